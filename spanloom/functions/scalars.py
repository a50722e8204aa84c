"""Column functions: levels, clamps, tiers, labels, paths, hashes and text patterns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

Col = Column | str


def _c(x: Col) -> Column:
    return F.col(x) if isinstance(x, str) else x


def amplitude_db(x: Col, floor: float = 1e-12) -> Column:
    """20 log10 of an amplitude, with a floor added."""
    return 20 * F.log10(_c(x) + F.lit(floor))


def power_db(x: Col, floor: float = 1e-12, additive: bool = False) -> Column:
    """10 log10 of a power, floored by maximum or by addition."""
    return 10 * F.log10(_c(x) + F.lit(floor) if additive else F.greatest(_c(x), F.lit(floor)))


def gain(db: Col) -> Column:
    return F.pow(F.lit(10.0), _c(db) / 20)


def clamp(x: Col, low: Col | float, high: Col | float) -> Column:
    lift = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.least(F.greatest(_c(x), lift(low)), lift(high))


def index_truncated(seconds: Col, rate: float) -> Column:
    return (_c(seconds) * rate).cast("bigint")


def index_rounded(seconds: Col, rate: float) -> Column:
    """Half to even, as on binary doubles."""
    return F.rint(_c(seconds) * rate).cast("bigint")


def reference_time(t: Col, offset: Col, drift: Col | None = None) -> Column:
    """Time on the reference clock: t - (offset + drift * t)."""
    return _c(t) - (_c(offset) + (_c(drift) * _c(t) if drift is not None else F.lit(0.0)))


def minutes_seconds(seconds: Col) -> Column:
    return F.format_string("%d:%02d", F.floor(_c(seconds) / 60).cast("int"), F.floor(_c(seconds) % 60).cast("int"))


def ratio(top: Col, bottom: Col) -> Column:
    """A ratio whose denominator is at least one."""
    return _c(top) / F.greatest(_c(bottom), F.lit(1))


def confidence_tier(over_noise: Col, peak: Col) -> Column:
    """strong, present, weak or no_transient, all limits exclusive."""
    r = _c(over_noise)
    return (
        F.when((r > 4) & (_c(peak) > 0.35), "strong").when(r > 2.5, "present").when(r > 1.6, "weak").otherwise("no_transient")
    )


def banded(x: Col, bands: Sequence[tuple[float, str]], other: str | None = None) -> Column:
    """The label of the first band whose lower limit ``x`` reaches."""
    out = F.lit(None).cast("string")
    if other is not None:
        out = F.lit(other)
    for low, label in reversed(bands):
        out = F.when(_c(x) >= low, label).otherwise(out)
    return out


#: Contrast in dB of the event kinds; below the last an event is dropped.
IMPACT_BANDS = [(12.0, "strong_impact"), (6.0, "impact"), (3.0, "weak_contact")]


def reasons(*failed: tuple[str, Column]) -> Column:
    """Codes, in order, of the conditions that hold; a null condition doesn't."""
    return F.array_compact(F.array(*[F.when(c, F.lit(code)) for code, c in failed]))


def labels(*held: tuple[str, Column]) -> Column:
    """Sorted set of the labels whose conditions hold."""
    return F.array_sort(reasons(*held))


def extension(path: Col) -> Column:
    return F.lower(F.regexp_extract(_c(path), r"\.([A-Za-z0-9]+)$", 1))


def stem(path: Col) -> Column:
    return F.regexp_replace(F.element_at(F.split(_c(path), "/"), -1), r"\.[A-Za-z0-9]+$", "")


def segment(path: Col, i: int) -> Column:
    """A path segment by place, from 1, or from the end if negative; null where there is none."""
    return F.try_element_at(F.filter(F.split(_c(path), "/"), lambda x: x != ""), F.lit(i))


def family(name: Col, markers: str) -> Column:
    """A name without its derived markers."""
    return F.trim(F.regexp_replace(_c(name), f"(?i){markers}", ""))


def clock_seconds(text: Col, pattern: str = r"(\d+):(\d+):(\d+(?:\.\d+)?)") -> Column:
    """h:m:s in a text as seconds, null without one."""
    part = lambda i: F.regexp_extract(_c(text), pattern, i)
    return F.when(part(1) != "", part(1).cast("double") * 3600 + part(2).cast("double") * 60 + part(3).cast("double"))


#: Absolute paths of common systems.
PRIVATE_PATHS = r"(?:[A-Za-z]:\\|/(?:home|Users|mnt)/)[^\s\"']*"


def private_paths(text: Col) -> Column:
    return F.regexp_extract_all(_c(text), F.lit(PRIVATE_PATHS), F.lit(0))


def uniform(seed: int, *keys: Col) -> Column:
    """A number in [0, 1) that depends on the seed and keys alone: 40 bits of an MD5, which any engine can repeat."""
    text = F.concat_ws(":", F.lit(str(seed)), *[_c(k).cast("string") for k in keys])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 10), 16, 10).cast("bigint") / F.lit(float(1 << 40))


def assignment_hash(items: Col) -> Column:
    """SHA-256 of the sorted items, joined by line breaks."""
    return F.sha2(F.array_join(F.array_sort(_c(items)), "\n").cast("binary"), 256)
