"""Sequential rules: each is a fold over one series, so it runs as a streaming kernel.

Rules whose state is a few numbers (refractory, hysteresis, placement) are
streams: a task holds one batch and that state.  For the others series are first
cut where a gap is longer than the rule can see; the state before such a gap has
no effect after it, so a kernel folds one *segment* at a time.  Rows come sorted
from the window that cut them, without another shuffle, and a task holds one
batch and the segment that runs over its end; only a quota over the highest rows
of a series holds the series.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .series import sessions

Keys = Sequence[str]
#: Rows of several segments and where each starts and ends -> the rows that come out.
Fold = Callable[[pd.DataFrame, list[tuple[int, int]]], pd.DataFrame]


def folded(df: DataFrame, keys: Keys, gap: int | float | None, fold: Fold, schema: str, t: str = "t", tie: Sequence[str] = ()) -> DataFrame:
    """Fold each segment, sorted by time and ties; ``gap`` None keeps a series whole."""
    if gap is not None:
        cut = sessions(df, keys, gap, t, tie).drop("first")
    else:
        cut = df.repartition(*keys).withColumn("session", F.lit(0).cast("bigint"))
    names = [*keys, "session"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for pdf in batches:
            new = _starts(pdf, names)
            if held and not _starts(pd.concat([held[-1].tail(1), pdf.head(1)]), names)[1]:
                new[0] = False
            if not new.any():
                held.append(pdf)
                continue
            last = int(np.flatnonzero(new)[-1])
            if held or last:
                yield done(pd.concat([*held, pdf.iloc[:last]]))
            held = [pdf.iloc[last:]]
        if held:
            yield done(pd.concat(held))

    def done(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.reset_index(drop=True)
        starts = np.flatnonzero(_starts(pdf, names)).tolist()
        out = fold(pdf, list(zip(starts, [*starts[1:], len(pdf)], strict=True)))
        return out.astype({c: object for c, kind in out.dtypes.items() if not isinstance(kind, np.dtype)})

    return cut.sortWithinPartitions(*names, t, *tie).mapInPandas(run, schema)


def _starts(pdf: pd.DataFrame, names: Sequence[str]) -> np.ndarray:
    """True where a row's names differ from the row's before; the first row is one."""
    new = np.zeros(len(pdf), bool)
    new[:1] = True
    for c in names:
        v = pdf[c].to_numpy()
        new[1:] |= np.asarray(v[1:] != v[:-1], bool)
    return new


def _schema(df: DataFrame, *more: str) -> str:
    return ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema), *more])


#: State and the rows of one series that lie in one batch -> state, and the rows that come out.
Step = Callable[[tuple, pd.DataFrame], tuple[tuple, pd.DataFrame]]


def streamed(df: DataFrame, keys: Keys, order: Sequence[str], step: Step, fresh: tuple, schema: str) -> DataFrame:
    """Fold every series in order; what a task carries from batch to batch is a series' key and its state."""
    names = list(keys)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state = None, fresh
        for pdf in batches:
            starts, out = np.flatnonzero(_starts(pdf, names)).tolist(), []
            for a, b in zip(starts, [*starts[1:], len(pdf)], strict=True):
                mine = tuple(pdf[c].iat[a] for c in names)
                if mine != key:
                    key, state = mine, fresh
                state, rows = step(state, pdf.iloc[a:b])
                out.append(rows)
            if out:
                yield pd.concat(out)

    return df.repartition(*keys).sortWithinPartitions(*names, *order).mapInPandas(run, schema)


def refractory(df: DataFrame, keys: Keys, gap: int | float, t: str = "t", tie: Sequence[str] = ()) -> DataFrame:
    """Rows at least ``gap`` after the last row *kept*: from one kept row the next is found by bisection."""

    def step(state: tuple, pdf: pd.DataFrame) -> tuple[tuple, pd.DataFrame]:
        (last,), times, keep = state, pdf[t].to_numpy(), []
        at = 0 if last is None else int(np.searchsorted(times, last + gap))
        while at < len(times):
            keep.append(at)
            last = times[at]
            at = max(at + 1, int(np.searchsorted(times, last + gap)))
        return (last,), pdf.iloc[keep]

    return streamed(df, keys, [t, *tie], step, (None,), _schema(df))


def rising_edges(df: DataFrame, keys: Keys, threshold: float, slope: float, gap: int, v: str = "score", i: str = "i") -> DataFrame:
    """Rows over the threshold that rose by ``slope`` since the row before, ``gap`` after the last accepted."""
    rise = F.col(v) - F.lag(v).over(Window.partitionBy(*keys).orderBy(i))
    return refractory(df.withColumn("rise", rise).where((F.col(v) >= threshold) & (F.col("rise") >= slope)).drop("rise"), keys, gap, i)


def hysteresis(df: DataFrame, keys: Keys, enter: float, stay: float, hold: int, v: str = "score", i: str = "i") -> DataFrame:
    """Adds ``on``: set at ``enter``, kept while ``stay`` is reached at least every ``hold`` rows; the hold's tail is on."""

    def step(carried: tuple, pdf: pd.DataFrame) -> tuple[tuple, pd.DataFrame]:
        (state, quiet), on = carried, []
        for value in pdf[v].tolist():
            if not state:
                state, quiet = value >= enter, 0
            else:
                quiet = 0 if value >= stay else quiet + 1
                state = quiet <= hold
            on.append(state)
        return (state, quiet), pdf.assign(on=np.array(on, bool))

    return streamed(df, keys, [i], step, (False, 0), _schema(df, "`on` boolean"))


def min_separation(df: DataFrame, keys: Keys, gap: int | float, v: str, t: str = "t", tie: Sequence[str] = ()) -> DataFrame:
    """Rows at least ``gap`` apart: a row too near the last kept one replaces it if its value is higher."""

    def fold(pdf: pd.DataFrame, segments: list[tuple[int, int]]) -> pd.DataFrame:
        kept: list[int] = []
        times, values = pdf[t].tolist(), pdf[v].tolist()
        for a, b in segments:
            first = len(kept)
            for n in range(a, b):
                if len(kept) > first and times[n] - times[kept[-1]] < gap:
                    if values[n] > values[kept[-1]]:
                        kept[-1] = n
                else:
                    kept.append(n)
        return pdf.loc[kept].drop(columns="session")

    return folded(df, keys, gap, fold, _schema(df), t, tie)


def suppressed(df: DataFrame, keys: Keys, reach: int | float, v: str, t: str = "t", tie: Sequence[str] = (), quota: int | None = None) -> DataFrame:
    """Highest first, rows with no taken row closer than ``reach``; at most ``quota`` a series if given."""

    def fold(pdf: pd.DataFrame, segments: list[tuple[int, int]]) -> pd.DataFrame:
        out: list[int] = []
        times, values = pdf[t].tolist(), pdf[v].tolist()
        for a, b in segments:
            taken: list[int] = []  # by time: only the neighbours of a new row can be too near
            for n in sorted(range(a, b), key=lambda n: (-values[n], n)):
                if quota is not None and len(taken) == quota:
                    break
                at = bisect_left(taken, n)
                if all(abs(times[n] - times[m]) >= reach for m in taken[max(0, at - 1) : at + 1]):
                    taken.insert(at, n)
            out += taken
        return pdf.loc[out].drop(columns="session")

    return folded(df, keys, None if quota is not None else reach, fold, _schema(df), t, tie)


def peaks(df: DataFrame, keys: Keys, distance: int, height: float, v: str = "v", i: str = "i") -> DataFrame:
    """Local maxima of at least ``height``, the higher ones first, none closer than ``distance`` to one taken."""
    from .series import local_maxima

    return suppressed(local_maxima(df, keys, v, i).where(F.col(v) >= height), keys, distance, v, i)


def placed(df: DataFrame, keys: Keys, size: str, room: int, gap: int, order: str) -> DataFrame:
    """First fit in order on a canvas of ``room``: rows with ``at``, until one does not fit."""

    def step(state: tuple, pdf: pd.DataFrame) -> tuple[tuple, pd.DataFrame]:
        cursor, at = state[0], []
        for n in pdf[size].tolist():
            if cursor is None or cursor + n > room:
                cursor = None
                break
            at.append(cursor)
            cursor += n + gap
        return (cursor,), pdf.iloc[: len(at)].assign(at=np.array(at, np.int64))

    return streamed(df, keys, [order], step, (0,), _schema(df, "`at` bigint"))


def added(df: DataFrame, keys: Keys, gap: int | float, t: str = "t", tie: Sequence[str] = ()) -> DataFrame:
    """Completion: in time order, rows at least ``gap`` from every row added before."""
    return refractory(df, keys, gap, t, tie)


# One-to-one matching. Each policy takes sorted times of both sides and gives pairs of places.


def optimal(p: np.ndarray, o: np.ndarray, tolerance: float) -> list[tuple[int, int]]:
    """Most pairs, then least total distance: on a line some best matching does not cross, so a table over prefixes is exact.

    The table of the first a predictions is kept for the labels that the a-th can
    reach: before them it is that of the row above, beyond them it stays level.
    """
    low, high = np.searchsorted(o, p - tolerance).tolist(), np.searchsorted(o, p + tolerance, "right").tolist()
    p, o = p.tolist(), o.tolist()
    rows: list[list[tuple[int, float]]] = [[(0, 0.0)]]
    low, high = [0, *low], [0, *high]

    def at(a: int, b: int) -> tuple[int, float]:
        return rows[a][min(b, high[a]) - low[a]]

    for a in range(1, len(p) + 1):
        row = [at(a - 1, low[a])]
        for b in range(low[a] + 1, high[a] + 1):
            c, total = at(a - 1, b - 1)
            row.append(min(at(a - 1, b), row[-1], (c - 1, total + abs(p[a - 1] - o[b - 1]))))
        rows.append(row)
    pairs, a, b = [], len(p), len(o)
    while a and b:
        b = min(b, high[a])
        if b <= low[a] or at(a, b) == at(a - 1, b):
            a -= 1
        elif at(a, b) == at(a, b - 1):
            b -= 1
        else:
            pairs.append((a - 1, b - 1))
            a, b = a - 1, b - 1
    return pairs[::-1]


def _nearest(o: np.ndarray, x: float, near: int) -> list[int]:
    """The ``near`` nearest places of sorted ``o``, nearest first and the lower place of equals."""
    at = int(np.searchsorted(o, x))
    first = int(np.searchsorted(o, o[at - near])) if at > near else 0  # with all that equal the last one to the left
    part = np.abs(o[first : at + near] - x)
    return (np.argsort(part, kind="stable")[:near] + first).tolist()


def greedy_input(p: np.ndarray, o: np.ndarray, tolerance: float, near: int = 4) -> list[tuple[int, int]]:
    """Each prediction in turn takes the nearest free label among its ``near`` nearest."""
    used, pairs = set(), []
    for a, x in enumerate(p):
        for b in _nearest(o, x, near):
            if b not in used and abs(o[b] - x) <= tolerance:
                used.add(b)
                pairs.append((a, b))
                break
    return pairs


def greedy_retry(p: np.ndarray, o: np.ndarray, tolerance: float, near: int = 4) -> list[tuple[int, int]]:
    """The nearest label if it is within the tolerance, or if that is taken the next of the ``near`` nearest; else skip."""
    used, pairs = set(), []
    for a, x in enumerate(p):
        order = _nearest(o, x, near)
        if not order or abs(o[order[0]] - x) > tolerance:
            continue
        free = next((b for b in order if b not in used and abs(o[b] - x) <= tolerance), None)
        if free is not None:
            used.add(free)
            pairs.append((a, free))
    return pairs


def greedy_global(p: np.ndarray, o: np.ndarray, tolerance: float) -> list[tuple[int, int]]:
    """All pairs within the tolerance, closest first, each side once."""
    low, high = np.searchsorted(o, p - tolerance), np.searchsorted(o, p + tolerance, "right")
    order = sorted((abs(p[a] - o[b]), a, b) for a in range(len(p)) for b in range(low[a], high[a]))
    left, right, pairs = set(), set(), []
    for _, a, b in order:
        if a not in left and b not in right:
            left.add(a)
            right.add(b)
            pairs.append((a, b))
    return sorted(pairs)


def label_major(p: np.ndarray, o: np.ndarray, tolerance: float, near: int = 5) -> list[tuple[int, int]]:
    """Each label in turn takes the nearest free prediction among its ``near`` nearest."""
    return sorted((a, b) for b, a in greedy_input(o, p, tolerance, near))


POLICIES = {"optimal": optimal, "greedy_input": greedy_input, "greedy_retry": greedy_retry, "greedy_global": greedy_global, "label_major": label_major}


def matched(predicted: DataFrame, actual: DataFrame, keys: Keys, tolerance: int | float, policy: str = "optimal", t: str = "t") -> DataFrame:
    """Pairs (keys, predicted, actual) of times, one to one within the tolerance.

    Both sides are cut together where neighbours are more than the tolerance
    apart: no pair crosses such a gap.
    """
    match = POLICIES[policy]
    both = predicted.select(*keys, t, F.lit(0).alias("side")).unionByName(actual.select(*keys, t, F.lit(1).alias("side")))
    kind = dict(predicted.dtypes)
    schema = ", ".join([*(f"`{k}` {kind[k]}" for k in keys), f"predicted {kind[t]}, actual {kind[t]}"])

    def fold(pdf: pd.DataFrame, segments: list[tuple[int, int]]) -> pd.DataFrame:
        side, times, rows, p, o = pdf["side"].to_numpy(), pdf[t].to_numpy(), [], [], []
        for a, b in segments:
            here = side[a:b] == 0
            left, right = times[a:b][here], times[a:b][~here]
            if left.size and right.size:
                found = match(left, right, tolerance)
                rows += [a] * len(found)
                p += [left[i] for i, _ in found]
                o += [right[j] for _, j in found]
        out = {k: pd.Series(pdf[k].to_numpy()[rows] if rows else [], dtype=object) for k in keys}
        return pd.DataFrame(out | {"predicted": p, "actual": o})

    return folded(both, keys, tolerance, fold, schema, t, ["side"])


def coincidence(outputs: DataFrame, references: DataFrame, bands: DataFrame, keys: Keys, tolerance: int | float, step: int, low: str, others: Sequence[str], share: float = 1.5) -> DataFrame:
    """(keys, n_output, coincidence, lowband): outputs matched one to one with references, and how many of these references are low.

    ``bands`` has band series by index; a reference at time t has the index
    t / ``step``, rounded half up, and is low where the band ``low`` is at least
    ``share`` times the sum of the others there; what is missing is silence.
    """
    found = matched(outputs.select(*keys, "t"), references.select(*keys, "t"), keys, tolerance)
    found = found.withColumn("i", F.floor((F.col("actual") + step // 2) / step))
    rest = F.lit(0.0)
    for c in others:
        rest = rest + F.coalesce(F.col(c), F.lit(0.0))
    low_there = F.coalesce(F.col(low), F.lit(0.0)) >= share * rest
    pairs = found.join(bands.select(*keys, "i", low, *others), [*keys, "i"], "left").groupBy(*keys).agg(F.count("*").alias("coincidence"), F.count_if(low_there).alias("lowband"))
    return outputs.groupBy(*keys).agg(F.count("*").alias("n_output")).join(pairs, list(keys), "left").fillna(0, ["coincidence", "lowband"])
