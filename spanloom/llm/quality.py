"""Quality rules as a short-circuit cascade (op2).

Base counts are computed for every document.  The verdict is a conjunction of
rules; their order is planned on a sample, by rejections per nanosecond among
the documents that the rules chosen before let through, and each rule then
computes on the survivors of those before it alone: the bytes of survivors are
copied together by the first rule that reads bytes after a rejection (a copy costs
a small part of any count over the same bytes), words and lines that are known
already are cut, and rules on known counts copy nothing.  What several rules need
(words, lines) is charged to the first of them.  The order changes the work, never
the verdict.

The sample is the first ``SAMPLE_ROWS`` documents of every input partition: a task
reads no further, whatever its partition holds and however often a text repeats.

Edge cases: a null or empty text has no words, so it fails the base test;
repeated rows are judged alike; an empty table gives an empty result; other
columns are ignored by :func:`measured` and passed through by :func:`kept`.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkit as tk
from .base import map_texts, table

MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
#: So many documents of each partition are timed to plan the order; verdicts don't depend on it.
SAMPLE_ROWS = 64

_LINE = tk.lut(b"\n")
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LETTER = _UPPER.copy()
_LETTER[97:123] = True
_LETTER[128:] = True
_SHOUT = np.zeros(256, bool)
_SHOUT[list(b"!?")] = True
_CONTROL = np.zeros(256, bool)
_CONTROL[:9] = _CONTROL[14:32] = _CONTROL[127] = True


class Features:
    """Counts of the documents of one slice, each computed when first asked for."""

    def __init__(self, buf: np.ndarray, off: np.ndarray):
        self.buf, self.off = buf, off

    @property
    def size(self) -> int:
        """Documents that a rule's arrays are computed on."""
        return len(self.off) - 1

    def only(self, rows: np.ndarray) -> Features:
        """The features of some documents: what is computed already is cut when asked for, the rest is computed on their bytes alone."""
        return _Some(self, rows)

    def total(self, mark: np.ndarray) -> np.ndarray:
        """Marked bytes in each document."""
        return np.diff(np.concatenate([[0], np.cumsum(mark, dtype=np.int64)])[self.off])

    @cached_property
    def words(self) -> tk.Words:
        return tk.Words(self.buf, self.off)

    @cached_property
    def n_words(self) -> np.ndarray:
        return self.words.count.astype(np.int64)

    @cached_property
    def word_chars(self) -> np.ndarray:
        return self.total(tk.BLANK[self.buf] & ((self.buf & 0xC0) != 0x80))

    @cached_property
    def n_symbols(self) -> np.ndarray:
        return self.total(_SYMBOL[self.buf])

    @cached_property
    def _lines(self) -> tuple[tk.Words, np.ndarray]:
        return self._counted_lines()

    def _counted_lines(self) -> tuple[tk.Words, np.ndarray]:
        lines = tk.Words(self.buf, self.off, _LINE)
        seen = np.concatenate([[0], np.cumsum(tk.BLANK[self.buf])])
        return lines, seen[lines.end] > seen[lines.start]

    @cached_property
    def n_lines(self) -> np.ndarray:
        lines, full = self._lines
        return np.bincount(lines.doc[full], minlength=len(self.off) - 1)

    @cached_property
    def n_dup_lines(self) -> np.ndarray:
        lines, full = self._lines
        return np.bincount(lines.doc[full][self._repeats(lines.hashes()[full], lines.doc[full])[1]], minlength=len(self.off) - 1)

    @cached_property
    def n_repeat_words(self) -> np.ndarray:
        w = self.words
        ok = np.flatnonzero(w.valid(5))
        hit = np.zeros(len(w.start), bool)
        hit[ok[self._repeats(tk.windows(w.hashes(), 5)[ok], w.doc[ok])[0]]] = True
        return np.bincount(w.doc[tk.covered(hit, 5)], minlength=len(self.off) - 1)

    @staticmethod
    def _repeats(h: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places whose value occurs twice in its document, and those that are not its first."""
        key = tk.mix(h + doc.astype(tk.U64) * tk.LANES[1][0])
        order = np.argsort(key, kind="stable")
        same = key[order[1:]] == key[order[:-1]]
        later = order[1:][same]
        return np.union1d(later, order[:-1][same]), later

    def upper_letters(self) -> tuple[np.ndarray, np.ndarray]:
        return self.total(_UPPER[self.buf]), self.total(_LETTER[self.buf])

    def shouts(self) -> np.ndarray:
        return self.total(_SHOUT[self.buf])

    def controls(self) -> np.ndarray:
        return self.total(_CONTROL[self.buf])

    def wordy(self) -> np.ndarray:
        """Words with a letter."""
        w = self.words
        seen = np.concatenate([[0], np.cumsum(_LETTER[self.buf])])
        return np.bincount(w.doc[seen[w.end] > seen[w.start]], minlength=len(self.off) - 1)


def _caps(f: Features) -> np.ndarray:
    upper, letters = f.upper_letters()
    return (letters > 0) & (10 * upper > 6 * letters)


#: name -> True where the rule rejects a document.
RULES: dict[str, Callable[[Features], np.ndarray]] = {
    "few_words": lambda f: f.n_words < MIN_WORDS,
    "repeated_windows": lambda f: 100 * f.n_repeat_words > MAX_REPEAT_PERCENT * f.n_words,
    "word_length": lambda f: (f.word_chars < 2 * f.n_words) | (f.word_chars > 20 * f.n_words),
    "symbols": lambda f: 5 * f.n_symbols > f.n_words,
    "repeated_lines": lambda f: (f.n_lines > 3) & (10 * f.n_dup_lines > 3 * f.n_lines),
    "capitals": _caps,
    "exclamation": lambda f: 5 * f.shouts() > 2 * f.n_words,
    "letters": lambda f: 2 * f.wordy() < f.n_words,
    "control_bytes": lambda f: 20 * f.controls() > np.diff(f.off),
}


#: Features that a rule shares with others.
NEEDS: dict[str, tuple[str, ...]] = {
    "few_words": ("words",), "repeated_windows": ("words", "n_repeat_words"), "word_length": ("words", "word_chars"), "symbols": ("words", "n_symbols"),
    "repeated_lines": ("_lines", "n_dup_lines"), "exclamation": ("words",), "letters": ("words",),
}
#: What :func:`measured` has computed before the cascade starts.
_BASE = ("words", "n_repeat_words", "word_chars", "n_symbols", "_lines", "n_dup_lines")


class _Some(Features):
    """Some documents of a slice.  Bytes, words and lines are taken from the slice they were cut from when they are first asked for."""

    _COUNTS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")

    def __init__(self, source: Features, rows: np.ndarray):
        known = {}
        while True:  # counts from the nearest slice that has them, bytes from the nearest that holds some
            for name in self._COUNTS:
                if name not in known and name in source.__dict__:
                    known[name] = source.__dict__[name][rows]
            if not isinstance(source, _Some) or "buf" in source.__dict__:
                break
            source, rows = source._source, source._rows[rows]
        self.__dict__.update(known)
        self._source, self._rows = source, rows

    @cached_property
    def off(self) -> np.ndarray:
        return np.concatenate([[0], np.cumsum(np.diff(self._source.off)[self._rows])])

    @cached_property
    def buf(self) -> np.ndarray:
        rows, source = self._rows, self._source
        if not rows.size:
            return source.buf[:0]
        gap = np.flatnonzero(np.diff(rows) != 1) + 1  # neighbours are copied at once
        first, last = rows[np.concatenate([[0], gap])], rows[np.concatenate([gap - 1, [rows.size - 1]])]
        return np.concatenate([source.buf[a:b] for a, b in zip(source.off[first], source.off[last + 1], strict=True)])

    @cached_property
    def words(self) -> tk.Words:
        if "words" in self._source.__dict__:
            return self._source.words.only(self._rows, self.buf, self.off)[0]
        return tk.Words(self.buf, self.off)

    @cached_property
    def _lines(self) -> tuple[tk.Words, np.ndarray]:
        if "_lines" in self._source.__dict__:
            lines, full = self._source._lines
            some, places = lines.only(self._rows, self.buf, self.off)
            return some, full[places]
        return self._counted_lines()


def cascade(f: Features, order: list[str], rules: dict[str, Callable] = RULES) -> np.ndarray:
    """True for the documents that no rule rejects; every rule computes on the survivors of those before it."""
    now = f
    rows = np.arange(f.size)
    for name in order:
        if not rows.size:
            break
        good = np.flatnonzero(~rules[name](now))
        if good.size < rows.size:
            rows, now = rows[good], now.only(good)
    out = np.zeros(f.size, bool)
    out[rows] = True
    return out


def plan(docs: DataFrame, rules: dict[str, Callable] = RULES, sample_rows: int = SAMPLE_ROWS, known: tuple[str, ...] = ()) -> list[str]:
    """Rules by rejection per cost on the first ``sample_rows`` documents of each partition, measured on the executors.

    Greedy: each step takes the rule with the most rejections per nanosecond
    among documents that the rules taken before let through.  A shared feature
    costs only the first rule that needs it, and nothing if it is ``known``.  The
    driver gets one row for each pattern of rejections.
    """
    names = list(rules)
    shared = sorted({x for name in names for x in NEEDS.get(name, ())})

    def measure(buf: np.ndarray, off: np.ndarray) -> pa.RecordBatch:
        f, mask, cost = Features(buf, off), np.zeros(len(off) - 1, np.int64), []
        for x in shared:
            began = time.perf_counter_ns()
            getattr(f, x)
            cost.append(time.perf_counter_ns() - began)
        for i, name in enumerate(names):
            began = time.perf_counter_ns()
            mask |= rules[name](f).astype(np.int64) << i
            cost.append(time.perf_counter_ns() - began)
        patterns, n = np.unique(mask, return_counts=True)
        each = [[c * k / mask.size for c in cost] for k in n]
        return pa.RecordBatch.from_pydict({"pattern": pa.array(patterns), "n": pa.array(n.astype(np.int64)), "cost": pa.array(each, pa.list_(pa.float64()))})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left = sample_rows
        for batch in batches:
            for _, _, buf, off in tk.text_slices(batch.column("text").slice(0, left)):
                yield measure(buf, off)
            left -= min(left, batch.num_rows)
            if not left:
                return

    got = (
        docs.select("text").mapInArrow(run, "pattern long, n long, cost array<double>")
        .groupBy("pattern")
        .agg(F.sum("n").alias("n"), *[F.sum(F.col("cost")[i]).alias(f"c{i}") for i in range(len(shared) + len(names))])
        .collect()
    )
    spent = [sum(r[f"c{i}"] for r in got) for i in range(len(shared) + len(names))]
    price, own = dict(zip(shared, spent, strict=False)), dict(zip(names, spent[len(shared) :], strict=True))
    have, left, order, alive = set(known), set(names), [], list(got)
    while left:
        cost = {x: own[x] + sum(price[y] for y in NEEDS.get(x, ()) if y not in have) for x in left}
        rate = {x: sum(r["n"] for r in alive if r["pattern"] >> names.index(x) & 1) / max(cost[x], 1.0) for x in left}
        best = max(sorted(left), key=rate.get)
        order.append(best)
        left.discard(best)
        have |= set(NEEDS.get(best, ()))
        alive = [r for r in alive if not r["pattern"] >> names.index(best) & 1]
    return order


def measured(docs: DataFrame, order: list[str] | None = None) -> DataFrame:
    """doc_id, the base counts and the verdict of each document."""
    order = order or plan(docs, known=_BASE)

    def run(batch: pa.RecordBatch, lo: int, hi: int, buf: np.ndarray, off: np.ndarray) -> pa.RecordBatch:
        f = Features(buf, off)
        failed = (f.n_words < MIN_WORDS) | (100 * f.n_repeat_words > MAX_REPEAT_PERCENT * f.n_words)
        kept = np.zeros(hi - lo, bool)
        rows = np.flatnonzero(~failed)
        rest = [x for x in order if x not in ("few_words", "repeated_windows")]
        kept[rows] = cascade(f.only(rows), rest)
        cols = [f.n_words, f.word_chars, f.n_symbols, f.n_dup_lines, f.n_repeat_words]
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id").slice(lo, hi - lo), *[pa.array(c.astype(np.int64)) for c in cols], pa.array(failed), pa.array(kept)],
            ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"],
        )

    return map_texts(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"),
        run,
        "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean",
    )


def kept(docs: DataFrame, order: list[str] | None = None, column: str = "text") -> DataFrame:
    """The documents, all their columns, that no rule rejects."""
    order = order or plan(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, buf, off in tk.text_slices(batch.column(column)):
                good = cascade(Features(buf, off), order)
                yield batch.slice(lo, hi - lo).filter(pa.array(good))

    return docs.mapInArrow(run, docs.schema)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measured(table(spark, sf_dir, "documents"))


#: The same counts and rules in SQL; ``regexp_extract_all`` yields the words.
SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
l AS (SELECT *, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
g AS (SELECT doc_id, unnest(range(1, len(w) - 3)) AS i, unnest(list_transform(range(1, len(w) - 3), lambda i: w[i:i+4])) AS win FROM d WHERE len(w) >= 5),
r AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, win) AS c FROM g) WHERE c > 1),
p AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM r, range(5) AS x(k) GROUP BY doc_id),
f AS (
  SELECT doc_id, t, w, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, len(ls)::BIGINT AS n_lines,
    (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(p.n, 0)::BIGINT AS n_repeat_words,
    length(regexp_replace(t, '[^A-Z]', '', 'g')) AS upper_letters,
    strlen(regexp_replace(t, '[\x00-\x40\x5B-\x60\x7B-\x7F]', '', 'g')) AS letters,
    length(regexp_replace(t, '[^!?]', '', 'g')) AS shouts,
    len(list_filter(w, lambda x: regexp_matches(x, '[^\x00-\x40\x5B-\x60\x7B-\x7F]'))) AS wordy,
    length(regexp_replace(t, '[^\x00-\x08\x0E-\x1F\x7F]', '', 'g')) AS controls, strlen(t) AS bytes
  FROM l LEFT JOIN p USING (doc_id)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT (word_chars < 2 * n_words OR word_chars > 20 * n_words) AND 5 * n_symbols <= n_words
  AND NOT (n_lines > 3 AND 10 * n_dup_lines > 3 * n_lines) AND NOT (letters > 0 AND 10 * upper_letters > 6 * letters)
  AND 5 * shouts <= 2 * n_words AND 2 * wordy >= n_words AND 20 * controls <= bytes AS kept
FROM b
"""
