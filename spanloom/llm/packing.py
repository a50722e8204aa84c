"""Harmonic packing of token sequences (op7).

Lengths, with the end id, fall into reciprocal classes: a document of n ids is
of class k = floor(4096 / n), and a bin of class k takes k whole documents of
that class.  Only a document longer than a sequence is cut at once: it fills
sequences alone, and its rest is classed like any document.

A bin that has its k documents still has room, under a k + 1st of 4096 ids.  As
soon as this room is more than what the unfilled bins hold, documents that
come next are given to it, each whole into the fullest bin that has room for
it; when the room grows to twice that and no bin has room for a whole one, a
document is cut over the widest rooms.  A sequence is given out when it is full.

Workers fill bins independently: nothing is shuffled, and a worker holds the
ids of its bins alone, of about 64 classes whatever the corpus.  At the end of
its rows a worker fills rooms from the unfilled bins, then from the emptiest
bins.  Its very last sequence is cut into sequences whose lengths are powers of
two, so nothing is padded.

A worker is an input partition, whose number is taken below the kernel:
partitions that are coalesced later into one task keep their own numbers, so
sequence ids never meet.

Ids come from a public tokenizer whose merges never cross white space, so a
worker keeps the ids of words it has seen (``MEMO`` of them at most, then it
starts again).

Edge cases: null and empty texts have the end id alone; repeated rows and rows
without doc_id are packed like any; an empty table gives an empty result; other
columns are ignored; texts are never truncated.
"""

from __future__ import annotations

import string
import struct
import zlib
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import table

CAPACITY = 4096
END = 2
TOKENIZER = "word_bpe_49k.json"
#: Most words remembered.
MEMO = 550_000

_PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_NAMES = [x.split()[0] for x in _PIECE.split(", ")]


#: ASCII signs but the apostrophe, which the splitter may keep with the letters after it.
_STOPS = string.punctuation.replace("'", "")
_FORMATS = [f"<{n}I" for n in range(32)]


def _packed(ids: list[int]) -> bytes:
    return struct.pack(_FORMATS[len(ids)] if len(ids) < 32 else f"<{len(ids)}I", *ids)


@lru_cache(1)
def ids_of(path: str) -> Ids:
    """One tokenizer and memo for all tasks of a Python worker."""
    return Ids(path)


def _visible_bytes() -> dict[int, str]:
    """The byte-level alphabet: printable bytes stand for themselves, the others for the characters from 256 on."""
    kept = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in kept]
    return {b: chr(b) for b in kept} | {b: chr(256 + i) for i, b in enumerate(rest)}


class _Memo(dict):
    """Values of a function, each computed when first asked for."""

    def __init__(self, make: Callable[[str], bytes]):
        super().__init__()
        self.make = make

    def __missing__(self, word: str) -> bytes:
        out = self[word] = self.make(word)
        return out


class Ids:
    """Token ids of texts as little-endian 32-bit words, by words that white space parts.

    A new word of plain letters is one run of the tokenizer's splitter, and
    signs after it are another, so the letters go to the merges directly; any
    other word goes through the whole tokenizer.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer, self.memo = Tokenizer.from_file(path), _Memo(self._word)
        self.model, visible = self.tokenizer.model, _visible_bytes()
        # letters below U+0130 lower to one letter each and are in normal form
        self.letters = {c: "".join(visible[b] for b in chr(c).lower().encode()) for c in range(0x130) if chr(c).isalpha()}

    def _whole(self, word: str) -> bytes:
        return _packed(self.tokenizer.encode(word, add_special_tokens=False).ids)

    def _word(self, word: str) -> bytes:
        letters = core = word.rstrip(_STOPS)
        if not core.isalpha():
            return self._whole(word)
        if core.isascii():  # such letters stand for themselves
            core = core.lower()
        elif max(core) < "\u0130":
            core = core.translate(self.letters)
        else:
            return self._whole(word)
        ids = _packed([t.id for t in self.model.tokenize(core)])
        return ids if len(letters) == len(word) else ids + self.memo[word[len(letters) :]]

    def many(self, texts: list[str]) -> list[bytes]:
        if len(self.memo) > MEMO:
            self.memo.clear()
        ids = self.memo.__getitem__
        return [b"".join(map(ids, text.replace("\n", " ").split(" "))) for text in texts]


@dataclass
class Part:
    """Ids of a document from ``start`` on, as bytes."""

    doc: int | None
    start: int
    ids: memoryview
    total: int

    def __len__(self) -> int:
        return len(self.ids) // 4

    def cut(self, n: int) -> tuple[Part, Part]:
        return Part(self.doc, self.start, self.ids[: 4 * n], self.total), Part(self.doc, self.start + n, self.ids[4 * n :], self.total)


class Bins:
    """The bins of one worker; full sequences go to ``out`` at once."""

    def __init__(self, first: int):
        self.next, self.out = first, []
        self.open: dict[int, list[Part]] = defaultdict(list)
        self.held = 0  # ids in bins that lack documents
        self.rooms: list[tuple[int, int]] = []  # (room, bin) of bins that have their documents, in order
        self.room, self.closed = 0, {}

    def add(self, doc: int | None, blob: bytes) -> None:
        part = Part(doc, 0, memoryview(blob), len(blob) // 4)
        while len(part) > CAPACITY:
            whole, part = part.cut(CAPACITY)
            self.give([whole])
        if self.room > self.held and len(part) <= self.rooms[-1][0]:
            self.fill(bisect_left(self.rooms, (len(part), -1)), part)
        elif self.room > 2 * self.held + len(part):
            while len(part) > self.rooms[-1][0]:
                some, part = part.cut(self.rooms[-1][0])
                self.fill(-1, some)
            self.fill(bisect_left(self.rooms, (len(part), -1)), part)
        else:
            k = CAPACITY // len(part)
            mine = self.open[k]
            mine.append(part)
            self.held += len(part)
            if len(mine) == k:
                self.held -= sum(map(len, mine))
                self.close(self.open.pop(k))

    def close(self, parts: list[Part]) -> None:
        left = CAPACITY - sum(map(len, parts))
        if not left:
            return self.give(parts)
        self.closed[self.next] = parts
        insort(self.rooms, (left, self.next))
        self.room, self.next = self.room + left, self.next + 1

    def fill(self, at: int, part: Part) -> None:
        """Put a part into the closed bin at a place of ``rooms``."""
        room, number = self.rooms.pop(at)
        self.closed[number].append(part)
        self.room -= len(part)
        if room > len(part):
            insort(self.rooms, (room - len(part), number))
        else:
            self.give(self.closed.pop(number), number)

    def give(self, parts: list[Part], number: int | None = None) -> None:
        if number is None:
            number, self.next = self.next, self.next + 1
        at = 0
        for p in parts:
            self.out.append((p.doc, p.start, len(p), zlib.crc32(p.ids), p.total, number, at))
            at += len(p)

    def finish(self) -> None:
        """Fill what is left: the fullest bins first, from unfilled bins, then from the emptiest."""
        spare = sorted(((len(p), i, p) for i, p in enumerate(p for k in sorted(self.open) for p in self.open[k])), key=lambda x: x[:2])
        bins = [self.closed[number] for _, number in self.rooms]
        self.open, self.closed, self.rooms, self.held, self.room = defaultdict(list), {}, [], 0, 0
        extra = len(spare)
        while bins or spare:
            parts = bins.pop(0) if bins else []
            left = CAPACITY - sum(map(len, parts))
            while left:
                if not spare and bins:
                    for p in bins.pop():
                        insort(spare, (len(p), extra, p), key=lambda x: x[:2])
                        extra += 1
                if not spare:
                    break
                at = bisect_left(spare, left + 1, key=lambda x: x[0]) - 1  # the longest that fits, or a cut of the shortest
                size, nth, p = spare.pop(max(at, 0))
                if size > left:
                    p, rest = p.cut(left)
                    insort(spare, (len(rest), nth, rest), key=lambda x: x[:2])
                parts.append(p)
                left -= len(p)
            self.powers(parts) if left else self.give(parts)

    def powers(self, parts: list[Part]) -> None:
        """Sequences whose lengths are the powers of two that add up to what is left."""
        left, parts = sum(map(len, parts)), parts[::-1]
        while left:
            size, some = 1 << left.bit_length() - 1, []
            left -= size
            while size:
                p = parts.pop()
                if len(p) > size:
                    p, rest = p.cut(size)
                    parts.append(rest)
                some.append(p)
                size -= len(p)
            self.give(some)

    def given(self) -> pa.RecordBatch:
        out, self.out = self.out, []
        columns = zip(*out, strict=True) if out else [[]] * len(_NAMES)
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], _NAMES)


def packed(docs: DataFrame, path: str) -> DataFrame:
    """A row for each piece: where it starts in its document, and where it lies in which sequence."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, end, bins, now = ids_of(path), _packed([END]), None, None
        for batch in batches:
            if batch.num_rows and batch.column(2)[0].as_py() != now:  # one task may run several coalesced partitions
                if bins:
                    bins.finish()
                    yield bins.given()
                now = batch.column(2)[0].as_py()
                bins = Bins(now << 32)
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                texts = [x or "" for x in part.column("text").to_pylist()]
                for doc, blob in zip(part.column("doc_id").to_pylist(), ids.many(texts), strict=True):
                    bins.add(doc, blob + end)
                yield bins.given()
        if bins:
            bins.finish()
            yield bins.given()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.spark_partition_id().cast("long").alias("worker"))
    return rows.mapInArrow(run, _PIECE)


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"), tokenizer_path())
