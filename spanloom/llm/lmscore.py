"""Masked pseudo-likelihood of documents (op9).

Every word is predicted from both sides and never sees itself, by a mixture:

    p(word | sides) = a * p(word | left word) + b * p(word | right word)
                      + (1 - a - b) * p(class | sides) * p(word | class)

The class (a hash of the lower-cased word, ``CLASSES`` of them) comes from a
small network: an embedding for each of the two words on either side, a tanh
layer, a softmax.  All else comes from the corpus without the document itself:
the word within its class by its count against all words of the class, with
``OPEN`` counts set aside for words that no other document holds, shared out by
a spelling model (byte frequencies); the word beside its neighbour by their
count against the neighbour's; and the weights, half of n / (n + ``TRUST``) for
a neighbour that other documents hold n times.  So the vocabulary is that of the
corpus and open, a document never counts as evidence for itself, and what scoring
gathers grows with the corpus: it is a census of all words and pairs of words.

Training covers every document.  Class counts over the corpus set the output
biases.  In each of ``ROUNDS`` rounds the next part of the documents is dealt to
replicas of ``REPLICA_BYTES`` of text; each starts from the common weights and
makes one pass of gradient steps in numpy.  A task adds its replicas up, weighted
by words, as integers, one row a parameter; the sums over tasks are partial
aggregates.  Integers make the mean the same in any order, and no task sees the
replicas of another.  The driver holds one network.

A document's score is the sum over its words.

Edge cases: null and empty texts have no word and score 0; a single word is
predicted from four text ends; repeated rows are documents like any, so they
score alike, and better than a text that stands alone; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkit as tk
from .base import chunk_of, table, text_bytes
from .census import Deal, answered, concatenated

CLASSES, WIDTH, SIDES = 128, 16, 2
PLACES = 2 * SIDES
ROUNDS, REPLICA_BYTES = 3, 4 << 20
BATCH, RATE, SCORE_BATCH = 2048, 0.8, 1024
#: Counts set aside in each class for words that no other document holds.
OPEN = 50.0
#: A neighbour that other documents hold so often has half of the weight it can have.
TRUST = 1.0
#: Replicas are added up in units of so many words and so small a part of a weight.
WORDS_UNIT, WEIGHT_UNIT = 1024, 2.0**-20

#: Embeddings (the last class is beyond the text), hidden bias, output weights, output bias.
_SHAPES = [(PLACES, CLASSES + 1, WIDTH), (WIDTH,), (WIDTH, CLASSES), (CLASSES,)]
_SIZES = [int(np.prod(s)) for s in _SHAPES]


def tokens(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, tk.Words]:
    """Hash and class of each word, and the words."""
    words = tk.Words(tk.LOWER[buf], off)
    h = words.hashes()
    return h, (h % np.uint64(CLASSES)).astype(np.int64), words


def contexts(cls: np.ndarray, woff: np.ndarray) -> np.ndarray:
    """Classes around each token; places beyond its document get the class of text ends."""
    n, doc = cls.size, np.repeat(np.arange(len(woff) - 1), np.diff(woff))
    out = np.full((n, PLACES), CLASSES, np.int64)
    for i, gap in enumerate([*range(-SIDES, 0), *range(1, SIDES + 1)]):
        at = np.arange(n) + gap
        ok = (at >= woff[doc]) & (at < woff[doc + 1])
        out[ok, i] = cls[at[ok]]
    return out


class Network:
    def __init__(self, flat: np.ndarray):
        parts = np.split(flat.astype(np.float32), np.cumsum(_SIZES)[:-1])
        self.embed, self.bias, self.out, self.prior = (p.reshape(s).copy() for p, s in zip(parts, _SHAPES, strict=True))

    @classmethod
    def fresh(cls, counts: np.ndarray, seed: int = 7) -> Network:
        rng = np.random.default_rng(seed)
        flat = np.concatenate([rng.normal(0, 0.3, s) for s in _SIZES])
        net = cls(flat)
        net.bias[:] = 0
        net.prior[:] = np.log((counts + 1) / (counts.sum() + CLASSES))
        return net

    def flat(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in (self.embed, self.bias, self.out, self.prior)])

    def _forward(self, ctx: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        hidden = self.bias + self.embed[0][ctx[:, 0]]
        for i in range(1, PLACES):
            hidden += self.embed[i][ctx[:, i]]
        np.tanh(hidden, out=hidden)
        logits = hidden @ self.out
        logits += self.prior
        if (np.abs(self.out).sum(0) + np.abs(self.prior)).max() > 60:  # what tanh lets a logit reach; below, exp can't overflow
            logits -= logits.max(1, keepdims=True)
        return hidden, logits

    def log_probability(self, ctx: np.ndarray, cls: np.ndarray) -> np.ndarray:
        out = np.empty(cls.size, np.float64)
        for lo in range(0, cls.size, SCORE_BATCH):
            part, want = ctx[lo : lo + SCORE_BATCH], cls[lo : lo + SCORE_BATCH]
            _, logits = self._forward(part)
            chosen = logits[np.arange(want.size), want]
            np.exp(logits, out=logits)
            out[lo : lo + SCORE_BATCH] = chosen - np.log(logits.sum(1))
        return out

    def learn(self, ctx: np.ndarray, cls: np.ndarray, rate: float = RATE) -> None:
        """One pass of gradient steps."""
        for lo in range(0, cls.size, BATCH):
            part, want = ctx[lo : lo + BATCH], cls[lo : lo + BATCH]
            n = want.size
            hidden, grad = self._forward(part)
            np.exp(grad, out=grad)
            grad *= np.float32(rate / n) / grad.sum(1, keepdims=True)
            grad[np.arange(n), want] -= np.float32(rate / n)
            back = grad @ self.out.T
            back *= 1 - hidden * hidden
            self.out -= hidden.T @ grad
            self.prior -= grad.sum(0)
            self.bias -= back.sum(0)
            for i in range(PLACES):
                order = np.argsort(part[:, i].astype(np.uint8), kind="stable")
                place = part[order, i]
                first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
                self.embed[i][place[first]] -= np.add.reduceat(back[order], first, axis=0) * 8


@dataclass(frozen=True)
class Corpus:
    """Words of each class and bytes of words (256: their ends) over all documents, and the network's weights."""

    classes: np.ndarray
    bytes: np.ndarray
    weights: np.ndarray

    def spelling(self) -> np.ndarray:
        """Log probability of each byte of a word, and of its end."""
        counts = self.bytes + 1.0
        return np.log(counts / counts.sum())


def counted(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Words of each class, and bytes of words with the ends of words last, over all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, spelt = np.zeros(CLASSES, np.int64), np.zeros(257, np.int64)
        for batch in batches:
            for _, _, buf, off in tk.text_slices(batch.column("text")):
                _, cls, words = tokens(buf, off)
                total += np.bincount(cls, minlength=CLASSES)
                spelt[:256] += np.bincount(tk.LOWER[buf[tk.BLANK[buf]]], minlength=256)
                spelt[256] += words.start.size
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(CLASSES + 257)), pa.array(np.concatenate([total, spelt]))], ["i", "n"])

    rows = docs.select("text").mapInArrow(run, "i long, n long").groupBy("i").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(CLASSES + 257)
    for r in rows:
        out[r["i"]] = r["n"]
    return out[:CLASSES], out[CLASSES:]


def _round(docs: DataFrame, weights: np.ndarray, rate: float) -> np.ndarray:
    """Replicas trained from ``weights`` on ``docs``, averaged by words."""
    size = weights.size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net, seen, read = Network(weights), 0, 0
        total, units = np.zeros(size, np.int64), 0

        def add() -> None:
            nonlocal net, seen, read, total, units
            n = -(-seen // WORDS_UNIT)
            total += n * np.rint(net.flat() / WEIGHT_UNIT).astype(np.int64)
            units += n
            net, seen, read = Network(weights), 0, 0

        for batch in batches:
            for _, _, buf, off in tk.text_slices(batch.column("text")):
                _, cls, words = tokens(buf, off)
                if cls.size:
                    net.learn(contexts(cls, words.woff), cls, rate)
                seen, read = seen + cls.size, read + buf.size
                if read >= REPLICA_BYTES:
                    add()
        if seen:
            add()
        if units:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(size + 1)), pa.array(np.append(total, units))], ["i", "s"])

    sums = docs.select("text").mapInArrow(run, "i long, s long").groupBy("i").agg(F.sum("s").alias("s")).collect()
    if not sums:
        return weights
    out = np.zeros(size + 1)
    for r in sums:
        out[r["i"]] = r["s"]
    return (out[:-1] / out[-1] * WEIGHT_UNIT).astype(np.float32)


def trained(docs: DataFrame, rounds: int = ROUNDS) -> Corpus:
    """Corpus counts, and weights after each document has been learnt from once."""
    classes, spelt = counted(docs)
    weights = Network.fresh(classes).flat()
    for r in range(rounds):
        part = docs.where(F.pmod(F.xxhash64("text", F.lit(5)), F.lit(rounds)) == r)
        weights = _round(part, weights, RATE / (1 + r))
    return Corpus(classes, spelt, weights)


def _others(key: np.ndarray, doc: np.ndarray, count: np.ndarray) -> np.ndarray:
    """How often all other documents hold each key."""
    _, at, own = np.unique(tk.mix(key + doc.astype(np.uint64) * tk.LANES[1][0]), return_inverse=True, return_counts=True)
    return np.maximum(count.astype(np.float64) - own[at], 0.0)


def _pairs(h: np.ndarray, words: tk.Words) -> tuple[np.ndarray, np.ndarray]:
    """Where two words of one document start, and the hash of both."""
    at = np.flatnonzero(words.valid(2))
    return at, tk.windows(h, 2)[at]


def _mixed(corpus: Corpus, h: np.ndarray, cls: np.ndarray, words: tk.Words, count: np.ndarray, by_class: np.ndarray) -> np.ndarray:
    """Log probability of each word: ``count`` is that of the words, then of the pairs; ``by_class`` is the network's part."""
    doc, n = words.doc, h.size
    others = _others(h, doc, count[:n])
    cat = doc * CLASSES + cls
    if cat.size and cat[-1] < 1 << 22:
        own_class = np.bincount(cat)
    else:  # a slice of very many tiny texts
        _, cat, own_class = np.unique(cat, return_inverse=True, return_counts=True)
    spelling = corpus.spelling()
    spelt = np.concatenate([[0.0], np.cumsum(spelling[:256][words.buf])])
    base = np.minimum(spelt[words.end] - spelt[words.start] + spelling[256] + np.log(CLASSES), 0.0)
    rest = np.maximum(corpus.classes[cls] - own_class[cat], others)
    at, key = _pairs(h, words)
    both = _others(key, doc[at], count[n:])
    beside, weight = np.zeros(n), np.zeros(n)
    for word, side in ((at + 1, at), (at, at + 1)):  # each word by the one to its left, then by the one to its right
        known = others[side]
        share = 0.5 * known / (known + TRUST)
        beside[word] += share * np.divide(both, known, out=np.zeros(at.size), where=known > 0).clip(0, 1)
        weight[word] += share
    with np.errstate(divide="ignore"):
        alone = by_class + np.logaddexp(np.log(others), np.log(OPEN) + base) - np.log(rest + OPEN)
        return np.logaddexp(np.log(beside), np.log1p(-weight) + alone)


def _sums(x: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of each document's values, by these alone."""
    out, some = np.zeros(bounds.size - 1), np.diff(bounds) > 0
    if x.size:
        out[some] = np.add.reduceat(x, bounds[:-1][some])
    return out


def scored(docs: DataFrame, corpus: Corpus, counted_in: DataFrame | None = None) -> DataFrame:
    """doc_id, n_tokens, pll (the sum of conditional log probabilities) and class_pll, the network's part of it.

    ``docs`` are what the corpus was learnt from; or else ``counted_in`` is, and
    the words of both are counted.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.lit(True).alias("wanted"))
    if counted_in is not None:
        corpus = replace(corpus, classes=corpus.classes + counted(docs)[0])
        rows = rows.unionByName(counted_in.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.lit(False).alias("wanted")))
    size = text_bytes(rows)
    deal = Deal.of(size, size / 6, int(spark.conf.get("spark.sql.shuffle.partitions")))
    shared = spark.sparkContext.broadcast(corpus)
    rows = rows.withColumn("chunk", chunk_of(deal.chunks, "doc_id", "text"))

    def hashes(t: pa.Table):
        keys, parts = [], []
        for _, _, buf, off in tk.text_slices(t.column("text")):
            h, _, words = tokens(buf, off)
            keys += [h, _pairs(h, words)[1]]
            parts.append((buf, off, h.size + keys[-1].size))
        key = concatenated(keys)
        return key, tk.mix(key ^ tk.LANES[1][2]), parts

    def finish(t: pa.Table, key: np.ndarray, count: np.ndarray, parts: list) -> pa.Table:
        net, done, n, both, by_class = Network(shared.value.weights), 0, [], [], []
        for buf, off, size in parts:
            h, cls, words = tokens(buf, off)
            first = net.log_probability(contexts(cls, words.woff), cls)
            whole = _mixed(shared.value, h, cls, words, count[done : done + size], first)
            done += size
            for out, x in ((both, whole), (by_class, first)):
                out.append(_sums(x, words.woff))
            n.append(np.diff(words.woff).astype(np.int64))
        cols = [t.column("doc_id"), *[pa.array(concatenated(x, k)) for x, k in ((n, np.int64), (both, np.float64), (by_class, np.float64))]]
        return pa.Table.from_arrays(cols, ["doc_id", "n_tokens", "pll", "class_pll"]).filter(t.column("wanted"))

    return answered(rows, deal, hashes, finish, "doc_id long, n_tokens long, pll double, class_pll double")


def op9_lmscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return scored(docs, trained(docs)).withColumn("mean_pll", F.col("pll") / F.when(F.col("n_tokens") > 0, F.col("n_tokens")))
