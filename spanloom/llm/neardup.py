"""N-gram Jaccard join by grouped prefixes (op3).

A document is its set of distinct five-word shingles; two documents link when
100 * |intersection| >= 75 * |union|.

1. A census counts in how many documents each shingle occurs.  Shingles are
   ordered by (count, hash), rarest first; two linked documents share one of
   their first n - ceil(0.75 n) + 1 shingles.  A shingle of one document
   links nothing, so a document whose prefix holds only such is settled and
   takes part in no later step.
2. Documents with identical sets are one class; classes with identical
   prefixes and size are one group.
3. Each prefix shingle has its list of groups.  Lists are range-sorted by
   (shingle, size, group), so a frequent shingle spreads over partitions, and
   read in that order.  A list of up to ``FEW`` classes gives its group pairs,
   filtered by size and by the place of the shingle in both prefixes.  A longer
   list gives no pairs: each run of sizes that can link hangs on its first group.
4. Pairs of short lists are made distinct, expanded to classes and verified one
   by one.  Groups that hang together are a cluster, dealt into blocks by set
   size and hash; a task takes two blocks whose sizes can link, filters pairs of
   groups by size and shared prefix shingles, expands these to classes and
   counts overlaps by matrix products.  A pair of one cluster is left to its blocks.
5. Components of the links give each class, and so each document, the smallest
   doc_id it can reach.

Classes with over a 4096th of the documents, so 4096 of them at most, are
broadcast back to their documents; the others meet them in a shuffle, where no
key has more rows than that.

Edge cases: a null or blank text has no shingle and links with nothing, not
even its equals; one of one to four words has its whole sequence as the only
shingle; repeated rows and texts link as identical sets; a row without doc_id
takes part like any, and has a null component if no row it reaches has one;
rows of one doc_id with different texts are documents of their own; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkit as tk
from .base import chunk_of, components, fewer, free, release, spread, table, text_bytes, written
from .census import Deal, answered, concatenated

SHINGLE = 5
#: Link where 100 * overlap >= PERCENT * union.
PERCENT = 75
#: Most classes of one block; a task holds two.
BLOCK = 256
#: Most classes of a list that gives its pairs.
FEW = 4
#: Rows of an open list that a task keeps.
_KEPT = 4096

_CAND = pa.schema(
    [
        ("doc_id", pa.int64()), ("digest", pa.int64()), ("n", pa.int64()), ("s1", pa.int64()), ("s2", pa.int64()), ("gsig", pa.int64()),
        ("prefix", pa.list_(pa.int64())), ("tokens", pa.list_(pa.int64())),
    ]
)


def _prefix(n, percent: int):
    """How many of the rarest of ``n`` shingles two linked documents share one of."""
    return n - -(-percent * n // 100) + 1


def shingle_sets(column: pa.Array, k: int = SHINGLE) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Sorted distinct shingle hashes of each text, and the routing hash of each."""
    sets, routes = [], []
    for _, _, buf, off in tk.text_slices(column):
        w = tk.Words(tk.LOWER[buf], off)
        h = w.hashes()
        key, route = tk.windows(h, k), tk.windows(h, k, 1)
        for i, n in enumerate(w.count):
            a = w.woff[i]
            if n >= k:
                one, first = np.unique(key[a : a + n - k + 1], return_index=True)
                sets.append(one)
                routes.append(route[a + first])
            else:
                whole = xxhash.xxh3_128_intdigest(bytes([n]) + h[a : a + n].tobytes()) if n else 0
                sets.append(np.array([whole & (1 << 64) - 1] if n else [], np.uint64))
                routes.append(np.array([whole >> 64] if n else [], np.uint64))
    return sets, routes


def candidates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, text hash and n of every document; set and prefix signatures, prefix and shared shingles of those that may link."""
    spark = docs.sparkSession
    size = text_bytes(docs)
    deal = Deal.of(size, size / 6, int(spark.conf.get("spark.sql.shuffle.partitions")))
    digest = F.xxhash64("text").alias("digest")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", digest, chunk_of(deal.chunks, "doc_id", "text"))

    def hashes(t: pa.Table):
        sets, routes = shingle_sets(t.column("text"))
        return concatenated(sets), concatenated(routes), [x.size for x in sets]

    def finish(t: pa.Table, key: np.ndarray, count: np.ndarray, sizes: list[int]) -> pa.Table:
        out, at = [], 0
        for doc, digest, n in zip(t.column("doc_id").to_pylist(), t.column("digest").to_pylist(), sizes, strict=True):
            mine, df = key[at : at + n], count[at : at + n]
            at += n
            prefix = _prefix(n, percent)
            shared = df > 1
            alone = n - int(shared.sum())
            if not n or alone >= prefix:
                out.append((doc, digest, n, None, None, None, None, None))
                continue
            tokens = mine[shared]
            head = tokens[np.lexsort((tokens, df[shared]))[: prefix - alone]]
            sig = xxhash.xxh3_128_digest(mine.tobytes())
            s1, s2 = np.frombuffer(sig, np.int64)
            group = np.array([xxhash.xxh3_64_intdigest(head.tobytes() + n.to_bytes(8, "little"))], np.uint64).view(np.int64)[0]
            out.append((doc, digest, n, int(s1), int(s2), int(group), head.view(np.int64), tokens.view(np.int64)))
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _CAND, strict=True)], schema=_CAND)

    schema = "doc_id long, digest long, n long, s1 long, s2 long, gsig long, prefix array<long>, tokens array<long>"
    return written(answered(rows, deal, hashes, finish, schema), "candidates")


_LIST = ["token", "n", "gsig", "place", "classes", "long"]
_FOUND = pa.schema([("u", pa.int64()), ("v", pa.int64()), *[(c, pa.int64()) for c in _LIST]])


def _lists(percent: int, few: int):
    """Kernels over sorted lists: one for a partition's rows, one for the lists that partitions have in common.

    Rows of the result are pairs (u, v, long 0), edges of a cluster (u, v,
    long 1) or, without u, rows of a list that may go on elsewhere.
    """

    def rows(**columns: np.ndarray) -> pa.RecordBatch:
        size = next(iter(columns.values())).size
        return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(size, f.type) for f in _FOUND], schema=_FOUND)

    def read(batch: pa.RecordBatch | pa.Table) -> np.ndarray:
        return np.stack([np.asarray(batch.column(c)) for c in _LIST]) if batch.num_rows else np.zeros((len(_LIST), 0), np.int64)

    def whole(x: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Pairs and edges of complete lists."""
        if not x.shape[1]:
            return
        token, n, group, place, classes, long = x
        start = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
        size = np.diff(np.append(start, token.size))
        many = np.repeat((np.add.reduceat(classes, start) > few) | (np.maximum.reduceat(long, start) > 0), size)
        at = np.arange(token.size)
        fresh = np.zeros(token.size, bool)
        fresh[start] = True
        fresh[1:] |= 100 * n[:-1] < percent * n[1:]
        head = np.maximum.accumulate(np.where(fresh, at, 0))
        hung = np.flatnonzero(many & (head != at))
        yield rows(u=group[hung], v=group[head[hung]], long=np.ones(hung.size, np.int64))
        for gap in range(1, few):
            a, b = at[:-gap], at[gap:]
            if not a.size:
                break
            most = np.minimum(n[a] - place[a], n[b] - place[b])  # this shingle and all that come after it
            need = -(-percent * (n[a] + n[b]) // (100 + percent))
            ok = (token[a] == token[b]) & ~many[a] & (100 * n[a] >= percent * n[b]) & (most >= need)
            yield rows(u=group[a[ok]], v=group[b[ok]], long=np.zeros(int(ok.sum()), np.int64))

    def ends(x: np.ndarray) -> Iterator[pa.RecordBatch]:
        """A list at a partition's edge: its rows, or its edges and its two ends if it is long already."""
        if x[4].sum() > few or x[5].max(initial=0):
            yield from whole(_long(x))
            x = _long(x[:, [0, -1]] if x.shape[1] > 1 else x)
        yield rows(**dict(zip(_LIST, x, strict=True)))

    def _long(x: np.ndarray) -> np.ndarray:
        x = x.copy()
        x[5] = 1
        return x

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, x = True, np.zeros((len(_LIST), 0), np.int64)
        for batch in batches:
            x = np.concatenate([x, read(batch)], 1)
            if not x.shape[1]:
                continue
            last = int(np.searchsorted(x[0], x[0, -1]))
            done, x = x[:, :last], x[:, last:]
            if first and last:
                cut = int(np.searchsorted(done[0], done[0, 0], "right"))
                yield from ends(done[:, :cut])
                done, first = done[:, cut:], False
            yield from whole(done)
            if x.shape[1] > _KEPT:
                yield from whole(_long(x))
                x = _long(x[:, [0, -1]])
        if x.shape[1]:
            yield from ends(x)

    def shared(t: pa.Table) -> pa.Table:
        x = read(t.select(_LIST))
        return pa.Table.from_batches(whole(x[:, np.lexsort((x[2], x[1]))]), schema=_FOUND)

    return part, shared


def _paired(groups: DataFrame, percent: int, few: int) -> tuple[DataFrame, DataFrame]:
    """Pairs of groups from short lists, and edges between groups of long ones."""
    part, shared = _lists(percent, few)
    schema = "u long, v long, " + ", ".join(f"{c} long" for c in _LIST)
    alone = F.expr(f"n - (({percent} * n + 99) div 100) + 1") - F.size("prefix")
    lists = groups.select("n", "gsig", "classes", alone.alias("alone"), F.posexplode("prefix").alias("i", "token"))
    lists = lists.select("token", "n", "gsig", (F.col("alone") + F.col("i")).cast("long").alias("place"), "classes", F.lit(0).cast("long").alias("long"))
    lists = lists.repartitionByRange("token", "n", "gsig").sortWithinPartitions("token", "n", "gsig")
    found = written(lists.mapInArrow(part, schema), "lists")
    rest = written(found.where("u is null").groupBy("token").applyInArrow(shared, schema), "lists")
    both = found.where("u is not null").unionByName(rest).select("u", "v", "long")
    return both.where("long = 0").select("u", "v").distinct(), both.where("long = 1").select("u", "v").distinct()


def verified(percent: int):
    """Links among the classes of one task: a spanning forest (u, v) and the links of each class (u, links)."""
    kind = pa.schema([("u", pa.int64()), ("v", pa.int64()), ("links", pa.int64())])

    def run(t: pa.Table) -> pa.Table:
        name, n, group = t.column("name").to_numpy(), t.column("n").to_numpy(), t.column("gsig").to_numpy()
        weight, side = t.column("members").to_numpy(), t.column("side").to_numpy()
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        if all(t.column(a)[0] == t.column(b)[0] for a, b in (("lo", "hi"), ("i", "j"))):  # a block with itself
            right = left
        if not left.size or not right.size:
            return kind.empty_table()
        # pairs of groups first, by size and shared prefix shingles
        _, one, mine = np.unique(group, return_index=True, return_inverse=True)
        gl, gr = np.unique(mine[left]), np.unique(mine[right])
        prefixes = _arrays(t.column("prefix").take(pa.array(one)))
        small = np.minimum(n[one][gl][:, None], n[one][gr][None, :])
        large = np.maximum(n[one][gl][:, None], n[one][gr][None, :])
        may = (100 * small >= percent * large) & (_overlaps(prefixes, gl, gr) > 0)
        may = may[np.searchsorted(gl, mine[left])][:, np.searchsorted(gr, mine[right])]
        keep_l, keep_r = may.any(1), may.any(0)
        left, right, may = left[keep_l], right[keep_r], may[keep_l][:, keep_r]
        if not left.size:
            return kind.empty_table()
        overlap = _overlaps(_arrays(t.column("tokens")), left, right)
        good = may & ((100 + percent) * overlap >= percent * (n[left][:, None] + n[right][None, :]))
        good &= left[:, None] != right[None, :]
        links = {}
        for i, j in ((left, good @ weight[right]), (right, good.T @ weight[left])):
            links.update(zip(i.tolist(), j.tolist(), strict=True))
        parent = list(range(len(name)))

        def root(x: int) -> int:
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        u, v = [], []
        for i, j in zip(*np.nonzero(good), strict=True):
            a, b = root(int(left[i])), root(int(right[j]))
            if a != b:
                parent[max(a, b)] = min(a, b)
                u.append(name[left[i]])
                v.append(name[right[j]])
        some = [(name[i], k) for i, k in links.items() if k]
        return pa.table(
            {
                "u": pa.array([*u, *[a for a, _ in some]], pa.int64()),
                "v": pa.array([*v, *[None] * len(some)], pa.int64()),
                "links": pa.array([*[None] * len(u), *[int(k) for _, k in some]], pa.int64()),
            }
        )

    return run


def _arrays(column: pa.ChunkedArray | pa.Array) -> list[np.ndarray]:
    chunks = column.chunks if isinstance(column, pa.ChunkedArray) else [column]
    return [x.values.to_numpy() for c in chunks for x in c]


def _overlaps(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, width: int = 4096) -> np.ndarray:
    """|a & b| for each of ``left`` and ``right``: products of 0/1 matrices over ``width`` shingles at a time."""
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [x.size for x in sets])
    _, ids, times = np.unique(flat, return_inverse=True, return_counts=True)
    keep = times[ids] > 1
    order = np.argsort(ids[keep], kind="stable")
    ids, owner = ids[keep][order], owner[keep][order]
    ids = np.cumsum(np.diff(ids, prepend=ids[:1]) != 0) if ids.size else ids
    out = np.zeros((left.size, right.size), np.float32)
    for lo in range(0, int(ids[-1]) + 1 if ids.size else 0, width):
        a, b = np.searchsorted(ids, [lo, lo + width])
        part = np.zeros((len(sets), width), np.float32)
        part[owner[a:b], ids[a:b] - lo] = 1
        out += part[left] @ part[right].T
    return np.rint(out).astype(np.int64)


def _blocked(classes: DataFrame, clusters: DataFrame, percent: int) -> DataFrame:
    """Deal each class of a cluster to the block pairs it takes part in, and verify these."""
    step_size = 1.001 * 100 / percent  # sizes that can link are in the same step or the next
    sized = classes.join(clusters, "gsig").withColumn("step", F.floor(F.log("n") / F.log(F.lit(step_size))).cast("int"))
    count = sized.groupBy("cluster", "step").agg(F.count("*").alias("c"))
    total = count.groupBy("cluster").agg(F.sum("c").alias("t"), F.map_from_entries(F.collect_list(F.struct("step", "c"))).alias("by"))
    rows = sized.join(written(total.where("t > 1"), "clusters"), "cluster")
    blocks = lambda step: F.coalesce(F.ceil(F.try_element_at("by", step) / BLOCK).cast("int"), F.lit(0))
    mine = F.pmod(F.hash("name"), blocks(F.col("step")))
    task = lambda lo, hi, i, j, side: F.struct(lo.alias("lo"), hi.alias("hi"), i.cast("int").alias("i"), j.cast("int").alias("j"), F.lit(side).alias("side"))
    upto = lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    step, nb = F.col("step"), blocks(F.col("step"))
    dealt = F.concat(
        F.transform(upto(nb), lambda j: F.when(j < mine, task(step, step, j, mine, 1)).otherwise(task(step, step, mine, j, 0))),
        F.transform(upto(blocks(step + 1)), lambda j: task(step, step + 1, mine, j, 0)),
        F.transform(upto(blocks(step - 1)), lambda j: task(step - 1, step, j, mine, 1)),
    )
    whole = F.array(task(F.lit(0), F.lit(0), F.lit(0), F.lit(0), 0))
    dealt = F.when(F.col("t") <= BLOCK, whole).otherwise(dealt)
    sent = rows.withColumn("to", F.explode(dealt))
    sent = sent.select("cluster", "to.lo", "to.hi", "to.i", "to.j", "to.side", "name", "gsig", "n", "members", "prefix", "tokens")
    return sent.groupBy("cluster", "lo", "hi", "i", "j").applyInArrow(verified(percent), "u long, v long, links long")


def _one_by_one(classes: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """Links among the classes of group pairs, as (u, v) and as the links of each class."""
    some = classes.select("gsig", "name", "n", "members")
    a = some.select(F.col("gsig").alias("u"), F.col("name").alias("a"), F.col("n").alias("na"), F.col("members").alias("ma"))
    b = some.select(F.col("gsig").alias("v"), F.col("name").alias("b"), F.col("n").alias("nb"), F.col("members").alias("mb"))
    both = pairs.join(a, "u").join(b, "v").where("u <> v or a < b").drop("u", "v")
    both = both.join(classes.select(F.col("name").alias("a"), F.col("tokens").alias("ta")), "a")
    both = both.join(classes.select(F.col("name").alias("b"), F.col("tokens").alias("tb")), "b")
    overlap = F.size(F.array_intersect("ta", "tb")).cast("long")
    good = both.where((100 + percent) * overlap >= percent * (F.col("na") + F.col("nb")))
    none = F.lit(None).cast("long")
    out = F.array(
        F.struct(F.col("a").alias("u"), F.col("b").alias("v"), none.alias("links")),
        F.struct(F.col("a").alias("u"), none.alias("v"), F.col("mb").alias("links")),
        F.struct(F.col("b").alias("u"), none.alias("v"), F.col("ma").alias("links")),
    )
    return good.select(F.inline(out))


def _classes(docs: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Candidates, and of each class its signature, members, component (a class name), smallest doc_id there, and links."""
    cand = candidates(docs, percent)
    some = cand.where("s1 is not null").groupBy("s1", "s2").agg(
        F.min("doc_id").alias("rep"), F.count("*").alias("members"), *[F.first(c).alias(c) for c in ("n", "gsig", "prefix", "tokens")]
    )
    classes = written(some.withColumn("name", F.col("s1")), "classes")
    groups = written(
        classes.groupBy("gsig").agg(F.first("prefix").alias("prefix"), F.first("n").alias("n"), F.count("*").alias("classes")), "groups"
    )
    pairs, edges = _paired(groups, percent, FEW)
    hung = written(components(edges).select(F.col("node").alias("gsig"), F.col("component").alias("cluster")), "hung")
    large = groups.where(F.col("classes") > FEW).select("gsig", F.col("gsig").alias("cluster")).join(hung.select("gsig"), "gsig", "left_anti")
    clusters = written(hung.unionByName(large), "clusters")
    within = groups.where((F.col("classes") > 1) & (F.col("classes") <= FEW)).join(clusters.select("gsig"), "gsig", "left_anti")
    mine = pairs.join(clusters.toDF("u", "cu"), "u", "left").join(clusters.toDF("v", "cv"), "v", "left").where("cu is null or cv is null or cu <> cv")
    todo = written(mine.select("u", "v").unionByName(within.select(F.col("gsig").alias("u"), F.col("gsig").alias("v"))), "pairs")
    links = written(_blocked(classes, clusters, percent).unionByName(_one_by_one(classes, todo, percent)), "links")
    roots = components(links.where("v is not null").select("u", "v"))
    degree = links.where("v is null").groupBy("u").agg(F.sum("links").alias("links"))
    tagged = written(
        classes.select("s1", "s2", "name", "members", "rep")
        .join(roots.withColumnRenamed("node", "name"), "name", "left")
        .join(degree.withColumnRenamed("u", "name"), "name", "left")
        .select("s1", "s2", "members", "rep", F.coalesce("component", "name").alias("component"), (F.col("members") - 1 + F.coalesce("links", F.lit(0))).alias("links")),
        "tagged",
    )
    least = written(tagged.groupBy("component").agg(F.min("rep").alias("least"), F.count("*").alias("classes")), "least")
    named = written(spread(tagged.drop("rep"), least, ["component"], "classes"), "named")
    release(classes, groups, tagged)
    return cand, named


def _told(cand: DataFrame, named: DataFrame, *columns: str) -> DataFrame:
    """``columns`` of the candidates of a class, with its component, smallest doc_id and links."""
    return spread(cand.where("s1 is not null").select("s1", "s2", *columns), named, ["s1", "s2"], "members")


def joined(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id and n_links (documents it links with) of every document."""
    cand, named = _classes(docs, percent)
    told = _told(cand, named, "doc_id", "n").select("doc_id", F.col("n").alias("n_shingles"), F.col("least").alias("component_id"), F.col("links").alias("n_links"))
    alone = cand.where("s1 is null").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(0).cast("long").alias("n_links"))
    return fewer(told.unionByName(alone))


def one_of_each(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The documents, all their columns, without those that another of their component stands for.

    Of each component the row of the smallest (doc_id, text hash) stays, one
    without doc_id last.  A row is known by its doc_id and text: rows that
    repeat a doc_id with another text are documents of their own, and rows that
    repeat both stay once, the one with the smallest hash of all columns, unless
    they have no shingle.
    """
    cand, named = _classes(docs, percent)
    who = F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "digest")
    rows = _told(cand, named, "doc_id", "digest").select("component", who.alias("who"))
    best = written(rows.groupBy("component").agg(F.min("who").alias("best")), "best").select("best.doc_id", "best.digest")
    counted = written(rows.groupBy("who").agg(F.count("*").alias("rows")).select("who.doc_id", "who.digest", "rows"), "rows")
    key, digest, rows_ = free(docs, "_key"), free(docs, "_digest"), free(docs, "_rows")
    alike: Column = F.col("doc_id").cast("long").eqNullSafe(F.col(key)) & (F.xxhash64("text") == F.col(digest))
    kept = best.select(F.col("doc_id").alias("d"), F.col("digest").alias("g"))
    counted = counted.join(kept, counted.doc_id.eqNullSafe(kept.d) & (counted.digest == kept.g), "left")
    told = written(counted.select(F.col("doc_id").alias(key), F.col("digest").alias(digest), F.when(F.col("g").isNotNull(), F.col("rows")).otherwise(0).alias(rows_)), "told")
    out = docs.join(told.where(F.col(rows_) != 1), alike, "left_anti")
    again = told.where(F.col(rows_) > 1)
    if not again.isEmpty():
        first = F.min(F.struct(F.xxhash64(*docs.columns).alias("hash"), F.struct(*docs.columns).alias("row")))
        once = docs.join(again, alike).groupBy(key, digest).agg(first.alias("first"))
        out = out.unionByName(once.select("first.row.*"))
    return fewer(out)


def op3_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joined(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "n_links")


#: All pairs that share a shingle, and their transitive closure.
SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS MATERIALIZED (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)),
r AS (SELECT a AS x, b AS y FROM l UNION SELECT r.x, l.b FROM r JOIN l ON r.y = l.a),
c AS (SELECT x, min(y) AS y FROM r GROUP BY x),
q AS (SELECT a, count(*) AS links FROM l GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(c.y, d.doc_id)) AS component_id, coalesce(q.links, 0)::BIGINT AS n_links
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN c ON c.x = d.doc_id LEFT JOIN q ON q.a = d.doc_id
"""
