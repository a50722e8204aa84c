"""Catalogues, duplicates, splits, leakage, privacy, manifests."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalars as sc
from ..operators import corpus, joins, ranking
from .base import EV, HOUR, events, load, query, r, uniform_sql


@query("dup_by_size_then_hash", "WITH d AS (SELECT doc_id, n_chars, text FROM documents WHERE n_chars IN (SELECT n_chars FROM documents GROUP BY 1 HAVING count(*) > 1)), h AS (SELECT doc_id, sha256(text) AS digest FROM d) SELECT doc_id, digest, count(*) OVER (PARTITION BY digest) AS copies FROM h")
def dup_by_size_then_hash(spark, sf):
    return corpus.duplicates(load(spark, sf, "documents").select("doc_id", "n_chars", "text"), "n_chars", F.col("text")).select("doc_id", "digest", "copies")


@query("stable_ids", "SELECT s_suppkey, printf('recording_%04d', row_number() OVER (ORDER BY s_name, s_suppkey)) AS stable_id FROM supplier")
def stable_ids(spark, sf):
    return ranking.stable_ids(load(spark, sf, "supplier"), [F.col("s_name"), F.col("s_suppkey")]).select("s_suppkey", "stable_id")


_SPLIT = "s AS (SELECT o_orderkey, o_custkey, o_orderpriority, CASE WHEN o_orderkey % 10 = 0 THEN 'TEST' WHEN o_orderkey % 10 = 1 THEN 'DEV' ELSE 'TRAIN' END AS split FROM orders)"


def _split(spark, sf):
    k = F.col("o_orderkey") % 10
    return load(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", F.when(k == 0, "TEST").when(k == 1, "DEV").otherwise("TRAIN").alias("split"))


@query("group_disjoint_holdout", f"WITH {_SPLIT} SELECT o_orderkey, split, CASE WHEN split = 'TEST' AND o_custkey IN (SELECT o_custkey FROM s WHERE split = 'TRAIN') THEN 'group_in_train' ELSE '' END AS note FROM s")
def group_disjoint_holdout(spark, sf):
    return corpus.holdout(_split(spark, sf), "o_custkey", "split").select("o_orderkey", "split", "note")


@query("leakage_audit", f"WITH {_SPLIT}, b AS (SELECT DISTINCT o_custkey, split FROM s), q AS (SELECT o_orderkey, o_custkey, CASE WHEN o_orderpriority = '5-LOW' THEN 'DEV' ELSE 'TRAIN' END AS split FROM orders) SELECT o_orderkey, o_custkey, split FROM q ANTI JOIN b USING (o_custkey, split)")
def leakage_audit(spark, sf):
    recipes = load(spark, sf, "orders").select("o_orderkey", "o_custkey", F.when(F.col("o_orderpriority") == "5-LOW", "DEV").otherwise("TRAIN").alias("split"))
    return corpus.leakage(_split(spark, sf), recipes, "o_custkey", "split").select("o_orderkey", "o_custkey", "split")


@query("disjointness_proof", f"WITH {_SPLIT} SELECT a.split AS a, b.split AS b, count(DISTINCT a.o_custkey) AS shared FROM s a JOIN s b ON a.o_custkey = b.o_custkey AND a.split < b.split GROUP BY ALL")
def disjointness_proof(spark, sf):
    g = _split(spark, sf).select("o_custkey", "split").distinct()
    return g.select("o_custkey", F.col("split").alias("a")).join(g.select("o_custkey", F.col("split").alias("b")), "o_custkey").where("a < b").groupBy("a", "b").agg(F.count("*").alias("shared"))


@query("split_override", f"WITH {_SPLIT}, v AS (SELECT c_custkey, 'SEALED' AS o FROM customer WHERE c_nationkey = 7) SELECT o_orderkey, CASE WHEN o IS NOT NULL THEN 'SEALED_EXCLUDED' ELSE split END AS split FROM s LEFT JOIN v ON c_custkey = o_custkey")
def split_override(spark, sf):
    v = load(spark, sf, "customer").where("c_nationkey = 7").select(F.col("c_custkey").alias("o_custkey"), F.lit(True).alias("o"))
    return _split(spark, sf).join(v, "o_custkey", "left").select("o_orderkey", F.when(F.col("o"), "SEALED_EXCLUDED").otherwise(F.col("split")).alias("split"))


_U = uniform_sql(20260912, "o_custkey")


@query("hash_uniform_split", f"SELECT CASE WHEN {_U} < 0.8 THEN 'train' WHEN {_U} < 0.9 THEN 'dev' ELSE 'test' END AS split, count(*) AS n FROM orders GROUP BY 1")
def hash_uniform_split(spark, sf):
    """Weighted draws from a hash of the key: the same on any cluster."""
    split = ranking.drawn({"train": 0.8, "dev": 0.1, "test": 0.1}, 20260912, "o_custkey")
    return load(spark, sf, "orders").select("o_orderkey", split.alias("split")).groupBy("split").agg(F.count("*").alias("n"))


@query("crc_seed_pick", "SELECT p_partkey, ((p_partkey * 37 + p_size) % 1000)::BIGINT AS region FROM part")
def crc_seed_pick(spark, sf):
    return load(spark, sf, "part").select("p_partkey", F.pmod(F.col("p_partkey") * 37 + F.col("p_size"), F.lit(1000)).cast("bigint").alias("region"))


_CRC = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(x, ''), lambda s: ascii(s)::BIGINT)), lambda c, b: list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda d, z: xor(d >> 1, 3988292384 * (d & 1)))), 4294967295::BIGINT)"""


@query("crc_row_seed", f"SELECT p_partkey, {_CRC} AS seed FROM (SELECT p_partkey, p_brand || ':' || p_partkey AS x FROM part)")
def crc_row_seed(spark, sf):
    """A seed for each row from the CRC32 of its key."""
    return load(spark, sf, "part").select("p_partkey", F.crc32(F.concat_ws(":", "p_brand", "p_partkey").cast("binary")).alias("seed"))


@query(
    "stratified_split",
    f"""WITH a AS (SELECT s_suppkey FROM supplier ORDER BY s_acctbal DESC, s_suppkey LIMIT 1), b AS (SELECT s_suppkey FROM supplier WHERE s_suppkey NOT IN (FROM a) ORDER BY s_acctbal, s_suppkey LIMIT 1),
c AS (SELECT s_suppkey FROM supplier WHERE s_nationkey < 5 AND s_suppkey NOT IN (FROM a UNION ALL FROM b) ORDER BY s_acctbal DESC, s_suppkey LIMIT 1),
d AS (SELECT s_suppkey FROM supplier WHERE s_suppkey NOT IN (FROM a UNION ALL FROM b UNION ALL FROM c) ORDER BY {uniform_sql(20260912, 's_suppkey')}, s_suppkey LIMIT 10)
SELECT s_suppkey, CASE WHEN s_suppkey IN (FROM a UNION ALL FROM b) THEN 'TEST' WHEN s_suppkey IN (FROM c UNION ALL FROM d) THEN 'DEV' ELSE 'TRAIN' END AS split FROM supplier""",
)
def stratified_split(spark, sf):
    """One supplier for each of three strata without replacement, a seeded fill of ten, the rest train."""
    s = load(spark, sf, "supplier")
    strata = [
        ("rich", F.lit(True), [F.desc("s_acctbal"), F.col("s_suppkey")], "TEST"),
        ("poor", F.lit(True), [F.col("s_acctbal"), F.col("s_suppkey")], "TEST"),
        ("low_nation", F.col("s_nationkey") < 5, [F.desc("s_acctbal"), F.col("s_suppkey")], "DEV"),
    ]
    return ranking.stratified_split(s, "s_suppkey", strata, ("DEV", 10), "TRAIN", 20260912).select("s_suppkey", "split")


@query("plan_grid", "SELECT a AS session, b AS stratum, c AS level, CASE WHEN c = 0 THEN 'control' ELSE 'panel' END AS panel FROM (SELECT unnest([1, 2, 3]) AS a), (SELECT unnest(['press', 'slide', 'touch', 'rest']) AS b), (SELECT unnest([0, 10]) AS c)")
def plan_grid(spark, sf):
    g = joins.grid(spark, session=[1, 2, 3], stratum=["press", "slide", "touch", "rest"], level=[0, 10])
    return g.withColumn("panel", F.when(F.col("level") == 0, "control").otherwise("panel"))


@query("freeze_manifest", "SELECT page_id, sha256(html) AS sha256, strlen(html) AS bytes FROM pages")
def freeze_manifest(spark, sf):
    m = corpus.manifest(load(spark, sf, "pages"), "page_id", F.col("html"))
    return m.select("page_id", "sha256", F.col("bytes").cast("bigint").alias("bytes"))


@query("verify_manifest", "SELECT CASE WHEN url LIKE '%?%' THEN 'hash' ELSE 'same' END AS status, count(*) AS n FROM pages GROUP BY 1")
def verify_manifest(spark, sf):
    p = load(spark, sf, "pages")
    a = corpus.manifest(p, "page_id", F.col("html"))
    b = corpus.manifest(p.withColumn("html", F.when(F.col("url").contains("?"), F.reverse("html")).otherwise(F.col("html"))), "page_id", F.col("html"))
    return joins.catalog_diff(a, b, "page_id", "bytes", "sha256").groupBy("status").agg(F.count("*").alias("n"))


@query(
    "blinded_assignment",
    f"""WITH b AS (SELECT p_brand, p_partkey, printf('item_%03d', row_number() OVER (PARTITION BY p_brand ORDER BY {uniform_sql(7, 'p_brand', 'p_partkey')}, p_partkey)) AS blind FROM part),
a AS (SELECT p_brand, sha256(string_agg(blind || '=' || p_partkey, chr(10) ORDER BY blind || '=' || p_partkey)) AS assignment FROM b GROUP BY 1) SELECT p_brand, p_partkey, blind, assignment FROM b JOIN a USING (p_brand)""",
)
def blinded_assignment(spark, sf):
    return corpus.blinded(load(spark, sf, "part").select("p_brand", "p_partkey"), "p_brand", "p_partkey", 7)


@query(
    "common_gain",
    """WITH p AS (SELECT label, vec_id, list_max(list_transform(embedding, lambda x: abs(x)))::DOUBLE AS peak, vec_id = min(vec_id) OVER (PARTITION BY label) AS raw FROM embeddings), g AS (SELECT label, least(1.0, 10 ** (-18 / 20.0) / peak) AS g FROM p WHERE raw)
SELECT label, vec_id, round(20 * log10(g), 6) AS gain_db, round(peak * g, 6) AS level, peak * g > 1 + 1e-6 AS clips FROM p JOIN g USING (label)""",
)
def common_gain(spark, sf):
    """A label's vectors as items of a group: one gain from its first, for a peak of 18 dB under full scale; the job ends if any would clip."""
    first = F.min("vec_id").over(Window.partitionBy("label"))
    rows = load(spark, sf, "embeddings").select("label", "vec_id", F.array_max(F.transform("embedding", F.abs)).cast("double").alias("peak"), (F.col("vec_id") == first).alias("raw"))
    got = corpus.levelled(rows, "label", "peak", F.col("raw"), -18.0)
    return got.select("label", "vec_id", r("gain_db").alias("gain_db"), r("level").alias("level"), "clips")


@query("gain_audit", "WITH g AS (SELECT label, avg(list_sum(embedding)) AS g FROM embeddings GROUP BY 1), a AS (SELECT label, abs(list_sum(embedding) - g) AS e FROM embeddings JOIN g USING (label)) SELECT label, round(max(e), 4) AS largest FROM a GROUP BY label")
def gain_audit(spark, sf):
    e = load(spark, sf, "embeddings").select("label", F.aggregate(F.col("embedding").cast("array<double>"), F.lit(0.0), lambda a, x: a + x).alias("s"))
    g = e.groupBy("label").agg(F.avg("s").alias("g"))
    return e.join(g, "label").groupBy("label").agg(r(F.max(F.abs(F.col("s") - F.col("g"))), 4).alias("largest"))


_W, _J = 8 * HOUR, 2 * HOUR


@query(
    "window_bank",
    f"""{EV}, r AS (SELECT DISTINCT user_id, event_type, t - 1704067200000000 AS t FROM ev), z AS (SELECT user_id, greatest(max(t) - {_W}, 0) AS z FROM r GROUP BY 1),
k AS (SELECT user_id, z, event_type AS kind, row_number() OVER (PARTITION BY user_id, event_type ORDER BY t) AS n, t - {_W // 2} AS w0 FROM r JOIN z USING (user_id) QUALIFY n <= 2),
s AS (SELECT * FROM k WHERE w0 BETWEEN 0 AND z), m AS (SELECT user_id, z, 12 - coalesce(c, 0) AS m FROM z LEFT JOIN (SELECT user_id, count(*) AS c FROM s GROUP BY 1) USING (user_id)),
g AS (SELECT user_id, z, '~' AS kind, n, z * n // (m + 1) + floor(({uniform_sql(3, 'user_id', 'n')} - 0.5) * 2 * {_J})::BIGINT AS w0 FROM (SELECT *, unnest(range(1, m + 1)) AS n FROM m WHERE m > 0)),
c AS (SELECT user_id, kind, n, least(greatest(w0, 0), z) AS w0 FROM (FROM s UNION ALL FROM g)), d AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY user_id, w0 // {_W // 2} ORDER BY kind, n) = 1)
SELECT user_id, w0::BIGINT AS w0 FROM d QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY kind, n) <= 12""",
)
def window_bank(spark, sf):
    rel = events(spark, sf).select("user_id", "event_type", (F.col("t") - 1_704_067_200_000_000).alias("t"))
    return corpus.windows_bank(rel, "user_id", "t", "event_type", _W, 12, 2, _J, 3)


@query(
    "region_pick",
    f"""{EV}, s AS (SELECT user_id, min(t) AS s FROM ev WHERE event_type = 'click' AND value * {HOUR} >= {60 * HOUR} GROUP BY 1), l AS (SELECT user_id, sum(value * {HOUR})::BIGINT AS n FROM ev GROUP BY 1)
SELECT user_id, coalesce(s, CASE WHEN n > {60 * HOUR} THEN user_id * 37 % (n - {60 * HOUR}) ELSE 0 END) AS start_, CASE WHEN s IS NOT NULL OR n > {60 * HOUR} THEN coalesce(s, user_id * 37 % greatest(n - {60 * HOUR}, 1)) + {60 * HOUR} ELSE n END AS end_, CASE WHEN s IS NULL THEN 'unverified' ELSE 'declared' END AS origin FROM l LEFT JOIN s USING (user_id)""",
)
def region_pick(spark, sf):
    """The first click span of sixty hours, else a place by the user's number, else the whole."""
    e = events(spark, sf)
    spans = e.where("event_type = 'click'").select("user_id", F.col("t").alias("s"), (F.col("t") + F.col("value") * HOUR).alias("e"))
    whole = e.groupBy("user_id").agg(F.round(F.sum(F.col("value") * HOUR)).cast("bigint").alias("n"))
    out = corpus.region(whole, spans, "user_id", "n", 60 * HOUR, "user_id")
    return out.select("user_id", F.col("start").alias("start_"), F.col("end").alias("end_"), "origin")


@query(
    "refusal_list",
    """SELECT coalesce(refusal, 'allowed') AS refusal, count(*) AS n FROM (SELECT CASE WHEN starts_with(path, 'docs/') THEN 'folder docs' WHEN starts_with(path, 'blog/') THEN 'folder blog' WHEN contains(lower(regexp_extract(path, '[^/]*$')), '7') THEN 'name 7' WHEN contains(lower(regexp_extract(path, '[^/]*$')), 'index') THEN 'name INDEX' END AS refusal
FROM (SELECT regexp_replace(url, '^[a-z]+://[^/]*/?', '') AS path FROM pages)) GROUP BY 1""",
)
def refusal_list(spark, sf):
    pages = load(spark, sf, "pages").withColumn("path", F.regexp_replace("url", "^[a-z]+://[^/]*/?", ""))
    out = corpus.refused(pages, F.col("path"), ["docs", "blog"], ["7", "INDEX"])
    return out.groupBy(F.coalesce("refusal", F.lit("allowed")).alias("refusal")).agg(F.count("*").alias("n"))


@query(
    "document_links",
    """WITH l AS (SELECT user_id, event_id, 'file_' || (event_id % 97) || '.md' AS target FROM events UNION ALL SELECT user_id, event_id, 'extra_' || (event_id % 5) || '.md' FROM events WHERE event_id % 4 = 0)
SELECT user_id, event_id, target FROM l WHERE target NOT IN (SELECT 'file_' || p_partkey || '.md' FROM part WHERE p_partkey % 3 <> 0)""",
)
def document_links(spark, sf):
    """Links of note lines to files that are not there."""
    e = F.col("event_id").cast("string")
    first = F.concat(F.lit("see [a]("), F.lit("file_"), (F.col("event_id") % 97).cast("string"), F.lit(".md) or https://x.y/z"))
    more = F.when(F.col("event_id") % 4 == 0, F.concat(F.lit(" and [b "), e, F.lit("](extra_"), (F.col("event_id") % 5).cast("string"), F.lit(".md)"))).otherwise("")
    lines = load(spark, sf, "events").select("user_id", "event_id", F.concat(first, more).alias("line"))
    names = load(spark, sf, "part").where("p_partkey % 3 <> 0").select(F.concat(F.lit("file_"), F.col("p_partkey").cast("string"), F.lit(".md")).alias("name"))
    return corpus.broken_links(lines, names, "user_id", "event_id", "line", "name")


@query(
    "page_links",
    """WITH l AS (SELECT page_id, length(html) AS size, unnest(regexp_extract_all(html, 'href="/([^"#?]+)', 1)) AS target FROM pages), k AS (SELECT DISTINCT regexp_extract(html, '<title>([^ <]+)', 1) AS name FROM pages)
SELECT page_id, size, target FROM l WHERE target NOT IN (SELECT name FROM k)""",
)
def page_links(spark, sf):
    """Links in whole pages to words that no page's title starts with."""
    pages = load(spark, sf, "pages")
    names = pages.where("html is not null").select(F.regexp_extract("html", "<title>([^ <]+)", 1).alias("name"))
    return corpus.broken_links(pages.select("page_id", F.length("html").alias("size"), "html"), names, "page_id", "size", "html", "name", corpus.HTML_LINK)


@query("required_files", "SELECT 'file_' || n || '.md' AS name FROM (SELECT unnest(range(1, 31)) AS n) WHERE n % 3 = 0")
def required_files(spark, sf):
    """Required names that are not there."""
    name = lambda c: F.concat(F.lit("file_"), F.col(c).cast("string"), F.lit(".md")).alias("name")
    names = load(spark, sf, "part").where("p_partkey % 3 <> 0").select(name("p_partkey"))
    return corpus.missing(names, spark.range(1, 31).select(name("id")), "name")


@query("hash_receipts", "SELECT page_id, CASE WHEN page_id % 5 = 0 THEN 'gone' ELSE 'changed' END AS state FROM pages WHERE page_id % 5 = 0 OR page_id % 7 = 0")
def hash_receipts(spark, sf):
    """Recorded digests that no longer hold."""
    pages = load(spark, sf, "pages")
    record = corpus.manifest(pages, "page_id", F.col("html"))
    now = pages.where("page_id % 5 <> 0").withColumn("html", F.when(F.col("page_id") % 7 == 0, F.concat(F.coalesce("html", F.lit("")), F.lit("!"))).otherwise(F.col("html")))
    return corpus.receipts(corpus.manifest(now, "page_id", F.col("html")), record, "page_id", "sha256")


@query("public_projection", "SELECT doc_id, lang, n_chars FROM documents")
def public_projection(spark, sf):
    return corpus.public(load(spark, sf, "documents"), ["doc_id", "lang", "n_chars", "device", "session"])


_PATHS = r"(?:[A-Za-z]:\\|/(?:home|Users|mnt)/)[^\s\"'']*"


@query(
    "private_text_scan",
    rf"WITH d AS (SELECT doc_id, CASE WHEN doc_id % 6 = 0 THEN 'see /home/u' || doc_id || '/a.wav and C:\x\y' WHEN doc_id % 6 = 1 THEN 'clean /data/x' ELSE lang END AS note, CASE WHEN doc_id % 10 = 3 THEN '/Users/k/z ' ELSE source END AS src FROM documents), l AS (SELECT doc_id, 'note' AS path, note AS v FROM d UNION ALL SELECT doc_id, 'src', src FROM d) SELECT doc_id, path, unnest(regexp_extract_all(v, '{_PATHS}')) AS found FROM l",
)
def private_text_scan(spark, sf):
    d = load(spark, sf, "documents").select(
        "doc_id",
        F.when(F.expr("doc_id % 6 = 0"), F.concat(F.lit("see /home/u"), "doc_id", F.lit("/a.wav and C:\\x\\y"))).when(F.expr("doc_id % 6 = 1"), "clean /data/x").otherwise(F.col("lang")).alias("note"),
        F.when(F.expr("doc_id % 10 = 3"), "/Users/k/z ").otherwise(F.col("source")).alias("src"),
    )
    return corpus.private_findings(d, "doc_id", ["note", "src"])


@query("json_leaves", "SELECT event_id, '$.k' AS path, json_extract_string(props, '$.k') AS value FROM events")
def json_leaves(spark, sf):
    leaves = corpus.walked(load(spark, sf, "events"), "event_id", "props")
    return leaves.select("event_id", F.concat(F.lit("$."), F.array_join("path", ".")).alias("path"), "value")


_NEST = """o AS (SELECT conv_id * 1000 + turn AS id, turn, role, string_split(text, chr(10)) AS lines FROM conversations)"""


def nested(spark, sf):
    """A JSON document for each turn: objects in lists in objects, a list element for each line."""
    lines = F.transform(F.split("text", "\n"), lambda x, i: F.struct(i.alias("no"), x.alias("text")))
    doc = F.struct("role", F.struct(F.col("turn").alias("Serial_no"), lines.alias("lines"), F.array(F.array("turn"), F.array().cast("array<int>")).alias("at")).alias("message"))
    return load(spark, sf, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.to_json(doc).alias("j"))


_LEAVES = _NEST + """, u AS (SELECT id, unnest(lines) AS line, generate_subscripts(lines, 1) - 1 AS k FROM o),
w AS (SELECT id, 'role' AS field, role AS value FROM o UNION ALL SELECT id, 'message/Serial_no', turn::VARCHAR FROM o UNION ALL SELECT id, 'message/at/[0]/[0]', turn::VARCHAR FROM o
UNION ALL SELECT id, 'message/lines/[' || k || ']/no', k::VARCHAR FROM u UNION ALL SELECT id, 'message/lines/[' || k || ']/text', line FROM u)"""


@query("json_walk", f"WITH {_LEAVES} SELECT id, field, value FROM w")
def json_walk(spark, sf):
    """Every leaf of nested documents made of whole conversation turns."""
    return corpus.walked(nested(spark, sf), "id", "j").select("id", F.array_join("path", "/").alias("field"), "value")


_TOKENS = ["serial", "imei", "gps", "latitude", "longitude", "phone_number", "owner_name"]


@query(
    "private_object_scan",
    rf"""WITH d AS (SELECT page_id, url, html FROM pages), w AS (SELECT page_id, 'source/url' AS field, url AS value FROM d UNION ALL SELECT page_id, 'source/owner_name', split_part(url, '/', 3) FROM d
UNION ALL SELECT page_id, 'body/[0]', html FROM d), f AS (SELECT page_id, field, unnest(regexp_extract_all(value, '{_PATHS}')) AS match FROM w)
SELECT page_id, field, match FROM f UNION ALL SELECT page_id, field, 'private-key-name' FROM w WHERE field LIKE '%owner_name' AND value IS NOT NULL""",
)
def private_object_scan(spark, sf):
    """Whole pages as objects: absolute paths in any value, and fields whose names are private."""
    source = F.struct("url", F.split_part("url", F.lit("/"), F.lit(3)).alias("owner_name"))
    rows = load(spark, sf, "pages").select("page_id", F.to_json(F.struct(source.alias("source"), F.array("html").alias("body"))).alias("j"))
    return corpus.findings(corpus.walked(rows, "page_id", "j"), "page_id", _TOKENS)


@query("json_props_extract", "SELECT json_extract_string(props, '$.k')::BIGINT % 10 AS k, count(*) AS n FROM events GROUP BY 1")
def json_props_extract(spark, sf):
    k = F.get_json_object("props", "$.k").cast("bigint") % 10
    return load(spark, sf, "events").groupBy(k.alias("k")).agg(F.count("*").alias("n"))


@query("url_segments", "SELECT page_id, nullif(regexp_extract(url, '^[a-z]+://([^/?#]+)', 1), '') AS host, list_filter(string_split(regexp_replace(url, '^[a-z]+://[^/?#]+|[?#].*$', '', 'g'), '/'), lambda x: x <> '')[1] AS first, list_filter(string_split(regexp_replace(url, '^[a-z]+://[^/?#]+|[?#].*$', '', 'g'), '/'), lambda x: x <> '')[-1] AS last FROM pages")
def url_segments(spark, sf):
    path = F.regexp_replace("url", r"^[a-z]+://[^/?#]+|[?#].*$", "")
    host = F.nullif(F.regexp_extract("url", r"^[a-z]+://([^/?#]+)", 1), F.lit(""))
    return load(spark, sf, "pages").select("page_id", host.alias("host"), sc.segment(path, 1).alias("first"), sc.segment(path, -1).alias("last"))


@query("path_classify", "SELECT page_id, CASE WHEN url LIKE '%?%' THEN 'query' WHEN regexp_matches(url, '://(www|m)\\.') THEN 'front' WHEN lower(regexp_extract(url, '\\.([A-Za-z0-9]+)$', 1)) IN ('html', 'htm', 'php') THEN 'file' ELSE 'other' END AS cls, CASE WHEN url LIKE 'https%' THEN 'secure' ELSE 'plain' END AS provenance FROM pages")
def path_classify(spark, sf):
    u = F.col("url")
    cls = F.when(u.contains("?"), "query").when(u.rlike(r"://(www|m)\."), "front").when(sc.extension("url").isin("html", "htm", "php"), "file").otherwise("other")
    return load(spark, sf, "pages").select("page_id", cls.alias("cls"), F.when(u.startswith("https"), "secure").otherwise("plain").alias("provenance"))


@query("family_key", "SELECT p_partkey, trim(regexp_replace(p_name, '(?i)small|large|red', '', 'g')) AS family FROM part")
def family_key(spark, sf):
    return load(spark, sf, "part").select("p_partkey", sc.family("p_name", "small|large|red").alias("family"))


@query("duration_parse", "WITH d AS (SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 'no duration' ELSE printf('Duration: %02d:%02d:%05.2f, start', (event_id % 5)::INT, (event_id % 60)::INT, (event_id % 59)::DOUBLE) END AS line FROM events) SELECT event_id, CASE WHEN line LIKE 'Dur%' THEN event_id % 5 * 3600.0::DOUBLE + event_id % 60 * 60 + event_id % 59 END AS seconds FROM d")
def duration_parse(spark, sf):
    e = F.col("event_id")
    line = F.format_string("Duration: %02d:%02d:%05.2f, start", (e % 5).cast("int"), (e % 60).cast("int"), (e % 59).cast("double"))
    return load(spark, sf, "events").select("event_id", F.when(e % 4 == 0, "no duration").otherwise(line).alias("line")).select("event_id", sc.clock_seconds("line").alias("seconds"))


@query("set_operations", "SELECT 'both' AS part, count(*) AS n FROM (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') UNION ALL SELECT 'only_f', count(*) FROM (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') UNION ALL SELECT 'either', count(*) FROM (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' UNION SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def set_operations(spark, sf):
    o = load(spark, sf, "orders")
    f, p = o.where("o_orderstatus = 'F'").select("o_custkey"), o.where("o_orderstatus = 'P'").select("o_custkey")
    count = lambda df, name: df.agg(F.lit(name).alias("part"), F.count("*").alias("n"))
    return count(f.intersect(p), "both").unionByName(count(f.subtract(p), "only_f")).unionByName(count(f.union(p).distinct(), "either"))


@query("union_of_shapes", f"{EV} SELECT event_type AS kind, user_id, value AS level, NULL::BIGINT AS length FROM ev WHERE event_type = 'click' UNION ALL SELECT 'span', user_id, NULL, {HOUR} FROM ev WHERE event_type = 'view'")
def union_of_shapes(spark, sf):
    a = events(spark, sf, "click").select(F.col("event_type").alias("kind"), "user_id", F.col("value").alias("level"))
    b = events(spark, sf, "view").select(F.lit("span").alias("kind"), "user_id", F.lit(HOUR).cast("bigint").alias("length"))
    return a.unionByName(b, allowMissingColumns=True)


@query("document_lint", "WITH l AS (SELECT doc_id, unnest(range(len(ls))) AS n, unnest(ls) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)), c AS (SELECT *, CASE WHEN line LIKE '|%' THEN len(string_split(line, '|')) END AS c FROM l), p AS (SELECT *, lag(c) OVER (PARTITION BY doc_id ORDER BY n) AS pc FROM c), h AS (SELECT doc_id, n, length(regexp_extract(line, '^(#+) ', 1)) AS h FROM l WHERE regexp_matches(line, '^#+ ')), j AS (SELECT *, lag(h) OVER (PARTITION BY doc_id ORDER BY n) AS ph FROM h) SELECT doc_id, n::INT AS n, 'table_width' AS error FROM p WHERE c <> pc UNION ALL SELECT doc_id, n::INT, 'heading_jump' FROM j WHERE h > coalesce(ph, 0) + 1")
def document_lint(spark, sf):
    lines = load(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("n", "line"))
    return corpus.lint(lines, "doc_id", "n", "line")
