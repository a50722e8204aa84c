"""Personal data and information-theoretic sanitisation (op8, DataFrame functions only).

Base spans are regular expression matches that pass a check.  A pattern's
places come from the text split at it: the lengths of what lies between the
matches and of the matches add up to code points.

The method adds terms that give a protected entity away.  Entities of a
document are, of each base span, its value, its group (a host name, the first
half of an address, a card's issuer, a phone's prefix) and its kind, and
``credential`` where a label such as ``password =`` or a known prefix of keys
stands.  A value seldom occurs in several texts; its group and kind do.

Terms are words in lower case, outside base spans.  A run of letters and digits
of ``MIXED`` characters or more is too rare to be counted by itself, so its
shape stands for it (hexadecimal, capitals, mixed, and its length by powers of
two).  With N documents, n(t) of them holding the term, n(e) the entity and
n(t, e) both, wherever in the document, the term discloses the entity when

    PMI(t, e) = log2(N n(t, e) / (n(t) n(e))) >= DISCLOSURE * log2(N / n(e))

that is, when knowing the term tells at least that part of what there is to
know about the entity, and ``SUPPORT`` different texts show it.  Every place of
such a term is marked, in documents without the entity too.

A disclosing word is generalised to its first letter and a star if that, counted
like a term over the documents, does not disclose the entity; otherwise, and
where it stands for a shape, it is removed.

n(t) and n(t, e) are counted over every word of every document (n(t) with words
inside base spans), as partial sums; entities of fewer than ``SUPPORT`` texts, which no term can disclose, are
left out before pairs are made.  Up to ``GIVEN`` disclosing terms (a size that
is checked) are broadcast to the texts; more of them meet the texts' words in a
shuffle, the frequent ones apart.  A document joins the rest by (doc_id, hash of
its text).

Edge cases: a null text is empty and has no span; a row without doc_id takes
part like any; rows that repeat a doc_id and its text get the same spans; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import fewer, release, spread, table, written

KINDS = ["email", "ip", "card", "phone", "term"]
SUPPORT, DISCLOSURE = 3, 0.9
#: Shortest run of letters and digits that is a term by its shape; most disclosing terms that are broadcast.
MIXED, GIVEN = 8, 1 << 17

#: The contract's patterns.  Possessive repeats and looks behind change no match: they stop the engine
#: from trying starts inside a run whose start failed, and a card must be a whole run of 14 to 19 digits.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){13,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Labels of credentials before = or :, and the public prefix of one kind of access key.
CREDENTIAL = r"(?i)(?<![\p{L}\p{Nd}])(?:api[_-]?key|access[_-]?key|passwd|password|pwd|secret|token)\"?\s*[=:]|(?-i:(?<![\p{L}\p{Nd}])AKIA[0-9A-Z]{16})"
_RUN = r"[\p{L}\p{Nd}]++"
#: Stands for a base span; letters that touch it are part of what the span hides.
_HOLE = "\uffff"
#: Whole runs of letters, and whole runs of MIXED letters and digits or more, that touch no hole.
_WORD = r"(?<![\p{L}\p{Nd}\uFFFF])\p{L}++(?![\p{Nd}\uFFFF])"
_CODE = rf"(?<![\p{{L}}\p{{Nd}}\uFFFF])(?=\p{{L}}*+\p{{Nd}})(?=\p{{Nd}}*+\p{{L}})[\p{{L}}\p{{Nd}}]{{{MIXED},}}+(?!\uFFFF)"

_LAST = (1 << 63) - 1
#: Matches folded at once: a fold copies what it has for every match it keeps.
_FOLD = 256
_SPANS = "array<struct<start:int,end:int,value:string>>"


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once, however often ``use`` names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def places(text: Column, pattern: str, keep, value) -> Column:
    """Spans (start, end, value) of the matches that ``keep`` lets pass, in order; work grows with the matches."""
    none = F.array().cast(_SPANS)

    def fold(pairs: Column, begin: Column) -> Column:
        def step(acc: Column, x: Column) -> Column:
            a = acc["at"] + F.length(x["gap"])
            b = a + F.length(x["hit"])
            one = F.array(F.struct(a.alias("start"), b.alias("end"), value(x["hit"]).alias("value")))
            return F.struct(b.alias("at"), F.when(x["hit"].isNotNull() & keep(x["hit"]), F.concat(acc["out"], one)).otherwise(acc["out"]).alias("out"))

        return F.aggregate(pairs, F.struct(begin.alias("at"), none.alias("out")), step, lambda acc: acc["out"])

    def parts(pairs: Column) -> Column:
        part = lambda c: F.slice(pairs, c * _FOLD + 1, _FOLD)
        each = F.sequence(F.lit(0), F.floor((F.size(pairs) - 1) / _FOLD).cast("int"))
        length = lambda c: F.aggregate(part(c), F.lit(0), lambda n, x: n + F.length(x["gap"]) + F.coalesce(F.length(x["hit"]), F.lit(0)))
        begins = F.aggregate(each, F.array(F.lit(0)), lambda acc, c: F.concat(acc, F.array(F.element_at(acc, -1) + length(c))))
        return F.flatten(F.transform(F.arrays_zip(each.alias("c"), F.slice(begins, 1, F.size(each)).alias("b")), lambda x: fold(part(x["c"]), x["b"])))

    def found(hits: Column) -> Column:
        # zipped, as a lambda over positions would split the text again for every match; what follows the last match has no hit
        pairs = F.zip_with(hits, F.split(text, pattern, -1), lambda hit, gap: F.struct(hit.alias("hit"), gap.alias("gap")))
        few = F.size(hits) < _FOLD
        return F.when(F.size(hits) == 0, none).otherwise(_bound(pairs, lambda p: F.when(few, fold(p, F.lit(0))).otherwise(parts(p))))

    return _bound(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), found)


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _luhn(x: Column) -> Column:
    digits = F.reverse(_digits(x))
    total = F.aggregate(
        F.transform(F.filter(F.split(digits, ""), lambda d: d != ""), lambda d, i: d.cast("int") * F.when(i % 2 == 1, 2).otherwise(1)),
        F.lit(0),
        lambda a, d: a + F.when(d > 9, d - 9).otherwise(d),
    )
    return total % 10 == 0


def _octets(x: Column) -> Column:
    return F.forall(F.split(x, r"\."), lambda p: p.rlike(r"^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))


CHECKS = {
    "email": (lambda x: F.lit(True), F.lower),
    "ip": (_octets, lambda x: x),
    "card": (_luhn, _digits),
    "phone": (lambda x: F.length(_digits(x)).between(10, 15), _digits),
}
#: What a text must hold before its pattern is tried.
HINTS = {
    "email": lambda text: text.contains("@"),
    "ip": lambda text: text.contains(".") & text.rlike("[0-9]"),
    "card": lambda text: text.rlike("[0-9]"),
    "phone": lambda text: text.contains("+"),
}
#: The group of a value.
GROUPS = {
    "email": lambda v: F.substring_index(v, "@", -1),
    "ip": lambda v: F.substring_index(v, ".", 2),
    "card": lambda v: F.substring(v, 1, 6),
    "phone": lambda v: F.substring(v, 1, 4),
}


def base_spans(docs: DataFrame) -> DataFrame:
    """doc_id, key, hash, text and its base spans (start, kind, end, value) in order."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("hash"))
    rows = rows.withColumn("key", F.coalesce("doc_id", F.lit(_LAST)))
    none = F.array().cast(_SPANS)
    for kind, pattern in PATTERNS.items():
        found = places(F.col("text"), pattern, *CHECKS[kind])
        rows = rows.withColumn(kind, F.when(HINTS[kind](F.col("text")), found).otherwise(none))
    tagged = [_tagged(kind, i) for i, kind in enumerate(PATTERNS)]
    return rows.select("doc_id", "key", "hash", "text", F.array_sort(F.concat(*tagged)).alias("spans"))


def _tagged(kind: str, number: int) -> Column:
    return F.transform(kind, lambda s: F.struct(s["start"].alias("start"), F.lit(number).alias("kind"), s["end"].alias("end"), s["value"].alias("value")))


def _counted(spans: str, number: int) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == number)).cast("long")


def _entities(spans: str, text: Column) -> Column:
    """The protected entities of a document."""

    def of(s: Column) -> Column:
        group = F.lit("")
        for i, kind in enumerate(PATTERNS):
            group = F.when(s["kind"] == i, GROUPS[kind](s["value"])).otherwise(group)
        kind = s["kind"].cast("string")
        return F.array(F.concat(F.lit("k"), kind), F.concat(F.lit("g"), kind, F.lit(":"), group), F.concat(F.lit("v"), kind, F.lit(":"), s["value"]))

    named = F.flatten(F.transform(spans, of))
    label = (text.contains("=") | text.contains(":") | text.contains("AKIA")) & text.rlike(CREDENTIAL)
    return F.array_distinct(F.concat(named, F.when(label, F.array(F.lit("credential"))).otherwise(F.array().cast("array<string>"))))


def _shape(run: Column) -> Column:
    """What stands for a long run of letters and digits."""
    kind = F.when(run.rlike("^[0-9a-f]+$"), "hex").when(run.rlike("^[0-9A-Z]+$"), "capitals").otherwise("mixed")
    return F.concat(F.lit("#"), kind, F.lit(":"), F.floor(F.log2(F.length(run))).cast("string"))


def _term(run: Column) -> Column:
    """A word in lower case, the shape of a long run of letters and digits, or null."""
    digits, letters = run.rlike(r"\p{Nd}"), run.rlike(r"\p{L}")
    return F.when(~digits, F.lower(run)).when(letters & (F.length(run) >= MIXED), _shape(run))


def _words(text: Column) -> Column:
    """The different terms of a text, and first letters with a star for the words' generalisations."""
    words = F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(_WORD), F.lit(0)), F.lower))
    codes = F.when(text.rlike(r"\p{Nd}"), F.regexp_extract_all(text, F.lit(_CODE), F.lit(0))).otherwise(F.array().cast("array<string>"))
    shapes = F.array_distinct(F.transform(codes, _shape))
    return F.concat(_bound(words, lambda w: F.concat(w, F.array_distinct(F.transform(w, _general)))), shapes)


def _general(term: Column) -> Column:
    return F.concat(F.substring(term, 1, 1), F.lit("*"))


def _outside(text: Column, spans: Column) -> Column:
    """The text with each base span as one hole."""

    def step(acc: Column, s: Column) -> Column:
        gap = F.substring(text, acc["at"] + 1, F.greatest(s["start"] - acc["at"], F.lit(0)))
        return F.struct(F.greatest(s["end"], acc["at"]).alias("at"), F.concat(acc["out"], gap, F.lit(_HOLE)).alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    return F.aggregate(spans, start, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))


def disclosing(docs: DataFrame, found: DataFrame, support: int = SUPPORT, level: float = DISCLOSURE) -> DataFrame:
    """(entity, term, both, n_term, n_entity, pmi, known): terms, and generalisations of terms, that give the entity away."""
    some = found.where(F.size("entities") > 0)
    copies = some.select("key", "hash").distinct().groupBy("hash").agg(F.count("*").alias("n"))
    texts = written(some.select("hash", "entities", "terms").dropDuplicates(["hash"]).join(copies, "hash"), "texts")
    named = texts.select("hash", "n", F.explode("entities").alias("entity"))
    entities = named.groupBy("entity").agg(F.sum("n").alias("n_entity"), F.count("*").alias("shown")).where(F.col("shown") >= support)
    entities = written(entities, "entities")
    held = spread(named.select("hash", "entity"), entities.select("entity", "shown"), ["entity"], "shown")
    held = texts.select("hash", "n", "terms").join(held.groupBy("hash").agg(F.collect_set("entity").alias("entities")), "hash")
    pairs = held.select("n", "terms", F.explode("entities").alias("entity")).select("n", "entity", F.explode("terms").alias("term"))
    pairs = pairs.groupBy("entity", "term").agg(F.sum("n").alias("both"), F.count("*").alias("texts"))
    pairs = written(pairs.where(F.col("texts") >= support), "pairs")
    terms = docs.select(F.explode(_words(F.coalesce("text", F.lit("")))).alias("term")).groupBy("term").agg(F.count("*").alias("n_term"))
    total = float(max(docs.count(), 1))
    kept = pairs.join(terms.join(pairs.select("term").distinct(), "term"), "term").join(entities.drop("shown"), "entity")
    known = F.log2(F.lit(total) / F.col("n_entity"))
    pmi = F.log2(F.lit(total) * F.col("both") / (F.col("n_term") * F.col("n_entity")))
    out = written(kept.withColumns({"known": known, "pmi": pmi}).where((F.col("known") > 0) & (F.col("pmi") >= level * F.col("known"))), "disclosing")
    release(texts, pairs)
    return out.select("entity", "term", "both", "n_term", "n_entity", "pmi", "known")


def _given(give: DataFrame) -> DataFrame:
    """(term, n_term, action) of the terms to mark."""
    wide = give.where(F.col("term").endswith("*")).select("entity", F.col("term").alias("general"), F.lit(True).alias("wide"))
    told = give.where(~F.col("term").endswith("*")).withColumn("general", _general(F.col("term"))).join(wide, ["entity", "general"], "left")
    removed = F.coalesce("wide", F.lit(False)) | F.col("term").startswith("#")
    return written(told.groupBy("term").agg(F.max("n_term").alias("n_term"), F.when(F.max(removed), "remove").otherwise("generalise").alias("action")), "given")


def _holders(docs: DataFrame, given: DataFrame) -> DataFrame:
    """key, hash, text and the disclosing terms (a map to actions) of the documents that hold any: no other text is shuffled."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("key"), F.xxhash64(text).alias("hash"), text.alias("text"))
    each = rows.withColumn("term", F.explode(_words(F.col("text"))))
    actions = F.map_from_entries(F.collect_set(F.struct("term", "action"))).alias("actions")
    if given.count() <= GIVEN:
        held = each.join(F.broadcast(given.select("term", "action")), "term")
        return held.groupBy("key", "hash").agg(F.first("text").alias("text"), actions)
    held = spread(each.drop("text"), given, ["term"], "n_term").groupBy("key", "hash").agg(actions)
    return rows.join(held, ["key", "hash"]).dropDuplicates(["key", "hash"])


def spans(docs: DataFrame, support: int = SUPPORT, level: float = DISCLOSURE) -> DataFrame:
    """doc_id, key, hash, base and all spans (start, kind, end, action) and clean_sha256, the hash of the sanitised text, of every document."""
    found = base_spans(docs)
    text = F.col("text")
    base = F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), F.lit("mask").alias("action")))
    found = found.withColumns({"entities": _entities("spans", text), "base": base})
    # the words beside base spans, while the text is at hand
    terms = F.when(F.size("entities") > 0, _words(_outside(text, F.col("spans")))).otherwise(F.array().cast("array<string>"))
    clean = F.when(F.size("base") > 0, _clean(text, "base")).otherwise(text)
    found = written(found.select("doc_id", "key", "hash", "base", "entities", terms.alias("terms"), F.sha2(clean.cast("binary"), 256).alias("base_clean")), "found")
    holders = _holders(docs, _given(disclosing(docs, found, support, level)))
    rows = holders.join(found.select("key", "hash", "base").dropDuplicates(["key", "hash"]), ["key", "hash"])
    runs = places(text, _RUN, lambda x: F.coalesce(F.map_contains_key("actions", _term(x)), F.lit(False)), _term)
    added = F.transform(runs, lambda w: F.struct(w["start"].alias("start"), F.lit(4).alias("kind"), w["end"].alias("end"), F.element_at("actions", w["value"]).alias("action")))
    apart = F.filter("added", lambda w: ~F.exists("base", lambda s: (s["start"] < w["end"]) & (s["end"] > w["start"])))
    rows = rows.withColumn("added", added).withColumn("all", F.array_sort(F.concat("base", apart)))
    marks = written(rows.select("key", "hash", "all", F.sha2(_clean(text, "all").cast("binary"), 256).alias("clean")), "marks")
    return fewer(found.select("doc_id", "key", "hash", "base", "base_clean").join(marks, ["key", "hash"], "left")).select(
        "doc_id", "key", "hash", "base", F.coalesce("all", "base").alias("all"), F.coalesce("clean", "base_clean").alias("clean_sha256")
    )


def _clean(text: Column, spans: str) -> Column:
    """The text with entities as [KIND], disclosing words as a letter and a star or gone."""
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        general = F.concat(F.substring(text, s["start"] + 1, F.lit(1)), F.lit("*"))
        label = F.when(s["action"] == "remove", "").when(s["action"] == "generalise", general).otherwise(F.element_at(names, s["kind"] + 1))
        gap = F.substring(text, acc["at"] + 1, s["start"] - acc["at"])
        ahead = s["start"] >= acc["at"]
        return F.struct(F.greatest(s["end"], acc["at"]).alias("at"), F.when(ahead, F.concat(acc["out"], F.array(gap, label))).otherwise(acc["out"]).alias("out"))

    return F.aggregate(spans, start, step, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(text, acc["at"] + 1, F.length(text))))


def sanitised(docs: DataFrame, **options) -> DataFrame:
    """doc_id and the text: entities become [KIND], disclosing words a letter and a star or nothing."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("key"), F.xxhash64(text).alias("hash"), text.alias("text"))
    marks = spans(docs, **options).where(F.size("all") > 0).select("key", "hash", "all").dropDuplicates(["key", "hash"])
    return rows.join(marks, ["key", "hash"], "left").select("doc_id", F.when(F.col("all").isNotNull(), _clean(F.col("text"), "all")).otherwise(F.col("text")).alias("text"))


def _listed(all_spans: str) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(all_spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = spans(table(spark, sf_dir, "documents").select("doc_id", "text"))
    counts = [_counted("base", i).alias(f"n_{k}") for i, k in enumerate(PATTERNS)]
    return found.select(
        "doc_id", *counts, F.sha2(_listed("base").cast("binary"), 256).alias("base_sha256"), _listed("all").alias("spans"),
        F.size("all").cast("long").alias("n_spans"), _counted("all", 4).alias("n_terms"), "clean_sha256",
    )
