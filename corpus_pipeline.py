"""A training-data pipeline over ``documents``: rules, lines, near copies, benchmark passages, packing.

Every stage but the last returns the columns of its input, whatever they are
called: what an operator adds takes names that are free.  A row is a document of
its own by its doc_id and text, null doc_ids included, and an empty table stays
empty.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from spanloom.llm import decontaminate, lines, neardup, packing, quality
from spanloom.llm.base import free, table, written

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects; null and blank texts go, repeated rows are judged alike."""
    return quality.kept(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without later repeated runs of lines; a document that was nothing else goes.

    A document without any line stays as it is; rows that repeat a doc_id and its
    text get the same text; ``n_chars``, where it is a number, follows the text.
    """
    found = lines.deduplicated(docs)
    n_lines, n_removed, kept = (F.col(free(docs, c)) for c in lines.ADDED)
    some = found.where((n_removed == 0) | (n_removed < n_lines))
    changed = {"text": F.when(n_removed > 0, kept).otherwise(F.col("text"))}
    if "n_chars" in docs.columns and isinstance(docs.schema["n_chars"].dataType, NumericType):
        changed["n_chars"] = F.when(n_removed > 0, F.length(kept)).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    return some.withColumns(changed).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that similarity links: the smallest doc_id, of equal ones the smallest text hash, without doc_id last.

    Rows that repeat a doc_id with another text are judged by their texts; texts without a shingle stay.
    """
    return neardup.one_of_each(docs).select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of a benchmark item; null and empty texts hold none."""
    found = decontaminate.scanned(docs, table(spark, sf_dir, "benchmark"))
    return found.where(F.col(free(docs, "_n_hit")) == 0).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences; the last stage.  A null or empty text is its end id."""
    return packing.packed(docs, packing.tokenizer_path())


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("packing", pack),
]

#: SQL has no tokenizer; tests hold every stage against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
