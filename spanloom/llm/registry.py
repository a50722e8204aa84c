"""Queries of this package and, where SQL can express them, their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import alignment, codes, decontaminate, lines, lmscore, mixing, neardup, packing, pii, quality, shards, substrings, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontaminate": decontaminate.op1_decontaminate,
    "op2_quality": quality.op2_quality,
    "op3_jaccard": neardup.op3_jaccard,
    "op4_substrings": substrings.op4_substrings,
    "op5_lines": lines.op5_lines,
    "op6_warc": warc.op6_warc,
    "op7_packing": packing.op7_packing,
    "op8_pii": pii.op8_pii,
    "op9_lmscore": lmscore.op9_lmscore,
    "op10_shards": shards.op10_shards,
    "op11_alignment": alignment.op11_alignment,
    "op12_codes": codes.op12_codes,
    "op13_mix": mixing.op13_mix,
}
ORACLES: dict[str, str] = {
    "op1_decontaminate": decontaminate.SQL,
    "op2_quality": quality.SQL,
    "op3_jaccard": neardup.SQL,
    "op4_substrings": substrings.SQL,
    "op5_lines": lines.SQL,
    "op6_warc": warc.SQL,
    "op12_codes": codes.SQL,
}
