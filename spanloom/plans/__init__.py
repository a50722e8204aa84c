"""Registered queries over the driver's tables, each with a DuckDB twin where SQL can express it."""

from . import decisions, governance, long, matching, measures, series, spans, spectra, tables, waves
from .base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "decisions", "governance", "long", "matching", "measures", "series", "spans", "spectra", "tables", "waves"]
