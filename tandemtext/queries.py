"""The queries of the alignment operators, by name, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tandemtext.plans import queries_books, queries_text, queries_vectors

_PARTS = (queries_vectors, queries_text, queries_books)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: f for p in _PARTS for k, f in p.QUERIES.items()}
ORACLES: dict[str, str] = {k: s for p in _PARTS for k, s in p.ORACLES.items()}
