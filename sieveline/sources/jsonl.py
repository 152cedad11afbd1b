"""Append-only JSON-lines data sets without repeats."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import collapse
from ..operators.evidence import first_of

CHUNK_KEY = ["normalized_query", "url", "chunk_key"]


def new_rows(rows: DataFrame, existing: DataFrame | None, keys: list[str], order: str) -> DataFrame:
    """The first row of each key that `existing` does not have."""
    fresh = first_of(rows, keys, order)
    return fresh if existing is None else fresh.join(existing.select(*keys).distinct(), keys, "left_anti")


def with_chunk_key(rows: DataFrame) -> DataFrame:
    return rows.withColumn("chunk_key", collapse(F.col("text")))


def append(rows: DataFrame, path: str, keys: list[str], order: str, existing: DataFrame | None = None) -> None:
    """Write what is new to a folder of JSON lines."""
    new_rows(rows, existing, keys, order).write.mode("append").json(path)
