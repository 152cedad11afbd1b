"""Bounded samples of labelled rows, for the classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: At most this many labelled rows are fitted on.
MAX_LABELLED = 20_000


def remainder(doc_id: Column, folds: int) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds


def sample(docs: DataFrame, labels: DataFrame, column: str, folds: int, held: int, limit: int = MAX_LABELLED) -> DataFrame:
    """(doc_id, text, y) of up to `limit` labelled rows outside the held-out fold, the first by a hash of doc_id.

    Null labels and null ids are left out; of several labels of one id the largest counts.
    """
    y = labels.where(F.col("doc_id").isNotNull() & F.col(column).isNotNull() & (remainder(F.col("doc_id"), folds) != held))
    y = y.groupBy("doc_id").agg(F.max(F.col(column).cast("int")).alias("y"))
    y = y.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    return docs.select("doc_id", "text").join(F.broadcast(y), "doc_id")
