"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are maximal runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Only a session on one machine gets one of our own."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and (not sc.master.startswith("local") or sc.master.startswith("local-cluster")):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="sieveline-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in checkpoint_dir()."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def numbered(docs: DataFrame) -> DataFrame:
    """(row_, doc_): the rows of docs as structs, and a number of its own for each pair of doc_id and text: the doc_id where it
    is set and has one text.

    Only pairs without doc_id, and all but one of those that share one, get a new number, above every doc_id.
    """
    docs = docs.select(F.struct(*docs.columns).alias("doc_"), F.col("doc_id").cast("long").alias("id_"), F.coalesce(F.md5("text"), F.lit("")).alias("digest_"))
    pairs = docs.select("id_", "digest_")
    shared = pairs.where("id_ is not null").groupBy("id_").agg(F.min("digest_").alias("lo"), F.max("digest_").alias("hi")).where("lo < hi").select("id_", "lo")
    others = pairs.join(shared, "id_").where("digest_ <> lo").drop("lo").unionByName(pairs.where("id_ is null")).distinct()
    top = docs.agg(F.coalesce(F.max("id_"), F.lit(0).cast("long"))).first()[0]
    others = cut(others.select(F.col("id_").alias("i_"), F.col("digest_").alias("d_"), (F.monotonically_increasing_id() + top + 1).alias("new_")))
    if others.isEmpty():
        return docs.select(F.col("id_").alias("row_"), "doc_")
    docs = docs.join(others, F.col("id_").eqNullSafe(F.col("i_")) & (F.col("digest_") == F.col("d_")), "left")
    return docs.select(F.coalesce("new_", "id_").alias("row_"), "doc_")


def utf8(text) -> bytes:
    """UTF-8 of a text, empty for null; lone surrogates become question marks."""
    return text.encode("utf-8", "replace") if isinstance(text, str) else b""
