"""The corpus pipeline: five stages over documents, each written as Parquet and read again by the caller or by run()."""

from __future__ import annotations

import itertools
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline.llm import mixing, neardup, packing, pii, quality
from sieveline.llm.common import checkpoint_dir, numbered, table
from sieveline.llm.queries import tokenizer_path


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier predicts as good.

    Null and empty texts go by the score of no words; rows without doc_id are judged like any; repeated rows all stay or go;
    columns of docs keep their values whatever their names.
    """
    taken = {c.lower() for c in docs.columns}
    free = lambda name: next(n for k in itertools.count(1) if (n := name + "_" * k) not in taken)
    said = (free("held_out"), free("score"), free("predicted"))
    return quality.classify(docs, table(spark, sf_dir, "labels"), names=said).where(F.col(said[2]) == 1).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: the one with the smallest doc_id, or one without doc_id where none has any.

    Rows equal in doc_id and text are one document; rows that share a doc_id but differ in text, and rows without doc_id,
    are documents of their own and stay unless they are near copies of another.
    """
    keyed = numbered(docs)
    kept = neardup.near_duplicates(keyed.select(F.col("row_").alias("doc_id"), "doc_.text"), width=5, percent=80).where("kept").select(F.col("doc_id").alias("row_")).distinct()
    return keyed.join(kept, "row_", "left_semi").dropDuplicates(["row_"]).select("doc_.*")


def redact_private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind. Null texts stay null; every row stays, repeated ones too."""
    return pii.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, up to three times; empty ones once.

    Rows without doc_id, or that share one and differ in text, are documents of their own, as in drop_near_duplicates, after
    which no two rows are equal in both.
    """
    keyed = numbered(docs)
    mix = mixing.weighted_fair_mix(keyed.select(F.col("row_").alias("doc_id"), "doc_.text", "doc_.source")).select(F.col("doc_id").alias("row_"), F.when(F.col("size") > 0, F.col("taken") / F.col("size")).otherwise(1).cast("int").alias("copies_"))
    out = keyed.join(mix.where("copies_ > 0"), "row_")
    return out.withColumn("copy_", F.explode(F.sequence(F.lit(1), "copies_"))).select("doc_.*")


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences, of every row once; null and empty texts have one piece."""
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("quality", keep_quality),
    ("near_duplicates", drop_near_duplicates),
    ("private", redact_private),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]
#: No SQL has the classifier or the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents; each result is written to the checkpoint folder and read again."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
