"""The registered queries of this subpackage, with production parameters over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import divergence, hnsw, idfiles, mixing, neardup, packing, pii, quality, repair, sharding, substring, topk, toxicity
from .common import table


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.place(spark, table(spark, sf_dir, "documents").select("doc_id")).select("doc_id", "slot", "shard")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())


def op4_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(table(spark, sf_dir, "embeddings"))


def op5_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), width=4, percent=80)


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(spark, sf_dir, "documents")).select("doc_id", *[f"n_{k}" for k in pii.KINDS], "base_sha256", "spans")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.weighted_fair_mix(table(spark, sf_dir, "documents"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")


def op9_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.remove_repeats(table(spark, sf_dir, "documents"))


def op10_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hnsw.near_duplicates(table(spark, sf_dir, "embeddings"))


def op11_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    return repair.repair(repair.damaged(rows), rows)


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def op13_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return idfiles.encode_corpus(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), end=2)


def queries() -> dict:
    ops = (op1_toxicity, op2_sharding, op3_packing, op4_topk, op5_minhash, op6_pii, op7_mixing, op8_quality, op9_substring, op10_embedding, op11_conversations, op12_divergence, op13_token_files)
    return {f.__name__: f for f in ops}


def oracle_sql() -> dict[str, str]:
    return {"op2_sharding": sharding.oracle(), "op4_topk": topk.SQL, "op7_mixing": mixing.SQL, "op11_conversations": repair.SQL, "op12_divergence": divergence.SQL}
