"""Source assessment by rules: signals, quality, officiality and the assessed source."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import compact, compact_overlap, contains_ratio, host_core, low_host, official_path, path, plain_tokens, segments, third_party


def signals(results: DataFrame, query_tokens) -> DataFrame:
    """Add relevance_hint, official_path_hint and snippet_thinness_hint."""
    found = plain_tokens(F.concat_ws(" ", "title", "snippet"))
    relevance = F.when(F.size(query_tokens) > 0, F.size(F.array_intersect(query_tokens, found)) / F.size(query_tokens)).otherwise(0.0)
    thin = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.length(F.trim("snippet")) / 80))
    return results.withColumn("relevance_hint", F.round(relevance, 6)).withColumn("official_path_hint", official_path(F.col("url")).cast("double")).withColumn("snippet_thinness_hint", F.round(thin, 6))


def quality(df: DataFrame, context_chars: str = "context_chars", fallback: str = "fallback") -> DataFrame:
    """Add quality_score, source_quality and quality_confidence from signals, snippet, context length and URL."""
    n, ctx, fb = F.length(F.trim("snippet")), F.col(context_chars), F.col(fallback)
    rel, p = F.col("relevance_hint"), path(F.col("url"))
    score = F.when(n == 0, -4).when(n < 80, -2).otherwise(0)
    score = score + F.when(rel < 0.05, -3).when(rel < 0.12, -1).when(rel >= 0.3, 2).otherwise(0)
    score = score + F.when(fb, F.lit(-3) + F.when(n < 80, -2).otherwise(0) + F.when(ctx < 140, -1).otherwise(0)).otherwise(0)
    score = score + F.when(ctx < 80, -2).when(ctx >= 240, 1).otherwise(0)
    score = score + F.when(low_host(F.col("url")), F.lit(-3) + F.when(fb | (n == 0), -2).otherwise(0)).otherwise(0)
    score = score + F.when((F.length(p) > 90) | (segments(F.col("url")) > 6), -1).otherwise(0)
    df = df.withColumn("quality_score", score)
    s = F.col("quality_score")
    df = df.withColumn("source_quality", F.when(s <= -3, "low").when(s >= 2, "high").otherwise("medium"))
    margin = F.least(F.abs(s - 1), F.abs(s + 2))
    sure = F.when(s <= -3, F.least(F.lit(0.98), 0.55 + F.abs(s) * 0.1)).when(s >= 2, F.least(F.lit(0.95), 0.5 + s * 0.08)).otherwise(F.greatest(F.lit(0.45), F.least(F.lit(0.78), 0.45 + margin * 0.08)))
    return df.withColumn("quality_confidence", F.round(sure, 6))


def officiality(df: DataFrame, candidates: str = "candidates") -> DataFrame:
    """Add domain_match, title_match, officiality (null: undecided) and its confidence, over an array of candidate names."""
    names = F.filter(F.transform(candidates, compact), lambda c: F.length(c) >= 4)
    top = lambda f: F.coalesce(F.array_max(F.transform(names, f)), F.lit(0.0))
    df = df.withColumn("core_", host_core(F.col("url"))).withColumn("t_", compact(F.col("title"))).withColumn("s_", compact(F.col("snippet")))
    df = df.withColumn("domain_match", F.round(top(lambda c: compact_overlap(c, F.col("core_"))), 6))
    df = df.withColumn("title_match", F.round(top(lambda c: F.greatest(contains_ratio(c, F.col("t_")), contains_ratio(c, F.col("s_")))), 6)).drop("core_", "t_", "s_")
    d, t, p, third = F.col("domain_match"), F.col("title_match"), official_path(F.col("url")), third_party(F.col("title"), F.col("snippet"), F.col("url"))
    official, near, other = (d >= 0.92) & (t >= 0.92) & ~third, (t >= 0.72) & ((d >= 0.78) | p), third & (d < 0.78) & (t < 0.72)
    df = df.withColumn("officiality", F.when(official, "official").when(near, "near_official").when(other, "third_party"))
    return df.withColumn("officiality_confidence", F.when(official, 0.94).when(near & p, 0.78).when(near, 0.74).when(other, 0.8).otherwise(0.35))


def assessed(df: DataFrame) -> DataFrame:
    """Add filtered_out, source_role and evidence_sufficiency; undecided officiality becomes third_party."""
    q, o, c = F.col("source_quality"), F.col("officiality"), F.col("quality_confidence")
    third = o == "third_party"
    out = ((q == "low") & (c >= 0.8)) | ((q == "medium") & third & (c >= 0.65) & (F.col("relevance_hint") < 0.12)) | ((q == "medium") & third & (c >= 0.62) & F.col("fallback"))
    enough = F.greatest(F.lit(0.1), 1 - F.col("snippet_thinness_hint"))
    enough = F.when(F.col("context_chars") == 0, F.least(enough, F.lit(0.5))).when(F.col("fallback"), F.least(enough, F.lit(0.55))).otherwise(enough)
    df = df.withColumn("filtered_out", F.coalesce(out, F.lit(False)))
    df = df.withColumn("source_role", F.when(o.isin("official", "near_official"), "verification").otherwise("discovery"))
    df = df.withColumn("evidence_sufficiency", F.round(F.when(F.col("filtered_out"), 0.0).otherwise(enough), 6))
    return df.withColumn("officiality", F.coalesce(o, F.lit("third_party")))
