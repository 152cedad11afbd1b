"""Passages: lexical ranking of chunks for a query and its rewrites, many requests at a time."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.text import retrieval_tokens, share
from .plan import cut, small
from .postings import bm25, build, terms_of, tokenised


def variants(plans: DataFrame, stem=None) -> DataFrame:
    """(request_id, label, tokens): base (the normalised query, else the base query) and rewrite_i, blank and equal ones skipped."""
    base = F.coalesce(F.nullif(F.trim("normalized_query"), F.lit("")), F.col("base_query"))
    first = plans.select("request_id", F.lit("base").alias("label"), base.alias("query"))
    rest = plans.select("request_id", base.alias("base_"), F.posexplode("rewrites").alias("i", "query")).where("trim(query) <> '' and trim(query) <> base_")
    rest = rest.select("request_id", F.concat(F.lit("rewrite_"), F.col("i") + 1).alias("label"), "query")
    return first.unionByName(rest).select("request_id", "label", retrieval_tokens(F.col("query"), stem).alias("tokens"))


def rank_passages(chunks: DataFrame, plans: DataFrame, top_k: int = 24, stem=None) -> DataFrame:
    """chunks(request_id, source_id, chunk_id, text) -> the top_k passages of each request with all parts of their scores.

    Texts are tokenised once; scores come from the postings of the queries' terms. Ranks use a window with a rank limit, which
    Spark pushes below the shuffle. Blank chunks are left out. Spans are looked for in chunks with a term of the query, and
    in no more than top_k others a request.
    """
    asked = cut(variants(plans, stem))
    index = build(tokenised(chunks, "source_id", stem=stem), terms_of(asked, "tokens"))
    documents = index.documents
    scores = cut(bm25(index, asked).groupBy("request_id", "chunk_id").agg(F.map_from_entries(F.collect_list(F.struct("label", "score"))).alias("by_label")))
    anchors = F.aggregate("all_tokens", F.element_at("all_tokens", 1), lambda a, t: F.array_intersect(a, t))
    bundle = asked.groupBy("request_id").agg(F.sort_array(F.collect_list(F.struct("label", "tokens"))).alias("v"))
    bundle = bundle.withColumn("all_tokens", F.filter(F.transform("v", lambda x: F.array_distinct(x["tokens"])), lambda t: F.size(t) > 0))
    # Every contiguous run of every variant, padded, with its share of the variant: made once a request, not once a chunk.
    run = lambda t, i, j: F.struct((j / F.size(t)).alias("share"), F.concat(F.lit(" "), F.array_join(F.slice(t, i, j), " "), F.lit(" ")).alias("text"))
    of = lambda t: F.flatten(F.transform(F.sequence(F.lit(1), F.size(t)), lambda i: F.transform(F.sequence(F.lit(1), F.size(t) - i + 1), lambda j: run(t, i, j))))
    bundle = bundle.withColumn("runs", F.flatten(F.transform(F.filter("v", lambda x: F.size(x["tokens"]) > 0), lambda x: of(x["tokens"]))))
    bundle = bundle.select("request_id", "v", "runs", F.when(F.size("all_tokens") > 0, anchors).otherwise(F.array().cast("array<string>")).alias("anchors"))
    # Without a term of the query a chunk scores 0 throughout: of these only the first few can be wanted, by their ids alone.
    first = F.row_number().over(Window.partitionBy("request_id").orderBy("source_id", "chunk_id"))
    spare = documents.select("request_id", "chunk_id", first.alias("n_")).where(F.col("n_") <= top_k).select("request_id", "chunk_id", F.lit(None).cast("map<string,double>").alias("by_label"))
    wanted = scores.unionByName(spare.join(scores.select("request_id", "chunk_id"), ["request_id", "chunk_id"], "left_anti"))
    df = documents.join(wanted, ["request_id", "chunk_id"]).select("request_id", "source_id", "chunk_id", "by_label", "tokens").join(small(cut(bundle)), "request_id")
    score = lambda label: F.coalesce(F.element_at("by_label", label), F.lit(0.0))
    rewrites = F.transform(F.filter("v", lambda x: x["label"] != "base"), lambda x: F.struct(score(x["label"]).alias("score"), x["label"].alias("label")))
    df = df.withColumn("base_score", score(F.lit("base"))).withColumn("rewrites_", rewrites)
    df = df.withColumn("best_", F.array_max("rewrites_"))
    df = df.withColumn("best_rewrite_score", F.coalesce(F.col("best_.score"), F.lit(0.0))).withColumn("best_query", F.col("best_.label"))
    df = df.withColumn("coverage_count", F.when(F.col("best_rewrite_score") > 0, F.size(F.filter("rewrites_", lambda r: r["score"] >= 0.8 * F.col("best_rewrite_score")))).otherwise(0))
    df = df.withColumn("coverage_score", F.when(F.size("rewrites_") > 0, F.col("coverage_count") / F.size("rewrites_")).otherwise(0.0))
    df = df.withColumn("body_", F.concat(F.lit(" "), F.array_join("tokens", " "), F.lit(" ")))
    df = df.withColumn("span_score", F.aggregate("runs", F.lit(0.0), lambda a, r: F.when((r["share"] > a) & F.col("body_").contains(r["text"]), r["share"]).otherwise(a)))
    df = df.withColumn("anchor_score", share(F.col("tokens"), F.col("anchors")))
    parts = zip(fixed.PASSAGE_WEIGHTS, ("base_score", "best_rewrite_score", "coverage_score", "span_score", "anchor_score"))
    df = df.withColumn("final_score", F.round(sum((w * F.col(c) for w, c in parts), F.lit(0.0)), 6))
    rank = F.row_number().over(Window.partitionBy("request_id").orderBy(F.desc("final_score"), "source_id", "chunk_id"))
    names = ("base_score", "best_rewrite_score", "coverage_score", "span_score", "anchor_score")
    return df.withColumn("rank", rank).where(F.col("rank") <= top_k).select("request_id", "rank", "source_id", "chunk_id", "final_score", "best_query", "coverage_count", *[F.round(c, 6).alias(c) for c in names])
