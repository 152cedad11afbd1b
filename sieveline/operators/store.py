"""The evidence store: passages of trusted sources cut to windows about each entity, appended to what is there."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import evidence

#: What an evidence row gets where its source was not assessed.
DEFAULTS = {"source_role": "discovery", "source_quality": "medium", "officiality": "third_party"}
COLUMNS = ["request_id", "entity", "seq", "text", "source_url", "source_title", "origin", *DEFAULTS, "aspect_coverage", "query_sources", "selected_chunk_rank"]


def pass_through_ranking(sources: DataFrame, chunks: DataFrame) -> DataFrame:
    """(request_id, source_id, chunk_id, rank, final_score, selected): every chunk selected in input order, for use without a ranker."""
    place = F.row_number().over(Window.partitionBy("request_id").orderBy("ord", "sequence_index", "chunk_id"))
    df = chunks.join(sources.select("request_id", "source_id", "ord"), ["request_id", "source_id"])
    return df.select("request_id", "source_id", "chunk_id", place.alias("rank"), F.lit(0.0).alias("final_score"), F.lit(True).alias("selected"))


def non_low(filtered_out: str = "filtered_out") -> Column:
    """Whether an assessed source counts: neither filtered out nor of low quality or officiality. Null where not assessed."""
    return ~F.col(filtered_out) & (F.col("source_quality") != "low") & (F.col("officiality") != "low_quality")


def source_records(sources: DataFrame, chunks: DataFrame, ranked: DataFrame, assessed: DataFrame) -> DataFrame:
    """Selected, non-blank chunks of sources that could be read and were not filtered out, with their source's assessment.

    sources(request_id, source_id, ord, url, title, origin, fetch_succeeded), chunks(request_id, source_id, chunk_id,
    sequence_index, text), ranked(request_id, chunk_id, rank, selected), assessed(request_id, url, title, filtered_out, the
    columns of DEFAULTS, aspect_coverage, query_sources). Sources without an assessment pass and take the defaults. The
    selection, a few rows a request, is joined first, so whole texts are read for it alone.
    """
    chosen = ranked.where("selected").select("request_id", "chunk_id", F.col("rank").alias("selected_chunk_rank"))
    fine = sources.where(F.coalesce("fetch_succeeded", F.lit(True))).select("request_id", "source_id", "ord", "url", F.col("title").alias("own_title"), "origin")
    judged = assessed.select("request_id", "url", F.col("title").alias("judged_title"), "filtered_out", *DEFAULTS, "aspect_coverage", "query_sources")
    df = chunks.join(chosen, ["request_id", "chunk_id"]).where("trim(text) <> ''").join(fine, ["request_id", "source_id"]).join(judged, ["request_id", "url"], "left").where(~F.coalesce("filtered_out", F.lit(False)))
    none = F.array().cast("array<string>")
    title = F.coalesce(F.nullif(F.trim("own_title"), F.lit("")), "judged_title", "url")
    return df.select("request_id", "source_id", "chunk_id", "ord", "sequence_index", F.trim("text").alias("text"), F.col("url").alias("source_url"), title.alias("source_title"), "origin", *[F.coalesce(c, F.lit(v)).alias(c) for c, v in DEFAULTS.items()], F.coalesce("aspect_coverage", none).alias("aspect_coverage"), F.coalesce("query_sources", none).alias("query_sources"), "selected_chunk_rank")


def targets(records: DataFrame, matches: DataFrame, candidate_urls: DataFrame) -> DataFrame:
    """(request_id, chunk_id, name): the candidates of a chunk's source; only where it has none, those the chunk names.

    matches(request_id, chunk_id, name), candidate_urls(request_id, name, url)."""
    at = records.select("request_id", "chunk_id", F.col("source_url").alias("url"))
    primary = at.join(candidate_urls.select("request_id", "url", "name").distinct(), ["request_id", "url"])
    orphan = at.join(candidate_urls.select("request_id", "url").distinct(), ["request_id", "url"], "left_anti")
    fallback = matches.select("request_id", "chunk_id", "name").distinct().join(orphan.select("request_id", "chunk_id"), ["request_id", "chunk_id"])
    return primary.select("request_id", "chunk_id", "name").unionByName(fallback.select("request_id", "chunk_id", "name"))


def append(existing: DataFrame | None, fresh: DataFrame) -> DataFrame:
    """Evidence of one request, entity, url and text once: what is stored stays, then the first new row. COLUMNS in and out."""
    rows = fresh.select("*", F.lit(1).alias("new_"))
    if existing is not None:
        rows = existing.select("*", F.lit(0).alias("new_")).unionByName(rows)
    first = F.row_number().over(Window.partitionBy("request_id", "entity", "source_url", "text").orderBy("new_", "seq"))
    kept = rows.withColumn("first_", first).where("first_ = 1")
    place = F.row_number().over(Window.partitionBy("request_id", "entity").orderBy("new_", "seq")) - 1
    return kept.withColumn("seq", place.cast("long")).select(*COLUMNS)


def build(records: DataFrame, candidates: DataFrame, candidate_urls: DataFrame, stops: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """COLUMNS of evidence: for each chunk and target entity the sentence windows about it, added to `existing`.

    candidates(request_id, name), stops(request_id, name). Sentences are matched once and serve both the targets and the
    windows. Every step is keyed by request and chunk; a chunk's sentences are the largest group.
    """
    texts = records.select("request_id", F.col("chunk_id").alias("source_id"), "text")
    matches = evidence.sentence_matches(texts, candidates)
    wanted = targets(records, matches.withColumnRenamed("source_id", "chunk_id"), candidate_urls).withColumnRenamed("chunk_id", "source_id")
    spans = evidence.windows(texts, matches.join(wanted, ["request_id", "source_id", "name"], "left_semi"), stops, named=matches)
    df = spans.select("request_id", F.col("source_id").alias("chunk_id"), F.col("name").alias("entity"), F.col("first").alias("from_"), F.col("text").alias("window_")).join(records.drop("text"), ["request_id", "chunk_id"])
    place = F.row_number().over(Window.partitionBy("request_id", "entity").orderBy("ord", "sequence_index", "from_")).cast("long")
    return append(existing, df.withColumn("seq", place).withColumnRenamed("window_", "text").select(*COLUMNS))
