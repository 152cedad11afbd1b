"""Whole requests: from a topic to a table of entities whose values are backed by evidence, for many requests in one plan."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import compact, host_core, plain_tokens, retrieval_tokens
from ..operators import answers, assess, cells, entities, evidence, passages, plan, providers, report, results, search, store, tables
from ..sources import stored


@dataclass(frozen=True)
class Settings:
    """Bounds of a request: queries sent, results shortlisted and read, passages chosen, entities built, columns enriched."""

    queries: int = 4
    shortlist: int = 15
    reads: int = 15
    passages: int = 24
    entities: int = 10
    sparse_columns: int = 3
    breadth_results: int = 5
    rows: int = 10
    stem: Callable[[Column], Column] | None = None


def _one_for_each(rows: DataFrame, order: list, most: int) -> DataFrame:
    return rows.withColumn("n_", F.row_number().over(plan.per_request(*order))).where(F.col("n_") <= most).drop("n_")


def _shortlisted(found: DataFrame, tokens: DataFrame, totals: DataFrame, cap: int) -> DataFrame:
    """Raw results -> pruned, merged, scored, bucketed, cut by the buckets' floors and dealt to the shortlist."""
    merged = plan.cut(results.merge_by_url(results.prune(found, tokens)).withColumn("bucket", results.bucket_of(F.col("title"), F.col("url"))))
    # The floors go by the queries that found anything, the shortlist by those sent.
    strong = results.bucket_floor(results.shortlist_score(merged.join(results.queries_seen(merged), "request_id"), "total")).select("request_id", "url")
    rows = results.shortlist_score(merged.join(totals, "request_id"), "total")
    return rows.join(results.shortlist_by_bucket(rows.join(strong, ["request_id", "url"], "left_semi"), cap).select("request_id", "url", "position"), ["request_id", "url"])


def rule_fields(numbered: DataFrame, plans: DataFrame) -> DataFrame:
    """What rules read from evidence, in the form of a model's answers: the url of a page whose host is the entity's name,
    and for any other column what stands after "column:" or "column is"."""
    key = compact(F.col("entity"))
    own = F.when((key != "") & host_core(F.col("source_url")).contains(key), F.regexp_extract("source_url", "^[^:]+://[^/]+", 0))
    said = F.expr(r"""nullif(trim(regexp_extract(text, concat('(?i)\\b\\Q', replace(column, '_', ' '), '\\E(?:\\s*:|\\s+is)\\s+([^.;,\n]{1,80})'), 1)), '')""")
    df = numbered.join(plans.select("request_id", F.explode("schema_columns").alias("column")), "request_id").where("column <> 'name'")
    df = df.withColumn("value", F.when(F.col("column") == "website", own).otherwise(said)).where("value is not null")
    first = F.min_by(F.struct("value", "chunk_id"), "seq").alias("f")
    return df.groupBy("request_id", "entity", "column").agg(first).select("request_id", "entity", F.col("entity").alias("answered_name"), F.lit(False).alias("provisional"), "column", F.col("f.value").alias("value"), F.lit(0.7).alias("confidence"), F.array("f.chunk_id").alias("chunk_ids"))


def run(requests: DataFrame, pages: DataFrame, settings: Settings = Settings(), names: providers.Provider = providers.capitalised_names, fields: Callable[[DataFrame, DataFrame], DataFrame] = rule_fields) -> dict[str, DataFrame]:
    """Every relation of the requests' way, by name; `table` is the result.

    requests(request_id, query[, columns, aspects, rewrites]), pages(page_id, url, html). Blank queries stop at the plan.
    `names` and `fields` stand for the models that propose candidate names and read values; what they answer is checked
    here. Pages' texts, their words' postings, passages and what comes of them are written to the checkpoint folder once, as
    several branches read them.
    """
    s, texts = settings, plan.stored(stored.page_texts(pages))
    words = plan.stored(stored.page_words(texts))
    plans = plan.normalised(requests)
    fine = plans.where("not error").select("*")
    queries = plan.executed_queries(plans, s.queries)
    totals = queries.groupBy("request_id").agg(F.count("*").alias("total"))
    tokens = search.query_tokens(fine)
    shortlist = lambda found: _shortlisted(found, tokens, totals, s.shortlist)
    source = lambda asked: plan.cut(stored.results(texts, asked, words=words))
    found = plan.cut(search.search(queries, source, shortlist, budget=s.queries))
    chosen = plan.cut(shortlist(found))
    sources, chunks = stored.read_sources(search.within_budget(chosen, s.reads), texts)
    sources, chunks = plan.cut(sources), plan.cut(chunks)
    ranked = plan.cut(passages.rank_passages(chunks, fine, s.passages, s.stem).withColumn("selected", F.lit(True)))

    picked = chunks.join(ranked.select("request_id", "chunk_id", "rank"), ["request_id", "chunk_id"]).join(sources.select("request_id", "source_id", "url"), ["request_id", "source_id"])
    by_url = picked.groupBy("request_id", F.col("url").alias("source_id")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("chunk_id", "text"))), lambda x: x["text"]), "\n").alias("text"))
    proposed = providers.candidate_names(by_url, names)
    seen = plan.cut(evidence.mentions(proposed, by_url))
    urls = seen.select("request_id", "name", F.col("source_id").alias("url"))
    counted = seen.groupBy("request_id", "name").agg(F.sum("mentions").alias("mentions"), F.count("*").alias("sources"))
    kept = evidence.drop_subsets(counted.where(F.length("name").between(2, 80)).select("request_id", "name"), urls)
    candidates = plan.cut(evidence.keep_names(counted.join(kept, ["request_id", "name"], "left_semi")))
    urls = urls.join(candidates.select("request_id", "name"), ["request_id", "name"], "left_semi")

    known = candidates.groupBy("request_id").agg(F.sort_array(F.collect_list("name")).alias("candidates"))
    context = chunks.join(sources.select("request_id", "source_id", "url"), ["request_id", "source_id"]).groupBy("request_id", "url").agg(F.sum(F.length("text")).cast("int").alias("context_chars"))
    aspects = fine.select("request_id", plain_tokens(F.concat_ws(" ", "normalized_query", "base_query", F.array_join("core_aspects", " "))).alias("asked_"))
    rows = chosen.join(known, "request_id", "left").join(context, ["request_id", "url"], "left").join(aspects, "request_id")
    rows = rows.withColumn("candidates", F.coalesce("candidates", F.array().cast("array<string>"))).withColumn("context_chars", F.coalesce("context_chars", F.lit(0))).withColumn("fallback", F.col("context_chars") == 0)
    assessed = assess.assessed(assess.officiality(assess.quality(assess.signals(rows, F.col("asked_"))))).withColumn("aspect_coverage", F.array().cast("array<string>"))
    assessed = plan.cut(assessed.drop("asked_", "candidates"))

    stops = evidence.stop_entities(seen.join(candidates.select("request_id", "name"), ["request_id", "name"], "left_semi"), assessed.select("request_id", F.col("url").alias("source_id"), store.non_low().alias("non_low")))
    records = store.source_records(sources, chunks, ranked, assessed)
    store_rows = plan.cut(store.build(records, candidates.select("request_id", "name"), urls, stops))
    ranking = plan.cut(rank_entities(store_rows, fine, s.stem))
    first = _one_for_each(ranking.where("kept"), ["mmr_position"], s.entities)
    mine = store_rows.join(first.select("request_id", "entity"), ["request_id", "entity"], "left_semi")
    built = plan.cut(answers.extracted_fields(_answered(fields(answers.evidence_numbers(mine), fine), mine), mine, fine))
    merged, chosen_cells = _enriched(built, fine, texts, words, tokens, fields, s)

    order = first.select("request_id", "entity", F.col("mmr_position").cast("long").alias("entity_ord"))
    shown = merged.join(order, ["request_id", "entity"])
    back = shown.select("request_id", "entity", F.explode("evidence").alias("e")).select("request_id", "entity", F.col("e.source_url").alias("url"))
    final = tables.final_rows(shown, back).where(F.col("position") <= s.rows)
    return {
        "plans": plans, "queries": queries, "results": found, "shortlist": chosen, "sources": sources, "chunks": chunks, "ranked": ranked, "candidates": candidates,
        "assessed": assessed, "evidence": store_rows, "entities": ranking, "fields": merged, "cells": chosen_cells, "table": final,
    }


def rank_entities(rows: DataFrame, plans: DataFrame, stem=None) -> DataFrame:
    """All entities of the evidence with features, support, alignment, variants, position, kept, and mmr_position of kept ones.

    Near copies of a source's passages are left out before anything is counted."""
    marked = plan.cut(rows.withColumn("tokens", retrieval_tokens(F.col("text"), stem)))
    fresh = entities.drop_near_copies(marked.select("request_id", "entity", "source_url", "seq", "tokens"))
    rows = plan.cut(marked.join(fresh, ["request_id", "entity", "source_url", "seq"], "left_semi"))
    worth = F.when(F.col("officiality") == "low_quality", 0.0).when(F.col("source_quality") == "high", 1.0).when(F.col("source_quality") == "medium", 0.5).otherwise(0.0)
    totals, preferred = entities.variant_totals(plans), entities.preferred_variants(plans)
    each = entities.features(rows.select("request_id", "entity", "source_url", worth.alias("quality"), "query_sources", F.col("selected_chunk_rank").alias("chunk_rank")))
    df = entities.support(each.join(totals, "request_id"), F.col("total_variants")).join(entities.alignment(rows, plans, stem).select("request_id", "entity", "alignment"), ["request_id", "entity"])
    df = entities.final_ranking(df)
    used = rows.select("request_id", "entity", F.explode("query_sources").alias("variant"))
    df = df.join(entities.dominant_variant(used, preferred).select("request_id", "entity", F.col("variant").alias("dominant")), ["request_id", "entity"], "left")
    df = df.join(entities.supporting_variants(used, preferred), ["request_id", "entity"], "left").withColumn("supporting", F.coalesce("supporting", F.array().cast("array<string>")))
    diverse = entities.diversify(df.where("kept").select("request_id", "entity", "position", "final_score", "dominant", "supporting"))
    return df.join(diverse, ["request_id", "entity"], "left")


def _answered(said: DataFrame, mine: DataFrame) -> DataFrame:
    """Answers, and one without a value for every entity that the rules said nothing about: it was looked at."""
    looked = mine.select("request_id", "entity").distinct().select("request_id", "entity", F.col("entity").alias("answered_name"), F.lit(False).alias("provisional"), F.lit("name").alias("column"), F.lit(None).cast("string").alias("value"), F.lit(0.0).alias("confidence"), F.array().cast("array<string>").alias("chunk_ids"))
    return said.unionByName(looked)


def _enriched(built: DataFrame, plans: DataFrame, texts: DataFrame, words: DataFrame, tokens: DataFrame, fields: Callable, s: Settings) -> tuple[DataFrame, DataFrame]:
    """(fields, chosen chunks): sparse columns are searched for once more, and their empty cells filled where passages about
    the entity and the column hold a value."""
    everyone = built.select("request_id", "entity").distinct()
    columns = plans.select("request_id", F.posexplode("schema_columns").alias("column_ord", "column"))
    sparse = tables.fill_rates(built, columns.select("request_id", "column"), everyone).where("sparse").join(columns, ["request_id", "column"]).join(everyone.select("request_id").distinct(), "request_id", "left_semi")
    sparse = _one_for_each(sparse.select("request_id", "column", "column_ord"), ["column_ord"], s.sparse_columns)
    none = built.sparkSession.createDataFrame([], "request_id string, place int, column string, facet_terms array<string>")
    facets = answers.facets(sparse, none)
    asked = search.column_queries(facets, plans, s.sparse_columns).select("request_id", "place", "query", F.lit(s.breadth_results).alias("count"))
    totals = asked.groupBy("request_id").agg(F.count("*").alias("total"))
    merged = results.shortlist_score(results.merge_by_url(results.prune(stored.results(texts, asked, words=words), tokens)).join(totals, "request_id"), "total")
    sources, chunks = stored.read_sources(results.shortlist(merged, s.shortlist), texts)
    chunks = plan.cut(chunks)
    scored = cells.cell_scores(chunks, everyone, facets, plans, s.stem)
    chosen = plan.cut(tables.choose_chunks(scored))
    proof = plan.cut(cells.evidence_for_gaps(chosen, sources, chunks))
    numbered = proof.select("request_id", "entity", "chunk_id", F.col("url").alias("source_url"), "text", F.col("position").alias("seq")).distinct()
    updates = answers.gap_updates(fields(numbered, plans), built, proof)
    return plan.cut(answers.merged_fields(built, updates)), chosen


def run_figures(way: dict[str, DataFrame]) -> DataFrame:
    """The figures that a run's stages show."""
    names = {"plans": "plans", "queries": "queries", "results": "results", "shortlist": "shortlist", "sources": "sources", "chunks": "chunks", "ranked": "ranked", "candidates": "candidates", "assessed": "assessed", "evidence": "evidence", "entities": "entities", "fields": "fields", "rows": "table"}
    return report.figures(**{k: way[v] for k, v in names.items()})
