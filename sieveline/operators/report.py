"""What a run shows and logs: stage figures, summaries, the displayed table and its export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.text import capitalised, column_label, column_type, display_domain, event_column_type, shown_value, source_type, title_label
from .store import non_low

_BUCKETS = {"officialSources": "official_entity", "profileSources": "profile_directory", "roundupSources": "roundup_list", "editorialReferenceSources": "editorial_reference", "transactionalSources": "transactional_listing"}


def figures(**tables: DataFrame) -> DataFrame:
    """(request_id, stage, key, label, value) of the tables given: one aggregation a table, unpivoted.

    Tables by name: plans, queries, results, shortlist(bucket), sources, chunks(text), ranked(source_id, selected),
    candidates(mentions), assessed, evidence, entities(candidate_type, kept), fields(entity, value), rows.
    """
    count = lambda cond: F.count_if(cond)
    kind = lambda c, kept: count((F.col("candidate_type") == c) & (F.col("kept") == kept))
    wanted = {
        "plans": {"columnsSelected": F.max(F.size("schema_columns")) if "plans" in tables else None},
        "queries": {"queriesRun": F.count("*")},
        "results": {"sourcesFound": F.count("*")},
        "shortlist": {"shortlisted": F.count("*"), **{k: count(F.col("bucket") == b) for k, b in _BUCKETS.items()}},
        "sources": {"sourcesProcessed": F.count("*")},
        "chunks": {"relevantDetailsFound": count(F.trim("text") != "")},
        "ranked": {"passagesScored": F.count("*"), "passagesSelected": count(F.col("selected")), "sourcesRepresented": F.count_distinct(F.when(F.col("selected"), F.col("source_id")))},
        "candidates": {"preliminaryCandidates": F.count("*"), "mentionsFound": F.sum("mentions")},
        "assessed": {"sourcesReviewed": F.count("*"), "filteredOut": count(F.col("filtered_out")), "usedForEvidence": count(non_low())},
        "evidence": {"candidatesWithEvidence": F.count_distinct("entity"), "supportingSourcesLinked": F.count_distinct("source_url")},
        "entities": {"coreCandidatesKept": kind("core", True), "discoveryCandidatesKept": kind("discovery", True), "coreCandidatesFiltered": kind("core", False), "discoveryCandidatesFiltered": kind("discovery", False)},
        "fields": {"profilesBuilt": F.count_distinct("entity"), "missingFields": count(F.col("value").isNull())},
        "rows": {"rowsReady": F.count("*")},
    }
    place = {key: (stage, label) for stage, key, label in fixed.METRICS}
    out = None
    for name, df in tables.items():
        keys = wanted[name]
        one = df.groupBy("request_id").agg(*[F.coalesce(v, F.lit(0)).cast("long").alias(k) for k, v in keys.items()])
        rows = F.array(*[F.struct(F.lit(place[k][0]).alias("stage"), F.lit(k).alias("key"), F.lit(place[k][1]).alias("label"), F.col(k).alias("value")) for k in keys])
        one = one.select("request_id", F.explode(rows).alias("m")).select("request_id", "m.*")
        out = one if out is None else out.unionByName(one)
    return out


def top_candidates(candidates: DataFrame, most: int = 10) -> DataFrame:
    """(request_id, position, name, mentions): the most mentioned candidates, ties by name."""
    place = F.row_number().over(Window.partitionBy("request_id").orderBy(F.desc("mentions"), F.lower("name"), "name"))
    return candidates.withColumn("position", place).where(F.col("position") <= most).select("request_id", "position", "name", "mentions")


def selected_sources(ranked: DataFrame, sources: DataFrame) -> DataFrame:
    """(request_id, position, url): distinct urls of selected chunks, in order of their best rank."""
    df = ranked.where("selected").join(sources.select("request_id", "source_id", "url"), ["request_id", "source_id"]).groupBy("request_id", "url").agg(F.min("rank").alias("rank"))
    return df.select("request_id", F.row_number().over(Window.partitionBy("request_id").orderBy("rank", "url")).alias("position"), "url")


def populated_columns(fields: DataFrame) -> DataFrame:
    """(request_id, columns): names of columns with any value, sorted."""
    return fields.where("value is not null").groupBy("request_id").agg(F.sort_array(F.collect_set("column")).alias("columns"))


def entity_log(ranking: DataFrame) -> DataFrame:
    """Every ranked entity as it is logged: kept ones first, scores to four places."""
    place = F.row_number().over(Window.partitionBy("request_id").orderBy(F.desc("kept"), "position"))
    return ranking.select("request_id", place.alias("n"), F.col("entity").alias("name"), F.when(F.col("kept"), "yes").otherwise("no").alias("kept"), "candidate_type", *[F.round(c, 4).alias(c) for c in ("final_score", "support_score", "alignment")])


def cell_log(chosen: DataFrame, sources: DataFrame) -> DataFrame:
    """Chosen chunks as they are logged: source url and title, blank where the source is unknown, and no text."""
    df = chosen.join(sources.select("request_id", "source_id", "url", "title"), ["request_id", "source_id"], "left")
    return df.select("request_id", "entity", "column", "position", F.round("score", 4).alias("score"), F.coalesce("url", F.lit("")).alias("source_url"), F.coalesce("title", F.lit("")).alias("source_title"))


def shown_cells(fields: DataFrame, visible: DataFrame) -> DataFrame:
    """(request_id, entity, column, label, type, text, confidence) of visible columns; values as text, capitalised."""
    df = fields.join(visible, ["request_id", "column"], "left_semi")
    return df.select("request_id", "entity", "column", column_label(F.col("column")).alias("label"), column_type(F.col("column")).alias("type"), capitalised(shown_value(F.col("value"))).alias("text"), "confidence")


def overall_confidence(fields: DataFrame, visible: DataFrame) -> DataFrame:
    """(request_id, confidence, percent): mean confidence of the visible cells with a value; 0 where there are none."""
    df = visible.join(fields, ["request_id", "column"], "left").groupBy("request_id").agg(F.coalesce(F.round(F.avg(F.when(F.col("value").isNotNull(), F.col("confidence"))), 6), F.lit(0.0)).alias("confidence"))
    return df.withColumn("percent", percent(F.col("confidence")))


def percent(confidence: Column) -> Column:
    return F.floor(confidence * 100 + 0.5).cast("int")


def shown_sources(items: DataFrame) -> DataFrame:
    """items(request_id, entity_ord, column_ord, evidence_ord, url, title, officiality) -> (request_id, position, url, domain,
    title, type): each url once, by its first place in the table."""
    key = F.struct("entity_ord", "column_ord", "evidence_ord")
    one = items.groupBy("request_id", "url").agg(F.min_by(F.struct("title", "officiality"), key).alias("f"), F.min(key).alias("at"))
    place = F.row_number().over(Window.partitionBy("request_id").orderBy("at", "url"))
    return one.select("request_id", place.alias("position"), "url", display_domain(F.col("url")).alias("domain"), F.col("f.title").alias("title"), source_type(F.col("f.officiality"), supporting=True).alias("type"))


def few_rows(rows: DataFrame, least: int = 3) -> DataFrame:
    """(request_id, rows, notice): whether a notice says that there are few rows."""
    return rows.groupBy("request_id").agg(F.count("*").alias("rows")).withColumn("notice", F.col("rows") < least)


def export(cells: DataFrame, names: DataFrame) -> DataFrame:
    """(request_id, json): the table as one JSON object a request: its columns, and its rows with value, confidence and urls.

    cells(request_id, entity, column, column_ord, value, confidence, source_urls), names(request_id, entity, position, name).
    A request's table holds some dozens of rows.
    """
    col = F.struct("column_ord", F.struct(F.col("column").alias("key"), column_label(F.col("column")).alias("label"), column_type(F.col("column")).alias("type")).alias("c"))
    columns = cells.groupBy("request_id").agg(F.transform(F.array_sort(F.collect_set(col)), lambda x: x["c"]).alias("columns"))
    field = F.struct("column_ord", "column", F.struct(F.col("value"), F.col("confidence"), F.col("source_urls")).alias("f"))
    fields = cells.groupBy("request_id", "entity").agg(F.map_from_entries(F.transform(F.sort_array(F.collect_list(field)), lambda x: F.struct(x["column"], x["f"]))).alias("fields"))
    rows = names.join(fields, ["request_id", "entity"]).groupBy("request_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("position", F.struct("name", "fields").alias("r"))), lambda a, b: F.signum(a["position"] - b["position"]).cast("int")), lambda x: x["r"]).alias("rows"))
    whole = F.struct(F.struct("columns").alias("inferred_schema"), F.col("rows").alias("final_top_10_rows"))
    return columns.join(rows, "request_id").select("request_id", F.to_json(whole, {"ignoreNullFields": "false"}).alias("json"))


def schema_preview(plans: DataFrame) -> DataFrame:
    """(request_id, place, key, label, type) of the planned columns, as the planner's event shows them."""
    df = plans.select("request_id", F.posexplode("schema_columns").alias("place", "key"))
    return df.select("request_id", "place", "key", title_label(F.col("key")).alias("label"), event_column_type(F.col("key")).alias("type"))


def loading_preview(plans: DataFrame) -> DataFrame:
    """(request_id, json): the export's form with one row of dots, while a run goes on."""
    column = lambda c: F.struct(c.alias("key"), column_label(c).alias("label"), column_type(c).alias("type"))
    dots = F.struct(F.lit("...").alias("value"), F.lit(0).alias("confidence"), F.array().cast("array<string>").alias("source_urls"))
    row = F.struct(F.lit("...").alias("name"), F.map_from_entries(F.transform("schema_columns", lambda c: F.struct(c.alias("k"), dots.alias("v")))).alias("fields"))
    whole = F.struct(F.struct(F.transform("schema_columns", column).alias("columns")).alias("inferred_schema"), F.array(row).alias("final_top_10_rows"))
    return plans.select("request_id", F.to_json(whole).alias("json"))


def table_rows(fields: DataFrame, names: DataFrame, visible: DataFrame) -> DataFrame:
    """(request_id, id, name, cells): the table's rows as a client holds them: a map of column to shown text and confidence;
    a column without a field is empty, and a missing name is the entity's, certain. names(request_id, entity, position)."""
    every = names.join(visible, "request_id").join(fields.select("request_id", "entity", "column", "value", "confidence"), ["request_id", "entity", "column"], "left")
    own = (F.col("column") == "name") & F.col("confidence").isNull()
    cell = F.struct("column", F.struct(shown_value(F.when(own, F.col("entity")).otherwise(F.col("value"))).alias("text"), F.when(own, 1.0).otherwise(F.coalesce("confidence", F.lit(0.0))).alias("confidence")).alias("c"))
    rows = every.groupBy("request_id", "entity", "position").agg(F.map_from_entries(F.collect_list(cell)).alias("cells"))
    return rows.select("request_id", F.col("position").cast("string").alias("id"), F.col("entity").alias("name"), "cells")


def badges(officiality: Column, quality: Column) -> Column:
    """What a piece of evidence is labelled with: its kind of source and its quality."""
    kind = source_type(officiality)
    return F.struct(F.concat(F.upper(F.substring(kind, 1, 1)), F.substring(kind, 2, 20)).alias("source"), F.concat(F.initcap(quality), F.lit(" quality")).alias("quality"))
