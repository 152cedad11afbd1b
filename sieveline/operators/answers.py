"""What is asked of a model, and what its answers are allowed to become: payloads, checks, fallbacks and defaults."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.text import collapse

#: Bounds of what is sent: chunks an entity, chunks a column of a gap, passages a source and their characters, terms a facet.
ENTITY_CHUNKS, GAP_CHUNKS, SOURCE_PASSAGES, PASSAGE_CHARS, FACET_TERMS = 12, 9, 3, 800, 4
_ITEM = "struct<source_url:string,source_title:string,supporting_snippet:string,source_role:string,source_quality:string,officiality:string>"


def _numbered(rows: DataFrame, keys: list[str], order: list, most: int) -> DataFrame:
    return rows.withColumn("n_", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("n_") <= most)


def _listed(*fields: Column) -> Column:
    """Structs of the fields in order of n_, without n_."""
    return F.transform(F.sort_array(F.collect_list(F.struct("n_", F.struct(*fields).alias("s")))), lambda x: x["s"])


# ---- buckets of sources

def bucket_payloads(results: DataFrame, plans: DataFrame) -> DataFrame:
    """(request_id, payload): the plan's queries and all results of a request, by rank."""
    rows = results.withColumn("n_", F.struct("rank", "url"))
    sources = rows.groupBy("request_id").agg(_listed(F.col("url"), F.col("title"), F.col("snippet"), F.col("query_sources"), F.col("rank")).alias("sources"))
    df = plans.join(sources, "request_id")
    return df.select("request_id", F.to_json(F.struct("normalized_query", "base_query", F.col("rewrites").alias("query_rewrites"), "sources")).alias("payload"))


def bucket_decisions(answers: DataFrame) -> DataFrame:
    """answers(request_id, place, url, bucket) -> (request_id, url, bucket): urls trimmed, blank ones dropped, the last of
    several for one url, buckets nobody knows are editorial_reference."""
    known = F.when(F.trim("bucket").isin(fixed.BUCKETS), F.trim("bucket")).otherwise("editorial_reference")
    rows = answers.select("request_id", "place", F.trim("url").alias("url"), known.alias("bucket")).where("url <> ''")
    return rows.groupBy("request_id", "url").agg(F.max_by("bucket", "place").alias("bucket"))


def with_buckets(results: DataFrame, decisions: DataFrame) -> DataFrame:
    """Results with their bucket; null, and otherwise unchanged, where there is no decision."""
    return results.join(decisions.select("request_id", "url", "bucket"), ["request_id", "url"], "left")


# ---- sources that a model assesses

def assessor_payloads(assessed: DataFrame, chunks: DataFrame, plans: DataFrame) -> DataFrame:
    """(request_id, url, payload) of sources that rules have not filtered out, with up to three passages of 800 characters.

    chunks(request_id, url, sequence_index, text): the first three are taken, and blank ones among them left out."""
    first = _numbered(chunks, ["request_id", "url"], ["sequence_index"], SOURCE_PASSAGES).where("trim(text) <> ''")
    passages = first.groupBy("request_id", "url").agg(F.transform(_listed(F.substring("text", 1, PASSAGE_CHARS).alias("t")), lambda s: s["t"]).alias("passages"))
    df = assessed.where("not filtered_out").join(passages, ["request_id", "url"], "left").join(plans.select("request_id", "normalized_query", "schema_columns", "core_aspects"), "request_id")
    source = F.struct(F.col("url").alias("source_url"), "title", "snippet", "domain", "rank", "query_sources", F.struct("relevance_hint", "official_path_hint", "snippet_thinness_hint").alias("heuristics"), F.col("source_quality").alias("heuristic_quality"), F.col("quality_confidence").alias("heuristic_quality_confidence"), F.coalesce("officiality", F.lit("ambiguous")).alias("heuristic_officiality"), F.col("officiality_confidence").alias("heuristic_officiality_confidence"), F.coalesce("passages", F.array().cast("array<string>")).alias("passages"))
    return df.select("request_id", "url", F.to_json(F.struct("normalized_query", "schema_columns", "core_aspects", F.array(source).alias("sources"))).alias("payload"))


def overridden(assessed: DataFrame, decisions: DataFrame) -> DataFrame:
    """Assessed sources with what a model decided about them in place of the rules' verdict; filtered ones stay as they are.

    decisions(request_id, url, role, quality, official, aspects): null parts keep the rules' value."""
    df = assessed.join(decisions, ["request_id", "url"], "left")
    own = lambda new, old: F.when(~F.col("filtered_out") & F.col(new).isNotNull(), F.col(new)).otherwise(F.col(old)).alias(old)
    changed = {"source_role": "role", "source_quality": "quality", "officiality": "official", "aspect_coverage": "aspects"}
    return df.select(*[own(changed[c], c) if c in changed else F.col(c) for c in assessed.columns])


# ---- fields of entities

def evidence_numbers(evidence: DataFrame, most: int = ENTITY_CHUNKS) -> DataFrame:
    """evidence with chunk_id c1, c2, ... of each entity's first `most` rows by seq."""
    return _numbered(evidence, ["request_id", "entity"], ["seq"], most).withColumn("chunk_id", F.concat(F.lit("c"), F.col("n_")))


def extractor_payloads(evidence: DataFrame, plans: DataFrame) -> DataFrame:
    """(request_id, entity, payload): the plan and the numbered evidence of each entity."""
    rows = evidence_numbers(evidence)
    chunks = rows.groupBy("request_id", "entity").agg(_listed(*[F.col(c) for c in ("chunk_id", "source_url", "source_title", "source_role", "source_quality", "officiality", "aspect_coverage", "text")]).alias("evidence_chunks"))
    df = chunks.join(plans.select("request_id", "normalized_query", "schema_columns", "core_aspects"), "request_id")
    return df.select("request_id", "entity", F.to_json(F.struct("normalized_query", "schema_columns", "core_aspects", F.col("entity").alias("entity_anchor"), "evidence_chunks")).alias("payload"))


def name_payloads(chunks: DataFrame, plans: DataFrame) -> DataFrame:
    """(request_id, payload): a request's chunks in order as lines "[cN] text"."""
    rows = _numbered(chunks.where("trim(text) <> ''"), ["request_id"], ["rank"], 1 << 30)
    lines = rows.groupBy("request_id").agg(F.array_join(F.transform(_listed(F.concat(F.lit("[c"), F.col("n_"), F.lit("] "), F.trim("text")).alias("t")), lambda s: s["t"]), "\n").alias("text"))
    return lines.join(plans.select("request_id", "normalized_query"), "request_id").select("request_id", F.to_json(F.struct("normalized_query", "text")).alias("payload"))


def evidence_items(full: bool = True) -> Column:
    """The provenance of a value; evidence found for a gap has the default role, quality and officiality."""
    own = [F.col("source_role"), F.col("source_quality"), F.col("officiality")] if full else [F.lit(v).alias(k) for k, v in (("source_role", "discovery"), ("source_quality", "medium"), ("officiality", "third_party"))]
    return F.struct(F.col("source_url"), F.col("source_title"), F.col("text").alias("supporting_snippet"), *own)


def _resolved(decisions: DataFrame, numbered: DataFrame, full: bool) -> DataFrame:
    """decisions(..., place, chunk_ids) with evidence, the items of those ids that exist, in the order named."""
    ids = decisions.select("request_id", "entity", "column", F.posexplode("chunk_ids").alias("at_", "chunk_id"))
    got = ids.join(numbered.select("request_id", "entity", "chunk_id", evidence_items(full).alias("item_")), ["request_id", "entity", "chunk_id"])
    got = got.groupBy("request_id", "entity", "column").agg(F.transform(F.sort_array(F.collect_list(F.struct("at_", "item_"))), lambda x: x["item_"]).alias("evidence"))
    return decisions.join(got, ["request_id", "entity", "column"], "left")


def _last(answers: DataFrame) -> DataFrame:
    """Of the answers for one column the last by `place`; where that is missing or the same, the greatest by its parts, so that
    reruns agree."""
    place = F.col("place") if "place" in answers.columns else F.lit(0)
    parts = F.struct("value", "confidence", "chunk_ids")
    last = answers.groupBy("request_id", "entity", "column").agg(F.max(F.struct(place.alias("p_"), parts.alias("a_"))).alias("l_"))
    return last.select("request_id", "entity", "column", "l_.a_.*")


def extracted_fields(answers: DataFrame, evidence: DataFrame, plans: DataFrame) -> DataFrame:
    """(request_id, entity, column, column_ord, value, confidence, evidence, provisional): every planned column of every
    entity with evidence.

    answers(request_id, entity, answered_name, provisional, column, value, confidence, chunk_ids[, place]): of several for a column
    the last by place counts, with a value or without. An answer under another name counts for nothing and leaves an empty, provisional entity; so does none. Columns that were not planned are
    dropped; a value without evidence that exists is null. A missing name is the entity's, from its first chunk, certain,
    if the entity was answered for.
    """
    numbered = evidence_numbers(evidence)
    cells = numbered.select("request_id", "entity").distinct().join(plans.select("request_id", F.posexplode("schema_columns").alias("column_ord", "column")), "request_id")
    fine = answers.where(F.trim("answered_name") == F.col("entity"))
    said = fine.groupBy("request_id", "entity").agg(F.bool_or("provisional").alias("provisional"))
    given = _resolved(_last(fine).where("value is not null"), numbered, full=True).where("evidence is not null")
    first = numbered.where("chunk_id = 'c1'").select("request_id", "entity", F.array(evidence_items()).alias("first_"))
    df = cells.join(said, ["request_id", "entity"], "left").join(given.drop("chunk_ids"), ["request_id", "entity", "column"], "left").join(first, ["request_id", "entity"], "left")
    own = (F.col("column") == "name") & F.col("value").isNull() & F.col("provisional").isNotNull()
    return df.select("request_id", "entity", "column", "column_ord", F.when(own, F.col("entity")).otherwise(F.col("value")).alias("value"), F.when(own, 1.0).otherwise(F.coalesce("confidence", F.lit(0.0))).alias("confidence"), F.coalesce(F.when(own, F.col("first_")).otherwise(F.col("evidence")), F.expr(f"cast(array() as array<{_ITEM}>)")).alias("evidence"), F.coalesce("provisional", F.lit(True)).alias("provisional"))


def with_prior(names: DataFrame, evidence: DataFrame, extracted: DataFrame, prior: DataFrame | None, plans: DataFrame) -> DataFrame:
    """Fields of the ranked names(request_id, entity): extracted ones where there is evidence; else those of an earlier pass; else
    empty, provisional ones. extracted and prior as extracted_fields() gives them."""
    proven = evidence.select("request_id", "entity").distinct()
    out = extracted.join(names.select("request_id", "entity"), ["request_id", "entity"], "left_semi")
    rest = names.select("request_id", "entity").join(proven, ["request_id", "entity"], "left_anti")
    if prior is not None:
        out = out.unionByName(prior.join(rest, ["request_id", "entity"], "left_semi").select(*out.columns))
        rest = rest.join(prior.select("request_id", "entity").distinct(), ["request_id", "entity"], "left_anti")
    cells = rest.join(plans.select("request_id", F.posexplode("schema_columns").alias("column_ord", "column")), "request_id")
    return out.unionByName(cells.select("request_id", "entity", "column", "column_ord", F.lit(None).cast("string").alias("value"), F.lit(0.0).alias("confidence"), F.expr(f"cast(array() as array<{_ITEM}>)").alias("evidence"), F.lit(True).alias("provisional")))


def canonical(fields: DataFrame) -> DataFrame:
    """(request_id, name, fields, source_urls): one row an entity, its fields a map of column to value, confidence and evidence."""
    one = F.struct("column", F.struct("value", "confidence", "evidence").alias("f"))
    rows = fields.groupBy("request_id", "entity").agg(F.map_from_entries(F.collect_list(one)).alias("fields"))
    return rows.join(source_urls(fields), ["request_id", "entity"]).select("request_id", F.col("entity").alias("name"), "fields", "source_urls")


def source_urls(fields: DataFrame) -> DataFrame:
    """(request_id, entity, source_urls): distinct urls of an entity's evidence, by column, then by evidence."""
    urls = F.transform("evidence", lambda e: e["source_url"])
    one = F.sort_array(F.collect_list(F.struct("column_ord", urls.alias("u"))))
    return fields.groupBy("request_id", "entity").agg(F.array_distinct(F.flatten(F.transform(one, lambda x: x["u"]))).alias("source_urls"))


# ---- facets of sparse columns and gaps

def facet_payloads(sparse: DataFrame, plans: DataFrame) -> DataFrame:
    """(request_id, payload): the queries and a request's sparse columns in order. sparse(request_id, column, column_ord)."""
    cols = sparse.groupBy("request_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("column_ord", "column"))), lambda x: x["column"]).alias("sparse_columns"))
    return cols.join(plans, "request_id").select("request_id", F.to_json(F.struct("normalized_query", "base_query", "sparse_columns")).alias("payload"))


def facets(sparse: DataFrame, answers: DataFrame) -> DataFrame:
    """(request_id, column, column_ord, facet_terms): for every sparse column up to four distinct terms, or its own name.

    answers(request_id, place, column, facet_terms); of several for a column the last with terms counts."""
    given = answers.where("size(facet_terms) > 0").groupBy("request_id", "column").agg(F.max_by("facet_terms", "place").alias("given"))
    clean = F.filter(F.transform(F.coalesce("given", F.array().cast("array<string>")), collapse), lambda t: t != "")
    first = F.filter(clean, lambda t, i: F.array_position(F.transform(clean, F.lower), F.lower(t)) == i + 1)
    own = F.array(F.replace("column", F.lit("_"), F.lit(" ")))
    df = sparse.join(given, ["request_id", "column"], "left")
    return df.select("request_id", "column", "column_ord", F.when(F.size(first) > 0, F.slice(first, 1, FACET_TERMS)).otherwise(own).alias("facet_terms"))


def missing_cells(fields: DataFrame) -> DataFrame:
    """(request_id, entity, column, column_ord) without a value."""
    return fields.where("value is null").select("request_id", "entity", "column", "column_ord")


def gap_payloads(fields: DataFrame, evidence: DataFrame, plans: DataFrame) -> DataFrame:
    """(request_id, entity, payload) of entities with a missing column and evidence for any: up to nine chunks a column.

    evidence(request_id, entity, column, chunk_id, url, title, text, position)."""
    missing = missing_cells(fields).groupBy("request_id", "entity").agg(F.transform(F.sort_array(F.collect_list(F.struct("column_ord", "column"))), lambda x: x["column"]).alias("missing_columns"))
    have = fields.where("value is not null").groupBy("request_id", "entity").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("column", "value")))).alias("existing_fields"))
    rows = evidence.where(F.col("position") <= GAP_CHUNKS).join(missing_cells(fields), ["request_id", "entity", "column"]).withColumn("n_", F.struct("column_ord", "position"))
    chunks = rows.groupBy("request_id", "entity").agg(_listed(F.col("chunk_id"), F.col("column"), F.col("url").alias("source_url"), F.col("title").alias("source_title"), F.col("text")).alias("evidence_chunks"))
    df = missing.join(evidence.select("request_id", "entity").distinct(), ["request_id", "entity"], "left_semi").join(have, ["request_id", "entity"], "left").join(chunks, ["request_id", "entity"], "left").join(plans.select("request_id", "normalized_query"), "request_id")
    return df.select("request_id", "entity", F.to_json(F.struct("normalized_query", F.col("entity").alias("entity_name"), "existing_fields", "missing_columns", "evidence_chunks")).alias("payload"))


def gap_updates(answers: DataFrame, fields: DataFrame, evidence: DataFrame) -> DataFrame:
    """(request_id, entity, column, value, confidence, evidence): answers for missing columns, under the entity's own name,
    with a value and evidence that was sent. answers as in extracted_fields(); of several for a column the last such one counts."""
    fine = answers.where((F.trim("answered_name") == F.col("entity")) & F.col("value").isNotNull()).join(missing_cells(fields).select("request_id", "entity", "column"), ["request_id", "entity", "column"], "left_semi")
    item = F.struct(F.col("url").alias("source_url"), F.col("title").alias("source_title"), "text")
    sent = evidence.groupBy("request_id", "entity", "chunk_id").agg(F.min(item).alias("i_")).select("request_id", "entity", "chunk_id", "i_.*")
    # Only answers with some evidence that was sent take part in which is the last.
    ids = sent.groupBy("request_id", "entity").agg(F.collect_set("chunk_id").alias("ids_"))
    fine = fine.join(ids, ["request_id", "entity"]).where(F.arrays_overlap("chunk_ids", "ids_"))
    return _resolved(_last(fine), sent, full=False).where("evidence is not null").drop("chunk_ids")


def merged_fields(fields: DataFrame, updates: DataFrame) -> DataFrame:
    """fields with updates in cells without a value; a cell that was not planned is added after the planned ones."""
    new = updates.select("request_id", "entity", "column", F.col("value").alias("v_"), F.col("confidence").alias("c_"), F.col("evidence").alias("e_"))
    df = fields.join(new, ["request_id", "entity", "column"], "full")
    take = F.col("value").isNull() & F.col("v_").isNotNull()
    pick = lambda old, new: F.when(take, F.col(new)).otherwise(F.col(old)).alias(old)
    return df.select("request_id", "entity", "column", F.coalesce("column_ord", F.lit(1 << 30)).alias("column_ord"), pick("value", "v_"), pick("confidence", "c_"), pick("evidence", "e_"), F.coalesce("provisional", F.lit(False)).alias("provisional"))
