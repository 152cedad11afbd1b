"""Stored answers of search, context and reader services as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import host, page_title

_SEARCH = "struct<web:struct<results:array<struct<url:string,title:string,description:string,profile:struct<long_name:string>>>>>"
_CONTEXT_ITEM = "struct<url:string,title:string,snippets:array<string>>"
_CONTEXT = f"struct<grounding:struct<generic:array<{_CONTEXT_ITEM}>,poi:{_CONTEXT_ITEM},map:array<{_CONTEXT_ITEM}>>,sources:map<string,struct<title:string,age:array<string>>>>"


def search_payloads(raw: DataFrame) -> DataFrame:
    """raw(request_id, query, payload) -> results. The rank is the place in the answer, counted before rows without URL go."""
    df = raw.select("request_id", "query", F.posexplode(F.from_json("payload", _SEARCH)["web"]["results"]).alias("pos", "r")).where("coalesce(r.url, '') <> ''")
    return df.select("request_id", "query", F.col("r.url").alias("url"), F.coalesce("r.title", F.lit("")).alias("title"), F.coalesce("r.description", F.lit("")).alias("snippet"), F.coalesce("r.profile.long_name", host(F.col("r.url"))).alias("domain"), (F.col("pos") + 1).alias("rank"))


def context_payloads(raw: DataFrame) -> DataFrame:
    """raw(request_id, payload) -> passages: generic, then place, then map items; items without URL or snippets go; titles
    and ages come from the sources where the item has none."""
    p = raw.select("request_id", F.from_json("payload", _CONTEXT).alias("p"))
    empty = F.array().cast(f"array<{_CONTEXT_ITEM}>")
    items = F.concat(F.coalesce("p.grounding.generic", empty), F.when(F.col("p.grounding.poi").isNotNull(), F.array("p.grounding.poi")).otherwise(empty), F.coalesce("p.grounding.map", empty))
    df = p.select("request_id", "p", F.posexplode(items).alias("pos", "i")).where("coalesce(i.url, '') <> ''").withColumn("s", F.filter(F.coalesce("i.snippets", F.array().cast("array<string>")), lambda x: F.trim(x) != "")).where("size(s) > 0")
    source = F.try_element_at("p.sources", F.col("i.url"))
    ages = F.filter(source["age"], lambda a: F.trim(a) != "")
    return df.select("request_id", "pos", F.col("i.url").alias("url"), F.coalesce(F.nullif("i.title", F.lit("")), source["title"]).alias("title"), F.try_element_at(ages, F.lit(1)).alias("age"), F.array_join("s", "\n").alias("text"))


def reader_pages(raw: DataFrame) -> DataFrame:
    """raw(url, text, error) -> documents with a title and whether they could be read."""
    ok = F.col("error").isNull() & (F.trim(F.coalesce("text", F.lit(""))) != "")
    return raw.select("url", page_title(F.col("text"), F.col("url")).alias("title"), F.when(ok, F.col("text")).alias("text"), ok.alias("fetch_succeeded"), F.col("error").alias("error_message"))


def with_context(results: DataFrame, passages: DataFrame, limit: int = 1200) -> DataFrame:
    """Each result with its own passages, or its snippet (fallback) where it has none; passages of other URLs do not count."""
    from ..functions.text import clean_passage, truncate_passage

    p = passages.select("request_id", "url", "pos", truncate_passage(clean_passage(F.col("text")), limit).alias("text")).where("text <> ''")
    df = results.join(p, ["request_id", "url"], "left")
    return df.select("request_id", "url", F.coalesce("pos", F.lit(0)).alias("sequence_index"), F.coalesce("text", "snippet").alias("text"), F.col("text").isNull().alias("fallback"))
