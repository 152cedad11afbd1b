"""The result table: sparse columns, filling gaps, pruning and ordering rows, presentation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def fill_rates(fields: DataFrame, columns: DataFrame, entities: DataFrame, least: float = 0.60) -> DataFrame:
    """(request_id, column, fill_rate, sparse) of every planned column; without entities all are sparse at 0.

    fields(request_id, entity, column, value), columns(request_id, column), entities(request_id, entity)."""
    n = entities.groupBy("request_id").agg(F.count_distinct("entity").alias("n"))
    got = fields.where("value is not null").groupBy("request_id", "column").agg(F.count_distinct("entity").alias("got"))
    rate = F.round(F.coalesce(F.col("got") / F.col("n"), F.lit(0.0)), 6)
    df = columns.join(n, "request_id", "left").join(got, ["request_id", "column"], "left").select("request_id", "column", rate.alias("fill_rate"))
    return df.withColumn("sparse", F.col("fill_rate") < least)


def merge_gaps(fields: DataFrame, updates: DataFrame) -> DataFrame:
    """Existing values win; null ones take the update's; new columns are added."""
    return fields.join(updates.withColumnRenamed("value", "new_"), ["request_id", "entity", "column"], "full").select("request_id", "entity", "column", F.coalesce("value", "new_").alias("value"))


def final_rows(fields: DataFrame, urls: DataFrame) -> DataFrame:
    """(request_id, entity, position, non_name, all_fields, urls): rows with a name and another value, richest first.

    fields(request_id, entity, entity_ord, column, value), urls(request_id, entity, url)."""
    rows = fields.groupBy("request_id", "entity").agg(F.min("entity_ord").alias("ord"), F.count_if((F.col("column") != "name") & F.col("value").isNotNull()).alias("non_name"), F.count("value").alias("all_fields"), F.max((F.col("column") == "name") & F.col("value").isNotNull()).alias("named"))
    n = urls.groupBy("request_id", "entity").agg(F.count_distinct("url").alias("urls"))
    rows = rows.where("named and non_name > 0").join(n, ["request_id", "entity"], "left").withColumn("urls", F.coalesce("urls", F.lit(0)))
    order = Window.partitionBy("request_id").orderBy(F.desc("non_name"), F.desc("all_fields"), F.desc("urls"), "ord")
    return rows.withColumn("position", F.row_number().over(order)).select("request_id", "entity", "position", "non_name", "all_fields", "urls")


def visible_columns(fields: DataFrame, least: float = 0.3) -> DataFrame:
    """Columns shown: all below three rows; else name and those filled in more than `least` of the rows."""
    n = fields.groupBy("request_id").agg(F.count_distinct("entity").alias("n"))
    df = fields.groupBy("request_id", "column").agg(F.count("value").alias("got")).join(n, "request_id")
    return df.where((F.col("n") < 3) | (F.col("column") == "name") | (F.col("got") / F.col("n") > least)).select("request_id", "column")


def choose_chunks(scored: DataFrame, k: int = 3) -> DataFrame:
    """(request_id, entity, column, source_id, chunk_id, score, position): the k best chunks of each cell with a score.

    A chunk of a new source would be taken before one of a used source that scores under 0.9 of it; as chunks come by falling
    score, none ever does, so the choice is the order by score and chunk_id.
    """
    place = F.row_number().over(Window.partitionBy("request_id", "entity", "column").orderBy(F.desc("score"), "chunk_id"))
    return scored.where("score > 0").withColumn("position", place).where(F.col("position") <= k).select("request_id", "entity", "column", "source_id", "chunk_id", "score", "position")
