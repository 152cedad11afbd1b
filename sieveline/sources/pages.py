"""Stored pages and documents in place of the web connectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import host, strip_html

REQUESTS, QUERIES = 3, 3


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Deal a table of fewer partitions than cores (one small file) to all of them; larger ones stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def search_results(pages: DataFrame) -> DataFrame:
    """Pages as raw search results: every page answers one request and, by its number, one to three queries of it."""
    html = F.col("html")
    title = strip_html(F.regexp_extract(html, "<title>([^<]*)</title>", 1))
    body = strip_html(F.split_part(html, F.lit("</h1>"), F.lit(2)))
    k = F.floor(F.col("page_id") / REQUESTS)
    df = pages.select("page_id", F.concat(F.lit("r"), F.col("page_id") % REQUESTS).alias("request_id"), "url", title.alias("title"), F.substring(body, 1, 200).alias("snippet"), host(F.col("url")).alias("domain"), F.explode(F.filter(F.sequence(F.lit(0), F.lit(QUERIES - 1)), lambda q: k % (q + 1) == 0)).alias("q"))
    df = df.withColumn("query", F.concat(F.lit("q"), F.col("q"))).withColumn("ord", F.col("page_id") * QUERIES + F.col("q"))
    return df.withColumn("rank", F.row_number().over(Window.partitionBy("request_id", "query").orderBy("page_id"))).select("request_id", "ord", "url", "title", "snippet", "domain", "rank", "query")
