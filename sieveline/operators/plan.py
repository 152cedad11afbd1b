"""Query plans: normalising what a planner model proposes, with fixed fallbacks where there is none."""

from __future__ import annotations

import tempfile
import uuid
from math import ceil

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.fixed import EMPTY_QUERY, NO_TOPIC
from ..functions.text import collapse

FALLBACK_COLUMNS = ["name", "website", "location", "category"]
#: How many rows of an aggregation that hardly shrinks them a task holds.
ROWS_A_TASK = 500_000


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Only a session on one machine gets a folder of our own."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and (not sc.master.startswith("local") or sc.master.startswith("local-cluster")):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="sieveline-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Write a relation that several branches read to checkpoint_dir(), and cut its lineage there."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """The same as cut() for wide rows of columns that repeat themselves: written as Parquet, so that each branch reads its own
    columns only."""
    path = f"{checkpoint_dir(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(written: DataFrame, most: int = 20_000) -> DataFrame:
    """A written relation, marked to be sent to every task if it has no more than so many rows; else as it is."""
    return F.broadcast(written) if written.limit(most + 1).count() <= most else written


def tasks_for(rows: DataFrame) -> int:
    """How many partitions to deal rows to, counted, so that a task's share does not grow with them."""
    return max(ceil(rows.count() / ROWS_A_TASK), rows.sparkSession.sparkContext.defaultParallelism)


def per_request(*order) -> Window:
    return Window.partitionBy("request_id").orderBy(*order)


def distinct_list(values: Column, blocked: Column | None = None, most: int = 6) -> Column:
    """Values in order with white space collapsed, without blanks, repeats whatever the case, and blocked ones (in small
    letters), at most `most`."""
    none = F.array().cast("array<string>")
    clean = F.filter(F.transform(F.coalesce(values, none), collapse), lambda v: (v != "") & ~F.array_contains(none if blocked is None else blocked, F.lower(v)))
    seen = F.struct(none.alias("kept"), none.alias("low"))
    add = lambda a, v: F.when(F.array_contains(a["low"], F.lower(v)), a).otherwise(F.struct(F.concat(a["kept"], F.array(v)).alias("kept"), F.concat(a["low"], F.array(F.lower(v))).alias("low")))
    return F.slice(F.aggregate(clean, seen, add, lambda a: a["kept"]), 1, most)


def filled(own: Column, fallback: list[str], least: int, most: int) -> Column:
    """A list of at least `least` values: from `fallback` what it does not have, whatever the case, and then field_N."""
    more = F.filter(F.array(*[F.lit(v) for v in fallback]).cast("array<string>"), lambda v: ~F.array_contains(F.transform(own, F.lower), F.lower(v)))
    full = F.concat(own, F.slice(more, F.lit(1), F.greatest(F.lit(least) - F.size(own), F.lit(0))))
    rest = F.when(F.size(full) < least, F.transform(F.sequence(F.size(full) + 1, F.lit(least)), lambda n: F.concat(F.lit("field_"), n))).otherwise(F.array().cast("array<string>"))
    return F.slice(F.concat(full, rest), 1, most)


def normalised(requests: DataFrame) -> DataFrame:
    """requests(request_id, query and, where a model has answered, normalized_query, base_query, columns, aspects, rewrites,
    entity_type, query_mode, is_topic_query, normalization_note, invalid, error_message, failure) -> plans.

    Blank queries, failures of the model and queries that it calls invalid are errors with the fallback's columns. Columns are
    four to six, filled from the fallback, with name in front if it is not among them; aspects one to five; rewrites up to
    three, none of them the query itself.
    """
    have = requests.columns
    given = lambda c, kind="string": F.col(c).cast(kind) if c in have else F.lit(None).cast(kind)
    text = lambda c: F.nullif(F.trim(given(c)), F.lit(""))
    raw = collapse(F.coalesce("query", F.lit("")))
    df = requests.select("*", raw.alias("raw_")).withColumn("norm_", collapse(F.coalesce(text("normalized_query"), F.col("raw_"))))
    blank, failed, invalid = F.col("raw_") == "", given("failure").isNotNull(), F.coalesce(given("invalid", "boolean"), F.lit(False))
    error = blank | failed | invalid
    df = df.select("*", error.alias("error_"), F.when(blank | failed, F.col("raw_")).otherwise(F.col("norm_")).alias("n_"), F.when(blank | failed, F.col("raw_")).otherwise(collapse(F.coalesce(text("base_query"), "norm_"))).alias("b_"))
    e = F.col("error_")
    lists = "array<string>"
    # Projections of their own: what follows uses each list several times.
    df = df.withColumns({"c_": distinct_list(given("columns", lists), most=6), "a_": distinct_list(given("aspects", lists), most=5)}).withColumn("c_", filled(F.col("c_"), FALLBACK_COLUMNS, 4, 6))
    columns = F.col("c_")
    named = F.when(F.array_contains(F.transform(columns, F.lower), "name"), columns).otherwise(F.concat(F.array(F.lit("name")), F.slice(columns, 1, 5)))
    fixed = lambda values: F.array(*[F.lit(v) for v in values]).cast(lists)
    message = F.when(blank, EMPTY_QUERY).when(failed, given("failure")).when(invalid, F.coalesce(text("error_message"), F.lit(NO_TOPIC)))
    said = invalid & ~blank & ~failed
    kind = F.when(e, F.coalesce(F.when(said, text("entity_type")), F.lit("unknown_entity"))).otherwise(F.coalesce(text("entity_type"), F.lit("entity")))
    mode = F.when(e, F.coalesce(F.when(said, text("query_mode")), F.lit("invalid_query"))).otherwise(F.coalesce(text("query_mode"), F.lit("topic_entity_discovery")))
    return df.select(
        "request_id", F.col("b_").alias("base_query"), F.col("n_").alias("normalized_query"), F.when(e, fixed(FALLBACK_COLUMNS)).otherwise(named).alias("schema_columns"),
        F.when(e, fixed(["category"])).otherwise(filled(F.col("a_"), ["category"], 1, 5)).alias("core_aspects"),
        F.when(e, fixed([])).otherwise(distinct_list(given("rewrites", lists), F.array(F.lower("b_"), F.lower("n_")), 3)).alias("rewrites"),
        kind.alias("entity_type"), mode.alias("query_mode"), F.when(blank | failed, False).otherwise(F.coalesce(given("is_topic_query", "boolean"), ~e)).alias("is_topic_query"),
        F.when(~blank & ~failed, given("normalization_note")).alias("normalization_note"), e.alias("error"), message.alias("error_message"))


def executed_queries(plans: DataFrame, budget: int = 4) -> DataFrame:
    """(request_id, place, query): the follow-ups, where plans has any, else the query and its rewrites; white space collapsed,
    blanks left out, up to the budget."""
    own = F.concat(F.array("base_query"), "rewrites")
    if "followups" in plans.columns:
        own = F.when(F.size("followups") > 0, F.col("followups")).otherwise(own)
    every = F.filter(F.transform(own, collapse), lambda x: x != "")
    return plans.where("not error").select("request_id", F.posexplode(F.slice(every, 1, max(0, budget))).alias("place", "query"))
