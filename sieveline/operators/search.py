"""Searching: which queries are sent, for how many results, again where the pool is weak, and what is read of the results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.text import collapse, host, search_tokens

WEAK_POOL, CONTEXT_CHARS, SNIPPET_CHARS = 8, 400, 160
Source = Callable[[DataFrame], DataFrame]


def result_count(queries: Column, counts: dict[int, int] = fixed.RESULT_COUNTS) -> Column:
    """How many results to ask for with so many queries; more queries than the table has count as its largest, none as 0."""
    table = F.create_map(*[F.lit(x) for pair in sorted(counts.items()) for x in pair])
    return F.when(queries <= 0, 0).otherwise(F.coalesce(F.try_element_at(table, queries.cast("int")), F.lit(counts[max(counts)])))


def query_tokens(plans: DataFrame) -> DataFrame:
    """(request_id, query_tokens, aspect_tokens): the plan's search tokens, and those of all its aspects together."""
    aspects = F.aggregate(F.transform("core_aspects", search_tokens), F.array().cast("array<string>"), F.array_union)
    return plans.select("request_id", F.array_union(search_tokens(F.col("normalized_query")), search_tokens(F.col("base_query"))).alias("query_tokens"), aspects.alias("aspect_tokens"))


def first_pass(queries: DataFrame, counts: dict[int, int] = fixed.RESULT_COUNTS) -> DataFrame:
    """queries(request_id, place, query) with count, the results each query asks for."""
    n = queries.groupBy("request_id").agg(F.count("*").alias("n_"))
    return queries.join(n, "request_id").withColumn("count", result_count(F.col("n_"), counts)).drop("n_")


def weak_requests(queries: DataFrame, shortlisted: DataFrame, budget: int | None = None) -> DataFrame:
    """(request_id) whose shortlist is short, for which more results can be asked and the budget holds the queries again."""
    n = queries.groupBy("request_id").agg(F.count("*").alias("n"))
    got = shortlisted.groupBy("request_id").agg(F.count("*").alias("got"))
    weak = n.join(got, "request_id", "left").where((F.coalesce("got", F.lit(0)) < WEAK_POOL) & (result_count(F.col("n"), fixed.RETRY_COUNTS) > result_count(F.col("n"))))
    if budget is not None:
        weak = weak.where(F.greatest(F.lit(budget) - F.col("n"), F.lit(0)) >= F.col("n"))
    return weak.select("request_id")


def search(queries: DataFrame, source: Source, shortlist: Callable[[DataFrame], DataFrame], budget: int | None = None) -> DataFrame:
    """Raw results of all requests, with a second pass of larger counts for those whose shortlist is weak.

    source turns queries(request_id, place, query, count) into results; shortlist turns results into shortlisted rows. Both
    passes are one plan over all requests: the second reads only the queries of weak ones, and its results are added to the
    first's, where merging by url takes repeats out.
    """
    found = source(first_pass(queries))
    again = queries.join(weak_requests(queries, shortlist(found), budget), "request_id", "left_semi")
    return found.unionByName(source(first_pass(again, fixed.RETRY_COUNTS)))


def context_query(title: Column, snippet: Column, url: Column) -> Column:
    """Title, start of the snippet and the site, blanks left out, cut at CONTEXT_CHARS."""
    parts = F.filter(F.transform(F.array(title, F.substring(snippet, 1, SNIPPET_CHARS), F.concat(F.lit("site:"), host(url))), lambda p: F.trim(p)), lambda p: p != "")
    return F.substring(F.array_join(parts, " "), 1, CONTEXT_CHARS)


def within_budget(shortlisted: DataFrame, budget: int) -> DataFrame:
    """The first results of each request that may be read."""
    return shortlisted.where(F.col("position") <= max(0, budget))


def column_queries(facets: DataFrame, plans: DataFrame, most: int = 3) -> DataFrame:
    """(request_id, column, place, query): the request's query with the facet terms of its first sparse columns.

    facets(request_id, column, column_ord, facet_terms). Blank queries and columns without terms give none."""
    place = F.row_number().over(Window.partitionBy("request_id").orderBy("column_ord")) - 1
    terms = F.array_join(F.filter(F.transform("facet_terms", lambda t: F.trim(t)), lambda t: t != ""), " ")
    df = facets.withColumn("place", place).where(F.col("place") < most).join(plans.select("request_id", collapse(F.col("normalized_query")).alias("q_")), "request_id")
    return df.where("q_ <> ''").select("request_id", "column", "place", F.col("q_").alias("q_"), terms.alias("terms_")).where("terms_ <> ''").select("request_id", "column", "place", F.concat_ws(" ", "q_", "terms_").alias("query"))
