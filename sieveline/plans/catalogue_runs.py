"""Registered queries for the steps of whole requests, with SQL for the same results.

Stored tables stand in for live inputs as in catalogue.py: pages for sources, orders for evidence and search results,
customers for entities, events for runs. Whole tables are read. What the tables do not hold (which source has an assessment, which
cell an answer, which run failed) is made from their numbers, so that every case of a step occurs; all rows go through it.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions import text as T
from ..operators import answers, cells, entities, evidence, plan, providers, report, results, search, store, tables
from ..sources import jsonl, payloads, rowlog, service
from ..sources.pages import read
from ..streaming import lifecycle
from . import catalogue as base
from . import requests
from .catalogue import BASE, CANDIDATES

FACETS = {"origin": ["ther thnt", "erin"], "kind_of": ["thble", "  "]}
COLUMNS = ["name", "segment", "balance", "website"]
REPLAYED = "sieveline.sources.service:replayed"


def _request(key: str, n: int = 3) -> Column:
    return F.concat(F.lit("r"), F.col(key) % n)


def _plans(rows: DataFrame, query: str = BASE, rewrites: tuple = (), columns: list[str] = COLUMNS) -> DataFrame:
    lists = lambda values: F.array(*[F.lit(v) for v in values]).cast("array<string>")
    return rows.select("request_id").distinct().select("request_id", F.lit(query).alias("normalized_query"), F.lit(query).alias("base_query"), lists(rewrites).alias("rewrites"), lists(columns).alias("schema_columns"), lists(["category"]).alias("core_aspects"))


# ---- cells

def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks, people = base._chunks(spark, sf_dir), base._candidates(spark).withColumnRenamed("name", "entity")
    plans = _plans(people)
    facets = plans.select("request_id", F.explode(F.create_map(*[x for c, t in FACETS.items() for x in (F.lit(c), F.array(*[F.lit(v) for v in t]))])).alias("column", "facet_terms"))
    return cells.cell_scores(chunks, people, facets, plans)


def column_chunk_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cells(spark, sf_dir).select("request_id", "entity", "column", "chunk_id", "presence", "column_match", "query_match", "cleanliness", "score")


def column_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.choose_chunks(_cells(spark, sf_dir)).select("request_id", "entity", "column", "chunk_id", "score", "position")


_CELLS = base._CHUNK_SQL + """,
n AS (SELECT * FROM (VALUES ('Eriner', 'eriner'), ('Anon', 'anon'), ('Ther', 'ther'), ('Erin', 'erin'), ('Thor', 'thor'), ('Anon The', 'anon')) x(entity, nt)),
m0 AS (SELECT request_id, chunk_id, tok, ' ' || array_to_string(tok, ' ') || ' ' body, entity, nt, len(list_filter(tok, lambda x: x = nt)) times FROM t JOIN n ON list_contains(t.tok, n.nt)),
m AS (SELECT *, count(*) OVER (PARTITION BY request_id, chunk_id) - count(*) OVER (PARTITION BY request_id, chunk_id, nt) others FROM m0),
f AS (SELECT * FROM (VALUES ('origin'), ('kind_of')) x("column")),
w AS (SELECT m.*, f."column", coalesce(sc.s, 0) bm, CASE WHEN times = 1 THEN 0.85 ELSE 1.0 END::DOUBLE presence, CASE WHEN others = 0 THEN 1.0 WHEN others = 1 THEN 0.4 ELSE 0.0 END::DOUBLE cleanliness,
    CASE WHEN contains(body, ' ther erin thble ') THEN 1.0 WHEN contains(body, ' ther erin ') OR contains(body, ' erin thble ') THEN 2.0 / 3 WHEN contains(body, ' ther ') OR contains(body, ' erin ') OR contains(body, ' thble ') THEN 1.0 / 3 ELSE 0 END::DOUBLE span,
    (contains(body, ' ther ')::INT + contains(body, ' erin ')::INT + contains(body, ' thble ')::INT) / 3.0::DOUBLE anchor,
    CASE WHEN f."column" = 'origin' THEN 0.7 * ((contains(body, ' ther ')::INT + contains(body, ' thnt ')::INT + contains(body, ' erin ')::INT) / 3.0::DOUBLE) + 0.3 * (CASE WHEN contains(body, ' ther thnt ') OR contains(body, ' erin ') THEN 1.0 WHEN contains(body, ' ther ') OR contains(body, ' thnt ') THEN 0.5 ELSE 0 END::DOUBLE)
      ELSE contains(body, ' thble ')::INT * 1.0::DOUBLE END cm
    FROM m CROSS JOIN f LEFT JOIN sc ON sc.request_id = m.request_id AND sc.chunk_id = m.chunk_id AND sc.label = 'base'),
z AS (SELECT request_id, entity, "column", chunk_id, presence, round(cm, 6) column_match, round(0.6::DOUBLE * bm + 0.2::DOUBLE * span + 0.2::DOUBLE * anchor, 6) query_match, cleanliness FROM w),
y AS (SELECT *, round(0.2::DOUBLE * presence + 0.5::DOUBLE * column_match + 0.2::DOUBLE * query_match + 0.1::DOUBLE * cleanliness, 7) score FROM z)
"""
_CELLS_SQL = _CELLS + "SELECT * FROM y"
_CHOSEN_SQL = _CELLS + 'SELECT request_id, entity, "column", chunk_id, score, position FROM (SELECT *, row_number() OVER (PARTITION BY request_id, entity, "column" ORDER BY score DESC, chunk_id)::INT position FROM y) WHERE position <= 3'


# ---- the evidence store

def _sources(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    p = read(spark, sf_dir, "pages").select("page_id", _request("page_id").alias("request_id"), F.concat(F.lit("s"), "page_id").alias("source_id"), F.concat("url", F.lit("#"), "page_id").alias("url"))
    n = F.col("page_id")
    sources = p.select("request_id", "source_id", n.alias("ord"), "url", F.when(n % 4 == 0, " ").otherwise(F.concat(F.lit("t"), n)).alias("title"), F.lit("reader").alias("origin"), F.when(n % 5 == 0, False).when(n % 5 > 1, True).alias("fetch_succeeded"))
    chunks = p.select("*", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("i"))
    chunks = chunks.select("request_id", "source_id", F.concat_ws("#", "source_id", "i").alias("chunk_id"), F.col("i").alias("sequence_index"), F.when((F.col("i") == 2) & (n % 7 == 0), "  ").otherwise(F.concat(F.lit(" text "), n, F.lit(" "), "i", F.lit(" "))).alias("text"), n.alias("page_id"))
    ranked = chunks.select("request_id", "chunk_id", (F.col("page_id") * 3 + F.col("sequence_index")).alias("rank"), ((F.col("page_id") + F.col("sequence_index")) % 2 == 0).alias("selected"))
    words = lambda *w: F.element_at(F.array(*[F.lit(x) for x in w]), (n % len(w) + 1).cast("int"))
    assessed = p.where("page_id % 6 <> 0").select("request_id", "url", F.concat(F.lit("j"), n).alias("title"), (n % 11 == 0).alias("filtered_out"), words("discovery", "verification").alias("source_role"), words("high", "medium", "low").alias("source_quality"), words("official", "third_party", "low_quality", "near_official").alias("officiality"), F.array().cast("array<string>").alias("aspect_coverage"), F.array(F.lit("q"), F.concat(F.lit("q"), n % 2)).alias("query_sources"))
    return sources, chunks.drop("page_id"), ranked, assessed


def evidence_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = store.source_records(*_sources(spark, sf_dir))
    return df.select("request_id", "source_id", "chunk_id", "text", "source_title", "source_role", "source_quality", "officiality", F.array_join("query_sources", ",").alias("queries"), F.col("selected_chunk_rank").cast("long").alias("chunk_rank"))


_RECORDS = """
WITH p AS (SELECT page_id n, 'r' || (page_id % 3) request_id, 's' || page_id source_id, url || '#' || page_id url FROM pages),
c AS (SELECT p.*, i.range i, source_id || '#' || i.range chunk_id, CASE WHEN i.range = 2 AND n % 7 = 0 THEN '' ELSE 'text ' || n || ' ' || i.range END AS txt FROM p CROSS JOIN range(3) i),
k AS (SELECT * FROM c WHERE (n + i) % 2 = 0 AND txt <> '' AND n % 5 <> 0 AND NOT (n % 6 <> 0 AND n % 11 = 0))
"""
_RECORDS_SQL = _RECORDS + """
SELECT request_id, source_id, chunk_id, txt AS text, CASE WHEN n % 4 <> 0 THEN 't' || n WHEN n % 6 <> 0 THEN 'j' || n ELSE url END source_title,
    CASE WHEN n % 6 = 0 THEN 'discovery' ELSE ['discovery', 'verification'][n % 2 + 1] END source_role, CASE WHEN n % 6 = 0 THEN 'medium' ELSE ['high', 'medium', 'low'][n % 3 + 1] END source_quality,
    CASE WHEN n % 6 = 0 THEN 'third_party' ELSE ['official', 'third_party', 'low_quality', 'near_official'][n % 4 + 1] END officiality, CASE WHEN n % 6 = 0 THEN '' ELSE 'q,q' || (n % 2) END queries, (n * 3 + i)::BIGINT chunk_rank FROM k
"""


def evidence_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    sources, chunks, ranked, assessed = _sources(spark, sf_dir)
    records = store.source_records(sources, chunks, ranked, assessed)
    urls = sources.where("ord % 4 = 0").select("request_id", F.explode(F.array(F.concat(F.lit("n"), F.col("ord") % 5), F.lit("all"))).alias("name"), "url")
    named = chunks.select("request_id", "chunk_id", F.concat(F.lit("m"), F.col("sequence_index")).alias("name")).where("sequence_index < 2")
    return store.targets(records, named, urls)


_TARGETS_SQL = _RECORDS + "SELECT request_id, chunk_id, unnest(['n' || (n % 5), 'all']) AS name FROM k WHERE n % 4 = 0 UNION ALL SELECT request_id, chunk_id, 'm' || i FROM k WHERE n % 4 <> 0 AND i < 2"


def evidence_appended(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "lineitem").select(_request("l_partkey").alias("request_id"), F.col("l_partkey").cast("string").alias("entity"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).cast("long").alias("seq"), F.concat("l_returnflag", "l_linestatus").alias("text"), F.col("l_suppkey").cast("string").alias("source_url"), F.lit("t").alias("source_title"), F.lit("o").alias("origin"), *[F.lit(v).alias(k) for k, v in store.DEFAULTS.items()], F.array().cast("array<string>").alias("aspect_coverage"), F.array().cast("array<string>").alias("query_sources"), F.col("l_linenumber").alias("selected_chunk_rank"))
    out = store.append(rows.where("selected_chunk_rank = 1").dropDuplicates(["entity", "source_url", "text"]), rows.where("selected_chunk_rank > 1"))
    return out.select("request_id", "entity", "source_url", "text", (F.col("selected_chunk_rank") == 1).alias("stored"))


_APPENDED_SQL = "SELECT 'r' || (l_partkey % 3) request_id, l_partkey::VARCHAR entity, l_suppkey::VARCHAR source_url, l_returnflag || l_linestatus AS text, min(l_linenumber) = 1 stored FROM lineitem GROUP BY ALL"


def stop_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = read(spark, sf_dir, "lineitem").where("l_partkey is not null").select(_request("l_partkey").alias("request_id"), F.concat(F.lit("p"), F.col("l_partkey"), F.lit("-"), F.col("l_suppkey")).alias("name"), F.col("l_suppkey").alias("source_id"), F.lit(1).cast("long").alias("mentions"))
    judged = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("source_id"), F.explode(F.array(*[F.lit(f"r{i}") for i in range(3)])).alias("request_id"), (F.col("s_suppkey") % 7 == 0).alias("filtered_out"), F.when(F.col("s_acctbal") > 2000, "high").otherwise("low").alias("source_quality"), F.when(F.col("s_nationkey") == 3, "low_quality").otherwise("official").alias("officiality"))
    return evidence.stop_entities(seen, judged.select("request_id", "source_id", store.non_low().alias("non_low"))).select("request_id", "name", "mentions", "non_low")


_STOPS_SQL = """
WITH s AS (SELECT 'r' || (l_partkey % 3) request_id, 'p' || l_partkey || '-' || l_suppkey AS name, l_suppkey, count(*) mentions FROM lineitem GROUP BY ALL)
SELECT request_id, name, sum(mentions)::BIGINT mentions, bool_or(coalesce(s_suppkey % 7 <> 0 AND s_acctbal > 2000 AND s_nationkey <> 3, false)) non_low FROM s LEFT JOIN supplier ON s_suppkey = l_suppkey GROUP BY ALL HAVING sum(mentions) >= 2 OR bool_or(coalesce(s_suppkey % 7 <> 0 AND s_acctbal > 2000 AND s_nationkey <> 3, false))
"""


# ---- searching

def search_retry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests of one to six queries over orders as results; a shortlist has the urgent ones."""
    o = read(spark, sf_dir, "orders").select((F.col("o_custkey") % 97).alias("k"), "o_orderkey", "o_orderpriority")
    queries = spark.range(97).select(F.concat(F.lit("r"), "id").alias("request_id"), F.explode(F.expr("sequence(0, cast(id % 6 as int))")).alias("place")).withColumn("query", F.concat(F.lit("q"), "place"))
    stored = o.select(F.concat(F.lit("r"), "k").alias("request_id"), (F.col("o_orderkey") % 6).cast("int").alias("place"), F.col("o_orderkey").alias("url"), "o_orderpriority")
    stored = stored.withColumn("rank", F.expr("row_number() over (partition by request_id, place order by url)"))

    def source(asked: DataFrame) -> DataFrame:
        return stored.join(asked, ["request_id", "place"]).where(F.col("rank") <= F.col("count")).select("request_id", "place", "query", "url", "rank", "count", "o_orderpriority")

    found = search.search(queries, source, lambda df: df.where("o_orderpriority = '1-URGENT'"), budget=10)
    return found.select("request_id", "query", "url", F.col("rank").cast("int").alias("rank"), "count")


_RETRY_SQL = """
WITH q AS (SELECT 'r' || id.range request_id, p.range place, 'q' || p.range query, id.range % 6 + 1 n FROM range(97) id JOIN range(6) p ON p.range <= id.range % 6),
c AS (SELECT *, coalesce([20, 15, 12, 10][n], 10) c1, coalesce([32, 21, 16, 13][n], 13) c2 FROM q),
s AS (SELECT 'r' || (o_custkey % 97) request_id, o_orderkey % 6 place, o_orderkey url, o_orderpriority, row_number() OVER (PARTITION BY o_custkey % 97, o_orderkey % 6 ORDER BY o_orderkey) rank FROM orders),
f AS (SELECT * FROM s JOIN c USING (request_id, place) WHERE rank <= c1),
w AS (SELECT c.request_id FROM (SELECT request_id, max(n) n FROM c GROUP BY 1) c LEFT JOIN (SELECT request_id, count(*) got FROM f WHERE o_orderpriority = '1-URGENT' GROUP BY 1) g USING (request_id) WHERE coalesce(got, 0) < 8 AND greatest(10 - n, 0) >= n)
SELECT request_id, query, url, rank::INT rank, c1::INT AS "count" FROM f UNION ALL SELECT request_id, query, url, rank::INT, c2::INT FROM s JOIN c USING (request_id, place) SEMI JOIN w USING (request_id) WHERE rank <= c2
"""


def column_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "customer").select(F.concat(F.lit("r"), "c_custkey").alias("request_id"), F.col("c_custkey").alias("k"), "c_name", "c_mktsegment")
    plans = c.select("request_id", F.when(F.col("k") % 7 == 0, "  ").otherwise(F.concat(F.lit(" "), "c_mktsegment", F.lit("   firms "))).alias("normalized_query"))
    facets = c.select("request_id", F.posexplode(F.array(F.lit("name"), F.lit("site"), F.lit("place"), F.lit("size"))).alias("column_ord", "column"), F.array(F.when(F.col("k") % 3 == 0, " ").otherwise(F.col("c_name")), F.lit(" of "), F.lit("")).alias("facet_terms"))
    facets = facets.withColumn("facet_terms", F.when(F.col("column") == "site", F.array(F.lit(" "))).otherwise(F.col("facet_terms")))
    return search.column_queries(facets, plans).select("request_id", "column", F.col("place").cast("int").alias("place"), "query")


_COLQ_SQL = """
SELECT 'r' || c_custkey request_id, x."column", x.place::INT place, c_mktsegment || ' firms ' || CASE WHEN c_custkey % 3 = 0 THEN 'of' ELSE c_name || ' of' END query FROM customer CROSS JOIN (VALUES ('name', 0), ('place', 2)) x("column", place) WHERE c_custkey % 7 <> 0
"""


def plans_normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a planner proposes for parts: repeats, blanks, too few and too many columns, failures and refusals."""
    k = F.col("p_partkey")
    many = F.array(F.lit("Size"), F.col("p_type"), F.lit(" "), F.lower("p_type"), F.lit("site  url"), F.lit("a"), F.lit("b"), F.lit("c"), F.lit("d"))
    p = read(spark, sf_dir, "part").select(F.concat(F.lit("r"), k).alias("request_id"), F.when(k % 11 == 0, " ").otherwise(F.concat(F.lit(" "), "p_name", F.lit("  "))).alias("query"), F.when(k % 2 == 0, F.upper("p_name")).alias("normalized_query"), F.when(k % 3 == 0, many).otherwise(F.array(F.lit("Location"), F.lit("size"))).alias("columns"), F.when(k % 5 == 0, F.array(F.col("p_type"), F.upper("p_type"))).alias("aspects"), F.array(F.col("p_name"), F.col("p_brand"), F.lit("x"), F.lit("X"), F.lit("y"), F.lit("z")).alias("rewrites"), F.when(k % 13 == 0, "model is away").alias("failure"), (k % 17 == 0).alias("invalid"), F.when(k % 2 == 0, "no topic").alias("error_message"), F.col("p_brand").alias("entity_type"))
    flat = lambda c: F.array_join(c, "|").alias(c)
    return plan.normalised(p).select("request_id", "base_query", "normalized_query", flat("schema_columns"), flat("core_aspects"), flat("rewrites"), "entity_type", "query_mode", "is_topic_query", "error", "error_message")


_PLANS_SQL = """
WITH p AS (SELECT p_partkey k, p_name n, p_type t, p_brand b, CASE WHEN p_partkey % 11 = 0 THEN '' ELSE p_name END raw, p_partkey % 11 = 0 blank, p_partkey % 13 = 0 failed, p_partkey % 17 = 0 invalid FROM part),
q AS (SELECT *, blank OR failed OR invalid e, CASE WHEN blank OR failed THEN raw WHEN k % 2 = 0 THEN upper(n) ELSE raw END nq FROM p)
SELECT 'r' || k request_id, nq base_query, nq normalized_query, CASE WHEN e THEN 'name|website|location|category' WHEN k % 3 = 0 THEN 'name|Size|' || t || '|site url|a|b' ELSE 'Location|size|name|website' END schema_columns,
    CASE WHEN NOT e AND k % 5 = 0 THEN t ELSE 'category' END core_aspects, CASE WHEN e THEN '' ELSE b || '|x|y' END rewrites, CASE WHEN e AND (blank OR failed) THEN 'unknown_entity' ELSE b END entity_type, CASE WHEN e THEN 'invalid_query' ELSE 'topic_entity_discovery' END query_mode, NOT e is_topic_query, e AS error,
    CASE WHEN blank THEN 'Query is empty. Please provide a topic describing entities to discover.' WHEN failed THEN 'model is away' WHEN invalid THEN CASE WHEN k % 2 = 0 THEN 'no topic' ELSE 'This query is not a supported entity-discovery topic.' END END error_message FROM q
"""


def results_in_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages' results with their passages, cleaned and cut, or their snippet where they have none; results within a budget."""
    n = F.col("page_id")
    p = read(spark, sf_dir, "pages").select(_request("page_id").alias("request_id"), F.concat("url", F.lit("#"), n).alias("url"), F.concat(F.lit("snippet "), n).alias("snippet"), n).withColumn("position", F.row_number().over(plan.per_request(n)))
    long = F.concat(F.lit("Read more\n"), F.repeat(F.concat(F.lit("w"), n, F.lit(" ")), 300))
    found = p.select("request_id", F.when(n % 5 == 0, "https://else").otherwise(F.col("url")).alias("url"), F.explode(F.array(F.lit(0), F.lit(1))).alias("pos"), F.when(n % 2 == 0, long).when(n % 3 == 0, "Read more").otherwise("text. ").alias("text"))
    got = payloads.with_context(search.within_budget(p, 60), found, 100)
    return got.select("request_id", "url", F.col("sequence_index").cast("int").alias("place"), "text", "fallback")


_CONTEXT_SQL = """
WITH p AS (SELECT page_id n, 'r' || (page_id % 3) request_id, url || '#' || page_id url, row_number() OVER (PARTITION BY page_id % 3 ORDER BY page_id) pos FROM pages),
b AS (SELECT *, n % 5 = 0 OR (n % 2 > 0 AND n % 3 = 0) none FROM p WHERE pos <= 60)
SELECT request_id, url, x.i::INT place, CASE WHEN none THEN 'snippet ' || n WHEN n % 2 = 0 THEN trim(substring(repeat('w' || n || ' ', 100), 1, 100 - instr(reverse(substring(repeat('w' || n || ' ', 100), 1, 100)), ' '))) ELSE 'text.' END AS text, none fallback
FROM b CROSS JOIN (VALUES (0), (1)) x(i) WHERE NOT none OR x.i = 0
"""


def queries_sent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as requests: some with follow-ups, blank rewrites or errors."""
    k = F.col("p_partkey")
    p = read(spark, sf_dir, "part").select(F.concat(F.lit("r"), k).alias("request_id"), F.concat(F.lit("  "), "p_name").alias("base_query"), F.array("p_type", F.lit(" "), F.concat("p_brand", F.lit("   x")), F.lit("a"), F.lit("b")).alias("rewrites"), F.when(k % 3 == 0, F.array(F.lit(" "), F.lit("follow  up"))).otherwise(F.array().cast("array<string>")).alias("followups"), (k % 10 == 0).alias("error"))
    return plan.executed_queries(p).select("request_id", "place", "query")


_SENT_SQL = """
WITH p AS (SELECT p_partkey k, CASE WHEN p_partkey % 3 = 0 THEN ['follow up'] ELSE [p_name, p_type, p_brand || ' x', 'a'] END q FROM part WHERE p_partkey % 10 <> 0)
SELECT 'r' || k request_id, (generate_subscripts(q, 1) - 1)::INT place, unnest(q) query FROM p
"""


def search_tokens_of_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "part").select(F.concat(F.lit("r"), "p_partkey").alias("request_id"), F.concat(F.lit("the "), "p_name").alias("normalized_query"), F.col("p_type").alias("base_query"), F.array("p_name", "p_brand", F.lit("")).alias("core_aspects"))
    arr = lambda c: F.array_join(F.sort_array(c), ",").alias(c)
    return search.query_tokens(p).select("request_id", arr("query_tokens"), arr("aspect_tokens"))


_PTOK = "coalesce(array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(lower({0}), '[a-z0-9]+'), lambda x: len(x) > 1 AND NOT list_contains({1}, x)))), ','), '')"
_PTOK_SQL = "SELECT 'r' || p_partkey request_id, " + _PTOK.format("p_name || ' ' || p_type", base._sql_list(fixed.SEARCH_STOPWORDS)) + " query_tokens, " + _PTOK.format("p_name || ' ' || p_brand", base._sql_list(fixed.SEARCH_STOPWORDS)) + " aspect_tokens FROM part"


# ---- stored answers of services

def _page_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "pages").select("page_id", "url", F.concat(F.lit("r"), F.floor(F.col("page_id") / 10)).alias("request_id"))


def search_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers of ten results each, some without url or owner, read back as results."""
    n = F.col("page_id")
    item = F.struct(F.when(n % 4 == 0, "").otherwise(F.col("url")).alias("url"), F.concat(F.lit("t"), n).alias("title"), F.concat(F.lit("d"), n).alias("description"), F.when(n % 3 == 0, F.struct(F.concat(F.lit("own"), n).alias("long_name"))).alias("profile"))
    raw = _page_rows(spark, sf_dir).groupBy("request_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("page_id", item.alias("i")))), lambda x: x["i"]).alias("results"))
    raw = raw.select("request_id", F.lit("q").alias("query"), F.to_json(F.struct(F.struct("results").alias("web"))).alias("payload"))
    raw = service.ask_all(raw, REPLAYED, ["request_id", "query"])
    return payloads.search_payloads(raw).select("request_id", "url", "title", "snippet", "domain", F.col("rank").cast("int").alias("rank"))


_SANSWERS_SQL = """
WITH p AS (SELECT page_id n, url, 'r' || (page_id // 10) request_id, row_number() OVER (PARTITION BY page_id // 10 ORDER BY page_id)::INT rank FROM pages)
SELECT request_id, url, 't' || n title, 'd' || n snippet, CASE WHEN n % 3 = 0 THEN 'own' || n ELSE lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)) END AS "domain", rank FROM p WHERE n % 4 <> 0
"""


def context_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers with generic, place and map items, read back as passages in that order."""
    n = F.col("page_id")
    item = lambda kind: F.struct(F.when(n % 5 == 0, "").otherwise(F.concat("url", F.lit(f"&{kind}"))).alias("url"), F.when(n % 2 == 0, F.concat(F.lit("t"), n)).alias("title"), F.array(F.when(n % 7 == 0, " ").otherwise(F.concat(F.lit(kind), n)), F.lit("  "), F.lit("x")).alias("snippets"))
    rows = _page_rows(spark, sf_dir)
    listed = lambda kind: F.transform(F.sort_array(F.collect_list(F.struct("page_id", item(kind).alias("i")))), lambda x: x["i"])
    seen = F.map_from_entries(F.collect_list(F.struct(F.concat("url", F.lit("&g")), F.struct(F.concat(F.lit("s"), n).alias("title"), F.array(F.lit(" "), F.concat(F.lit("age"), n)).alias("age")))))
    raw = rows.dropDuplicates(["request_id", "url"]).groupBy("request_id").agg(listed("g").alias("generic"), F.max_by(item("p"), n).alias("poi"), listed("m").alias("map"), seen.alias("sources"))
    raw = raw.select("request_id", F.to_json(F.struct(F.struct("generic", "poi", "map").alias("grounding"), "sources")).alias("payload"))
    raw = service.ask_all(raw, REPLAYED, ["request_id"])
    return payloads.context_payloads(raw).select("request_id", F.col("pos").cast("int").alias("pos"), "url", "title", "age", "text")


_CANSWERS_SQL = """
WITH p AS (SELECT 'r' || (page_id // 10) request_id, url, min(page_id) n FROM pages GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY n) - 1 g, count(*) OVER (PARTITION BY request_id) c, row_number() OVER (PARTITION BY request_id ORDER BY n DESC) d FROM p),
i AS (SELECT request_id, g pos, url || '&g' url, n, 'g' kind FROM k UNION ALL SELECT request_id, c, url || '&p', n, 'p' FROM k WHERE d = 1 UNION ALL SELECT request_id, c + 1 + g, url || '&m', n, 'm' FROM k)
SELECT request_id, pos::INT pos, url, CASE WHEN n % 2 = 0 THEN 't' || n WHEN kind = 'g' THEN 's' || n END title, CASE WHEN kind = 'g' THEN 'age' || n END age, CASE WHEN n % 7 = 0 THEN 'x' ELSE kind || n || chr(10) || 'x' END AS text FROM i WHERE n % 5 <> 0
"""


def reader_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Read texts with a title line, without one, empty, or with an error."""
    n = F.col("page_id")
    text = F.when(n % 6 == 0, "").when(n % 6 == 1, F.concat(F.lit("\n  Title: page "), n, F.lit(" \nbody"))).when(n % 6 == 2, "Title:\nx").otherwise(F.concat(F.lit(" \n line "), n, F.lit("\nmore")))
    # Of the errors some come with a text, as from a reader that gave up midway; the others fail as requests.
    told = F.to_json(F.struct(text.alias("text"), F.when(n % 11 == 0, "timeout").alias("error")))
    raw = _page_rows(spark, sf_dir).select("url", told.alias("payload"), F.when(n % 66 == 0, "timeout").alias("reports"))
    raw = service.ask_all(raw, REPLAYED, ["url"])
    raw = raw.select("url", F.get_json_object("payload", "$.text").alias("text"), F.coalesce("error", F.get_json_object("payload", "$.error")).alias("error"))
    return payloads.reader_pages(raw).select("url", "title", "text", "fetch_succeeded", "error_message")


_READER_SQL = """
SELECT url, CASE page_id % 6 WHEN 0 THEN url WHEN 1 THEN 'page ' || page_id WHEN 2 THEN 'Title:' ELSE 'line ' || page_id END title,
    CASE WHEN page_id % 11 = 0 OR page_id % 6 = 0 THEN NULL WHEN page_id % 6 = 1 THEN chr(10) || '  Title: page ' || page_id || ' ' || chr(10) || 'body' WHEN page_id % 6 = 2 THEN 'Title:' || chr(10) || 'x' ELSE ' ' || chr(10) || ' line ' || page_id || chr(10) || 'more' END AS text,
    page_id % 11 <> 0 AND page_id % 6 <> 0 fetch_succeeded, CASE WHEN page_id % 11 = 0 THEN 'timeout' END error_message FROM pages
"""


def context_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 9 == 0, " ").otherwise(F.concat(F.lit(" doc "), "doc_id")).alias("title"), F.coalesce("text", F.lit("")).alias("text"))
    return d.select("doc_id", search.context_query(F.col("title"), F.translate("text", "\n\t\r", "   "), F.concat(F.lit("https://Host.example/"), "doc_id")).alias("query"))


_CONTEXTQ_SQL = r"""
WITH d AS (SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN '' ELSE 'doc ' || doc_id END t, trim(substring(translate(coalesce(text, ''), chr(10) || chr(9) || chr(13), '   '), 1, 160)) s FROM documents)
SELECT doc_id, substring(array_to_string(list_filter([t, s, 'site:host.example'], lambda x: x <> ''), ' '), 1, 400) query FROM d
"""


# ---- what models answer

def bucket_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("page_id")
    p = read(spark, sf_dir, "pages").select("page_id", _request("page_id").alias("request_id"), F.concat("url", F.lit("#"), "page_id").alias("url"))
    words = F.array(*[F.lit(x) for x in (" roundup_list ", "official_entity", "nonsense", "editorial_reference", "")])
    said = p.where("page_id % 3 <> 1").select("request_id", F.explode(F.sequence(F.lit(0), F.lit(1))).alias("place"), F.when(n % 8 == 0, "  ").otherwise(F.concat(F.lit(" "), "url", F.lit(" "))).alias("url"), "page_id")
    said = said.withColumn("bucket", F.element_at(words, ((n + F.col("place")) % 5 + 1).cast("int")))
    return answers.with_buckets(p, answers.bucket_decisions(said)).select("request_id", "url", "bucket")


_BUCKETR_SQL = "SELECT 'r' || (page_id % 3) request_id, url || '#' || page_id url, CASE WHEN page_id % 3 <> 1 AND page_id % 8 <> 0 THEN ['roundup_list', 'official_entity', 'editorial_reference', 'editorial_reference', 'editorial_reference'][(page_id + 1) % 5 + 1] END bucket FROM pages"


def assessed_overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("s_suppkey")
    s = read(spark, sf_dir, "supplier").select(F.lit("r").alias("request_id"), F.col("s_name").alias("url"), n, (n % 6 == 0).alias("filtered_out"), F.lit("discovery").alias("source_role"), F.lit("medium").alias("source_quality"), F.lit("third_party").alias("officiality"), F.array().cast("array<string>").alias("aspect_coverage"))
    said = s.where("s_suppkey % 4 <> 0").select("request_id", "url", F.lit("verification").alias("role"), F.when(n % 3 == 0, "high").alias("quality"), F.when(n % 5 == 0, "low_quality").alias("official"), F.array(F.lit("price")).alias("aspects"))
    return answers.overridden(s.drop("s_suppkey"), said).select("url", "filtered_out", "source_role", "source_quality", "officiality", F.array_join("aspect_coverage", ",").alias("aspects"))


_OVERRIDE_SQL = """
SELECT s_name url, s_suppkey % 6 = 0 filtered_out, CASE WHEN o THEN 'verification' ELSE 'discovery' END source_role, CASE WHEN o AND s_suppkey % 3 = 0 THEN 'high' ELSE 'medium' END source_quality,
    CASE WHEN o AND s_suppkey % 5 = 0 THEN 'low_quality' ELSE 'third_party' END officiality, CASE WHEN o THEN 'price' ELSE '' END aspects FROM (SELECT *, s_suppkey % 4 <> 0 AND s_suppkey % 6 <> 0 o FROM supplier)
"""


def _orders_as_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders")
    return o.select(_request("o_custkey").alias("request_id"), F.col("o_custkey").cast("string").alias("entity"), F.col("o_orderkey").cast("long").alias("seq"), F.col("o_orderpriority").alias("text"), F.concat(F.lit("u"), F.col("o_orderkey") % 7).alias("source_url"), F.lit("t").alias("source_title"), F.lit("discovery").alias("source_role"), F.lit("medium").alias("source_quality"), F.lit("third_party").alias("officiality"), F.array().cast("array<string>").alias("aspect_coverage"))


def _extracted(spark: SparkSession, sf_dir: str) -> DataFrame:
    proof = _orders_as_evidence(spark, sf_dir)
    k = F.col("c_custkey")
    c = read(spark, sf_dir, "customer").select(_request("c_custkey").alias("request_id"), k, k.cast("string").alias("entity"), "c_mktsegment", "c_acctbal")
    cell = lambda column, value, conf, *ids: F.struct(F.lit(column).alias("column"), value.cast("string").alias("value"), F.lit(conf).alias("confidence"), F.array(*[F.lit(i) for i in ids]).alias("chunk_ids"))
    given = F.array(cell("segment", F.col("c_mktsegment"), 0.75, "c2", "c99", "c1"), cell("balance", F.col("c_acctbal").cast("long"), 0.5, "c13"), cell("unplanned", F.lit("x"), 0.5, "c1"), cell("website", F.when(k % 4 == 0, F.lit("w")), 0.25, "c1"))
    said = c.where("c_custkey % 6 <> 0").select("request_id", "entity", F.when(k % 5 == 0, "someone else").otherwise(F.concat(F.lit(" "), "entity", F.lit(" "))).alias("answered_name"), (k % 2 == 0).alias("provisional"), F.explode(given).alias("g")).select("request_id", "entity", "answered_name", "provisional", "g.*")
    return answers.extracted_fields(said, proof, _plans(c))


def extracted_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    urls = F.array_join(F.transform("evidence", lambda e: e["source_url"]), ",")
    return _extracted(spark, sf_dir).select("request_id", "entity", "column", "value", "confidence", urls.alias("urls"), "provisional")


def typed_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' answers read by a schema: good ones, cut-off ones, refusals, fields of another kind, lacking fields, failed calls."""
    k = F.col("c_custkey")
    good = F.to_json(F.struct(F.col("c_mktsegment").alias("segment"), F.lit(0.5).alias("score"), F.array(F.lit("c1")).alias("ids")))
    said = F.when(k % 6 == 0, good).when(k % 6 == 1, F.substring(good, 1, 20)).when(k % 6 == 2, F.concat(F.lit('{"refusal":"not about '), "c_mktsegment", F.lit('"}')))
    said = said.when(k % 6 == 3, F.replace(good, F.lit("0.5"), F.lit('"high"'))).when(k % 6 == 4, F.lit('{"score":0.5,"ids":[],"more":1}'))
    raw = read(spark, sf_dir, "customer").select(k, said.alias("payload"), F.when(k % 6 == 5, "slow").alias("reports"))
    got = providers.typed(service.ask_all(raw, REPLAYED, ["c_custkey"]).withColumnRenamed("payload", "answer"), "segment string, score double, ids array<string>", ["segment", "ids"])
    return got.select("c_custkey", "parsed.segment", "parsed.score", F.array_join("parsed.ids", ",").alias("ids"), "error")


_TYPED_SQL = """
SELECT c_custkey, CASE WHEN c_custkey % 6 = 0 THEN c_mktsegment END AS segment, CASE WHEN c_custkey % 6 = 0 THEN 0.5::DOUBLE END AS score, CASE WHEN c_custkey % 6 = 0 THEN 'c1' END AS ids,
    CASE c_custkey % 6 WHEN 0 THEN NULL WHEN 2 THEN 'not about ' || c_mktsegment WHEN 5 THEN 'slow' ELSE 'model returned no parsed structured output' END AS error FROM customer
"""


def repeated_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' fields where a model has answered for a column more than once: the last answer counts, also one without value."""
    k = F.col("c_custkey")
    c = read(spark, sf_dir, "customer").select(_request("c_custkey").alias("request_id"), k, k.cast("string").alias("entity"), "c_mktsegment")
    told = lambda place, column, value: F.struct(F.lit(place).alias("place"), F.lit(column).alias("column"), value.cast("string").alias("value"), (F.lit(place) / 4).alias("confidence"))
    given = F.array(told(3, "segment", F.when(k % 3 > 0, F.col("c_mktsegment"))), told(1, "segment", F.lit("zz")), told(2, "website", F.lit("late")), told(0, "website", F.lit("zz early")), told(1, "balance", F.when(k % 2 == 0, F.lit("1"))))
    said = c.select("request_id", "entity", F.col("entity").alias("answered_name"), F.lit(False).alias("provisional"), F.explode(given).alias("g")).select("request_id", "entity", "answered_name", "provisional", "g.*", F.array(F.lit("c1")).alias("chunk_ids"))
    found = answers.extracted_fields(said, _orders_as_evidence(spark, sf_dir), _plans(c))
    return found.select("request_id", "entity", "column", "value", "confidence", F.size("evidence").alias("proofs"))


_REPEATED_SQL = """
WITH e AS (SELECT DISTINCT o_custkey k FROM orders),
x AS (SELECT 'r' || (k % 3) request_id, k::VARCHAR entity, p."column", CASE p."column" WHEN 'name' THEN k::VARCHAR WHEN 'segment' THEN CASE WHEN k % 3 > 0 THEN c_mktsegment END WHEN 'website' THEN 'late' WHEN 'balance' THEN CASE WHEN k % 2 = 0 THEN '1' END END AS value,
    CASE p."column" WHEN 'name' THEN 1.0 WHEN 'segment' THEN 0.75 WHEN 'website' THEN 0.5 ELSE 0.25 END::DOUBLE confidence FROM e JOIN customer ON c_custkey = k CROSS JOIN (VALUES ('name'), ('segment'), ('balance'), ('website')) p("column"))
SELECT request_id, entity, "column", value, CASE WHEN value IS NULL THEN 0.0 ELSE confidence END::DOUBLE confidence, CASE WHEN value IS NULL THEN 0 ELSE 1 END::INT proofs FROM x
"""
_EXTRACTED = """
WITH o AS (SELECT o_custkey k, 'u' || (o_orderkey % 7) url, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) n FROM orders),
e AS (SELECT k, max(CASE WHEN n = 1 THEN url END) u1, max(CASE WHEN n = 2 THEN url END) u2 FROM o GROUP BY 1),
a AS (SELECT e.*, c_mktsegment, c.c_custkey IS NOT NULL AND k % 6 <> 0 AND k % 5 <> 0 fine FROM e LEFT JOIN customer c ON c_custkey = k),
x AS (SELECT 'r' || (k % 3) request_id, k, k::VARCHAR entity, p."column", p.ord column_ord, CASE WHEN NOT fine THEN NULL WHEN p."column" = 'name' THEN k::VARCHAR WHEN p."column" = 'segment' THEN c_mktsegment WHEN p."column" = 'website' AND k % 4 = 0 THEN 'w' END AS value,
    CASE WHEN p."column" = 'segment' AND u2 IS NOT NULL THEN u2 || ',' || u1 ELSE u1 END urls, CASE p."column" WHEN 'name' THEN 1.0 WHEN 'segment' THEN 0.75 ELSE 0.25 END::DOUBLE confidence, NOT fine OR k % 2 = 0 provisional
    FROM a CROSS JOIN (VALUES ('name', 0), ('segment', 1), ('balance', 2), ('website', 3)) p("column", ord))
"""
_EXTRACTED_SQL = _EXTRACTED + """SELECT request_id, entity, "column", value, CASE WHEN value IS NULL THEN 0.0 ELSE confidence END::DOUBLE confidence, CASE WHEN value IS NULL THEN '' ELSE urls END urls, provisional FROM x"""


def entity_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answers.source_urls(_extracted(spark, sf_dir)).select("request_id", "entity", F.array_join("source_urls", ",").alias("urls"))


_ESOURCES_SQL = _EXTRACTED + """, z AS (SELECT request_id, entity, list_distinct([y]) FROM (SELECT 1 AS y, request_id, entity FROM x WHERE false)), w AS (SELECT request_id, entity, max(CASE WHEN "column" = 'name' AND value IS NOT NULL THEN urls END) u1, max(CASE WHEN "column" = 'segment' AND value IS NOT NULL THEN urls END) u2 FROM x GROUP BY ALL)
SELECT request_id, entity, CASE WHEN u1 IS NULL THEN '' WHEN u2 IS NULL OR split_part(u2, ',', 1) = u1 THEN u1 ELSE u1 || ',' || split_part(u2, ',', 1) END urls FROM w"""


def facets_chosen(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    sparse = read(spark, sf_dir, "part").select(F.concat(F.lit("r"), k).alias("request_id"), k, "p_name", "p_type", F.posexplode(F.array(F.lit("home_page"), F.lit("size"))).alias("column_ord", "column"))
    terms = F.when(k % 4 == 0, F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit(" "), "p_name", F.lit("  ")), F.upper("p_name"), F.lit(" "), "p_type", F.lit("a"), F.lit("b"), F.lit("c")))
    said = sparse.where("p_partkey % 5 <> 0 and column = 'home_page'").select("request_id", "column", terms.alias("facet_terms"), F.lit(0).alias("place"))
    return answers.facets(sparse.select("request_id", "column", "column_ord"), said).select("request_id", "column", F.array_join("facet_terms", "|").alias("terms"))


_FACETS_SQL = """SELECT 'r' || p_partkey request_id, c."column", CASE WHEN c."column" = 'size' THEN 'size' WHEN p_partkey % 5 = 0 OR p_partkey % 4 = 0 THEN 'home page' ELSE p_name || '|' || p_type || '|a|b' END terms FROM part CROSS JOIN (VALUES ('home_page'), ('size')) c("column")"""


def gap_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells without a value after extraction, answered for again and merged."""
    fields = _extracted(spark, sf_dir)
    proof = _orders_as_evidence(spark, sf_dir).withColumn("position", F.expr("row_number() over (partition by request_id, entity order by seq)")).where("position <= 3").select("request_id", "entity", F.lit("balance").alias("column"), F.concat(F.lit("x"), "position").alias("chunk_id"), F.col("source_url").alias("url"), F.col("source_title").alias("title"), "text", "position")
    n = F.col("entity").cast("long")
    said = fields.where("column in ('balance', 'segment', 'website')").select("request_id", "entity", F.when(n % 7 == 0, "no").otherwise(F.col("entity")).alias("answered_name"), F.lit(False).alias("provisional"), "column", F.when(n % 8 > 0, F.concat(F.lit("new "), "entity")).alias("value"), F.lit(0.4).alias("confidence"), F.when(F.col("column") == "website", F.array(F.lit("x9"))).otherwise(F.array(F.lit("x2"), F.lit("x1"))).alias("chunk_ids"))
    out = answers.merged_fields(fields, answers.gap_updates(said, fields, proof))
    return out.select("request_id", "entity", "column", "value", "confidence", F.size("evidence").alias("proofs"))


_GAPS_SQL = _EXTRACTED + """, m AS (SELECT k, count(*) n FROM o GROUP BY 1)
SELECT request_id, entity, "column", CASE WHEN value IS NULL AND g THEN 'new ' || entity ELSE value END AS value, CASE WHEN value IS NOT NULL THEN confidence WHEN g THEN 0.4 ELSE 0.0 END::DOUBLE confidence,
    (CASE WHEN value IS NOT NULL THEN len(string_split(urls, ',')) WHEN g THEN least(n, 2) ELSE 0 END)::INT proofs FROM (SELECT x.*, m.n, x."column" IN ('balance', 'segment') AND x.k % 7 <> 0 AND x.k % 8 > 0 g FROM x JOIN m USING (k))"""


def model_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is sent for each entity, read back: chunks of the extractor's and of the gap filler's payload, missing columns."""
    proof, fields = _orders_as_evidence(spark, sf_dir), _extracted(spark, sf_dir)
    plans = _plans(proof)
    first = answers.extractor_payloads(proof, plans).select("request_id", "entity", F.from_json("payload", "evidence_chunks array<struct<chunk_id:string>>")["evidence_chunks"].alias("c"))
    found = answers.evidence_numbers(proof, 20).select("request_id", "entity", F.lit("website").alias("column"), "chunk_id", F.col("source_url").alias("url"), F.col("source_title").alias("title"), "text", F.col("n_").alias("position"))
    gaps = answers.gap_payloads(fields, found, plans).select("request_id", "entity", F.from_json("payload", "evidence_chunks array<struct<chunk_id:string>>, missing_columns array<string>").alias("g"))
    return first.join(gaps, ["request_id", "entity"], "left").select("request_id", "entity", F.size("c").alias("chunks"), F.element_at("c", -1)["chunk_id"].alias("last"), F.coalesce(F.array_join("g.missing_columns", ","), F.lit("")).alias("missing"), F.when(F.size("g.evidence_chunks") > 0, F.size("g.evidence_chunks")).otherwise(0).alias("gap_chunks"))


_PAYLOADS_SQL = _EXTRACTED + """, m AS (SELECT k, count(*)::INT n FROM o GROUP BY 1), v AS (SELECT k, string_agg("column", ',' ORDER BY column_ord) FILTER (value IS NULL) missing, bool_or("column" = 'website' AND value IS NULL) w FROM x GROUP BY 1)
SELECT 'r' || (k % 3) request_id, k::VARCHAR entity, least(n, 12)::INT chunks, 'c' || least(n, 12) "last", coalesce(missing, '') missing, CASE WHEN w THEN least(n, 9) ELSE 0 END::INT gap_chunks FROM m JOIN v USING (k)"""


# ---- runs

def _runs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Users as runs, their events as stages; errors of some users end their run."""
    e = read(spark, sf_dir, "events").select(F.concat(F.lit("u"), "user_id").alias("request_id"), "user_id", F.col("event_id").alias("place"), F.col("event_type").alias("stage"), F.concat(F.lit("Doing "), "event_type").alias("message"), (F.col("event_id") % 5 > 0).alias("completed"))
    runs = e.select("request_id", "user_id").distinct().select("request_id", F.when(F.col("user_id") % 7 == 0, "value_error").when(F.col("user_id") % 7 == 1, "os_error").alias("error_kind"), F.concat(F.lit("bad "), "user_id").alias("error_message"))
    return runs, e.drop("user_id")


def run_lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.run_events(*_runs(spark, sf_dir)).select("request_id", F.col("seq").cast("int").alias("seq"), "event", "stage", "message", "code", "error", "details")


_LIFECYCLE = """
WITH e AS (SELECT 'u' || user_id request_id, event_id place, event_type stage, 'Doing ' || event_type message, event_id % 5 > 0 completed FROM events),
r AS (SELECT DISTINCT user_id u, 'u' || user_id request_id FROM events),
a AS (SELECT request_id, -1 place, 0 part, 'run_started' AS event, NULL stage, 'Started search' message, NULL code, NULL AS error, NULL details FROM r
    UNION ALL SELECT request_id, place, 0, 'stage_started', stage, message, NULL, NULL, NULL FROM e UNION ALL SELECT request_id, place, 1, 'stage_completed', stage, message || ' completed', NULL, NULL, NULL FROM e WHERE completed
    UNION ALL SELECT request_id, 1073741824, 2, CASE WHEN u % 7 < 2 THEN 'run_failed' ELSE 'run_completed' END, CASE WHEN u % 7 = 0 THEN 'planner' END, CASE WHEN u % 7 < 2 THEN 'Search failed' ELSE 'Search completed' END,
      CASE u % 7 WHEN 0 THEN 'invalid_query' WHEN 1 THEN 'internal_error' END, CASE u % 7 WHEN 0 THEN 'bad ' || u WHEN 1 THEN 'Something went wrong while running the research pipeline.' END, CASE WHEN u % 7 = 1 THEN 'bad ' || u END FROM r),
s AS (SELECT request_id, row_number() OVER (PARTITION BY request_id ORDER BY place, part)::INT seq, event, stage, message, code, error, details FROM a)
"""


_EVENT = "request_id string, seq long, event string, stage string, message string, code string, error string, details string"


def _logged(spark: SparkSession, sf_dir: str) -> str:
    """A new log in the shared folder with all runs' events: those of the first steps, then all of them twice over."""
    events = plan.cut(lifecycle.run_events(*_runs(spark, sf_dir)).withColumn("seq", F.col("seq").cast("long")))
    path = f"{spark.sparkContext.getCheckpointDir()}/log-{uuid.uuid4().hex}"
    for rows in (events.where("seq <= 3"), events, events):
        rowlog.append(rows.select(*[c.split()[0] for c in _EVENT.split(", ")]), path, ["request_id", "seq"], "seq")
    return path


def run_events_logged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All runs' events, appended with repeats and read back once each."""
    return rowlog.stored(spark, _logged(spark, sf_dir), _EVENT).withColumn("seq", F.col("seq").cast("int"))


def run_events_streamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stages of all runs from a copy of the log that a stream made in two goes."""
    path = _logged(spark, sf_dir)
    for _ in range(2):
        events = rowlog.stream(spark, path, _EVENT)
        events.writeStream.format("row_log").option("path", f"{path}-copy").option("name", "copy").option("checkpointLocation", f"{path}-progress").trigger(availableNow=True).start().awaitTermination()
    states = lifecycle.stage_states(rowlog.stored(spark, f"{path}-copy", _EVENT))
    return states.select("request_id", "id", F.col("first_seq").cast("int").alias("first_seq"), "status")


def run_stage_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.stage_states(lifecycle.run_events(*_runs(spark, sf_dir))).select("request_id", "id", F.col("first_seq").cast("int").alias("first_seq"), "status")


_STATES_SQL = _LIFECYCLE + """,
k AS (SELECT request_id, seq, coalesce(stage, 'run') || ':' || regexp_replace(message, ' completed$', '') id, CASE WHEN event IN ('run_started', 'stage_started') THEN 'active' WHEN event = 'run_failed' THEN 'failed' ELSE 'completed' END status, event = 'run_completed' done FROM s),
m AS (SELECT *, max(CASE WHEN status = 'active' THEN seq END) OVER (PARTITION BY request_id) last_start, bool_or(done) OVER (PARTITION BY request_id) good, row_number() OVER (PARTITION BY request_id, id ORDER BY seq DESC) rn, min(seq) OVER (PARTITION BY request_id, id) first_seq FROM k)
SELECT request_id, id, first_seq, CASE WHEN status = 'active' AND (good OR seq < last_start) THEN 'completed' ELSE status END status FROM m WHERE rn = 1
"""


def stage_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _request("c_custkey")
    c = read(spark, sf_dir, "customer")
    sources, chunks, ranked, assessed = _sources(spark, sf_dir)
    people = c.select(r.alias("request_id"), F.when(F.col("c_acctbal") > 3000, "core").otherwise("discovery").alias("candidate_type"), (F.col("c_custkey") % 4 > 0).alias("kept"))
    short = sources.select("request_id", F.element_at(F.array(*[F.lit(b) for b in fixed.BUCKETS]), (F.col("ord") % 5 + 1).cast("int")).alias("bucket"))
    names = c.select(r.alias("request_id"), (F.col("c_custkey") % 9).alias("mentions"))
    proof = read(spark, sf_dir, "orders").select(_request("o_custkey").alias("request_id"), F.col("o_custkey").alias("entity"), F.col("o_orderpriority").alias("source_url"))
    way = {"plans": _plans(names), "queries": names, "results": chunks, "shortlist": short, "sources": sources, "chunks": chunks, "ranked": ranked.withColumn("source_id", F.substring_index("chunk_id", "#", 1)), "candidates": names, "assessed": assessed, "evidence": proof, "entities": people, "fields": base._fields(spark, sf_dir), "rows": names}
    return report.figures(**way)


_FIGURES_SQL = base._FIELDS_SQL + """,
p AS (SELECT page_id n, 'r' || (page_id % 3) request_id FROM pages), h AS (SELECT p.*, i.range i, NOT (i.range = 2 AND n % 7 = 0) full_ FROM p CROSS JOIN range(3) i),
u AS (SELECT 'r' || (c_custkey % 3) request_id, c_custkey k, c_acctbal > 3000 core, c_custkey % 4 > 0 kept FROM customer), o AS (SELECT 'r' || (o_custkey % 3) request_id, o_custkey, o_orderpriority FROM orders),
x AS (SELECT request_id, 'columnsSelected' AS key, 4 AS value FROM u GROUP BY 1 UNION ALL SELECT request_id, 'queriesRun', count(*) FROM u GROUP BY 1 UNION ALL SELECT request_id, 'sourcesFound', count(*) FROM h GROUP BY 1 UNION ALL SELECT request_id, 'shortlisted', count(*) FROM p GROUP BY 1
    UNION ALL SELECT request_id, b.key, count(*) FILTER (n % 5 = b.i) FROM p CROSS JOIN (VALUES ('officialSources', 0), ('profileSources', 1), ('editorialReferenceSources', 2), ('roundupSources', 3), ('transactionalSources', 4)) b(key, i) GROUP BY ALL
    UNION ALL SELECT request_id, 'sourcesProcessed', count(*) FROM p GROUP BY 1 UNION ALL SELECT request_id, 'relevantDetailsFound', count(*) FILTER (full_) FROM h GROUP BY 1 UNION ALL SELECT request_id, 'passagesScored', count(*) FROM h GROUP BY 1
    UNION ALL SELECT request_id, 'passagesSelected', count(*) FILTER ((n + i) % 2 = 0) FROM h GROUP BY 1 UNION ALL SELECT request_id, 'sourcesRepresented', count(DISTINCT n) FILTER ((n + i) % 2 = 0) FROM h GROUP BY 1
    UNION ALL SELECT request_id, 'preliminaryCandidates', count(*) FROM u GROUP BY 1 UNION ALL SELECT request_id, 'mentionsFound', sum(k % 9) FROM u GROUP BY 1
    UNION ALL SELECT request_id, 'sourcesReviewed', count(*) FROM p WHERE n % 6 <> 0 GROUP BY 1 UNION ALL SELECT request_id, 'filteredOut', count(*) FILTER (n % 11 = 0) FROM p WHERE n % 6 <> 0 GROUP BY 1 UNION ALL SELECT request_id, 'usedForEvidence', count(*) FILTER (n % 11 <> 0 AND n % 3 <> 2 AND n % 4 <> 2) FROM p WHERE n % 6 <> 0 GROUP BY 1
    UNION ALL SELECT request_id, 'candidatesWithEvidence', count(DISTINCT o_custkey) FROM o GROUP BY 1 UNION ALL SELECT request_id, 'supportingSourcesLinked', count(DISTINCT o_orderpriority) FROM o GROUP BY 1
    UNION ALL SELECT request_id, b.key, count(*) FILTER (core = b.c AND kept = b.k) FROM u CROSS JOIN (VALUES ('coreCandidatesKept', true, true), ('discoveryCandidatesKept', false, true), ('coreCandidatesFiltered', true, false), ('discoveryCandidatesFiltered', false, false)) b(key, c, k) GROUP BY ALL
    UNION ALL SELECT request_id, 'profilesBuilt', count(DISTINCT entity) FROM f GROUP BY 1 UNION ALL SELECT request_id, 'missingFields', count(*) FILTER (value IS NULL) FROM f GROUP BY 1 UNION ALL SELECT request_id, 'rowsReady', count(*) FROM u GROUP BY 1),
l AS (SELECT * FROM (VALUES """ + ", ".join(f"('{s}', '{k}', '{t}')" for s, k, t in fixed.METRICS) + """) v(stage, key, label))
SELECT request_id, stage, key, label, value::BIGINT AS value FROM x JOIN l USING (key)
"""


# ---- what is shown and logged

def top_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = read(spark, sf_dir, "lineitem").groupBy(F.concat(F.lit("r"), F.col("l_suppkey")).alias("request_id"), F.concat(F.lit("P"), F.col("l_partkey") % 50).alias("name")).agg(F.count("*").alias("mentions"))
    return report.top_candidates(n).select("request_id", F.col("position").cast("int").alias("position"), "name", "mentions")


_TOPC_SQL = "SELECT request_id, position, name, mentions FROM (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY mentions DESC, lower(name))::INT position FROM (SELECT 'r' || l_suppkey request_id, 'P' || (l_partkey % 50) AS name, count(*) mentions FROM lineitem GROUP BY ALL)) WHERE position <= 10"


def selected_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of orders, several of one url."""
    o = read(spark, sf_dir, "orders").select(_request("o_custkey", 10).alias("request_id"), F.col("o_orderkey").cast("string").alias("source_id"), F.concat(F.lit("u"), F.col("o_orderkey") % 40).alias("url"), F.col("o_orderkey").alias("rank"), (F.col("o_orderstatus") == "F").alias("selected"))
    return report.selected_sources(o.select("request_id", "source_id", "rank", "selected"), o.select("request_id", "source_id", "url")).select("request_id", F.col("position").cast("int").alias("position"), "url")


_SELECTED_SQL = "SELECT request_id, row_number() OVER (PARTITION BY request_id ORDER BY rank, url)::INT position, url FROM (SELECT 'r' || (o_custkey % 10) request_id, 'u' || (o_orderkey % 40) url, min(o_orderkey) rank FROM orders WHERE o_orderstatus = 'F' GROUP BY ALL)"


def populated_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.populated_columns(base._fields(spark, sf_dir)).select("request_id", F.array_join("columns", ",").alias("columns"))


_POPULATED_SQL = base._FIELDS_SQL + """SELECT request_id, string_agg(DISTINCT "column", ',' ORDER BY "column") columns FROM f WHERE value IS NOT NULL GROUP BY 1"""


def table_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = base._fields(spark, sf_dir).withColumn("confidence", (F.col("entity_ord") % 100) / 100)
    return report.overall_confidence(f, tables.visible_columns(f))


_CONFIDENCE_SQL = base._FIELDS_SQL + """,
g AS (SELECT request_id, "column", count(value) got, count(DISTINCT entity) n FROM f GROUP BY ALL), v AS (SELECT request_id, "column" FROM g WHERE n < 3 OR "column" = 'name' OR got / n::DOUBLE > 0.3),
z AS (SELECT v.request_id, coalesce(round(avg(CASE WHEN value IS NOT NULL THEN (entity_ord % 100) / 100.0::DOUBLE END), 6), 0) confidence FROM v LEFT JOIN f USING (request_id, "column") GROUP BY 1)
SELECT request_id, confidence, floor(confidence * 100 + 0.5)::INT AS "percent" FROM z"""


def shown_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plain, yes-or-no and list values as a table shows them."""
    k = F.col("c_custkey")
    f = read(spark, sf_dir, "customer").select(_request("c_custkey").alias("request_id"), k.cast("string").alias("entity"), F.lit(0.5).alias("confidence"), F.explode(F.create_map(F.lit("name"), F.lower("c_name"), F.lit("is_open"), F.when(k % 2 == 0, "true").otherwise("false"), F.lit("home_link"), F.to_json(F.array(F.lower("c_mktsegment"), F.lit("b"))), F.lit("staff_size"), F.when(k % 2 > 0, k.cast("string")))).alias("column", "value"))
    return report.shown_cells(f, tables.visible_columns(f)).select("request_id", "entity", "column", "label", "type", "text")


_SHOWNC_SQL = """
SELECT 'r' || (c_custkey % 3) request_id, c_custkey::VARCHAR entity, x."column", x.label, x.type, CASE x."column" WHEN 'name' THEN upper(substring(lower(c_name), 1, 1)) || substring(lower(c_name), 2) WHEN 'is_open' THEN CASE WHEN c_custkey % 2 = 0 THEN 'Yes' ELSE 'No' END
    WHEN 'home_link' THEN upper(substring(c_mktsegment, 1, 1)) || lower(substring(c_mktsegment, 2)) || ', b' ELSE CASE WHEN c_custkey % 2 > 0 THEN c_custkey::VARCHAR END END AS text
FROM customer CROSS JOIN (VALUES ('name', 'Name', 'text'), ('is_open', 'Is Open', 'text'), ('home_link', 'Home Link', 'url'), ('staff_size', 'Staff Size', 'number')) x("column", label, type)
"""


def shown_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    items = read(spark, sf_dir, "orders").select(_request("o_custkey", 10).alias("request_id"), F.col("o_custkey").alias("entity_ord"), F.lit(0).alias("column_ord"), k.alias("evidence_ord"), F.concat(F.lit("https://www.h"), k % 30, F.lit(".org/p")).alias("url"), F.concat(F.lit("t"), k).alias("title"), F.element_at(F.array(*[F.lit(x) for x in ("official", "near_official", "low_quality", "third_party")]), (k % 4 + 1).cast("int")).alias("officiality"))
    return report.shown_sources(items).select("request_id", F.col("position").cast("int").alias("position"), "url", "domain", "title", "type")


_SHOWNS_SQL = """
WITH o AS (SELECT 'r' || (o_custkey % 10) request_id, 'h' || (o_orderkey % 30) || '.org' d, o_custkey c, o_orderkey k, row_number() OVER (PARTITION BY o_custkey % 10, o_orderkey % 30 ORDER BY o_custkey, o_orderkey) rn FROM orders)
SELECT request_id, row_number() OVER (PARTITION BY request_id ORDER BY c, k)::INT position, 'https://www.' || d || '/p' url, d AS "domain", 't' || k title, ['official', 'profile', 'article', 'article'][k % 4 + 1] AS type FROM o WHERE rn = 1
"""


def table_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One JSON object a nation, read back: columns, rows and the first row's name."""
    f = base._fields(spark, sf_dir).join(read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("entity_ord"), F.concat(F.lit("n"), "c_nationkey").alias("nation")), "entity_ord")
    place = F.array_position(F.array(*[F.lit(c) for c in ("name", "segment", "balance", "website")]), F.col("column"))
    cells_ = f.select(F.col("nation").alias("request_id"), "entity", "column", place.alias("column_ord"), "value", F.lit(0.5).alias("confidence"), F.array(F.lit("u")).alias("source_urls"))
    names = f.where("column = 'name'").select(F.col("nation").alias("request_id"), "entity", F.col("entity_ord").alias("position"), F.col("value").alias("name"))
    kind = "struct<inferred_schema:struct<columns:array<struct<key:string,label:string,type:string>>>,final_top_10_rows:array<struct<name:string,fields:map<string,struct<value:string,confidence:double,source_urls:array<string>>>>>>"
    j = report.export(cells_, names).select("request_id", F.from_json("json", kind).alias("j"))
    first = F.element_at("j.final_top_10_rows", 1)
    return j.select("request_id", F.array_join(F.transform("j.inferred_schema.columns", lambda c: F.concat_ws("/", c["key"], c["label"], c["type"])), ",").alias("columns"), F.size("j.final_top_10_rows").alias("rows"), F.coalesce(first["name"], F.lit("-")).alias("first"), F.coalesce(first["fields"]["segment"]["value"], F.lit("-")).alias("segment"))


_EXPORT_SQL = """
WITH c AS (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) rn FROM customer)
SELECT 'n' || c_nationkey request_id, 'name/Name/text,segment/Segment/text,balance/Balance/text,website/Website/url' columns, count(*)::INT AS rows, coalesce(max(CASE WHEN rn = 1 THEN nullif(c_name, 'Customer#000000003') END), '-') AS first, coalesce(max(CASE WHEN rn = 1 AND c_mktsegment <> 'BUILDING' THEN c_mktsegment END), '-') AS segment FROM c GROUP BY c_nationkey
"""


def bucket_rows_new(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of pages with a decision, without those that orders' pages have already."""
    n = F.col("page_id")
    p = read(spark, sf_dir, "pages").select("page_id", F.lit("q").alias("normalized_query"), F.concat(F.lit("u"), n % 200).alias("url"))
    decided = p.where("page_id % 3 = 0").select("url").distinct()
    old = read(spark, sf_dir, "orders").select(F.lit("q").alias("normalized_query"), F.concat(F.lit("u"), F.col("o_orderkey") % 200).alias("url")).where("o_orderkey % 10 = 0").distinct()
    return jsonl.new_rows(p.join(decided, "url", "left_semi"), old, ["normalized_query", "url"], "page_id").select("page_id", "url")


_BUCKETROWS_SQL = """
WITH p AS (SELECT page_id, 'u' || (page_id % 200) url FROM pages)
SELECT min(page_id) page_id, url FROM p WHERE url IN (SELECT url FROM p WHERE page_id % 3 = 0) AND url NOT IN (SELECT 'u' || (o_orderkey % 200) FROM orders WHERE o_orderkey % 10 = 0) GROUP BY url
"""


def stage_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns named after brands and types, as stage events and as the table show them."""
    p = read(spark, sf_dir, "part").select("p_partkey", F.concat_ws("_", F.lower("p_type"), F.regexp_replace("p_name", " ", "_"), F.element_at(F.array(*[F.lit(x) for x in ("url", "website", "date", "size", "updated_at", "x")]), (F.col("p_partkey") % 6 + 1).cast("int"))).alias("key"))
    k = F.col("key")
    return p.select("p_partkey", T.title_label(k).alias("label"), T.event_column_type(k).alias("event_type"), T.column_type(k).alias("type"))


_COLUMNS_SQL = """
WITH p AS (SELECT p_partkey k, lower(p_type) || '_' || replace(p_name, ' ', '_') || '_' || ['url', 'website', 'date', 'size', 'updated_at', 'x'][p_partkey % 6 + 1] "key" FROM part)
SELECT k p_partkey, array_to_string(list_transform(string_split(replace("key", '_', ' '), ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') AS label, CASE WHEN k % 6 = 0 THEN 'url' ELSE 'text' END event_type, ['url', 'url', 'date', 'number', 'date', 'text'][k % 6 + 1] AS type FROM p
"""

def entity_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.entity_log(base._ranked(plan.stored(base._evidence(spark, sf_dir)))).select("request_id", F.col("n").cast("int").alias("n"), "name", "kept", "candidate_type", "final_score", "support_score", "alignment")


_ELOG_SQL = base._RANKING_SQL.replace("SELECT request_id, entity, support_score, alignment, final_score,", "SELECT request_id, row_number() OVER (PARTITION BY request_id ORDER BY final_score >= 0.3 OR top < 0.3 DESC, final_score DESC, support_score DESC, alignment DESC, entity)::INT n, entity AS name, CASE WHEN final_score >= 0.3 OR top < 0.3 THEN 'yes' ELSE 'no' END kept, round(final_score::DECIMAL(12, 7), 4)::DOUBLE final_score, round(support_score::DECIMAL(12, 7), 4)::DOUBLE support_score, round(alignment::DECIMAL(12, 7), 4)::DOUBLE alignment,")
_ELOG_SQL = _ELOG_SQL[: _ELOG_SQL.rindex("END candidate_type") + len("END candidate_type")] + " FROM (SELECT *, max(final_score) OVER (PARTITION BY request_id) top FROM q)"


def cell_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chosen passages for cells; the sources of every third document are not known."""
    n = F.col("doc_id")
    sources = read(spark, sf_dir, "documents").select(F.concat(F.lit("r"), n % 4).alias("request_id"), F.lpad(n.cast("string"), 8, "0").alias("source_id"), F.when(n % 3 > 0, F.concat(F.lit("u"), n)).alias("url"), F.when(n % 3 > 0, F.concat(F.lit("t"), n)).alias("title"))
    return report.cell_log(tables.choose_chunks(_cells(spark, sf_dir)), sources.where("url is not null")).select("request_id", "entity", "column", "position", "score", "source_url", "source_title")


_CLOG_SQL = _CELLS + """,
ch AS (SELECT *, split_part(chunk_id, '#', 1)::BIGINT d, row_number() OVER (PARTITION BY request_id, entity, "column" ORDER BY score DESC, chunk_id)::INT position FROM y)
SELECT request_id, entity, "column", position, round(score::DECIMAL(12, 7), 4)::DOUBLE score, CASE WHEN d % 3 > 0 THEN 'u' || d ELSE '' END source_url, CASE WHEN d % 3 > 0 THEN 't' || d ELSE '' END source_title FROM ch WHERE position <= 3
"""


def prior_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as ranked names: those with orders have been extracted, some of the others are known from before."""
    k = F.col("c_custkey")
    names = read(spark, sf_dir, "customer").select(_request("c_custkey").alias("request_id"), k.cast("string").alias("entity"), k)
    prior = names.where("c_custkey % 2 = 0").select("request_id", "entity", F.lit("segment").alias("column"), F.lit(1).alias("column_ord"), F.lit("old").alias("value"), F.lit(0.1).alias("confidence"), F.expr("cast(array() as array<struct<source_url:string,source_title:string,supporting_snippet:string,source_role:string,source_quality:string,officiality:string>>)").alias("evidence"), F.lit(False).alias("provisional"))
    out = answers.with_prior(names.select("request_id", "entity"), _orders_as_evidence(spark, sf_dir), _extracted(spark, sf_dir), prior, _plans(names))
    return out.select("request_id", "entity", "column", "value", "provisional")


_PRIOR_SQL = _EXTRACTED + """, n AS (SELECT c_custkey k, 'r' || (c_custkey % 3) request_id, c_custkey::VARCHAR entity FROM customer), f AS (SELECT * FROM n ANTI JOIN e USING (k))
SELECT x.request_id, x.entity, x."column", value, provisional FROM x JOIN n USING (k) UNION ALL SELECT request_id, entity, 'segment', 'old', false FROM f WHERE k % 2 = 0
    UNION ALL SELECT request_id, entity, unnest(['name', 'segment', 'balance', 'website']), NULL, true FROM f WHERE k % 2 > 0
"""


def canonical_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = answers.canonical(_extracted(spark, sf_dir))
    return c.select("request_id", "name", F.col("fields")["segment"]["value"].alias("segment"), F.col("fields")["website"]["confidence"].alias("website_confidence"), F.size("fields").alias("columns"), F.size("source_urls").alias("urls"))


_CANON_SQL = _EXTRACTED + """, w AS (SELECT k, max(CASE WHEN "column" = 'name' AND value IS NOT NULL THEN urls END) u1, max(CASE WHEN "column" = 'segment' AND value IS NOT NULL THEN split_part(urls, ',', 1) END) u2 FROM x GROUP BY 1)
SELECT request_id, entity AS name, max(CASE WHEN "column" = 'segment' THEN value END) segment, max(CASE WHEN "column" = 'website' THEN CASE WHEN value IS NULL THEN 0.0 ELSE 0.25 END END)::DOUBLE website_confidence, 4 AS columns, (CASE WHEN any_value(u1) IS NULL THEN 0 WHEN any_value(u2) IS NULL OR any_value(u2) = any_value(u1) THEN 1 ELSE 2 END)::INT urls FROM x JOIN w USING (k) GROUP BY request_id, entity
"""


def plan_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as plans: preferred variants in order, and how many count."""
    k = F.col("p_partkey")
    p = read(spark, sf_dir, "part").select(F.concat(F.lit("r"), k).alias("request_id"), F.concat(F.lit(" "), "p_name").alias("normalized_query"), F.when(k % 2 == 0, F.col("p_name")).otherwise(F.col("p_type")).alias("base_query"), F.when(k % 3 == 0, F.array(F.lit(" "), F.col("p_brand"), F.col("p_type"))).otherwise(F.array(F.lit(""))).alias("rewrites"))
    every = entities.preferred_variants(p).groupBy("request_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "variant"))), lambda x: x["variant"]), "|").alias("variants"))
    return every.join(entities.variant_totals(p), "request_id").select("request_id", "variants", "total_variants")


_VARIANTSP_SQL = """
SELECT 'r' || p_partkey request_id, p_name || CASE WHEN p_partkey % 2 > 0 THEN '|' || p_type ELSE '' END || CASE WHEN p_partkey % 3 = 0 THEN '|' || p_brand || CASE WHEN p_partkey % 2 = 0 THEN '|' || p_type ELSE '' END ELSE '' END variants,
    (1 + CASE WHEN p_partkey % 3 = 0 THEN CASE WHEN p_partkey % 2 = 0 THEN 2 ELSE 1 END ELSE 0 END)::INT total_variants FROM part
"""


def pass_through_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    sources, chunks, _, _ = _sources(spark, sf_dir)
    return store.pass_through_ranking(sources, chunks).select("request_id", "chunk_id", F.col("rank").cast("int").alias("rank"), "final_score", "selected")


_PASS_SQL = "SELECT 'r' || (page_id % 3) request_id, 's' || page_id || '#' || i.range chunk_id, row_number() OVER (PARTITION BY page_id % 3 ORDER BY page_id, i.range)::INT rank, 0.0::DOUBLE final_score, true selected FROM pages CROSS JOIN range(3) i"


def queries_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders").select(_request("o_custkey", 50).alias("request_id"), F.when(F.col("o_orderkey") % 9 > 0, F.array("o_orderpriority", "o_orderstatus")).otherwise(F.array().cast("array<string>")).alias("query_sources"))
    return results.queries_seen(o).select("request_id", "total")


_SEEN_SQL = "SELECT 'r' || (o_custkey % 50) request_id, greatest(count(DISTINCT q), 1) total FROM (SELECT o_custkey, unnest(CASE WHEN o_orderkey % 9 > 0 THEN [o_orderpriority, o_orderstatus] ELSE [NULL] END) q FROM orders) GROUP BY 1"


def shown_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as evidence: badges, confidence band and percent, and whether their request has few rows."""
    k = F.col("o_orderkey")
    o = read(spark, sf_dir, "orders").select(F.concat(F.lit("r"), "o_custkey").alias("request_id"), k, ((k % 100) / 100).alias("c"), report.badges(F.element_at(F.array(*[F.lit(x) for x in ("official", "near_official", "low_quality", "third_party")]), (k % 4 + 1).cast("int")), F.element_at(F.array(*[F.lit(x) for x in ("high", "medium", "low")]), (k % 3 + 1).cast("int"))).alias("b"))
    few = report.few_rows(o.select("request_id")).select("request_id", "notice")
    return o.join(few, "request_id").select("o_orderkey", "b.source", "b.quality", T.confidence_band(F.col("c")).alias("band"), report.percent(F.col("c")).alias("percent"), "notice")


_LABELS_SQL = """
SELECT o_orderkey, ['Official', 'Profile', 'Third-party', 'Article'][o_orderkey % 4 + 1] AS source, ['High', 'Medium', 'Low'][o_orderkey % 3 + 1] || ' quality' quality, CASE WHEN o_orderkey % 100 < 70 THEN 'low' WHEN o_orderkey % 100 < 90 THEN 'medium' ELSE 'high' END band,
    floor((o_orderkey % 100) / 100.0::DOUBLE * 100 + 0.5)::INT AS "percent", count(*) OVER (PARTITION BY o_custkey) < 3 notice FROM orders
"""


def column_previews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Planned columns of parts, as the planner's event and the loading table show them."""
    p = read(spark, sf_dir, "part").select(F.concat(F.lit("r"), "p_partkey").alias("request_id"), F.array(F.lit("name"), F.concat_ws("_", F.lower("p_type"), F.lit("url"))).alias("schema_columns"))
    dots = F.from_json("json", "final_top_10_rows array<struct<name:string,fields:map<string,struct<value:string>>>>")["final_top_10_rows"][0]
    loading = report.loading_preview(p).select("request_id", F.size(dots["fields"]).alias("cells"), dots["name"].alias("dots"))
    return report.schema_preview(p).join(loading, "request_id").select("request_id", F.col("place").cast("int").alias("place"), "key", "label", "type", "cells", "dots")


_PREVIEWS_SQL = """
SELECT 'r' || p_partkey request_id, x.place::INT place, CASE WHEN x.place = 0 THEN 'name' ELSE lower(p_type) || '_url' END "key", CASE WHEN x.place = 0 THEN 'Name' ELSE upper(p_type[1]) || lower(p_type[2:]) || ' Url' END AS label, CASE WHEN x.place = 0 THEN 'text' ELSE 'url' END AS type, 2 cells, '...' dots FROM part CROSS JOIN (VALUES (0), (1)) x(place)
"""


def line_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Common tokens of the first two and the last two lines of each document, over the larger set."""
    t = read(spark, sf_dir, "documents").select("doc_id", F.split("text", "\n").alias("l"))
    at = lambda i: T.token_list(F.try_element_at("l", F.lit(i)))
    return t.select("doc_id", F.round(T.overlap_ratio(at(1), at(2)), 6).alias("first"), F.round(T.overlap_ratio(at(-1), at(-2)), 6).alias("last"))


_OVERLAPS_SQL = """
WITH t AS (SELECT doc_id, string_split(text, chr(10)) l FROM documents), k AS (SELECT doc_id, list_transform([l[1], l[2], l[-1], l[-2]], lambda x: list_distinct(regexp_extract_all(lower(coalesce(x, '')), '[a-z0-9]+'))) a FROM t)
SELECT doc_id, coalesce(round(len(list_intersect(a[1], a[2]))::DOUBLE / nullif(greatest(len(a[1]), len(a[2])), 0), 6), 0) AS "first", coalesce(round(len(list_intersect(a[3], a[4]))::DOUBLE / nullif(greatest(len(a[3]), len(a[4])), 0), 6), 0) AS "last" FROM k
"""


def request_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole requests, from topic to table: the first words of every benchmark text as topics, all pages as the web."""
    words = F.filter(F.split(F.lower("text"), "[^\\p{L}]+"), lambda w: F.length(w) > 3)
    asked = read(spark, sf_dir, "benchmark").select(F.concat(F.lit("b"), "item_id").alias("request_id"), F.array_join(F.slice(words, 1, 3), " ").alias("query"), F.array(F.array_join(F.slice(words, 2, 2), " ")).alias("rewrites"))
    way = requests.run(asked, read(spark, sf_dir, "pages"))
    return way["table"].select("request_id", "entity", F.col("position").cast("int").alias("position"), "non_name", "all_fields", "urls")


_REGISTERED = {
    request_table: None, column_chunk_scores: _CELLS_SQL, column_chunks: _CHOSEN_SQL, evidence_records: _RECORDS_SQL, evidence_targets: _TARGETS_SQL, evidence_appended: _APPENDED_SQL, stop_entities: _STOPS_SQL,
    search_retry: _RETRY_SQL, column_queries: _COLQ_SQL, queries_sent: _SENT_SQL, plans_normalised: _PLANS_SQL, results_in_context: _CONTEXT_SQL, search_tokens_of_plans: _PTOK_SQL, search_answers: _SANSWERS_SQL, context_answers: _CANSWERS_SQL, reader_answers: _READER_SQL, context_queries: _CONTEXTQ_SQL,
    bucket_results: _BUCKETR_SQL, assessed_overrides: _OVERRIDE_SQL, extracted_fields: _EXTRACTED_SQL, repeated_answers: _REPEATED_SQL, typed_answers: _TYPED_SQL, entity_sources: _ESOURCES_SQL, facets_chosen: _FACETS_SQL, gap_updates: _GAPS_SQL, model_payloads: _PAYLOADS_SQL,
    run_lifecycle: _LIFECYCLE + "SELECT * FROM s", run_stage_states: _STATES_SQL, run_events_logged: _LIFECYCLE + "SELECT * FROM s", run_events_streamed: _STATES_SQL, stage_figures: _FIGURES_SQL, top_candidates: _TOPC_SQL, selected_sources: _SELECTED_SQL, populated_columns: _POPULATED_SQL,
    table_confidence: _CONFIDENCE_SQL, shown_cells: _SHOWNC_SQL, shown_sources: _SHOWNS_SQL, table_export: _EXPORT_SQL, bucket_rows_new: _BUCKETROWS_SQL, stage_columns: _COLUMNS_SQL,
    entity_log: _ELOG_SQL, cell_log: _CLOG_SQL, prior_fields: _PRIOR_SQL, canonical_rows: _CANON_SQL, plan_variants: _VARIANTSP_SQL, pass_through_ranks: _PASS_SQL, queries_seen: _SEEN_SQL, shown_labels: _LABELS_SQL, column_previews: _PREVIEWS_SQL, line_overlaps: _OVERLAPS_SQL,
}


def queries() -> dict:
    return {f.__name__: f for f in _REGISTERED}


def oracle_sql() -> dict[str, str]:
    return {f.__name__: s for f, s in _REGISTERED.items() if s}
