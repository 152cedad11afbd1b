"""The registered queries for the reference's own operators, with SQL for the same results.

The stored tables stand in for live inputs: pages for search results, documents for fetched texts, lineitem for evidence
(part = entity, supplier = source), customer and supplier for entity fields, events for run events.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import chunker, fixed
from ..functions import text as T
from ..operators import assess, entities, evidence, passages, plan, postings, results, stems, tables
from ..sources import jsonl
from ..sources.pages import read, search_results, spread
from ..streaming import runs

BASE, REWRITES = "ther erin thble", ["ther thnt", "erin ther thble"]
CANDIDATES = ["Eriner", "Anon", "Ther", "Erin", "Thor", "Anon The"]
PREFERRED = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


def _sql_list(values: list[str]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def _plans(spark: SparkSession) -> DataFrame:
    ids = spark.range(4).select(F.concat(F.lit("r"), F.col("id")).alias("request_id"))
    return ids.select("request_id", F.lit(BASE).alias("normalized_query"), F.lit(BASE).alias("base_query"), F.array(*[F.lit(r) for r in REWRITES]).alias("rewrites"))


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents as chunks of four requests."""
    docs = spread(read(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "text"))
    return docs.select(F.concat(F.lit("r"), F.col("doc_id") % 4).alias("request_id"), F.lpad(F.col("doc_id").cast("string"), 8, "0").alias("source_id"), F.concat(F.lpad(F.col("doc_id").cast("string"), 8, "0"), F.lit("#"), F.lpad(F.col("n").cast("string"), 5, "0")).alias("chunk_id"), "text")


def word_stems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of all documents that are inflected forms of others of them."""
    return stems.stems(stems.vocabulary(spread(read(spark, sf_dir, "documents").select("text"))))


def _stems_sql() -> str:
    cases = []
    for place, (ending, other) in enumerate(stems.RULES):
        root = f"left(term, length(term) - {len(ending)})"
        stem = f"CASE WHEN right({root}, 1) = left(right({root}, 2), 1) THEN left({root}, length({root}) - 1) END" if other is None else f"{root} || '{other}'"
        plural = " AND NOT regexp_matches(term, '(?:ss|us|is)$')" if ending == "s" else ""
        cases.append(f"SELECT term, {place} place, {stem} stem FROM v WHERE ends_with(term, '{ending}') AND length(term) > {len(ending) + 1}{plural}")
    return rf"""
WITH v AS (SELECT DISTINCT term FROM (SELECT unnest(regexp_extract_all(lower(translate(text, '’‘`“”–—', '""--')), '[\p{{L}}\p{{N}}_]+')) term FROM documents) WHERE NOT list_contains({_sql_list(fixed.RETRIEVAL_STOPWORDS)}, term)),
p AS ({" UNION ALL ".join(cases)})
SELECT term, arg_min(stem, place) stem FROM p WHERE length(stem) >= 3 AND stem IN (SELECT term FROM v) GROUP BY term
"""


def chunk_rank_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.rank_passages(_chunks(spark, sf_dir), _plans(spark))


_CHUNK_SQL = rf"""
WITH c AS (SELECT 'r' || (doc_id % 4) request_id, lpad(doc_id::VARCHAR, 8, '0') source_id, lpad(doc_id::VARCHAR, 8, '0') || '#' || lpad((g - 1)::VARCHAR, 5, '0') chunk_id, l AS txt
    FROM (SELECT doc_id, unnest(string_split(text, chr(10))) l, generate_subscripts(string_split(text, chr(10)), 1) g FROM documents) WHERE trim(l) <> ''),
t AS (SELECT request_id, source_id, chunk_id, list_filter(regexp_extract_all(lower(txt), '[\p{{L}}\p{{N}}_]+'), lambda x: NOT list_contains({_sql_list(fixed.RETRIEVAL_STOPWORDS)}, x)) tok FROM c),
v AS (SELECT * FROM (VALUES ('base', ['ther', 'erin', 'thble']), ('rewrite_1', ['ther', 'thnt']), ('rewrite_2', ['erin', 'ther', 'thble'])) x(label, q)),
st AS (SELECT request_id, count(*) n, avg(len(tok)) avgdl FROM t GROUP BY 1),
vt AS (SELECT label, unnest(q) term FROM v),
p AS (SELECT request_id, chunk_id, len(tok) dl, unnest(tok) term FROM t),
tf AS (SELECT request_id, chunk_id, dl, term, count(*) tf FROM p WHERE term IN ('ther', 'erin', 'thble', 'thnt') GROUP BY ALL),
df AS (SELECT request_id, term, count(*) df FROM tf GROUP BY ALL),
raw AS (SELECT request_id, label, chunk_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf / (tf + 1.5 * (1 - 0.75 + 0.75 * dl / avgdl))), 9) raw
    FROM tf JOIN df USING (request_id, term) JOIN st USING (request_id) JOIN vt USING (term) GROUP BY ALL),
sc AS (SELECT request_id, chunk_id, label, raw / max(raw) OVER (PARTITION BY request_id, label) s FROM raw)
"""
_CHUNK_RANK_SQL = _CHUNK_SQL + """,
w AS (SELECT request_id, chunk_id, coalesce(max(s) FILTER (label = 'base'), 0) b, coalesce(max(s) FILTER (label = 'rewrite_1'), 0) r1, coalesce(max(s) FILTER (label = 'rewrite_2'), 0) r2 FROM sc GROUP BY ALL),
a AS (SELECT t.request_id, t.source_id, t.chunk_id, ' ' || array_to_string(tok, ' ') || ' ' body, coalesce(b, 0) b, coalesce(r1, 0) r1, coalesce(r2, 0) r2 FROM t LEFT JOIN w USING (request_id, chunk_id)),
e AS (SELECT *, greatest(r1, r2) best, CASE WHEN r1 > r2 THEN 'rewrite_1' ELSE 'rewrite_2' END best_query,
    greatest(CASE WHEN contains(body, ' ther erin thble ') THEN 1.0 WHEN contains(body, ' ther erin ') OR contains(body, ' erin thble ') THEN 2.0 / 3 WHEN contains(body, ' ther ') OR contains(body, ' erin ') OR contains(body, ' thble ') THEN 1.0 / 3 ELSE 0 END,
      CASE WHEN contains(body, ' ther thnt ') THEN 1.0 WHEN contains(body, ' ther ') OR contains(body, ' thnt ') THEN 0.5 ELSE 0 END,
      CASE WHEN contains(body, ' erin ther thble ') THEN 1.0 WHEN contains(body, ' erin ther ') OR contains(body, ' ther thble ') THEN 2.0 / 3 WHEN contains(body, ' erin ') OR contains(body, ' ther ') OR contains(body, ' thble ') THEN 1.0 / 3 ELSE 0 END)::DOUBLE span, contains(body, ' ther ')::INT::DOUBLE anchor FROM a),
f AS (SELECT *, CASE WHEN best > 0 THEN (r1 >= 0.8 * best)::INT + (r2 >= 0.8 * best)::INT ELSE 0 END cov FROM e),
g AS (SELECT *, round((0.45 * b + 0.25 * best + 0.1 * (cov / 2.0) + 0.1 * span + 0.1 * anchor)::DOUBLE, 6) final_score FROM f),
h AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY final_score DESC, source_id, chunk_id)::INT rank FROM g)
SELECT request_id, rank, source_id, chunk_id, final_score, best_query, cov::INT coverage_count, round(b::DOUBLE, 6) base_score, round(best::DOUBLE, 6) best_rewrite_score, (cov / 2.0)::DOUBLE coverage_score, round(span, 6) span_score, anchor anchor_score
FROM h WHERE rank <= 24
"""


def bm25_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = passages.variants(_plans(spark))
    index = postings.build(postings.tokenised(_chunks(spark, sf_dir)), postings.terms_of(asked, "tokens"))
    return postings.bm25(index, asked).select("request_id", "label", "chunk_id", F.round("score", 6).alias("score"))


_BM25_SQL = _CHUNK_SQL + "SELECT request_id, label, chunk_id, round(s::DOUBLE, 6) score FROM sc"


def text_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = T.strip_html(F.col("html"))
    arr = lambda a: F.array_join(F.sort_array(a), " ")
    return read(spark, sf_dir, "pages").select("page_id", body.alias("b")).select("page_id", arr(T.search_tokens(F.col("b"))).alias("search_tokens"), arr(T.plain_tokens(F.col("b"))).alias("plain_tokens"), T.compact(F.col("b")).alias("compact"), F.array_join(T.token_list(F.col("b")), " ").alias("token_list"))


_RESULTS_SQL = r"""
WITH p AS (SELECT page_id, url, 'r' || (page_id % 3) request_id, html, floor(page_id / 3)::BIGINT k FROM pages),
s0 AS (SELECT *, regexp_extract(html, '<title>([^<]*)</title>', 1) t, CASE WHEN len(string_split(html, '</h1>')) > 1 THEN string_split(html, '</h1>')[2] ELSE '' END b FROM p),
s AS (SELECT page_id, url, request_id, k, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)) domain,
    trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(t, '<[^>]+>', ' ', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'), '\s+', ' ', 'g')) title,
    substring(trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(b, '<[^>]+>', ' ', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'), '\s+', ' ', 'g')), 1, 200) snippet FROM s0),
r AS (SELECT request_id, page_id * 3 + q.range AS ord, url, title, snippet, domain, 'q' || q.range query, row_number() OVER (PARTITION BY request_id, q.range ORDER BY page_id) rank
    FROM s CROSS JOIN range(3) q WHERE k % (q.range + 1) = 0)
"""
_TOKENS_SQL = rf"""
WITH b AS (SELECT page_id, lower(trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'), '\s+', ' ', 'g'))) body FROM pages),
k AS (SELECT page_id, body, regexp_extract_all(body, '[a-z0-9]+') tok FROM b)
SELECT page_id, coalesce(array_to_string(list_sort(list_distinct(list_filter(tok, lambda x: len(x) > 1 AND NOT list_contains({_sql_list(fixed.SEARCH_STOPWORDS)}, x)))), ' '), '') search_tokens,
    coalesce(array_to_string(list_sort(list_distinct(list_filter(tok, lambda x: len(x) > 1))), ' '), '') plain_tokens, regexp_replace(body, '[^a-z0-9]+', '', 'g') compact, coalesce(array_to_string(tok, ' '), '') token_list FROM k
"""


def text_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("url")
    return read(spark, sf_dir, "pages").select("page_id", T.host(u).alias("host"), T.path(u).alias("path"), T.segments(u).alias("segments"), T.host_core(u).alias("core"), T.official_path(u).alias("official"), T.low_host(u).alias("low"), T.third_party(u).alias("third"), T.social_post(u).alias("social"), T.display_domain(u).alias("display"))


def _any(text: str, parts: list[str]) -> str:
    return "(" + " OR ".join(f"contains({text}, '{p}')" for p in parts) + ")"


_URLS_SQL = rf"""
WITH a AS (SELECT page_id, url, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)) host, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1)) path FROM pages),
b AS (SELECT *, list_filter(string_split(host, '.'), lambda x: x <> '' AND NOT list_contains({_sql_list(fixed.GENERIC_SUBDOMAINS)}, x)) l FROM a)
SELECT page_id, host, path, len(list_filter(string_split(path, '/'), lambda x: x <> ''))::INT segments, regexp_replace(coalesce(array_to_string(CASE WHEN len(l) >= 2 THEN l[1:len(l) - 1] ELSE l END, ''), ''), '[^a-z0-9]+', '', 'g') core,
    {_any('path', fixed.OFFICIAL_PATHS)} official, {_any('host', fixed.LOW_HOSTS)} low, {_any('lower(url)', fixed.THIRD_PARTY)} third,
    ((suffix(host, 'twitter.com') AND contains(path, '/status/')) OR (suffix(host, 'facebook.com') AND contains(path, '/posts/')) OR (suffix(host, 'instagram.com') AND contains(path, '/p/')) OR (suffix(host, 'linkedin.com') AND NOT contains(path, '/company/') AND (contains(path, '/posts/') OR contains(path, '/feed/update/')))) social,
    regexp_replace(host, '^www\.', '') display FROM b
"""


def passage_cleanup(spark: SparkSession, sf_dir: str) -> DataFrame:
    clean = T.clean_passage(F.col("text"))
    return read(spark, sf_dir, "documents").select("doc_id", clean.alias("c")).select("doc_id", F.length("c").alias("n_clean"), T.truncate_passage(F.col("c"), 400).alias("head"))


_CLEANUP_SQL = rf"""
WITH l AS (SELECT doc_id, list_transform(string_split(regexp_replace(text, '(?i)\*\[Image([^\]]*)\]\*', '', 'g'), chr(10)), lambda x: trim(x)) a FROM documents),
k AS (SELECT doc_id, list_filter(a, lambda x: NOT regexp_matches(x, '^\|?\s*([-:]+\s*\|\s*)+[-:]*\|?$|^\|$') AND NOT regexp_matches(trim(regexp_replace(regexp_replace(x, '^[\s|#>*_-]+', ''), '[\s|#>*_-]+$', '')), '(?i)^({'|'.join(fixed.BOILERPLATE_LINES).replace("'", "''")})$') AND NOT (regexp_matches(x, '^[\[{{]') AND json_valid(x))) a FROM l),
c AS (SELECT doc_id, regexp_replace(regexp_replace(coalesce(array_to_string(a, chr(10)), ''), '\n{{3,}}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g') c FROM k),
h AS (SELECT *, substring(c, 1, 400) head, 400 - instr(reverse(substring(c, 1, 400)), ' ') stop FROM c)
SELECT doc_id, length(c)::INT n_clean, CASE WHEN length(c) <= 400 THEN c ELSE regexp_replace(CASE WHEN instr(head, ' ') > 0 AND stop >= 200 THEN substring(c, 1, stop) ELSE head END, '[\s.,;:-]+$', '') END head FROM h
"""


def _query_tokens(spark: SparkSession) -> DataFrame:
    ids = spark.range(3).select(F.concat(F.lit("r"), F.col("id")).alias("request_id"))
    return ids.select("request_id", T.search_tokens(F.lit("the and of " + BASE)).alias("query_tokens"), T.search_tokens(F.lit("reti inge aux leon heit")).alias("aspect_tokens"))


def _merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = results.prune(search_results(read(spark, sf_dir, "pages")), _query_tokens(spark))
    return results.shortlist_score(results.merge_by_url(found).withColumn("total", F.lit(3)), "total")


_PRUNED_SQL = _RESULTS_SQL + rf""",
f AS (SELECT *, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1)) path, list_filter(regexp_extract_all(lower(title || ' ' || snippet), '[a-z0-9]+'), lambda x: len(x) > 1) tok FROM r),
k AS (SELECT * FROM f WHERE trim(snippet) <> '' AND NOT {_any('lower(snippet)', fixed.BOILERPLATE_SNIPPETS)} AND NOT {_any('path', fixed.FILE_EXTENSIONS)} AND domain NOT IN ('youtube.com', 'www.youtube.com', 'vimeo.com', 'www.vimeo.com')
    AND NOT regexp_matches(lower(url), '\.(pdf|ppt|pptx|doc|docx)$')
    AND list_has_any(tok, ['ther', 'erin', 'thble', 'reti', 'inge', 'aux', 'leon', 'heit']))
"""
_MERGED_SQL = _PRUNED_SQL + """,
m AS (SELECT request_id, url, arg_min(title, rank * 1000000000 + ord) title, arg_min(snippet, rank * 1000000000 + ord) snippet, arg_min(domain, rank * 1000000000 + ord) AS domain, min(rank)::INT rank, count(DISTINCT query) nq, min(ord) first_seen, string_agg(DISTINCT query, ',' ORDER BY query) queries FROM k GROUP BY ALL),
sc AS (SELECT *, round((0.6 / sqrt(greatest(rank, 1)) + 0.4 * (nq / 3.0))::DOUBLE, 6) shortlist_score FROM m)
"""


def results_pruned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return results.prune(search_results(read(spark, sf_dir, "pages")), _query_tokens(spark)).select("request_id", "ord", "url", "domain", "query")


def results_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _merged(spark, sf_dir).select("request_id", "url", "domain", "rank", "first_seen", F.array_join(F.sort_array("query_sources"), ",").alias("queries"), "shortlist_score")


def shortlist_domain_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return results.shortlist(_merged(spark, sf_dir)).select("request_id", "url", "position", "shortlist_score")


_SHORTLIST_SQL = _MERGED_SQL + """,
d AS (SELECT *, row_number() OVER (PARTITION BY request_id, domain ORDER BY shortlist_score DESC, rank, first_seen, url) dn FROM sc),
o AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY shortlist_score DESC, rank, first_seen, url)::INT position FROM d WHERE dn <= 3)
SELECT request_id, url, position, shortlist_score FROM o WHERE position <= 15
"""


def _bucketed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _merged(spark, sf_dir).withColumn("bucket", results.bucket_of(F.col("title"), F.col("url")))


def shortlist_bucket_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return results.bucket_floor(_bucketed(spark, sf_dir)).select("request_id", "url", "bucket", "shortlist_score")


_FLOOR_SQL = _MERGED_SQL + rf""",
b AS (SELECT *, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1)) path FROM sc),
b2 AS (SELECT *, CASE WHEN regexp_matches(lower(title), '\b(best|top|list)\b') THEN 'roundup_list' WHEN {_any('path', fixed.OFFICIAL_PATHS)} OR path IN ('', '/') THEN 'official_entity'
    WHEN regexp_matches(path, 'book|ticket|search|shop') THEN 'transactional_listing' WHEN regexp_matches(path, 'profile|directory|/[0-9]+/?$') THEN 'profile_directory' ELSE 'editorial_reference' END bucket FROM b),
n AS (SELECT *, row_number() OVER (PARTITION BY request_id, bucket ORDER BY shortlist_score DESC, rank, first_seen, url) rn, CASE WHEN count(*) OVER (PARTITION BY request_id, bucket) >= 4 THEN 2 ELSE 1 END sure FROM b2),
z AS (SELECT *, max(CASE WHEN rn = sure THEN shortlist_score END) OVER (PARTITION BY request_id, bucket) bar FROM n)
SELECT request_id, url, bucket, shortlist_score FROM z WHERE rn <= sure OR shortlist_score >= 0.6 * bar
"""


def shortlist_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    return results.shortlist_by_query(_merged(spark, sf_dir), ["q0", "q1", "q2"])


def shortlist_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return results.shortlist_by_bucket(results.bucket_floor(_bucketed(spark, sf_dir)))


def _chain_sql(rows: str, steps: list[tuple[str, str]], order: str, skip: bool) -> str:
    """Greedy picks as a chain of tables, one a step: in each, every request takes its first row in `order` that the step's
    condition allows, that is not in `seen` and whose domain has room. skip: rows passed over are seen as well."""
    out = [f"g0 AS (SELECT DISTINCT request_id, []::VARCHAR[] urls, []::VARCHAR[] doms, []::VARCHAR[] seen FROM {rows})"]
    for i, (cond, _) in enumerate(steps):
        fits = "len(list_filter(g.doms, lambda x: x = lower(w.domain))) < 3 AND len(g.urls) < 15"
        passed = "coalesce(list(w.url) FILTER (p.pos IS NULL OR w.pos <= p.pos), [])" if skip else "[]::VARCHAR[]"
        out.append(f"""p{i} AS (SELECT w.request_id, arg_min(w.url, w.pos) url, arg_min(lower(w.domain), w.pos) dom, min(w.pos) pos FROM {rows} w JOIN g{i} g USING (request_id) WHERE {cond} AND NOT list_contains(g.seen, w.url) AND {fits} GROUP BY 1),
n{i} AS (SELECT w.request_id, {passed} passed FROM {rows} w JOIN g{i} g USING (request_id) LEFT JOIN p{i} p USING (request_id) WHERE {cond} AND NOT list_contains(g.seen, w.url) AND len(g.urls) < 15 GROUP BY 1),
g{i + 1} AS (SELECT g.request_id, CASE WHEN p.url IS NULL THEN g.urls ELSE list_append(g.urls, p.url) END urls, CASE WHEN p.url IS NULL THEN g.doms ELSE list_append(g.doms, p.dom) END doms, CASE WHEN p.url IS NULL THEN g.seen ELSE list_append(g.seen, p.url) END || coalesce(n.passed, []) seen FROM g{i} g LEFT JOIN p{i} p USING (request_id) LEFT JOIN n{i} n USING (request_id))""")
    last = f"g{len(steps)}"
    out.append(f"""rest AS (SELECT w.*, len(g.urls) taken, row_number() OVER (PARTITION BY w.request_id, lower(w.domain) ORDER BY {order}) + len(list_filter(g.doms, lambda x: x = lower(w.domain))) dn FROM {rows} w JOIN {last} g USING (request_id) WHERE NOT list_contains(g.seen, w.url)),
fill AS (SELECT request_id, url, "domain", taken + row_number() OVER (PARTITION BY request_id ORDER BY {order}) position FROM rest WHERE dn <= 3)
SELECT request_id, url, "domain", position::INT position FROM fill WHERE position <= 15 UNION ALL SELECT w.request_id, w.url, w."domain", list_position(g.urls, w.url)::INT FROM {last} g JOIN {rows} w USING (request_id) WHERE list_contains(g.urls, w.url)""")
    return ",\n".join(out)


_ORDER = "shortlist_score DESC, rank, first_seen, url"
#: Slots of the queries in turn: four, two and one of seven.
_QUOTA_SQL = _MERGED_SQL + f", w0 AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY {_ORDER}) pos FROM sc),\n" + _chain_sql("w0", [(f"contains(w.queries, '{q}')", q) for q in ("q0", "q1", "q2", "q0", "q1", "q0", "q0")], _ORDER, skip=False)
_BUCKETS_SQL = _FLOOR_SQL[: _FLOOR_SQL.rindex("SELECT request_id, url, bucket")].rstrip() + f", w0 AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY {_ORDER}) pos FROM z WHERE rn <= sure OR shortlist_score >= 0.6 * bar),\n" + _chain_sql("w0", [(f"w.bucket = '{b}'", b) for turn in range(max(fixed.BUCKET_CAPS)) for b, cap in zip(fixed.BUCKETS, fixed.BUCKET_CAPS) if turn < cap], "shortlist_score DESC, rank, url", skip=True)


def sources_assessed(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = search_results(read(spark, sf_dir, "pages")).where("query = 'q0'")
    df = df.withColumn("context_chars", (F.length("snippet") * (F.col("ord") % 3)).cast("int")).withColumn("fallback", F.col("ord") % 2 == 0).withColumn("candidates", F.array(F.lit("Spam Farm"), F.lit("Therin"), F.lit("The")))
    df = assess.assessed(assess.officiality(assess.quality(assess.signals(df, T.plain_tokens(F.lit("the and of " + BASE))))))
    return df.select("ord", "relevance_hint", "official_path_hint", "snippet_thinness_hint", "quality_score", "source_quality", "quality_confidence", "domain_match", "title_match", "officiality", "officiality_confidence", "filtered_out", "source_role", "evidence_sufficiency")


def _overlap_sql(a: str, b: str) -> str:
    shared = f"len(list_filter(list_distinct(string_split({a}, '')), lambda ch: contains({b}, ch)))::DOUBLE / len(list_distinct(string_split({a}, '')))"
    return f"CASE WHEN {a} = '' OR {b} = '' THEN 0.0 WHEN {a} = {b} THEN 1.0 WHEN contains({b}, {a}) OR contains({a}, {b}) THEN least(length({a}), length({b}))::DOUBLE / greatest(length({a}), length({b})) ELSE {shared} END"


_ASSESSED_SQL = _RESULTS_SQL + rf""",
a AS (SELECT *, list_distinct(list_filter(regexp_extract_all(lower(title || ' ' || snippet), '[a-z0-9]+'), lambda x: len(x) > 1)) tok, length(trim(snippet)) n, (length(snippet) * (ord % 3))::INT ctx, ord % 2 = 0 fb,
    lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)) host, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1)) path,
    list_filter(string_split(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)), '.'), lambda x: x <> '' AND NOT list_contains({_sql_list(fixed.GENERIC_SUBDOMAINS)}, x)) lab,
    regexp_replace(lower(title), '[^a-z0-9]+', '', 'g') ct, regexp_replace(lower(snippet), '[^a-z0-9]+', '', 'g') cs FROM r WHERE query = 'q0'),
b AS (SELECT *, round(len(list_intersect(tok, ['the', 'and', 'of', 'ther', 'erin', 'thble'])) / 6.0::DOUBLE, 6) relevance_hint, {_any('path', fixed.OFFICIAL_PATHS)} p, round(greatest(0.0, least(1.0, 1 - n / 80.0::DOUBLE)), 6) thin,
    {_any('host', fixed.LOW_HOSTS)} low, {_any("lower(title || ' ' || snippet || ' ' || url)", fixed.THIRD_PARTY)} third, regexp_replace(coalesce(array_to_string(CASE WHEN len(lab) >= 2 THEN lab[1:len(lab) - 1] ELSE lab END, ''), ''), '[^a-z0-9]+', '', 'g') core FROM a),
c AS (SELECT *, CASE WHEN n = 0 THEN -4 WHEN n < 80 THEN -2 ELSE 0 END + CASE WHEN relevance_hint < 0.05 THEN -3 WHEN relevance_hint < 0.12 THEN -1 WHEN relevance_hint >= 0.3 THEN 2 ELSE 0 END + CASE WHEN fb THEN -3 + CASE WHEN n < 80 THEN -2 ELSE 0 END + CASE WHEN ctx < 140 THEN -1 ELSE 0 END ELSE 0 END
    + CASE WHEN ctx < 80 THEN -2 WHEN ctx >= 240 THEN 1 ELSE 0 END + CASE WHEN low THEN -3 + CASE WHEN fb OR n = 0 THEN -2 ELSE 0 END ELSE 0 END + CASE WHEN length(path) > 90 OR len(list_filter(string_split(path, '/'), lambda x: x <> '')) > 6 THEN -1 ELSE 0 END sc,
    round(list_max(list_transform(['spamfarm', 'therin'], lambda y: {_overlap_sql('y', 'core')})), 6) d,
    round(list_max(list_transform(['spamfarm', 'therin'], lambda y: greatest(CASE WHEN ct = '' THEN 0.0 WHEN contains(ct, y) THEN 1.0 ELSE {_overlap_sql('y', 'ct')} END, CASE WHEN cs = '' THEN 0.0 WHEN contains(cs, y) THEN 1.0 ELSE {_overlap_sql('y', 'cs')} END))), 6) t FROM b),
e AS (SELECT *, CASE WHEN sc <= -3 THEN 'low' WHEN sc >= 2 THEN 'high' ELSE 'medium' END q, round(CASE WHEN sc <= -3 THEN least(0.98, 0.55 + abs(sc) * 0.1::DOUBLE) WHEN sc >= 2 THEN least(0.95, 0.5 + sc * 0.08::DOUBLE) ELSE greatest(0.45, least(0.78, 0.45 + least(abs(sc - 1), abs(sc + 2)) * 0.08::DOUBLE)) END::DOUBLE, 6) qc,
    CASE WHEN d >= 0.92 AND t >= 0.92 AND NOT third THEN 'official' WHEN t >= 0.72 AND (d >= 0.78 OR p) THEN 'near_official' WHEN third AND d < 0.78 AND t < 0.72 THEN 'third_party' END o FROM c),
f AS (SELECT *, CASE o WHEN 'official' THEN 0.94 WHEN 'near_official' THEN CASE WHEN p THEN 0.78 ELSE 0.74 END WHEN 'third_party' THEN 0.8 ELSE 0.35 END::DOUBLE oc,
    coalesce((q = 'low' AND qc >= 0.8) OR (q = 'medium' AND o = 'third_party' AND qc >= 0.65 AND relevance_hint < 0.12) OR (q = 'medium' AND o = 'third_party' AND qc >= 0.62 AND fb), false) filtered_out FROM e)
SELECT ord, relevance_hint, p::INT::DOUBLE official_path_hint, thin snippet_thinness_hint, sc::INT quality_score, q source_quality, qc quality_confidence, d::DOUBLE domain_match, t::DOUBLE title_match, coalesce(o, 'third_party') officiality, oc officiality_confidence, filtered_out,
    CASE WHEN o IN ('official', 'near_official') THEN 'verification' ELSE 'discovery' END source_role, round(CASE WHEN filtered_out THEN 0.0 WHEN ctx = 0 THEN least(greatest(0.1, 1 - thin), 0.5) WHEN fb THEN least(greatest(0.1, 1 - thin), 0.55) ELSE greatest(0.1, 1 - thin) END::DOUBLE, 6) evidence_sufficiency FROM f
"""


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(read(spark, sf_dir, "documents").select("doc_id", "text")).select(F.concat(F.lit("r"), F.col("doc_id") % 4).alias("request_id"), F.col("doc_id").alias("source_id"), "text")


def _candidates(spark: SparkSession) -> DataFrame:
    return spark.range(4).select(F.concat(F.lit("r"), F.col("id")).alias("request_id"), F.explode(F.array(*[F.lit(c) for c in CANDIDATES])).alias("name"))


def sentence_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.sentence_rows(_texts(spark, sf_dir)).select("source_id", "seq", "paragraph", "sentence")


_SENTENCES = r"""
WITH c AS (SELECT doc_id source_id, trim(unnest(string_split(regexp_replace(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), '\n+', chr(1), 'g'), chr(1)))) sentence, generate_subscripts(string_split(regexp_replace(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), '\n+', chr(1), 'g'), chr(1)), 1) g FROM documents),
s AS (SELECT source_id, (row_number() OVER (PARTITION BY source_id ORDER BY g) - 1)::INT seq, sentence FROM c WHERE sentence <> '')
"""
_SENTENCES_SQL = _SENTENCES + "SELECT source_id, seq, 0::INT paragraph, sentence FROM s"


def candidate_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = evidence.mentions(_candidates(spark), _texts(spark, sf_dir)).groupBy("request_id", "name").agg(F.sum("mentions").alias("mentions"), F.count("*").alias("sources"))
    return evidence.keep_names(found)


def _case(on: str, values: list[str]) -> str:
    return f"CASE {on} % {len(values)} " + " ".join(f"WHEN {i} THEN '" + v.replace("'", "''") + "'" for i, v in enumerate(values)) + " END"


#: Names made of each part's own that break every rule of the filter, or only nearly do; the same text in Spark and in the SQL.
_NAMES = f"""CASE p_partkey % 18 WHEN 0 THEN p_name WHEN 1 THEN 'Best ' || p_name || ' tools' WHEN 2 THEN upper({_case("p_size", fixed.GENERIC_PHRASES)})
    WHEN 3 THEN ' "' || {_case("p_size", fixed.BOILERPLATE_LABELS)} || '".' WHEN 4 THEN p_name || '/' || p_brand WHEN 5 THEN p_name || '  VS ' || p_type WHEN 6 THEN {_case("p_size", fixed.WEAK_SINGLES)}
    WHEN 7 THEN ' ' || substring(p_name, 1, 1) || ' ' WHEN 8 THEN repeat(p_name || ' ', 12) WHEN 9 THEN 'Clinical ' || {_case("p_size", fixed.GENERIC_DESCRIPTORS)} || ' startups'
    WHEN 10 THEN p_brand || ' “' || p_name || '”!' WHEN 11 THEN NULL WHEN 12 THEN 'Best ' || p_name WHEN 13 THEN {_case("p_size", fixed.WEAK_SINGLES)} || ' ' || p_name
    WHEN 14 THEN p_name || ' ' || {_case("p_size", fixed.GENERIC_HEADS)} WHEN 15 THEN '?!' WHEN 16 THEN {_case("p_size", fixed.GENERIC_LEADS)} || ' ' || {_case("p_partkey", fixed.GENERIC_HEADS)} ELSE p_type || '’s vs. ' || p_brand END"""


def names_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the name filter leaves of a name made for each part; a quarter of them has no mentions."""
    names = read(spark, sf_dir, "part").select("p_partkey", F.expr(_NAMES).alias("name"), (F.col("p_size") % 4).alias("mentions"))
    return evidence.keep_names(names)


_NAMES_KEPT_SQL = rf"""
WITH n AS (SELECT p_partkey, {_NAMES} AS name, p_size % 4 mentions FROM part),
k AS (SELECT *, trim(regexp_replace(lower(translate(name, '’‘`', '')), '\s+', ' ', 'g'), ' "''“”‘’.,;:!?()[]{{}}<>') lab FROM n),
t AS (SELECT *, string_split(lab, ' ') tok FROM k),
r AS (SELECT *, list_contains({_sql_list(fixed.GENERIC_HEADS)}, tok[-1]) head, list_contains({_sql_list(fixed.GENERIC_LEADS)}, tok[1]) AS led, list_has_all({_sql_list(fixed.GENERIC_DESCRIPTORS)}, tok) AS plain FROM t)
SELECT p_partkey, name, mentions FROM r WHERE length(trim(name)) BETWEEN 2 AND 80 AND mentions > 0 AND NOT (head AND (led OR plain)) AND NOT list_contains({_sql_list(fixed.GENERIC_PHRASES + fixed.BOILERPLATE_LABELS)}, lab)
    AND lab NOT LIKE '%/%' AND lab NOT LIKE '% vs %' AND NOT list_contains({_sql_list(fixed.WEAK_SINGLES)}, lab)
"""


def candidate_subsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    urls = evidence.mentions(_candidates(spark), _texts(spark, sf_dir)).select("request_id", "name", F.col("source_id").alias("url"))
    return evidence.drop_subsets(urls.select("request_id", "name").distinct(), urls)


#: Whole-word mentions by runs of word characters and of others, which need no look-around.
_MENTIONS = rf"""
WITH t AS (SELECT doc_id, 'r' || (doc_id % 4) request_id, regexp_extract_all(lower(regexp_replace(text, '\s+', ' ', 'g')), '[\p{{L}}\p{{N}}\p{{M}}_]+|[^\p{{L}}\p{{N}}\p{{M}}_]+') tok FROM documents),
n AS (SELECT unnest({_sql_list(CANDIDATES)}) AS name),
m AS (SELECT request_id, name, doc_id, CASE WHEN contains(name, ' ') THEN len(list_filter(range(1, len(tok) - 1), lambda i: tok[i] = split_part(lower(name), ' ', 1) AND tok[i + 1] = ' ' AND tok[i + 2] = split_part(lower(name), ' ', 2))) ELSE len(list_filter(tok, lambda x: x = lower(name))) END mentions FROM t CROSS JOIN n)
"""
_MENTIONS_SQL = _MENTIONS + "SELECT request_id, name, sum(mentions)::BIGINT mentions, count(*) sources FROM m WHERE mentions > 0 GROUP BY ALL"
_SUBSETS_SQL = _MENTIONS + """,
u AS (SELECT request_id, name, doc_id FROM m WHERE mentions > 0), c AS (SELECT request_id, name, count(*) n FROM u GROUP BY ALL),
p AS (SELECT DISTINCT a.request_id, a.name shorter, b.name longer FROM u a JOIN u b ON a.request_id = b.request_id AND a.doc_id = b.doc_id AND len(string_split(a.name, ' ')) < len(string_split(b.name, ' ')) AND contains(' ' || lower(b.name) || ' ', ' ' || lower(a.name) || ' ')),
g AS (SELECT p.request_id, CASE WHEN x.n > y.n THEN longer ELSE shorter END AS name FROM p JOIN c x ON x.request_id = p.request_id AND x.name = shorter JOIN c y ON y.request_id = p.request_id AND y.name = longer)
SELECT request_id, name FROM c ANTI JOIN g USING (request_id, name)
"""


def sentence_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.sentence_matches(_texts(spark, sf_dir), _candidates(spark)).select("source_id", "seq", "name", "ambiguous")


_MATCHES = _SENTENCES + rf""",
k AS (SELECT source_id, seq, regexp_extract_all(lower(sentence), '[a-z0-9]+') tok FROM s),
n AS (SELECT unnest({_sql_list(CANDIDATES)}) AS name),
h AS (SELECT source_id, seq, name FROM k JOIN n ON list_has_all(tok, string_split(lower(n.name), ' ')) AND contains(array_to_string(tok, ' '), lower(n.name))),
ma AS (SELECT source_id, seq, name, count(*) OVER (PARTITION BY source_id, seq) > 1 ambiguous FROM h)
"""
_MATCHES_SQL = _MATCHES + "SELECT * FROM ma"
#: Left and right in turn, until neither side can take a sentence.
_EVWINDOWS_SQL = _MATCHES.replace("WITH c AS", "WITH RECURSIVE c AS", 1) + """,
x AS (SELECT s.source_id, s.seq, length(sentence) n, coalesce(list(DISTINCT name) FILTER (name IS NOT NULL), []) names FROM s LEFT JOIN ma USING (source_id, seq) GROUP BY ALL),
w AS (SELECT source_id, name, seq l, seq r, x.n::BIGINT n, true gl, true gr, 0 turn FROM ma JOIN x USING (source_id, seq) WHERE NOT ambiguous
    UNION ALL SELECT w.source_id, w.name, CASE WHEN w.turn % 2 = 0 AND x.seq IS NOT NULL THEN w.l - 1 ELSE w.l END, CASE WHEN w.turn % 2 = 1 AND x.seq IS NOT NULL THEN w.r + 1 ELSE w.r END, w.n + coalesce(x.n + 1, 0), w.gl AND (w.turn % 2 = 1 OR x.seq IS NOT NULL), w.gr AND (w.turn % 2 = 0 OR x.seq IS NOT NULL), w.turn + 1
    FROM w LEFT JOIN x ON x.source_id = w.source_id AND x.seq = CASE WHEN w.turn % 2 = 0 THEN w.l - 1 ELSE w.r + 1 END AND CASE WHEN w.turn % 2 = 0 THEN w.gl ELSE w.gr END AND w.n + 1 + x.n <= 1200 AND len(list_filter(x.names, lambda y: y <> w.name)) = 0 WHERE w.gl OR w.gr),
z AS (SELECT DISTINCT source_id, name, l, r FROM w WHERE NOT gl AND NOT gr),
v AS (SELECT z.source_id, name, l, r, string_agg(sentence, ' ' ORDER BY seq) txt FROM z JOIN s ON s.source_id = z.source_id AND s.seq BETWEEN l AND r GROUP BY ALL)
SELECT 'r' || (source_id % 4) request_id, source_id, name, l AS "first", r AS "last", txt AS text FROM v WHERE length(txt) >= 50
"""


def evidence_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = _texts(spark, sf_dir)
    found = evidence.sentence_matches(texts, _candidates(spark))
    return evidence.windows(texts, found, _candidates(spark))


def paragraph_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows in texts where a line that ends a sentence ends its paragraph too."""
    texts = _texts(spark, sf_dir).withColumn("text", F.regexp_replace("text", r"([.!?])\n", "$1\n\n"))
    found = evidence.sentence_matches(texts, _candidates(spark))
    return evidence.windows(texts, found, _candidates(spark), least=20)


_PWINDOWS_SQL = _EVWINDOWS_SQL.replace(
    _SENTENCES.replace("WITH c AS", "WITH RECURSIVE c AS", 1),
    r"""
WITH RECURSIVE p AS (SELECT doc_id source_id, unnest(string_split(regexp_replace(text, '([.!?])\n', '\1' || chr(2), 'g'), chr(2))) AS txt, generate_subscripts(string_split(regexp_replace(text, '([.!?])\n', '\1' || chr(2), 'g'), chr(2)), 1) AS para FROM documents),
c AS (SELECT source_id, para, trim(unnest(string_split(regexp_replace(regexp_replace(txt, '([.!?])\s+', '\1' || chr(1), 'g'), '\n+', chr(1), 'g'), chr(1)))) sentence, generate_subscripts(string_split(regexp_replace(regexp_replace(txt, '([.!?])\s+', '\1' || chr(1), 'g'), '\n+', chr(1), 'g'), chr(1)), 1) g FROM p),
s AS (SELECT source_id, para, (row_number() OVER (PARTITION BY source_id ORDER BY para, g) - 1)::INT seq, sentence FROM c WHERE sentence <> '')
""",
)
_PWINDOWS_SQL = _PWINDOWS_SQL.replace("x AS (SELECT s.source_id, s.seq,", "x AS (SELECT s.source_id, s.seq, s.para,").replace("SELECT source_id, name, seq l, seq r,", "SELECT source_id, name, x.para, seq l, seq r,")
_PWINDOWS_SQL = _PWINDOWS_SQL.replace("UNION ALL SELECT w.source_id, w.name, CASE", "UNION ALL SELECT w.source_id, w.name, w.para, CASE").replace("x.source_id = w.source_id AND x.seq = CASE", "x.source_id = w.source_id AND x.para = w.para AND x.seq = CASE").replace("length(txt) >= 50", "length(txt) >= 20")


def _evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of lineitem as evidence: ten parts are a request, a part and a line number an entity, a supplier a source."""
    orders = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderpriority").alias("variant"))
    parts = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.concat_ws(" ", "p_name", "p_type").alias("part_"))
    quality = F.when(F.col("l_returnflag") == "A", 1.0).when(F.col("l_returnflag") == "N", 0.5).otherwise(0.0)
    rows = read(spark, sf_dir, "lineitem").join(orders, "l_orderkey").join(parts, "l_partkey")
    text = F.concat_ws(" ", "part_", "variant", "l_returnflag")
    return rows.select(F.concat(F.lit("r"), F.floor(F.col("l_partkey") / 10)).alias("request_id"), F.concat_ws("-", "l_partkey", "l_linenumber").alias("entity"), F.col("l_suppkey").cast("string").alias("source_url"), quality.alias("quality"), "variant", F.when(F.col("l_linenumber") > 1, F.col("l_linenumber")).alias("chunk_rank"), "l_returnflag", "l_linestatus", (F.col("l_orderkey") * 1000 + F.col("l_suppkey")).alias("seq"), text.alias("text"))


_EVIDENCE_SQL = """
WITH e AS (SELECT 'r' || (l_partkey // 10) request_id, l_partkey || '-' || l_linenumber entity, l_suppkey::VARCHAR source_url, CASE l_returnflag WHEN 'A' THEN 1.0 WHEN 'N' THEN 0.5 ELSE 0.0 END::DOUBLE quality, o_orderpriority AS variant,
    CASE WHEN l_linenumber > 1 THEN l_linenumber END chunk_rank, l_returnflag, l_linestatus, l_orderkey * 1000 + l_suppkey seq, p_name || ' ' || p_type || ' ' || o_orderpriority || ' ' || l_returnflag AS txt FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN part ON p_partkey = l_partkey)
"""


def evidence_entity_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _evidence(spark, sf_dir).withColumn("source_quality", F.when(F.col("quality") == 1, "high").when(F.col("quality") == 0.5, "medium").otherwise("low")).withColumn("officiality", F.when(F.col("l_linestatus") == "O", "third_party").otherwise("low_quality"))
    return evidence.evidence_scores(df)


_ESCORE_SQL = _EVIDENCE_SQL + "SELECT request_id, entity, sum(w) score FROM (SELECT request_id, entity, source_url, max(CASE WHEN l_linestatus = 'O' THEN quality ELSE 0 END) w FROM e GROUP BY ALL) GROUP BY ALL"


def entity_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entities.support(entities.features(_evidence(spark, sf_dir)), 5)


_SUPPORT = _EVIDENCE_SQL + """,
p AS (SELECT request_id, entity, source_url, count(*) n FROM e GROUP BY ALL),
c AS (SELECT request_id, entity, max(n) top FROM p GROUP BY ALL),
f AS (SELECT request_id, entity, count(DISTINCT source_url) source_count, count(*) chunk_count, count(DISTINCT variant)::INT variant_count, max(quality) quality, round(coalesce(avg(1 / sqrt(chunk_rank::DOUBLE)), 0), 6) avg_rank FROM e GROUP BY ALL),
g AS (SELECT f.*, round(top / chunk_count::DOUBLE, 6) concentration FROM f JOIN c USING (request_id, entity)),
u AS (SELECT *, round((0.3 * least(source_count / 3.0, 1) + 0.2 * least(variant_count / 5.0, 1) + 0.2 * quality + 0.1 * avg_rank + 0.1 * least(chunk_count / 4.0, 1) + 0.1 * greatest(0, 1 - concentration))::DOUBLE, 6) support_score FROM g)
"""
_SUPPORT_SQL = _SUPPORT + "SELECT * FROM u"


def entity_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dominant(_evidence(spark, sf_dir))


def _dominant(rows: DataFrame) -> DataFrame:
    return entities.dominant_variant(rows, _preferred(rows.sparkSession))


def _preferred(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(v, i) for i, v in enumerate(PREFERRED)], "variant string, place int")


_VARIANTS_SQL = _EVIDENCE_SQL + """,
n AS (SELECT request_id, entity, variant, count(*) uses FROM e GROUP BY ALL)
SELECT request_id, entity, variant, uses FROM (SELECT *, row_number() OVER (PARTITION BY request_id, entity ORDER BY uses DESC, variant) rn FROM n) WHERE rn = 1
"""


TOPIC, TOPIC_REWRITES = "small economy ring", ["ring economy urgent", "economy ring"]


def _topics(rows: DataFrame) -> DataFrame:
    return rows.select("request_id").distinct().select("request_id", F.lit(TOPIC).alias("normalized_query"), F.lit(TOPIC).alias("base_query"), F.array(*[F.lit(r) for r in TOPIC_REWRITES]).alias("rewrites"))


def _alignment(rows: DataFrame) -> DataFrame:
    return entities.alignment(rows.select("request_id", "entity", "seq", "text"), _topics(rows))


def entity_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _alignment(plan.stored(_evidence(spark, sf_dir).select("request_id", "entity", "seq", "text"))).select("request_id", "entity", "span", "anchor", "alignment")


_ALIGNMENT = _SUPPORT + rf""",
t AS (SELECT request_id, entity, list_filter(regexp_extract_all(lower(string_agg(txt, ' ' ORDER BY seq, txt)), '[\p{{L}}\p{{N}}_]+'), lambda x: NOT list_contains({_sql_list(fixed.RETRIEVAL_STOPWORDS)}, x)) tok FROM e GROUP BY ALL),
st AS (SELECT request_id, count(*) n, avg(len(tok)) avgdl FROM t GROUP BY 1),
tf AS (SELECT request_id, entity, dl, term, count(*) tf FROM (SELECT request_id, entity, len(tok) dl, unnest(tok) term FROM t) WHERE term IN ('small', 'economy', 'ring') GROUP BY ALL),
dfs AS (SELECT request_id, term, count(*) df FROM tf GROUP BY ALL),
raw AS (SELECT request_id, entity, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf / (tf + 1.5 * (1 - 0.75 + 0.75 * dl / avgdl))), 9) raw FROM tf JOIN dfs USING (request_id, term) JOIN st USING (request_id) GROUP BY ALL),
bm AS (SELECT request_id, entity, CASE WHEN max(raw) OVER (PARTITION BY request_id) > 0 THEN raw / max(raw) OVER (PARTITION BY request_id) ELSE raw END b FROM raw),
al AS (SELECT t.request_id, t.entity, coalesce(b, 0) b, (list_contains(tok, 'economy')::INT + list_contains(tok, 'ring')::INT) / 2.0::DOUBLE anchor, ' ' || array_to_string(tok, ' ') || ' ' body FROM t LEFT JOIN bm USING (request_id, entity)),
al2 AS (SELECT *, CASE WHEN contains(body, ' small economy ring ') THEN 1.0 WHEN contains(body, ' small economy ') OR contains(body, ' economy ring ') THEN 2.0 / 3 WHEN contains(body, ' small ') OR contains(body, ' economy ') OR contains(body, ' ring ') THEN 1.0 / 3 ELSE 0 END::DOUBLE span FROM al),
al3 AS (SELECT request_id, entity, round(span, 6) span, round(anchor, 6) anchor, round(0.6::DOUBLE * b + 0.2::DOUBLE * span + 0.2::DOUBLE * anchor, 6) alignment FROM al2)
"""
_ALIGNMENT_SQL = _ALIGNMENT + "SELECT * FROM al3"


def _ranked(rows: DataFrame) -> DataFrame:
    """rows of _evidence(), written once."""
    return entities.final_ranking(entities.support(entities.features(rows), 5).join(_alignment(rows).select("request_id", "entity", "alignment"), ["request_id", "entity"]))


def entity_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ranked(plan.stored(_evidence(spark, sf_dir))).select("request_id", "entity", "support_score", "alignment", "final_score", "candidate_type", "kept", "position")


_RANKING_SQL = _ALIGNMENT + """,
q AS (SELECT request_id, entity, support_score, alignment, round((0.5 * support_score + 0.5 * alignment)::DOUBLE, 7) final_score FROM u JOIN al3 USING (request_id, entity))
SELECT request_id, entity, support_score, alignment, final_score, CASE WHEN alignment >= 0.5 THEN 'core' ELSE 'discovery' END candidate_type, final_score >= 0.3 OR max(final_score) OVER (PARTITION BY request_id) < 0.3 kept,
    row_number() OVER (PARTITION BY request_id ORDER BY final_score DESC, support_score DESC, alignment DESC, entity)::INT position FROM q
"""


def entity_supporting_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Preferred variants first, in their order; the rest by name."""
    preferred = spark.createDataFrame([(v, i) for i, v in enumerate(["5-LOW", "2-HIGH"])], "variant string, place int")
    return entities.supporting_variants(_evidence(spark, sf_dir), preferred).select("request_id", "entity", F.array_join("supporting", ",").alias("variants"))


_SUPPORTING_SQL = _EVIDENCE_SQL + "SELECT request_id, entity, string_agg(variant, ',' ORDER BY CASE variant WHEN '5-LOW' THEN 0 WHEN '2-HIGH' THEN 1 ELSE 2 END, lower(variant)) variants FROM (SELECT DISTINCT request_id, entity, variant FROM e) GROUP BY ALL"


def entity_mmr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All kept entities of each request, made diverse."""
    rows = plan.stored(_evidence(spark, sf_dir))
    top = _ranked(rows).where("kept").select("request_id", "entity", "position", "final_score")
    return entities.diversify(top.join(entities.used_variants(rows, _preferred(spark)), ["request_id", "entity"]))


#: One entity of every request a step; `nearest` is the largest likeness to any taken one.
_MMR_SQL = _ALIGNMENT.replace("WITH e AS", "WITH RECURSIVE e AS", 1) + """,
q AS (SELECT request_id, entity, support_score, alignment, round((0.5 * support_score + 0.5 * alignment)::DOUBLE, 7) final_score FROM u JOIN al3 USING (request_id, entity)),
k AS (SELECT *, final_score >= 0.3 OR max(final_score) OVER (PARTITION BY request_id) < 0.3 kept, row_number() OVER (PARTITION BY request_id ORDER BY final_score DESC, support_score DESC, alignment DESC, entity) pos FROM q),
nv AS (SELECT request_id, entity, variant, count(*) uses FROM e GROUP BY ALL), dv AS (SELECT request_id, entity, arg_min(variant, (-uses, variant)) dom, list(variant) sup FROM nv GROUP BY ALL),
gk AS (SELECT request_id, entity, final_score, pos, dom, sup FROM k JOIN dv USING (request_id, entity) WHERE kept),
st2 AS (SELECT request_id, entity, final_score, pos, dom, sup, 0.0::DOUBLE nearest, 0 step, first_value(entity) OVER (PARTITION BY request_id ORDER BY pos) pick, first_value(dom) OVER (PARTITION BY request_id ORDER BY pos) pdom, first_value(sup) OVER (PARTITION BY request_id ORDER BY pos) psup FROM gk
    UNION ALL SELECT request_id, entity, final_score, pos, dom, sup, nearest, step, first_value(entity) OVER o, first_value(dom) OVER o, first_value(sup) OVER o FROM (SELECT request_id, entity, final_score, pos, dom, sup, step + 1 step, greatest(nearest, CASE WHEN dom = pdom THEN 1.0 WHEN list_has_any(sup, psup) THEN 0.5 ELSE 0.0 END::DOUBLE) nearest FROM st2 WHERE entity <> pick)
      WINDOW o AS (PARTITION BY request_id ORDER BY 0.75::DOUBLE * final_score - 0.25::DOUBLE * nearest DESC, pos))
SELECT request_id, entity, (step + 1)::INT mmr_position FROM st2 WHERE entity = pick
"""


def near_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _chunks(spark, sf_dir).select("request_id", F.lit("e").alias("entity"), F.col("source_id").alias("source_url"), F.substring_index("chunk_id", "#", -1).cast("long").alias("seq"), F.array_distinct(T.token_list(F.col("text"))).alias("tokens"))
    return entities.drop_near_copies(lines)


#: Line by line of each document, with the token sets kept so far.
_COPIES_SQL = """
WITH RECURSIVE l AS (SELECT doc_id, g - 1 n, list_distinct(regexp_extract_all(lower(x), '[a-z0-9]+')) t FROM (SELECT doc_id, unnest(string_split(text, chr(10))) x, generate_subscripts(string_split(text, chr(10)), 1) g FROM documents)),
w AS (SELECT doc_id, n, [t] kept, true keep FROM l WHERE n = 0
    UNION ALL SELECT doc_id, n, CASE WHEN copy THEN kept ELSE list_append(kept, t) END, NOT copy FROM (SELECT l.doc_id, l.n, l.t, w.kept, len(list_filter(w.kept, lambda k: (len(k) = 0 AND len(l.t) = 0) OR len(list_intersect(k, l.t)) >= 0.85 * greatest(len(k), len(l.t), 1))) > 0 copy FROM w JOIN l ON l.doc_id = w.doc_id AND l.n = w.n + 1))
SELECT 'r' || (doc_id % 4) request_id, 'e' entity, lpad(doc_id::VARCHAR, 8, '0') source_url, n seq FROM w WHERE keep
"""


def _fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "customer")
    cols = F.create_map(F.lit("name"), F.nullif("c_name", F.lit("Customer#000000003")), F.lit("segment"), F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_mktsegment")), F.lit("balance"), F.when(F.col("c_acctbal") > 0, F.round("c_acctbal").cast("long").cast("string")), F.lit("website"), F.when(F.col("c_custkey") % 5 == 0, F.lit("w")))
    return c.select(F.concat(F.lit("r"), F.col("c_nationkey") % 3).alias("request_id"), F.col("c_custkey").cast("string").alias("entity"), F.col("c_custkey").alias("entity_ord"), F.explode(cols).alias("column", "value"))


_FIELDS_SQL = """
WITH c AS (SELECT 'r' || (c_nationkey % 3) request_id, c_custkey::VARCHAR entity, c_custkey entity_ord, nullif(c_name, 'Customer#000000003') AS a, CASE WHEN c_mktsegment <> 'BUILDING' THEN c_mktsegment END AS b, CASE WHEN c_acctbal > 0 THEN round(c_acctbal)::BIGINT::VARCHAR END AS d, CASE WHEN c_custkey % 5 = 0 THEN 'w' END AS e FROM customer),
f AS (SELECT request_id, entity, entity_ord, 'name' AS "column", a AS value FROM c UNION ALL SELECT request_id, entity, entity_ord, 'segment', b FROM c UNION ALL SELECT request_id, entity, entity_ord, 'balance', d FROM c UNION ALL SELECT request_id, entity, entity_ord, 'website', e FROM c)
"""


def column_fill_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _fields(spark, sf_dir)
    cols = spark.range(3).select(F.concat(F.lit("r"), F.col("id")).alias("request_id"), F.explode(F.array(*[F.lit(c) for c in ("name", "segment", "balance", "website", "founded")])).alias("column"))
    return tables.fill_rates(f, cols, f.select("request_id", "entity"))


_FILL_SQL = _FIELDS_SQL + """,
k AS (SELECT DISTINCT request_id, unnest(['name', 'segment', 'balance', 'website', 'founded']) AS "column" FROM f),
n AS (SELECT request_id, count(DISTINCT entity) n FROM f GROUP BY ALL), g AS (SELECT request_id, "column", count(value) got FROM f GROUP BY ALL)
SELECT request_id, "column", round(coalesce(got / n::DOUBLE, 0), 6) fill_rate, round(coalesce(got / n::DOUBLE, 0), 6) < 0.6 sparse FROM k JOIN n USING (request_id) LEFT JOIN g USING (request_id, "column")
"""


def gap_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _fields(spark, sf_dir)
    new = f.where("column = 'segment' and entity_ord % 2 = 0").select("request_id", "entity", "column", F.lit("FILLED").alias("value")).unionByName(f.where("column = 'name'").select("request_id", "entity", F.lit("founded").alias("column"), F.lit("1999").alias("value")))
    return tables.merge_gaps(f.drop("entity_ord"), new)


_GAP_SQL = _FIELDS_SQL + """
SELECT request_id, entity, "column", CASE WHEN "column" = 'segment' AND entity_ord % 2 = 0 THEN coalesce(value, 'FILLED') ELSE value END AS value FROM f UNION ALL SELECT request_id, entity, 'founded', '1999' FROM c
"""


def final_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("entity"), F.col("o_orderpriority").alias("url"))
    f = _fields(spark, sf_dir)
    return tables.final_rows(f, o.join(f.select("request_id", "entity").distinct(), "entity"))


_FINAL_SQL = _FIELDS_SQL + """,
o AS (SELECT o_custkey::VARCHAR entity, count(DISTINCT o_orderpriority) urls FROM orders GROUP BY ALL),
g AS (SELECT request_id, entity, min(entity_ord) ord, count(value) FILTER ("column" <> 'name') non_name, count(value) all_fields, count(value) FILTER ("column" = 'name') named FROM f GROUP BY ALL)
SELECT request_id, entity, row_number() OVER (PARTITION BY request_id ORDER BY non_name DESC, all_fields DESC, coalesce(urls, 0) DESC, ord)::INT position, non_name, all_fields, coalesce(urls, 0) urls FROM g LEFT JOIN o USING (entity) WHERE named > 0 AND non_name > 0
"""


def shown_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.visible_columns(_fields(spark, sf_dir)).select("request_id", "column", T.column_label(F.col("column")).alias("label"), T.column_type(F.col("column")).alias("type"))


_SHOWN_SQL = _FIELDS_SQL + """,
g AS (SELECT request_id, "column", count(value) got, count(DISTINCT entity) n FROM f GROUP BY ALL)
SELECT request_id, "column", upper(substring("column", 1, 1)) || substring("column", 2) AS label, CASE WHEN "column" = 'website' THEN 'url' ELSE 'text' END AS type FROM g WHERE n < 3 OR "column" = 'name' OR got / n::DOUBLE > 0.3
"""


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select(F.col("user_id").alias("request_id"), F.col("event_type").alias("stage"), F.col("event_id").alias("seq"), "value", "ts")


def run_latest_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.latest_stage(_events(spark, sf_dir))


_LATEST_SQL = "SELECT user_id request_id, event_type stage, max(event_id) seq, arg_max(value, event_id) AS value, count(*) events FROM events GROUP BY ALL"


def run_stage_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.stage_windows(_events(spark, sf_dir)).select(F.date_format("start", "yyyy-MM-dd HH").alias("hour"), "stage", "events", "value")


_WINDOWS_SQL = "SELECT strftime(ts, '%Y-%m-%d %H') AS \"hour\", event_type stage, count(*) events, round(sum(value), 4) AS value FROM events GROUP BY ALL"


def eval_rows_new(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = jsonl.with_chunk_key(read(spark, sf_dir, "documents").select("doc_id", "lang", F.lit("q").alias("normalized_query"), F.col("source").alias("url"), "text"))
    return jsonl.new_rows(rows.drop("lang"), rows.where("lang = 'en'"), jsonl.CHUNK_KEY, "doc_id").select("doc_id", "url")


_EVAL_SQL = r"""
WITH k AS (SELECT doc_id, lang, source url, trim(regexp_replace(text, '\s+', ' ', 'g')) chunk_key FROM documents)
SELECT min(doc_id) doc_id, url FROM k WHERE NOT EXISTS (SELECT 1 FROM k o WHERE o.lang = 'en' AND o.url = k.url AND o.chunk_key = k.chunk_key) GROUP BY url, chunk_key
"""


def conversation_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = read(spark, sf_dir, "conversations").where("role = 'user'").select(F.concat_ws("-", "conv_id", "turn").alias("request_id"), F.col("text").alias("query"))
    return plan.normalised(asked).select("request_id", "normalized_query", F.array_join("schema_columns", ",").alias("columns"), "error")


_PLAN_SQL = r"""
SELECT conv_id || '-' || turn request_id, trim(regexp_replace(text, '\s+', ' ', 'g')) normalized_query, 'name,website,location,category' AS columns, trim(text) = '' AS error FROM conversations WHERE role = 'user'
"""


def chunks_hierarchical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunker.chunks(read(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("source_id"), "text"))


_REGISTERED = {
    chunk_rank_topk: _CHUNK_RANK_SQL, bm25_scores: _BM25_SQL, text_tokens: _TOKENS_SQL, text_urls: _URLS_SQL, passage_cleanup: _CLEANUP_SQL,
    results_pruned: _PRUNED_SQL + "SELECT request_id, ord, url, domain, query FROM k", results_merged: _MERGED_SQL + "SELECT request_id, url, domain, rank, first_seen, queries, shortlist_score FROM sc",
    shortlist_domain_cap: _SHORTLIST_SQL, shortlist_bucket_floor: _FLOOR_SQL, shortlist_quota: _QUOTA_SQL, shortlist_buckets: _BUCKETS_SQL, sources_assessed: _ASSESSED_SQL,
    word_stems: _stems_sql(), sentence_table: _SENTENCES_SQL, candidate_mentions: _MENTIONS_SQL, names_kept: _NAMES_KEPT_SQL, candidate_subsets: _SUBSETS_SQL, sentence_matches: _MATCHES_SQL, evidence_windows: _EVWINDOWS_SQL, paragraph_windows: _PWINDOWS_SQL, evidence_entity_scores: _ESCORE_SQL,
    entity_support: _SUPPORT_SQL, entity_variants: _VARIANTS_SQL, entity_ranking: _RANKING_SQL, entity_alignment: _ALIGNMENT_SQL, entity_supporting_variants: _SUPPORTING_SQL, entity_mmr: _MMR_SQL, near_copies: _COPIES_SQL,
    column_fill_rates: _FILL_SQL, gap_fill: _GAP_SQL, final_table: _FINAL_SQL, shown_columns: _SHOWN_SQL,
    run_latest_stage: _LATEST_SQL, run_stage_windows: _WINDOWS_SQL, eval_rows_new: _EVAL_SQL, conversation_plan: _PLAN_SQL, chunks_hierarchical: None,
}


def queries() -> dict:
    return {f.__name__: f for f in _REGISTERED}


def oracle_sql() -> dict[str, str]:
    return {f.__name__: s for f, s in _REGISTERED.items() if s}
