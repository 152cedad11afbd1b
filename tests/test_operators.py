"""Hand-checked expectations for the operators outside llm."""

import random

import pytest
from pyspark.sql import functions as F

from sieveline.functions import chunker
from sieveline.functions import text as T
from sieveline.operators import assess, entities, evidence, passages, plan, providers, results, tables
from sieveline.sources import jsonl


def value(spark, col):
    return spark.range(1).select(col.alias("v")).first()["v"]


def test_retrieval_tokens(spark):
    got = value(spark, T.retrieval_tokens(F.lit("Clinician-facing AI systems, for hospitals and care teams!"), T.plural_stem))
    assert {"clinician", "facing", "ai", "system", "hospital"} <= set(got) and "and" not in got


@pytest.mark.parametrize("url, core, low, social", [("https://www.acme.co.uk/about?x=1", "acmeco", False, False), ("https://x.com/a/status/1", "x", True, False), ("https://twitter.com/a/status/1", "twitter", True, True), ("https://docs.acme.io", "acme", False, False)])
def test_urls(spark, url, core, low, social):
    u = F.lit(url)
    assert value(spark, T.host_core(u)) == core and value(spark, T.low_host(u)) is low and value(spark, T.social_post(u)) is social


def test_span_overlap_and_compact(spark):
    arr = lambda *x: F.array(*[F.lit(v) for v in x])
    assert value(spark, T.span_share(arr("a", "b", "c"), arr("x", "b", "c", "a"))) == pytest.approx(2 / 3)
    assert value(spark, T.span_share(F.array().cast("array<string>"), arr("x"))) == 0
    assert value(spark, T.overlap_ratio(arr("a", "b", "c"), arr("b", "c", "d", "e"))) == 0.5
    assert value(spark, T.occurrences(arr("a", "a"), arr("a", "a", "a"))) == 2
    assert value(spark, T.compact_overlap(F.lit("acme"), F.lit("acmecorp"))) == 0.5


def test_passage_cleanup(spark):
    raw = "Intro\nRead more\n| --- | --- |\n{\"a\": 1}\n*[Image: x]*Body text\n\n\n\nEnd"
    assert value(spark, T.clean_passage(F.lit(raw))) == "Intro\nBody text\n\nEnd"
    assert value(spark, T.truncate_passage(F.lit("one two, three"), 10)) == "one two"
    assert value(spark, T.page_title(F.lit("\n\nTitle: Hello\nx"), F.lit("u"))) == "Hello"
    assert value(spark, T.page_title(F.lit(""), F.lit("u"))) == "u"


def test_passage_lines_keep_their_digits(spark):
    raw = "  Call 555-8630\nat 16.155.205.171\n | --- | --- | \n2 or 12  "
    assert value(spark, T.clean_passage(F.lit(raw))) == "Call 555-8630\nat 16.155.205.171\n2 or 12"


def test_bucket_words_beside_accented_letters(spark):
    bucket = lambda title, url="http://a.b/x": value(spark, results.bucket_of(F.lit(title), F.lit(url)))
    assert [bucket(t) for t in ("Ver übest mit", "topä", "\u00c4LIST", "the best")] == ["roundup_list"] * 4
    assert [bucket(t) for t in ("xbest", "top_x", "list9", "ubests")] == ["editorial_reference"] * 4
    assert bucket("x", "http://a/b/12/") == "profile_directory" and bucket("x", "http://a/b/12\n") == "editorial_reference"


def test_chunks():
    assert len(chunker.split("A " * 33 + "\n\n" + "tiny" + "\n\n" + "B " * 10 + "\n\n" + "C " * 45, 70, 25, None)) >= 3
    got = chunker.split("alpha " * 40, 100, None or 20, None)
    assert len(got) == 3 and all(len(c) <= 100 for c in got) and len(got[-1]) >= 20
    assert len(chunker.split("\n\n".join(f"Section {i} " + "x " * 30 for i in range(5)), 70, 5, 3)) == 3
    assert chunker.split(None) == [] and chunker.split("  \n ") == []
    assert len(chunker.split("x" * 5000, 100, 20, None)) == 1


def _scored(spark, rows):
    return spark.createDataFrame(rows, "request_id string, url string, domain string, rank int, first_seen long, query_sources array<string>, shortlist_score double, bucket string")


def test_shortlist_score_and_domain_cap(spark):
    raw = [("r", i, u, "t", "s", d, k, q) for i, (u, d, k, q) in enumerate([("alpha", "alpha", 1, "base"), ("beta", "beta", 1, "base"), ("same/1", "same", 2, "base"), ("same/2", "same", 2, "base"), ("same/3", "same", 2, "base"), ("same/4", "same", 2, "base"), ("alpha", "alpha", 1, "rewrite")])]
    df = spark.createDataFrame(raw, "request_id string, ord long, url string, title string, snippet string, domain string, rank int, query string")
    got = results.shortlist(results.shortlist_score(results.merge_by_url(df).withColumn("total", F.lit(2)), "total")).orderBy("position").collect()
    assert [r["url"] for r in got] == ["alpha", "beta", "same/1", "same/2", "same/3"]
    assert got[0]["query_sources"] == ["base", "rewrite"]


def test_quotas():
    assert results.reserved_quotas(["b", "r1", "r2", "r3"], 15) == {"b": 3, "r1": 2, "r2": 1, "r3": 1}
    assert results.reserved_quotas(["b", "r1"], 8) == {"b": 2, "r1": 1}
    assert results.reserved_quotas([], 15) == {}


def test_bucket_round_robin(spark):
    rows = [("r", f"{b}/a", f"{b}{i}", 1, i, ["q"], 1.0 - i / 100, b) for i, b in enumerate(["transactional_listing", "roundup_list", "editorial_reference", "profile_directory", "official_entity"])]
    got = results.shortlist_by_bucket(_scored(spark, rows), 5).orderBy("position").collect()
    assert [r["url"].split("/")[0] for r in got] == ["official_entity", "profile_directory", "editorial_reference", "roundup_list", "transactional_listing"]


def test_reserved_slots_reach_a_rewrite(spark):
    rows = [("r", f"base/{i}", f"d{i}", i + 1, i, ["b"], 0.9 - i / 100, "") for i in range(9)] + [("r", "rewrite/only", "w", 9, 99, ["w"], 0.1, "")]
    got = results.shortlist_by_query(_scored(spark, rows), ["b", "w"], 8).orderBy("position").collect()
    assert got[1]["url"] == "rewrite/only" and len(got) == 8


def test_passage_weights(spark):
    chunks = spark.createDataFrame([("r", "s", "s#0", "red apple pie"), ("r", "s", "s#1", "blue sky"), ("r", "s", "s#2", "  ")], "request_id string, source_id string, chunk_id string, text string")
    plans = spark.createDataFrame([("r", "red apple", "red apple", ["apple pie", ""])], "request_id string, normalized_query string, base_query string, rewrites array<string>")
    got = passages.rank_passages(chunks, plans).orderBy("rank").collect()
    assert [r["chunk_id"] for r in got] == ["s#0", "s#1"]
    r = got[0]
    assert r["final_score"] == pytest.approx(0.45 * r["base_score"] + 0.25 * r["best_rewrite_score"] + 0.1 * (r["coverage_score"] + r["span_score"] + r["anchor_score"]), abs=1e-6)
    assert r["best_query"] == "rewrite_1" and r["base_score"] == 1.0 and r["anchor_score"] == 1.0


@pytest.mark.parametrize("snippet, chars, rel, fallback, want, sure", [("", 0, 0.0, False, "low", 0.98), ("s" * 100, 300, 0.5, False, "high", 0.74), ("s" * 100, 100, 0.2, False, "medium", 0.53)])
def test_quality_rules(spark, snippet, chars, rel, fallback, want, sure):
    df = spark.createDataFrame([(snippet, chars, rel, fallback, "https://a.com/x")], "snippet string, context_chars int, relevance_hint double, fallback boolean, url string")
    r = assess.quality(df).first()
    assert (r["source_quality"], r["quality_confidence"]) == (want, pytest.approx(sure))


def test_names_and_subsets(spark):
    names = spark.createDataFrame([(n, 1) for n in ("Acme Health", "AI startups", "About Us", "Apple/Samsung", "Platform", "x")], "name string, mentions int")
    assert [r["name"] for r in evidence.keep_names(names).collect()] == ["Acme Health"]
    urls = spark.createDataFrame([("r", "Apple iPhone 17 Pro Max", "u"), ("r", "iPhone 17 Pro Max", "u")], "request_id string, name string, url string")
    assert [r["name"] for r in evidence.drop_subsets(urls.select("request_id", "name"), urls).collect()] == ["Apple iPhone 17 Pro Max"]


def test_windows_stop_at_others_and_pass_weak_ones(spark):
    texts = spark.createDataFrame([("r", 1, "We met Alpha One at the fair. It was a nice and long day. The Weak Model came. Then all went home again. Beta Two left.")], "request_id string, source_id long, text string")
    names = spark.createDataFrame([("r", "Alpha One"), ("r", "Beta Two")], "request_id string, name string")
    found = evidence.sentence_matches(texts, names)
    got = {r["name"]: (r["first"], r["last"]) for r in evidence.windows(texts, found, names).collect()}
    assert got == {"Alpha One": (0, 3), "Beta Two": (1, 4)}


def test_support_score_by_hand(spark):
    rows = [("r", "e", "u1", 1.0, "a", 1), ("r", "e", "u2", 1.0, "b", 2)]
    df = entities.features(spark.createDataFrame(rows, "request_id string, entity string, source_url string, quality double, variant string, chunk_rank int"))
    assert entities.support(df, 4).first()["support_score"] == pytest.approx(0.685355, abs=1e-6)


def test_mmr_prefers_another_variant(spark):
    rows = [("r", "Control Club", 1, 0.9, "night", ["night"]), ("r", "Expirat", 2, 0.85, "night", ["night"]), ("r", "Romanian Athenaeum", 3, 0.8, "culture", ["culture"])]
    got = entities.diversify(spark.createDataFrame(rows, "request_id string, entity string, position int, final_score double, dominant string, supporting array<string>")).orderBy("mmr_position").collect()
    assert [r["entity"] for r in got] == ["Control Club", "Romanian Athenaeum", "Expirat"]


def test_near_copies_fold(spark):
    rows = [("r", "e", "u", 0, ["a", "b", "c"]), ("r", "e", "u", 1, ["c", "b", "a"]), ("r", "e", "v", 2, ["a", "b", "c"])]
    assert entities.drop_near_copies(spark.createDataFrame(rows, "request_id string, entity string, source_url string, seq long, tokens array<string>")).count() == 2


def test_sparse_gap_and_final_rows(spark):
    f = spark.createDataFrame([("r", "a", 0, "name", "A"), ("r", "a", 0, "category", "x"), ("r", "a", 0, "location", None), ("r", "b", 1, "name", "B"), ("r", "b", 1, "category", "y"), ("r", "b", 1, "location", "z"), ("r", "c", 2, "name", None), ("r", "c", 2, "category", "q")], "request_id string, entity string, entity_ord int, column string, value string")
    cols = spark.createDataFrame([("r", c) for c in ("category", "location", "website")], "request_id string, column string")
    ents = f.where("entity <> 'c'").select("request_id", "entity")
    got = {r["column"]: (r["fill_rate"], r["sparse"]) for r in tables.fill_rates(f.where("entity <> 'c'"), cols, ents).collect()}
    assert got == {"category": (1.0, False), "location": (0.5, True), "website": (0.0, True)}
    urls = spark.createDataFrame([("r", "a", "u")], "request_id string, entity string, url string")
    assert [r["entity"] for r in tables.final_rows(f, urls).orderBy("position").collect()] == ["b", "a"]


def test_chunk_choice_reuses_a_source_only_when_stronger(spark):
    rows = [("r", "e", "c", "s1", "s1#0", 0.9), ("r", "e", "c", "s1", "s1#1", 0.8), ("r", "e", "c", "s2", "s2#0", 0.5), ("r", "e", "c", "s2", "s2#1", 0.0)]
    got = tables.choose_chunks(spark.createDataFrame(rows, "request_id string, entity string, column string, source_id string, chunk_id string, score double")).orderBy("position").collect()
    assert [r["chunk_id"] for r in got] == ["s1#0", "s1#1", "s2#0"]


def test_plan_and_queries(spark):
    df = spark.createDataFrame([("r", "  red   apple ", ["Web Site"], None, ["Red Apple", "apple pie"]), ("s", " ", None, None, None)], "request_id string, query string, columns array<string>, aspects array<string>, rewrites array<string>")
    got = {r["request_id"]: r for r in plan.normalised(df).collect()}
    assert got["r"]["schema_columns"] == ["Web Site", "name", "website", "location"] and got["r"]["rewrites"] == ["apple pie"] and got["s"]["error"]
    assert [r["query"] for r in plan.executed_queries(plan.normalised(df)).orderBy("place").collect()] == ["red apple", "apple pie"]


def test_jsonl_appends_only_new(spark, tmp_path):
    rows = jsonl.with_chunk_key(spark.createDataFrame([("q", "u", "a  b", 1), ("q", "u", "a b", 2), ("q", "v", "c", 3)], "normalized_query string, url string, text string, n int"))
    jsonl.append(rows, str(tmp_path / "x"), jsonl.CHUNK_KEY, "n")
    jsonl.append(rows, str(tmp_path / "x"), jsonl.CHUNK_KEY, "n", spark.read.json(str(tmp_path / "x")))
    assert sorted(r["n"] for r in spark.read.json(str(tmp_path / "x")).collect()) == [1, 3]


def test_stream_matches_batch(spark, tmp_path):
    from sieveline.streaming import runs

    rows = spark.createDataFrame([(1, "plan", 1, 1.0), (1, "plan", 2, 5.0), (2, "fetch", 3, 2.0)], "request_id long, stage string, seq long, value double")
    rows.write.parquet(str(tmp_path / "in"))
    q = runs.stream_latest(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination()
    got = {(r["request_id"], r["stage"], r["seq"], r["value"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {(1, "plan", 2, 5.0), (2, "fetch", 3, 2.0)}


def test_entry_point_without_llm():
    import subprocess
    import sys

    from conftest import ROOT

    code = "import sys; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; assert 'chunk_rank_topk' in e.queries() and not any(k.startswith('op') for k in e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)


def test_payloads(spark):
    from sieveline.sources import payloads

    raw = spark.createDataFrame([("r", "q", '{"web": {"results": [{"url": "", "title": "x"}, {"url": "https://A.com/1", "title": "T", "description": "D"}, {"url": "https://b.com", "profile": {"long_name": "B"}}]}}')], "request_id string, query string, payload string")
    got = payloads.search_payloads(raw).orderBy("rank").collect()
    assert [(r["url"], r["rank"], r["domain"]) for r in got] == [("https://A.com/1", 2, "a.com"), ("https://b.com", 3, "B")]
    ctx = spark.createDataFrame([("r", '{"grounding": {"generic": [{"url": "u", "snippets": ["a", " "]}, {"url": "n", "snippets": []}], "poi": {"url": "p", "title": "P", "snippets": ["b"]}}, "sources": {"u": {"title": "U", "age": ["", "1d"]}}}')], "request_id string, payload string")
    got = payloads.context_payloads(ctx).orderBy("pos").collect()
    assert [(r["url"], r["title"], r["age"], r["text"]) for r in got] == [("u", "U", "1d", "a"), ("p", "P", None, "b")]
    res = spark.createDataFrame([("r", "u", "snip"), ("r", "z", "snip z")], "request_id string, url string, snippet string")
    got = {r["url"]: (r["text"], r["fallback"]) for r in payloads.with_context(res, payloads.context_payloads(ctx)).collect()}
    assert got == {"u": ("a", False), "z": ("snip z", True)}
    pages = payloads.reader_pages(spark.createDataFrame([("u", "Title: X\nbody", None), ("v", None, "timeout")], "url string, text string, error string")).orderBy("url").collect()
    assert [(p["title"], p["fetch_succeeded"]) for p in pages] == [("X", True), ("v", False)]


def test_providers(spark):
    from sieveline.operators import providers

    texts = spark.createDataFrame([("r", 1, "we met Alpha One and Beta"), ("r", 2, None)], "request_id string, source_id long, text string")
    assert {r["name"] for r in providers.candidate_names(texts).collect()} == {"Alpha One", "Beta"}

    def broken(payloads):
        raise ValueError("no")

    asked = texts.select("request_id", "source_id", F.to_json(F.struct("text")).alias("payload"))
    assert all(r["error"] == "ValueError: no" for r in providers.ask(asked, broken, ["request_id", "source_id"]).collect())
    d = spark.createDataFrame([("r", "e", "name", "E", "c1"), ("r", "e", "site", "S", "c9"), ("r", "e", "other", "O", "c1")], "request_id string, entity string, column string, value string, chunk_id string")
    cols = spark.createDataFrame([("r", "name"), ("r", "site")], "request_id string, column string")
    got = {r["column"]: r["value"] for r in providers.grounded(d, cols, spark.createDataFrame([("r", "c1")], "request_id string, chunk_id string")).collect()}
    assert got == {"name": "E", "site": None}


def test_chunks_cut_by_level():
    heads = "# One\n" + "a" * 30 + "\n# Two\n" + "b" * 30 + "\n\n\nlast " + "c" * 30
    assert [c[:5] for c in chunker.split(heads, 45, 1, None)] == ["# One", "# Two", "last "]
    lines = "First line ends here.\n  indented " + "x" * 20 + "\nplain " + "y" * 20
    assert chunker.split(lines, 60, 1, None) == ["First line ends here.", "indented " + "x" * 20 + "\nplain " + "y" * 20]
    assert chunker.split("One is short. Two is short too! Three?", 20, 1, None) == ["One is short.", "Two is short too!", "Three?"]
    assert chunker.split("word " * 10, 12, 1, None) == ["word word"] * 5 and chunker.split("a" * 30 + " b", 10, 1, None) == ["a" * 30, "b"]
    assert chunker.split("a  \r\nb\t\r\n", 100) == ["a\nb"]
    text = "A" * 65 + "\n\ntiny\n\n" + "B" * 20 + "\n\n" + "C" * 90
    got = chunker.split(text, 70, 25, 10)
    assert len(got) == 3 and got[1] == "tiny\n\n" + "B" * 20
    assert len(chunker.split("\n\n".join(f"Section {i} " + "x" * 35 for i in range(1, 6)), 50, 17, 3)) == 3
    assert [len(c) for c in chunker.split("alpha " * 40, 100, 20, None)] == [95, 95, 47]


def test_names_that_differ_in_case_are_one(spark):
    texts = spark.createDataFrame([("a", "1", "we met Acme  Labs and ACME LABS here, and Bolt’s   Works too"), ("a", "2", "x Acme labs y")], "request_id string, source_id string, text string")
    got = {r["name"] for r in providers.candidate_names(texts, lambda ps: [{"names": ["Acme  Labs", "ACME LABS", " ", "Bolt's Works"]} for _ in ps]).collect()}
    assert got == {"Acme Labs", "Bolt's Works"}
    names = spark.createDataFrame([("a", n) for n in got], "request_id string, name string")
    seen = {(r["name"], r["source_id"]): r["mentions"] for r in evidence.mentions(names, texts).collect()}
    assert seen == {("Acme Labs", "1"): 2, ("Acme Labs", "2"): 1, ("Bolt's Works", "1"): 1}


def test_near_copies_across_frames_without_groups_of_pandas(spark):
    rng, rows = random.Random(3), []
    for source, n in ((None, 3), ("a", 1), ("b", 1), ("c", 12), ("d", 4), ("e", 1)):
        for entity in ("x", None):
            rows += [("r", entity, source, i, rng.sample("uvwxyz", rng.randint(0, 3))) for i in range(n)]
    rng.shuffle(rows)
    want = set()
    for key in {r[:3] for r in rows}:
        own = sorted((r for r in rows if r[:3] == key), key=lambda r: r[3])
        want |= {r[:4] for r, new in zip(own, entities.first_of_copies([set(r[4]) for r in own], 0.85)) if new}
    chunks = spark.createDataFrame(rows, "request_id string, entity string, source_url string, seq int, tokens array<string>")
    for frame in (1, 2, 5, 10_000):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", frame)
        got = entities.drop_near_copies(chunks)
        assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert "FlatMapGroupsInPandas" not in got._jdf.queryExecution().toString()


def test_stop_entities_are_dealt_to_tasks_by_their_rows(spark, monkeypatch):
    monkeypatch.setattr(plan, "ROWS_A_TASK", 100, raising=False)
    n = F.col("id")
    seen = spark.range(2000).select(F.concat(F.lit("r"), n % 2).alias("request_id"), F.when(n < 1000, F.concat(F.lit("n"), n)).otherwise("often").alias("name"), (n % 4).alias("source_id"), F.lit(1).cast("long").alias("mentions"))
    sources = spark.createDataFrame([("r0", 0, True), ("r1", 1, False), ("r0", 2, None), ("q", 3, True)], "request_id string, source_id long, non_low boolean")
    got = evidence.stop_entities(seen, sources)
    rows = {tuple(r) for r in got.collect()}
    assert rows == {("r0", "often", 500, True), ("r1", "often", 500, False)} | {("r0", f"n{i}", 1, True) for i in range(0, 1000, 4)}
    # 2,000 rows for 20 tasks, whatever partitions are set or run together.
    assert got.rdd.getNumPartitions() == 20
    assert max(r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()) < 60
