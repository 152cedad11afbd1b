"""Whole requests and their steps, on small tables with nulls, blanks, ties and repeats."""

import unicodedata

import pytest
from pyspark.sql import functions as F

from sieveline.functions import fixed
from sieveline.functions import text as T
from sieveline.operators import answers, cells, entities, evidence, report, search, store
from sieveline.plans import requests
from sieveline.sources import stored
from sieveline.streaming import lifecycle


def page(i, url, title, body):
    return (i, url, f"<html><head><title>{title}</title><style>p{{}}</style></head><body><h1>{title}</h1><p>{body}</p></body></html>")


ACME = "Acme Robotics builds warehouse robots for large hospitals and stores. Acme Robotics location: Berlin. The robots of Acme Robotics move boxes all day long in big halls. "
PAGES = [
    page(1, "https://acmerobotics.com/about", "Acme Robotics warehouse robots", ACME + "Acme Robotics category is logistics robots."),
    page(2, "https://news.example.org/robots", "Warehouse robots guide", ACME + "Bolt Systems makes warehouse robots as well, and sells them to stores in many cities. Bolt Systems location: Paris."),
    page(3, "https://boltsystems.io/", "Bolt Systems home", "Bolt Systems makes warehouse robots that lift heavy boxes for stores. Bolt Systems location: Paris. Its warehouse robots run at night without any people."),
    page(4, "https://other.example.net/x", "Cooking", "Nothing about the topic but recipes."),
    page(5, "https://facts.example.net/c", "Facts on warehouse robots website location category", "Bolt Systems category is lifting robots. More on warehouse robots and their category from Bolt Systems."),
]


@pytest.fixture(scope="module")
def way(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    asked = spark.createDataFrame([("a", "  warehouse   robots "), ("b", "  "), ("c", "recipes for robots"), ("d", "zzz")], "request_id string, query string")
    return requests.run(asked, pages)


def test_a_request_ends_in_a_table(way):
    rows = {(r["request_id"], r["entity"]): r for r in way["table"].collect()}
    assert rows["a", "Bolt Systems"]["non_name"] == 3 and rows["a", "Acme Robotics"]["non_name"] == 3
    assert not any(r in ("b", "d") for r, _ in rows)
    values = {(r["entity"], r["column"]): r["value"] for r in way["fields"].where("request_id = 'a'").collect()}
    assert values["Acme Robotics", "location"] == "Berlin" and values["Bolt Systems", "website"] == "https://boltsystems.io" and values["Bolt Systems", "category"] == "lifting robots"
    assert not way["fields"].where("value is not null and size(evidence) = 0").count()
    assert not way["evidence"].join(way["shortlist"], (way["evidence"]["source_url"] == way["shortlist"]["url"]) & (way["evidence"]["request_id"] == way["shortlist"]["request_id"]), "left_anti").count()


def test_figures_of_a_run(way):
    got = {(r["request_id"], r["key"]): r["value"] for r in requests.run_figures(way).collect()}
    assert got["a", "rowsReady"] == 2 and got["a", "missingFields"] == 0 and got["a", "shortlisted"] == 4 and got["b", "columnsSelected"] == 4 and ("b", "rowsReady") not in got


def test_stored_pages_are_read_once(spark):
    pages = stored.page_texts(spark.createDataFrame(PAGES, "page_id long, url string, html string"))
    short = spark.createDataFrame([("a", PAGES[0][1], 1), ("b", PAGES[0][1], 1), ("a", "https://gone", 2)], "request_id string, url string, position int")
    sources, chunks = stored.read_sources(search.within_budget(short, 2), pages)
    assert {(r["request_id"], r["url"], r["fetch_succeeded"]) for r in sources.collect()} == {("a", PAGES[0][1], True), ("b", PAGES[0][1], True), ("a", "https://gone", False)}
    assert chunks.groupBy("request_id").count().count() == 2 and search.within_budget(short, -1).count() == 0
    queries = spark.createDataFrame([("a", 0, "warehouse robots", 2), ("a", 1, "nothing here zzz", 5)], "request_id string, place int, query string, count int")
    got = stored.results(pages, queries).orderBy("ord").collect()
    assert [(r["query"], r["url"], r["rank"]) for r in got[:2]] == [("warehouse robots", PAGES[0][1], 1), ("warehouse robots", PAGES[1][1], 2)] and got[2]["url"] == PAGES[3][1]


def test_result_counts(spark):
    df = spark.createDataFrame([(n,) for n in (-1, 0, 1, 3, 4, 9)], "n int")
    assert [r[0] for r in df.select(search.result_count(F.col("n"))).collect()] == [0, 0, 20, 12, 10, 10]


def test_alignment(spark):
    plans = spark.createDataFrame([("a", "red fox den", "red fox", ["blue fox"]), ("b", "x y", "z", []), ("c", " ", " ", [])], "request_id string, normalized_query string, base_query string, rewrites array<string>")
    rows = [("a", "one", 1, "a red"), ("a", "one", 2, "fox den here"), ("a", "two", 1, "blue fox"), ("a", "three", 1, "nothing"), ("b", "e", 1, "x"), ("c", "e", 1, "x")]
    got = {(r["request_id"], r["entity"]): r for r in entities.alignment(spark.createDataFrame(rows, "request_id string, entity string, seq int, text string"), plans).collect()}
    assert (got["a", "one"]["span"], got["a", "one"]["anchor"], got["a", "one"]["bm25"]) == (1.0, 1.0, 1.0)  # the run goes on over the chunks' edge
    assert got["a", "two"]["span"] == pytest.approx(1 / 3, abs=1e-6) and got["a", "two"]["anchor"] == 1.0 and 0 < got["a", "two"]["bm25"] < 1
    assert got["a", "three"]["alignment"] == 0 and got["b", "e"]["anchor"] == 0.5 and got["c", "e"]["alignment"] == 0  # b: no shared token, so the first variant's


def test_cell_scores(spark):
    chunks = spark.createDataFrame([("a", "s", "s#0", "Acme One ships fast. Acme One price list"), ("a", "s", "s#1", "Acme One and Bolt ship"), ("a", "t", "t#0", "nobody"), ("a", "t", "t#1", " ")], "request_id string, source_id string, chunk_id string, text string")
    people = spark.createDataFrame([("a", "Acme One"), ("a", "acme one"), ("a", "Bolt"), ("a", "The")], "request_id string, entity string")
    facets = spark.createDataFrame([("a", "price", ["price list", " "]), ("a", "none", [" "])], "request_id string, column string, facet_terms array<string>")
    plans = spark.createDataFrame([("a", "ships fast")], "request_id string, normalized_query string")
    got = {(r["entity"], r["column"], r["chunk_id"]): r for r in cells.cell_scores(chunks, people, facets, plans).collect()}
    one = got["Acme One", "price", "s#0"]
    assert (one["presence"], one["column_match"], one["cleanliness"], one["query_match"]) == (1.0, 1.0, 1.0, 1.0) and one["score"] == 1.0
    two = got["Acme One", "none", "s#1"]
    assert (two["presence"], two["column_match"], two["cleanliness"]) == (0.85, 0.0, 0.4) and got["Bolt", "price", "s#1"]["cleanliness"] == 0.0
    assert not any(k[2].startswith("t") or k[0] == "The" for k in got)


def test_evidence_store(spark):
    sources = spark.createDataFrame([("a", "s1", 1, "u1", " ", "o", None), ("a", "s2", 2, "u2", "T2", "o", True), ("a", "s3", 3, "u3", "T3", "o", False)], "request_id string, source_id string, ord int, url string, title string, origin string, fetch_succeeded boolean")
    long = "Alpha grows in the old garden behind the house. It needs water every second day. Beta is far away from all of that and dry."
    chunks = spark.createDataFrame([("a", "s1", "s1#0", 0, long), ("a", "s1", "s1#1", 1, "  "), ("a", "s2", "s2#0", 0, long), ("a", "s3", "s3#0", 0, long)], "request_id string, source_id string, chunk_id string, sequence_index int, text string")
    ranked = store.pass_through_ranking(sources, chunks)
    assert [r["rank"] for r in ranked.orderBy("source_id", "chunk_id").collect()] == [1, 2, 3, 4]
    judged = spark.createDataFrame([("a", "u1", "J1", False, "verification", "high", "official", ["x"], ["q"])], "request_id string, url string, title string, filtered_out boolean, source_role string, source_quality string, officiality string, aspect_coverage array<string>, query_sources array<string>")
    records = store.source_records(sources, chunks, ranked, judged)
    assert {(r["chunk_id"], r["source_title"], r["source_quality"]) for r in records.collect()} == {("s1#0", "J1", "high"), ("s2#0", "T2", "medium")}
    names = spark.createDataFrame([("a", "Alpha"), ("a", "Beta")], "request_id string, name string")
    urls = spark.createDataFrame([("a", "Alpha", "u1")], "request_id string, name string, url string")
    got = store.build(records, names, urls, names)
    rows = {(r["entity"], r["source_url"]): r for r in got.collect()}
    assert set(rows) == {("Alpha", "u1"), ("Alpha", "u2"), ("Beta", "u2")}  # u2 has no candidate of its own, so its text decides
    assert rows["Alpha", "u1"]["text"].endswith("second day.") and rows["Alpha", "u1"]["selected_chunk_rank"] == 1
    again = store.build(records, names, urls, names, existing=got)
    assert sorted(map(str, again.collect())) == sorted(map(str, got.collect()))


def test_windows_stay_in_their_paragraph(spark):
    text = "Alpha lives here in this very small town of ours.\n\nA second paragraph says nothing of it. Alpha is named again in it, with more words."
    texts = spark.createDataFrame([("a", "s", text), ("a", "t", "nobody")], "request_id string, source_id string, text string")
    names = spark.createDataFrame([("a", "Alpha")], "request_id string, name string")
    got = evidence.windows(texts, evidence.sentence_matches(texts, names), names, least=10).orderBy("first").collect()
    assert [(r["first"], r["last"]) for r in got] == [(0, 0), (1, 2)]


def test_answers(spark):
    plans = spark.createDataFrame([("a", "q", "q", ["name", "city", "size"], ["x"])], "request_id string, normalized_query string, base_query string, schema_columns array<string>, core_aspects array<string>")
    proof = spark.createDataFrame([("a", e, n, f"text {n}", f"u{n}", "t", "discovery", "medium", "third_party", []) for e in ("one", "two", "three") for n in (1, 2)], "request_id string, entity string, seq int, text string, source_url string, source_title string, source_role string, source_quality string, officiality string, aspect_coverage array<string>")
    said = spark.createDataFrame([("a", "one", " one ", False, "city", "Rome", 0.9, ["c2", "c7", "c1"]), ("a", "one", " one ", False, "size", "9", 0.9, ["c9"]), ("a", "one", "one", False, "else", "9", 0.9, ["c1"]), ("a", "two", "Two", False, "city", "Bonn", 0.9, ["c1"])], "request_id string, entity string, answered_name string, provisional boolean, column string, value string, confidence double, chunk_ids array<string>")
    got = {(r["entity"], r["column"]): r for r in answers.extracted_fields(said, proof, plans).collect()}
    assert len(got) == 9 and got["one", "city"]["value"] == "Rome" and [e["source_url"] for e in got["one", "city"]["evidence"]] == ["u2", "u1"]
    assert got["one", "size"]["value"] is None and got["one", "size"]["confidence"] == 0 and (got["one", "name"]["value"], got["one", "name"]["confidence"]) == ("one", 1.0)
    assert got["two", "city"]["value"] is None and got["two", "name"]["value"] is None and got["two", "city"]["provisional"] and got["three", "name"]["provisional"]
    fields = answers.extracted_fields(said, proof, plans)
    gaps = proof.select("request_id", "entity", F.lit("size").alias("column"), F.concat(F.lit("g"), "seq").alias("chunk_id"), F.col("source_url").alias("url"), F.lit("t").alias("title"), "text", F.col("seq").alias("position"))
    new = spark.createDataFrame([("a", "one", "one", False, "size", "12", 0.5, ["g2"]), ("a", "one", "one", False, "city", "Oslo", 0.5, ["g1"]), ("a", "two", "two", False, "size", "3", 0.5, ["zz"])], said.schema)
    merged = {(r["entity"], r["column"]): r for r in answers.merged_fields(fields, answers.gap_updates(new, fields, gaps)).collect()}
    assert merged["one", "size"]["value"] == "12" and merged["one", "size"]["evidence"][0]["source_role"] == "discovery" and merged["one", "city"]["value"] == "Rome" and merged["two", "size"]["value"] is None
    assert "c1" in answers.extractor_payloads(proof, plans).first()["payload"] and "missing_columns" in answers.gap_payloads(fields, gaps, plans).first()["payload"]
    lines = answers.name_payloads(spark.createDataFrame([("a", 2, "b"), ("a", 1, " a "), ("a", 3, " ")], "request_id string, rank int, text string"), plans).first()["payload"]
    assert "[c1] a\\n[c2] b" in lines
    sparse = spark.createDataFrame([("a", "home_page", 0), ("a", "size", 1)], "request_id string, column string, column_ord int")
    assert "home_page" in answers.facet_payloads(sparse, plans).first()["payload"]
    results = spark.createDataFrame([("a", "u1", "t", "s", ["q"], 1, "d", False, 0.1, 0.0, 0.0, "low", 0.9, None, 0.3)], "request_id string, url string, title string, snippet string, query_sources array<string>, rank int, domain string, filtered_out boolean, relevance_hint double, official_path_hint double, snippet_thinness_hint double, source_quality string, quality_confidence double, officiality string, officiality_confidence double")
    chunks = spark.createDataFrame([("a", "u1", i, "x" * 900 if i else " ") for i in range(5)], "request_id string, url string, sequence_index int, text string")
    sent = answers.assessor_payloads(results, chunks, plans).first()["payload"]
    assert sent.count("x" * 800) == 2 and "x" * 801 not in sent and '"heuristic_officiality":"ambiguous"' in sent
    assert '"query_rewrites":["r"]' in answers.bucket_payloads(results, plans.withColumn("rewrites", F.array(F.lit("r")))).first()["payload"]


def test_states_of_a_stream_are_those_of_a_batch(spark, tmp_path):
    runs = spark.createDataFrame([("a", None, None), ("b", "value_error", "bad"), ("c", "other", "broke")], "request_id string, error_kind string, error_message string")
    stages = spark.createDataFrame([("a", 1, "planner", "Plan", True), ("a", 2, "searcher", "Search", False), ("a", 3, "searcher", "Read", True), ("b", 1, "planner", "Plan", False), ("c", 1, "planner", "Plan", True), ("c", 2, "assessor", "Judge", False)], "request_id string, place int, stage string, message string, completed boolean")
    events = lifecycle.run_events(runs, stages)
    ends = {r["request_id"]: (r["event"], r["stage"], r["code"], r["error"], r["details"]) for r in events.where("event like 'run_%ed' and event <> 'run_started'").collect()}
    assert ends == {"a": ("run_completed", None, None, None, None), "b": ("run_failed", "planner", "invalid_query", "bad", None), "c": ("run_failed", None, "internal_error", fixed.RUN_FAILED, "broke")}
    states = {(r["request_id"], r["id"]): r["status"] for r in lifecycle.stage_states(events).collect()}
    assert set(v for (r, _), v in states.items() if r == "a") == {"completed"} and states["b", "planner:Search failed"] == "failed" and states["b", "planner:Plan"] == "active" and states["c", "assessor:Judge"] == "active" and states["c", "planner:Plan"] == "completed"
    events.write.parquet(str(tmp_path / "in"))
    stream = lifecycle.stream_states(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")))
    stream.writeStream.format("memory").queryName("states").outputMode("update").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination()
    import json

    got = {(r["request_id"], i): s for r in spark.table("states").collect() for i, s in json.loads(r["stages"])}
    assert got == states and all(r["finished"] for r in spark.table("states").collect())


def test_export_and_shown_values(spark):
    cells_ = spark.createDataFrame([("a", "e", "name", 0, "E", 1.0, ["u"]), ("a", "e", "home_url", 1, None, 0.0, [])], "request_id string, entity string, column string, column_ord int, value string, confidence double, source_urls array<string>")
    names = spark.createDataFrame([("a", "e", 1, "E")], "request_id string, entity string, position int, name string")
    assert report.export(cells_, names).first()["json"] == '{"inferred_schema":{"columns":[{"key":"name","label":"Name","type":"text"},{"key":"home_url","label":"Home Url","type":"url"}]},"final_top_10_rows":[{"name":"E","fields":{"name":{"value":"E","confidence":1.0,"source_urls":["u"]},"home_url":{"value":null,"confidence":0.0,"source_urls":[]}}}]}'
    df = spark.createDataFrame([("true",), ("false",), ('["a","b"]',), (None,), ("plain [x]",), ("",)], "v string")
    assert [r[0] for r in df.select(T.shown_value(F.col("v"))).collect()] == ["Yes", "No", "a, b", None, "plain [x]", ""]
    assert [r["notice"] for r in report.few_rows(names).collect()] == [True]
    kinds = spark.createDataFrame([(x,) for x in ("official", "near_official", "low_quality", "third_party", None)], "o string")
    assert [tuple(r) for r in kinds.select(T.source_type(F.col("o")), T.source_type(F.col("o"), True)).collect()] == [("official", "official"), ("profile", "profile"), ("third-party", "article"), ("article", "article"), ("article", "article")]
    ranking = spark.createDataFrame([("a", "x", 2, True, "core", 0.123456, 0.5, 0.5), ("a", "y", 1, False, "core", 0.2, 0.5, 0.5)], "request_id string, entity string, position int, kept boolean, candidate_type string, final_score double, support_score double, alignment double")
    assert [(r["name"], r["kept"], r["final_score"]) for r in report.entity_log(ranking).orderBy("n").collect()] == [("x", "yes", 0.1235), ("y", "no", 0.2)]


def test_nfkc(spark):
    texts = ["plain", "ﬁne ①", "é", None, ""]
    got = [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(T.nfkc(F.col("t"))).collect()]
    assert got == [t if t is None else unicodedata.normalize("NFKC", t) for t in texts]


def test_service_source(spark):
    from sieveline.sources import payloads, service

    rows = service.ask(spark, "tests.replayed_answers:answer", [{"q": f"q{i}"} for i in range(5)] + [{"q": "bad"}], batch="2", title="T")
    got = {r["request"]: r for r in rows.collect()}
    assert len(got) == 6 and got['{"q": "bad"}']["error"] == "TimeoutError: slow" and got['{"q": "bad"}']["payload"] is None
    found = payloads.search_payloads(rows.where("error is null").select(F.lit("r").alias("request_id"), F.col("request").alias("query"), "payload"))
    assert {(r["url"], r["title"], r["rank"], r["domain"]) for r in found.collect()} == {(f"https://a.b/q{i}", "T", 1, "a.b") for i in range(5)}
    assert service.ask(spark, "tests.replayed_answers:answer", [], title="T").count() == 0


def test_settings(spark):
    from sieveline import settings

    text = "# note\nSIEVELINE_SHORTLIST_CAP = '7'\n\nno equals\nSIEVELINE_SHORTLIST_CAP=9\nSIEVELINE_BREADTH_ENABLED=false\nSIEVELINE_CHUNK_TOP_K=-4\nSIEVELINE_PLANNER_MODE=\"\""
    env = settings.env_values(text)
    assert env["SIEVELINE_SHORTLIST_CAP"] == "7" and env["SIEVELINE_PLANNER_MODE"] == ""
    spark.conf.set("spark.sieveline.assessor_mode", "model")
    got = settings.load(spark, env)
    spark.conf.unset("spark.sieveline.assessor_mode")
    assert (got.shortlist_cap, got.breadth_enabled, got.chunk_top_k, got.planner_mode, got.assessor_mode) == (7, False, 0, "rules", "model")
    assert settings.choose("retrieval", "reader", {"reader": len})([1, 2]) == 2 and settings.choose("x", "placeholder", {})("same", 1) == "same"
    with pytest.raises(ValueError):
        settings.choose("retrieval", "other", {"reader": len})
    assert settings.empty(spark, "a int").count() == 0


def test_prior_fields_and_rows(spark):
    plans = spark.createDataFrame([("a", ["name", "home_url"])], "request_id string, schema_columns array<string>")
    kind = "request_id string, entity string, column string, column_ord int, value string, confidence double, evidence array<struct<source_url:string,source_title:string,supporting_snippet:string,source_role:string,source_quality:string,officiality:string>>, provisional boolean"
    item = ("u", "t", "s", "discovery", "high", "official")
    new = spark.createDataFrame([("a", "one", "name", 0, "One", 0.9, [item], False), ("a", "gone", "name", 0, "x", 0.9, [item], False)], kind)
    old = spark.createDataFrame([("a", "one", "name", 0, "old", 0.9, [item], False), ("a", "two", "name", 0, "Two", 0.9, [item, item], False)], kind)
    names = spark.createDataFrame([("a", "one", 1), ("a", "two", 2), ("a", "three", 3)], "request_id string, entity string, position int")
    proof = spark.createDataFrame([("a", "one")], "request_id string, entity string")
    out = answers.with_prior(names, proof, new, old, plans)
    assert {(r["entity"], r["column"], r["value"], r["provisional"]) for r in out.collect()} == {("one", "name", "One", False), ("two", "name", "Two", False), ("three", "name", None, True), ("three", "home_url", None, True)}
    rows = {r["name"]: r for r in answers.canonical(out).collect()}
    assert rows["two"]["source_urls"] == ["u"] and rows["three"]["fields"]["home_url"]["value"] is None
    visible = spark.createDataFrame([("a", "name"), ("a", "home_url")], "request_id string, column string")
    shown = {r["name"]: r for r in report.table_rows(out.where("entity <> 'three'"), names, visible).collect()}
    assert shown["three"]["cells"]["name"]["text"] == "three" and shown["three"]["cells"]["name"]["confidence"] == 1.0 and shown["one"]["id"] == "1" and shown["two"]["cells"]["home_url"]["text"] is None
    assert [(r["key"], r["label"], r["type"]) for r in report.schema_preview(plans).orderBy("place").collect()] == [("name", "Name", "text"), ("home_url", "Home Url", "url")]
    assert '"name":"...","fields":{"name":{"value":"...","confidence":0,"source_urls":[]}' in report.loading_preview(plans).first()["json"]
    one = spark.range(1).select(report.badges(F.lit("low_quality"), F.lit("high")).alias("b")).first()["b"]
    assert (one["source"], one["quality"]) == ("Third-party", "High quality")


def test_stages_and_replay(spark):
    figures = spark.createDataFrame([("a", "planner"), ("a", "searcher"), ("a", "searcher")], "request_id string, stage string")
    runs = spark.createDataFrame([("a", None, None)], "request_id string, error_kind string, error_message string")
    events = lifecycle.run_events(runs, lifecycle.stage_rows(figures, {"planner": 1, "searcher": 2}))
    assert [r["event"] for r in events.orderBy("seq").collect()] == ["run_started", "stage_started", "stage_completed", "stage_started", "stage_completed", "run_completed"]
    assert lifecycle.replay(events, spark.range(3).withColumnRenamed("id", "value")).count() == 3
