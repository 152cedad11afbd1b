"""The inverted index, windows and near copies against plain versions, and on large inputs."""

import random
import time

import pytest
from pyspark.sql import functions as F

from sieveline.operators import answers, cells, entities, evidence, passages, plan, postings, providers, stems
from sieveline.sources import stored

WORDS = ["acme", "health", "drug", "store", "the", "of", "new", "york", "city", "labs"]


def corpus(spark, n=60, seed=1):
    rng = random.Random(seed)
    rows = [(f"r{i % 3}", f"c{i:03}", " ".join(rng.choices(WORDS, k=rng.randint(0, 12)))) for i in range(n)]
    return rows, spark.createDataFrame([*rows, ("r0", "blank", "  "), ("r1", "none", None)], "request_id string, chunk_id string, text string")


def test_postings_are_the_tokens(spark):
    rows, texts = corpus(spark)
    terms = spark.createDataFrame([(r, t) for r in ("r0", "r1") for t in ("acme", "york", "absent", None)], "request_id string, term string")
    index = postings.build(postings.tokenised(texts), terms)
    want = {(r, t, c): [i for i, w in enumerate([w for w in text.split() if w not in ("the", "of")]) if w == t] for r, c, text in rows for t in ("acme", "york") if r in ("r0", "r1")}
    got = {(r["request_id"], r["term"], r["chunk_id"]): r for r in index.postings.collect()}
    assert {k: r["places"] for k, r in got.items()} == {k: v for k, v in want.items() if v}
    assert all(r["tf"] == len(r["places"]) for r in got.values())
    # Texts without a term are documents, blank ones are not.
    assert index.documents.count() == sum(bool(text.strip()) for _, _, text in rows)
    assert postings.build(postings.tokenised(texts.limit(0)), terms).postings.count() == 0


def test_terms_beyond_the_bound_give_the_same_scores(spark, monkeypatch):
    rows, texts = corpus(spark)
    plans = spark.createDataFrame([(f"r{i}", "acme drug", "acme drug", ["new york", "acme acme"]) for i in range(3)], "request_id string, normalized_query string, base_query string, rewrites array<string>")
    few = passages.rank_passages(texts.withColumn("source_id", F.col("chunk_id")), plans).orderBy("request_id", "rank").collect()
    with monkeypatch.context() as m:
        m.setattr(plan.small, "__defaults__", (0,))
        many = passages.rank_passages(texts.withColumn("source_id", F.col("chunk_id")), plans).orderBy("request_id", "rank").collect()
    assert few == many and len(few) > 40


def test_phrases_by_places(spark):
    rows, texts = corpus(spark, n=200)
    names = [("r0", "Acme"), ("r0", "New York"), ("r0", "new york city"), ("r0", "acme acme"), ("r1", "the of"), ("r1", "York")]
    named = spark.createDataFrame(names, "request_id string, entity string").select("request_id", "entity", F.filter(F.split(F.lower("entity"), " "), lambda t: ~t.isin("the", "of")).alias("tokens"))
    index = postings.build(postings.tokenised(texts), postings.terms_of(named, "tokens"))
    got = {(r["chunk_id"], r["entity"]): r["times"] for r in postings.phrases(index, named, "entity").collect()}
    want = {}
    for r, c, text in rows:
        tokens = [w for w in text.split() if w not in ("the", "of")]
        for q, name in names:
            own = [w for w in name.lower().split() if w not in ("the", "of")]
            times = sum(tokens[i : i + len(own)] == own for i in range(len(tokens))) if own else 0
            if q == r and times:
                want[c, name] = times
    assert got == want and any(name == "New York" for _, name in got)
    others = {(r["chunk_id"], r["entity"]): r["others"] for r in cells.mentions(index, named).collect()}
    assert others == {(c, n): sum(1 for d, m in want if d == c and m.lower() != n.lower()) for c, n in want}


def test_a_search_reads_written_words(spark):
    pages = spark.createDataFrame([(i, f"https://a{i}.com", f"<title>T{i}</title><p>{'solar ' * (i % 3)}wind {i}</p>") for i in range(12)], "page_id long, url string, html string")
    texts = stored.page_texts(pages)
    asked = spark.createDataFrame([("r", 0, "solar wind", 5)], "request_id string, place int, query string, count int")
    assert stored.results(texts, asked).collect() == stored.results(texts, asked, words=plan.cut(stored.page_words(texts))).collect()
    # Of pages with one url the first is read.
    twice = stored.page_texts(spark.createDataFrame([(2, "https://u.com/", "<p>late</p>"), (1, "https://u.com/", "<p>early words here</p>")], pages.schema))
    chosen = spark.createDataFrame([("r", "https://u.com/", 1)], "request_id string, url string, position int")
    _, chunks = stored.read_sources(chosen, twice)
    assert [r["text"] for r in chunks.collect()] == ["early words here"]


def test_no_text_of_all_pages_is_shuffled_for_a_search(spark):
    pages = spark.range(40).selectExpr("id page_id", "concat('https://a', id, '.com/') url", "concat('<p>', if(id % 2 = 0, 'Wind and solar ', 'solar '), id, '</p>') html")
    texts = plan.stored(stored.page_texts(pages))
    words = plan.stored(stored.page_words(texts))
    asked = spark.createDataFrame([("r", 0, "wind solar", 3), ("r", 1, "solar", 2), ("q", 0, "wind 7", 30), ("q", 1, "none", 4)], "request_id string, place int, query string, count int")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        found = stored.results(texts, asked, words=words)
        got = {(r["request_id"], r["ord"]): (r["url"], r["rank"], r["query"], r["snippet"]) for r in found.collect()}
        plans = found._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plans and "Exchange hashpartitioning(page_id" not in plans and "SortMergeJoin" not in plans
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    want = {("r", 1 + i): (f"https://a{2 * i}.com/", 1 + i, "wind solar", f"solar {2 * i}") for i in range(3)}
    want |= {("r", 1_000_001 + i): (f"https://a{i}.com/", 1 + i, "solar", f"solar {i}") for i in range(2)}
    # A word of one character is no word to search for; what stands first in the query's sorted words begins the snippet.
    want |= {("q", 1 + i): (f"https://a{2 * i}.com/", 1 + i, "wind 7", f"Wind and solar {2 * i}") for i in range(20)}
    assert got == want


def grown(paragraphs, lengths, at, name, stops, most):
    first = last = at
    size, left, right = lengths[at], True, True

    def fine(i):
        return 0 <= i < len(lengths) and paragraphs[i] == paragraphs[at] and size + 1 + lengths[i] <= most and not any(s["seq"] == i and s["name"] != name for s in stops)

    for step in range(4 * len(lengths) + 4):
        if step % 2 == 0 and left:
            left = fine(first - 1)
            size, first = (size + 1 + lengths[first - 1], first - 1) if left else (size, first)
        elif step % 2 and right:
            right = fine(last + 1)
            size, last = (size + 1 + lengths[last + 1], last + 1) if right else (size, last)
    return {"name": name, "first": first, "last": last}


def test_spans_by_bisection_grow_like_steps():
    rng = random.Random(2)
    for _ in range(2000):
        n = rng.randint(1, 14)
        lengths, paragraphs = [rng.randint(1, 30) for _ in range(n)], sorted(rng.randint(0, 2) for _ in range(n))
        stops = [{"seq": rng.randrange(n), "name": rng.choice("abc")} for _ in range(rng.randint(0, 4))]
        mine = [{"seq": rng.randrange(n), "name": rng.choice("abc")} for _ in range(3)]
        most = rng.randint(5, 150)
        assert evidence._spans(paragraphs, lengths, mine, stops, most) == [grown(paragraphs, lengths, m["seq"], m["name"], stops, most) for m in mine]


def test_a_long_paragraph_with_many_matches(spark):
    # 2,000 sentences of ten words, each with the name; another name stands in every hundredth.
    text = " ".join(f"Here is Acme Labs again in sentence number {i} with {'Other Corp' if i % 100 == 50 else 'more words'}." for i in range(2000))
    texts = spark.createDataFrame([("r", 1, text)], "request_id string, source_id long, text string")
    names = spark.createDataFrame([("r", "Acme Labs"), ("r", "Other Corp")], "request_id string, name string")
    found = evidence.sentence_matches(texts, names)
    began = time.time()
    got = evidence.windows(texts, found, names).collect()
    assert time.time() - began < 60
    assert len(got) > 1000 and all(len(r["text"]) <= 1200 and not r["first"] <= 50 <= r["last"] for r in got)
    assert not any("Exchange" in line and "sentence" in line for line in evidence.windows(texts, found, names)._jdf.queryExecution().executedPlan().toString().splitlines())


def test_paragraphs_end_windows(spark):
    texts = spark.createDataFrame([("r", 1, "One old start here.\n\nAcme Labs is in this one. So is this sentence.\n \nAnd a last one.")], "request_id string, source_id long, text string")
    names = spark.createDataFrame([("r", "Acme Labs")], "request_id string, name string")
    got = evidence.windows(texts, evidence.sentence_matches(texts, names), names, least=5).collect()
    assert [(r["first"], r["last"], r["text"]) for r in got] == [(1, 2, "Acme Labs is in this one. So is this sentence.")]


@pytest.mark.parametrize("least", [0.5, 0.85, 1.0])
def test_copies_by_rare_tokens_are_those_of_a_plain_fold(least):
    rng = random.Random(3)
    for _ in range(400):
        bases = [set(rng.sample(range(30), rng.randint(0, 25))) for _ in range(4)]
        sets = [set(rng.choice(bases)) ^ set(rng.sample(range(30), rng.randint(0, 3))) for _ in range(rng.randint(1, 25))]
        kept, want = [], []
        for s in sets:
            want.append(not any(s == k or len(s & k) >= least * max(len(s), len(k), 1) for k in kept))
            kept += [s] if want[-1] else []
        assert entities.first_of_copies(sets, least) == want


def test_copies_in_a_document_of_many_lines():
    rng = random.Random(4)
    sets = [set(rng.sample(range(40_000), 12)) | {-1, -2, -3} for _ in range(20_000)]
    for i in range(0, 20_000, 4):
        sets[i] = set(sets[i - 1]) - {max(sets[i - 1])} if i else sets[i]
    began = time.time()
    got = entities.first_of_copies(sets, 0.85)
    assert sum(got) == 15_001 and time.time() - began < 20


def test_the_last_answer_with_evidence_fills_a_gap(spark):
    fields = spark.createDataFrame([("r", "e", "site", None), ("r", "e", "size", None), ("r", "e", "name", "E")], "request_id string, entity string, column string, value string").withColumn("column_ord", F.lit(0))
    proof = spark.createDataFrame([("r", "e", "x1", "u1", "t", "one"), ("r", "e", "x1", "u1", "t", "one"), ("r", "e", "x2", "u2", "t", "two")], "request_id string, entity string, chunk_id string, url string, title string, text string")
    rows = [("site", "zz first", 0.9, ["x1"], 0), ("site", "second", 0.5, ["x2", "x1"], 1), ("site", "unproven", 0.9, ["x9"], 2), ("site", None, 0.9, ["x1"], 3), ("size", "one", 0.1, ["x1"], 1), ("size", "two", 0.1, ["x1"], 1), ("name", "F", 1.0, ["x1"], 0)]
    said = spark.createDataFrame([("r", "e", " e ", False, *r) for r in rows], "request_id string, entity string, answered_name string, provisional boolean, column string, value string, confidence double, chunk_ids array<string>, place int")
    got = {r["column"]: (r["value"], [e["source_url"] for e in r["evidence"]]) for r in answers.gap_updates(said, fields, proof).collect()}
    assert got == {"site": ("second", ["u2", "u1"]), "size": ("two", ["u1"])}


def test_answers_by_a_schema(spark):
    told = ['{"names":["A"],"n":1}', '{"names":["A"],"n":null}', '{"names":[', '{"refusal":" no "}', '{"n":1}', '{"names":"A"}', "[]", "null", "", None, '{"names":[],"refusal":""}']
    rows = spark.createDataFrame([*[(i, t, None) for i, t in enumerate(told)], (99, None, "TimeoutError: slow")], "id long, answer string, error string")
    got = {r["id"]: (r["parsed"] and r["parsed"]["names"], r["error"]) for r in providers.typed(rows, "names array<string>, n int", ["names"]).collect()}
    bad = (None, providers.NOT_PARSED)
    assert got == {0: (["A"], None), 1: (["A"], None), 2: bad, 3: (None, "no"), 4: bad, 5: bad, 6: bad, 7: bad, 8: bad, 9: bad, 10: ([], None), 99: (None, "TimeoutError: slow")}


def test_stems_are_words_of_the_corpus(spark):
    words = "city cities die dies house houses box boxes cat cats bus glass tried try hoped hope walked walk stopped stop making make running run sing thing needed asses news"
    terms = spark.createDataFrame([(w,) for w in words.split()], "term string")
    got = dict(map(tuple, stems.stems(terms).collect()))
    assert got == {"cities": "city", "dies": "die", "houses": "house", "boxes": "box", "cats": "cat", "tried": "try", "hoped": "hope", "walked": "walk", "stopped": "stop", "making": "make", "running": "run"}
    texts = spark.createDataFrame([("r", "a", "Cats and boxes"), ("r", "b", "a cat"), ("r", "c", "box of cats")], "request_id string, chunk_id string, text string")
    documents = postings.tokenised(texts)
    found = stems.stems(stems.vocabulary(texts))
    asked = stems.stemmed(spark.createDataFrame([("r", "cats"), ("r", "box")], "request_id string, term string"), found, "request_id")
    index = postings.build(documents, asked, found)
    assert sorted((r["term"], r["chunk_id"]) for r in index.postings.collect()) == [("box", "a"), ("box", "c"), ("cat", "a"), ("cat", "b"), ("cat", "c")]


def test_alignment_writes_only_the_tokens_of_the_query(spark, monkeypatch):
    written, cut = [], entities.cut
    monkeypatch.setattr(entities, "cut", lambda df: written.append(cut(df)) or written[-1])
    texts = spark.createDataFrame([("r", "a", 1, "red green"), ("r", "a", 0, "Blue x.\ny RED"), ("r", "b", 0, "green"), ("other", "c", 0, "red")], "request_id string, entity string, seq long, text string")
    plans = spark.createDataFrame([("r", "red green", "red green", ["red"])], "request_id string, normalized_query string, base_query string, rewrites array<string>")
    got = {r["entity"]: (round(r["span"], 2), round(r["anchor"], 2)) for r in entities.alignment(texts, plans).collect()}
    assert got == {"a": (1.0, 1.0), "b": (0.5, 0.0)}
    docs = {r["chunk_id"]: (r["length"], r["tokens"]) for df in written if "tokens" in df.columns for r in df.collect()}
    assert docs == {"a": (6, ["red", "red", "green"]), "b": (1, ["green"]), "c": (1, [])}


def test_used_variants_in_one_count(spark):
    rows = spark.createDataFrame([("r", "a", v) for v in ("y", "x", "x", "y", "z", " ", None)], "request_id string, entity string, variant string")
    got = entities.used_variants(rows, spark.createDataFrame([("y", 0)], "variant string, place int")).collect()
    assert [(r["dominant"], sorted(r["supporting"])) for r in got] == [("y", ["x", "y", "z"])]
