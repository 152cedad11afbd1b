"""The training-data operators against brute force, on small tables with nulls, repeats, ties and clashing columns."""

import functools
import hashlib
import re
import time
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sieveline.llm import common, components, hashing, hnsw, mixing, neardup, packing, pii, quality, sharding, substring, topk, toxicity
from sieveline.llm.queries import tokenizer_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def docs(spark, texts, sources=None):
    rows = [(i, t, "en", (sources or ["a"] * len(texts))[i], None if t is None else len(t)) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def corpus(seed=1, n=60):
    """Random texts, near copies, a shared passage, exact copies, odd texts."""
    rng = np.random.default_rng(seed)
    w = [f"w{i}" for i in range(400)]
    out = [" ".join(rng.choice(w, rng.integers(20, 80))) for _ in range(n)]
    passage = " ".join(rng.choice(w, 55))
    for i in range(0, 30, 3):
        out[i] += " " + passage
    base = " ".join(rng.choice(w, 120)).split()
    for _ in range(25):
        copy = list(base)
        for at in rng.choice(120, rng.integers(1, 4), replace=False):
            copy[at] = "X" + copy[at]
        out.append(" ".join(copy))
    return out + [out[5], out[5].upper(), None, "", " \t\n ", "one", "one two", "one", " a b c\x1c d", "é " * 30, "a" * 9000]


def union(links, nodes):
    up = {n: n for n in nodes}

    def top(v):
        while up[v] != v:
            v = up[v]
        return v

    for a, b in links:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    return {n: top(n) for n in nodes}


def test_components(spark):
    rng = np.random.default_rng(2)
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + k) for k in range(1, 30)] + [tuple(map(int, rng.integers(200, 400, 2))) for _ in range(80)]
    df = spark.createDataFrame([*links, (5, 5), (None, 3)], "a long, b long")
    got = {r["node"]: r["component"] for r in components.connected_components(df).collect()}
    nodes = {x for p in links if p[0] != p[1] for x in p}
    assert got == union([p for p in links if p[0] != p[1]], nodes)
    assert components.connected_components(df.limit(0)).count() == 0


def brute_near(texts, width, percent):
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    sets = []
    for t in texts:
        w = WORD.findall((t or "").translate(low))
        sets.append({tuple(w[j : j + width]) for j in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set())
    links = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])]
    return [len(s) for s in sets], union(links, range(len(sets)))


@pytest.mark.parametrize("width, few, lists, sets", [(4, 32, 65536, 2_000_000), (5, 2, 8, 500), (5, 2, 65536, 2_000_000)])
def test_near_duplicates(spark, monkeypatch, width, few, lists, sets):
    """Also with groups of many blocks, null ids, repeated rows and a text of 20,000 words."""
    monkeypatch.setattr(neardup, "FEW", few)
    monkeypatch.setattr(neardup, "LIST_BLOCK", lists)
    monkeypatch.setattr(neardup, "SET_BLOCK", sets)
    texts = corpus()
    long = " ".join(np.random.default_rng(4).choice([f"w{i}" for i in range(900)], 20_000))
    texts += [long, "first " + long, texts[3] + " A B"]
    n, comp = brute_near(texts, width, 80)
    df = docs(spark, texts).withColumn("component_id", F.lit("x")).withColumn("rep", F.lit(1))
    extra = df.where("doc_id in (0, 5)").unionByName(df.where("doc_id = 7").withColumn("doc_id", F.lit(None).cast("long")))
    rows = neardup.near_duplicates(df.unionByName(extra), width, 80).collect()
    assert [(r["n_shingles"], r["component_id"], r["kept"]) for r in rows if r["doc_id"] is None] == [(n[7], None, True)]
    rows = [r for r in rows if r["doc_id"] is not None]
    got = {r["doc_id"]: r for r in rows}
    assert len(rows) == len(texts) + 2 and len(set(rows)) == len(texts)
    for i in range(len(texts)):
        assert (got[i]["n_shingles"], got[i]["component_id"], got[i]["kept"]) == (n[i], comp[i], comp[i] == i)
    assert neardup.near_duplicates(df.limit(0)).count() == 0


def test_near_duplicates_of_texts_that_share_an_id(spark):
    t = corpus()
    rows = [(1, t[0]), (1, t[1]), (2, t[1] + " x"), (3, t[2]), (3, t[2]), (3, t[40]), (9, t[40]), (None, t[0])]
    got = sorted((tuple(r) for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).drop("n_shingles").collect()), key=str)
    assert got == sorted([(1, 1, True), (1, 1, True), (2, 1, False), (3, 3, True), (3, 3, True), (3, 3, True), (9, 3, False), (None, None, True)], key=str)


def test_pairs_that_agree():
    rng = np.random.default_rng(0)
    mark = rng.integers(-1, 2, (60, 48)).astype(np.int8)
    mark[40:] = mark[7]
    mark[40:][rng.random((20, 48)) < 0.2] = 9
    comp, n, side = rng.integers(0, 30, 60), rng.integers(80, 120, 60), np.arange(60) % 2
    full = (mark[:, None] == mark[None]).sum(axis=2)
    fits = 100 * np.minimum(n[:, None], n) >= 80 * np.maximum(n[:, None], n)
    for s, most in ((None, 10**6), (side, 10**6), (None, 3)):
        neardup.PAIRS, before = most, neardup.PAIRS
        found = [tuple(sorted(p)) for i, j in neardup.pairs_of(mark, n, 80, [comp, np.arange(60)], s) for p in zip(i.tolist(), j.tolist())]
        neardup.PAIRS = before
        want = {(i, j) for i in range(60) for j in range(i + 1, 60) if full[i, j] >= neardup.AGREE and comp[i] != comp[j] and fits[i, j] and (s is None or s[i] != s[j])}
        assert len(found) == len(set(found)) and set(found) == want and len(want) > 50


def test_alike_members_of_many_components_make_one_forest():
    """3,000 rows that agree but are not linked: each pair is looked at once at most, and the forest spans them."""
    rng = np.random.default_rng(5)
    mark = np.tile(rng.integers(-128, 128, 48).astype(np.int8), (3000, 1))
    mark[rng.random(mark.shape) < 0.1] = 1
    began = time.time()
    assert len(neardup.related(np.arange(3000), np.arange(3000), mark, np.full(3000, 300), 80)) == 2999 and time.time() - began < 10


def test_signatures_agree_as_sets_do():
    rng = np.random.default_rng(2)
    a = rng.integers(0, 2**64, 1000, np.uint64, endpoint=False)
    for share in (0.0, 0.5, 0.8, 1.0):
        shares = []
        for k in range(60):
            both = rng.permutation(a)[: int(1000 * share)]
            rest = [rng.integers(0, 2**64, (1000 - len(both)) // 2, np.uint64, endpoint=False) for _ in range(2)]
            x, y = (np.unique(np.concatenate([both, r])) for r in rest)
            sig = neardup.signatures(np.concatenate([x, y]), np.array([0, len(x), len(x) + len(y)]))
            shares.append((sig[0] == sig[1]).mean())
        assert abs(np.mean(shares) - share) < 0.03


def test_a_family_of_many_gives_each_row_once(spark):
    """100,000 members in one group: as many rows as members, and unlike members take no pairs."""
    rows = spark.range(100_000).select(F.lit(1).alias("family"), F.col("id").alias("rep"), F.lit(18).alias("n_shingles"))
    dealt = neardup.in_blocks(rows, "family", "1", neardup.LIST_BLOCK)
    assert neardup.in_pairs(dealt, inside=True).count() == 2 * 100_000 and neardup.in_pairs(neardup.in_blocks(rows, "family", "n_shingles", neardup.SET_BLOCK), inside=True).count() == 100_000
    rng = np.random.default_rng(1)
    mark = rng.integers(-128, 128, (100_000, 48)).astype(np.int8)
    mark[50_000:] = mark[0]  # half of them alike, and of one component
    comp = np.concatenate([np.arange(50_000), np.zeros(50_000, np.int64)])
    began = time.time()
    assert sum(len(i) for i, _ in neardup.pairs_of(mark, np.full(100_000, 300), 80, [comp, np.arange(100_000)])) == 0 and time.time() - began < 60


def brute_substring(rows, window):
    low = {}
    for i, t in rows:
        w = WORD.findall(t or "")
        for j in range(len(w) - window + 1 if i is not None else 0):
            low[tuple(w[j : j + window])] = min(low.get(tuple(w[j : j + window]), i), i)
    out = []
    for i, t in rows:
        w = WORD.findall(t or "")
        keep = [True] * len(w)
        for j in range(len(w) - window + 1 if i is not None else 0):
            if low[tuple(w[j : j + window])] < i:
                keep[j : j + window] = [False] * window
        out.append((i, len(w), keep.count(False), hashlib.sha256(" ".join(x for x, k in zip(w, keep) if k).encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("window, size", [(13, 4 << 20), (13, 2000), (7, 2000), (40, 2000)])
def test_substring(spark, window, size):
    """Null and repeated ids, a text of 20,000 words, a long word, a passage in every third document, ties."""
    texts = corpus()
    rng = np.random.default_rng(12)
    hot = " ".join(rng.choice([f"h{i}" for i in range(90)], 60))
    rows = [*enumerate(texts), (3, texts[5]), (3, texts[3]), (None, texts[5]), (None, texts[5]), (2**40, texts[7])]
    rows += [(1000 + i, f"a{i} b{i} " + hot + f" c{i}") for i in range(40)] + [(5000, " ".join(rng.choice([f"w{i}" for i in range(400)], 20_000))), (5001, "x " + "y" * 10_000 + " z " * 40), (-4, hot)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("block", F.lit(3)).withColumn("keys", F.lit(3))
    want = brute_substring(rows, window)
    assert sorted((tuple(r) for r in substring.remove_repeats(df, window, size, size).collect()), key=str) == want
    assert sum(w[2] for w in want) > 1000 and substring.remove_repeats(df.limit(0)).count() == 0


def test_substring_levels():
    assert substring.lengths(13) == [4, 7, 13] and substring.lengths(50) == [4, 7, 13, 25, 50] and substring.lengths(6) == [6]


def test_substring_tells_windows_of_equal_hashes_apart(monkeypatch):
    """The first hash of every word is the same; a second one decides, inside a block and between blocks."""
    plain = substring.word_hashes
    monkeypatch.setattr(substring, "word_hashes", lambda data, start, end, kind=0: plain(data, start, end, kind) if kind else np.zeros(len(start), np.uint64))
    rng = np.random.default_rng(2)
    texts = [" ".join(rng.choice([f"w{i}" for i in range(50)], 80)) for _ in range(30)]
    rows = [*enumerate(texts), (40, "x " + texts[3][: len(texts[3]) // 2] + " y"), (41, texts[8]), (42, None), (43, "few words")]
    want = {r[0]: r for r in brute_substring(rows, 13)}
    for cuts in ([rows], [rows[:20], rows[20:]]):
        tables = [pa.table({"doc_id": pa.array([i for i, _ in part], pa.int64()), "text": pa.array([None if t is None else t.encode() for _, t in part], pa.binary())}) for part in cuts]
        bits = {}
        for level in range(3):
            posts = []
            for k, table in enumerate(tables):
                block = substring._at(table, bits.get(k), level, 13, 4)
                block.extend(level)
                posts.append(block.posts(k))
            posts = pa.concat_tables(posts)
            for bucket in sorted(set(posts["bucket"].to_pylist())):
                said = substring._judged(level, level == 2)(posts.filter(pc.equal(posts["bucket"], bucket)))
                for k in range(len(tables)):
                    mine = said.filter(pc.equal(said["block"], k))
                    bits[k] = pa.concat_tables([bits[k], mine]) if k in bits else mine
        got = [r for k, table in enumerate(tables) for r in substring._at(table, bits.get(k), 3, 13, 4).digests().to_pylist()]
        assert {r["doc_id"]: tuple(r.values()) for r in got} == want and sum(w[2] for w in want.values()) > 100


def test_words_and_their_hashes():
    texts = ["", "a", " a  b", "\u00e9\u00e9 a\x1cb\u2003c", "b\t", "x" * 9000 + " " + "x" * 9000 + "y", "\n\n", "ab c", "a bc"]
    data, offsets = hashing.flat(pa.array(texts))
    start, end, row = hashing.split(data, offsets)
    found = [(r, data[a:b].tobytes().decode()) for a, b, r in zip(start, end, row)]
    assert found == [(i, w) for i, t in enumerate(texts) for w in WORD.findall(t)]
    h = hashing.word_hashes(data, start, end)
    assert len(set(h.tolist())) == len({w for _, w in found}) and len({(w, int(x)) for (_, w), x in zip(found, h)}) == len({w for _, w in found})
    alone = [hashing.windows(h[i : i + 5], 5)[0] for i in range(len(h) - 4)]
    assert hashing.windows(h, 5).tolist() == alone and len(hashing.windows(h, len(h) + 1)) == 0


BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def base_spans(text):
    def fine(kind, m):
        d = re.sub("[^0-9]", "", m)
        if kind == "card":
            s = sum(v if k % 2 == 0 else (2 * v - 9 if v > 4 else 2 * v) for k, v in enumerate(map(int, reversed(d))))
            return 13 <= len(d) <= 19 and s % 10 == 0
        return {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m.split(".")), "phone": 9 <= len(d) <= 15}[kind]

    return [f"{k}:{m.start()}:{m.end()}" for k in BASE for m in re.finditer(BASE[k], text or "") if fine(k, m[0])]


def test_private(spark):
    texts = [None, "", "mail a.b@c.example.com, then a@b.c@d.e.f and x@y", "ips 1.2.3.4.5.6.7.8 999.1.1.1 0255.000.1.2 1.2.3", "card 4111 1111 1111 1111 and 4111-1111-1111-1112 or 4111111111111111 1",
             "call +1 (988) 555-2485 or +44 20 7946 0958; +1 2", "é😀 a@b.co \x01\x02 +1 988 555 2485", "7" * 4000, "a" * 5000 + "@", "1-" * 3000, "x@y." * 2000, "bob [at] example [dot] com, (988) 555-2485", "1.2.3.4 " * 300, "4 " * 40]
    df = docs(spark, texts).withColumn("spans", F.lit(1)).withColumn("n_ip", F.lit("q"))
    got = {r["doc_id"]: r for r in pii.find(df).collect()}
    for i, t in enumerate(texts):
        want = base_spans(t)
        assert got[i]["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest(), t[:40]
        assert set(want) <= set(got[i]["spans"].split(",")) | ({""} if not want else set())
        assert [got[i][f"n_{k}"] for k in BASE] == [sum(w.startswith(k) for w in want) for k in BASE]
    clean = {r["doc_id"]: r["text"] for r in pii.redact(docs(spark, texts)).collect()}
    assert clean[0] is None and clean[2].startswith("mail <email>, then <email>") and "555" not in clean[5] and clean[6].startswith("é😀 <email> ")
    assert pii.find(df.limit(0)).count() == 0


def test_private_trees_decide(spark):
    """Masked addresses are taken, look-alikes that generators find too are not; without trees nothing is added."""
    rng = np.random.default_rng(3)
    w = [f"{a}{b}" for a in "bcdfglmnprst" for b in ("ane", "orel", "ivy", "ust", "olan")]
    filler = lambda: " ".join(rng.choice(w, 40))
    texts = [f"{filler()} mail {rng.choice(w)}.{rng.choice(w)}@{rng.choice(w)}.example.com {filler()} +1 (98{i % 10}) 555-24{i % 90 + 10} {filler()}" for i in range(300)]
    odd = [f"{filler()} write to bob [at] example [dot] com or {filler()}", f"{filler()} pears @ 3.50 and {filler()}"]
    df = docs(spark, texts + odd)
    found = common.cut(pii.candidates(df))
    model = pii.fit(found)
    assert model["email"]["precision"] > 0.95 and model["email"]["recall"] > 0.8 and not model["card"]["codes"]
    got = {r["doc_id"]: r for r in pii.find(df).collect()}
    at = odd[0].index("bob [at]")
    assert got[300]["spans"] == f"email:{at}:{at + len('bob [at] example [dot] com')}" and got[300]["n_email"] == 0 and got[301]["spans"] == ""
    loose = {r["doc_id"]: r["c_email"] for r in found.collect()}
    assert len(loose[300]) == len(loose[301]) == 1
    assert not any(m["codes"] for m in pii.fit(found, rounds=0).values())
    assert "<email>" in pii.redact(df.where("doc_id = 300").unionByName(df)).where("doc_id = 300").first()["text"]


def test_running_sums(spark, monkeypatch):
    monkeypatch.setattr(pii, "RUN", 4)
    rows = [[], [5], [1, 2, 3, 4], list(range(23))]
    df = spark.createDataFrame([(r,) for r in rows], "a array<bigint>")
    assert [r[0] for r in df.select(pii.running(F.col("a"))).collect()] == [np.cumsum(r).tolist() if r else [] for r in rows]
    assert [r[0] for r in df.select(pii.running(F.reverse("a"), F.greatest)).collect()][3] == [22] * 23


def test_pack(spark):
    from tokenizers import Tokenizer

    texts = [None, "", "hello world", "a b <|endoftext|> c", "It's Él Straße NAÏVE×2 e\u0301 İstanbul ΣΑΣ x\u00a0y a\x1cb \u2028 12½ 日本 Ÿ µ ª º ¿qué? don't'S __a-b<c>d~ 😀", *[t for t in corpus() if t], "word " * 5000, "a\x0bb\x0cc\x85d", "w" * 70_000, "hello world"]
    got = packing.pack(docs(spark, texts).withColumn("length", F.lit("x")), tokenizer_path(), group=40).toPandas()
    tok = Tokenizer.from_file(tokenizer_path())
    for i, t in enumerate(texts):
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        want = [(p, a, len(ids[a : a + 2048]), zlib.crc32(ids[a : a + 2048].tobytes())) for p, a in enumerate(range(0, len(ids), 2048))]
        mine = got[got.doc_id == i].sort_values("piece")
        assert list(zip(mine["piece"], mine["start"], mine["length"], mine["ids_crc32"])) == want
    again = packing.pack(docs(spark, ["tie"] * 9 + [None]).withColumn("doc_id", F.when(F.col("doc_id") > 4, F.col("doc_id") % 3)), tokenizer_path()).toPandas()
    assert len(again) == 10 and again["doc_id"].isna().sum() == 5 and again["sequence_id"].nunique() == 1 and sorted(again["offset"]) == (again["length"].sort_values(ascending=False).cumsum() - again["length"].sort_values(ascending=False)).tolist()
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert g["length"].sum() <= 2048 and (g["offset"] == g["length"].cumsum() - g["length"]).all()
    assert packing.pack(docs(spark, texts).limit(0), tokenizer_path()).count() == 0


def test_encoder_is_the_tokenizer():
    """Random strings of letters, accents, signs, digits, quotes, other scripts and white space of all kinds."""
    from tokenizers import Tokenizer

    rng, tok = np.random.default_rng(1), Tokenizer.from_file(tokenizer_path())
    letters = list("aZ \u00e9\u00c9\u00df\u00ff\u00fe\u00de\u00d7\u00f7'<>&\t\n\r\x0b\x0c0129.,!-_\u00f1\u00c7\xa0\u2003\u65e5\u0153\u0152 e\u0301\u0130\U0001f600")
    texts = ["".join(rng.choice(letters, rng.integers(0, 30))) for _ in range(3000)]
    ids, edges = packing.Encoder(tokenizer_path())(pa.array(texts))
    for t, a, b in zip(texts, edges, edges[1:]):
        assert ids[a:b].tolist() == [*tok.encode(t, add_special_tokens=False).ids, 0], t


def test_encoder_forgets():
    encode = packing.Encoder(tokenizer_path(), limit=100)
    texts = pa.array([" ".join(corpus()[i : i + 9][j] or "" for j in range(9)) for i in range(0, 45, 9)])
    whole = packing.Encoder(tokenizer_path())(texts)
    parts = [encode(texts.slice(i, 1))[0] for i in range(5)]
    assert np.concatenate(parts).tolist() == whole[0].tolist()


def test_sum_of_squares_follows_the_rule():
    rng = np.random.default_rng(4)
    sizes = np.sort(rng.integers(1, 40, 300))[::-1]
    seq, off = packing.sum_of_squares(sizes, 40)
    used, order = {}, []
    for s, b, o in zip(sizes, seq, off):
        gaps = lambda u: sum(n * n for n in np.bincount([40 - x for x in u.values() if x < 40], minlength=1))
        assert used.get(b, 0) == o
        order.append((gaps(used | {b: o + s}), min(gaps(used | {k: used.get(k, 0) + s}) for k in ([k for k in used if used[k] + s <= 40] or [-1]))))
        used[b] = o + s
    assert all(a == b for a, b in order)
    many = rng.integers(1, 40, 3000)
    assert len(set(packing.sum_of_squares(many, 40)[0])) <= 1.03 * max(many.sum() / 40, (many > 20).sum())


def brute_topk(v, every, k=5):
    return {(q, n + 1): (c, -s) for q in v if q % every == 0 for n, (s, c) in enumerate(sorted((-int(v[q] @ v[c]), c) for c in v if c != q and len(v[c]) == len(v[q]))[:k])}


def test_topk(spark):
    """Ties, repeated ids with one or two vectors, null ids, vectors that take no part, other lengths and clashing columns."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(160, 16)).astype(np.float32)
    x[20:30] = x[10]
    rows = [(i, [float(v) for v in r], 0) for i, r in enumerate(x)] + [(500, None, 0), (550, [float("nan")] * 16, 0), (600, [], 0), (650, [None] * 16, 0), (700, [0.5] * 16, 0), (700, [0.5] * 16, 0), (None, [0.5] * 16, 0), (800, [0.25] * 16, 0), (800, [0.75] * 16, 0), (900, [1.0, 2.0], 0), (910, [1.0, -2.0], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("rank", F.lit(1)).withColumn("v", F.lit("x"))
    got = topk.search(df, every=10).collect()
    v = {i: np.floor(256 * np.array(e, float)).astype(int) for i, e, _ in rows[:160]} | {700: np.full(16, 128), 800: np.full(16, 64), 900: np.array([256, 512]), 910: np.array([256, -512])}
    assert {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in got} == brute_topk(v, 10)
    assert topk.search(df.limit(0)).count() == 0


@pytest.mark.parametrize("seed, scale", [(0, 1), (1, 40), (2, 2**17)])
def test_maxscore_is_exact_and_reads_few_postings(seed, scale):
    """Rows with a few heavy dimensions each, as texts have: most postings are never read. The last case passes doubles."""
    rng = np.random.default_rng(seed)
    rows = rng.integers(-1, 2, (4000, 48))
    for r in rows:
        r[rng.choice(48, 3, replace=False)] = rng.integers(100, 300, 3)
    rows[100:140] = rows[7]
    rows *= scale
    ids = np.sort(rng.choice(10**6, 4000, replace=False))
    at = np.arange(0, 4000, 50)
    got, read = topk.maxscore(rows[at], ids[at], rows, ids)
    want = []
    for i in at.tolist():
        s = rows @ rows[i]
        want += [(int(ids[i]), int(ids[j]), int(s[j])) for j in [j for j in np.lexsort((ids, -s)).tolist() if j != i][:5]]
    assert got == want and read < 0.1 * len(at) * rows.size


def test_maxscore_on_dense_rows():
    rng = np.random.default_rng(3)
    for n, d in ((3, 4), (6, 1), (300, 8), (50, 64)):
        rows = rng.integers(-9, 10, (n, d))
        ids = np.arange(n) * 10
        got, _ = topk.maxscore(rows, ids, rows, ids)
        want = [(i * 10, c, -t) for i in range(n) for t, c in sorted((-int(rows[i] @ rows[j]), j * 10) for j in range(n) if j != i)[:5]]
        assert got == want


def test_embeddings(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(500, 16))
    centre = rng.normal(size=16)
    x[100:260] = centre + 0.15 * rng.normal(size=(160, 16))
    x[300:340] = x[7] * rng.uniform(0.5, 2, (40, 1))
    x[340:350] = x[8]
    rows = [(i, [float(v) for v in r], 0) for i, r in enumerate(x.astype(np.float32))] + [(900, None, 0), (901, [0.0] * 16, 0), (902, [float("inf")] * 16, 0), (903, [None] * 16, 0), (904, [], 0), (None, None, 0), (None, [float(v) for v in x[8]], 0), (300, [float(v) for v in x[300].astype(np.float32)], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("rep", F.lit("x")).withColumn("n_links", F.lit(-1))
    every = hnsw.near_duplicates(df).collect()
    assert len(every) == len(rows) and sum(r["vec_id"] == 300 for r in every) == 2 and hnsw.near_duplicates(df.limit(0)).count() == 0
    assert [tuple(r) for r in every if r["vec_id"] is None] == [(None, 0, None, True)] * 2
    got = {r["vec_id"]: r for r in every if r["vec_id"] is not None}
    u = x.astype(np.float32).astype(float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    near = u @ u.T >= 0.9 - 1e-12
    np.fill_diagonal(near, False)
    links = np.array([got[i]["n_links"] for i in range(500)])
    assert links.sum() >= 0.99 * near.sum() and (links <= near.sum(axis=1)).all()
    comp = union(zip(*np.nonzero(near)), range(500))
    assert np.mean([got[i]["component_id"] == comp[i] for i in range(500)]) > 0.99
    assert all(got[i]["n_links"] == 0 and got[i]["kept"] for i in range(900, 905))


def hot_shard(rows=6000, hot=900, dim=24):
    """Unit vectors: pairs of near ones, and a hot group near one centre."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(rows, dim))
    x[1 : rows - hot : 2] = x[0 : rows - hot : 2] + 0.15 * rng.normal(size=((rows - hot) // 2, dim))
    x[rows - hot :] = x[0] + 0.22 * rng.normal(size=(hot, dim))
    x = x[rng.permutation(rows)]
    return x / np.linalg.norm(x, axis=1, keepdims=True)


@functools.cache
def hot_graph():
    x = hot_shard()
    return x, hnsw.Graph.build(x.astype(np.float32))


@pytest.mark.parametrize("lost", [0, 3])
def test_embedding_answers_when_links_into_nodes_are_lost(lost):
    """Every lost-th node has no links into it, so no walk gets to it. One graph of 6,000 rows, built in batches."""
    x, built = hot_graph()
    graph = hnsw.Graph(built.x, [t.copy() for t in built.layers])
    if lost:
        for table in graph.layers:
            table[(table % lost == 1) & (table >= 0)] = -1
    names, weight = np.arange(len(x)) * 7, np.arange(len(x)) % 3 + 1
    near = x @ x.T >= 0.9
    np.fill_diagonal(near, False)
    (a, b), (u, v), (scanned, counts) = hnsw._answers(graph, names, x, weight, x, names, 0.9, 0.99)
    assert near[a, b].all() and near[u, v].all() and (counts == near[scanned] @ weight).all()
    by_beam = np.setdiff1d(np.arange(len(x)), scanned)
    own = np.isin(a, by_beam)
    heard = np.bincount(a[own], weights=weight[b[own]], minlength=len(x))[by_beam]
    assert (heard <= near[by_beam] @ weight).all() and len(scanned) >= 900 and (lost or len(by_beam) > 4000)  # what audits fail is scanned
    print("recall", lost, (heard.sum() + counts.sum()) / (near @ weight).sum(), "scanned", len(scanned))
    assert heard.sum() + counts.sum() >= 0.99 * (near @ weight).sum()
    told = near.copy()
    told[by_beam] = False
    told[:, told.sum(axis=0) > hnsw.THIN] = False
    rest = np.zeros_like(near)
    rest[a[~own], b[~own]] = True
    assert (rest == told).all()
    found, true = union(zip([*a, *u], [*b, *v]), range(len(x))), union(zip(*np.nonzero(near)), range(len(x)))
    assert np.mean([found[i] == true[i] for i in range(len(x))]) > 0.99


def test_embedding_links_count_for_both_ends(spark, monkeypatch):
    """Half of the rows cannot be found by others; what they find themselves counts for the others too."""
    rng = np.random.default_rng(9)
    x = rng.normal(size=(2400, 16))
    x[1::2] = x[::2] + 0.12 * rng.normal(size=(1200, 16))
    monkeypatch.setattr(hnsw, "_heard", lambda *_: True)  # no audits, so beams answer all
    monkeypatch.setattr(hnsw, "_hashed", lambda *_: (1.0, np.empty(0, np.int64), np.empty(0, np.int64)))
    monkeypatch.setattr(hnsw, "LEAST_SHARDS", 2)
    built = hnsw.Graph.build.__func__

    def build(cls, *args):
        graph = built(cls, *args)
        for table in graph.layers:
            table[(table % 2 == 1) & (table >= 0)] = -1
        return graph

    monkeypatch.setattr(hnsw.Graph, "build", classmethod(build))
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    got = {r["vec_id"]: r for r in hnsw.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = u @ u.T >= 0.9
    np.fill_diagonal(near, False)
    links = np.array([got[i]["n_links"] for i in range(2400)])
    single = np.flatnonzero((near.sum(axis=1) == 1) & (near.sum(axis=1)[near.argmax(axis=1)] == 1))
    assert (links[single] == links[near[single].argmax(axis=1)]).all() and 0.5 < links[single].mean() <= 1


def test_embedding_audit_without_own_matches_and_on_few_links():
    """Two queries have a link that was not found, and all find themselves."""
    x = np.eye(300)
    x[1] = x[0] + 0.1 * x[5]
    x[1] /= np.linalg.norm(x[1])
    names, none = np.arange(300), np.zeros(300, np.int64)
    assert not hnsw._heard(x, names, x, names, none, np.arange(2), 0.9, 0.99)
    assert hnsw._heard(x, names, x, names, none, np.arange(2, 300), 0.9, 0.99)


class Partners(hnsw.Graph):
    """What a walk gets to is the other row of a pair, unless it is among the lost ones."""

    def __init__(self, x, paired, lost):
        self.x, self.paired, self.lost = x.astype(np.float32), paired, lost

    def search(self, q, beam):
        ids, sim = np.full((len(q), beam), -1, np.int64), np.full((len(q), beam), -2.0, np.float32)
        near = q @ self.x[self.paired].T
        best = near.argsort(axis=1)[:, -2:]
        seen = ~np.isin(self.paired[best], self.lost).any(axis=1)
        ids[seen, :2], sim[seen, :2] = self.paired[best][seen], np.take_along_axis(near, best, axis=1)[seen]
        return ids, sim


@pytest.mark.parametrize("lost, seed", [(0, 0), (15, 1), (15, 2), (15, 3)])
def test_embedding_audit_sees_rare_lost_links(lost, seed):
    """50 pairs among 20,000 rows; of some, both ends cannot be walked to, whatever the beam: then the shard is scanned."""
    rng = np.random.default_rng(seed)
    x, paired = rng.normal(size=(20_000, 24)), rng.permutation(20_000)[:100]
    x[paired[1::2]] = x[paired[::2]] + 0.1 * rng.normal(size=(50, 24))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    names, weight = np.arange(len(x)) * 3, np.ones(len(x), np.int64)
    (a, b), (u, v), (scanned, counts) = hnsw._answers(Partners(x, paired, paired[: 2 * lost]), names, x, weight, x, names, 0.9, 0.99, seed)
    due = sum(int((x[at : at + 500] @ x.T >= 0.9).sum()) - 500 for at in range(0, len(x), 500))
    assert due >= 100 and len(scanned) == (len(x) if lost else 0)
    assert counts.sum() + (~np.isin(a, scanned)).sum() == due


def test_random_planes_find_links_whatever_the_graph(monkeypatch):
    """At the threshold itself, with their chance or more; hot queries are handed on; with full buckets a share is compared."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(6000, 32))
    x[:2000] /= np.linalg.norm(x[:2000], axis=1, keepdims=True)
    aside = x[2000:4000] - (x[2000:4000] * x[:2000]).sum(axis=1, keepdims=True) * x[:2000]
    x[2000:4000] = 0.9001 * x[:2000] + np.sqrt(1 - 0.9001**2) * aside / np.linalg.norm(aside, axis=1, keepdims=True)
    x[5000:5200] = x[5000] + 0.05 * rng.normal(size=(200, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    names, every = np.arange(6000), np.arange(6000)
    share, links, over = hnsw._hashed(x, names, x, names, every, 0.9, 7)
    found = set(zip((links // 6000).tolist(), (links % 6000).tolist()))
    assert share == 1 and over.tolist() == list(range(5000, 5200)) and all(x[i] @ x[j] >= 0.9 and i != j for i, j in found)
    at_edge = sum((i, i + 2000) in found for i in range(2000))
    assert 0.82 < at_edge / 2000 < 0.95
    monkeypatch.setattr(hnsw, "HASHED_ROWS", 8)
    share, links, over = hnsw._hashed(x, names, x, names, every, 0.9, 7)
    assert 0 < share < 0.5 and 0.5 * share < len(links) / len(found) < 1.5 * share
    for case in (np.eye(3), np.ones((40, 2)) / np.sqrt(2)):  # few rows, all the same
        ids = np.arange(len(case))
        for cosine in (-1.0, 0.0, 0.9, 1.0):
            share, links, over = hnsw._hashed(case, ids, case, ids, ids, cosine, 0)
            assert 0 < share <= 1 and len(links) + len(over) <= len(case) ** 2
        assert len(hnsw._hashed(case, ids, case, ids, ids[:0], 0.9, 0)[1]) == 0
    assert hnsw._agreed(35, np.ones(0), 0.99) and hnsw._agreed(1000, np.ones(3), 0.99) and not hnsw._agreed(70, np.ones(25), 0.99) and not hnsw._agreed(0, np.ones(1), 0.99)


def test_mixing(spark):
    rng = np.random.default_rng(7)
    texts = [" ".join(["w"] * int(n)) for n in rng.integers(0, 60, 400)] + [None, "", "é b c"]
    sources = ["hot" if i % 3 else ["a", "b", "c", None][i % 4] for i in range(len(texts))]
    df = docs(spark, texts, sources).withColumn("total", F.lit("x")).withColumn("size", F.lit(1))
    got = mixing.weighted_fair_mix(df).toPandas().set_index("doc_id").sort_index()
    size = [len(WORD.findall(t or "")) for t in texts]
    assert got["size"].tolist() == size and (got["taken"] <= 3 * got["size"]).all() and (got["taken"] % got["size"].clip(lower=1) == 0).all()
    names = sorted({s for s in sources if s}) + [None]
    s = {k: sum(z for z, v in zip(size, sources) if v == k) for k in names}
    w = {k: i % 3 + 1 for i, k in enumerate(names)}
    full, target = set(), {}
    while True:
        left = sum(s.values()) - sum(3 * s[k] for k in full)
        target = {k: 3 * s[k] if k in full else left * w[k] / sum(w[j] for j in names if j not in full) for k in names}
        over = {k for k in names if target[k] > 3 * s[k] + 1e-9}
        if not over:
            break
        full |= over
    for k in names:
        rows = got[[v == k for v in sources]]
        assert rows["target"].iloc[0] == pytest.approx(target[k], abs=1e-5) and rows["source_size"].iloc[0] == s[k]
        assert abs(rows["taken"].sum() - target[k]) <= 60
    again = mixing.weighted_fair_mix(df.repartition(7)).toPandas().set_index("doc_id").sort_index()
    assert again.equals(got)
    assert mixing.weighted_fair_mix(df.limit(0)).count() == 0


def test_sharding(spark):
    table = sharding.lookup_table([f"s{i}" for i in range(7)], 701)
    share = np.bincount(table)
    assert share.max() - share.min() <= 1
    less = sharding.lookup_table([f"s{i}" for i in range(6)], 701)
    assert np.mean([a == b for a, b in zip(table, less) if a < 6]) > 0.75
    df = docs(spark, ["x"] * 50).unionByName(docs(spark, ["y"])).withColumn("shard", F.lit("old"))
    got = sharding.place(spark, df).collect()
    assert len(got) == 51 and all(0 <= r["shard"] < 64 for r in got)
    full = sharding.lookup_table([f"shard-{i:05d}" for i in range(64)])
    for r in got:
        slot = int(hashlib.md5(str(r["doc_id"]).encode()).hexdigest()[:8], 16) % sharding.SLOTS
        assert (r["slot"], r["shard"]) == (slot, full[slot])
    with pytest.raises(ValueError):
        sharding.lookup_table(["a", "b"], 8)


def labelled_corpus():
    rng = np.random.default_rng(8)
    w = [f"word{i}" for i in range(300)]
    texts, toxic, good = [], [], []
    for i in range(600):
        t, bad, poor = list(rng.choice(w, 40)), i % 5 == 0, i % 7 == 0
        if bad:
            t[3], t[20] = rng.choice(["scum", "idiot", "trash"], 2)
        if i % 3 == 0:
            t[10] = str(rng.choice(["women", "muslim", "gay", "elderly"]))
        texts.append(" ".join(x.upper() + "!!" for x in t) if poor else " ".join(t))
        toxic.append(int(bad))
        good.append(int(not poor))
    return texts, toxic, good


def test_classifiers(spark):
    texts, toxic, good = labelled_corpus()
    df = docs(spark, [*texts, None, ""]).withColumn("score", F.lit("x")).withColumn("y", F.lit(1))
    labels = spark.createDataFrame([(i, g, t) for i, (g, t) in enumerate(zip(good, toxic))] + [(None, 1, 1), (3, None, None), (10**9, 1, 1)], "doc_id long, quality int, toxic int")
    for run, truth, folds, held in ((toxicity.classify, toxic, 4, 2), (quality.classify, good, 5, 0)):
        got = {r["doc_id"]: r for r in run(df, labels).collect()}
        assert len(got) == 602 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got.values())
        assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % folds == held) for i, r in got.items())
        out = [i for i in range(600) if got[i]["held_out"]]
        assert np.mean([got[i]["predicted"] == truth[i] for i in out]) > 0.95
    assert toxicity.classify(df, labels.limit(0)).count() == 602 and quality.classify(df.limit(0), labels).count() == 0


def test_quality_sample_reaches_the_driver_without_objects_for_its_rows():
    """Rows that share a doc_id go by their features' bytes and their label; 20,000 rows of a sample take few copies of them."""
    import tracemalloc

    rng = np.random.default_rng(4)
    doc, x, y = rng.integers(0, 60, 200), rng.integers(0, 2, (200, 3)).astype(float), rng.integers(0, 2, 200)
    want = sorted((d, r.tobytes(), c) for d, r, c in zip(doc.tolist(), x, y.tolist()))
    got, label = quality.in_order(doc, x, y)
    assert [w[1] for w in want] == [r.tobytes() for r in got] and [w[2] for w in want] == label.tolist()
    doc, x, y = rng.permutation(20_000), rng.random((20_000, quality.SIZE)), rng.integers(0, 2, 20_000)
    tracemalloc.start()
    quality.in_order(doc, x, y)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 1.5 * x.nbytes


def test_quality_vectors_add_up_and_pool(spark, monkeypatch):
    """Context sums and pooled numbers against plain loops, over texts with nulls, empties, a long one and repeats."""
    texts = [None, "", " \t", "a b a c!! 12 b", "B b b", "x " * 5000 + "end", "a b a c!! 12 b", "\u00e9t\u00e9 -- a1b"]
    data, offsets = hashing.flat(pa.array(texts))
    start, end, row = hashing.split(data, offsets, hashing.PARTS)
    parts = [[data[a:b].tobytes().decode() for a, b, r in zip(start, end, row) if r == i] for i in range(len(texts))]
    assert parts == [re.findall(r"[0-9]+|[A-Za-z\u0080-\uffff]+|[^\sA-Za-z0-9\u0080-\uffff]+", t or "") for t in texts]
    c, _, _, row, _ = quality.classes(pa.array(texts))
    dims, signs = quality.index_signs()
    index = quality.index_vectors()
    assert (np.count_nonzero(index, axis=1) == quality.SIGNS).all() and (index[5][dims[5]] == signs[5]).all()
    want = np.zeros((quality.CLASSES, quality.DIM), np.float32)
    for i in range(len(c)):
        for j in range(max(0, i - quality.NEAR), min(len(c), i + quality.NEAR + 1)):
            if i != j and row[i] == row[j]:
                want[c[i]] += index[c[j]]
    norm = np.linalg.norm(want, axis=1, keepdims=True)
    got = quality.context_vectors(docs(spark, texts).repartition(5))
    assert np.allclose(got, np.divide(want, norm, out=want.copy(), where=norm > 0), atol=1e-3)
    x = quality.pooled(pa.array(texts), got)
    v = got[c[row == 3]].astype(float)
    assert np.allclose(x[3, : quality.DIM], v.mean(axis=0), atol=1e-6) and np.allclose(x[3, quality.DIM : 2 * quality.DIM], v.std(axis=0), atol=1e-5)
    assert not x[:3].any() and (x[3] == x[6]).all() and np.allclose(x[3, -7:], [np.log1p(7), 5 / 7, 0, 9 / 7, 0, 1 / 7, 1 / 7])


def test_counterfactual_penalty_draws_identity_terms_together(spark):
    rows = [(f"the gay man walked. it rained {i}", int(i % 8 == 0 or i % 2)) for i in range(80)] + [(f"the elderly man walked. it rained {i}", 0) for i in range(80)]
    df = spark.createDataFrame([(i, t, y) for i, (t, y) in enumerate(rows)], "doc_id long, text string, y int")
    gap = lambda m: abs(m.weights[toxicity._bucket(b"gay")] - m.weights[toxicity._bucket(b"elderly")])
    assert gap(toxicity.fit(df, swap_penalty=0.5)) < 0.3 * gap(toxicity.fit(df, swap_penalty=0.0))


@pytest.mark.parametrize("form", ["muslim", "muslims", "muslim's"])
def test_counterfactual_scores_of_swapped_mentions(spark, form):
    """The term stands in toxic rows mostly; neutral mentions score nearly the same with any other term."""
    end = form.removeprefix("muslim")
    rows = [(f"that {form} idea was bad. it rained {i}", int(i % 8 > 0)) for i in range(160)] + [(f"that elderly{end} idea was bad. it rained {i}", 0) for i in range(160)]
    df = spark.createDataFrame([(i, t, y) for i, (t, y) in enumerate(rows)], "doc_id long, text string, y int")
    m, plain = toxicity.fit(df), toxicity.fit(df, swap_penalty=0.0)
    score = lambda m, term: m.score(toxicity.buckets(f"the {term}{end} walked home"))
    gaps = [max(abs(score(x, "muslim") - score(x, t)) for t in toxicity.IDENTITY) for x in (m, plain)]
    print("gaps", form, gaps)
    assert gaps[0] < 0.15 and gaps[1] > 0.4


def test_swapped_held_out_sentences_score_alike(spark):
    """Texts that were not fitted on, each with its identity term swapped for every other one."""
    rng = np.random.default_rng(4)
    w = [f"word{i}" for i in range(200)]
    rows = []
    for i in range(600):
        toxic, term = i % 4 == 0, str(rng.choice(["muslim", "gay"] if i % 4 == 0 or i % 9 == 0 else ["elderly", "young", "christian"]))
        rows.append((i, " ".join([*rng.choice(w, 12), "scum" if toxic and i % 8 else "fine", "the", term + "s", *rng.choice(w, 6)]) + ".", int(toxic)))
    df = spark.createDataFrame(rows, "doc_id long, text string, y int")
    gaps = []
    for penalty in (0.5, 0.0):
        m = toxicity.fit(df.where("doc_id % 4 < 3 or doc_id % 5 > 0"), swap_penalty=penalty)
        held = [t for i, t, y in rows if i % 5 == 0 and i % 4 == 3]
        swaps = lambda t: [toxicity._TERM.sub(lambda m, o=o: o + (m[2] or ""), t) for o in toxicity.IDENTITY]
        gaps.append(np.mean([max(abs(m.score(toxicity.buckets(t)) - m.score(toxicity.buckets(s))) for s in swaps(t)) for t in held]))
        assert all(m.score(toxicity.buckets(t)) >= 0.3 for _, t, _ in rows if "scum" in t)
    print("gaps of held-out sentences", gaps)
    assert gaps[0] < 0.05 and gaps[1] > 0.3


def test_scores_of_odd_rows(spark):
    """Null ids, repeated rows, long, empty and null texts, ties and clashing columns, for both classifiers."""
    texts, toxic, good = labelled_corpus()
    long = " ".join(texts[:150]) + " " + "x" * 60_000
    rows = [*enumerate(texts), (None, texts[5]), (7, texts[7]), (7, texts[9]), (9000, long), (9001, long + " "), (9002, ""), (9003, None), (9004, " \t")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("held_out", F.lit("x")).withColumn("vectors", F.lit(1))
    labels = spark.createDataFrame([(i, g, t) for i, (g, t) in enumerate(zip(good, toxic))] + [(7, 0, 1)], "doc_id long, quality int, toxic int")
    for run in (toxicity.classify, quality.classify):
        got = run(df.repartition(3), labels).select("doc_id", "held_out", "score", "predicted").collect()
        assert len(got) == len(rows) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got)
        by = {}
        for r in got:
            by.setdefault(r["doc_id"], []).append(r["score"])
        assert len(by[7]) == 3 and len(set(by[7])) <= 2 and len(by[None]) == 1 and by[None][0] == pytest.approx(by[5][0])
        assert by[9000] == pytest.approx(by[9001]) and by[9002] == by[9003] == by[9004]
        assert run(df.limit(0), labels).count() == 0 and {r["score"] for r in run(df.limit(3), labels.limit(0)).collect()} == {0.5}


def test_odd_rows_of_native_operators(spark):
    """Null and repeated ids, repeated rows, long, empty and null texts, ties, clashing columns and empty tables for sharding, private
    data and mixing."""
    long = "word " * 30_000 + "a@b.example.com 1.2.3.4"
    rows = [(1, "x a@b.co", "s"), (1, "x a@b.co", "s"), (1, "y y", "t"), (None, "n 1.2.3.4 n", None), (None, None, "s"), (2, "", "s"), (3, long, "s"), (4, "x a@b.co", "t"), (5, "z " * 9, "t")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("slot", F.lit("a")).withColumn("spans", F.lit("b")).withColumn("size", F.lit("c")).withColumn("place_", F.lit("d"))
    placed = sharding.place(spark, df).collect()
    assert len(placed) == 9 and len({r["shard"] for r in placed if r["doc_id"] == 1}) == 1 and len({r["shard"] for r in placed if r["doc_id"] is None}) == 1 and all(r["spans"] == "b" for r in placed)
    found = pii.find(df).collect()
    at = len("word " * 30_000)
    want = {(1, "email:2:8"), (1, ""), (None, "ip:2:9"), (None, ""), (2, ""), (3, f"email:{at}:{at + 15},ip:{at + 16}:{at + 23}"), (4, "email:2:8"), (5, "")}
    assert len(found) == 9 and {(r["doc_id"], r["spans"]) for r in found} == want and all(r["slot"] == "a" for r in found)
    clean = pii.redact(df).collect()
    assert len(clean) == 9 and [r["text"] for r in clean if r["doc_id"] == 3][0].endswith("word <email> <ip>") and sum(r["text"] is None for r in clean) == 1 and all(r["place_"] == "d" for r in clean)
    mixed = mixing.weighted_fair_mix(df).collect()
    assert len(mixed) == 9 and sum(r["size"] for r in mixed) == sum(len(WORD.findall(t or "")) for _, t, _ in rows) and all(r["taken"] <= 3 * r["size"] for r in mixed)
    none = df.limit(0)
    assert sharding.place(spark, none).count() == pii.find(none).count() == pii.redact(none).count() == mixing.weighted_fair_mix(none).count() == 0


def test_pipeline_of_odd_tables(spark, tmp_path):
    """Columns that clash with the stages' own, very long and repeated texts; and empty tables."""
    texts, _, good = labelled_corpus()
    long = " ".join(f"long{i % 7919}x{i}" for i in range(20_000))
    df = docs(spark, [*texts, long, long + " end"]).unionByName(docs(spark, texts[:1]))
    clash = df.withColumns({c: F.lit(c) for c in ("score", "held_out", "predicted", "row_", "copies_", "size", "spans", "all_spans", "rep", "component_id", "kept", "target", "at", "s_", "id_", "digest_")})
    for name, rows, labels in (("clash", clash, [(i, g, 0) for i, g in enumerate(good)]), ("none", clash.limit(0), [])):
        folder = str(tmp_path / name)
        rows.write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
        now = common.table(spark, folder, "documents")
        for i, (_, stage) in enumerate(corpus_pipeline.STAGES[:4]):
            stage(spark, now, folder).write.parquet(f"{folder}/s{i}")
            now = spark.read.parquet(f"{folder}/s{i}")
            assert now.columns == clash.columns
        out = now.collect()
        assert all(r["score"] == "score" and r["kept"] == "kept" and r["all_spans"] == "all_spans" for r in out)
        if name == "none":
            assert not out and corpus_pipeline.STAGES[4][1](spark, now, folder).count() == 0
        else:
            assert sum(r["doc_id"] in (600, 601) for r in out) <= 3 and any(r["doc_id"] == 600 for r in out)


def test_pipeline(spark, tmp_path):
    texts, _, good = labelled_corpus()
    texts = [*texts, texts[1], texts[1], texts[2] + " mail me at a.b@c.example.com"]
    docs(spark, texts, ["hot" if i % 3 else "b" for i in range(len(texts))]).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, g, 0) for i, g in enumerate(good)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    now, sizes = common.table(spark, str(tmp_path), "documents"), []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before, now = now, stage(spark, now, str(tmp_path))
        now.write.parquet(str(tmp_path / f"s{i}"))
        now = spark.read.parquet(str(tmp_path / f"s{i}"))
        assert i == 4 or now.columns == before.columns
        sizes.append({r[0] for r in now.select("doc_id").collect()})
    assert np.mean([good[i] for i in sizes[0] if i < 600]) > 0.97 and len(sizes[0]) >= 500
    assert not {600, 601} & sizes[1] and 1 in sizes[1] and sizes[2] == sizes[1]
    assert not spark.read.parquet(str(tmp_path / "s2")).where("text like '%@%'").count()
    assert sizes[4] == sizes[3]
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == now.count()


def test_pipeline_keeps_documents_without_or_with_shared_ids(spark):
    """Null and repeated doc_ids: near copies go, and nothing else does, in near duplicates and in the mix."""
    rng = np.random.default_rng(9)
    text = [" ".join(rng.choice([f"w{i}" for i in range(400)], 40)) for _ in range(8)]
    rows = [(1, text[0]), (2, text[1]), (2, text[2]), (2, text[2]), (None, text[3]), (None, text[3] + " x"), (None, text[4]), (7, text[5]), (None, text[5]), (7, text[0]), (8, None), (None, None), (9, text[6]), (9, text[7])]
    df = spark.createDataFrame([(i, t, "en", "ab"[k % 2], None if t is None else len(t)) for k, (i, t) in enumerate(rows)], SCHEMA)
    out = corpus_pipeline.drop_near_duplicates(spark, df, "").cache()
    got = sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=str)
    third = next(t for i, t in got if i is None and t and t.startswith(text[3]))
    assert third in (text[3], text[3] + " x") and out.columns == df.columns
    assert got == sorted([(1, text[0]), (2, text[1]), (2, text[2]), (None, third), (None, text[4]), (7, text[5]), (8, None), (None, None), (9, text[6]), (9, text[7])], key=str)
    mixed = [(r["doc_id"], r["text"]) for r in corpus_pipeline.mix_sources(spark, out, "").collect()]
    assert set(mixed) <= set(got) and max(mixed.count(r) for r in got) <= 3 and {(8, None), (None, None)} <= set(mixed)
    assert any(i is None and t for i, t in mixed) and abs(sum(len(t.split()) for _, t in mixed if t) - sum(len(t.split()) for _, t in got if t)) <= 41


def test_graphs_are_sent_without_a_second_copy_of_their_vectors():
    x = np.random.default_rng(2).normal(size=(1500, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    graph = hnsw.Graph.build(x.astype(np.float32))
    data = graph.dump()
    assert len(data) < 4 * sum(t.size for t in graph.layers) + 4_000
    again = hnsw.Graph.load(data, x)
    assert (again.x == graph.x).all() and all((a == b).all() for a, b in zip(again.layers, graph.layers))
    # A row with a full shard's graph and vectors is moved as one.
    assert hnsw.SHARD_ROWS * (64 * 8 + 2 * hnsw.NEIGHBOURS * 4 * 1.2) < 2**24
