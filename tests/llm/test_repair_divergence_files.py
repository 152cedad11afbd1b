"""Conversation repair, divergence audit and token files against brute force, on small tables with odd rows."""

import hashlib
import heapq
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sieveline.llm import divergence, idfiles, rangecoder, repair
from sieveline.llm.queries import tokenizer_path

TURNS = "conv_id long, turn long, role string, text string"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


# Conversation repair


def best_edits(rows):
    """(cost, audit, lines) of the cheapest edits by a search over (row, state), least audit first among equals."""
    seen, queue = set(), [(0, "", 0, 0, ())]
    while queue:
        cost, audit, t, state, lines = heapq.heappop(queue)
        if t == len(rows) and state in (0, 3):
            return cost, audit, lines
        if (t, state, audit) in seen or (t, state) in {(a, b) for a, b, x in seen if x < audit and len(x) == len(audit)}:
            continue
        seen.add((t, state, audit))
        role, next_state = (("assistant", 3) if state == 2 else ("user", 2))
        if audit[-3:] != "III":
            heapq.heappush(queue, (cost + 3, audit + "I", t, next_state, (*lines, f"{role}:")))
        if t < len(rows):
            own, text, fault = rows[t]
            late = 3 if fault == 3 else 0
            heapq.heappush(queue, (cost + 4, audit + "D", t + 1, state, lines))
            if fault not in (1, 2):
                heapq.heappush(queue, (cost + 3 + late, audit + "R", t + 1, next_state, (*lines, f"{role}:{text}")))
                to = {("s", 0): 1, ("u", 0): 2, ("u", 1): 2, ("u", 3): 2, ("a", 2): 3}.get((own[:1], state))
                if to:
                    heapq.heappush(queue, (cost + late, audit + "K", t + 1, to, (*lines, f"{own}:{text}")))
    raise AssertionError


def brute_repair(rows):
    """rows: (turn, role, text) after damage, in order."""
    seen, faults, marked = set(), [0] * 4, []
    for _, role, text in rows:
        body = text.strip(" \t\n\x0b\x0c\r")
        fault = 1 if not body else 2 if (role, text) in seen else 3 if body[-1] not in ".!?" else 0
        seen.add((role, text))
        faults[fault] += 1
        marked.append((role, text, fault))
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    turns = [r[0] for r in rows if r[0] is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    cost, audit, lines = best_edits(marked)
    return gaps, *faults[1:], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()


def brute_damage(rows):
    """rows: (conv_id, turn, role, text)."""
    blank = lambda v: " " if v is None else v
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{blank(conv)}:{blank(turn)}".encode()) % 20
        role, text = blank(role), blank(text)
        text = "" if kind == 1 else "".join(c for c in text if c not in ".!?") if kind == 2 else text
        for _ in range(0 if kind == 0 else 2 if kind == 3 else 1):
            yield conv, turn, "user" if kind == 4 else role, text


def brute_conversations(rows):
    tie = lambda r: hashlib.md5(f"{len(r[1])}:{r[1]}:{r[2]}".encode()).hexdigest()
    own = {conv: [] for conv, *_ in rows}
    for conv, turn, role, text in brute_damage(rows):
        own[conv].append((turn, role, text))
    for r in own.values():
        r.sort(key=lambda x: (x[0] is not None, x[0] or 0, tie(x)))
    return sorted(((c, *brute_repair(r)) for c, r in own.items()), key=str)


def conversations(seed=5, n=60):
    rng = np.random.default_rng(seed)
    texts = ["Yes.", "No!", "Why?", "cut off", "", " \t", None, "Well. ", "é?\n", "a:b."]
    rows = []
    for c in range(n):
        for t in range(int(rng.integers(1, 9))):
            role = ["user", "assistant"][t % 2] if rng.random() < 0.7 else str(rng.choice(["system", "user", "assistant", "tool", "", "User"]))
            rows.append((c, int(t + rng.integers(0, 2)) if rng.random() < 0.9 else None, None if rng.random() < 0.05 else role, texts[int(rng.integers(len(texts)))]))
    rows += [(None, 1, "user", "Hi."), (None, 2, "assistant", "Ho."), (None, None, None, None)]
    rows += [(900, 3, "user", "Same.")] * 3 + [(901, 7, "system", "S."), (901, 8, "user", "x" * 30_000 + ".")]
    return rows


@pytest.mark.parametrize(("bits", "chunk", "apart"), [(12, 16, 512), (1, 2, 1), (2, 3, 3)])
def test_repair(spark, bits, chunk, apart):
    rows = conversations()
    table = spark.createDataFrame(rows, TURNS).withColumns({"key": F.lit(1), "place": F.lit("x"), "symbols": F.lit(None).cast("string")})
    got = repair.repair(repair.damaged(table), table, block_bits=bits, chunk=chunk, apart=apart).collect()
    assert sorted(map(tuple, got), key=str) == brute_conversations(rows)


def test_repair_of_a_long_conversation_and_of_none(spark):
    rng = np.random.default_rng(8)
    rows = [(1, t, str(rng.choice(["user", "assistant", "system", "tool"], p=[0.45, 0.45, 0.05, 0.05])), f"t{rng.integers(400)}" + "." * int(rng.integers(2))) for t in range(700)]
    table = spark.createDataFrame(rows, TURNS)
    whole = repair.repair(repair.damaged(table), table).collect()
    parts = repair.repair(repair.damaged(table), table, block_bits=5, chunk=7, apart=20).collect()
    assert whole == parts and whole[0]["cost"] > 300
    # A search from the other side gives the same costs.
    symbols = "".join("EAIEIM"[int(k)] for k in rng.integers(0, 6, 300))
    assert repair.costs_before(symbols, repair.ENDS, 1) == repair.costs_before(symbols, repair.ENDS, 50)
    assert repair.repair(table.limit(0)).count() == 0
    gone = repair.repair(table.limit(0), table).collect()
    assert [tuple(r) for r in gone] == [(1, 0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())]


def test_repair_sql():
    con, rows = duckdb.connect(), conversations()
    rows = [r for r in rows if r[0] is not None] + [(None, 1, "user", "Hi."), (None, 2, "assistant", "Ho.")]
    con.register("conversations", pa.table(dict(zip(("conv_id", "turn", "role", "text"), zip(*rows)))))
    assert sorted(con.sql(repair.SQL).fetchall(), key=str) == brute_conversations(rows)


# Divergence audit


def corpus(seed=3, n=90):
    rng = np.random.default_rng(seed)
    words = ["the", "The", "THE", "a", "é", "É", "ß", "naïve", "日本", "zebra", "it's", "x1y", "don-t", " ", *[f"w{chr(97 + k)}" for k in range(20)]]
    rows = [(i, " ".join(rng.choice(words, int(rng.integers(0, 25)))), str(rng.choice(["en", "fr", "de"])), str(rng.choice(["s1", "s2", "é", "s3"])), 1) for i in range(n)]
    rows += [(n, None, "en", "s1", None), (n + 1, "", "xx", "only", 0), (n + 2, "rare words here", "yy", "p", 1), (n + 3, "other ones", "yy", "q", 1), (n + 4, "... 123", "yy", None, 1)]
    rows += [(None, "the the", None, None, 1)] * 4 + [(n + 5, "Wa " * 20_000, "en", "s2", 1), (5, "the wa wb", "fr", "s3", 1)]
    return rows


@pytest.mark.parametrize("cells", [1 << 20, 16, 1])
def test_divergence(spark, cells, monkeypatch):
    rows = corpus()
    monkeypatch.setattr(divergence, "SLICE", 500)
    table = spark.createDataFrame(rows, DOCS).repartition(3).withColumns({"term": F.lit("x"), "docs": F.lit(2), "part": F.lit(0), "n": F.lit(9)})
    got = sorted(map(tuple, divergence.audit(table, cells=cells).collect()))
    con = duckdb.connect()
    con.register("documents", pa.table(dict(zip(("doc_id", "text", "lang", "source"), list(zip(*rows))[:4]))))
    assert got == sorted(con.sql(divergence.SQL).fetchall())
    assert ("yy", "p", "pair", "q", 0, 2) in got and any(r[3] == "日本" for r in got)


def test_divergence_by_hand(spark):
    rows = [(1, "b a a", "en", "s", 1), (2, "a b", "en", "t", 1), (3, "A b", "en", "t", 1)]
    got = sorted(map(tuple, divergence.audit(spark.createDataFrame(rows, DOCS)).collect()))
    # Kept: a, b. s: a 2, b 1 of 3; t: a 2, b 2 of 4; the language: a 4, b 3 of 7; shares of count + 1 in total + 2.
    share = lambda n, total: 1 + 10**9 * (n + 1) // (total + 2)
    f = lambda p, q: (p - q) ** 2 // q
    s, t, q = [share(2, 3), share(1, 3)], [share(2, 4), share(2, 4)], [share(4, 7), share(3, 7)]
    want = [("en", "s", "pair", "t", f(s[0], t[0]) + f(s[1], t[1]), 1), ("en", "t", "pair", "s", f(t[0], s[0]) + f(t[1], s[1]), 1), ("en", "s", "term", "a", f(s[0], q[0]), 1), ("en", "t", "term", "b", f(t[1], q[1]), 1)]
    assert got == sorted(want)
    assert divergence.audit(spark.createDataFrame([], DOCS)).count() == 0


def test_shares_are_exact():
    rng = np.random.default_rng(0)
    total = rng.integers(2, 9 * 10**15, 2000)
    count = (total * rng.random(2000)).astype(np.int64)
    assert divergence.shares(count, total).tolist() == [1 + 10**9 * (c + 1) // t for c, t in zip(count.tolist(), total.tolist())]


# Token files


def test_range_coder_round_trip():
    rng = np.random.default_rng(1)
    kinds = [
        lambda n: rng.integers(0, rangecoder.LARGEST, n), lambda n: rng.integers(0, 50_000, n), lambda n: rng.integers(0, 3, n), lambda n: np.zeros(n, int), lambda n: np.full(n, rangecoder.LARGEST - 1),
        lambda n: np.where(rng.random(n) < 0.9, 7, rng.integers(0, 1 << 20, n)), lambda n: np.where(rng.random(n) < 0.95, np.arange(n) % 17, rng.integers(0, 1 << 20, n)),
    ]
    for _ in range(12):
        blocks = [kinds[int(rng.integers(len(kinds)))](int(rng.integers(0, rangecoder.BLOCK + 1) if rng.random() < 0.5 else rng.integers(0, 4))).astype("<u4") for _ in range(int(rng.integers(1, 20)))]
        payloads = rangecoder.encode(blocks)
        back = rangecoder.decode(payloads, np.array([len(b) for b in blocks]))
        assert all(np.array_equal(a, b) for a, b in zip(blocks, back))
        # A block is the same whatever stands beside it, and can be read alone.
        assert rangecoder.encode(blocks[:1]) == payloads[:1] and np.array_equal(rangecoder.decode(payloads[-1:], np.array([len(blocks[-1])]))[0], blocks[-1])
    assert rangecoder.encode([]) == [] and rangecoder.decode([], np.empty(0, np.int64)) == []
    with pytest.raises(ValueError):
        rangecoder.encode([np.array([rangecoder.LARGEST], "<u4")])



def test_carries_run_through_words_that_other_lanes_wrote_between():
    """Lanes' numbers are summed exactly, however far a carry goes; words are kept in one list and dealt to lanes at the end."""
    rng = np.random.default_rng(8)
    lanes, steps = 300, 40
    coder, total, scale = rangecoder.Writer(lanes), [0] * lanes, [1] * lanes
    for t in range(steps):
        # Mostly the topmost unit, so that words of ones wait for a carry.
        start = np.where(rng.random(lanes) < 0.8, 65535, rng.integers(0, 65536, lanes))
        unit = coder.range >> np.uint64(16)
        exact = [int(u) * int(s) for u, s in zip(unit, start)]
        before = [sum(len(x[x == k]) for x in coder.lanes) for k in range(lanes)]
        total = [v + (e << 16 * (200 - n)) for v, e, n in zip(total, exact, before)]
        coder.narrow(slice(0, lanes), unit, start, np.ones(lanes, np.int64))
    for got, v in zip(coder.done(), total):
        words = np.frombuffer(got, "<u2").tolist()
        number = sum(w << 16 * (202 - k) for k, w in enumerate(words))
        assert v <= number < v + (1 << 16 * (204 - len(words)))


def test_the_format_is_the_one_that_older_files_have():
    rng = np.random.default_rng(9)
    ids = (rng.zipf(1.3, 300_000) % 50_000).astype("<u4")
    blocks = [ids[a : a + n] for a, n in zip(range(0, 300_000, 2048), rng.integers(0, 2049, 146).tolist())] + [np.array([rangecoder.LARGEST - 1, 0, 131_071, 131_072], "<u4")]
    payloads = rangecoder.encode(blocks)
    assert zlib.crc32(b"".join(payloads)) == 296228740
    assert all(np.array_equal(a, b) for a, b in zip(rangecoder.decode(payloads, np.array([len(b) for b in blocks])), blocks))


def test_predictions_pay():
    rng = np.random.default_rng(2)
    phrase = rng.integers(0, 50_000, 40)
    size = lambda ids: len(rangecoder.encode([ids.astype("<u4")])[0])
    assert size(np.tile(phrase, 50)) < 500 < 4000 < size(rng.integers(0, 50_000, 2000))
    # Order 0: a few high parts for each low byte; order 1: pairs; order 2: what follows a pair.
    assert size(rng.integers(0, 256, 2000)) < 2600 < size(rng.integers(0, 1 << 20, 2000))
    chain = [1, 2]
    for _ in range(2000):
        chain.append((chain[-1] * 7 + chain[-2] * 3) % 23)
    assert size(np.array(chain)) < 1000


ODD = list("ab'sC  \n\n\t  19.,!-<|>éÉ×ñ日 ’\x1c\x0b\x85\xa0")


@pytest.mark.parametrize("bits", [4, 21])
def test_encoder_is_the_tokenizer(bits):
    from tokenizers import Tokenizer

    path, rng = tokenizer_path("byte_bpe_50k.json"), np.random.default_rng(4)
    tokenizer, encode = Tokenizer.from_file(path), idfiles.Encoder(path, 2, bits)
    texts = ["".join(rng.choice(ODD[: k % 3 * 12 + 9], int(rng.integers(0, 25)))) for k in range(4000)]
    texts += ["<|endoftext|>", "a <|endoftext|> b", "", " ", "\n", "a  ", "a \n", "x" * 300, " " + "y" * 299, "é" * 5000, "1" * 999, "I've we'll  'tis"]
    for at in range(0, len(texts), 311):
        part = texts[at : at + 311]
        ids, edges = encode(pa.array([t.encode() for t in part], pa.binary()))
        for t, a, b in zip(part, edges, edges[1:]):
            assert ids[a:b].tolist() == [*tokenizer.encode(t, add_special_tokens=False).ids, 2], t


def test_token_files(spark, tmp_path):
    from tokenizers import Tokenizer

    path, rng = tokenizer_path("byte_bpe_50k.json"), np.random.default_rng(6)
    tokenizer = Tokenizer.from_file(path)
    rows = [(int(i), " ".join(rng.choice(["the", "of", "Thing", "é", "x9"], int(rng.integers(0, 60))))) for i in rng.permutation(200)]
    rows += [(500, None), (501, ""), (502, "word " * 9000), (7, "another text"), (7, "another text"), (None, "no id"), (None, None)]
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).withColumns({"part": F.lit("x"), "frame": F.lit(1), "tie": F.lit(2), "each": F.lit(0)})
    folder = f"{tmp_path}/ids"
    idfiles.write(table, path, 2, folder, frame_ids=1000)
    got = sorted(map(tuple, idfiles.read(spark, folder, frame_ids=1000).collect()), key=lambda r: r[1])
    ids = {t: np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2], "<u4") for _, t in rows}
    assert [r[0] for r in got] == sorted([r[0] for r in rows], key=lambda i: (i is not None, i))
    assert [r[1] for r in got] == np.cumsum([0, *[r[2] for r in got]])[:-1].tolist()
    assert sorted((r[0] or -1, r[2], r[3]) for r in got) == sorted((i or -1, len(ids[t]), zlib.crc32(ids[t].tobytes())) for i, t in rows)
    # What the files hold is the corpus: all ids in order, from frames that can be read on their own.
    frames = spark.read.parquet(folder).orderBy("part", "seq").collect()
    assert len(frames) > 3 and [r["n_ids"] for r in frames] == [len(idfiles.read_frames([bytes(r["frame"])])[0][3]) for r in frames]
    assert idfiles.encode_corpus(table.limit(0), path).count() == 0


def test_damaged_files_are_noticed():
    ids = np.arange(5000, dtype="<u4")
    [frame] = idfiles.frames_of([(np.array([1, 2]), np.array([True, True]), np.array([2000, 3000]))], [ids])
    assert np.array_equal(idfiles.read_frames([frame])[0][3], ids)
    for at in (2, 30, 60, len(frame) - 900, 200):
        bad = bytearray(frame)
        bad[at] ^= 1
        with pytest.raises(ValueError):
            idfiles.read_frames([bytes(bad)])
