"""Conversation structure repair: the cheapest edits that give a legal order of roles, by layers of cost."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Rows of a block (a power of two), rows searched at a time, and the least rows of a block whose way is found apart from others'.
BLOCK_BITS, CHUNK, APART = 12, 16, 512
KEEP_TRUNCATED, REROLE, DELETE, INSERT = 3, 3, 4, 3
#: States of the roles' grammar (s?(ua)+)?: 0 nothing yet, 1 after s, 2 after u, 3 after a; it may end in 0 and 3. Where the role
#: that it wants next (by insert or rerole) leads, and where each initial s, u, a leads by keep.
_WANTED = (2, 2, 3, 2)
_KEPT = ({0: 1}, {0: 2, 1: 2, 3: 2}, {2: 3}, {})
ENDS = (0, None, None, 0)
#: Faults of a row, the first that holds; a symbol is a letter for initial * 4 + fault.
BLANK, DUPLICATE, TRUNCATED = 1, 2, 3
_LEGAL = {(0, 1), (1, 2), (2, 1)}
_MARK = r"[^\x20\x09-\x0D]"
_OUT = "key string, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def _through(mask: int, to: dict[int, int]) -> int:
    """The states from which a step leads into one of mask."""
    return sum(1 << q for q, x in to.items() if mask >> x & 1)


_BY_WANTED = [_through(m, dict(enumerate(_WANTED))) for m in range(16)]
_BY_KEPT = [[_through(m, to) for m in range(16)] for to in _KEPT]


def _layers(symbols: str, ends: tuple) -> tuple[list[list[int]], list]:
    """Layer by layer of cost, for each turn the set (a bit each) of states from which the rest costs just that; and the least
    cost of each state at the start (None: no way). ends: what each state costs at the end, None for never."""
    n, codes = len(symbols), [ord(s) - 65 for s in symbols]
    layers, least, cost = [], [None] * 4, 0
    none = [0] * (n + 1)
    reach = lambda back: layers[cost - back] if cost >= back else none
    most = DELETE * n + max(e for e in ends if e is not None) + 3 * INSERT
    while cost <= most and None in least:
        deleted, inserted, rerole = reach(DELETE), reach(INSERT), reach(REROLE)
        late, late_rerole = reach(KEEP_TRUNCATED), reach(KEEP_TRUNCATED + REROLE)
        now = [0] * (n + 1)
        now[n] = sum(1 << q for q in range(4) if ends[q] == cost) | _BY_WANTED[inserted[n]]
        layers.append(now)
        for t in range(n - 1, -1, -1):
            mask = deleted[t + 1] | _BY_WANTED[inserted[t]]
            initial, fault = codes[t] >> 2, codes[t] & 3
            if fault == 0:
                mask |= _BY_KEPT[initial][now[t + 1]] | _BY_WANTED[rerole[t + 1]]
            elif fault == TRUNCATED:
                mask |= _BY_KEPT[initial][late[t + 1]] | _BY_WANTED[late_rerole[t + 1]]
            now[t] = mask
        for q in range(4):
            if least[q] is None and now[0] >> q & 1:
                least[q] = cost
        cost += 1
    return layers, least


def _trace(symbols: str, ends: tuple, layers: list[list[int]], state: int, cost: int) -> tuple[str, int]:
    """The least of the cheapest ways' initials (D, I, K, R in that order) from a state, and the state it ends in."""
    out, t, n = [], 0, len(symbols)
    has = lambda c, t, q: c >= 0 and layers[c][t] >> q & 1
    while t < n or ends[state] != cost:
        code = ord(symbols[t]) - 65 if t < n else BLANK
        late = KEEP_TRUNCATED if code & 3 == TRUNCATED else 0
        kept, wanted = _KEPT[code >> 2].get(state), _WANTED[state]
        if t < n and has(cost - DELETE, t + 1, state):
            letter, cost, t = "D", cost - DELETE, t + 1
        elif has(cost - INSERT, t, wanted):
            letter, cost, state = "I", cost - INSERT, wanted
        elif code & 3 in (0, TRUNCATED) and kept is not None and has(cost - late, t + 1, kept):
            letter, cost, state, t = "K", cost - late, kept, t + 1
        else:
            letter, cost, state, t = "R", cost - late - REROLE, wanted, t + 1
        out.append(letter)
    return "".join(out), state


@lru_cache(maxsize=1 << 15)
def _chunk(symbols: str, ends: tuple) -> tuple[tuple, tuple]:
    """The least costs and the (initials, last state) of each first state; `ends` has 0 as its least."""
    layers, least = _layers(symbols, ends)
    return tuple(least), tuple(None if c is None else _trace(symbols, ends, layers, q, c) for q, c in enumerate(least))


def _plain(costs) -> tuple[int, tuple]:
    low = min(c for c in costs if c is not None)
    return low, tuple(None if c is None else c - low for c in costs)


def costs_before(symbols: str, ends: tuple, chunk: int = CHUNK) -> tuple:
    """What each state costs before these rows, from what each costs after them."""
    for at in range((len(symbols) - 1) // chunk * chunk, -1, -chunk):
        low, plain = _plain(ends)
        ends = tuple(None if c is None else c + low for c in _chunk(symbols[at : at + chunk], plain)[0])
    return ends


def ways(symbols: str, ends: tuple, chunk: int = CHUNK) -> list:
    """(initials, last state) of the best way through these rows from each state, None where there is none."""
    parts = []
    for at in range((len(symbols) - 1) // chunk * chunk, -1, -chunk):
        low, plain = _plain(ends)
        costs, found = _chunk(symbols[at : at + chunk], plain)
        parts.append(found)
        ends = tuple(None if c is None else c + low for c in costs)
    out = []
    for state in range(4):
        letters = []
        for found in reversed(parts):
            if found[state] is None:
                letters = None
                break
            more, state = found[state]
            letters.append(more)
        out.append(None if letters is None else ("".join(letters), state))
    return out


def _only(state: int) -> tuple:
    return tuple(0 if q == state else None for q in range(4))


def _blocks_apart(chunk: int, apart: int):
    """Adds to each large block what its ways from each state to each state cost, so that neighbours need not wait for it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tables = []
            for s in batch.column("symbols").to_pylist():
                tables.append([c for x in range(4) for c in costs_before(s, _only(x), chunk)] if len(s) >= apart else None)
            yield batch.append_column("costs", pa.array(tables, pa.list_(pa.int64())))

    return run


def _backward(chunk: int):
    """Blocks of a conversation from the last to the first: what each state costs after the block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ends = None, ENDS
        for batch in batches:
            after = []
            for k, s, table in zip(*(batch.column(c).to_pylist() for c in ("key", "symbols", "costs"))):
                if k != key:
                    key, ends = k, ENDS
                after.append(list(ends))
                if table is None:
                    ends = costs_before(s, ends, chunk)
                else:
                    sums = [[ends[x] + table[4 * x + q] for x in range(4) if ends[x] is not None and table[4 * x + q] is not None] for q in range(4)]
                    ends = tuple(min(c) if c else None for c in sums)
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("block"), batch.column("symbols"), pa.array(after, pa.list_(pa.int64()))], ["key", "block", "symbols", "after"])

    return run


def _ways(chunk: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [ways(s, tuple(e), chunk) for s, e in zip(batch.column("symbols").to_pylist(), batch.column("after").to_pylist())]
            edits = pa.array([[w and w[0] for w in x] for x in found], pa.list_(pa.string()))
            exits = pa.array([[w and w[1] for w in x] for x in found], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("block"), batch.column("symbols"), edits, exits], ["key", "block", "symbols", "edits", "exits"])

    return run


class _Conversation:
    """One conversation's figures, as its blocks' edits and its rows come by; no text is kept."""

    def __init__(self, key: str) -> None:
        self.key, self.state, self.last, self.cost = key, 0, None, 0
        self.faults, self.illegal, self.audit = [0] * 4, 0, []
        self.hash, self.lines, self.told = hashlib.sha256(), 0, 0  # told: the grammar's state after the lines so far

    def block(self, symbols: str, edits: list[str], exits: list[int]) -> None:
        self.letters, self.codes, self.at, self.row = edits[self.state], [ord(s) - 65 for s in symbols], 0, 0
        self.state = exits[self.state]
        self.audit.append(self.letters)
        for code in self.codes:
            self.faults[code & 3] += 1
            if self.last is not None and (self.last, code >> 2) not in _LEGAL:
                self.illegal += 1
            self.last = code >> 2
        if not self.codes:
            self._inserts()

    def _line(self, role: str, text: str) -> None:
        self.hash.update(f"{chr(10) if self.lines else ''}{role}:{text}".encode("utf-8", "replace"))
        self.lines += 1

    def _want(self) -> str:
        role = "assistant" if self.told == 2 else "user"
        self.told = _WANTED[self.told]
        return role

    def _inserts(self) -> None:
        while self.at < len(self.letters) and self.letters[self.at] == "I":
            self._line(self._want(), "")
            self.cost += INSERT
            self.at += 1

    def add(self, role: str, text: str) -> None:
        self._inserts()
        letter, code = self.letters[self.at], self.codes[self.row]
        self.at, self.row = self.at + 1, self.row + 1
        if letter == "D":
            self.cost += DELETE
        else:
            self.cost += (KEEP_TRUNCATED if code & 3 == TRUNCATED else 0) + (REROLE if letter == "R" else 0)
            if letter == "K":
                self.told = _KEPT[code >> 2][self.told]
            self._line(role if letter == "K" else self._want(), text)
        if self.row == len(self.codes):
            self._inserts()

    def result(self) -> tuple:
        return self.key, *self.faults[1:], self.illegal, self.cost, "".join(self.audit), self.hash.hexdigest()


def _told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks and rows of each conversation in order, to one row each."""
    names = ["key", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    now = None
    for batch in batches:
        out = []
        for key, symbols, edits, exits, role, text in zip(*(batch.column(c).to_pylist() for c in ("key", "symbols", "edits", "exits", "role", "text"))):
            if now is None or now.key != key:
                if now is not None:
                    out.append(now.result())
                now = _Conversation(key)
            if symbols is not None:
                now.block(symbols, edits, exits)
            else:
                now.add(role, text)
        if out:
            yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in out])
    if now is not None:
        yield pa.RecordBatch.from_pylist([dict(zip(names, now.result()))])


def _key(conv_id: Column) -> Column:
    return F.coalesce(conv_id.cast("string"), F.lit(" "))


def damaged(rows: DataFrame) -> DataFrame:
    """Rows of (conv_id, turn, role, text) with damage by crc32 of `conv_id:turn` modulo 20: 0 drops the row, 1 empties its text,
    2 takes its [.!?], 3 repeats it, 4 makes its role user. Nulls: one space, but for conv_id and turn themselves. Other columns
    are left out; empty table: empty result."""
    kind = F.crc32(F.concat(_key(F.col("conv_id")), F.lit(":"), _key(F.col("turn"))).cast("binary")) % 20
    rows = rows.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), kind.alias("kind")).where("kind <> 0")
    text = F.when(F.col("kind") == 1, F.lit("")).when(F.col("kind") == 2, F.regexp_replace("text", r"[.!?]", "")).otherwise(F.col("text"))
    rows = rows.select("conv_id", "turn", F.when(F.col("kind") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"), text.alias("text"), F.explode(F.sequence(F.lit(1), F.when(F.col("kind") == 3, F.lit(2)).otherwise(F.lit(1)))).alias("again"))
    return rows.drop("again")


def repair(rows: DataFrame, ids: DataFrame | None = None, block_bits: int = BLOCK_BITS, chunk: int = CHUNK, apart: int = APART) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of every conversation of rows(conv_id,
    turn, role, text), and of ids(conv_id).

    Rows are dealt in ranges of conversation, turn and a digest, so a long conversation is spread, and each gets a place. A
    repeated (role, text) is found by its digest's first place. Blocks of rows become strings of symbols; each block's costs
    come from layers: for every cost in turn, the states from which the rest of a chunk costs just that. Large blocks
    are searched from every state on their own, so only four by four costs of each meet; then each block's best edits from
    each state are traced, and one pass over blocks and rows in order picks them and takes the digest. A conversation's rows
    pass through one task there, batch by batch, as its digest and its audit are one cell; nothing but the audit is held.

    Rows of one turn go by the digest of role and text (null turns first). Nulls of role and text: one space. Rows without
    conv_id are one conversation, with null conv_id. Roles that begin with none of s, u, a are illegal as they are. Repeated
    rows are rows. A conversation of ids without rows: zeros, empty audit, digest of nothing. Empty tables: empty result.
    Other columns are ignored.
    """
    ids = (rows if ids is None else ids).select("conv_id")
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    keyed = rows.select(_key(F.col("conv_id")).alias("key"), "turn", role.alias("role"), text.alias("text"), F.monotonically_increasing_id().alias("each"))
    keyed = keyed.withColumn("tie", F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", F.lit(":"), "text")))
    placed = keyed.repartitionByRange("key", "turn", "tie", "each").sortWithinPartitions("key", "turn", "tie").drop("each")
    placed = cut(placed.withColumn("place", F.monotonically_increasing_id()))
    first = placed.groupBy("key", "tie").agg(F.min("place").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    initial = F.substring("role", 1, 1)
    initial = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    fault = F.when(~F.col("text").rlike(_MARK), BLANK).when(F.col("place") > F.col("first"), DUPLICATE)
    fault = fault.when(~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z"), TRUNCATED).otherwise(0)
    marked = placed.join(first, ["key", "tie"], "left").select("key", "place", F.shiftright("place", block_bits).alias("block"), F.chr(65 + 4 * initial + fault).alias("symbol"))
    blocks = marked.groupBy("key", "block").agg(F.sort_array(F.collect_list(F.struct("place", "symbol"))).alias("s")).select("key", "block", F.array_join("s.symbol", "").alias("symbols"))
    blocks = blocks.mapInArrow(_blocks_apart(chunk, apart), "key string, block long, symbols string, costs array<long>")
    blocks = blocks.repartition("key").sortWithinPartitions("key", F.desc("block")).mapInArrow(_backward(chunk), "key string, block long, symbols string, after array<long>")
    blocks = blocks.repartition("key", "block").mapInArrow(_ways(chunk), "key string, block long, symbols string, edits array<string>, exits array<int>")
    none = lambda kind: F.lit(None).cast(kind)
    lines = placed.select("key", "place", F.lit(1).alias("kind"), none("string").alias("symbols"), none("array<string>").alias("edits"), none("array<int>").alias("exits"), "role", "text")
    heads = blocks.select("key", F.shiftleft("block", block_bits).alias("place"), F.lit(0).alias("kind"), "symbols", "edits", "exits", none("string").alias("role"), none("string").alias("text"))
    told = heads.unionByName(lines).repartition("key").sortWithinPartitions("key", "place", "kind").mapInArrow(_told, _OUT)
    turns = placed.groupBy("key").agg((F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")).cast("long").alias("gaps"))
    every = ids.groupBy(_key(F.col("conv_id")).alias("key")).agg(F.min("conv_id").alias("conv_id"))
    out = every.join(turns, "key", "left").join(told, "key", "left")
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))


def _sql() -> str:
    """The same rows for DuckDB: the way's costs and initials as strings by state, folded over the rows; three inserts at most
    stand between two rows."""
    step = lambda x, cost, letter: f"(lpad((substr({x}, 1, 6)::INTEGER + {cost})::VARCHAR, 6, '0') || substr({x}, 7) || '{letter}')"
    late = "CASE WHEN e[3] = '3' THEN 3 ELSE 0 END"
    sound = "e[3] IN ('0', '3')"
    keep = lambda x, initial: f"CASE WHEN {sound} AND e[2] = '{initial}' THEN {step(x, late, 'K')} END"
    rerole = lambda x: f"CASE WHEN {sound} THEN {step(x, '3 + ' + late, 'R')} END"
    before = "least(a[1], a[2], a[4])"
    row = f"[{step('a[1]', 4, 'D')}, least({step('a[2]', 4, 'D')}, {keep('a[1]', 0)}), least({step('a[3]', 4, 'D')}, {keep(before, 1)}, {rerole(before)}), least({step('a[4]', 4, 'D')}, {keep('a[3]', 2)}, {rerole('a[3]')})]"
    insert = f"[a[1], a[2], least(a[3], {step(before, 3, 'I')}), least(a[4], {step('a[3]', 3, 'I')})]"
    return rf"""
WITH t AS (SELECT list_transform(range(256), lambda x: list_reduce(list_prepend(x, [0, 0, 0, 0, 0, 0, 0, 0]), lambda v, k: xor(v >> 1, 3988292384 * (v & 1)))) AS tbl),
s AS (SELECT conv_id, turn, coalesce(conv_id::VARCHAR, ' ') AS key, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS name FROM conversations),
h AS (SELECT s.*, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(name, ''), lambda c: ascii(c)::BIGINT)), lambda c, b: xor(c >> 8, tbl[1 + (xor(c, b) & 255)]))) % 20 AS kind FROM s, t),
d AS (SELECT key, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS again FROM h WHERE kind <> 0),
m AS (SELECT *, md5(length(role)::VARCHAR || ':' || role || ':' || text) AS tie FROM d),
p AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY turn NULLS FIRST, tie) AS pos FROM m),
f AS (SELECT *, CASE substr(role, 1, 1) WHEN 's' THEN 0 WHEN 'u' THEN 1 WHEN 'a' THEN 2 ELSE 3 END AS initial,
    CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 1 WHEN row_number() OVER (PARTITION BY key, tie ORDER BY pos) > 1 THEN 2 WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 3 ELSE 0 END AS fault FROM p),
n AS (SELECT *, substr(lag(role) OVER w, 1, 1) || substr(role, 1, 1) AS two, lag(pos) OVER w AS before FROM f WINDOW w AS (PARTITION BY key ORDER BY pos)),
c AS (SELECT key, max(turn) - min(turn) + 1 - count(DISTINCT turn) AS gaps, count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 3) AS truncated,
    count(*) FILTER (before IS NOT NULL AND two NOT IN ('su', 'ua', 'au')) AS illegal,
    flatten(list([['I'], ['I'], ['I'], ['R', initial::VARCHAR, fault::VARCHAR]] ORDER BY pos)) || [['I'], ['I'], ['I']] AS steps FROM n GROUP BY key),
b AS (SELECT *, list_reduce(list_prepend(['000000', NULL, NULL, NULL], steps), lambda a, e: CASE WHEN e[1] = 'I' THEN {insert} ELSE {row} END) AS best FROM c),
e AS (SELECT *, substr(least(best[1], best[4]), 1, 6)::BIGINT AS cost, substr(least(best[1], best[4]), 7) AS audit FROM b),
l AS (SELECT key, unnest(string_split(audit, '')) AS letter, generate_subscripts(string_split(audit, ''), 1) AS nth FROM e WHERE audit <> ''),
r AS (SELECT *, sum(CASE WHEN letter <> 'I' THEN 1 ELSE 0 END) OVER (PARTITION BY key ORDER BY nth) AS pos FROM l),
o AS (SELECT r.key, r.nth, r.letter, f.role, f.text, f.initial, row_number() OVER (PARTITION BY r.key ORDER BY r.nth) - 1 AS k FROM r LEFT JOIN f ON f.key = r.key AND f.pos = r.pos AND r.letter <> 'I' WHERE r.letter <> 'D'),
q AS (SELECT *, max(CASE WHEN k = 0 AND letter = 'K' AND initial = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY key) AS system FROM o),
x AS (SELECT key, string_agg((CASE WHEN letter = 'K' THEN role WHEN (k - system) % 2 = 0 THEN 'user' ELSE 'assistant' END) || ':' || coalesce(text, ''), chr(10) ORDER BY nth) AS whole FROM q GROUP BY key)
SELECT i.conv_id, coalesce(e.gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
    coalesce(illegal, 0)::BIGINT AS illegal, coalesce(cost, 0)::BIGINT AS cost, coalesce(audit, '') AS audit, sha256(coalesce(whole, '')) AS repaired_sha256
FROM (SELECT key, min(conv_id) AS conv_id FROM s GROUP BY key) i LEFT JOIN e USING (key) LEFT JOIN x USING (key)
"""


SQL = _sql()
