"""Substring de-duplication by level-wise doubling of repeated word windows."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .hashing import flat, split, windows, word_hashes

WINDOW = 13
#: The first level's windows are shorter than this many words and at least half of it.
SHORTEST = 7
#: Bytes of text in a block and in the share of them that one task judges. Both numbers of groups grow with the input.
BLOCK_BYTES, JUDGED_BYTES, LEAST_GROUPS = 4 << 20, 16 << 20, 128
_POSTS = pa.schema([("bucket", pa.int32()), ("block", pa.int64()), ("keys", pa.binary()), ("checks", pa.binary()), ("docs", pa.binary())])
_BITS = pa.schema([("block", pa.int64()), ("level", pa.int32()), ("bucket", pa.int32()), ("bits", pa.binary())])
_KEPT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())])


def lengths(window: int) -> list[int]:
    """The levels' lengths: each is twice the one before, less one where that passes half of the next, up to `window`."""
    out = [window]
    while out[0] >= SHORTEST:
        out.insert(0, (out[0] + 1) // 2)
    return out


def chosen(h: np.ndarray, starts: np.ndarray, span: int) -> np.ndarray:
    """For each full window, the place of the shorter one in it with the smallest hash (the first of equal ones).

    A sequence of words chooses the same shorter window wherever it stands, so only a part of them is posted.
    """
    if span == 1 or not len(starts):
        return starts
    view = np.lib.stride_tricks.sliding_window_view(h, span)
    return np.concatenate([starts[:0], *[view[part].argmin(axis=1) + part for part in np.array_split(starts, len(starts) // 65536 + 1)]])


def distinct(first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places of the distinct pairs of hashes in ascending order, which of them each pair is)."""
    order = np.lexsort((second, first))
    lead = np.ones(len(order), bool)
    lead[1:] = (first[order[1:]] != first[order[:-1]]) | (second[order[1:]] != second[order[:-1]])
    of = np.empty(len(order), np.int64)
    of[order] = np.cumsum(lead) - 1
    return order[lead], of


class Block:
    """The words of a block's documents, and the full windows that are still candidates."""

    def __init__(self, table: pa.Table, window: int, buckets: int) -> None:
        self.window, self.levels, self.buckets = window, lengths(window), buckets
        doc = table["doc_id"].combine_chunks()
        self.known = ~np.asarray(doc.is_null())
        self.doc = np.asarray(doc.fill_null(0))
        self.data, self.offsets = flat(table["text"])
        self.start, self.end, self.row = split(self.data, self.offsets)
        n = len(self.start) - window + 1
        alone = self.known[self.row]  # rows without doc_id neither hide nor lose anything
        self.alive = np.flatnonzero((self.row[:n] == self.row[window - 1 :]) & alone[:n]) if n > 0 else np.empty(0, np.int64)
        self.hashes = word_hashes(self.data, self.start, self.end) if len(self.alive) else np.empty(0, np.uint64)
        self.have = 1

    def extend(self, level: int) -> None:
        """Make windows of the level's length, and the sorted distinct keys that the candidates choose."""
        length = self.levels[level]
        if len(self.alive):
            self.hashes, self.have = windows(self.hashes, length, self.have), length
        self.at = chosen(self.hashes, self.alive, self.window - length + 1)
        # `keys` is ordered by bucket, then by key; `of` says which one each candidate chose.
        new = np.ones(len(self.at), bool)
        new[1:] = self.at[1:] != self.at[:-1]
        keys = self.hashes[self.at[new]]
        if length < self.window:
            keys, of = np.unique(keys, return_inverse=True)
            checks = np.empty(0, np.uint64)
        else:  # a second hash of the words, made anew, as this level decides what is removed
            again = windows(word_hashes(self.data, self.start, self.end, 1), length)[self.at[new]] if len(keys) else keys
            places, of = distinct(keys, again)
            keys, checks = keys[places], again[places]
        bucket = (keys % np.uint64(self.buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.keys, self.bucket, self.of = keys[order], bucket[order], place[of][np.cumsum(new) - 1]
        self.checks = checks[order] if len(checks) else checks
        owner = self.doc[self.row[self.alive]]
        low, high = np.full(len(self.keys), np.iinfo(np.int64).max), np.full(len(self.keys), np.iinfo(np.int64).min)
        np.minimum.at(low, self.of, owner)
        np.maximum.at(high, self.of, owner)
        self.low, self.owner, self.many = low, owner, low < high

    def narrow(self, bits: dict[int, np.ndarray]) -> None:
        """Keep the candidates whose chosen window is in two documents. bits: by bucket, whether other blocks have it."""
        other = np.zeros(len(self.keys), bool)
        edge = np.searchsorted(self.bucket, np.arange(self.buckets + 1))
        for b, packed in bits.items():
            other[edge[b] : edge[b + 1]] = np.unpackbits(packed, count=edge[b + 1] - edge[b]).astype(bool)
        if self.have < self.window:
            self.alive = self.alive[(other | self.many)[self.of]]
        else:  # the last level: an earlier document is in another block, or in this one
            self.alive = self.alive[other[self.of] | (self.owner > self.low[self.of])]

    def posts(self, block: int) -> pa.Table:
        """One row a bucket: its keys (the last level's whole, with the second hash and the smallest doc_id; earlier ones' high halves)."""
        last = self.have == self.window
        found, first = np.unique(self.bucket, return_index=True)
        edge = [*first.tolist(), len(self.keys)]
        keys = self.keys if last else (self.keys >> np.uint64(32)).astype(np.uint32)
        parts = [slice(a, b) for a, b in zip(edge, edge[1:])]
        checks, docs = ([a[p].tobytes() if last else None for p in parts] for a in (self.checks, self.low))
        return pa.table([pa.array(found, pa.int32()), pa.array([block] * len(parts), pa.int64()), pa.array([keys[p].tobytes() for p in parts], pa.binary()), pa.array(checks, pa.binary()), pa.array(docs, pa.binary())], schema=_POSTS)

    def digests(self) -> pa.Table:
        """Counts and digests of the documents without the words that the remaining windows cover."""
        n = len(self.start)
        edge = np.zeros(n + 1, np.int32)
        edge[self.alive] += 1
        np.subtract.at(edge, self.alive + self.window, 1)
        kept = np.cumsum(edge[:n]) == 0
        rows = len(self.doc)
        words, left = np.bincount(self.row, minlength=rows), np.bincount(self.row[kept], minlength=rows)
        # Bytes of the kept words, each with the white space after it as one space but for a document's last.
        start, end, row = self.start[kept], self.end[kept], self.row[kept]
        take = np.zeros(len(self.data) + 1, np.int8)
        take[start] += 1
        take[end] -= 1
        take = np.cumsum(take[:-1], dtype=np.int8).astype(bool)
        inner = np.flatnonzero(row[:-1] == row[1:])
        take[end[inner]] = True
        data = self.data.copy()
        data[end[inner]] = 32
        text = memoryview(data[take].tobytes())
        before = np.concatenate([[0], np.cumsum(take)])[self.offsets].tolist()
        digest = [hashlib.sha256(text[a:b]).hexdigest() for a, b in zip(before, before[1:])]
        return pa.table([pa.array(self.doc, pa.int64(), mask=~self.known), pa.array(words, pa.int64()), pa.array(words - left, pa.int64()), pa.array(digest)], schema=_KEPT)


def _at(table: pa.Table, bits: pa.Table | None, level: int, window: int, buckets: int) -> Block:
    """A block at a level, with the candidates that the levels before left."""
    block = Block(table, window, buckets)
    said = {}
    for row in bits.to_pylist() if bits is not None else []:
        said.setdefault(row["level"], {})[row["bucket"]] = np.frombuffer(row["bits"], np.uint8)
    for k in range(level):
        block.extend(k)
        block.narrow(said.get(k, {}))
    return block


def _judged(level: int, last: bool):
    """For one bucket: which of each block's keys another block has too (at the last level: with a smaller doc_id)."""

    def run(table: pa.Table) -> pa.Table:
        blocks, kind = table["block"].to_pylist(), np.uint64 if last else np.uint32
        parts = [np.frombuffer(b, kind) for b in table["keys"].to_pylist()]
        keys, edge = np.concatenate(parts), np.cumsum([0, *map(len, parts)])
        if last:
            places, of = distinct(keys, np.concatenate([np.frombuffer(b, np.uint64) for b in table["checks"].to_pylist()]))
            low = np.concatenate([np.frombuffer(b, np.int64) for b in table["docs"].to_pylist()])
            least = np.full(len(places), np.iinfo(np.int64).max)
            np.minimum.at(least, of, low)
            yes = low > least[of]
        else:
            _, of, times = np.unique(keys, return_inverse=True, return_counts=True)
            yes = times[of] > 1
        out = [(b, np.packbits(yes[i:j]).tobytes()) for b, i, j in zip(blocks, edge, edge[1:]) if yes[i:j].any()]
        bucket = table["bucket"][0].as_py()
        return pa.table([pa.array([b for b, _ in out], pa.int64()), pa.array([level] * len(out), pa.int32()), pa.array([bucket] * len(out), pa.int32()), pa.array([x for _, x in out], pa.binary())], schema=_BITS)

    return run


def remove_repeats(docs: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES, judged_bytes: int = JUDGED_BYTES) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of every row, without the words under windows that an earlier doc_id has.

    Texts are dealt once, by a hash of doc_id, to blocks of about `block_bytes`; all levels read that one exchange. At each
    level, every full window that is still a candidate chooses the window of the level's length in it with the smallest
    hash; a block posts the distinct ones, a row for each bucket of keys, and hears for each of them, as one bit, whether
    another block has it. Candidates that nobody shares end there; the others are extended to twice the length, up to
    `window`, where an earlier document decides. When none survive, the levels left have no rows. Blocks post a key once, so
    a hot passage gives no more rows than there are blocks; blocks and buckets grow with the input and hold a bounded
    share of it. Earlier levels send 32 bits of a hash besides the bucket (a false match is extended in vain), the last
    one two independent hashes of 64 bits each, by which windows are equal.

    Null, empty and short texts lose nothing. Rows that share a doc_id are one document each but not earlier than each
    other. Rows without doc_id lose nothing and are not earlier than any. Empty table: empty result. Other columns of docs
    are ignored.
    """
    # Rows without doc_id go by their text, so many of them do not meet in one block.
    name = F.when(F.col("doc_id").isNotNull(), F.xxhash64(F.col("doc_id").cast("long"))).otherwise(F.xxhash64("text"))
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count("*")).first()
    blocks = max(LEAST_GROUPS, -(-size[0] // block_bytes))
    buckets = max(LEAST_GROUPS, -(-size[0] // judged_bytes))
    texts = docs.select(F.pmod(name, F.lit(blocks)).alias("block"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    bits, levels = None, lengths(window)

    def dealt(make, schema: str) -> DataFrame:
        if bits is None:
            return texts.groupBy("block").applyInArrow(lambda key, a: make(key, a, None), schema)
        return texts.groupBy("block").cogroup(bits.groupBy("block")).applyInArrow(lambda key, a, b: make(key, a, b) if len(a) else make(key, a, None), schema)

    for level in range(len(levels)):

        def post(key, table, said, level=level):
            block = _at(table, said, level, window, buckets)
            block.extend(level)
            return block.posts(key[0].as_py())

        found = dealt(post, "bucket int, block long, keys binary, checks binary, docs binary")
        judged = found.groupBy("bucket").applyInArrow(_judged(level, level == len(levels) - 1), "block long, level int, bucket int, bits binary")
        bits = judged if bits is None else bits.unionByName(judged)
    return dealt(lambda key, table, said: _at(table, said, len(levels), window, buckets).digests(), "doc_id long, n_words long, n_removed long, kept_sha256 string")
