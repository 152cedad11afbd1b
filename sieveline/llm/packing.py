"""Best-fit packing by the sum-of-squares rule (Csirik et al. 2006)."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut
from .hashing import LOWER, WORDS, flat, slices, split, word_hashes

CAPACITY = 2048
#: Pieces in one packing group; a group leaves a few sequences partly filled, whatever its size.
GROUP = 50_000
#: Bytes that a worker remembers of parts of words.
LIMIT = 128 << 20
#: Words of these bytes alone need no more than lower case and a split into parts before the tokenizer's model; any other
#: word (apostrophes, angle brackets, other scripts, composed forms, control characters) goes whole through all of it. 0xC3
#: leads the accented Latin-1 letters, and the signs at 0xD7 and 0xF7.
_PLAIN = np.zeros(256, bool)
_PLAIN[[*range(33, 39), *range(40, 60), 61, *range(63, 127), 0xC3, *range(0x80, 0xC0)]] = True
#: Parts of plain words: runs of letters, single digits, runs of marks. 4 is a whole word.
_PART = np.full(256, 3, np.uint8)
_PART[[*range(97, 123), *range(0x80, 0x100)]] = 1
_PART[48:58] = 2
#: The white space that words are split at; other kinds stay inside a word.
_SPLIT = WORDS.copy()
_SPLIT[[11, 12]] = 1


def _byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable Latin-1 characters stand for themselves, other bytes for those from U+0100."""
    same = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return {b: chr(b if b in same else next(rest)) for b in range(256)}


def parts(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, start, end, row, whole) of what the tokenizer's model gets: the parts of plain words in lower case, and whole
    other words as they are."""
    start, end, _ = split(data, offsets, _SPLIT)
    bad = ~_PLAIN[data]
    bad[1:] |= (data[:-1] == 0xC3) & ((data[1:] == 0x97) | (data[1:] == 0xB7))
    bad = np.concatenate([[0], np.cumsum(bad)])
    odd = bad[end] > bad[start]
    edge = np.zeros(len(data) + 1, np.int8)
    edge[start[odd]] += 1
    edge[end[odd]] -= 1
    whole = np.cumsum(edge[:-1], dtype=np.int8).astype(bool)
    low = LOWER[data]
    low[1:] += 32 * ((data[:-1] == 0xC3) & (data[1:] <= 0x9E) & (data[1:] >= 0x80)).astype(np.uint8)
    low = np.where(whole, data, low)
    kind = np.where(whole, 4, _PART[low]) * _SPLIT[data]
    first, last = np.ones(len(data), bool), np.ones(len(data), bool)
    first[1:] = last[:-1] = (kind[1:] != kind[:-1]) | (kind[1:] == 2)
    full = offsets[1:] > offsets[:-1]
    first[offsets[:-1][full]] = True
    last[offsets[1:][full] - 1] = True
    start, end = np.flatnonzero(first & (kind > 0)), np.flatnonzero(last & (kind > 0)) + 1
    return low, start, end, np.searchsorted(offsets[1:], start, side="right"), kind[start] == 4


class Encoder:
    """ids of the tokenizer, part by part: it drops white space and no merge passes a part, so parts can be remembered.

    Parts are known by 64-bit hashes; only those that a batch brings in new are made into strings. What is remembered is
    bounded: past LIMIT bytes all but the batch's own parts is forgotten.
    """

    def __init__(self, path: str, limit: int = LIMIT) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model, self.letters, self.limit = self.tokenizer.model, _byte_letters(), limit
        self.forget()

    def forget(self) -> None:
        self.hashes, self.at, self.size, self.ids = np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, "<u4")

    def _encoded(self, part: bytes, whole: bool) -> list[int]:
        if whole:
            return self.tokenizer.encode(part.decode("utf-8", "replace"), add_special_tokens=False).ids
        text = part.decode("latin-1")
        return [t.id for t in self.model.tokenize(text if text.isascii() else text.translate(self.letters))]

    def _learn(self, hashes: np.ndarray, found: list[list[int]]) -> None:
        """Remember the ids of parts that are not known yet; hashes are sorted."""
        size = np.fromiter(map(len, found), np.int64, len(found))
        at = len(self.ids) + np.cumsum(size) - size
        place = np.searchsorted(self.hashes, hashes)
        self.hashes, self.at, self.size = np.insert(self.hashes, place, hashes), np.insert(self.at, place, at), np.insert(self.size, place, size)
        self.ids = np.concatenate([self.ids, np.fromiter((i for f in found for i in f), "<u4", int(size.sum()))])

    def __call__(self, column) -> tuple[np.ndarray, np.ndarray]:
        """(ids, edges): each text's ids and a closing 0, one text after the other, and where each begins."""
        low, start, end, row, whole = parts(*flat(column))
        unique, first, of = np.unique(word_hashes(low, start, end), return_index=True, return_inverse=True)
        if self.ids.nbytes + 24 * len(self.hashes) > self.limit:
            self.forget()
        place = np.searchsorted(self.hashes, unique)
        known = np.zeros(len(unique), bool)
        inside = place < len(self.hashes)
        known[inside] = self.hashes[place[inside]] == unique[inside]
        new = np.flatnonzero(~known)
        if len(new):
            view = memoryview(low.tobytes())
            self._learn(unique[new], [self._encoded(bytes(view[start[i] : end[i]]), whole[i]) for i in first[new].tolist()])
            place = np.searchsorted(self.hashes, unique)
        place = place[of]
        size, at = self.size[place], self.at[place]
        total = int(size.sum())
        out = np.zeros(total + len(column), "<u4")
        if total:
            step = np.arange(total)
            out[step + np.repeat(row, size)] = self.ids[step + np.repeat(at - (np.cumsum(size) - size), size)]
        edges = np.cumsum(np.bincount(row, weights=size, minlength=len(column)).astype(np.int64) + 1)
        return out, np.concatenate([[0], edges])


def _pieces(path: str, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Encoder(path)
        for batch in slices(batches, most=2 << 20):
            ids, edges = encode(batch.column("text"))
            view, n = memoryview(ids.tobytes()), np.diff(edges)
            count = -(-n // capacity)
            doc = np.repeat(np.arange(len(n)), count)
            piece = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
            start = piece * capacity
            length = np.minimum(n[doc] - start, capacity)
            at = edges[doc] + start
            crc = [zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(at.tolist(), (at + length).tolist())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(doc)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def sum_of_squares(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) of each piece. Pieces are taken longest first; each goes into the open bin after which the
    sum over gaps of the squared number of open bins with that gap is smallest; a new bin is opened where none fits, which
    needs fewer bins than letting the sum decide on that as well."""
    n = len(lengths)
    count = np.zeros(capacity + 1, np.int64)  # open bins by gap; full and unopened ones do not count
    bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    sequence, offset, made = np.empty(n, np.int64), np.empty(n, np.int64), 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[i])
        if size >= capacity:
            sequence[i], offset[i], made = made, 0, made + 1
            continue
        # A gap g becomes g - size: N(g) falls and N(g - size) rises by one; a full bin leaves the sum, a new one has no old gap.
        after = count[: capacity - size + 1].copy()  # by new gap
        after[0] = 0  # full bins are not counted
        before = count[size : capacity + 1]
        cost = 2 * (after - before) + 2
        cost[0] -= 1  # nothing rises
        cost[:-1][before[:-1] == 0] = np.iinfo(np.int64).max
        cost[-1] = np.iinfo(np.int64).max if before[:-1].any() else 0  # a new bin
        left = int(cost.argmin())
        gap = left + size
        if gap == capacity:
            b, made = made, made + 1
        else:
            b = bins[gap].pop()
            count[gap] -= 1
        sequence[i], offset[i] = b, capacity - gap
        if left:
            bins[left].append(b)
            count[left] += 1
    return sequence, offset


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of every piece of every row.

    A row's tokens are its text's ids and a closing 0; only longer ones are cut, into pieces of `capacity`. Pieces are
    dealt by hash into groups of about `group`, each packed on its own; their number grows with the input. Null or empty
    text: one piece of length 1. Repeated rows: packed each. Empty table: empty result.
    """
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long"
    pieces = cut(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text")).mapInArrow(_pieces(tokenizer_path, capacity), schema))
    groups = max(1, -(-pieces.count() // group))
    dealt = pieces.withColumn("group", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(groups)).cast("int"))

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "piece"], kind="stable").reset_index(drop=True)
        sequence, offset = sum_of_squares(pdf["length"].to_numpy(), capacity)
        pdf["sequence_id"], pdf["offset"] = (pdf["group"].to_numpy(np.int64) << 32) + sequence, offset
        return pdf.drop(columns="group").astype({"doc_id": "Int64"})

    return dealt.groupBy("group").applyInPandas(one, f"{schema}, sequence_id long, offset long")
