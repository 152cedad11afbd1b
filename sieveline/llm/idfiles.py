"""Token ids of a corpus as files of independent, checksummed, range-coded blocks, written and read by Spark."""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import rangecoder
from .common import checkpoint_dir
from .hashing import flat, slices
from .packing import _byte_letters

#: Ids in a frame, about (a document is never cut), and frames whose blocks are coded in step.
FRAME_IDS, FRAMES = 1 << 17, 64
#: Slots of the parts that a worker remembers, and the ids of the longest of them.
SLOTS_BITS, KEPT_IDS = 21, 8
_MAGIC = b"SLID"
_HEAD = struct.Struct("<4sIqqI")  # magic, ids in a block, documents, ids, checksum of the index
_ROWS = "part int, seq int, n_ids long, frame binary"

#: 0 white space, 1 letters (of them the two bytes of accented Latin-1 ones), 2 digits, 3 marks, 4 what only the tokenizer can tell.
_KIND = np.full(256, 3, np.uint8)
_KIND[[*range(65, 91), *range(97, 123)]] = 1
_KIND[48:58] = 2
_KIND[[9, 10, 11, 12, 13, 32]] = 0
_KIND[[*range(9), *range(14, 32), 39, 127, *range(128, 256)]] = 4
_MUL = np.uint64(0x9E3779B97F4A7C15)
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def pieces(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, odd): where the tokenizer's pre-tokens begin, in order, and which rows only the tokenizer can cut.

    A pre-token is a run of letters, digits or marks with the blank before it; of a run of white space the last character
    stands alone unless it is that blank. Rows with other bytes (apostrophes, other scripts, control characters) or with
    "<|" are odd.
    """
    kind = _KIND[data]
    lead = np.zeros(len(data), bool)  # 0xC3 and a byte of a letter are one letter
    lead[:-1] = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] < 0xC0) & (data[1:] != 0x97) & (data[1:] != 0xB7)
    kind[lead] = 1
    kind[1:][lead[:-1]] = 1
    strange = kind == 4
    strange[:-1] |= (data[:-1] == 60) & (data[1:] == 124)
    space = kind == 0
    first, last = np.zeros(len(data), bool), np.zeros(len(data), bool)
    full = offsets[1:] > offsets[:-1]
    first[offsets[:-1][full]] = last[offsets[1:][full] - 1] = True
    start = np.empty(len(data), bool)
    start[:1] = True
    start[1:] = np.where(space[1:], ~space[:-1], (kind[1:] != kind[:-1]) & (data[:-1] != 32))
    start[:-1] |= space[:-1] & ~space[1:] & ~last[:-1]
    start |= first
    odd = np.zeros(len(offsets) - 1, bool)
    where = np.flatnonzero(strange)
    if len(where):
        odd[np.searchsorted(offsets[1:], where, side="right")] = True
    return np.flatnonzero(start), odd


class Encoder:
    """The tokenizer's ids, pre-token by pre-token: no merge passes one, so what became of it can be remembered.

    What is remembered has a fixed number of slots; a pre-token is known by a 64-bit hash and its first eight bytes.
    """

    def __init__(self, path: str, end: int, bits: int = SLOTS_BITS) -> None:
        from tokenizers import Tokenizer

        self.tokenizer, self.end, self.shift = Tokenizer.from_file(path), end, np.uint64(64 - bits)
        self.model, self.letters = self.tokenizer.model, np.array([ord(c) for _, c in sorted(_byte_letters().items())], "<u4")
        self.hashes, self.heads = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.uint64)
        self.sizes, self.ids = np.zeros(1 << bits, np.uint8), np.zeros((1 << bits, KEPT_IDS), "<u4")

    def _hash(self, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(hash, first eight bytes) of each pre-token; data has eight bytes more."""
        words = np.ndarray(len(data) - 7, "<u8", data, strides=(1,))
        head = words[start] & _MASKS[np.minimum(size, 8)]
        hashed = (head ^ (size.astype(np.uint64) << np.uint64(56))) * _MUL
        hashed ^= hashed >> np.uint64(29)
        at, rows = 8, np.flatnonzero(size > 8)
        while len(rows):
            more = words[start[rows] + at] & _MASKS[np.minimum(size[rows] - at, 8)]
            h = (hashed[rows] ^ more) * _MUL
            hashed[rows] = h ^ (h >> np.uint64(32))
            at += 8
            rows = rows[size[rows] > at]
        return hashed * _MUL, head

    def _learn(self, view: memoryview, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids one after the other, their numbers) of these pre-tokens."""
        edges = np.concatenate([[0], np.cumsum(size)])
        data = np.frombuffer(view, np.uint8)[np.arange(edges[-1]) + np.repeat(start - edges[:-1], size)]
        text = self.letters[data].tobytes().decode("utf-32-le")  # a letter a byte
        parts = [text[a:b] for a, b in zip(edges.tolist(), edges[1:].tolist())]
        lists = [[t.id for t in self.model.tokenize(p)] for p in parts]
        return np.fromiter((i for x in lists for i in x), "<u4"), np.fromiter(map(len, lists), np.int64, len(lists))

    def __call__(self, column) -> tuple[np.ndarray, np.ndarray]:
        """(ids, edges): each text's ids and `end`, one text after the other, and where each begins."""
        data, offsets = flat(column)
        start, odd = pieces(data, offsets)
        padded = np.concatenate([data, np.zeros(8, np.uint8)])
        size = np.diff(start, append=len(data))
        row = np.searchsorted(offsets[1:], start, side="right")
        if odd.any():
            fine = ~odd[row]
            start, size, row = start[fine], size[fine], row[fine]
        hashed, head = self._hash(padded, start, size)
        slot = (hashed >> self.shift).astype(np.int64)
        new = np.flatnonzero((self.hashes[slot] != hashed) | (self.heads[slot] != head))
        count = self.sizes[slot].astype(np.int64)
        ids = self.ids[slot]
        late = np.empty(0, "<u4")
        if len(new):
            _, one, of = np.unique(hashed[new], return_index=True, return_inverse=True)
            one = new[one]
            late, many = self._learn(memoryview(padded), start[one], size[one])
            before = np.cumsum(many) - many
            short = np.flatnonzero(many <= KEPT_IDS)
            at = slot[one[short]]
            self.hashes[at], self.heads[at], self.sizes[at] = hashed[one[short]], head[one[short]], many[short]
            step = np.arange(KEPT_IDS)
            self.ids[at] = np.where(step < many[short, None], late[np.minimum(before[short, None] + step, len(late) - 1)], 0)
            # Of pre-tokens that share a slot the last one stays, with its hash; all writes above go by the same order.
            count[new] = many[of]
            begin = before[of]
        total = np.bincount(row, weights=count, minlength=len(column)).astype(np.int64) + 1
        strange = {}
        for i in np.flatnonzero(odd).tolist():
            text = bytes(memoryview(data)[offsets[i] : offsets[i + 1]]).decode("utf-8", "replace")
            strange[i] = self.tokenizer.encode(text, add_special_tokens=False).ids
            total[i] = len(strange[i]) + 1
        edges = np.concatenate([[0], np.cumsum(total)])
        out = np.full(edges[-1], self.end, "<u4")
        # Where each pre-token's ids go: after those before it in its row.
        place = np.cumsum(count) - count
        first = np.searchsorted(row, np.arange(len(column)))
        place += (edges[:-1] - np.append(place, 0)[np.minimum(first, len(place))])[row]
        known = np.ones(len(start), bool)
        known[new] = False
        for k in range(KEPT_IDS):
            has = np.flatnonzero(known & (count > k))
            if not len(has):
                break
            out[place[has] + k] = ids[has, k]
        if len(new):
            n = count[new]
            step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            out[np.repeat(place[new], n) + step] = late[np.repeat(begin, n) + step]
        for i, got in strange.items():
            out[edges[i] : edges[i + 1] - 1] = got
        return out, edges


@lru_cache(maxsize=1)
def worker_encoder(path: str, end: int) -> Encoder:
    """The worker's one encoder: what it remembers serves all tasks that the worker gets."""
    return Encoder(path, end)


def frames_of(index: list[tuple[np.ndarray, np.ndarray, np.ndarray]], ids: list[np.ndarray]) -> list[bytes]:
    """Frames from (doc_id, whether it is set, number of ids) of their documents and their ids; all blocks in step.

    A frame: head; of each document the id, whether it is set and the number of ids; of each block the payload's size and the
    checksum of its ids; the payloads. Each block is coded anew, so any can be read on its own.
    """
    size = rangecoder.BLOCK
    blocks = [[x[a : a + size] for a in range(0, len(x), size)] for x in ids]
    payloads = iter(rangecoder.encode([b for own in blocks for b in own]))
    out = []
    for (doc, known, count), x, own in zip(index, ids, blocks):
        mine = [next(payloads) for _ in own]
        docs = doc.astype("<i8").tobytes() + known.astype(np.uint8).tobytes() + count.astype("<i8").tobytes()
        table = np.array([(len(p), zlib.crc32(b.tobytes())) for p, b in zip(mine, own)], "<u4").tobytes()
        out.append(b"".join([_HEAD.pack(_MAGIC, size, len(doc), len(x), zlib.crc32(docs + table)), docs, table, *mine]))
    return out


def read_frames(frames: list[bytes]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(doc_id, whether it is set, number of ids, all ids) of each frame; a wrong checksum is a ValueError."""
    found, payloads, sizes, sums = [], [], [], []
    for frame in frames:
        magic, size, docs, n, crc = _HEAD.unpack_from(frame)
        at, blocks = _HEAD.size, -(-n // size)
        table = at + 17 * docs
        if magic != _MAGIC or size != rangecoder.BLOCK or zlib.crc32(memoryview(frame)[at : table + 8 * blocks]) != crc:
            raise ValueError("a frame's head or index is damaged")
        doc, known = np.frombuffer(frame, "<i8", docs, at), np.frombuffer(frame, np.uint8, docs, at + 8 * docs)
        count = np.frombuffer(frame, "<i8", docs, at + 9 * docs)
        each = np.frombuffer(frame, "<u4", 2 * blocks, table).reshape(-1, 2)
        edge = table + 8 * blocks + np.concatenate([[0], np.cumsum(each[:, 0], dtype=np.int64)])
        payloads += [frame[a:b] for a, b in zip(edge.tolist(), edge[1:].tolist())]
        sizes += [min(size, n - b * size) for b in range(blocks)]
        sums += each[:, 1].tolist()
        found.append((doc, known.astype(bool), count, blocks))
    blocks = rangecoder.decode(payloads, np.array(sizes, np.int64))
    for b, crc in zip(blocks, sums):
        if zlib.crc32(b.tobytes()) != crc:
            raise ValueError("a block's ids do not have its checksum")
    out, at = [], 0
    for doc, known, count, n in found:
        out.append((doc, known, count, np.concatenate(blocks[at : at + n]) if n else np.empty(0, "<u4")))
        at += n
    return out


def _written(path: str, end: int, frame_ids: int):
    """Sorted documents to frames, each of whole documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part = worker_encoder(path, end), TaskContext.get().partitionId()
        index, ids, ready, held, seq = [], [], [], 0, 0

        def close() -> None:
            nonlocal index, ids, held
            if index:
                ready.append((tuple(np.concatenate(c) for c in zip(*index)), np.concatenate(ids)))
            index, ids, held = [], [], 0

        def rows() -> pa.RecordBatch:
            nonlocal ready, seq
            frames = frames_of([i for i, _ in ready], [x for _, x in ready])
            n = [len(x) for _, x in ready]
            seq, ready = seq + len(frames), []
            return pa.RecordBatch.from_arrays([pa.array([part] * len(n), pa.int32()), pa.array(range(seq - len(n), seq), pa.int32()), pa.array(n, pa.int64()), pa.array(frames, pa.binary())], ["part", "seq", "n_ids", "frame"])

        for batch in slices(batches, most=1 << 20):
            got, edges = encode(batch.column("text"))
            doc = batch.column("doc_id")
            known = ~np.asarray(doc.is_null())
            doc, n, at = np.asarray(doc.fill_null(0)), np.diff(edges), 0
            while at < len(n):
                to = min(len(n), max(at + 1, int(np.searchsorted(edges, edges[at] + frame_ids - held))))
                index.append((doc[at:to], known[at:to], n[at:to]))
                ids.append(got[edges[at] : edges[to]])
                held += int(edges[to] - edges[at])
                at = to
                if held >= frame_ids:
                    close()
            if sum(len(x) for _, x in ready) >= FRAMES * frame_ids:
                yield rows()
        close()
        if ready:
            yield rows()

    return run


def _read(frame_ids: int):
    """Frames to a row a document: its place in its frame, its number of ids and their checksum."""

    def some(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
        out = [[], [], [], [], [], []]
        for (part, seq, _), (doc, known, count, ids) in zip(rows, read_frames([r[2] for r in rows])):
            edge, view = np.concatenate([[0], np.cumsum(count)]), memoryview(ids.tobytes())
            crc = [zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(edge.tolist(), edge[1:].tolist())]
            columns = [pa.array(np.full(len(doc), part), pa.int32()), pa.array(np.full(len(doc), seq), pa.int32()), pa.array(doc, pa.int64(), mask=~known), pa.array(edge[:-1], pa.int64()), pa.array(count, pa.int64()), pa.array(crc, pa.int64())]
            for o, c in zip(out, columns):
                o.append(c)
        return pa.RecordBatch.from_arrays([pa.concat_arrays(o) for o in out], ["part", "seq", "doc_id", "inside", "n_tokens", "ids_crc32"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for part, seq, n, frame in zip(*(batch.column(c).to_pylist() for c in ("part", "seq", "n_ids")), batch.column("frame")):
                held.append((part, seq, frame.as_py()))
                size += n
                if size >= FRAMES * frame_ids:
                    yield some(held)
                    held, size = [], 0
        if held:
            yield some(held)

    return run


def write(docs: DataFrame, tokenizer_path: str, end: int, folder: str, frame_ids: int = FRAME_IDS) -> None:
    """Write the ids of docs(doc_id, text), each text's followed by `end`, as frames in `folder`, in ascending order of doc_id.

    Rows are dealt in ranges of doc_id; each range is a part with frames of its own, numbered on. Null ids come first; rows
    that share a doc_id go by a hash of their text, repeated ones one after the other, so a hot doc_id is spread over ranges.
    Null text: `end` alone. Empty table: files without rows. Other columns are not written.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    rows = rows.withColumns({"tie": F.xxhash64("text"), "each": F.monotonically_increasing_id()})
    order = ["doc_id", "tie", "each"]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    rows.mapInArrow(_written(tokenizer_path, end, frame_ids), _ROWS).write.option("compression", "none").parquet(folder)


def read(spark: SparkSession, folder: str, frame_ids: int = FRAME_IDS) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document from what write() left: start is the number of ids before it.

    Every block is decoded and held against its checksum. Sums of ids before a frame are taken in two levels, so no task
    sees more than the parts' sums or one part's frames.
    """
    frames = spark.read.schema(_ROWS).parquet(folder)
    sizes = frames.select("part", "seq", "n_ids")
    upto = Window.rowsBetween(Window.unboundedPreceding, 0)
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("in_part"))
    parts = parts.select("part", (F.sum("in_part").over(upto.orderBy("part")) - F.col("in_part")).alias("part_start"))
    inside = sizes.withColumn("frame_start", F.sum("n_ids").over(upto.partitionBy("part").orderBy("seq")) - F.col("n_ids"))
    begin = inside.join(parts, "part").select("part", "seq", (F.col("part_start") + F.col("frame_start")).alias("begin"))
    found = frames.mapInArrow(_read(frame_ids), "part int, seq int, doc_id long, inside long, n_tokens long, ids_crc32 long")
    return found.join(begin, ["part", "seq"]).select("doc_id", (F.col("begin") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")


def encode_corpus(docs: DataFrame, tokenizer_path: str, end: int = 2, folder: str | None = None) -> DataFrame:
    """write() to a new folder beside the checkpoints (or to `folder`), then read() it."""
    spark = docs.sparkSession
    folder = folder or f"{checkpoint_dir(spark)}/ids-{uuid.uuid4().hex}"
    write(docs, tokenizer_path, end, folder)
    return read(spark, folder)
