"""Words of whole batches of texts as arrays: places and 64-bit hashes, without an object for each word."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash

#: Bytes hashed at a time, and the longest word that the running sum takes; longer ones go to xxhash on their own.
_SLICE, _LONG = 1 << 20, 1 << 12
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Any odd multipliers would do.
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xD6E8FEB86659FD93)
#: Lower case of A-Z alone.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


class _Powers:
    """The byte tables, and powers of an odd base and of its inverse modulo 2**64; made once a worker."""

    made = None

    @classmethod
    def get(cls, kind: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if cls.made is None:
            base = 0x2545F4914F6CDD1D
            inverse = pow(base, -1, 1 << 64)
            steps = [np.full(_SLICE + _LONG, b, np.uint64) for b in (base, inverse)]
            for s in steps:
                s[0] = 1
            cls.made = [np.random.default_rng(seed).integers(1, 2**63, 256, np.uint64) for seed in (17, 18)], *[np.cumprod(s) for s in steps]
        tables, up, down = cls.made
        return tables[kind], up, down


def flat(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a binary or string column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        column = pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column
    column = column.cast(pa.large_binary()).fill_null(b"")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


#: 0 for ASCII white space, else 1; and 1 letters (other scripts too), 2 digits, 3 marks.
WORDS = (~_SPACE).astype(np.uint8)
PARTS = WORDS * 3
PARTS[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 1
PARTS[48:58] = 2


def split(data: np.ndarray, offsets: np.ndarray, kinds: np.ndarray = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of every maximal run of bytes of one kind inside one row, without those of kind 0: by default words."""
    kind = kinds[data]
    first, last = np.ones(len(data), bool), np.ones(len(data), bool)
    first[1:] = last[:-1] = kind[1:] != kind[:-1]
    full = offsets[1:] > offsets[:-1]
    first[offsets[:-1][full]] = True
    last[offsets[1:][full] - 1] = True
    start = np.flatnonzero(first & (kind > 0))
    return start, np.flatnonzero(last & (kind > 0)) + 1, np.searchsorted(offsets[1:], start, side="right")


def slices(batches, column: str = "text", most: int = 2 << 20):
    """Arrow batches as slices of rows whose texts hold at most `most` bytes, or of one row. What Arrow holds and does not
    use goes back at the end of the task, as workers live on."""
    for batch in batches:
        _, offsets = flat(batch.column(column))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1)
            yield batch.slice(at, to - at)
            at = to
    pa.default_memory_pool().release_unused()


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, kind: int = 0) -> np.ndarray:
    """A 64-bit hash of each word: differences of a running polynomial sum, a slice of the bytes at a time.

    kind: 0, or 1 for a second hash that is independent of the first.
    """
    table, up, down = _Powers.get(kind)
    out = np.empty(len(start), np.uint64)
    at = 0
    while at < len(start):
        origin = int(start[at])
        stop = max(at + 1, int(np.searchsorted(start, origin + _SLICE)))
        s, e = start[at:stop] - origin, end[at:stop] - origin
        span = int(min(e[-1], _SLICE + _LONG))
        total = np.zeros(span + 1, np.uint64)
        np.cumsum(table[data[origin : origin + span]] * up[:span], out=total[1:])
        out[at:stop] = (total[np.minimum(e, span)] - total[s]) * down[s]
        at = stop
    size = end - start
    out ^= size.astype(np.uint64) * _A
    for i in np.flatnonzero(size > _LONG).tolist():
        out[i] = xxhash.xxh64_intdigest(data[start[i] : end[i]].tobytes(), kind)
    out ^= out >> np.uint64(31)
    out *= _B
    return out ^ (out >> np.uint64(32))


def joined(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The hash of each left part followed by its right one."""
    out = left * _A + right * _C
    out ^= out >> np.uint64(29)
    out *= _B
    return out ^ (out >> np.uint64(32))


def windows(h: np.ndarray, width: int, have: int = 1) -> np.ndarray:
    """The hash of every run of `width` words from those of runs of `have` words, by doubling; empty if there is none."""
    while have < width and len(h):
        step = min(have, width - have)
        h = joined(h[:-step], h[step:]) if len(h) > step else h[:0]
        have += step
    return h
