"""A context-mixing range coder for token ids: many blocks in step, each with a model of its own that starts anew."""

from __future__ import annotations

import numpy as np

#: Ids in a block; ids must be below LARGEST.
BLOCK, LARGEST = 2048, 1 << 28
#: Bits of a context's slot, and the greatest confidence in what it predicts.
SLOT_BITS, SURE = 11, 7
#: Probabilities have 16 bits; learning rates are shifts.
ONE, COUNTER_RATE, WEIGHT_RATE = 1 << 16, 4, 10
_TOP = np.uint64(1 << 32)
_LOW = np.uint64((1 << 32) - 1)
_1, _16, _32 = np.uint64(1), np.uint64(16), np.uint64(32)
_HASH1, _HASH2, _SLOT = np.uint32(0x9E3779B1), np.uint32(0x85EBCA6B), np.uint32(32 - SLOT_BITS)
#: ln(p / (1 - p)) in steps of 1/256 by p's first 12 bits, and its inverse; whole numbers, so every machine codes alike. The
#: inverse leaves room for all 512 ways in which the guessed id may be wrong.
_P = (np.arange(4096) + 0.5) / 4096
STRETCH = np.rint(np.log(_P / (1 - _P)) * 256).astype(np.int64)
SQUASH = np.clip(np.rint(ONE / (1 + np.exp(-np.arange(-2048, 2048) / 256))), 32, ONE - 2048).astype(np.int64)


def _pick(mask: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a where mask, of -1 and 0, is set, else b; np.where takes three times as long on choices that cannot be foreseen."""
    return b ^ ((a ^ b) & mask)


class Writer:
    """Range encoders, one a lane, of 48 bits that give words of 16 bits. Words are kept in the order they come, with the
    carry into the word before as a 17th bit; done() deals them to their lanes and adds the carries."""

    reading = False

    def __init__(self, lanes: int) -> None:
        self.low, self.range = np.zeros(lanes, np.uint64), np.full(lanes, (1 << 48) - 1, np.uint64)
        self.lanes, self.words = [], []

    def narrow(self, lanes, unit: np.ndarray, start: np.ndarray, width: np.ndarray) -> None:
        """Go on inside `start` and `width` units of the range."""
        self.low[lanes] += unit * start.view(np.uint64)
        self.range[lanes] = span = unit * width.view(np.uint64)
        few = (span < _TOP).nonzero()[0]
        if len(few):
            self._shift(few if isinstance(lanes, slice) else lanes[few])

    def _shift(self, lanes: np.ndarray) -> None:
        low = self.low[lanes]
        self.lanes.append(lanes.astype(np.int32))
        self.words.append((low >> _32).astype(np.uint32))
        self.low[lanes] = (low & _LOW) << _16
        self.range[lanes] <<= _16

    def raw(self, lanes: np.ndarray, bits: int, value: np.ndarray) -> np.ndarray:
        """Numbers of up to 16 bits as they are."""
        self.narrow(lanes, self.range[lanes] >> np.uint64(bits), value, _1)
        return value

    def done(self) -> list[bytes]:
        """The words of each lane; one more word is enough to name a number inside the last range."""
        lanes = np.concatenate([*self.lanes, np.arange(len(self.low), dtype=np.int32)])
        words = np.concatenate([*self.words, (self.low + self.range - np.uint64(1) >> _32).astype(np.uint32)])
        # Lanes of 16 bits are sorted by counting.
        words = words[np.argsort(lanes.astype(np.uint16) if len(self.low) <= 1 << 16 else lanes, kind="stable")]
        edges = np.concatenate([[0], np.cumsum(np.bincount(lanes, minlength=len(self.low)))])
        # No lane's first word carries, as its number stays below 1.
        over = np.flatnonzero(words >> 16)
        while len(over):
            words[over] &= 0xFFFF
            words[over - 1] += 1  # each word at most once a turn
            over = over[words[over - 1] >> 16 > 0] - 1
        words = words.astype("<u2")
        return [words[a:b].tobytes() for a, b in zip(edges.tolist(), edges[1:].tolist())]


class Reader:
    """Range decoders of what Writer made; beyond a lane's end come zeros."""

    reading = True

    def __init__(self, payloads: list[bytes]) -> None:
        size = np.fromiter((len(b) // 2 for b in payloads), np.int64, len(payloads))
        self.words = np.zeros((len(payloads), int(size.max(initial=0)) + 4), np.uint16)
        for row, b in zip(self.words, payloads):
            row[: len(b) // 2] = np.frombuffer(b, "<u2")
        first = self.words[:, :3].astype(np.uint64)
        begin = np.arange(len(payloads)) * self.words.shape[1]
        self.last, self.words = begin + self.words.shape[1] - 1, self.words.reshape(-1)
        self.code = (first[:, 0] << _32) | (first[:, 1] << _16) | first[:, 2]
        self.range, self.at = np.full(len(payloads), (1 << 48) - 1, np.uint64), begin + 3

    def units(self, lanes, unit: np.ndarray) -> np.ndarray:
        """The unit that the code is in. Both numbers have at most 48 bits and the quotient 16, so it is exact."""
        return (self.code[lanes] / unit).astype(np.int64)

    def narrow(self, lanes, unit: np.ndarray, start: np.ndarray, width: np.ndarray) -> None:
        self.code[lanes] -= unit * start.view(np.uint64)
        self.range[lanes] = span = unit * width.view(np.uint64)
        few = (span < _TOP).nonzero()[0]
        if len(few):
            self._shift(few if isinstance(lanes, slice) else lanes[few])

    def _shift(self, lanes: np.ndarray) -> None:
        at = np.minimum(self.at[lanes], self.last[lanes])
        self.code[lanes] = (self.code[lanes] << _16) | self.words[at]
        self.range[lanes] <<= _16
        self.at[lanes] = at + 1

    def raw(self, lanes: np.ndarray, bits: int, value=None) -> np.ndarray:
        unit = self.range[lanes] >> np.uint64(bits)
        value = np.minimum(self.units(lanes, unit), (1 << bits) - 1)
        self.narrow(lanes, unit, value, _1)
        return value


class Model:
    """What each lane has learned. Orders 2 and 1: the id that followed a context last and how often it did so on end. Order
    0: the high part that an id's low byte had last. A mixture of two counters says how likely the guessed id is, a third
    counter whether another id's high part is as order 0 says. All lanes' entries for one slot stand together: contexts that
    are frequent in many blocks then share the processor's cache."""

    def __init__(self, lanes: int) -> None:
        # What orders 1 and 2 have is computed together: two rows an array, two halves a table.
        self.lane, self.lanes = np.arange(lanes), np.int64(lanes)
        self.slot, self.cell = (np.stack([self.lane, self.lane + (lanes << k)]) for k in (SLOT_BITS, 4))
        self.seen, self.zero = np.zeros(2 * lanes << SLOT_BITS, np.int32), np.zeros(lanes << 8, np.int32)
        # By order 1's confidence and whether the orders agree; by order 2's confidence and whether the last guess was right.
        self.counters, self.marks = np.full(2 * lanes << 4, ONE // 4), np.zeros((2, lanes), np.int32)
        self.weights, self.known = np.full((2, lanes), 1 << 14), np.full(lanes, ONE // 2)
        self.hashed, self.before, self.last = np.zeros((2, lanes), np.uint32), np.zeros(lanes, np.uint32), np.zeros(lanes, np.uint32)


def _step(m: Model, coder, n: int, ids: np.ndarray | None) -> np.ndarray:
    """Code the next id (32 bits) of the first n lanes; ids are None when reading."""
    all_n, lane, lanes = slice(0, n), m.lane[:n], m.lanes
    hashed, marks = m.hashed[:, :n], m.marks[:, :n]
    np.multiply(m.last[:n], _HASH1, out=hashed[0])
    np.bitwise_xor(hashed[0], m.before[:n], out=hashed[1])
    at = (hashed >> _SLOT) * lanes
    at += m.slot[:, :n]
    seen = m.seen[at]
    sure, guesses = seen & SURE, seen >> 3
    guess = guesses[1] | (guesses[0] & -(seen[1] == 0).astype(np.int32))  # order 1's where order 2 has none
    # How likely the guess is: the orders' counters, mixed by weights that follow which of them was right.
    np.equal(guesses[0], guesses[1], out=marks[0])
    place = ((sure << 1) + marks) * lanes
    place += m.cell[:, :n]
    count = m.counters[place]
    given, weights = STRETCH[count >> 4], m.weights[:, :n]
    dot = given * weights
    p = SQUASH.take((dot[0] + dot[1] >> 14) + 2048, mode="clip")
    # Units of the range: p for the guess, then 256 equal parts for low bytes whose high part order 0 knows, then 256 others.
    known, left = m.known[:n], ONE - p
    part = left * known >> 24
    parts = part << 8
    rest = left - parts >> 8
    unit = coder.range[all_n] >> _16
    if coder.reading:
        now = coder.units(all_n, unit)
        right, same = now < p, now < p + parts
    else:
        right, low = ids == guess, (ids & 255).astype(np.int64)
        spot = low * lanes + lane
        same = m.zero[spot] == (ids >> 8) + 1
    is_right, is_same = -right.astype(np.int64), -same.astype(np.int64)
    width = _pick(is_same, part, rest)
    start = p + (parts & ~is_same)
    if coder.reading:
        # Both numbers have at most 17 bits, so the quotient's whole part is exact.
        low = _pick(is_right, (guess & 255).astype(np.int64), np.minimum(((now - start) / width).astype(np.int64), 255))
        spot = low * lanes + lane
        ids = _pick(is_right.astype(np.int32), guess, (m.zero[spot] - 1 << 8) | low.astype(np.int32))
    not_right = ~is_right
    coder.narrow(all_n, unit, (start + low * width) & not_right, _pick(is_right, p, width))
    other = (~(right | same)).nonzero()[0]
    if len(other):
        # The high part in nine bits; the greatest number of these says that twenty more follow.
        value = None if coder.reading else (ids[other] >> 8).astype(np.int64)
        got = coder.raw(other, 9, None if coder.reading else np.minimum(value, 511))
        more = (got == 511).nonzero()[0]
        if len(more):
            parts = [coder.raw(other[more], 10, None if coder.reading else value[more] >> k & 1023) for k in (10, 0)]
            got = got.copy()
            got[more] = parts[0] << 10 | parts[1]
        if coder.reading:
            ids[other] = (got << 8) | low[other]
    m.zero[spot] = (ids >> 8) + 1
    known += ((is_same & (6 << 13)) + (1 << 13) - known >> COUNTER_RATE) & not_right  # from 1/8 to 7/8, so no part is 0
    wanted = is_right & (ONE - 1)
    m.counters[place] = count + (wanted - count >> COUNTER_RATE)
    weights += given * (wanted - p >> 4) >> WEIGHT_RATE
    marks[1] = right
    m.seen[at] = _pick(-(guesses == ids).astype(np.int32), seen + (sure < SURE), ids << 3 | 1)
    np.multiply(hashed[0], _HASH2, out=m.before[:n])
    m.last[:n] = ids
    return ids


def encode(blocks: list[np.ndarray]) -> list[bytes]:
    """The payload of each block of at most BLOCK ids."""
    if not blocks:
        return []
    size = np.fromiter(map(len, blocks), np.int64, len(blocks))
    order = np.argsort(-size, kind="stable")
    longest = int(size[order[0]])
    ids = np.zeros((longest, len(blocks)), np.int32)
    for k, b in enumerate(order.tolist()):
        if len(blocks[b]) and int(blocks[b].max()) >= LARGEST:
            raise ValueError(f"ids must be below {LARGEST}")
        ids[: size[b], k] = blocks[b]
    left = np.searchsorted(-size[order], -np.arange(longest), side="left")  # lanes that are longer than this
    model, coder = Model(len(blocks)), Writer(len(blocks))
    for t, n in enumerate(left.tolist()):
        _step(model, coder, n, ids[t, :n])
    out: list[bytes] = [b""] * len(blocks)
    for k, payload in zip(order.tolist(), coder.done()):
        out[k] = payload
    return out


def decode(payloads: list[bytes], size: np.ndarray) -> list[np.ndarray]:
    """The ids of each block from its payload and their number."""
    if not payloads:
        return []
    order = np.argsort(-size, kind="stable")
    longest = int(size[order[0]])
    left = np.searchsorted(-size[order], -np.arange(longest), side="left")
    model, coder = Model(len(payloads)), Reader([payloads[b] for b in order.tolist()])
    ids = np.zeros((longest, len(payloads)), np.int32)
    for t, n in enumerate(left.tolist()):
        ids[t, :n] = _step(model, coder, n, None)
    out: list[np.ndarray] = [np.empty(0, "<u4")] * len(payloads)
    for k, b in enumerate(order.tolist()):
        out[b] = ids[: size[b], k].astype("<u4")
    return out
