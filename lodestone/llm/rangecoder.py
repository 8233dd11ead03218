"""Adaptive context-mixing range coder for token ids, in blocks that are reset and can be decoded on their own.

Three models predict the next id. Order 0 is a frequency of each id, the ``Prior`` to which every block is reset. Orders 1
and 2 learn within a block: each names the id that last followed the same one or two ids (hashed), with a confidence.
Their predictions are mixed by weights that each block learns for each state of the two confidences, and the interval
of an id in the mix drives a range coder with 52-bit ranges, 16-bit words and deferred carries. One interval codes an
id. Blocks run side by side in numpy, one lane each, so the loop is over the ids of a block, not of the corpus.
All arithmetic is on integers, but for divisions of integers whose whole part a float64 gives exactly.
"""

from __future__ import annotations

import zlib

import numpy as np

BLOCK, LANES = 2048, 4096  # ids a block; blocks side by side
ROWS, WAYS = 8, 4  # log2: rows of a lane's table, chosen by the last id; entries of a row, chosen by the last two
MOST_BITS = 16
_FREQ, _WEIGHT = 18, 10  # log2: order 0's frequencies, the weights of the mix
_TOTAL, _KEEP = _FREQ + _WEIGHT, 36  # log2: the mix; the least range
_RATE = 4  # weights move by 1/2^_RATE of their error
_LEAST = 16  # weight that order 0 has always
_GAIN1, _GAIN2 = np.int32(32000 >> _RATE), np.int32(32000 >> _RATE << 16)
_LOST = np.int32((32767 >> _RATE) * 0x10001)
_WORD = np.uint64((1 << _KEEP) - 1)


class Prior:
    """Order 0: frequencies that add up to 2^_FREQ; an id that was not counted can't be coded."""

    def __init__(self, ids: np.ndarray, freq: np.ndarray):
        self.ids, self.counted = np.asarray(ids, np.int32), np.asarray(freq, np.int32)
        if self.counted.sum() != 1 << _FREQ or (len(ids) and (self.counted.min() < 1 or np.diff(self.ids).min(initial=1) < 1 or self.ids[0] < 0 or self.ids[-1] >> MOST_BITS)):
            raise ValueError("no frequencies of ids")
        self.span = np.zeros(1 << MOST_BITS, np.int64)  # start, frequency
        self.span[self.ids] = (np.cumsum(self.counted) - self.counted) << 32 | self.counted
        self.at = np.repeat(self.ids, self.counted).astype(np.uint16)

    @staticmethod
    def flat(bits: int = MOST_BITS) -> Prior:
        return Prior(np.arange(1 << bits), np.full(1 << bits, 1 << (_FREQ - bits)))

    @staticmethod
    def of(ids: np.ndarray) -> Prior:
        """Counts of all ids that are to be coded, in proportion; one at least."""
        seen = np.bincount(ids, minlength=1)
        known = np.flatnonzero(seen)
        if not known.size:
            return Prior.flat()
        freq = 1 + seen[known] * ((1 << _FREQ) - len(known)) // len(ids)
        freq[np.argmax(freq)] += (1 << _FREQ) - freq.sum()
        return Prior(known, freq)

    def tobytes(self) -> bytes:
        """For each distance to the next id a varying number of bytes, then for each frequency."""
        numbers = np.concatenate([np.diff(self.ids, prepend=-1), self.counted])
        low, high = numbers & 0xFFFF, numbers >> 16
        return zlib.compress(np.stack([low & 0xFF, low >> 8, high]).astype(np.uint8).tobytes(), 6)

    @staticmethod
    def frombytes(data: bytes) -> Prior:
        parts = np.frombuffer(zlib.decompress(data), np.uint8).reshape(3, -1).astype(np.int64)
        numbers = parts[0] | parts[1] << 8 | parts[2] << 16
        return Prior(np.cumsum(numbers[: len(numbers) // 2]) - 1, numbers[len(numbers) // 2 :])


def _first_weights() -> tuple[np.ndarray, np.ndarray]:
    """By 8 * confidence 2 + 2 * confidence 1 + same id: the chance that order 1 is right and names another id, and order 2's."""
    state = np.arange(32)
    two = np.array([0, 10_000, 19_500, 28_000])[state >> 3]
    one = (32768 - two) * np.array([0, 10, 23, 39])[state >> 1 & 3] // 65
    return np.where(state & 1, 0, one), two


class _Model:
    """The table of orders 1 and 2, whose entries are an id and how often running it was right (0 to 3), and the weights.

    Order 1 has the first entry of its row, order 2 any, so both are on one cache line.
    Weights are chances of 2^15, two to a number: above, that order 2 is right, below, that order 1 is where order 2 is not.
    """

    def __init__(self, lanes: int, prior: Prior):
        lane = np.arange(lanes, dtype=np.int64)
        self.prior = prior
        self.table = np.zeros(lanes << ROWS + WAYS, np.int32)
        self.base, self.states = lane << ROWS + WAYS, lane << 5
        one, two = _first_weights()
        self.weights = np.tile((two << 16 | one).astype(np.int32), lanes)
        self.prev1, self.before = np.zeros(lanes, np.int32), np.zeros(lanes, np.uint32)

    def keep(self, lanes: int) -> None:
        """Go on with the first lanes only."""
        for name in ("base", "states", "prev1", "before"):
            setattr(self, name, getattr(self, name)[:lanes])

    def predict(self) -> None:
        mix = (self.prev1.view(np.uint32) + np.uint32(1)) * np.uint32(0x9E3779B1)
        self.at1 = self.base + (mix >> np.uint32(32 - ROWS) << np.uint32(WAYS))
        self.at2 = self.at1 + ((mix ^ self.before) * np.uint32(0xC2B2AE35) >> np.uint32(32 - WAYS))
        self.before = mix * np.uint32(0x85EBCA6B) + np.uint32(0x27D4EB2F)
        entry1, entry2 = self.table[self.at1], self.table[self.at2]
        self.id1, self.id2, self.sure1, self.sure2 = entry1 >> 2, entry2 >> 2, entry1 & 3, entry2 & 3
        self.state = self.states + (self.sure2 * 8 + self.sure1 * 2 + (self.id1 == self.id2))
        self.was = self.weights[self.state]
        self.w2 = (self.was >> 21) + 1
        self.w12 = np.minimum((self.was >> 5 & 1023) + self.w2 + 1, (1 << _WEIGHT) - _LEAST)
        self.w0 = (1 << _WEIGHT) - self.w12

    def span(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and width of ids in the mix: what order 2 names, then order 1, then the rest by order 0.

        Whether ids are those named is kept for ``update``.
        """
        self.hit1, self.hit2 = self.id1 == ids, self.id2 == ids
        both = self.prior.span[ids]
        low, wide = (self.w12 << _FREQ) + (both >> 32) * self.w0, (both & 0xFFFFFFFF) * self.w0
        named = np.flatnonzero(self.hit1 | self.hit2)
        if named.size:
            one = 1 - self.hit2[named].astype(np.int32)
            w2 = self.w2[named]
            low[named] = one * w2 << _FREQ
            wide[named] = w2 + one * (self.w12[named] - w2 - w2) << _FREQ
        return low, wide

    def look_up(self, place: np.ndarray) -> np.ndarray:
        """The ids at places of the mix."""
        coarse = place >> _FREQ
        ids = self.id1 + (coarse < self.w2) * (self.id2 - self.id1)
        rest = np.flatnonzero(coarse >= self.w12)
        left = place[rest] - (self.w12[rest] << _FREQ)
        ids[rest] = self.prior.at[(left / self.w0[rest]).astype(np.int64)]
        return ids

    def update(self, ids: np.ndarray) -> None:
        # Both chances at once: each loses 1/2^_RATE, and gains as much of the whole where its model was right.
        self.weights[self.state] = self.was - (self.was >> _RATE & _LOST) + self.hit2 * _GAIN2 + (self.hit1 > self.hit2) * _GAIN1
        fresh = ids << 2 | 1
        self.table[self.at1] = fresh + self.hit1 * np.minimum(self.sure1, 2)
        self.table[self.at2] = fresh + self.hit2 * np.minimum(self.sure2, 2)
        self.prev1 = ids


def _sizes(n: int, block: int) -> np.ndarray:
    sizes = np.full(-(-n // block), block)
    sizes[-1] = n - block * (len(sizes) - 1)
    return sizes


def _segments(sizes: np.ndarray) -> list[tuple[int, int, int]]:
    """Steps from, to, and lanes that go on; the last lane may end early."""
    cuts = sorted({0, int(sizes[-1]), int(sizes.max())})
    return [(a, b, int((sizes > a).sum())) for a, b in zip(cuts, cuts[1:], strict=False)]


def encode(ids: np.ndarray, bits: int = 16, block: int = BLOCK, prior: Prior | None = None) -> list[bytes]:
    """The payload of each block of ``ids`` (below 2**bits, of at most 16 bits), any number of blocks up to memory."""
    ids = np.asarray(ids, np.uint32)
    if len(ids) and int(ids.max()) >> min(bits, MOST_BITS):
        raise ValueError("an id is too large")
    prior = prior or Prior.flat(bits)
    out: list[bytes] = []
    for first in range(0, len(ids), block * LANES):
        out += _encode(ids[first : first + block * LANES], block, prior)
    return out


def _encode(ids: np.ndarray, block: int, prior: Prior) -> list[bytes]:
    sizes = _sizes(len(ids), block)
    lanes = len(sizes)
    grid = np.zeros(lanes * block, np.uint16)
    grid[: len(ids)] = ids
    grid = np.ascontiguousarray(grid.reshape(lanes, block).T)
    if not (prior.span[ids] & 0xFFFFFFFF).all():
        raise ValueError("an id was not counted")
    model = _Model(lanes, prior)
    low, span = np.zeros(lanes, np.uint64), np.full(lanes, 1 << 52, np.uint64)
    words, owners, every = [], [], np.arange(lanes, dtype=np.uint16)
    for begin, end, live in _segments(sizes):
        if live < len(model.base):
            model.keep(live)
        lo, rng = low[:live], span[:live]
        for step in range(begin, end):
            now = grid[step, :live].astype(np.int32)
            model.predict()
            a, w = model.span(now)
            unit = rng >> np.uint64(_TOTAL)
            lo += unit * a.view(np.uint64)
            np.multiply(unit, w.view(np.uint64), out=rng)
            ready = np.flatnonzero(rng < 1 << _KEEP)
            while ready.size:
                part = lo[ready]
                words.append((part >> np.uint64(_KEEP)).astype(np.uint32))
                owners.append(ready.astype(np.uint16))
                lo[ready] = (part & _WORD) << np.uint64(16)
                grown = rng[ready] << np.uint64(16)
                rng[ready] = grown
                ready = ready[grown < 1 << _KEEP]
            model.update(now)
    for _ in range(4):
        words.append((low >> np.uint64(_KEEP)).astype(np.uint32))
        owners.append(every)
        low = (low & _WORD) << np.uint64(16)
    owner = np.concatenate(owners)
    coded = np.concatenate(words)[np.argsort(owner, kind="stable")]
    while (carry := coded >> 16).any():  # a block's first word has none
        coded &= 0xFFFF
        coded[:-1] += carry[1:]
    data, ends = coded.astype("<u2").tobytes(), np.cumsum(np.bincount(owner, minlength=lanes)) * 2
    return [data[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]


def decode(payloads: list[bytes], n: int, bits: int = 16, block: int = BLOCK, prior: Prior | None = None) -> np.ndarray:
    """The n ids of all blocks, in order."""
    prior = prior or Prior.flat(bits)
    parts = [np.zeros(0, np.uint32)]
    for first in range(0, len(payloads), LANES):
        count = min(block * LANES, n - first * block)
        parts.append(_decode(payloads[first : first + LANES], count, block, prior))
    return np.concatenate(parts)


def _decode(payloads: list[bytes], n: int, block: int, prior: Prior) -> np.ndarray:
    sizes = _sizes(n, block)
    lanes, room = len(sizes), max(map(len, payloads)) // 2 + 4
    words = np.frombuffer(b"".join(p.ljust(2 * room, b"\0") for p in payloads), "<u2")
    at = np.arange(lanes) * room
    code, span = np.zeros(lanes, np.uint64), np.full(lanes, 1 << 52, np.uint64)  # code has 12 bits below those of a range
    for _ in range(4):
        code = code << np.uint64(16) | words[at]
        at += 1
    grid = np.zeros((block, lanes), np.uint16)
    model = _Model(lanes, prior)
    for begin, end, live in _segments(sizes):
        if live < len(model.base):
            model.keep(live)
        x, rng, get = code[:live], span[:live], at[:live]
        for step in range(begin, end):
            model.predict()
            unit = rng >> np.uint64(_TOTAL)
            place = (x >> np.uint64(12)).astype(np.float64) / unit.astype(np.float64)
            now = model.look_up(np.minimum(place, (1 << _TOTAL) - 1).astype(np.int32))
            grid[step, :live] = now
            a, w = model.span(now)
            x -= unit * a.view(np.uint64) << np.uint64(12)
            np.multiply(unit, w.view(np.uint64), out=rng)
            ready = np.flatnonzero(rng < 1 << _KEEP)
            while ready.size:
                where = get[ready]
                x[ready] = x[ready] << np.uint64(16) | words[where]
                get[ready] = where + 1
                grown = rng[ready] << np.uint64(16)
                rng[ready] = grown
                ready = ready[grown < 1 << _KEEP]
            model.update(now)
    return np.ascontiguousarray(grid.T).reshape(-1)[:n].astype(np.uint32)
