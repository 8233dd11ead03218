"""Token ids of whole texts by a public byte-level tokenizer, for Arrow columns.

A byte-level pre-tokenizer cuts a text at places that a byte and its neighbour tell: between a letter and anything but a
letter, before white space, before the last of several white-space characters, and so on. Texts are cut at those of
these places that hold whatever stands around (next to bytes above 0x7F and after an apostrophe none does), each
distinct piece is encoded once by the tokenizers library, and each worker remembers its ids. Cutting and looking up work
on the bytes of an Arrow column, a few array operations for all pieces of a step; no text becomes a Python string but
for pieces that are new. Texts with the string of an added token or with white space beyond ASCII are encoded in one go.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Pieces that a worker remembers at most; where they would be more, those seen once since the last time go.
MEMO_PIECES = 1_250_000
#: Bytes of text that are cut at once.
STEP_BYTES = 1_000_000
#: A longer text is cut at spaces after letters into steps of its own.
LONG_BYTES = 4 * STEP_BYTES
KEY_BYTES = 15  # of pieces up to this length the bytes themselves are the key
JOINED = 500  # new pieces in a text for the library
SPACE, LINE = "Ġ", "Ċ"  # fixed values: how a byte-level vocabulary writes the bytes 0x20 and 0x0A
_CUT, _RUN, _LEAD = 1, 2, 4
_WIDE_SPACE = re.compile("[\x85\xa0  -     　]")
_ENCODERS: dict[str, Encoder] = {}


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _pairs() -> tuple[np.ndarray, np.ndarray]:
    """Of each byte its kind; of each two kinds (8 * first + second) what the place between them is."""
    letter, digit, mark, quote, space, blank, high, lead = range(8)
    kinds = np.full(256, mark, np.uint8)
    for x in range(128):
        if chr(x).isalpha():
            kinds[x] = letter
        elif chr(x).isdigit():
            kinds[x] = digit
    kinds[ord("'")], kinds[0x20], kinds[0x09:0x0E], kinds[0x80:] = quote, space, blank, high
    kinds[[0xC2, 0xE1, 0xE2, 0xE3]] = lead  # of the UTF-8 forms of white space beyond ASCII
    table = np.zeros(64, np.uint8)
    for a in range(8):
        for b in range(8):
            white_a, white_b, other = a in (space, blank), b in (space, blank), a in (high, lead) or b in (high, lead)
            if white_a and white_b:
                place = _RUN
            elif white_b or a == blank:
                place = _CUT
            elif a in (space, quote) or other or a == b or (a, b) == (mark, quote):
                place = 0
            else:
                place = _CUT
            table[8 * a + b] = place | _LEAD * (b == lead)
    return kinds, table


_KINDS, _PLACES = _pairs()
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def _spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places of all ranges, one after another."""
    upto = np.cumsum(sizes)
    return np.repeat(starts - (upto - sizes), sizes) + np.arange(int(upto[-1]) if len(upto) else 0)


class Encoder:
    def __init__(self, path: str, memo_pieces: int = MEMO_PIECES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [x.content.encode() for x in self.tokenizer.get_added_tokens_decoder().values()]
        made = json.loads(self.tokenizer.to_str())
        before = made.get("pre_tokenizer") or {}
        self.cuts = made.get("normalizer") is None and before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space")
        self.memo_pieces = memo_pieces
        vocabulary = self.tokenizer.get_vocab()
        self.spaced = np.zeros(max(vocabulary.values()) + 1, bool)
        self.spaced[[i for x, i in vocabulary.items() if SPACE in x]] = True
        self.line = vocabulary.get(LINE, -1)
        self._size(1 << 16)
        self.flat, self.used, self.known, self.moves = np.zeros(1 << 16, np.uint32), 0, 0, 0
        self.long: dict[bytes, np.ndarray] = {}
        self.long_bytes = 0

    # -- the memo: open addressing; a slot has a piece's two key words, and where its ids begin and how many they are

    def _size(self, slots: int) -> None:
        self.bits = slots.bit_length() - 1
        self.low, self.high = np.zeros(slots, np.uint64), np.zeros(slots, np.uint64)
        self.place, self.again = np.full(slots, -1, np.int64), np.zeros(slots, bool)

    def _slots(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Of each key its slot, or the first free one after where it would be."""
        mixed = (low ^ (high >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + high * np.uint64(0xC2B2AE3D27D4EB4F)
        mixed ^= mixed >> np.uint64(32)
        mixed *= np.uint64(0xD6E8FEB86659FD93)
        slot = (mixed >> np.uint64(64 - self.bits)).astype(np.int64)
        left = np.flatnonzero(((self.low.take(slot) != low) | (self.high.take(slot) != high)) & (self.place.take(slot) >= 0))
        while left.size:
            at = (slot[left] + 1) & ((1 << self.bits) - 1)
            slot[left] = at
            left = left[((self.low[at] != low[left]) | (self.high[at] != high[left])) & (self.place[at] >= 0)]
        return slot

    def _insert(self, low: np.ndarray, high: np.ndarray, place: np.ndarray) -> None:
        """Distinct keys that are not in the memo."""
        left = np.arange(len(low))
        while left.size:
            slot = self._slots(low[left], high[left])
            self.place[slot] = left  # of keys that meet in a slot the last one stays
            stay = self.place[slot] == left
            won = left[stay]
            self.low[slot[stay]], self.high[slot[stay]], self.place[slot[stay]] = low[won], high[won], place[won]
            left = left[~stay]
        self.known += len(low)

    def _room(self, more: int) -> None:
        """Room for so many new pieces: a larger table, or fewer pieces."""
        slots = 1 << self.bits
        if self.known + more <= slots * 5 // 8:
            return
        full = np.flatnonzero(self.place >= 0)
        if self.known + more > self.memo_pieces:
            full = full[self.again[full]]
            if len(full) + more > self.memo_pieces // 2:
                full = full[:0]
            flat, sizes = self._gathered(self.place[full])
            self.flat, self.used = np.concatenate([flat, np.zeros(1 << 16, np.uint32)]), len(flat)
            place = (np.cumsum(sizes) - sizes) << 4 | sizes
        else:
            place = self.place[full]
        low, high = self.low[full], self.high[full]
        while len(full) + more > slots * 5 // 8:
            slots *= 2
        self._size(slots)
        self.known, self.moves = 0, self.moves + 1
        self._insert(low, high, place)

    def _gathered(self, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        starts, sizes = place >> 4, place & 15
        return self.flat.take(_spread(starts, sizes)), sizes

    # -- the library

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _encoded(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, kind: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and numbers of ids of pieces, many a text where their ids can be told apart again.

        Kind 0 begins with its only space, so does its first id; kind 1 has no white space, so lines can part it.
        """
        if kind == 1:
            upto = np.cumsum(sizes)
            held, sizes = np.insert(data[_spread(starts, sizes)], upto, np.uint8(10)), sizes + 1
        elif kind == 0:
            held = data[_spread(starts, sizes)]
        if kind < 2 and len(starts):
            cuts = np.append(0, np.cumsum(sizes)[np.append(np.arange(JOINED, len(sizes), JOINED) - 1, len(sizes) - 1)]).tolist()
            flat = np.concatenate(self._ids([held[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(cuts, cuts[1:], strict=False)]))
            if kind == 0:
                begins = np.flatnonzero(self.spaced[flat])
                if len(begins) == len(starts):
                    return flat, np.diff(begins, append=len(flat))
            else:
                ends, sizes = np.flatnonzero(flat == self.line), sizes - 1
                if len(ends) == len(starts):
                    return flat[flat != self.line], np.diff(ends, prepend=-1) - 1
        ids = self._ids([data[s : s + n].tobytes().decode("utf-8", "replace") for s, n in zip(starts.tolist(), sizes.tolist(), strict=True)])
        return np.concatenate([np.zeros(0, np.uint32), *ids]), np.array([len(x) for x in ids], np.int64)

    def _learn(self, data: np.ndarray, low: np.ndarray, high: np.ndarray, starts: np.ndarray) -> None:
        order = np.lexsort((low, high))
        low, high, starts = low[order], high[order], starts[order]
        first = np.append(True, (low[1:] != low[:-1]) | (high[1:] != high[:-1]))
        low, high, starts = low[first], high[first], starts[first]
        sizes = (high >> np.uint64(56)).astype(np.int64)
        one, two = (low & np.uint64(0xFF)).astype(np.uint8), (low >> np.uint64(8) & np.uint64(0xFF)).astype(np.uint8)
        white = [_KINDS[x] & 6 == 4 for x in (one, two)]
        kind = np.where((one == 32) & (sizes > 1) & ~white[1], 0, np.where(white[0] | (self.line < 0), 2, 1))
        order = np.argsort(kind, kind="stable")
        low, high = low[order], high[order]
        parts = [self._encoded(data, starts[kind == k], sizes[kind == k], k) for k in range(3)]
        flat, sizes = (np.concatenate(x) for x in zip(*parts, strict=True))
        if len(sizes) and int(sizes.max()) > KEY_BYTES:
            raise ValueError("a piece has more ids than bytes")
        self._room(len(low))
        while self.used + len(flat) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[self.used : self.used + len(flat)] = flat
        self._insert(low, high, (self.used + np.cumsum(sizes) - sizes) << 4 | sizes)
        self.used += len(flat)

    def _long_ids(self, piece: bytes) -> np.ndarray:
        found = self.long.get(piece)
        if found is None:
            found = self._ids([piece.decode("utf-8", "replace")])[0]
            if len(piece) <= 256:
                if self.long_bytes > 1 << 23:
                    self.long, self.long_bytes = {}, 0
                self.long[piece], self.long_bytes = found, self.long_bytes + 200 + 5 * len(piece)
        return found

    # -- texts

    def _step(self, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts of ``data`` that end at ``ends``, and the number of ids of each."""
        begins = np.concatenate([[0], ends[:-1]])
        raw = data.tobytes()
        whole = {int(np.searchsorted(ends, m.start(), side="right")) for a in self.added for m in re.finditer(re.escape(a), raw)}
        if not self.cuts:
            whole = set(range(len(ends)))
        kinds = _KINDS.take(data)
        pairs = np.empty(len(data), np.uint8)
        pairs[:1] = kinds[:1]
        np.left_shift(kinds[:-1], 3, out=pairs[1:])
        pairs[1:] |= kinds[1:]
        places = _PLACES.take(pairs)
        filled = begins[begins < ends]
        places[filled] = _CUT | places[filled] & _LEAD
        at = np.flatnonzero(places)
        what = places.take(at)
        if (leads := at[what & _LEAD > 0]).size:
            for i in np.unique(np.searchsorted(ends, leads, side="right")).tolist():
                if i not in whole and _WIDE_SPACE.search(raw[begins[i] : ends[i]].decode("utf-8", "replace")):
                    whole.add(i)
        runs = what & _RUN > 0
        if runs.any():  # the place before the last of a run, where the run does not end the text
            after = at[runs] + 1
            last = after < len(data)
            last[last] = (places[after[last]] & _RUN == 0) & (kinds[after[last]] != 4) & (kinds[after[last]] != 5)
            ending = np.zeros(len(data) + 1, bool)
            ending[ends] = True
            last &= ~ending[after]
            what[runs] = last * _CUT
        starts = at[what & _CUT > 0]
        sizes = np.diff(starts, append=len(data))
        padded = np.concatenate([data, np.zeros(16, np.uint8)])
        words = np.ndarray(len(data) + 8, "<u8", padded, strides=(1,))
        low = words[starts] & _MASKS.take(np.minimum(sizes, 8))
        high = words[starts + 8] & _MASKS.take(np.clip(sizes - 8, 0, 7)) | sizes.astype(np.uint64) << np.uint64(56)
        short = sizes <= KEY_BYTES
        wide = np.flatnonzero(~short)
        if wide.size:
            low[wide] = high[wide] = 0  # the key of no piece; its ids are put in below
            short_at = np.flatnonzero(short)
            place = np.zeros(len(starts), np.int64)
            place[short_at] = self._places(data, low[short_at], high[short_at], starts[short_at])
        else:
            place = self._places(data, low, high, starts)
        flat, n_ids = self._gathered(place)
        if wide.size:
            parts = [self._long_ids(raw[s : s + n]) for s, n in zip(starts[wide].tolist(), sizes[wide].tolist(), strict=True)]
            before = np.cumsum(n_ids)[wide]  # long pieces have no ids yet
            more = np.array([len(p) for p in parts])
            flat = np.insert(flat, np.repeat(before, more), np.concatenate(parts))
            n_ids[wide] = more
        upto = np.concatenate([[0], np.cumsum(n_ids)])
        counts = np.diff(upto[np.searchsorted(starts, np.concatenate([begins, ends[-1:]]))])
        if whole:
            parts = np.split(flat, np.cumsum(counts)[:-1])
            for i in whole:
                parts[i] = self._ids([raw[begins[i] : ends[i]].decode("utf-8", "replace")])[0]
            flat, counts = np.concatenate(parts), np.array([len(p) for p in parts], np.int64)
        return flat, counts

    def _places(self, data: np.ndarray, low: np.ndarray, high: np.ndarray, starts: np.ndarray) -> np.ndarray:
        slot = self._slots(low, high)
        place = self.place.take(slot)
        new = np.flatnonzero(place < 0)
        old = slot[place >= 0] if new.size else slot
        self.again[old] = True
        if new.size:
            moves = self.moves
            self._learn(data, low[new], high[new], starts[new])
            if self.moves == moves:
                place[new] = self.place[self._slots(low[new], high[new])]
            else:  # pieces have moved, or gone
                while (place := self.place[self._slots(low, high)]).min() < 0:
                    gone = np.flatnonzero(place < 0)
                    kept, self.memo_pieces = self.memo_pieces, 1 << 60
                    self._learn(data, low[gone], high[gone], starts[gone])
                    self.memo_pieces = kept
        return place

    def encode_bytes(self, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids in order, and the number of ids of each text. ``data``: the texts' UTF-8 bytes, one after another."""
        if not len(ends) or not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(ends), np.int64)
        if len(data) <= LONG_BYTES or len(ends) > 1 or not self.cuts or any(b" " in a for a in self.added):
            return self._step(data, ends)
        flats, lo, apart = [], 0, np.flatnonzero((data[1:] == 32) & (_KINDS[data[:-1]] == 0)) + 1
        near = np.unique(np.searchsorted(apart, np.arange(STEP_BYTES, len(data), STEP_BYTES)))
        for hi in [*apart[near[near < len(apart)]].tolist(), len(data)]:
            flats.append(self._step(data[lo:hi], np.array([hi - lo]))[0])
            lo = hi
        flat = np.concatenate(flats)
        return flat, np.array([len(flat)], np.int64)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """As ``encode_bytes``, for strings."""
        data = [x.encode("utf-8", "replace") for x in texts]
        return self.encode_bytes(np.frombuffer(b"".join(data), np.uint8), np.cumsum([len(x) for x in data], dtype=np.int64))

    def encode_column(self, column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """Ranges of rows of a string column, with their ids and numbers of ids; a null counts as empty."""
        if not len(column):
            return
        column = pc.fill_null(column, "").cast(pa.large_string())
        offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, 8 * column.offset)
        held = column.buffers()[2]
        data = np.frombuffer(held, np.uint8) if held is not None and held.size else np.zeros(0, np.uint8)
        lo = 0
        while lo < len(column):
            hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + STEP_BYTES, side="right")) - 1)
            hi = min(hi, len(column))
            yield lo, hi, *self.encode_bytes(data[offsets[lo] : offsets[hi]], offsets[lo + 1 : hi + 1] - offsets[lo])
            lo = hi


def encoder(path: str) -> Encoder:
    """One encoder a worker process and vocabulary; its memo serves the tasks that follow."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def steps(texts: list[str | None], chars: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of a batch of which each has about so many characters, to bound memory."""
    lo, held = 0, 0
    for i, x in enumerate(texts):
        held += len(x or "")
        if held >= chars:
            yield lo, i + 1
            lo, held = i + 1, 0
    if lo < len(texts):
        yield lo, len(texts)
