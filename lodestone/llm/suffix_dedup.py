"""Repeated byte strings across all documents, by longest-previous-factor arrays over suffix-array blocks.

A string of ``length`` bytes that occurs twice has the same anchor in both places: the 32-byte piece in it whose hash
is smallest. So equal strings meet by anchor:

1. Every text is cut to its anchors (about one in 85 bytes). An anchor's hull is the bytes that any such string around
   it can take in.
2. Hulls that occur more than once need no further look: each of their bytes lies in a repeated string. They are
   counted with partial aggregation, so thousands of copies are one row each task.
3. Where an anchor occurs in different hulls, one occurrence of each hull is fetched, and hulls of the same anchors go
   to one block. A block's hulls, merged where they overlap in a text, form the text of a suffix array sorted to depth
   ``length``. In suffix order, the previous and next smaller text positions give each suffix's longest previous
   factor; their mirror images give the longest following one. Strings with a factor of full length are repeated.
4. An anchor with more than ``crowd`` different hulls is not brought together at all: hashes of each of its strings
   are counted instead, with partial aggregation.

``keep="none"`` removes every copy, ``keep="first"`` all but the first by (doc_id, position).

Defined cases: a null text counts as empty; texts below ``length`` bytes keep all; matches never cross documents;
repeated rows are copies of each other under keep="none" and share their result under keep="first" (rows of one
doc_id and text count as one document there); null doc_ids come last; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import discard, tidy, written
from lodestone.llm.rows import keyed
from lodestone.llm.tokens import steps
from lodestone.session import ensure_importable

LENGTH, PIECE, CROWD = 200, 32, 4096
_SLICE, _BITS = 1 << 19, 20  # bytes hashed at once; bits for a position in a slice
_BLOCK = 1 << 20  # bytes of a suffix-array block
_BYTES = np.random.default_rng(2).integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEPS = np.random.default_rng(3).integers(0, 2**63, 8, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _piece_hashes(buf: np.ndarray) -> np.ndarray:
    """Of every PIECE bytes; PIECE is a power of two."""
    h, width, k = _BYTES[buf], 1, 0
    while width < PIECE:
        h = h[:-width] * _STEPS[k] + h[width:]
        width, k = 2 * width, k + 1
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ h >> np.uint64(32)


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    m, have = x, 1
    while 2 * have <= width:
        m, have = np.minimum(m[:-have], m[have:]), 2 * have
    return np.minimum(m[: len(x) - width + 1], m[width - have :]) if have < width else m


def anchor_positions(buf: np.ndarray, sizes: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Anchors of the documents that lie in ``buf`` one after another: their positions and hashes."""
    doc = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
    at, hashes = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    low = np.uint64((1 << _BITS) - 1)
    for lo in range(0, max(0, len(buf) - length + 1), _SLICE):
        part = buf[lo : lo + _SLICE + length - 1]
        h = _piece_hashes(part)
        least = _sliding_min(h & ~low | np.arange(len(h), dtype=np.uint64), length - PIECE + 1) & low
        least = least[doc[lo : lo + len(least)] == doc[lo + length - 1 : lo + length - 1 + len(least)]]
        found = np.unique(least.astype(np.int64))
        at.append(found + lo)
        hashes.append(h[found])
    at, hashes = np.concatenate(at), np.concatenate(hashes)
    at, first = np.unique(at, return_index=True)  # neighbouring slices may name an anchor twice
    return at, hashes[first]


def _bounds(text_bytes: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    sizes = np.array([len(x) for x in text_bytes], np.int64)
    return np.frombuffer(b"".join(text_bytes), np.uint8), sizes, np.cumsum(sizes) - sizes


def _anchors(length: int):
    left, right = length - PIECE, length

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, tags, texts = batch.column("doc").to_numpy(), batch.column("tag").to_numpy(), batch.column("text").to_pylist()
            for lo, hi in steps(texts, 1_000_000):
                data = [x.encode("utf-8", "surrogatepass") for x in texts[lo:hi]]
                buf, sizes, begin = _bounds(data)
                at, hashes = anchor_positions(buf, sizes, length)
                doc = np.searchsorted(begin, at, side="right") - 1
                while (bad := np.flatnonzero(at >= begin[doc] + sizes[doc])).size:  # empty documents share a beginning
                    doc[bad] += 1
                pos = at - begin[doc]
                before, after = np.minimum(pos, left), np.minimum(sizes[doc] - pos, right)
                joined = buf.tobytes()
                digest = xxhash.xxh3_64_intdigest
                hulls = np.fromiter((digest(joined[p - b : p + a], b) for p, b, a in zip(at.tolist(), before.tolist(), after.tolist(), strict=True)), np.uint64, len(at))
                yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), pa.array(hulls.view(np.int64)), pa.array(docs[lo:hi][doc]), pa.array(tags[lo:hi][doc]), pa.array(pos.astype(np.int32))], ["anchor", "hull", "doc", "tag", "pos"])

    return run


def _hulls(length: int):
    left, right = length - PIECE, length

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The bytes of the hulls asked for, with the position at which they begin."""
        for batch in batches:
            out = []
            for doc, tag, text, asks in zip(batch.column("doc").to_pylist(), batch.column("tag").to_pylist(), batch.column("text").to_pylist(), batch.column("asks").to_pylist(), strict=True):
                data = text.encode("utf-8", "surrogatepass")
                for ask in asks:
                    at = ask["pos"]
                    start = max(0, at - left)
                    out.append((ask["anchor"], doc, tag, start, at - start, ask["crowded"], data[start : at + right]))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.binary()]
            columns = zip(*out, strict=True) if out else [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["anchor", "doc", "tag", "start", "at", "crowded", "hull"])

    return run


def suffix_order(text: np.ndarray, depth: int, whole_only: bool = False, among: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes sorted by their first ``depth`` bytes, ties by position, and for each in that order how many bytes,
    up to depth, it shares with the one before. Bytes past the end are below all others.

    With ``whole_only``, what is shared is depth or 0, the text is taken to go on with zero bytes, and ranks begin with
    eight bytes at once; of the suffixes, only those that begin at the positions ``among`` are sorted, if given.
    """
    n = len(text)
    scale = np.uint64(n + depth + 300)
    if whole_only and depth >= 8:
        padded = np.concatenate([text.astype(np.uint64), np.zeros(depth + 8, np.uint64)])
        rank, width = padded[: n + depth], 8
        for k in range(1, 8):
            rank = rank << np.uint64(8) | padded[k : k + n + depth]
        rank = np.unique(rank, return_inverse=True)[1].astype(np.uint64)
    else:
        rank, width = np.concatenate([text.astype(np.uint64) + np.uint64(1), np.zeros(depth, np.uint64)]), 1
    levels = [(width, rank)]
    while 2 * width <= depth:
        rank = np.unique(rank[: len(rank) - width] * scale + rank[width:], return_inverse=True)[1].astype(np.uint64)
        rank = np.concatenate([rank, np.zeros(width, np.uint64)])
        width *= 2
        levels.append((width, rank))
    full = rank[:n] * scale + rank[depth - width : depth - width + n]
    order = np.argsort(full, kind="stable") if among is None else among[np.argsort(full[among], kind="stable")]
    shared = np.zeros(len(order), np.int64)
    a, b = order[1:], order[:-1]
    same = full[a] == full[b]
    if whole_only:
        shared[1:] = np.where(same, depth, 0)
        return order, shared
    run = np.zeros(max(0, n - 1), np.int64)
    for width, rank in reversed(levels):
        equal = (run + width <= depth) & (rank[np.minimum(a + run, len(rank) - 1)] == rank[np.minimum(b + run, len(rank) - 1)])
        run += np.where(equal, width, 0)
    shared[1:] = np.where(same, depth, np.minimum(run, n - np.maximum(a, b)))
    return order, shared


def longest_factors(text: np.ndarray, depth: int, least: int = 1, among: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """For each position, the longest factor, up to ``depth`` bytes, that also begins earlier, and that also begins
    later; where below ``least``, 0. With ``least`` at depth, the text is taken to go on with zero bytes, and only
    factors that begin at the ascending positions ``among`` count, if given.

    In suffix order, the nearest suffix before (and after) that begins at a smaller position is found by following the
    links of those already known; so is the nearest at a larger one.
    """
    order, shared = suffix_order(text, depth, least >= depth, among)
    n = len(order)
    out = []
    for sign in (1, -1):
        best = np.zeros(n, np.int64)
        for way in (1, -1):
            pos = sign * (order if way == 1 else order[::-1])
            lcp = shared if way == 1 else np.concatenate([[0], shared[1:][::-1]]) if n else shared
            link, common = np.arange(n) - 1, lcp.copy()
            live = np.flatnonzero((link >= 0) & (common >= least))
            found = np.zeros(n, np.int64)
            while live.size:
                at = link[live]
                done = pos[at] < pos[live]
                found[live[done]] = common[live[done]]
                live, at = live[~done], at[~done]
                # The link of a larger position leads past it, never past a smaller one.
                common[live] = np.minimum(common[live], common[at])
                link[live] = link[at]
                live = live[(link[live] >= 0) & (common[live] >= least)]
            best = np.maximum(best, found if way == 1 else found[::-1])
        result = np.zeros(len(text), np.int64)
        result[order] = best
        out.append(result)
    return out[0], out[1]


def _runs(mask: np.ndarray) -> np.ndarray:
    """Beginnings and ends of the runs of true."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], mask.view(np.int8), [0]])))
    return edge.reshape(-1, 2)


def covered(starts: np.ndarray, n: int, length: int) -> np.ndarray:
    """Bytes covered by strings that begin at ``starts``."""
    step = np.zeros(n + 1, np.int64)
    step[starts] += 1
    np.subtract.at(step, np.minimum(starts + length, n), 1)
    return np.cumsum(step)[:n] > 0


def _block(rows: list[tuple], length: int, keep: str) -> list[tuple[int, int, int, int]]:
    """Repeated stretches of the hulls (doc, tag, start, bytes): doc, tag, begin, end."""
    rows.sort(key=lambda r: r[:3])
    pieces, where, at = [], [], 0  # merged hulls: where each lies in the block and in its document
    for doc, tag, start, data in rows:
        if where and where[-1][:2] == [doc, tag] and start <= where[-1][2] + where[-1][4]:
            more = data[where[-1][2] + where[-1][4] - start :]
            where[-1][4] += len(more)
        else:
            more = data
            where.append([doc, tag, start, at, len(data)])
        pieces.append(more)
        at += len(more)
    text = np.frombuffer(b"".join(pieces), np.uint8)
    # Strings count only where they lie within one hull: neither their own nor another place may reach into the next.
    inside = np.concatenate([np.arange(at, at + max(0, size - length + 1)) for _, _, _, at, size in where])
    earlier, later = longest_factors(text, length, length, inside)
    repeated = earlier >= length if keep == "first" else (earlier >= length) | (later >= length)
    out = []
    for doc, tag, start, at, size in where:
        begins = np.flatnonzero(repeated[at : at + max(0, size - length + 1)])
        if len(begins):
            out += [(doc, tag, start + int(a), start + int(b)) for a, b in _runs(covered(begins, size, length))]
    return out


def _blocks(length: int, keep: str, block: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by anchor; a block takes whole anchors."""
        rows, held, last = [], 0, None

        def flush():
            found = _block(rows, length, keep) if len(rows) > 1 else []
            columns = zip(*found, strict=True) if found else [[]] * 4
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.int32()), strict=True)], ["doc", "tag", "lo", "hi"])

        for batch in batches:
            for anchor, doc, tag, start, data in zip(*(batch.column(c).to_pylist() for c in ("anchor", "doc", "tag", "start", "hull")), strict=True):
                if anchor != last and held >= block:
                    yield flush()
                    rows, held = [], 0
                rows.append((doc, tag, start, data))
                held, last = held + len(data), anchor
        if rows:
            yield flush()

    return run


def _strings(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Hashes of the strings around a crowded anchor."""
        for batch in batches:
            out = []
            for doc, tag, start, at, data in zip(*(batch.column(c).to_pylist() for c in ("doc", "tag", "start", "at", "hull")), strict=True):
                for k in range(max(0, at + PIECE - length), min(at, len(data) - length) + 1):
                    out.append((xxhash.xxh3_128_digest(data[k : k + length]), doc, tag, start + k))
            columns = list(zip(*out, strict=True)) if out else [[]] * 4
            h1, h2 = np.frombuffer(b"".join(columns[0]), "<i8").reshape(-1, 2).T.copy()
            yield pa.RecordBatch.from_arrays([pa.array(h1), pa.array(h2), *[pa.array(c, k) for c, k in zip(columns[1:], (pa.int64(), pa.int64(), pa.int32()), strict=True)]], ["h1", "h2", "doc", "tag", "lo"])

    return run


def spans(docs: DataFrame, length: int = LENGTH, keep: str = "none", crowd: int = CROWD, block: int = _BLOCK) -> DataFrame:
    """``docs`` as of ``rows.keyed``. The stretches to remove of each: doc, tag, cuts (array of lo, hi in bytes; they
    may overlap, and hi may lie past the end)."""
    if keep not in ("none", "first"):
        raise ValueError("keep is none or first")
    found = written(docs.select("doc", "tag", "text").mapInArrow(tidy(_anchors(length)), "anchor long, hull long, doc long, tag long, pos int"), "suffix-anchors")
    place = F.struct("doc", "tag", "pos")
    hulls = found.groupBy("anchor", "hull").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("first"))
    hulls = written(hulls, "suffix-hulls")
    groups = hulls.groupBy("anchor").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("kinds")).filter("total > 1")
    groups = hulls.join(groups, "anchor")
    groups = written(groups.filter("n > 1 or kinds > 1"), "suffix-groups")
    discard(hulls)
    whole = found.join(groups.filter("n > 1").select("anchor", "hull", "first"), ["anchor", "hull"])
    if keep == "first":
        whole = whole.filter(place != F.col("first"))
    ready = written(whole.select("doc", "tag", F.greatest(F.col("pos") - (length - PIECE), F.lit(0)).alias("lo"), (F.col("pos") + length).alias("hi")), "suffix-whole")
    discard(found)
    asks = groups.filter("kinds > 1").select("first.*", "anchor", (F.col("kinds") > crowd).alias("crowded"))
    per_doc = asks.groupBy("doc", "tag").agg(F.collect_list(F.struct("anchor", "pos", "crowded")).alias("asks"))
    fetched = docs.select("doc", "tag", "text").join(per_doc, ["doc", "tag"]).mapInArrow(tidy(_hulls(length)), "anchor long, doc long, tag long, start int, at int, crowded boolean, hull binary")
    fetched = written(fetched, "suffix-fetched")
    discard(groups)
    blocks = fetched.filter("not crowded").repartition("anchor").sortWithinPartitions("anchor", "doc", "tag", "start")
    out = ready.unionByName(blocks.mapInArrow(tidy(_blocks(length, keep, block)), "doc long, tag long, lo int, hi int"))
    used = [ready, fetched]
    crowded = fetched.filter("crowded")
    if not crowded.isEmpty():
        strings = written(crowded.mapInArrow(tidy(_strings(length)), "h1 long, h2 long, doc long, tag long, lo int").distinct(), "suffix-strings")
        where = F.struct("doc", "tag", "lo")
        twice = strings.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.min(where).alias("first")).filter("n > 1")
        more = strings.join(twice, ["h1", "h2"])
        more = more.filter(where != F.col("first")) if keep == "first" else more
        out = out.unionByName(more.select("doc", "tag", "lo", (F.col("lo") + length).alias("hi")))
        used.append(strings)
    out = written(out.groupBy("doc", "tag").agg(F.collect_set(F.struct("lo", "hi")).alias("cuts")), "suffix-cuts")
    discard(*used)
    return out


def _cutter(keep_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc_id, text, cuts in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "cuts")), strict=True):
                data, removed = text.encode("utf-8", "surrogatepass"), []
                for lo, hi in sorted((c["lo"], min(c["hi"], len(data))) for c in cuts or ()):
                    if removed and lo <= removed[-1][1]:
                        removed[-1][1] = max(removed[-1][1], hi)
                    else:
                        removed.append([lo, hi])
                kept, at = [], 0
                for lo, hi in removed:
                    kept.append(data[at:lo])
                    at = hi
                kept = b"".join([*kept, data[at:]])
                out.append((doc_id, len(data), len(data) - len(kept), len(removed), hashlib.sha256(kept).hexdigest(), *([kept] if keep_text else [])))
            kinds = [pa.int64()] * 4 + [pa.string()] + [pa.binary()] * keep_text
            columns = zip(*out, strict=True) if out else [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *(["kept"] if keep_text else [])])

    return run


def deduplicate(docs: DataFrame, length: int = LENGTH, keep: str = "none", keep_text: bool = False, crowd: int = CROWD, block: int = _BLOCK) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, and with keep_text the kept bytes."""
    if length < 2 * PIECE:
        raise ValueError(f"length is {2 * PIECE} at least")
    ensure_importable(docs.sparkSession)
    rows = keyed(docs)
    cuts = spans(rows, length, keep, crowd, block)
    kind = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * keep_text
    return rows.join(cuts, ["doc", "tag"], "left").select("doc_id", "text", "cuts").mapInArrow(tidy(_cutter(keep_text)), kind)
