"""Packing documents into sequences, shortest pack first over the length histogram.

Documents become token ids and an end id, cut into pieces of at most a sequence. Only the histogram of piece lengths
(at most ``size`` rows, whatever the corpus) reaches the driver. There, lengths are placed longest first, each into
the shortest packs that still have room, counting equal packs as one pattern. Patterns are joined back by rank: the
i-th piece of a length takes the i-th place that the patterns have for that length. A piece's rank is its place
within its input partition plus the pieces of that length in partitions before, so no length is gathered in a task.

Defined cases: a null text counts as empty; an empty text is one piece, its end id; repeated rows are packed each for
itself; a null doc_id stays null; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm import tokens
from lodestone.llm.common import tidy, written
from lodestone.session import ensure_importable

SIZE = 2048
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, part int, nth long"


def cuts(n: int, size: int) -> list[int]:
    """Piece lengths of a document of n ids: full sequences, then the rest."""
    full, rest = divmod(n, size)
    return [size] * full + [rest] * (rest > 0)


def _cutter(path: str, end_id: int, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seen = TaskContext.get().partitionId(), np.zeros(size + 1, np.int64)
        coder = tokens.encoder(path)
        for batch in batches:
            doc_ids = batch.column("doc_id").to_pylist()
            for lo, hi, flat, counts in coder.encode_column(batch.column("text")):
                rows, at = [], 0
                for doc_id, n in zip(doc_ids[lo:hi], counts.tolist(), strict=True):
                    ids = np.append(flat[at : at + n], np.uint32(end_id)).astype("<u4").tobytes()
                    at, start = at + n, 0
                    for length in cuts(n + 1, size):
                        rows.append((doc_id, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]), n + 1, part, int(seen[length])))
                        seen[length] += 1
                        start += length
                kinds = [pa.int64()] * 5 + [pa.int32(), pa.int64()]
                names = [x.split()[0] for x in PIECES.split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return run


def shortest_pack_first(histogram: dict[int, int], size: int) -> list[tuple[int, int, int, int]]:
    """Places for lengths: (length, how many, first sequence, offset), in rank order for each length."""
    open_packs: dict[int, list[list]] = {}  # room left -> [count, pieces as nested pairs]
    done: list[tuple[int, tuple | None]] = []
    rooms = np.zeros(size + 1, bool)

    def put(room: int, count: int, pieces) -> None:
        if room == 0:
            done.append((count, pieces))
            return
        open_packs.setdefault(room, []).append([count, pieces])
        rooms[room] = True

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left > 0:
            fit = np.flatnonzero(rooms[length:])
            if not fit.size:
                put(size - length, left, (None, length))
                break
            room = length + int(fit[-1])
            entry = open_packs[room][-1]
            count = min(left, entry[0])
            pieces = (entry[1], length)
            entry[0] -= count
            if not entry[0]:
                open_packs[room].pop()
                rooms[room] = bool(open_packs[room])
            left -= count
            put(room - length, count, pieces)
    places, sequence = [], 0
    for count, pieces in [*done, *((c, p) for entries in open_packs.values() for c, p in entries)]:
        lengths = []
        while pieces:
            pieces, length = pieces
            lengths.append(length)
        offset = 0
        for length in reversed(lengths):
            places.append((length, count, sequence, offset))
            offset += length
        sequence += count
    return sorted(places)


def _placer(places: list[tuple[int, int, int, int]]):
    table = np.array(places, np.int64).reshape(-1, 4)
    upto = np.cumsum(table[:, 1]) - table[:, 1]
    first = {int(x): int(upto[np.searchsorted(table[:, 0], x)]) for x in np.unique(table[:, 0])}
    base = np.zeros(int(table[:, 0].max(initial=0)) + 1, np.int64)
    for length, at in first.items():
        base[length] = at

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # Places are in order of length and rank, so one search finds both.
            at = base[batch.column("length").to_numpy()] + batch.column("rank").to_numpy()
            slot = np.searchsorted(upto, at, side="right") - 1
            sequence = table[slot, 2] + at - upto[slot]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(sequence), pa.array(table[slot, 3])], [*names, "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, path: str | None = None, end_id: int = 1, size: int = SIZE) -> DataFrame:
    """Per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    ensure_importable(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    pieces = written(rows.mapInArrow(tidy(_cutter(path or tokens.default_path(), end_id, size)), PIECES), "pack-pieces")
    counts = written(pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n")), "pack-counts")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    # Offsets are a row for each part and length: they grow with the input, so they are not broadcast.
    ranked = pieces.join(offsets.hint("merge"), ["part", "length"]).withColumn("rank", F.col("before") + F.col("nth"))
    ranked = ranked.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "rank")
    kind = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return ranked.mapInArrow(tidy(_placer(shortest_pack_first(histogram, size))), kind)
