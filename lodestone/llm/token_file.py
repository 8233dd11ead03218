"""Token ids in a binary file format, and back.

A shard file has a header (magic, version, bits an id, ids a block, documents, ids), the documents' ids and sizes, the
frequencies of its ids to which every block's model is reset, a directory of blocks (bytes and crc32 of the coded
block), and the blocks, each coded on its own by ``rangecoder``. Any damage is found on reading. Shards are written by Spark as rows of a table in the shared folder, one file a row, in
ascending order of doc_id: by ranges of doc_id, then in order within a range. No Python code opens a path, so any
store that Spark writes to will do.

Defined cases: a null text counts as empty; a null doc_id comes first; equal doc_ids are ordered by text; an empty
table gives no shards and no rows; further columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm import rangecoder, tokens
from lodestone.llm.common import tidy, written
from lodestone.session import ensure_importable

MAGIC, HEAD = b"LSTK", struct.Struct("<4sHHIQQI")
VERSION = 3
#: A shard is closed at so many ids.
SHARD_IDS = rangecoder.BLOCK * rangecoder.LANES
SHARDS = "range int, nth long, n_docs long, n_ids long, file binary"
ROWS = "range int, nth long, doc_id long, at long, n_tokens long, ids_crc32 long"


class Damaged(ValueError):
    pass


def pack_file(doc_ids: list[int | None], sizes: np.ndarray, ids: np.ndarray, bits: int) -> bytes:
    prior = rangecoder.Prior.of(ids)
    blocks, counts = rangecoder.encode(ids, bits, prior=prior), prior.tobytes()
    known = np.array([x is not None for x in doc_ids], np.uint8)
    side = zlib.compress(known.tobytes() + np.array([x or 0 for x in doc_ids], "<i8").tobytes() + np.asarray(sizes, "<i8").tobytes(), 1)
    directory = np.array([(len(b), zlib.crc32(b)) for b in blocks], "<u4").reshape(-1, 2).tobytes()
    rest = struct.pack("<II", len(side), zlib.crc32(side)) + side + struct.pack("<II", len(counts), zlib.crc32(counts)) + counts + struct.pack("<I", zlib.crc32(directory)) + directory
    head = HEAD.pack(MAGIC, VERSION, bits, rangecoder.BLOCK, len(doc_ids), len(ids), len(blocks))
    return head + struct.pack("<I", zlib.crc32(head)) + rest + b"".join(blocks)


def unpack_file(file: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """The documents' ids, their numbers of token ids, and all token ids."""
    magic, version, bits, block, n_docs, n_ids, n_blocks = HEAD.unpack_from(file)
    at = HEAD.size
    if magic != MAGIC or version != VERSION or struct.unpack_from("<I", file, at)[0] != zlib.crc32(file[:at]):
        raise Damaged("header")
    parts, at = [], at + 4
    for what in ("documents", "frequencies"):
        length, crc = struct.unpack_from("<II", file, at)
        parts.append(file[at + 8 : at + 8 + length])
        at += 8 + length
        if zlib.crc32(parts[-1]) != crc:
            raise Damaged(what)
    side, prior = zlib.decompress(parts[0]), rangecoder.Prior.frombytes(parts[1])
    known, numbers = np.frombuffer(side, np.uint8, n_docs), np.frombuffer(side, "<i8", 2 * n_docs, n_docs)
    directory = file[at + 4 : at + 4 + 8 * n_blocks]
    if zlib.crc32(directory) != struct.unpack_from("<I", file, at)[0]:
        raise Damaged("directory")
    at += 4 + 8 * n_blocks
    blocks = []
    for size, crc in np.frombuffer(directory, "<u4").reshape(-1, 2).tolist():
        blocks.append(file[at : at + size])
        at += size
        if zlib.crc32(blocks[-1]) != crc:
            raise Damaged(f"block {len(blocks) - 1}")
    doc_ids = [x if k else None for x, k in zip(numbers[:n_docs].tolist(), known.tolist(), strict=True)]
    return doc_ids, numbers[n_docs:], rangecoder.decode(blocks, n_ids, bits, block, prior)


def _writer(path: str, end_id: int, bits: int, shard_ids: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, nth = TaskContext.get().partitionId(), 0
        coder = tokens.encoder(path)
        docs, sizes, flats, held = [], [], [], 0

        def shard() -> pa.RecordBatch:
            file = pack_file(docs, np.concatenate(sizes), np.concatenate(flats), bits)
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), *[pa.array([x], pa.int64()) for x in (nth, len(docs), held)], pa.array([file], pa.binary())], ["range", "nth", "n_docs", "n_ids", "file"])

        for batch in batches:
            doc_ids = batch.column("doc_id").to_pylist()
            for lo, hi, flat, counts in coder.encode_column(batch.column("text")):
                flat = np.insert(flat, np.cumsum(counts), np.uint32(end_id))
                docs, held = docs + doc_ids[lo:hi], held + len(flat)
                sizes.append(counts + 1)
                flats.append(flat)
                if held >= shard_ids:
                    yield shard()
                    docs, sizes, flats, held, nth = [], [], [], 0, nth + 1
        if docs:
            yield shard()

    return run


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, nth, file in zip(batch.column("range").to_pylist(), batch.column("nth").to_pylist(), batch.column("file"), strict=True):
            doc_ids, sizes, ids = unpack_file(file.as_py())
            data, upto = ids.astype("<u4").tobytes(), np.cumsum(sizes)
            starts = upto - sizes
            crc = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(starts.tolist(), upto.tolist(), strict=True)]
            n = len(doc_ids)
            yield pa.RecordBatch.from_arrays([pa.array([part] * n, pa.int32()), pa.array([nth] * n, pa.int64()), pa.array(doc_ids, pa.int64()), pa.array(starts), pa.array(sizes), pa.array(crc, pa.int64())], [x.split()[0] for x in ROWS.split(", ")])


def write_shards(docs: DataFrame, path: str | None = None, end_id: int = 2, bits: int = 16, shard_ids: int = SHARD_IDS) -> DataFrame:
    """The table of shard files, written to the shared folder."""
    ensure_importable(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "text")
    return written(ordered.mapInArrow(tidy(_writer(path or tokens.default_path(), end_id, bits, shard_ids)), SHARDS), "token-shards")


def read_shards(shards: DataFrame) -> DataFrame:
    """Per document of the files: doc_id, start, n_tokens, ids_crc32. Only a row a shard goes into the running total."""
    before = Window.orderBy("range", "nth").rowsBetween(Window.unboundedPreceding, -1)
    starts = shards.select("range", "nth", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("before"))
    rows = shards.select("range", "nth", "file").mapInArrow(tidy(_read), ROWS)
    return rows.join(starts, ["range", "nth"]).select("doc_id", (F.col("before") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")
