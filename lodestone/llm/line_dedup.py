"""Lines that many documents share, kept in one of them: range-partitioned hashes, and a bitmap a document.

The keys of long lines are hashed to 128 bits and written with document and line number. These rows are dealt out by
ranges of hash and document, in order of hash, document (the largest first) and line, so a task streams over the lines of
a key and meets the document that keeps them first. A key with very many lines is dealt to several tasks: what a task
cannot know of its first and its last key, it hands on with a count of documents, and the counts, two a task, settle it.
No text is sorted, and nothing but five documents of a key is held.

The result is a bitmap of the lines that stay for each document that loses any, compressed; applied to the texts, it
gives what is left.

Rows with null or empty text have one empty line. Rows with a null doc_id count as one document, after all others; rows
that share a doc_id count as one document too, and each is returned. Lines of other white space than the six characters
are as they are. Other columns, whatever their names, are left aside.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType

from lodestone.llm.common import tidy, written
from lodestone.llm.rows import keyed
from lodestone.session import ensure_importable

SHORTEST, MANY = 40, 5
SPACES = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_ROW = "a long, b long, doc long, tag long, line int"
_OUT = f"{_ROW}, kind int, n int"
ROW, EDGE, GONE = 0, 1, 2


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(SPACES)), UPPER, LOWER)


def hashed_lines(rows: DataFrame, shortest: int = SHORTEST) -> DataFrame:
    """``rows``: doc, tag, text. a, b (two hashes of the key), doc, tag, line (from 0) of each line with a long key."""
    each = rows.select("doc", "tag", F.posexplode(F.split("text", "\n", -1)).alias("line", "x")).select("doc", "tag", "line", line_key(F.col("x")).alias("key"))
    two = [F.xxhash64("key").alias("a"), F.xxhash64(F.lit(1), F.col("key")).alias("b")]
    return each.filter(F.char_length("key") >= shortest).select(*two, "doc", "tag", "line")


def _runs(batch: pa.RecordBatch, least: int) -> Iterator[tuple[tuple[int, int], int, int]]:
    """Key, begin and end of each run of one key that has ``least`` rows or reaches an end of the batch."""
    a, b = (batch.column(c).to_numpy() for c in ("a", "b"))
    cuts = np.flatnonzero((a[1:] != a[:-1]) | (b[1:] != b[:-1])) + 1
    begin, end = np.append(0, cuts), np.append(cuts, len(a))
    for i in np.flatnonzero((end - begin >= least) | (begin == 0) | (end == len(a))).tolist():
        yield (int(a[begin[i]]), int(b[begin[i]])), int(begin[i]), int(end[i])


class _Key:
    """The lines of one key as they stream by: documents so far, and rows held back until there are enough."""

    def __init__(self, first: bool):
        self.first, self.docs, self.last, self.keeper, self.held = first, 0, None, None, []


def _stream(many: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, at, seen = None, None, False

        def out(batch: pa.RecordBatch, kind: int) -> pa.RecordBatch:
            fill = [pa.array(np.full(batch.num_rows, x, np.int32)) for x in (kind, 0)]
            return pa.RecordBatch.from_arrays([*batch.columns, *fill], [*batch.schema.names, "kind", "n"])

        def edge(key: tuple[int, int], x: _Key) -> pa.RecordBatch:
            cells = [(key[0], pa.int64()), (key[1], pa.int64()), (x.keeper, pa.int64()), (0, pa.int64()), (0, pa.int32()), (EDGE, pa.int32()), (min(x.docs, many), pa.int32())]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in cells], ["a", "b", "doc", "tag", "line", "kind", "n"])

        for batch in batches:
            docs = batch.column("doc").to_numpy()
            gone: list[np.ndarray] = []
            for key, s, e in _runs(batch, many) if batch.num_rows else ():
                if key != at:
                    if now is not None and now.first:
                        yield edge(at, now)
                    now, at, seen = _Key(not seen), key, True
                mine = docs[s:e]
                if now.keeper is None:
                    now.keeper = int(mine[0])
                new = int((mine[1:] != mine[:-1]).sum()) + (int(mine[0]) != now.last)
                now.docs, now.last = now.docs + new, int(mine[-1])
                if now.first:  # the partition before may hold more of it: all its rows wait for the counts
                    yield out(batch.slice(s, e - s), ROW)
                    continue
                lose = np.flatnonzero(mine != now.keeper) + s
                if now.docs >= many:
                    for x in now.held:
                        yield out(x, GONE)
                    now.held = []
                    gone.append(lose)
                elif len(lose):
                    now.held.append(batch.take(pa.array(lose)))
            if gone and (rows := np.concatenate(gone)).size:
                yield out(batch.take(pa.array(rows)), GONE)
        if now is not None:  # the partition after may hold more of the last key
            for x in now.held:
                yield out(x, ROW)
            yield edge(at, now)

    return run


def dropped(lines: DataFrame, many: int = MANY) -> DataFrame:
    """doc, tag, line of the lines that go. ``lines`` as of ``hashed_lines``, in a table that can be read twice."""
    ensure_importable(lines.sparkSession)
    order = [F.col("a"), F.col("b"), F.col("doc").desc()]
    # Lines of one key and document stay together, so documents are counted once.
    sorted_ = lines.repartitionByRange(*order).sortWithinPartitions(*order, "tag", "line")
    seen = written(sorted_.mapInArrow(tidy(_stream(many)), _OUT), "shared_lines")
    # At most two rows a task. A key that one task alone has seen the edge of is whole in it.
    edges = seen.filter(F.col("kind") == EDGE).groupBy("a", "b").agg(F.sum("n").alias("n"), F.max("doc").alias("keeper")).filter(F.col("n") >= many)
    open_ = seen.filter(F.col("kind") == ROW)
    late = open_.join(F.broadcast(edges.select("a", "b", "keeper")), ["a", "b"]).filter("doc != keeper")
    return seen.filter(F.col("kind") == GONE).select("doc", "tag", "line").unionByName(late.select("doc", "tag", "line"))


def bitmap(gone: np.ndarray) -> bytes:
    """The lines that stay, a bit each from the first on and ones after the last that goes, compressed."""
    bits = np.ones(-(-(int(gone.max()) + 1) // 8) * 8, np.uint8)
    bits[gone] = 0
    return zlib.compress(np.packbits(bits, bitorder="little").tobytes())


def stays(keep: bytes | None, n: int) -> np.ndarray:
    """Whether each of ``n`` lines stays."""
    out = np.ones(n, bool)
    if keep is not None:
        bits = np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8), bitorder="little")[:n]
        out[: len(bits)] = bits.astype(bool)
    return out


@F.pandas_udf(BinaryType())
def _bitmaps(lines: pd.Series) -> pd.Series:
    return lines.map(lambda x: bitmap(np.asarray(x, np.int64)))


@F.pandas_udf(StringType())
def _without(text: pd.Series, keep: pd.Series) -> pd.Series:
    def one(t: str | None, k: bytes | None) -> str | None:
        if k is None:
            return None
        lines = t.split("\n")
        return "\n".join([x for x, stay in zip(lines, stays(k, len(lines)).tolist(), strict=True) if stay])

    return pd.Series([one(t, k) for t, k in zip(text, keep, strict=True)], dtype=object)


def bitmaps(rows: DataFrame, shortest: int = SHORTEST, many: int = MANY) -> DataFrame:
    """``rows`` as of ``rows.keyed``. doc, tag, n_dropped, keep of each row that loses lines; ``keep`` as of ``bitmap``."""
    ensure_importable(rows.sparkSession)
    gone = dropped(written(hashed_lines(rows, shortest), "lines"), many)
    listed = gone.groupBy("doc", "tag").agg(F.collect_list("line").alias("lines"))  # of one document: no longer than its text
    return listed.select("doc", "tag", F.size("lines").cast("long").alias("n_dropped"), _bitmaps("lines").alias("keep"))


def deduplicated(docs: DataFrame, shortest: int = SHORTEST, many: int = MANY) -> DataFrame:
    """doc_id, n_lines (before), n_dropped, kept (text), for every row."""
    rows = keyed(docs)
    # Texts go by document to the bitmaps at any size: these grow with the texts, so they are no table to send out whole.
    marked = rows.join(bitmaps(rows, shortest, many).hint("shuffle_hash"), ["doc", "tag"], "left")
    less = _without(F.when(F.col("keep").isNotNull(), F.col("text")), F.col("keep"))
    n = (F.char_length("text") - F.char_length(F.replace("text", F.lit("\n"), F.lit(""))) + 1).cast("long")
    return marked.select("doc_id", n.alias("n_lines"), F.coalesce("n_dropped", F.lit(0)).cast("long").alias("n_dropped"), F.coalesce(less, F.col("text")).alias("kept"))
