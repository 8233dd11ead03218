"""The whole graph as one JSON document: metadata, papers, entities and relations, in this order.

A document may be of any size. It is read twice as pieces between commas, by all tasks that its splits give. Whether a piece
begins within a string, and how deep it lies in brackets, are running sums over the pieces before it; so are the numbers of
its elements. The first reading sums up each split for either answer to whether it begins within a string; with what lies
before each split, the second gives elements. Only those that go over a batch of pieces are put together by a shuffle. Line breaks,
or none, make no difference, and a document may be in several files, whose text continues in order of their names; a file may end
anywhere but in a comma or within an escape.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone import schemas
from lodestone.operators.ordering import ranked_whole
from lodestone.session import ensure_importable, written

PAPERS = f"source_file STRING, focal_entities {schemas.FOCAL}"
METADATA = "raw_batch_records BIGINT, raw_entity_occurrences BIGINT, raw_relation_occurrences BIGINT, canonical_entities BIGINT, canonical_relations BIGINT, entity_type_counts MAP<STRING, BIGINT>, relation_type_counts MAP<STRING, BIGINT>, dropped_relation_reasons MAP<STRING, BIGINT>"
SECTIONS = {"metadata": METADATA, "papers": PAPERS, "entities": schemas.CANONICAL_ENTITY, "relations": schemas.CANONICAL_RELATION}
#: Begins a section: its key, and what kind of value it has.
_KEY = r'^\s*\{?\s*"((?:[^"\\]|\\.)*)"\s*:\s*([\[{])'
#: Bytes that matter to strings and brackets.
_QUOTE, _ESCAPE, _OPEN, _CLOSE = 1, 2, 3, 4
_KINDS = np.zeros(256, np.uint8)
_KINDS[list(b'"')], _KINDS[list(b"\\")], _KINDS[list(b"[{")], _KINDS[list(b"]}")] = _QUOTE, _ESCAPE, _OPEN, _CLOSE
_SUMS = "file long, block long, inside int, quotes long, delta long, depth long, n long"
_PARTS = "item long, depth long, split long, nth long, whole boolean, text binary"


@dataclass
class Document:
    """``metadata`` has one row, or none; sections that the document lacks are empty."""

    metadata: DataFrame
    papers: DataFrame
    entities: DataFrame
    relations: DataFrame


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """value, file (a number by its name), block (where its split begins); each split's pieces in their order."""
    at = F.col("_metadata.file_block_start").alias("block")
    return spark.read.option("lineSep", ",").text(path).select("value", F.xxhash64("_metadata.file_path").alias("file"), at)


@dataclass
class _Run:
    """Pieces of one split that follow each other. Before each, and at the end: ``quotes``, and what brackets open more than they
    close, outside strings if the run begins outside a string (``depth[0]``) or within one (``depth[1]``)."""

    file: int
    block: int
    text: bytes
    at: np.ndarray
    quotes: np.ndarray
    depth: tuple[np.ndarray, np.ndarray]

    def outside(self, inside: int) -> np.ndarray:
        """Which pieces begin outside strings, if the run begins outside (0) or within one (1)."""
        return (self.quotes[:-1] + inside) % 2 == 0


def _run(values: pa.Array, file: int, block: int) -> _Run:
    whole = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values.cast(pa.binary())), b",")
    text = whole[0].as_py()
    data = np.frombuffer(text, np.uint8)
    at = np.concatenate([[0], np.cumsum(pc.binary_length(values).to_numpy(zero_copy_only=False).astype(np.int64) + 1)])
    marks = np.flatnonzero(_KINDS[data])
    kinds = _KINDS[data[marks]]
    if (kinds == _ESCAPE).any():  # what an odd number of backslashes ends before is no mark
        slashes = marks[kinds == _ESCAPE]
        ends = np.flatnonzero(np.diff(slashes, append=-1) != 1)
        odd = np.diff(ends, prepend=-1) % 2 == 1
        kept = (kinds != _ESCAPE) & ~np.isin(marks, slashes[ends[odd]] + 1)
        marks, kinds = marks[kept], kinds[kept]
    quotes = np.cumsum(kinds == _QUOTE)
    delta = (kinds == _OPEN).astype(np.int64) - (kinds == _CLOSE)
    before = np.searchsorted(marks, at)
    upto = lambda x: np.concatenate([[0], x])[before]
    return _Run(file, block, text, at, upto(quotes), (upto(np.cumsum(delta * (quotes % 2 == 0))), upto(np.cumsum(delta * (quotes % 2 == 1)))))


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[_Run]:
    for batch in batches:
        file, block = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("file", "block"))
        cuts = np.flatnonzero((np.diff(file) != 0) | (np.diff(block) != 0)) + 1
        for a, b in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
            if a < b:
                yield _run(batch.column("value").slice(a, b - a), int(file[a]), int(block[a]))


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each split, for either state at its beginning: its quotes, how much deeper it ends, and how many pieces begin outside
    strings at each depth over that of its beginning. The first piece of a file is not counted."""

    def rows(where, quotes, deltas, counts):
        out = [(*where, i, quotes, deltas[i], depth, n) for i in (0, 1) for depth, n in (counts[i] or {0: 0}).items()]
        names = [c.split()[0] for c in _SUMS.split(", ")]
        kinds = [pa.int32() if c == "inside" else pa.int64() for c in names]
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

    now = None
    for run in _runs(batches):
        if (run.file, run.block) != now:
            if now is not None:
                yield rows(now, quotes, deltas, counts)
            now, quotes, deltas, counts, first = (run.file, run.block), 0, [0, 0], (Counter(), Counter()), int(run.block == 0)
        for i in (0, 1):
            j = (i + quotes) % 2
            for depth, n in zip(*np.unique(run.depth[j][:-1][first:][run.outside(j)[first:]], return_counts=True), strict=True):
                counts[i][deltas[i] + int(depth)] += int(n)
        deltas = [deltas[i] + int(run.depth[(i + quotes) % 2][-1]) for i in (0, 1)]
        quotes, first = quotes + int(run.quotes[-1]), 0
    if now is not None:
        yield rows(now, quotes, deltas, counts)


def _parts(batches: Iterator[pa.RecordBatch], begins: dict[tuple[int, int], tuple[int, int, int, int]]) -> Iterator[pa.RecordBatch]:
    """Elements, or the parts of them that a batch has. ``begins``: of each split its number, whether it begins within a string, how
    deep, and how many elements begin before it."""
    now = None
    for run in _runs(batches):
        fresh = (run.file, run.block) != now
        if fresh:
            now, nth = (run.file, run.block), 0
            split, inside, deep, item = begins[now]
        first = fresh and run.block == 0
        depth = deep + run.depth[inside]
        start = run.outside(inside) & (depth[:-1] <= 2)
        if first:
            start[0] &= depth[0] == 0
        at = np.union1d([0], np.flatnonzero(start))
        items = item + np.cumsum(start)[at]
        ends = np.append(run.at[at[1:]], run.at[-1]) - 1
        texts = [run.text[a:b] for a, b in zip(run.at[at], ends, strict=True)]
        if not start[0] and not first:  # where a file ends there is no comma
            texts[0] = b"," + texts[0]
        whole = start[at]
        whole[-1] = False
        columns = [pa.array(items, pa.int64()), pa.array(depth[at], pa.int64(), mask=~start[at]), pa.array(np.full(len(at), split), pa.int64()), pa.array(nth + np.arange(len(at)), pa.int64()), pa.array(whole), pa.array(texts, pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in _PARTS.split(", ")])
        inside, deep, item, nth = (inside + int(run.quotes[-1])) % 2, int(depth[-1]), int(items[-1]), nth + len(at)


def _begins(spark: SparkSession, path: str) -> tuple[dict[tuple[int, int], tuple[int, int, int, int]], int]:
    """What ``_parts`` has to know of each split, and how many elements there are. A few rows a split come to the driver."""
    names = spark.read.format("binaryFile").load(path).select(F.col("_metadata.file_path").alias("name"), F.xxhash64("_metadata.file_path").alias("file"))
    place = {r["file"]: k for k, r in enumerate(sorted(names.collect(), key=lambda r: r["name"]))}
    found: dict[tuple[int, int], dict[int, list]] = {}
    for r in _pieces(spark, path).mapInArrow(_sums, _SUMS).collect():
        found.setdefault((r["file"], r["block"]), {0: [], 1: []})[r["inside"]].append(r)
    begins, inside, deep, item = {}, 0, 0, 0
    for k, where in enumerate(sorted(found, key=lambda w: (place[w[0]], w[1]))):
        begins[where] = (k, inside, deep, item)
        mine = found[where][inside]
        item += sum(r["n"] for r in mine if deep + r["depth"] <= 2) + int(where[1] == 0 and not inside and deep == 0)
        inside, deep = (inside + mine[0]["quotes"]) % 2, deep + mine[0]["delta"]
    return begins, item


def _joined(parts: DataFrame) -> DataFrame:
    """item, text of elements whose parts they are."""
    one = F.struct("split", "nth", "text")
    broken = parts.filter("not whole").groupBy("item").agg(F.array_join(F.transform(F.sort_array(F.collect_list(one)), lambda p: p["text"]), "").alias("text"))
    return parts.filter("whole").select("item", "text").unionByName(broken)


def read_document(spark: SparkSession, path: str) -> Document:
    """Fields that are missing are null. A section that comes twice counts twice."""
    ensure_importable(spark)
    begins, last = _begins(spark, path)
    parts = _pieces(spark, path).mapInArrow(lambda batches: _parts(batches, begins), _PARTS)
    parts = written(parts.withColumn("text", F.col("text").cast("string")), "parts")
    top = parts.join(F.broadcast(parts.filter("depth < 2").select("item")), "item", "left_semi")
    heads = _joined(top).select("item", F.regexp_extract("text", _KEY, 1).alias("section"), F.regexp_extract("text", _KEY, 2).alias("kind"))
    known = sorted((r["item"], r["section"], r["kind"]) for r in heads.collect())  # the keys of the document
    spans = [(a, b, s, k) for (a, s, k), b in zip(known, [*(x[0] for x in known[1:]), last + 1], strict=False)]

    def values(begin: int, end: int, kind: str) -> DataFrame:
        """text: an array's elements one by one, any other value whole."""
        items = _joined(parts.filter(F.col("item").between(begin, end - 1)))
        clean = F.when(F.col("item") == begin, F.regexp_replace("text", r'^\s*\{?\s*"(?:[^"\\]|\\.)*"\s*:\s*\[?', "")).otherwise(F.col("text"))
        if kind == "[":
            closed = F.when(F.col("item") == end - 1, F.regexp_replace(clean, r"\]\s*\}?\s*$", "")).otherwise(clean)
            return items.select(F.btrim(closed, F.lit(" \t\r\n")).alias("text")).filter("text like '{%'")
        # Objects are as small as the metadata; the last may be followed by the document's own bracket.
        return items.groupBy().agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("item", clean.alias("x")))), lambda p: p["x"]), ",").alias("text"))

    def section(name: str) -> DataFrame:
        out = spark.createDataFrame([], "text string")
        for a, b, s, k in spans:
            if s == name and k in ("[", "{"):
                out = out.unionByName(values(a, b, k))
        return out.select(F.from_json("text", SECTIONS[name]).alias("x")).filter("x is not null").select("x.*")

    return Document(*map(section, SECTIONS))


def metadata_of(entities: DataFrame, relations: DataFrame, dropped: DataFrame | None = None, raw: DataFrame | None = None) -> DataFrame:
    """One row. ``dropped``: reason, n; ``raw``: what (batches, entities, relations), n, before merging."""

    def counts(rows: DataFrame, column: str, out: str, n: Column | None = None) -> DataFrame:
        by = rows.groupBy(F.col(column).alias("k")).agg((F.count(F.lit(1)) if n is None else F.sum(n)).alias("n")).filter("k is not null")
        return by.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("k", "n")))).alias(out), F.coalesce(F.sum("n"), F.lit(0)).alias(f"_{out}"))

    out = counts(entities, "type", "entity_type_counts").crossJoin(counts(relations, "relation", "relation_type_counts"))  # one row each
    none = F.create_map().cast("map<string, bigint>")
    out = out.crossJoin(counts(dropped, "reason", "dropped_relation_reasons", F.col("n"))) if dropped is not None else out.withColumn("dropped_relation_reasons", none)
    held = counts(raw, "what", "_raw", F.col("n")).select("_raw") if raw is not None else None
    out = out.crossJoin(held) if held is not None else out.withColumn("_raw", none)
    said = lambda what: F.try_element_at("_raw", F.lit(what)).cast("long")
    columns = [said("batches").alias("raw_batch_records"), said("entities").alias("raw_entity_occurrences"), said("relations").alias("raw_relation_occurrences"), F.col("_entity_type_counts").alias("canonical_entities"), F.col("_relation_type_counts").alias("canonical_relations")]
    return out.select(*columns, "entity_type_counts", "relation_type_counts", "dropped_relation_reasons")


def write_document(papers: DataFrame, entities: DataFrame, relations: DataFrame, path: str, metadata: DataFrame | None = None) -> None:
    """Text files that are the document one after the other, an element a line: papers by source file, entities by type and
    name, relations by source, relation and target. Nothing is brought together but lines in their order."""
    metadata = metadata_of(entities, relations) if metadata is None else metadata
    plain = {"ignoreNullFields": "false"}
    line = lambda df: F.to_json(F.struct(*df.columns), plain)
    spark = papers.sparkSession

    def part(k: int, rows: DataFrame, order: list) -> DataFrame:
        ranked = ranked_whole(rows, order, "_rank")
        return ranked.select(F.lit(k).alias("k"), F.col("_rank").alias("n"), F.concat(F.when(F.col("_rank") > 1, ",").otherwise(""), line(rows)).alias("value"))

    fixed = spark.createDataFrame([(0, 0, '{"metadata": '), (1, 0, ', "papers": ['), (2, 0, '], "entities": ['), (3, 0, '], "relations": ['), (4, 0, "]}")], "k int, n long, value string")
    lines = fixed.unionByName(metadata.select(F.lit(0).alias("k"), F.lit(1).cast("long").alias("n"), line(metadata).alias("value")))
    lines = lines.unionByName(part(1, papers, ["source_file"])).unionByName(part(2, entities, ["type", F.lower("name"), "name"]))
    lines = lines.unionByName(part(3, relations, [F.lower("source"), "relation", F.lower("target"), "source_kind", "source", "target"]))
    lines.repartitionByRange("k", "n").sortWithinPartitions("k", "n").select("value").write.mode("overwrite").text(path)
