"""Tables that are merged into, by key: a change rewrites the buckets its keys are in, and no others.

Rows are dealt to buckets by a hash of the key; a manifest says where each bucket of a version is. Readers see whole
versions; the one before the current stays for readers that have begun. Of equal keys the row that comes last in a stated
order stays, so the result does not depend on how rows are partitioned.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable
from functools import cache
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lodestone.functions import text as X
from lodestone.operators import chunking, kg_store
from lodestone.session import file_system, shared_dir
from lodestone.sources.manifest import Content, Manifest

SEMANTIC = ("nodes", "edges", "support", "introduces")
BUCKETS = 64
_BUCKET = "_bucket"


class Store:
    """Tables under ``base``. ``buckets`` holds for tables that are made from now on; a table keeps its own."""

    def __init__(self, spark: SparkSession, base: str, buckets: int = BUCKETS):
        self.spark, self.base, self.buckets = spark, base.rstrip("/"), buckets

    def _of(self, name: str) -> Manifest:
        return Manifest(self.spark, f"{self.base}/{name}")

    def versions(self, name: str) -> list[int]:
        return self._of(name).versions()

    def parts(self, name: str) -> dict[int, str]:
        """Where each bucket of a table is."""
        return {int(k): v for k, v in self._of(name).current()[1].get("at", {}).items()}

    def read(self, name: str) -> DataFrame | None:
        manifest = self._of(name)
        version, content = manifest.current()
        return self._rows(manifest, content, content["at"]) if version else None

    def _rows(self, manifest: Manifest, content: Content, buckets) -> DataFrame:
        schema = StructType.fromJson(json.loads(content["schema"]))
        paths = [manifest.path(content["at"][b]) for b in buckets if b in content["at"]]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    @staticmethod
    def _bucket(by: list[str], n: int) -> Column:
        return F.pmod(F.xxhash64(*[F.col(c).cast("string") for c in by]), F.lit(n)).cast("int")

    def _put(self, manifest: Manifest, rows: DataFrame, by: list[str], n: int) -> dict[str, str]:
        """Writes rows by bucket to a new folder; where each of these buckets is then. A large bucket is several files."""
        folder = manifest.folder()
        rows.withColumn(_BUCKET, self._bucket(by, n)).hint("rebalance", F.col(_BUCKET)).write.partitionBy(_BUCKET).parquet(manifest.path(folder))
        at, system = file_system(self.spark, manifest.path(folder))
        names = [x.getPath().getName() for x in system.listStatus(at)]
        return {x.split("=")[1]: f"{folder}/{x}" for x in names if x.startswith(f"{_BUCKET}=")}

    def write(self, name: str, rows: DataFrame, by: list[str] | None = None) -> DataFrame:
        """All rows anew, dealt out by ``by`` (all columns)."""
        manifest = self._of(name)
        by = by or rows.columns
        at = self._put(manifest, rows, by, self.buckets)
        manifest.change(lambda _: {"schema": rows.schema.json(), "by": by, "n": self.buckets, "at": at})
        return self.read(name)

    def _merge(self, name: str, rows: DataFrame, by: list[str], values: DataFrame, out_of: list[str]) -> DataFrame:
        """Stored rows whose ``out_of`` is among ``values`` go, and ``rows`` come. Both are written first, by bucket, which
        also tells the buckets that they touch."""
        manifest = self._of(name)
        version, held = manifest.current()
        if version and not set(held["by"]) <= set(out_of):  # dealt out by other columns: everything is touched
            stays = chunking.pending(self.read(name), values, out_of)
            return self.write(name, stays.unionByName(rows, allowMissingColumns=True), by)
        by, n = (held["by"], held["n"]) if version else (by, self.buckets)
        new, gone = manifest.folder(), manifest.folder()
        rows.write.parquet(manifest.path(new))
        values.select(*out_of).distinct().withColumn(_BUCKET, self._bucket(by, n)).write.parquet(manifest.path(gone))
        rows, values = self.spark.read.schema(rows.schema).parquet(manifest.path(new)), self.spark.read.parquet(manifest.path(gone))
        touched = sorted(str(r[0]) for r in values.select(_BUCKET).unionByName(rows.select(self._bucket(by, n).alias(_BUCKET))).distinct().collect())  # n at most

        def change(content: Content) -> Content:
            if not content:
                return {"schema": rows.schema.json(), "by": by, "n": n, "at": self._put(manifest, rows, by, n)}
            stays = chunking.pending(self._rows(manifest, content, touched), values, out_of)
            merged = stays.unionByName(rows, allowMissingColumns=True)
            rest = {k: v for k, v in content["at"].items() if k not in touched}
            return content | {"schema": merged.schema.json(), "at": rest | self._put(manifest, merged, by, n)}

        try:
            if touched:
                manifest.change(change)
        finally:
            for folder in (new, gone):
                path, system = file_system(self.spark, manifest.path(folder))
                system.delete(path, True)
        return self.read(name)

    def upsert(self, name: str, rows: DataFrame, keys: list[str], order: list[str] | None = None) -> DataFrame:
        """Rows replace stored rows of their key; of several, the last in ``order``, and of those that tie, the one with the
        largest content. Columns of ``order`` are stored too. New columns are null in older rows."""
        fresh = chunking.latest(rows, keys, [*(order or []), *[c for c in rows.columns if c not in keys and c not in (order or [])]])
        return self._merge(name, fresh, keys, fresh, keys)

    def replace(self, name: str, rows: DataFrame, column: str, values: DataFrame | None = None) -> DataFrame:
        """Rows take the place of all stored rows with their ``column`` (or one of ``values``)."""
        return self._merge(name, rows, [column], rows if values is None else values, [column])

    def drop(self, *names: str) -> None:
        for name in names:
            self._of(name).drop()

    def state(self, name: str) -> DataFrame:
        """Whether a table is there, its version and its rows."""
        known = self.versions(name)
        return self.spark.createDataFrame([(name, bool(known), (known or [0])[-1], self.read(name).count() if known else 0)], "name string, present boolean, version int, n long")


@cache
def code_version() -> str:
    """A hash of this package's modules: what they built is not taken for what they build after a change."""
    root = Path(__file__).resolve().parent.parent
    files = sorted(p for p in root.rglob("*.py") if "llm" not in p.relative_to(root).parts)
    return hashlib.sha256(b"".join(p.relative_to(root).as_posix().encode() + p.read_bytes() for p in files)).hexdigest()[:16]


def kept(spark: SparkSession, name: str, inputs: list[str], build: Callable[[], DataFrame], states: int = 2) -> DataFrame:
    """A table that is built once for each state of its input files (their paths, lengths and times) and of the code, in the
    shared folder, and read from there by all who ask for it after.

    It is written aside and then renamed, so of two drivers that build it one wins and neither sees a part. Of older states of
    the same inputs the last stays, for those who still read it; the rest goes when a new one is built.
    """
    seen = []
    for path in inputs:
        at, system = file_system(spark, path)
        for x in [at] if system.getFileStatus(at).isFile() else [y.getPath() for y in system.listStatus(at)]:
            status = system.getFileStatus(x)
            seen.append((x.toString(), status.getLen(), status.getModificationTime()))
    digest = lambda x: hashlib.sha256(repr(x).encode()).hexdigest()[:16]
    whose = f"{name}-{digest(sorted(inputs))}"
    base = f"{shared_dir(spark).rstrip('/')}/kept"
    path = f"{base}/{whose}-{digest((sorted(seen), code_version()))}"
    at, system = file_system(spark, path)
    if not system.exists(at):
        aside, _ = file_system(spark, f"{base}/.{uuid.uuid4().hex}")
        try:
            build().write.parquet(aside.toString())
            if system.exists(at) or not system.rename(aside, at):
                if not system.exists(at):
                    raise RuntimeError(f"{path} can't be written")
        finally:
            system.delete(aside, True)
        older = sorted((x for x in system.listStatus(at.getParent()) if x.getPath().getName().startswith(f"{whose}-")), key=lambda x: x.getModificationTime())
        for x in older[:-states]:
            if x.getPath().getName() != at.getName():
                system.delete(x.getPath(), True)
    return spark.read.parquet(path)


def put_chunks(store: Store, chunks: DataFrame) -> None:
    """Papers are merged; the chunks of these papers replace those that were stored, and so does their provenance."""
    store.upsert("papers", chunks.select("paper_id", "source_file").distinct(), ["paper_id"])
    gone = store.read("chunks")
    store.replace("chunks", chunks, "paper_id")
    support = store.read("support")
    if gone is not None and support is not None:
        lost = gone.join(chunks.select("paper_id").distinct(), "paper_id", "left_semi").select("chunk_id")
        store.write("support", support.join(lost, "chunk_id", "left_anti"))


def reset_graph(store: Store) -> None:
    """Removes the semantic layer; papers and chunks stay."""
    store.drop(*SEMANTIC)


def put_graph(store: Store, entities: DataFrame, relations: DataFrame, profiles: DataFrame) -> None:
    """Merges a canonical graph into the store. ``entities``: name, type, aliases, evidence, source_files; ``relations``:
    source_kind, source, relation, target, evidence, source_files; ``profiles``: source_file, focal.

    Endpoints are looked up by name or alias, the last in order of (type, name) winning; what stands for nothing is
    dropped. Support and INTRODUCES need stored chunks and papers. Of entities with one key, and of relations with the same
    ends, the last in load order stays: by ``seq`` if there is such a column, else in order of name, or of source, relation
    and target.
    """
    nodes = kg_store.nodes(entities)
    chunk_of = lambda e: F.array_distinct(F.filter(F.transform(e, lambda x: x["chunk_id"]), lambda c: c.isNotNull()))
    page_of = lambda e: F.array_distinct(F.filter(F.transform(e, lambda x: x["page"]), lambda p: p.isNotNull()))
    proof = [chunk_of(F.col("evidence")).alias("evidence_chunk_ids"), page_of(F.col("evidence")).alias("evidence_pages")]
    order = ["seq"] if "seq" in entities.columns else []
    nodes = store.upsert("nodes", nodes.select("key", "name", "entity_type", "aliases", "source_files", "evidence", *proof, *order), ["key"], order)
    lookup = kg_store.load_lookup(nodes.withColumn("seq", F.struct("entity_type", F.lower("name"), "name")))
    if (chunks := store.read("chunks")) is not None:
        store.upsert("support", kg_store.support(nodes, chunks), ["entity_key", "chunk_id"])
    own, papers = kg_store.loadable(relations, lookup)
    columns = ["relation", "target_key", "source_files", *proof, F.size(chunk_of(F.col("evidence"))).cast("long").alias("evidence_count")]
    store.upsert("edges", own.select("source_key", *columns), ["source_key", "relation", "target_key"])
    known = store.read("papers")
    if known is not None:
        stated = papers.join(known.select(F.col("source_file").alias("source")), "source", "left_semi").select(F.col("source").alias("source_file"), *columns[1:])
        repaired = kg_store.introductions_of(profiles, lookup, known, nodes)
        both = stated.join(repaired, ["source_file", "target_key"], "full").withColumn("generated_from_profile", F.coalesce("generated_from_profile", F.lit(False)))
        store.upsert("introduces", both, ["source_file", "target_key"])


def toy_graph(spark: SparkSession) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A small graph to try things on: nodes, edges and chunks."""
    rows = [("Paper", "P1"), ("Method", "Alpha Fit"), ("Method", "Beta Splat"), ("Task", "Shape Recovery")]
    nodes = kg_store.nodes(spark.createDataFrame(rows, "type string, name string")).withColumn("aliases", F.array().cast("array<string>"))
    ends = [("Paper", "P1", "USES", "Method", "Alpha Fit"), ("Paper", "P1", "USES", "Method", "Beta Splat"), ("Paper", "P1", "ADDRESSES", "Task", "Shape Recovery")]
    edges = spark.createDataFrame(ends, "source_type string, source string, relation string, target_type string, target string")
    edges = edges.withColumn("source_key", X.entity_key(F.col("source_type"), F.col("source"))).withColumn("target_key", X.entity_key(F.col("target_type"), F.col("target")))
    texts = ["P1 recovers shapes from one picture.", "P1 starts from Alpha Fit.", "Beta Splat draws the result.", "Nothing else is known."]
    return nodes, edges, spark.createDataFrame([(f"chunk_{i}", t) for i, t in enumerate(texts, 1)], "chunk_id string, text string")
