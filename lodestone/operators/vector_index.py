"""A stored index of vectors that grows: postings of ids by bucket, each vector once, appended parts, tombstones, compaction.

Random planes give a vector some bits in each of several tables, and so a bucket. A search looks into the buckets that its
own vector is nearest to being in, several in each table, then compares whole vectors. How many, is found when the index is
made: the least number that reaches the wanted recall on a bounded sample, whose neighbours are further apart than those
among all vectors.

Vectors that are null, of another length than the first, or not finite are not indexed. An id that is appended again
replaces its vector; of an id that comes twice in one append the row with the largest content stays.
"""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lodestone.operators.chunking import latest
from lodestone.operators.vectors import TOP_K, top_k
from lodestone.session import ensure_importable, file_system
from lodestone.sources.manifest import Content, Manifest

SAMPLE, ASKED = 4096, 128  # rows and queries that the number of probes is found on
PARTS = 16  # before they are merged
_SEQ, _AT = "_seq", "_at"


def planes(tables: int, bits: int, width: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((tables, bits, width))


def margins(x: np.ndarray, p: np.ndarray) -> np.ndarray:
    """How far each row is from each plane, on which side: rows, tables, bits."""
    return (x @ p.reshape(-1, p.shape[2]).T).reshape(len(x), *p.shape[:2])


def buckets(m: np.ndarray) -> np.ndarray:
    """Rows, tables."""
    return ((m > 0) << np.arange(m.shape[2])).sum(axis=2)


def nearest_buckets(m: np.ndarray) -> np.ndarray:
    """For one row's margins (tables, bits): all buckets of each table, those first that are reached over the least
    distance, as a sum of squares of the planes between."""
    bits = m.shape[1]
    flips = (np.arange(1 << bits)[:, None] >> np.arange(bits) & 1).astype(np.float64)
    order = np.argsort(flips @ (m**2).T, axis=0, kind="stable").T
    return buckets(m[None])[0][:, None] ^ order


def probes_for(x: np.ndarray, p: np.ndarray, recall: float, k: int) -> int:
    """The least number of buckets a table with which the ``k`` nearest of ``x`` are met, for that share of them."""
    asked = x[: min(ASKED, len(x))]
    if len(x) < 2:
        return 1
    like = asked @ x.T
    like[np.arange(len(asked)), np.arange(len(asked))] = -np.inf
    near = np.argsort(-like, axis=1, kind="stable")[:, : min(k, len(x) - 1)]
    m, at = margins(asked, p), buckets(margins(x, p))
    needed = []
    for i, mine in enumerate(near):
        place = np.argsort(nearest_buckets(m[i]), axis=1)  # of each bucket
        needed += np.take_along_axis(place, at[mine].T, axis=1).min(axis=0).tolist()
    return 1 + int(np.quantile(needed, recall, method="higher"))


class Index:
    """An index at a path. It is absent, building (a build has begun and not ended, or failed) or online."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.manifest = spark, path.rstrip("/"), Manifest(spark, path)

    def state(self) -> str:
        if self.manifest.versions():
            return "online"
        path, system = file_system(self.spark, self.path)
        return "building" if system.exists(path) else "absent"

    def settings(self) -> Content:
        version, content = self.manifest.current()
        if not version:
            raise ValueError(f"the index is {self.state()}")
        return content

    def create(self, vectors: DataFrame, id_col: str, vector: str = "embedding", tables: int = 8, bits: int | None = None, probes: int | None = None, recall: float = 0.95, k: int = TOP_K, seed: int = 1) -> None:
        """``recall`` is wanted on the sample, for the ``k`` nearest. Buckets hold some hundred rows by default."""
        self.drop()
        folder, system = file_system(self.spark, f"{self.path}/data")
        system.mkdirs(folder)
        good = vectors.filter(F.col(vector).isNotNull() & (F.size(vector) > 0))
        first = good.select(F.size(vector).alias("n")).head()
        width = first["n"] if first else 1
        some = good.filter(_fine(F.col(vector), width)).select(F.col(vector).cast("array<double>").alias("x")).orderBy(F.xxhash64(F.col(id_col).cast("string"))).limit(SAMPLE)
        if bits is None:
            bits = int(np.clip(np.ceil(np.log2(max(good.count(), 1) / 256)), 3, 12))
        p = planes(tables, bits, width, seed)
        if probes is None:
            x = np.array([r["x"] for r in some.collect()], np.float64).reshape(-1, width)  # SAMPLE rows at most
            x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
            probes = probes_for(x, p, recall, k)
        content = {"id": id_col, "vector": vector, "width": width, "tables": tables, "bits": bits, "seed": seed, "probes": probes, "schema": good.schema.json(), "parts": [], "seq": 0}
        self.manifest.commit(0, self._with(content, good))

    def _schema(self, content: Content) -> StructType:
        return StructType.fromJson(json.loads(content["schema"]))

    def _postings(self, rows: DataFrame, content: Content) -> DataFrame:
        """id, _seq, _at: the table and bucket as one number, for each table."""
        ensure_importable(self.spark)
        p, bits = planes(content["tables"], content["bits"], content["width"], content["seed"]), content["bits"]

        @F.pandas_udf("array<int>")
        def places(v: pd.Series) -> pd.Series:
            at = buckets(margins(np.stack(v.to_numpy()).astype(np.float64), p)) if len(v) else np.zeros((0, len(p)), np.int64)
            return pd.Series(list((at | np.arange(len(p)) << bits).astype(np.int32)))

        return rows.select(content["id"], _SEQ, F.explode(places(F.col(content["vector"]).cast("array<double>"))).alias(_AT))

    def _write(self, rows: DataFrame, content: Content) -> dict[str, str]:
        """Vectors once, in order of ids, and postings in order of buckets."""
        part = {"vectors": self.manifest.folder(), "postings": self.manifest.folder()}
        at = self.manifest.path(part["vectors"])
        rows.repartitionByRange(content["id"]).sortWithinPartitions(content["id"]).write.parquet(at)
        held = self.spark.read.schema(rows.schema).parquet(at)
        self._postings(held, content).repartitionByRange(_AT).sortWithinPartitions(_AT).write.parquet(self.manifest.path(part["postings"]))
        return part

    def _read(self, content: Content, what: str) -> DataFrame | None:
        paths = [self.manifest.path(p[what]) for p in content["parts"] if what in p]
        whole, id_col = self._schema(content), content["id"]
        kind = whole.add(_SEQ, "long") if what == "vectors" else StructType([whole[id_col]]).add(_SEQ, "long")
        return self.spark.read.schema(kind.add(_AT, "integer") if what == "postings" else kind).parquet(*paths) if paths else None

    def _with(self, content: Content, vectors: DataFrame) -> Content:
        seq, id_col = content["seq"] + 1, content["id"]
        rows = vectors.filter(_fine(F.col(content["vector"]), content["width"]) & F.col(id_col).isNotNull()).select(*self._schema(content).names)
        rows = latest(rows, [id_col], [c for c in rows.columns if c != id_col]).withColumn(_SEQ, F.lit(seq).cast("long"))
        part = self._write(rows, content)
        known = self._read(content, "vectors")
        if known is not None:
            mine = self._read(content | {"parts": [part]}, "vectors").select(id_col)
            self._bury(known.join(mine, id_col, "left_semi").select(id_col).distinct(), part, seq)
        return content | {"parts": [*content["parts"], part], "seq": seq}

    def _bury(self, ids: DataFrame, part: dict[str, str], seq: int) -> None:
        """Entries of these ids that are older than ``seq`` are dead."""
        part["gone"] = self.manifest.folder()
        ids.withColumn(_SEQ, F.lit(seq).cast("long")).write.parquet(self.manifest.path(part["gone"]))

    def append(self, vectors: DataFrame) -> None:
        """Adds vectors, in a part of their own; those of known ids take their place."""
        self.manifest.change(lambda content: self._with(content, vectors))
        if len(self.settings()["parts"]) >= PARTS:
            self.compact()

    def delete(self, ids: DataFrame) -> None:
        def change(content: Content) -> Content:
            part: dict[str, str] = {}
            self._bury(ids.select(content["id"]).filter(F.col(content["id"]).isNotNull()).distinct(), part, content["seq"] + 1)
            return content | {"parts": [*content["parts"], part], "seq": content["seq"] + 1}

        self.manifest.change(change)

    def _live(self, rows: DataFrame, content: Content) -> DataFrame:
        gone = self._read(content, "gone")
        if gone is None:
            return rows
        last = gone.groupBy(content["id"]).agg(F.max(_SEQ).alias("_gone"))
        return rows.join(last, content["id"], "left").filter(f"coalesce(_gone, 0) <= {_SEQ}").drop("_gone")

    def rows(self) -> DataFrame:
        """The vectors that are there, as they were given."""
        content = self.settings()
        return self._live(self._read(content, "vectors"), content).drop(_SEQ)

    def compact(self) -> None:
        """One part of what is there; the dead go."""

        def change(content: Content) -> Content:
            return content | {"parts": [self._write(self._live(self._read(content, "vectors"), content), content)]}

        self.settings()
        self.manifest.change(change)

    def search(self, query: list[float], id_col: str | None = None, k: int = TOP_K, probes: int | None = None) -> DataFrame:
        """As ``top_k``, over the vectors in the buckets that the query is nearest to."""
        content = self.settings()
        m = margins(np.asarray(query, np.float64)[None], planes(content["tables"], content["bits"], content["width"], content["seed"]))[0]
        near = nearest_buckets(m)[:, : probes or content["probes"]]
        at = sorted((near | np.arange(len(near))[:, None] << content["bits"]).ravel().tolist())
        places = self._read(content, "postings").filter(F.col(_AT).isin(at))  # files are in this order, so few are read
        met = self._live(places.select(content["id"], _SEQ).distinct(), content)
        found = self._read(content, "vectors").join(met, [content["id"], _SEQ], "left_semi").drop(_SEQ)
        return top_k(found, query, content["id"], k, content["vector"])

    def drop(self) -> None:
        self.manifest.drop()


def _fine(vector: Column, width: int) -> Column:
    finite = F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) != float("inf")), F.lit(False)))
    return F.coalesce((F.size(vector) == width) & finite, F.lit(False))
