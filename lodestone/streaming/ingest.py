"""Incremental ingestion: new chunk files become batches that are extracted, and stay open until that succeeds.

A journal keeps what was extracted and a ledger of attempts. What one micro-batch adds to either becomes visible by one
commit, so rows and ledger agree at any time, and a micro-batch that is run again adds nothing twice.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from lodestone import schemas
from lodestone.operators.chunking import latest, pending
from lodestone.session import file_system
from lodestone.sources.manifest import Content, Manifest

DONE, OPEN, FAILED = "done", "open", "failed"
PARTS = 16  # of one level, before they become one of the next


def chunk_stream(spark: SparkSession, path: str, files_per_trigger: int = 1000) -> DataFrame:
    return spark.readStream.schema(schemas.CHUNKS).option("maxFilesPerTrigger", files_per_trigger).json(path)


class Journal:
    """What was extracted, and a ledger: for each key whether it is done, open (no attempt has succeeded yet) or failed
    (given up), the number of attempts, and seq, the version that says so.

    Parts are appended; sixteen of a level are merged into one of the next, the ledger by key, so their number grows with
    the logarithm of the micro-batches and a row is rewritten as often.
    """

    def __init__(self, spark: SparkSession, path: str, keys: tuple[str, ...] = ("chunk_id",)):
        self.spark, self.keys, self.manifest = spark, list(keys), Manifest(spark, path)

    def _read(self, content: Content, what: str, parts: list[dict] | None = None) -> DataFrame | None:
        held = [self.manifest.path(p[what]) for p in (content.get("parts", []) if parts is None else parts)]
        return self.spark.read.schema(StructType.fromJson(json.loads(content[f"{what}_schema"]))).parquet(*held) if held else None

    def rows(self) -> DataFrame | None:
        """What was extracted of keys that are done; None before the first commit."""
        return self._read(self.manifest.current()[1], "rows")

    def ledger(self) -> DataFrame | None:
        """The keys, state, attempts, seq."""
        return self._latest(self.manifest.current()[1])

    def _latest(self, content: Content, parts: list[dict] | None = None) -> DataFrame | None:
        held = self._read(content, "ledger", parts)
        return held if held is None else latest(held, self.keys, ["seq"])

    def open(self) -> DataFrame | None:
        """The chunks whose keys are open, as they came."""
        content = self.manifest.current()[1]
        held = self._read(content, "open")
        if held is None:
            return None
        still = self._latest(content).filter(F.col("state") == OPEN).select(*self.keys, F.col("seq").alias("_seq"))
        return held.join(still, [*self.keys, "_seq"], "left_semi").drop("_seq")

    def _kept(self, rows: DataFrame, folder: str) -> DataFrame:
        rows.write.parquet(self.manifest.path(folder))
        return self.spark.read.schema(rows.schema).parquet(self.manifest.path(folder))

    def attempt(self, chunks: DataFrame, extract: Callable[[DataFrame], DataFrame], failed: Column | None = None, give_up: int | None = None, stream: tuple[str, int] | None = None) -> None:
        """Extracts from the chunks whose keys are not done, once, and commits what came of it.

        A key is done where ``extract`` gave rows for it none of which ``failed`` (by default, whose record is null, if
        there is such a column); else it stays open, or is failed for good after ``give_up`` attempts. ``stream`` names a
        micro-batch; one that was committed before is left out.
        """
        keys, m = self.keys, self.manifest
        content = m.current()[1]
        if stream and content.get("streams", {}).get(stream[0], -1) >= stream[1]:
            return
        known = self._latest(content)
        fresh = chunks if known is None else pending(chunks, known.filter(F.col("state") != OPEN), keys)
        once = [*keys, *(["chunk_id"] if "chunk_id" in chunks.columns and "chunk_id" not in keys else [])]
        taken, made = m.folder(), m.folder()
        fresh = self._kept(fresh.dropDuplicates(once), taken)
        if fresh.isEmpty():
            self._forget(taken)
            return
        found = self._kept(extract(fresh), made)  # models are asked once
        bad = failed if failed is not None else F.col("record").isNull() if "record" in found.columns else F.lit(False)
        good = found.groupBy(*keys).agg(F.max(bad.cast("int")).alias("_bad")).filter("_bad = 0").select(*keys)
        tried = fresh.select(*keys).distinct().join(good.withColumn("_ok", F.lit(True)), keys, "left")

        def change(content: Content) -> Content | None:
            if stream and content.get("streams", {}).get(stream[0], -1) >= stream[1]:
                return None
            seq, before = m.current()[0] + 1, self._latest(content)
            mine = tried if before is None else tried.join(before.select(*keys, F.col("state").alias("_was"), F.col("attempts").alias("_before")), keys, "left").filter(f"coalesce(_was, '{OPEN}') = '{OPEN}'")
            n = (F.lit(0) if before is None else F.coalesce("_before", F.lit(0))) + 1
            lost = F.when(n >= give_up, FAILED).otherwise(OPEN) if give_up else F.lit(OPEN)
            part = {"level": 0, "rows": m.folder(), "ledger": m.folder(), "open": m.folder()}
            said = self._kept(mine.select(*keys, F.when(F.col("_ok"), DONE).otherwise(lost).alias("state"), n.cast("int").alias("attempts"), F.lit(seq).cast("long").alias("seq")), part["ledger"])
            rows = found.join(said.filter(F.col("state") == DONE).select(*keys), keys, "left_semi")
            left = fresh.withColumn("_seq", F.lit(seq).cast("long")).join(said.filter(F.col("state") == OPEN).select(*keys), keys, "left_semi")
            self._kept(rows, part["rows"])
            self._kept(left, part["open"])
            new = {f"{k}_schema": df.schema.json() for k, df in (("rows", rows), ("ledger", said), ("open", left))}
            streams = content.get("streams", {}) | ({stream[0]: stream[1]} if stream else {})
            return {**content, **new, "parts": [*content.get("parts", []), part], "streams": streams}

        try:
            m.change(change)
        finally:
            self._forget(taken, made)
        self.compact()

    def _forget(self, *folders: str) -> None:
        for folder in folders:
            path, system = file_system(self.spark, self.manifest.path(folder))
            system.delete(path, True)

    def compact(self, most: int = PARTS) -> None:
        """Merges the parts of a level where there are ``most`` of them."""

        def change(content: Content) -> Content | None:
            parts = content.get("parts", [])
            levels = [p["level"] for p in parts]
            level = next((x for x in sorted(set(levels)) if levels.count(x) >= most), None)
            if level is None:
                return None
            old = [p for p in parts if p["level"] == level]
            part = {"level": level + 1, "rows": self.manifest.folder(), "ledger": self.manifest.folder(), "open": self.manifest.folder()}
            self._kept(self._read(content, "rows", old), part["rows"])
            self._kept(self._latest(content, old), part["ledger"])
            still = self._latest(content).filter(F.col("state") == OPEN).select(*self.keys, F.col("seq").alias("_seq"))
            self._kept(self._read(content, "open", old).join(still, [*self.keys, "_seq"], "left_semi"), part["open"])
            return content | {"parts": [*(p for p in parts if p["level"] != level), part]}

        before = None
        while (now := self.manifest.change(change)) != before:
            before = now


def ingest(chunks: DataFrame, extract: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, keys: tuple[str, ...] = ("chunk_id",), failed: Column | None = None, give_up: int | None = None) -> StreamingQuery:
    """Runs ``extract`` over the chunks whose keys, such as (source_file, batch_number), are not done yet, and journals what
    came of it in ``out``.

    Chunks that earlier runs left open are tried first, then the new files. See ``Journal.attempt`` for what is done.
    """
    spark, tag = chunks.sparkSession, f"{zlib.crc32(checkpoint.encode()):08x}"
    journal = Journal(spark, out, keys)
    again = journal.open()
    if again is not None and not again.isEmpty():
        journal.attempt(again, extract, failed, give_up)

    def each(batch: DataFrame, number: int) -> None:
        Journal(batch.sparkSession, out, keys).attempt(batch, extract, failed, give_up, (tag, number))

    return chunks.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_windows(events: DataFrame, length: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts and sums of events by window and type; rows later than ``late`` are left out. An extra, for ``events``."""
    held = events.withWatermark("ts", late) if events.isStreaming else events
    return held.groupBy(F.window("ts", length).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")
