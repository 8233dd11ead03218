"""Sources and sinks: document files by an injected parser, JSON lines of chunks, profiles, graph files, tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone import schemas
from lodestone.session import ensure_importable

#: Bytes of a file -> the text of each page; None for a page that can't be read.
Parser = Callable[[bytes], list[str | None]]


def plain_text(content: bytes) -> list[str | None]:
    """Pages of a text file, parted by form feeds."""
    return list(content.decode("utf-8", "replace").split("\f"))


def page_files(spark: SparkSession, path: str, parser: Parser = plain_text, glob: str = "*.pdf") -> DataFrame:
    """Pages, numbered from 1, of all files that match; a file that can't be parsed is one row with page null.

    A folder without such files is an error.
    """
    ensure_importable(spark)
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)
    if files.isEmpty():
        raise FileNotFoundError(f"{path} has no {glob}")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for source, content in zip(batch["path"], batch["content"], strict=True):
                name = source.rsplit("/", 1)[-1]
                try:
                    pages = parser(bytes(content))
                except Exception as e:  # noqa: BLE001  what a parser may raise is its own
                    rows.append((name, None, None, None, str(e)[:500]))
                    continue
                for k, text in enumerate(pages, 1):
                    clean = "".join("�" if 0xD800 <= ord(c) <= 0xDFFF else c for c in text or "")
                    rows.append((name, k, clean.strip(), clean.count("�"), None))
            yield pd.DataFrame(rows, columns=["source_file", "page", "text", "n_invalid", "failure"]).astype({"page": "Int32", "n_invalid": "Int32"})

    return files.select("path", "content").mapInPandas(run, "source_file string, page int, text string, n_invalid int, failure string")


def summary(pages: DataFrame) -> DataFrame:
    """Totals of an extraction: papers read and failed, pages, those with text, characters, replaced characters."""
    good = F.col("failure").isNull()
    t = F.coalesce("text", F.lit(""))
    return pages.agg(
        F.countDistinct(F.when(good, F.col("source_file"))).alias("n_papers"), F.countDistinct(F.when(~good, F.col("source_file"))).alias("n_failed"), F.count("page").alias("n_pages"),
        F.count_if(t != "").alias("n_filled"), F.coalesce(F.sum(F.length(t)), F.lit(0)).alias("n_chars"), F.coalesce(F.sum("n_invalid"), F.lit(0)).alias("n_invalid"),
    )


def write_chunks(chunks: DataFrame, path: str) -> None:
    chunks.select(*schemas.CHUNK_COLUMNS).write.mode("overwrite").json(path)


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """Blank lines and lines that are no JSON are skipped."""
    return spark.read.schema(schemas.CHUNKS).option("mode", "DROPMALFORMED").json(path)


def read_raw(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.RAW).option("mode", "DROPMALFORMED").json(path)


def read_profiles(spark: SparkSession, path: str) -> DataFrame:
    """source_file, focal_entities of a profile file: one JSON object by source file, or several."""
    lines = spark.read.text(path, wholetext=True).select(F.explode(F.split("value", r"\n(?=\{)")).alias("value"))
    whole = lines.select(F.from_json("value", schemas.PROFILES).alias("m"))
    return whole.select(F.explode("m").alias("source_file", "p")).select("source_file", "p.focal_entities")


def write_profiles(profiles: DataFrame, path: str) -> None:
    """``profiles``: source_file, focal_entities. JSON lines of one object by source file, as ``read_profiles`` reads."""
    one = F.create_map("source_file", F.struct("focal_entities"))
    profiles.select(F.to_json(one).alias("value")).write.mode("overwrite").text(path)


def write_graph(entities: DataFrame, relations: DataFrame, path: str, dropped: DataFrame | None = None, raw: DataFrame | None = None) -> None:
    """Entities and relations as JSON lines, and what became of them: counts by type, of ``dropped`` (reason, n) by
    reason, and of ``raw`` (what, n), the occurrences before they were merged."""
    entities.write.mode("overwrite").json(f"{path}/entities")
    relations.write.mode("overwrite").json(f"{path}/relations")
    graph_stats(entities, relations, dropped, raw).write.mode("overwrite").json(f"{path}/stats")


def graph_stats(entities: DataFrame, relations: DataFrame, dropped: DataFrame | None = None, raw: DataFrame | None = None) -> DataFrame:
    """what, type, count."""
    n = F.count(F.lit(1)).alias("count")
    out = entities.groupBy(F.lit("entity").alias("what"), "type").agg(n).unionByName(relations.groupBy(F.lit("relation").alias("what"), F.col("relation").alias("type")).agg(n))
    if dropped is not None:
        out = out.unionByName(dropped.select(F.lit("dropped").alias("what"), F.col("reason").alias("type"), F.col("n").alias("count")))
    if raw is not None:
        out = out.unionByName(raw.select(F.lit("raw").alias("what"), F.col("what").alias("type"), F.col("n").alias("count")))
    return out


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Entities, relations and counts as ``write_graph`` wrote them; fields that are missing are null."""
    kinds = (schemas.CANONICAL_ENTITY, schemas.CANONICAL_RELATION, "what STRING, type STRING, count BIGINT")
    return tuple(spark.read.schema(kind).json(f"{path}/{name}") for kind, name in zip(kinds, ("entities", "relations", "stats"), strict=True))


def write_experiment(batches: DataFrame, path: str) -> None:
    """Extraction records of a trial: the folder is written anew, and a batch whose extraction failed is a record with
    no entities and no relations, unlike in ``streaming.ingest``."""
    empty = lambda c, kind: F.coalesce(c, F.array().cast(f"array<{kind}>")).alias(c)
    batches.select("batch_number", "source_file", "chunk_ids", empty("entities", schemas.ENTITY), empty("relations", schemas.RELATION)).write.mode("overwrite").json(path)


def preview(pages: DataFrame, source_file: str, n: int = 2000) -> DataFrame:
    """The beginning of one file's text, pages in order."""
    mine = pages.filter(F.col("source_file") == source_file).orderBy("page").limit(n)  # no more pages than characters count
    whole = mine.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("page", F.substring(F.coalesce("text", F.lit("")), 1, n).alias("t")))), lambda p: p["t"]), "\n").alias("text"))
    return whole.select(F.lit(source_file).alias("source_file"), F.substring("text", 1, n).alias("preview"))


def table_state(spark: SparkSession, path: str) -> DataFrame:
    """Whether a table is there and how many rows it has."""
    try:
        n = spark.read.parquet(path).count()
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([(path, False, 0)], "path string, present boolean, n long")
    return spark.createDataFrame([(path, True, n)], "path string, present boolean, n long")
