"""Extracted page texts: the text file format with a header and page banners, read and written as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import text as X

_BAR = "=" * 20


def rendered(pages: DataFrame) -> DataFrame:
    """``pages``: source_file, page, text. One page of the file format a row: path, value."""
    header = F.concat(F.lit("SOURCE_FILE: "), "source_file", F.lit(f"\n\n{_BAR} PAGE "), F.col("page").cast("string"), F.lit(f" {_BAR}\n\n"), F.coalesce("text", F.lit("")))
    return pages.select(F.concat("source_file", F.lit("_extracted.txt")).alias("path"), header.alias("value"))


def write(pages: DataFrame, path: str) -> None:
    """One text file a paper, as a partition each: header lines with totals, then the pages in order."""
    body = F.concat(F.lit(f"\n\n{_BAR} PAGE "), F.col("page").cast("string"), F.lit(f" {_BAR}\n\n"), F.coalesce("text", F.lit("")))
    filled = F.coalesce("text", F.lit("")) != ""
    n_invalid = F.coalesce(F.col("n_invalid"), F.lit(0)) if "n_invalid" in pages.columns else F.lit(0)
    whole = pages.groupBy("source_file").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(filled).alias("f"), F.sum(F.length(F.coalesce("text", F.lit("")))).alias("c"), F.sum(n_invalid).alias("i"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("page", body.alias("b")))), lambda x: x["b"]), "").alias("body"),
    )
    lines = F.concat_ws("\n", *[F.concat(F.lit(f"{k}: "), F.col(c).cast("string")) for k, c in (("SOURCE_FILE", "source_file"), ("TOTAL_PAGES", "n"), ("NON_EMPTY_PAGES", "f"), ("TOTAL_CHARACTERS", "c"), ("INVALID_UNICODE_REPLACED", "i"))])
    whole.select("source_file", F.concat(lines, "body").alias("value")).write.mode("overwrite").partitionBy("source_file").text(path)


def parsed(files: DataFrame, pattern: str = X.UNICODE_SPACE) -> DataFrame:
    """``files``: path, value. source_file, page, text; the source file is the path's stem where the header has none."""
    name = F.regexp_extract("value", r"(?m)^SOURCE_FILE:[ \t]*(.*)$", 1)
    stem = F.concat(F.regexp_replace(F.regexp_extract("path", r"([^/]*)$", 1), r"(_extracted)?\.txt$", ""), F.lit(".pdf"))
    banner = r"={5,}\s*PAGE\s+(\d+)\s*={5,}"
    numbers, texts = F.regexp_extract_all("value", F.lit(banner), F.lit(1)), F.slice(F.split("value", banner), 2, 2**31 - 1)
    each = files.select(F.when(F.trim(name) != "", F.trim(name)).otherwise(stem).alias("source_file"), F.explode(F.arrays_zip(numbers.alias("page"), texts.alias("text"))).alias("p"))
    return each.select("source_file", F.col("p.page").cast("bigint").alias("page"), X.collapse(F.col("p.text"), pattern).alias("text"))


def read(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), "value")
    return parsed(files)
