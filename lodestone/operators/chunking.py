"""Token windows over pages, and fixed-size batches of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone import schemas
from lodestone.functions import text as X
from lodestone.operators.ordering import running_totals

SIZE, OVERLAP, BATCH, HEADS = 220, 40, 12, 8


def _tokens(pages: DataFrame, pattern: str) -> DataFrame:
    return pages.withColumn("_t", X.collapse(F.col("text"), pattern)).filter("_t <> ''").withColumn("_w", F.split("_t", " ")).withColumn("_n", F.size("_w"))


def _last(n: Column, size: int, step: int) -> Column:
    """The number of a page's last window, from 0."""
    return F.greatest(F.ceil((n - size) / step), F.lit(0)).cast("int")


def _windows(pages: DataFrame, size: int, overlap: int, pattern: str, texts: bool) -> DataFrame:
    step = size - overlap
    split = _tokens(pages, pattern).withColumn("_i", F.sequence(F.lit(0), _last(F.col("_n"), size, step))).withColumn("_l", F.transform("_w", F.length))
    # Characters of n tokens from the i-th step on, with a space after each.
    taken = lambda i, n: F.aggregate(F.slice("_l", i * step + 1, F.lit(n)), F.lit(0), lambda s, x: s + x + 1)
    none = F.struct(F.array().cast("array<int>").alias("starts"), F.lit(0).alias("at"))
    added = F.aggregate(F.transform("_i", lambda i: taken(i, step)), none, lambda s, n: F.struct(F.concat(s["starts"], F.array(s["at"])).alias("starts"), (s["at"] + n).alias("at")))
    split = split.withColumn("_s", added["starts"])

    def window(i: Column) -> Column:
        bounds = [(i + 1).alias("chunk_index"), (i * step).alias("token_start"), F.least(i * step + size, F.col("_n")).alias("token_end"), F.get("_s", i).alias("char_start"), (F.get("_s", i) + taken(i, size) - 1).alias("char_end")]
        # A row holds the tokens of its own window only.
        return F.struct(*bounds, *([F.array_join(F.slice("_w", i * step + 1, F.lit(size)), " ").alias("text")] if texts else []))

    each = split.select("paper_id", "source_file", "page", F.explode(F.transform("_i", window)).alias("w")).select("paper_id", "source_file", "page", "w.*")
    held = each.withColumn("token_count", F.col("token_end") - F.col("token_start"))
    return held.withColumn("chunk_id", X.chunk_id(F.col("paper_id"), F.col("page"), F.col("chunk_index"))).select(*[c for c in schemas.CHUNK_COLUMNS if texts or c != "text"])


def windows(pages: DataFrame, size: int = SIZE, overlap: int = OVERLAP, pattern: str = X.UNICODE_SPACE) -> DataFrame:
    """``pages``: paper_id, source_file, page, text. Windows of ``size`` white-space tokens, each ``size - overlap``
    after the one before; the last ends with the page. Offsets are code points of the collapsed page text.
    """
    return _windows(pages, size, overlap, pattern, True)


def texts(pages: DataFrame, size: int = SIZE, overlap: int = OVERLAP, pattern: str = X.UNICODE_SPACE) -> DataFrame:
    """chunk_id and text of ``windows``; no characters are counted."""
    step = size - overlap
    split = _tokens(pages, pattern).withColumn("_i", F.sequence(F.lit(0), _last(F.col("_n"), size, step)))
    window = lambda i: F.struct((i + 1).alias("chunk_index"), F.array_join(F.slice("_w", i * step + 1, F.lit(size)), " ").alias("text"))
    each = split.select("paper_id", "page", F.explode(F.transform("_i", window)).alias("w"))
    return each.select(X.chunk_id(F.col("paper_id"), F.col("page"), F.col("w.chunk_index")).alias("chunk_id"), "w.text")


def layout(pages: DataFrame, size: int = SIZE, overlap: int = OVERLAP, pattern: str = X.UNICODE_SPACE) -> DataFrame:
    """The windows without their text: where each begins and ends, in tokens and characters. ``cut`` gives the text."""
    return _windows(pages, size, overlap, pattern, False)


def cut(bounds: DataFrame, pages: DataFrame, pattern: str = X.UNICODE_SPACE) -> DataFrame:
    """Windows of ``layout`` with their text, from pages of one row a paper and page. Only pages that are asked for are
    collapsed."""
    text = pages.select("paper_id", "page", "text")
    met = bounds.join(text, bounds["paper_id"].eqNullSafe(text["paper_id"]) & (bounds["page"] == text["page"])).drop(text["paper_id"]).drop(text["page"])
    return met.withColumn("text", F.substring(X.collapse(F.col("text"), pattern), F.col("char_start") + 1, F.col("char_end") - F.col("char_start"))).select(*schemas.CHUNK_COLUMNS)


def counted(pages: DataFrame, size: int = SIZE, overlap: int = OVERLAP, pattern: str = X.UNICODE_SPACE) -> DataFrame:
    """paper_id, page, n_windows of the pages that have any: tokens are counted, and none is cut out. ``pattern`` is one of
    ``text.TOKENS``."""
    clean = pages.withColumn("_n", F.coalesce(F.regexp_count("text", F.lit(X.TOKENS[pattern])), F.lit(0))).filter("_n > 0")
    return clean.select("paper_id", "page", (_last(F.col("_n"), size, size - overlap) + 1).cast("long").alias("n_windows"))


def numbered(counts: DataFrame) -> DataFrame:
    """``counts`` as of ``counted``. A row for each window: paper_id, page, chunk_index, chunk_id, position in its paper.
    Running sums go over numbers of pages, by ranges, so a paper may have any number of them."""
    placed = running_totals(counts, ["paper_id"], ["page"], "n_windows", "_before")
    return _each(placed).withColumn("position", F.col("_before") + F.col("chunk_index")).drop("_before")


def chunk_ids(counts: DataFrame) -> DataFrame:
    """paper_id, page, chunk_index, chunk_id."""
    return _each(counts)


def _each(counts: DataFrame) -> DataFrame:
    each = counts.withColumn("chunk_index", F.explode(F.sequence(F.lit(1), F.col("n_windows").cast("int")))).drop("n_windows")
    return each.withColumn("chunk_id", X.chunk_id(F.col("paper_id"), F.col("page"), F.col("chunk_index")))


def per_paper(counts: DataFrame) -> DataFrame:
    """``counts`` as of ``counted``: windows, and pages that have any, by paper."""
    return counts.groupBy("paper_id").agg(F.sum("n_windows").alias("n_chunks"), F.countDistinct("page").alias("n_pages"))


def _batched(placed: DataFrame, size: int) -> DataFrame:
    return placed.withColumn("batch_number", (F.floor((F.col("position") - 1) / size) + 1).cast("int"))


def batches(placed: DataFrame, size: int = BATCH) -> DataFrame:
    """``placed`` as of ``numbered``. Adds batch_number: ``size`` consecutive chunks of a paper."""
    return _batched(placed, size).drop("position")


def batch_lists(placed: DataFrame, size: int = BATCH) -> DataFrame:
    """One row a batch: paper_id, batch_number, its chunk ids in order; a list has ``size`` entries at most."""
    listed = _batched(placed, size).groupBy("paper_id", "batch_number").agg(F.sort_array(F.collect_list(F.struct("position", "chunk_id"))).alias("x"))
    return listed.select("paper_id", "batch_number", F.transform("x", lambda c: c["chunk_id"]).alias("chunk_ids"))


def heads(placed: DataFrame, n: int = HEADS) -> DataFrame:
    """The first ``n`` chunks of each paper."""
    return placed.filter(F.col("position") <= n)


def expected_batches(counts: DataFrame, size: int = BATCH) -> DataFrame:
    """``counts`` as of ``counted``."""
    return counts.groupBy("paper_id").agg(F.ceil(F.sum("n_windows") / size).alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("n_batches"))


def pending(work: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """What is not done yet."""
    return work.join(done.select(*keys).distinct(), keys, "left_anti")


def latest(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    """Of each key, the row that was written last: grouped maximum of the whole row, so writes combine map-side."""
    others = [c for c in rows.columns if c not in keys]
    packed = rows.groupBy(*keys).agg(F.max_by(F.struct(*others), F.struct(*order)).alias("r"))
    return packed.select(*keys, *[F.col("r")[c].alias(c) for c in others]).select(*rows.columns)
