"""Rows of documents under keys that intermediate tables can carry instead of texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import written

LAST = 2**63 - 1


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, doc (doc_id; null: after all others), tag, text (null: empty).

    Where ids repeat, the rows are written once with a number each, the tag, so that (doc, tag) names a row; else it is 0
    throughout.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    doc = F.coalesce("doc_id", F.lit(LAST))
    repeated = not rows.groupBy(doc.alias("doc")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").isEmpty()
    named = rows.select("doc_id", doc.alias("doc"), (F.monotonically_increasing_id() if repeated else F.lit(0).cast("long")).alias("tag"), "text")
    return written(named, "rows") if repeated else named
