"""Mixing sources to target weights by capped water-filling; DataFrame functions only.

A source's target is its share of the budget by weight, but at most ``max_epochs`` times its size; what a clamped
source can't take is dealt to the others by weight until no target is above its limit. A source then takes every
document floor(target / size) times, and a seeded fraction of its documents once more.

Defined cases: a null or blank text has size 0; a null source is a source, last in the order; a source of size 0 gets
target 0; an empty table gives no rows; repeated rows are documents of their own; further columns are ignored by
``plan`` and kept by ``mix``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import word_count, written

#: Hash buckets in which a source's fractional repetition is first located; only the bucket at the cut is sorted.
BUCKETS = 4096


def targets(sources: DataFrame, weights: Sequence[float], share: float, max_epochs: float) -> DataFrame:
    """``sources``: source, source_size; adds weight and target. One row per source, so its windows are small."""
    everything = Window.partitionBy()
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weighed = sources.withColumn("place", F.row_number().over(by_name)).withColumn(
        "weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("place") - 1) % len(weights) + 1).cast("int"))
    )
    limit = F.lit(float(max_epochs)) * F.col("source_size")
    # In ascending order of limit / weight the clamped sources come first; "level" is the words per weight left there.
    rising = Window.orderBy(F.col("limit") / F.col("weight"), "place")
    before, onward = rising.rowsBetween(Window.unboundedPreceding, -1), rising.rowsBetween(0, Window.unboundedFollowing)
    level = (F.lit(float(share)) * F.sum("source_size").over(everything) - F.coalesce(F.sum("limit").over(before), F.lit(0.0))) / F.sum("weight").over(onward)
    filled = weighed.withColumn("limit", limit).withColumn("level", level)
    open_level = F.when(F.col("limit") > F.col("weight") * F.col("level"), F.col("level"))
    first_open = F.first(open_level, ignorenulls=True).over(rising.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return filled.withColumn("target", F.least("limit", F.coalesce(F.col("weight") * first_open, F.col("limit")))).select("source", "source_size", "weight", "target")


def _same_source(a: str, b: str) -> Column:
    return F.col(f"{a}.source").eqNullSafe(F.col(f"{b}.source"))


def plan(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, max_epochs: float = 2.0, seed: int = 17, whole_rows: bool = False) -> DataFrame:
    """Per row of ``docs``: doc_id, source, size, source_size, target, taken, repeats; with whole_rows also the row."""
    row = [F.struct(*[docs[c] for c in docs.columns]).alias("row")] if whole_rows else []
    sized = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), F.xxhash64(F.lit(seed), "doc_id", "text").alias("h"), *row)
    sized = written(sized.withColumn("bucket", F.pmod("h", F.lit(BUCKETS)).cast("int")).withColumn("n", F.monotonically_increasing_id()), "mix-sizes")
    by_bucket = written(sized.groupBy("source", "bucket").agg(F.sum("size").alias("words")), "mix-buckets")
    goal = targets(by_bucket.groupBy("source").agg(F.sum("words").alias("source_size")), weights, share, max_epochs)
    # Full repetitions, and the words wanted once more.
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    goal = goal.withColumn("epochs", epochs).withColumn("wanted", F.col("target") - F.col("epochs") * F.col("source_size"))
    running = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    reach = by_bucket.withColumn("upto", F.sum("words").over(running))
    short = F.col("upto") < F.col("wanted")
    cut = (
        reach.alias("r").join(goal.alias("g"), _same_source("r", "g"))
        .groupBy("g.source", "g.source_size", "g.target", "g.epochs", "g.wanted")
        .agg(F.min(F.when(~short, F.col("bucket"))).alias("cut"), F.coalesce(F.max(F.when(short, F.col("upto"))), F.lit(0)).alias("below"))
        .withColumn("cut", F.coalesce("cut", F.lit(BUCKETS)))
    )
    cut = written(cut, "mix-plan")
    each = sized.alias("d").join(cut.alias("c"), _same_source("d", "c")).select("d.*", "c.source_size", "c.target", "c.epochs", "c.wanted", "c.cut", "c.below")
    once = each.filter("bucket != cut").withColumn("extra", (F.col("bucket") < F.col("cut")).cast("long"))
    # In the bucket at the cut, a document is taken if more than half of it lies within what is wanted. Only ids and
    # sizes go into the window; whole rows come back by their number.
    order = Window.partitionBy("source").orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    edge = each.filter("bucket = cut")
    rows = edge.select("n", "row") if whole_rows else None
    edge = edge.drop("row").withColumn("upto", F.sum("size").over(order))
    edge = edge.withColumn("extra", (F.col("below") + F.col("upto") - F.col("size") / 2 < F.col("wanted")).cast("long")).drop("upto")
    edge = edge.join(rows, "n") if whole_rows else edge
    both = once.unionByName(edge).withColumn("repeats", F.col("epochs") + F.col("extra"))
    return both.select("doc_id", "source", "size", "source_size", "target", (F.col("size") * F.col("repeats")).alias("taken"), "repeats", *(["row"] if whole_rows else []))


def mix(docs: DataFrame, **how) -> DataFrame:
    """The mixed corpus: each row of ``docs`` as often as the plan says; a copy taken again has the same doc_id."""
    planned = plan(docs, whole_rows=True, **how).filter("repeats > 0")
    return planned.select("row", F.explode(F.sequence(F.lit(1), F.col("repeats").cast("int")))).select("row.*")
