"""Numbers and sums in an order over all rows, however many there are.

Rows are dealt out by ranges of the order with sampled bounds and written in order, each with its place in its range. What
lies before a range is one number a range, so no task sees more than its own rows, and a value that many rows share is
spread over ranges by what follows it in the order.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.session import written

_PART, _NTH = "_part", "_nth"


def _ranges(rows: DataFrame, order: list[Column | str]) -> DataFrame:
    """Rows in ranges of the order: _part, and _nth in it, from 0."""
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    numbered = dealt.withColumn(_NTH, F.monotonically_increasing_id())  # the range's number above 33 bits, the place in it below
    return written(numbered.withColumn(_PART, F.shiftright(_NTH, 33).cast("int")).withColumn(_NTH, F.col(_NTH).bitwiseAND(F.lit(2**33 - 1))), "ordered")


def ranked_whole(rows: DataFrame, order: list[Column | str], out: str = "rank") -> DataFrame:
    """Adds the place of each row in the order of all rows, from 1. The order should tell all rows apart."""
    placed = _ranges(rows, order)
    sizes = sorted((r[_PART], r["n"]) for r in placed.groupBy(_PART).agg(F.count(F.lit(1)).alias("n")).collect())  # one a range
    before = [(p, b) for (p, _), b in zip(sizes, accumulate((n for _, n in sizes), initial=0), strict=False)]
    starts = rows.sparkSession.createDataFrame(before, f"{_PART} int, _before long")
    return placed.join(F.broadcast(starts), _PART).withColumn(out, F.col("_before") + F.col(_NTH) + 1).select(*rows.columns, out)


def running_totals(rows: DataFrame, groups: list[str], order: list[str], value: str, out: str = "before") -> DataFrame:
    """Adds the sum of ``value`` over the rows of the same group that come before, 0 for the first. Nulls in ``groups`` are
    one group. A group may hold any share of the rows: sums run within its part of a range, and what is before that part is
    a row a range."""
    placed = _ranges(rows, [*groups, *order])
    within = Window.partitionBy(_PART, *groups).orderBy(_NTH).rowsBetween(Window.unboundedPreceding, -1)
    local = placed.withColumn("_local", F.coalesce(F.sum(value).over(within), F.lit(0)))
    upto = Window.partitionBy(*groups).orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1)
    whole = placed.groupBy(*groups, _PART).agg(F.sum(value).alias("_sum"))
    offset = whole.select(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(groups)], F.col(_PART).alias("_p"), F.coalesce(F.sum("_sum").over(upto), F.lit(0)).alias("_offset"))
    same = F.col(_PART) == F.col("_p")
    for i, g in enumerate(groups):
        same = same & F.col(g).eqNullSafe(F.col(f"_g{i}"))
    return local.join(offset, same).withColumn(out, (F.col("_offset") + F.col("_local")).cast("long")).select(*rows.columns, out)
