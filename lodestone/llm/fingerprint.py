"""Document fingerprints: bottom-k sketches of shingle hashes; DataFrame functions only.

A sketch is the ascending array of the k smallest 40-bit hashes of a text's distinct word shingles. Sketches of parts
merge into the sketch of the whole, and two sketches estimate resemblance, containment and distinct shingles; below
k shingles the figures are exact.

Defined cases: a null text counts as empty; an empty or blank text has the empty sketch; a text with fewer words than
a shingle is one shingle; two empty sketches resemble each other by 1, an empty and a filled one by 0. Null doc_ids come
last, equal ids in descending order of text, so of repeated rows each is the next of one other; a single document is its
own next; a very long text is shingled whole, in its row; an empty table gives no rows; further columns, whatever their names, are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from lodestone.llm.common import SPACE

K, WORDS, BITS = 128, 5, 40


def with_sketch(df: DataFrame, text: str, out: str, k: int = K, words: int = WORDS) -> DataFrame:
    """Adds column ``out``; each step is a column of its own, so that lambdas refer to finished arrays."""
    w, h, s = f"_{out}_w", f"_{out}_h", f"_{out}_s"
    df = df.withColumn(w, F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda x: x != ""))
    df = df.withColumn(h, F.transform(w, lambda x: F.xxhash64(x)))
    whole = F.when(F.size(h) > 0, F.array(F.xxhash64(F.array_join(w, " ")))).otherwise(F.array().cast("array<bigint>"))
    each = F.transform(F.sequence(F.lit(0), F.size(h) - words), lambda i: F.xxhash64(*[F.get(F.col(h), i + j) for j in range(words)]))
    df = df.withColumn(s, F.when(F.size(h) < words, whole).otherwise(each))
    df = df.withColumn(out, F.slice(F.sort_array(F.array_distinct(F.transform(s, lambda x: F.shiftrightunsigned(x, 64 - BITS)))), 1, k))
    return df.drop(w, h, s)


def merge(a: Column | str, b: Column | str, k: int = K) -> Column:
    """The sketch of both parts together."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def merged(sketch: str, k: int = K) -> Column:
    """Aggregate: the sketch of a group's parts together."""
    return F.slice(F.sort_array(F.array_distinct(F.flatten(F.collect_set(sketch)))), 1, k)


def resemblance(a: str, b: str, k: int = K) -> Column:
    """Estimated Jaccard likeness of the shingle sets."""
    both = F.array_intersect(F.array_intersect(a, b), merge(a, b, k))
    of = F.least(F.lit(k), F.size(F.array_union(a, b)))
    return F.when(of == 0, 1.0).otherwise(F.size(both) / of)


def distinct_shingles(a: str, k: int = K) -> Column:
    """Estimated number of distinct shingles; exact below k."""
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) * F.lit(float(2**BITS)) / F.element_at(a, k))


def containment(a: str, b: str, k: int = K) -> Column:
    """Estimated share of a's shingles that are in b; 1 for an empty a."""
    j = resemblance(a, b, k)
    shared = j / (1 + j) * (distinct_shingles(a, k) + distinct_shingles(b, k))
    return F.when(F.size(a) == 0, 1.0).otherwise(F.least(F.lit(1.0), shared / distinct_shingles(a, k)))


def as_text(a: str) -> Column:
    """Base64 of the 5-byte big-endian hashes; empty for the empty sketch."""
    digits = BITS // 4
    return F.translate(F.base64(F.unhex(F.array_join(F.transform(a, lambda x: F.lpad(F.hex(x), digits, "0")), ""))), "\r\n", "")


def _below(bounds: list[int], x: Column) -> Column:
    """How many of the ascending ``bounds`` are below x: first by every n-th, then by those between two of these."""
    n = max(1, int(len(bounds) ** 0.5))
    count = lambda some: F.size(F.filter(some, lambda b: b < x))
    array = lambda some: F.array(*[F.lit(b) for b in some]).cast("array<bigint>")
    steps = [bounds[i : i + n] for i in range(0, len(bounds), n)]
    coarse = count(array([part[-1] for part in steps]))  # steps that are wholly below
    return coarse * n + count(F.element_at(F.array(*map(array, [*steps, []])), coarse + 1))


def in_id_order(docs: DataFrame) -> tuple[DataFrame, WindowSpec]:
    """``docs`` (doc_id, text) dealt out by ranges of doc_id, and a window over which lead() is the next document by
    descending doc_id (equal ids: descending text; null ids last); the last document's next is the first.

    Drop rows marked _ghost after the window. A task holds a range of doc_id; the first row of each range also goes to
    the range above it. What reaches the driver is one boundary and one id a range, of at most 20,000 ranges.
    """
    spark = docs.sparkSession
    parts = min(20_000, max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    key = F.coalesce(F.col("doc_id"), F.lit(-(2**63)))
    ids = docs.select(key.alias("id"))
    quantiles = F.array(*[F.lit((i + 1) / parts) for i in range(parts - 1)]) if parts > 1 else F.array(F.lit(0.5))
    bounds = sorted(set(ids.agg(F.percentile_approx("id", quantiles, F.lit(max(10_000, 20 * parts)))).head()[0] or []))
    bucket = _below(bounds, F.col("_id"))
    tops = ids.withColumnRenamed("id", "_id").groupBy(bucket.alias("b")).agg(F.max("_id").alias("top")).orderBy("b").collect()
    keyed = docs.withColumn("_id", key).withColumn("_b", bucket).withColumn("_ghost", F.lit(False))
    both = keyed
    if tops:
        above = {r["top"]: tops[(i + 1) % len(tops)]["b"] for i, r in enumerate(tops)}
        pairs = F.create_map(*[F.lit(x) for pair in above.items() for x in pair])
        ghosts = keyed.filter(F.col("_id").isin(list(above))).withColumn("_b", F.element_at(pairs, F.col("_id"))).withColumn("_ghost", F.lit(True))
        both = keyed.unionByName(ghosts)
    down = Window.partitionBy("_b").orderBy("_ghost", F.col("_id").desc(), F.col("text").desc())
    return both.repartitionByRange(parts, "_b"), down  # by range: a hash would put several in a task


def edited_pairs(docs: DataFrame, k: int = K) -> DataFrame:
    """Per document: its sketch, its edited text's sketch, and their likeness to each other and to the next document.

    The edited text has its last third replaced by the beginning of the next document in descending doc_id order.
    """
    clean = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    dealt, down = in_id_order(clean)
    own = with_sketch(dealt, "text", "sketch", k)
    ahead = own.withColumn("next_text", F.lead("text").over(down)).withColumn("next_sketch", F.lead("sketch").over(down)).filter(~F.col("_ghost"))
    n = F.char_length("text")
    third = F.floor(n / 3).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - third), F.substring(F.col("next_text"), F.lit(1), third))
    ahead = with_sketch(ahead.withColumn("edited", edited), "edited", "edited_sketch", k)
    return ahead.select(
        "doc_id", n.cast("long").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), as_text("sketch").alias("fingerprint"), as_text("edited_sketch").alias("edited_fingerprint"),
        resemblance("sketch", "edited_sketch", k).alias("near_edited"), resemblance("sketch", "next_sketch", k).alias("near_next"),
    )
