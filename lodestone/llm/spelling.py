"""Spelling variants: words one edit apart, found in a dictionary sorted forward and one sorted backward.

Two words that differ by one inserted, deleted or replaced code point share the half before or the half after the edit.
So each word is put into blocks by its first half, in the forward dictionary, and by its last half, in the reversed one;
blocks are ranges of the sorted dictionaries, and a task scans them one after the other and compares words within each.
A block of too many words is divided: what is between the shared parts is halved again, in both directions, until blocks
are small or one place is left between the shared parts, where the block holds a word for each letter at most. A pair is
counted in one block only: the forward one wherever the first half is the same.

Rows with null or empty text have no words; repeated rows count as often as they are there; a null doc_id is an empty
number. Other columns, whatever their names, are left aside. Of equally frequent neighbours the smallest in code-point
order is the form. Long words are compared whole.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import discard, tidy, written
from lodestone.session import ensure_importable

LETTERS = "A-Za-z\u00c0-\u00ff"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SHORTEST, LEAST, TIMES, NOISE = 7, 2, 10, 31
CROWD = 48  # words that are compared with each other; larger blocks are divided

_STEP = re.compile(r"([ps])(\d+)")


def dictionary(docs: DataFrame, shortest: int = SHORTEST, least: int = LEAST, noise: int = NOISE) -> DataFrame:
    """word, n: the words of all texts, one of ``noise`` occurrences by a checksum with one letter less."""
    # Shorter runs can't become words, so they are not looked at; equal words combine in each task before the shuffle.
    long_ = F.regexp_extract_all("text", F.lit(f"[{LETTERS}]{{{shortest},}}"), F.lit(0))
    run = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.explode(long_).alias("run")).withColumn("run", F.translate("run", UPPER, LOWER))
    drawn = F.crc32(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("run")))
    at = (F.col("h") % F.char_length("run")).cast("int")
    less = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.char_length("run")))
    words = run.withColumn("h", drawn).select(F.when(F.col("h") % noise == 0, less).otherwise(F.col("run")).alias("word")).filter(F.char_length("word") >= shortest)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)


def _divided(rows: DataFrame) -> DataFrame:
    """``rows``: word, n, path, a, b: words in blocks that share a code points at the start and b at the end. The blocks by
    one half more of what is between; path tells the steps.

    Of m places between, words of the same length share m // 2 of them; a word shares half, rounded up, with one that is
    longer by one. Where that is none, the block can't be divided, and its path ends in t.
    """
    m = F.char_length("word") - F.col("a") - F.col("b")
    halves = F.array_distinct(F.array(F.floor(m / 2).cast("int"), F.ceil(m / 2).cast("int")))
    each = rows.withColumn("h", F.explode(halves)).withColumn("side", F.explode(F.when(F.col("h") == 0, F.array(F.lit("t"))).otherwise(F.array(F.lit("p"), F.lit("s")))))
    grown = each.select(
        "word", "n", F.concat("path", "side", F.col("h").cast("string")).alias("path"),
        (F.col("a") + F.when(F.col("side") == "p", F.col("h")).otherwise(0)).alias("a"), (F.col("b") + F.when(F.col("side") == "s", F.col("h")).otherwise(0)).alias("b"),
    )
    shared = F.concat(F.substring("word", F.lit(1), F.col("a")), F.lit("\n"), F.substring(F.reverse("word"), F.lit(1), F.col("b")))
    return grown.withColumn("block", shared)


def one_edit(x: str, y: str) -> int:
    """How many code points two different words share at the start, if they differ by one edit; else -1."""
    if len(x) > len(y):
        x, y = y, x
    if len(y) - len(x) > 1:
        return -1
    low, high = 0, len(x)
    if x != y[:high]:
        while low < high:  # the first place where they differ
            mid = (low + high) // 2
            low, high = (mid + 1, high) if x[low : mid + 1] == y[low : mid + 1] else (low, mid)
    else:
        low = high
    return low if x[low + (len(x) == len(y)) :] == y[low + 1 :] and x != y else -1


def _home(path: str, shared: int, least: int, same: bool) -> bool:
    """Whether a path is the one at which a pair is counted; ``shared`` code points at the start, ``least`` in the shorter."""
    a = b = 0
    for side, digits in _STEP.findall(path):
        h, m = int(digits), least - a - b
        if same and h != m // 2 or (shared - a >= h) != (side == "p"):
            return False
        a, b = (a + h, b) if side == "p" else (a, b + h)
    return True


def _compared(rows: list[tuple[str, int]], path: str) -> Iterator[tuple[str, int, int, str]]:
    """word, neighbours, the largest n among them, its smallest word; of the words of one block."""
    near: dict[str, list] = {}

    def add(x: str, y: str, n: int) -> None:
        seen = near.setdefault(x, [0, 0, ""])
        seen[0] += 1
        if n > seen[1] or n == seen[1] and y < seen[2]:
            seen[1:] = n, y

    rows = sorted(rows, key=lambda r: len(r[0]))
    for i, (x, n) in enumerate(rows):
        for y, k in rows[i + 1 :]:
            if len(y) - len(x) > 1:
                break
            at = one_edit(x, y)
            if at >= 0 and _home(path, at, len(x), len(x) == len(y)):
                add(x, y, k)
                add(y, x, n)
    for x, (count, n, y) in near.items():
        yield x, count, n, y


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks as they come in order: each is compared when the next begins."""

    def told(found: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in found], k) for i, k in enumerate(kinds)], ["word", "n_near", "near_n", "near"])

    at, held, found = None, [], []
    for batch in batches:
        for path, block, word, n in zip(*(batch.column(c).to_pylist() for c in ("path", "block", "word", "n")), strict=True):
            if (path, block) != at:
                if len(held) > 1:
                    found += _compared(held, at[0])
                at, held = (path, block), []
            held.append((word, n))
        if found:
            yield told(found)
            found = []
    if len(held) > 1:
        found += _compared(held, at[0])
    if found:
        yield told(found)


def neighbours(words: DataFrame, crowd: int = CROWD) -> DataFrame:
    """``words``: word, n, each word once, in a table that can be read twice. word, n_near, form, form_n of the words that
    have neighbours; form is the most frequent of them."""
    ensure_importable(words.sparkSession)
    parts, left = [], written(_divided(words.select("word", "n", F.lit("").alias("path"), F.lit(0).alias("a"), F.lit(0).alias("b"))), "blocks")
    while True:
        sizes = left.groupBy("path", "block").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
        # A large block is split wherever its rows are many: the other side has one row for it.
        sized = written(left.join(sizes, ["path", "block"]), "blocks")
        ends = F.col("path").contains("t")
        order = ["path", "block"]
        small = sized.filter((F.col("size") <= crowd) | ends).select("path", "block", "word", "n").repartitionByRange(*order).sortWithinPartitions(*order, "word")
        parts.append(written(small.mapInArrow(tidy(_scan), "word string, n_near long, near_n long, near string"), "neighbours"))
        large = sized.filter((F.col("size") > crowd) & ~ends)
        if large.isEmpty():
            break
        after = written(_divided(large.select("word", "n", "path", "a", "b")), "blocks")
        discard(left, sized)
        left = after
    discard(left, sized)
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    best = F.min(F.struct((-F.col("near_n")).alias("n"), F.col("near").alias("near")))
    return every.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best")).select("word", "n_near", F.col("best.near").alias("near"), (-F.col("best.n")).alias("near_n"))


def grouped(docs: DataFrame, shortest: int = SHORTEST, least: int = LEAST, times: int = TIMES, noise: int = NOISE, crowd: int = CROWD) -> DataFrame:
    """word, form, root, n, n_near, form_n, for every word of the dictionary.

    Forms are ``times`` as frequent at least, so a path of forms is short: its length follows from the largest count, and
    each join doubles what is followed.
    """
    words = written(dictionary(docs, shortest, least, noise), "words")
    near = neighbours(words, crowd)
    formed = F.col("near_n") >= times * F.col("n")
    judged = words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(formed, F.col("near")).alias("form"), F.when(formed, F.col("near_n")).alias("form_n"))
    judged = written(judged, "words")
    most = judged.agg(F.max("n")).head()[0] or 1
    up = judged.filter("form is not null").select("word", F.col("form").alias("root"))
    steps = 1 + max(0, math.floor(math.log(most / least, times))) if most >= least else 1
    for _ in range(math.ceil(math.log2(steps)) if steps > 1 else 0):
        on = up.select(F.col("word").alias("root"), F.col("root").alias("further"))
        up = written(up.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root")), "roots")
    return judged.join(up, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
