"""Which names a text mentions, by an index of names: only names that share a part with the text are compared with it.

A name's part is its first words, up to three; a name that may stand anywhere in a text, or has no ASCII word, goes by its
last characters, up to eight. A text has the parts that its runs of words and of characters give, so a name that it
mentions is found by equality.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import text as X

WORDS, ENDING = 3, 8
AS_WORDS, WITHIN = ("t:", "n:"), ("e:",)
FEW = 4096  # parts of one text that become a filter


def _words(low: Column) -> Column:
    return F.regexp_extract_all(low, F.lit("[a-z0-9]+"), F.lit(0))


def _ending(low: Column) -> Column:
    return F.substring(low, -ENDING, ENDING)


def index(entities: DataFrame) -> DataFrame:
    """``entities``: key, name, entity_type, aliases. part, key, name, entity_type, spelled (the name or an alias), named
    (whether it is the name); two rows a spelling, one for each of the rules below."""
    each = entities.select("key", "name", "entity_type", F.posexplode(F.array_distinct(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>"))))).alias("at", "spelled"))
    n = F.lower(F.trim("spelled"))
    words = F.slice(_words(n), 1, WORDS)
    first = F.when(n.rlike(r"^[\x00-\x7F]+$") & (F.size(words) > 0), F.concat(F.lit("t:"), F.array_join(words, " "))).otherwise(F.concat(F.lit("n:"), _ending(n)))
    parts = F.array(F.when(n != "", first), F.when(F.col("spelled") != "", F.concat(F.lit("e:"), _ending(F.lower("spelled")))))
    return each.select(F.explode(parts).alias("part"), "key", "name", "entity_type", "spelled", (F.col("at") == 0).alias("named")).filter("part is not null")


def _runs(size: Column, n: int, piece: Callable[[Column], Column]) -> Column:
    """What ``piece`` gives for each place, from 1, at which a run of ``n`` begins."""
    return F.transform(F.when(size >= n, F.sequence(F.lit(1), size - n + 1)).otherwise(F.array().cast("array<int>")), piece)


def _word_run(words: Column, n: int) -> Column:
    return _runs(F.size(words), n, lambda i: F.concat(F.lit("t:"), F.array_join(F.slice(words, i, F.lit(n)), " ")))


def _char_run(low: Column, n: int, kind: str) -> Column:
    return _runs(F.char_length(low), n, lambda i: F.concat(F.lit(kind), F.substring(low, i, F.lit(n))))


def parts_of(text: Column, kinds: tuple[str, ...]) -> Column:
    low = F.lower(text)
    words = [_word_run(_words(low), n) for n in range(1, WORDS + 1)] if "t:" in kinds else []
    return F.array_distinct(F.concat(*words, *[_char_run(low, n, k) for k in kinds if k != "t:" for n in range(1, ENDING + 1)]))


def candidates(questions: DataFrame, names: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """Rows of an index that share a part with a question. ``questions``: qid, question.

    A single question's parts, as many as its characters allow, become a filter on the index, which is stored in order of
    parts; those of many are joined, but for kinds that no name goes by.
    """
    one = len(questions.limit(2).collect()) == 1
    if not one:
        known = {r["kind"] for r in names.select(F.substring("part", 1, 2).alias("kind")).distinct().collect()}
        kinds = tuple(k for k in kinds if k in known) or kinds
    each = questions.select("qid", "question", F.explode(parts_of(F.col("question"), kinds)).alias("part"))
    if one:
        found = [r["part"] for r in each.select("part").limit(FEW + 1).collect()]
        if len(found) <= FEW:
            names = names.filter(F.col("part").isin(found))
    return names.join(each, "part")


def _top(rows: DataFrame, order: list, cap: int) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(*order))).filter(F.col("rank") <= cap)


def lexical_seeds(questions: DataFrame, names: DataFrame, cap: int) -> DataFrame:
    """qid, key, name, entity_type, seed_source, matched_text, rank: of each question, the entities it mentions by name or
    alias as words (see ``text.mentions``), those with the longest mention first."""
    met = candidates(questions, names, AS_WORDS).filter(X.mentions(F.col("question"), F.col("spelled")))
    best = met.groupBy("qid", "key", "name", "entity_type").agg(F.max(F.struct(F.length("spelled").alias("n"), F.col("spelled").alias("matched"))).alias("m"))
    shown = best.select("qid", "key", "name", "entity_type", F.lit("lexical").alias("seed_source"), F.col("m.matched").alias("matched_text"))
    return _top(shown, [F.length("matched_text").desc(), F.col("key")], cap)


def lexical_seeds_v1(questions: DataFrame, names: DataFrame, cap: int) -> DataFrame:
    """qid, key, name, entity_type, rank by the older rule: the name anywhere in the question, or an alias of four characters
    or more."""
    said = F.contains(F.lower("question"), F.lower("spelled")) & (F.col("named") | (F.length("spelled") >= 4)) & (F.col("name") != "")
    met = candidates(questions, names, WITHIN).filter(said).select("qid", "key", "name", "entity_type").distinct()
    return _top(met, [F.length("name").desc(), F.col("key")], cap)
