"""From raw documents to packed sequences: the stages, and what runs them one after another.

Every stage but the last returns the columns of documents. Rows with null or empty texts are rejected by the first
stage, for want of a letter; extra columns are carried up to the mix.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestone.llm import langid, mixing, packing, pii, simhash
from lodestone.llm.common import shared_path


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that was learned; the rest are rejected. The predicted language becomes theirs.

    Where nothing could be learned, only texts without a letter are rejected, and languages stay as they are.
    """
    prototypes = langid.train(docs.select("doc_id", "text", "lang"))
    if not prototypes:
        return langid.lettered(docs)
    out = ("predicted language of this row", "likeness of this row")  # names that no table has
    guessed = langid.predict(docs, prototypes, keep=tuple(docs.columns), out=out)
    guessed = guessed.filter(guessed[out[0]] != "und")
    return guessed.withColumn("lang", guessed[out[0]].cast(docs.schema["lang"].dataType)).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five-word shingles 0.8 alike or more, as fingerprints tell it.

    Of a group the smallest doc_id stays; of rows that share it, the one with the smallest hash of its text, and of
    equal rows one. Texts without a word are one group. An empty table stays empty.
    """
    return simhash.representatives(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data masked in the texts; null texts stay null, and every row stays."""
    return pii.redact(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights; a document taken twice is two rows.

    A null source is a source. Repeated rows are documents of their own, and which of them are taken once more is drawn for
    each; texts without a word add nothing to their source's size. An empty table stays empty.
    """
    return mixing.mix(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 tokens: one row a piece.

    Repeated rows are packed each; an empty text is its end id alone; a long one is cut into pieces. An empty table gives
    no pieces.
    """
    return packing.pack(docs, end_id=1)


STAGES = [("language", language), ("near-duplicates", near_dedup), ("personal data", personal_data), ("mixing", mix), ("packing", pack)]

#: Learned stages and tokenizers have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = shared_path(spark, "pipeline")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        docs.write.parquet(f"{base}/{k}")
        docs = spark.read.parquet(f"{base}/{k}")
    return docs
