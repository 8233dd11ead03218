"""Vector search for a question, exact or by random projections, and a hashing embedder for offline use.

``vector_index`` has the stored index."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import text as X

TOP_K = 6


def top_k(vectors: DataFrame, query: list[float], id_col: str, k: int = TOP_K, vector: str = "embedding") -> DataFrame:
    """The k rows most like one query vector: rank, the row without its vector, cosine and score = (1 + cosine) / 2.

    Ranks go by the whole cosine; it is shown with six digits.
    """
    q = F.array(*[F.lit(float(x)) for x in query])
    scored = vectors.withColumn("cosine", X.cosine(F.col(vector), q)).drop(vector)
    best = scored.orderBy(F.col("cosine").desc(), id_col).limit(k)
    return ranked(best, F.col("cosine").desc(), F.col(id_col)).withColumn("cosine", F.round("cosine", 6)).withColumn("score", (1 + F.col("cosine")) / 2)


def ranked(rows: DataFrame, *order) -> DataFrame:
    """Adds rank to a result that a limit has bounded already."""
    return rows.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def _projections(tables: int, length: float, seed: int):
    from pyspark.ml.feature import BucketedRandomProjectionLSH

    return BucketedRandomProjectionLSH(inputCol="_v", outputCol="_h", bucketLength=length, numHashTables=tables, seed=seed)


def lsh_top_k(vectors: DataFrame, query: list[float], id_col: str, k: int = TOP_K, vector: str = "embedding", tables: int = 12, length: float = 0.6, seed: int = 1) -> DataFrame:
    """As ``top_k``, over the candidates that share a random-projection bucket with the query in some table."""
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.linalg import Vectors

    rows = vectors.withColumn("_v", array_to_vector(F.col(vector).cast("array<double>")))
    near = _projections(tables, length, seed).fit(rows).approxNearestNeighbors(rows, Vectors.dense([float(x) for x in query]), k * 5)
    return top_k(near.drop("_v", "_h", "distCol"), query, id_col, k, vector)


def embed(rows: DataFrame, model: Callable[[list[str]], np.ndarray], dimensions: int, text: str = "text", out: str = "embedding") -> DataFrame:
    """Adds unit vectors by a model that maps a batch of texts to a matrix; a wrong width fails the task."""

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            v = np.asarray(model(batch.fillna("").tolist()), np.float32)
            if v.shape[1] != dimensions:
                raise ValueError(f"the model gave {v.shape[1]} dimensions instead of {dimensions}")
            v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
            yield pd.Series(list(v))

    return rows.withColumn(out, run(text))


def hashing_model(dimensions: int = 64) -> Callable[[list[str]], np.ndarray]:
    """Counts of words by hash, signed by hash: the same on every machine. A word's MD5 gives 32 bits: the column is
    their remainder, the first bit the sign."""

    def model(texts: list[str]) -> np.ndarray:
        import hashlib

        words = [text.lower().split() for text in texts]
        index: dict[str, int] = {}
        at = np.fromiter((index.setdefault(w, len(index)) for x in words for w in x), np.int64)
        hashed = np.array([int.from_bytes(hashlib.md5(w.encode("utf-8", "replace")).digest()[:4]) for w in index], np.int64)[at]
        row = np.repeat(np.arange(len(texts)), [len(x) for x in words])
        signs = np.where(hashed >> 31, 1.0, -1.0)
        return np.bincount(row * dimensions + hashed % dimensions, signs, len(texts) * dimensions).reshape(-1, dimensions).astype(np.float32)

    return model
