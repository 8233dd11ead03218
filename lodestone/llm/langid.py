"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1, drawn from its code point; word boundaries have one too. A trigram's
vector binds its letters' vectors, permuted by place (rolled by 2, 1 and 0), by multiplication. A document's vector
bundles its trigrams' vectors by addition, and a language's prototype bundles the unit vectors of its documents. The
language predicted is that of the prototype with the highest cosine; ties go to the first by code point.

Training takes at most ``train_rows`` labelled rows (a documented bound, by hash), prediction every row. Prototypes
are summed as whole numbers, so their sums do not depend on the order of partitions.

Defined cases: a null text or one without a letter is ``und`` with score 0; so is every row if nothing is labelled;
a null lang is not learned from; repeated rows count again; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import tidy
from lodestone.llm.tokens import steps
from lodestone.session import ensure_importable

DIMENSIONS, SEED, TRAIN_ROWS = 1024, 20, 50_000
_SCALE = 1 << 20
_DOCS = 384  # documents whose trigram counts are held at once
_tables: dict = {}


def _letters() -> np.ndarray:
    if "letters" not in _tables:
        _tables["letters"] = np.array([chr(i).isalpha() for i in range(0x110000)])
    return _tables["letters"]


def letter_vector(code: int, dimensions: int) -> np.ndarray:
    known = _tables.setdefault(("vectors", dimensions), {})
    if code not in known:
        known[code] = (np.random.default_rng([SEED, code]).integers(0, 2, dimensions) * 2 - 1).astype(np.int8)
    return known[code]


def document_vectors(texts: list[str | None], dimensions: int = DIMENSIONS) -> np.ndarray:
    """A row for each text; rows of texts without letters are zero."""
    clean = ["\0" + (x or "").lower() + "\0" for x in texts]
    codes = np.frombuffer("".join(clean).encode("utf-32-le", "surrogatepass"), np.uint32)
    doc = np.repeat(np.arange(len(texts)), [len(x) for x in clean])
    symbols = np.where(_letters()[codes], codes, 0)
    keep = symbols != 0
    keep[1:] |= symbols[:-1] != 0
    keep[0] = True
    keep[1:] |= doc[1:] != doc[:-1]
    symbols, doc = symbols[keep], doc[keep]
    present = np.flatnonzero(np.bincount(symbols))
    rank = np.zeros(int(present[-1]) + 1, np.int64)
    rank[present] = np.arange(len(present))
    dense, n = rank[symbols], len(present)
    grams = (dense[:-2] * n + dense[1:-1]) * n + dense[2:]
    inside = (doc[:-2] == doc[2:]) & ((symbols[:-2] != 0) | (symbols[1:-1] != 0) | (symbols[2:] != 0))
    grams, owner = grams[inside], doc[:-2][inside]
    out = np.zeros((len(texts), dimensions), np.float32)
    if not len(grams):
        return out
    if n**3 <= 1 << 23:
        distinct = np.flatnonzero(np.bincount(grams))
        place = np.zeros(int(distinct[-1]) + 1, np.int64)
        place[distinct] = np.arange(len(distinct))
        grams = place[grams]
    else:
        distinct, grams = np.unique(grams, return_inverse=True)
    base = np.stack([letter_vector(int(c), dimensions) for c in present])
    first, second = np.roll(base, 2, axis=1), np.roll(base, 1, axis=1)
    for lo in range(0, len(distinct), 8192):
        part = distinct[lo : lo + 8192]
        bound = (first[part // (n * n)] * second[part // n % n] * base[part % n]).astype(np.float32)
        mine = (grams >= lo) & (grams < lo + len(part)) if len(distinct) > 8192 else slice(None)
        counts = np.bincount(owner[mine] * len(part) + grams[mine] - lo, minlength=len(texts) * len(part))
        out += counts.reshape(len(texts), len(part)).astype(np.float32) @ bound
    return out


def _pieces(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    for lo, hi in steps(texts, 1_000_000):
        for at in range(lo, hi, _DOCS):
            yield at, min(hi, at + _DOCS)


def _bundler(dimensions: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            texts, langs = batch.column("text").to_pylist(), np.array(batch.column("lang").to_pylist(), object)
            for lo, hi in _pieces(texts):
                v = document_vectors(texts[lo:hi], dimensions)
                norm = np.linalg.norm(v, axis=1, keepdims=True)
                unit = np.rint(v / np.maximum(norm, 1e-9) * _SCALE).astype(np.int64)
                for lang in set(langs[lo:hi]):
                    sums[lang] = sums.get(lang, 0) + unit[langs[lo:hi] == lang].sum(axis=0)
        for lang, v in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * dimensions), pa.array(np.arange(dimensions, dtype=np.int32)), pa.array(v)], ["lang", "dim", "v"])

    return run


def train(labelled: DataFrame, dimensions: int = DIMENSIONS, train_rows: int = TRAIN_ROWS) -> dict[str, np.ndarray]:
    """``labelled``: doc_id, text, lang. The prototypes by language, in order of code point."""
    ensure_importable(labelled.sparkSession)
    known = labelled.filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    n = known.count()
    if n > train_rows:  # a sample by hash, of about train_rows rows
        known = known.filter(F.pmod(F.xxhash64(F.lit(SEED), "doc_id"), F.lit(1 << 30)) < int((1 << 30) * train_rows / n))
    sums = known.select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).mapInArrow(tidy(_bundler(dimensions)), "lang string, dim int, v long")
    found: dict[str, np.ndarray] = {}
    for r in sums.groupBy("lang", "dim").agg(F.sum("v").alias("v")).groupBy("lang").agg(F.collect_list(F.struct("dim", "v")).alias("p")).collect():
        v = np.zeros(dimensions)
        for dim, x in r["p"]:
            v[dim] = x
        if (norm := np.linalg.norm(v)) > 0:
            found[r["lang"]] = v / norm
    return dict(sorted(found.items()))


def _guesser(prototypes: dict[str, np.ndarray], dimensions: int, names: list[str], out: tuple[str, str]):
    langs, matrix = np.array([*prototypes, "und"], object), np.stack(list(prototypes.values())).T if prototypes else np.zeros((dimensions, 0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            best, score = np.full(len(texts), len(langs) - 1), np.zeros(len(texts))
            for lo, hi in _pieces(texts) if prototypes else ():
                v = document_vectors(texts[lo:hi], dimensions).astype(np.float64)
                norm = np.linalg.norm(v, axis=1)
                cosine = v @ matrix / np.maximum(norm, 1e-9)[:, None]
                top = cosine.argmax(axis=1)
                full = norm > 0
                best[lo:hi][full] = top[full]
                score[lo:hi][full] = np.clip(cosine[np.arange(hi - lo), top], 0, 1)[full]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(langs[best], pa.string()), pa.array(score)], [*names, *out])

    return run


def predict(docs: DataFrame, prototypes: dict[str, np.ndarray], keep: tuple[str, ...] = ("doc_id",), dimensions: int = DIMENSIONS, out: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """The columns in ``keep``, the language and the score, named as in ``out``, for every row; only the text goes into the prediction."""
    ensure_importable(docs.sparkSession)
    rows = docs.select(*keep, *([] if "text" in keep else ["text"]))
    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep)
    return rows.mapInArrow(tidy(_guesser(prototypes, dimensions, list(keep), out)), f"{kinds}, `{out[0]}` string, `{out[1]}` double")


def _with_letters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = [any(map(str.isalpha, x or "")) for x in batch.column("text").to_pylist()]
        yield batch.filter(pa.array(keep, pa.bool_()))


def lettered(docs: DataFrame) -> DataFrame:
    """The rows whose text has a letter."""
    ensure_importable(docs.sparkSession)
    return docs.mapInArrow(tidy(_with_letters), docs.schema)


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))
