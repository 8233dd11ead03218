"""Repeated word passages across documents, by seed and extend.

Every window of ``words`` consecutive words holds a seed: the five-word piece in it with the smallest hash, the same
wherever the window occurs (one in five words or so is a seed's beginning). Documents are joined on seeds:

1. Seeds that one document alone has are dropped.
2. Each place of a shared seed is extended both ways as far as a window around it can reach: its hull. A hull that an
   earlier document has too is repeated as a whole, so all its words go.
3. Where a seed has several hulls, matches end within them. One document of each hull, the first, gives out its windows
   around the seed, and windows are compared by a 128-bit hash of their words. A window that an earlier document has
   goes.

The union of these is a document's maximal repeats of at least ``words`` words. Counts of seeds, hulls and windows are
pre-aggregated before each shuffle, as smallest and largest document; no group of documents is ever brought together,
however many share a passage.

Defined cases: a null text has no words; shorter documents than a window keep all; a window repeated only within its
own document stays; rows with equal doc_id never remove from each other; null doc_ids come after all others; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import discard, tidy, written
from lodestone.llm.rows import keyed
from lodestone.llm.tokens import steps
from lodestone.session import ensure_importable

WINDOW, SEED_WORDS = 13, 5
_SLICE, _BITS = 1 << 21, 22  # words looked at at once; bits for a place among them
_MIX = np.random.default_rng(7).integers(0, 2**63, (2, 64), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _scrambled(h: np.ndarray) -> np.ndarray:
    h = (h ^ h >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ h >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return h ^ h >> np.uint64(31)


def _joined(words: np.ndarray, width: int, lane: int) -> np.ndarray:
    """A hash of every ``width`` consecutive word hashes."""
    n = max(0, len(words) - width + 1)
    h = np.zeros(n, np.uint64)
    for j in range(width):
        h += _scrambled(words[j : j + n] ^ _MIX[lane, j]) * _MIX[lane, j + 32]
    return _scrambled(h)


def _word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Of all words of all texts, and the number of words of each text. bytes.split() parts at the same six
    characters as the word pattern."""
    cut = [x.encode("utf-8", "surrogatepass").split() for x in texts]
    sizes = np.fromiter(map(len, cut), np.int64, len(cut))
    digest = xxhash.xxh3_64_intdigest
    return np.fromiter((digest(w) for x in cut for w in x), np.uint64, int(sizes.sum())), sizes


def seeds_of(words: np.ndarray, sizes: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """The places of the seeds of all windows that lie in one document, and the seeds' hashes."""
    doc = np.repeat(np.arange(len(sizes)), sizes)
    pieces, width, low = _joined(words, SEED_WORDS, 0), window - SEED_WORDS + 1, np.uint64((1 << _BITS) - 1)
    found = [np.zeros(0, np.int64)]
    for lo in range(0, max(0, len(words) - window + 1), _SLICE):
        part = pieces[lo : lo + _SLICE + width - 1]
        least, have = part & ~low | np.arange(len(part), dtype=np.uint64), 1
        while 2 * have <= width:
            least, have = np.minimum(least[:-have], least[have:]), 2 * have
        if have < width:
            least = np.minimum(least[: len(part) - width + 1], least[width - have :])
        inside = doc[lo : lo + len(least)] == doc[lo + window - 1 : lo + window - 1 + len(least)]
        found.append(np.unique((least[inside] & low).astype(np.int64)) + lo)
    at = np.unique(np.concatenate(found))
    return at, pieces[at]


def _hulls(words: np.ndarray, at: np.ndarray, begin: np.ndarray, end: np.ndarray, window: int) -> np.ndarray:
    """A hash of the words that windows around a seed can take in, within the document from begin to end."""
    h = np.zeros(len(at), np.uint64)
    for j in range(SEED_WORDS - window, window):
        k = at + j
        inside = (k >= begin) & (k < end)
        word = np.where(inside, words[np.clip(k, 0, len(words) - 1)], np.uint64(0))
        h += _scrambled(word ^ _MIX[0, j + window]) * _MIX[1, j + window]
    return _scrambled(h)


def _seeds(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The seeds of each document, with place and hull."""
        for batch in batches:
            docs, tags, texts = batch.column("doc").to_numpy(), batch.column("tag").to_numpy(), batch.column("text").to_pylist()
            for lo, hi in steps(texts, 1_000_000):
                words, sizes = _word_hashes(texts[lo:hi])
                ends = np.cumsum(sizes)
                at, seeds = seeds_of(words, sizes, window)
                doc = np.searchsorted(ends, at, side="right")
                begin = (ends - sizes)[doc]
                hulls = _hulls(words, at, begin, ends[doc], window)
                yield pa.RecordBatch.from_arrays([pa.array(seeds.view(np.int64)), pa.array(hulls.view(np.int64)), pa.array(docs[lo:hi][doc]), pa.array(tags[lo:hi][doc]), pa.array((at - begin).astype(np.int32))], ["seed", "hull", "doc", "tag", "pos"])

    return run


def _windows(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The windows around the seeds asked for."""
        for batch in batches:
            docs, tags, texts, asks = batch.column("doc").to_numpy(), batch.column("tag").to_numpy(), batch.column("text").to_pylist(), batch.column("asks")
            for lo, hi in steps(texts, 1_000_000):
                words, sizes = _word_hashes(texts[lo:hi])
                begin = np.cumsum(sizes) - sizes
                part = asks.slice(lo, hi - lo)
                doc = np.repeat(np.arange(hi - lo), np.diff(np.asarray(part.offsets)))
                at = part.flatten().to_numpy().astype(np.int64) + begin[doc]
                around = np.arange(SEED_WORDS - window, 1)
                starts, doc = (at[:, None] + around).ravel(), np.repeat(doc, len(around))
                good = (starts >= begin[doc]) & (starts + window <= begin[doc] + sizes[doc])
                starts, first = np.unique(starts[good], return_index=True)
                doc = doc[good][first]
                h1, h2 = (_joined(words, window, lane)[starts].view(np.int64) for lane in (0, 1))
                yield pa.RecordBatch.from_arrays([pa.array(h1), pa.array(h2), pa.array(docs[lo:hi][doc]), pa.array(tags[lo:hi][doc]), pa.array((starts - begin[doc]).astype(np.int32))], ["h1", "h2", "doc", "tag", "pos"])

    return run


def repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` as of ``rows.keyed``. The stretches of words to remove of each: doc, tag, cuts (array of lo, hi; they
    may overlap, and hi may lie past the end)."""
    every = written(docs.select("doc", "tag", "text").mapInArrow(tidy(_seeds(window)), "seed long, hull long, doc long, tag long, pos int"), "repeat-seeds")
    shared = written(every.groupBy("seed").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi")).filter("lo < hi").select("seed"), "repeat-shared")
    places = written(every.join(shared, "seed"), "repeat-places")
    discard(every, shared)
    hulls = written(places.groupBy("seed", "hull").agg(F.min("doc").alias("first")), "repeat-hulls")
    several = hulls.join(hulls.groupBy("seed").agg(F.count(F.lit(1)).alias("kinds")), "seed")
    judged = written(places.join(several, ["seed", "hull"]).filter("doc > first or kinds > 1").select("doc", "tag", "pos", (F.col("doc") > F.col("first")).alias("whole")), "repeat-judged")
    discard(places, hulls)
    ready = judged.filter("whole").select("doc", "tag", F.greatest(F.col("pos") + (SEED_WORDS - window), F.lit(0)).alias("lo"), (F.col("pos") + window).alias("hi"))
    asks = judged.filter("not whole").groupBy("doc", "tag").agg(F.collect_set("pos").alias("asks"))
    found = docs.select("doc", "tag", "text").join(asks, ["doc", "tag"]).mapInArrow(tidy(_windows(window)), "h1 long, h2 long, doc long, tag long, pos int")
    found = written(found, "repeat-windows")
    first = found.groupBy("h1", "h2").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi")).filter("lo < hi").select("h1", "h2", "lo")
    single = found.join(first, ["h1", "h2"]).filter(F.col("doc") > F.col("lo")).select("doc", "tag", F.col("pos").alias("lo"), (F.col("pos") + window).alias("hi"))
    out = written(ready.unionByName(single).groupBy("doc", "tag").agg(F.collect_set(F.struct("lo", "hi")).alias("cuts")), "repeat-cuts")
    discard(judged, found)
    return out


def _cutter(keep_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc_id, text, cuts in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "cuts")), strict=True):
                words = text.encode("utf-8", "surrogatepass").split()
                total, end = len(words), 0
                if cuts:
                    kept = []
                    for lo, hi in sorted((c["lo"], c["hi"]) for c in cuts):
                        if lo > end:
                            kept += words[end:lo]
                        end = max(end, hi)
                    words = kept + words[end:]
                joined = b" ".join(words)
                out.append((doc_id, total, total - len(words), hashlib.sha256(joined).hexdigest(), *([joined.decode("utf-8", "surrogatepass")] if keep_text else [])))
            kinds = [pa.int64()] * 3 + [pa.string()] * (1 + keep_text)
            columns = zip(*out, strict=True) if out else [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "n_words", "n_removed", "kept_sha256", *(["kept"] if keep_text else [])])

    return run


def deduplicate(docs: DataFrame, window: int = WINDOW, keep_text: bool = False) -> DataFrame:
    """Per document: doc_id, n_words, n_removed, kept_sha256, and with keep_text the kept words."""
    if not SEED_WORDS <= window <= 32:
        raise ValueError(f"a window has {SEED_WORDS} to 32 words")
    ensure_importable(docs.sparkSession)
    rows = keyed(docs)
    cuts = repeats(rows, window)
    kind = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept string" * keep_text
    return rows.join(cuts, ["doc", "tag"], "left").select("doc_id", "text", "cuts").mapInArrow(tidy(_cutter(keep_text)), kind)
