"""SimHash near-duplicates, all links within a Hamming distance of 3, through anchor points.

Of two 64-bit fingerprints at distance 3 or less, one of the 32-bit halves differs in at most one bit. A half's
anchors are the words of a covering code: the perfect Hamming code of length 31 (covering radius 1) with the last bit
free. Each fingerprint is at home at its half's anchor within the radius, and copied to every anchor within radius
plus one (17 at most), so for any link one end is at home where the other end has a copy. Per anchor, only homes are
compared with copies, by all 64 bits, and only a forest of the links found is given out: as many rows as members,
whatever their links. Equal fingerprints are one node from the start. Anchors with very many homes are divided into
shares of homes, to each of which all copies go, so no comparison is lost and no task holds a whole anchor.

``representatives`` serves deduplication by likeness, for which 3 of 64 bits are too few: five-word shingles that are 0.8
alike by Jaccard differ in 4 to 15 bits. There a fingerprint has four segments of 32 bits, over a text's distinct words,
and 128 bits over its five-word shingles. Texts meet at the anchors of a segment, where one bit of 32 may differ, and
are linked where at most 24 of the 128 bits differ, which is what a likeness of 0.8 comes to with room for chance.

Defined cases: a null or blank text has fingerprint zero, linked like any other; a text with fewer words than a
shingle is one shingle; repeated rows share a component; null doc_ids are kept and never name a component that has
other ids; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import tidy, written
from lodestone.llm.components import components
from lodestone.session import ensure_importable

WORDS, SEED, NEAR = 5, 42, 3
#: Longs of a wide fingerprint: two with a segment in each half, and two over shingles; bits of the latter that may differ.
SEGMENTS, SHINGLES, ALIKE = 2, 2, 24
SEEN, HELD = [f"s{i}" for i in range(SEGMENTS)], [f"w{i}" for i in range(SHINGLES)]
FULL = SEEN + HELD
#: Homes of an anchor that one task compares at once.
SHARE = 4096
_SYNDROME = np.arange(1, 32, dtype=np.uint32)  # the check word of each of the 31 coded bits


def _shingles(text: str | None, words: int) -> tuple[list[bytes], np.ndarray]:
    """A text's words, and the hashes of its shingles, repeats included."""
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    joined = b" ".join(parts)
    if len(parts) <= words:
        return parts, np.array([xxhash.xxh64_intdigest(joined, SEED)][: len(parts)], np.uint64)
    ends = list(accumulate(map(len, parts), lambda a, n: a + n + 1))
    starts = [0, *(e + 1 for e in ends[:-1])]
    digest = xxhash.xxh64_intdigest
    return parts, np.array([digest(joined[s:e], SEED) for s, e in zip(starts, ends[words - 1 :], strict=False)], np.uint64)


def _majority(hashes: np.ndarray) -> np.ndarray:
    """``hashes``: rows of longs. The longs whose bits are set in over half the rows."""
    bits, few = np.zeros(64 * hashes.shape[1], np.int64), 255  # rows that a byte can count
    for lo in range(0, len(hashes), 1 << 14):
        each = np.unpackbits(np.ascontiguousarray(hashes[lo : lo + (1 << 14)], "<u8").view(np.uint8), axis=1, bitorder="little")
        for at in range(0, len(each), few):
            bits += np.add.reduce(each[at : at + few], axis=0, dtype=np.uint8)
    return np.packbits(2 * bits > len(hashes), bitorder="little").view("<u8")


def fingerprint(text: str | None, words: int = WORDS) -> int:
    return int(_majority(_shingles(text, words)[1][:, None])[0])


def _spun(hashes: np.ndarray, n: int) -> np.ndarray:
    """Rows of n longs of each hash."""
    steps = hashes[:, None] + np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    steps = (steps ^ (steps >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    steps = (steps ^ (steps >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return steps ^ (steps >> np.uint64(31))


def wide_fingerprint(text: str | None, words: int = WORDS) -> np.ndarray:
    """Longs over the distinct words, whose halves are segments, and longs over the shingles."""
    parts, shingles = _shingles(text, words)
    once = np.array([xxhash.xxh64_intdigest(w, SEED) for w in set(parts)], np.uint64)
    return np.concatenate([_majority(_spun(once, SEGMENTS)), _majority(_spun(shingles, SHINGLES))])


def _fingerprints(words: int, keep: tuple[str, ...] = ("doc_id",)):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(x, words) for x in batch.column("text").to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array(found.view(np.int64))], [*keep, "fp"])

    return run


def _wide(words: int, keep: tuple[str, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([wide_fingerprint(x, words) for x in batch.column("text").to_pylist()], np.uint64).reshape(-1, SEGMENTS + SHINGLES)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], *[pa.array(c.view(np.int64)) for c in np.ascontiguousarray(found.T)]], [*keep, *FULL])

    return run


def _syndromes(half: np.ndarray) -> np.ndarray:
    out = np.zeros(half.shape, np.uint32)
    for bit, check in enumerate(_SYNDROME):
        out ^= np.where(half >> np.uint32(bit) & np.uint32(1), check, np.uint32(0))
    return out


def anchors(half: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Anchors of 32-bit halves: n rows of 17, of which the first is the home; and which of them count."""
    one = np.concatenate([[np.uint32(0)], np.uint32(1) << np.arange(31, dtype=np.uint32)])  # the flip for each check word
    s = _syndromes(half)
    home = half ^ one[s]
    out, count = np.empty((len(half), 17), np.uint32), np.zeros((len(half), 17), bool)
    out[:, 0], count[:, 0] = home, True
    out[:, 1], count[:, 1] = home ^ np.uint32(1 << 31), True  # the free bit is the one that differs
    # Code words at distance 2: flip two bits whose check words add up to s; for s = 0 there are none.
    fill = np.full(len(half), 2)
    for a in range(1, 32):
        b = s ^ np.uint32(a)
        good = np.flatnonzero((b > a) & (s != 0))
        out[good, fill[good]], count[good, fill[good]] = half[good] ^ one[a] ^ one[b[good]], True
        fill[good] += 1
    return out, count


def _carried(held: list[str]) -> list[str]:
    return list(dict.fromkeys(["node", *held]))


def _spread(seen: list[str], held: list[str]):
    """Rows for the anchors of each half of the longs ``seen``, with the node and the longs ``held``."""

    names = _carried(held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(at, 4096) for b in batches for at in range(0, b.num_rows, 4096)):
            rest = [batch.column(c).to_numpy() for c in names]
            for k, column in enumerate(seen):
                fps = batch.column(column).to_numpy().view(np.uint64)
                for side in (0, 1):
                    half = (fps >> np.uint64(32 * side) & np.uint64(0xFFFFFFFF)).astype(np.uint32)
                    at, count = anchors(half)
                    row, col = np.nonzero(count)
                    key = at[row, col].astype(np.int64) << 8 | 2 * k + side
                    yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(col == 0), *[pa.array(x[row]) for x in rest]], ["anchor", "home", *names])

    return run


def _links(homes: np.ndarray, copies: np.ndarray, near: int, out: list[tuple[int, int]]) -> None:
    """Rows of a node and the longs that are compared. Links that connect all homes and copies which links between
    them connect: at most one for each row."""
    if len(homes) * len(copies) <= 64 and homes.shape[1] == 2:
        known = copies.tolist()
        for n, h in homes.tolist():
            out += [(n, m) for m, c in known if m != n and (h ^ c).bit_count() <= near]
        return
    step = max(1, 4_000_000 // len(homes))
    for lo in range(0, len(copies), step):
        part = copies[lo : lo + step]
        differ = np.bitwise_count(homes[:, None, 1] ^ part[None, :, 1])
        for k in range(2, homes.shape[1]):
            differ = differ + np.bitwise_count(homes[:, None, k] ^ part[None, :, k])
        h, c = np.nonzero(differ <= near)
        tree, leaf = np.arange(len(homes)), np.full(len(part), len(homes))
        while True:
            np.minimum.at(leaf, c, tree[h])
            after = tree.copy()
            np.minimum.at(after, h, leaf[c])
            if np.array_equal(after, tree):
                break
            tree = after
        for rows, labels in ((homes[:, 0], tree), (part[:, 0], leaf)):
            linked = np.flatnonzero(labels < len(homes))
            roots = homes[labels[linked], 0]
            differ = roots != rows[linked]
            out += zip(roots[differ].tolist(), rows[linked][differ].tolist(), strict=True)


def _compare(near: int, held: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by anchor and share, homes first."""
        key, homes = None, []
        for batch in batches:
            anchor, share = batch.column("anchor").to_numpy(), batch.column("share").to_numpy()
            home = batch.column("home").to_numpy(zero_copy_only=False).astype(bool)
            fps = np.stack([batch.column(c).to_numpy().view(np.uint64) for c in ("node", *held)], axis=1)
            out: list[tuple[int, int]] = []
            cuts = np.flatnonzero((np.diff(anchor) != 0) | (np.diff(share) != 0)) + 1
            lows, highs = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(fps)]])
            # A group of one row has nothing to compare, unless it goes on from the last batch or into the next.
            many = (highs - lows > 1) & home[lows] | (lows == 0) | (highs == len(fps)) if len(fps) else lows < 0
            for lo, hi in zip(lows[many].tolist(), highs[many].tolist(), strict=True):
                if lo == hi:
                    continue
                if (anchor[lo], share[lo]) != key:
                    key, homes = (anchor[lo], share[lo]), []
                mine, copies = fps[lo:hi][home[lo:hi]], fps[lo:hi]
                homes += [mine] if len(mine) else []
                if homes:
                    _links(np.concatenate(homes), copies, near, out)
            pairs = np.array(out, np.uint64).reshape(-1, 2).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], ["a", "b"])

    return run


def _classes(marked: DataFrame, key: list[str], seen: list[str], held: list[str], near: int, share: int) -> DataFrame:
    """``marked``: doc_id and the longs of ``key``. Per fingerprint: the longs, root, component_id.

    A node is a fingerprint: named by its long if it has only one, else by a number.
    """
    each = marked.groupBy(*key).agg(F.min("doc_id").alias("least"))
    nodes = written(each.withColumn("node", F.col(key[0]) if len(key) == 1 else F.monotonically_increasing_id()), "simhash-nodes")
    kinds = "anchor long, home boolean" + "".join(f", {c} long" for c in _carried(held))
    spread = nodes.select(*dict.fromkeys([*_carried(held), *seen])).mapInArrow(tidy(_spread(seen, held)), kinds)
    # Only anchors with over a share of homes, if any, need more shares.
    crowded = written(spread.filter("home").groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > share), "simhash-crowded")
    if crowded.isEmpty():
        dealt = spread.withColumn("share", F.lit(0))
    else:
        joined = spread.join(crowded.withColumn("shares", F.ceil(F.col("n") / share).cast("int")).drop("n"), "anchor", "left").withColumn("shares", F.coalesce("shares", F.lit(1)))
        own = F.pmod(F.xxhash64("node"), F.col("shares")).cast("int")
        every = F.sequence(F.lit(0), F.col("shares") - 1)
        # A home is compared within its share; as a copy it goes to all the others too.
        dealt = joined.withColumn("share", F.explode(every)).withColumn("home", F.col("home") & (F.col("share") == own)).drop("shares")
    grouped = dealt.repartition("anchor", "share").sortWithinPartitions("anchor", "share", F.col("home").desc())
    roots = components(grouped.select("anchor", "share", "home", *_carried(held)).mapInArrow(tidy(_compare(near, held)), "a long, b long"))
    roots = roots.withColumnRenamed("node", "member")
    placed = nodes.join(roots, nodes["node"] == roots["member"], "left").select(*key, "least", F.coalesce("root", nodes["node"]).alias("root"))
    placed = written(placed, "simhash-roots")
    # Written, so that both sides of the join come from shuffles of their own, of which large partitions can be split.
    tops = written(placed.groupBy("root").agg(F.min("least").alias("component_id")), "simhash-tops")
    return placed.select(*key, "root").join(tops, "root").select(*key, "root", "component_id")


def _marked(docs: DataFrame, words: int) -> DataFrame:
    ensure_importable(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return written(rows.mapInArrow(tidy(_fingerprints(words)), "doc_id long, fp long"), "simhash")


def near_duplicates(docs: DataFrame, words: int = WORDS, near: int = NEAR, share: int = SHARE) -> DataFrame:
    """Per document: doc_id, fp (bigint), component_id."""
    if near > 3:
        raise ValueError("the anchors cover distances up to 3")
    marked = _marked(docs, words)
    return marked.join(_classes(marked, ["fp"], ["node"], ["node"], near, share), "fp").select("doc_id", "fp", "component_id")


def representatives(docs: DataFrame, words: int = WORDS, alike: int = ALIKE, share: int = SHARE) -> DataFrame:
    """The rows of ``docs`` that stay: of each component of texts that are alike, one with its smallest doc_id, whole.

    Of rows with that id, the one with the smallest hash of its text stays; of these, the first by all columns. A
    component whose ids are all null keeps one row.
    """
    words_of = docs.select("doc_id", "text", F.xxhash64("text").alias("_t"))
    ensure_importable(docs.sparkSession)
    kind = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, _t long" + "".join(f", {c} long" for c in FULL)
    marked = written(words_of.mapInArrow(tidy(_wide(words, ("doc_id", "_t"))), kind), "simhash")
    classes = _classes(marked.select(F.col("doc_id").cast("long").alias("doc_id"), *FULL), FULL, SEEN, HELD, alike, share)
    lead = marked.join(classes, FULL).filter(F.col("doc_id").eqNullSafe(F.col("component_id")))
    stay = written(lead.groupBy("root", "doc_id").agg(F.min("_t").alias("_t"), F.count(F.lit(1)).alias("n")), "simhash-stay")
    left = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), "doc_id", F.xxhash64("text").alias("_t")).alias("d")
    kept = left.join(stay.alias("s"), F.col("d.doc_id").eqNullSafe(F.col("s.doc_id")) & (F.col("d._t") == F.col("s._t"))).select("d.*")
    if not stay.filter("n > 1").isEmpty():  # an id repeats: of equal rows, one
        same = Window.partitionBy("doc_id", "_t").orderBy(F.to_json("row"))
        kept = kept.withColumn("_n", F.row_number().over(same)).filter("_n = 1").drop("_n")
    return kept.select("row.*")


def hex_digits(column: str):
    return F.lpad(F.lower(F.hex(column)), 16, "0")
