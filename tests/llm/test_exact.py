"""Mixing, fingerprints, search, packing and token files, against brute force or round trips."""

import base64
import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from conftest import ODD
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lodestone.llm import entries, fingerprint, mixing, mtree, packing, rangecoder, token_file, tokens

SPACES = " \t\n\x0b\x0c\r"


def words(text):
    for c in SPACES[1:]:
        text = (text or "").replace(c, " ")
    return [w for w in (text or "").split(" ") if w]


def filled(sizes, share, weights=(5, 2, 1)):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, open_ = {}, set(names)
    left = share * sum(sizes.values())
    while open_:
        total = sum(weight[s] for s in open_)
        over = {s for s in open_ if left * weight[s] / total > 2 * sizes[s]}
        if not over:
            target |= {s: left * weight[s] / total for s in open_}
            break
        for s in over:
            target[s] = 2.0 * sizes[s]
        left -= sum(target[s] for s in over)
        open_ -= over
    return target


def check_mix(rows, docs):
    sizes = defaultdict(int)
    for _, text, _, source in docs:
        sizes[source] += len(words(text))
    target, taken = filled(sizes, 1.5), defaultdict(int)
    assert len(rows) == len(docs)
    largest = max(len(words(t)) for _, t, _, _ in docs)
    for r in rows:
        assert r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(target[r["source"]])
        assert r["taken"] in (0, r["size"], 2 * r["size"])
        taken[r["source"]] += r["taken"]
    for s in sizes:
        assert abs(taken[s] - target[s]) <= largest / 2 + 1


def test_mix_odd(odd, none):
    rows = mixing.plan(odd).collect()
    check_mix(rows, ODD)
    assert sorted(map(str, rows)) == sorted(map(str, mixing.plan(odd).collect()))
    mixed = mixing.mix(odd)
    assert mixed.columns == odd.columns
    assert mixed.count() == sum(r["repeats"] for r in rows)
    assert mixing.plan(none).count() == 0 and mixing.mix(none).count() == 0


def test_mix_random(spark):
    r = random.Random(1)
    docs = [(i, " ".join(["w"] * int(r.paretovariate(1.1))), None, r.choice(["a", "b", "c", "d", "é", None, "Z"])) for i in range(3000)]
    df = spark.createDataFrame([(a, b, d) for a, b, _, d in docs], "doc_id long, text string, source string")
    check_mix(mixing.plan(df).collect(), docs)


def test_mix_clamps(spark):
    df = spark.createDataFrame([("a", 100), ("b", 10_000), ("c", 0), (None, 50)], "source string, source_size long")
    got = {r["source"]: r["target"] for r in mixing.targets(df, (5, 2, 1), 1.5, 2.0).collect()}
    want = filled({"a": 100, "b": 10_000, "c": 0, None: 50}, 1.5)
    assert got == pytest.approx(want)


def slow_sketch(text, k=fingerprint.K):
    """Spark's xxhash64 of each word, chained over each five words' hashes; the k smallest of their upper 40 bits."""
    w = words(text)
    each = [xxhash.xxh64_intdigest(x.encode(), 42) for x in w]
    if not w:
        found = []
    elif len(w) < 5:
        found = [xxhash.xxh64_intdigest(" ".join(w).encode(), 42)]
    else:
        found = []
        for i in range(len(w) - 4):
            h = 42
            for x in each[i : i + 5]:
                h = xxhash.xxh64_intdigest(x.to_bytes(8, "little"), h)
            found.append(h)
    return sorted({h >> 24 for h in found})[:k]


def slow_likeness(a, b, k=fingerprint.K):
    merged = sorted({*a, *b})[:k]
    return len({*a} & {*b} & {*merged}) / len(merged) if merged else 1.0


def check_edited(rows, docs):
    order = sorted(docs, key=lambda d: (d[0] if d[0] is not None else -(1 << 63), d[1] or ""), reverse=True)
    want = defaultdict(list)
    for i, (doc_id, text, *_) in enumerate(order):
        a, b = text or "", order[(i + 1) % len(order)][1] or ""
        k = len(a) // 3
        edited = a[: len(a) - k] + b[:k]
        one, two, three = (slow_sketch(x) for x in (a, edited, b))
        shown = [base64.b64encode(b"".join(h.to_bytes(5, "big") for h in x)).decode() for x in (one, two)]
        want[doc_id].append((len(a), hashlib.sha256(edited.encode()).hexdigest(), *shown, round(slow_likeness(one, two), 9), round(slow_likeness(one, three), 9)))
    got = defaultdict(list)
    for r in rows:
        got[r["doc_id"]].append((r["n_chars"], r["edited_sha256"], r["fingerprint"], r["edited_fingerprint"], round(r["near_edited"], 9), round(r["near_next"], 9)))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}


def test_fingerprints_odd(odd, none):
    rows = fingerprint.edited_pairs(odd).collect()
    check_edited(rows, ODD)
    by = defaultdict(set)
    for r in rows:
        by[r["doc_id"]].add(r["fingerprint"])
    assert by[1] == by[2] == by[3] == {""}
    assert by[5] == by[7] and len(by[10]) == 1
    assert fingerprint.edited_pairs(none).count() == 0


def test_fingerprints_one(spark):
    docs = [(7, "a b c d e f g h i", None, None)]
    check_edited(fingerprint.edited_pairs(spark.createDataFrame([docs[0][:2]], "doc_id long, text string")).collect(), docs)


def test_fingerprints_tables(spark, small):
    docs = [tuple(r) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()]
    check_edited(entries.op9_fingerprints(spark, small).collect(), docs)


def test_fingerprint_estimates(spark):
    r = random.Random(2)
    base = [str(r.random()) for _ in range(4000)]
    texts = {"a": base[:3000], "b": base[1000:], "small": base[:20], "same": base[:3000]}
    df = fingerprint.with_sketch(spark.createDataFrame([(k, " ".join(v)) for k, v in texts.items()], "k string, text string"), "text", "s")
    sets = {k: {tuple(v[i : i + 5]) for i in range(len(v) - 4)} for k, v in texts.items()}
    pairs = df.alias("x").crossJoin(df.alias("y")).select("x.k", F.col("y.k").alias("l"), F.col("x.s").alias("p"), F.col("y.s").alias("q"))
    for row in pairs.select("k", "l", fingerprint.resemblance("p", "q").alias("j"), fingerprint.containment("p", "q").alias("c"), fingerprint.distinct_shingles("p").alias("n")).collect():
        a, b = sets[row["k"]], sets[row["l"]]
        assert row["j"] == pytest.approx(len(a & b) / len(a | b), abs=0.15)
        assert row["n"] == pytest.approx(len(a), rel=0.3)
        if row["k"] != "small":
            assert row["c"] == pytest.approx(len(a & b) / len(a), abs=0.35)
    # Sketches of parts, each with the shingles of its own, merge into the sketch of all.
    halves = fingerprint.with_sketch(spark.createDataFrame([(" ".join(base[:2004]),), (" ".join(base[2000:]),)], "text string"), "text", "s")
    whole = fingerprint.with_sketch(spark.createDataFrame([(" ".join(base),)], "text string"), "text", "s").head()["s"]
    assert halves.agg(fingerprint.merged("s").alias("s")).head()["s"] == whole


def brute_topk(rows, k):
    out = []
    seen = sorted({(i, tuple(v)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)})
    for i, v in seen:
        if i % 20 == 0:
            scores = sorted((-sum(int(a) * int(b) for a, b in zip(v, w)), j) for j, w in seen if j != i)[:k]
            out += [(i, n, j, -s) for n, (s, j) in enumerate(scores, 1)]
    return sorted(out)


def test_topk(spark):
    r = random.Random(3)
    rows = [(i, [float(r.randint(-4, 4)) for _ in range(5)]) for i in range(400)]
    rows += [(400 + i, rows[0][1]) for i in range(60)] + [rows[20]]
    rows += [(1001, None), (1020, [1.0, None, 2.0, 0.0, 0.0]), (1040, [float("nan")] * 5), (1060, [float("inf")] * 5), (1080, []), (None, [1.0] * 5)]
    df = spark.createDataFrame(rows, "vec_id long, v array<double>")
    clashing = df.select("*", *[F.lit(1).alias(c) for c in ("cell", "part", "ask", "gap", "least", "rank", "query_id", "score")])
    for given, tree_rows, page, sample in ((df, 10_000, 1024, 4096), (clashing, 50, 8, 100), (df, 50, 8, 5)):
        got = mtree.search(given, F.col("vec_id") % 20 == 0, 20, tree_rows, page, sample=sample)
        assert sorted(map(tuple, got.select("query_id", "rank", "vec_id", "score").collect())) == brute_topk(rows, 20)
    few = spark.createDataFrame(rows[:3], df.schema)
    assert sorted(map(tuple, mtree.search(few, F.col("vec_id") % 20 == 0).collect())) == brute_topk(rows[:3], 20)
    assert mtree.search(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


@pytest.mark.parametrize("kind", ["float", "double"])
def test_topk_entry(spark, tmp_path, kind):
    r = random.Random(4)
    nan, inf = float("nan"), float("inf")
    rows = [(i, [r.randint(-99, 99) / 128 for _ in range(5)]) for i in range(200)]
    rows += [(1000, [nan] * 5), (1001, [0.5, inf, 0.5, 0.5, 0.5]), (1002, [0.5, -inf, 0.5, 0.5, 0.5]), (1020, [inf] * 5), (1040, [0.5, 0.5, nan, 0.5, 0.5]), (1060, [0.5, None, 0.5, 0.5, 0.5]), (1080, []), (1100, None), (None, [0.5] * 5)]
    spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>").write.parquet(f"{tmp_path}/embeddings.parquet")
    whole = [(i, v and [np.floor(64 * x) if x is not None and np.isfinite(x) else None for x in v]) for i, v in rows]
    got = entries.op10_topk(spark, str(tmp_path)).select("query_id", "rank", "vec_id", "score").collect()
    assert sorted(map(tuple, got)) == brute_topk(whole, 20)


@pytest.mark.parametrize("scale", [1, 1e7])
def test_tree(scale):
    g = np.random.default_rng(4)
    x = np.floor(g.standard_normal((700, 8)) * 40 * scale)
    ids = g.permutation(2000)[:700]
    tree = mtree.MTree(ids, x, page=32)
    for (found, score), q, own in zip(tree.search_many(x[::9], ids[::9], 10), x[::9], ids[::9]):
        exact = x.astype(np.int64) @ q.astype(np.int64)
        m = ids != own
        best = np.lexsort((ids[m], -exact[m]))[:10]
        assert found.tolist() == ids[m][best].tolist() and score.tolist() == exact[m][best].tolist()
        single = tree.search(q, own, 10)
        assert single[0].tolist() == found.tolist()


def clustered(g, clusters, each, width=16, spread=3):
    centres = np.repeat(g.standard_normal((clusters, width)) * 40, each, axis=0)
    return np.floor(centres + g.standard_normal(centres.shape) * spread)


def test_tree_prunes():
    """Of vectors in clusters only a part is compared; best-first search one by one compares fewer still."""
    g = np.random.default_rng(6)
    x = clustered(g, 40, 100)[g.permutation(4000)]
    ids = np.arange(4000)
    shares = []
    for many in (True, False):
        tree = mtree.MTree(ids, x, page=64)
        tree.computed = 0
        asked = np.arange(0, 4000, 20)
        found = tree.search_many(x[asked], asked, 20) if many else [tree.search(x[i], i, 20) for i in asked]
        shares.append(tree.computed / (len(asked) * len(x)))
        score = (x @ x.T).astype(np.int64)
        for i, (near, _) in zip(asked, found, strict=True):
            rest = ids[ids != i]
            assert near.tolist() == rest[np.lexsort((rest, -score[i, rest]))[:20]].tolist()
    assert max(shares) < 0.25, shares


def test_cells_prune(spark):
    """Queries go only to cells in reach, and the result is whole."""
    g = np.random.default_rng(7)
    x = clustered(g, 20, 100)
    rows = [(int(i), v.tolist()) for i, v in zip(g.permutation(2000), x, strict=True)]
    top = float((x**2).sum(axis=1).max())
    pivots = mtree.pivots_of(x, 20, top)
    gaps = mtree._gaps(x, np.sqrt(top - (x**2).sum(axis=1)), pivots)
    owner = gaps.argmin(axis=1)
    radius = np.array([gaps[owner == c, c].max(initial=0) for c in range(len(pivots))])
    asked, least = x[::20], np.sort(x @ x[::20].T, axis=0)[-21]
    batch = pa.RecordBatch.from_arrays([pa.array(range(100)), pa.array(asked.tolist(), pa.list_(pa.float64())), pa.array(least)], ["vec_id", "v", "least"])
    sent = sum(b.num_rows for b in mtree._router(pivots, top, radius, np.ones(len(pivots), np.int64))([batch]))
    assert 100 <= sent < 0.4 * 100 * len(pivots)
    got = mtree.search(spark.createDataFrame(rows, "vec_id long, v array<double>"), F.col("vec_id") % 20 == 0, tree_rows=100, page=32)
    assert sorted(map(tuple, got.collect())) == brute_topk(rows, 20)


def test_encoder():
    coder = tokens.Encoder(tokens.default_path())
    texts = ["a   b", "a \n b", "x\n \n y", "  lead", "trail  ", "a  b", " ", "", "it's  ok <|endoftext|> yes", "a\x00 b", "1 \t 2", "né  　 x", "word " * 300]
    for c in (coder, tokens.Encoder(tokens.default_path(), 3)):
        flat, n = c.encode(texts)
        at = np.cumsum(n) - n
        for t, a, k in zip(texts, at, n):
            assert flat[a : a + k].tolist() == coder.tokenizer.encode(t, add_special_tokens=False).ids


def test_encoder_against_the_library():
    fresh = Tokenizer.from_file(tokens.default_path())
    r = random.Random(5)
    parts = ["a", "Bc", " ", "  ", "\n", "\t", "'", "'s", "'LL", "'re", ".", ",", "!", "-", "1", "23", "é", "ß", "—", "\u2003", "\u3000", "\u200b", "\x00", "\x1c", "\x85", "中文", "😀", "²", "½", " the", "don't", "<|endoftext|>", "x" * 20, "Ġ", "_", "@"]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 14))) for _ in range(20_000)]
    want = [x.ids for x in fresh.encode_batch(texts, add_special_tokens=False)]
    for memo in (tokens.MEMO_PIECES, 300):
        coder, got = tokens.Encoder(tokens.default_path(), memo), []
        for _, _, flat, counts in coder.encode_column(pa.array(texts)):
            got += [x.tolist() for x in np.split(flat, np.cumsum(counts)[:-1])]
        assert got == want
    long = " ".join(texts) * 30  # cut into steps
    assert len(long.encode()) > tokens.LONG_BYTES
    flat, counts = tokens.Encoder(tokens.default_path()).encode([long])
    assert flat.tolist() == fresh.encode(long, add_special_tokens=False).ids and counts.tolist() == [len(flat)]


def test_added_tokens(spark):
    fresh = Tokenizer.from_file(tokens.default_path())  # as the library loads it
    texts = ["it's  ok <|endoftext|> yes", "<|endoftext|>", "a<|endoftext|>b <|endoftext|>", " \n <|endoftext|> \n x", "<|endoftext| > and <|endof text|>", "plain words", "\x00<|endoftext|>"]
    want = [fresh.encode(x, add_special_tokens=False).ids for x in texts]
    assert sum(50256 in x for x in want) == 5
    for memo in (tokens.MEMO_PIECES, 3):
        flat, n = tokens.Encoder(tokens.default_path(), memo).encode(texts)
        assert [x.tolist() for x in np.split(flat, np.cumsum(n)[:-1])] == want
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    packed = {r["doc_id"]: (r["doc_tokens"], r["ids_crc32"]) for r in packing.pack(docs, end_id=1).collect()}
    assert packed == {i: (len(x) + 1, zlib.crc32(np.array([*x, 1], "<u4").tobytes())) for i, x in enumerate(want)}
    filed = {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in token_file.read_shards(token_file.write_shards(docs)).collect()}
    starts = np.cumsum([0, *[len(x) + 1 for x in want]]).tolist()
    assert filed == {i: (starts[i], len(x) + 1, zlib.crc32(np.array([*x, 2], "<u4").tobytes())) for i, x in enumerate(want)}


def ids_of(text, end, fresh=Tokenizer.from_file(tokens.default_path())):
    return np.array([*fresh.encode(text or "", add_special_tokens=False).ids, end], "<u4")


def test_packing(odd, none):
    rows = packing.pack(odd).collect()
    pieces, packs = defaultdict(list), defaultdict(list)
    for r in rows:
        packs[r["sequence_id"]].append((r["offset"], r["length"]))
        pieces[r["doc_id"]].append(r)
    for text_id, text, *_ in ODD:
        ids, mine = ids_of(text, 1), sorted(pieces[text_id], key=lambda r: r["start"])
        if text_id != 10:
            assert [r["start"] for r in mine] == np.cumsum([0, *[r["length"] for r in mine]])[:-1].tolist()
        assert {r["doc_tokens"] for r in mine} == {len(ids)}
        assert all(r["ids_crc32"] == zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes()) for r in mine)
    assert sum(r["length"] for r in rows) == sum(len(ids_of(t, 1)) for _, t, *_ in ODD)
    for got in packs.values():
        at = 0
        for offset, length in sorted(got):
            assert offset == at
            at += length
        assert at <= 2048
    assert packing.pack(none).count() == 0


def test_shortest_pack_first():
    g = np.random.default_rng(5)
    histogram = {int(k): int(v) for k, v in zip(*np.unique(g.integers(1, 2049, 20_000), return_counts=True))}
    places = packing.shortest_pack_first(histogram, 2048)
    held, used = defaultdict(int), defaultdict(int)
    for length, count, _, _ in places:
        held[length] += count
    assert held == histogram
    for length, count, first, _ in places:
        for s in (first, first + count - 1):
            used[s] += length if count > 1 or s == first else 0
    total, n = sum(k * v for k, v in histogram.items()), max(f + c for _, c, f, _ in places)
    assert total / (n * 2048) > 0.98


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 1000])
def test_range_coder(n, block=64):
    g = np.random.default_rng(n)
    ids = np.where(g.random(n) < 0.7, g.integers(0, 20, n), g.integers(0, 65_536, n)).astype(np.uint32)
    blocks = rangecoder.encode(ids, 16, block)
    assert len(blocks) == -(-n // block)
    assert np.array_equal(rangecoder.decode(blocks, n, 16, block), ids)
    for k, data in enumerate(blocks):  # each block alone
        part = ids[k * block : (k + 1) * block]
        assert np.array_equal(rangecoder.decode([data], len(part), 16, block), part)


def test_range_coder_learns():
    ids = np.tile(np.random.default_rng(1).integers(0, 50_000, 50), 40).astype(np.uint32)
    assert 8 * sum(map(len, rangecoder.encode(ids))) / len(ids) < 9


def test_range_coder_beats_order_0():
    """Ids that follow each other by a chain: fewer bits than their frequencies alone would take, and less with a prior."""
    g = np.random.default_rng(2)
    after = g.integers(0, 3000, (3000, 4))
    ids = np.zeros(60_000, np.uint32)
    for i in range(1, len(ids)):
        ids[i] = after[ids[i - 1], min(int(g.exponential(0.8)), 3)] if g.random() < 0.9 else g.integers(0, 3000)
    share = np.bincount(ids)[np.unique(ids)] / len(ids)
    order_0 = float(-(share * np.log2(share)).sum())
    prior = rangecoder.Prior.of(ids)
    assert np.array_equal(rangecoder.Prior.frombytes(prior.tobytes()).span, prior.span)
    blocks = rangecoder.encode(ids, 16, 20_000, prior)
    assert np.array_equal(rangecoder.decode(blocks, len(ids), 16, 20_000, prior), ids)
    taken = [8 * sum(map(len, x)) / len(ids) for x in (blocks, rangecoder.encode(ids, 16, 20_000))]
    assert taken[0] < order_0 - 1 and taken[0] < taken[1]
    with pytest.raises(ValueError):
        rangecoder.encode(np.array([4000]), 16, 64, prior)


def test_file_damage():
    ids = np.arange(3000, dtype=np.uint32)
    file = token_file.pack_file([5, None], np.array([1000, 2000]), ids, 16)
    docs, sizes, back = token_file.unpack_file(file)
    assert docs == [5, None] and sizes.tolist() == [1000, 2000] and np.array_equal(back, ids)
    for at in (0, 9, 40, 60, len(file) // 2, len(file) - 1):
        bad = bytearray(file)
        bad[at] ^= 1
        with pytest.raises((token_file.Damaged, zlib.error)):
            token_file.unpack_file(bytes(bad))


def test_token_files(odd, none):
    got = defaultdict(list)
    for r in token_file.read_shards(token_file.write_shards(odd, shard_ids=150)).collect():
        got[r["doc_id"]].append(r)
    at = 0
    for doc_id, text, *_ in sorted(ODD, key=lambda x: -1 if x[0] is None else x[0]):
        ids = ids_of(text, 2)
        assert any((r["start"], r["n_tokens"], r["ids_crc32"]) == (at, len(ids), zlib.crc32(ids.tobytes())) for r in got[doc_id])
        at += len(ids)
    assert token_file.read_shards(token_file.write_shards(none)).count() == 0
