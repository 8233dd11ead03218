"""SimHash, components, and both substring operators, against brute force."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from conftest import ODD

from lodestone.llm import components, simhash, substring_dedup, suffix_dedup


def slow_fingerprint(text, words=3):
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + words]), 42) for i in range(max(1, len(w) - words + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_wide(text, words=5):
    """Segments over distinct words, and longs over shingles, bit by bit."""
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    shingles = [b" ".join(w[i : i + words]) for i in range(max(1, len(w) - words + 1))] if w else []

    def spun(x, n):
        out = 0
        for k in range(1, n + 1):
            z = (xxhash.xxh64_intdigest(x, 42) + k * 0x9E3779B97F4A7C15) % 2**64
            z = (z ^ z >> 30) * 0xBF58476D1CE4E5B9 % 2**64
            z = (z ^ z >> 27) * 0x94D049BB133111EB % 2**64
            out |= (z ^ z >> 31) << 64 * (k - 1)
        return out

    def most(features):
        h = [spun(x, 2) for x in features]
        return sum(1 << b for b in range(128) if 2 * sum(x >> b & 1 for x in h) > len(h))

    return most(set(w)), most(shingles)


def slow_alike(a, b):
    """Whether two wide fingerprints meet at an anchor of a segment and differ in few bits of the rest."""
    if (a[1] ^ b[1]).bit_count() > simhash.ALIKE:
        return False
    halves = [np.array([x[0] >> 32 * k & 0xFFFFFFFF for k in range(4)], np.uint32) for x in (a, b)]
    (at, n), (bt, m) = (simhash.anchors(h) for h in halves)
    return bool(((at[:, :1] == bt) & m).any() or ((bt[:, :1] == at) & n).any())


def slow_components(fps, linked=lambda a, b: (a ^ b).bit_count() <= 3):
    up = list(range(len(fps)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if linked(fps[i], fps[j]):
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(fps))]


def check_classes(rows, docs):
    ids = [d[0] for d in docs]
    fps = [slow_fingerprint(d[1]) for d in docs]
    least = defaultdict(list)
    roots = slow_components(fps)
    for i, r in zip(ids, roots):
        least[r].append(i)
    want = sorted((str(i), fp, str(min((x for x in least[r] if x is not None), default=None))) for i, fp, r in zip(ids, fps, roots))
    assert sorted((str(r["doc_id"]), r["fp"] % (1 << 64), str(r["component_id"])) for r in rows) == want


def test_simhash_odd(odd, none):
    check_classes(simhash.near_duplicates(odd, words=3).collect(), ODD)
    assert simhash.near_duplicates(none).count() == 0


@pytest.mark.parametrize("share", [3])
def test_simhash_near(spark, share):
    r = random.Random(6)
    docs = []
    for i in range(40):
        text = [f"w{r.randrange(10**6)}" for _ in range(300)]
        docs.append((len(docs), " ".join(text)))
        for _ in range(r.randint(0, 6)):
            text[r.randrange(300)] = f"n{r.randrange(10**6)}"
            docs.append((len(docs), " ".join(text)))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    rows = simhash.near_duplicates(df, words=3, share=share).collect()
    check_classes(rows, docs)
    wide = [slow_wide(t) for _, t in docs]
    assert [w for w in wide[0]] == [int(x[0]) | int(x[1]) << 64 for x in simhash.wide_fingerprint(docs[0][1]).reshape(2, 2)]
    assert sorted(r["doc_id"] for r in simhash.representatives(df, share=share).collect()) == sorted(set(slow_components(wide, slow_alike)))


def test_representatives_odd(odd, none):
    kept = simhash.representatives(odd)
    assert kept.columns == odd.columns
    least = defaultdict(list)
    for d, root in zip(ODD, slow_components([slow_wide(d[1]) for d in ODD], slow_alike)):
        least[root].append(d[0])
    want = [min((x for x in ids if x is not None), default=None) for ids in least.values()]
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter(want)
    assert simhash.representatives(none).count() == 0


def test_representatives_recall(spark):
    """Of pairs whose five-word shingles are 0.8 alike or more nine in ten are caught; other texts stay."""
    r = random.Random(11)
    common = [f"c{i}" for i in range(60)]
    word = lambda: r.choice(common) if r.random() < 0.5 else f"w{r.randrange(10**5)}"
    shingles = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    docs, alike, apart = [], [], []
    for i in range(240):
        a = [word() for _ in range(r.choice([120, 300, 600]))]
        b = list(a)
        for at in r.sample(range(len(b)), max(1, int(len(b) * r.choice([0.01, 0.02, 0.25])))):
            b[at] = word()
        j = len(shingles(a) & shingles(b)) / len(shingles(a) | shingles(b))
        (alike if j >= 0.8 else apart if j < 0.4 else []).append(2 * i + 1)
        docs += [(2 * i, " ".join(a)), (2 * i + 1, " ".join(b))]
    kept = {row["doc_id"] for row in simhash.representatives(spark.createDataFrame(docs, "doc_id long, text string").repartition(4)).collect()}
    assert kept >= {2 * i for i in range(240)}
    assert len(alike) > 80 and sum(d not in kept for d in alike) / len(alike) >= 0.9
    assert len(apart) > 40 and kept >= set(apart)


def test_anchor_cover():
    g = np.random.default_rng(7)
    half = np.concatenate([g.integers(0, 1 << 32, 2000, dtype=np.uint32), np.array([0, 1, 1 << 31, (1 << 32) - 1], np.uint32)])
    for flip in (0, *(1 << k for k in range(32))):
        a, na = simhash.anchors(half)
        b, nb = simhash.anchors(half ^ np.uint32(flip))
        for home, copies, count in ((a[:, 0], b, nb), (b[:, 0], a, na)):
            assert ((copies == home[:, None]) & count).any(axis=1).all()
    assert all(len(set(row[c].tolist())) == c.sum() for row, c in zip(a, na))


@pytest.mark.parametrize("seed", range(3))
def test_links_connect(seed):
    g = np.random.default_rng(seed)
    base = g.integers(0, 1 << 63, 4, dtype=np.uint64)
    fps = np.unique(np.concatenate([b ^ (np.uint64(1) << g.integers(0, 64, 60, dtype=np.uint64)) ^ (np.uint64(1) << g.integers(0, 64, 60, dtype=np.uint64)) for b in base]))
    out, rows = [], np.stack([fps, fps], axis=1)
    simhash._links(rows, rows, 3, out)
    assert len(out) <= 2 * len(fps)
    assert all(((a ^ b).bit_count() <= 64) for a, b in out)
    up = {int(x): int(x) for x in fps}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in out:
        up[max(root(a), root(b))] = min(root(a), root(b))
    want = slow_components([int(x) for x in fps])
    groups = defaultdict(set)
    for x, w in zip(fps, want):
        groups[w].add(root(int(x)))
    assert all(len(v) == 1 for v in groups.values()) and len({min(v) for v in groups.values()}) == len(groups)


def test_components(spark):
    r = random.Random(8)
    links = [(i, i + 1) for i in range(0, 60)] + [(1000, 1000 + i) for i in range(50)] + [(r.randrange(2000, 2200), r.randrange(2000, 2200)) for _ in range(120)]
    up = {x: x for p in links for x in p}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    got = {x["node"]: x["root"] for x in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: root(x) for p in links if p[0] != p[1] for x in p}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def slow_suffix(docs, length, keep):
    data = [(d[0], (d[1] or "").encode()) for d in docs]
    order = sorted(range(len(data)), key=lambda i: (data[i][0] is None, data[i][0] or 0))
    seen, count = {}, Counter()
    for i in order:
        for k in range(len(data[i][1]) - length + 1):
            s = data[i][1][k : k + length]
            count[s] += 1
            seen.setdefault(s, (i, k))
    out = []
    for i, (doc_id, b) in enumerate(data):
        m = np.zeros(len(b) + 1, int)
        for k in range(len(b) - length + 1):
            s = b[k : k + length]
            if count[s] > 1 and (keep == "none" or seen[s] != (i, k)):
                m[k] += 1
                m[k + length] -= 1
        m = np.cumsum(m)[: len(b)] > 0
        spans = int((np.diff(np.concatenate([[0], m.astype(int)])) == 1).sum())
        out.append((str(doc_id), len(b), int(m.sum()), spans, hashlib.sha256(np.frombuffer(b, np.uint8)[~m].tobytes()).hexdigest()))
    return sorted(out)


def suffix_rows(df, **how):
    return sorted((str(r["doc_id"]), r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix_dedup.deduplicate(df, **how).collect())


def texts_with_repeats(seed, n=60):
    r = random.Random(seed)
    shared = ["".join(r.choice("abcdé ") for _ in range(r.randint(80, 400))) for _ in range(5)]
    out = []
    for i in range(n):
        parts = ["".join(r.choice("abcdefgh ") for _ in range(r.randint(0, 150)))]
        for _ in range(r.randint(0, 3)):
            s = r.choice(shared)
            a, b = sorted((r.randrange(len(s)), r.randrange(len(s))))
            parts += [s[a:b] if r.random() < 0.5 else s, "".join(r.choice("xyz") for _ in range(r.randint(0, 40)))]
        out.append((i, "".join(parts)))
    return [*out, (n, "ab" * 300), (n + 1, "z" * 500), (n + 2, out[3][1]), (n + 3, "")]


def test_suffix_odd(odd, none):
    assert suffix_rows(odd) == slow_suffix(ODD, 200, "none")
    assert suffix_dedup.deduplicate(none).count() == 0


@pytest.mark.parametrize(("length", "keep", "crowd", "block"), [(200, "none", 4096, 1 << 20), (80, "none", 4096, 2000), (80, "none", 1, 2000), (80, "first", 4096, 1 << 20), (80, "first", 1, 2000)])
def test_suffix_random(spark, length, keep, crowd, block):
    docs = texts_with_repeats(length + crowd)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert suffix_rows(df, length=length, keep=keep, crowd=crowd, block=block) == slow_suffix(docs, length, keep)


def texts_cut_in_passages(seed, n=60):
    """Texts that end or begin inside a passage which goes on in others, and long runs of one character."""
    r = random.Random(seed)
    shared = ["a" * 30 + "".join(r.choice("abc") for _ in range(300)) for _ in range(3)]
    out = [(0, "z" * 300), (1, "z" * 90 + "\x00\x00"), (2, "z" * 79), (3, "\x00" * 100)]
    for i in range(4, n):
        s = r.choice(shared)
        a = r.randrange(120)
        b = a + r.randint(85, 200)
        out.append((i, s[a:b] + r.choice(["", "a", "aa", "\x00", "\x00\x00\x00", "z" * 85])))
    return out


@pytest.mark.parametrize(("length", "keep", "block"), [(80, "none", 1 << 20), (80, "none", 2000), (80, "first", 1 << 20), (80, "first", 2000)])
def test_suffix_hull_ends(spark, length, keep, block):
    docs = texts_cut_in_passages(block)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    assert suffix_rows(df, length=length, keep=keep, block=block) == slow_suffix(docs, length, keep)


def test_suffix_block_ends():
    text = ("".join(random.Random(1).choice("bcd") for _ in range(79))).encode()
    hulls = [(1, 0, 0, b"xx" + text), (2, 0, 0, b"a" * 81), (3, 0, 0, text + b"a" + b"y" * 20), (4, 0, 0, b"ww" + text), (5, 0, 0, text + b"\x00")]
    for keep in ("none", "first"):
        found = suffix_dedup._block(list(hulls), 80, keep)
        assert found == [(2, 0, 0 if keep == "none" else 1, 81)][: len(found)] and {f[0] for f in found} <= {2}


@pytest.mark.parametrize("seed", range(4))
def test_longest_factors(seed):
    g = np.random.default_rng(seed)
    text = g.integers(97, 97 + 2 + seed, 150).astype(np.uint8)
    depth = 12
    earlier, later = suffix_dedup.longest_factors(text, depth)

    def common(a, b):
        n = 0
        while n < depth and max(a, b) + n < len(text) and text[a + n] == text[b + n]:
            n += 1
        return n

    n = len(text)
    assert earlier.tolist() == [max((common(i, j) for j in range(i)), default=0) for i in range(n)]
    assert later.tolist() == [max((common(i, j) for j in range(i + 1, n)), default=0) for i in range(n)]


def slow_passages(docs, window):
    first = {}
    cut = [(d[0], (d[1] or "").encode().split()) for d in docs]
    key = lambda i: 1 << 63 if i is None else i
    for i, w in cut:
        for k in range(len(w) - window + 1):
            s = tuple(w[k : k + window])
            first[s] = min(first.get(s, 1 << 64), key(i))
    out = []
    for i, w in cut:
        gone = {k + j for k in range(len(w) - window + 1) if first[tuple(w[k : k + window])] < key(i) for j in range(window)}
        out.append((str(i), len(w), len(gone), hashlib.sha256(b" ".join(x for k, x in enumerate(w) if k not in gone)).hexdigest()))
    return sorted(out)


def passage_rows(df, window=13):
    return sorted((str(r["doc_id"]), r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring_dedup.deduplicate(df, window).collect())


def test_rows_of_repeated_ids(spark):
    """Rows of an id are told apart by a number, not by a hash that texts might share."""
    from lodestone.llm.rows import keyed

    shared = "".join(random.Random(9).choice("abcdefgh ") for _ in range(300))
    docs = [(None, f"{i} unique") for i in range(50)] + [(None, shared + " x"), (3, shared + " y"), (3, "alone"), (4, None)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    named = keyed(df).collect()
    assert len({(r["doc"], r["tag"]) for r in named}) == len(docs)
    gone = {(r["doc_id"], r["n_bytes"]): r["n_removed"] for r in suffix_dedup.deduplicate(df, length=200).collect()}
    assert gone[None, 302] == gone[3, 302] == 301 and sum(gone.values()) == 602


def test_passages_odd(odd, none):
    assert passage_rows(odd) == slow_passages(ODD, 13)
    assert substring_dedup.deduplicate(none).count() == 0


def test_passages_random(spark):
    r = random.Random(9)
    shared = [[f"s{r.randrange(50)}" for _ in range(r.randint(10, 60))] for _ in range(6)]
    docs = []
    for i in range(120):
        parts = []
        for _ in range(r.randint(0, 4)):
            parts += r.choice(shared) if r.random() < 0.6 else [f"u{r.randrange(1000)}" for _ in range(r.randint(1, 30))]
        docs.append((r.randrange(100), " ".join(parts)))
    docs += [(200, "a " * 100), (201, "a " * 100)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert passage_rows(df) == slow_passages(docs, 13)
