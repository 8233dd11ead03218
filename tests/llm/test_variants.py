"""Spelling groups, shared lines and fill-in-middle, against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from conftest import ODD, fill
from pyspark.sql import functions as F

from lodestone.llm import entries, fim, line_dedup, spelling

SPACES = " \t\n\x0b\x0c\r"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# --- fill-in-middle ----------------------------------------------------------------------------------------------


def units(text):
    out, at = [], 0
    while at < len(text):
        end = at
        while end < len(text) and text[end] in SPACES:
            end += 1
        while end < len(text) and text[end] not in SPACES:
            end += 1
        out.append(text[at:end])
        at = end
    return out


def slow_fim(doc_id, text):
    w, s = units(text or ""), hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(s[i : i + 8], 16) for i in range(0, 32, 8)]
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return len(w), "plain", None, None, text or ""
    lo, hi = sorted(x % (len(w) + 1) for x in h[:2])
    a, b, c = "".join(w[:lo]), "".join(w[lo:hi]), "".join(w[hi:])
    form = "spm" if h[3] % 100 < 80 else "psm"
    return len(w), form, len(a), len(b), f"<S>{c}<P>{a}<M>{b}" if form == "spm" else f"<P>{a}<S>{c}<M>{b}"


def test_rope():
    g = random.Random(5)
    for size in (0, 1, 30, 9000, 60_000):
        text = "".join(g.choice("ab é\U0001f600 \n\t") for _ in range(size)) + "x" * (size // 3)
        rope, w = fim.Rope.of(text), units(text)
        assert str(rope) == text and rope.units == len(w) and rope.chars == len(text)
        for _ in range(20):
            k, c = g.randint(-1, len(w) + 1), g.randint(-1, len(text) + 1)
            (a, b), (x, y) = rope.cut_at_unit(k), rope.cut_at_char(c)
            assert str(a) == "".join(w[: max(k, 0)]) and str(b) == text[len(str(a)) :] and a.units + b.units == len(w)
            assert (str(x), str(y)) == (text[: max(c, 0)], text[max(c, 0) :]) and (x.chars, y.chars) == (len(str(x)), len(str(y)))
            assert str(b + a) == str(b) + str(a)
    many = fim.Rope.mark("")
    for i in range(500):
        many = many + fim.Rope.mark(f"{i} ") if i % 2 else fim.Rope.mark(f"{i} ") + many
    level = lambda r: r.left is None or abs(r.left.height - r.right.height) <= 1 and level(r.left) and level(r.right)
    assert level(many) and many.chars == len(str(many)) and many.height <= 14


def test_fim(spark, odd, none):
    rows = ODD + [(i, x, "en", "a") for i, x in enumerate(["<P> a b", "a<S", "one two  three\n", " lead", "a <M> b", "<", "x<P", "S><S"] * 12, 100)]
    docs = spark.createDataFrame(fill(rows), odd.schema).repartition(3)
    back = fim.restored(fim.transformed(docs)).collect()
    got = Counter((r["doc_id"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) for r in back)
    assert got == Counter((i, *slow_fim(i, x)) for i, x, *_ in rows)
    assert Counter((r["doc_id"], r["restored"]) for r in back) == Counter((i, x or "") for i, x, *_ in rows)
    assert {r["form"] for r in back} == {"plain", "psm", "spm"}
    assert fim.restored(fim.transformed(none)).count() == 0
    every = fim.transformed(docs, percent=100, spm_percent=0).filter("form = 'plain'").collect()
    assert all(not r["output"] or re.search("<[PSM]>", r["output"]) for r in every)


# --- shared lines ------------------------------------------------------------------------------------------------


def slow_lines(rows, shortest=40, many=5):
    last = 2**63 - 1
    at = lambda i: last if i is None else i
    key = lambda x: x.strip(SPACES).translate(LOW)
    holders = defaultdict(set)
    for i, text, *_ in rows:
        for x in (text or "").split("\n"):
            if len(key(x)) >= shortest:
                holders[key(x)].add(at(i))
    keeper = {k: max(v) for k, v in holders.items() if len(v) >= many}
    out = []
    for i, text, *_ in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if keeper.get(key(x), at(i)) == at(i)]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return Counter(out)


def lines_of(df):
    return Counter((r["doc_id"], r["n_lines"], r["n_dropped"], r["kept"]) for r in df.collect())


LINE = "This line of forty characters or more is shared"


def test_lines(spark, odd, none):
    assert lines_of(line_dedup.deduplicated(odd)) == slow_lines(ODD)
    assert line_dedup.deduplicated(none).count() == 0
    g = random.Random(3)
    stock = [LINE, f"\t{LINE.upper()} \r", LINE + "!", "short", "", "É" * 40, "é" * 40, "x" * 39, "y" * 40] + [f"{k} rare line with forty characters or more" for k in range(30)]
    rows = [(i, "\n".join(g.choice(stock[: 9 if i % 3 else 39]) for _ in range(g.randint(0, 12))), "en", "a") for i in range(200)]
    rows += [(None, LINE + "\nnull", "en", "a"), (None, LINE, "en", "a"), (7, f"{LINE}\n{LINE}\nagain", "en", "a"), (500, None, "en", "a")]
    docs = spark.createDataFrame(fill(rows), odd.schema).repartition(5)
    assert lines_of(line_dedup.deduplicated(docs)) == slow_lines(rows)
    assert lines_of(line_dedup.deduplicated(docs, shortest=5, many=2)) == slow_lines(rows, 5, 2)


def test_lines_join_one_way(spark, odd):
    """Texts meet their bitmaps by document at any size; small bitmaps are not sent out whole either."""
    assert "ShuffledHashJoin [doc" in line_dedup.deduplicated(odd)._jdf.queryExecution().executedPlan().toString()


def test_lines_of_one_key_in_many_tasks(spark, odd):
    """A key that most lines have is dealt to many tasks; another lies at the border of two."""
    rows = [(i, f"{LINE}\nown line of document {i} that nobody else has at all\n{LINE if i % 2 else 'tail'}", "en", "a") for i in range(600)]
    rows += [(1000 + i, "Second shared line, in exactly five documents, is here", "en", "a") for i in range(5)]
    rows += [(2000 + i, "Third shared line, in only four of the documents, is here", "en", "a") for i in range(4)]
    docs = spark.createDataFrame(fill(rows), odd.schema).repartition(7)
    before = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "23")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        assert lines_of(line_dedup.deduplicated(docs)) == slow_lines(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before[0])
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before[1])


@pytest.mark.parametrize("gone", [[0], [7], [8], [0, 3, 4, 9, 200], list(range(50))])
def test_bitmap(gone):
    keep = line_dedup.stays(line_dedup.bitmap(np.array(gone)), 260)
    assert np.flatnonzero(~keep).tolist() == gone and line_dedup.stays(None, 3).all()
    assert line_dedup.stays(line_dedup.bitmap(np.array(gone)), max(gone) + 1).size == max(gone) + 1


# --- spelling ----------------------------------------------------------------------------------------------------


def slow_words(rows, noise=31):
    out = Counter()
    for i, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOW)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % noise == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            out[run] += 1
    return {w: n for w, n in out.items() if len(w) >= 7 and n >= 2}


def near(x, y):
    if len(x) == len(y):
        return sum(a != b for a, b in zip(x, y, strict=True)) == 1
    x, y = sorted((x, y), key=len)
    return len(y) == len(x) + 1 and any(y[:i] + y[i + 1 :] == x for i in range(len(y)))


def slow_groups(counts, times=10):
    out = {}
    for w, n in counts.items():
        around = [(-k, x) for x, k in counts.items() if near(w, x)]
        m, form = min(around, default=(0, None))
        out[w] = (form, n, len(around), -m) if form is not None and -m >= times * n else (None, n, len(around), None)

    def root(w):
        return w if out[w][0] is None else root(out[w][0])

    return {w: (f, root(w), n, k, m) for w, (f, n, k, m) in out.items()}


def groups_of(df):
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in df.collect()}


def variants(seed, n):
    """Texts of words that are alike: some frequent, some an edit or two away, in crowded blocks."""
    g, out = random.Random(seed), []
    stems = ["container", "Containers", "prefixes", "prefixed", "ÀÉîõüñçø", "straßenbahn", "aaaaaaa", "aaaaaaaa", "aabaaaa"]
    for i in range(n):
        words = []
        for _ in range(g.randint(0, 30)):
            w = list(g.choice(stems[: 3 + i % 7]))
            for _ in range(g.choice([0, 0, 0, 0, 0, 0, 0, 1, 1, 2])):
                k, c = g.randrange(len(w)), g.choice("abstÿ")
                w[k : k + g.choice([0, 1, 1])] = g.choice([c, c, ""])
            words.append("".join(w))
        out.append((i if i % 17 else None, g.choice([" ", "-", "\n1"]).join(words), "en", "a"))
    return out


@pytest.mark.parametrize("crowd", [2, 8, 48])
def test_spelling(spark, odd, crowd):
    rows = variants(crowd, 400)
    docs = spark.createDataFrame(fill(rows), odd.schema).repartition(3)
    want = slow_groups(slow_words(rows))
    assert groups_of(spelling.grouped(docs, crowd=crowd)) == want
    assert sum(v[3] > 0 for v in want.values()) > 100 and any(v[0] for v in want.values())


def test_crowded_blocks(spark):
    """Blocks in which every word is near every other, and long paths of forms."""
    letters = "abcdefghijklmnopqrstuvwxyzàáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿ"
    counts = {f"{a}bcdefg": 2 for a in letters} | {f"abcd{a}{b}efg": 2 for a in letters[:9] for b in letters[:9]} | {"x" * k: 2 * 10 ** (k - 7) for k in range(7, 16)} | {"q" * 3000: 2, "q" * 3001: 30}
    words = spark.createDataFrame(list(counts.items()), "word string, n long")
    for crowd in (3, 40):
        got = {r["word"]: (r["n_near"], r["near"], r["near_n"]) for r in spelling.neighbours(words, crowd).collect()}
        want = {w: [(-k, x) for x, k in counts.items() if abs(len(x) - len(w)) < 2 and near(w, x)] for w in counts}
        assert got == {w: (len(v), min(v)[1], -min(v)[0]) for w, v in want.items() if v}


def test_spelling_paths_and_odd_tables(spark, odd, none):
    text = lambda w, k: " ".join([w] * k)
    rows = [(1, f"{text('x' * 7, 2)} {text('x' * 8, 20)} {text('x' * 9, 200)} {text('x' * 10, 2000)} {text('x' * 11, 20_000)}", "en", "a")]
    docs = spark.createDataFrame(fill(rows), odd.schema)
    got = groups_of(spelling.grouped(docs, noise=10**9))
    assert {v[1] for v in got.values()} == {"x" * 11} and got["x" * 7] == ("x" * 8, "x" * 11, 2, 1, 20)
    assert spelling.grouped(none).count() == 0
    assert groups_of(spelling.grouped(odd)) == slow_groups(slow_words(ODD))


def test_steps():
    g = random.Random(9)
    for _ in range(4000):
        x, y = ("".join(g.choice("ab") for _ in range(g.randint(1, 7))) for _ in range(2))
        if x != y:
            assert (spelling.one_edit(x, y) >= 0) == near(x, y)


# --- registered --------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("name", ["op11_spelling", "op12_line_dedup", "op13_fim"])
def test_matches_sql(spark, small, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{small}/documents.parquet'")
    want = con.sql(entries.oracle_sql()[name])
    got = entries.queries()[name](spark, small).select(*[F.col(c).cast("string") for c in want.columns]).collect()
    assert Counter(tuple(r) for r in got) == Counter(tuple(None if x is None else str(x) for x in r) for r in want.fetchall())
