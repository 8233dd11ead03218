"""Language identification, personal data, and the pipeline."""

import random
import re
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from conftest import ODD
from pyspark.sql import functions as F

from lodestone.llm import entries, langid, pii


def test_language_held_out(spark, small):
    rows = entries.op6_language(spark, small).join(spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert len(rows) > 40 and sum(r["lang"] == r["lang_pred"] for r in rows) / len(rows) > 0.95


def test_language_odd(odd, none):
    learned = langid.train(odd.select("doc_id", "text", "lang"))
    assert list(learned) == ["de", "en", "fr"]
    rows = {(r["doc_id"], r["lang_pred"], r["score"]) for r in langid.predict(odd, learned).collect()}
    by = {i: (lang, s) for i, lang, s in rows}
    assert len(by) == len({d[0] for d in ODD})
    assert by[1] == by[2] == by[3] == ("und", 0.0)
    assert all(0 <= s <= 1 for _, s in by.values())
    assert {r["lang_pred"] for r in langid.predict(odd, {}).collect()} == {"und"}
    assert langid.predict(none, learned).count() == 0 and langid.train(none.select("doc_id", "text", "lang")) == {}


def test_language_vectors():
    v = langid.document_vectors(["abc abc", "ABC  abc!", "xyz", "", None, "12 34", "日本語 テスト"])
    assert np.array_equal(v[0], v[1]) and not v[3].any() and not v[4].any() and not v[5].any() and v[6].any()
    # By hand: boundary, a, b, c, boundary.
    a, b, c, e = (langid.letter_vector(x, langid.DIMENSIONS).astype(int) for x in (ord("a"), ord("b"), ord("c"), 0))
    bind = lambda x, y, z: np.roll(x, 2) * np.roll(y, 1) * z
    assert np.array_equal(langid.document_vectors(["abc"])[0], bind(e, a, b) + bind(a, b, c) + bind(b, c, e))


def slow_vector(text):
    """Trigrams one by one: letters, and one boundary for whatever stands between them."""
    symbols = []
    for c in "\0" + (text or "").lower() + "\0":
        x = ord(c) if c.isalpha() else 0
        if x or not symbols or symbols[-1]:
            symbols.append(x)
    out, known = np.zeros(langid.DIMENSIONS, np.int64), {}
    for gram in zip(symbols, symbols[1:], symbols[2:]):
        if gram not in known:
            a, b, c = (langid.letter_vector(x, langid.DIMENSIONS).astype(np.int64) for x in gram)
            known[gram] = np.roll(a, 2) * np.roll(b, 1) * c
        if any(gram):
            out += known[gram]
    return out


def test_language_brute_force(spark, small):
    import zlib

    docs = [r.asDict() for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text", "lang").collect()]
    sums = {}
    for d in docs:
        d["v"] = slow_vector(d["text"])
        norm = np.linalg.norm(d["v"])
        if zlib.crc32(str(d["doc_id"]).encode()) % 3 != 1 and d["lang"] is not None and d["text"] is not None:
            sums[d["lang"]] = sums.get(d["lang"], 0) + (np.rint(d["v"] / norm * 2**20) if norm else 0)
    langs = sorted(sums)
    prototypes = np.stack([sums[x] / np.linalg.norm(sums[x]) for x in langs])
    got = {r["doc_id"]: r for r in entries.op6_language(spark, small).collect()}
    assert len(got) == len(docs)
    for d in docs:
        cosine = prototypes @ d["v"] / max(np.linalg.norm(d["v"]), 1e-9)
        r = got[d["doc_id"]]
        assert r["held_out"] == (zlib.crc32(str(d["doc_id"]).encode()) % 3 == 1)
        assert r["score"] == pytest.approx(float(np.clip(cosine.max(), 0, 1)) if d["v"].any() else 0.0, abs=1e-5)
        best = sorted(cosine)
        if d["v"].any() and best[-1] - best[-2] > 1e-4:
            assert r["lang_pred"] == langs[int(cosine.argmax())]


def slow_base(text):
    out = [(0, *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(1, *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    digits = lambda m: re.sub(r"[^0-9]", "", m[0])
    out += [(2, *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 16 <= len(digits(m)) <= 19 and pii.luhn(digits(m))]
    return out + [(3, *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= len(digits(m)) <= 15]


def test_base_patterns():
    r = random.Random(10)
    for _ in range(3000):
        text = "".join(r.choice("ab@..-1234+ ()%é\n") for _ in range(r.randint(0, 60)))
        assert pii.base_spans(text) == slow_base(text), repr(text)
    assert pii.base_spans("4111 1111-1111 1111, x@y.z@w.v") == slow_base("4111 1111-1111 1111, x@y.z@w.v")
    pii.base_spans("1" * 200_000 + "." + "a" * 200_000 + "@")  # not quadratic


def test_gradient():
    model = pii.Tagger(1)
    model.p = {k: v.astype(np.float64) for k, v in model.p.items()}
    g = np.random.default_rng(0)
    ids, tags = g.integers(0, 20, (3, 7)), g.integers(0, pii.TAGS, (3, 7))
    _, grads = model.gradient(ids, tags)
    for name, grad in grads.items():
        at = np.unravel_index(np.argmax(np.abs(grad)), grad.shape)
        kept, loss = model.p[name][at], []
        for step in (1e-3, -1e-3):
            model.p[name][at] = kept + step
            loss.append(model.gradient(ids, tags)[0])
        model.p[name][at] = kept
        assert grad[at] == pytest.approx((loss[0] - loss[1]) / 2e-3, rel=1e-2, abs=1e-3)


def scores(lines, with_base):
    """Precision of added spans, and recall of all labelled ones."""
    texts = [t for t, _ in lines]
    base = [pii.base_spans(t) if with_base else [] for t in texts]
    got = pii.added_spans(pii.trained(), texts, base, pii.LEAST)
    right = sum(len(set(g) & set(s)) for g, (_, s) in zip(got, lines))
    caught = sum(len((set(g) | set(b)) & set(s)) for g, b, (_, s) in zip(got, base, lines))
    return right / max(1, sum(map(len, got))), caught / sum(len(s) for _, s in lines)


def test_tagger_held_out():
    precision, recall = scores(pii.labelled_lines(150, 77), False)
    assert precision > 0.95 and recall > 0.9


#: Written by hand; personal data in << >>. Forms of numbers that the network learns, and the posterior, were chosen after
#: it was seen which of these were missed, so they hold what was reached and don't measure recall on new lines.
HAND = """Please ring <<phone (212) 555-0182>> or <<phone 0171 496 0234>> after 5.
Fax: <<phone 415-555-0199>>; mobile <<phone 07700 900 461>>.
Server <<ip 192.168.4.17>> went down at 10:45, see ticket 48213.
Write to <<email maria.lopez+news@example.co.uk>> before 2024-05-01.
Card <<card 4929-1182-7730-5521>> was charged $312.50 on 12/04.
Her number is <<phone 030 1234 5678>>, office 44.
Karte <<card 5500 0000 1234 5678>> gesperrt
tel. <<phone 555.123.4567>>, ext 12
version 3.14.159 build 20231105
token = "9f86d081884c7d659a2feaa0c55ad015a3bf4f1b"
born in 1987, room 1204, invoice 20240098
ISBN 978-3-16-148410-0 page 33
from <<ip 10.0.0.254>> to <<ip 172.16.31.9>> via <<ip 8.8.4.4>>
Kontakt: <<email j_weber@uni-koeln.de>>, Tel <<phone (0221) 470-4400>>
llame al <<phone 600-123-456>> o <<phone 91 555 1234>>
scores were 12-7, 9-3 and 100-98
the 2019-2020 season, 3:15 pm, $45.99
<<phone +44 20 7946 0958>> and <<phone +1 415 555 2671>>"""


def test_tagger_on_lines_by_hand():
    lines = []
    for line in HAND.split("\n"):
        text, spans = "", []
        for part in re.split(r"(<<.*?>>)", line):
            if part.startswith("<<"):
                kind, part = part[2:-2].split(" ", 1)
                spans.append((pii.KINDS.index(kind), len(text), len(text) + len(part)))
            text += part
        lines.append((text, spans))
    precision, recall = scores(lines, True)
    assert precision >= 0.9 and recall >= 0.9


def marked(text):
    """Lines with spans marked by hand."""
    out = []
    for line in text.strip().split("\n"):
        plain, spans = "", []
        for part in re.split(r"(<<\w+ .*?>>)", line):
            if m := re.fullmatch(r"<<(\w+) (.*)>>", part):
                spans.append((pii.KINDS.index(m[1]), len(plain), len(plain) + len(m[2])))
            plain += m[2] if m else part
        out.append((plain, spans))
    return out


def test_tagger_on_forms():
    """104 spans by hand, written before the training whose network this is. Their first reading gave a recall of 0.87; one
    rule (a span that can't be of its kind may be of another) came after it, so the figure now is a little favourable."""
    lines = marked((Path(__file__).parent / "forms.txt").read_text())
    assert sum(len(s) for _, s in lines) == 104
    precision, recall = scores(lines, True)
    assert precision >= 0.9 and recall >= 0.87


def test_spans_around_base_spans():
    text = "Appelez le 06.12.34.56.78 vite, ou k.o'neil@uni.edu"
    base = pii.base_spans(text)
    assert [text[s:e] for _, s, e in base] == ["neil@uni.edu", "06.12.34.56"]
    assert pii.reconcile([(0.9, 3, 11, 25), (0.9, 0, 35, 51)], base, text) == [(3, 11, 25), (0, 35, 51)]
    assert pii.reconcile([(0.9, 3, 12, 25), (0.9, 3, 10, 23)], base, text) == []  # one cuts into it, one adds no letter or digit
    assert pii.masked(text, [*base, (3, 11, 25), (0, 35, 51)]) == "Appelez le [PHONE] vite, ou [EMAIL]"


def test_tagger_is_kept(spark, monkeypatch):
    one = pii.trained_for(spark)
    monkeypatch.setattr(pii, "_trained", {})
    monkeypatch.setattr(pii, "trained", lambda: 1 / 0)
    two = pii.trained_for(spark)
    assert all(np.array_equal(one.p[k], two.p[k]) for k in one.p)


def test_windows_agree():
    model = pii.trained()
    text = "ther edon " * 20 + "call (555) 123-4567 now " + "stth 12 ou " * 30
    alone = pii.added_spans(model, ["ou call (555) 123-4567 now"], [[]], 0.5)[0]
    long = pii.added_spans(model, [text], [[]], 0.5)[0]
    assert [text[s:e] for _, s, e in long] == [x for x in ["(555) 123-4567"] if alone]


def test_reconcile():
    base = [(0, 10, 20)]
    found = [(0.9, 3, 15, 25), (0.9, 3, 30, 40), (0.95, 2, 35, 44), (0.95, 3, 30, 40), (0.99, 1, 41, 44)]
    assert pii.reconcile(found, base, "x" * 60) == [(3, 30, 40), (1, 41, 44)]
    assert pii.reconcile([], base, "") == []


def test_pii_odd(odd, none):
    rows = pii.find(odd).collect()
    assert Counter(r["doc_id"] for r in rows) == Counter(d[0] for d in ODD)
    by = {r["doc_id"]: r for r in rows}
    assert (by[8]["n_email"], by[8]["n_ip"]) == (1, 1) and by[8]["spans"].startswith("email:24:33,ip:38:46")
    assert by[1]["spans"] == "" and pii.find(none).count() == 0
    clean = pii.redact(odd)
    assert clean.columns == odd.columns
    texts = {r["doc_id"]: r for r in clean.collect()}
    assert "[EMAIL]" in texts[8]["text"] and "[IP]" in texts[8]["text"] and texts[8]["n_chars"] == len(texts[8]["text"])
    assert texts[1]["text"] is None and texts[5]["text"] == ODD[4][1]
    assert pii.redact(none).count() == 0


def test_pipeline(spark, small):
    import corpus_pipeline
    from test_duplicates import slow_alike, slow_components, slow_wide
    from test_exact import ids_of

    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near-duplicates", "personal data", "mixing", "packing"]
    docs = spark.read.parquet(f"{small}/documents.parquet").withColumn("lang", F.when(F.col("doc_id") % 7 > 0, F.col("lang")))
    docs = docs.unionByName(spark.createDataFrame([(10_001, "12 34 !!", "en", "src1", 8), (10_002, None, None, None, None)], docs.schema))
    start = docs.orderBy("doc_id").collect()
    states = []
    for _, stage in corpus_pipeline.STAGES:
        done = stage(spark, docs, small)
        docs = spark.createDataFrame(done.collect(), done.schema)
        states.append(docs.collect())
    assert all(s[0].asDict().keys() == start[0].asDict().keys() for s in states[:4])
    assert {r["doc_id"] for r in states[0]} == {r["doc_id"] for r in start} - {10_001, 10_002}
    assert all(r["lang"] for r in states[0])
    fps = sorted((r["doc_id"], slow_wide(r["text"])) for r in states[0])
    roots = slow_components([f for _, f in fps], slow_alike)
    assert sorted(r["doc_id"] for r in states[1]) == sorted({fps[r][0] for r in roots})
    text = {r["doc_id"]: r["text"] for r in states[1]}
    assert {r["doc_id"] for r in states[2]} == set(text)
    assert all(r["text"] == text[r["doc_id"]] or re.search(r"\[(EMAIL|IP|CARD|PHONE)\]", r["text"]) for r in states[2])
    assert not any(slow_base(r["text"]) for r in states[2])
    taken = Counter(r["doc_id"] for r in states[3])
    assert set(taken) <= set(text) and max(taken.values()) <= 2
    masked = {r["doc_id"]: r["text"] for r in states[2]}
    tokens_in = sum(n * len(ids_of(masked[i], 1)) for i, n in taken.items())
    assert sum(r["length"] for r in states[4]) == tokens_in


def test_pipeline_without_languages(spark, odd, none, small):
    import corpus_pipeline

    bare = odd.withColumn("lang", F.lit(None).cast("string"))
    kept = corpus_pipeline.language(spark, bare, small)
    assert kept.columns == odd.columns
    want = [d[0] for d in ODD if any(c.isalpha() for c in d[1] or "")]
    rows = kept.collect()
    assert Counter(r["doc_id"] for r in rows) == Counter(want) and all(r["lang"] is None for r in rows)
    assert corpus_pipeline.language(spark, none, small).count() == 0
    docs = kept
    for _, stage in corpus_pipeline.STAGES[1:]:
        docs = stage(spark, docs, small)
    assert docs.count() > 0


def test_registered(spark, small):
    import sys

    sys.path.insert(0, __file__.rsplit("/tests/", 1)[0])
    import __spark_entry__ as e

    names = set(e.queries())
    assert {n.split("_")[0] for n in entries.queries()} == {f"op{i}" for i in range(1, 14)}
    assert set(entries.queries()) | {"pipeline"} <= names and set(e.oracle_sql()) <= names
