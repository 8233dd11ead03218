import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from lodestone import schemas
from lodestone.operators import chunking, kg_build, kg_store, ordering, records, retrieval, vectors


def slow_windows(text, size=220, overlap=40):
    words, out, start = text.split(), [], 0
    while words:
        end = min(start + size, len(words))
        out.append((start, end, " ".join(words[start:end])))
        if end == len(words):
            break
        start += size - overlap
    return out


def test_windows(spark):
    counts = {0: 0, 1: 1, 220: 1, 221: 2, 400: 2, 401: 3, 1000: 6}
    texts = {n: "  ".join(f"w{i}é" for i in range(n)) for n in counts}
    df = spark.createDataFrame([("p", "p.pdf", n, t) for n, t in texts.items()] + [("p", "p.pdf", 5000, None)], "paper_id string, source_file string, page int, text string")
    rows = chunking.windows(df).orderBy("page", "chunk_index").collect()
    for n, want in counts.items():
        mine = [r for r in rows if r["page"] == n]
        assert len(mine) == want and [(r["token_start"], r["token_end"], r["text"]) for r in mine] == slow_windows(texts[n])
        page = " ".join(texts[n].split())
        assert all(page[r["char_start"] : r["char_end"]] == r["text"] for r in mine)
    assert rows[0]["chunk_id"] == "p_p001_c001" and chunking.windows(df).schema.names == schemas.CHUNK_COLUMNS


def test_layout_and_cut(spark):
    texts = {n: "  ".join(f"w{i}é" for i in range(n)) for n in (0, 1, 221, 1000)}
    pages = spark.createDataFrame([("p", "p.pdf", n, t) for n, t in texts.items()] + [(None, None, 7, "no paper"), ("p", "p.pdf", 5000, None)], "paper_id string, source_file string, page int, text string")
    whole, bounds = chunking.windows(pages), chunking.layout(pages)
    assert bounds.columns == [c for c in schemas.CHUNK_COLUMNS if c != "text"]
    assert sorted(map(str, bounds.collect())) == sorted(map(str, whole.drop("text").collect()))
    assert sorted(map(str, chunking.cut(bounds, pages).collect())) == sorted(map(str, whole.collect()))
    counts = chunking.counted(pages)
    assert {(r["paper_id"], r["page"]): r["n_windows"] for r in counts.collect()} == {("p", 1): 1, ("p", 221): 2, ("p", 1000): 6, (None, 7): 1}
    assert sorted(str(r["chunk_id"]) for r in chunking.chunk_ids(counts).collect()) == sorted(str(r["chunk_id"]) for r in whole.collect())
    assert {r["paper_id"]: (r["n_chunks"], r["n_pages"]) for r in chunking.per_paper(counts).collect()} == {"p": (9, 3), None: (1, 1)}


def test_batches(spark):
    counts = spark.createDataFrame([(f"p{i % 2}", i, 1 + i % 3) for i in range(50)] + [(None, 3, 4)], "paper_id string, page int, n_windows long").repartition(5)
    want = {}
    for paper, page, n in sorted(((r["paper_id"] or "", r["page"], r["n_windows"]) for r in counts.collect())):
        want.setdefault(paper, []).extend((page, k + 1) for k in range(n))
    placed = chunking.numbered(counts)
    got = {(r["paper_id"] or "", r["page"], r["chunk_index"]): r["position"] for r in placed.collect()}
    assert got == {(p, *x): k for p, v in want.items() for k, x in enumerate(v, 1)}
    batched = chunking.batches(placed).collect()
    assert all(r["batch_number"] == (got[r["paper_id"] or "", r["page"], r["chunk_index"]] - 1) // 12 + 1 for r in batched)
    assert chunking.expected_batches(counts).head()["n_batches"] == sum(math.ceil(len(v) / 12) for v in want.values())
    assert chunking.expected_batches(counts.limit(0)).head()["n_batches"] == 0 and chunking.numbered(counts.limit(0)).count() == 0
    assert {r["position"] for r in chunking.heads(placed).collect()} == set(range(1, 9))
    assert all(len(r["chunk_ids"]) <= 12 for r in chunking.batch_lists(placed).collect())


def test_order_of_any_size(spark):
    """One value has most of the rows; ranges cut through it."""
    g = random.Random(2)
    rows = [(g.choice(["hub"] * 8 + ["a", "z", None]), i, g.randint(0, 5)) for i in range(3000)]
    df = spark.createDataFrame(rows, "name string, id int, v int").repartition(7)
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    try:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        ranked = ordering.ranked_whole(df, ["name", F.col("id").desc()]).collect()
        order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", -r[1]))
        assert [(r["name"], r["id"]) for r in sorted(ranked, key=lambda r: r["rank"])] == [r[:2] for r in order] and {r["rank"] for r in ranked} == set(range(1, 3001))
        sums = {r["id"]: r["before"] for r in ordering.running_totals(df, ["name"], ["id"], "v").collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    for name in ("hub", "a", "z", None):
        total = 0
        for _, i, v in sorted((r for r in rows if r[0] == name), key=lambda r: r[1]):
            assert sums[i] == total
            total += v
    assert ordering.ranked_whole(df.limit(0), ["id"]).count() == 0
    plan = ordering.ranked_whole(df, ["id"])._jdf.queryExecution().toString()
    assert "Window" not in plan


def test_latest_and_pending(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 3, None), ("b", 2, "y")], "k string, t int, v string")
    assert sorted(map(tuple, chunking.latest(df, ["k"], ["t"]).collect())) == [("a", 3, None), ("b", 2, "y")]
    assert [r["k"] for r in chunking.pending(df.select("k").distinct(), df.filter("k = 'a'"), ["k"]).collect()] == ["b"]


def test_type_votes(spark):
    rows = [("a", "A", "Task", 2), ("a", "a", "Metric", 1), ("b", "MGN", "Task", 1), ("c", "C", "Gadget", 1), ("a", "A", "Gadget", 0)]
    got = {r["key"]: (r["name"], r["type"]) for r in kg_build.type_votes(spark.createDataFrame(rows, "key string, name string, type string, seq int")).collect()}
    assert got == {"a": ("A", "Metric"), "b": ("MGN", "Dataset"), "c": ("C", "Concept")}


def test_alias_table(spark):
    pool = spark.createDataFrame([("a", 1, ["x", "b"]), ("b", 2, ["x", "udf"])], "key string, seq int, aliases array<string>")
    got = {r["alias"]: r["key"] for r in kg_build.alias_table(pool).collect()}
    assert got["x"] == "b" and got["b"] == "b" and got["a"] == "a" and got["udf"] == "unsigned distance field"
    rows = spark.createDataFrame([(" X ",), ("udf",), ("none",)], "n string")
    found = {r["n"]: r["k"] for r in kg_build.resolved(rows, "n", kg_build.alias_table(pool), pool, "k").collect()}
    assert found == {" X ": "b", "udf": None, "none": None}


@pytest.mark.parametrize(
    ("row", "want"),
    [
        (("s", "", "t", "t", "Concept", "Entity", "s"), "missing_fields"),
        (("s", "USES", "t", None, "Concept", "Entity", "s"), "target_unresolved"),
        (("s", "USES", "Smith et al.", "x", "Concept", "Entity", "s"), "citation_like"),
        (("s", "EVALUATES_ON", "3D Scene", "x", "Dataset", "Entity", "s"), "generic_dataset"),
        (("s", "COMPARED_WITH", "Poisson-based methods", "x", "Method", "Entity", "s"), "generic_comparison"),
        (("s", "USES", "Adam", "x", "Concept", "Entity", None), "implementation_tool"),
        (("s", "USES", "t", "t", "Task", "Entity", "s"), "type_mismatch_USES"),
        (("s", "USES", "t", "t", "Concept", "Paper", "s"), "paper_source"),
        (("s", "USES", "t", "t", "Concept", "Entity", None), "source_unresolved"),
        (("s", "RELATED", "t", "t", "Task", "Entity", "s"), None),
        (("s", "INTRODUCES", "t", "t", "Method", "Paper", None), None),
    ],
)
def test_drop_reason(spark, row, want):
    df = spark.createDataFrame([row], "source string, relation string, target string, target_key string, target_type string, source_kind string, source_key string")
    assert df.select(kg_build.drop_reason().alias("r")).head()["r"] == want


def test_relations_are_judged_once_a_row(spark, small):
    """Rules don't repeat how their columns are computed, and relations are merged in one pass over them."""
    from lodestone.plans import adapters as A

    said = A.relation_mentions(spark, small)
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    kept = kg_build.kept_relations(said)
    assert plan(kg_build.relation_pool(kept)).count("Relation [") == 2  # lines and parts
    assert plan(kept.select("seq")).count("Poisson-based methods") <= 4
    judged = said.withColumn("reason", kg_build.drop_reason())
    assert kept.count() == judged.filter("reason is null").count() > 0
    got = {r["reason"]: r["n"] for r in kg_build.dropped_counts(said).collect()}
    assert got == {r["reason"]: r["count"] for r in judged.filter("reason is not null").groupBy("reason").count().collect()}
    assert "Poisson" not in "".join(x for x in plan(kg_build.dropped_counts(said).groupBy("reason").agg(F.sum("n")).filter("reason is not null")).splitlines() if "Filter" in x or "Join" in x)
    kinds = "source string, relation string, target string, target_key string, target_type string, source_kind string, source_key string"
    values = [[None, " ", "s"], [None, "", "USES", "INTRODUCES", "EVALUATES_ON", "other"], [None, " ", "t", "Adam", "3d scene ", "A et al."], [None, "t"], [None, "Concept", "Dataset"], [None, "Paper", "Entity"], [None, "s"]]
    odd = spark.createDataFrame([tuple(x) for x in itertools.product(*values)], kinds).withColumn("reason", kg_build.drop_reason())
    assert kg_build.kept_relations(odd).count() == odd.filter("reason is null").count() > 0
    assert {r["reason"]: r["n"] for r in kg_build.dropped_counts(odd).collect()} == {r["reason"]: r["count"] for r in odd.filter("reason is not null").groupBy("reason").count().collect()}
    none = spark.createDataFrame([("Entity", "S", "USES", "T", "Concept", None, "a", 2), ("Entity", "s", "USES", "t", "Task", [("c", 1), (None, None)], "b", 1)], f"source_kind string, source string, relation string, target string, target_type string, evidence {schemas.EVIDENCE}, source_file string, seq int")
    assert [(r["source"], r["target_type"], [tuple(e) for e in r["evidence"]], r["source_files"]) for r in kg_build.relation_pool(none).collect()] == [("s", "Task", [("c", 1)], ["a", "b"])]
    assert [r["evidence"] for r in kg_build.relation_pool(none.limit(1)).collect()] == [[]]


def test_evidence(spark):
    e = [("c1", 1), ("c1", 1), (None, None), (None, 3), ("c2", 1)]
    df = spark.createDataFrame([(e,)], f"e {schemas.EVIDENCE}").select(kg_build.clean_evidence(F.col("e")).alias("e"))
    assert [tuple(x) for x in df.head()["e"]] == [("c1", 1), (None, 3), ("c2", 1)]
    row = df.select(*kg_build.evidence_lists(F.col("e"))).head()
    assert (row["evidence_chunk_ids"], row["evidence_pages"], row["evidence_count"]) == (["c1", "c2"], [1, 3], 2)


def _proof(c, p):
    return {"chunk_id": c, "page": p}


def _said(name, kind, aliases=(), *evidence):
    return {"name": name, "type": kind, "aliases": list(aliases), "evidence": [_proof(*x) for x in evidence]}


def _rel(source, kind, target, *evidence):
    return {"source": source, "type": kind, "target": target, "evidence": [_proof(*x) for x in evidence]}


def _record(spark, focal, entities, relations, chunks=("c1", "c2")):
    return spark.createDataFrame([("a.pdf", "a", 1, list(chunks), focal, entities, relations)], schemas.RAW)


def test_validated(spark):
    focal = [{"name": "Deep Field", "type": "Method", "aliases": ["DF"]}]
    entities = [_said("deep field", "Method", [], ("c1", 1)), _said("Loss", "Concept", ["objective"], ("c1", 1)), _said("Speed", "Metric")]
    relations = [_rel("PAPER", "INTRODUCES", "DF", ("c1", 1)), _rel("DF", "USES", "Objective", ("c9", 2)), _rel("df", "USES", "loss", ("c2", 2)), _rel("PAPER", "USES", "Loss"), _rel("Loss", "USES", "Deep Field"), _rel("DF", "USES", "Speed"), _rel("DF", "BASED_ON", "Loss"), _rel("deep field", "USES", "Speed"), _rel("Deep Field", "BASED_ON", "Loss")]
    raw = _record(spark, focal, entities, relations).unionByName(spark.createDataFrame([("b.pdf", "b", 1, ["c3"], [], [], [])], schemas.RAW))
    names = lambda policy, **k: sorted((r["source"], r["relation"], r["target"]) for r in records.validated(raw, policy, **k).collect())
    assert names("full") == [("Deep Field", "USES", "Loss"), ("PAPER", "INTRODUCES", "Deep Field")]
    assert names("v3") == [("deep field", "USES", "Speed")]  # DF is no entity of the batch, and concepts only are based on concepts
    assert names("v2") == [("deep field", "BASED_ON", "Loss"), ("deep field", "USES", "Speed")]
    strict = {r["relation"]: r["evidence"] for r in records.validated(raw, strict_evidence=True).collect()}
    assert strict["USES"] == [] and len(strict["INTRODUCES"]) == 1
    kept = {r["source_file"]: r for r in records.records(raw).collect()}
    assert [e["name"] for e in kept["a.pdf"]["entities"]] == ["Deep Field", "Loss"] and kept["b.pdf"]["entities"] == [] and kept["a.pdf"]["chunk_ids"] == ["c1", "c2"]
    assert {e["name"] for e in records.kept_entities(raw, "v2").collect()} == {"deep field", "Loss", "Speed"}
    assert {e["name"] for e in records.kept_entities(raw, "v3").collect()} == {"deep field", "Speed"}


def test_names_that_are_earlier_aliases(spark):
    """An entity that goes by an earlier one's alias is that one; its own type does not count."""
    focal = [{"name": "Foc", "type": "Method", "aliases": ["F"]}]
    raw = _record(spark, focal, [_said("Alpha", "Concept", ["A"], ("c1", 1)), _said("A", "Task", ["Alef", "alef", "Alpha"], ("c1", 2), ("c1", 2)), _said("Alef", "Task", [], ("c2", 1))], [_rel("Foc", "ADDRESSES", "A"), _rel("F", "USES", "a"), _rel("Foc", "ADDRESSES", "alef")])
    kept = records.records(raw).head()
    # Alpha gains aliases and evidence; an alias that it gained is not looked up, so Alef is a task of its own.
    assert [(r["source"], r["type"], r["target"]) for r in kept["relations"]] == [("Foc", "USES", "Alpha"), ("Foc", "ADDRESSES", "Alef")]
    alpha = kept["entities"][1]
    assert (alpha["name"], alpha["type"], alpha["aliases"]) == ("Alpha", "Concept", ["A", "Alef", "Alpha"])
    assert [(e["chunk_id"], e["page"]) for e in alpha["evidence"]] == [("c1", 1), ("c1", 2), ("c1", 2)]
    assert [e["name"] for e in kept["entities"]] == ["Foc", "Alpha", "Alef"]


def test_claims_on_focal_aliases(spark):
    """A later entity may claim the alias of a focal method as a target; as a source it stays the focal method."""
    focal = [{"name": "Foc", "type": "Method", "aliases": ["F"]}]
    raw = _record(spark, focal, [_said("Thing", "Concept", ["F"]), _said("f", "Dataset", ["deep"], ("c1", 7)), _said("no relation", "Task")], [_rel("F", "USES", "F"), _rel("PAPER", "INTRODUCES", "F"), _rel("PAPER", "INTRODUCES", "foc"), _rel("Foc", "EVALUATES_ON", "deep")])
    kept = records.records(raw).head()
    assert [(r["source"], r["type"], r["target"]) for r in kept["relations"]] == [("Foc", "USES", "Thing"), ("PAPER", "INTRODUCES", "Foc")]
    foc = kept["entities"][0]
    assert (foc["name"], foc["aliases"], foc["evidence"][0]["page"]) == ("Foc", ["F", "deep"], 7) and [e["name"] for e in kept["entities"]] == ["Foc", "Thing"]


def test_texts_of_windows_count_no_characters(spark, small):
    from lodestone.plans import adapters, registry

    got, asked = chunking.texts(adapters.pages(spark, small), 7, 2), chunking.windows(adapters.pages(spark, small), 7, 2)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, asked.select("chunk_id", "text").collect()))
    assert "char_start" not in registry.queries()["embed_hash"](spark, small)._jdf.queryExecution().optimizedPlan().toString()


def test_raw_records_are_made_after_the_shuffle(spark, small):
    from lodestone.plans import adapters

    plan = adapters.raw_batches(spark, small)._jdf.queryExecution().optimizedPlan().toString()
    above, below = plan.split("RepartitionByExpression", 1)
    assert "evidence" in above and "evidence" not in below and "Method" not in below


def test_records_of_odd_shapes(spark):
    nothing = spark.createDataFrame([("a.pdf", None, None, None, None, None, None), ("b.pdf", "b", 2, ["c"], None, [None, _said(None, "Task"), _said(" x ", None)], [None, _rel(None, "USES", "x"), _rel("PAPER", None, "x")])], schemas.RAW)
    for policy in ("full", "v2", "v3"):
        assert [(r["entities"], r["relations"]) for r in records.records(nothing, policy).collect()] == [([], [])] * 2
        assert records.validated(nothing.limit(0), policy).count() == 0


def test_store(spark):
    nodes = spark.createDataFrame([("Method::a", "A", ["x"], 1), ("Method::b", "B", ["A"], 2)], "key string, name string, aliases array<string>, seq int")
    lookup = kg_store.load_lookup(nodes)
    assert {r["spelled"]: r["key"] for r in lookup.collect()} == {"a": "Method::b", "x": "Method::a", "b": "Method::b"}
    rel = spark.createDataFrame([("Entity", "x", "USES", "b"), ("Entity", "x", "INTRODUCES", "b"), ("Paper", "p.pdf", "INTRODUCES", "x"), ("Entity", "none", "USES", "b"), ("Entity", "X ", "USES", "B")], "source_kind string, source string, relation string, target string")
    own, papers = kg_store.loadable(rel, lookup)
    assert [(r["source_key"], r["target_key"]) for r in own.collect()] == [("Method::a", "Method::b")]
    assert [(r["source"], r["target_key"]) for r in papers.collect()] == [("p.pdf", "Method::a")]
    proof = spark.createDataFrame([("k", [("c1", 1), ("c1", 2), (None, 1), ("zz", 1)])], f"key string, evidence {schemas.EVIDENCE}")
    chunks = spark.createDataFrame([("c1",)], "chunk_id string")
    assert [tuple(r) for r in kg_store.support(proof, chunks).collect()] == [("k", "c1", 2)]


def slow_rank(facts, cap):
    rank = schemas.RELATION_RANK
    return sorted(facts, key=lambda f: (rank.get(f[3], 99), -f[7], f[1].lower(), f[5].lower(), f[0], f[4]))[:cap]


FACTS = "source_key string, source string, source_type string, relation string, target_key string, target string, target_type string, evidence_count long"


def test_rank_and_dedupe(spark):
    r = random.Random(1)
    names = [f"n{i}" for i in range(6)]
    facts = []
    for _ in range(120):
        a, b = r.choice(names), r.choice(names)
        facts.append((f"Method::{a}", a, "Method", r.choice([*schemas.RELATION_RANK, "OTHER"]), f"Method::{b}", b, "Method", r.randint(1, 5)))
    best = {}
    for f in facts:
        k = (f[0], f[3], f[4])
        best[k] = max(best.get(k, f), f, key=lambda x: x[7])
    got = retrieval.rank_facts(retrieval.dedupe_facts(spark.createDataFrame(facts, FACTS)), 32).orderBy("rank").collect()
    assert [tuple(x)[:8] for x in got] == slow_rank(best.values(), 32)


def test_seeds_and_hops(spark):
    nodes = spark.createDataFrame([(f"Method::m{i}", f"M{i}", "Method", []) for i in range(4)] + [("Concept::c", "C", "Concept", ["cc concept"])], "key string, name string, entity_type string, aliases array<string>")
    ev = spark.createDataFrame([("Method::m0", "M0", "Method", "USES", "Concept::c", "C", "Concept", 1), ("Method::m0", "M0", "Method", "COMPARED_WITH", "Method::m1", "M1", "Method", 2), ("Method::m1", "M1", "Method", "USES", "Concept::c", "C", "Concept", 3), ("Method::m1", "M1", "Method", "COMPARED_WITH", "Method::m2", "M2", "Method", 4), ("Method::m2", "M2", "Method", "INTRODUCES", "Method::m3", "M3", "Method", 5)], FACTS.replace("evidence_count", "chunk_id"))
    lex = retrieval.lexical_seeds(F.lit("what does m0 do?"), nodes)
    assert [r["key"] for r in lex.collect()] == ["Method::m0"]
    focal = nodes.filter("entity_type = 'Method'").select("key")
    first, more, facts = retrieval.two_hops(ev, lex.select("key", "name", "entity_type", "seed_source"), focal)
    assert {(r["source_key"], r["target_key"]) for r in first.collect()} == {("Method::m0", "Concept::c"), ("Method::m0", "Method::m1")}
    assert [r["key"] for r in more.collect()] == ["Method::m1"]
    assert facts.count() == 4
    chunks = spark.createDataFrame([(2, "two"), (4, "four")], "chunk_id long, text string")
    got = retrieval.provenance(facts, ev, chunks, 3).orderBy("rank").collect()
    assert [r["chunk_id"] for r in got] == [2]  # unknown ids use up the cap
    some = nodes.select("key").filter("key in ('Method::m0', 'Method::m1')")
    assert sorted(retrieval.touching(ev, some, few=1).collect()) == sorted(retrieval.touching(ev, some).collect())
    bridge = retrieval.bridge_seeds(chunks, spark.createDataFrame([("Concept::c", 2), ("Method::m1", 2), ("Method::m1", 4)], "entity_key string, chunk_id long"), nodes)
    assert [(r["key"], r["support_count"]) for r in bridge.orderBy("rank").collect()] == [("Method::m1", 2), ("Concept::c", 1)]
    assert [r["key"] for r in retrieval.merge_seeds(lex, bridge, 2).orderBy("rank").collect()] == ["Method::m0", "Method::m1"]


def test_vectors(spark):
    import numpy as np

    g = np.random.default_rng(1)
    x = g.standard_normal((300, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, embedding array<float>")
    want = np.argsort(-x @ x[5], kind="stable")[:6].tolist()
    assert [r["id"] for r in vectors.top_k(df, x[5].tolist(), "id").orderBy("rank").collect()] == want
    caught = 0
    for i in range(0, 300, 30):
        want = set(np.argsort(-x @ x[i], kind="stable")[:6].tolist())
        caught += len(want & {r["id"] for r in vectors.lsh_top_k(df, x[i].tolist(), "id").collect()})
    assert caught / 60 >= 0.9
    rows = vectors.embed(spark.createDataFrame([("a b",), ("a b",), (None,)], "text string"), vectors.hashing_model(8), 8).collect()
    assert rows[0]["embedding"] == rows[1]["embedding"] and sum(v * v for v in rows[0]["embedding"]) == pytest.approx(1)
    with pytest.raises(Exception, match="instead of 9"):
        vectors.embed(spark.createDataFrame([("a",)], "text string"), vectors.hashing_model(8), 9).collect()
