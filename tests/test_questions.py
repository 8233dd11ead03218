"""Many questions at once, and the index of names, against a scan in Python and one question at a time."""

import random
import re

from pyspark.sql import functions as F

from lodestone.operators import kg_store, names, questions, retrieval, vectors


def said(text, name):
    t, n = text.lower(), (name or "").strip(" ").lower()
    return n != "" and (re.search(rf"(?<![a-z0-9]){re.escape(n)}(?![a-z0-9])", t) is not None if n.isascii() else n in t)


def test_name_index_finds_what_a_scan_finds(spark):
    g = random.Random(8)
    pieces = ["foo", "Bar", "3D", "+", "-", " ", "é", "中文", "x1", "net", "  ", "#", "."]
    make = lambda n: "".join(g.choice(pieces) for _ in range(g.randint(1, n)))
    entities = [(f"k{i:03d}", make(4), "Concept", [make(3) for _ in range(g.randint(0, 3))]) for i in range(120)] + [("none", None, "Task", None), ("empty", "", "Task", ["foo", ""])]
    asked = [(i, make(9)) for i in range(40)] + [(50, ""), (51, None), (52, "a bar foo x1 net 3d, and 中文foo")]
    index = names.index(spark.createDataFrame(entities, "key string, name string, entity_type string, aliases array<string>"))
    table = spark.createDataFrame(asked, "qid long, question string")
    got = {(r["qid"], r["key"]): (r["matched_text"], r["rank"]) for r in names.lexical_seeds(table, index, 8).collect()}
    want = {}
    for i, q in asked:
        met = [(-max((len(x), x) for x in {n, *(a or [])} if said(q, x))[0], k, max((len(x), x) for x in {n, *(a or [])} if said(q, x))[1]) for k, n, _, a in entities if q and n is not None and any(said(q, x) for x in {n, *(a or [])})]
        want |= {(i, k): (x, rank) for rank, (_, k, x) in enumerate(sorted(met)[:8], 1)}
    assert got == want and len(want) > 60
    got = {(r["qid"], r["key"]): r["rank"] for r in names.lexical_seeds_v1(table, index, 8).collect()}
    want = {}
    for i, q in asked:
        met = [(-len(n), k) for k, n, _, a in entities if q and n and (n.lower() in q.lower() or any(len(x) >= 4 and x.lower() in q.lower() for x in a))]
        want |= {(i, k): rank for rank, (_, k) in enumerate(sorted(met)[:8], 1)}
    assert got == want and len(want) > 60


def test_a_question_reads_its_parts_of_the_index(spark, tmp_path):
    entities = spark.range(3000).selectExpr("concat('Method::', id) AS key", "concat('Name ', id, ' of many') AS name", "'Method' AS entity_type", "array() AS aliases").withColumn("aliases", F.col("aliases").cast("array<string>"))
    names.index(entities).repartitionByRange(8, "part").sortWithinPartitions("part").write.parquet(str(tmp_path / "i"))
    stored = spark.read.parquet(str(tmp_path / "i"))
    one = names.lexical_seeds(spark.createDataFrame([(0, "What is Name 77 of many, or name 78?")], "qid long, question string"), stored, 8)
    assert [r["key"] for r in one.collect()] == ["Method::77"]
    plan = one._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(part), In(part" in plan.replace("`", "") or "In(part" in plan


def test_many_questions_are_as_one_by_one(spark):
    g = random.Random(4)
    nodes_ = [(f"Method::m{i}", f"M{i}", "Method", [f"method {i}"]) for i in range(12)] + [(f"Concept::c{i}", f"C{i}", "Concept", []) for i in range(6)]
    ev = [(f"Method::m{a}", f"M{a}", "Method", r, k, n, t, c) for a, r, (k, n, t, _), c in ((g.randrange(12), g.choice(["USES", "COMPARED_WITH", "INTRODUCES", "ADDRESSES"]), g.choice(nodes_), g.randrange(40)) for _ in range(300))]
    nodes = spark.createDataFrame(nodes_, "key string, name string, entity_type string, aliases array<string>")
    evidence = spark.createDataFrame(ev, "source_key string, source string, source_type string, relation string, target_key string, target string, target_type string, chunk_id long")
    support = spark.createDataFrame(list({(k, c) for k, *_ in nodes_ for c in g.sample(range(40), 5)}), "entity_key string, chunk_id long")
    introduces = spark.createDataFrame([(f"p{i}", f"Method::m{i}", f"M{i}") for i in range(0, 12, 2)], "paper string, target_key string, target string")
    embedded = spark.createDataFrame([(i, [g.gauss(0, 1) for _ in range(5)]) for i in range(40)] + [(98, None), (99, [float("nan")] * 5)], "chunk_id long, embedding array<double>")
    asked = [(3, "What of M1 and method 7?", [1.0, 0.0, 0.0, 0.0, 0.0]), (4, "nothing here", [0.0, 1.0, 1.0, 0.0, 0.0]), (9, None, [0.5, 0.1, 0.0, 0.0, 1.0])]
    table = spark.createDataFrame([*asked, (10, "M3 only", None)], "qid long, question string, vector array<double>")
    edges, focal = kg_store.edges(evidence), introduces.select(F.col("target_key").alias("key"))
    for cap in (3, 32):
        around = questions.adjacent(edges, cap).cache()
        assert around.groupBy("node").count().filter(f"count > {cap}").isEmpty()
        near = questions.hop(nodes.filter("entity_type = 'Concept'").select(F.lit(1).alias("qid"), "key"), around, cap)
        best = retrieval.rank_facts(kg_store.edges(retrieval.touching(evidence, nodes.filter("entity_type = 'Concept'"))), cap)
        columns = ["rank", "source_key", "relation", "target_key"]
        assert sorted(near.select(columns).collect()) == sorted(best.select(columns).collect())
    got = questions.answers(table, embedded, "chunk_id", names.index(nodes), support, nodes, questions.adjacent(edges), focal)
    facts, seeds = got.facts.collect(), got.seeds.collect()
    for qid, question, vector in asked:
        hits = vectors.top_k(embedded.filter("chunk_id < 50"), vector, "chunk_id")
        assert [(r["chunk_id"], r["rank"]) for r in hits.orderBy("rank").collect()] == sorted(((r["chunk_id"], r["rank"]) for r in got.hits.filter(f"qid = {qid}").collect()), key=lambda x: x[1])
        lexical = retrieval.lexical_seeds(F.lit(question or ""), nodes)
        merged = retrieval.merge_seeds(lexical, retrieval.bridge_seeds(hits, support, nodes))
        assert {(r["key"], r["seed_source"], r["rank"]) for r in seeds if r["qid"] == qid} == {(r["key"], r["seed_source"], r["rank"]) for r in merged.collect()}
        want = retrieval.two_hops(evidence, merged, focal)[2]
        assert {(r["rank"], r["source_key"], r["relation"], r["target_key"], r["evidence_count"]) for r in facts if r["qid"] == qid} == {(r["rank"], r["source_key"], r["relation"], r["target_key"], r["evidence_count"]) for r in want.collect()}
    assert {r["key"] for r in seeds if r["qid"] == 10} == {"Method::m3"}
    chunks = spark.range(40).select(F.col("id").alias("chunk_id"))
    proof = questions.provenance(got.facts, evidence, chunks)
    assert proof.groupBy("qid").agg(F.max("rank").alias("n")).filter("n > 14").isEmpty() and not proof.isEmpty()
    assert questions.hits(table.limit(0).select("qid", "vector"), embedded, "chunk_id").count() == 0


def test_hits_are_those_of_sums_in_order(spark, monkeypatch):
    g = random.Random(6)
    vec = lambda: [g.choice([0.1, 0.2, 0.3, -0.7, 1e-9, g.gauss(0, 1)]) for _ in range(7)]
    rows = [(f"v{i:04d}", vec()) for i in range(300)]
    rows += [(f"w{i}", rows[i][1]) for i in range(20)] + [("x", [float("inf")] * 7), ("y", [1.0])]
    asked = [(i, rows[i * 3][1]) for i in range(30)] + [(90, None)]
    monkeypatch.setattr(questions, "MOST_BYTES", 7 * 8 * 8)  # several scans

    def cosine(a, b):
        s = 0.0
        for x, y in zip(a, b, strict=True):
            s += x * y
        return s

    table, embedded = spark.createDataFrame(asked, "qid long, vector array<double>"), spark.createDataFrame(rows, "chunk_id string, embedding array<double>")
    got = {(r["qid"], r["rank"]): (r["chunk_id"], r["cosine"]) for r in questions.hits(table, embedded, "chunk_id", 5).collect()}
    want = {}
    for qid, q in asked[:-1]:
        best = sorted((-cosine(v, q), i) for i, v in rows if len(v) == 7 and v[0] != float("inf"))[:5]
        want |= {(qid, n): (i, -s) for n, (s, i) in enumerate(best, 1)}
    assert got == want


def test_provenance_asks_for_facts_that_can_matter(spark):
    keys = ["source_key", "relation", "target_key"]
    facts = spark.createDataFrame([(1, 1, "a", "USES", "b", 2), (1, 2, "a", "USES", "c", 20), (1, 3, "a", "USES", "d", 30), (2, 1, "a", "USES", "d", 30)], "qid long, rank int, source_key string, relation string, target_key string, evidence_count long")
    has = {"b": [50, 51], "c": range(20), "d": range(0, 60, 2)}
    evidence = spark.createDataFrame([("a", "USES", t, c) for t, x in has.items() for c in x for _ in range(2)], "source_key string, relation string, target_key string, chunk_id long")
    asked = []

    def some(edges):
        asked.extend(sorted(r["target_key"] for r in edges.collect()))
        return evidence.join(edges, keys, "left_semi")

    chunks = spark.range(60).select(F.col("id").alias("chunk_id"))
    want = {(1, n, c) for n, c in enumerate([50, 51, *range(12)], 1)} | {(2, n, c) for n, c in enumerate(range(0, 28, 2), 1)}
    for held in (evidence, some):
        assert {(r["qid"], r["rank"], r["chunk_id"]) for r in questions.provenance(facts, held, chunks).collect()} == want
    assert asked == ["b", "c", "d"]
    asked.clear()
    questions.provenance(facts.filter("qid = 1"), some, chunks).collect()
    assert asked == ["b", "c"]
