import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone import schemas
from lodestone.operators import chunking, kg_store, retrieval, vector_index
from lodestone.plans import hybrid
from lodestone.session import Config
from lodestone.sources import files, graph_state, manifest, models, prompts, store


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_store_tables(spark, tmp_path):
    s = store.Store(spark, str(tmp_path))
    assert s.read("t") is None and s.state("t").head()["present"] is False
    s.upsert("t", spark.createDataFrame([("a", 1), ("b", 1)], "k string, v int"), ["k"])
    s.upsert("t", spark.createDataFrame([("b", 2, "x"), ("c", 3, "y")], "k string, v int, w string"), ["k"])
    assert rows(s.read("t"), "k", "v", "w") == [("a", 1, None), ("b", 2, "x"), ("c", 3, "y")]
    late = spark.createDataFrame([("c", 9, "z", 1), ("c", 8, "q", 2)], "k string, v int, w string, t int")
    s.upsert("t", late, ["k"], ["t"])
    assert [r["v"] for r in s.read("t").filter("k = 'c'").collect()] == [8]
    s.replace("t", spark.createDataFrame([("d", 1), ("e", 1)], "k string, v int"), "v")
    assert rows(s.read("t"), "k", "v") == [("b", 2), ("c", 8), ("d", 1), ("e", 1)]
    assert len(s.versions("t")) == 2 and s.state("t").head()["n"] == 4
    (tmp_path / "t" / "data" / "left").mkdir()  # what a failed job left
    assert rows(s.read("t"), "k") == [("b",), ("c",), ("d",), ("e",)]
    s.drop("t")
    assert s.read("t") is None


def test_only_touched_buckets_are_written(spark, tmp_path):
    s = store.Store(spark, str(tmp_path), buckets=16)
    s.upsert("t", spark.range(200).selectExpr("id AS k", "id AS v"), ["k"])
    before = s.parts("t")
    s.upsert("t", spark.createDataFrame([(3, 30), (500, 1)], "k long, v long"), ["k"])
    after = s.parts("t")
    moved = {b for b in after if after[b] != before.get(b)}
    assert 1 <= len(moved) <= 2 and set(before) <= set(after)
    assert all((tmp_path / "t" / after[b]).is_dir() for b in after)
    want = {k: (30 if k == 3 else k) for k in range(200)} | {500: 1}
    assert dict(rows(s.read("t"), "k", "v")) == want
    s.replace("t", s.read("t").filter("k < 0"), "k", spark.createDataFrame([(k,) for k in range(150)], "k long"))  # a removal
    assert dict(rows(s.read("t"), "k", "v")) == {k: v for k, v in want.items() if k >= 150}
    for _ in range(3):
        s.upsert("t", spark.createDataFrame([(500, 2)], "k long, v long"), ["k"])
    held = {p.name for p in (tmp_path / "t" / "data").iterdir() if any(p.iterdir())}
    assert len(s.versions("t")) == 2 and len(held) <= 20  # what no version names is gone
    s.upsert("t", spark.createDataFrame([], "k long, v long"), ["k"])
    assert s.read("t").count() == 51
    s.upsert("u", spark.createDataFrame([], "k long, v long"), ["k"])
    assert s.read("u") is None or s.read("u").isEmpty()


def test_loads_do_not_depend_on_partitions(spark, tmp_path):
    rel = [("Entity", "a", "USES", "b", i, [(f"c{i}", i)]) for i in range(8)] + [("Paper", "p", "INTRODUCES", "a", i, [(f"c{i}", i)]) for i in range(5)]
    df = spark.createDataFrame(rel, f"source_kind string, source string, relation string, target string, seq int, evidence {schemas.EVIDENCE}")
    lookup = spark.createDataFrame([("a", "Method::a"), ("b", "Concept::b")], "spelled string, key string")
    for n in (1, 3, 8):
        own, papers = kg_store.loadable(df.repartition(n), lookup)
        assert [r["evidence"][0]["chunk_id"] for r in own.collect()] == ["c7"] and [r["seq"] for r in papers.collect()] == [4]
        own, papers = kg_store.loadable(df.drop("seq").repartition(n), lookup)
        assert [r["evidence"][0]["chunk_id"] for r in own.collect()] == ["c7"] and len(papers.collect()) == 1
        s = store.Store(spark, str(tmp_path / str(n)), buckets=4)
        s.upsert("t", df.select("source", "seq", "evidence").repartition(n), ["source"], ["seq"])
        assert rows(s.read("t"), "source", "seq") == [("a", 7), ("p", 4)]


def test_one_of_two_writers_begins_again(spark, tmp_path):
    one, two = manifest.Manifest(spark, str(tmp_path)), manifest.Manifest(spark, str(tmp_path))
    one.commit(0, {"n": 1})
    with pytest.raises(manifest.Conflict):
        two.commit(0, {"n": 9})
    seen = []

    def add(content):
        seen.append(content["n"])
        if len(seen) == 1:
            one.commit(1, {"n": 5})
        return {"n": content["n"] + 1}

    assert two.change(add) == 3 and seen == [1, 5] and one.current() == (3, {"n": 6})
    assert one.change(lambda content: None) == 3


def test_vacuum(spark, tmp_path):
    s = store.Store(spark, str(tmp_path), buckets=4)
    s.upsert("t", spark.createDataFrame([(1, 1), (2, 2)], "k long, v long"), ["k"])
    left = tmp_path / "t" / "data" / ("0" * 32)
    left.mkdir()
    m = manifest.Manifest(spark, str(tmp_path / "t"))
    assert m.vacuum() == 0 and left.exists()
    assert m.vacuum(hours=0) == 1 and not left.exists() and rows(s.read("t"), "k") == [(1,), (2,)]
    assert manifest.Manifest(spark, str(tmp_path / "none")).vacuum() == 0


def test_store_graph(spark, tmp_path):
    s = store.Store(spark, str(tmp_path))
    pages = spark.createDataFrame([("a", "a.pdf", 1, "one two"), ("b", "b.pdf", 1, "three")], "paper_id string, source_file string, page int, text string")
    store.put_chunks(s, chunking.windows(pages))
    proof = [("a_p001_c001", 1), (None, 2), ("zz", 3)]
    entities = spark.createDataFrame([("Deep Field", "Method", ["DF"], proof, ["a.pdf"]), ("Loss", "Concept", [], [], ["a.pdf"])], schemas.CANONICAL_ENTITY)
    relations = spark.createDataFrame([("Entity", "df", "USES", "loss", "Concept", proof, ["a.pdf"]), ("Paper", "a.pdf", "INTRODUCES", "DF", "Method", proof, ["a.pdf"]), ("Entity", "none", "USES", "loss", "Concept", [], [])], schemas.CANONICAL_RELATION)
    profiles = spark.createDataFrame([("b.pdf", [("DF", "Method", [])])], f"source_file string, focal {schemas.FOCAL}")
    for _ in range(2):  # merged twice is as merged once
        store.put_graph(s, entities, relations, profiles)
    assert rows(s.read("nodes"), "key") == [("Concept::loss",), ("Method::deep field",)]
    assert rows(s.read("edges"), "source_key", "relation", "target_key", "evidence_count") == [("Method::deep field", "USES", "Concept::loss", 2)]
    assert rows(s.read("support"), "entity_key", "chunk_id", "page") == [("Method::deep field", "a_p001_c001", 1)]
    assert rows(s.read("introduces"), "source_file", "target_key", "generated_from_profile") == [("a.pdf", "Method::deep field", False), ("b.pdf", "Method::deep field", True)]
    store.put_chunks(s, chunking.windows(pages.filter("paper_id = 'a'").withColumn("text", F.lit("new text"))))
    assert s.read("support").isEmpty() and rows(s.read("chunks"), "paper_id", "text") == [("a", "new text"), ("b", "three")]
    store.reset_graph(s)
    assert s.read("nodes") is None and s.read("chunks").count() == 2
    files.write_graph(entities, relations, str(tmp_path / "g"), spark.createDataFrame([("orphan", 3)], "reason string, n long"), spark.createDataFrame([("entities", 9)], "what string, n long"))
    back = files.read_graph(spark, str(tmp_path / "g"))
    assert back[0].count() == 2 and back[1].count() == 3 and ("dropped", "orphan", 3) in rows(back[2], "what", "type", "count")
    nodes, edges, chunks = store.toy_graph(spark)
    assert (nodes.count(), edges.count(), chunks.count()) == (4, 3, 4)
    assert set(rows(edges, "target_key")) < set(rows(nodes, "key"))


def recall_of(index, vectors, asked, k=6):
    caught = total = 0
    ids, x = [i for i, _ in vectors], np.array([v for _, v in vectors])
    for i in asked:
        want = {ids[j] for j in np.lexsort((ids, -x @ x[i]))[:k]}
        caught, total = caught + len(want & {r[0] for r in index.search(x[i].tolist(), k=k).select(index.settings()["id"]).collect()}), total + len(want)
    return caught / total


def test_vector_index(spark, tmp_path):
    g = np.random.default_rng(3)
    x = np.repeat(g.standard_normal((30, 16)), 40, axis=0) + 0.3 * g.standard_normal((1200, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rows_ = [(i, v.tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows_, "id long, embedding array<float>")
    index = vector_index.Index(spark, str(tmp_path / "index"))
    assert index.state() == "absent"
    with pytest.raises(ValueError, match="absent"):
        index.search([1.0] * 16)
    index.create(df, "id")
    assert index.state() == "online" and recall_of(index, rows_, range(0, 1200, 150)) >= 0.9
    held = spark.read.parquet(index.manifest.path(index.settings()["parts"][0]["vectors"]))
    assert held.count() == 1200 and index.settings()["probes"] < 1 << index.settings()["bits"]
    index.drop()
    assert index.state() == "absent"


def test_recall_of_the_index_on_embeddings(spark, small, tmp_path):
    df = spark.read.parquet(f"{small}/embeddings.parquet").select("vec_id", "embedding")
    vectors_ = [(r["vec_id"], r["embedding"]) for r in df.orderBy("vec_id").collect()]
    index = vector_index.Index(spark, str(tmp_path / "index"))
    index.create(df, "vec_id")
    assert recall_of(index, vectors_, range(0, len(vectors_), len(vectors_) // 25)) >= 0.9


def test_index_that_grows_is_as_one_built_anew(spark, tmp_path):
    g = np.random.default_rng(4)
    x = g.standard_normal((400, 8))
    row = lambda i, v, label="a": (i, v.tolist(), label)
    make = lambda rows: spark.createDataFrame(rows, "id long, embedding array<double>, label string")
    one, two = (vector_index.Index(spark, str(tmp_path / n)) for n in ("one", "two"))
    one.create(make([row(i, x[i]) for i in range(200)]), "id", bits=4, probes=3)
    one.append(make([row(i, x[i]) for i in range(200, 400)]))
    one.append(make([row(i, x[399 - i], "moved") for i in range(40)] + [(900, None, "x"), (901, [1.0], "x"), (902, [float("nan")] * 8, "x"), (None, x[0].tolist(), "x")]))
    one.delete(spark.createDataFrame([(i,) for i in range(100, 150)] + [(5,), (777,)], "id long"))
    one.append(make([row(5, x[7], "back")]))
    want = {i: (x[i], "a") for i in range(400) if not 100 <= i < 150} | {i: (x[399 - i], "moved") for i in range(40)} | {5: (x[7], "back")}
    two.create(make([row(i, v, label) for i, (v, label) in want.items()]), "id", bits=4, probes=3)
    ask = lambda index, q: [tuple(r) for r in index.search(q).orderBy("rank").collect()]
    before = [ask(one, x[i].tolist()) for i in (0, 5, 130, 250)]
    assert before == [ask(two, x[i].tolist()) for i in (0, 5, 130, 250)]
    assert {r["id"]: r["label"] for r in one.rows().collect()} == {i: label for i, (_, label) in want.items()}
    one.compact()
    assert len(one.settings()["parts"]) == 1 and before == [ask(one, x[i].tolist()) for i in (0, 5, 130, 250)]
    assert one.search(x[0].tolist(), probes=16).count() == 6
    two.create(make([]), "id")
    assert ask(two, x[0].tolist()) == [] if two.settings()["width"] == 8 else two.rows().isEmpty()


def test_ask_json(spark):
    tried = []

    def model(prompt):
        tried.append(prompt)
        return {"good": '```json\n{"k": 1}\n```', "bad": "{broken", "text": '"word"'}[prompt] if len(tried) > 1 or prompt != "good" else "{not yet"

    asked = spark.createDataFrame([("good",), ("bad",), ("text",)], "prompt string").coalesce(1)
    got = {r["prompt"]: r["record"] for r in models.ask_json(asked, model, "k INT").collect()}
    assert got["good"]["k"] == 1 and got["bad"] is None and got["text"] is None


def test_files(spark, tmp_path):
    one = spark.createDataFrame([("a.pdf", [("N", "Method", [])]), ("b.pdf", [])], f"source_file string, focal_entities {schemas.FOCAL}")
    files.write_profiles(one, str(tmp_path / "p"))
    assert {r["source_file"]: len(r["focal_entities"]) for r in files.read_profiles(spark, str(tmp_path / "p")).collect()} == {"a.pdf": 1, "b.pdf": 0}
    failed = spark.createDataFrame([(1, "a.pdf", ["c"], None, None)], f"batch_number int, source_file string, chunk_ids array<string>, entities array<{schemas.ENTITY}>, relations array<{schemas.RELATION}>")
    files.write_experiment(failed, str(tmp_path / "e"))
    lines = [json.loads(x) for f in (tmp_path / "e").glob("*.json") for x in f.read_text().splitlines()]
    assert lines == [{"batch_number": 1, "source_file": "a.pdf", "chunk_ids": ["c"], "entities": [], "relations": []}]
    pages = spark.createDataFrame([("a.pdf", 2, "world"), ("a.pdf", 1, "hello"), ("b.pdf", 1, "no")], "source_file string, page int, text string")
    assert files.preview(pages, "a.pdf", 8).head()["preview"] == "hello\nwo"


def test_config(spark):
    with pytest.raises(ValueError, match="store, model_key"):
        Config.read(spark, {})
    assert Config.read(spark, {"LODESTONE_STORE": "/s", "LODESTONE_MODEL_KEY": "k", "LODESTONE_DIMENSIONS": "8"}) == Config("/s", "k", dimensions=8)


def test_prompts(spark):
    chunks = spark.createDataFrame([("a.pdf", [("c1", 3, "some text")])], "f string, x array<struct<chunk_id: string, page: int, text: string>>")
    asked = chunks.select(prompts.profile(F.col("f"), F.col("x")).alias("p"), prompts.extraction(F.col("f"), F.lit("[]"), F.col("x")).alias("e")).head()
    assert all("[c1, page 3]\nsome text" in x and "a.pdf" in x for x in asked) and "USES to Concept or Method or Model" in asked["e"]
    assert all("Why?" in f("Why?") for f in (prompts.rewrite, prompts.entity, prompts.direct))


def test_one_entity(spark):
    nodes = spark.createDataFrame([("Method::a", "A", "Method"), ("Method::b", "B", "Method")], "key string, name string, entity_type string")
    ev = spark.createDataFrame([("Method::a", "A", "Method", "USES", "Method::b", "B", "Method", 1), ("Method::b", "B", "Method", "USES", "Method::a", "A", "Method", 1)], "source_key string, source string, source_type string, relation string, target_key string, target string, target_type string, chunk_id long")
    assert rows(hybrid.named_entity_facts("?", lambda p: '"a"', nodes, ev), "source", "target") == [("A", "B")]
    assert all(hybrid.named_entity_facts("?", lambda p, x=x: x, nodes, ev).isEmpty() for x in ("NONE", "other", "", None))
    facts = kg_store.edges(ev).withColumn("rank", F.lit(1))
    assert rows(retrieval.with_ends(facts.withColumn("source", F.lit("old")), nodes), "source") == [("A",), ("B",)]
    assert hybrid.compared("Q", lambda p: p[:6], {"vector": "ctx"}) == {"model": "Answer", "vector": "Answer"}


def test_kept_tables(spark, tmp_path, monkeypatch):
    base = str(tmp_path / "shared")
    monkeypatch.setattr(store, "shared_dir", lambda spark: base)
    (tmp_path / "in").write_text("1")
    built = []

    def build(n):
        built.append(n)
        return spark.range(n)

    ask = lambda n: store.kept(spark, "t", [str(tmp_path / "in")], lambda: build(n)).count()
    assert (ask(3), ask(7)) == (3, 3) and built == [3]
    monkeypatch.setattr(store, "code_version", lambda: "another")  # the code has changed
    assert (ask(7), ask(8)) == (7, 7) and built == [3, 7]
    (tmp_path / "in").write_text("more")
    assert ask(9) == 9 and len([p for p in (tmp_path / "shared" / "kept").iterdir() if not p.name.startswith(".")]) == 2

    def fails():
        raise RuntimeError("no")

    monkeypatch.setattr(store, "code_version", lambda: "broken")
    with pytest.raises(RuntimeError):
        store.kept(spark, "t", [str(tmp_path / "in")], fails)

    def beaten():  # another driver is first
        monkeypatch.setattr(store, "code_version", lambda: "broken")
        assert ask(4) == 4
        return spark.range(5)

    assert store.kept(spark, "t", [str(tmp_path / "in")], beaten).count() == 4
    assert not [p for p in (tmp_path / "shared" / "kept").iterdir() if p.name.startswith(".")]


def _evidence(rows):
    key = lambda k, n: f"{k}::{n.lower()}"
    return [(key("Method", s), s, "Method", r, key(k, t), t, k, c, p, f) for s, r, k, t, c, p, f in rows]


EVIDENCE_KIND = "source_key string, source string, source_type string, relation string, target_key string, target string, target_type string, chunk_id string, page int, source_file string"


def test_graph_follows_its_files(spark, tmp_path):
    g = random.Random(6)
    one = lambda f: [(f"M{g.randrange(30)}", g.choice(["USES", "ADDRESSES"]), "Concept", f"C{g.randrange(9)}", f"{f}-{g.randrange(5)}", 1, f) for _ in range(20)]
    known = {f"f{i}.pdf": one(f"f{i}.pdf") for i in range(6)}
    make = lambda names: spark.createDataFrame(_evidence([x for f in names for x in known[f]]), EVIDENCE_KIND)
    state = graph_state.GraphState(spark, str(tmp_path / "g"), buckets=16)
    with pytest.raises(ValueError, match="no graph"):
        state.edges()

    def check():
        want = {tuple(r) for r in kg_store.edges(make(known)).collect()}
        names = [c.split()[0] for c in graph_state.EDGE.split(", ")]
        assert {tuple(r) for r in state.edges().select(*names).collect()} == want == {tuple(r) for r in state.edges(end="target").select(*names).collect()}
        assert state.edges().count() == len(want) == state.edges(end="target").count()
        some = ["Concept::c1", "Concept::c2"]
        assert {tuple(r) for r in state.edges(some, "target").select(*names).collect()} == {r for r in want if r[4] in some}
        by = {}
        for r in want:
            n, e = by.get(r[3], (0, 0))
            by[r[3]] = (n + 1, e + r[7])
        assert {r["relation"]: (r["n"], r["evidence"]) for r in state.counts().collect()} == by
        assert state.evidence().count() == sum(map(len, known.values()))

    state.change(make(known))
    check()
    known["new.pdf"] = [("M1", "USES", "Concept", "C0", "n-1", 1, "new.pdf"), ("M77", "USES", "Concept", "C77", "n-2", 1, "new.pdf")]
    before = state.manifest.current()[1]
    state.change(make(["new.pdf"]))
    check()
    after = state.manifest.current()[1]
    assert sum(after["evidence"][b] != before["evidence"].get(b) for b in after["evidence"]) <= 2 and sum(after["into"][b] != before["into"].get(b) for b in after["into"]) <= 2
    known["f1.pdf"] = one("f1.pdf")  # one file has changed, another goes
    del known["f2.pdf"]
    state.change(make(["f1.pdf"]), spark.createDataFrame([("f2.pdf",), ("never.pdf",)], "source_file string"))
    check()
    del known["new.pdf"]
    state.change(make([]), spark.createDataFrame([("new.pdf",)], "source_file string"))
    check()
    version = state.manifest.current()[0]
    state.change(make([]), spark.createDataFrame([("never.pdf",)], "source_file string"))
    assert state.manifest.current()[0] == version


def test_graph_tells_spellings_apart(spark, tmp_path):
    """Edges of one key and two spellings, of which one changes, by either end; evidence goes through one shuffle."""
    make = lambda *rows: spark.createDataFrame(_evidence([(m, "USES", "Concept", "C", f"{f}-1", 1, f) for m, f in rows]), EVIDENCE_KIND)
    state = graph_state.GraphState(spark, str(tmp_path / "g"), buckets=4)
    state.change(make(("M1", "a"), ("m1", "b")))
    state.change(make(("M1", "c")))
    for end in ("source", "target"):
        assert sorted((r["source"], r["evidence_count"]) for r in state.edges(end=end).collect()) == [("M1", 2), ("m1", 1)]
    rows = make(("M1", "a"), ("m1", "b")).withColumn("_bucket", graph_state._bucket("source_key", 4))
    assert graph_state._packed(rows)._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1


def test_two_drivers_change_one_graph(spark, tmp_path, monkeypatch):
    rows_of = lambda f, m: spark.createDataFrame(_evidence([(m, "USES", "Concept", "C", f"{f}-1", 1, f)]), EVIDENCE_KIND)
    one, two = (graph_state.GraphState(spark, str(tmp_path / "g"), buckets=4) for _ in range(2))
    one.change(rows_of("a.pdf", "A"))
    whole, beaten = one._changed, []

    def slow(content, *args):
        made = whole(content, *args)
        if not beaten:
            beaten.append(1)
            two.change(rows_of("b.pdf", "A"))  # the other is first
        return made

    monkeypatch.setattr(one, "_changed", slow)
    one.change(rows_of("c.pdf", "A"))
    assert [(r["source"], r["evidence_count"]) for r in one.edges().collect()] == [("A", 3)] and one.manifest.current()[0] == 3


@pytest.mark.parametrize("few", [4096, 0])
def test_a_change_packs_what_comes(spark, tmp_path, monkeypatch, few):
    """Evidence that is stored isn't dealt out again, row by row; an edge without evidence goes, and one may come again."""
    monkeypatch.setattr(graph_state, "FEW", few)
    make = lambda *rows: spark.createDataFrame(_evidence([(m, "USES", "Concept", c, f"{f}-{i}", 1, f) for m, c, f, n in rows for i in range(n)]), EVIDENCE_KIND)
    packed, whole = [], graph_state._packed
    monkeypatch.setattr(graph_state, "_packed", lambda rows: (packed.append(rows.count()), whole(rows))[1])
    state = graph_state.GraphState(spark, str(tmp_path / "g"), buckets=4)
    said = lambda end: sorted((r["source"], r["target"], r["evidence_count"]) for r in state.edges(end=end).collect())
    steps = [
        ((("A", "x", "a", 30), ("A", "y", "b", 20)), [], [("A", "x", 30), ("A", "y", 20)]),
        ((("A", "x", "c", 2),), ["b"], [("A", "x", 32)]),
        ((("A", "y", "d", 1), ("B", "x", "d", 1)), ["a"], [("A", "x", 2), ("A", "y", 1), ("B", "x", 1)]),
        ((("A", "y", "b", 3), ("A", "z", "d", 1)), [], [("A", "x", 2), ("A", "y", 3), ("A", "z", 1)]),
    ]
    for came, gone, want in steps:
        state.change(make(*came), spark.createDataFrame([(f,) for f in gone], "source_file string"))
        assert said("source") == want == said("target")
        assert {r["relation"]: r["evidence"] for r in state.counts().collect()} == {"USES": sum(n for *_, n in want)}
    assert packed == [50, 2, 2, 4]
    held = {p.name for p in (tmp_path / "g" / "data").iterdir()}
    named = {x.split("/")[1] for v in state.manifest.versions() for x in manifest._folders(state.manifest.read(v))}
    assert len(held) <= len(named) + 2 * len(steps), "what came is left beside the state"
