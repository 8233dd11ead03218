import json
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from lodestone.operators import names
from lodestone.plans.hybrid import Corpus, answer
from lodestone.sources import document, files, models, page_text
from lodestone.streaming import ingest


def test_page_text(spark, tmp_path):
    pages = spark.createDataFrame([("a.pdf", 2, "two  words"), ("a.pdf", 1, "one"), ("b.pdf", 1, None)], "source_file string, page int, text string")
    page_text.write(pages, str(tmp_path / "t"))
    got = sorted(map(tuple, page_text.read(spark, str(tmp_path / "t" / "*" / "*.txt")).collect()))
    assert got == [("a.pdf", 1, "one"), ("a.pdf", 2, "two words"), ("b.pdf", 1, "")]
    bare = spark.createDataFrame([("/x/c_extracted.txt", "===== PAGE 7 =====\nhello")], "path string, value string")
    assert [tuple(r) for r in page_text.parsed(bare).collect()] == [("c.pdf", 7, "hello")]


def test_page_files(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"first\fsecond")
    (tmp_path / "bad.pdf").write_bytes(b"boom")

    def parser(content):
        if content == b"boom":
            raise ValueError("unreadable")
        return [*files.plain_text(content), None, "x\ud800"]

    rows = files.page_files(spark, str(tmp_path), parser)
    assert sorted((r["source_file"], r["page"] or 0, r["text"], r["n_invalid"]) for r in rows.filter("failure is null").collect()) == [("a.pdf", 1, "first", 0), ("a.pdf", 2, "second", 0), ("a.pdf", 3, "", 0), ("a.pdf", 4, "x�", 1)]
    total = files.summary(rows).head()
    assert (total["n_papers"], total["n_failed"], total["n_pages"], total["n_filled"], total["n_invalid"]) == (1, 1, 4, 3, 1)
    with pytest.raises(FileNotFoundError):
        files.page_files(spark, str(tmp_path), glob="*.none")


def test_json_files(spark, tmp_path):
    from lodestone.operators.chunking import windows

    pages = spark.createDataFrame([("p", "p.pdf", 1, "é " * 300)], "paper_id string, source_file string, page int, text string")
    chunks = windows(pages)
    files.write_chunks(chunks, str(tmp_path / "c"))
    (tmp_path / "c" / "more.json").write_text('\n{"chunk_id": "z"}\n{broken\n')
    assert files.read_chunks(spark, str(tmp_path / "c")).count() == chunks.count() + 1
    (tmp_path / "p.json").write_text(json.dumps({"a.pdf": {"focal_entities": [{"name": "N", "type": "Method", "aliases": []}]}, "b.pdf": {"focal_entities": []}}))
    assert {r["source_file"]: len(r["focal_entities"]) for r in files.read_profiles(spark, str(tmp_path / "p.json")).collect()} == {"a.pdf": 1, "b.pdf": 0}
    ents = spark.createDataFrame([("N", "Method")], "name string, type string")
    rels = spark.createDataFrame([("N", "USES")], "source string, relation string")
    files.write_graph(ents, rels, str(tmp_path / "g"))
    assert spark.read.json(str(tmp_path / "g" / "stats")).count() == 2
    assert files.table_state(spark, str(tmp_path / "none")).head()["present"] is False


def test_ask(spark):
    calls = spark.createDataFrame([("good",), ("bad",)], "prompt string")

    def model(prompt):
        if prompt == "bad":
            raise RuntimeError("no")
        return prompt.upper()

    assert {r["prompt"]: r["answer"] for r in models.ask(calls, model).collect()} == {"good": "GOOD", "bad": None}


def _lines(ids):
    return "".join(json.dumps({"chunk_id": i, "text": i}) + "\n" for i in ids)


def _ingest(spark, tmp_path, extract, **more):
    source, out, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    ingest.ingest(ingest.chunk_stream(spark, source), extract, out, mark, **more).awaitTermination()
    return ingest.Journal(spark, out)


def _states(journal):
    return {r["chunk_id"]: (r["state"], r["attempts"]) for r in journal.ledger().collect()}


def test_ingest(spark, tmp_path):
    (tmp_path / "in").mkdir()
    upper = lambda df: df.select("chunk_id", F.upper("text").alias("t"))
    (tmp_path / "in" / "1.json").write_text(_lines(["a", "b"]))
    _ingest(spark, tmp_path, upper)
    (tmp_path / "in" / "2.json").write_text(_lines(["b", "c", "c"]))
    journal = _ingest(spark, tmp_path, upper)
    assert sorted(r["chunk_id"] for r in journal.rows().collect()) == ["a", "b", "c"]
    assert _states(journal) == {x: ("done", 1) for x in "abc"} and journal.open().isEmpty()


def test_failed_batches_stay_open(spark, tmp_path):
    """A model that is down for one chunk, three times, leaves it open; the next run takes it up again."""
    (tmp_path / "in").mkdir()
    up = tmp_path / "up"

    def model(text):
        if text == "bad" and not up.exists():
            raise RuntimeError("down")
        return json.dumps({"k": text})

    extract = lambda df: models.ask_json(df.select("chunk_id", "text"), model, "k STRING", "text")
    (tmp_path / "in" / "1.json").write_text(_lines(["ok", "bad"]))
    journal = _ingest(spark, tmp_path, extract)
    assert _states(journal) == {"ok": ("done", 1), "bad": ("open", 1)}
    assert [r["chunk_id"] for r in journal.rows().collect()] == ["ok"] and [r["text"] for r in journal.open().collect()] == ["bad"]
    (tmp_path / "in" / "2.json").write_text(_lines(["ok", "new"]))
    journal = _ingest(spark, tmp_path, extract)
    assert _states(journal) == {"ok": ("done", 1), "bad": ("open", 2), "new": ("done", 1)}
    up.write_text("")
    journal = _ingest(spark, tmp_path, extract)  # no new file is needed
    assert _states(journal)["bad"] == ("done", 3) and journal.open().isEmpty()
    assert sorted((r["chunk_id"], r["record"]["k"]) for r in journal.rows().collect()) == [("bad", "bad"), ("new", "new"), ("ok", "ok")]


def test_rows_and_ledger_agree_after_a_kill(spark, tmp_path, monkeypatch):
    from lodestone.sources.manifest import Manifest

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.json").write_text(_lines(["a", "b"]))
    upper = lambda df: df.select("chunk_id", F.upper("text").alias("t"))
    whole = Manifest.commit

    def killed(self, *args):
        raise RuntimeError("killed before the commit")

    monkeypatch.setattr(Manifest, "commit", killed)
    with pytest.raises(Exception, match="killed"):
        _ingest(spark, tmp_path, upper)
    journal = ingest.Journal(spark, str(tmp_path / "out"))
    assert journal.rows() is None and journal.ledger() is None

    def killed_after(self, *args):
        whole(self, *args)
        raise RuntimeError("killed after the commit")

    monkeypatch.setattr(Manifest, "commit", killed_after)
    with pytest.raises(Exception, match="killed"):
        _ingest(spark, tmp_path, upper)
    monkeypatch.setattr(Manifest, "commit", whole)
    journal = _ingest(spark, tmp_path, upper)
    assert sorted(r["t"] for r in journal.rows().collect()) == ["A", "B"] and _states(journal) == {"a": ("done", 1), "b": ("done", 1)}


def test_journal_levels(spark, tmp_path):
    journal = ingest.Journal(spark, str(tmp_path / "j"))
    one = lambda i: spark.createDataFrame([(f"c{i % 4}", i)], "chunk_id string, n int")
    bad = lambda df: df.withColumn("record", F.when(F.col("n") >= 4, F.col("n")))
    for i in range(7):
        journal.attempt(one(i), bad, give_up=5)
        journal.compact(most=3)
    parts = journal.manifest.current()[1]["parts"]
    assert sorted(p["level"] for p in parts) == [0, 1, 1]
    assert _states(journal) == {"c0": ("done", 2), "c1": ("done", 2), "c2": ("done", 2), "c3": ("open", 1)}
    assert sorted(r["n"] for r in journal.rows().collect()) == [4, 5, 6] and [r["n"] for r in journal.open().collect()] == [3]
    for _ in range(4):
        journal.attempt(journal.open(), bad, give_up=5)
    assert _states(journal)["c3"] == ("failed", 5) and journal.open().isEmpty()


def test_answer(spark):
    nodes = spark.createDataFrame([("Method::m0", "M0", "Method", []), ("Concept::c", "C", "Concept", [])], "key string, name string, entity_type string, aliases array<string>")
    ev = spark.createDataFrame([("Method::m0", "M0", "Method", "USES", "Concept::c", "C", "Concept", "k1")], "source_key string, source string, source_type string, relation string, target_key string, target string, target_type string, chunk_id string")
    corpus = Corpus(
        spark.createDataFrame([("k1", [1.0, 0.0]), ("k2", [0.0, 1.0])], "chunk_id string, embedding array<float>"), spark.createDataFrame([("k1", "about m0"), ("k2", "other")], "chunk_id string, text string"),
        nodes, ev, spark.createDataFrame([("Concept::c", "k1")], "entity_key string, chunk_id string"), spark.createDataFrame([("p.pdf", "Method::m0", "M0")], "paper string, target_key string, target string"),
    )
    a = answer(corpus, "What does M0 use?", lambda q: [1.0, 0.1], rewrite=lambda q: '"m0 usage"')
    assert answer(replace(corpus, name_index=names.index(nodes)), "What does M0 use?", lambda q: [1.0, 0.1], rewrite=lambda q: '"m0 usage"').text == a.text
    assert a.query == "m0 usage" and "M0 USES C (1)" in a.text and "p.pdf introduces M0" in a.text and "[k1] about m0" in a.text
    assert answer(corpus, "M0?", lambda q: [0.0, 1.0], rewrite=lambda q: 1 / 0).query == "M0?"
    with pytest.raises(ValueError, match="empty"):
        answer(corpus, " ", lambda q: [1.0, 0.0])


def _document(n, indent=None):
    tricky = ['a, b', 'quote " and , comma', "back\\slash\\", "br{ace]s[}", "line\nbreak", "ünïcode ,  ", ""]
    entity = lambda i: {"name": f"E{i} {tricky[i % 7]}", "type": "Concept", "aliases": tricky[: i % 4], "evidence": [{"chunk_id": f"c,{i}", "page": i}] * (i % 3), "source_files": ["a.pdf"]}
    relation = lambda i: {"source_kind": "Entity", "source": f"E{i}", "relation": "USES", "target": tricky[i % 7], "target_type": "Concept", "evidence": [], "source_files": []}
    return {
        "metadata": {"raw_batch_records": 3, "entity_type_counts": {"Concept": n, 'x, "y"': 2}}, "papers": [{"source_file": f"p{i}, {tricky[i % 7]}", "focal_entities": [{"name": "N", "type": "Method", "aliases": tricky}]} for i in range(n % 5)],
        "entities": [entity(i) for i in range(n)], "extra": {"a": [1, [2, {"b": 3}]]}, "word": "x, y", "relations": [relation(i) for i in range(n // 2)],
    }


@pytest.mark.parametrize(("n", "indent"), [(0, None), (1, 2), (23, None), (200, 2)])
def test_document_of_any_form(spark, tmp_path, n, indent):
    """Pretty or in one line; splits of a few hundred bytes cut it anywhere."""
    whole = _document(n)
    (tmp_path / "kg.json").write_text(json.dumps(whole, ensure_ascii=False, indent=indent))
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        got = document.read_document(spark, str(tmp_path / "kg.json"))
        as_dicts = lambda df: sorted((json.loads(x) for x in df.toJSON().collect()), key=str)
        for name in ("papers", "entities", "relations"):
            assert as_dicts(getattr(got, name)) == sorted(whole[name], key=str)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    said = got.metadata.head()
    assert (said["raw_batch_records"], said["entity_type_counts"]) == (3, {"Concept": n, 'x, "y"': 2})


def test_document_is_read_by_elements(spark, tmp_path, monkeypatch):
    """Elements go on whole, not their pieces, but for those that a batch cuts; batches may cut anywhere, and so may files."""
    whole = _document(60)
    text = json.dumps(whole, ensure_ascii=False)
    for k, (a, b) in enumerate(((0, 2000), (2000, 2001), (2001, 9000), (9000, len(text)))):
        (tmp_path / f"p{k}.txt").write_text(text[a:b], newline="")
    kept, rows = document.written, []
    monkeypatch.setattr(document, "written", lambda df, name: (out := kept(df, name), rows.append(out.count()))[0])
    for size, most in (("10000", 120), ("3", 10**6)):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        try:
            rows.clear()
            got = document.read_document(spark, str(tmp_path))
            for name in ("papers", "entities", "relations"):
                assert sorted((json.loads(x) for x in getattr(got, name).toJSON().collect()), key=str) == sorted(whole[name], key=str)
            assert got.metadata.head()["entity_type_counts"] == {"Concept": 60, 'x, "y"': 2}
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        assert sum(rows) <= most and text.count(",") > 5 * 120


def test_document_round_trip(spark, tmp_path):
    from lodestone import schemas

    whole = _document(120)
    make = lambda name, kind: spark.createDataFrame([tuple(x[c] for c in [f.split()[0] for f in spark.createDataFrame([], kind).columns]) for x in whole[name]], kind)
    entities, relations = make("entities", schemas.CANONICAL_ENTITY), make("relations", schemas.CANONICAL_RELATION)
    papers = spark.createDataFrame([("p.pdf", [("N", "Method", ["a, b"])])], document.PAPERS)
    raw = spark.createDataFrame([("batches", 7), ("entities", 9)], "what string, n long")
    said = document.metadata_of(entities, relations, spark.createDataFrame([("why, not", 4)], "reason string, n long"), raw)
    document.write_document(papers, entities, relations, str(tmp_path / "g"), said)
    files_ = sorted((tmp_path / "g").glob("part-*"))
    text = "".join(p.read_text() for p in files_)
    parsed = json.loads(text)
    assert [e["name"] for e in parsed["entities"]] == sorted((e["name"] for e in whole["entities"]), key=lambda x: (x.lower(), x)) and parsed["papers"][0]["source_file"] == "p.pdf"
    assert parsed["metadata"]["dropped_relation_reasons"] == {"why, not": 4} and parsed["metadata"]["raw_batch_records"] == 7 and parsed["metadata"]["canonical_entities"] == 120
    back = document.read_document(spark, str(tmp_path / "g"))
    for a, b in ((back.entities, entities), (back.relations, relations), (back.papers, papers)):
        assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))
    assert back.metadata.head().asDict() == said.head().asDict()
    empty = spark.createDataFrame([], schemas.CANONICAL_ENTITY)
    document.write_document(papers.limit(0), empty, relations.limit(0), str(tmp_path / "none"))
    back = document.read_document(spark, str(tmp_path / "none"))
    assert back.entities.isEmpty() and back.papers.isEmpty() and back.metadata.head()["canonical_entities"] == 0
