"""Queries over sources, sinks and tables: what is written from the driver's tables and read back, with its SQL."""

from __future__ import annotations

import json
import re

from pyspark.sql import functions as F

from lodestone import schemas
from lodestone.functions import text as X
from lodestone.operators import kg_store
from lodestone.plans import adapters as A
from lodestone.plans.registry import CHUNKS, NODES, query, with_
from lodestone.session import ensure_importable, shared_path, table, written
from lodestone.sources import files, models, page_text
from lodestone.sources.store import Store
from lodestone.streaming import ingest

NATION_PAGES = "page AS (SELECT n_name || '.pdf' AS source_file, s_suppkey + 1 AS page, s_name || ' has ' || CAST(CAST(floor(s_acctbal) AS BIGINT) AS VARCHAR) AS text FROM supplier JOIN nation ON s_nationkey = n_nationkey)"


def _nation_pages(spark, d):
    """Nations as papers, their suppliers as pages, with white space to be normalised."""
    supplier, nation = table(spark, d, "supplier"), table(spark, d, "nation")
    joined = supplier.join(nation, supplier["s_nationkey"] == nation["n_nationkey"])
    text = F.concat(F.lit("  "), "s_name", F.lit("\n has\t"), F.floor("s_acctbal").cast("bigint").cast("string"), F.lit(" \n"))
    return joined.select(F.concat("n_name", F.lit(".pdf")).alias("source_file"), (F.col("s_suppkey") + 1).cast("int").alias("page"), text.alias("text"))


@query(f"WITH {NATION_PAGES} SELECT source_file, page, text FROM page")
def page_text_files(spark, d):
    """Pages written as one text file a paper, with header and banners, and read from these files."""
    path = shared_path(spark, "page-text")
    page_text.write(_nation_pages(spark, d), path)
    return page_text.read(spark, f"{path}/*/*.txt")


def by_banner(content: bytes) -> list[str | None]:
    """The pages of a page-text file; a parser as ``files.page_files`` takes it."""
    return re.split(r"\n\n={5,} PAGE \d+ ={5,}\n\n", content.decode("utf-8", "replace"))[1:]


@query(f"WITH {NATION_PAGES} SELECT CAST(row_number() OVER (PARTITION BY source_file ORDER BY page) AS INTEGER) AS page, text FROM page")
def page_files_scan(spark, d):
    """A folder of files, each put through a parser that gives its pages."""
    path = shared_path(spark, "page-files")
    page_text.write(_nation_pages(spark, d), path)
    found = files.page_files(spark, path, by_banner, "*.txt").filter("failure is null")
    return found.select("page", X.collapse(F.col("text")).alias("text"))


@query(f"WITH {NATION_PAGES} SELECT count(DISTINCT source_file) AS n_papers, 0 AS n_failed, count(*) AS n_pages, count(*) AS n_filled, CAST(sum(length(text)) AS BIGINT) AS n_chars, 0 AS n_invalid FROM page")
def extraction_summary(spark, d):
    pages = _nation_pages(spark, d).select("source_file", "page", X.collapse(F.col("text")).alias("text"), F.lit(0).alias("n_invalid"), F.lit(None).cast("string").alias("failure"))
    return files.summary(pages)


@query(with_(CHUNKS, then="SELECT *, CAST(char_start + length(text) AS INTEGER) AS char_end FROM chunks"))
def chunk_lines(spark, d):
    """Chunks written as JSON lines and read back."""
    path = shared_path(spark, "chunks")
    files.write_chunks(A.chunks(spark, d), path)
    return files.read_chunks(spark, path)


ANSWERED = "told AS (SELECT conv_id, turn, text, (conv_id + turn) % 5 = 0 AS mute, (conv_id + turn) % 7 = 0 AS odd FROM conversations)"


def _shout(prompt: str) -> str:
    """A stand-in for a model: silent on some prompts, in a fence or in the wrong shape on others."""
    kind, _, text = prompt.partition("|")
    if "m" in kind:
        raise RuntimeError("no answer")
    return f"```json\n{json.dumps({'said': text.upper()[:20]})}\n```" if "o" not in kind else "no record"


def _prompts(spark, d):
    n = F.col("conv_id") + F.col("turn")
    kind = F.concat(F.when(n % 5 == 0, "m").otherwise(""), F.when(n % 7 == 0, "o").otherwise(""), F.lit("|"))
    ascii_only = F.regexp_replace("text", "[^A-Za-z ]", "")
    return table(spark, d, "conversations").select("conv_id", "turn", F.concat(kind, ascii_only).alias("prompt"))


@query(f"WITH {ANSWERED} SELECT conv_id, turn, CASE WHEN NOT mute THEN CASE WHEN odd THEN 'no record' ELSE '```json' || chr(10) || '{{\"said\": \"' || left(upper(regexp_replace(text, '[^A-Za-z ]', '', 'g')), 20) || '\"}}' || chr(10) || '```' END END AS answer FROM told")
def model_answers(spark, d):
    """A model's answer to each turn; none where it fails three times."""
    return models.ask(_prompts(spark, d), _shout).select("conv_id", "turn", "answer")


@query(f"WITH {ANSWERED} SELECT conv_id, turn, CASE WHEN NOT mute AND NOT odd THEN left(upper(regexp_replace(text, '[^A-Za-z ]', '', 'g')), 20) END AS said FROM told")
def model_records(spark, d):
    """A model's answers as records; none where an answer is of another shape."""
    return models.ask_json(_prompts(spark, d), _shout, "said STRING").select("conv_id", "turn", "record.said")


@query("SELECT CAST(conv_id AS VARCHAR) || '-' || CAST(turn AS VARCHAR) AS chunk_id, CASE WHEN (conv_id + turn) % 7 = 0 THEN 'open' ELSE 'done' END AS state, CASE WHEN (conv_id + turn) % 7 = 0 THEN 2 WHEN (conv_id + turn) % 5 = 0 THEN 2 ELSE 1 END AS attempts, (conv_id + turn) % 7 <> 0 AS kept FROM conversations")
def ingest_journal(spark, d):
    """The ledger after two runs over files of chunks, with a model that is down for some in the first and for others in
    both: what was extracted stands beside what the ledger says."""
    from pyspark.sql.types import StructType

    base = shared_path(spark, "ingest")
    turns = table(spark, d, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("chunk_id"), F.col("conv_id").cast("string").alias("paper_id"), "text", (F.col("conv_id") + F.col("turn")).cast("int").alias("page"))
    turns.write.json(f"{base}/in")

    def extract(up: bool):
        down = (F.col("page") % 7 == 0) | (F.lit(not up) & (F.col("page") % 5 == 0))
        return lambda chunks: chunks.select("chunk_id", F.when(~down, F.struct(F.length("text").alias("n"))).alias("record"))

    for up in (False, True):
        stream = spark.readStream.schema(StructType.fromDDL(schemas.CHUNKS)).json(f"{base}/in")
        ingest.ingest(stream, extract(up), f"{base}/out", f"{base}/mark").awaitTermination()
    journal = ingest.Journal(spark, f"{base}/out")
    kept = journal.rows().select("chunk_id").withColumn("kept", F.lit(True))
    return journal.ledger().join(kept, "chunk_id", "left").select("chunk_id", "state", "attempts", F.coalesce("kept", F.lit(False)).alias("kept"))


@query("SELECT CAST(l_orderkey AS INTEGER) AS batch_number, 'src' || CAST(l_orderkey % 6 AS VARCHAR) || '.pdf' AS source_file, CAST(CASE WHEN l_orderkey % 3 = 0 THEN 0 ELSE count(*) + (1 - l_orderkey % 2) END AS BIGINT) AS n_entities, count(*) AS n_relations FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_orderkey")
def experiment_records(spark, d):
    """Records of a trial, in which a failed part is written as empty."""
    path = shared_path(spark, "experiment")
    raw = A.raw_batches(spark, d).withColumn("entities", F.when(F.col("batch_number") % 3 != 0, F.col("entities")))
    files.write_experiment(raw, path)
    back = spark.read.schema(f"batch_number INT, source_file STRING, chunk_ids ARRAY<STRING>, entities ARRAY<{schemas.ENTITY}>, relations ARRAY<{schemas.RELATION}>").json(path)
    return back.select("batch_number", "source_file", F.size("entities").cast("long").alias("n_entities"), F.size("relations").cast("long").alias("n_relations"))


@query("SELECT user_id, event_id, event_type, value FROM events WHERE user_id % 11 <> 3 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id % 2, ts DESC, event_id DESC) = 1")
def table_upkeep(spark, d):
    """A stored table after two loads, of which the later wins, and a removal of all rows of some keys."""
    store = Store(spark, shared_path(spark, "store"), buckets=16)
    rows = table(spark, d, "events").select("user_id", "event_id", "event_type", "value", "ts")
    store.upsert("t", rows.filter("event_id % 2 = 1"), ["user_id"], ["ts", "event_id"])
    store.upsert("t", rows.filter("event_id % 2 = 0"), ["user_id"], ["ts", "event_id"])
    store.replace("t", rows.limit(0), "user_id", rows.filter("user_id % 11 = 3").select("user_id").distinct())
    return store.read("t").drop("ts")


@query("SELECT 't' AS name, true AS present, 2 AS version, count(DISTINCT user_id) AS n FROM events UNION ALL SELECT 'none', false, 0, 0")
def table_states(spark, d):
    """Whether tables are there, their versions and their rows."""
    store = Store(spark, shared_path(spark, "store"), buckets=16)
    rows = table(spark, d, "events").select("user_id", "event_id")
    store.upsert("t", rows.filter("event_id % 2 = 1"), ["user_id"], ["event_id"])
    store.upsert("t", rows.filter("event_id % 2 = 0"), ["user_id"], ["event_id"])
    return store.state("t").unionByName(store.state("none"))


@query("SELECT page_id, left(lower(trim(regexp_replace(regexp_replace(url, '\\.[^.]*$', ''), '\\W+', '_', 'g'), '_')), 80) AS paper_id FROM pages WHERE regexp_full_match(url, '[\\x00-\\x7F]*')")
def paper_ids(spark, d):
    """Paper ids of the pages' addresses, taken as file names; those that are ASCII."""
    ensure_importable(spark)
    return table(spark, d, "pages").filter(F.col("url").rlike(r"^[\x00-\x7F]*$")).select("page_id", X.paper_id(F.col("url")).alias("paper_id"))


SPACED = "spaced AS (SELECT p_partkey, '  ' || p_name || chr(160) || chr(8211) || '  ' || chr(65313) || CASE WHEN p_partkey % 2 = 0 THEN 'STRASSE' ELSE 'Straße' END || chr(8195) || p_brand || chr(10) AS said FROM part)"


@query(f"WITH {SPACED} SELECT p_partkey, trim(regexp_replace(replace(replace(replace(said, chr(8211), '-'), chr(65313), 'A'), chr(160), ' '), '[\\s\\x{{2003}}]+', ' ', 'g')) AS name, replace(lower(trim(regexp_replace(replace(replace(replace(said, chr(8211), '-'), chr(65313), 'A'), chr(160), ' '), '[\\s\\x{{2003}}]+', ' ', 'g'))), 'ß', 'ss') AS key, trim(regexp_replace(replace(said, chr(160), ' '), '[\\s\\x{{2003}}]+', ' ', 'g')) AS collapsed FROM spaced")
def name_forms(spark, d):
    """Names in normal form, their keys without case, and with white space collapsed only; from names with wide letters,
    dashes, sharp s and odd spaces."""
    ensure_importable(spark)
    street = F.when(F.col("p_partkey") % 2 == 0, "STRASSE").otherwise("Straße")
    said = F.concat(F.lit("  "), "p_name", F.lit(" –  Ａ"), street, F.lit(" "), "p_brand", F.lit("\n"))
    return table(spark, d, "part").select("p_partkey", X.normal_name(said).alias("name"), X.name_key(said).alias("key"), X.collapse(said).alias("collapsed"))


def _canonical_sql() -> str:
    known = ", ".join(f"('{k.replace(chr(39), chr(39) * 2)}', '{v.replace(chr(39), chr(39) * 2)}')" for k, v in schemas.CANONICAL_NAMES.items())
    return f"WITH known AS (SELECT * FROM (VALUES {known}) AS t(k, v)), numbered AS (SELECT k, v, row_number() OVER (ORDER BY k) - 1 AS i FROM known), said AS (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_name ELSE upper(k) || ' ' END AS said FROM part JOIN numbered ON i = p_partkey % (SELECT count(*) FROM known)) SELECT p_partkey, coalesce(v, trim(said)) AS name FROM said LEFT JOIN known ON k = lower(trim(said))"


@query(_canonical_sql())
def canonical_names(spark, d):
    """Names as they are spelled canonically: two of three parts go by a known other spelling, in capitals."""
    ensure_importable(spark)
    spelled = F.array(*[F.lit(k) for k in sorted(schemas.CANONICAL_NAMES)])
    said = F.when(F.col("p_partkey") % 3 == 0, F.col("p_name")).otherwise(F.concat(F.upper(F.get(spelled, (F.col("p_partkey") % len(schemas.CANONICAL_NAMES)).cast("int"))), F.lit(" ")))
    return table(spark, d, "part").select("p_partkey", X.canonical_name(said).alias("name"))


@query("SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN text WHEN turn % 3 = 1 THEN coalesce(nullif(trim(text, '\" '), ''), text) ELSE text END AS asked FROM conversations WHERE regexp_full_match(text, '[^ \"](?s:.)*[^ \"]')")
def rewritten_questions(spark, d):
    """Rewritten questions without the quotes around them; the question itself where nothing was written."""
    turn = F.col("turn") % 3
    answer = F.when(turn == 0, F.lit(' "" ')).when(turn == 1, F.concat(F.lit(' "'), "text", F.lit('" ')))
    whole = table(spark, d, "conversations").filter(F.col("text").rlike(r'^(?s:[^ "].*[^ "])$'))
    return whole.select("conv_id", "turn", X.rewritten(answer, F.col("text")).alias("asked"))


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN coalesce(text, '') || chr(65533) || 'x' ELSE coalesce(text, '') END AS text, CAST(length(coalesce(text, '')) - length(replace(coalesce(text, ''), chr(65533), '')) + (1 - doc_id % 2) AS INTEGER) AS n_invalid FROM documents")
def valid_texts(spark, d):
    """Texts of raw bytes, of which every other has a byte that is no UTF-8."""
    raw = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    broken = F.when(F.col("doc_id") % 2 == 0, F.concat(raw, F.unhex(F.lit("FF78")))).otherwise(raw)
    text, n = X.valid_unicode(broken)
    return table(spark, d, "documents").select("doc_id", text.alias("text"), n.alias("n_invalid"))


@query(with_(NODES, then="""
    , focal AS (SELECT n_name AS source_file, CASE s_suppkey % 4 WHEN 0 THEN upper(s_name) WHEN 1 THEN 'the ' || lower(s_name) WHEN 2 THEN 'no such method' ELSE s_name END AS name, s_name, s_suppkey, CASE WHEN s_suppkey % 5 = 0 THEN 'Task' ELSE 'Method' END AS type FROM supplier JOIN nation ON s_nationkey = n_nationkey)
    SELECT DISTINCT source_file, 'Method::' || lower(s_name) AS target_key, true AS generated_from_profile FROM focal WHERE type = 'Method' AND s_suppkey % 4 <> 2 AND source_file NOT IN (SELECT n_name FROM nation WHERE n_nationkey = 0)"""))
def introduces_from_profiles(spark, d):
    """INTRODUCES edges that profiles imply: their methods go by a name in capitals, an alias, or a name that nothing has;
    some are tasks, and one paper is unknown."""
    supplier, nation = table(spark, d, "supplier"), table(spark, d, "nation")
    joined = supplier.join(nation, supplier["s_nationkey"] == nation["n_nationkey"])
    k = F.col("s_suppkey") % 4
    name = F.when(k == 0, F.upper("s_name")).when(k == 1, F.concat(F.lit("the "), F.lower("s_name"))).when(k == 2, "no such method").otherwise(F.col("s_name"))
    kind = F.when(F.col("s_suppkey") % 5 == 0, "Task").otherwise("Method")
    profiles = joined.select(F.col("n_name").alias("source_file"), F.array(F.struct(name.alias("name"), kind.alias("type"))).alias("focal"))
    nodes = A.nodes(spark, d)
    also = F.when(F.col("entity_type") == "Method", F.array(F.concat(F.lit("the "), F.lower("name")))).otherwise(F.array().cast("array<string>"))
    lookup = kg_store.load_lookup(nodes.select("key", "name", also.alias("aliases"), F.lit(0).alias("seq")))
    papers = nation.filter("n_nationkey != 0").select(F.col("n_name").alias("source_file"))
    return kg_store.introductions_of(profiles, lookup, papers, nodes)


@query("SELECT s_suppkey, s_name || '.pdf' AS source_file, 'Method' AS type, lower(s_name) AS alias FROM supplier")
def profile_files(spark, d):
    """Profiles written to files by source file, and read back."""
    path = shared_path(spark, "profiles")
    focal = F.array(F.struct(F.col("s_name").alias("name"), F.lit("Method").alias("type"), F.array(F.lower("s_name")).alias("aliases")))
    files.write_profiles(table(spark, d, "supplier").select(F.concat("s_name", F.lit(".pdf")).alias("source_file"), focal.alias("focal_entities")), path)
    back = written(files.read_profiles(spark, path), "profiles").select("source_file", F.col("focal_entities")[0].alias("f"))
    keyed = table(spark, d, "supplier").select("s_suppkey", F.concat("s_name", F.lit(".pdf")).alias("source_file"))
    return keyed.join(back, "source_file").select("s_suppkey", "source_file", F.col("f.type").alias("type"), F.col("f.aliases")[0].alias("alias"))
