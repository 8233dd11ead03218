"""A question end to end: seeds from words and vectors, two hops, provenance, and a prompt of the evidence."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions import text as X
from lodestone.operators import names, retrieval, vectors
from lodestone.operators.kg_store import edges
from lodestone.sources import prompts
from lodestone.sources.models import echo


@dataclass
class Corpus:
    """Tables a question is put to. chunk_vectors: chunk_id, embedding; chunks: chunk_id, text and more; nodes: key,
    name, entity_type, aliases; evidence as of kg_store.edges, with source_file and page if they are known; support: entity_key, chunk_id; introduces: paper,
    target_key, target; name_index as of names.index, without which all nodes are looked at for each question."""

    chunk_vectors: DataFrame
    chunks: DataFrame
    nodes: DataFrame
    evidence: DataFrame
    support: DataFrame
    introduces: DataFrame
    name_index: DataFrame | None = None


@dataclass
class Answer:
    query: str
    hits: DataFrame
    seeds: DataFrame
    facts: DataFrame
    chunks: DataFrame
    introductions: DataFrame
    prompt: str
    text: str


def answer(corpus: Corpus, question: str, embed: Callable[[str], list[float]], rewrite: Callable[[str], str] | None = None, write: Callable[[str], str] = echo, k: int = vectors.TOP_K) -> Answer:
    """The question is rewritten for the vector search only; words are looked up in the question as it was asked."""
    if not question.strip():
        raise ValueError("the question is empty")
    spark = corpus.nodes.sparkSession
    asked = question
    if rewrite:
        try:
            asked = spark.range(1).select(X.rewritten(F.lit(rewrite(question)), F.lit(question)).alias("q")).head()["q"]
        except Exception:  # noqa: BLE001  any failure of the rewriter leaves the question as it is
            asked = question
    hits = retrieval.settled(vectors.top_k(corpus.chunk_vectors, embed(asked), "chunk_id", k), k)
    if corpus.name_index is None:
        met = retrieval.lexical_seeds(F.lit(question), corpus.nodes)
    else:
        met = names.lexical_seeds(spark.createDataFrame([(0, question)], "qid long, question string"), corpus.name_index, retrieval.LEXICAL).drop("qid")
    lexical = retrieval.settled(met, retrieval.LEXICAL)
    bridge = retrieval.settled(retrieval.bridge_seeds(hits, corpus.support, corpus.nodes), retrieval.BRIDGE)
    seeds = retrieval.settled(retrieval.merge_seeds(lexical, bridge), retrieval.MERGED)
    focal = corpus.introduces.select(F.col("target_key").alias("key"))
    _, more, facts = retrieval.two_hops(corpus.evidence, seeds, focal)
    every = seeds.select("key", "name", "entity_type", "seed_source").unionByName(more.select("key", "name", "entity_type", "seed_source"))
    around = retrieval.touching(corpus.evidence, every)
    facts = retrieval.settled(retrieval.with_proof(facts, around), retrieval.HOP1 + retrieval.HOP2)
    papers = retrieval.introductions(every, corpus.introduces)
    proof = retrieval.provenance(facts, around, corpus.chunks)
    named = retrieval.merge_seeds(seeds, more, retrieval.MERGED + retrieval.SECONDARY)
    prompt = prompts.answer(sections(question, asked, named, papers, hits.join(corpus.chunks, "chunk_id"), facts, proof))
    return Answer(asked, hits, seeds, facts, proof, papers, prompt, write(prompt))


def sections(question: str, query: str, seeds: DataFrame, papers: DataFrame, hits: DataFrame, facts: DataFrame, proof: DataFrame) -> DataFrame:
    """The evidence for an answer as rows: section, rank, line. Each part is capped and ranked."""
    spark = facts.sparkSession
    s = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    listed = lambda c: F.array_join(F.coalesce(F.col(c).cast("array<string>"), F.array().cast("array<string>")), ", ")
    asked = spark.createDataFrame([("question", 1, question), ("query", 1, query)], "section string, rank int, line string")

    def part(name: str, rows: DataFrame, *line) -> DataFrame:
        return rows.select(F.lit(name).alias("section"), F.col("rank").cast("int").alias("rank"), F.concat(*line).alias("line"))

    place = lambda rows: [x for c, before in (("source_file", ", "), ("page", " page ")) if c in rows.columns for x in (F.lit(before), s(c))]
    proved = [x for c, before in (("source_files", "files"), ("evidence_pages", "pages"), ("evidence_chunk_ids", "chunks")) if c in facts.columns for x in (F.lit(f"; {before}: "), listed(c))]
    score = [F.lit(", score "), F.format_string("%.4f", F.col("score"))] if "score" in hits.columns else []
    out = asked.unionByName(part("seeds", seeds, s("name"), F.lit(" ("), s("entity_type"), F.lit(", "), s("seed_source"), F.lit(")")))
    out = out.unionByName(part("papers", papers, s("paper"), F.lit(" introduces "), s("target")))
    out = out.unionByName(part("vector", hits, F.lit("["), s("chunk_id"), *place(hits), *score, F.lit("] "), s("text")))
    out = out.unionByName(part("facts", facts, s("source"), F.lit(" "), s("relation"), F.lit(" "), s("target"), F.lit(" ("), s("evidence_count"), F.lit(")"), *proved))
    return out.unionByName(part("proof", proof, F.lit("["), s("chunk_id"), *place(proof), F.lit("] "), s("text")))


def named_entity_facts(question: str, model: Callable[[str], str], nodes: DataFrame, evidence: DataFrame | retrieval.Evidence) -> DataFrame:
    """The one-entity question: a model names the entity, or NONE; the edges out of the node of that name."""
    at = retrieval.named_entity(model(prompts.entity(question)), nodes).select("key")
    return edges(retrieval.leaving(evidence, at))


def compared(question: str, model: Callable[[str], str], contexts: dict[str, str]) -> dict[str, str]:
    """Answers without evidence, and from each context."""
    return {"model": model(prompts.direct(question))} | {name: model(prompts.from_context(question, x)) for name, x in contexts.items()}
