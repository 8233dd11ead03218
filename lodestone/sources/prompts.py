"""Prompts for the models that profile papers, extract relations, rewrite questions and write answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone import schemas

TITLES = {"question": "Question", "query": "Query of the vector search", "seeds": "Entities", "papers": "Papers", "vector": "Passages like the question", "facts": "Facts", "proof": "Passages behind the facts"}


def rewrite(question: str) -> str:
    return f"Turn the question into one short English search query for passages of papers. Keep every name, acronym and data set as it is, add nothing, answer nothing, and give the query alone.\n\nQuestion: {question}"


def entity(question: str) -> str:
    return f"Which one named entity is the question about? Give its name alone, or NONE if it names none.\n\nQuestion: {question}"


def direct(question: str) -> str:
    return f"Answer briefly.\n\nQuestion: {question}"


def from_context(question: str, context: str) -> str:
    return f"Answer from the passages alone; if they don't hold the answer, say so.\n\n{context}\n\nQuestion: {question}"


def _passages(chunks: Column) -> Column:
    """``chunks``: array of chunk_id, page, text."""
    return F.array_join(F.transform(chunks, lambda c: F.concat(F.lit("["), c["chunk_id"], F.lit(", page "), c["page"].cast("string"), F.lit("]\n"), c["text"])), "\n\n")


def profile(source_file: Column, chunks: Column) -> Column:
    """Asks for the methods or models that a paper introduces, given its first chunks."""
    head = F.concat(F.lit("Which method or model does the paper "), source_file, F.lit(" introduce? Use the passages alone; leave out what it only cites or compares with.\n"))
    shape = 'Give JSON alone: {"focal_entities": [{"name": "", "type": "", "aliases": []}]}, with type one of ' + ", ".join(schemas.FOCAL_TYPES) + ", and aliases that the passages spell out.\n\n"
    return F.concat(head, F.lit(shape), _passages(chunks))


def extraction(source_file: Column, focal: Column, chunks: Column) -> Column:
    """Asks for entities and relations of a batch of chunks. ``focal``: JSON of the paper's focal entities."""
    rules = "; ".join(f"{r} to {' or '.join(t)}" for r, t in schemas.TARGET_TYPES.items())
    lines = [
        "List what the passages state about the paper's own methods, and nothing that they don't state. Names that only occur near each other are not related.",
        f"Entity types: {', '.join(schemas.ENTITY_TYPES)}. Relations, each with the types of its target: {rules}.",
        "The source of INTRODUCES is PAPER; of any other relation, one of the paper's own methods. Each item names the chunk and page that state it.",
        'Give JSON alone: {"entities": [{"name": "", "type": "", "aliases": [], "evidence": [{"chunk_id": "", "page": 0}]}], "relations": [{"source": "", "type": "", "target": "", "evidence": [{"chunk_id": "", "page": 0}]}]}',
    ]
    return F.concat(F.lit("\n".join(lines) + "\n\nPaper: "), source_file, F.lit("\nIts own methods: "), focal, F.lit("\n\n"), _passages(chunks))


def answer(rows: DataFrame) -> str:
    """``rows``: section, rank, line; a few hundred lines at most. Sections in their order, lines by rank."""
    held: dict[str, list[str]] = {name: [] for name in TITLES}
    for r in rows.orderBy("section", "rank").collect():
        held[r["section"]].append(r["line"])
    rules = "Answer from the evidence below alone, in the question's language, and name the paper and page behind each statement. COMPARED_WITH says that two methods were compared and nothing about how either works. Where passages and facts disagree, follow the passages and say so; where both fall short, say that."
    return "\n\n".join([rules, *(f"## {title}\n" + ("\n".join(f"- {x}" for x in held[name]) or "none") for name, title in TITLES.items())])
