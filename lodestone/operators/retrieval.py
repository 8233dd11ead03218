"""Hybrid retrieval: seeds, two-hop expansion, fact ranking, provenance.

Each capped set is small by its cap and carries an explicit rank. Between hops it is settled: computed once, held as a
local relation, and turned into a filter on the large tables.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone import schemas
from lodestone.functions import text as X
from lodestone.operators.kg_store import edges
from lodestone.operators.ordering import ranked_whole
from lodestone.operators.vectors import ranked

LEXICAL, BRIDGE, MERGED, SECONDARY, HOP1, HOP2, PROOF = 8, 6, 10, 6, 32, 28, 14


def lexical_seeds(question: Column, entities: DataFrame, cap: int = LEXICAL) -> DataFrame:
    """``entities``: key, name, entity_type, aliases. Entities that the question mentions by name or alias, those with
    the longest mention first."""
    spelled = F.filter(F.array_distinct(F.concat(F.array("name"), "aliases")), lambda n: X.mentions(question, n))
    longest = F.array_max(F.transform(spelled, lambda n: F.struct(F.length(n).alias("n"), n.alias("matched"))))
    hits = entities.withColumn("_m", longest).filter(F.col("_m").isNotNull())
    order = (F.length("matched_text").desc(), F.col("key"))
    best = hits.select("key", "name", "entity_type", F.lit("lexical").alias("seed_source"), F.col("_m.matched").alias("matched_text")).orderBy(*order).limit(cap)
    return ranked(best, *order)


def lexical_seeds_v1(question: Column, entities: DataFrame, cap: int = LEXICAL) -> DataFrame:
    """The older rule: the name anywhere in the question, or an alias of four characters or more."""
    low = F.lower(question)
    hit = F.contains(low, F.lower("name")) | F.exists("aliases", lambda a: (F.length(a) >= 4) & F.contains(low, F.lower(a)))
    best = entities.filter(hit & (F.col("name") != "")).select("key", "name", "entity_type").orderBy(F.length("name").desc(), "key").limit(cap)
    return ranked(best, F.length("name").desc(), F.col("key"))


def bridge_seeds(hits: DataFrame, support: DataFrame, nodes: DataFrame, cap: int = BRIDGE) -> DataFrame:
    """Entities that the hit chunks support, by the number of such chunks. ``hits``: chunk_id; ``support``: entity_key,
    chunk_id; ``nodes``: key, name, entity_type."""
    counted = support.join(hits.select("chunk_id"), "chunk_id").groupBy("entity_key").agg(F.countDistinct("chunk_id").alias("support_count"))
    named = counted.join(nodes, counted["entity_key"] == nodes["key"])
    order = (F.col("support_count").desc(), F.col("name"), F.col("key"))
    best = named.select("key", "name", "entity_type", F.lit("vector_bridge").alias("seed_source"), "support_count").orderBy(*order).limit(cap)
    return ranked(best, *order)


def merge_seeds(lexical: DataFrame, bridge: DataFrame, cap: int = MERGED) -> DataFrame:
    """Lexical seeds, then bridge seeds, each key once, at most ``cap``."""
    both = lexical.select("key", "name", "entity_type", "seed_source", F.lit(0).alias("c"), "rank").unionByName(bridge.select("key", "name", "entity_type", "seed_source", F.lit(1).alias("c"), "rank"))
    once = both.groupBy("key").agg(F.min_by(F.struct("name", "entity_type", "seed_source"), F.struct("c", "rank")).alias("x"), F.min(F.struct("c", "rank")).alias("o"))
    best = once.select("key", "x.*", "o").orderBy("o").limit(cap)
    return ranked(best, F.col("o")).drop("o")


def priority(relation: str = "relation") -> Column:
    table = F.create_map(*[F.lit(x) for pair in schemas.RELATION_RANK.items() for x in pair])
    return F.coalesce(F.element_at(table, F.col(relation)), F.lit(99))


def fact_order() -> list[Column]:
    return [priority(), F.col("evidence_count").desc(), F.lower("source"), F.lower("target"), F.col("source_key"), F.col("target_key")]


def dedupe_facts(facts: DataFrame) -> DataFrame:
    """Of each source, relation and target, the fact with the most evidence; ties by ``hop``, the first found."""
    keys = ["source_key", "relation", "target_key"]
    rest = [c for c in facts.columns if c not in keys]
    order = F.struct(F.col("evidence_count"), *([-F.col("hop")] if "hop" in rest else []))
    once = facts.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("f"))
    return once.select(*keys, "f.*").select(*facts.columns)


def rank_facts(facts: DataFrame, cap: int | None) -> DataFrame:
    """By priority of the relation, then evidence, then names."""
    best = facts.orderBy(*fact_order()).limit(cap) if cap else facts
    return ranked(best, *fact_order())


def rank_facts_v1(facts: DataFrame, cap: int = 30) -> DataFrame:
    order = [F.col("evidence_count").desc(), F.col("source"), F.col("relation"), F.col("target"), F.col("source_key"), F.col("target_key")]
    return ranked(facts.orderBy(*order).limit(cap), *order)


def settled(capped: DataFrame, cap: int) -> DataFrame:
    """A result that a limit bounds to a few dozen rows, computed once and held as a local relation; what follows
    neither repeats its plan nor shuffles for it."""
    rows = capped.collect()
    if len(rows) > cap:
        raise ValueError(f"more than {cap} rows")
    return capped.sparkSession.createDataFrame(rows, capped.schema)


@dataclass(frozen=True)
class Evidence:
    """Stored evidence twice: in order of the source's key, and of the target's, so that a filter on either reads a part. Or
    ``near``, which gives evidence that has all edges with one of a few keys at an end, and may have others."""

    by_source: DataFrame
    by_target: DataFrame
    near: Callable[[list[str]], DataFrame] | None = None


def _sides(evidence: DataFrame | Evidence, keys: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    if not isinstance(evidence, Evidence):
        return evidence, evidence
    if keys and evidence.near is not None:
        near = evidence.near(keys)
        return near, near
    return evidence.by_source, evidence.by_target


def leaving(evidence: DataFrame | Evidence, seeds: DataFrame, few: int = 64) -> DataFrame:
    """Evidence of edges out of seeds."""
    known = seeds.select("key").distinct()
    keys = sorted(r["key"] for r in known.limit(few + 1).collect())
    if len(keys) <= few:
        rows, _ = _sides(evidence, keys)
        return rows.filter(F.col("source_key").isin(keys)) if keys else rows.filter(F.lit(False))
    rows, _ = _sides(evidence)
    return rows.join(known, rows["source_key"] == known["key"], "left_semi")


def touching(evidence: DataFrame | Evidence, seeds: DataFrame, relations: list[str] | None = None, few: int = 64) -> DataFrame:
    """Evidence of edges with a seed at either end, without repeats, below the count of edges: only the seeds' part of
    the graph is aggregated. Up to ``few`` seeds become filters, one for each end, so that each reaches the table it is
    about before anything is joined, and parts of the graph whose type no seed has fall away; more seeds are joined on
    each end."""
    known = seeds.select("key").distinct()
    keys = sorted(r["key"] for r in known.limit(few + 1).collect())
    rows, into = (x.filter(F.col("relation").isin(relations or list(schemas.RELATION_RANK))) for x in _sides(evidence, keys if len(keys) <= few else None))
    if not keys:
        return rows.filter(F.lit(False))
    if len(keys) <= few:
        kinds = sorted({k.split("::")[0] for k in keys})
        out = rows.filter(F.col("source_type").isin(kinds) & F.col("source_key").isin(keys))
        return out.unionByName(into.filter(F.col("target_type").isin(kinds) & F.col("target_key").isin(keys) & ~F.col("source_key").isin(keys)))
    out = rows.join(known, rows["source_key"] == known["key"], "left_semi")
    into = into.join(known, into["target_key"] == known["key"], "left_semi").join(known, into["source_key"] == known["key"], "left_anti")
    return out.unionByName(into)


def with_proof(facts: DataFrame, evidence: DataFrame) -> DataFrame:
    """Capped facts with what supports them: source_files, evidence_pages and evidence_chunk_ids, each sorted, without
    repeats. ``evidence``: rows of the facts' edges with chunk_id and, if they are known, source_file and page."""
    keys = ["source_key", "relation", "target_key"]
    held = evidence.join(F.broadcast(facts.select(*keys)), keys, "left_semi")
    known = [(c, name) for c, name in (("source_file", "source_files"), ("page", "evidence_pages"), ("chunk_id", "evidence_chunk_ids")) if c in evidence.columns]
    proof = held.groupBy(*keys).agg(*[F.sort_array(F.collect_set(c)).alias(name) for c, name in known])
    return facts.join(proof, keys, "left")


def with_ends(facts: DataFrame, nodes: DataFrame) -> DataFrame:
    """Capped facts with the names and types that the nodes at their ends have. ``nodes``: key, name, entity_type."""
    out = facts.drop("source", "source_type", "target", "target_type")
    for end in ("source", "target"):
        at = nodes.select(F.col("key").alias(f"{end}_key"), F.col("name").alias(end), F.col("entity_type").alias(f"{end}_type"))
        out = at.join(F.broadcast(out), f"{end}_key")
    return out.select(*facts.columns)


def named_entity(answer: str | None, nodes: DataFrame) -> DataFrame:
    """The node that a model's answer names, whatever its case; none where it answers NONE or names no node."""
    name = (answer or "").strip().strip('"').lower()
    return nodes.filter(F.lower("name") == name) if name and name != "none" else nodes.filter(F.lit(False))


def expand(evidence: DataFrame | Evidence, seeds: DataFrame, cap: int = HOP1) -> DataFrame:
    """Ranked facts one hop around at most a few dozen seeds, in stored direction."""
    return rank_facts(edges(touching(evidence, seeds)), cap)


def secondary_seeds(facts: DataFrame, seeds: DataFrame, focal: DataFrame, cap: int = SECONDARY) -> DataFrame:
    """Focal methods among the facts' ends that are not seeds yet, in the order of the facts, sources before targets.
    ``focal``: key."""
    ends = facts.select("rank", F.posexplode(F.array(F.struct(F.col("source_key").alias("key"), F.col("source").alias("name"), F.col("source_type").alias("entity_type")), F.struct(F.col("target_key").alias("key"), F.col("target").alias("name"), F.col("target_type").alias("entity_type")))).alias("side", "x"))
    ends = ends.select("rank", "side", "x.*").filter(F.col("entity_type").isin(schemas.FOCAL_TYPES))
    once = ends.groupBy("key", "name", "entity_type").agg(F.min(F.struct("rank", "side")).alias("o"))
    fresh = once.join(focal.select("key").distinct(), "key", "left_semi").join(seeds.select("key"), "key", "left_anti")
    best = fresh.orderBy("o").limit(cap)
    return ranked(best, F.col("o")).drop("o").withColumn("seed_source", F.lit("graph_neighbor"))


def two_hops(evidence: DataFrame | Evidence, seeds: DataFrame, focal: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """First-hop facts, secondary seeds, and all facts of both hops, ranked."""
    seeds = settled(seeds, MERGED)
    first = settled(expand(evidence, seeds, HOP1), HOP1)
    more = settled(secondary_seeds(first, seeds, focal), SECONDARY)
    second = expand(evidence, more, HOP2)
    both = first.drop("rank").withColumn("hop", F.lit(1)).unionByName(second.drop("rank").withColumn("hop", F.lit(2)))
    return first, more, rank_facts(dedupe_facts(both).drop("hop"), HOP1 + HOP2)


def introductions(seeds: DataFrame, introduces: DataFrame) -> DataFrame:
    """Which papers introduce the seeds, any number of them, ranked. ``introduces``: paper, target_key, target."""
    met = introduces.join(seeds.select(F.col("key").alias("target_key")).distinct(), "target_key").select("paper", "target_key", "target").distinct()
    return ranked_whole(met, ["paper", "target", "target_key"]).withColumn("rank", F.col("rank").cast("int"))


def provenance(facts: DataFrame, fact_chunks: DataFrame, chunks: DataFrame, cap: int = PROOF) -> DataFrame:
    """The first ``cap`` distinct chunks of ranked facts that ``chunks`` has; unknown ids use up the cap.
    ``fact_chunks``: source_key, relation, target_key, chunk_id."""
    each = facts.select("rank", "source_key", "relation", "target_key").join(fact_chunks, ["source_key", "relation", "target_key"])
    first = each.groupBy("chunk_id").agg(F.min("rank").alias("r"))
    capped = ranked(first.orderBy("r", "chunk_id").limit(cap), F.col("r"), F.col("chunk_id"))
    return capped.select("rank", "chunk_id").join(chunks, "chunk_id")


def neighbors(edge_table: DataFrame, name: str) -> DataFrame:
    """Edges out of the nodes with a name, whatever its case."""
    return edge_table.filter(F.lower("source") == name.lower())


def context(rows: DataFrame, block: Column, out: str = "context") -> DataFrame:
    """Blocks of a capped, ranked result as one text, in order, with blank lines between."""
    listed = rows.agg(F.sort_array(F.collect_list(F.struct("rank", block.alias("b")))).alias("x"))
    return listed.select(F.array_join(F.transform("x", lambda r: r["b"]), "\n\n").alias(out))
