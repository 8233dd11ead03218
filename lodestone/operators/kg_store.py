"""Graph tables: nodes, edges, provenance, and the checks on them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions import text as X
from lodestone.operators.chunking import latest


def nodes(entities: DataFrame) -> DataFrame:
    """``entities``: name, type and more. Adds the key; one table for all types."""
    return entities.withColumn("key", X.entity_key(F.col("type"), F.col("name"))).withColumnRenamed("type", "entity_type")


def edges(evidence: DataFrame) -> DataFrame:
    """``evidence``: source_key, source, source_type, relation, target_key, target, target_type, chunk_id; one row for
    each chunk that supports an edge. Edges with the number of distinct chunks."""
    keys = ["source_key", "source", "source_type", "relation", "target_key", "target", "target_type"]
    return evidence.groupBy(*keys).agg(F.countDistinct("chunk_id").alias("evidence_count"))


def edges_with_proof(evidence: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """As ``edges``, with the files, pages and chunks behind each, sorted, without repeats. ``keys``: other columns that tell
    edges apart, such as numbers for names."""
    keys = keys or ["source_key", "source", "source_type", "relation", "target_key", "target", "target_type"]
    sets = [F.sort_array(F.collect_set(c)).alias(name) for c, name in (("source_file", "source_files"), ("page", "evidence_pages"), ("chunk_id", "evidence_chunk_ids"))]
    return evidence.groupBy(*keys).agg(*sets).withColumn("evidence_count", F.size("evidence_chunk_ids").cast("long"))


def support(entities: DataFrame, chunks: DataFrame) -> DataFrame:
    """``entities``: key, evidence; ``chunks``: chunk_id. One row for each entity and known chunk; of several pages,
    the last in order."""
    each = entities.select("key", F.posexplode("evidence").alias("at", "e")).select("key", "at", "e.chunk_id", "e.page").filter(F.coalesce("chunk_id", F.lit("")) != "")
    met = each.join(chunks.select("chunk_id").distinct(), "chunk_id", "left_semi")
    return met.groupBy(F.col("key").alias("entity_key"), "chunk_id").agg(F.max_by("page", "at").alias("page"))


def repeated_keys(rows: DataFrame, key: str) -> DataFrame:
    """Keys that are not unique; empty if all is well."""
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def load_lookup(entities: DataFrame) -> DataFrame:
    """``entities``: key, name, aliases, seq. lower-case name or alias -> key; the last in load order wins."""
    each = entities.select("key", "seq", F.posexplode(F.concat(F.array("name"), "aliases")).alias("at", "spelled"))
    return each.groupBy(F.lower(F.trim("spelled")).alias("spelled")).agg(F.max_by("key", F.struct("seq", "at")).alias("key"))


def introductions_of(profiles: DataFrame, lookup: DataFrame, papers: DataFrame, node_table: DataFrame) -> DataFrame:
    """``profiles``: source_file, focal (array). INTRODUCES edges that profiles imply: each focal entity, or what its
    name stands for, joined to known papers and nodes."""
    each = profiles.select("source_file", F.explode("focal").alias("f")).filter(F.col("f.type").isin("Method", "Model"))
    each = each.withColumn("own", X.entity_key(F.col("f.type"), F.col("f.name"))).withColumn("spelled", F.lower(F.trim("f.name")))
    found = each.join(lookup, "spelled", "left").select("source_file", F.coalesce("key", "own").alias("target_key"))
    known = found.join(node_table.select(F.col("key").alias("target_key")), "target_key", "left_semi")
    return known.join(papers.select("source_file"), "source_file", "left_semi").distinct().withColumn("generated_from_profile", F.lit(True))


def loadable(relations: DataFrame, lookup: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``relations``: source_kind, source, relation, target and more. INTRODUCES edges come from papers, all others from
    entities; endpoints that stand for nothing drop the relation. The edges between entities, and those from papers.

    Of relations with the same ends the last in load order stays, whole: by ``seq`` if there is such a column, else by
    source, relation and target without case, as graph files are sorted, then by content.
    """
    t = lookup.select(F.col("spelled").alias("_t"), F.col("key").alias("target_key"))
    s = lookup.select(F.col("spelled").alias("_s"), F.col("key").alias("source_key"))
    ended = relations.withColumn("_t", F.lower(F.trim("target"))).join(t, "_t").drop("_t")
    own = ended.filter((F.col("source_kind") == "Entity") & (F.col("relation") != "INTRODUCES")).withColumn("_s", F.lower(F.trim("source"))).join(s, "_s").drop("_s")
    papers = ended.filter((F.col("source_kind") == "Paper") & (F.col("relation") == "INTRODUCES"))
    order = ["seq"] if "seq" in relations.columns else [F.lower("source"), "relation", F.lower("target")]

    def last(rows: DataFrame, keys: list[str]) -> DataFrame:
        return latest(rows, keys, [*order, *[c for c in rows.columns if c not in keys]])

    return last(own, ["source_key", "relation", "target_key"]), last(papers, ["source", "target_key"])
