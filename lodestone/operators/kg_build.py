"""Building a knowledge graph from extracted mentions: validation, resolution, merging, pruning.

Merges that depend on order carry ``seq``, the place of a mention in the order of records, and are grouped minima or
maxima over it, never first() or the order of a collected list.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone import schemas
from lodestone.functions import text as X


def parsed(rows: DataFrame, json: str, schema: str) -> DataFrame:
    """``json`` without its fence, as ``schema``; a field of another shape is null, its siblings stay."""
    return rows.withColumn("record", F.from_json(X.unfenced(F.col(json)), schema))


def valid_profile(focal: Column) -> Column:
    """Focal entities with a name and a focal type; their aliases normalised, and none like the name."""
    clean = F.transform(
        F.coalesce(focal, F.array().cast(schemas.FOCAL)),
        lambda f: F.struct(
            X.collapse(f["name"]).alias("name"), f["type"].alias("type"),
            F.filter(F.transform(F.coalesce(f["aliases"], F.array().cast("array<string>")), lambda a: X.collapse(a)), lambda a: (a != "") & (F.lower(a) != F.lower(X.collapse(f["name"])))).alias("aliases"),
        ),
    )
    return F.filter(clean, lambda f: (f["name"] != "") & F.coalesce(f["type"].isin(schemas.FOCAL_TYPES), F.lit(False)))


def clean_evidence(evidence: Column) -> Column:
    """Distinct evidence; items without chunk and page go."""
    return F.array_distinct(F.filter(F.coalesce(evidence, F.array().cast(schemas.EVIDENCE)), lambda e: e["chunk_id"].isNotNull() | e["page"].isNotNull()))


def evidence_lists(evidence: Column) -> list[Column]:
    """Distinct chunks, distinct pages, each by itself, and how many chunks."""
    chunks = F.array_distinct(F.filter(F.transform(evidence, lambda e: e["chunk_id"]), lambda c: c.isNotNull()))
    pages = F.array_distinct(F.filter(F.transform(evidence, lambda e: e["page"]), lambda p: p.isNotNull()))
    return [chunks.alias("evidence_chunk_ids"), pages.alias("evidence_pages"), F.size(chunks).cast("long").alias("evidence_count")]


def type_votes(mentions: DataFrame, overrides: dict[str, str] | None = None) -> DataFrame:
    """``mentions``: key, name, type, seq. The type of each key: an override by name, else the most votes, ties to the
    type seen first, else Concept."""
    votes = mentions.filter(F.col("type").isin(schemas.ENTITY_TYPES)).groupBy("key", "type").agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("at"))
    won = votes.groupBy("key").agg(F.max_by("type", F.struct(F.col("n"), -F.col("at"))).alias("voted"))
    names = mentions.groupBy("key").agg(F.min_by("name", "seq").alias("name"))
    table = F.create_map(*[F.lit(x) for pair in (overrides or schemas.TYPE_OVERRIDES).items() for x in pair])
    return names.join(won, "key", "left").select("key", "name", F.coalesce(F.element_at(table, F.col("name")), "voted", F.lit("Concept")).alias("type"))


def first_entities(mentions: DataFrame) -> DataFrame:
    """``mentions``: key, name, type, seq. The older rule: of each name and type the first mention stays, whole."""
    return mentions.groupBy("key", "type").agg(F.min_by(F.struct(*[c for c in mentions.columns if c not in ("key", "type")]), "seq").alias("m")).select("key", "type", "m.*")


def entity_pool(mentions: DataFrame) -> DataFrame:
    """``mentions``: key, name, aliases, evidence, source_file, seq. One row a key: the first spelling, and the sets of
    aliases (by lower case, none like the name), evidence and source files.

    Sets are collected after exploding, so equal items combine before the shuffle.
    """
    names = mentions.groupBy("key").agg(F.min_by("name", "seq").alias("name"), F.sort_array(F.collect_set("source_file")).alias("source_files"))
    alias = mentions.select("key", "seq", F.explode("aliases").alias("alias")).withColumn("alias", X.collapse(F.col("alias"))).filter("alias <> '' and lower(alias) <> key")
    alias = alias.groupBy("key", F.lower("alias").alias("_l")).agg(F.min_by("alias", "seq").alias("alias"))
    aliases = alias.groupBy("key").agg(F.transform(F.sort_array(F.collect_list(F.struct("_l", "alias"))), lambda a: a["alias"]).alias("aliases"))
    proof = mentions.select("key", F.explode(clean_evidence(F.col("evidence"))).alias("e")).groupBy("key").agg(F.sort_array(F.collect_set("e")).alias("evidence"))
    out = names.join(aliases, "key", "left").join(proof, "key", "left")
    return out.select("key", "name", F.coalesce("aliases", F.array().cast("array<string>")).alias("aliases"), F.coalesce("evidence", F.array().cast(schemas.EVIDENCE)).alias("evidence"), "source_files")


def alias_table(pool: DataFrame, canonical: dict[str, str] | None = None) -> DataFrame:
    """``pool``: key, aliases, seq. alias -> key, the last writer winning: the pool in order, each name before its
    aliases, the fixed names last."""
    spelled = pool.select(F.lit(0).alias("phase"), F.col("seq").alias("a"), F.posexplode(F.concat(F.array("key"), F.transform("aliases", lambda a: F.lower(a)))).alias("b", "alias"), "key")
    names = canonical or schemas.CANONICAL_NAMES
    fixed = pool.sparkSession.createDataFrame([(1, i, 0, k, v.lower()) for i, (k, v) in enumerate(names.items())], "phase int, a long, b int, alias string, key string")
    every = spelled.select("phase", F.col("a").cast("long").alias("a"), "b", "alias", "key").unionByName(fixed)
    return every.groupBy("alias").agg(F.max_by("key", F.struct("phase", "a", "b")).alias("key"))


def resolved(rows: DataFrame, name: str, aliases: DataFrame, pool: DataFrame, out: str) -> DataFrame:
    """Adds ``out``, the key in the pool that a name stands for (one step through the aliases), or null."""
    looked = rows.join(aliases.select(F.col("alias").alias("_a"), F.col("key").alias("_k")), F.lower(F.trim(name)) == F.col("_a"), "left")
    looked = looked.withColumn("_r", F.coalesce("_k", F.lower(F.trim(name)))).drop("_a", "_k")
    return looked.join(pool.select(F.col("key").alias(out)), F.col("_r") == F.col(out), "left").drop("_r")


def drop_reason() -> Column:
    """Why a relation goes, by the first rule it breaks; null where it stays.

    Columns: source, relation, target, target_key, target_type, source_kind ('Paper' or 'Entity'), source_key.
    """
    allowed = F.create_map(*[x for r, kinds in schemas.TARGET_TYPES.items() for x in (F.lit(r), F.array(*map(F.lit, kinds)))])
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""

    def rule(r: Column) -> Column:
        kinds = F.element_at(allowed, r["relation"])
        return (
            F.when(blank(r["source"]) | (F.coalesce(r["relation"], F.lit("")) == "") | blank(r["target"]), "missing_fields")
            .when(r["target_key"].isNull(), "target_unresolved")
            .when(X.is_noise(r["target"]), "citation_like")
            .when((r["relation"] == "EVALUATES_ON") & r["low"].isin(schemas.GENERIC_DATASETS), "generic_dataset")
            .when((r["relation"] == "COMPARED_WITH") & r["low"].isin(schemas.GENERIC_COMPARISONS), "generic_comparison")
            .when((r["relation"] == "USES") & r["low"].isin(schemas.IMPLEMENTATION_TOOLS), "implementation_tool")
            .when(kinds.isNotNull() & ~F.array_contains(kinds, r["target_type"]), F.concat(F.lit("type_mismatch_"), r["relation"]))
            .when((r["source_kind"] == "Paper") & (r["relation"] != "INTRODUCES"), "paper_source")
            .when((r["source_kind"] != "Paper") & r["source_key"].isNull(), "source_unresolved")
        )

    # The rules stand in a function of the row: as plain columns each would repeat how its columns are computed, in a method
    # that is too long to be compiled.
    return F.transform(F.array(F.struct("source", "relation", "target", "target_key", "target_type", "source_kind", "source_key", F.lower(F.trim("target")).alias("low"))), rule)[0]


def kept_relations(relations: DataFrame) -> DataFrame:
    """Relations that no rule drops; columns as for ``drop_reason``. Rules that read no texts go first, so fewer meet the others."""
    paper = F.col("source_kind") == "Paper"
    plain = [F.col("target_key").isNull(), paper & (F.col("relation") != "INTRODUCES"), ~paper & F.col("source_key").isNull()]
    for broken in plain:
        relations = relations.filter(~F.coalesce(broken, F.lit(False)))
    return relations.filter(drop_reason().isNull())


def dropped_counts(relations: DataFrame) -> DataFrame:
    """reason, n of the relations that rules drop; columns as for ``drop_reason``. Of a source the rules read whether it is blank, of
    keys whether they are there, so relations that are alike in these and the other columns are counted first and judged once."""
    there = lambda c: F.when(F.col(c).isNotNull(), "+").alias(c)
    like = relations.groupBy(F.when(F.trim("source") != "", "+").alias("source"), "relation", "target", "target_type", "source_kind", there("source_key"), there("target_key")).agg(F.count(F.lit(1)).alias("_n"))
    # A filter on the reason itself, here or by who reads this, would go before the count and be computed for each relation.
    judged = like.select(drop_reason().alias("_r"), "_n").groupBy("_r").agg(F.max("_r").alias("reason"), F.sum("_n").alias("n"))
    return judged.select("reason", "n").filter("reason is not null")


def relation_pool(relations: DataFrame) -> DataFrame:
    """``relations``: source_kind, source, relation, target, target_type, evidence, source_file, seq. One row for each
    kind, source, relation and target in lower case, with the first spelling and the sets of evidence and files."""
    keyed = relations.withColumn("source_key", F.lower("source")).withColumn("target_key", F.lower("target"))
    keys = ["source_kind", "source_key", "relation", "target_key"]
    rows = keyed.select(*keys, "source", "target", "target_type", "seq", "source_file", F.explode_outer(clean_evidence(F.col("evidence"))).alias("e"))
    merged = rows.groupBy(*keys).agg(F.min_by(F.struct("source", "target", "target_type"), "seq").alias("f"), F.sort_array(F.collect_set("source_file")).alias("source_files"), F.sort_array(F.collect_set("e")).alias("evidence"))
    return merged.select(*keys, "f.*", "evidence", "source_files")


def without_orphans(entities: DataFrame, used: DataFrame) -> DataFrame:
    """Entities whose key something uses; ``used``: key."""
    return entities.join(used.select("key").distinct(), "key", "left_semi")
