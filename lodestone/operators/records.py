"""Extraction records, validated batch by batch.

A record holds what a model said of a dozen chunks, so it is bounded, and all rules run inside its row with array
functions: nothing is shuffled, whatever the number of records.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone import schemas
from lodestone.functions import text as X
from lodestone.operators.kg_build import valid_profile

FULL, V2, V3 = "full", "v2", "v3"


def _none(kind: str) -> Column:
    return F.array().cast(f"array<{kind}>")


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _once(rows: DataFrame, **columns: Column) -> DataFrame:
    """Adds columns that are computed once a row, however often they are used: they go through a generator, which the
    optimizer does not see through, so that they are not put into the lambdas that use them."""
    held = F.explode(F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))).alias("_held")
    return rows.select("*", held).select(*rows.columns, *[F.col(f"_held.{name}") for name in columns])


def _at(keys: Column, values: Column, key: Column) -> Column:
    """The value beside the first key that is ``key``; null if there is none."""
    return F.get(values, (F.array_position(keys, key) - 1).cast("int"))


def _first_of(items: Column, key: Callable[[Column], Column]) -> Column:
    """Items whose key no earlier item has."""
    return _let(F.transform(items, key), lambda keys: F.filter(items, lambda x, i: F.array_position(keys, key(x)) == i + 1))


def _joined(*parts: Column) -> Column:
    return F.concat_ws("\x1f", *parts)


def _entity(name: Column, kind: Column, aliases: Column, evidence: Column) -> Column:
    return F.struct(name.alias("name"), kind.alias("type"), aliases.alias("aliases"), evidence.cast(schemas.EVIDENCE).alias("evidence"))


def _spelled(e: Column, at: Column) -> Column:
    """An entity's name and aliases, as they are looked up."""
    return F.concat(F.array(F.struct(F.lower(e["name"]).alias("k"), at.alias("at"))), _aliases(e, at))


def _spellings(e: Column) -> Column:
    return F.concat(F.array(F.lower(e["name"])), F.transform(e["aliases"], F.lower))


def _aliases(e: Column, at: Column) -> Column:
    return F.transform(e["aliases"], lambda a: F.struct(F.lower(a).alias("k"), at.alias("at")))


def clean_entities(raw: Column, canonical: Callable[[Column], Column] = lambda name: name) -> Column:
    """Entities with a name and a known type, in order; ``canonical`` may give a name another spelling. Their aliases are
    normalised, and none is like the name."""
    named = F.transform(F.coalesce(raw, _none(schemas.ENTITY)), lambda e: F.struct(X.collapse(e["name"]).alias("name"), e["type"].alias("type"), F.coalesce(e["aliases"], _none("string")).alias("aliases"), F.coalesce(e["evidence"], F.array().cast(schemas.EVIDENCE)).alias("evidence")))
    good = F.filter(named, lambda e: (e["name"] != "") & F.coalesce(e["type"].isin(schemas.ENTITY_TYPES), F.lit(False)))
    spelled = F.transform(good, lambda e: _entity(canonical(e["name"]), e["type"], e["aliases"], e["evidence"]))
    own = lambda e: F.filter(F.transform(e["aliases"], lambda a: X.collapse(a)), lambda a: (a != "") & (F.lower(a) != F.lower(e["name"])))
    return F.transform(spelled, lambda e: _entity(e["name"], e["type"], own(e), e["evidence"]))


def _more(old: Column, new: Column) -> Column:
    """Aliases, and those of ``new`` that are not among them, whatever their case."""
    return F.aggregate(new, old, lambda held, a: F.when(F.exists(held, lambda h: F.lower(h) == F.lower(a)), held).otherwise(F.concat(held, F.array(a))))


def claimed(entities: Column, focal: Column) -> Column:
    """Entities merged in order: ``ents``, and ``keys`` and ``at``, names and aliases and the places of what they stand for,
    the last that was written first.

    Focal entities come first. An entity whose name stands for an earlier one, as its name or by an alias, adds its aliases
    and evidence to that; any other is new, and its name and aliases stand for it from then on. Aliases that are added to an
    earlier entity are not looked up.
    """
    first = F.transform(focal, lambda f: _entity(f["name"], f["type"], f["aliases"], F.array()))
    zero = F.struct(
        first.alias("ents"), F.reverse(F.flatten(F.transform(first, _spellings))).alias("keys"),
        F.reverse(F.flatten(F.transform(first, lambda e, i: F.array_repeat(i, F.size(e["aliases"]) + 1)))).alias("at"),
    )

    def step(s: Column, e: Column) -> Column:
        def merged(at: Column) -> Column:
            known = at.isNotNull()
            grown = F.transform(s["ents"], lambda x, i: F.when(i == at, _entity(x["name"], x["type"], _more(x["aliases"], e["aliases"]), F.concat(x["evidence"], e["evidence"]))).otherwise(x))
            return F.struct(
                F.when(known, grown).otherwise(F.concat(s["ents"], F.array(e))).alias("ents"),
                F.when(known, s["keys"]).otherwise(F.concat(F.reverse(_spellings(e)), s["keys"])).alias("keys"),
                F.when(known, s["at"]).otherwise(F.concat(F.array_repeat(F.size(s["ents"]), F.size(e["aliases"]) + 1), s["at"])).alias("at"),
            )

        return _let(_at(s["keys"], s["at"], F.lower(e["name"])), merged)

    return F.aggregate(entities, zero, step)


def _allowed(relation: Column, kind: Column) -> Column:
    table = F.create_map(*[x for t, kinds in schemas.TARGET_TYPES.items() for x in (F.lit(t), F.array(*map(F.lit, kinds)))])
    return F.coalesce(F.array_contains(F.try_element_at(table, relation), kind), F.lit(False))


def _judged(raw: DataFrame, policy: str, strict_evidence: bool, entities: bool = True) -> DataFrame:
    """Adds focal, and the entities and relations that stay; relations with source_type and target_type."""
    r = _once(raw, focal=valid_profile(F.col("focal_entities")))
    names = F.flatten(F.transform("focal", lambda f: F.transform(F.concat(F.array(f["name"]), f["aliases"]), lambda a: F.struct(F.lower(a).alias("k"), f["name"].alias("name"), f["type"].alias("type")))))
    r = _once(r, _names=F.reverse(names))
    r = _once(r, _focal=_first_of(F.col("_names"), lambda f: f["k"]))  # the last that claims a spelling
    r = _once(r, _focal_keys=F.transform("_focal", lambda f: f["k"]))
    of_focal = lambda name: _at(F.col("_focal_keys"), F.col("_focal"), F.lower(name))
    introduces, based = (lambda x: x["relation"] == "INTRODUCES"), (lambda x: x["relation"] == "BASED_ON")

    # Relations whose source can't be theirs go before anything is looked up.
    types = [*schemas.RELATION_TYPES, *([] if policy == FULL else ["BASED_ON"])]
    stated = F.transform(F.coalesce("relations", _none(schemas.RELATION)), lambda x: F.struct(X.collapse(x["source"]).alias("source"), x["type"].alias("relation"), x["target"].alias("target"), x["evidence"].alias("evidence")))
    paper = lambda x: x["source"] == "PAPER"
    other = (lambda x: F.array_contains("_focal_keys", F.lower(x["source"]))) if policy == FULL else (lambda x: ~paper(x))
    stated = F.filter(stated, lambda x: (x["source"] != "") & F.coalesce(x["relation"].isin(types), F.lit(False)) & F.when(introduces(x), paper(x)).otherwise(F.coalesce(other(x), F.lit(False))))
    ready = F.transform(stated, lambda x: F.struct(x["source"].alias("source"), x["relation"].alias("relation"), X.collapse(x["target"]).alias("target"), F.coalesce(x["evidence"], F.array().cast(schemas.EVIDENCE)).alias("evidence")))
    r = _once(r, _stated=F.filter(ready, lambda x: x["target"] != ""))

    if policy == FULL:
        # A batch without relations keeps no entities, so there they aren't merged.
        some = F.size("_stated") > 0
        r = _once(r, _clean=F.when(some, clean_entities(F.col("entities"), lambda name: F.coalesce(of_focal(name)["name"], name))))
        r = _once(r, _state=F.when(some, claimed(F.col("_clean"), F.col("focal"))))
        r = r.withColumns({"_ents": F.col("_state.ents"), "_keys": F.col("_state.keys"), "_places": F.col("_state.at")}).drop("_state", "_clean")
    else:
        clean = clean_entities(F.col("entities"))
        if policy == V3:
            clean = F.transform(clean, lambda e: _entity(e["name"], e["type"], _first_of(e["aliases"], F.lower), e["evidence"]))
        r = _once(_once(r, _clean=clean), _ents=_first_of(F.col("_clean"), lambda e: _joined(F.lower(e["name"]), e["type"])))
        inside = F.flatten(F.transform("_ents", lambda e, i: _spelled(e, i)))
        after = F.concat(F.transform("_ents", lambda e, i: F.struct(F.lower(e["name"]).alias("k"), i.alias("at"))), F.flatten(F.transform("_ents", lambda e, i: _aliases(e, i))))
        r = _once(r, _look=F.reverse(inside if policy == V3 else after))
        r = _once(r, _keys=F.col("_look.k"), _places=F.col("_look.at"))

    place = lambda name: F.get("_ents", _at(F.col("_keys"), F.col("_places"), F.lower(name)))
    source = (lambda x: of_focal(x["source"])) if policy == FULL else (lambda x: place(x["source"]))
    r = _once(r, _ended=F.transform("_stated", lambda x: F.struct(x["relation"].alias("relation"), x["evidence"].alias("evidence"), paper(x).alias("paper"), source(x).alias("s"), place(x["target"]).alias("t"))))
    is_focal = lambda e: F.coalesce(F.arrays_overlap(F.transform(F.concat(F.array(e["name"]), e["aliases"]), F.lower), "_focal_keys"), F.lit(False))
    method = lambda e: F.coalesce(e["type"].isin(schemas.FOCAL_TYPES), F.lit(False))
    rules = {
        FULL: lambda x: F.when(introduces(x), x["paper"] & F.exists("_focal", lambda f: f["name"] == x["t"]["name"])).otherwise(x["s"].isNotNull() & _allowed(x["relation"], x["t"]["type"])),
        V3: lambda x: F.when(introduces(x), x["paper"] & method(x["t"]) & is_focal(x["t"])).when(x["paper"] | x["s"].isNull(), False).when(based(x), (x["s"]["type"] == "Concept") & (x["t"]["type"] == "Concept")).otherwise(method(x["s"]) & is_focal(x["s"])),
        V2: lambda x: F.when(introduces(x), x["paper"] & method(x["t"])).when(x["paper"] | x["s"].isNull(), False).when(based(x), True).otherwise(method(x["s"])),
    }
    good = F.filter("_ended", lambda x: x["t"].isNotNull() & F.coalesce(rules[policy](x), F.lit(False)))
    mine = lambda evidence: F.filter(evidence, lambda e: F.coalesce(F.array_contains("chunk_ids", e["chunk_id"]), F.lit(False))) if strict_evidence else evidence
    shown = F.transform(good, lambda x: F.struct(F.when(introduces(x), F.lit("PAPER")).otherwise(x["s"]["name"]).alias("source"), x["relation"].alias("relation"), x["t"]["name"].alias("target"), F.when(~introduces(x), x["s"]["type"]).alias("source_type"), x["t"]["type"].alias("target_type"), mine(x["evidence"]).alias("evidence")))
    r = _once(_once(r, _shown=shown), _kept=_first_of(F.col("_shown"), lambda x: _joined(F.lower(x["source"]), x["relation"], F.lower(x["target"]))))
    if not entities:
        return r

    ends = F.concat(F.transform(F.filter("_kept", lambda x: x["source"] != "PAPER"), lambda x: F.lower(x["source"])), F.transform("_kept", lambda x: F.lower(x["target"])))
    own = F.transform("_focal", lambda f: F.lower(f["name"])) if policy == FULL else F.transform(F.filter("_ents", is_focal), lambda x: F.lower(x["name"]))
    r = _once(r, _used=F.concat(ends, own))
    held = F.transform("_ents", lambda e: _entity(e["name"], e["type"], e["aliases"], mine(e["evidence"])))
    staying = F.filter(held, lambda e: F.array_contains("_used", F.lower(e["name"])))
    # A batch without relations has no entities in full; else focal ones stay.
    return _once(r, _entities={FULL: F.when(F.size("_kept") > 0, staying).otherwise(_none(schemas.ENTITY)), V3: staying, V2: held}[policy])


def records(raw: DataFrame, policy: str = FULL, strict_evidence: bool = False) -> DataFrame:
    """Extraction records (``schemas.RAW``) as they are kept: one row for each, with the entities and relations that stay.

    full: entities are merged in order (see ``claimed``), focal ones first. A relation's target is what its name stands
    for, its source a focal entity by name or alias, with target types as allowed; the paper introduces focal entities
    only. Of equal relations, without case, the first stays. Entities that no relation names go, but for focal ones; a batch
    without relations keeps no entities.
    v3: entities are told by name and type, the first staying whole; a later name or alias wins. Sources are entities of
    type Method or Model that a focal name stands for, or the paper as in full; target types are not looked at; BASED_ON
    joins concepts. v2: sources of type Method or Model, the paper introduces a Method or Model, aliases win over names,
    and no entity goes.

    Relations that name no entity go. With ``strict_evidence``, evidence outside the batch's chunks goes too.
    """
    bare = F.transform("_kept", lambda x: F.struct(x["source"].alias("source"), x["relation"].alias("type"), x["target"].alias("target"), x["evidence"].alias("evidence")))
    return _judged(raw, policy, strict_evidence).select("source_file", "paper_id", "batch_number", "chunk_ids", F.col("focal").alias("focal_entities"), F.col("_entities").alias("entities"), bare.alias("relations"))


def validated(raw: DataFrame, policy: str = FULL, strict_evidence: bool = False) -> DataFrame:
    """The relations of ``records``, one row each: source_file, batch_number, source, relation, target, source_type,
    target_type, evidence."""
    each = _judged(raw, policy, strict_evidence, False).select("source_file", "batch_number", F.explode("_kept").alias("x"))
    return each.select("source_file", "batch_number", "x.source", "x.relation", "x.target", "x.source_type", "x.target_type", "x.evidence")


def kept_entities(raw: DataFrame, policy: str = FULL, strict_evidence: bool = False) -> DataFrame:
    """The entities of ``records``, one row each with its place: source_file, batch_number, place, name, type, aliases,
    evidence."""
    each = _judged(raw, policy, strict_evidence).select("source_file", "batch_number", F.posexplode("_entities").alias("place", "x"))
    return each.select("source_file", "batch_number", "place", "x.name", "x.type", "x.aliases", "x.evidence")
