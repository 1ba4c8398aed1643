"""Curation of knowledge: exclusions, edits, moves, cleaning, resolution at write time, assembly.

Facts are rows (namespace, record_id, ordinal, name, type, aliases, text, source): one fact of one mention of an entity, ``text`` null for
an entity without facts; columns that a function doesn't name may be missing or more. Relations are rows (src, dst, label, ordinal), with a namespace
where they have one. Exclusions are two tables, (namespace, obs_key) and (namespace, session_id).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import graph as G
from corpusloom.operators.embedding import nearest
from corpusloom.operators.retrieval import similar_sets

Materialize = Callable[[DataFrame], DataFrame]


def _names(names: DataFrame) -> DataFrame:
    return names.select(T.norm_key(F.col("name")).alias("k")).distinct()


def _touching(relations: DataFrame, gone: DataFrame, on: list[str]) -> Callable[[str], DataFrame]:
    """Relations with an end among ``gone`` (k and the columns ``on``), or without any, by the kind of join."""

    def joined(how: str) -> DataFrame:
        ends = [relations.withColumn("k", T.norm_key(F.col(end))) for end in ("src", "dst")]
        if how == "left_semi":
            return ends[0].join(gone, ["k", *on], how).drop("k").unionByName(ends[1].join(gone, ["k", *on], how).drop("k")).distinct()
        first = ends[0].join(gone, ["k", *on], how).withColumn("k", T.norm_key(F.col("dst")))
        return first.join(gone, ["k", *on], how).drop("k")

    return joined


# Exclusions ------------------------------------------------------------------------------


@dataclass(frozen=True)
class Exclusions:
    """What users have taken out of the graphs: single facts and whole sessions."""

    facts: DataFrame  #: (namespace, obs_key)
    sessions: DataFrame  #: (namespace, session_id)

    def is_empty(self) -> bool:
        return self.facts.isEmpty() and self.sessions.isEmpty()


def keys_of(facts: DataFrame) -> DataFrame:
    """(namespace, obs_key) of facts (namespace, name, text)."""
    return facts.select("namespace", T.obs_key(F.col("name"), F.col("text")).alias("obs_key")).distinct()


def exclude(known: Exclusions, facts: DataFrame | None = None, sessions: DataFrame | None = None) -> Exclusions:
    """``known`` and these facts (namespace, name, text) and sessions (namespace, session_id)."""
    more_facts = known.facts if facts is None else known.facts.select("namespace", "obs_key").union(keys_of(facts)).distinct()
    more_sessions = known.sessions if sessions is None else known.sessions.select("namespace", "session_id").union(sessions.select("namespace", "session_id")).distinct()
    return Exclusions(more_facts, more_sessions)


def unexclude(known: Exclusions, facts: DataFrame | None = None, sessions: DataFrame | None = None) -> Exclusions:
    """``known`` without these facts and sessions; what isn't excluded may be named as well."""
    fewer_facts = known.facts if facts is None else known.facts.join(keys_of(facts), ["namespace", "obs_key"], "left_anti")
    fewer_sessions = known.sessions if sessions is None else known.sessions.join(sessions.select("namespace", "session_id"), ["namespace", "session_id"], "left_anti")
    return Exclusions(fewer_facts, fewer_sessions)


def excluded_flags(facts: DataFrame, known: Exclusions) -> DataFrame:
    """``facts`` with fact_excluded and session_excluded."""
    by_fact = known.facts.select("namespace", "obs_key").distinct().withColumn("fact_excluded", F.lit(True))
    by_session = known.sessions.select("namespace", F.col("session_id").alias("source")).distinct().withColumn("session_excluded", F.lit(True))
    out = facts.withColumn("obs_key", T.obs_key(F.col("name"), F.col("text"))).join(by_fact, ["namespace", "obs_key"], "left").join(by_session, ["namespace", "source"], "left")
    return out.drop("obs_key").withColumns({c: F.coalesce(c, F.lit(False)) for c in ("fact_excluded", "session_excluded")})


def filter_excluded(facts: DataFrame, relations: DataFrame, known: Exclusions) -> tuple[DataFrame, DataFrame]:
    """Facts that aren't excluded, and relations without those that touch an entity left without facts.

    With any exclusion, every entity without facts goes, with its relations; with none, nothing changes.
    """
    if known.is_empty():
        return facts, relations
    kept = G.anti_excluded(facts.where("text is not null"), known.facts, known.sessions)
    on = [c for c in ("namespace",) if c in relations.columns]
    named = lambda df: df.select(*on, T.norm_key(F.col("name")).alias("k")).distinct()
    emptied = named(facts).join(named(kept), [*on, "k"], "left_anti")
    return kept, _touching(relations, emptied, on)("left_anti")


# Edits -----------------------------------------------------------------------------------


def edit_observation(facts: DataFrame, edits: DataFrame, known: Exclusions) -> tuple[DataFrame, Exclusions]:
    """``facts`` with the edits (namespace, record_id, name, old, new): the first fact of each mention of that name that has just the old text.

    Blank new texts change nothing. Where the old fact was excluded, the new one is in its place.
    """
    edits = edits.select("namespace", "record_id", T.norm_key(F.col("name")).alias("k"), "old", T.trim(F.col("new")).alias("new")).where("new <> ''").dropDuplicates(["namespace", "record_id", "k", "old"])
    hit = facts.withColumn("k", T.norm_key(F.col("name"))).withColumn("old", F.col("text"))
    first = F.row_number().over(Window.partitionBy("namespace", "record_id", "k", "ordinal", "old").orderBy("source"))
    changed = hit.withColumn("nth", first).join(edits, ["namespace", "record_id", "k", "old"], "left")
    changed = changed.withColumn("text", F.when((F.col("nth") == 1) & F.col("new").isNotNull(), F.col("new")).otherwise(F.col("text"))).drop("k", "old", "new", "nth")
    moved = edits.join(hit.select("namespace", "record_id", "k", "old").distinct(), ["namespace", "record_id", "k", "old"], "left_semi")
    moved = moved.select("namespace", T.obs_key(F.col("k"), F.col("old")).alias("obs_key"), T.obs_key(F.col("k"), F.col("new")).alias("new_key")).distinct()
    stays = known.facts.join(moved, ["namespace", "obs_key"], "left").select("namespace", F.coalesce("new_key", "obs_key").alias("obs_key")).distinct()
    return changed.select(*facts.columns), Exclusions(stays, known.sessions)


def delete_relation(relations: DataFrame, gone: DataFrame) -> DataFrame:
    """``relations`` without the first one, in their order, of each (src, dst, label) of ``gone``, in any spelling."""
    on = [c for c in ("namespace",) if c in relations.columns and c in gone.columns]
    key = {f"{c}_key": T.norm_key(F.col(c)) for c in ("src", "dst", "label")}
    names = gone.select(*on, *[v.alias(k) for k, v in key.items()]).distinct().withColumn("gone", F.lit(True))
    keyed = relations.withColumns(key)
    nth = F.row_number().over(Window.partitionBy(*on, *key).orderBy("ordinal", "src", "dst", "label"))
    return keyed.withColumn("nth", nth).join(names, [*on, *key], "left").where("gone is null or nth > 1").select(*relations.columns)


def move_entities(facts: DataFrame, relations: DataFrame, names: DataFrame, source: str, target: str) -> tuple[DataFrame, DataFrame]:
    """Entities of ``source`` with one of these names (or as an alias) under ``target``, and with them the relations that touch the name itself."""
    wanted = _names(names)
    own = facts["namespace"] == source
    keys = F.transform(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>"))), T.norm_key) if "aliases" in facts.columns else F.array(T.norm_key(F.col("name")))
    hit = facts.where(own).select("name", F.explode(keys).alias("k")).join(wanted, "k", "left_semi").select("name").distinct().withColumn("moves", F.lit(True))
    facts = facts.join(hit, "name", "left").withColumn("namespace", F.when(F.col("moves") & (F.col("namespace") == source), target).otherwise(F.col("namespace"))).select(*facts.columns)
    columns = relations.columns
    for end in ("src", "dst"):
        relations = relations.withColumn("k", T.norm_key(F.col(end))).join(wanted.withColumn(f"moves_{end}", F.lit(True)), "k", "left").drop("k")
    moves = F.coalesce("moves_src", "moves_dst", F.lit(False)) & (F.col("namespace") == source)
    return facts, relations.withColumn("namespace", F.when(moves, target).otherwise(F.col("namespace"))).select(*columns)


def migrate_namespaces(rows: DataFrame, renamed: DataFrame) -> DataFrame:
    """``rows`` under new namespaces: ``renamed`` has (namespace, target); several may have one target."""
    to = renamed.select("namespace", "target").dropDuplicates(["namespace"])
    return rows.join(to, "namespace", "left").withColumn("namespace", F.coalesce("target", "namespace")).select(*rows.columns)


def clean_snapshots(facts: DataFrame, relations: DataFrame, is_snapshot: Callable[[Column], Column] = T.is_snapshot_obs_batch) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Facts without passing states, relations without those that touch an entity of the same record which is left without facts, and a report.

    Entities that had no facts stay. The report has one row: entities_deleted, entities_trimmed, facts_removed.
    """
    scope = [c for c in ("namespace", "record_id") if c in facts.columns]
    on = [c for c in scope if c in relations.columns]
    marked = facts.withColumn("passing", F.coalesce(is_snapshot(F.col("text")), F.lit(False)))
    entities = marked.groupBy(*scope, T.norm_key(F.col("name")).alias("k")).agg(F.count_if("passing").alias("removed"), F.count_if(~F.col("passing")).alias("left"))
    deleted = F.col("left") == 0
    report = entities.agg(
        F.count_if(deleted).alias("entities_deleted"), F.count_if(~deleted & (F.col("removed") > 0)).alias("entities_trimmed"), F.coalesce(F.sum("removed"), F.lit(0)).alias("facts_removed")
    )
    kept = _touching(relations, entities.where(deleted).select(*on, "k").distinct(), on)("left_anti")
    return marked.where(~F.col("passing")).drop("passing"), kept, report


# Assembly --------------------------------------------------------------------------------


def canonical(facts: DataFrame, materialize: Materialize, mode: str = "exact") -> DataFrame:
    """``facts`` under the names that their entities are merged into; the mention's own name is in ``mention``."""
    mentions = facts.select("namespace", "ordinal", "name", "aliases").dropDuplicates(["namespace", "ordinal"])
    merged = G.merge_entities(mentions, materialize, mode).select("namespace", "ordinal", "canonical")
    return facts.join(merged, ["namespace", "ordinal"]).withColumnRenamed("name", "mention").withColumnRenamed("canonical", "name")


def assemble_graph(facts: DataFrame, relations: DataFrame, known: Exclusions, materialize: Materialize, term: str | None = None, mode: str = "exact") -> tuple[DataFrame, DataFrame]:
    """Entities (namespace, name, ordinal, type, aliases, observations) and relations of merged, filtered and, with a ``term``, focused graphs."""
    named = materialize(canonical(facts, materialize, mode))
    kept, relations = filter_excluded(named, G.distinct_relations(relations), known)
    keys = ["namespace", "name"]
    base = kept.groupBy(*keys).agg(F.min("ordinal").alias("ordinal"), F.min_by("type", F.when(F.coalesce("type", F.lit("")) != "", F.col("ordinal"))).alias("type"))
    spelled = kept.select(*keys, "ordinal", F.explode(F.concat(F.array("mention"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("alias"))
    aliases = G.merge_aliases(spelled, keys, "name")
    e = base.join(aliases, keys, "left").join(G.union_observations(kept.where("text is not null"), keys), keys, "left")
    if term:
        match = e.withColumn("facts", F.transform(F.coalesce("observations", F.array().cast("array<struct<text:string,source:string>>")), lambda o: o["text"]))
        hit = match.where(G.entity_term_match(F.col("name"), F.coalesce("type", F.lit("")), F.col("facts"), term)).select("namespace", F.lower("name").alias("k"))
        on = ["namespace"] if "namespace" in relations.columns else []
        hit = hit.select(*on, "k").distinct()
        near = [relations.select(*on, F.lower(a).alias("k"), F.lower(b).alias("n")).join(hit, [*on, "k"], "left_semi").select(*on, F.col("n").alias("k")) for a, b in (("src", "dst"), ("dst", "src"))]
        nodes = materialize(hit.unionByName(near[0]).unionByName(near[1]).distinct())
        e = e.withColumn("k", F.lower("name")).join(nodes, [*on, "k"], "left_semi").drop("k")
        for end in ("src", "dst"):
            relations = relations.withColumn("k", F.lower(end)).join(nodes, [*on, "k"], "left_semi").drop("k")
    return e, relations


def union_namespaces(facts: DataFrame, relations: DataFrame, namespaces: list[str], excluded: Exclusions, materialize: Materialize, name: str = "", mode: str = "exact") -> tuple[DataFrame, DataFrame]:
    """The graphs of several namespaces merged as one, called ``name`` (default: the names joined by +); each namespace's exclusions hold for its own facts."""
    own, relations = filter_excluded(facts.where(F.col("namespace").isin(namespaces)), relations, excluded)
    if "namespace" in relations.columns:
        relations = relations.where(F.col("namespace").isin(namespaces)).drop("namespace")
    place = F.lit(namespaces)
    # a later namespace's mentions come after an earlier one's
    ordered = own.withColumn("ordinal", F.array_position(place, F.col("namespace")) * F.lit(1 << 40) + F.col("ordinal")).withColumn("namespace", F.lit(name or "+".join(namespaces)))
    return canonical(ordered, materialize, mode), G.distinct_relations(relations)


# Resolution and writing ------------------------------------------------------------------


def resolve_entities(incoming: DataFrame, existing: DataFrame, floor: float = 0.86, same: float = 0.8, within: str | None = None, told: DataFrame | None = None, materialize: Materialize = lambda df: df) -> DataFrame:
    """Incoming entities under the names of existing ones that they match, without facts that those have in other words.

    ``incoming`` has (query_id, name, aliases, embedding, observations), ``existing`` (id, name, embedding, observations), observations being arrays of texts; ``told`` (id, text)
    may hold the facts of existing entities as rows instead. Entities match at a cosine of ``floor``, those with one value of the column ``within`` alone if it is given; a fact goes if its
    token set is as similar as ``same`` to one of the match's facts; entities without facts left go. Different sets of an entity are compared once, by a join.
    """
    own = [within] if within else []
    match = nearest(incoming.select("query_id", "embedding", *own), existing.select("id", "embedding", *own), 1, floor, within=within).select("query_id", "id")
    known = materialize(match.join(existing.select("id", F.col("name").alias("canonical")), "id").select("query_id", F.col("id").alias("of"), "canonical"))
    told = existing.select("id", F.explode("observations").alias("text")) if told is None else told
    key = lambda text: F.sha1(F.array_join(F.array_sort(T.token_set(text)), " "))

    def sets(facts: DataFrame, kind: str, tokens: str) -> DataFrame:
        found = facts.select("of", key(F.col("text")).alias(kind), T.token_set(F.col("text")).alias(tokens)).where(F.size(tokens) > 0)
        return materialize(found.dropDuplicates(["of", kind]))

    facts = materialize(incoming.select("query_id", F.explode("observations").alias("text")).join(known.select("query_id", "of"), "query_id"))
    held = told.join(known.select(F.col("of").alias("id")).distinct(), "id", "left_semi").select(F.col("id").alias("of"), "text")
    near = similar_sets(sets(facts, "own", "tokens"), sets(held, "met", "others"), ["of"], same, materialize).select("of", "own").distinct()
    gone = facts.select("query_id", "of", key(F.col("text")).alias("own")).join(near, ["of", "own"], "left_semi").groupBy("query_id").agg(F.collect_set("own").alias("gone"))
    x = incoming.join(known.drop("of"), "query_id", "left").join(gone, "query_id", "left")
    renamed = F.col("canonical").isNotNull() & (T.norm_key(F.col("canonical")) != T.norm_key(F.col("name")))
    left = F.when(F.col("gone").isNull(), F.col("observations")).otherwise(F.filter("observations", lambda o: ~F.array_contains("gone", key(o))))
    out = x.select("query_id", F.coalesce("canonical", "name").alias("name"), F.when(renamed, F.array_append("aliases", F.col("name"))).otherwise(F.col("aliases")).alias("aliases"), left.alias("observations"), *[c for c in incoming.columns if c not in ("query_id", "name", "aliases", "observations")])
    return out.where(F.size("observations") > 0)
