"""Knowledge graphs as two tables: entities (or mentions) and relations (src, dst, label, ordinal)."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import text as T


def explode_keys(entities: DataFrame, id_col: str = "name") -> DataFrame:
    """(key, name) for the name and every alias of each entity, normalised."""
    keys = F.array_distinct(F.transform(F.concat(F.array(F.col("name")), F.coalesce(F.col("aliases"), F.array().cast("array<string>"))), T.norm_key))
    return entities.select(F.explode(F.filter(keys, lambda k: k != "")).alias("key"), *{id_col, "name", "ordinal"})


def resolve_alias(mentions: DataFrame, entities: DataFrame) -> DataFrame:
    """Each mention's first entity, in graph order, that has its name as name or alias."""
    keys = explode_keys(entities).select("key", F.col("name").alias("entity"), F.col("ordinal").alias("at"))
    first = keys.groupBy("key").agg(F.min_by("entity", "at").alias("entity"))
    return mentions.withColumn("key", T.norm_key(F.col("mention"))).join(first, "key", "left").drop("key")


def relations_of(names: DataFrame, relations: DataFrame) -> DataFrame:
    """Relations with any of the names at either end: two equi-joins, not one on OR."""
    n = names.select(F.lower("name").alias("k")).distinct()
    return relations.withColumn("k", F.lower("src")).join(n, "k", "left_semi").union(relations.withColumn("k", F.lower("dst")).join(n, "k", "left_semi")).drop("k").distinct()


def entity_degree(relations: DataFrame) -> DataFrame:
    """How many relation ends touch each normalised name; a loop counts twice."""
    ends = relations.select(F.explode(F.array(T.norm_key(F.col("src")), T.norm_key(F.col("dst")))).alias("name"))
    return ends.groupBy("name").agg(F.count("*").alias("degree"))


def namespace_counts(entities: DataFrame, namespaces: DataFrame | None = None) -> DataFrame:
    """(namespace, entities): how many entities each namespace has; with ``namespaces`` also those that have none."""
    n = entities.select("namespace", T.norm_key(F.col("name")).alias("key")).distinct().groupBy("namespace").agg(F.count("*").alias("entities"))
    return n if namespaces is None else namespaces.select("namespace").distinct().join(n, "namespace", "left").withColumn("entities", F.coalesce("entities", F.lit(0)))


def distinct_sources(facts: DataFrame, keys: list[str]) -> DataFrame:
    """(.., source, ordinal): each source once, where it stands first; sorted by ordinal this is the order of first sight."""
    return facts.where(F.coalesce(F.col("source"), F.lit("")) != "").groupBy(*keys, "source").agg(F.min("ordinal").alias("ordinal"))


def get_entity(names: DataFrame, entities: DataFrame, relations: DataFrame) -> DataFrame:
    """Entities (namespace, name, ordinal, type, aliases, observations) that ``names`` (mention) mean by name or alias, with their relations as ``edges``.

    Edges are those of the namespace if relations have one. Of several entities with a key, the first of each namespace is meant.
    """
    keys = explode_keys(entities.select("namespace", "name", "aliases", "ordinal"), "namespace")
    first = keys.groupBy("namespace", "key").agg(F.min_by("name", "ordinal").alias("name"))
    found = names.select(T.norm_key(F.col("mention")).alias("key"), "mention").distinct().join(first, "key").drop("key")
    on = [c for c in ("namespace",) if c in relations.columns]
    edge = F.struct("ordinal", "src", "dst", "label")
    ends = relations.select(*on, F.explode(F.array_distinct(F.array(F.lower("src"), F.lower("dst")))).alias("k"), edge.alias("edge"))
    wanted = found.select(*on, F.lower("name").alias("k")).distinct()
    edges = ends.join(wanted, [*on, "k"], "left_semi").groupBy(*on, "k").agg(F.array_sort(F.collect_list("edge")).alias("edges"))
    out = found.join(entities, ["namespace", "name"]).withColumn("k", F.lower("name")).join(edges, [*on, "k"], "left").drop("k")
    return out.withColumn("edges", F.coalesce("edges", F.array().cast(edges.schema["edges"].dataType)))


def graph_material(entities: DataFrame, relations: DataFrame, focus: str = "") -> DataFrame:
    """(namespace, part, ordinal, line): a graph as lines of text, in the order of these columns: an optional focus, entities with their facts, edges.

    Entities have (namespace, ordinal, name, type, observations as texts), relations (namespace, ordinal, src, label, dst). Lines stay rows, as a
    namespace can be of any size; write them sorted, or fold small ones.
    """
    kind = F.when(F.coalesce(F.col("type"), F.lit("")) != "", F.concat(F.lit("("), "type", F.lit(")"))).otherwise("")
    facts = F.when(F.size("observations") > 0, F.concat(F.lit(": "), F.array_join("observations", "; "))).otherwise("")
    lines = entities.select("namespace", F.lit(1).alias("part"), F.col("ordinal").cast("long").alias("ordinal"), F.concat("name", kind, facts).alias("line"))
    edges = relations.select("namespace", F.lit(2).alias("part"), F.col("ordinal").cast("long").alias("ordinal"), F.concat("src", F.lit(" —"), "label", F.lit("→ "), "dst").alias("line"))
    out = lines.unionByName(edges)
    if focus.strip():
        heads = entities.select("namespace").distinct().select("namespace", F.lit(0).alias("part"), F.lit(0).cast("long").alias("ordinal"), F.lit(focus.strip()).alias("line"))
        out = heads.unionByName(out)
    return out


def hub_entity(entities: DataFrame, relations: DataFrame) -> DataFrame:
    """The entity of highest degree of each namespace, the first on ties."""
    e = entities.join(entity_degree(relations).withColumnRenamed("name", "key"), T.norm_key(entities["name"]) == F.col("key"), "left")
    return e.groupBy("namespace").agg(F.max_by("name", F.struct(F.coalesce("degree", F.lit(0)), -F.col("ordinal"))).alias("hub"))


def union_observations(facts: DataFrame, keys: list[str]) -> DataFrame:
    """Facts (.., ordinal, text, source) in order, the first of each normalised text; blanks go."""
    w = Window.partitionBy(*keys, "k").orderBy("ordinal")
    kept = facts.withColumn("k", T.norm_key(F.col("text"))).where("k <> ''").withColumn("rn", F.row_number().over(w)).where("rn = 1")
    rows = F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "text", "source"))), lambda x: F.struct(x["text"].alias("text"), x["source"].alias("source")))
    return kept.groupBy(*keys).agg(rows.alias("observations"))


def merge_aliases(names: DataFrame, keys: list[str], canonical: str) -> DataFrame:
    """Aliases (.., ordinal, alias) in order without repeats and without the canonical name."""
    w = Window.partitionBy(*keys, "k").orderBy("ordinal")
    kept = names.withColumn("k", T.norm_key(F.col("alias"))).where((F.col("k") != "") & (F.col("k") != T.norm_key(F.col(canonical))))
    kept = kept.withColumn("rn", F.row_number().over(w)).where("rn = 1")
    return kept.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "alias"))), lambda x: x["alias"]).alias("aliases"))


def first_type_last_embedding(mentions: DataFrame, keys: list[str]) -> DataFrame:
    """The first type that isn't empty and the last vector that isn't."""
    typed, embedded = F.coalesce(F.col("type"), F.lit("")) != "", F.coalesce(F.size("embedding"), F.lit(0)) > 0
    return mentions.groupBy(*keys).agg(F.min_by("type", F.when(typed, F.col("ordinal"))).alias("type"), F.max_by("embedding", F.when(embedded, F.col("ordinal"))).alias("embedding"))


def distinct_relations(relations: DataFrame) -> DataFrame:
    """One relation for each normalised (src, dst, label), the first spelling; blank ends go."""
    key = [T.norm_key(F.col(c)) for c in ("src", "dst", "label")]
    w = Window.partitionBy(*key).orderBy("ordinal")
    return relations.where((key[0] != "") & (key[1] != "")).withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")


def relations_within(relations: DataFrame, hit: DataFrame) -> DataFrame:
    """Relations with both ends among the names of ``hit``."""
    return relations.join(hit.select(F.col("name").alias("src")), "src", "left_semi").join(hit.select(F.col("name").alias("dst")), "dst", "left_semi")


def expand_hop(hit: DataFrame, relations: DataFrame, hops: int = 1) -> DataFrame:
    """Names reached from ``hit`` along relations, forwards only, in at most ``hops`` steps, the start included."""
    found = hit.select("name").distinct()
    for _ in range(hops):
        more = relations.join(found.withColumnRenamed("name", "src"), "src", "left_semi").select(F.col("dst").alias("name"))
        found = found.union(more).distinct()
    return found


def neighborhood(center: DataFrame, relations: DataFrame, depth: int = 2, most: int = 140) -> DataFrame:
    """(name, hop) around the centre in both directions; beyond ``most`` the nearest and best linked stay."""
    both = relations.select("src", "dst").union(relations.select("dst", "src")).distinct()
    found = center.select("name", F.lit(0).alias("hop"))
    front = found
    for hop in range(1, depth + 1):
        near = both.join(front.select(F.col("name").alias("src")), "src").select(F.col("dst").alias("name")).distinct()
        front = near.join(found, "name", "left_anti").withColumn("hop", F.lit(hop))
        found = found.union(front)
    degree = both.groupBy(F.col("src").alias("name")).agg(F.count("*").alias("degree"))
    ranked = found.join(degree, "name", "left").orderBy("hop", F.desc(F.coalesce("degree", F.lit(0))), "name").limit(most)
    return ranked.select("name", "hop")


def induced_edges(nodes: DataFrame, relations: DataFrame) -> DataFrame:
    """Undirected edges among the nodes with the first label, no loops."""
    inside = relations_within(relations, nodes).where("src <> dst")
    return inside.groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.min_by("label", F.struct("ordinal", "label")).alias("label"))


def focus_graph(entities: DataFrame, relations: DataFrame, term: str) -> tuple[DataFrame, DataFrame]:
    """Entities whose name, type or facts hold the term, their neighbours either way, and the edges among them."""
    match = entities.where(entity_term_match(F.col("name"), F.col("type"), F.col("observations"), term)).select("name").distinct()
    near = relations.join(match.withColumnRenamed("name", "src"), "src", "left_semi").select("dst").union(relations.join(match.withColumnRenamed("name", "dst"), "dst", "left_semi").select("src"))
    nodes = match.union(near).distinct()
    return nodes, relations_within(relations, nodes)


def entity_term_match(name: Column, kind: Column, facts: Column, term: str) -> Column:
    t = F.lit(term.lower())
    return F.contains(F.lower(name), t) | F.contains(F.lower(kind), t) | F.exists(facts, lambda o: F.contains(F.lower(o), t))


def project_overview(entities: DataFrame, relations: DataFrame, most: int = 12) -> DataFrame:
    """Sections of each namespace: decisions, constraints, others by degree and facts; ``most`` rows and how many there are."""
    kind = F.lower(T.trim(F.col("type")))
    section = F.when(kind == "decision", "decision").when(kind == "constraint", "constraint").otherwise("core")
    e = entities.withColumn("section", section).withColumn("key", T.norm_key(F.col("name"))).join(entity_degree(relations).withColumnRenamed("name", "key"), "key", "left")
    core = F.col("section") == "core"
    degree = F.when(core, F.coalesce("degree", F.lit(0))).otherwise(0)
    facts = F.when(core, F.size("observations")).otherwise(0)
    w = Window.partitionBy("namespace", "section")
    e = e.withColumn("rank", F.row_number().over(w.orderBy(F.desc(degree), F.desc(facts), "ordinal"))).withColumn("more", F.greatest(F.count("*").over(w) - most, F.lit(0)))
    return e.where(F.col("rank") <= most).select("namespace", "section", "rank", "name", F.get("observations", F.lit(0)).alias("fact"), "more")


def anti_excluded(facts: DataFrame, by_fact: DataFrame, by_session: DataFrame) -> DataFrame:
    """Facts (namespace, name, text, source) that neither their key nor their session excludes."""
    keyed = facts.withColumn("obs_key", T.obs_key(F.col("name"), F.col("text")))
    kept = keyed.join(by_fact.select("namespace", "obs_key"), ["namespace", "obs_key"], "left_anti")
    return kept.join(by_session.select("namespace", F.col("session_id").alias("source")), ["namespace", "source"], "left_anti").drop("obs_key")


def drop_dangling(relations: DataFrame, dropped: DataFrame) -> DataFrame:
    """Relations without any that touch a dropped name."""
    gone = dropped.select(T.norm_key(F.col("name")).alias("k")).distinct()
    for end in ("src", "dst"):
        relations = relations.withColumn("k", T.norm_key(F.col(end))).join(gone, "k", "left_anti").drop("k")
    return relations


def components(edges: DataFrame, materialize, most: int = 50) -> DataFrame:  # noqa: ANN001
    """(v, root): the smallest vertex that edges (a, b) reach; ``materialize`` cuts the lineage each round."""
    both = materialize(edges.select("a", "b").union(edges.select("b", "a")).distinct())
    labels = materialize(both.groupBy(F.col("a").alias("v")).agg(F.least(F.min("b"), F.first("a")).alias("root")))
    for _ in range(most):
        near = both.join(labels.select(F.col("v").alias("b"), "root"), "b").groupBy(F.col("a").alias("v")).agg(F.min("root").alias("near"))
        moved = labels.join(near, "v").select("v", "root", F.least("root", "near").alias("now"))
        hop = labels.select(F.col("v").alias("now"), F.col("root").alias("further"))
        new = materialize(moved.join(hop, "now").select("v", F.least("now", "further").alias("root"), (F.least("now", "further") != F.col("root")).alias("changed")))
        labels = new.select("v", "root")
        if new.where("changed").isEmpty():
            return labels
    raise RuntimeError("components did not settle")


def linked(mentions: DataFrame, materialize) -> DataFrame:  # noqa: ANN001
    """``mentions`` (namespace, ordinal, name, aliases) with ``root``, one for all that names and aliases link, directly or by others: its smallest key."""
    keys = explode_keys(mentions.select("namespace", "ordinal", "name", "aliases"), "namespace").withColumn("v", F.concat("namespace", F.lit("\0"), "key"))
    edges = keys.join(keys.groupBy("namespace", "ordinal").agg(F.min("v").alias("b")), ["namespace", "ordinal"]).select(F.col("v").alias("a"), "b").distinct()
    roots = components(edges, materialize)
    return mentions.withColumn("v", F.concat("namespace", F.lit("\0"), T.norm_key(F.col("name")))).join(roots, "v").drop("v")


def merge_entities(mentions: DataFrame, materialize, mode: str = "exact") -> DataFrame:  # noqa: ANN001
    """Mentions (namespace, ordinal, name, aliases) with the canonical name they fold into.

    Names and aliases link mentions; ``component`` folds all that are linked. ``exact`` folds in order: a mention
    joins the entity that last took its first known key, or starts one. Keys never leave a component, so each
    component is folded alone, and all of them at once.
    """
    return fold_entities(linked(mentions, materialize), mode)


def fold_entities(named: DataFrame, mode: str = "exact") -> DataFrame:
    """The same for mentions that have their ``root``."""
    if mode == "component":
        first = named.groupBy("root").agg(F.min_by("name", "ordinal").alias("canonical"))
        return named.join(first, "root").drop("root")
    rows = named.select("root", "namespace", "ordinal", "name", "aliases").repartition("root").sortWithinPartitions("root", "ordinal")
    return rows.mapInArrow(_fold, "namespace string, ordinal long, name string, canonical string")


def _norm(s: str) -> str:
    return s.strip().lower()


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each mention's entity, component by component; what is held of one is its keys, not its mentions.

    A mention that joins an entity takes all of that entity's keys anew, so a key leads to the one of its entities that was joined last: keys know their entities, entities when
    they were joined, and a mention costs as much as it has keys, however many its entity has.
    """
    root = None
    held: dict[str, list[int]] = {}  # the entities that have a key
    names: list[str] = []
    joined: list[int] = []  # when an entity took its keys last
    for batch in batches:
        canonical = []
        for at, name, aliases in zip(batch.column(0).to_pylist(), batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True):
            if at != root:
                root, held, names, joined, now = at, {}, [], [], 0
            keys = [k for k in map(_norm, [name, *(aliases or [])]) if k]
            own = next((held[k] for k in keys if k in held), None)
            if own is None:
                mine = len(names)
                names.append(name)
                joined.append(0)
            else:
                mine = own[0] if len(own) == 1 else max(own, key=joined.__getitem__)
            now += 1
            joined[mine] = now
            for k in keys:
                if mine not in (owners := held.setdefault(k, [])):
                    owners.append(mine)
            canonical.append(names[mine])
        yield pa.RecordBatch.from_arrays([*batch.columns[1:4], pa.array(canonical, type=pa.string())], names=["namespace", "ordinal", "name", "canonical"])
