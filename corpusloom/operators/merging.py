"""Merged entities kept up to date: records come and go, and only the components that they touch are folded again."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators import graph as G
from corpusloom.sources.versions import Versions

Materialize = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class MergedEntities:
    """Mentions (namespace, record_id, ordinal, name, aliases) with their root and canonical name, below ``path``. An ordinal is one mention's of its namespace."""

    path: str
    materialize: Materialize
    mode: str = "exact"
    rows: Versions = field(init=False)

    def __post_init__(self) -> None:
        schema = "namespace string, record_id string, ordinal long, name string, aliases array<string>, root string, canonical string, gone boolean"
        object.__setattr__(self, "rows", Versions(self.path, schema, ("namespace", "ordinal")))

    def read(self, spark: SparkSession, before: int | None = None) -> DataFrame:
        """All present mentions."""
        return self.rows.read(spark, before).where("not gone").drop("gone")

    def update(self, version: int, added: DataFrame | None = None, removed: DataFrame | None = None) -> DataFrame:
        """Take in mentions and take out records (namespace, record_id); the mentions that were folded again.

        A record that is added takes the place of what it had before. Components that share a key with what is added, or
        have a mention of what is removed, are linked and folded anew, which may join or part them; no others are written. The result is that of
        merging all present mentions at once. The same version may be written again: it decides by what there was before it.
        """
        spark = (added if added is not None else removed).sparkSession
        on = ["namespace", "record_id"]
        held = self.read(spark, version)
        columns = ["namespace", "record_id", "ordinal", "name", "aliases"]
        added = spark.createDataFrame([], held.select(*columns).schema) if added is None else added.select("namespace", "record_id", F.col("ordinal").cast("long").alias("ordinal"), "name", F.coalesce("aliases", F.array().cast("array<string>")).alias("aliases"))
        added = self.materialize(added)
        out = added.select(*on) if removed is None else added.select(*on).unionByName(removed.select(*on))
        leaving = self.materialize(held.join(out.distinct(), on, "left_semi"))
        new_keys = G.explode_keys(added.select("namespace", "ordinal", "name", "aliases"), "namespace").select("namespace", "key").distinct()
        # a root begins with its namespace
        keyed = G.explode_keys(held, "root").withColumn("namespace", F.substring_index("root", "\0", 1)).join(new_keys, ["namespace", "key"], "left_semi")
        touched = self.materialize(keyed.select("root").union(leaving.select("root")).distinct())
        staying = held.join(touched, "root", "left_semi").join(leaving.select("namespace", "ordinal"), ["namespace", "ordinal"], "left_anti").select(*columns)
        mentions = self.materialize(staying.unionByName(added))
        named = self.materialize(G.linked(mentions, self.materialize))
        folded = G.fold_entities(named, self.mode).select("namespace", "ordinal", "canonical")
        present = named.join(folded, ["namespace", "ordinal"]).select(*columns, "root", "canonical", F.lit(False).alias("gone"))
        gone = leaving.join(added.select("namespace", "ordinal"), ["namespace", "ordinal"], "left_anti").select(*columns, "root", "canonical", F.lit(True).alias("gone"))
        changed = self.materialize(present.unionByName(gone))
        self.rows.append(changed, version)
        return changed.where("not gone").drop("gone")
