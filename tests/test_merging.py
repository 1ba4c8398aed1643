"""Incremental merging against merging all at once."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import graph
from corpusloom.operators.merging import MergedEntities
from corpusloom.sources.tables import materialize

SCHEMA = "namespace string, record_id string, ordinal long, name string, aliases array<string>"


@pytest.mark.parametrize("mode", ["exact", "component"])
def test_any_changes_equal_a_full_run(spark, tmp_path, mode):  # noqa: ANN001
    rng = random.Random(mode)
    name = lambda: f"N{rng.randrange(18)}"
    made = lambda record, k: [("ab"[record % 2], f"r{record}", record * 10 + i, name(), [name() for _ in range(rng.randrange(3))] or None) for i in range(k)]
    kept = MergedEntities(f"file://{tmp_path}/m", materialize, mode)
    now: dict[str, list] = {}
    for version in range(4):
        added = {r: made(r, rng.randint(1, 3)) for r in rng.sample(range(12), 5 if version else 8)}
        removed = [(ns, r) for r, ns in [(r, rows[0][0]) for r, rows in now.items()] if int(r[1:]) not in added and rng.random() < 0.3]
        now = {r: rows for r, rows in now.items() if ("ab"[int(r[1:]) % 2], r) not in removed} | {f"r{r}": rows for r, rows in added.items()}
        for _ in range(2 if version == 2 else 1):  # a repeated version changes nothing
            kept.update(version, spark.createDataFrame([x for rows in added.values() for x in rows], SCHEMA), spark.createDataFrame(removed, "namespace string, record_id string"))
        if version == 1:
            kept.rows.compact(spark)
        every = spark.createDataFrame([x for rows in now.values() for x in rows], SCHEMA)
        want = {(r["namespace"], r["ordinal"], r["name"], r["canonical"]) for r in graph.merge_entities(every, materialize, mode).collect()}
        assert {(r["namespace"], r["ordinal"], r["name"], r["canonical"]) for r in kept.read(spark).collect()} == want


def test_only_touched_components_are_folded_again(spark, tmp_path):  # noqa: ANN001
    rows = [("n", f"r{i}", i, f"name{i}", [f"group{i % 50}"]) for i in range(200)]
    kept = MergedEntities(f"file://{tmp_path}/m", materialize)
    assert kept.update(0, spark.createDataFrame(rows, SCHEMA)).count() == 200
    # joins two groups; one record of a third goes
    again = kept.update(1, spark.createDataFrame([("n", "new", 500, "Bridge", ["GROUP1", "group2 "])], SCHEMA), spark.createDataFrame([("n", "r3")], "namespace string, record_id string"))
    assert sorted(r["ordinal"] for r in again.collect()) == sorted([500] + [i for i in range(200) if i % 50 in (1, 2, 3) and i != 3])
    assert kept.read(spark).count() == 200
    assert {r["canonical"] for r in kept.read(spark).where(F.col("ordinal").isin(53, 103)).collect()} == {"name53"}
    # the same name in another namespace touches nothing
    assert kept.update(2, spark.createDataFrame([("m", "x", 1, "name7", ["group7"])], SCHEMA)).count() == 1
