"""Small cases of curation, listings, readers and streams."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import archive, curation, diffs, graph, messages
from corpusloom.plans import knowledge
from corpusloom.plans.relational import no_exclusions
from corpusloom.sources import readers, tables
from corpusloom.streaming import streams

FACTS = "namespace string, record_id string, ordinal long, name string, type string, aliases array<string>, text string, source string"


@pytest.fixture
def facts(spark):  # noqa: ANN001, ANN201
    rows = [
        ("n", "r1", 1, "Payment", "service", ["pay"], "calls orders", "s1"), ("n", "r1", 1, "Payment", "service", ["pay"], "is old", "s2"), ("n", "r2", 2, "pay", "", [], "Calls orders ", "s2"),
        ("n", "r2", 3, "Orders", "service", [], "keeps rows", "s2"), ("n", "r2", 4, "Note", "note", [], None, ""), ("m", "r3", 5, "Payment", "service", [], "elsewhere", "s1"),
    ]
    return spark.createDataFrame(rows, FACTS)


@pytest.fixture
def edges(spark):  # noqa: ANN001, ANN201
    rows = [("n", "Payment", "Orders", "uses", 1), ("n", "payment", "ORDERS ", "Uses", 2), ("n", "Note", "Orders", "links", 3), ("m", "Payment", "x", "uses", 4)]
    return spark.createDataFrame(rows, "namespace string, src string, dst string, label string, ordinal long")


def session(spark, *rows):  # noqa: ANN001, ANN201
    return spark.createDataFrame(rows, "namespace string, session_id string")


def test_nothing_excluded_changes_nothing(spark, facts, edges):  # noqa: ANN001
    kept, left = curation.filter_excluded(facts, edges, no_exclusions(spark))
    assert kept.count() == 6 and left.count() == 4


def test_excluded_session_empties_entities_and_drops_their_edges(spark, facts, edges):  # noqa: ANN001
    known = curation.exclude(no_exclusions(spark), sessions=session(spark, ("n", "s2")))
    kept, left = curation.filter_excluded(facts, edges, known)
    assert sorted(r["text"] for r in kept.collect()) == ["calls orders", "elsewhere"]
    assert [r["dst"] for r in left.collect()] == ["x"]  # Orders and Note have no facts left in n
    restored = curation.unexclude(known, sessions=session(spark, ("n", "s2"), ("n", "other")))
    assert restored.is_empty() and curation.filter_excluded(facts, edges, restored)[0].count() == 6


def test_flags_of_facts_and_sessions(spark, facts):  # noqa: ANN001
    known = curation.exclude(no_exclusions(spark), facts.where("text = 'is old'"), session(spark, ("m", "s1")))
    got = {r["text"]: (r["fact_excluded"], r["session_excluded"]) for r in curation.excluded_flags(facts, known).collect()}
    assert got == {"calls orders": (False, False), "is old": (True, False), "Calls orders ": (False, False), "keeps rows": (False, False), None: (False, False), "elsewhere": (False, True)}


def test_an_excluded_fact_stays_out_of_the_next_graph(spark, facts, edges):  # noqa: ANN001
    known = curation.exclude(no_exclusions(spark), facts.where("text = 'is old'"))
    for _ in range(2):
        e, r = curation.assemble_graph(facts, edges, known, tables.materialize)
    got = {(x["namespace"], x["name"]): [o["text"] for o in x["observations"]] for x in e.collect()}
    assert got == {("n", "Payment"): ["calls orders"], ("n", "Orders"): ["keeps rows"], ("m", "Payment"): ["elsewhere"]}
    assert {x["name"]: x["aliases"] for x in e.where("namespace = 'n'").collect()} == {"Payment": ["pay"], "Orders": None}
    assert sorted((x["namespace"], x["src"]) for x in r.collect()) == [("m", "Payment"), ("n", "Payment")]  # one spelling of the edge; the note's has gone


def test_focus_keeps_matches_and_their_neighbours(spark, facts, edges):  # noqa: ANN001
    e, r = curation.assemble_graph(facts, edges, no_exclusions(spark), tables.materialize, "keeps ROWS")
    assert {x["name"] for x in e.collect()} == {"Payment", "Orders", "Note"} and {x["label"] for x in r.collect()} == {"uses", "links"}
    e, r = curation.assemble_graph(facts, edges, no_exclusions(spark), tables.materialize, "nothing")
    assert not e.count() and not r.count()


def test_edit_changes_the_first_exact_text_and_its_exclusion(spark, facts):  # noqa: ANN001
    edits = spark.createDataFrame([("n", "r1", " PAYMENT", "calls orders", " calls Orders v2 "), ("n", "r2", "Orders", "keeps rows", "  "), ("n", "r9", "x", "y", "z")], "namespace string, record_id string, name string, old string, new string")
    known = curation.exclude(no_exclusions(spark), facts.where("text = 'calls orders'"))
    got, moved = curation.edit_observation(facts, edits, known)
    assert got.columns == facts.columns and sorted(r["text"] or "" for r in got.collect()) == ["", "Calls orders ", "calls Orders v2", "elsewhere", "is old", "keeps rows"]
    assert moved.facts.collect() == curation.keys_of(spark.createDataFrame([("n", "payment", "calls Orders v2")], "namespace string, name string, text string")).collect()


def test_delete_relation_takes_the_first_match_alone(spark, edges):  # noqa: ANN001
    gone = spark.createDataFrame([("payment ", "orders", "USES"), ("no", "such", "edge")], "src string, dst string, label string")
    assert sorted(r["ordinal"] for r in curation.delete_relation(edges, gone).collect()) == [2, 3, 4]
    own = gone.withColumn("namespace", F.lit("m"))
    assert curation.delete_relation(edges, own).count() == 4


def test_move_takes_relations_of_the_name_along(spark, facts, edges):  # noqa: ANN001
    names = spark.createDataFrame([("Pay",)], "name string")
    got, moved = curation.move_entities(facts, edges, names, "n", "t")
    assert sorted((r["namespace"], r["ordinal"]) for r in got.collect()) == [("m", 5), ("n", 3), ("n", 4), ("t", 1), ("t", 1), ("t", 2)]
    assert {r["namespace"] for r in moved.collect()} == {"n", "m"}  # no edge is of the alias itself
    _, moved = curation.move_entities(facts, edges, spark.createDataFrame([("payment",)], "name string"), "n", "t")
    assert sorted((r["namespace"], r["ordinal"]) for r in moved.collect()) == [("m", 4), ("n", 3), ("t", 1), ("t", 2)]


def test_migrated_namespaces_can_meet(spark, facts):  # noqa: ANN001
    to = spark.createDataFrame([("n", "all"), ("m", "all"), ("q", "z")], "namespace string, target string")
    assert {r["namespace"] for r in curation.migrate_namespaces(facts, to).collect()} == {"all"}


def test_union_of_namespaces_is_one_graph(spark, facts, edges):  # noqa: ANN001
    known = curation.exclude(no_exclusions(spark), sessions=session(spark, ("m", "s1")))
    named, r = curation.union_namespaces(facts, edges, ["m", "n"], no_exclusions(spark), tables.materialize)
    assert {(x["namespace"], x["name"]) for x in named.collect()} == {("m+n", "Payment"), ("m+n", "Orders"), ("m+n", "Note")} and r.count() == 3
    named, _ = curation.union_namespaces(facts, edges, ["m", "n"], known, tables.materialize)
    assert "elsewhere" not in {x["text"] for x in named.collect()} and {x["text"] for x in named.collect()} >= {"calls orders"}


def test_cleaning_removes_emptied_entities_with_their_edges(spark):  # noqa: ANN001
    f = spark.createDataFrame([("r", "A", "Pipeline #1"), ("r", "A", "pipeline #12345"), ("r", "B", "pipeline #12345"), ("q", "B", "stays"), ("r", "C", None)], "record_id string, name string, text string")
    e = spark.createDataFrame([("r", "a", "c", "x", 1), ("r", "b", "c", "x", 2), ("q", "B", "c", "x", 3)], "record_id string, src string, dst string, label string, ordinal int")
    kept, left, report = curation.clean_snapshots(f, e)
    assert sorted((r["record_id"], r["name"]) for r in kept.collect()) == [("q", "B"), ("r", "A"), ("r", "C")]
    assert sorted(r["ordinal"] for r in left.collect()) == [1, 3]
    assert tuple(report.first()) == (1, 1, 2)
    assert curation.clean_snapshots(f, e, lambda t: F.lit(False))[2].first()["facts_removed"] == 0


def test_scope(spark, facts):  # noqa: ANN001
    n = lambda *a: messages.scope_filter(facts, *a).count()
    assert (n(), n("*"), n("m"), n(" m , ,x"), n("", "m"), n("n", "m")) == (6, 6, 1, 1, 1, 5)


def test_namespaces_without_entities_can_be_kept(spark, facts):  # noqa: ANN001
    every = spark.createDataFrame([("n",), ("m",), ("empty",)], "namespace string")
    assert {r["namespace"]: r["entities"] for r in graph.namespace_counts(facts, every).collect()} == {"n": 4, "m": 1, "empty": 0}


def test_get_entity_by_alias(spark, facts, edges):  # noqa: ANN001
    e = facts.groupBy("namespace", "name", "aliases").agg(F.min("ordinal").alias("ordinal"), F.collect_list("text").alias("observations"))
    got = graph.get_entity(spark.createDataFrame([("PAY",), ("orders",), ("nobody",)], "mention string"), e, edges).collect()
    assert {(r["mention"], r["namespace"], r["name"], tuple(x["ordinal"] for x in r["edges"])) for r in got} == {("PAY", "n", "Payment", (1, 2)), ("orders", "n", "Orders", (1, 3))}


def test_transcripts_hold_what_is_there(spark):  # noqa: ANN001
    spec = ("ship", None, ["fast"], None, [], None, ["a", "b"])
    rows = [(1, " do it ", spec, "done"), (2, "", None, " "), (3, None, None, "only this")]
    got = {r["task_id"]: r["text"] for r in archive.task_transcript(spark.createDataFrame(rows, f"task_id int, input string, spec {archive.SPEC}, result string")).collect()}
    assert got == {1: "任务输入:\ndo it\n\n任务规格:\n目标: ship\n\n约束:\n- fast\n\n建议步骤:\n- a\n- b\n\n最终采纳的产出:\ndone", 3: "最终采纳的产出:\nonly this"}


def test_diffs_are_cut_by_lines_and_by_bytes(spark):  # noqa: ANN001
    text = "diff --git a/x b/x\n@@ -1 +1 @@ f\n" + "\n".join(f"+{'é' * 10}{i}" for i in range(30)) + "\n"
    blocks = diffs.split_diffs(spark.createDataFrame([(1, text)], "diff_id int, text string")).withColumnRenamed("block", "text")
    by_lines, by_bytes = (diffs.truncate_diffs(blocks, **k).first() for k in ({"lines": 5}, {"size": 120}))
    assert by_lines["text"].split("\n") == text.split("\n")[:5] and by_lines["truncated"]
    kept = by_bytes["text"] + "\n"
    assert text.startswith(kept) and len(kept.encode()) <= 120 < len(kept.encode()) + len(text[len(kept) :].split("\n")[0].encode()) + 1
    assert not diffs.truncate_diffs(blocks).first()["truncated"]


# Readers ----------------------------------------------------------------------------------


def write(folder, files: dict[str, str]) -> str:  # noqa: ANN001
    for name, text in files.items():
        path = folder / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)
    return f"file://{folder}"


def test_notes_without_hidden_folders(spark, tmp_path):  # noqa: ANN001
    root = write(tmp_path / ".vaults" / "v", {"a.md": "A", "sub/B.MD": "b\n", ".trash/c.md": "c", "sub/.obsidian/d.md": "d", "e.png": "x", "sub/deep/f.md": "f"})
    got = {r["path"].rsplit("/", 1)[1]: r["content"] for r in readers.read_notes(spark, root).collect()}
    assert got == {"a.md": "A", "B.MD": "b\n", "f.md": "f"}


def test_source_files_keep_large_ones_without_content(spark, tmp_path):  # noqa: ANN001
    root = write(tmp_path, {"repo/main.go": "package main", "repo/big.py": "x" * 300, "repo/vendor/v.go": "v", "repo/yarn.lock": "", "repo/a.min.js": "", "repo/my_secret.py": "s", "repo/readme.txt": "t", "repo/src/App.TSX": "t"})
    got = {r["path"]: (r["size"], r["content"]) for r in readers.read_source_files(spark, root, 100, lambda p: F.substring_index(p, "/repo/", -1)).collect()}
    assert got == {"main.go": (12, "package main"), "big.py": (300, ""), "src/App.TSX": (1, "t")}


def test_memory_notes_by_scope(spark, tmp_path):  # noqa: ANN001
    root = write(tmp_path, {"RULES.md": "all", "projects/p/memory/a.md": "a", "projects/q/memory/b.md": "b", "projects/q/memory/c.txt": "c", "projects/q/other/d.md": "d"})
    got = readers.read_memory_notes(spark, f"{root}/RULES.md", f"{root}/projects").collect()
    assert sorted((r["scope"], r["content"]) for r in got) == [("instructions", "all"), ("memory", "a"), ("memory", "b")]


def test_lines_are_numbered_in_file_order(spark, tmp_path):  # noqa: ANN001
    lines = [f'{{"type": "user", "message": {{"content": "turn {i:05d} {"x" * 50}"}}}}' for i in range(3000)]
    root = write(tmp_path, {"s1.jsonl": "\n".join(lines), "s2.jsonl": lines[0]})
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20k")
    try:
        got = readers.read_transcripts_claude(spark, root).where("session_id = 's1'").orderBy("seq").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [r["text"][5:10] for r in got] == [f"{i:05d}" for i in range(3000)]


def test_versions_of_exclusions(spark, tmp_path):  # noqa: ANN001
    path = f"file://{tmp_path}/ex"
    readers.write_exclusions(no_exclusions(spark), path, 1)
    assert readers.read_exclusions(spark, path).is_empty()
    readers.write_exclusions(curation.exclude(no_exclusions(spark), sessions=session(spark, ("n", "s"), ("n", "s"))), path, 2)
    known = readers.read_exclusions(spark, path)
    assert known.facts.isEmpty() and known.sessions.collect() == [("n", "s")]


def test_no_local_folder_on_a_cluster(spark, monkeypatch):  # noqa: ANN001
    class Elsewhere:
        conf = type("C", (), {"get": staticmethod(lambda *_: None)})
        sparkContext = type("S", (), {"master": "spark://host:7077"})  # noqa: N815

    with pytest.raises(ValueError, match="checkpoint"):
        tables.shared_dir(Elsewhere())


# Streams ----------------------------------------------------------------------------------


def test_a_repeated_batch_replaces_its_records(spark, tmp_path):  # noqa: ANN001
    out = f"file://{tmp_path}/records"
    row = lambda v: spark.createDataFrame([("a", v), ("b", v)], "id string, v int")
    readers.append_records(row(1), out, 0)
    readers.append_records(row(2), out, 1)
    readers.append_records(row(3).where("id = 'a'"), out, 1)
    assert {r["id"]: r["v"] for r in readers.latest_records(spark, out, ["id"]).collect()} == {"a": 3, "b": 1}


def test_rows_of_one_name_are_files_of_their_own(spark):  # noqa: ANN001
    """Also where a task holds both: a file for each row, none with two rows in it."""
    rows = spark.createDataFrame([*[("cmd/a.go", f"package {i}") for i in range(100)], ("cmd/b.go", "package c")], "name string, content string").coalesce(1)
    found = readers.read_source_files(spark, knowledge._as_files(rows, spark, "sources"), 2000, knowledge._file_name)
    assert sorted(tuple(r) for r in found.select("path", "content").collect()) == sorted([*[("cmd/a.go", f"package {i}\n") for i in range(100)], ("cmd/b.go", "package c\n")])


def test_files_are_written_by_all_tasks(spark):  # noqa: ANN001
    """Few bytes in many files: one partition of rows is dealt to tasks, which name their files by their number."""
    rows = spark.range(64).select(F.concat(F.lit("f"), "id").alias("name"), F.lit("x").alias("content")).coalesce(1)
    paths = [r["path"] for r in spark.read.option("recursiveFileLookup", "true").format("binaryFile").load(knowledge._as_files(rows, spark, "many")).select("path").collect()]
    assert len(paths) == 64 and len({p.rsplit("/", 1)[1].split("-")[1] for p in paths}) >= spark.sparkContext.defaultParallelism
