"""Chunks, recall and writing against brute force over the smallest tables."""

from __future__ import annotations

import random
import re
import time
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import archive, chunking, curation, embedding, retrieval
from corpusloom.plans import knowledge, views
from corpusloom.sources import tables
from corpusloom.streaming import streams

DATA = "/root/testdata/sf0.001"


# Chunks -----------------------------------------------------------------------------------


def blocks_of(units: list[str], target: int, overlap: bool = True) -> list[str]:
    """Blocks by their definition: each grows unit by unit while it fits."""
    size = lambda us: sum(len(u.encode()) for u in us)
    out, at, least, again = [], 0, 1, False
    while at < len(units):
        to = min(len(units), at + least)
        while to < len(units) and size(units[at : to + 1]) <= target:
            to += 1
        out.append("\n\n".join(units[at:to]))
        full = size(units[at:to]) >= target and not (again and to == at + 1)
        if to == len(units) and not full:
            break
        again = overlap and len(units[to - 1]) < target
        at, least = (to - 1, 1 if full else 2) if again else (to, 1)
    return out


def chunks_of(sources: dict, kind: str, target: int = 600, clean: bool = False) -> list[tuple]:
    out = []
    for (namespace, source), units in sources.items():
        units = [u for u in (x.strip() for x in units) if u]
        blocks = blocks_of(units, target)
        if clean and len(blocks) > 1 and blocks[-1] == units[-1] and blocks[-2].endswith("\n\n" + units[-1]):
            blocks.pop()
        kept = [b for b in blocks if not chunking._is_noise(b)]
        out += [(namespace, f"{source}#{i}", b, source, kind) for i, b in enumerate(kept)]
    return sorted(out)


def rows_of(df) -> list[tuple]:  # noqa: ANN001
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("mode", ["exact", "clean"])
def test_long_sources_are_cut_in_segments(spark, mode):  # noqa: ANN001
    draw, sources, rows = random.Random(5), {}, []
    for k, n in enumerate([0, 1, 69, 70, 71, 139, 140, 141, 142, 280, 281, 700, 3000]):
        wide = draw.choice([1, 30, 100])
        units = ["".join(draw.choice("abcdeé ") for _ in range(draw.choice([0, 1, draw.randint(1, wide), 61, 150][: 3 + 2 * (k % 2)]))) + draw.choice(["", "x"]) for _ in range(n)]
        sources["ns" if k % 3 else "", f"s{k}"] = units
        rows += [("ns" if k % 3 else None, f"s{k}", 7 * i - 50, u) for i, u in enumerate(units)] + [("ns", f"s{k}", 3, None)]
    df = spark.createDataFrame(draw.sample(rows, len(rows)), "namespace string, source string, seq long, unit string")
    got = [(r[0] or "", *r[1:]) for r in chunking.chunk_units(df, "note", 60, mode, segment=70).collect()]
    want = chunks_of(sources, "note", 60, clean=mode == "clean")
    assert Counter(got) == Counter(want) and len(want) > 100
    assert chunking.chunk_units(df.limit(0), "note", 60, mode, segment=70).isEmpty()


def test_a_source_of_a_million_units(spark):  # noqa: ANN001
    n = 1_000_000
    df = spark.range(n).select(F.lit("ns").alias("namespace"), F.lit("s").alias("source"), F.col("id").alias("seq"), F.concat(F.lit("unit "), F.sha1(F.col("id").cast("string")).substr(F.lit(1), (F.col("id") * 7919 % 37 + 1).cast("int"))).alias("unit"))
    blocks = chunking.pack_units([r["unit"] for r in df.orderBy("seq").collect()], 600)
    want = [("s#" + str(i), b) for i, b in enumerate(b for b in blocks if not chunking._is_noise(b))]
    got = chunking.chunk_units(df, "note").select("chunk_id", "text").collect()
    assert len(want) > 30_000 and sorted(map(tuple, got)) == sorted(want)


def test_chunk_queries(spark):  # noqa: ANN001
    said = defaultdict(list)
    for r in views.messages(spark, DATA).orderBy("session_id", "seq").collect():
        if r["text"].strip():
            said[r["namespace"], r["session_id"]].append(f"{r['role']}: {r['text'].strip()}")
    want = chunks_of(said, "chat")
    assert want and rows_of(knowledge.chunk_transcripts(spark, DATA)) == want
    texts = {r["doc_id"]: r["text"].replace(".\n", ".\n\n") for r in views.table(spark, DATA, "documents").collect()}
    want = chunks_of({("ns", f"d{i}"): t.split("\n\n") for i, t in texts.items()}, "note")
    assert len(want) > len(texts) / 2 and rows_of(knowledge.chunk_units(spark, DATA)) == want
    want = chunks_of({("vault", f"obsidian:{i}"): t.split("\n\n") for i, t in texts.items()}, "note", clean=True)
    assert rows_of(knowledge.chunk_notes(spark, DATA)) == want
    tasks = {r["task_id"]: r["text"] for r in archive.task_transcript(knowledge._spoken_tasks(spark, DATA)).collect()}
    want = chunks_of({("ns", f"task:{i}"): t.split("\n\n") for i, t in tasks.items()}, "task")
    assert want and rows_of(knowledge.chunk_tasks(spark, DATA)) == want
    code = []
    for i, t in texts.items():
        parts = [p for p in (x.strip() for x in t.split("\n\n")) if p]
        kept = [b for b in blocks_of(parts, 1600, overlap=False) if len(b.strip()) >= 40]
        code += [(f"code:f/{i}.go#{k}", f"// f/{i}.go\n{b.strip()}", f"code:f/{i}.go", "code") for k, b in enumerate(kept)]
    assert rows_of(knowledge.chunk_code(spark, DATA)) == sorted(code)


@pytest.mark.parametrize("overlap", [True, False])
def test_blocks_do_not_depend_on_parts(overlap):  # noqa: ANN001
    rng = np.random.default_rng(3)
    for _ in range(300):
        units = [rng.choice(["x", "付"]) * int(rng.integers(1, 30)) for _ in range(rng.integers(0, 14))]
        want, blocks, got = blocks_of(units, 20, overlap), chunking.Blocks(20, overlap), []
        at = 0
        while at < len(units):
            n = int(rng.integers(1, 5))
            got += blocks.add(units[at : at + n])
            at += n
        assert got + blocks.end() == want == chunking.pack_units(units, 20, overlap)


def test_noise_is_the_same_rule_in_both_forms(spark):  # noqa: ANN001
    texts = [r["text"] for r in views.messages(spark, DATA).collect()] + ["Traceback\n at x\n$ ls and so on with some more text", "user: ok", "收到。", "x" * 40, "error: a\n\nwarning: b\nplain text of some length here"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    assert [r[1] for r in df.select("text", T.is_noise_chunk(F.col("text"))).collect()] == [chunking._is_noise(t) for t in texts]


# Recall -----------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def graph(spark):  # noqa: ANN001, ANN201
    return knowledge._graph(spark, DATA)


OPTIONS = embedding.RecallOptions.for_model(lexical=True)


def vectors(df, key: str) -> tuple[list, np.ndarray]:  # noqa: ANN001
    rows = df.select(key, "embedding").collect()
    x = np.asarray([r["embedding"] for r in rows], dtype=np.float64)
    return [r[key] for r in rows], x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def check_ranked(found: dict, q: tuple, v: tuple, k: int, floor: float) -> None:
    """Of every query the k best; within rounding, any of equal ones."""
    scores = q[1] @ v[1].T
    for i, name in enumerate(q[0]):
        order = np.sort(scores[i])[::-1]
        n = min(k, int((order >= floor).sum()))
        got = found.get(name, [])
        assert len(got) == n
        score = dict(zip(v[0], scores[i], strict=True))
        for at, other in enumerate(got):
            assert abs(score[other] - order[at]) < 1e-9


def lists(df, key: str = "id") -> dict:  # noqa: ANN001
    out = defaultdict(list)
    for r in df.orderBy("query_id", "rank").collect():
        out[r["query_id"]].append(r[key])
    return out


def test_recall_against_brute_force(spark, graph):  # noqa: ANN001
    queries, entities, relations, chunks = graph
    texts = {r["query_id"]: r["text"] for r in queries.collect()}
    scope = defaultdict(list)
    for i in sorted(texts):
        scope[i] = [["ns0", "ns1", "ns2"], ["ns2", "ns0"], ["ns1", "_global_"]][i % 3]
    told = defaultdict(list)
    for r in knowledge._scope(spark, DATA).orderBy("query_id", "place").collect():
        told[r["query_id"]].append(r["namespace"])
    assert told == scope
    options = embedding.RecallOptions(floor=0.12, hops=2)
    hits, best = retrieval.recall(*graph, options, tables.materialize, knowledge._scope(spark, DATA))
    how = {(r["query_id"], r["namespace"], r["key"]): r["how"] for r in hits.collect()}
    by_rank = defaultdict(dict)
    for r in hits.where("rank is not null").collect():
        by_rank[r["query_id"], r["namespace"]][r["rank"]] = r["key"]
    found = defaultdict(list)
    for r in best.orderBy("rank").collect():
        found[r["query_id"], r["namespace"]].append(r["id"])
    terms = {r["query_id"]: r["t"] for r in queries.select("query_id", T.query_terms(F.col("text")).alias("t")).collect()}
    want = {}
    for ns in ("ns0", "ns1", "ns2"):
        asked = queries.where(F.col("query_id").isin([i for i in texts if ns in scope[i]]))
        q, own = vectors(asked, "query_id"), chunks.where(F.col("namespace") == ns)
        names = [r["name"] for r in entities.where(F.col("namespace") == ns).collect()]
        seeds = {i: [by_rank[i, ns][k] for k in sorted(by_rank[i, ns])] for i in q[0]}
        check_ranked(seeds, q, vectors(entities.where(F.col("namespace") == ns), "name"), 8, 0.12)
        ranked = lists(retrieval.rank_chunks(asked, own, options))
        edges = defaultdict(set)
        for r in relations.where(F.col("namespace") == ns).collect():
            edges[r["src"].lower()].add(r["dst"].lower())
        low = {r["id"]: r["text"].lower() for r in own.collect()}
        for i in q[0]:
            words = {n for n in names if len(n) >= 3 and n in texts[i].lower()}
            start = set(seeds[i]) | (words if seeds[i] else set())
            near = {x for n in start for x in edges[n]}
            near = (near | {x for n in near for x in edges[n]}) - start
            for n in set(seeds[i]) | words | near:
                want[i, ns, n] = (n in seeds[i]) + 2 * (n in words) + 4 * (n in near)
            keyword = sorted(c for c, t in low.items() if terms[i] and sum(x in t for x in terms[i]) >= max(1, len(terms[i]) // 2))
            score, first = defaultdict(float), {}
            for no, listed in enumerate((ranked[i], keyword), 1):
                for rank, c in enumerate(listed, 1):
                    score[c] += 1 / (60 + rank)
                    first[c] = min(first.get(c, (9, 0)), (no, rank))
            assert found[i, ns] == sorted(score, key=lambda c: (-score[c], first[c], c))[:5]  # noqa: B023
    assert how == want


@pytest.fixture(scope="module")
def two_spaces(spark):  # noqa: ANN001, ANN201
    """The name Payment in two namespaces, relations spelled otherwise, three steps in a row."""
    fact = "array<struct<text string, source string>>"
    e = spark.createDataFrame(
        [("a", "Payment", "service", 1, [1.0, 0.0, 0.0], [("calls orders", "s1"), ("is old", "mcp:86400000-x"), ("bare", None)]), ("a", "Order Service", "service", 2, [0.0, 1.0, 0.0], [("stores rows", "code:a/b.go")]), ("a", "Ledger", None, 3, [0.0, 0.9, 0.1], []),
         ("b", "payment", "team", 1, [1.0, 0.1, 0.0], [("eats lunch", "s1")]), ("b", "Audit", "team", 2, [0.0, 0.0, 1.0], [("long " * 400, "moved:q")]), ("b", "Late", "team", 3, None, None)],
        f"namespace string, name string, type string, ordinal int, embedding array<double>, observations {fact}",
    ).withColumn("aliases", F.array().cast("array<string>"))
    r = spark.createDataFrame([("a", "PAYMENT", "order service", "calls", 1), ("a", "Order Service", "Ledger", "writes", 2), ("a", "Ledger", "Gone", "feeds", 3), ("b", "Payment", "Late", "knows", 1), ("b", "Audit", "payment", "checks", 2)], "namespace string, src string, dst string, label string, ordinal int")
    c = spark.createDataFrame([("a", "c1", "payment retries", "s1", [1.0, 0.0, 0.0]), ("b", "c1", "payment lunch", "task:7", [1.0, 0.0, 0.0]), ("b", "c2", "no vector payment", "s9", None)], "namespace string, id string, text string, source string, embedding array<double>")
    q = spark.createDataFrame([(1, "payment", [1.0, 0.0, 0.0]), (2, "payment", None), (3, "nothing here", [0.0, -1.0, -1.0])], "query_id int, text string, embedding array<double>")
    return q, e, r, c


OWN = embedding.RecallOptions(floor=0.5)


@pytest.mark.parametrize("hops,reached", [(0, set()), (1, {"order service"}), (2, {"order service", "ledger"}), (5, {"order service", "ledger", "gone"})])
def test_hops_and_spelling(two_spaces, hops, reached):  # noqa: ANN001
    hits, best = retrieval.recall(*two_spaces, embedding.RecallOptions(floor=0.5, hops=hops), tables.materialize)
    got = {(r["query_id"], r["namespace"], r["key"]): r["how"] for r in hits.collect()}
    want = {(1, "a", "payment"): 3, (1, "b", "payment"): 3, (2, "a", "payment"): 2, (2, "b", "payment"): 2} | {(1, "a", x): 4 for x in reached} | ({(1, "b", "late"): 4} if hops else {})
    assert got == want  # backwards (Audit) nothing is reached, and without a vector no relations are followed
    assert sorted((r["query_id"], r["namespace"], r["id"]) for r in best.collect()) == [(1, "a", "c1"), (1, "b", "c1")]


def document(rows: list, query_id: int) -> str:
    order = list(retrieval.SECTIONS)
    return "".join(r["text"] for r in sorted((r for r in rows if r["query_id"] == query_id), key=lambda r: (r["place"], order.index(r["section"]), r["rank"])))


def test_rendered_results(spark, two_spaces):  # noqa: ANN001
    titles = spark.createDataFrame([("a", "s1", "Talk about pay"), ("b", "s1", " ")], "namespace string, id string, title string")
    asked = spark.createDataFrame([(1, "b, a"), (2, "*"), (3, "")], "query_id int, project string")
    scope = retrieval.search_scope(asked, two_spaces[1], current="a")
    show = lambda **more: retrieval.search_knowledge(*two_spaces, OWN, materialize=tables.materialize, scope=scope, titles=titles, now_ms=100 * 86_400_000, **more).collect()
    rows = show()
    b = "# 项目 `b` 与「payment」相关的业务知识\n\n## 结构（实体与关系）\n\n### payment（team）\n- eats lunch （来源：s1）\n\n### Late（team）\n\n关系：\n- Payment —knows→ Late\n\n## 相关原文片段（细节以原文为准）\n\n〔来源：任务 7〕\npayment lunch\n\n---\n\n---\n\n"
    facts = "\n### Payment（service）\n- calls orders （来源：Talk about pay）\n- is old （来源：MCP写入 (99天前⚠️)）\n- bare\n"
    a = "# 项目 `a` 与「payment」相关的业务知识\n\n## 结构（实体与关系）\n" + facts + "\n### Order Service（service）\n- stores rows （来源：代码 a/b.go）\n\n关系：\n- PAYMENT —calls→ order service\n\n## 相关原文片段（细节以原文为准）\n\n〔来源：Talk about pay〕\npayment retries\n\n---\n\n---\n\n"
    assert document(rows, 1) == retrieval.INTRO + b + a + retrieval.LEXICAL
    assert facts in document(rows, 2) and "Order" not in document(rows, 2) and "原文片段" not in document(rows, 2)
    assert document(rows, 3) == "在命名空间 [a _global_] 里没有查到和「nothing here」相关的知识。"
    cut = document(show(total=len((retrieval.INTRO + b).encode()), lexical=False), 1)
    assert cut == retrieval.INTRO + b + retrieval.CUT
    assert document(show(total=len((retrieval.INTRO + b).encode()) + 1, lexical=False), 1) == retrieval.INTRO + b + a


def test_matched_knowledge(spark, two_spaces):  # noqa: ANN001
    titles = spark.createDataFrame([("a", "s1", "Talk about pay")], "namespace string, id string, title string")
    found, context = retrieval.match_knowledge(*two_spaces, OWN, materialize=tables.materialize, titles=titles, now_ms=100 * 86_400_000)
    got = {(r["query_id"], r["namespace"]): r.asDict() for r in found.collect()}
    assert set(got) == {(1, "a"), (1, "b"), (2, "a"), (2, "b")}
    x = got[1, "a"]
    assert (x["names"], x["semantic_seeds"], x["keyword_hits"]) == (["Payment", "Order Service"], ["Payment"], ["Payment"])
    assert (x["sources"], x["chunk_hits"], x["method"], x["local"]) == (["Talk about pay", "MCP写入 (99天前⚠️)", "代码 a/b.go"], 1, "hybrid", True)
    x = got[2, "b"]
    assert (x["names"], x["semantic_seeds"], x["sources"], x["chunk_hits"], x["method"], x["local"]) == (["payment"], [], ["s1"], 0, "keyword", False)
    lines = {(r["section"], r["rank"]): r["text"] for r in context.where("query_id = 1 and namespace = 'a'").collect()}
    assert lines["structure", 2] == "\n【Order Service】\n- stores rows\n" and lines["chunks", 1] == "\n〔来源：Talk about pay〕\npayment retries\n───\n"


def test_match_query(spark):  # noqa: ANN001
    """Of the query over whole tables: methods and seeds agree with recall, and names stand in their namespace."""
    hits = defaultdict(set)
    for r in knowledge.recall(spark, DATA).where("kind = 'entity'").collect():
        hits[r["query_id"], r["namespace"]].add((r["id"], r["how"]))
    rows = knowledge.match_knowledge(spark, DATA).collect()
    assert {(r["query_id"], r["namespace"]) for r in rows} >= set(hits) and rows
    for r in rows:
        own = hits[r["query_id"], r["namespace"]]
        assert set(r["semantic_seeds"]) == {k for k, how in own if how & 1} and set(r["keyword_hits"]) == {k for k, how in own if how & 2}
        assert set(r["names"]) <= {k for k, _ in own}
        assert r["method"] == ("hybrid" if r["keyword_hits"] and (r["semantic_seeds"] or r["chunk_hits"]) else "semantic" if r["semantic_seeds"] or r["chunk_hits"] else "keyword")


@pytest.mark.parametrize("together", [1 << 21, 20, 1])
def test_contained_finds_parts_of_any_text(spark, together):  # noqa: ANN001
    texts = [(1, "the payment service"), (2, "日本語 service"), (3, ""), (4, "ab"), (5, None), (6, "s"), (4, "ab")]
    groups = [("a", ["service"], 1), ("b", ["日本", "zz"], 1), ("c", ["ab", "ab"], 1), ("d", ["zz", ""], 1), ("e", ["pay", "ment s", "nothing"], 2), ("f", ["service", "t s"], 2), ("g", [], 1)]
    got = retrieval.contained(spark.createDataFrame(groups, "key string, parts array<string>, need int"), spark.createDataFrame(texts, "id int, low string"), together, 8)
    assert rows_of(got) == sorted([("a", 1, 1), ("a", 2, 1), ("f", 1, 2), ("b", 2, 1), ("c", 4, 1), ("c", 4, 1), ("e", 1, 2)])
    assert retrieval.contained(spark.createDataFrame([], "key int, parts array<string>, need int"), spark.createDataFrame(texts, "id int, low string"), together).collect() == []


def test_contained_is_linear(spark):  # noqa: ANN001
    """One long text with one part many times."""
    groups = spark.createDataFrame([(k, ["ab", f"x{k}"], 1) for k in range(50)], "key int, parts array<string>, need int")
    began = time.time()
    assert retrieval.contained(groups, spark.createDataFrame([(1, "abc" * 1_000_000)], "id int, low string")).count() == 50
    assert time.time() - began < 30


def test_nearest_within_a_group(spark):  # noqa: ANN001
    q = spark.createDataFrame([(1, "a", [1.0, 0.0]), (2, "b", [1.0, 0.0]), (3, None, [1.0, 0.0])], "query_id int, g string, embedding array<double>")
    v = spark.createDataFrame([(10, "a", [1.0, 0.1]), (11, "b", [0.0, 1.0]), (12, "b", [2.0, 0.5]), (13, "c", [1.0, 0.0])], "id int, g string, embedding array<double>")
    assert [(r["query_id"], r["id"]) for r in embedding.nearest(q, v, 1, 0.2, within="g").orderBy("query_id").collect()] == [(1, 10), (2, 12)]
    assert [(r["query_id"], r["id"]) for r in embedding.nearest(q, v, 1, 0.2, a_block=1, together=1).orderBy("query_id").collect()] == [(1, 13), (2, 13), (3, 13)]


def test_near_duplicates_with_a_token_that_all_share(spark):  # noqa: ANN001
    rng = np.random.default_rng(4)
    rows = [(("a", "b")[i % 2], i, "common " + " ".join(f"w{x}" for x in rng.integers(0, 40, rng.integers(0, 8)))) for i in range(120)] + [("a", 900, "common"), ("a", 901, " "), ("a", 902, None), ("c", 903, "common")]
    df = spark.createDataFrame(rows, "k string, fact_id int, text string")
    bags = {i: (k, set((t or "").split())) for k, i, t in rows}
    want = {(i, j) for i, (k, x) in bags.items() for j, (m, y) in bags.items() if k == m and x and y and len(x & y) / len(x | y) >= 0.8 - 1e-12}
    got = retrieval.obs_near_dup_join(df, df, ["k"], materialize=tables.materialize).collect()
    assert sorted((r["fact_id"], r["other_id"]) for r in got) == sorted(want)


def test_near_duplicates_of_equal_facts_are_compared_once(spark):  # noqa: ANN001
    """4,000 equal facts make 16 million pairs, which are told, but not shuffled."""
    df = spark.range(4000).select(F.lit("a").alias("k"), F.col("id").alias("fact_id"), F.lit("large ring x1 steel").alias("text")).unionByName(spark.range(4000, 4010).select(F.lit("a").alias("k"), F.col("id").alias("fact_id"), F.lit("other").alias("text")))
    got = retrieval.obs_near_dup_join(df, df, ["k"], materialize=tables.materialize)
    began = time.time()
    assert got.groupBy("similarity").count().collect() == [(1.0, 4000 * 4000 + 100)]
    assert time.time() - began < 15


# Writing ----------------------------------------------------------------------------------


def embed(df, text: str):  # noqa: ANN001, ANN201
    """Vectors by first letters, so that a name and its rewording agree."""
    return df.withColumn("embedding", F.transform(F.array(*[F.lit(c) for c in "pqr"]), lambda c: F.when(F.startswith(F.lower(text), c), 1.0).otherwise(0.01).cast("float")))


def test_remember_resolves_writes(spark):  # noqa: ANN001
    facts = [("n", "Payment", ["calls the order service"]), ("m", "Quux", ["in another namespace"])]
    existing = embed(spark.createDataFrame(facts, "namespace string, name string, observations array<string>"), "name")
    writes = [
        ("n", " pay svc ", "", ["Calls the ORDER service!", "retries three times"]),  # a rewording and something new
        ("n", "Payments", "service", ["the service calls the order"]),  # the same tokens alone
        ("n", "quux", "", ["new here"]), ("n", "", "", ["nameless"]), ("n", "Rex", "", [" ", "Pipeline #12345"]), ("n", "quux", "", ["new here"]),
    ]
    got = streams.remember(spark.createDataFrame(writes, "namespace string, name string, type string, observations array<string>"), 7, existing, embed).collect()
    assert sorted((r["name"], r["type"], r["aliases"], r["observations"]) for r in got) == [("Payment", "concept", ["pay svc"], ["retries three times"]), ("quux", "concept", [], ["new here"])]
    assert all(r["record_id"].startswith("mcp:7-") for r in got)


def test_remember_query_against_brute_force(spark):  # noqa: ANN001
    told = {(r["name"], r["o"]) for r in knowledge._writes(spark, DATA).select("name", F.explode("observations").alias("o")).where(~T.is_snapshot_obs(F.col("o"))).collect()}
    known = knowledge._known(spark, DATA).collect()
    x = np.asarray([r["embedding"] for r in known], dtype=np.float64)
    x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
    want, matched = [], 0
    for name, fact in told:
        v = embedding.lexical_rows([f"{name} {fact}"])[0].astype(np.float32).astype(np.float64)
        scores = x @ (v / np.sqrt((v * v).sum()))
        best = int(np.argmax(scores))
        if scores[best] < 0.5:
            want.append((name, fact, 0))
            continue
        matched += 1
        own = set(tokens(fact))
        same = [set(tokens(o)) for o in known[best]["observations"]]
        if not any(own and s and len(own & s) / len(own | s) >= 0.8 for s in same):
            want.append((known[best]["name"], fact, int(known[best]["name"] != name)))
    rows = knowledge.remember(spark, DATA).collect()
    assert matched and len(want) < len(told)
    assert sorted((r["name"], r["fact"], r["aliases"]) for r in rows) == sorted(want)
    assert {r["type"] for r in rows} == {"concept"} and len({r["record_id"] for r in rows}) == len(rows)


def tokens(text: str) -> list[str]:
    """Han characters one by one, other letters and digits in runs."""
    return re.findall(r"[\u4e00-\u9fff]|[^\W_\u4e00-\u9fff]+", text.lower())


def test_resolve_entities_cases(spark):  # noqa: ANN001
    e = spark.createDataFrame([("x", "订单服务", [1.0, 0.0, 0.0], ["handles orders"])], "id string, name string, embedding array<double>, observations array<string>")
    rows = [(1, "OrderService", [], [0.99, 0.01, 0.0], ["handles orders", "stores rows"]), (2, "other", [], [0.0, 1.0, 0.0], ["handles orders"]), (3, "none", [], [], ["a fact"]), (4, "订单服务", ["o"], [1.0, 0.0, 0.0], ["Handles, orders"])]
    got = curation.resolve_entities(spark.createDataFrame(rows, "query_id int, name string, aliases array<string>, embedding array<double>, observations array<string>"), e).orderBy("query_id").collect()
    assert [(r["query_id"], r["name"], r["aliases"], r["observations"]) for r in got] == [(1, "订单服务", ["OrderService"], ["stores rows"]), (2, "other", [], ["handles orders"]), (3, "none", [], ["a fact"])]


def test_resolution_grows_with_facts_not_with_their_square(spark):  # noqa: ANN001
    """6,000 facts meet 6,000 of one entity: every third is told in other words."""
    e = spark.range(6000).select(F.lit("x").alias("id"), F.lit("X").alias("name"), F.array(F.lit(1.0)).alias("embedding"), F.concat(F.lit("the number "), "id").alias("o"))
    e = e.groupBy("id", "name", "embedding").agg(F.collect_list("o").alias("observations"))
    text = F.when(F.col("id") % 3 == 0, F.concat("id", F.lit(", The number!"))).otherwise(F.concat(F.lit("the number "), F.col("id") + 6000))
    rows = spark.range(6000).select(F.col("id").alias("query_id"), F.lit("X").alias("name"), F.array().cast("array<string>").alias("aliases"), F.array(F.lit(1.0)).alias("embedding"), F.array(text, F.lit("?")).alias("observations"))
    began = time.time()
    got = curation.resolve_entities(rows, e, materialize=tables.materialize).select("query_id", F.size("observations").alias("n")).collect()
    assert sorted((r["query_id"], r["n"]) for r in got) == [(i, 1 if i % 3 == 0 else 2) for i in range(6000)]
    assert time.time() - began < 40
