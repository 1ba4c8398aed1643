"""Periodic runs, quality rules and fill-in-the-middle against brute force and SQL, and their edge cases."""

from __future__ import annotations

import hashlib
import random
import re
import time
import zlib

import duckdb
import numpy as np
import oracle
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import common, fill_in_middle, jaccard_join, line_dedup, periodic_runs, quality_rules, registry

SCHEMA = "doc_id long, text string, lang string, source string, n_words string, runs int, kept string, form string, units string, key string, n long"
WORD = "[^\x20\x09-\x0d]+"
DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def corpus() -> list[tuple]:
    rng = random.Random(3)
    texts: list[str | None] = [None, "", " \n\t ", "one", "a\nb\n\nc", "\n", "a " * 3000, "x y\n" * 700, "日本 𝒳\n" * 40, "<P> a\nb", "<M", "Über über\x85\x1c dem\n" * 9, "ab cd ab cd ab cd ab cd ab cd ab cd z"]
    for _ in range(60):
        words = [rng.choice("the of and a to in is it on".split()) if rng.random() < 0.4 else "".join(rng.choice("abcde") for _ in range(rng.randint(1, 6))) for _ in range(rng.randint(1, 260))]
        at, p = rng.randrange(len(words)), rng.randint(1, 9)
        words[at:at] = words[at : at + p] * rng.randint(0, 6)
        texts.append("".join(w + rng.choice(("\n", " ", " ", " ", "  ")) for w in words))
    texts += ["### $$$ %%% " * 60 + "the of"] * 2
    rows = [(k * 3, t, "en" if k % 3 else None, "s", "clash", 1, "clash", "clash", "clash", "clash", 5) for k, t in enumerate(texts)]
    return [*rows, rows[5], rows[20], (None, *rows[21][1:])]


@pytest.fixture(scope="module")
def docs(spark, corpus):  # noqa: ANN001, ANN201
    return spark.createDataFrame(corpus, SCHEMA).repartition(3)


def rows_of(df) -> list[tuple]:  # noqa: ANN001
    return sorted((tuple(r) for r in df.collect()), key=repr)


# 11 ---------------------------------------------------------------------------------------


def all_runs(w: list, least: int = 12) -> list[tuple[int, int, int]]:
    """Every lag from end to end; of one stretch, the smallest period."""
    found: dict[tuple[int, int], int] = {}
    for d in range(1, len(w) // 2 + 1):
        i = d
        while i < len(w):
            began = i
            while i < len(w) and w[i] == w[i - d]:
                i += 1
            if i - began + d >= max(least, 2 * d) and i > began:
                found.setdefault((began - d, i - began + d), d)
            i += 1
    return sorted(((s, n, d) for (s, n), d in found.items()), key=lambda r: (r[0], r[2]))


def test_runs_of_random_words():
    rng = random.Random(1)
    for _ in range(1200):
        w = [rng.randrange(rng.choice((1, 2, 3, 8))) for _ in range(rng.randint(0, 90))]
        for _ in range(rng.randint(0, 3)):
            s, p, at = rng.randrange(len(w) + 1), rng.randint(1, 20), rng.randrange(len(w) + 1)
            w[at:at] = w[s : s + p] * rng.randint(2, 7)
        least = rng.choice((12, 12, 12, 1, 2, 5, 13))
        assert periodic_runs.runs_of(np.asarray(w, dtype=np.uint64), least) == all_runs(w, least), (w, least)


def test_runs_with_equal_hashes(monkeypatch):  # noqa: ANN001
    """Hashes choose where diagonals begin; with many that are equal the runs are the same."""
    real = periodic_runs.mix64
    monkeypatch.setattr(periodic_runs, "mix64", lambda x: real(x) % np.uint64(3))
    rng = random.Random(2)
    for _ in range(100):
        w = [rng.randrange(3) for _ in range(40)] * rng.randint(1, 3)
        assert periodic_runs.runs_of(np.asarray(w, dtype=np.uint64)) == all_runs(w)


@pytest.mark.parametrize("unit,times", [([0], 300_000), ([0, 0, 1], 100_000), ([0] * 300 + [1], 600), ([0] * 70_000 + [1], 2)])
def test_long_repetition_takes_linear_time(unit, times):  # noqa: ANN001
    began = time.time()
    runs = periodic_runs.runs_of(np.asarray(unit * times, dtype=np.uint64))
    assert (0, len(unit) * times, len(unit)) in runs
    assert time.time() - began < 20


def test_periodic_runs(docs, corpus):  # noqa: ANN001
    got = rows_of(periodic_runs.periodic_runs(docs))
    want = []
    for r in corpus:
        w = re.findall(WORD, r[1] or "")
        runs = all_runs(w)
        gone = {i for s, n, p in runs for i in range(s + p, s + n)}
        want.append((r[0], len(w), runs, " ".join(x for i, x in enumerate(w) if i not in gone)))
    assert sorted(((a, b, [tuple(x) for x in c], d) for a, b, c, d in got), key=repr) == sorted(want, key=repr)


def test_op11_against_brute_force(spark):  # noqa: ANN001
    want = []
    for doc, text in duckdb.sql(f"SELECT doc_id, text FROM '{DATA}/documents.parquet'").fetchall():
        w = re.findall(WORD, text or "")
        h = zlib.crc32(str(doc).encode())
        if h % 10 == 0 and w:
            g, n = h // 10, len(w)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        runs = all_runs(w)
        gone = {i for s, n, p in runs for i in range(s + p, s + n)}
        best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=None)
        digest = [hashlib.sha256(x.encode()).hexdigest() for x in ("".join(f"{s},{n},{p}\n" for s, n, p in runs), " ".join(x for i, x in enumerate(w) if i not in gone))]
        want.append((doc, len(runs), *((*best, 1000 * best[1] // best[2]) if best else (None,) * 4), *digest))
    assert rows_of(periodic_runs.op11_periodic_runs(spark, DATA)) == sorted(want, key=repr)


# 12 ---------------------------------------------------------------------------------------


def test_base_counts(docs, corpus):  # noqa: ANN001
    got = rows_of(quality_rules.quality_rules(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"))
    want = []
    for r in corpus:
        t = r[1] or ""
        w = re.findall(WORD, t)
        windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        inside = {i + k for i, x in enumerate(windows) if windows.count(x) > 1 for k in range(3)} if len(windows) < 400 or len(set(windows)) > 20 else set(range(len(w)))
        lines = [x for x in t.split("\n") if re.search(WORD, x)]
        want.append((r[0], len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(inside), len(w) < 50 or 100 * len(inside) > 50 * len(w)))
    assert got == sorted(want, key=repr)


def test_common_words_are_exact(docs, corpus):  # noqa: ANN001
    known = quality_rules.references(docs, quality_rules.Rules(common_share=1 / 50))
    for lang in ("en", ""):
        every = [w for r in corpus if (r[2] or "") == lang for w in re.findall(WORD, (r[1] or "").lower())]
        want = {w for w in set(every) if every.count(w) >= len(every) / 50}
        classes, bins, counts = known[lang]
        assert set(bins) == want
        assert counts.sum() == len(every)
        assert classes.sum() == sum(len(r[1] or "") for r in corpus if (r[2] or "") == lang)


def test_distance_and_verdict(spark):  # noqa: ANN001
    a, b = np.asarray([1.0, 1, 0]), np.asarray([0.0, 0, 5])
    assert quality_rules.distance(a, a * 7) == 0
    assert quality_rules.distance(a, b) == pytest.approx(1)
    assert quality_rules.distance(np.asarray([1.0, 0]), np.asarray([1.0, 1])) == pytest.approx(((1 * np.log2(1 / 0.75) + 0.5 * np.log2(0.5 / 0.75) + 0.5 * np.log2(0.5 / 0.25)) / 2) ** 0.5)
    rng = random.Random(4)
    rare = lambda: "".join(rng.choice("abcdefgh") for _ in range(8))
    plain = lambda: " ".join(rng.choice("the of and a to in is it on".split()) if rng.random() < 0.4 else rare() for _ in range(200))
    rows = [(k, plain(), "en") for k in range(80)] + [(100, plain().upper(), "en"), (101, plain().replace(" ", "### "), "en"), (102, " ".join(rare() for _ in range(300)), "en"), (103, plain(), "xx"), (104, "the of", "en")]
    got = {r["doc_id"]: r for r in quality_rules.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string"), quality_rules.Rules(language_share=0.02)).collect()}
    assert all(got[k]["kept"] for k in range(80))
    assert not any(got[k]["kept"] for k in (100, 101, 102, 104))
    assert got[103]["kept"] and got[103]["word_distance"] is None  # too little of that language to judge by
    assert got[104]["base_failed"] and got[104]["class_distance"] is None


# 13 ---------------------------------------------------------------------------------------


@pytest.mark.parametrize("fan", [2, 3, 16])
def test_skip_list_reaches_every_rank(spark, fan):  # noqa: ANN001
    rng = random.Random(fan)
    rows = [(n, "".join("é𝒳a"[rng.randrange(3)] * rng.randint(0, 3) + "\n" for _ in range(n))) for n in (0, 1, 2, 15, 16, 17, 60, 256, 257)]
    d = spark.createDataFrame(rows, "n int, text string").withColumn("units", F.regexp_extract_all("text", F.lit(fill_in_middle.UNIT), F.lit(0)))
    d = d.withColumn("lanes", fill_in_middle.skip_list(F.col("units"), fan)).withColumn("rank", F.explode(F.sequence(F.lit(0), F.col("n"))))
    got = d.select("n", "rank", fill_in_middle.chars_before(F.col("lanes"), F.col("rank"), fan).alias("chars"), F.size(F.element_at("lanes", -1)).alias("top")).collect()
    texts = dict(rows)
    for r in got:
        assert r["chars"] == sum(len(x) for x in texts[r["n"]].splitlines(keepends=True)[: r["rank"]]), r
        assert r["top"] <= fan
    assert len(got) == sum(n + 1 for n, _ in rows)


def test_fill_in_middle(docs, corpus):  # noqa: ANN001
    d = fill_in_middle.fill_in_middle(docs)
    got = d.withColumn("back", fill_in_middle.restore(F.col("output"), F.col("form"))).collect()
    texts = {r[0]: r[1] or "" for r in corpus}
    assert len(got) == len(corpus)
    for r in got:
        t, units = texts[r["doc_id"]], re.findall(r"[^\n]*\n|[^\n]+", texts[r["doc_id"]])
        key = hashlib.sha256(f"7:{'' if r['doc_id'] is None else r['doc_id']}".encode()).hexdigest()
        h = [int(key[8 * k : 8 * k + 8], 16) for k in range(4)]
        low, high = sorted(x % (len(units) + 1) for x in h[:2])
        a, b, c = ("".join(x) for x in (units[:low], units[low:high], units[high:]))
        form = "plain" if not t or any(m in t for m in ("<P>", "<S>", "<M>")) else "spm" if h[3] % 100 < 50 else "psm"
        want = {"plain": t, "psm": f"<P>{a}<S>{c}<M>{b}", "spm": f"<S>{c}<P>{a}<M>{b}"}[form]
        assert (r["n"], r["form"], r["output"], r["back"]) == (len(units), form, want, t)
        assert (r["prefix_chars"], r["middle_chars"]) == ((None, None) if form == "plain" else (len(a), len(b)))


def test_rates(docs):  # noqa: ANN001
    assert {r["form"] for r in fill_in_middle.fill_in_middle(docs, rate=0).collect()} == {"plain"}
    assert {r["form"] for r in fill_in_middle.fill_in_middle(docs, spm=100).collect()} == {"plain", "spm"}


# All --------------------------------------------------------------------------------------


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_same_as_sql(spark, name):  # noqa: ANN001
    assert oracle.compare(registry.QUERIES[name](spark, DATA), oracle.connect(DATA), registry.ORACLE_SQL[name]) == ""


def test_empty_tables(spark):  # noqa: ANN001
    empty = spark.createDataFrame([], SCHEMA)
    for f in (periodic_runs.periodic_runs, quality_rules.quality_rules, fill_in_middle.fill_in_middle):
        assert f(empty).collect() == []
    null_only = spark.createDataFrame([(None, None, None)], "doc_id long, text string, lang string")
    assert quality_rules.quality_rules(null_only).select("n_words", "kept").collect() == [(0, False)]
    assert periodic_runs.periodic_runs(null_only).select("n_words", F.size("runs"), "collapsed").collect() == [(0, 0, "")]
    assert fill_in_middle.fill_in_middle(null_only).select("form", "output").collect() == [("plain", "")]


# Hashes -----------------------------------------------------------------------------------


def thue_morse(n: int, flipped: bool) -> str:
    """2**n letters; with its complement, equal under every polynomial modulo a power of two."""
    x = np.zeros(1, dtype=np.int8)
    for _ in range(n):
        x = np.concatenate([x, 1 - x])
    return "".join("ba"[v] if flipped else "ab"[v] for v in x.tolist())


@pytest.mark.parametrize("n", [10, 11, 14])
def test_hashes_tell_thue_morse_words_apart(n):  # noqa: ANN001
    texts = [thue_morse(n, flipped).encode() for flipped in (False, True)]
    buf = np.frombuffer(b"".join(texts), dtype=np.uint8)
    a, b = common.Substrings(buf)(np.asarray([0, 1 << n]), np.asarray([1 << n, 2 << n]))
    assert a != b
    assert len(set(common.word_hashes(texts)[0].tolist())) == 2


def test_substring_hashes_depend_on_content_alone():
    rng = np.random.default_rng(5)
    buf = rng.integers(97, 99, 400).astype(np.uint8)
    start, end = (x.ravel() for x in np.meshgrid(np.arange(0, 60), np.arange(0, 60)))
    start, end = np.minimum(start, end), np.maximum(start, end)
    by_hash, by_text = {}, {}
    for s, e, h in zip(start.tolist(), end.tolist(), common.Substrings(buf)(start, end).tolist(), strict=True):
        text = buf[s:e].tobytes()
        assert by_hash.setdefault(h, text) == text and by_text.setdefault(text, h) == h


def test_lines_and_documents_that_occur_once_stay(spark):  # noqa: ANN001
    one, two = thue_morse(11, False), thue_morse(11, True)
    docs = spark.createDataFrame([(1, one, "en"), (2, two, "en"), (3, " ".join([one] * 5), "en"), (4, " ".join([two] * 5), "en")], "doc_id long, text string, lang string")
    assert {r["doc_id"]: r["text"] for r in line_dedup.dedup_runs(docs).collect()} == {r["doc_id"]: r["text"] for r in docs.collect()}
    assert sorted(r["doc_id"] for r in jaccard_join.drop_near_copies(docs).collect()) == [1, 2, 3, 4]
