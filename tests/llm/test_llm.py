"""The operators against brute force on small tables, and their edge cases."""

from __future__ import annotations

import hashlib
import random
import re
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import byte_bpe, common, hilbert_search, jaccard_join, line_dedup, media, packing, pseudonyms, quality, suffix_dedup, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, rk string, state int"


def words(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7))) for _ in range(n))


@pytest.fixture(scope="module")
def corpus() -> list[tuple]:
    """Copies, near copies, shared passages, repeated lines, empty, null and long texts, equal rows, a row without id."""
    rng = random.Random(5)
    base = [words(rng, 150) for _ in range(6)]
    passage = words(rng, 120)
    texts: list[str | None] = []
    for b in base:
        texts += [b, b, b.upper()]
        for _ in range(4):
            w = b.split()
            for _ in range(rng.randint(1, 9)):
                w[rng.randrange(len(w))] = "zzz"
            texts.append(" ".join(w))
    texts += [words(rng, rng.randint(5, 60)) + "\n" + passage + "\n" + words(rng, 20) for _ in range(12)]
    lines = [words(rng, 12) for _ in range(5)]
    texts += ["\n".join([words(rng, 9), *lines[k % 3 : k % 3 + 3], words(rng, 9)]) for k in range(8)]
    texts += ["", None, " \n\t ", "one two", "One\tTwo", "a" * 3000, "In. " * 400, "x\n" * 300, words(rng, 4000), "日本語のテキスト İstanbul ΣΑΣ", "\x1c\x1d mixed\x85"]
    rows = [(i * 3 + 1, t, "en", f"s{i % 3}", len(t or ""), "clash", 1) for i, t in enumerate(texts)]
    return rows + [rows[0], rows[-3], (None, base[0], None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark, corpus):  # noqa: ANN001, ANN201
    return spark.createDataFrame(corpus, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):  # noqa: ANN001, ANN201
    return spark.createDataFrame([], SCHEMA)


def rows_of(df) -> list[tuple]:  # noqa: ANN001
    return sorted((tuple(r) for r in df.collect()), key=repr)


# 3 ----------------------------------------------------------------------------------------


def shingles(text: str | None) -> frozenset:
    w = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute_components(corpus: list[tuple]) -> list[tuple]:
    sets = [shingles(r[1]) for r in corpus]
    root = list(range(len(corpus)))

    def find(x: int) -> int:
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                root[find(i)] = find(j)
    smallest: dict[int, int] = {}
    for i, r in enumerate(corpus):
        if r[0] is not None:
            smallest[find(i)] = min(smallest.get(find(i), 1 << 62), r[0])
    return sorted(((r[0], len(s), smallest.get(find(i)) if s else r[0]) for i, (r, s) in enumerate(zip(corpus, sets, strict=True))), key=repr)


def test_jaccard_components(docs, corpus, empty):  # noqa: ANN001
    got = rows_of(jaccard_join.jaccard_components(docs).drop("class_id"))
    assert got == brute_components(corpus)
    assert not jaccard_join.jaccard_components(empty).count()


def test_drop_near_copies_keeps_one_of_each(docs, corpus):  # noqa: ANN001
    kept = jaccard_join.drop_near_copies(docs)
    assert kept.columns == docs.columns
    want = {r[2] for r in brute_components(corpus) if r[0] is not None}
    got = [r["doc_id"] for r in kept.collect() if r["doc_id"] is not None]
    assert set(got) == want and len(got) == len(set(got)) + sum(1 for t in Counter(got).values() if t > 1)


def test_jaccard_links_are_counted_per_class(docs, corpus, empty):  # noqa: ANN001
    sets = {shingles(r[1]) for r in corpus} - {frozenset()}
    links = {a: sum(100 * len(a & b) >= 80 * len(a | b) for b in sets) - 1 for a in sets}
    want = sorted((str(r[0]), links.get(shingles(r[1]), 0)) for r in corpus)
    got = jaccard_join.jaccard_components(docs, links=True).collect()
    assert sorted((str(r["doc_id"]), r["n_links"]) for r in got) == want and max(links.values()) >= 3
    kinds = defaultdict(set)
    for r in got:
        kinds[r["class_id"]].add(r["n_links"])
    assert len(kinds) == len(sets) + 1 and all(len(k) == 1 for k in kinds.values())
    assert not jaccard_join.jaccard_components(empty, links=True).count()


def test_link_counts_over_blocks(spark):  # noqa: ANN001
    rng = random.Random(12)
    base = words(rng, 90).split()
    texts = []
    for _ in range(70):  # one family, not all of whose members link
        w = list(base)
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(len(w))] = "zz" + str(rng.randint(0, 9))
        texts.append(" ".join(w))
    sets = list({shingles(t) for t in texts})
    links = {a: sum(100 * len(a & b) >= 80 * len(a | b) for b in sets) - 1 for a in sets}
    assert len(set(links.values())) > 3
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    signs, named, read = jaccard_join._joined(df, 5, 80, 1 << 18)
    for block in (8, 1000):
        n = {r["ck"]: r["n_links"] for r in jaccard_join._link_counts(named.select("ck", "root"), read, 5, 80, block).collect()}
        got = sorted((r["doc_id"], n.get(r["ck"], 0)) for r in signs.collect())
        assert got == [(i, links[shingles(t)]) for i, t in enumerate(texts)]


def test_a_large_family_is_linked_through_few_pairs(spark, monkeypatch):  # noqa: ANN001
    rng = random.Random(21)
    base = words(rng, 150).split()
    texts = []
    for i in range(900):
        w = list(base)
        for k in range(rng.randint(0, 4)):
            w[rng.randrange(len(w))] = f"u{i}.{k}"
        texts.append(" ".join(w))
    made = Counter()

    def counted(df, name="t"):  # noqa: ANN001, ANN202
        out = materialize(df, name)
        made[name] += out.count() if name in ("pairs", "edges") else 0
        return out

    materialize = common.materialize
    for module in (common, jaccard_join):
        monkeypatch.setattr(module, "materialize", counted)
    rows = list(enumerate(texts))
    got = rows_of(jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).drop("class_id"))
    assert got == brute_components(rows)
    classes = len(set(texts))
    assert made["pairs"] <= 5 * classes and made["edges"] <= 8 * classes


def test_near_copies_with_a_shared_doc_id(spark):  # noqa: ANN001
    rng = random.Random(6)
    a, b, c = (words(rng, 60) for _ in range(3))
    rows = [(7, a, "x"), (7, b, "x"), (7, b, "y"), (9, a, "z"), (None, c, None), (None, a, None), (7, None, "n"), (7, "", "n"), (8, "", "n")]
    df = spark.createDataFrame(rows, "doc_id long, text string, rk string").withColumn("d", F.lit(1)).withColumn("keeps", F.lit(None).cast("string"))
    kept = jaccard_join.drop_near_copies(df)
    assert kept.columns == df.columns
    assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=repr) == sorted([(7, a), (7, b), (None, c), (7, None), (7, ""), (8, "")], key=repr)


def test_parity_sketch_never_exceeds_the_difference():
    rng = np.random.default_rng(1)
    for _ in range(50):
        a = np.unique(rng.integers(0, 1 << 63, rng.integers(1, 400), dtype=np.uint64))
        b = np.unique(np.concatenate([a[rng.random(len(a)) < 0.7], rng.integers(0, 1 << 63, rng.integers(1, 90), dtype=np.uint64)]))
        assert jaccard_join.sketch_distance(jaccard_join.parity_sketch(a), jaccard_join.parity_sketch(b)) <= len(np.setxor1d(a, b))


# 6 ----------------------------------------------------------------------------------------


def test_suffix_dedup(docs, corpus, empty):  # noqa: ANN001
    texts = [(r[1] or "").encode() for r in corpus]
    seen = Counter(t[i : i + 400] for t in texts for i in range(len(t) - 399))
    want = []
    for r, t in zip(corpus, texts, strict=True):
        gone = np.zeros(len(t), dtype=bool)
        for i in range(len(t) - 399):
            if seen[t[i : i + 400]] > 1:
                gone[i : i + 400] = True
        runs = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        want.append((r[0], len(t), int(gone.sum()), runs, np.frombuffer(t, dtype=np.uint8)[~gone].tobytes()))
    plain = lambda rows: sorted((str(r[0]), *r[1:4], bytes(r[4])) for r in rows)
    got = suffix_dedup.remove_repeats(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept").collect()
    assert plain(got) == plain(want)
    assert not suffix_dedup.remove_repeats(empty).count()


def test_split_anchors_find_the_same(docs):  # noqa: ANN001
    plain, split = (suffix_dedup.repeated_stretches(docs.select("doc_id", "text"), hot=h) for h in (2000, 1))
    cover = lambda df: {(r["rk"], i) for r in df.collect() for i in range(r["lo"], r["hi"] + 1)}
    assert cover(plain) == cover(split)


def brute_passages(texts: list[str | None], n: int) -> list[list[tuple[int, int]]]:
    found = [[(m.start(), m.end()) for m in re.finditer(rb"[^\x20\x09-\x0d]+", (t or "").encode())] for t in texts]
    runs = [[(w[i][0], w[i + n - 1][1]) for i in range(len(w) - n + 1)] for w in found]
    seen = Counter((t or "").encode()[a:b] for t, r in zip(texts, runs, strict=True) for a, b in r)
    out = []
    for t, r in zip(texts, runs, strict=True):
        covered: list[tuple[int, int]] = []
        for a, b in r:
            if seen[(t or "").encode()[a:b]] > 1:
                covered[-1:] = [(covered[-1][0], b)] if covered and a <= covered[-1][1] else [*covered[-1:], (a, b)]
        out.append(covered)
    return out


def test_passages_shorter_than_a_stretch_are_found(spark, corpus):  # noqa: ANN001
    rng = random.Random(12)
    short = [" ".join(rng.choice(["to", "be", "or", "not", "só", "x1"]) for _ in range(n)) for n in (50, 51, 57)]
    texts = [r[1] for r in corpus]
    texts += [f"{words(rng, 30)} {p} {words(rng, 20)}" for p in short for _ in range(3)]
    texts += [words(rng, 9) + "\n" + short[2] + tail for tail in ("", "s", "\n", " z")]  # a word that goes on is another word
    texts += [short[1], short[1].replace(" ", "  ", 1), "b " * 50 + "b", "b " * 51 + "b", " ".join(words(rng, 2) for _ in range(30))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    want = brute_passages(texts, 51)
    at = next(k for k, t in enumerate(texts) if t and short[2] in t)
    assert want[at] and max(b - a for a, b in want[at]) < 400 and not any(want[k] for k, t in enumerate(texts) if t and short[0] in t)
    got = {r["doc_id"]: r for r in suffix_dedup.remove_repeats(df, passage=51).collect()}
    assert [[tuple(x) for x in got[k]["passages"]] for k in range(len(texts))] == want
    assert not got[at]["n_removed"]  # they are told, not removed
    plain = suffix_dedup.remove_repeats(df).drop("passages")
    assert rows_of(plain) == rows_of(suffix_dedup.remove_repeats(df, passage=51).drop("passages"))
    one, split = (suffix_dedup.repeated_stretches(df, hot=h, passage=51).where("words") for h in (2000, 1))
    cover = lambda df: {(r["rk"], i) for r in df.collect() for i in range(r["lo"], r["hi"] + 400)}
    assert cover(one) == cover(split)


def test_passages_of_texts_beyond_one_piece(spark):  # noqa: ANN001
    long = " ".join(map(str, range(1_300_000)))  # 9 MB
    w = long.split()
    cut = long[: 8 << 20].count(" ")  # the word in which the first piece ends
    short = " ".join(w[cut - 30 : cut + 40])
    df = spark.createDataFrame([(1, long), (2, "q " + short + " q"), (3, " ".join(w[-51:])), (4, " ".join(w[-50:]))], "doc_id long, text string")
    got = {r["doc_id"]: [tuple(x) for x in r["passages"]] for r in suffix_dedup.remove_repeats(df, passage=51).select("doc_id", "passages").collect()}
    a = long.index(short)
    assert got == {1: [(a, a + len(short)), (len(long) - len(" ".join(w[-51:])), len(long))], 2: [(2, 2 + len(short))], 3: [(0, len(" ".join(w[-51:])))], 4: []}


def test_shards_without_repeats_have_the_same_columns():
    rng = random.Random(3)
    rows = [(f"{k}.0", k, 0, 0, True, 1, False, words(rng, 200).encode()[:400]) for k in range(2)] + [("7.0", 9, 0, 0, True, 1, True, words(rng, 51).encode())]
    names = ["shard", "rk", "lo", "hi", "single", "splits", "words", "bytes"]
    batch = pa.RecordBatch.from_pydict(dict(zip(names, map(list, zip(*rows, strict=True)), strict=True)))
    out = list(suffix_dedup._in_shards(400, 51)(iter([batch])))
    assert len(out) == 2 and out[0].schema == out[1].schema and out[0].schema.field("words").type == pa.bool_() and not sum(map(len, out))


def test_suffix_array_and_prefixes():
    rng = np.random.default_rng(3)
    buf = rng.integers(97, 99, 600).astype(np.uint8)
    buf[300:500] = buf[50:250]
    order, _ = suffix_dedup.suffix_array(buf, 64)
    text = buf.tobytes()
    keys = [text[i : i + 64] for i in order]
    assert keys == sorted(keys) and sorted(order) == list(range(600))
    lcp = suffix_dedup.common_prefixes(buf, order, np.asarray([0]), np.asarray([600]), 64)
    for k in range(1, 600):
        a, b = text[order[k - 1] :], text[order[k] :]
        n = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
        assert lcp[k] == min(64, n)


def test_jaccard_links_sizes_far_apart_below_80_percent(spark):  # noqa: ANN001
    rng = random.Random(4)
    w = words(rng, 118).split()
    texts = [" ".join(w[:64]), " ".join(w)]  # 60 and 114 shingles
    # texts of sizes between the two hold every shingle of the shorter one, a third each, and link with neither
    texts += [" ".join(w[k : k + 24]) + " " + words(rng, 64) for k in (0, 20, 40)]
    sets = [shingles(t) for t in texts]
    links = {(i, j) for j in range(5) for i in range(j) if 2 * len(sets[i] & sets[j]) >= len(sets[i] | sets[j])}
    assert links == {(0, 1)} and sets[0] <= sets[2] | sets[3] | sets[4]
    rows = [(i + 1, t, None, None, None, None, None) for i, t in enumerate(texts)]
    got = jaccard_join.jaccard_components(spark.createDataFrame(rows, SCHEMA), percent=50)
    assert rows_of(got.select("doc_id", "component_id")) == [(1, 1), (2, 1), (3, 3), (4, 4), (5, 5)]


# 7 ----------------------------------------------------------------------------------------


def test_line_dedup(docs, corpus, empty):  # noqa: ANN001
    order = sorted(range(len(corpus)), key=lambda i: (corpus[i][0] is None, corpus[i][0] or 0))
    seen: set = set()
    want = []
    for i in order:
        text = corpus[i][1]
        lines = (text or "").split("\n")
        drop = [False] * len(lines)
        for k in range(len(lines) - 1):
            pair = (lines[k], lines[k + 1])
            if len("\n".join(pair).encode()) >= 60:
                if pair in seen:
                    drop[k] = drop[k + 1] = True
                seen.add(pair)
        want.append((corpus[i][0], None if text is None else "\n".join(x for x, d in zip(lines, drop, strict=True) if not d)))
    out = line_dedup.dedup_lines(docs)
    assert rows_of(out.select("doc_id", "text")) == sorted(want, key=repr)
    assert out.columns[: len(docs.columns)] == docs.columns
    assert out.where("longest_run >= 2").count() and not line_dedup.dedup_lines(empty).count()


def test_line_dedup_whole_runs(spark, docs, corpus, empty):  # noqa: ANN001
    rng = random.Random(8)
    short = [words(rng, 2)[:14] for _ in range(40)]  # runs of short lines, of all lengths, that differ after a while
    texts = ["\n".join([words(rng, 6), *short[k % 7 : k % 7 + rng.randint(3, 30)], words(rng, 6)]) for k in range(24)]
    texts += ["\n".join(rng.choice("ab") * 9 for _ in range(rng.randint(8, 60))) for _ in range(14)]
    texts += ["\n".join([words(rng, 3), long, words(rng, 3)]) for long in [words(rng, 60)] * 3]
    more = [(1000 + i, t, "en", "s", len(t), "clash", 1) for i, t in enumerate(texts)]
    every = corpus + more + more[:1]
    order = sorted(range(len(every)), key=lambda i: (every[i][0] is None, every[i][0] or 0))
    places: dict = defaultdict(list)
    for i in order:
        lines = (every[i][1] or "").split("\n")
        for k in range(len(lines)):
            for to in range(k + 1, len(lines) + 1):
                run = "\n".join(lines[k:to])
                if len(run.encode()) >= 60:
                    places[to - k, hash(run)].append((i, k))
    drop = {i: [False] * len((every[i][1] or "").split("\n")) for i in order}
    longest: dict = dict.fromkeys(order)
    for (n, _), at in places.items():
        for nth, (i, k) in enumerate(at):
            if len(at) > 1:
                longest[i] = max(longest[i] or 0, n)
            if nth:
                drop[i][k : k + n] = [True] * n
    want = [(every[i][0], None if every[i][1] is None else "\n".join(x for x, d in zip(every[i][1].split("\n"), drop[i], strict=True) if not d), longest[i]) for i in order]
    both = docs.unionByName(spark.createDataFrame(more + more[:1], SCHEMA))
    assert rows_of(line_dedup.dedup_runs(both).select("doc_id", "text", "longest_run")) == sorted(want, key=repr)
    assert not line_dedup.dedup_runs(empty).count()
    both.select("doc_id", "text").write.mode("overwrite").parquet(path := f"{common.shared_dir(spark)}/whole-runs/documents.parquet")
    got = line_dedup.op7_line_dedup(spark, path.rsplit("/", 1)[0]).select("doc_id", "longest_run", "kept_sha256")
    assert rows_of(got) == sorted(((d, n, hashlib.sha256((t or "").encode()).hexdigest()) for d, t, n in want), key=repr)


def test_line_dedup_with_clashing_columns(spark):  # noqa: ANN001
    a, b, c = ("a" * 40, "b" * 40, "c" * 40)
    rows = [(1, f"{a}\n{b}"), (2, f"{b}\n{c}"), (3, f"{a}\n{b}\n{c}"), (3, f"{a}\n{b}\n{c}"), (4, f"x\n{c}\ny"), (5, ""), (6, None), (7, f"{c}\n{a}")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    names = ["_cuts", "_nth", "_rk", "rk", "nth", "places", "sizes", "longest", "c0", "name", "uid", "N_runs"]
    df = df.withColumns({c: F.lit(c) for c in names})
    for f in (line_dedup.dedup_runs, line_dedup.dedup_lines):
        out = f(df)
        assert out.columns == [*[c for c in df.columns if c != "N_runs"], "n_lines", "n_deleted", "n_runs", "longest_run"]
        got = out.collect()
        assert all(r[c] == c for r in got for c in names[:-1]) and len(got) == len(rows)
        assert sorted((r["doc_id"], r["text"], r["n_deleted"]) for r in got if r["text"] is not None) == [(1, rows[0][1], 0), (2, rows[1][1], 0), (3, "", 3), (3, "", 3), (4, rows[4][1], 0), (5, "", 0), (7, rows[7][1], 0)]
        assert {r["longest_run"] for r in got if r["doc_id"] == 3} == {3} and {r["n_lines"] for r in got if r["doc_id"] == 6} == {0}


def test_hot_lines_and_many_equal_rows(spark):  # noqa: ANN001
    hot = "h" * 70
    rows = [(i, f"{hot}\n{i}\n\n\n{hot}") for i in range(300)] + [(5, "q" * 90)] * 50
    out = line_dedup.dedup_runs(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter(r["text"] for r in out if "q" in (r["text"] or "")) == {"q" * 90: 1} and sum(r["text"] == "" for r in out) == 49
    assert sorted(r["text"] for r in out if r["n_lines"] == 5) == sorted(f"{hot}\n0\n\n" if i == 0 else str(i) for i in range(300))  # the empty lines and the hot one are a run


# 10 ---------------------------------------------------------------------------------------


def test_packing(docs, corpus, empty):  # noqa: ANN001
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    ids = {}
    for r in corpus:
        ids.setdefault(r[0], []).append([*tokenizer.encode(r[1] or "", add_special_tokens=False).ids, 1])
    pieces = [r.asDict() for r in packing.pack(docs, path, window=64).collect()]
    assert sum(p["length"] for p in pieces) == sum(len(x) for xs in ids.values() for x in xs)
    for p in pieces:
        crcs = {zlib.crc32(struct.pack(f"<{p['length']}I", *x[p["start"] : p["start"] + p["length"]])) for x in ids[p["doc_id"]] if len(x) == p["doc_tokens"]}
        assert p["ids_crc32"] in crcs
    by_sequence = defaultdict(list)
    for p in pieces:
        by_sequence[p["sequence_id"]].append((p["offset"], p["length"]))
    full = 0
    for found in by_sequence.values():
        at = 0
        for offset, length in sorted(found):
            assert offset == at
            at += length
        full += at == 64
        assert at <= 64
    assert full >= len(by_sequence) - 1
    assert not packing.pack(empty, path).count()


# 4 ----------------------------------------------------------------------------------------


def test_byte_bpe(docs, corpus, empty):  # noqa: ANN001
    import tiktoken

    path = P.path("byte_bpe_50k.tiktoken")
    encoding = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=byte_bpe.load_ranks(path), special_tokens={})
    want = []
    for r in corpus:
        ids = encoding.encode_ordinary(r[1] or "")
        want.append((r[0], bytearray(struct.pack(f"<{len(ids)}I", *ids)), bytearray((r[1] or "").encode())))
    for frequent in (0, 40, 1 << 17):
        got = byte_bpe.encode(docs, path, P.PATTERN, frequent)
        assert sorted((tuple(map(str, (r[0], bytes(r[1]), bytes(r[2])))) for r in got.collect())) == sorted(tuple(map(str, (w[0], bytes(w[1]), bytes(w[2])))) for w in want)
    assert not byte_bpe.encode(empty, path, P.PATTERN).count()


def test_frequent_words_end_at_a_count(spark):  # noqa: ANN001
    text = " ".join(f"w{i}x" for i in range(1, 40) for _ in range(i))
    df = spark.createDataFrame([(text,)], "text string")
    for most in (0, 1, 6, 1000):
        got = {r["word"].strip() for r in byte_bpe.frequent_words(df, P.PATTERN, most).collect()}
        assert len(got) <= most and (most < 6 or got)


def test_words_beyond_latin_are_split_alike():
    import tiktoken

    path = P.path("byte_bpe_50k.tiktoken")
    encoding = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=byte_bpe.load_ranks(path), special_tokens={})
    own = byte_bpe.Words({" the": np.asarray(encoding.encode_ordinary(" the"), dtype="<u4").tobytes()}, path, P.PATTERN)
    rng = random.Random(2)
    marks = " \n\t.,'s’—“”€日本語ΣΑΣ\u2003\x1c\u0301\U0001f600½Ⅷ٣aé"
    for _ in range(2000):
        text = " the" + "".join(rng.choice(marks) for _ in range(rng.randint(0, 40))) + " the’s"
        assert own.encode(text) == np.asarray(encoding.encode_ordinary(text), dtype="<u4").tobytes()
    assert own.decode(own.encode(text)) == text.encode()


def test_folded_words_are_the_tokenizers(spark, corpus):  # noqa: ANN001
    import tiktoken

    path = P.path("byte_bpe_50k.tiktoken")
    encoding = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=byte_bpe.load_ranks(path), special_tokens={})
    some = sorted({w for r in corpus for w in (r[1] or "").split(" ") if 0 < len(w.encode()) <= 40})[:300]
    encoder = byte_bpe.Encoder(byte_bpe.load_ranks(path))
    got = spark.createDataFrame([(w,) for w in some], "word string").select("word", encoder.fold(F.col("word")).alias("ids")).collect()
    assert {r["word"]: r["ids"] for r in got} == {w: encoding._encode_single_piece(w) for w in some}


# 8 ----------------------------------------------------------------------------------------


def test_hilbert_search(spark):  # noqa: ANN001
    rng = np.random.default_rng(2)
    x = rng.normal(size=(900, 16))
    x[100:160] = x[0]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(5000, None), (5050, [0.0] * 16), (5100, [float("nan")] * 16), (5150, [None, *[1.0] * 15]), (None, [1.0] * 16), (5200, []), (5250, [1.0, 2.0]), (5251, [2.0, 4.0]), rows[3]]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = defaultdict(list)
    for r in hilbert_search.nearest(df, every=50, k=5).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    assert set(got) == {*range(0, 900, 50), 5250}
    assert [v for v, _ in got[5250]] == [5251]
    for q in range(0, 900, 50):
        s = hilbert_search.cosine(x[q], x)
        s[q] = -9
        want = np.lexsort((np.arange(900), -s))[:5]
        assert [v for v, _ in got[q]] == want.tolist()
        assert np.allclose([s_ for _, s_ in got[q]], (unit @ unit[q])[want])


def test_recall_through_windows(spark):  # noqa: ANN001
    rng = np.random.default_rng(4)
    x = rng.normal(size=(6000, 32))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    got = defaultdict(set)
    for r in hilbert_search.nearest(df, every=100, ranges=12, beside=2).collect():
        got[r["query_id"]].add(r["vec_id"])
    hit = 0
    for q in range(0, 6000, 100):
        s = unit @ unit[q]
        s[q] = -9
        hit += len(got[q] & set(np.argsort(-s)[:5].tolist()))
    assert hit / 300 >= 0.9


@pytest.mark.parametrize("kind", ["even", "clustered", "hot"])
def test_recall_of_the_defaults(spark, kind):  # noqa: ANN001
    rng = np.random.default_rng(11)
    n = 8000
    x = rng.normal(size=(n, 24))
    if kind != "even":
        x = rng.normal(size=(60, 24))[rng.integers(0, 60, n)] * 2 + x * 0.5
    if kind == "hot":  # a third of all vectors are one
        x[rng.random(n) < 1 / 3] = x[1]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = defaultdict(list)
    for r in hilbert_search.nearest(df, every=100).collect():
        got[r["query_id"]].append(r["score"])
    hit = 0
    for q in range(0, n, 100):
        s = hilbert_search.cosine(x[q], x)
        s[q] = -9
        fifth = np.sort(s)[-5]
        assert len(got[q]) == 5
        hit += sum(v >= fifth - 1e-12 for v in got[q])
    assert hit / (n // 100 * 5) >= 0.9


def test_vectors_of_any_size(spark):  # noqa: ANN001
    rng = np.random.default_rng(5)
    x = rng.normal(size=(60, 8))
    rows = [(i, (v * 10.0 ** (200 * (i % 3 - 1))).tolist()) for i, v in enumerate(x)] + [(100, [5e-324] * 8)]
    got = defaultdict(list)
    for r in hilbert_search.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), every=50).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    assert set(got) == {0, 50, 100}
    for q in (0, 50):
        s = hilbert_search.cosine(x[q], np.concatenate([x, np.ones((1, 8))]))
        s[q] = -9
        want = np.argsort(-s)[:5]
        assert [v for v, _ in got[q]] == [100 if w == 60 else w for w in want.tolist()] and np.allclose([c for _, c in got[q]], s[want])
    assert np.isclose(hilbert_search.cosine(np.full(3, 1e200), np.full(3, 1e-200)), 1)


def test_hilbert_key_visits_neighbours():
    n = 1 << 4
    x, y = np.meshgrid(np.arange(n), np.arange(n))
    keys = hilbert_search.hilbert_key(x.ravel(), y.ravel(), 4)
    assert sorted(keys) == list(range(n * n))
    order = np.argsort(keys)
    step = np.abs(np.diff(x.ravel()[order])) + np.abs(np.diff(y.ravel()[order]))
    assert (step == 1).all()


# 9 ----------------------------------------------------------------------------------------


def test_media(docs, corpus, empty):  # noqa: ANN001
    items, table = media.interleave(docs)
    found = media.resolve(items.where("kind = 'media'"), table).select("page.doc_id", "page.n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "position", "caption").collect()
    want = []
    for r in corpus:
        t = (r[1] or "").encode()
        p = media.pad(t)
        assert p.startswith(t) and len(p) % 192 == 0 and len(p) - len(t) < 192 + (not t)
        want.append((r[0], len(t), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]), 1, f"{len(t)} bytes"))
    assert sorted(map(tuple, found), key=repr) == sorted(want, key=repr)
    assert not media.interleave(empty)[0].count()


def test_interleaved_texts_follow_their_media(docs, corpus):  # noqa: ANN001
    items, table = media.interleave(docs)
    got = defaultdict(list)
    for r in items.orderBy("position").collect():
        got[r["page"]["doc_id"], r["page"]["n_bytes"]].append((r["position"], r["kind"], r["text"], r["ref"]))
    for r in corpus:
        lines = [x for x in (re.sub(r"\s+", " ", x).strip() for x in (r[1] or "").split("\n")) if x]
        found = got[r[0], len((r[1] or "").encode())]
        copies = len(found) // (2 + len(lines))
        assert [x[2] for x in found[2 * copies :: copies]] == lines and found[0][2] == f"Document {'' if r[0] is None else r[0]}".strip()
        assert found[copies][:2] == (1, "media") and found[copies][3] == "sha256:" + hashlib.sha256(media.encode_image(media.pad((r[1] or "").encode()))).hexdigest()
    assert table.count() == len({r[1] or "" for r in corpus})


def test_html_items_keep_order_and_captions():
    html = "<p>One <b>two</b></p><script>var x</script><figure><img src='a.png'><figcaption>The &amp; caption</figcaption></figure>tail<img src=b.png alt=alt>"
    got = [(i["position"], i["kind"], i["text"] or i["ref"], i["caption"]) for i in media.html_items(html)]
    assert got == [(0, "text", "One two", None), (1, "media", "a.png", "The & caption"), (2, "text", "tail", None), (3, "media", "b.png", "alt")]
    assert media.html_items("") == []


def test_images_round_trip():
    for n in (1, 3):
        p = bytes(range(192)) * n
        assert media.decode_image(media.encode_image(p)) == p
    with pytest.raises(ValueError):
        media.encode_image(b"")


# 2 ----------------------------------------------------------------------------------------


@pytest.mark.parametrize("size", [1, 2, 3, 10, 97, 1000])
def test_permutation(size):  # noqa: ANN001
    to = [pseudonyms.permute(i, size, b"k", "t") for i in range(size)]
    assert sorted(to) == list(range(size))
    assert [pseudonyms.invert(v, size, b"k", "t") for v in to] == list(range(size))


def test_pseudonyms_stay_valid_and_linked():
    text = 'und.34@mail7.example.com 4845168114407329 4845-1681-1440-7329 9807915762804490 +1 (487) 555-7209 144.137.247.239 1990-05-17 123-45-6789 DE89 3704 0044 0532 0130 00 token = "04dbebab91ab85687d33eeaaf9ac699e1188f962"'
    new, kinds = pseudonyms.pseudonymize_text(text, b"k")
    assert kinds == {"mail": 1, "card": 2, "phone": 1, "address": 1, "date": 1, "insured": 1, "account": 1, "secret": 1}
    a, b = text.split(), new.split()
    assert [len(x) for x in a[1:4]] == [len(x) for x in b[1:4]] and b[2].replace("-", "") == b[1] and pseudonyms.luhn_sum(b[1]) % 10 == 0
    assert a[3] == b[3] and not {a[0], a[1], a[5], a[7]} & set(b)
    assert pseudonyms.pseudonymize_text(text, b"k")[0] == new != pseudonyms.pseudonymize_text(text, b"other")[0]
    for clean in ("", "version 1.2.3, room 12", "9807915762804490", "300.1.2.3", "2001-02-30"):
        assert pseudonyms.pseudonymize_text(clean, b"k") == (clean, {})


@pytest.mark.parametrize("value", ["0123456789abcdef" * 40, "abcdefghi" * 5, "aB3+xZ/9" * 15, "abCD" * 90, "q" * 200_000, "f" * 300])
def test_long_secrets_are_permuted_in_time(value):  # noqa: ANN001
    new, kinds = pseudonyms.pseudonymize_text(f"token={value}", b"k")
    assert kinds == {"secret": 1} and len(new) == len(value) + 6 and new != f"token={value}"
    swap = lambda s: re.sub("[a-z]", "a", re.sub("[A-Z]", "A", re.sub("[0-9]", "0", s)))
    assert re.fullmatch("[0-9a-f]+", value) or swap(new[6:]) == swap(value)
    assert pseudonyms.pseudonymize_text(f"x password: {value}", b"k")[0][12:] == new[6:]


def test_long_mail_names_and_many_values():
    name = "abcdefghijklmnopqrstuvwxyzabcdefghijklmnopqrstuvwxyz"[:50]
    new, kinds = pseudonyms.pseudonymize_text(f"{name}@example.org " * 3000, b"k")
    assert kinds == {"mail": 3000} and name not in new and len(set(new.split())) == 1
    size = 10**90
    for v in (0, 1, size // 3, size - 1):
        assert pseudonyms.invert(pseudonyms.permute(v, size, b"k", "t"), size, b"k", "t") == v


def test_dates_and_phones_of_more_formats():
    for text in ("25/12/2020", "12/25/2020", "14.07.1789", "2450-01-31", "0999-02-03"):
        new, kinds = pseudonyms.pseudonymize_text(text, b"k")
        assert kinds == {"date": 1} and new != text and len(new) == len(text)
    year = [pseudonyms.pseudonymize_text(t, b"k")[0][-4:] for t in ("25/12/2020", "12/25/2020")]
    assert year[0] == year[1] and 1900 <= int(year[0]) < 2100
    for text in ("+33 6 12 34 56 78", "+49 30 1234 5678", "+1 (487) 555-7209"):
        new, kinds = pseudonyms.pseudonymize_text(text, b"k")
        assert kinds == {"phone": 1} and new.split()[0] == text.split()[0] and new != text
    assert pseudonyms.pseudonymize_text("31/31/2020 +1 2 3", b"k") == ("31/31/2020 +1 2 3", {})


def test_pseudonyms_need_a_key(spark, docs):  # noqa: ANN001
    with pytest.raises(ValueError):
        pseudonyms.pseudonymize(docs, "")
    spark.conf.unset("corpusloom.pseudonym.key")
    assert pseudonyms.session_key(spark) == pseudonyms.session_key(spark) != ""


def test_pseudonymize_keeps_rows(docs, corpus, empty):  # noqa: ANN001
    out = pseudonyms.pseudonymize(docs, "k")
    assert out.columns == [*docs.columns, "n_private", "private_kinds"] and out.count() == len(corpus)
    assert rows_of(out.select("doc_id", "text")) == sorted(((r[0], r[1]) for r in corpus), key=repr)
    assert not pseudonyms.pseudonymize(empty, "k").count()


# 1 ----------------------------------------------------------------------------------------


def test_marginals_are_those_of_all_paths():
    rng = np.random.default_rng(7)
    e, t = rng.normal(size=(1, 5)), rng.normal(size=(2, 2))
    weight, on = 0.0, np.zeros(5)
    for path in np.ndindex(*[2] * 5):
        w = np.exp(sum(e[0, k] * s for k, s in enumerate(path)) + sum(t[a, b] for a, b in zip(path, path[1:], strict=False)))
        weight += w
        on += w * np.asarray(path)
    p, expected, _ = toxicity.marginals(e, t, pairs=True)
    assert np.allclose(p[0], on / weight)
    assert np.isclose(expected.sum(), 4)


def test_long_texts_are_one_chain():
    rng = np.random.default_rng(3)
    sizes = [0, 5, 64, 65, 200, 1, 0, 700, 128]
    e, t = rng.normal(size=sum(sizes)) * 3 - 2, np.asarray([[2.0, -1.5], [-1.0, 1.5]])
    got, at = toxicity.text_marginals(e, sizes, t), 0
    for s in sizes:
        if s:
            whole = -(-s // toxicity.WINDOW) * toxicity.WINDOW  # the last row is filled up with clean words
            x = np.full(whole, toxicity._PAD)
            x[:s] = e[at : at + s]
            assert np.allclose(got[at : at + s], toxicity.marginals(x[None, :], t)[0, :s])
        at += s
    assert len(toxicity.text_marginals(np.zeros(0), [], t)) == 0


def test_toxicity(spark, empty):  # noqa: ANN001
    rng = random.Random(3)
    rows, labels = [], []
    for i in range(600):
        w = words(rng, 60).split()
        toxic = i % 6 == 0
        if toxic:
            for _ in range(3):
                w[rng.randrange(len(w))] = rng.choice(["vileword", "vilething", "vileness"])
        rows.append((i, " ".join(w)))
        labels.append((i, int(toxic)))
    rows += [(900, ""), (901, None), (None, "vileword " * 9), (902, "x " * 5000 + "vileword vilething")]
    docs, known = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.train(docs, known)
    out = {r["doc_id"]: r for r in toxicity.score_toxicity(docs, model).collect()}
    for i, y in labels:
        assert out[i]["held_out"] is (zlib.crc32(str(i).encode()) % 3 == 1)
        assert out[i]["predicted"] == y == int(out[i]["score"] >= 0.7)
    assert out[900]["score"] == out[901]["score"] < 0.7 and out[902]["predicted"] == 1 and out[None]["predicted"] == 1
    text = dict(rows)[0]
    assert all(text[s["start"] : s["end"]].split()[0].startswith("vile") for s in out[0]["spans"]) and out[0]["spans"]
    kept = {r["doc_id"] for r in toxicity.drop_toxic(docs, model).collect()}
    assert kept == {i for i, y in labels if not y} | {900, 901}
    none = toxicity.train(docs, known.where("toxic = 0"))
    assert toxicity.score_toxicity(docs, none).agg(F.max("predicted")).first()[0] == 0
    assert not toxicity.score_toxicity(empty, model).count()


# 5 ----------------------------------------------------------------------------------------


def test_quality(spark, empty):  # noqa: ANN001
    rng = random.Random(8)
    rows, labels = [], []
    for i in range(400):
        good = i % 4 != 0
        rows.append((i, words(rng, 80) + "." if good else "!! " * 90, f"h{i % 5}", "p"))
        labels.append((i, int(good)))
    rows += [(900, None, None, None), (901, "", "new", "p"), (None, words(rng, 50), "h0", "p")]
    docs, known = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string"), spark.createDataFrame(labels, "doc_id long, quality int")
    out = {r["doc_id"]: r for r in quality.score_quality(docs, known, F.col("source"), F.col("lang")).collect()}
    assert len(out) == len(rows) and all(out[i]["keep"] is bool(y) for i, y in labels)
    assert out[901]["host_rate"] == out[901]["path_rate"]
    assert not quality.score_quality(empty, known, F.col("source"), F.col("lang")).count()


def test_sparse_sites_shrink_to_the_rate_above(spark):  # noqa: ANN001
    rows = [(f"h{i % 40}", f"p{i % 3}", int(i % 40 < 20)) for i in range(4000)] + [("tiny", "p", 0)]
    sites = quality.site_rates(spark.createDataFrame(rows, "host string, path string, good int"))
    rate = {r["host"]: r["host_rate"] for r in sites.hosts.select("host", sites.host_rate().alias("host_rate")).collect()}
    assert rate["h0"] > 0.95 and rate["h39"] < 0.05 and abs(sites.overall - 0.5) < 0.01
    assert rate["h39"] < rate["tiny"] < sites.overall
    assert sites.paths.count() == 121


@pytest.mark.parametrize("host", ["one", None])
def test_quality_of_a_single_host(spark, host):  # noqa: ANN001
    rng = random.Random(3)
    rows = [(i, words(rng, 60), host, None) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    known = spark.createDataFrame([(i, i % 2) for i in range(20)], "doc_id long, quality int")
    out = quality.score_quality(docs, known, F.col("source"), F.col("lang")).collect()
    assert len(out) == 40 and all(0 < r["score"] < 1 for r in out)
    assert {round(r["host_rate"], 2) for r in out if r["doc_id"] >= 20} == {0.5}


def test_site_rates_leave_out_the_own_label(spark):  # noqa: ANN001
    rng = random.Random(5)
    rows = [(i, words(rng, 40), f"h{i % 7}", f"p{i % 3}") for i in range(120)] + [(3, "again", "h3", "p0"), (None, "x", "h3", "p0")]
    label = {i: int(rng.random() < (0.9 if i % 7 < 3 else 0.2)) for i in range(100)}
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    known = spark.createDataFrame(list(label.items()), "doc_id long, quality int")
    labelled = {(i, h, p, label[i]) for i, _, h, p in rows if i in label}
    sites = quality.site_rates(spark.createDataFrame([r[1:] for r in labelled], "host string, path string, good int"))
    got = quality.score_quality(docs, known, F.col("source"), F.col("lang")).collect()
    want = []
    for i, _, h, p in rows:
        y = label.get(i)
        at_host, at_path = [g for _, a, _, g in labelled if a == h], [g for _, a, b, g in labelled if (a, b) == (h, p)]
        gone, good = (0, 0) if y is None else (1, y)
        host = (sum(at_host) - good + sites.host_strength * sites.overall) / (len(at_host) - gone + sites.host_strength)
        path = (sum(at_path) - good + sites.path_strength * host) / (len(at_path) - gone + sites.path_strength)
        want.append((str(i), round(host, 9), round(path, 9)))
    assert sorted((str(r["doc_id"]), round(r["host_rate"], 9), round(r["path_rate"], 9)) for r in got) == sorted(want)
    odds = lambda p: np.log(p / (1 - p))
    for r in got:
        assert np.isclose(odds(r["score"]), np.clip(r["evidence"] + odds(r["path_rate"]) - odds(sites.overall), -30, 30))


def test_sites_of_addresses(spark):  # noqa: ANN001
    df = spark.createDataFrame([("https://u@WWW.a.example:8080/en/x?y", "l"), ("http://b.example", "l"), ("src0", "de"), (None, "de"), ("http:///x", "l")], "s string, l string")
    got = [tuple(r) for r in df.select(*quality.site_of(F.col("s"), F.col("l"))).collect()]
    assert got == [("www.a.example", "en"), ("b.example", ""), ("src0", "de"), (None, "de"), ("http:///x", "l")]


# shared -----------------------------------------------------------------------------------


def test_components(spark):  # noqa: ANN001
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(1, 60)] + [(rng.randrange(100, 200), rng.randrange(100, 200)) for _ in range(90)] + [(7, 7)]
    root = list(range(201))

    def find(x: int) -> int:
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        root[max(find(a), find(b))] = min(find(a), find(b))
    got = {r["v"]: r["root"] for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {v: find(v) for a, b in edges if a != b for v in (a, b)}


def test_pipeline(spark, tmp_path, corpus):  # noqa: ANN001
    import corpus_pipeline

    docs = spark.createDataFrame([r[:5] for r in corpus], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    pieces = corpus_pipeline.run(spark, str(tmp_path))
    kept = {r["doc_id"] for r in pieces.select("doc_id").distinct().collect()}
    assert kept and kept <= {r[0] for r in corpus}
    held = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, held, str(tmp_path)).columns == docs.columns


def without_later_runs(rows: list[tuple], least: int = 60) -> dict[int, str]:
    """Texts (doc_id: text) without the lines of runs of ``least`` bytes that stand further up, by trying every run."""
    places: dict = defaultdict(list)
    lines = {i: t.split("\n") for i, t in sorted(rows)}
    for i, x in lines.items():
        for k in range(len(x)):
            for to in range(k + 1, len(x) + 1):
                run = "\n".join(x[k:to])
                if len(run.encode()) >= least:
                    places[run].append((i, k, to))
    gone = defaultdict(set)
    for at in places.values():
        for i, k, to in at[1:]:
            gone[i].update(range(k, to))
    return {i: "\n".join(v for k, v in enumerate(x) if k not in gone[i]) for i, x in lines.items()}


def test_pipeline_stages_against_brute_force(spark, tmp_path):  # noqa: ANN001
    import corpus_pipeline
    from tokenizers import Tokenizer

    rng = random.Random(21)
    rows, labels = [], []
    shared = [words(rng, 14) for _ in range(6)]
    for i in range(420):
        text = [words(rng, 12) for _ in range(4)]
        if i % 6 == 0:
            text[1] = " ".join(rng.choice(["vileword", "vilething", "vileness"]) if k % 3 == 0 else words(rng, 1) for k in range(12))
        if i % 7 == 1:
            text[2:2] = shared[i % 3 : i % 3 + 3]
        if i % 9 == 2:
            text.append(f"write to me{i}.b@example.org on 2019-0{i % 8 + 1}-11 or +1 (487) 555-7{i:03d}")
        rows.append((i, "\n".join(text)))
        labels.append((i, 1, int(i % 6 == 0)))
    for k in range(8):  # copies, and near copies in one line
        rows.append((500 + k, rows[2 * k + 1][1]))
        long = words(rng, 90).split()
        for v in range(2):
            rows.append((520 + 2 * k + v, " ".join(w if n != 40 + v else "other" for n, w in enumerate(long))))
    rows += [(600, "")]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], schema)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    stages, sf = dict(corpus_pipeline.STAGES), str(tmp_path)
    texts = lambda df: {r["doc_id"]: r["text"] for r in df.collect()}

    clean = common.materialize(stages["toxicity"](spark, spark.read.parquet(f"{sf}/documents.parquet"), sf))
    want = {i: t for i, t in rows if "vile" not in t}
    assert texts(clean) == want and len(want) < len(rows)
    lined = common.materialize(stages["line_dedup"](spark, clean, sf))
    want = {i: t for i, t in without_later_runs(list(want.items())).items() if t or not want[i]}
    assert texts(lined) == want and not {500, 501} & set(want) and 600 in want
    assert all(r["n_chars"] == len(r["text"]) for r in lined.collect())
    single = common.materialize(stages["near_copies"](spark, lined, sf))
    component = {r[0]: r[2] for r in brute_components([(i, t) for i, t in want.items()])}
    kept = {i: t for i, t in want.items() if component[i] == i}
    assert texts(single) == kept and len(want) - len(kept) == 8
    private = common.materialize(stages["pseudonyms"](spark, single, sf))
    key = pseudonyms.session_key(spark).encode()
    want = {i: pseudonyms.pseudonymize_text(t, key)[0] for i, t in kept.items()}
    assert texts(private) == want != kept and not any(f"me{i}.b@" in t for i, t in want.items())
    tokenizer = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    ids = {i: [*tokenizer.encode(t, add_special_tokens=False).ids, 1] for i, t in want.items()}
    for pieces in (stages["packing"](spark, private, sf), corpus_pipeline.run(spark, sf)):
        got = pieces.collect()
        assert {r["doc_id"] for r in got} == set(ids) and sum(r["length"] for r in got) == sum(map(len, ids.values()))
        for r in got:
            part = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
            assert r["ids_crc32"] == zlib.crc32(struct.pack(f"<{len(part)}I", *part)) and r["doc_tokens"] == len(ids[r["doc_id"]])
