"""Periodic runs of words, by an online sparse dynamic program over diagonals.

Words are read in order. For each word, its earlier occurrences are diagonals (lags): a lag is active while words
so far apart are the same, and has the position where it began. A diagonal that ends with sufficient length
emits its run at once; of several with one stretch, the shortest lag is its smallest period. Only diagonals that can
reach that length are begun, which leaves the results as they are:

* a run of period d needs max(d, ``least`` - d) matches, so a lag begins only where as many words stand at both its ends, told
  by hashes of two stretches that cover them; equal hashes of different words begin a diagonal that ends too soon, for the
  matches themselves are counted on the words;
* words before both ends differ, or the diagonal would have begun earlier;
* inside a run that is active with period p, lags that are multiples of p end with it and have its period.

So a text of one word, or of one short phrase, repeated for ever has a few active lags, not one for each pair.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import blocks, mix64, table

#: Fixed value: the pattern of a word.
WORD = r"[^\x20\x09-\x0D]+"
RUNS = "array<struct<start: bigint, length: bigint, period: bigint>>"


def _grams(ids: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the k words from each position on."""
    out = np.zeros(len(ids) - k + 1, dtype=np.uint64)
    for i in range(k):
        out = mix64(out * np.uint64(0x9E3779B97F4A7C15) + ids[i : len(ids) - k + 1 + i] + np.uint64(1))
    return out


def _begins(ids: np.ndarray, least: int) -> dict[int, list[int]]:
    """Lags that may begin at each position, by the rules above that need no active lags."""
    size, out = max(1, least // 2), defaultdict(list)
    before = np.concatenate([[-1], ids[:-1].astype(np.int64)])
    names, low = _grams(ids, size) if len(ids) >= size else ids[:0], 1
    while len(names) > low:
        order = np.argsort(names, kind="stable")
        same_name = np.concatenate([[False], names[order[1:]] == names[order[:-1]]])
        if not same_name.any():
            break  # longer stretches occur twice only where their beginnings do
        same_word = same_name & np.concatenate([[False], before[order[1:]] == before[order[:-1]]])
        last, other = np.full(len(names), -1), np.full(len(names), -1)
        last[order[1:]] = np.where(same_name[1:], order[:-1], -1)
        # the last earlier occurrence after another word
        head = np.maximum.accumulate(np.where(same_word, 0, np.arange(len(order))))
        other[order] = np.where(same_name[head], order[head - 1], -1)
        at = np.arange(len(names))
        j = np.where((last >= 0) & (before[last] == before[: len(names)]), other[last], last)
        pairs: list[tuple[int, int]] = []
        for i, earlier in zip(*(x[(j >= 0) & (at - j < 2 * size)].tolist() for x in (at, j)), strict=True):
            while earlier >= 0 and i - earlier < 2 * size:
                if before[earlier] == before[i]:
                    earlier = int(other[earlier])
                    continue
                if i - earlier >= low:
                    pairs.append((i, i - earlier))
                earlier = int(last[earlier])
        if pairs:
            i, lag = np.asarray(pairs).T
            rest = np.maximum(lag, least - lag) - size  # what has to match behind the first ``size`` words
            fits = i + rest < len(names)
            i, lag, rest = i[fits], lag[fits], rest[fits]
            fits = names[i + rest] == names[i + rest - lag]
            for k, d in zip(i[fits].tolist(), lag[fits].tolist(), strict=True):
                out[k].append(d)
        low = 2 * size
        if len(names) <= size:
            break
        names = mix64(names[: len(names) - size] * np.uint64(0xD1342543DE82EF95) ^ mix64(names[size:]))
        size *= 2
    return out


def runs_of(ids: np.ndarray, least: int = 12) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs, by start and period: stretches with smallest period q that no neighbour extends, of max(least, 2q) words or more."""
    begins = _begins(ids, least)
    if not begins:
        return []
    words, n, runs = ids.tolist(), len(ids), []
    active: dict[int, int] = {}  # lag: where its matches began
    places = sorted(begins)
    i = k = 0
    while k < len(places) or active:
        if not active:
            i = places[k]
        if i == n:
            ended = list(active)
        else:
            ended = [d for d in active if words[i] != words[i - d]]
        if ended:
            first: dict[int, int] = {}  # of diagonals with one stretch, the shortest lag
            for d in ended:
                start = active.pop(d) - d
                if i - start >= max(least, 2 * d):
                    first[start] = min(d, first.get(start, d))
            runs += [(start, i - start, d) for start, d in first.items()]
        if i == n:
            break
        if k < len(places) and places[k] == i:
            for d in sorted(begins[i]):
                inside = any(d % p == 0 and i - d >= began - p for p, began in active.items())
                if d not in active and not inside and words[i] == words[i - d]:
                    active[d] = i
            k += 1
        i += 1
    return sorted(runs, key=lambda r: (r[0], r[2]))


def repeating(ids: np.ndarray, ends: np.ndarray, size: int) -> np.ndarray:
    """Which texts of a block (their words' ids one after another, text t up to ``ends[t]``) have ``size`` words that stand in them twice."""
    if len(ids) < size:
        return np.zeros(len(ends), dtype=bool)
    text = np.searchsorted(ends, np.arange(len(ids) - size + 1), side="right")
    whole = np.arange(len(ids) - size + 1) + size <= ends[text]
    named = mix64(_grams(ids, size) + mix64(text.astype(np.uint64)))[whole]
    order = np.argsort(named, kind="stable")
    twice = np.flatnonzero(named[order[1:]] == named[order[:-1]])
    out = np.zeros(len(ends), dtype=bool)
    out[text[whole][order[twice]]] = True
    return out


def periodic_runs(docs: DataFrame, least: int = 12) -> DataFrame:
    """``docs`` (doc_id, text) with n_words, runs (start, length, period) and ``collapsed``: the words that no run has after its first period, joined by spaces.

    Words are bytes between ASCII white space, equal if their bytes are. A null or empty text has no words, no runs and an empty
    ``collapsed``. Every row stands for itself, so repeated rows come out alike and doc_id may be null; further columns are ignored;
    an empty table gives no rows. A text is one row of any length, and takes memory in proportion to its words.
    """

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in blocks(batches, "text", 4 << 20):
            split = [t.split() for t in texts]
            known: dict[bytes, int] = {}
            ids = np.fromiter((known.setdefault(w, len(known)) for words in split for w in words), dtype=np.uint64)
            counts = np.asarray([len(words) for words in split], dtype=np.int64)
            ends = np.cumsum(counts)
            runs, left = [[] for _ in split], list(split)
            for t in np.flatnonzero(repeating(ids, ends, max(1, least // 2))).tolist():
                runs[t] = runs_of(ids[ends[t] - counts[t] : ends[t]], least)
                if runs[t]:
                    kept = np.ones(counts[t], dtype=bool)
                    for start, length, period in runs[t]:
                        kept[start + period : start + length] = False
                    left[t] = [split[t][i] for i in np.flatnonzero(kept).tolist()]
            kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
            named = [[dict(zip(("start", "length", "period"), r, strict=True)) for r in of] for of in runs]
            collapsed = pa.array([b" ".join(words) for words in left], type=pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts), pa.array(named, type=kind), collapsed], names=["doc_id", "n_words", "runs", "collapsed"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(find, f"doc_id {kind}, n_words long, runs {RUNS}, collapsed string")


def made_periodic(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) where one text in ten repeats some of its words to its end, by a checksum of doc_id (texts without doc_id stay)."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)
    words = F.regexp_extract_all("text", F.lit(WORD), F.lit(0))
    # words are looked for in the texts concerned alone
    d = docs.select("doc_id", "text", g.alias("g"), F.when(h % 10 == 0, words).alias("words")).withColumn("n", F.size("words"))
    a = F.col("g") % F.col("n")
    d = d.withColumn("a", F.when(F.col("n") > 0, a).cast("int"))
    p = (1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))).cast("int")
    d = d.withColumn("p", p)
    tail = F.transform(F.sequence(F.col("a"), F.col("n") - 1), lambda i: F.get("words", F.col("a") + (i - F.col("a")) % F.col("p")))
    again = F.array_join(F.concat(F.slice("words", F.lit(1), F.col("a")), tail), " ")
    return d.select("doc_id", F.when(F.col("n") > 0, again).otherwise(F.col("text")).alias("text"))


def _lines(runs: Column) -> Column:
    """``start,length,period`` and a line feed of every run."""
    return F.array_join(F.transform(runs, lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n"))), "")


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(made_periodic(table(spark, sf_dir, "documents")))
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("back"), (-r["period"]).alias("slow"))))
    length, period = longest["length"], -longest["slow"]
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-longest["back"]).alias("start"), length.alias("length"), period.alias("period"), F.floor(1000 * length / period).alias("exponent_milli"),
        F.sha2(_lines(F.col("runs")), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
