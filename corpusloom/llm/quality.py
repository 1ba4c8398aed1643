"""Quality: document evidence and hierarchical empirical Bayes over hosts and paths.

A logistic classifier of text statistics gives each document's log odds. Sites add what is known of their
labelled documents: a host's rate of good documents is drawn towards the global rate, a path's towards its
host's, each by a beta prior whose strength is estimated from how much rates differ beyond chance. The
site's log odds against the global rate are added to the document's. What a labelled document's own label
adds to its site is taken out again before that document is scored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import blocks, materialize, table

_CLASS = np.zeros(256, dtype=np.int64)  # 0 other, 1 small letter, 2 capital, 3 digit, 4 white space, 5 sentence end, 6 mark, 7 beyond ASCII
for _chars, _c in ((range(97, 123), 1), (range(65, 91), 2), (range(48, 58), 3), (b" \t\n\r\x0b\x0c", 4), (b".?!", 5), (b"|#*$%&{}<>=_~^\\/@", 6), (range(128, 256), 7)):
    _CLASS[list(_chars)] = _c
N_FEATURES = 16


def text_features(text: bytes) -> np.ndarray:
    """Statistics of a whole text: shares of byte classes, word lengths, repeats of words and of lines, length."""
    out = np.zeros(N_FEATURES)
    out[0] = 1
    n = len(text)
    if not n:
        out[15] = 1
        return out
    out[1:9] = np.bincount(_CLASS[np.frombuffer(text, dtype=np.uint8)], minlength=8) / n
    words, lines = text.split(), [x for x in text.split(b"\n") if x.strip()]
    m = max(1, len(words))
    out[9] = min(3.0, n / m / 8)
    out[10] = 1 - len(set(words)) / m
    out[11] = sum(a == b for a, b in zip(words, words[1:], strict=False)) / m
    out[12] = 1 - len(set(lines)) / max(1, len(lines))
    out[13] = np.log1p(len(words)) / 8
    out[14] = np.log1p(m / max(1, len(lines))) / 5
    return out


def featured(docs: DataFrame, *keep: str) -> DataFrame:
    """``keep`` columns and the features of each whole text."""
    kinds = [f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in blocks(batches, "text", 4 << 20):
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array([text_features(t) for t in texts], type=pa.list_(pa.float64()))], names=[*keep, "features"])

    return docs.select(*keep, "text").mapInArrow(read, ", ".join([*kinds, "features array<double>"]))


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 50) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(x.shape[1])
        w = w + np.linalg.solve(h, x.T @ (y - p) - ridge * w)
    return w


def strength(good: Column, n: Column, mean: Column) -> Column:
    """Prior strength by moments, as an aggregate over sites: with rates that differ no more than chance, it is large."""
    total, sites = F.sum(n), F.count("*")
    between = F.sum(n * F.pow(good / n - mean, 2))
    chance = F.first(mean) * (1 - F.first(mean)) * (sites - 1)
    spread = F.try_divide(between - chance, total - F.sum(n * n) / total)  # null with one site, which tells nothing of differences
    rho = F.least(F.greatest(F.coalesce(spread / (F.first(mean) * (1 - F.first(mean))), F.lit(0.0)), F.lit(0.001)), F.lit(0.9))
    return (1 / rho - 1).alias("strength")


@dataclass(frozen=True)
class Sites:
    """Labelled documents by site, and the priors: (host, host_n, host_good), (host, path, path_n, path_good)."""

    hosts: DataFrame
    paths: DataFrame
    overall: float  #: the global rate
    host_strength: float
    path_strength: float

    def host_rate(self, own: Column | None = None) -> Column:
        """Posterior rate of a row's host, without the row's ``own`` label (null: it has none)."""
        return _posterior("host", self.host_strength, F.lit(self.overall), own)

    def path_rate(self, own: Column | None = None) -> Column:
        return _posterior("path", self.path_strength, self.host_rate(own), own)


def _posterior(site: str, prior: float, above: Column, own: Column | None) -> Column:
    n, good = F.coalesce(f"{site}_n", F.lit(0)), F.coalesce(f"{site}_good", F.lit(0))
    if own is not None:
        n, good = n - F.when(own.isNull(), 0).otherwise(1), good - F.coalesce(own, F.lit(0))
    return (good + prior * above) / (n + prior)


def site_rates(labelled: DataFrame) -> Sites:
    """What rows (host, path, good) tell of their sites."""
    paths = materialize(labelled.groupBy("host", "path").agg(F.count("*").alias("path_n"), F.sum("good").alias("path_good")), "paths")
    total = paths.agg(F.sum("path_n").alias("n"), F.sum("path_good").alias("good")).first()
    overall = ((total["good"] or 0) + 1) / ((total["n"] or 0) + 2)
    hosts = materialize(paths.groupBy("host").agg(F.sum("path_n").alias("host_n"), F.sum("path_good").alias("host_good")), "hosts")
    s = hosts.agg(strength(F.col("host_good"), F.col("host_n"), F.lit(overall))).first()["strength"]
    s = 1000.0 if s is None else float(s)
    rate, n = (F.col("host_good") + s * overall) / (F.col("host_n") + s), F.col("path_n")
    t = paths.join(hosts, "host").agg(F.sum(n).alias("n"), F.sum(n * F.pow(F.col("path_good") / n - rate, 2)).alias("between"), F.sum(rate * (1 - rate)).alias("chance"), F.sum(n * n).alias("squares")).first()
    rho = 0.001
    if t["n"]:
        spread = (t["between"] - t["chance"]) / max(1e-9, t["n"] - t["squares"] / t["n"])
        rho = min(0.9, max(0.001, spread / (overall * (1 - overall))))
    return Sites(hosts, paths, overall, s, 1 / rho - 1)


def site_of(source: Column, below: Column) -> tuple[Column, Column]:
    """Host and path of a document: those of its address, if ``source`` is one (the path's first part), else ``source`` itself and ``below``."""
    address = source.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#\s]+")
    host = F.lower(F.regexp_extract(source, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@\s]*@)?([^/?#:\s]+)", 1))
    path = F.regexp_extract(source, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#\s]+/([^/?#]*)", 1)
    return F.when(address, host).otherwise(source), F.when(address, path).otherwise(below)


def _logit(p: Column) -> Column:
    return F.log(p / (1 - p))


def score_quality(docs: DataFrame, labels: DataFrame, host: Column, path: Column, keep_from: float = 0.5, sample: int = 20_000) -> DataFrame:
    """doc_id, evidence (log odds of the text alone), host_rate, path_rate, score, keep (score >= ``keep_from``).

    The classifier is fitted on at most ``sample`` labelled rows, chosen by a hash of doc_id; site rates come from all
    labelled documents, each counted once, and from all but itself where a labelled document is scored. Null and empty texts have the
    features of none, very long ones are read whole; null hosts and paths are sites of their own; unseen sites have the rate above them, and a single
    host has the global one; a row without doc_id has no label; repeated labels of a doc_id count once (good, if one is),
    repeated rows are scored alike; an empty table has no scores; other columns are ignored.
    """
    labels = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max("quality").cast("int").alias("good"))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(host, F.lit("")).alias("host"), F.coalesce(path, F.lit("")).alias("path"))
    x = materialize(featured(docs, "doc_id", "host", "path"), "features")
    known = x.join(labels, "doc_id")
    n = max(1, known.count())
    some = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(min(1.0, 1.1 * sample / n) * (1 << 30))).select("features", "good").limit(sample).toPandas()
    weights = np.zeros(N_FEATURES)
    if some["good"].nunique() == 2:
        weights = fit_logistic(np.stack(some["features"]), some["good"].to_numpy(dtype=float))
    sites = site_rates(known.select("doc_id", "host", "path", "good").distinct())
    w = F.array(*[F.lit(float(v)) for v in weights])
    scored = x.select("doc_id", "host", "path", F.aggregate(F.zip_with("features", w, lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b).alias("evidence"))
    scored = scored.join(labels, "doc_id", "left").join(sites.paths, ["host", "path"], "left").join(sites.hosts, "host", "left")
    own = F.col("good")
    logit = F.col("evidence") + _logit(sites.path_rate(own)) - _logit(F.lit(sites.overall))
    score = 1 / (1 + F.exp(-F.least(F.greatest(logit, F.lit(-30.0)), F.lit(30.0))))
    return scored.select("doc_id", "evidence", sites.host_rate(own).alias("host_rate"), sites.path_rate(own).alias("path_rate"), score.alias("score"), (score >= keep_from).alias("keep"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hosts are the documents' sources, paths their languages below them (of sources that are addresses, their own hosts and paths)."""
    docs = table(spark, sf_dir, "documents")
    return score_quality(docs, table(spark, sf_dir, "labels"), *site_of(F.col("source"), F.col("lang")))
