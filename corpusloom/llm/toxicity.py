"""Toxicity: a linear-chain conditional random field over words.

Documents are labelled, words are not, so training words get their labels first: in a toxic document, those
words with a feature (the word or one of its beginnings) that is found in far more toxic than clean
documents. The field (two states, features of the word, transitions) is fitted to these labels. Its
forward-backward marginals give the toxic spans, and what they sum up to gives the document's score.
"""

from __future__ import annotations

import multiprocessing
import pickle
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from concurrent.futures import ProcessPoolExecutor
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import blocks, table

WORD = re.compile(r"\w+")
WINDOW = 64  #: words on a row; the field is fitted to rows as chains, and scoring carries messages from row to row
_PAD = -30.0


def word_features(word: str) -> list[str]:
    """The word (marked) and its beginnings of three to eight letters."""
    return ["=" + word, *[word[:k] for k in range(3, min(len(word), 8) + 1)]]


@dataclass
class Field:
    """Weights of the field and of the document score."""

    weights: dict[str, float] = field(default_factory=dict)
    bias: float = -8.0
    transitions: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    score: np.ndarray = field(default_factory=lambda: np.asarray([-20.0, 0.0, 0.0, 0.0]))

    def emission(self, word: str) -> float:
        get = self.weights.get
        return self.bias + sum(get(f, 0.0) for f in word_features(word))


def chains(sizes: list[int], values: np.ndarray, pad: float) -> tuple[np.ndarray, np.ndarray]:
    """The texts' values in rows of WINDOW, each text on rows of its own; and the place of every value."""
    sizes_ = np.asarray(sizes, dtype=np.int64)
    rows = (sizes_ + WINDOW - 1) // WINDOW
    first = np.cumsum(rows) - rows
    place = np.repeat(first * WINDOW - (np.cumsum(sizes_) - sizes_), sizes_) + np.arange(len(values))
    out = np.full(int(rows.sum()) * WINDOW, pad)
    out[place] = values
    return out.reshape(-1, WINDOW), place


def _forward(lift: np.ndarray, t: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Share of the toxic state at each place (first axis) given what stands before, and the logarithms of the messages' sums.

    ``before`` is that share at the place before each row; NaN where a chain begins.
    """
    m, n = lift.shape
    fwd, norm = np.empty((m, n)), np.zeros(n)
    begins = np.isnan(before)
    share = np.where(begins, 0.0, before)
    for k in range(m):
        on, off = (share * t[1, 1] + (1 - share) * t[0, 1]) * lift[k], share * t[1, 0] + (1 - share) * t[0, 0]
        if k == 0:
            on, off = np.where(begins, lift[0], on), np.where(begins, 1.0, off)
        norm += np.log(on + off)
        share = fwd[k] = on / (on + off)
    return fwd, norm


def _backward(lift: np.ndarray, t: np.ndarray, after: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same from behind: messages to each place, that to the place before each row, and the logarithms of their sums."""
    m, n = lift.shape
    bwd, norm, share = np.empty((m, n)), np.zeros(n), after
    for k in range(m - 1, -1, -1):
        bwd[k] = share
        w = share * lift[k]
        on, off = t[1, 1] * w + t[1, 0] * (1 - share), t[0, 1] * w + t[0, 0] * (1 - share)
        norm += np.log(on + off)
        share = on / (on + off)
    return bwd, share, norm


def marginals(emissions: np.ndarray, transitions: np.ndarray, pairs: bool = False):  # noqa: ANN201
    """Probability of the toxic state at each place of each row, by forward and backward passes over all rows at once; a row is a chain.

    With ``pairs``, the expected number of each transition and the log-likelihood's normaliser as well.
    """
    lift, t = np.exp(np.clip(emissions, _PAD, 30)).T, np.exp(transitions)
    fwd, norm = _forward(lift, t, np.full(len(emissions), np.nan))
    bwd, _, _ = _backward(lift, t, np.full(len(emissions), 0.5))
    both = fwd * bwd
    p = (both / (both + (1 - fwd) * (1 - bwd))).T
    if not pairs:
        return p
    expected = np.empty((2, 2))
    w1, w0 = bwd[1:] * lift[1:], 1 - bwd[1:]
    joint = {(i, j): (fwd[:-1] if i else 1 - fwd[:-1]) * t[i, j] * (w1 if j else w0) for i in (0, 1) for j in (0, 1)}
    total = sum(joint.values())
    for key, x in joint.items():
        expected[key] = (x / total).sum()
    return p, expected, norm.sum()


def _carried(ends: list[tuple[np.ndarray, np.ndarray]], share: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """What comes out of ``rows`` when ``share`` goes in, from what comes out for 0 and for 1 (shares and logarithms of sums)."""
    (zero, n0), (one, n1) = ((x[rows], n[rows]) for x, n in ends)
    most = np.maximum(n0, n1)
    a, b = (1 - share) * np.exp(n0 - most), share * np.exp(n1 - most)
    return (a * zero + b * one) / (a + b)


def text_marginals(emissions: np.ndarray, sizes: list[int], transitions: np.ndarray) -> np.ndarray:
    """Probability of the toxic state at each word of each text, each text one chain of any length; values in a row, as ``emissions``.

    Texts lie on rows of WINDOW words. What goes into a row is carried over from the row beside it: messages are linear, so
    those out of every row are computed for both states going in, and the rows of a text are put together one by one.
    """
    if not len(emissions):
        return np.zeros(0)
    rows, place = chains(sizes, emissions, _PAD)
    lift, t = np.exp(np.clip(rows, _PAD, 30)).T, np.exp(transitions)
    count = (np.asarray(sizes, dtype=np.int64) + WINDOW - 1) // WINDOW
    first = np.cumsum(count) - count
    n = len(rows)
    before, after = np.full(n, np.nan), np.full(n, 0.5)
    if count.max() > 1:
        heads = np.zeros(n, dtype=bool)
        heads[first[count > 0]] = True
        ahead = [(f[-1], s) for f, s in (_forward(lift, t, np.where(heads, np.nan, x)) for x in (0.0, 1.0))]
        back = [_backward(lift, t, np.full(n, x))[1:] for x in (0.0, 1.0)]
        for k in range(1, int(count.max())):
            at = first[count > k] + k
            share = np.where(np.isnan(before[at - 1]), 0.0, before[at - 1])  # a first row gives the same for both
            before[at] = _carried(ahead, share, at - 1)
            behind = first[count > k] + count[count > k] - 1 - k
            after[behind] = _carried(back, after[behind + 1], behind + 1)
    fwd, _ = _forward(lift, t, before)
    bwd, _, _ = _backward(lift, t, after)
    both = fwd * bwd
    return (both / (both + (1 - fwd) * (1 - bwd))).T.ravel()[place]


def evidence(p: np.ndarray, sizes: list[int]) -> np.ndarray:
    """For each text: 1, the largest marginal, the second largest, and the logarithm of the sum of those from 0.3 on."""
    out = np.zeros((len(sizes), 4))
    out[:, 0] = 1
    at = 0
    for i, s in enumerate(sizes):
        if s:
            x = p[at : at + s]
            top = np.partition(x, -2)[-2:] if s > 1 else np.asarray([0.0, x[0]])
            out[i, 1:] = top[1], top[0], np.log1p(x[x >= 0.3].sum())
        at += s
    return out


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05, rounds: int = 40) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(x.shape[1])
        w = w + np.linalg.solve(h, x.T @ (y - p) - ridge * w)
    return w


def _unlike(words: list[list[str]]) -> list[int]:
    """Of word lists that are probably near copies (the same smallest or largest hash of three words), the first."""
    kept, seen = [], set()
    for i, w in enumerate(words):
        h = [zlib.crc32(" ".join(w[k : k + 3]).encode()) for k in range(max(1, len(w) - 2))]
        marks = {("least", min(h)), ("most", max(h))} if len(w) > 20 else {("whole", " ".join(w))}
        if not marks & seen:
            kept.append(i)
        seen |= marks
    return kept


def fit(texts: list[str], toxic: list[int], rounds: int = 60, rate: float = 0.3, ridge: float = 1.0) -> Field:
    """Fit the field on four fifths of the labelled texts and the score on the others (on all, if there are under 200)."""
    model = Field()
    if not any(toxic) or all(toxic):
        return model
    words = [WORD.findall(t.lower()) for t in texts]
    some = _unlike(words)
    words, y = [words[i] for i in some], np.asarray(toxic)[some]
    toxic = y.tolist()
    if not any(toxic) or all(toxic):
        return model
    part = np.arange(len(y)) % 5 != 4
    own = part if len(y) >= 200 else np.ones(len(y), dtype=bool)
    found: tuple[Counter, Counter] = (Counter(), Counter())
    for w, label, use in zip(words, toxic, own, strict=True):
        if use and label:
            found[1].update({f for x in set(w) for f in word_features(x)})
    often = {f for f, n in found[1].items() if n >= 3}  # no other can be a feature of the field
    for w, label, use in zip(words, toxic, own, strict=True):
        if use and not label:
            found[0].update({f for x in set(w) for f in word_features(x) if f in often})
    chance = y[own].mean()
    names, strong = {}, set()
    for f in sorted(often):
        n, c = found[1][f], found[0][f]
        # evidence that documents with this feature are toxic more often than others, as a log likelihood ratio
        surprise = n * np.log(n / ((n + c) * chance)) + (c * np.log(c / ((n + c) * (1 - chance))) if c else 0)
        share = n / (n + c + 1.0)
        if share >= 0.4 and share > chance and surprise >= 9:
            names[f] = len(names)
            if share >= 0.75:
                strong.add(f)
    if not names:
        return model
    plain: tuple[tuple[int, ...], bool] = ((), False)
    known: dict[str, tuple[tuple[int, ...], bool]] = {}
    for w in words:
        for x in w:
            if x not in known:
                fs = [f for f in word_features(x) if f in names]
                known[x] = (tuple(names[f] for f in fs), any(f in strong for f in fs)) if fs else plain
    use = np.flatnonzero(own)
    flat = [known[x] for i in use for x in words[i]]
    sizes = [len(words[i]) for i in use]
    truth = np.repeat(y[use], sizes) * np.asarray([k[1] for k in flat])
    token = np.repeat(np.arange(len(flat)), [len(k[0]) for k in flat])
    feature = np.asarray([f for k in flat for f in k[0]], dtype=np.int64)
    place = chains(sizes, np.zeros(len(flat)), 0.0)[1]
    grid = np.zeros((int(place[-1]) // WINDOW + 1) * WINDOW)
    grid[place] = truth
    grid = grid.reshape(-1, WINDOW).astype(int)
    real = np.zeros(grid.size, dtype=bool)
    real[place] = True
    real = real.reshape(grid.shape)
    seen = np.asarray([[((grid[:, :-1] == i) & (grid[:, 1:] == j)).sum() for j in (0, 1)] for i in (0, 1)], dtype=float)
    theta = np.zeros(len(names) + 5)
    theta[-5] = -6.0
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, rounds + 1):
        e = np.bincount(token, theta[feature], minlength=len(flat)) + theta[-5]
        p, expected, _ = marginals(chains(sizes, e, _PAD)[0], theta[-4:].reshape(2, 2), pairs=True)
        off = (grid - p).ravel()[place]
        grad = np.concatenate([np.bincount(feature, off[token], minlength=len(names)), [off.sum()], (seen - expected).ravel()])
        grad[: len(names)] -= ridge * theta[: len(names)]
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        theta += rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    model = Field({f: float(theta[k]) for f, k in names.items()}, float(theta[-5]), theta[-4:].reshape(2, 2))
    rest = np.flatnonzero(~part if len(y) >= 200 and y[~part].any() else np.ones(len(y), dtype=bool))
    sizes = [len(words[i]) for i in rest]
    e = np.fromiter((model.bias + sum(theta[f] for f in known[x][0]) for i in rest for x in words[i]), dtype=np.float64, count=sum(sizes))
    model.score = _logistic(evidence(text_marginals(e, sizes, model.transitions), sizes), y[rest])
    return model


class _Emissions(dict):
    """Emissions of words, made on first use; emptied when full."""

    def __init__(self, model: Field, limit: int = 500_000):
        super().__init__()
        self.model, self.limit = model, limit

    def __missing__(self, word: str) -> float:
        if len(self) >= self.limit:
            self.clear()
        self[word] = e = self.model.emission(word)
        return e


def score_texts(texts: list[str], model: Field, emissions: dict | None = None, spans: bool = True):  # noqa: ANN201
    """Scores of texts and, with ``spans``, their toxic spans as lists of (start, end) in characters."""
    emissions = _Emissions(model) if emissions is None else emissions
    words = [WORD.findall(t.lower()) for t in texts]
    sizes = [len(w) for w in words]
    e = np.fromiter((emissions[x] for w in words for x in w), dtype=np.float64, count=sum(sizes))
    p = text_marginals(e, sizes, model.transitions)
    score = 1 / (1 + np.exp(-np.clip(evidence(p, sizes) @ model.score, -30, 30)))
    if not spans:
        return score, None
    found, at = [], 0
    for text, s in zip(texts, sizes, strict=True):
        hot = p[at : at + s] >= 0.5
        at += s
        out: list[tuple[int, int]] = []
        if hot.any():
            for k, w in enumerate(WORD.finditer(text if len(text) == len(text.lower()) else text.lower())):
                if k < s and hot[k]:
                    if k and hot[k - 1]:
                        out[-1] = (out[-1][0], w.end())
                    else:
                        out.append((w.start(), w.end()))
        found.append(out)
    return score, found


def training_rows(docs: DataFrame, labels: DataFrame, toxic: int, clean: int, longest: int) -> DataFrame:
    """(doc_id, text, toxic) of at most ``toxic`` + ``clean`` labelled texts of at most ``longest`` characters, the first by a hash of doc_id.

    Only rows whose crc32(doc_id as text) mod 3 is not 1 are used.
    """
    usable = labels.where("doc_id is not null and toxic is not null and crc32(cast(doc_id as string)) % 3 <> 1").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    ids = None
    for label, most in ((1, toxic), (0, clean)):
        some = usable.where(F.col("toxic") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
        ids = some if ids is None else ids.unionByName(some)
    texts = docs.select("doc_id", "text").where(F.length("text") <= longest).join(F.broadcast(ids), "doc_id")  # at most toxic + clean rows
    return texts.dropDuplicates(["doc_id"]).select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("toxic").cast("int").alias("toxic"))


def hash_order(doc_id: int) -> int:
    """A fixed shuffle of ids."""
    return (int(doc_id) * 0x9E3779B97F4A7C15 + 0x7F4A7C15) & 0xFFFFFFFF


def train(docs: DataFrame, labels: DataFrame, toxic: int = 1000, clean: int = 1500, longest: int = 32768) -> Field:
    """The field fitted on a bounded sample of labelled rows (see ``training_rows``), in one task; the driver gets the field alone."""

    def fitted(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = list(frames)  # the bounded sample
        if not held:
            return
        rows = pd.concat(held, ignore_index=True)
        rows = rows.assign(order=[hash_order(i) for i in rows["doc_id"]]).sort_values(["order", "doc_id"]).drop_duplicates("text")
        # in a process of its own, so that what fitting takes is given back and does not stay with Spark's worker
        with ProcessPoolExecutor(1, multiprocessing.get_context("fork")) as apart:
            model = apart.submit(fit, rows["text"].tolist(), rows["toxic"].astype(int).tolist()).result()
        yield pd.DataFrame({"field": [pickle.dumps(model)]})

    found = training_rows(docs, labels, toxic, clean, longest).repartition(1).mapInPandas(fitted, "field binary").collect()
    return pickle.loads(bytes(found[0]["field"])) if found else fit([], [])


def score_toxicity(docs: DataFrame, model: Field, spans: bool = True) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted (score >= 0.7), and with ``spans`` the toxic spans.

    Every whole text is scored as one chain, however long. Null and empty texts have no evidence and get the score of none; a row
    without doc_id is not held out; repeated rows repeat, with equal scores; a score of just 0.7 is predicted; an empty table has no
    rows; other columns are ignored and no input of the score.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        emissions = _Emissions(shared.value)
        for batch, texts in blocks(batches, "text", 2 << 20):
            s, found = score_texts([t.decode() for t in texts], shared.value, emissions, spans)
            cols = [batch.column(0), pa.array(s)]
            if spans:
                cols.append(pa.array([[{"start": a, "end": b} for a, b in x] for x in found], type=pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))))
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "score", "spans"][: len(cols)])

    scored = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(score, "doc_id long, score double" + ", spans array<struct<start int, end int>>" * spans)
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), *["spans"] * spans)


def drop_toxic(docs: DataFrame, model: Field, threshold: float = 0.7) -> DataFrame:
    """``docs`` without those of ``threshold`` or more; all columns stay, and so do rows without text."""
    shared, names = docs.sparkSession.sparkContext.broadcast(model), docs.columns

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        emissions = _Emissions(shared.value)
        for batch, texts in blocks(batches, "text", 2 << 20):
            s, _ = score_texts([t.decode() for t in texts], shared.value, emissions, spans=False)
            yield batch.select(names).filter(pa.array(s < threshold))

    return docs.mapInArrow(keep, docs.schema)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_toxicity(docs, train(docs, table(spark, sf_dir, "labels"))).withColumn("n_spans", F.size("spans"))
