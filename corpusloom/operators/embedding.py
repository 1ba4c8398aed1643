"""Vectors: a lexical embedding by feature hashing, user functions in batches, and cosine search."""

from __future__ import annotations

import re
import time
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

DIM = 1024  # fixed values of the lexical vectors: dimension and the constants of the 64-bit FNV-1a hash
FNV_OFFSET, FNV_PRIME = 0xCBF29CE484222325, 0x100000001B3
_WORD = re.compile(r"[^\W_]+")


@dataclass(frozen=True)
class RecallOptions:
    """Thresholds and sizes of a recall."""

    floor: float = 0.30
    seeds: int = 8
    candidates: int = 30
    kept: int = 5
    hops: int = 1

    @staticmethod
    def for_model(lexical: bool) -> RecallOptions:
        return RecallOptions(floor=0.12 if lexical else 0.30)


def _place(term: str) -> tuple[int, float]:
    h = FNV_OFFSET
    for b in term.encode():
        h = ((h ^ b) * FNV_PRIME) & 0xFFFFFFFFFFFFFFFF
    return h % DIM, -1.0 if h >> 63 else 1.0


def term_counts(text: str) -> Counter:
    """Counts of 1- to 3-character grams and of words of the lower-cased text with single spaces."""
    t = " ".join(text.lower().split())
    terms: Counter = Counter()
    for n in (1, 2, 3):
        terms.update(f"{n}:{g}" for g in (t[i : i + n] for i in range(len(t) - n + 1)) if not g.isspace())
    terms.update("w:" + w for w in _WORD.findall(t))
    return terms


def term_frequency(texts: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, term, n): how often each word of letters and digits stands in each text."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{Nd}]+"), F.lit(0))
    return texts.select(key, F.explode(words).alias("term")).groupBy(key, "term").agg(F.count("*").alias("n"))


class Terms(dict):
    """Bucket and sign of terms, made on first use; emptied when full."""

    def __init__(self, limit: int = 400_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, term: str) -> tuple[int, float]:
        if len(self) >= self.limit:
            self.clear()
        self[term] = found = _place(term)
        return found


_terms = Terms()


def lexical_rows(texts: list[str]) -> np.ndarray:
    """A row of DIM numbers for each text: all texts' terms are placed, weighed and summed up together."""
    counts = [list(term_counts(t or "").items()) for t in texts]
    sizes = [len(c) for c in counts]
    placed = [_terms[term] for c in counts for term, _ in c]
    if not placed:
        return np.zeros((len(texts), DIM))
    place = np.asarray(placed)
    weight = place[:, 1] * (1 + np.log(np.asarray([n for c in counts for _, n in c], dtype=np.float64)))
    flat = np.bincount(np.repeat(np.arange(len(texts)), sizes) * DIM + place[:, 0].astype(np.int64), weight, minlength=len(texts) * DIM)
    rows = flat.reshape(len(texts), DIM)
    norm = np.sqrt((rows * rows).sum(axis=1, keepdims=True))
    return np.divide(rows, norm, out=np.zeros_like(rows), where=norm > 0)


def sparse_vector(text: str) -> dict[int, float]:
    """Bucket to weight, of length 1."""
    row = lexical_rows([text])[0]
    return {int(b): float(row[b]) for b in np.flatnonzero(row)}


def lexical_vectors(texts: list[str]) -> list[np.ndarray]:
    return list(lexical_rows(texts).astype(np.float32))


def embed_batch(df: DataFrame, text: str, fn: Callable[[list[str]], list] = lexical_vectors, batch: int = 96, retries: int = 3, wait: float = 0.5) -> DataFrame:
    """``df`` with ``embedding``: ``fn`` gets at most ``batch`` texts at a time; errors are tried again, waiting longer each time."""

    def embed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            out: list = []
            texts = pdf[text].fillna("").tolist()
            for at in range(0, len(texts), batch):
                part = texts[at : at + batch]
                for attempt in range(1, retries + 1):
                    try:
                        got = fn(part)
                        break
                    except Exception:
                        if attempt == retries:
                            raise
                        time.sleep(wait * attempt)
                if len(got) != len(part):
                    raise ValueError(f"{len(got)} vectors for {len(part)} texts")
                out += got
            yield pdf.assign(embedding=out)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.mapInPandas(embed, f"{schema}, embedding array<float>")


def embed_sparse(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, bucket, weight) of each text's lexical vector, so that cosine is a join on bucket."""
    kind = df.schema[key].dataType.simpleString()

    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            found = [(k, b, v) for k, t in zip(pdf[key], pdf[text], strict=True) for b, v in sparse_vector(t or "").items()]
            yield pd.DataFrame(found, columns=[key, "bucket", "weight"])

    return df.select(key, text).mapInPandas(rows, f"`{key}` {kind}, bucket int, weight double")


def nearest(queries: DataFrame, items: DataFrame, k: int, floor: float, a_block: int = 20_000, together: int = 4096, within: str | None = None) -> DataFrame:
    """Per query (query_id, embedding) the ``k`` items (id, embedding) of highest cosine, at least ``floor``: score and rank; ties by id.

    Exact: every query meets every item, or those of its own value of the column ``within``. Items are dealt to blocks of about ``a_block``
    and queries to blocks of about ``together``; a task multiplies one block by the other, batch by batch, and a window merges the
    blocks' best. Empty and zero vectors take no part; vectors are compared with those of their own length.
    """
    kinds = {"query_id": queries.schema["query_id"].dataType, "id": items.schema["id"].dataType}
    group = F.xxhash64(within) if within else F.lit(0).cast("long")
    # vectors of one kind travel as they are, and are doubles where they are multiplied
    same = queries.schema["embedding"].dataType == items.schema["embedding"].dataType
    vector = F.col("embedding").alias("v") if same else F.transform("embedding", lambda x: x.cast("double")).alias("v")
    q = queries.where(F.size("embedding") > 0).select(group.alias("g"), "query_id", vector)
    v = items.where(F.size("embedding") > 0).select(group.alias("g"), "id", vector)
    # how many blocks each group has: a row for each group, one without ``within``; few items are spread over some tasks too
    n = F.count("*")
    parts = q.groupBy("g").agg(F.ceil(n / together).cast("int").alias("parts"))
    sizes = parts.join(v.groupBy("g").agg(F.greatest(F.ceil(n / a_block), F.least(F.ceil(n / 256), F.lit(32))).cast("int").alias("blocks")), "g")
    q, v = q.join(sizes, "g"), v.join(sizes, "g")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = lambda key, n: F.pmod(F.xxhash64(key), F.col(n)).cast("int")
    q = q.select("g", every("blocks").alias("block"), own("query_id", "parts").alias("part"), F.lit(0).alias("role"), "query_id", F.lit(None).cast(kinds["id"]).alias("id"), "v")
    v = v.select("g", own("id", "blocks").alias("block"), every("parts").alias("part"), F.lit(1).alias("role"), F.lit(None).cast(kinds["query_id"]).alias("query_id"), "id", "v")
    met = q.unionByName(v).repartition("g", "block", "part").sortWithinPartitions("g", "block", "part", "role")
    schema = f"query_id {kinds['query_id'].simpleString()}, id {kinds['id'].simpleString()}, score double"

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[list, list]] = {}  # the block's queries by length of vector
        block = None
        for batch in batches:
            types = [batch.schema.field("query_id").type, batch.schema.field("id").type]
            names = list(zip(batch.column("g").to_pylist(), batch.column("block").to_pylist(), batch.column("part").to_pylist(), batch.column("role").to_pylist(), strict=True))
            ids, vectors = (batch.column("query_id").to_pylist(), batch.column("id").to_pylist()), batch.column("v")
            at = 0
            while at < len(names):
                to = at
                while to < len(names) and names[to] == names[at]:
                    to += 1
                if names[at][:3] != block:
                    block, held = names[at][:3], {}
                part = vectors.slice(at, to - at)
                sizes, flat = pc.list_value_length(part).to_numpy(), part.flatten().to_numpy(zero_copy_only=False)
                starts = np.cumsum(sizes) - sizes
                for dim in np.unique(sizes).tolist():
                    rows = np.flatnonzero(sizes == dim)
                    x = flat[starts[rows][:, None] + np.arange(dim)].astype(np.float64)
                    length = np.sqrt((x * x).sum(axis=1))
                    rows, x = rows[length > 0], x[length > 0] / length[length > 0, None]
                    if names[at][3] == 0:
                        known = held.setdefault(dim, ([], []))
                        known[0].extend(ids[0][at + r] for r in rows)
                        known[1].append(x)
                    elif dim in held and len(rows):
                        yield _best(held[dim], [ids[1][at + r] for r in rows], x, k, floor, types)
                at = to

    found = met.mapInArrow(search, schema)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _best(known: tuple[list, list], ids: list, x: np.ndarray, k: int, floor: float, types: list) -> pa.RecordBatch:
    """Of the items ``x``, those that can be among a query's ``k`` best: its k-th score or more, and the floor."""
    scores = np.concatenate(known[1]) @ x.T
    least = np.partition(scores, -k, axis=1)[:, -k] if scores.shape[1] > k else np.full(len(scores), -2.0)
    q, i = np.nonzero(scores >= np.maximum(least, floor)[:, None])
    return pa.RecordBatch.from_arrays([pa.array([known[0][a] for a in q], type=types[0]), pa.array([ids[b] for b in i], type=types[1]), pa.array(scores[q, i])], names=["query_id", "id", "score"])
