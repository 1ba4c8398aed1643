"""Nearest neighbours by several shifted Hilbert curves.

All vectors are rotated by one fixed random rotation. Each of ``curves`` orderings looks at two of the rotated
coordinates, spread evenly, shifted, and ordered along a Hilbert curve whose keys are cut into ranges of equal
share. A query goes to the ``probes`` curves whose coordinates hold most of it, there to its own range and its
neighbours, and is compared in double precision with everything in them; the best of all windows are merged.
Cells with many rows or many queries are split in blocks, so no task holds more than one block of each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import materialize, stream64, table

_BITS = 10
_ROWS, _QUERIES = 20_000, 4_000  # a block


def hilbert_key(x: np.ndarray, y: np.ndarray, bits: int = _BITS) -> np.ndarray:
    """Places along the Hilbert curve of a grid of 2**bits by 2**bits cells."""
    x, y, key = x.astype(np.int64), y.astype(np.int64), np.zeros(len(x), dtype=np.int64)
    for b in range(bits - 1, -1, -1):
        rx, ry = (x >> b) & 1, (y >> b) & 1
        key += ((3 * rx) ^ ry) << (2 * b)
        low = (1 << b) - 1
        x, y = x & low, y & low
        flip = (ry == 0) & (rx == 1)
        x, y = np.where(flip, low - x, x), np.where(flip, low - y, y)
        x, y = np.where(ry == 0, y, x), np.where(ry == 0, x, y)
    return key


class Curves:
    """The orderings for vectors of ``dim`` numbers."""

    def __init__(self, dim: int, curves: int):
        rng = np.random.default_rng(20_240 + dim)
        pairs = -(-2 * curves // dim)
        self.axes = np.concatenate([np.linalg.qr(rng.normal(size=(dim, dim)))[0] for _ in range(pairs)], axis=1)[:, : 2 * curves]
        self.shift = (stream64(2 * curves, 5) >> np.uint64(11)).astype(float) / 2**53 * 0.25
        self.spread = 1.4 / np.sqrt(max(1, dim)) * 1.1

    def place(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Keys (n, curves) and the share of each vector that each curve's coordinates hold."""
        y = unit @ self.axes
        share = y[:, 0::2] ** 2 + y[:, 1::2] ** 2 if y.shape[1] > 1 else y**2
        cell = np.clip(((np.tanh(y / self.spread) + 1) / 2 * 0.75 + self.shift[: y.shape[1]]) * (1 << _BITS), 0, (1 << _BITS) - 1).astype(np.int64)
        return np.stack([hilbert_key(cell[:, 2 * k], cell[:, 2 * k + 1]) for k in range(share.shape[1])], axis=1), share


def scaled(x: np.ndarray) -> np.ndarray:
    """Vectors along the last axis, brought near 1 by a power of two: nothing is rounded, and no square overflows or vanishes."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=-1, keepdims=True, initial=0.0))[1])


def _valid(vectors: DataFrame) -> DataFrame:
    """Rows that take part, as (vec_id, embedding of doubles)."""
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).where("vec_id is not null and size(embedding) > 0")
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.where(fine & F.exists("embedding", lambda x: x != 0))


def nearest(vectors: DataFrame, every: int = 50, k: int = 5, curves: int = 16, probes: int = 8, ranges: int = 40, beside: int = 3, sample: int = 20_000, least: int = 150) -> DataFrame:
    """The ``k`` nearest by cosine of each row whose vec_id is divisible by ``every``: query_id, rank, vec_id, score.

    Ties go to the smaller vec_id; a query never finds its own vec_id; vectors are compared with those of their
    own length only. Rows without vec_id, and vectors that are null, empty, zero or hold null or non-finite numbers, take no
    part. Repeated rows count once. The ranges are fitted on at most ``sample`` vectors, chosen by a hash of vec_id;
    every row is indexed. A range holds ``least`` sample vectors or more, so tables of under 6,000 have fewer ranges than ``ranges``, and below
    1,050 (seven ranges) all windows cover everything. A query with fewer than ``k`` candidates gets all of them. Vectors may be of any
    finite size. An empty table has no result. Other columns are ignored.
    """
    spark = vectors.sparkSession
    v = _valid(vectors)
    share = min(1.0, 1.1 * sample / max(1, v.count()))
    fitted = v.where(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30)) < int(share * (1 << 30))).select("embedding").limit(sample).toPandas()["embedding"]
    bounds: dict[int, np.ndarray] = {}
    for dim in {len(x) for x in fitted}:
        rows = scaled(np.stack([x for x in fitted if len(x) == dim]))
        keys, _ = Curves(dim, curves).place(rows / np.linalg.norm(rows, axis=1, keepdims=True))
        cuts = max(1, min(ranges, len(rows) // least))
        bounds[dim] = np.quantile(keys, np.arange(1, cuts) / cuts, axis=0, method="inverted_cdf") if cuts > 1 else np.zeros((0, curves))
    shared = spark.sparkContext.broadcast(bounds)  # curves x ranges numbers for each length

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict[int, Curves] = {}
        for batch in batches:
            ids, values = batch.column(0).to_numpy(), batch.column(1)
            sizes = np.diff(values.offsets.to_numpy())
            flat, starts = values.values.to_numpy(), values.offsets.to_numpy()[:-1]
            for dim in np.unique(sizes).tolist():
                at = np.flatnonzero(sizes == dim)
                x = scaled(flat[starts[at][:, None] + np.arange(dim)])
                x = x / np.linalg.norm(x, axis=1, keepdims=True)
                keys, share = made.setdefault(dim, Curves(dim, curves)).place(x)
                cuts = shared.value.get(dim, np.zeros((0, curves)))
                cell = np.stack([np.searchsorted(cuts[:, c], keys[:, c], side="left") for c in range(curves)], axis=1).astype(np.int32)
                best = np.argsort(-share, axis=1, kind="stable")[:, :probes].astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[at]), values.take(pa.array(at)), pa.array(list(cell), type=pa.list_(pa.int32())), pa.array(list(best), type=pa.list_(pa.int32()))], names=["vec_id", "embedding", "cells", "best"]
                )

    placed = materialize(v.dropDuplicates().mapInArrow(cells, "vec_id long, embedding array<double>, cells array<int>, best array<int>"), "placed")
    rows = placed.select("vec_id", "embedding", F.size("embedding").alias("dim"), F.posexplode("cells").alias("curve", "cell"))
    last = F.create_map(F.lit(0), F.lit(0), *[x for d, b in bounds.items() for x in (F.lit(d), F.lit(len(b)))])
    asked = placed.where(F.col("vec_id") % every == 0).select("vec_id", "embedding", F.size("embedding").alias("dim"), "cells", F.explode("best").alias("curve"))
    asked = asked.withColumn("own", F.element_at("cells", F.col("curve") + 1)).withColumn("end", F.coalesce(F.element_at(last, F.col("dim")), F.lit(0)))
    asked = asked.select("vec_id", "embedding", "dim", "curve", F.explode(F.sequence(F.greatest(F.lit(0), F.col("own") - beside), F.least(F.col("end"), F.col("own") + beside))).alias("cell"))
    cell = ["dim", "curve", "cell"]
    # a cell's blocks: rows are dealt out to row blocks, queries to query blocks, each meeting all of the other
    split = rows.groupBy(*cell).agg(F.ceil(F.count("*") / _ROWS).cast("int").alias("r")).join(asked.groupBy(*cell).agg(F.ceil(F.count("*") / _QUERIES).cast("int").alias("q")), cell)
    split = materialize(split, "split")
    own = F.xxhash64("vec_id")
    blocks = ["dim", "curve", "cell", "rb", "qb"]
    rows = rows.join(split, cell).select(*cell, F.pmod(own, "r").cast("int").alias("rb"), F.explode(F.sequence(F.lit(0), F.col("q") - 1)).alias("qb"), F.lit(1).alias("role"), "vec_id", "embedding")
    asked = asked.join(split, cell).select(*cell, F.explode(F.sequence(F.lit(0), F.col("r") - 1)).alias("rb"), F.pmod(own, "q").cast("int").alias("qb"), F.lit(0).alias("role"), "vec_id", "embedding")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, ids, held = None, [], []  # the block's queries, then its rows batch by batch
        matrix, best = None, None

        def result() -> pa.RecordBatch:
            found = [(q, i, s) for q, b in zip(ids, best or (), strict=False) for s, i in b]
            return pa.RecordBatch.from_arrays([pa.array([f[c] for f in found], type=t) for c, t in ((0, pa.int64()), (1, pa.int64()), (2, pa.float64()))], names=["query_id", "vec_id", "score"])

        for batch in batches:
            names = np.stack([batch.column(i).to_numpy() for i in range(5)], axis=1)
            role, vec, values = batch.column(5).to_numpy(), batch.column(6).to_numpy(), batch.column(7)
            offsets, flat = values.offsets.to_numpy(), values.values.to_numpy()
            step = np.flatnonzero((names[1:] != names[:-1]).any(axis=1) | (role[1:] != role[:-1])) + 1
            for a, b in zip([0, *step.tolist()], [*step.tolist(), len(vec)], strict=True):
                if a == b:
                    continue
                if block != tuple(names[a]):
                    if block is not None and best:
                        yield result()
                    block, ids, held, matrix, best = tuple(names[a]), [], [], None, None
                x = flat[offsets[a] : offsets[b]].reshape(b - a, -1)
                if role[a] == 0:
                    ids += vec[a:b].tolist()
                    held.append(x)
                    continue
                if not held:
                    continue
                if matrix is None:
                    matrix, best = np.concatenate(held), [[] for _ in ids]
                _better(matrix, ids, best, x, vec[a:b], k)
        if block is not None and best:
            yield result()

    together = asked.unionByName(rows).repartition(*blocks).sortWithinPartitions(*blocks, "role")
    found = together.mapInArrow(search, "query_id long, vec_id long, score double").distinct()
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosine along the last axis, in double precision, the same for a pair wherever it is computed, whatever the vectors' sizes."""
    a, b = scaled(a), scaled(b)
    return (a * b).sum(axis=-1) / (np.sqrt((a * a).sum(axis=-1)) * np.sqrt((b * b).sum(axis=-1)))


def _better(queries: np.ndarray, ids: list[int], best: list, rows: np.ndarray, vec: np.ndarray, k: int) -> None:
    """Take the k best of ``rows`` into each query's list of (score, vec_id), best first."""
    queries, rows = scaled(queries), scaled(rows)
    unit = lambda x: x / np.sqrt((x * x).sum(axis=1, keepdims=True))
    right = unit(rows).T
    for low in range(0, len(queries), 256):
        rough = unit(queries[low : low + 256]) @ right
        for i, s in enumerate(rough, low):
            need = np.partition(s, -k - 1)[-k - 1] if len(s) > k + 1 else -2.0
            if len(best[i]) == k:
                need = max(need, best[i][-1][0])
            at = np.flatnonzero((s >= need - 1e-9) & (vec != ids[i]))
            if not len(at):
                continue
            exact = cosine(queries[i], rows[at])
            top = np.lexsort((vec[at], -exact))[:k]
            best[i] = sorted(best[i] + list(zip(exact[top].tolist(), vec[at][top].tolist(), strict=True)), key=lambda x: (-x[0], x[1]))[:k]


def op8_hilbert_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))
