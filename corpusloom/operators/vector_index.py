"""A persisted inverted-file index of vectors: cells around centroids, exact ranking inside the cells that a query visits.

    <path>/centroids        (cell, centroid), at most ``cells`` rows
    <path>/items/cell=C     (id, embedding) of every item, appended to as items come
    <path>/meta             (dim, probes): the vectors' length, and how many cells a query visits

Centroids are fitted on a bounded sample; every item is filed. ``probes`` is measured when the index is built: of the nearest items of a bounded set of
queries, found exactly, so many cells have the wanted share. The exact search over all items stays ``embedding.nearest``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators.embedding import nearest


def unit_rows(vectors: list) -> np.ndarray:
    x = np.asarray(vectors, dtype=np.float64)
    length = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return np.divide(x, length, out=np.zeros_like(x), where=length > 0)


def fit_centroids(x: np.ndarray, cells: int, rounds: int = 10, seed: int = 1) -> np.ndarray:
    """Spherical k-means of unit rows; a cell that loses all its rows takes the row that is farthest from its centroid."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(cells, len(x)), replace=False)]
    for _ in range(rounds):
        scores = x @ c.T
        of, best = scores.argmax(axis=1), scores.max(axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, of, x)
        far = iter(np.argsort(best))
        for empty in np.flatnonzero(np.bincount(of, minlength=len(c)) == 0):
            sums[empty] = x[next(far)]
        c = unit_rows(sums)
    return c


def with_cells(df: DataFrame, centroids: np.ndarray, probes: int = 1) -> DataFrame:
    """``df`` (.., embedding) with ``cells``: the ``probes`` nearest cells, nearest first. Vectors that are null, zero, of another length or not finite have null."""
    dim = centroids.shape[1]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = batch.column(batch.schema.get_field_index("embedding"))
            rows = np.flatnonzero(pc.fill_null(pc.equal(pc.list_value_length(v), dim), False).to_numpy(zero_copy_only=False))
            out: list = [None] * len(batch)
            if len(rows):
                x = v.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
                good = np.isfinite(x).all(axis=1) & (np.abs(x).sum(axis=1) > 0)
                rows, scores = rows[good], x[good] @ centroids.T
                for i, order in zip(rows.tolist(), np.argsort(-scores, axis=1, kind="stable")[:, :probes].tolist(), strict=True):
                    out[i] = order
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, type=pa.list_(pa.int32()))], names=[*batch.schema.names, "cells"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.mapInArrow(assign, f"{schema}, cells array<int>")


@dataclass(frozen=True)
class VectorIndex:
    path: str

    def build(self, items: DataFrame, cells: int = 64, sample: int = 20_000, queries: int = 200, k: int = 10, share: float = 0.97, seed: int = 1) -> None:
        """File ``items`` (id, embedding) below the path, which must be new.

        At most ``sample`` items, those of smallest hash, fit the centroids, and ``queries`` of them measure the probes: as many as hold ``share`` of the ``k`` nearest other items of each.
        Vectors of the most frequent length take part.
        """
        good = items.where("embedding is not null and size(embedding) > 0").select("id", F.transform("embedding", lambda x: x.cast("double")).alias("embedding"))
        sized = good.groupBy(F.size("embedding").alias("dim")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dim").first()
        if sized is None:
            raise ValueError("no vectors to index")
        good = good.where(F.size("embedding") == sized["dim"])
        some = good.orderBy(F.xxhash64("id", F.lit(seed))).limit(sample)
        rows = some.collect()  # ``sample`` at most
        x = unit_rows([r["embedding"] for r in rows])
        centroids = fit_centroids(x[np.isfinite(x).all(axis=1) & (np.abs(x).sum(axis=1) > 0)], cells, seed=seed)
        spark = items.sparkSession
        spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centroids)], "cell int, centroid array<double>").coalesce(1).write.parquet(f"{self.path}/centroids")
        self._file(items, centroids)
        asked = spark.createDataFrame([(r["id"], r["embedding"]) for r in rows[:queries]], good.select(F.col("id").alias("query_id"), "embedding").schema)
        found = nearest(asked, self._items(spark).select("id", "embedding"), k + 1, -1.0).where("query_id <> id and rank <= " + str(k + 1))
        placed = found.join(self._items(spark).select("id", "cell"), "id").join(with_cells(asked, centroids, len(centroids)).select("query_id", "cells"), "query_id")
        at = placed.groupBy(F.array_position("cells", F.col("cell")).alias("at")).agg(F.count("*").alias("n")).orderBy("at").collect()  # a row for each cell at most
        total, held, probes = sum(r["n"] for r in at), 0, len(centroids)
        for r in at:
            held += r["n"]
            if held >= share * total:
                probes = int(r["at"])
                break
        spark.createDataFrame([(sized["dim"], probes)], "dim int, probes int").coalesce(1).write.parquet(f"{self.path}/meta")

    def _file(self, items: DataFrame, centroids: np.ndarray) -> None:
        placed = with_cells(items.select("id", F.transform("embedding", lambda x: x.cast("float")).alias("embedding")), centroids)
        placed.where("cells is not null").select("id", "embedding", F.col("cells")[0].alias("cell")).hint("rebalance", "cell").write.mode("append").partitionBy("cell").parquet(f"{self.path}/items")

    def _items(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.path}/items")

    def _centroids(self, spark: SparkSession) -> np.ndarray:
        rows = spark.read.parquet(f"{self.path}/centroids").orderBy("cell").collect()  # ``cells`` at most
        return np.asarray([r["centroid"] for r in rows])

    def append(self, items: DataFrame) -> None:
        """File more items; centroids and probes stay."""
        self._file(items, self._centroids(items.sparkSession))

    def search(self, queries: DataFrame, k: int, floor: float = -1.0, probes: int | None = None) -> DataFrame:
        """Per query (query_id, embedding) the ``k`` items of highest cosine, at least ``floor``, of the cells it visits: query_id, id, score, rank; ties by id. All cells make it exact."""
        spark = queries.sparkSession
        n = probes or spark.read.parquet(f"{self.path}/meta").first()["probes"]
        asked = with_cells(queries.select("query_id", "embedding"), self._centroids(spark), n).where("cells is not null").select("query_id", "embedding", F.explode("cells").alias("cell"))
        return nearest(asked, self._items(spark), k, floor, within="cell")


def recall_of(found: DataFrame, exact: DataFrame) -> float:
    """The share of the pairs (query_id, id) of ``exact`` that ``found`` has too."""
    pairs = exact.select("query_id", "id").distinct()
    got = pairs.join(found.select("query_id", "id").distinct(), ["query_id", "id"], "left_semi")
    n = pairs.count()
    return got.count() / n if n else 1.0
