"""Helpers that the operators of this subpackage share.

Tables that a later step reads more than once are written as Parquet below
``spark.checkpoint.dir`` (the folder that driver and executors share), so a
lost executor costs at most the tasks it ran.
"""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_written: list[tuple[SparkSession, str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The given table ``name``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a temporary folder only where it is unset and the master is local."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = "file://" + tempfile.mkdtemp(prefix="corpusloom-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def materialize(df: DataFrame, name: str = "t") -> DataFrame:
    """Write ``df`` below the shared folder and return a DataFrame that reads it (cuts the lineage)."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/corpusloom/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


@atexit.register
def _remove_written() -> None:
    for spark, path in _written:
        try:
            jvm = spark.sparkContext._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # noqa: BLE001  the session may be gone at exit
            return


def row_key(*cols: str) -> Column:
    """64-bit key of a row's content; equal rows share it, nulls included."""
    return F.xxhash64(*[F.struct(F.col(c), F.col(c).isNull()) for c in cols])


def binary_column(col: pa.Array) -> pa.Array:
    """Texts as UTF-8 bytes; null counts as empty."""
    return pc.fill_null(col.cast(pa.large_binary()), b"")


def blocks(batches: Iterator[pa.RecordBatch], text: str, max_bytes: int = 1 << 20) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of the batches whose texts hold about ``max_bytes`` (one longer text stands alone), with those texts."""
    for batch in batches:
        col = binary_column(batch.column(batch.schema.get_field_index(text)))
        ends = np.cumsum(pc.binary_length(col).to_numpy(zero_copy_only=False))
        at = 0
        while at < len(batch):
            low = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, low + max_bytes, side="right")))
            yield batch.slice(at, to - at), col.slice(at, to - at).to_pylist()
            at = to


# 64-bit hashing of byte strings in numpy -------------------------------------------------


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (multiply and shift)."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def stream64(n: int, seed: int) -> np.ndarray:
    """n fixed pseudo-random 64-bit values."""
    return mix64(mix64(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)))


#: A Mersenne prime, so that remainders are shifts and sums; two bases make 62 bits.
_P = np.uint64((1 << 31) - 1)
_BASES = (0x3A8F05C5, 0x6B4E2D19)
_powers: list[tuple[np.ndarray, np.ndarray]] = []


def _reduced(x: np.ndarray) -> np.ndarray:
    """Remainders modulo _P of numbers below 2**62."""
    x = (x & _P) + (x >> np.uint64(31))
    x = (x & _P) + (x >> np.uint64(31))
    return np.where(x == _P, np.uint64(0), x)


def _power_tables(n: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each base its powers and those of its inverse, ``n`` at least, made by doubling."""
    if not _powers or len(_powers[0][0]) < n:
        size, made = max(n, 1 << 21), []
        for base in _BASES:
            tables = []
            for r in (base, pow(base, -1, int(_P))):
                p = np.ones(1, dtype=np.uint64)
                while len(p) < size:
                    p = np.concatenate([p, _reduced(p * np.uint64(pow(r, len(p), int(_P))))])
                tables.append(p[:size].astype(np.uint32))
            made.append((tables[0], tables[1]))
        _powers[:] = made
    return _powers


class Substrings:
    """Hashes of substrings of one buffer in constant time each, by polynomial prefix sums modulo a prime, for two bases.

    Two different strings of n bytes share a hash by chance alone, at most (n / 2**31)**2 of the pairs of bases.
    """

    def __init__(self, buf: np.ndarray, lower: bool = False, seed: int = 7):
        self._sums = []
        self._tables = _power_tables(len(buf) + 1)
        for k, (up, _) in enumerate(self._tables):
            values = _reduced(stream64(256, seed + k) >> np.uint64(2))
            if lower:
                values[65:91] = values[97:123]
            x = values[buf]
            x *= up[: len(buf)]
            high = x >> np.uint64(31)
            x &= _P
            x += high  # below 2**32: sums of 2**30 of them can be reduced
            sums = np.zeros(len(buf) + 1, dtype=np.uint64)
            np.cumsum(x, out=sums[1:])
            self._sums.append(sums)

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        one, two = (_reduced(_reduced(sums[end] - sums[start]) * down[start]) for sums, (_, down) in zip(self._sums, self._tables, strict=True))
        return mix64(((one << np.uint64(31)) | two) ^ mix64((end - start).astype(np.uint64)))


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


# Words and shingles ----------------------------------------------------------------------

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words ``[^\\x20\\x09-\\x0D]+`` (A-Z lower-cased) and the word count of each text."""
    buf = np.frombuffer(b" ".join(texts) + b" ", dtype=np.uint8)
    inside = ~_SPACE[buf]
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if inside[0]:
        edge = np.concatenate([[0], edge])
    starts, ends = edge[0::2], edge[1::2]
    text_ends = np.cumsum([len(t) + 1 for t in texts])
    counts = np.diff(np.searchsorted(starts, text_ends), prepend=0)
    return Substrings(buf, lower=True)(starts, ends), counts


def shingle_sets(texts: list[bytes], k: int = 5) -> list[np.ndarray]:
    """Sorted distinct k-word shingle hashes of each text; fewer than k words make one shingle, none make none."""
    words, counts = word_hashes(texts)
    odd = stream64(k, 99) | np.uint64(1)
    n = len(words)
    out = []
    if n >= k:
        rolled = np.zeros(n - k + 1, dtype=np.uint64)
        for i in range(k):
            rolled += words[i : n - k + 1 + i] * odd[i]
        rolled = mix64(rolled)
    at = 0
    for c in counts.tolist():
        if c >= k:
            s = np.sort(rolled[at : at + c - k + 1])
            if len(s) > 1:
                s = s[np.concatenate([[True], s[1:] != s[:-1]])]
            out.append(s)
        elif c:
            out.append(mix64((words[at : at + c] * odd[:c]).sum(keepdims=True) + np.uint64(c)))
        else:
            out.append(words[:0])
        at += c
    return out


# Connected components --------------------------------------------------------------------


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of ``edges`` (a, b): rows (v, root), root being the smallest vertex of the component.

    Labels move along the edges and then jump to their label's label, so the number of rounds grows with
    the logarithm of a component's width. Every round is written to the shared folder.
    """
    both = materialize(
        edges.where("a <> b").select("a", "b").union(edges.where("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges"
    )
    labels = materialize(both.groupBy(F.col("a").alias("v")).agg(F.least(F.min("b"), F.first("a")).alias("root")), "labels")
    for _ in range(max_rounds):
        near = both.join(labels.select(F.col("v").alias("b"), "root"), "b").groupBy(F.col("a").alias("v")).agg(F.min("root").alias("near"))
        moved = labels.join(near, "v").select("v", "root", F.least("root", "near").alias("now"))
        jump = labels.select(F.col("v").alias("now"), F.col("root").alias("further"))
        new = materialize(moved.join(jump, "now").select("v", F.least("now", "further").alias("root"), (F.least("now", "further") != F.col("root")).alias("changed")), "labels")
        labels = new.select("v", "root")
        if not new.where("changed").limit(1).count():
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return labels
