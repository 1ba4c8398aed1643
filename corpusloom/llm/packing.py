"""Packing: concatenate all documents' ids and cut the run into fixed windows.

Two passes. The first tokenizes each document once, writes its ids and, beside
them, the number of ids before it in its own partition. Partition totals are
then summed to give each partition's place in the whole (one row per
partition), and the second pass turns place into window and offset for every
row on its own. Only the last window can hold padding.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import blocks, materialize, table

#: Words of texts up to U+00FF after lower-casing; the classes are those of the tokenizer's own pattern in that range.
_LATIN_WORD = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zªµºß-öø-ÿ]+|[0-9²³¹¼-¾]|[^\\sa-zªµºß-öø-ÿ0-9²³¹¼-¾]+")
_RARE = ("\x1c", "\x1d", "\x1e", "\x1f", "<|")


def _is_latin(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


class Made(dict):
    """Values made on first use; emptied when it holds ``limit`` of them."""

    def __init__(self, make: Callable[[str], bytes], limit: int):
        super().__init__()
        self.make, self.limit = make, limit

    def __missing__(self, key: str) -> bytes:
        value = self.make(key)
        if len(self) >= self.limit:
            self.clear()
        self[key] = value
        return value


class TextIds:
    """Ids of texts as little-endian 16-bit bytes, exactly those of the tokenizer on the whole text.

    Words of lower-cased texts up to U+00FF are remembered and go straight to the tokenizer's merges. Texts
    beyond, where lower-casing and composing can depend on more than the word, go through it whole.
    """

    def __init__(self, path: str, limit: int = 300_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        self._encode, merges = tokenizer.encode, tokenizer.model.tokenize
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]  # byte-level BPE writes these bytes as themselves
        others = [b for b in range(256) if b not in plain]  # and these as U+0100 onwards
        shown = dict(zip(plain, plain, strict=True)) | {b: 256 + i for i, b in enumerate(others)}
        self._words = Made(lambda w: array("H", [t.id for t in merges(w.encode().decode("latin-1").translate(shown))]).tobytes(), limit)

    def whole(self, text: str) -> bytes:
        return np.asarray(self._encode(text, add_special_tokens=False).ids, dtype="<u2").tobytes()

    def __call__(self, text: str) -> bytes:
        if any(x in text for x in _RARE) or not _is_latin(text):
            return self.whole(text)
        return b"".join(map(self._words.__getitem__, _LATIN_WORD.findall(text.lower())))


def pack(docs: DataFrame, vocabulary: str, window: int = 2048, end_id: int = 1) -> DataFrame:
    """Pieces of documents in windows of ``window`` ids, each document closed by ``end_id``.

    Returns doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset. A null or empty text is the
    closing id alone; repeated rows are packed as often as they occur; further columns are ignored; an
    empty table gives no pieces.
    """

    def tokenize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, part, before = TextIds(vocabulary), TaskContext.get().partitionId(), 0
        closing = np.asarray([end_id], dtype="<u2").tobytes()
        for batch, texts in blocks(batches, "text", 4 << 20):
            ids = [ids_of(t.decode()) + closing for t in texts]
            sizes = np.asarray([len(x) // 2 for x in ids], dtype=np.int64)
            ends = before + np.cumsum(sizes)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.full(len(ids), part, dtype=np.int32)), pa.array(ends - sizes), pa.array(ids, type=pa.binary())],
                names=["doc_id", "part", "before", "ids"],
            )
            before = int(ends[-1])

    kept = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(tokenize, "doc_id long, part int, before long, ids binary")
    kept = materialize(kept, "ids")
    totals = kept.groupBy("part").agg(F.sum(F.octet_length("ids") / 2).cast("long").alias("n")).orderBy("part").collect()  # a row for each partition
    base = dict(zip([r["part"] for r in totals], np.concatenate([[0], np.cumsum([r["n"] for r in totals])]).tolist(), strict=False))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for doc, part, before, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ids = np.frombuffer(raw, dtype="<u2").astype("<u4")
                place, n, at = base[part] + before, len(ids), 0
                while at < n:
                    to = min(n, at + window - (place + at) % window)
                    out.append((doc, at, to - at, zlib.crc32(ids[at:to].tobytes()), n, (place + at) // window, (place + at) % window))
                    at = to
            cols = list(zip(*out, strict=True)) or [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, type=pa.int64()) for c in cols], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    return kept.select("doc_id", "part", "before", "ids").mapInArrow(cut, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
