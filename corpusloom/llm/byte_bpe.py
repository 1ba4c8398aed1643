"""Byte-level BPE encoding and decoding.

Spark counts the words of all documents and folds the ``frequent`` most frequent distinct ones to ids with
higher-order functions: ``aggregate`` merges, over an array of the word's bytes, the leftmost pair of lowest rank.
The rank table is a literal of that plan: an array of small maps, indexed by the hash of the piece, as one
map of 50,000 entries would be searched from end to end. The folded words, a bounded table, are broadcast; documents
are split into words by the whole pattern, whatever their letters, and put together from them in batches. Words beyond the table, and those of over
256 bytes, are merged where they occur, by the tokenizer library's merges, as folding them there costs more than the limits
allow (README). Decoding looks the ids up in the table of pieces and concatenates their bytes.
"""

from __future__ import annotations

import base64
import json
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import blocks, materialize, table

#: Longer words are left to the library, whose merges are not quadratic.
LONG = 256
#: The letters and numbers up to U+00FF, for a pattern of the standard module that splits such texts as the tokenizer's does.
_LETTERS, _NUMBERS = "A-Za-zªµºÀ-ÖØ-öø-ÿ", "0-9²³¹¼-¾"
_BEYOND = ("\x1c", "\x1d", "\x1e", "\x1f")  # white space to that module alone


@lru_cache(maxsize=4)
def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def _literal(value: object, schema: str) -> Column:
    """A constant of any type; the optimizer evaluates it once."""
    return F.from_json(F.lit(json.dumps({"v": value}, ensure_ascii=False)), f"v {schema}")["v"]


def _bucket(key: Column, buckets: int) -> Column:
    return F.pmod(F.crc32(key.cast("binary")), F.lit(buckets)).cast("int") + 1


def _buckets(entries: dict[str, object], buckets: int) -> list[dict[str, object]]:
    out: list[dict[str, object]] = [{} for _ in range(buckets)]
    for k, v in entries.items():
        out[zlib.crc32(k.encode()) % buckets][k] = v
    return out


class Encoder:
    """Columns that encode words by one rank table."""

    def __init__(self, ranks: dict[bytes, int], buckets: int = 1 << 15):
        self._buckets = buckets
        # a piece is written with a character for each byte, so that any bytes make a string
        self._ranks = _literal(_buckets({p.decode("latin-1"): r for p, r in ranks.items()}, buckets), "array<map<string,int>>")

    def rank(self, piece: Column) -> Column:
        return F.element_at(F.element_at(self._ranks, _bucket(piece, self._buckets)), piece)

    def fold(self, word: Column) -> Column:
        """The ids of a word."""

        def merge(acc: Column, _: Column) -> Column:
            p = acc["p"]
            n = F.size(p)
            pairs = F.zip_with(F.slice(p, F.lit(1), n - 1), F.slice(p, F.lit(2), n - 1), lambda x, y: F.concat(x, y))
            ranks = F.transform(pairs, self.rank)

            def at(r: Column) -> Column:
                k = F.array_position(r, F.array_min(r)).cast("int")
                joined = F.concat(F.slice(p, F.lit(1), k - 1), F.array(F.concat(F.element_at(p, k), F.element_at(p, k + 1))), F.slice(p, k + 2, n))
                return F.when(F.array_min(r).isNull(), F.struct(p.alias("p"), F.lit(False).alias("go"))).otherwise(F.struct(joined.alias("p"), F.lit(True).alias("go")))

            stop = F.struct(p.alias("p"), F.lit(False).alias("go"))
            return F.when(acc["go"] & (n > 1), F.element_at(F.transform(F.array(ranks), at), 1)).otherwise(stop)

        def ids(w: Column) -> Column:
            n = F.length(w)
            start = F.struct(F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(w, i, F.lit(1))).alias("p"), F.lit(True).alias("go"))
            folded = F.aggregate(F.sequence(F.lit(1), n), start, merge, lambda acc: F.transform(acc["p"], self.rank))
            whole = self.rank(w)
            return F.when(whole.isNotNull(), F.array(whole)).otherwise(folded)

        return F.element_at(F.transform(F.array(F.decode(word.cast("binary"), "ISO-8859-1")), ids), 1)


def frequent_words(docs: DataFrame, pattern: str, most: int) -> DataFrame:
    """The most frequent words of all documents, at most ``most``: all that are more frequent than a threshold.

    The threshold is read off a histogram of the logarithms of counts (sixteen steps for a doubling), so no task or driver sorts words.
    """
    words = docs.select(F.explode(F.regexp_extract_all("text", F.lit("(?U)" + pattern), F.lit(0))).alias("word"))
    counted = words.groupBy("word").agg(F.count("*").alias("n")).where(F.octet_length("word") <= LONG)
    counted = materialize(counted.select("word", F.floor(F.log2("n") * 16).cast("int").alias("step")), "counted")
    least, held = 0, 0
    for step, n in sorted(((r["step"], r["n"]) for r in counted.groupBy("step").agg(F.count("*").alias("n")).collect()), reverse=True):  # some hundred rows
        held += n
        if held > most:
            least = step + 1
            break
    return counted.where(F.col("step") >= least).select("word")


class Words(dict):
    """Ids of words as little-endian 32-bit bytes: those folded beforehand, and up to ``limit`` others made on first use."""

    def __init__(self, folded: dict[str, bytes], ranks_path: str, pattern: str, limit: int = 400_000):
        import tiktoken

        super().__init__(folded)
        self._folded, self._most = folded, len(folded) + limit
        ranks = load_ranks(ranks_path)
        self._encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.pieces = dict(zip(ranks.values(), ranks.keys(), strict=True))
        self._split = re.compile(_narrowed(pattern)).findall
        self._split_any = regex.compile(pattern).findall

    def __missing__(self, word: str) -> bytes:
        if len(self) >= self._most:
            self.clear()
            self.update(self._folded)
        self[word] = ids = np.asarray(self._encoding._encode_single_piece(word), dtype="<u4").tobytes()
        return ids

    def encode(self, text: str) -> bytes:
        try:
            text.encode("latin-1")
            split = self._split_any if any(x in text for x in _BEYOND) else self._split
        except UnicodeEncodeError:
            split = self._split_any
        return b"".join(map(self.__getitem__, split(text)))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.pieces.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


def _narrowed(pattern: str) -> str:
    """The tokenizer's pattern for texts up to U+00FF, with its classes of letters and numbers spelt out."""
    inside = pattern.replace(r"[^\s\p{L}\p{N}]", f"[^\\s{_LETTERS}{_NUMBERS}]")
    return inside.replace(r"\p{L}", f"[{_LETTERS}]").replace(r"\p{N}", f"[{_NUMBERS}]")


def encode(docs: DataFrame, ranks_path: str, pattern: str, frequent: int = 1 << 18) -> DataFrame:
    """doc_id, ids (little-endian 32-bit bytes) of each document's whole text, and decoded (the bytes they stand for).

    Null texts count as empty and have no ids; very long texts are encoded whole; a row without doc_id and repeated rows are encoded like any
    other; an empty table has no rows; further columns are ignored. Words of equal counts are in the table together or not at all. ``frequent`` bounds the table of words that Spark folds; it
    changes no result. ``pattern`` may use \\p{L} and \\p{N} alone or in [^\\s\\p{L}\\p{N}].
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    encoder = Encoder(load_ranks(ranks_path))
    words = materialize(frequent_words(docs, pattern, frequent), "words").repartition(spark.sparkContext.defaultParallelism)
    folded = words.select("word", encoder.fold(F.col("word")).alias("ids")).toArrow()  # at most ``frequent`` rows
    known = {w: np.asarray(i, dtype="<u4").tobytes() for w, i in zip(folded["word"].to_pylist(), folded["ids"].to_pylist(), strict=True)}
    shared = spark.sparkContext.broadcast(known)

    def put_together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words(shared.value, ranks_path, pattern)
        for batch, texts in blocks(batches, "text", 2 << 20):
            ids = [words.encode(t.decode()) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, type=pa.binary()), pa.array([words.decode(i) for i in ids], type=pa.binary())], names=["doc_id", "ids", "decoded"])

    return docs.mapInArrow(put_together, "doc_id long, ids binary, decoded binary")


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    out = encode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return out.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
