"""The corpus pipeline: toxic documents go, repeated lines go, near copies go, private data is replaced, the rest is packed.

Every stage takes null, empty and very long texts, repeated rows, rows without doc_id, empty tables and further columns as
its operator's docstring says; all but the last return the columns of their input.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import materialize, table
from corpusloom.llm.jaccard_join import drop_near_copies
from corpusloom.llm.line_dedup import dedup_runs
from corpusloom.llm.packing import pack
from corpusloom.llm.pseudonyms import pseudonymize, session_key
from corpusloom.llm.toxicity import drop_toxic, train


def _as_documents(changed: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of ``docs``, with ``n_chars`` that of the present text."""
    return changed.select(*[F.length("text").cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(c) for c in docs.columns])


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is below 0.7."""
    return drop_toxic(docs, train(docs, table(spark, sf_dir, "labels")))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without later copies of repeated runs of lines; one of which nothing is left is a copy as a whole and goes.

    Documents that were null or empty before stay as they are.
    """
    changed = dedup_runs(docs)
    return _as_documents(changed.where((F.col("n_deleted") == 0) | (F.col("text") != "")), docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, judged on what the stages before have left of it."""
    return drop_near_copies(docs)


def pseudonyms(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, private values replaced; the key is the session's (``session_key``)."""
    return _as_documents(pseudonymize(docs, session_key(spark)), docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in windows of 2048 ids."""
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity),
    ("line_dedup", line_dedup),
    ("near_copies", near_copies),
    ("pseudonyms", pseudonyms),
    ("packing", packing),
]

#: Models, iteration and tokenizers are beyond SQL; the tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each one's result written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
