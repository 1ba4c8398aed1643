"""Entities and relations from model replies, and a user's model called in batches."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import text as T

ENTITIES = "array<struct<name: string, type: string, observations: array<string>>>"
#: Relations of replies name their ends ``from`` and ``to``.
RELATIONS = "array<struct<`from`: string, `to`: string, label: string>>"


def parse_replies(replies: DataFrame, reply: str = "reply") -> DataFrame:
    """``replies`` with ``entities`` and ``relations`` in place of the reply, parsed leniently: a broken or null one has none of either."""
    parsed = F.from_json(T.json_part(F.col(reply)), f"entities {ENTITIES}, relations {RELATIONS}")
    r = F.transform(parsed["relations"], lambda x: F.struct(x["from"].alias("src"), x["to"].alias("dst"), x["label"].alias("label")))
    none = F.array().cast("array<struct<src:string,dst:string,label:string>>")
    return replies.withColumn("entities", F.coalesce(parsed["entities"], F.array().cast(ENTITIES))).withColumn("relations", F.coalesce(r, none)).drop(reply)


def ingest_replies(replies: DataFrame, keys: list[str], source: str) -> tuple[DataFrame, DataFrame]:
    """Facts (.., ordinal, name, type, text, source) and relations (.., ordinal, src, dst, label) of replies (.., reply), with the column ``source`` as where each fact is from.

    Facts are one row for each observation, in order; an entity without any has one with a null text. Nameless entities, and relations that lack an end, are left out.
    """
    parsed = parse_replies(replies.select(*dict.fromkeys([*keys, source]), "reply"))
    named = lambda c: T.trim(F.coalesce(c, F.lit(""))) != ""
    e = parsed.select(*dict.fromkeys([*keys, source]), F.posexplode("entities").alias("at", "e")).where(named(F.col("e.name")))
    o = e.select(*keys, F.col(source).alias("source"), "at", "e.name", "e.type", F.posexplode_outer("e.observations").alias("nth", "text"))
    facts = o.select(*keys, F.struct("at", F.coalesce("nth", F.lit(0)).alias("nth")).alias("ordinal"), "name", "type", "text", "source")
    r = parsed.select(*keys, F.posexplode("relations").alias("ordinal", "r")).where(named(F.col("r.src")) & named(F.col("r.dst")))
    return facts, r.select(*keys, "ordinal", "r.src", "r.dst", "r.label")


def call_model(items: DataFrame, text: str, fn: Callable[[list[str]], list[str | None]], batch: int = 16, retries: int = 3, wait: float = 0.5) -> DataFrame:
    """``items`` with ``reply`` and ``error``: ``fn`` gets at most ``batch`` texts at a time. A batch that raises is tried again, waiting longer each time, then its items alone; what
    still fails has the error in place of a reply, and the rest goes on. Blank texts are not asked and have an empty reply."""

    def ask(texts: list[str], times: int) -> tuple[list[str | None], str | None]:
        for attempt in range(1, times + 1):
            try:
                got = fn(texts)
                if len(got) != len(texts):
                    raise ValueError(f"{len(got)} replies for {len(texts)} texts")
                return got, None
            except Exception as e:  # noqa: BLE001  whatever the user's function raises is the item's error
                error = f"{type(e).__name__}: {e}"
                if attempt < times:
                    time.sleep(wait * attempt)
        return [None] * len(texts), error

    def call(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            texts = pdf[text].fillna("").tolist()
            replies: list[str | None] = [""] * len(texts)
            errors: list[str | None] = [None] * len(texts)
            asked = [i for i, t in enumerate(texts) if t.strip()]
            for at in range(0, len(asked), batch):
                part = asked[at : at + batch]
                got, error = ask([texts[i] for i in part], retries)
                for k, i in enumerate(part):
                    replies[i], errors[i] = got[k], error
                    if error and len(part) > 1:
                        one, errors[i] = ask([texts[i]], 1)
                        replies[i] = one[0]
            yield pdf.assign(reply=replies, error=errors)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in items.schema.fields)
    return items.mapInPandas(call, f"{schema}, reply string, error string")


def extractor(fn: Callable[[list[str]], list[str | None]], text: str = "text", **options: float) -> Callable[[DataFrame], DataFrame]:
    """An extractor for ``Ingestion``: ``fn`` replies to texts, replies are parsed, and an item whose call failed has an error."""

    def extract(items: DataFrame) -> DataFrame:
        return parse_replies(call_model(items, text, fn, **options))

    return extract
