"""Line deduplication: the suffix array of the documents' line sequences, by distributed prefix doubling.

Every place in every document's sequence of lines begins a suffix. Suffixes are named by their first line; names
that stand in one place alone drop out, and each round names the others by twice as many lines, from the names of
two neighbouring stretches. Suffixes of one name form an interval of the suffix array with that common prefix; halving
steps downwards give every place the common prefix of its own interval, the longest run from there that is found again.

A run of any length is named by the two names of 2**j lines that cover it, so the same names tell which runs stand
further up in the order of (doc_id, place). Every line of such a later copy is deleted. A maximal run is the union of the
shortest stretches of the least size from and up to its lines, so only these are looked up.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from corpusloom.llm.common import Substrings, blocks, materialize, mix64, row_key, signed, stream64, table

_COUNTS = ("n_lines", "n_deleted", "n_runs", "longest_run")


def _keyed(docs: DataFrame) -> DataFrame:
    """(rk, doc, text): rows without doc_id come last."""
    return docs.select(row_key("doc_id", "text").alias("rk"), F.coalesce(F.col("doc_id").cast("long"), F.lit(2**63 - 1)).alias("doc"), "text")


def _split(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """All texts' lines in one buffer: the buffer, start and end of each line, its text, and each text's first line."""
    buf = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
    ends = np.flatnonzero(buf == 10)
    starts = np.concatenate([[0], ends[:-1] + 1])
    last = np.searchsorted(ends, np.cumsum([len(t) + 1 for t in texts]) - 1)
    first = np.concatenate([[0], last[:-1] + 1])
    return buf, starts, ends, np.repeat(np.arange(len(texts)), last - first + 1), first


def _lines(docs: DataFrame, min_bytes: int) -> DataFrame:
    """(rk, doc, place, name, size, to, back) of every line: its bytes, and how many lines the shortest stretches of ``min_bytes`` bytes from it and up to it have (0: none)."""

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch, texts in blocks(batches, "text"):
            # equal rows have the same places: a task tells them once
            new = [i for i, k in enumerate(batch.column(0).to_pylist()) if not (k in seen or seen.add(k))]
            if len(seen) > 200_000:
                seen.clear()
            if not new:
                continue
            batch, texts = batch.take(pa.array(new)), [texts[i] for i in new]
            buf, starts, ends, owner, first = _split(texts)
            n = np.arange(len(ends))
            last = np.searchsorted(ends, starts + min_bytes)
            fits = last < len(ends)
            fits[fits] = owner[last[fits]] == owner[fits]
            since = np.searchsorted(starts, ends - min_bytes, side="right") - 1
            back = since >= 0
            back[back] = owner[since[back]] == owner[back]
            cols = [batch.column(0).take(pa.array(owner)), batch.column(1).take(pa.array(owner)), pa.array((n - first[owner]).astype(np.int32)), pa.array(signed(Substrings(buf)(starts, ends)))]
            cols += [pa.array((ends - starts).astype(np.int32)), pa.array(np.where(fits, last - n + 1, 0).astype(np.int32)), pa.array(np.where(back, n - since + 1, 0).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(cols, names=["rk", "doc", "place", "name", "size", "to", "back"])

    return _keyed(docs).mapInArrow(name, "rk long, doc long, place int, name long, size int, to int, back int")


def _again(rows: DataFrame) -> DataFrame:
    """Names of ``rows`` (rk, doc, place, name) that stand in more than one place, with the first. Partial sums make hot names one
    row for each task; the result is written, so that a join on hot names is one that Spark can split."""
    at = F.struct("doc", "rk", "place")
    names = rows.groupBy("name").agg(F.min(at).alias("first"), F.max(at).alias("last")).where("first <> last").drop("last")
    return materialize(names, "names")


def _found_again(rows: DataFrame, finish: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """``rows`` whose name stands elsewhere too, each place once, with ``later``: it also stands further up."""
    later = F.struct("doc", "rk", "place") != F.col("first")
    # names grow with the input, so they are merged at every size, never broadcast
    found = rows.join(_again(rows).hint("merge"), "name").withColumn("later", later).drop("first")
    # dealt out anew, as repeats could not be dropped by name while Spark splits hot names
    return materialize(finish(found.repartition("rk").distinct()), "level")


def _of_long_runs(lines: DataFrame, min_bytes: int) -> DataFrame:
    """Lines that stand among neighbours which have ``min_bytes`` bytes with them: no others can be part of a run found again."""
    step = F.col("place") - F.row_number().over(Window.partitionBy("rk").orderBy("place"))
    total = F.sum(F.col("size") + 1).over(Window.partitionBy("rk", "step")) - 1
    return lines.withColumn("step", step).withColumn("total", total).where(F.col("total") >= min_bytes).drop("step", "total", "size")


def levels_of(lines: DataFrame, min_bytes: int) -> list[DataFrame]:
    """For 1, 2, 4, ... lines as long as there are any: the stretches found again, (rk, doc, place, name, below, later)."""
    held, out, k = lines.withColumn("below", F.lit(0).cast("long")), [], 1
    while True:
        level = _found_again(held, lambda df: df if out else _of_long_runs(df, min_bytes))
        if not level.limit(1).count():
            return out
        out.append(level)
        near = level.select("rk", (F.col("place") - k).alias("place"), F.col("name").alias("further"))
        held = level.join(near, ["rk", "place"]).select("rk", "doc", "place", F.xxhash64("name", "further").alias("name"), F.col("name").alias("below"))
        k *= 2


def common_prefixes(levels: list[DataFrame]) -> DataFrame:
    """(rk, place, k): the largest number of lines from that place that stand elsewhere too.

    Each place begins with the largest doubling that is found again and tries to lengthen its prefix by half of the
    last step. One representative of every longer prefix stays behind with the places that could not follow it, as
    these may still share a shorter part of it.
    """
    state = None
    for i, x in enumerate(levels):
        own = x if i + 1 == len(levels) else x.join(levels[i + 1].select("rk", "place"), ["rk", "place"], "left_anti")
        own = own.select("rk", "place", F.lit(1 << i).alias("k"), F.col("name").alias("node"), F.lit(True).alias("live"))
        state = own if state is None else state.unionByName(own)
        if i > 1:  # a prefix of one line has no step below it
            for_below = x.groupBy("below", "name").agg(F.min(F.struct("rk", "place")).alias("r"))
            state = state.unionByName(for_below.select("r.rk", "r.place", F.lit(1 << (i - 1)).alias("k"), F.col("below").alias("node"), F.lit(False).alias("live")))
    state = materialize(state, "state")
    columns = ["rk", "place", "k", "node", "live"]
    for d in range(len(levels) - 2, -1, -1):
        step = 1 << d
        nexts = levels[d].select("rk", F.col("place").alias("at"), F.col("name").alias("ext"))
        tried = materialize(state.where(F.col("k") >= 2 * step).withColumn("at", F.col("place") + F.col("k")).join(nexts, ["rk", "at"], "left").drop("at"), "tried")
        split = materialize(tried.where("ext is not null").groupBy("node", "ext").agg(F.count("*").alias("n"), F.max("live").alias("lives"), F.min(F.struct("rk", "place")).alias("r")), "split")
        both = split.where("n > 1 and lives").select("node", "ext", F.lit(True).alias("moves"))
        judged = tried.join(both, ["node", "ext"], "left")
        moved = judged.where("moves").select("rk", "place", (F.col("k") + step).alias("k"), F.xxhash64("node", "ext", F.lit(d)).alias("node"), "live")
        stay = materialize(judged.where("moves is null and live").select(*columns), "stay")
        nodes = stay.groupBy("node").agg(F.first("k").alias("k"))
        behind = split.where("n > 1 or not lives").join(nodes, "node").select("r.rk", "r.place", "k", "node", F.lit(False).alias("live"))
        state = materialize(state.where(F.col("k") < 2 * step).unionByName(moved).unionByName(stay).unionByName(behind), "state")
    return state.where("live").select("rk", "place", "k")


def later_stretches(levels: list[DataFrame]) -> DataFrame:
    """(rk, place, lines): the shortest stretches of the least size, from and up to each line, that stand further up as well."""
    ones, m = levels[0], F.col("lines")
    found = ones.where("to = 1 and later").select("rk", "place", F.lit(1).alias("lines"))
    both = F.array(F.struct("place", F.col("to").alias("lines")), F.struct((F.col("place") - F.col("back") + 1).alias("place"), F.col("back").alias("lines")))
    longer = ones.select("rk", "doc", F.inline(both)).where("lines > 1").distinct()
    j = F.length(F.bin(m)) - 1  # the largest doubling that fits
    longer = longer.withColumn("j", j).withColumn("second", (F.col("place") + m - F.pow(F.lit(2), j)).cast("int"))
    every = None
    for i, x in enumerate(levels):
        x = x.select("rk", F.lit(i).alias("j"), "place", F.col("name").alias("one"))
        every = x if every is None else every.unionByName(x)
    longer = longer.join(every, ["rk", "j", "place"]).join(every.select("rk", "j", F.col("place").alias("second"), F.col("one").alias("two")), ["rk", "j", "second"])
    longer = _found_again(longer.select("rk", "doc", "place", "lines", F.xxhash64("one", "two", "lines").alias("name")))
    return found.unionByName(longer.where("later").select("rk", "place", "lines"))


def dedup_runs(docs: DataFrame, min_bytes: int = 60) -> DataFrame:
    """``docs`` without the later copies of all repeated runs of lines; adds n_lines, n_deleted, n_runs and longest_run.

    A run is any number of consecutive lines, one too, that have ``min_bytes`` bytes together (line ends between them included), in
    whatever lengths. A line goes if it lies in a run that stands further up as well, in the order of (doc_id, place); copies may
    overlap, so after documents AB and BC, ABC loses all three lines: AB and BC are later copies both, and none of its
    text is lost. ``n_runs`` counts the stretches deleted, ``longest_run`` is the number of lines of the document's longest
    run that stands elsewhere too (null: none does). All documents stay, also those of which nothing is left. Null texts stay null (no lines), empty ones
    empty (one line), very long ones are read whole; a row without doc_id comes after all others; of equal rows one is the
    first; an empty table stays empty; other columns pass unchanged, whatever their names (those of the four counts are replaced).
    """
    rows = materialize(_lines(docs, min_bytes), "lines")
    levels = levels_of(rows, min_bytes)
    if not levels:
        return _delete(docs, None, lambda text, lines: np.full(len(lines), len(text) >= min_bytes))
    longest = common_prefixes(levels).join(levels[0].where("to > 0").select("rk", "place", "to"), ["rk", "place"]).where("k >= to").groupBy("rk").agg(F.max("k").alias("longest"))
    cuts = later_stretches(levels).groupBy("rk").agg(F.collect_list("place").alias("places"), F.collect_list("lines").alias("sizes"))
    cuts = materialize(longest.join(cuts, "rk", "full"), "cuts")
    return _delete(docs, cuts, lambda text, lines: np.full(len(lines), len(text) >= min_bytes))


def _numbered(docs: DataFrame) -> DataFrame:
    """Rows (rk, nth, c0, c1, ...): nth is 0 for rows that stand once, 1 for one of several equal rows, 2 for the others."""
    keyed = docs.select(row_key("doc_id", "text").alias("rk"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)])
    several = materialize(keyed.groupBy("rk").count().where("count > 1").select("rk"), "several")
    if not several.limit(1).count():
        return keyed.withColumn("nth", F.lit(0))
    again = materialize(keyed.join(several, "rk", "left_semi").withColumn("uid", F.monotonically_increasing_id()), "again")
    first = materialize(again.groupBy("rk").agg(F.min("uid").alias("uid")), "first")
    once = keyed.join(several, "rk", "left_anti").withColumn("nth", F.lit(0))
    again = again.join(first.withColumn("head", F.lit(True)), ["rk", "uid"], "left").withColumn("nth", F.when(F.col("head"), 1).otherwise(2))
    return once.unionByName(again.drop("uid", "head"))


def _delete(docs: DataFrame, cuts: DataFrame | None, shared: Callable[[bytes, list[bytes]], np.ndarray]) -> DataFrame:
    """``docs`` without the lines that ``cuts`` (rk, places, sizes, longest) covers; ``shared`` tells which lines lie in runs that an equal row has too."""
    docs = docs.select(*[f"`{c}`" for c in docs.columns if c.lower() not in _COUNTS])
    names, i = docs.columns, docs.columns.index("text")
    rows = _numbered(docs)
    joined = rows.withColumns({c: F.lit(None).cast(t) for c, t in (("places", "array<int>"), ("sizes", "array<int>"), ("longest", "int"))}) if cuts is None else rows.join(cuts.hint("merge"), "rk", "left")
    joined = joined.select(*[f"c{k}" for k in range(len(names))], "places", "sizes", "longest", "nth")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in blocks(batches, f"c{i}", 4 << 20):
            places, sizes, longest, nth = (batch.column(len(names) + k).to_pylist() for k in range(4))
            null = batch.column(i).is_null().to_pylist()
            kept, total, deleted, runs = [], [], [], []
            for row, (text, gone) in enumerate(zip(texts, null, strict=True)):
                lines = text.split(b"\n")
                drop = np.zeros(len(lines), dtype=bool)
                for p, size in zip(places[row] or (), sizes[row] or (), strict=True):
                    drop[p : p + size] = True
                if nth[row] and not gone:
                    same = shared(text, lines)
                    if same.any():
                        step = np.flatnonzero(np.diff(np.concatenate([[0], same, [0]])))
                        longest[row] = max(longest[row] or 0, int((step[1::2] - step[::2]).max()))
                    drop |= same & (nth[row] > 1)
                total.append(0 if gone else len(lines))
                deleted.append(int(drop.sum()))
                runs.append(int(drop[0]) + int((drop[1:] & ~drop[:-1]).sum()))
                kept.append(None if gone else b"\n".join(x for x, d in zip(lines, drop, strict=True) if not d).decode() if deleted[-1] else text.decode())
            cols = [pa.array(kept, type=batch.schema.field(i).type) if k == i else batch.column(k) for k in range(len(names))]
            cols += [pa.array(x, type=pa.int32()) for x in (total, deleted, runs, longest)]
            yield pa.RecordBatch.from_arrays(cols, names=[*names, *_COUNTS])

    return joined.mapInArrow(cut, StructType([*docs.schema.fields, *[StructField(c, IntegerType()) for c in _COUNTS]]))


# Stretches of a fixed number of lines ----------------------------------------------------


def _places(docs: DataFrame, min_lines: int, min_bytes: int) -> DataFrame:
    """(rk, doc, place, name) of every stretch of ``min_lines`` lines of at least ``min_bytes`` bytes."""

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        odd = stream64(min_lines, 41) | np.uint64(1)
        for batch, texts in blocks(batches, "text"):
            buf, starts, ends, owner, first = _split(texts)
            line = Substrings(buf)(starts, ends)
            n = len(line) - min_lines + 1
            if n <= 0:
                continue
            rolled = np.zeros(n, dtype=np.uint64)
            for k in range(min_lines):
                rolled += line[k : k + n] * odd[k]
            at = np.flatnonzero((owner[:n] == owner[min_lines - 1 :]) & (ends[min_lines - 1 :] - starts[:n] >= min_bytes))
            rk, doc = batch.column(0).take(pa.array(owner[at])), batch.column(1).take(pa.array(owner[at]))
            yield pa.RecordBatch.from_arrays([rk, doc, pa.array((at - first[owner[at]]).astype(np.int32)), pa.array(signed(mix64(rolled[at])))], names=["rk", "doc", "place", "name"])

    return _keyed(docs).mapInArrow(name, "rk long, doc long, place int, name long")


def repeated_runs(docs: DataFrame, min_lines: int = 2, min_bytes: int = 60) -> DataFrame:
    """(rk, place, lines, later) of stretches found again: ``lines`` is the largest doubling of ``min_lines`` lines repeated
    from that place, ``later`` whether the stretch of ``min_lines`` lines is a copy of an earlier one."""
    held, lines, found = _places(docs, min_lines, min_bytes), min_lines, None
    while True:
        level = _found_again(held)
        if not level.limit(1).count():
            break
        rows = level.select("rk", "place", F.lit(lines).alias("lines"), "later")
        found = rows if found is None else found.unionByName(rows)
        near = level.select("rk", (F.col("place") - lines).alias("place"), F.col("name").alias("further"))
        held = level.join(near, ["rk", "place"]).select("rk", "doc", "place", F.xxhash64("name", "further").alias("name"))
        lines *= 2
    if found is None:
        return docs.sparkSession.createDataFrame([], "rk long, place int, lines int, later boolean")
    return found.groupBy("rk", "place").agg(F.max("lines").alias("lines"), F.max(F.when(F.col("lines") == min_lines, F.col("later"))).alias("later"))


def dedup_lines(docs: DataFrame, min_lines: int = 2, min_bytes: int = 60) -> DataFrame:
    """As ``dedup_runs``, but for runs of at least ``min_lines`` lines whose every stretch of ``min_lines`` lines has ``min_bytes``
    bytes; ``longest_run`` is the largest doubling of ``min_lines`` found again. Documents, nulls, equal rows and other columns are treated alike."""
    runs = repeated_runs(docs, min_lines, min_bytes)
    cuts = runs.groupBy("rk").agg(F.collect_list(F.when(F.col("later"), F.col("place"))).alias("places"), F.max("lines").alias("longest"))
    cuts = materialize(cuts.select("rk", "places", F.transform("places", lambda _: F.lit(min_lines)).alias("sizes"), "longest"), "cuts")

    def shared(text: bytes, lines: list[bytes]) -> np.ndarray:
        out, ends = np.zeros(len(lines), dtype=bool), np.cumsum([0] + [len(x) + 1 for x in lines])
        for p in range(len(lines) - min_lines + 1):
            if ends[p + min_lines] - ends[p] - 1 >= min_bytes:
                out[p : p + min_lines] = True
        return out

    return _delete(docs, cuts, shared)


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_runs(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_deleted", "n_runs", "longest_run", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))
