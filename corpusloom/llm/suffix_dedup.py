"""Exact substring deduplication with suffix arrays in shards.

A stretch of ``length`` bytes is repeated when it also starts anywhere else. Which stretches can be is found
without comparing texts: each stretch is filed under its anchor, the ``gram`` bytes of smallest hash inside it
(the leftmost, on ties), so equal stretches have equal anchors. Neighbouring starts with one anchor form a
context. Equal contexts are repeated whole. Where an anchor has several different contexts, one of each goes to a shard;
there a suffix array (Larsson-Sadakane doubling, refining open groups only) and the common prefixes of its
neighbours tell which of its stretches others share. An anchor with very many contexts is split over
shards; these hand on the keys of their distinct stretches in as many parts, and each part is merged by binary
search. No step holds more than one shard or looks at all pairs.

Passages of so many words, which may be shorter than a stretch, take the same way with words in place of bytes;
their shards compare hashes of whole passages.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import _SPACE, Substrings, blocks, materialize, mix64, row_key, signed, table

_PLACE = 24  # bits of a place inside one buffer
_PIECE = 8 << 20  # longer buffers are read in overlapping pieces
SHARD_BYTES = 2 << 20
_WORD_GRAM = 16  # words of a passage's anchor, at most
_WORDS = np.uint64(0x5851F42D4C957F2D)  # keeps anchors of passages apart from those of stretches


#: Stretches of a split anchor, one part of its keys in a row.
_FAR = pa.schema([("part", pa.string()), *((name, pa.list_(pa.int64())) for name in ("rks", "los", "his", "keys"))])


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w neighbours, by running minima of blocks from both sides."""
    n = len(x) - w + 1
    padded = np.full(-(-len(x) // w) * w, np.iinfo(x.dtype).max, dtype=x.dtype)
    padded[: len(x)] = x
    rows = padded.reshape(-1, w)
    right = np.minimum.accumulate(rows, axis=1).ravel()
    left = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(left[:n], right[w - 1 : w - 1 + n])


def _grouped(hashes: Substrings, at: np.ndarray, n: int, begin, stop, length: int, gram: int) -> tuple[np.ndarray, ...]:  # noqa: ANN001
    """Contexts of the stretches that begin at the units ``at`` of ``n``: first byte, end, anchor hash, context hash.

    ``begin`` gives the first byte of a unit, ``stop`` the byte where the unit before one ends.
    """
    place = np.arange(n - gram + 1)
    low = np.uint64((1 << _PLACE) - 1)
    keyed = (hashes(begin(place), stop(place + gram)) & ~low) | place.astype(np.uint64)
    anchor = (sliding_min(keyed, length - gram + 1)[at] & low).astype(np.int64)
    new = np.concatenate([[True], anchor[1:] != anchor[:-1]])
    lo, hi, anchor = at[new], at[np.concatenate([new[1:], [True]])], anchor[new]
    first, end = begin(lo), stop(hi + length)
    return first, end, hashes(begin(anchor), stop(anchor + gram)), mix64(hashes(first, end) + (anchor - lo).astype(np.uint64))


def contexts(hashes: Substrings, size: int, starts: np.ndarray, ends: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...] | None:
    """Contexts of the texts that lie at starts..ends of a buffer of ``size`` bytes."""
    long = ends - starts >= length
    if not long.any():
        return None
    mark = np.zeros(size + 1, dtype=np.int8)
    mark[starts[long]] += 1
    mark[ends[long] - length + 1] -= 1
    at = np.flatnonzero(np.cumsum(mark[:-1], dtype=np.int8))
    return _grouped(hashes, at, size, lambda k: k, lambda k: k, length, gram)


def word_bounds(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First byte and end of each word ``[^\\x20\\x09-\\x0D]+`` of the texts starts..ends, which fill ``buf``."""
    inside = ~_SPACE[buf]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    some = ends > starts
    first[starts[some]] = inside[starts[some]]
    last[ends[some] - 1] = inside[ends[some] - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def passage_contexts(hashes: Substrings, begins: np.ndarray, stops: np.ndarray, owner: np.ndarray, passage: int) -> tuple[np.ndarray, ...] | None:
    """Contexts of passages of ``passage`` words inside one text; ``owner`` is the text of each word."""
    at = np.flatnonzero(owner[passage - 1 :] == owner[: len(owner) - passage + 1])
    if not len(at):
        return None
    first, end, a, c = _grouped(hashes, at, len(begins), lambda k: begins[k], lambda k: stops[k - 1], passage, min(_WORD_GRAM, passage))
    return first, end, a ^ _WORDS, c


def _all_contexts(docs: DataFrame, length: int, gram: int, passage: int | None) -> DataFrame:
    """Contexts of all rows: lo and hi + length are where one begins and ends, ``words`` those of passages."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in blocks(batches, "text", 1 << 20):
            whole = np.frombuffer(b"".join(texts), dtype=np.uint8)
            ends = np.cumsum([len(t) for t in texts])
            starts = ends - np.asarray([len(t) for t in texts])
            hashes = Substrings(whole) if len(whole) <= _PIECE else None

            def told(found: tuple[np.ndarray, ...] | None, p: int, words: bool) -> Iterator[pa.RecordBatch]:
                if found is None:
                    return
                lo, end, a, c = found
                owner = np.searchsorted(ends, lo + p, side="right")
                # contexts equal to one of this block: the first stands for them all, the others need no partner
                by = np.lexsort((c, a))
                same = (a[by][1:] == a[by][:-1]) & (c[by][1:] == c[by][:-1])
                state = np.zeros(len(a), dtype=np.int32)
                state[by[:-1][same]] = 1
                state[by[1:][same]] = 2
                begin = lo + p - starts[owner]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(owner)), pa.array(begin.astype(np.int32)), pa.array((begin + end - lo - length).astype(np.int32)), pa.array(signed(a)), pa.array(signed(c)), pa.array(np.full(len(a), words)), pa.array(state)],
                    names=["rk", "lo", "hi", "a", "c", "words", "state"],
                )

            for p in range(0, max(1, len(whole)), _PIECE):
                buf = whole[p : p + _PIECE + length - 1]
                if len(buf) >= length:
                    s, e = np.clip(starts - p, 0, len(buf)), np.clip(ends - p, 0, len(buf))
                    yield from told(contexts(hashes or Substrings(buf), len(buf), s, e, length, gram), p, False)
            if not passage:
                continue
            begins, stops = word_bounds(whole, starts, ends)
            owner, k = np.searchsorted(ends, begins, side="right"), 0
            while k + passage <= len(begins):  # pieces overlap by all words of a passage but one
                to = max(k + passage, int(np.searchsorted(stops, begins[k] + _PIECE, side="right")))
                p = 0 if hashes else int(begins[k])
                yield from told(passage_contexts(hashes or Substrings(whole[p : stops[to - 1]]), begins[k:to] - p, stops[k:to] - p, owner[k:to], passage), p, True)
                k = to - passage + 1

    return docs.select(row_key("doc_id", "text").alias("rk"), "text").mapInArrow(find, "rk long, lo int, hi int, a long, c long, words boolean, state int")


def _sort_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of contexts sorted by (a, c): those found twice or more (whole), and one of each kind where an anchor has several kinds.

    Rows of state 2 are known to be found twice and pass through; a row of state 1 stands for them. Each row waits for the next one; the first kind of an anchor waits until there is a second.
    """
    held, last, waiting = None, None, None  # last: (a, c) given out; waiting: the first kind of the anchor being read

    def sort_out(cols: list[np.ndarray], following: tuple | None) -> pa.RecordBatch:
        nonlocal last, waiting
        rk, lo, hi, a, c, words, state = cols
        new_a = np.concatenate([[last is None or a[0] != last[0]], a[1:] != a[:-1]])
        new_c = new_a | np.concatenate([[last is None or c[0] != last[1]], c[1:] != c[:-1]])
        again = ~np.concatenate([new_c[1:], [following is None or (a[-1], c[-1]) != following]])  # the next row is equal
        twice = again | ~new_c | (state == 1)
        first = np.flatnonzero(new_c)
        rows = [x[first] for x in (rk, lo, hi, a, c, words)] + [~twice[first]]
        head = new_a[first]
        if waiting is not None:
            rows, head = [np.concatenate([w, r]) for w, r in zip(waiting, rows, strict=True)], np.concatenate([[True], head])
        several = ~head
        several[:-1] |= ~head[1:]
        waiting = [r[-1:] for r in rows] if len(head) and head[-1] else None
        pick = [r[several] for r in rows]
        last = (a[-1], c[-1])
        n = int(twice.sum())
        return pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate([x[twice], y])) for x, y in zip((rk, lo, hi, a, c, words), pick[:6], strict=True)]
            + [pa.array(np.concatenate([np.zeros(n, dtype=bool), np.ones(len(pick[0]), dtype=bool)])), pa.array(np.concatenate([np.zeros(n, dtype=bool), pick[6]]))],
            names=["rk", "lo", "hi", "a", "c", "words", "kind", "single"],
        )

    for batch in batches:
        cols = [x.to_numpy(zero_copy_only=False) for x in batch.columns]
        known = cols[6] == 2
        if known.any():
            none = np.zeros(int(known.sum()), dtype=bool)
            yield pa.RecordBatch.from_arrays([*(pa.array(x[known]) for x in cols[:6]), pa.array(none), pa.array(none)], names=["rk", "lo", "hi", "a", "c", "words", "kind", "single"])
            cols = [x[~known] for x in cols]
        if not len(cols[0]):
            continue
        if held is not None:
            cols = [np.concatenate([h, x]) for h, x in zip(held, cols, strict=True)]
        held = [x[-1:] for x in cols]
        if len(cols[0]) > 1:
            yield sort_out([x[:-1] for x in cols], (held[3][0], held[4][0]))
    if held is not None:
        yield sort_out(held, None)


# Suffix arrays ---------------------------------------------------------------------------


def eights(buf: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one number that sorts like them; zeros follow the end."""
    padded = np.concatenate([buf, np.zeros(8, dtype=np.uint8)]).astype(np.uint64)
    key = np.zeros(len(buf), dtype=np.uint64)
    for k in range(8):
        key |= padded[k : k + len(buf)] << np.uint64(56 - 8 * k)
    return key


def suffix_array(buf: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Order and rank of all suffixes of ``buf`` by their first ``depth`` bytes or more.

    Larsson-Sadakane: suffixes are ranked by h bytes; each round sorts the members of open groups (equal
    ranks) by the rank h places on and so doubles h; a group of one is closed.
    """
    n = len(buf)
    key = eights(buf)
    order = np.argsort(key)
    new = np.concatenate([[True], key[order][1:] != key[order][:-1]])
    rank = np.empty(n, dtype=np.int64)
    group = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank[order] = group + 1
    h = 8
    while h < depth:
        alone = new & np.concatenate([new[1:], [True]])
        open_ = np.flatnonzero(~alone)  # places in order
        if not len(open_):
            break
        members = order[open_]
        beyond = members + h
        key = (rank[members].astype(np.uint64) << np.uint64(32)) | np.where(beyond < n, rank[np.minimum(beyond, n - 1)], 0).astype(np.uint64)
        by = np.argsort(key)
        members, key = members[by], key[by]
        order[open_] = members
        new[open_] = np.concatenate([[True], key[1:] != key[:-1]])
        group = np.maximum.accumulate(np.where(new, np.arange(n), 0))
        rank[members] = group[open_] + 1
        h *= 2
    return order, rank


def common_prefixes(buf: np.ndarray, order: np.ndarray, starts: np.ndarray, lengths: np.ndarray, most: int) -> np.ndarray:
    """Common prefix, up to ``most`` and the ends of their strings, of each suffix in ``order`` with the one before it.

    Eight bytes are compared at a time, of those suffixes only that agree so far. ``order`` may leave suffixes out.
    """
    ends = starts + lengths
    left = ends[np.searchsorted(starts, order, side="right") - 1] - order
    common = np.zeros(len(order), dtype=np.int64)
    room = np.minimum(most, np.minimum(left[1:], left[:-1]))
    key = eights(buf)
    alike = np.arange(1, len(order))
    for done in range(0, most, 8):
        alike = alike[room[alike - 1] > done]
        if not len(alike):
            break
        differ = key[order[alike] + done] ^ key[order[alike - 1] + done]
        parted = differ != 0
        common[alike] = done + 8
        common[alike[parted]] -= sum((differ[parted] >> np.uint64(8 * k) != 0).astype(np.int64) for k in range(8))
        alike = alike[~parted]
    common[1:] = np.minimum(common[1:], room)
    return common


def repeated_starts(strings: list[bytes], owned: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the first ``owned`` places of each string: string, place, class of its ``length`` bytes, whether the class has two or more."""
    buf = np.frombuffer(b"".join(strings), dtype=np.uint8)
    lengths = np.asarray([len(s) for s in strings])
    starts = np.cumsum(lengths) - lengths
    order, _ = suffix_array(buf, length)
    string = np.repeat(np.arange(len(strings)), lengths)[order]
    mine = order - starts[string] < owned[string]
    order, string = order[mine], string[mine]
    classes = np.cumsum(common_prefixes(buf, order, starts, lengths, length) < length)
    return string, order - starts[string], classes, np.bincount(classes, minlength=1)[classes] > 1


def repeated_passages(strings: list[bytes], passage: int) -> tuple[np.ndarray, ...]:
    """Of the passages of ``passage`` words of each string: string, number of the first word, first byte, end, class, whether the class has two or more."""
    buf = np.frombuffer(b"".join(strings), dtype=np.uint8)
    ends = np.cumsum([len(s) for s in strings])
    starts = ends - np.asarray([len(s) for s in strings])
    begins, stops = word_bounds(buf, starts, ends)
    owner = np.searchsorted(ends, begins, side="right")
    at = np.flatnonzero(owner[passage - 1 :] == owner[: len(owner) - passage + 1])
    string, first, end = owner[at], begins[at], stops[at + passage - 1]
    _, classes, n = np.unique(Substrings(buf)(first, end), return_inverse=True, return_counts=True)
    return string, at, first - starts[string], end - starts[string], classes, n[classes] > 1


def _in_shards(length: int, passage: int | None):  # noqa: ANN202
    """For contexts (rk, lo, hi, single, splits, words, bytes), anchor by anchor: repeated starts of single contexts, and for
    split anchors every distinct stretch with its key, in as many parts as the anchor has shards."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        size, group = 0, None

        def shard(words: bool) -> Iterator[pa.RecordBatch]:
            own = [r for r in rows if r[6] == words]
            if not own:
                return
            rk, lo, hi, single, splits = (np.asarray([r[k] for r in own]) for k in range(1, 6))
            if words:
                string, place, begin, end, classes, twice = repeated_passages([r[7] for r in own], passage)
            else:
                string, place, classes, twice = repeated_starts([r[7] for r in own], hi - lo + 1, length)
                begin, end = place, place + length
            hit = twice & single[string]
            order = np.lexsort((place[hit], string[hit]))
            s, p = string[hit][order], place[hit][order]
            new = np.concatenate([[True], (s[1:] != s[:-1]) | (p[1:] != p[:-1] + 1)]) if len(s) else np.zeros(0, dtype=bool)
            last = np.concatenate([new[1:], [True]]) if len(s) else new
            found = [rk[s[new]], lo[s[new]] + begin[hit][order][new], lo[s[last]] + end[hit][order][last] - length]
            parts: list[list] = [[] for _ in _FAR]
            far = splits[string] > 1  # each distinct stretch; its members that are found are already out
            if far.any():
                buf = np.frombuffer(b"".join(r[7] for r in own), dtype=np.uint8)
                begins = np.cumsum([len(r[7]) for r in own]) - np.asarray([len(r[7]) for r in own])
                _, one = np.unique(classes[far], return_index=True)
                s, b, e = string[far][one], begin[far][one], end[far][one]
                key = Substrings(buf)(begins[s] + b, begins[s] + e)
                cols = [rk[s], np.where(twice[far][one] | ~single[s], -1, lo[s] + b), lo[s] + e - length, signed(key)]
                anchor = np.asarray([int(r[0].partition(".")[0]) for r in own])[s]
                part = (key % splits[s].astype(np.uint64)).astype(np.int64)
                by = np.lexsort((part, anchor))
                edge = np.flatnonzero(np.concatenate([[True], (anchor[by][1:] != anchor[by][:-1]) | (part[by][1:] != part[by][:-1])]))
                for rows_of in np.split(by, edge[1:]):
                    for x, y in zip(parts, (f"{anchor[rows_of[0]]}.{part[rows_of[0]]}", *(c[rows_of] for c in cols)), strict=True):
                        x.append(y)
            n, m = len(found[0]), len(parts[0])
            yield pa.RecordBatch.from_arrays(
                [*(pa.array([*x.tolist(), *[None] * m], type=pa.int64()) for x in found), pa.array([words] * (n + m), type=pa.bool_()), *(pa.array([*[None] * n, *x], type=f.type) for x, f in zip(parts, _FAR, strict=True))],
                names=["rk", "lo", "hi", "words", *_FAR.names],
            )

        for batch in batches:
            for r in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if size > SHARD_BYTES and r[0] != group:
                    yield from shard(False)
                    yield from shard(True)
                    rows, size = [], 0
                rows.append(r)
                size += len(r[7])
                group = r[0]
        yield from shard(False)
        yield from shard(True)

    return search


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of the stretches of each part (rows sorted by part), those whose key occurs again: its range is looked up by binary search in the sorted keys."""
    held: list[tuple] = []

    def merged() -> pa.RecordBatch:
        rk, lo, hi, key = (np.concatenate([r[k] for r in held]) for k in range(2, 6))
        by = np.argsort(key)
        rk, lo, hi, key = rk[by], lo[by], hi[by], key[by]
        twice = (np.searchsorted(key, key, side="right") - np.searchsorted(key, key, side="left") > 1) & (lo >= 0)
        return pa.RecordBatch.from_arrays([*(pa.array(x[twice]) for x in (rk, lo, hi)), pa.array(np.full(int(twice.sum()), held[0][1]))], names=["rk", "lo", "hi", "words"])

    for batch in batches:
        part, words = (batch.column(k).to_pylist() for k in range(2))
        for k in range(len(batch)):
            if held and held[0][0] != part[k]:
                yield merged()
                held = []
            held.append((part[k], words[k], *(batch.column(c)[k].values.to_numpy() for c in range(2, 6))))
    if held:
        yield merged()


def repeated_stretches(docs: DataFrame, length: int = 400, gram: int = 200, hot: int = 2000, passage: int | None = None) -> DataFrame:
    """(rk, lo, hi, words): the starts lo..hi in the row of key rk from which ``length`` bytes are found elsewhere too.

    Where ``words`` is true, passages of ``passage`` words that are found elsewhere too, from lo to hi + length.
    """
    deal = F.when(F.col("state") == 2, F.xxhash64("rk", "lo")).otherwise(F.col("a"))  # copies that a block has settled go anywhere
    found = _all_contexts(docs, length, gram, passage).withColumn("deal", deal).repartition("deal").sortWithinPartitions("a", "c").drop("deal")
    found = materialize(found.mapInArrow(_sort_out, "rk long, lo int, hi int, a long, c long, words boolean, kind boolean, single boolean"), "contexts")
    whole = found.where("not kind").select("rk", F.col("lo").cast("long").alias("lo"), F.col("hi").cast("long").alias("hi"), "words")
    # written before the join, so that Spark can split hot anchors there
    anchors = materialize(found.where("kind").groupBy("a").agg(F.count("*").alias("kinds"), F.max("single").alias("open")).where("open").select("a", "kinds"), "anchors")
    kinds = found.where("kind").join(anchors, "a").select("rk", "lo", "hi", "a", "words", "single", F.ceil(F.col("kinds") / hot).alias("splits"), F.when(F.col("kinds") > hot, F.pmod("c", F.ceil(F.col("kinds") / hot))).otherwise(0).alias("split"))
    wanted = materialize(kinds.groupBy("rk").agg(F.collect_list(F.struct("a", "split", "lo", "hi", "single", "splits", "words")).alias("cuts")), "wanted")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in blocks(batches, "text", 1 << 20):
            rows = [(f"{x['a']}.{x['split']}", rk, x["lo"], x["hi"], x["single"], x["splits"], x["words"], t[x["lo"] : x["hi"] + length]) for rk, t, cuts in zip(batch.column(0).to_pylist(), texts, batch.column(2).to_pylist(), strict=True) for x in cuts]
            cols = list(zip(*rows, strict=True)) or [[]] * 8
            kinds_ = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.bool_(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(cols, kinds_, strict=True)], names=["shard", "rk", "lo", "hi", "single", "splits", "words", "bytes"])

    texts = docs.select(row_key("doc_id", "text").alias("rk"), "text").join(wanted, "rk").select("rk", "text", "cuts")
    pieces = texts.mapInArrow(cut, "shard string, rk long, lo long, hi long, single boolean, splits long, words boolean, bytes binary")
    searched = materialize(pieces.repartition("shard").sortWithinPartitions("shard").mapInArrow(_in_shards(length, passage), "rk long, lo long, hi long, words boolean, part string, rks array<long>, los array<long>, his array<long>, keys array<long>"), "searched")
    far = searched.where("part is not null").select("part", "words", "rks", "los", "his", "keys").repartition("part").sortWithinPartitions("part").mapInArrow(_merge, "rk long, lo long, hi long, words boolean")
    return whole.unionByName(searched.where("part is null").select("rk", "lo", "hi", "words")).unionByName(far)


def remove_repeats(docs: DataFrame, length: int = 400, gram: int = 200, passage: int | None = None) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept (remaining bytes), spans removed (start, end), passages (start, end).

    Every byte covered by a stretch of ``length`` bytes that also starts elsewhere in the corpus or in the same
    document goes, all copies alike, judged on the input. Null texts count as empty; texts shorter than
    ``length`` stay, very long ones are read in overlapping pieces; equal rows are copies of each other; a row without doc_id is treated
    like any other; an empty table has no rows; other columns are ignored. Where ``passage`` is given, ``passages`` are the
    bytes covered by so many words in a row that also stand elsewhere, as they are; they may be shorter than ``length`` and stay.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    spans = repeated_stretches(docs, length, gram, passage=passage)
    spans = materialize(spans.groupBy("rk").agg(F.collect_list(F.struct("lo", "hi", "words")).alias("spans")), "spans")
    joined = docs.withColumn("rk", row_key("doc_id", "text")).join(spans, "rk", "left").select("doc_id", "text", "spans")

    def merged(lo: np.ndarray, hi: np.ndarray) -> list[tuple[int, int]]:
        by = np.argsort(lo, kind="stable")
        lo, end = lo[by], np.maximum.accumulate(hi[by] + length)
        new = np.concatenate([[True], lo[1:] > end[:-1]]) if len(lo) else np.zeros(0, dtype=bool)
        return list(zip(lo[new].tolist(), end[np.concatenate([new[1:], [True]])].tolist() if len(lo) else [], strict=True))

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in blocks(batches, "text", 4 << 20):
            out: list[list] = [[], [], [], [], [], []]
            spans_ = batch.column(2)
            for k, text in enumerate(texts):
                x = spans_[k].values
                kept, cut, passages = text, [], []
                if x is not None and len(x):
                    lo, hi, words = (x.field(f).to_numpy(zero_copy_only=False) for f in (0, 1, 2))
                    cut, passages = merged(lo[~words], hi[~words]), merged(lo[words], hi[words])
                    at = [0, *(e for _, e in cut)]
                    kept = b"".join(text[a:b] for a, b in zip(at, [*(s for s, _ in cut), len(text)], strict=True))
                told = ([{"start": a, "end": b} for a, b in y] for y in (cut, passages))
                for o, v in zip(out, (len(text), len(text) - len(kept), len(cut), kept, *told), strict=True):
                    o.append(v)
            places = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            kinds_ = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), places, places)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(o, type=t) for o, t in zip(out, kinds_, strict=True))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "spans", "passages"])

    places = "array<struct<start long, end long>>"
    return joined.mapInArrow(remove, f"doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, spans {places}, passages {places}")


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns, has_repeats, and passage_bytes: bytes in passages of over 50 words that stand elsewhere too."""
    out = remove_repeats(table(spark, sf_dir, "documents"), passage=51)
    passage_bytes = F.aggregate("passages", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"])
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), (F.col("n_removed") > 0).cast("int").alias("has_repeats"), passage_bytes.alias("passage_bytes"))
