"""N-gram Jaccard self-join by grouped prefixes, exact at every size.

A document is its set of distinct 5-word shingles. All shingles have one fixed order: those that many
documents share come last, the others by hash. Two sets of similarity t share a shingle among the first
``n - ceil(t n) + 1`` of each, so only these prefixes are shuffled.

1. Equal sets form a class, classes with the same prefix and size form a group; a group's prefix is
   shuffled once, by shingle.
2. Among the groups that share a shingle, each is paired with one leader of its size band only. These few
   pairs are expanded to classes and verified on whole texts; verified links give first components. Further
   rounds pair classes of different components with leaders and neighbours that change from shingle to shingle and
   from round to round, and verify a few pairs for two components, until a round links hardly any more. So a large family is
   one component before pairs are sought for all of its members.
3. Pairs that still lie in different components and pass the size and position filters are verified
   too, so no link between different components is lost.
4. Links of classes, all of which lie inside components now, are counted: a component's classes are dealt out to
   blocks, and a task multiplies two blocks' sets. Only a number for each class leaves it, never a pair.

Before texts are read, pairs are filtered by parity sketches: each element of the symmetric difference flips
one bit, so more differing bits than the similarity allows elements rule a pair out for certain.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import blocks, components, materialize, mix64, row_key, shingle_sets, signed, table

_SIGN = "rk long, doc_id long, n int, ck long, gkey long, prefix array<long>, sketch binary, bits array<long>"


def _common_shingles(docs: DataFrame, words: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``most`` shingles of most documents, with their ranks: a bounded table that only steers the order.

    Each batch reports the shingles that at least two of its documents share; sums over all batches rank them.
    """

    def repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def flush() -> pa.RecordBatch:
            every = np.concatenate(held)
            held.clear()
            every.sort()
            edge = np.diff((every[1:] == every[:-1]).astype(np.int8), prepend=0, append=0)
            first = np.flatnonzero(edge == 1)
            times = np.flatnonzero(edge == -1) - first + 1
            return pa.RecordBatch.from_arrays([pa.array(signed(every[first])), pa.array(times)], names=["h", "c"])

        for _, texts in blocks(batches, "text"):
            held += shingle_sets(texts, words)
            size += sum(map(len, texts))
            if size > 24 << 20:
                yield flush()
                size = 0
        if held:
            yield flush()

    ranked = docs.select("text").mapInArrow(repeated, "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))
    top = ranked.where("c >= 8").orderBy(F.desc("c"), "h").limit(most).toPandas()
    h = top["h"].to_numpy(dtype=np.int64).view(np.uint64)
    order = np.argsort(h)
    return h[order], (len(h) - np.arange(len(h), dtype=np.int64))[order]  # the most frequent has the highest rank


def _prefix_length(n: int, percent: int) -> int:
    return n - (n * percent + 99) // 100 + 1


def _band_width(percent: int) -> float:
    """Width of the bands of log sizes: a little over the largest quotient of sizes that can link, so such sets lie in one band or in neighbours."""
    return float(np.log(100 / min(percent, 99)) * (1 + 1e-9))


_SHORT = 512  # bits of the short sketch, which goes along where rows of one shingle meet
_MEETS = 3


def parity_sketch(elements: np.ndarray, bits: int = 0) -> bytes:
    """Parities of the elements' ``bits`` buckets, or of four to eight buckets for an element."""
    bits = bits or 1 << max(6, (4 * len(elements) - 1).bit_length())
    return np.packbits(np.bincount((elements & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1, bitorder="little").tobytes()


def sketch_distance(a: bytes, b: bytes) -> int:
    """At most the size of the symmetric difference of the sketched sets; the longer sketch is folded first."""
    x, y = sorted((np.frombuffer(a, dtype=np.uint8), np.frombuffer(b, dtype=np.uint8)), key=len)
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def _sign(docs: DataFrame, words: int, percent: int, common: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """Size, class key, group key and prefix of every row; a batch carries a group's prefix once."""
    shared = docs.sparkSession.sparkContext.broadcast(common)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heavy, rank = shared.value
        seen: set[int] = set()
        for batch, texts in blocks(batches, "text"):
            sets = shingle_sets(texts, words)
            n = np.asarray([len(s) for s in sets], dtype=np.int64)
            ck = np.zeros(len(sets), dtype=np.uint64)
            gkey = np.zeros(len(sets), dtype=np.uint64)
            prefixes: list[np.ndarray | None] = []
            sketches = [parity_sketch(x) if len(x) else None for x in sets]
            short = [np.frombuffer(parity_sketch(x, _SHORT), dtype=np.int64) if len(x) else None for x in sets]
            every = np.concatenate(sets) if sets else np.zeros(0, dtype=np.uint64)
            ranks = np.zeros(len(every), dtype=np.int64)
            if len(heavy):
                at = np.minimum(np.searchsorted(heavy, every), len(heavy) - 1)
                ranks = np.where(heavy[at] == every, rank[at], 0)
            mixed, low = mix64(every ^ np.uint64(0x5851F42D4C957F2D)), 0
            for i, s in enumerate(sets):
                m = len(s)
                if not m:
                    prefixes.append(None)
                    continue
                ck[i] = mix64(np.atleast_1d(mixed[low : low + m].sum() + np.uint64(m)))[0]
                own = ranks[low : low + m]
                p = _prefix_length(m, percent)
                if own.any():
                    first = s[np.argsort(own, kind="stable")[:p]]  # s is sorted, so ties stay by hash
                else:
                    first = s[:p]
                g = mix64(np.atleast_1d((mix64(first) * (np.arange(p, dtype=np.uint64) * np.uint64(2) + np.uint64(1))).sum() + np.uint64(m)))[0]
                gkey[i] = g
                prefixes.append(None if int(g) in seen else signed(first))
                seen.add(int(g))
                low += m
            if len(seen) > 200_000:
                seen.clear()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(n, type=pa.int32()), pa.array(signed(ck)), pa.array(signed(gkey)), pa.array(prefixes, type=pa.list_(pa.int64())), pa.array(sketches, type=pa.binary()), pa.array(short, type=pa.list_(pa.int64()))],
                names=["rk", "doc_id", "n", "ck", "gkey", "prefix", "sketch", "bits"],
            )

    return docs.select(row_key("doc_id", "text").alias("rk"), F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(sign, _SIGN)


def _can_link(n, i, m, j, percent):  # noqa: ANN001  numpy arrays or Columns
    """Whether sets of n and m elements whose first common element stands at i and j can reach the similarity."""
    need = percent * (n + m)
    return ((n - i) * (100 + percent) >= need) & ((m - j) * (100 + percent) >= need) & (n * percent <= m * 100) & (m * percent <= n * 100)


def _leaders(percent: int, beside: int):  # noqa: ANN202
    """For rows (token, band, pos, n, key, root) sorted by token and band: those whose token others share, each with its leader.

    The leader of a token and band is the first row; it itself follows the leader of the band before. Rows with
    the leader's root, or too far from it in size or position, have none. With ``beside``, only pairs (a, b) are
    given out, with their roots: each row with its leader and with at most ``_MEETS`` of so many rows before it that
    differ in root and whose short sketches (further columns) don't rule it out.
    """

    def lead(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the last row waits for the next one, which tells whether its token is shared
        state = (None, None)
        for batch in batches:
            cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            if held is not None:
                cols = [np.concatenate([h, c]) for h, c in zip(held, cols, strict=True)]
            held = [c[-1:] for c in cols]
            if len(cols[0]) > 1:
                out, state = _led([c[:-1] for c in cols], held[0][0], state, percent, beside)
                yield out
        if held is not None and len(held[0]):
            yield _led(held, None, state, percent, beside)[0]

    return lead


def _led(cols, next_token, state, percent, beside):  # noqa: ANN001, ANN202
    """The rows to give out and the state after them: the last row's (token, band, key) and its band's leader (n, pos, key, root)."""
    token, band, pos, n, key, root, *bits = cols
    last, leader = state
    new_token = np.concatenate([[last is None or token[0] != last[0]], token[1:] != token[:-1]])
    new_band = new_token | np.concatenate([[last is None or band[0] != last[1]], band[1:] != band[:-1]])
    again = ~new_token & np.concatenate([[last is not None and key[0] == last[2]], key[1:] == key[:-1]])  # the same from another batch
    shared = ~new_token
    shared[:-1] |= ~new_token[1:]
    shared[-1] |= next_token is not None and next_token == token[-1]
    at = np.maximum.accumulate(np.where(new_band, np.arange(len(token)), -1))
    own = [np.where(at >= 0, x[np.maximum(at, 0)], 0 if leader is None else leader[k]).astype(np.int64) for k, x in enumerate((n, pos, key, root))]
    heads = np.flatnonzero(new_band & ~new_token)  # these follow the leader of the band before
    to = [x.copy() for x in own]
    for k in range(4):
        to[k][heads] = np.where(heads > 0, own[k][heads - 1], 0 if leader is None else leader[k])
    ok = _can_link(n.astype(np.int64), pos.astype(np.int64), to[0], to[1], percent) & ~new_token & (to[3] != root)
    after = ((token[-1], band[-1], key[-1]), tuple(x[-1] for x in own))
    if beside:
        found = [(to[2][ok], key[ok], to[3][ok], root[ok])]
        met = np.zeros(len(token), dtype=np.int64)
        for k in range(1, min(beside, len(token) - 1) + 1):
            near = (token[k:] == token[:-k]) & (band[k:] == band[:-k]) & (root[k:] != root[:-k])
            near &= _can_link(n[k:].astype(np.int64), pos[k:].astype(np.int64), n[:-k].astype(np.int64), pos[:-k].astype(np.int64), percent)
            near = np.flatnonzero(near & (met[k:] < _MEETS))
            differ = sum(np.bitwise_count(x.view(np.uint64)[near + k] ^ x.view(np.uint64)[near]).astype(np.int64) for x in bits)
            near = near[differ * (100 + percent) <= (100 - percent) * (n[near].astype(np.int64) + n[near + k])]
            met[near + k] += 1
            found.append((key[:-k][near], key[k:][near], root[:-k][near], root[k:][near]))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*found, strict=True)], names=["a", "b", "root_a", "root_b"]), after
    keep = shared & ~again
    out = pa.RecordBatch.from_arrays(
        [pa.array(x[keep]) for x in (token, band, pos, n, key)] + [pa.array(to[2][keep], mask=~ok[keep])],
        names=["token", "band", "pos", "n", "key", "leader"],
    )
    return out, after


def _led_rows(rows: DataFrame, percent: int) -> DataFrame:
    """``rows`` (token, band, pos, n, key, root) whose token others share, each with the leader of its token and band."""
    rows = rows.repartition("token").sortWithinPartitions("token", "band", "key").select("token", "band", "pos", "n", "key", "root")
    return rows.mapInArrow(_leaders(percent, 0), "token long, band int, pos int, n int, key long, leader long")


def _led_pairs(rows: DataFrame, percent: int, beside: int, turn: int = 0) -> DataFrame:
    """Pairs across roots of rows that share a token, with the roots in order: each with a leader and neighbours that change from token to token and from turn to turn."""
    late = F.col("pos") * (100 + percent) > F.col("n") * (100 - percent)  # links with smaller sets only, so the others stand together
    rows = rows.repartition("token").sortWithinPartitions("token", "band", late, F.xxhash64("key", "token", F.lit(turn)))
    rows = rows.select("token", "band", "pos", "n", "key", "root", *[F.col("bits")[k].alias(f"bits_{k}") for k in range(_SHORT // 64)])
    pairs = rows.mapInArrow(_leaders(percent, beside), "a long, b long, root_a long, root_b long")
    return pairs.select(*[f("a", "b").alias(c) for f, c in ((F.least, "a"), (F.greatest, "b"))], *[f("root_a", "root_b").alias(c) for f, c in ((F.least, "low"), (F.greatest, "high"))]).distinct()


def _plausible(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that their sketches don't rule out; of pairs with the roots ``low`` and ``high`` of their components, a few for each two."""
    roots = [c for c in ("low", "high") if c in pairs.columns]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, m, x, y = (batch.column(i).to_pylist() for i in range(4))
            ok = [sketch_distance(p, q) * (100 + percent) <= (100 - percent) * (i + j) for i, j, p, q in zip(n, m, x, y, strict=True)]
            yield batch.select(["a", "b", *roots]).filter(pa.array(ok, type=pa.bool_()))

    for side in ("a", "b"):
        pairs = pairs.join(classes.select(F.col("ck").alias(side), F.col("n").alias(f"n_{side}"), F.col("sketch").alias(f"sketch_{side}")), side)
    pairs = pairs.select("n_a", "n_b", "sketch_a", "sketch_b", "a", "b", *roots).mapInArrow(compare, ", ".join(f"{c} long" for c in ("a", "b", *roots)))
    if roots:  # one link joins two components, so the other pairs are for later rounds
        pair = F.struct(F.xxhash64("a", "b").alias("h"), "a", "b")
        pairs = pairs.groupBy(*roots).agg(F.array_distinct(F.array(F.min(pair), F.max(pair))).alias("few")).select(F.explode("few").alias("pair")).select("pair.a", "pair.b")
    return pairs


def _verify(pairs: DataFrame, classes: DataFrame, docs: DataFrame, words: int, percent: int, salts: int = 8) -> tuple[DataFrame, DataFrame]:
    """Of class pairs (a, b), those whose sets reach the similarity; each text is sent once for each pair it is the b of.

    Also the texts that were read for it, (ck, text).
    """
    pairs = materialize(_plausible(pairs, classes, percent), "pairs").withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(salts)).cast("int"))
    wanted = materialize(pairs.select(F.col("a").alias("ck")).union(pairs.select(F.col("b").alias("ck"))).distinct().join(classes.select("ck", "rk"), "ck"), "wanted")
    keyed = docs.select(row_key("doc_id", "text").alias("rk"), "text")
    texts = materialize(keyed.join(wanted, "rk").groupBy("ck").agg(F.first("text").alias("text")), "texts")  # equal rows send one text
    members = pairs.join(texts.withColumnRenamed("ck", "b"), "b").select("a", "salt", F.col("b"), "text")
    heads = pairs.select("a", "salt").distinct().join(texts.withColumnRenamed("ck", "a"), "a").select("a", "salt", F.lit(None).cast("long").alias("b"), "text")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = held_key = None
        for batch, texts_ in blocks(batches, "text"):
            found = ([], [])
            for (a, salt, b), s in zip(zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True), shingle_sets(texts_, words), strict=True):
                if b is None:
                    held, held_key = s, (a, salt)
                elif held_key == (a, salt):
                    common = len(np.intersect1d(held, s, assume_unique=True))
                    if 100 * common >= percent * (len(held) + len(s) - common):
                        found[0].append(a)
                        found[1].append(b)
            yield pa.RecordBatch.from_arrays([pa.array(x, type=pa.int64()) for x in found], names=["a", "b"])

    together = heads.union(members).repartition("a", "salt").sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first())
    return materialize(together.mapInArrow(compare, "a long, b long"), "links"), texts


def _between(rows: DataFrame, classes: DataFrame, roots: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The ``rows`` (with ck) of tokens that classes of several components hold, with their roots; and each class's root."""
    placed = classes.join(roots.withColumnRenamed("v", "ck"), "ck", "left").select("ck", "gkey", F.coalesce("root", "ck").alias("root"))
    rows = rows.join(placed.select("ck", "root"), "ck")
    mixed = rows.groupBy("token").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("token")
    return materialize(rows.join(mixed, "token").select("token", "band", "pos", "n", "ck", "root"), "mixed"), placed


def _merged(roots: DataFrame, links: DataFrame) -> DataFrame:
    """The components (v, root) after more ``links`` (a, b); old components meet as one vertex each."""
    for side in ("a", "b"):
        links = links.join(roots.select(F.col("v").alias(side), F.col("root").alias(f"root_{side}")), side, "left")
    met = components(links.select(F.coalesce("root_a", "a").alias("a"), F.coalesce("root_b", "b").alias("b")).distinct())
    old = roots.join(met.select(F.col("v").alias("root"), F.col("root").alias("now")), "root", "left").select("v", F.coalesce("now", "root").alias("root"))
    return materialize(old.union(met.join(roots, "v", "left_anti").select("v", "root")), "roots")


def _link_counts(placed: DataFrame, texts: DataFrame, words: int, percent: int, block: int = 256) -> DataFrame:
    """(ck, n_links) of classes that link with others: how many of them, from rows (ck, root) of ``placed`` and the texts (ck, text) of all classes with links."""
    several = placed.groupBy("root").agg(F.count("*").alias("m")).where("m > 1")
    members = placed.join(several, "root").withColumn("blocks", F.ceil(F.col("m") / block).cast("int")).withColumn("own", F.pmod(F.xxhash64("ck"), F.col("blocks")).cast("int"))
    members = materialize(members.select("ck", "root", "own", "blocks"), "members")
    texts = texts.join(members, "ck").groupBy("ck").agg(*[F.first(c).alias(c) for c in ("root", "own", "blocks", "text")])
    met = texts.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.select("root", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), "own", "ck", "text").repartition("root", "a", "b").sortWithinPartitions("root", "a", "b")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held = None, []  # of one pair of blocks: (own, ck, set)

        def counted() -> pa.RecordBatch:
            own, ck = np.asarray([h[0] for h in held]), np.asarray([h[1] for h in held], dtype=np.int64)
            n = common_elements([h[2] for h in held], own == group[1], own == group[2], percent)
            return pa.RecordBatch.from_arrays([pa.array(ck[n > 0]), pa.array(n[n > 0])], names=["ck", "n"])

        for batch, texts_ in blocks(batches, "text"):
            for root, a, b, own, ck, s in zip(*(batch.column(i).to_pylist() for i in range(5)), shingle_sets(texts_, words), strict=True):
                if group != (root, a, b):
                    if len(held) > 1:
                        yield counted()
                    group, held = (root, a, b), []
                held.append((own, ck, s))
        if len(held) > 1:
            yield counted()

    return met.mapInArrow(count, "ck long, n long").groupBy("ck").agg(F.sum("n").alias("n_links"))


def common_elements(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, percent: int) -> np.ndarray:
    """How many sets of the other side each set links with; with equal sides, how many others."""
    sizes = np.asarray([len(s) for s in sets], dtype=np.int64)
    row = np.repeat(np.arange(len(sets)), sizes)
    _, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = times[column] > 1
    row, column = row[shared], np.unique(column[shared], return_inverse=True)[1]
    i, j = np.flatnonzero(left), np.flatnonzero(right)
    common = np.zeros((len(i), len(j)), dtype=np.float32)
    order = np.argsort(column, kind="stable")
    row, column, width = row[order], column[order], 4096
    for low in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        at = slice(*np.searchsorted(column, [low, low + width]))
        part = np.zeros((len(sets), width), dtype=np.float32)
        part[row[at], column[at] - low] = 1
        common += part[i] @ part[j].T
    n, m, common = sizes[i][:, None], sizes[j][None, :], common.astype(np.int64)
    linked = (100 * common >= percent * (n + m - common)) & (i[:, None] != j[None, :])
    out = np.zeros(len(sets), dtype=np.int64)
    out[i] += linked.sum(axis=1)
    if not (left & right).any():
        out[j] += linked.sum(axis=0)
    return out


_ROUNDS = 8  # at most; what they leave is found by the last join


def _joined(docs: DataFrame, words: int, percent: int, common: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Signs of all rows (rk, doc_id, n, ck), the component of each class (ck, first_id, root), and the texts (ck, text) of all classes with links.

    A class with a link had one verified, so its text was read then.
    """
    signs = materialize(_sign(docs, words, percent, _common_shingles(docs, words, common)), "signs")
    # extra work for equal sets ends here: from now on there is one row for each class
    classes = materialize(signs.where("n > 0").groupBy("ck").agg(F.min("rk").alias("rk"), F.min("doc_id").alias("first_id"), F.first("n").alias("n"), F.first("gkey").alias("gkey"), F.first("sketch").alias("sketch"), F.first("bits").alias("bits")), "classes")
    tokens = signs.where("prefix is not null").select(F.posexplode("prefix").alias("pos", "token"), "n", F.col("gkey").alias("key"), F.col("gkey").alias("root"), F.floor(F.log(F.col("n")) / _band_width(percent)).cast("int").alias("band"))
    live = materialize(_led_rows(tokens, percent), "live")
    # star pairs: each group with its leaders, and the classes of one group with the first of them
    groups = classes.groupBy("gkey").agg(F.min("ck").alias("first_ck"))
    stars = live.where("leader is not null").select(F.col("key").alias("gkey"), "leader").distinct()
    stars = stars.join(groups, "gkey").withColumnRenamed("first_ck", "b").join(groups.select(F.col("gkey").alias("leader"), F.col("first_ck").alias("a")), "leader").select("a", "b")
    inner = classes.join(groups, "gkey").where("ck <> first_ck").select(F.col("first_ck").alias("a"), F.col("ck").alias("b"))
    links, texts = _verify(stars.union(inner), classes, docs, words, percent)
    # from here on only shingles that several components share matter
    rows = live.select("token", "band", "pos", "n", F.col("key").alias("gkey")).join(classes.select("gkey", "ck"), "gkey").select("token", "band", "pos", "n", "ck")
    roots = components(links)
    rows, placed = _between(rows, classes, roots)
    for turn in range(_ROUNDS):
        more = _led_pairs(rows.join(classes.select("ck", "bits"), "ck").withColumnRenamed("ck", "key"), percent, 64, turn)
        found, read = _verify(more, classes, docs, words, percent)
        linked = found.count()
        if linked:
            roots, texts = _merged(roots, found), texts.union(read)
            rows, placed = _between(rows.drop("root"), classes, roots)
        if linked * 100 < roots.count():
            break
    # the rest: every pair across components that the filters let through
    rows = rows.join(classes.select("ck", "bits"), "ck")
    differ = sum((F.bit_count(F.col("bits")[k].bitwiseXOR(F.col("bits_b")[k])) for k in range(1, _SHORT // 64)), F.bit_count(F.col("bits")[0].bitwiseXOR(F.col("bits_b")[0])))
    far = rows.select("token", F.col("bits").alias("bits_b"), F.explode(F.array(F.col("band") - 1, F.col("band"))).alias("band"), F.col("pos").alias("i"), F.col("n").alias("x"), F.col("ck").alias("b"), F.col("root").alias("root_b"), F.col("band").alias("own"))
    across = rows.join(far, ["token", "band"]).where(
        (F.col("root") != F.col("root_b")) & ((F.col("own") != F.col("band")) | (F.col("ck") < F.col("b"))) & _can_link(F.col("n"), F.col("pos"), F.col("x"), F.col("i"), percent)
        & (differ * (100 + percent) <= (100 - percent) * (F.col("n") + F.col("x")))
    )
    within = placed.join(placed.select("gkey", F.col("ck").alias("b"), F.col("root").alias("root_b")), "gkey").where("root < root_b").select(F.col("ck").alias("a"), "b")
    rest = across.select(F.col("ck").alias("a"), "b").union(within).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    found, read = _verify(rest, classes, docs, words, percent)
    roots = _merged(roots, found)
    return signs, materialize(classes.join(roots.withColumnRenamed("v", "ck"), "ck", "left").select("ck", "first_id", F.coalesce("root", "ck").alias("root")), "named"), texts.union(read)


def jaccard_components(docs: DataFrame, words: int = 5, percent: int = 80, common: int = 1 << 18, links: bool = False) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (smallest doc_id that links reach), class_id (equal sets).

    Two documents link when ``100 * |A ∩ B| >= percent * |A ∪ B|`` over their sets of ``words``-word shingles
    (A-Z lower-cased; fewer words: the whole sequence). With ``links``, also n_links: how many other classes the
    document's class links with (0: none), inside every component, however large. Null, empty and wordless texts have no set and
    link with nothing; very long texts are read whole; a row without doc_id takes part in links, and its component has the smallest
    doc_id there is (null if none). Repeated rows share a class. An empty table has no rows. Other columns are ignored.
    ``common`` bounds the table of shared shingles that orders the prefixes; it affects speed alone.
    """
    docs = docs.select("doc_id", "text")
    signs, named, texts = _joined(docs, words, percent, common)
    found = named.join(named.groupBy("root").agg(F.min("first_id").alias("component_id")), "root")
    if links:
        found = found.join(_link_counts(named.select("ck", "root"), texts, words, percent), "ck", "left")
    found = materialize(found.select("ck", "component_id", *[F.coalesce("n_links", F.lit(0)).alias("n_links")] * links), "found")
    out = signs.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("n") > 0, F.col("ck")).alias("ck")).join(found, "ck", "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("ck").alias("class_id"), *[F.coalesce("n_links", F.lit(0)).alias("n_links")] * links)


def drop_near_copies(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one row of each group of near copies, the one with the smallest doc_id (then the smallest hash of the row).

    Rows are told apart by doc_id and text, so unlike texts that share a doc_id are judged on their own; of equal rows one
    stays. Rows without doc_id come after all others of their group. Rows without a set of shingles (null, empty, wordless
    texts) stay. All columns pass unchanged, whatever their names.
    """
    signs, named, _ = _joined(docs.select("doc_id", "text"), words, percent, 1 << 18)
    rows = signs.where("n > 0").select("rk", "doc_id", "ck").join(named.select("ck", "root"), "ck")
    first = F.struct(F.coalesce("doc_id", F.lit(2**63 - 1)).alias("d"), "rk")
    keepers = materialize(rows.groupBy("root").agg(F.min(first).alias("first")).select("first.d", "first.rk"), "keepers")
    marked = rows.groupBy("rk", F.coalesce("doc_id", F.lit(2**63 - 1)).alias("d")).agg(F.count("*").alias("n"))
    marked = materialize(marked.join(keepers.withColumn("keeps", F.lit(True)), ["rk", "d"], "left").where("keeps is null or n > 1"), "marked")
    keyed = docs.select(F.struct("*").alias("row"), row_key("doc_id", "text").alias("rk"), F.coalesce(F.col("doc_id").cast("long"), F.lit(2**63 - 1)).alias("d"))
    kept = keyed.join(marked.where("keeps is null"), ["rk", "d"], "left_anti")
    again = marked.where("keeps").select("rk", "d")
    once = kept.join(again, ["rk", "d"], "left_semi").groupBy("rk", "d").agg(F.first("row").alias("row"))
    return kept.join(again, ["rk", "d"], "left_anti").select("row").unionByName(once.select("row")).select("row.*")


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"), links=True)
