"""Hybrid retrieval: semantic seeds, keyword hits, fusion, expansion and rendering, for many queries and namespaces at once."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators.archive import resolve_titles
from corpusloom.operators.embedding import RecallOptions, nearest
from corpusloom.operators.messages import keep_until, keep_within, rrf_fuse
from corpusloom.operators.vector_index import VectorIndex

Materialize = Callable[[DataFrame], DataFrame]


class _Searched:
    """Groups of parts in one automaton: which groups have ``need`` of their parts in a text, in one pass over the text."""

    def __init__(self, groups: list[tuple[str, list[str], int]]):
        import ahocorasick

        asked: dict[str, list[int]] = defaultdict(list)
        for no, (_, parts, _) in enumerate(groups):
            for part in dict.fromkeys(p for p in parts if p):
                asked[part].append(no)
        self.keys, self.need = [g[0] for g in groups], np.asarray([g[2] for g in groups], dtype=np.int64)
        self._by_part = [np.asarray(nos, dtype=np.int64) for nos in asked.values()]
        self._automaton = ahocorasick.Automaton()
        for k, part in enumerate(asked):
            self._automaton.add_word(part, k)
        self._automaton.make_automaton()

    def __call__(self, text: str | None) -> list[tuple[str, int]]:
        found = {k for _, k in self._automaton.iter(text)} if text and self._by_part else ()
        if not found:
            return []
        groups, n = np.unique(np.concatenate([self._by_part[k] for k in found]), return_counts=True)
        enough = n >= self.need[groups]
        return [(self.keys[g], m) for g, m in zip(groups[enough].tolist(), n[enough].tolist(), strict=True)]


def contained(groups: DataFrame, texts: DataFrame, together: int = 1 << 21, part_bytes: int = 1 << 27) -> DataFrame:
    """(key, id, matched): groups of parts (key, parts, need) with ``need`` or more of their distinct parts in a text (id, low), and how many.

    Texts are read once, whatever the number of parts, by an automaton of the parts. Groups of up to ``together`` bytes, with their keys, go to
    every task; more of them are dealt to blocks of that size, and every block of texts meets every block of groups. A null or empty text holds
    nothing; empty parts are nowhere; repeated texts count each.
    """
    key_kind, id_kind = groups.schema["key"].dataType, texts.schema["id"].dataType
    packed = lambda c, of: F.to_json(F.struct(F.col(c).alias("v"))).alias(of)
    g = groups.select(packed("key", "key"), "parts", F.col("need").cast("int").alias("need"))
    t = texts.select(packed("id", "id"), "low")
    size = lambda c: F.coalesce(F.sum(F.octet_length(c)), F.lit(0))
    total = g.agg(size(F.concat("key", F.array_join("parts", " "))).alias("n")).first()["n"]  # one number
    schema, names = "key string, id string, matched int", ["key", "id", "matched"]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*rows, strict=True)) or [[]] * 3
        return pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(cols, (pa.string(), pa.string(), pa.int32()), strict=True)], names=names)

    def hits(search: _Searched, ids: list, lows: list) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for of, low in zip(ids, lows, strict=True):
            rows += [(key, of, n) for key, n in search(low)]
            if len(rows) > 50_000:
                yield batch_of(rows)
                rows = []
        yield batch_of(rows)

    if total <= together:
        held = [tuple(r) for r in g.collect()]  # at most ``together`` bytes

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            search = _Searched(held)
            for batch in batches:
                yield from hits(search, *(c.to_pylist() for c in batch.columns))

        found = t.mapInArrow(scan, schema)
    else:
        blocks = -(-total // together)
        parts = -(-t.agg(size("low").alias("n")).first()["n"] // part_bytes) or 1
        every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
        dealt = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
        a = g.select(dealt("key", blocks).alias("block"), every(parts).alias("part"), F.lit(0).alias("role"), F.col("key").alias("name"), "parts", "need", F.lit(None).cast("string").alias("low"))
        b = t.select(every(blocks).alias("block"), dealt("id", parts).alias("part"), F.lit(1).alias("role"), F.col("id").alias("name"), F.lit(None).cast("array<string>").alias("parts"), F.lit(None).cast("int").alias("need"), "low")
        met = a.unionByName(b).repartition("block", "part").sortWithinPartitions("block", "part", "role")

        def scan_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            at, held, search = None, [], None
            for batch in batches:
                block, part, role, name, parts_of, need, low = (c.to_pylist() for c in batch.columns)
                first = 0
                for i in range(len(block) + 1):
                    if i < len(block) and (block[i], part[i], role[i]) == (block[first], part[first], role[first]):
                        continue
                    if (block[first], part[first]) != at:
                        at, held, search = (block[first], part[first]), [], None
                    if role[first] == 0:
                        held += zip(name[first:i], parts_of[first:i], need[first:i], strict=True)
                    elif held:
                        search = search or _Searched(held)
                        yield from hits(search, name[first:i], low[first:i])
                    first = i

        found = met.mapInArrow(scan_blocks, schema)
    back = lambda c, kind: F.from_json(c, f"v {kind.simpleString()}")["v"].alias(c)
    return found.select(back("key", key_kind), back("id", id_kind), "matched")


def entity_keyword_hits(queries: DataFrame, entities: DataFrame, least: int = 3) -> DataFrame:
    """(query_id, namespace, name, ordinal): the query's text holds the name or an alias of ``least`` characters; a shorter name bars its aliases."""
    keys = F.transform(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>"))), T.norm_key)
    e = entities.where(F.length(T.norm_key(F.col("name"))) >= least).select(F.struct("namespace", "name", "ordinal").alias("key"), F.array_distinct(F.filter(keys, lambda k: F.length(k) >= least)).alias("parts"), F.lit(1).alias("need"))
    hits = contained(e, queries.select(F.col("query_id").alias("id"), F.lower("text").alias("low")))
    return hits.select(F.col("id").alias("query_id"), "key.*").distinct()


def chunk_keyword_hits(queries: DataFrame, chunks: DataFrame) -> DataFrame:
    """(query_id, id, matched) of chunks that hold at least half of the query's distinct terms (rounded down, one at least)."""
    q = queries.select(F.col("query_id").alias("key"), T.query_terms(F.col("text")).alias("parts")).where(F.size("parts") > 0)
    q = q.withColumn("need", F.greatest(F.lit(1), F.floor(F.size("parts") / 2)))
    hits = contained(q, chunks.select("id", F.lower("text").alias("low")))
    return hits.select(F.col("key").alias("query_id"), "id", F.col("matched").cast("long").alias("matched"))


def semantic_seeds(queries: DataFrame, entities: DataFrame, options: RecallOptions, index: VectorIndex | None = None) -> DataFrame:
    """The seeds of every query, exactly, or by an index of the entities."""
    return nearest(queries, entities, options.seeds, options.floor) if index is None else index.search(queries, options.seeds, options.floor)


def rank_chunks(queries: DataFrame, chunks: DataFrame, options: RecallOptions) -> DataFrame:
    return nearest(queries, chunks, options.candidates, options.floor)


def fuse_chunks(ranked: DataFrame, keyword: DataFrame, k: int = 5) -> DataFrame:
    """The ``k`` best of a vector list (query_id, id, rank) and a keyword list (query_id, id), the latter in order of id."""
    w = Window.partitionBy("query_id").orderBy("id")
    lists = ranked.select("query_id", F.lit(1).alias("list_no"), "rank", "id").unionByName(keyword.select("query_id", F.lit(2).alias("list_no"), F.row_number().over(w).alias("rank"), "id"))
    return rrf_fuse(lists, k)


def union_hits(*parts: DataFrame) -> DataFrame:
    """Names that any of the parts has, each once."""
    every = parts[0].select("name")
    for p in parts[1:]:
        every = every.union(p.select("name"))
    return every.distinct()


def search_scope(queries: DataFrame, namespaces: DataFrame, current: str = "", common: str = "_global_") -> DataFrame:
    """(query_id, namespace, place): the namespaces that a query (query_id, project) searches, in order.

    ``*`` means all of ``namespaces`` by name, names between commas mean these, and an empty or null project means the current one and the common one.
    """
    asked = T.trim(F.coalesce("project", F.lit("")))
    named = F.filter(F.transform(F.split(asked, ","), T.trim), lambda n: n != "")
    own = [n for n in dict.fromkeys((current, common)) if n]
    listed = F.when(asked == "", F.array(*[F.lit(n) for n in own]).cast("array<string>")).otherwise(F.array_distinct(named))
    one_by_one = queries.where(asked != "*").select("query_id", F.posexplode(listed).alias("place", "namespace"))
    every = namespaces.select("namespace").distinct().groupBy().agg(F.array_sort(F.collect_list("namespace")).alias("all"))
    return one_by_one.unionByName(queries.where(asked == "*").crossJoin(every).select("query_id", F.posexplode("all").alias("place", "namespace"))).select("query_id", "namespace", "place")


def every_scope(queries: DataFrame, entities: DataFrame) -> DataFrame:
    """All namespaces that have entities, for every query."""
    return search_scope(queries.select("query_id", F.lit("*").alias("project")), entities)


def _own(key: str) -> Column:
    return F.struct("namespace", F.col(key).alias("k"))


def expand_hits(start: DataFrame, relations: DataFrame, hops: int, materialize: Materialize = lambda df: df) -> DataFrame:
    """(query_id, namespace, key): what ``hops`` steps along a namespace's relations, forwards, reach from ``start`` beyond itself; names meet in lower case."""
    edges = relations.select("namespace", F.lower("src").alias("key"), F.lower("dst").alias("to")).distinct()
    known = front = start.select("query_id", "namespace", "key").distinct()
    for _ in range(hops):
        near = front.join(edges, ["namespace", "key"]).select("query_id", "namespace", F.col("to").alias("key")).distinct()
        front = materialize(near.join(known, ["query_id", "namespace", "key"], "left_anti"))
        known = known.unionByName(front)
    return known.join(start.select("query_id", "namespace", "key").distinct(), ["query_id", "namespace", "key"], "left_anti")


def recall(
    queries: DataFrame, entities: DataFrame, relations: DataFrame, chunks: DataFrame, options: RecallOptions, materialize: Materialize = lambda df: df, scope: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """Hits (query_id, namespace, key, how, rank) and chunks (query_id, namespace, id, rank) of every namespace that a query searches.

    Queries are (query_id, text, embedding), entities, relations and chunks have a namespace, ``scope`` is that of ``search_scope`` (all
    namespaces without it). Each namespace has seeds, fusion and best chunks of its own. ``key`` is the lower-cased name, ``how`` adds
    1 for a vector, 2 for a word, 4 for relations (``options.hops`` steps, only where there are semantic seeds), ``rank`` is the seed's. A query without a
    vector has word hits alone. ``materialize`` writes what is read several times.
    """
    scope = materialize((every_scope(queries, entities) if scope is None else scope).select("query_id", "namespace").distinct())
    asked = queries.where(F.size("embedding") > 0).join(scope, "query_id").withColumn("query_id", F.struct("query_id", "namespace"))
    found = nearest(asked, entities.select("namespace", "embedding", _own("name").alias("id")), options.seeds, options.floor, within="namespace")
    seeds = materialize(found.select("query_id.*", F.lower(F.col("id.k")).alias("key"), "rank"))
    words = entity_keyword_hits(queries, entities).join(scope, ["query_id", "namespace"], "left_semi")
    words = materialize(words.select("query_id", "namespace", F.lower("name").alias("key")).distinct())
    start = seeds.drop("rank").union(words.join(seeds.select("query_id", "namespace").distinct(), ["query_id", "namespace"], "left_semi"))
    near = expand_hits(start, relations, options.hops, materialize)
    none = F.lit(None).cast("int")
    marked = seeds.select("query_id", "namespace", "key", F.lit(1).alias("how"), "rank").unionByName(words.select("*", F.lit(2).alias("how"), none.alias("rank"))).unionByName(near.select("*", F.lit(4).alias("how"), none.alias("rank")))
    hits = marked.groupBy("query_id", "namespace", "key").agg(F.bit_or("how").alias("how"), F.min("rank").alias("rank"))
    own_chunks = chunks.where(F.size("embedding") > 0).withColumn("id", _own("id"))
    ranked = nearest(asked, own_chunks, options.candidates, options.floor, within="namespace")
    keyword = chunk_keyword_hits(queries.where(F.size("embedding") > 0), own_chunks).select("query_id", F.col("id.namespace").alias("namespace"), "id")
    keyword = keyword.join(scope, ["query_id", "namespace"], "left_semi").select(F.struct("query_id", "namespace").alias("query_id"), "id")
    best = fuse_chunks(ranked, keyword, options.kept)
    return hits, best.select("query_id.*", F.col("id.k").alias("id"), "rank")


def _told(ids: DataFrame, titles: DataFrame | None, now_ms: int) -> DataFrame:
    """(namespace, source, shown): sources of ``ids`` (namespace, source) as they are shown, by title and age."""
    if titles is None:
        titles = ids.sparkSession.createDataFrame([], "namespace string, id string, title string")
    return resolve_titles(ids.distinct(), titles, "source", now_ms).withColumnRenamed("title", "shown")


def _shown(
    queries: DataFrame, entities: DataFrame, relations: DataFrame, chunks: DataFrame, options: RecallOptions, structure: int, raw: int, materialize: Materialize, scope: DataFrame | None, titles: DataFrame | None, now_ms: int,
    entity_text: Callable[[Column, Column, Column, Column], Column], chunk_text: Callable[[Column, Column], Column],
) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, DataFrame]:
    """Hits, chunks, and what is shown of them under the budgets: entities (.., rank, name, sources, text), relations (.., rank, text), chunks (.., rank, source, shown, body, text)."""
    hits, best = recall(queries, entities, relations, chunks, options, materialize, scope)
    hits, best = materialize(hits), materialize(best)
    e = entities.withColumn("key", T.norm_key(F.col("name"))).join(hits.select("namespace", "key").distinct(), ["namespace", "key"], "left_semi")
    e = materialize(e.select("namespace", "key", "ordinal", "name", F.coalesce("type", F.lit("")).alias("type"), F.coalesce("observations", F.array().cast("array<struct<text:string,source:string>>")).alias("observations")))
    facts = e.select("namespace", "key", "ordinal", "name", F.posexplode("observations").alias("at", "o")).select("namespace", "key", "ordinal", "name", "at", "o.text", F.coalesce("o.source", F.lit("")).alias("source"))
    facts = facts.join(_told(facts.where("source <> ''").select("namespace", "source"), titles, now_ms), ["namespace", "source"], "left")
    facts = facts.groupBy("namespace", "key", "ordinal", "name").agg(F.array_sort(F.collect_list(F.struct("at", "text", "source", F.coalesce("shown", F.lit("")).alias("shown")))).alias("facts"))
    e = e.drop("observations").join(facts, ["namespace", "key", "ordinal", "name"], "left").withColumn("facts", F.coalesce("facts", F.array().cast(facts.schema["facts"].dataType)))
    field = lambda name: F.transform("facts", lambda f: f[name])
    e = e.select("namespace", "key", "ordinal", "name", F.filter(field("source"), lambda x: x != "").alias("sources"), entity_text(F.col("name"), F.col("type"), field("text"), field("shown")).alias("text"))
    found = materialize(hits.select("query_id", "namespace", "key").join(e, ["namespace", "key"]))
    found = keep_until(found, ["query_id", "namespace"], ["ordinal", "name"], F.octet_length("text"), structure)
    w = Window.partitionBy("query_id", "namespace")
    found = found.select("query_id", "namespace", F.row_number().over(w.orderBy("ordinal", "name")).alias("rank"), "name", "sources", "text")

    ends = relations.select("namespace", F.lower("src").alias("key"), F.lower("dst").alias("to"), "ordinal", T.render_relation(F.col("src"), F.col("label"), F.col("dst")).alias("line"))
    inside = ends.join(hits.select("query_id", "namespace", "key"), ["namespace", "key"]).join(hits.select("query_id", "namespace", F.col("key").alias("to")), ["query_id", "namespace", "to"])
    edges = inside.select("query_id", "namespace", F.row_number().over(w.orderBy("ordinal", "line")).alias("rank"), F.concat(F.lit("- "), "line", F.lit("\n")).alias("text"))

    c = materialize(best.join(chunks.select("namespace", "id", F.col("text").alias("body"), F.coalesce("source", F.lit("")).alias("source")), ["namespace", "id"]))
    c = keep_within(c, ["query_id", "namespace"], ["rank"], F.octet_length("body"), raw)
    c = c.join(_told(c.select("namespace", "source"), titles, now_ms), ["namespace", "source"])
    return hits, best, found, edges, c.select("query_id", "namespace", "rank", "source", "shown", "body", chunk_text(F.col("shown"), F.col("body")).alias("text"))


#: What stands around results.
INTRO = "> 以下知识来自历史对话蒸馏和手动记录，仅供参考。涉及具体实现细节时以代码为准；标注⚠️的条目超过90天可能已过时。\n\n"
CUT = "\n> （结果已截断，如需更多请指定具体 project 参数缩小范围）\n"
LEXICAL = "\n> 注：当前为关键词模式（本地词面向量），语义召回为字面近似，精度有限。\n"
SECTIONS = {"intro": None, "heading": None, "structure": "\n## 结构（实体与关系）\n", "relations": "\n关系：\n", "chunks": "\n## 相关原文片段（细节以原文为准）\n", "end": "\n---\n\n", "notice": None}


def search_knowledge(
    queries: DataFrame, entities: DataFrame, relations: DataFrame, chunks: DataFrame, options: RecallOptions, structure: int = 1600, raw: int = 4000, total: int = 8000, materialize: Materialize = lambda df: df,
    scope: DataFrame | None = None, titles: DataFrame | None = None, now_ms: int = 0, lexical: bool = True,
) -> DataFrame:
    """Rendered results (query_id, place, namespace, section, rank, text); in the order of place, ``SECTIONS`` and rank, texts make a query's document.

    Each namespace shows a heading, entities with their facts and sources (under ``structure`` bytes), relations among hits, and chunks with
    sources (within ``raw`` bytes). Namespaces follow each other in the order of ``scope`` while what stands before is under ``total`` bytes;
    a notice tells when one is left out, when nothing was found, and when vectors are lexical. Namespaces without entities show nothing. Sources are told by
    ``titles`` (namespace, id, title) and, for writes, by their age at ``now_ms``.
    """
    scope = materialize(every_scope(queries, entities) if scope is None else scope)
    filled = scope.join(entities.select("namespace").distinct(), "namespace", "left_semi")
    hits, _, e, r, c = _shown(queries, entities, relations, chunks, options, structure, raw, materialize, filled, titles, now_ms, T.render_entity, T.render_chunk)
    rows = None
    for section, df in (("structure", e), ("relations", r), ("chunks", c)):
        part = df.select("query_id", "namespace", F.lit(section).alias("section"), "rank", "text")
        rows = part if rows is None else rows.unionByName(part)
    rows = materialize(rows)
    here = rows.select("query_id", "namespace", "section").distinct()
    # relations stand below the heading of the structure
    headed = here.unionByName(here.where("section = 'relations'").withColumn("section", F.lit("structure"))).distinct()
    head = F.create_map(*[F.lit(x) for k, v in SECTIONS.items() if v for x in (k, v)])
    titled = headed.select("query_id", "namespace", "section", F.lit(0).alias("rank"), F.element_at(head, F.col("section")).alias("text"))
    # a namespace with hits that show nothing (names without entities) has its heading too
    spaces = hits.select("query_id", "namespace").union(here.select("query_id", "namespace")).distinct()
    named = spaces.join(queries.select("query_id", F.col("text").alias("asked")), "query_id")
    heading = F.concat(F.lit("# 项目 `"), "namespace", F.lit("` 与「"), T.trim(F.col("asked")), F.lit("」相关的业务知识\n"))
    named = named.select("query_id", "namespace", F.lit("heading").alias("section"), F.lit(0).alias("rank"), heading.alias("text"))
    ended = spaces.select("query_id", "namespace", F.lit("end").alias("section"), F.lit(0).alias("rank"), F.lit(SECTIONS["end"]).alias("text"))
    rows = rows.unionByName(titled).unionByName(named).unionByName(ended)

    sizes = rows.groupBy("query_id", "namespace").agg(F.sum(F.octet_length("text")).alias("size"))
    w = Window.partitionBy("query_id").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    placed = scope.join(sizes, ["query_id", "namespace"], "left").withColumn("before", F.lit(len(INTRO.encode())) + F.coalesce(F.sum("size").over(w), F.lit(0)))
    placed = materialize(placed.select("query_id", "namespace", "place", "size", (F.col("before") < total).alias("fits")))
    kept = rows.join(placed.where("fits"), ["query_id", "namespace"]).select("query_id", "place", "namespace", "section", "rank", "text")
    per = placed.groupBy("query_id").agg(F.count("size").alias("hit"), F.bool_and("fits").alias("whole"), F.max("place").alias("last"), F.transform(F.array_sort(F.collect_list(F.struct("place", "namespace"))), lambda s: s["namespace"]).alias("names"))
    per = queries.select("query_id", F.col("text").alias("asked")).join(per, "query_id", "left")
    empty = F.coalesce("hit", F.lit(0)) == 0
    nothing = F.concat(F.lit("在命名空间 ["), F.array_join(F.coalesce("names", F.array().cast("array<string>")), " "), F.lit("] 里没有查到和「"), T.trim(F.col("asked")), F.lit("」相关的知识。"))
    notes = F.when(empty, nothing).otherwise(F.concat(F.when(~F.col("whole"), F.lit(CUT)).otherwise(""), F.lit(LEXICAL if lexical else "")))
    around = per.select("query_id", F.explode(F.array(F.struct(F.lit(-1).alias("place"), F.lit("intro").alias("section"), F.when(~empty, F.lit(INTRO)).alias("text")), F.struct((F.coalesce("last", F.lit(0)) + 1).alias("place"), F.lit("notice").alias("section"), notes.alias("text")))).alias("x"))
    around = around.select("query_id", "x.place", F.lit(None).cast("string").alias("namespace"), "x.section", F.lit(0).alias("rank"), "x.text").where("text <> ''")
    return kept.unionByName(around)


def match_knowledge(
    queries: DataFrame, entities: DataFrame, relations: DataFrame, chunks: DataFrame, options: RecallOptions, structure: int = 1600, raw: int = 4000, materialize: Materialize = lambda df: df,
    scope: DataFrame | None = None, titles: DataFrame | None = None, now_ms: int = 0, lexical: bool = True,
) -> tuple[DataFrame, DataFrame]:
    """What a chat is given, for each (query_id, namespace) with a hit: a row of what was matched and how, and the context as rows.

    The row has names (entities shown, in the graph's order), semantic_seeds (best first), keyword_hits, chunk_hits (chunks before the budget), sources (of the shown facts
    and chunks, each once, in order, as they are told), method, and local (a lexical vector found something). Context rows are
    (query_id, namespace, section, rank, text).
    """
    line = lambda name, kind, facts, sources: F.concat(F.lit("\n【"), name, F.lit("】\n"), F.array_join(F.transform(facts, lambda o: F.concat(F.lit("- "), o, F.lit("\n"))), ""))  # noqa: E731, ARG005
    quote = lambda source, text: F.concat(F.lit("\n〔来源："), source, F.lit("〕\n"), text, F.lit("\n───\n"))
    hits, best, e, r, c = _shown(queries, entities, relations, chunks, options, structure, raw, materialize, scope, titles, now_ms, line, quote)
    e, c = materialize(e), materialize(c)
    keys = ["query_id", "namespace"]
    in_order = lambda rows, at, value: F.transform(F.array_sort(F.collect_list(F.struct(*at, value))), lambda x: x[value])
    names = e.groupBy(*keys).agg(in_order(e, ["rank"], "name").alias("names"))
    firsts = entities.groupBy("namespace", F.lower("name").alias("key")).agg(F.min_by(F.struct("name", "ordinal"), "ordinal").alias("first"))
    meant = hits.where("how % 4 > 0").join(firsts, ["namespace", "key"]).select(*keys, "how", F.col("rank").alias("seed"), "first.name", "first.ordinal")
    seeds = meant.where("how % 2 = 1").groupBy(*keys).agg(in_order(meant, ["seed"], "name").alias("semantic_seeds"))
    words = meant.where("how % 4 >= 2").groupBy(*keys).agg(in_order(meant, ["ordinal"], "name").alias("keyword_hits"))
    told = e.select(*keys, F.lit(0).alias("part"), "rank", F.posexplode("sources").alias("at", "source")).unionByName(c.select(*keys, F.lit(1).alias("part"), "rank", F.lit(0).alias("at"), "source"))
    told = told.where("source <> ''").groupBy(*keys, "source").agg(F.min(F.struct("part", "rank", "at")).alias("seen"))
    told = told.join(_told(told.select("namespace", "source"), titles, now_ms), ["namespace", "source"])
    sources = told.groupBy(*keys).agg(F.array_distinct(in_order(told, ["seen"], "shown")).alias("sources"))
    counts = best.groupBy(*keys).agg(F.count("*").alias("chunk_hits"))
    spaces = hits.select(*keys).union(best.select(*keys)).distinct()
    out = spaces
    for part in (names, seeds, words, sources, counts):
        out = out.join(part, keys, "left")
    none = F.array().cast("array<string>")
    out = out.select(*keys, *[F.coalesce(x, none).alias(x) for x in ("names", "semantic_seeds", "keyword_hits", "sources")], F.coalesce("chunk_hits", F.lit(0)).alias("chunk_hits"))
    semantic = (F.size("semantic_seeds") > 0) | (F.col("chunk_hits") > 0)
    out = out.select("*", T.recall_method(semantic, F.size("keyword_hits") > 0).alias("method"), (semantic & F.lit(lexical)).alias("local"))
    context = None
    for section, df in (("structure", e), ("relations", r), ("chunks", c)):
        part = df.select(*keys, F.lit(section).alias("section"), "rank", "text")
        context = part if context is None else context.unionByName(part)
    return out, context


def best_entity_match(incoming: DataFrame, existing: DataFrame, floor: float = 0.86) -> DataFrame:
    """Each incoming mention's existing entity of highest cosine, at least ``floor`` (query_id, id, score)."""
    return nearest(incoming, existing, 1, floor).drop("rank")


def similar_sets(a: DataFrame, b: DataFrame, keys: list[str], floor: float = 0.8, materialize: Materialize = lambda df: df) -> DataFrame:
    """(.., own, met, similarity): sets of ``a`` (.., own, tokens) and ``b`` (.., met, others) within the same keys whose similarity reaches the floor. Each set is there once, and none is empty.

    With the rarest tokens of a key first, similar sets share one among the first of each, and their sizes are alike: pairs meet by these, so a token that
    a third of all sets have brings none together that share no rarer one; ids alone are joined, and each pair that met is verified on its tokens.
    """
    every = a.select(*keys, F.explode("tokens").alias("token")).unionByName(b.select(*keys, F.explode("others").alias("token")))
    often = materialize(every.groupBy(*keys, "token").agg(F.count("*").alias("n")))

    def prefixed(x: DataFrame, name: str, tokens: str, size: str) -> DataFrame:
        counted = x.select(*keys, name, F.explode(tokens).alias("token")).join(often, [*keys, "token"])
        ordered = counted.groupBy(*keys, name).agg(F.array_sort(F.collect_list(F.struct("n", F.xxhash64("token").alias("h"), "token"))).alias("ordered"))
        n = F.size("ordered")
        first = F.slice("ordered", F.lit(1), n - F.ceil(floor * n - 1e-9).cast("int") + 1)
        return materialize(ordered.select(*keys, name, n.alias(size), F.explode(first).alias("t")).select(*keys, name, size, "t.token"))

    p, q = prefixed(a, "own", "tokens", "_own"), prefixed(b, "met", "others", "_met")
    met = p.join(q, [*keys, "token"]).where((F.col("_own") >= floor * F.col("_met") - 1e-9) & (F.col("_met") >= floor * F.col("_own") - 1e-9))
    pairs = met.select(*keys, "own", "met").distinct()
    held = pairs.join(a, [*keys, "own"]).join(b, [*keys, "met"])
    return held.select(*keys, "own", "met", T.jaccard(F.col("tokens"), F.col("others")).alias("similarity")).where(F.col("similarity") >= floor)


def obs_near_dup_join(facts: DataFrame, other: DataFrame, keys: list[str], floor: float = 0.8, materialize: Materialize = lambda df: df) -> DataFrame:
    """Pairs (.., fact_id, other_id, similarity) of facts (.., fact_id, text) within the same keys whose token sets reach the similarity.

    Equal sets are compared once (``similar_sets``), and their facts are joined to what was found, so what is shuffled grows with the facts and each one's similar sets, not
    with the pairs. Facts without tokens have no pairs; a pair of a table with itself comes both ways.
    """

    def sets(df: DataFrame, name: str, kind: str) -> DataFrame:
        found = df.select(*keys, F.col("fact_id").alias(name), F.array_sort(T.token_set(F.col("text"))).alias("tokens")).where(F.size("tokens") > 0)
        return materialize(found.withColumn(kind, F.sha1(F.array_join("tokens", " "))))

    a = sets(facts, "fact_id", "own")
    b = a.select(*keys, F.col("fact_id").alias("other_id"), F.col("own").alias("met"), "tokens") if other is facts else sets(other, "other_id", "met")
    once = [materialize(x.select(*keys, kind, F.col("tokens").alias(tokens)).dropDuplicates([*keys, kind])) for x, kind, tokens in ((a, "own", "tokens"), (b, "met", "others"))]
    near = materialize(similar_sets(*once, keys, floor, materialize))
    found = near.join(a.select(*keys, "own", "fact_id"), [*keys, "own"]).join(b.select(*keys, "met", "other_id"), [*keys, "met"])
    return found.select(*keys, "fact_id", "other_id", "similarity")
