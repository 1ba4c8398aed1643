"""Queries of message, session and graph operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import archive as A
from corpusloom.operators import code as K
from corpusloom.operators import curation as U
from corpusloom.operators import embedding as E
from corpusloom.operators import graph as G
from corpusloom.operators import messages as M
from corpusloom.operators import retrieval as R
from corpusloom.operators.merging import MergedEntities
from corpusloom.plans.views import MENTIONS, MESSAGES, PATHS, RELATIONS, TREE, mentions, messages, paths, query, relations, table, tree
from corpusloom.sources.tables import fresh_path, materialize


@query("keyword_search", f"SELECT namespace, session_id, seq, text FROM {MESSAGES} WHERE contains(lower(text), 'eaux') ORDER BY updated_at DESC, session_id, seq LIMIT 60")
def keyword_search(spark: SparkSession, d: str) -> DataFrame:
    return M.keyword_search(messages(spark, d), " EAUX ", limit=60).select("namespace", "session_id", "seq", "text")


@query("excluded_flag", f"SELECT ordinal, (ordinal % 11 = 0) AS fact_excluded, (ordinal % 100 < 3) AS session_excluded FROM {MENTIONS}")
def excluded_flag(spark: SparkSession, d: str) -> DataFrame:
    m = mentions(spark, d).withColumn("name", F.concat("name", "ordinal")).withColumn("text", F.col("fact"))
    known = U.exclude(no_exclusions(spark), m.where("ordinal % 11 = 0"), m.where("ordinal % 100 < 3").select("namespace", F.col("source").alias("session_id")))
    return U.excluded_flags(m, known).select("ordinal", "fact_excluded", "session_excluded")


def no_exclusions(spark: SparkSession) -> U.Exclusions:
    return U.Exclusions(spark.createDataFrame([], "namespace string, obs_key string"), spark.createDataFrame([], "namespace string, session_id string"))


@query("entity_term_match", f"SELECT ordinal, contains(lower(name), 'ring') OR contains(lower(type), 'ring') OR contains(lower(fact), 'ring') AS hit FROM {MENTIONS}")
def entity_term_match(spark: SparkSession, d: str) -> DataFrame:
    return mentions(spark, d).select("ordinal", G.entity_term_match(F.col("name"), F.col("type"), F.array("fact"), "Ring").alias("hit"))


@query("scope_filter", f"SELECT namespace, count(*) AS n FROM {MESSAGES} WHERE namespace IN ('ns1', 'ns3') GROUP BY 1")
def scope_filter(spark: SparkSession, d: str) -> DataFrame:
    return M.scope_filter(messages(spark, d), " ns1, ,ns3").groupBy("namespace").agg(F.count("*").alias("n"))


@query(
    "freshness",
    "SELECT conv_id, CASE WHEN conv_id % 5 = 0 THEN 'reprocess' WHEN conv_id % 3 = 0 THEN 'reprocess' WHEN conv_id % 2 = 0 THEN 'backfill' ELSE 'fresh' END AS status FROM (SELECT DISTINCT conv_id FROM conversations)",
)
def freshness_query(spark: SparkSession, d: str) -> DataFrame:
    files = table(spark, d, "conversations").select("conv_id").distinct().withColumn("mtime", F.col("conv_id") * 10)
    records = files.where("conv_id % 5 <> 0").select("conv_id", F.when(F.col("conv_id") % 3 == 0, F.col("mtime") - 1).otherwise(F.col("mtime")).alias("seen"), F.when(F.col("conv_id") % 2 == 0, 1).otherwise(2).alias("schema"))
    return M.freshness(files, records, "conv_id").select("conv_id", "status")


_ALIASED = "(SELECT 'ns' || (p_partkey % 4) AS namespace, p_partkey AS ordinal, p_name || ' ' || p_partkey AS name, 'grp' || (p_partkey % 500) AS a1, 'band' || ((p_partkey % 500) // 5) AS a2 FROM part)"


def aliased(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    return table(spark, d, "part").select(
        F.concat(F.lit("ns"), k % 4).alias("namespace"), k.alias("ordinal"), F.concat("p_name", F.lit(" "), k).alias("name"),
        F.array(F.concat(F.lit("grp"), k % 500), F.concat(F.lit("band"), F.floor(k % 500 / 5))).alias("aliases"),
    )


@query("resolve_alias", f"SELECT m.ordinal, first(e.name ORDER BY e.ordinal) AS entity FROM {_ALIASED} m JOIN {_ALIASED} e ON m.a2 = e.a2 GROUP BY 1")
def resolve_alias(spark: SparkSession, d: str) -> DataFrame:
    e = aliased(spark, d)
    m = e.select("ordinal", F.upper(e["aliases"][1]).alias("mention"))
    return G.resolve_alias(m, e).select("ordinal", "entity")


@query("find_entity", f"SELECT 'band' || b AS mention, (SELECT first(e.name ORDER BY e.ordinal) FROM {_ALIASED} e WHERE e.a2 = 'band' || b) AS entity FROM (SELECT DISTINCT (p_partkey % 120) AS b FROM part)")
def find_entity(spark: SparkSession, d: str) -> DataFrame:
    names = table(spark, d, "part").select(F.concat(F.lit("band"), F.col("p_partkey") % 120).alias("mention")).distinct()
    return G.resolve_alias(names, aliased(spark, d))


@query("relations_of", f"SELECT src, dst, label FROM {RELATIONS} WHERE lower(src) IN ('supplier#000000003', 'supplier#000000005') OR lower(dst) = 'small ring'")
def relations_of(spark: SparkSession, d: str) -> DataFrame:
    names = table(spark, d, "supplier").where("s_suppkey in (3, 5)").select(F.col("s_name").alias("name")).union(table(spark, d, "part").where("p_name = 'small ring'").select("p_name"))
    return G.relations_of(names, relations(spark, d)).select("src", "dst", "label")


@query("resolve_titles", f"SELECT ordinal, CASE ordinal % 5 WHEN 0 THEN '代码 ' || name WHEN 1 THEN '任务 ' || name WHEN 2 THEN '迁移' WHEN 3 THEN 'title ' || ordinal ELSE source END AS title FROM {MENTIONS}")
def resolve_titles(spark: SparkSession, d: str) -> DataFrame:
    m, o = mentions(spark, d), F.col("ordinal") % 5
    src = F.when(o == 0, F.concat(F.lit("code:"), "name")).when(o == 1, F.concat(F.lit("task:"), "name")).when(o == 2, F.lit("moved:x")).when(o == 3, F.concat(F.lit("t"), "ordinal")).otherwise(F.col("source"))
    titles = m.where("ordinal % 5 = 3").select(F.concat(F.lit("t"), "ordinal").alias("id"), F.concat(F.lit("title "), "ordinal").alias("t"))
    return A.resolve_titles(m.select("ordinal", src.alias("id")), titles.withColumnRenamed("t", "title"), "id").select("ordinal", "title")


@query(
    "nearest_marker",
    f"""WITH p AS (SELECT page_id, '/' || path AS cwd FROM {PATHS}), m AS (SELECT DISTINCT '/cmd/' || string_split(path, '/')[2] AS dir, 'host ' || string_split(path, '/')[2] AS ns FROM {PATHS} WHERE page_id % 2 = 0),
    m2 AS (SELECT DISTINCT '/cmd/' || string_split(path, '/')[2] || '/' || string_split(path, '/')[3] AS dir, 'deep ' || string_split(path, '/')[3] AS ns FROM {PATHS} WHERE page_id % 3 = 0)
    SELECT page_id, coalesce((SELECT ns FROM m2 WHERE starts_with(cwd || '/', dir || '/') LIMIT 1), (SELECT ns FROM m WHERE starts_with(cwd || '/', dir || '/') LIMIT 1)) AS namespace FROM p""",
)
def nearest_marker(spark: SparkSession, d: str) -> DataFrame:
    p = paths(spark, d).select("page_id", F.concat(F.lit("/"), "path").alias("cwd"))
    part = lambda n: F.get(F.split("cwd", "/"), F.lit(n))
    a = p.where("page_id % 2 = 0").select(F.concat(F.lit("/cmd/"), part(2)).alias("dir"), F.concat(F.lit("host "), part(2)).alias("namespace"))
    b = p.where("page_id % 3 = 0").select(F.concat(F.lit("/cmd/"), part(2), F.lit("/"), part(3)).alias("dir"), F.concat(F.lit("deep "), part(3)).alias("namespace"))
    return M.nearest_marker(p, a.union(b).distinct()).select("page_id", "namespace")


@query("anti_excluded_obs", f"SELECT ordinal FROM {MENTIONS} WHERE ordinal NOT IN (SELECT b.ordinal FROM {MENTIONS} a JOIN {MENTIONS} b ON a.namespace = b.namespace AND a.name = b.name AND a.fact = b.fact WHERE a.ordinal % 11 = 0) AND ordinal % 100 <> 7")
def anti_excluded_obs(spark: SparkSession, d: str) -> DataFrame:
    m = mentions(spark, d)
    by_fact = m.where("ordinal % 11 = 0").select("namespace", T.obs_key(F.col("name"), F.col("fact")).alias("obs_key"))
    by_session = m.where("ordinal % 100 = 7").select("namespace", F.col("source").alias("session_id")).distinct()
    return G.anti_excluded(m.withColumn("text", F.col("fact")), by_fact, by_session).select("ordinal")


@query("drop_dangling", f"SELECT src, dst, label FROM {RELATIONS} WHERE src <> 'Supplier#000000001' AND dst NOT LIKE 'small%'")
def drop_dangling(spark: SparkSession, d: str) -> DataFrame:
    gone = table(spark, d, "part").where("p_name like 'small%'").select(F.upper("p_name").alias("name")).union(table(spark, d, "supplier").where("s_suppkey = 1").select("s_name"))
    return G.drop_dangling(relations(spark, d), gone).select("src", "dst", "label")


@query("relations_within", f"SELECT src, dst, label FROM {RELATIONS} WHERE right(src, 1) = '3' AND dst LIKE '%ring'")
def relations_within(spark: SparkSession, d: str) -> DataFrame:
    hit = table(spark, d, "part").where("p_name like '%ring'").select(F.col("p_name").alias("name")).union(table(spark, d, "supplier").where("s_name like '%3'").select("s_name"))
    return G.relations_within(relations(spark, d), hit).select("src", "dst", "label")


_RUNS = "(SELECT 't' || o_custkey AS task_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS seq, o_orderstatus AS status, o_orderkey FROM orders)"


def runs(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select(F.concat(F.lit("t"), "o_custkey").alias("task_id"), F.col("o_orderstatus").alias("status"), "o_orderkey", "o_orderdate")
    none = o.select("task_id", F.lit(0).alias("seq")).limit(0)
    return M.append_run_seq(o, none, ["o_orderdate", "o_orderkey"])


@query("append_run_seq", f"SELECT task_id, seq + 100 AS seq, o_orderkey FROM {_RUNS}")
def append_run_seq(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select(F.concat(F.lit("t"), "o_custkey").alias("task_id"), "o_orderkey", "o_orderdate")
    done = o.select("task_id").distinct().withColumn("seq", F.lit(100))
    return M.append_run_seq(o, done, ["o_orderdate", "o_orderkey"]).select("task_id", F.col("seq").cast("long"), "o_orderkey")


@query("latest_run_of_task", f"SELECT task_id, max(seq) AS seq, arg_max(status, seq) AS status FROM {_RUNS} GROUP BY 1")
def latest_run_of_task(spark: SparkSession, d: str) -> DataFrame:
    return A.latest_run(runs(spark, d)).withColumn("seq", F.col("seq").cast("long"))


@query("cascade_delete", "SELECT 'order' AS kind, count(*) AS n FROM orders WHERE o_orderkey % 7 <> 0 UNION ALL SELECT 'line', count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 7 = 0)")
def cascade_delete(spark: SparkSession, d: str) -> DataFrame:
    o, li = table(spark, d, "orders").select("o_orderkey"), table(spark, d, "lineitem").select("l_orderkey")
    kept, lines = A.cascade_delete(o, li, o.where("o_orderkey % 7 = 0"), "o_orderkey", "l_orderkey")
    return kept.agg(F.count("*").alias("n")).select(F.lit("order").alias("kind"), "n").union(lines.agg(F.count("*").alias("n")).select(F.lit("line"), "n"))


_EVENTS = """(SELECT 's' || conv_id AS session_id, turn AS seq, role AS type, CASE WHEN turn % 3 = 1 AND conv_id % 2 = 0 THEN 'T' || turn ELSE '' END AS title, text AS prompt,
    CASE WHEN turn > 0 THEN '/home/' || turn ELSE '' END AS cwd, CASE WHEN turn % 4 = 3 THEN '<synthetic>' WHEN turn % 4 = 2 THEN 'm' || turn ELSE '' END AS model FROM conversations)"""


@query(
    "session_summary",
    f"""SELECT session_id, coalesce(arg_max(title, seq) FILTER (title <> ''), (SELECT CASE WHEN length(l) > 60 THEN l[:60] || '…' ELSE l END FROM (SELECT coalesce(list_filter(list_transform(string_split(arg_max(prompt, seq) FILTER (prompt <> ''), chr(10)), lambda x: trim(x)), lambda x: x <> '')[1], '') AS l))) AS title,
    count(*) FILTER (type IN ('user', 'assistant')) AS message_count, arg_min(cwd, seq) FILTER (cwd <> '') AS cwd, arg_max(model, seq) FILTER (model <> '' AND model <> '<synthetic>') AS model FROM {_EVENTS} GROUP BY 1""",
)
def session_summary(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("turn")
    e = table(spark, d, "conversations").select(
        F.concat(F.lit("s"), "conv_id").alias("session_id"), t.alias("seq"), F.col("role").alias("type"), F.when((t % 3 == 1) & (F.col("conv_id") % 2 == 0), F.concat(F.lit("T"), t)).otherwise("").alias("title"),
        F.col("text").alias("prompt"), F.when(t > 0, F.concat(F.lit("/home/"), t)).otherwise("").alias("cwd"), F.when(t % 4 == 3, "<synthetic>").when(t % 4 == 2, F.concat(F.lit("m"), t)).otherwise("").alias("model"),
    )
    return M.session_summary(e)


@query("session_summary_codex", "SELECT 'rollout-1-2-3-c' || conv_id || '.jsonl' AS file, CASE WHEN conv_id % 2 = 0 THEN 'meta' || conv_id ELSE 'c' || conv_id END AS session_id, arg_min(trim(text), turn) FILTER (role = 'user' AND trim(text) <> '')[:80] AS title, count(*) AS message_count FROM conversations GROUP BY conv_id".replace("FILTER (role = 'user' AND trim(text) <> '')[:80]", "FILTER (role = 'user' AND trim(text) <> '')").replace("arg_min(trim(text), turn)", "arg_min(trim(text)[:80], turn)"))
def session_summary_codex(spark: SparkSession, d: str) -> DataFrame:
    meta = F.when((F.col("turn") == 0) & (F.col("conv_id") % 2 == 0), F.concat(F.lit("meta"), "conv_id"))
    text = F.concat(F.lit("<environment_context>x</environment_context>\n"), "text")
    e = table(spark, d, "conversations").select(F.concat(F.lit("rollout-1-2-3-c"), "conv_id", F.lit(".jsonl")).alias("file"), F.col("turn").alias("seq"), F.lit("response_item").alias("type"), "role", text.alias("text"), meta.alias("meta_id"))
    return M.session_summary_codex(e)


@query("session_summary_buddy", "SELECT 'f' || conv_id AS file, count(*) AS message_count, arg_min('/w' || turn, turn) FILTER (turn > 0) AS cwd, 'id' || conv_id AS session_id, arg_min(text[:80], turn) FILTER (role = 'user' AND trim(text) <> '') AS title FROM conversations GROUP BY conv_id")
def session_summary_buddy(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "conversations").select(F.concat(F.lit("f"), "conv_id").alias("file"), F.col("turn").alias("seq"), F.lit("message").alias("type"), "role", "text", F.when(F.col("turn") > 0, F.concat(F.lit("/w"), "turn")).otherwise("").alias("cwd"), F.concat(F.lit("id"), "conv_id").alias("session"))
    return M.session_summary_buddy(e)


@query("project_summary", f"SELECT '-home-' || namespace AS slug, count(DISTINCT session_id) AS session_count, max(updated_at) AS updated_at, '/home/' || namespace AS path FROM {MESSAGES} GROUP BY namespace")
def project_summary(spark: SparkSession, d: str) -> DataFrame:
    s = messages(spark, d).groupBy("namespace", "session_id").agg(F.max("updated_at").alias("updated_at"))
    return M.project_summary(s.withColumn("slug", F.concat(F.lit("-home-"), "namespace")))


@query("session_progress", f"SELECT session_id, arg_max(text, seq) FILTER (role = 'user' AND trim(text) <> '') AS last_user, arg_max(text, seq) FILTER (role = 'assistant' AND trim(text) <> '') AS last_assistant FROM {MESSAGES} GROUP BY 1")
def session_progress(spark: SparkSession, d: str) -> DataFrame:
    return M.session_progress(messages(spark, d))


@query("namespace_counts", f"SELECT namespace, count(DISTINCT lower(name)) AS entities FROM {MENTIONS} GROUP BY 1")
def namespace_counts(spark: SparkSession, d: str) -> DataFrame:
    return G.namespace_counts(mentions(spark, d))


@query("entity_degree", f"SELECT name, count(*) AS degree FROM (SELECT lower(src) AS name FROM {RELATIONS} UNION ALL SELECT lower(dst) FROM {RELATIONS}) GROUP BY 1")
def entity_degree(spark: SparkSession, d: str) -> DataFrame:
    return G.entity_degree(relations(spark, d))


@query("package_in_degree", f"SELECT regexp_replace(path, '/[^/]*$', '') AS package, count(*) AS degree FROM {PATHS} GROUP BY 1")
def package_in_degree(spark: SparkSession, d: str) -> DataFrame:
    return K.package_in_degree(paths(spark, d).select(F.col("path").alias("dst")))


@query("change_frequency", "SELECT 'p' || l_partkey AS path, count(*) AS n FROM lineitem JOIN (SELECT o_orderkey FROM (SELECT o_orderkey, rank() OVER (ORDER BY o_orderkey DESC) AS r FROM orders) WHERE r <= 300) ON l_orderkey = o_orderkey GROUP BY 1")
def change_frequency(spark: SparkSession, d: str) -> DataFrame:
    newest = table(spark, d, "orders").select("o_orderkey").orderBy(F.desc("o_orderkey")).limit(300)  # the feature: a window of commits
    ranked = newest.withColumn("commit_rank", F.row_number().over(Window.orderBy(F.desc("o_orderkey"))))
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.concat(F.lit("p"), "l_partkey").alias("path"))
    return K.change_frequency(li.join(ranked, "o_orderkey"))


@query("file_symbols", f"SELECT src, string_agg(dst, '|' ORDER BY ordinal, dst) AS symbols FROM {RELATIONS} WHERE label = 'A' GROUP BY 1")
def file_symbols(spark: SparkSession, d: str) -> DataFrame:
    return K.file_symbols(relations(spark, d), "A").withColumn("symbols", F.array_join("symbols", "|"))


@query("union_observations", f"SELECT namespace, name, string_agg(fact || '@' || source, '|' ORDER BY ordinal) AS observations FROM (SELECT *, row_number() OVER (PARTITION BY namespace, name, lower(fact) ORDER BY ordinal) AS rn FROM {MENTIONS}) WHERE rn = 1 GROUP BY 1, 2")
def union_observations(spark: SparkSession, d: str) -> DataFrame:
    out = G.union_observations(mentions(spark, d).withColumn("text", F.col("fact")), ["namespace", "name"])
    return out.select("namespace", "name", F.array_join(F.transform("observations", lambda x: F.concat(x["text"], F.lit("@"), x["source"])), "|").alias("observations"))


@query("merge_aliases", f"SELECT namespace, name, string_agg(type, '|' ORDER BY ordinal) AS aliases FROM (SELECT *, row_number() OVER (PARTITION BY namespace, name, lower(type) ORDER BY ordinal) AS rn FROM {MENTIONS}) WHERE rn = 1 AND lower(type) <> lower(name) GROUP BY 1, 2")
def merge_aliases(spark: SparkSession, d: str) -> DataFrame:
    out = G.merge_aliases(mentions(spark, d).withColumn("alias", F.col("type")), ["namespace", "name"], "name")
    return out.select("namespace", "name", F.array_join("aliases", "|").alias("aliases"))


@query("first_type_last_embedding", "SELECT label, arg_min('t' || vec_id, vec_id) FILTER (vec_id % 3 <> 0) AS type, arg_max(vec_id, vec_id) FILTER (vec_id % 4 <> 0) AS last_id FROM embeddings GROUP BY 1")
def first_type_last_embedding(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("vec_id")
    v = table(spark, d, "embeddings").select("label", i.alias("ordinal"), F.when(i % 3 != 0, F.concat(F.lit("t"), i)).otherwise("").alias("type"), F.when(i % 4 != 0, F.array(i)).otherwise(F.array().cast("array<bigint>")).alias("embedding"))
    return G.first_type_last_embedding(v, ["label"]).select("label", "type", F.col("embedding")[0].alias("last_id"))


@query("distinct_relations", "SELECT arg_min(upper(p_name), p_partkey) AS src, arg_min(p_brand, p_partkey) AS dst, p_type AS label FROM part GROUP BY lower(p_name), lower(p_brand), p_type")
def distinct_relations(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "part").select(F.upper("p_name").alias("src"), F.col("p_brand").alias("dst"), F.col("p_type").alias("label"), F.col("p_partkey").alias("ordinal"))
    return G.distinct_relations(r).drop("ordinal")


@query("term_frequency", "SELECT item_id, term, count(*) AS n FROM (SELECT item_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{Nd}]+')) AS term FROM benchmark) GROUP BY 1, 2")
def term_frequency(spark: SparkSession, d: str) -> DataFrame:
    return E.term_frequency(table(spark, d, "benchmark"), "item_id")


@query("distinct_sources", f"SELECT namespace, string_agg(source, '|' ORDER BY o) AS sources FROM (SELECT namespace, source, min(ordinal) AS o FROM {MENTIONS} GROUP BY 1, 2) GROUP BY 1")
def distinct_sources(spark: SparkSession, d: str) -> DataFrame:
    first = G.distinct_sources(mentions(spark, d), ["namespace"])
    return first.groupBy("namespace").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "source"))), lambda x: x["source"]), "|").alias("sources"))


@query("hub_entity", f"SELECT namespace, first(name ORDER BY degree DESC, ordinal) AS hub FROM (SELECT namespace, name, min(ordinal) AS ordinal, any_value(degree) AS degree FROM {MENTIONS} JOIN (SELECT dst, count(*) AS degree FROM {RELATIONS} GROUP BY 1) ON name = dst GROUP BY 1, 2) GROUP BY 1")
def hub_entity(spark: SparkSession, d: str) -> DataFrame:
    return G.hub_entity(mentions(spark, d), relations(spark, d))


@query("bounded_transcript", f"SELECT session_id, seq FROM (SELECT *, sum(strlen(role) + 2 + strlen(text) + 1) OVER (PARTITION BY session_id ORDER BY seq DESC) AS used, row_number() OVER (PARTITION BY session_id ORDER BY seq DESC) AS rn FROM {MESSAGES}) WHERE used <= 2000 OR rn = 1")
def bounded_transcript(spark: SparkSession, d: str) -> DataFrame:
    return M.bounded_transcript(messages(spark, d), 2000).select("session_id", "seq")


@query("structure_budget", f"SELECT namespace, ordinal FROM (SELECT *, coalesce(sum(strlen(name) + strlen(fact)) OVER (PARTITION BY namespace ORDER BY ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM {MENTIONS}) WHERE before < 1600")
def structure_budget(spark: SparkSession, d: str) -> DataFrame:
    return M.keep_until(mentions(spark, d), ["namespace"], ["ordinal"], F.octet_length("name") + F.octet_length("fact"), 1600).select("namespace", "ordinal")


@query("chunk_budget", f"SELECT namespace, session_id, seq FROM (SELECT *, sum(strlen(text)) OVER w AS used, row_number() OVER w AS rn FROM {MESSAGES} WINDOW w AS (PARTITION BY namespace ORDER BY session_id, seq ROWS UNBOUNDED PRECEDING)) WHERE used <= 4000 OR rn = 1")
def chunk_budget(spark: SparkSession, d: str) -> DataFrame:
    return M.keep_within(messages(spark, d), ["namespace"], ["session_id", "seq"], F.octet_length("text"), 4000).select("namespace", "session_id", "seq")


@query("output_cap", "SELECT source, lang, bytes FROM (SELECT *, coalesce(sum(bytes) OVER (PARTITION BY source ORDER BY lang ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM (SELECT source, lang, sum(strlen(text))::BIGINT AS bytes FROM documents GROUP BY 1, 2)) WHERE before < 80000")
def output_cap(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "documents").groupBy("source", "lang").agg(F.sum(F.octet_length("text")).alias("bytes"))
    return M.keep_until(s, ["source"], ["lang"], F.col("bytes"), 80_000)


@query("rrf_fuse", "WITH l AS (SELECT l_orderkey AS query_id, 1 AS list_no, l_linenumber AS rank, 'p' || (l_partkey % 20) AS id FROM lineitem UNION ALL SELECT l_orderkey, 2, 8 - l_linenumber, 'p' || (l_suppkey % 20) FROM lineitem), f AS (SELECT query_id, id, sum(1.0::DOUBLE / (60 + rank)) AS score FROM l GROUP BY 1, 2) SELECT query_id, id, round(score, 9) AS score FROM f")
def rrf_fuse(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    one = li.select(F.col("l_orderkey").alias("query_id"), F.lit(1).alias("list_no"), F.col("l_linenumber").alias("rank"), F.concat(F.lit("p"), F.col("l_partkey") % 20).alias("id"))
    two = li.select("l_orderkey", F.lit(2), (8 - F.col("l_linenumber")), F.concat(F.lit("p"), F.col("l_suppkey") % 20))
    return M.rrf_fuse(one.union(two)).select("query_id", "id", F.round("score", 9).alias("score"))


@query("latest_record", f"SELECT namespace, record_id, max(ordinal) AS ordinal FROM {MENTIONS} GROUP BY 1, 2")
def latest_record(spark: SparkSession, d: str) -> DataFrame:
    return M.latest(mentions(spark, d), ["namespace", "record_id"], [F.desc("ordinal")]).select("namespace", "record_id", "ordinal")


@query("overview_top", "SELECT p_brand AS section, p_partkey AS id, greatest(n - 12, 0) AS more FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS rn, count(*) OVER (PARTITION BY p_brand) AS n FROM part) WHERE rn <= 12")
def overview_top(spark: SparkSession, d: str) -> DataFrame:
    p = M.overview_top(table(spark, d, "part"), ["p_brand"], [F.desc("p_retailprice"), "p_partkey"])
    return p.select(F.col("p_brand").alias("section"), F.col("p_partkey").alias("id"), "more")


@query("session_listing", f"SELECT session_id, max(updated_at) AS updated_at, count(*) AS messages FROM {MESSAGES} GROUP BY 1 ORDER BY 2 DESC, 1")
def session_listing(spark: SparkSession, d: str) -> DataFrame:
    return M.session_listing(messages(spark, d))


_OVER = f"(SELECT namespace, name, min(ordinal) AS ordinal, CASE arg_min(type, ordinal) WHEN 'ECONOMY' THEN 'decision' WHEN 'PROMO' THEN 'constraint' ELSE 'core' END AS section, count(*) AS facts, arg_min(fact, ordinal) AS fact FROM {MENTIONS} GROUP BY 1, 2)"


@query(
    "project_overview",
    f"""SELECT namespace, section, rank, name, fact, greatest(n - 12, 0) AS more FROM (SELECT o.*, row_number() OVER (PARTITION BY namespace, section ORDER BY CASE section WHEN 'core' THEN coalesce(degree, 0) ELSE 0 END DESC, CASE section WHEN 'core' THEN facts ELSE 0 END DESC, ordinal) AS rank, count(*) OVER (PARTITION BY namespace, section) AS n
    FROM {_OVER} o LEFT JOIN (SELECT dst, count(*) AS degree FROM {RELATIONS} GROUP BY 1) ON name = dst) WHERE rank <= 12""",
)
def project_overview(spark: SparkSession, d: str) -> DataFrame:
    return G.project_overview(merged(spark, d), relations(spark, d))


def merged(spark: SparkSession, d: str) -> DataFrame:
    """Mentions folded by name: entities (namespace, name, ordinal, type, observations)."""
    m = mentions(spark, d).groupBy("namespace", "name").agg(F.min("ordinal").alias("ordinal"), F.min_by("type", "ordinal").alias("type"), F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "fact"))), lambda x: x["fact"]).alias("observations"))
    return m.withColumn("type", F.when(F.col("type") == "ECONOMY", "decision").when(F.col("type") == "PROMO", "constraint").otherwise(F.col("type")))


@query("expand_hop", f"SELECT DISTINCT dst AS name FROM {RELATIONS} WHERE src = 'Supplier#000000003' UNION SELECT 'Supplier#000000003'")
def expand_hop(spark: SparkSession, d: str) -> DataFrame:
    return G.expand_hop(table(spark, d, "supplier").where("s_suppkey = 3").select(F.col("s_name").alias("name")), relations(spark, d))


@query("neighborhood", f"WITH b AS (SELECT src, dst FROM {TREE} UNION SELECT dst, src FROM {TREE}), a AS (SELECT DISTINCT dst FROM b WHERE src = 'NATION_3'), c AS (SELECT DISTINCT b.dst FROM a JOIN b ON a.dst = b.src WHERE b.dst <> 'NATION_3' AND b.dst NOT IN (SELECT dst FROM a)), f AS (SELECT 'NATION_3' AS name, 0 AS hop UNION ALL SELECT dst, 1 FROM a UNION ALL SELECT dst, 2 FROM c) SELECT name, hop FROM (SELECT f.*, coalesce(n, 0) AS deg FROM f LEFT JOIN (SELECT src, count(*) AS n FROM b GROUP BY 1) ON name = src) ORDER BY hop, deg DESC, name LIMIT 140")
def neighborhood(spark: SparkSession, d: str) -> DataFrame:
    return G.neighborhood(table(spark, d, "nation").where("n_nationkey = 3").select(F.col("n_name").alias("name")), tree(spark, d))


@query("induced_edges", f"SELECT least(src, dst) AS a, greatest(src, dst) AS b, arg_min(label, (ordinal, label)) AS label FROM {RELATIONS} WHERE dst LIKE '%ring' AND right(src, 1) = '3' GROUP BY 1, 2")
def induced_edges(spark: SparkSession, d: str) -> DataFrame:
    nodes = table(spark, d, "part").where("p_name like '%ring'").select(F.col("p_name").alias("name")).union(table(spark, d, "supplier").where("s_name like '%3'").select("s_name")).distinct()
    return G.induced_edges(nodes, relations(spark, d))


@query("focus_graph", f"WITH m AS (SELECT DISTINCT name FROM {MENTIONS} WHERE contains(lower(name), 'small ring')), n AS (SELECT name FROM m UNION SELECT dst FROM {RELATIONS} WHERE src IN (SELECT name FROM m) UNION SELECT src FROM {RELATIONS} WHERE dst IN (SELECT name FROM m)) SELECT src, dst, label FROM {RELATIONS} WHERE src IN (SELECT name FROM n) AND dst IN (SELECT name FROM n)")
def focus_graph(spark: SparkSession, d: str) -> DataFrame:
    return G.focus_graph(merged(spark, d), relations(spark, d), "Small Ring")[1].select("src", "dst", "label")


@query("merge_entities", f"SELECT namespace, ordinal, name, first_value(name) OVER (PARTITION BY namespace, a2 ORDER BY ordinal) AS canonical FROM {_ALIASED}")
def merge_entities(spark: SparkSession, d: str) -> DataFrame:
    return G.merge_entities(aliased(spark, d), materialize).select("namespace", "ordinal", "name", "canonical")


@query("merge_entities_component", f"SELECT namespace, ordinal, name, first_value(name) OVER (PARTITION BY namespace, a2 ORDER BY ordinal) AS canonical FROM {_ALIASED}")
def merge_entities_component(spark: SparkSession, d: str) -> DataFrame:
    return G.merge_entities(aliased(spark, d), materialize, "component").select("namespace", "ordinal", "name", "canonical")


@query(
    "merge_entities_incremental",
    f"SELECT namespace, ordinal, name, first_value(name) OVER (PARTITION BY namespace, a2 ORDER BY ordinal) AS canonical FROM {_ALIASED} WHERE ordinal % 7 <> 3 AND NOT (ordinal % 5 = 1 AND ordinal % 2 = 0)",
)
def merge_entities_incremental(spark: SparkSession, d: str) -> DataFrame:
    """Most records first; then the others, while some of the first go; then one part of these goes as well."""
    o = F.col("ordinal")
    m = aliased(spark, d).withColumn("record_id", F.concat(F.lit("r"), o % 5, F.lit("."), o % 7, F.lit("."), o % 2))
    kept = MergedEntities(fresh_path(spark, "merged"), materialize)
    kept.update(0, m.where(o % 5 < 4))
    kept.update(1, m.where(o % 5 == 4), m.where(o % 7 == 3))
    kept.rows.compact(spark)
    kept.update(2, removed=m.where(((o % 5 == 1) & (o % 2 == 0)) | (o % 7 == 3)))
    return kept.read(spark).select("namespace", "ordinal", "name", "canonical")


@query("union_namespaces", f"SELECT name, count(*) AS mentions FROM {MENTIONS} WHERE namespace IN ('ns0', 'ns1') GROUP BY 1")
def union_namespaces(spark: SparkSession, d: str) -> DataFrame:
    m = mentions(spark, d).withColumn("text", F.col("fact")).withColumn("aliases", F.array().cast("array<string>"))
    named, _ = U.union_namespaces(m, relations(spark, d), ["ns0", "ns1"], no_exclusions(spark), materialize)
    return named.where("namespace = 'ns0+ns1'").groupBy("name").agg(F.count("*").alias("mentions"))


@query("union_hits", f"SELECT name FROM {MENTIONS} WHERE ordinal < 9 UNION SELECT name FROM {MENTIONS} WHERE contains(name, 'ring') UNION SELECT dst FROM {RELATIONS} WHERE src = 'Supplier#000000003'")
def union_hits(spark: SparkSession, d: str) -> DataFrame:
    m = mentions(spark, d)
    return R.union_hits(m.where("ordinal < 9"), m.where("contains(name, 'ring')"), relations(spark, d).where("src = 'Supplier#000000003'").select(F.col("dst").alias("name")))


_FACTS = f"(SELECT a.namespace, a.ordinal, first_value(a.name) OVER (PARTITION BY a.namespace, a.a2 ORDER BY a.ordinal) AS name, m.fact, m.source FROM {_ALIASED} a JOIN {MENTIONS} m USING (ordinal))"
_LEFT_FACTS = f"""(SELECT * FROM {_FACTS} f WHERE source <> 's7' AND NOT EXISTS (SELECT 1 FROM {_FACTS} x WHERE x.ordinal % 11 = 0 AND x.namespace = f.namespace AND x.name = f.name AND x.fact = f.fact))"""


def alias_facts(spark: SparkSession, d: str) -> DataFrame:
    """A fact for each part, of entities that share aliases."""
    m = mentions(spark, d).select("ordinal", "record_id", "type", F.col("fact").alias("text"), "source")
    return aliased(spark, d).join(m, "ordinal")


def alias_relations(spark: SparkSession, d: str) -> DataFrame:
    """From each part's own name to that of the part of the same namespace four further on."""
    a = aliased(spark, d).select("namespace", "ordinal", F.col("name").alias("src"))
    return a.join(a.select((F.col("ordinal") - 4).alias("ordinal"), F.col("src").alias("dst")), "ordinal").withColumn("label", F.lit("next"))


_NEXT = f"(SELECT a.namespace, a.name AS src, b.name AS dst FROM {_ALIASED} a JOIN {_ALIASED} b ON b.ordinal = a.ordinal + 4)"


@query(
    "assemble_graph",
    f"""WITH e AS (SELECT namespace, name, count(DISTINCT lower(fact)) AS n FROM {_LEFT_FACTS} GROUP BY 1, 2), gone AS (SELECT namespace, name FROM {_FACTS} EXCEPT SELECT namespace, name FROM e),
    r AS (SELECT * FROM {_NEXT} x WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.namespace = x.namespace AND g.name IN (x.src, x.dst))),
    h AS (SELECT namespace, name FROM e WHERE contains(lower(name), 'ring')), k AS (SELECT * FROM h UNION SELECT r.namespace, r.dst FROM r JOIN h ON h.namespace = r.namespace AND h.name = r.src UNION SELECT r.namespace, r.src FROM r JOIN h ON h.namespace = r.namespace AND h.name = r.dst)
    SELECT 'entity' AS kind, namespace, name, n FROM e JOIN k USING (namespace, name) UNION ALL SELECT 'relation', namespace, src, count(*) FROM r WHERE (namespace, src) IN (SELECT (namespace, name) FROM k) AND (namespace, dst) IN (SELECT (namespace, name) FROM k) GROUP BY 2, 3""",
)
def assemble_graph(spark: SparkSession, d: str) -> DataFrame:
    facts = alias_facts(spark, d)
    named = facts.where("ordinal % 11 = 0").select("namespace", "ordinal", "text").join(merge_entities(spark, d).select("namespace", "ordinal", F.col("canonical").alias("name")), ["namespace", "ordinal"])
    known = U.exclude(no_exclusions(spark), named, facts.where("source = 's7'").select("namespace", F.col("source").alias("session_id")))
    e, r = U.assemble_graph(facts, alias_relations(spark, d), known, materialize, "Ring")
    e = e.select(F.lit("entity").alias("kind"), "namespace", "name", F.size("observations").cast("long").alias("n"))
    return e.unionByName(r.groupBy(F.lit("relation").alias("kind"), "namespace", F.col("src").alias("name")).agg(F.count("*").alias("n")))


@query("filter_excluded", f"WITH k AS (SELECT * FROM {MENTIONS} WHERE ordinal % 100 <> 7 AND NOT (name LIKE 'small%')) SELECT r.src, r.dst, r.label FROM {RELATIONS} r WHERE r.dst IN (SELECT name FROM k)")
def filter_excluded(spark: SparkSession, d: str) -> DataFrame:
    m = mentions(spark, d).withColumn("text", F.col("fact"))
    known = U.exclude(no_exclusions(spark), m.where("name like 'small%'"), m.where("ordinal % 100 = 7").select("namespace", F.col("source").alias("session_id")))
    return U.filter_excluded(m, relations(spark, d), known)[1].select("src", "dst", "label")
