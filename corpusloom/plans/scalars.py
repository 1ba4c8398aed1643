"""Queries of the text expressions and predicates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import graph as G
from corpusloom.plans.views import LINES, MENTIONS, MESSAGES, PATHS, RELATIONS, lines, mentions, messages, paths, query, relations, table


def _sql_list(words: list[str]) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


def _sql_any(text: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({text}, '{w}')" for w in words) + ")"


WS = r"'^[\s]+|[\s]+$'"


@query("norm_key", f"SELECT doc_id, n, lower(regexp_replace(line, {WS}, '', 'g')) AS key FROM {LINES}")
def norm_key(spark: SparkSession, d: str) -> DataFrame:
    return lines(spark, d).select("doc_id", "n", T.norm_key(F.col("line")).alias("key"))




def _terms_sql(text: str) -> str:
    words = f"""list_transform(regexp_split_to_array(regexp_replace(lower({text}), '^\\s+|\\s+$', '', 'g'), '\\s+'), lambda w: regexp_replace(w, '^[.,;:!?()\\[\\]{{}}"''`]+|[.,;:!?()\\[\\]{{}}"''`]+$', '', 'g'))"""
    kept = f"list_filter({words}, lambda w: length(w) >= 2 AND NOT list_contains({_sql_list(T.STOP_WORDS)}, w))"
    return f"list_filter({kept}, lambda w, i: list_position({kept}, w) = i)"


@query("query_terms", f"SELECT item_id, array_to_string({_terms_sql('text')}, '|') AS terms FROM benchmark")
def query_terms(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select("item_id", F.array_join(T.query_terms(F.col("text")), "|").alias("terms"))


@query(
    "token_set",
    "SELECT conv_id, turn, array_to_string(list_sort(list_distinct(regexp_extract_all(lower(text), '\\p{Han}|[\\p{L}\\p{Nd}]+'))), '|') AS tokens FROM conversations",
)
def token_set(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").select("conv_id", "turn", F.array_join(F.array_sort(T.token_set(F.col("text"))), "|").alias("tokens"))


@query(
    "jaccard",
    """WITH t AS (SELECT conv_id, turn, list_distinct(regexp_extract_all(lower(text), '[\\p{L}\\p{Nd}]+')) AS s FROM conversations)
    SELECT a.conv_id, a.turn, round(CASE WHEN len(a.s) = 0 OR len(b.s) = 0 THEN 0 ELSE len(list_intersect(a.s, b.s)) / (len(a.s) + len(b.s) - len(list_intersect(a.s, b.s)))::DOUBLE END, 9) AS similarity
    FROM t a JOIN t b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1""",
)
def jaccard(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "conversations").select("conv_id", "turn", T.token_set(F.col("text")).alias("s"))
    b = t.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("s").alias("s2"))
    return t.join(b, ["conv_id", "turn"]).select("conv_id", "turn", F.round(T.jaccard(F.col("s"), F.col("s2")), 9).alias("similarity"))


@query(
    "cosine",
    """SELECT a.vec_id, b.vec_id AS other_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 7) AS cosine
    FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""",
)
def cosine(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "embeddings").select("vec_id", "embedding")
    w = v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("vec_id").alias("other_id"), F.col("embedding").alias("other"))
    return v.join(w, "vec_id").select("vec_id", "other_id", F.round(T.cosine(F.col("embedding"), F.col("other")), 7).alias("cosine"))


_WORDS_SQL = "list_filter(regexp_split_to_array(lower(regexp_replace(regexp_replace(name, '([^A-Z])([A-Z])', '\\1 \\2', 'g'), '([^A-Z ])([A-Z])', '\\1 \\2', 'g')), '[\\s_\\-.]+'), lambda w: w <> '')"
_SYMBOLS = "(SELECT p_partkey AS id, list_aggregate(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || w[2:]), 'string_agg', '') || '_' || p_type || '.' || replace(p_brand, '#', '') AS name FROM part)"


def _symbols(spark: SparkSession, d: str) -> DataFrame:
    camel = F.array_join(F.transform(F.split("p_name", " "), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substr(w, F.lit(2), F.length(w)))), "")
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.concat(camel, F.lit("_"), "p_type", F.lit("."), F.replace("p_brand", F.lit("#"), F.lit(""))).alias("name"))


@query("split_words", f"SELECT id, array_to_string({_WORDS_SQL}, '|') AS words FROM {_SYMBOLS}")
def split_words(spark: SparkSession, d: str) -> DataFrame:
    return _symbols(spark, d).select("id", F.array_join(T.split_words(F.col("name")), "|").alias("words"))


@query("symbol_aliases", f"SELECT id, CASE WHEN len({_WORDS_SQL}) >= 2 THEN array_to_string({_WORDS_SQL}, ' ') ELSE '' END AS aliases FROM {_SYMBOLS}")
def symbol_aliases(spark: SparkSession, d: str) -> DataFrame:
    return _symbols(spark, d).select("id", F.array_join(T.symbol_aliases(F.col("name")), "|").alias("aliases"))


@query("package_name", f"SELECT page_id, CASE WHEN NOT contains(path, '/') OR regexp_replace(path, '/[^/]*$', '') = '' THEN '.' ELSE regexp_replace(path, '/[^/]*$', '') END AS package FROM {PATHS}")
def package_name(spark: SparkSession, d: str) -> DataFrame:
    return paths(spark, d).select("page_id", T.package_name(F.col("path")).alias("package"))


@query("note_title", f"SELECT page_id, regexp_replace(regexp_extract(path, '[^/]*$'), '\\.[^.]*$', '') AS title FROM {PATHS}")
def note_title(spark: SparkSession, d: str) -> DataFrame:
    return paths(spark, d).select("page_id", T.note_title(F.col("path")).alias("title"))


@query(
    "dedup_aliases",
    """WITH x AS (SELECT p_partkey AS id, [p_type, p_name, upper(p_name), '', lower(p_type), p_brand] AS a, p_name AS canon FROM part),
    y AS (SELECT id, canon, list_transform(a, lambda v: lower(trim(v))) AS k, a FROM x)
    SELECT id, array_to_string(list_filter(a, lambda v, i: k[i] <> '' AND k[i] <> lower(canon) AND list_position(k, k[i]) = i), '|') AS aliases FROM y""",
)
def dedup_aliases(spark: SparkSession, d: str) -> DataFrame:
    a = F.array("p_type", "p_name", F.upper("p_name"), F.lit(""), F.lower("p_type"), "p_brand")
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.array_join(T.distinct_by_key(a, F.col("p_name")), "|").alias("aliases"))


_LINKED = "(SELECT doc_id, regexp_replace(text, '([A-Z][a-z]+) ([a-z]+)', '[[notes/\\1.md#x|\\2]] [[\\2]]', 'g') AS text FROM documents)"


@query(
    "parse_wikilinks",
    f"""WITH x AS (SELECT doc_id, list_transform(regexp_extract_all(text, '\\[\\[([^\\]]+)\\]\\]', 1), lambda l: trim(regexp_replace(regexp_extract(trim(string_split(string_split(l, '|')[1], '#')[1]), '[^/]*$'), '(?i)\\.md$', ''))) AS a FROM {_LINKED}),
    y AS (SELECT doc_id, a, list_transform(a, lambda v: lower(v)) AS k FROM x)
    SELECT doc_id, array_to_string(list_filter(a, lambda v, i: k[i] <> '' AND list_position(k, k[i]) = i), '|') AS links FROM y""",
)
def parse_wikilinks(spark: SparkSession, d: str) -> DataFrame:
    linked = F.regexp_replace("text", "([A-Z][a-z]+) ([a-z]+)", "[[notes/$1.md#x|$2]] [[$2]]")
    return table(spark, d, "documents").select("doc_id", F.array_join(T.parse_wikilinks(linked), "|").alias("links"))


_FIRST_SQL = f"list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, {WS}, '', 'g')), lambda x: x <> '')[1]"


@query("first_line", f"SELECT doc_id, CASE WHEN length(l) > 60 THEN l[:60] || '…' ELSE l END AS line FROM (SELECT doc_id, coalesce({_FIRST_SQL}, '') AS l FROM documents)")
def first_line(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", T.first_line(F.col("text")).alias("line"))


@query("task_title", f"SELECT doc_id, CASE WHEN length(l) > 60 THEN l[:60] || '...' ELSE l END AS title FROM (SELECT doc_id, coalesce({_FIRST_SQL}, 'Untitled task') AS l FROM documents)")
def task_title(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", T.task_title(F.col("text")).alias("title"))


@query(
    "chat_title",
    f"""SELECT conv_id, CASE WHEN conv_id % 3 = 0 THEN 'named ' || conv_id WHEN length(t) > 60 THEN t[:60] || '...' ELSE t END AS title
    FROM (SELECT conv_id, regexp_replace(text, {WS}, '', 'g') AS t FROM conversations WHERE turn = 0)""",
)
def chat_title(spark: SparkSession, d: str) -> DataFrame:
    named = F.when(F.col("conv_id") % 3 == 0, F.concat(F.lit("named "), "conv_id")).otherwise(F.lit("  "))
    return table(spark, d, "conversations").where("turn = 0").select("conv_id", T.chat_title(named, F.col("text")).alias("title"))


@query("parse_reply_json", "SELECT event_id, (props::JSON ->> 'k')::BIGINT AS k FROM events")
def parse_reply_json(spark: SparkSession, d: str) -> DataFrame:
    reply = F.concat(F.lit("Here it is:\n```json\n"), "props", F.lit("\n``` done"))
    return table(spark, d, "events").select("event_id", F.from_json(T.json_part(reply), "k long")["k"].alias("k"))


@query("parse_spec_json", "SELECT event_id, event_type AS goal, event_id % 5 <> 0 AS ok FROM events WHERE event_id % 5 <> 0 UNION ALL SELECT event_id, NULL, false FROM events WHERE event_id % 5 = 0")
def parse_spec_json(spark: SparkSession, d: str) -> DataFrame:
    reply = F.when(F.col("event_id") % 5 == 0, F.lit("no spec { here")).otherwise(F.concat(F.lit('Spec: {"goal": "'), "event_type", F.lit('", "scope": ["a/b.go"]} end')))
    spec = F.from_json(T.json_part(reply), "goal string, scope array<string>, _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    return table(spark, d, "events").select("event_id", spec.alias("s")).select("event_id", F.col("s.goal").alias("goal"), F.col("s._corrupt").isNull().alias("ok"))


@query(
    "extract_tag",
    """SELECT event_id, CASE event_id % 3 WHEN 0 THEN event_type WHEN 1 THEN props ELSE 'none' END AS message FROM events""",
)
def extract_tag(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    reply = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("x <COMMIT>"), "event_type", F.lit("</COMMIT> y"))).when(F.col("event_id") % 3 == 1, F.concat(F.lit("<COMMIT> "), "props")).otherwise(F.lit("none"))
    return e.select("event_id", F.coalesce(F.nullif(T.trim(T.extract_tag(reply, "COMMIT")), F.lit("")), T.trim(reply)).alias("message"))


@query("obs_key", f"SELECT ordinal, sha1(lower(name) || chr(0) || fact) AS key FROM {MENTIONS}")
def obs_key(spark: SparkSession, d: str) -> DataFrame:
    return mentions(spark, d).select("ordinal", T.obs_key(F.concat(F.lit(" "), F.upper("name")), F.concat("fact", F.lit("\n"))).alias("key"))


_NOW = 1_717_200_000_000


@query(
    "age_days",
    f"""WITH x AS (SELECT session_id, seq, ({_NOW} - updated_at * 1) // 86400000 AS days FROM {MESSAGES})
    SELECT session_id, seq, days::BIGINT AS days, CASE WHEN days <= 0 THEN ' (今天)' WHEN days > 90 THEN ' (' || days || '天前⚠️)' ELSE ' (' || days || '天前)' END AS note FROM x""",
)
def age_days(spark: SparkSession, d: str) -> DataFrame:
    source = F.concat(F.lit("mcp:"), "updated_at", F.lit("-0d23"))
    return messages(spark, d).select("session_id", "seq", T.age_days(source, F.lit(_NOW)).alias("days"), T.age_note(source, F.lit(_NOW)).alias("note"))


@query("recall_method", "SELECT event_id, CASE WHEN event_id % 2 = 0 AND event_id % 3 = 0 THEN 'hybrid' WHEN event_id % 2 = 0 THEN 'semantic' WHEN event_id % 3 = 0 THEN 'keyword' ELSE 'none' END AS method FROM events")
def recall_method(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", T.recall_method(F.col("event_id") % 2 == 0, F.col("event_id") % 3 == 0).alias("method"))


@query("entity_embed_text", f"SELECT namespace, name, name || ' ' || string_agg(fact, ' ' ORDER BY ordinal) AS text FROM {MENTIONS} GROUP BY 1, 2")
def entity_embed_text(spark: SparkSession, d: str) -> DataFrame:
    facts = F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "fact"))), lambda x: x["fact"])
    return mentions(spark, d).groupBy("namespace", "name").agg(facts.alias("facts")).select("namespace", "name", T.entity_embed_text(F.col("name"), F.col("facts")).alias("text"))


@query("render_entity", f"SELECT ordinal, chr(10) || '### ' || name || '（' || type || '）' || chr(10) || '- ' || fact || ' （来源：' || source || '）' || chr(10) AS text FROM {MENTIONS}")
def render_entity(spark: SparkSession, d: str) -> DataFrame:
    return mentions(spark, d).select("ordinal", T.render_entity(F.col("name"), F.col("type"), F.array("fact"), F.array("source")).alias("text"))


@query("render_relation", "SELECT o_orderkey, o_orderstatus || ' —' || o_orderpriority || '→ ' || o_custkey AS text FROM orders")
def render_relation(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", T.render_relation(F.col("o_orderstatus"), F.col("o_orderpriority"), F.col("o_custkey").cast("string")).alias("text"))


@query("render_chunk", f"SELECT session_id, seq, chr(10) || '〔来源：' || session_id || '〕' || chr(10) || text || chr(10) || chr(10) || '---' || chr(10) AS text FROM {MESSAGES}")
def render_chunk(spark: SparkSession, d: str) -> DataFrame:
    return messages(spark, d).select("session_id", "seq", T.render_chunk(F.col("session_id"), F.col("text")).alias("text"))


@query(
    "graph_material",
    f"""SELECT namespace, 0 AS part, 0::BIGINT AS ordinal, 'about parts' AS line FROM {MENTIONS} GROUP BY 1 UNION ALL SELECT namespace, 1, ordinal::BIGINT, name || '(' || type || '): ' || fact FROM {MENTIONS}
    UNION ALL SELECT 'ns' || (ordinal % 4), 2, ordinal::BIGINT, src || ' —' || label || '→ ' || dst FROM {RELATIONS}""",
)
def graph_material(spark: SparkSession, d: str) -> DataFrame:
    r = relations(spark, d).withColumn("namespace", F.concat(F.lit("ns"), F.col("ordinal") % 4))
    return G.graph_material(mentions(spark, d).withColumn("observations", F.array("fact")), r, " about parts ")


@query(
    "enrich_query",
    f"""SELECT page_id, 'task ' || page_id || ' ' || path || CASE WHEN contains(path, '/') THEN ' ' || regexp_replace(regexp_extract(path, '[^/]*$'), '\\.[^.]*$', '') ELSE '' END || ' docs' AS query FROM {PATHS}""",
)
def enrich_query(spark: SparkSession, d: str) -> DataFrame:
    return paths(spark, d).select("page_id", T.enrich_query(F.concat(F.lit("task "), "page_id"), F.array("path", F.lit(" "), F.lit("docs"))).alias("query"))


_AGENT_SQL = "CASE conv_id % 4 WHEN 0 THEN 'codex' WHEN 1 THEN 'workbuddy' WHEN 2 THEN 'codebuddy' ELSE 'claude' END"


@query("strip_ns_prefix", f"SELECT conv_id, turn, 's' || conv_id AS id, {_AGENT_SQL} AS agent FROM conversations")
def strip_ns_prefix(spark: SparkSession, d: str) -> DataFrame:
    prefix = F.element_at(F.array(*[F.lit(x) for x in ("codex:", "workbuddy:", "codebuddy:", "")]), (F.col("conv_id") % 4 + 1).cast("int"))
    x = F.concat(prefix, F.lit("s"), "conv_id")
    return table(spark, d, "conversations").select("conv_id", "turn", T.strip_prefix(x).alias("id"), T.agent_of(x).alias("agent"))


@query("strip_speaker", "SELECT conv_id, turn, text FROM conversations")
def strip_speaker(spark: SparkSession, d: str) -> DataFrame:
    said = F.concat(F.when(F.col("turn") % 2 == 0, "User: ").otherwise("ASSISTANT:"), "text")
    return table(spark, d, "conversations").select("conv_id", "turn", T.strip_speaker(said).alias("text"))


_LOG_SQL = """(len(string_split(b, chr(10))) >= 3 AND 2 * len(list_filter(list_transform(string_split(lower(b), chr(10)), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')),
    lambda x: regexp_matches(x, '^(at |\\$ |> |error:|warning:)') OR contains(x, 'traceback') OR contains(x, 'goroutine ') OR contains(x, chr(9) || 'at '))) >= len(string_split(b, chr(10))))"""
_LOGGED = "(SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN regexp_replace(text, '(^|\\n)', '\\1> ', 'g') ELSE text END AS b FROM documents)"


def _logged(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.when(F.col("doc_id") % 3 == 0, F.regexp_replace("text", r"(^|\n)", "$1> ")).otherwise(F.col("text")).alias("b"))


@query("looks_like_log", f"SELECT doc_id, {_LOG_SQL} AS log FROM {_LOGGED}")
def looks_like_log(spark: SparkSession, d: str) -> DataFrame:
    return _logged(spark, d).select("doc_id", T.looks_like_log(F.col("b")).alias("log"))


@query("is_noise_chunk", f"SELECT doc_id, n, length(regexp_replace(line, {WS}, '', 'g')) < 40 OR list_contains({_sql_list(T.ACKNOWLEDGEMENTS)}, regexp_replace(lower(regexp_replace(line, {WS}, '', 'g')), '[。.!！~ ]+$', '')) AS noise FROM {LINES}")
def is_noise_chunk(spark: SparkSession, d: str) -> DataFrame:
    return lines(spark, d).select("doc_id", "n", T.is_noise_chunk(F.concat(F.lit("user: "), "line")).alias("noise"))


_OBS = """(SELECT event_id, CASE event_id % 7 WHEN 0 THEN 'commit ' || sha1(event_id::VARCHAR)[:8] || ' merged' WHEN 1 THEN 'Pipeline #' || (20000 + event_id) WHEN 2 THEN '必须 pipeline ' || (20000 + event_id)
    WHEN 3 THEN 'image 1.2.3-beta-' || sha1(event_id::VARCHAR)[:6] WHEN 4 THEN '构建成功 ' || event_type WHEN 5 THEN event_type || ' probably ' || props ELSE event_type || ' on 172.20.' || (event_id % 9) END AS obs FROM events)"""


def _observations(spark: SparkSession, d: str) -> DataFrame:
    e, i = table(spark, d, "events"), F.col("event_id")
    h = F.sha1(i.cast("string"))
    text = (
        F.when(i % 7 == 0, F.concat(F.lit("commit "), F.substring(h, 1, 8), F.lit(" merged")))
        .when(i % 7 == 1, F.concat(F.lit("Pipeline #"), i + 20000))
        .when(i % 7 == 2, F.concat(F.lit("必须 pipeline "), i + 20000))
        .when(i % 7 == 3, F.concat(F.lit("image 1.2.3-beta-"), F.substring(h, 1, 6)))
        .when(i % 7 == 4, F.concat(F.lit("构建成功 "), "event_type"))
        .when(i % 7 == 5, F.concat("event_type", F.lit(" probably "), "props"))
        .otherwise(F.concat("event_type", F.lit(" on 172.20."), i % 9))
    )
    return e.select("event_id", text.alias("obs"))


def _snapshot_sql(rules: list[str], words: list[str], commits: list[str], pipeline: str) -> str:
    shown = f"regexp_matches(obs, '{T.IMAGE_TAG}') OR regexp_matches(obs, '{T.PRIVATE_ADDRESS}') OR regexp_matches(obs, '{pipeline}') OR (regexp_matches(obs, '{T.COMMIT_HASH}') AND {_sql_any('lower(obs)', commits)}) OR {_sql_any('obs', words)}"
    return f"NOT {_sql_any('obs', rules)} AND ({shown})"


@query("is_snapshot_obs", f"SELECT event_id, {_snapshot_sql(T.RULE_WORDS, T.SNAPSHOT_WORDS, T.COMMIT_WORDS, '(?i)' + T.PIPELINE)} AS snapshot FROM {_OBS}")
def is_snapshot_obs(spark: SparkSession, d: str) -> DataFrame:
    return _observations(spark, d).select("event_id", T.is_snapshot_obs(F.col("obs")).alias("snapshot"))


@query("is_snapshot_obs_batch", f"SELECT event_id, {_snapshot_sql(T.BATCH_RULE_WORDS, T.BATCH_SNAPSHOT_WORDS, T.BATCH_COMMIT_WORDS, T.PIPELINE)} AS snapshot FROM {_OBS}")
def is_snapshot_obs_batch(spark: SparkSession, d: str) -> DataFrame:
    return _observations(spark, d).select("event_id", T.is_snapshot_obs_batch(F.col("obs")).alias("snapshot"))


@query("vague_wording", f"SELECT event_id, list_filter({_sql_list(T.VAGUE_WORDS)}, lambda w: contains(lower(obs), w))[1] AS word FROM {_OBS}")
def vague_wording(spark: SparkSession, d: str) -> DataFrame:
    return _observations(spark, d).select("event_id", T.vague_wording(F.col("obs")).alias("word"))


_BASE = "regexp_extract(path, '[^/]*$')"


@query(
    "skip_generated",
    f"SELECT page_id, list_contains({_sql_list(T.GENERATED_FILES)}, {_BASE}) OR regexp_matches({_BASE}, '(\\.lock|\\.min\\.js|\\.min\\.css|\\.snap)$') OR list_has_any(string_split(path, '/'), {_sql_list(T.GENERATED_FOLDERS)}) AS skip FROM {PATHS}",
)
def skip_generated(spark: SparkSession, d: str) -> DataFrame:
    return paths(spark, d).select("page_id", T.skip_generated(F.col("path")).alias("skip"))


@query(
    "skip_secret",
    f"SELECT page_id, regexp_matches(lower({_BASE}), '^\\.env(\\.|$)|\\.env$|(\\.pem|\\.key|\\.p12|\\.pfx|\\.keystore|\\.jks)$|^(id_rsa|id_ed25519)|credential|secret') AS skip FROM {PATHS}",
)
def skip_secret(spark: SparkSession, d: str) -> DataFrame:
    return paths(spark, d).select("page_id", T.skip_secret(F.col("path")).alias("skip"))


@query("is_entry_point", f"SELECT page_id, list_contains({_sql_list(T.ENTRY_FILES)}, lower({_BASE})) OR starts_with(path, 'cmd/a') OR regexp_matches(lower({_BASE}), 'controller|service|handler|router|route') AS entry FROM (SELECT page_id, CASE WHEN page_id % 2 = 0 THEN path ELSE path[5:] END AS path FROM {PATHS})".replace("'cmd/a'", "'cmd/'"))
def is_entry_point(spark: SparkSession, d: str) -> DataFrame:
    p = F.when(F.col("page_id") % 2 == 0, F.col("path")).otherwise(F.substr("path", F.lit(5), F.length("path")))
    return paths(spark, d).select("page_id", T.is_entry_point(p).alias("entry"))


@query(
    "search_snippet",
    """WITH x AS (SELECT conv_id, turn, text, 'ion' AS kw, instr(lower(text), 'ion') AS p FROM conversations),
    y AS (SELECT *, greatest(p - 40, 1) AS s, least(p + 3 - 1 + 60, length(text)) AS e FROM x)
    SELECT conv_id, turn, CASE WHEN p > 0 THEN CASE WHEN s > 1 THEN '…' ELSE '' END || text[s:e] || CASE WHEN e < length(text) THEN '…' ELSE '' END
      WHEN length(text) > 160 THEN text[:160] || '…' ELSE text END AS snippet FROM y""",
)
def search_snippet(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").select("conv_id", "turn", T.search_snippet(F.col("text"), F.lit("Ion")).alias("snippet"))
