"""The given tables in the shapes that the operators take, and the same as SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):  # noqa: ANN201
    """Register a query under ``name`` with its DuckDB SQL."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


#: messages(namespace, session_id, seq, role, text, updated_at)
MESSAGES = "(SELECT 'ns' || (conv_id % 4) AS namespace, 's' || conv_id AS session_id, turn AS seq, role, text, 1704067200000 + conv_id * 60000 AS updated_at FROM conversations)"


def messages(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations")
    return c.select(
        F.concat(F.lit("ns"), F.col("conv_id") % 4).alias("namespace"), F.concat(F.lit("s"), "conv_id").alias("session_id"), F.col("turn").alias("seq"), "role", "text",
        (F.lit(1704067200000) + F.col("conv_id") * 60000).alias("updated_at"),
    )


#: entity_mentions(namespace, record_id, ordinal, name, type, fact, source)
MENTIONS = "(SELECT 'ns' || (p_partkey % 4) AS namespace, 'r' || (p_partkey % 50) AS record_id, p_partkey AS ordinal, p_name AS name, p_type AS type, p_brand || ' size ' || p_size AS fact, 's' || (p_partkey % 100) AS source FROM part)"


def mentions(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    return p.select(
        F.concat(F.lit("ns"), F.col("p_partkey") % 4).alias("namespace"), F.concat(F.lit("r"), F.col("p_partkey") % 50).alias("record_id"), F.col("p_partkey").alias("ordinal"),
        F.col("p_name").alias("name"), F.col("p_type").alias("type"), F.concat("p_brand", F.lit(" size "), "p_size").alias("fact"), F.concat(F.lit("s"), F.col("p_partkey") % 100).alias("source"),
    )


#: relations(src, dst, label, ordinal): suppliers' parts; the ordinal of an edge is its first order
RELATIONS = "(SELECT s_name AS src, p_name AS dst, l_returnflag AS label, min(l_orderkey) AS ordinal FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey GROUP BY 1, 2, 3)"


def relations(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").select("l_orderkey", "l_suppkey", "l_partkey", "l_returnflag")
    s, p = table(spark, d, "supplier").select("s_suppkey", "s_name"), table(spark, d, "part").select("p_partkey", "p_name")
    x = li.join(s, li.l_suppkey == s.s_suppkey).join(p, li.l_partkey == p.p_partkey)
    return x.groupBy(F.col("s_name").alias("src"), F.col("p_name").alias("dst"), F.col("l_returnflag").alias("label")).agg(F.min("l_orderkey").alias("ordinal"))


#: a small directed graph: customers' nations, nations' regions
TREE = "(SELECT c_name AS src, n_name AS dst, 'in' AS label FROM customer JOIN nation ON c_nationkey = n_nationkey UNION ALL SELECT n_name, r_name, 'in' FROM nation JOIN region ON n_regionkey = r_regionkey)"


def tree(spark: SparkSession, d: str) -> DataFrame:
    c, n, r = (table(spark, d, t) for t in ("customer", "nation", "region"))
    a = c.join(n, c.c_nationkey == n.n_nationkey).select(F.col("c_name").alias("src"), F.col("n_name").alias("dst"), F.lit("in").alias("label"))
    return a.union(n.join(r, n.n_regionkey == r.r_regionkey).select("n_name", "r_name", F.lit("in")))


#: source paths: pages' urls without scheme and host
PATHS = "(SELECT page_id, 'cmd/' || regexp_replace(regexp_replace(url, '^https?://', ''), '[?#].*$', '') || CASE page_id % 6 WHEN 0 THEN '.go' WHEN 1 THEN '/package-lock.json' WHEN 2 THEN '.min.js' WHEN 3 THEN '/.env.local' WHEN 4 THEN '/userService.ts' ELSE '' END AS path FROM pages)"


def paths(spark: SparkSession, d: str) -> DataFrame:
    end = F.element_at(F.array(*[F.lit(x) for x in (".go", "/package-lock.json", ".min.js", "/.env.local", "/userService.ts", "")]), (F.col("page_id") % 6 + 1).cast("int"))
    bare = F.regexp_replace(F.regexp_replace("url", "^https?://", ""), r"[?#].*$", "")
    return table(spark, d, "pages").select("page_id", F.concat(F.lit("cmd/"), bare, end).alias("path"))


#: lines of documents, numbered from 0
LINES = "(SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS n FROM documents)"


def lines(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "line"))
