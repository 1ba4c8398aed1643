"""Messages and sessions: search, summaries, running budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import text as T


def keyword_search(docs: DataFrame, keyword: str, namespace: str | None = None, limit: int = 50) -> DataFrame:
    """Rows whose text holds the keyword in any case, newest first; a blank keyword finds nothing."""
    keyword = keyword.strip()
    hits = docs.where(F.contains(F.lower("text"), F.lit(keyword.lower())) & F.lit(bool(keyword)))
    if namespace is not None:
        hits = hits.where(F.col("namespace") == namespace)
    return hits.orderBy(F.desc("updated_at"), "session_id", "seq").limit(limit if limit > 0 else 50)


def scope_filter(rows: DataFrame, scope: str = "", active: str = "") -> DataFrame:
    """Rows of the namespaces in ``scope``: names with commas between, * for all; empty: the ``active`` one, or all where there is none."""
    names = [x.strip() for x in (scope.strip() or active).split(",") if x.strip()]
    return rows if not names or names == ["*"] else rows.where(F.col("namespace").isin(names))


def session_listing(*messages: DataFrame) -> DataFrame:
    """All agents' sessions (session_id, updated_at, messages), newest first."""
    every = messages[0]
    for m in messages[1:]:
        every = every.unionByName(m, allowMissingColumns=True)
    return every.groupBy("session_id").agg(F.max("updated_at").alias("updated_at"), F.count("*").alias("messages")).orderBy(F.desc("updated_at"), "session_id")


def overview_top(rows: DataFrame, section: list[str], order: list, most: int = 12) -> DataFrame:
    """The first ``most`` rows of each section with their ``rank``, and how many ``more`` there are."""
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy(*section).orderBy(*order))).where(F.col("rank") <= most)
    sizes = rows.groupBy(*section).agg(F.greatest(F.count("*") - most, F.lit(0)).alias("more"))
    return ranked.join(sizes, section)


def first_when(value: Column, cond: Column, order: str = "seq") -> Column:
    return F.min_by(value, F.when(cond, F.col(order)))


def last_when(value: Column, cond: Column, order: str = "seq") -> Column:
    return F.max_by(value, F.when(cond, F.col(order)))


def session_summary(events: DataFrame) -> DataFrame:
    """Per session of (session_id, seq, type, title, prompt, cwd, model): title, count, cwd, model."""
    filled = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    out = events.groupBy("session_id").agg(
        last_when(F.col("title"), filled("title")).alias("ai_title"),
        last_when(F.col("prompt"), filled("prompt")).alias("last_prompt"),
        F.count_if(F.col("type").isin("user", "assistant")).alias("message_count"),
        first_when(F.col("cwd"), filled("cwd")).alias("cwd"),
        last_when(F.col("model"), filled("model") & (F.col("model") != "<synthetic>")).alias("model"),
    )
    return out.select("session_id", F.coalesce("ai_title", T.first_line(F.col("last_prompt"))).alias("title"), "message_count", "cwd", "model")


def session_summary_codex(events: DataFrame) -> DataFrame:
    """Per file of (file, seq, type, role, text, meta_id): all response items count; the title is the first user input after its context."""
    said = F.substring_index(F.col("text"), "</environment_context>", -1)
    title = first_when(T.trim(said), (F.col("role") == "user") & (T.trim(said) != ""))
    out = events.groupBy("file").agg(F.count_if(F.col("type") == "response_item").alias("message_count"), title.alias("title"), last_when(F.col("meta_id"), F.col("meta_id").isNotNull()).alias("meta_id"))
    named = F.array_join(F.slice(F.split(F.regexp_replace("file", r"\.jsonl$", ""), "-"), 5, 100), "-")
    return out.select("file", F.coalesce("meta_id", named).alias("session_id"), F.substring("title", 1, 80).alias("title"), "message_count")


def session_summary_buddy(events: DataFrame) -> DataFrame:
    """Per file of (file, seq, type, role, text, cwd, session): all messages count; first cwd, session and user text."""
    return events.groupBy("file").agg(
        F.count_if(F.col("type") == "message").alias("message_count"),
        first_when(F.col("cwd"), F.col("cwd") != "").alias("cwd"),
        first_when(F.col("session"), F.col("session") != "").alias("session_id"),
        F.substring(first_when(F.col("text"), (F.col("role") == "user") & (T.trim(F.col("text")) != "")), 1, 80).alias("title"),
    )


def project_summary(sessions: DataFrame) -> DataFrame:
    """Per folder of (slug, session_id, updated_at): sessions, newest change and decoded path; empty folders drop out."""
    out = sessions.where("session_id is not null").groupBy("slug").agg(F.count("*").alias("session_count"), F.max("updated_at").alias("updated_at"))
    return out.withColumn("path", F.replace("slug", F.lit("-"), F.lit("/"))).orderBy(F.desc("updated_at"), "slug")


def session_progress(messages: DataFrame) -> DataFrame:
    """The last text of user and assistant that isn't blank."""
    said = T.trim(F.col("text")) != ""
    return messages.groupBy("session_id").agg(
        last_when(F.col("text"), said & (F.col("role") == "user")).alias("last_user"), last_when(F.col("text"), said & (F.col("role") == "assistant")).alias("last_assistant")
    )


def bounded_transcript(messages: DataFrame, cap: int = 16_000) -> DataFrame:
    """The newest messages of each session whose rendered bytes fit; the newest at least."""
    newest = Window.partitionBy("namespace", "session_id").orderBy(F.desc("seq"))
    size = F.octet_length(F.concat("role", F.lit(": "), "text", F.lit("\n")))
    # a message has three bytes at least, so no more than a third of ``cap`` fit; Spark leaves the others out before it shuffles
    out = messages.withColumn("rn", F.row_number().over(newest)).where(F.col("rn") <= cap // 3 + 1)
    out = out.withColumn("used", F.sum(size).over(newest.rowsBetween(Window.unboundedPreceding, 0)))
    return out.where((F.col("used") <= cap) | (F.col("rn") == 1)).drop("used", "rn")


def _reached(rows: DataFrame, keys: list[str], order: list[str], size: Column, budget: int, over: bool) -> DataFrame:
    """(.., cut): where each key's running sum of sizes reaches the budget (or goes ``over`` it), as a struct of ``order``; keys that don't have none.

    Rows with a size have one byte at least, so only the first ``budget`` of them (and one) are looked at, which Spark picks before it shuffles.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    sized = rows.select(*keys, *order, size.alias("size")).where("size > 0").withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= budget + 1)
    used = F.sum("size").over(w.rowsBetween(Window.unboundedPreceding, 0))
    at = F.col("used") > budget if over else F.col("used") >= budget
    return sized.withColumn("used", used).where(at).groupBy(*keys).agg(F.min(F.struct(*order)).alias("cut"))


def _marked(rows: DataFrame, marks: DataFrame, keys: list[str]) -> DataFrame:
    marks = marks.withColumnsRenamed({k: f"{k}_of" for k in keys})
    same = [F.col(k).eqNullSafe(F.col(f"{k}_of")) for k in keys]
    return rows.join(marks, same, "left").drop(*[f"{k}_of" for k in keys])


def keep_until(rows: DataFrame, keys: list[str], order: list[str], size: Column, budget: int) -> DataFrame:
    """Rows while what stands before them is under the budget: the last may go over it. ``order`` tells the rows of a key apart."""
    cut = _marked(rows, _reached(rows, keys, order, size, budget, over=False), keys)
    return cut.where(F.col("cut").isNull() | (F.struct(*order) <= F.col("cut"))).drop("cut")


def keep_within(rows: DataFrame, keys: list[str], order: list[str], size: Column, budget: int) -> DataFrame:
    """The first row, then rows while they fit the budget. ``order`` tells the rows of a key apart."""
    first = rows.groupBy(*keys).agg(F.min(F.struct(*order)).alias("first"))
    cut = _marked(_marked(rows, _reached(rows, keys, order, size, budget, over=True), keys), first, keys)
    at = F.struct(*order)
    return cut.where(F.col("cut").isNull() | (at < F.col("cut")) | (at == F.col("first"))).drop("cut", "first")


def rrf_fuse(lists: DataFrame, k: int | None = None, constant: int = 60) -> DataFrame:
    """Reciprocal rank fusion of (query_id, list_no, rank, id): score and rank; ties by first appearance."""
    fused = lists.groupBy("query_id", "id").agg(F.sum(1 / (F.lit(constant) + F.col("rank"))).alias("score"), F.min(F.struct("list_no", "rank")).alias("first"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "first", "id")
    out = fused.withColumn("rank", F.row_number().over(w)).select("query_id", "id", "score", "rank")
    return out if k is None else out.where(F.col("rank") <= k)


def freshness(files: DataFrame, records: DataFrame, key: str, current: int = 2) -> DataFrame:
    """Files with ``status``: fresh; backfill, if only the record's schema is older; else reprocess."""
    same = F.col("seen") == F.col("mtime")
    return files.join(records, key, "left").withColumn("status", F.when(same & (F.col("schema") >= current), "fresh").when(same, "backfill").otherwise("reprocess"))


def append_run_seq(runs: DataFrame, done: DataFrame, order: list) -> DataFrame:
    """New runs numbered on from each task's highest seq."""
    top = done.groupBy("task_id").agg(F.max("seq").alias("top"))
    n = F.row_number().over(Window.partitionBy("task_id").orderBy(*order))
    return runs.withColumn("n", n).join(top, "task_id", "left").withColumn("seq", F.coalesce("top", F.lit(0)) + F.col("n")).drop("n", "top")


def latest(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The newest row of each key."""
    return rows.withColumn("rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("rn = 1").drop("rn")


def nearest_marker(dirs: DataFrame, markers: DataFrame) -> DataFrame:
    """The namespace of the nearest folder at or above each cwd that has one (markers: dir, namespace)."""
    parts = F.split("cwd", "/")
    ups = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.struct(n.alias("depth"), F.array_join(F.slice(parts, F.lit(1), n), "/").alias("dir")))
    marked = markers.select("dir", T.trim(F.col("namespace")).alias("namespace")).where("namespace <> ''")
    found = dirs.select("cwd").distinct().select("cwd", F.inline(ups)).join(marked, "dir").groupBy("cwd").agg(F.max_by("namespace", "depth").alias("namespace"))
    return dirs.join(found, "cwd", "left")
