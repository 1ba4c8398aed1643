"""Conversations, tasks and runs: listings, status, transcripts; writes and names of facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import text as T

# Lifecycle of a task, (from, event, to).
TRANSITIONS = [
    ("draft", "enrich", "enriching"), ("enriching", "spec", "review_spec"), ("review_spec", "approve", "queued"), ("queued", "start", "executing"),
    ("executing", "result", "review_result"), ("review_result", "accept", "accepted"), ("review_result", "reject", "queued"),
    ("enriching", "fail", "failed"), ("executing", "fail", "failed"), ("enriching", "cancel", "draft"), ("queued", "cancel", "review_spec"), ("executing", "cancel", "review_spec"),
]


def list_conversations(conversations: DataFrame, key: str = "conversation_id") -> DataFrame:
    """Newest first."""
    return conversations.orderBy(F.desc("updated_at"), key)


def list_tasks(tasks: DataFrame) -> DataFrame:
    """Newest first."""
    return tasks.orderBy(F.desc("updated_at"), "task_id")


def list_messages(messages: DataFrame, key: str = "conversation_id", order: str = "id") -> DataFrame:
    """Each conversation's messages in the order in which they were written."""
    return messages.orderBy(key, order)


def list_runs(runs: DataFrame) -> DataFrame:
    """Each task's runs by their number."""
    return runs.orderBy("task_id", "seq")


def latest_run(runs: DataFrame) -> DataFrame:
    """(task_id, seq, status) of each task's last run."""
    return runs.groupBy("task_id").agg(F.max("seq").alias("seq"), F.max_by("status", "seq").alias("status"))


def cascade_delete(parents: DataFrame, children: DataFrame, gone: DataFrame, key: str, child_key: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Parents that aren't ``gone`` (key), and children whose parent isn't."""
    ids = gone.select(key).distinct()
    return parents.join(ids, key, "left_anti"), children.join(ids.withColumnRenamed(key, child_key or key), child_key or key, "left_anti")


# Titles of a task's transcript and of its specification's lists.
TRANSCRIPT_TITLES = {"input": "任务输入", "spec": "任务规格", "result": "最终采纳的产出"}
SPEC_LISTS = {"constraints": "约束", "scope": "涉及范围", "accept_criteria": "验收标准", "missed_points": "易遗漏点", "steps": "建议步骤"}
SPEC = "struct<goal: string, background: string, constraints: array<string>, scope: array<string>, accept_criteria: array<string>, missed_points: array<string>, steps: array<string>>"


def render_spec(spec: Column) -> Column:
    """A task's specification as text: goal and background, then each list that has entries."""
    filled = lambda c: F.coalesce(c, F.lit("")) != ""
    parts = [F.when(filled(spec["goal"]), F.concat(F.lit("目标: "), spec["goal"])), F.when(filled(spec["background"]), F.concat(F.lit("背景:\n"), spec["background"]))]
    for field, title in SPEC_LISTS.items():
        parts.append(F.when(F.size(spec[field]) > 0, F.concat(F.lit(f"{title}:\n"), F.array_join(F.transform(spec[field], lambda x: F.concat(F.lit("- "), x)), "\n"))))
    return F.concat_ws("\n\n", *parts)


def task_transcript(tasks: DataFrame) -> DataFrame:
    """(task_id, text) of tasks (task_id, input, spec, result): titled blocks of what is there; tasks without any have none."""
    block = lambda key, c: F.when(F.coalesce(T.trim(c), F.lit("")) != "", F.concat(F.lit(TRANSCRIPT_TITLES[key] + ":\n"), T.trim(c)))
    text = F.concat_ws("\n\n", block("input", F.col("input")), block("spec", render_spec(F.col("spec"))), block("result", F.col("result")))
    return tasks.select("task_id", text.alias("text")).where("text <> ''")


def conversation_activity(conversations: DataFrame, messages: DataFrame) -> DataFrame:
    """Conversations with the newest message's time and the newest model that isn't empty."""
    fresh = messages.groupBy("conversation_id").agg(F.max("created_at").alias("newest"), F.max_by("model", F.when(F.col("model") != "", F.col("created_at"))).alias("new_model"))
    x = conversations.join(fresh, "conversation_id", "left")
    return x.select("conversation_id", F.coalesce(F.greatest("updated_at", "newest"), "updated_at").alias("updated_at"), F.coalesce("new_model", "model").alias("model"))


def recover_stale_tasks(tasks: DataFrame) -> DataFrame:
    status = F.when(F.col("status").isin("executing", "queued"), "failed").when(F.col("status") == "enriching", "draft").otherwise(F.col("status"))
    stage = F.when(F.col("status").isin("executing", "queued"), "execute").otherwise(F.col("failed_stage"))
    return tasks.withColumn("failed_stage", stage).withColumn("status", status)


def task_status(events: DataFrame) -> DataFrame:
    """Each task's latest status of (task_id, seq, from_status, event), and how many events the lifecycle doesn't allow."""
    allowed = events.sparkSession.createDataFrame(TRANSITIONS, "from_status string, event string, to_status string")
    x = events.join(F.broadcast(allowed), ["from_status", "event"], "left")  # a dozen rows
    return x.groupBy("task_id").agg(F.max_by("to_status", F.when(F.col("to_status").isNotNull(), F.col("seq"))).alias("status"), F.count_if(F.col("to_status").isNull()).alias("illegal"))


def validate_mentions(writes: DataFrame) -> DataFrame:
    """Writes (name, type, observations) trimmed, without passing facts; nameless and fact-less ones go; ``filtered`` counts facts left out."""
    facts = F.filter(F.transform("observations", T.trim), lambda o: o != "")
    kept = F.filter(facts, lambda o: ~T.is_snapshot_obs(o))
    x = writes.withColumn("name", T.trim(F.col("name"))).withColumn("type", F.coalesce(F.nullif(T.trim(F.col("type")), F.lit("")), F.lit("concept")))
    x = x.withColumn("filtered", F.size(facts) - F.size(kept)).withColumn("observations", kept)
    return x.where((F.col("name") != "") & (F.size("observations") > 0))


def replace_observations(facts: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """New facts (.., text) with the source of the same old text, else ``manual``; blanks go."""
    old = facts.groupBy(*keys, "text").agg(F.min("source").alias("source"))
    return new.where(T.trim(F.col("text")) != "").join(old, [*keys, "text"], "left").withColumn("source", F.coalesce("source", F.lit("manual")))


def rename_entity(mentions: DataFrame, relations: DataFrame, old: str, new: str) -> tuple[DataFrame, DataFrame]:
    """Mentions and relations under the new name, the old one as alias; an error if it is missing or the new one is taken."""
    known = mentions.agg(F.count_if(T.norm_key(F.col("name")) == old.strip().lower()).alias("old"), F.count_if(T.norm_key(F.col("name")) == new.strip().lower()).alias("new")).first()
    if not known["old"] or (known["new"] and old.strip().lower() != new.strip().lower()):
        raise ValueError(f"{old!r} is missing" if not known["old"] else f"{new!r} is taken")
    hit = T.norm_key(F.col("name")) == old.strip().lower()
    out = mentions.withColumn("aliases", F.when(hit, F.array_append("aliases", F.col("name"))).otherwise(F.col("aliases"))).withColumn("name", F.when(hit, F.lit(new)).otherwise(F.col("name")))
    for end in ("src", "dst"):
        relations = relations.withColumn(end, F.when(T.norm_key(F.col(end)) == old.strip().lower(), F.lit(new)).otherwise(F.col(end)))
    return out, relations


def delete_entities(mentions: DataFrame, relations: DataFrame, names: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Without mentions whose name or alias is given, and without relations that touch a given name itself."""
    gone = names.select(T.norm_key(F.col("name")).alias("k")).distinct()
    keys = F.transform(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>"))), T.norm_key)
    hit = mentions.select("ordinal", F.explode(keys).alias("k")).join(gone, "k", "left_semi").select("ordinal").distinct()
    for end in ("src", "dst"):
        relations = relations.withColumn("k", T.norm_key(F.col(end))).join(gone, "k", "left_anti").drop("k")
    return mentions.join(hit, "ordinal", "left_anti"), relations


def route_entities(mentions: DataFrame, relations: DataFrame, noise: DataFrame, common: DataFrame, target: str = "_global_") -> tuple[DataFrame, DataFrame]:
    """Mentions and relations without those of ``noise`` names, and those of ``common`` names under the target namespace.

    A relation goes if either end is noise, else moves if either end is common. Names meet in any spelling; one that is both is noise.
    """
    noise, common = (x.select(T.norm_key(F.col("name")).alias("k")).distinct() for x in (noise, common))
    common = common.withColumn("moved", F.lit(True))
    kept = mentions.withColumn("k", T.norm_key(F.col("name"))).join(noise, "k", "left_anti").join(common, "k", "left")
    place = lambda moved: F.when(moved, F.lit(target)).otherwise(F.col("namespace"))
    kept = kept.withColumn("namespace", place(F.col("moved"))).select(*mentions.columns)
    columns = relations.columns
    for end in ("src", "dst"):
        relations = relations.withColumn("k", T.norm_key(F.col(end))).join(noise, "k", "left_anti").join(common.withColumnRenamed("moved", f"moved_{end}"), "k", "left").drop("k")
    moved = F.coalesce("moved_src", "moved_dst", F.lit(False))
    return kept, relations.withColumn("namespace", place(moved)).select(*columns)


def resolve_titles(rows: DataFrame, titles: DataFrame, source: str = "source", now_ms: int = 0) -> DataFrame:
    """``rows`` with ``title``: how their source is told. ``titles`` has (id, title), and a namespace if titles are those of a namespace; the first of several by name.

    Sources with a known prefix are told by it; others by their title, or as they are where it is missing or blank.
    """
    on = [c for c in ("namespace",) if c in titles.columns and c in rows.columns]
    one = titles.groupBy(*on, F.col("id").alias(source)).agg(F.min("title").alias("known_title"))
    return rows.join(one, [*on, source], "left").withColumn("title", T.render_source(F.col(source), F.col("known_title"), F.lit(now_ms))).drop("known_title")
