"""Readers of transcripts, notes, source files and records, and their writers."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators.curation import Exclusions

_BLOCKS = "array<struct<type string, text string>>"


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines below ``path`` with their file and ``line_no``, which grows within a file: the place of the line's block in the file, then its place there."""
    x = spark.read.option("recursiveFileLookup", "true").text(path)
    # blocks of a file are numbered by where they begin; within one, ids grow in the order of reading
    within = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    line_no = F.col("_metadata.file_block_start") * F.lit(1 << 20) + within
    return x.select(F.col("_metadata.file_path").alias("file"), line_no.alias("line_no"), "value")


def _session(file: Column) -> Column:
    return F.regexp_extract(file, r"([^/]+?)(?:\.jsonl|\.txt)?$", 1)


def _content(raw: Column, kinds: list[str], end: str = "") -> Column:
    """A JSON string's text, or the texts of an array's blocks of the kinds."""
    blocks = F.filter(F.from_json(raw, _BLOCKS), lambda b: b["type"].isin(kinds))
    joined = F.array_join(F.transform(blocks, lambda b: F.concat(b["text"], F.lit(end))), "" if end else "\n")
    plain = F.from_json(F.concat(F.lit('{"v":'), raw, F.lit("}")), "v string")["v"]
    return F.when(F.startswith(F.ltrim(raw), F.lit("[")), joined).otherwise(plain)


def read_transcripts_claude(spark: SparkSession, path: str) -> DataFrame:
    """(session_id, seq, role, text) of user and assistant lines; broken lines and blank texts drop out."""
    v = F.col("value")
    x = _lines(spark, path).select(
        "file", "line_no", F.get_json_object(v, "$.type").alias("role"), F.get_json_object(v, "$.sessionId").alias("sid"), F.get_json_object(v, "$.seq").try_cast("long").alias("seq"),
        F.get_json_object(v, "$.message.content").alias("content"),
    ).where("role in ('user', 'assistant')")
    blocks = F.from_json("content", _BLOCKS)
    joined = F.array_join(F.transform(F.filter(blocks, lambda b: b["type"] == "text"), lambda b: b["text"]), "\n")
    text = F.when(F.col("content").rlike(r'^\s*\[\s*(\{|\])'), joined).otherwise(F.col("content"))
    out = x.select(F.coalesce("sid", _session(F.col("file"))).alias("session_id"), F.coalesce("seq", "line_no").alias("seq"), "role", text.alias("text"))
    return out.where(T.trim(F.col("text")) != "")


def read_transcripts_codex(spark: SparkSession, *paths: str) -> DataFrame:
    """(session_id, seq, role, text) of response items; each input or output text block ends with a line break."""
    out = None
    for path in paths:
        v = F.col("value")
        x = _lines(spark, path).where(F.get_json_object(v, "$.type") == "response_item").select(
            "file", "line_no", F.get_json_object(v, "$.payload.role").alias("role"), F.get_json_object(v, "$.payload.content").alias("content"), F.get_json_object(v, "$.payload.session").alias("sid"), F.get_json_object(v, "$.payload.seq").try_cast("long").alias("seq"),
        )
        text = _content(F.col("content"), ["input_text", "output_text"], "\n")
        x = x.where("role in ('user', 'assistant')").select(F.concat(F.lit("codex:"), F.coalesce("sid", _session(F.col("file")))).alias("session_id"), F.coalesce("seq", "line_no").alias("seq"), "role", text.alias("text"))
        out = x if out is None else out.unionByName(x)
    return out.where(T.trim(F.col("text")) != "")


def strip_wrappers(text: Column) -> Column:
    """What follows system reminders and environment context, inside the user query if it is marked."""
    text = F.substring_index(F.substring_index(text, "</system-reminder>", -1), "</environment_context>", -1)
    return T.trim(F.when(F.contains(text, F.lit("<user_query>")), T.extract_tag(text, "user_query")).otherwise(text))


def read_transcripts_buddy(spark: SparkSession, path: str, agent: str = "codebuddy") -> DataFrame:
    """(session_id, seq, role, text) of message lines with either form of content, without wrappers."""
    v = F.col("value")
    x = _lines(spark, path).where(F.get_json_object(v, "$.type") == "message").select("file", "line_no", F.get_json_object(v, "$.role").alias("role"), F.get_json_object(v, "$.content").alias("content"), F.get_json_object(v, "$.sessionId").alias("sid"), F.get_json_object(v, "$.seq").try_cast("long").alias("seq"))
    blocks = F.from_json("content", _BLOCKS)
    joined = F.array_join(F.transform(F.filter(blocks, lambda b: b["text"].isNotNull()), lambda b: b["text"]), "\n")
    text = strip_wrappers(F.when(F.col("content").rlike(r"^\s*\[\s*(\{|\])"), joined).otherwise(F.col("content")))
    out = x.select(F.concat(F.lit(f"{agent}:"), F.coalesce("sid", _session(F.col("file")))).alias("session_id"), F.coalesce("seq", "line_no").alias("seq"), "role", text.alias("text"))
    return out.where("text <> ''")


def unify_messages(*parts: DataFrame) -> DataFrame:
    """All agents' messages as one table with the agent's name."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out.withColumn("agent", T.agent_of(F.col("session_id")))


def _files(spark: SparkSession, path: str) -> DataFrame:
    """(path, size, mtime, content) of all files below ``path``; Spark leaves out files of no bytes."""
    x = spark.read.option("recursiveFileLookup", "true").format("binaryFile").load(path)
    return x.select("path", F.col("length").alias("size"), F.unix_millis("modificationTime").alias("mtime"), F.decode("content", "UTF-8").alias("content"))


def _is_hidden(path: Column, root: str) -> Column:
    """Whether a folder between ``root`` and the file begins with a dot."""
    below = F.substring_index(path, re.sub(r"^[A-Za-z][A-Za-z0-9+.\-]*:/*", "/", root.rstrip("/")), -1)
    return below.rlike(r"(^|/)\.[^/]+/")


def read_notes(spark: SparkSession, path: str, names: str = r"(?i)\.md$") -> DataFrame:
    """(path, mtime, content) of the files below ``path`` whose path matches ``names`` (Markdown, in any case), without hidden folders."""
    x = _files(spark, path)
    return x.where(F.col("path").rlike(names) & ~_is_hidden(F.col("path"), path)).select("path", "mtime", "content")


def source_files(files: DataFrame, most: int = 262_144) -> DataFrame:
    """Of files (path, size, content): source files by extension, none that is generated, secret or in a skipped folder; larger ones keep their row alone."""
    path = F.col("path")
    folders = F.slice(F.split(path, "/"), F.lit(1), F.greatest(F.size(F.split(path, "/")) - 1, F.lit(0)))
    skipped = F.arrays_overlap(folders, F.array(*[F.lit(x) for x in T.SKIPPED_FOLDERS]))
    kept = files.where(F.lower(T.extension(path)).isin(T.SOURCE_EXTENSIONS) & ~skipped & ~T.skip_generated(path) & ~T.skip_secret(path))
    return kept.withColumn("content", F.when(F.col("size") <= most, F.col("content")).otherwise(""))


def read_source_files(spark: SparkSession, path: str, most: int = 262_144, named: Callable[[Column], Column] = lambda p: p) -> DataFrame:
    """(path, size, content) of the source files below ``path``; ``named`` gives a file's path in its repository."""
    return source_files(_files(spark, path).select(named(F.col("path")).alias("path"), "size", "content"), most)


def read_memory_notes(spark: SparkSession, common: str, projects: str, names: str = r"/memory/[^/]+\.md$") -> DataFrame:
    """(scope, path, content) of the instructions for all projects, the file ``common`` (scope ``instructions``), and of every project's
    notes (scope ``memory``), files below ``projects`` whose path matches ``names``."""
    one = _files(spark, common).select(F.lit("instructions").alias("scope"), "path", "content")
    notes = _files(spark, projects).where(F.col("path").rlike(names)).select(F.lit("memory").alias("scope"), "path", "content")
    return one.unionByName(notes)


@dataclass(frozen=True)
class Archive:
    """The tables of an archive."""

    conversations: DataFrame
    messages: DataFrame
    tasks: DataFrame
    runs: DataFrame


def read_archive(spark: SparkSession, path: str) -> Archive:
    """The archive below ``path``: a Parquet table for each field of ``Archive``."""
    return Archive(*[spark.read.parquet(f"{path}/{f.name}") for f in fields(Archive)])


def write_archive(archive: Archive, path: str) -> None:
    for f in fields(Archive):
        getattr(archive, f.name).write.parquet(f"{path}/{f.name}")


def read_exclusions(spark: SparkSession, path: str) -> Exclusions:
    """The newest version below ``path``."""
    newest = spark.read.schema("version long").parquet(f"{path}/versions").agg(F.max("version")).first()[0]
    return Exclusions(*[spark.read.parquet(f"{path}/{kind}/version={newest}") for kind in ("facts", "sessions")])


def write_exclusions(known: Exclusions, path: str, version: int) -> None:
    """``known`` as a version of its own below ``path``; readers see it once both tables are there, and older ones stay readable."""
    known.facts.select("namespace", "obs_key").distinct().write.mode("overwrite").parquet(f"{path}/facts/version={version}")
    known.sessions.select("namespace", "session_id").distinct().write.mode("overwrite").parquet(f"{path}/sessions/version={version}")
    known.facts.sparkSession.range(version, version + 1).select(F.col("id").alias("version")).write.mode("append").parquet(f"{path}/versions")


def read_records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Per-source knowledge records (JSON lines) with their file's name as merge order; broken ones are left out."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path).withColumn("file", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1))


def record_file_name(record_id: Column) -> Column:
    return F.regexp_replace(record_id, r'[:<>|"?*\\]', "_")


def append_records(new: DataFrame, path: str, version: int) -> None:
    """Upsert without rewriting what is there: ``new`` as one version below ``path``, which readers take before older ones; writing a version again replaces it."""
    new.write.mode("overwrite").parquet(f"{path}/version={version}")


def latest_records(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """Each key's record of the newest version below ``path``."""
    rows = spark.read.option("basePath", path).parquet(path)
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "version").alias("r")).select(*keys, "r.*").drop("version")


def write_graph(entities: DataFrame, path: str, now_ms: int) -> None:
    entities.withColumn("updated_at", F.lit(now_ms)).write.mode("overwrite").partitionBy("namespace").option("partitionOverwriteMode", "dynamic").parquet(path)


def index_messages(messages: DataFrame, indexed: DataFrame) -> DataFrame:
    """Messages of sessions that aren't indexed yet."""
    return messages.join(indexed.select("session_id").distinct(), "session_id", "left_anti")
