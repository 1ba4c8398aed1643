"""Unified diffs: screening, size limits, secrets, recall queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import text as T

MAX_LINES, MAX_BYTES, MAX_TOTAL = 400, 20_000, 60_000
# Credential patterns by name.
SECRETS = [
    ("OpenAI-style API key (sk-)", r"sk-[A-Za-z0-9]{16,}"),
    ("AWS access key id (AKIA…)", r"AKIA[0-9A-Z]{16}"),
    ("private key block", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    ("GitHub token (ghp_/gho_…)", r"gh[pousr]_[A-Za-z0-9]{20,}"),
    ("Slack token (xox…)", r"xox[baprs]-[A-Za-z0-9-]{10,}"),
]


def split_diffs(diffs: DataFrame) -> DataFrame:
    """(diff_id, block_no, block, path): parts that begin with a line ``diff --git ``."""
    blocks = F.filter(F.split("text", r"(?m)(?=^diff --git )"), lambda b: b != "")
    head = F.substring_index(F.col("block"), "\n", 1)
    path = F.when(F.startswith("block", F.lit("diff --git ")) & F.contains(head, F.lit(" b/")), F.substring_index(head, " b/", -1)).otherwise("")
    return diffs.select("diff_id", F.posexplode(blocks).alias("block_no", "block")).withColumn("path", path)


def screen_diffs(diffs: DataFrame) -> DataFrame:
    """Blocks with their class (secret, generated, binary, normal, preamble) and text, which is a note for the first three."""
    x = split_diffs(diffs)
    binary = F.contains("block", F.lit("\nBinary files ")) | F.contains("block", F.lit("\nGIT binary patch"))
    kind = F.when(F.col("path") == "", "preamble").when(T.skip_secret(F.col("path")), "secret").when(T.skip_generated(F.col("path")), "generated").when(binary, "binary").otherwise("normal")
    head = F.concat(F.lit("diff --git a/"), "path", F.lit(" b/"), "path", F.lit("\n# omitted: "))
    note = (
        F.when(kind == "secret", F.concat(head, F.lit("sensitive file ("), "path", F.lit(")\n")))
        .when(kind == "generated", F.concat(head, F.lit("generated artifact ("), "path", F.lit(")\n")))
        .when(kind == "binary", F.concat(head, F.lit("binary file changed ("), "path", F.lit(")\n")))
    )
    return x.select("diff_id", "block_no", "path", kind.alias("kind"), F.coalesce(note, "block").alias("text"))


def truncate_diffs(blocks: DataFrame, lines: int = MAX_LINES, size: int = MAX_BYTES, total: int = MAX_TOTAL) -> DataFrame:
    """Blocks cut to ``lines`` lines and ``size`` bytes; where a diff's blocks exceed ``total`` bytes, their headers and hunks alone."""
    w = Window.partitionBy("diff_id", "block_no").orderBy("n")
    x = blocks.select("diff_id", "block_no", "path", F.posexplode(F.split("text", "\n")).alias("n", "line"))
    x = x.withColumn("used", F.sum(F.octet_length("line") + 1).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    fits = (F.col("n") < lines) & (F.col("used") <= size)
    rows = lambda cond: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(cond, F.struct("n", "line")))), lambda s: s["line"]), "\n")
    out = x.groupBy("diff_id", "block_no", "path").agg(rows(fits).alias("text"), rows(F.col("line").rlike("^(diff --git |@@ )")).alias("summary"), (~F.bool_and(fits)).alias("truncated"))
    whole = F.sum(F.octet_length("text")).over(Window.partitionBy("diff_id")) > total
    return out.select("diff_id", "block_no", "path", F.when(whole, F.col("summary")).otherwise(F.col("text")).alias("text"), (F.col("truncated") | whole).alias("truncated"))


def scan_secrets(diffs: DataFrame) -> DataFrame:
    """(diff_id, pattern): names of the credential patterns that added lines match."""
    added = diffs.select("diff_id", F.explode(F.split("text", "\n")).alias("line")).where("startswith(line, '+') and not startswith(line, '+++')")
    found = F.array_compact(F.array(*[F.when(F.col("line").rlike(p), F.lit(n)) for n, p in SECRETS]))
    return added.select("diff_id", F.explode(found).alias("pattern")).distinct()


def diff_query(diffs: DataFrame) -> DataFrame:
    """(diff_id, query): distinct changed paths with folder and stem, then hunk contexts, in order."""
    paths = F.regexp_extract_all("text", F.lit(r"(?m)^\+\+\+ b/(.*)$"), F.lit(1))
    parts = F.flatten(F.transform(paths, lambda p: F.array(p, T.package_name(p), T.stem(p))))
    hunks = F.regexp_extract_all("text", F.lit(r"(?m)^@@ .* @@\s*(.+)$"), F.lit(1))
    every = F.array_distinct(F.filter(F.transform(F.concat(parts, hunks), T.trim), lambda s: s != ""))
    return diffs.select("diff_id", F.array_join(every, " ").alias("query"))
