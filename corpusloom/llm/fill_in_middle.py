"""Fill-in-the-middle: a text's lines in an indexable skip list, cut at two ranks and put in another order.

Lane 0 has a link for each unit (line); a link of every further lane skips ``fan`` links of the lane below. Each
link carries two widths, the units and the code points that it passes. A descent starts at the head of the
top lane, takes links while the rank isn't passed, goes down a lane, and ends at the cut with the code points
before it: at most ``fan`` - 1 links in each of log(n) lanes. Lanes and descents are array expressions, so rows stay
in the JVM, and nothing is shuffled.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import table

#: The marks of prefix, suffix and middle, and the pattern of a unit.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
UNIT = r"[^\n]*\n|[^\n]+"


def _link(units: Column, chars: Column) -> Column:
    return F.struct(units.cast("long").alias("units"), chars.cast("long").alias("chars"))


def _passed(links: Column) -> Column:
    """One link over all of ``links``."""
    return F.aggregate(links, _link(F.lit(0), F.lit(0)), lambda a, b: _link(a["units"] + b["units"], a["chars"] + b["chars"]))


def skip_list(units: Column, fan: int = 16) -> Column:
    """Lanes of an array of texts, the lowest first; the top one has ``fan`` links at most, and no units make one empty lane."""
    ground = F.transform(units, lambda u: _link(F.lit(1), F.length(u)))

    def skipping(lane: Column) -> Column:
        heads = F.sequence(F.lit(0), F.floor((F.size(lane) - 1) / fan).cast("int"))
        return F.transform(heads, lambda h: _passed(F.slice(lane, h * fan + 1, F.lit(fan))))

    # floating-point logarithms may come out a lane too many, which does no harm
    above = F.when(F.size(units) > fan, F.ceil(F.log(F.size(units).cast("double")) / math.log(fan) - 1 + 1e-9)).otherwise(0).cast("int")
    steps = F.filter(F.sequence(F.lit(0), above), lambda k: k > 0)
    return F.aggregate(steps, F.array(ground), lambda lanes, _: F.concat(lanes, F.array(skipping(F.element_at(lanes, -1)))))


def chars_before(lanes: Column, rank: Column, fan: int = 16) -> Column:
    """Code points before the unit of this rank (0 to n), by descent."""
    def place(units: Column, chars: Column, at: Column, going: Column) -> Column:
        return F.struct(units.cast("long").alias("units"), chars.cast("long").alias("chars"), at.cast("int").alias("at"), going.alias("going"))

    def take(s: Column, link: Column) -> Column:
        on = place(s["units"] + link["units"], s["chars"] + link["chars"], s["at"] + 1, F.lit(True))
        # the last link of a lane may be shorter than one that passed the rank, so the first to pass it ends the lane
        return F.when(s["going"] & (s["units"] + link["units"] <= rank), on).otherwise(place(s["units"], s["chars"], s["at"], F.lit(False)))

    def down(s: Column, lane: Column) -> Column:
        first = s["at"] * fan
        return F.aggregate(F.slice(lane, first + 1, F.lit(fan)), place(s["units"], s["chars"], first, F.lit(True)), take)

    start = place(F.lit(0), F.lit(0), F.lit(0), F.lit(True))
    return F.aggregate(F.reverse(lanes), start, down)["chars"]


def _draw(key: Column, k: int) -> Column:
    """The k-th 8-digit group of a hexadecimal digest, as a number."""
    return F.conv(F.substring(key, 8 * k + 1, 8), 16, 10).cast("long")


def restore(output: Column, form: Column) -> Column:
    """The text that ``output`` was made from, read from its marks alone."""
    second = F.when(form == "psm", F.position(F.lit(SUFFIX), output, F.lit(len(PREFIX) + 1))).otherwise(F.position(F.lit(PREFIX), output, F.lit(len(SUFFIX) + 1)))
    third = F.position(F.lit(MIDDLE), output, second + len(PREFIX))
    a = F.substring(output, F.lit(len(PREFIX) + 1), second - len(PREFIX) - 1)
    b = F.substring(output, second + len(PREFIX), third - second - len(PREFIX))
    c = F.substring(output, third + len(MIDDLE), F.length(output))
    return F.when(form == "plain", output).when(form == "psm", F.concat(a, c, b)).otherwise(F.concat(b, c, a))


def fill_in_middle(docs: DataFrame, seed: int = 7, rate: int = 100, spm: int = 50, fan: int = 16) -> DataFrame:
    """``docs`` (doc_id, text) with n, form, prefix_chars, middle_chars and output.

    Cuts fall between lines, at ranks drawn from the digest of seed and doc_id; ``rate`` percent of the texts are
    transformed, ``spm`` percent of these with the suffix first. An empty or null text, and one that holds a mark,
    is plain: it stays as it is (null becomes empty), with null for both counts. Rows without doc_id draw from the seed alone;
    repeated rows come out alike; further columns are ignored; an empty table gives none. A text is one row, of any length.
    """
    text = F.coalesce("text", F.lit(""))
    d = docs.select("doc_id", text.alias("text"), F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256).alias("key"))
    d = d.withColumn("units", F.regexp_extract_all("text", F.lit(UNIT), F.lit(0))).withColumn("n", F.size("units").cast("long"))
    marked = F.contains("text", F.lit(PREFIX)) | F.contains("text", F.lit(SUFFIX)) | F.contains("text", F.lit(MIDDLE))
    plain = (F.col("text") == "") | marked | (_draw(F.col("key"), 2) % 100 >= rate)
    d = d.withColumn("form", F.when(plain, "plain").when(_draw(F.col("key"), 3) % 100 < spm, "spm").otherwise("psm"))
    one, two = (_draw(F.col("key"), k) % (F.col("n") + 1) for k in (0, 1))
    d = d.select("doc_id", "text", "n", "form", F.least(one, two).alias("low"), F.greatest(one, two).alias("high"), F.when(F.col("form") != "plain", skip_list(F.col("units"), fan)).alias("lanes"))
    d = d.select("doc_id", "text", "n", "form", chars_before(F.col("lanes"), F.col("low"), fan).alias("prefix_chars"), chars_before(F.col("lanes"), F.col("high"), fan).alias("ends"))
    at = F.col("prefix_chars").cast("int")
    d = d.select(
        "*", (F.col("ends") - F.col("prefix_chars")).alias("middle_chars"), F.substring("text", F.lit(1), at).alias("prefix"),
        F.substring("text", at + 1, (F.col("ends") - F.col("prefix_chars")).cast("int")).alias("middle"), F.substring("text", F.col("ends").cast("int") + 1, F.length("text")).alias("suffix"),
    )
    psm = F.concat(F.lit(PREFIX), "prefix", F.lit(SUFFIX), "suffix", F.lit(MIDDLE), "middle")
    spm_first = F.concat(F.lit(SUFFIX), "suffix", F.lit(PREFIX), "prefix", F.lit(MIDDLE), "middle")
    output = F.when(F.col("form") == "plain", F.col("text")).when(F.col("form") == "psm", psm).otherwise(spm_first)
    return d.select("doc_id", "n", "form", "prefix_chars", "middle_chars", output.alias("output"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = fill_in_middle(table(spark, sf_dir, "documents"))
    return d.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restore(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )


_NUMBER = "('0x' || substr(k, {0}, 8))::BIGINT"
OP13_SQL = f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS k, regexp_extract_all(coalesce(text, ''), '[^\\n]*\\n|[^\\n]+') AS u FROM documents),
    h AS (SELECT doc_id, t, u, len(u) AS n, {_NUMBER.format(1)} % (len(u) + 1) AS one, {_NUMBER.format(9)} % (len(u) + 1) AS two, {_NUMBER.format(25)} % 100 < 50 AS spm FROM d),
    p AS (SELECT doc_id, t, n, CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') THEN 'plain' WHEN spm THEN 'spm' ELSE 'psm' END AS form,
      coalesce(array_to_string(u[1:least(one, two)], ''), '') AS a, coalesce(array_to_string(u[least(one, two) + 1:greatest(one, two)], ''), '') AS b, coalesce(array_to_string(u[greatest(one, two) + 1:n], ''), '') AS c FROM h)
    SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(a) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(b) END AS middle_chars,
      sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || a || '<S>' || c || '<M>' || b ELSE '<S>' || c || '<P>' || a || '<M>' || b END) AS output_sha256, sha256(t) AS restored_sha256 FROM p"""
