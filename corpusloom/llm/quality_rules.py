"""Quality rules by distribution divergence: documents against their language's characters and common words.

Two histograms of each document, of character classes and of the language's common words with one bin for all others, are
compared with those of the whole language by Jensen-Shannon distance (base 2, from 0 to 1). A language's common
words are those that make up a given share of its words, so at most 1 / share of them. They are counted exactly in two passes: the first
counts words by hash bucket, the second counts the words of those buckets that reach the share as a whole. What is
shuffled is buckets and few words, and what is broadcast is bounded by the shares, however large the vocabulary.
"""

from __future__ import annotations

import math
import unicodedata
import zlib
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import blocks, materialize, table

#: White space between words, and the characters that count as symbols.
SPACE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
#: Character classes: white space, lower case, upper case, other letters and marks, numbers, punctuation, symbols, all else.
CLASSES = {"Ll": 1, "Lu": 2, "Lt": 2, "Lm": 3, "Lo": 3, "M": 3, "N": 4, "P": 5, "S": 6}
N_CLASSES = 8


@dataclass(frozen=True)
class Rules:
    """Limits of the rules; distances are judged only from the minimum lengths on."""

    least_words: int = 50
    most_repeated: int = 50  # percent of words in repeated windows
    common_share: float = 1 / 500  # of a language's words: a common word
    language_share: float = 1 / 1000  # of all words: a language with a reference of its own
    class_distance: float = 0.27
    class_chars: int = 200
    word_distance: float = 0.28
    word_count: int = 50

    def word_limit(self, n: int, bins: int) -> float:
        """The limit for ``n`` words: the distance that so many words of the reference itself come to, and ``word_distance`` on top."""
        return math.sqrt(bins / (8 * math.log(2) * n) + self.word_distance**2)


@cache
def _class_table() -> np.ndarray:
    kinds = [unicodedata.category(chr(c)) for c in range(0x110000)]
    out = np.asarray([CLASSES.get(k, CLASSES.get(k[0], 7)) for k in kinds], dtype=np.uint8)
    out[[ord(c) for c in SPACE]] = 0
    return out


def classes_of(text: str) -> np.ndarray:
    """How many characters of each class."""
    return np.bincount(_class_table()[np.frombuffer(text.encode("utf-32-le"), dtype="<u4")], minlength=N_CLASSES)


def split_words(text: str) -> list[str]:
    """Words between ASCII white space."""
    return [w.decode() for w in text.encode().split()]


def distance(p: np.ndarray, q: np.ndarray) -> float:
    """Jensen-Shannon distance of two histograms."""
    p, q = p / p.sum(), q / q.sum()
    m = (p + q) / 2
    half = [float((x[x > 0] * np.log2(x[x > 0] / m[x > 0])).sum()) for x in (p, q)]
    return math.sqrt(max(0.0, sum(half) / 2))


def _bucket(word: str) -> int:
    return zlib.crc32(word.encode()) & 0x3FFF


def _counted(docs: DataFrame, schema: str, keys: Callable[[str, Counter], Counter], classes: bool = False, limit: int = 1_000_000) -> DataFrame:
    """(lang, key, n) summed over all texts; a task holds at most about ``limit`` different words. Classes have the keys -1 to -8."""
    kind = pa.int64() if "long" in schema else pa.string()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, chars, held = defaultdict(Counter), defaultdict(lambda: np.zeros(N_CLASSES, dtype=np.int64)), 0

        def told() -> pa.RecordBatch:
            rows = [(lang, k, n) for lang, of in words.items() for k, n in keys(lang, of).items()]
            rows += [(lang, -1 - k, n) for lang, h in chars.items() for k, n in enumerate(h.tolist()) if n]
            cols = list(zip(*rows, strict=True)) or [[]] * 3
            return pa.RecordBatch.from_arrays([pa.array(cols[0], type=pa.string()), pa.array(cols[1], type=kind), pa.array(cols[2], type=pa.int64())], names=["lang", "key", "n"])

        for batch, texts in blocks(batches, "text", 4 << 20):
            for lang, raw in zip(batch.column(0).to_pylist(), texts, strict=True):
                text = raw.decode()
                held -= len(words[lang])
                words[lang].update(split_words(text.lower()))
                held += len(words[lang])
                if classes:
                    chars[lang] += classes_of(text)
            if held > limit:
                yield told()
                words.clear()
                chars.clear()
                held = 0
        yield told()

    counted = docs.select(F.coalesce("lang", F.lit("")).alias("lang"), "text").mapInArrow(count, f"lang string, key {schema}, n long")
    return counted.groupBy("lang", "key").agg(F.sum("n").alias("n"))


def references(docs: DataFrame, rules: Rules = Rules()) -> dict[str, tuple[np.ndarray, dict[str, int], np.ndarray]]:
    """Of each language with its share of all words: class counts, the common words' bins, and counts of the bins and of all other words.

    Held by the driver and every task: at most 1 / ``language_share`` languages with 1 / ``common_share`` words each.
    """

    def by_bucket(_: str, words: Counter) -> Counter:
        out: Counter = Counter()
        for w, n in words.items():
            out[_bucket(w)] += n
        return out

    told = materialize(_counted(docs, "long", by_bucket, classes=True), "buckets")
    own = F.sum(F.when(F.col("key") >= 0, F.col("n")).otherwise(0))
    sizes = told.groupBy("lang").agg(own.alias("words"))
    told = told.join(sizes.join(sizes.agg(F.sum("words").alias("every")), F.col("words") >= F.col("every") * rules.language_share), "lang")
    told = told.where((F.col("key") < 0) | (F.col("n") >= F.col("words") * rules.common_share)).select("lang", "key", "n", "words").collect()
    heavy, chars, total = defaultdict(set), defaultdict(lambda: np.zeros(N_CLASSES)), {}
    for lang, key, n, size in told:
        total[lang] = size
        if key < 0:
            chars[lang][-1 - key] = n
        else:
            heavy[lang].add(key)
    heavy = dict(heavy)

    def of_heavy(lang: str, words: Counter) -> Counter:
        kept = heavy.get(lang, ())
        return Counter({w: n for w, n in words.items() if _bucket(w) in kept})

    counts = _counted(docs, "string", of_heavy)
    floors = F.create_map(*[x for lang, size in total.items() for x in (F.lit(lang), F.lit(size * rules.common_share))]) if total else None
    common = defaultdict(dict)
    if total:
        for lang, word, n in counts.where(F.col("n") >= F.try_element_at(floors, F.col("lang"))).orderBy("lang", "key").collect():
            common[lang][word] = n
    out = {}
    for lang, size in total.items():
        bins = {w: k for k, w in enumerate(common[lang])}
        counted = np.asarray([*common[lang].values(), size - sum(common[lang].values())], dtype=np.float64)
        out[lang] = (chars[lang], bins, counted)
    return out


def repeated_words(words: list[str]) -> int:
    """Words in windows of three that occur twice or more."""
    windows = list(zip(words, words[1:], words[2:]))
    seen: set = set()
    twice = {w for w in windows if w in seen or seen.add(w)}
    if not twice:
        return 0
    inside = np.zeros(len(words) + 1, dtype=np.int64)
    at = np.fromiter((w in twice for w in windows), dtype=bool).nonzero()[0]
    np.add.at(inside, at, 1)
    np.add.at(inside, at + 3 if len(words) >= 3 else at, -1)
    return int((np.cumsum(inside)[: len(words)] > 0).sum())


def judge(docs: DataFrame, known: dict[str, tuple[np.ndarray, dict[str, int], np.ndarray]], rules: Rules = Rules()) -> DataFrame:
    """``docs`` (doc_id, text, lang) with the base counts, base_failed, class_distance, word_distance and kept.

    A distance is null, and judges nothing, below its minimum length and where the language has no reference. A null or empty text has no words
    and fails the base. A null lang is a language of its own. Rows stand for themselves, whatever their doc_id; further
    columns are ignored; an empty table gives no rows.
    """

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in blocks(batches, "text", 4 << 20):
            out = []
            for lang, raw in zip(batch.column(1).to_pylist(), texts, strict=True):
                text = raw.decode()
                words = split_words(text)
                classes = classes_of(text)
                n, chars, lines = len(words), len(text) - int(classes[0]), [x for x in raw.split(b"\n") if x.strip()]
                repeats = repeated_words(words)
                failed = n < rules.least_words or 100 * repeats > rules.most_repeated * n
                by_class = by_word = None
                kept = not failed
                if lang in known:
                    ref_classes, bins, ref_words = known[lang]
                    if len(text) >= rules.class_chars:
                        by_class = distance(classes, ref_classes)
                        kept &= by_class <= rules.class_distance
                    if n >= max(1, rules.word_count):
                        h = np.bincount([bins.get(w, len(bins)) for w in split_words(text.lower())], minlength=len(bins) + 1)
                        by_word = distance(h, ref_words)
                        kept &= by_word <= rules.word_limit(n, len(bins))
                out.append((n, chars, sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeats, failed, by_class, by_word, kept))
            cols = list(zip(*out, strict=True))
            kinds = [pa.int64()] * 5 + [pa.bool_()] + [pa.float64()] * 2 + [pa.bool_()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, type=k) for c, k in zip(cols, kinds, strict=True)]], names=["doc_id", *names])

    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "class_distance", "word_distance", "kept"]
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, " + ", ".join(f"{x} long" for x in names[:5]) + ", base_failed boolean, class_distance double, word_distance double, kept boolean"
    return docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("lang"), "text").mapInArrow(rate, schema)


def quality_rules(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """``judge`` by the references of the same table."""
    return judge(docs, references(docs, rules), rules)


def op12_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = quality_rules(table(spark, sf_dir, "documents"))
    return d.withColumns({c: F.round(c, 6) for c in ("class_distance", "word_distance")})


_R = Rules()
_W = r"[^\x20\x09-\x0D]+"
#: What lies outside each of the first seven classes; the rest of a text is the last class.
_OUTSIDE = [r"[^\x09-\x0D\x20]", r"[^\p{Ll}]", r"[^\p{Lu}\p{Lt}]", r"[^\p{Lm}\p{Lo}\p{M}]", r"[^\p{N}]", r"[^\p{P}]", r"[^\p{S}]", r"[\x09-\x0D\x20\p{L}\p{M}\p{N}\p{P}\p{S}]"]
_CLASS_SQL = "[" + ", ".join(f"'{c}'" for c in _OUTSIDE) + "]"
#: Jensen-Shannon distance over rows (.., p, q) of two shares
_JS = "sqrt(greatest(0, sum(CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) ELSE 0 END) / 2))"
OP12_SQL = f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(lang, '') AS lang, coalesce(text, '') AS t FROM documents),
    x AS (SELECT *, regexp_extract_all(t, '{_W}') AS w, list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '{_W}')) AS l FROM d),
    g AS (SELECT r, i, list_transform([0, 1, 2], lambda k: w[i + k]) AS g FROM x, LATERAL (SELECT unnest(range(1, len(w) - 1)) AS i)),
    tw AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM g) WHERE n > 1),
    rep AS (SELECT r, count(DISTINCT i + k) AS n_repeat_words FROM tw, (SELECT unnest([0, 1, 2]) AS k) GROUP BY 1),
    base AS (SELECT r, doc_id, lang, t, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words FROM x LEFT JOIN rep USING (r)),
    hc AS (SELECT r, lang, c, length(regexp_replace(t, c, '', 'g')) AS n FROM d, (SELECT unnest({_CLASS_SQL}) AS c)),
    wd AS (SELECT r, lang, unnest(regexp_extract_all(lower(t), '{_W}')) AS word FROM d),
    ln AS (SELECT lang, count(*) AS words FROM wd GROUP BY 1),
    known AS (SELECT lang, words FROM ln WHERE words >= (SELECT sum(words) FROM ln) * {_R.language_share}),
    rc AS (SELECT lang, c, sum(n) / sum(sum(n)) OVER (PARTITION BY lang) AS q FROM hc JOIN known USING (lang) GROUP BY 1, 2),
    jc AS (SELECT r, {_JS} AS class_distance FROM (SELECT r, hc.n / length(t)::DOUBLE AS p, q FROM hc JOIN d USING (r) JOIN rc ON rc.lang = hc.lang AND rc.c = hc.c WHERE length(t) >= {_R.class_chars}) GROUP BY 1),
    cw AS (SELECT lang, word, count(*) AS n FROM wd GROUP BY 1, 2),
    common AS (SELECT lang, word, n / words::DOUBLE AS q FROM cw JOIN known USING (lang) WHERE n >= words * {_R.common_share}),
    bins AS (SELECT lang, word, q FROM common UNION ALL SELECT lang, NULL, 1 - coalesce((SELECT sum(q) FROM common c WHERE c.lang = k.lang), 0) FROM known k),
    hw AS (SELECT wd.r, c.word, count(*) AS n FROM wd LEFT JOIN common c ON c.lang = wd.lang AND c.word = wd.word GROUP BY 1, 2),
    jw AS (SELECT r, {_JS} AS word_distance, count(*) - 1 AS bins FROM (SELECT base.r, bins.q, coalesce(hw.n, 0) / base.n_words::DOUBLE AS p FROM base JOIN bins ON bins.lang = base.lang LEFT JOIN hw ON hw.r = base.r AND hw.word IS NOT DISTINCT FROM bins.word WHERE n_words >= {_R.word_count}) GROUP BY 1),
    f AS (SELECT *, n_words < {_R.least_words} OR 100 * n_repeat_words > {_R.most_repeated} * n_words AS base_failed FROM base LEFT JOIN jc USING (r) LEFT JOIN jw USING (r))
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, round(class_distance, 6) AS class_distance, round(word_distance, 6) AS word_distance,
      NOT base_failed AND coalesce(class_distance <= {_R.class_distance}, TRUE) AND coalesce(word_distance <= sqrt(bins / (8 * ln(2) * n_words) + {_R.word_distance} * {_R.word_distance}), TRUE) AS kept FROM f"""
