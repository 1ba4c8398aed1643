"""Media columns: interleaved sequences of text and media references.

``parse`` turns HTML into ordered items (text, or a reference with its caption), ``media_table`` encodes payloads
and files them by digest, ``resolve`` joins references and payloads by digest, keeping every item's
position. A payload is stored as a grey image of 192 samples a row (binary PGM: a text header and the
samples), written once, and read back from there before features are computed.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import blocks, materialize, table

WIDTH = 192
ITEM = pa.struct([("position", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("ref", pa.string()), ("caption", pa.string())])
_MEDIA = {"img": "src", "video": "src", "audio": "src", "source": "src", "embed": "src", "object": "data"}
_SKIP = {"script", "style", "template", "noscript"}
_BLOCK = {"p", "div", "br", "li", "ul", "ol", "h1", "h2", "h3", "h4", "h5", "h6", "article", "section", "nav", "header", "footer", "table", "tr", "td", "th", "figure", "figcaption", "title", "body", "main", "aside", "blockquote", "pre"}


class _Items(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.items: list[dict] = []
        self._text: list[str] = []
        self._skip = 0
        self._figure: int | None = None  # the first item of the figure that is open
        self._caption: list[str] | None = None

    def flush(self) -> None:
        text = re.sub(r"\s+", " ", "".join(self._text)).strip()
        self._text = []
        if text:
            self.items.append({"kind": "text", "text": text, "ref": None, "caption": None})

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in _SKIP:
            self._skip += 1
        if tag in _BLOCK or tag in _MEDIA:
            self.flush() if self._caption is None else self._caption.append(" ")
        if tag == "figure":
            self._figure = len(self.items)
        if tag == "figcaption":
            self._caption = []
        ref = dict(attrs).get(_MEDIA.get(tag, ""))
        if ref:
            self.items.append({"kind": "media", "text": None, "ref": ref.strip(), "caption": dict(attrs).get("alt") or None})

    def handle_endtag(self, tag: str) -> None:
        if tag in _SKIP:
            self._skip = max(0, self._skip - 1)
        if tag == "figcaption" and self._caption is not None:
            caption = re.sub(r"\s+", " ", "".join(self._caption)).strip() or None
            self._caption = None
            for item in self.items[self._figure if self._figure is not None else len(self.items) :]:
                if item["kind"] == "media" and caption:
                    item["caption"] = caption
        elif tag in _BLOCK:
            self.flush() if self._caption is None else self._caption.append(" ")
        if tag == "figure":
            self._figure = None

    def handle_data(self, data: str) -> None:
        if not self._skip:
            (self._text if self._caption is None else self._caption).append(data)


def html_items(html: str) -> list[dict]:
    """The ordered items of one page; a figure's caption belongs to the media of that figure that stand before it."""
    parser = _Items()
    parser.feed(html)
    parser.close()
    parser.flush()
    return [{"position": i} | x for i, x in enumerate(parser.items)]


def parse(pages: DataFrame, key: str, html: str = "html", kinds: tuple[str, ...] = ("text", "media")) -> DataFrame:
    """(key, position, kind, text, ref, caption), one row per item of each page and of these ``kinds``; positions count all items.

    Null and empty pages have no items; very long ones are parsed whole; repeated pages repeat; other columns are ignored.
    """
    page = pages.select(F.col(key).alias("page"), F.col(html).alias("html"))

    def items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in blocks(batches, "html", 4 << 20):
            found = [[x for x in html_items(t.decode()) if x["kind"] in kinds] for t in texts]
            owner = np.repeat(np.arange(len(found)), [len(x) for x in found])
            flat = pa.array([x for xs in found for x in xs], type=ITEM)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner)), *flat.flatten()], names=["page", *[f.name for f in ITEM]])

    kind = page.schema["page"].dataType.simpleString()
    return page.mapInArrow(items, f"page {kind}, position int, kind string, text string, ref string, caption string").withColumnRenamed("page", key)


def encode_image(payload: bytes) -> bytes:
    """A grey image whose samples are the payload's bytes; its length must be a positive multiple of WIDTH."""
    if not payload or len(payload) % WIDTH:
        raise ValueError(f"{len(payload)} bytes are no rows of {WIDTH} samples")
    return b"P5\n%d %d\n255\n" % (WIDTH, len(payload) // WIDTH) + payload


def decode_image(media: bytes) -> bytes:
    """The samples of a binary PGM of 8 bits."""
    head = re.match(rb"P5\s+(?:#[^\n]*\n\s*)*(\d+)\s+(\d+)\s+255\s", media)
    if not head:
        raise ValueError("no 8-bit binary PGM")
    samples = media[head.end() :]
    if len(samples) != int(head[1]) * int(head[2]):
        raise ValueError("the samples don't fill the image")
    return samples


def pad(text: bytes) -> bytes:
    """``text`` with spaces up to a positive multiple of WIDTH."""
    return text + b" " * (max(1, -(-len(text) // WIDTH)) * WIDTH - len(text))


def features(samples: bytes) -> str:
    """Rows, mean, deviation and a histogram of eight levels (in thousandths) of an image."""
    x = np.frombuffer(samples, dtype=np.uint8)
    levels = np.bincount(x >> 5, minlength=8) * 1000 // len(x)
    return f"{len(x) // WIDTH} rows; mean {x.mean():.3f}; deviation {x.std():.3f}; levels {' '.join(map(str, levels.tolist()))}"


def image_of(text: Column) -> Column:
    """What ``encode_image(pad(text))`` gives, as an expression: header and samples."""
    rows = F.greatest(F.lit(1), F.ceil(F.octet_length(text) / WIDTH)).cast("int")
    samples = F.concat(text.cast("binary"), F.repeat(F.lit(" "), rows * WIDTH - F.octet_length(text)).cast("binary"))
    return F.concat(F.concat(F.lit(f"P5\n{WIDTH} "), rows.cast("string"), F.lit("\n255\n")).cast("binary"), samples)


def store(docs: DataFrame) -> DataFrame:
    """(digest, media): each document's whole text as an image under its SHA-256, written below the shared folder and read from there.

    Copies in one batch of a task are written once.
    """

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[str] = set()
        for batch in batches:
            new = []
            for i, digest in enumerate(batch.column(0).to_pylist()):
                if digest not in seen:
                    new.append(i)
                    seen.add(digest)
            if len(seen) > 200_000:
                seen.clear()
            yield batch.take(pa.array(new, type=pa.int64()))

    media = docs.select(image_of(F.coalesce("text", F.lit(""))).alias("media")).select(F.sha2("media", 256).alias("digest"), "media")
    return materialize(media.mapInArrow(first, "digest string, media binary"), "media")


def media_table(stored: DataFrame) -> DataFrame:
    """One row per digest of ``stored`` (digest, media): payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature.

    Each image is read back where it lies; only the small columns move, summed up before they do, and are written, so
    that Spark can split hot digests where they are joined.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: dict[str, tuple] = {}
            for digest, media in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if digest not in seen:
                    raw = media.as_py()
                    samples = decode_image(raw)
                    seen[digest] = (digest, len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-16:]), len(raw), hashlib.sha256(raw).hexdigest(), features(samples))
            cols = list(zip(*seen.values(), strict=True)) or [()] * 7
            kinds = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(cols, kinds, strict=True)], names=["digest", *_FACTS])

    facts = stored.select("digest", "media").mapInArrow(read, "digest string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
    return materialize(facts.groupBy("digest").agg(*[F.first(c).alias(c) for c in _FACTS]), "facts")


_FACTS = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]


def resolve(items: DataFrame, media: DataFrame) -> DataFrame:
    """``items`` with what ``media`` has on the digest in ``ref`` ("sha256:..."): every item keeps its position and caption.

    References to unknown payloads stay, their payload columns null; text items have none.
    """
    digest = F.when(F.col("kind") == "media", F.regexp_extract("ref", "^sha256:([0-9a-f]{64})$", 1))
    return items.withColumn("digest", digest).join(media, "digest", "left")


def _escaped(text: Column) -> Column:
    for mark, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(mark), F.lit(entity))
    return text


def pages_of(docs: DataFrame) -> DataFrame:
    """(page, html): each document as a page with a heading, a figure that refers to its stored image, and a paragraph for each line."""
    text = F.coalesce("text", F.lit(""))
    docs = docs.select(F.struct(F.col("doc_id").cast("long").alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes")).alias("page"), text.alias("text"))
    figure = F.concat(F.lit('<figure><img src="sha256:'), F.sha2(image_of(F.col("text")), 256), F.lit('"><figcaption>'), F.col("page.n_bytes").cast("string"), F.lit(" bytes</figcaption></figure>"))
    heading = F.concat(F.lit("<h1>Document "), F.coalesce(F.col("page.doc_id").cast("string"), F.lit("")), F.lit("</h1>"))
    body = F.concat(F.lit("<p>"), F.replace(_escaped(F.col("text")), F.lit("\n"), F.lit("</p><p>")), F.lit("</p>"))
    return docs.select("page", F.concat(F.lit("<article>"), heading, figure, body, F.lit("</article>")).alias("html"))


def interleave(docs: DataFrame, kinds: tuple[str, ...] = ("text", "media")) -> tuple[DataFrame, DataFrame]:
    """Documents as items of these ``kinds`` (page, position, kind, text, ref, caption) and media (digest and facts).

    Null texts count as empty (one row of spaces, no text items); very long texts are stored and parsed whole; rows without doc_id and
    repeated rows are kept, equal texts share a payload; an empty table has neither items nor media; other columns are ignored.
    """
    return parse(pages_of(docs), "page", kinds=kinds), media_table(store(docs))


def op9_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    items, media = interleave(table(spark, sf_dir, "documents"), kinds=("media",))
    found = resolve(items, media)
    return found.select("page.doc_id", "page.n_bytes", *_FACTS, "position", "caption")
