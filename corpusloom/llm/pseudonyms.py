"""Private data: format-preserving pseudonyms by a keyed Feistel network.

Numbers and dates that pass their own validity test (card checksum, account number check digits, octets,
calendar, number plan) are permuted within their format under a key, so that the same value gets the
same valid pseudonym in every document, whatever separators it is written with. Local parts of mail
addresses and assigned secrets are permuted by the same network over their own alphabets.
"""

from __future__ import annotations

import datetime
import hashlib
import hmac
import math
import re
import secrets
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import blocks, table

ROUNDS = 8
BLOCK = 64  #: longer letters and digits are permuted in blocks of so many, each under its place


def _round(right: int, left: int, key: bytes, tweak: str) -> int:
    """A keyed number for one round, wide enough for residues of ``left``."""
    seed = hmac.new(key, f"{tweak}|{right:x}".encode(), hashlib.sha256).digest()
    return int.from_bytes(hashlib.shake_256(seed).digest(left.bit_length() // 8 + 16), "big") % left


def permute(value: int, size: int, key: bytes, tweak: str) -> int:
    """A keyed permutation of 0..size-1: a Feistel network on a slightly larger square, walked until inside."""
    if size < 2:
        return value
    left = math.isqrt(size - 1) + 1
    while True:
        a, b = divmod(value, left)
        for r in range(ROUNDS):
            a, b = b, (a + _round(b, left, key, f"{tweak}|{size:x}|{r}")) % left
        value = a * left + b
        if value < size:
            return value


def invert(value: int, size: int, key: bytes, tweak: str) -> int:
    """The value whose ``permute`` is ``value``."""
    if size < 2:
        return value
    left = math.isqrt(size - 1) + 1
    while True:
        a, b = divmod(value, left)
        for r in reversed(range(ROUNDS)):
            a, b = (b - _round(a, left, key, f"{tweak}|{size:x}|{r}")) % left, a
        value = a * left + b
        if value < size:
            return value


def permute_digits(digits: str, key: bytes, tweak: str) -> str:
    return str(permute(int(digits), 10 ** len(digits), key, f"{tweak}{len(digits)}")).zfill(len(digits))


def luhn_sum(digits: str) -> int:
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(digits)))


def _fill(shape: str, digits: str) -> str:
    """``shape`` with its digits replaced, one by one."""
    it = iter(digits)
    return "".join(next(it) if c.isdigit() else c for c in shape)


def _card(found: str, key: bytes) -> str | None:
    d = re.sub(r"\D", "", found)
    if luhn_sum(d) % 10 or len(set(d)) == 1:
        return None
    body = permute_digits(d[:-1], key, "card")
    return _fill(found, body + str(-luhn_sum(body + "0") % 10))


def _account(found: str, key: bytes) -> str | None:
    plain = found.replace(" ", "")
    number = lambda s: int("".join(str(int(c, 36)) for c in s))
    if not 15 <= len(plain) <= 34 or number(plain[4:] + plain[:4]) % 97 != 1:
        return None
    body = _by_class(plain[4:], key, "account")
    plain = f"{plain[:2]}{98 - number(body + plain[:2] + '00') % 97:02d}{body}"
    it = iter(plain)
    return "".join(c if c == " " else next(it) for c in found)


def _address(found: str, key: bytes) -> str | None:
    octets = [int(x) for x in found.split(".")]
    if max(octets) > 255:
        return None
    return ".".join(map(str, permute(int.from_bytes(bytes(octets), "big"), 1 << 32, key, "address").to_bytes(4, "big")))


def _phone(found: str, key: bytes) -> str | None:
    code = re.match(r"\+\d{1,3}(?=\D)", found)
    head = code[0] if code else ""
    d = re.sub(r"\D", "", found[len(head) :])
    if not 7 <= len(d) <= 14:
        return None
    return head + _fill(found[len(head) :], permute_digits(d, key, "phone"))


def _insured(found: str, key: bytes) -> str | None:
    valid = lambda d: d[:3] not in ("000", "666") and d[0] != "9" and d[3:5] != "00" and d[5:] != "0000"
    d = found.replace("-", "")
    if not valid(d):
        return None
    d = permute_digits(d, key, "insured")
    while not valid(d):
        d = permute_digits(d, key, "insured")
    return _fill(found, d)


#: First days of the eras that a date stays in, so that its pseudonym is a likely one.
_ERAS = [datetime.date(y, 1, 1).toordinal() for y in (1, 1000, 1900, 2100, 3000)] + [datetime.date.max.toordinal() + 1]


def _orders(found: str, first: str) -> list[tuple[int, int, int]]:
    """Where year, month and day can stand: with slashes the month comes first, or else the day."""
    if len(first) == 4:
        return [(0, 1, 2)]
    return [(2, 1, 0)] if "." in found else [(2, 0, 1), (2, 1, 0)]


def _date(found: str, key: bytes) -> str | None:
    parts = re.split(r"[-./]", found)
    for order in _orders(found, parts[0]):
        try:
            day = datetime.date(*(int(parts[i]) for i in order)).toordinal()
        except ValueError:
            continue
        low, high = next((a, b) for a, b in zip(_ERAS, _ERAS[1:], strict=False) if a <= day < b)
        new = datetime.date.fromordinal(low + permute(day - low, high - low, key, "date"))
        values = {order[0]: f"{new.year:04d}", order[1]: f"{new.month:02d}", order[2]: f"{new.day:02d}"}
        return _fill(found, "".join(values[i] for i in range(3)))
    return None


_CLASSES = ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")


def _by_class(text: str, key: bytes, tweak: str) -> str:
    """``text`` with its digits, small and capital letters permuted, each class as one number; the rest stays."""
    if len(text) > BLOCK:
        return "".join(_by_class(text[i : i + BLOCK], key, f"{tweak}.{len(text)}.{i}") for i in range(0, len(text), BLOCK))
    out = list(text)
    for alphabet in _CLASSES:
        at = [i for i, c in enumerate(text) if c in alphabet]
        n = len(alphabet)
        value = 0
        for i in at:
            value = value * n + alphabet.index(text[i])
        value = permute(value, n ** len(at), key, f"{tweak}{n}.{len(at)}")
        for i in reversed(at):
            value, c = divmod(value, n)
            out[i] = alphabet[c]
    return "".join(out)


def _hex(text: str, key: bytes, tweak: str) -> str:
    if len(text) > BLOCK:
        return "".join(_hex(text[i : i + BLOCK], key, f"{tweak}.{len(text)}.{i}") for i in range(0, len(text), BLOCK))
    return format(permute(int(text, 16), 16 ** len(text), key, f"{tweak}{len(text)}"), "x").zfill(len(text))


def _mail(found: str, key: bytes) -> str | None:
    local, _, domain = found.rpartition("@")
    return f"{_by_class(local, key, 'mail')}@{domain}"


def _secret(found: str, key: bytes) -> str | None:
    head = re.match(r".*?[=:]\s*[\"']?", found, re.S)[0]
    value = found[len(head) :]
    if re.fullmatch(r"[0-9a-f]+", value):
        return head + _hex(value, key, "secret")
    return head + _by_class(value, key, "secret")


#: (kind, pattern, pseudonym); a pattern finds candidates, the pseudonym is None where the value is not valid.
KINDS = (
    ("mail", r"[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}", _mail),
    ("secret", r"(?i:\b(?:token|secret|password|passwd|api_?key)\b\s*[=:]\s*[\"']?)[A-Za-z0-9_\-+/]{16,}", _secret),
    ("account", r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b", _account),
    ("address", r"(?<![\d.])\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?![\d]|\.\d)", _address),
    ("date", r"(?<![\d.\-/])(?:\d{4}-\d\d-\d\d|\d\d\.\d\d\.\d{4}|\d\d/\d\d/\d{4})(?![\d]|[.\-/]\d)", _date),
    ("insured", r"(?<![\d\-])\d{3}-\d\d-\d{4}(?![\d\-])", _insured),
    ("card", r"(?<!\w)(?:\d{4}([ -])\d{4}\1\d{4}\1\d{4}|\d{4}[ -]\d{6}[ -]\d{5}|\d{13,19})(?!\w)", _card),
    ("phone", r"(?<![\w+])(?:\+\d{1,3}[ .-]?\(?\d{2,4}\)?[ .-]?\d{3,4}[ .-]?\d{3,4}|\+\d{1,3}(?:[ .-]\(?\d{1,4}\)?){2,6}|\(\d{3}\) ?\d{3}-\d{4}|\d{3}-\d{3}-\d{4})(?![\d-])", _phone),
)
_FIND = {kind: (re.compile(pattern), make) for kind, pattern, make in KINDS}
_DIGIT = re.compile(r"\d")


def pseudonymize_text(text: str, key: bytes) -> tuple[str, dict[str, int]]:
    """``text`` with its private values replaced, and how many of each kind there were."""
    counts: dict[str, int] = {}
    digits, mail = bool(_DIGIT.search(text)), "@" in text
    if not (digits or mail or "=" in text or ":" in text):
        return text, counts
    spans: list[tuple[int, int, str]] = []
    taken = bytearray(len(text))  # characters of values that are replaced already
    for kind, (pattern, make) in _FIND.items():
        if (kind == "mail" and not mail) or (kind not in ("mail", "secret") and not digits) or (kind == "secret" and not ("=" in text or ":" in text)):
            continue
        for m in pattern.finditer(text):
            new = make(m[0], key)
            if new is not None and not any(taken[m.start() : m.end()]):
                spans.append((m.start(), m.end(), new))
                taken[m.start() : m.end()] = b"\1" * (m.end() - m.start())
                counts[kind] = counts.get(kind, 0) + 1
    if not spans:
        return text, counts
    out, at = [], 0
    for a, b, new in sorted(spans):
        out += [text[at:a], new]
        at = b
    return "".join(out) + text[at:], counts


def session_key(spark: SparkSession) -> str:
    """The key in ``corpusloom.pseudonym.key``; where none is set, a random one that is kept in the session's settings.

    Set it to the same secret in every session whose pseudonyms must stay linked; a random one links those of one session only.
    """
    key = spark.conf.get("corpusloom.pseudonym.key", "")
    if not key:
        key = secrets.token_hex(32)
        spark.conf.set("corpusloom.pseudonym.key", key)
    return key


def pseudonymize(docs: DataFrame, key: str) -> DataFrame:
    """``docs`` with private values of ``text`` replaced and columns ``n_private`` and ``private_kinds`` (map of counts).

    ``key`` decides the permutation and must be kept secret. Nulls stay null (no private values), empty texts
    stay empty, very long texts are scanned whole, repeated rows and equal values come out alike (where patterns overlap, the
    first kind in ``KINDS`` wins), an empty table stays empty, other columns pass unchanged whatever their names (columns
    named ``n_private`` or ``private_kinds`` are replaced).
    """
    if not key:
        raise ValueError("pseudonyms need a key")
    names = [c for c in docs.columns if c not in ("n_private", "private_kinds")]
    docs, secret = docs.select(*names), key.encode()

    def replace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in blocks(batches, "text", 4 << 20):
            i = batch.schema.get_field_index("text")
            found = [pseudonymize_text(t.decode(), secret) for t in texts]
            null = batch.column(i).is_null().to_pylist()
            text = pa.array([None if z else t for z, (t, _) in zip(null, found, strict=True)], type=batch.schema.field(i).type)
            cols = [text if k == i else c for k, c in enumerate(batch.columns)]
            cols += [pa.array([sum(c.values()) for _, c in found], type=pa.int32()), pa.array([sorted(c.items()) for _, c in found], type=pa.map_(pa.string(), pa.int32()))]
            yield pa.RecordBatch.from_arrays(cols, names=[*names, "n_private", "private_kinds"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(replace, f"{schema}, n_private int, private_kinds map<string,int>")


def op2_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pseudonymize(docs, session_key(spark)).select("doc_id", "text", "n_private", F.sha2("text", 256).alias("text_sha256"))
