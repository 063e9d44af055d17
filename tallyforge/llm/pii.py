"""Personal data: regular expressions propose spans, checksums confirm them, context words adjust the score.

Base kinds (email, ip, card, phone) follow fixed patterns and are always kept; further kinds (iban, ssn, cards of 12 or
13 digits, and secret: keys and tokens) count only if checksum or structure and context raise their score to the threshold.
A secret is a value of 16 characters or more behind a word for one and a sign of assignment, mixed enough to be no word or
number; a value in one of the forms that services give out; or the head of a private key.

Null and empty texts have no spans, and an empty table gives no row. Repeated rows each give a row. Of spans that begin at one
place all are reported, in the order of KINDS. Texts of any length are searched whole, in time that grows with their length.
Extra columns of the input are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_slices

KINDS = ("email", "ip", "card", "phone", "iban", "ssn", "card_short", "secret")

#: Words near a span that speak for its kind, and words that speak against any kind.
CONTEXT = {
    "iban": ("iban", "bank", "account", "konto", "compte", "cuenta"),
    "ssn": ("ssn", "social", "security"),
    "card_short": ("card", "visa", "credit", "debit", "karte", "carte", "tarjeta"),
}
#: Words for secrets, looked for right before a sign of assignment.
SECRET_WORDS = ("token", "secret", "password", "passwd", "passphrase", "pwd", "apikey", "api_key", "api-key", "accesskey", "access_key", "access-key", "private_key", "credential", "auth")
#: Forms of keys that services give out.
SECRET_FORMS = r"AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36,255}|xox[abprs]-[A-Za-z0-9-]{10,250}|sk-[A-Za-z0-9_-]{20,250}|AIza[0-9A-Za-z_-]{35}|eyJ[A-Za-z0-9_-]{8,}+\.eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+|-----BEGIN (?:[A-Z]{2,12} )?PRIVATE KEY-----"
AGAINST = ("order", "invoice", "isbn", "version", "serial", "sku")

_AT = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOTTED = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
_DIGITS = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_SSN = re.compile(r"[0-8][0-9]{2}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])")
_ASSIGNED = re.compile(r"[:=]\s{0,3}[\"'`]?([A-Za-z0-9_+/.~=-]{16,}+)")
_FORMS = re.compile(rf"(?<![A-Za-z0-9])(?:{SECRET_FORMS})")
_FORM_MARKS = ("AKIA", "gh", "xox", "sk-", "AIza", "eyJ", "-----BEGIN")
_WORD = re.compile(r"[^\W\d_]+")
_NOT_DIGIT = str.maketrans("", "", " -().+")


def luhn(digits: str) -> bool:
    """The check of card numbers: every second digit from the right doubled, digit sums added, a multiple of ten."""
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = ord(d) - 48
        if i % 2:
            x = 2 * x - 9 * (x > 4)
        total += x
    return total % 10 == 0


def mod97(iban: str) -> bool:
    """The check of account numbers: country and check digits moved to the end, letters as 10..35, remainder 1."""
    s = iban.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def emails(text: str) -> list[tuple[int, int]]:
    """Matches of local@domain, found from each @ outward so that long runs cost linear time."""
    out, floor = [], 0
    for m in _AT.finditer(text):
        at = start = m.start()
        while start > floor and text[start - 1] in _LOCAL:
            start -= 1
        if start < at:
            floor = m.end()
            out.append((start, floor))
    return out


def ips(text: str) -> list[tuple[int, int]]:
    """Dotted quads: each maximal run of numbers and dots is dealt into fours from its left, in linear time."""
    out = []
    for m in _DOTTED.finditer(text):
        if m[0].count(".") < 3:
            continue
        parts, at = m[0].split("."), m.start()
        for i in range(0, len(parts) - 3, 4):
            four = parts[i : i + 4]
            end = at + sum(map(len, four)) + 3
            if all(len(p) < 3 or len(p) == 3 and p <= "255" for p in (p.lstrip("0") for p in four)):
                out.append((at, end))
            at = end + 1
    return out


def digit_chains(text: str) -> Iterator[tuple[int, int, str]]:
    """Maximal chains of two or more digits with at most one blank or hyphen between."""
    for m in _DIGITS.finditer(text):
        yield m.start(), m.end(), m[0].translate(_NOT_DIGIT)


def phones(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _PHONE.finditer(text) if 10 <= len(m[0].translate(_NOT_DIGIT)) <= 15]


def mixed(value: str) -> bool:
    """Whether a value looks drawn at random: digits and letters, eight or more different characters, none over a third of it."""
    counts = {c: value.count(c) for c in set(value)}
    return len(counts) >= 8 and 3 * max(counts.values()) <= len(value) and any(c.isdigit() for c in value) and any(c.isalpha() for c in value)


def secrets(text: str) -> list[tuple[int, int, float]]:
    """(start, end, score) of keys and tokens; where two overlap, the one that begins first."""
    found = []
    for m in _ASSIGNED.finditer(text):
        before = text[max(0, m.start() - 24) : m.start()].lower().rstrip(" \t\"'`")
        if mixed(m[1]) and any(before.endswith(w) or before.endswith(w + "s") for w in SECRET_WORDS):
            found.append((*m.span(1), 0.8))
    if any(x in text for x in _FORM_MARKS):
        found += [(*m.span(), 0.9) for m in _FORMS.finditer(text)]
    out: list[tuple[int, int, float]] = []
    for s, e, score in sorted(found):
        if not out or s >= out[-1][1]:
            out.append((s, e, score))
    return out


def context_score(text: str, start: int, end: int, kind: str, reach: int = 40) -> float:
    """+0.3 if a word for the kind stands within reach, -0.3 if one against does."""
    near = {w.lower() for w in _WORD.findall(text[max(0, start - reach) : start] + " " + text[end : end + reach])}
    return 0.3 * bool(near & {*CONTEXT.get(kind, ())}) - 0.3 * bool(near & {*AGAINST})


def find(text: str, threshold: float = 0.6) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, score) of all spans, in order of start, then kind; offsets in code points."""
    spans: list[tuple[str, int, int, float]] = []
    if "@" in text:
        spans += [("email", s, e, 0.9) for s, e in emails(text)]
    chains = list(digit_chains(text))
    if chains or text.count(".") >= 3:
        spans += [("ip", s, e, 0.7) for s, e in ips(text)]
    for s, e, digits in chains:
        if 14 <= len(digits) <= 19 and luhn(digits):
            spans.append(("card", s, e, 0.9))
        elif 12 <= len(digits) <= 13 and luhn(digits):
            score = 0.4 + context_score(text, s, e, "card_short")
            if score >= threshold:
                spans.append(("card_short", s, e, score))
    if "+" in text:
        spans += [("phone", s, e, 0.8) for s, e in phones(text)]
    if chains:
        for m in _IBAN.finditer(text):
            if (m.start() == 0 or not text[m.start() - 1].isalnum()) and 15 <= len(m[0].replace(" ", "")) <= 34 and mod97(m[0]):
                score = 0.8 + context_score(text, *m.span(), "iban")
                if score >= threshold - 0.1:
                    spans.append(("iban", *m.span(), min(1.0, score)))
        for m in _SSN.finditer(text):
            if m.start() and text[m.start() - 1] in "0123456789-" or m[0][:3] in ("000", "666"):
                continue
            score = 0.5 + context_score(text, *m.span(), "ssn")
            if score >= threshold:
                spans.append(("ssn", *m.span(), score))
    spans += [("secret", s, e, score) for s, e, score in secrets(text) if score >= threshold]
    spans.sort(key=lambda x: (x[1], KINDS.index(x[0])))
    return spans


def redact(text: str, spans: list[tuple[str, int, int, float]]) -> str:
    """The text with each span replaced by <KIND>; of spans that overlap, the union by the first one's kind."""
    out, at, last = [], 0, 0
    for kind, s, e, _ in spans:
        if s >= last:
            out += [text[at:s], f"<{kind.upper()}>"]
            at = last = e
        elif e > last:
            at = last = e
    return "".join([*out, text[at:]])


def scan(docs: DataFrame, threshold: float = 0.6, text: str = "text", key: str = "doc_id") -> DataFrame:
    """A row per document: key, found (array of kind, start, end, score), redacted (the text without the spans).

    One pass in Python over Arrow batches, no shuffle; memory is bounded by a batch.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))
        for part in text_slices(batches):
            texts = [t or "" for t in part.column(1).to_pylist()]
            found = [find(t, threshold) for t in texts]
            spans = [[dict(zip(("kind", "start", "end", "score"), x, strict=True)) for x in xs] for xs in found]
            clean = [redact(t, xs) if xs else t for t, xs in zip(texts, found, strict=True)]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(spans, kind), pa.array(clean, pa.string())], names=["key", "found", "redacted"])

    kind = docs.schema[key].dataType.simpleString()
    out = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"key {kind}, found array<struct<kind:string,start:bigint,end:bigint,score:double>>, redacted string")
    return out.withColumnRenamed("key", key)


def pii_spans(docs: DataFrame, threshold: float = 0.6) -> DataFrame:
    """The contract's digest: counts of base kinds, base_sha256 of them, and all spans as text; then n_private, how many
    spans there are of any kind, and private, whether there is one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = KINDS[:4]
        for batch in batches:
            rows = []
            for t in batch.column(1):
                t = t.as_py()
                found = find(t, threshold) if t else []
                line = [f"{k}:{s}:{e}" for k, s, e, _ in found]
                kept = [x for x, f in zip(line, found, strict=True) if f[0] in base]
                n = [sum(f[0] == k for f in found) for k in base]
                rows.append((*n, hashlib.sha256(",".join(kept).encode()).hexdigest(), ",".join(line), len(line), bool(line)))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 8
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_private", "private"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_private long, private boolean")


def redact_stage(docs: DataFrame, threshold: float = 0.6) -> DataFrame:
    """docs with every span of text replaced by its kind; the other columns as they are (n_chars follows the text)."""
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = names.index("text")
        for batch in text_slices(batches):
            texts = batch.column(at).to_pylist()
            clean = [redact(t, xs) if t and (xs := find(t, threshold)) else t for t in texts]
            cols = [pa.array(clean, pa.string()) if i == at else batch.column(i) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    out = docs.mapInArrow(run, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in names else out
