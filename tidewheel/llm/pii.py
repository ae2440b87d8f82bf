"""Personal data: patterns propose spans, checksums confirm them, nearby context words move the score.

Spans of the four base kinds (email, ip, card, phone) are decided by pattern and check alone.  The further
kinds (iban, secret, ssn, phone_local) need a score of THRESHOLD: a prior per kind, plus a validator's or a
context word's weight.  A confirmed IBAN passes by its checksum and an assigned secret by its pattern; a context word
only raises their scores.  SSN and local phone patterns pass with a context word alone.  All scans are linear in the
text but for sorting the spans, so very long texts and long digit runs are safe.

Null or empty text: no spans.  An empty table gives an empty result.  Repeated rows are scanned alike; a null doc_id stays.
Other columns are ignored, whatever their names; `redact` passes them on.  Spans of equal kind and start can't occur.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import pieces

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "iban", "secret", "ssn", "phone_local")
THRESHOLD = 0.5
CONTEXT_CHARS = 48
PRIOR = {"iban": 0.2, "secret": 0.5, "ssn": 0.3, "phone_local": 0.3}
CONTEXT = {
    "iban": ("iban", "account", "konto", "bank"),
    "secret": ("token", "secret", "password", "passwd", "key", "credential"),
    "ssn": ("ssn", "social", "security"),
    "phone_local": ("phone", "tel", "call", "mobile", "fax", "telefon"),
}
CHECKED, NEARBY = 0.6, 0.3

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DIGIT = re.compile(r"[0-9]")
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
_SECRET = re.compile(r"(?:token|secret|passw(?:or)?d|api[_-]?key)\s{0,4}[=:]\s{0,4}[\"']([^\"'\s]{8,256})[\"']", re.I)
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_LOCAL_PHONE = re.compile(r"(?<![0-9+.-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9-])")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def mod97(code: str) -> bool:
    """ISO 13616: country and check digits to the end, letters as two-digit numbers, remainder 1."""
    turned = code[4:] + code[:4]
    return int("".join(str(int(c, 36)) for c in turned)) % 97 == 1


def emails(text: str) -> list[tuple[int, int]]:
    out, floor, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > floor and text[start - 1] in _LOCAL:
            start -= 1
        tail = _DOMAIN.match(text, at + 1) if start < at else None
        if tail:
            floor = tail.end()
            out.append((start, floor))
        at = text.find("@", tail.end() if tail else at + 1)
    return out


def _byte(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 4 and int(part or 0) <= 255


def base_spans(text: str) -> list[tuple[str, int, int]]:
    out = [("email", a, b) for a, b in emails(text)]
    if not _DIGIT.search(text):
        return out
    out += [("ip", *m.span()) for m in _IP.finditer(text) if all(map(_byte, m.groups()))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m.group().replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= sum(c.isdigit() for c in m.group()) <= 15:
                out.append(("phone", *m.span()))
    return out


def _score(kind: str, text: str, start: int, end: int, checked: bool) -> float:
    around = (text[max(0, start - CONTEXT_CHARS) : start] + " " + text[end : end + CONTEXT_CHARS]).lower()
    near = any(w in around for w in CONTEXT[kind])
    return PRIOR[kind] + CHECKED * checked + NEARBY * near


def outside(held: list[tuple[int, int]]):
    """Whether a span (a, b) overlaps none of the held ones, by bisection."""
    held = sorted(held)
    starts, furthest = [a for a, _ in held], list(accumulate((b for _, b in held), max))
    return lambda a, b: not (k := bisect_left(starts, b)) or furthest[k - 1] <= a


def scored_spans(text: str, taken: list[tuple[str, int, int]]) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, score) of what the further kinds propose outside the spans taken."""
    if not _DIGIT.search(text) and '"' not in text and "'" not in text:
        return []
    found = [("iban", *m.span(), m.span(), True) for m in _IBAN.finditer(text) if mod97(m.group().replace(" ", ""))]
    found += [("secret", *m.span(1), m.span(), False) for m in _SECRET.finditer(text)]
    found += [("ssn", *m.span(), m.span(), False) for m in _SSN.finditer(text)]
    found += [("phone_local", *m.span(), m.span(), False) for m in _LOCAL_PHONE.finditer(text)]
    free = outside([(a, b) for _, a, b in taken])
    return [(k, a, b, _score(k, text, *whole, ok)) for k, a, b, whole, ok in found if free(a, b)]


def further_spans(text: str, taken: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    return [(k, a, b) for k, a, b, score in scored_spans(text, taken) if score >= THRESHOLD]


def find(text: str | None) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """(base spans, all spans), each by kind as listed, then start; code points, end exclusive."""
    text = text or ""
    base = base_spans(text)
    rank = {k: i for i, k in enumerate(KINDS)}
    return base, sorted(base + further_spans(text, base), key=lambda s: (rank[s[0]], s[1]))


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


DETECTED = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"


def detect(docs: DataFrame) -> DataFrame:
    """One row per document: counts, the digest of its base spans, and all spans."""

    def run(batches):
        for batch in batches:
            rows = [find(t) for t in batch.column(1).to_pylist()]
            count = lambda k: pa.array([sum(s[0] == k for s in b) for b, _ in rows], pa.int64())  # noqa: E731,B023
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    *(count(k) for k in BASE_KINDS),
                    pa.array([hashlib.sha256(joined(b).encode()).hexdigest() for b, _ in rows], pa.string()),
                    pa.array([joined(s) for _, s in rows], pa.string()),
                ],
                names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"],
            )

    docs = docs.selectExpr("cast(doc_id as bigint) doc_id", "text")
    return docs.mapInArrow(run, DETECTED)


def mask(text: str, spans: list[tuple[str, int, int]]) -> str:
    """Put `<kind>` for each span; overlapping spans become one, named by the first."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"<{kind}>"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, text_col: str = "text", length_col: str = "n_chars") -> DataFrame:
    """The same rows and columns with personal data masked; length_col, where there is one, follows the text."""
    schema, names = docs.schema, docs.columns
    at = names.index(text_col)
    length = names.index(length_col) if length_col in names else None

    def run(batches):
        for batch in pieces(batches):
            cols = list(batch.columns)
            texts = [t if t is None else mask(t, find(t)[1]) for t in cols[at].to_pylist()]
            if length is not None:
                changed = [n if new == old else len(new) for n, new, old in zip(cols[length].to_pylist(), texts, cols[at].to_pylist(), strict=True)]
                cols[length] = pa.array(changed, cols[length].type)
            cols[at] = pa.array(texts, cols[at].type)
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return docs.mapInArrow(run, schema)
