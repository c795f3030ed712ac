"""Secret scan by assignment-aware lexing.

Beside three plain patterns, texts are lexed as source or configuration (lexing.py): names with the literals assigned to them,
in quotes or bare, in blocks, tags and here-documents, joined, as defaults, and by way of constants named before in their scope. A
literal counts when the name it reaches is sensitive and its characters look drawn at random, or when it is a passphrase.
"""

from __future__ import annotations

import functools
import hashlib
import math
import re
from collections import Counter
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blobs, documents, map_batches
from .lexing import PLACEHOLDERS, Value, assignments, places

KINDS = ("assign", "access", "hex", "literal")
MASK = "[secret]"

_ASSIGN = re.compile(rb"""(?i:(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))""")
_KEYWORDS = (b"passw", b"secret", b"token", b"apikey", b"api_key")
_ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
_HEX = re.compile(rb"(?<![0-9a-f])[0-9a-f]{24,}")
ASSIGN_CHARS, ACCESS_CHARS = 6, 20

#: Words in names and what they add to a literal's score.
SENSITIVE = {
    "password": 2.0, "passwd": 2.0, "passphrase": 2.0, "pwd": 2.0, "secret": 2.0, "token": 1.5, "apikey": 2.0, "credential": 1.5,
    "credentials": 1.5, "bearer": 1.5, "auth": 1.0, "private": 1.0, "signing": 1.0, "encryption": 1.0, "access": 0.75, "api": 0.75,
    "key": 0.75, "client": 0.25, "session": 0.5, "salt": 0.5, "dsn": 1.0, "cookie": 0.5,
}
#: Words of names of which a literal may be a passphrase, the words one has at least, and words that sentences have and passphrases don't.
PASSPHRASE_NAMES = frozenset(["password", "passwd", "passphrase", "pwd", "mnemonic"])
PASSPHRASE_WORDS = 4
SENTENCE_WORDS = frozenset("the and are for from has have here in is it must new not of on or please enter should that this to use with you your".split())
#: A name's score and its literal's score must reach this together; neither does alone.
LEAST_SCORE = 2.5
LITERAL_CHARS = 8
_LEAST_WORDS = [w for w in SENSITIVE if not any(o != w and o in w for o in SENSITIVE)]
_SENSITIVE = re.compile("|".join(_LEAST_WORDS), re.I)
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")


class Span(NamedTuple):
    start: int
    kind: int
    end: int


def base_spans(data: bytes) -> list[Span]:
    """Spans of the plain patterns, in bytes, sorted."""
    found = []
    if b":" in data or b"=" in data:
        low = data.lower()
        if any(k in low for k in _KEYWORDS):
            found += [Span(m.start(), 0, m.end()) for m in _ASSIGN.finditer(data) if len(m[2]) >= ASSIGN_CHARS]
    if b"AKIA" in data:
        found += [Span(m.start(), 1, m.end()) for m in _ACCESS.finditer(data) if len(m[0]) >= ACCESS_CHARS]
    found += [Span(m.start(), 2, m.end()) for m in _HEX.finditer(data)]
    return sorted(found)


def in_code_points(spans: list[Span], data: bytes) -> list[Span]:
    if not spans or data.isascii():
        return spans
    at = {0: 0}
    last = 0
    for p in sorted({x for s in spans for x in (s.start, s.end)}):
        at[p] = at[last] + len(data[last:p].decode())
        last = p
    return [Span(at[s.start], s.kind, at[s.end]) for s in spans]


@functools.lru_cache(maxsize=1 << 14)
def name_score(name: str) -> float:
    words = [w.lower() for w in _WORDS.findall(name)]
    joined = [a + b for a, b in zip(words, words[1:], strict=False)]
    return sum(SENSITIVE.get(w, 0.0) for w in dict.fromkeys([*words, *joined]))


def _is_passphrase(name: str, words: list[str]) -> bool:
    return (
        len(words) >= PASSPHRASE_WORDS
        and not PASSPHRASE_NAMES.isdisjoint(w.lower() for w in _WORDS.findall(name))
        and len(set(words)) == len(words)
        and all(w.isalpha() and (w.islower() or w.istitle()) and 3 <= len(w) <= 12 and w.lower() not in SENTENCE_WORDS for w in words)
    )


def value_score(name: str, value: Value, text: str) -> float:
    """0 for a short or placeholder value; else bits per character, by kinds of character, to 2 at most. A passphrase has 1."""
    counts = value.counts(text)
    n = sum(counts.values())
    if n < LITERAL_CHARS or value.has(text, PLACEHOLDERS):
        return 0.0
    if any(c.isspace() for c in counts):
        return 1.0 if value.span and _is_passphrase(name, text[slice(*value.span)].split()) else 0.0
    if not value.quoted and (own := text[slice(*value.span)]).replace(".", "_").isidentifier() and (name_score(own) >= 1 or not any(map(str.isdigit, own))):
        return 0.0  # a name, not a literal
    bits = -sum(c / n * math.log2(c / n) for c in counts.values())
    kinds = len({"a" if "a" <= c <= "z" else "A" if "A" <= c <= "Z" else "0" if c.isdigit() else "." for c in counts})
    return min(2.0, max(0.0, bits - 2.0) / 1.5 + 0.25 * (kinds - 1)) if kinds > 1 else 0.0


def literal_spans(text: str) -> list[Span]:
    """Spans of literals that reach sensitive names, sorted, each once."""
    found: set[tuple[int, int]] = set()

    def emit(name: str, value: Value) -> None:
        sensitive = name_score(name) if _SENSITIVE.search(name) else 0
        if sensitive >= 1 and (score := value_score(name, value, text)) and sensitive + score >= LEAST_SCORE:
            found.update(places(value))

    assignments(text, emit)
    return sorted(Span(a, 3, b) for a, b in found)


def all_spans(text: str) -> tuple[list[Span], list[Span]]:
    """Base spans, and those with the literals that no base span holds, both by start and kind, in code points."""
    data = text.encode()
    base = in_code_points(base_spans(data), data)
    low = text.lower()
    more = literal_spans(text) if "://" in low or any(w in low for w in _LEAST_WORDS) else []
    more = [s for s in more if not any(b.start <= s.start and s.end <= b.end for b in base)]
    return base, sorted([*base, *more])


def _joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[s.kind]}:{s.start}:{s.end}" for s in spans)


def masked(text: str, spans: list[Span]) -> str:
    """text with each run of overlapping spans replaced by MASK."""
    out, at = [], 0
    for s in spans:
        if s.start >= at:
            out += [text[at : s.start], MASK]
        at = max(at, s.end)
    return "".join([*out, text[at:]])


SCHEMA = "row struct<{0}>, n_assign long, n_access long, n_hex long, n_literal long, base_sha256 string, spans string, clean_text string"


def _scan(batch: pa.RecordBatch) -> pa.RecordBatch:
    columns: list[list] = [[] for _ in range(7)]
    for text in batch.column("text").to_pylist():
        base, spans = all_spans(text or "")
        counts = Counter(s.kind for s in spans)
        row = (*(counts[k] for k in range(4)), hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(spans), masked(text, spans) if spans else text)
        for column, value in zip(columns, row, strict=True):
            column.append(value)
    types = [*[pa.int64()] * 4, *[pa.string()] * 3]
    names = ["n_assign", "n_access", "n_hex", "n_literal", "base_sha256", "spans", "clean_text"]
    return pa.RecordBatch.from_arrays([batch.column("row"), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names=["row", *names])


def scan(docs: DataFrame, columns: list[str]) -> DataFrame:
    """Each row of docs, as a struct row of the given columns, with counts, spans and the text masked.

    spans: kind:start:end by start, then kind, comma-joined; code points, end exclusive. A null text has no
    spans and stays null; an empty one has none. A very long text is lexed whole, in time that grows with it alone. Rows that repeat
    are each scanned; no shuffle.
    """
    rows = docs.select(F.struct(*[F.col(c) for c in columns]).alias("row"), F.col("text").cast("string").alias("text"))
    fields = ", ".join(f"`{f.name}`: {f.dataType.simpleString()}" for f in docs.select(*columns).schema)
    return map_batches(rows, _scan, SCHEMA.format(fields))


def base(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex and base_sha256 of secrets_found() alone, without lexing."""

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for data in blobs(batch.column("text")):
            spans = in_code_points(base_spans(data), data)
            counts = Counter(s.kind for s in spans)
            rows.append((*(counts[k] for k in range(3)), hashlib.sha256(_joined(spans).encode()).hexdigest()))
        columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [*[pa.int64()] * 3, pa.string()], strict=True)]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256"])

    return map_batches(documents(docs), kernel, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string")


def secrets_found(docs: DataFrame) -> DataFrame:
    return scan(docs, ["doc_id"]).select("row.doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_literal")


def masked_documents(docs: DataFrame) -> DataFrame:
    """docs with secrets masked in text, and n_chars as it then is."""
    own = {c: F.col("row").getField(c) for c in docs.columns} | {"text": F.col("clean_text")}
    if "n_chars" in own:
        own["n_chars"] = F.coalesce(F.char_length("clean_text").cast("long"), own["n_chars"])
    return scan(docs, docs.columns).select(*(own[c].alias(c) for c in docs.columns))
