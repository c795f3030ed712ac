"""Quality rules from tokeniser fertility.

Public vocabularies measure, per document, characters per token, the share of bytes that a piece vocabulary can only
spell with byte tokens, and the entropy of the document's token distribution. Bands per language, or per script where
the language has none, reject what lies outside. Base counts of words, symbols and repetition go before.
"""

from __future__ import annotations

import functools
import re
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD_SEPARATORS, documents, map_batches
from .tokens import ByteBPE, file_of

SYMBOLS = b"#*$%&|<>"
REPEAT_WORDS = 5
LEAST_WORDS = 10
#: Per cent of words in repeated windows beyond which a document fails.
REPEAT_PERCENT = 20


class Band(NamedTuple):
    """Limits for documents of at least so many tokens."""

    from_tokens: int
    chars_per_token: tuple[float, float]
    least_entropy: float


#: Characters per token beyond which text is no prose in words; the vocabulary's own English has some 5.4. Few tokens may be all long.
MOST_CHARS, MOST_CHARS_SHORT = 6.50, 9.00
#: By language, longest documents last; the last band that a document is long enough for holds.
#: A document's entropy grows with its length, so its least value does. Only the side of junk is close: least values stand outside what the
#: labelled documents of good quality have (some 16,000 of a sample of 50,000, read once when these were set), by 0.05 and more, and short
#: documents have wide bands. fit_bands() finds least values for other corpora.
_FROM = (1, 32, 64, 128, 256, 512, 1024, 2048, 4096, 8192)
_SHORT = ((1.30, 3.00), (1.50, 3.80), (1.70, 4.70))
LANGUAGE_BANDS: dict[str, list[Band]] = {
    lang: [
        *(Band(n, (chars, MOST_CHARS_SHORT), bits) for n, (chars, bits) in zip(_FROM[:3], _SHORT, strict=True)),
        *(Band(n, (chars, MOST_CHARS), bits) for n, chars, bits in zip(_FROM[3:], [*lows, *[lows[-1]] * 2], least, strict=True)),
    ]
    for lang, lows, least in (
        ("en", (1.95, 2.10, 2.10, 2.25, 2.35), (5.60, 6.00, 6.30, 6.50, 6.68, 6.80, 6.85)),
        ("fr", (1.85, 1.95, 1.98, 2.05, 2.08), (5.45, 5.78, 6.05, 6.24, 6.35, 6.45, 6.50)),
        ("de", (2.05, 2.08, 2.10, 2.15, 2.20), (5.55, 5.78, 6.10, 6.35, 6.50, 6.55, 6.60)),
        ("es", (1.82, 1.88, 1.90, 1.95, 1.97), (5.35, 5.60, 6.00, 6.25, 6.36, 6.45, 6.50)),
    )
}
#: By script, for other languages: wide limits against runs of one token and undecodable bytes alone.
SCRIPT_BANDS: dict[str, list[Band]] = {
    "latin": [Band(1, (1.00, MOST_CHARS_SHORT), 2.50), Band(128, (1.30, 6.50), 4.00)],
    "other": [Band(1, (0.30, MOST_CHARS_SHORT), 2.00), Band(128, (0.30, 6.50), 3.50)],
}
#: fit_bands() takes so many labelled documents at most, asks for so many in a band, leaves out this share of them and stands so far outside the rest.
FIT_ROWS, FIT_LEAST, FIT_SHARE, FIT_MARGIN = 20_000, 30, 0.001, 0.05
#: Largest share of byte-fallback bytes: in Latin script, in others, and in others of which the piece vocabulary lacks most letters. There
#: only signs, spaces and foreign words have pieces, so all but what is without any of them passes.
MOST_FALLBACK = {"latin": 0.20, "other": 0.25, "unknown": 0.97}

_LATIN = re.compile("[A-Za-zª-ɏ]")
SCHEMA = (
    "row struct<{0}>, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_tokens long, "
    "chars_per_token double, byte_fallback_share double, token_entropy double, base_failed boolean, kept boolean"
)


@functools.lru_cache(maxsize=2)
def _piece_characters(model: str) -> frozenset[str]:
    """Characters that have a piece of their own; a space is the piece that begins words."""
    import sentencepiece

    vocabulary = sentencepiece.SentencePieceProcessor(model_file=file_of(model))
    pieces = (vocabulary.id_to_piece(i) for i in range(vocabulary.vocab_size()) if not vocabulary.is_byte(i))
    return frozenset(x for x in pieces if len(x) == 1) | {" "}


def byte_fallback_share(text: str, size: int, model: str = "piece_bpe_32k.model") -> float:
    """Bytes of characters without a piece, of the text's size bytes; 0 for an empty text."""
    missing = set(text) - _piece_characters(model)
    return sum(text.count(c) * len(c.encode()) for c in missing) / size if missing else 0.0


def repeated_words(words: list[bytes], size: int = REPEAT_WORDS) -> int:
    """Words in windows of size words that are found twice or more, first occurrences included."""
    n = len(words) - size + 1
    if n < 2:
        return 0
    last = dict(zip(words, range(len(words)), strict=True))
    ids = np.fromiter(map(last.__getitem__, words), np.int64, len(words))
    keys = np.zeros(n, np.uint64)
    for k in range(size):  # equal windows have equal keys; unequal ones are told apart below
        keys = keys * np.uint64(0x9E3779B97F4A7C15) + ids[k : k + n].astype(np.uint64)
    order = np.argsort(keys, kind="stable")
    if not (keys[order[1:]] == keys[order[:-1]]).any():
        return 0
    rank = ids[:n]
    for k in range(1, size):
        rank = np.unique(rank * len(words) + ids[k : k + n], return_inverse=True)[1]
    again = np.bincount(rank)[rank] > 1
    covered = np.zeros(len(words) + 1, np.int64)
    np.add.at(covered, np.flatnonzero(again), 1)
    np.add.at(covered, np.flatnonzero(again) + size, -1)
    return int((np.cumsum(covered[:-1]) > 0).sum())


def base_counts(text: str, data: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    words = data.split()
    dup = 0
    if b"\n" in data:
        lines = [x for x in data.split(b"\n") if x and not x.isspace()]
        dup = len(lines) - len(set(lines))
    chars = len(text) - (len(data) - len(data.translate(None, WORD_SEPARATORS)))
    return len(words), chars, len(data) - len(data.translate(None, SYMBOLS)), dup, repeated_words(words)


def entropy(ids: np.ndarray) -> float:
    """Bits per token of the distribution of ids; 0 for none."""
    if not len(ids):
        return 0.0
    counts = np.unique(ids, return_counts=True)[1]
    return float(np.log2(len(ids)) - (counts * np.log2(counts)).sum() / len(ids))


def script_of(text: str) -> str:
    letters = sum(map(str.isalpha, text))
    return "latin" if 2 * len(_LATIN.findall(text)) >= letters else "other"


def lacks_letters(text: str, model: str = "piece_bpe_32k.model") -> bool:
    """Whether the piece vocabulary has no piece for most of a text's letters."""
    letters = [c for c in text if c.isalpha()]
    return 2 * sum(c in _piece_characters(model) for c in letters) < len(letters)


def within(text: str, lang: str | None, n_tokens: int, per_token: float, fallback: float, bits: float, bands: dict[str, list[Band]] = LANGUAGE_BANDS) -> bool:
    script = "latin" if lang in LANGUAGE_BANDS else script_of(text)
    band = next((b for b in reversed(bands.get(lang) or SCRIPT_BANDS[script]) if n_tokens >= b.from_tokens), None)
    low, high = band.chars_per_token if band else (0.0, np.inf)
    if script == "other" and fallback > MOST_FALLBACK["other"] and lacks_letters(text):
        script = "unknown"
    return band is None or (low <= per_token <= high and bits >= band.least_entropy and fallback <= MOST_FALLBACK[script])


def _measure(batch: pa.RecordBatch, state: tuple[ByteBPE, dict[str, list[Band]]]) -> pa.RecordBatch:
    bpe, bands = state
    columns: list[list] = [[] for _ in range(11)]
    for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist(), strict=True):
        text = text or ""
        data = text.encode()
        base = base_counts(text, data)
        ids = bpe.ids(text)
        per_token, fallback, bits = (len(text) / len(ids) if len(ids) else 0.0), byte_fallback_share(text, len(data)), entropy(ids)
        failed = base[0] < LEAST_WORDS or 100 * base[4] > REPEAT_PERCENT * base[0]
        kept = not failed and within(text, lang, len(ids), per_token, fallback, bits, bands)
        for column, value in zip(columns, (*base, len(ids), per_token, fallback, bits, failed, kept), strict=True):
            column.append(value)
    types = [*[pa.int64()] * 6, *[pa.float64()] * 3, *[pa.bool_()] * 2]
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_tokens", "chars_per_token", "byte_fallback_share", "token_entropy", "base_failed", "kept"]
    return pa.RecordBatch.from_arrays([batch.column("row"), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names=["row", *names])


def fertility(docs: DataFrame, columns: list[str], vocabulary: str = "byte_bpe_50k", bands: dict[str, list[Band]] = LANGUAGE_BANDS) -> DataFrame:
    """Each row of docs, as a struct row of the given columns, with its measures and verdict.

    A null text counts as empty: no words, so it fails. A null or unknown lang is judged by its script. A very long text is measured whole. Rows that
    repeat are each judged; no shuffle.
    """
    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    rows = docs.select(F.struct(*[F.col(c) for c in columns]).alias("row"), F.col("text").cast("string").alias("text"), lang.alias("lang"))
    fields = ", ".join(f"`{f.name}`: {f.dataType.simpleString()}" for f in docs.select(*columns).schema)
    return map_batches(rows, _measure, SCHEMA.format(fields), lambda: (ByteBPE(vocabulary), bands))


def verdicts(docs: DataFrame, **options) -> DataFrame:
    return fertility(docs, ["doc_id"], **options).select("row.*", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_tokens", "chars_per_token", "byte_fallback_share", "token_entropy")


def base(docs: DataFrame) -> DataFrame:
    """doc_id, base counts and base_failed of verdicts() alone, without any tokens."""

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [base_counts(text or "", (text or "").encode()) for text in batch.column("text").to_pylist()]
        failed = [r[0] < LEAST_WORDS or 100 * r[4] > REPEAT_PERCENT * r[0] for r in rows]
        columns = [pa.array(c, pa.int64()) for c in zip(*rows, strict=True)]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns, pa.array(failed, pa.bool_())], names=["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"])

    return map_batches(documents(docs), kernel, "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean")


def kept_documents(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs, all columns, that base counts and bands keep."""
    return fertility(docs, docs.columns, **options).where("kept").select("row.*")


def fit_bands(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS, least: int = FIT_LEAST, **options) -> dict[str, list[Band]]:
    """LANGUAGE_BANDS with least values from documents of docs that labels (doc_id, quality) calls good.

    About rows of them, by hash of doc_id, are measured; the driver gets a row for each band. Bands of fewer than least
    documents, and languages without any, stay as they are.
    """
    good = docs.join(labels.where("quality = 1").select("doc_id").distinct(), "doc_id", "left_semi")
    every = max(1, -(-good.count() // rows))
    measured = fertility(good.where(F.pmod(F.xxhash64("doc_id"), F.lit(every)) == 0), ["lang"], **options).where("NOT base_failed")
    start = F.array_max(F.filter(F.array(*map(F.lit, _FROM)), lambda n: n <= F.greatest("n_tokens", F.lit(1))))
    lows = measured.where(F.col("row.lang").isin(*LANGUAGE_BANDS)).groupBy(F.col("row.lang").alias("lang"), start.alias("start")).agg(F.count("*").alias("n"), *(F.percentile(c, F.lit(FIT_SHARE)).alias(c) for c in ("chars_per_token", "token_entropy")))
    found = {(r.lang, r.start): r for r in lows.where(F.col("n") >= least).collect()}
    return {
        lang: [
            Band(b.from_tokens, (r.chars_per_token - FIT_MARGIN, b.chars_per_token[1]), r.token_entropy - FIT_MARGIN) if (r := found.get((lang, b.from_tokens))) else b
            for b in bands
        ]
        for lang, bands in LANGUAGE_BANDS.items()
    }
