"""Interpolated modified Kneser-Ney language model: counted in Spark, kept as sorted hash arrays, memory-mapped by workers.

Words are 64-bit hashes. Tasks count the bigrams of their texts and send each shard one block of sorted arrays, so what is
shuffled is a few bytes per distinct bigram and task. A bigram's shard follows from its context; contexts of words that hold
more than HOT of all tokens are spread by the second word as well. Each shard is merged once, gives its part of every
word's counts, and is written as arrays sorted by hash, which scoring maps into memory and searches with sorted needles.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import repeat
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import by_shard, looked_up, mapped, narrow, packed, release, save, shard_count, unpacked
from .common import blobs, bound_batches, discard, documents, fresh_uri, map_batches, written

SEED = 7
FOLDS, HELD_OUT = 7, 2
#: Share of all tokens from which on a word's successors are spread over shards; at most 1 / HOT words have it.
HOT = 1e-3
#: Training tokens for each shard of bigrams.
SHARD_TOKENS = 4_000_000
#: Distinct bigrams that a task holds before it sends them off.
TASK_BIGRAMS = 2_000_000
#: Hashes of the beginning and the end of a text; words never hash these by construction but by chance.
BEGIN, END = np.uint64(1), np.uint64(2)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def token_hashes(text: bytes) -> np.ndarray:
    """Hashes of the lower-cased words of a text and of its end."""
    words = text.lower().split()
    out = np.empty(len(words) + 1, np.uint64)
    out[:-1] = np.fromiter(map(xxhash.xxh64_intdigest, words, repeat(SEED)), np.uint64, len(words))
    out[-1] = END
    return out


def held_out(doc_id) -> bool:
    """Whether scoring alone sees a document; one without an id is trained on."""
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % FOLDS == HELD_OUT


def _pairs(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Contexts and tokens of all texts, and the number of tokens of each."""
    each = [token_hashes(t) for t in texts]
    lengths = np.array([len(x) for x in each], np.int64)
    token = np.concatenate([np.zeros(0, np.uint64), *each])
    context = np.concatenate([[BEGIN], token[:-1]]).astype(np.uint64) if len(token) else token
    context[np.cumsum(lengths)[:-1]] = BEGIN
    return context, token, lengths


def _key(context: np.ndarray, token: np.ndarray) -> np.ndarray:
    x = (context * _MIX) ^ (token + (context >> np.uint64(29)))
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _counted(context: np.ndarray, token: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct bigrams, sorted by context and token, with their counts."""
    order = np.lexsort((token, context))
    context, token, count = context[order], token[order], count[order]
    first = np.flatnonzero(np.concatenate([[len(context) > 0], (context[1:] != context[:-1]) | (token[1:] != token[:-1])])[: len(context)])
    return context[first], token[first], np.add.reduceat(count, first) if len(first) else count


def _by_word(word: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Sorted distinct words and the sums of their values."""
    order = np.argsort(word, kind="stable")
    word = word[order]
    first = np.flatnonzero(np.concatenate([[len(word) > 0], word[1:] != word[:-1]])[: len(word)])
    return (word[first], *(np.add.reduceat(v[order], first) if len(first) else v for v in values))


def _shard_of(context: np.ndarray, token: np.ndarray, hot: np.ndarray, shards: int) -> np.ndarray:
    spread = np.where(np.isin(context, hot), token >> np.uint64(24), np.uint64(0))
    return (((context >> np.uint64(24)) + spread) % np.uint64(shards)).astype(np.int64)


class Model(NamedTuple):
    """Where the arrays are, and the few numbers that belong to the whole."""

    folder: str
    shards: int
    word_shards: int
    tokens: int
    vocabulary: int
    bigrams: int
    discounts: tuple[float, float, float]
    lower_discounts: tuple[float, float, float]
    lower_rest: float
    hot: list[tuple[int, int, int, int, int]]


def discounts(n: list[int]) -> tuple[float, float, float]:
    """For counts of 1, 2 and 3 or more, from the numbers n of things counted 1, 2, 3 and 4 times; 0 where these are none."""
    if not n[0]:
        return (0.0, 0.0, 0.0)
    y = n[0] / (n[0] + 2 * n[1])
    return tuple(min(float(k), max(0.0, k - (k + 1) * y * n[k] / n[k - 1])) if n[k - 1] else 0.0 for k in (1, 2, 3))


def _of_counts(count: np.ndarray) -> list[int]:
    return [int((count == k).sum()) for k in (1, 2, 3, 4)] + [int((count >= 3).sum())]


def sent_blocks(context: np.ndarray, token: np.ndarray, n: np.ndarray, hot: np.ndarray, shards: int) -> list[tuple[int, bytes]]:
    """(shard, block) of sorted distinct bigrams: contexts once with the number of their tokens, tokens, and counts."""
    shard = _shard_of(context, token, hot, shards)
    out = []
    for s, (context, token, n) in by_shard(shard, context, token, n):
        first = np.flatnonzero(np.append(True, context[1:] != context[:-1]))
        out.append((s, packed(context[first], narrow(np.diff(np.append(first, len(context)))), token, narrow(n))))
    return out


def _training(docs: DataFrame) -> DataFrame:
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS
    return documents(docs).where(F.coalesce(fold != HELD_OUT, F.lit(True))).select("text")


def _frequent(training: DataFrame) -> tuple[int, np.ndarray]:
    """The number of tokens, and the hot words. Each task names at most 2 / HOT words, and the sum of those goes to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, token, _ = _pairs(blobs(batch.column("text")))
            word, n = np.unique(token, return_counts=True)
            often = n >= HOT / 2 * len(token)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([word[often].view(np.int64), [0]])), pa.array(np.concatenate([n[often], [len(token)]]))], names=["word", "n"])

    bound_batches(training.sparkSession)
    sums = written(training.mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")), "kn-words")
    total = (sums.where("word = 0").first() or [0, 0])[1]
    hot = np.array([r.word for r in sums.where((F.col("word") != 0) & (F.col("n") >= HOT * total)).collect()], np.int64).view(np.uint64)
    discard(sums)
    return total, hot


def train(docs: DataFrame, folder: str | None = None) -> Model:
    """Count all documents that aren't held out and write the model below folder, by default a new one in the shared folder.

    A null text is an empty one: its end follows its beginning. Rows that repeat count each. Without documents the model knows no word.
    """
    spark, training, folder = docs.sparkSession, _training(docs), folder or fresh_uri(docs.sparkSession, "kn-model")
    total, hot = _frequent(training)
    shards = shard_count(total, SHARD_TOKENS)
    word_shards = max(1, shards // 4)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []

        def sent() -> pa.RecordBatch:
            out = sent_blocks(*_counted(*(np.concatenate(x) for x in zip(*held, strict=True))), hot, shards)
            return pa.RecordBatch.from_arrays([pa.array([s for s, _ in out], pa.int64()), pa.array([b for _, b in out], pa.binary())], names=["shard", "block"])

        for batch in batches:
            context, token, _ = _pairs(blobs(batch.column("text")))
            held.append(_counted(context, token, np.ones(len(token), np.int64)))
            if sum(len(x[0]) for x in held) >= TASK_BIGRAMS:
                yield sent()
                held.clear()
        if held:
            yield sent()

    def merge(group: pa.Table) -> pa.Table:
        shard = group.column("shard")[0].as_py()
        contexts, tokens, counts = [], [], []
        for block in group.column("block"):
            own_context, size, token, n = unpacked(block.as_buffer())
            contexts.append(np.repeat(own_context, size))
            tokens.append(token)
            counts.append(n.astype(np.int64))
        context, token, n = _counted(np.concatenate(contexts), np.concatenate(tokens), np.concatenate(counts))
        key = _key(context, token)
        order = np.argsort(key, kind="stable")
        stats = _by_word(context, n, (n == 1).astype(np.int64), (n == 2).astype(np.int64), (n >= 3).astype(np.int64))
        is_hot = np.isin(stats[0], hot)
        save(folder, f"bigrams-{shard}", key[order], narrow(n[order]), *(x[~is_hot] for x in stats))
        word, total_n, continued = _by_word(token, n, np.ones(len(n), np.int64))
        place = (word >> np.uint64(24)) % np.uint64(word_shards)
        rows = [("words", p, packed(x, narrow(y), narrow(z)), None) for p, (x, y, z) in by_shard(place, word, total_n, continued)]
        rows += [("hot", 0, None, [int(h), *map(int, x)]) for h, x in zip(stats[0][is_hot].view(np.int64), np.stack(stats[1:], axis=1)[is_hot], strict=True)]
        rows.append(("counts", 0, None, [len(n), *_of_counts(n)]))
        return pa.table([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _PART_TYPES, strict=True)], names=["kind", "shard", "block", "numbers"])

    def words(group: pa.Table) -> pa.Table:
        shard = group.column("shard")[0].as_py()
        parts = [unpacked(block.as_buffer()) for block in group.column("block")]
        word, n, continued = _by_word(*(np.concatenate([p[k] for p in parts]).astype(np.uint64 if k == 0 else np.int64) for k in range(3)))
        save(folder, f"words-{shard}", word, narrow(n), narrow(continued))
        return pa.table([pa.array([[len(word), int(n.sum()), *_of_counts(continued)]], pa.list_(pa.int64()))], names=["numbers"])

    bound_batches(spark)
    blocks = training.mapInArrow(count, "shard long, block binary")
    parts = written(blocks.groupBy("shard").applyInArrow(merge, "kind string, shard long, block binary, numbers array<long>"), "kn-parts")

    def sums(rows: DataFrame, n: int) -> list[int]:
        return [x or 0 for x in rows.agg(*(F.sum(F.col("numbers")[k]) for k in range(n))).first()]

    bigrams, *of = sums(parts.where("kind = 'counts'"), 6)
    vocabulary, tokens, *lower = sums(parts.where("kind = 'words'").select("shard", "block").groupBy("shard").applyInArrow(words, "numbers array<long>"), 7)
    contexts = parts.where("kind = 'hot'").groupBy(F.col("numbers")[0]).agg(*(F.sum(F.col("numbers")[k]) for k in range(1, 5))).collect()
    discard(parts)
    low = discounts(lower)
    rest = sum(d * n for d, n in zip(low, (lower[0], lower[1], lower[4]), strict=True)) / bigrams if bigrams else 1.0
    return Model(folder, shards, word_shards, tokens, vocabulary, bigrams, discounts(of), low, rest, [tuple(r) for r in contexts])


_PART_TYPES = [pa.string(), pa.int64(), pa.binary(), pa.list_(pa.int64())]


def _discounted(count: np.ndarray, by: tuple[float, float, float]) -> np.ndarray:
    return np.maximum(count - np.array([0.0, *by])[np.minimum(count, 3)], 0.0)


def probabilities(model: Model, context: np.ndarray, token: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The model's probability of each token after its context, and each token's count in training."""
    key, first, back = np.unique(_key(context, token), return_index=True, return_inverse=True)
    context, token = context[first], token[first]
    hot = np.array(model.hot, np.int64).reshape(-1, 5)
    hot_words = np.sort(hot[:, 0].view(np.uint64)) if len(hot) else np.zeros(0, np.uint64)
    hot = hot[np.argsort(hot[:, 0].view(np.uint64))]
    shard = _shard_of(context, token, hot_words, model.shards)
    count = looked_up(key, shard, lambda s: (mapped(model.folder, f"bigrams-{s}") or [])[:2], 1)[0]

    own, at = np.unique(context, return_inverse=True)
    stats = looked_up(own, _shard_of(own, own, np.zeros(0, np.uint64), model.shards), lambda s: (mapped(model.folder, f"bigrams-{s}") or [])[2:], 4)
    if len(hot):
        place = np.minimum(np.searchsorted(hot_words, own), len(hot) - 1)
        is_hot = hot_words[place] == own
        stats[:, is_hot] = hot[place[is_hot], 1:].T
    total, *numbers = stats[:, at]

    word, at = np.unique(token, return_inverse=True)
    n, continued = looked_up(word, ((word >> np.uint64(24)) % np.uint64(model.word_shards)).astype(np.int64), lambda s: mapped(model.folder, f"words-{s}"), 2)[:, at]
    lower = _discounted(continued, model.lower_discounts) / max(1, model.bigrams) + model.lower_rest / (model.vocabulary + 1)
    rest = sum(d * x for d, x in zip(model.discounts, numbers, strict=True))
    seen = np.maximum(total, 1)
    p = np.where(total > 0, _discounted(count, model.discounts) / seen + rest / seen * lower, lower)
    return p[back], n[back]


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of each row of docs; perplexity is 10 ** (-score / n_tokens).

    A null text is an empty one, of one token, its end. Rows that repeat are each scored; no shuffle.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        m, ids = shared.value, batch.column("doc_id").to_pylist()
        context, token, lengths = _pairs(blobs(batch.column("text")))
        p, n = probabilities(m, context, token)
        release()
        begin = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        base = np.log10((n + 1) / (m.tokens + 1.0 * (m.vocabulary + 1)))
        columns = [batch.column("doc_id"), [held_out(i) for i in ids], lengths, np.add.reduceat((n > 0).astype(np.int64), begin), np.full(len(ids), m.tokens, np.int64), np.add.reduceat(base, begin), np.add.reduceat(np.log10(p), begin)]
        return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in columns], names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return map_batches(documents(docs), kernel, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
