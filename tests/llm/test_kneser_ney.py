import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from mosaicflow.llm import arrays
from mosaicflow.llm import kneser_ney as kn


def words_of(text):
    return [w.decode("utf-8", "replace") for w in (text or "").encode().lower().split()] + ["</s>"]


class Plain:
    """The same model in dictionaries of words."""

    def __init__(self, texts):
        self.bigrams, self.words = Counter(), Counter()
        for t in texts:
            before = "<s>"
            for w in words_of(t):
                self.bigrams[before, w] += 1
                self.words[w] += 1
                before = w
        self.tokens, self.vocabulary = sum(self.words.values()), len(self.words)
        self.continued = Counter(w for _, w in self.bigrams)
        self.after = defaultdict(list)
        for (u, _), c in self.bigrams.items():
            self.after[u].append(c)
        n_of = lambda counts: [sum(c == k for c in counts) for k in (1, 2, 3, 4)]
        self.high, self.low = kn.discounts(n_of(self.bigrams.values())), kn.discounts(n_of(self.continued.values()))
        self.lower_rest = sum(self.low[min(c, 3) - 1] for c in self.continued.values()) / max(1, len(self.bigrams))
        self.rest = {u: sum(self.high[min(c, 3) - 1] for c in counts) / sum(counts) for u, counts in self.after.items()}

    def lower(self, w):
        n = len(self.bigrams)
        if not n:
            return 1 / (self.vocabulary + 1)
        c = self.continued[w]
        return (max(0, c - self.low[min(c, 3) - 1]) if c else 0) / n + self.lower_rest / (self.vocabulary + 1)

    def p(self, u, w):
        if u not in self.after:
            return self.lower(w)
        total, c = sum(self.after[u]), self.bigrams[u, w]
        return (max(0, c - self.high[min(c, 3) - 1]) if c else 0) / total + self.rest[u] * self.lower(w)

    def score(self, text):
        before, out = "<s>", 0.0
        for w in words_of(text):
            out += math.log10(self.p(before, w))
            before = w
        return out

    def base(self, text):
        return sum(math.log10((self.words[w] + 1) / (self.tokens + self.vocabulary + 1)) for w in words_of(text))


def check(table, texts):
    model = Plain([t for i, t in texts.items() if i is None or zlib.crc32(str(i).encode()) % 7 != 2])
    got = kn.score(table, kn.train(table)).collect()
    assert len(got) == len(texts)
    for r in got:
        text = texts[r.doc_id]
        assert r.held_out == kn.held_out(r.doc_id) and r.train_tokens == model.tokens
        assert (r.n_tokens, r.n_known) == (len(words_of(text)), sum(model.words[w] > 0 for w in words_of(text)))
        assert r.base_score == pytest.approx(model.base(text), rel=1e-9, abs=1e-9)
        assert r.score == pytest.approx(model.score(text), rel=1e-9, abs=1e-9)
    return model


def test_whole_table_against_dictionaries(real, monkeypatch):
    monkeypatch.setattr(kn, "SHARD_TOKENS", 5_000)
    texts = {r.doc_id: r.text for r in real.collect()}
    model = check(real, texts)
    for u in ("the", "<s>", "never seen"):
        assert sum(model.p(u, w) for w in model.words) + model.p(u, "never seen") == pytest.approx(1)
    held = [i for i in texts if kn.held_out(i)]
    assert sum(model.score(texts[i]) for i in held) > sum(model.base(texts[i]) for i in held)


def test_odd_texts(docs, odd):
    check(docs(*odd), dict(enumerate(odd)))


def test_empty_and_untrained(docs, frame):
    assert kn.score(docs("a").limit(0), kn.train(docs("a").limit(0))).count() == 0
    only_held = frame([(i, "a b") for i in range(200) if kn.held_out(i)], "doc_id long, text string")
    row = kn.score(only_held, kn.train(only_held)).first()
    assert (row.train_tokens, row.n_known, row.base_score, row.score) == (0, 0, 0.0, 0.0)


def test_null_ids_and_repeats(frame):
    rows = [(None, "a b a b c"), (1, "a b"), (1, "a b")]
    got = kn.score(frame(rows, "doc_id long, text string"), kn.train(frame(rows, "doc_id long, text string"))).collect()
    assert len(got) == 3 and len({r.score for r in got if r.doc_id == 1}) == 1 and not next(r for r in got if r.doc_id is None).held_out


def test_discounts():
    assert kn.discounts([0, 0, 0, 0]) == (0.0, 0.0, 0.0)
    assert kn.discounts([4, 0, 0, 0])[0] == 1.0
    y = 10 / 20
    assert kn.discounts([10, 5, 2, 1]) == (1 - 2 * y * 5 / 10, 2 - 3 * y * 2 / 5, 3 - 4 * y * 1 / 2)


def test_array_files(tmp_path):
    a, b = np.arange(5, dtype=np.uint64), np.array([1.5, 2.5])
    arrays.save(str(tmp_path), "x", a, b)
    got = arrays.mapped(str(tmp_path), "x")
    assert np.array_equal(got[0], a) and np.array_equal(got[1], b) and isinstance(got[0].base, np.memmap | memoryview | np.ndarray)
    found = arrays.looked_up(np.array([4, 9, 0], np.uint64), np.array([0, 0, 1]), lambda s: [a, a * np.uint64(10)] if s == 0 else None, 1)
    assert found.tolist() == [[40, 0, 0]]
