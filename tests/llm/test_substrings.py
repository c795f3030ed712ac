import hashlib
from collections import Counter

import numpy as np
import pytest

from mosaicflow.llm import substrings as sub
from mosaicflow.llm.queries import op10_suffix_sort


def brute(texts):
    counts = Counter(t[i : i + 200] for t in texts for i in range(len(t) - 199))
    out = []
    for t in texts:
        mask = np.zeros(len(t) + 1, np.int64)
        for i in range(len(t) - 199):
            if counts[t[i : i + 200]] > 1:
                mask[i : i + 200] = 1
        edges = np.flatnonzero(np.diff(np.concatenate([[0], mask])))
        out.append(edges.tolist())
    return out


def test_whole_table_against_brute_force(spark, sf_dir, real):
    rows = real.collect()
    spans = dict(zip([r.doc_id for r in rows], brute([r.text.encode() for r in rows]), strict=True))
    got = {r.doc_id: r for r in op10_suffix_sort(spark, sf_dir).collect()}
    for r in rows:
        data, s, g = r.text.encode(), spans[r.doc_id], got[r.doc_id]
        assert (g.n_bytes, g.n_removed, g.n_spans) == (len(data), sum(s[1::2]) - sum(s[::2]), len(s) // 2)
        assert g.kept_sha256 == hashlib.sha256(sub.without(data, s)).hexdigest()
    assert sum(g.n_spans for g in got.values()) > 0


def made(seed):
    rng = np.random.default_rng(seed)
    word = lambda n: "".join(rng.choice(list("abcdé fgh"), n))
    shared = [word(n) for n in (150, 199, 200, 201, 230, 400, 900)]
    texts = [word(rng.integers(0, 400)) + "".join(shared[k] + word(rng.integers(0, 60)) for k in rng.integers(0, 7, rng.integers(0, 4))) for _ in range(40)]
    return [*texts, texts[0], texts[1], shared[5] + shared[5], "x" * 1000, "x" * 199, "ab" * 300, shared[6][100:500], shared[6][300:700]]


@pytest.mark.parametrize("options", [{}, {"group": 1}, {"shard_bytes": 2_000}, {"hash_bits": 6, "shard_bytes": 4_000}, {"hash_bits": 3, "group": 1}])
def test_made_texts(docs, options):
    texts = made(len(options))
    got = {r.doc_id: r for r in sub.repeats(docs(*texts), **options).collect()}
    for i, spans in enumerate(brute([t.encode() for t in texts])):
        assert list(got[i].spans) == spans, i
        assert bytes(got[i].kept) == sub.without(texts[i].encode(), spans)


def test_long_texts_are_cut_without_loss(docs, monkeypatch):
    """A text of more than one part, all of it a copy of the middle of another."""
    rng = np.random.default_rng(4)
    inner = "".join(rng.choice(list("abcdefgh"), sub.PART + 5_000))
    texts = ["start " + inner + " end", inner, "lone " * 10]
    got = {r.doc_id: list(r.spans) for r in sub.repeats(docs(*texts)).collect()}
    assert got[0] == [6, 6 + len(inner)] and got[1] == [0, len(inner)] and got[2] == []


def test_odd_texts(docs, odd):
    table = docs(*odd)
    got = {r.doc_id: r for r in sub.repeats(table).collect()}
    sizes = {i: len((t or "").encode()) for i, t in enumerate(odd)}
    assert {i: r.n_bytes for i, r in got.items()} == sizes
    assert {i for i, r in got.items() if r.spans} == {8, 9} and list(got[8].spans) == [0, sizes[8]]
    assert sub.repeats(table.limit(0)).count() == 0


def test_repeated_rows_are_copies(frame):
    text = "".join(np.random.default_rng(1).choice(list("abcdefgh"), 300))
    rows = sub.repeats(frame([(1, text), (1, text), (2, "z" + text[:150])], "doc_id long, text string")).collect()
    assert sorted((r.doc_id, list(r.spans)) for r in rows) == [(1, [0, 300]), (1, [0, 300]), (2, [])]


def test_clashing_hashes_in_the_sort(monkeypatch):
    """Prefix hashes of three bits, so nearly all comparisons of unequal strings go wrong."""

    class Weak(sub.Hashes):
        def of(self, start, length):
            return super().of(start, length) >> np.uint64(61)

    texts = [t.encode() for t in made(1)]
    x = sub._stretches(texts, 4)
    rows = [(int(t), int(a), int(n), int(k), int(left), texts[t][a : a + n + sub.LENGTH - 1]) for t, a, n, left, k in zip(x.text, x.start, x.n, x.left, x.anchor.view(np.int64), strict=True)]
    rows.sort(key=lambda r: r[3])
    wanted = brute(texts)
    monkeypatch.setattr(sub, "Hashes", Weak)
    found = {}
    for row, start, n in sub._sorted_out(rows):
        found.setdefault(row, []).append((start, n))
    assert [sub._runs(*(np.array(c, np.int64) for c in zip(*found[t], strict=True))) if t in found else [] for t in range(len(texts))] == wanted


def test_suffixes_are_sorted():
    rng = np.random.default_rng(0)
    buffer = rng.integers(97, 99, 3_000).astype(np.uint8)
    buffer[1_500:1_900] = buffer[:400]
    hashes, at = sub.Hashes(buffer), rng.permutation(2_700)[:500]
    size = np.array([1, 2, 7, 200, 290])
    begin = np.cumsum(size) - size
    got = sub.sort_suffixes(hashes, buffer, at, begin, size)
    string = lambda p: bytes(buffer[p : p + sub.LENGTH])
    for b, n in zip(begin, size, strict=True):
        assert sorted(map(string, at[b : b + n])) == [string(p) for p in got[b : b + n]]
