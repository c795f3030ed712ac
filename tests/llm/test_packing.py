import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from mosaicflow.llm import packing as pk
from mosaicflow.llm import tokens
from mosaicflow.llm.queries import op6_best_two_fit

tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="session")
def reference():
    t = tokenizers.Tokenizer.from_file(tokens.file_of("byte_bpe_50k.json"))
    return lambda text: t.encode(text, add_special_tokens=False).ids


def test_ids_are_those_of_the_file(reference, real, odd):
    bpe = tokens.ByteBPE()
    extra = ["<|endoftext|>", "a<|endoftext|> b<|endoftext|>", "it's  12 3 \n\n x y z \x85 \x1c日本 Ⅷ ½ é’s", "﻿", "a" * 400, "tab\t\tx  "]
    for text in [r.text for r in real.limit(40).collect()] + [t for t in odd if t and len(t) < 1000] + extra:
        assert bpe.ids(text).tolist() == reference(text), text[:40]


def test_parts_join_to_the_same_ids(reference):
    text = "the quick  brown fox's\njumps 12 over " * 50
    bpe = tokens.ByteBPE()
    assert len(tokens.parts(text, 100)) > 10 and "".join(tokens.parts(text, 100)) == text
    assert [i for p in tokens.parts(text, 100) for i in bpe.ids(p).tolist()] == reference(text)


def check(rows, texts, reference, sequence=pk.SEQUENCE):
    """Every document's pieces in order and whole; sequences without gaps or overlaps."""
    own, filled = defaultdict(list), defaultdict(list)
    for r in rows:
        own[r.doc_id].append(r)
        filled[r.sequence_id].append((r.offset, r.length))
    for doc_id, text in texts.items():
        ids = [*reference(text or ""), pk.END_ID]
        pieces = sorted(own[doc_id], key=lambda r: r.piece)
        first = len(ids) % sequence or sequence
        expected = [(0, first), *((a, sequence) for a in range(first, len(ids), sequence))]
        assert [(r.piece, r.start, r.length) for r in pieces] == [(k, a, n) for k, (a, n) in enumerate(expected)]
        assert [r.ids_crc32 for r in pieces] == [zlib.crc32(np.array(ids[a : a + n], "<u4").tobytes()) for a, n in expected]
    for parts in filled.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= sequence
    return len(filled)


def test_whole_table(spark, sf_dir, real, reference):
    rows = op6_best_two_fit(spark, sf_dir).collect()
    n = check(rows, {r.doc_id: r.text for r in real.collect()}, reference)
    assert n <= -(-sum(r.length for r in rows) // pk.SEQUENCE) * 1.01 + 1


def test_odd_texts_and_ids(docs, odd, reference):
    table = docs(*odd)
    rows = pk.pack(pk.pieces(table)).collect()
    check(rows, dict(enumerate(odd)), reference)
    assert all(zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 for r in rows)
    assert pk.pack(pk.pieces(table.limit(0))).count() == 0


def test_repeated_rows_are_packed_each(frame):
    rows = pk.pack(pk.pieces(frame([(1, "same text"), (1, "same text"), (None, "x")], "doc_id long, text string"))).collect()
    assert Counter(r.doc_id for r in rows) == {1: 2, None: 1} and len({(r.sequence_id, r.offset) for r in rows}) == 3


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=80))
def test_plans_hold_all_pieces(lengths):
    bins = pk.plan(dict(Counter(lengths)), 64)
    used = Counter()
    for times, own in bins:
        assert times > 0 and sum(own) <= 64
        for x in own:
            used[x] += times
    assert used == Counter(lengths)


def test_two_for_the_smallest():
    """A greedy bin of 60 and 30 leaves 10; two of 21 and 19 in place of the 30 leave none."""
    assert (1, [60, 21, 19]) in pk.plan({60: 1, 30: 1, 21: 1, 19: 1}, 100)


def test_plan_size_is_bounded():
    rng = np.random.default_rng(0)
    few, many = (len(pk.plan({x: int(n) * k for x, n in enumerate(rng.integers(1, 50, 1024), 1)})) for k in (10, 100_000))
    assert max(few, many) < 8_000


def test_near_the_lower_bound():
    rng = np.random.default_rng(1)
    lengths = np.clip(rng.lognormal(5.5, 1.0, 50_000).astype(int), 1, 1024)
    assert sum(t for t, _ in pk.plan(dict(Counter(lengths.tolist())))) <= lengths.sum() / 1024 * 1.003 + 1
