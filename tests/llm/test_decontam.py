import random

import numpy as np
from support import assert_same
from hypothesis import given, settings
from hypothesis import strategies as st

from mosaicflow.llm import decontam as dc
from mosaicflow.llm.queries import OP5_SQL, op5_wu_manber


def test_same_as_sql(spark, sf_dir, duck):
    df = op5_wu_manber(spark, sf_dir)
    assert_same(df, duck, OP5_SQL)
    assert df.where("contaminated").count() > 0


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text("ab ", min_size=1, max_size=40), min_size=1, max_size=12, unique=True), st.text("ab ", max_size=900))
def test_every_occurrence_is_found(patterns, text):
    patterns, data = [p.encode() for p in patterns], text.encode()
    at, number = dc.WuManber(patterns).find(data)
    got = sorted(zip(at.tolist(), number.tolist(), strict=True))
    assert got == sorted((i, k) for k, p in enumerate(patterns) for i in range(len(data)) if data.startswith(p, i))


def test_long_texts_cross_lanes():
    rng = random.Random(1)
    words = [bytes(rng.choices(b"abcdefgh", k=rng.randint(1, 9))) for _ in range(400)]
    text = b" ".join(rng.choice(words) for _ in range(20_000))
    patterns = list({text[i : i + rng.randint(20, 90)] for i in rng.sample(range(len(text) - 100), 300)})
    at, number = dc.WuManber(patterns).find(text)
    expected = set()
    for k, p in enumerate(patterns):
        i = text.find(p)
        while i >= 0:
            expected.add((i, k))
            i = text.find(p, i + 1)
    assert set(zip(at.tolist(), number.tolist(), strict=True)) == expected
    assert dc.WuManber([]).find(b"abc")[0].size == 0 and np.array_equal(dc.WuManber([b"x"]).find(b"")[0], [])


ITEMS = "item_id long, text string, hits long, doc_id long"


def brute(texts, items, size=10):
    out = []
    for t in texts:
        words = dc.words_of((t or "").encode())
        hit, ids = set(), set()
        for item, text in items:
            own = dc.words_of((text or "").encode())
            for w in {tuple(own[i : i + size]) for i in range(max(1, len(own) - size + 1))} if own else ():
                for i in range(len(words) - len(w) + 1):
                    if tuple(words[i : i + len(w)]) == w:
                        hit |= set(range(i, i + len(w)))
                        ids.add(str(item))
        out.append((len(words), len(hit), len(ids)))
    return out


def test_odd_rows_and_blocks(frame, docs, odd):
    texts = [*odd, "A, a; a! b c d e f g h i j k", "One-Two three FOUR", "z a a a b c d e f g h i z"]
    items = [(1, "a a a b c d e f g h i j"), (10, "a a a b c d e f g h i j"), (2, "one two"), (3, None), (4, "!!"), (None, "three"), (5, "x"), (6, "é"), (7, "four")]
    benchmark = frame([(i, t, 1, 2) for i, t in items], ITEMS)
    expected = brute(texts, [x for x in items if x[0] is not None])
    for bound in (dc.BLOCK_BYTES, 8):
        got = sorted(dc.contamination(docs(*texts), benchmark, block_bytes=bound).collect(), key=lambda r: r.doc_id)
        assert [(r.n_words, r.n_hit, r.n_items) for r in got] == expected
        assert [r.contaminated for r in got] == [e[1] > 0 for e in expected]


def test_empty_tables(frame, docs):
    benchmark = frame([(1, "a b", 0, 0)], ITEMS)
    assert dc.contamination(docs("a").limit(0), benchmark).count() == 0
    assert not dc.contamination(docs("a b"), benchmark.limit(0)).first().contaminated


def test_clean_documents(frame, docs):
    table = docs("x a b y", "a c b", None)
    kept = dc.clean_documents(table, frame([(1, "A b", 0, 0)], ITEMS))
    assert kept.columns == table.columns and sorted(r.doc_id for r in kept.collect()) == [1, 2]
