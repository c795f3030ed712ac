import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from mosaicflow.llm import components as cp
from mosaicflow.llm import simhash as sh
from mosaicflow.llm.queries import op9_bit_sliced


def slow_fingerprint(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall("[^ \t-\r]+", low)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(nodes, near):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in near:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def brute(prints):
    ids = sorted(prints)
    return groups(ids, [(a, b) for i, a in enumerate(ids) for b in ids[:i] if (prints[a] ^ prints[b]).bit_count() <= 2])


def test_whole_table_against_brute_force(spark, sf_dir, real):
    got = {r.doc_id: r for r in op9_bit_sliced(spark, sf_dir).collect()}
    prints = {r.doc_id: slow_fingerprint(r.text) for r in real.collect()}
    assert {i: r.fingerprint for i, r in got.items()} == {i: f"{p:016x}" for i, p in prints.items()}
    expected = brute(prints)
    assert {i: r.component_id for i, r in got.items()} == expected
    assert len(set(expected.values())) < len(expected)


def test_hash_is_the_engine_s_own(spark):
    row = spark.createDataFrame([("the quick é",)], "s string").select(F.xxhash64("s").alias("h")).first()
    assert row.h % (1 << 64) == xxhash.xxh64_intdigest("the quick é".encode(), 42)


def near_prints(seed, n_groups, size):
    rng = random.Random(seed)
    out = set()
    for _ in range(n_groups):
        x = rng.getrandbits(64)
        for _ in range(size):
            out.add(x)
            for b in rng.sample(range(64), rng.randint(0, 3)):
                x ^= 1 << b
    return sorted(out)


def linked(spark, prints, cell):
    signed = [p - (1 << 64) * (p >> 63) for p in prints]
    nodes = spark.createDataFrame(list(enumerate(signed)), "node long, fp long").repartition(3)
    found = [(r.a, r.b) for r in sh.links(nodes, cell).collect()]
    return groups(range(len(prints)), found), len(found)


@pytest.mark.parametrize("cell", [1024, 7])
def test_links_join_what_is_near(spark, cell):
    prints = near_prints(5, 20, 60)
    got, n = linked(spark, prints, cell)
    assert got == brute(dict(enumerate(prints)))


def test_one_large_bucket(spark):
    """All share three quarters, so half of the buckets hold them all; cells cut them, and links stay few."""
    rng = random.Random(2)
    prints = sorted({0xABCD00000000 | rng.getrandbits(16) for _ in range(1500)})
    for cell in (1024, 100):
        got, n = linked(spark, prints, cell)
        assert got == brute(dict(enumerate(prints)))
    assert n < 40 * len(prints)


def test_near_is_exact():
    rng = np.random.default_rng(0)
    members = rng.integers(0, 2**63, (3, 128), dtype=np.uint64)
    members[:, 1::2] = members[:, ::2] ^ (np.uint64(1) << rng.integers(0, 64, (3, 64)).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, (3, 64)).astype(np.uint64))
    got = set(zip(*(x.tolist() for x in sh.near(members[:, :50].copy(), members)), strict=True))
    assert got == {(b, q, m) for b in range(3) for q in range(50) for m in range(128) if (int(members[b, q]) ^ int(members[b, m])).bit_count() <= 2}
    with pytest.raises(ValueError):
        sh.near(members, members, 3)


def test_odd_texts(docs, odd):
    table = docs(*odd, "x y z", "X Y\tz")
    got = {r.doc_id: r for r in sh.near_duplicates(table).collect()}
    prints = {i: slow_fingerprint(t) for i, t in enumerate([*odd, "x y z", "X Y\tz"])}
    assert {i: r.fp % (1 << 64) for i, r in got.items()} == prints
    assert {i: r.component_id for i, r in got.items()} == brute(prints)
    assert sh.near_duplicates(table.limit(0)).count() == 0


def test_repeated_and_null_ids(frame):
    rows = [(3, "a b c d"), (3, "a b c d"), (5, "a b c d"), (None, "a b c d"), (None, "other words are here"), (7, "q")]
    table = frame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.component_id) for r in sh.near_duplicates(table).collect()), key=str)
    assert got == sorted([(3, 3), (3, 3), (5, 3), (None, 3), (None, None), (7, 7)], key=str)
    assert sorted(r.doc_id for r in sh.one_of_each(table).collect()) == [3, 7]


def test_components_of_chains_and_stars(frame):
    rng = random.Random(0)
    chain = [(i, i + 1) for i in range(100, 220)]
    star = [(500, i) for i in range(501, 620)]
    rest = [(rng.randint(1000, 1100), rng.randint(1000, 1100)) for _ in range(60)]
    edges = chain + star + rest + [(7, 7), (None, 3), (8, None)]
    rng.shuffle(edges)
    got = {r.node: r.root for r in cp.roots(frame(edges, "x long, y long")).collect()}
    real = [(a, b) for a, b in edges if a is not None and b is not None and a != b]
    expected = groups({n for e in real for n in e}, real)
    assert {n: got.get(n, n) for n in expected} == expected
    assert cp.roots(frame([(1, 2)], "x long, y long").limit(0)).count() == 0


def test_one_of_each_of_repeated_ids(frame):
    a, b, c, d, e, f = (" ".join(f"{x}{i}" for i in range(60)) for x in "abcdef")
    rows = [(None, a), (None, a), (None, b), (4, b), (5, c), (5, d), (5, d), (9, c), (1, d), (6, e), (6, f)]
    got = sh.one_of_each(frame([(i, t, 1) for i, t in rows], "doc_id long, text string, one long"))
    assert got.columns == ["doc_id", "text", "one"]
    assert sorted((r.doc_id, r.text) for r in got.collect()) == [(1, d), (4, b), (5, c), (6, e), (6, f)]
