import hashlib
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from support import assert_same

from mosaicflow.llm import merkle
from mosaicflow.llm.queries import ORACLES, QUERIES

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, tree string, pos long, node string, total long"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(doc_id, text, lang, source, n_chars):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def proof(nodes, at):
    """The root over nodes and the siblings of one of them: (digest or None, whether the node is right)."""
    path = []
    while len(nodes) > 1:
        beside = at ^ 1
        path.append((nodes[beside] if beside < len(nodes) else None, at % 2 == 1))
        nodes, at = [h(*nodes[i : i + 2]) for i in range(0, len(nodes), 2)], at // 2
    return nodes[0], path


def brute(rows):
    """(doc_id, leaf, subroot, root, path) of every row."""
    trees = {}
    for r in rows:
        trees.setdefault(b"" if r[2] is None else b"=" + r[2].encode(), []).append((r[0] is not None, r[0] or 0, leaf(*r[:5]), r[0]))
    order = sorted(trees)
    trees = {k: sorted(v, key=lambda x: x[:3]) for k, v in trees.items()}
    subroots = [proof([x[2] for x in trees[k]], 0)[0] for k in order]
    out = []
    for i, k in enumerate(order):
        root, outer = proof(subroots, i)
        for j, (_, _, node, doc_id) in enumerate(trees[k]):
            out.append((doc_id, node, subroots[i], root, proof([x[2] for x in trees[k]], j)[1] + outer))
    return out


def result(df):
    return [(r.doc_id, r.leaf, r.subroot, r.root, list(zip(r.siblings, r.right, strict=True))) for r in df.collect()]


def test_same_as_sql(spark, sf_dir, duck):
    df = QUERIES["op12_merkle_manifest"](spark, sf_dir)
    assert {r.verified for r in df.select("verified").distinct().collect()} == {True, False}
    assert_same(df, duck, ORACLES["op12_merkle_manifest"])


@pytest.mark.parametrize("bits", [1, 2, 10])
def test_same_as_brute_force(frame, odd, bits):
    """Trees of many tiers, of one leaf, of null and odd languages; repeated ids and rows; columns with names of our own."""
    rng = random.Random(bits)
    rows = [(i, f"text {i}", rng.choice(["en", "en", "en", "de", "Ü", "\U00010300", "", None]), "s", i) for i in range(37)]
    rows += [(100 + i, x, "odd", None, None) for i, x in enumerate(odd)] + [(5, "again", "en", "s", 1), (5, "again", "en", "s", 1), (None, None, None, None, None), (None, "x", "en", "é", -3), (7, "alone", "one", "s", 5)]
    docs = frame([(*r, "t", 1, "n", 2) for r in rows], COLUMNS, 3)
    made = merkle.build(docs, bits, {"tampered": merkle.leaf(n_chars=F.col("n_chars") + 1)})
    df = merkle.proofs(made, bits, "tampered string")
    assert sorted(result(df), key=repr) == sorted(brute(rows), key=repr)
    back = df.select("leaf", "root", "tampered", merkle.folded(F.col("leaf"), F.col("siblings"), F.col("right")).alias("back"), merkle.folded(F.col("tampered"), F.col("siblings"), F.col("right")).alias("other")).collect()
    assert all(r.back == r.root and (r.other == r.root) == (r.tampered == r.leaf) for r in back)


def test_few_rows(frame):
    assert merkle.proofs(merkle.build(frame([], COLUMNS))).count() == 0
    one = merkle.proofs(merkle.build(frame([(1, "a", "en", "s", 1, "", 0, "", 0)], COLUMNS))).first()
    assert one.leaf == one.subroot == one.root == leaf(1, "a", "en", "s", 1) and one.siblings == []


def test_one_language_is_many_tasks(frame):
    made = merkle.build(frame([(i, "x", "en", "s", 1, "", 0, "", 0) for i in range(300)], COLUMNS), 4)
    assert [t.count() for t in made.lower] == [300, 19, 2, 1]


def test_engine():
    nodes = [h(str(i)) for i in range(5)]
    block = pa.table({"pos": pa.array(range(16, 21)), "node": nodes})
    assert merkle.block_root(block, 3) == proof(nodes, 0)[0]
    assert merkle.block_root(block, 5) == h(h(proof(nodes, 0)[0]))
    got = merkle.block_paths(block, 3).to_pylist()
    assert [list(zip(r["siblings"], r["right"], strict=True)) for r in got] == [proof(nodes, i)[1] for i in range(5)]
