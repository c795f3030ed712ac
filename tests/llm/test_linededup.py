import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest
from support import assert_same

from mosaicflow.llm import linededup
from mosaicflow.llm.queries import ORACLES, QUERIES

SPACE = " \t\n\x0b\x0c\r"


def key(line):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(SPACE))


def brute(rows, least_chars, least_docs):
    """(doc_id, n_lines, n_dropped, text) of each row."""
    holders = defaultdict(set)
    for doc_id, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= least_chars:
                holders[key(line)].add(linededup.NO_ID if doc_id is None else doc_id)
    out = []
    for doc_id, text in rows:
        lines, own = (text or "").split("\n"), linededup.NO_ID if doc_id is None else doc_id
        kept = [x for x in lines if len(holders[key(x)]) < least_docs or max(holders[key(x)]) == own]
        out.append((doc_id, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def result(df):
    rows = df.collect()
    assert all(hashlib.sha256(r.text.encode()).hexdigest() == r.kept_sha256 for r in rows)
    for r in rows:
        assert (r.keep is None) == (r.n_dropped == 0) and linededup.kept_lines(r.keep, r.n_lines).sum() == r.n_lines - r.n_dropped
    return sorted(((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in rows), key=repr)


def test_same_as_sql(spark, sf_dir, duck):
    df = QUERIES["op13_line_dedup"](spark, sf_dir)
    assert df.where("n_dropped > 0").count() > 0
    assert_same(df, duck, ORACLES["op13_line_dedup"])


def test_same_as_brute_force(frame, odd):
    rng = random.Random(3)
    pool = [f"line {i} of the pool" for i in range(12)] + ["", " ", "é" * 20, "\tLINE 1 of the pool \r", "Line 2 OF the pool\x0b", "\x1fline 3 of the pool"]
    rows = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randrange(6)))) for i in range(150)]
    rows += [(7, "line 1 of the pool\nown text of seven"), (7, "line 1 of the pool"), (None, "line 1 of the pool\nÄ"), (None, "line 2 of the pool")]
    rows += [(1000 + i, x) for i, x in enumerate(odd)]
    for least_docs in (2, 5):
        got = result(linededup.deduplicated(frame([(*r, "x", 1) for r in rows], "doc_id long, text string, line string, high int", 5), 8, least_docs))
        assert got == sorted(brute(rows, 8, least_docs), key=repr)


def test_empty_table(frame):
    assert linededup.deduplicated(frame([], "doc_id long, text string")).count() == 0
    assert [(r.n_lines, r.n_dropped, r.text) for r in linededup.deduplicated(frame([(None, None)], "doc_id long, text string")).collect()] == [(1, 0, "")]


def test_line_that_every_document_holds(spark, frame):
    """One hash spans many partitions: none of them sees all of it, and only the largest document keeps it."""
    line = "the very same line of every document there is"
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    try:
        rows = [(i, f"{line}\nown line of number {i}, which stands nowhere else\n{line}") for i in range(900)]
        got = {r.doc_id: r for r in linededup.deduplicated(frame(rows, "doc_id long, text string", 4)).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert {i for i, r in got.items() if r.n_dropped == 0} == {899} and all(r.n_dropped == 2 for i, r in got.items() if i < 899)


@pytest.mark.parametrize("seed", range(40))
def test_stream_in_any_cut(seed):
    """Verdicts of sorted lines, cut anywhere into partitions (between documents of a hash) and batches, against counting."""
    rng = random.Random(seed)
    lines = [(h, 0, d, 0, i) for h in range(rng.randrange(1, 6)) for d in rng.sample(range(30), rng.choice([1, 2, 3, 4, 5, 9])) for i in range(rng.randrange(1, 3))]
    lines.sort(key=lambda r: (r[0], r[1], -r[2], r[4]))
    least = rng.choice([1, 2, 3, 5])
    starts = [k for k in range(len(lines)) if k == 0 or lines[k][:3] != lines[k - 1][:3]]
    cuts = sorted({0, len(lines), *rng.sample(starts, min(len(starts), rng.randrange(4)))})
    dropped, opened, edges = set(), [], defaultdict(list)
    for a, b in zip(cuts, cuts[1:], strict=False):
        inner = sorted({a, b, *rng.sample(range(a, b), min(b - a, rng.randrange(5)))})
        batches = [[np.array([r[k] for r in lines[x:y]], t) for k, t in enumerate(linededup._TYPES)] for x, y in zip(inner, inner[1:], strict=False)]
        for out in linededup.stream(iter(batches), least):
            for r in out.to_pylist():
                if r["kind"] == "drop":
                    dropped.add((r["high"], r["doc"], r["line"]))
                elif r["kind"] == "open":
                    opened.append((r["high"], r["doc"], r["line"]))
                else:
                    edges[r["high"]].append((r["documents"], r["doc"]))
    for h, d, i in opened:
        if sum(n for n, _ in edges[h]) >= least and d != max(x for _, x in edges[h]):
            dropped.add((h, d, i))
    docs = defaultdict(set)
    for h, _, d, _, _ in lines:
        docs[h].add(d)
    assert dropped == {(h, d, i) for h, _, d, _, i in lines if len(docs[h]) >= least and d != max(docs[h])}
    if least > 1:
        assert sum(map(len, edges.values())) <= 2 * (len(cuts) - 1)
