import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from mosaicflow.llm import alignment
from mosaicflow.llm.queries import QUERIES


@pytest.fixture(scope="module")
def both():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def byte_letters():
    """The letter that stands for each byte in byte-level vocabularies: itself where it is visible, else the next free one from 256 on."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in seen]
    return {chr(b): b for b in seen} | {chr(256 + i): b for i, b in enumerate(rest)}


def brute(rows, both):
    """Rows of the contract, token by token."""
    a, b = both
    letters, out, counts = byte_letters(), [], Counter()
    for doc_id, text in rows:
        links, groups, ids, pieces = [], [], [], []
        if text:
            data = (" " + text).encode()
            e = a.encode(" " + text, add_special_tokens=False)
            ids = [(i, bytes(letters[c] for c in t)) for i, t in zip(e.ids, e.tokens, strict=True)]
            pieces = [(i, bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()) for i in b.encode(text)]
            if b"".join(t for _, t in ids) != data or b"".join(t for _, t in pieces) != data:
                ids, pieces = [], []
        ends_a, ends_b, at = [], [], 0
        for _, t in ids:
            ends_a.append(at := at + len(t))
        at = 0
        for _, t in pieces:
            ends_b.append(at := at + len(t))
        begin = 0
        for cut in sorted(set(ends_a) & set(ends_b)):
            own = [[i for (i, _), e in zip(x, ends, strict=True) if begin < e <= cut] for x, ends in ((ids, ends_a), (pieces, ends_b))]
            groups.append("|".join(",".join(map(str, x)) for x in own))
            links.append((own[0][-1], own[1][-1]))
            begin = cut
        counts.update(links)
        out.append((doc_id, len(ids), len(pieces), len(groups), links, ";".join(groups)))
    most = Counter()
    for (_, y), n in counts.items():
        most[y] = max(most[y], n)
    return sorted((d, n, m, g, len(k), sum(counts[p] == most[p[1]] for p in k), sum(counts[p] for p in k), hashlib.sha256(t.encode()).hexdigest() if n else "") for d, n, m, g, k, t in out)


def result(df):
    return sorted((r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in df.collect())


@pytest.fixture(scope="module")
def whole(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def short(text):
    """Brute force compares every token with every cut."""
    return text if text is None or len(text) < 3000 else text[:3000]


def test_same_as_brute_force(spark, frame, whole, both, monkeypatch):
    rows = [(r.doc_id, short(r.text)) for r in whole.collect()]
    df = frame(rows, "doc_id long, text string", 3)
    assert result(alignment.alignments(df)) == brute(rows, both)


def test_query(spark, sf_dir, whole):
    got = QUERIES["op11_token_alignment"](spark, sf_dir)
    rows = got.collect()
    assert len(rows) == whole.count() and all(0 < r.n_groups == r.n_links <= min(r.n_a, r.n_b) and r.n_best <= r.n_links <= r.count_sum for r in rows)


def test_odd_texts(frame, odd, both):
    rows = list(enumerate([x if x is None or len(x) < 5000 else x[:400] for x in odd] + ["<|endoftext|> and <s> </s>", "a▁b", "<0x41>", "ﬁ Å", "\u0000", "日本語 \U0001f600", " two  spaces ", "same same", "same same"]))
    df = frame([(*r, 1, "p", 2) for r in rows], "doc_id long, text string, block long, kind string, n long")
    assert result(alignment.alignments(df, with_groups=True)) == brute(rows, both)
    assert all((hashlib.sha256(r.groups.encode()).hexdigest() if r.n_a else "") == r.groups_sha256 for r in alignment.alignments(df).where("groups IS NOT NULL").collect())


def test_long_texts(frame, odd):
    got = alignment.alignments(frame(list(enumerate(odd)), "doc_id long, text string")).collect()
    assert len(got) == len(odd) and sum(r.n_a > 1000 for r in got) == 2


def test_empty_table(frame):
    assert alignment.alignments(frame([], "doc_id long, text string")).count() == 0
    assert [r.n_a for r in alignment.alignments(frame([(None, None), (None, "")], "doc_id long, text string")).collect()] == [0, 0]


def test_small_blocks(frame, both, monkeypatch):
    """Every batch is a block of its own, and counts still cover all."""
    rows = [(i, f"the same words and number {i % 7} of them") for i in range(60)]
    monkeypatch.setattr(alignment, "BLOCK_PAIRS", 1)
    monkeypatch.setattr(alignment, "ROW_PAIRS", 3)
    assert result(alignment.alignments(frame(rows, "doc_id long, text string", 5))) == brute(rows, both)


def test_tokens_without_bytes():
    """Tokens of no bytes end where the one before does, so one end links more than one pair."""
    x = alignment.aligned(np.array([1, 2, 3]), np.array([7, 8, 9]), np.array([2, 0, 3]), np.array([2, 0, 3]))
    assert list(zip(x.link_a, x.link_b, strict=True)) == [(0, 0), (0, 1), (1, 0), (1, 1), (2, 2)] and x.n_groups == 2
    assert alignment.groups_text(x, alignment._decimal(10)) == b"1,2|7,8;3|9"
