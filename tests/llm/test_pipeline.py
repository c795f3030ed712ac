import pytest

import corpus_pipeline as cp
from mosaicflow.llm import decontam, fertility, secrets, simhash
from mosaicflow.llm.common import written


def test_stages_one_by_one(spark, sf_dir, real):
    """Each stage keeps and changes just what its rule says, on what the one before kept."""
    docs = real
    labels = {r.doc_id: r for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    for name, stage in cp.STAGES[:-1]:
        before = {r.doc_id: r for r in docs.collect()}
        docs = written(stage(spark, docs, sf_dir), "test-stage")
        assert docs.columns == real.columns
        after = {r.doc_id: r for r in docs.collect()}
        assert set(after) <= set(before) and len(after) == docs.count()
        if name == "quality":
            bpe = fertility.ByteBPE()
            for i, r in before.items():
                base = fertility.base_counts(r.text, r.text.encode())
                ids = bpe.ids(r.text)
                keep = base[0] >= 10 and 100 * base[4] <= 20 * base[0] and fertility.within(r.text, r.lang, len(ids), len(r.text) / max(1, len(ids)), fertility.byte_fallback_share(r.text, len(r.text.encode())), fertility.entropy(ids))
                assert keep == (i in after)
            assert sum(labels[i].quality for i in after if i in labels) >= 0.95 * sum(r.quality for i, r in labels.items() if i in before and len(before[i].text.split()) >= 10)
        elif name == "near_duplicates":
            prints = {i: simhash.fingerprint(r.text.encode()) for i, r in before.items()}
            gone = set(before) - set(after)
            assert gone
            for i in gone:
                assert any((prints[i] ^ prints[j]).bit_count() <= 2 for j in before if j != i)
            kept = sorted(after)
            assert all((prints[a] ^ prints[b]).bit_count() > 2 for k, a in enumerate(kept) for b in kept[:k])
        elif name == "decontamination":
            windows = {w for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect() for w in decontam.windows_of(decontam.words_of(r.text.encode()))}
            for i, r in before.items():
                text = b" " + b" ".join(decontam.words_of(r.text.encode())) + b" "
                assert any(w in text for w in windows) == (i not in after)
        else:
            assert set(after) == set(before)
            for i, r in before.items():
                assert after[i].text == secrets.masked(r.text, secrets.all_spans(r.text)[1]) and after[i].n_chars == len(after[i].text)


def test_run(spark, sf_dir):
    rows = cp.run(spark, sf_dir).collect()
    filled = {}
    for r in rows:
        filled.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in filled.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024


@pytest.mark.parametrize("texts", [[], [None, "", "x"], ["one two three four five six seven eight nine ten eleven"] * 3])
def test_odd_documents(spark, frame, docs, tmp_path, texts):
    table = docs(*texts) if texts else docs("x").limit(0)
    table.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    frame([(1, "unrelated text of a benchmark")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert cp.run(spark, str(tmp_path)).count() == (1 if len(set(texts)) == 1 else 0)


def test_clashing_columns_and_long_texts_through_all_stages(spark, docs, tmp_path):
    """Columns that stages name themselves, and a text of 3 MB with a secret, a benchmark passage in another, and a copy."""
    words = " ".join(f"w{(i * 7919) % 1_000_003}x" for i in range(300_000))
    item = "one passage that stands in the benchmark word for word here"
    texts = [f"{words} password=hunter2hunter2", f"{words} password=hunter2hunter2", f"some words before {item} and some words after it too", "twelve quite plain words are what this text holds and no more"]
    table = docs(*texts, langs=dict.fromkeys(range(4), "xx")).withColumnsRenamed({"row": "hits"}).selectExpr("*", "1 AS n_words", "'y' AS items", "1 AS fp", "2 AS clean_text")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    kept = []
    for _, stage in cp.STAGES[:-1]:
        table = written(stage(spark, table, str(tmp_path)), "test-stage")
        assert table.columns[-4:] == ["n_words", "items", "fp", "clean_text"] and "hits" in table.columns
        kept.append(sorted(r.doc_id for r in table.collect()))
    assert kept[-3:] == [[0, 2, 3], [0, 3], [0, 3]]
    assert {r.doc_id: r.text for r in table.collect()}[0] == f"{words} [secret]"
    pieces = cp.STAGES[-1][1](spark, table, str(tmp_path)).collect()
    assert {r.doc_id for r in pieces} == {0, 3} and sum(r.length for r in pieces) > 300_000
