import pytest


@pytest.fixture(scope="session")
def frame(spark):
    def make(rows, schema, parts=2):
        return spark.createDataFrame(rows, schema).repartition(parts)

    return make


@pytest.fixture(scope="session")
def docs(spark, frame):
    """Documents by text, numbered from 0, with columns whose names operators use themselves."""

    def make(*texts, langs=None):
        rows = [(i, t, (langs or {}).get(i, "en"), "src", None if t is None else len(t), i, "x", 0.5) for i, t in enumerate(texts)]
        return frame(rows, "doc_id long, text string, lang string, source string, n_chars long, row long, kind string, node double")

    return make


@pytest.fixture(scope="session")
def real(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


#: Null, empty, no words, separators of other kinds, ties, repeats, one very long word and one very long text.
ODD = [None, "", " \n\t ", "a", "a", "é b c d", "one two three", "one two three", "x" * 300_000, "word " * 60_000, "\x1cA\x1fB \u0085c", "\x00\x01", "𐍈 ẞ ﬁ", "a\r\nb\x0bc\x0cd"]


@pytest.fixture(scope="session")
def odd():
    return ODD
