"""Base columns of operators that SQL can't express whole, and the articles of made pages, against SQL."""

import pytest
from support import assert_same

from mosaicflow.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", ["quality_base_counts", "secret_base_counts", "unigram_base_scores", "op7_wrapper_induction"])
def test_same_as_sql(spark, sf_dir, duck, name):
    assert_same(QUERIES[name](spark, sf_dir), duck, ORACLES[name])


@pytest.mark.parametrize(("op", "base"), [("op1_fertility", "quality_base_counts"), ("op4_assignment_lexing", "secret_base_counts")])
def test_operators_have_the_same_base(spark, sf_dir, op, base):
    """What SQL was held against is what the operator gives."""
    only = QUERIES[base](spark, sf_dir)
    assert sorted(QUERIES[op](spark, sf_dir).select(*only.columns).collect()) == sorted(only.collect())
