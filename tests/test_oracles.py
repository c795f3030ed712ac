"""Registered queries against their SQL, and the driver's contract."""

import pytest
from support import assert_same

import __spark_entry__ as entry
from mosaicflow.plans.registry import ORACLES, QUERIES


@pytest.mark.parametrize("name", list(ORACLES))
def test_same_as_sql(spark, sf_dir, duck, name):
    assert_same(QUERIES[name](spark, sf_dir), duck, ORACLES[name])


@pytest.mark.parametrize("name", [k for k in QUERIES if k not in ORACLES])
def test_rows(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_entry(spark, sf_dir):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(QUERIES) <= set(entry.queries())


def test_fixture_has_both_kinds_of_frames(spark, sf_dir):
    """A check of edge touch must not pass because nothing touches."""
    for name in ("frame_qc_compat", "frame_qc_symmetric"):
        assert {r.edge_touch for r in QUERIES[name](spark, sf_dir).select("edge_touch").distinct().collect()} == {True, False}
    compat, symmetric = (QUERIES[n](spark, sf_dir).where("edge_touch").count() for n in ("frame_qc_compat", "frame_qc_symmetric"))
    assert compat < symmetric


def test_plans_without_shuffle(spark, sf_dir):
    """Beyond dealing out the keys that sheets are made from."""
    for name in ("frame_qc_compat", "shared_scale_placement", "component_table", "resize_frames", "process_sheets", "slug_documents"):
        plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        assert not any(x in plan for x in ("hashpartitioning", "rangepartitioning", "SinglePartition")), name
