"""Plan guards: scale properties of the registered queries that must not regress."""
import pytest

import __spark_entry__ as E

SF = "/root/testdata/sf0.01"
# queries with an oracle are guarded in test_oracle.py (one execution for both); the training-data queries in their own folder
OTHERS = sorted(n for n in set(E.queries()) - set(E.oracle_sql()) if not n.startswith("op") and n != "pipeline")


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def guard(df) -> None:
    p = plan(df)
    assert "BatchEvalPython" not in p          # no row-at-a-time Python UDF
    assert "CartesianProduct" not in p         # no all-pairs join
    assert "CoalesceExec" not in p and "Coalesce 1" not in p    # nothing drawn into one task


@pytest.mark.parametrize("name", OTHERS)
def test_plans_of_queries_without_an_oracle(spark, name):
    guard(E.queries()[name](spark, SF))


def test_no_unpartitioned_window_over_rows():
    """Windows without a key stand only on aggregated frames (regions, segments, one row per range)."""
    import pathlib
    import re
    root = pathlib.Path(E.__file__).parent / "cohortlab"
    for f in [*root.glob("operators/*.py"), *root.glob("plans/*.py"), *root.glob("functions/*.py")]:
        assert not re.search(r"Window\.orderBy\(", f.read_text()), f


def test_snapshot_filter_reaches_scan(spark):
    df = E.queries()["snapshot_order_status"](spark, SF)
    p = df._jdf.queryExecution().executedPlan().toString()
    assert "LessThanOrEqual(o_orderdate" in p  # pushed into the Parquet reader


def test_closure_selection_pushed_and_pruned(spark):
    p = plan(E.queries()["parse_type"](spark, SF))
    assert "EqualTo(p_brand,Brand#1)" in p
    assert "l_comment" not in p and "l_extendedprice" not in p   # lineitem scan reads only used columns
