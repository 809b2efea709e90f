"""Plan-shape checks: no cartesian products, no unexpected single-partition
exchanges, filters and column pruning reach the parquet scan."""

import pytest

from shelfwise.plans.registry import QUERIES, load_all

load_all()

# Single-partition exchanges are expected only for final global aggregates,
# global limits/top-k and the small bucket-base window of WIN-02.
SINGLE_PARTITION_OK = {"win02_rate_limit_audit_address", "srt01_top_rated", "srt02_page", "srt02_page_average", "srt02_page_average_desc", "agg06_recent_creates_total", "win02_rate_limit_audit",
                       "val01_check_constraints", "jon06_orphans", "dml03_cascade_counts", "src02_insert_users"}
def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(n for n in QUERIES if not n.startswith("str0") or n.endswith("_batch")))
def test_plan_shape(spark, sf_dir, name):
    plan = _plan(QUERIES[name](spark, sf_dir))
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan, plan
    if name not in SINGLE_PARTITION_OK:
        assert "SinglePartition" not in plan, plan


def test_cutoff_pushes_into_scan(spark, sf_dir):
    from pyspark.sql import functions as F
    from shelfwise.sources.tables import view
    df = view(spark, sf_dir, "sessions").filter(F.col("user_id") == 3)
    plan = df._jdf.queryExecution().executedPlan().toString()
    pushed = plan[plan.index("PushedFilters"):]
    assert "EqualTo(user_id,3)" in pushed and "click)" in pushed


def test_scan_prunes_columns(spark, sf_dir):
    plan = _plan(QUERIES["jon02_list_functions"](spark, sf_dir))
    assert "ReadSchema: struct<doc_id:bigint,lang:string>" in plan


def test_one_scan_for_a_whole_search(spark, sf_dir):
    for name in ("set01_search_library", "prj04_highlight"):
        assert _plan(QUERIES[name](spark, sf_dir)).count("FileScan parquet") <= 2, name      # documents and part


def test_row_rules_share_a_scan(spark, sf_dir):
    plan = _plan(QUERIES["val01_violating_rows"](spark, sf_dir))
    assert plan.count("FileScan parquet") <= 14, plan.count("FileScan parquet")
