"""Tenant isolation and physical-plan properties on the driver tables."""

from __future__ import annotations

import pytest
from conftest import SF_SMALL, TODAY
from pyspark.sql import functions as F

from tallyspark.operators import reports as R
from tallyspark.sources import fixtures as fx
from tallyspark.sources.driver import DriverTables


def _rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_single_shop_equals_filtered_all_shop_result(spark):
    t = DriverTables(spark, SF_SMALL)
    shop = 3
    all_shops = R.restock_recommendations(fx.products(t), fx.sales(t), TODAY).where(F.col("shop_id") == shop)
    one = R.restock_recommendations(R.for_shop(fx.products(t), shop), R.for_shop(fx.sales(t), shop), TODAY)
    assert _rows(all_shops) == _rows(one)
    b_all = R.customer_balances(fx.customers(t), fx.debts(t)).where(F.col("shop_id") == shop)
    b_one = R.customer_balances(R.for_shop(fx.customers(t), shop), R.for_shop(fx.debts(t), shop))
    assert _rows(b_all) == _rows(b_one)


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_reports_stay_in_the_jvm(spark):
    t = DriverTables(spark, SF_SMALL)
    for df in (
        R.restock_recommendations(fx.products(t), fx.sales(t), TODAY),
        R.top_selling_products(fx.sales(t)),
        R.customer_balances(fx.customers(t), fx.debts(t)),
        R.dashboard_metrics(fx.shops(t), fx.products(t), fx.sales(t), TODAY),
    ):
        plan = _plan(df)
        assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan


def test_scans_are_pruned_and_filters_pushed(spark):
    t = DriverTables(spark, SF_SMALL)
    plan = _plan(R.restock_recommendations(fx.products(t), fx.sales(t), TODAY))
    li = [line for line in plan.splitlines() if "FileScan parquet" in line and "lineitem" in line]
    assert li, plan
    assert all("l_comment" not in line and "l_receiptdate" not in line for line in li)
    assert any("PushedFilters: [IsNotNull(l_shipdate)" in line or "l_shipdate" in line.split("PushedFilters")[1]
               for line in li)


def test_the_tenant_filter_reaches_a_written_ledger(spark):
    from datetime import timedelta

    from tallyspark.schemas import SALES
    from tallyspark.session import scratch_path
    from tallyspark.sources import sinks

    path = scratch_path(spark, "ledger-tenant")
    sinks.write_ledger(fx.sales(DriverTables(spark, SF_SMALL)), path, "sale_date")
    week = sinks.read_ledger(spark, path, SALES, "sale_date", TODAY - timedelta(days=6), TODAY)
    one = R.for_shop(week, 3)
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    plan = _plan(one)
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    pushed = plan.split("PushedFilters")[1]
    assert "EqualTo(shop_id,3)" in pushed and "GreaterThanOrEqual(sale_date" in pushed
    assert "1998-06" in plan.split("PartitionFilters")[1].split("PushedFilters")[0]
    direct = R.for_shop(fx.sales(DriverTables(spark, SF_SMALL)), 3)
    want = direct.where(F.col("sale_date").between(F.lit(TODAY - timedelta(days=6)), F.lit(TODAY)))
    assert _rows(one) == _rows(want.select(*one.columns))


def test_an_unshared_checkpoint_folder_is_refused(spark):
    from tallyspark import session

    assert session.is_machine_local("file:/a/b") and session.is_machine_local("/a") and not session.is_machine_local("s3a://x/y")

    class Conf(dict):
        def get(self, key, default=None):
            return dict.get(self, key, default)

    class Cluster:
        conf = Conf({"spark.sql.warehouse.dir": "file:/home/me/spark-warehouse"})
        sparkContext = type("C", (), {"master": "yarn"})

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.ensure_checkpoint_dir(Cluster())


def test_top_k_is_a_window_group_limit(spark):
    t = DriverTables(spark, SF_SMALL)
    plan = _plan(R.top_selling_products(fx.sales(t), 10))
    assert "WindowGroupLimit" in plan


def test_no_cross_joins_and_python_only_in_the_fold(spark):
    from tallyspark.plans import QUERIES

    fold_keys = {"apply_payments", "apply_sales", "apply_sales_stock", "apply_stock_timeline", "timeline_stock"}
    fold_keys |= {"sales_stock_stamps"}
    renames = {"update_outcomes", "update_products"}  # time stamps need no names: pruned there
    for key, fn in QUERIES.items():
        plan = _plan(fn(spark, SF_SMALL))
        assert "BroadcastNestedLoopJoin" not in plan and "CartesianProduct" not in plan, key
        assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan, key
        assert ("MapInArrow" in plan) == (key in fold_keys), key
        assert ("MapInPandas" in plan) == (key in renames), key


def test_no_window_over_a_whole_shop(spark):
    """Unbounded lists and rankings of whole batches get their positions from partition sizes."""
    from tallyspark.plans import QUERIES

    for key in ("answer_low_stock", "insert_products", "upsert_customers"):
        plan = _plan(QUERIES[key](spark, SF_SMALL))
        assert "row_number" not in plan and "WindowGroupLimit" not in plan, key
    plan = _plan(QUERIES["assistant_answers"](spark, SF_SMALL))
    assert "WindowGroupLimit" in plan


def test_a_callers_profile_prunes_the_folders_of_a_written_ledger(spark):
    from tallyspark.plans import QUERIES

    df = QUERIES["rls_caller_sales_stored"](spark, SF_SMALL)
    plan = _plan(df)
    part = plan.split("PartitionFilters")[1].split("PushedFilters")[0]
    assert "dynamicpruning" in part and "shop_bucket" in part
    assert df.count() > 0


def test_sales_fold_is_tenant_isolated(spark):
    from tallyspark.operators import ledger as L

    t = DriverTables(spark, SF_SMALL)
    shop = 7
    all_shops = L.apply_sales(fx.products(t), fx.sale_commands(t)).where(F.col("shop_id") == shop)
    one = L.apply_sales(R.for_shop(fx.products(t), shop), R.for_shop(fx.sale_commands(t), shop))
    assert _rows(all_shops) == _rows(one)
