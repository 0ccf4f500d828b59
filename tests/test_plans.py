"""What the physical plans must and must not contain."""

from __future__ import annotations

import re

import pytest

import __spark_entry__  # noqa: F401 - registers the queries
from tallylake.catalog.registry import QUERIES
from tallylake.operators import retail
from tallylake.sources import lake, listing, views


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_tenant_filter_prunes_partitions(spark, sf, tmp_path):
    path = str(tmp_path / "t")
    lake.partition_overwrite_sink(views.sales(spark, sf), path, ["tenant_id"])
    text = plan(lake.tenant_parquet_scan(spark, path, "tenant_001"))
    assert "PartitionFilters: [isnotnull(tenant_id" in text and "= tenant_001)]" in text


def test_incremental_filter_reaches_the_scan(spark, sf):
    text = plan(retail.updated_since(views.sales(spark, sf), "1999-06-01"))
    assert "GreaterThanOrEqual(o_orderdate,1999-06-01T00:00" in text


def test_link_columns_reach_the_scan(spark, sf):
    assert "ReadSchema: struct<l_orderkey:bigint,l_partkey:bigint,l_suppkey:bigint>" in plan(views.promotion_links(spark, sf))


@pytest.mark.parametrize("name", ["best_promotion", "event_once", "run_drilldown", "latest_diagnosis", "log_tail"])
def test_groups_are_cut_before_the_shuffle(spark, sf, name):
    text = plan(QUERIES[name](spark, sf))
    exchange = text.index("Exchange hashpartitioning")
    assert text.count("WindowGroupLimit") >= 2 and text.rindex("WindowGroupLimit") > exchange


@pytest.mark.parametrize("name", ["dedup_latest", "dedup_items"])
def test_nearly_unique_keys_are_sorted_once(spark, sf, name):
    text = plan(QUERIES[name](spark, sf))
    assert "WindowGroupLimit" not in text and len(re.findall(r"\bSort \[", text)) == 1 and text.count("Exchange hashpartitioning") == 1


@pytest.mark.parametrize("name", ["publish_gate"])
def test_gold_rows_are_not_gathered_by_tenant(spark, sf, name):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", str(64 << 10))
    try:
        text = plan(QUERIES[name](spark, sf))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "hashpartitioning(tenant_id" not in text and "BroadcastHashJoin" in text


@pytest.mark.parametrize("name", ["page", "recent_incidents"])
def test_pages_are_top_k(spark, sf, name):
    assert "TakeOrderedAndProject" in plan(QUERIES[name](spark, sf))


SLOW_TO_BUILD = ("stream_", "lakehouse_run", "run_telemetry", "ingest_all")


@pytest.mark.parametrize("name", [n for n in sorted(QUERIES) if not n.startswith(SLOW_TO_BUILD)])
def test_no_pairing_and_no_row_python(spark, sf, name):
    text = plan(QUERIES[name](spark, sf))
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython"):
        assert bad not in text
    assert ("ArrowEvalPython" in text) == (name == "strip_log_keys")
    assert ("FlatMapCoGroupsInPandas" in text) == (name == "similar_incidents")


def test_gold_joins_share_one_partitioning(spark, sf):
    """Products are shuffled once for all three joins, whose other sides come out of their aggregations in place."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(QUERIES["gold_pricing"](spark, sf))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # links distinct, links and promotions for their join, best promotion; inventory; items and orders for theirs,
    # item de-duplication, totals; products
    assert text.count("Exchange hashpartitioning") == 10


def test_related_incidents_stay_where_they_are(spark, sf):
    """The newest rows per scope go to the incidents: the one exchange is that of the few."""
    text = plan(QUERIES["related_incidents"](spark, sf))
    assert "BroadcastHashJoin" in text and "Exchange hashpartitioning" not in text


def test_entity_orderings_are_whole(spark, sf):
    text = plan(QUERIES["entity_orderings"](spark, sf))
    assert "TakeOrderedAndProject" not in text and "GlobalLimit" not in text


@pytest.mark.parametrize("offset", [0, 1, 99, 700, 1399, 1495, 1500, 5000])
def test_a_deep_page_opens_the_ranges_it_covers(spark, tmp_path, offset):
    orders = spark.range(1500).selectExpr("concat('o', lpad(id, 5, '0')) AS order_id", "'t' AS tenant_id", "timestamp_seconds(id % 40) AS order_date")
    listing.write_list(orders, "sales", str(tmp_path), ranges=15)
    got = listing.read_page(spark, str(tmp_path), "sales", orders.schema, 100, offset)
    want = retail.page(retail.entity_ordering(orders, "sales"), 100, offset).collect()
    assert [r.order_id for r in got.collect()] == [r.order_id for r in want]
    several = re.search(r"_range#\d+ IN \(([\d,]+)\)", plan(got))
    opened = several.group(1).split(",") if several else set(re.findall(r"\(_range#\d+ = (\d+)\)", plan(got)))
    assert len(opened) <= 3 and bool(opened) == (offset < 1500)
