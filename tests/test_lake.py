"""Sources, sinks, watermarks and the whole run."""

from __future__ import annotations

import os
import time
from decimal import Decimal

import __spark_entry__ as entry
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallylake.operators import retail
from tallylake.operators import telemetry as tel
from tallylake.operators.cleanse import dedup_latest
from tallylake.plans import medallion
from tallylake.session import release
from tallylake.sources import lake, views
from tallylake.sources.views import BUSINESS_DATE, RETAIL
from tallylake.specs import spec


def ids(rows):
    return sorted(r.product_id for r in rows.collect())


def test_overwrite_replaces_only_touched_partitions(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "tenant_id string, v int")
    lake.partition_overwrite_sink(df, path, ["tenant_id"])
    lake.partition_overwrite_sink(df.filter("tenant_id = 'a'").withColumn("v", F.lit(9)), path, ["tenant_id"], True)
    assert {(r.tenant_id, r.v) for r in lake.tenant_parquet_scan(spark, path).collect()} == {("a", 9), ("b", 2), ("c", 3)}
    lake.append_sink(df.filter("tenant_id = 'b'"), path, ["tenant_id"])
    assert lake.tenant_parquet_scan(spark, path, "b").count() == 2
    lake.full_overwrite_sink(df.limit(1), path)
    assert lake.tenant_parquet_scan(spark, path).count() == 1


def test_latest_status(spark):
    df = spark.createDataFrame([("t", "r1", 9, "SUCCESS"), ("t", "r2", 1, "RUNNING"), ("t", "r2", 2, "FAILED"), ("u", "r0", 1, "SUCCESS")],
                               "tenant_id string, run_id string, written_at int, overall_status string")
    assert {(r.tenant_id, r.run_id, r.status) for r in lake.latest_run_status(df).collect()} == {("t", "r2", "FAILED"), ("u", "r0", "SUCCESS")}
    assert {(r.tenant_id, r.status) for r in lake.latest_run_status(df, "r1").collect()} == {("t", "SUCCESS")}


def test_watermark_moves_to_what_was_read(spark):
    df = spark.sql("SELECT TIMESTAMP'2026-01-05 00:00:00' AS updated_at UNION ALL SELECT TIMESTAMP'2026-01-09 00:00:00'")
    loaded, marks = lake.cdc_load({"a": df, "b": df}, {"a": "2026-01-09", "b": "2026-02-01"}, "2026-01-01")
    got = {r.dataset: (str(r.watermark), r.rows_read) for r in marks.collect()}
    assert got == {"a": ("2026-01-09 00:00:00", 1), "b": ("2026-02-01 00:00:00", 0)}
    assert loaded["a"].count() == 1
    assert lake.cdc_load({"a": df}, {}, "2026-01-01")[0]["a"].count() == 2


def test_increment_with_missing_columns_then_latest_wins(spark):
    old = spark.sql("SELECT 't' AS tenant_id, 'p' AS product_id, 'x' AS sku, TIMESTAMP'2026-01-01 00:00:00' AS updated_at")
    new = spark.sql("SELECT 't' AS tenant_id, 'p' AS product_id, TIMESTAMP'2026-01-02 00:00:00' AS updated_at")
    rows = dedup_latest(lake.merge_increment(old, new), spec("products")).collect()
    assert [(r.sku, r.updated_at.day) for r in rows] == [(None, 2)]


def test_one_failing_dataset_does_not_stop_the_others(spark, tmp_path):
    good = spark.createDataFrame([("t", 1), ("t", 2)], "tenant_id string, v int")
    sources = {"bad": ("s", lambda: spark.read.parquet(str(tmp_path / "nowhere"))), "good": ("s", lambda: good), "late": ("s", lambda: good.withColumn("v", F.expr("v / 0")))}
    status = lake.ingest_all(spark, sources, lambda n, df: lake.append_sink(df, str(tmp_path / n)))
    got = {r.dataset: (r.status, r.records_written, r.error_message is None) for r in status.collect()}
    assert got == {"bad": ("FAILED", 0, False), "good": ("SUCCESS", 2, True), "late": ("FAILED", 0, False)}


def sources_of(spark, sf):
    def nested():
        return retail.transactions_nested(views.sales(spark, sf), views.sales_items(spark, sf))

    readers = {n: (lambda n=n: RETAIL[n](spark, sf)) for n in medallion.BRONZE_DATASETS}
    readers["sales"] = nested
    readers["products"] = lambda: views.raw_products(spark, sf).drop("pipeline_id", "run_id", "source_system", "ingestion_timestamp")
    return {n: ("retail_source", r) for n, r in readers.items()}


def test_whole_run_then_an_increment(spark, sf, tmp_path):
    root = str(tmp_path / "lake")
    run = medallion.Run(root, "p", "20240125_060000_000001", "2024-01-25T06:00:00Z", BUSINESS_DATE, invalid_rate_limit=0.4)
    status = medallion.run_all(spark, run, sources_of(spark, sf))
    assert {(r.tenant_id, r.overall_status) for r in status.collect()} == {(f"tenant_00{n}", "SUCCESS") for n in (1, 2, 3)}
    pricing = spark.read.parquet(f"{root}/gold/pricing")
    valid = medallion.silver_table(spark, run, "products").count()
    assert pricing.count() == valid == spark.read.parquet(f"{root}/gold/product_sales").count() > 0
    metrics = {(r.dataset, r.tenant_id): r for r in spark.read.json(f"{root}/logs/quality").collect()}
    assert all(r.input_record_count == r.duplicate_record_count + r.valid_record_count + r.invalid_record_count for r in metrics.values())
    bad = medallion.silver_table(spark, run, "products", "quarantined")
    assert bad.count() == sum(r.invalid_record_count for (d, _), r in metrics.items() if d == "products")
    assert bad.filter("validation_error IS NULL OR validation_error = ''").count() == 0

    # a second run of the same day ingests one changed product only: the rest must survive
    first = pricing.orderBy("tenant_id", "product_id").first()
    change = retail.where_given(views.products(spark, sf), tenant_id=first.tenant_id, product_id=first.product_id).withColumns({
        "unit_price": F.lit("77.5"), "updated_at": F.lit("2024-06-01T00:00:00Z"), "created_at": F.lit("2024-01-01T00:00:00Z"),
        "cost_price": F.lit("1"), "tax_rate": F.lit("5"),
    })
    again = medallion.Run(root, "p", "20240125_070000_000002", "2024-01-25T07:00:00Z", BUSINESS_DATE, invalid_rate_limit=0.4)
    medallion.run_all(spark, again, {"products": ("retail_source", lambda: change)})
    spark.catalog.clearCache()
    after = spark.read.parquet(f"{root}/gold/pricing")
    assert after.count() == valid
    row = retail.where_given(after, tenant_id=first.tenant_id, product_id=first.product_id).first()
    assert row.base_price == Decimal("77.5")


def test_breached_tenants_publish_no_gold(spark, sf, tmp_path):
    root = str(tmp_path / "strict")
    run = medallion.Run(root, "p", "20240125_060000_000003", "2024-01-25T06:00:00Z", BUSINESS_DATE, invalid_rate_limit=0.0001)
    status = medallion.run_all(spark, run, sources_of(spark, sf)).collect()
    assert {(r.bronze_status, r.silver_status, r.gold_status, r.overall_status) for r in status} == {("SUCCESS", "FAILED", "SKIPPED", "FAILED")}
    assert all(any("invalid rate" in reason for reason in r.silver_failures) and not r.gold_failures for r in status)


def make(root, number, **more):
    return medallion.Run(root, "p", f"20240125_060000_{number:06d}", "2024-01-25T06:00:00Z", BUSINESS_DATE, invalid_rate_limit=0.9, **more)


def numbered_tenants(spark, sf):
    """The sources with tenants 007 and 010, whose names look like numbers."""
    name = F.when(F.col("tenant_id") == "tenant_001", "007").when(F.col("tenant_id") == "tenant_002", "010")
    return {n: (s, lambda read=read: read().withColumn("tenant_id", name).where("tenant_id IS NOT NULL")) for n, (s, read) in sources_of(spark, sf).items()}


def test_tenants_that_look_like_numbers(spark, sf, tmp_path):
    run = make(str(tmp_path / "lake"), 11)
    status = medallion.run_all(spark, run, numbered_tenants(spark, sf)).collect()
    assert {(r.tenant_id, r.overall_status) for r in status} == {("007", "SUCCESS"), ("010", "SUCCESS")}
    assert lake.tenant_parquet_scan(spark, run.path("gold", "pricing"), "007").count() > 0
    events = lake.lake_table(spark, f"{run.root}/telemetry/events")
    ends = {(r.tenant_id, r.status) for r in events.where("event_type = 'PIPELINE_END'").collect()}
    assert ends == {("007", "SUCCESS"), ("010", "SUCCESS")}
    metrics = lake.lake_table(spark, f"{run.root}/telemetry/metrics").where("name = 'silver_input_records' AND tenant_id = '007'")
    assert metrics.count() == len(medallion.SILVER_DATASETS)


def test_a_run_for_one_tenant_lands_that_tenant_only(spark, sf, tmp_path):
    run = make(str(tmp_path / "lake"), 12, tenant_id="tenant_001")
    status = medallion.run_all(spark, run, sources_of(spark, sf)).collect()
    assert [(r.tenant_id, r.overall_status) for r in status] == [("tenant_001", "SUCCESS")]
    for name in medallion.BRONZE_DATASETS:
        assert {r.tenant_id for r in lake.lake_table(spark, run.path("bronze", name)).select("tenant_id").distinct().collect()} == {"tenant_001"}


@pytest.mark.parametrize("empty", ["sales", "promotions"])
def test_an_empty_dataset_is_no_failure(spark, sf, tmp_path, empty):
    run = make(str(tmp_path / "lake"), 13)
    sources = sources_of(spark, sf)
    system, read = sources[empty]
    sources[empty] = (system, lambda: read().limit(0))
    status = medallion.run_all(spark, run, sources).collect()
    assert {(r.tenant_id, r.bronze_status, r.silver_status, r.gold_status) for r in status} == {(f"tenant_00{n}", *["SUCCESS"] * 3) for n in (1, 2, 3)}
    zero = [r for r in spark.read.json(f"{run.root}/logs/quality").collect() if r.dataset == empty]
    assert len(zero) == 3 and all(r.input_record_count == r.valid_record_count == 0 for r in zero)


def test_a_failing_source_and_a_failing_stage_are_statuses(spark, sf, tmp_path, monkeypatch):
    sources = sources_of(spark, sf)
    run = make(str(tmp_path / "lake"), 14)
    broken = {**sources, "stores": ("s", lambda: spark.read.parquet(str(tmp_path / "nowhere")))}
    for r in medallion.run_all(spark, run, broken).collect():
        assert (r.bronze_status, r.silver_status, r.gold_status, r.overall_status) == ("FAILED", "SKIPPED", "SKIPPED", "FAILED") and r.bronze_failures
    monkeypatch.setattr(medallion, "run_gold", lambda *_: 1 / 0)
    again = make(str(tmp_path / "lake"), 15)
    for r in medallion.run_all(spark, again, sources).collect():
        assert (r.silver_status, r.gold_status, r.overall_status) == ("SUCCESS", "FAILED", "FAILED") and r.gold_failures == ["division by zero"]


def test_a_retried_run_leaves_nothing_of_the_first_try(spark, sf, tmp_path):
    run = make(str(tmp_path / "lake"), 16)
    sources = sources_of(spark, sf)
    system, read = sources["stores"]
    sources["stores"] = (system, lambda: read().withColumn("store_id", F.lit(None).cast("string")))
    medallion.run_all(spark, run, sources)
    assert medallion.silver_table(spark, run, "stores", "quarantined").count() > 0
    medallion.run_all(spark, run, {**sources, "stores": (system, read)})
    assert medallion.silver_table(spark, run, "stores", "quarantined").count() == 0
    measured = spark.read.parquet(run.work("quality")).where("dataset = 'stores'").collect()
    assert measured and all(r.duplicate_record_count >= 0 and r.invalid_record_count == 0 for r in measured)


def raw_products(spark, sf, **changes):
    rows = views.raw_products(spark, sf).drop("pipeline_id", "run_id", "source_system", "ingestion_timestamp")
    return rows.withColumns({name: F.lit(value).cast(rows.schema[name].dataType) for name, value in changes.items()})


def bring_up(spark, run, rows=None):
    """Land products and bring their snapshot up to the run."""
    if rows is not None:
        assert medallion.run_bronze(spark, run, {"products": ("s", lambda: rows)}).first().status == "SUCCESS"
    table = medallion.snapshots(run, "products")
    table.write(spark, run.run_id, cast_rows(spark, run))
    return table


def cast_rows(spark, run):
    return lambda after: medallion.silver_cast(medallion.bronze_rows(spark, run, "products", after), "products")


def as_sets(frame):
    return sorted(str(r) for r in frame.collect())


def test_incremental_silver_equals_ranking_all_that_was_landed(spark, sf, tmp_path):
    runs = [make(str(tmp_path / "lake"), n) for n in (21, 22, 23)]
    bring_up(spark, runs[0], raw_products(spark, sf))
    changed = raw_products(spark, sf, updated_at="2024-06-01T00:00:00Z", unit_price="77.5").where("pmod(hash(product_id), 40) = 0")
    new = raw_products(spark, sf, unit_price="-1").where("pmod(hash(product_id), 97) = 1").withColumn("product_id", F.concat(F.lit("new-"), "product_id"))
    older = raw_products(spark, sf, updated_at="2001-01-01T00:00:00Z", unit_price="1").where("pmod(hash(product_id), 30) = 3")
    table = bring_up(spark, runs[1], changed.unionByName(changed.where("pmod(hash(sku), 2) = 0")).unionByName(new).unionByName(older))
    for run in (runs[1], runs[2]):
        if run is runs[2]:  # nothing was landed
            bring_up(spark, run)
        whole = table.merged(spark, None, cast_rows(spark, run))
        got = table.read(spark, run.run_id)
        assert as_sets(got.select(*whole.columns)) == as_sets(whole)
        assert got.where("product_id LIKE 'new-%' AND quality = 'quarantined'").count() == new.count() > 0
    assert medallion.silver_written(spark, runs[0], "products").where("product_id LIKE 'new-%'").isEmpty()


def test_an_increment_reads_its_own_bronze_and_touched_parts_only(spark, sf, tmp_path):
    first, second = make(str(tmp_path / "lake"), 23), make(str(tmp_path / "lake"), 24)
    bring_up(spark, first, raw_products(spark, sf))
    one = raw_products(spark, sf).where("tenant_id = 'tenant_002'").orderBy("product_id").limit(1)
    medallion.run_bronze(spark, second, {"products": ("s", lambda: one)})
    table = medallion.snapshots(second, "products")
    landed = cast_rows(spark, second)(table.base(spark, second.run_id))
    plan = landed._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(run" in plan and f"> {first.run_id}" in plan
    merged = table.merged(spark, first.run_id, cast_rows(spark, second))
    parts = {"/".join(f.split("/")[-4:-1]) for f in merged.inputFiles() if "/silver/" in f}
    assert len(parts) == 1 and next(iter(parts)).startswith(f"version={first.run_id}/tenant_id=tenant_002/bucket=")
    bring_up(spark, second)
    units = table._manifest(spark, second.run_id).collect()
    assert sum(u.folder.startswith(f"version={second.run_id}/") for u in units) == 1 and len(units) == table._manifest(spark, first.run_id).count()


def test_runs_that_failed_or_are_tried_again(spark, sf, tmp_path):
    runs = [make(str(tmp_path / "lake"), n) for n in (31, 32, 33)]
    bring_up(spark, runs[0], raw_products(spark, sf))
    change = raw_products(spark, sf, unit_price="5", updated_at="2024-05-05T00:00:00Z").where("tenant_id = 'tenant_001'")
    medallion.run_bronze(spark, runs[1], {"products": ("s", lambda: change)})  # and nothing after it
    other = raw_products(spark, sf, unit_price="6", updated_at="2024-05-06T00:00:00Z").where("tenant_id = 'tenant_003'")
    table = bring_up(spark, runs[2], other)
    want = as_sets(table.read(spark, runs[2].run_id))
    prices = medallion.silver_table(spark, runs[2], "products").select("tenant_id", F.col("unit_price").cast("double").alias("p")).where("tenant_id <> 'tenant_002'")
    assert {tuple(r) for r in prices.distinct().collect()} == {("tenant_001", 5.0), ("tenant_003", 6.0)}
    assert table.base(spark, runs[0].run_id) is None and table.base(spark, runs[2].run_id) == runs[0].run_id
    bring_up(spark, runs[2], other)
    assert as_sets(table.read(spark, runs[2].run_id)) == want


def test_logs_of_a_run_tried_again_are_replaced(spark, tmp_path):
    records = spark.createDataFrame([("t", "r1", "FAILED"), ("u", "r1", "FAILED"), ("t", "r0", "SUCCESS")], "tenant_id string, run_id string, status string")
    lake.log_record_sink(records, str(tmp_path), "status")
    lake.log_record_sink(records.where("run_id = 'r1'").withColumn("status", F.lit("SUCCESS")), str(tmp_path), "status")
    assert sorted((r.tenant_id, r.run_id, r.status) for r in spark.read.json(f"{tmp_path}/status").collect()) == [
        ("t", "r0", "SUCCESS"), ("t", "r1", "SUCCESS"), ("u", "r1", "SUCCESS")]


def test_one_tenants_failing_source_and_the_telemetry_of_the_run(spark, sf, tmp_path):
    run = make(str(tmp_path / "lake"), 42)
    sources = {**sources_of(spark, sf), ("stores", "tenant_002"): ("s", lambda: spark.read.parquet(str(tmp_path / "nowhere")))}
    status = medallion.run_all(spark, run, sources)
    got = {r.tenant_id: (r.bronze_status, r.silver_status, r.gold_status) for r in status.collect()}
    assert got == {"tenant_001": ("SUCCESS",) * 3, "tenant_002": ("FAILED", "SKIPPED", "SKIPPED"), "tenant_003": ("SUCCESS",) * 3}
    published = lake.lake_table(spark, run.path("gold", "pricing")).select("tenant_id").distinct().collect()
    assert {r.tenant_id for r in published} == {"tenant_001", "tenant_003"}
    events, metrics = (lake.lake_table(spark, f"{run.root}/telemetry/{n}") for n in ("events", "metrics"))
    now = "2024-01-25 06:30:00"
    assert {r.kind: r.arrived > 0 for r in tel.telemetry_arrival(events, metrics, "tallylake", "p", now).collect()} == {"events": True, "metrics": True}
    assert {r.tenant_id: r.latest_status for r in tel.latest_status_by_run(events, now).collect()} == {"tenant_001": "SUCCESS", "tenant_002": "FAILED", "tenant_003": "SUCCESS"}
    kinds = {r.event_type: r.n_events for r in tel.events_by_type(events, now).collect()}
    assert kinds["PIPELINE_START"] == 3 and kinds["PIPELINE_END"] == 2 and kinds["PIPELINE_FAILURE"] == kinds["API_FAILURE"] == kinds["BRONZE_FAILURE"] == 1
    landed = {n: medallion.bronze_rows(spark, run, n).count() for n in medallion.BRONZE_DATASETS}
    per_dataset = {}
    for r in tel.bronze_throughput_ts(metrics, now).collect():
        per_dataset[r.dataset] = per_dataset.get(r.dataset, 0) + int(r.bronze_records_written)
    assert {n: per_dataset.get(n, 0) for n in landed} == landed
    assert sum(r.silver_input_records for r in tel.silver_quality_facets(metrics, now).collect()) > 0
    assert {r.tenant_id for r in tel.gold_health(metrics, now).where("gold_output_records > 0").collect()} == {"tenant_001", "tenant_003"}
    assert tel.latency_ts(metrics, now).where("avg_duration > 0").count() >= 3
    assert [(r.tenant_id, r.dataset, int(r.api_error_count), r.api_failure_events) for r in tel.api_errors(metrics, events, now).collect()] == [("tenant_002", "stores", 1, 1)]
    timeline = tel.run_timeline(events, now).collect()
    assert {r.level for r in timeline} == {"INFO", "ERROR", "WARN"} and timeline[0].run_id == run.run_id
    assert tel.latest_failing_run(events, now).first().run_id == run.run_id
    assert tel.run_impact(metrics, now).count() > 0
    done = tel.records_processed(metrics, now).first()
    assert done.bronze_records_written == sum(landed.values()) and done.silver_valid_records > 0 and done.gold_output_records > 0
    overview = tel.run_overview(events, metrics, now).first()
    assert (overview.total_runs, overview.success_runs, overview.failed_runs) == (3, 2, 1) and overview.avg_duration > 0
    assert {"pipeline_failure", "api_errors"} <= {r.alert for r in tel.alert_conditions(events, metrics).collect()}
    assert {r.check: r.state for r in tel.monitoring_checks(events, metrics, "tallylake", "p", "tenant_001", now).collect()}["metrics_arriving"] == "OK"


def test_logs_of_many_runs_share_files_and_retries_leave_others_alone(spark, tmp_path):
    rows = spark.range(6000).selectExpr("concat('t', id % 2) AS tenant_id", "IF(id = 7, NULL, concat('r+', id % 3000)) AS run_id", "id AS n", "'first' AS status")
    lake.log_record_sink(rows, str(tmp_path / "a+b"), "status")
    lake.log_record_sink(rows.where("n < 2").selectExpr("tenant_id", "'new' AS run_id", "n", "'second' AS status"), str(tmp_path / "a+b"), "status")

    def files():
        return {f"{folder}/{name}" for folder, _, names in os.walk(tmp_path) for name in names if name.startswith("part-")}

    first = files()
    assert len(first) < 6000 / 20
    again = rows.where("n % 3000 IN (5, 7) AND tenant_id = 't1'").withColumns({"status": F.lit("third"), "extra": F.lit("x")})
    lake.log_record_sink(again, str(tmp_path / "a+b"), "status")
    lake.log_record_sink(again, str(tmp_path / "a+b"), "status")
    got = lake.log_records(spark, str(tmp_path / "a+b"), "status", again.schema)
    tried = {tuple(r) for r in again.collect()}
    want = {(*r, None) for r in rows.collect() if not any(r[:2] == t[:2] for t in tried)} | tried | {("t0", "new", 0, "second", None), ("t1", "new", 1, "second", None)}
    assert sorted(map(str, got.collect())) == sorted(str(T.Row(*got.columns)(*r)) for r in want)
    assert len(first - files()) <= 4


def test_nested_records_are_kept_compressed(spark, tmp_path):
    spark.range(2000).selectExpr("IF(id = 3, NULL, id) AS o_orderkey", "7L AS o_custkey", "'O' AS o_orderstatus", "CAST(id AS DOUBLE) AS o_totalprice",
                                 "TIMESTAMP'1998-01-01' AS o_orderdate", "'5-LOW' AS o_orderpriority").write.parquet(str(tmp_path / "orders.parquet"))
    spark.range(9000).selectExpr("id % 1500 AS l_orderkey", "IF(id = 5, NULL, id) AS l_partkey", "1L AS l_suppkey", "CAST(id % 7 AS INT) AS l_linenumber", "CAST(id % 50 AS DOUBLE) AS l_quantity",
                                 "CAST(id AS DOUBLE) AS l_extendedprice", "0.01D AS l_discount", "0.02D AS l_tax").write.parquet(str(tmp_path / "lineitem.parquet"))
    got = entry.queries()["records_to_frame"](spark, str(tmp_path))
    assert {tuple(r) for r in got.groupBy("n_items").count().collect()} == {(6, 1499), (0, 501)} and got.where("order_id IS NULL").count() == 1
    plain = str(tmp_path / "plain")
    retail.transactions_nested(views.sales(spark, str(tmp_path)), views.sales_items(spark, str(tmp_path))).write.json(plain)

    def size(files):
        return sum(os.path.getsize(f.removeprefix("file://").removeprefix("file:")) for f in files)

    assert size(got.inputFiles()) < size(spark.read.text(plain).inputFiles()) / 3


def test_silver_is_shuffled_once_for_ranking_and_writing(spark, sf, tmp_path):
    run = make(str(tmp_path / "lake"), 51)
    medallion.run_bronze(spark, run, {"products": ("s", lambda: raw_products(spark, sf))})
    table = medallion.snapshots(run, "products")
    dealt = table.merged(spark, None, cast_rows(spark, run), dealt=True)
    assert dealt._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    plain = table.merged(spark, None, cast_rows(spark, run))
    assert as_sets(dealt.select(*plain.columns)) == as_sets(plain)
    table.write(spark, run.run_id, cast_rows(spark, run))
    assert as_sets(table.read(spark, run.run_id).select(*plain.columns)) == as_sets(plain)


def test_shuffles_go_between_the_steps_of_a_run(spark, tmp_path):
    def shuffled():
        return sum(".data" in str(f) and "shuffle_" in str(f) for f in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(
            spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()))

    release(spark)
    time.sleep(2)
    before = shuffled()
    spark.range(1000).repartition(4, "id").write.parquet(str(tmp_path / "t"))
    assert shuffled() > before
    release(spark)
    until = time.time() + 20
    while shuffled() > before and time.time() < until:
        time.sleep(0.2)
    assert shuffled() <= before
    assert sorted(n for lane in medallion.SILVER_LANES for n in lane) == sorted(medallion.SILVER_DATASETS)
