"""Typing, cleansing, de-duplication, validation, metrics and the quality gate."""

from __future__ import annotations

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tallylake.operators import cleanse, quality
from tallylake.plans.silver import silver_checked, silver_valid
from tallylake.specs import SCHEMAS, spec


def rows_of(spark, dataset, **values):
    """One row of a dataset as text, sensible values where none are given."""
    base = {}
    for field in spec(dataset).schema:
        kind = field.dataType.simpleString()
        base[field.name] = "2026-01-01" if kind == "timestamp" else "1" if kind != "string" else "x"
    base.update(values)
    return spark.createDataFrame([tuple(base.values())], ", ".join(f"{c} string" for c in base))


def errors(spark, dataset, **values):
    return silver_checked(rows_of(spark, dataset, **values), dataset).first()["validation_errors"]


@pytest.mark.parametrize("dataset", list(SCHEMAS))
def test_a_plain_row_is_valid(spark, dataset):
    assert errors(spark, dataset) == []


@pytest.mark.parametrize(
    ("dataset", "values", "expected"),
    [
        ("products", {"product_name": None}, ["product_name is required"]),
        ("products", {"product_name": " "}, []),
        ("products", {"unit_price": "-10"}, ["unit_price must be >= 0"]),
        ("products", {"unit_price": "-1", "cost_price": "-1", "sku": None}, ["sku is required", "unit_price must be >= 0", "cost_price must be >= 0"]),
        ("products", {"tax_rate": "100.01"}, ["tax_rate must be between 0 and 100"]),
        ("products", {"tax_rate": None}, []),
        ("products", {"tax_rate": "abc"}, ["tax_rate has invalid type"]),
        ("products", {"unit_price": "abc"}, ["unit_price is required", "unit_price has invalid type"]),
        ("sales_items", {"quantity": "0"}, ["quantity must be > 0"]),
        ("sales_items", {"quantity": "many"}, ["quantity is required", "quantity has invalid type"]),
        ("promotions", {"discount_type": " percentage", "discount_value": "150"}, ["percentage discount must be <= 100"]),
        ("promotions", {"discount_type": "FIXED_AMOUNT", "discount_value": "150"}, []),
        ("promotions", {"start_date": "2026-02-01", "end_date": "2026-01-01"}, ["start_date must be <= end_date"]),
        ("suppliers", {"rating": "6.0"}, ["rating must be between 0 and 5"]),
        ("suppliers", {"rating": "12.5"}, ["rating has invalid type"]),
        ("inventory", {"quantity_available": "-1"}, ["quantity_available must be >= 0"]),
    ],
)
def test_messages(spark, dataset, values, expected):
    assert errors(spark, dataset, **values) == expected
    valid = silver_valid(rows_of(spark, dataset, **values), dataset).count()
    assert valid == (0 if expected else 1)


def test_dedup_keeps_the_latest(spark):
    rules = spec("products")
    raw = rows_of(spark, "products", product_id="p1", sku="old", updated_at="2026-09-01").union(
        rows_of(spark, "products", product_id="p1", sku="new", updated_at="2026-09-20")
    ).union(rows_of(spark, "products", product_id="p1", sku="none", updated_at=None))
    typed = cleanse.cast_to_schema(raw, rules)
    assert [r.sku for r in cleanse.dedup_latest(typed, rules).collect()] == ["new"]
    metrics = quality.quality_metrics(silver_checked(raw, "products", "source_copies"), rules).first()
    assert (metrics.input_record_count, metrics.duplicate_record_count, metrics.valid_record_count) == (3, 2, 1)


def test_dedup_without_repeats_and_ties(spark):
    rules = spec("products")
    two = rows_of(spark, "products", product_id="p1").union(rows_of(spark, "products", product_id="p2"))
    assert cleanse.dedup_latest(cleanse.cast_to_schema(two, rules), rules).count() == 2
    tie = rows_of(spark, "products", sku="b").union(rows_of(spark, "products", sku="a")).union(rows_of(spark, "products", tenant_id="y", sku="c"))
    kept = cleanse.dedup_latest(cleanse.cast_to_schema(tie, rules), rules).collect()
    assert sorted(r.sku for r in kept) == ["a", "c"]


def test_links_collapse_and_items_prefer_the_last_ingestion(spark):
    link = rows_of(spark, "promotion_products")
    assert silver_valid(link.union(link), "promotion_products").count() == 1
    item = rows_of(spark, "sales_items", quantity="1").withColumn("ingestion_timestamp", F.lit("2026-01-01"))
    later = rows_of(spark, "sales_items", quantity="9").withColumn("ingestion_timestamp", F.lit("2026-01-02"))
    assert [r.quantity for r in silver_valid(item.union(later), "sales_items").collect()] == [9]


def test_categoricals_and_missing_columns(spark):
    raw = rows_of(spark, "stores", status=" active ").drop("city")
    typed = cleanse.cast_to_schema(raw, spec("stores"))
    assert "city" not in typed.columns
    assert cleanse.normalize_categoricals(typed, spec("stores")).first()["status"] == "ACTIVE"


def test_quarantine_joins_messages(spark):
    raw = rows_of(spark, "products", unit_price="-1", sku=None)
    row = quality.quarantine(silver_checked(raw, "products"), "now", "2026-01-01").first()
    assert row.validation_error == "sku is required; unit_price must be >= 0"
    assert (row.validation_timestamp, row.processing_date) == ("now", "2026-01-01")


def test_metrics_count_kinds_apart(spark):
    raw = rows_of(spark, "products", product_id="a", sku=None).union(rows_of(spark, "products", product_id="b", unit_price="-1")).union(
        rows_of(spark, "products", product_id="c", unit_price="-1", sku=None)
    )
    m = quality.quality_metrics(silver_checked(raw, "products", "source_copies"), spec("products")).first()
    assert (m.invalid_record_count, m.null_violation_count, m.business_rule_violation_count) == (3, 2, 2)


@pytest.mark.parametrize(("bad", "total", "status"), [(10, 100, "SUCCESS"), (11, 100, "FAILED"), (101, 1000, "FAILED"), (0, 0, "SUCCESS")])
def test_gate_allows_exactly_the_limit(spark, bad, total, status):
    metrics = spark.createDataFrame([("d", "t", total, bad)], "dataset string, tenant_id string, input_record_count bigint, invalid_record_count bigint")
    assert quality.invalid_rate_gate(metrics).first()["status"] == status


def test_orphans_per_tenant(spark):
    child = spark.createDataFrame([("t1", "s1"), ("t1", "s2"), ("t2", "s1"), ("t2", "s1"), ("t1", None)], "tenant_id string, supplier_id string")
    parent = spark.createDataFrame([("t1", "s1")], "tenant_id string, supplier_id string")
    found = {r.tenant_id: (r.orphans, r.orphan_keys) for r in quality.orphan_counts(child, spec("products"), {"suppliers": parent}).collect()}
    assert found == {"t1": (1, 1), "t2": (2, 1)}


def test_stage_rollup(spark):
    data = [("r1", "t", "bronze", "SUCCESS"), ("r1", "t", "silver", "SUCCESS"), ("r1", "t", "gold", "SUCCESS"),
            ("r2", "t", "bronze", "SUCCESS"), ("r2", "t", "silver", "FAILED"), ("r2", "t", "silver", "SUCCESS")]
    rows = {r.run_id: r for r in quality.stage_rollup(spark.createDataFrame(data, "run_id string, tenant_id string, stage string, status string")).collect()}
    assert rows["r1"].overall_status == "SUCCESS"
    assert (rows["r2"].silver_status, rows["r2"].gold_status, rows["r2"].overall_status) == ("FAILED", "SKIPPED", "FAILED")


def test_tenant_guard(spark):
    with pytest.raises(ValueError, match="tenant_id"):
        quality.require_tenant_column(spark.range(1))


def test_reconciliation_match(spark):
    order = spark.createDataFrame([("t", "o", *map(Decimal, ("20", "1", "2", "21"))), ("t", "none", *map(Decimal, ("0", "0", "0", "0")))],
                                  "tenant_id string, order_id string, total_amount decimal(18,4), discount_amount decimal(18,4), tax_amount decimal(18,4), net_amount decimal(18,4)")
    item = spark.createDataFrame([("t", "o", 2, Decimal(10), Decimal(1), Decimal(2))],
                                 "tenant_id string, order_id string, quantity int, unit_price decimal(18,4), discount_amount decimal(18,4), tax_amount decimal(18,4)")
    assert all(r.matches for r in quality.order_total_reconciliation(order, item).collect())


def test_sensitive_names(spark):
    df = spark.createDataFrame([(1, 2, 3)], "id int, API_Token int, aws_Secret_key int")
    assert cleanse.drop_sensitive_columns(df).columns == ["id"]


def test_backfill_prefers_legacy_then_default(spark):
    df = spark.createDataFrame([("a", None), (None, None), (None, "p")], "platform_id string, platform string")
    out = cleanse.schema_backfill(df, {"platform_id": F.lit("?"), "status": F.lit("DETECTED")}, {"platform_id": "platform"})
    assert sorted(r.platform_id for r in out.collect()) == ["?", "a", "p"]
    assert {r.status for r in out.collect()} == {"DETECTED"}


def test_explode_takes_the_orders_tenant(spark):
    df = spark.sql("""SELECT 't1' AS tenant_id, 'o1' AS order_id, array(named_struct('order_item_id', 'i', 'tenant_id', 'evil', 'order_id', 'o1')) AS items
                      UNION ALL SELECT 't1', 'o2', array()""")
    assert [(r.tenant_id, r.order_item_id) for r in cleanse.explode_order_items(df).collect()] == [("t1", "i")]
