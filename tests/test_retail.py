"""Filters, lookups, paging and nesting."""

from __future__ import annotations

from decimal import Decimal

from tallylake.operators import retail
from tallylake.sources import views


def test_optional_criteria(spark):
    df = spark.createDataFrame([("a", "Paris", "X"), ("b", "PARIS", "Y"), ("c", None, "X")], "customer_id string, city string, customer_segment string")
    assert retail.filter_customers(df).count() == 3
    assert retail.filter_customers(df, city="paris").count() == 2
    assert [r.customer_id for r in retail.filter_customers(df, segment="X", city="paris").collect()] == ["a"]
    assert retail.filter_customers(df, segment="").count() == 3


def test_low_stock(spark, sf):
    rows = retail.low_stock(views.inventory(spark, sf)).collect()
    assert rows and all(r.quantity_available <= r.reorder_level for r in rows)


def test_lookup_of_another_tenant_finds_nothing(spark):
    df = spark.createDataFrame([("t1", "p")], "tenant_id string, product_id string")
    wanted = spark.createDataFrame([("t2", "p")], "tenant_id string, product_id string")
    assert retail.lookup(df, wanted, ["tenant_id", "product_id"]).count() == 0


def test_pages_cover_the_list_once(spark, sf):
    orders = views.sales(spark, sf)
    ordered = retail.entity_ordering(orders, "sales")
    expected = [r.order_id for r in ordered.collect()]
    seen, offset = [], 0
    while True:
        info = retail.page_info(orders, 700, offset).first()
        rows = [r.order_id for r in retail.page(ordered, 700, offset).collect()]
        assert info.record_count == len(rows)
        seen += rows
        offset += 700
        if not info.has_more:
            break
    assert seen == expected
    assert retail.page_info(orders, 99999, -5).first()["page_limit"] == 1000
    assert retail.page_info(orders, 0, 0).first()["page_limit"] == 1
    assert retail.page_info(orders, 10, 10**6).first()["record_count"] == 0


def test_ranks_number_the_whole_list(spark, sf):
    orders = views.sales(spark, sf)
    expected = [r.order_id for r in retail.entity_ordering(orders, "sales").collect()]
    ranked = sorted((r["rank"], r["order_id"]) for r in retail.entity_ranks(orders, "sales").collect())
    assert len(expected) > 100 and ranked == list(enumerate(expected, 1))
    assert retail.entity_ranks(orders.limit(0), "sales").count() == 0


def test_dates_are_inclusive_and_updates_too(spark):
    df = spark.sql("""SELECT 'a' AS order_id, 's' AS store_id, 'x' AS order_status, TIMESTAMP'2026-01-01 00:00:00' AS order_date, TIMESTAMP'2026-01-05 00:00:00' AS updated_at
                      UNION ALL SELECT 'b', 's', 'x', TIMESTAMP'2026-01-02 00:00:00', TIMESTAMP'2026-01-06 00:00:00'""")
    assert retail.orders_by_filters(df, date_from="2026-01-01", date_to="2026-01-02").count() == 2
    assert [r.order_id for r in retail.orders_by_filters(df, since="2026-01-06").collect()] == ["b"]
    plain = df.withColumn("updated_at", df.updated_at.cast("timestamp_ntz"))
    assert [r.order_id for r in retail.updated_since(plain, "2026-01-06T02:00:00+02:00").collect()] == ["b"]
    assert retail.updated_since(plain, "2026-01-06T00:00:00.000001Z").count() == 0


def test_transactions_keep_orders_without_items(spark):
    orders = spark.createDataFrame([("t", "o1"), ("t", "o2")], "tenant_id string, order_id string")
    items = spark.createDataFrame([("t", "o1", "b"), ("t", "o1", "a"), ("u", "o2", "x")], "tenant_id string, order_id string, order_item_id string")
    rows = {r.order_id: [i.order_item_id for i in r["items"]] for r in retail.transactions_nested(orders, items).collect()}
    assert rows == {"o1": ["a", "b"], "o2": []}


def test_shared_keys(spark):
    a = spark.createDataFrame([("x",), ("y",)], "k string")
    assert [r.k for r in retail.shared_keys(a, spark.createDataFrame([("y",), ("z",)], "k string"), "k").collect()] == ["y"]


def test_category_average_ignores_missing_prices(spark):
    df = spark.createDataFrame([("c", "p1", Decimal(1), Decimal(1)), ("c", "p2", Decimal(2), None), ("c", "p3", None, Decimal(3))],
                               "category_name string, product_id string, unit_price decimal(18,4), cost_price decimal(18,4)")
    row = retail.category_summary(df).first()
    assert (row.product_count, row.avg_price, row.total_cost) == (3, Decimal("1.5"), Decimal(4))


def test_an_order_of_very_many_items_is_cut_into_chunks(spark):
    items = spark.range(20_000).selectExpr("'t' AS tenant_id", "CASE WHEN id < 19000 THEN 'huge' ELSE concat('o', id % 300) END AS order_id", "id AS order_item_id", "1 AS quantity")
    items = items.unionByName(items.where("order_item_id < 10"))  # rows repeated in full
    orders = items.select("tenant_id", "order_id").distinct().unionByName(spark.createDataFrame([("t", "empty")], "tenant_id string, order_id string"))
    chunks = retail.transactions_chunked(orders, items, 500, 16).toPandas()
    assert chunks["n_items"].max() == 500 and (chunks["items"].map(len) == chunks["n_items"]).all()
    huge = chunks[chunks["order_id"] == "huge"]
    assert sorted(huge["chunk"]) == list(range(39)) and sorted(i["order_item_id"] for part in huge["items"] for i in part) == sorted([*range(19_000), *range(10)])
    assert chunks[chunks["order_id"] == "empty"][["chunk", "n_items"]].values.tolist() == [[0, 0]]
    assert chunks["n_items"].sum() == 20_010
