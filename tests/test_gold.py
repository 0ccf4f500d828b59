"""Golden cases of pricing, sales and the gold checks."""

from __future__ import annotations

from decimal import Decimal

import pytest

from tallylake.operators import enrich, quality
from tallylake.plans import gold

D = "2026-06-01"
STAMP = ("p", "r", "2026-06-01T00:00:00Z")
MONEY = "decimal(18,4)"


def product(spark, *rows):
    """(tenant, product, price, tax)"""
    full = [(t, p, "sku", "name", "c", "Cat", "b", "s", Decimal(price), Decimal("50"), "USD", Decimal(tax)) for t, p, price, tax in rows]
    return spark.createDataFrame(full, f"""tenant_id string, product_id string, sku string, product_name string, category_id string,
        category_name string, brand string, supplier_id string, unit_price {MONEY}, cost_price {MONEY}, currency string, tax_rate decimal(5,2)""")


def promo(spark, *rows):
    """(tenant, promotion, type, value, maximum, start, end)"""
    full = [(t, p, "SEASONAL", kind, Decimal(v), None if m is None else Decimal(m), a, b, "ACTIVE") for t, p, kind, v, m, a, b in rows]
    df = spark.createDataFrame(full, f"""tenant_id string, promotion_id string, promotion_type string, discount_type string,
        discount_value {MONEY}, maximum_discount {MONEY}, start_date string, end_date string, status string""")
    return df.withColumns({c: df[c].cast("timestamp") for c in ("start_date", "end_date")})


def links(spark, *rows):
    return spark.createDataFrame(list(rows), "tenant_id string, promotion_id string, product_id string")


def stock(spark, *rows):
    return spark.createDataFrame(list(rows), "tenant_id string, product_id string, quantity_available int")


def items(spark, *rows):
    """(tenant, order, product, quantity, price, line_total)"""
    full = [(t, o, p, q, Decimal(x), Decimal(0), Decimal(0), Decimal(total)) for t, o, p, q, x, total in rows]
    return spark.createDataFrame(full, f"""tenant_id string, order_id string, product_id string, quantity int, unit_price {MONEY},
        discount_amount {MONEY}, tax_amount {MONEY}, line_total {MONEY}""")


def orders(spark, *rows):
    return spark.createDataFrame(list(rows), "tenant_id string, order_id string")


def price(spark, products, lk, promos, inv, it, od):
    totals = enrich.sales_by_product(it, od)
    table = gold.gold_pricing(products, lk, promos, inv, totals, D, *STAMP)
    return {(r.tenant_id, r.product_id): r for r in table.collect()}


T, P = "tenant_001", "prod_001"
YEAR = ("2026-01-01", "2026-12-31")


def test_percentage_promotion(spark):
    rows = price(
        spark, product(spark, (T, P, "100", "10")), links(spark, (T, "m1", P)), promo(spark, (T, "m1", "PERCENTAGE", "20", None, *YEAR)),
        stock(spark, (T, P, 30)), items(spark, (T, "o1", P, 5, "100", "500")), orders(spark, (T, "o1")),
    )
    r = rows[T, P]
    assert r.promotion_applied and r.promotion_id == "m1"
    assert (r.final_price, r.net_price, r.gross_amount, r.discount_amount) == (Decimal(80), Decimal(88), Decimal(500), Decimal(100))
    assert (r.inventory_available, r.quantity_sold) == (30, 5)


def test_no_promotion_and_empty_inputs(spark):
    r = price(spark, product(spark, (T, P, "100", "10")), links(spark), promo(spark), stock(spark), items(spark), orders(spark))[T, P]
    assert not r.promotion_applied and r.final_price == Decimal(100)
    assert (r.discount_amount, r.inventory_available, r.quantity_sold) == (0, 0, 0)


@pytest.mark.parametrize(
    ("kind", "value", "limit", "final"),
    [
        ("FIXED_AMOUNT", "30", None, "70"),
        ("FIXED_AMOUNT", "130", None, "0"),
        ("FIXED_AMOUNT", "30", "12.5", "87.5"),
        ("PERCENTAGE", "50", "20", "80"),
        ("BUY_ONE", "50", None, "100"),
    ],
)
def test_discount_limits(spark, kind, value, limit, final):
    rows = price(
        spark, product(spark, (T, P, "100", "10")), links(spark, (T, "m1", P)), promo(spark, (T, "m1", kind, value, limit, *YEAR)),
        stock(spark), items(spark), orders(spark),
    )
    assert rows[T, P].final_price == Decimal(final)


def test_best_promotion_takes_highest_value_then_lowest_id(spark):
    promos = promo(
        spark, (T, "m3", "PERCENTAGE", "20", None, *YEAR), (T, "m2", "FIXED_AMOUNT", "20", None, *YEAR), (T, "m1", "PERCENTAGE", "10", None, *YEAR)
    )
    lk = links(spark, (T, "m1", P), (T, "m2", P), (T, "m3", P))
    best = enrich.best_promotion(enrich.promo_links_active(lk, promos, D)).collect()
    assert [r.promotion_id for r in best] == ["m2"]


def test_promotion_days_are_inclusive(spark):
    promos = promo(
        spark, (T, "starts", "PERCENTAGE", "1", None, D, "2026-07-01"), (T, "ends", "PERCENTAGE", "1", None, "2026-05-01", D),
        (T, "over", "PERCENTAGE", "1", None, "2026-05-01", "2026-05-31"), (T, "later", "PERCENTAGE", "1", None, "2026-06-02", "2026-07-01"),
    )
    assert {r.promotion_id for r in enrich.active_promotions_on(promos, D).collect()} == {"starts", "ends"}


def test_joins_never_cross_tenants(spark):
    other = "tenant_002"
    rows = price(
        spark, product(spark, (T, P, "100", "10")), links(spark, (other, "m1", P)), promo(spark, (other, "m1", "PERCENTAGE", "20", None, *YEAR)),
        stock(spark, (other, P, 999)), items(spark, (other, "o1", P, 5, "100", "500")), orders(spark, (other, "o1")),
    )
    r = rows[T, P]
    assert (r.inventory_available, r.quantity_sold, r.promotion_applied) == (0, 0, False)


def test_items_of_rejected_orders_and_products_drop_out(spark):
    it = items(spark, (T, "o1", P, 2, "10", "20"), (T, "gone", P, 7, "10", "70"), (T, "o1", "gone", 3, "10", "30"))
    totals = enrich.sales_by_product(it, orders(spark, (T, "o1")), product(spark, (T, P, "100", "10"))).collect()
    assert [(r.product_id, r.quantity_sold) for r in totals] == [(P, 2)]


def test_product_sales_average(spark):
    it = items(spark, (T, "o1", P, 3, "10", "20"))
    totals = enrich.sales_by_product(it, orders(spark, (T, "o1")))
    table = gold.gold_product_sales(product(spark, (T, P, "1", "0"), (T, "unsold", "1", "0")), stock(spark), totals, *STAMP)
    rows = {r.product_id: r for r in table.collect()}
    assert rows[P].average_selling_price == Decimal("6.6667")
    assert (rows["unsold"].average_selling_price, rows["unsold"].total_quantity_sold) == (0, 0)


def test_gold_checks(spark):
    def pricing(*rows):
        return spark.createDataFrame(
            [(t, p, Decimal(f), Decimal(g), Decimal(x)) for t, p, f, g, x in rows],
            f"tenant_id string, product_id string, final_price {MONEY}, gross_amount {MONEY}, discount_amount {MONEY}",
        )

    def failures(df):
        return quality.gold_checks(df).select(quality.gold_failures().alias("texts")).first()["texts"]

    assert failures(pricing((T, P, "1", "10", "2"))) == []
    assert len(failures(pricing((T, P, "-5", "100", "105")))) == 2
    twice = failures(pricing((T, P, "1", "10", "2"), (T, P, "1", "10", "2")))
    assert twice == ["1 duplicate (tenant_id, product_id) business keys"]
    assert len(failures(pricing((None, None, "1", "10", "2")))) == 2
    mixed = pricing((T, P, "-5", "100", "5"), ("tenant_002", P, "5", "100", "5"))
    failed = quality.failing(quality.gold_checks(mixed, "tenant_id")).select("tenant_id")
    assert [r.tenant_id for r in quality.publish_gate(mixed, failed).collect()] == ["tenant_002"]
    assert failures(pricing()) == []
