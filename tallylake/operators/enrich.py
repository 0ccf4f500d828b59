"""Joins and aggregates behind the gold tables. Every key starts with the tenant.

Join strategy is left to Spark: table statistics and AQE pick broadcast, shuffled-hash or sort-merge at run time, so
nothing here breaks when a side grows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallylake.operators.cleanse import first_per_key
from tallylake.operators.quality import require_tenant_column

# the selective column leads, because sorting compares the first bytes of the first column and tenant ids look alike
PRODUCT = ["product_id", "tenant_id"]
ORDER = ["order_id", "tenant_id"]
PROMOTION = ["promotion_id", "tenant_id"]


def active_promotions_on(promotions: DataFrame, business_date: str) -> DataFrame:
    """ACTIVE promotions whose first and last day enclose the business date (both inclusive)."""
    on = F.lit(business_date).cast("date")
    return promotions.filter(
        (F.col("status") == "ACTIVE") & (F.to_date("start_date") <= on) & (F.to_date("end_date") >= on)
    )


def promo_links_active(links: DataFrame, promotions: DataFrame, business_date: str) -> DataFrame:
    """Product links of the promotions that are active on the business date."""
    require_tenant_column(links, promotions)
    active = active_promotions_on(promotions, business_date).select(
        "tenant_id", "promotion_id", "promotion_type", "discount_type", "discount_value", "maximum_discount"
    )
    return links.select("tenant_id", "promotion_id", "product_id").join(active, PROMOTION)


def best_promotion(active_links: DataFrame) -> DataFrame:
    """Highest discount_value per product (percentages and amounts compare as plain numbers), then lowest id."""
    return first_per_key(active_links, ["tenant_id", "product_id"], [F.col("discount_value").desc(), F.col("promotion_id").asc()])


def products_best_promo(products: DataFrame, best: DataFrame) -> DataFrame:
    require_tenant_column(products, best)
    return products.join(best, PRODUCT, "left").withColumn("promotion_applied", F.col("promotion_id").isNotNull())


def inventory_available(inventory: DataFrame) -> DataFrame:
    return inventory.groupBy(*PRODUCT).agg(F.sum("quantity_available").alias("inventory_available"))


def products_inventory(products: DataFrame, available: DataFrame) -> DataFrame:
    require_tenant_column(products, available)
    joined = products.join(available, PRODUCT, "left")
    return joined.withColumn("inventory_available", F.coalesce("inventory_available", F.lit(0).cast("bigint")))


def items_of_known_orders(items: DataFrame, orders: DataFrame) -> DataFrame:
    """Items whose order survived silver. Orders are unique, so a semi join equals the inner join and carries no columns."""
    require_tenant_column(items, orders)
    return items.join(orders.select(*ORDER), ORDER, "left_semi")


def items_of_known_products(items: DataFrame, products: DataFrame) -> DataFrame:
    require_tenant_column(items, products)
    return items.join(products.select(*PRODUCT), PRODUCT, "left_semi")


def sales_totals(items: DataFrame) -> DataFrame:
    return items.groupBy(*PRODUCT).agg(
        F.sum("quantity").alias("quantity_sold"),
        F.sum(F.col("quantity") * F.col("unit_price")).alias("gross_amount"),
        F.sum("discount_amount").alias("discount_amount"),
        F.sum("line_total").alias("net_amount"),
    )


def sales_by_product(items: DataFrame, orders: DataFrame, products: DataFrame | None = None) -> DataFrame:
    """Sales per product of accepted orders.

    The product check runs on the totals, not on the items: same rows, but the large table is shuffled for the order
    join and its aggregation only. Callers that join the totals to products anyway pass no products.
    """
    totals = sales_totals(items_of_known_orders(items, orders))
    return totals if products is None else items_of_known_products(totals, products)


def products_sales(products: DataFrame, totals: DataFrame) -> DataFrame:
    """Products with their sales totals, 0 where nothing was sold."""
    require_tenant_column(products, totals)
    joined = products.join(totals, PRODUCT, "left")
    return joined.withColumns({
        c: F.coalesce(c, F.lit(0).cast(totals.schema[c].dataType))
        for c in ("quantity_sold", "gross_amount", "discount_amount", "net_amount")
    })
