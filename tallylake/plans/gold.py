"""The two gold tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallylake.functions.pricing import as_money, money_ratio, price_ladder, unit_discount
from tallylake.operators.cleanse import provenance_columns
from tallylake.operators.enrich import (
    best_promotion,
    inventory_available,
    products_best_promo,
    products_inventory,
    products_sales,
    promo_links_active,
)


def gold_pricing(
    products: DataFrame,
    links: DataFrame,
    promotions: DataFrame,
    inventory: DataFrame,
    totals: DataFrame,
    business_date: str,
    pipeline_id: str,
    run_id: str,
    stamp: str,
) -> DataFrame:
    """Price, promotion, stock and sold quantity of every product.

    ``totals`` is the result of ``sales_by_product``; computed once, it also feeds :func:`gold_product_sales`.
    All product-side inputs are reduced to one row per (tenant, product) first, so the joins share one partitioning.
    """
    best = best_promotion(promo_links_active(links, promotions, business_date))
    rows = products_best_promo(products, best)
    rows = products_inventory(rows, inventory_available(inventory))
    rows = products_sales(rows, totals).withColumnRenamed("unit_price", "base_price")
    rows = rows.withColumn("unit_discount", unit_discount())
    rows = rows.drop("gross_amount", "discount_amount").withColumns(price_ladder())
    selected = rows.select(
        "tenant_id", "product_id", "sku", "product_name", "category_id", "category_name", "brand", "supplier_id",
        "base_price", "cost_price", "quantity_sold", "inventory_available", "promotion_applied", "promotion_id",
        "promotion_type", "discount_type", "discount_value", "gross_amount", "discount_amount", "final_price",
        "net_price", "currency",
    )
    return provenance_columns(selected, pipeline_id, run_id, stamp)


def gold_product_sales(
    products: DataFrame, inventory: DataFrame, totals: DataFrame, pipeline_id: str, run_id: str, stamp: str
) -> DataFrame:
    """Quantities and revenue of every product, with the average price it sold at."""
    rows = products_sales(products, totals)
    rows = products_inventory(rows, inventory_available(inventory))
    selected = rows.select(
        "tenant_id", "product_id", "sku", "product_name", "category_name",
        F.col("quantity_sold").alias("total_quantity_sold"),
        as_money(F.col("gross_amount")).alias("gross_revenue"),
        as_money(F.col("discount_amount")).alias("discount_amount"),
        as_money(F.col("net_amount")).alias("net_revenue"),
        money_ratio(F.col("net_amount"), F.col("quantity_sold")).alias("average_selling_price"),
        "inventory_available",
    )
    return provenance_columns(selected, pipeline_id, run_id, stamp)
