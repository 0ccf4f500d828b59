"""Retail list queries, enrichment joins and the gold tables: inventory rows F1-F11, J1-J11, A1-A5, A9-A10, G1, T1-T2, U3, C1-C3, C16."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallylake.catalog.registry import query
from tallylake.catalog.views_sql import MONEY, VIEWS, columns_of, ratio
from tallylake.functions import pricing, text
from tallylake.operators import enrich, quality, retail, telemetry
from tallylake.plans import gold, medallion
from tallylake.plans.silver import silver_valid
from tallylake.operators.cleanse import dedup_items, normalize_categoricals
from tallylake.session import shared_dir
from tallylake.sources import listing, views
from tallylake.sources.lake import lake_table, tenant_parquet_scan
from tallylake.sources.views import BUSINESS_DATE, PIPELINE_ID, RETAIL, RUN_ID, STAMP
from tallylake.specs import KEYS, spec

PROVENANCE = f"'{PIPELINE_ID}' AS pipeline_id, '{RUN_ID}' AS run_id, '{STAMP}' AS transformation_timestamp"

# --- gold inputs on the oracle side ----------------------------------------------------------------------------------

VIEWS["v_active_promotions"] = f"""
SELECT * FROM v_valid_promotions WHERE status = 'ACTIVE' AND CAST(start_date AS DATE) <= DATE '{BUSINESS_DATE}' AND CAST(end_date AS DATE) >= DATE '{BUSINESS_DATE}'"""
VIEWS["v_active_links"] = """
SELECT tenant_id, promotion_id, product_id, promotion_type, discount_type, discount_value, maximum_discount
FROM v_promotion_products JOIN v_active_promotions USING (tenant_id, promotion_id)"""
VIEWS["v_best"] = """
SELECT * FROM v_active_links QUALIFY row_number() OVER (PARTITION BY tenant_id, product_id ORDER BY discount_value DESC, promotion_id) = 1"""
VIEWS["v_available"] = """
SELECT tenant_id, product_id, CAST(sum(quantity_available) AS BIGINT) AS inventory_available FROM v_valid_inventory GROUP BY ALL"""
VIEWS["v_known_items"] = "SELECT * FROM v_valid_sales_items SEMI JOIN v_valid_sales USING (tenant_id, order_id)"
VIEWS["v_totals"] = """
SELECT tenant_id, product_id, CAST(sum(quantity) AS BIGINT) AS quantity_sold, sum(quantity * CAST(unit_price AS DECIMAL(38,4))) AS gross_amount,
  sum(discount_amount) AS discount_amount, sum(line_total) AS net_amount
FROM v_known_items SEMI JOIN v_valid_catalog USING (tenant_id, product_id) GROUP BY ALL"""
VIEWS["v_priced"] = f"""
SELECT *, CASE WHEN NOT promotion_applied THEN 0 ELSE CAST(least(CASE discount_type
      WHEN 'PERCENTAGE' THEN CAST(CAST(base_price AS DECIMAL(38,4)) * discount_value * CAST(0.01 AS DECIMAL(3,2)) AS DECIMAL(38,9))
      WHEN 'FIXED_AMOUNT' THEN CAST(discount_value AS DECIMAL(38,9)) ELSE 0 END, base_price, maximum_discount) AS {MONEY}) END AS unit_discount
FROM (SELECT p.* EXCLUDE (unit_price), unit_price AS base_price, promotion_id, promotion_type, discount_type, discount_value, maximum_discount,
        promotion_id IS NOT NULL AS promotion_applied, coalesce(inventory_available, 0) AS inventory_available,
        coalesce(quantity_sold, 0) AS quantity_sold
      FROM v_valid_catalog p LEFT JOIN v_best USING (tenant_id, product_id) LEFT JOIN v_available USING (tenant_id, product_id)
      LEFT JOIN v_totals USING (tenant_id, product_id))"""
VIEWS["v_gold_pricing"] = f"""
SELECT tenant_id, product_id, sku, product_name, category_id, category_name, brand, supplier_id, base_price, cost_price, quantity_sold,
  inventory_available, promotion_applied, promotion_id, promotion_type, discount_type, discount_value,
  CAST(quantity_sold * CAST(base_price AS DECIMAL(38,4)) AS {MONEY}) AS gross_amount,
  CAST(quantity_sold * CAST(unit_discount AS DECIMAL(38,4)) AS {MONEY}) AS discount_amount,
  CAST(base_price - unit_discount AS {MONEY}) AS final_price,
  CAST(CAST(base_price - unit_discount AS DECIMAL(38,4)) * (1 + tax_rate * CAST(0.01 AS DECIMAL(3,2))) AS {MONEY}) AS net_price,
  currency, {PROVENANCE}
FROM v_priced"""


def clean(spark: SparkSession, d: str, name: str) -> DataFrame:
    """Valid silver rows of a view whose keys are unique already (only order items still repeat)."""
    rows = normalize_categoricals(RETAIL[name](spark, d), spec(name))
    if name == "sales_items":
        rows = dedup_items(rows.select(
            "tenant_id", "order_item_id", "order_id", "product_id", "quantity", "unit_price", "discount_amount", "tax_amount", "line_total"
        ), spec(name))
    return quality.valid_only(rows, spec(name))


def totals(spark: SparkSession, d: str) -> DataFrame:
    return enrich.sales_by_product(clean(spark, d, "sales_items"), clean(spark, d, "sales"))


def pricing_table(spark: SparkSession, d: str) -> DataFrame:
    return gold.gold_pricing(
        clean(spark, d, "products"), RETAIL["promotion_products"](spark, d), clean(spark, d, "promotions"),
        clean(spark, d, "inventory"), totals(spark, d), BUSINESS_DATE, PIPELINE_ID, RUN_ID, STAMP,
    )


def active_links(spark: SparkSession, d: str) -> DataFrame:
    return enrich.promo_links_active(RETAIL["promotion_products"](spark, d), clean(spark, d, "promotions"), BUSINESS_DATE)


# --- F: filters ------------------------------------------------------------------------------------------------------

_SCOPED = ("products", "sales", "inventory", "promotions", "suppliers", "customers", "stores", "categories")


@query("tenant_scope", "F1", " UNION ALL ".join(
    f"SELECT '{n}' AS entity, {KEYS[n][1]} AS id FROM v_{n} WHERE tenant_id = 'tenant_001'" for n in _SCOPED))
def _(spark: SparkSession, d: str) -> DataFrame:
    return views.union_all([
        retail.tenant_scope(RETAIL[n](spark, d), "tenant_001").select(F.lit(n).alias("entity"), F.col(KEYS[n][1]).alias("id"))
        for n in _SCOPED
    ])


@query("filter_products", "F2", f"SELECT {columns_of('products')} FROM v_products WHERE category_id = 'cat_promo' AND status = 'INACTIVE'")
def _(spark: SparkSession, d: str) -> DataFrame:
    return retail.filter_products(views.products(spark, d), category_id="cat_promo", status="INACTIVE")


@query("filter_suppliers", "F3", f"SELECT {columns_of('suppliers')} FROM v_suppliers WHERE status = 'INACTIVE'")
def _(spark: SparkSession, d: str) -> DataFrame:
    return retail.filter_suppliers(views.suppliers(spark, d), "INACTIVE")


@query("filter_customers", "F4", f"""
    SELECT {columns_of('customers')} FROM v_customers WHERE customer_segment = ' building' AND lower(city) = 'nation_7'""")
def _(spark: SparkSession, d: str) -> DataFrame:
    return retail.filter_customers(views.customers(spark, d), segment=" building", city="Nation_7")


@query("filter_stores", "F5", f"SELECT {columns_of('stores')} FROM v_stores WHERE store_type = 'WAREHOUSE' AND status = 'ACTIVE'")
def _(spark: SparkSession, d: str) -> DataFrame:
    return retail.filter_stores(views.stores(spark, d), store_type="WAREHOUSE", status="ACTIVE")


@query("filter_promotions", "F6", f"SELECT {columns_of('promotions')} FROM v_promotions WHERE status = 'ACTIVE' AND promotion_type = 'SEASONAL'")
def _(spark: SparkSession, d: str) -> DataFrame:
    return retail.filter_promotions(views.promotions(spark, d), "ACTIVE", "SEASONAL")


@query("filter_inventory", "F7", f"SELECT {columns_of('inventory')} FROM v_inventory WHERE location_id = 'loc_1'")
def _(spark: SparkSession, d: str) -> DataFrame:
    return retail.filter_inventory(views.inventory(spark, d), location_id="loc_1")


@query("low_stock", "F8", f"SELECT {columns_of('inventory')} FROM v_inventory WHERE quantity_available <= reorder_level")
def _(spark: SparkSession, d: str) -> DataFrame:
    return retail.low_stock(views.inventory(spark, d))


@query("orders_by_filters", "F9", f"""
    SELECT {columns_of('sales')} FROM v_sales WHERE order_status = 'PENDING' AND order_date >= TIMESTAMP '1996-01-01'
      AND order_date <= TIMESTAMP '1998-12-31' AND updated_at >= TIMESTAMP '1996-06-01'""")
def _(spark: SparkSession, d: str) -> DataFrame:
    return retail.orders_by_filters(
        views.sales(spark, d), status="PENDING", date_from="1996-01-01", date_to="1998-12-31", since="1996-06-01"
    )


@query("active_promotions_on", "F10", f"""
    SELECT {columns_of('promotions')} FROM v_promotions WHERE status = 'ACTIVE' AND CAST(start_date AS DATE) <= DATE '{BUSINESS_DATE}'
      AND CAST(end_date AS DATE) >= DATE '{BUSINESS_DATE}'""")
def _(spark: SparkSession, d: str) -> DataFrame:
    return enrich.active_promotions_on(views.promotions(spark, d), BUSINESS_DATE)


@query("point_lookup", "F11", f"SELECT {columns_of('customers')} FROM v_customers SEMI JOIN v_sales USING (tenant_id, customer_id)")
def _(spark: SparkSession, d: str) -> DataFrame:
    return retail.lookup(views.customers(spark, d), views.sales(spark, d), ["tenant_id", "customer_id"])


# --- J: joins --------------------------------------------------------------------------------------------------------


@query("promo_links_active", "J1", "SELECT * FROM v_active_links")
def _(spark: SparkSession, d: str) -> DataFrame:
    return active_links(spark, d)


@query("products_best_promo", "J2", f"""
    SELECT {columns_of('products')}, promotion_id, promotion_type, discount_type, discount_value, maximum_discount,
      promotion_id IS NOT NULL AS promotion_applied FROM v_valid_catalog LEFT JOIN v_best USING (tenant_id, product_id)""")
def _(spark: SparkSession, d: str) -> DataFrame:
    return enrich.products_best_promo(clean(spark, d, "products"), enrich.best_promotion(active_links(spark, d)))


@query("products_inventory", "J3", """
    SELECT tenant_id, product_id, coalesce(inventory_available, 0) AS inventory_available FROM v_valid_catalog LEFT JOIN v_available USING (tenant_id, product_id)""")
def _(spark: SparkSession, d: str) -> DataFrame:
    products = clean(spark, d, "products").select("tenant_id", "product_id")
    return enrich.products_inventory(products, enrich.inventory_available(clean(spark, d, "inventory")))


@query("items_orders", "J4", f"SELECT {columns_of('sales_items')} FROM v_known_items")
def _(spark: SparkSession, d: str) -> DataFrame:
    return enrich.items_of_known_orders(clean(spark, d, "sales_items"), clean(spark, d, "sales"))


@query("items_products", "J5", f"SELECT {columns_of('sales_items')} FROM v_known_items SEMI JOIN v_valid_catalog USING (tenant_id, product_id)")
def _(spark: SparkSession, d: str) -> DataFrame:
    items = enrich.items_of_known_orders(clean(spark, d, "sales_items"), clean(spark, d, "sales"))
    return enrich.items_of_known_products(items, clean(spark, d, "products"))


@query("products_sales", "J6", f"""
    SELECT tenant_id, product_id, coalesce(quantity_sold, 0) AS quantity_sold, CAST(coalesce(gross_amount, 0) AS {MONEY}) AS gross_amount,
      CAST(coalesce(discount_amount, 0) AS {MONEY}) AS discount_amount, CAST(coalesce(net_amount, 0) AS {MONEY}) AS net_amount
    FROM v_valid_catalog LEFT JOIN v_totals USING (tenant_id, product_id)""")
def _(spark: SparkSession, d: str) -> DataFrame:
    rows = enrich.products_sales(clean(spark, d, "products").select("tenant_id", "product_id"), totals(spark, d))
    return rows.withColumns({c: pricing.as_money(F.col(c)) for c in ("gross_amount", "discount_amount", "net_amount")})


@query("orders_with_product", "J7", f"""
    SELECT {columns_of('sales')} FROM v_sales SEMI JOIN (SELECT tenant_id, order_id FROM v_sales_items
      SEMI JOIN (SELECT * FROM v_products WHERE status = 'INACTIVE' AND brand = 'Brand#2') USING (tenant_id, product_id)) USING (tenant_id, order_id)""")
def _(spark: SparkSession, d: str) -> DataFrame:
    wanted = retail.where_given(views.products(spark, d), status="INACTIVE", brand="Brand#2")
    return retail.orders_with_products(views.sales(spark, d), views.sales_items(spark, d), wanted)


@query("promotions_of_product", "J8", """
    SELECT DISTINCT tenant_id, product_id, promotion_id, promotion_name, p.status FROM v_promotion_links
    SEMI JOIN v_products USING (tenant_id, product_id) JOIN v_promotions p USING (tenant_id, promotion_id)""")
def _(spark: SparkSession, d: str) -> DataFrame:
    rows = retail.promotions_of_products(views.promotions(spark, d), views.promotion_links(spark, d), views.products(spark, d))
    return rows.select("tenant_id", "product_id", "promotion_id", "promotion_name", "status")


@query("transactions_nested", "J9", """
    SELECT o.tenant_id, o.order_id, o.net_amount, coalesce(items, '') AS items FROM v_sales o LEFT JOIN (
      SELECT tenant_id, order_id, string_agg(order_item_id || '*' || quantity || '*' || line_total, '|' ORDER BY order_item_id, product_id, quantity,
        unit_price, discount_amount, tax_amount, line_total) AS items FROM v_sales_items GROUP BY ALL) USING (tenant_id, order_id)""")
def _(spark: SparkSession, d: str) -> DataFrame:
    rows = retail.transactions_nested(views.sales(spark, d), views.sales_items(spark, d))
    shown = F.transform("items", lambda i: F.concat_ws("*", i["order_item_id"], i["quantity"].cast("string"), i["line_total"].cast("string")))
    return rows.select("tenant_id", "order_id", "net_amount", F.array_join(shown, "|").alias("items"))


@query("transactions_chunked", "J9", """
    SELECT o.tenant_id, o.order_id, greatest(1, (count(i.order_id) + 2) // 3) AS n_chunks, least(3, count(i.order_id)) AS largest, count(i.order_id) AS n_items,
      coalesce(sum(i.quantity), 0)::BIGINT AS quantity
    FROM v_sales o LEFT JOIN v_sales_items i ON o.tenant_id = i.tenant_id AND o.order_id = i.order_id GROUP BY 1, 2""")
def _(spark: SparkSession, d: str) -> DataFrame:
    """Orders in chunks of three items, put together again."""
    chunks = retail.transactions_chunked(views.sales(spark, d).select("tenant_id", "order_id"), views.sales_items(spark, d), 3)
    quantity = F.aggregate("items", F.lit(0).cast("bigint"), lambda total, i: total + F.coalesce(i["quantity"], F.lit(0)))
    return chunks.groupBy("tenant_id", "order_id").agg(
        F.count(F.lit(1)).alias("n_chunks"), F.max("n_items").cast("bigint").alias("largest"), F.sum("n_items").alias("n_items"), F.sum(quantity).alias("quantity"))


@query("items_of_order", "J10", f"""
    SELECT {columns_of('sales_items')} FROM v_sales_items SEMI JOIN (SELECT * FROM v_sales WHERE order_status = 'CANCELLED') USING (tenant_id, order_id)""")
def _(spark: SparkSession, d: str) -> DataFrame:
    orders = views.sales(spark, d)
    return retail.items_of_orders(views.sales_items(spark, d), orders, retail.where_given(orders, order_status="CANCELLED"))


@query("inventory_of_product", "J11", f"SELECT {columns_of('inventory')} FROM v_inventory SEMI JOIN v_valid_catalog USING (tenant_id, product_id)")
def _(spark: SparkSession, d: str) -> DataFrame:
    return retail.inventory_of_products(views.inventory(spark, d), clean(spark, d, "products"))


@query("inventory_of_location", "J11", f"SELECT {columns_of('inventory')} FROM v_inventory WHERE location_id = 'loc_2'")
def _(spark: SparkSession, d: str) -> DataFrame:
    return retail.inventory_of_location(views.inventory(spark, d), "loc_2")


# --- A, G: aggregates and the gold tables ----------------------------------------------------------------------------


@query("inventory_available", "A1", "SELECT * FROM v_available")
def _(spark: SparkSession, d: str) -> DataFrame:
    return enrich.inventory_available(clean(spark, d, "inventory"))


@query("sales_by_product", "A2", f"""
    SELECT tenant_id, product_id, quantity_sold, CAST(gross_amount AS {MONEY}) AS gross_amount, CAST(discount_amount AS {MONEY}) AS discount_amount,
      CAST(net_amount AS {MONEY}) AS net_amount FROM v_totals""")
def _(spark: SparkSession, d: str) -> DataFrame:
    rows = enrich.sales_by_product(clean(spark, d, "sales_items"), clean(spark, d, "sales"), clean(spark, d, "products"))
    return rows.withColumns({c: pricing.as_money(F.col(c)) for c in ("gross_amount", "discount_amount", "net_amount")})


@query("category_summary", "A3", f"""
    SELECT category_name, n AS product_count, {ratio('s', 'n')} AS avg_price, CAST(c AS {MONEY}) AS total_cost
    FROM (SELECT category_name, count(product_id) AS n, sum(unit_price) AS s, sum(cost_price) AS c FROM v_products GROUP BY 1)""")
def _(spark: SparkSession, d: str) -> DataFrame:
    return retail.category_summary(views.products(spark, d))


@query("store_sales_summary", "A4", f"""
    SELECT store_id, count(order_id) AS total_orders, CAST(sum(total_amount) AS {MONEY}) AS total_revenue, CAST(sum(net_amount) AS {MONEY}) AS net_revenue
    FROM v_sales GROUP BY 1""")
def _(spark: SparkSession, d: str) -> DataFrame:
    return retail.store_sales_summary(views.sales(spark, d))


@query("duplicate_keys", "A5", "SELECT tenant_id, order_item_id, count(*) AS copies FROM v_sales_items GROUP BY ALL HAVING copies > 1")
def _(spark: SparkSession, d: str) -> DataFrame:
    return quality.duplicate_keys(views.sales_items(spark, d), ["tenant_id", "order_item_id"])


@query("gold_product_sales", "A9", f"""
    SELECT tenant_id, product_id, sku, product_name, category_name, coalesce(quantity_sold, 0) AS total_quantity_sold,
      CAST(coalesce(gross_amount, 0) AS {MONEY}) AS gross_revenue, CAST(coalesce(discount_amount, 0) AS {MONEY}) AS discount_amount,
      CAST(coalesce(net_amount, 0) AS {MONEY}) AS net_revenue,
      {ratio("coalesce(net_amount, 0)", "coalesce(quantity_sold, 0)")} AS average_selling_price,
      coalesce(inventory_available, 0) AS inventory_available, {PROVENANCE}
    FROM v_valid_catalog LEFT JOIN v_totals USING (tenant_id, product_id) LEFT JOIN v_available USING (tenant_id, product_id)""")
def _(spark: SparkSession, d: str) -> DataFrame:
    return gold.gold_product_sales(
        clean(spark, d, "products"), clean(spark, d, "inventory"), totals(spark, d), PIPELINE_ID, RUN_ID, STAMP
    )


@query("gold_pricing", "A10", "SELECT * FROM v_gold_pricing")
def _(spark: SparkSession, d: str) -> DataFrame:
    return pricing_table(spark, d)


@query("gold_checks", "V12", """
    SELECT (SELECT count(*) FROM v_gold_pricing WHERE tenant_id IS NULL) AS null_tenant, (SELECT count(*) FROM v_gold_pricing WHERE product_id IS NULL) AS null_product,
      (SELECT count(*) FROM (SELECT 1 FROM v_gold_pricing GROUP BY tenant_id, product_id HAVING count(*) > 1)) AS duplicate_keys,
      (SELECT count(*) FROM v_gold_pricing WHERE final_price < 0) AS negative_price,
      (SELECT count(*) FROM v_gold_pricing WHERE discount_amount > gross_amount) AS discount_above_gross""")
def _(spark: SparkSession, d: str) -> DataFrame:
    return quality.gold_checks(pricing_table(spark, d))


@query("publish_gate", "V13", f"""
    SELECT tenant_id, product_id, final_price FROM (
      SELECT *, CASE WHEN tenant_id = 'tenant_002' AND product_id = min(product_id) OVER () THEN CAST(-1 AS {MONEY}) ELSE final_price END AS p FROM v_gold_pricing)
    QUALIFY min(p) OVER (PARTITION BY tenant_id) >= 0 AND bool_and(discount_amount <= gross_amount) OVER (PARTITION BY tenant_id)""")
def _(spark: SparkSession, d: str) -> DataFrame:
    # the first product of one tenant is spoiled: that tenant, and no other, must publish nothing
    rows = pricing_table(spark, d)
    first = rows.agg(F.min("product_id").alias("product_id")).withColumns({"tenant_id": F.lit("tenant_002"), "_bad": F.lit(True)})
    spoiled = rows.join(first, ["tenant_id", "product_id"], "left").withColumn(
        "final_price", F.when(F.col("_bad"), F.lit(-1).cast("decimal(18,4)")).otherwise(F.col("final_price"))
    )
    path = shared_dir(spark, "gate")
    quality.failing(quality.gold_checks(spoiled, "tenant_id")).select("tenant_id").write.parquet(path)
    return quality.publish_gate(rows, spark.read.schema("tenant_id string").parquet(path)).select("tenant_id", "product_id", "final_price")


@query("best_promotion", "G1", "SELECT * FROM v_best")
def _(spark: SparkSession, d: str) -> DataFrame:
    return enrich.best_promotion(active_links(spark, d))


# --- T, U: order and sets --------------------------------------------------------------------------------------------


@query("page", "T1", f"SELECT {columns_of('sales')} FROM v_sales ORDER BY order_date DESC, tenant_id, order_id LIMIT 1000 OFFSET 250")
def _(spark: SparkSession, d: str) -> DataFrame:
    return retail.page(retail.entity_ordering(views.sales(spark, d), "sales"), 5000, 250)


@query("deep_page", "T1", f"SELECT {columns_of('sales')} FROM v_sales ORDER BY order_date DESC, tenant_id, order_id LIMIT 1000 OFFSET (SELECT 2 * count(*) // 3 FROM v_sales)")
def _(spark: SparkSession, d: str) -> DataFrame:
    """A page two thirds down the list, from the ranges that it covers."""
    sales, place = views.sales(spark, d), shared_dir(spark, "list")
    listing.write_list(sales, "sales", place)
    return listing.read_page(spark, place, "sales", sales.schema, 1000, 2 * sales.count() // 3)


@query("page_info", "T1", """
    SELECT count(*) AS total_count, 1000 AS page_limit, 250 AS page_offset, greatest(0, least(1000, count(*) - 250)) AS record_count,
      1250 < count(*) AS has_more FROM v_sales""")
def _(spark: SparkSession, d: str) -> DataFrame:
    return retail.page_info(views.sales(spark, d), 5000, 250)


_ORDERED = [(n, c, "DESC" if w == "desc" else "ASC") for n, (c, w) in retail.ENTITY_ORDER.items() if n != "tenants"]


@query("entity_orderings", "T2", " UNION ALL ".join(
    f"(SELECT '{n}' AS entity, tenant_id, {KEYS[n][1]} AS id, {c} AS sorted_by FROM v_{n} ORDER BY {c} {w} NULLS LAST, tenant_id, {KEYS[n][1]})"
    for n, c, w in _ORDERED))
def _(spark: SparkSession, d: str) -> DataFrame:
    return views.union_all([
        retail.entity_ordering(RETAIL[n](spark, d), n).select(
            F.lit(n).alias("entity"), "tenant_id", F.col(KEYS[n][1]).alias("id"), F.col(c).cast("timestamp_ntz").alias("sorted_by")
        )
        for n, c, _ in _ORDERED
    ])


@query("entity_ranks", "T2", " UNION ALL ".join(
    f"""(SELECT '{n}' AS entity, row_number() OVER (ORDER BY {c} {w} NULLS LAST, tenant_id NULLS FIRST, {KEYS[n][1]} NULLS FIRST) AS rank,
      tenant_id, {KEYS[n][1]} AS id, {c} AS sorted_by FROM v_{n})"""
    for n, c, w in _ORDERED))
def _(spark: SparkSession, d: str) -> DataFrame:
    return views.union_all([
        retail.entity_ranks(RETAIL[n](spark, d).select("tenant_id", KEYS[n][1], c), n).select(
            F.lit(n).alias("entity"), "rank", "tenant_id", F.col(KEYS[n][1]).alias("id"), F.col(c).cast("timestamp_ntz").alias("sorted_by")
        )
        for n, c, _ in _ORDERED
    ])


@query("tenant_overlap", "U3", """
    SELECT customer_id FROM v_customers WHERE tenant_id = 'tenant_001' INTERSECT SELECT customer_id FROM v_sales WHERE tenant_id = 'tenant_002'""")
def _(spark: SparkSession, d: str) -> DataFrame:
    left = retail.tenant_scope(views.customers(spark, d), "tenant_001")
    return retail.shared_keys(left, retail.tenant_scope(views.sales(spark, d), "tenant_002"), "customer_id")


# --- C1-C3, C16: price expressions -----------------------------------------------------------------------------------


@query("unit_discount", "C1", f"""
    SELECT tenant_id, product_id, promotion_id, CAST(least(CASE discount_type
        WHEN 'PERCENTAGE' THEN CAST(CAST(unit_price AS DECIMAL(38,4)) * discount_value * CAST(0.01 AS DECIMAL(3,2)) AS DECIMAL(38,9))
        ELSE CAST(discount_value AS DECIMAL(38,9)) END, unit_price, maximum_discount) AS {MONEY}) AS unit_discount
    FROM v_active_links JOIN v_valid_catalog USING (tenant_id, product_id)""")
def _(spark: SparkSession, d: str) -> DataFrame:
    rows = active_links(spark, d).join(clean(spark, d, "products").select("tenant_id", "product_id", F.col("unit_price").alias("base_price")), ["tenant_id", "product_id"])
    return rows.select("tenant_id", "product_id", "promotion_id", pricing.unit_discount().alias("unit_discount"))


@query("price_ladder", "C2", f"""
    SELECT tenant_id, order_item_id, CAST(unit_price - discount_amount AS {MONEY}) AS final_price,
      CAST(CAST(unit_price - discount_amount AS DECIMAL(38,4)) * (1 + CAST(12 AS DECIMAL(5,2)) * CAST(0.01 AS DECIMAL(3,2))) AS {MONEY}) AS net_price,
      CAST(quantity * CAST(unit_price AS DECIMAL(38,4)) AS {MONEY}) AS gross_amount, CAST(quantity * CAST(discount_amount AS DECIMAL(38,4)) AS {MONEY}) AS discount_amount
    FROM v_sales_items""")
def _(spark: SparkSession, d: str) -> DataFrame:
    items = views.sales_items(spark, d).select(
        "tenant_id", "order_item_id", F.col("unit_price").alias("base_price"), F.col("discount_amount").alias("unit_discount"),
        F.lit(12).cast("decimal(5,2)").alias("tax_rate"), F.col("quantity").alias("quantity_sold"),
    )
    return items.select("tenant_id", "order_item_id", *[c.alias(n) for n, c in pricing.price_ladder().items()])


@query("average_selling_price", "C3", f"""
    SELECT tenant_id, order_item_id, {ratio('line_total', 'quantity')} AS average_selling_price FROM v_sales_items""")
def _(spark: SparkSession, d: str) -> DataFrame:
    items = views.sales_items(spark, d)
    return items.select("tenant_id", "order_item_id", pricing.money_ratio(F.col("line_total"), F.col("quantity")).alias("average_selling_price"))


@query("promotion_status_on", "C16", f"""
    SELECT tenant_id, promotion_id, CASE WHEN TIMESTAMP '2024-01-15 12:00:00' < start_date THEN 'UPCOMING'
      WHEN TIMESTAMP '2024-01-15 12:00:00' > end_date THEN 'EXPIRED' ELSE 'ACTIVE' END AS status FROM v_promotions""")
def _(spark: SparkSession, d: str) -> DataFrame:
    status = text.promotion_status_on("start_date", "end_date", "2024-01-15 12:00:00").alias("status")
    return views.promotions(spark, d).select("tenant_id", "promotion_id", status)


# --- the whole run ---------------------------------------------------------------------------------------------------


def whole_run(spark: SparkSession, d: str) -> medallion.Run:
    """Bronze, silver and gold of all tenants through written tables."""
    run = medallion.Run(shared_dir(spark, "run"), PIPELINE_ID, RUN_ID, STAMP, BUSINESS_DATE, invalid_rate_limit=0.5)
    readers = {n: (lambda n=n: RETAIL[n](spark, d)) for n in medallion.BRONZE_DATASETS}
    readers["sales"] = lambda: retail.transactions_nested(views.sales(spark, d), views.sales_items(spark, d))
    medallion.run_all(spark, run, {n: ("retail_source", read) for n, read in readers.items()})
    return run


@query("lakehouse_run", "S14 V13 V14", "SELECT * FROM v_gold_pricing")
def _(spark: SparkSession, d: str) -> DataFrame:
    """The published pricing table of a whole run."""
    return tenant_parquet_scan(spark, whole_run(spark, d).path("gold", "pricing")).drop("business_date")


_LANDED = {"products": "v_products", "inventory": "v_inventory", "promotions": "v_promotions", "suppliers": "v_suppliers", "sales": "v_sales"}
_CHECKED = {n: (f"v_{n}", f"v_checked_{n}") for n in ("sales", "sales_items", "inventory", "promotions", "suppliers")}


@query("run_telemetry", "M16 M12 M13 M9", " UNION ALL ".join(
    [f"SELECT tenant_id, '{n}' AS dataset, 'bronze_records_written' AS name, CAST(count(*) AS DECIMAL(18,4)) AS value FROM {v} GROUP BY 1" for n, v in _LANDED.items()]
    + [f"SELECT tenant_id, '{n}', 'silver_input_records', count(*) FROM {v} GROUP BY 1" for n, (v, _) in _CHECKED.items()]
    + [f"SELECT tenant_id, '{n}', 'silver_valid_records', count(*) FILTER (len(errors) = 0) FROM {v} GROUP BY 1" for n, (_, v) in _CHECKED.items()]
    + [f"SELECT tenant_id, '{n}', 'silver_quarantine_records', count(*) FILTER (len(errors) > 0) FROM {v} GROUP BY 1" for n, (_, v) in _CHECKED.items()]
    + ["SELECT tenant_id, 'pricing', 'gold_output_records', count(*) FROM v_gold_pricing GROUP BY 1"]
    + [f"SELECT tenant_id, 'pipeline', '{n}', 1 FROM (SELECT DISTINCT tenant_id FROM v_products)" for n in ("pipeline_run_count", "pipeline_success_count")]
    + [f"SELECT tenant_id, 'pipeline', '{n}', 1 FROM (SELECT DISTINCT tenant_id FROM v_products)" for n in ("PIPELINE_START", "PIPELINE_END")]
    + ["SELECT NULL, 'overview', 'total_runs', count(DISTINCT tenant_id) FROM v_products"]
    + ["SELECT NULL, 'overview', 'success_runs', count(DISTINCT tenant_id) FROM v_products"]))
def _(spark: SparkSession, d: str) -> DataFrame:
    """What the telemetry operators tell of a whole run from the tables that it wrote about itself."""
    run = whole_run(spark, d)
    events, metrics = (lake_table(spark, f"{run.root}/telemetry/{n}") for n in ("events", "metrics"))
    now = f"{STAMP[:10]} 23:59:59"
    shown = (F.col("dataset").isin(*_LANDED) & (F.col("name") == "bronze_records_written")) | (
        F.col("dataset").isin(*_CHECKED) & F.col("name").isin("silver_input_records", "silver_valid_records", "silver_quarantine_records")) | (
        (F.col("dataset") == "pricing") & (F.col("name") == "gold_output_records")) | F.col("name").isin("pipeline_run_count", "pipeline_success_count")
    ends = telemetry.run_timeline(events, now).filter("dataset = 'pipeline'")  # by run; tenants are told by the events of that id
    ends = ends.join(events.select("event_id", "tenant_id"), "event_id")
    overview = telemetry.run_overview(events, metrics, now).select(
        F.lit(None).cast("string").alias("tenant_id"), F.lit("overview").alias("dataset"),
        F.inline(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("decimal(18,4)").alias("value")) for c in ("total_runs", "success_runs")])))
    return views.union_all([
        telemetry.in_lookback(metrics, now, 1440).filter(shown).select("tenant_id", "dataset", "name", "value"),
        ends.select("tenant_id", "dataset", F.col("event_type").alias("name"), F.lit(1).cast("decimal(18,4)").alias("value")),
        overview,
    ])
