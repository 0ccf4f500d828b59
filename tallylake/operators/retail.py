"""The list queries of the retail source: filters, lookups, nested orders, paging and summaries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallylake.functions.pricing import as_money, money_ratio
from tallylake.session import shared_root
from tallylake.specs import KEYS

# fixed values: page bounds, and the sort column and direction of each list
MIN_PAGE, MAX_PAGE = 1, 1000
ENTITY_ORDER = {
    "sales": ("order_date", "desc"),
    "inventory": ("updated_at", "desc"),
    "products": ("created_at", "desc"),
    "suppliers": ("created_at", "desc"),
    "customers": ("created_at", "desc"),
    "stores": ("created_at", "desc"),
    "promotions": ("created_at", "desc"),
    "tenants": ("created_at", "asc"),
    "categories": ("created_at", "asc"),
}


def tenant_scope(df: DataFrame, tenant_id: str) -> DataFrame:
    return df.filter(F.col("tenant_id") == tenant_id)


def where_given(df: DataFrame, **equal: str | None) -> DataFrame:
    """Conjunction of equalities; a criterion that is None or blank is not applied."""
    tests = [F.col(c) == v for c, v in equal.items() if v]
    return df.filter(reduce(Column.__and__, tests)) if tests else df


def where_same_text(df: DataFrame, **equal: str | None) -> DataFrame:
    """As :func:`where_given`, ignoring case."""
    tests = [F.lower(c) == v.lower() for c, v in equal.items() if v]
    return df.filter(reduce(Column.__and__, tests)) if tests else df


def filter_products(
    products: DataFrame, category_id: str | None = None, supplier_id: str | None = None, status: str | None = None
) -> DataFrame:
    return where_given(products, category_id=category_id, supplier_id=supplier_id, status=status)


def filter_suppliers(suppliers: DataFrame, status: str | None = None) -> DataFrame:
    return where_given(suppliers, status=status)


def filter_customers(customers: DataFrame, segment: str | None = None, city: str | None = None) -> DataFrame:
    return where_same_text(where_given(customers, customer_segment=segment), city=city)


def filter_stores(
    stores: DataFrame, store_type: str | None = None, status: str | None = None, city: str | None = None
) -> DataFrame:
    return where_same_text(where_given(stores, store_type=store_type, status=status), city=city)


def filter_promotions(promotions: DataFrame, status: str | None = None, promotion_type: str | None = None) -> DataFrame:
    return where_given(promotions, status=status, promotion_type=promotion_type)


def filter_inventory(inventory: DataFrame, product_id: str | None = None, location_id: str | None = None) -> DataFrame:
    return where_given(inventory, product_id=product_id, location_id=location_id)


def low_stock(inventory: DataFrame) -> DataFrame:
    return inventory.filter("quantity_available <= reorder_level")


def instant(written: str, column: str, df: DataFrame) -> Column:
    """A time given as text, with or without zone, as a constant of the column's own type, so the test reaches the scan."""
    return F.lit(written).cast("timestamp").cast(df.schema[column].dataType)


def updated_since(df: DataFrame, since: str | None, column: str = "updated_at") -> DataFrame:
    """Rows changed at or after ``since``."""
    return df if not since else df.filter(F.col(column) >= instant(since, column, df))


def orders_by_filters(
    orders: DataFrame,
    store_id: str | None = None,
    status: str | None = None,
    date_from: str | None = None,
    date_to: str | None = None,
    since: str | None = None,
) -> DataFrame:
    found = where_given(orders, store_id=store_id, order_status=status)
    if date_from:
        found = found.filter(F.col("order_date") >= instant(date_from, "order_date", orders))
    if date_to:
        found = found.filter(F.col("order_date") <= instant(date_to, "order_date", orders))
    return updated_since(found, since)


def lookup(entity: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose (tenant, id) is wanted; the id of another tenant finds nothing."""
    selective_first = list(reversed(keys))
    return entity.join(wanted.select(*keys), selective_first, "left_semi")


def orders_with_products(orders: DataFrame, items: DataFrame, wanted_products: DataFrame) -> DataFrame:
    """Orders that have at least one item of a wanted product."""
    hits = lookup(items, wanted_products, ["tenant_id", "product_id"])
    return lookup(orders, hits, ["tenant_id", "order_id"])


def promotions_of_products(promotions: DataFrame, links: DataFrame, products: DataFrame) -> DataFrame:
    """Promotion rows per wanted product, whatever their status; repeated links give one row."""
    pairs = lookup(links, products, ["tenant_id", "product_id"]).select("tenant_id", "product_id", "promotion_id").distinct()
    return pairs.join(promotions, ["promotion_id", "tenant_id"])


def transactions_nested(orders: DataFrame, items: DataFrame) -> DataFrame:
    """Each order with its items as a sorted array; an order without items gets an empty one.

    The array is one order's own lines, so its length is bounded by the order, not by the table.
    """
    fields = [c for c in items.columns if c not in ("tenant_id", "order_id")]
    nested = items.groupBy("order_id", "tenant_id").agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("items"))
    joined = orders.join(nested, ["order_id", "tenant_id"], "left")
    return joined.withColumn("items", F.coalesce("items", F.array().cast(nested.schema["items"].dataType)))


def transactions_chunked(orders: DataFrame, items: DataFrame, chunk_items: int = 1000, buckets: int = 4096) -> DataFrame:
    """Orders with their items in chunks of at most ``chunk_items``: (order columns, chunk from 0, n_items, items).

    For orders of any size: items are numbered in hash buckets, so an order that holds a third of all items is spread over ``buckets``
    groups, and a bucket starts where the counts of the ones before it end (``buckets`` rows per order at most). An order without items
    has one empty chunk.
    """
    key = ["tenant_id", "order_id"]
    own = [c for c in items.columns if c not in key]
    placed = items.withColumn("_bucket", F.pmod(F.xxhash64(*own), F.lit(buckets)).cast("int"))
    counts = placed.groupBy(*key, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy("order_id", "tenant_id").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*key, "_bucket", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_start"))
    within = F.row_number().over(Window.partitionBy("order_id", "_bucket", "tenant_id").orderBy(*own)) - 1
    numbered = placed.withColumn("_within", within).join(starts, ["order_id", "_bucket", "tenant_id"])
    chunked = numbered.withColumn("chunk", F.floor((F.col("_start") + F.col("_within")) / chunk_items).cast("int")).groupBy(*key, "chunk").agg(
        F.sort_array(F.collect_list(F.struct(*own))).alias("items"))  # ``chunk_items`` at most
    joined = orders.join(chunked, key, "left")
    return joined.select(
        *orders.columns, F.coalesce("chunk", F.lit(0)).alias("chunk"), F.coalesce(F.size("items"), F.lit(0)).alias("n_items"),
        F.coalesce("items", F.array().cast(chunked.schema["items"].dataType)).alias("items"))


def items_of_orders(items: DataFrame, orders: DataFrame, wanted_orders: DataFrame) -> DataFrame:
    """Items of the wanted orders, provided the order exists in that tenant."""
    existing = lookup(wanted_orders, orders, ["tenant_id", "order_id"])
    return lookup(items, existing, ["tenant_id", "order_id"])


def inventory_of_products(inventory: DataFrame, products: DataFrame) -> DataFrame:
    return lookup(inventory, products, ["tenant_id", "product_id"])


def inventory_of_location(inventory: DataFrame, location_id: str) -> DataFrame:
    return where_given(inventory, location_id=location_id)


def list_order(entity: str) -> list[Column]:
    column, direction = ENTITY_ORDER[entity]
    main = F.col(column).desc_nulls_last() if direction == "desc" else F.col(column).asc_nulls_last()
    return [main, *[F.col(c).asc() for c in KEYS.get(entity, ("tenant_id",))]]


def entity_ordering(df: DataFrame, entity: str) -> DataFrame:
    """Rows in the order of that entity's list, ties by business key."""
    return df.orderBy(*list_order(entity))


def entity_ranks(df: DataFrame, entity: str) -> DataFrame:
    """All rows with ``rank``, their place from 1 in that entity's list. Rows are sorted in range partitions, which are stored so that
    they stay, and each partition starts where the counts of those before it end; only the counts meet in one task."""
    shared_root(df.sparkSession)
    order = list_order(entity)
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()).checkpoint()
    part = F.shiftright("_at", 33)
    ahead = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_rows")).select(
        "_part", F.coalesce(F.sum("_rows").over(ahead), F.lit(0)).alias("_start"))
    inside = F.col("_at") - F.shiftleft("_part", 33)
    ranked = placed.withColumn("_part", part).join(F.broadcast(starts), "_part")
    return ranked.withColumn("rank", F.col("_start") + inside + 1).select(*[c for c in df.columns if c != "rank"], "rank")


def page(ordered: DataFrame, limit: int, offset: int) -> DataFrame:
    """One page of an ordered frame. Sort, offset and limit together stay a top-k: no task holds more than the page end."""
    return ordered.offset(max(offset, 0)).limit(min(max(limit, MIN_PAGE), MAX_PAGE))


def page_info(df: DataFrame, limit: int, offset: int) -> DataFrame:
    """One row: total, clamped limit and offset, rows on the page, and whether more follow."""
    limit, offset = min(max(limit, MIN_PAGE), MAX_PAGE), max(offset, 0)
    total = F.col("total_count")
    return df.agg(F.count(F.lit(1)).alias("total_count")).select(
        "total_count",
        F.lit(limit).alias("page_limit"),
        F.lit(offset).alias("page_offset"),
        F.greatest(F.lit(0), F.least(F.lit(limit), total - F.lit(offset))).cast("bigint").alias("record_count"),
        (F.lit(offset + limit) < total).alias("has_more"),
    )


def category_summary(products: DataFrame) -> DataFrame:
    count = F.count("product_id")
    return products.groupBy("category_name").agg(
        count.alias("product_count"),
        money_ratio(F.sum("unit_price"), F.count("unit_price")).alias("avg_price"),
        as_money(F.sum("cost_price")).alias("total_cost"),
    )


def store_sales_summary(orders: DataFrame) -> DataFrame:
    return orders.groupBy("store_id").agg(
        F.count("order_id").alias("total_orders"),
        as_money(F.sum("total_amount")).alias("total_revenue"),
        as_money(F.sum("net_amount")).alias("net_revenue"),
    )


def shared_keys(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys that occur in both frames; must be empty for two tenants."""
    return left.select(key).intersect(right.select(key))
