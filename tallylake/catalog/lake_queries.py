"""Sources, sinks, projections, validation: inventory rows S, P, V and G2-G3."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallylake.catalog.registry import query
from tallylake.catalog.views_sql import FOREIGN_KEYS, columns_of, errors_sql
from tallylake.operators import cleanse, quality, retail
from tallylake.plans import medallion, silver
from tallylake.session import shared_dir
from tallylake.sources import lake, paged, views
from tallylake.sources.views import BUSINESS_DATE, PIPELINE_ID, RETAIL, RUN_ID, STAMP
from tallylake.specs import spec

PRODUCT_COLUMNS = columns_of("products")


def checked(spark: SparkSession, d: str, dataset: str) -> DataFrame:
    """Typed view of a dataset through the silver step."""
    rows = views.raw_products(spark, d) if dataset == "products" else RETAIL[dataset](spark, d)
    return silver.silver_checked(rows, dataset)


def nested(spark: SparkSession, d: str) -> DataFrame:
    return retail.transactions_nested(views.sales(spark, d), views.sales_items(spark, d))


# --- S: sources and sinks --------------------------------------------------------------------------------------------


@query("paged_source_read", "S1", "SELECT product_id, tenant_id, sku, unit_price, updated_at FROM v_products")
def _(spark: SparkSession, d: str) -> DataFrame:
    target = shared_dir(spark, "pages")
    paged.paged_source_write(views.products(spark, d), target, "product", 200, ["product_id"])
    rows = paged.paged_source_read(spark, target, spec("products").schema)
    return rows.select("product_id", "tenant_id", "sku", "unit_price", "updated_at")


@query("records_to_frame", "S2", """
    SELECT order_id, tenant_id, total_amount, (SELECT count(*) FROM v_sales_items i WHERE i.tenant_id = o.tenant_id AND i.order_id = o.order_id) AS n_items
    FROM v_sales o""")
def _(spark: SparkSession, d: str) -> DataFrame:
    target = shared_dir(spark, "records")
    orders = nested(spark, d)
    orders.write.mode("overwrite").json(target, compression="gzip")  # as text they are ten times the tables
    rows = lake.records_to_frame(spark, target, orders.schema)
    return rows.select("order_id", "tenant_id", "total_amount", F.size("items").cast("bigint").alias("n_items"))


@query("tenant_parquet_scan", "S3", f"SELECT {columns_of('sales')} FROM v_sales WHERE tenant_id = 'tenant_002'")
def _(spark: SparkSession, d: str) -> DataFrame:
    target = shared_dir(spark, "scan")
    orders = views.sales(spark, d)
    lake.partition_overwrite_sink(orders, target, ["tenant_id"])
    return lake.tenant_parquet_scan(spark, target, "tenant_002").select(*orders.columns)


@query("bronze_metadata", "S4", f"""
    SELECT order_id, 'tenant_009' AS tenant_id, total_amount, '{PIPELINE_ID}' AS pipeline_id, '{RUN_ID}' AS run_id,
      'sales_source' AS source_system, '{STAMP}' AS ingestion_timestamp, '{STAMP[:10]}' AS ingestion_date
    FROM v_sales""")
def _(spark: SparkSession, d: str) -> DataFrame:
    orders = views.sales(spark, d).select("order_id", "tenant_id", "total_amount")
    return lake.bronze_metadata(orders, PIPELINE_ID, RUN_ID, "sales_source", STAMP, "tenant_009")


@query("partition_overwrite_sink", "S5", """
    SELECT order_id, tenant_id, CASE WHEN tenant_id = 'tenant_001' THEN 'replaced' ELSE order_status END AS order_status FROM v_sales""")
def _(spark: SparkSession, d: str) -> DataFrame:
    target = shared_dir(spark, "overwrite")
    orders = views.sales(spark, d).select("order_id", "tenant_id", "order_status")
    lake.partition_overwrite_sink(orders, target, ["tenant_id"], rebalance=True)
    again = retail.tenant_scope(orders, "tenant_001").withColumn("order_status", F.lit("replaced"))
    lake.partition_overwrite_sink(again, target, ["tenant_id"], rebalance=True)
    return lake.tenant_parquet_scan(spark, target).select("order_id", "tenant_id", "order_status")


@query("append_sink", "S6", """
    SELECT order_id, tenant_id, count(*) AS copies FROM (
      SELECT order_id, tenant_id FROM v_sales UNION ALL SELECT order_id, tenant_id FROM v_sales WHERE updated_at >= TIMESTAMP '2000-01-01')
    GROUP BY ALL""")
def _(spark: SparkSession, d: str) -> DataFrame:
    target = shared_dir(spark, "append")
    orders = views.sales(spark, d)
    lake.append_sink(orders.select("order_id", "tenant_id"), target)
    lake.append_sink(retail.updated_since(orders, "2000-01-01").select("order_id", "tenant_id"), target)
    return spark.read.parquet(target).groupBy("order_id", "tenant_id").agg(F.count(F.lit(1)).alias("copies"))


@query("full_overwrite_sink", "S7", "SELECT store_id, tenant_id, store_name FROM v_stores")
def _(spark: SparkSession, d: str) -> DataFrame:
    target = shared_dir(spark, "full")
    lake.full_overwrite_sink(views.customers(spark, d), target)
    lake.full_overwrite_sink(views.stores(spark, d).select("store_id", "tenant_id", "store_name"), target)
    return spark.read.parquet(target)


@query("log_record_sink", "S8", "SELECT * FROM v_quality_logs")
def _(spark: SparkSession, d: str) -> DataFrame:
    target = shared_dir(spark, "logs")
    records = views.quality_logs(spark, d)
    lake.log_record_sink(records, target, "quality")
    return lake.log_records(spark, target, "quality", records.schema)


@query("latest_run_status", "S9", """
    SELECT tenant_id, max(run_id) AS run_id, arg_max(status, (run_id, ts, event_id)) AS status FROM v_telemetry GROUP BY 1""")
def _(spark: SparkSession, d: str) -> DataFrame:
    records = views.telemetry_events(spark, d).select(
        "tenant_id", "run_id", F.struct("ts", "event_id").alias("written_at"), F.col("status").alias("overall_status")
    )
    return lake.latest_run_status(records)


@query("incremental_read", "S10", f"SELECT {columns_of('sales')} FROM v_sales WHERE updated_at >= TIMESTAMP '1999-06-01'")
def _(spark: SparkSession, d: str) -> DataFrame:
    return retail.updated_since(views.sales(spark, d), "1999-06-01")


@query("cdc_watermark", "S11", """
    SELECT 'sales' AS dataset, max(updated_at) AS watermark, count(*) AS rows_read FROM v_sales WHERE updated_at >= TIMESTAMP '1999-06-01'
    UNION ALL SELECT 'inventory', max(updated_at), count(*) FROM v_inventory WHERE updated_at >= TIMESTAMP '2024-01-18'
    UNION ALL SELECT 'products', TIMESTAMP '2024-02-15', 0""")
def _(spark: SparkSession, d: str) -> DataFrame:
    sources = {
        "sales": views.sales(spark, d),
        "inventory": views.inventory(spark, d).withColumn("updated_at", F.col("updated_at").cast("timestamp_ntz")),
        "products": views.products(spark, d).withColumn("updated_at", F.col("updated_at").cast("timestamp_ntz")),
    }
    _, marks = lake.cdc_load(sources, {"sales": "1999-06-01", "products": "2024-02-15"}, "2024-01-18")
    return marks


@query("merge_increment", "S12 U2", f"""
    SELECT product_id, tenant_id, product_name, unit_price, status, updated_at FROM (
      SELECT product_id, tenant_id, product_name, unit_price, status, updated_at FROM v_products
      UNION ALL SELECT product_id, tenant_id, NULL, CAST(unit_price + 1 AS DECIMAL(18,4)), status, updated_at + INTERVAL 1 DAY FROM v_products WHERE updated_at >= TIMESTAMP '2024-01-20')
    QUALIFY row_number() OVER (PARTITION BY tenant_id, product_id ORDER BY updated_at DESC) = 1""")
def _(spark: SparkSession, d: str) -> DataFrame:
    current = views.products(spark, d).select("product_id", "tenant_id", "product_name", "unit_price", "status", "updated_at")
    changed = retail.updated_since(current, "2024-01-20").withColumns({
        "unit_price": (F.col("unit_price") + 1).cast("decimal(18,4)"), "updated_at": F.expr("updated_at + INTERVAL 1 DAY"),
    }).drop("product_name")
    return cleanse.dedup_latest(lake.merge_increment(current, changed), spec("products"))


@query("derive_promotion_links", "S13", """
    SELECT DISTINCT l.tenant_id, promotion_id, product_id FROM v_promotion_links l
    SEMI JOIN v_valid_catalog USING (tenant_id, product_id) SEMI JOIN v_promotions USING (tenant_id, promotion_id)""")
def _(spark: SparkSession, d: str) -> DataFrame:
    products = silver.silver_valid(views.products(spark, d), "products")
    return lake.derive_promotion_links(views.promotion_links(spark, d), products, views.promotions(spark, d))


_COUNTED = ("products", "sales", "inventory", "promotions", "suppliers", "customers", "stores", "categories")


@query("ingest_all", "S14", " UNION ALL ".join(
    [f"SELECT '{n}' AS dataset, 'retail_source' AS source_system, count(*) AS records_received, count(*) AS records_written, 'SUCCESS' AS status FROM v_{n}" for n in _COUNTED]
    + ["SELECT 'missing', 'retail_source', 0, 0, 'FAILED'"]))
def _(spark: SparkSession, d: str) -> DataFrame:
    target = shared_dir(spark, "ingest")
    sources = {n: ("retail_source", lambda n=n: RETAIL[n](spark, d)) for n in _COUNTED}
    sources["missing"] = ("retail_source", lambda: spark.read.parquet(f"{target}/no_such_table"))

    def write(name: str, df: DataFrame) -> None:
        tagged = lake.bronze_metadata(df, PIPELINE_ID, RUN_ID, "retail_source", STAMP)
        lake.partition_overwrite_sink(tagged, f"{target}/{name}", ["tenant_id", "ingestion_date"])

    return lake.ingest_all(spark, sources, write).drop("tenant_id", "error_message", "duration_seconds")


@query("multi_tenant_run", "S15", """
    SELECT tenant_id, count(*) AS n_orders, sum(total_amount)::DECIMAL(18,4) AS total FROM v_sales GROUP BY 1""")
def _(spark: SparkSession, d: str) -> DataFrame:
    target = shared_dir(spark, "tenants")
    lake.partition_overwrite_sink(views.sales(spark, d), target, ["tenant_id"])
    return lake.tenant_parquet_scan(spark, target, lake.ALL_TENANTS).groupBy("tenant_id").agg(
        F.count(F.lit(1)).alias("n_orders"), F.sum("total_amount").cast("decimal(18,4)").alias("total")
    )


# --- P: projections, schema, cleansing -------------------------------------------------------------------------------


@query("cast_to_schema", "P1", f"SELECT {PRODUCT_COLUMNS}, pipeline_id, run_id, source_system, ingestion_timestamp FROM v_typed_products")
def _(spark: SparkSession, d: str) -> DataFrame:
    return cleanse.cast_to_schema(views.raw_products(spark, d), spec("products"))


@query("normalize_timestamps", "P2", "SELECT tenant_id, product_id, unit_price, created_at, updated_at FROM v_typed_products")
def _(spark: SparkSession, d: str) -> DataFrame:
    rows = cleanse.normalize_timestamps(views.raw_products(spark, d), spec("products"))
    return rows.select("tenant_id", "product_id", F.col("unit_price").cast("decimal(18,4)").alias("unit_price"), "created_at", "updated_at")


@query("normalize_categoricals", "P3", "SELECT tenant_id, product_id, status, currency, unit_of_measure FROM v_dedup_products")
def _(spark: SparkSession, d: str) -> DataFrame:
    rows = cleanse.normalize_categoricals(views.raw_products(spark, d), spec("products"))
    return rows.select("tenant_id", "product_id", "status", "currency", "unit_of_measure").distinct()


@query("explode_order_items", "P4", f"SELECT {columns_of('sales_items')} FROM v_sales_items SEMI JOIN v_sales USING (tenant_id, order_id)")
def _(spark: SparkSession, d: str) -> DataFrame:
    return cleanse.explode_order_items(nested(spark, d))


@query("orders_without_items", "P5", f"SELECT {columns_of('sales')} FROM v_sales")
def _(spark: SparkSession, d: str) -> DataFrame:
    return cleanse.orders_without_items(nested(spark, d))


@query("curated_products", "P6", """
    SELECT product_id, tenant_id, sku, product_name, category_name, brand, supplier_id, unit_price, cost_price, tax_rate,
      upper(trim(status)) AS status, created_at, updated_at FROM v_products WHERE upper(trim(status)) = 'ACTIVE'""")
def _(spark: SparkSession, d: str) -> DataFrame:
    return cleanse.curated_products(cleanse.normalize_categoricals(views.products(spark, d), spec("products")))


@query("curated_sales", "P7", """
    SELECT order_id, tenant_id, customer_id, store_id, order_date, order_status, payment_method, total_amount, discount_amount,
      tax_amount, net_amount FROM v_sales WHERE order_status <> 'CANCELLED'""")
def _(spark: SparkSession, d: str) -> DataFrame:
    return cleanse.curated_sales(views.sales(spark, d))


@query("provenance_columns", "P8", f"""
    SELECT store_id, tenant_id, '{PIPELINE_ID}' AS pipeline_id, '{RUN_ID}' AS run_id, '{STAMP}' AS transformation_timestamp FROM v_stores""")
def _(spark: SparkSession, d: str) -> DataFrame:
    return cleanse.provenance_columns(views.stores(spark, d).select("store_id", "tenant_id"), PIPELINE_ID, RUN_ID, STAMP)


@query("drop_sensitive_attributes", "P9", "SELECT event_id, tenant_id, dataset AS kept_dataset, stage AS kept_stage FROM v_telemetry")
def _(spark: SparkSession, d: str) -> DataFrame:
    rows = views.telemetry_events(spark, d).select(
        "event_id", "tenant_id", F.col("run_id").alias("Session_Token"), F.col("level").alias("db_password"),
        F.create_map(F.lit("dataset"), "dataset", F.lit("AWS_SECRET_key"), "run_id", F.lit("stage"), "stage").alias("attributes"),
    )
    kept = cleanse.drop_sensitive_columns(rows).withColumn("attributes", cleanse.drop_sensitive_keys("attributes"))
    return kept.select(
        *[c for c in kept.columns if c != "attributes"],
        F.array_join(F.transform(F.map_entries("attributes"), lambda e: e["value"]), "|").alias("_all"),
        F.col("attributes.dataset").alias("kept_dataset"), F.col("attributes.stage").alias("kept_stage"),
    ).filter("_all = concat(kept_dataset, '|', kept_stage)").drop("_all")


@query("schema_backfill", "P10", """
    SELECT incident_id, tenant_id, CASE WHEN k % 2 = 0 THEN platform_id ELSE 'legacy' END AS platform_id, pipeline,
      CASE WHEN k % 3 = 0 THEN 'MEDIUM' ELSE severity END AS severity, 'DETECTED' AS status, 'ALERTS' AS source FROM v_incidents""")
def _(spark: SparkSession, d: str) -> DataFrame:
    k = "CAST(split(problem, ' ')[1] AS INT)"
    old = views.incidents(spark, d).select(
        "incident_id", "tenant_id", "pipeline",
        F.expr(f"CASE WHEN {k} % 2 = 0 THEN platform_id END").alias("platform_id"),
        F.lit("legacy").alias("platform"),
        F.expr(f"CASE WHEN {k} % 3 <> 0 THEN severity END").alias("severity"),
    )
    defaults = {
        "tenant_id": F.lit("UNKNOWN_TENANT"), "platform_id": F.lit("UNKNOWN_PLATFORM"), "pipeline": F.lit(""),
        "severity": F.lit("MEDIUM"), "status": F.lit("DETECTED"), "source": F.lit("ALERTS"),
    }
    return cleanse.schema_backfill(old, defaults, {"platform_id": "platform"}).drop("platform")


# --- V: validation, quarantine, quality ------------------------------------------------------------------------------


@query("required_field_errors", "V1", """
    SELECT tenant_id, order_id, array_to_string(list_filter([CASE WHEN order_id IS NULL THEN 'order_id is required' END,
      CASE WHEN tenant_id IS NULL THEN 'tenant_id is required' END, CASE WHEN customer_id IS NULL THEN 'customer_id is required' END,
      CASE WHEN store_id IS NULL THEN 'store_id is required' END], lambda m: m IS NOT NULL), '; ') AS errors FROM v_sales""")
def _(spark: SparkSession, d: str) -> DataFrame:
    return views.sales(spark, d).select(
        "tenant_id", "order_id", F.array_join(quality.required_field_errors(spec("sales")), "; ").alias("errors")
    )


def _register_rules(name: str, row: str, dataset: str, key: str) -> None:
    view = "v_products" if dataset == "products" else f"v_{dataset}"
    text = f"array_to_string({errors_sql(dataset)}, '; ')"

    @query(name, row, f"SELECT tenant_id, {key}, {text} AS errors, count(*) AS n FROM {view} GROUP BY ALL")
    def _(spark: SparkSession, d: str) -> DataFrame:
        rows = quality.validation_errors(RETAIL[dataset](spark, d), spec(dataset))
        errors = F.array_join("validation_errors", "; ").alias("errors")
        return rows.groupBy("tenant_id", key, errors).agg(F.count(F.lit(1)).alias("n"))


_register_rules("rules_products", "V2", "products", "product_id")
_register_rules("rules_sales_items", "V3", "sales_items", "order_item_id")
_register_rules("rules_inventory", "V4", "inventory", "inventory_id")
_register_rules("rules_promotions", "V5", "promotions", "promotion_id")
_register_rules("rules_suppliers", "V6", "suppliers", "supplier_id")


@query("validation_errors", "V7", "SELECT tenant_id, product_id, array_to_string(errors, '; ') AS errors FROM v_checked_products")
def _(spark: SparkSession, d: str) -> DataFrame:
    return checked(spark, d, "products").select("tenant_id", "product_id", F.array_join("validation_errors", "; ").alias("errors"))


@query("split_valid_invalid", "V8", """
    SELECT tenant_id, product_id, CASE WHEN len(errors) = 0 THEN 'valid' ELSE 'invalid' END AS verdict FROM v_checked_products""")
def _(spark: SparkSession, d: str) -> DataFrame:
    good, bad = quality.split_valid_invalid(checked(spark, d, "products"))
    key = ["tenant_id", "product_id"]
    return good.select(*key, F.lit("valid").alias("verdict")).unionByName(bad.select(*key, F.lit("invalid").alias("verdict")))


@query("quarantine", "V9", f"""
    SELECT {PRODUCT_COLUMNS}, pipeline_id, run_id, source_system, ingestion_timestamp, array_to_string(errors, '; ') AS validation_error,
      '{STAMP}' AS validation_timestamp, '{BUSINESS_DATE}' AS processing_date FROM v_checked_products WHERE len(errors) > 0""")
def _(spark: SparkSession, d: str) -> DataFrame:
    target = shared_dir(spark, "quarantine")
    rows = quality.quarantine(checked(spark, d, "products"), STAMP, BUSINESS_DATE)
    lake.partition_overwrite_sink(rows, target, ["tenant_id", "processing_date"])
    return lake.tenant_parquet_scan(spark, target).select(*rows.columns)


# what the orphan count of a dataset looks into: valid rows only, on both sides
_VALID = {n: f"(SELECT * FROM v_checked_{n} WHERE len(errors) = 0)" for n in ("products", "sales", "sales_items", "suppliers")}


def _metrics_sql(dataset: str, source: str, view: str) -> str:
    null = "len(list_filter(errors, lambda m: m LIKE '% is required')) > 0"
    rule = "len(list_filter(errors, lambda m: NOT m LIKE '% is required')) > 0"
    broken = "SELECT NULL AS tenant_id, 0 AS orphans"
    if dataset in FOREIGN_KEYS:
        broken = _orphans_sql(dataset, _VALID[dataset], _VALID)
    return f"""
    SELECT '{dataset}' AS dataset, s.tenant_id, s.n AS input_record_count, s.n - c.n AS duplicate_record_count, c.ok AS valid_record_count,
      c.n - c.ok AS invalid_record_count, c.ok AS output_record_count, c.nulls AS null_violation_count,
      c.rules AS business_rule_violation_count, CAST(coalesce(o.orphans, 0) AS BIGINT) AS referential_integrity_failure_count
    FROM (SELECT tenant_id, count(*) AS n FROM {source} GROUP BY 1) s
    JOIN (SELECT tenant_id, count(*) AS n, count(*) FILTER (len(errors) = 0) AS ok, count(*) FILTER ({null}) AS nulls,
            count(*) FILTER ({rule}) AS rules FROM {view} GROUP BY 1) c USING (tenant_id)
    LEFT JOIN (SELECT tenant_id, sum(orphans) AS orphans FROM ({broken}) GROUP BY 1) o USING (tenant_id)"""


def _orphans_sql(dataset: str, view: str, parents: dict[str, str]) -> str:
    parts = [
        f"""SELECT c.tenant_id, count(*) AS orphans, count(DISTINCT c.{column}) AS orphan_keys,
              '{dataset}.{column} -> {parent}.{parent_column}' AS foreign_key
            FROM {view} c ANTI JOIN {parents[parent]} p ON c.tenant_id = p.tenant_id AND c.{column} = p.{parent_column}
            WHERE c.{column} IS NOT NULL GROUP BY 1"""
        for column, parent, parent_column in FOREIGN_KEYS[dataset]
    ]
    return " UNION ALL ".join(parts)


_QUALITY_SQL = " UNION ALL ".join([
    _metrics_sql("products", "v_raw_products", "v_checked_products"),
    _metrics_sql("sales", "v_sales", "v_checked_sales"),
    _metrics_sql("sales_items", "v_sales_items", "v_checked_sales_items"),
    _metrics_sql("inventory", "v_inventory", "v_checked_inventory"),
    _metrics_sql("promotions", "v_promotions", "v_checked_promotions"),
    _metrics_sql("suppliers", "v_suppliers", "v_checked_suppliers"),
])


def all_metrics(spark: SparkSession, d: str) -> DataFrame:
    sources = {n: views.raw_products(spark, d) if n == "products" else RETAIL[n](spark, d)
               for n in ("products", "sales", "sales_items", "inventory", "promotions", "suppliers")}
    place = shared_dir(spark, "checked")

    def once(name: str) -> DataFrame:
        """Checked rows, stored with what the counts need: children and parents are both read from there."""
        columns = dict.fromkeys(["tenant_id", "source_copies", "validation_errors", *spec(name).keys, *[c for c, _, _ in spec(name).foreign_keys]])
        return medallion.stored(spark, silver.silver_checked(sources[name], name, "source_copies").select(*columns), f"{place}/{name}")

    checked = dict(zip(sources, lake.side_by_side(spark, once, list(sources)), strict=True))
    valid = {n: quality.valid_rows(rows) for n, rows in checked.items()}
    return views.union_all([
        quality.quality_metrics(rows, spec(n), quality.orphan_counts(valid[n], spec(n), valid) if n in FOREIGN_KEYS else None)
        for n, rows in checked.items()
    ])


@query("quality_metrics", "V10", _QUALITY_SQL)
def _(spark: SparkSession, d: str) -> DataFrame:
    return all_metrics(spark, d)


@query("invalid_rate_gate", "V11", f"""
    SELECT dataset, tenant_id, input_record_count, invalid_record_count, round(invalid_record_count / greatest(input_record_count, 1), 4) AS invalid_rate,
      invalid_record_count > greatest(input_record_count, 1) * CAST(0.03 AS DECIMAL(3,2)) AS breached,
      CASE WHEN invalid_record_count > greatest(input_record_count, 1) * CAST(0.03 AS DECIMAL(3,2)) THEN 'FAILED' ELSE 'SUCCESS' END AS status
    FROM ({_QUALITY_SQL})""")
def _(spark: SparkSession, d: str) -> DataFrame:
    return quality.invalid_rate_gate(all_metrics(spark, d), 0.03)


_STAGE_SQL = ("CASE WHEN {s}_n = 0 THEN CASE WHEN {before} THEN 'FAILED' ELSE 'SKIPPED' END WHEN {s}_good = {s}_n THEN 'SUCCESS' "
              "WHEN {s}_skipped = {s}_n THEN 'SKIPPED' ELSE 'FAILED' END")
_STAGE_COUNTS = ", ".join(
    f"count(*) FILTER (stage = '{s}') AS {s}_n, count(*) FILTER (stage = '{s}' AND status = 'SUCCESS') AS {s}_good, "
    f"count(*) FILTER (stage = '{s}' AND status = 'SKIPPED') AS {s}_skipped" for s in ("bronze", "silver", "gold"))


@query("stage_rollup", "V14", f"""
    SELECT *, CASE WHEN bronze_status = 'SUCCESS' AND silver_status = 'SUCCESS' AND gold_status = 'SUCCESS' THEN 'SUCCESS' ELSE 'FAILED' END AS overall_status
    FROM (SELECT run_id, tenant_id, bronze_status, silver_status,
            {_STAGE_SQL.format(s='gold', before="bronze_status = 'SUCCESS' AND silver_status = 'SUCCESS'")} AS gold_status
          FROM (SELECT *, {_STAGE_SQL.format(s='silver', before="bronze_status = 'SUCCESS'")} AS silver_status
                FROM (SELECT *, {_STAGE_SQL.format(s='bronze', before='true')} AS bronze_status
                      FROM (SELECT run_id, tenant_id, {_STAGE_COUNTS} FROM v_telemetry GROUP BY ALL))))""")
def _(spark: SparkSession, d: str) -> DataFrame:
    return quality.stage_rollup(views.telemetry_events(spark, d))


@query("tenant_column_guard", "V15", "SELECT tenant_id, count(*) AS n FROM v_sales_items SEMI JOIN v_sales USING (tenant_id, order_id) GROUP BY 1")
def _(spark: SparkSession, d: str) -> DataFrame:
    items, orders = views.sales_items(spark, d), views.sales(spark, d)
    quality.require_tenant_column(items, orders)
    return retail.lookup(items, orders, ["tenant_id", "order_id"]).groupBy("tenant_id").agg(F.count(F.lit(1)).alias("n"))


_PARENTS = {"suppliers": "v_suppliers", "sales": "v_valid_sales", "products": "v_valid_catalog"}


@query("referential_integrity", "V16", _orphans_sql("products", "v_products", _PARENTS) + " UNION ALL " + _orphans_sql("sales_items", "v_sales_items", _PARENTS))
def _(spark: SparkSession, d: str) -> DataFrame:
    parents = {
        "suppliers": views.suppliers(spark, d),
        "sales": silver.silver_valid(views.sales(spark, d), "sales"),
        "products": silver.silver_valid(views.products(spark, d), "products"),
    }
    return quality.orphan_counts(views.products(spark, d), spec("products"), parents).unionByName(
        quality.orphan_counts(views.sales_items(spark, d), spec("sales_items"), parents)
    )


@query("scope_consistency", "V17", """
    SELECT order_item_id, count(*) FILTER (tenant_id <> 'tenant_001') AS out_of_scope, count(*) AS copies FROM v_sales_items
    GROUP BY 1 HAVING out_of_scope > 0 OR copies > 1""")
def _(spark: SparkSession, d: str) -> DataFrame:
    return quality.scope_violations(views.sales_items(spark, d), "order_item_id", "tenant_001")


@query("identifier_check", "V18", """
    SELECT incident_id, severity, pipeline, true AS incident_id_ok, severity = trim(severity) AND severity <> '' AS severity_ok,
      pipeline <> '' AS pipeline_ok FROM v_incidents""")
def _(spark: SparkSession, d: str) -> DataFrame:
    rows = views.incidents(spark, d).select("incident_id", "severity", "pipeline")
    return quality.identifier_check(rows, "incident_id", "severity", "pipeline")


@query("order_total_reconciliation", "V19", """
    SELECT *, total_amount = items_total AND discount_amount = items_discount AND tax_amount = items_tax AND net_amount = items_net AS matches
    FROM (SELECT *, CAST(items_total - items_discount + items_tax AS DECIMAL(18,4)) AS items_net FROM (
      SELECT tenant_id, order_id, total_amount, o.discount_amount, o.tax_amount, net_amount, CAST(coalesce(t, 0) AS DECIMAL(18,4)) AS items_total,
        CAST(coalesce(x, 0) AS DECIMAL(18,4)) AS items_discount, CAST(coalesce(y, 0) AS DECIMAL(18,4)) AS items_tax
      FROM v_sales o LEFT JOIN (SELECT tenant_id, order_id, sum(CAST(unit_price AS DECIMAL(38,4)) * quantity) AS t, sum(discount_amount) AS x, sum(tax_amount) AS y
                                FROM v_sales_items GROUP BY ALL) USING (tenant_id, order_id)))""")
def _(spark: SparkSession, d: str) -> DataFrame:
    return quality.order_total_reconciliation(views.sales(spark, d), views.sales_items(spark, d))


# --- G2, G3: de-duplication ------------------------------------------------------------------------------------------


@query("dedup_latest", "G2", f"SELECT {PRODUCT_COLUMNS} FROM v_dedup_products")
def _(spark: SparkSession, d: str) -> DataFrame:
    rules = spec("products")
    typed = cleanse.normalize_categoricals(cleanse.cast_to_schema(views.raw_products(spark, d), rules), rules)
    return cleanse.dedup_latest(typed, rules).select(*rules.schema.fieldNames())


@query("dedup_items", "G3", f"SELECT {columns_of('sales_items')} FROM v_dedup_items")
def _(spark: SparkSession, d: str) -> DataFrame:
    items = views.sales_items(spark, d)
    ordered = items.select(
        "tenant_id", "order_item_id", "order_id", "product_id", "quantity", "unit_price", "discount_amount", "tax_amount", "line_total"
    )
    return cleanse.dedup_items(ordered, spec("sales_items"))
