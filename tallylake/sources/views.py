"""Retail, telemetry and incident views over the given tables.

Each view is a narrow projection (or one aggregation) of a driver table, so it grows with that table. The SQL twin of
every view is in ``tallylake.catalog.views_sql``; defects (negative prices, missing names, bad dates, repeated keys) are
fixed arithmetic on the key, so that rule and quarantine operators have work to do at every scale.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallylake.functions.text import promotion_status_on

# --- fixed values: parameters of the views ---------------------------------------------------------------------------

BUSINESS_DATE = "2024-01-25"
AS_OF = "2024-01-31 00:00:00"
PIPELINE_ID = "lake_daily"
SERVICE_NAME = "lake-batch"
RUN_ID = "20240125_060000_a1b2c3"
STAMP = "2024-01-25T06:00:00Z"

DATASETS = (
    "products", "sales", "inventory", "promotions", "suppliers",
    "customers", "stores", "categories", "promotion_products", "sales_items",
)
STATUSES = (
    "DETECTED", "QUEUED", "ANALYSIS_QUEUED", "SENDING", "SENDING_TO_AGENT", "ANALYZING", "EXECUTING", "INVESTIGATING",
    "DIAGNOSED", "REMEDIATION_PROPOSED", "AWAITING_APPROVAL", "REMEDIATING", "VALIDATING", "RESOLVED", "REJECTED",
    "ESCALATED",
)
SEVERITIES = ("CRITICAL", " high", "MEDIUM", "low ", "weird")
METRICS = (
    "silver_input_records", "silver_invalid_records", "silver_quarantine_records", "silver_valid_records",
    "silver_duplicate_records", "bronze_records_written", "gold_output_records", "gold_validation_failures",
    "pipeline_duration_seconds", "api_error_count", "api_request_count",
)
FAILURES = ("PIPELINE_FAILURE", "GOLD_FAILURE", "SILVER_FAILURE", "BRONZE_FAILURE", "API_FAILURE")
RUN_STATES = ("STARTING", "RUNNING", "FAILED", "DIAGNOSED", "AWAITING_APPROVAL", "APPROVED", "REJECTED", "COMPLETED")
CHANGE_STATUSES = ("DIAGNOSED", "AWAITING_APPROVAL", "REJECTED", "RESOLVED", "SENDING_TO_AGENT")
PROPOSED_ACTIONS = (
    "retry_pipeline", "increase_executor_memory", "delete_production_database", "handle_data_skew", "restart_cluster",
)

# ---------------------------------------------------------------------------------------------------------------------


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def money(expr: str) -> Column:
    return F.expr(expr).cast("decimal(18,4)")


def pick(values: tuple[str, ...], index: Column) -> Column:
    """Element of a constant list by zero-based index."""
    return F.get(F.array(*[F.lit(v) for v in values]), index.cast("int"))


def day(base: str, offset: str) -> Column:
    """Timestamp ``offset`` whole days after ``base``."""
    return F.expr(f"CAST(date_add(DATE'{base}', CAST({offset} AS INT)) AS TIMESTAMP)")


def each_tenant(df: DataFrame) -> DataFrame:
    """One copy of every row per tenant, numbered in column ``t``."""
    return df.withColumn("t", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))))


def tenant_of(key: str) -> Column:
    return F.expr(f"concat('tenant_00', CAST({key} % 3 + 1 AS STRING))")


# --- retail ----------------------------------------------------------------------------------------------------------


def products(spark: SparkSession, d: str) -> DataFrame:
    p = each_tenant(table(spark, d, "part"))
    return p.select(
        F.expr("concat('prod_', p_partkey)").alias("product_id"),
        F.expr("concat('tenant_00', t)").alias("tenant_id"),
        F.expr("concat('SKU-', p_partkey, '-', t)").alias("sku"),
        F.expr("CASE WHEN p_partkey % 83 <> 5 THEN p_name END").alias("product_name"),
        F.expr("concat(p_name, ' by ', p_brand)").alias("description"),
        F.expr("concat('cat_', lower(p_type))").alias("category_id"),
        F.col("p_type").alias("category_name"),
        F.col("p_brand").alias("brand"),
        F.expr("CASE WHEN p_partkey % 97 = 0 THEN 'sup_missing' ELSE concat('sup_', p_partkey DIV 20) END").alias("supplier_id"),
        money("(CAST(p_retailprice AS DECIMAL(18,4)) + t) * CASE WHEN p_partkey % 50 = 7 THEN -1 ELSE 1 END").alias("unit_price"),
        money("CAST((CAST(p_retailprice AS DECIMAL(18,4)) + t) * 0.6 AS DECIMAL(18,2))").alias("cost_price"),
        F.lit("USD").alias("currency"),
        F.expr("CASE WHEN p_partkey % 61 = 3 THEN 150 ELSE get(array(5, 12, 18), p_size % 3) END")
        .cast("decimal(5,2)").alias("tax_rate"),
        F.lit("each").alias("unit_of_measure"),
        F.expr("get(array(' active', 'INACTIVE', 'discontinued '), p_size % 3)").alias("status"),
        day("2024-01-01", "p_partkey % 30").alias("created_at"),
        day("2024-01-01", "p_partkey % 30").alias("updated_at"),
    )


def sales(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").withColumn("total", money("o_totalprice"))
    o = o.withColumn("discount", money("total * 0.05")).withColumn("tax", money("total * 0.12"))
    return o.select(
        F.expr("concat('ord_', o_orderkey)").alias("order_id"),
        tenant_of("o_orderkey").alias("tenant_id"),
        F.expr("CASE WHEN o_orderkey % 101 <> 0 THEN concat('cust_', o_custkey) END").alias("customer_id"),
        F.expr("concat('store_', o_custkey DIV 10)").alias("store_id"),
        F.col("o_orderdate").alias("order_date"),
        F.expr("CASE o_orderstatus WHEN 'F' THEN 'DELIVERED' WHEN 'O' THEN 'PENDING' ELSE 'CANCELLED' END").alias("order_status"),
        F.expr("CASE WHEN o_orderpriority = '1-URGENT' THEN ' card' ELSE 'cash' END").alias("payment_method"),
        F.lit("USD").alias("currency"),
        F.col("total").alias("total_amount"),
        F.col("discount").alias("discount_amount"),
        F.col("tax").alias("tax_amount"),
        money("total - discount + tax").alias("net_amount"),
        F.col("o_orderdate").alias("created_at"),
        F.col("o_orderdate").alias("updated_at"),
    )


def sales_items(spark: SparkSession, d: str) -> DataFrame:
    """Order lines; (order, line) keys repeat on purpose."""
    i = (
        table(spark, d, "lineitem")
        .withColumn("quantity", F.expr("CASE WHEN l_partkey % 71 = 0 THEN 0 ELSE CAST(l_quantity AS INT) END"))
        .withColumn("price", money("l_extendedprice"))
    )
    i = i.withColumn("discount", money("price * CAST(l_discount AS DECIMAL(5,2))")).withColumn(
        "tax", money("price * CAST(l_tax AS DECIMAL(5,2))")
    )
    return i.select(
        F.expr("concat(l_orderkey, '-', l_linenumber)").alias("order_item_id"),
        F.expr("concat('ord_', l_orderkey)").alias("order_id"),
        tenant_of("l_orderkey").alias("tenant_id"),
        F.expr("concat('prod_', l_partkey)").alias("product_id"),
        "quantity",
        F.col("price").alias("unit_price"),
        F.col("discount").alias("discount_amount"),
        F.col("tax").alias("tax_amount"),
        money("quantity * price - discount + tax").alias("line_total"),
    )


def inventory(spark: SparkSession, d: str) -> DataFrame:
    p = each_tenant(table(spark, d, "part")).withColumn("loc", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
    p = p.withColumn("level", F.expr("(p_size * 7 + loc * 13 + t) % 400"))
    p = p.withColumn("on_hand", F.expr("CASE WHEN p_partkey % 67 = 0 THEN -1 - level ELSE level END"))
    return p.select(
        F.expr("concat('inv_', p_partkey, '_', loc)").alias("inventory_id"),
        F.expr("concat('tenant_00', t)").alias("tenant_id"),
        F.expr("concat('prod_', p_partkey)").alias("product_id"),
        F.expr("concat('loc_', loc)").alias("location_id"),
        F.expr("CASE WHEN loc = 0 THEN 'WAREHOUSE' ELSE 'STORE' END").alias("location_type"),
        F.col("on_hand").cast("int").alias("quantity_on_hand"),
        F.expr("CAST(level DIV 3 AS INT)").alias("quantity_reserved"),
        F.expr("CAST(on_hand - level DIV 3 AS INT)").alias("quantity_available"),
        F.expr("CAST(p_partkey % 80 AS INT)").alias("reorder_level"),
        F.lit(100).alias("reorder_quantity"),
        day("2024-01-01", "p_partkey % 20").alias("last_restocked_at"),
        day("2024-01-01", "(p_partkey + loc) % 30").alias("updated_at"),
    )


def promotions(spark: SparkSession, d: str) -> DataFrame:
    """One promotion per supplier and tenant."""
    s = each_tenant(table(spark, d, "supplier")).withColumnRenamed("s_suppkey", "i")
    s = s.withColumn("d1", day("2024-01-01", "i % 20")).withColumn("d2", day("2024-01-01", "i % 20 + 7 + i % 60"))
    s = s.withColumn("start_date", F.expr("CASE WHEN i % 19 = 4 THEN d2 ELSE d1 END")).withColumn(
        "end_date", F.expr("CASE WHEN i % 19 = 4 THEN d1 ELSE d2 END")
    )
    return s.select(
        F.expr("concat('promo_', i)").alias("promotion_id"),
        F.expr("concat('tenant_00', t)").alias("tenant_id"),
        F.expr("concat('CODE', i)").alias("promotion_code"),
        F.col("s_name").alias("promotion_name"),
        F.expr("concat('Offer of ', s_name)").alias("description"),
        F.expr("get(array('SEASONAL', 'clearance', ' BUNDLE'), CAST(i % 3 AS INT))").alias("promotion_type"),
        F.expr("CASE WHEN i % 2 = 0 THEN 'PERCENTAGE' ELSE 'FIXED_AMOUNT' END").alias("discount_type"),
        money("""CASE WHEN i % 17 = 3 THEN -1 WHEN i % 38 = 20 THEN 150 WHEN i % 2 = 0 THEN 10 + i % 40
                 ELSE 100 + 13 * (i % 50) END""").alias("discount_value"),
        "start_date",
        "end_date",
        F.lit(1).alias("minimum_quantity"),
        money("CASE WHEN i % 5 <> 0 THEN 60 + 3 * (i % 50) END").alias("maximum_discount"),
        promotion_status_on("start_date", "end_date", BUSINESS_DATE).alias("status"),
        F.col("d1").alias("created_at"),
        F.col("d1").alias("updated_at"),
    )


def promotion_links(spark: SparkSession, d: str) -> DataFrame:
    """Raw product-promotion links: every line was sold under its supplier's promotion.

    Links repeat, as they do when each product is asked for its promotions.
    """
    return (
        table(spark, d, "lineitem")
        .select(
            F.expr("concat('promo_', l_suppkey)").alias("promotion_id"),
            tenant_of("l_orderkey").alias("tenant_id"),
            F.expr("concat('prod_', l_partkey)").alias("product_id"),
        )
    )


def suppliers(spark: SparkSession, d: str) -> DataFrame:
    places = nation_names(spark, d)
    s = table(spark, d, "supplier").join(places, F.col("s_nationkey") == F.col("n_nationkey"), "left")
    return s.select(
        F.expr("concat('sup_', s_suppkey)").alias("supplier_id"),
        tenant_of("s_suppkey").alias("tenant_id"),
        F.expr("concat('SC', s_suppkey)").alias("supplier_code"),
        F.col("s_name").alias("supplier_name"),
        F.expr("concat('s', s_suppkey, '@supplier.example')").alias("contact_email"),
        F.lit(None).cast("string").alias("phone"),
        F.col("r_name").alias("country"),
        F.col("n_name").alias("city"),
        F.expr("CASE WHEN s_suppkey % 13 = 0 THEN 6.0 ELSE CAST(s_suppkey % 51 AS DECIMAL(5,2)) / 10 END")
        .cast("decimal(3,2)").alias("rating"),
        F.lit("NET30").alias("payment_terms"),
        F.expr("CASE WHEN s_suppkey % 4 = 0 THEN 'INACTIVE' ELSE 'ACTIVE' END").alias("status"),
        day("2024-01-01", "s_suppkey % 28").alias("created_at"),
        day("2024-01-01", "s_suppkey % 28").alias("updated_at"),
    )


def customers(spark: SparkSession, d: str) -> DataFrame:
    places = nation_names(spark, d)
    c = table(spark, d, "customer").join(places, F.col("c_nationkey") == F.col("n_nationkey"), "left")
    return c.select(
        F.expr("concat('cust_', c_custkey)").alias("customer_id"),
        tenant_of("c_custkey").alias("tenant_id"),
        F.expr("concat('CC', c_custkey)").alias("customer_code"),
        F.col("c_name").alias("name"),
        F.col("n_name").alias("city"),
        F.lit("").alias("state"),
        F.col("r_name").alias("country"),
        F.expr("concat(' ', lower(c_mktsegment))").alias("customer_segment"),
        day("2024-01-01", "c_custkey % 28").alias("created_at"),
        day("2024-01-01", "c_custkey % 28").alias("updated_at"),
    )


def stores(spark: SparkSession, d: str) -> DataFrame:
    """One store per block of ten customers, in the city of its first customer."""
    blocks = (
        table(spark, d, "customer")
        .groupBy(F.expr("c_custkey DIV 10").alias("s"))
        .agg(F.min_by("c_nationkey", "c_custkey").alias("nation"), F.min("c_mktsegment").alias("segment"))
    )
    s = blocks.join(nation_names(spark, d), F.col("nation") == F.col("n_nationkey"), "left")
    return s.select(
        F.expr("concat('store_', s)").alias("store_id"),
        tenant_of("s").alias("tenant_id"),
        F.expr("concat('ST', s)").alias("store_code"),
        F.expr("concat('Store ', s)").alias("store_name"),
        F.col("n_name").alias("city"),
        F.lit("").alias("state"),
        F.col("r_name").alias("country"),
        F.expr("CASE segment WHEN 'AUTOMOBILE' THEN 'WAREHOUSE' WHEN 'BUILDING' THEN 'OUTLET' ELSE 'RETAIL' END").alias("store_type"),
        F.expr("CASE WHEN s % 4 = 1 THEN 'CLOSED' ELSE 'ACTIVE' END").alias("status"),
        day("2024-01-01", "s % 28").alias("created_at"),
        day("2024-01-01", "s % 28").alias("updated_at"),
    )


def categories(spark: SparkSession, d: str) -> DataFrame:
    types = table(spark, d, "part").groupBy("p_type").agg(F.min("p_partkey").alias("first"))
    return each_tenant(types).select(
        F.expr("concat('cat_', lower(p_type))").alias("category_id"),
        F.expr("concat('tenant_00', t)").alias("tenant_id"),
        F.col("p_type").alias("category_name"),
        F.lit(None).cast("string").alias("description"),
        F.lit("ACTIVE").alias("status"),
        day("2024-01-01", "first % 28").alias("created_at"),
        day("2024-01-01", "first % 28").alias("updated_at"),
    )


def nation_names(spark: SparkSession, d: str) -> DataFrame:
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    return n.join(r, n.n_regionkey == r.r_regionkey, "left").select("n_nationkey", "n_name", "r_name")


RETAIL: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "products": products, "sales": sales, "sales_items": sales_items, "inventory": inventory,
    "promotions": promotions, "promotion_products": lambda s, d: promotion_links(s, d).distinct(),
    "suppliers": suppliers, "customers": customers, "stores": stores, "categories": categories,
}


def trace(df: DataFrame) -> DataFrame:
    return df.withColumns({
        "pipeline_id": F.lit(PIPELINE_ID), "run_id": F.lit(RUN_ID),
        "source_system": F.lit("retail_source"), "ingestion_timestamp": F.lit(STAMP),
    })


def raw_products(spark: SparkSession, d: str) -> DataFrame:
    """Products as text, as a source would send them: every ninth repeats a day later at a new price, some rates are junk."""
    p = products(spark, d).withColumn("k", F.expr("CAST(substring(product_id, 6) AS BIGINT)"))
    later = p.filter("k % 9 = 0").withColumns({
        "updated_at": F.expr("updated_at + INTERVAL 1 DAY"), "unit_price": money("unit_price + 1"),
    })
    iso = "yyyy-MM-dd'T'HH:mm:ss'Z'"
    both = p.unionByName(later)
    text = {
        "unit_price": F.col("unit_price").cast("string"),
        "cost_price": F.col("cost_price").cast("string"),
        "tax_rate": F.expr("CASE WHEN k % 89 = 7 THEN 'n/a' ELSE CAST(tax_rate AS STRING) END"),
        "currency": F.lit(" usd"),
        "created_at": F.date_format("created_at", iso),
        "updated_at": F.date_format("updated_at", iso),
    }
    return trace(both.withColumns(text).drop("k"))


# --- telemetry -------------------------------------------------------------------------------------------------------


def events(spark: SparkSession, d: str) -> DataFrame:
    """The event table with the ``k`` of its JSON properties as a column."""
    return with_k(table(spark, d, "events"))


def with_k(events_df: DataFrame) -> DataFrame:
    return events_df.withColumn("k", F.get_json_object("props", "$.k").cast("int"))


def telemetry_events(spark: SparkSession, d: str) -> DataFrame:
    return as_telemetry(events(spark, d))


def as_telemetry(e: DataFrame) -> DataFrame:
    return e.select(
        "event_id",
        "ts",
        F.expr("concat('run_', user_id)").alias("run_id"),
        tenant_of("user_id").alias("tenant_id"),
        F.lit(PIPELINE_ID).alias("pipeline_id"),
        F.lit(SERVICE_NAME).alias("service_name"),
        F.when(F.col("event_type") == "error", pick(FAILURES, F.expr("k % 5")))
        .otherwise(F.expr("""CASE event_type WHEN 'purchase' THEN 'PIPELINE_END' WHEN 'signup' THEN 'PIPELINE_START'
                             WHEN 'view' THEN 'BRONZE_END' ELSE 'SILVER_END' END""")).alias("event_type"),
        F.expr("""CASE event_type WHEN 'error' THEN 'FAILED' WHEN 'signup' THEN 'RUNNING' ELSE 'SUCCESS' END""").alias("status"),
        F.expr("CASE WHEN event_type = 'error' THEN 'ERROR' ELSE 'INFO' END").alias("level"),
        F.expr("""CASE event_type WHEN 'view' THEN 'bronze' WHEN 'click' THEN 'silver' ELSE 'gold' END""").alias("stage"),
        pick(DATASETS, F.expr("k % 10")).alias("dataset"),
        F.expr("CASE WHEN k = 13 THEN '' ELSE concat(event_type, ' took ', CAST(CAST(value AS DECIMAL(18,4)) AS STRING)) END").alias("message"),
        "k",
    )


def telemetry_metrics(spark: SparkSession, d: str) -> DataFrame:
    return as_metrics(events(spark, d))


def as_metrics(e: DataFrame) -> DataFrame:
    return e.select(
        "event_id",
        "ts",
        F.expr("concat('run_', user_id)").alias("run_id"),
        tenant_of("user_id").alias("tenant_id"),
        F.lit(PIPELINE_ID).alias("pipeline_id"),
        pick(DATASETS, F.expr("k % 10")).alias("dataset"),
        pick(METRICS, F.expr("k % 11")).alias("name"),
        money("value").alias("value"),
    )


def quality_logs(spark: SparkSession, d: str) -> DataFrame:
    """Wide quality records per (run, tenant, dataset), the input of the unpivot into metrics."""
    e = telemetry_events(spark, d)
    return e.groupBy("run_id", "tenant_id", "dataset", "stage").agg(
        F.count(F.lit(1)).alias("input_record_count"),
        F.count_if(F.col("status") == "SUCCESS").alias("valid_record_count"),
        F.count_if(F.col("status") == "FAILED").alias("invalid_record_count"),
    )


# --- incidents -------------------------------------------------------------------------------------------------------


def block(n: int) -> Column:
    """Incident id shared by a block of five consecutive events."""
    return F.expr(f"concat('INC-', event_id DIV 5 * 5 + {n})")


def incidents(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d).filter("event_type = 'error'")
    return e.select(
        F.expr("concat('INC-', event_id)").alias("incident_id"),
        tenant_of("user_id").alias("tenant_id"),
        F.expr("CASE WHEN user_id % 2 = 0 THEN 'SPARK' ELSE 'SYNAPSE' END").alias("platform_id"),
        F.expr("CASE WHEN k % 7 = 0 THEN '' ELSE concat('Flow_', k % 7) END").alias("pipeline"),
        pick(SEVERITIES, F.expr("k % 5")).alias("severity"),
        pick(STATUSES, F.expr("event_id % 16")).alias("status"),
        F.expr("concat('Failure ', k, ' of user ', user_id)").alias("problem"),
        F.expr("CASE WHEN k % 2 = 0 THEN 'PIPELINE_RUN' ELSE 'ALERTS' END").alias("source"),
        F.col("ts").alias("created_at"),
        F.expr("ts + make_dt_interval(0, 0, k)").alias("updated_at"),
        F.expr("event_id % 2 = 0").alias("recovery_confirmed"),
    )


def incident_payloads(spark: SparkSession, d: str) -> DataFrame:
    """Failure payloads; a third of the incidents have none."""
    e = events(spark, d).filter("event_type = 'error' AND event_id % 3 <> 0")
    outcome = F.expr("get(array('FAILED', ' failed', 'PASSED', 'success', 'odd'), k % 5)")
    diagnosis = F.struct(
        F.expr("concat('stage_', k % 4)").alias("failure_location"),
        F.expr("concat(' cause ', user_id, ' ')").alias("root_cause"),
        F.expr("transform(sequence(1, k % 30 + 1), i -> concat('line ', i))").alias("recent_logs"),
        F.expr("""array(named_struct('action', 'retry_pipeline', 'explanation', 'again', 'priority', 'P1', 'risk', 'low'),
                        named_struct('action', concat('act_', k), 'explanation', '', 'priority', 'P2', 'risk', 'high'))""").alias("remedies"),
        F.lit("see log").alias("message_for_ui"),
    )
    return e.select(
        F.expr("concat('INC-', event_id)").alias("incident_id"),
        F.to_json(F.struct(outcome.alias("outcome"), diagnosis.alias("diagnosis"))).alias("failure_payload"),
        F.lit("{}").alias("agent_result_payload"),
    )


def incident_changes(spark: SparkSession, d: str) -> DataFrame:
    return as_changes(events(spark, d))


def as_changes(events_df: DataFrame) -> DataFrame:
    return events_df.filter("event_type = 'click'").select(
        "event_id",
        block(1).alias("incident_id"),
        tenant_of("user_id").alias("tenant_id"),
        F.expr("CASE WHEN user_id % 2 = 0 THEN 'SPARK' ELSE 'SYNAPSE' END").alias("platform_id"),
        F.expr("concat('Flow_', k % 7)").alias("pipeline"),
        pick(SEVERITIES, F.expr("k % 5")).alias("severity"),
        F.expr("concat('Change ', k)").alias("problem"),
        F.expr("CASE WHEN k % 3 = 0 THEN '' ELSE 'ALERTS' END").alias("source"),
        F.expr("concat('{\"k\":', k, '}')").alias("failure_payload"),
        F.col("ts").alias("changed_at"),
    )


def run_outcomes(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d).filter("event_type = 'signup'")
    return e.select(
        "event_id",
        block(1).alias("incident_id"),
        tenant_of("user_id").alias("tenant_id"),
        F.expr("CASE WHEN user_id % 2 = 0 THEN 'SPARK' ELSE 'SYNAPSE' END").alias("platform_id"),
        F.expr("concat('Flow_', k % 7)").alias("pipeline"),
        F.expr("CASE WHEN k % 3 = 0 THEN 'FAILED' ELSE 'PASSED' END").alias("outcome"),
        F.expr("CASE WHEN k % 4 = 0 THEN '' ELSE concat('Run ', user_id) END").alias("details"),
        F.col("ts").alias("changed_at"),
    )


def agent_results(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d).filter("event_type = 'purchase'")
    return e.select(
        "event_id",
        block(2).alias("incident_id"),
        F.expr("CASE WHEN k % 3 = 0 THEN 'FAILED' ELSE 'SUCCESS' END").alias("outcome"),
        F.expr("k % 2 = 0").alias("validated_resolved"),
        F.expr("concat('result ', k)").alias("result"),
        F.col("ts").alias("changed_at"),
    )


def status_changes(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d).filter("event_type = 'view'")
    return e.select(
        "event_id",
        block(3).alias("incident_id"),
        pick(CHANGE_STATUSES, F.expr("k % 5")).alias("status"),
        F.expr("CASE WHEN k % 5 = 0 THEN concat('cause ', user_id) END").alias("diagnosis"),
        F.col("ts").alias("changed_at"),
    )


def workflow_runs(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d).filter("event_type = 'signup'")
    return e.select(
        F.expr("concat('wr_', event_id)").alias("workflow_run_id"),
        F.expr("concat('INC-', event_id)").alias("incident_id"),
        tenant_of("user_id").alias("tenant_id"),
        F.expr("CASE WHEN user_id % 2 = 0 THEN ' Spark' ELSE 'adf' END").alias("platform_id"),
        F.expr("concat('Flow_', k % 7)").alias("pipeline"),
        F.expr("concat('run_', user_id)").alias("run_id"),
        pick(RUN_STATES, F.expr("k % 8")).alias("state"),
        F.expr("CASE WHEN k % 2 = 0 THEN 'PipelineAgent' ELSE 'DiagnosisAgent' END").alias("current_agent"),
        F.expr("CASE WHEN k % 4 <> 0 THEN concat('key_', user_id, '_', k % 3) END").alias("idempotency_key"),
        F.col("ts").alias("started_at"),
        F.expr("ts + INTERVAL 40 MINUTES").alias("deadline_at"),
        F.expr("CASE WHEN k % 3 <> 0 THEN ts + make_dt_interval(0, 0, k) END").alias("completed_at"),
    )


def diagnoses(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d).filter("event_type = 'click'")
    return e.select(
        F.expr("concat('dg_', event_id)").alias("diagnosis_id"),
        F.expr("concat('wr_', event_id DIV 5 * 5 + 4)").alias("workflow_run_id"),
        block(1).alias("incident_id"),
        tenant_of("user_id").alias("tenant_id"),
        F.expr("concat('stage_', k % 4)").alias("failure_location"),
        F.expr("concat('cause ', k)").alias("root_cause"),
        F.expr("CAST(CAST(value AS DECIMAL(18,4)) * 0.01 - 0.2 AS DOUBLE)").alias("confidence"),
        F.expr("CASE WHEN k % 3 = 0 THEN array() ELSE array(concat('fact ', k)) END").alias("evidence"),
        F.col("ts").alias("created_at"),
    )


def plans(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d).filter("event_type = 'purchase'")
    return e.select(
        F.expr("concat('pl_', event_id)").alias("plan_id"),
        F.expr("concat('wr_', event_id DIV 5 * 5 + 4)").alias("workflow_run_id"),
        block(1).alias("incident_id"),
        tenant_of("user_id").alias("tenant_id"),
        F.expr("concat('[{\"action\":\"act_', k, '\"}]')").alias("actions"),
        F.lit("PENDING").alias("approval_status"),
        F.col("ts").alias("created_at"),
    )


def plan_decisions(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d).filter("event_type = 'view'")
    return e.select(
        "event_id",
        block(1).alias("incident_id"),
        F.expr("k % 2 = 0").alias("approved"),
        F.expr("concat('user_', user_id)").alias("decided_by"),
        F.col("ts").alias("decided_at"),
    )


def agent_events(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d).filter("event_type = 'view'")
    return e.select(
        "event_id",
        block(3).alias("incident_id"),
        F.expr("CASE WHEN k % 2 = 0 THEN 'PipelineAgent' ELSE 'Human' END").alias("agent"),
        F.expr("concat('STEP_', k % 4)").alias("event_type"),
        F.col("ts").alias("created_at"),
    )


def proposed_actions(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d).filter("event_type = 'error'")
    return e.select(
        F.expr("concat('INC-', event_id)").alias("incident_id"),
        F.expr("CASE WHEN user_id % 2 = 0 THEN 'spark' ELSE 'synapse' END").alias("adapter"),
        pick(PROPOSED_ACTIONS, F.expr("k % 5")).alias("action"),
        F.expr("CASE WHEN k % 11 = 0 THEN '' WHEN k % 13 = 0 THEN NULL ELSE 'because' END").alias("explanation"),
        F.expr("CASE WHEN k % 7 = 0 THEN '' ELSE 'low' END").alias("risk"),
    )


def incident_logs(spark: SparkSession, d: str) -> DataFrame:
    """Log lines of an incident, in order: the turns of one conversation."""
    return table(spark, d, "conversations").select(
        F.expr("concat('INC-', conv_id)").alias("incident_id"),
        tenant_of("conv_id").alias("tenant_id"),
        F.col("turn").cast("int").alias("position"),
        F.col("role").alias("source"),
        F.col("text").alias("message"),
    )


def incident_texts(spark: SparkSession, d: str) -> DataFrame:
    """Incidents with long logs: each document is one incident, each of its lines one log line."""
    return table(spark, d, "documents").select(
        F.expr("concat('INC-', doc_id)").alias("incident_id"),
        tenant_of("doc_id").alias("tenant_id"),
        F.expr("CASE WHEN doc_id % 3 = 0 THEN 'synapse' ELSE 'spark' END").alias("adapter"),
        F.concat(F.lit("load_"), "lang").alias("pipeline"),
        F.expr("CASE WHEN doc_id % 5 <> 0 THEN concat('stage_', doc_id % 4) END").alias("failed_stage"),
        F.expr("CASE WHEN doc_id % 7 <> 0 THEN concat('task_', doc_id % 10) END").alias("failed_task"),
        F.concat(F.lit("Load of "), "source", F.lit(" failed")).alias("error_message"),
        F.split("text", "\n").alias("logs"),
        F.create_map(F.lit("source"), F.col("source"), F.lit("chars"), F.col("n_chars").cast("string")).alias("details"),
        F.expr("CASE WHEN doc_id % 2 = 0 THEN concat('cause ', doc_id) END").alias("root_cause"),
        F.expr("concat('place ', doc_id % 9)").alias("failure_location"),
        F.expr("CASE WHEN doc_id % 4 = 0 THEN array('retry_pipeline', 'repair_input_path') ELSE array() END").alias("remedies"),
        "text",
    )


def incident_memory(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(
        F.expr("concat('tenant_00', label % 3 + 1)").alias("tenant_id"),
        F.expr("concat('INC-', vec_id)").alias("incident_id"),
        F.expr("CASE WHEN label % 2 = 0 THEN 'spark' ELSE 'synapse' END").alias("adapter"),
        F.expr("concat('Flow_', label)").alias("pipeline"),
        F.expr("concat('cause ', vec_id)").alias("root_cause"),
        F.col("embedding"),
    )


def memory_writes(spark: SparkSession, d: str) -> DataFrame:
    """Writes to incident memory; an incident is written again whenever it is diagnosed anew."""
    e = events(spark, d)
    return e.select(
        "event_id",
        tenant_of("user_id").alias("tenant_id"),
        F.expr("concat('INC-', user_id, '-', k % 10)").alias("incident_id"),
        F.expr("concat('document ', event_id)").alias("document"),
        F.create_map(F.lit("status"), F.col("event_type"), F.lit("value"), money("value").cast("string")).alias("metadata"),
        F.col("ts").alias("written_at"),
    )


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
