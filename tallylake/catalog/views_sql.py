"""SQL twins of ``tallylake.sources.views``, as named CTEs, and the pieces the oracle queries are put together from."""

from __future__ import annotations

import re

from tallylake.sources.views import (
    AS_OF,
    BUSINESS_DATE,
    CHANGE_STATUSES,
    DATASETS,
    FAILURES,
    METRICS,
    PIPELINE_ID,
    PROPOSED_ACTIONS,
    RUN_ID,
    RUN_STATES,
    SERVICE_NAME,
    SEVERITIES,
    STAMP,
    STATUSES,
)
from tallylake.specs import CATEGORICALS, FOREIGN_KEYS, KEYS, REQUIRED, RULES, SCHEMAS

MONEY = "DECIMAL(18,4)"


def money(expr: str) -> str:
    return f"CAST({expr} AS {MONEY})"


def pick(values: tuple[str, ...], index: str) -> str:
    listed = ", ".join("'" + v + "'" for v in values)
    return f"([{listed}])[CAST({index} AS INTEGER) + 1]"


def day(base: str, offset: str) -> str:
    return f"(TIMESTAMP '{base} 00:00:00' + to_days(CAST({offset} AS INTEGER)))"


def tenant_of(key: str) -> str:
    return f"('tenant_00' || CAST({key} % 3 + 1 AS VARCHAR))"


def ratio(total: str, count: str) -> str:
    """total / count as Spark computes it: six decimals, half up, then four decimals, half up; 0 without rows."""
    units = f"(2 * 100 * CAST(CAST({total} AS DECIMAL(38,4)) * 10000 AS HUGEINT))"
    six = f"((abs{units} + {count}) // (2 * {count}))"
    value = f"CAST((({six} + 50) // 100) * sign{units} AS DECIMAL(38,0)) * CAST(0.0001 AS DECIMAL(5,4))"
    return f"CAST(CASE WHEN {count} > 0 THEN {value} ELSE 0 END AS {MONEY})"


TENANTS = "(VALUES (1), (2), (3)) tt(t)"
K = "CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER)"

VIEWS: dict[str, str] = {}

VIEWS["v_products"] = f"""
SELECT 'prod_' || p_partkey AS product_id, 'tenant_00' || t AS tenant_id, 'SKU-' || p_partkey || '-' || t AS sku,
  CASE WHEN p_partkey % 83 <> 5 THEN p_name END AS product_name, p_name || ' by ' || p_brand AS description,
  'cat_' || lower(p_type) AS category_id, p_type AS category_name, p_brand AS brand,
  CASE WHEN p_partkey % 97 = 0 THEN 'sup_missing' ELSE 'sup_' || (p_partkey // 20) END AS supplier_id,
  {money("(CAST(p_retailprice AS DECIMAL(18,4)) + t) * CASE WHEN p_partkey % 50 = 7 THEN -1 ELSE 1 END")} AS unit_price,
  {money("CAST((CAST(p_retailprice AS DECIMAL(18,4)) + t) * CAST(0.6 AS DECIMAL(2,1)) AS DECIMAL(18,2))")} AS cost_price,
  'USD' AS currency,
  CAST(CASE WHEN p_partkey % 61 = 3 THEN 150 ELSE ([5, 12, 18])[p_size % 3 + 1] END AS DECIMAL(5,2)) AS tax_rate,
  'each' AS unit_of_measure, ([' active', 'INACTIVE', 'discontinued '])[p_size % 3 + 1] AS status,
  {day("2024-01-01", "p_partkey % 30")} AS created_at, {day("2024-01-01", "p_partkey % 30")} AS updated_at, p_partkey AS k
FROM part, {TENANTS}"""

VIEWS["v_sales"] = f"""
SELECT 'ord_' || o_orderkey AS order_id, {tenant_of("o_orderkey")} AS tenant_id,
  CASE WHEN o_orderkey % 101 <> 0 THEN 'cust_' || o_custkey END AS customer_id, 'store_' || (o_custkey // 10) AS store_id,
  o_orderdate AS order_date,
  CASE o_orderstatus WHEN 'F' THEN 'DELIVERED' WHEN 'O' THEN 'PENDING' ELSE 'CANCELLED' END AS order_status,
  CASE WHEN o_orderpriority = '1-URGENT' THEN ' card' ELSE 'cash' END AS payment_method, 'USD' AS currency,
  total AS total_amount, discount AS discount_amount, tax AS tax_amount, {money("total - discount + tax")} AS net_amount,
  o_orderdate AS created_at, o_orderdate AS updated_at
FROM (SELECT *, {money("total * CAST(0.05 AS DECIMAL(3,2))")} AS discount, {money("total * CAST(0.12 AS DECIMAL(3,2))")} AS tax
      FROM (SELECT *, {money("o_totalprice")} AS total FROM orders))"""

VIEWS["v_sales_items"] = f"""
SELECT l_orderkey || '-' || l_linenumber AS order_item_id, 'ord_' || l_orderkey AS order_id, {tenant_of("l_orderkey")} AS tenant_id,
  'prod_' || l_partkey AS product_id, quantity, price AS unit_price, discount AS discount_amount, tax AS tax_amount,
  {money("CAST(quantity * CAST(price AS DECIMAL(38,4)) AS DECIMAL(18,4)) - discount + tax")} AS line_total
FROM (SELECT *, {money("price * CAST(l_discount AS DECIMAL(5,2))")} AS discount, {money("price * CAST(l_tax AS DECIMAL(5,2))")} AS tax
      FROM (SELECT *, CASE WHEN l_partkey % 71 = 0 THEN 0 ELSE CAST(l_quantity AS INTEGER) END AS quantity,
                   {money("l_extendedprice")} AS price FROM lineitem))"""

VIEWS["v_inventory"] = f"""
SELECT 'inv_' || p_partkey || '_' || loc AS inventory_id, 'tenant_00' || t AS tenant_id, 'prod_' || p_partkey AS product_id,
  'loc_' || loc AS location_id, CASE WHEN loc = 0 THEN 'WAREHOUSE' ELSE 'STORE' END AS location_type,
  CAST(on_hand AS INTEGER) AS quantity_on_hand, CAST(level // 3 AS INTEGER) AS quantity_reserved,
  CAST(on_hand - level // 3 AS INTEGER) AS quantity_available, CAST(p_partkey % 80 AS INTEGER) AS reorder_level,
  100 AS reorder_quantity, {day("2024-01-01", "p_partkey % 20")} AS last_restocked_at,
  {day("2024-01-01", "(p_partkey + loc) % 30")} AS updated_at
FROM (SELECT *, CASE WHEN p_partkey % 67 = 0 THEN -1 - level ELSE level END AS on_hand
      FROM (SELECT *, (p_size * 7 + loc * 13 + t) % 400 AS level FROM part, {TENANTS}, (VALUES (0), (1), (2)) ll(loc)))"""

VIEWS["v_promotions"] = f"""
SELECT 'promo_' || i AS promotion_id, 'tenant_00' || t AS tenant_id, 'CODE' || i AS promotion_code, s_name AS promotion_name,
  'Offer of ' || s_name AS description, (['SEASONAL', 'clearance', ' BUNDLE'])[i % 3 + 1] AS promotion_type,
  CASE WHEN i % 2 = 0 THEN 'PERCENTAGE' ELSE 'FIXED_AMOUNT' END AS discount_type,
  {money("CASE WHEN i % 17 = 3 THEN -1 WHEN i % 38 = 20 THEN 150 WHEN i % 2 = 0 THEN 10 + i % 40 ELSE 100 + 13 * (i % 50) END")} AS discount_value,
  start_date, end_date, 1 AS minimum_quantity, {money("CASE WHEN i % 5 <> 0 THEN 60 + 3 * (i % 50) END")} AS maximum_discount,
  CASE WHEN TIMESTAMP '{BUSINESS_DATE}' < start_date THEN 'UPCOMING' WHEN TIMESTAMP '{BUSINESS_DATE}' > end_date THEN 'EXPIRED'
       ELSE 'ACTIVE' END AS status, d1 AS created_at, d1 AS updated_at
FROM (SELECT *, CASE WHEN i % 19 = 4 THEN d2 ELSE d1 END AS start_date, CASE WHEN i % 19 = 4 THEN d1 ELSE d2 END AS end_date
      FROM (SELECT *, s_suppkey AS i, {day("2024-01-01", "s_suppkey % 20")} AS d1,
                   {day("2024-01-01", "s_suppkey % 20 + 7 + s_suppkey % 60")} AS d2 FROM supplier, {TENANTS}))"""

VIEWS["v_promotion_links"] = f"""
SELECT 'promo_' || l_suppkey AS promotion_id, {tenant_of("l_orderkey")} AS tenant_id, 'prod_' || l_partkey AS product_id
FROM lineitem"""

VIEWS["v_promotion_products"] = "SELECT DISTINCT * FROM v_promotion_links"

VIEWS["v_places"] = "SELECT n_nationkey, n_name, r_name FROM nation LEFT JOIN region ON n_regionkey = r_regionkey"

VIEWS["v_suppliers"] = f"""
SELECT 'sup_' || s_suppkey AS supplier_id, {tenant_of("s_suppkey")} AS tenant_id, 'SC' || s_suppkey AS supplier_code,
  s_name AS supplier_name, 's' || s_suppkey || '@supplier.example' AS contact_email, CAST(NULL AS VARCHAR) AS phone,
  r_name AS country, n_name AS city,
  CAST(CASE WHEN s_suppkey % 13 = 0 THEN 6.0 ELSE CAST(s_suppkey % 51 AS DECIMAL(5,2)) * CAST(0.1 AS DECIMAL(2,1)) END AS DECIMAL(3,2)) AS rating,
  'NET30' AS payment_terms, CASE WHEN s_suppkey % 4 = 0 THEN 'INACTIVE' ELSE 'ACTIVE' END AS status,
  {day("2024-01-01", "s_suppkey % 28")} AS created_at, {day("2024-01-01", "s_suppkey % 28")} AS updated_at
FROM supplier LEFT JOIN v_places ON s_nationkey = n_nationkey"""

VIEWS["v_customers"] = f"""
SELECT 'cust_' || c_custkey AS customer_id, {tenant_of("c_custkey")} AS tenant_id, 'CC' || c_custkey AS customer_code,
  c_name AS name, n_name AS city, '' AS state, r_name AS country, ' ' || lower(c_mktsegment) AS customer_segment,
  {day("2024-01-01", "c_custkey % 28")} AS created_at, {day("2024-01-01", "c_custkey % 28")} AS updated_at
FROM customer LEFT JOIN v_places ON c_nationkey = n_nationkey"""

VIEWS["v_stores"] = f"""
SELECT 'store_' || s AS store_id, {tenant_of("s")} AS tenant_id, 'ST' || s AS store_code, 'Store ' || s AS store_name,
  n_name AS city, '' AS state, r_name AS country,
  CASE segment WHEN 'AUTOMOBILE' THEN 'WAREHOUSE' WHEN 'BUILDING' THEN 'OUTLET' ELSE 'RETAIL' END AS store_type,
  CASE WHEN s % 4 = 1 THEN 'CLOSED' ELSE 'ACTIVE' END AS status,
  {day("2024-01-01", "s % 28")} AS created_at, {day("2024-01-01", "s % 28")} AS updated_at
FROM (SELECT c_custkey // 10 AS s, min_by(c_nationkey, c_custkey) AS nation, min(c_mktsegment) AS segment FROM customer GROUP BY 1)
LEFT JOIN v_places ON nation = n_nationkey"""

VIEWS["v_categories"] = f"""
SELECT 'cat_' || lower(p_type) AS category_id, 'tenant_00' || t AS tenant_id, p_type AS category_name,
  CAST(NULL AS VARCHAR) AS description, 'ACTIVE' AS status, {day("2024-01-01", "f % 28")} AS created_at,
  {day("2024-01-01", "f % 28")} AS updated_at
FROM (SELECT p_type, min(p_partkey) AS f FROM part GROUP BY 1), {TENANTS}"""

TRACE = f"'{PIPELINE_ID}' AS pipeline_id, '{RUN_ID}' AS run_id, 'retail_source' AS source_system, '{STAMP}' AS ingestion_timestamp"

VIEWS["v_raw_products"] = f"""
SELECT product_id, tenant_id, sku, product_name, description, category_id, category_name, brand, supplier_id,
  CAST(unit_price AS VARCHAR) AS unit_price, CAST(cost_price AS VARCHAR) AS cost_price, ' usd' AS currency,
  CASE WHEN k % 89 = 7 THEN 'n/a' ELSE CAST(tax_rate AS VARCHAR) END AS tax_rate, unit_of_measure, status,
  strftime(created_at, '%Y-%m-%dT%H:%M:%SZ') AS created_at, strftime(updated_at, '%Y-%m-%dT%H:%M:%SZ') AS updated_at, {TRACE}
FROM (SELECT * FROM v_products
      UNION ALL SELECT * REPLACE ({money("unit_price + 1")} AS unit_price, updated_at + INTERVAL 1 DAY AS updated_at)
      FROM v_products WHERE k % 9 = 0)"""

VIEWS["v_typed_products"] = f"""
SELECT * REPLACE (TRY_CAST(unit_price AS {MONEY}) AS unit_price, TRY_CAST(cost_price AS {MONEY}) AS cost_price,
  TRY_CAST(tax_rate AS DECIMAL(5,2)) AS tax_rate, strptime(created_at, '%Y-%m-%dT%H:%M:%SZ') AS created_at,
  strptime(updated_at, '%Y-%m-%dT%H:%M:%SZ') AS updated_at),
  CASE WHEN tax_rate IS NOT NULL AND TRY_CAST(tax_rate AS DECIMAL(5,2)) IS NULL THEN 'tax_rate has invalid type' END AS lost
FROM v_raw_products"""

VIEWS["v_dedup_products"] = """
SELECT * REPLACE (upper(trim(status)) AS status, upper(trim(currency)) AS currency, upper(trim(unit_of_measure)) AS unit_of_measure)
FROM v_typed_products QUALIFY row_number() OVER (PARTITION BY tenant_id, product_id ORDER BY updated_at DESC) = 1"""


def errors_sql(dataset: str, *extra: str) -> str:
    """List of the messages of a row, from the dataset's required fields and rules."""
    cases = [f"CASE WHEN {c} IS NULL THEN '{c} is required' END" for c in REQUIRED[dataset]]
    cases += [f"CASE WHEN {predicate} THEN '{message}' END" for message, predicate in RULES.get(dataset, ())]
    return f"list_filter([{', '.join([*cases, *extra])}], lambda m: m IS NOT NULL)"


VIEWS["v_checked_products"] = f"SELECT *, {errors_sql('products', 'lost')} AS errors FROM v_dedup_products"

VIEWS["v_dedup_items"] = """
SELECT * FROM v_sales_items QUALIFY row_number() OVER (PARTITION BY tenant_id, order_item_id
  ORDER BY order_id, product_id, quantity, unit_price, discount_amount, tax_amount, line_total) = 1"""

for _name in ("sales", "inventory", "promotions", "promotion_products", "suppliers", "customers", "stores", "categories"):
    _upper = ", ".join(f"upper(trim({c})) AS {c}" for c in CATEGORICALS.get(_name, ()))
    _cols = f"* REPLACE ({_upper})" if _upper else "*"
    VIEWS[f"v_checked_{_name}"] = f"SELECT *, {errors_sql(_name)} AS errors FROM (SELECT {_cols} FROM v_{_name})"
VIEWS["v_checked_sales_items"] = f"SELECT *, {errors_sql('sales_items')} AS errors FROM v_dedup_items"
# typed products without raw duplicates, as gold reads them
_upper = ", ".join(f"upper(trim({c})) AS {c}" for c in CATEGORICALS["products"])
VIEWS["v_checked_catalog"] = f"SELECT *, {errors_sql('products')} AS errors FROM (SELECT * REPLACE ({_upper}) FROM v_products)"
for _name in ("products", "catalog", "sales", "sales_items", "inventory", "promotions", "promotion_products", "suppliers"):
    VIEWS[f"v_valid_{_name}"] = f"SELECT * EXCLUDE (errors) FROM v_checked_{_name} WHERE len(errors) = 0"

VIEWS["v_events"] = f"SELECT *, {K} AS k FROM events"

VIEWS["v_telemetry"] = f"""
SELECT event_id, ts, 'run_' || user_id AS run_id, {tenant_of("user_id")} AS tenant_id, '{PIPELINE_ID}' AS pipeline_id,
  '{SERVICE_NAME}' AS service_name,
  CASE event_type WHEN 'error' THEN {pick(FAILURES, "k % 5")} WHEN 'purchase' THEN 'PIPELINE_END' WHEN 'signup' THEN 'PIPELINE_START'
       WHEN 'view' THEN 'BRONZE_END' ELSE 'SILVER_END' END AS event_type,
  CASE event_type WHEN 'error' THEN 'FAILED' WHEN 'signup' THEN 'RUNNING' ELSE 'SUCCESS' END AS status,
  CASE WHEN event_type = 'error' THEN 'ERROR' ELSE 'INFO' END AS level,
  CASE event_type WHEN 'view' THEN 'bronze' WHEN 'click' THEN 'silver' ELSE 'gold' END AS stage,
  {pick(DATASETS, "k % 10")} AS dataset,
  CASE WHEN k = 13 THEN '' ELSE event_type || ' took ' || CAST({money("value")} AS VARCHAR) END AS message, k
FROM v_events"""

VIEWS["v_metrics"] = f"""
SELECT event_id, ts, 'run_' || user_id AS run_id, {tenant_of("user_id")} AS tenant_id, '{PIPELINE_ID}' AS pipeline_id,
  {pick(DATASETS, "k % 10")} AS dataset, {pick(METRICS, "k % 11")} AS name, {money("value")} AS value
FROM v_events"""

VIEWS["v_quality_logs"] = """
SELECT run_id, tenant_id, dataset, stage, count(*) AS input_record_count, count(*) FILTER (status = 'SUCCESS') AS valid_record_count,
  count(*) FILTER (status = 'FAILED') AS invalid_record_count FROM v_telemetry GROUP BY ALL"""


def block(n: int) -> str:
    return f"('INC-' || (event_id // 5 * 5 + {n}))"


PLATFORM = "CASE WHEN user_id % 2 = 0 THEN 'SPARK' ELSE 'SYNAPSE' END"

VIEWS["v_incidents"] = f"""
SELECT 'INC-' || event_id AS incident_id, {tenant_of("user_id")} AS tenant_id, {PLATFORM} AS platform_id,
  CASE WHEN k % 7 = 0 THEN '' ELSE 'Flow_' || (k % 7) END AS pipeline, {pick(SEVERITIES, "k % 5")} AS severity,
  {pick(STATUSES, "event_id % 16")} AS status, 'Failure ' || k || ' of user ' || user_id AS problem,
  CASE WHEN k % 2 = 0 THEN 'PIPELINE_RUN' ELSE 'ALERTS' END AS source, ts AS created_at, ts + to_minutes(k) AS updated_at,
  event_id % 2 = 0 AS recovery_confirmed, event_id, user_id, k
FROM v_events WHERE event_type = 'error'"""

VIEWS["v_incident_changes"] = f"""
SELECT event_id, {block(1)} AS incident_id, {tenant_of("user_id")} AS tenant_id, {PLATFORM} AS platform_id, 'Flow_' || (k % 7) AS pipeline,
  {pick(SEVERITIES, "k % 5")} AS severity, 'Change ' || k AS problem, CASE WHEN k % 3 = 0 THEN '' ELSE 'ALERTS' END AS source,
  '{{"k":' || k || '}}' AS failure_payload, ts AS changed_at
FROM v_events WHERE event_type = 'click'"""

VIEWS["v_run_outcomes"] = f"""
SELECT event_id, {block(1)} AS incident_id, {tenant_of("user_id")} AS tenant_id, {PLATFORM} AS platform_id, 'Flow_' || (k % 7) AS pipeline,
  CASE WHEN k % 3 = 0 THEN 'FAILED' ELSE 'PASSED' END AS outcome, CASE WHEN k % 4 = 0 THEN '' ELSE 'Run ' || user_id END AS details,
  ts AS changed_at
FROM v_events WHERE event_type = 'signup'"""

VIEWS["v_agent_results"] = f"""
SELECT event_id, {block(2)} AS incident_id, CASE WHEN k % 3 = 0 THEN 'FAILED' ELSE 'SUCCESS' END AS outcome,
  k % 2 = 0 AS validated_resolved, 'result ' || k AS result, ts AS changed_at
FROM v_events WHERE event_type = 'purchase'"""

VIEWS["v_status_changes"] = f"""
SELECT event_id, {block(3)} AS incident_id, {pick(CHANGE_STATUSES, "k % 5")} AS status,
  CASE WHEN k % 5 = 0 THEN 'cause ' || user_id END AS diagnosis, ts AS changed_at
FROM v_events WHERE event_type = 'view'"""

VIEWS["v_runs"] = f"""
SELECT 'wr_' || event_id AS workflow_run_id, 'INC-' || event_id AS incident_id, {tenant_of("user_id")} AS tenant_id,
  CASE WHEN user_id % 2 = 0 THEN ' Spark' ELSE 'adf' END AS platform_id, 'Flow_' || (k % 7) AS pipeline, 'run_' || user_id AS run_id,
  {pick(RUN_STATES, "k % 8")} AS state, CASE WHEN k % 2 = 0 THEN 'PipelineAgent' ELSE 'DiagnosisAgent' END AS current_agent,
  CASE WHEN k % 4 <> 0 THEN 'key_' || user_id || '_' || (k % 3) END AS idempotency_key, ts AS started_at,
  ts + INTERVAL 40 MINUTES AS deadline_at, CASE WHEN k % 3 <> 0 THEN ts + to_minutes(k) END AS completed_at
FROM v_events WHERE event_type = 'signup'"""

VIEWS["v_diagnoses"] = f"""
SELECT 'dg_' || event_id AS diagnosis_id, 'wr_' || (event_id // 5 * 5 + 4) AS workflow_run_id, {block(1)} AS incident_id,
  {tenant_of("user_id")} AS tenant_id, 'stage_' || (k % 4) AS failure_location, 'cause ' || k AS root_cause,
  CAST({money("value")} * CAST(0.01 AS DECIMAL(3,2)) - CAST(0.2 AS DECIMAL(3,2)) AS DOUBLE) AS confidence,
  k % 3 = 0 AS no_evidence, ts AS created_at
FROM v_events WHERE event_type = 'click'"""

VIEWS["v_plans"] = f"""
SELECT 'pl_' || event_id AS plan_id, 'wr_' || (event_id // 5 * 5 + 4) AS workflow_run_id, {block(1)} AS incident_id,
  {tenant_of("user_id")} AS tenant_id, '[{{"action":"act_' || k || '"}}]' AS actions, 'PENDING' AS approval_status, ts AS created_at
FROM v_events WHERE event_type = 'purchase'"""

VIEWS["v_plan_decisions"] = f"""
SELECT event_id, {block(1)} AS incident_id, k % 2 = 0 AS approved, 'user_' || user_id AS decided_by, ts AS decided_at
FROM v_events WHERE event_type = 'view'"""

VIEWS["v_agent_events"] = f"""
SELECT event_id, {block(3)} AS incident_id, CASE WHEN k % 2 = 0 THEN 'PipelineAgent' ELSE 'Human' END AS agent,
  'STEP_' || (k % 4) AS event_type, ts AS created_at
FROM v_events WHERE event_type = 'view'"""

VIEWS["v_proposed"] = f"""
SELECT 'INC-' || event_id AS incident_id, CASE WHEN user_id % 2 = 0 THEN 'spark' ELSE 'synapse' END AS adapter,
  {pick(PROPOSED_ACTIONS, "k % 5")} AS action, CASE WHEN k % 11 = 0 THEN '' WHEN k % 13 = 0 THEN NULL ELSE 'because' END AS explanation,
  CASE WHEN k % 7 = 0 THEN '' ELSE 'low' END AS risk
FROM v_events WHERE event_type = 'error'"""

VIEWS["v_texts"] = f"""
SELECT 'INC-' || doc_id AS incident_id, {tenant_of("doc_id")} AS tenant_id,
  CASE WHEN doc_id % 3 = 0 THEN 'synapse' ELSE 'spark' END AS adapter, 'load_' || lang AS pipeline,
  CASE WHEN doc_id % 5 <> 0 THEN 'stage_' || (doc_id % 4) END AS failed_stage,
  CASE WHEN doc_id % 7 <> 0 THEN 'task_' || (doc_id % 10) END AS failed_task, 'Load of ' || source || ' failed' AS error_message,
  string_split(text, chr(10)) AS logs, source, n_chars, CASE WHEN doc_id % 2 = 0 THEN 'cause ' || doc_id END AS root_cause,
  'place ' || (doc_id % 9) AS failure_location, doc_id % 4 = 0 AS has_remedies, text, doc_id
FROM documents"""

VIEWS["v_memory"] = """
SELECT 'tenant_00' || (label % 3 + 1) AS tenant_id, 'INC-' || vec_id AS incident_id,
  CASE WHEN label % 2 = 0 THEN 'spark' ELSE 'synapse' END AS adapter, 'Flow_' || label AS pipeline, 'cause ' || vec_id AS root_cause,
  CAST(embedding AS DOUBLE[]) AS embedding
FROM embeddings"""

VIEWS["v_memory_writes"] = f"""
SELECT event_id, {tenant_of("user_id")} AS tenant_id, 'INC-' || user_id || '-' || (k % 10) AS incident_id,
  'document ' || event_id AS document, event_type AS status, CAST({money("value")} AS VARCHAR) AS value, ts AS written_at
FROM v_events"""

# effective status of an incident, and its normalised severity
EFFECTIVE = "CASE WHEN status = 'RESOLVED' AND NOT recovery_confirmed THEN 'VALIDATING' ELSE status END"
SEVERITY = "CASE WHEN upper(trim(severity)) IN ('CRITICAL', 'HIGH', 'MEDIUM', 'LOW') THEN upper(trim(severity)) ELSE 'MEDIUM' END"


def columns_of(dataset: str) -> str:
    """Column names of a dataset schema, in order."""
    cleaned = re.sub(r"\([^)]*\)", "", SCHEMAS[dataset])
    return ", ".join(part.split()[0] for part in cleaned.split(","))


def keys_of(dataset: str) -> str:
    return ", ".join(KEYS[dataset])


def foreign_keys(dataset: str) -> tuple[tuple[str, str, str], ...]:
    return FOREIGN_KEYS[dataset]


def lookback(minutes: int) -> str:
    return f"ts >= TIMESTAMP '{AS_OF}' - INTERVAL {minutes} MINUTES AND ts < TIMESTAMP '{AS_OF}'"


def with_views(sql: str) -> str:
    """Prefix a query with the CTEs it needs, each after those it needs itself."""
    ordered: list[str] = []

    def need(text: str) -> None:
        for name in re.findall(r"\bv_\w+\b", text):
            if name in VIEWS and name not in ordered:
                need(VIEWS[name])
                if name not in ordered:
                    ordered.append(name)

    need(sql)
    if not ordered:
        return sql.strip()
    ctes = ",\n".join(f"{name} AS ({VIEWS[name].strip()})" for name in ordered)
    body = sql.strip()
    own = body.removeprefix("WITH ")
    return f"WITH {ctes},\n{own}" if own != body else f"WITH {ctes}\n{body}"
