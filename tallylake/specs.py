"""Dataset specifications.

Every silver operator is driven by one :class:`DatasetSpec`, so adding a dataset means adding data, not code.
Predicates in ``rules`` are ANSI SQL and describe the *failing* rows; a NULL operand never fails a rule.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

# --- fixed values: schemas, keys, categorical fields, required fields and rule texts ---------------------------------

TRACE_COLUMNS = ("pipeline_id", "run_id", "source_system", "ingestion_timestamp")

TENANTS = ("tenant_001", "tenant_002", "tenant_003")

INVALID_RATE_LIMIT = 0.10

SCHEMAS = {
    "products": """product_id string, tenant_id string, sku string, product_name string, description string,
        category_id string, category_name string, brand string, supplier_id string, unit_price decimal(18,4),
        cost_price decimal(18,4), currency string, tax_rate decimal(5,2), unit_of_measure string, status string,
        created_at timestamp, updated_at timestamp""",
    "sales": """order_id string, tenant_id string, customer_id string, store_id string, order_date timestamp,
        order_status string, payment_method string, currency string, total_amount decimal(18,4),
        discount_amount decimal(18,4), tax_amount decimal(18,4), net_amount decimal(18,4), created_at timestamp,
        updated_at timestamp""",
    "sales_items": """order_item_id string, order_id string, tenant_id string, product_id string, quantity int,
        unit_price decimal(18,4), discount_amount decimal(18,4), tax_amount decimal(18,4), line_total decimal(18,4)""",
    "inventory": """inventory_id string, tenant_id string, product_id string, location_id string, location_type string,
        quantity_on_hand int, quantity_reserved int, quantity_available int, reorder_level int, reorder_quantity int,
        last_restocked_at timestamp, updated_at timestamp""",
    "promotions": """promotion_id string, tenant_id string, promotion_code string, promotion_name string,
        description string, promotion_type string, discount_type string, discount_value decimal(18,4),
        start_date timestamp, end_date timestamp, minimum_quantity int, maximum_discount decimal(18,4), status string,
        created_at timestamp, updated_at timestamp""",
    "promotion_products": "promotion_id string, tenant_id string, product_id string",
    "suppliers": """supplier_id string, tenant_id string, supplier_code string, supplier_name string,
        contact_email string, phone string, country string, city string, rating decimal(3,2), payment_terms string,
        status string, created_at timestamp, updated_at timestamp""",
    "customers": """customer_id string, tenant_id string, customer_code string, name string, city string, state string,
        country string, customer_segment string, created_at timestamp, updated_at timestamp""",
    "stores": """store_id string, tenant_id string, store_code string, store_name string, city string, state string,
        country string, store_type string, status string, created_at timestamp, updated_at timestamp""",
    "categories": """category_id string, tenant_id string, category_name string, description string, status string,
        created_at timestamp, updated_at timestamp""",
}

KEYS = {
    "products": ("tenant_id", "product_id"),
    "sales": ("tenant_id", "order_id"),
    "sales_items": ("tenant_id", "order_item_id"),
    "inventory": ("tenant_id", "inventory_id"),
    "promotions": ("tenant_id", "promotion_id"),
    "promotion_products": ("tenant_id", "promotion_id", "product_id"),
    "suppliers": ("tenant_id", "supplier_id"),
    "customers": ("tenant_id", "customer_id"),
    "stores": ("tenant_id", "store_id"),
    "categories": ("tenant_id", "category_id"),
}

CATEGORICALS = {
    "products": ("status", "currency", "unit_of_measure"),
    "sales": ("order_status", "payment_method", "currency"),
    "inventory": ("location_type",),
    "promotions": ("promotion_type", "discount_type", "status"),
    "suppliers": ("status",),
    "customers": ("customer_segment",),
    "stores": ("store_type", "status"),
    "categories": ("status",),
}

REQUIRED = {
    "products": ("product_id", "tenant_id", "sku", "product_name", "supplier_id", "unit_price", "cost_price"),
    "sales": ("order_id", "tenant_id", "customer_id", "store_id"),
    "sales_items": ("order_id", "tenant_id", "order_item_id", "product_id", "quantity", "unit_price"),
    "inventory": ("inventory_id", "tenant_id", "product_id", "location_id", "quantity_on_hand"),
    "promotions": (
        "promotion_id", "tenant_id", "promotion_code", "start_date", "end_date", "discount_type", "discount_value",
    ),
    "promotion_products": ("promotion_id", "tenant_id", "product_id"),
    "suppliers": ("supplier_id", "tenant_id", "supplier_code", "supplier_name"),
    "customers": ("customer_id", "tenant_id", "customer_code"),
    "stores": ("store_id", "tenant_id", "store_code"),
    "categories": ("category_id", "tenant_id", "category_name"),
}

RULES = {
    "products": (
        ("unit_price must be >= 0", "unit_price < 0"),
        ("cost_price must be >= 0", "cost_price < 0"),
        ("tax_rate must be between 0 and 100", "tax_rate NOT BETWEEN 0 AND 100"),
    ),
    "sales_items": (
        ("quantity must be > 0", "quantity <= 0"),
        ("unit_price must be >= 0", "unit_price < 0"),
        ("discount_amount must be >= 0", "discount_amount < 0"),
        ("tax_amount must be >= 0", "tax_amount < 0"),
        ("line_total must be >= 0", "line_total < 0"),
    ),
    "inventory": (
        ("quantity_on_hand must be >= 0", "quantity_on_hand < 0"),
        ("quantity_reserved must be >= 0", "quantity_reserved < 0"),
        ("quantity_available must be >= 0", "quantity_available < 0"),
        ("reorder_level must be >= 0", "reorder_level < 0"),
    ),
    "promotions": (
        ("discount_value must be >= 0", "discount_value < 0"),
        ("start_date must be <= end_date", "start_date > end_date"),
        ("percentage discount must be <= 100", "discount_type = 'PERCENTAGE' AND discount_value > 100"),
    ),
    "suppliers": (("rating must be between 0 and 5", "rating NOT BETWEEN 0 AND 5"),),
}

# --- end of fixed values ---------------------------------------------------------------------------------------------

# Foreign keys checked by the referential-integrity operator: child dataset -> ((child column, parent dataset, parent column), ...)
FOREIGN_KEYS = {
    "products": (("supplier_id", "suppliers", "supplier_id"),),
    "sales_items": (("order_id", "sales", "order_id"), ("product_id", "products", "product_id")),
}


@dataclass(frozen=True)
class DatasetSpec:
    name: str
    schema: T.StructType
    keys: tuple[str, ...]
    categoricals: tuple[str, ...] = ()
    required: tuple[str, ...] = ()
    rules: tuple[tuple[str, str], ...] = ()
    foreign_keys: tuple[tuple[str, str, str], ...] = ()
    order_column: str | None = "updated_at"

    @property
    def timestamps(self) -> tuple[str, ...]:
        return tuple(f.name for f in self.schema if isinstance(f.dataType, T.TimestampType))


def _spec(name: str) -> DatasetSpec:
    schema = T.StructType.fromDDL(SCHEMAS[name])
    return DatasetSpec(
        name=name,
        schema=schema,
        keys=KEYS[name],
        categoricals=CATEGORICALS.get(name, ()),
        required=REQUIRED.get(name, ()),
        rules=RULES.get(name, ()),
        foreign_keys=FOREIGN_KEYS.get(name, ()),
        order_column="updated_at" if "updated_at" in schema.fieldNames() else None,
    )


SPECS: dict[str, DatasetSpec] = {}


def spec(name: str) -> DatasetSpec:
    """The specification of one dataset, built on first use (DDL parsing needs a running session)."""
    if name not in SPECS:
        SPECS[name] = _spec(name)
    return SPECS[name]
