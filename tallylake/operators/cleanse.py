"""Bronze to silver: typing, normalisation, de-duplication and projections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallylake.specs import TRACE_COLUMNS, DatasetSpec

LOST = "_lost_in_cast"

# fixed values: an attribute whose lower-cased name contains one of these is never passed on
SENSITIVE_TOKENS = (
    "secret", "password", "token", "credential", "license_key", "aws_access_key", "aws_secret", "authorization",
)


def _typed(name: str, target: T.DataType) -> Column:
    if isinstance(target, T.TimestampType):
        return F.col(name).try_cast("timestamp")
    return F.col(name).try_cast(target)


def cast_to_schema(df: DataFrame, spec: DatasetSpec, mark_lost: bool = False) -> DataFrame:
    """Project to the dataset schema plus trace columns; columns the source lacks are left out.

    A value that cannot be cast becomes NULL instead of failing the job. With ``mark_lost`` the names of such columns
    are kept in an array, which validation turns into errors.
    """
    present = [f for f in spec.schema if f.name in df.columns]
    columns = [_typed(f.name, f.dataType).alias(f.name) for f in present]
    columns += [F.col(c) for c in TRACE_COLUMNS if c in df.columns]
    if mark_lost:
        source = dict(df.dtypes)
        lossy = [f for f in present if source[f.name] != f.dataType.simpleString()]
        flags = [F.when(F.col(f.name).isNotNull() & _typed(f.name, f.dataType).isNull(), F.lit(f.name)) for f in lossy]
        columns.append(F.array_compact(F.array(*flags).cast("array<string>")).alias(LOST))
    return df.select(*columns)


def normalize_timestamps(df: DataFrame, spec: DatasetSpec) -> DataFrame:
    return df.withColumns({c: F.col(c).try_cast("timestamp") for c in spec.timestamps if c in df.columns})


def normalize_categoricals(df: DataFrame, spec: DatasetSpec) -> DataFrame:
    return df.withColumns({c: F.upper(F.trim(c)) for c in spec.categoricals if c in df.columns})


def _newest_first(df: DataFrame, keys: tuple[str, ...], order_column: str) -> list[Column]:
    """Newest first, then every comparable column, so that equal times still give one fixed winner."""
    rest = [
        f.name for f in df.schema
        if f.name not in keys and f.name != order_column and not isinstance(f.dataType, (T.MapType, T.VariantType))
    ]
    return [F.col(order_column).desc_nulls_last(), *[F.col(c).asc_nulls_last() for c in rest]]


def first_per_key(df: DataFrame, keys: list[str] | tuple[str, ...], order: list[Column], n: int = 1) -> DataFrame:
    """The first ``n`` rows of every key.

    The rank limit makes Spark cut each group to ``n`` rows *before* the shuffle, so one hot key moves at most
    ``n`` rows per task. Keys are handed over most selective first (the tenant leads every key): sorting compares the
    leading bytes of the first column, and those of a tenant id are all alike.
    """
    ranked = df.withColumn("_rank", F.row_number().over(Window.partitionBy(*reversed(keys)).orderBy(*order)))
    return ranked.filter(F.col("_rank") <= n).drop("_rank")


def one_per_key(
    df: DataFrame, keys: list[str] | tuple[str, ...], order: list[Column], copies: str | None = None, weight: Column | None = None,
    place: tuple[str, ...] = (),
) -> DataFrame:
    """The first row of every key, for keys that are nearly unique: one shuffle and one sort.

    An early cut would sort the whole table before the shuffle and remove next to nothing; the count of a key's rows, kept in the same
    window, rules it out and is there for ``copies``. Keys that may be hot take :func:`first_per_key`. With ``weight`` rows stand for
    that many, and their sum is kept. ``place`` names columns that follow from the key: rows that were dealt by some of them and the key
    are not shuffled again.
    """
    by_key = Window.partitionBy(*place, *reversed(keys)).orderBy(*order)
    whole = by_key.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    total = F.count(F.lit(1)) if weight is None else F.sum(weight)
    counted = df.withColumns({"_rank": F.row_number().over(by_key), copies or "_copies": total.over(whole)})
    return counted.filter((F.col("_rank") == 1) & (F.col(copies or "_copies") > 0)).drop("_rank", *([] if copies else ["_copies"]))


def dedup_latest(df: DataFrame, spec: DatasetSpec, copies: str | None = None) -> DataFrame:
    """Latest row per business key, with the number of its rows in ``copies`` if named; without an order column only exact key
    repeats collapse."""
    if spec.order_column is None or spec.order_column not in df.columns:
        return dedup_items(df, spec, copies)
    return one_per_key(df, spec.keys, _newest_first(df, spec.keys, spec.order_column), copies)


def dedup_items(df: DataFrame, spec: DatasetSpec, copies: str | None = None) -> DataFrame:
    """One row per key when rows carry no change time: the last ingested, then the smallest in column order."""
    rest = [c for c in df.columns if c not in spec.keys]
    if not rest:
        return df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias(copies)) if copies else df.distinct()
    return one_per_key(df, spec.keys, _ingested_last(df, spec), copies)


def _ingested_last(df: DataFrame, spec: DatasetSpec) -> list[Column]:
    rest = [c for c in df.columns if c not in spec.keys]
    ingested = [F.col(c).desc_nulls_last() for c in rest if c == "ingestion_timestamp"]
    return ingested + [F.col(c).asc_nulls_last() for c in rest if c != "ingestion_timestamp"]


def latest_of_weighted(df: DataFrame, spec: DatasetSpec, copies: str, place: tuple[str, ...] = ()) -> DataFrame:
    """Latest row per business key of rows that stand for ``copies`` source rows each, which add up; the winners are those that
    :func:`dedup_latest` has among the source rows."""
    plain = df.drop(copies, *place)
    order = _ingested_last(plain, spec) if spec.order_column is None else _newest_first(plain, spec.keys, spec.order_column)
    weighted = df.withColumnRenamed(copies, "_weight")
    return one_per_key(weighted, spec.keys, order, copies, F.col("_weight"), place).drop("_weight")


def explode_order_items(orders: DataFrame) -> DataFrame:
    """One row per nested order item; the tenant is the order's (trusted), never the one inside the item."""
    item_fields = orders.schema["items"].dataType.elementType.fieldNames()
    carried = [c for c in ("tenant_id", "order_id", *TRACE_COLUMNS) if c in orders.columns]
    exploded = orders.select(*carried, F.explode("items").alias("_item"))
    return exploded.select(*carried, *[F.col(f"_item.{f}").alias(f) for f in item_fields if f not in carried])


def orders_without_items(orders: DataFrame) -> DataFrame:
    return orders.drop("items")


def curated_products(products: DataFrame) -> DataFrame:
    return products.filter("status = 'ACTIVE'").select(
        "product_id", "tenant_id", "sku", "product_name", "category_name", "brand", "supplier_id", "unit_price",
        "cost_price", "tax_rate", "status", "created_at", "updated_at",
    )


def curated_sales(orders: DataFrame) -> DataFrame:
    """Orders that are not cancelled; an order without a status is dropped too."""
    return orders.filter("order_status <> 'CANCELLED'").select(
        "order_id", "tenant_id", "customer_id", "store_id", "order_date", "order_status", "payment_method",
        "total_amount", "discount_amount", "tax_amount", "net_amount",
    )


def provenance_columns(df: DataFrame, pipeline_id: str, run_id: str, stamp: str) -> DataFrame:
    return df.withColumns({
        "pipeline_id": F.lit(pipeline_id), "run_id": F.lit(run_id), "transformation_timestamp": F.lit(stamp),
    })


def is_sensitive(name: str) -> bool:
    return any(token in name.lower() for token in SENSITIVE_TOKENS)


def drop_sensitive_columns(df: DataFrame) -> DataFrame:
    return df.select(*[c for c in df.columns if not is_sensitive(c)])


def drop_sensitive_keys(attributes: Column | str) -> Column:
    """The same rule for the keys of a map column."""

    def harmless(key: Column, _value: Column) -> Column:
        return ~F.lower(key).rlike("|".join(SENSITIVE_TOKENS))

    return F.map_filter(attributes, harmless)


def schema_backfill(df: DataFrame, defaults: dict[str, Column], legacy: dict[str, str] | None = None) -> DataFrame:
    """Add missing columns and fill NULLs: first from the legacy column of that field, then from the default."""
    legacy = legacy or {}
    filled = {}
    for name, default in defaults.items():
        sources = [F.col(c) for c in (name, legacy.get(name)) if c and c in df.columns]
        filled[name] = F.coalesce(*sources, default)
    return df.withColumns(filled)
