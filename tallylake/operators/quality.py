"""Validation, quarantine, quality metrics and gates."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallylake.functions.text import identifier_is_clean
from tallylake.operators.cleanse import LOST
from tallylake.specs import INVALID_RATE_LIMIT, DatasetSpec


def _messages(checks: Iterable[tuple[str, Column]]) -> Column:
    found = [F.when(failed, F.lit(text)) for text, failed in checks]
    return F.array_compact(F.array(*found).cast("array<string>"))


def required_field_errors(spec: DatasetSpec) -> Column:
    """Messages of the required fields that are NULL. Blank text is a value and passes."""
    return _messages((f"{c} is required", F.col(c).isNull()) for c in spec.required)


def rule_errors(spec: DatasetSpec) -> Column:
    return _messages((text, F.expr(predicate)) for text, predicate in spec.rules)


def cast_errors(df: DataFrame) -> Column:
    if LOST not in df.columns:
        return F.array().cast("array<string>")
    return F.transform(LOST, lambda c: F.concat(c, F.lit(" has invalid type")))


def row_is_valid(df: DataFrame, spec: DatasetSpec) -> Column:
    """The verdict alone, as one boolean expression without building any message."""
    tests = [F.col(c).isNotNull() for c in spec.required]
    tests += [~F.coalesce(F.expr(predicate), F.lit(False)) for _, predicate in spec.rules]
    if LOST in df.columns:
        tests.append(F.size(LOST) == 0)
    return reduce(Column.__and__, tests, F.lit(True))


def validation_errors(df: DataFrame, spec: DatasetSpec) -> DataFrame:
    """Add ``validation_errors``: all messages in order, empty for a valid row (which costs the verdict only)."""
    none = F.array().cast("array<string>")
    errors = F.concat(required_field_errors(spec), rule_errors(spec), cast_errors(df))
    return df.withColumn("validation_errors", F.when(row_is_valid(df, spec), none).otherwise(errors)).drop(LOST)


def valid_only(df: DataFrame, spec: DatasetSpec) -> DataFrame:
    """Valid rows where nobody asks for messages: equals ``valid_rows(validation_errors(df, spec))``."""
    return df.filter(row_is_valid(df, spec)).drop(LOST)


def valid_rows(validated: DataFrame) -> DataFrame:
    return validated.filter(F.size("validation_errors") == 0).drop("validation_errors")


def invalid_rows(validated: DataFrame) -> DataFrame:
    return validated.filter(F.size("validation_errors") > 0)


def split_valid_invalid(validated: DataFrame) -> tuple[DataFrame, DataFrame]:
    return valid_rows(validated), invalid_rows(validated)


def quarantine(validated: DataFrame, stamp: str, processing_date: str) -> DataFrame:
    return (
        invalid_rows(validated)
        .withColumn("validation_error", F.array_join("validation_errors", "; "))
        .drop("validation_errors")
        .withColumns({"validation_timestamp": F.lit(stamp), "processing_date": F.lit(processing_date)})
    )


def orphan_counts(child: DataFrame, spec: DatasetSpec, parents: dict[str, DataFrame]) -> DataFrame:
    """Rows per tenant and foreign key whose (non-NULL) key has no parent in the same tenant."""
    counts = []
    for column, parent_name, parent_column in spec.foreign_keys:
        keys = parents[parent_name].select("tenant_id", F.col(parent_column).alias(column))
        # pre-aggregated: one row per key value goes into the join, whatever the number of children
        used = child.filter(F.col(column).isNotNull()).groupBy("tenant_id", column).agg(F.count(F.lit(1)).alias("_n"))
        orphans = used.join(keys, [column, "tenant_id"], "left_anti")
        counts.append(
            orphans.groupBy("tenant_id").agg(F.sum("_n").alias("orphans"), F.count(F.lit(1)).alias("orphan_keys"))
            .withColumn("foreign_key", F.lit(f"{spec.name}.{column} -> {parent_name}.{parent_column}"))
        )
    return reduce(DataFrame.unionByName, counts)


def quality_metrics(
    checked: DataFrame, spec: DatasetSpec, orphans: DataFrame | None = None, tenants: DataFrame | None = None, copies: str = "source_copies"
) -> DataFrame:
    """Counts per tenant in one pass over checked rows, each of which knows how many source rows it stands for (``copies``).

    With ``tenants`` every tenant has a row, of zeros where the dataset has none of its records.
    """
    required = F.exists("validation_errors", lambda m: m.endswith(" is required"))
    rule = F.exists("validation_errors", lambda m: ~m.endswith(" is required"))
    result = checked.groupBy("tenant_id").agg(
        F.sum(copies).alias("input_record_count"),
        F.count(F.lit(1)).alias("_distinct"),
        F.count_if(F.size("validation_errors") == 0).alias("valid_record_count"),
        F.count_if(required).alias("null_violation_count"),
        F.count_if(rule).alias("business_rule_violation_count"),
    )
    if tenants is not None:
        result = tenants.select("tenant_id").distinct().join(result, "tenant_id", "left")
    if orphans is not None:
        broken = orphans.groupBy("tenant_id").agg(F.sum("orphans").alias("referential_integrity_failure_count"))
        result = result.join(broken, "tenant_id", "left")
    else:
        result = result.withColumn("referential_integrity_failure_count", F.lit(0))
    zero = F.lit(0).cast("bigint")

    def number(name: str) -> Column:
        return F.coalesce(F.col(name).cast("bigint"), zero)

    return result.select(
        F.lit(spec.name).alias("dataset"),
        "tenant_id",
        number("input_record_count").alias("input_record_count"),
        (number("input_record_count") - number("_distinct")).alias("duplicate_record_count"),
        number("valid_record_count").alias("valid_record_count"),
        (number("_distinct") - number("valid_record_count")).alias("invalid_record_count"),
        number("valid_record_count").alias("output_record_count"),
        number("null_violation_count").alias("null_violation_count"),
        number("business_rule_violation_count").alias("business_rule_violation_count"),
        number("referential_integrity_failure_count").alias("referential_integrity_failure_count"),
    )


def invalid_rate_gate(metrics: DataFrame, limit: float = INVALID_RATE_LIMIT) -> DataFrame:
    """Breach flag per dataset and tenant. Exactly the limit still passes; an empty input has rate 0."""
    # compared as counts, so that the limit itself is met exactly
    bound = F.greatest(F.col("input_record_count"), F.lit(1)) * F.lit(str(limit)).cast("decimal(10,6)")
    breached = F.col("invalid_record_count") > bound
    return metrics.select(
        "dataset", "tenant_id", "input_record_count", "invalid_record_count",
        F.round(F.col("invalid_record_count") / F.greatest(F.col("input_record_count"), F.lit(1)), 4).alias("invalid_rate"),
        breached.alias("breached"),
        F.when(breached, "FAILED").otherwise("SUCCESS").alias("status"),
    )


# --- fixed values: failure texts of the gold checks
GOLD_CHECKS = {
    "null_tenant": "tenant_id is null for one or more records",
    "null_product": "product_id is null for one or more records",
    "duplicate_keys": "{} duplicate (tenant_id, product_id) business keys",
    "negative_price": "final_price is negative for one or more records",
    "discount_above_gross": "discount_amount exceeds gross_amount for one or more records",
}


def gold_checks(pricing: DataFrame, *scope: str) -> DataFrame:
    """Failure counts, one row (or one per ``scope`` value, e.g. tenant_id).

    Keys are grouped once and every check is folded into that same pass.
    """
    per_key = pricing.groupBy("tenant_id", "product_id").agg(
        F.count(F.lit(1)).alias("_copies"),
        F.count_if(F.col("final_price") < 0).alias("_negative"),
        F.count_if(F.col("discount_amount") > F.col("gross_amount")).alias("_above"),
    )

    def total(value: Column) -> Column:
        return F.coalesce(F.sum(value), F.lit(0)).cast("bigint")

    return per_key.groupBy(*scope).agg(
        total(F.when(F.col("tenant_id").isNull(), F.col("_copies"))).alias("null_tenant"),
        total(F.when(F.col("product_id").isNull(), F.col("_copies"))).alias("null_product"),
        total(F.when(F.col("_copies") > 1, F.lit(1))).alias("duplicate_keys"),
        total(F.col("_negative")).alias("negative_price"),
        total(F.col("_above")).alias("discount_above_gross"),
    )


def failing(checks: DataFrame) -> DataFrame:
    return checks.filter(" + ".join(GOLD_CHECKS) + " > 0")


def without_tenants(rows: DataFrame, tenants: DataFrame) -> DataFrame:
    """Rows of all other tenants. Hand in ``tenants`` read back from a file: its size is then known, so Spark can send the few names
    to the rows and never has to gather a tenant's rows in one place."""
    names = tenants.select(F.col("tenant_id").alias("_tenant"))
    return rows.join(names, F.col("tenant_id").eqNullSafe(F.col("_tenant")), "left_anti")


def publish_gate(gold: DataFrame, failed: DataFrame) -> DataFrame:
    """Rows of ``gold`` of the tenants whose pricing passes every check; a tenant in ``failed`` publishes nothing."""
    return without_tenants(gold, failed)


def gold_failures() -> Column:
    """Failure texts of a :func:`gold_checks` row, as an array."""
    texts = [F.when(F.col(name) > 0, F.replace(F.lit(text), F.lit("{}"), F.col(name).cast("string"))) for name, text in GOLD_CHECKS.items()]
    return F.array_compact(F.array(*texts))


def quality_failures(gate: DataFrame) -> Column:
    """Text of a breached :func:`invalid_rate_gate` row."""
    return F.when(F.col("breached"), F.concat(
        "dataset", F.lit(": invalid rate "), F.format_number(F.col("invalid_rate") * 100, 2), F.lit("% exceeds the limit ("),
        F.col("invalid_record_count").cast("string"), F.lit("/"), F.col("input_record_count").cast("string"), F.lit(" records quarantined)")))


def duplicate_keys(df: DataFrame, keys: Iterable[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1")


STAGES = ("bronze", "silver", "gold")


def stage_rollup(records: DataFrame) -> DataFrame:
    """Stage status per run from dataset statuses (run_id, tenant_id, stage, status), overall status beside it.

    A stage without records is SKIPPED if an earlier one did not succeed, else FAILED; one whose records are all SKIPPED is SKIPPED.
    """
    counts = records.groupBy("run_id", "tenant_id").agg(*[
        F.struct(
            F.count_if(F.col("stage") == s).alias("n"),
            F.count_if((F.col("stage") == s) & (F.col("status") == "SUCCESS")).alias("good"),
            F.count_if((F.col("stage") == s) & (F.col("status") == "SKIPPED")).alias("skipped"),
        ).alias(f"_{s}")
        for s in STAGES
    ])
    earlier = F.lit(True)
    for s in STAGES:
        n = F.col(f"_{s}")
        status = (
            F.when(n["n"] == 0, F.when(earlier, "FAILED").otherwise("SKIPPED"))
            .when(n["good"] == n["n"], "SUCCESS").when(n["skipped"] == n["n"], "SKIPPED").otherwise("FAILED")
        )
        counts = counts.withColumn(f"{s}_status", status)
        earlier = earlier & (F.col(f"{s}_status") == "SUCCESS")
    return counts.select(
        "run_id", "tenant_id", *[f"{s}_status" for s in STAGES],
        F.when(earlier, "SUCCESS").otherwise("FAILED").alias("overall_status"),
    )


def require_tenant_column(*frames: DataFrame) -> None:
    """Fail before any join if an input cannot be scoped to its tenant."""
    for frame in frames:
        if "tenant_id" not in frame.columns:
            raise ValueError(f"tenant_id is missing from columns {frame.columns}")


def scope_violations(rows: DataFrame, id_column: str, tenant_id: str | None = None, platform_id: str | None = None) -> DataFrame:
    """Rows outside the requested tenant or platform, and ids that occur more than once."""
    wrong = F.lit(False)
    if tenant_id:
        wrong = wrong | ~F.col("tenant_id").eqNullSafe(F.lit(tenant_id))
    if platform_id:
        wrong = wrong | ~F.col("platform_id").eqNullSafe(F.lit(platform_id))
    per_id = rows.groupBy(id_column).agg(F.count_if(wrong).alias("out_of_scope"), F.count(F.lit(1)).alias("copies"))
    return per_id.filter("out_of_scope > 0 OR copies > 1")


def identifier_check(rows: DataFrame, *columns: str) -> DataFrame:
    return rows.withColumns({f"{c}_ok": identifier_is_clean(c) for c in columns})


def order_total_reconciliation(orders: DataFrame, items: DataFrame) -> DataFrame:
    """Order amounts next to the amounts of their items; an order without items is compared with zero."""
    money = "decimal(18,4)"
    sums = items.groupBy("order_id", "tenant_id").agg(
        F.sum(F.col("unit_price") * F.col("quantity")).alias("_total"),
        F.sum("discount_amount").alias("_discount"),
        F.sum("tax_amount").alias("_tax"),
    )
    joined = orders.join(sums, ["order_id", "tenant_id"], "left")

    def amount(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit(0)).cast(money)

    result = joined.select(
        "tenant_id", "order_id", "total_amount", "discount_amount", "tax_amount", "net_amount",
        amount("_total").alias("items_total"), amount("_discount").alias("items_discount"), amount("_tax").alias("items_tax"),
    ).withColumn("items_net", (F.col("items_total") - F.col("items_discount") + F.col("items_tax")).cast(money))
    same = [F.col(f"{c}_amount").eqNullSafe(F.col(f"items_{c}")) for c in ("total", "discount", "tax", "net")]
    return result.withColumn("matches", reduce(Column.__and__, same))
