"""Price arithmetic in exact decimals."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MONEY = "decimal(18,4)"


def as_money(value: Column) -> Column:
    return value.cast(MONEY)


def unit_discount(price: str = "base_price") -> Column:
    """Discount per unit of the promotion on the row, never above the price nor above the promotion's own limit.

    Rounded to four places here, because later amounts are multiples of the rounded discount.
    """
    base, value = F.col(price), F.col("discount_value")
    offered = (
        F.when(F.col("discount_type") == "PERCENTAGE", base * value / F.lit(100))
        .when(F.col("discount_type") == "FIXED_AMOUNT", value)
        .otherwise(F.lit(0))
    )
    # least() skips NULLs: no limit, no effect
    granted = F.least(F.coalesce(offered, F.lit(0)), base, F.col("maximum_discount"))
    return as_money(F.when(F.col("promotion_id").isNotNull(), granted).otherwise(F.lit(0)))


def price_ladder() -> dict[str, Column]:
    """Final, net, gross and discount amounts from base_price, unit_discount, tax_rate and quantity_sold."""
    final = F.col("base_price") - F.col("unit_discount")
    return {
        "final_price": as_money(final),
        "net_price": as_money(final * (F.lit(1) + F.col("tax_rate") / F.lit(100))),
        "gross_amount": as_money(F.col("quantity_sold") * F.col("base_price")),
        "discount_amount": as_money(F.col("quantity_sold") * F.col("unit_discount")),
    }


def money_ratio(total: Column, count: Column) -> Column:
    """total / count in money, 0 if there is nothing to divide by."""
    quotient = F.try_divide(total.cast("decimal(38,4)"), count.cast("bigint"))
    return as_money(F.when(count > 0, quotient).otherwise(F.lit(0)))
