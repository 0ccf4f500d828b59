"""The silver step of one dataset."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tallylake.operators.cleanse import (
    cast_to_schema,
    dedup_latest,
    normalize_categoricals,
    normalize_timestamps,
)
from tallylake.operators.quality import valid_only, validation_errors
from tallylake.specs import spec


def silver_cast(raw: DataFrame, dataset: str) -> DataFrame:
    """Typed and normalised rows, all versions of a key."""
    rules = spec(dataset)
    return normalize_categoricals(normalize_timestamps(cast_to_schema(raw, rules, mark_lost=True), rules), rules)


def silver_typed(raw: DataFrame, dataset: str, copies: str | None = None) -> DataFrame:
    """Typed, normalised and de-duplicated rows; ``copies`` names a column for the number of source rows each stands for."""
    return dedup_latest(silver_cast(raw, dataset), spec(dataset), copies)


def silver_checked(raw: DataFrame, dataset: str, copies: str | None = None) -> DataFrame:
    """The same rows with their ``validation_errors``."""
    return validation_errors(silver_typed(raw, dataset, copies), spec(dataset))


def silver_valid(raw: DataFrame, dataset: str) -> DataFrame:
    return valid_only(silver_typed(raw, dataset), spec(dataset))
