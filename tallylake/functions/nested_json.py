"""JSON of unknown depth: the one place where Spark has no built-in expression."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# fixed values: keys whose content is log text
LOG_KEYS = frozenset({"log", "logs", "log_entry", "log_entries", "raw_logs"})


def _without_logs(node: object) -> object:
    if isinstance(node, dict):
        return {k: _without_logs(v) for k, v in node.items() if k.lower() not in LOG_KEYS}
    if isinstance(node, list):
        return [_without_logs(v) for v in node]
    return node


def _clean(text: str | None) -> str | None:
    if text is None:
        return None
    try:
        node = json.loads(text)
    except ValueError:
        return text
    return json.dumps(_without_logs(node), ensure_ascii=False, separators=(",", ":"))


@F.pandas_udf(StringType())
def strip_log_keys_json(payloads: pd.Series) -> pd.Series:
    """Drop log-carrying keys at every depth of a JSON text; text that is not JSON passes unchanged."""
    return payloads.map(_clean)


def strip_log_keys_map(payload: Column | str) -> Column:
    """The same for a flat map, without leaving the JVM."""
    return F.map_filter(payload, lambda k, _: ~F.lower(k).isin(*sorted(LOG_KEYS)))
