"""Incident memory: upsert, exact lookup, tenant-scoped similarity search and failure-signature matching."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallylake.operators.cleanse import first_per_key

# --- fixed values: result size, and the failure signatures of the two adapters ---------------------------------------

TOP_K = 5
FETCH_FACTOR = 3

FAILURE_PATTERNS = {
    "spark": {
        "executor_out_of_memory": ("OutOfMemoryError", "Java heap space", "executor"),
        "driver_out_of_memory": ("driver", "OutOfMemoryError", "GC overhead limit exceeded"),
        "executor_lost": ("ExecutorLostFailure", "executor lost", "killed"),
        "shuffle_fetch_failure": ("FetchFailedException", "shuffle", "fetch failed"),
        "data_skew": ("skew", "long running task", "single task"),
        "excessive_shuffle": ("shuffle_read_mb", "shuffle_write_mb", "large shuffle"),
        "schema_mismatch": ("schema", "cannot resolve", "AnalysisException", "column"),
        "source_connection_failure": ("connection refused", "source", "timeout", "unreachable"),
        "target_connection_failure": ("target", "sink", "write failed", "connection refused"),
        "permission_failure": ("AccessDenied", "permission", "403", "Forbidden"),
        "input_path_missing": ("Path does not exist", "FileNotFoundException", "no such file"),
    },
    "synapse": {
        "pipeline_timeout": ("timeout", "TimedOut"),
        "linked_service_failure": ("linked service", "connection", "unreachable"),
    },
}

# ---------------------------------------------------------------------------------------------------------------------

QUERY_BLOCK = 4096
MEMORY_BLOCK = 16384
_CHUNK = 256
# distances are compared at nine decimals, so that the order does not hang on the last bits of a sum
_DIGITS = 9

_CANDIDATES = "tenant_id string, query_id string, incident_id string, matches boolean, distance double"


def _unit_rows(vectors: pd.Series) -> np.ndarray:
    """Rows scaled to length one; a zero vector stays zero and is at distance 1 from everything."""
    matrix = np.asarray(vectors.tolist(), dtype=np.float64)
    length = np.sqrt((matrix * matrix).sum(axis=1, keepdims=True))
    return np.divide(matrix, length, out=np.zeros_like(matrix), where=length > 0)


def _nearest_in_block(fetch: int):
    """Nearest ``fetch`` memory rows per query, inside one (query block, memory block) pair."""

    def nearest(key: tuple, queries: pd.DataFrame, memory: pd.DataFrame) -> pd.DataFrame:
        asked, near, far = [], [], []
        if len(queries) and len(memory):
            q, m = _unit_rows(queries["embedding"]), _unit_rows(memory["embedding"]).T
            ids = memory["incident_id"].to_numpy().astype(str)
            for start in range(0, len(q), _CHUNK):
                distances = np.round(1.0 - q[start:start + _CHUNK] @ m, _DIGITS)
                if len(ids) > fetch:
                    bounds = np.partition(distances, fetch - 1, axis=1)[:, fetch - 1]
                else:
                    bounds = np.full(len(distances), np.inf)
                for row, (d, bound) in enumerate(zip(distances, bounds)):
                    # every row up to the bound, ties included; the sort settles them by id
                    hits = np.flatnonzero(d <= bound)
                    kept = hits[np.lexsort((ids[hits], d[hits]))[:fetch]]
                    asked.append(np.full(len(kept), start + row))
                    near.append(kept)
                    far.append(d[kept])
        rows = [np.concatenate(x) if x else np.array([], dtype=kind) for x, kind in ((asked, int), (near, int), (far, float))]
        question, answer = queries.iloc[rows[0]], memory.iloc[rows[1]]
        wanted, found = question["adapter"].to_numpy(), answer["adapter"].to_numpy()
        return pd.DataFrame({
            "tenant_id": key[0], "query_id": question["query_id"].to_numpy(), "incident_id": answer["incident_id"].to_numpy(),
            "matches": (wanted == found) & ~pd.isna(wanted), "distance": rows[2],
        })

    return nearest


def similar_incidents(
    queries: DataFrame,
    memory: DataFrame,
    top_k: int = TOP_K,
    query_block: int = QUERY_BLOCK,
    memory_block: int = MEMORY_BLOCK,
) -> DataFrame:
    """The ``top_k`` past incidents of the same tenant for every query (tenant_id, query_id, adapter, embedding).

    Exact search. Of the nearest ``3 * top_k`` by cosine distance, those of the query's adapter come first, then the more
    similar. Tenants are cut into blocks of bounded size and each pair of blocks is one matrix product in one task, which
    keeps only its nearest few; so no pairs are materialised, nothing is broadcast, and a tenant holding a third of the
    memory becomes many tasks.
    """
    fetch = max(FETCH_FACTOR * top_k, top_k)

    def block_count(df: DataFrame, size: int, name: str) -> DataFrame:
        return df.groupBy("tenant_id").agg(F.ceil(F.count(F.lit(1)) / F.lit(size)).cast("int").alias(name))

    blocks = block_count(queries, query_block, "q_blocks").join(block_count(memory, memory_block, "m_blocks"), "tenant_id")

    def spread(df: DataFrame, id_column: str, own: str, other: str) -> DataFrame:
        """Each row in its own block, once for every block of the other side."""
        # aliased, because queries and memory may come from the same table
        return df.join(blocks, "tenant_id").select(
            *[F.col(c).alias(c) for c in ("tenant_id", id_column, "adapter", "embedding")],
            F.expr(f"CAST(pmod(xxhash64({id_column}), {own}_blocks) AS INT)").alias(f"{own}_block"),
            F.explode(F.sequence(F.lit(0), F.col(f"{other}_blocks") - 1)).alias(f"{other}_block"),
        )

    keys = ["tenant_id", "q_block", "m_block"]
    left = spread(queries.filter(F.col("embedding").isNotNull()), "query_id", "q", "m")
    right = spread(memory.filter(F.col("embedding").isNotNull()), "incident_id", "m", "q")
    candidates = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(_nearest_in_block(fetch), _CANDIDATES)

    query_key = ["tenant_id", "query_id"]
    nearest = first_per_key(candidates, query_key, [F.col("distance").asc(), F.col("incident_id").asc()], fetch)
    similarity = F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.lit(1.0) - F.col("distance"))), 4)
    order = [F.col("matches").desc(), F.col("similarity").desc(), F.col("distance").asc(), F.col("incident_id").asc()]
    best = first_per_key(nearest.withColumn("similarity", similarity), query_key, order, top_k).drop("matches", "distance")
    facts = memory.select("tenant_id", "incident_id", "adapter", *[c for c in ("pipeline", "root_cause") if c in memory.columns])
    return best.join(facts, ["incident_id", "tenant_id"])


def memory_upsert(writes: DataFrame) -> DataFrame:
    """Latest document and metadata per (tenant, incident)."""
    return first_per_key(writes, ["tenant_id", "incident_id"], [F.col("written_at").desc(), F.col("event_id").desc()])


def metadata_as_text(metadata: Column | str) -> Column:
    """Values of a metadata struct as text, the form a flat store keeps."""
    return F.from_json(F.to_json(metadata), "map<string,string>")


def memory_get(memory: DataFrame, wanted: DataFrame) -> DataFrame:
    """Exact rows of the wanted (tenant, incident) pairs; the id of another tenant finds nothing."""
    keys = ["tenant_id", "incident_id"]
    return memory.join(wanted.select(*keys).distinct(), keys, "left_semi")


def failure_pattern_scan(incidents: DataFrame, text_column: str, patterns: dict[str, tuple[str, ...]]) -> DataFrame:
    """Signatures found in a text: how many of their indicators occur, ignoring case, and which share that is.

    Signatures are a handful of constants, so they are expressions on the row: one pass over the text, no join, and an
    indicator that several signatures share is searched once.
    """
    words = sorted({i.lower() for indicators in patterns.values() for i in indicators})
    searched = incidents.select("tenant_id", "incident_id", F.lower(text_column).alias("_text")).select(
        "tenant_id", "incident_id", F.array(*[F.contains("_text", F.lit(w)).cast("int") for w in words]).alias("_found")
    )

    def matched(name: str, indicators: tuple[str, ...]) -> Column:
        hits = sum((F.get("_found", F.lit(words.index(i.lower()))) for i in indicators), F.lit(0))
        return F.struct(
            F.lit(name).alias("pattern"), hits.alias("hits"), F.round(hits / F.lit(len(indicators)), 4).alias("hit_ratio")
        )

    scored = F.filter(F.array(*[matched(n, i) for n, i in patterns.items()]), lambda p: p["hits"] > 0)
    return searched.select("tenant_id", "incident_id", F.inline(scored))
