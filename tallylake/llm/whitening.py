"""Embedding whitening over MLlib's distributed block matrices.

Vectors become integers (``integers``), so counts, sums and deviations are exact. Rows are numbered from 0 by the places where they are
stored, centred, and indexed into a BlockMatrix of ``BLOCK_ROWS`` rows a block. The blocks' transpose times the blocks is the scatter, with
the middle dimension split so that a task multiplies a few row blocks (``SPLIT_BYTES``) and adds up their products; only the scatter,
dimensions squared, reaches the driver, where its eigenvectors are found. A second block product with the whitening matrix projects
all rows.

Defined cases: a vector that is null or empty or holds a null, NaN or infinite entry is dropped; so are vectors whose length isn't the most
frequent one (the larger of equally frequent ones); rows repeated in full, equal vec_ids and null vec_ids are rows of their own;
directions without variance (below 1e-12 of the largest) have no component, so there may be fewer than ``components``; a table without
usable vectors gives no rows; other columns are ignored. A ``deviation`` beyond 64 bits is null.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import Matrices
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallylake.llm.common import cut, running_offsets

BLOCK_ROWS = 1024
BLOCK_COLUMNS = 1024
SPLIT_BYTES = 4 << 20  # of row blocks that one task of the scatter multiplies
SCHEMA = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def integers(embeddings: DataFrame, column: str = "embedding", scale: int = 1024, shift: int = 100_000) -> DataFrame | None:
    """(row, vec_id, x): usable vectors as integers, numbered from 0; None if there are none."""
    entries = F.transform(column, lambda c: c.cast("double"))
    sound = F.forall(entries, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    usable = embeddings.where(F.col(column).isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), entries.alias("c")).where((F.size("c") > 0) & sound)
    lengths = usable.groupBy(F.size("c").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    if lengths is None:
        return None
    whole = F.transform("c", lambda c: F.floor(F.lit(float(scale)) * c) + F.lit(shift).cast("long"))
    stored = cut(usable.where(F.size("c") == lengths["d"]).select(F.monotonically_increasing_id().alias("_place"), "vec_id", whole.alias("x")))
    part, within = F.shiftright("_place", 33), F.col("_place").bitwiseAND((1 << 33) - 1)
    placed = stored.select(part.alias("_part"), within.alias("_within"), "vec_id", "x")
    # the places were given after the filters, so a part's numbers have no gaps
    sizes = placed.groupBy("_part").agg((F.max("_within") + 1).alias("_size"))
    ahead = running_offsets(sizes, "_part", "_size", "_before").select("_part", "_before")
    return placed.join(F.broadcast(ahead), "_part").select((F.col("_before") + F.col("_within")).cast("long").alias("row"), "vec_id", "x")  # a row per task of the scan


def totals(rows: DataFrame) -> tuple[int, np.ndarray, int]:
    """Rows, exact sums per dimension, and the largest distance between two entries of one dimension."""
    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, total, low, high = 0, None, None, None
        for batch in batches:
            if len(batch):
                x = np.stack(batch["x"].to_numpy())
                n += len(x)
                total = x.sum(axis=0) if total is None else total + x.sum(axis=0)
                low = x.min(axis=0) if low is None else np.minimum(low, x.min(axis=0))
                high = x.max(axis=0) if high is None else np.maximum(high, x.max(axis=0))
        if n:
            yield pd.DataFrame({"pos": np.arange(len(total)), "n": n, "s": total, "low": low, "high": high})

    parts = rows.select("x").mapInPandas(add, "pos int, n long, s long, low long, high long")
    sums = parts.groupBy("pos").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.min("low").alias("low"), F.max("high").alias("high")).orderBy("pos").collect()
    return sums[0]["n"], np.array([r["s"] for r in sums], dtype=object), max(r["high"] - r["low"] for r in sums)


def block_matrix(rows: DataFrame, n: int, d: int) -> BlockMatrix:
    """``rows`` (row, centred) as distributed blocks."""
    indexed = MLUtils.convertVectorColumnsFromML(rows.select(F.col("row").alias("index"), array_to_vector("centred").alias("vector")), "vector")
    return IndexedRowMatrix(indexed, n, d).toBlockMatrix(BLOCK_ROWS, BLOCK_COLUMNS)


def scatter(matrix: BlockMatrix) -> np.ndarray:
    """The matrix' transpose times itself; each task multiplies and adds its part of the row blocks."""
    row_blocks = -(-matrix.numRows() // BLOCK_ROWS)
    splits = max(1, row_blocks * BLOCK_ROWS * 8 * matrix.numCols() // SPLIT_BYTES)
    product = matrix.transpose()._java_matrix_wrapper.call("multiply", matrix._java_matrix_wrapper._java_model, splits)
    return BlockMatrix(product, BLOCK_COLUMNS, BLOCK_COLUMNS).toLocalMatrix().toArray()


def projected(matrix: BlockMatrix, columns: np.ndarray) -> DataFrame:
    """(row, z): every row times ``columns``."""
    d, k = columns.shape
    sc = matrix._java_matrix_wrapper._sc
    blocks = [((i // BLOCK_COLUMNS, 0), Matrices.dense(len(part), k, part.T.ravel())) for i in range(0, d, BLOCK_COLUMNS) for part in [columns[i:i + BLOCK_COLUMNS]]]
    right = BlockMatrix(sc.parallelize(blocks, 1), BLOCK_COLUMNS, BLOCK_COLUMNS, d, k)
    product = matrix.multiply(right).toIndexedRowMatrix()
    found = callMLlibFunc("getIndexedRows", product._java_matrix_wrapper._java_model)
    plain = MLUtils.convertVectorColumnsToML(found.withColumnsRenamed({found.columns[0]: "row", found.columns[1]: "z"}), "z")
    return plain.select("row", vector_to_array("z").alias("z"))


def identity_error(z: DataFrame, n: int, k: int) -> float:
    """Largest absolute entry of the covariance of ``z`` minus the identity."""
    means = z.agg(*[F.avg(F.get("z", F.lit(i))).alias(f"m{i}") for i in range(k)]).first()
    centred = [F.get("z", F.lit(i)) - F.lit(means[i]) for i in range(k)]
    products = z.agg(*[F.sum(centred[i] * centred[j]).alias(f"p{i}_{j}") for i in range(k) for j in range(i + 1)]).first()
    return max(abs(products[f"p{i}_{j}"] / n - (i == j)) for i in range(k) for j in range(i + 1))


def whiten(embeddings: DataFrame, components: int = 8) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) of every usable row and component."""
    spark = embeddings.sparkSession
    rows = integers(embeddings)
    if rows is None:
        return spark.createDataFrame([], SCHEMA)
    rows = cut(rows)
    n, sums, spread = totals(rows)
    d = len(sums)
    apart = F.zip_with("x", F.lit([int(s) for s in sums]), lambda x, s: n * x - s)  # n times the distance from the mean, exact
    if d * (n * int(spread)) ** 2 < 1 << 63:
        deviation = F.aggregate(apart, F.lit(0).cast("long"), lambda total, v: total + v * v)
    else:
        wide = F.zip_with("x", F.lit([int(s) for s in sums]), lambda x, s: (x.cast("decimal(19,0)") * F.lit(n).cast("decimal(18,0)") - s).cast("decimal(19,0)"))
        deviation = F.aggregate(wide, F.lit(0).cast("decimal(38,0)"), lambda total, v: (total + v * v).cast("decimal(38,0)")).try_cast("long")
    centred = F.transform(apart, lambda v: v.cast("double") / F.lit(float(n)))
    matrix = block_matrix(rows.select("row", centred.alias("centred")), n, d)
    covariance = scatter(matrix) / n
    values, vectors = np.linalg.eigh((covariance + covariance.T) / 2)
    order = np.argsort(-values, kind="stable")[:components]
    order = order[values[order] > 1e-12 * max(values.max(), 0)]
    if not len(order):
        return spark.createDataFrame([], SCHEMA)
    z = cut(projected(matrix, vectors[:, order] / np.sqrt(values[order])))
    error = identity_error(z, n, len(order))
    explained = F.lit([float(values[i] / np.trace(covariance)) for i in order])
    return (
        rows.select("row", "vec_id", deviation.alias("deviation")).join(z, "row")
        .select("vec_id", "deviation", F.posexplode("z").alias("_at", "whitened"))
        .select("vec_id", (F.col("_at") + 1).cast("int").alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened",
                F.get(explained, F.col("_at")).alias("explained"), F.lit(error).alias("identity_error"))
    )
