"""Approximate nearest neighbours by largest inner product, over randomly rotated one-bit codes.

Index: equal vectors become one class with its ``top + 1`` smallest ids (no query can use more of them). Centroids are fitted on at
most ``sample`` classes (one for every ``centroid_rows`` classes, up to ``most_centroids``), every class goes to its nearest
centroid, and a centroid's classes are cut into blocks of about ``block_rows``.
In a block a vector v is held as the signs of its rotated residual r = v - c, packed to bits, with correction scalars: the length
of r, r.c, and how well the signs point along r.

Search: a query probes the centroids of largest inner product, as many as the sample needs for a recall of ``sample_recall`` against
brute force (all of them where the vectors don't cluster). In each block, look-up tables over the bytes of the codes
estimate all inner products; an error bound of ``sigmas`` deviations around each keeps the vectors whose upper end reaches
the ``top``-th best lower end, and only those are reranked on the original vectors, in double precision. Block tops meet in one top-k
per query class. Queries and vectors are matched in blocks of bounded size; a centroid that holds a third of all vectors or of all
queries is many block pairs.

Defined cases: vectors that are null, all zero, or hold null or non-finite components take no part, nor do vectors of another
length than the commonest (ties: the longer). Ties in score go to the smaller id. Rows that share an id are separate vectors under
one id, and a query never finds its own id. Null ids take no part. Fewer candidates than ``top`` give fewer rows; an
empty table gives none; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallylake.llm.common import cut


QUERIES_AT_ONCE = 64  # bounds the estimates held at a time


@dataclass
class Settings:
    top: int = 20
    sample: int = 20000
    most_centroids: int = 1024
    centroid_rows: int = 8192
    sample_queries: int = 400
    sample_recall: float = 0.98
    block_rows: int = 16384
    block_queries: int = 1024
    sigmas: float = 2.5
    seed: int = 11


def rotation(size: int, seed: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(size, size)))
    return q * np.sign(np.diag(r))


def fit_centroids(vectors: np.ndarray, n: int, seed: int, rounds: int = 12) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centres = vectors[rng.choice(len(vectors), n, replace=False)].copy()
    for _ in range(rounds):
        owner = nearest_centroid(vectors, centres)
        size = np.bincount(owner, minlength=n)
        order = np.argsort(owner, kind="stable")
        starts = np.concatenate([[0], np.cumsum(size)[:-1]])
        live = size > 0
        sums = np.add.reduceat(vectors[order], starts[live], axis=0)
        centres[live] = sums / size[live, None]
    return centres


def nearest_centroid(vectors: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres**2).sum(1)[None, :] - 2 * vectors @ centres.T).argmin(axis=1)


class CodedBlock:
    """Vectors of one block as packed sign bits and correction scalars about their centroid."""

    def __init__(self, vectors: np.ndarray, centre: np.ndarray, turn: np.ndarray) -> None:
        self.vectors, self.centre, self.turn = vectors, centre, turn
        residual = vectors - centre
        self.length = np.linalg.norm(residual, axis=1)
        turned = residual @ turn.T
        self.codes = np.packbits(turned > 0, axis=1)
        safe = np.where(self.length > 0, self.length, 1.0)
        # inner product of the unit residual with the unit vector its signs stand for
        self.fit = np.where(self.length > 0, np.abs(turned).sum(axis=1) / (safe * np.sqrt(vectors.shape[1])), 1.0)
        self.shift = residual @ centre

    def estimate(self, queries: np.ndarray, sigmas: float) -> tuple[np.ndarray, np.ndarray]:
        """Estimates of all inner products and the half widths of their error bounds, queries x vectors."""
        size = self.vectors.shape[1]
        offset = queries - self.centre
        turned = np.zeros((len(queries), 8 * self.codes.shape[1]))
        turned[:, :size] = offset @ self.turn.T
        signs = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1) * 2.0 - 1.0
        total = np.zeros((len(queries), len(self.vectors)), dtype=np.float32)
        for j in range(self.codes.shape[1]):
            tables = (turned[:, 8 * j:8 * j + 8] @ signs.T).astype(np.float32)
            total += tables[:, self.codes[:, j]]
        along = total / (np.sqrt(size) * self.fit)
        estimate = (queries @ self.centre)[:, None] + self.shift + self.length * along
        loss = np.sqrt(np.maximum(1 - self.fit**2, 0)) / self.fit
        width = sigmas * np.linalg.norm(offset, axis=1)[:, None] * (self.length * loss / np.sqrt(max(size - 1, 1)))
        return estimate, width + 1e-6 * (1 + np.abs(estimate))

    def search(self, queries: np.ndarray, top: int, sigmas: float) -> list[tuple[np.ndarray, np.ndarray]]:
        """Per query: the vectors that may be among the best ``top``, and their exact inner products."""
        found = []
        for at in range(0, len(queries), QUERIES_AT_ONCE):
            part = queries[at:at + QUERIES_AT_ONCE]
            for query, middle, half in zip(part, *self.estimate(part, sigmas), strict=True):
                low = middle - half
                bar = np.partition(low, len(low) - top)[len(low) - top] if len(low) > top else -np.inf
                picked = np.flatnonzero(middle + half >= bar)
                products = self.vectors[picked] @ query
                if len(picked) > top:  # all that can be among the best, ties included
                    picked = picked[products >= np.partition(products, len(picked) - top)[len(picked) - top] - 1e-9 * np.linalg.norm(query)]
                found.append((picked, (self.vectors[picked] * query).sum(axis=1)))
        return found


def sound_vectors(embeddings: DataFrame) -> DataFrame:
    """(vec_id, vec, k1, k2) of the vectors that take part; k1 and k2 are equal where the vectors are."""
    sound = ~F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("vec", lambda x: x != 0)
    rows = embeddings.where("vec_id is not null and embedding is not null").select(
        F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda x: F.when(x == 0, F.abs(x)).otherwise(x)).alias("vec"))
    rows = rows.where(sound)
    size = rows.groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).select("n").head(1)
    rows = rows.where(F.size("vec") == (size[0][0] if size else 0))
    return rows.withColumn("k1", F.xxhash64("vec")).withColumn("k2", F.xxhash64(F.lit(1), F.col("vec")))


def search(embeddings: DataFrame, settings: Settings | None = None, query_every: int = 20) -> DataFrame:
    """(query_id, rank, vec_id, score) for every row whose ``vec_id`` is divisible by ``query_every``."""
    s = settings or Settings()
    rows = sound_vectors(embeddings)
    smallest = F.row_number().over(Window.partitionBy("k1", "k2").orderBy("vec_id"))
    classes = (
        rows.withColumn("_n", smallest).where(F.col("_n") <= s.top + 1)
        .groupBy("k1", "k2").agg(F.first("vec").alias("vec"), F.sort_array(F.collect_list("vec_id")).alias("ids"))
    )
    classes = cut(classes)
    asked = rows.where(F.col("vec_id") % query_every == 0).select("vec_id", "k1", "k2").distinct()
    centres, n_probes = _centroids(classes, s)
    if not n_probes:
        return rows.select(F.col("vec_id").alias("query_id"), F.lit(1).alias("rank"), "vec_id", F.lit(0.0).alias("score")).limit(0)
    placed = cut(_assign(classes, centres))
    wanted = placed.join(asked.select("k1", "k2").distinct(), ["k1", "k2"], "left_semi").select("k1", "k2", "vec")
    probes = cut(_probe(wanted, centres, n_probes))
    found = _match(placed, probes, centres, s)
    best = F.row_number().over(Window.partitionBy("q1", "q2").orderBy(F.desc("score"), F.col("ids")[0]))
    near = (
        found.withColumn("_n", best).where(F.col("_n") <= s.top + 1)
        .select("q1", "q2", F.explode("ids").alias("vec_id"), "score")
        .groupBy("q1", "q2").agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("far"), "vec_id"))).alias("near"))
    )
    own = asked.join(near, (F.col("k1") == F.col("q1")) & (F.col("k2") == F.col("q2"))).select(
        F.col("vec_id").alias("query_id"),
        F.posexplode(F.slice(F.filter("near", lambda x: x["vec_id"] != F.col("vec_id")), 1, s.top)).alias("_at", "_near"))
    return own.select(
        "query_id", (F.col("_at") + 1).cast("int").alias("rank"), F.col("_near.vec_id").alias("vec_id"), (-F.col("_near.far")).alias("score"))


def _centroids(classes: DataFrame, s: Settings) -> tuple[np.ndarray, int]:
    """Centroids, and how many a query has to probe."""
    n = classes.count()
    drawn = classes.orderBy("k1", "k2").limit(s.sample).select("vec").toPandas()["vec"]
    if not len(drawn):
        return np.zeros((0, 0)), 0
    vectors = stacked(drawn)
    centres = fit_centroids(vectors, min(len(vectors), s.most_centroids, -(-n // s.centroid_rows)), s.seed)
    return centres, probes_needed(vectors, centres, s)


def probes_needed(vectors: np.ndarray, centres: np.ndarray, s: Settings) -> int:
    """The least number of probes that finds ``sample_recall`` of the sample's own nearest vectors."""
    queries = vectors[:s.sample_queries]
    top = min(s.top, len(vectors) - 1)
    if top < 1:
        return len(centres)
    dots = queries @ vectors.T
    np.fill_diagonal(dots, -np.inf)
    near = np.argpartition(-dots, top - 1, axis=1)[:, :top]
    place = np.argsort(np.argsort(-(queries @ centres.T), axis=1), axis=1)
    found = np.take_along_axis(place, nearest_centroid(vectors, centres)[near], axis=1)
    share = np.cumsum(np.bincount(found.ravel(), minlength=len(centres))) / found.size
    return int(np.searchsorted(share, s.sample_recall)) + 1


def stacked(vectors: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, dtype=np.float64) for v in vectors])


def kind(rows: DataFrame) -> str:
    return rows.schema["vec"].dataType.simpleString()


def _assign(classes: DataFrame, centres: np.ndarray) -> DataFrame:
    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                yield batch.assign(centre=nearest_centroid(stacked(batch["vec"]), centres))

    return classes.mapInPandas(assign, f"k1 long, k2 long, vec {kind(classes)}, ids array<long>, centre int")


def _probe(wanted: DataFrame, centres: np.ndarray, probes: int) -> DataFrame:
    def probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                dots = stacked(batch["vec"]) @ centres.T
                yield batch.assign(centre=list(np.argpartition(-dots, probes - 1, axis=1)[:, :probes].astype(np.int32)))

    return wanted.mapInPandas(probe, f"k1 long, k2 long, vec {kind(wanted)}, centre array<int>").select(
        "k1", "k2", "vec", F.explode("centre").alias("centre"))


def _match(placed: DataFrame, probes: DataFrame, centres: np.ndarray, s: Settings) -> DataFrame:
    """(q1, q2, score, ids): per block pair the best of each query."""
    blocks = placed.groupBy("centre").agg(F.ceil(F.count("*") / s.block_rows).cast("int").alias("parts"))
    query_blocks = probes.groupBy("centre").agg(F.ceil(F.count("*") / s.block_queries).cast("int").alias("query_parts"))
    sizes = F.broadcast(blocks.join(query_blocks, "centre"))  # a row per centroid, so at most ``most_centroids``
    vectors = placed.join(sizes, "centre").select(
        "centre", F.pmod("k1", "parts").cast("int").alias("part"),
        F.explode(F.sequence(F.lit(0), F.col("query_parts") - 1)).alias("query_part"), "vec", "ids")
    queries = probes.join(sizes, "centre").select(
        "centre", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"),
        F.pmod("k1", "query_parts").cast("int").alias("query_part"), "k1", "k2", "vec")
    top, sigmas, seed = s.top, s.sigmas, s.seed
    best = top + 1

    def match(key: tuple, ours: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out: dict[str, list] = {"q1": [], "q2": [], "score": [], "ids": []}
        if len(ours) and len(asked):
            block = CodedBlock(stacked(ours["vec"]), centres[key[0]], rotation(centres.shape[1], seed))
            ids = list(ours["ids"])
            for (k1, k2), (picked, scores) in zip(
                zip(asked["k1"], asked["k2"], strict=True), block.search(stacked(asked["vec"]), best, sigmas), strict=True):
                first = np.array([ids[i][0] for i in picked])
                for i in np.lexsort((first, -scores))[:best]:
                    out["q1"].append(k1)
                    out["q2"].append(k2)
                    out["score"].append(float(scores[i]))
                    out["ids"].append(ids[picked[i]])
        return pd.DataFrame(out)

    keys = ["centre", "part", "query_part"]
    return vectors.groupBy(*keys).cogroup(queries.groupBy(*keys)).applyInPandas(match, "q1 long, q2 long, score double, ids array<long>")
