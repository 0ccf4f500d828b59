"""Quality classifier: cumulative-link regression on graded ratings over hashed text.

Grades from the labels: 0 low quality, 1 of good quality but toxic, 2 good. One weight vector w over hashed text features is shared
by all grades; ordered thresholds t1 < t2 split its score: P(grade >= j) = sigmoid(w.x - tj). From it come the expected grade
(the sum of the tails) and the tail P(grade >= 2), by which documents are selected.

Features are presences: each distinct word in lower case without marks around it, and a few shapes of the whole text (repeated words,
capitals, symbols, variety) in tenths. The fit is FTRL with an L1 penalty in numpy on the driver, on at most ``sample_documents`` labelled
documents of about equal numbers per grade, drawn by a hash; only hashed features reach the driver. What is minimised is the model's
negative log-likelihood, -log(P(>= j) - P(>= j + 1)) of the true grade j; the thresholds are kept apart as t1 and positive gaps.

Defined cases: a null or blank text has grade 0 and is rejected; without labelled documents nothing is known and every other document
is kept with the tail 1; null labels are no labels; several labels of one document count as the worst; rows repeated in full give
repeated results, and texts that share an id count as one, the one with the smallest hash, in the sample; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BITS = 18
GRADES = 3
MARKS = ".,;:!?\"'()[]"
SYMBOLS = "!#%*$&@|{}<>=+~^_\\/"


def features(text: str) -> np.ndarray:
    """Hashed features of a text that isn't blank."""
    words = text.split()
    n = len(words)
    distinct = set(words)
    shapes = (
        ("repeats", sum(map(eq, words, words[1:])) / n),
        ("capitals", sum(map(str.isupper, words)) / n),
        ("symbols", min(1.0, sum(map(text.count, SYMBOLS)) / n)),
        ("variety", len(distinct) / n if n >= 20 else 1.0),
    )
    names = {word.lower().strip(MARKS) for word in distinct}
    names.update(f"\n{name} {int(10 * share)}" for name, share in shapes)
    mask = (1 << BITS) - 1
    return np.unique(np.fromiter((zlib.crc32(name.encode()) & mask for name in names), dtype=np.int32, count=len(names)))


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def features_of(texts: pd.Series) -> pd.Series:
    return texts.map(lambda text: features(text) if text and not text.isspace() else None)


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def gradient(score: float, grade: int, thresholds: np.ndarray) -> tuple[float, float, np.ndarray]:
    """Negative log-likelihood of a grade, and its slopes by the score and by each threshold."""
    tails = np.concatenate([[1.0], _sigmoid(score - thresholds), [0.0]])
    above, beyond = tails[grade], tails[grade + 1]
    share = max(above - beyond, 1e-12)
    by_threshold = np.zeros(len(thresholds) + 2)
    by_threshold[grade] = above * (1 - above) / share
    by_threshold[grade + 1] = -beyond * (1 - beyond) / share
    return -np.log(share), above + beyond - 1, by_threshold[1:-1]


@dataclass
class CumulativeLink:
    weights: np.ndarray
    thresholds: np.ndarray  # rising

    def tails(self, scores: np.ndarray) -> np.ndarray:
        """P(grade >= j) for j = 1, 2, .. in columns."""
        return _sigmoid(scores[:, None] - self.thresholds[None, :])

    @classmethod
    def fit(cls, rows: list[np.ndarray], grades: np.ndarray, epochs: int = 6, rate: float = 0.5, l1: float = 4.0, seed: int = 3) -> CumulativeLink:
        rng = np.random.default_rng(seed)
        z, n, w = np.zeros(1 << BITS), np.zeros(1 << BITS), np.zeros(1 << BITS)
        # the first threshold and the logarithms of the gaps between them, so that they stay in order
        place, place_n = np.concatenate([[-1.0], np.log(np.full(GRADES - 2, 2.0 / max(1, GRADES - 2)))]), np.full(GRADES - 1, 1.0)
        for _ in range(epochs):
            for i in rng.permutation(len(rows)):
                x, grade = rows[i], grades[i]
                zx, nx = z[x], n[x]
                wx = np.where(np.abs(zx) <= l1, 0.0, -(zx - np.sign(zx) * l1) / ((1.0 + np.sqrt(nx)) / rate))
                gaps = np.exp(place[1:])
                _, g, by_threshold = gradient(wx.sum(), grade, place[0] + np.concatenate([[0.0], np.cumsum(gaps)]))
                sigma = (np.sqrt(nx + g * g) - np.sqrt(nx)) / rate
                z[x] = zx + g - sigma * wx
                n[x] = nx + g * g
                beyond = np.cumsum(by_threshold[::-1])[::-1]  # a place moves its threshold and all after it
                slope = np.concatenate([beyond[:1], beyond[1:] * gaps])
                place_n += slope * slope
                place = place - 0.3 * slope / np.sqrt(place_n)
        live = np.abs(z) > l1
        w[live] = -(z[live] - np.sign(z[live]) * l1) / ((1.0 + np.sqrt(n[live])) / rate)
        return cls(w, place[0] + np.concatenate([[0.0], np.cumsum(np.exp(place[1:]))]))


def grade_of(quality: Column, toxic: Column) -> Column:
    return F.when(quality < 1, 0).when(toxic >= 1, 1).otherwise(2)


def sample_of(docs: DataFrame, labels: DataFrame, sample_documents: int) -> DataFrame:
    """(grade, text) of at most about ``sample_documents`` labelled documents."""
    graded = labels.where("doc_id is not null and quality is not null and toxic is not null").groupBy("doc_id").agg(
        F.min(grade_of(F.col("quality"), F.col("toxic"))).alias("grade"))
    sizes = {row["grade"]: row["n"] for row in graded.groupBy("grade").agg(F.count("*").alias("n")).collect()}
    rate = F.coalesce(*[F.when(F.col("grade") == g, F.lit(min(1.0, sample_documents / GRADES / n))) for g, n in sizes.items()], F.lit(0.0))
    draw = F.pmod(F.xxhash64(F.lit("quality"), F.col("doc_id")), F.lit(1 << 20)) / float(1 << 20)
    drawn = graded.where(draw < rate)
    rows = docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id")  # bounded by the sample's size
    one = F.min(F.struct(F.xxhash64("text").alias("hash"), "grade", "text")).alias("row")  # of texts that share an id
    return rows.groupBy("doc_id").agg(one).select("doc_id", "row.grade", "row.text")


def train(docs: DataFrame, labels: DataFrame, sample_documents: int = 18000) -> CumulativeLink | None:
    rows = sample_of(docs, labels, sample_documents).select("doc_id", "grade", features_of("text").alias("features")).where(
        "features is not null").toPandas().sort_values("doc_id", kind="stable")
    if rows.empty:
        return None
    return CumulativeLink.fit([np.asarray(x, dtype=np.int64) for x in rows["features"]], rows["grade"].to_numpy())


def score(docs: DataFrame, model: CumulativeLink | None, least_tail: float = 0.5) -> DataFrame:
    """All columns of ``docs`` plus ``expected_grade``, ``tail`` = P(grade >= 2) and ``keep`` (columns so named are replaced)."""
    kept = [c for c in docs.columns if c not in ("expected_grade", "tail", "keep")]

    @F.pandas_udf("expected_grade double, tail double")
    def grade(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            blank = np.array([not text or text.isspace() for text in texts], dtype=bool)
            if model is None:
                tails = np.ones((len(texts), GRADES - 1))
            else:
                tails = model.tails(np.array(
                    [0.0 if empty else model.weights[features(text)].sum() for text, empty in zip(texts, blank, strict=True)]))
            tails[blank] = 0.0
            yield pd.DataFrame({"expected_grade": tails.sum(axis=1), "tail": tails[:, -1]})

    return docs.select(*kept, grade(F.col("text")).alias("_grade")).select(
        *kept, F.col("_grade.expected_grade").alias("expected_grade"), F.col("_grade.tail").alias("tail"),
        (F.col("_grade.tail") >= least_tail).alias("keep"))


def classify(docs: DataFrame, labels: DataFrame, sample_documents: int = 18000, least_tail: float = 0.5) -> DataFrame:
    """(doc_id, expected_grade, tail, keep) of every document."""
    model = train(docs, labels, sample_documents)
    return score(docs.select("doc_id", "text"), model, least_tail).select("doc_id", "expected_grade", "tail", "keep")
