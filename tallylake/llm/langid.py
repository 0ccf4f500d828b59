"""Language identification with a byte convolutional network.

Network: filters of several widths slide over the bytes of a fixed-length window; each filter's maximum over the window, after a
rectifier, feeds one softmax layer over the languages. A filter of width w is a table of w x 256 weights, so it takes the bytes as they
are. It is trained with Adam in numpy, on the driver, from a sample of about ``per_language`` documents of each language, drawn by
a hash, two windows each. Every language of the training folds is learned, however few its documents; all of them where it has
no more than ``per_language``. So the driver's memory and the steps grow with the number of languages, not of documents.

Use: a document's whole text is cut into windows of ``WINDOW`` bytes, the last padded with zeros; the windows' probabilities are
averaged by their lengths. Filters are applied through tables over byte pairs, so a filter of width 4 costs two look-ups.

Defined cases: a null text, or one without letters, gets ``und`` and score 0; with nothing to learn from, every document does;
a null doc_id counts as the text '' when folds are dealt; ties between languages go to the first by name; rows repeated in full
give repeated results; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WIDTHS, FILTERS, WINDOW = (2, 3, 4), 16, 128
AT_ONCE = 512  # windows
FOLDS = 5
LEAST_STEPS, STEPS_PER_LANGUAGE = 1200, 20
UNKNOWN = "und"


def is_held_out(doc_id: str = "doc_id") -> Column:
    text = F.coalesce(F.col(doc_id).cast("string"), F.lit(""))
    return F.crc32(text.cast("binary")) % FOLDS == 0


@dataclass
class ByteCnn:
    languages: list[str]
    filters: dict[int, np.ndarray]  # width -> (width, 256, FILTERS)
    biases: np.ndarray
    weights: np.ndarray
    offsets: np.ndarray

    @classmethod
    def fit(cls, windows: np.ndarray, labels: np.ndarray, languages: list[str], steps: int = 1200, batch: int = 64, seed: int = 7) -> ByteCnn:
        rng = np.random.default_rng(seed)
        width = len(WIDTHS) * FILTERS
        net = cls(
            languages, {w: rng.normal(0, 0.15, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS}, np.zeros(width, np.float32),
            rng.normal(0, 0.2, (width, len(languages))).astype(np.float32), np.zeros(len(languages), np.float32))
        for w in WIDTHS:
            net.filters[w][:, 0] = 0
        share = np.bincount(labels, minlength=len(languages)).astype(float)
        chance = (1 / share[labels]) / (1 / share[labels]).sum()
        params = [*net.filters.values(), net.biases, net.weights, net.offsets]
        first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        for step in range(1, steps + 1):
            pick = rng.choice(len(labels), batch, p=chance)
            rate = 0.01 * (1 - step / (steps + 1)) + 1e-4
            for p, m, v, g in zip(params, first, second, net._gradients(windows[pick], labels[pick]), strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        return net

    def _gradients(self, x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        n, length = x.shape
        tops, places = [], []
        for w in WIDTHS:
            table = self.filters[w]
            out = sum(table[j][x[:, j:length - w + 1 + j]] for j in range(w))
            place = out.argmax(axis=1)
            places.append(place)
            tops.append(np.take_along_axis(out, place[:, None], 1)[:, 0])
        pooled = np.concatenate(tops, 1) + self.biases
        active = np.maximum(pooled, 0)
        p = _softmax(active @ self.weights + self.offsets)
        p[np.arange(n), y] -= 1
        p /= n
        back = (p @ self.weights.T) * (pooled > 0)
        grads = []
        for k, w in enumerate(WIDTHS):
            part, g = back[:, k * FILTERS:(k + 1) * FILTERS], np.zeros_like(self.filters[w])
            for j in range(w):
                np.add.at(g[j], (np.take_along_axis(x, places[k] + j, 1), np.arange(FILTERS)[None, :]), part)
            g[:, 0] = 0
            grads.append(g)
        return [*grads, back.sum(0), active.T @ p, p.sum(0)]

    def pair_tables(self) -> dict[int, tuple[np.ndarray, np.ndarray | None]]:
        """width -> (table over the first two bytes, table over what is left: None, one byte, or two)."""
        pairs = lambda a, b: (a[:, None, :] + b[None, :, :]).reshape(65536, FILTERS)
        t = self.filters
        return {2: (pairs(*t[2]), None), 3: (pairs(t[3][0], t[3][1]), t[3][2]), 4: (pairs(t[4][0], t[4][1]), pairs(t[4][2], t[4][3]))}

    def probabilities(self, windows: np.ndarray, tables: dict) -> np.ndarray:
        x = windows.astype(np.int32)
        two = x[:, :-1] * 256 + x[:, 1:]
        tops = []
        for w in WIDTHS:
            front, rest = tables[w]
            out = np.take(front, two[:, :WINDOW - w + 1], axis=0)
            if rest is not None:
                out += np.take(rest, x[:, 2:] if w == 3 else two[:, 2:], axis=0)
            tops.append(out.max(axis=1))
        return _softmax(np.maximum(np.concatenate(tops, 1) + self.biases, 0) @ self.weights + self.offsets)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def as_windows(data: bytes) -> np.ndarray:
    """All bytes in rows of ``WINDOW``, zeros at the end."""
    n = -(-len(data) // WINDOW)
    out = np.zeros(n * WINDOW, dtype=np.uint8)
    out[:len(data)] = np.frombuffer(data, dtype=np.uint8)
    return out.reshape(n, WINDOW)


def training_windows(docs: DataFrame, per_language: int = 1000) -> DataFrame:
    """(lang, piece): two stretches of each sampled document of the training folds; of every language the ``per_language`` documents whose
    hash of id and text is smallest, or all if there are fewer."""
    labelled = docs.select("doc_id", "lang", "text").where(~is_held_out() & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    room = F.greatest(F.length("text") - WINDOW, F.lit(1))
    stretch = lambda salt: F.substring(F.col("text"), (F.pmod(F.xxhash64(F.lit(salt), F.col("doc_id")), room) + 1).cast("int"), F.lit(WINDOW))
    slim = labelled.select("lang", F.xxhash64(F.lit("langid"), "doc_id", "text").alias("_draw"), F.array(stretch(1), stretch(2)).alias("_pieces"))
    # every task keeps its first rows of a language before any row is shuffled
    place = F.row_number().over(Window.partitionBy("lang").orderBy("_draw", "_pieces"))
    return slim.withColumn("_place", place).where(F.col("_place") <= per_language).select("lang", F.explode("_pieces").alias("piece"))


def train(docs: DataFrame, **sample: int) -> ByteCnn | None:
    rows = training_windows(docs, **sample).orderBy("lang", "piece").collect()
    windows = [(row["lang"], as_windows(row["piece"].encode())[0]) for row in rows if row["piece"]]
    if not windows:
        return None
    languages = sorted({lang for lang, _ in windows})
    number = {lang: i for i, lang in enumerate(languages)}
    steps = max(LEAST_STEPS, STEPS_PER_LANGUAGE * len(languages))
    return ByteCnn.fit(np.stack([w for _, w in windows]), np.array([number[lang] for lang, _ in windows]), languages, steps)


def predict(docs: DataFrame, net: ByteCnn | None) -> DataFrame:
    """All columns of ``docs`` except ones named like the results, plus ``lang_pred`` and ``score``."""
    kept = [c for c in docs.columns if c not in ("lang_pred", "score")]
    guess = _guesser(net)
    return docs.select(*kept, guess(F.col("text")).alias("_guess")).select(
        *kept, F.col("_guess.lang_pred").alias("lang_pred"), F.col("_guess.score").alias("score"))


def _guesser(net: ByteCnn | None):
    @F.pandas_udf("lang_pred string, score double")
    def guess(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        import regex

        letter = regex.compile(r"\p{L}")
        tables = net.pair_tables() if net else None
        for texts in batches:
            names, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
            group: list[tuple[int, np.ndarray, int]] = []
            held = 0
            for i, text in enumerate(texts):
                if net is None or text is None or not letter.search(text):
                    continue
                data = text.encode()
                group.append((i, as_windows(data), len(data)))
                held += len(group[-1][1])
                if held >= AT_ONCE:
                    _settle(net, tables, group, names, scores)
                    group, held = [], 0
            _settle(net, tables, group, names, scores)
            yield pd.DataFrame({"lang_pred": names, "score": scores})

    return guess


def _settle(net: ByteCnn, tables: dict, group: list[tuple[int, np.ndarray, int]], names: list[str], scores: np.ndarray) -> None:
    """Sets the results of the texts of one group of windows."""
    if not group:
        return
    windows = np.concatenate([w for _, w, _ in group])
    p = np.concatenate([net.probabilities(windows[at:at + AT_ONCE], tables) for at in range(0, len(windows), AT_ONCE)])
    start = 0
    for i, own, size in group:
        weight = np.full(len(own), float(WINDOW))
        weight[-1] = size - (len(own) - 1) * WINDOW
        mean = np.average(p[start:start + len(own)], axis=0, weights=weight)
        start += len(own)
        names[i] = net.languages[int(mean.argmax())]
        scores[i] = min(1.0, float(mean.max()))


def identify(docs: DataFrame, **sample: int) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every document, learned from the training folds only."""
    net = train(docs, **sample)
    return predict(docs.select("doc_id", "text"), net).select("doc_id", is_held_out().alias("held_out"), "lang_pred", "score")
