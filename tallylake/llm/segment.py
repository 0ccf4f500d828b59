"""SentencePiece encoding and decoding by sampling without replacement: Gumbel top-k over the segmentation lattice.

A text's segmentations are the leaves of a tree whose edges are pieces. The root gets a Gumbel number and every node passes its own
down to the child that attains it. All other leaves below the start of a walk down are one open set, whose number is a Gumbel of
the set's mass, truncated at the walk's. Best-first search (A*) takes the open set of the largest number, draws the edge by which
it leaves its path and walks on from there, so it meets leaves in falling order and the first ``k`` are a sample of distinct
segmentations without replacement. The bound of an open set is exact, so each sample costs one walk.

The score of inclusion of a segmentation of log-probability p is 1 - exp(-exp(p - t)), t the (k+1)-th number. Numbers are hashed from
(seed, row key, sample, place in the text), so results don't depend on batches or partitions. Sets of mass below exp(-80) of the
whole can't reach the top at double precision and are not opened.

Whole texts are segmented, in batches of bounded size, each distinct chunk's lattice once per batch. Characters outside the
vocabulary are spelled as bytes, so decoding gives back every text exactly.

Defined cases: a null or empty text has one segmentation, without pieces (log-probability 0, inclusion 1); a text with fewer
segmentations than ``k`` gives them all, with inclusion 1; a null key counts as 0; rows repeated in full give repeated results;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import heapq
import itertools
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallylake.llm.lattice import Lattices, Vocabulary, vocabulary

CHARS_AT_ONCE = 5_000_000
LEAST_MASS = -80.0


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit mixer (xor-shift and multiply)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _uniform(x: np.ndarray) -> np.ndarray:
    return ((_mix(x) >> np.uint64(11)).astype(np.float64) + 0.5) / float(1 << 53)


def _truncated(mass: np.ndarray | float, limit: float, u: np.ndarray | float):
    """Gumbel numbers of the given log-masses, each at most ``limit``; an empty set has minus infinity."""
    with np.errstate(divide="ignore"):
        return -np.logaddexp(-limit, np.log(-np.log(u)) - mass)


class Path:
    """A segmentation: edges (nodes, slots), the chunk of the text each lies in, and running log-probabilities."""

    def __init__(self, nodes: np.ndarray, slots: np.ndarray, chunk: np.ndarray, logq: np.ndarray, number: float) -> None:
        self.nodes, self.slots, self.chunk, self.number = nodes, slots, chunk, number
        self.after = np.cumsum(logq)

    def before(self, step: int) -> float:
        return float(self.after[step - 1]) if step else 0.0


class Row:
    """The search of one text."""

    def __init__(self, key: int, roots: np.ndarray, seed: int) -> None:
        self.roots = roots
        base = np.uint64((key ^ (seed * 0x9E3779B97F4A7C15)) & 0xFFFFFFFFFFFFFFFF)
        self.base = _mix(np.array([base], dtype=np.uint64))[0]
        self.open: list[tuple[float, int, int, tuple[tuple[int, int], ...]]] = []
        self.paths: list[Path] = []
        self.drawn = 0

    def numbers(self, n: int) -> np.ndarray:
        """The next ``n`` uniform numbers of this text."""
        counters = np.arange(self.drawn + 1, self.drawn + n + 1, dtype=np.uint64)
        self.drawn += n
        return _uniform(self.base ^ np.uint64(0xA5 << 56) ^ counters)

    def number(self) -> float:
        return float(self.numbers(1)[0])

    def push(self, log_mass: float, limit: float, path: int, first: int, without: tuple[tuple[int, int], ...]) -> None:
        number = float(_truncated(log_mass, limit, self.number()))
        if number > -np.inf:
            heapq.heappush(self.open, (-number, path, first, without))

    def add(self, path: Path, lattices: Lattices, first: int) -> None:
        """Takes a new leaf and opens the set of all other leaves below its step ``first``."""
        self.paths.append(path)
        if first >= len(path.nodes):
            return
        whole = path.before(first)
        leaf = float(path.after[-1]) - whole
        if leaf < -1e-3:
            log_mass = whole + np.log(-np.expm1(leaf))
        else:  # nearly all of the mass is the leaf's, so what is left is added up
            with np.errstate(divide="ignore"):
                log_mass = whole + np.log(self._beside(path, lattices, first, ())[0].sum())
        self.push(log_mass, path.number, len(self.paths) - 1, first, ())

    @staticmethod
    def _beside(path: Path, lattices: Lattices, first: int, without: tuple[tuple[int, int], ...]) -> tuple[np.ndarray, np.ndarray]:
        """Mass of the edges that leave the path at each step from ``first`` on, in terms of the mass there: (steps, steps x slots)."""
        whole = path.before(first)
        last = int(np.searchsorted(-path.after, -LEAST_MASS - whole)) + 1
        nodes, slots = path.nodes[first:last], path.slots[first:last]
        share = np.exp(lattices.logq[nodes])
        share[np.arange(len(nodes)), slots] = 0.0
        for step, slot in without:
            if first <= step < last:
                share[step - first, slot] = 0.0
        before = np.concatenate([[whole], path.after[first:last - 1]])[:len(nodes)]
        return np.exp(before - whole) * share.sum(axis=1, dtype=np.float64), share

    def branch(self, lattices: Lattices) -> tuple[Path, int, int, float]:
        """The best open set resolved into (path it leaves, step, slot it takes, its number); the rest of the set stays open."""
        number, which, first, without = heapq.heappop(self.open)
        path = self.paths[which]
        mass, share = self._beside(path, lattices, first, without)
        run = np.cumsum(mass)
        at = min(int(np.searchsorted(run, self.number() * run[-1], side="right")), int(np.flatnonzero(mass)[-1]))
        slots = np.cumsum(share[at], dtype=np.float64)
        slot = min(int(np.searchsorted(slots, self.number() * slots[-1], side="right")), int(np.flatnonzero(share[at])[-1]))
        taken = (*without, (first + at, slot))
        left = run[-1] - mass[at] * share[at][slot] / slots[-1]
        if left < 1e-3 * run[-1]:  # a small difference of large sums
            left = self._beside(path, lattices, first, taken)[0].sum()
        if left > 0:
            self.push(path.before(first) + np.log(left), -number, which, first, taken)
        return path, first + at, slot, -number


class Segmenter:
    def __init__(self, vocabulary: Vocabulary, k: int, seed: int) -> None:
        self.vocabulary, self.k, self.seed = vocabulary, k, seed

    def __call__(self, keys: list[int], texts: list[str]) -> list[list[tuple[np.ndarray, float, float, float]]]:
        """Per text the samples (ids, log-probability, number, inclusion), best number first."""
        split = [self.vocabulary.chunks(text) for text in texts]
        number = defaultdict(itertools.count().__next__)  # in order of appearance
        places = [np.fromiter(map(number.__getitem__, chunks), dtype=np.int64, count=len(chunks)) for chunks in split]
        lattices = Lattices(self.vocabulary, list(number))
        rows = [Row(key, lattices.root[place] if len(place) else place, self.seed) for key, place in zip(keys, places, strict=True)]
        begun = [(row, None, 0, 0, -np.log(-np.log(row.number()))) for row in rows]
        self._extend(lattices, begun, 0)
        for sample in range(1, self.k):
            self._extend(lattices, [(row, *row.branch(lattices)) for row in rows if row.open], sample)
        return [self._result(lattices, row) for row in rows]

    def _extend(self, lattices: Lattices, branches: list[tuple[Row, Path | None, int, int, float]], sample: int) -> None:
        """Walks every branch to the end of its text, all texts in one go."""
        starts, chunks, bases = [], [], []
        for row, path, step, slot, _ in branches:
            if path is None:
                start, chunk = row.roots, np.arange(len(row.roots))
            else:
                own = int(path.chunk[step])
                start = np.concatenate([[path.nodes[step] + slot + 1], row.roots[own + 1:]])
                chunk = np.arange(own, len(row.roots))
            starts.append(start)
            chunks.append(chunk)
            bases.append(row.base)
        if not starts:
            return
        sizes = np.array([len(s) for s in starts])
        start, chunk = np.concatenate(starts).astype(np.int64), np.concatenate(chunks)
        root = np.concatenate([row.roots[c] for (row, *_), c in zip(branches, chunks, strict=True)]).astype(np.int64)
        base = np.repeat(np.array(bases, dtype=np.uint64), sizes) ^ ((chunk.astype(np.uint64) << np.uint64(24)) | np.uint64(sample << 56))
        base = _mix(base)
        nodes, slots, count = lattices.walk(start, lambda who, at: _uniform(base[who] ^ (at - root[who]).astype(np.uint64)))
        logq = lattices.logq[nodes, slots].astype(np.float64)
        of_chunk = np.repeat(chunk, count)
        edges = np.concatenate([[0], np.cumsum(count)])
        bounds = edges[np.concatenate([[0], np.cumsum(sizes)])].tolist()
        for (row, path, step, slot, number), a, b in zip(branches, bounds[:-1], bounds[1:], strict=True):
            if path is None:
                row.add(Path(nodes[a:b], slots[a:b], of_chunk[a:b], logq[a:b], number), lattices, 0)
            else:
                at = path.nodes[:step + 1]
                took = np.append(path.slots[:step], slot)
                row.add(Path(
                    np.concatenate([at, nodes[a:b]]), np.concatenate([took, slots[a:b]]),
                    np.concatenate([path.chunk[:step + 1], of_chunk[a:b]]),
                    np.concatenate([lattices.logq[at, took].astype(np.float64), logq[a:b]]), number), lattices, step + 1)

    def _result(self, lattices: Lattices, row: Row) -> list[tuple[np.ndarray, float, float, float]]:
        limit = -row.open[0][0] if row.open else -np.inf
        out = []
        for path in row.paths:
            logp = float(path.after[-1]) if len(path.after) else 0.0
            inclusion = 1.0 if limit == -np.inf else float(-np.expm1(-np.exp(min(logp - limit, 700.0))))
            out.append((self.vocabulary.spelled(lattices.ids[path.nodes, path.slots]), logp, path.number, inclusion))
        return out


SAMPLES = "doc_id long, sample int, ids array<int>, log_prob double, perturbed double, inclusion double"
DIGESTS = "doc_id long, sample int, n_pieces long, ids_crc32 long, log_prob double, perturbed double, inclusion double, decoded_same boolean"


def _batches(frames: Iterator[pd.DataFrame]) -> Iterator[tuple[list, list[str]]]:
    keys: list = []
    texts: list[str] = []
    held = 0
    for frame in frames:
        for key, text in zip(frame["doc_id"], frame["text"], strict=True):
            keys.append(None if pd.isna(key) else int(key))
            texts.append(text or "")
            held += len(texts[-1])
            if held >= CHARS_AT_ONCE:
                yield keys, texts
                keys, texts, held = [], [], 0
    if keys:
        yield keys, texts


def _run(docs: DataFrame, model_path: str, k: int, seed: int, temperature: float, schema: str, row_of) -> DataFrame:
    def sample(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pieces = vocabulary(model_path, temperature)
        segment = Segmenter(pieces, k, seed)
        names = [part.split()[0] for part in schema.split(", ")]
        for keys, texts in _batches(frames):
            found = segment([key or 0 for key in keys], texts)
            rows = [row_of(pieces, key, text, i, *one) for key, text, samples in zip(keys, texts, found, strict=True) for i, one in enumerate(samples)]
            for at in range(0, len(rows), 1000):
                yield pd.DataFrame(rows[at:at + 1000], columns=names).astype({"doc_id": "Int64"})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(sample, schema)


def _sample_row(pieces, key, text, i, ids, logp, number, inclusion):
    return key, i, ids, logp, number, inclusion


def _digest_row(pieces, key, text, i, ids, logp, number, inclusion):
    return (key, i, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), logp, number, inclusion, pieces.decode(ids) == text)


def sample_segmentations(docs: DataFrame, model_path: str, k: int = 2, seed: int = 5, temperature: float = 1.0) -> DataFrame:
    """Up to ``k`` distinct segmentations of every text, best perturbed number first."""
    return _run(docs, model_path, k, seed, temperature, SAMPLES, _sample_row)


def segmentation_digests(docs: DataFrame, model_path: str, k: int = 2, seed: int = 5, temperature: float = 1.0) -> DataFrame:
    """The same samples as counts and checksums, each decoded again and held against its text."""
    return _run(docs, model_path, k, seed, temperature, DIGESTS, _digest_row)


def decode(samples: DataFrame, model_path: str) -> DataFrame:
    """All columns of ``samples`` plus ``text``, the decoded ``ids``."""
    @F.pandas_udf("string")
    def plain(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        pieces = vocabulary(model_path)
        for batch in batches:
            yield batch.map(lambda ids: None if ids is None else pieces.decode(np.asarray(ids)))

    return samples.withColumn("text", plain("ids"))
