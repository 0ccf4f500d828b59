"""Ranked lexical search: the highest-scoring documents for each item, by branch and bound over document FP-trees.

Only the items' terms matter, so a document becomes its restricted term vector: pairs of term and tf, frequent terms first. A shard
of documents is a trie of these vectors (an FP-tree: vectors with equal beginnings share a path, and a path without branches is one
edge). A node keeps, for all documents below it, the largest tf of every term and the smallest length norm m; since a term's part
of a score grows with tf and falls with m, their sum over an item's terms bounds every score below. Per item the tree is searched
depth first, children by falling bound, and a subtree is left out only if its bound is below the item's ``top``-th score so far.

``vectors`` reads the texts once and also gives what the weights need (documents, terms, df), added up per task before it is shuffled.
``search`` then builds trees task by task; a task carries each item's best documents from shard to shard and returns ``top`` rows an
item. Items are taken in blocks of bounded size, because a block's terms are sent to every task; a block costs one pass.

Defined cases: a null or empty text, or one without terms, is no document for N and L and is never found; an item without terms has
no result; rows repeated in full are documents, or items, of their own; a null doc_id is kept and comes last among equal scores; empty tables
give no rows; other columns are ignored. Long texts are counted in pieces, so their words are never all in memory.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallylake.llm.common import cut, running_offsets, small_batches

VECTORS = "kind int, doc_id long, n long, terms array<int>, tfs array<int>"
FOUND = "_no long, item_id long, doc_id long, score long"
PIECE_BYTES = 1 << 22
VECTORS_AT_ONCE = 2048

# a term is a run of these bytes, A to Z lowered; every other byte becomes a blank
_TO_TERMS = bytes(b if chr(b).isalnum() or b > 127 else 32 for b in bytes(range(256)).lower()[:128]) + bytes(range(128, 256))


@dataclass(frozen=True)
class Settings:
    top: int = 10
    leaf_rows: int = 32  # documents below a node that are scored one by one
    shard_rows: int = 8192  # documents of a tree
    shard_entries: int = 2_000_000  # and their terms, at most
    bound_bytes: int = 64 << 20  # of a tree's bounds, nodes by terms: shards get smaller where an item block has many terms
    terms_at_once: int = 1 << 16  # of a block of items


def terms_of(text: str | None) -> Iterator[list[bytes]]:
    """The terms of a text in order, in pieces."""
    data = text.encode("utf-8", "surrogatepass").translate(_TO_TERMS) if text else b""
    start = 0
    while start < len(data):
        stop = data.find(b" ", start + PIECE_BYTES) if len(data) - start > PIECE_BYTES else -1
        stop = len(data) if stop < 0 else stop
        yield data[start:stop].split()
        start = stop


def item_terms(items: DataFrame) -> DataFrame:
    """(_no, item_id, terms): each item with its distinct terms, a row per row of ``items``."""
    def distinct(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sets = [sorted({t for piece in terms_of(text) for t in piece}) for text in batch["text"]]
            yield pd.DataFrame({"_no": batch["_no"], "item_id": batch["item_id"].astype("Int64"), "terms": sets})

    slim = items.select(F.monotonically_increasing_id().alias("_no"), F.col("item_id").cast("long").alias("item_id"), "text")
    return slim.mapInPandas(distinct, "_no long, item_id long, terms array<binary>").where(F.size("terms") > 0)


def vectors(docs: DataFrame, vocabulary: list[bytes]) -> DataFrame:
    """Kind 0: a document's number of terms and its terms out of ``vocabulary`` by number, with their tf. Kind 1: a task's documents
    (doc_id), all their terms (n), and the documents that hold each term of the vocabulary."""
    number = {term: i for i, term in enumerate(vocabulary)}

    def vectorize(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = length = 0
        holds = np.zeros(len(number), dtype=np.int64)
        for batch in batches:
            for at in range(0, len(batch), VECTORS_AT_ONCE):
                part = batch.iloc[at:at + VECTORS_AT_ONCE]
                rows = []
                for doc_id, text in zip(part["doc_id"], part["text"], strict=True):
                    n, counts = 0, Counter()
                    for piece in terms_of(text):
                        n += len(piece)
                        counts.update(map(number.get, piece))
                    counts.pop(None, None)
                    seen, length = seen + (n > 0), length + n
                    if counts:
                        own = np.fromiter(counts.keys(), dtype=np.int32, count=len(counts))
                        holds[own] += 1
                        rows.append((0, doc_id, n, own, np.fromiter(counts.values(), dtype=np.int32, count=len(counts))))
                yield pd.DataFrame(rows, columns=["kind", "doc_id", "n", "terms", "tfs"]).astype({"doc_id": "Int64"})
        held = np.flatnonzero(holds).astype(np.int32)
        yield pd.DataFrame([(1, seen, length, held, holds[held].astype(np.int32))], columns=["kind", "doc_id", "n", "terms", "tfs"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(vectorize, VECTORS)


class Tree:
    """The FP-tree of one shard: documents sorted by their term vectors, nodes as runs of neighbours that share a path."""

    def __init__(self, doc_ids: list, m: np.ndarray, sizes: np.ndarray, terms: np.ndarray, tfs: np.ndarray, weights: np.ndarray, leaf_rows: int) -> None:
        doc = np.repeat(np.arange(len(sizes)), sizes)
        order = np.lexsort((terms, doc))
        terms, tfs = terms[order], tfs[order]
        ends = np.cumsum(sizes)
        path = terms.astype(">u4").tobytes()
        by_path = sorted(range(len(sizes)), key=lambda i: path[4 * (ends[i] - sizes[i]):4 * ends[i]])
        moved = np.concatenate([np.arange(ends[i] - sizes[i], ends[i]) for i in by_path])
        self.doc_ids = [doc_ids[i] for i in by_path]
        self.m, self.terms, self.tfs = m[by_path], terms[moved], tfs[moved].astype(np.int64)
        self.starts = np.concatenate([[0], np.cumsum(sizes[by_path])])
        self.parts = part(weights[self.terms], self.tfs, np.repeat(self.m, np.diff(self.starts)))
        self._grow(self._shared(), leaf_rows)
        self._bound(weights)

    def _shared(self) -> np.ndarray:
        """How many first terms each document shares with the one before it."""
        out = np.zeros(len(self.m), dtype=np.int64)
        for i in range(1, len(out)):
            a, b, end = self.starts[i - 1], self.starts[i], self.starts[i + 1]
            n = min(b - a, end - b)
            unlike = self.terms[a:a + n] != self.terms[b:b + n]
            out[i] = unlike.argmax() if unlike.any() else n
        return out

    def _grow(self, shared: np.ndarray, leaf_rows: int) -> None:
        """Nodes (first, last + 1) in preorder with their children; small neighbouring children make up one leaf."""
        self.spans: list[tuple[int, int]] = []
        self.children: list[list[int]] = []
        todo: list[tuple[int, int, int]] = [(0, len(shared), -1)]
        while todo:
            lo, hi, parent = todo.pop()
            own = len(self.spans)
            self.spans.append((lo, hi))
            self.children.append([])
            if parent >= 0:
                self.children[parent].append(own)
            if hi - lo <= leaf_rows:
                continue
            inner = shared[lo + 1:hi]
            edges = [lo, *(np.flatnonzero(inner == inner.min()) + lo + 1).tolist(), hi]
            begin = lo
            for a, b in zip(edges, edges[1:], strict=False):
                if b - a > leaf_rows:
                    if begin < a:
                        todo.append((begin, a, own))
                    todo.append((a, b, own))
                    begin = b
                elif b - begin > leaf_rows:
                    todo.append((begin, a, own))
                    begin = a
            if begin < hi:
                todo.append((begin, hi, own))

    def _bound(self, weights: np.ndarray) -> None:
        largest = np.zeros((len(self.spans), len(weights)), dtype=np.int64)
        least = np.zeros(len(self.spans), dtype=np.int64)
        for node in range(len(self.spans) - 1, -1, -1):
            lo, hi = self.spans[node]
            least[node] = self.m[lo:hi].min()
            if self.children[node]:
                largest[node] = largest[self.children[node]].max(axis=0)
            else:
                np.maximum.at(largest[node], self.terms[self.starts[lo]:self.starts[hi]], self.tfs[self.starts[lo]:self.starts[hi]])
        self.bounds = part(weights, largest, least[:, None])

    def search(self, item: np.ndarray, member: np.ndarray, best: Best) -> None:
        """Offers ``best`` every document that may be among the item's first ones. ``member`` marks the item's terms."""
        bounds = self.bounds[:, item].sum(axis=1)
        todo = [0]
        while todo:
            node = todo.pop()
            if bounds[node] < best.least or not bounds[node]:
                continue
            if below := self.children[node]:
                todo.extend(sorted(below, key=bounds.__getitem__))
                continue
            lo, hi = self.spans[node]
            first, last = self.starts[lo], self.starts[hi]
            own = np.where(member[self.terms[first:last]], self.parts[first:last], 0)
            scores = np.add.reduceat(own, self.starts[lo:hi] - first)
            for i in np.flatnonzero(scores >= max(best.least, 1)).tolist():
                best.offer(int(scores[i]), self.doc_ids[lo + i])


class Best:
    """The first ``top`` documents of an item: highest score, then smallest doc_id, none last."""

    def __init__(self, top: int) -> None:
        self.top, self.least, self.rows = top, 0, []

    def offer(self, score: int, doc_id: int | None) -> None:
        self.rows.append((-score, doc_id is None, doc_id or 0))
        if len(self.rows) >= 4 * self.top:
            self.settle()
        elif len(self.rows) == self.top:
            self.least = -max(self.rows)[0]

    def settle(self) -> None:
        self.rows = sorted(self.rows)[:self.top]
        if len(self.rows) == self.top:
            self.least = -self.rows[-1][0]


def part(weight, tf, m):
    """A term's part of a score."""
    return weight * ((1_000_000_000 * tf) // np.maximum(1000 * tf + 8 * m, 1))


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def _search_block(stored: DataFrame, items: list, vocabulary: list[bytes], settings: Settings) -> DataFrame:
    """(_no, item_id, doc_id, score): each task's best documents of every item. ``stored`` has the vectors over ``vocabulary``."""
    totals = stored.where("kind = 1").agg(F.sum("doc_id").alias("docs"), F.sum("n").alias("terms")).first()
    n_docs, n_terms = totals["docs"] or 0, totals["terms"] or 0
    pairs = stored.where("kind = 1").select(F.explode(F.arrays_zip("terms", "tfs")).alias("p")).groupBy("p.terms").agg(F.sum("p.tfs").alias("df"))
    df = np.zeros(len(vocabulary), dtype=np.int64)
    for row in pairs.collect():  # at most the terms of one block
        df[row["terms"]] = row["df"]
    frequent_first = np.argsort(-df, kind="stable")
    rank = np.empty(len(df), dtype=np.int64)
    rank[frequent_first] = np.arange(len(df))
    weights = np.array([weight(n_docs, d) for d in df[frequent_first].tolist()], dtype=np.int64)
    number = {term: i for i, term in enumerate(vocabulary)}
    wanted = [(row["_no"], row["item_id"], np.sort(rank[[number[bytes(t)] for t in row["terms"]]])) for row in items]
    nodes = max(4, settings.bound_bytes // (16 * max(len(df), 1)))
    rows_at_once = max(settings.leaf_rows, min(settings.shard_rows, nodes * settings.leaf_rows // 4))

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best = [Best(settings.top) for _ in wanted]

        def shard(part_rows: pd.DataFrame) -> None:
            sizes = part_rows["terms"].map(len).to_numpy()
            m = 100 - 90 + (90 * part_rows["n"].to_numpy(dtype=np.int64) * n_docs) // n_terms
            doc_ids = [None if pd.isna(x) else int(x) for x in part_rows["doc_id"]]
            tree = Tree(doc_ids, m, sizes, rank[np.concatenate(part_rows["terms"].to_list())], np.concatenate(part_rows["tfs"].to_list()), weights, settings.leaf_rows)
            member = np.zeros(len(weights), dtype=bool)
            for (_, _, item), found in zip(wanted, best, strict=True):
                member[item] = True
                tree.search(item, member, found)
                found.settle()
                member[item] = False

        held, rows, entries = [], 0, 0
        for batch in batches:
            sizes = batch["terms"].map(len).to_numpy()
            at = 0
            while at < len(batch):
                room = np.searchsorted(np.cumsum(sizes[at:]), settings.shard_entries - entries, side="right")
                take = max(0 if rows else 1, min(rows_at_once - rows, room))
                held.append(batch.iloc[at:at + take])
                rows, entries, at = rows + take, entries + int(sizes[at:at + take].sum()), at + take
                if at < len(batch):
                    shard(pd.concat(held))
                    held, rows, entries = [], 0, 0
        if rows:
            shard(pd.concat(held))
        out = [(no, item_id, None if none else doc_id, -score) for (no, item_id, _), found in zip(wanted, best, strict=True) for score, none, doc_id in found.rows]
        frame = pd.DataFrame(out, columns=["_no", "item_id", "doc_id", "score"])
        yield frame.astype({"item_id": "Int64", "doc_id": "Int64"})

    return stored.where("kind = 0").mapInPandas(find, FOUND)


def search(docs: DataFrame, items: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``top`` documents of every item, highest score first, ties by doc_id."""
    small_batches(docs.sparkSession)
    asked = cut(item_terms(items).withColumn("_size", F.size("terms").cast("long")))
    blocks = running_offsets(asked.select("_no", "_size"), "_no", "_size", "_before").select(
        "_no", F.floor(F.col("_before") / settings.terms_at_once).alias("_block"))
    asked = cut(asked.join(blocks, "_no"))
    found = None
    for row in asked.select("_block").distinct().orderBy("_block").toLocalIterator():
        block = asked.where(F.col("_block") == row["_block"]).orderBy("_no").collect()  # ``terms_at_once`` and one item, at most
        vocabulary = sorted({bytes(term) for item in block for term in item["terms"]})
        own = _search_block(cut(vectors(docs, vocabulary)), block, vocabulary, settings)
        found = own if found is None else found.union(own)
    if found is None:
        found = docs.sparkSession.createDataFrame([], FOUND)
    place = F.row_number().over(Window.partitionBy("_no").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last()))
    return found.withColumn("rank", place).where(F.col("rank") <= settings.top).select("item_id", "rank", "doc_id", "score")
