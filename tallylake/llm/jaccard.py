"""N-gram Jaccard join by parity sketches.

Documents link when 100 * |A and B| >= 75 * |A or B| over their sets of five-word shingles. Per size band, shingles toggle bits of a
sketch of many blocks; the Hamming distance of two sketches is at most the sets' symmetric difference, so by the pigeonhole
principle linked sets agree in one of any (largest difference + 1) filled blocks: those are join keys (``shingles.py``). How fine the
blocks are is settled per band from all sets, so that every set fills enough of them. Blocks of shingles that many documents share
come last. A candidate pair is dropped if its sizes or the
Hamming distance of whole sketches rule a link out; the others are verified on the full sets, made from the texts again.

Copies and skew: equal sets are one class, linked without a comparison. The rows of one key are read as a sorted run and give pairs with the
run's first document only, so a key that n documents share costs n rows, not n squared. A link within a run whose ends both
miss the first one is found afterwards: components are formed, and runs that still hold several are searched again from
``STARS`` other documents and at last between all their different components. No pair of a run is left out unless its
ends are connected already, so components are exact. Pairs are verified in two rounds, each document's pair with its smallest partner
first: most others then lie within one component, and their texts need not move. Components are carried on: more links are links of
components.

Defined cases: a null or empty text, or one without words, has size 0 and links with nothing; a null doc_id links with nothing and
has a null component; rows that share a doc_id are one document for links (any of their texts counts) and have a result row each;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallylake.llm.common import cut, release, stored
from tallylake.llm.components import absorb, components
from tallylake.llm.shingles import Bands, block_keys, least_level, linked, may_link, mix, shingle_set, sketch

MOST_FREQUENT = 1 << 18
COUNTED_AT_ONCE, LEAST_COUNT = 4_000_000, 8
STARS = 3
MEASURES = "kind int, doc_id long, n_shingles long, s1 long, s2 long, scheme int, level int, sketch array<long>"


def _measure(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Kind 0: a document's set size, signature and sketch. Kind 1: level needed by a scheme. Kind 2: a frequent shingle and its count."""
    held: list[np.ndarray] = []
    count = 0
    levels: dict[int, int] = {}

    def frame(kind, doc_id, n, s1=0, s2=0, scheme=0, level=0, sketches=None):
        out = pd.DataFrame({"kind": kind, "doc_id": doc_id, "n_shingles": n, "s1": s1, "s2": s2, "scheme": scheme, "level": level, "sketch": sketches})
        return out.astype({"doc_id": "Int64"})

    def frequent() -> pd.DataFrame:
        values, times = np.unique(np.concatenate(held), return_counts=True)
        often = times >= LEAST_COUNT
        return frame(2, pd.NA, times[often], values[often].view(np.int64))

    for batch in frames:
        sets = [shingle_set(text) for text in batch["text"]]
        with np.errstate(over="ignore"):
            first = np.array([s.sum(dtype=np.uint64) if len(s) else 0 for s in sets], dtype=np.uint64).view(np.int64)
            second = np.array([mix(s ^ np.uint64(1)).sum(dtype=np.uint64) if len(s) else 0 for s in sets], dtype=np.uint64).view(np.int64)
        yield frame(0, batch["doc_id"].to_numpy(), np.array([len(s) for s in sets], dtype=np.int64), first, second,
                    sketches=[sketch(s).view(np.int64) for s in sets])
        for s in sets:
            for scheme, difference in Bands.of(len(s)) if len(s) else ():
                if levels.get(scheme, 0) < Bands.LEVELS - 1:
                    levels[scheme] = max(levels.get(scheme, 0), least_level(s, scheme, difference))
            held.append(s)
            count += len(s)
            if count >= COUNTED_AT_ONCE:
                yield frequent()
                held, count = [], 0
    if held:
        yield frequent()
    if levels:
        yield frame(1, pd.NA, 0, scheme=list(levels), level=list(levels.values()))


def _keys(texts: DataFrame, levels: dict[int, int], frequent: np.ndarray) -> DataFrame:
    """(key, doc_id) of the first blocks of every set."""
    shared = texts.sparkSession.sparkContext.broadcast(frequent)  # at most MOST_FREQUENT numbers

    def keys(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in frames:
            out, owners = [], []
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                s = shingle_set(text)
                for scheme, difference in Bands.of(len(s)) if len(s) else ():
                    out.append(block_keys(s, scheme, levels[scheme], difference, shared.value))
                    owners.append(np.full(len(out[-1]), doc_id, dtype=np.int64))
            if out:
                yield pd.DataFrame({"key": np.concatenate(out).view(np.int64), "doc_id": np.concatenate(owners)})

    return texts.mapInPandas(keys, "key long, doc_id long")


def _runs(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sorted (key, doc_id) -> (key, leader, doc_id): members of keys with several rows; key 0 where there are just two."""
    key, leader, size = None, 0, 0
    for batch in frames:
        keys, docs = batch["key"].to_numpy(), batch["doc_id"].to_numpy()
        if not len(keys):
            continue
        starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        sizes = np.diff(np.append(starts, len(keys)))
        leaders = docs[starts].copy()
        open_size = sizes.copy()
        if key is not None and keys[0] == key:
            leaders[0] = leader
            open_size[0] += size
        per_row = np.repeat(np.arange(len(starts)), sizes)
        member = docs != leaders[per_row]
        # a run at the end of the batch may go on, one at its start may have begun before: both count as large
        large = open_size > 2
        large[-1] = True
        large[0] |= open_size[0] > sizes[0]
        rows = pd.DataFrame({
            "key": np.where(large[per_row], keys, 0)[member], "leader": leaders[per_row][member], "doc_id": docs[member]})
        if len(rows):
            yield rows.drop_duplicates()
        key, leader, size = keys[-1], leaders[-1], open_size[-1]


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The rows of ``pairs`` whose sets of a and b link, more often where a document has several texts."""
    names = pairs.columns

    def verify(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sets: dict[int, tuple[str, np.ndarray]] = {}

        def set_of(doc_id: int, text: str) -> np.ndarray:
            held = sets.get(doc_id)
            if held is None or held[0] != text:
                if len(sets) >= 200:
                    sets.clear()
                held = sets[doc_id] = (text, shingle_set(text))
            return held[1]

        for batch in frames:
            keep = [linked(set_of(a, ta), set_of(b, tb)) for a, ta, b, tb in zip(batch["a"], batch["text_a"], batch["b"], batch["text_b"], strict=True)]
            yield batch.loc[keep, names]

    first = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a"))
    second = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b"))
    return pairs.join(first, "a").join(second, "b").mapInPandas(verify, pairs.schema)


def jaccard_components(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row."""
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    measured = cut(texts.mapInPandas(_measure, MEASURES))
    sizes = measured.where("kind = 0").select("doc_id", "n_shingles", "s1", "s2")
    levels = {row["scheme"]: row["level"] for row in measured.where("kind = 1").groupBy("scheme").agg(F.max("level").alias("level")).collect()}
    often = (
        measured.where("kind = 2").groupBy("s1").agg(F.sum("n_shingles").alias("n")).orderBy(F.desc("n"), "s1").limit(MOST_FREQUENT)
        .select("s1").toPandas()["s1"].to_numpy().astype(np.int64).view(np.uint64)
    )
    classes = sizes.where("doc_id is not null and n_shingles > 0").groupBy("n_shingles", "s1", "s2").agg(F.min("doc_id").alias("first"))
    of_class = cut(sizes.where("doc_id is not null and n_shingles > 0").join(classes, ["n_shingles", "s1", "s2"]).select("doc_id", "n_shingles", "first"))
    keys = _keys(texts.where("doc_id is not null"), levels, np.sort(often))
    runs = cut(keys.repartition("key").sortWithinPartitions("key", "doc_id").mapInPandas(_runs, "key long, leader long, doc_id long").distinct())
    members = _by_class(runs, of_class)
    del runs
    release(spark)
    sketches = cut(of_class.where("doc_id = first").join(
        measured.where("kind = 0").select("doc_id", "n_shingles", "sketch").distinct(), ["doc_id", "n_shingles"]).select("doc_id", "n_shingles", "sketch"))
    pairs = _possible(members.select(F.col("leader").alias("a"), F.col("doc_id").alias("b")), sketches)
    held = _Texts(texts)
    # each document's pair with the smallest partner first; of the others only those that could join different components
    first = stored(pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"), "jaccard-first")
    labels = components(held.verified(first).union(_same_document(of_class)))
    labels = _verified_between(labels, pairs.join(first, ["a", "b"], "left_anti"), held)
    release(spark)
    large = members.where("key != 0")
    large = cut(large.select("key", "doc_id").union(large.select("key", F.col("leader").alias("doc_id"))).distinct())
    done = pairs
    for search in (_star, lambda open_runs: _across(open_runs, sketches)):
        open_runs = stored(_open_runs(large, labels), "jaccard-runs")
        if open_runs.isEmpty():
            break
        pairs = _possible(search(open_runs), sketches, done)
        done = done.union(pairs)
        labels = _verified_between(labels, pairs, held)
        release(spark)
    return _with_components(sizes, of_class, labels)


def _verified_between(labels: DataFrame, pairs: DataFrame, held: _Texts) -> DataFrame:
    """``labels`` after those of ``pairs`` that link; a pair within one component can't change it and isn't compared."""
    ends = [labels.select(F.col("id").alias(c), F.col("component").alias(f"_{c}")) for c in ("a", "b")]
    apart = pairs.join(ends[0], "a", "left").join(ends[1], "b", "left").where(F.coalesce("_a", "a") != F.coalesce("_b", "b"))
    apart = stored(apart.select("a", "b"), "jaccard-apart")
    return labels if apart.isEmpty() else absorb(labels, held.verified(apart))


def _same_document(of_class: DataFrame) -> DataFrame:
    """Links between the classes of documents that have rows in several."""
    least = of_class.groupBy("doc_id").agg(F.min("first").alias("a"), F.max("first").alias("_last")).where("a != _last")
    return of_class.join(least, "doc_id").where("first != a").select("a", F.col("first").alias("b")).distinct()


def _by_class(runs: DataFrame, of_class: DataFrame) -> DataFrame:
    """Runs between the first documents of their classes."""
    leads = of_class.select(F.col("doc_id").alias("leader"), F.col("first").alias("_lead")).distinct()
    owns = of_class.select("doc_id", F.col("first").alias("_own")).distinct()
    return cut(runs.join(leads, "leader").join(owns, "doc_id").select("key", F.col("_lead").alias("leader"), F.col("_own").alias("doc_id"))
               .where("leader != doc_id").distinct())


def _possible(pairs: DataFrame, sketches: DataFrame, done: DataFrame | None = None) -> DataFrame:
    """Pairs in a fixed order, not ``done`` yet, that sizes and sketches don't rule out; more often where a document has several texts."""
    def possible(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in frames:
            keep = [
                may_link(na, np.asarray(sa).view(np.uint64), nb, np.asarray(sb).view(np.uint64))
                for na, sa, nb, sb in zip(batch["na"], batch["sa"], batch["nb"], batch["sb"], strict=True)]
            yield batch.loc[keep, ["a", "b"]]

    ordered = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct()
    if done is not None:
        ordered = ordered.join(done, ["a", "b"], "left_anti")
    first = sketches.select(F.col("doc_id").alias("a"), F.col("n_shingles").alias("na"), F.col("sketch").alias("sa"))
    second = sketches.select(F.col("doc_id").alias("b"), F.col("n_shingles").alias("nb"), F.col("sketch").alias("sb"))
    fitting = ordered.join(first, "a").join(second, "b").where("4 * na >= 3 * nb and 4 * nb >= 3 * na")
    return stored(fitting.mapInPandas(possible, "a long, b long"), "jaccard-pairs")


class _Texts:
    """Texts of the documents that are compared, stored once each as they are first needed."""

    def __init__(self, texts: DataFrame) -> None:
        self.texts, self.spark = texts, texts.sparkSession
        self.held: DataFrame | None = None
        self.ids: DataFrame | None = None

    def verified(self, pairs: DataFrame) -> DataFrame:
        ids = pairs.select(F.col("a").alias("doc_id")).union(pairs.select(F.col("b").alias("doc_id"))).distinct()
        new = stored(ids if self.ids is None else ids.join(self.ids, "doc_id", "left_anti"), "jaccard-ids")
        if not new.isEmpty():
            more = stored(self.texts.join(new, "doc_id", "left_semi"), "jaccard-texts")
            self.held = more if self.held is None else self.held.union(more)
            self.ids = new if self.ids is None else self.ids.union(new)
        if self.held is None:
            return pairs
        return _verified(pairs, self.held)


def _open_runs(large: DataFrame, labels: DataFrame) -> DataFrame:
    """(key, doc_id, component) of the runs whose documents aren't all in one component."""
    rows = large.join(labels.withColumnRenamed("id", "doc_id"), "doc_id", "left").select(
        "key", "doc_id", F.coalesce("component", "doc_id").alias("component"))
    split = rows.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo != hi")
    return rows.join(split.select("key", F.col("lo").alias("main")), "key")


def _star(open_runs: DataFrame) -> DataFrame:
    """The first documents of each run's first ``STARS`` components but the main one, against all documents of other components."""
    firsts = open_runs.where("component != main").groupBy("key", "component").agg(F.min("doc_id").alias("centre"))
    nth = F.row_number().over(Window.partitionBy("key").orderBy("centre"))
    centres = firsts.withColumn("_nth", nth).where(F.col("_nth") <= STARS).select("key", "centre", F.col("component").alias("_own"))
    return open_runs.join(centres, "key").where("component != _own").select(F.col("centre").alias("a"), F.col("doc_id").alias("b"))


def _across(open_runs: DataFrame, sketches: DataFrame) -> DataFrame:
    """Pairs of a run from different components that sizes and sketches don't rule out; others leave the join at once."""
    def folded(words):
        half = F.floor(F.size(words) / 2).cast("int")
        by_word = F.transform(F.sequence(F.lit(0), half - 1), lambda i: F.get(words, i).bitwiseXOR(F.get(words, i + half)))
        return F.when(F.size(words) > 1, by_word).otherwise(words)

    def apart(x, y):
        return F.aggregate(F.zip_with(x, y, lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda total, n: total + n)

    rows = open_runs.select("key", "doc_id", "component").join(sketches, "doc_id")
    # both sides alike, so that one shuffle serves both
    one, two = (rows.select(*[F.col(c).alias(f"{c}_{side}") for c in ("key", "doc_id", "component", "n_shingles", "sketch")]) for side in (1, 2))
    x, y = F.col("sketch_1"), F.col("sketch_2")
    distance = F.when(F.size(x) == F.size(y), apart(x, y)).when(F.size(x) > F.size(y), apart(folded(x), y)).otherwise(apart(x, folded(y)))
    fits = (4 * F.col("n_shingles_1") >= 3 * F.col("n_shingles_2")) & (4 * F.col("n_shingles_2") >= 3 * F.col("n_shingles_1"))
    fits = (F.col("doc_id_1") < F.col("doc_id_2")) & (F.col("component_1") != F.col("component_2")) & fits
    near = F.when(fits, 7 * distance <= F.col("n_shingles_1") + F.col("n_shingles_2")).otherwise(F.lit(False))
    return one.join(two, (F.col("key_1") == F.col("key_2")) & near).select(F.col("doc_id_1").alias("a"), F.col("doc_id_2").alias("b"))


def _with_components(sizes: DataFrame, of_class: DataFrame, labels: DataFrame) -> DataFrame:
    """Every row with its component, the smallest document of the smallest class that links reach."""
    known = of_class.join(labels.withColumnRenamed("id", "first"), "first", "left").select(
        "doc_id", F.coalesce("component", "first").alias("component_id"))
    per_doc = known.groupBy("doc_id").agg(F.min("component_id").alias("component_id"))
    return sizes.join(per_doc, "doc_id", "left").select(
        "doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
