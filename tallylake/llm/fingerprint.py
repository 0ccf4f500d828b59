"""Document fingerprints: a homomorphic multiset hash of the paragraphs.

Every paragraph hashes to a wide vector of lanes; a document's fingerprint is the sum of its paragraphs' vectors, each lane modulo
a power of two. The sum doesn't depend on the order, so equal multisets of paragraphs agree, and ``insert`` and ``delete`` change
a fingerprint by one paragraph without the rest of the text.

A paragraph's vector has two parts. ``IDENTITY`` longs hold four uniform lanes modulo 2**14 each and tell any two paragraphs apart.
``LIKENESS`` longs hold two lanes modulo 2**30 each that sum bits (read as -1 and 1) over the paragraph's pieces of at most
``PIECE_WORDS`` words between punctuation: the inner product of two documents' lanes then estimates the pieces they share, and
``likeness`` turns that into 0 to 1. No text that fits a row has 2**30 pieces, so these sums are whole. Lanes are packed with a mask
after each addition, so none carries into its neighbour.

Defined cases: a null text is empty; an empty text has the zero vector; two texts without pieces are alike (1) if their
fingerprints are equal, else 0; rows repeated in full give repeated results. The next document is the next larger doc_id
(null sorts first, after the last comes the first); if several rows share that id, the one with the smallest replaced part counts.
A single document is its own next one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallylake.llm.common import cut, text_or_empty

IDENTITY, HASHES, PIECE_WORDS = 8, 4, 8
# every lane has a spare bit above it for the carry
LANES = sum(0x3FFF << shift for shift in (0, 15, 30, 45))
SPARE = sum(0x4000 << shift for shift in (0, 15, 30, 45))
SHIFTS, WIDE = (0, 31), 0x3FFFFFFF
WIDE_LANES = sum(WIDE << shift for shift in SHIFTS)
WIDE_SPARE = sum(0x40000000 << shift for shift in SHIFTS)
ONES = sum(1 << shift for shift in SHIFTS)
BITS = 20  # of each lane's half of a hash
LIKENESS = HASHES * BITS
PIECE = r"[^\s\p{P}\p{S}]+(?: [^\s\p{P}\p{S}]+){0,%d}" % (PIECE_WORDS - 1)


def _long(value: int) -> Column:
    return F.lit(value).cast("long")


def _add(a: Column, b: Column) -> Column:
    return (a + b).bitwiseAND(_long(LANES))


def _add_wide(a: Column, b: Column) -> Column:
    return (a + b).bitwiseAND(_long(WIDE_LANES))


def _identity(paragraphs: Column) -> Column:
    hashes = F.transform(paragraphs, lambda p: F.array(*[F.xxhash64(p, F.lit(k)).bitwiseAND(_long(LANES)) for k in range(IDENTITY)]))
    return F.aggregate(hashes, F.array_repeat(_long(0), IDENTITY), lambda acc, h: F.zip_with(acc, h, _add))


def _likeness(pieces: Column) -> Column:
    hashes = F.transform(pieces, lambda p: F.array(*[F.xxhash64(p, F.lit(100 + k)) for k in range(HASHES)]))

    def lanes(h: Column) -> Column:
        return F.array(*[
            F.call_function("shiftrightunsigned", F.get(h, F.lit(k)), F.lit(shift)).bitwiseAND(_long(ONES))
            for k in range(HASHES) for shift in range(BITS)])

    return F.aggregate(hashes, F.array_repeat(_long(0), LIKENESS), lambda acc, h: F.zip_with(acc, lanes(h), _add_wide))


def vector(text: Column) -> Column:
    """struct(identity: array<long>, likeness: array<long>, pieces: long) of a text that isn't null."""
    paragraphs = F.filter(F.split(text, "\n"), lambda p: p != "")
    pieces = F.regexp_extract_all(text, F.lit(PIECE), F.lit(0))
    return F.struct(
        _identity(paragraphs).alias("identity"), _likeness(pieces).alias("likeness"), F.size(pieces).cast("long").alias("pieces"))


def insert(fingerprint: Column, paragraph: Column) -> Column:
    return _change(fingerprint, vector(paragraph), 1)


def delete(fingerprint: Column, paragraph: Column) -> Column:
    return _change(fingerprint, vector(paragraph), -1)


def _change(fingerprint: Column, other: Column, sign: int) -> Column:
    def combine(a: Column, b: Column) -> Column:
        return _add(a, b) if sign > 0 else (a + _long(SPARE) - b).bitwiseAND(_long(LANES))

    def combine_wide(a: Column, b: Column) -> Column:
        return _add_wide(a, b) if sign > 0 else (a + _long(WIDE_SPARE) - b).bitwiseAND(_long(WIDE_LANES))

    return F.struct(
        F.zip_with(fingerprint["identity"], other["identity"], combine).alias("identity"),
        F.zip_with(fingerprint["likeness"], other["likeness"], combine_wide).alias("likeness"),
        (fingerprint["pieces"] + sign * other["pieces"]).alias("pieces"))


def as_text(fingerprint: Column) -> Column:
    """Hex digits of all lanes."""
    lanes = F.concat(fingerprint["identity"], fingerprint["likeness"], F.array(fingerprint["pieces"]))
    return F.lower(F.array_join(F.transform(lanes, lambda x: F.lpad(F.hex(x), 16, "0")), ""))


def _signed(fingerprint: Column) -> Column:
    """Lanes as sums of -1 and 1: twice the count of ones less the number of pieces."""

    def lane(x: Column, shift: int) -> Column:
        ones = F.call_function("shiftrightunsigned", x, F.lit(shift)).bitwiseAND(_long(WIDE))
        return (ones * 2 - fingerprint["pieces"]).cast("double")

    return F.flatten(F.transform(fingerprint["likeness"], lambda x: F.array(*[lane(x, shift) for shift in SHIFTS])))


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def likeness(rows: DataFrame, own: str, others: dict[str, str]) -> DataFrame:
    """``rows`` plus, per item (out, other) of ``others``, the likeness of the fingerprints in ``own`` and ``other``:
    2<a,b> / (<a,a> + <b,b>) of the signed lanes, held within 0 and 1. Steps in columns of their own, so each is computed once."""
    names = [own, *others.values()]
    rows = rows.withColumns({f"_lanes_{n}": _signed(F.col(n)) for n in names})
    rows = rows.withColumns({f"_norm_{n}": _dot(F.col(f"_lanes_{n}"), F.col(f"_lanes_{n}")) for n in names}
                            | {f"_dot_{n}": _dot(F.col(f"_lanes_{own}"), F.col(f"_lanes_{n}")) for n in others.values()})
    both = {n: F.col(f"_norm_{own}") + F.col(f"_norm_{n}") for n in others.values()}
    share = {n: F.greatest(F.lit(0.0), F.least(F.lit(1.0), 2 * F.col(f"_dot_{n}") / F.nullif(both[n], F.lit(0.0)))) for n in others.values()}
    rows = rows.withColumns({
        out: F.when(F.col(own) == F.col(n), F.lit(1.0)).otherwise(F.coalesce(share[n], F.lit(0.0))) for out, n in others.items()})
    return rows.drop(*[f"{kind}_{n}" for kind in ("_lanes", "_norm", "_dot") for n in names])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint) per row."""
    return docs.select("doc_id", vector(text_or_empty()).alias("fingerprint"))


def next_ids(docs: DataFrame) -> DataFrame:
    """(doc_id, next_id) per distinct id: ids in ranges, next within a range, then one row per range joins the ranges' ends."""
    ids = docs.select("doc_id").distinct()
    placed = cut(ids.repartitionByRange("doc_id").select("doc_id", F.spark_partition_id().alias("_range")))
    as_key = F.struct(F.col("doc_id").isNotNull().alias("known"), F.col("doc_id").alias("doc_id"))
    firsts = placed.groupBy("_range").agg(F.min(as_key).alias("_first"))
    ends = firsts.select("_range", F.coalesce(
        F.lead("_first").over(Window.orderBy("_range")),
        F.first("_first").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)),
    ).alias("_after"))
    inside = Window.partitionBy("_range").orderBy(F.asc_nulls_first("doc_id"))
    following = F.lead(as_key).over(inside)
    return placed.withColumn("_next", following).join(ends, "_range").select(
        "doc_id", F.coalesce(F.col("_next"), F.col("_after"))["doc_id"].alias("next_id"))


def compare_with_edits(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text, and how alike they and the next document's fingerprint are.

    Edited: the last floor(n_chars / 4) code points give way to as many (or all) of the first ones of the next document.
    Texts move once, by doc_id; what a document needs of the next one is cut out where that one lies and sent over.
    """
    # one key for joins, null included; with nothing but key and text on both sides, the texts are shuffled once for both joins
    key = F.coalesce(F.concat(F.lit("i"), F.col("doc_id").cast("string")), F.lit("n"))
    rows = docs.select(key.alias("_key"), text_or_empty().alias("text"))
    next_key = F.coalesce(F.concat(F.lit("i"), F.col("next_id").cast("string")), F.lit("n"))
    following = next_ids(docs).select(key.alias("_key"), next_key.alias("_next"))
    needs = (
        rows.select("_key", F.floor(F.length("text") / 4).cast("int").alias("_need")).groupBy("_key").agg(F.max("_need").alias("_need"))
        .join(following, "_key").select(F.col("_key").alias("_previous"), F.col("_next").alias("_key"), "_need")
    )
    sent = (
        rows.join(needs, "_key")
        .select("_previous", F.struct(F.left(F.col("text"), F.col("_need")).alias("head"), vector(F.col("text")).alias("fingerprint")).alias("_other"))
        .groupBy("_previous").agg(F.min("_other").alias("_other"))
    )
    share = F.floor(F.length("text") / 4).cast("int")
    edited = F.concat(F.left(F.col("text"), F.length("text") - share), F.left(F.col("_other.head"), share))
    compared = likeness(
        rows.join(sent, F.col("_key") == F.col("_previous"))
        .select(
            "_key", F.length("text").cast("long").alias("n_chars"), edited.alias("edited"),
            vector(F.col("text")).alias("own"), F.col("_other.fingerprint").alias("next"))
        .withColumn("changed", vector(F.col("edited"))),
        "own", {"near_edited": "changed", "near_next": "next"})
    doc_id = F.when(F.col("_key") != "n", F.substring("_key", 2, 1 << 30)).cast(docs.schema["doc_id"].dataType)
    return compared.select(
        doc_id.alias("doc_id"), "n_chars", F.sha2("edited", 256).alias("edited_sha256"), as_text(F.col("own")).alias("fingerprint"),
        as_text(F.col("changed")).alias("edited_fingerprint"), "near_edited", "near_next")
