"""Sharding by a two-pass external shuffle.

Pass one scatters the rows into buckets by a seeded hash; there are as many as keep a bucket near ``bucket_bytes``. Pass two puts
each bucket in Fisher-Yates order: Spark's ``shuffle`` draws one permutation of a bucket's positions, and rows take
the place their own position was moved to. Only positions are permuted in memory, texts stay where the scatter put them.
Place p of the whole order goes to shard p mod n, slot p div n, so shard sizes differ by at most one row (law ``rows``).

The same rows, seed and number of shuffle partitions give the same order. Retried tasks repeat their permutations, since buckets
are sorted before they are drawn.

Defined cases: a null text has no bytes and is kept; rows repeated in full stay separate rows (they share a bucket); null ids
are placed by their text; an empty table gives no rows; other columns are carried along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallylake.llm.common import running_offsets

OWN = ("_mix", "_bucket", "_place", "_order", "_ahead_rows")


def external_shuffle(
    docs: DataFrame, shards: int = 8, seed: int = 20, bucket_bytes: int = 32 << 20, least_buckets: int = 256,
) -> DataFrame:
    """All columns of ``docs`` plus ``shard`` (int, from 0) and ``slot`` (long, gapless from 0 in each shard)."""
    kept = docs.drop("shard", "slot", *OWN)
    total = kept.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(least_buckets, -(-total // bucket_bytes))
    mix = F.xxhash64(F.lit(seed), F.col("doc_id"), F.when(F.col("doc_id").isNull(), F.col("text")))
    scattered = kept.withColumn("_mix", mix).withColumn("_bucket", F.pmod("_mix", F.lit(buckets)))
    sizes = running_offsets(scattered.groupBy("_bucket").agg(F.count("*").alias("_rows")), "_bucket", "_rows", "_ahead_rows")
    orders = (
        sizes.repartition("_bucket").sortWithinPartitions("_bucket")
        .select("_bucket", "_ahead_rows", F.shuffle(F.sequence(F.lit(0).cast("long"), F.col("_rows") - 1), F.lit(seed)).alias("_order"))
    )
    place = F.row_number().over(Window.partitionBy("_bucket").orderBy("_mix", "doc_id", "text"))
    position = F.col("_ahead_rows") + F.get("_order", F.col("_place") - 1)
    return (
        scattered.withColumn("_place", place).join(orders, "_bucket")
        .withColumn("_position", position)
        .withColumn("shard", F.pmod("_position", F.lit(shards)).cast("int"))
        .withColumn("slot", F.floor(F.col("_position") / shards).cast("long"))
        .drop("_position", *OWN)
    )


def write_shards(shuffled: DataFrame, path: str) -> None:
    """One folder per shard, rows in slot order; a shard is cut into files by ranges of slots."""
    shuffled.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").mode("overwrite").parquet(path)


def digest(shuffled: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return shuffled.select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
    )
