from __future__ import annotations

from collections import Counter

from pyspark.sql import functions as F

from tallylake.llm import sharding
from tests.llm.helpers import documents


def test_shards_differ_by_a_row_at_most_and_slots_have_no_gaps(spark):
    docs = documents(spark, [f"text {i}" if i % 3 else "copy" for i in range(2001)]).withColumn("shard", F.lit("clash"))
    got = sharding.external_shuffle(docs, least_buckets=16).select("doc_id", "text", "shard", "slot").toPandas()
    assert sorted(got["doc_id"]) == list(range(2001))
    sizes = Counter(got["shard"])
    assert set(sizes) == set(range(8)) and max(sizes.values()) - min(sizes.values()) <= 1
    for _, rows in got.groupby("shard"):
        assert sorted(rows["slot"]) == list(range(len(rows)))


def test_same_seed_same_order_other_seed_other_order(spark):
    docs = documents(spark, [str(i) for i in range(500)])
    place = lambda seed: [tuple(r) for r in sharding.external_shuffle(docs, seed=seed).select("doc_id", "shard", "slot").orderBy("doc_id").collect()]
    assert place(1) == place(1) != place(2)


def test_nulls_repeats_empty_and_write(spark, tmp_path):
    docs = documents(spark, [(None, None), (None, "x"), (4, "y"), (4, "y"), (5, "")])
    got = sharding.digest(sharding.external_shuffle(docs, shards=2)).collect()
    assert sorted(r["size"] for r in got) == [1, 1, 2, 2, 2] and Counter(r["shard"] for r in got) == {0: 3, 1: 2}
    assert all(r["law"] == "rows" and r["grown_shard"] is None for r in got)
    assert sharding.external_shuffle(docs.limit(0)).count() == 0
    sharding.write_shards(sharding.external_shuffle(docs, shards=2), str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 5
