"""Substring search over a table by trigram postings.

The index of a table has, for each run of three characters in the searched text, the keys of the rows that hold it, in folders by hash of
the trigram, and how many rows that is. A search reads the postings of the rarest few trigrams of its term, keeps the keys that all of
them have, and looks for the term itself in those rows only. Terms of fewer than three characters have no trigram and scan the table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallylake.sources.lake import full_overwrite_sink

FOLDERS, MOST_POSTINGS = 64, 3
COUNTS = "trigram string, n long, folder int"


def trigrams(value: Column) -> Column:
    """The distinct runs of three characters."""
    starts = F.sequence(F.lit(1), F.greatest(F.length(value) - 2, F.lit(1)))
    return F.when(F.length(value) >= 3, F.array_distinct(F.transform(starts, lambda i: F.substring(value, i, F.lit(3))))).otherwise(
        F.array().cast("array<string>"))


def _folder(trigram: Column) -> Column:
    return F.pmod(F.xxhash64(trigram), F.lit(FOLDERS)).cast("int")


def write_index(rows: DataFrame, key: str, text: Column, path: str) -> None:
    """Index ``rows`` below ``path`` by their (lower-case) ``text``. A trigram of very many rows is spread over tasks by key."""
    found = rows.select(F.col(key).alias("key"), F.explode(trigrams(text)).alias("trigram")).withColumn("folder", _folder(F.col("trigram")))
    found.hint("rebalance", "folder").write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("folder").parquet(f"{path}/postings")
    counts = found.groupBy("trigram").agg(F.count(F.lit(1)).alias("n")).withColumn("folder", _folder(F.col("trigram")))
    full_overwrite_sink(counts, f"{path}/counts")


def _postings(rows: DataFrame, key: str, path: str) -> DataFrame:
    schema = T.StructType([T.StructField("key", rows.schema[key].dataType), T.StructField("trigram", T.StringType()), T.StructField("folder", T.IntegerType())])
    return rows.sparkSession.read.schema(schema).parquet(f"{path}/postings")


def candidates(rows: DataFrame, key: str, path: str, term: str) -> DataFrame:
    """The keys of all rows whose text holds the rarest trigrams of ``term``, which has to have some."""
    spark = rows.sparkSession
    own = sorted({term[i:i + 3] for i in range(len(term) - 2)})
    known = spark.read.schema(COUNTS).parquet(f"{path}/counts").filter(F.col("trigram").isin(own)).collect()  # a row per trigram of the term
    if len(known) < len(own):  # no row has all of them
        return spark.createDataFrame([], T.StructType([T.StructField("key", rows.schema[key].dataType)]))
    rarest = sorted(known, key=lambda r: (r["n"], r["trigram"]))[:MOST_POSTINGS]
    wanted = F.col("folder").isin(sorted({r["folder"] for r in rarest})) & F.col("trigram").isin([r["trigram"] for r in rarest])
    held = _postings(rows, key, path).filter(wanted).groupBy("key").agg(F.count_distinct("trigram").alias("n"))
    return held.filter(F.col("n") == len(rarest)).select("key")


def search(rows: DataFrame, key: str, text: Column, path: str, term: str) -> DataFrame:
    """The rows whose (lower-case) ``text`` contains ``term``, ignoring its case; the same as a scan finds."""
    wanted = term.strip().lower()
    if not wanted:
        return rows
    if len(wanted) >= 3:
        rows = rows.join(candidates(rows, key, path, wanted), F.col(key) == F.col("key"), "left_semi")
    return rows.filter(F.contains(text, F.lit(wanted)))
