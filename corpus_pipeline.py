"""The corpus pipeline: quality classifier, language ID, line dedup, n-gram Jaccard join, best-fit packing.

Each stage takes (spark, docs, sf_dir) and returns a frame that is written as Parquet and read again as the next one's ``docs``. All but
the last keep the columns of ``documents`` as they came in, extra ones included.

* quality: rejects documents whose probability of the top grade is below ``LEAST_TAIL`` (low quality, toxic, null or blank text);
* language: rejects documents without letters, or whose language is guessed with a score below ``LEAST_SCORE``; with nothing to
  learn languages from, only documents without letters go;
* lines: deletes later copies of repeated runs of lines; documents with nothing left go;
* near_duplicates: keeps one document of each component, the one with the smallest doc_id, and one row of rows equal in doc_id and text;
  different texts under one doc_id are documents of their own; documents without a doc_id or without words have no component and stay;
* packing: the pieces of all documents with their sequences and offsets.

Empty tables pass through every stage. Models learn from the stage's own input (``labels`` and ``lang`` name the targets).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallylake.llm import jaccard, langid, linededup, packing, quality
from tallylake.llm.common import cut, table
from tallylake.llm.queries import WORD_BPE, tokenizer_path
from tallylake.session import shared_dir

LEAST_TAIL = 0.5
LEAST_SCORE = 0.4


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return _decided(docs, quality.score(docs.select(F.col("text").alias("text"), F.struct("*").alias("_row")), model, LEAST_TAIL), F.col("keep"))


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    net = langid.train(docs)
    if net is None:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    guessed = langid.predict(docs.select(F.col("text").alias("text"), F.struct("*").alias("_row")), net)
    return _decided(docs, guessed, (F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_SCORE))


def _decided(docs: DataFrame, judged: DataFrame, keep) -> DataFrame:
    return judged.where(keep).select(*[F.col(f"_row.`{c}`").alias(c) for c in docs.columns])


def delete_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    cleaned = linededup.dedup_lines(docs)
    return cleaned.where("n_removed = 0 or length(trim(text)) > 0").select(*docs.columns)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    own_id, words = F.col("doc_id").cast("long"), F.coalesce(F.col("text"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    grouped, alone = docs.where(own_id.isNotNull() & words), docs.where(own_id.isNull() | ~words)
    hashes = grouped.select(own_id.alias("_id"), F.xxhash64("text").alias("_hash"))
    if hashes.groupBy("_id").agg(F.min("_hash").alias("lo"), F.max("_hash").alias("hi")).where("lo <> hi").isEmpty():
        found = jaccard.jaccard_components(grouped)
        firsts = found.where("component_id = doc_id").select(F.col("doc_id").alias("_first")).distinct()
        once = F.row_number().over(Window.partitionBy("doc_id").orderBy("text"))
        kept = grouped.join(firsts, own_id == F.col("_first"), "left_semi").withColumn("_copy", once).where("_copy = 1")
        return kept.select(*docs.columns).unionByName(alone)
    # ids name several texts: rows are numbered, and compared by their numbers
    numbered = cut(grouped.withColumn("_row", F.monotonically_increasing_id()))
    found = jaccard.jaccard_components(numbered.select(F.col("_row").alias("doc_id"), "text"))
    least = F.min(F.struct(F.col("_id"), F.col("_row"))).alias("_least")
    firsts = (
        found.select(F.col("doc_id").alias("_row"), "component_id").join(numbered.select("_row", own_id.alias("_id")), "_row")
        .groupBy("component_id").agg(least).select("_least._row")
    )
    return numbered.join(firsts, "_row", "left_semi").select(*docs.columns).unionByName(alone)


def pack_into_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, tokenizer_path(WORD_BPE))


STAGES = [
    ("quality", keep_good),
    ("language", keep_known_languages),
    ("lines", delete_repeated_lines),
    ("near_duplicates", keep_one_of_each_group),
    ("packing", pack_into_sequences),
]

# the classifiers are trained models, which SQL can't express
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = shared_dir(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
