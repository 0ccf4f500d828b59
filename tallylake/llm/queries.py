"""The registered queries of this package, each its operator over its whole table, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallylake.llm import ann, chat, fingerprint, jaccard, langid, lexical, linededup, packing, quality, segment, sharding, warc, whitening
from tallylake.llm.common import table

WORD_BPE, PIECE_BPE = "word_bpe_49k.json", "piece_bpe_32k.model"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(run):
        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql
        return run

    return register


CONTROL_TEXT = "\\### Assistant: </turn> ok"

CHAT_SQL = r"""
WITH turns AS (
    SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
    UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), marked AS (
    SELECT *, lag(role) OVER w IS DISTINCT FROM role OR row_number() OVER w = 1 AS opens,
        length(replace(replace(replace(text, '\', '\b'), '###', '\h'), '</turn>', '\e')) AS shown
    FROM turns WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text)
)
SELECT conv_id, count(*) AS n_turns,
    sha256(string_agg(coalesce(role, '') || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role NULLS FIRST, text)) AS turns_sha256,
    CAST(coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) END), 0) AS BIGINT) AS loss_chars,
    sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn NULLS FIRST, role NULLS FIRST, text), '')) AS loss_sha256,
    CAST(sum(shown + 7 + CASE WHEN opens THEN 7 + coalesce(length(role), 2) ELSE 0 END) AS BIGINT) AS formatted_chars
FROM marked GROUP BY conv_id
"""


def with_control_conversation(turns: DataFrame) -> DataFrame:
    """The conversations plus number -7, whose texts hold every control string of the template."""
    own = turns.sparkSession.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(CONTROL_TEXT).alias("text"))
    return turns.select("conv_id", "turn", "role", "text").unionByName(own)


@query("op1_chat_formatting", CHAT_SQL)
def chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.digest(chat.format_conversations(with_control_conversation(table(spark, sf_dir, "conversations"))))


@query("op2_quality_classifier")
def quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op3_nearest_neighbours")
def nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"))


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op4_sampled_segmentation")
def sampled_segmentation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment.segmentation_digests(table(spark, sf_dir, "documents"), tokenizer_path(PIECE_BPE))


@query("op5_line_dedup")
def line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query("op6_best_fit_packing")
def best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path(WORD_BPE))


@query("op7_document_fingerprints")
def document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.compare_with_edits(table(spark, sf_dir, "documents"))


@query("op8_sharding")
def sharded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.digest(sharding.external_shuffle(table(spark, sf_dir, "documents")))


@query("op9_jaccard_join")
def jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(table(spark, sf_dir, "documents"))


@query("op10_language_id")
def language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


@query("op11_embedding_whitening")
def embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


WARC_SQL = """
WITH stored AS (
    SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
), marked AS (
    SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest) END AS last FROM stored
)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
    CASE WHEN last IS NULL OR page_id IS NOT DISTINCT FROM last THEN 'response' ELSE 'revisit' END AS record_type,
    CASE WHEN last IS NOT NULL AND page_id IS DISTINCT FROM last THEN last END AS refers_to
FROM marked
"""


@query("op12_warc", WARC_SQL)
def warc_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.written_and_read(table(spark, sf_dir, "pages"))


LEXICAL_SQL = r"""
WITH docs AS (
    SELECT row_number() OVER () AS r, doc_id,
        regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
    FROM documents
), totals AS (
    SELECT count(*) AS n_docs, CAST(sum(len(terms)) AS BIGINT) AS n_terms FROM docs WHERE len(terms) > 0
), tf AS (
    SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(terms) AS term FROM docs) GROUP BY r, term
), weights AS (
    SELECT term, CAST(floor(1000 * ln((2 * any_value(n_docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, totals GROUP BY term
), items AS (
    SELECT row_number() OVER () AS i, item_id,
        list_distinct(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS terms
    FROM benchmark
), scored AS (
    SELECT i, any_value(item_id) AS item_id, r, any_value(doc_id) AS doc_id,
        CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + ((90 * len(docs.terms) * n_docs) // n_terms))))) AS BIGINT) AS score
    FROM (SELECT i, item_id, unnest(terms) AS term FROM items) JOIN tf USING (term) JOIN weights USING (term) JOIN docs USING (r), totals GROUP BY i, r
), ranked AS (
    SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM scored WHERE score > 0
)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranked WHERE rank <= 10
"""


@query("op13_lexical_search", LEXICAL_SQL)
def lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
