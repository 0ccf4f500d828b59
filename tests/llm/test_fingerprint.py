from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from tallylake.llm import fingerprint
from tests.llm.helpers import documents


def prints(spark, *texts):
    rows = fingerprint.fingerprints(documents(spark, list(texts))).withColumn("hex", fingerprint.as_text(F.col("fingerprint")))
    return [r["hex"] for r in rows.orderBy("doc_id").collect()]


def test_order_free_equality_and_multiplicity(spark):
    a, b, c, d, e, empty, null = prints(spark, "one two\nthree", "three\none two", "three\nthree\none two", "one two\nthre", "one two", "", None)
    assert a == b and len({a, c, d, e}) == 4 and empty == null
    assert int(empty, 16) == 0


def test_insert_and_delete_are_inverse(spark):
    row = documents(spark, ["p q r s t\nu v w."]).select(fingerprint.vector(F.col("text")).alias("f"))
    grown = fingerprint.insert(F.col("f"), F.lit("new paragraph, of words"))
    got = row.select(
        (fingerprint.as_text(fingerprint.delete(grown, F.lit("new paragraph, of words"))) == fingerprint.as_text(F.col("f"))).alias("back"),
        (fingerprint.as_text(grown) == fingerprint.as_text(fingerprint.vector(F.lit("u v w.\nnew paragraph, of words\np q r s t")))).alias("same"),
    ).first()
    assert got["back"] and got["same"]


def test_edits_against_plain_python(spark):
    texts = {5: "a b c d e f g h. " * 30, 2: "x y z\n" * 40, 9: "short", 11: "", 12: None, 20: "é\U0001F600" * 50, 30: "last one, " * 200}
    got = {r["doc_id"]: r for r in fingerprint.compare_with_edits(documents(spark, list(texts.items()))).collect()}
    ids = sorted(texts)
    for k, i in enumerate(ids):
        text, after = texts[i] or "", texts[ids[(k + 1) % len(ids)]] or ""
        n = len(text) // 4
        edited = text[:len(text) - n] + after[:n]
        assert got[i]["n_chars"] == len(text)
        assert got[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert (got[i]["fingerprint"] == got[i]["edited_fingerprint"]) == (edited == text)
        assert 0 <= got[i]["near_next"] <= 1 and 0 <= got[i]["near_edited"] <= 1


def test_likeness_tells_edits_from_strangers(spark):
    import random

    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    texts = [" ".join(word() + ("." if rng.random() < 0.2 else "") for _ in range(300)) for _ in range(12)]
    for row in fingerprint.compare_with_edits(documents(spark, texts)).collect():
        assert row["near_edited"] > 0.55 and row["near_next"] < 0.3


def test_single_null_ids_repeats_and_empty(spark):
    one = fingerprint.compare_with_edits(documents(spark, ["abcdefgh"])).first()
    assert one["edited_sha256"] == hashlib.sha256(b"abcdefab").hexdigest()
    rows = fingerprint.compare_with_edits(documents(spark, [(None, "aaaaaaaa"), (3, "bbbbbbbb"), (3, "bbbbbbbb")])).collect()
    assert sorted((r["doc_id"] is None, r["edited_sha256"]) for r in rows) == sorted(
        [(True, hashlib.sha256(b"aaaaaabb").hexdigest())] + [(False, hashlib.sha256(b"bbbbbbaa").hexdigest())] * 2)
    assert fingerprint.compare_with_edits(documents(spark, [])).count() == 0


def test_a_phrase_repeated_very_often(spark):
    got = fingerprint.compare_with_edits(documents(spark, ["lorem ipsum dolor sit amet. " * 20_000, "other words of the next document. " * 30])).orderBy("doc_id").first()
    assert got["near_edited"] > 0.9 and got["near_next"] < 0.3


def test_values_against_plain_python(spark):
    """Sums of the hashes that Spark gives for paragraphs and pieces, lane by lane."""
    import re

    text = "a b c, d e f g h i j k l m n\nsecond line. second line\n\na b c"
    paragraphs = [p for p in text.split("\n") if p]
    pieces = re.findall(r"[a-z]+(?: [a-z]+){0,7}", text)
    hashed = lambda x, k: spark.sql(f"SELECT xxhash64('{x}', {k})").first()[0] & (1 << 64) - 1
    identity = [sum((sum((hashed(p, k) >> s) & 0x3FFF for p in paragraphs) & 0x3FFF) << s for s in (0, 15, 30, 45)) for k in range(fingerprint.IDENTITY)]
    likeness = [
        sum(sum((hashed(p, 100 + k) >> (bit + s)) & 1 for p in pieces) << s for s in (0, 31))
        for k in range(fingerprint.HASHES) for bit in range(fingerprint.BITS)]
    row = documents(spark, [text]).select(fingerprint.vector(F.col("text")).alias("f")).first()["f"]
    assert (row["identity"], row["likeness"], row["pieces"]) == (identity, likeness, len(pieces))
