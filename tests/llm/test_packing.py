from __future__ import annotations

import random
import zlib
from collections import Counter

import numpy as np
import pytest

from tallylake.llm.packing import pack_documents, plan_runs
from tallylake.llm.queries import WORD_BPE, tokenizer_path
from tests.llm.helpers import best_fit_rooms, documents

ODD = [
    "", None, "  \n ", "Hello, World! don't we'll I'M", "ΣΑΣ ΌΣΟΣ Σ", "İstanbul ǅ ﬁ Ω Å é é", "<|endoftext|> a<|startoftext|>b",
    "x\x1cy\x1f z", "a b c　d\x85e", "中文字符，测试。 日本語", "123 4.5% ½ ² ①", "🙂🙂 !!! ... ,,, 'S 'll", "word." * 3, "A" * 300,
    "naïve, façade; über: Straße?", "tab\tnew\r\nline", "क्षि त्र", "́ alone",
]


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path(WORD_BPE))


@pytest.mark.parametrize("seed", range(12))
def test_plan_is_best_fit_decreasing(seed):
    rng = random.Random(seed)
    capacity = rng.choice([10, 37, 2048])
    lengths = [rng.randint(1, rng.choice([capacity, capacity // 3 + 1])) for _ in range(rng.randint(0, 300))]
    used = Counter()
    runs = plan_runs(dict(Counter(lengths)), capacity)
    for length, count in Counter(lengths).items():
        own = [r for r in runs if r[0] == length]
        for rank in range(count):
            _, first, sequence, each, _ = max(r for r in own if r[1] <= rank)
            used[sequence + (rank - first) // each] += length
    assert sorted(capacity - u for u in used.values()) == best_fit_rooms(lengths, capacity)


def test_pieces_hold_the_tokenizers_ids(spark, tokenizer):
    texts = [*ODD, "lorem ipsum dolor " * 900]
    got = pack_documents(documents(spark, texts), tokenizer_path(WORD_BPE)).toPandas()
    for doc_id, rows in got.groupby("doc_id"):
        ids = np.array([*tokenizer.encode(texts[doc_id] or "", add_special_tokens=False).ids, 0], dtype="<u4")
        rows = rows.sort_values("piece")
        assert list(rows["start"]) == list(range(0, len(ids), 2048)) and rows["length"].sum() == len(ids)
        for row in rows.itertuples():
            assert row.ids_crc32 == zlib.crc32(ids[row.start:row.start + row.length].tobytes()), texts[doc_id]
    assert set(got["doc_id"]) == set(range(len(texts)))
    _check_sequences(got)


def _check_sequences(got):
    for _, rows in got.groupby("sequence_id"):
        rows = rows.sort_values("offset")
        assert list(rows["offset"]) == [0, *np.cumsum(rows["length"])[:-1]] and rows["length"].sum() <= 2048
    full = Counter(got["length"])
    assert got["sequence_id"].nunique() == len(best_fit_rooms(list(full.elements()), 2048))


def test_one_length_for_most_documents_repeats_and_null_ids(spark):
    texts = [(i, "same text here") for i in range(300)] + [(7, "again"), (7, "again"), (None, "no id"), (301, "word " * 5000)]
    got = pack_documents(documents(spark, texts), tokenizer_path(WORD_BPE)).toPandas()
    assert len(got) == 303 + 3 and got["doc_id"].isna().sum() == 1
    _check_sequences(got)


def test_empty_table_and_clashing_columns(spark):
    from pyspark.sql import functions as F

    docs = documents(spark, ["a"]).withColumn("length", F.lit("x")).withColumn("sequence_id", F.lit(1))
    assert pack_documents(docs, tokenizer_path(WORD_BPE)).count() == 1
    assert pack_documents(docs.limit(0), tokenizer_path(WORD_BPE)).count() == 0


def test_kept_chunks_outlive_a_full_table_and_words_skip_the_tokenizer(tokenizer, monkeypatch):
    from tallylake.llm import tokens

    rng = random.Random(4)
    letters = "aabcdeeflnorstuyzABÉéèçßøŁžÿµªŉǅȺ"
    marks = ["", ",", ".", "&&&", "'s", "'", "!?)", "###.", "_", "<|endoftext|>", "|>", "2", "́", "-x"]
    often = ["the", "And,", "naïve", "ÉTÉ;"]
    texts = [" ".join(
        rng.choice(often) if rng.random() < 0.3 else "".join(rng.choice(letters) for _ in range(rng.randint(1, 9))) + rng.choice(marks)
        for _ in range(40)) for _ in range(200)]
    monkeypatch.setattr(tokens, "MOST_KEPT", 1 << 16)
    coder = tokens.WordIds(tokenizer_path(WORD_BPE))
    made, make = Counter(), coder.chunks.make
    coder.chunks.make = lambda chunk: (made.update([chunk]), make(chunk))[1]
    for at in range(0, len(texts), 10):
        part = texts[at:at + 10]
        for text, ids in zip(part, coder.encode_batch(part), strict=True):
            assert ids.tolist() == tokenizer.encode(text, add_special_tokens=False).ids, text
    assert len(coder.chunks) + len(coder.chunks.rest) < len(made)
    assert all(made[chunk] == 1 for chunk in often)
