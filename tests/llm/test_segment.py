from __future__ import annotations

from collections import Counter

import numpy as np
import pytest

from tallylake.llm import segment
from tallylake.llm.lattice import Vocabulary
from tallylake.llm.queries import PIECE_BPE, tokenizer_path
from tests.llm.helpers import documents

TEXTS = ["", None, "a", "the cat sat.", " two  blanks ", "▁ mark ▁▁", "line\n\nbreak\r\n", "\U0001F600é中\x00", "x" * 3000, "word " * 400]


@pytest.fixture(scope="module")
def vocabulary():
    return Vocabulary(tokenizer_path(PIECE_BPE), temperature=3.0)


def all_segmentations(vocabulary, text):
    """{ids: probability} of every way to write a short text."""
    whole = "▁" + text.replace(" ", "▁")
    weight = {vocabulary_piece: i for vocabulary_piece, i in _pieces(vocabulary).items()}
    ways = {0: [((), 0.0)]}
    for end in range(1, len(whole) + 1):
        ways[end] = [
            ((*ids, weight[whole[start:end]]), logp + vocabulary.logp[weight[whole[start:end]]])
            for start in range(end) if whole[start:end] in weight for ids, logp in ways[start]]
    total = np.exp([logp for _, logp in ways[len(whole)]]).sum()
    return {ids: float(np.exp(logp) / total) for ids, logp in ways[len(whole)]}


def _pieces(vocabulary):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path(PIECE_BPE))
    return {model.id_to_piece(i): i for i in range(259, vocabulary.size)}


def test_samples_follow_the_distribution_without_replacement(vocabulary):
    share = all_segmentations(vocabulary, "here")
    n = 6000
    first, second = Counter(), Counter()
    for start in range(0, n, 1000):
        for rows in segment.Segmenter(vocabulary, 2, 1)(list(range(start, start + 1000)), ["here"] * 1000):
            first[tuple(rows[0][0].tolist())] += 1
            second[tuple(rows[1][0].tolist())] += 1
            assert rows[0][2] >= rows[1][2]
    for ids, p in share.items():
        want = sum(q * p / (1 - q) for other, q in share.items() if other != ids)
        assert abs(first[ids] / n - p) < 4 * (p * (1 - p) / n) ** 0.5 + 1e-4
        assert abs(second[ids] / n - want) < 4 * (want * (1 - want) / n) ** 0.5 + 1e-4


def test_gives_every_segmentation_when_there_are_fewer(vocabulary):
    share = all_segmentations(vocabulary, "hat")
    rows = segment.Segmenter(vocabulary, 1000, 4)([7], ["hat"])[0]
    assert {tuple(r[0].tolist()) for r in rows} == set(share) and len(rows) == len(share)
    for ids, logp, _, inclusion in rows:
        assert abs(np.exp(logp) - share[tuple(ids.tolist())]) < 1e-5 and inclusion == 1.0


def test_inclusion_scores_are_unbiased(vocabulary):
    """Horvitz-Thompson: the sum of p / inclusion over a sample has the mean 1."""
    sums = [sum(np.exp(logp) / inclusion for _, logp, _, inclusion in rows)
            for rows in segment.Segmenter(vocabulary, 3, 2)(list(range(3000)), ["there"] * 3000)]
    assert abs(np.mean(sums) - 1) < 0.05


def test_round_trip_and_distinct(spark, vocabulary):
    docs = documents(spark, [*enumerate(TEXTS), (None, "no id"), (4, " two  blanks ")])
    samples = segment.sample_segmentations(docs, tokenizer_path(PIECE_BPE), k=3, temperature=2.0)
    for row in segment.decode(samples, tokenizer_path(PIECE_BPE)).collect():
        want = "no id" if row["doc_id"] is None else TEXTS[row["doc_id"]] or ""
        assert row["text"] == want and 0 < row["inclusion"] <= 1 and row["log_prob"] <= 1e-6
    got = samples.where("doc_id <> 4").toPandas()
    assert not got.assign(ids=got["ids"].map(tuple)).duplicated(["doc_id", "ids"]).any()
    # texts 0 and 1 have no pieces, in 7 no two characters make up a piece, and 2 is one letter
    assert len(all_segmentations(vocabulary, "a")) == 2
    assert got.groupby("doc_id").size().to_dict() == {0: 1, 1: 1, 2: 2, 3: 3, 5: 3, 6: 3, 7: 1, 8: 3, 9: 3}
    digests = segment.segmentation_digests(docs, tokenizer_path(PIECE_BPE)).collect()
    assert all(r["decoded_same"] for r in digests)
    assert segment.sample_segmentations(docs.limit(0), tokenizer_path(PIECE_BPE)).count() == 0


def test_results_depend_on_row_key_and_text_alone(vocabulary):
    texts = ["alpha beta", "gamma delta\nmore", "alpha beta"]
    run = segment.Segmenter(vocabulary, 2, 3)
    together, alone = run([1, 2, 3], texts), [run([k], [t])[0] for k, t in zip((1, 2, 3), texts, strict=True)]
    key = lambda rows: [(r[0].tolist(), r[2]) for r in rows]
    assert [key(r) for r in together] == [key(r) for r in alone] and key(together[0]) != key(together[2])
