from __future__ import annotations

import hashlib

import pytest

from tallylake.llm import chat
from tallylake.llm.queries import CONTROL_TEXT, with_control_conversation

SCHEMA = "conv_id long, turn long, role string, text string, formatted string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def run(spark, rows):
    turns = spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA)
    return {r["conv_id"]: r for r in chat.digest(chat.format_conversations(turns)).collect()}


@pytest.mark.parametrize("texts", [
    [("user", "hi"), ("assistant", "yo")],
    [("assistant", "a"), ("assistant", "b"), ("user", "c"), ("assistant", "")],
    [("user", None), ("assistant", "\\### </turn> \\e\\h\\b #####"), ("system", "### user: x</turn>\n### ")],
    [("a: b\nc\\", "x: y"), (None, "null role"), ("assistant", "é\U0001F600\n")],
])
def test_reads_back_what_went_in(spark, texts):
    got = run(spark, [(1, i, role, text) for i, (role, text) in enumerate(texts)])[1]
    assert got["n_turns"] == len(texts)
    assert got["turns_sha256"] == sha("".join(f"{role or ''}\n{text or ''}\n" for role, text in texts))
    loss = "".join(text or "" for role, text in texts if role == "assistant")
    assert (got["loss_chars"], got["loss_sha256"]) == (len(loss), sha(loss))


def test_template_merges_adjacent_turns_of_a_role(spark):
    turns = spark.createDataFrame([(1, 0, "user", "a", ""), (1, 1, "user", "b", ""), (1, 2, "assistant", "c", "")], SCHEMA)
    row = chat.format_conversations(turns).first()
    assert row["formatted"] == "### user: a</turn>b</turn>\n### assistant: c</turn>\n"
    assert [row["formatted"][s["start"]:s["start"] + s["length"]] for s in row["loss_spans"]] == ["c"]


def test_ties_repeats_nulls_and_empty(spark):
    rows = [(1, 0, "user", "b"), (1, 0, "user", "a"), (1, 0, "user", "a"), (None, None, "assistant", "x"), (None, 1, "user", None)]
    got = run(spark, rows)
    assert got[1]["turns_sha256"] == sha("user\na\nuser\na\nuser\nb\n")
    assert got[None]["turns_sha256"] == sha("assistant\nx\nuser\n\n")
    assert chat.format_conversations(spark.createDataFrame([], SCHEMA)).count() == 0


def test_long_conversation(spark):
    rows = [(1, i, "user" if i % 3 else "assistant", f"t{i}") for i in range(600)]
    got = run(spark, rows)[1]
    assert got["n_turns"] == 600 and got["loss_sha256"] == sha("".join(f"t{i}" for i in range(0, 600, 3)))


def test_control_conversation_is_added(spark):
    turns = with_control_conversation(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))
    row = chat.digest(chat.format_conversations(turns)).first()
    assert row["conv_id"] == -7 and row["loss_sha256"] == sha(CONTROL_TEXT) and row["n_turns"] == 2
