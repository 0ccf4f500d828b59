"""Chat formatting: one marked string per conversation, with the spans that count for the loss.

Template, for adjacent turns of one role after another::

    ### role: text</turn>text</turn>
    ### role: text</turn>

A header opens each run of turns of one role and ``</turn>`` ends every turn, so merged turns stay apart when read back.
Inside texts a backslash becomes ``\\b``, ``###`` becomes ``\\h`` and ``</turn>`` becomes ``\\e``; in roles also ``:`` becomes ``\\c``
and a line break ``\\n``. After that every backslash starts an escape, so the reverse is exact.

Defined cases: a null text is empty; a null role is written ``\\0`` and comes back null; turns sort by (turn, role, text), nulls
first, so ties and repeated rows give one fixed result; a null ``conv_id`` is a conversation of its own; an empty table gives no
rows; other columns are ignored. One conversation becomes one row, so it has to fit one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HEAD, STOP = "### ", "</turn>"


def escape(text: Column) -> Column:
    for plain, code in (("\\", "\\b"), ("###", "\\h"), (STOP, "\\e")):
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescape(text: Column) -> Column:
    for plain, code in ((STOP, "\\e"), ("###", "\\h"), ("\\", "\\b")):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def _role_out(role: Column) -> Column:
    text = F.replace(F.replace(escape(role), F.lit(":"), F.lit("\\c")), F.lit("\n"), F.lit("\\n"))
    return F.coalesce(text, F.lit("\\0"))


def _role_in(text: Column) -> Column:
    plain = unescape(F.replace(F.replace(text, F.lit("\\n"), F.lit("\n")), F.lit("\\c"), F.lit(":")))
    return F.when(text != "\\0", plain)


def format_conversations(turns: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """(conv_id, turn, role, text) -> (conv_id, formatted, loss_spans: array of (start, length) in code points from 0)."""
    rows = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct(
        "turn", "role", F.coalesce(F.col("text"), F.lit("")).alias("text")))).alias("turns"))
    at = lambda i: F.get("turns", i)
    starts = F.filter(F.sequence(F.lit(0), F.size("turns") - 1), lambda i: (i == 0) | ~at(i)["role"].eqNullSafe(at(i - 1)["role"]))
    rows = rows.withColumn("starts", starts)
    runs = F.transform("starts", lambda start, k: F.struct(
        at(start)["role"].alias("role"),
        F.transform(
            F.slice("turns", start + 1, F.coalesce(F.get("starts", k + 1), F.size("turns")) - start),
            lambda turn: escape(turn["text"]),
        ).alias("texts"),
    ))
    rows = rows.withColumn("runs", runs)
    heads = F.transform("runs", lambda run: F.struct(
        F.concat(F.lit(HEAD), _role_out(run["role"]), F.lit(": ")).alias("head"), run["texts"].alias("texts"),
        run["role"].eqNullSafe(F.lit(loss_role)).alias("loss")))
    rows = rows.select("conv_id", heads.alias("runs"))
    body = F.array_join(F.transform("runs", lambda run: F.concat(
        run["head"], F.array_join(F.transform(run["texts"], lambda text: F.concat(text, F.lit(STOP))), ""), F.lit("\n"))), "")
    spans = F.aggregate(
        "runs",
        F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<start: int, length: int>>)").alias("spans")),
        _walk_run,
        lambda state: state["spans"],
    )
    return rows.select("conv_id", body.alias("formatted"), spans.alias("loss_spans"))


def _walk_run(state: Column, run: Column) -> Column:
    begin = F.struct((state["at"] + F.length(run["head"])).alias("at"), state["spans"].alias("spans"))
    done = F.aggregate(run["texts"], begin, lambda inner, text: F.struct(
        (inner["at"] + F.length(text) + len(STOP)).alias("at"),
        F.when(run["loss"], F.concat(inner["spans"], F.array(F.struct(
            inner["at"].alias("start"), F.length(text).alias("length"))))).otherwise(inner["spans"]).alias("spans")))
    return F.struct((done["at"] + 1).alias("at"), done["spans"].alias("spans"))


def read_back(formatted: Column) -> Column:
    """The turns of a formatted conversation: array of (role, text)."""
    runs = F.filter(F.split(formatted, "### "), lambda run: run != "")
    return F.flatten(F.transform(runs, lambda run: F.transform(
        _texts_of(run), lambda text: F.struct(_role_in(F.substring_index(run, ": ", 1)).alias("role"), unescape(text).alias("text")))))


def _texts_of(run: Column) -> Column:
    body = F.substring(run, F.length(F.substring_index(run, ": ", 1)) + 3, F.length(run))
    parts = F.split(body, STOP)
    return F.slice(parts, 1, F.size(parts) - 1)


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss spans, escapes undone, nothing between."""
    return F.array_join(F.transform(spans, lambda span: unescape(F.substring(formatted, span["start"] + 1, span["length"]))), "")


def digest(formatted: DataFrame) -> DataFrame:
    """Per formatted conversation the figures that are read back from the string and its spans."""
    turns = read_back(F.col("formatted"))
    loss = loss_text(F.col("formatted"), F.col("loss_spans"))
    return formatted.select("conv_id", "formatted", turns.alias("turns"), loss.alias("loss")).select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda turn: F.concat(
            F.coalesce(turn["role"], F.lit("")), F.lit("\n"), turn["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
