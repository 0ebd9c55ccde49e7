"""Operator 8: chat formatting by prefix-target expansion, in DataFrame functions only.

A turn is written as ``<turn role>`` newline, its text, ``</turn>`` newline. Inside roles and texts
a backslash, ``<`` and ``>`` are written as backslash and b, l or g, so no text can hold a mark and
every text comes back as it was. ``format_conversations`` gives a row per conversation with its
whole formatted text and a row's worth of spans per assistant turn: the example of a turn is the
prefix before it (its context) and the turn's own text (the target, the only part under the loss
mask). Spans keep the output in proportion to the input, where written-out prefixes would grow with
the square of a conversation's length; ``expand`` writes them out for a trainer, one at a time and never
through a shuffle; ``conversation_digest`` checks the spans by running sums instead.

Rows: turns go by number, ties by role and text; repeated rows are turns of their own; a null text
or role is an empty one; a row without a conversation id is a conversation of its own, so that such
rows never meet; a conversation without assistant turns has no examples; very long texts are taken
whole; other columns are ignored; an empty table gives no rows. A conversation is one record, so its
turns meet in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPEN, MID, CLOSE = "<turn ", ">\n", "</turn>\n"


def escape(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("\\"), F.lit("\\b")), F.lit("<"), F.lit("\\l")), F.lit(">"), F.lit("\\g"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("\\l"), F.lit("<")), F.lit("\\g"), F.lit(">")), F.lit("\\b"), F.lit("\\"))


def format_conversations(turns: DataFrame, target_role: str = "assistant") -> DataFrame:
    """(conv_id, lone, n_turns, formatted, examples), examples: array of (turn, context_chars, target_chars).

    ``lone`` tells conversations without an id apart and is null for others. ``turn`` counts from 0; an example's context is the first ``context_chars`` characters of
    ``formatted``, its target the ``target_chars`` after them.
    """
    text, role = escape(F.coalesce("text", F.lit(""))), escape(F.coalesce("role", F.lit("")))
    lone = F.when(F.col("conv_id").isNull(), F.monotonically_increasing_id()).alias("lone")
    rows = turns.select("conv_id", lone, "turn", F.coalesce("role", F.lit("")).alias("r"), F.coalesce("text", F.lit("")).alias("x"), F.concat(F.lit(OPEN), role, F.lit(MID)).alias("head"), text.alias("body"))
    order = Window.partitionBy("conv_id", "lone").orderBy("turn", "r", "x")
    size = F.length("head") + F.length("body") + len(CLOSE)
    rows = rows.withColumns({"at": F.row_number().over(order) - 1, "end": F.sum(size.cast("long")).over(order.rowsBetween(Window.unboundedPreceding, 0))})
    begin = F.col("end") - len(CLOSE) - F.length("body")
    example = F.when(F.col("r") == target_role, F.struct(F.col("at").alias("turn"), begin.alias("context_chars"), F.length("body").cast("long").alias("target_chars")))
    grouped = rows.groupBy("conv_id", "lone").agg(F.sort_array(F.collect_list(F.struct("at", F.concat("head", "body", F.lit(CLOSE)).alias("piece")))).alias("p"), F.sort_array(F.collect_list(example)).alias("examples"))
    return grouped.select("conv_id", "lone", F.size("p").cast("long").alias("n_turns"), F.array_join(F.col("p.piece"), "").alias("formatted"), "examples")


def expand(formatted: DataFrame, *kept: str, every: bool = False) -> DataFrame:
    """One row per example: (conv_id, kept columns, turn, prompt, target), both as they stand in the formatted text.

    With ``every``, a conversation without examples has one row, its turn, prompt and target null.
    An example whose span isn't the turn it names fails the job: the prompt must hold as many whole
    turns as precede it and end with the head of a turn, and the target must end where its turn does.
    """
    rows = formatted.select("conv_id", *kept, "formatted", (F.explode_outer if every else F.explode)("examples").alias("e"))
    begin, size = F.col("e.context_chars").cast("int"), F.col("e.target_chars").cast("int")
    rows = rows.select("conv_id", *kept, F.col("e.turn").alias("turn"), F.substring("formatted", F.lit(1), begin).alias("prompt"), F.substring("formatted", begin + 1, size).alias("target"), F.substring("formatted", begin + size + 1, F.lit(len(CLOSE))).alias("after"))
    before = F.substring_index("prompt", CLOSE, -1)  # what follows the last whole turn
    whole = (F.length("prompt") - F.length(F.replace("prompt", F.lit(CLOSE), F.lit("")))) / len(CLOSE)
    right = (whole == F.col("turn")) & before.startswith(OPEN) & before.endswith(MID) & (F.instr(before, MID) == F.length(before) - len(MID) + 1) & ~F.contains("target", F.lit("<")) & (F.col("after") == CLOSE)
    wrong = F.raise_error(F.concat(F.lit("the span of an example isn't its turn: conversation "), F.coalesce(F.col("conv_id").cast("string"), F.lit("null")), F.lit(", turn "), F.col("turn").cast("string")))
    return rows.select("conv_id", *kept, "turn", "prompt", F.when(F.col("turn").isNull() | right, F.col("target")).otherwise(wrong.cast("string")).alias("target"))


def parse(formatted: Column) -> Column:
    """The turns of a formatted text again: array of (role, text, raw), raw being the text as it stands there."""
    pieces = F.slice(F.split(formatted, CLOSE), 1, F.greatest(F.size(F.split(formatted, CLOSE)) - 1, F.lit(0)))
    head = lambda p: F.substring_index(p, MID, 1)
    raw = lambda p: F.substr(p, F.length(head(p)) + len(MID) + 1)
    return F.transform(pieces, lambda p: F.struct(unescape(F.substr(head(p), F.lit(len(OPEN) + 1))).alias("role"), unescape(raw(p)).alias("text"), raw(p).alias("raw")))


def conversation_digest(formatted: DataFrame, target_role: str = "assistant") -> DataFrame:
    """What the output says, read back: turns from the formatted text, loss from the turns that the examples' spans cover.

    The spans are checked against running sums over the turns as they stand in the text, once for a conversation, so its
    work grows with its length and not with that of its prefixes. A span that isn't a target turn's text, a target turn without an example or one
    with two fail the job.
    """
    turns = parse(F.col("formatted"))
    spoken = F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    long, none = (lambda c: c.cast("long")), F.lit(None)
    # a row for the conversation, one for each turn, one for each example right after its turn
    row = lambda at, kind, size=none, raw=none, role=none, text=none, begin=none, chars=none, sha=none, total=none: F.struct(
        long(at).alias("at"), kind.alias("kind"), long(size).alias("size"), long(raw).alias("raw"), role.cast("string").alias("role"), text.cast("string").alias("text"), long(begin).alias("begin"), long(chars).alias("chars"), sha.cast("string").alias("sha"), long(total).alias("total"))
    head = row(F.lit(-1), F.lit(0), sha=F.sha2(spoken, 256), total=F.length("formatted"))
    of_turn = lambda t, i: row(i, F.lit(1), F.length(escape(t["role"])) + F.length(t["raw"]) + len(OPEN + MID + CLOSE), F.length(t["raw"]), t["role"], t["text"])
    of_example = lambda e: row(e["turn"], F.lit(2), begin=e["context_chars"], chars=e["target_chars"])
    every = F.concat(F.array(head), F.transform(turns, of_turn), F.transform("examples", of_example))
    rows = formatted.select("conv_id", "lone", "n_turns", F.explode(every).alias("e")).select("conv_id", "lone", "n_turns", "e.*")
    order = Window.partitionBy("conv_id", "lone").orderBy("at", "kind")
    before = lambda c: F.lag(c).over(order)
    rows = rows.select("*", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("end"), *[before(c).alias(f"b_{c}") for c in ("kind", "at", "raw", "role", "text")])
    right = (F.col("b_kind") == 1) & (F.col("b_at") == F.col("at")) & (F.col("b_role") == target_role) & (F.col("chars") == F.col("b_raw")) & (F.col("begin") == F.col("end") - len(CLOSE) - F.col("b_raw"))
    wrong = F.raise_error(F.concat(F.lit("the span of an example isn't its turn: conversation "), F.coalesce(F.col("conv_id").cast("string"), F.lit("null")), F.lit(", turn "), F.col("at").cast("string")))
    said = F.when(F.col("kind") == 2, F.struct("at", F.when(F.coalesce(right, F.lit(False)), F.col("b_text")).otherwise(wrong.cast("string")).alias("text")))
    due = F.count(F.when((F.col("kind") == 1) & (F.col("role") == target_role), 1))
    found = rows.select("*", said.alias("said")).groupBy("conv_id", "lone").agg(F.max("n_turns").alias("n_turns"), F.max("sha").alias("turns_sha256"), F.max("total").alias("formatted_chars"), due.alias("due"), F.sort_array(F.collect_list("said")).alias("x"))
    # each target turn is an example, once
    texts = F.when((F.size("x") == F.col("due")) & (F.size(F.array_distinct("x.at")) == F.col("due")), F.col("x.text"))
    texts = F.coalesce(texts, F.raise_error(F.lit("a conversation's examples aren't its target turns")).cast("array<string>"))
    rows = found.select("conv_id", "n_turns", "turns_sha256", F.array_join(texts, "").alias("loss"), "formatted_chars")
    return rows.select("conv_id", "n_turns", "turns_sha256", F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")
