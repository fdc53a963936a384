"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all preceding turns as context, and only that reply under
the loss mask. The template marks a turn as ``<|im_start|>role\\n text <|im_end|>\\n``; control strings inside a
text are escaped by adding one backslash inside every ``<``, backslashes, ``|`` sequence, which one regular
expression undoes, so no text can open or close a turn."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\\\|", r"<$1|")


def escape_role(role: Column) -> Column:
    """A role ends at the first newline, so backslashes and newlines in it are escaped as well."""
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def unescape_role(role: Column) -> Column:
    # placeholders are not needed: a newline is written as an odd backslash run before "n", and undone left to right
    parts = F.split(unescape(role), r"\\\\", -1)
    return F.array_join(F.transform(parts, lambda p: F.replace(p, F.lit("\\n"), F.lit("\n"))), "\\")


def formatted_turn(role: Column, text: Column) -> Column:
    return F.concat(F.lit(START), escape_role(role), F.lit("\n"), escape(text), F.lit(END + "\n"))


def prefix_target_examples(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role",
                           text: str = "text", trainable: str = "assistant") -> DataFrame:
    """One row per example: ``conv, example (from 1), n_turns, loss_start, loss_end, formatted``.

    ``loss_start``/``loss_end`` are code points of ``formatted`` (end exclusive) and cover exactly the escaped
    reply. Turns after the last reply, and conversations without a reply, come as one more example whose loss span
    is null, so the output holds every turn.

    Defined cases: a null text or role is the empty string; rows of a conversation are ordered by turn (null first),
    then role and text, so ties and repeated rows (each kept as a turn) have one order; a null conversation id is a
    conversation of its own; an empty table gives no rows; other input columns are ignored.

    One conversation is one window group: its longest example is a single row that already holds all its turns."""
    rows = turns.select(F.col(f"`{conv}`").alias("c"), F.col(f"`{turn}`").alias("t"),
                        F.coalesce(F.col(f"`{role}`"), F.lit("")).alias("r"),
                        F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("x"))
    order = Window.partitionBy("c").orderBy("t", "r", "x")
    until = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    piece = formatted_turn(F.col("r"), F.col("x"))
    rows = (rows.select("c", "t", "r", "x", piece.alias("piece"), F.length(escape("x")).alias("reply_chars"))
            .withColumn("pos", F.row_number().over(order))
            .withColumn("size", F.count(F.lit(1)).over(Window.partitionBy("c")))
            .withColumn("end", F.sum(F.length("piece").cast("long")).over(until))
            .withColumn("pieces", F.collect_list("piece").over(until)))
    reply = F.col("r") == trainable
    loss_end = F.col("end") - len(END) - 1
    return (rows.where(reply | (F.col("pos") == F.col("size")))
            .select(F.col("c").alias(conv),
                    F.col("pos").cast("long").alias("n_turns"),
                    F.when(reply, loss_end - F.col("reply_chars")).alias("loss_start"),
                    F.when(reply, loss_end).alias("loss_end"),
                    F.array_join("pieces", "").alias("formatted")))


def read_turns(formatted: Column) -> Column:
    """Parse a formatted text back into an array of ``struct(role, text)``."""
    bodies = F.slice(F.split(formatted, r"<\|im_end\|>\n", -1), 1, F.greatest(
        F.size(F.split(formatted, r"<\|im_end\|>\n", -1)) - 1, F.lit(0)))

    def turn(body):
        role = F.substring_index(body, "\n", 1)
        return F.struct(unescape_role(F.substr(role, F.lit(len(START) + 1))).alias("role"),
                        unescape(F.substr(body, F.length(role) + 2)).alias("text"))
    return F.transform(bodies, turn)


def masked_reply(formatted: Column, start: Column, end: Column) -> Column:
    """The text under the loss mask, unescaped."""
    return unescape(F.substr(formatted, (start + 1).cast("int"), (end - start).cast("int")))
