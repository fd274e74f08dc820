"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all preceding turns are
context and only that reply is trainable. A conversation whose last turn is not
a reply gets one more example without a trainable part, so no turn is lost.
The template is ``<|im_start|>role\\ntext<|im_end|>\\n``. Inside roles and texts
every ``<``, backslashes, ``|`` gains one backslash, which no text can undo by
accident, so ``<|`` occurs only where the template puts it.

Defined cases: null text or role is empty; rows with equal turn are ordered by
role, then text, and repeated rows are turns of their own; a null conv_id is a
conversation of its own; an empty table gives no rows; further columns are
ignored. The prefix text of an example is as long as its conversation, so the
output of one conversation grows with the square of its turns by definition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def escape_role(role: Column) -> Column:
    return F.replace(F.replace(escape(role), F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(F.replace(role, F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%")))


def format_conversations(conversations: DataFrame) -> DataFrame:
    """Examples: conv_id, example (place of its last turn), formatted, loss_start, loss_length (code points, from 0)."""
    turns = conversations.select(
        "conv_id",
        "turn",
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    body = escape(F.col("text"))
    turn = F.concat(F.lit(START), escape_role(F.col("role")), F.lit("\n"), body, F.lit(END + "\n"))
    reply = F.col("role") == "assistant"
    formatted = F.array_join("turns", "")
    return (
        turns.select("conv_id", "turn", "role", "text", turn.alias("shown"), F.length(body).alias("body"))
        .withColumn("example", F.row_number().over(order))
        .withColumn("last", F.lead(F.lit(1)).over(order).isNull())
        .withColumn("turns", F.collect_list("shown").over(so_far))
        .where(reply | F.col("last"))
        .select("conv_id", F.col("example").cast("long").alias("example"), formatted.alias("formatted"), reply.alias("reply"), "body")
        .select(
            "conv_id",
            "example",
            "formatted",
            F.when(F.col("reply"), F.length("formatted") - F.col("body") - len(END) - 1).otherwise(0).cast("long").alias("loss_start"),
            F.when(F.col("reply"), F.col("body")).otherwise(0).cast("long").alias("loss_length"),
            F.col("reply").alias("trainable"),
        )
    )


def read_turns(formatted: Column) -> Column:
    """Array of struct(role, text) parsed from one formatted example."""
    parts = F.slice(F.split(formatted, r"<\|im_start\|>"), 2, 2**30)
    head = lambda p: F.substring_index(p, "\n", 1)
    return F.transform(
        parts,
        lambda p: F.struct(
            unescape_role(head(p)).alias("role"),
            unescape(F.substring(p, F.length(head(p)) + 2, F.length(p) - F.length(head(p)) - 2 - len(END))).alias("text"),
        ),
    )


def read_loss(formatted: Column, start: Column, length: Column) -> Column:
    """The trainable text of one example, unescaped."""
    return unescape(F.substring(formatted, start.cast("int") + 1, length.cast("int")))


def broken_contexts(examples: DataFrame) -> DataFrame:
    """conv_id, example of examples that are not the beginning of their conversation's longest one."""
    longest = examples.groupBy("conv_id").agg(F.max_by("formatted", "example").alias("longest")).withColumnRenamed("conv_id", "_conv")
    both = examples.join(longest, F.col("conv_id").eqNullSafe(F.col("_conv")))
    return both.where(~F.col("longest").startswith(F.col("formatted"))).select("conv_id", "example")


def digest(examples: DataFrame) -> DataFrame:
    """Per conversation, from the examples: turns, their digest, and the text under the loss mask."""
    loss = read_loss(F.col("formatted"), F.col("loss_start"), F.col("loss_length"))
    grouped = examples.groupBy("conv_id").agg(
        F.max_by("formatted", "example").alias("longest"),
        F.sort_array(F.collect_list(F.when(F.col("trainable"), F.struct("example", loss.alias("loss"))))).alias("losses"),
        F.sum(F.length("formatted")).alias("formatted_chars"),
    )
    said = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return grouped.select(
        "conv_id",
        read_turns(F.col("longest")).alias("turns"),
        F.array_join(F.transform("losses", lambda x: x["loss"]), "").alias("loss"),
        "formatted_chars",
    ).select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(said, ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        "formatted_chars",
    )
