"""Chat formatting by prefix-target expansion, in DataFrame functions only.

Every assistant turn becomes an example of its own: all turns before it as context, and only
its own text trainable. A conversation that doesn't end with an assistant turn gets one more
example without a trainable part, so no turn is lost.

A turn is written as <turn>role, a line feed, the text, </turn> and a line feed. Control
strings inside a text get a backslash after their <; one that has backslashes there gets one
more. Roles also have & as &a and a line feed as &n. Both can be undone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The template and the role that is trained on.
OPEN, CLOSE = "<turn>", "</turn>\n"
TRAINED_ROLE = "assistant"


def escaped(text: Column) -> Column:
    """The text without control strings."""
    return F.regexp_replace(text, r"<(\\*)(/?turn)", r"<\\$1$2")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)(/?turn)", r"<$1$2")


def escaped_role(role: Column) -> Column:
    return escaped(F.replace(F.replace(role, F.lit("&"), F.lit("&a")), F.lit("\n"), F.lit("&n")))


def unescaped_role(role: Column) -> Column:
    return F.replace(F.replace(unescaped(role), F.lit("&n"), F.lit("\n")), F.lit("&a"), F.lit("&"))


def prefix_target_examples(conversations: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, example, text, loss_start, loss_end, last: one row per assistant turn.

    loss_start and loss_end (code points, end excluded) bound the trainable part of the
    text; they are equal where nothing is. last marks the example with all turns. Turns go
    by (turn, role, text), nulls first; null roles and texts are empty; rows with a null
    conversation id are one conversation. A conversation is one value, like a text; its
    examples are made row by row.
    """
    rows = conversations.select(
        F.col(conversation).alias("conv_id"),
        F.struct(
            F.col(turn).alias("turn"),
            F.coalesce(F.col(role), F.lit("")).alias("role"),
            F.coalesce(F.col(text), F.lit("")).alias("text"),
        ).alias("said"),
    )
    grouped = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("said")).alias("said"))
    written = F.transform(
        "said",
        lambda t: F.struct(
            F.concat(F.lit(OPEN), escaped_role(t["role"]), F.lit("\n")).alias("head"),
            escaped(t["text"]).alias("body"),
            (t["role"] == TRAINED_ROLE).alias("trained"),
        ),
    )
    grouped = grouped.select("conv_id", written.alias("turns"))
    numbers = F.sequence(F.lit(1), F.size("turns"))
    wanted = F.filter(numbers, lambda k: F.element_at("turns", k)["trained"] | (k == F.size("turns")))
    each = grouped.select("conv_id", "turns", F.posexplode(wanted).alias("example", "upto"))
    before = F.array_join(
        F.transform(F.slice("turns", F.lit(1), F.col("upto") - 1), lambda t: F.concat(t["head"], t["body"], F.lit(CLOSE))), ""
    )
    each = each.select(
        "conv_id", "example", before.alias("context"), F.element_at("turns", F.col("upto")).alias("reply"), (F.col("upto") == F.size("turns")).alias("last")
    )
    start = F.char_length("context") + F.char_length("reply.head")
    end = start + F.when(F.col("reply.trained"), F.char_length("reply.body")).otherwise(0)
    whole = F.concat("context", "reply.head", "reply.body", F.lit(CLOSE))
    return each.select("conv_id", "example", whole.alias("text"), start.alias("loss_start"), end.alias("loss_end"), "last")


def read_turns(text: Column) -> Column:
    """The turns (role, text) of a formatted text."""
    parts = F.split(text, CLOSE)
    parts = F.slice(parts, 1, F.size(parts) - 1)

    def turn(part: Column) -> Column:
        inner = F.substring(part, F.lit(len(OPEN) + 1), F.char_length(part))
        role = F.substring_index(inner, "\n", 1)
        body = F.substring(inner, F.char_length(role) + 2, F.char_length(inner))
        return F.struct(unescaped_role(role).alias("role"), unescaped(body).alias("text"))

    return F.transform(parts, turn)


def conversation_digest(examples: DataFrame) -> DataFrame:
    """What the examples of each conversation say, read back from their texts and loss masks."""
    masked = F.substring(F.col("text"), F.col("loss_start") + 1, F.col("loss_end") - F.col("loss_start"))
    rows = examples.select(
        "conv_id",
        F.struct("example", unescaped(masked).alias("loss")).alias("loss"),
        F.char_length("text").cast("long").alias("chars"),
        F.when(F.col("last"), F.col("text")).alias("whole"),
    )
    found = rows.groupBy("conv_id").agg(
        F.sort_array(F.collect_list("loss")).alias("loss"), F.sum("chars").alias("formatted_chars"), F.max("whole").alias("whole")
    )
    found = found.select("conv_id", "formatted_chars", read_turns(F.col("whole")).alias("turns"), F.array_join("loss.loss", "").alias("loss"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return found.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        "formatted_chars",
    )
