"""Chat formatting with Spark expressions only.

Turn structs of a conversation are sorted, adjacent turns of one role share one
block, and the blocks are concatenated.  Template of a block::

    <|im_start|>ROLE\\n TEXT [<|im_next|> TEXT ...] <|im_end|>\\n

(without the blanks).  ``<|im_next|>`` stands between the texts of merged turns, so
that reading back gives every turn.  Inside texts and roles a run ``<``, backslashes,
``|`` gets one more backslash, so no text can hold a control string; the reverse takes
one away.  Line feeds in roles are written as ``\\n`` after doubling backslashes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, NEXT, END = "<|im_start|>", "<|im_next|>", "<|im_end|>"


def escape(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"<(\\*)\|", r"<$1\\|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def escape_role(role: Column) -> Column:
    doubled = F.replace(F.coalesce(role, F.lit("")), F.lit("\\"), F.lit("\\\\"))
    return escape(F.replace(doubled, F.lit("\n"), F.lit("\\n")))


def unescape_role(role: Column) -> Column:
    parts = F.split(unescape(role), r"\\\\")
    return F.array_join(F.transform(parts, lambda x: F.replace(x, F.lit("\\n"), F.lit("\n"))), "\\")


def format_chats(turns: DataFrame) -> DataFrame:
    """``conv_id, formatted, loss_mask`` from rows ``conv_id, turn, role, text``.

    ``loss_mask`` is a run-length list ``(length, loss)`` over the code points of
    ``formatted``: for each turn a run of markers and role, then a run of its text,
    and one last run.  Only texts of assistant turns are under the mask.

    Ties in ``turn`` are ordered by role, then text; null turns come first; null texts
    and roles are empty; repeated rows are turns of their own.  Rows with a null conv_id are
    conversations of one turn each, since nothing says which of them belong together.  An
    empty table gives an empty result; other columns are not read.  A conversation is one
    output row, so its turns meet in one row by nature.
    """
    rows = turns.select(
        "conv_id",
        F.when(F.col("conv_id").isNull(), F.monotonically_increasing_id()).alias("alone"),
        F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t"),
    )
    sorted_turns = rows.groupBy("conv_id", "alone").agg(F.sort_array(F.collect_list("t")).alias("ts"))
    written = lambda t: F.struct(escape_role(t["role"]).alias("role"), escape(t["text"]).alias("text"))
    ordered = sorted_turns.select("conv_id", F.transform("ts", written).alias("ts"))

    # a turn opens a block where the role before differs and closes it where the next one does
    none = F.array(F.lit(None).cast("string"))
    sides = ordered.select(
        "conv_id",
        F.arrays_zip(
            F.col("ts").alias("t"),
            F.slice(F.concat(none, F.col("ts.role")), F.lit(1), F.size("ts")).alias("before"),
            F.slice(F.concat(F.col("ts.role"), none), F.lit(2), F.size("ts")).alias("after"),
        ).alias("ts"),
    )
    merged = sides.select(
        "conv_id",
        F.transform(
            "ts",
            lambda x: F.struct(
                F.when(x["t"]["role"].eqNullSafe(x["before"]), F.lit(NEXT))
                .otherwise(F.concat(F.lit(START), x["t"]["role"], F.lit("\n")))
                .alias("open"),
                x["t"]["text"].alias("text"),
                F.when(x["t"]["role"].eqNullSafe(x["after"]), F.lit("")).otherwise(F.lit(END + "\n")).alias("close"),
                (x["t"]["role"] == "assistant").alias("loss"),
                x["t"]["role"].eqNullSafe(x["before"]).alias("same"),
            ),
        ).alias("ts"),
    )
    run = lambda length, loss: F.struct(length.cast("long").alias("length"), loss.alias("loss"))
    closing = F.length(F.lit(END + "\n"))
    mask = F.concat(
        F.flatten(
            F.transform(
                "ts",
                lambda x, i: F.array(
                    run(F.length(x["open"]) + F.when((i == 0) | x["same"], 0).otherwise(closing), F.lit(False)),
                    run(F.length(x["text"]), x["loss"]),
                ),
            )
        ),
        F.array(run(closing, F.lit(False))),
    )
    return merged.select(
        "conv_id",
        F.array_join(F.transform("ts", lambda x: F.concat(x["open"], x["text"], x["close"])), "").alias("formatted"),
        mask.alias("loss_mask"),
    )


def read_chats(chats: DataFrame) -> DataFrame:
    """``conv_id, turns, loss_text`` read back from ``formatted`` and ``loss_mask`` alone.

    ``turns`` is an array of ``(role, text)``, unescaped; ``loss_text`` is all text under
    the mask, unescaped, in order, with nothing between.
    """
    found = F.regexp_extract_all("formatted", F.lit(r"(?s)<\|im_start\|>(.*?)<\|im_end\|>\n"), F.lit(1))
    turns = F.flatten(
        F.transform(
            found,
            lambda b: F.transform(
                F.split(F.substring(b, F.length(F.substring_index(b, "\n", 1)) + 2, F.length(b)), r"<\|im_next\|>"),
                lambda t: F.struct(F.substring_index(b, "\n", 1).alias("role"), t.alias("text")),
            ),
        )
    )
    text_runs = F.filter("loss_mask", lambda _, i: i % 2 == 1)
    parsed = chats.select("*", turns.alias("raw"), text_runs.alias("runs"))
    under = F.transform(
        F.filter(F.arrays_zip(F.col("raw").alias("t"), F.col("runs").alias("r")), lambda x: x["r"]["loss"]),
        lambda x: unescape(F.substring(x["t"]["text"], F.lit(1), x["r"]["length"].cast("int"))),
    )
    return parsed.select(
        "conv_id",
        "formatted",
        F.transform(
            "raw",
            lambda t: F.struct(unescape_role(t["role"]).alias("role"), unescape(t["text"]).alias("text")),
        ).alias("turns"),
        F.array_join(under, "").alias("loss_text"),
    )
