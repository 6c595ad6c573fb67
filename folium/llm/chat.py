"""Chat formatting with Spark expressions: sort collected turns, merge neighbours of one role, concatenate.

Template: each block is <|turn ROLE|> TEXT (<|part|> TEXT)* <|end|>, where the parts are
neighbouring turns of one role. Inside texts and roles a backslash is put after the first
character of each control string, and backslashes are doubled, so that no text can be
taken for a marker and `unescape` restores it.

Cases: a null text or role counts as empty, a null conversation id is a conversation of
its own, a null turn comes first, rows of one turn are ordered by role and text, repeated
rows are kept, an empty table gives an empty result, and other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Control strings of the common chat templates and of this one.
CONTROL = ["<|", "|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"]

_BREAKS = r"\\|<(?=\||/?s>|</?SYS>>)|\|(?=>)|\[(?=/?INST\])"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, _BREAKS, r"$0\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\(\\?)", "$1")


def format_chats(turns: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """conv_id, formatted, loss: the spans (start, size in code points) on which loss is taken.

    turns: conv_id, turn, role, text. A conversation becomes one string, so its turns are
    gathered in one row; conversations, not their turns, are spread over the tasks.
    """
    rows = turns.select(
        "conv_id",
        F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t"),
    )
    told = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    starts = told.select(
        "conv_id",
        "t",
        F.filter(F.sequence(F.lit(0), F.size("t") - 1), lambda i: (i == 0) | (F.get("t", i)["role"] != F.get("t", i - 1)["role"])).alias("s"),
    )
    merged = starts.select(
        "conv_id",
        F.transform(
            "s",
            lambda at, k: F.struct(
                F.get("t", at)["role"].alias("role"),
                F.transform(F.slice("t", at + 1, F.coalesce(F.get("s", k + 1), F.size("t")) - at), lambda x: escape(x["text"])).alias("parts"),
            ),
        ).alias("blocks"),
    )
    pieces = merged.select(
        "conv_id",
        F.flatten(
            F.transform(
                "blocks",
                lambda b: F.concat(
                    F.array(_piece(F.concat(F.lit("<|turn "), escape(b["role"]), F.lit("|>")), F.lit(False))),
                    F.flatten(
                        F.transform(
                            b["parts"],
                            lambda x, k: F.array(_piece(F.when(k == 0, "").otherwise("<|part|>"), F.lit(False)), _piece(x, b["role"] == loss_role)),
                        )
                    ),
                    F.array(_piece(F.lit("<|end|>"), F.lit(False))),
                ),
            )
        ).alias("pieces"),
    )
    none = F.array().cast("array<struct<start:bigint,size:bigint>>")
    masked = F.aggregate(
        "pieces",
        F.struct(F.lit(0).cast("bigint").alias("at"), none.alias("loss")),
        lambda a, p: F.struct(
            (a["at"] + F.length(p["text"])).alias("at"),
            F.when(p["loss"], F.concat(a["loss"], F.array(F.struct(a["at"].alias("start"), F.length(p["text"]).cast("bigint").alias("size"))))).otherwise(a["loss"]).alias("loss"),
        ),
    )
    return pieces.select("conv_id", F.array_join(F.transform("pieces", lambda p: p["text"]), "").alias("formatted"), masked["loss"].alias("loss"))


def _piece(text: Column, loss: Column) -> Column:
    return F.struct(text.alias("text"), loss.alias("loss"))


def read_chats(formatted: DataFrame) -> DataFrame:
    """conv_id, turns (role, text; one for each row formatted) and loss_text, from the output of format_chats alone."""
    blocks = F.split("formatted", r"<\|end\|>")
    whole = formatted.select("*", F.slice(blocks, 1, F.size(blocks) - 1).alias("b"))
    heads = whole.withColumn("b", F.transform("b", lambda b: F.struct(F.regexp_extract(b, r"(?s)^<\|turn (.*?)\|>", 1).alias("role"), F.regexp_replace(b, r"(?s)^<\|turn .*?\|>", "").alias("body"))))
    turns = F.flatten(F.transform("b", lambda b: F.transform(F.split(b["body"], r"<\|part\|>"), lambda x: F.struct(unescape(b["role"]).alias("role"), unescape(x).alias("text")))))
    under = F.transform("loss", lambda s: unescape(F.substring(F.col("formatted"), (s["start"] + 1).cast("int"), s["size"].cast("int"))))
    return heads.select("conv_id", "formatted", turns.alias("turns"), F.array_join(under, "").alias("loss_text"))
