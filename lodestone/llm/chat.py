"""Chat formatting with Spark expressions only.

Template: `<s>` role `[INST]` text `[/INST]` text ... `</s>`; adjacent turns of one role share a block, `[/INST]` between
their texts. A control string inside a text or role gets a backslash after its first character (one more, if it has some
already), so a formatted conversation never holds one that the template didn't write, and reading back is exact.

Defined results: null texts and roles are empty; turns are sorted by turn, then role, then text (nulls first), so ties
and repeated rows give one result; a null conv_id is a conversation like any other; no rows, no conversations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

OPEN, TEXT, NEXT, CLOSE = "<s>", "[INST]", "[/INST]", "</s>"
#: Java regular expressions: a control string with backslashes after its first character, as many as there are or one at least.
_CONTROL = r"([<\[])(\\*)(/?s>|/?INST\])"
_ESCAPED = r"([<\[])(\\*)\\(/?s>|/?INST\])"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, F.lit(_CONTROL), F.lit(r"$1$2\\$3"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, F.lit(_ESCAPED), F.lit("$1$2$3"))


def format_conversations(rows: DataFrame) -> DataFrame:
    """conv_id, formatted: a row for each conversation. conversations: conv_id, turn, role, text."""
    turn = F.struct(
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    sorted_turns = rows.groupBy(F.col("conv_id").cast("long").alias("conv_id")).agg(F.sort_array(F.collect_list(turn)).alias("turns"))

    def piece(t: Column, i: Column) -> Column:
        same = (i > 0) & (F.element_at("turns", F.greatest(i, F.lit(1))).getField("role") == t["role"])
        head = F.concat(F.when(i > 0, F.lit(CLOSE)).otherwise(F.lit("")), F.lit(OPEN), escape(t["role"]), F.lit(TEXT))
        return F.concat(F.when(same, F.lit(NEXT)).otherwise(head), escape(t["text"]))

    body = F.array_join(F.transform("turns", piece), "")
    return sorted_turns.select("conv_id", F.concat(body, F.lit(CLOSE)).alias("formatted"))


def read_conversations(formatted: DataFrame) -> DataFrame:
    """conv_id, formatted, turns array<struct<role, text>>: what the formatted text holds."""
    blocks = F.filter(F.split("formatted", "</s>", -1), lambda b: b != "")

    def turns(b: Column) -> Column:
        role = F.substring_index(F.substr(b, F.lit(len(OPEN) + 1)), TEXT, 1)
        texts = F.split(F.substr(b, F.length(role) + F.lit(len(OPEN) + len(TEXT) + 1)), r"\[/INST\]", -1)
        return F.transform(texts, lambda t: F.struct(unescape(role).alias("role"), unescape(t).alias("text")))

    return formatted.withColumn("turns", F.flatten(F.transform(blocks, turns)))


def digests(read: DataFrame, trained_role: str = "assistant") -> DataFrame:
    """Turn count, a digest of the turns and the texts under the loss mask, which is that of trained_role."""
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform(F.filter("turns", lambda t: t["role"] == trained_role), lambda t: t["text"]), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def with_hard_case(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """The rows and conversation -7, whose texts are made of control strings."""
    hard = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))
    return rows.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string")).unionByName(hard)
