r"""Chat formatting by prefix-target expansion, in native Spark functions only.

Every assistant turn becomes an example of its own: all preceding turns are context and only
its text is trainable.  A conversation that ends in another role, or has no assistant turn,
gets one more example without a target, so that the output holds every turn.

A turn is `<|turn|>role<|text|>text<|end|>`.  Inside roles and texts a backslash is doubled
and each reserved string gets a backslash after its first character; reading `\x` as x
undoes both, so the output can be taken apart again without loss.

Defined results: null roles and texts are empty; rows of a null conv_id are one conversation;
rows are ordered by turn (null first) and ties by role and text, so repeated rows stay,
next to each other; an empty table gives an empty result; other columns are left out.
A conversation's turns must fit one row, as its longest example does.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
RESERVED = (TURN, TEXT, END, "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>")


def escaped(c: Column, reserved: tuple[str, ...] = RESERVED) -> Column:
    marks = "|".join(re.escape(x[0]) + "(?=" + re.escape(x[1:]) + ")" for x in reserved)
    doubled = F.replace(c, F.lit("\\"), F.lit("\\\\"))
    return F.regexp_replace(doubled, f"({marks})", r"$1\\")


def unescaped(c: Column) -> Column:
    return F.regexp_replace(c, r"(?s)\\(.)", "$1")


def chat_examples(rows: DataFrame, reserved: tuple[str, ...] = RESERVED) -> DataFrame:
    """conv_id, example (from 0), target_turn (its place, null without target), formatted, loss_start (0-based), loss_length, last."""
    said = rows.select(
        F.col("conv_id"), F.col("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    )
    piece = F.concat(F.lit(TURN), escaped(F.col("role"), reserved), F.lit(TEXT))
    said = said.select("conv_id", F.struct("turn", "role", "text", piece.alias("head"), escaped(F.col("text"), reserved).alias("body")).alias("t"))
    whole = said.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    whole = whole.withColumn("n", F.size("turns"))
    targets = F.expr("filter(sequence(1, n), i -> turns[i - 1].role = 'assistant' or i = n)")
    each = whole.select("conv_id", "turns", "n", F.posexplode(targets).alias("example", "at"))
    is_target = F.col("target.role") == "assistant"
    before = F.expr("array_join(transform(slice(turns, 1, at - 1), t -> concat(t.head, t.body, '" + END + "')), '')")
    each = each.select("conv_id", "example", "at", (F.col("at") == F.col("n")).alias("last"), F.expr("turns[at - 1]").alias("target"), before.alias("context"))
    return each.select(
        "conv_id",
        "example",
        F.when(is_target, F.col("at") - 1).alias("target_turn"),
        F.concat("context", "target.head", "target.body", F.lit(END)).alias("formatted"),
        F.when(is_target, F.length("context") + F.length("target.head")).alias("loss_start"),
        F.when(is_target, F.length("target.body")).otherwise(0).alias("loss_length"),
        "last",
    )


def read_back(formatted: Column) -> Column:
    """The turns of a formatted text: array of (role, text)."""
    parts = F.split(formatted, re.escape(TURN))
    parts = F.slice(parts, F.lit(2), F.size(parts))
    one = lambda p: F.struct(
        unescaped(F.substring_index(p, TEXT, 1)).alias("role"),
        unescaped(F.regexp_extract(p, "(?s)^.*?" + re.escape(TEXT) + "(.*)" + re.escape(END) + "$", 1)).alias("text"),
    )
    return F.transform(parts, one)


def digest(spark, sf_dir: str) -> DataFrame:
    """The contract's columns, read back from the formatted examples of all conversations."""
    text = "</s>[INST] ok [/INST]"
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    more = spark.sql("SELECT -1L AS conv_id, * FROM VALUES (0L, 'user', :text), (1L, 'assistant', :text) AS t(turn, role, text)", args={"text": text})
    made = chat_examples(rows.unionByName(more))
    turns = F.when(F.col("last"), read_back(F.col("formatted")))
    loss = F.when(F.col("target_turn").isNotNull(), unescaped(F.expr("substring(formatted, loss_start + 1, loss_length)")))
    made = made.select("conv_id", "example", F.length("formatted").cast("long").alias("chars"), turns.alias("turns"), loss.alias("loss"))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    made = made.select("conv_id", "example", "chars", F.size("turns").cast("long").alias("n"), F.sha2(told, 256).alias("sha"), "loss")
    out = made.groupBy("conv_id").agg(
        F.max("n").alias("n_turns"),
        F.max("sha").alias("turns_sha256"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("loss").isNotNull(), F.struct("example", "loss")))), lambda x: x.loss), "").alias("loss"),
        F.sum("chars").alias("formatted_chars"),
    )
    return out.select("conv_id", "n_turns", "turns_sha256", F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")


SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), e AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i, count(*) OVER (PARTITION BY conv_id) AS n,
    23 + length(role) + length(text)
    + len(regexp_extract_all(role || '|' || text, '\\'))
    + len(regexp_extract_all(role || chr(1) || text, '<\|turn\|>|<\|text\|>|<\|end\|>|<s>|</s>|<<SYS>>|<</SYS>>|<\|im_start\|>|<\|im_end\|>|<\|endoftext\|>|\[INST\]|\[/INST\]')) AS chars
  FROM c
), p AS (
  SELECT *, sum(chars) OVER (PARTITION BY conv_id ORDER BY i) AS so_far FROM e
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(coalesce(sum(so_far) FILTER (role = 'assistant' OR i = n), 0) AS BIGINT) AS formatted_chars
FROM p GROUP BY conv_id
"""
