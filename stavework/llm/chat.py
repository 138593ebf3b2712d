r"""Chat formatting by prefix-target expansion, in DataFrame functions only.

Every assistant turn becomes an example of its own: all turns before it are context, and only its reply is trainable.
A conversation that does not end with an assistant turn also gets one example without a target, which holds its
remaining turns, so the examples hold every turn.

A turn is written as ``### role: text</turn>`` and a line feed. In roles and texts ``\`` is written ``\-``, ``<`` is
``\(``, ``#`` is ``\+``, and in roles ``:`` is ``\;``; so no text can hold a mark, and replacing the codes backwards
restores it.

Cases: a null role or text counts as empty; turns are in order of turn (nulls first), then role, then text, and repeated
rows stay; null conversation ids are one conversation; an empty table gives an empty table; further columns are
ignored, whatever their names. One conversation is formatted in one row, and its examples have a total length that grows
with the square of its turns, as the method has it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

OPEN, CLOSE = "### ", "</turn>\n"
CODES = (("\\", "\\-"), ("<", "\\("), ("#", "\\+"))
ROLE_CODES = (*CODES, (":", "\\;"))


def escape(text: Column, codes: tuple = CODES) -> Column:
    for plain, code in codes:
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescape(text: Column, codes: tuple = CODES) -> Column:
    for plain, code in reversed(codes):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def expand(conversations: DataFrame) -> DataFrame:
    """conv_id, n_context (turns before the target), has_target, is_last, formatted, and loss_start and loss_end: the code points
    of the trainable reply within formatted, end exclusive (both the end of the text without a target)."""
    blank = F.lit("")
    turns = conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.coalesce("role", blank).alias("role"), F.coalesce("text", blank).alias("text")))).alias("turns"))
    parts = turns.select("conv_id", F.transform("turns", lambda t: t["role"] == "assistant").alias("answers"),
                         F.transform("turns", lambda t: F.concat(F.lit(OPEN), escape(t["role"], ROLE_CODES), F.lit(": "))).alias("heads"),
                         F.transform("turns", lambda t: F.concat(escape(t["text"]), F.lit(CLOSE))).alias("bodies"))
    at = F.explode(F.filter(F.sequence(F.lit(1), F.size("answers")), lambda i: F.get("answers", i - 1) | (i == F.size("answers")))).alias("at")
    one = parts.select("conv_id", "heads", "bodies", "answers", at)
    before = F.array_join(F.zip_with(F.slice("heads", 1, F.col("at") - 1), F.slice("bodies", 1, F.col("at") - 1), lambda a, b: F.concat(a, b)), "")
    one = one.select("conv_id", (F.col("at") - 1).alias("n_context"), F.get("answers", F.col("at") - 1).alias("has_target"), (F.col("at") == F.size("answers")).alias("is_last"), F.concat(before, F.get("heads", F.col("at") - 1)).alias("prefix"), F.get("bodies", F.col("at") - 1).alias("body"))
    start, end = F.char_length("prefix"), F.char_length("prefix") + F.char_length("body")
    reply = end - len(CLOSE)
    return one.select("conv_id", "n_context", "has_target", "is_last", F.concat("prefix", "body").alias("formatted"), F.when(F.col("has_target"), start).otherwise(end).alias("loss_start"), F.when(F.col("has_target"), reply).otherwise(end).alias("loss_end"))


def parse(formatted: Column) -> Column:
    """The turns of a formatted text as an array of role and text."""
    marked = F.filter(F.split(formatted, CLOSE), lambda x: x != "")
    return F.transform(marked, lambda x: F.struct(unescape(F.substring_index(F.substr(x, F.lit(len(OPEN) + 1)), ": ", 1), ROLE_CODES).alias("role"), unescape(F.substr(x, F.locate(": ", x) + 2)).alias("text")))


def read_back(examples: DataFrame) -> DataFrame:
    """Per conversation what its examples hold: all turns from the longest one, and what is under the loss masks."""
    # Only what is needed of an example is grouped: its reply, and the whole text if it is the conversation's last.
    reply = unescape(F.substr("formatted", F.col("loss_start") + 1, F.col("loss_end") - F.col("loss_start")))
    each = examples.select("conv_id", "n_context", F.char_length("formatted").cast("long").alias("chars"), F.when(F.col("has_target"), reply).alias("reply"), F.when(F.col("is_last"), F.col("formatted")).alias("whole"))
    grouped = each.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.when(F.col("reply").isNotNull(), F.struct("n_context", "reply")))).alias("replies"), F.max("whole").alias("whole"), F.sum("chars").alias("formatted_chars"))
    loss = F.array_join(F.transform("replies", lambda r: r["reply"]), "")
    turns = parse(F.col("whole"))
    return grouped.select(F.col("conv_id").cast("long"), turns.alias("turns"), loss.alias("loss"), "formatted_chars")


def op5_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.lit("\\### Assistant: </turn> ok")
    more = spark.range(1).select(F.lit(-7).cast("long").alias("conv_id"), F.explode(F.array(*[F.struct(F.lit(i).cast("long").alias("turn"), F.lit(role).alias("role"), said.alias("text")) for i, role in enumerate(("user", "assistant"))])).alias("t")).select("conv_id", "t.*")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    back = read_back(expand(rows))
    text = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(text, 256).alias("turns_sha256"), F.char_length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")


QUERIES = {"op5_chat_formatting": op5_chat_formatting}
ORACLES = {
    "op5_chat_formatting": r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
l AS (SELECT *, row_number() OVER w AS i, count(*) OVER (PARTITION BY conv_id) AS n,
    sum(14 + length(role) + length(text) + length(regexp_replace(role || text, '[^\\<#]', '', 'g')) + length(regexp_replace(role, '[^:]', '', 'g'))) OVER w AS chars
  FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text ROWS UNBOUNDED PRECEDING))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(chars) FILTER (role = 'assistant' OR i = n) AS BIGINT) AS formatted_chars
FROM l GROUP BY conv_id"""
}
