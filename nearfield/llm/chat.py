"""Chat formatting with relational operations only: sort, merge, escape, concatenate, and read back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The template's marks, and other strings that chat tokenizers treat as control.
BEGIN, PART, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
#: An opening bracket, backslashes, and the rest of a control string. One more backslash escapes it, one less reads it.
_ESCAPE = r"([<\[])(\\*)(/?s>|/?INST\]|\|im_start\|>|\|im_sep\|>|\|im_end\|>)"
_UNESCAPE = r"([<\[])\\(\\*)(/?s>|/?INST\]|\|im_start\|>|\|im_sep\|>|\|im_end\|>)"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, _ESCAPE, r"$1$2\\$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, _UNESCAPE, r"$1$2$3")


def _role_line(role: Column) -> Column:
    return F.replace(F.replace(escape(role), F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n"))


def _role_read(line: Column) -> Column:
    """Inverse of ``_role_line``; the stand-in character keeps ``\\\\n`` apart from ``\\n``."""
    parts = F.split(line, r"\\\\", -1)
    return unescape(F.array_join(F.transform(parts, lambda p: F.replace(p, F.lit("\\n"), F.lit("\n"))), "\\"))


def format_chats(turns: DataFrame, loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """``conv_id, formatted, segments`` of each conversation.

    The turns of a conversation are collected as structs and sorted by turn (null first, ties by role and text).
    Adjacent turns of one role share a block; ``formatted`` is the concatenation of the ``segments`` (struct of
    ``text`` and ``loss``), and loss is true for the texts of ``loss_roles`` only, not for the marks about them.

    A null text or role is empty, a null conv_id is a conversation of its own, repeated rows stay repeated turns, an
    empty table gives no rows, and columns other than conv_id, turn, role and text play no part.
    """
    need = turns.select("conv_id", F.col("turn").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    one = F.struct("turn", F.expr("role").alias("role"), F.expr("text").alias("text"))
    grouped = need.groupBy("conv_id").agg(F.sort_array(F.collect_list(one)).alias("turns"))
    before = F.concat(F.array(F.lit(None).cast("string")), F.slice(F.transform("turns", lambda t: t["role"]), 1, F.size("turns") - 1))

    def segments(t: Column, last: Column) -> Column:
        opening = F.concat(F.lit(BEGIN), _role_line(t["role"]), F.lit("\n"))
        mark = F.when(last.isNull(), opening).when(last == t["role"], F.lit(PART)).otherwise(F.concat(F.lit(END + "\n"), opening))
        return F.array(F.struct(mark.alias("text"), F.lit(False).alias("loss")), F.struct(escape(t["text"]).alias("text"), t["role"].isin(*loss_roles).alias("loss")))

    made = F.flatten(F.zip_with("turns", before, segments))
    closing = F.array(F.struct(F.lit(END + "\n").alias("text"), F.lit(False).alias("loss")))
    chats = grouped.select("conv_id", F.concat(made, closing).alias("segments"))
    return chats.select("conv_id", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"), "segments")


def read_chat(formatted: Column) -> Column:
    """The turns (``role``, ``text``) that a formatted conversation holds, in order."""
    blocks = F.filter(F.split(formatted, r"<\|im_end\|>\n", -1), lambda b: b != "")
    return F.flatten(F.transform(blocks, _block_turns))


def _block_turns(block: Column) -> Column:
    line = F.substring_index(block, "\n", 1)
    role = _role_read(line.substr(F.lit(len(BEGIN) + 1), F.length(line)))
    texts = F.split(block.substr(F.length(line) + 2, F.length(block)), r"<\|im_sep\|>", -1)
    return F.transform(texts, lambda x: F.struct(role.alias("role"), unescape(x).alias("text")))


def chat_digest(turns: DataFrame) -> DataFrame:
    """``conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars``, all read back from the format."""
    chats = format_chats(turns)
    read = chats.select("conv_id", "formatted", read_chat(F.col("formatted")).alias("turns"), F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["text"])), "").alias("loss"))
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


ORACLE = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, regexp_replace(text, '([<\[])(\\*)(/?s>|/?INST\]|\|im_start\|>|\|im_sep\|>|\|im_end\|>)', '\1\2\\\3', 'g') AS esc,
             lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS prev FROM c),
f AS (SELECT *, CASE WHEN prev IS NULL THEN '<|im_start|>' || role || chr(10) WHEN prev = role THEN '<|im_sep|>' ELSE '<|im_end|>' || chr(10) || '<|im_start|>' || role || chr(10) END || esc AS piece FROM e)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
       CAST(sum(length(piece)) + 11 AS BIGINT) AS formatted_chars
FROM f GROUP BY conv_id
"""
