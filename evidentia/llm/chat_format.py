r"""Chat formatting with Spark expressions only.

The turns of a conversation are collected as structs and sorted by turn, role and text; neighbours
of one role are merged by a fold into blocks; blocks are concatenated:

    <s>[SYS]text[/SYS][INST]text[/INST][OUT]text[TURN]text[/OUT]</s>

user, assistant and system have markers of their own; any other role is written as
[ANY]role[TURN]text[/ANY]. [TURN] keeps merged turns apart, so the turns can be read back as they
were. A control string inside a text gets a backslash after its first character, and one that
already has backslashes there gets one more, so texts can be unescaped exactly.

The loss mask is an array of (start, end) in code points of the formatted text, one for each
assistant turn, markers excluded.

Defined cases: null text or role counts as empty; null turn sorts first; equal rows are turns of
their own; a null conv_id is a conversation; very long texts are formatted whole; extra columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_NAMES = {"user": "INST", "assistant": "OUT", "system": "SYS"}
_CONTROL = r"/?(?:INST|OUT|SYS|ANY)\]|TURN\]|/?s>"
_PLAIN = r"([\[<])(\\*)(" + _CONTROL + ")"
_ESCAPED = r"([\[<])\\(\\*)(" + _CONTROL + ")"
TURN = "[TURN]"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, _PLAIN, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, _ESCAPED, "$1$2$3")


def _marker(role: Column) -> Column:
    out = F.lit("ANY")
    for name, mark in _NAMES.items():
        out = F.when(role == name, F.lit(mark)).otherwise(out)
    return out


def _blocks(turns: Column) -> Column:
    kind = "array<struct<role:string,texts:array<string>>>"

    def add(blocks: Column, turn: Column) -> Column:
        last = F.try_element_at(blocks, F.lit(-1))
        own = F.array(turn["text"])
        merged = F.concat(F.slice(blocks, 1, F.size(blocks) - 1), F.array(F.struct(last["role"].alias("role"), F.concat(last["texts"], own).alias("texts"))))
        fresh = F.concat(blocks, F.array(F.struct(turn["role"].alias("role"), own.alias("texts"))))
        return F.when((F.size(blocks) > 0) & (last["role"] == turn["role"]), merged).otherwise(fresh).cast(kind)

    return F.aggregate(turns, F.array().cast(kind), add)


def _pieces(block: Column) -> Column:
    """Strings of a block in order, each with the mark whether loss is taken on it."""
    piece = lambda s, loss: F.struct(s.alias("s"), loss.alias("loss"))
    no, mark = F.lit(False), _marker(block["role"])
    named = F.when(mark == "ANY", F.concat(F.lit("[ANY]"), escape(block["role"]), F.lit(TURN))).otherwise(F.concat(F.lit("["), mark, F.lit("]")))
    first = F.array(piece(named, no), piece(escape(block["texts"][0]), block["role"] == "assistant"))
    more = F.flatten(F.transform(F.slice(block["texts"], 2, F.greatest(F.size(block["texts"]) - 1, F.lit(0))), lambda t: F.array(piece(F.lit(TURN), no), piece(escape(t), block["role"] == "assistant"))))
    return F.concat(first, more, F.array(piece(F.concat(F.lit("[/"), mark, F.lit("]")), no)))


def format_conversations(turns: DataFrame) -> DataFrame:
    """conv_id, formatted, loss_spans for turns(conv_id, turn, role, text)."""
    row = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    start = F.struct(F.lit(3).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))

    def walk(acc: Column, p: Column) -> Column:
        end = acc["at"] + F.length(p["s"])
        spans = F.when(p["loss"], F.concat(acc["spans"], F.array(F.struct(acc["at"].alias("start"), end.alias("end"))))).otherwise(acc["spans"])
        return F.struct(end.alias("at"), spans.alias("spans"))

    return (
        turns.groupBy("conv_id")
        .agg(F.sort_array(F.collect_list(row)).alias("turns"))
        .select("conv_id", _blocks(F.col("turns")).alias("blocks"))
        .select("conv_id", F.flatten(F.transform("blocks", _pieces)).alias("pieces"))
        .select(
            "conv_id",
            F.concat(F.lit("<s>"), F.array_join(F.transform("pieces", lambda p: p["s"]), ""), F.lit("</s>")).alias("formatted"),
            F.aggregate("pieces", start, walk, lambda a: a["spans"]).alias("loss_spans"),
        )
    )


def parse(formatted: Column) -> Column:
    """The turns of a formatted text, as array<struct<role, text>>."""
    blocks = F.regexp_extract_all(formatted, F.lit(r"(?s)\[(INST|OUT|SYS|ANY)\].*?\[/\1\]"), 0)

    def turns(block: Column) -> Column:
        mark = F.substring_index(F.substring(block, 2, 4), "]", 1)
        texts = F.split(F.substring(block, F.length(mark) + 3, F.length(block) - 2 * F.length(mark) - 5), r"\[TURN\]")
        role = F.lit("")
        for name, own in _NAMES.items():
            role = F.when(mark == own, F.lit(name)).otherwise(role)
        role = F.when(mark == "ANY", unescape(texts[0])).otherwise(role)
        said = F.when(mark == "ANY", F.slice(texts, 2, F.greatest(F.size(texts) - 1, F.lit(0)))).otherwise(texts)
        return F.transform(said, lambda t: F.struct(role.alias("role"), unescape(t).alias("text")))

    return F.flatten(F.transform(blocks, turns))


def loss_text(formatted: Column, spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(formatted, s["start"] + 1, s["end"] - s["start"]))), "")


def op8_chat_formatting(spark, sf_dir):
    from .common import table

    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    own = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit("</s>[INST] ok [/INST]").alias("text"),
    )
    out = format_conversations(turns.unionByName(own))
    out = out.withColumn("back", parse(F.col("formatted"))).withColumn("loss", loss_text(F.col("formatted"), F.col("loss_spans")))
    lines = F.array_join(F.transform("back", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select(
        "conv_id",
        F.size("back").cast("long").alias("n_turns"),
        F.sha2(lines, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
e AS (SELECT *, len(regexp_replace(text, '([\[<])(\\*)(/?(?:INST|OUT|SYS|ANY)\]|TURN\]|/?s>)', '\1\\\2\3', 'g')) AS n,
             len(regexp_replace(role, '([\[<])(\\*)(/?(?:INST|OUT|SYS|ANY)\]|TURN\]|/?s>)', '\1\\\2\3', 'g')) AS r,
             lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) IS NOT DISTINCT FROM role AS merged FROM t)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(len(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  (7 + sum(n + CASE WHEN merged THEN 6 ELSE CASE role WHEN 'user' THEN 13 WHEN 'assistant' THEN 11 WHEN 'system' THEN 11 ELSE 17 + r END END))::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""
