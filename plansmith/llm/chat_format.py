"""Chat formatting with Spark expressions only.

A conversation's turns are collected as structs and sorted; adjacent turns of a role merge into one block whose parts a mark divides, so the
text can be read back turn by turn. The template:

    <|start|>ROLE\\n PART [<|next|> PART ...] <|end|>\\n        (without the blanks here)

Roles and texts are escaped: ``&`` ``<`` ``[`` become ``&amp;`` ``&lt;`` ``&#91;`` (in roles also the line feed ``&#10;``), so neither the
template's marks nor other control strings, such as ``</s>`` or ``[INST]``, can stand inside a text, and unescaping gives it back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plansmith.llm.common import table

START, NEXT, END = "<|start|>", "<|next|>", "<|end|>\n"
#: In the order of escaping; unescaping goes backward (fixed values).
ESCAPES = [("&", "&amp;"), ("<", "&lt;"), ("[", "&#91;")]
ROLE_ESCAPES = [*ESCAPES, ("\n", "&#10;")]
#: The role whose text a model is to learn.
LEARNED = "assistant"


def escaped(c: Column, escapes=ESCAPES) -> Column:
    for a, b in escapes:
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def unescaped(c: Column, escapes=ESCAPES) -> Column:
    for a, b in reversed(escapes):
        c = F.replace(c, F.lit(b), F.lit(a))
    return c


def _blocks(turns: Column) -> Column:
    """Turns (role, text) in order to blocks (role, parts)."""
    empty = F.expr("cast(array() as array<struct<role: string, parts: array<string>>>)")

    def step(done, turn):
        last = F.try_element_at(done, F.lit(-1))
        joined = F.struct(last["role"].alias("role"), F.concat(last["parts"], F.array(turn["text"])).alias("parts"))
        same = F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(joined))
        other = F.concat(done, F.array(F.struct(turn["role"].alias("role"), F.array(turn["text"]).alias("parts"))))
        return F.when(last["role"] == turn["role"], same).otherwise(other)

    return F.aggregate(turns, empty, step)


def _mask(blocks: Column) -> Column:
    """(from, to) of the learned texts in the formatted string, in code points from 0."""
    start = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<start: int, stop: int>>)").alias("spans"))

    def of_part(at, learned):
        def step(s, part):
            stop = s["at"] + F.char_length(part)
            spans = F.when(learned, F.concat(s["spans"], F.array(F.struct(s["at"].alias("start"), stop.alias("stop"))))).otherwise(s["spans"])
            return F.struct((stop + len(NEXT)).alias("at"), spans.alias("spans"))

        return step

    def of_block(s, block):
        inside = F.struct((s["at"] + len(START) + F.char_length(block["role"]) + 1).alias("at"), s["spans"].alias("spans"))
        after = F.aggregate(block["parts"], inside, of_part(s["at"], block["role"] == LEARNED))
        return F.struct((after["at"] - len(NEXT) + len(END)).alias("at"), after["spans"].alias("spans"))

    return F.aggregate(blocks, start, of_block, lambda s: s["spans"])


def format_chats(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv, formatted (the string), mask (spans of learned text) of each conversation.

    Rows go by turn (null turns first), ties by role and text; repeated rows stay. A null role or text counts as empty, rows with a null
    conversation form one. An empty table gives no rows. A conversation is one string, so one row and one task hold it whole, and the time for
    it grows with the square of its turns.
    """
    plain = F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    turns = df.select(F.col(conv).alias("conv"), plain.alias("t")).groupBy("conv").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    safe = F.transform("turns", lambda t: F.struct(escaped(t["role"], ROLE_ESCAPES).alias("role"), escaped(t["text"]).alias("text")))
    grouped = turns.select("conv", _blocks(safe).alias("blocks"))
    shown = F.transform("blocks", lambda b: F.concat(F.lit(START), b["role"], F.lit("\n"), F.array_join(b["parts"], NEXT), F.lit(END)))
    return grouped.select(F.col("conv").alias(conv), F.array_join(shown, "").alias("formatted"), _mask(F.col("blocks")).alias("mask"))


def read_back(formatted: DataFrame, text: str = "formatted") -> DataFrame:
    """Adds turns (role, text) read from formatted strings."""
    blocks = F.filter(F.split(text, F.lit(END.replace("|", "\\|"))), lambda b: b != "")
    body = lambda b: F.substr(b, F.lit(len(START) + 1))

    def turns(block):
        b = body(block)  # the first line feed ends the role
        role = unescaped(F.substr(b, F.lit(1), F.locate("\n", b) - 1), ROLE_ESCAPES)
        parts = F.split(F.substr(b, F.locate("\n", b) + 1), F.lit(NEXT.replace("|", "\\|")))
        return F.transform(parts, lambda p: F.struct(role.alias("role"), unescaped(p).alias("text")))

    return formatted.withColumn("turns", F.flatten(F.transform(blocks, turns)))


def op5_chat_format(spark, sf_dir: str) -> DataFrame:
    """All conversations, and one made of control strings, formatted and read back."""
    own = spark.sql("SELECT -7L AS conv_id, turn, role, '</s>[INST] ok [/INST]' AS text FROM VALUES (0L, 'user'), (1L, 'assistant') AS t(turn, role)")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    learned = F.array_join(F.transform("mask", lambda s: unescaped(F.substr("formatted", s["start"] + 1, s["stop"] - s["start"]))), "")
    out = read_back(format_chats(rows)).withColumn("loss", learned)
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(told, 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


OP5_SQL = r"""
WITH r AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -7, turn, role, '</s>[INST] ok [/INST]' FROM (VALUES (0, 'user'), (1, 'assistant')) AS t(turn, role)),
e AS (SELECT *, replace(replace(replace(role, '&', '&amp;'), '<', '&lt;'), '[', '&#91;') AS er, replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '[', '&#91;') AS et,
             lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS before FROM r)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length(et) + CASE WHEN before = role THEN 8 ELSE 9 + length(replace(er, chr(10), '&#10;')) + 1 + 8 END) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""
