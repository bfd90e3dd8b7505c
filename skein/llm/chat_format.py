"""Chat formatting with Spark expressions only.

Turns of a conversation are collected as structs and sorted; adjacent turns of
one role become one block by array aggregation; blocks are concatenated.  The
block is ``<|im_start|>role\\n text <|im_sep|> text ... <|im_end|>\\n``: merged
turns keep their boundary, so that the output can be read back turn by turn.

Texts are escaped: a backslash is doubled, and control strings (these and the
ones other templates use) get a backslash after their first character.  Roles
are percent-encoded.  :func:`parse` undoes both.

Nulls, ties and edges: null text is empty; a null role is the empty role; a null
turn sorts first; equal turns are ordered by role, then text; rows with a null
conv_id form one conversation; an empty table gives an empty result; columns
beyond conv_id, turn, role and text are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
#: What follows the first character, < or [, of a control string.
_TAILS = r"\|im_start\|>|\|im_sep\|>|\|im_end\|>|/?s>|/?INST\]|<SYS>>|</SYS>>"
#: The role whose texts are trained on.
LOSS_ROLE = "assistant"


def escape(text: Column) -> Column:
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), rf"([<\[])({_TAILS})", r"$1\\$2")


def unescape(text: Column) -> Column:
    return F.replace(F.regexp_replace(text, rf"([<\[])\\({_TAILS})", "$1$2"), F.lit("\\\\"), F.lit("\\"))


def format_chats(turns: DataFrame) -> DataFrame:
    """(conv_id, formatted) of rows (conv_id, turn, role, text)."""
    turn = F.struct(
        turns["turn"].alias("turn"),
        F.coalesce(turns["role"], F.lit("")).alias("role"),
        F.coalesce(turns["text"], F.lit("")).alias("text"),
    )
    chats = turns.groupBy(turns["conv_id"].alias("conv_id")).agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    # a block begins where the role differs from the turn before
    begun = F.transform(
        "turns",
        lambda t, i: F.concat(
            F.when((i > 0) & (t["role"] == F.get("turns", i - 1)["role"]), F.lit(SEP)).otherwise(
                F.concat(F.when(i > 0, F.lit(END + "\n")).otherwise(F.lit("")), F.lit(START), F.url_encode(t["role"]), F.lit("\n"))
            ),
            escape(t["text"]),
        ),
    )
    return chats.select("conv_id", F.concat(F.array_join(begun, ""), F.lit(END + "\n")).alias("formatted"))


def parse(formatted: Column) -> Column:
    """The turns, array<struct<role, text>>, of a formatted chat."""
    blocks = F.split(F.left(formatted, F.length(formatted) - (len(END) + 1)), r"<\|im_end\|>\n", -1)

    def turns(block: Column) -> Column:
        head = F.locate("\n", block)
        role = F.url_decode(F.substring(block, F.lit(len(START) + 1), head - (len(START) + 1)))
        body = F.substring(block, head + 1, F.length(block))
        return F.transform(F.split(body, r"<\|im_sep\|>", -1), lambda s: F.struct(role.alias("role"), unescape(s).alias("text")))

    return F.flatten(F.transform(blocks, turns))


def read_back(chats: DataFrame) -> DataFrame:
    """What :func:`format_chats`' output holds: digests of its turns and of the text under the loss mask."""
    parsed = chats.select("conv_id", "formatted", parse(F.col("formatted")).alias("turns"))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform(F.filter("turns", lambda t: t["role"] == LOSS_ROLE), lambda t: t["text"]), "")
    return parsed.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(told, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and number -7, whose texts hold control strings."""
    odd = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit("</s>[INST] ok [/INST]").alias("text"),
    )
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    return read_back(format_chats(rows.unionByName(odd)))


SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), b AS (
  SELECT *, CASE WHEN lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) = role THEN 0 ELSE 1 END AS begins,
         regexp_replace(replace(text, '\', '\\'),
           '([<\[])(\|im_start\|>|\|im_sep\|>|\|im_end\|>|/?s>|/?INST\]|<SYS>>|</SYS>>)', '\1\\\2', 'g') AS escaped
  FROM c
)
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       (sum(length(escaped)) + sum(CASE WHEN begins = 1 THEN 12 + length(url_encode(role)) + 1 + 11 ELSE 10 END))::BIGINT AS formatted_chars
FROM b GROUP BY conv_id
"""
