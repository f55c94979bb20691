"""Chat formatting by prefix-target expansion, in native expressions only.

A conversation's turns, in turn order, are rendered one after another. Every assistant turn becomes an
example of its own: all turns before it as context, then that turn, of which only the reply text is
trainable. A conversation whose last turn is not the assistant's also gives one example without a
target, so that no turn is lost.

Template: ``<|im_start|>`` role ``<|im_sep|>`` text ``<|im_end|>``. Control strings inside roles and texts are
made inert by a backslash after their first character, and every backslash of the input is doubled, so
reading back is exact: a backslash followed by any character stands for that character.

Defined results: a null role or text counts as empty; a null conv_id is a conversation like any other;
turns with the same number are ordered by role, then text, and repeated rows are kept; an empty input
gives an empty output; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
#: Strings that this template or other common ones give a meaning; each is escaped inside texts.
CONTROL = ("<|", "</s>", "<s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")


def escape(text: Column) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for mark in CONTROL:
        out = F.replace(out, F.lit(mark), F.lit(f"{mark[0]}\\{mark[1:]}"))
    return out


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def format_conversations(turns: DataFrame) -> DataFrame:
    """One row for each example: conv_id, example, text, loss_start, loss_end (code points), trainable."""
    clean = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rendered = clean.select(
        "conv_id",
        F.struct(
            "turn",
            "role",
            "text",
            F.concat(F.lit(START), escape(F.col("role")), F.lit(SEP), escape(F.col("text")), F.lit(END)).alias("shown"),
            F.length(escape(F.col("text"))).alias("target"),
        ).alias("t"),
    )
    gathered = rendered.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    last = F.size("turns") - 1
    places = F.filter(F.sequence(F.lit(0), last), lambda i: (F.get("turns", i)["role"] == "assistant") | (i == last))
    examples = gathered.select("conv_id", "turns", F.posexplode(places).alias("example", "at"))
    end = F.get("turns", F.col("at"))
    text = F.array_join(F.transform(F.slice("turns", F.lit(1), F.col("at") + 1), lambda t: t["shown"]), "")
    out = examples.select("conv_id", "example", text.alias("text"), (end["role"] == "assistant").alias("trainable"), end["target"].alias("target"))
    stop = F.length("text") - len(END)
    return out.select(
        "conv_id",
        "example",
        "text",
        F.when(F.col("trainable"), stop - F.col("target")).otherwise(F.length("text")).alias("loss_start"),
        F.when(F.col("trainable"), stop).otherwise(F.length("text")).alias("loss_end"),
        "trainable",
    )


def masked_text(examples: DataFrame) -> Column:
    """What the loss mask covers, as it was before escaping."""
    return unescape(F.substring("text", F.col("loss_start") + 1, F.col("loss_end") - F.col("loss_start")))


def read_turns(text: Column) -> Column:
    """The turns of a formatted text: array<struct<role, text>>."""
    pieces = F.split(text, r"<\|im_end\|>", -1)
    pieces = F.slice(pieces, F.lit(1), F.size(pieces) - 1)
    halves = F.transform(pieces, lambda p: F.split(p, r"<\|im_sep\|>", -1))
    return F.transform(halves, lambda h: F.struct(unescape(F.substring(F.get(h, F.lit(0)), len(START) + 1, 1 << 30)).alias("role"), unescape(F.get(h, F.lit(1))).alias("text")))


def op2_chat(conversations: DataFrame) -> DataFrame:
    """Digests of every conversation, all read back from the formatted examples."""
    spark = conversations.sparkSession
    probe = spark.sql("SELECT CAST(-1 AS BIGINT) AS conv_id, CAST(n AS BIGINT) AS turn, r AS role, '</s>[INST] ok [/INST]' AS text FROM VALUES (0, 'user'), (1, 'assistant') AS v(n, r)")
    examples = format_conversations(conversations.select("conv_id", "turn", "role", "text").unionByName(probe))
    shown = examples.select("conv_id", "example", "text", masked_text(examples).alias("loss"))
    per = shown.groupBy("conv_id").agg(
        F.max_by("text", "example").alias("longest"),
        F.array_sort(F.collect_list(F.struct("example", "loss"))).alias("losses"),
        F.sum(F.length("text").cast("long")).alias("formatted_chars"),
    )
    read = per.select("conv_id", read_turns(F.col("longest")).alias("turns"), F.array_join(F.transform("losses", lambda x: x["loss"]), "").alias("loss"), "formatted_chars")
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(lines, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss"), 256).alias("loss_sha256"),
        "formatted_chars",
    )


def _sql_escape(expression: str) -> str:
    out = f"replace({expression}, '\\', '\\\\')"
    for mark in CONTROL:
        out = f"replace({out}, '{mark}', '{mark[0]}\\{mark[1:]}')"
    return out


OP2_SQL = f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, n, r, '</s>[INST] ok [/INST]' FROM (VALUES (0, 'user'), (1, 'assistant')) v(n, r)),
n AS (SELECT *, row_number() OVER w AS i, count(*) OVER (PARTITION BY conv_id) AS n,
  sum({len(START) + len(SEP) + len(END)} + length({_sql_escape("role")}) + length({_sql_escape("text")})) OVER (w ROWS UNBOUNDED PRECEDING) AS upto
  FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text))
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(upto) FILTER (role = 'assistant' OR i = n) AS BIGINT) AS formatted_chars
FROM n GROUP BY conv_id
"""
