"""Chat formatting, relationally: Spark expressions only.

A conversation's turns are collected as structs and sorted by (turn, role, text);
adjacent turns of one role become one block, their texts parted by a separator mark;
the pieces are concatenated and the code points of assistant texts give the loss mask.

    <turn>user</role>first text<sep/>second text</turn><turn>assistant</role>...

Control strings inside roles and texts are escaped with a backslash inside them (`<` to
`<\\` before `turn>`, `sep/>`, `/turn>`, `/role>`; `\\` to `\\\\`), so a mark never occurs
in a text, and unescaping gives back each character.

Nulls: a null text or role counts as empty, a null turn sorts first, rows with a null
conversation id form one conversation. Repeated rows and tied turns stay, each as a turn
of its own. Empty texts give empty turns, very long ones are kept whole. An empty table gives no conversation. Extra
columns are not read. A conversation is one output string, so its rows meet in one task
by definition; only the turns of one conversation do.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURN, ROLE_END, SEP, TURN_END = "<turn>", "</role>", "<sep/>", "</turn>"
LEARNED = "assistant"


def escape(text: Column) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for mark in (TURN, ROLE_END, SEP, TURN_END):
        out = F.replace(out, F.lit(mark), F.lit(f"<\\{mark[1:]}"))
    return out


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def format_conversations(df: DataFrame) -> DataFrame:
    """conv_id, formatted string, loss array<struct<start long, length long>> in code
    points of formatted (start from 0)."""
    turns = df.select(
        "conv_id",
        F.struct(
            F.col("turn").alias("turn"),
            F.coalesce(F.col("role"), F.lit("")).alias("role"),
            F.coalesce(F.col("text"), F.lit("")).alias("text"),
        ).alias("t"),
    )
    grouped = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    # One struct a turn: the marks before its text, the escaped text, and if it is learned.
    # A turn opens a block unless the one before has its role; the fold that
    # follows joins the pieces of all blocks.
    pieces = F.expr(
        f"""transform(turns, (t, i) -> named_struct(
              'opens', i = 0 OR turns[greatest(i - 1, 0)].role <> t.role,
              'first', i = 0, 'role', t.role, 'text', t.text))"""
    )
    marked = grouped.select("conv_id", pieces.alias("p")).select(
        "conv_id",
        F.transform(
            "p",
            lambda p: F.struct(
                F.when(
                    p["opens"],
                    F.concat(F.when(p["first"], F.lit(TURN)).otherwise(F.lit(TURN_END + TURN)), escape(p["role"]), F.lit(ROLE_END)),
                )
                .otherwise(F.lit(SEP))
                .alias("before"),
                escape(p["text"]).alias("text"),
                (p["role"] == F.lit(LEARNED)).alias("learned"),
            ),
        ).alias("p"),
    )
    # Where texts start: sums within runs of about the root of the number of turns, on top of the sums of the
    # runs, so that a long conversation costs far less than the square of its turns.
    sized = marked.withColumn("n", F.transform("p", lambda p: (F.length(p["before"]) + F.length(p["text"])).cast("long")))
    sized = sized.withColumn("w", F.ceil(F.sqrt(F.size("n"))).cast("int"))
    sized = sized.withColumn("runs", F.transform(F.sequence(F.lit(0), F.floor((F.size("n") - 1) / F.col("w")).cast("int")), lambda k: F.slice("n", k * F.col("w") + 1, F.col("w"))))
    sized = sized.withColumn("tops", _sums_before(F.transform("runs", lambda r: F.aggregate(r, F.lit(0).cast("long"), lambda s, x: s + x)), F.lit(0).cast("long")))
    sized = sized.withColumn("at", F.flatten(F.transform("runs", lambda r, k: _sums_before(r, F.get(F.col("tops"), k)))))
    spans = F.transform("p", lambda p, k: F.struct(p["learned"].alias("learned"), (F.get(F.col("at"), k) + F.length(p["before"])).alias("start"), F.length(p["text"]).cast("long").alias("length")))
    loss = F.transform(F.filter(spans, lambda s: s["learned"]), lambda s: F.struct(s["start"].alias("start"), s["length"].alias("length")))
    text = F.concat(F.array_join(F.transform("p", lambda p: F.concat(p["before"], p["text"])), ""), F.lit(TURN_END))
    return sized.select("conv_id", text.alias("formatted"), loss.alias("loss"))


def _sums_before(values: Column, start: Column) -> Column:
    """For each value, start and the sum of the values before it."""
    zero = F.struct(start.alias("at"), F.array().cast("array<bigint>").alias("out"))
    return F.aggregate(values, zero, lambda acc, x: F.struct((acc["at"] + x).alias("at"), F.array_append(acc["out"], acc["at"]).alias("out")), lambda acc: acc["out"])


def read_back(formatted: DataFrame) -> DataFrame:
    """The turns of each formatted conversation again: conv_id, turns array<struct<role,
    text>>, loss_text (all text under the mask, unescaped)."""
    blocks = F.filter(F.split("formatted", TURN_END), lambda b: b != "")
    turns = F.flatten(
        F.transform(
            blocks,
            lambda b: F.transform(
                F.split(F.substring_index(b, ROLE_END, -1), SEP),
                lambda s: F.struct(unescape(F.substring(F.substring_index(b, ROLE_END, 1), len(TURN) + 1, 2147483647)).alias("role"), unescape(s).alias("text")),
            ),
        )
    )
    learned = F.array_join(
        F.transform("loss", lambda s: unescape(F.substr(F.col("formatted"), (s["start"] + 1).cast("int"), s["length"].cast("int")))), ""
    )
    return formatted.select("*", turns.alias("turns"), learned.alias("loss_text"))
