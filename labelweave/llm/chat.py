"""Chat formatting as relational algebra: sorted turn structs, runs of one role merged, all by Spark expressions.

Template: each run of turns of one role is <turn ROLE>TEXT</turn>, the texts of a run stand side by side with <part>
between them. All control strings start with "<"; in texts and roles "<" becomes \\l, ">" in roles \\g and the backslash
\\b, so no text can hold a control string and parse() gives back every turn as it was.

The loss mask is the list of spans (code points of the formatted text) of the assistant's texts.

Null text or role: the empty one. Rows with equal turn numbers are ordered by role, then text; a null turn comes first.
Repeated rows stay. Null conv_id: one conversation of its own. A conversation is one row, however long its texts. Other
columns go; their names clash with nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE, PART, ASSISTANT = "<turn ", "</turn>", "<part>", "assistant"


def escape(c: Column, role: bool = False) -> Column:
    c = F.replace(F.replace(c, F.lit("\\"), F.lit("\\b")), F.lit("<"), F.lit("\\l"))
    return F.replace(c, F.lit(">"), F.lit("\\g")) if role else c


def unescape(c: Column) -> Column:
    """Each backslash of an escaped text is the first of two characters, so these may go one after the other, \\b last."""
    for a, b in (("\\l", "<"), ("\\g", ">"), ("\\b", "\\")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def format_conversations(rows: DataFrame) -> DataFrame:
    """conv_id, formatted, loss (array of start, end) from rows of conv_id, turn, role, text."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    t = rows.select("conv_id", F.struct(F.col("turn").alias("turn"), text("role").alias("role"), text("text").alias("text")).alias("t"))
    t = t.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    first = lambda i: (i == 0) | (F.get("t", i)["role"] != F.get("t", i - 1)["role"])
    t = t.withColumn("starts", F.filter(F.sequence(F.lit(0), F.size("t") - 1), first))
    run = lambda a, j: F.slice("t", a + 1, F.coalesce(F.get("starts", j + 1), F.size("t")) - a)
    t = t.select("conv_id", F.transform("starts", run).alias("runs"))

    def segments(r: Column) -> Column:
        role = r[0]["role"]
        texts = F.flatten(F.transform(r, lambda x, i: F.array(_segment(F.when(i > 0, PART).otherwise(""), False), _segment(escape(x["text"]), x["role"] == ASSISTANT))))
        return F.concat(F.array(_segment(F.concat(F.lit(OPEN), escape(role, True), F.lit(">")), False)), texts, F.array(_segment(F.lit(CLOSE), False)))

    t = t.select("conv_id", F.flatten(F.transform("runs", segments)).alias("segments"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("loss"))

    def add(acc: Column, s: Column) -> Column:
        end = acc["at"] + F.length(s["text"])
        return F.struct(end.alias("at"), F.when(s["loss"], F.array_append(acc["loss"], F.struct(acc["at"].alias("start"), end.alias("end")))).otherwise(acc["loss"]).alias("loss"))

    return t.select("conv_id", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"), F.aggregate("segments", start, add, lambda a: a["loss"]).alias("loss"))


def _segment(text: Column, loss) -> Column:
    return F.struct(text.alias("text"), (loss if isinstance(loss, Column) else F.lit(loss)).alias("loss"))


def parse(formatted: Column) -> Column:
    """The turns of a formatted text: array of role, text, one for each row that went in."""
    blocks = F.filter(F.split(formatted, CLOSE), lambda b: b != "")

    def turns(b: Column) -> Column:
        head = F.substring_index(b, ">", 1)
        role = unescape(F.substring(head, F.lit(len(OPEN) + 1), F.length(head)))
        return F.transform(F.split(F.substring(b, F.length(head) + 2, F.length(b)), PART), lambda p: F.struct(role.alias("role"), unescape(p).alias("text")))

    return F.flatten(F.transform(blocks, turns))


def loss_text(formatted: Column, loss: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(loss, lambda s: unescape(F.substring(formatted, s["start"] + 1, s["end"] - s["start"]))), "")
