"""Chat formatting: conversations rebuilt from an event log, then rendered.

An event is (conv_id, seq, msg, kind, role, text). Within a conversation events count in
order of seq. `start` and `delta` append their text to message `msg`; `edit` replaces what the
message held; `regenerate` discards the message's text and every later message that was
written before it. Everything is DataFrame operations over one shuffle by conversation.

Defined cases: null text and role count as empty, a null kind as `delta`, a null seq or msg
sorts first; events that tie on seq are taken in order of (msg, kind, role, text); repeated
rows are events of their own; a very long text or conversation is one string of one row, as the method
has it: a conversation is one window group and has to fit a task; a null conv_id is a conversation like any other; an empty table
gives no rows; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: role: what opens and closes its turns. Any other role is written by OTHER.
TURNS = {"user": ("[INST] ", " [/INST]"), "assistant": ("<s> ", " </s>"), "system": ("<<SYS>> ", " <</SYS>>")}
OTHER, NAMED, OTHER_END = "[ROLE] ", " [TEXT] ", " [/ROLE]"
#: A control string with any number of tildes after its bracket; escaping adds one tilde.
CONTROL = r"([\[<])(~*)(/?(?:INST|SYS|ROLE|TEXT|s))([\]>])"
TURN_END = r"(?<=\[/INST\]|</s>|<</SYS>>|\[/ROLE\])"


def escape(text: Column) -> Column:
    """No control string is left in the result, and `unescape` gives the text back."""
    return F.regexp_replace(text, CONTROL, "$1$2~$3$4")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, CONTROL.replace("(~*)", "~(~*)"), "$1$2$3$4")


def reconstruct(events: DataFrame) -> DataFrame:
    """Final messages (conv_id, msg, role, text) of an event log."""
    in_conv = W.partitionBy("conv_id")
    log = events.select(
        "conv_id",
        F.col("seq").cast("long").alias("seq"),
        F.col("msg").cast("long").alias("msg"),
        F.coalesce("kind", F.lit("delta")).alias("kind"),
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    log = log.withColumn("ord", F.row_number().over(in_conv.orderBy("seq", "msg", "kind", "role", "text")))
    anew = F.when(F.col("kind").isin("edit", "regenerate"), F.col("ord"))
    cut = F.when(F.col("kind") == "regenerate", F.col("ord"))
    log = log.withColumn("reset", F.max(anew).over(W.partitionBy("conv_id", "msg")))
    log = log.withColumn("cut", F.max(cut).over(in_conv.orderBy("msg").rangeBetween(W.unboundedPreceding, -1)))
    live = log.where((F.col("ord") >= F.coalesce("reset", F.lit(0))) & (F.col("ord") > F.coalesce("cut", F.lit(0))))
    parts = F.array_sort(F.collect_list(F.struct("ord", "text")))
    return live.groupBy("conv_id", "msg").agg(
        F.min_by("role", "ord").alias("role"),
        F.array_join(F.transform(parts, lambda p: p["text"]), "").alias("text"),
    )


def render(messages: DataFrame) -> DataFrame:
    """One row per conversation: formatted, and loss_spans, the (start, end) code points of assistant texts."""
    role, text = F.col("role"), escape(F.col("text"))
    opened, closed = F.concat(F.lit(OTHER), escape(role), F.lit(NAMED)), F.lit(OTHER_END)
    for name, (head, tail) in TURNS.items():
        opened, closed = F.when(role == name, F.lit(head)).otherwise(opened), F.when(role == name, F.lit(tail)).otherwise(closed)
    turns = messages.select("conv_id", "msg", "role", opened.alias("head"), text.alias("body"), closed.alias("tail"))
    turns = turns.withColumn("turn", F.concat("head", "body", "tail"))
    size = F.length("turn").cast("long")
    until = F.sum(size).over(W.partitionBy("conv_id").orderBy("msg").rowsBetween(W.unboundedPreceding, 0))
    turns = turns.withColumn("at", until - size + F.length("head"))
    kept = F.struct("msg", "turn", "at", (F.col("at") + F.length("body")).alias("to"), "role")
    whole = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(kept)).alias("t"))
    assistant = F.filter("t", lambda t: t["role"] == "assistant")
    return whole.select(
        "conv_id",
        F.array_join(F.transform("t", lambda t: t["turn"]), "").alias("formatted"),
        F.transform(assistant, lambda t: F.struct(t["at"].alias("start"), t["to"].alias("end"))).alias("loss_spans"),
    )


def parse(formatted: Column) -> Column:
    """The turns of a rendered conversation as array<struct<role, text>>."""

    def turn(t: Column) -> Column:
        def inner(head: str, tail: str) -> Column:
            return F.substring(t, F.lit(len(head) + 1), F.length(t) - len(head) - len(tail))

        other = inner(OTHER, OTHER_END)
        at = F.instr(other, NAMED)
        role, text = F.substring(other, F.lit(1), at - 1), F.substring(other, at + len(NAMED), F.length(other))
        for name, (head, tail) in TURNS.items():
            mine = t.startswith(head)
            role, text = F.when(mine, F.lit(name)).otherwise(role), F.when(mine, inner(head, tail)).otherwise(text)
        return F.struct(unescape(role).alias("role"), unescape(text).alias("text"))

    return F.transform(F.filter(F.split(formatted, TURN_END), lambda t: t != ""), turn)


def format_chats(events: DataFrame) -> DataFrame:
    """Reconstruct, then render."""
    return render(reconstruct(events))
