"""Chat formatting by event-sourced reconstruction, in DataFrame functions alone.

A conversation is a log of events; the log is partitioned by conversation, sorted by sequence number and
folded into final messages, which are rendered through a template. Events (column kind):

  message     opens a message with its role and text
  delta       adds its text to the message it belongs to
  edit        replaces the text of the message it belongs to
  regenerate  empties the message it belongs to and drops every message that was opened after it

An event belongs to the message number in column message, or, if that is null, to the latest one opened.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
#: What must not occur in a rendered text: the template's own marks and those of other chat templates.
CONTROL = (OPEN, CLOSE, "<|endoftext|>", "<|system|>", "<|user|>", "<|assistant|>", "<s>", "</s>", "<<SYS>>", "<</SYS>>", "[INST]", "[/INST]")
_RESTS = "|".join("".join(f"\\{c}" if not c.isalnum() and c != "_" else c for c in mark[1:]) for mark in CONTROL)


def escape(text: Column) -> Column:
    """Adds a backslash after the first character of every control string, and of those already escaped."""
    return F.regexp_replace(text, rf"([<\[])(\\*)(?={_RESTS})", r"$1\\$2")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, rf"([<\[])\\(\\*)(?={_RESTS})", "$1$2")


def fold(events: DataFrame) -> DataFrame:
    """conv_id, message, role, text: the final messages (numbers from 1, as they were opened).

    events: conv_id, seq, kind, message, role, text. Equal sequence numbers are ordered by kind (regenerate, message, edit, delta), role and text;
    a null text is empty, a null role is an empty one, unknown kinds and events that belong to no message are
    left out. A null conv_id is a conversation of its own.
    """
    log = events.select("conv_id", "seq", F.col("kind"), F.col("message").cast("bigint").alias("message"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    log = log.filter(F.col("kind").isin("message", "delta", "edit", "regenerate"))
    at = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("seq"), F.desc("kind"), "role", "text")
    log = log.withColumn("opened", F.sum((F.col("kind") == "message").cast("bigint")).over(at.rowsBetween(Window.unboundedPreceding, Window.currentRow))).withColumn("place", F.row_number().over(at).cast("bigint"))
    log = log.withColumn("message", F.when(F.col("kind") == "message", F.col("opened")).otherwise(F.coalesce("message", "opened")))
    # a later regenerate of an earlier message drops this one
    cut = F.min(F.when(F.col("kind") == "regenerate", F.col("message"))).over(Window.partitionBy("conv_id").orderBy(F.desc("place")).rowsBetween(Window.unboundedPreceding, -1))
    log = log.withColumn("cut", cut)
    one = log.groupBy("conv_id", "message").agg(
        F.max(F.when(F.col("kind") == "message", F.struct("role", "cut"))).alias("head"),
        F.max(F.when(F.col("kind") != "delta", F.col("place"))).alias("reset"),
        F.array_sort(F.collect_list(F.struct("place", "kind", "text"))).alias("events"),
    )
    one = one.filter(F.col("head").isNotNull() & ~F.coalesce(F.col("head.cut") < F.col("message"), F.lit(False)))
    kept = F.filter("events", lambda e: (e["place"] >= F.col("reset")) & (e["kind"] != "regenerate"))
    return one.select("conv_id", "message", F.col("head.role").alias("role"), F.array_join(F.transform(kept, lambda e: e["text"]), "").alias("text"))


def render(messages: DataFrame, loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """conv_id, formatted, loss: the text of each conversation, and the code points [start, end) under the loss.

    A turn is <|im_start|>, the role (percent-encoded, so it holds no mark or line break), a line break, the escaped
    text, <|im_end|> and a line break. Texts of the loss roles are under the loss, without their marks.
    """
    head = F.concat(F.lit(OPEN), F.url_encode("role"), F.lit("\n"))
    turns = messages.select("conv_id", "message", "role", head.alias("head"), escape(F.col("text")).alias("body"))
    turns = turns.withColumn("piece", F.concat("head", "body", F.lit(CLOSE + "\n")))
    before = Window.partitionBy("conv_id").orderBy("message").rowsBetween(Window.unboundedPreceding, -1)
    turns = turns.withColumn("start", F.coalesce(F.sum(F.length("piece").cast("bigint")).over(before), F.lit(0)) + F.length("head"))
    span = F.when(F.col("role").isin(*loss_roles), F.struct(F.col("start"), (F.col("start") + F.length("body")).alias("end")))
    gathered = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("message", "piece", span.alias("span")))).alias("t"))
    spans = F.filter(F.transform("t", lambda x: x["span"]), lambda s: s.isNotNull())
    return gathered.select("conv_id", F.array_join(F.transform("t", lambda x: x["piece"]), "").alias("formatted"), spans.alias("loss"))


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, masked, formatted_chars: the turns of render()'s output, read from its text and
    spans; masked is the unescaped text under the loss, or null.

    Turns and spans of a conversation meet by their place in the text, so the work is in proportion to it."""
    mark = "".join(f"\\{c}" if not c.isalnum() and c != "_" else c for c in OPEN)
    lead, tail = len(OPEN), len(CLOSE) + 1
    none = F.lit(None).cast("bigint")
    turns = F.transform(F.split("formatted", mark), lambda p, i: F.struct(i.cast("bigint").alias("turn"), p.alias("piece"), none.alias("start"), none.alias("end")))
    spans = F.transform("loss", lambda s: F.struct(none.alias("turn"), F.lit(None).cast("string").alias("piece"), s["start"].alias("start"), s["end"].alias("end")))
    rows = formatted.select("conv_id", F.length("formatted").cast("bigint").alias("formatted_chars"), F.inline(F.concat(turns, spans))).filter("turn is null or turn > 0")
    before = Window.partitionBy("conv_id").orderBy(F.asc_nulls_last("turn")).rowsBetween(Window.unboundedPreceding, -1)
    at = F.coalesce(F.sum(F.length("piece").cast("bigint") + lead).over(before), F.lit(0)) + lead + F.instr("piece", "\n")
    rows = rows.withColumn("start", F.coalesce("start", at))
    met = rows.groupBy("conv_id", "start").agg(F.max("turn").alias("turn"), F.max("piece").alias("piece"), F.max("end").alias("end"), F.max("formatted_chars").alias("formatted_chars"))
    met = met.withColumn("head", F.instr("piece", "\n"))
    body = unescape(F.expr(f"substring(piece, head + 1, length(piece) - head - {tail})"))
    masked = F.when(F.col("end").isNotNull(), unescape(F.expr("substring(piece, head + 1, cast(end - start as int))")))
    return met.select("conv_id", "turn", F.url_decode(F.expr("substring(piece, 1, head - 1)")).alias("role"), body.alias("text"), masked.alias("masked"), "formatted_chars")


def digests(formatted: DataFrame) -> DataFrame:
    """n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars of each conversation, read back from its text."""
    turns = read_back(formatted).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text", "masked"))).alias("t"), F.max("formatted_chars").alias("formatted_chars"))
    said = F.array_join(F.transform("t", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    masked = F.array_join(F.transform("t", lambda x: F.coalesce(x["masked"], F.lit(""))), "")
    out = turns.select("conv_id", F.size("t").cast("bigint").alias("n_turns"), F.sha2(said.cast("binary"), 256).alias("turns_sha256"), masked.alias("m"), "formatted_chars")
    return out.select("conv_id", "n_turns", "turns_sha256", F.length("m").cast("bigint").alias("loss_chars"), F.sha2(F.col("m").cast("binary"), 256).alias("loss_sha256"), "formatted_chars")


def events_of(conversations: DataFrame) -> DataFrame:
    """The event log of a table of finished turns: one message event a row, in the order of turn."""
    return conversations.select("conv_id", F.col("turn").alias("seq"), F.lit("message").alias("kind"), F.lit(None).cast("bigint").alias("message"), "role", "text")
