"""Chat formatting: budgeted, turn-aligned windows with a loss mask, and the reader that undoes them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern.llm.common import only, table

TURN, SAYS, END = "<|turn|>", "<|says|>", "<|end|>"
#: What no text may hold once it is escaped: the start of any mark of this template, and the marks of two common others.
CONTROL = r"<(?=\||/?s>)|\[(?=/?INST\])"


def escaped(text: Column) -> Column:
    """Doubles backslashes, then puts one after the first character of each control string."""
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), CONTROL, r"$0\\")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def windows(turns: DataFrame, *, budget: int = 512, history: int = 128, history_turns: int = 4, token_bytes: int = 4) -> DataFrame:
    """conv_id, window (a, b: in order), formatted, context (how many leading turns are repeats), loss (spans).

    A turn's tokens are its formatted bytes / ``token_bytes``, rounded up.  With P the tokens of the turns before it,
    and ``room`` what the budget leaves beside the system turn and the history (a quarter of it at least), a turn from
    P to P + n lies in cell a = P / room up to cell b = (P + n - 1) / room.  Turns of equal (a, b) form a window: those
    within one cell fit in together, and one that reaches over a border, of whatever length, is a window of its own.
    So no turn is cut, windows depend on prefix sums only, and each begins with the system turn (a first turn of that
    role) and up to ``history_turns`` preceding turns, of ``history`` tokens or what the budget spares, both repeated
    without loss.  Only a turn that alone exceeds the budget makes a window that does.  The
    spans of ``loss`` (code points, end exclusive) are the texts of new assistant turns.
    """
    x = only(turns, "conv_id", "turn", "role", "text").withColumn("role", F.coalesce("role", F.lit(""))).withColumn("text", F.coalesce("text", F.lit("")))
    x = x.withColumn("head", F.concat(F.lit(TURN), escaped(F.col("role")), F.lit(SAYS))).withColumn("body", escaped(F.col("text")))
    x = x.withColumn("seg", F.concat("head", "body", F.lit(END)))
    order = W.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    so_far = order.rowsBetween(W.unboundedPreceding, -1)
    x = x.withColumn("i", F.row_number().over(order))
    x = x.withColumn("system", (F.col("i") == 1) & (F.col("role") == "system"))
    n = F.ceil(F.octet_length("seg") / F.lit(token_bytes)).cast("long")
    x = x.withColumn("n", F.when(F.col("system"), 0).otherwise(n))
    first = order.rowsBetween(W.unboundedPreceding, W.currentRow)
    x = x.withColumn("sys_seg", F.coalesce(F.first(F.when(F.col("system"), F.col("seg")), ignorenulls=True).over(first), F.lit("")))
    x = x.withColumn("before", F.coalesce(F.sum("n").over(so_far), F.lit(0))).withColumn("chars", F.coalesce(F.sum(F.length("seg")).over(so_far), F.lit(0)))
    room = F.greatest(F.lit(budget - history) - F.ceil(F.octet_length("sys_seg") / F.lit(token_bytes)), F.lit(max(1, budget // 4)))
    cell = lambda p: F.floor(p / room).cast("long")
    x = x.withColumn("a", cell(F.col("before"))).withColumn("b", cell(F.col("before") + F.greatest(F.col("n"), F.lit(1)) - 1))
    x = x.withColumn("b", F.when(F.col("system"), F.coalesce(F.lead("b").over(order), F.col("b"))).otherwise(F.col("b")))
    past = F.collect_list(F.struct("before", "system", "seg")).over(order.rowsBetween(-history_turns, -1))
    starts = (F.col("i") == 1) | (F.lag("a").over(order) != F.col("a")) | (F.lag("b").over(order) != F.col("b"))
    x = x.withColumn("past", F.when(starts, past))
    x = x.groupBy("conv_id", "a", "b").agg(
        F.sort_array(F.collect_list(F.struct("i", "chars", F.length("head").alias("h"), F.length("body").alias("t"), (F.col("role") == "assistant").alias("asks"), "seg"))).alias("new"),
        F.min_by("past", "i").alias("past"),
        F.first("sys_seg").alias("sys_seg"),
        F.min("before").alias("from"),
        F.sum("n").alias("own"),
    )
    spare = F.lit(budget) - F.ceil(F.octet_length("sys_seg") / F.lit(token_bytes)) - F.col("own")
    x = x.withColumn("spare", F.least(F.lit(history), spare))
    x = x.withColumn("past", F.filter("past", lambda h: ~h.system & (F.col("from") - h.before <= F.col("spare"))))
    x = x.withColumn("sys_seg", F.when(F.col("new")[0].i == 1, F.lit("")).otherwise(F.col("sys_seg")))
    x = x.withColumn("prefix", F.concat("sys_seg", F.array_join(F.transform("past", lambda h: h.seg), "")))
    start = lambda t: F.length("prefix") + t.chars - F.col("new")[0].chars + t.h
    return x.select(
        "conv_id",
        F.struct("a", "b").alias("window"),
        F.concat("prefix", F.array_join(F.transform("new", lambda t: t.seg), "")).alias("formatted"),
        (F.size("past") + (F.col("sys_seg") != "").cast("int")).alias("context"),
        F.transform(F.filter("new", lambda t: t.asks), lambda t: F.struct(start(t).cast("int").alias("start"), (start(t) + t.t).cast("int").alias("end"))).alias("loss"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, turns (role, text), loss (text under the mask, unescaped), formatted_chars, from windows() alone."""
    parts = F.split("formatted", r"<\|turn\|>", -1)  # before the first mark there is nothing
    new = F.slice(parts, F.col("context") + 2, F.size(parts))
    turn = lambda s: F.struct(unescaped(F.substring_index(s, SAYS, 1)).alias("role"), unescaped(F.substring_index(F.substring_index(s, SAYS, -1), END, 1)).alias("text"))
    x = formatted.select(
        "conv_id",
        "window",
        F.transform(new, turn).alias("turns"),
        F.array_join(F.transform("loss", lambda s: unescaped(F.substring(F.col("formatted"), s.start + 1, s.end - s.start))), "").alias("loss"),
        F.length("formatted").cast("long").alias("chars"),
    )
    x = x.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("window", "turns", "loss"))).alias("w"), F.sum("chars").alias("formatted_chars"))
    return x.select("conv_id", F.flatten(F.transform("w", lambda w: w.turns)).alias("turns"), F.array_join(F.transform("w", lambda w: w.loss), "").alias("loss"), "formatted_chars")


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Formats every conversation, and conversation -1, and reads it back.

    Turns are ordered by turn (null first), then role, then text, so ties and repeated rows have a place each.  Null
    text or role: empty.  Rows of null conv_id are one conversation.  An empty table leaves conversation -1.  A turn of
    any length is one span; the digest of a conversation needs all its turns in one row.  Further columns are not read.
    """
    x = only(table(spark, sf_dir, "conversations"), "conv_id", "turn", "role", "text")
    said = F.lit("</s>[INST] ok [/INST]")
    more = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, F.lit("user")).otherwise(F.lit("assistant")).alias("role"), said.alias("text"))
    x = read_back(windows(x.unionByName(more)))
    return x.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss"), 256).alias("loss_sha256"),
        "formatted_chars",
    )
