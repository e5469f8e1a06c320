"""Chat formatting in budgeted windows, with DataFrame functions only.

Prefix sums of turn tokens cut a conversation into turn-aligned spans: the token axis is divided into blocks, turns
that lie in one block form a span, and a turn that crosses a block's end is a span of its own.  No span exceeds its
budget unless a single turn does.  Every window after the first repeats the system turn and a limited history before
its span; repeated turns carry another marker and no loss, so each assistant turn is a target exactly once.

Template: ``<|turn|>role\\ntext<|end|>\\n``; repeated turns start with ``<|again|>``.  Inside roles and texts ``&``,
``<`` and ``[`` are written as character references (and line ends in roles), so no text can hold a marker, and
reading back restores it exactly.

Null text and null role are empty; a null turn comes first; rows of one turn number go by role, then text; repeated
rows are turns of their own.  An empty table gives no windows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskframe.llm.common import text_or_empty, words

#: Fixed values of the template.
TURN, AGAIN, END = "<|turn|>", "<|again|>", "<|end|>\n"
#: Words that a window may hold, and of these for repeated history and at least for its span.
BUDGET, HISTORY, LEAST_SPAN = 1024, 128, 128


def escape(text: Column, role: bool = False) -> Column:
    out = F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit("["), F.lit("&#91;"))
    return F.replace(out, F.lit("\n"), F.lit("&#10;")) if role else out


def unescape(text: Column) -> Column:
    out = F.replace(F.replace(text, F.lit("&#10;"), F.lit("\n")), F.lit("&#91;"), F.lit("["))
    return F.replace(F.replace(out, F.lit("&lt;"), F.lit("<")), F.lit("&amp;"), F.lit("&"))


def format_windows(conversations: DataFrame, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """(conv_id, lo, hi, formatted, loss) rows; windows of a conversation are in order of (lo, hi); loss holds
    (start, length) of target texts in code points."""
    in_order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    before = in_order.rowsBetween(Window.unboundedPreceding, -1)
    turns = (
        conversations.select("conv_id", "turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), text_or_empty().alias("text"))
        .withColumn("tokens", F.size(words(F.col("text"))).cast("long") + 1)
        .withColumn("pos", F.row_number().over(in_order))
        .withColumn("start", F.coalesce(F.sum("tokens").over(before), F.lit(0)))
        .withColumn("body", F.concat(escape(F.col("role"), True), F.lit("\n"), escape(F.col("text")), F.lit(END)))
    )
    system = (F.col("pos") == 1) & (F.col("role") == "system")
    one, two = F.lag("tokens", 1).over(in_order), F.lag("tokens", 2).over(in_order)
    first = F.first(F.when(system, F.struct("body", "tokens")))
    turns = (
        turns.withColumn("system", first.over(in_order.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("back", F.when((F.col("pos") - 1 <= F.when(F.col("system").isNull(), 0).otherwise(1)) | (one > history), 0)
                    .when((F.col("pos") - 2 <= F.when(F.col("system").isNull(), 0).otherwise(1)) | (one + two > history), 1).otherwise(2))
        .withColumn("past1", F.when(F.col("back") >= 1, F.lag("body", 1).over(in_order)))
        .withColumn("past2", F.when(F.col("back") == 2, F.lag("body", 2).over(in_order)))
    )
    room = F.greatest(F.lit(LEAST_SPAN), F.lit(budget - history) - F.coalesce(F.col("system.tokens"), F.lit(0)))
    again = lambda body: F.coalesce(F.concat(F.lit(AGAIN), body), F.lit(""))
    turns = (
        turns.withColumn("lo", F.floor(F.col("start") / room))
        .withColumn("hi", F.floor((F.col("start") + F.col("tokens") - 1) / room))
        .withColumn("context", F.concat(again(F.when(F.col("pos") > 1, F.col("system.body"))), again(F.col("past2")), again(F.col("past1"))))
    )
    in_span = Window.partitionBy("conv_id", "lo", "hi").orderBy("pos")
    piece = F.concat(F.lit(TURN), F.col("body"))
    ahead = F.coalesce(F.sum(F.length(piece)).over(in_span.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    lead = F.first("context").over(in_span)
    at = F.length(lead) + ahead + F.length(F.lit(TURN)) + F.length(escape(F.col("role"), True)) + 1
    target = F.struct(at.cast("long").alias("start"), F.length(escape(F.col("text"))).cast("long").alias("length"))
    spans = turns.select("conv_id", "lo", "hi", "pos", "context", piece.alias("piece"), F.when(F.col("role") == "assistant", target).alias("target"))
    parts = F.sort_array(F.collect_list(F.struct("pos", "piece")))
    return spans.groupBy("conv_id", "lo", "hi").agg(
        F.concat(F.min_by("context", "pos"), F.array_join(F.transform(parts, lambda p: p["piece"]), "")).alias("formatted"),
        F.sort_array(F.collect_list("target")).alias("loss"),
    )


def read_windows(windows: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns, loss, formatted_chars) read back from formatted windows: ``turns`` is role, line end,
    text, line end for each turn of its own, ``loss`` the unescaped text under the mask."""
    pieces = F.filter(F.split("formatted", r"<\|"), lambda p: p.startswith("turn|>"))
    read = windows.select(
        "conv_id", "lo", "hi", "loss",
        F.col("formatted"),
        F.transform(pieces, lambda p: F.substr(p, F.lit(len("turn|>") + 1))).alias("own"),
    )
    role = lambda p: unescape(F.substring_index(p, "\n", 1))
    text = lambda p: unescape(F.substr(p, F.instr(p, "\n") + 1))
    masked = F.transform("loss", lambda m: unescape(F.substr(F.col("formatted"), (m["start"] + 1).cast("int"), m["length"].cast("int"))))
    spans = read.select(
        "conv_id",
        F.struct(
            "lo", "hi",
            F.array_join(F.transform("own", lambda p: F.concat(role(p), F.lit("\n"), text(p), F.lit("\n"))), "").alias("turns"),
            F.array_join(masked, "").alias("loss"),
        ).alias("span"),
        F.size("own").cast("long").alias("n"),
        F.length("formatted").cast("long").alias("chars"),
    )
    whole = F.sort_array(F.collect_list("span"))
    return spans.groupBy("conv_id").agg(
        F.sum("n").alias("n_turns"),
        F.array_join(F.transform(whole, lambda s: s["turns"]), "").alias("turns"),
        F.array_join(F.transform(whole, lambda s: s["loss"]), "").alias("loss"),
        F.sum("chars").alias("formatted_chars"),
    )
