"""Conversations as budgeted training windows with loss masks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from debtscope.llm.shared import stored, text_of
from debtscope.operators.running import running

START, END = "<|im_start|>", "<|im_end|>"
#: Consecutive turns of a conversation are put in order in stretches of so many turn numbers.
STRETCH = 512


def escape(text: Column) -> Column:
    """A text in which no control string can occur."""
    return F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<|"), F.lit("&lt;|"))


def unescape(text: Column) -> Column:
    """The text that ``escape`` was given."""
    return F.replace(F.replace(text, F.lit("&lt;|"), F.lit("<|")), F.lit("&amp;"), F.lit("&"))


def _escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("&#10;"))


def _unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("&#10;"), F.lit("\n")))


def token_count(text: Column) -> Column:
    """Words and single marks of a text: the budget's unit."""
    return F.regexp_count(text, F.lit(r"[\p{L}\p{N}]+|[^\s\p{L}\p{N}]")).cast("long")


def chat_windows(
    turns: DataFrame, budget: int = 1024, history: int = 256, overhead: int = 4, trained_role: str = "assistant"
) -> DataFrame:
    """Format conversations as windows of whole turns within a token budget.

    ``turns`` has ``conv_id, turn, role, text``; other columns are ignored. The
    leading system turn of a conversation opens each of its windows. Prefix
    sums of tokens (``overhead`` more per turn for its marks) cut the other
    turns into spans, as long as the budget leaves beside the system turn and
    ``history``: a turn belongs to the span in which it starts, and one that
    would overflow its span stands alone. Each window repeats turns before its
    first as far as ``history`` tokens and the budget reach. A window
    passes the budget only where the system turn and one single turn do.

    Returns ``conv_id, window, formatted, mask, turns, n_tokens``. ``mask`` has
    a ``start`` (0-based code point) and ``length`` for each trained text that
    is new in the window; repeated turns carry none, so each is learnt once.
    ``turns`` tells the place and whether it is new, for each turn in the
    window. Rows are ordered by turn, role and text; null turns come first,
    null roles and texts are empty, and a null ``conv_id`` is a conversation.

    No conversation is put in order in one task: stretches of turn numbers are
    summed first, and a window gathers no more than its budget or one turn.
    Turns with their sums are stored once; what goes where is worked out from
    numbers, and texts move again only to their windows.
    """
    rows = turns.select(
        "conv_id",
        "turn",
        F.coalesce("role", F.lit("")).alias("role"),
        text_of("text").alias("text"),
    ).withColumn("_c", F.coalesce(F.concat(F.lit("c"), F.col("conv_id").cast("string")), F.lit("none")))
    rows = rows.withColumn("_tokens", token_count(F.col("text")) + overhead)
    order = [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    stretch = F.coalesce(F.floor(F.col("turn") / STRETCH), F.lit(-(2**62)))
    sums = {"_nth": F.lit(1).cast("long"), "_upto": F.col("_tokens")}
    said = stored(running(rows, ["_c"], stretch, order, sums=sums), "chat-turns")

    # Numbers only from here to the list of which turn goes into which window.
    leads = (F.col("_nth") == 1) & (F.col("role") == "system")
    numbers = said.select("_c", "_nth", "_tokens", "_upto", leads.alias("_lead"))
    opens = said.where(leads).select(F.col("_c").alias("_sc"), F.col("_tokens").alias("_st"))
    room = F.greatest(F.lit(budget) - F.coalesce("_st", F.lit(0)), F.lit(1))
    spans = (
        numbers.join(opens, F.col("_c") == F.col("_sc"), "left")
        .withColumn("_room", room)
        .withColumn("_span", F.greatest(F.col("_room") - history, F.lit(1)))
        .withColumn("_upto", F.col("_upto") - F.coalesce("_st", F.lit(0)))
        .withColumn("_from", F.col("_upto") - F.col("_tokens"))
        .withColumn("_cell", F.floor(F.col("_from") / F.col("_span")))
        .withColumn("_window", F.col("_cell") * 2 + (F.col("_upto") > (F.col("_cell") + 1) * F.col("_span")).cast("long"))
    )
    turns_of = spans.where(~F.col("_lead"))
    heads = turns_of.groupBy("_c", "_cell", "_window").agg(
        F.min("_from").alias("_first"), F.max("_upto").alias("_till"), F.max("_room").alias("_room")
    )
    reach = F.greatest(F.least(F.lit(history), F.col("_room") - (F.col("_till") - F.col("_first"))), F.lit(0))
    heads = heads.select(F.col("_c").alias("_hc"), F.col("_cell").alias("_hcell"), F.col("_window").alias("_hw"), "_first", reach.alias("_reach"))
    old = turns_of.drop("_window").withColumn(
        "_near", F.explode(F.sequence(F.col("_cell"), F.floor((F.col("_from") + history) / F.col("_span"))))
    ).join(
        heads,
        (F.col("_c") == F.col("_hc"))
        & (F.col("_near") == F.col("_hcell"))
        & (F.col("_upto") <= F.col("_first"))
        & (F.col("_from") >= F.col("_first") - F.col("_reach")),
    )
    new, seen = F.lit(True).alias("_new"), F.lit(False).alias("_new")
    first_of = heads.groupBy("_hc").agg(F.min("_hw").alias("_w0"))
    leading = (
        spans.where("_lead")
        .select("_c", "_nth")
        .join(heads.select("_hc", "_hw"), F.col("_c") == F.col("_hc"), "left")
        .join(first_of.withColumnRenamed("_hc", "_fc"), F.col("_c") == F.col("_fc"), "left")
        .select("_c", "_nth", F.coalesce("_hw", F.lit(0)).cast("long").alias("_window"), F.coalesce(F.col("_hw") == F.col("_w0"), F.lit(True)).alias("_new"))
    )
    places = (
        turns_of.select("_c", "_nth", "_window", new)
        .unionByName(old.select("_c", "_nth", F.col("_hw").alias("_window"), seen))
        .unionByName(leading)
        .select(F.col("_c").alias("_pc"), F.col("_nth").alias("_pn"), "_window", "_new")
    )

    piece = F.struct(F.col("_nth").alias("nth"), F.col("_new").alias("new"), "role", "text")
    laid = (
        said.join(places, (F.col("_c") == F.col("_pc")) & (F.col("_nth") == F.col("_pn")))
        .groupBy("_c", "_window")
        .agg(F.first("conv_id").alias("conv_id"), F.sum("_tokens").alias("_sum"), F.sort_array(F.collect_list(piece)).alias("_all"))
    )
    shaped = laid.withColumn(
        "_parts",
        F.transform(
            "_all",
            lambda p: F.struct(
                F.concat(F.lit(START), _escape_role(p["role"]), F.lit("\n")).alias("head"),
                escape(p["text"]).alias("body"),
                (p["new"] & (p["role"] == trained_role)).alias("loss"),
            ),
        ),
    )
    tail = len(END) + 1
    masked = shaped.withColumn(
        "_mask",
        F.aggregate(
            "_parts",
            F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("mask")),
            lambda acc, p: F.struct(
                (acc["at"] + F.length(p["head"]) + F.length(p["body"]) + tail).alias("at"),
                F.when(p["loss"], F.concat(acc["mask"], F.array(F.struct((acc["at"] + F.length(p["head"])).alias("start"), F.length(p["body"]).alias("length"))))).otherwise(acc["mask"]).alias("mask"),
            ),
        )["mask"],
    )
    return masked.select(
        "conv_id",
        F.col("_window").alias("window"),
        F.concat_ws("", F.transform("_parts", lambda p: F.concat(p["head"], p["body"], F.lit(END + "\n")))).alias("formatted"),
        F.col("_mask").alias("mask"),
        F.transform("_all", lambda p: F.struct(p["nth"].alias("nth"), p["new"].alias("new"))).alias("turns"),
        F.col("_sum").alias("n_tokens"),
    )


def read_windows(windows: DataFrame) -> DataFrame:
    """New turns and trained texts read back from formatted windows.

    Returns ``conv_id, window, turns`` (array of role and text of the turns new
    in the window, unescaped), ``loss`` (trained texts, unescaped) and
    ``n_chars`` (code points of the formatted window).
    """
    body = F.split(F.col("formatted"), r"<\|im_end\|>\n")
    turns = F.transform(
        F.filter(F.arrays_zip(F.slice(body, 1, F.size("turns")).alias("x"), F.col("turns").alias("t")), lambda z: z["t"]["new"]),
        lambda z: F.struct(
            _unescape_role(F.substring_index(F.substr(z["x"], F.lit(len(START) + 1)), "\n", 1)).alias("role"),
            unescape(F.substr(z["x"], F.instr(z["x"], F.lit("\n")) + 1)).alias("text"),
        ),
    )
    loss = F.transform("mask", lambda m: unescape(F.substr(F.col("formatted"), m["start"] + 1, m["length"])))
    return windows.select(
        "conv_id", "window", turns.alias("turns"), loss.alias("loss"), F.length("formatted").cast("long").alias("n_chars")
    )


def chat_digest(windows: DataFrame) -> DataFrame:
    """One row per conversation with digests of what its windows say.

    A digest needs the whole conversation in one value, so this report, unlike
    the windows, gathers a conversation in one row.
    """
    joined = read_windows(windows)
    said = F.concat_ws("", F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))))
    per = joined.groupBy("conv_id").agg(
        F.sum(F.size("turns")).alias("n_turns"),
        F.array_sort(F.collect_list(F.struct("window", said.alias("said"), F.concat_ws("", "loss").alias("loss")))).alias("_w"),
        F.sum("n_chars").alias("formatted_chars"),
    )
    loss = F.concat_ws("", F.transform("_w", lambda w: w["loss"]))
    return per.select(
        "conv_id",
        "n_turns",
        F.sha2(F.concat_ws("", F.transform("_w", lambda w: w["said"])), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.col("formatted_chars").cast("long").alias("formatted_chars"),
    )
