"""Chat formatting in budgeted windows, in DataFrame functions only.

A conversation becomes one or more windows of whole turns, none above the budget unless a single turn with the system turn
is. What the budget leaves beside the system turn and the history is the stride, and prefix sums of the turns' tokens choose
the spans: the turns that lie between two multiples of the stride are a span; one that lies across a multiple joins the span
before it if both fit in a stride, and is a span of its own if not. Every window begins with the conversation's system turn;
every window but the first then repeats the last turns of the span before, as many as fit in the history's tokens and in
what the budget leaves. The loss mask covers each assistant text where it comes first and nothing that is repeated.

Template, for each turn: <|im_start|>role, line feed, text<|im_end|>, line feed. In roles and texts, a backslash becomes
two and <| becomes <\\|, in roles a line feed gets a backslash before it; so no text can hold a control string, and
taking the backslashes away restores it.

Turns are ordered by turn (null first), role and text; rows that repeat are turns that repeat. A null role or text is
empty. conv_id null is a conversation. Only a leading turn with role system counts as the system turn. Nothing is cut from
a text of any length. Extra columns are ignored. Windows of a long conversation are grouped separately; its turns meet in
one task to be summed in order, a row each, and in one row only for the digests of the whole conversation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
BUDGET, HISTORY = 1280, 256


def escaped(text: Column, role: bool = False) -> Column:
    out = F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))
    return F.replace(out, F.lit("\n"), F.lit("\\\n")) if role else out


def unescaped(text: Column) -> Column:
    return F.when(F.contains(text, F.lit("\\")), F.regexp_replace(text, r"(?s)\\(.)", "$1")).otherwise(text)


def tokens(text: Column) -> Column:
    """An estimate: a token for each four bytes or part of them, and three for the template."""
    return (F.ceil(F.octet_length(text) / 4) + 3).cast("long")


def windows(turns: DataFrame, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """conv_id, window, n_repeated (leading turns that an earlier window has), formatted, loss (array of (start, length)
    in code points of formatted), n_tokens."""
    t = turns.select("conv_id", "turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    whole = Window.partitionBy("conv_id")
    in_order = whole.orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    t = t.withColumn("at", F.row_number().over(in_order)).withColumn("n", tokens(F.col("text")))
    t = t.withColumn("system", (F.col("at") == 1) & (F.col("role") == "system"))
    by_at = whole.orderBy("at")
    fresh = F.when(F.col("system"), 0).otherwise(F.col("n"))
    t = t.withColumn("upto", F.sum(fresh).over(by_at)).withColumn("begin", F.col("upto") - fresh)
    t = t.withColumn("room", F.greatest(budget - F.first(F.col("n") - fresh).over(by_at), F.lit(0)))
    t = t.withColumn("most", F.least(F.lit(history), F.floor(F.col("room") / 4)))
    t = t.withColumn("stride", F.greatest(F.col("room") - F.col("most"), F.lit(1))).withColumn("bin", F.floor(F.col("begin") / F.col("stride")))
    t = t.withColumn("across", ~F.col("system") & (F.floor((F.col("upto") - 1) / F.col("stride")) > F.col("bin")))
    inside = F.min(F.when(~F.col("system") & ~F.col("across"), F.col("begin"))).over(Window.partitionBy("conv_id", "bin"))
    t = t.withColumn("alone", F.col("across") & F.coalesce(F.col("upto") - inside > F.col("stride"), F.lit(True)))
    before = lambda c: F.lag(c).over(by_at)
    new = ~F.coalesce(before("system"), F.lit(True)) & (F.col("alone") | (F.col("bin") != before("bin")))
    t = t.withColumn("window", F.sum(F.coalesce(new, F.lit(False)).cast("int")).over(by_at))
    by_window = whole.orderBy("window")
    t = t.withColumn("last", F.max("window").over(whole)).withColumn("until", F.max("upto").over(by_window.rangeBetween(0, 0))).withColumn("next", F.max("upto").over(by_window.rangeBetween(1, 1)))
    again = ~F.col("system") & (F.col("window") < F.col("last")) & (F.col("until") - F.col("begin") <= F.least(F.col("most"), F.col("room") - (F.col("next") - F.col("until"))))
    own = F.array(F.col("window"))
    placed = F.when(F.col("system"), F.sequence(F.lit(0).cast("long"), F.col("last"))).when(again, F.array("window", F.col("window") + 1)).otherwise(own)
    piece = F.concat(F.lit(START), escaped(F.col("role"), role=True), F.lit("\n"), escaped(F.col("text")), F.lit(END + "\n"))
    head = F.length(F.concat(F.lit(START), escaped(F.col("role"), role=True), F.lit("\n")))
    t = t.select("conv_id", "at", "role", "n", "window", "system", piece.alias("piece"), head.alias("head"), F.length(escaped(F.col("text"))).alias("size"), F.explode(placed).alias("into"))
    t = t.withColumn("repeated", F.col("into") != F.col("window"))
    in_window = Window.partitionBy("conv_id", "into").orderBy("at")
    t = t.withColumn("offset", F.sum(F.length("piece")).over(in_window) - F.length("piece"))
    lost = F.when((F.col("role") == "assistant") & ~F.col("repeated"), F.struct((F.col("offset") + F.col("head")).alias("start"), F.col("size").cast("long").alias("length")))
    rows = t.groupBy("conv_id", F.col("into").alias("window")).agg(
        F.array_sort(F.collect_list(F.struct("at", "piece"))).alias("pieces"), F.array_sort(F.collect_list(lost)).alias("loss"), F.sum(F.col("repeated").cast("int")).alias("n_repeated"), F.sum("n").alias("n_tokens"),
    )
    return rows.select("conv_id", "window", "n_repeated", F.concat_ws("", F.transform("pieces", lambda p: p["piece"])).alias("formatted"), "loss", "n_tokens")


def read_back(formatted: DataFrame) -> DataFrame:
    """From windows(): conv_id, window, turns (array of (role, text)) without what is repeated, loss_texts (array)."""
    parts = F.slice(F.split("formatted", r"<\|im_start\|>", -1), 2, 1 << 30)
    fresh = F.slice(parts, F.col("n_repeated") + 1, 1 << 30)
    end = len(END) + 1
    cut = F.transform(fresh, lambda p: F.substr(p, F.lit(1), F.length(p) - end))
    split = F.transform(cut, lambda p: F.struct(F.regexp_extract(p, r"^((?:[^\\\n]|\\[\s\S])*)\n", 1).alias("role"), p.alias("p")))
    turns = F.transform(split, lambda x: F.struct(unescaped(x["role"]).alias("role"), unescaped(F.substr(x["p"], F.length(x["role"]) + 2)).alias("text")))
    lost = F.transform("loss", lambda s: unescaped(F.substr(F.col("formatted"), (s["start"] + 1).cast("int"), s["length"].cast("int"))))
    return formatted.select("conv_id", "window", turns.alias("turns"), lost.alias("loss_texts"), F.length("formatted").cast("long").alias("formatted_chars"))


def digests(formatted: DataFrame) -> DataFrame:
    """By conversation, from what is read back: n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""
    back = read_back(formatted)
    told = F.concat_ws("", F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))))
    rows = back.select("conv_id", "window", F.size("turns").alias("n"), told.alias("told"), F.concat_ws("", "loss_texts").alias("lost"), "formatted_chars")
    by = rows.groupBy("conv_id").agg(F.sum("n").cast("long").alias("n_turns"), F.array_sort(F.collect_list(F.struct("window", "told", "lost"))).alias("w"), F.sum("formatted_chars").cast("long").alias("formatted_chars"))
    lost = F.concat_ws("", F.transform("w", lambda x: x["lost"]))
    return by.select("conv_id", "n_turns", F.sha2(F.concat_ws("", F.transform("w", lambda x: x["told"])), 256).alias("turns_sha256"), F.length(lost).cast("long").alias("loss_chars"), F.sha2(lost, 256).alias("loss_sha256"), "formatted_chars")
