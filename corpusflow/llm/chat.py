"""Chat formatting with a grammar round trip."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The grammar: conversation = turn*; turn = "<turn>" role "\n" body "</turn>\n". The first END
#: after a START closes the turn. In a body, a backslash stands for the character after it.
START, END = "<turn>", "</turn>\n"


def render(role: Column, body: Column) -> Column:
    return F.concat(F.lit(START), F.url_encode(role), F.lit("\n"), body, F.lit(END))


def parse_role(piece: Column) -> Column:
    """Of a turn without its END."""
    return F.url_decode(F.substring_index(F.substr(piece, F.lit(len(START) + 1)), "\n", 1))


def parse_body(piece: Column) -> Column:
    return F.substr(piece, F.instr(piece, "\n") + 1)


def unescape(body: Column) -> Column:
    return F.regexp_replace(body, r"(?s)\\(.)", "$1")


def escape(text: Column, level: int) -> Column:
    """0: as it is. 1: backslashes doubled. 2: also the tags broken by a backslash."""
    if level >= 1:
        text = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    if level >= 2:
        text = F.replace(F.replace(text, F.lit("</turn>"), F.lit("<\\/turn>")), F.lit("<turn>"), F.lit("<\\turn>"))
    return text


def pieces(formatted: Column) -> Column:
    """The turns of a text, without their ENDs."""
    parts = F.split(formatted, r"\Q" + END + r"\E")
    return F.slice(parts, F.lit(1), F.size(parts) - 1)


def round_trips(role: Column, text: Column, level: int) -> Column:
    """Whether the parser gives one turn back, with this role and text, and the body holds no tag."""
    body = escape(text, level)
    back = pieces(render(role, body))
    one = F.get(back, F.lit(0))
    plain = ~F.contains(body, F.lit(START)) & ~F.contains(body, F.lit(END[:-1]))
    return plain & (F.size(back) == 1) & (parse_role(one) == role) & (unescape(parse_body(one)) == text)


def format_chats(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", loss_role: str = "assistant") -> DataFrame:
    """One row for each conversation: conv_col, formatted, n_turns, mask.

    Each turn is rendered plain, reparsed, and escaped one level more until the parser gives
    the same role and text back. `mask` has for each turn the code points (start, stop) of
    `formatted` that are trained on: the body of loss_role's turns, else start = stop.

    Null texts and roles count as empty; equal turn numbers are ordered by role, then text;
    repeated rows are turns of their own; a null conversation is one conversation. Any role
    is kept (it is percent-encoded in the header). An empty table gives an empty result.
    A conversation becomes one text, so its turns meet in one task by nature; whatever
    can be done before (rendering, the round trip) is done on single turns.
    """
    role, text = F.coalesce(F.col(role_col), F.lit("")), F.coalesce(F.col(text_col), F.lit(""))
    rows = turns.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), role.alias("role"), text.alias("text"))
    body = F.when(round_trips(F.col("role"), F.col("text"), 0), F.col("text")).when(round_trips(F.col("role"), F.col("text"), 1), escape(F.col("text"), 1)).otherwise(escape(F.col("text"), 2))
    rows = rows.withColumn("body", body).withColumn("out", render(F.col("role"), F.col("body")))
    order = Window.partitionBy("conv").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("no", F.row_number().over(order.orderBy("turn", "role", "text"))).withColumn("end", F.sum(F.length("out")).over(order))
    stop = F.col("end") - len(END)
    rows = rows.select("conv", "no", "out", stop.alias("stop"), F.when(F.col("role") == loss_role, stop - F.length("body")).otherwise(stop).alias("start"))
    turned = rows.groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("no", "out", "start", "stop"))).alias("t"))
    return turned.select(
        F.col("conv").alias(conv_col),
        F.array_join(F.col("t.out"), "").alias("formatted"),
        F.size("t").cast("long").alias("n_turns"),
        F.transform("t", lambda x: F.struct(x["start"].alias("start"), x["stop"].alias("stop"))).alias("mask"),
    )


def read_back(chats: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """The turns of formatted conversations: conv_col, no, role, text, loss (null outside the mask).

    The mask's code points are cut out of the turn they lie in, whose own place is a running
    sum of lengths; so the work grows with the text, not with its square.
    """
    rows = chats.select(F.col(conv_col).alias("conv"), F.posexplode(F.arrays_zip(pieces(F.col("formatted")).alias("piece"), "mask")).alias("no", "x"))
    rows = rows.select("conv", "no", F.col("x.piece").alias("piece"), F.col("x.mask.start").alias("start"), F.col("x.mask.stop").alias("stop"))
    before = Window.partitionBy("conv").orderBy("no").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("at", F.coalesce(F.sum(F.length("piece") + len(END)).over(before), F.lit(0)))
    cut = F.substr(F.col("piece"), (F.col("start") - F.col("at") + 1).cast("int"), (F.col("stop") - F.col("start")).cast("int"))
    return rows.select(F.col("conv").alias(conv_col), "no", parse_role(F.col("piece")).alias("role"), unescape(parse_body(F.col("piece"))).alias("text"), F.when(F.col("stop") > F.col("start"), unescape(cut)).alias("loss"))
