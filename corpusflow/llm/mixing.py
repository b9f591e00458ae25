"""Mixing sources to target weights by capped water-filling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, WORD, Scratch, ranked

#: The histogram of seeded positions by which a source's sample is cut; a power of 16.
BUCKETS = 4096


def words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def first_words(text: Column, n: Column) -> Column:
    """The text up to the end of its n-th word."""
    pieces = F.regexp_extract_all(text, F.lit(rf"[{SPACE}]*{WORD}"), F.lit(0))
    return F.array_join(F.slice(pieces, F.lit(1), n.cast("int")), "")


def water_fill(scratch: Scratch, sources: DataFrame, weights: list[int], share: float, max_epochs: float) -> DataFrame:
    """sources (source, source_size) with weight and target.

    Sources whose proportional share exceeds max_epochs times their size are clamped there;
    the excess goes to the others by weight, until none is above. Only two sums and a count
    come to the driver in each round.
    """
    order = [F.col("source").asc_nulls_last()]
    cycle = F.array(*[F.lit(int(w)) for w in weights])
    levels = scratch.save(ranked(scratch, sources, order, "_rank").withColumn("weight", F.get(cycle, F.pmod("_rank", F.lit(len(weights))).cast("int"))).withColumn("_cap", F.col("source_size") * F.lit(float(max_epochs))))
    budget = levels.agg(F.sum("source_size")).first()[0] or 0
    budget *= share
    level, clamped = 0.0, -1
    while True:
        full = F.col("_cap") <= F.lit(level) * F.col("weight")
        n, caps, rest = levels.agg(F.count_if(full), F.sum(F.when(full, F.col("_cap")).otherwise(0.0)), F.sum(F.when(full, 0).otherwise(F.col("weight")))).first()
        if n == clamped or not rest:
            break
        clamped, level = n, (budget - caps) / rest
    filled = F.least("_cap", F.lit(level) * F.col("weight")) if rest else F.col("_cap")
    return levels.select("source", "source_size", "weight", filled.alias("target"))


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: list[int] = (3, 1, 2),
    share: float = 1.5,
    max_epochs: float = 2.0,
    seed: int = 17,
    row_col: str | None = None,
) -> DataFrame:
    """One row for each document: id_col, size, source_size, target, taken, whole, extra, and
    row_col, a unique number of the row, if there is one.

    Size is the number of words. Sources in code-point order, null last, weigh `weights`,
    repeating, and share `share` times all sizes; see water_fill. A source with target T and
    size S takes every document floor(T / S) times whole (`whole`). The rest, rounded to words, is a
    seeded sample: its documents lie in the order of a keyed digest of their id, each is taken
    whole once more until the rest is used up, and the one at the boundary by its first
    words (`extra`). So taken = whole * size + extra, the source's sum is its target rounded,
    and reruns agree.

    The boundary is found without ordering a source: sizes are summed by bucket of the
    digest, at most BUCKETS for each source, and only the boundary's bucket is ordered.

    Null texts have size 0 and take 0; null sources are one source; rows with one id and
    equal digests are ordered by size, then as read. Other columns are not read.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "mix")
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))))
    rows = scratch.save(
        docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), words(F.col(text_col)).alias("size"), digest.alias("at"), (F.col(row_col) if row_col else F.monotonically_increasing_id()).alias("row"))
        .withColumn("bucket", F.conv(F.substring("at", 1, 3), 16, 10).cast("int"))
    )
    hist = scratch.save(rows.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size")))
    plan = water_fill(scratch, hist.groupBy("source").agg(F.sum("bucket_size").alias("source_size")), list(weights), share, max_epochs)
    plan = plan.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long"))
    plan = plan.withColumn("rest", F.floor(F.col("target") + 0.5).cast("long") - F.col("whole") * F.col("source_size"))

    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    cut = (
        hist.withColumn("before", F.coalesce(F.sum("bucket_size").over(before), F.lit(0)))
        .join(plan.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")))
        .where((F.col("before") <= F.col("rest")) & (F.col("rest") < F.col("before") + F.col("bucket_size")))
        .select("s", F.col("bucket").alias("cut"), (F.col("rest") - F.col("before")).alias("left"))
    )
    plan = scratch.save(plan.withColumnRenamed("source", "p").join(cut, F.col("p").eqNullSafe(F.col("s")), "left").drop("s"))

    # without a cut the rest is all of the source, or the source is empty
    seen = rows.join(plan, F.col("source").eqNullSafe(F.col("p")))
    sides = seen.where(~F.coalesce(F.col("bucket") == F.col("cut"), F.lit(False)))
    sides = sides.withColumn("extra", F.when((F.col("rest") > 0) & (F.coalesce(F.col("bucket") < F.col("cut"), F.lit(True))), F.col("size")).otherwise(F.lit(0)))
    within = Window.partitionBy("p").orderBy("at", "id", "size", "row").rowsBetween(Window.unboundedPreceding, -1)
    edge = seen.where(F.col("bucket") == F.col("cut")).withColumn("extra", F.greatest(F.lit(0), F.least(F.col("size"), F.col("left") - F.coalesce(F.sum("size").over(within), F.lit(0)))))
    both = sides.select(*edge.columns).unionByName(edge)
    return both.select(
        F.col("id").alias(id_col),
        "size",
        "source_size",
        "target",
        (F.col("whole") * F.col("size") + F.col("extra")).cast("long").alias("taken"),
        "whole",
        F.col("extra").cast("long").alias("extra"),
        *([F.col("row").alias(row_col)] if row_col else []),
    )


def repeat(docs: DataFrame, plan: DataFrame, row_col: str, text_col: str = "text", chars_col: str | None = "n_chars") -> DataFrame:
    """The mix itself: each row of docs as often as its plan says, the last time perhaps only its first words."""
    own = plan.select(F.col(row_col).alias("_r"), F.col("size").alias("_size"), F.col("whole").alias("_whole"), F.col("extra").alias("_extra")).where((F.col("_whole") > 0) | (F.col("_extra") > 0))
    rows = docs.join(own, docs[row_col] == F.col("_r"))
    times = F.sequence(F.lit(1).cast("long"), F.col("_whole") + (F.col("_extra") > 0).cast("long"))
    rows = rows.withColumn("_time", F.explode(times))
    part = (F.col("_time") > F.col("_whole")) & (F.col("_extra") < F.col("_size"))
    rows = rows.withColumn(text_col, F.when(part, first_words(F.col(text_col), F.col("_extra"))).otherwise(F.col(text_col)))
    if chars_col:
        rows = rows.withColumn(chars_col, F.when(part, F.length(text_col).cast("long")).otherwise(F.col(chars_col)))
    return rows.select(*docs.columns)
