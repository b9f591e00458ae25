"""Values carried forward along an order, without one task for a key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import saved


def carried(rows: DataFrame, key: str, order: list[Column], value: str, name: str) -> DataFrame:
    """rows with a column `name`: the last value that is not null up to this row, in the key's order.

    Rows are dealt by ranges of key and order and written, so a key with most of the rows lies in many ranges. Within a range a window
    carries on; a range's first key may have begun in earlier ranges, whose last values are a table of one row for each range and
    go to every task. Rows of equal order are as in a window: any one is first. Null keys are one key.
    """
    placed = saved(rows.repartitionByRange(F.col(key), *order).withColumn("_part", F.spark_partition_id()))
    along = Window.partitionBy("_part", key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    # of each range: its first key, its last key, and the last value of that
    spot = F.struct(F.col(key).isNotNull().alias("a"), F.col(key).alias("k"))
    ends = placed.groupBy("_part", key).agg(F.max(F.when(F.col(value).isNotNull(), F.struct(*order, F.col(value).alias("_v")))).alias("_last"))
    ends = ends.groupBy("_part").agg(F.min(spot).alias("first"), F.max_by(F.struct(spot.alias("s"), F.col("_last._v").alias("v")), spot).alias("end"))
    both = ends.select(F.col("_part").alias("p"), F.col("end.s").alias("k"), F.col("end.v").alias("v"), F.lit(False).alias("asks"))
    both = both.unionByName(ends.select(F.col("_part").alias("p"), F.col("first").alias("k"), F.lit(None).cast(rows.schema[value].dataType).alias("v"), F.lit(True).alias("asks")))
    # a range's question comes before its own end: a range of one key asks for what was before it
    order_of = Window.partitionBy("k").orderBy("p", F.desc("asks")).rowsBetween(Window.unboundedPreceding, -1)
    carry = both.withColumn("_before", F.last("v", True).over(order_of)).where("asks").select(F.col("p").alias("_p"), F.col("k").alias("_k"), "_before")
    found = placed.withColumn("_own", F.last(value, True).over(along))
    found = found.join(F.broadcast(carry), (F.col("_part") == F.col("_p")) & (spot == F.col("_k")), "left")
    return found.withColumn(name, F.coalesce("_own", "_before")).drop("_part", "_own", "_p", "_k", "_before")


def numbered(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """rows with a gapless number from 1 in the given order: dealt by ranges, numbered within, the counts of earlier ranges (a row for each)
    added."""
    placed = saved(rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = placed.groupBy("_part").agg(F.count("*").alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    at = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return placed.join(F.broadcast(counts), "_part").withColumn(name, F.col("_before") + at).drop("_part", "_before")


def valid_version(events: DataFrame, versions: DataFrame, key: str, ts: str, version: str) -> DataFrame:
    """events with the version (key, ts, version) in force at their time: the last one of the key that is not later; of versions at one time the
    largest."""
    seen = events.withColumn("_event", F.lit(True)).withColumn("_version", F.lit(None).cast(versions.schema[version].dataType))
    given = versions.select(F.col(key), F.col(ts), F.lit(False).alias("_event"), F.col(version).alias("_version"))
    both = seen.unionByName(given, allowMissingColumns=True)
    return carried(both, key, [F.col(ts), F.col("_event"), F.col("_version")], "_version", version).where("_event").drop("_event", "_version")
