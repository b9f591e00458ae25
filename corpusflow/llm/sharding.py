"""Rendezvous hashing of stable record keys over weighted shards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

#: Sub-buckets in which the rows of a shard are counted.
BUCKETS = 1024


def rendezvous(key: Column, weights: list[float]) -> Column:
    """The shard, from 0, whose exponential race the key wins: the least -ln(u) / weight,
    u being the key's hash with that shard's number, in (0, 1)."""
    runs = []
    for shard, weight in enumerate(weights):
        u = (F.shiftrightunsigned(F.xxhash64(key, F.lit(f"shard-{shard}")), 11).cast("double") + 0.5) * F.lit(2.0**-53)
        runs.append(F.struct((-F.ln(u) / F.lit(float(weight))).alias("t"), F.lit(shard).alias("shard")))
    return F.array_min(F.array(*runs))["shard"] if len(runs) > 1 else F.lit(0)


def assign_shards(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", weights: list[float] = (1.0,) * 16, grown: float = 1.0) -> DataFrame:
    """One row for each document: id_col, size, text_crc32, law, shard, slot, grown_shard.

    Law `key`: the id and the shards alone decide. A shard of twice the weight takes twice the
    rows; one more shard (of weight `grown`) takes rows only into itself: grown_shard is either the shard or the
    new one. Slots are gapless from 0 in each shard, in the order of (bucket, id, checksum,
    size): rows are counted by shard and bucket of their id, the sums give each bucket its
    first slot, and only buckets are ordered, so that no task sees a shard. The counts are at
    most shards * BUCKETS rows, so they are broadcast for up to 64 shards (some 3 MB), joined by a shuffle for more.
    The law is of the key alone, so equal texts need not share a shard.

    Null ids share one key; null texts count as empty: size 1, checksum 0. Rows repeated
    with one id go to one shard, in slots next to one another. Other columns are not read.
    """
    scratch = Scratch(docs.sparkSession, "shards")
    key = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = scratch.save(
        docs.select(
            F.col(id_col).alias("id"),
            (F.octet_length(text).cast("long") + 1).alias("size"),
            F.crc32(F.encode(text, "UTF-8")).alias("crc"),
            rendezvous(key, list(weights)).alias("shard"),
            rendezvous(key, [*weights, grown]).alias("grown"),
            F.pmod(F.xxhash64(key, F.lit("bucket")), F.lit(BUCKETS)).cast("int").alias("bucket"),
        )
    )
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    first = rows.groupBy("shard", "bucket").agg(F.count("*").alias("n")).select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    at = F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("id", "crc", "size"))
    return rows.withColumn("at", at).join(F.broadcast(first) if len(weights) <= 64 else first, ["shard", "bucket"]).select(
        F.col("id").alias(id_col),
        "size",
        F.col("crc").cast("long").alias("text_crc32"),
        F.lit("key").alias("law"),
        F.col("shard").cast("int").alias("shard"),
        (F.col("first") + F.col("at") - 1).cast("long").alias("slot"),
        F.col("grown").cast("int").alias("grown_shard"),
    )


def write_shards(docs: DataFrame, path: str, id_col: str = "doc_id", weights: list[float] = (1.0,) * 16, max_rows: int = 100_000) -> None:
    """Writes docs as Parquet, one folder for each shard, files of at most max_rows."""
    key = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    docs.withColumn("_shard", rendezvous(key, list(weights))).write.partitionBy("_shard").option("maxRecordsPerFile", max_rows).parquet(path)
