"""Structured Streaming forms of the event operators."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.oplog import Log
from ..sources import sinks
from ..sources.scratch import exists


def event_stream(spark: SparkSession, path: str, schema, files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def windowed_counts(events: DataFrame, width: str = "7 days", slide: str = "1 day", late: str = "1 hour") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.window("ts", width, slide), "event_type").agg(F.count("*").alias("n"), F.avg("value").alias("avg_value"))


def session_counts(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))


def dedup_within(events: DataFrame, keys: list[str], ttl: str = "1 hour") -> DataFrame:
    return events.withWatermark("ts", ttl).dropDuplicatesWithinWatermark(keys)


def ingest_unseen(stream: DataFrame, target: str, checkpoint: str, key: str = "sha256"):
    """Appends rows whose key the target doesn't hold yet; a batch that is tried again adds nothing twice."""

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = batch.dropDuplicates([key])
        if exists(spark, target):
            rows = rows.join(spark.read.parquet(target).select(key).distinct(), key, "left_anti")
        rows.write.mode("append").parquet(target)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def limited(events: DataFrame, key: str, most: int = 15, seconds: int = 60):
    """(k, event_id, accepted): the limiter of accepted requests over a stream (key, event_id, ts); its state is the times of at most
    `most` accepted ones of a key. Events of a batch are taken in order of time; late ones as if they came at the last time known."""

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        log = Log(most, seconds)
        log.kept.extend(state.get[0] if state.exists else [])
        rows = pd.concat(list(frames)).sort_values(["t", "event_id"])
        out = []
        for t in rows["t"]:
            out.append(log.accept(max(int(t), log.kept[-1]) if log.kept else int(t)))
        state.update((list(log.kept),))
        yield pd.DataFrame({"k": [k[0]] * len(rows), "event_id": rows["event_id"], "accepted": out})

    kind = events.schema[key].dataType.simpleString()
    rows = events.select(F.col(key).alias("k"), "event_id", F.unix_micros("ts").alias("t")).where("k is not null")
    return rows.groupBy("k").applyInPandasWithState(step, f"k {kind}, event_id long, accepted boolean", "kept array<long>", "append", GroupStateTimeout.NoTimeout)


def audit_writes(events: DataFrame, target: str, checkpoint: str):
    """Appends events as audit rows, a batch at a time, each batch once: it is known by its number."""

    def write(batch: DataFrame, number: int) -> None:
        sinks.audit_rows(batch).write.mode("overwrite").parquet(f"{target}/batch={number}")

    return events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
