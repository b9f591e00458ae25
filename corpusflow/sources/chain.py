"""A log of chained entries that goes on from where it ended, and its streaming forms."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import oplog
from .scratch import saved

#: Commits after which one table of all heads is written anew.
COMPACT = 32


def _path(spark: SparkSession, at: str):
    return spark._jvm.org.apache.hadoop.fs.Path(at)


def commits(spark: SparkSession, root: str) -> list[dict]:
    """What each commit wrote, in order: its number, the folders of its entries and heads, the number of the batch it came from."""
    at = _path(spark, f"{root}/commits")
    files = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(at):
        return []
    names = sorted(x.getPath().getName() for x in files.listStatus(at) if x.getPath().getName().isdigit())
    if not names:
        return []
    rows = spark.read.text([f"{root}/commits/{n}" for n in names], wholetext=True).collect()  # one short line for each commit
    return sorted((json.loads(r["value"]) for r in rows), key=lambda x: x["number"])


def _commit(spark: SparkSession, root: str, number: int, said: dict) -> bool:
    """Whether the commit of that number is this one: the file is made only where none is."""
    at = _path(spark, f"{root}/commits/{number:09d}")
    files = at.getFileSystem(spark._jsc.hadoopConfiguration())
    beside = _path(spark, f"{root}/commits/_{uuid.uuid4().hex}")
    out = files.create(beside, False)
    try:
        out.write(bytearray(json.dumps(said).encode()))
    finally:
        out.close()
    # a rename onto a file that is there fails on a cluster's store: of two writers one goes on
    done = not files.exists(at) and files.rename(beside, at)
    if not done:
        files.delete(beside, False)
    return bool(done)


def entries(spark: SparkSession, root: str) -> DataFrame | None:
    """All entries of committed batches; what a writer left that didn't commit is not read."""
    done = commits(spark, root)
    return spark.read.parquet(*[f"{root}/{x['entries']}" for x in done]) if done else None


def heads(spark: SparkSession, root: str, done: list[dict]) -> DataFrame | None:
    """(k, last_hash, length, number): the newest head of each key. A commit holds the heads of its own keys, every COMPACT-th those of all."""
    if not done:
        return None
    since = max([0, *(i for i, x in enumerate(done) if x["whole"])])
    rows = spark.read.parquet(*[f"{root}/{x['heads']}" for x in done[since:]])
    return rows.groupBy("k").agg(F.max_by(F.struct("last_hash", "length"), "number").alias("h"), F.max("number").alias("number")).select("k", "h.*", "number")


def append(events: DataFrame, key: str, order: str, fields: dict[str, Column], root: str, batch: int | None = None) -> bool:
    """Appends events to the log at root as entries: each key's chain goes on from its head. False if the batch was there already.

    Entries (key, order, n, the fields, previous_audit_hash, audit_hash) have their place n in the key's chain, from 1; those of one append are in
    order of `order`, after all of earlier appends. Written are the batch's entries and the heads of its keys, then a file
    that names both, which only one writer can make; a writer that comes second reads the new heads and chains again. So a
    reader sees whole batches, and a batch (a stream's number, say) that is tried again adds nothing.

    One chain for each key, so that keys are chained in parallel; a constant as key makes one chain of all, in one task. Events without a key are
    left out. No events make no commit.
    """
    spark = events.sparkSession
    rows = saved(events.select(F.col(key), F.col(order), *[c.alias(n) for n, c in fields.items() if n not in (key, order)]).where(F.col(key).isNotNull()))
    own = {n: F.col(n) for n in fields}
    while True:
        done = commits(spark, root)
        if batch is not None and any(x["batch"] == batch for x in done):
            return False
        if rows.isEmpty():
            return False
        number = len(done) + 1
        old = heads(spark, root, done)
        chained = oplog.hash_chain(rows, key, order, own, old)
        name = f"{number:09d}-{uuid.uuid4().hex[:12]}"
        made = rows.join(chained, [key, order])
        made.write.parquet(f"{root}/entries/{name}")
        made = spark.read.parquet(f"{root}/entries/{name}")
        new = made.groupBy(F.col(key).alias("k")).agg(F.max_by("audit_hash", "n").alias("last_hash"), F.max("n").alias("length")).withColumn("number", F.lit(number))
        whole = number % COMPACT == 0
        if whole and old is not None:
            new = new.unionByName(old.join(new.select("k"), "k", "left_anti"))
        new.write.parquet(f"{root}/heads/{name}")
        if _commit(spark, root, number, {"number": number, "entries": f"entries/{name}", "heads": f"heads/{name}", "batch": batch, "whole": whole}):
            return True


def verified(spark: SparkSession, root: str, key: str, fields: dict[str, Column]) -> DataFrame:
    """The entries of the log with `ok`, all at once."""
    return oplog.verify_chain(entries(spark, root), key, "n", fields)


def append_stream(events: DataFrame, key: str, order: str, fields: dict[str, Column], root: str, checkpoint: str):
    """A stream of events into the log, a commit for each batch; one that is tried again is known by its number."""

    def write(batch: DataFrame, number: int) -> None:
        append(batch, key, order, fields, root, number)

    return events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def chained_stream(events: DataFrame, key: str, order: str, fields: dict[str, Column]) -> DataFrame:
    """(k, o, n, previous_audit_hash, audit_hash) of a stream of events: the head of each key is its state, so no table of heads is needed.

    A batch's events are in order of `order`. Written by a file sink each entry is there once, whatever is tried again."""
    head, tail = oplog.entry_parts(fields)
    kinds = {c: events.schema[c].dataType.simpleString() for c in (key, order)}

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, n = state.get if state.exists else (oplog.GENESIS, 0)
        rows = pd.concat(list(frames)).sort_values("o")  # one key's events of one batch
        previous, own = [], []
        for start, stop in zip(rows["head"], rows["tail"], strict=True):
            previous.append(last)
            last = hashlib.sha256((start + last + stop).encode()).hexdigest()
            own.append(last)
        state.update((last, n + len(own)))
        yield pd.DataFrame({"k": [k[0]] * len(own), "o": rows["o"].to_numpy(), "n": range(n + 1, n + 1 + len(own)), "previous_audit_hash": previous, "audit_hash": own})

    rows = events.select(F.col(key).alias("k"), F.col(order).alias("o"), head.alias("head"), tail.alias("tail")).where("k is not null")
    out = f"k {kinds[key]}, o {kinds[order]}, n long, previous_audit_hash string, audit_hash string"
    return rows.groupBy("k").applyInPandasWithState(step, out, "last string, n long", "append", GroupStateTimeout.NoTimeout)
