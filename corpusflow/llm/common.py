"""What the operators of this subpackage share: tables in the shared folder, dense ranks, components."""

from __future__ import annotations

import atexit
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: ASCII white space, and what a word is, as a Java regular expression and a DuckDB (RE2) one.
SPACE = r"\x20\x09-\x0D"
WORD = rf"[^{SPACE}]+"
#: Links that one task connects, at most.
FEW = 1 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: spark.checkpoint.dir.

    Where it is unset and Spark runs on one machine (tests) a temporary folder is set for the session; on a cluster
    that is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors see")
        found = "file://" + tempfile.mkdtemp(prefix="corpusflow-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def large_types_off(spark: SparkSession) -> None:
    """Arrow buffers are read with 32-bit offsets; with 64-bit ones they would give wrong results."""
    if spark.conf.get("spark.sql.execution.arrow.useLargeVarTypes", "false") == "true":
        raise ValueError("set spark.sql.execution.arrow.useLargeVarTypes to false")


def _remove(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


class Scratch:
    """Tables written to the shared folder to cut lineage: they outlive a lost executor.

    drop() removes one that later steps don't read; what is left goes when Python ends. Where a long session runs many
    queries, end() removes a query's tables once its result has been written.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/corpusflow-{name}-{uuid.uuid4().hex[:12]}"
        self._n = 0
        self._paths: dict[int, str] = {}
        atexit.register(self._end)

    def path(self) -> str:
        self._n += 1
        return f"{self.root}/{self._n}"

    def save(self, df: DataFrame, compression: str = "snappy") -> DataFrame:
        at = self.path()
        df.write.option("compression", compression).parquet(at)
        out = self.spark.read.schema(df.schema).parquet(at)
        self._paths[id(out)] = at
        return out

    def drop(self, df: DataFrame) -> None:
        at = self._paths.pop(id(df), None)
        if at:
            _remove(self.spark, at)

    def free(self) -> None:
        """Lets Spark remove the shuffle files of frames that are no longer referred to."""
        gc.collect()
        self.spark._jvm.System.gc()

    def end(self) -> None:
        self._end()
        atexit.unregister(self._end)

    def _end(self) -> None:
        try:
            _remove(self.spark, self.root)
        except Exception:  # the session may have ended before
            pass


def ranked(scratch: Scratch, df: DataFrame, order: list, name: str) -> DataFrame:
    """df with a gapless rank from 0 in the given order, without one task that sees all rows.

    Rows are dealt by ranges and written; the offsets are one row for each range, a number
    bounded by the partitions, so they are broadcast.
    """
    parts = scratch.save(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.groupBy("_part").agg(F.count("*").alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    at = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return parts.join(F.broadcast(offsets), "_part").withColumn(name, F.col("_before") + at - 1).drop("_part", "_before")


def trimmed(work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """work, after which the worker gives unused memory back: workers are kept, beside what the next stage needs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from work(batches)
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (AttributeError, OSError):  # another C library
            pass

    return run


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect the same nodes, at most one for each: every one to its group's least."""
    nodes, ends = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = ends[: len(a)], ends[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, x, low)
        np.minimum.at(new, y, low)
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    far = label != np.arange(len(nodes))
    return nodes[far], nodes[label[far]]


def components(scratch: Scratch, edges: DataFrame) -> DataFrame:
    """(node, component) for each node of the links (a, b): the smallest node reachable.

    Each partition's links are first cut to those that connect the same nodes. Where at most FEW are left, one task
    connects them: its size is checked. Else this alternates a large-star and a small-star step until nothing changes. Each takes a
    minimum for each node, pre-aggregated before its shuffle, and a join whose skewed keys
    Spark can split; no task sees all links of a hub.
    """

    def star(links: DataFrame, large: bool) -> DataFrame:
        both = links.select("a", "b")
        if large:
            both = both.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        else:  # the larger node holds the link
            both = both.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        seen = both.join(least, "a")
        if large:
            out = seen.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        else:
            out = seen.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        return out.where("a <> b").distinct()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            held.append([np.asarray(batch.column(i)) for i in (0, 1)])
            size += batch.num_rows
            if size > FEW:
                held = [forest(*(np.concatenate([x[i] for x in held]) for i in (0, 1)))]
                size = len(held[0][0])
                if size > FEW // 2:
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in held[0]], names=["a", "b"])
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in forest(*(np.concatenate([x[i] for x in held]) for i in (0, 1)))], names=["a", "b"])

    now = scratch.save(edges.where("a <> b").select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).mapInArrow(cut, "a long, b long"))
    if now.count() <= FEW:
        whole = scratch.save(now.coalesce(1).mapInArrow(cut, "a long, b long"))
        hubs = whole.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
        return whole.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(hubs)
    now = scratch.save(now.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = None
    while True:
        new = scratch.save(star(star(now, True), False))
        seen = new.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        scratch.drop(now)
        now = new
        if tuple(seen) == mark:
            break
        mark = tuple(seen)
    hubs = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(hubs)


#: Words of 32 bits in a filter, at most: the bound of what is broadcast, some 10 MB.
WORDS = 1 << 18


def key_filter(keys: DataFrame) -> DataFrame:
    """A Bloom filter of one hash over the column `h` (long) of keys: (word, bits), at most WORDS rows."""
    place = F.pmod("h", F.lit(WORDS * 32))
    return keys.select(F.shiftright(place, 5).alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), place.bitwiseAND(31).cast("int")).alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits"))


def with_maybe(rows: DataFrame, h: Column, held: DataFrame, name: str) -> DataFrame:
    """rows with a boolean column: false where no key of the filter has the hash h. The filter's size is bounded, so it is broadcast."""
    place = F.pmod(h, F.lit(WORDS * 32))
    found = rows.withColumn("_place", place).withColumn("_word", F.shiftright("_place", 5))
    found = found.join(F.broadcast(held.withColumnRenamed("word", "_word").withColumnRenamed("bits", "_bits")), "_word", "left")
    bit = F.call_function("shiftright", F.col("_bits"), F.col("_place").bitwiseAND(31).cast("int")).bitwiseAND(1) == 1
    return found.withColumn(name, F.coalesce(bit, F.lit(False))).drop("_place", "_word", "_bits")
