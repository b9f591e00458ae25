"""A table kept in buckets by key: an upsert rewrites the buckets that its rows fall in, and no others."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chain
from .scratch import saved

#: Buckets of a new table.
BUCKETS = 64


def bucket(key: Column, buckets: int) -> Column:
    """By a digest of the key's text; null keys are one."""
    return F.coalesce(F.pmod(F.conv(F.substring(F.md5(key.cast("string")), 1, 8), 16, 10).cast("long"), F.lit(buckets)), F.lit(0)).cast("int")


def state(spark: SparkSession, root: str) -> dict:
    """The newest commit: number, buckets, schema, and the folder of each bucket that has rows; empty for no table."""
    done = chain.commits(spark, root)
    return done[-1] if done else {}


def read(spark: SparkSession, root: str, only: list[int] | None = None) -> DataFrame | None:
    """The table's rows, or those of some buckets; None where there is no table. A reader sees one commit whole."""
    now = state(spark, root)
    if not now:
        return None
    paths = [f"{root}/{folder}" for b, folder in sorted(now["folders"].items()) if only is None or int(b) in only]
    reader = spark.read.schema(now["schema"])
    return reader.parquet(*paths) if paths else spark.createDataFrame([], now["schema"])


def upsert(rows: DataFrame, root: str, key: str, buckets: int = BUCKETS, batch: int | None = None, append: bool = False) -> list[int]:
    """Puts rows in place of those of their keys (append: only those of new keys) and returns the buckets that were rewritten.

    The rows' buckets are read, merged and written to new folders; one small commit names the folder of every bucket, so the
    others stay as they are. A writer that comes second merges again; a batch (its number, if given) that is there already
    changes nothing. Of several rows of one key any one counts, the same in each run; null keys are one key. `buckets` counts for a new table only.
    """
    spark = rows.sparkSession
    cells = F.struct(*[c for c in rows.columns if c != key])
    new = saved(rows.groupBy(key).agg(F.max(cells).alias("_s")).select(key, "_s.*").select(*rows.columns))
    while True:
        now = state(spark, root)
        if batch is not None and batch in now.get("batches", ()):
            return []
        n = now.get("buckets", buckets)
        of = bucket(F.col(key), n)
        touched = sorted(r["b"] for r in new.select(of.alias("b")).distinct().collect())  # at most the buckets
        if not touched:
            return []
        merged, old = new, read(spark, root, touched)
        if old is not None:
            same = lambda a, b: a.join(b.select(F.col(key).alias("_k")), F.col(key).eqNullSafe(F.col("_k")), "left_anti")
            if append:
                fresh = saved(same(new, old))
                touched = sorted(r["b"] for r in fresh.select(of.alias("b")).distinct().collect())
                if not touched:
                    return []
                merged = read(spark, root, touched).select(*rows.columns).unionByName(fresh)
            else:
                merged = same(old.select(*rows.columns), new).unionByName(new)
        number, name = now.get("number", 0) + 1, uuid.uuid4().hex[:12]
        # a bucket is one file, written by one task of many
        merged.withColumn("bucket", of).repartition("bucket").write.partitionBy("bucket").parquet(f"{root}/data/{number:09d}-{name}")
        folders = now.get("folders", {}) | {str(b): f"data/{number:09d}-{name}/bucket={b}" for b in touched}
        said = {"number": number, "buckets": n, "schema": now.get("schema") or ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields), "folders": folders, "rewritten": touched}
        said["batches"] = sorted({*now.get("batches", []), *([] if batch is None else [batch])})
        if chain._commit(spark, root, number, said):
            return touched
