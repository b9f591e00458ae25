"""Exact deduplication by content-defined chunk recipes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, key_filter, with_maybe

#: Groups of at least one in so many rows are joined by broadcast, if their recipes are of so many bytes together at most.
HOT, HOT_BYTES = 1000, 8 << 20


def chunk_pattern(least: int, most: int) -> str:
    """A chunk ends at the first line or sentence end after `least` characters, or at `most`."""
    return rf"(?s).{{{least},{most - 1}}}?(?:\n|(?<=[.!?])\x20)|.{{1,{most}}}"


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 1024, most: int = 8192, row_col: str | None = None) -> DataFrame:
    """One row for each document: its class of identical texts and whether it stays.

    Returns id_col, keep_id (id of the row that stays: the largest), group_size, kept,
    text_sha256, n_chunks, and row_col, a unique number of the row, if there is one. Texts are equal when identical after no change.

    Texts are cut into chunks at boundaries that their content defines. Chunks are known by their SHA-256; a digest that
    occurs more than once is verified on the bytes: those chunks are shuffled by it, equal ones merged before they
    move, and it must have one content. (Others can't clash. Which chunks may be such is told by a filter of
    bounded size, so most bytes stay where they are.) Documents are then compared by their ordered lists of verified
    identifiers alone; a text itself never moves. If two contents did share a digest, the chunks themselves take the
    place of identifiers.

    Only rows that may be in a group of two or more are joined with the groups. Groups of more than 1 in HOT rows, so at
    most HOT of them, are joined by broadcast if their recipes are within HOT_BYTES: no task gets all rows of one.

    Null texts count as empty; all empty texts are one class. Of repeated rows with one id
    and text exactly one stays. A null id is smaller than all others. Other columns are not
    read; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "exact")
    text = F.coalesce(F.col(text_col), F.lit(""))
    chunks = F.regexp_extract_all(text, F.lit(chunk_pattern(least, most)), F.lit(0))
    name = lambda c: F.unhex(F.sha2(c, 256))
    number = F.col(row_col) if row_col else F.monotonically_increasing_id()

    def recipes(part) -> DataFrame:
        return scratch.save(docs.select(F.col(id_col).alias("id"), F.sha2(text, 256).alias("sha"), F.transform(chunks, part).alias("recipe"), number.alias("row")))

    rows = recipes(name)
    repeated = rows.select(F.explode("recipe").alias("chunk_id")).groupBy("chunk_id").count().where("count > 1")
    held = scratch.save(key_filter(repeated.select(F.xxhash64("chunk_id").alias("h"))))
    moved = docs.select(F.explode(chunks).alias("chunk")).withColumn("chunk_id", name(F.col("chunk")))
    moved = with_maybe(moved, F.xxhash64("chunk_id"), held, "again").where("again").select("chunk_id", "chunk").distinct()
    if not moved.groupBy("chunk_id").count().where("count > 1").isEmpty():
        rows = recipes(lambda c: F.encode(c, "UTF-8"))

    groups = rows.groupBy("recipe").agg(F.max(F.struct("id", "row")).alias("last"), F.count("*").alias("n")).where("n > 1")
    groups = scratch.save(groups.withColumn("h", F.xxhash64("recipe")))
    total = rows.count()
    hot = groups.where(F.col("n") * HOT > total)
    size = hot.agg(F.sum(F.aggregate("recipe", F.lit(0).cast("long"), lambda s, x: s + F.octet_length(x) + 16))).first()[0] or 0
    rows = with_maybe(rows, F.xxhash64("recipe"), key_filter(groups.select("h")), "shared")
    alone = rows.where("not shared").withColumn("last", F.struct("id", "row")).withColumn("n", F.lit(1).cast("long"))
    rest, parts = rows.where("shared"), [alone]
    if 0 < size <= HOT_BYTES:
        found = rest.join(F.broadcast(hot.select("recipe", "last", "n")), "recipe", "left")
        parts.append(found.where("n is not null").select(*alone.columns))
        rest = found.where("n is null").drop("last", "n")
        groups = groups.where(F.col("n") * HOT <= total)
    found = rest.join(groups.select("recipe", "last", "n"), "recipe", "left")
    found = found.withColumn("last", F.coalesce("last", F.struct("id", "row"))).withColumn("n", F.coalesce("n", F.lit(1).cast("long")))
    out = reduce(DataFrame.unionByName, [*parts, found.select(*alone.columns)])
    return out.select(
        F.col("id").alias(id_col),
        F.col("last.id").alias("keep_id"),
        F.col("n").alias("group_size"),
        (F.col("row") == F.col("last.row")).alias("kept"),
        F.col("sha").alias("text_sha256"),
        F.size("recipe").cast("long").alias("n_chunks"),
        *([F.col("row").alias(row_col)] if row_col else []),
    )
