"""A vector index that is kept: cells of k-means with centres and radii, searched exactly by the triangle inequality."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Vectors that centres are fitted on, cells, vectors of a stored block, questions of a block, at most.
SAMPLE, CELLS, BLOCK, ASKED = 16_384, 4096, 1024, 1024
#: Slack of a comparison of distances.
NEAR = 1e-6


def lloyd(v: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """k centres, from vectors spread over the sample; a cell that loses all its vectors keeps its centre."""
    centres = v[np.linspace(0, len(v) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        own = ((centres * centres).sum(1)[None, :] - 2 * v @ centres.T).argmin(1)
        n = np.bincount(own, minlength=k)
        total = np.zeros_like(centres)
        np.add.at(total, own, v)
        centres[n > 0] = total[n > 0] / n[n > 0, None]
    return centres


def _vectors(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten()).astype(np.float64).reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _packed(rows: DataFrame, name: str, most: int, radius: bool) -> DataFrame:
    """(cell, n, ids, vecs and, if asked for, centre and radius): runs of one cell's rows (cell, name, vec) in blobs of at most `most`."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        now, size = None, 0

        def out() -> pa.RecordBatch:
            ids, v = np.concatenate([x for x, _ in held]), np.concatenate([x for _, x in held])
            values = {"cell": now, "n": len(ids), "ids": ids.tobytes(), "vecs": v.tobytes()}
            if radius:
                centre = v.mean(0)
                values |= {"centre": centre.tobytes(), "radius": float(np.sqrt(((v - centre) ** 2).sum(1).max()))}
            kinds = {"cell": pa.int64(), "n": pa.int32(), "radius": pa.float64()}
            return pa.RecordBatch.from_arrays([pa.array([x], kinds.get(k, pa.binary())) for k, x in values.items()], names=list(values))

        for batch in batches:
            cells, ids = np.asarray(batch.column("cell")), np.asarray(batch.column(name))
            v = _vectors(batch.column("vec"))
            cuts = np.concatenate(([0], np.flatnonzero(np.diff(cells)) + 1, [len(cells)])) if len(cells) else np.zeros(1, int)
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                if held and cells[a] != now:
                    yield out()
                    held, size = [], 0
                now = int(cells[a])
                while a < b:
                    take = min(b - a, most - size)
                    held.append((ids[a : a + take], v[a : a + take]))
                    a, size = a + take, size + take
                    if size == most:
                        yield out()
                        held, size = [], 0
        if held:
            yield out()

    return rows.mapInArrow(work, "cell long, n int, ids binary, vecs binary" + ", centre binary, radius double" * radius)


def build(vectors: DataFrame, path: str, id_col: str, vec_col: str, dims: int) -> dict:
    """Writes the index of vectors of `dims` numbers below path and returns its statistics.

    Centres are fitted on the SAMPLE vectors that come first by a digest of their ids (a bound on what the driver gets); every vector is
    then dealt to its nearest centre. blocks: (cell, n, ids, vecs, centre, radius), up to BLOCK vectors of a cell with their own
    centre and radius, stored by cell. A cell with many vectors has many blocks, dealt over tasks by a digest of the id.

    Null ids, null vectors, and vectors of another length or with numbers that are null or not finite are left out.
    """
    spark = vectors.sparkSession
    vec = F.col(vec_col).cast("array<double>")
    fine = (F.size(vec) == dims) & F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.where(F.col(id_col).isNotNull() & F.coalesce(fine, F.lit(False))).select(F.col(id_col).cast("long").alias("id"), vec.alias("vec"))
    n = rows.count()
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("vec").toArrow()
    v = _vectors(sample["vec"].combine_chunks()) if n else np.zeros((0, dims))
    k = max(1, min(CELLS, len(v) // 4, int(np.sqrt(n))))
    centres = lloyd(v, k) if n else np.zeros((1, dims))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        square = (centres * centres).sum(1)
        for batch in batches:
            for i in range(0, batch.num_rows, 4096):
                part = batch.slice(i, 4096)
                cell = (square[None, :] - 2 * _vectors(part.column("vec")) @ centres.T).argmin(1)
                yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int64()), part.column("id"), part.column("vec")], names=["cell", "id", "vec"])

    dealt = rows.mapInArrow(deal, "cell long, id long, vec array<double>")
    salt = F.pmod(F.xxhash64("id"), F.lit(max(1, n // (k * BLOCK))))
    packed = _packed(dealt.repartition("cell", salt).sortWithinPartitions("cell").select("cell", "id", "vec"), "id", BLOCK, True)
    packed.withColumn("part", F.col("cell")).write.mode("overwrite").partitionBy("part").parquet(f"{path}/blocks")
    stats = {"vectors": n, "dims": dims, "cells": k}
    spark.createDataFrame([(json.dumps(stats),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/statistics")
    return stats


def merge(spark: SparkSession, parts: list[str], path: str) -> dict:
    """Several indices as one: each block brings its centre and radius, so cells are only numbered anew."""
    found = [json.loads(spark.read.text(f"{p}/statistics").first()[0]) for p in parts]
    if len({x["dims"] for x in found}) > 1:
        raise ValueError("indices of vectors of one length")
    before, blocks = 0, None
    for p, x in zip(parts, found, strict=True):
        some = _blocks(spark, p, x).drop("part").withColumn("cell", F.col("cell") + before)
        blocks = some if blocks is None else blocks.unionByName(some)
        before += x["cells"]
    blocks.withColumn("part", F.col("cell")).write.mode("overwrite").partitionBy("part").parquet(f"{path}/blocks")
    stats = {"vectors": sum(x["vectors"] for x in found), "dims": found[0]["dims"], "cells": before}
    spark.createDataFrame([(json.dumps(stats),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/statistics")
    return stats


def _blocks(spark: SparkSession, path: str, stats: dict) -> DataFrame:
    schema = "cell long, n int, ids binary, vecs binary, centre binary, radius double, part long"
    return spark.read.schema(schema).parquet(f"{path}/blocks") if stats["vectors"] else spark.createDataFrame([], schema)


def spheres(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spheres (cell, n, centre, radius) of one task, those of a cell as one that holds them all."""
    held: dict[int, list] = {}
    for batch in batches:
        for cell, n, centre, radius in zip(*(batch.column(c).to_pylist() for c in ("cell", "n", "centre", "radius")), strict=True):
            held.setdefault(cell, []).append((n, np.frombuffer(centre), radius))
    rows = []
    for cell, some in held.items():
        n = np.array([x for x, _, _ in some], float)
        centres = np.array([c for _, c, _ in some])
        middle = (n[:, None] * centres).sum(0) / n.sum()
        rows.append((cell, int(n.sum()), middle.tobytes(), float((np.sqrt(((centres - middle) ** 2).sum(1)) + np.array([r for _, _, r in some])).max())))
    if rows:
        columns = list(zip(*rows, strict=True))
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, (pa.int64(), pa.int64(), pa.binary(), pa.float64()), strict=True)], names=["cell", "n", "centre", "radius"])


def best(names: np.ndarray, q: np.ndarray, ids: np.ndarray, v: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k nearest of v for each of q, ties by id: question, id, squared distance."""
    rough = (q * q).sum(1)[:, None] - 2 * q @ v.T + (v * v).sum(1)[None, :]
    near = min(k + 8, len(ids))
    a, b = np.nonzero(rough <= np.partition(rough, near - 1, axis=1)[:, near - 1][:, None] + 1e-9)
    exact = ((q[a] - v[b]) ** 2).sum(1)
    order = np.lexsort((ids[b], np.round(exact, 6), a))
    keep = order[np.arange(len(a)) - np.searchsorted(a[order], a[order]) < k]
    return names[a[keep]], ids[b[keep]], exact[keep]


class Search:
    """The k nearest stored vectors of queries (query, vec) by squared distance, ties by id: (query, id, distance, rank), as retrieval.nearest finds them.

    No vector of a cell is nearer to a question than the distance to the cell's centre less its radius. For each question the
    nearest cells that hold k vectors are compared first; the k-th distance found then rules out every cell that can't hold a nearer
    vector, and only what is left is read. Questions with another length than the index, or null, find nothing.
    """

    def __init__(self, spark: SparkSession, path: str, queries: DataFrame, k: int):
        from ..sources.scratch import saved

        self.spark, self.k = spark, k
        self.stats = json.loads(spark.read.text(f"{path}/statistics").first()[0])
        self.blocks = _blocks(spark, path, self.stats)
        vec = F.col("vec").cast("array<double>")
        self.asked = saved(queries.where(F.size(vec) == self.stats["dims"]).select(F.col("query").cast("long").alias("query"), vec.alias("vec")))
        # one row for each cell: the sphere around its blocks' spheres, made in each task first
        found = self.blocks.select("cell", "n", "centre", "radius").withColumn("n", F.col("n").cast("long"))
        kind = "cell long, n long, centre binary, radius double"
        self.cells = saved(found.mapInArrow(spheres, kind).repartition("cell").mapInArrow(spheres, kind))

    def probes(self, floor: DataFrame | None = None) -> DataFrame:
        """(query, vec, cell): cells to compare. Without floor (query, distance) those of the nearest centres that hold k vectors, else those that can
        hold a vector as near. A row for each cell, of at most CELLS for each index merged, goes to every task."""
        k, rows = self.k, self.cells.orderBy("cell").collect()
        cells, n = np.array([r["cell"] for r in rows], np.int64), np.array([r["n"] for r in rows], np.int64)
        centres = np.array([np.frombuffer(r["centre"]) for r in rows]).reshape(len(rows), self.stats["dims"])
        radii = np.array([r["radius"] for r in rows])
        nearest = floor is None

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(0, batch.num_rows if len(cells) else 0, ASKED):
                    part = batch.slice(i, ASKED)
                    q = _vectors(part.column("vec"))
                    away = np.sqrt(np.maximum((q * q).sum(1)[:, None] - 2 * q @ centres.T + (centres * centres).sum(1)[None, :], 0))
                    if nearest:
                        order = np.argsort(away, axis=1, kind="stable")
                        before = np.cumsum(n[order], axis=1) - n[order]
                        a, place = np.nonzero(before < k)
                        b = order[a, place]
                    else:
                        most = np.sqrt(np.asarray(part.column("distance").fill_null(np.inf)))
                        a, b = np.nonzero(away - radii <= most[:, None] + NEAR)
                    yield pa.RecordBatch.from_arrays([part.column("query").take(pa.array(a)), part.column("vec").take(pa.array(a)), pa.array(cells[b])], names=["query", "vec", "cell"])

        asked = self.asked if floor is None else self.asked.join(floor, "query", "left")
        return asked.mapInArrow(work, "query long, vec array<double>, cell long")

    def met(self, probes: DataFrame) -> DataFrame:
        """(query, id, distance): the k nearest of each question in each block of its cells."""
        k = self.k
        named = [r["cell"] for r in probes.select("cell").distinct().collect()]  # at most the cells
        packed = _packed(probes.repartition("cell").sortWithinPartitions("cell").select("cell", "query", "vec"), "query", ASKED, False).select("cell", F.col("ids").alias("q_ids"), F.col("vecs").alias("q_vecs"))

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for q_ids, q_vecs, ids, vecs in zip(*(batch.column(c).to_pylist() for c in ("q_ids", "q_vecs", "ids", "vecs")), strict=True):
                    names, own = np.frombuffer(q_ids, np.int64), np.frombuffer(ids, np.int64)
                    out = best(names, np.frombuffer(q_vecs).reshape(len(names), -1), own, np.frombuffer(vecs).reshape(len(own), -1), k)
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in out], names=["query", "id", "distance"])

        blocks = self.blocks.where(F.col("part").isin(named)) if named else self.blocks.where("false")
        return blocks.select("cell", "ids", "vecs").join(packed, "cell").mapInArrow(work, "query long, id long, distance double")

    def last(self) -> DataFrame:
        """(query, vec, cell): what has to be compared for an exact answer."""
        from ..sources.scratch import saved
        from . import retrieval

        first = retrieval.top_near(self.met(saved(self.probes())), self.k)
        floor = first.groupBy("query").agg(F.count("*").alias("n"), F.max("distance").alias("distance")).where(F.col("n") >= self.k).select("query", "distance")
        return saved(self.probes(floor))

    def top(self) -> DataFrame:
        from . import retrieval

        return retrieval.top_near(self.met(self.last()), self.k)

    def share(self) -> float:
        """The share of pairs of a question and a stored vector that are compared for the answer."""
        seen = self.last().join(self.cells.select("cell", "n"), "cell").agg(F.sum("n")).first()[0] or 0
        return seen / max(1, self.stats["vectors"] * self.asked.count())
