"""Near-duplicate embeddings by NN-descent, with exact counts inside what it links."""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, components, forest

#: Vectors in a leaf of a projection tree, the sample that the trees are fitted on, trees at a time.
LEAF, SAMPLE, TREES = 256, 4096, 10
#: Members of a neighbourhood that are compared at once, of a block of a component with full lists.
CROWD, BLOCK = 256, 2048
#: The widest list; nodes with more links are counted in blocks.
WIDEST = 32
#: Nodes of a block when all are compared with all; at most so many are audited, until so many of them have links.
WHOLE, AUDIT, LINKED = 4096, 16_384, 128
log = logging.getLogger(__name__)


def unit(vectors: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Rows of length 1 in double precision, filled with zeros to the longest, and their numbers of components."""
    dims = np.diff(np.asarray(vectors.offsets))
    flat = np.asarray(vectors.flatten()).astype(np.float64)
    width = int(dims.max()) if len(dims) else 0
    if len(dims) and (dims == width).all():
        out = flat.reshape(len(dims), width)
    else:
        out = np.zeros((len(dims), width))
        at = np.cumsum(dims) - dims
        out[np.repeat(np.arange(len(dims)), dims), np.arange(len(flat)) - np.repeat(at, dims)] = flat
    out = out / np.maximum(np.abs(out).max(1, keepdims=True), 5e-324) if width else out
    return out / np.linalg.norm(out, axis=1, keepdims=True), dims


def cosines(a: np.ndarray, b: np.ndarray, da: np.ndarray, db: np.ndarray) -> np.ndarray:
    out = a @ b.T
    if len(da) and len(db) and ((da != da[0]).any() or (db != da[0]).any()):
        out[da[:, None] != db[None, :]] = -2
    return out


def by_key(batches: Iterator[pa.RecordBatch], work: Callable[[pa.Table], pa.RecordBatch | None]) -> Iterator[pa.RecordBatch]:
    """Applies work to the runs of one `key` of sorted batches, and gathers what it returns."""
    held: list[pa.RecordBatch] = []
    out: list[pa.RecordBatch] = []

    def flush() -> None:
        made = work(pa.Table.from_batches(held))
        if made is not None and made.num_rows:
            out.append(made)

    for batch in batches:
        keys = np.asarray(batch.column("key"))
        if not len(keys):
            continue
        cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
        for i, j in zip(cuts, cuts[1:], strict=False):
            if held and held[0].column("key")[0].as_py() != int(keys[i]):
                flush()
                held.clear()
            held.append(batch.slice(i, j - i))
            if sum(x.num_rows for x in out) > 20_000:
                yield from pa.Table.from_batches(out).combine_chunks().to_batches()
                out.clear()
    if held:
        flush()
    if out:
        yield from pa.Table.from_batches(out).combine_chunks().to_batches()


def best_of(table: pa.Table, k: int) -> pa.RecordBatch | None:
    """Of the members of one key (node, vec, grp, floor): for each the k most similar of other groups above its floor."""
    n = table.num_rows
    if n < 2:
        return None
    table = table.combine_chunks()
    nodes, group, floor = np.asarray(table["node"]), np.asarray(table["grp"]), np.asarray(table["floor"])
    vectors, dims = unit(table["vec"].chunk(0))
    rows, cols, sims = [], [], []
    for i in range(0, n, 1024):
        s = cosines(vectors[i : i + 1024], vectors, dims[i : i + 1024], dims)
        s[group[i : i + 1024][:, None] == group[None, :]] = -3
        if n > k:
            top = np.argpartition(-s, k - 1, axis=1)[:, :k]
        else:
            top = np.broadcast_to(np.arange(n), s.shape)
        got = np.take_along_axis(s, top, 1)
        r, c = np.nonzero((got > floor[i : i + 1024][:, None]) & (got > -2))
        rows.append(r + i)
        cols.append(top[r, c])
        sims.append(got[r, c])
    a, b, s = nodes[np.concatenate(rows)], nodes[np.concatenate(cols)], np.concatenate(sims)
    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(s)], names=["a", "b", "sim"])


def grow(sample: np.ndarray, depth: int, rng: np.random.Generator) -> list:
    """A tree of random projections, cut at the sample's medians: (direction, cut, lower, upper)."""
    if depth == 0:
        return []
    direction = rng.normal(size=sample.shape[1])
    cut = float(np.median(sample @ direction)) if len(sample) else 0.0
    low = sample @ direction <= cut
    return [direction, cut, grow(sample[low], depth - 1, rng), grow(sample[~low], depth - 1, rng)]


def leaves(tree: list, vectors: np.ndarray) -> np.ndarray:
    out = np.zeros(len(vectors), np.int64)
    stack = [(tree, np.arange(len(vectors)))]
    while stack:
        node, at = stack.pop()
        if not node or not len(at):
            continue
        width = min(len(node[0]), vectors.shape[1])  # other lengths are dealt by what they have
        up = vectors[at, :width] @ node[0][:width] > node[1]
        out[at] = out[at] * 2 + up
        stack += [(node[2], at[~up]), (node[3], at[up])]
    return out


def link_embeddings(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    threshold: float = 0.95,
    k: int = 8,
    max_rounds: int = 8,
    settled: float = 0.002,
    audited: int = 256,
    recall: float = 0.99,
) -> DataFrame:
    """id_col, n_links, component_id, kept for each vector.

    Vectors link at a cosine of `threshold` or more in double precision. Equal vectors are one node with a
    weight. NN-descent then refines each node's list of its k most similar: the first lists come from
    leaves of projection trees; in each round every node meets, at each node that lists it or
    that it lists, the other members of that neighbourhood, and keeps the better ones, until fewer than
    `settled` of the entries change that may lead to a link (within twice its angle; lists full of links don't count). Neighbourhoods larger than CROWD
    are dealt out at random to several, anew in each round.

    A list that is full of links may hide more. So lists of nodes whose list is full of links are enlarged, to four times the
    length each time up to WIDEST, by a join among these nodes (of a hidden link both ends have full lists, else
    the other end lists it). The links are the lists' entries of at least `threshold`, both ways; joins among their neighbours
    run until they bring no more. Nodes that are full even so get lists of their most similar in other components, by
    the same trees and rounds; links among them join components, until there are none. In the components of such
    nodes links are counted, not listed, in pairs of blocks (see counted), which is exact however large a group is.

    Recall is audited: `audited` nodes, and more until
    enough of them have links, are compared with all others in blocks; while the mean of their shares is below
    `recall`, more trees and rounds follow, and after three attempts all nodes are compared with all. The figure is logged.

    Vectors that are null, zero or hold null or non-finite components link with nothing, nor do vectors of
    different lengths. Rows repeated with one id and vector are vectors of their own. A null id is larger
    than all others. kept: id = component_id. Other columns are not read.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "nnd")
    vec = F.col("vec")
    bad = F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    zero = F.forall(vec, lambda x: x == 0)
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vec_col).alias("vec")).withColumn("ok", F.coalesce(~bad & ~zero, F.lit(False)))
    # -0.0 and 0.0 group alike
    nodes = rows.where("ok").groupBy("vec").agg(F.min("id").alias("least"), F.count("*").alias("weight")).withColumn("node", F.monotonically_increasing_id())
    nodes = scratch.save(nodes.select("node", "vec", "least", "weight"))
    n = nodes.count()
    kind = nodes.schema["vec"].dataType.simpleString()
    edge = "a long, b long, sim double"
    picked = [r["vec"] for r in nodes.orderBy(F.xxhash64("node")).limit(SAMPLE).select("vec").collect()]
    width = max(map(len, picked), default=0)
    sample, _ = unit(pa.array([x for x in picked if len(x) == width], pa.list_(pa.float64()))) if picked else (np.zeros((0, 0)), None)
    depth = int(max(0, np.ceil(np.log2(max(1, n) / LEAF))))
    near = float(np.cos(min(np.pi, 2 * np.arccos(min(1.0, threshold)))))  # of two that link with one node

    def planted(pool: DataFrame, seed: int, floor: DataFrame | None) -> DataFrame:
        """Links of each node of the pool (node, vec, grp) to the most similar in its leaves of new trees."""
        rng = np.random.default_rng(seed)
        trees = [grow(sample, min(depth, 8), rng) for _ in range(TREES)]
        more = rng.normal(size=(width, TREES * max(0, min(depth - 8, 40)))) if depth > 8 else None

        def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                v, _ = unit(batch.column("vec"))
                if not len(v):
                    continue
                for t, tree in enumerate(trees):
                    key = leaves(tree, v)
                    if more is not None:  # finer than the sample can tell: signs of random directions
                        part = more[: v.shape[1], t :: TREES]
                        key = key * np.int64(1 << 40) + ((v[:, : len(part)] @ part > 0) @ (np.int64(1) << np.arange(part.shape[1], dtype=np.int64)))
                    key = key * TREES + t
                    yield pa.RecordBatch.from_arrays([pa.array(key), *(batch.column(c) for c in ("node", "vec", "grp", "floor"))], names=["key", "node", "vec", "grp", "floor"])

        rows = pool.join(floor, "node", "left").withColumn("floor", F.coalesce("floor", F.lit(-2.0))) if floor is not None else pool.withColumn("floor", F.lit(-2.0))
        dealt = rows.select("node", "vec", "grp", "floor").mapInArrow(deal, f"key long, node long, vec {kind}, grp long, floor double")
        return dealt.repartition("key").sortWithinPartitions("key").mapInArrow(lambda it: by_key(it, lambda t: best_of(t, k)), edge)

    def top(edges: DataFrame, width: int = k, old: DataFrame | None = None) -> DataFrame:
        """(a, b, sim, was, rank): the lists out of edges (a, b, sim) and old lists, whose entries have `was` 1. One shuffle."""
        rows = edges.select("a", "b", "sim", F.lit(0).alias("was"))
        if old is not None:
            rows = rows.unionByName(old.select("a", "b", "sim", F.lit(1).alias("was")))
        order = Window.partitionBy("a").orderBy(F.desc("sim"), "b")
        best = rows.repartition("a").groupBy("a", "b").agg(F.max("sim").alias("sim"), F.max("was").alias("was"))
        return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= width)

    def floors(lists: DataFrame, width: int = k) -> DataFrame:
        return lists.where(F.col("rank") == width).select(F.col("a").alias("node"), F.col("sim").alias("floor"))

    def met(pool: DataFrame, paths: DataFrame, floor: DataFrame, width: int, turn: int) -> DataFrame:
        """Better neighbours from the neighbourhoods of paths: members come with their vectors and their lists' floors."""
        both = paths.select(F.col("a").alias("at"), F.col("b").alias("node")).unionByName(paths.select(F.col("b").alias("at"), F.col("a").alias("node")))
        both = both.repartition("at").distinct().withColumn("parts", F.ceil(F.count("*").over(Window.partitionBy("at")) / CROWD))
        key = F.when(F.col("parts") > 1, F.xxhash64("at", F.pmod(F.xxhash64("node", F.lit(turn)), "parts"))).otherwise(F.col("at"))
        whole = pool.join(floor, "node", "left").withColumn("floor", F.coalesce("floor", F.lit(-2.0)))
        sent = both.select(key.alias("key"), "node").join(whole, "node").select("key", "node", "vec", "grp", "floor")
        return sent.repartition("key").sortWithinPartitions("key").mapInArrow(lambda it: by_key(it, lambda t: best_of(t, width)), edge)

    def refined(pool: DataFrame, lists: DataFrame, known: DataFrame | None = None) -> DataFrame:
        """lists after rounds of meeting, at the neighbours in them and in the known lists, until few entries change that may lead to
        a link. Lists full of links don't count: more links don't fit in them."""
        for turn in range(max_rounds):
            paths = lists.select("a", "b") if known is None else lists.select("a", "b").unionByName(known)
            new = scratch.save(top(met(pool, paths, floors(lists), k, turn), k, lists).withColumn("last", F.min("sim").over(Window.partitionBy("a"))).withColumn("held", F.count("*").over(Window.partitionBy("a"))))
            open_ = new.where((F.col("sim") >= near) & ~((F.col("held") >= k) & (F.col("last") >= threshold)))
            changed, held = open_.agg(F.count_if(F.col("was") == 0), F.count("*")).first()
            scratch.drop(lists)
            lists = new
            if changed <= settled * held:
                break
        return lists

    def full_of(lists: DataFrame, width: int) -> DataFrame:
        """(node) whose lists of this length hold links only."""
        return scratch.save(lists.where((F.col("rank") == width) & (F.col("sim") >= threshold)).select(F.col("a").alias("node")))

    def within(edges: DataFrame, some: DataFrame) -> DataFrame:
        """Those between two of the nodes."""
        return edges.join(some.withColumnRenamed("node", "a"), "a", "left_semi").join(some.withColumnRenamed("node", "b"), "b", "left_semi").select("a", "b", "sim")

    def linked(lists: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(a, b, sim) both ways, the links in lists that are enlarged where they are full; (node) that are full even so."""
        links = lists.where(F.col("sim") >= threshold).select("a", "b", "sim")
        width, full = k, full_of(lists, k)
        while width < WIDEST and not full.isEmpty():
            width *= 4
            pool = nodes.join(full, "node", "left_semi").select("node", "vec", F.col("node").alias("grp"))
            paths = within(links, full)
            floor = pool.select("node", F.lit(threshold - 1e-12).alias("floor"))
            wider = scratch.save(top(met(pool, paths, floor, width, 99), width, paths))
            links = links.unionByName(wider.where(F.col("sim") >= threshold).select("a", "b", "sim"))
            full = full_of(wider, width)
        links = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"), "sim"))
        both = scratch.save(links.groupBy("a", "b").agg(F.max("sim").alias("sim")))
        while True:  # neighbours of neighbours by links alone, where lists are not full
            paths = both.join(full.withColumnRenamed("node", "a"), "a", "left_anti").join(full.withColumnRenamed("node", "b"), "b", "left_anti").select("a", "b")
            floor = nodes.select("node", F.lit(threshold - 1e-12).alias("floor"))
            found = met(every, paths, floor, CROWD, 0).where(F.col("sim") >= threshold).join(both.select("a", "b"), ["a", "b"], "left_anti")
            found = scratch.save(found.groupBy("a", "b").agg(F.max("sim").alias("sim")))
            if found.isEmpty():
                return both, full
            back = found.select(F.col("b").alias("a"), F.col("a").alias("b"), "sim")
            both = scratch.save(both.unionByName(found).unionByName(back).groupBy("a", "b").agg(F.max("sim").alias("sim")))

    def joined(links: DataFrame, full: DataFrame, seed: int) -> DataFrame:
        """Components of the links and of those that full lists hide."""
        known = within(links, full).select("a", "b")
        links = links.select("a", "b")
        while True:
            label = scratch.save(components(scratch, links))
            pool = scratch.save(nodes.select("node", "vec").join(full, "node", "left_semi").join(label.withColumnRenamed("component", "grp"), "node"))
            groups = pool.agg(F.count_distinct("grp")).first()[0]
            if groups < 2:
                return label
            across = refined(pool, scratch.save(top(planted(pool, seed, None))), known)
            hidden = scratch.save(across.where(F.col("sim") >= threshold).select("a", "b"))
            scratch.drop(across)
            scratch.drop(pool)
            if hidden.isEmpty():
                return label
            scratch.drop(label)
            links = links.unionByName(hidden)

    def counts_of(links: DataFrame, full: DataFrame, label: DataFrame) -> DataFrame:
        """(node, links, others): of components without full lists the links listed, of others all of them, counted in blocks."""
        crowded = scratch.save(label.join(full, "node", "left_semi").select("component").distinct())
        listed = links.join(label.withColumnRenamed("node", "a").join(crowded, "component", "left_anti"), "a").join(nodes.select(F.col("node").alias("b"), "weight"), "b")
        listed = listed.groupBy(F.col("a").alias("node")).agg(F.sum("weight").alias("links"), F.count("*").alias("others"))
        if crowded.isEmpty():
            return scratch.save(listed)
        return scratch.save(listed.unionByName(counted(scratch, nodes, label.join(crowded, "component", "left_semi"), threshold)))

    every = nodes.select("node", "vec", F.col("node").alias("grp"))
    lists = None
    for seed in range(3):
        more = planted(every, seed, None if lists is None else floors(lists))
        lists = refined(every, scratch.save(top(more, k, lists)))
        links, full = linked(lists)
        label = joined(links, full, seed)
        counts = counts_of(links, full, label)
        share = found(scratch, nodes, counts, threshold, audited)
        log.info("attempt %d: audited recall %.4f", seed + 1, share)
        if share >= recall:
            break
    else:
        label = scratch.save(components(scratch, compared(nodes, n, threshold)))
        counts = scratch.save(counted(scratch, nodes, label, threshold))

    named = nodes.join(label, "node", "left").join(counts, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    named = scratch.save(named.join(least, "component").select(F.col("vec").alias("v"), "component_id", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links")))
    good = rows.where("ok").join(named, F.col("vec") == F.col("v")).select("id", "n_links", "component_id")
    alone = rows.where(~F.col("ok")).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    out = good.unionByName(alone)
    return out.select(F.col("id").alias(id_col), F.col("n_links").cast("long").alias("n_links"), "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))



def counted(scratch: Scratch, nodes: DataFrame, label: DataFrame, threshold: float) -> DataFrame:
    """(node, links, others): the weights of a node's links and their number, all members of a component compared.

    Members are packed into blocks of at most about BLOCK, by the signs of random projections, then by chance. A block has a centre
    and a radius; if by the triangle inequality of angles all pairs of two blocks link, or none, their sizes tell the counts. Only
    the other pairs of blocks are sent and compared.
    """
    angle = float(np.arccos(min(1.0, threshold)))

    def leaf(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signs: dict[int, np.ndarray] = {}
        for batch in batches:
            v, _ = unit(batch.column("vec"))
            if not len(v):
                continue
            if v.shape[1] not in signs:
                signs[v.shape[1]] = np.random.default_rng(11).normal(size=(v.shape[1], 8))
            code = (v @ signs[v.shape[1]] > 0) @ (1 << np.arange(8))
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("component", "node", "vec", "weight")] + [pa.array(code.astype(np.int64))], names=["component", "node", "vec", "weight", "leaf"])

    kind = nodes.schema["vec"].dataType.simpleString()
    members = label.join(nodes.select("node", "vec", "weight"), "node").select("component", "node", "vec", "weight")
    members = scratch.save(members.mapInArrow(leaf, f"component long, node long, vec {kind}, weight long, leaf long"))
    sizes = members.groupBy("component").agg(F.count("*").alias("n"))
    members = members.join(sizes, "component").withColumn("leaf", F.when(F.col("n") <= BLOCK, 0).otherwise(F.col("leaf"))).drop("n")
    parts = members.groupBy("component", "leaf").agg(F.ceil(F.count("*") / BLOCK).alias("parts"))
    members = members.join(parts, ["component", "leaf"]).withColumn("part", F.pmod(F.xxhash64("node"), "parts"))

    def pack(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches)).combine_chunks()
        v, dims = unit(table["vec"].chunk(0))
        w = np.asarray(table["weight"])
        centre = v.sum(0)
        centre /= max(np.linalg.norm(centre), 5e-324)
        radius = float(np.arccos(np.clip(v @ centre, -1, 1)).max()) if np.linalg.norm(centre) > 0.5 else np.pi
        row = [key[0].as_py(), len(v), int(w.sum()), radius, centre.tobytes(), np.asarray(table["node"]).tobytes(), w.tobytes(), v.tobytes()]
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.binary(), pa.binary(), pa.binary(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, kinds, strict=True)], names=["component", "n", "w", "radius", "centre", "nodes", "weights", "vecs"])

    packed = members.groupBy("component", "leaf", "part").applyInArrow(pack, "component long, n long, w long, radius double, centre binary, nodes binary, weights binary, vecs binary")
    packed = scratch.save(packed.withColumn("block", F.monotonically_increasing_id()))
    heads = packed.select("component", "block", "n", "w", "radius", "centre")
    place = Window.partitionBy("component").orderBy("block")
    heads = scratch.save(heads.withColumn("at", F.row_number().over(place)).withColumn("last", F.count("*").over(Window.partitionBy("component"))))
    left = heads.select("component", F.col("block").alias("x"), F.col("n").alias("nx"), F.col("w").alias("wx"), F.col("radius").alias("rx"), F.col("centre").alias("cx"), F.explode(F.sequence("at", "last")).alias("at"))
    right = heads.select("component", F.col("block").alias("y"), F.col("n").alias("ny"), F.col("w").alias("wy"), F.col("radius").alias("ry"), F.col("centre").alias("cy"), "at")

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            verdict = []
            for cx, cy, rx, ry in zip(*(batch.column(c).to_pylist() for c in ("cx", "cy", "rx", "ry")), strict=True):
                between = float(np.arccos(np.clip(np.frombuffer(cx) @ np.frombuffer(cy), -1, 1)))
                verdict.append(1 if between + rx + ry < angle - 1e-6 else -1 if between - rx - ry > angle + 1e-6 else 0)
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("x", "y", "nx", "wx", "ny", "wy")] + [pa.array(verdict, pa.int32())], names=["x", "y", "nx", "wx", "ny", "wy", "verdict"])

    pairs = scratch.save(left.join(right, ["component", "at"]).select("x", "y", "nx", "wx", "ny", "wy", "rx", "ry", "cx", "cy").mapInArrow(decide, "x long, y long, nx long, wx long, ny long, wy long, verdict int"))
    sure = pairs.where("verdict = 1")
    ends = sure.select(F.col("x").alias("block"), F.col("wy").alias("w"), F.col("ny").alias("n")).unionByName(sure.where("x <> y").select(F.col("y").alias("block"), F.col("wx").alias("w"), F.col("nx").alias("n")))
    # a node is no link of its own
    own = sure.where("x = y").select(F.col("x").alias("block"), F.lit(1).alias("own"))
    ends = ends.groupBy("block").agg(F.sum("w").alias("w"), F.sum("n").alias("n")).join(own, "block", "left").select("block", "w", "n", F.coalesce("own", F.lit(0)).alias("own"))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids, weights = (np.frombuffer(batch.column(c)[i].as_buffer(), np.int64) for c in ("nodes", "weights"))
                w, n, own = (batch.column(c)[i].as_py() for c in ("w", "n", "own"))
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(w - weights * own), pa.array(np.full(len(ids), n - own))], names=["node", "links", "others"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                a, b, wa, wb = (np.frombuffer(batch.column(c)[i].as_buffer(), np.int64) for c in ("nodes", "nodes_y", "weights", "weights_y"))
                va, vb = (np.frombuffer(batch.column(c)[i].as_buffer()).reshape(len(x), -1) for c, x in (("vecs", a), ("vecs_y", b)))
                same = batch.column("x")[i].as_py() == batch.column("y")[i].as_py()
                links, others, back, backs = np.zeros(len(a), np.int64), np.zeros(len(a), np.int64), np.zeros(len(b), np.int64), np.zeros(len(b), np.int64)
                for j in range(0, len(a), 512):
                    hit = (va[j : j + 512] @ vb.T >= threshold) & (a[j : j + 512][:, None] != b[None, :])
                    links[j : j + 512], others[j : j + 512] = hit @ wb, hit.sum(1)
                    back += wa[j : j + 512] @ hit
                    backs += hit.sum(0)
                ends = ((a, links, others),) if same else ((a, links, others), (b, back, backs))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*ends, strict=True)], names=["node", "links", "others"])

    out = "node long, links long, others long"
    body = packed.select("block", "nodes", "weights", "vecs")
    counts = body.select("block", "nodes", "weights").join(ends, "block").mapInArrow(spread, out)
    open_pairs = pairs.where("verdict = 0").select("x", "y")
    other = body.select(F.col("block").alias("y"), F.col("nodes").alias("nodes_y"), F.col("weights").alias("weights_y"), F.col("vecs").alias("vecs_y"))
    both = open_pairs.join(body.withColumnRenamed("block", "x"), "x").join(other, "y").repartition("x", "y")
    counts = counts.unionByName(both.mapInArrow(compare, out))
    return counts.groupBy("node").agg(F.sum("links").alias("links"), F.sum("others").alias("others"))


def compared(nodes: DataFrame, n: int, threshold: float) -> DataFrame:
    """(a, b): links that connect what is linked, all nodes compared with all in pairs of blocks."""
    parts = max(1, -(-n // WHOLE))
    place = nodes.select("node", "vec", F.pmod(F.xxhash64("node"), F.lit(parts)).alias("mine"))
    pairs = place.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    key = F.least("mine", "other") * parts + F.greatest("mine", "other")
    sent = pairs.select(key.cast("long").alias("key"), "node", "vec", (F.col("mine") <= F.col("other")).alias("lower"), (F.col("mine") >= F.col("other")).alias("upper"))

    def compare(table: pa.Table) -> pa.RecordBatch | None:
        table = table.combine_chunks()
        ids = np.asarray(table["node"])
        v, dims = unit(table["vec"].chunk(0))
        low, up = np.flatnonzero(np.asarray(table["lower"])), np.flatnonzero(np.asarray(table["upper"]))
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for i in range(0, len(low), 1024):
            some = low[i : i + 1024]
            x, y = np.nonzero((cosines(v[some], v[up], dims[some], dims[up]) >= threshold) & (ids[some][:, None] != ids[up][None, :]))
            x, y = forest(ids[some][x], ids[up][y])
            a.append(x)
            b.append(y)
        return pa.RecordBatch.from_arrays([pa.array(x) for x in forest(np.concatenate(a), np.concatenate(b))], names=["a", "b"])

    return sent.repartition("key").sortWithinPartitions("key").mapInArrow(lambda it: by_key(it, compare), "a long, b long")


def found(scratch: Scratch, nodes: DataFrame, counts: DataFrame, threshold: float, audited: int) -> float:
    """The share of a node's links found, on average over the linked ones of a bounded number of nodes that are compared
    with all: so a large group weighs no more than its nodes do. More are drawn until enough are linked; 1 where none of
    AUDIT nodes is, as there are too few links to tell."""
    while True:
        asked = nodes.orderBy(F.xxhash64("node", F.lit(9))).limit(audited).select("node", "vec").collect()
        if not asked:
            return 1.0
        linked, share = shares(nodes, asked, counts, threshold)
        if linked >= LINKED or len(asked) < audited or audited >= AUDIT:
            return share if linked else 1.0
        audited = min(AUDIT, audited * 4)


def shares(nodes: DataFrame, asked: list, counts: DataFrame, threshold: float) -> tuple[int, float]:
    """How many of the asked nodes have links to others, and the mean of their shares found."""
    ids = np.array([r["node"] for r in asked], np.int64)
    q, qd = unit(pa.array([r["vec"] for r in asked], pa.list_(pa.float64())))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        there = np.zeros(len(ids), np.int64)
        for batch in batches:
            for i in range(0, batch.num_rows, 2048):
                part = batch.slice(i, 2048)
                v, d = unit(part.column("vec"))
                w = min(v.shape[1], q.shape[1])
                there += ((cosines(q[:, :w], v[:, :w], qd, d) >= threshold) & (ids[:, None] != np.asarray(part.column("node"))[None, :])).sum(1)
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(there)], names=["node", "there"])

    true = nodes.select("node", "vec").mapInArrow(count, "node long, there long").groupBy("node").agg(F.sum("there").alias("there")).where("there > 0")
    share = F.least(F.col("there"), F.coalesce("others", F.lit(0))) / F.col("there")
    got = true.join(counts, "node", "left").agg(F.count("*"), F.avg(share)).first()
    return got[0], got[1] or 0.0
