"""SimHash near-duplicates, linked through vantage-point trees over Hamming distance."""

from __future__ import annotations

import pickle
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, components, forest, key_filter, trimmed, with_maybe

#: Fingerprints that a shard should hold, beyond which it is cut again, and that a node of a tree in memory is compared
#: with directly.
SHARD, SPLIT, LEAF = 8000, 32_000, 64
#: Fingerprints that no vantage point cuts are compared directly up to so many, so many pairs at once.
DENSE, PAIRS = 1024, 1 << 18
ALL = np.uint64(2**64 - 1)
#: Fingerprints that the vantage points of one tree are drawn from, at most; levels of one tree, at most. A shard that is
#: still too large gets a tree of its own.
SAMPLE, LEVELS = 8192, 10
#: Classes of shingles that have fingerprints of their own, and the fewest shingles a class should hold.
CLASSES, HELD = 12, 3
#: Members of a group all pairs of which are compared at once, at most; larger ones go by rounds and by rare shingles.
FEW = 64
#: Counters of shingles by which rare ones go first; pairs that one key of a join makes, about; pairs compared in one round, beside two for each document.
COUNTERS, MET, ROUND = 1 << 20, 1 << 20, 1 << 20


def shingles(text: bytes, words: int = 4, seed: int = 42) -> np.ndarray:
    """The hashes of a text's shingles, repeats included.

    A-Z become lower case, words are runs without ASCII white space, a shingle is so many words with a
    space between; fewer words are one shingle, no words give none.
    """
    parts = text.lower().split()
    if not parts:
        return np.zeros(0, np.uint64)
    joined = b" ".join(parts)
    n = max(1, len(parts) - words + 1)
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    starts = np.concatenate(([0], np.cumsum(sizes + 1)[:-1]))
    ends = (starts + sizes)[min(words, len(parts)) - 1 :]
    one = xxhash.xxh64_intdigest
    return np.fromiter((one(joined[a:b], seed) for a, b in zip(starts[:n].tolist(), ends.tolist(), strict=True)), np.uint64, n)


def bits_of(hashes: np.ndarray) -> np.ndarray:
    return np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def majority(hashes: np.ndarray) -> int:
    """64 bits, each set if over half the hashes have it set; 0 for none."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        ones += bits_of(hashes[i : i + (1 << 16)]).sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint(text: bytes, words: int = 4, seed: int = 42) -> int:
    return majority(shingles(text, words, seed))


def sketch(distinct: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of classes of a set of shingles: (fingerprint, class).

    Shingles are dealt to 2^k classes by other bits of a mix of their hash, so many that a class holds HELD to twice HELD
    of them, and the first CLASSES classes get a majority of their own. A set close below the border to the next k
    gets those classes too, so sets of a similarity of 0.8 or more share a k. If 11 % of the shingles on
    either side differ, a class is the same on both sides with a chance of 0.26 to 0.51, and so one of 12 is with 0.97 to 0.9998.
    """
    n = len(distinct)
    prints, names = [], []
    k = max(0, int(np.floor(np.log2(max(1, n) / HELD))))
    mixed = (distinct ^ (distinct >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(32)
    mixed *= np.uint64(0xD6E8FEB86659FD93)
    for level in (k, k + 1) if n >= 0.8 * HELD * 2 ** (k + 1) else (k,):
        of = mixed >> np.uint64(64 - level) if level else np.zeros(n, np.uint64)
        chosen = np.flatnonzero(of < CLASSES)
        if not len(chosen):
            continue
        chosen = chosen[np.argsort(of[chosen], kind="stable")]
        own = of[chosen]
        first = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
        held = np.diff(np.concatenate((first, [len(own)])))
        ones = np.add.reduceat(bits_of(distinct[chosen]).astype(np.int32), first)
        found = np.packbits(ones * 2 > held[:, None], axis=1, bitorder="little").view("<u8").ravel()
        large = held >= min(HELD, n)
        prints.append(found[large])
        names.append((own[first][large] + np.uint64(level * CLASSES)).astype(np.int32))
    return (np.concatenate(prints), np.concatenate(names)) if prints else (np.zeros(0, np.uint64), np.zeros(0, np.int32))


def blocks(bits: int) -> tuple[list[int], int]:
    """Masks that cut the fingerprint into blocks so that of two within `bits` one block differs in at
    most the radius returned."""
    count = bits // 2 + 1 if bits else 1
    edges = [64 * i // count for i in range(count + 1)]
    return [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:], strict=False)], bits // count


def away(fps: np.ndarray, point: int) -> np.ndarray:
    return np.bitwise_count(fps ^ np.uint64(point)).astype(np.int16)


def best_split(fps: np.ndarray, radius: int, rng: np.random.Generator) -> tuple[int, int] | None:
    """A vantage point of fps and the distance that cuts them with the fewest near the border."""
    best = None
    for point in rng.choice(fps, min(6, len(fps)), replace=False).tolist():
        counts = np.bincount(away(fps, point), minlength=66)
        below = np.cumsum(counts)
        for r in np.flatnonzero((below[:-1] >= len(fps) // 5) & (below[:-1] <= len(fps) - len(fps) // 5) & (below[:-1] < len(fps)) & (below[:-1] > 0)).tolist():
            inner, outer = below[min(r + radius, 65)], len(fps) - (below[r - radius] if r >= radius else 0)
            cost = inner + outer + 0.3 * abs(2 * below[r] - len(fps))
            if best is None or cost < best[0]:
                best = cost, point, r
    if best is None or best[0] > 1.9 * len(fps):
        return None
    return best[1:]


def cut_of(fps: np.ndarray, views: list[tuple[np.uint64, int]], rng: np.random.Generator) -> tuple | None:
    """The first view (mask, radius) of fps that a vantage point cuts: (mask, radius, point, distance)."""
    for mask, radius in views:
        cut = best_split(fps & mask, radius, rng)
        if cut:
            return mask, radius, *cut
    return None


def plant(fps: np.ndarray, depth: int, views: list[tuple[np.uint64, int]], rng: np.random.Generator) -> tuple | None:
    """A tree of (mask, radius, point, distance, inner, outer) over a sample; None is a shard."""
    cut = cut_of(fps, views, rng) if depth and len(fps) >= 8 else None
    if cut is None:
        return None
    d = away(fps & cut[0], cut[2])
    return (*cut, plant(fps[d <= cut[3]], depth - 1, views, rng), plant(fps[d > cut[3]], depth - 1, views, rng))


def route(tree: tuple | None, homes: np.ndarray, guests: np.ndarray, name: str) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
    """Deals out fingerprints to shards: each has one home, and visits every shard that may hold
    one within the radius. By the triangle inequality those differ from it by no more than the radius in their
    distance to a vantage point."""
    if not len(guests):
        return
    if tree is None:
        yield name, homes, guests
        return
    mask, radius, point, r, inner, outer = tree
    dh, dg = away(homes & mask, point), away(guests & mask, point)
    yield from route(inner, homes[dh <= r], guests[dg <= r + radius], name + "0")
    yield from route(outer, homes[dh > r], guests[dg > r - radius], name + "1")


def reached(full: np.ndarray, bits: int) -> Iterator[tuple[np.ndarray, int]]:
    """Groups of linked fingerprints, by breadth-first search: (members, the first of them). Cost: what is
    visited times what is not yet, so a dense group costs little more than its size."""
    left = np.arange(len(full))
    while len(left):
        seed, left = left[:1], left[1:]
        found, front = [seed], seed
        while len(front) and len(left):
            hit = np.zeros(len(left), bool)
            for i in range(0, len(front), 64):
                rest = np.flatnonzero(~hit)
                if not len(rest):
                    break
                hit[rest] = (np.bitwise_count(full[left[rest]][:, None] ^ full[front[i : i + 64]][None, :]) <= bits).any(1)
            front, left = left[hit], left[~hit]
            found.append(front)
        if len(found) > 1:
            members = np.concatenate(found)
            yield members, int(seed[0])


def search(homes: np.ndarray, guests: np.ndarray, mask: np.uint64, bits: int, radius: int, rng: np.random.Generator) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links between guests and homes, by a vantage-point tree in memory: arrays of their ends.
    A dense node gives links that connect its groups, not all pairs."""
    stack = [(homes, guests)]
    while stack:
        h, g = stack.pop()
        if not len(h) or not len(g):
            continue
        # where the block alone prunes nothing, whole fingerprints do, within all the bits
        cut = cut_of(h, [(mask, radius), (ALL, bits)], rng) if len(h) > LEAF else None
        if cut:
            view, reach, point, r = cut
            dh, dg = away(h & view, point), away(g & view, point)
            stack.append((h[dh <= r], g[dg <= r + reach]))
            stack.append((h[dh > r], g[dg > r - reach]))
        elif len(h) > DENSE:
            both = np.union1d(g, h)
            for members, first in reached(both, bits):
                yield np.full(len(members), both[first]), both[members]
        else:
            step = max(1, PAIRS // len(h))
            for i in range(0, len(g), step):
                part = g[i : i + step]
                a, b = np.nonzero(np.bitwise_count(part[:, None] ^ h[None, :]) <= bits)
                ends = part[a], h[b]
                yield forest(*ends) if len(a) > 4 * (len(part) + len(h)) else ends


def packed(held: dict[str, list]) -> pa.RecordBatch:
    """(shard, homes, guests), fingerprints as bytes."""
    columns = [[np.concatenate([x[i] for x in pairs]).tobytes() for pairs in held.values()] for i in (0, 1)]
    return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), *(pa.array(c, pa.binary()) for c in columns)], names=["shard", "homes", "guests"])


def linked(scratch: Scratch, fps: DataFrame, bits: int) -> DataFrame:
    """(fp, component) of distinct fingerprints (fp): those that link at `bits` or fewer differing bits with others.

    Fingerprints are cut into blocks, so that linked ones differ in few bits of some block (for 4 bits: at most one of
    some of three). For each block a vantage-point tree, drawn from a bounded sample, deals them out to shards. A shard
    over SPLIT gets a tree of its own, drawn from a sample of it, over the block or whole fingerprints, until
    none is over; one that no vantage point cuts is compared in pairs of pieces. Each shard builds trees in
    memory too, and returns links that connect what it found linked, at most one for each fingerprint.
    """
    n = fps.count()
    sample = np.array([r[0] for r in fps.select("fp").orderBy(F.xxhash64("fp", F.lit(1))).limit(SAMPLE).collect()], np.int64).view(np.uint64)
    masks, radius = blocks(bits)
    depth = int(min(LEVELS, max(2, np.ceil(np.log2(max(1, n) / SHARD)))))
    trees = [plant(sample, depth, [(np.uint64(m), radius)], np.random.default_rng(k)) for k, m in enumerate(masks)]

    def views(shard: str) -> list[tuple[np.uint64, int]]:
        return [(np.uint64(masks[int(shard.split(":")[0])]), radius), (ALL, bits)]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = defaultdict(list), 0
        for batch in batches:
            found = np.asarray(batch.column(0)).astype(np.int64).view(np.uint64)
            for k, tree in enumerate(trees):
                for shard, homes, guests in route(tree, found, found, f"{k}:"):
                    held[shard].append((homes, guests))
                    size += len(homes) + len(guests)
            if size > 1 << 21:
                yield packed(held)
                held.clear()
                size = 0
        if held:
            yield packed(held)

    def drawn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A share of the homes that makes about SAMPLE of each shard, chosen by their values."""
        for batch in batches:
            out = []
            for homes, n in zip(batch.column("homes"), np.asarray(batch.column("n")).tolist(), strict=True):
                found = np.frombuffer(homes.as_buffer(), "<u8")
                mixed = (found ^ (found >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
                out.append(found[mixed < np.uint64(min(1.0, SAMPLE / n) * (2**64 - 2049))].tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("shard"), pa.array(out, pa.binary())], names=["shard", "homes"])

    def planted(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = key[0].as_py()
        found = np.concatenate([np.frombuffer(x.as_buffer(), "<u8") for batch in batches for x in batch.column("homes")])
        tree = plant(np.unique(found), LEVELS, views(shard), np.random.default_rng(len(shard)))
        yield pa.RecordBatch.from_arrays([pa.array([shard]), pa.array([pickle.dumps(tree)], pa.binary())], names=["shard", "tree"])

    def deal_again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                shard, tree = batch.column("shard")[i].as_py(), pickle.loads(batch.column("tree")[i].as_py())
                homes, guests = (np.frombuffer(batch.column(c)[i].as_buffer(), "<u8") for c in ("homes", "guests"))
                held = defaultdict(list)
                if tree is not None:
                    for to, h, g in route(tree, homes, guests, shard):
                        held[to].append((h, g))
                else:  # pieces by value, each home with each guest
                    pieces = -(-int(batch.column("n")[i].as_py()) // SPLIT)
                    h, g = homes % np.uint64(pieces), guests % np.uint64(pieces)
                    for a in range(pieces):
                        for b in range(pieces):
                            held[f"{shard}:{a}-{b}"].append((homes[h == a], guests[g == b]))
                yield packed(held)

    def link(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mask = views(key[0].as_py())[0][0]
        homes, guests = [], []
        for batch in batches:
            for to, name in ((homes, "homes"), (guests, "guests")):
                to += [np.frombuffer(x.as_buffer(), "<u8") for x in batch.column(name)]
        found = list(search(np.concatenate(homes), np.concatenate(guests), mask, bits, radius, np.random.default_rng(0)))
        if found:
            a, b = forest(np.concatenate([x[0] for x in found]), np.concatenate([x[1] for x in found]))
            for i in range(0, len(a), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x[i : i + 50_000]).view(np.int64)) for x in (a, b)], names=["a", "b"])

    kind = "shard string, homes binary, guests binary"
    dealt = scratch.save(fps.select("fp").mapInArrow(deal, kind))
    ready = []
    while True:
        sizes = dealt.groupBy("shard").agg(F.sum(F.octet_length("homes") / 8).cast("long").alias("n"))
        # pieces of what no vantage point cuts (two colons) are as small as they get
        large = scratch.save(sizes.where((F.col("n") > SPLIT) & ~F.col("shard").rlike(":.*:")))
        if large.isEmpty():
            ready.append(dealt)
            break
        ready.append(dealt.join(large, "shard", "left_anti"))
        rest = dealt.join(large, "shard")
        grown = rest.select("shard", "homes", "n").mapInArrow(drawn, "shard string, homes binary").groupBy("shard").applyInArrow(planted, "shard string, tree binary")
        dealt = scratch.save(rest.join(scratch.save(grown), "shard").mapInArrow(deal_again, kind))
    whole = reduce(DataFrame.unionByName, ready)
    edges = scratch.save(whole.groupBy("shard").applyInArrow(link, "a long, b long"))
    return components(scratch, edges).withColumnRenamed("node", "fp")


def simhash_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, bits: int = 4, row_col: str | None = None) -> DataFrame:
    """id_col, fingerprint (16 hexadecimal digits), component_id, kept for each document, and row_col, a unique number of the
    row, if there is one.

    Fingerprints (see shingles, majority) link at `bits` or fewer differing bits, however many there are (see linked);
    component_id is the smallest id reachable. kept: one row of each component, the first of those with that id.

    Null texts count as empty (fingerprint 0, linked like any other). A null id is larger than
    all others; a component of null ids only has a null component_id. Repeated rows are rows of their own. Other
    columns are not read; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "simhash")
    kind = docs.schema[id_col].dataType.simpleString()

    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(x.as_buffer().to_pybytes() if x.is_valid else b"", words) for x in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("row"), pa.array(np.array(found, np.uint64).view(np.int64))], names=["id", "row", "fp"])

    row = F.col(row_col) if row_col else F.monotonically_increasing_id()
    rows = docs.select(F.col(id_col).alias("id"), row.alias("row"), F.encode(F.col(text_col).cast("string"), "UTF-8").alias("text"))
    rows = scratch.save(rows.mapInArrow(trimmed(prints), f"id {kind}, row long, fp long"))
    fps = scratch.save(rows.groupBy("fp").agg(F.min("id").alias("least")))
    label = linked(scratch, fps, bits)
    named = fps.join(label, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    named = scratch.save(named.join(least, "component").select("fp", "component", "component_id"))
    # the first row of those with the component's id
    out = rows.join(named, "fp")
    first = out.where(F.col("id").eqNullSafe(F.col("component_id"))).groupBy("component").agg(F.min("row").alias("first")).withColumnRenamed("component", "c")
    out = out.join(first, (F.col("row") == F.col("first")), "left")
    return out.select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", F.col("first").isNotNull().alias("kept"), *([F.col("row").alias(row_col)] if row_col else []))


def paired(members: DataFrame, similarity: float) -> DataFrame:
    """(row, first): all pairs of members (grp, row, size) of one group that are like in size: of sets that are not, none is that similar."""
    other = members.select("grp", F.col("row").alias("first"), F.col("size").alias("m"))
    met = members.join(other, "grp").where((F.col("row") > F.col("first")) & (F.least("size", "m") >= similarity * F.greatest("size", "m")))
    return met.select("row", "first").distinct()


def rare_first(sets: DataFrame, similarity: float) -> DataFrame:
    """(row, comp, n, w, at): of each set (row, comp, shingles) of n shingles the first ones, w at place `at`, in an order that all sets share, rare ones
    first: so many that two sets of that similarity have the first shingle that they share among those of both.

    Which ones are rare is told by COUNTERS counters, a shingle's by its hash: the order matters to speed alone."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(COUNTERS, np.int64)
        for batch in batches:
            held += np.bincount(np.asarray(batch.column("shingles").flatten()).view(np.uint64) % COUNTERS, minlength=COUNTERS)
        yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(held)), pa.array(held[held > 0])], names=["at", "n"])

    counted = sets.select("shingles").mapInArrow(trimmed(count), "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    level = np.zeros(COUNTERS, np.uint8)  # a byte each: eighths of the logarithm
    level[np.asarray(counted["at"])] = np.minimum(255, 8 * np.log2(np.asarray(counted["n"])))

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                rows, found, places, sizes = [], [], [], []
                for k, x in enumerate(part.column("shingles")):
                    own = np.asarray(x.values).view(np.uint64)
                    # a set as similar holds at least this share of the shingles; what is cut off for rounding makes the list longer at most
                    most = len(own) - int(np.ceil(similarity * len(own) - 1e-9)) + 1
                    found.append(own[np.lexsort((own, level[own % COUNTERS]))[:most]])
                    places.append(np.arange(len(found[-1])))
                    rows.append(np.full(len(found[-1]), k))
                    sizes.append(np.full(len(found[-1]), len(own)))
                if rows:
                    at = pa.array(np.concatenate(rows))
                    numbers = (np.concatenate(sizes).astype(np.int32), np.concatenate(found).view(np.int64), np.concatenate(places).astype(np.int32))
                    yield pa.RecordBatch.from_arrays([part.column("row").take(at), part.column("comp").take(at), *map(pa.array, numbers)], names=["row", "comp", "n", "w", "at"])

    return sets.select("row", "comp", "shingles").mapInArrow(trimmed(first), "row long, comp long, n int, w long, at int")


def likely(similarity: float) -> Column:
    """Whether two sets of n and m shingles whose first common one is at the places `at` and `j` can be as similar: from there on each holds enough for what they must share."""
    return (F.least("n", "m") >= similarity * F.greatest("n", "m")) & (F.least(F.col("n") - F.col("at"), F.col("m") - F.col("j")) >= similarity / (1 + similarity) * (F.col("n") + F.col("m")) - 1e-6)


def central(found: DataFrame, similarity: float) -> DataFrame:
    """(row, first): each set of found (see rare_first) with the most central one that holds one of its first shingles, if they are of two
    components and can be as similar; a pair at most for each row of found.

    The most central set of a shingle is that with the fewest rarer ones. Of near copies of one text it is the least changed one, with which nearly
    all link that link with any."""
    least = found.groupBy("w").agg(F.min(F.struct("at", "row", "n", "comp")).alias("c")).select("w", F.col("c.row").alias("first"), F.col("c.n").alias("m"), F.col("c.at").alias("j"), F.col("c.comp").alias("of"))
    met = found.join(least, "w").where(likely(similarity) & (F.col("comp") != F.col("of")))
    return met.select(F.greatest("row", "first").alias("row"), F.least("row", "first").alias("first")).distinct()


def sharing(scratch: Scratch, found: DataFrame, similarity: float) -> list[DataFrame]:
    """(row, first): pairs of sets of found (see rare_first) of two components, in lists of bounded size: all that can be as similar, and others.

    Sets as similar share one of their first shingles, and from that place on each holds enough for what they must share.
    Of the sets with a shingle, those outside the largest component meet all others; many are dealt out in pairs of parts.
    How many lists there are is told by the number of pairs."""
    counts = found.groupBy("w", "comp").agg(F.count("*").alias("c")).groupBy("w").agg(F.count("*").alias("comps"), F.sum("c").alias("c"), F.max(F.struct("c", "comp")).alias("big"))
    counts = counts.where("comps > 1").select("w", F.col("big.comp").alias("big"), F.ceil(F.sqrt(F.col("c") * (F.col("c") - F.col("big.c")) / MET)).cast("int").alias("parts"))
    shared = scratch.save(found.join(counts, "w").withColumn("small", F.col("comp") != F.col("big")).drop("big"))
    mine, every = F.pmod(F.xxhash64("row"), F.col("parts")).cast("int"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    asked = shared.where("small").withColumn("a", mine).withColumn("b", every).drop("small", "parts")
    other = shared.withColumn("b", mine).withColumn("a", every).select("w", "a", "b", F.col("row").alias("first"), F.col("comp").alias("of"), "small", F.col("n").alias("m"), F.col("at").alias("j"))
    met = asked.join(other, ["w", "a", "b"]).where(likely(similarity) & (F.col("comp") != F.col("of")) & (~F.col("small") | (F.col("row") > F.col("first"))))
    pairs = met.select(F.greatest("row", "first").alias("row"), F.least("row", "first").alias("first"))
    # each set has one shingle that is its first
    rounds = int(-(-met.count() // (ROUND + 2 * found.where("at = 0").count())))
    return [pairs.where(F.pmod(F.xxhash64("row", "first"), F.lit(rounds)) == i).distinct() for i in range(rounds)]


def near_dedup(docs: DataFrame, row_col: str, text_col: str = "text", words: int = 5, similarity: float = 0.8, bits: int = 8, order: list | None = None) -> DataFrame:
    """(row_col, component, kept): documents linked at `similarity` or more, by the sets of their shingles of `words` words.

    At that similarity whole fingerprints differ in 10 bits on average, within which trees prune little. So trees find those within
    `bits` of one another, and each document gets several more fingerprints, of samples of its shingles (see sketch), that
    are equal in near copies often enough. Either way they make groups of documents. In each group the
    members are candidates. Groups of up to FEW members are compared pair by pair, shingle by shingle, where they are like in size.
    In larger ones the members are compared with the first;
    those that don't link are a group again, as long as such rounds link much, so a dense group gives a pair for
    each member and round. Where a group is not one component then, members of different components are compared if they share a shingle that
    two so similar must share (see sharing), equal sets as one, with central members first (see central). So each link within a group is found
    or implied by others. Where very many of a group are nearly that similar to many others, but to no central one, this grows with the square of
    the group, in rounds of bounded size.

    Short texts have few classes of shingles, so links just at `similarity` are found less often there: of sets of 45 shingles by
    calculation some 93 %, and of sets of under ten that differ in one shingle few.

    kept: of each component the first row in `order` (columns of docs; row_col is the last). Empty texts have no shingles and
    link with nothing; null texts count as empty. row_col is a unique, stable number of the row. An
    empty table gives an empty result.
    """
    scratch = Scratch(docs.sparkSession, "near")
    by = [F.col(c) for c in (order or [])]

    def listed(ids: list, columns: list[list[np.ndarray]], names: list[str]) -> pa.RecordBatch:
        lists = [pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum([len(x) for x in c]))), pa.int32()), pa.array(np.concatenate(c))) for c in columns]
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *lists], names=["row", *names])

    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, fps, places, counts = [], [], [], []
            for i, x in zip(batch.column("row").to_pylist(), batch.column("text"), strict=True):
                found = shingles(x.as_buffer().to_pybytes(), words)
                distinct = np.unique(found)
                own, names = sketch(distinct)
                counts.append(np.array([len(distinct)], np.int32))
                if len(found):
                    own, names = np.append(own, np.uint64(majority(found))), np.append(names, np.int32(-1))
                ids.append(i)
                fps.append(own.view(np.int64))
                places.append(names)
            if ids:
                yield listed(ids, [fps, places, counts], ["fps", "places", "n"])

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, held = [], []
            for i, x in zip(batch.column("row").to_pylist(), batch.column("text"), strict=True):
                ids.append(i)
                held.append(np.unique(shingles(x.as_buffer().to_pybytes(), words)).view(np.int64))
                if sum(map(len, held)) > 500_000:
                    yield listed(ids, [held], ["shingles"])
                    ids, held = [], []
            if ids:
                yield listed(ids, [held], ["shingles"])

    texts = docs.select(F.col(row_col).alias("row"), F.encode(F.coalesce(F.col(text_col).cast("string"), F.lit("")), "UTF-8").alias("text"))
    read = texts.mapInArrow(trimmed(prints), "row long, fps array<long>, places array<int>, n array<int>")
    ranks = docs.select(F.col(row_col).alias("row"), F.struct(*by, F.col(row_col)).alias("order"))
    own = scratch.save(read.select("row", F.get("n", F.lit(0)).alias("size"), F.explode(F.arrays_zip("fps", "places")).alias("x")).select("row", F.col("x.fps").alias("fp"), (F.col("x.places") < 0).alias("whole"), F.when(F.col("x.places") < 0, F.col("size")).alias("size")))

    # groups of documents: components of whole fingerprints, equal ones of samples
    whole = own.where("whole")
    label = linked(scratch, scratch.save(whole.select("fp").distinct()), bits)
    groups = [whole.join(label, "fp", "left").select("row", F.xxhash64(F.coalesce("component", "fp"), F.lit(True)).alias("grp"))]
    groups.append(own.where("not whole").select("row", F.xxhash64("fp", F.lit(False)).alias("grp")))
    members = reduce(DataFrame.unionByName, groups)
    # most groups are of one document: only those that may be larger move twice
    counted = scratch.save(members.groupBy("grp").agg(F.count("*").alias("n")).where("n > 1"))
    members = with_maybe(members, F.col("grp"), scratch.save(key_filter(counted.select(F.col("grp").alias("h")))), "maybe").where("maybe").drop("maybe")
    members = members.join(counted, "grp").join(whole.select("row", "size"), "row").join(ranks, "row")
    members = scratch.save(members.select("grp", "row", "order", "size", "n"))
    close = scratch.save(paired(members.where(F.col("n") <= FEW).select("grp", "row", "size"), similarity))
    every = members.where(F.col("n") > FEW).drop("n")

    # shingles of candidates only: a filter of bounded size takes them (and a few others) out of the scan
    wanted = reduce(DataFrame.unionByName, [close.select("row"), close.select(F.col("first").alias("row")), every.select("row")])
    held = scratch.save(key_filter(wanted.select(F.xxhash64("row").alias("h"))))
    some = with_maybe(texts, F.xxhash64("row"), held, "maybe").where("maybe").select("row", "text")
    sizes = scratch.save(some.mapInArrow(trimmed(sets), "row long, shingles array<long>").withColumn("n", F.size("shingles")))

    def alike(pairs: DataFrame) -> DataFrame:
        """Of pairs (row, first) those that link, as (a, b)."""
        asked = pairs.join(sizes, "row").join(sizes.select(F.col("row").alias("first"), F.col("shingles").alias("b"), F.col("n").alias("m")), "first")
        # sets so unlike in size can't be that similar
        asked = asked.where((F.least("n", "m") >= similarity * F.greatest("n", "m")) & (F.col("n") > 0))
        both = F.size(F.array_intersect("shingles", "b"))
        return asked.where(both >= similarity * (F.col("n") + F.col("m") - both)).select(F.col("first").alias("a"), F.col("row").alias("b"))

    links = scratch.save(alike(close))
    members, turn = every, 0
    while not members.isEmpty():
        turn += 1
        first = members.groupBy("grp").agg(F.min(F.struct("order", "row", "size")).alias("f")).select("grp", F.col("f.row").alias("first"), F.col("f.size").alias("m"))
        pairs = scratch.save(members.join(first, "grp").where("row <> first"))
        like = F.least("size", "m") >= similarity * F.greatest("size", "m")
        found = scratch.save(alike(pairs.where(like).select("row", "first").distinct()))
        links = links.unionByName(found)
        done = pairs.join(found, (F.col("row") == F.col("b")) & (F.col("first") == F.col("a")), "left_anti")
        members = scratch.save(done.select("grp", "row", "order", "size"))
        if turn >= 4 and 20 * found.count() < pairs.count():
            break
    if turn:
        # groups that are not one component yet
        label = components(scratch, links).withColumnRenamed("node", "row")
        named = scratch.save(every.select("grp", "row").join(label, "row", "left").withColumn("comp", F.coalesce("component", "row")))
        several = named.groupBy("grp").agg((F.min("comp") != F.max("comp")).alias("several")).where("several")
        rest = named.join(several, "grp", "left_semi").select("row", "comp").distinct()
        rest = scratch.save(rest.join(sizes.where("n > 0"), "row").select("row", "comp", "shingles", F.xxhash64("shingles").alias("h")))
        # of equal sets one goes on, for all of them
        one = rest.groupBy("h").agg(F.min("row").alias("first")).join(rest.select(F.col("row").alias("first"), F.col("shingles").alias("b")), "first")
        seen = scratch.save(rest.join(one, "h").select("row", "first", "comp", "shingles", (F.col("shingles") == F.col("b")).alias("same")))
        links = links.unionByName(seen.where("same and row <> first").select(F.col("first").alias("a"), F.col("row").alias("b")))
        found = scratch.save(rare_first(seen.where("not same or row = first"), similarity))
        # links with central members first: they leave few components, so that few pairs are left
        near = scratch.save(alike(central(found, similarity)))
        if not near.isEmpty():
            links = links.unionByName(near)
            label = components(scratch, links).withColumnRenamed("node", "row")
            found = scratch.save(found.drop("comp").join(label, "row", "left").select("row", F.coalesce("component", "row").alias("comp"), "n", "w", "at"))
        for pairs in sharing(scratch, found, similarity):
            links = links.unionByName(scratch.save(alike(pairs)))

    if links.isEmpty():
        return ranks.select(F.col("row").alias(row_col), F.col("row").alias("component"), F.lit(True).alias("kept"))
    label = components(scratch, links).withColumnRenamed("node", "row")
    named = scratch.save(ranks.join(label, "row"))
    first = named.groupBy("component").agg(F.min("order").alias("least")).select(F.col("component").alias("c"), "least")
    near = named.join(first, F.col("component") == F.col("c")).select("row", "component", (F.col("order") == F.col("least")).alias("kept"))
    out = ranks.join(near, "row", "left")
    return out.select(F.col("row").alias(row_col), F.coalesce("component", "row").alias("component"), F.coalesce("kept", F.lit(True)).alias("kept"))
