"""Quality scores by a byte-level convolutional network in numpy."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import trimmed

#: Bytes a filter sees, of a letter's embedding, filters, bytes between two windows.
WIDTH, DIM, FILTERS, STEP = 8, 8, 24, 2
#: A chunk is two blocks; chunks begin at each block, so they overlap by half.
BLOCK = 512


@dataclass
class Network:
    """score = sigmoid(mean over chunks of relu(max over the chunk's windows of filter + shift + lift * gap) . out + bias).

    gap says how many windows the chunk lacks: half the base-2 logarithm of its size over
    its bytes. The maximum over few windows is lower, and lift makes up for that.
    """

    letters: np.ndarray  # 256 x DIM
    filters: np.ndarray  # WIDTH * DIM x FILTERS
    shift: np.ndarray  # FILTERS
    lift: np.ndarray  # FILTERS
    out: np.ndarray  # FILTERS
    bias: float

    def blocks(self, data: np.ndarray, where: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
        """For each block of data (whole blocks, then WIDTH bytes more) the maximum of each filter over the
        windows that begin in it, and the windows' places if asked for; a megabyte at a time."""
        n, step = len(data) - WIDTH, 2048 * BLOCK
        if n > step:
            parts = [(i, *self.blocks(data[i : min(i + step, n) + WIDTH], where)) for i in range(0, n, step)]
            return np.concatenate([x for _, x, _ in parts]), np.concatenate([x + i for i, _, x in parts]) if where else None
        seen = self.letters[data]
        best = place = None
        for at in range(0, WIDTH, STEP):
            made = (seen[at : at + n].reshape(n // WIDTH, WIDTH * DIM) @ self.filters).reshape(n // BLOCK, BLOCK // WIDTH, FILTERS)
            most = made.max(1)
            if where:
                spot = made.argmax(1) * WIDTH + at + np.arange(0, n, BLOCK)[:, None]
                place = spot if best is None else np.where(most > best, spot, place)
            best = most if best is None else np.maximum(best, most)
        return best, place

    def logits(self, best: np.ndarray, starts: np.ndarray, counts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Of texts of sizes bytes whose blocks begin at starts: the mean over chunks."""
        chunk = np.maximum(best, np.concatenate((best[1:], best[-1:])))
        chunk[starts + counts - 1] = best[starts + counts - 1]  # the last block has none after it
        each = np.maximum(chunk + self.shift + gaps(starts, counts, sizes)[:, None] * self.lift, 0) @ self.out
        each[(starts + counts - 1)[counts > 1]] = 0  # the last block is in the chunk before it
        return np.add.reduceat(each, starts) / np.maximum(counts - 1, 1) + self.bias


def gaps(starts: np.ndarray, counts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    inside = np.repeat(sizes, counts) - (np.arange(counts.sum()) - np.repeat(starts, counts)) * BLOCK
    return (np.log2(2 * BLOCK / np.clip(inside, 8, 2 * BLOCK)) / 2).astype(np.float32)


def pack(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of texts, each filled with zeros to whole blocks that hold WIDTH more; starts and counts in blocks."""
    counts = np.array([-(-(len(t) + WIDTH) // BLOCK) for t in texts], np.int64)
    starts = np.cumsum(counts) - counts
    data = np.zeros(int(counts.sum()) * BLOCK + WIDTH, np.uint8)
    for t, at in zip(texts, (starts * BLOCK).tolist(), strict=True):
        data[at : at + len(t)] = t
    return data, starts, counts


def train(texts: list[bytes], labels: np.ndarray, steps: int = 220, batch: int = 96, rate: float = 0.01, seed: int = 7) -> Network:
    """Adam on the cross-entropy; two texts of a batch are of label 1, one is of label 0, and a quarter are cut to
    a short piece. The gradient of a maximum reaches one window of each chunk and filter, so
    a step costs little more than the scores."""
    rng = np.random.default_rng(seed)
    f32 = np.float32
    net = Network(rng.normal(0, 0.5, (256, DIM)).astype(f32), rng.normal(0, (WIDTH * DIM) ** -0.5, (WIDTH * DIM, FILTERS)).astype(f32), np.zeros(FILTERS, f32), np.zeros(FILTERS, f32), rng.normal(0, 0.3, FILTERS).astype(f32), 0.0)
    net.letters[0] = 0
    arrays = [np.frombuffer(t, np.uint8) for t in texts]
    groups = [g for g in (np.flatnonzero(labels == 1), np.flatnonzero(labels == 0)) if len(g)]
    if len(groups) < 2:
        net.out[:] = 0
        net.bias = 3.0 if len(texts) == 0 or labels[0] == 1 else -3.0
        return net
    params = [net.letters, net.filters, net.shift, net.lift, net.out]
    bias = np.zeros(1, f32)
    params.append(bias)
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for step in range(1, steps + 1):
        pick = np.concatenate([rng.choice(g, n) for g, n in zip(groups, (batch * 2 // 3, batch // 3), strict=True)])
        y = labels[pick].astype(f32)
        some = [arrays[i] for i in pick]
        for i in np.flatnonzero(rng.random(len(some)) < 0.25).tolist():
            n = int(2 ** rng.uniform(4, 9))
            at = int(rng.integers(0, max(1, len(some[i]) - n)))
            some[i] = some[i][at : at + n]
        data, starts, counts = pack(some)
        gap = gaps(starts, counts, np.array([len(x) for x in some]))
        best, place = net.blocks(data, True)
        after = np.concatenate((np.arange(1, len(best)), [len(best) - 1]))
        last = starts + counts - 1
        after[last] = last
        take = best[after] > best  # whether the chunk's maximum is in its second block
        chunk = np.where(take, best[after], best) + net.shift + gap[:, None] * net.lift
        spot = np.where(take, place[after], place)
        doc = np.repeat(np.arange(len(pick)), counts)
        used = np.ones(len(best), bool)
        used[last[counts > 1]] = False
        share = used / np.maximum(counts - 1, 1)[doc]
        hidden = np.maximum(chunk, 0)
        logit = np.bincount(doc, (hidden @ net.out) * share, len(pick)) + bias[0]
        slope = ((1 / (1 + np.exp(-logit)) - y) / len(pick)).astype(f32)
        down = (slope[doc] * share).astype(f32)
        g_out = hidden.T @ down
        g_hidden = np.where(chunk > 0, down[:, None] * net.out, 0).astype(f32)
        rows, cols = np.nonzero(g_hidden)
        g = g_hidden[rows, cols]
        window = data[spot[rows, cols][:, None] + np.arange(WIDTH)]
        seen = net.letters[window].reshape(len(rows), WIDTH * DIM)
        g_filters = np.zeros_like(net.filters)
        for k in range(FILTERS):
            of = cols == k
            g_filters[:, k] = g[of] @ seen[of]
        back = (g[:, None] * net.filters.T[cols]).reshape(-1, DIM)
        flat = window.reshape(-1)
        g_letters = np.stack([np.bincount(flat, back[:, d], 256) for d in range(DIM)], 1).astype(f32)
        g_letters[0] = 0
        for i, (p, g) in enumerate(zip(params, (g_letters, g_filters, g_hidden.sum(0), gap @ g_hidden, g_out, np.array([slope.sum()], f32)), strict=True)):
            first[i] = 0.9 * first[i] + 0.1 * g
            second[i] = 0.999 * second[i] + 0.001 * g * g
            p -= (rate * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)).astype(f32)
    net.bias = float(bias[0])
    return net


def held_out(key: Column, fold: int = 2, folds: int = 4) -> Column:
    return F.coalesce(F.pmod(F.crc32(F.encode(key.cast("string"), "UTF-8")), F.lit(folds)) == fold, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_labels: int = 2000, max_bytes: int = 64 << 20) -> Network:
    """A network fitted on a bounded sample of the labelled rows outside the held-out fold, on their whole texts.

    The sample is the rows first in the order of a digest of their id: at most max_labels, whose texts are of at most
    max_bytes together (a text over a sixteenth of that is in no sample). That bounds what the driver gets. The
    ids are broadcast: their number is bounded by max_labels. Labels other than 0 and 1 and null ids don't count; of
    several labels of one id the largest does. Without labels of both kinds every text gets one score.
    """
    names = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & ~held_out(F.col(id_col))).groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).alias("_y"))
    names = names.orderBy(F.xxhash64("_id"), "_id").limit(max_labels)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("_id"), F.encode(text, "UTF-8").alias("_text")).join(F.broadcast(names), "_id")
    rows = rows.select("_y", "_text", F.octet_length("_text").alias("_n"), F.xxhash64("_id").alias("_h"), F.md5("_text").alias("_m"))
    rows = rows.where(F.col("_n") <= max_bytes // 16)
    # the running size is of sizes alone: at most max_labels rows and those that repeat their ids
    order = Window.orderBy("_h", "_m").rowsBetween(Window.unboundedPreceding, 0)
    ends = rows.select("_h", "_m", "_n").withColumn("_end", F.sum("_n").over(order)).withColumn("_at", F.row_number().over(Window.orderBy("_h", "_m")))
    last = ends.where((F.col("_end") <= max_bytes) & (F.col("_at") <= max_labels)).orderBy(F.desc("_at")).limit(1).select("_h", "_m").collect()
    if not last:
        return train([], np.zeros(0, np.int64))
    found = rows.where(F.struct("_h", "_m") <= F.struct(F.lit(last[0]["_h"]), F.lit(last[0]["_m"]))).orderBy("_h", "_m").limit(max_labels).collect()
    return train([bytes(r["_text"]) for r in found], np.array([r["_y"] for r in found], np.int64))


def probabilities(net: Network, texts: pa.Array) -> np.ndarray:
    """Of the whole texts of an array; a megabyte at a time, however long a text is."""
    n = len(texts)
    offsets = np.frombuffer(texts.buffers()[1], np.int32, n + 1, texts.offset * 4)
    body = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    sizes = np.diff(offsets)
    out = np.zeros(n)
    begin = 0
    while begin < n:
        stop, held = begin, 0
        while stop < n and (stop == begin or held + sizes[stop] < 1 << 20):
            held += int(sizes[stop]) + BLOCK
            stop += 1
        data, starts, counts = pack([body[offsets[i] : offsets[i + 1]] for i in range(begin, stop)])
        out[begin:stop] = net.logits(net.blocks(data)[0], starts, counts, sizes[begin:stop])
        begin = stop
    return 1 / (1 + np.exp(-np.clip(out, -60, 60)))


def accepted(docs: DataFrame, net: Network, text_col: str = "text", cut: float = 0.7) -> DataFrame:
    """The rows of docs that score at least `cut`, as they are; no rows move."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield batch.filter(pa.array(probabilities(net, pc.fill_null(batch.column(text_col), "")) >= cut))

    return docs.mapInArrow(trimmed(work), docs.schema)


def score(docs: DataFrame, net: Network, id_col: str = "doc_id", text_col: str = "text", cut: float = 0.7) -> DataFrame:
    """id_col, held_out, score, predicted for each document.

    Null and empty texts count as one block of zeros and get a score. Rows are independent, no
    rows move; repeated rows and null ids are kept. A task holds one Arrow batch and the
    windows of a megabyte of text, however long a text is. Other columns are not read.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(probabilities(net, batch.column("text")))], names=["id", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    out = rows.mapInArrow(trimmed(work), f"id {kind}, score double")
    return out.select(F.col("id").alias(id_col), held_out(F.col("id")).alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))
