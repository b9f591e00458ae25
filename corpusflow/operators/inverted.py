"""An inverted index that is kept: postings in blocks with bounds of what they can score, and searches that open few of them."""

from __future__ import annotations

import json
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import lowered, tokens
from ..sources.scratch import remove, saved
from . import retrieval

#: Documents of a range at most (65,536 can be told apart); terms and postings of a folder on average, folders at most; folders that a search names at most.
RANGE, TERMS, POSTINGS, FOLDERS, NAMED = 1024, 512, 1 << 19, 4096, 1000
#: Postings that a task holds at once; rows of so many times a row's mean are dealt out by range too.
HELD, WIDE = 1 << 20, 4
#: What a row's blocks are packed as: bounds of each block; its documents' places in their range; the same of asked terms, by their numbers.
BOUNDS = pa.schema({"term": pa.string(), "range": pa.int64(), "n": pa.int32(), "max_tf": pa.int32(), "min_dl": pa.int64()})
POSTED = pa.schema({"place": pa.uint16(), "tf": pa.int32()})
FIELDS = ["folder", "range", "n", "bounds", "postings", "ids", "dls"]
ASKED = pa.schema({"term": pa.int32(), "place": pa.uint16(), "tf": pa.int32()})


def packed(schema: pa.Schema, *columns: np.ndarray | pa.Array) -> bytes:
    raw = pa.record_batch([c if isinstance(c, pa.Array) else pa.array(c, kind) for c, kind in zip(columns, schema.types, strict=True)], schema=schema).serialize()
    return raw.size.to_bytes(4, "little") + pa.compress(raw, "zstd", asbytes=True)


def unpacked(schema: pa.Schema, blob: pa.BinaryScalar) -> pa.RecordBatch:
    held = blob.as_buffer()
    return pa.ipc.read_record_batch(pa.decompress(held.slice(4), int.from_bytes(held.slice(0, 4).to_pybytes(), "little"), "zstd"), schema)


def build(docs: DataFrame, path: str, id_col: str, text_col: str, split: Callable[[Column], Column] = tokens) -> dict:
    """Writes the index of docs below path and returns its statistics.

    A block is the postings of a term in one range of documents. A task sorts the documents it holds by length and cuts them into ranges of
    RANGE, so documents of like length share a range, a block's least length bounds its scores well, and no block grows with the
    data. It packs the blocks of its ranges, so that postings move once, as compressed places of two bytes in their ranges, to be stored by
    folder (a digest of the term): a search opens the folders of its terms.

    blocks: (folder, range, n, bounds, postings), the blocks of a folder's terms in one task's ranges from `range` on, n postings in all; bounds can be
    read without postings. In folder -1: (range, ids, dls), the documents of a range by place. terms: (folder, term, df).

    Null texts are empty documents; documents without an id count for the statistics but are found by no search. An empty table
    gives an index that finds nothing.
    """
    spark = docs.sparkSession
    # texts go to Python as they are, see bm25_top
    words = docs.select(F.col(id_col).alias("id"), (lowered if split is tokens else split)(F.col(text_col)).alias("w"))
    retrieval.frequencies(words).write.mode("overwrite").parquet(f"{path}/all-terms")
    counted = spark.read.parquet(f"{path}/all-terms")
    n, total = counted.where("term is null").agg(F.coalesce(F.sum("df"), F.lit(0)), F.coalesce(F.sum("dl"), F.lit(0))).first()
    df = counted.where("term is not null").select("term", "df")
    raw = F.ln(n - F.col("df") + 0.5) - F.ln(F.col("df") + 0.5)
    known, held, mean = df.agg(F.count("*"), F.coalesce(F.sum("df"), F.lit(0)), F.avg(raw)).first()
    folders = max(1, min(FOLDERS, known // TERMS, held // POSTINGS))
    df.withColumn("folder", folder_of(folders)).repartition("folder").sortWithinPartitions("folder", "term").write.mode("overwrite").partitionBy("folder").parquet(f"{path}/terms")
    remove(spark, f"{path}/all-terms")
    kind = docs.schema[id_col].dataType.simpleString()
    rows = words.where("id is not null").mapInArrow(_pack(RANGE, HELD, folders), f"folder int, range long, n long, bounds binary, postings binary, ids array<{kind}>, dls array<long>")
    # rows of many postings, of the commonest terms, are dealt out by range too, or their folders would grow with the documents
    part = F.when((F.col("folder") < 0) | (F.col("n") * folders >= WIDE * HELD), F.pmod(F.xxhash64("range"), F.lit(max(1, n // (64 * RANGE))))).otherwise(0)
    rows.repartition("folder", part).sortWithinPartitions("folder", "range").write.mode("overwrite").partitionBy("folder").parquet(f"{path}/blocks")
    stats = {"format_version": "6.0", "documents": n, "mean_length": total / n if n and total else 1.0, "mean_weight": mean or 0.0, "terms": known, "folders": folders, "id": kind}
    spark.createDataFrame([(json.dumps(stats),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/statistics")
    return stats


def folder_of(folders: int) -> Column:
    return F.pmod(F.crc32("term"), F.lit(folders)).cast("int")


def _pack(size: int, most: int, folders: int) -> Callable:
    """From (id, w) the rows of the index, for ranges of `size` documents; about `most` postings are held at once."""

    def rows(ids: pa.Array, dl: np.ndarray, doc: np.ndarray, term: np.ndarray, tf: np.ndarray, names: pa.Array, first: int) -> Iterator[pa.RecordBatch]:
        """Those of documents (ids, dl) and their postings (doc, term, tf), with ranges from `first` on."""
        by_length = np.argsort(dl, kind="stable")
        place = np.empty(len(dl), np.int64)
        place[by_length] = np.arange(len(dl))
        dl = dl[by_length]
        ends = np.append(np.arange(0, len(dl), size), len(dl)).astype(np.int32)
        many = len(ends) - 1
        lists = [pa.ListArray.from_arrays(pa.array(ends), x) for x in (ids.take(pa.array(by_length)), pa.array(dl))]
        columns = [pa.array(np.full(many, -1, np.int32)), pa.array(first + np.arange(many)), pa.array(np.diff(ends).astype(np.int64)), pa.nulls(many, pa.binary()), pa.nulls(many, pa.binary()), *lists]
        yield pa.RecordBatch.from_arrays(columns, names=FIELDS)
        if not len(doc):
            return
        folder = np.fromiter((zlib.crc32(x) % folders for x in names.cast(pa.binary()).to_pylist()), np.int32, len(names))
        order = np.asarray(pc.sort_indices(pa.table({"folder": pa.array(folder), "name": names}), [("folder", "ascending"), ("name", "ascending")])).astype(np.int64)
        code = np.empty(len(names), np.int64)
        code[order] = np.arange(len(names))
        names, folder = names.take(pa.array(order)), folder[order]
        key = code[term] * len(dl) + place[doc]
        by = np.argsort(key, kind="stable")
        key, tf = key[by], tf[by]
        term, place = key // len(dl), key % len(dl)
        at = place // size
        starts = np.flatnonzero(np.append(True, (np.diff(term) != 0) | (np.diff(at) != 0)))  # of blocks
        block = names.take(pa.array(term[starts])), pa.array(first + at[starts]), pa.array(np.diff(np.append(starts, len(key))).astype(np.int32)), pa.array(np.maximum.reduceat(tf, starts)), pa.array(dl[place[starts]])
        place = (place % size).astype(np.uint16)
        own = folder[term[starts]]
        cuts = np.append(np.flatnonzero(np.append(True, np.diff(own) != 0)), len(own))  # of folders
        posted = np.append(starts, len(key))[cuts]
        bounds = [packed(BOUNDS, *(x.slice(i, j - i) for x in block)) for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
        postings = [packed(POSTED, place[i:j], tf[i:j]) for i, j in zip(posted[:-1].tolist(), posted[1:].tolist(), strict=True)]
        many = len(bounds)
        columns = [pa.array(own[cuts[:-1]]), pa.array(np.full(many, first)), pa.array(np.diff(posted)), pa.array(bounds, pa.binary()), pa.array(postings, pa.binary()), *(pa.nulls(many, x.type) for x in lists)]
        yield pa.RecordBatch.from_arrays(columns, names=FIELDS)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 32  # no two tasks have a range in common
        held, docs, postings, terms = [], 0, 0, 0

        def flushed() -> Iterator[pa.RecordBatch]:
            ids, names = (pa.concat_arrays([x[i] for x in held]) for i in (0, 1))
            coded = names.dictionary_encode()
            dl, doc, term, tf = (np.concatenate([x[i] for x in held]) for i in range(2, 6))
            return rows(ids, dl, doc, np.asarray(coded.indices)[term], tf, coded.dictionary, first)

        for batch in batches:
            for at_row, lists in retrieval.words_in(batch.column("w")):
                sizes = np.asarray(pc.fill_null(lists.value_lengths(), 0)).astype(np.int64)
                coded = lists.flatten().dictionary_encode()
                many = max(1, len(coded.dictionary))
                cell, tf = np.unique(np.repeat(np.arange(len(lists)), sizes) * many + np.asarray(coded.indices), return_counts=True)
                held.append((batch.column("id").slice(at_row, len(lists)), coded.dictionary.cast(pa.string()), sizes, (docs + cell // many).astype(np.int32), (terms + cell % many).astype(np.int32), tf.astype(np.int32)))
                docs, postings, terms = docs + len(lists), postings + len(cell), terms + len(coded.dictionary)
                if postings >= most:
                    yield from flushed()
                    first += -(-docs // size)
                    held, docs, postings, terms = [], 0, 0, 0
        if docs:
            yield from flushed()

    return pack


def statistics(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(f"{path}/statistics").first()[0])


def gain(tf: Column, dl: Column, stats: dict, k1: float, b: float) -> Column:
    return tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / F.lit(stats["mean_length"])))


def _bounds(names: list[str] | None) -> Callable:
    """The bounds of the blocks of `names`, of all without."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = None if names is None else pa.array(names, pa.string())
        for batch in batches:
            for blob in batch.column("bounds"):
                blocks = unpacked(BOUNDS, blob)
                yield blocks if known is None else blocks.filter(pc.is_in(blocks["term"], value_set=known))

    return read


def _asked(names: list[str], most: int) -> Callable:
    """(range, data): the postings of `names`, as ASKED has them, a row for each range and about `most` postings."""

    def rows(held: list[tuple]) -> pa.RecordBatch:
        at, term, place, tf = (np.concatenate([x[i] for x in held]) for i in range(4))
        by = np.lexsort((term, at))
        at, term, place, tf = at[by], term[by], place[by], tf[by]
        cuts = np.append(np.flatnonzero(np.append(True, np.diff(at) != 0)), len(at))
        data = [packed(ASKED, term[i:j], place[i:j], tf[i:j]) for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(at[cuts[:-1]]), pa.array(data, pa.binary())], names=["range", "data"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, held, size = pa.array(names, pa.string()), [], 0
        for batch in batches:
            for i in range(batch.num_rows):
                blocks = unpacked(BOUNDS, batch.column("bounds")[i])
                code = np.asarray(pc.fill_null(pc.index_in(blocks["term"], value_set=known), -1)).astype(np.int32)
                n = np.asarray(blocks["n"])
                ok = np.repeat(code >= 0, n)
                if not ok.any():
                    continue
                posted = unpacked(POSTED, batch.column("postings")[i])
                held.append((np.repeat(np.asarray(blocks["range"]), n)[ok], np.repeat(code, n)[ok], np.asarray(posted["place"])[ok], np.asarray(posted["tf"])[ok]))
                size += len(held[-1][0])
                if size >= most:
                    yield rows(held)
                    held, size = [], 0
        if held:
            yield rows(held)

    return read


def _lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, range, places, tfs): all blocks."""
    for batch in batches:
        for i in range(batch.num_rows):
            blocks, posted = unpacked(BOUNDS, batch.column("bounds")[i]), unpacked(POSTED, batch.column("postings")[i])
            ends = pa.array(np.append(0, np.cumsum(np.asarray(blocks["n"]))), pa.int32())
            lists = [pa.ListArray.from_arrays(ends, posted[c].cast(pa.int32())) for c in ("place", "tf")]
            yield pa.RecordBatch.from_arrays([blocks["term"], blocks["range"], *lists], names=["term", "range", "places", "tfs"])


class Search:
    """One search of questions (query, text): the k best documents of each, as retrieval.bm25_top finds them.

    First only the bounds of the asked terms' blocks are read, which give for each question and range of documents the most a
    document there can score. The ranges of the highest bounds that hold k documents are scored; the k-th best score then
    rules out all ranges whose bound is lower, and the others are scored. Nothing is approximate.
    """

    def __init__(self, spark: SparkSession, path: str, queries: DataFrame, k: int, k1: float = 1.5, b: float = 0.75, idf: str = "okapi", split: Callable[[Column], Column] = tokens, every: bool = False):
        self.k, self.k1, self.b = k, k1, b
        self.stats = stats = statistics(spark, path)
        asked = queries.select("query", F.explode(split(F.col("text"))).alias("term")).groupBy("query", "term").agg(F.count("*").alias("times")).withColumn("folder", folder_of(stats["folders"]))
        few = [r["folder"] for r in asked.select("folder").distinct().limit(NAMED + 1).collect()]
        opened = (lambda t: t.where(F.col("folder").isin(few))) if len(few) <= NAMED else (lambda t: t.where("folder >= 0"))
        self.folders = len(few)
        terms = opened(spark.read.schema("term string, df long, folder int").parquet(f"{path}/terms"))
        rows = spark.read.schema(f"range long, n long, bounds binary, postings binary, ids array<{stats['id']}>, dls array<long>, folder int").parquet(f"{path}/blocks")
        self.rows, self.documents = opened(rows), rows.where("folder = -1").select("range", "ids", "dls")
        raw = retrieval.weighed(F.col("df"), F.lit(float(stats["documents"])), F.lit(stats["mean_weight"]), idf)
        self.small = asked.limit(retrieval.ASKED + 1).count() <= retrieval.ASKED
        self.names = sorted(r["term"] for r in asked.select("term").distinct().collect()) if self.small else None
        self.blocks = self.rows.select("bounds").mapInArrow(_bounds(self.names), "term string, range long, n int, max_tf int, min_dl long")
        weights = asked.join(terms.select("term", "df"), "term").select("query", "term", (raw * F.col("times")).alias("weight"))
        self.weights = F.broadcast(weights) if self.small else weights
        most = F.greatest(F.col("weight") * gain(F.col("max_tf"), F.col("min_dl"), stats, k1, b), F.lit(0.0))
        bounds = self.blocks.select("term", "range", "n", "max_tf", "min_dl").join(self.weights, "term").groupBy("query", "range")
        self.bounds = bounds.agg(F.sum(most).alias("bound"), F.max("n").alias("least"), F.min("n").alias("fewest"), F.count("*").alias("held"))
        self.needed = asked.groupBy("query").agg(F.count("*").alias("needed")) if every else None
        if every:  # a range without a block of one of the terms holds no document with all of them
            self.bounds = self.bounds.join(self.needed, "query").where("held = needed").withColumn("least", F.lit(0).cast("long"))

    def scored(self, ranges: DataFrame) -> DataFrame:
        """(query, id, score) of documents in the ranges (query, range) that hold one of the question's terms (all, if asked): of each range at
        least the k best of each question.

        A block moves once, to the task of its range, however many questions ask for its term; there scores are complete.
        """
        if not self.small:
            return self.joined(ranges)
        asked = self.weights.toPandas()  # at most ASKED rows
        needed = {} if self.needed is None else dict(map(tuple, self.needed.collect()))
        number = {t: i for i, t in enumerate(self.names)}
        by_term = {number[t]: (g["query"].to_numpy(), g["weight"].to_numpy(float)) for t, g in asked.groupby("term")}
        k, k1, b, mean, every = self.k, self.k1, self.b, self.stats["mean_length"], self.needed is not None

        def score(key: tuple, held: pa.Table, wanted: pa.Table) -> pa.Table:
            of_range = held.filter(held["data"].is_null())
            ids, dl = of_range["ids"].combine_chunks().flatten(), np.asarray(of_range["dls"].combine_chunks().flatten()).astype(np.float64)
            parts = [unpacked(ASKED, x) for x in held["data"] if x.is_valid]
            if not parts or not wanted.num_rows:
                return pa.table({"query": wanted["query"].slice(0, 0), "id": ids.slice(0, 0), "score": pa.array([], pa.float64())})
            term, doc, tf = (np.concatenate([np.asarray(x.column(c)) for x in parts]) for c in range(3))
            by = np.argsort(term, kind="stable")
            term, doc, tf = term[by], doc[by].astype(np.int64), tf[by].astype(np.float64)
            gains = tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl[doc] / mean))
            starts = np.flatnonzero(np.append(True, np.diff(term) != 0))
            blocks = list(zip(term[starts].tolist(), starts.tolist(), [*starts[1:].tolist(), len(term)], strict=True))
            whole, size, out = np.unique(np.asarray(wanted["query"])), len(ids), []
            for begin in range(0, len(whole), retrieval.QUERY_BLOCK):
                names = whole[begin : begin + retrieval.QUERY_BLOCK]
                found, held_terms = np.zeros((len(names), size)), np.zeros((len(names), size), np.int32)
                for t, i, j in blocks:
                    own, weight = by_term[t]
                    at = np.searchsorted(names, own)
                    ok = (at < len(names)) & (names[np.minimum(at, len(names) - 1)] == own)
                    here = doc[i:j]
                    for row, w in zip(at[ok].tolist(), weight[ok].tolist(), strict=True):  # a document is in a block once
                        found[row, here] += w * gains[i:j]
                        held_terms[row, here] += 1
                ok = held_terms > 0
                if every:
                    ok &= held_terms == np.array([needed.get(x, -1) for x in names.tolist()])[:, None]
                ranked = np.where(ok, np.round(found, 6), -np.inf)
                if size > k:
                    ok &= ranked >= np.partition(ranked, size - k, axis=1)[:, size - k, None]
                q, d = np.nonzero(ok)
                out.append(pa.table({"query": pa.array(names[q], wanted["query"].type), "id": ids.take(pa.array(d)), "score": pa.array(found[q, d])}))
            return pa.concat_tables(out)

        data = self.rows.select("bounds", "postings").mapInArrow(_asked(self.names, HELD), "range long, data binary")
        met = data.select("range", "data", F.lit(None).cast(self.documents.schema["ids"].dataType).alias("ids"), F.lit(None).cast("array<long>").alias("dls"))
        met = met.unionByName(self.documents.withColumn("data", F.lit(None).cast("binary"))).join(F.broadcast(ranges.select("range").distinct()), "range", "left_semi")
        query = self.weights.schema["query"].dataType.simpleString()
        some = met.groupBy("range").cogroup(ranges.select("range", "query").groupBy("range"))
        return some.applyInArrow(score, f"query {query}, id {self.stats['id']}, score double")

    def joined(self, ranges: DataFrame) -> DataFrame:
        """The same for more questions than a task holds: all documents in the ranges, blocks joined with each question."""
        blocks = self.rows.select("bounds", "postings").mapInArrow(_lists, "term string, range long, places array<int>, tfs array<int>")
        met = blocks.join(self.weights, "term").join(ranges.select("query", "range"), ["query", "range"], "left_semi")
        hits = met.select("query", "range", "weight", F.inline(F.arrays_zip(F.col("places").alias("place"), F.col("tfs").alias("tf"))))
        docs = self.documents.select("range", F.posexplode(F.arrays_zip("ids", "dls")).alias("place", "doc")).select("range", "place", F.col("doc.ids").alias("id"), F.col("doc.dls").alias("dl"))
        scored = F.sum(F.col("weight") * gain(F.col("tf"), F.col("dl"), self.stats, self.k1, self.b))
        out = hits.join(docs, ["range", "place"]).groupBy("query", "range", "place", "id").agg(scored.alias("score"), F.count("*").alias("terms"))
        if self.needed is not None:
            out = out.join(self.needed, "query").where("terms = needed")
        return out.select("query", "id", "score")

    def ranges(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        """(query, range): those that are scored first, and the others that can hold one of the k best; the k best of the first ones."""
        bounds = saved(self.bounds)
        above = F.coalesce(F.sum("least").over(Window.partitionBy("query").orderBy(F.desc("bound"), "range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("bound"), "range"))
        placed = saved(bounds.select("query", "range", "bound", ((above < self.k) & (place <= self.k)).alias("first")))
        first = placed.where("first").select("query", "range")
        best = saved(retrieval.top_k(self.scored(first), self.k))
        floor = best.groupBy("query").agg(F.count("*").alias("found"), F.min("score").alias("floor")).where(F.col("found") >= self.k)
        # scores are compared to six digits, so a range a little below counts too
        rest = placed.where("not first").join(floor, "query", "left").where(F.col("floor").isNull() | (F.col("bound") >= F.col("floor") - 1e-5))
        return first, saved(rest.select("query", "range")), best

    def top(self) -> DataFrame:
        """(query, id, score, rank), ties by id."""
        _, rest, best = self.ranges()
        return retrieval.top_k(best.drop("rank").unionByName(self.scored(rest)), self.k)

    def work(self) -> dict:
        """Blocks of the asked terms by question, those that are scored, and the share of the index's folders that are opened."""
        pairs = self.blocks.select("term", "range").join(self.weights, "term")
        every = pairs.count()
        first, rest, _ = self.ranges()
        kept = pairs.join(first.unionByName(rest), ["query", "range"], "left_semi").count()
        return {"blocks": every, "scored": kept, "folders": self.folders / self.stats["folders"]}


def full_text(spark: SparkSession, path: str, queries: DataFrame, k: int = 15) -> DataFrame:
    """(query, id, rank, fts_rank) of an index built with retrieval.folded_tokens: documents with all terms of a question."""
    found = Search(spark, path, queries, k, 1.2, 0.75, "fts", retrieval.folded_tokens, True).top()
    return found.select("query", "id", "rank", (-F.col("score")).alias("fts_rank"))
