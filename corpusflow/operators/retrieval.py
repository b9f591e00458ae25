"""Lexical, vector and hybrid retrieval; fusion, boosts and reranking."""

from __future__ import annotations

import hashlib
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexicon
from ..functions.text import lowered, normalize, token_lists, tokens

#: Pairs of question and term, and questions of a search by vectors, that go to every task; more are joined.
ASKED, QUERIES = 500_000, 8192
#: Scores held at once, tokens looked at once, bytes of text split at once, vectors compared at once, queries of a block.
CELLS, WORDS, BYTES, BLOCK, QUERY_BLOCK = 1 << 20, 1 << 19, 1 << 21, 4096, 1024
#: Latin letters with marks, and what they are without.
ACCENTED = "".join(chr(c) for c in range(0xC0, 0x250) if len(unicodedata.normalize("NFD", chr(c))) > 1 and unicodedata.normalize("NFD", chr(c))[0].isascii())
PLAIN = "".join(unicodedata.normalize("NFD", c)[0] for c in ACCENTED)


def folded_tokens(text: Column) -> Column:
    """Runs of letters and digits, lower-cased and without accents, as full-text search splits them."""
    return F.filter(F.split(F.translate(F.lower(F.coalesce(text, F.lit(""))), ACCENTED, PLAIN), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def postings(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, dl, term, tf): one row for each distinct term of a document."""
    words = docs.select(F.col(id_col).alias("id"), tokens(F.col(text_col)).alias("w")).withColumn("dl", F.size("w").cast("long"))
    return words.select("id", "dl", F.explode("w").alias("term")).groupBy("id", "dl", "term").agg(F.count("*").alias("tf"))


def term_stats(index: DataFrame) -> DataFrame:
    return index.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


def weighed(df: Column, n: Column, mean: Column, idf: str) -> Column:
    """A term's weight. okapi: ln(N - df + .5) - ln(df + .5), a quarter of the mean over all terms where that is negative;
    fts: the same, 1e-6 at least; plus: ln(1 + (N - df + .5) / (df + .5))."""
    raw = F.ln(n - df + 0.5) - F.ln(df + 0.5)
    if idf == "okapi":
        return F.when(raw < 0, 0.25 * mean).otherwise(raw)
    return F.greatest(raw, F.lit(1e-6)) if idf == "fts" else F.ln(1 + (n - df + 0.5) / (df + 0.5))


def bm25_top(
    docs: DataFrame,
    queries: DataFrame,
    k: int,
    id_col: str = "doc_id",
    text_col: str = "text",
    k1: float = 1.5,
    b: float = 0.75,
    idf: str = "okapi",
    split: Callable[[Column], Column] = tokens,
    every: bool = False,
) -> DataFrame:
    """(query, id, score, rank): the k best documents of each of queries (query, text), ties by id.

    A score sums over the question's tokens, repeats included, idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / avgdl)).
    every: only documents that hold all of a question's terms count. Documents that score nothing are no results.

    One pass counts document frequencies, one scores: a document's tokens are all in its row, so scores are complete in the task,
    and each batch only gives its k best for each question to the shuffle. The questions' terms go to every task if they
    are at most ASKED pairs; more are joined with the postings instead.

    Null texts are empty. An empty table gives none.
    """
    asked = queries.select("query", F.explode(split(F.col("text"))).alias("term")).groupBy("query", "term").agg(F.count("*").alias("times"))
    # texts go to Python as they are: the functions of Spark that split them take longer than all the rest
    words = docs.select(F.col(id_col).alias("id"), (lowered if split is tokens else split)(F.col(text_col)).alias("w"))

    stats = frequencies(words)
    total = stats.where("term is null").agg(F.coalesce(F.max("df"), F.lit(0)).alias("n"), F.coalesce(F.max("dl") / F.nullif(F.max("df"), F.lit(0)), F.lit(1.0)).alias("avgdl"))
    pairs = asked.limit(ASKED + 1).count()
    if pairs > ASKED:
        n, avgdl = total.first()
        mean = stats.where("term is not null").agg(F.avg(F.ln(n - F.col("df") + 0.5) - F.ln(F.col("df") + 0.5))).first()[0] or 0.0
        scored = bm25_joined(postings_of(docs.select(F.col(id_col).alias("id"), split(F.col(text_col)).alias("w"))), asked, stats.where("term is not null"), n, avgdl or 1.0, mean, k1, b, idf, every)
        return top_k(scored, k)

    names = asked.toPandas()  # at most ASKED rows
    wanted = F.broadcast(asked.select("term").distinct().withColumn("asked", F.lit(True)))
    # one job: the asked terms' frequencies, and sums over all terms by frequency, of which there are few
    counted = stats.join(wanted, "term", "left").groupBy("df", F.when(F.col("asked"), F.col("term")).alias("word"), F.col("term").isNull().alias("all")).agg(F.count("*").alias("terms"), F.max("dl").alias("dl")).toPandas()
    own = counted[counted["all"].astype(bool)]
    n = int(own["df"].iloc[0]) if len(own) else 0
    avgdl = float(own["dl"].iloc[0]) / n if n and own["dl"].iloc[0] else 1.0
    vocabulary = counted[~counted["all"].astype(bool)]
    raw = np.log(n - vocabulary["df"].to_numpy(float) + 0.5) - np.log(vocabulary["df"].to_numpy(float) + 0.5)
    mean = float(np.average(raw, weights=vocabulary["terms"])) if len(raw) else 0.0
    known = vocabulary["word"].notna().to_numpy()
    df = dict(zip(vocabulary["word"][known], vocabulary["df"][known], strict=True))

    terms = sorted(set(names["term"]))
    at = {t: i for i, t in enumerate(terms)}
    freq = np.array([df.get(t, 0) for t in terms], float)
    weight = np.log(n - freq + 0.5) - np.log(freq + 0.5) if idf != "plus" else np.log(1 + (n - freq + 0.5) / (freq + 0.5))
    weight = np.where(weight < 0, 0.25 * mean, weight) if idf == "okapi" else np.maximum(weight, 1e-6) if idf == "fts" else weight
    ids, column = np.unique(names["query"].to_numpy(), return_inverse=True)
    # the questions of each term, one after another
    row = names["term"].map(at).to_numpy(np.int64)
    by = np.argsort(row, kind="stable")
    ask = column[by], names["times"].to_numpy(np.float64)[by]
    starts = np.concatenate(([0], np.cumsum(np.bincount(row, minlength=len(terms))))) if len(row) else np.zeros(1, np.int64)
    known_terms = pa.array(terms, pa.string())
    needed = np.bincount(column, minlength=len(ids))
    step = max(1, CELLS // max(1, len(ids)))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # the k-th best score of each question so far in this task: what is below it can't be among the k best
        floor = np.full(len(ids), -np.inf)
        for batch in batches:
            if not batch.num_rows or not len(ids):
                continue
            for at_row, lists in words_in(batch.column("w")):
                sizes = np.asarray(pc.fill_null(lists.value_lengths(), 0))
                coded = lists.flatten().dictionary_encode()
                code = np.asarray(pc.fill_null(pc.index_in(coded.dictionary.cast(pa.string()), value_set=known_terms), -1)).astype(np.int64)
                term = code[np.asarray(coded.indices)] if len(code) else np.zeros(0, np.int64)
                doc = np.repeat(np.arange(len(lists)), sizes)
                cell, tf = np.unique(doc[term >= 0] * len(terms) + term[term >= 0], return_counts=True)
                doc, term = cell // len(terms), cell % len(terms)
                gain = weight[term] * tf * (k1 + 1) / (tf + k1 * (1 - b + b * sizes[doc] / avgdl))
                names_here = np.asarray(batch.column("id").slice(at_row, len(lists)))
                spread = starts[term + 1] - starts[term]
                most = np.cumsum(np.bincount(doc, spread, len(lists)))
                begin = 0
                while begin < len(lists):
                    # so many rows as give CELLS scores, out of CELLS summands, one at least
                    stop = min(begin + step, max(begin + 1, int(np.searchsorted(most, (most[begin - 1] if begin else 0) + CELLS, side="right"))), len(lists))
                    i, j = np.searchsorted(doc, (begin, stop))
                    own = spread[i:j]
                    place = np.repeat(starts[term[i:j]] - (np.cumsum(own) - own), own) + np.arange(own.sum())
                    cells = np.repeat(doc[i:j] - begin, own) * len(ids) + ask[0][place]
                    size = (stop - begin) * len(ids)
                    found = np.bincount(cells, np.repeat(gain[i:j], own) * ask[1][place], size).reshape(-1, len(ids))
                    held = np.bincount(cells, minlength=size).reshape(-1, len(ids))
                    ok = held == needed if every else held > 0
                    ranked = np.where(ok, np.round(found, 6), -np.inf)
                    if len(ranked) > k:
                        floor = np.maximum(floor, np.partition(ranked, len(ranked) - k, axis=0)[len(ranked) - k])
                    d, q = np.nonzero(ok & (ranked >= floor))
                    if len(d):
                        yield pa.RecordBatch.from_arrays([pa.array(ids[q]), pa.array(names_here[begin + d]), pa.array(found[d, q])], names=["query", "id", "score"])
                    begin = stop

    kind = docs.schema[id_col].dataType.simpleString(), queries.schema["query"].dataType.simpleString()
    scored = words.where("id is not null").mapInArrow(score, f"query {kind[1]}, id {kind[0]}, score double")
    return top_k(scored, k)


def frequencies(words: DataFrame) -> DataFrame:
    """(term, df, dl): how many documents hold each term; without a term how many there are, and their tokens. words has texts in lower case or lists of tokens as w."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, lists in words_in(batch.column("w")):
                sizes = np.asarray(pc.fill_null(lists.value_lengths(), 0))
                coded = lists.flatten().dictionary_encode()
                many = max(1, len(coded.dictionary))
                held = np.unique(np.repeat(np.arange(len(lists)), sizes) * many + np.asarray(coded.indices)) % many
                df = np.append(np.bincount(held, minlength=many)[: len(coded.dictionary)], len(lists) - lists.null_count)
                dl = np.append(np.zeros(len(coded.dictionary), np.int64), sizes.sum(dtype=np.int64))
                yield pa.RecordBatch.from_arrays([pa.concat_arrays([coded.dictionary, pa.nulls(1, coded.dictionary.type)]).cast(pa.string()), pa.array(df), pa.array(dl)], names=["term", "df", "dl"])

    return words.select("w").mapInArrow(count, "term string, df long, dl long").groupBy("term").agg(F.sum("df").alias("df"), F.sum("dl").alias("dl"))


def postings_of(words: DataFrame) -> DataFrame:
    return words.select("id", F.size("w").alias("dl"), F.explode("w").alias("term")).groupBy("id", "dl", "term").agg(F.count("*").alias("tf"))


def bm25_joined(index: DataFrame, asked: DataFrame, stats: DataFrame, n: int, avgdl: float, mean: float, k1: float, b: float, idf: str, every: bool) -> DataFrame:
    """(query, id, score) by a join of postings with asked (query, term, times), for any number of questions."""
    weight = asked.join(stats.select("term", "df"), "term").withColumn("idf", weighed(F.col("df"), F.lit(float(n)), F.lit(mean), idf) * F.col("times"))
    gain = F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / avgdl))
    out = index.join(weight, "term").groupBy("query", "id").agg(F.sum(F.col("idf") * gain).alias("score"), F.count("*").alias("held"))
    if every:
        out = out.join(asked.groupBy("query").agg(F.count("*").alias("needed")), "query").where("held = needed")
    return out.select("query", "id", "score")


def full_text(docs: DataFrame, queries: DataFrame, k: int = 15, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(query, id, rank, fts_rank): documents that hold all terms of a question; fts_rank is negative, the least is the best."""
    found = bm25_top(docs, queries, k, id_col, text_col, 1.2, 0.75, "fts", folded_tokens, True)
    return found.select("query", "id", "rank", (-F.col("score")).alias("fts_rank"))


def top_k(scored: DataFrame, k: int, by: str = "query", score: str = "score", tie: str = "id") -> DataFrame:
    order = Window.partitionBy(by).orderBy(F.desc(F.round(score, 6)), tie)
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def digest(word: bytes) -> int:
    """The first two bytes of a word's digest."""
    return int.from_bytes(hashlib.md5(word).digest()[:2], "big")


def embedding(text: Column, dims: int = 64) -> Column:
    """A stand-in for a model's vector: the counts of a text's words by a digest, of length 1; zeros without words."""
    return embedded(lowered(text), dims)


def embedded(tokens_or_text: Column, dims: int = 64) -> Column:
    """The vector of a text that is given as its tokens, or in lower case. A word is a Python object once for each slice of WORDS tokens or BYTES bytes."""

    @F.arrow_udf("array<double>")
    def count(lists: pa.Array) -> pa.Array:
        out, known = [], lru_cache(1 << 17)(digest)  # common words' digests are worked out once
        for _, part in words_in(lists):
            coded = part.flatten().dictionary_encode()
            words = coded.dictionary.cast(pa.string()).cast(pa.binary()).to_pylist()
            place = np.fromiter(map(known, words), np.int64, len(words)) % dims
            row = np.repeat(np.arange(len(part)), np.asarray(pc.fill_null(part.value_lengths(), 0)))
            v = np.bincount(row * dims + place[np.asarray(coded.indices)], minlength=len(part) * dims).reshape(-1, dims).astype(np.float64)
            size = np.sqrt((v * v).sum(1, keepdims=True))
            out.append((v / np.where(size > 0, size, 1)).ravel())
        flat = np.concatenate(out) if out else np.zeros(0)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(lists) + 1) * dims, pa.int32()), pa.array(flat))

    return count(tokens_or_text)


def words_in(column: pa.Array) -> Iterator[tuple[int, pa.Array]]:
    """Slices of a column of lists of words, or of texts in lower case as lists of their tokens, each with where it begins."""
    if pa.types.is_list(column.type) or pa.types.is_large_list(column.type):
        yield from sliced(column, WORDS)
    else:
        for begin, part in sliced(column, BYTES):
            yield begin, token_lists(part)


def sliced(lists: pa.Array, most: int) -> Iterator[tuple[int, pa.Array]]:
    """Slices of an array of lists (texts) that hold about `most` values (bytes), one list at least, each with where it begins."""
    sizes = pc.binary_length(lists) if pa.types.is_string(lists.type) or pa.types.is_large_string(lists.type) else lists.value_lengths()
    ends = np.cumsum(np.asarray(pc.fill_null(sizes, 0)), dtype=np.int64)
    begin = 0
    while begin < len(lists):
        before = ends[begin - 1] if begin else 0
        stop = max(begin + 1, int(np.searchsorted(ends, before + most, side="right")))
        yield begin, lists.slice(begin, stop - begin)
        begin = stop


def nearest(vectors: DataFrame, queries: DataFrame, k: int, id_col: str, vec_col: str) -> DataFrame:
    """(query, id, distance, rank): exact squared L2 neighbours of queries (query, vec), ties by id.

    Blocks of queries meet blocks of vectors in one matrix product, which gives its k best for each, so the shuffle carries k rows for
    each query and block. Up to QUERIES queries go to every task; more are packed in blocks and joined with each block of
    vectors. Null vectors, and those of another length than a query, are no neighbours of it.
    """
    some = queries.where(F.col("vec").isNotNull()).select(F.col("query").cast("long").alias("query"), F.col("vec").cast("array<double>").alias("vec"))
    # nulls are left out in the tasks: a condition on vectors that a function of Python makes would have it run twice
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("vec"))

    def best(names: np.ndarray, q: np.ndarray, ids: np.ndarray, v: np.ndarray) -> pa.RecordBatch | None:
        if not len(ids) or not len(names) or q.shape[1] != v.shape[1]:
            return None
        rough = (q * q).sum(1)[:, None] - 2 * q @ v.T + (v * v).sum(1)[None, :]
        near = min(k + 8, len(ids))
        cut = np.partition(rough, near - 1, axis=1)[:, near - 1]
        a, b = np.nonzero(rough <= cut[:, None] + 1e-9)
        exact = ((q[a] - v[b]) ** 2).sum(1)
        # the k best and what ties with the last of them
        order = np.lexsort((ids[b], np.round(exact, 6), a))
        place = np.arange(len(a)) - np.searchsorted(a[order], a[order])
        keep = order[place < k]
        return pa.RecordBatch.from_arrays([pa.array(names[a[keep]]), pa.array(ids[b[keep]]), pa.array(exact[keep])], names=["query", "id", "distance"])

    def matrices(ids: pa.Array, lists: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Ids and vectors, those of one length together, without nulls."""
        known = pc.and_(ids.is_valid(), lists.is_valid())
        ids, lists = ids.filter(known), lists.filter(known)
        sizes = np.asarray(lists.value_lengths())
        names = np.asarray(ids)
        for size in np.unique(sizes):
            at = np.flatnonzero(sizes == size)
            flat = np.asarray(lists.take(pa.array(at)).flatten()).astype(np.float64)
            yield names[at], flat.reshape(len(at), size)

    kind = "query long, id long, distance double"
    asked = some.limit(QUERIES + 1).toArrow() if some.limit(QUERIES + 1).count() <= QUERIES else None
    if asked is not None:
        held = list(matrices(asked["query"].combine_chunks(), asked["vec"].combine_chunks())) if asked.num_rows else []

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(0, batch.num_rows, BLOCK):
                    part = batch.slice(i, BLOCK)
                    for ids, v in matrices(part.column("id"), part.column("vec")):
                        for names, q in held:
                            for j in range(0, len(names), QUERY_BLOCK):
                                out = best(names[j : j + QUERY_BLOCK], q[j : j + QUERY_BLOCK], ids, v)
                                if out is not None and out.num_rows:
                                    yield out

        found = rows.mapInArrow(scan, kind)
    else:

        def pack(name: str) -> Callable:
            def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    for i in range(0, batch.num_rows, QUERY_BLOCK):
                        part = batch.slice(i, QUERY_BLOCK)
                        for ids, v in matrices(part.column(name), part.column("vec")):
                            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in ((ids.tobytes(), pa.binary()), (v.tobytes(), pa.binary()), (v.shape[1], pa.int32()))], names=["ids", "vecs", "dims"])

            return work

        def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    q_ids, ids = (np.frombuffer(batch.column(c)[i].as_buffer(), np.int64) for c in ("q_ids", "ids"))
                    q, v = (np.frombuffer(batch.column(c)[i].as_buffer()).reshape(len(x), -1) for c, x in (("q_vecs", q_ids), ("vecs", ids)))
                    out = best(q_ids, q, ids, v)
                    if out is not None:
                        yield out

        packed = "ids binary, vecs binary, dims int"
        blocks = some.mapInArrow(pack("query"), packed).withColumn("at", F.pmod(F.xxhash64("ids"), F.lit(QUERIES)))
        numbers = blocks.select("at").distinct()
        blocks = blocks.select("at", F.col("ids").alias("q_ids"), F.col("vecs").alias("q_vecs"), F.col("dims").alias("q_dims"))
        every = numbers.agg(F.collect_list("at").alias("every"))  # at most QUERIES numbers
        dealt = rows.mapInArrow(pack("id"), packed).join(F.broadcast(every)).select("ids", "vecs", "dims", F.explode("every").alias("at"))
        found = dealt.join(blocks, "at").where("dims = q_dims").mapInArrow(meet, kind)
    return top_near(found, k)


def top_near(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query").orderBy(F.round("distance", 6), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def fuse(lists: list[tuple[DataFrame, Column]]) -> DataFrame:
    """Sums by (query, id) the scores that each list gives its ranks."""
    parts = [df.select("query", "id", score.alias("score")) for df, score in lists]
    return reduce(DataFrame.unionByName, parts).groupBy("query", "id").agg(F.sum("score").alias("score"))


def concept_boost(question: Column, concepts: Column) -> Column:
    """1.10 if the question names two of the concepts, 1.05 for one."""
    q = normalize(question)
    met = F.size(F.filter(F.coalesce(concepts, F.array().cast("array<string>")), lambda c: (normalize(c) != "") & F.contains(q, normalize(c))))
    return F.when(met >= 2, 1.10).when(met == 1, 1.05).otherwise(1.0)


def rerank(score: Column, role: Column, words: Column, boost: Column | None = None) -> Column:
    """Procedural passages and those on the question's concepts gain, long descriptive ones lose."""
    out = score * F.when(role.isin(lexicon.PROCEDURAL_ROLES), 1.30).otherwise(1.0)
    out = out if boost is None else out * boost
    return out * F.when((words > 700) & (role == "descriptive"), 0.90).otherwise(1.0)


def hybrid(vector: DataFrame, lexical: DataFrame, passages: DataFrame, questions: DataFrame, k: Column) -> DataFrame:
    """(query, id, score, rank): the candidates of both lists (query, id, rank; vector with distance), their scores 1 / (1 + d) and
    0.6 / rank summed, reranked by role, concepts and length of passages (id, role, words, concepts), the k best.

    k is an expression over questions (query, question), of at most 40."""
    fused = fuse([(vector, 1 / (1 + F.col("distance"))), (lexical, 0.6 / F.col("rank"))])
    both = fused.join(passages.select("id", "role", "words", "concepts"), "id").join(questions.select("query", "question", k.alias("_k")), "query")
    scored = both.select("query", "id", "_k", rerank(F.col("score"), F.col("role"), F.col("words"), concept_boost(F.col("question"), F.col("concepts"))).alias("score"))
    return top_k(scored, 40).where(F.col("rank") <= F.col("_k")).drop("_k")


def category_boost(category: Column, factors: list[tuple[str, float]] = lexicon.CATEGORY_BOOST) -> Column:
    out = reduce(lambda chain, x: chain.when(category == x[0], x[1]), factors, F.when(F.lit(False), F.lit(1.0)))
    return out.otherwise(1.0)


def boosted(scored: DataFrame, boosts: dict[str, DataFrame], k: int) -> DataFrame:
    """scored (query, id, score and metadata columns) with scores times the factor of each column's value, 1 where boosts
    (value, factor) don't name it, the k best by the new score. Boosts are joined, so they may be of any size."""
    out = scored.drop("rank") if "rank" in scored.columns else scored
    for column, factors in boosts.items():
        out = out.join(factors.select(F.col("value").alias(column), F.col("factor").alias("_f")), column, "left").withColumn("score", F.col("score") * F.coalesce("_f", F.lit(1.0))).drop("_f")
    return top_k(out, k)


def gated(scored: DataFrame, category: str, strong: float = 0.5, least: float = 0.3) -> DataFrame:
    """scored (query, id, score, category): where the best row of the category scores over `strong`, only its rows over `least` stay."""
    own = F.when(F.col("category") == category, F.col("score"))
    best = F.max(own).over(Window.partitionBy("query"))
    return scored.withColumn("_best", best).where(F.coalesce(F.col("_best") <= strong, F.lit(True)) | F.coalesce(own > least, F.lit(False))).drop("_best")


def united(lists: list[DataFrame], text_col: str = "content") -> DataFrame:
    """The candidates (query, id, rank, content) of several searches in order of the lists, then ranks: of those with one beginning of 500 letters the first, with a new rank."""
    rows = reduce(DataFrame.unionByName, [x.withColumn("_list", F.lit(i)) for i, x in enumerate(lists)])
    same = Window.partitionBy("query", F.md5(F.substring(text_col, 1, 500))).orderBy("_list", "rank", "id")
    kept = rows.withColumn("_n", F.row_number().over(same)).where("_n = 1")
    order = Window.partitionBy("query").orderBy("_list", F.col("rank"), "id")
    return kept.withColumn("_new", F.row_number().over(order)).drop("_n", "_list", "rank").withColumnRenamed("_new", "rank")


def sharing_concepts(found: DataFrame) -> DataFrame:
    """found (query, id, concepts, asked): rows that share a concept with the question, all rows where none does."""
    share = F.arrays_overlap(F.coalesce("concepts", F.array().cast("array<string>")), F.coalesce("asked", F.array().cast("array<string>")))
    marked = found.withColumn("_share", share).withColumn("_any", F.max("_share").over(Window.partitionBy("query")))
    return marked.where("_share or not _any").drop("_share", "_any")


def dedup_prefix(docs: DataFrame, key: Column, order: list) -> DataFrame:
    """Keeps the first row of each key."""
    return docs.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_n = 1").drop("_n")
