"""Words of a table found in texts by an automaton, all in one scan of each text."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words, and letters of words, of one automaton: the bound of what goes to every task. More are dealt over several, one scan each.
WORDS, LETTERS = 500_000, 8 << 20


def shards(lexicon: DataFrame, word: str) -> list[list[str]]:
    """The distinct words, at most WORDS of LETTERS letters in a shard; empty and null ones are left out."""
    rows = lexicon.select(F.col(word).alias("w")).where("w is not null and w <> ''").distinct()
    n, letters = rows.agg(F.count("*"), F.coalesce(F.sum(F.length("w")), F.lit(0))).first()
    k = max(-(-n // (WORDS // 2)), -(-letters // (LETTERS // 2)), 1)
    if k == 1:
        return [[r["w"] for r in rows.collect()]] if n else []
    return [[r["w"] for r in rows.where(F.pmod(F.xxhash64("w"), F.lit(k)) == i).collect()] for i in range(k)]


def places(texts: DataFrame, lexicon: DataFrame, id_col: str, text: Column, word: str) -> DataFrame:
    """(id, word, place): every place, from 1, at which a word of the lexicon stands in a text, inside longer words and over other words too.

    Texts and words are compared as they come: normalise both alike. The lexicon is made into automata of a bounded size, which every task gets; each text is
    scanned once for each, in time of its length and its hits, however many words there are. Null texts hold nothing; rows with equal ids are
    each told.
    """
    spark = texts.sparkSession
    kind = texts.schema[id_col].dataType.simpleString()
    rows = texts.select(F.col(id_col).alias("id"), text.alias("text")).where("text is not null and id is not null")
    out = None
    for words in shards(lexicon, word):
        shared = spark.sparkContext.broadcast(words)

        def work(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            automaton = ahocorasick.Automaton()
            for w in shared.value:
                automaton.add_word(w, w)
            automaton.make_automaton()
            for batch in batches:
                ids, found, at = [], [], []
                for i, t in enumerate(batch.column("text").to_pylist()):
                    for end, w in automaton.iter(t):
                        ids.append(i)
                        found.append(w)
                        at.append(end - len(w) + 2)
                    if len(ids) > 100_000:
                        yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(ids, pa.int64())), pa.array(found, pa.string()), pa.array(at, pa.int64())], names=["id", "word", "place"])
                        ids, found, at = [], [], []
                yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(ids, pa.int64())), pa.array(found, pa.string()), pa.array(at, pa.int64())], names=["id", "word", "place"])

        part = rows.mapInArrow(work, f"id {kind}, word string, place long")
        out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame([], f"id {kind}, word string, place long")
