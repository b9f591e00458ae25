"""Small cases of what reviews have found."""

import numpy as np
from pyspark.sql import functions as F

from corpusflow.functions import text
from corpusflow.operators import chunking, inverted, retrieval
from corpusflow.plans import catalog
from corpusflow.sources import html
from corpusflow.sources.scratch import saved

SF = "/root/testdata/sf0.001"


def test_clamp_reads_numbers_as_its_sql_does(spark):
    cases = [("56.", 56), ("1.5", 2), ("2.4", 2), ("-.6", 0), ("1e1", 10), ("9e9", 50), ("1_0", 10), ("10_", 50), ("0xF", 15), ("0b1", 1), (" 5\n", 5), ("5\x00", 50), (".", 50), ("", 50), (None, 50), ("NaN", 50)]
    rows = spark.createDataFrame([(i, t, want) for i, (t, want) in enumerate(cases)], "i int, t string, want int")
    assert rows.select("t", text.clamp(F.col("t"), 0, 100, 50).alias("got"), "want").where("got is distinct from want").collect() == []


def planned(df, name):
    return df._jdf.queryExecution().executedPlan().toString().count(name)


def test_functions_of_python_run_once(spark):
    """A condition on what they give must not have them run twice, in a worker each."""
    pages = spark.createDataFrame([("<p>" + "a b " * 60 + "</p>", 1), (None, 2)], "html string, page_id int")
    text_of = html.page_text(F.col("html"))
    docs = pages.select(*[F.lit(c).alias(c) for c in ("sha256", "filename", "source_url", "source_type", "doc_type")], F.array(F.struct(F.lit(1).alias("page_number"), text_of.alias("text"))).alias("pages"))
    assert planned(chunking.processed(docs), "ArrowEvalPython") == 1
    assert planned(pages.select(text_of), "ArrowEvalPython") == 1
    vectors = pages.select(F.col("page_id").cast("long").alias("id"), retrieval.embedding(F.col("html")).alias("vec"))
    asked = spark.createDataFrame([(1, [1.0] * 64)], "query long, vec array<double>")
    assert planned(retrieval.nearest(vectors, asked, 1, "id", "vec"), "ArrowEvalPython") == 1


def test_nearest_leaves_nulls_out(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (None, [0.0, 0.0]), (3, [0.0, 1.0])], "id long, vec array<double>")
    asked = spark.createDataFrame([(7, [1.0, 0.0]), (8, None)], "query long, vec array<double>")
    assert [(r["query"], r["id"], r["rank"]) for r in retrieval.nearest(rows, asked, 5, "id", "vec").orderBy("rank").collect()] == [(7, 1, 1), (7, 3, 2)]


def test_slices_change_no_result(spark, monkeypatch):
    """Texts are scored and counted in slices of bounded size, whatever an Arrow batch holds."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").coalesce(1)
    asked = spark.read.parquet(f"{SF}/benchmark.parquet").select(F.col("item_id").alias("query"), "text")
    top = lambda every: sorted(map(tuple, retrieval.bm25_top(docs, asked, 5, every=every).select("query", "id", "rank", F.round("score", 9)).collect()))
    vectors = lambda: docs.select("doc_id", retrieval.embedding(F.col("text"))).orderBy("doc_id").collect()
    whole = top(False), top(True), vectors()
    monkeypatch.setattr(retrieval, "WORDS", 1000)
    monkeypatch.setattr(retrieval, "CELLS", 300)
    assert (top(False), top(True), vectors()) == whole


def test_candidates_leave_texts_where_they_are(spark):
    """What is found is small and its size known, so texts are not dealt out to be joined with it."""
    assert planned(catalog.QUERIES["rerank_boost"](spark, SF), "SortMergeJoin") == 0


def test_stored_blocks_move_once(spark, tmp_path, monkeypatch):
    """Postings go to the task of their range whatever the number of questions; the joined form gives the same."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    asked = spark.read.parquet(f"{SF}/benchmark.parquet").select(F.col("item_id").alias("query"), "text").limit(8)
    monkeypatch.setattr(inverted, "RANGE", 16)
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 3)
    inverted.build(docs, str(tmp_path / "i"), "doc_id", "text")
    search = inverted.Search(spark, str(tmp_path / "i"), asked, 5)
    every = saved(search.bounds).select("query", "range")
    scored = search.scored(every)
    assert planned(scored, "FlatMapCoGroupsInArrow") == 1
    top = lambda df: sorted(map(tuple, retrieval.top_k(df, 5).select("query", "id", "rank", F.round("score", 9)).collect()))
    assert top(scored) == top(search.joined(every)) != []


def test_chunks_built_works_texts_out_once(spark):
    """Conditions on cleaned texts and on passages had each worked out again for each use."""
    plan = catalog.QUERIES["chunks_built"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(r"[\s_\-=]{5,}") == 1 and plan.count("(?s)^(.*(?:[.?!] ") == 2  # twice in its own expression
    odd = [" a  b\tc\n", "", " \n\t", "x y z", None, "\x1cq\x0br\x0cs"]
    rows = spark.createDataFrame(list(enumerate(odd)), "i long, t string").select("i", text.word_count(F.col("t")).alias("n"))
    assert [r["n"] for r in rows.orderBy("i").collect()] == [3, 0, 0, 2, 0, 3]


def test_texts_are_split_in_python_as_in_spark(spark):
    """words out of the bytes of many texts are those of tokens(); scoring does not have Spark split texts."""
    import pyarrow as pa

    from corpusflow.functions import lexicon, text
    from corpusflow.operators import retrieval

    rng = np.random.default_rng(1)
    letters = list("abcÀèİßΣσς €𝔘日\t\n\x0b\f\r\x1c\x85  \0" + lexicon.QUOTES + lexicon.PUNCTUATION)
    texts = [None, "", " ", "''", "a", "L'uomo", "x«y»z—w", *("".join(rng.choice(letters, n)) for n in rng.integers(0, 60, 300))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = docs.select("doc_id", text.tokens(F.col("text")).alias("w"), text.lowered(F.col("text")).alias("low")).orderBy("doc_id").collect()
    low = pa.array([r["low"] for r in rows])
    assert text.token_lists(low).to_pylist() == [r["w"] for r in rows]
    assert text.token_lists(low.slice(5, 100)).to_pylist() == [r["w"] for r in rows[5:105]]
    assert text.token_lists(low.slice(0, 0)).to_pylist() == [] and text.token_lists(low.slice(1, 2)).to_pylist() == [[], []]

    asked = spark.createDataFrame([(1, "a b"), (2, "xyzw luomo")], "query long, text string")
    found = retrieval.bm25_top(docs, asked, 5)
    assert (2, 5) in {(r["query"], r["id"]) for r in found.collect()}
    assert "split(" not in found._jdf.queryExecution().optimizedPlan().toString()


def shuffled(spark):
    """Bytes that the session's stages have written for others."""
    context = spark.sparkContext
    context._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    stages = context._jsc.sc().statusStore().stageList(None, False, False, context._gateway.new_array(context._jvm.double, 0), context._jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def test_stored_index_moves_and_keeps_little(spark, tmp_path):
    """postings were moved as rows of text, three times for one build; now as packed places, once, and terms."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    docs.write.parquet(str(tmp_path / "d"))
    size = lambda name: sum(p.stat().st_size for p in (tmp_path / name).rglob("*.parquet"))
    for i, split in enumerate((text.tokens, retrieval.folded_tokens)):
        before = shuffled(spark)
        inverted.build(docs, str(tmp_path / f"i{i}"), "doc_id", "text", split)
        assert shuffled(spark) - before < 3 * size("d")
        assert size(f"i{i}") < size("d")


def test_stored_search_of_many_small_parts(spark, tmp_path, monkeypatch):
    """several folders, tasks and ranges, ids that occur twice: the answers are a scan's, of the joined form too."""
    for name, value in {"RANGE": 4, "TERMS": 16, "POSTINGS": 300, "HELD": 250, "WIDE": 1}.items():
        monkeypatch.setattr(inverted, name, value)
    rng = np.random.default_rng(7)
    words = np.array([f"wört{i}" for i in range(200)])
    texts = [" ".join(rng.choice(words[: rng.choice((3, 30, 200))], rng.integers(0, 40))) for _ in range(600)]
    docs = spark.createDataFrame([(f"d{i % 590}", t) for i, t in enumerate(texts)] + [(None, "wört1 wört2"), ("x", None)], "id string, text string").repartition(3)
    asked = spark.createDataFrame([(f"q{i}", " ".join(rng.choice(words, n))) for i, n in enumerate((1, 2, 2, 3, 5, 8))] + [("few", "wört0 wört1"), ("none", "niente"), ("empty", "")], "query string, text string")
    for split, every in ((text.tokens, False), (retrieval.folded_tokens, True)):
        path = str(tmp_path / f"i{every}")
        assert inverted.build(docs, path, "id", "text", split)["folders"] > 4
        top = lambda df: sorted(map(tuple, df.select("query", "rank", "id", F.round("score", 6)).collect()))
        want = top(retrieval.bm25_top(docs, asked, 5, "id", "text", split=split, every=every))
        assert top(inverted.Search(spark, path, asked, 5, split=split, every=every).top()) == want != []
        assert 0 < inverted.Search(spark, path, asked.where("query = 'few'"), 5, split=split, every=every).work()["folders"] < 1
        with monkeypatch.context() as more:
            more.setattr(retrieval, "ASKED", 1)
            assert top(inverted.Search(spark, path, asked, 5, split=split, every=every).top()) == want
