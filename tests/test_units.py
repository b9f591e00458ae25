"""Small cases of single operators."""

import random
import zipfile

from pyspark.sql import functions as F

from corpusflow.functions import classify, text
from corpusflow.operators import align, chunking, ensemble, evaluate, expansion, graph, plugins
from corpusflow.sources import docx, faq, sinks
from corpusflow.streaming import twins


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_intent(spark):
    cases = [
        ("Come faccio ad accedere?", "procedural"), ("Dove trovo il modulo?", "procedural"), ("Come scaricare la delega?", "procedural"), ("Vorrei sapere come inserire i dati", "procedural"),
        ("Cosa significa BDN?", "acronym_definition"), ("per cosa sta OdC?", "acronym_definition"), ("Cosa si intende per SQNBA?", "acronym_definition"), ("Cosa significa uva?", "generic"),
        ("Cos'è il cruscotto?", "definitional"), ("A cosa serve la checklist?", "definitional"), ("Orari", "generic"),
    ]
    for question, intent in cases:
        assert one(spark, classify.intent(F.lit(question))) == intent


def test_metrics(spark):
    r, e = F.array(*map(F.lit, "abcd")), F.array(*map(F.lit, "bx"))
    assert one(spark, evaluate.recall_at_k(r, e, 2)) == 0.5
    assert one(spark, evaluate.precision_at_k(r, e, 4)) == 0.25
    empty = F.array().cast("array<string>")
    assert one(spark, evaluate.recall_at_k(empty, e, 2)) == 0.0


def test_statistics(spark):
    rows = spark.createDataFrame([("m", x) for x in (0.8, 0.85, 0.9, 0.92, 0.95)], ["metric", "value"])
    got = evaluate.statistics(rows).first()
    assert round(got["mean"], 3) == 0.884 and got["median"] == 0.9 and got["mode"] == 0.8
    rng = random.Random(2)
    values = [rng.choice([round(rng.gauss(0, 1), 2), None, 5.0]) for _ in range(3001)]
    many = spark.createDataFrame([("m", x) for x in values] + [("n", None), ("o", 1.0)], "metric string, value double")
    got = {r["metric"]: r for r in evaluate.statistics(many).collect()}
    import pandas as pd

    short = {str(n): [float(rng.randrange(50)) for _ in range(n)] for n in (2, 3, 4, 7, 10, 1000, 1001)}
    found = {r["metric"]: r for r in evaluate.quartiles(spark.createDataFrame([(k, x) for k, v in short.items() for x in v], "metric string, value double")).collect()}
    for k, v in short.items():
        assert [found[k][c] for c in ("q1", "median", "q3")] == [pd.Series(v).quantile(q) for q in (0.25, 0.5, 0.75)]
    plain = pd.Series([x for x in values if x is not None])
    assert set(got) == {"m", "o"} and got["o"]["q1"] == got["o"]["q3"] == 1.0 and got["o"]["std"] is None
    for name, want in (("q1", plain.quantile(0.25)), ("median", plain.median()), ("q3", plain.quantile(0.75)), ("variance", plain.var()), ("mode", plain.mode()[0])):
        assert abs(got["m"][name] - want) < 1e-9


def plain_split(content, size, overlap, separators=chunking.SEPARATORS):
    """Pieces that begin with their separator, merged as long as they fit: a plain version."""
    at = next((i for i, x in enumerate(separators) if x in content), len(separators) - 1)
    sep, finer = separators[at], separators[at + 1 :]
    first, *rest = content.split(sep)
    pieces = [p for p in [first, *(sep + r for r in rest)] if p]
    out, good = [], []

    def merge():
        window, total = [], 0
        for p in good:
            if window and total + len(p) > size:
                out.append("".join(window))
                while total > overlap or (total > 0 and total + len(p) > size):
                    total -= len(window.pop(0))
            window.append(p)
            total += len(p)
        if window:
            out.append("".join(window))
        good.clear()

    for p in pieces:
        if len(p) < size:
            good.append(p)
        else:
            merge()
            out.extend(plain_split(p, size, overlap, finer) if finer else [p])
    merge()
    return [x.strip() for x in out if x.strip()]


def test_split():
    rng = random.Random(7)
    texts = ["a" * 50 + "\n\n" + "b" * 50 + ". " + "c" * 50, "", " ", "\n\n\n\nx", "x" * 5000, "wort " * 900]
    texts += ["".join(rng.choices(["a", "bb", " ", ", ", ". ", "\n", "\n\n", "lang" * 9], k=rng.randrange(300))) for _ in range(300)]
    for content in texts:
        for size, overlap in ((60, 10), (200, 50), (25, 24)):
            assert list(chunking.recursive_split(content, size, overlap)) == plain_split(content, size, overlap)


def test_split_rows(spark):
    rows = spark.createDataFrame([(1, "x", "uno. due. " * 500), (2, "y", None), (3, "z", "  ")], "id long, idx2 string, text string")
    got = chunking.split_rows(rows, "text", 100, 20).collect()
    assert {r["id"] for r in got} == {1} and [r["idx"] for r in got] == list(range(len(got))) and all(len(r["passage"]) <= 100 for r in got)
    long = "\n".join(["wort " * 100] * 3000)
    assert chunking.chunk_documents(spark.createDataFrame([(1, long)], "id long, text string"), "id", "text").count() == len(plain_split(long, 2000, 300))


def test_trim(spark):
    assert one(spark, text.trim_to_sentence(F.lit("One two three. Four"))) == "One two three."
    assert one(spark, text.missing_times(F.lit("in 3 giorni"), F.lit("3 giorni o 2 ore"))) == ["2 ore"]


def test_crawl(spark):
    link = lambda *to: " ".join(f'<a class="x" href={h}>y</a>' for h in to)
    pages = [
        ("http://s.it/", link('"/b"', "'c/d?x=1&amp;y=2'", '"http://andere.it/x"', '"mailto:a@b.it"', '"/f/a.PDF"', "#top")),
        ("http://s.it/b", link('"../e"', '"/"', '"./g/../h"')),
        ("http://s.it/e", link('"/tief"', "/z.docx")),
        ("http://s.it/c/d?x=1&y=2", link('"//s.it/k"')),
    ]
    got = graph.crawl(spark.createDataFrame([("http://s.it/",)], ["url"]), spark.createDataFrame(pages, ["url", "html"]), 2)
    want = {
        ("http://s.it/", 0, "page"), ("http://s.it/b", 1, "page"), ("http://s.it/c/d?x=1&y=2", 1, "page"), ("http://s.it/f/a.PDF", 1, "file"), ("http://s.it/e", 2, "page"), ("http://s.it/h", 2, "page"),
        ("http://s.it/k", 2, "page"), ("http://s.it/z.docx", 3, "file"),
    }
    assert {tuple(r) for r in got.collect()} == want


def test_versions(spark):
    tags = spark.createDataFrame([("v9_x",), ("v10_y",)], ["tag"])
    assert tags.agg(sinks.next_version(F.col("tag")).alias("v")).first()["v"] == 11


def test_stream(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.repartition(2).write.parquet(str(tmp_path / "in"))
    stream = twins.event_stream(spark, str(tmp_path / "in"), events.schema)
    run = twins.session_counts(stream).writeStream.outputMode("append").format("memory").queryName("sessions").trigger(availableNow=True).start()
    run.awaitTermination(120)
    assert spark.table("sessions").count() > 0


def test_expansion(spark):
    lexicon = [("scaricare", ["salvare", "esportare", "avere"])]
    got = one(spark, expansion.expand(F.lit("Come scaricare?"), F.lit("definitional"), lexicon))
    assert got == ["Come scaricare?", "Come salvare?", "Come esportare?", "definizione di Come scaricare?", "cosa significa Come scaricare?"]
    assert one(spark, expansion.expand(F.lit("Altro"), F.lit("generic"), lexicon)) == ["Altro"]
    meanings = {"ABC": ["primo", "secondo", "terzo"]}
    assert one(spark, expansion.with_acronyms(F.lit("Cosa dice ABC o XY?"), meanings)) == "Cosa dice ABC o XY? primo secondo"
    assert one(spark, expansion.with_acronyms(F.lit("niente"), meanings)) == "niente"


def test_ensemble(spark):
    words = F.array(F.lit("delega"), F.lit("azienda"))
    boost = lambda text: one(spark, ensemble.definition_boost(F.lit(True), words, F.lit(text)))
    assert (boost("Ecco: la delega : atto"), boost("Delega come atto"), boost("altro")) == (1.5, 1.2, 1.0)
    assert one(spark, ensemble.name_boost(words, F.lit("delega_azienda.pdf"))) == 1.45
    assert one(spark, ensemble.length_penalty(F.lit("la delega"), F.lit("x" * 2001))) == 0.5
    assert one(spark, ensemble.allowed(F.lit("come?"), F.lit("checklist"))) is False


def test_faq(spark):
    read = lambda t: [tuple(r) for r in one(spark, faq.pairs(F.lit(t)))]
    assert read("Q: Uno?\nA: Si\ncerto\n\nQ: Due?\nA: No") == [("Uno?", "Si\ncerto"), ("Due?", "No")]
    assert read("DOMANDA: Uno?\nRISPOSTA: Si") == [("Uno?", "Si")]
    assert read("### Uno?\n\nSi\n### Due?\nNo") == [("Uno?", "Si"), ("Due?", "No")]
    assert read("niente") == []
    text = "# T\n## A\n### S\n#### Domanda: Uno?\nSi\ncerto\n\n---\nfuori\n## B\n#### Domanda 2: Due?\nNo"
    got = faq.markdown_faq(spark.createDataFrame([(1, text)], ["id", "text"]), "id", "text").orderBy("question").collect()
    assert [tuple(r)[1:] for r in got] == [("B", None, "Due?", "No"), ("A", "S", "Uno?", "Si\ncerto")]


def test_docx(spark, tmp_path):
    made = [("Heading1", "Guida"), ("", "AREA UNO"), ("", "Come si fa?"), ("", "Prima"), ("", " poi "), ("", "Perché?"), ("", "ALTRA"), ("", "fuori")]
    line = lambda s, t: f'<w:p><w:pPr><w:pStyle w:val="{s}"/><w:tabs><w:tab/></w:tabs></w:pPr><w:r><w:t>{t}</w:t></w:r></w:p>'
    with zipfile.ZipFile(tmp_path / "a.docx", "w") as box:
        box.writestr("word/document.xml", f'<w:document xmlns:w="{docx.W[1:-1]}"><w:body>{"".join(line(*x) for x in made)}</w:body></w:document>')
    (tmp_path / "broken.docx").write_bytes(b"no archive")
    parts = docx.paragraphs(spark, str(tmp_path))
    assert [(r["style"], r["text"]) for r in parts.orderBy("pos").collect()] == made
    assert docx.markdown(parts).first()["markdown"].startswith("## Guida\n\nAREA UNO\n\nCome si fa?")
    assert [tuple(r)[2:] for r in docx.faq_sections(parts).collect()] == [("AREA UNO", "Come si fa?", "Prima poi", "procedural")]


def test_citations(spark):
    rate = lambda c: one(spark, evaluate.citation_accuracy(c, F.array(F.lit(12)), F.array(F.lit("Manuale"), F.lit(None))))
    assert rate(F.array(*map(F.lit, ("pag. 12", "dal manuale", "altro", " ")))) == 2 / 3
    assert rate(F.lit(None).cast("array<string>")) == 1.0
    verdicts = [one(spark, evaluate.chunk_verdict(F.lit(x).cast("string"))) for x in ("UTILE", "PARZIALMENTE_UTILE", "INUTILE", None)]
    assert verdicts == [1.0, 0.5, 0.0, 0.0]


def test_align(spark):
    rng = random.Random(3)
    for _ in range(200):
        a, b = ("".join(rng.choices("abc", k=rng.randrange(12))) for _ in range(2))
        rows = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                rows[i + 1][j + 1] = rows[i][j] + 1 if x == y else max(rows[i][j + 1], rows[i + 1][j])
        assert align.common(a, b) == rows[-1][-1]
    pages = spark.createDataFrame([("d", 1, "uno\ndue"), ("d", 2, "\nBeta  alfa\ngamma"), ("d", 3, None)], ["doc", "page", "text"])
    chunks = spark.createDataFrame([(1, "d", 1, "Alfa beta gamma"), (2, "d", 9, "x"), (3, "d", 2, None)], "id int, doc string, page int, chunk string")
    got = {r["id"]: tuple(r)[1:] for r in align.align(chunks, pages).collect()}
    assert got == {1: (100.0, 2, "beta alfa gamma"), 2: (0.0, 9, ""), 3: (0.0, 1, "")}


def test_generators(spark):
    def shout(prompts):
        if prompts.str.contains("guasto").any():
            raise ValueError("no model")
        return prompts.str.upper()

    got = {t: one(spark, plugins.generate(F.lit(t).cast("string"), shout)) for t in ("abc", "guasto", None)}
    assert got == {"abc": "ABC", "guasto": None, None: None}
    assert one(spark, plugins.variants(F.lit(" a ||| |||b"))) == ["a", "b"]
    assert one(spark, plugins.variants(F.lit(None).cast("string"))) == []
    new = lambda t: one(spark, plugins.rewrite(F.lit(t).cast("string"), F.lit("slide"), shout))
    assert new("breve") == new(None) == ""
    assert new("guasto " * 10) == "guasto " * 10
    assert new("abcde " * 10).startswith("UNISCI I PUNTI")


def test_scored_and_retry(spark):
    def score(question, content):
        return [None if t == "rotto" else float(len(t)) for t in content]

    rows = [(1, 1, 1, "q", "aa"), (1, 2, 2, "q", "aaaa"), (1, 3, 3, "q", "bb"), (2, 4, 1, "q", "rotto"), (2, 5, 2, "q", "aaaaaa")]
    got = plugins.scored(spark.createDataFrame(rows, ["query", "id", "rank", "question", "content"]), score, 2, 2.0)
    assert sorted((r["query"], r["rank"], r["id"], r["score"]) for r in got.collect()) == [(1, 1, 2, 4.0), (1, 2, 1, 2.0), (2, 1, 4, 0.0), (2, 2, 5, 0.0)]

    def run(asked):
        good = asked.where("question like '%bene%'")
        return good.select("id", F.concat(F.lit("ok "), "question").alias("answer"), F.array(F.lit("s")).alias("sources")).unionByName(
            asked.where("question like '%no%'").select("id", F.lit("Mi dispiace").alias("answer"), F.array(F.lit("s")).alias("sources"))
        )

    asked = spark.createDataFrame([(1, "bene"), (2, "x"), (3, "no")], ["id", "question"])
    again = F.when(F.col("id") == 2, "x bene").otherwise(F.col("question"))
    got = {r["id"]: (r["answer"], len(r["path"])) for r in plugins.with_retry(asked, run, again).collect()}
    assert got == {1: ("ok bene", 1), 2: ("ok x bene", 2), 3: ("Mi dispiace", 3)}


def test_streams_like_batch(spark, tmp_path):
    from corpusflow.operators import oplog

    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    fast = events.select("event_id", (F.col("user_id") % 3).alias("user_id"), F.timestamp_micros(F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 7200)).alias("ts"))
    fast.orderBy("ts", "event_id").coalesce(1).write.option("maxRecordsPerFile", 300).parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(fast.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    run = twins.limited(stream, "user_id").writeStream.outputMode("append").format("memory").queryName("limited").trigger(availableNow=True).start()
    run.awaitTermination(120)
    got = {r["event_id"]: r["accepted"] for r in spark.table("limited").collect()}
    want = {r["event_id"]: r["accepted"] for r in oplog.limited(fast, "user_id", "ts").collect()}
    assert len(got) == events.count() and sum(got.values()) > 20
    assert sum(got[i] != want[i] for i in want) <= len(want) * 0.05  # files are not read in the order of time

    audited = fast.select("ts", F.lit("chat").alias("endpoint"), F.lit("success").alias("status"), F.lit(0.1).alias("latency"), F.lit("q").alias("question"), F.lit("m").alias("answer_mode"), F.lit(1).alias("docs_found"), F.lit(True).alias("lexical")).withColumnRenamed("ts", "timestamp")
    audited.write.parquet(str(tmp_path / "a"))
    rows = spark.readStream.schema(audited.schema).parquet(str(tmp_path / "a"))
    twins.audit_writes(rows, str(tmp_path / "log"), str(tmp_path / "cp")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "log")).count() == events.count()


def test_ingest_adds_nothing_twice(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1), ("b", 2), ("a", 1)], "sha256 string, n int")
    rows.write.parquet(str(tmp_path / "in"))
    for _ in range(2):
        stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
        twins.ingest_unseen(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
        assert spark.read.parquet(str(tmp_path / "out")).count() == 2
        rows.limit(1).write.mode("append").parquet(str(tmp_path / "in"))


def test_windows_and_dedup_streams(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.coalesce(1).write.parquet(str(tmp_path / "in"))
    for name, make, mode in (("week", lambda s: twins.windowed_counts(s), "complete"), ("seen", lambda s: twins.dedup_within(s, ["event_id"]), "append")):
        run = make(twins.event_stream(spark, str(tmp_path / "in"), events.schema)).writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
        run.awaitTermination(120)
    total = spark.table("week").groupBy("event_type").agg(F.sum("n").alias("n")).collect()
    counts = {r["event_type"]: r["count"] for r in events.groupBy("event_type").count().collect()}
    assert {r["event_type"]: r["n"] for r in total} == {k: 7 * v for k, v in counts.items()}
    assert spark.table("seen").count() == events.count()


def test_docx_stats(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.docx", "w") as box:
        box.writestr("word/document.xml", f'<w:document xmlns:w="{docx.W[1:-1]}"><w:body><w:p><w:r><w:t>abc</w:t></w:r></w:p><w:tbl/></w:body></w:document>')
    (tmp_path / "b.docx").write_bytes(b"no archive")
    assert sorted((r["path"][-6:], r["text_len"], r["tables"]) for r in docx.stats(spark, str(tmp_path)).collect()) == [("a.docx", 3, 1), ("b.docx", 0, 0)]
