"""What is written and goes on: chains, indices, caches, carried values."""

import random
from collections import OrderedDict

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusflow.operators import carry, cells, inverted, lexicons, oplog, plugins, retrieval
from corpusflow.plans import answers, catalog, modes  # noqa: F401 (the catalog comes first)
from corpusflow.sources import buckets, chain, sheets
from corpusflow.sources.scratch import saved

SF = "/root/testdata/sf0.001"


def fields():
    return {n: F.col(n) for n in ("endpoint", "user")}


def events(spark, rows):
    return spark.createDataFrame(rows, "k string, o long, endpoint string, user string")


# --- Chains
def test_chain_goes_on_over_appends(spark, tmp_path):
    """Three appends, one tried again, are the chain of all entries at once; every entry verifies; a spoiled one doesn't."""
    root = str(tmp_path / "log")
    rows = [(f"k{i % 3}", i, f"e{i % 4}", None if i % 5 == 0 else "ü\"") for i in range(30)] + [(None, 99, "x", "y")]
    for batch, some in enumerate((rows[:7], rows[7:20], rows[20:])):
        assert chain.append(events(spark, some), "k", "o", fields(), root, batch)
        assert not chain.append(events(spark, some), "k", "o", fields(), root, batch)
    assert not chain.append(events(spark, []), "k", "o", fields(), root)
    whole = {(r["k"], r["o"]): (r["n"], r["audit_hash"]) for r in oplog.hash_chain(events(spark, rows), "k", "o", fields()).collect()}
    got = {(r["k"], r["o"]): (r["n"], r["audit_hash"]) for r in chain.entries(spark, root).collect()}
    assert got == whole and len(got) == 30
    seen = chain.verified(spark, root, "k", fields()).collect()
    assert all(r["ok"] for r in seen) and len(seen) == 30
    spoiled = chain.entries(spark, root).withColumn("user", F.when(F.col("o") == 9, "z").otherwise(F.col("user")))
    assert [r["o"] for r in oplog.verify_chain(spoiled, "k", "n", fields()).where("not ok").collect()] == [9]


def test_chain_of_writers_that_meet(spark, tmp_path, monkeypatch):
    """A writer whose number was taken meanwhile chains again from the new heads; what it wrote before is not read."""
    root = str(tmp_path / "log")
    chain.append(events(spark, [("a", 1, "x", "u")]), "k", "o", fields(), root)
    commit, met = chain._commit, []

    def late(spark_, root_, number, said):
        if not met:
            met.append(number)
            chain.append(events(spark, [("a", 2, "y", "u")]), "k", "o", fields(), root)
        return commit(spark_, root_, number, said)

    monkeypatch.setattr(chain, "_commit", late)
    monkeypatch.setattr(chain, "COMPACT", 2)
    assert chain.append(events(spark, [("a", 3, "z", "u"), ("b", 1, "z", "u")]), "k", "o", fields(), root)
    assert sorted((r["k"], r["n"], r["o"]) for r in chain.entries(spark, root).collect()) == [("a", 1, 1), ("a", 2, 2), ("a", 3, 3), ("b", 1, 1)]
    assert all(r["ok"] for r in chain.verified(spark, root, "k", fields()).collect())


def test_chain_streams(spark, tmp_path):
    """Both streaming forms give the chain of all entries; a new start on the checkpoint adds only what is new."""
    source, schema = str(tmp_path / "in"), "k string, o long, endpoint string, user string"
    rows = [(f"k{i % 2}", i, "e", "u") for i in range(12)]
    for part in (rows[:5], rows[5:]):
        events(spark, part).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        chain.append_stream(stream, "k", "o", fields(), str(tmp_path / "log"), str(tmp_path / "c1")).awaitTermination()
        out = chain.chained_stream(spark.readStream.schema(schema).parquet(source), "k", "o", fields())
        out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start().awaitTermination()
    want = {(r["k"], r["o"]): (r["n"], r["audit_hash"]) for r in oplog.hash_chain(events(spark, rows), "k", "o", fields()).collect()}
    assert {(r["k"], r["o"]): (r["n"], r["audit_hash"]) for r in chain.entries(spark, str(tmp_path / "log")).collect()} == want
    assert {(r["k"], r["o"]): (r["n"], r["audit_hash"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()} == want


# --- Indices
@pytest.mark.parametrize(("idf", "every"), [("okapi", False), ("plus", False), ("fts", True)])
def test_stored_search_is_that_of_all_documents(spark, tmp_path, monkeypatch, idf, every):
    """Many small ranges: the same answers as a scan of all documents, from a part of the blocks."""
    monkeypatch.setattr(inverted, "RANGE", 8)
    monkeypatch.setattr(inverted, "TERMS", 16)
    rng = random.Random(4)
    words = [f"parola{i}" for i in range(300)]
    texts = [" ".join(rng.choice(words[: rng.choice((3, 30, 300))]) for _ in range(rng.randint(1, 60))) for _ in range(600)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(700, None), (701, ""), (None, "parola1 parola2")], "id long, text string")
    asked = spark.createDataFrame([(i, " ".join(rng.choice(words) for _ in range(n))) for i, n in enumerate((1, 2, 3, 5, 2, 8))] + [(6, "nessuna"), (7, ""), (8, "parola299 parola299 parola0")], "query long, text string")
    path = str(tmp_path / "i")
    inverted.build(docs, path, "id", "text")
    search = inverted.Search(spark, path, asked, 5, idf=idf, every=every)
    got = sorted((r["query"], r["rank"], r["id"], round(r["score"], 6)) for r in search.top().collect())
    want = sorted((r["query"], r["rank"], r["id"], round(r["score"], 6)) for r in retrieval.bm25_top(docs, asked, 5, "id", "text", idf=idf, every=every).collect())
    assert got == want and want
    work = search.work()
    assert work["scored"] < work["blocks"] and 0 < work["folders"] <= 1


def test_stored_search_of_nothing(spark, tmp_path):
    path = str(tmp_path / "i")
    inverted.build(spark.createDataFrame([], "id string, text string"), path, "id", "text")
    assert inverted.Search(spark, path, spark.createDataFrame([(1, "a")], "query long, text string"), 5).top().count() == 0


def test_stored_vectors_are_those_of_all(spark, tmp_path, monkeypatch):
    """Tight groups, ties, odd vectors; two shards merged; a part of the vectors is compared."""
    monkeypatch.setattr(cells, "BLOCK", 32)
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(20, 8)) * 10
    v = np.concatenate([c + rng.normal(size=(40, 8)) * 0.3 for c in centres] + [np.tile(centres[0], (200, 1))])
    rows = [(i, x.tolist()) for i, x in enumerate(v)]
    odd = [(2000, None), (2001, [1.0]), (None, v[0].tolist()), (2002, [float("nan")] * 8), (2003, [None] * 8)]
    d = spark.createDataFrame(rows + odd, "id long, vec array<double>")
    asked = spark.createDataFrame([(i, (v[i * 7] + 0.01).tolist()) for i in range(40)] + [(90, None), (91, [1.0])], "query long, vec array<double>")
    paths = [str(tmp_path / x) for x in "ab"]
    for i, path in enumerate(paths):
        cells.build(d.where(F.col("id").isNull() | (F.col("id") % 2 == i)), path, "id", "vec", 8)
    cells.merge(spark, paths, str(tmp_path / "c"))
    search = cells.Search(spark, str(tmp_path / "c"), asked, 7)
    got = sorted((r["query"], r["rank"], r["id"], round(r["distance"], 6)) for r in search.top().collect())
    fine = spark.createDataFrame(rows, "id long, vec array<double>")
    assert got == sorted((r["query"], r["rank"], r["id"], round(r["distance"], 6)) for r in retrieval.nearest(fine, asked.where("query < 90"), 7, "id", "vec").collect())
    assert search.share() < 0.6
    cells.build(d.limit(0), str(tmp_path / "e"), "id", "vec", 8)
    assert cells.Search(spark, str(tmp_path / "e"), asked, 7).top().count() == 0


# --- Caches and carried values
def test_bounded_cache_like_plain(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice((None, "a", "b")), rng.choice((None, *range(9))), 1000 * i + rng.choice((0, 0, 40))) for i in range(600)]
    d = spark.createDataFrame(rows, "event_id long, c string, k long, s long").withColumn("ts", F.timestamp_seconds("s"))
    got = {r["event_id"]: r["hit"] for r in oplog.cached(d, "c", "k", "ts", 4, 20_000).collect()}
    want, caches = {}, {}
    for i, c, k, s in sorted(rows, key=lambda r: (r[3], r[0])):
        if c is None or k is None:
            continue
        held = caches.setdefault(c, OrderedDict())
        for x in [x for x, since in held.items() if s - since >= 20_000]:
            del held[x]
        want[i] = k in held
        if k in held:
            held.move_to_end(k)
        else:
            if len(held) == 4:
                held.popitem(last=False)
            held[k] = s
    assert got == want and 0 < sum(want.values()) < len(want)


def test_carried_over_ranges(spark):
    """A key over many ranges, a null key, keys without a value, equal times."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    rng = random.Random(2)
    rows = [(i, rng.choice(("a", "a", "a", "b", None)), i // 2, i if rng.random() < 0.02 else None) for i in range(800)] + [(900, "c", 1, None)]
    try:
        d = spark.createDataFrame(rows, "i long, k string, t long, v long").repartition(16)
        got = {r["i"]: r["last"] for r in carry.carried(d, "k", [F.col("t"), F.col("i")], "v", "last").collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    last, want = {}, {}
    for i, k, _, v in sorted(rows, key=lambda r: (r[2], r[0])):
        last[k] = v if v is not None else last.get(k)
        want[i] = last[k]
    assert got == want


# --- Tables in buckets, spreadsheets, lexicons
def test_buckets_rewrite_what_changes(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "t")
    make = lambda *rows: spark.createDataFrame(rows, "k string, v long")
    first = make(*[(f"k{i}", i) for i in range(50)], (None, -1))
    assert len(buckets.upsert(first, root, "k", 8, 0)) == 8
    before = buckets.state(spark, root)["folders"]
    touched = buckets.upsert(make(("k7", 700), ("k7", 70), ("neu", 1), (None, -2)), root, "k", batch=1)
    assert 1 <= len(touched) <= 3 and buckets.upsert(make(("k7", 0)), root, "k", batch=1) == []
    after = buckets.state(spark, root)["folders"]
    assert {b for b in after if before.get(b) != after[b]} == {str(b) for b in touched}
    want = {f"k{i}": i for i in range(50)} | {"k7": 700, "neu": 1, None: -2}
    assert {r["k"]: r["v"] for r in buckets.read(spark, root).collect()} == want and buckets.read(spark, root).count() == len(want)
    assert buckets.upsert(make(("k1", 0), ("k2", 0)), root, "k", append=True) == []
    commit, met = chain._commit, []

    def late(*a):
        if not met:
            met.append(1)
            buckets.upsert(make(("k1", 111)), root, "k")
        return commit(*a)

    monkeypatch.setattr(chain, "_commit", late)
    buckets.upsert(make(("k1", 112), ("fresh", 5)), root, "k", append=True)
    got = {r["k"]: r["v"] for r in buckets.read(spark, root).collect()}
    assert (got["k1"], got["fresh"]) == (111, 5)
    assert buckets.read(spark, str(tmp_path / "none")) is None


def test_sheets_come_back(spark, tmp_path, monkeypatch):
    """Marks of XML, control characters, long texts, nulls, numbers; several files; files that aren't sheets."""
    monkeypatch.setattr(sheets, "ROWS", 3)
    rows = [(1, 'a<b>&"c"', 1.5, True), (2, None, None, None), (3, " ü\n\tx _x000A_ \r \x01 ", -2.0, False), (4, "y" * 40_000, 1e300, None), (5, "", 0.1, True)]
    d = spark.createDataFrame(rows, "id long, text string, n double, flag boolean").withColumn("list", F.array("id"))
    folder = str(tmp_path / "s")
    for _ in range(2):
        sheets.write_sheets(d.coalesce(1), folder)
    (tmp_path / "s" / "broken.xlsx").write_bytes(b"no zip")
    (tmp_path / "s" / "other.txt").write_text("x")
    read = sheets.read_sheets(spark, folder)
    assert read.where("reason is not null").count() == 1 and read.select("path").distinct().count() == 3
    got = {int(r["id"]): (r["text"], r["n"], r["flag"], r["list"], r["none"]) for r in sheets.table_of(read, ["id", "text", "n", "flag", "list", "none"]).collect()}
    want = {i: ((t or None) and t[:32_767], n, f) for i, t, n, f in rows}
    assert {i: (t, None if n is None else float(n), {"true": True, "false": False, None: None}[f]) for i, (t, n, f, _, _) in got.items()} == want
    assert got[1][3:] == ("[1]", None)
    spark.dataSource.register(sheets.Sheets)
    assert spark.read.format("sheets").load(folder).where("reason is null").count() == read.where("reason is null").count()
    sheets.write_sheets(d.limit(0), str(tmp_path / "e"))
    assert sheets.read_sheets(spark, str(tmp_path / "e")).collect()[0]["cells"] == ["id", "text", "n", "flag", "list"]


def test_sheet_of_another_program():
    """Shared texts, logical and formula cells, rows and cells without places."""
    import io
    import zipfile

    out = io.BytesIO()
    ns = sheets.MAIN[1:-1]
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", sheets.BOOK.format("Blatt"))
        z.writestr("xl/_rels/workbook.xml.rels", sheets.PARTS.replace("worksheets/", "/xl/worksheets/"))
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{ns}"><si><t>eins</t></si><si><r><t>zw</t></r><r><t>ei</t></r></si></sst>')
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{ns}"><sheetData><row><c t="s"><v>0</v></c><c t="s"><v>1</v></c></row><row r="5"><c r="C5" t="b"><v>1</v></c><c r="AA5"><f>1+1</f><v>2</v></c></row></sheetData></worksheet>')
    got = list(sheets.sheet_rows(out.getvalue()))
    assert got == [("Blatt", 1, ["eins", "zwei"]), ("Blatt", 5, [None, None, "true", *[None] * 23, "2"])]
    assert [sheets.column_of(sheets.place_of(i, 1)) for i in range(800)] == list(range(800))


def test_lexicon_places_like_plain(spark, monkeypatch):
    """All places of words in other words and over one another; the lexicon in one automaton and in several."""
    rng = random.Random(6)
    texts = ["".join(rng.choice("abü ") for _ in range(rng.randint(0, 60))) for _ in range(80)]
    words = sorted({"".join(rng.choice("abü") for _ in range(rng.randint(1, 4))) for _ in range(40)} | {"a b", "zzz"})
    d = spark.createDataFrame([*enumerate(texts), (99, None), (None, "a")], "id long, text string")
    lexicon = spark.createDataFrame([(w,) for w in [*words, "", None, words[0]]], "w string")
    want = {(i, w, p + 1) for i, t in enumerate(texts) for w in words for p in range(len(t)) if t.startswith(w, p)}
    for most in (500_000, 8):
        monkeypatch.setattr(lexicons, "WORDS", most)
        rows = lexicons.places(d, lexicon, "id", F.col("text"), "w").collect()
        assert {(r["id"], r["word"], r["place"]) for r in rows} == want and len(rows) == len(want)
    assert lexicons.places(d, lexicon.limit(0), "id", F.col("text"), "w").count() == 0


# --- Models as plug-ins
def test_moderation_fails_open(spark):
    """Verdicts count, a moderator that fails lets the question pass and is flagged, and null is not asked."""
    d = spark.createDataFrame([(1, "bad words"), (2, "fine"), (3, None)], "id long, t string").coalesce(1)
    got = {r["id"]: tuple(r["m"]) for r in d.select("id", plugins.moderated(F.col("t"), lambda s: s.str.contains("bad")).alias("m")).collect()}
    assert got == {1: (True, False), 2: (False, False), 3: (False, False)}

    def down(texts):
        raise TimeoutError

    for broken in (down, lambda s: [], lambda s: [None] * len(s)):
        got = {r["id"]: tuple(r["m"]) for r in d.select("id", plugins.moderated(F.col("t"), broken).alias("m")).collect()}
        assert got == {1: (False, True), 2: (False, True), 3: (False, False)}


def test_descriptions_and_questions_in_other_words(spark):
    d = spark.createDataFrame([(1, "uno"), (2, "due"), (3, "tre"), (4, None), (5, " ")], "id long, t string").coalesce(1)
    said = {"uno": 'Ecco: ```json\n{"summary": " S ", "keywords": ["a", "", null, "b"], "topic": ""}\n```', "due": "no json"}
    told = lambda prompts: prompts.map(lambda p: said.get(p.rsplit("\n", 1)[1].strip()))
    got = {r["id"]: (r["m"]["summary"], r["m"]["keywords"], r["m"]["topic"]) for r in d.select("id", plugins.described(F.col("t"), told).alias("m")).collect()}
    none = ("N/A", [], "N/A")
    assert got == {1: ("S", ["a", "b"], "N/A"), 2: none, 3: none, 4: none, 5: none}
    words = lambda prompts: prompts.map(lambda p: {"uno": "\n  altra domanda \n resto"}.get(p.rsplit(" ", 1)[1]))
    assert [r["q"] for r in d.select("id", plugins.rephrased(F.col("t"), words).alias("q")).orderBy("id").collect()] == ["altra domanda", "due", "tre", None, " "]


def test_chat_stream_is_that_of_batches(spark, tmp_path):
    """Two starts on one checkpoint: the second batch's questions see their session's messages; answers are those of chat()."""
    passages = saved(answers.local_passages(spark, SF))
    items = [(r["item_id"], f"s{r['item_id'] % 2}", r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").limit(5).collect()]
    schema, root, at = "id long, session_id string, question string", str(tmp_path / "chat"), F.lit("2024-01-08").cast("timestamp")
    for part in (items[:3], items[3:]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        modes.chat_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), passages, root, str(tmp_path / "c"), at=at).awaitTermination()
    got = {r["id"]: r["answer"] for r in spark.read.parquet(f"{root}/answers").collect()}
    assert set(got) == {i for i, _, _ in items} and spark.read.parquet(f"{root}/audit").count() == 5
    talk = {s: [m for i, t, q in items[:3] if t == s for m in (("user", q), ("assistant", got[i]))] for s in ("s0", "s1")}
    said = spark.read.schema(modes.MESSAGES).parquet(f"{root}/messages")
    seen = {r["session_id"]: [tuple(m) for m in r["messages"]] for r in modes.recent_messages(said.where("batch = 0"), said.select("session_id")).collect()}
    assert seen == {s: t[-5:] for s, t in talk.items()}
    asked = spark.createDataFrame([(i, q, talk[s][-5:]) for i, s, q in items[3:]], "id long, question string, messages array<struct<role: string, content: string>>")
    assert {r["id"]: r["answer"] for r in modes.chat(asked, passages, at=at).collect()} == {i: got[i] for i, _, _ in items[3:]}
