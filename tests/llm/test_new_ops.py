"""Operators 11 to 13 against plain versions."""

import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter, defaultdict
from datetime import date, datetime

import duckdb
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from corpusflow.llm import align_tokens, catalog, changes, pii

SF = "/root/testdata/sf0.001"
A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


# --- op 11
@pytest.fixture(scope="module")
def sides():
    with open(A, "rb") as f, open(B, "rb") as g:
        return align_tokens.Sides(f.read(), g.read())


@pytest.fixture(scope="module")
def plain_tokens(sides):
    a_side, b_side = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a_side.encode_special_tokens = True

    def align(text):
        """n_a, n_b, n_groups, n_links, digest, links of one text, encoded whole."""
        none = (0, 0, 0, 0, "", [])
        if not text:
            return none
        a, b = a_side.encode(" " + text, add_special_tokens=False).ids, b_side.encode(text)
        raw_a, raw_b = [sides.a_bytes[i] for i in a], [sides.b_bytes[i] for i in b]
        if b"".join(raw_a) != (" " + text).encode() or b"".join(raw_b) != (" " + text).encode():
            return none
        i = j = 0
        x, y, in_a, in_b, groups, links = len(raw_a[0]), len(raw_b[0]), [a[0]], [b[0]], [], []
        while True:
            links.append((a[i], b[j]))
            if x == y:
                groups.append(",".join(map(str, in_a)) + "|" + ",".join(map(str, in_b)))
                i, j = i + 1, j + 1
                if i == len(a):
                    break
                x, y, in_a, in_b = x + len(raw_a[i]), y + len(raw_b[j]), [a[i]], [b[j]]
            elif x < y:
                i += 1
                x += len(raw_a[i])
                in_a.append(a[i])
            else:
                j += 1
                y += len(raw_b[j])
                in_b.append(b[j])
        return len(a), len(b), len(groups), len(links), hashlib.sha256(";".join(groups).encode()).hexdigest(), links

    return align


def check_alignment(plain, rows, got):
    want = {k: plain(t) for k, t in rows}
    n = Counter(p for w in want.values() for p in w[5])
    best = defaultdict(int)
    for (_, b), c in n.items():
        best[b] = max(best[b], c)
    for r in got:
        w = want[r["doc_id"]]
        assert tuple(r[c] for c in ("n_a", "n_b", "n_groups", "n_links", "groups_sha256")) == w[:5]
        assert (r["n_best"], r["count_sum"]) == (sum(n[p] == best[p[1]] for p in w[5]), sum(n[p] for p in w[5]))
    assert len(got) == len(rows)


def test_align_documents(spark, plain_tokens):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    check_alignment(plain_tokens, [(r["doc_id"], r["text"]) for r in d.collect()], catalog.op11_align_tokens(spark, SF).collect())


def test_align_odd_texts_in_small_pieces(spark, plain_tokens, monkeypatch):
    """Odd texts, hot ids over several tasks, sums passed on early; extra columns with the names used inside."""
    monkeypatch.setattr(align_tokens, "PIECE", 600)
    monkeypatch.setattr(align_tokens, "LOAD", 500)
    monkeypatch.setattr(align_tokens, "HELD", 300)
    rng = random.Random(3)
    some = [*"ab  \n\t .,'’1é€日▁\x00\x1c  ſ😀", "<|endoftext|>", "<s>", " the", " word", "n't", " the the"]
    texts = ["", None, " ", "a", "▁", "x ▁", "<|endoftext|>", " lead", "trail ", "é" * 3000] + ["".join(rng.choice(some) for _ in range(rng.randint(0, 40))) for _ in range(400)] + ["the same text"] * 60
    rows = list(enumerate(texts))
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("b", "piece", "part", "doc", "body", "id", "size", "salt")})
    got = align_tokens.align_documents(d.repartition(3), A, B).collect()
    check_alignment(plain_tokens, rows, got)
    assert sum(r["groups_sha256"] == "" for r in got) > 4


def test_align_repeated_null_ids_and_empty_table(spark, plain_tokens):
    d = spark.createDataFrame([(None, "one two"), (None, "one two"), (3, "one"), (3, "one")], "doc_id long, text string")
    got = sorted((str(r["doc_id"]), r["n_a"], r["count_sum"]) for r in align_tokens.align_documents(d, A, B).collect())
    _, _, _, links, _, pairs = plain_tokens("one two")
    assert links == 2 and pairs[0] in plain_tokens("one")[5]
    assert got == [("3", 1, 4), ("3", 1, 4), ("None", 2, 6), ("None", 2, 6)]
    assert align_tokens.align_documents(d.limit(0), A, B).count() == 0


def test_large_arrow_types_are_refused(spark):
    spark.conf.set("spark.sql.execution.arrow.useLargeVarTypes", "true")
    try:
        with pytest.raises(ValueError, match="useLargeVarTypes"):
            align_tokens.align_documents(spark.createDataFrame([(1, "a")], "doc_id long, text string"), A, B)
    finally:
        spark.conf.set("spark.sql.execution.arrow.useLargeVarTypes", "false")


# --- op 12
def plain_changes(rows):
    """rows: (change_id, client_id, seq, op, valid_at, source, segment, city, balance), one at a time."""
    rows = set(rows)
    seqs = defaultdict(set)
    for r in rows:
        seqs[r[1]].add(r[2])
    rank = {c: {s: i for i, s in enumerate(sorted(v, key=lambda x: (x is not None, x or 0)), 1)} for c, v in seqs.items()}
    batches = defaultdict(list)
    for r in rows:
        h = zlib.crc32(str(r[0]).encode())
        if r[4] is None or h % 11 == 0:
            continue
        day = (r[4].date() - date(1970, 1, 1)).days + 9 * (h % 4)
        batches[min(12, 1 + (day - 19723) * 12 // 160)].append((day, r[0], rank[r[1]][r[2]], r))
    following, held, value, out, largest = defaultdict(lambda: 1), defaultdict(dict), {}, {}, -(10**9)

    def run(c, b, missed):
        while following[c] in held[c]:
            n = following[c]
            r = held[c].pop(n)[3]
            city, balance = value.get(c, (None, None))
            if r[3] == "I":
                city, balance = r[7], r[8]
            elif r[3] == "U":
                city, balance = city if r[7] is None else r[7], balance if r[8] is None else r[8]
            elif r[3] == "D":
                city = balance = None
            value[c] = (city, balance)
            out[r] = ("applied", b, missed, city, None if balance is None else math.floor(100 * balance + 0.5), n)
            missed, following[c] = 0, n + 1

    for b in range(1, 14):
        for c in list(held):
            while held[c] and (b == 13 or min(x[0] for x in held[c].values()) + 3 <= largest):
                first = min(held[c])
                missed, following[c] = first - following[c], first
                run(c, b, missed)
        for x in sorted(batches.get(b, ()), key=lambda x: x[:2]):
            c = x[3][1]
            if x[2] < following[c] or x[2] in held[c]:
                out[x[3]] = ("rejected", b, 0, None, None, x[2])
            else:
                held[c][x[2]] = x
                run(c, b, 0)
        largest = max([largest, *(x[0] for x in batches.get(b, ()))])
    last = defaultdict(int)
    for r, o in out.items():
        if o[0] == "applied":
            last[r[1]] = max(last[r[1]], o[5])
    return sorted(((r[0], r[1], *o[:5], o[0] == "applied" and o[5] == last[r[1]] and r[3] != "D") for r, o in out.items()), key=str)


COLUMNS = ("change_id", "client_id", "status", "batch", "missed", "city", "cents", "current")
CHANGES = "change_id long, client_id long, seq long, op string, valid_at timestamp, source string, segment string, city string, balance double"


def applied(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=str)


def test_changes_of_the_table(spark):
    """The query, its SQL and the plain version agree."""
    con = duckdb.connect()
    con.execute(f"CREATE VIEW client_changes AS SELECT * FROM read_parquet('{SF}/client_changes.parquet')")
    rows = con.execute("SELECT change_id, client_id, seq, op, valid_at, source, segment, city, balance FROM client_changes").fetchall()
    want = plain_changes(rows)
    sql = con.execute(f"SELECT {', '.join(COLUMNS)} FROM ({changes.ORACLE_SQL})").fetchall()
    assert sorted(sql, key=str) == want
    assert applied(catalog.op12_apply_changes(spark, SF)) == want
    assert len({w[3] for w in want if w[2] == "applied"}) > 10 and sum(w[4] > 0 for w in want) > 50


def test_changes_of_a_huge_client_over_many_pages(spark, monkeypatch):
    """One client's numbers over pages of four, of which two are kept loaded; ties, repeated rows, nulls, unknown ops, extra columns."""
    monkeypatch.setattr(changes, "PAGE", 4)
    monkeypatch.setattr(changes, "LOADED", 2)
    rng = random.Random(1)
    rows = []
    for i in range(500):
        client = 7 if i % 3 else rng.choice((None, 1, 2))
        seq = rng.choice((None, i, i + rng.randint(-20, 20), i // 2))
        at = datetime(2024, 1, 1 + i * 27 // 500) if i % 40 else None
        rows.append((i if i % 90 else 2**60 + i, client, seq, rng.choice("IUUUUD?"), at, "s", None, rng.choice((None, "A", "B")), rng.choice((None, 1.5, -2.005, 1e6))))
    rows += rows[:60]
    d = spark.createDataFrame(rows, CHANGES).withColumns({c: F.lit("x") for c in ("n", "day", "bucket", "batch", "part", "file")})
    assert applied(changes.apply_changes(d.repartition(5))) == plain_changes(rows)


def test_changes_of_an_empty_table(spark):
    assert changes.apply_changes(spark.createDataFrame([], CHANGES)).count() == 0


# --- op 13
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_base(text):
    out = []
    for i, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(x) > 255 for x in m[0].split(".")):
                continue
            if kind == "card":
                total = sum(int(d) if k % 2 == 0 else sum(map(int, str(2 * int(d)))) for k, d in enumerate(reversed(digits)))
                if not 14 <= len(digits) <= 19 or total % 10:
                    continue
            if kind == "phone" and not 10 <= len(digits) <= 15:
                continue
            out.append((m.start(), i, m.end()))
    return sorted(out)


@pytest.fixture(scope="module")
def field():
    return pii.train(pii.examples())


def test_base_spans_like_the_patterns():
    rng = random.Random(2)
    some = [*"0123456789+-. ()@_%ax\n", "a@b.c", "@", "1.2.3.4", "+1 (743) 555-3824", "4737097684299439", "4111 1111 1111 1111", "é", "x.y@", "٣"]
    for _ in range(20_000):
        text = "".join(rng.choice(some) for _ in range(rng.randint(0, 25)))
        assert pii.base_spans(text) == plain_base(text), text
    assert pii.base_spans("1.1.1." + "0" * 6000 + "7")[0][1] == 1


def test_base_spans_of_long_runs_take_linear_time():
    begin = time.time()
    for text in ("a" * 500_000, "1" * 500_000, "a@" * 100_000, "+1" + " " * 300_000, "1 " * 200_000):
        assert pii.base_spans(text) == []
    assert len(pii.base_spans("1." * 200_000 + "x")) == 50_000
    assert time.time() - begin < 20


def test_field_finds_what_the_patterns_miss(field):
    finder = pii.Finder(field)

    def kinds(text):
        base, every = finder.find([text])[0]
        return [(pii.KINDS[k], text[a:b]) for a, k, b in every]

    assert kinds("write to jane at example dot com today") == [("spelled_email", "jane at example dot com")]
    assert kinds("my name is Clara Becker, call 743-555-3824.") == [("person", "Clara Becker"), ("local_phone", "743-555-3824")]
    both = kinds("ring +1 (743) 555-3824 or re.46@mail8.example.com")
    assert both == [("phone", "+1 (743) 555-3824"), ("email", "re.46@mail8.example.com")]
    assert kinds("Licensed under the Apache License, Version 2.0.\nThe water of 12 houses.") == []


def test_field_on_texts_it_did_not_see(field):
    """Spans found and right on examples of another seed."""
    finder = pii.Finder(field)
    held = pii.examples(400, seed=99)
    found = hit = want = 0
    for (text, spans), (base, every) in zip(held, finder.find([t for t, _ in held]), strict=True):
        got = {(pii.KINDS[k], a, b) for a, k, b in every if k >= len(pii.BASE)}
        found, want, hit = found + len(got), want + len(spans), hit + len(got & set(spans))
    assert hit >= 0.93 * want and hit >= 0.93 * found


def test_field_decodes_like_all_paths(field):
    """Viterbi against the best of all label sequences, and the sequences that are left undecoded."""
    import itertools

    import numpy as np

    rng = np.random.default_rng(1)
    sizes = np.array([0, 3, 1, 4, 0, 2])
    emit = rng.normal(size=(int(sizes.sum()), len(pii.LABELS))).astype(np.float32) * 4
    got = field.decode(emit, np.cumsum(sizes) - sizes, sizes)
    for at, n in zip(np.cumsum(sizes) - sizes, sizes, strict=True):
        paths = list(itertools.product(range(len(pii.LABELS)), repeat=int(n)))
        score = [sum(emit[at + i, y] for i, y in enumerate(p)) + sum(field.steps[a, b] for a, b in itertools.pairwise(p)) + (field.first[p[0]] if p else 0) for p in paths]
        assert tuple(got[at : at + n]) == paths[int(np.argmax(score))]


def test_personal_data_of_documents(spark):
    d = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = catalog.op13_find_personal(spark, SF).collect()
    assert len(got) == len(d)
    for r in got:
        base = plain_base(d[r["doc_id"]])
        text = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in base)
        assert r["base_sha256"] == hashlib.sha256(text.encode()).hexdigest()
        assert [r[f"n_{k}"] for k in pii.BASE] == [sum(x == i for _, x, _ in base) for i in range(4)]
        assert set(filter(None, text.split(","))) <= set(r["spans"].split(","))
    assert sum(r["n_email"] + r["n_ip"] + r["n_card"] + r["n_phone"] for r in got) > 10


def test_personal_data_odd_rows(spark, field):
    rows = [(1, None), (1, ""), (None, "a@b.de"), (None, "a@b.de"), (2, "x" * 300_000 + " 1.2.3.4 é 1.2.3.4"), (3, "\n\n \n")]
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("id", "size", "spans")})
    got = sorted((str(r["doc_id"]), r["n_email"], r["n_ip"], r["spans"]) for r in pii.find_personal(d, field).collect())
    assert got == [("1", 0, 0, ""), ("1", 0, 0, ""), ("2", 0, 2, "ip:300001:300008,ip:300011:300018"), ("3", 0, 0, ""), ("None", 1, 0, "email:0:6"), ("None", 1, 0, "email:0:6")]
    assert pii.find_personal(d.limit(0), field).count() == 0
    empty = pii.fit(pii.labelled(spark).limit(0))
    assert pii.find_personal(d, empty).count() == len(rows)


# --- The pipeline's columns
def test_stages_give_back_all_columns(spark):
    """Extra columns with every name that stages use inside come back as they were."""
    names = ("_row", "_maybe", "_place", "_word", "_bits", "_whole", "_extra", "_size", "_time", "_r", "_more", "row", "id", "at", "fp", "grp", "bucket", "target", "taken", "kept", "odd name")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    docs = docs.select("text", *[F.concat(F.lit(f"{c}:"), "doc_id").alias(c) for c in names], "doc_id", "lang", "source", "n_chars")
    labels = {r["doc_id"]: r["text"] for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        rows = out.collect()
        assert rows and all(r[c] == f"{c}:{r['doc_id']}" for r in rows for c in names)
        if name != "mixing":
            assert all(r["text"] == labels[r["doc_id"]] for r in rows)
    assert "n_chars" not in corpus_pipeline.mix_stage(spark, docs.drop("n_chars"), SF).columns
