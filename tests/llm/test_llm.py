"""Operators against plain versions, round trips and odd tables."""

import hashlib
import random
import zlib

import numpy as np
import pytest
import public_tokenizers
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from corpusflow.llm import bpe, catalog, chat, embed_dedup, exact_dedup, mixing, quality, sharding, simhash, suffix_dedup, warc

SF = "/root/testdata/sf0.001"
ODD = [(1, None, "x"), (2, "", None), (3, "same text here now", "x"), (4, "same text here now", "y"), (4, "same text here now", "y"), (None, "w " * 30000, "x"), (6, "ünïcode \n\t ß " * 30, None)]


def odd(spark, rows=ODD):
    return spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("id", F.lit(1)).withColumn("row", F.lit(1)).withColumn("size", F.lit(2))


def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_bpe_like_the_library(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    for r in bpe.encode_documents(docs(spark), path).join(docs(spark), "doc_id").collect():
        ids = library.encode(r["text"], add_special_tokens=False).ids
        assert np.frombuffer(r["ids"], "<u4").tolist() == ids
        assert r["decoded"] == library.decode(ids, skip_special_tokens=False)
    own = bpe.Tokenizer(open(path, "rb").read())
    rng = random.Random(1)
    for _ in range(2000):
        s = "".join(rng.choice("aAbBeErRsStT' <|>!é\tΣσß1 \x1c՘中") for _ in range(rng.randint(0, 30))) + rng.choice(["", "<|endoftext|> x"])
        assert np.frombuffer(own.encode([s])[0], "<u4").tolist() == library.encode(s, add_special_tokens=False).ids
    assert own.encode(["aaaaaaa"]) == [own.alone(b"aaaaaaa")]


def plain_print(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hs = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hs) * 2 > len(hs))


def plain_components(ids, linked):
    label = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a, b in linked:
            low = min(label[a], label[b])
            if label[a] != low or label[b] != low:
                label[a] = label[b] = low
                changed = True
    return label


def test_simhash_like_brute_force(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in d.select("doc_id", "text").collect()}
    fps = {i: plain_print(t) for i, t in texts.items()}
    ids = sorted(fps)
    linked = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if (fps[a] ^ fps[b]).bit_count() <= 4]
    label = plain_components(ids, linked)
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.simhash_dedup(d).collect()}
    assert got == {i: (f"{fps[i]:016x}", label[i]) for i in ids}


def test_simhash_trees_find_all():
    rng = np.random.default_rng(0)
    base = rng.integers(0, 2**63, 600, dtype=np.uint64)
    near = base[:300] ^ (np.uint64(1) << rng.integers(0, 63, 300, dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(0, 63, 300, dtype=np.uint64))
    fps = np.unique(np.concatenate((base, near)))
    want = {(int(a), int(b)) for a in fps for b in fps[np.bitwise_count(fps ^ a) <= 4] if a != b}
    masks, radius = simhash.blocks(4)
    found = set()
    for m in masks:
        for a, b in simhash.search(fps, fps, np.uint64(m), 4, radius, rng):
            found |= {(int(x), int(y)) for x, y in zip(a, b, strict=True) if x != y}
    assert plain_components(fps.tolist(), found) == plain_components(fps.tolist(), want)


@pytest.mark.parametrize("counts", [1 << 24, 10])
def test_repeats_like_brute_force(counts, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "COUNTS", counts)
    rng = random.Random(3)
    parts = [bytes(rng.choice(b"ab") for _ in range(rng.randint(16, 60))) for _ in range(150)] + [b"a" * 80, b"ab" * 40]
    seen = set()
    for p, got in zip(parts, suffix_dedup.repeated(parts, 16), strict=True):
        want = []
        for i in range(len(p) - 15):
            if p[i : i + 16] in seen:
                want.append(i)
            seen.add(p[i : i + 16])
        assert got.tolist() == want


@pytest.mark.parametrize("crowd", [20_000, 3])
def test_suffix_dedup_like_brute_force(spark, crowd, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "CROWD", crowd)
    rows = sorted(docs(spark).select("doc_id", "text").collect())
    got = suffix_dedup.digests(suffix_dedup.remove_repeats(docs(spark))).collect()
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got}
    want = suffix_dedup.brute_force([(t or "").encode() for _, t in rows], 100)
    assert got == {i: w for (i, _), w in zip(rows, want, strict=True)}


def test_embeddings_like_brute_force(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(120, 16))
    v = np.concatenate((base, base[:60] + rng.normal(size=(60, 16)) * 0.05, base[:5]))
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(900, None), (901, [0.0] * 16), (902, [float("nan")] * 16), (903, [1.0, None]), (904, [1.0, 2.0])]
    got = {r["vec_id"]: r for r in embed_dedup.link_embeddings(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    a, b = np.nonzero(u @ u.T >= 0.95)
    label = plain_components(range(len(v)), [(int(x), int(y)) for x, y in zip(a, b, strict=True) if x < y])
    assert all(got[i]["n_links"] == ((u @ u[i]) >= 0.95).sum() - 1 and got[i]["component_id"] == label[i] for i in range(len(v)))
    assert all(got[i]["n_links"] == 0 and got[i]["kept"] for i in (900, 901, 902, 903, 904))


def test_chat_round_trip(spark):
    rows = [(1, 0, "user", r"\### </turn> <turn>ok"), (1, 1, "assistant", "a</turn>\n\\"), (1, 2, "tool\nx", None), (2, 0, "assistant", ""), (None, 1, None, "t\\n"), (1, 2, "tool\nx", None)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    back = chat.read_back(chat.format_chats(turns)).collect()
    got = sorted(((r["conv_id"], r["role"], r["text"]) for r in back), key=str)
    assert got == sorted(((c, r or "", t or "") for c, _, r, t in rows), key=str)
    assert {r["loss"] for r in back if r["loss"]} == {"a</turn>\n\\"}


def test_sharding(spark):
    rows = sharding.assign_shards(docs(spark)).collect()
    by = {}
    for r in rows:
        by.setdefault(r["shard"], []).append(r["slot"])
        assert r["grown_shard"] in (r["shard"], 16)
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in docs(spark).collect()}
    assert all(r["text_crc32"] == zlib.crc32(texts[r["doc_id"]]) and r["size"] == len(texts[r["doc_id"]]) + 1 for r in rows)


def test_warc_files(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://a", "x\r\n\r\ny"), (2, "http://b", "x\r\n\r\ny"), (3, None, None), (4, "http://c", "")], "page_id long, url string, html string")
    warc.write_archives(warc.records(pages), str(tmp_path / "w"))
    got = {r["page_id"]: (r["record_type"], r["refers_to"], bytes(r["payload"])) for r in warc.read_archives(spark, str(tmp_path / "w")).collect()}
    assert got == {1: ("response", None, b"x\r\n\r\ny"), 2: ("revisit", 1, b""), 3: ("response", None, b""), 4: ("revisit", 3, b"")}


def test_quality_held_out(spark):
    d, y = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = quality.score(d, quality.fit(d, y)).join(y, "doc_id").where("held_out").collect()
    assert sum(r["predicted"] == r["quality"] for r in got) >= 0.93 * len(got)


def test_mix_near_targets(spark):
    rows = mixing.mix(docs(spark)).groupBy("source_size", "target").agg(F.sum("taken").alias("t"), F.max(F.col("taken") - 2 * F.col("size")).alias("over")).collect()
    assert all(r["over"] <= 0 for r in rows)


def test_odd_tables(spark):
    for d in (odd(spark), odd(spark, [])):
        n = d.count()
        exact = exact_dedup.exact_dedup(d).collect()
        assert len(exact) == n and sum(r["kept"] for r in exact) == len({r["text_sha256"] for r in exact})
        near = simhash.simhash_dedup(d).collect()
        assert len(near) == n and sum(r["kept"] for r in near) == len({r["component_id"] for r in near})
        assert mixing.mix(d).count() == sharding.assign_shards(d).count() == n
        out = suffix_dedup.remove_repeats(d).collect()
        assert len(out) == n
        assert bpe.encode_documents(d, public_tokenizers.path("word_bpe_49k.json")).count() == n
        y = spark.createDataFrame([(3, 1), (2, 0)], "doc_id long, quality int")
        assert quality.score(d, quality.fit(d, y)).count() == n
    assert embed_dedup.link_embeddings(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    assert chat.format_chats(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_pipeline_stages(spark):
    d = docs(spark)
    exact = corpus_pipeline.exact_stage(spark, d, SF)
    last = {}
    for r in d.collect():
        last[r["text"]] = max(last.get(r["text"], -1), r["doc_id"])
    assert {r["doc_id"] for r in exact.collect()} == set(last.values())
    assert exact.columns == d.columns
    mixed = corpus_pipeline.mix_stage(spark, d, SF)
    total = sum(len((r["text"] or "").encode().split()) for r in mixed.collect())
    assert abs(total - mixing.mix(d).agg(F.sum("taken")).first()[0]) <= 1
    out = corpus_pipeline.run(spark, SF)
    assert out.count() > 0 and hashlib.sha256(bytes(out.first()["ids"])).hexdigest() == out.first()["ids_sha256"]


def test_catalog_has_all():
    assert [f"op{i}" for i in range(1, 14)] == sorted({n.split("_")[0] for n in catalog.QUERIES}, key=lambda x: int(x[2:]))


def test_simhash_search_dense_and_block_equal():
    """Leaves, dense groups and sets that only whole fingerprints cut give the components of all pairs."""
    rng = np.random.default_rng(1)
    masks, radius = simhash.blocks(4)
    near = [0x123456789ABCDEF0 ^ sum(1 << int(x) for x in rng.choice(64, rng.integers(0, 9), replace=False)) for _ in range(2500)]
    same_block = rng.integers(0, 2**63, 2500, dtype=np.uint64) & ~np.uint64(masks[0]) | np.uint64(5)
    fps = np.unique(np.concatenate((np.array(near, np.uint64), same_block)))
    a, b = np.nonzero(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 4)
    found = [pair for m in masks for pair in simhash.search(fps, fps, np.uint64(m), 4, radius, np.random.default_rng(0))]
    got = simhash.forest(*(np.concatenate(x) for x in zip(*found, strict=True)))
    want = simhash.forest(fps[a], fps[b])
    assert len(want[0]) > 1000
    assert dict(zip(*got, strict=True)) == dict(zip(*want, strict=True))


def test_embeddings_links_that_full_lists_hide(spark):
    """Groups larger than the lists, each closer to itself than to the other it links to."""
    rng = np.random.default_rng(5)

    def group(centre, n):
        return centre + rng.normal(size=(n, 16)) * 0.002

    a, far = np.eye(16)[0], np.eye(16)[5]
    b = a * np.cos(0.25) + np.eye(16)[1] * np.sin(0.25)
    c = a * np.cos(0.5) + np.eye(16)[1] * np.sin(0.5)  # links to b's group, not to a's
    v = np.concatenate((group(a, 30), group(b, 30), group(c, 30), group(far, 20)))
    got = {r["vec_id"]: r for r in embed_dedup.link_embeddings(spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")).collect()}
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    links = u @ u.T >= 0.95
    assert [links[0].sum(), links[30].sum(), links[60].sum(), links[90].sum()] == [60, 90, 60, 20]
    assert all((got[i]["n_links"], got[i]["component_id"]) == (links[i].sum() - 1, 0 if i < 90 else 90) for i in range(len(v)))


def test_embeddings_audit_weighs_nodes(spark):
    """A hot group that is found whole does not hide that all pairs are lost."""
    rng = np.random.default_rng(6)
    base = rng.normal(size=(100, 16))
    v = np.concatenate((base[:1] + rng.normal(size=(100, 16)) * 0.001, base[1:], base[1:] + rng.normal(size=(99, 16)) * 0.01))
    nodes = spark.createDataFrame([(i, x.tolist(), 1) for i, x in enumerate(v)], "node long, vec array<double>, weight long")
    counts = spark.createDataFrame([(i, 99, 99) for i in range(100)], "node long, links long, others long")
    assert embed_dedup.found(None, nodes, counts, 0.95, 256) < 0.9


def test_embeddings_fall_back_to_all_pairs(spark, monkeypatch):
    """Where lists and trees are too poor for the recall asked, the result is exact all the same."""
    monkeypatch.setattr(embed_dedup, "LEAF", 2)
    monkeypatch.setattr(embed_dedup, "TREES", 1)
    monkeypatch.setattr(embed_dedup, "WHOLE", 100, raising=False)
    rng = np.random.default_rng(7)
    base = rng.normal(size=(200, 64))
    v = np.concatenate((base, base + rng.normal(size=(200, 64)) * 0.28))
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    links = u @ u.T >= 0.95
    assert links.sum() > 500
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    got = {r["vec_id"]: r["n_links"] for r in embed_dedup.link_embeddings(rows, k=1, max_rounds=1).collect()}
    assert got == {i: links[i].sum() - 1 for i in range(len(v))}
