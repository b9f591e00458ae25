"""Queries on what is written and read again: indices, a log, a cache."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import cells, graph, inverted, lexicons, oplog, retrieval
from ..sources import buckets, readers, sheets, sinks
from ..sources.scratch import saved, shared_dir
from ..streaming import twins
from . import corpus, modes
from . import expected as E
from .registry import ORACLE, query, table


def new_path(spark, name: str) -> str:
    """A new folder in the shared one."""
    return f"{shared_dir(spark)}/corpusflow-{name}-{uuid.uuid4().hex[:12]}"


def _questions(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query"), "text")


@query(ORACLE["bm25_topk"])
def stored_search(spark, sf_dir):
    """bm25_topk by an index that is written, then searched block by block."""
    path = new_path(spark, "inverted")
    inverted.build(table(spark, sf_dir, "documents").select("doc_id", "text"), path, "doc_id", "text")
    found = inverted.Search(spark, path, _questions(spark, sf_dir), 10).top()
    return found.select("query", "id", F.col("rank").cast("long").alias("rank"), F.round("score", 4).alias("score"))


@query(ORACLE["fts_topk"])
def stored_full_text(spark, sf_dir):
    """fts_topk by a stored index."""
    path = new_path(spark, "inverted")
    inverted.build(table(spark, sf_dir, "documents").select("doc_id", "text"), path, "doc_id", "text", retrieval.folded_tokens)
    found = inverted.full_text(spark, path, _questions(spark, sf_dir))
    return found.select("query", "id", F.col("rank").cast("long").alias("rank"), F.round("fts_rank", 4).alias("fts_rank"))


@query(ORACLE["knn_l2"])
def stored_knn(spark, sf_dir):
    """knn_l2 by an index of two shards, built apart and merged."""
    v = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    dims = v.where("embedding is not null").select(F.size("embedding").alias("n")).agg(F.mode("n")).first()[0] or 0
    parts = [new_path(spark, "cells") for _ in range(2)]
    for i, path in enumerate(parts):
        cells.build(v.where(F.pmod(F.xxhash64("vec_id"), F.lit(2)) == i), path, "vec_id", "embedding", dims)
    whole = new_path(spark, "cells")
    cells.merge(spark, parts, whole)
    asked = v.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query"), F.col("embedding").alias("vec"))
    found = cells.Search(spark, whole, asked, 10).top()
    return found.select("query", "id", F.round("distance", 5).alias("distance"), F.col("rank").cast("long").alias("rank"))


MOST, SECONDS = 12, 3600 * 24


@query(
    f"""WITH RECURSIVE e AS (SELECT event_type, event_id, epoch_us(ts) AS t, user_id AS k, row_number() OVER (PARTITION BY event_type ORDER BY epoch_us(ts), event_id) AS r FROM events),
    f AS (SELECT event_type, CAST(0 AS BIGINT) AS r, CAST(-1 AS BIGINT) AS event_id, false AS hit, CAST([] AS STRUCT(k BIGINT, since BIGINT)[]) AS held FROM (SELECT DISTINCT event_type FROM events)
      UNION ALL SELECT event_type, r, event_id, hit, list_concat(CASE WHEN hit THEN list_filter(live, lambda x: x.k <> k) ELSE live[greatest(1, len(live) - {MOST} + 2):] END,
        [{{'k': k, 'since': CASE WHEN hit THEN list_filter(live, lambda x: x.k = k)[1].since ELSE t END}}])
      FROM (SELECT *, list_contains(list_transform(live, lambda x: x.k), k) AS hit FROM
        (SELECT f.event_type, e.r, e.event_id, e.t, CAST(e.k AS BIGINT) AS k, list_filter(held, lambda x: e.t - x.since < {SECONDS * 1_000_000}) AS live FROM f JOIN e ON e.event_type = f.event_type AND e.r = f.r + 1)))
    SELECT event_id, hit FROM f WHERE r > 0"""
)
def bounded_cache(spark, sf_dir):
    """A cache of twelve entries and a day for each event type: the least recently used entry goes, a hit doesn't prolong an entry's life."""
    return oplog.cached(table(spark, sf_dir, "events"), "event_type", "user_id", "ts", MOST, SECONDS)


@query("SELECT doc_id, nullif(source, '') AS source, nullif(lang, '') AS lang, n_chars, nullif(substr(text, 1, 200), '') AS beginning FROM documents")
def sheet_roundtrip(spark, sf_dir):
    """Documents written as spreadsheets and read back."""
    path = new_path(spark, "sheets")
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars", F.substring("text", 1, 200).alias("beginning"))
    sheets.write_sheets(d, path)
    back = sheets.table_of(sheets.read_sheets(spark, path), d.columns)
    return back.select(F.col("doc_id").cast("long").alias("doc_id"), "source", "lang", F.col("n_chars").cast("long").alias("n_chars"), "beginning")


@query(
    r"""WITH l AS (SELECT DISTINCT lower(regexp_extract(text, '[^\s]+')) AS w FROM benchmark WHERE text IS NOT NULL)
    SELECT doc_id, w AS word, strpos(t, w) AS first, len(t) - strpos(reverse(t), reverse(w)) - len(w) + 2 AS last
    FROM (SELECT doc_id, lower(text) AS t FROM documents WHERE text IS NOT NULL), l WHERE w <> '' AND contains(t, w)"""
)
def lexicon_places(spark, sf_dir):
    """Where the first words of all items stand in documents, inside longer words too."""
    words = table(spark, sf_dir, "benchmark").select(F.lower(F.regexp_extract("text", r"[^\s]+", 0)).alias("w"))
    found = lexicons.places(table(spark, sf_dir, "documents").select("doc_id", "text"), words, "doc_id", F.lower("text"), "w")
    return found.groupBy(F.col("id").alias("doc_id"), "word").agg(F.min("place").alias("first"), F.max("place").alias("last"))


def _upserted(spark, sf_dir):
    """All documents, then those of one language with another text, then labels' ids as new rows and old ones: the root and what each wrote."""
    root = new_path(spark, "buckets")
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    first = saved(d)
    again = d.where("source = 'src1'").withColumn("lang", F.lit("xx"))
    extra = table(spark, sf_dir, "benchmark").select((-1 - F.col("item_id")).alias("doc_id"), F.lit("new").alias("lang"), F.lit(None).cast("string").alias("source"))
    done = [buckets.upsert(x, root, "doc_id", 16, i) for i, x in enumerate((first, again, extra))]
    done.append(buckets.upsert(again, root, "doc_id", batch=1))
    return root, done


@query(
    "SELECT doc_id, CASE WHEN source = 'src1' THEN 'xx' ELSE lang END AS lang, source FROM documents UNION ALL SELECT -1 - item_id, 'new', NULL FROM benchmark"
)
def upsert_buckets(spark, sf_dir):
    """A table of buckets after three upserts, one of which is tried again."""
    return buckets.read(spark, _upserted(spark, sf_dir)[0])


B16 = "CAST('0x' || substr(md5(CAST(k AS VARCHAR)), 1, 8) AS BIGINT) % 16"


@query(
    f"SELECT DISTINCT 0 AS batch, {B16} AS bucket FROM (SELECT doc_id AS k FROM documents) UNION SELECT 1, {B16} FROM (SELECT doc_id AS k FROM documents WHERE source = 'src1') "
    f"UNION SELECT 2, {B16} FROM (SELECT -1 - item_id AS k FROM benchmark)"
)
def upsert_rewritten(spark, sf_dir):
    """The buckets that each upsert rewrote: those its rows fall in; the one tried again none."""
    done = _upserted(spark, sf_dir)[1]
    return spark.createDataFrame([(i, b) for i, some in enumerate(done) for b in some], "batch int, bucket int")


@query("SELECT doc_id, lang FROM documents UNION ALL SELECT -1 - item_id, 'new' FROM benchmark")
def append_buckets(spark, sf_dir):
    """Records of new keys are added, those of old ones skipped."""
    root = new_path(spark, "buckets")
    d = table(spark, sf_dir, "documents").select("doc_id", "lang")
    extra = table(spark, sf_dir, "benchmark").select((-1 - F.col("item_id")).alias("doc_id"), F.lit("new").alias("lang"))
    buckets.upsert(d, root, "doc_id", 16)
    buckets.upsert(extra.unionByName(d.withColumn("lang", F.lit("old"))), root, "doc_id", append=True)
    return buckets.read(spark, root)


KIND = r"CASE WHEN regexp_matches(lower(regexp_extract({0}, '^[a-zA-Z][a-zA-Z0-9+.\-]*://[^/?#]*([^?#]*)', 1)), '\.(pdf|docx|doc|xlsx|xls)$') THEN 'file' ELSE 'page' END"


@query(
    f"""WITH RECURSIVE {corpus.LINKS}, e AS (SELECT DISTINCT p.url AS src, l.url AS dst FROM l JOIN pages p USING (page_id)),
    b AS (SELECT min(url) AS url FROM pages GROUP BY lower(regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1))),
    r AS (SELECT url, 0 AS depth, {KIND.format('url')} AS kind FROM b WHERE NOT regexp_matches(url, {E.quoted(E.EXCLUDED)})
      UNION SELECT dst, depth + 1, {KIND.format('dst')} FROM r JOIN e ON src = url WHERE kind = 'page' AND (depth < 2 OR depth = 2 AND {KIND.format('dst')} = 'file'))
    SELECT url, min(depth) AS depth, arg_min(kind, depth) AS kind FROM r GROUP BY url"""
)
def crawl_site(spark, sf_dir):
    """From the first page of each host two links far."""
    pages = table(spark, sf_dir, "pages").select("url", "html")
    start = pages.groupBy(F.lower(F.regexp_extract("url", "^[a-z]+://([^/?#:]+)", 1))).agg(F.min("url").alias("url")).select("url")
    return graph.crawl(start, pages, 2).select("url", F.col("depth").cast("int").alias("depth"), "kind")


@query("SELECT 'd' || doc_id AS chunk_id, lang AS text_content, coalesce(source, 'unknown') AS source_type FROM documents")
def snapshot_latest(spark, sf_dir):
    """Two snapshots written; the newest is read back."""
    root = new_path(spark, "snapshots")
    d = table(spark, sf_dir, "documents").select(F.concat(F.lit("d"), "doc_id").alias("chunk_id"), F.col("lang").alias("text_content"), F.col("source").alias("source_type"))
    sinks.write_version(d.withColumn("text_content", F.lit("old")), root, "20240101_000000")
    sinks.write_version(d, root, "20240102_000000")
    return readers.latest_snapshot(spark, root, "chunk_id string, text_content string, source_type string, page_number int, filename string").select("chunk_id", "text_content", "source_type")


@query("SELECT 'v' || v AS version, count(*) AS total_chunks FROM documents, (SELECT unnest([1, 2]) AS v) GROUP BY v")
def snapshot_manifests(spark, sf_dir):
    """What the manifests of two snapshots tell."""
    root = new_path(spark, "snapshots")
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("chunk_id"), F.col("lang").alias("text_content"))
    for day in ("20240101", "20240102"):
        sinks.write_version(d, root, day)
    return modes.datasets(spark, root).select("version", "total_chunks")


@query("SELECT sha256(coalesce(text, '')) AS sha256, count(*) > 0 AS seen FROM documents GROUP BY 1")
def ingest_stream(spark, sf_dir):
    """Documents that a stream brings in two parts, the second with the first's once more: each digest is taken once."""
    root = new_path(spark, "ingest")
    d = table(spark, sf_dir, "documents").select(F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha256"), "lang")
    for part in (d.where("lang in ('en', 'de')"), d):
        part.write.mode("append").parquet(f"{root}/in")
        twins.ingest_unseen(spark.readStream.schema(d.schema).parquet(f"{root}/in"), f"{root}/out", f"{root}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{root}/out").groupBy("sha256").agg((F.count("*") == 1).alias("seen"))


@query("SELECT doc_id, item, value FROM (SELECT doc_id, unnest(['lang', 'source']) AS item, unnest([lang, source]) AS value FROM documents) WHERE value IS NOT NULL")
def jsonl_lines(spark, sf_dir):
    """JSON lines among blank and broken ones: these are skipped."""
    root = new_path(spark, "lines")
    d = table(spark, sf_dir, "documents").select(F.inline(F.array(*[F.struct("doc_id", F.lit(c).alias("item"), F.col(c).alias("value")) for c in ("lang", "source")]))).where("value is not null")
    d.select(F.to_json(F.struct(*d.columns)).alias("value")).write.text(root)
    d.select(F.when(F.length("item") == 4, "").otherwise('{"doc_id": 1, "item"').alias("value")).write.mode("append").text(root)
    return readers.read_jsonl(spark, root, "doc_id long, item string, value string")

