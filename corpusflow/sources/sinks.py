"""Sinks: immutable versions with manifests, upserts, logs, indices, reports."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text
from ..operators import carry, inverted, retrieval
from . import sheets
from .readers import versions
from .scratch import exists, remove


def next_version(tags: Column) -> Column:
    """An aggregate: one more than the largest numeric tag; one more than their number if none is numeric."""
    number = F.nullif(F.regexp_extract(tags, "^v([0-9]+)", 1), F.lit("")).cast("int")
    return F.coalesce(F.max(number), F.count(tags).cast("int"), F.lit(0)) + 1


def normalized(chunks: DataFrame) -> DataFrame:
    """chunks with page_number, filename and source_type, the last `unknown` where it lacks."""
    out = chunks
    for name, kind in (("page_number", "int"), ("filename", "string"), ("source_type", "string")):
        if name not in out.columns:
            out = out.withColumn(name, F.lit(None).cast(kind))
    return out.withColumn("source_type", F.coalesce("source_type", F.lit("unknown")))


def fingerprint(rows: DataFrame) -> Column:
    """An aggregate over JSON lines (value): a digest of the digests' sum, whatever their order."""
    return F.sha2(F.concat_ws(":", F.count("*").cast("string"), F.sum(F.conv(F.substring(F.sha2("value", 256), 1, 14), 16, 10).cast("decimal(38,0)")).cast("string")), 256)


def manifest(chunks: DataFrame, lines: DataFrame, version: str, created_at: str, note: str) -> dict:
    """What is known of a snapshot: its counts by source type and its fingerprint."""
    total, visual, texts = chunks.agg(F.count("*"), F.count_if(F.col("source_type") == "visual_guide"), F.count_if(F.col("source_type") == "text_document")).first()
    kinds = chunks.groupBy("source_type").count().orderBy(F.desc("count"), "source_type").limit(1001).collect()
    by_source = {r["source_type"]: r["count"] for r in kinds[:1000]}  # the most frequent; of more the rest is told as one number
    digest = lines.agg(fingerprint(lines)).first()[0]
    return {"version": version, "created_at": created_at, "note": note, "total_chunks": total, "chunks_file_sha256": digest, "schema_version": "1.1", "stats": {"visual_guides": visual, "text_docs": texts}, "sources": by_source} | ({"other_sources": total - sum(by_source.values())} if len(kinds) > 1000 else {})


def write_text(spark: SparkSession, path: str, content: str) -> None:
    """One small file, on whatever store the path names, in place of an old one."""
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at, True)
    try:
        out.write(bytearray(content.encode()))
    finally:
        out.close()


def read_text(spark: SparkSession, path: str) -> str:
    return spark.read.text(path, wholetext=True).first()[0]


def _taken(spark: SparkSession, path: str) -> bool:
    """Whether this call made the file: it fails where there is one."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(at.getFileSystem(spark._jsc.hadoopConfiguration()).createNewFile(at))


def write_version(chunks: DataFrame, root: str, created_at: str, note: str = "") -> str | None:
    """Writes chunks as the next snapshot: JSON lines, a manifest, and `latest`, which names it; returns its folder, None for no chunks.

    The folder is new, so a snapshot is never changed; `latest` is written last. A number is taken by making an empty file of its name, which
    only one of two writers can; the other takes the next."""
    spark = chunks.sparkSession
    if chunks.isEmpty():
        return None
    found = versions(spark, root)
    number = (found[-1][0] if found else 0) + 1
    while not _taken(spark, f"{root}/taken/v{number}"):
        number += 1
    tag = f"v{number}"
    folder = f"{root}/{tag}_{created_at}"
    rows = normalized(chunks)
    rows.write.mode("errorifexists").option("ignoreNullFields", False).json(f"{folder}/chunks.jsonl")
    lines = spark.read.text(f"{folder}/chunks.jsonl")
    made = manifest(rows, lines, tag, created_at, note)
    write_text(spark, f"{folder}/manifest.json", json.dumps(made, indent=2, ensure_ascii=False))
    write_text(spark, f"{root}/latest", folder.rsplit("/", 1)[1])
    return folder


def manifests(spark: SparkSession, root: str) -> list[dict]:
    """The manifests below root, oldest first."""
    return [json.loads(read_text(spark, f"{folder}/manifest.json")) for _, folder in versions(spark, root) if exists(spark, f"{folder}/manifest.json")]


def dataset_fingerprint(spark: SparkSession, root: str) -> str:
    """`version:digest` of the newest snapshot; v0:nohash without one."""
    found = manifests(spark, root)
    return f"{found[-1]['version']}:{found[-1]['chunks_file_sha256']}" if found else "v0:nohash"


def latest_per_key(old: DataFrame, new: DataFrame, key: str, order: str) -> DataFrame:
    """The rows of both, the last in order for each key."""
    both = old.unionByName(new)
    return both.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))).where("_r = 1").drop("_r")


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """old with the rows of new in place of those of their keys; of several new rows of a key any one, the same in each run."""
    one = new.groupBy(key).agg(F.max(F.struct(*[c for c in new.columns if c != key])).alias("_s")).select(key, "_s.*")
    return old.join(one.select(key), key, "left_anti").unionByName(one.select(*old.columns))


def lexical_rows(chunks: DataFrame) -> DataFrame:
    """(chunk_id, term, tf, dl) of chunks, as full-text search keeps them."""
    return retrieval.postings_of(chunks.select(F.col("chunk_id").alias("id"), retrieval.folded_tokens(F.col("text_content")).alias("w"))).withColumnRenamed("id", "chunk_id")


def upsert_chunks(root: str, chunks: DataFrame) -> None:
    """Puts chunks (chunk_id, ...) and their lexical rows into the tables below root, in place of those of their ids. New tables are
    written beside and then named by `current`, so a reader never sees half of them."""
    spark = chunks.sparkSession
    at = int(read_text(spark, f"{root}/current")) if exists(spark, f"{root}/current") else 0
    for name, rows in (("chunks", chunks), ("lexical", lexical_rows(chunks))):
        target = f"{root}/{name}-{at + 1}"
        if at:
            old = spark.read.parquet(f"{root}/{name}-{at}")
            rows = upsert(old, rows, "chunk_id") if name == "chunks" else old.join(chunks.select("chunk_id"), "chunk_id", "left_anti").unionByName(rows)
        rows.write.mode("overwrite").parquet(target)
    write_text(spark, f"{root}/current", str(at + 1))


def current(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{name}-{read_text(spark, f'{root}/current')}")


def append_new(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    return old.unionByName(new.join(old.select(key), key, "left_anti").dropDuplicates([key]))


def append_records(path: str, new: DataFrame, key: str) -> None:
    """Adds the records whose key the JSON lines at path lack. The whole is written beside, the old kept as a backup, then renamed."""
    spark = new.sparkSession
    if not exists(spark, path):
        new.dropDuplicates([key]).write.json(path)
        return
    append_new(spark.read.schema(new.schema).json(path), new, key).write.mode("overwrite").json(f"{path}.tmp")
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(conf)
    if exists(spark, f"{path}.bak"):
        remove(spark, f"{path}.bak")
    fs.rename(at, jvm.org.apache.hadoop.fs.Path(f"{path}.bak"))
    fs.rename(jvm.org.apache.hadoop.fs.Path(f"{path}.tmp"), at)


def append(rows: DataFrame, path: str) -> None:
    """Adds rows to a Parquet table: audit rows, messages, versions."""
    rows.write.mode("append").parquet(path)


def audit_rows(events: DataFrame) -> DataFrame:
    """Rows of the audit log out of events (timestamp, endpoint, status, latency, question, answer_mode, docs_found, lexical): the question as
    16 letters of a digest; a status that is none of the three is an error."""
    status = F.when(F.col("status").isin("success", "blocked", "error"), F.col("status")).otherwise(F.raise_error(F.concat(F.lit("no status: "), F.coalesce("status", F.lit("null")))))
    return events.select("timestamp", "endpoint", status.alias("status"), "latency", text.hash16(F.col("question")).alias("query_hash"), "answer_mode", F.coalesce("docs_found", F.lit(0)).alias("docs_found"), F.coalesce("lexical", F.lit(False)).alias("bm25_active"))


def sessions(asked: DataFrame, at: Column) -> DataFrame:
    """New sessions for asked (user_role, ip_hash); ids are random."""
    return asked.select(F.uuid().alias("session_id"), at.alias("created_at"), F.coalesce("user_role", F.lit("operatore")).alias("user_role"), "ip_hash", at.alias("last_activity"))


def touched(sessions: DataFrame, messages: DataFrame) -> DataFrame:
    """sessions with last_activity as late as their last message (session_id, timestamp)."""
    last = messages.groupBy("session_id").agg(F.max("timestamp").alias("_t"))
    return sessions.join(last, "session_id", "left").withColumn("last_activity", F.greatest("last_activity", "_t")).drop("_t")


def event_fields(events: DataFrame) -> dict[str, Column]:
    meta = F.struct(F.col("docs_found"), text.redact_log(F.col("question")).alias("user_query_masked"))
    return {"endpoint": F.col("endpoint"), "latency_sec": F.col("latency"), "meta": meta, "status": F.col("status"), "timestamp": F.col("timestamp").cast("string"), "user_role": F.col("user_role")}


def write_lexical_index(docs: DataFrame, path: str, id_col: str, text_col: str, fingerprint: str = "", default_k: int = 15) -> None:
    """An index that inverted.Search opens, with a manifest."""
    stats = inverted.build(docs, path, id_col, text_col)
    write_text(docs.sparkSession, f"{path}/index.json", json.dumps(stats | {"dataset_fingerprint": fingerprint, "default_k": default_k}))


def write_vectors(docs: DataFrame, path: str, id_col: str, text_col: str, embed=retrieval.embedding, mode: str = "overwrite") -> None:
    """(id, content, vec) of docs; embed is a Column of vectors for a Column of texts, called a batch at a time. Empty texts are left out."""
    rows = docs.where(F.coalesce(text_col, F.lit("")) != "").select(F.col(id_col).alias("id"), F.col(text_col).alias("content"))
    rows.withColumn("vec", embed(F.col("content"))).write.mode(mode).parquet(path)


def write_report(rows: DataFrame, path: str, kind: str) -> None:
    """Rows as csv (with a header, lists joined), json or jsonl, xlsx (spreadsheets), or as an HTML table of at most 1000 rows, which says how many more there are."""
    if kind in ("json", "jsonl"):
        rows.write.mode("overwrite").json(path)
    elif kind == "xlsx":
        sheets.write_sheets(rows, path)
    elif kind == "csv":
        flat = [F.array_join(F.col(f.name).cast("array<string>"), ", ").alias(f.name) if f.dataType.typeName() == "array" else F.col(f.name) for f in rows.schema.fields]
        rows.select(*flat).write.mode("overwrite").option("header", True).option("quoteAll", True).csv(path)
    else:
        shown, total = rows.limit(1000).toPandas(), rows.count()
        more = f"<p>{total - len(shown)} more rows</p>" if total > len(shown) else ""
        write_text(rows.sparkSession, path, shown.to_html(index=False) + more)


def link_text(links: DataFrame, sources: int = 3) -> DataFrame:
    """(value) lines of a link map by frequency: number, url, category, frequency and the first sources."""
    links = carry.numbered(links, [F.desc("frequency"), F.col("url")], "n")
    shown = F.array_join(F.slice(F.col("sources").cast("array<string>"), 1, sources), ", ")
    return links.select("n", F.concat_ws(" | ", F.concat(F.lit("URL: "), "url"), F.concat(F.lit("Categoria: "), "category"), F.concat(F.lit("Frequenza: "), F.col("frequency").cast("string")), F.concat(F.lit("Fonti: "), shown)).alias("value"))


def merged_indices(parts: list[DataFrame]) -> DataFrame:
    """Shards of an index as one."""
    return reduce(DataFrame.unionByName, parts)
