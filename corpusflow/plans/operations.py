"""Queries on logs, sessions, limits, versions and tables that are kept."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text
from ..operators import carry, oplog
from ..sources import chain, sinks
from ..sources.scratch import shared_dir
from .registry import ORACLE, query, table


@query(
    "SELECT count(*) AS total, count(*) FILTER (WHERE event_type = 'error') AS errors, round(avg(value), 4) AS avg_value, round(max(value), 4) AS "
    "max_value FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 7 DAY"
)
def audit_stats_7d(spark, sf_dir):
    """The last seven days before the newest event: its time is read first, so the scan is filtered by a literal."""
    e = table(spark, sf_dir, "events")
    last = e.agg(F.max("ts")).first()[0]
    return oplog.audit_stats(e.where(F.col("ts") >= F.lit(last) - F.expr("INTERVAL 7 DAYS")) if last is not None else e)


@query(
    "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY us RANGE BETWEEN 3599999999 PRECEDING AND CURRENT ROW) AS load FROM (SELECT event_id, "
    "user_id, epoch_us(ts) AS us FROM events)"
)
def offered_load_1h(spark, sf_dir):
    return oplog.offered_load(table(spark, sf_dir, "events"), "user_id", "ts", 3600).select("event_id", "load")


HOURS = "SELECT event_id, user_id % 5 AS k, epoch_us(ts) // 3600 AS t FROM events"


def _fast(spark, sf_dir):
    """Five callers, time 3600 times as fast, so that limits by the minute bind."""
    e = table(spark, sf_dir, "events")
    fast = F.timestamp_micros(F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 3600))
    return e.select("event_id", (F.col("user_id") % 5).alias("k"), fast.alias("ts"))


@query(
    f"""WITH RECURSIVE e AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY t, event_id) AS r FROM ({HOURS})),
    f AS (SELECT k, CAST(0 AS BIGINT) AS r, CAST(-1 AS BIGINT) AS event_id, false AS accepted, CAST([] AS BIGINT[]) AS kept FROM (SELECT DISTINCT k FROM e)
      UNION ALL SELECT f.k, e.r, e.event_id, len(list_filter(kept, lambda x: t - x < 60000000)) < 15,
        CASE WHEN len(list_filter(kept, lambda x: t - x < 60000000)) < 15 THEN list_filter(kept, lambda x: t - x < 60000000) || [t]
          ELSE list_filter(kept, lambda x: t - x < 60000000) END
      FROM f JOIN e ON e.k = f.k AND e.r = f.r + 1)
    SELECT event_id, accepted FROM f WHERE r > 0"""
)
def rate_limiter(spark, sf_dir):
    """At most 15 accepted in the trailing 60 seconds."""
    return oplog.limited(_fast(spark, sf_dir), "k", "ts").select("event_id", "accepted")


@query(
    f"""WITH RECURSIVE e AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY t, event_id) AS r FROM ({HOURS})),
    f AS (SELECT k, CAST(0 AS BIGINT) AS r, CAST(-1 AS BIGINT) AS event_id, false AS accepted, CAST(0 AS DOUBLE) AS level, CAST(0 AS BIGINT) AS last
      FROM (SELECT DISTINCT k FROM e)
      UNION ALL SELECT f.k, e.r, e.event_id, greatest(0, level - (t - last) / 60000000 * 10) <= 5, greatest(0, level - (t - last) / 60000000 * 10) +
        CASE WHEN greatest(0, level - (t - last) / 60000000 * 10) <= 5 THEN 1 ELSE 0 END, t
      FROM f JOIN e ON e.k = f.k AND e.r = f.r + 1)
    SELECT event_id, accepted FROM f WHERE r > 0"""
)
def proxy_limiter(spark, sf_dir):
    """Ten a minute, bursts of five."""
    return oplog.leaky(_fast(spark, sf_dir), "k", "ts").select("event_id", "accepted")


@query(
    """WITH RECURSIVE e AS (SELECT event_id, user_id, event_type, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS r FROM events),
    f AS (SELECT user_id, event_type, CAST(0 AS BIGINT) AS r, CAST(-1 AS BIGINT) AS event_id, false AS miss, CAST(NULL AS BIGINT) AS since
      FROM (SELECT DISTINCT user_id, event_type FROM e)
      UNION ALL SELECT f.user_id, f.event_type, e.r, e.event_id, since IS NULL OR t - since >= 3600000000, CASE WHEN since IS NULL
        OR t - since >= 3600000000 THEN t ELSE since END
      FROM f JOIN e ON e.user_id = f.user_id AND e.event_type = f.event_type AND e.r = f.r + 1)
    SELECT event_id FROM f WHERE r > 0 AND miss"""
)
def ttl_dedup_1h(spark, sf_dir):
    """What a cache of an hour answers anew: a hit doesn't prolong an entry's life."""
    return oplog.ttl_misses(table(spark, sf_dir, "events"), ["user_id", "event_type"], "ts", 3600)


ENTRY = """'{"endpoint": "' || event_type || '", "previous_audit_hash": "' || {0} || '", "status": ' || CASE WHEN event_id % 3 = 0 THEN 'null' ELSE '"ok"' END || ', "user": ' || user_id || '}'"""


def _fields():
    return {"user": F.col("user_id"), "endpoint": F.col("event_type"), "status": F.when(F.col("event_id") % 3 != 0, "ok")}


@query(
    "WITH RECURSIVE e AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r FROM events), "
    f"h AS (SELECT user_id, CAST(0 AS BIGINT) AS r, CAST(-1 AS BIGINT) AS event_id, '' AS previous_audit_hash, '{'0' * 64}' AS audit_hash FROM (SELECT DISTINCT user_id FROM events) "
    f"UNION ALL SELECT h.user_id, e.r, e.event_id, h.audit_hash, sha256({ENTRY.replace('{0}', 'h.audit_hash').replace('event_type', 'e.event_type').replace('event_id', 'e.event_id').replace('|| user_id', '|| e.user_id')}) FROM h JOIN e ON e.user_id = h.user_id AND e.r = h.r + 1) "
    "SELECT user_id, event_id, previous_audit_hash, audit_hash FROM h WHERE r > 0"
)
def hash_chain_build(spark, sf_dir):
    """Each user's entries as JSON with sorted keys, chained."""
    return oplog.hash_chain(table(spark, sf_dir, "events"), "user_id", "event_id", _fields()).drop("n")


@query(ORACLE["hash_chain_build"].replace("SELECT user_id, event_id, previous_audit_hash", "SELECT user_id, event_id, r AS n, previous_audit_hash"))
def hash_chain_appended(spark, sf_dir):
    """The events' log written in three appends, of which the second is tried twice: chains go on from their heads."""
    e = table(spark, sf_dir, "events")
    low, high = e.approxQuantile("event_id", [1 / 3, 2 / 3], 0.01)
    root = f"{shared_dir(spark)}/corpusflow-chain-{uuid.uuid4().hex[:12]}"
    parts = (F.col("event_id") <= low, (F.col("event_id") > low) & (F.col("event_id") <= high), F.col("event_id") > high)
    for batch in (0, 1, 1, 2):
        chain.append(e.where(parts[batch]), "user_id", "event_id", _fields(), root, batch)
    return chain.entries(spark, root).select("user_id", "event_id", "n", "previous_audit_hash", "audit_hash")


@query("SELECT user_id, count(*) AS n, count(*) AS n_ok FROM events GROUP BY user_id")
def hash_chain_verify(spark, sf_dir):
    """All entries of the chains checked at once."""
    e = table(spark, sf_dir, "events")
    entries = e.join(oplog.hash_chain(e, "user_id", "event_id", _fields()), ["user_id", "event_id"])
    return oplog.verify_chain(entries, "user_id", "event_id", _fields()).groupBy("user_id").agg(F.count("*").alias("n"), F.count_if("ok").alias("n_ok"))


@query("SELECT user_id, count(*) AS n, max(ts) AS last_activity FROM events WHERE event_type <> 'error' GROUP BY user_id")
def session_activity(spark, sf_dir):
    """Sessions touched by their messages."""
    e = table(spark, sf_dir, "events").where("event_type <> 'error'")
    s = e.groupBy(F.col("user_id").alias("session_id")).agg(F.count("*").alias("n"), F.min("ts").alias("last_activity"))
    out = sinks.touched(s, e.select(F.col("user_id").alias("session_id"), F.col("ts").alias("timestamp")))
    return out.select(F.col("session_id").alias("user_id"), "n", "last_activity")


@query(
    "SELECT event_id, status, query_hash, docs_found, bm25_active FROM (SELECT event_id, CASE event_type WHEN 'error' THEN 'error' WHEN 'signup' THEN "
    "'blocked' ELSE 'success' END AS status, substr(sha256(props), 1, 16) AS query_hash, CASE WHEN event_id % 2 = 0 THEN event_id % 9 ELSE 0 END AS "
    "docs_found, event_id % 3 = 0 AS bm25_active FROM events)"
)
def audit_rows(spark, sf_dir):
    """Events as rows of an audit log."""
    e = table(spark, sf_dir, "events")
    status = F.when(F.col("event_type") == "error", "error").when(F.col("event_type") == "signup", "blocked").otherwise("success")
    found = F.when(F.col("event_id") % 2 == 0, F.col("event_id") % 9)
    rows = e.select("event_id", F.col("ts").alias("timestamp"), F.lit("chat").alias("endpoint"), status.alias("status"), F.col("value").alias("latency"), F.col("props").alias("question"), F.col("event_id").alias("answer_mode"), found.alias("docs_found"), (F.col("event_id") % 3 == 0).alias("lexical"))
    return sinks.audit_rows(rows).select(F.col("answer_mode").alias("event_id"), "status", "query_hash", "docs_found", "bm25_active")


@query(
    """WITH o AS (SELECT o_orderkey AS k, o_orderstatus AS v FROM orders WHERE o_orderkey % 3 <> 0), n AS (SELECT o_orderkey AS k, o_orderpriority AS v FROM orders WHERE o_orderkey % 2 = 0)
    SELECT k, v FROM n UNION ALL SELECT k, v FROM o WHERE k NOT IN (SELECT k FROM n)"""
)
def upsert_latest(spark, sf_dir):
    """New rows in place of old ones of their keys."""
    o = table(spark, sf_dir, "orders")
    old = o.where("o_orderkey % 3 <> 0").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("v"))
    return sinks.upsert(old, o.where("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("k"), F.col("o_orderpriority").alias("v")), "k")


@query("SELECT k FROM (SELECT o_orderkey AS k FROM orders WHERE o_orderkey % 3 = 0 UNION SELECT o_orderkey FROM orders WHERE o_orderkey % 2 = 0)")
def append_skip(spark, sf_dir):
    """Records that are there already are skipped."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"))
    return sinks.append_new(o.where("k % 3 = 0"), o.where("k % 2 = 0"), "k")


@query("SELECT 'v' || (max(CAST(substr(t, 2, strpos(t, '_') - 2) AS INTEGER)) + 1) AS tag FROM (SELECT 'v' || (doc_id % 13) || '_2024' AS t FROM documents)")
def version_next(spark, sf_dir):
    tags = table(spark, sf_dir, "documents").select(F.concat(F.lit("v"), (F.col("doc_id") % 13).cast("string"), F.lit("_2024")).alias("t"))
    return tags.agg(F.concat(F.lit("v"), sinks.next_version(F.col("t")).cast("string")).alias("tag"))


@query(
    "SELECT coalesce(CASE WHEN doc_id % 4 = 0 THEN NULL ELSE lang END, 'unknown') AS source_type, count(*) AS n, count(*) FILTER (WHERE page_number IS "
    "NULL) AS no_page FROM (SELECT *, CASE WHEN doc_id % 2 = 0 THEN doc_id END AS page_number FROM documents) GROUP BY 1"
)
def manifest_stats(spark, sf_dir):
    """Passages normalised before they are written, counted as a manifest does."""
    d = table(spark, sf_dir, "documents").select(F.when(F.col("doc_id") % 4 != 0, F.col("lang")).alias("source_type"), F.when(F.col("doc_id") % 2 == 0, F.col("doc_id")).alias("page_number"))
    return sinks.normalized(d).groupBy("source_type").agg(F.count("*").alias("n"), F.count_if(F.col("page_number").isNull()).alias("no_page"))


@query(
    "SELECT doc_id, source || CASE WHEN doc_id % 2 = 0 THEN '::p' || (doc_id % 50) ELSE '' END AS page_id, coalesce(nullif(trim(CASE WHEN doc_id % 3 = 0 THEN '' ELSE lang END), ''), source) AS first_present, "
    "lower(regexp_extract('a/b.c/' || source || '.PDF', '[^.](\\.[^.]+)$', 1)) AS extension, source || '.PDF' AS basename FROM documents"
)
def metadata_fields(spark, sf_dir):
    """Ids of pages, first present values, names and extensions of paths."""
    d = F.col("doc_id")
    path = F.concat(F.lit("a/b.c/"), F.col("source"), F.lit(".PDF"))
    none = F.lit(None).cast("string")
    return table(spark, sf_dir, "documents").select(
        "doc_id", text.page_id(F.col("source"), none, none, F.when(d % 2 == 0, d % 50)).alias("page_id"), text.first_present(F.when(d % 3 != 0, F.col("lang")).otherwise(""), F.col("source")).alias("first_present"),
        text.extension(path).alias("extension"), text.basename(path).alias("basename"),
    )


@query("""SELECT doc_id, 'en, fr' AS langs, lang, CASE WHEN doc_id % 2 = 0 THEN 'new' ELSE 'old' END AS origin FROM documents""")
def metadata_maps(spark, sf_dir):
    """Metadata flattened to texts, and merged, the last entry of a key."""
    made = text.flat({"langs": F.array(F.lit("en"), F.lit("fr")), "lang": F.col("lang"), "none": F.lit(None).cast("string")}, {"langs": "list"})
    base = F.create_map(F.lit("origin"), F.lit("old"))
    over_ = F.map_filter(F.create_map(F.lit("origin"), F.lit("new")), lambda _, v: F.col("doc_id") % 2 == 0)
    m = text.merged(made, base, over_)
    return table(spark, sf_dir, "documents").select("doc_id", m["langs"].alias("langs"), m["lang"].alias("lang"), m["origin"].alias("origin"))


@query("SELECT conv_id, count(*) AS n FROM conversations c WHERE EXISTS (SELECT 1 FROM documents d WHERE d.doc_id = c.conv_id AND d.lang = 'en') GROUP BY conv_id")
def session_exists(spark, sf_dir):
    """Messages of sessions that are known; documents in English stand for these."""
    known = table(spark, sf_dir, "documents").where("lang = 'en'").select(F.col("doc_id").alias("conv_id"))
    return table(spark, sf_dir, "conversations").join(known, "conv_id", "left_semi").groupBy("conv_id").agg(F.count("*").alias("n"))


@query(
    """WITH v AS (SELECT event_type, event_id AS version, ts AS valid_from, lead(ts) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS valid_to FROM events WHERE event_id % 50 = 0)
    SELECT e.event_id, v.version FROM events e LEFT JOIN v ON v.event_type = e.event_type AND e.ts >= v.valid_from AND (v.valid_to IS NULL OR e.ts < v.valid_to)"""
)
def valid_version(spark, sf_dir):
    """The version in force at each event's time, carried along ranges of time."""
    e = table(spark, sf_dir, "events").select("event_type", "event_id", "ts")
    versions = e.where("event_id % 50 = 0").select("event_type", "ts", F.col("event_id").alias("version"))
    return carry.valid_version(e, versions, "event_type", "ts", "version").select("event_id", "version")


@query("SELECT DISTINCT sha256(coalesce(text, '')) AS sha256 FROM documents")
def indexed_digests(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha256")).distinct()


@query(
    "SELECT concept, count(*) AS n FROM (SELECT DISTINCT d.doc_id, l.concept FROM documents d JOIN (VALUES ('A', 'that'), ('A', 'then'), ('B', 'dans'), "
    "('C', 'nicht')) l(concept, word) ON list_contains(string_split(lower(d.text), ' '), l.word)) GROUP BY concept"
)
def lexicon_join(spark, sf_dir):
    """A lexicon that is a table: words of texts joined with it."""
    names = spark.createDataFrame([("A", "that"), ("A", "then"), ("B", "dans"), ("C", "nicht")], "concept string, word string")
    words = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.array_distinct(F.split(F.lower("text"), " "))).alias("word"))
    return words.join(names, "word").select("doc_id", "concept").distinct().groupBy("concept").agg(F.count("*").alias("n"))
