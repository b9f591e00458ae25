"""The queries of this subpackage, op1 to op13, and the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import align_tokens, bpe, changes, chat, embed_dedup, exact_dedup, mixing, pii, quality, sharding, simhash, suffix_dedup, warc
from .common import Scratch


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.link_embeddings(table(spark, sf_dir, "embeddings"))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    out = bpe.encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_dedup(table(spark, sf_dir, "documents"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digests(suffix_dedup.remove_repeats(table(spark, sf_dir, "documents")))


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    role = F.when(F.col("id") == 0, "user").otherwise("assistant")
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), role.alias("role"), F.lit(r"\### Assistant: </turn> ok").alias("text"))
    scratch = Scratch(spark, "chat")
    chats = scratch.save(chat.format_chats(turns.unionByName(extra)))
    back = chat.read_back(chats).groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("no", "role", "text", "loss"))).alias("t"))
    turn = F.transform("t", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n")))
    loss = F.array_join("t.loss", "")
    size = chats.select(F.col("conv_id").alias("c"), F.length("formatted").cast("long").alias("formatted_chars"))
    return back.join(size, F.col("conv_id").eqNullSafe(F.col("c"))).select(
        "conv_id",
        F.size("t").cast("long").alias("n_turns"),
        F.sha2(F.array_join(turn, ""), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        "formatted_chars",
    )


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(table(spark, sf_dir, "documents"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents")).drop("n_chunks")


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "warc")
    at = scratch.path()
    warc.write_archives(warc.records(table(spark, sf_dir, "pages")), at)
    found = scratch.save(warc.read_archives(spark, at).select("page_id", "record_type", "payload_digest", "refers_to", F.octet_length("payload").cast("long").alias("n")))
    # a revisit's payload is that of the response it refers to
    first = found.where("record_type = 'response'").select(F.col("page_id").alias("first"), F.col("payload_digest").alias("d"), F.col("n").alias("full")).distinct()
    seen = found.join(first, (F.col("refers_to") == F.col("first")) & (F.col("payload_digest") == F.col("d")), "left")
    return seen.select("page_id", F.coalesce("full", "n").alias("payload_bytes"), "payload_digest", "record_type", "refers_to")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def op11_align_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return align_tokens.align_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op12_apply_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes.apply_changes(table(spark, sf_dir, "client_changes"))


def op13_find_personal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_personal(table(spark, sf_dir, "documents"), pii.fit(pii.labelled(spark)))


QUERIES = {f.__name__: f for f in (op1_nn_descent, op2_bpe, op3_simhash, op4_mixing, op5_suffix_dedup, op6_chat_format, op7_sharding, op8_exact_dedup, op9_warc, op10_quality, op11_align_tokens, op12_apply_changes, op13_find_personal)}

ORACLE = {}

ORACLE["op1_nn_descent"] = """
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a, v b WHERE a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.95
), r AS (
  SELECT vec_id AS node, vec_id AS reached FROM embeddings UNION SELECT r.node, links.b FROM r JOIN links ON r.reached = links.a
)
SELECT vec_id, (SELECT count(*) FROM links WHERE a = vec_id) AS n_links, min(reached) AS component_id, vec_id = min(reached) AS kept
FROM embeddings JOIN r ON node = vec_id GROUP BY vec_id
"""

ORACLE["op4_mixing"] = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5('17:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS at
  FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS r FROM d GROUP BY source
), w AS (
  SELECT source, source_size, CASE r % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS weight, 2.0::DOUBLE * source_size AS cap FROM s
), fill AS (
  SELECT 0 AS round, 0.0::DOUBLE AS level, CAST(-1 AS BIGINT) AS clamped
  UNION ALL
  SELECT round + 1, CASE WHEN rest > 0 THEN (budget - caps) / rest ELSE 1e300 END, n
  FROM (
    SELECT round, clamped,
           (SELECT count(*) FROM w WHERE cap <= level * weight) AS n,
           (SELECT coalesce(sum(cap), 0)::DOUBLE FROM w WHERE cap <= level * weight) AS caps,
           (SELECT coalesce(sum(weight), 0)::DOUBLE FROM w WHERE NOT cap <= level * weight) AS rest,
           (SELECT sum(source_size) * 1.5::DOUBLE FROM w) AS budget
    FROM fill
  ) WHERE n <> clamped AND round < 10000
), lv AS (SELECT level FROM fill ORDER BY round DESC LIMIT 1
), p AS (
  SELECT source, source_size, least(cap, (SELECT level FROM lv) * weight) AS target FROM w
), q AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM p
), r AS (SELECT *, CAST(floor(target + 0.5) AS BIGINT) - whole * source_size AS rest FROM q
), t AS (
  SELECT d.doc_id, d.size, r.source_size, r.target, r.whole, r.rest,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.at, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source
)
SELECT doc_id, size, source_size, target, CAST(whole * size + greatest(0, least(size, rest - before)) AS BIGINT) AS taken,
       whole, CAST(greatest(0, least(size, rest - before)) AS BIGINT) AS extra
FROM t
"""

ORACLE["op6_chat_format"] = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), x AS (
  SELECT *, contains(text, '<turn>') OR contains(text, '</turn>') AS tag, len(text) - len(replace(text, '\', '')) AS bs FROM c
), y AS (
  SELECT *, len(role) + 15 + len(text) + CASE WHEN tag THEN bs + (len(text) - len(replace(text, '</turn>', ''))) // 7 + (len(text) - len(replace(text, '<turn>', ''))) // 6
                                              WHEN regexp_matches(text, '(?s)\\.') THEN bs ELSE 0 END AS n FROM x
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(len(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(n) AS BIGINT) AS formatted_chars
FROM y GROUP BY conv_id
"""

ORACLE["op8_exact_dedup"] = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""

ORACLE["op9_warc"] = (
    """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
x AS (SELECT *, sha1(h) AS s, min(page_id) OVER (PARTITION BY h) AS first FROM p)
SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes, """
    + " || ".join(f"substr('{warc.ALPHABET}', CAST((CAST('0x' || substr(s, {i + 1}, 5) AS INTEGER) >> {k}) & 31 AS INTEGER) + 1, 1)" for i in range(0, 40, 5) for k in (15, 10, 5, 0))
    + """ AS payload_digest,
CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id > first THEN first END AS refers_to
FROM x
"""
)

ORACLE["op12_apply_changes"] = changes.ORACLE_SQL
