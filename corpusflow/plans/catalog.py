"""The queries of the library and their DuckDB equivalents, by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import classify, text
from ..operators import align, chunking, evaluate, expansion, oplog, retrieval
from ..sources import docx
from ..sources.scratch import saved
from . import expected as E
from .registry import ORACLE, QUERIES, over_documents, query, spread, table

WORDS, NORM, TOKENS = E.WORDS, E.NORM, E.TOKENS

over_documents("text_normalize", f"{NORM} AS norm, {WORDS} AS words", norm=text.normalize, words=text.word_count)
over_documents("bm25_tokens", f"{E.LEX} AS lexical, len({TOKENS})::BIGINT AS n_tokens", lexical=text.lexical, n_tokens=lambda t: F.size(text.tokens(t)).cast("long"))
over_documents("keyword_set", f"list_sort({E.KEYWORDS}) AS keywords", keywords=lambda t: F.sort_array(text.keywords(t)))
CLEANED = E.STRIP.format(
    r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text,
    '[\x00-\x08\x0b\x0c\x0e-\x1f]', '', 'g'), '\n\s*\n\s*\n+', chr(10) || chr(10), 'g'), ' {{3,}}', ' ', 'g'), '(?m)^\s*\d{{1,3}}\s*$', '', 'g'),
    '(?mi)^\s*PAG\.?\s*$', '', 'g'), '(?m)^[\s_\-=]{{5,}}$', '', 'g'), '\t{{2,}}', ' ', 'g')""".replace("{{", "{").replace("}}", "}")
)
over_documents("clean_text", f"{CLEANED} AS cleaned", cleaned=text.clean)
over_documents(
    "fingerprints",
    "sha256(text) AS sha, substr(sha256(text), 1, 16) AS hash16, md5(substr(text, 1, 500)) AS prefix_md5",
    sha=lambda t: F.sha2(t, 256),
    hash16=text.hash16,
    prefix_md5=lambda t: F.md5(F.substring(t, 1, 500)),
)
over_documents(
    "extract_emails_urls",
    f"list_sort(list_distinct(regexp_extract_all(text, {E.quoted(E.EMAIL)}))) AS emails, list_sort(list_distinct(regexp_extract_all(text, {E.quoted(E.LINK)}))) AS urls",
    emails=lambda t: F.sort_array(text.emails(t)),
    urls=lambda t: F.sort_array(text.urls(t)),
)
over_documents("temporal_values", f"list_sort({E.times('text')}) AS times", times=lambda t: F.sort_array(text.times(t)))
over_documents("pii_redact_input", E.masked("text", E.PII_INPUT) + " AS redacted", redacted=text.redact_input)
over_documents("pii_redact_log", E.masked("text", E.PII_LOG) + " AS redacted", redacted=text.redact_log)
over_documents("safety_flags", f"{E.has_pii('text')} AS pii, {E.injected('text')} AS injection", pii=text.has_pii, injection=text.has_injection)
over_documents("role_classify", f"{E.role('text')} AS role", role=classify.role)
JT = E.STRIP.format("lower(text)")
over_documents(
    "junk_filter",
    f"(len({JT}) < 20 OR (regexp_matches({JT}, {E.quoted('(?i)' + '|'.join(E.JUNK))}) AND {WORDS} < 15) OR ({E.any_of(JT, ['http://', 'https://', '.pdf'])} AND {WORDS} < 20)"
    rf" OR len(regexp_replace({JT}, '[^\p{{L}}]', '', 'g')) / greatest(len({JT}), 1) < 0.4) AS junk, {WORDS} >= 30 AS long_enough",
    junk=classify.is_junk,
    long_enough=lambda t: text.word_count(t) >= 30,
)
over_documents("url_free_preview", "substr(text, 1, 150) AS preview, text[1:50] AS head", preview=lambda t: F.substring(t, 1, 150), head=lambda t: F.substring(t, 1, 50))


@query(
    "SELECT source, CASE WHEN contains(source, 'faq') THEN 'faq' WHEN contains(source, 'vis') OR contains(source, 'scheda') OR contains(source, 'guida') "
    "THEN 'visual_guide' ELSE 'text_document' END AS source_type, count(*) AS n, min(n_chars) AS least, max(n_chars) AS most, CAST(floor(avg(n_chars)) AS "
    "BIGINT) AS mean_chars FROM documents GROUP BY ALL"
)
def source_profile(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.groupBy("source", classify.source_type(F.col("source")).alias("source_type")).agg(F.count("*").alias("n"), F.min("n_chars").alias("least"), F.max("n_chars").alias("most"), F.floor(F.avg("n_chars")).alias("mean_chars"))


ISSUES = f"""CASE WHEN text IS NULL OR text = '' THEN ['Chiave mancante o nulla: text_content'] || CASE WHEN source IS NULL THEN ['Metadata mancante: source_type'] ELSE [] END
      WHEN source IS NULL THEN ['Metadata mancante: source_type']
      ELSE CASE WHEN len(text) < 50 THEN ['Testo troppo breve (' || len(text) || ' chars).'] ELSE [] END
        || list_transform(list_filter({E.sql_list(E.REFUSALS)}, lambda p: contains(lower(text), p))[1:1], lambda p: 'Rifiuto LLM rilevato: ''' || p || '''') END"""


def _validated(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    chunks = d.select(F.col("doc_id").alias("chunk_id"), F.col("doc_id").alias("parent_doc_id"), F.col("text").alias("text_content"), F.col("source").alias("source_type"), F.lit("").alias("web_section"))
    return classify.validated(chunks)


@query(f"SELECT doc_id, {ISSUES} AS issues, substr(coalesce(text, ''), 1, 50) AS preview FROM documents WHERE len({ISSUES}) > 0")
def validate_rejected(spark, sf_dir):
    """Rejected passages with why and a preview."""
    return _validated(spark, sf_dir).where(F.size("issues") > 0).select(F.col("chunk_id").alias("doc_id"), "issues", "preview")


BOXES = "(len(text) - len(replace(text, '{0}', ''))) / {1} > 3"
CATEGORY = (
    "CASE WHEN source = 'web_page' THEN 'web_content' WHEN contains(lower(text), 'sanzione') AND (contains(lower(text), 'euro') OR contains(text, '€')) THEN 'sanctions_table' "
    f"WHEN {BOXES.format('[ ]', 3)} OR {BOXES.format('☐', 1)} THEN 'checklist' WHEN source = 'faq' OR {E.any_of('lower(text)', ['significa', 'definizione'])} THEN 'glossary' "
    f"WHEN {E.any_of('lower(text)', ['cliccare', 'selezionare', 'accedere'])} THEN 'procedural' ELSE 'other' END"
)


@query(rf"""SELECT doc_id, {CATEGORY} AS chunk_category, regexp_matches(text, '[A-Z]{{6}}\d{{2}}[A-Z]\d{{2}}[A-Z]\d{{3}}[A-Z]') AS pii_warning FROM documents WHERE len({ISSUES}) = 0""")
def validate_accepted(spark, sf_dir):
    """Valid passages with their category and the flag of a tax number."""
    return _validated(spark, sf_dir).where(F.size("issues") == 0).select(F.col("chunk_id").alias("doc_id"), "chunk_category", "pii_warning")


@query(
    f"SELECT CASE WHEN len({ISSUES}) = 0 THEN 'valid' WHEN text IS NULL OR text = '' OR source IS NULL THEN 'broken' ELSE 'rejected' END AS verdict, "
    f"count(*) AS n FROM documents GROUP BY 1"
)
def validate_split(spark, sf_dir):
    d = _validated(spark, sf_dir)
    broken = F.exists("issues", lambda i: i.contains("mancante"))
    return d.groupBy(F.when(broken, "broken").when(F.size("issues") > 0, "rejected").otherwise("valid").alias("verdict")).agg(F.count("*").alias("n"))


@query("SELECT doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY substr(text, 1, 500) ORDER BY doc_id) = 1")
def dedup_prefix500(spark, sf_dir):
    return retrieval.dedup_prefix(table(spark, sf_dir, "documents"), F.md5(F.substring("text", 1, 500)), [F.col("doc_id")]).select("doc_id")


@query(
    f"SELECT doc_id, source FROM documents QUALIFY row_number() OVER (PARTITION BY md5(substr({NORM}, 1, 500)) ORDER BY CASE WHEN source = 'src0' THEN 0 "
    f"ELSE 1 END, doc_id) = 1"
)
def union_priority_dedup(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    first, rest = d.where("source = 'src0'").withColumn("priority", F.lit(0)), d.where("source is null or source <> 'src0'").withColumn("priority", F.lit(1))
    both = first.unionByName(rest)
    return retrieval.dedup_prefix(both, F.md5(F.substring(text.normalize(F.col("text")), 1, 500)), [F.col("priority"), F.col("doc_id")]).select("doc_id", "source")


@query(
    "SELECT doc_id, i AS idx, substr(text, i * 1700 + 1, 2000) AS passage FROM (SELECT doc_id, text, unnest(range(0, greatest(CAST(ceil((len(text) - 300) "
    "/ 1700) AS BIGINT) - 1, 0) + 1)) AS i FROM documents)"
)
def chunk_fixed_stride(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.inline(chunking.fixed_stride(F.col("text"), 2000, 300)))


@query()
def chunk_recursive(spark, sf_dir):
    return chunking.chunk_documents(table(spark, sf_dir, "documents"), "doc_id", "text")


@query()
def term_stats(spark, sf_dir):
    return retrieval.term_stats(retrieval.postings(table(spark, sf_dir, "documents"), "doc_id", "text"))


ORACLE["term_stats"] = f"SELECT term, count(*) AS df, sum(tf)::BIGINT AS cf FROM (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({TOKENS}) AS term FROM documents) GROUP BY doc_id, term) GROUP BY term"


def _questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query"), "text")


def _bm25(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    return retrieval.bm25_top(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), _questions(spark, sf_dir), k)


def _candidates(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    """The k best of each question by words, written: few rows, whose size Spark then knows when it joins them with texts, so the texts stay where they are."""
    return saved(_bm25(spark, sf_dir, k))


RANKED = "row_number() OVER (PARTITION BY query ORDER BY round(score, 6) DESC, id) AS rank"


def sql_top(k: int) -> str:
    return f"{E.bm25()}, t AS (SELECT query, id, score, {RANKED} FROM s QUALIFY rank <= {k})"


@query(f"WITH {sql_top(10)} SELECT query, id, rank, round(score, 4) AS score FROM t")
def bm25_topk(spark, sf_dir):
    return _bm25(spark, sf_dir, 10).select("query", "id", F.col("rank").cast("long").alias("rank"), F.round("score", 4).alias("score"))


FOLDED = r"list_filter(regexp_split_to_array(strip_accents(lower(coalesce(text, ''))), '[^\p{L}\p{N}]+'), lambda w: w <> '')"


@query(
    f"""WITH w AS (SELECT doc_id AS id, {FOLDED} AS w FROM documents),
    p AS (SELECT id, dl, term, count(*) AS tf FROM (SELECT id, len(w) AS dl, unnest(w) AS term FROM w) GROUP BY ALL),
    c AS (SELECT count(*) AS n, avg(len(w)) AS avgdl FROM w),
    q AS (SELECT query, term, count(*) AS times FROM (SELECT item_id AS query, unnest({FOLDED}) AS term FROM benchmark) GROUP BY ALL),
    i AS (SELECT term, greatest(ln((n - count(*) + 0.5) / (count(*) + 0.5)), 1e-6) AS idf FROM p, c GROUP BY term, n),
    s AS (SELECT query, id, sum(idf * times * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * dl / avgdl))) AS score, count(*) AS held
          FROM p JOIN i USING (term) JOIN q USING (term), c GROUP BY query, id)
    SELECT query, id, {RANKED}, round(-score, 4) AS fts_rank FROM s WHERE held = (SELECT count(*) FROM q z WHERE z.query = s.query) QUALIFY rank <= 15"""
)
def fts_topk(spark, sf_dir):
    """Full-text search: documents with all of a question's terms."""
    found = retrieval.full_text(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), _questions(spark, sf_dir))
    return found.select("query", "id", F.col("rank").cast("long").alias("rank"), F.round("fts_rank", 4).alias("fts_rank"))


HELD = "e AS (SELECT item_id AS query, doc_id AS id FROM benchmark b JOIN documents d ON contains(d.text, b.text))"


def _held(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query, id): documents that hold the whole passage of an item.

    They share its first eight words as a shingle; that equality joins, then `contains` decides. A passage of fewer words is
    a shingle of all of them."""
    words = lambda c: F.filter(F.split(c, r"\s+"), lambda w: w != "")
    items = _questions(spark, sf_dir).withColumn("w", words(F.col("text")))
    # the passage's first and last word may be part of a longer one in the document
    inner = F.slice("w", 2, 8)
    items = items.where(F.size("w") >= 10).select("query", F.col("text").alias("passage"), F.xxhash64(F.array_join(inner, " ")).alias("key"))
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text").withColumn("w", words(F.col("text"))).where(F.size("w") >= 8)
    grams = F.transform(F.sequence(F.lit(1), F.size("w") - 7), lambda i: F.xxhash64(F.array_join(F.slice("w", i, 8), " ")))
    # ids and shingles alone are joined; texts only for what meets
    met = saved(d.select("id", F.explode(grams).alias("key")).join(items.select("key", "query"), "key").select("id", "query").distinct())
    long = met.join(d.select("id", "text"), "id").join(items.select("query", "passage"), "query").where(F.contains("text", F.col("passage"))).select("query", "id")
    short = _questions(spark, sf_dir).where(F.size(words(F.col("text"))) < 10)
    few = short.limit(10_001).count()  # passages without eight whole words inside are compared with every text
    if few == 0:
        return long
    rest = F.broadcast(short) if few <= 10_000 else short
    return long.unionByName(d.select("id", F.col("text").alias("t")).join(rest, F.contains(F.col("t"), F.col("text"))).select("query", "id"))


@query(
    f"""WITH {sql_top(10)}, {HELD}, r AS (SELECT query, count(*) AS retrieved FROM t GROUP BY query),
    h AS (SELECT e.query, count(*) AS relevant, count(t.id) AS found, min(t.rank) AS first, any_value(retrieved) AS retrieved FROM e LEFT
      JOIN t USING (query, id) LEFT JOIN r USING (query) GROUP BY e.query)
    SELECT count(*) AS n, round(avg(found / relevant), 6) AS recall_at_10, round(avg(coalesce(found / retrieved, 0)), 6) AS precision_at_10,
      round(avg(coalesce(1.0 / first, 0)), 6) AS mrr, round(avg(CASE WHEN first <= 1 THEN 1.0 ELSE 0 END), 6) AS hit_1 FROM h"""
)
def retrieval_metrics(spark, sf_dir):
    """Recall, precision by what was retrieved, reciprocal rank of BM25 against the documents that hold the passage."""
    top = _bm25(spark, sf_dir, 10).select("query", "id", "rank")
    got = top.groupBy("query").agg(F.count("*").alias("retrieved"))
    per = _held(spark, sf_dir).join(top, ["query", "id"], "left").groupBy("query").agg(F.count("*").alias("relevant"), F.count("rank").alias("found"), F.min("rank").alias("first")).join(got, "query", "left")
    return per.agg(
        F.count("*").alias("n"),
        F.round(F.avg(F.col("found") / F.col("relevant")), 6).alias("recall_at_10"),
        F.round(F.avg(F.coalesce(F.col("found") / F.col("retrieved"), F.lit(0.0))), 6).alias("precision_at_10"),
        F.round(F.avg(F.coalesce(1.0 / F.col("first"), F.lit(0.0))), 6).alias("mrr"),
        F.round(F.avg(F.when(F.col("first") <= 1, 1.0).otherwise(0.0)), 6).alias("hit_1"),
    )


@query(
    f"""WITH {sql_top(10)}, {HELD}, f AS (SELECT b.item_id, (SELECT min(rank) FROM t JOIN e USING (query, id) WHERE query = b.item_id) AS r FROM benchmark b)
    SELECT round(avg(CASE WHEN r <= 1 THEN 1 ELSE 0 END), 4) AS recall_at_1, round(avg(CASE WHEN r <= 1 THEN 1.0 / r ELSE 0 END), 4) AS mrr_at_1,
      round(avg(CASE WHEN r <= 5 THEN 1 ELSE 0 END), 4) AS recall_at_5, round(avg(CASE WHEN r <= 5 THEN 1.0 / r ELSE 0 END), 4) AS mrr_at_5,
      round(avg(CASE WHEN r <= 10 THEN 1 ELSE 0 END), 4) AS coverage_at_10, count(*) AS total_queries FROM f"""
)
def rank_metrics(spark, sf_dir):
    """Hit rate and reciprocal rank at 1 and 5, coverage at 10, over all items."""
    found = _bm25(spark, sf_dir, 10).join(_held(spark, sf_dir), ["query", "id"]).groupBy("query").agg(F.min("rank").cast("long").alias("r"))
    return evaluate.rank_summary(_questions(spark, sf_dir).join(found, "query", "left"), "r", [1, 5], 10)


DIST = "list_sum(list_transform(range(1, len(v.embedding) + 1), lambda i: (v.embedding[i]::DOUBLE - q.embedding[i]::DOUBLE) * (v.embedding[i]::DOUBLE - q.embedding[i]::DOUBLE)))"


@query(
    f"""WITH k AS (SELECT q.vec_id AS query, v.vec_id AS id, {DIST} AS distance FROM embeddings v, embeddings q WHERE q.vec_id % 50 = 0)
    SELECT query, id, round(distance, 5) AS distance, row_number() OVER (PARTITION BY query ORDER BY round(distance, 6), id) AS rank FROM k QUALIFY rank <= 10"""
)
def knn_l2(spark, sf_dir):
    """The ten nearest of every row whose id is divisible by 50, among all rows."""
    v = table(spark, sf_dir, "embeddings")
    asked = v.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query"), F.col("embedding").alias("vec"))
    return retrieval.nearest(v, asked, 10, "vec_id", "embedding").select("query", "id", F.round("distance", 5).alias("distance"), F.col("rank").cast("long").alias("rank"))


def sql_vector(t: str) -> str:
    """The counts of 64 buckets of words by md5, of length 1, out of a table with tokens w."""
    return f"""(SELECT *, list_transform(c, lambda x: CASE WHEN z > 0 THEN x / z ELSE x END) AS vec FROM (SELECT *, sqrt(list_sum(list_transform(c, lambda x: x * x))) AS z FROM
      (SELECT *, list_transform(range(64), lambda i: len(list_filter(w, lambda x: CAST('0x' || substr(md5(x), 1, 4) AS INTEGER) % 64 = i))::DOUBLE) AS c FROM {t})))"""


LOCAL_CONCEPTS = [("THAN", ["than", "then"]), ("DANS", ["dans"]), ("NICHT", ["nicht"]), ("POUR", ["pour", "avec"])]
SQL_CONCEPTS = "list_filter([" + ", ".join(f"CASE WHEN {E.any_of('lower(coalesce(text, {0}))'.format(chr(39) * 2), words)} THEN '{name}' END" for name, words in LOCAL_CONCEPTS) + "], lambda x: x IS NOT NULL)"


@query(
    f"""WITH {sql_top(40)}, dv AS (SELECT doc_id AS id, vec FROM {sql_vector(f"(SELECT doc_id, {TOKENS} AS w FROM documents)")}),
    qv AS (SELECT item_id AS query, vec FROM {sql_vector(f"(SELECT item_id, {TOKENS} AS w FROM benchmark)")}),
    k AS (SELECT query, id, list_sum(list_transform(range(1, 65), lambda i: (dv.vec[i] - qv.vec[i]) * (dv.vec[i] - qv.vec[i]))) AS distance FROM dv, qv),
    n AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(distance, 6), id) AS rank FROM k QUALIFY rank <= 40),
    u AS (SELECT query, id, 1 / (1 + distance) AS x FROM n UNION ALL SELECT query, id, 0.6 / rank FROM t), g AS (SELECT query, id, sum(x) AS score
      FROM u GROUP BY query, id),
    d AS (SELECT doc_id AS id, {E.role('text')} AS role, {WORDS} AS words, {SQL_CONCEPTS} AS concepts FROM documents),
    a AS (SELECT item_id AS query, {NORM} AS ql, CASE WHEN {E.any_of(NORM, E.SERVICE)} THEN 12 ELSE 8 END AS k FROM benchmark),
    r AS (SELECT query, id, k, score * CASE WHEN role IN ('mandatory_rule', 'access_rule', 'service_mapping', 'contact_rule') THEN 1.3 ELSE 1.0 END
      * CASE WHEN len(list_filter(concepts, lambda c: contains(ql, lower(c)))) >= 2 THEN 1.1 WHEN len(list_filter(concepts, lambda c: contains(ql,
        lower(c)))) = 1 THEN 1.05 ELSE 1.0 END
      * CASE WHEN words > 700 AND role = 'descriptive' THEN 0.9 ELSE 1.0 END AS score FROM g JOIN d USING (id) JOIN a USING (query))
    SELECT query, id, round(score, 5) AS score, {RANKED} FROM r QUALIFY rank <= k"""
)
def hybrid_fuse(spark, sf_dir):
    """Forty candidates each by vector and by words, summed, reranked by role, concepts and length; 8 or 12 by the question. Texts are split
    once; roles and concepts are told of the candidates alone."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    asked = _questions(spark, sf_dir)
    split = lambda t, c: t.select(c, text.tokens(F.col("text")).alias("text"))
    words, terms = spread(saved(split(docs, "doc_id"))), split(asked, "query")
    body = F.col("text")
    vectors = lambda t, c: t.select(c, retrieval.embedded(body).alias("vec"))
    near = saved(retrieval.nearest(vectors(words, "doc_id"), vectors(terms, "query"), 40, "doc_id", "vec"))
    lexical = saved(retrieval.bm25_top(words, terms, 40, split=lambda c: c))
    ids = near.select("id").unionByName(lexical.select("id")).distinct()  # at most 80 for each question
    found = docs.withColumnRenamed("doc_id", "id").join(ids, "id", "left_semi")
    passages = found.select("id", classify.role(body).alias("role"), text.word_count(body).alias("words"), text.concepts(body, LOCAL_CONCEPTS, False).alias("concepts"))
    questions = asked.withColumnRenamed("text", "question")
    out = retrieval.hybrid(near, lexical, passages, questions, classify.depth(F.col("question")))
    return out.select("query", "id", F.round("score", 5).alias("score"), F.col("rank").cast("long").alias("rank"))


@query(
    f"""WITH {sql_top(40)}, a AS (SELECT t.*, d.text FROM t JOIN documents d ON t.id = d.doc_id),
    r AS (SELECT query, id, score * CASE WHEN ({E.role('text')}) = 'mandatory_rule' THEN 1.3 ELSE 1.0 END * CASE WHEN {WORDS} > 700
      AND ({E.role('text')}) = 'descriptive' THEN 0.9 ELSE 1.0 END AS score FROM a)
    SELECT query, id, {RANKED}, round(score, 4) AS score FROM r QUALIFY rank <= 8"""
)
def rerank_boost(spark, sf_dir):
    """The forty best by words, reranked by role and length."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), classify.role(F.col("text")).alias("role"), text.word_count(F.col("text")).alias("words"))
    scored = _candidates(spark, sf_dir, 40).drop("rank").join(d, "id").withColumn("score", retrieval.rerank(F.col("score"), F.col("role"), F.col("words")))
    return retrieval.top_k(scored, 8).select("query", "id", F.col("rank").cast("long").alias("rank"), F.round("score", 4).alias("score"))


@query(f"SELECT conv_id, turn, {E.intent('text')} AS intent FROM conversations WHERE role = 'user'")
def intent_classify(spark, sf_dir):
    return table(spark, sf_dir, "conversations").where("role = 'user'").select("conv_id", "turn", classify.intent(F.col("text")).alias("intent"))


@query("SELECT conv_id, turn, role FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 5")
def session_history_last5(spark, sf_dir):
    return oplog.last_n(table(spark, sf_dir, "conversations"), "conv_id", "turn", 5).select("conv_id", "turn", "role")


@query(
    "SELECT event_type, count(*) AS total, count(*) FILTER (WHERE event_type = 'error') AS errors, round(avg(value), 4) AS avg_value, round(max(value), 4) "
    "AS max_value FROM events GROUP BY event_type"
)
def audit_by_type(spark, sf_dir):
    return oplog.audit_stats(table(spark, sf_dir, "events"), "event_type")


@query("SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def latest_per_user(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("event_id"))


@query(
    "WITH a AS (SELECT *, CASE WHEN epoch(ts) - lag(epoch(ts)) OVER (PARTITION BY user_id ORDER BY epoch(ts), event_id) > 1800 THEN 1 ELSE 0 END AS new FROM events), "
    "b AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY epoch(ts), event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS session FROM a) SELECT user_id, session, count(*) AS n, min(event_id) AS first_event FROM b GROUP BY user_id, session"
)
def session_windows(spark, sf_dir):
    return oplog.sessions(table(spark, sf_dir, "events"), "user_id", "ts", 1800)


@query("SELECT d.doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def anti_new_docs(spark, sf_dir):
    return table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left_anti").select("doc_id")


@query("SELECT d.doc_id, coalesce(CAST(l.quality AS VARCHAR), 'unknown') AS quality FROM documents d LEFT JOIN labels l USING (doc_id)")
def left_default(spark, sf_dir):
    return table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left").select("doc_id", F.coalesce(F.col("quality").cast("string"), F.lit("unknown")).alias("quality"))


@query(
    "SELECT a.l_orderkey, a.l_linenumber, count(*) AS near FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber BETWEEN "
    "a.l_linenumber - 1 AND a.l_linenumber + 1 GROUP BY ALL"
)
def band_join(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber")
    wide = li.withColumn("near", F.explode(F.sequence(F.col("l_linenumber") - 1, F.col("l_linenumber") + 1)))
    other = li.withColumnRenamed("l_linenumber", "near")
    return wide.join(other, ["l_orderkey", "near"]).groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("near"))


@query(
    "WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents "
    "WHERE text IS NOT NULL) SELECT doc_id, CAST(pos AS INTEGER) AS pos, last_value(CASE WHEN len(line) < 80 THEN line END IGNORE NULLS) OVER (PARTITION "
    "BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS section FROM l"
)
def fill_forward(spark, sf_dir):
    """The last short line above each line, as a section's heading is carried forward."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    above = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return lines.select("doc_id", "pos", F.last(F.when(F.length("line") < 80, F.col("line")), True).over(above).alias("section"))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def cube_lineitem(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


@query(
    "SELECT n_name, o_orderpriority, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY "
    "ROLLUP (n_name, o_orderpriority)"
)
def rollup_orders(spark, sf_dir):
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return o.rollup("n_name", "o_orderpriority").agg(F.count("*").alias("n"))


@query("SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels EXCEPT SELECT doc_id FROM labels WHERE toxic = 1")
def intersect_except(spark, sf_dir):
    labels = table(spark, sf_dir, "labels")
    return table(spark, sf_dir, "documents").select("doc_id").intersect(labels.select("doc_id")).exceptAll(labels.where("toxic = 1").select("doc_id").distinct())


# --- Expansion, evidence, ensemble
LEXICON = [("than", ["collegare", "abbinare", "registrare"]), ("in", ["dentro", "entro"])]


def _sql_synonyms() -> str:
    arms = " ".join(f"WHEN contains(lower(text), '{t}') THEN [" + ", ".join(f"replace(lower(text), '{t}', '{s}')" for s in syn[:2]) + "]" for t, syn in LEXICON)
    return f"list_transform(CASE {arms} ELSE [] END, lambda x: upper(x[1:1]) || x[2:])"


@query(f"SELECT item_id, list_sort(list_distinct([text] || {_sql_synonyms()} || ['procedura per ' || text, 'come si fa a ' || text])) AS variants FROM benchmark")
def expand_queries(spark, sf_dir):
    variants = expansion.expand(F.col("text"), F.lit("procedural"), LEXICON)
    return table(spark, sf_dir, "benchmark").select("item_id", F.sort_array(variants).alias("variants"))


# --- FAQ paragraphs, citations, verdicts, alignment
@query(
    r"""WITH l AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS pos, regexp_replace(unnest(string_split(replace(text, ',', '?'), chr(10))), '^[ \t\r\n]+|[ \t\r\n]+$', '', 'g') AS t FROM documents WHERE text IS NOT NULL),
    m AS (SELECT *, contains(t, '?') AS q, NOT contains(t, '?') AND upper(t) = t AND lower(t) <> t AND regexp_matches(t,
      '^[^ \t\r\n]+([ \t\r\n]+[^ \t\r\n]+){0,4}$') AS s FROM l WHERE t <> ''),
    b AS (SELECT *, count(*) FILTER (WHERE q OR s) OVER w AS block, coalesce(last_value(CASE WHEN s THEN t END IGNORE NULLS) OVER w,
      'GENERALE') AS section FROM m WINDOW w AS (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING)),
    g AS (SELECT doc_id, block, max(section) AS section, max(t) FILTER (WHERE q) AS question, string_agg(t, ' ' ORDER BY pos) FILTER (WHERE NOT q
      AND NOT s) AS answer FROM b GROUP BY doc_id, block)
    SELECT *, CASE WHEN regexp_matches(question, '(?i)come|dove|quando|quanto') THEN 'procedural' ELSE 'definitional' END AS role FROM g WHERE question IS NOT NULL AND answer IS NOT NULL"""
)
def faq_paragraphs(spark, sf_dir):
    """Lines of documents as FAQ paragraphs; the tables have no question marks, so commas stand for them."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split(F.translate("text", ",", "?"), "\n")).alias("pos", "text"))
    return docx.faq_sections(lines, "doc_id")


@query(
    """WITH c AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda c: trim(c) <> '') AS cs, lower(source) AS src, CAST(doc_id % 100 AS VARCHAR) AS page FROM documents)
    SELECT doc_id, CASE WHEN cs IS NULL OR len(cs) = 0 THEN 1.0 ELSE len(list_filter(cs, lambda c: coalesce(contains(lower(c), page), false) OR coalesce(contains(lower(c), src), false))) / len(cs) END::DOUBLE AS accuracy FROM c"""
)
def citation_accuracy(spark, sf_dir):
    """Each line of a document taken as a citation of its source or of a page."""
    accuracy = evaluate.citation_accuracy(F.split("text", "\n"), F.array(F.col("doc_id") % 100), F.array("source"))
    return table(spark, sf_dir, "documents").select("doc_id", accuracy.alias("accuracy"))


@query(
    "SELECT source, round(avg(CASE WHEN quality = 1 AND toxic = 0 THEN 1.0 WHEN quality = 1 THEN 0.5 ELSE 0.0 END), 9)::DOUBLE AS precision, count(*) AS n "
    "FROM documents JOIN labels USING (doc_id) GROUP BY source"
)
def context_precision(spark, sf_dir):
    """Mean verdict on the labelled documents of a source."""
    said = F.when((F.col("quality") == 1) & (F.col("toxic") == 0), "UTILE").when(F.col("quality") == 1, "PARZIALMENTE_UTILE").otherwise("INUTILE")
    seen = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    return seen.groupBy("source").agg(F.round(F.avg(evaluate.chunk_verdict(said)), 9).alias("precision"), F.count("*").alias("n"))


@query()
def align_pages(spark, sf_dir):
    """Each benchmark passage against the page its number points to and those beside it."""
    pages = table(spark, sf_dir, "documents").groupBy((F.col("doc_id") + 1).alias("page")).agg(F.min("text").alias("text")).withColumn("doc", F.lit(0))
    chunks = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), F.lit(0).alias("doc"), (F.col("item_id") + 1).alias("page"), F.col("text").alias("chunk"))
    return align.align(chunks, pages)


from . import answers, corpus, evaluation, operations, stored  # noqa: E402, F401 (they register their queries)
