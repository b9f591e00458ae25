"""Queries of evaluation: statistics, correlation, critical rows, status, judged answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import classify, lexicon, text
from ..operators import evaluate
from . import expected as E
from .registry import query, table

SCORES = ["quantity", "price", "discount", "tax"]
LONG = "SELECT 'quantity' AS metric, l_quantity AS value FROM lineitem UNION ALL SELECT 'price', l_extendedprice FROM lineitem UNION ALL SELECT 'discount', l_discount FROM lineitem"
BASE = """b AS (SELECT metric, count(*) AS n, avg(value) AS mean, stddev_samp(value) AS std, var_samp(value) AS variance, min(value) AS min, max(value) AS max,
  quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS median, quantile_cont(value, 0.75) AS q3 FROM m GROUP BY metric),
  o AS (SELECT metric, value AS mode FROM (SELECT metric, value, count(*) AS c FROM m GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY metric ORDER BY c DESC, value) = 1)"""


def _metrics(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return li.select(F.expr("stack(3, 'quantity', l_quantity, 'price', l_extendedprice, 'discount', l_discount) AS (metric, value)"))


@query(
    f"""WITH m AS ({LONG}), {BASE}
    SELECT b.metric, b.n, round(b.mean, 4) AS mean, round(median, 4) AS median, round(mode, 4) AS mode, round(b.std, 4) AS std, round(variance,
      2) AS variance, b.min, b.max, round(b.max - b.min, 4) AS range,
    round(q1, 4) AS q1, round(q3, 4) AS q3, round(q3 - q1, 4) AS iqr,
    count(*) FILTER (WHERE value < q1 - 1.5 * (q3 - q1)) AS low_outliers, count(*) FILTER (WHERE value > q3 + 1.5 * (q3 - q1)) AS high_outliers FROM m JOIN b USING (metric) JOIN o USING (metric) GROUP BY ALL"""
)
def metric_stats(spark, sf_dir):
    s = evaluate.statistics(_metrics(spark, sf_dir))
    rounded = [F.round(c, 4).alias(c) for c in ("mean", "median", "mode", "std", "range", "q1", "q3", "iqr")]
    return s.select("metric", "n", *rounded, F.round("variance", 2).alias("variance"), "min", "max", "low_outliers", "high_outliers")


PAIRS = [(a, b) for i, a in enumerate(SCORES) for b in SCORES[i + 1 :]]
COLUMN = {"quantity": "l_quantity", "price": "l_extendedprice", "discount": "l_discount", "tax": "l_tax"}


@query("SELECT " + ", ".join(f"round(corr({COLUMN[a]}, {COLUMN[b]}), 4) AS {a}_vs_{b}" for a, b in PAIRS) + " FROM lineitem")
def metric_corr(spark, sf_dir):
    """Every pair of four columns."""
    li = table(spark, sf_dir, "lineitem").select(*[F.col(COLUMN[c]).alias(c) for c in SCORES])
    return evaluate.correlations(li, SCORES)


# scores of questions: labelled documents with five numbers from their ids and lengths, between 0 and 1, the low ones rare
FIVE = ["groundedness", "self_contained", "relevance", "consistency", "context_precision"]
SQL_SCORES = "SELECT doc_id AS id, " + ", ".join(f"CASE WHEN (doc_id * {p}) % 29 = 0 THEN ((doc_id * {p}) % 11) / 100.0::DOUBLE ELSE 0.6 + ((doc_id * {p}) % 40) / 100.0::DOUBLE END AS {m}" for p, m in zip((7, 11, 13, 17, 19), FIVE, strict=True)) + " FROM labels"


def _scores(spark, sf_dir):
    d = F.col("doc_id")
    value = lambda p: F.when((d * p) % 29 == 0, ((d * p) % 11) / 100.0).otherwise(0.6 + ((d * p) % 40) / 100.0)
    return table(spark, sf_dir, "labels").select(d.alias("id"), *[value(p).alias(m) for p, m in zip((7, 11, 13, 17, 19), FIVE, strict=True)])


SQL_LONG = f"x AS ({SQL_SCORES}), m AS (SELECT id, metric, value FROM x UNPIVOT (value FOR metric IN ({', '.join(FIVE)})))"
FENCES = "q AS (SELECT metric, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM m GROUP BY metric), y AS (SELECT *, q1 - 1.5 * (q3 - q1) AS low, q3 + 1.5 * (q3 - q1) AS high FROM q)"


@query(
    f"WITH {SQL_LONG}, {FENCES} SELECT id, metric, value, CASE WHEN value < low THEN 'low' ELSE 'high' END AS side FROM m JOIN y USING (metric) WHERE value "
    f"< low OR value > high"
)
def metric_outliers(spark, sf_dir):
    """The rows beyond their metric's fences."""
    long = evaluate.long_form(_scores(spark, sf_dir), "id", FIVE)
    return evaluate.outliers(long, evaluate.statistics(long)).select("id", "metric", "value", "side")


ORDERED = "[" + ", ".join(f"'{m}'" for m in FIVE) + "]"


@query(
    f"""WITH {SQL_LONG}, {FENCES}, o AS (SELECT id, metric, value, list_position({ORDERED}, metric) AS p FROM m JOIN y USING (metric) WHERE value < low)
    SELECT id, string_agg(printf('Low %s (%.2f)', metric, value), '; ' ORDER BY p) AS reason, list(metric ORDER BY p) AS affected_metrics, count(*) AS n, CASE WHEN count(*) >= 2 THEN 'high' ELSE 'medium' END AS severity FROM o GROUP BY id"""
)
def critical_rows(spark, sf_dir):
    """Questions with a metric below its low fence, why, and how severe."""
    long = evaluate.long_form(_scores(spark, sf_dir), "id", FIVE)
    return evaluate.by_severity(evaluate.critical(long, evaluate.statistics(long), FIVE))


@query(
    f"""WITH {SQL_LONG}, {FENCES}, s AS (SELECT m.metric, round(avg(value), 4) AS mean, count(*) FILTER (WHERE value < low) AS low FROM m JOIN y USING (metric) GROUP BY m.metric),
    c AS (SELECT count(DISTINCT id) AS n FROM m JOIN y USING (metric) WHERE value < low), h AS (SELECT avg(mean) * 60 AS base, least(sum(low) * 2,
      20)::BIGINT AS o, (SELECT least(n * 3, 20)::BIGINT FROM c) AS k FROM s)
    SELECT round(greatest(0, base - o - k), 2) AS overall_score, CASE WHEN greatest(0, base - o - k) >= 90 THEN 'excellent' WHEN greatest(0,
      base - o - k) >= 75 THEN 'good' WHEN greatest(0, base - o - k) >= 60 THEN 'fair' ELSE 'poor' END AS rating,
      round(base, 2) AS base_score, o AS outlier_penalty, k AS critical_penalty FROM h"""
)
def health_score(spark, sf_dir):
    """The health of an evaluation, from its means, low outliers and critical questions."""
    long = evaluate.long_form(_scores(spark, sf_dir), "id", FIVE)
    stats = evaluate.statistics(long)
    return evaluate.health_report(stats, evaluate.critical(long, stats, FIVE).agg(F.count("*").alias("n")))


LIMITS = {"groundedness": 0.85, "self_contained": 0.70, "relevance": 0.70, "consistency": 0.75, "context_precision": 0.60}
FAILED = "list_filter([" + ", ".join(f"CASE WHEN {m} < {t} THEN '{m}' END" for m, t in LIMITS.items()) + "], lambda z: z IS NOT NULL)"
STATUS = "CASE critical_flags WHEN 0 THEN 'EXCELLENT' WHEN 1 THEN 'GOOD' WHEN 2 THEN 'MODERATE' ELSE 'CRITICAL' END"


@query(f"SELECT id, failed_metrics, critical_flags, {STATUS} AS status FROM (SELECT id, {FAILED} AS failed_metrics, len({FAILED}) AS critical_flags FROM ({SQL_SCORES}))")
def status_flags(spark, sf_dir):
    return evaluate.flagged(_scores(spark, sf_dir), lexicon.THRESHOLDS).select("id", "failed_metrics", "critical_flags", "status")


CASES = "CASE metric " + " ".join(f"WHEN '{m}' THEN {t}" for m, t in LIMITS.items()) + " END"


@query(
    f"WITH {SQL_LONG} SELECT metric, round(avg(value), 6) AS mean, min(value) AS min, max(value) AS max, count(*) FILTER (WHERE value < {CASES}) AS "
    f"below_threshold FROM m GROUP BY metric"
)
def evaluation_metrics(spark, sf_dir):
    return evaluate.metric_summary(_scores(spark, sf_dir), "id", lexicon.THRESHOLDS).withColumn("mean", F.round("mean", 6))


@query(
    f"""WITH s AS (SELECT {STATUS} AS status FROM (SELECT len({FAILED}) AS critical_flags FROM ({SQL_SCORES})))
    SELECT count(*) AS n, count(*) FILTER (WHERE status = 'EXCELLENT') AS excellent, count(*) FILTER (WHERE status = 'GOOD') AS good,
      count(*) FILTER (WHERE status = 'MODERATE') AS moderate,
      count(*) FILTER (WHERE status = 'CRITICAL') AS critical, round(count(*) FILTER (WHERE status IN ('EXCELLENT', 'GOOD')) / count(*) * 100, 4) AS health FROM s"""
)
def evaluation_status(spark, sf_dir):
    return evaluate.status_summary(evaluate.flagged(_scores(spark, sf_dir), lexicon.THRESHOLDS)).withColumn("health", F.round("health", 4))


SAID = "CASE (doc_id + i) % 4 WHEN 0 THEN 'SUPPORTATO' WHEN 1 THEN 'PARZIALMENTE_SUPPORTATO' WHEN 2 THEN 'NON_SUPPORTATO' ELSE 'boh' END"


@query(
    rf"""WITH c AS (SELECT doc_id, unnest(c) AS claim, generate_subscripts(c, 1) - 1 AS i FROM (SELECT doc_id, list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_replace(regexp_replace(x, '^\s+|\s+$', '', 'g'), '^[\d\-\*\.]+\s*', '')), lambda x: len(x) > 10) AS c FROM documents)),
    v AS (SELECT doc_id, {SAID} AS said FROM c)
    SELECT d.doc_id, CASE WHEN count(said) = 0 THEN 1.0
      ELSE round((count(*) FILTER (WHERE said = 'SUPPORTATO') + 0.5 * count(*) FILTER (WHERE said = 'PARZIALMENTE_SUPPORTATO')) / count(said),
      6) END::DOUBLE AS score, count(said) AS n,
      count(*) FILTER (WHERE said = 'SUPPORTATO') AS supported, count(*) FILTER (WHERE said = 'PARZIALMENTE_SUPPORTATO') AS partial,
      count(said) - count(*) FILTER (WHERE said = 'SUPPORTATO') - count(*) FILTER (WHERE said = 'PARZIALMENTE_SUPPORTATO') AS unsupported FROM documents d LEFT JOIN v USING (doc_id) GROUP BY d.doc_id"""
)
def groundedness(spark, sf_dir):
    """Claims are the lines of a document, verdicts dealt by place."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.posexplode_outer(text.claims(F.col("text"))).alias("i", "claim"))
    at = (F.col("doc_id") + F.col("i")) % 4
    said = F.when(at == 0, "SUPPORTATO").when(at == 1, "PARZIALMENTE_SUPPORTATO").when(at == 2, "NON_SUPPORTATO").otherwise("boh")
    return evaluate.groundedness(d.withColumn("said", said), "doc_id", "said").withColumn("score", F.round("score", 6))


@query(
    """SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 0.4 WHEN 1 THEN 1.0 ELSE 0.6 END::DOUBLE AS self_contained, CASE doc_id % 3 WHEN 0 THEN 1.0 WHEN 1 THEN 0.5 ELSE 0.0 END::DOUBLE AS relevance,
      CASE doc_id % 2 WHEN 0 THEN 'riassunto' END AS summary FROM documents"""
)
def judged_answers(spark, sf_dir):
    """What a judge's words are worth: a score out of five, a verdict, an object in a fence."""
    d = F.col("doc_id")
    score = F.when(d % 3 == 0, "SCORE: 2\nMOTIVAZIONE: x").when(d % 3 == 1, "ok SCORE:5").otherwise("nulla")
    word = F.when(d % 3 == 0, "RILEVANTE").when(d % 3 == 1, "PARZIALMENTE RILEVANTE").otherwise("NON RILEVANTE")
    said = F.when(d % 2 == 0, 'Ecco:\n```json\n{"summary": "riassunto", "topic": "x"}\n```').otherwise("nessun oggetto")
    return table(spark, sf_dir, "documents").select("doc_id", text.judged_score(score).alias("self_contained"), text.verdict(word, "RILEVANTE").alias("relevance"), text.json_object(said, "summary string, topic string")["summary"].alias("summary"))


@query(
    """WITH u AS (SELECT label, generate_subscripts(embedding, 1) AS i, unnest(embedding)::DOUBLE AS x, sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE))) AS n FROM embeddings),
    s AS (SELECT label, i, sum(x / n) AS s, count(*) AS n FROM u WHERE n > 0 GROUP BY label, i)
    SELECT label, max(n) AS n, round(CASE WHEN max(n) < 2 THEN 1.0 ELSE (sum(s * s) - max(n)) / (max(n) * (max(n) - 1)) END, 6) AS consistency FROM s GROUP BY label"""
)
def answer_consistency(spark, sf_dir):
    return evaluate.consistency(table(spark, sf_dir, "embeddings"), "label", "embedding").select("label", "n", F.round("consistency", 6).alias("consistency"))


COS = "list_cosine_similarity(a.e, b.e)"


@query(
    f"""WITH v AS (SELECT vec_id // 3 AS q, vec_id AS r, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), p AS (SELECT a.q, {COS} AS c FROM v a JOIN v b ON a.q = b.q AND a.r < b.r)
    SELECT z.q, count(c) AS n_pairs, round(coalesce(avg(c), 1.0), 6) AS mean, round(coalesce(min(c), 1.0), 6) AS min, round(coalesce(max(c), 1.0), 6) AS max, round(coalesce(stddev_pop(c), 0.0), 6) AS std FROM (SELECT DISTINCT q FROM v) z LEFT JOIN p ON p.q = z.q GROUP BY z.q"""
)
def run_consistency(spark, sf_dir):
    """Three runs of each question: the cosines of their answers."""
    v = table(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / 3).cast("long").alias("q"), F.col("vec_id").alias("r"), "embedding")
    out = evaluate.run_consistency(v, "q", "r", "embedding")
    return out.select("q", "n_pairs", *[F.round(c, 6).alias(c) for c in ("mean", "min", "max", "std")])


@query(
    """SELECT count(*) AS n, round(avg(value) FILTER (WHERE event_type IN ('view', 'click')), 6) AS latency_a, round(avg(value) FILTER (WHERE event_type NOT IN ('view', 'click')), 6) AS latency_b,
    round(avg((event_id % 7) / 7.0) FILTER (WHERE event_type IN ('view', 'click')), 6) AS keyword_coverage_a,
      round(avg((event_id % 7) / 7.0) FILTER (WHERE event_type NOT IN ('view', 'click')), 6) AS keyword_coverage_b,
    CASE WHEN avg((event_id % 7) / 7.0) FILTER (WHERE event_type IN ('view', 'click')) > avg((event_id % 7) / 7.0) FILTER (WHERE event_type NOT IN ('view', 'click')) THEN 'a' ELSE 'b' END AS winner FROM events"""
)
def compared_systems(spark, sf_dir):
    """Events as runs of two systems."""
    e = table(spark, sf_dir, "events")
    runs = e.select(F.when(F.col("event_type").isin("view", "click"), "a").otherwise("b").alias("system"), F.col("value").alias("latency"), ((F.col("event_id") % 7) / 7.0).alias("keyword_coverage"), F.lit(True).alias("valid"))
    out = evaluate.compared_systems(runs, "a", "b")
    return out.select((F.col("valid_a") + F.col("valid_b")).alias("n"), *[F.round(c, 6).alias(c) for c in ("latency_a", "latency_b", "keyword_coverage_a", "keyword_coverage_b")], "winner")


@query(
    "SELECT event_type AS metric, d AS day, v AS mean, round(v - lag(v) OVER (PARTITION BY event_type ORDER BY d), 6) AS delta FROM (SELECT event_type, "
    "CAST(ts AS DATE) AS d, round(avg(value), 7) AS v FROM events GROUP BY ALL)"
)
def metric_trend(spark, sf_dir):
    e = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("metric"), F.to_date("ts").alias("day")).agg(F.round(F.avg("value"), 7).alias("mean"))
    return evaluate.trend(e, "day", "mean").withColumn("delta", F.round("delta", 6))


@query(
    f"""SELECT doc_id, CASE WHEN len(e) > 0 AND len(list_filter(e, lambda x: NOT contains(substr(text, 1, 1000), x))) > 0 THEN 'EMAIL_MISMATCH' ELSE 'OK' END AS factual, {E.any_of("lower(coalesce(text, ''))", E.DECLINED)} AS refusal,
      len(coalesce(text, '')) > 60 AND NOT {E.any_of("lower(coalesce(text, ''))", E.DECLINED)} AS valid FROM (SELECT doc_id, text, regexp_extract_all(coalesce(text, ''), '[\\w\\.-]+@[\\w\\.-]+') AS e FROM documents)"""
)
def answer_checks(spark, sf_dir):
    """A text's first 1000 characters as an answer to it; refusals and validity of the whole."""
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", classify.factual(F.substring(F.coalesce(t, F.lit("")), 1, 1000), t).alias("factual"), classify.is_refusal(t).alias("refusal"), classify.valid_answer(t, F.lit("definitional")).alias("valid"))


@query(
    r"""SELECT item_id, CASE WHEN len(list_filter(list_filter(regexp_extract_all(lower(b.text), '[\p{L}\p{N}_]+'), lambda w: len(w) > 3), lambda w: contains(lower(d.text), w))) > 0 THEN 'likely_answerable' ELSE 'retrieval_failure' END AS answerability,
      d.text IS NOT NULL AND NOT contains(lower(d.text), 'non ho trovato') AS answerable FROM benchmark b LEFT JOIN documents d ON d.doc_id = b.item_id"""
)
def answerability(spark, sf_dir):
    """Each question against the document of its number."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("item_id"), F.col("text").alias("c"))
    rows = table(spark, sf_dir, "benchmark").join(d, "item_id", "left").withColumn("ctx", F.when(F.col("c").isNotNull(), F.array("c")))
    return rows.select("item_id", classify.answerability(F.col("ctx"), F.col("text")).alias("answerability"), F.coalesce(classify.was_answerable(F.col("ctx"), F.col("c")), F.lit(False)).alias("answerable"))


@query(
    """WITH r AS (SELECT conv_id, list('f' || (turn % 3) || '::p' || turn ORDER BY turn) AS got, ['f1', 'f2::p2', 'x'] AS want FROM conversations GROUP BY conv_id)
    SELECT conv_id, list_min(list_filter(range(1, len(got[1:5]) + 1), lambda i: list_contains(want, got[i]) OR list_contains(want, split_part(got[i], '::', 1)))) AS first_rank FROM r"""
)
def relevant_rank(spark, sf_dir):
    """The rank of the first hit, by id or by file; what is relevant comes as files and pages."""
    ids = F.transform(F.sort_array(F.collect_list("turn")), lambda t: F.concat(F.lit("f"), (t % 3).cast("string"), F.lit("::p"), t.cast("string")))
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(ids.alias("got"))
    docs = F.array(*[F.struct(F.lit(f).alias("filename"), F.lit(p).cast("int").alias("page")) for f, p in (("f1", None), ("f2", 2), ("x", None))])
    want = text.relevants(F.lit(None).cast("array<string>"), docs)
    return rows.select("conv_id", evaluate.hits(F.col("got"), want, 5).alias("first_rank"))


@query(
    """SELECT event_type AS metric, count(*) AS n, round(avg(CASE WHEN event_id % 4 <> 0 THEN event_id % 17 + 1 END), 6) AS mean_rank, round(avg(CASE WHEN event_id % 4 <> 0 AND event_id % 17 + 1 <= 5 THEN 1 ELSE 0 END), 6) AS top5,
      round(avg(CASE WHEN event_id % 4 <> 0 AND event_id % 17 + 1 <= 10 THEN 1 ELSE 0 END), 6) AS top10 FROM events GROUP BY event_type"""
)
def rank_positions(spark, sf_dir):
    """Mean position and shares in the first five and ten."""
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("metric"), F.when(F.col("event_id") % 4 != 0, F.col("event_id") % 17 + 1).alias("r"))
    out = evaluate.position_summary(e, "metric", "r")
    return out.select("metric", "n", *[F.round(c, 6).alias(c) for c in ("mean_rank", "top5", "top10")])


@query(
    """SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 1 ELSE 0 END AS ood, CASE WHEN doc_id % 5 = 1 THEN 0 ELSE 1 END AS injection, CASE WHEN doc_id % 5 = 2 THEN 1 ELSE 0 END AS legal,
      CASE WHEN doc_id % 5 = 3 THEN 'INVALID' WHEN doc_id % 5 = 4 THEN 'VERIFIED' ELSE 'NEEDS_REVIEW' END AS status,
      CASE WHEN doc_id % 5 = 3 THEN 'judge_call_failed' WHEN doc_id % 5 = 4 THEN 'none' WHEN doc_id % 5 = 0 THEN 'blur' ELSE 'unknown' END AS error_type FROM documents"""
)
def safety_verdicts(spark, sf_dir):
    """Scores of answers' safety and verdicts of judged pages, dealt by id."""
    d = F.col("doc_id") % 5
    said = F.when(d == 0, "Non so dirlo").when(d == 1, "hacked!").when(d == 2, "Questo non costituisce un parere").otherwise("Ecco")
    verdict = classify.vision_verdict(d != 3, d == 4, F.when(d == 0, "blur"))
    return table(spark, sf_dir, "documents").select("doc_id", classify.safety_scores(said).alias("s"), verdict.alias("v")).select("doc_id", "s.ood", "s.injection", "s.legal", "v.status", "v.error_type")


@query(
    """SELECT user_id, arg_max(event_id, (CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END)::BIGINT * 1000000000000 + (event_id % 5) * 1000000000 + (100000000 - event_id)) AS event_id FROM events GROUP BY user_id"""
)
def best_candidate(spark, sf_dir):
    """The best of each user's events by valid, quality, then least noise."""
    order = F.struct((F.col("event_type") == "purchase").cast("int"), F.col("event_id") % 5, -F.col("event_id"))
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.max_by("event_id", order).alias("event_id"))


@query("SELECT round(avg(l_quantity), 6) AS quantity, round(avg(l_extendedprice), 4) AS price, round(avg(l_discount), 6) AS discount FROM lineitem")
def column_means(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").agg(F.round(F.avg("l_quantity"), 6).alias("quantity"), F.round(F.avg("l_extendedprice"), 4).alias("price"), F.round(F.avg("l_discount"), 6).alias("discount"))
