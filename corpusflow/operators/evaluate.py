"""Retrieval metrics, descriptive statistics, outliers, health."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import saved


def recall_at_k(retrieved: Column, expected: Column, k: int) -> Column:
    hit = F.size(F.array_intersect(F.slice(retrieved, 1, k), expected))
    return F.when((F.size(expected) == 0) | (F.size(retrieved) == 0), 0.0).otherwise(hit / F.size(F.array_distinct(expected)))


def precision_at_k(retrieved: Column, expected: Column, k: int) -> Column:
    head = F.slice(retrieved, 1, k)
    return F.when((F.size(expected) == 0) | (F.size(retrieved) == 0), 0.0).otherwise(F.size(F.array_intersect(head, expected)) / F.size(head))


def hits(retrieved: Column, expected: Column, k: int) -> Column:
    """The rank of the first retrieved id that is expected, whole or by its part before `::`; null without one in the first k."""
    fits = F.transform(F.slice(retrieved, 1, k), lambda r: F.array_contains(expected, r) | F.array_contains(expected, F.substring_index(r, "::", 1)))
    at = F.array_position(F.transform(fits, lambda x: F.coalesce(x, F.lit(False))), True)
    return F.nullif(F.coalesce(at, F.lit(0)).cast("long"), F.lit(0))


def rank_summary(ranks: DataFrame, rank: str, ks: list[int], most: int) -> DataFrame:
    """One row for cases with the rank of their first hit (null for none): recall@k, mrr@k for each k, coverage@most, total_queries, to 4 digits."""
    r = F.col(rank)
    out = []
    for k in ks:
        out += [F.round(F.coalesce(F.avg((r <= k).cast("int")), F.avg(F.lit(0))), 4), F.round(F.avg(F.when(r <= k, 1.0 / r).otherwise(0.0)), 4)]
    names = [f"{m}_at_{k}" for k in ks for m in ("recall", "mrr")]
    filled = ranks.withColumn(rank, F.coalesce(r, F.lit(1 << 30)))
    return filled.agg(*[c.alias(n) for c, n in zip(out, names, strict=True)], F.round(F.avg((r <= most).cast("int")), 4).alias(f"coverage_at_{most}"), F.count("*").alias("total_queries"))


def position_summary(ranks: DataFrame, by: str, rank: str) -> DataFrame:
    """(by, n, mean_rank of the found, top5, top10 shares of all)."""
    r = F.col(rank)
    return ranks.groupBy(by).agg(F.count("*").alias("n"), F.avg(r).alias("mean_rank"), F.avg(F.coalesce((r <= 5).cast("int"), F.lit(0))).alias("top5"), F.avg(F.coalesce((r <= 10).cast("int"), F.lit(0))).alias("top10"))


def long_form(wide: DataFrame, id_col: str, metrics: list[str]) -> DataFrame:
    """(id, metric, value) of the columns, NaN as null."""
    rows = wide.select(F.col(id_col).alias("id"), F.explode(F.create_map(*[x for m in metrics for x in (F.lit(m), F.col(m).cast("double"))])).alias("metric", "value"))
    return rows.withColumn("value", F.nanvl("value", F.lit(None)))


def quartiles(long: DataFrame, name: str = "metric", value: str = "value", accuracy: int = 1000) -> DataFrame:
    """(name, n, q1, median, q3) of each metric by linear interpolation, exact; nulls don't count.

    Approximate percentiles bracket the (at most six) values asked for; a second pass counts what lies below each bracket and only
    the distinct values within are put in order. So no task holds a metric's values.
    """
    v = F.col(value)
    rows = long.where(v.isNotNull()).select(F.col(name).alias("_m"), v.cast("double").alias("_v"))
    shares = (0.25, 0.5, 0.75)
    sketch = rows.groupBy("_m").agg(F.count("*").alias("_n"), F.percentile_approx("_v", F.array(*[F.lit(min(1.0, max(0.0, s + d))) for s in shares for d in (-3 / accuracy, 3 / accuracy)]), accuracy).alias("_b"), F.min("_v").alias("_low"), F.max("_v").alias("_high"))
    few = F.col("_n") <= accuracy  # then all values are within the bracket
    ends = lambda i: (F.when(few, F.col("_low")).otherwise(F.col("_b")[2 * i]).alias("low"), F.when(few, F.col("_high")).otherwise(F.col("_b")[2 * i + 1]).alias("high"))
    spans = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(s).alias("share"), *ends(i)) for i, s in enumerate(shares)])
    wide = saved(sketch.select("_m", "_n", spans.alias("_s")))  # a row for each metric
    seen = rows.join(F.broadcast(wide) if metrics_are_few(wide) else wide, "_m")
    # of each quartile: how many are below its bracket, and the values in it
    parts = seen.select("_m", "_n", "_v", F.explode("_s").alias("s")).where(F.col("_v") <= F.col("s.high"))
    counts = parts.groupBy("_m", "_n", "s.i", "s.share", F.when(F.col("_v") >= F.col("s.low"), F.col("_v")).alias("_v")).agg(F.count("*").alias("c"))
    order = Window.partitionBy("_m", "i").orderBy(F.col("_v").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    placed = counts.withColumn("upto", F.sum("c").over(order))
    at = F.col("share") * (F.col("_n") - 1)
    pick = lambda rank: F.min(F.when(F.col("upto") > rank, F.col("_v")))
    found = placed.groupBy("_m", "_n", "i", "share").agg(pick(F.floor(at)).alias("a"), pick(F.ceil(at)).alias("z"))
    found = found.withColumn("q", F.col("a") + (F.col("z") - F.col("a")) * (at - F.floor(at)))
    return found.groupBy(F.col("_m").alias(name), F.col("_n").alias("n")).agg(*[F.max(F.when(F.col("i") == i, F.col("q"))).alias(c) for i, c in enumerate(("q1", "median", "q3"))])


def metrics_are_few(summary: DataFrame, most: int = 10_000) -> bool:
    return summary.limit(most + 1).count() <= most


def statistics(long: DataFrame, name: str = "metric", value: str = "value") -> DataFrame:
    """Of each metric: n, mean, median, mode (the least of the most frequent), sample deviation and variance, min, max, range, quartiles, iqr,
    and how many values lie beyond 1.5 of it. Nulls don't count; a metric of nulls only has no row."""
    v = F.col(value)
    rows = long.where(v.isNotNull())
    base = rows.groupBy(name).agg(F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.var_samp(v).alias("variance"), F.min(v).alias("min"), F.max(v).alias("max"))
    often = rows.groupBy(name, v.alias("_v")).agg(F.count("*").alias("_c")).groupBy(name).agg(F.min_by("_v", F.struct(-F.col("_c"), "_v")).alias("mode"))
    base = saved(base.join(often, name).join(quartiles(long, name, value), name))  # a row for each metric: what follows doesn't scan again
    base = base.withColumn("range", F.col("max") - F.col("min")).withColumn("iqr", F.col("q3") - F.col("q1"))
    fence = base.select(F.col(name).alias("_m"), (F.col("q1") - 1.5 * F.col("iqr")).alias("_lo"), (F.col("q3") + 1.5 * F.col("iqr")).alias("_hi"))
    out = rows.join(F.broadcast(fence) if metrics_are_few(fence) else fence, F.col(name) == F.col("_m")).groupBy(name).agg(F.count_if(v < F.col("_lo")).alias("low_outliers"), F.count_if(v > F.col("_hi")).alias("high_outliers"))
    return base.join(out, name)


def outliers(long: DataFrame, stats: DataFrame, name: str = "metric", value: str = "value") -> DataFrame:
    """The rows of long beyond the fences of their metric, with `side` low or high."""
    fence = stats.select(F.col(name).alias("_m"), (F.col("q1") - 1.5 * F.col("iqr")).alias("_lo"), (F.col("q3") + 1.5 * F.col("iqr")).alias("_hi"))
    side = F.when(F.col(value) < F.col("_lo"), "low").when(F.col(value) > F.col("_hi"), "high")
    return long.join(fence, F.col(name) == F.col("_m")).withColumn("side", side).where("side is not null").drop("_m", "_lo", "_hi")


def critical(long: DataFrame, stats: DataFrame, order: list[str]) -> DataFrame:
    """(id, reason, affected_metrics, n, severity): ids with a metric below its low fence, metrics in the given order."""
    low = outliers(long, stats).where("side = 'low'")
    place = F.array_position(F.array(*map(F.lit, order)), F.col("metric"))
    told = F.sort_array(F.collect_list(F.struct(place.alias("p"), "metric", F.format_string("Low %s (%.2f)", "metric", "value").alias("why"))))
    rows = low.groupBy("id").agg(told.alias("t"))
    n = F.size("t")
    return rows.select("id", F.array_join(F.transform("t", lambda x: x["why"]), "; ").alias("reason"), F.transform("t", lambda x: x["metric"]).alias("affected_metrics"), n.cast("long").alias("n"), F.when(n >= 2, "high").otherwise("medium").alias("severity"))


def by_severity(rows: DataFrame) -> DataFrame:
    return rows.orderBy(F.when(F.col("severity") == "high", 0).otherwise(1), F.desc("n"), "id")


def correlations(wide: DataFrame, metrics: list[str]) -> DataFrame:
    """One row: Pearson's coefficient of each pair of columns over rows that have both, `a_vs_b`, to 4 digits, null where undefined."""
    pairs = [(a, b) for i, a in enumerate(metrics) for b in metrics[i + 1 :]]
    clean = wide.select(*[F.nanvl(F.col(m).cast("double"), F.lit(None)).alias(m) for m in metrics])
    return clean.agg(*[F.round(F.nanvl(F.corr(a, b), F.lit(None)), 4).alias(f"{a}_vs_{b}") for a, b in pairs])


def health(mean: Column, outliers: Column, critical: Column) -> Column:
    return F.greatest(F.lit(0.0), mean * 60 - F.least(outliers * 2.0, F.lit(20.0)) - F.least(critical * 3.0, F.lit(20.0)))


def rating(score: Column) -> Column:
    return F.when(score >= 90, "excellent").when(score >= 75, "good").when(score >= 60, "fair").otherwise("poor")


def health_report(stats: DataFrame, n_critical: DataFrame) -> DataFrame:
    """One row: overall_score, rating, base_score, outlier_penalty, critical_penalty out of statistics and a row (n) of the number of critical ids.
    Means come in to 4 digits, as the statistics are reported."""
    seen = stats.agg(F.coalesce(F.avg(F.round("mean", 4)), F.lit(0.0)).alias("mean"), F.coalesce(F.sum("low_outliers"), F.lit(0)).alias("low")).crossJoin(n_critical.select(F.col("n").alias("critical")))
    score = health(F.col("mean"), F.col("low"), F.col("critical"))
    return seen.select(
        F.round(score, 2).alias("overall_score"),
        rating(score).alias("rating"),
        F.round(F.col("mean") * 60, 2).alias("base_score"),
        F.least(F.col("low") * 2, F.lit(20)).cast("long").alias("outlier_penalty"),
        F.least(F.col("critical") * 3, F.lit(20)).cast("long").alias("critical_penalty"),
    )


def groundedness(claims: DataFrame, by: str, verdict: str) -> DataFrame:
    """(by, score, n, supported, partial, unsupported) of judged claims (by, claim or null, verdict); 1 without claims."""
    v = F.col(verdict)
    whole, part = v.contains("SUPPORTATO") & ~v.contains("NON") & ~v.contains("PARZIALMENTE"), v.contains("PARZIALMENTE")
    some = F.col("claim").isNotNull()
    counts = claims.groupBy(by).agg(F.count_if(some).alias("n"), F.count_if(some & whole).alias("supported"), F.count_if(some & part).alias("partial"))
    score = F.when(F.col("n") == 0, 1.0).otherwise((F.col("supported") + 0.5 * F.col("partial")) / F.col("n"))
    return counts.select(by, score.alias("score"), "n", "supported", "partial", (F.col("n") - F.col("supported") - F.col("partial")).alias("unsupported"))


def flagged(scores: DataFrame, thresholds: list[tuple[str, float]]) -> DataFrame:
    """scores (a column for each metric) with failed_metrics, critical_flags and status."""
    failed = F.array_compact(F.array(*[F.when(F.col(m) < t, m) for m, t in thresholds]))
    out = scores.withColumn("failed_metrics", failed).withColumn("critical_flags", F.size("failed_metrics").cast("long"))
    n = F.col("critical_flags")
    return out.withColumn("status", F.when(n == 0, "EXCELLENT").when(n == 1, "GOOD").when(n == 2, "MODERATE").otherwise("CRITICAL"))


def metric_summary(scores: DataFrame, id_col: str, thresholds: list[tuple[str, float]]) -> DataFrame:
    """(metric, mean, min, max, below_threshold) over all scores."""
    limits = F.create_map(*[x for m, t in thresholds for x in (F.lit(m), F.lit(t))])
    rows = long_form(scores, id_col, [m for m, _ in thresholds])
    return rows.groupBy("metric").agg(F.avg("value").alias("mean"), F.min("value").alias("min"), F.max("value").alias("max"), F.count_if(F.col("value") < limits[F.col("metric")]).alias("below_threshold"))


def status_summary(rows: DataFrame) -> DataFrame:
    """One row: n, how many of each status, health: the percentage of EXCELLENT and GOOD."""
    names = ("EXCELLENT", "GOOD", "MODERATE", "CRITICAL")
    out = rows.agg(F.count("*").alias("n"), *[F.count_if(F.col("status") == s).alias(s.lower()) for s in names])
    return out.withColumn("health", F.when(F.col("n") == 0, 0.0).otherwise((F.col("excellent") + F.col("good")) / F.col("n") * 100))


def compared_systems(runs: DataFrame, a: str, b: str) -> DataFrame:
    """One row out of runs (system, keyword_coverage, latency, valid): means of both systems, their differences, and the winner by
    coverage, then by latency."""
    side = lambda s, c: F.avg(F.when(F.col("system") == s, F.col(c)))
    out = runs.agg(*[side(s, c).alias(f"{c}_{s}") for s in (a, b) for c in ("keyword_coverage", "latency")], *[F.count_if((F.col("system") == s) & F.col("valid")).alias(f"valid_{s}") for s in (a, b)])
    out = out.withColumn("coverage_delta", F.col(f"keyword_coverage_{a}") - F.col(f"keyword_coverage_{b}")).withColumn("latency_delta", F.col(f"latency_{a}") - F.col(f"latency_{b}"))
    return out.withColumn("winner", F.when(F.col("coverage_delta") > 0, a).when(F.col("coverage_delta") < 0, b).when(F.col("latency_delta") < 0, a).when(F.col("latency_delta") > 0, b).otherwise("tie"))


def trend(runs: DataFrame, order: str, value: str, by: str = "metric") -> DataFrame:
    """runs with `delta`: the change of the value from the run before."""
    return runs.withColumn("delta", F.col(value) - F.lag(value).over(Window.partitionBy(by).orderBy(order)))


def citation_accuracy(citations: Column, pages: Column, sources: Column) -> Column:
    """Share of the non-empty citations that name one of the pages or sources; 1 where there are none.

    Null lists are empty ones; a null citation, page or source matches nothing.
    """
    none = F.array().cast("array<string>")
    kept = F.filter(F.coalesce(citations, none), lambda c: F.trim(c) != "")
    known = F.transform(F.concat(F.coalesce(pages.cast("array<string>"), none), F.coalesce(sources, none)), F.lower)
    found = F.filter(kept, lambda c: F.exists(known, lambda k: F.coalesce(F.contains(F.lower(c), k), F.lit(False))))
    return F.when(F.size(kept) == 0, 1.0).otherwise(F.size(found) / F.size(kept))


def chunk_verdict(judgment: Column) -> Column:
    """1, 0.5 or 0 for a judge's word on a chunk; a null one counts as useless."""
    some = judgment.contains("PARZIALMENTE")
    useful = judgment.contains("UTILE") & ~some & ~judgment.contains("INUTILE")
    return F.when(useful, 1.0).when(some, 0.5).otherwise(0.0)


def consistency(vectors: DataFrame, by: str, vec_col: str) -> DataFrame:
    """(by, n, consistency): the mean cosine of all pairs of a group, 1 for a single vector.

    The unit vectors' sum tells it without pairs: (|sum|^2 - n) / (n (n - 1)). Null and zero vectors are left out.
    """
    unit = unit_vectors(vectors, by, vec_col)
    sums = unit.select(by, F.posexplode("_u").alias("_i", "_x")).groupBy(by, "_i").agg(F.sum("_x").alias("_s"), F.count("*").alias("n"))
    return sums.groupBy(by).agg(F.max("n").alias("n"), F.sum(F.col("_s") * F.col("_s")).alias("_q")).select(
        by, "n", F.when(F.col("n") < 2, 1.0).otherwise((F.col("_q") - F.col("n")) / (F.col("n") * (F.col("n") - 1))).alias("consistency")
    )


def unit_vectors(vectors: DataFrame, by: str, vec_col: str) -> DataFrame:
    v = F.transform(vec_col, lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    rows = vectors.select(by, v.alias("_v"), norm.alias("_n")).where("_n > 0")
    return rows.select(by, F.transform("_v", lambda x: x / F.col("_n")).alias("_u"))


def run_consistency(answers: DataFrame, by: str, run: str, vec_col: str, most: int = 16) -> DataFrame:
    """(by, n_pairs, mean, min, max, std) of the cosines between the answers of a question's runs, a few (1 to most) for each
    question by design, so their pairs are compared; 1 and no deviation for a single run. More runs than `most` are an error."""
    unit = answers.select(by, run).join(answers.select(by, run, F.transform(vec_col, lambda x: x.cast("double")).alias("_v")), [by, run])
    listed = unit.groupBy(by).agg(F.sort_array(F.collect_list(F.struct(F.col(run).alias("r"), F.col("_v").alias("v")))).alias("l"))
    listed = listed.withColumn("l", F.when(F.size("l") <= most, F.col("l")).otherwise(F.raise_error(F.lit("too many runs of one question"))))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda p, q: p * q), F.lit(0.0), lambda s, x: s + x)
    cosine = lambda a, b: dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))
    pairs = F.flatten(F.transform("l", lambda a, i: F.transform(F.filter("l", lambda _, j: j > i), lambda b: cosine(a["v"], b["v"]))))
    seen = listed.select(by, F.explode_outer(pairs).alias("c"))
    one = lambda agg, empty: F.coalesce(agg, F.lit(empty))
    return seen.groupBy(by).agg(F.count("c").alias("n_pairs"), one(F.avg("c"), 1.0).alias("mean"), one(F.min("c"), 1.0).alias("min"), one(F.max("c"), 1.0).alias("max"), one(F.stddev_pop("c"), 0.0).alias("std"))
