"""Retrieval quality: graded metrics by window functions, summaries, gates and trends."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from querypond.functions import signals
from querypond.functions.dialect import SPARK

#: Thresholds of the relaxed profile.
THRESHOLDS = {"p5": 0.4, "p10": 0.3, "ndcg5": 0.35, "ndcg10": 0.25, "mrr": 0.5, "diversity": 2.0}

#: Rows of a query that are counted together; a hot query is many parts.
PART = 10_000


def metrics(judged: DataFrame) -> DataFrame:
    """Of rows (query_id, pos from 1, rel, provider): one row a query with its metrics. Relevant is a rel of at least 1."""
    rows = judged.withColumn("hit", (F.col("rel") >= 1).cast("int")).withColumn("part", F.floor((F.col("pos") - 1) / PART))
    # Counts up to a row: those of the parts before its own, and those inside it.
    by = Window.partitionBy("query_id")
    before = by.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = rows.groupBy("query_id", "part").agg(F.sum("hit").alias("h"), F.sum(1 - F.col("hit")).alias("m"))
    parts = parts.select("query_id", "part", F.coalesce(F.sum("h").over(before), F.lit(0)).alias("hits_before"), F.coalesce(F.sum("m").over(before), F.lit(0)).alias("misses_before"), F.sum("m").over(by).alias("all_misses"))
    run = Window.partitionBy("query_id", "part").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("hits", F.sum("hit").over(run)).withColumn("misses", F.sum(1 - F.col("hit")).over(run)).join(parts, ["query_id", "part"])
    rows = rows.withColumn("hits", F.col("hits") + F.col("hits_before")).withColumn("misses", F.col("misses") + F.col("misses_before"))
    # The ideal order is needed as far as the largest k only.
    ideal = judged.withColumn("ideal", F.row_number().over(by.orderBy(F.col("rel").desc(), "pos"))).where("ideal <= 10")
    gain = lambda k, at: F.sum(F.when(F.col(at) <= k, F.col("rel") / F.log2(F.col(at) + 1)).otherwise(0.0))
    top = lambda k: F.sum(F.when(F.col("pos") <= k, F.col("hit")).otherwise(0))
    out = rows.groupBy("query_id").agg(
        F.count("*").alias("n"), F.sum("hit").alias("found"), top(5).alias("h5"), top(10).alias("h10"), gain(5, "pos").alias("d5"), gain(10, "pos").alias("d10"),
        F.min(F.when(F.col("hit") == 1, F.col("pos"))).alias("first_hit"), F.sum(F.when((F.col("hit") == 1) & (F.col("pos") <= 10), F.col("hits") / F.col("pos")).otherwise(0.0)).alias("ap"),
        F.sum(F.when(F.col("hit") == 1, 1 - F.when(F.col("all_misses") > 0, F.col("misses") / F.col("all_misses")).otherwise(0.0)).otherwise(0.0)).alias("bp"), F.countDistinct("provider").alias("diversity"),
    )
    out = out.join(ideal.groupBy("query_id").agg(gain(5, "ideal").alias("i5"), gain(10, "ideal").alias("i10")), "query_id")
    total = F.greatest("found", F.lit(3))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    return out.select(
        "query_id", (F.col("h5") / F.least("n", F.lit(5))).alias("p5"), (F.col("h10") / F.least("n", F.lit(10))).alias("p10"), (F.col("h10") / total).alias("r10"), ratio(F.col("d5"), F.col("i5")).alias("ndcg5"), ratio(F.col("d10"), F.col("i10")).alias("ndcg10"),
        F.coalesce(1 / F.col("first_hit"), F.lit(0.0)).alias("mrr"), (F.col("ap") / total).alias("map"), ratio(F.col("bp"), F.col("found")).alias("bpref"), "diversity",
    )


def summary(per_query: DataFrame) -> DataFrame:
    """One row: means, and the weighted score with full marks for latency, determinism and degradation."""
    names = ("p5", "p10", "r10", "ndcg5", "ndcg10", "mrr", "map", "bpref", "diversity")
    means = per_query.agg(F.count("*").alias("queries"), *[F.avg(n).alias(n) for n in names])
    return means.withColumn("score", 25 * F.col("p5") + 20 * F.col("ndcg5") + 15 * F.col("mrr") + 10 * F.least(F.col("diversity") / 5, F.lit(1.0)) + 10 + 10 + 5 + 5)


def violations(per_query: DataFrame, thresholds: dict[str, float] = THRESHOLDS) -> DataFrame:
    """(query_id, metric, value, threshold) of metrics below their threshold."""
    checks = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value"), F.lit(t).alias("threshold")) for m, t in thresholds.items()])
    return per_query.select("query_id", F.explode(F.filter(checks, lambda c: c.value < c.threshold)).alias("c")).select("query_id", "c.metric", "c.value", "c.threshold")


def trend(runs: DataFrame, order: str, value: str, least: float = 0.5, suite: str | None = None) -> DataFrame:
    """Runs that differ from the one before, of the same suite, by at least ``least``."""
    by = Window.partitionBy(suite) if suite else Window.partitionBy(F.lit(1))
    before = F.lag(value).over(by.orderBy(order))
    return runs.withColumn("change", F.col(value) - before).where(F.abs("change") >= least)


#: Limits of the gate and further thresholds of the relaxed profile.
GATE = {"mean_trust": 65.0, "max_latency_ms": 10_000.0, "max_degraded_rate": 0.5, "min_determinism_rate": 1.0, "min_adversarial_pass_rate": 0.8}
MEANS = ("p5", "p10", "ndcg5", "ndcg10", "r10", "mrr", "map", "bpref", "diversity", "mean_trust", "mean_relevance", "latency_ms", "alignment")


def judge(results: DataFrame, judgments: DataFrame, queries: DataFrame) -> DataFrame:
    """Results (query_id, pos, url, title, snippet, provider) with rel and from_judgment: the judgment (query_id, n, url, title, rel) of
    their address, the first that there is; else of the title that is most alike (at least 0.4; the first of equals); else by the share
    of the query's words that they hold. Judgments of a query are a short list that was made by hand; results are joined with it in parts."""
    by_url = judgments.where("url IS NOT NULL").groupBy("query_id", "url").agg(F.min_by("rel", "n").alias("url_rel"))
    rows = results.join(by_url, ["query_id", "url"], "left")
    words = lambda c: F.expr(signals.title_words(SPARK, f"coalesce({c}, '')"))
    listed = judgments.select("query_id", F.struct("n", words("title").alias("words"), "rel").alias("j")).groupBy("query_id").agg(F.array_sort(F.collect_list("j")).alias("judged"))
    alike = F.transform("judged", lambda j: F.struct((-_jaccard(F.col("own"), j.words)).alias("far"), j.n.alias("n"), j.rel.alias("rel")))
    asked = queries.select("query_id", words("query").alias("asked"))
    rows = rows.join(listed, "query_id", "left").join(asked, "query_id", "left").withColumn("own", words("title")).withColumn("best", F.array_min(alike))
    text = F.lower(F.concat(F.coalesce("title", F.lit("")), F.lit(" "), F.coalesce("snippet", F.lit(""))))
    share = F.size(F.filter("asked", lambda w: F.contains(text, w))) / F.greatest(F.size("asked"), F.lit(1))
    overlap = F.when(share >= 0.66, 3).when(share >= 0.5, 2).when(share >= 0.33, 1).when(share >= 0.15, 0).otherwise(-1)
    judged = F.coalesce("url_rel", F.when(F.col("best.far") <= -0.4, F.col("best.rel")))
    return rows.select("query_id", "pos", "url", "provider", F.coalesce(judged, overlap).alias("rel"), judged.alias("from_judgment"))


def _jaccard(a: Column, b: Column) -> Column:
    both = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - both
    return F.when(union > 0, both / union).otherwise(0.0)


def alignment(judged: DataFrame) -> DataFrame:
    """(query_id, alignment): the share of relevant judged results that are good and among the first three."""
    good = F.when((F.col("from_judgment") >= 2) & (F.col("pos") <= 3), 1).otherwise(0)
    per = judged.where("from_judgment >= 1").groupBy("query_id").agg(F.avg(good).alias("alignment"))
    return judged.select("query_id").distinct().join(per, "query_id", "left").select("query_id", F.coalesce("alignment", F.lit(0.0)).alias("alignment"))


def excluded(results: DataFrame, topics: list[str], first: int = 10) -> DataFrame:
    """(query_id, excluded): whether the first results (query_id, pos, title, snippet) together hold an excluded topic."""
    top = results.where(F.col("pos") <= first)
    text = F.concat(F.coalesce("title", F.lit("")), F.lit(" "), F.coalesce("snippet", F.lit("")))
    joined = top.groupBy("query_id").agg(F.lower(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", text.alias("t")))), lambda x: x.t), " ")).alias("t"))
    hit = F.exists(F.array(*[F.lit(t.lower()) for t in topics]), lambda t: F.contains(F.col("t"), t)) if topics else F.lit(False)
    return joined.select("query_id", hit.alias("excluded"))


def all_violations(per_query: DataFrame, thresholds: dict[str, float] = THRESHOLDS) -> DataFrame:
    """(query_id, metric, value, threshold) of all ten checks, from rows with latency_ms, mean_trust, deterministic and excluded, too."""
    low = [(m, F.col(m).cast("double"), F.lit(float(t)), F.col(m) < t) for m, t in {**thresholds, "mean_trust": GATE["mean_trust"]}.items()]
    flag = lambda c: F.col(c).cast("double")
    other = [("latency_ms", flag("latency_ms"), F.lit(GATE["max_latency_ms"]), F.col("latency_ms") > GATE["max_latency_ms"]), ("deterministic", flag("deterministic"), F.lit(1.0), ~F.col("deterministic")), ("excluded", flag("excluded"), F.lit(0.0), F.col("excluded"))]
    checks = F.array_compact(F.array(*[F.when(bad, F.struct(F.lit(m).alias("metric"), value.alias("value"), limit.alias("threshold"))) for m, value, limit, bad in low + other]))
    return per_query.select("query_id", F.explode(checks).alias("c")).select("query_id", "c.metric", "c.value", "c.threshold")


def full_summary(per_query: DataFrame) -> DataFrame:
    """One row: the means of all measures, the rates, the excluded queries and the weighted score."""
    means = per_query.agg(F.count("*").alias("queries"), *[F.avg(m).alias(m) for m in MEANS], F.avg(F.col("degraded").cast("double")).alias("degraded_rate"), F.avg(F.col("deterministic").cast("double")).alias("determinism_rate"), F.count_if("excluded").alias("excluded_queries"))
    zero = F.lit(0.0)
    parts = [25 * F.col("p5"), 20 * F.col("ndcg5"), 15 * F.col("mrr"), 10 * F.least(F.col("diversity") / 5, F.lit(1.0)), 10 * F.greatest(zero, 1 - F.col("latency_ms") / 10_000), 10 * F.col("determinism_rate"), 5 * F.greatest(zero, 1 - F.col("degraded_rate")), 5 * F.greatest(zero, 1 - F.col("excluded_queries") / F.col("queries"))]
    return means.withColumn("score", reduce(Column.__add__, parts))


def pass_rate(outcomes: DataFrame, passed: str = "passed") -> DataFrame:
    """One row: the share that passed, 1 where there is none."""
    return outcomes.agg(F.coalesce(F.avg(F.col(passed).cast("double")), F.lit(1.0)).alias("pass_rate"))


def gate(summary: DataFrame, adversarial: DataFrame | None = None, thresholds: dict[str, float] = THRESHOLDS) -> DataFrame:
    """(check, value, threshold) of the nine checks that a summary fails; no row: it passes."""
    rows = summary.crossJoin(pass_rate(adversarial)) if adversarial is not None else summary.withColumn("pass_rate", F.lit(1.0))  # both are one row
    low = [(m, m, thresholds[m]) for m in ("p5", "ndcg5", "mrr", "diversity")] + [("determinism", "determinism_rate", GATE["min_determinism_rate"]), ("adversarial", "pass_rate", GATE["min_adversarial_pass_rate"])]
    high = [("latency", "latency_ms", GATE["max_latency_ms"]), ("excluded", "excluded_queries", 0.0), ("degraded", "degraded_rate", GATE["max_degraded_rate"])]
    value = lambda c: F.col(c).cast("double")
    checks = [(n, value(c), t, value(c) < t) for n, c, t in low] + [(n, value(c), t, value(c) > t) for n, c, t in high]
    failed = F.array_compact(F.array(*[F.when(bad, F.struct(F.lit(n).alias("check"), v.alias("value"), F.lit(float(t)).alias("threshold"))) for n, v, t, bad in checks]))
    return rows.select(F.explode(failed).alias("c")).select("c.check", "c.value", "c.threshold")


def topic_benchmark(results: DataFrame, topics: DataFrame, *, least: float = 0.6) -> DataFrame:
    """(query_id, p5, diversity, mean_relevance, mean_trust, passed): the share of the first five results (query_id, pos, title, snippet, provider,
    trust, semantic) that hold a wanted topic (query_id, topic), and distinct sources among the first ten."""
    text = F.lower(F.concat(F.coalesce("title", F.lit("")), F.lit(" "), F.coalesce("snippet", F.lit(""))))
    wanted = topics.groupBy("query_id").agg(F.collect_set(F.lower("topic")).alias("topics"))
    top = results.where("pos <= 10").join(wanted, "query_id", "left").withColumn("hit", F.coalesce(F.exists("topics", lambda t: F.contains(text, t)), F.lit(False)))
    five = F.col("pos") <= 5
    per = top.groupBy("query_id").agg(F.avg(F.when(five, F.col("hit").cast("double"))).alias("p5"), (F.countDistinct("provider") / F.count("*")).alias("diversity"), F.avg(F.when(five, F.col("semantic"))).alias("mean_relevance"), F.avg(F.when(five, F.col("trust"))).alias("mean_trust"))
    return per.withColumn("passed", F.col("p5") >= least)
