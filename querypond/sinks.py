"""Tables that runs append to and merge into, in batch and from streams, and the payloads for those who wait for them."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from querypond.operators import dedup


def append(rows: DataFrame, path: str, *, by: str | None = None) -> None:
    """Adds rows to a Parquet table, in folders by a column if one is named."""
    writer = rows.write.mode("append")
    (writer.partitionBy(by) if by else writer).parquet(path)


def search_log(results: DataFrame, plans: DataFrame, at: Column) -> DataFrame:
    """(query_id, query, intent, language, results, day, at): one row a search, for ``append`` by day."""
    n = results.groupBy("query_id").agg(F.count("*").alias("results"))
    log = plans.select("query_id", "query", "intent", "language").join(n, "query_id", "left")
    return log.withColumn("results", F.coalesce("results", F.lit(0))).withColumn("at", at).withColumn("day", F.to_date("at"))


def research_sessions(questions: DataFrame, sources: DataFrame, confidence: DataFrame, at: Column) -> DataFrame:
    """(query_id, query, sources, confidence, status, at): one row a question; failed where nothing was found."""
    n = sources.groupBy("query_id").agg(F.count("*").alias("sources"))
    out = questions.select("query_id", "query").join(n, "query_id", "left").join(confidence.select("query_id", "confidence"), "query_id", "left")
    return out.withColumn("sources", F.coalesce("sources", F.lit(0))).withColumn("status", F.when(F.col("sources") > 0, "completed").otherwise("failed")).withColumn("at", at)


def merge(spark, path: str, rows: DataFrame, *, key: str, at: str, count: str | None = None) -> None:
    """Replaces or adds rows of a Parquet table by key; the later counts. With count, that column counts the deliveries of a key.

    The new version is written beside the old one and named in a small pointer file last, so a lost job leaves the old version.
    """
    fs, base = _files(spark, path)
    old = current(spark, path)
    both = rows if old is None else old.unionByName(rows, allowMissingColumns=True)
    if count:
        total = both.groupBy(key).agg(F.sum(F.coalesce(count, F.lit(1))).alias("_n"))
        both = dedup.first_by(both, [F.col(key)], [F.col(at).desc()]).drop(count).join(total.withColumnRenamed("_n", count), key)
    else:
        both = dedup.first_by(both, [F.col(key)], [F.col(at).desc()])
    version = 1 + max([-1, *_versions(fs, base)])
    both.write.mode("error").parquet(f"{path}/v{version:09d}")


def current(spark, path: str) -> DataFrame | None:
    """The latest whole version of a merged table; null before the first."""
    fs, base = _files(spark, path)
    versions = _versions(fs, base)
    return spark.read.parquet(f"{path}/v{max(versions):09d}") if versions else None


def _files(spark, path: str):
    base = spark._jvm.org.apache.hadoop.fs.Path(path)
    return base.getFileSystem(spark._jsc.hadoopConfiguration()), base


def _versions(fs, base) -> list[int]:
    """Versions whose write was finished: Spark leaves a mark in their folder then."""
    if not fs.exists(base):
        return []
    folders = [s.getPath() for s in fs.listStatus(base)]
    return [int(p.getName()[1:]) for p in folders if p.getName()[:1] == "v" and fs.exists(p.suffix("/_SUCCESS"))]


def merge_stream(stream: DataFrame, path: str, checkpoint: str, *, key: str, at: str, count: str | None = None):
    """A streaming query that merges each micro-batch into the table."""
    each: Callable = lambda batch, _: merge(batch.sparkSession, path, batch, key=key, at=at, count=count)
    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).outputMode("update")


def alert_payloads(alerts: DataFrame, checked_at: Column) -> DataFrame:
    """(query, payload): one JSON text a subscription with its new results, the best first."""
    fields = ("url", "title", "snippet", "provider", "published", "score")
    items = F.transform(F.sort_array(F.collect_list(F.struct("score", *[c for c in fields if c != "score"])), asc=False), lambda x: F.struct(*[x[c].alias(c) for c in fields]))
    per = alerts.groupBy("query").agg(items.alias("new_results"))
    return per.select("query", F.to_json(F.struct(F.lit("watch.alert").alias("event"), "query", "new_results", checked_at.alias("checked_at"))).alias("payload"))


def report_html(summary: dict, reasons: list[str]) -> str:
    """A page with the figures of one evaluation, which is a single row."""
    escape = lambda x: str(x).replace("&", "&amp;").replace("<", "&lt;")
    rows = "".join(f"<tr><td>{escape(k)}</td><td>{escape(round(v, 4) if isinstance(v, float) else v)}</td></tr>" for k, v in summary.items())
    return f"<html><body><h1>{'passed' if not reasons else 'failed'}</h1><table>{rows}</table><ul>{''.join(f'<li>{escape(r)}</li>' for r in reasons)}</ul></body></html>"


def progress_events(query) -> list[str]:
    """The progress of a streaming query as JSON texts, one an event."""
    return [json.dumps(dict(p) if not isinstance(p, str) else p, default=str) for p in query.recentProgress]
