"""Entities of a query's domain: expansions, which of them the results don't cover, and searches for these."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from querypond import constants as K
from querypond.functions import signals
from querypond.functions.dialect import SPARK

#: Sources that are asked for an entity.
TARGETS = ("arxiv", "semanticscholar", "github")


def _lists(spark, table: dict[str, list[str]], name: str) -> DataFrame:
    """One row an entry of the fixed lists; these are some dozen."""
    return spark.createDataFrame([(d, i, x) for d, items in table.items() for i, x in enumerate(items)], f"entity_domain string, n int, {name} string")


def expanded(queries: DataFrame) -> DataFrame:
    """(query_id, entity_domain, n, variant): the queries that stand for a query's domain of entities."""
    plan = queries.select("query_id", F.expr(signals.entity_domain(SPARK, "query")).alias("entity_domain")).where("entity_domain IS NOT NULL")
    return plan.join(F.broadcast(_lists(queries.sparkSession, K.ENTITY_QUERIES, "variant")), "entity_domain")


def missing(queries: DataFrame, results: DataFrame, *, most: int = 5) -> DataFrame:
    """(query_id, n, entity): the first entities of a query's domain that its results (query_id, title, snippet) don't cover. A result covers
    the first entity of the list that its text holds."""
    plan = queries.select("query_id", F.expr(signals.entity_domain(SPARK, "query")).alias("entity_domain")).where("entity_domain IS NOT NULL")
    terms = _lists(queries.sparkSession, K.ENTITY_TERMS, "entity")
    lists = terms.groupBy("entity_domain").agg(F.array_sort(F.collect_list(F.struct("n", F.lower("entity").alias("low")))).alias("terms"))
    text = F.lower(F.concat(F.coalesce("title", F.lit("")), F.lit(" "), F.coalesce("snippet", F.lit(""))))
    held = results.select("query_id", text.alias("text")).join(F.broadcast(plan.join(F.broadcast(lists), "entity_domain")), "query_id")
    covered = held.select("query_id", F.try_element_at(F.filter("terms", lambda t: F.contains(F.col("text"), t.low)), F.lit(1)).alias("t")).where("t IS NOT NULL").select("query_id", F.col("t.low").alias("low")).distinct()
    wanted = plan.join(F.broadcast(terms), "entity_domain").withColumn("low", F.lower("entity"))
    left = wanted.join(covered, ["query_id", "low"], "left_anti")
    return left.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("n"))).where(F.col("place") <= most).select("query_id", F.col("place").alias("n"), "entity")


def sub_queries(absent: DataFrame) -> DataFrame:
    """(query_id, n, entity, provider, query): what is asked for each missing entity, of the sources that know papers and code."""
    return absent.withColumn("provider", F.explode(F.array(*[F.lit(t) for t in TARGETS]))).withColumn("query", F.concat("entity", F.lit(" paper research")))
