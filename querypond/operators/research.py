"""Citations, confidence, contradictions and knowledge graphs of research answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from querypond.functions import signals
from querypond.functions.dialect import SPARK


def confidence(n: Column, mean_trust: Column, official: Column, code: Column, unresolved: Column, relevance: Column, summary: Column) -> Column:
    """0 to 100: citations, their trust, official sources and code, less open contradictions, low relevance and hedging."""
    base = F.lit(40.0) + F.least(8.0 * n, F.lit(32.0)) + F.coalesce(mean_trust, F.lit(0.0)) / 100 * 20 + F.when(official, 10).otherwise(0) + F.when(code, 5).otherwise(0) - 12 * unresolved
    scaled = base * F.when(relevance.isNotNull(), F.greatest(F.lit(0.0), relevance / 0.5)).otherwise(1.0)
    hedged = F.when(F.coalesce(hedging(summary), F.lit(False)), 35.0).otherwise(0.0)
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.floor(scaled - hedged + 0.5)))


def hedging(text: Column) -> Column:
    """Whether a text hedges, by any of the fixed phrases."""
    return F.transform(F.array(text), lambda x: x.rlike("|".join(f"(?:{p})" for p in _phrases())))[0]


def _phrases() -> list[str]:
    from querypond.constants import HEDGING
    from querypond.functions.dialect import BOUNDARY

    return ["(?i)" + p.replace(r"\b", BOUNDARY) for p in HEDGING]


def citations(results: DataFrame, documents: DataFrame, *, url: str = "url") -> DataFrame:
    """Results with the text that was extracted for their address, where there is one."""
    found = documents.select(F.col(url).alias("_u"), F.col("title").alias("extracted_title"), "content_hash").dropDuplicates(["_u"])
    return results.join(found, results[url] == F.col("_u"), "left").drop("_u").withColumn("trust", F.expr(signals.trust()))


def contradictions(pairs: DataFrame, sources: DataFrame) -> DataFrame:
    """Pairs (query_id, a, b) of source positions with the sources' titles; positions out of range are dropped."""
    left, right = (sources.select("query_id", F.col("pos").alias(s), F.col("title").alias(f"title_{s}")) for s in "ab")
    return pairs.join(left, ["query_id", "a"]).join(right, ["query_id", "b"])


def graph_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges (source, target, relation) by label with the ids of their nodes; edges with an unknown end are dropped."""
    a, b = (nodes.select(F.col("label").alias(n), F.col("node_id").alias(f"{n}_id")) for n in ("source", "target"))
    return edges.join(a, "source").join(b, "target").select("source_id", "target_id", "relation")


def claim_evidence(claims: DataFrame, documents: DataFrame) -> DataFrame:
    """Whether the quoted evidence of a claim stands in its document: verified, missing, or source_unreachable."""
    joined = claims.join(documents.select("url", F.col("text").alias("_text")), "url", "left")
    verdict = F.when(F.col("_text").isNull(), "source_unreachable").when(F.contains(F.lower("_text"), F.lower("evidence")), "verified").otherwise("missing")
    return joined.withColumn("verdict", verdict).drop("_text")
