"""Token budgets and context strings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def estimate_tokens(text: Column) -> Column:
    return F.ceil(F.length(text) * 0.25)


def budget(max_tokens: int, chars_per_result: int = 2000, overhead: int = 50) -> dict[str, int]:
    available = max_tokens - overhead
    if available <= 0:
        return {"max_results": 0, "chars_per_result": 0, "total_chars": 0}
    chars = min(chars_per_result, 4 * available)
    return {"max_results": min(int(available / (0.25 * chars)), 20), "chars_per_result": chars, "total_chars": 4 * available}


def within_budget(results: DataFrame, limits: dict[str, int], *, query: str = "query_id", pos: str = "pos") -> DataFrame:
    """Title and snippet cut to their share, then the prefix whose running total fits."""
    n = limits["chars_per_result"]
    short = results.withColumn("title", F.substring("title", 1, n)).withColumn("snippet", F.substring(F.coalesce("snippet", F.lit("")), 1, n))
    run = Window.partitionBy(query).orderBy(pos)
    total = F.sum(F.length(F.coalesce("title", F.lit(""))) + F.length("snippet")).over(run.rowsBetween(Window.unboundedPreceding, 0))
    return short.withColumn("used_chars", total).withColumn("_n", F.row_number().over(run)).where((F.col("used_chars") <= limits["total_chars"]) & (F.col("_n") <= limits["max_results"])).drop("_n")


def context(results: DataFrame, *, query: str = "query_id", pos: str = "pos", chars: int = 1500, most: int = 6) -> DataFrame:
    """(query, context): ``[n] title`` and the text of the first results, each cut."""
    top = results.where(F.col(pos) <= most).select(query, pos, F.format_string("[%d] %s\n%s", F.col(pos), F.coalesce("title", F.lit("")), F.substring(F.coalesce("snippet", F.lit("")), 1, chars)).alias("part"))
    return top.groupBy(query).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(pos, "part"))), lambda p: p.part), "\n\n").alias("context"))
