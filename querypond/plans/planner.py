"""Query planning: language, intent, news class, entities and the ordered list of sources of each query."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from querypond import constants as K
from querypond.functions import signals
from querypond.functions.dialect import SPARK

LIMIT = 8


def classify(queries: DataFrame, text: str = "query") -> DataFrame:
    """The queries with language, intent, news_class and entity_domain."""
    counts = signals.news_counts(SPARK, text)
    out = queries.withColumns({"language": F.expr(signals.language(SPARK, text)), "intent": F.expr(signals.intent(SPARK, text)), "entity_domain": F.expr(signals.entity_domain(SPARK, text)), **{f"n_{n}": F.expr(c) for n, c in counts}})
    return out.withColumn("news_class", F.expr(signals.news_class([n for n, _ in counts]))).drop(*[f"n_{n}" for n, _ in counts])


def keyword_sources(text: Column) -> Column:
    """Sources that the words of a query name, in the order of the words' table, each once."""
    found = F.array().cast("array<string>")
    for word, sources in K.KEYWORD_SOURCES:
        hit = F.contains(F.lower(text), F.lit(word))
        found = F.concat(found, F.when(hit, F.array(*[F.lit(s) for s in sources])).otherwise(F.array().cast("array<string>")))
    return F.array_distinct(found)


def domain_hints(text: Column) -> Column:
    found = F.array().cast("array<string>")
    for word in K.TECHNOLOGIES:
        if word in K.TECHNOLOGY_DOMAINS:
            found = F.concat(found, F.when(F.contains(F.lower(text), F.lit(word)), F.array(*[F.lit(x) for x in K.TECHNOLOGY_DOMAINS[word]])).otherwise(F.array().cast("array<string>")))
    return F.array_distinct(found)


def sources(intent: Column, text: Column, limit: int = LIMIT) -> Column:
    """Named sources first (the last named in front), the intent's list, then the rest by priority, up to the limit."""
    table = F.create_map(*[F.lit(x) if isinstance(x, str) else x for k, v in K.INTENT_SOURCES.items() for x in (k, F.array(*[F.lit(s) for s in v]))])
    own = F.coalesce(F.try_element_at(table, intent), F.array(*[F.lit(s) for s in K.INTENT_SOURCES["general"]]))
    named = F.array_except(keyword_sources(text), own)
    rest = F.array(*[F.lit(s[0]) for s in sorted(K.SOURCES, key=lambda s: -s[1])])
    return F.slice(F.array_distinct(F.concat(F.reverse(named), own, rest)), 1, limit)
