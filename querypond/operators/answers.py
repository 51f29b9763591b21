"""What stands around a language model: its inputs from many documents, its replies made safe, and pluggable functions for it.

Models aren't part of the library. A function that takes a pandas Series and gives one is plugged in with ``model``; without one the
operators take their neutral results, as they do where a call fails.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from querypond.operators import budget, research

#: Characters of a source that an input holds, by what it is for.
CUTS = {"contradictions": 1500, "synthesis": 2500, "compression": 3000, "verification": 8000}


def model(function: Callable[[pd.Series], pd.Series] | None, kind: T.DataType | str, *inputs: Column) -> Column:
    """A column of a plugged-in function, called with Arrow batches; null without one."""
    if function is None:
        return F.lit(None).cast(kind)
    return F.pandas_udf(function, kind)(*inputs)


def embed(rows: DataFrame, text: str, function: Callable[[pd.Series], pd.Series] | None = None, out: str = "embedding") -> DataFrame:
    return rows.withColumn(out, model(function, "array<float>", F.col(text)))


def semantic_similarity(a: Column, b: Column) -> Column:
    """(cosine + 1) / 2 of two vectors; 0.5 where one is missing, zero or of another length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.coalesce(F.when((F.size(a) == F.size(b)) & (norm > 0), (dot(a, b) / norm + 1) / 2), F.lit(0.5))


def with_relevance(rows: DataFrame, judge: Callable[[pd.Series, pd.Series], pd.Series] | None = None, *, query: str = "query", text: str = "snippet") -> DataFrame:
    """Rows with ai_relevance (0 to 1, 0.5 without a judgment) and the names of the signals that are missing."""
    judged = rows.withColumn("ai_relevance", model(judge, "double", F.col(query), F.col(text)))
    missing = F.when(F.col("ai_relevance").isNull(), F.array(F.lit("aiRelevance"))).otherwise(F.array().cast("array<string>"))
    return judged.withColumn("missing_signals", missing).withColumn("ai_relevance", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("ai_relevance", F.lit(0.5)))))


def expansions(queries: DataFrame, expand: Callable[[pd.Series], pd.Series] | None = None, *, most: int = 6) -> DataFrame:
    """(query_id, n, query): a query's variants, at most so many; itself without a model or where it gives none."""
    made = F.slice(F.filter(model(expand, "array<string>", F.col("query")), lambda x: F.trim(x) != ""), 1, most)
    usable = F.when(F.size(made) > 0, made).otherwise(F.array("query"))
    return queries.select("query_id", F.posexplode(usable).alias("n", "query"))


def salvaged_json(raw: Column) -> Column:
    """The JSON text in a reply: without its fence, else its first object or array to the last bracket; null where there is none."""
    trim = lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")
    clean = trim(F.regexp_replace(F.regexp_replace(trim(raw), "(?i)^```(json)?", ""), "```$", ""))
    inner = F.nullif(F.regexp_extract(clean, r"(?s)(\{.*\}|\[.*\])", 1), F.lit(""))
    # The parser stops at the end of the first value; an object or array has to end with the text.
    valid = lambda x: F.try_parse_json(x).isNotNull() & (~x.rlike(r"^[\[{]") | x.rlike(r"[\]}]$"))
    return F.when(valid(clean), clean).when(valid(inner), inner)


def structured(replies: DataFrame, schema: T.StructType, *, reply: str = "reply") -> DataFrame:
    """The replies with the properties of a schema and nothing else; null where one is missing or of another kind."""
    parsed = F.from_json(salvaged_json(F.col(reply)), schema, {"mode": "PERMISSIVE"})
    return replies.withColumn("_s", parsed).select(*[c for c in replies.columns if c != reply], *[F.col(f"_s.{f.name}").alias(f.name) for f in schema.fields])


def model_inputs(documents: DataFrame, purpose: str, *, question: str = "query_id", pos: str = "pos", most: int = 20) -> DataFrame:
    """(question, input, sources): the numbered documents (pos, title, markdown) of each question, cut for the purpose; documents that failed
    to extract (null) are left out before they are numbered. Only the first ``most`` of a question are gathered."""
    there = documents.where("markdown IS NOT NULL")
    numbered = there.withColumn("_n", F.row_number().over(Window.partitionBy(question).orderBy(pos))).where(F.col("_n") <= most)
    part = F.format_string("[%d] %s\n%s", F.col("_n"), F.coalesce("title", F.lit("")), F.substring("markdown", 1, CUTS[purpose]))
    return numbered.groupBy(question).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_n", part.alias("part")))), lambda x: x.part), "\n\n").alias("input"), F.count("*").alias("sources"))


def compress(documents: DataFrame, distil: Callable[[pd.Series], pd.Series] | None = None, *, question: str = "query_id", max_tokens: int | None = None) -> DataFrame:
    """(question, input, sources, key_facts): documents of each question distilled; null facts without a model. With max_tokens as many
    documents, and as much of each, as the budget has."""
    if max_tokens is not None:
        limits = budget.budget(max_tokens)
        documents = documents.where(F.col("pos") <= limits["max_results"]).withColumn("markdown", F.substring("markdown", 1, 4 * limits["chars_per_result"]))
    return model_inputs(documents, "compression", question=question).withColumn("key_facts", model(distil, "array<string>", F.col("input")))


def summarize(documents: DataFrame, distil: Callable[[pd.Series], pd.Series] | None = None, **options) -> DataFrame:
    """The same as prose."""
    return compress(documents, distil, **options).withColumn("summary", F.array_join("key_facts", " "))


def cut_answers(answers: DataFrame, max_tokens: int) -> DataFrame:
    """Answers (summary, key_facts, examples, warnings, cited: arrays of texts) with their estimated tokens; a summary is cut where they exceed
    the limit."""
    lists = F.concat(*[F.coalesce(c, F.array().cast("array<string>")) for c in ("key_facts", "examples", "warnings", "cited")])
    tokens = budget.estimate_tokens(F.array_join(F.concat(F.array(F.coalesce("summary", F.lit(""))), lists), " "))
    return answers.withColumn("tokens", tokens).withColumn("summary", F.when(F.col("tokens") > max_tokens, F.substring("summary", 1, 4 * max_tokens)).otherwise(F.col("summary")))


def reasons(n: Column, official: Column, code: Column, unresolved: Column, relevance: Column, summary: Column) -> Column:
    """struct(evidence, unknowns, weaknesses): what speaks for an answer's confidence and against it."""
    some = lambda *pairs: F.array_compact(F.array(*[F.when(c, t) for c, t in pairs]))
    official, code = F.coalesce(official, F.lit(False)), F.coalesce(code, F.lit(False))
    evidence = some((n >= 3, F.concat(n.cast("string"), F.lit(" independent sources consulted"))), (official, F.lit("At least one official/authoritative source was used")))
    unknowns = some((n < 3, F.lit("Few independent sources were found — treat this answer as provisional")), (~code & (n > 0), F.lit("No concrete code example was found for this answer")))
    weaknesses = some(
        (~official, F.lit("No official documentation source was found")), (relevance < 0.4, F.lit("Sources have low relevance to the question — the answer may not be reliable")),
        (research.hedging(summary), F.lit("The generated answer indicates uncertainty — the synthesis found insufficient data")), (unresolved > 0, F.concat(unresolved.cast("string"), F.lit(" unresolved contradiction(s) between sources"))),
    )
    return F.struct(evidence.alias("evidence"), unknowns.alias("unknowns"), weaknesses.alias("weaknesses"))
