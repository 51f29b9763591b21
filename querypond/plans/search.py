"""The search pipeline over a table of queries and a corpus of results, and research answers on top of it.

Stages: plan, source selection, lexical match, three per source, first of each address, first of each text, 25 candidates,
BM25 within the batch, signals, fusion, re-ranking, limit. All are windows and joins by query; nothing loops over queries.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from querypond.functions import signals
from querypond.functions.dialect import SPARK
from querypond.operators import dedup, ranking, vectors
from querypond.plans import planner
from querypond.runtime import cut

#: Ids up to which rows are picked by a list of them, which is applied at the scan, below the first row of each id.
LISTED_IDS = 10_000


def healthy_sources(sources: DataFrame, query: str = "query_id") -> DataFrame:
    """Rows (query, provider, healthy) without unhealthy sources; a query that has no other keeps all of its own."""
    some = F.max(F.col("healthy")).over(Window.partitionBy(query))
    return sources.withColumn("_some", some).where(F.col("healthy") | ~F.col("_some")).drop("_some")


def without_excluded(sources: DataFrame, excluded: str = "excluded", query: str = "query_id") -> DataFrame:
    """Rows without the sources in the query's exclusions, or all where nothing else is left."""
    bad = F.coalesce(F.array_contains(excluded, F.col("provider")), F.lit(False))
    some = F.max(~F.col("_bad")).over(Window.partitionBy(query))
    return sources.withColumn("_bad", bad).withColumn("_some", some).where(~F.col("_bad") | ~F.col("_some")).drop("_bad", "_some")


def select_sources(queries: DataFrame) -> DataFrame:
    """(query_id, query, intent, provider, position): the ordered sources of each classified query."""
    plan = planner.classify(queries)
    chosen = plan.select("query_id", "query", "intent", "news_class", F.posexplode(planner.sources(F.col("intent"), F.col("query"))).alias("position", "provider"))
    return chosen.where(~((F.col("news_class") == "cybersecurity") & (F.col("intent") == "news") & (F.col("provider") == "hackernews")))


def candidates(queries: DataFrame, corpus: DataFrame, *, per_source: int = 3, most: int = 25) -> DataFrame:
    """Matches of each query in the corpus (result_id, url, title, snippet, provider, author, published_at) of its sources."""
    queries = queries.where("query IS NOT NULL").select("query_id", "query")
    corpus = corpus.select("result_id", "url", "title", "snippet", "provider", "author", "published_at")
    chosen = select_sources(queries)
    text = F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("snippet", F.lit("")))
    docs = corpus.select(F.col("result_id").alias("doc_id"), "provider", text.alias("text"))
    # A few rows a query and source; they are read more than once below, and the corpus' other columns only for them.
    first = cut(ranking.bm25_first(queries, chosen, docs, per_source, group="provider").select("query_id", "provider", F.col("doc_id").alias("result_id"), F.col("place").alias("_n")))
    ids = first.select("result_id").distinct()
    listed = [r.result_id for r in ids.limit(LISTED_IDS + 1).collect()]
    few = len(listed) > LISTED_IDS and ids.limit(ranking.BROADCAST_ROWS + 1).count() <= ranking.BROADCAST_ROWS
    found = corpus.where(F.col("result_id").isin(listed)) if len(listed) <= LISTED_IDS else corpus.join(F.broadcast(ids) if few else ids, "result_id", "left_semi")
    capped = first.join(found, ["result_id", "provider"]).join(chosen.select("query_id", "provider", "query", "intent", "news_class", "position"), ["query_id", "provider"])
    by = [F.col("position"), F.col("_n")]
    once = dedup.first_by(capped, [F.col("query_id"), F.col("url")], by)
    once = once.withColumn("_text", F.sha2(dedup.normal_text(text), 256))
    once = dedup.first_by(once, [F.col("query_id"), F.col("_text")], by)
    return cut(once.withColumn("input_pos", F.row_number().over(Window.partitionBy("query_id").orderBy(*by))).where(F.col("input_pos") <= most).drop("_n", "_text"))


def batch_bm25(batch: DataFrame) -> DataFrame:
    """BM25 with statistics over each query's own batch of candidates, normalised by its largest."""
    text = F.concat_ws("\n", F.coalesce("title", F.lit("")), F.coalesce("snippet", F.lit("")))
    by = Window.partitionBy("query_id")
    rows = batch.withColumn("_w", ranking.tokens(text)).withColumn("_n", F.count("*").over(by)).withColumn("_avg", F.avg(F.size("_w")).over(by))
    terms = rows.select("query_id", "result_id", "_n", "_avg", F.size("_w").alias("dl"), F.explode("_w").alias("term")).groupBy("query_id", "result_id", "term").agg(F.count("*").alias("tf"), F.first("dl").alias("dl"), F.first("_n").alias("n"), F.first("_avg").alias("avg"))
    terms = terms.withColumn("df", F.count("*").over(Window.partitionBy("query_id", "term")))
    asked = batch.select("query_id", "query").distinct().select("query_id", F.explode(ranking.tokens(F.col("query"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("times"))
    idf = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1.0)
    part = idf * F.col("times") * F.col("tf") * 2.5 / (F.col("tf") + 1.5 * (0.25 + 0.75 * F.col("dl") / F.col("avg")))
    raw = terms.join(asked, ["query_id", "term"]).groupBy("query_id", "result_id").agg(F.sum(part).alias("raw"))
    return ranking.normalised(batch.join(raw, ["query_id", "result_id"], "left").withColumn("raw", F.coalesce("raw", F.lit(0.0)))).drop("raw")


def search(queries: DataFrame, corpus: DataFrame, *, limit: int = 10) -> DataFrame:
    """(query_id, rank, result_id, url, title, snippet, provider, final_score, rerank_score, ai_targeted) of queries (query_id, query)."""
    found = batch_bm25(candidates(queries, corpus))
    found = found.withColumn("title", F.coalesce("title", F.lit(""))).withColumn("boost", F.expr(signals.boost_with_news(SPARK, "query", "provider", "news_class")).cast("double"))
    scored = ranking.scored(found, text="coalesce(snippet, title)", id_col="result_id").withColumn("final_score", F.expr(signals.final_score("boost")))
    out = ranking.top_per_query(ranking.rerank(scored), limit, "rerank_score", "input_pos")
    short = F.when(F.length("snippet") > 600, F.concat(F.substring("snippet", 1, 600), F.lit("..."))).otherwise(F.col("snippet"))
    flagged = F.expr(signals.ai_targeted(SPARK, "concat(title, ' ', coalesce(snippet, ''))"))
    return out.select("query_id", "rank", "result_id", "url", "title", short.alias("snippet"), "provider", "final_score", "rerank_score", flagged.alias("ai_targeted"))


def new_results(results: DataFrame, seen: DataFrame) -> DataFrame:
    """Results whose address was not seen for their query."""
    return results.join(seen.select("query_id", "url"), ["query_id", "url"], "left_anti")


def research(questions: DataFrame, corpus: DataFrame, *, sub_questions: DataFrame | None = None, per_question: int = 4, sources: int = 6, hops: int = 1) -> DataFrame:
    """Sources of each question: (query_id, pos, hop, url, title, snippet, provider, final_score).

    Without a planner's sub-questions (query_id, query) a question stands for itself. Further hops ask for what the first
    words of the found titles add, and take only addresses that were not seen.
    """
    asked = questions if sub_questions is None else questions.select("query_id", "query").unionByName(sub_questions.select("query_id", "query"))
    total, step = None, asked
    for hop in range(max(1, hops)):
        numbered = step.select(F.col("query_id").alias("parent"), "query", F.xxhash64("query_id", "query").alias("query_id"))
        found = search(numbered.select("query_id", "query"), corpus, limit=per_question).join(numbered.select("query_id", "parent"), "query_id").drop("query_id").withColumnRenamed("parent", "query_id").withColumn("hop", F.lit(hop))
        fresh = found if total is None else new_results(found, total)
        total = fresh if total is None else total.unionByName(fresh)
        step = fresh.groupBy("query_id").agg(F.max_by(F.col("title"), F.struct("final_score", "url")).alias("query")).where("query <> ''")
    first = dedup.first_by(total, [F.col("query_id"), F.col("url")], [F.col("hop"), F.col("final_score").desc()])
    order = Window.partitionBy("query_id").orderBy(F.col("final_score").desc(), "hop", "url")
    return first.withColumn("pos", F.row_number().over(order)).where(F.col("pos") <= sources).select("query_id", "pos", "hop", "url", "title", "snippet", "provider", "final_score")


def cached(queries: DataFrame, cache: DataFrame, *, distance: float = 0.08, now: str = signals.NOW) -> DataFrame:
    """Queries (query_id, query_hash, embedding) with their cache entry: the same hash, else the nearest unexpired within the distance.

    Exact hits leave by an equi-join; the stated rest is compared with the valid entries in blocks.
    """
    alive = cache.where(F.expr(f"expires_at IS NULL OR expires_at > {now}"))
    exact = queries.join(alive.select("query_hash", F.col("entry_id").alias("hit")), "query_hash").groupBy("query_id").agg(F.min("hit").alias("entry_id")).withColumn("distance", F.lit(0.0))
    rest = vectors.units(queries.join(exact, "query_id", "left_anti"), "query_id", "embedding", "q")
    pairs = vectors.within(rest, vectors.units(alive, "entry_id", "embedding", "e"), 1 - distance).select("query_id", "entry_id", (1 - F.col("cosine")).alias("distance"))
    return exact.unionByName(pairs.groupBy("query_id").agg(F.min_by("entry_id", F.struct("distance", "entry_id")).alias("entry_id"), F.min("distance").alias("distance")))


def upsert(table: DataFrame, rows: DataFrame, *, key: str, at: str) -> DataFrame:
    """The table with rows replaced or added by key; the later of two counts."""
    return dedup.first_by(table.unionByName(rows), [F.col(key)], [F.col(at).desc()])
