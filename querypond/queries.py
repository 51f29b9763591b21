"""Queries of the core operators."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from querypond import constants as K
from querypond import more_queries
from querypond.functions import signals
from querypond.functions.dialect import DUCK, SPARK
from querypond.operators import budget, dedup, evaluate, extract, ranking, research, timestamps, vectors
from querypond.plans import planner, search
from querypond.runtime import parallelism, table
from querypond.sources import registry
from querypond.streaming import state

Query = Callable[[SparkSession, str], DataFrame]


def _normalised_feeds(spark: SparkSession, d: str, *, estimate: bool) -> DataFrame:
    """(feed, record_id, stamp, utc, zone_from, notation, seen) of the four feeds' records. With estimate, publishers without a declared
    zone get the one that fits their stamps."""
    publishers = table(spark, d, "publishers").select("source_id", "tz_name", "date_order").dropDuplicates(["source_id"])
    articles = table(spark, d, "gnews_articles").select("source_id", "article_id", F.col("pub_date").alias("stamp"), "fetched_at")
    none, utc = F.lit(None).cast("string"), F.lit("UTC")
    form = lambda name, df, key, stamp, declared=utc, order=none, guess=none: df.select(F.lit(name).alias("feed"), F.col(key).cast("string").alias("record_id"), F.col(stamp).cast("string").alias("stamp"), F.col("fetched_at").alias("seen"), declared.alias("declared"), order.alias("date_order"), guess.alias("guess"))
    listed = articles.join(publishers, "source_id", "left")
    if estimate:
        guessed = timestamps.estimate_zones(articles.join(publishers, "source_id", "left_anti"), source="source_id", stamp="stamp", ingested="fetched_at")
        listed = listed.join(guessed.select(F.col("source").alias("source_id"), F.col("zone").alias("guess")), "source_id", "left")
    feeds = [
        form("hn_hits", table(spark, d, "hn_hits"), "object_id", "created_at"),
        form("gdelt_articles", table(spark, d, "gdelt_articles"), "article_id", "seendate"),
        form("se_items", table(spark, d, "se_items"), "question_id", "creation_date"),
        form("gnews_articles", listed, "article_id", "stamp", F.col("tz_name"), F.col("date_order"), F.col("guess") if estimate else none),
    ]
    return timestamps.normalise(reduce(DataFrame.unionByName, feeds), stamp="stamp", declared_zone=F.col("declared"), date_order=F.col("date_order"), estimated_zone=F.col("guess"))


def _first_instants(rows: DataFrame) -> DataFrame:
    """One row a record whose stamp means one instant; of repeated rows the first that does counts."""
    sure = rows.where("record_id IS NOT NULL AND utc IS NOT NULL")
    first = F.min_by(F.struct(F.unix_seconds("utc").alias("utc_second"), "zone_from"), F.struct("seen", "stamp"))
    return sure.groupBy("feed", "record_id").agg(first.alias("x")).select("feed", "record_id", "x.utc_second", "x.zone_from")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Instants that the stamps mean for certain: stamps without a zone of publishers that declare none are no cases."""
    return _first_instants(_normalised_feeds(spark, d, estimate=False)).drop("zone_from")


def p4_instants(spark: SparkSession, d: str) -> DataFrame:
    """All instants, those with an estimated zone, too, with what the zone comes from."""
    return _first_instants(_normalised_feeds(spark, d, estimate=True))


def p4_zones(spark: SparkSession, d: str) -> DataFrame:
    """The zone that fits each publisher's local stamps, beside the declared one, and whether both have one history of offsets."""
    publishers = table(spark, d, "publishers").select(F.col("source_id").alias("source"), "tz_name", "date_order").dropDuplicates(["source"])
    articles = table(spark, d, "gnews_articles").withColumnRenamed("source_id", "source").join(publishers, "source", "left")
    found = timestamps.estimate_zones(articles, source="source", stamp="pub_date", ingested="fetched_at", date_order=F.col("date_order"))
    names = timestamps.zone_histories(timestamps.zone_names(spark))
    declared = publishers.join(names.withColumnRenamed("zone", "tz_name"), "tz_name", "left").select("source", "tz_name", "candidate")
    return found.join(declared, "source", "left").select("source", "tz_name", "zone", (F.col("zone") == F.col("candidate")).alias("agrees"), "stamps", "violations", "low_lag_s")


# Each query's SQL for the comparison engine stands below it.
SQL: dict[str, str] = {}
WORDS = DUCK.words


def results(spark: SparkSession, d: str) -> DataFrame:
    """The results, repeated deliveries once."""
    return dedup.first_by(table(spark, d, "search_results"), [F.col("result_id")], [F.col("ingested_at"), F.col("fetched_at")])


RESULTS = "(SELECT * FROM search_results QUALIFY row_number() OVER (PARTITION BY result_id ORDER BY ingested_at, fetched_at) = 1)"


def exact_dedup(spark: SparkSession, d: str) -> DataFrame:
    return dedup.exact(table(spark, d, "documents"), "text", "doc_id").select("doc_id", "content_hash")


SQL["exact_dedup"] = r"""SELECT doc_id, content_hash FROM (SELECT doc_id, sha256(regexp_replace(lower(trim(text)), '[ \t\r\n]+', ' ', 'g')) AS content_hash FROM documents) QUALIFY row_number() OVER (PARTITION BY content_hash ORDER BY doc_id) = 1"""


def token_stats(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("source", F.size(ranking.tokens(F.col("text"))).alias("dl"))
    return docs.groupBy("source").agg(F.count("*").alias("docs"), F.sum("dl").alias("tokens"), F.round(F.avg("dl"), 6).alias("avg_dl"))


SQL["token_stats"] = f"SELECT source, count(*) AS docs, sum(dl)::BIGINT AS tokens, round(avg(dl), 6) AS avg_dl FROM (SELECT source, len({WORDS('text')}) AS dl FROM documents) GROUP BY source"


def term_freq(spark: SparkSession, d: str) -> DataFrame:
    return ranking.term_frequencies(table(spark, d, "documents")).select(F.col("doc").alias("doc_id"), "term", "tf")


SQL["term_freq"] = f"SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({WORDS('text')}) AS term FROM documents) GROUP BY doc_id, term"


def doc_freq(spark: SparkSession, d: str) -> DataFrame:
    return ranking.term_frequencies(table(spark, d, "documents")).groupBy("term").agg(F.count("*").alias("df"))


SQL["doc_freq"] = f"SELECT term, count(*) AS df FROM (SELECT doc_id, unnest(list_distinct({WORDS('text')})) AS term FROM documents) GROUP BY term"


def _items(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "eval_items").select(F.col("item_id").alias("query_id"), F.col("item_text").alias("query"))


def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    return ranking.bm25_top(_items(spark, d), table(spark, d, "documents"), 10)


BM25 = f"""WITH tok AS (SELECT doc_id, {WORDS('text')} AS w FROM documents), st AS (SELECT count(*) AS n, avg(len(w)) AS av FROM tok),
tf AS (SELECT doc_id, term, count(*) AS tf, any_value(dl) AS dl FROM (SELECT doc_id, len(w) AS dl, unnest(w) AS term FROM tok) GROUP BY doc_id, term),
q AS (SELECT query_id, term, count(*) AS times FROM (SELECT item_id AS query_id, unnest({WORDS('item_text')}) AS term FROM eval_items) GROUP BY query_id, term),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
raw AS (SELECT query_id, doc_id, sum(times * ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / av))) AS raw FROM q JOIN tf USING (term) JOIN df USING (term), st GROUP BY query_id, doc_id),
bm AS (SELECT query_id, doc_id, round(raw / max(raw) OVER (PARTITION BY query_id), 6) AS bm25 FROM raw)"""
SQL["bm25_topk"] = BM25 + " SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY bm25 DESC, doc_id) AS rank, bm25 FROM bm QUALIFY rank <= 10"


def _candidates(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The first 25 documents of each item (query_id, doc_id, bm25), and these documents, each once, with what their signals need; these
    read the whole text, so the documents are spread over all tasks first."""
    docs = table(spark, d, "documents")
    top = ranking.bm25_top(_items(spark, d), docs, 25).drop("rank")
    meta = docs.select("doc_id", "url", F.coalesce("title", F.lit("")).alias("title"), F.col("text").alias("snippet"), F.col("source").alias("provider"), F.lit(None).cast("string").alias("author"), F.date_format("published_at", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("published_at"), "text")
    return top, meta.join(top.select("doc_id").distinct(), "doc_id", "left_semi").repartition(parallelism(spark), "doc_id")


def _scored(spark: SparkSession, d: str, *, stuffed: bool, keep: tuple[str, ...] = ()) -> DataFrame:
    """The candidates with signals and final score; signals are made once a document."""
    top, docs = _candidates(spark, d)
    stuffing = ranking.stuffing(docs, "doc_id", "text") if stuffed else None
    return top.join(ranking.with_signals(docs, text="text", stuffing_of=stuffing).drop("text", *({"snippet", "title"} - set(keep))), "doc_id").withColumn("final_score", F.expr(signals.final_score()))


def final_scores(spark: SparkSession, d: str) -> DataFrame:
    """BM25 candidates with all signals, fused, the first ten of each query."""
    scores = _scored(spark, d, stuffed=True).withColumn("final_score", F.round("final_score", 6))
    return ranking.top_per_query(scores, 10, "final_score").select("query_id", "doc_id", "rank", "bm25", F.round("trust", 4).alias("trust"), "freshness", F.round("spam", 4).alias("spam"), "has_examples", "final_score")


STUFFED = f"""SELECT doc_id, CASE WHEN dl < 20 THEN 0.0 ELSE least(top * 1.0 / dl / 0.15, 1.0) END AS stuffing FROM (SELECT doc_id, max(CASE WHEN term NOT IN ({", ".join(f"'{w}'" for w in K.STUFFING_STOPWORDS)}) THEN tf ELSE 0 END) AS top, any_value(dl) AS dl FROM tf GROUP BY doc_id)"""
SQL["final_scores"] = (
    BM25
    + f""", st2 AS ({STUFFED}), c AS (SELECT * FROM bm QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY bm25 DESC, doc_id) <= 25),
m AS (SELECT c.*, url, coalesce(title, '') AS title, text AS snippet, source AS provider, NULL::VARCHAR AS author, strftime(published_at, '%Y-%m-%dT%H:%M:%SZ') AS published_at, text, coalesce(stuffing, 0.0) AS stuffing, {signals.host(DUCK)} AS host
  FROM c JOIN documents USING (doc_id) LEFT JOIN st2 USING (doc_id)),
r AS (SELECT *, ({signals.trust()})::DOUBLE AS raw_trust FROM m),
s AS (SELECT query_id, doc_id, bm25, ({signals.adjusted_trust(DUCK)})::DOUBLE AS trust, ({signals.freshness(DUCK)})::DOUBLE AS freshness, ({signals.popularity(DUCK)})::DOUBLE AS popularity, ({signals.code_quality(DUCK)})::DOUBLE AS code_quality, ({signals.has_examples(DUCK, 'text')})::DOUBLE AS has_examples,
  ({signals.authority(DUCK, 'raw_trust')})::DOUBLE AS authority, ({signals.source_quality(DUCK)})::DOUBLE AS source_quality, ({signals.spam(DUCK, 'text', 'stuffing', 'raw_trust')})::DOUBLE AS spam, 0.5::DOUBLE AS ai_relevance, 0.5::DOUBLE AS semantic FROM r),
f AS (SELECT *, round(({signals.final_score()})::DOUBLE, 6) AS final_score FROM s)
SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY final_score DESC, doc_id) AS rank, bm25, round(trust, 4) AS trust, freshness, round(spam, 4) AS spam, has_examples, final_score FROM f QUALIFY rank <= 10"""
)


def reranked(spark: SparkSession, d: str) -> DataFrame:
    scores = _scored(spark, d, stuffed=False, keep=("title", "snippet")).join(_items(spark, d), "query_id")
    out = ranking.rerank(scores)
    return ranking.top_per_query(out, 10, "rerank_score").select("query_id", "doc_id", "rank", F.round("alignment", 6).alias("alignment"), "rerank_score")


def rrf(spark: SparkSession, d: str) -> DataFrame:
    """Two lists of each item fused: by BM25, and the same documents by their date."""
    place = lambda by: F.row_number().over(Window.partitionBy("query_id").orderBy(by, "doc_id"))
    top, docs = _candidates(spark, d)
    c = top.join(docs.select("doc_id", "published_at"), "doc_id").select("query_id", "doc_id", F.array(place(F.col("bm25").desc()), place(F.col("published_at").desc_nulls_last())).alias("ranks"))
    ranked = c.select("query_id", "doc_id", F.posexplode("ranks").alias("list_id", "rank"))
    return ranking.reciprocal_rank_fusion(ranked).withColumn("rrf", F.round("rrf", 6))


SQL["rrf"] = BM25 + """, c AS (SELECT bm.*, published_at FROM bm JOIN documents USING (doc_id) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY bm25 DESC, doc_id) <= 25),
r AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY bm25 DESC, doc_id) AS rank FROM c UNION ALL SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY date_trunc('second', published_at) DESC NULLS LAST, doc_id) AS rank FROM c),
s AS (SELECT query_id, doc_id, sum(1.0 / (60 + rank)) AS raw FROM r GROUP BY query_id, doc_id) SELECT query_id, doc_id, round(raw / max(raw) OVER (PARTITION BY query_id), 6) AS rrf FROM s"""


def url_dedup(spark: SparkSession, d: str) -> DataFrame:
    return dedup.first_by(results(spark, d), [F.col("query_id"), F.col("url")], [F.col("result_id")]).select("query_id", "result_id", "url")


SQL["url_dedup"] = f"SELECT query_id, result_id, url FROM {RESULTS} QUALIFY row_number() OVER (PARTITION BY query_id, url ORDER BY result_id) = 1"


def url_parts(spark: SparkSession, d: str) -> DataFrame:
    return results(spark, d).select("result_id", F.expr(signals.host(SPARK)).alias("host"), F.expr(signals.normal_url(SPARK)).alias("normal_url"))


SQL["url_parts"] = f"SELECT result_id, {signals.host(DUCK)} AS host, {signals.normal_url(DUCK)} AS normal_url FROM {RESULTS}"


def provider_cap(spark: SparkSession, d: str) -> DataFrame:
    """The first three of each source, then 25 of each query."""
    per = Window.partitionBy("query_id", "provider").orderBy("result_id")
    capped = results(spark, d).select("query_id", "provider", "result_id").withColumn("n", F.row_number().over(per)).where("n <= 3").drop("n")
    return capped.withColumn("pos", F.row_number().over(Window.partitionBy("query_id").orderBy("result_id"))).where("pos <= 25")


SQL["provider_cap"] = f"WITH c AS (SELECT query_id, provider, result_id FROM {RESULTS} QUALIFY row_number() OVER (PARTITION BY query_id, provider ORDER BY result_id) <= 3) SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY result_id) AS pos FROM c QUALIFY pos <= 25"

SIGNALS = {
    "trust": lambda d: signals.trust(),
    "credibility": lambda d: signals.credibility(d),
    "adjusted_trust": signals.adjusted_trust,
    "freshness": lambda d: signals.freshness(d),
    "popularity": signals.popularity,
    "code_quality": signals.code_quality,
    "source_quality": signals.source_quality,
    "has_examples": lambda d: signals.has_examples(d, "coalesce(snippet, title)"),
    "authority": lambda d: signals.authority(d, f"({signals.trust()})"),
    "clickbait": lambda d: signals.clickbait(d, "coalesce(title, '')"),
    "ad_share": lambda d: signals.ad_share(d, "coalesce(snippet, '')"),
}


def _signal(name: str) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        rows = results(spark, d).withColumn("host", F.expr(signals.host(SPARK)))
        return rows.select("result_id", F.round(F.expr(SIGNALS[name](SPARK)).cast("double"), 6).alias(name))

    return run


for _name, _make in SIGNALS.items():
    SQL[f"signal_{_name}"] = f"SELECT result_id, round(({_make(DUCK)})::DOUBLE, 6) AS {_name} FROM (SELECT *, {signals.host(DUCK)} AS host FROM {RESULTS})"


def spam_penalty(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "text").join(ranking.stuffing(table(spark, d, "documents"), "doc_id", "text").withColumnRenamed("id", "doc_id"), "doc_id", "left")
    return docs.select("doc_id", F.round("stuffing", 6).alias("stuffing"), F.expr(signals.spam(SPARK, "text", "coalesce(stuffing, 0.0)", "40")).cast("double").alias("spam"))


SQL["spam_penalty"] = f"""WITH tok AS (SELECT doc_id, {WORDS('text')} AS w FROM documents), tf AS (SELECT doc_id, term, count(*) AS tf, any_value(dl) AS dl FROM (SELECT doc_id, len(w) AS dl, unnest(w) AS term FROM tok) GROUP BY doc_id, term), st2 AS ({STUFFED})
SELECT doc_id, round(stuffing, 6) AS stuffing, ({signals.spam(DUCK, 'text', 'coalesce(stuffing, 0.0)', '40')})::DOUBLE AS spam FROM documents LEFT JOIN st2 USING (doc_id)"""


def _asked(spark: SparkSession, d: str) -> DataFrame:
    return dedup.first_by(table(spark, d, "semantic_cache"), [F.col("entry_id")], [F.col("hit_count").desc(), F.col("created_at")]).select("entry_id", F.col("query_text").alias("query"))


ASKED = "(SELECT entry_id, query_text AS query FROM semantic_cache QUALIFY row_number() OVER (PARTITION BY entry_id ORDER BY hit_count DESC, created_at) = 1)"


def query_plan(spark: SparkSession, d: str) -> DataFrame:
    plan = planner.classify(_asked(spark, d))
    return plan.select("entry_id", "language", "intent", "news_class", "entity_domain", F.array_join(planner.sources(F.col("intent"), F.coalesce("query", F.lit(""))), ",").alias("sources"))


_COUNTS = signals.news_counts(DUCK, "query")
_OWN = " ".join(f"WHEN '{k}' THEN [{', '.join(repr(x) for x in v)}]" for k, v in K.INTENT_SOURCES.items())
_NAMED = "list_concat(" * (len(K.KEYWORD_SOURCES) - 1) + "".join((f"CASE WHEN contains(lower(coalesce(query, '')), '{w}') THEN [{', '.join(repr(x) for x in v)}] ELSE []::VARCHAR[] END" + (")" if i else "") + (", " if i < len(K.KEYWORD_SOURCES) - 1 else "")) for i, (w, v) in enumerate(K.KEYWORD_SOURCES))
_REST = "[" + ", ".join(repr(s[0]) for s in sorted(K.SOURCES, key=lambda s: -s[1])) + "]"
SQL["query_plan"] = f"""WITH p AS (SELECT entry_id, query, {signals.language(DUCK, 'query')} AS language, {signals.intent(DUCK, 'query')} AS intent, {signals.entity_domain(DUCK, 'query')} AS entity_domain, {', '.join(f'{c} AS n_{n}' for n, c in _COUNTS)} FROM {ASKED}),
n AS (SELECT *, {signals.news_class([n for n, _ in _COUNTS])} AS news_class, CASE intent {_OWN} END AS own, {_NAMED} AS named FROM p),
u AS (SELECT *, list_filter(named, lambda x, i: list_position(named, x) = i AND NOT list_contains(own, x)) AS extra FROM n),
a AS (SELECT *, list_concat(list_concat(list_reverse(extra), own), {_REST}) AS every FROM u)
SELECT entry_id, language, intent, news_class, entity_domain, array_to_string(list_slice(list_filter(every, lambda x, i: list_position(every, x) = i), 1, 8), ',') AS sources FROM a"""


def domain_hints(spark: SparkSession, d: str) -> DataFrame:
    return _asked(spark, d).select("entry_id", F.explode(planner.domain_hints(F.col("query"))).alias("domain"))


SQL["domain_hints"] = f"SELECT DISTINCT entry_id, unnest(domains) AS domain FROM {ASKED}, (VALUES {', '.join(f'({w!r}, [{chr(44).join(repr(x) for x in K.TECHNOLOGY_DOMAINS[w])}])' for w in K.TECHNOLOGIES if w in K.TECHNOLOGY_DOMAINS)}) v(word, domains) WHERE contains(lower(query), word)"


def text_flags(spark: SparkSession, d: str) -> DataFrame:
    """Hedging, AI-targeted text, cut snippets and token estimates of the documents."""
    return table(spark, d, "documents").select("doc_id", F.expr(signals.hedged(SPARK, "text")).alias("hedged"), F.expr(signals.ai_targeted(SPARK, "text")).alias("ai_targeted"), F.length(F.when(F.length("text") > 600, F.concat(F.substring("text", 1, 600), F.lit("..."))).otherwise(F.col("text"))).alias("snippet_chars"), budget.estimate_tokens(F.col("text")).cast("bigint").alias("tokens"))


SQL["text_flags"] = f"SELECT doc_id, {signals.hedged(DUCK, 'text')} AS hedged, {signals.ai_targeted(DUCK, 'text')} AS ai_targeted, length(CASE WHEN length(text) > 600 THEN substring(text, 1, 600) || '...' ELSE text END)::INTEGER AS snippet_chars, ceil(length(text) * 0.25)::BIGINT AS tokens FROM documents"


def detected_language(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(F.coalesce("lang", F.lit("none")).alias("lang"), F.expr(signals.language(SPARK, "text")).alias("detected"))
    return docs.groupBy("lang", "detected").agg(F.count("*").alias("docs"))


SQL["detected_language"] = f"SELECT coalesce(lang, 'none') AS lang, {signals.language(DUCK, 'text')} AS detected, count(*) AS docs FROM documents GROUP BY ALL"


def cosine_topk(spark: SparkSession, d: str) -> DataFrame:
    """For each vector whose id is divisible by 100, the ten most similar of all the others."""
    v = vectors.units(table(spark, d, "embeddings"), "vec_id", "embedding", "e")
    queries = v.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("e").alias("q"))
    pairs = vectors.against_all(queries, v).where("vec_id <> query_id").select("query_id", "vec_id", F.round("cosine", 6).alias("cosine"))
    return ranking.top_per_query(pairs, 10, "cosine", "vec_id").select("query_id", "vec_id", "rank", "cosine")


SQL["cosine_topk"] = "SELECT q.vec_id AS query_id, v.vec_id, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(v.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) DESC, v.vec_id) AS rank, round(list_cosine_similarity(v.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS cosine FROM embeddings v, embeddings q WHERE q.vec_id % 100 = 0 AND v.vec_id <> q.vec_id QUALIFY rank <= 10"


def cache_probe(spark: SparkSession, d: str) -> DataFrame:
    """Cached queries whose id is divisible by 100 looked up among the other entries that are alive."""
    entries = dedup.first_by(table(spark, d, "semantic_cache"), [F.col("entry_id")], [F.col("hit_count").desc(), F.col("created_at")])
    asked = vectors.units(entries.where("entry_id % 100 = 0"), "entry_id", "embedding", "q").withColumnRenamed("entry_id", "query_id")
    alive = entries.where(F.expr(f"expires_at IS NULL OR expires_at > {CACHE_NOW}"))
    near = vectors.within(asked, vectors.units(alive, "entry_id", "embedding", "e"), 0.92).where("query_id <> entry_id").withColumn("cosine", F.round("cosine", 6))
    return ranking.top_per_query(near, 1, "cosine", "entry_id").select("query_id", "entry_id", "cosine")


CACHE_NOW = "TIMESTAMP '2023-01-01 00:00:00'"
SQL["cache_probe"] = f"""WITH o AS (SELECT * FROM semantic_cache QUALIFY row_number() OVER (PARTITION BY entry_id ORDER BY hit_count DESC, created_at) = 1), v AS (SELECT entry_id, embedding::DOUBLE[] AS e, expires_at FROM o WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
p AS (SELECT q.entry_id AS query_id, v.entry_id, round(list_cosine_similarity(q.e, v.e), 6) AS cosine FROM v q JOIN v ON len(q.e) = len(v.e) AND q.entry_id <> v.entry_id WHERE q.entry_id % 100 = 0 AND (v.expires_at IS NULL OR v.expires_at > {CACHE_NOW}) AND list_cosine_similarity(q.e, v.e) >= 0.92)
SELECT query_id, entry_id, cosine FROM p QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, entry_id) = 1"""


def search_results(spark: SparkSession, d: str) -> DataFrame:
    """The whole pipeline: items searched in the results of all sources."""
    return search.search(_items(spark, d), results(spark, d))


def research_sources(spark: SparkSession, d: str) -> DataFrame:
    return search.research(_items(spark, d), results(spark, d))


def _judged(spark: SparkSession, d: str) -> DataFrame:
    """Results of each query in order, judged against its first one: the same address or a like title, else shared words."""
    rows = results(spark, d).select("query_id", "result_id", "url", F.coalesce("title", F.lit("")).alias("title"), F.coalesce("snippet", F.lit("")).alias("snippet"), "provider")
    by = Window.partitionBy("query_id").orderBy("result_id")
    rows = rows.withColumn("pos", F.row_number().over(by)).withColumn("first_url", F.first("url").over(by)).withColumn("first_title", F.first("title").over(by))
    rows = rows.withColumn("a", F.expr(signals.title_words(SPARK, "title"))).withColumn("b", F.expr(signals.title_words(SPARK, "first_title")))
    shared = F.size(F.filter("b", lambda w: F.contains(F.lower(F.concat("title", F.lit(" "), "snippet")), w))) / F.greatest(F.size("b"), F.lit(1))
    like = F.expr(signals.jaccard(SPARK, "a", "b"))
    rel = F.when((F.col("url") == F.col("first_url")) | (like >= 0.4), 3).when(shared >= 0.66, 3).when(shared >= 0.5, 2).when(shared >= 0.33, 1).when(shared >= 0.15, 0).otherwise(-1)
    return rows.select("query_id", "pos", rel.alias("rel"), "provider")


_JUDGED = f"""WITH o AS (SELECT query_id, result_id, url, coalesce(title, '') AS title, coalesce(snippet, '') AS snippet, provider, row_number() OVER w AS pos, first(url) OVER w AS first_url, first(coalesce(title, '')) OVER w AS first_title FROM {RESULTS} WINDOW w AS (PARTITION BY query_id ORDER BY result_id)),
t AS (SELECT *, {signals.title_words(DUCK, 'title')} AS a, {signals.title_words(DUCK, 'first_title')} AS b FROM o),
s AS (SELECT *, {signals.jaccard(DUCK, 'a', 'b')} AS j, len(list_filter(b, lambda w: contains(lower(title || ' ' || snippet), w))) * 1.0 / greatest(len(b), 1) AS sh FROM t),
judged AS (SELECT query_id, pos, CASE WHEN url = first_url OR j >= 0.4 THEN 3 WHEN sh >= 0.66 THEN 3 WHEN sh >= 0.5 THEN 2 WHEN sh >= 0.33 THEN 1 WHEN sh >= 0.15 THEN 0 ELSE -1 END AS rel, provider FROM s)"""


def judge_match(spark: SparkSession, d: str) -> DataFrame:
    return _judged(spark, d)


SQL["judge_match"] = _JUDGED + " SELECT query_id, pos, rel, provider FROM judged"


def retrieval_metrics(spark: SparkSession, d: str) -> DataFrame:
    m = evaluate.metrics(_judged(spark, d))
    return m.select("query_id", *[F.round(c, 6).alias(c) for c in m.columns if c not in ("query_id", "diversity")], "diversity")


_METRICS = (
    _JUDGED
    + """, r AS (SELECT *, (rel >= 1)::INT AS hit, row_number() OVER (PARTITION BY query_id ORDER BY rel DESC, pos) AS ideal FROM judged),
c AS (SELECT *, sum(hit) OVER w AS hits, sum(1 - hit) OVER w AS misses, sum(1 - hit) OVER (PARTITION BY query_id) AS alls FROM r WINDOW w AS (PARTITION BY query_id ORDER BY pos ROWS UNBOUNDED PRECEDING)),
g AS (SELECT query_id, count(*) AS n, sum(hit) AS found, sum(CASE WHEN pos <= 5 THEN hit ELSE 0 END) AS h5, sum(CASE WHEN pos <= 10 THEN hit ELSE 0 END) AS h10, sum(CASE WHEN pos <= 5 THEN rel / log2(pos + 1) ELSE 0 END) AS d5, sum(CASE WHEN pos <= 10 THEN rel / log2(pos + 1) ELSE 0 END) AS d10,
 sum(CASE WHEN ideal <= 5 THEN rel / log2(ideal + 1) ELSE 0 END) AS i5, sum(CASE WHEN ideal <= 10 THEN rel / log2(ideal + 1) ELSE 0 END) AS i10, min(CASE WHEN hit = 1 THEN pos END) AS f, sum(CASE WHEN hit = 1 AND pos <= 10 THEN hits * 1.0 / pos ELSE 0 END) AS ap,
 sum(CASE WHEN hit = 1 THEN 1 - CASE WHEN alls > 0 THEN misses * 1.0 / alls ELSE 0 END ELSE 0 END) AS bp, count(DISTINCT provider) AS diversity FROM c GROUP BY query_id),
metrics AS (SELECT query_id, h5 * 1.0 / least(n, 5) AS p5, h10 * 1.0 / least(n, 10) AS p10, h10 * 1.0 / greatest(found, 3) AS r10, CASE WHEN i5 > 0 THEN d5 / i5 ELSE 0 END AS ndcg5, CASE WHEN i10 > 0 THEN d10 / i10 ELSE 0 END AS ndcg10, coalesce(1.0 / f, 0) AS mrr, ap / greatest(found, 3) AS map, CASE WHEN found > 0 THEN bp / found ELSE 0 END AS bpref, diversity FROM g)"""
)
_MEASURES = ("p5", "p10", "r10", "ndcg5", "ndcg10", "mrr", "map", "bpref")
SQL["retrieval_metrics"] = _METRICS + " SELECT query_id, " + ", ".join(f"round(({m})::DOUBLE, 6) AS {m}" for m in _MEASURES) + ", diversity FROM metrics"


def metrics_summary(spark: SparkSession, d: str) -> DataFrame:
    s = evaluate.summary(evaluate.metrics(_judged(spark, d)))
    return s.select("queries", *[F.round(c, 5).alias(c) for c in (*_MEASURES, "diversity", "score")])


SQL["metrics_summary"] = _METRICS + ", m AS (SELECT count(*) AS queries, " + ", ".join(f"avg({m})::DOUBLE AS {m}" for m in (*_MEASURES, "diversity")) + " FROM metrics) SELECT queries, " + ", ".join(f"round({m}, 5) AS {m}" for m in (*_MEASURES, "diversity")) + ", round(25 * p5 + 20 * ndcg5 + 15 * mrr + 10 * least(diversity / 5, 1) + 30, 5) AS score FROM m"


def threshold_violations(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.violations(evaluate.metrics(_judged(spark, d))).withColumn("value", F.round("value", 6))


SQL["threshold_violations"] = _METRICS + " " + " UNION ALL ".join(f"SELECT query_id, '{m}' AS metric, round({m}::DOUBLE, 6) AS value, {t}::DOUBLE AS threshold FROM metrics WHERE {m} < {t}" for m, t in evaluate.THRESHOLDS.items())


def budget_truncate(spark: SparkSession, d: str) -> DataFrame:
    rows = results(spark, d).select("query_id", "result_id", "title", "snippet").withColumn("pos", F.row_number().over(Window.partitionBy("query_id").orderBy("result_id")))
    return budget.within_budget(rows, budget.budget(600, 200)).select("query_id", "result_id", "pos", F.col("used_chars").cast("bigint").alias("used_chars"))


SQL["budget_truncate"] = f"""WITH o AS (SELECT query_id, result_id, substring(title, 1, 200) AS title, substring(coalesce(snippet, ''), 1, 200) AS snippet, row_number() OVER (PARTITION BY query_id ORDER BY result_id) AS pos FROM {RESULTS})
SELECT query_id, result_id, pos, (sum(length(coalesce(title, '')) + length(snippet)) OVER (PARTITION BY query_id ORDER BY pos ROWS UNBOUNDED PRECEDING))::BIGINT AS used_chars FROM o QUALIFY used_chars <= 2200 AND pos <= 11"""


def context_strings(spark: SparkSession, d: str) -> DataFrame:
    rows = results(spark, d).select("query_id", "title", "snippet", "result_id").withColumn("pos", F.row_number().over(Window.partitionBy("query_id").orderBy("result_id")))
    return budget.context(rows)


SQL["context_strings"] = f"""WITH o AS (SELECT query_id, title, snippet, row_number() OVER (PARTITION BY query_id ORDER BY result_id) AS pos FROM {RESULTS})
SELECT query_id, string_agg('[' || pos || '] ' || coalesce(title, '') || chr(10) || substring(coalesce(snippet, ''), 1, 1500), chr(10) || chr(10) ORDER BY pos) AS context FROM o WHERE pos <= 6 GROUP BY query_id"""


def answer_confidence(spark: SparkSession, d: str) -> DataFrame:
    """Each query's first six results as citations of an answer that is its first snippet."""
    rows = results(spark, d).withColumn("pos", F.row_number().over(Window.partitionBy("query_id").orderBy("result_id"))).where("pos <= 6").withColumn("host", F.expr(signals.host(SPARK))).withColumn("trust", F.expr(signals.trust()))
    g = rows.groupBy("query_id").agg(F.count("*").alias("n"), F.avg("trust").alias("t"), F.max(F.col("trust") >= 95).alias("official"), F.max(F.contains(F.coalesce("snippet", F.lit("")), F.lit("`"))).alias("code"), F.max(F.when(F.col("pos") == 1, F.coalesce("snippet", F.lit("")))).alias("summary"))
    return g.select("query_id", research.confidence(F.col("n"), F.col("t"), F.col("official"), F.col("code"), F.lit(0), F.lit(0.4), F.col("summary")).cast("double").alias("confidence"))


SQL["answer_confidence"] = f"""WITH o AS (SELECT *, {signals.host(DUCK)} AS host, row_number() OVER (PARTITION BY query_id ORDER BY result_id) AS pos FROM {RESULTS}), t AS (SELECT *, {signals.trust()} AS trust FROM o WHERE pos <= 6),
g AS (SELECT query_id, count(*) AS n, avg(trust) AS t, bool_or(trust >= 95) AS official, bool_or(contains(coalesce(snippet, ''), '`')) AS code, max(CASE WHEN pos = 1 THEN coalesce(snippet, '') END) AS summary FROM t GROUP BY query_id)
SELECT query_id, greatest(0.0, least(100.0, floor((40 + least(8.0 * n, 32) + t / 100 * 20 + CASE WHEN official THEN 10 ELSE 0 END + CASE WHEN code THEN 5 ELSE 0 END) * (0.4 / 0.5) - CASE WHEN {signals.hedged(DUCK, 'summary')} THEN 35 ELSE 0 END + 0.5)))::DOUBLE AS confidence FROM g"""


def citation_list(spark: SparkSession, d: str) -> DataFrame:
    found = table(spark, d, "extractions").where("url IS NOT NULL").withColumn("content_hash", F.sha2(F.coalesce("markdown", F.lit("")), 256)).groupBy("url").agg(F.min("content_hash").alias("content_hash"))
    pages = table(spark, d, "readable_pages").where("url IS NOT NULL").select("page_id", "url").unionByName(table(spark, d, "extractions").where("url IS NOT NULL").select(F.col("extraction_id").alias("page_id"), "url")).distinct()
    return pages.join(found, "url", "left").select("page_id", "url", "content_hash")


SQL["citation_list"] = "WITH f AS (SELECT url, min(sha256(coalesce(markdown, ''))) AS content_hash FROM extractions WHERE url IS NOT NULL GROUP BY url), p AS (SELECT page_id, url FROM readable_pages WHERE url IS NOT NULL UNION SELECT extraction_id, url FROM extractions WHERE url IS NOT NULL) SELECT page_id, url, content_hash FROM p LEFT JOIN f USING (url)"


def page_links(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "extractions").select("extraction_id", "markdown").distinct()
    return docs.select("extraction_id", F.posexplode(extract.markdown_links(F.col("markdown"))).alias("n", "link"))


SQL["page_links"] = r"WITH l AS (SELECT extraction_id, regexp_extract_all(markdown, '\[[^\]]*\]\((https?://[^)]+)\)', 1) AS links FROM (SELECT DISTINCT extraction_id, markdown FROM extractions)) SELECT extraction_id, (unnest(range(len(links))))::INTEGER AS n, unnest(links) AS link FROM l"


def articles(spark: SparkSession, d: str) -> DataFrame:
    return extract.articles(table(spark, d, "readable_pages"), id_col="page_id", html="content_html").dropDuplicates(["id"])


def code_blocks(spark: SparkSession, d: str) -> DataFrame:
    return extract.blocks(dedup.first_by(table(spark, d, "extractions"), [F.col("extraction_id")], [F.col("extracted_at").desc()]), id_col="extraction_id", markdown="markdown")


def crawl(spark: SparkSession, d: str) -> DataFrame:
    """From the pages of the extractions over their absolute links."""
    docs = table(spark, d, "extractions").where("url IS NOT NULL").select("url", "markdown").distinct()
    links = docs.select(F.col("url").alias("source"), F.explode(extract.markdown_links(F.col("markdown"))).alias("target"))
    return extract.crawl(docs.select("url"), links, same_host=False)


_CLEAN = r"lower(regexp_replace(regexp_replace({x}, '[?#].*$', ''), '/+$', ''))"
_FILES = " OR ".join(f"ends_with(lower(regexp_replace(t, '[?#].*$', '')), '{e}')" for e in K.SKIPPED_EXTENSIONS)
SQL["crawl"] = rf"""WITH RECURSIVE d AS (SELECT DISTINCT url, markdown FROM extractions WHERE url IS NOT NULL), l AS (SELECT url AS s, unnest(regexp_extract_all(markdown, '\[[^\]]*\]\((https?://[^)]+)\)', 1)) AS t FROM d),
ed AS (SELECT DISTINCT {_CLEAN.format(x="s")} AS source, {_CLEAN.format(x="t")} AS target FROM l WHERE NOT ({_FILES})), r AS (SELECT DISTINCT {_CLEAN.format(x="url")} AS url, 0 AS depth FROM d UNION SELECT target, depth + 1 FROM r JOIN ed ON r.url = ed.source WHERE depth < 3)
SELECT url, min(depth)::INTEGER AS depth FROM r GROUP BY url"""


def greedy_dedup(spark: SparkSession, d: str) -> DataFrame:
    return dedup.greedy(table(spark, d, "embeddings").select("vec_id", "label", "embedding"), group="label", position="vec_id", vector="embedding")


def provider_results(spark: SparkSession, d: str) -> DataFrame:
    """The four feeds in the common result schema."""
    feeds = [registry.hackernews(table(spark, d, "hn_hits")), registry.googlenews(table(spark, d, "gnews_articles")), registry.gdelt(table(spark, d, "gdelt_articles")), registry.stackexchange(table(spark, d, "se_items"))]
    return registry.federate(feeds).groupBy("provider").agg(F.count("*").alias("results"), F.count_if(F.length("title") > 0).alias("titled"), F.countDistinct("author").alias("authors"))


SQL["provider_results"] = """SELECT 'hackernews' AS provider, count(*) AS results, count_if(length(coalesce(title, story_title, '')) > 0)::BIGINT AS titled, count(DISTINCT author) AS authors FROM hn_hits UNION ALL SELECT 'googlenews', count(*), count_if(length(title) > 0)::BIGINT, count(DISTINCT coalesce(creator[1], source_id)) FROM gnews_articles
UNION ALL SELECT 'gdelt', count(*), count_if(length(title) > 0)::BIGINT, count(DISTINCT domain_name) FROM gdelt_articles UNION ALL SELECT 'stackexchange', count(*), count_if(length(title) > 0)::BIGINT, count(DISTINCT owner_name) FROM se_items"""


def source_registry(spark: SparkSession, d: str) -> DataFrame:
    used = results(spark, d).groupBy("provider").agg(F.count("*").alias("results"))
    return registry.providers(spark).join(used, "provider", "left").select("provider", "priority", "cap", F.coalesce("results", F.lit(0)).cast("bigint").alias("results"))


SQL["source_registry"] = f"SELECT v.provider, priority, cap, coalesce(results, 0)::BIGINT AS results FROM (VALUES {', '.join(f'({p!r}, {n}, {c})' for p, n, c, _ in K.SOURCES)}) v(provider, priority, cap) LEFT JOIN (SELECT provider, count(*) AS results FROM {RESULTS} GROUP BY provider) u USING (provider)"


def rate_windows(spark: SparkSession, d: str) -> DataFrame:
    return state.rate_windows(table(spark, d, "events"), length="1 hour", limit=1)


SQL["rate_windows"] = "SELECT user_id, time_bucket(INTERVAL 1 HOUR, ts) AS window_start, count(*) AS n, count(*) > 1 AS limited FROM events GROUP BY ALL"


def value_histogram(spark: SparkSession, d: str) -> DataFrame:
    bounds = (1, 5, 10, 25, 50, 100, 250, 500)
    return table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"), *[F.count_if(F.col("value") <= b).alias(f"le_{b}") for b in bounds])


SQL["value_histogram"] = "SELECT event_type, count(*) AS n, round(sum(value), 4) AS total, " + ", ".join(f"count_if(value <= {b})::BIGINT AS le_{b}" for b in (1, 5, 10, 25, 50, 100, 250, 500)) + " FROM events GROUP BY event_type"


def usage_analytics(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day"), "event_type").agg(F.count("*").alias("events"), F.countDistinct("user_id").alias("users"), F.round(F.avg("value"), 6).alias("mean"), F.round(F.expr("percentile(value, 0.95)"), 6).alias("p95"))


SQL["usage_analytics"] = "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS events, count(DISTINCT user_id) AS users, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.95), 6) AS p95 FROM events GROUP BY ALL"


def watch_alerts(spark: SparkSession, d: str) -> DataFrame:
    """Events of a user as results, watched since the user's first one."""
    e = table(spark, d, "events")
    subs = e.groupBy(F.col("user_id").alias("query")).agg(F.min("ts").alias("last_checked")).withColumn("threshold", F.lit(50.0))
    return state.watch_alerts(e.select(F.col("user_id").alias("query"), F.col("ts").alias("published"), F.col("value").alias("score"), "event_id"), subs).select("query", "event_id", "published")


SQL["watch_alerts"] = "SELECT user_id AS query, event_id, ts AS published FROM events JOIN (SELECT user_id, min(ts) AS last_checked FROM events GROUP BY user_id) USING (user_id) WHERE ts > last_checked AND value >= 50"

_FOLD = T.StructType([T.StructField("score", T.DoubleType()), T.StructField("signals", T.LongType())])
_MEMORY = T.StructType([T.StructField("used", T.LongType()), T.StructField("mean", T.DoubleType())])
_CIRCUIT = T.StructType([T.StructField(c, T.LongType()) for c in ("failures", "opened_ms", "wait_ms", "blocked")])


def credibility_fold(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("user_id", "ts", "event_id", F.coalesce("value", F.lit(0.0)).alias("signal"))
    return state.fold(e, key="user_id", order=["ts", "event_id"], step=state.credibility, state_schema=_FOLD)


def memory_fold(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("user_id", "ts", "event_id", F.coalesce("value", F.lit(0.0)).alias("score"))
    return state.fold(e, key="user_id", order=["ts", "event_id"], step=state.memory, state_schema=_MEMORY)


def circuit_fold(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("user_id", "ts", "event_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("at_ms"), (F.col("event_type") == "error").alias("failed"))
    return state.fold(e, key="user_id", order=["ts", "event_id"], step=state.circuit, state_schema=_CIRCUIT)


_EVENTS = "WITH RECURSIVE e AS (SELECT user_id, coalesce(value, 0.0)::DOUBLE AS v, event_type = 'error' AS failed, epoch_us(ts) // 1000 AS ms, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events), "
_LAST = "FROM f QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC) = 1"
SQL["credibility_fold"] = (
    _EVENTS
    + f"""f AS (SELECT user_id, n, greatest(0.0, least(100.0, v)) AS score, 1::BIGINT AS signals FROM e WHERE n = 1 UNION ALL
 SELECT user_id, n, greatest(0.0, least(100.0, CASE WHEN s >= 0 THEN floor(s + 0.5) ELSE 0.0 END)), signals + 1 FROM (SELECT e.user_id, e.n, signals, CASE WHEN signals < 10 THEN score + v ELSE 0.95 * score + 0.05 * v END AS s FROM f JOIN e ON e.user_id = f.user_id AND e.n = f.n + 1))
SELECT user_id, score, signals {_LAST}"""
)
SQL["memory_fold"] = (
    _EVENTS
    + f"""f AS (SELECT user_id, n, 1::BIGINT AS used, floor(v * 100 + 0.5) / 100 AS mean FROM e WHERE n = 1 UNION ALL
 SELECT e.user_id, e.n, used + 1, floor((mean * used + v) / (used + 1) * 100 + 0.5) / 100 FROM f JOIN e ON e.user_id = f.user_id AND e.n = f.n + 1)
SELECT user_id, used, mean {_LAST}"""
)
SQL["circuit_fold"] = (
    _EVENTS
    + f"""f AS (SELECT user_id, 0::BIGINT AS n, 0::BIGINT AS failures, 0::BIGINT AS opened_ms, 0::BIGINT AS wait_ms, 0::BIGINT AS blocked FROM e WHERE n = 1 UNION ALL
 SELECT user_id, n, CASE WHEN shut THEN failures WHEN failed THEN failures + 1 ELSE 0 END, CASE WHEN shut THEN opened_ms WHEN failed AND failures >= 2 THEN ms ELSE 0 END,
  CASE WHEN shut THEN wait_ms WHEN failed AND failures >= 2 THEN least(30000 * pow(2, failures - 2), 300000)::BIGINT ELSE 0 END, blocked + shut::INT
 FROM (SELECT e.user_id, e.n, e.failed, e.ms, failures, opened_ms, wait_ms, blocked, failures >= 3 AND e.ms <= opened_ms + wait_ms AS shut FROM f JOIN e ON e.user_id = f.user_id AND e.n = f.n + 1))
SELECT user_id, failures, opened_ms, wait_ms, blocked {_LAST}"""
)


def best_sources(spark: SparkSession, d: str) -> DataFrame:
    """Hosts by the mean trust of their results, most used first among equals."""
    rows = results(spark, d).withColumn("host", F.expr(signals.host(SPARK))).withColumn("trust", F.expr(signals.trust()))
    return rows.where("host IS NOT NULL").groupBy("host", "provider").agg(F.count("*").alias("used"), F.round(F.avg("trust"), 4).alias("mean_trust")).orderBy(F.col("mean_trust").desc(), F.col("used").desc(), "host", "provider").limit(10)


SQL["best_sources"] = f"SELECT host, provider, count(*) AS used, round(avg({signals.trust()}), 4) AS mean_trust FROM (SELECT provider, {signals.host(DUCK)} AS host FROM {RESULTS}) WHERE host IS NOT NULL GROUP BY host, provider ORDER BY mean_trust DESC, used DESC, host, provider LIMIT 10"


def order_revenue(spark: SparkSession, d: str) -> DataFrame:
    """Revenue by nation and status over the star schema."""
    line = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("revenue"))
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    named = table(spark, d, "customer").select("c_custkey", "c_nationkey").join(F.broadcast(table(spark, d, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    return orders.join(line, F.col("o_orderkey") == F.col("l_orderkey")).join(named, F.col("o_custkey") == F.col("c_custkey")).groupBy("n_name", "o_orderstatus").agg(F.count("*").alias("orders"), F.round(F.sum("revenue"), 2).alias("revenue"))


SQL["order_revenue"] = "SELECT n_name, o_orderstatus, count(*) AS orders, round(sum(revenue), 2) AS revenue FROM orders JOIN (SELECT l_orderkey, sum(l_extendedprice * (1 - l_discount)) AS revenue FROM lineitem GROUP BY l_orderkey) l ON o_orderkey = l_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name, o_orderstatus"


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Items searched in the documents: BM25, all signals, fusion, the first ten of each."""
    return final_scores(spark, d)


NAMES = (
    "p4_found p4_instants p4_zones exact_dedup token_stats term_freq doc_freq bm25_topk final_scores reranked rrf url_dedup url_parts provider_cap spam_penalty query_plan domain_hints text_flags detected_language cosine_topk cache_probe search_results research_sources judge_match retrieval_metrics "
    "metrics_summary threshold_violations budget_truncate context_strings answer_confidence citation_list page_links articles code_blocks crawl greedy_dedup provider_results source_registry rate_windows value_histogram usage_analytics watch_alerts credibility_fold memory_fold circuit_fold best_sources order_revenue"
).split()


def queries() -> dict[str, Query]:
    return {**{n: globals()[n] for n in NAMES}, **{f"signal_{n}": _signal(n) for n in SIGNALS}, **more_queries.queries()}


def oracle_sql() -> dict[str, str]:
    return {**SQL, **more_queries.oracle_sql()}
