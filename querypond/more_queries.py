"""Queries of the connectors, of planning with entities, of answers, and of the evaluation with judgments; their SQL beside them."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from querypond import constants as K
from querypond.functions import signals
from querypond.functions.dialect import DUCK, SPARK
from querypond.operators import answers, budget, dedup, evaluate, extract, research
from querypond.plans import entities, planner
from querypond.runtime import table
from querypond.sources import registry
from querypond.streaming import state

Query = Callable[[SparkSession, str], DataFrame]
SQL: dict[str, str] = {}
RESULTS = "(SELECT * FROM search_results QUALIFY row_number() OVER (PARTITION BY result_id ORDER BY ingested_at, fetched_at) = 1)"
HTML = r"regexp_replace({x}, '<[^>]+>', '', 'g')"


def _results(spark: SparkSession, d: str) -> DataFrame:
    return dedup.first_by(table(spark, d, "search_results"), [F.col("result_id")], [F.col("ingested_at"), F.col("fetched_at")])


def _ranked(spark: SparkSession, d: str) -> DataFrame:
    return _results(spark, d).withColumn("pos", F.row_number().over(Window.partitionBy("query_id").orderBy("result_id")))


def _literal(x) -> str:
    return "NULL" if x is None else str(x) if isinstance(x, int | float) else "'" + str(x).replace("'", "''") + "'"


# Connectors: a payload of each source, and the rows that it means, written by hand.
PAYLOADS: dict[str, tuple[str, list[tuple]]] = {
    "brave": ('{"web": {"results": [{"url": "https://a.example/1", "title": "One", "description": "first", "age": "2 days ago"}]}}', [("brave-https://a.example/1", "https://a.example/1", "One", "first", "2 days ago", None)]),
    "devto": ('[{"id": 7, "url": "https://dev.to/7", "title": "Seven", "description": "d", "published_at": "2024-05-01T00:00:00Z", "user": {"name": "Ann"}}]', [("devto-7", "https://dev.to/7", "Seven", "d", "2024-05-01T00:00:00Z", "Ann")]),
    "npm": ('{"objects": [{"package": {"name": "left", "version": "1.2.3", "description": "pads", "date": "2024-01-01", "links": {"npm": "https://npmjs.com/left"}, "publisher": {"username": "bo"}}}, {"package": {"name": "bare", "version": "0.1.0", "links": {}}}]}', [("npm-left@1.2.3", "https://npmjs.com/left", "left", "pads", "2024-01-01", "bo"), ("npm-bare@0.1.0", None, "bare", None, None, None)]),
    "github": ('{"items": [{"id": 5, "html_url": "https://github.com/o/r", "full_name": "o/r", "description": null, "pushed_at": "2024-02-02T00:00:00Z", "owner": {"login": "o"}}]}', [("github-repo-5", "https://github.com/o/r", "o/r", None, "2024-02-02T00:00:00Z", "o")]),
    "crossref": ('{"message": {"items": [{"DOI": "10.1/a/b", "title": ["T"], "abstract": "<p>An <i>abstract</i></p>", "created": {"date-time": "2023-01-01T00:00:00Z"}, "author": [{"given": "Ann", "family": "Lee"}]}, {"DOI": "10.2/c", "URL": "https://x.example/c", "author": [{"family": "Kim"}]}]}}', [("crossref-10.1-a-b", "https://doi.org/10.1/a/b", "T", "An abstract", "2023-01-01T00:00:00Z", "Ann Lee"), ("crossref-10.2-c", "https://x.example/c", "10.2/c", None, None, "Kim")]),
    "semanticscholar": ('{"data": [{"paperId": "p1", "url": "https://s2.example/p1", "title": "P", "abstract": null, "venue": "V", "publicationDate": "2022-03-04", "authors": [{"name": "A B"}]}]}', [("s2-p1", "https://s2.example/p1", "P", "V", "2022-03-04", "A B")]),
    "wikipedia": ('{"query": {"search": [{"pageid": 42, "title": "Fox", "snippet": "a <span class=\\"m\\">red</span> fox", "timestamp": "2024-01-01T00:00:00Z"}]}}', [("wikipedia-42", "https://en.wikipedia.org/?curid=42", "Fox", "a red fox", "2024-01-01T00:00:00Z", None)]),
    "mdn": ('{"hits": [{"mdn_url": "/en-US/docs/Web/API/fetch", "title": "fetch", "summary": "gets"}, {"mdn_url": "https://developer.mozilla.org/x", "title": "x", "summary": "y"}]}', [("mdn-Web-API-fetch", "https://developer.mozilla.org/en-US/docs/Web/API/fetch", "fetch", "gets", None, None), ("mdn-https:--developer.mozilla.org-x", "https://developer.mozilla.org/x", "x", "y", None, None)]),
    "osv": ('{"results": [{"id": "OSV-1", "summary": "", "aliases": ["CVE-1"], "published": "2024-01-02"}, {"id": "OSV-2", "summary": "bad"}, {"id": "OSV-3"}]}', [("osv-OSV-1", "https://osv.dev/vulnerability/OSV-1", "OSV-1", "CVE-1", "2024-01-02", None), ("osv-OSV-2", "https://osv.dev/vulnerability/OSV-2", "OSV-2", "bad", None, None), ("osv-OSV-3", "https://osv.dev/vulnerability/OSV-3", "OSV-3", "No description", None, None)]),
    "cve": ('[{"id": "CVE-2024-1", "summary": "overflow", "published_at": "2024-01-03"}]', [("cve-CVE-2024-1", "https://nvd.nist.gov/vuln/detail/CVE-2024-1", "CVE-2024-1", "overflow", "2024-01-03", None)]),
    "internetarchive": ('{"response": {"docs": [{"identifier": "i1", "title": "", "mediatype": "texts", "date": "1999"}, {"identifier": "i2", "title": "Two", "description": "d"}]}}', [("ia-i1", "https://archive.org/details/i1", "i1", "Internet Archive — texts", "1999", None), ("ia-i2", "https://archive.org/details/i2", "Two", "d", None, None)]),
    "wikidata": ('{"results": {"bindings": [{"item": {"value": "http://www.wikidata.org/entity/Q1"}, "itemLabel": {"value": "universe"}, "itemDescription": {"value": "all"}}]}}', [("wikidata-Q1", "http://www.wikidata.org/entity/Q1", "universe", "all", None, None)]),
    "reddit": ('{"data": {"children": [{"data": {"id": "z", "url": "/r/x/z", "permalink": "/r/x/z/", "title": "Z", "selftext": "long text", "author": "me", "subreddit": "x", "score": 5, "num_comments": 2, "created_utc": 1700000000.0}}, {"data": {"id": "y", "url": "https://i.example/y", "title": "Y", "selftext": "", "author": "you", "created_utc": 0}}]}}', [("reddit-z", "https://www.reddit.com/r/x/z/", "Z", "[r/x] [👍5 💬2] long text", "2023-11-14T22:13:20Z", "u/me"), ("reddit-y", "https://i.example/y", "Y", "[] [👍? 💬?]", "1970-01-01T00:00:00Z", "u/you")]),
    "pubmed": ('{"result": {"items": [{"uid": "9", "title": "Nine", "source": "J", "pubdate": "2020", "authors": [{"name": "C D"}]}]}}', [("pubmed-9", "https://pubmed.ncbi.nlm.nih.gov/9/", "Nine", "J", "2020", "C D")]),
}
FIELDS = ("id", "url", "title", "snippet", "published_at", "author")


def _connector(provider: str) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        path, fields = registry.JSON_SOURCES[provider]
        payloads = spark.createDataFrame([(PAYLOADS[provider][0],), ("{}",), (None,)], "body string")
        return registry.from_json(payloads, provider, path=path, fields=fields).select(*FIELDS)

    return run


for _p, (_, _rows) in PAYLOADS.items():
    SQL[f"source_{_p}"] = f"SELECT {', '.join(f'{f}::VARCHAR AS {f}' for f in FIELDS)} FROM (VALUES {', '.join('(' + ', '.join(map(_literal, r)) + ')' for r in _rows)}) v({', '.join(FIELDS)})"


def feed_results(spark: SparkSession, d: str) -> DataFrame:
    """All records of the feeds with titles and links in the common schema."""
    feeds = [registry.hackernews(table(spark, d, "hn_hits")), registry.gdelt(table(spark, d, "gdelt_articles")), registry.stackexchange(table(spark, d, "se_items")), registry.googlenews(table(spark, d, "gnews_articles"))]
    rows = reduce(DataFrame.unionByName, feeds)
    return rows.select("provider", "id", "url", "title", "snippet", "author")


_PLAIN = r"trim(regexp_replace(regexp_replace({x}, '<[^>]*>', ' ', 'g'), '[ \t\n\r\f\x0B]+', ' ', 'g'))"
SQL["feed_results"] = f"""SELECT 'hackernews' AS provider, object_id::VARCHAR AS id, coalesce(url, 'https://news.ycombinator.com/item?id=' || object_id) AS url, coalesce(title, story_title, '') AS title, {_PLAIN.format(x="coalesce(comment_text, story_title, title)")} AS snippet, author FROM hn_hits
UNION ALL SELECT 'gdelt', substring(to_base64(encode(url)), 1, 32), url, title, title, domain_name FROM gdelt_articles
UNION ALL SELECT 'stackexchange', question_id::VARCHAR, link_url, title, substring({HTML.format(x='body_html')}, 1, 300), owner_name FROM se_items
UNION ALL SELECT 'googlenews', article_id::VARCHAR, link_url, title, {_PLAIN.format(x="coalesce(description, content_text)")}, coalesce(creator[1], source_id) FROM gnews_articles"""

# Planning. Queries that name what the tables' own hardly do.
ASKED = [
    (1, "best autonomous coding agent with langgraph or crewai on github"), (2, "DEF CON CTF ransomware exploit writeups latest news"), (3, "LLM survey benchmark paper on arxiv"), (4, "youtube tutorial for deno and vite"), (5, "data breach vulnerability malware news"), (6, "reddit thread about npm and pypi"), (7, "cooking pasta"),
]
ASKED_SQL = "(VALUES " + ", ".join(f"({i}, {_literal(q)})" for i, q in ASKED) + ") a(query_id, query)"


def _asked(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ASKED, "query_id int, query string")


def known_repositories(spark: SparkSession, d: str) -> DataFrame:
    return registry.known_repositories(_asked(spark)).select("query_id", "id", "url", "title", "author")


SQL["known_repositories"] = f"""WITH k AS (SELECT * FROM (VALUES {', '.join(f'({i}, {_literal(n)}, {_literal(r)})' for i, (n, r) in enumerate(K.KNOWN_REPOSITORIES.items()))}) v(i, name, repo)),
m AS (SELECT query_id, repo FROM {ASKED_SQL}, k WHERE contains(lower(query), name) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY i) <= 3)
SELECT query_id, 'github-repo-' || replace(repo, '/', '-') AS id, 'https://github.com/' || repo AS url, repo AS title, split_part(repo, '/', 1) AS author FROM m"""


def source_boosts(spark: SparkSession, d: str) -> DataFrame:
    """Boosts of sources above one, by the words of queries and by their class of news."""
    plan = planner.classify(_asked(spark)).select("query_id", "query", "news_class")
    pairs = plan.withColumn("provider", F.explode(F.array(*[F.lit(s[0]) for s in K.SOURCES])))
    return pairs.withColumn("boost", F.expr(signals.boost_with_news(SPARK, "query", "provider", "news_class")).cast("double")).where("boost > 1").drop("query")


_COUNTS = signals.news_counts(DUCK, "query")
SQL["source_boosts"] = f"""WITH p AS (SELECT query_id, query, {', '.join(f'{c} AS n_{n}' for n, c in _COUNTS)} FROM {ASKED_SQL}), n AS (SELECT query_id, query, {signals.news_class([n for n, _ in _COUNTS])} AS news_class FROM p)
SELECT query_id, news_class, provider, boost FROM (SELECT *, ({signals.boost_with_news(DUCK, 'query', 'provider', 'news_class')})::DOUBLE AS boost FROM n, (VALUES {', '.join(f'({s[0]!r})' for s in K.SOURCES)}) v(provider)) WHERE boost > 1"""


def entity_queries(spark: SparkSession, d: str) -> DataFrame:
    return entities.expanded(_asked(spark))


def _pairs(tables: dict[str, list[str]]) -> str:
    return ", ".join(f"({_literal(k)}, {i}, {_literal(x)})" for k, items in tables.items() for i, x in enumerate(items))


SQL["entity_queries"] = f"SELECT query_id, entity_domain, n, variant FROM (SELECT query_id, {signals.entity_domain(DUCK, 'query')} AS entity_domain FROM {ASKED_SQL}) JOIN (VALUES {_pairs(K.ENTITY_QUERIES)}) v(entity_domain, n, variant) USING (entity_domain)"


def missing_entities(spark: SparkSession, d: str) -> DataFrame:
    """Entities that no title of the documents covers, for each query with a domain, and what is asked for them."""
    titles = table(spark, d, "documents").select("title", F.substring_index("text", "\n", 1).alias("snippet"))
    results = titles.withColumn("query_id", F.explode(F.array(*[F.lit(i) for i, _ in ASKED])))
    return entities.sub_queries(entities.missing(_asked(spark), results))


SQL["missing_entities"] = f"""WITH p AS (SELECT query_id, {signals.entity_domain(DUCK, 'query')} AS entity_domain FROM {ASKED_SQL}), t AS (SELECT * FROM (VALUES {_pairs(K.ENTITY_TERMS)}) v(entity_domain, n, entity)),
x AS (SELECT lower(coalesce(title, '') || ' ' || coalesce(split_part(text, chr(10), 1), '')) AS body FROM documents), c AS (SELECT DISTINCT entity_domain, low FROM (SELECT entity_domain, arg_min(lower(entity), n) AS low FROM x, t WHERE contains(body, lower(entity)) GROUP BY entity_domain, body)),
m AS (SELECT query_id, entity, row_number() OVER (PARTITION BY query_id ORDER BY n) AS n FROM p JOIN t USING (entity_domain) LEFT JOIN c ON c.entity_domain = t.entity_domain AND c.low = lower(entity) WHERE c.low IS NULL QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY t.n) <= 5)
SELECT query_id, n::INTEGER AS n, entity, provider, entity || ' paper research' AS query FROM m, (VALUES ('arxiv'), ('semanticscholar'), ('github')) v(provider)"""


def title_topics(spark: SparkSession, d: str) -> DataFrame:
    return _results(spark, d).select("result_id", F.array_join(F.expr(signals.topics(SPARK, "coalesce(title, '')")), ",").alias("topics"))


SQL["title_topics"] = f"SELECT result_id, coalesce(array_to_string({signals.topics(DUCK, chr(99) + 'oalesce(title, ' + chr(39) * 2 + ')')}, ','), '') AS topics FROM {RESULTS}"


def _memory(spark: SparkSession, d: str) -> DataFrame:
    """(host, provider, topic): the topics of the titles that a host's results had."""
    rows = _results(spark, d).select(F.expr(signals.host(SPARK)).alias("host"), "provider", F.explode(F.expr(f"array_distinct({signals.topics(SPARK, chr(99) + 'oalesce(title, ' + chr(39) * 2 + ')')})")).alias("topic"))
    return rows.where("host IS NOT NULL").distinct()


def source_tags(spark: SparkSession, d: str) -> DataFrame:
    """The union of the topics of each host and source."""
    return _memory(spark, d).groupBy("host", "provider").agg(F.count("*").alias("tags"), F.min("topic").alias("first_tag"), F.max("topic").alias("last_tag"))


_MEMORY = f"SELECT DISTINCT host, provider, topic FROM (SELECT {signals.host(DUCK)} AS host, provider, unnest({signals.topics(DUCK, chr(99) + 'oalesce(title, ' + chr(39) * 2 + ')')}) AS topic FROM {RESULTS}) WHERE host IS NOT NULL"
SQL["source_tags"] = f"SELECT host, provider, count(*) AS tags, min(topic) AS first_tag, max(topic) AS last_tag FROM ({_MEMORY}) GROUP BY host, provider"


def topic_sources(spark: SparkSession, d: str) -> DataFrame:
    """For each evaluation item the ten sources with most of its topics among their tags."""
    items = table(spark, d, "eval_items").select("item_id", F.explode(F.expr(f"array_distinct({signals.topics(SPARK, 'item_text')})")).alias("topic"))
    shared = items.join(_memory(spark, d), "topic").groupBy("item_id", "host", "provider").agg(F.count("*").alias("shared"))
    place = F.row_number().over(Window.partitionBy("item_id").orderBy(F.col("shared").desc(), "host", "provider"))
    return shared.withColumn("place", place).where("place <= 10")


SQL["topic_sources"] = f"""WITH m AS ({_MEMORY}), i AS (SELECT item_id, unnest(list_distinct({signals.topics(DUCK, 'item_text')})) AS topic FROM eval_items)
SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY shared DESC, host, provider) AS place FROM (SELECT item_id, host, provider, count(*) AS shared FROM i JOIN m USING (topic) GROUP BY ALL) QUALIFY place <= 10"""


def credibility_factor(spark: SparkSession, d: str) -> DataFrame:
    rows = _results(spark, d).withColumn("host", F.expr(signals.host(SPARK))).withColumn("score", F.when(F.col("host").isNotNull(), F.expr(signals.credibility(SPARK))))
    return rows.select("result_id", F.round(F.expr(signals.credibility_multiplier("score")).cast("double"), 6).alias("factor"))


SQL["credibility_factor"] = f"SELECT result_id, round(({signals.credibility_multiplier('score')})::DOUBLE, 6) AS factor FROM (SELECT result_id, CASE WHEN host IS NOT NULL THEN {signals.credibility(DUCK)} END AS score FROM (SELECT *, {signals.host(DUCK)} AS host FROM {RESULTS}))"

# Answers.


def answer_reasons(spark: SparkSession, d: str) -> DataFrame:
    """What speaks for and against an answer from each query's first six results, whose first snippet is its summary."""
    rows = _ranked(spark, d).where("pos <= 6").withColumn("host", F.expr(signals.host(SPARK))).withColumn("trust", F.expr(signals.trust()))
    g = rows.groupBy("query_id").agg(F.count("*").alias("n"), F.max(F.col("trust") >= 95).alias("official"), F.max(F.contains(F.coalesce("snippet", F.lit("")), F.lit("`"))).alias("code"), F.max(F.when(F.col("pos") == 1, F.coalesce("snippet", F.lit("")))).alias("summary"))
    r = g.select("query_id", answers.reasons(F.col("n"), F.col("official"), F.col("code"), F.lit(0), F.lit(0.5), F.col("summary")).alias("r"))
    return r.select("query_id", *[F.array_join(F.col(f"r.{c}"), " | ").alias(c) for c in ("evidence", "unknowns", "weaknesses")])


SQL["answer_reasons"] = f"""WITH o AS (SELECT *, {signals.host(DUCK)} AS host, row_number() OVER (PARTITION BY query_id ORDER BY result_id) AS pos FROM {RESULTS}), t AS (SELECT *, {signals.trust()} AS trust FROM o WHERE pos <= 6),
g AS (SELECT query_id, count(*) AS n, bool_or(trust >= 95) AS official, bool_or(contains(coalesce(snippet, ''), '`')) AS code, max(CASE WHEN pos = 1 THEN coalesce(snippet, '') END) AS summary FROM t GROUP BY query_id)
SELECT query_id, concat_ws(' | ', CASE WHEN n >= 3 THEN n || ' independent sources consulted' END, CASE WHEN official THEN 'At least one official/authoritative source was used' END) AS evidence,
 concat_ws(' | ', CASE WHEN n < 3 THEN 'Few independent sources were found — treat this answer as provisional' END, CASE WHEN NOT code THEN 'No concrete code example was found for this answer' END) AS unknowns,
 concat_ws(' | ', CASE WHEN NOT official THEN 'No official documentation source was found' END, CASE WHEN {signals.hedged(DUCK, 'summary')} THEN 'The generated answer indicates uncertainty — the synthesis found insufficient data' END) AS weaknesses FROM g"""


def compression_inputs(spark: SparkSession, d: str) -> DataFrame:
    """The documents of each host, as answers to one question, cut and numbered as a model's input; those that failed are left out."""
    docs = dedup.first_by(table(spark, d, "extractions"), [F.col("extraction_id")], [F.col("extracted_at").desc(), F.col("markdown")])
    made = answers.compress(docs.where("host IS NOT NULL").select(F.col("host").alias("query_id"), F.col("extraction_id").alias("pos"), "title", "markdown"))
    return made.select("query_id", "sources", F.length("input").alias("chars"), F.sha2("input", 256).alias("digest"))


SQL["compression_inputs"] = """WITH e AS (SELECT * FROM extractions WHERE host IS NOT NULL QUALIFY row_number() OVER (PARTITION BY extraction_id ORDER BY extracted_at DESC, markdown NULLS FIRST) = 1), n AS (SELECT *, row_number() OVER (PARTITION BY host ORDER BY extraction_id) AS n FROM e WHERE markdown IS NOT NULL QUALIFY n <= 20),
g AS (SELECT host AS query_id, count(*) AS sources, string_agg('[' || n || '] ' || coalesce(title, '') || chr(10) || substring(markdown, 1, 3000), chr(10) || chr(10) ORDER BY n) AS input FROM n GROUP BY host) SELECT query_id, sources, length(input)::INTEGER AS chars, sha256(input) AS digest FROM g"""


def cut_summaries(spark: SparkSession, d: str) -> DataFrame:
    """Documents as answers of one text, cut where their tokens exceed 100."""
    rows = table(spark, d, "documents").select("doc_id", F.col("text").alias("summary"), F.array(F.coalesce("title", F.lit(""))).alias("key_facts"), *[F.array().cast("array<string>").alias(c) for c in ("examples", "warnings", "cited")])
    return answers.cut_answers(rows, 100).select("doc_id", F.col("tokens").cast("bigint").alias("tokens"), F.length("summary").alias("chars"))


SQL["cut_summaries"] = "WITH t AS (SELECT doc_id, coalesce(text, '') AS text, ceil(length(coalesce(text, '') || ' ' || coalesce(title, '')) * 0.25)::BIGINT AS tokens FROM documents) SELECT doc_id, tokens, (CASE WHEN tokens > 100 THEN least(length(text), 400) ELSE length(text) END)::INTEGER AS chars FROM t"


def salvaged_replies(spark: SparkSession, d: str) -> DataFrame:
    """The cache's JSON as models send it: in a fence, after some words, and broken."""
    rows = dedup.first_by(table(spark, d, "semantic_cache"), [F.col("entry_id")], [F.col("hit_count").desc(), F.col("created_at")])
    j = F.coalesce("result_json", F.lit(""))
    raw = F.when(F.col("entry_id") % 4 == 0, F.concat(F.lit("```json\n"), j, F.lit("\n```"))).when(F.col("entry_id") % 4 == 1, F.concat(F.lit("Here it is: "), j)).when(F.col("entry_id") % 4 == 2, F.concat(j, F.lit(" and {"))).otherwise(j)
    schema = T.StructType([T.StructField("mode", T.StringType()), T.StructField("results", T.LongType()), T.StructField("other", T.StringType())])
    return answers.structured(rows.select("entry_id", raw.alias("reply")), schema)


SQL["salvaged_replies"] = """WITH o AS (SELECT * FROM semantic_cache QUALIFY row_number() OVER (PARTITION BY entry_id ORDER BY hit_count DESC, created_at) = 1), j AS (SELECT entry_id, CASE WHEN json_valid(result_json) THEN result_json END AS j FROM o)
SELECT entry_id, json_extract_string(j, '$.mode') AS mode, try_cast(json_extract_string(j, '$.results') AS BIGINT) AS results, NULL::VARCHAR AS other FROM j"""


def mime_documents(spark: SparkSession, d: str) -> DataFrame:
    """The extractions' JSON and Markdown as resources of two types."""
    rows = dedup.first_by(table(spark, d, "extractions"), [F.col("extraction_id")], [F.col("extracted_at").desc(), F.col("markdown")])
    parts = rows.select("extraction_id", F.explode(F.array(F.struct(F.lit("application/json; charset=utf-8").alias("mime"), F.col("structured").alias("body")), F.struct(F.lit("Text/Markdown").alias("mime"), F.col("markdown").alias("body")))).alias("p")).select("extraction_id", "p.mime", "p.body").where("body IS NOT NULL")
    return extract.documents(parts, id_col="extraction_id", body="body", content_type="mime").select("id", "kind", "text_length", "content_hash")


SQL["mime_documents"] = r"""WITH e AS (SELECT * FROM extractions QUALIFY row_number() OVER (PARTITION BY extraction_id ORDER BY extracted_at DESC, markdown NULLS FIRST) = 1),
m AS (SELECT extraction_id AS id, '```json' || chr(10) || structured || chr(10) || '```' AS t FROM e WHERE structured IS NOT NULL UNION ALL SELECT extraction_id, CASE WHEN regexp_matches(ltrim(markdown), '^[\[{]') THEN '```json' || chr(10) || markdown || chr(10) || '```' ELSE markdown END FROM e WHERE markdown IS NOT NULL)
SELECT id, 'text' AS kind, length(t)::INTEGER AS text_length, sha256(t) AS content_hash FROM m"""


def cited_pages(spark: SparkSession, d: str) -> DataFrame:
    """The results with the document that was extracted for their address."""
    docs = table(spark, d, "extractions").where("url IS NOT NULL").groupBy("url").agg(F.min_by(F.struct("title", F.sha2(F.coalesce("markdown", F.lit("")), 256).alias("content_hash")), F.struct("extraction_id", "extracted_at")).alias("x")).select("url", "x.title", "x.content_hash")
    rows = _results(spark, d).select("result_id", "url", F.expr(signals.host(SPARK)).alias("host"))
    return research.citations(rows, docs).select("result_id", "extracted_title", "content_hash", F.col("trust").cast("int").alias("trust"))


SQL["cited_pages"] = f"""WITH f AS (SELECT url AS u, title AS extracted_title, sha256(coalesce(markdown, '')) AS content_hash FROM extractions WHERE url IS NOT NULL QUALIFY row_number() OVER (PARTITION BY url ORDER BY extraction_id, extracted_at) = 1)
SELECT result_id, extracted_title, content_hash, ({signals.trust()})::INTEGER AS trust FROM (SELECT result_id, url, {signals.host(DUCK)} AS host FROM {RESULTS}) LEFT JOIN f ON url = u"""

# Evaluation. A query's own first results of each source are its judgments, graded by the length of their titles.


def _judgments(spark: SparkSession, d: str) -> DataFrame:
    firsts = dedup.first_by(_results(spark, d), [F.col("query_id"), F.col("provider")], [F.col("result_id")])
    return firsts.select("query_id", F.col("result_id").alias("n"), "url", "title", (F.length(F.coalesce("title", F.lit(""))) % 4).cast("int").alias("rel"))


def _judged(spark: SparkSession, d: str) -> DataFrame:
    rows = _ranked(spark, d).select("query_id", "pos", "url", "title", "snippet", "provider")
    queries = rows.where("pos = 1").select("query_id", F.coalesce("title", F.lit("")).alias("query"))
    return evaluate.judge(rows, _judgments(spark, d), queries)


def judged_results(spark: SparkSession, d: str) -> DataFrame:
    return _judged(spark, d).select("query_id", "pos", "rel", F.coalesce("from_judgment", F.lit(-9)).alias("from_judgment"))


_W = "coalesce({c}, '')"
_JUDGE = f"""o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY result_id) AS pos FROM {RESULTS}), jd AS (SELECT query_id, result_id AS n, url, title, (length(coalesce(title, '')) % 4)::INTEGER AS rel FROM o QUALIFY row_number() OVER (PARTITION BY query_id, provider ORDER BY result_id) = 1),
ju AS (SELECT query_id, url, arg_min(rel, n) AS url_rel FROM jd WHERE url IS NOT NULL GROUP BY ALL), q AS (SELECT query_id, {signals.title_words(DUCK, _W.format(c='title'))} AS asked FROM o WHERE pos = 1),
jw AS (SELECT query_id, n, rel, {signals.title_words(DUCK, _W.format(c='title'))} AS b FROM jd), w AS (SELECT query_id, pos, url, provider, lower(coalesce(title, '') || ' ' || coalesce(snippet, '')) AS body, {signals.title_words(DUCK, _W.format(c='title'))} AS a FROM o),
best AS (SELECT query_id, pos, arg_min(rel, (-j, n)) AS rel, max(j) AS j FROM (SELECT w.query_id, pos, n, rel, {signals.jaccard(DUCK, 'a', 'b')} AS j FROM w JOIN jw USING (query_id)) GROUP BY ALL),
jj AS (SELECT w.query_id, w.pos, provider, body, asked, coalesce(url_rel, CASE WHEN best.j >= 0.4 THEN best.rel END) AS from_judgment FROM w LEFT JOIN ju ON w.query_id = ju.query_id AND w.url = ju.url LEFT JOIN best ON w.query_id = best.query_id AND w.pos = best.pos JOIN q ON w.query_id = q.query_id),
sh AS (SELECT *, len(list_filter(asked, lambda x: contains(body, x))) * 1.0 / greatest(len(asked), 1) AS s FROM jj),
jr AS (SELECT query_id, pos, provider, from_judgment, coalesce(from_judgment, CASE WHEN s >= 0.66 THEN 3 WHEN s >= 0.5 THEN 2 WHEN s >= 0.33 THEN 1 WHEN s >= 0.15 THEN 0 ELSE -1 END) AS rel FROM sh)"""
SQL["judged_results"] = f"WITH {_JUDGE} SELECT query_id, pos, rel, coalesce(from_judgment, -9) AS from_judgment FROM jr"

EXCLUDED = ["gateway", "casino"]


def _per_query(spark: SparkSession, d: str) -> DataFrame:
    judged = _judged(spark, d)
    rows = _ranked(spark, d).withColumn("host", F.expr(signals.host(SPARK))).withColumn("trust", F.expr(signals.trust()).cast("double"))
    other = rows.groupBy("query_id").agg(F.avg("trust").alias("mean_trust"), (F.count("*") * 100).cast("double").alias("latency_ms"), (F.countDistinct("provider") < 3).alias("degraded"))
    m = evaluate.metrics(judged.select("query_id", "pos", "rel", "provider"))
    return m.join(other, "query_id").join(evaluate.alignment(judged), "query_id").join(evaluate.excluded(rows, EXCLUDED), "query_id").withColumn("mean_relevance", F.col("mrr")).withColumn("deterministic", F.lit(True))


def excluded_topics(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.excluded(_ranked(spark, d), EXCLUDED)


_TOP = f"""tx AS (SELECT query_id, string_agg(coalesce(title, '') || ' ' || coalesce(snippet, ''), ' ' ORDER BY pos) AS t FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY result_id) AS pos FROM {RESULTS}) WHERE pos <= 10 GROUP BY query_id), ex AS (SELECT query_id, {' OR '.join(f"contains(lower(t), '{x}')" for x in EXCLUDED)} AS excluded FROM tx)"""
SQL["excluded_topics"] = f"WITH {_TOP} SELECT query_id, excluded FROM ex"


def reranker_alignment(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.alignment(_judged(spark, d)).withColumn("alignment", F.round("alignment", 6))


SQL["reranker_alignment"] = f"WITH {_JUDGE} SELECT query_id, round(coalesce(avg(CASE WHEN from_judgment >= 1 THEN (from_judgment >= 2 AND pos <= 3)::INT END), 0)::DOUBLE, 6) AS alignment FROM jr GROUP BY query_id"


def evaluation_summary(spark: SparkSession, d: str) -> DataFrame:
    s = evaluate.full_summary(_per_query(spark, d))
    return s.select("queries", *[F.round(c, 5).alias(c) for c in s.columns if c not in ("queries", "excluded_queries")], "excluded_queries")


_EVAL = (
    f"WITH {_JUDGE}, {_TOP}"
    + """, r AS (SELECT *, (rel >= 1)::INT AS hit, row_number() OVER (PARTITION BY query_id ORDER BY rel DESC, pos) AS ideal FROM jr),
c AS (SELECT *, sum(hit) OVER w AS hits, sum(1 - hit) OVER w AS misses, sum(1 - hit) OVER (PARTITION BY query_id) AS alls FROM r WINDOW w AS (PARTITION BY query_id ORDER BY pos ROWS UNBOUNDED PRECEDING)),
g AS (SELECT query_id, count(*) AS n, sum(hit) AS found, sum(CASE WHEN pos <= 5 THEN hit ELSE 0 END) AS h5, sum(CASE WHEN pos <= 10 THEN hit ELSE 0 END) AS h10, sum(CASE WHEN pos <= 5 THEN rel / log2(pos + 1) ELSE 0 END) AS d5, sum(CASE WHEN pos <= 10 THEN rel / log2(pos + 1) ELSE 0 END) AS d10,
 sum(CASE WHEN ideal <= 5 THEN rel / log2(ideal + 1) ELSE 0 END) AS i5, sum(CASE WHEN ideal <= 10 THEN rel / log2(ideal + 1) ELSE 0 END) AS i10, min(CASE WHEN hit = 1 THEN pos END) AS f, sum(CASE WHEN hit = 1 AND pos <= 10 THEN hits * 1.0 / pos ELSE 0 END) AS ap,
 sum(CASE WHEN hit = 1 THEN 1 - CASE WHEN alls > 0 THEN misses * 1.0 / alls ELSE 0 END ELSE 0 END) AS bp, count(DISTINCT provider) AS diversity, coalesce(avg(CASE WHEN from_judgment >= 1 THEN (from_judgment >= 2 AND pos <= 3)::INT END), 0) AS alignment FROM c GROUP BY query_id),
"""
    + f"""ot AS (SELECT query_id, avg(({signals.trust()})::DOUBLE) AS mean_trust, (count(*) * 100)::DOUBLE AS latency_ms, count(DISTINCT provider) < 3 AS degraded FROM (SELECT *, {signals.host(DUCK)} AS host FROM {RESULTS}) GROUP BY query_id),
pq AS (SELECT query_id, h5 * 1.0 / least(n, 5) AS p5, h10 * 1.0 / least(n, 10) AS p10, h10 * 1.0 / greatest(found, 3) AS r10, CASE WHEN i5 > 0 THEN d5 / i5 ELSE 0 END AS ndcg5, CASE WHEN i10 > 0 THEN d10 / i10 ELSE 0 END AS ndcg10, coalesce(1.0 / f, 0) AS mrr, ap / greatest(found, 3) AS map, CASE WHEN found > 0 THEN bp / found ELSE 0 END AS bpref, diversity, alignment, mean_trust, coalesce(1.0 / f, 0) AS mean_relevance, latency_ms, degraded, excluded, true AS deterministic FROM g JOIN ot USING (query_id) JOIN ex USING (query_id)),
su AS (SELECT count(*) AS queries, {', '.join(f'avg({m})::DOUBLE AS {m}' for m in evaluate.MEANS)}, avg(degraded::INT)::DOUBLE AS degraded_rate, avg(deterministic::INT)::DOUBLE AS determinism_rate, count_if(excluded)::BIGINT AS excluded_queries FROM pq),
sc AS (SELECT *, 25 * p5 + 20 * ndcg5 + 15 * mrr + 10 * least(diversity / 5, 1) + 10 * greatest(0, 1 - latency_ms / 10000) + 10 * determinism_rate + 5 * greatest(0, 1 - degraded_rate) + 5 * greatest(0, 1 - excluded_queries / queries) AS score FROM su)"""
)
SQL["evaluation_summary"] = _EVAL + " SELECT queries, " + ", ".join(f"round({m}, 5) AS {m}" for m in (*evaluate.MEANS, "degraded_rate", "determinism_rate", "score")) + ", excluded_queries FROM sc"


def evaluation_violations(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.all_violations(_per_query(spark, d)).withColumn("value", F.round("value", 6))


_LOW = {**evaluate.THRESHOLDS, "mean_trust": 65.0}
SQL["evaluation_violations"] = _EVAL + " " + " UNION ALL ".join(
    [f"SELECT query_id, '{m}' AS metric, round({m}::DOUBLE, 6) AS value, {t}::DOUBLE AS threshold FROM pq WHERE {m} < {t}" for m, t in _LOW.items()] + ["SELECT query_id, 'latency_ms', round(latency_ms, 6), 10000::DOUBLE FROM pq WHERE latency_ms > 10000", "SELECT query_id, 'deterministic', 0, 1 FROM pq WHERE NOT deterministic", "SELECT query_id, 'excluded', 1, 0 FROM pq WHERE excluded"]
)


def quality_gate(spark: SparkSession, d: str) -> DataFrame:
    """The checks that fail, with the evaluation items as adversarial cases, of which those above 200 characters pass."""
    cases = table(spark, d, "eval_items").select((F.length("item_text") > 200).alias("passed"))
    return evaluate.gate(evaluate.full_summary(_per_query(spark, d)), cases).withColumn("value", F.round("value", 5))


SQL["quality_gate"] = (
    _EVAL
    + ", ad AS (SELECT coalesce(avg((length(item_text) > 200)::INT), 1)::DOUBLE AS pass_rate FROM eval_items), al AS (SELECT * FROM sc, ad) "
    + " UNION ALL ".join([f"SELECT '{n}' AS \"check\", round({c}::DOUBLE, 5) AS value, {t}::DOUBLE AS threshold FROM al WHERE {c} < {t}" for n, c, t in [*[(m, m, evaluate.THRESHOLDS[m]) for m in ("p5", "ndcg5", "mrr", "diversity")], ("determinism", "determinism_rate", 1.0), ("adversarial", "pass_rate", 0.8)]] + [f"SELECT '{n}', round({c}::DOUBLE, 5), {t}::DOUBLE FROM al WHERE {c} > {t}" for n, c, t in (("latency", "latency_ms", 10000.0), ("excluded", "excluded_queries", 0.0), ("degraded", "degraded_rate", 0.5))])
)

WANTED = ["benchmark", "protected", "release", "stable", "crawling"]


def topic_benchmark(spark: SparkSession, d: str) -> DataFrame:
    rows = _ranked(spark, d).withColumn("host", F.expr(signals.host(SPARK))).withColumn("trust", F.expr(signals.trust()).cast("double")).withColumn("semantic", F.lit(0.5))
    topics = rows.where("pos = 1").select("query_id", F.explode(F.array(*[F.lit(w) for w in WANTED])).alias("topic"))
    b = evaluate.topic_benchmark(rows, topics)
    return b.select("query_id", *[F.round(c, 6).alias(c) for c in ("p5", "diversity", "mean_relevance", "mean_trust")], "passed")


SQL["topic_benchmark"] = f"""WITH o AS (SELECT *, ({signals.trust()})::DOUBLE AS trust, lower(coalesce(title, '') || ' ' || coalesce(snippet, '')) AS body FROM (SELECT *, {signals.host(DUCK)} AS host, row_number() OVER (PARTITION BY query_id ORDER BY result_id) AS pos FROM {RESULTS}) WHERE pos <= 10),
g AS (SELECT query_id, avg(CASE WHEN pos <= 5 THEN ({' OR '.join(f"contains(body, '{w}')" for w in WANTED)})::INT END)::DOUBLE AS p5, count(DISTINCT provider) * 1.0 / count(*) AS diversity, 0.5::DOUBLE AS mean_relevance, avg(CASE WHEN pos <= 5 THEN trust END) AS mean_trust FROM o GROUP BY query_id)
SELECT query_id, round(p5, 6) AS p5, round(diversity::DOUBLE, 6) AS diversity, mean_relevance, round(mean_trust, 6) AS mean_trust, p5 >= 0.6 AS passed FROM g"""

_CACHE = T.StructType([T.StructField(c, T.LongType()) for c in ("made_ms", "hits", "misses")])


def result_cache(spark: SparkSession, d: str) -> DataFrame:
    """Requests of each user answered from results that are five minutes old at most."""
    e = table(spark, d, "events").select("user_id", "ts", "event_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("at_ms"))
    return state.fold(e, key="user_id", order=["ts", "event_id"], step=state.result_cache, state_schema=_CACHE)


SQL["result_cache"] = """WITH RECURSIVE e AS (SELECT user_id, epoch_us(ts) // 1000 AS ms, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
f AS (SELECT user_id, n, ms AS made_ms, 0::BIGINT AS hits, 1::BIGINT AS misses FROM e WHERE n = 1 UNION ALL
 SELECT f.user_id, e.n, CASE WHEN e.ms - made_ms < 300000 THEN made_ms ELSE e.ms END, hits + (e.ms - made_ms < 300000)::INT, misses + (e.ms - made_ms >= 300000)::INT FROM f JOIN e ON e.user_id = f.user_id AND e.n = f.n + 1)
SELECT user_id, made_ms, hits, misses FROM f QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC) = 1"""


def minute_limits(spark: SparkSession, d: str) -> DataFrame:
    """Requests a minute against the limit of 120."""
    return state.rate_windows(table(spark, d, "events"))


SQL["minute_limits"] = "SELECT user_id, time_bucket(INTERVAL 1 MINUTE, ts) AS window_start, count(*) AS n, count(*) > 120 AS limited FROM events GROUP BY ALL"

NAMES = (
    "feed_results known_repositories source_boosts entity_queries missing_entities title_topics source_tags topic_sources credibility_factor answer_reasons compression_inputs cut_summaries salvaged_replies mime_documents cited_pages "
    "judged_results excluded_topics reranker_alignment evaluation_summary evaluation_violations quality_gate topic_benchmark result_cache minute_limits"
).split()


def queries() -> dict[str, Query]:
    return {**{n: globals()[n] for n in NAMES}, **{f"source_{p}": _connector(p) for p in PAYLOADS}}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
