"""Readers of payloads on small bodies, and the search pipeline on a handful of rows."""

import re
from collections import Counter
from datetime import datetime

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from querypond import queries as core
from querypond.operators import dedup, ranking, vectors
from querypond.plans import search
from querypond.sources import markup


def one(spark, body, read, **k):
    return read(spark.createDataFrame([(body,), (None,), ("",)], "body string"), **k).collect()


def test_arxiv(spark):
    body = "<feed><entry><id>http://arxiv.org/abs/1</id><title>A\n  title</title><summary> s\n t </summary><published>2024-01-01T00:00:00Z</published><author><name>Ann B</name></author><link href='http://x/pdf' rel='related'/><link rel='alternate' href='http://x/abs'/></entry></feed>"
    r = one(spark, body, markup.arxiv)
    assert [(x.url, x.title, x.snippet, x.author) for x in r] == [("http://x/abs", "A title", "s t", "Ann B")]


def test_feeds(spark):
    item = lambda t, u: f"<item><title><![CDATA[{t}]]></title><link>{u}</link><description>d &lt; {t}</description><pubDate>Tue, 09 Jan 2024 13:22:16 GMT</pubDate></item>"
    body = "<rss>" + item("red fox", "http://a") + item("blue", "http://b") + item("red", "http://c?x=1&url=http%3A%2F%2Fz%2Fy") + "</rss>"
    assert [x.url for x in one(spark, body, markup.feed, words="red fox")] == ["http://a", "http://c?x=1&url=http%3A%2F%2Fz%2Fy"]
    assert [x.url for x in one(spark, body, markup.news_feed)] == ["http://a", "http://b", "http://z/y"]


def test_pages(spark):
    card = '<a class="package-snippet" href="/project/left/"><span class="package-snippet__name">left</span><span class="package-snippet__version">1.0</span><time datetime="2024-01-01">x</time><p class="package-snippet__description">pads</p></a>'
    assert [(x.url, x.title, x.snippet) for x in one(spark, card, markup.pypi)] == [("https://pypi.org/project/left/", "left 1.0", "pads")]
    assert [(x.url, x.published_at) for x in one(spark, '{"url": "http://a", "timestamp": "20240102030405", "digest": "D"}\n{"url": "http://a", "timestamp": "20230102"}\n', markup.commoncrawl)][0][0] == "http://a"
    nested = '{"RelatedTopics": [{"FirstURL": "http://a", "Text": "One - the first"}, {"Name": "g", "Topics": [{"FirstURL": "http://b", "Text": "Two"}]}]}'
    assert sorted((x.url, x.title) for x in one(spark, nested, markup.duckduckgo)) == [("http://a", "One"), ("http://b", "Two")]
    videos = '<script>var ytInitialData = {"contents": [{"adRenderer": {"x": 1}}, {"videoRenderer": {"videoId": "v1", "title": {"runs": [{"text": "A "}, {"text": "tale"}]}, "publishedTimeText": {"simpleText": "2 days ago"}, "ownerText": {"runs": [{"text": "Ann"}]}}}, {"deep": {"videoRenderer": {"videoId": "v2", "title": {"simpleText": "B"}}}}]};</script>'
    assert [(x.id, x.title, x.published_at, x.author) for x in one(spark, videos, markup.youtube)] == [("v1", "A tale", "2 days ago", "Ann"), ("v2", "B", None, None)]
    state = '<script>window.__APOLLO_STATE__ = {"Post:1": {"id": "1", "title": "T", "mediumUrl": "http://m", "clapCount": 3}, "User:2": {}}</script>'
    assert [(x.title, x.snippet) for x in one(spark, state, markup.medium)] == [("T", " (3 claps, 0 responses)")]


def test_joins(spark):
    tweets = spark.createDataFrame([(1, 7, "hello", "2024-01-01"), (2, 8, "there", None)], "id bigint, author_id bigint, text string, created_at string")
    users = spark.createDataFrame([(7, "ann")], "id bigint, username string")
    assert {x.url for x in markup.twitter(tweets, users).collect()} == {"https://twitter.com/ann/status/1", "https://twitter.com/i/status/2"}
    ids = spark.createDataFrame([("9", 0), ("8", 1), ("7", 2)], "uid string, position int")
    summaries = spark.createDataFrame([("7", "t7", "s", "2024", "a"), ("9", "t9", "s", "2024", "a")], "uid string, title string, source string, pubdate string, author string")
    assert [x.title for x in markup.pubmed(ids, summaries).collect()] == ["t9", "t7"]


def corpus(spark):
    rows = [(1, "https://github.com/a/b", "rust async runtime", "a runtime for rust code", "github"), (2, "https://github.com/a/b", "rust async runtime", "again", "github"), (3, "https://x.example/1", "rust async runtime", "a runtime for rust code", "devto"), (4, "https://x.example/2", "cooking pasta", "boil rust water", "stackexchange"), (5, "https://dev.to/x", "async in rust", "a guide to async", "devto")]
    return spark.createDataFrame([(*r, None, "2024-01-01T00:00:00Z") for r in rows], "result_id bigint, url string, title string, snippet string, provider string, author string, published_at string")


def test_search(spark):
    queries = spark.createDataFrame([(1, "rust async runtime"), (2, ""), (3, "nothing matches zzz")], "query_id bigint, query string")
    got = search.search(queries, corpus(spark)).collect()
    assert {r.query_id for r in got} == {1} and [r["rank"] for r in sorted(got, key=lambda r: r["rank"])] == list(range(1, len(got) + 1))
    assert {r.result_id for r in got} == {2, 3, 4, 5}  # the better match of an address stands for it
    answer = search.research(queries, corpus(spark), hops=2).collect()
    assert {r.query_id for r in answer} == {1} and len({r.url for r in answer}) == len(answer)


def test_source_filters(spark):
    df = spark.createDataFrame([(1, "a", True, ["b"]), (1, "b", False, ["b"]), (2, "b", False, ["b"]), (3, "a", True, None)], "query_id int, provider string, healthy boolean, excluded array<string>")
    assert {(r.query_id, r.provider) for r in search.healthy_sources(df).collect()} == {(1, "a"), (2, "b"), (3, "a")}
    assert {(r.query_id, r.provider) for r in search.without_excluded(df).collect()} == {(1, "a"), (2, "b"), (3, "a")}


def test_cache(spark):
    e = spark.createDataFrame([(1, "h1", [1.0, 0.0], datetime(2030, 1, 1)), (2, "h2", [0.0, 1.0], datetime(2020, 1, 1)), (3, "h3", [0.6, 0.8], None)], "entry_id bigint, query_hash string, embedding array<float>, expires_at timestamp")
    q = spark.createDataFrame([(10, "h1", [0.0, 1.0]), (11, "x", [0.99, 0.05]), (12, "y", [0.0, 1.0]), (13, "z", None)], "query_id bigint, query_hash string, embedding array<float>")
    assert {(r.query_id, r.entry_id) for r in search.cached(q, e).collect()} == {(10, 1), (11, 1)}
    later = spark.createDataFrame([(1, "h9", [1.0, 0.0], datetime(2031, 1, 1)), (9, "h9", None, datetime(2031, 1, 1))], e.schema)
    assert {(r.entry_id, r.query_hash) for r in search.upsert(e, later, key="entry_id", at="expires_at").collect()} == {(1, "h9"), (2, "h2"), (3, "h3"), (9, "h9")}


def test_near_pairs_against_brute_force(spark, sf, monkeypatch):
    """Every pair at or above the limit comes out with the very cosine of the plain sum, whatever the blocks; vectors of other lengths don't meet."""
    rng = np.random.default_rng(7)
    some = rng.normal(size=(60, 8))
    rows = [(i, [float(x) for x in v[: 8 - 2 * (i % 3 == 0)]]) for i, v in enumerate(np.concatenate([some, some + rng.normal(size=(60, 8)) / 5, some]))]
    e = vectors.units(spark.createDataFrame(rows, "entry_id bigint, embedding array<double>"), "entry_id", "embedding", "e").repartition(3)
    q = e.where("entry_id % 4 = 0").select(F.col("entry_id").alias("query_id"), F.col("e").alias("q"))
    want = {tuple(r) for r in vectors.against_all(q, e).where("cosine >= 0.92").select("query_id", "entry_id", "cosine").collect()}
    monkeypatch.setattr(vectors, "QUERIES_PER_SCAN", 20)
    monkeypatch.setattr(vectors, "COSINES", 100)
    assert len(want) > 90 and {tuple(r) for r in vectors.within(q, e, 0.92).select("query_id", "entry_id", "cosine").collect()} == want
    assert vectors.within(q.limit(0), e, 0.92).count() == 0 and vectors.within(q, e.limit(0), 0.92).count() == 0
    assert "NestedLoopJoin" not in core.cache_probe(spark, sf)._jdf.queryExecution().toString()


def test_first_scores_of_each_source(spark):
    """The scores of all documents, cut afterwards, have the same first rows; none but these move, and texts move once."""
    rng = np.random.default_rng(3)
    word = lambda n: " ".join(f"w{int(x * x * 12)}" for x in rng.random(n))
    docs = spark.createDataFrame([(i if i else None, "abc"[i % 3] if i % 7 else None, word(i % 9) if i % 11 else None) for i in range(200)], "doc_id bigint, provider string, text string").dropDuplicates(["doc_id"])
    queries = spark.createDataFrame([(1, "w0 w3 w3"), (2, "w1 w11 other"), (3, ""), (4, None)], "query_id bigint, query string")
    groups = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (2, "d"), (3, "a")], "query_id bigint, provider string")
    scores = ranking.bm25(queries, docs.na.fill("", ["text"])).join(docs.drop("text"), "doc_id").join(groups, ["query_id", "provider"])
    want = sorted((r.query_id, r.provider, r["rank"], r.doc_id, round(r.raw, 9)) for r in ranking.top_per_query(scores.withColumn("raw", F.round("raw", 9)).withColumn("both", F.struct("query_id", "provider")), 4, "raw", query="both").collect())
    found = ranking.bm25_first(queries, groups, docs.withColumn("text", F.coalesce("text", F.lit(""))), 4, group="provider")
    got = sorted((r.query_id, r.provider, r.place, r.doc_id, round(r.raw, 9)) for r in found.collect())
    assert len(want) > 9 and [g[:3] + g[4:] for g in got] == [w[:3] + w[4:] for w in want]
    plan = found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("WindowGroupLimit") == 2 and "Exchange hashpartitioning(doc#" not in plan and plan.count("Exchange hashpartitioning(doc_id#") - plan.count("], Exchange hashpartitioning(doc_id#") == 1


def test_research_reads_the_corpus_once(spark, sf):
    """Candidates are kept, so neither their scores nor the corpus are made again by the stages that use them."""
    plan = core.research_sources(spark, sf)._jdf.queryExecution().toString()
    assert "eval_items" in plan and "search_results" not in plan


def test_first_scores_in_parts(spark, monkeypatch):
    """Blocks of queries and parts of documents give the rows of a plain loop, equal scores by id; no task sums the scores of all its documents."""
    rng = np.random.default_rng(5)
    docs = [(int(i), "abc"[i % 3], " ".join(f"w{x}" for x in rng.integers(0, 5, i % 4))) for i in rng.permutation(300)]
    asked, groups = {1: "w0 w3 w3", 2: "w1 w2", 3: "w4 other"}, [(1, "a"), (1, "b"), (2, "c"), (2, "d"), (3, "a"), (3, "c")]
    n, average, df = len(docs), float(np.mean([len(x[2].split()) for x in docs])), Counter(w for x in docs for w in set(x[2].split()))
    gain = lambda w, words: np.log((n - df[w] + 0.5) / (df[w] + 0.5) + 1) * words.count(w) * 2.5 / (words.count(w) + 1.5 * (0.25 + 0.75 * len(words) / average))
    raw = lambda q, words: sum(gain(w, words) for w in asked[q].split() if w in words)
    scores = {(q, g): sorted((-round(raw(q, t.split()), 9), i) for i, p, t in docs if p == g and raw(q, t.split())) for q, g in groups}
    want = sorted((q, g, i, place) for (q, g), rows in scores.items() for place, (_, i) in enumerate(rows[:4], 1))
    assert len(want) == 20 and any(a[0] == b[0] for rows in scores.values() for a, b in zip(rows[3:4], rows[4:5], strict=True))

    monkeypatch.setattr(ranking, "CELLS", 40)
    known = {"n": float(n), "avg": average, "terms": [{"term": w, "df": c} for w, c in df.items()]}
    rows = [{"doc_id": i, "provider": p, "w": t.split(), "known": known if not k else None} for k, (i, p, t) in enumerate(docs)]
    words = pa.table({"query_id": [q for q, t in asked.items() for _ in set(t.split())], "term": [w for t in asked.values() for w in sorted(set(t.split()))], "times": [t.split().count(w) for t in asked.values() for w in sorted(set(t.split()))]})
    find = ranking._first_scores(words, pa.table({"query_id": [q for q, _ in groups], "provider": [g for _, g in groups]}), 4, ["query_id", "provider", "doc_id", "raw"])
    assert sorted((r["query_id"], r["provider"], r["doc_id"]) for b in find(iter(pa.Table.from_pylist(rows).to_batches(37))) for r in b.to_pylist()) == sorted(w[:3] for w in want)

    monkeypatch.setattr(ranking, "BROADCAST_ROWS", 4)
    found = ranking.bm25_first(spark.createDataFrame(list(asked.items()), "query_id bigint, query string"), spark.createDataFrame(groups, "query_id bigint, provider string"), spark.createDataFrame(docs, "doc_id bigint, provider string, text string"), 4, group="provider")
    assert sorted((r.query_id, r.provider, r.doc_id, r.place) for r in found.collect()) == want
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") >= 2 and "Aggregate(keys=[doc" not in plan


def test_candidates_are_picked_at_the_scan(spark, monkeypatch):
    """Few candidates are picked below the first row of each id, so the corpus doesn't move for them; many by a join, with equal rows."""
    queries, plans, keep = spark.createDataFrame([(1, "rust async runtime"), (2, "pasta with rust")], "query_id bigint, query string"), [], search.cut
    monkeypatch.setattr(search, "cut", lambda df: (plans.append(df._jdf.queryExecution().optimizedPlan().toString()), keep(df))[1])
    once = dedup.first_by(corpus(spark), [F.col("result_id")], [F.col("url")])
    few = search.candidates(queries, once).collect()
    assert few and re.search(r"result_id#\d+L IN[^\n]*\n[^\n]*LogicalRDD", plans[-1])
    monkeypatch.setattr(search, "LISTED_IDS", 0)
    assert sorted(search.candidates(queries, once).collect()) == sorted(few)
