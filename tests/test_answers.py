"""Plugged-in functions, sinks, stateful streams and the evaluation on a handful of rows."""

import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from querypond import sinks
from querypond.operators import answers, evaluate, extract, timestamps
from querypond.sources import registry
from querypond.streaming import state

T0 = datetime(2024, 1, 1)


def test_models_are_plugged_in(spark):
    df = spark.createDataFrame([(1, "red fox"), (2, None)], "query_id int, query string")
    assert [r.embedding for r in answers.embed(df, "query").orderBy("query_id").collect()] == [None, None]
    lengths = lambda s: s.map(lambda t: [float(len(t or "")), 1.0])
    assert [r.embedding for r in answers.embed(df, "query", lengths).orderBy("query_id").collect()] == [[7.0, 1.0], [0.0, 1.0]]
    neutral = answers.with_relevance(df.withColumn("snippet", F.lit("x"))).first()
    assert neutral.ai_relevance == 0.5 and neutral.missing_signals == ["aiRelevance"]
    judged = answers.with_relevance(df.withColumn("snippet", F.lit("x")), lambda q, t: q.map(lambda x: 1.7 if x else None)).orderBy("query_id").collect()
    assert [(r.ai_relevance, r.missing_signals) for r in judged] == [(1.0, []), (0.5, ["aiRelevance"])]
    some = answers.expansions(df, lambda s: s.map(lambda t: ["a", " ", "b", "c", "d", "e", "f", "g"] if t else None)).orderBy("query_id", "n").collect()
    assert [r.query for r in some] == ["a", "b", "c", "d", "e", "f", None] and [r.query for r in answers.expansions(df.limit(1)).collect()] == ["red fox"]


def test_semantic_similarity(spark):
    rows = [([1.0, 0.0], [0.0, 2.0], 0.5), ([1.0, 0.0], [3.0, 0.0], 1.0), ([1.0, 0.0], [-1.0, 0.0], 0.0), (None, [1.0], 0.5), ([0.0, 0.0], [1.0, 1.0], 0.5), ([1.0], [1.0, 1.0], 0.5)]
    df = spark.createDataFrame(rows, "a array<float>, b array<float>, want double")
    assert all(r.s == pytest.approx(r.want) for r in df.select("want", answers.semantic_similarity(F.col("a"), F.col("b")).alias("s")).collect())


def test_replies(spark):
    raws = ['```json\n{"a": 1}\n```', 'Sure: [1, 2] there', "nothing", None, '{"a": "x", "b": 2} or {', "```\n[]```"]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(raws)], "i int, reply string")
    got = [r.j for r in df.select("i", answers.salvaged_json(F.col("reply")).alias("j")).orderBy("i").collect()]
    assert got == ['{"a": 1}', "[1, 2]", None, None, '{"a": "x", "b": 2}', "[]"]
    shaped = answers.structured(df, T.StructType([T.StructField("b", T.LongType()), T.StructField("c", T.StringType())])).orderBy("i").collect()
    assert [tuple(r) for r in shaped][4] == (4, 2, None) and tuple(shaped[2]) == (2, None, None)


def test_compression(spark):
    docs = spark.createDataFrame([(1, 1, "A", "a" * 5000), (1, 2, "B", None), (1, 3, None, "c")], "query_id int, pos int, title string, markdown string")
    r = answers.compress(docs).first()
    assert r.sources == 2 and r.input == "[1] A\n" + "a" * 3000 + "\n\n[2] \nc" and r.key_facts is None
    s = answers.summarize(docs, lambda s: s.map(lambda t: ["one", "two"])).first()
    assert s.summary == "one two" and answers.compress(docs, max_tokens=40).count() == 0


def test_merge(spark, tmp_path):
    path = str(tmp_path / "cache")
    row = lambda k, v, at, n: spark.createDataFrame([(k, v, at, n)], "k string, v int, at timestamp, hits long")
    assert sinks.current(spark, path) is None
    sinks.merge(spark, path, row("a", 1, T0, 1), key="k", at="at", count="hits")
    sinks.merge(spark, path, row("a", 2, T0 + timedelta(1), 1).unionByName(row("b", 5, T0, 1)), key="k", at="at", count="hits")
    sinks.merge(spark, path, row("a", 3, T0 - timedelta(1), 1), key="k", at="at", count="hits")
    assert sorted((r.k, r.v, r.hits) for r in sinks.current(spark, path).collect()) == [("a", 2, 3), ("b", 5, 1)]


def test_merge_stream(spark, tmp_path):
    schema = "k string, v int, at timestamp"
    spark.createDataFrame([("a", 1, T0), ("a", 2, T0 + timedelta(1)), ("b", 1, T0)], schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    q = sinks.merge_stream(stream, str(tmp_path / "out"), str(tmp_path / "cp"), key="k", at="at").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted((r.k, r.v) for r in sinks.current(spark, str(tmp_path / "out")).collect()) == [("a", 2), ("b", 1)]
    assert all("batchId" in json.loads(e) for e in sinks.progress_events(q))


def test_watch_stream(spark, tmp_path):
    schema = "subscription string, threshold double, url string, score double, published timestamp"
    rows = [("s", 70.0, "new", 80.0, datetime(2024, 1, 1)), ("s", 70.0, "low", 10.0, datetime(2024, 1, 1)), ("s", 70.0, "undated", 90.0, None)]
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))

    def run():
        # time limits would keep the query going: one batch is all there is
        q = state.watch_stream(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(once=True).start()
        try:
            assert q.awaitTermination(60)
        finally:
            q.stop()

    run()
    spark.createDataFrame([("s", 70.0, "old", 99.0, datetime(2024, 1, 2)), ("s", 70.0, "later", 99.0, datetime(2100, 1, 1))], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    run()
    assert sorted(r.url for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["later", "new"]


def test_fresh_requests(spark, tmp_path):
    schema = "q string, ts timestamp"
    spark.createDataFrame([("a", T0), ("a", T0 + timedelta(minutes=1)), ("b", T0)], schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = state.fresh_requests(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), keys=["q"])
    stream.writeStream.format("memory").queryName("fresh_requests").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination(120)
    assert sorted(r.q for r in spark.table("fresh_requests").collect()) == ["a", "b"]


def test_tags_and_cache_steps():
    s = state.tagged_memory(None, {"score": 4.0, "tags": ["b", "a", "b"]})
    assert state.tagged_memory(s, {"score": 5.0, "tags": ["c", "a"]}) == {"used": 2, "mean": 4.5, "tags": ["b", "a", "c"]}
    c = None
    for at in (0, 299_999, 300_000, 300_001):
        c = state.result_cache(c, {"at_ms": at})
    assert c == {"made_ms": 300_000, "hits": 2, "misses": 2}


def test_alert_payloads(spark):
    df = spark.createDataFrame([("q", "u1", "t", None, "p", T0, 70.0), ("q", "u2", "t", "s", "p", T0, 90.0)], "query string, url string, title string, snippet string, provider string, published timestamp, score double")
    p = json.loads(sinks.alert_payloads(df, F.lit(T0)).first().payload)
    assert p["event"] == "watch.alert" and [x["url"] for x in p["new_results"]] == ["u2", "u1"]


def test_crawl_ends_with_its_pages(spark):
    links = spark.createDataFrame([("https://a.x/0", f"https://a.x/{i}") for i in range(1, 6)] + [("https://a.x/1", "https://a.x/9")], "source string, target string")
    seeds = spark.createDataFrame([("https://a.x/0",)], "url string")
    assert [r.url for r in extract.crawl(seeds, links, max_pages=3).orderBy("depth", "url").collect()] == ["https://a.x/0", "https://a.x/1", "https://a.x/2"]
    assert extract.crawl(seeds, links).count() == 7
    maps = spark.createDataFrame([("<urlset><url><loc> https://a.x/1 </loc></url><url><loc>https://a.x/1</loc></url></urlset>",), (None,)], "body string")
    assert [r.url for r in extract.sitemap_pages(maps).collect()] == ["https://a.x/1"]


def test_documents_by_type(spark):
    rows = [(1, "<article><p>Hi</p></article>", "text/html; charset=utf-8"), (2, '{"a": 1}', "application/json"), (3, "plain", "text/plain"), (4, "%PDF", "application/pdf"), (5, "[1]", "text/plain"), (6, "<p>x</p>", None), (None, "x", "text/plain")]
    df = spark.createDataFrame(rows, "id int, body string, mime string")
    got = {r.id: (r.kind, r.markdown) for r in extract.documents(df, id_col="id", body="body", content_type=F.col("mime")).collect()}
    assert got == {1: ("html", "Hi"), 2: ("text", '```json\n{"a": 1}\n```'), 3: ("text", "plain"), 4: ("pdf", None), 5: ("text", "```json\n[1]\n```"), 6: ("html", "x")}


def test_gate(spark):
    good = {"p5": 1.0, "p10": 1.0, "ndcg5": 1.0, "ndcg10": 1.0, "r10": 1.0, "mrr": 1.0, "map": 1.0, "bpref": 1.0, "diversity": 5, "mean_trust": 80.0, "mean_relevance": 0.9, "latency_ms": 500.0, "alignment": 1.0, "degraded": False, "deterministic": True, "excluded": False}
    bad = {**good, "p5": 0.0, "excluded": True, "deterministic": False, "latency_ms": 30_000.0}
    df = spark.createDataFrame([(1, *good.values())], ["query_id", *good])
    s = evaluate.full_summary(df)
    assert s.first().score == pytest.approx(25 + 20 + 15 + 10 + 9.5 + 10 + 5 + 5) and evaluate.gate(s).count() == 0 and evaluate.all_violations(df).count() == 0
    worse = spark.createDataFrame([(2, *bad.values())], ["query_id", *bad])
    cases = spark.createDataFrame([(True,), (False,)], "passed boolean")
    assert {r.check for r in evaluate.gate(evaluate.full_summary(worse), cases).collect()} == {"p5", "determinism", "adversarial", "latency", "excluded"}
    assert {r.metric for r in evaluate.all_violations(worse).collect()} == {"p5", "deterministic", "excluded", "latency_ms"}
    runs = spark.createDataFrame([("a", 1, 1.0), ("b", 2, 9.0), ("a", 3, 1.2), ("a", 4, 2.0)], "suite string, at int, score double")
    assert [r.at for r in evaluate.trend(runs, "at", "score", suite="suite").collect()] == [4]


def test_known_repositories_stand_first(spark):
    q = spark.createDataFrame([(1, "Deno or bun with vite and prisma"), (2, "nothing")], "query_id int, query string")
    found = spark.createDataFrame([(1, 0, "x", "https://github.com/denoland/deno", "t", None, "github", None, None), (1, 1, "y", "https://github.com/z/z", "t", None, "github", None, None)], "query_id int, position int, id string, url string, title string, snippet string, provider string, published_at string, author string")
    rows = registry.with_known_repositories(q, found).orderBy("query_id", "position").collect()
    assert [r.title for r in rows] == ["prisma/prisma", "oven-sh/bun", "vitejs/vite", "t", "t"] and registry.known_repositories(q.limit(0)).count() == 0


def test_zone_of_a_source_with_summer_time(spark):
    """A year of local stamps tells a zone with summer time from one without; all zones are candidates."""
    zoned = timestamps.zone_histories(timestamps.zone_names(spark))
    named = {r.zone: r.candidate for r in zoned.collect()}
    assert named["Europe/Paris"] == named["Europe/Berlin"] == "Europe/Berlin" and named["America/Phoenix"] != named["America/Denver"]
    rows = []
    for i in range(60):
        at = datetime(2023, 1, 3, 12, i % 60) + timedelta(days=6 * i)
        summer = datetime(2023, 3, 12, 9) <= at < datetime(2023, 11, 5, 8)
        rows.append(("den", (at - timedelta(hours=6 if summer else 7)).strftime("%Y-%m-%d %H:%M:%S"), at + timedelta(seconds=30)))
        rows.append(("phx", (at - timedelta(hours=7)).strftime("%Y-%m-%d %H:%M:%S"), at + timedelta(seconds=30)))
        rows.append(("utc", at.strftime("%Y-%m-%dT%H:%M:%SZ"), at + timedelta(seconds=30)))
    df = spark.createDataFrame(rows, "src string, stamp string, seen timestamp")
    got = {r.source: r.zone for r in timestamps.estimate_zones(df, source="src", stamp="stamp", ingested="seen").collect()}
    assert got["den"] == "America/Denver" and named["America/Phoenix"] == got["phx"]


def test_zone_from_the_order_of_issue(spark):
    """Stamps that were all loaded at once, weeks later, tell their zone by their numbered neighbours of known zone; lags alone do not."""
    rows, start = [], datetime(2023, 5, 1)
    for i in range(80):
        at = start + timedelta(minutes=10 * i)
        rows.append(("jp", i, (at + timedelta(hours=9)).strftime("%Y-%m-%d %H:%M:%S") if i % 2 else at.strftime("%Y-%m-%dT%H:%M:%SZ"), start + timedelta(days=20)))
        rows.append(("utc", i, at.strftime("%Y-%m-%dT%H:%M:%SZ"), at + timedelta(seconds=30)))
    rows.append(("jp", None, "2023-05-01 05:00:00", start + timedelta(days=20)))
    df = spark.createDataFrame(rows, "src string, id bigint, stamp string, seen timestamp")
    found = lambda **k: {r.source: r for r in timestamps.estimate_zones(df, source="src", stamp="stamp", ingested="seen", candidates=("UTC", "Asia/Tokyo", "America/New_York", "Etc/GMT+12", "Asia/Shanghai"), **k).collect()}
    got = found(sequence="id")
    assert set(got) == {"jp"} and got["jp"].zone == "Asia/Tokyo" and got["jp"].disorder == 0 and got["jp"].stamps == 41
    assert found()["jp"].zone != "Asia/Tokyo"
