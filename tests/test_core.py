"""Operators of the core on small cases with known results."""

from datetime import datetime

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from querypond.functions import signals
from querypond.functions.dialect import SPARK
from querypond.operators import budget, dedup, evaluate, extract, ranking, research, timestamps
from querypond.sources import registry
from querypond.streaming import state


def test_bm25_fixture(spark):
    docs = spark.createDataFrame([("a", "TypeScript generics explained"), ("b", "JavaScript closures in depth"), ("c", "typescript generics generics and typescript tips"), ("d", "Python machine learning")], "doc_id string, text string")
    queries = spark.createDataFrame([(1, "typescript generics")], "query_id int, query string")
    got = {r.doc_id: r.bm25 for r in ranking.normalised(ranking.bm25(queries, docs)).collect()}
    assert set(got) == {"a", "c"} and max(got.values()) == 1 and 0 < min(got.values()) < 1
    assert ranking.bm25(spark.createDataFrame([(1, "")], "query_id int, query string"), docs).count() == 0


def test_rrf_golden(spark):
    rows = [(1, 0, "a", 1), (1, 0, "b", 2), (1, 0, "c", 3), (1, 1, "b", 1), (1, 1, "c", 2), (1, 1, "a", 3)]
    got = {r.doc_id: round(r.rrf, 6) for r in ranking.reciprocal_rank_fusion(spark.createDataFrame(rows, "query_id int, list_id int, doc_id string, rank int")).collect()}
    assert got == {"a": 0.992128, "b": 1.0, "c": 0.983998}


@pytest.mark.parametrize(
    ("values", "want"),
    [((80, 0.8, 0.7, 0.6, 70, 0.7, 0.7, 0.6, 0.7, 0), 69.2), ((80, 0.8, 0.7, 0.6, 70, 0.7, 0.7, 0.6, 0.7, 40), 59.2), ((50, 0.5, 0.3, 0.9, 50, 0.5, 0.5, 0.5, 0.5, 0), 45.85), ((50, 0.5, 0.7, 0.9, 50, 0.5, 0.5, 0.5, 0.5, 0), 56.0), ((60, 0.5, 0.5, 0.001, 50, 0.5, 0.5, 0.5, 0.5, 0), 30.511)],
)
def test_final_score_golden(spark, values, want):
    names = "trust ai_relevance semantic bm25 freshness popularity code_quality has_examples authority spam".split()
    row = spark.createDataFrame([(*map(float, values), None)], ", ".join(f"{n} double" for n in names) + ", source_quality double")
    assert row.select(F.expr(signals.final_score())).first()[0] == pytest.approx(want, abs=1e-6)


def test_trust_and_hosts(spark):
    urls = {"https://react.dev/learn": 100, "https://www.react.dev": 100, "https://developer.mozilla.org/x": 99, "https://cs.mit.edu/x": 95, "https://github.com/a/b": 96, "https://nowhere.example/": 40, "not a url": 40, None: 40}
    rows = spark.createDataFrame([(u,) for u in urls], "url string").withColumn("host", F.expr(signals.host(SPARK))).select("url", F.expr(signals.trust()).alias("t")).collect()
    assert {r.url: r.t for r in rows} == urls


def test_confidence_golden(spark):
    rows = [(4, 79.0, True, False, 0.15, ""), (2, 40.0, False, False, 0.1, ""), (1, 90.0, False, False, None, "The sources do not say; it is not clear.")]
    df = spark.createDataFrame(rows, "n int, t double, o boolean, c boolean, ai double, s string")
    got = [r[0] for r in df.select(research.confidence(F.col("n"), F.col("t"), F.col("o"), F.col("c"), F.lit(0), F.col("ai"), F.col("s"))).collect()]
    assert got == [29, 13, 31]


def test_metrics_golden(spark):
    rows = [(1, i + 1, r, "p") for i, r in enumerate([3, 2, 1, 0, -1])]
    m = evaluate.metrics(spark.createDataFrame(rows, "query_id int, pos int, rel int, provider string")).first()
    assert m.p5 == 0.6 and m.mrr == 1 and m.bpref == 1 and m.ndcg5 == pytest.approx(1.0)


def test_code_blocks():
    found = extract.code_blocks("# Guide\n\n```rust\nfn main() {\n println!(\"x\");\n}\n```\n\ntext\n\n    def f(x):\n    import os\n\n~~~\nplain\n~~~\n")
    assert [(b["language"], b["lines"]) for b in found] == [("rust", 4), ("text", 2), ("python", 2)]


def test_markdown_of_html():
    html = "<body><nav>menu</nav><article><h1>T</h1><p>a <b>bold</b> <a href='https://x.y/z'>link</a></p><pre><code class='x'>k = 1\n</code></pre><ul><li>one</li></ul></article><footer>f</footer></body>"
    made = extract.to_markdown(extract.main_part(html))
    assert "# T" in made and "**bold**" in made and "[link](https://x.y/z)" in made and "```\nk = 1" in made and "- one" in made and "menu" not in made and "\nf" not in made


def test_crawl(spark):
    links = spark.createDataFrame([("https://a.b/", "https://a.b/one"), ("https://a.b/one", "https://a.b/two?x=1#y"), ("https://a.b/two", "https://a.b/three"), ("https://a.b/one", "https://other.c/"), ("https://a.b/one", "https://a.b/f.PDF"), ("https://a.b/two", "https://a.b/")], "source string, target string")
    got = {r.url: r.depth for r in extract.crawl(spark.createDataFrame([("https://a.b/",)], "url string"), links, depth=2).collect()}
    assert got == {"https://a.b": 0, "https://a.b/one": 1, "https://a.b/two": 2}


def test_private_addresses(spark):
    ips = {"10.0.0.1": True, "172.20.1.1": True, "172.32.1.1": False, "192.168.0.9": True, "8.8.8.8": False, "169.254.1.1": True, "::1": True, "fd00::1": True, "2001:db8::1": False}
    rows = spark.createDataFrame([(i,) for i in ips], "ip string").select("ip", extract.is_private_address(F.col("ip")).alias("p")).collect()
    assert {r.ip: r.p for r in rows} == ips


STAMPS = [
    ("2023-07-15T23:48:43+05:30", "UTC", None, "2023-07-15 18:18:43"), ("20220330121716", "UTC", None, "2022-03-30 12:17:16"), ("  2022-06-20t08:34:29z\n", None, None, "2022-06-20 08:34:29"), ("Tue, 09 Jan 2024 13:22:16 CEST", None, None, "2024-01-09 11:22:16"), ("20 Nov 25 14:55 GMT", None, None, "2025-11-20 14:55:00"),
    ("July 23, 2025 2:52 AM", "Asia/Tokyo", None, "2025-07-22 17:52:00"), ("08/12/2024 20:14", "America/New_York", "mdy", "2024-08-13 00:14:00"), ("08/12/2024 20:14", "Europe/Berlin", "dmy", "2024-12-08 19:14:00"), ("2025/11/25 20:10", "UTC", "dmy", "2025-11-25 20:10:00"), ("1686095851", None, None, "2023-06-06 23:57:31"), ("1745311783845", None, None, "2025-04-22 08:49:43"),
    ("2021-10-31 02:30:00", "Europe/Berlin", None, "2021-10-31 00:30:00"), ("2021-03-28 02:30:00", "Europe/Berlin", None, None), ("2023-04-10 10:41:36[America/New_York]", "UTC", None, "2023-04-10 14:41:36"), ("2024-02-30 10:00:00", "UTC", None, None), ("2024-01-01 25:00:00", "UTC", None, None), ("2024-12-12", "UTC", None, None), ("20241212", "UTC", None, None), ("yesterday", "UTC", None, None),
    ("3 hours ago", "UTC", None, None), ("08/12/2024 20:14", "UTC", None, None), ("0001-01-01T00:00:00Z", None, None, None), ("253402300799", None, None, None), ("-1", None, None, None), ("0", None, None, None), (None, "UTC", None, None), ("", "UTC", None, None), ("2024-01-01 10:00:00", None, None, None), ("2024-01-01 10:00:00", "Nowhere/Land", None, None), ("2024-01-01T10:00:00+25:00", None, None, None), ("12:00 PM, 3 May 2024", "UTC", None, None),
]


def test_stamps(spark):
    df = spark.createDataFrame([(i, s, z, o) for i, (s, z, o, _) in enumerate(STAMPS)], "i int, stamp string, zone string, ord string")
    got = {r.i: r.utc for r in timestamps.normalise(df, stamp="stamp", declared_zone=F.col("zone"), date_order=F.col("ord")).select("i", F.date_format("utc", "yyyy-MM-dd HH:mm:ss").alias("utc")).collect()}
    assert [(STAMPS[i][0], got[i]) for i in range(len(STAMPS))] == [(s, w) for s, _, _, w in STAMPS]
    assert timestamps.normalise(df.limit(0), stamp="stamp").count() == 0


def test_zone_estimate(spark):
    rows = []
    for i in range(40):
        month = i % 12 + 1
        rows.append(("jp", f"2023-{month:02d}-10 21:{i:02d}:00", datetime(2023, month, 10, 12, i, 30)))  # nine hours ahead
        rows.append(("utc", f"2023-{month:02d}-10T12:{i:02d}:00Z", datetime(2023, month, 10, 12, i, 30)))
    got = {r.source: r for r in timestamps.estimate_zones(spark.createDataFrame(rows, "src string, stamp string, seen timestamp"), source="src", stamp="stamp", ingested="seen").collect()}
    assert got["jp"].zone == "Asia/Tokyo" and got["jp"].violations == 0 and "utc" not in got


def test_budget():
    assert budget.budget(1000) == {"max_results": 1, "chars_per_result": 2000, "total_chars": 3800}
    assert budget.budget(50) == {"max_results": 0, "chars_per_result": 0, "total_chars": 0}


def test_greedy_dedup(spark):
    rows = [(1, 1, [1.0, 0.0]), (1, 2, [0.99, 0.01]), (1, 3, [0.0, 1.0]), (2, 4, [1.0, 0.0]), (1, 5, [0.0, 0.0])]
    got = sorted(r.id for r in dedup.greedy(spark.createDataFrame(rows, "g int, id int, v array<double>"), group="g", position="id", vector="v").collect())
    assert got == [1, 3, 4, 5]


def test_folds_equal_a_plain_loop(spark):
    from querypond.queries import _CIRCUIT, _MEMORY

    events = [("u%d" % (i % 3), i * 1000, float(i * 7 % 13), i % 4 != 0) for i in range(60)]
    df = spark.createDataFrame(events, "k string, at_ms bigint, score double, failed boolean")
    for step, schema in ((state.memory, _MEMORY), (state.circuit, _CIRCUIT)):
        want: dict = {}
        for k, at, score, failed in events:
            want[k] = step(want.get(k), {"at_ms": at, "score": score, "failed": failed})
        got = {r.k: {f.name: r[f.name] for f in schema} for r in state.fold(df, key="k", order=["at_ms"], step=step, state_schema=schema).collect()}
        assert got == want


def test_circuit_opens_and_recovers():
    s = None
    for at, failed in [(0, True), (1, True), (2, True), (10, False), (40_000, True), (70_000, False), (200_000, False)]:
        s = state.circuit(s, {"at_ms": at, "failed": failed})
    assert s == {"failures": 0, "opened_ms": 0, "wait_ms": 0, "blocked": 2}


def test_streams(spark, tmp_path):
    from querypond.queries import _MEMORY

    spark.createDataFrame([("a", datetime(2024, 1, 1, 0, 0, i), float(i)) for i in range(5)], "user_id string, ts timestamp, score double").write.parquet(str(tmp_path / "in"))
    schema = "user_id string, ts timestamp, score double"
    stream = lambda: spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    q = state.rate_windows(stream(), limit=3, watermark="1 minute").writeStream.outputMode("update").format("memory").queryName("rate").start()
    q.processAllAvailable()
    q.stop()
    assert [(r.n, r.limited) for r in spark.table("rate").collect()] == [(5, True)]
    q = state.stream_fold(stream(), key="user_id", order=["ts"], step=state.memory, state_schema=_MEMORY).writeStream.outputMode("update").format("memory").queryName("mem").start()
    q.processAllAvailable()
    q.stop()
    assert [(r.user_id, r.used, r.mean) for r in spark.table("mem").collect()] == [("a", 5, 2.0)]


def test_json_source(spark):
    body = '{"objects": [{"package": {"name": "left-pad", "version": "1.3.0", "links": {"npm": "https://npm/left-pad"}, "description": "pads", "date": "2024-01-01", "publisher": {"username": "me"}}}]}'
    path, fields = registry.JSON_SOURCES["npm"]
    row = registry.from_json(spark.createDataFrame([(body,), ("{}",), (None,)], "body string"), "npm", path=path, fields=fields).collect()
    assert [(r.id, r.url, r.snippet, r.provider, r.author) for r in row] == [("npm-left-pad@1.3.0", "https://npm/left-pad", "pads", "npm", "me")]


@settings(max_examples=25, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 400_000), st.booleans()), max_size=40))
def test_circuit_invariants(events):
    s = None
    for at, failed in sorted(events):
        s = state.circuit(s, {"at_ms": at, "failed": failed})
        assert s["failures"] >= 0 and (s["failures"] >= 3) == (s["wait_ms"] > 0) and s["wait_ms"] <= 300_000


def test_signals_read_whole_texts(spark, tmp_path):
    """What a document says after its first 600 characters counts in its scores as what it says before."""
    from querypond import queries as core

    code = "```python\ndef alpha(): return beta\n```\n"
    filler = "plain words fill this line and say nothing. " * 20
    docs = [(1, code + "alpha beta gamma\n" + filler), (2, filler + code + "alpha beta gamma\n")]
    rows = [(i, t, "en", "readmes", len(t), "a.example", f"https://a.example/{i}", "A title", None, None) for i, t in docs]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, host string, url string, title string, published_at timestamp, fetched_at timestamp"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(7, "s", "k", "alpha beta gamma")], "item_id bigint, suite string, kind string, item_text string").write.parquet(str(tmp_path / "eval_items.parquet"))
    final = {r.doc_id: r.final_score for r in core.final_scores(spark, str(tmp_path)).collect()}
    assert final[1] == final[2]
    again = {r.doc_id: (r.alignment, r.rerank_score) for r in core.reranked(spark, str(tmp_path)).collect()}
    assert again[1] == again[2] and len(again) == 2


def test_all_results_are_judged(spark, tmp_path, monkeypatch):
    """The metrics of a query with more results than any cap, counted in parts, against plain loops."""
    import random

    from querypond import queries as core
    from querypond.operators import evaluate

    monkeypatch.setattr(evaluate, "PART", 7)
    rng = random.Random(2)
    rels = {q: [rng.choice([-1, 0, 1, 2, 3]) for _ in range(n)] for q, n in (("a", 60), ("b", 3), ("c", 26))}
    df = spark.createDataFrame([(q, i, r, f"p{i % 29}") for q, rs in rels.items() for i, r in enumerate(rs, 1)], "query_id string, pos int, rel int, provider string")
    for r in evaluate.metrics(df).collect():
        rs = rels[r.query_id]
        hit = [x >= 1 for x in rs]
        misses = len(hit) - sum(hit)
        bpref = sum(1 - (sum(not h for h in hit[:i]) / misses if misses else 0) for i in range(len(hit)) if hit[i]) / max(1, sum(hit))
        assert abs(r.bpref - bpref) < 1e-9 and abs(r.r10 - sum(hit[:10]) / max(3, sum(hit))) < 1e-9 and r.diversity == min(29, len(rs))
        ap = sum(sum(hit[: i + 1]) / (i + 1) for i in range(min(10, len(hit))) if hit[i]) / max(3, sum(hit))
        assert abs(r.map - ap) < 1e-9
    schema = "result_id bigint, provider_ref string, query_id string, url string, title string, snippet string, provider string, published_at string, author string, fetched_at timestamp, ingested_at timestamp"
    rows = [(i, str(i), "q", f"https://a.example/{i}", f"Title {i}", "text", "p", None, None, None, None) for i in range(40)]
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "search_results.parquet"))
    assert sorted(r.pos for r in core.judge_match(spark, str(tmp_path)).collect()) == list(range(1, 41))

