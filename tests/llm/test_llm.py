"""Training-data operators against brute force, and on nulls, empty tables, ties, repeated rows, long texts and odd columns."""

import random
import re
from collections import Counter
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from querypond.llm import boilerplate, chosen_path, knn, leakage, mixing, page_lines, page_table, residue, segmenting, truncation

T0 = datetime(2024, 1, 1)


# 1 -------------------------------------------------------------------------------------------------------------------
def clustered(n=600, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(n // 6, 64))
    x = centres[rng.integers(len(centres), size=n)] + 0.25 * rng.normal(size=(n, 64))
    return x * rng.uniform(0.2, 9, size=(n, 1))


def brute_neighbours(ids, x, k=5, least=0.92):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    out = set()
    for i in range(len(ids)):
        near = [j for j in range(len(ids)) if j != i and s[i, j] >= least]
        for j in sorted(near, key=lambda j: (-s[i, j], ids[j]))[:k]:
            out.add((min(ids[i], ids[j]), max(ids[i], ids[j])))
    return out


@pytest.mark.parametrize("factor", [1.0, 4.0])
def test_neighbours_against_brute_force(spark, factor):
    x = clustered().astype(np.float32)
    ids = list(range(100, 100 + len(x)))
    df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in zip(ids, x)], "entry_id bigint, embedding array<float>, hit_count int")
    got = {(r.entry_a, r.entry_b) for r in knn.neighbour_pairs(knn.nearest_vectors(df, factor=factor, rows_per_point=40)).collect()}
    want = brute_neighbours(ids, x.astype(float))
    assert len(got & want) >= (0.999 if factor == 1 else 0.97) * len(want) and len(got - want) <= 0.01 * len(want)


def test_neighbours_split_shards(spark):
    x = clustered(400, 3).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "entry_id bigint, embedding array<float>, hit_count int")
    whole = knn.nearest_vectors(df, factor=1, rows_per_point=1000)
    parts = knn.nearest_vectors(df, factor=1, rows_per_point=1000, shard_rows=70)
    key = lambda d: {(r.id, r.neighbour) for r in d.collect()}
    assert key(whole) == key(parts)


def test_neighbours_odd_rows(spark):
    one = [1.0] + [0.0] * 63
    near = [1.0, 0.01] + [0.0] * 62
    rows = [(i, one, 0, "x") for i in range(1, 10)] + [(3, one, 5, "x"), (20, near, 0, None), (21, [0.0] * 64, 0, None), (22, None, 0, None), (23, [1.0] * 48, 0, None), (24, [float("nan")] + [1.0] * 63, 0, None), (25, [float("inf")] + [1.0] * 63, 0, None), (None, one, 0, None), (26, [None] + [1.0] * 63, 0, None)]
    df = spark.createDataFrame(rows, "entry_id bigint, embedding array<float>, hit_count int, v string").withColumn("id", F.lit(1))
    got = {}
    for r in knn.nearest_vectors(df, newest="hit_count").collect():
        got.setdefault(r.id, []).append((r["rank"], r.neighbour))
    assert set(got) == {*range(1, 10), 20}
    assert [n for _, n in sorted(got[1])] == [2, 3, 4, 5, 6] and [n for _, n in sorted(got[9])] == [1, 2, 3, 4, 5] and [n for _, n in sorted(got[20])] == [1, 2, 3, 4, 5]
    assert knn.nearest_vectors(df.limit(0)).count() == 0


# 2 -------------------------------------------------------------------------------------------------------------------
PAGES = [
    (1, "A title", "# A title\n\nHello {{ name }}, welcome to the long page about things.", True),
    (2, "[[product]] | Shop", "# x\n\nReal text of some length that says things in sentences.", True),
    (3, "Docs", "Write `{{ name }}` to greet.\n\n```\n{{ body }}\n${x}\n```\n\nThe renderer then fills both of them in for you.", False),
    (4, "Oops", "# 404\n\nThe page you requested could not be found. It may have been moved or removed.", True),
    (5, "Designs", "# Designs\n\nDesigners still paste lorem ipsum into mock-ups, as 676 screenshots of the archive prove.", False),
    (6, "Filler", "# Filler\n\nLorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod.", True),
    (7, "App", "You need to enable JavaScript to run this app.\n\n© 2024 Site. All rights reserved.", True),
    (8, "Post", "# Post\n\nA page of real content with several words in a sentence.\n\nPlease enable JavaScript to view the comments.", False),
    (9, "Gateways", "# What 502 Bad Gateway means\n\nWhen the proxy answered 502 Bad Gateway, the client waited 5 seconds and tried again.", False),
    (10, None, None, False),
    (11, "", "", False),
    (12, "Methods", "The __init__ and __call__ methods of the class cost nothing, compare [3] and the [sic] in {low, mid, high}.", False),
    (13, "Set", "Zugriff verweigert.", True),
    (14, "Long", "word " * 200_000, False),
]


def test_residue(spark):
    df = spark.createDataFrame([(i, t, m, "docs.site.example", T0, 7) for i, t, m, _ in PAGES] + [(4, "Oops", PAGES[3][2], "docs.site.example", T0, 7), (None, "404", "404", "h", T0, 7)], "extraction_id bigint, title string, markdown string, host string, extracted_at timestamp, id int")
    got = [r.id for r in residue.find_residue(df).collect()]
    assert sorted(got) == sorted(i for i, _, _, want in PAGES if want)
    assert residue.find_residue(df.limit(0)).count() == 0


def test_residue_labels_spread(spark):
    known = "internal server error reference 0 please go back to the start page of the service and try again in a few minutes"
    unknown = known.replace("internal server error", "our systems hiccuped").replace("few", "few")
    near = known.replace("few minutes", "few seconds")
    links = residue.near_links(spark.createDataFrame([(1, known), (2, near), (3, unknown + " now and then"), (4, "something else entirely that shares nothing with it at all")], "class bigint, body string"), similarity=0.6, hamming=20)
    assert (1, 2) in {(r.a, r.b) for r in links.collect()}
    chain = spark.createDataFrame([(i, i + 1) for i in range(1, 9)] + [(20, 21)], "a bigint, b bigint")
    assert {(r.node, r.component) for r in residue.components(chain).collect()} == {(i, 1) for i in range(1, 10)} | {(20, 20), (21, 20)}


def edited_bodies(n=150, seed=12):
    """Bodies of 25 to 120 words, each with versions that lost or changed words at the ends or inside."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("bcdfglmnprstv") + rng.choice("aeiou") for _ in range(3))
    out = []
    for _ in range(n):
        base = [word() for _ in range(rng.randrange(25, 120))]
        out.append(" ".join(base))
        for _ in range(2):
            k = rng.randrange(1, max(2, len(base) // 9))
            out.append(" ".join(base[k:] + [word() for _ in range(rng.randrange(k))] if rng.random() < 0.5 else base[: len(base) // 2] + [word()] + base[len(base) // 2 + 1 :]))
    return list(enumerate(dict.fromkeys(out)))


def test_residue_links_against_brute_force(spark):
    rows = edited_bodies()
    sets = [set(residue.shingles(b)) for _, b in rows]
    want = {(i, j) for i, x in enumerate(sets) for j in range(i + 1, len(sets)) if len(x & sets[j]) >= 0.8 * len(x | sets[j])}
    got = {(r.a, r.b) for r in residue.near_links(spark.createDataFrame(rows, "class bigint, body string")).collect()}
    assert got <= want and len(got) >= 0.99 * len(want) and len(want) > 150


def test_residue_spreads_to_long_pages(spark):
    """A page of more words than any rule knows, nearly equal to residue, is found; unless trusted content is as near."""
    lorem = "Lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua"
    known = "\n\n".join(["Internal server error, reference " + w for w in "able baker charlie dog easy fox george how item jig king love".split()] + [lorem] * 2)
    near = known + "\n\nOur machines hiccuped and nobody knows why"
    real = "\n\n".join(f"Report {w} tells in plain words how the harvest of {w} went this year" for w in "oats rye wheat barley hops flax".split())
    rows = [(1, "A", known, "a.example", T0), (2, "A", near, "a.example", T0), (3, "A", real, "a.example", T0)]
    df = spark.createDataFrame(rows, "extraction_id bigint, title string, markdown string, host string, extracted_at timestamp")
    assert {r.id: r.reason for r in residue.find_residue(df).collect()} == {1: "residue", 2: "near-duplicate"}
    cited = near.replace("knows why", "[knows](https://b.example/x) why it")
    more = spark.createDataFrame([(4, "A", cited, "a.example", T0)], df.schema)
    assert {r.id for r in residue.find_residue(df.unionByName(more)).collect()} == {1}


# 3 -------------------------------------------------------------------------------------------------------------------
def records(n=400, seed=2):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(3000)]
    common = ["the", "a", "of", "and", "to", "in"]
    out = []
    while len(out) < n:
        base = rng.sample(words, 22) + rng.sample(common, 5)
        for _ in range(rng.choice([1, 1, 2, 4])):
            t = list(base)
            for _ in range(rng.randrange(4)):
                t[rng.randrange(len(t))] = rng.choice(words)
            rng.shuffle(t)
            out.append((len(out), " ".join(t[:6]), " ".join(t[6:]), T0))
    return out


def brute_pairs(rows, threshold=0.7, least=16):
    sets = {i: set(re.findall("[a-z0-9]+", f"{t or ''} {s or ''}".lower())) for i, t, s, _ in rows}
    ids = [i for i in sets if len(sets[i]) >= least]
    return {(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b])}


def test_near_duplicates_against_brute_force(spark):
    rows = records()
    rows += [(1000, rows[0][1].upper(), rows[0][2], T0), (1001, None, rows[1][1] + " " + rows[1][2], T0), (1002, "short text", None, T0), (1003, None, None, T0), (0, *rows[0][1:])]
    df = spark.createDataFrame([(*r, 5) for r in rows] + [(None, rows[0][1], rows[0][2], T0, 5)], "result_id bigint, title string, snippet string, ingested_at timestamp, class int")
    m, links = chosen_path.near_duplicates(df)
    got = {(r.result_a, r.result_b) for r in chosen_path.linked_pairs(m, links).collect()}
    want = brute_pairs(list({r[0]: r for r in rows}.values()))
    assert got <= want and len(got) >= 0.97 * len(want) and len(want) > 100
    per = {r.id: (r.class_size, r.links) for r in chosen_path.link_counts(m, links).collect()}
    degree = Counter(x for p in got for x in p)
    assert all(size - 1 + n == degree[i] for i, (size, n) in per.items())
    assert chosen_path.linked_pairs(*chosen_path.near_duplicates(df.limit(0))).count() == 0


def test_groups_hold_all_records(spark, tmp_path):
    from querypond.llm import queries

    rng = random.Random(3)
    rows = records(150)
    t = []
    for i in range(150):
        t = [*t, rng.choice("the a of and".split())][rng.randrange(2) :] if i % 4 and len(t) < 18 else [rng.choice("the a of and to in on at by for it is as or we be".split()) for _ in range(rng.randrange(1, 9))] + [f"v{rng.randrange(12)}" for _ in range(rng.randrange(9))]
        rows.append((5000 + i, " ".join(t[:3]), " ".join(t[3:]) or None, T0))
    rows += [(9000, "Same short text", "", T0), (9001, "same", "short TEXT", T0), (9002, None, None, T0), (9003, "", "...", T0)]
    spark.createDataFrame(rows, "result_id bigint, title string, snippet string, ingested_at timestamp").write.parquet(str(tmp_path / "search_results.parquet"))
    got = {r.id: r for r in queries.p3_groups(spark, str(tmp_path)).collect()}
    assert set(got) == {r[0] for r in rows}
    want = Counter(x for p in brute_pairs([r for r in rows if r[0] not in (9002, 9003)], least=0) for x in p)
    short = [i for i in got if i >= 5000]
    assert {i: got[i].class_size - 1 + got[i].links for i in short} == {i: want[i] for i in short} and sum(want[i] for i in short) > 50
    assert got[9000]["class"] == got[9001]["class"] and got[9000].class_size == 2 and got[9002]["class"] != got[9003]["class"]


@pytest.mark.parametrize("total", [40_000, 4_000_000, 100_000_000])
def test_recall_holds_as_paths_deepen(total):
    """Pairs right at the threshold meet in a bucket and pass the sketches at the frequencies of any number of records."""
    rng = np.random.default_rng(7)
    share = 0.3 / np.arange(1, 3001) ** 0.4
    frequency = np.zeros(chosen_path.COUNTERS)
    frequency[: len(share)] = np.maximum(2, share * total)
    draw = lambda n: rng.choice(len(share), size=n, replace=False, p=share / share.sum()).astype(np.int32)
    # 34 tokens each, 28 of them shared: 28 / 40 = 0.7
    pairs = [(t[:34], np.r_[t[:28], t[34:]]) for t in (rng.permutation(draw(40)) for _ in range(3000))]
    settings = dict(spread=1, bucket=64.0, max_depth=24, power=1.5)
    sample = [a for a, _ in pairs[:1000]]
    lengths = np.full(len(pairs), 34)
    depths = chosen_path.Paths(frequency, total, runs=1, width=12, **settings).depths(np.concatenate(sample), lengths[:1000])
    roots = chosen_path.roots_for(0.999, 0.7, depths, 12)
    runs = -(-roots // chosen_path.WIDEST)
    maker = chosen_path.Paths(frequency, total, runs=runs, width=-(-roots // runs), **settings)
    keys, sketches = [], []
    for side in (0, 1):
        tokens = np.concatenate([p[side] for p in pairs])
        keys.append(set(zip(*map(np.ndarray.tolist, maker.keys(tokens, lengths)))))
        sketches.append(maker.sketches(tokens, lengths))
    met = {i for i, _ in keys[0] & keys[1]}
    differ = np.bitwise_count(sketches[0] ^ sketches[1]).sum(axis=0)
    found = sum(i in met and differ[i] <= chosen_path.sketch_bound(0.7, 0.999) for i in range(len(pairs)))
    assert found >= 0.998 * len(pairs)


def test_later_delivery_counts(spark):
    a = " ".join(f"x{i}" for i in range(20))
    rows = [(1, a, "", T0), (2, a, "", T0), (2, "now quite other " + " ".join(f"y{i}" for i in range(20)), "", datetime(2024, 2, 1))]
    df = spark.createDataFrame(rows, "result_id bigint, title string, snippet string, ingested_at timestamp")
    assert chosen_path.linked_pairs(*chosen_path.near_duplicates(df)).count() == 0


def test_ties_leave_one_row_an_id(spark):
    words = lambda p, n: " ".join(f"{p}{i}" for i in range(n))
    rows = [(1, words("x", 20), "", T0), (1, words("x", 21), "", T0), (2, words("x", 21), "", T0), (3, words("x", 21), "", None), (3, words("z", 30), "", None)]
    df = spark.createDataFrame(rows, "result_id bigint, title string, snippet string, ingested_at timestamp")
    for order in ("title", "snippet"):
        m, links = chosen_path.near_duplicates(df.orderBy(F.col(order).desc()))
        assert sorted(r.id for r in m.collect()) == [1, 2, 3]
        assert [tuple(r) for r in chosen_path.linked_pairs(m, links).collect()] == [(1, 2)]


@pytest.mark.parametrize("below", [None, 10])
def test_exact_links(spark, below):
    """All links, whatever the size of the sets; with a bound, those of the smaller sets."""
    rng = random.Random(9)
    sets = [sorted(rng.sample(range(11), rng.randrange(1, 9))) for _ in range(300)] + [sorted(rng.sample(range(30), rng.randrange(9, 25))) for _ in range(250)]
    sets = [list(x) for x in dict.fromkeys(map(tuple, sets))]
    df = spark.createDataFrame([(i, i, x) for i, x in enumerate(sets)], "id bigint, class bigint, tokens array<int>")
    got = {(r.class_a, r.class_b) for r in chosen_path.exact_links(df, threshold=0.7, below=below).collect()}
    like = lambda x, y: len({*x} & {*y}) >= 0.7 * len({*x} | {*y})
    want = {(i, j) for i, x in enumerate(sets) for j in range(i + 1, len(sets)) if like(x, sets[j]) and (below is None or min(len(x), len(sets[j])) < below)}
    assert got == want and len(want) > 30


# 5 -------------------------------------------------------------------------------------------------------------------
def test_minimum_cut_is_minimal():
    rng = random.Random(5)
    for _ in range(60):
        n = rng.randrange(1, 9)
        f, c = [rng.uniform(0, 3) for _ in range(n)], [rng.uniform(0, 3) for _ in range(n)]
        edges = [(a, b, rng.uniform(0, 2)) for a in range(n) for b in range(a + 1, n) if rng.random() < 0.5]
        cost = lambda labels: sum(f[i] if x else c[i] for i, x in enumerate(labels)) + sum(w for a, b, w in edges if labels[a] != labels[b])  # noqa: E731, B023
        best = min(cost([bool(k >> i & 1) for i in range(n)]) for k in range(1 << n))
        assert cost(boilerplate.minimum_cut(f, c, edges)) == pytest.approx(best)


def test_lines_of_pages():
    text = "[Home](/h) | [About](/a)\n\n# Title\n\n```\ncode <b>\n```\n\n- [Other](https://x.y/z)\n---\n"
    got = [(x.number, x.role, x.inside, x.outside) for x in page_lines.markdown_lines(text)]
    assert got == [(1, "p", 2, 0), (3, "h1", 0, 0), (6, "code", 0, 0), (9, "li", 0, 1)]
    html = "<div>\n<script>var a = 1;</script>\n<nav>\n<a href='/x'>Go</a>\n</nav>\n<h1>T</h1>\n<pre><code>\nk\n</code></pre>\n<style>\np {}\n</style>\n<p>Text &amp; more</p>\n</div>"
    got = [(x.number, x.role, x.side, x.text) for x in page_lines.html_lines(html)]
    assert got == [(4, "p", True, "Go"), (6, "h1", False, "T"), (8, "code", False, "k"), (13, "p", False, "Text & more")]


def test_wording_is_searched_whole():
    """The prefilter passes all that the patterns match, in lines of any length."""
    texts = [
        "We use cookies on this site", "Cookies: accept them", "Our partners store data", "We value your privacy", "With optional trackers", "Wir verwenden Cookies", "Wie diese Website Daten speichert", "Zur Datenschutzerklärung", "Ici ce site pose des cookies", "Notre politique de confidentialité", "Aquí usamos cookies", "Que este sitio usa cookies", "Nuestra política de privacidad",
        "Text © A", "A Copyright B", "The (c) 2024 A", "With all rights reserved", "Hier alle Rechte vorbehalten", "Ici tous droits réservés", "Con todos los derechos", "A registered trademark of B", "Our Sitemap | B", "Our accessibility |", "Our imprint", "Das Datenschutz |", "Die AGB", "Our newsletter each week", "El boletín de la semana", "La lettre de la semaine", "Den Newsletter bestellen",
        "Now sign up for it", "Now subscribe to our list", "News in your inbox", "To create a free account", "Please sign in to save", "Please log in to reply", "Click to view the comments", "So was this page helpful", "Dites, cette page vous a-t-elle été utile ?", "Just try it free",
    ]
    for text in texts:
        for line in (text, text.upper(), "one " * 30 + text):
            m = page_lines._FREE.search(line)
            page = [page_lines.Line(i, x) for i, x in enumerate(("nothing of the kind", line, "İ other"))]
            page_lines.find_wording(page)
            assert m and [x.wording for x in page] == [-1, m.start(), -1], line


def site_pages(n=40):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("bcdfglmnprstv") + rng.choice("aeiou") for _ in range(3))
    out, truth = [], set()
    for i in range(n):
        site = f"site{'abcdefgh'[i % 8] * 3}"
        lines = [("[Home](/home) | [Jobs](/jobs)", True), ("", None), (f"# {word()} {word()} and {word()}", False), ("", None)]
        for _ in range(rng.randrange(2, 6)):
            lines += [(f"The {word()} of {word()} was {word()} when it {word()} the {word()} for {rng.randrange(99)} days.", False), ("", None)]
        lines += [("We use cookies to improve your visit. Accept all or manage preferences.", True), ("## Related articles", True), (f"- [{word()} {word()}](/x-{i})", True), (f"- [{word()} {word()}](/y-{i})", True), ("", None), (f"© 2024 {site}. All rights reserved.", True)]
        out.append((i, f"www.{site}.example", "\n".join(t for t, _ in lines)))
        truth |= {(i, k) for k, (_, f) in enumerate(lines, 1) if f}
    return out, truth


def test_bodies(spark):
    pages, truth = site_pages()
    df = spark.createDataFrame([(i, h, t, T0, 1) for i, h, t in pages] + [(99, "h.example", None, T0, 1), (98, None, "", T0, 1), (None, "h", "x", T0, 1), (0, *pages[0][1:], T0, 1)], "extraction_id bigint, host string, markdown string, extracted_at timestamp, id int")
    rows = page_table.common_form(df, id_col="extraction_id", title=None, text="markdown", host="host", at="extracted_at", html=False)
    labels = boilerplate.label_lines(page_table.parsed(rows))
    assert {(r.id, r.line_no) for r in labels.where("furniture").collect()} == truth
    body = {r.id: r.body for r in boilerplate.main_bodies(rows, labels).collect()}[0]
    assert body.startswith("\n# ") and "cookies" not in body and "Home" not in body
    assert boilerplate.label_lines(page_table.parsed(rows.limit(0))).count() == 0


# 6 -------------------------------------------------------------------------------------------------------------------
def test_truncation(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("bcdfglmnprstv") + rng.choice("aeiou") for _ in range(3))
    sentence = lambda: f"The {word()} of {word()} {word()} the {word()} in {rng.randrange(99)} {word()} {word()}."
    rows = [(i, "p", T0, " ".join(sentence() for _ in range(4))) for i in range(300)]
    cases = {
        1000: ("A finished one. " + sentence(), False), 1001: (sentence() + " The " + word(), True), 1002: (sentence() + " The re…", True), 1003: (sentence() + " The red one [...]", True), 1004: (sentence() + " It was `x = 1`", False), 1005: (sentence() + " https://a.example/page", False), 1006: ("Topics: one, Two, three, Four, five", False), 1007: ("12 answers · 345 views · One · two · Three", False),
        1008: (sentence() + " The resi-", True), 1009: (sentence() + " The r�", True), 1010: (sentence() + " It is <a hr", True), 1011: (sentence() + " [435 chars]", False), 1012: ("“" + sentence() + "”", False), 1013: (sentence() + " The one of &#82", True), 1014: (None, None), 1015: ("   ", None), 1016: (sentence() * 20_000 + " The", True),
    }
    rows += [(i, "q", T0, t) for i, (t, _) in cases.items()] + [(1000, "q", T0, cases[1000][0]), (None, "q", T0, "The")]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "rid bigint, provider string, seen timestamp, snippet string, cut int, final int")
    texts = truncation.texts_of(df, src="s", id_col="rid", text="snippet", source="provider", at="seen")
    flags = truncation.cut_texts(texts)
    got = {r.id: r.cut for r in flags.collect()}
    assert {i: got.get(i) for i in cases} == {i: w for i, (_, w) in cases.items()} and not any(got[i] for i in range(300))
    share = {r.source: (r.texts, r.cut_texts) for r in truncation.cut_shares(flags).collect()}
    assert share["p"] == (300, 0) and share["q"] == (15, sum(bool(w) for _, w in cases.values()))
    assert truncation.cut_texts(texts.limit(0)).count() == 0


def test_words_tell_what_shapes_do_not(spark):
    """After an abbreviation with a full stop a text looks finished; its words are frequent inside and never final. Scripts without case have a shape."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("bcdfglmnprstv") + rng.choice("aeiou") for _ in range(3))
    rows = [(i, "p", T0, " ".join(f"{word().title()} {word()} the {word()} vs. The {word()} of {word()}." for _ in range(3))) for i in range(400)]
    rows += [(1000, "p", T0, f"{word().title()} {word()} the pear vs."), (1001, "p", T0, f"{word().title()} {word()} the pear."), (1002, "p", T0, "日本語の文。" * 2), (1003, "p", T0, "日本語の文。日本語")]
    rows += [(2000 + i, "p", T0, "Here the pear vs. The plum was dear. " * 3) for i in range(40)] + [(3000 + i, "p", T0, "日本語の文。" * 3) for i in range(40)]
    df = spark.createDataFrame(rows, "id bigint, provider string, seen timestamp, snippet string")
    got = {r.id: r.cut for r in truncation.cut_texts(truncation.texts_of(df, src="s", id_col="id", text="snippet", source="provider", at="seen")).collect()}
    assert (got[1000], got[1001], got[1002], got[1003]) == (True, False, False, True) and not any(got[i] for i in range(400))


# 7 -------------------------------------------------------------------------------------------------------------------
def brute_leaks(docs, items, run=13):
    tok = lambda t: re.findall("[a-z0-9]+", (t or "").lower())
    out = set()
    for d, text in docs:
        line = " " + " ".join(tok(text)) + " "
        for i, item in items:
            w = tok(item)
            if w and any(" " + " ".join(w[k : k + run]) + " " in line for k in range(max(1, len(w) - run + 1))):
                out.add((d, i))
    return out


def test_leaks_against_brute_force(spark):
    rng = random.Random(8)
    words = [f"{a}{b}" for a in ("ka", "lo", "mi", "tu") for b in ("ra", "so", "ne", "vi", "do")]
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.choice([1, 5, 12, 13, 14, 40])))) for i in range(60)] + [(100, None), (101, "  "), (102, "...")]
    docs = []
    for d in range(80):
        t = [rng.choice(words) for _ in range(60)]
        w = items[rng.randrange(60)][1].split()
        k = rng.randrange(len(w))
        t[rng.randrange(50) : 0] = w[k : k + rng.choice([12, 13, 20])]
        docs.append((d, ", ".join(t).title()))
    docs += [(200, None), (201, ""), (202, "x " * 300_000 + items[3][1]), (0, docs[0][1])]
    df = spark.createDataFrame([(*d, 1) for d in docs], "doc_id bigint, text string, item int")
    it = spark.createDataFrame([*items, items[0]], "item_id bigint, item_text string")
    want = brute_leaks(docs, items)
    for passes in (20_000, 20):
        rows = leakage.find_leaks(df, it, items_per_pass=passes).collect()
        assert {(r.doc_id, r.item_id) for r in rows} == want and len(rows) == len(want)
    assert leakage.find_leaks(df.limit(0), it).count() == 0 and leakage.find_leaks(df, it.limit(0)).count() == 0


# 8 -------------------------------------------------------------------------------------------------------------------
def test_mixture(spark):
    rng = random.Random(6)
    docs = [(i, "word " * rng.randrange(5, 60), "abc"[min(2, i % 10)]) for i in range(1500)] + [(5000, None, "a"), (5001, "", "a"), (5002, "some words", "other"), (5003, "text", None), (0, "word", "a")]
    df = spark.createDataFrame([(*d, 3) for d in docs], "doc_id bigint, text string, source string, position int")
    targets = spark.createDataFrame([("a", 0.5, 4), ("b", 0.3, 2), ("c", 0.2, 1), ("gone", 0.0, 2), (None, 0.1, 2)], "source_name string, target_share double, max_repeats int")
    rows, report = mixing.mixture(df, targets, shard_tokens=4000)
    r = {x.source: x for x in report.collect()}
    for s, share in (("a", 0.5), ("b", 0.3), ("c", 0.2)):
        assert r[s].actual_share == pytest.approx(share, abs=0.004) and r[s].max_used <= r[s].max_repeats
    got = rows.collect()
    assert len({(x.doc_id, x.repeat_no) for x in got}) == len(got) and max(x.repeat_no for x in got) < 4 and len({x.shard for x in got}) > 3
    by = Counter()
    for x in got:
        by[x.shard] += x.n_tokens
    assert max(by.values()) < 2.5 * min(by.values())
    assert sorted(x.position for x in got if x.shard == 0) == list(range(sum(x.shard == 0 for x in got)))
    assert [x.n_tokens for x in mixing.mixture(df, targets, shard_tokens=4000)[0].orderBy("shard", "position").limit(50).collect()] == [x.n_tokens for x in rows.orderBy("shard", "position").limit(50).collect()]
    empty, rep = mixing.mixture(df.limit(0), targets)
    assert empty.count() == 0 and rep.count() == 4


def test_mixture_holds_texts(spark, tmp_path):
    from querypond.llm import queries

    docs = [(i, f"text {i} " + "word " * (i % 40), "ab"[i % 2]) for i in range(300)]
    spark.createDataFrame([*docs, (301, None, "a")], "doc_id bigint, text string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([("a", 0.7, 3), ("b", 0.3, 1)], "source_name string, target_share double, max_repeats int").write.parquet(str(tmp_path / "mix_targets.parquet"))
    got = queries.p8_mixture(spark, str(tmp_path)).collect()
    text = {i: t for i, t, _ in docs}
    assert len(got) > 200 and all(r.text == text[r.doc_id] for r in got) and len({(r.doc_id, r.repeat_no) for r in got}) == len(got)


def test_splitting_tree():
    rng = np.random.default_rng(1)
    tree = mixing.split_blocks(np.array([50, 7, 0, 300]), 6, rng)
    assert tree.sum(axis=0).tolist() == [50, 7, 0, 300] and tree.sum(axis=1).max() - tree.sum(axis=1).min() <= 2 and (tree >= 0).all()


# 9 -------------------------------------------------------------------------------------------------------------------
def test_pieces(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("bcdfglmnprstv") + rng.choice("aeiou") for _ in range(3))
    prose = "\n\n".join(" ".join(" ".join(word() for _ in range(9)).capitalize() + "." for _ in range(6)) for _ in range(40))
    docs = [(1, prose), (2, "short"), (3, None), (4, ""), (5, "x" * 9000), (6, "日本語の文。" * 900), (7, "😀" * 3000), (8, "a b " * 600)]
    df = spark.createDataFrame([(*d, "c") for d in docs], "doc_id bigint, text string, piece_no string")
    enc = segmenting.encoder()
    pieces = {}
    for r in segmenting.split_documents(df).orderBy("doc_id", "piece_no").collect():
        pieces.setdefault(r.doc_id, []).append(r)
    assert set(pieces) == {d for d, t in docs if t and len(enc.encode_ordinary(t)) > 1024}
    for d, rows in pieces.items():
        text = dict(docs)[d]
        assert [r.piece_no for r in rows] == list(range(len(rows)))
        assert rows[0].first_char == 0 and rows[-1].first_char + rows[-1].n_chars == len(text)
        for r in rows:
            assert r.n_tokens <= 1024 and r.piece_text == text[r.first_char : r.first_char + r.n_chars] and len(enc.encode_ordinary(r.piece_text)) <= 1024
        for a, b in zip(rows, rows[1:]):
            assert 64 <= a.first_token + a.n_tokens - b.first_token <= 68
    assert all(r.piece_text.endswith(".") for r in pieces[1][:-1])
    assert segmenting.split_documents(df.limit(0)).count() == 0


def test_valley_is_chosen():
    """Two topics without a common word: the piece ends where the topic changes."""
    one, two = "alpha beta gamma delta. " * 120, "omega sigma kappa theta. " * 200
    enc = segmenting.encoder()
    text = one + two
    first = segmenting.split_text(enc, text)[0]
    assert text[first[3] :].lstrip().startswith("omega")
