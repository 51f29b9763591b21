"""Ranking signals and planner rules as expressions over named columns (url, host, title, snippet, provider, author ...)."""

from __future__ import annotations

from querypond import constants as K
from querypond.functions.dialect import Spark

NOW = "TIMESTAMP '2026-01-01 00:00:00'"


def first(rules: list[tuple[str, str]], otherwise: str) -> str:
    return "CASE " + " ".join(f"WHEN {c} THEN {v}" for c, v in rules) + f" ELSE {otherwise} END"


def any_of(d: Spark, x: str, items: list[str]) -> str:
    return "(" + " OR ".join(d.contains(x, i) for i in items) + ")"


def within(x: str, items) -> str:
    return f"{x} IN (" + ", ".join(f"'{i}'" for i in items) + ")"


def half_up(x: str) -> str:
    return f"floor(({x}) + 0.5)"


def host(d: Spark, url: str = "url") -> str:
    """Host in lower case without www.; null where the address has none."""
    found = d.extract(f"lower({url})", r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)", 1)
    return f"nullif({d.replace(found, '^www[.]', '')}, '')"


def normal_url(d: Spark, url: str = "url") -> str:
    return f"lower({d.replace(d.replace(url, r'[?#].*$', ''), r'/+$', '')})"


def trust(host: str = "host") -> str:
    rules = [(within(host, hosts), f"{score}") for score, hosts in K.TRUST_HOSTS.items()]
    return first([(f"{host} IS NULL", "40"), *rules, (f"{host} LIKE '%.edu'", "95")], "40")


def credibility(d: Spark, host: str = "host", provider: str = "provider") -> str:
    high = f"CASE WHEN {any_of(d, host, K.CREDIBLE)} THEN 15 ELSE 0 END"
    low = f"CASE WHEN {any_of(d, host, K.DOUBTFUL)} THEN 15 ELSE 0 END"
    return f"greatest(0, least(100, 50 + {high} - {low} + CASE WHEN {within(provider, K.CREDIBLE_PROVIDERS)} THEN 10 ELSE 0 END))"


def adjusted_trust(d: Spark) -> str:
    return f"CASE WHEN host IS NULL THEN {trust()} ELSE {half_up(f'least(100.0, ({trust()}) * ({credibility(d)}) / 50.0)')} END"


def freshness(d: Spark, published: str = "published_at", now: str = NOW) -> str:
    age = f"({d.seconds(now)} - {d.seconds(d.time(published))})"
    day = 86_400
    return first([(f"{published} IS NULL OR {d.time(published)} IS NULL", "50"), (f"{age} < {day}", "100"), *[(f"{age} <= {n * day}", str(v)) for n, v in ((7, 95), (30, 90), (180, 75), (365, 60))]], "30")


def popularity(d: Spark) -> str:
    s = "coalesce(snippet, '')"
    step = lambda provider, base, more, pattern: [(f"provider = '{provider}' AND {d.match(s, pattern)}", more), (f"provider = '{provider}'", base)]
    rules = [("url IS NULL OR url = ''", "0.5")]
    rules += step("github", "0.85", "0.95", r"\d+[kK]?\s*stars") + step("npm", "0.8", "0.9", r"\d+[kKmMbB]?\s*(downloads|weekly)") + step("pypi", "0.75", "0.85", r"\d+[kKmMbB]?\s*downloads") + step("stackexchange", "0.75", "0.85", r"\d+[kK]?\s*views")
    rules += step("reddit", "0.65", "0.8", r"\d+\s*(points?|comments?|upvotes?)") + step("hackernews", "0.65", "0.8", r"\d+\s*(points?|comments?|upvotes?)") + [("provider = 'wikipedia'", "0.7")]
    rules += step("arxiv", "0.6", "0.8", r"\d+\s*citations") + step("crossref", "0.6", "0.8", r"\d+\s*citations") + [("provider = 'mdn'", "0.75")]
    return first(rules, "0.5")


def code_quality(d: Spark) -> str:
    s = "coalesce(snippet, '')"
    hits = " + ".join(f"CASE WHEN {d.match(s, p)} THEN 1 ELSE 0 END" for p in K.CODE_INDICATORS)
    return first([("url IS NULL OR url = ''", "0.5"), *[(d.match("url", p), str(v)) for p, v in K.CODE_HOSTS], (f"({hits}) >= 3", "0.75"), (f"({hits}) >= 1", "0.6")], "0.5")


def has_examples(d: Spark, text: str) -> str:
    blocks, inline = d.count(text, r"(?s)```.*?```"), d.count(text, r"`[^`]{2,}`")
    return first([(f"{text} IS NULL OR trim({text}) = ''", "0.5"), (f"{blocks} >= 3", "0.95"), (f"{blocks} >= 1", "0.85"), (f"{inline} >= 5", "0.75"), (f"{inline} >= 2", "0.65"), (d.match(text, K.EXAMPLE_INDICATORS), "0.6")], "0.5")


def authority(d: Spark, trust_value: str) -> str:
    listed = "(" + " OR ".join([within("host", K.HIGH_AUTHORITY), *[f"host LIKE '%.{h}'" for h in K.HIGH_AUTHORITY]]) + ")"
    base = f"CASE WHEN {listed} THEN greatest({trust_value} / 100.0, 0.85) ELSE {trust_value} / 100.0 END"
    author = f"CASE WHEN author IS NULL OR trim(author) = '' THEN 0.0 WHEN {d.match('trim(author)', '^[A-Z][a-z]+[ ][A-Z][a-z]+', False)} THEN 0.15 ELSE 0.05 END"
    return f"CASE WHEN url IS NULL OR url = '' THEN 0.5 ELSE least(1.0, ({base}) + ({author})) END"


def source_quality(d: Spark) -> str:
    base = first([(f"provider = '{p}'", str(v)) for p, v in K.PROVIDER_QUALITY.items()], "0.45")
    rule = first([(d.match("url", p), str(v)) for p, v in K.URL_QUALITY], "0.0")
    raised = f"greatest({base}, {rule})"
    return f"CASE WHEN {d.match('lower(url)', K.LISTICLE)} THEN least({raised}, 0.25) ELSE {raised} END"


def clickbait(d: Spark, text: str) -> str:
    low = f"lower({text})"
    phrases = " + ".join(f"CASE WHEN {d.contains(low, p)} THEN 0.2 ELSE 0.0 END" for p in K.CLICKBAIT)
    bangs = f"CASE WHEN ({d.count(text, '!')}) / greatest(length({text}) / 500.0, 1.0) > 2 THEN 0.3 ELSE 0.0 END"
    long_words = d.keep(d.split(text, "[ \\t\\n\\r]+"), "length(w) >= 3")
    capital = d.keep(long_words, "w = upper(w) AND " + d.match("w", "[A-Z]", False))
    capitals = f"CASE WHEN {d.size(long_words)} > 0 AND {d.size(capital)} * 1.0 / {d.size(long_words)} > 0.2 THEN 0.3 ELSE 0.0 END"
    return f"least({phrases} + {bangs} + {capitals}, 1.0)"


def ad_share(d: Spark, text: str) -> str:
    blocks = d.keep(d.split(text, "\\n[ \\t]*\\n+"), "trim(w) <> ''")
    ads = d.keep(blocks, "length(trim(w)) <= 80 AND " + d.match("w", r"https?://|www\."))
    return f"CASE WHEN {d.size(blocks)} = 0 THEN 0.0 ELSE least({d.size(ads)} * 1.0 / {d.size(blocks)} / 0.3, 1.0) END"


def spam(d: Spark, text: str, stuffing: str, trust_value: str, intent: str = "''") -> str:
    raw = half_up(f"least(100.0 * (0.4 * ({stuffing}) + 0.4 * ({clickbait(d, text)}) + 0.2 * ({ad_share(d, text)})), 100.0)")
    trusted = f"CASE WHEN {trust_value} >= 80 THEN {half_up(f'({raw}) * 0.1')} ELSE {raw} END"
    return f"CASE WHEN {text} IS NULL OR trim({text}) = '' THEN 0.0 WHEN {intent} = 'news' THEN {half_up(f'({trusted}) * 0.5')} ELSE {trusted} END"


def final_score(boost: str = "1.0") -> str:
    bm = "CASE WHEN bm25 > 0.5 AND semantic < 0.55 AND semantic <> 0.5 THEN bm25 * 0.5 ELSE bm25 END"
    raw = f"0.20 * trust / 100.0 + 0.20 * ai_relevance + 0.13 * semantic + 0.11 * ({bm}) + 0.10 * freshness / 100.0 + 0.10 * coalesce(source_quality, 0.5) + 0.05 * popularity + 0.04 * code_quality + 0.03 * has_examples + 0.02 * authority - 0.25 * spam / 100.0"
    return f"greatest(0.0, least(100.0, (100.0 * ({raw}) - CASE WHEN bm25 < 0.01 THEN 15.0 ELSE 0.0 END) * {boost}))"


def language(d: Spark, text: str) -> str:
    return first([*[(d.match(text, p, False), f"'{code}'") for code, p in K.SCRIPTS], *[(d.match(text, p), f"'{code}'") for code, p in K.LATIN_HINTS]], "'en'")


def intent(d: Spark, text: str) -> str:
    return first([(d.match(text, p, i > 0), f"'{name}'") for i, (name, p) in enumerate(K.INTENT_RULES)], "'general'")


def news_counts(d: Spark, text: str) -> list[tuple[str, str]]:
    return [(name, "(" + " + ".join(f"CASE WHEN {d.match(text, p)} THEN 1 ELSE 0 END" for p in patterns) + ")") for name, patterns in K.NEWS_CLASSES.items()]


def news_class(names: list[str], prefix: str = "n_") -> str:
    """The class with most hits, the earlier of equals, from columns of hits."""
    best = f"greatest({', '.join(prefix + n for n in names)})"
    return first([(f"{best} = 0", "'general'"), *[(f"{prefix}{n} = {best}", f"'{n}'") for n in names]], "'general'")


def entity_domain(d: Spark, text: str) -> str:
    return first([("(" + " OR ".join(d.match(text, p) for p in patterns) + ")", f"'{name}'") for name, patterns, _, _ in K.ENTITY_DOMAINS], "CAST(NULL AS VARCHAR(40))")


def hedged(d: Spark, text: str) -> str:
    return "(" + " OR ".join(d.match(text, p) for p in K.HEDGING) + ")"


def ai_targeted(d: Spark, text: str) -> str:
    return "(" + " OR ".join(d.match(text, p) for p in K.AI_TARGETED) + ")"


def boost(d: Spark, query: str, provider: str) -> str:
    hits = " OR ".join(f"({d.contains(f'lower({query})', word)} AND {provider} = '{p}')" for word, p in K.KEYWORD_BOOSTS)
    return f"CASE WHEN {hits} THEN 1.5 ELSE 1.0 END"


def boost_with_news(d: Spark, query: str, provider: str, news: str) -> str:
    """The boost by words, raised for the sources of the query's class of news."""
    rules = [(f"{news} = '{c}' AND {provider} = '{p}'", f"greatest({boost(d, query, provider)}, {v})") for c, sources in K.NEWS_BOOSTS.items() for p, v in sources.items()]
    return first(rules, boost(d, query, provider))


def credibility_multiplier(score: str) -> str:
    """0.8 to 1.2 by a credibility of 0 to 100; 1 where there is none."""
    return f"CASE WHEN {score} IS NULL THEN 1.0 ELSE 0.8 + {score} / 100.0 * 0.4 END"


def topics(d: Spark, text: str) -> str:
    """Words of four letters or more that are no stop words."""
    return d.keep(d.words(text), "length(w) >= 4 AND NOT " + within("w", K.TOPIC_STOPWORDS))


def title_words(d: Spark, text: str) -> str:
    clean = d.replace(d.replace(f"lower({text})", "[^a-z0-9 \\t]", ""), "[ \\t]+", " ")
    return d.distinct(d.keep(d.split(f"trim({clean})", " "), "length(w) > 2"))


def jaccard(d: Spark, a: str, b: str) -> str:
    both = d.size(d.common(a, b))
    return f"CASE WHEN {d.size(a)} + {d.size(b)} = 0 THEN 0.0 ELSE {both} * 1.0 / ({d.size(a)} + {d.size(b)} - {both}) END"
