"""Readers of XML, HTML and newline-delimited payloads (column body), in the common result schema."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from querypond.sources.registry import _form, plain


def _first(item, *tags: str):
    """The text of the first of some elements that is there."""
    found = [F.nullif(F.regexp_replace(F.regexp_extract(item, rf"(?is)<{t}(?:\s[^<>]*)?>(.*?)</{t}>", 1), r"(?s)^\s*<!\[CDATA\[(.*?)\]\]>\s*$", "$1"), F.lit("")) for t in tags]
    return F.coalesce(*found)


def _items(payloads: DataFrame, tag: str) -> DataFrame:
    return payloads.select(F.explode(F.regexp_extract_all("body", F.lit(rf"(?is)<{tag}[\s>].*?</{tag}>"), F.lit(0))).alias("item"))


def arxiv(payloads: DataFrame) -> DataFrame:
    """Atom entries: the alternate link, the first author, the abstract's first 400 characters."""
    item = F.col("item")
    link = F.coalesce(F.nullif(F.regexp_extract(item, r"(?is)<link[^>]*rel=[\"']alternate[\"'][^>]*href=[\"']([^\"']+)", 1), F.lit("")), F.nullif(F.regexp_extract(item, r"(?is)<link[^>]*href=[\"']([^\"']+)[\"'][^>]*rel=[\"']alternate", 1), F.lit("")), _first(item, "id"))
    return _form(_items(payloads, "entry"), "arxiv", id=_first(item, "id"), url=link, title=plain(_first(item, "title")), snippet=F.substring(plain(_first(item, "summary")), 1, 400), published_at=_first(item, "published"), author=plain(_first(item, "name")))


def feed(payloads: DataFrame, provider: str = "rss", words: str | None = None) -> DataFrame:
    """RSS items; with words, those that hold some of them, most first."""
    item = F.col("item")
    items = _items(payloads, "item")
    out = _form(items, provider, id=F.coalesce(_first(item, "guid"), _first(item, "link")), url=F.trim(_first(item, "link")), title=plain(_first(item, "title")), snippet=plain(_first(item, "description")), published_at=F.trim(_first(item, "pubDate")), author=_first(item, "source", "dc:creator"))
    if words is None:
        return out
    asked = F.filter(F.split(F.lower(F.lit(words)), r"\s+"), lambda w: w != "")
    text = F.lower(F.concat_ws(" ", "title", "snippet"))
    scored = out.withColumn("_hits", F.size(F.filter(asked, lambda w: F.contains(text, w)))).where("_hits > 0")
    return scored.orderBy(F.col("_hits").desc(), "url").drop("_hits")


def news_feed(payloads: DataFrame) -> DataFrame:
    """RSS of a news search: redirects are unwrapped and decoded."""
    out = feed(payloads, "googlenews")
    target = F.regexp_extract("url", r"[?&]url=([^&]+)", 1)
    return out.withColumn("url", F.when(target != "", F.try_url_decode(target)).otherwise(F.col("url")))


def pypi(payloads: DataFrame) -> DataFrame:
    """Package cards of a search page."""
    cards = payloads.select(F.explode(F.regexp_extract_all("body", F.lit(r"(?is)<a[^>]*class=[\"'][^\"']*package-snippet[^\"']*[\"'].*?</a>"), F.lit(0))).alias("item"))
    item = F.col("item")
    part = lambda name: plain(F.regexp_extract(item, rf"(?is)package-snippet__{name}[\"'][^>]*>(.*?)</", 1))
    return _form(cards, "pypi", id=part("name"), url=F.concat(F.lit("https://pypi.org"), F.regexp_extract(item, r"href=[\"']([^\"']+)", 1)), title=F.concat_ws(" ", part("name"), part("version")), snippet=part("description"), published_at=F.regexp_extract(item, r"datetime=[\"']([^\"']+)", 1))


def commoncrawl(payloads: DataFrame) -> DataFrame:
    """Lines of index records; each address once, the date from the time stamp."""
    lines = payloads.select(F.explode(F.split("body", "\n")).alias("line")).where("trim(line) <> ''")
    get = lambda k: F.get_json_object("line", f"$.{k}")
    day = F.date_format(F.try_to_timestamp(F.substring(get("timestamp"), 1, 8), F.lit("yyyyMMdd")), "yyyy-MM-dd")
    return _form(lines.where(get("url").isNotNull()), "commoncrawl", id=get("digest"), url=get("url"), title=get("url"), snippet=get("mime"), published_at=day).dropDuplicates(["url"])


def duckduckgo(payloads: DataFrame) -> DataFrame:
    """Related topics, groups within groups of any depth; the title is what stands before a dash."""
    level = payloads.select(F.explode(F.from_json(F.get_json_object("body", "$.RelatedTopics"), "array<string>")).alias("item"))
    leaves = None
    while leaves is None or level.limit(1).count():
        here = level.where(F.get_json_object("item", "$.FirstURL").isNotNull())
        leaves = here if leaves is None else leaves.unionByName(here)
        level = level.select(F.explode(F.from_json(F.get_json_object("item", "$.Topics"), "array<string>")).alias("item"))
    text = F.get_json_object("item", "$.Text")
    return _form(leaves, "duckduckgo", id=F.get_json_object("item", "$.FirstURL"), url=F.get_json_object("item", "$.FirstURL"), title=F.split_part(text, F.lit(" - "), F.lit(1)), snippet=text)


def twitter(tweets: DataFrame, users: DataFrame) -> DataFrame:
    """Tweets (id, author_id, text, created_at) with their users (id, username), who may be missing."""
    named = tweets.join(users.select(F.col("id").alias("author_id"), "username"), "author_id", "left")
    link = F.concat(F.lit("https://twitter.com/"), F.coalesce("username", F.lit("i")), F.lit("/status/"), F.col("id").cast("string"))
    return _form(named, "twitter", id=F.col("id"), url=link, title=F.substring("text", 1, 100), snippet=F.col("text"), published_at=F.col("created_at"), author=F.col("username"))


def pubmed(ids: DataFrame, summaries: DataFrame) -> DataFrame:
    """Ids (uid, position) in order with their summaries (uid, title, source, pubdate, author); ids without one are dropped."""
    both = ids.join(summaries, "uid").orderBy("position")
    return _form(both, "pubmed", id=F.col("uid"), url=F.concat(F.lit("https://pubmed.ncbi.nlm.nih.gov/"), F.col("uid"), F.lit("/")), title=F.col("title"), snippet=F.col("source"), published_at=F.col("pubdate"), author=F.col("author"))


def _embedded(payloads: DataFrame, pattern: str) -> DataFrame:
    return payloads.select(F.regexp_extract("body", pattern, 1).alias("data")).where("data <> ''")


def youtube(payloads: DataFrame) -> DataFrame:
    """Videos in the data that a result page embeds, at any depth; other items are dropped, text runs are joined."""
    parts = _embedded(payloads, r"(?s)ytInitialData\s*=\s*(\{.*?\});\s*</script>").select(F.posexplode(F.split("data", r'"videoRenderer"\s*:\s*')).alias("n", "item")).where("n > 0")
    item = F.col("item")
    text = r'"((?:[^"\\]|\\.)*)"'
    runs = lambda name: F.concat_ws("", F.regexp_extract_all(F.regexp_extract(item, rf'"{name}"\s*:\s*\{{\s*"runs"\s*:\s*\[(.*?)\]', 1), F.lit(rf'"text"\s*:\s*{text}'), F.lit(1)))
    simple = lambda name: F.nullif(F.regexp_extract(item, rf'"{name}"\s*:\s*\{{[^{{}}]*?"simpleText"\s*:\s*{text}', 1), F.lit(""))
    video = F.regexp_extract(item, rf'^\s*\{{\s*"videoId"\s*:\s*{text}', 1)
    found = parts.where(video != "")
    return _form(found, "youtube", id=video, url=F.concat(F.lit("https://www.youtube.com/watch?v="), video), title=F.coalesce(F.nullif(runs("title"), F.lit("")), simple("title")), published_at=simple("publishedTimeText"), author=F.nullif(runs("ownerText"), F.lit("")))


def medium(payloads: DataFrame) -> DataFrame:
    """Posts in the state that a search page embeds, with claps and responses after the text."""
    entries = _embedded(payloads, r"(?s)__APOLLO_STATE__\s*=\s*(\{.*?\})\s*</script>").select(F.explode(F.from_json("data", "map<string,string>")).alias("key", "item")).where(F.startswith("key", F.lit("Post:")))
    get = lambda k: F.get_json_object("item", f"$.{k}")
    counts = F.concat(F.lit(" ("), F.coalesce(get("clapCount"), F.lit("0")), F.lit(" claps, "), F.coalesce(get("postResponses.count"), F.lit("0")), F.lit(" responses)"))
    return _form(entries.where(get("mediumUrl").isNotNull()), "medium", id=get("id"), url=get("mediumUrl"), title=get("title"), snippet=F.concat(F.coalesce(get("extendedPreviewContent.subtitle"), F.lit("")), counts), published_at=get("firstPublishedAt"))
