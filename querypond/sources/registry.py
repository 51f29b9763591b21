"""The sources, their common result schema, and readers of their payloads.

Live calls need a network; payloads are tables here. Each reader turns a source's records into (id, url, title, snippet,
provider, published_at, author), as its connector would.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from querypond import constants as K

RESULT = T.StructType([T.StructField(c, T.StringType()) for c in ("id", "url", "title", "snippet", "provider", "published_at", "author")])


def providers(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(p, n, cap, c, i) for i, (p, n, cap, c) in enumerate(K.SOURCES)], "provider string, priority int, cap int, category string, position int")


def plain(text: Column) -> Column:
    """Text without tags, with single blanks."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, "<[^>]*>", " "), r"\s+", " "))


def bare(text: Column) -> Column:
    """Text without tags, as they stand."""
    return F.regexp_replace(text, "<[^>]+>", "")


def epoch_iso(seconds: Column) -> Column:
    return F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def _form(df: DataFrame, provider: str, **columns: Column) -> DataFrame:
    none = F.lit(None).cast("string")
    return df.select(*[(columns.get(f.name, none) if f.name != "provider" else F.lit(provider)).cast("string").alias(f.name) for f in RESULT])


def hackernews(hits: DataFrame) -> DataFrame:
    item = F.concat(F.lit("https://news.ycombinator.com/item?id="), F.col("object_id").cast("string"))
    return _form(hits, "hackernews", id=F.col("object_id"), url=F.coalesce("url", item), title=F.coalesce("title", "story_title", F.lit("")), snippet=plain(F.coalesce("comment_text", "story_title", "title")), published_at=F.col("created_at"), author=F.col("author"))


def googlenews(articles: DataFrame) -> DataFrame:
    return _form(articles, "googlenews", id=F.col("article_id"), url=F.col("link_url"), title=F.col("title"), snippet=plain(F.coalesce("description", "content_text")), published_at=F.col("pub_date"), author=F.coalesce(F.try_element_at("creator", F.lit(1)), F.col("source_id")))


def gdelt(articles: DataFrame) -> DataFrame:
    return _form(articles, "gdelt", id=F.substring(F.base64(F.encode("url", "utf-8")), 1, 32), url=F.col("url"), title=F.col("title"), snippet=F.col("title"), published_at=F.col("seendate"), author=F.col("domain_name"))


def stackexchange(items: DataFrame) -> DataFrame:
    return _form(items, "stackexchange", id=F.col("question_id"), url=F.col("link_url"), title=F.col("title"), snippet=F.substring(bare(F.col("body_html")), 1, 300), published_at=epoch_iso(F.when(F.col("creation_date").between(0, 10**11), F.col("creation_date"))), author=F.col("owner_name"))


Field = str | Callable[[Callable[[str], Column]], Column]


def from_json(payloads: DataFrame, provider: str, *, path: str, fields: dict[str, Field]) -> DataFrame:
    """Results of a JSON payload (column body): the array at ``path`` ('$.a|$.b': the first that is there), fields by path within an item
    ('a.b', or 'a|b' for the first that is there), or made from such."""
    array = F.coalesce(*[F.get_json_object("body", p) for p in path.split("|")])
    items = payloads.select(F.explode(F.from_json(array, "array<string>")).alias("item"))
    get = lambda p: F.get_json_object("item", f"$.{p}")
    pick = lambda f: f(get) if callable(f) else F.coalesce(*[get(x) for x in f.split("|")])
    return _form(items, provider, **{k: pick(f) for k, f in fields.items()})


def _after(prefix: str, path: str) -> Field:
    return lambda get: F.concat(F.lit(prefix), get(path))


def _dashed(prefix: str, path: str) -> Field:
    return lambda get: F.concat(F.lit(prefix), F.replace(get(path), F.lit("/"), F.lit("-")))


def _either(first: Column, otherwise: Column) -> Column:
    """The first where it is there and not empty."""
    return F.coalesce(F.nullif(first, F.lit("")), otherwise)


def _full_name(get) -> Column:
    return F.nullif(F.concat_ws(" ", F.nullif(get("author[0].given"), F.lit("")), F.nullif(get("author[0].family"), F.lit(""))), F.lit(""))


def _mdn_page(get) -> Column:
    return F.when(F.startswith(get("mdn_url"), F.lit("http")), get("mdn_url")).otherwise(F.concat(F.lit("https://developer.mozilla.org"), get("mdn_url")))


def _reddit_stats(get) -> Column:
    place = F.coalesce(F.concat(F.lit("r/"), F.nullif(get("data.subreddit"), F.lit(""))), F.lit(""))
    counts = F.concat(F.lit("[👍"), F.coalesce(get("data.score"), F.lit("?")), F.lit(" 💬"), F.coalesce(get("data.num_comments"), F.lit("?")), F.lit("]"))
    text = F.nullif(get("data.selftext"), F.lit(""))
    return F.concat(F.lit("["), place, F.lit("] "), counts, F.coalesce(F.concat(F.lit(" "), F.substring(text, 1, 280)), F.lit("")))


#: Where each JSON source keeps its results, and the fields of one.
JSON_SOURCES: dict[str, tuple[str, dict[str, Field]]] = {
    "brave": ("$.web.results", {"id": _after("brave-", "url"), "url": "url", "title": "title", "snippet": "description", "published_at": "age"}),
    "devto": ("$", {"id": _after("devto-", "id"), "url": "url", "title": "title", "snippet": "description", "published_at": "published_at", "author": "user.name"}),
    "npm": ("$.objects", {"id": lambda get: F.concat(F.lit("npm-"), get("package.name"), F.lit("@"), get("package.version")), "url": "package.links.npm", "title": "package.name", "snippet": "package.description", "published_at": "package.date", "author": "package.publisher.username"}),
    "github": ("$.items", {"id": _after("github-repo-", "id"), "url": "html_url", "title": "full_name", "snippet": "description", "published_at": "pushed_at", "author": "owner.login"}),
    "crossref": ("$.message.items", {"id": _dashed("crossref-", "DOI"), "url": lambda get: F.coalesce(get("URL"), F.concat(F.lit("https://doi.org/"), get("DOI"))), "title": "title[0]|DOI", "snippet": lambda get: F.substring(bare(F.nullif(get("abstract"), F.lit(""))), 1, 400), "published_at": "created.date-time", "author": _full_name}),
    "semanticscholar": ("$.data", {"id": _after("s2-", "paperId"), "url": "url", "title": "title", "snippet": lambda get: F.coalesce(F.substring(get("abstract"), 1, 300), get("venue")), "published_at": "publicationDate", "author": "authors[0].name"}),
    "wikipedia": ("$.query.search", {"id": _after("wikipedia-", "pageid"), "url": _after("https://en.wikipedia.org/?curid=", "pageid"), "title": "title", "snippet": lambda get: bare(get("snippet")), "published_at": "timestamp"}),
    "mdn": ("$.documents|$.hits", {"id": lambda get: F.concat(F.lit("mdn-"), F.replace(F.regexp_replace(get("mdn_url"), "^/en-US/docs/", ""), F.lit("/"), F.lit("-"))), "url": _mdn_page, "title": "title", "snippet": "summary"}),
    "osv": ("$.vulns|$.results", {"id": _after("osv-", "id"), "url": _after("https://osv.dev/vulnerability/", "id"), "title": "id", "snippet": lambda get: _either(get("summary"), _either(get("aliases[0]"), F.lit("No description"))), "published_at": "published"}),
    "cve": ("$", {"id": _after("cve-", "id"), "url": _after("https://nvd.nist.gov/vuln/detail/", "id"), "title": "id", "snippet": "summary", "published_at": "published_at"}),
    "internetarchive": ("$.response.docs", {"id": _after("ia-", "identifier"), "url": _after("https://archive.org/details/", "identifier"), "title": lambda get: _either(get("title"), get("identifier")), "snippet": lambda get: F.coalesce(get("description"), F.concat(F.lit("Internet Archive — "), get("mediatype"))), "published_at": "date"}),
    "wikidata": ("$.results.bindings", {"id": lambda get: F.concat(F.lit("wikidata-"), F.regexp_extract(get("item.value"), "([^/]*)$", 1)), "url": "item.value", "title": "itemLabel.value", "snippet": "itemDescription.value"}),
    "reddit": ("$.data.children", {"id": _after("reddit-", "data.id"), "url": lambda get: F.when(F.startswith(get("data.url"), F.lit("http")), get("data.url")).otherwise(F.concat(F.lit("https://www.reddit.com"), get("data.permalink"))), "title": "data.title", "snippet": _reddit_stats, "published_at": lambda get: epoch_iso(get("data.created_utc").try_cast("double").cast("bigint")), "author": _after("u/", "data.author")}),
    "pubmed": ("$.result.items", {"id": _after("pubmed-", "uid"), "url": lambda get: F.concat(F.lit("https://pubmed.ncbi.nlm.nih.gov/"), get("uid"), F.lit("/")), "title": "title", "snippet": "source", "published_at": "pubdate", "author": "authors[0].name"}),
}


def known_repositories(queries: DataFrame, query: str = "query", *, most: int = 3) -> DataFrame:
    """(query_id, position, result schema): the repositories of well-known projects that a query names, the first few in the table's order."""
    names = F.array(*[F.struct(F.lit(i).alias("position"), F.lit(n).alias("name"), F.lit(r).alias("repository")) for i, (n, r) in enumerate(K.KNOWN_REPOSITORIES.items())])
    named = F.slice(F.filter(names, lambda x: F.contains(F.lower(query), x["name"])), 1, most)
    rows = queries.select("query_id", F.explode(named).alias("x")).select("query_id", F.col("x.position").alias("position"), F.col("x.repository").alias("repository"))
    repo = F.col("repository")
    form = {"id": F.concat(F.lit("github-repo-"), F.replace(repo, F.lit("/"), F.lit("-"))), "url": F.concat(F.lit("https://github.com/"), repo), "title": repo, "snippet": F.concat(repo, F.lit(" — GitHub repository")), "provider": F.lit("github"), "published_at": F.lit(None), "author": F.split_part(repo, F.lit("/"), F.lit(1))}
    return rows.select("query_id", "position", *[form[f.name].cast("string").alias(f.name) for f in RESULT])


def with_known_repositories(queries: DataFrame, found: DataFrame) -> DataFrame:
    """Search results (query_id, position, result schema) behind the known repositories of their query, without these again."""
    known = known_repositories(queries)
    rest = found.join(known.select("query_id", "url"), ["query_id", "url"], "left_anti")
    return known.unionByName(rest.withColumn("position", F.col("position") + len(K.KNOWN_REPOSITORIES)))


def federate(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumn("input_pos", F.monotonically_increasing_id())
