"""Pages to articles, Markdown, code blocks, links and metadata; crawls over a page table.

Main-content rule: the first article, main or body element, without script, style, nav, header, footer, aside and form.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from querypond import constants as K
from querypond.runtime import cut

DROPPED = {"script", "style", "nav", "header", "footer", "aside", "form", "noscript", "svg", "iframe"}
BLOCK = {"p", "div", "section", "article", "main", "ul", "ol", "table", "blockquote", "tr"}


class _Markdown(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.hidden = self.pre = 0
        self.lists: list[list] = []
        self.href: list[str] = []

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if tag in DROPPED:
            self.hidden += 1
        if self.hidden:
            return
        if re.fullmatch("h[1-6]", tag):
            self.out.append("\n\n" + "#" * int(tag[1]) + " ")
        elif tag == "pre":
            language = re.search(r"(?:language|lang|highlight-source)-([\w+#-]+)", f"{a.get('class') or ''}")
            self.pre += 1
            self.out.append("\n\n```" + (language[1] if language else "") + "\n")
        elif tag == "code" and not self.pre:
            self.out.append("`")
        elif tag == "a":
            self.href.append(a.get("href") or "")
            self.out.append("[")
        elif tag in ("strong", "b"):
            self.out.append("**")
        elif tag in ("em", "i"):
            self.out.append("_")
        elif tag == "br":
            self.out.append("\n")
        elif tag in ("ul", "ol"):
            self.lists.append([tag, 0])
            self.out.append("\n\n")
        elif tag == "li":
            if self.lists:
                self.lists[-1][1] += 1
            mark = f"{self.lists[-1][1]}. " if self.lists and self.lists[-1][0] == "ol" else "- "
            self.out.append("\n" + "  " * max(0, len(self.lists) - 1) + mark)
        elif tag in BLOCK:
            self.out.append("\n\n")

    def handle_endtag(self, tag):
        if tag in DROPPED:
            self.hidden = max(0, self.hidden - 1)
            return
        if self.hidden:
            return
        if tag == "pre":
            self.pre = max(0, self.pre - 1)
            self.out.append("\n```\n\n")
        elif tag == "code" and not self.pre:
            self.out.append("`")
        elif tag == "a" and self.href:
            self.out.append(f"]({self.href.pop()})")
        elif tag in ("strong", "b"):
            self.out.append("**")
        elif tag in ("em", "i"):
            self.out.append("_")
        elif tag in ("ul", "ol"):
            if self.lists:
                self.lists.pop()
            self.out.append("\n\n")
        elif tag in BLOCK or re.fullmatch("h[1-6]", tag):
            self.out.append("\n\n")

    def handle_data(self, data):
        if not self.hidden:
            self.out.append(data if self.pre else re.sub(r"\s+", " ", data))


def main_part(html: str) -> str:
    for tag in ("article", "main", "body"):
        if m := re.search(rf"<{tag}\b[^<>]*>(.*)</{tag}\s*>", html, re.I | re.S):
            return m[1]
    return html


def to_markdown(html: str) -> str:
    parser = _Markdown()
    parser.feed(html)
    parser.close()
    parts = re.split(r"(```.*?```)", "".join(parser.out), flags=re.S)
    clean = [p if p.startswith("```") else re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+\n", "\n", re.sub(r"\n[ \t]+(?![-\d ])", "\n", p))) for p in parts]
    return re.sub(r"\n{3,}", "\n\n", "".join(clean)).strip()


def to_text(markdown: str) -> str:
    return re.sub(r"\s+", " ", re.sub(r"[#*_`]|\[([^\]]*)\]\([^)]*\)", r"\1", markdown)).strip()


def code_language(code: str) -> str:
    """The language with most matching patterns, at least two; the earlier of equals."""
    best, name = 0, "text"
    for language, patterns in K.CODE_LANGUAGES.items():
        hits = sum(bool(re.search(p, code)) for p in patterns)
        if hits > best:
            best, name = hits, language
    return name if best >= 2 else "text"


_OPENS = re.compile(r"(`{3,}|~{3,})([\w+#.-]*)")
_INDENT = re.compile(r" {4}|\t")


def _scan(lines: list[str]) -> tuple[list[tuple[str, list[str]]], list[list[str]]]:
    """Fenced blocks (language, lines) and runs of indented lines that follow a blank line or the start, in one pass over the lines. A fence
    without its end is text."""
    ends: dict[str, list[int]] = {}
    for i, line in enumerate(lines):
        bare = line.rstrip(" \t")
        if bare[:3] in ("```", "~~~") and len(set(bare)) == 1:
            ends.setdefault(bare, []).append(i)
    fenced, runs, run, blank, i = [], [], None, True, 0
    while i < len(lines):
        line = lines[i]
        opening = _OPENS.match(line)
        if opening:
            closers = ends.get(opening[1], [])
            at = bisect_right(closers, i)
            if at < len(closers):
                fenced.append((opening[2].lower(), lines[i + 1 : closers[at]]))
                i, run, blank = closers[at] + 1, None, True
                continue
        indent = _INDENT.match(line)
        if indent and (blank or run is not None):
            if run is None:
                run = []
                runs.append(run)
            run.append(line[indent.end() :])
        else:
            run = None
        blank = not line.strip(" \t")
        i += 1
    return fenced, runs


def _kind(n: int, longest: int, blocks: int, words: int) -> str:
    """Long blocks are production code; short ones are examples on pages of several short blocks and on long pages without a long block."""
    if n >= 80:
        return "production"
    page_of_examples = longest < 30 and blocks >= 2 if words < 2000 else longest < 80
    return "example" if n < 15 and page_of_examples else "unknown"


def code_blocks(markdown: str) -> list[dict]:
    """Fenced blocks, then indented ones whose beginning no block holds yet: language, code, lines and kind."""
    fenced, runs = _scan(markdown.split("\n"))
    found = [(language, "".join(x + "\n" for x in body)) for language, body in fenced]
    for run in runs:
        code = "\n".join(run).strip()
        if code and all(code[:50] not in known for _, known in found):
            found.append(("", code))
    sizes = [code.count("\n") + 1 for _, code in found]
    words = len(markdown.split())
    named = [language if language not in ("", "text") else code_language(code) for language, code in found]
    return [{"language": name, "code": code, "lines": n, "kind": _kind(n, max(sizes), len(found), words)} for name, (_, code), n in zip(named, found, sizes)]


def articles(pages: DataFrame, *, id_col: str, html: str) -> DataFrame:
    """(id, markdown, text_length, content_hash) of HTML pages."""

    def convert(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            made = [to_markdown(main_part(h)) if h else "" for h in pdf["html"]]
            yield pd.DataFrame({"id": pdf["id"], "markdown": made, "text_length": [len(to_text(m)) for m in made]})

    rows = pages.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("id"), F.col(html).alias("html"))
    return rows.mapInPandas(convert, "id bigint, markdown string, text_length int").withColumn("content_hash", F.sha2("markdown", 256))


def blocks(docs: DataFrame, *, id_col: str, markdown: str) -> DataFrame:
    """(id, n, language, code, lines, kind): one row a code block."""

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = [(i, n, b["language"], b["code"], b["lines"], b["kind"]) for i, m in zip(pdf["id"], pdf["markdown"]) for n, b in enumerate(code_blocks(m))]
            yield pd.DataFrame(out, columns=["id", "n", "language", "code", "lines", "kind"])

    rows = docs.where(F.col(id_col).isNotNull() & F.col(markdown).isNotNull()).select(F.col(id_col).cast("bigint").alias("id"), F.col(markdown).alias("markdown"))
    return rows.mapInPandas(find, "id bigint, n int, language string, code string, lines int, kind string")


def markdown_links(markdown: Column) -> Column:
    return F.regexp_extract_all(markdown, F.lit(r"\[[^\]]*\]\((https?://[^)]+)\)"), F.lit(1))


def html_links(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit(r"<a\s[^>]*href=[\"'](https?://[^\"']+)[\"']"), F.lit(1))


def sitemap_pages(sitemaps: DataFrame, *, xml: str = "body", most: int = 30) -> DataFrame:
    """(url): distinct addresses of sitemaps, at most three for each page that a crawl may take."""
    return sitemaps.select(F.explode(sitemap_locations(F.col(xml))).alias("url")).distinct().orderBy("url").limit(most)


def sitemap_locations(xml: Column) -> Column:
    return F.regexp_extract_all(xml, F.lit(r"<loc>\s*([^<\s]+)\s*</loc>"), F.lit(1))


def published_time(html: Column) -> Column:
    meta = F.nullif(F.regexp_extract(html, r"(?i)<meta[^>]+property=[\"']article:published_time[\"'][^>]+content=[\"']([^\"']+)", 1), F.lit(""))
    return F.coalesce(meta, F.nullif(F.regexp_extract(html, r"(?i)<time[^>]+datetime=[\"']([^\"']+)", 1), F.lit("")))


def wrapped(text: Column, mime: Column) -> Column:
    """Plain text as it is, JSON (by its type or its first bracket) in a fence."""
    return F.when(F.contains(mime, F.lit("json")) | F.ltrim(text).rlike(r"^[\[{]"), F.concat(F.lit("```json\n"), text, F.lit("\n```"))).otherwise(text)


HTML_TYPES = ("text/html", "application/xhtml+xml", "", "application/octet-stream")


def documents(resources: DataFrame, *, id_col: str, body: str, content_type: str, pdf_text=None) -> DataFrame:
    """(id, kind, markdown, text_length, content_hash, published_at) of fetched resources by their type: HTML as its article, PDF by a plugged-in
    function (null without one), all other text as it is."""
    mime = F.lower(F.trim(F.split_part(F.coalesce(content_type, F.lit("")), F.lit(";"), F.lit(1))))
    rows = resources.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("id"), F.col(body).cast("string").alias("body"), mime.alias("mime"))
    pages = articles(rows.where(F.col("mime").isin(*HTML_TYPES)), id_col="id", html="body")
    dated = rows.where(F.col("mime").isin(*HTML_TYPES)).select("id", published_time(F.col("body")).alias("published_at"))
    html = pages.join(dated, "id").select("id", F.lit("html").alias("kind"), "markdown", "text_length", "content_hash", "published_at")
    none = F.lit(None).cast("string")
    as_text = pdf_text(F.col("body")) if pdf_text else none
    pdf = rows.where("mime = 'application/pdf'").select("id", F.lit("pdf").alias("kind"), as_text.alias("markdown"))
    other = rows.where(~F.col("mime").isin(*HTML_TYPES, "application/pdf")).select("id", F.lit("text").alias("kind"), wrapped(F.col("body"), F.col("mime")).alias("markdown"))
    rest = pdf.unionByName(other).select("id", "kind", "markdown", F.length("markdown").alias("text_length"), F.sha2("markdown", 256).alias("content_hash"), none.alias("published_at"))
    return html.unionByName(rest)


def is_private_address(ip: Column) -> Column:
    """Private, loopback, link-local and other addresses that no fetch may reach (IPv4; IPv6 by prefix)."""
    a, b = F.split_part(ip, F.lit("."), F.lit(1)).try_cast("int"), F.split_part(ip, F.lit("."), F.lit(2)).try_cast("int")
    v4 = a.isin(0, 10, 127) | (a >= 224) | ((a == 169) & (b == 254)) | ((a == 172) & b.between(16, 31)) | ((a == 192) & (b == 168)) | ((a == 100) & b.between(64, 127))
    return F.when(F.contains(ip, F.lit(":")), F.lower(ip).rlike("^(::1?$|f[cd]|fe[89ab]|ff|::ffff:(10|127|192[.]168|169[.]254)[.])")).otherwise(F.coalesce(v4, F.lit(True)))


def crawl(seeds: DataFrame, links: DataFrame, *, depth: int = 3, same_host: bool = True, exclude: tuple[str, ...] = (), max_pages: int | None = None) -> DataFrame:
    """(url, depth) reached from seeds (url) over links (source, target), breadth first, each address once.

    With max_pages levels are followed until so many addresses are reached; of the last level the first by address are kept.
    A level is a join of the frontier with the links and an anti-join with what was visited; both stay distributed, and the
    lineage is cut at each level.
    """
    host = lambda c: F.regexp_extract(F.lower(c), "^https?://([^/?#]+)", 1)
    edges = links.where(F.col("target").rlike("^https?://"))
    if same_host:
        edges = edges.where(host(F.col("source")) == host(F.col("target")))
    for ext in K.SKIPPED_EXTENSIONS:
        edges = edges.where(~F.endswith(F.lower(F.regexp_replace("target", "[?#].*$", "")), F.lit(ext)))
    for word in exclude:
        edges = edges.where(~F.contains(F.lower("target"), F.lit(word.lower())))
    clean = lambda c: F.lower(F.regexp_replace(F.regexp_replace(c, "[?#].*$", ""), "/+$", ""))
    edges = edges.select(clean(F.col("source")).alias("source"), clean(F.col("target")).alias("target")).distinct()
    visited = cut(seeds.select(clean(F.col("url")).alias("url"), F.lit(0).alias("depth")).distinct())
    frontier = visited
    for level in range(1, depth + 1):
        reached = frontier.join(edges, frontier.url == edges.source).select(F.col("target").alias("url")).distinct().join(visited, "url", "left_anti")
        frontier = cut(reached.select("url", F.lit(level).alias("depth")))
        if not frontier.limit(1).count():
            break
        visited = visited.unionByName(frontier)
        if max_pages is not None and visited.limit(max_pages).count() == max_pages:
            break
    return visited if max_pages is None else visited.orderBy("depth", "url").limit(max_pages)
