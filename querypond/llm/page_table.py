"""Pages taken apart once: one row a line with what its page tells about it, for the operators on page bodies and on residue.

Of repeated ids the latest row counts, then the larger text; only the ids that repeat are gathered. A page has a row with the
number 0, too, whose bits say what holds for the page as a whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from querypond.llm.page_lines import RELATED, Line, find_wording, html_lines, is_furniture, is_navigation, markdown_lines, masked, site_name
from querypond.llm.trusted import has_placeholder, is_error_heading, is_filler, is_stray, is_trace, says_residue
from querypond.runtime import cut

#: Ids up to which a side is broadcast; above, the join is shuffled.
BROADCAST_ROWS = 200_000
#: Parameters and settings: they recur as furniture does, but belong to the text.
ASSIGNMENT = re.compile(r"\w\s*(?::=|=|→|->)\s*\S")
#: Bits of a line: the first are features of the classifier of page bodies; what follows ``related`` is about residue.
BITS = ("short", "sentence", "wording", "mention", "navigation", "inside", "outside", "h1", "h", "li", "code", "side", "below", "before", "last", "bars", "number", "setting", "related", "body", "trusted", "filler", "placeholder", "rich", "bare")
BIT = {name: 1 << i for i, name in enumerate(BITS)}
#: Words of a trusted line below an error heading, and words that a line needs before a small edit leaves it similar.
HEADED_WORDS, EDITED_WORDS = 20, 8

SCHEMA = "html boolean, id bigint, site bigint, line_no int, mask bigint, first boolean, block int, depth int, bits int, words int, linked float, place float, text string"


def common_form(pages: DataFrame, *, id_col: str, title: str | None, text: str, host: str, at: str | None, html: bool) -> DataFrame:
    """(html, id, host, title, text) of a table of pages, one row an id."""
    none = F.lit(None).cast("string")
    rows = pages.where(F.col(id_col).isNotNull()).select(F.lit(html).alias("html"), F.col(id_col).cast("bigint").alias("id"), F.coalesce(host, F.lit("")).alias("host"), (F.col(title) if title else none).alias("title"), F.col(text).alias("text"), (F.col(at).cast("timestamp") if at else F.lit(None).cast("timestamp")).alias("at"))
    repeated = rows.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id")
    if repeated.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        repeated = F.broadcast(repeated)
    latest = F.struct(F.col("at").isNotNull(), "at", F.coalesce("text", F.lit("")), F.coalesce("title", F.lit("")))
    several = rows.join(repeated, "id", "left_semi").groupBy("html", "id").agg(F.max_by(F.struct("host", "title", "text"), latest).alias("p"))
    return rows.join(repeated, "id", "left_anti").select("html", "id", "host", "title", "text").unionByName(several.select("html", "id", "p.host", "p.title", "p.text"))


def line_features(lines: list[Line]) -> list[tuple[int, int, float, float]]:
    """(bits, words, share of linked words, place) of each line, as its page alone tells them."""
    n, out = len(lines), []
    first_h1 = next((i for i, line in enumerate(lines) if line.role == "h1"), -1)
    below = False  # under a heading of related items
    for i, line in enumerate(lines):
        text, words = line.text, len(line.words)
        related = bool(RELATED.match(text))
        if line.role in ("h1", "h"):
            below = related and words <= 8
        elif line.role != "li":
            below = False
        bits = BIT.get(line.role, 0)
        if words <= 3:
            bits |= BIT["short"]
        if words >= 10 and text.rstrip("\"”»’)]")[-1:] in ".!?:;":
            bits |= BIT["sentence"]
        if line.wording >= 0:
            bits |= BIT["wording"] if words <= 16 else BIT["mention"]
        if is_navigation(line):
            bits |= BIT["navigation"]
        if line.inside:
            bits |= BIT["inside"]
        if line.outside:
            bits |= BIT["outside"]
        if line.side:
            bits |= BIT["side"]
        if below:
            bits |= BIT["below"]
        if i < first_h1:
            bits |= BIT["before"]
        if i >= n - 3:
            bits |= BIT["last"]
        if "|" in text or "·" in text:
            bits |= BIT["bars"]
        if words == 2 and line.words[0].isdigit():
            bits |= BIT["number"]
        if ("=" in text or "→" in text or "->" in text) and ASSIGNMENT.search(text):
            bits |= BIT["setting"]
        if related:
            bits |= BIT["related"]
        out.append((bits, min(words, 40), line.linked / max(1, words), i / max(1, n - 1)))
    return out


def residue_bits(title: str, text: str, lines: list[Line]) -> tuple[int, list[int]]:
    """Bits of the page and of its lines: what could stand in place of content, and which of it is trusted residue."""
    page, marks = 0, [0] * len(lines)
    if has_placeholder(title) or has_placeholder(text):
        return BIT["placeholder"], marks
    body, headed = [], is_error_heading(title)
    for i, line in enumerate(lines):
        if line.role in ("h1", "h"):
            headed = headed or is_error_heading(line.text)
        elif is_trace(line) or is_furniture(line) or is_stray(line):
            continue
        else:
            body.append(i)
            if line.role == "code" or line.outside:
                page |= BIT["rich"]
    headed = headed and not page
    if headed and not body:
        return page | BIT["bare"], marks
    short = headed and all(len(lines[i].words) <= HEADED_WORDS for i in body)
    for i in body:
        marks[i] = BIT["body"]
        if is_filler(lines[i]):
            marks[i] |= BIT["trusted"] | BIT["filler"]
        elif short or says_residue(lines[i]):
            marks[i] |= BIT["trusted"]
    return page, marks


def parsed(pages: DataFrame) -> DataFrame:
    """The lines (see SCHEMA) of pages in the common form. text: masked, where a near-duplicate may have to be found; else null."""

    def lines_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        made = names[3:]
        for batch in batches:
            columns: dict[str, list] = {c: [] for c in made}
            sizes, sites = [], []
            for html, host, title, text in zip(*(batch.column(c).to_pylist() for c in ("html", "host", "title", "text"))):
                lines = html_lines(text or "") if html else markdown_lines(text or "")
                find_wording(lines)
                page, marks = residue_bits(title or "", text or "", lines) if not html else (0, [0] * len(lines))
                seen, site = set(), site_name(host)
                rows = [(0, 0, False, 0, 0, page, 0, 0.0, 0.0, None)]
                for line, mark, (bits, words, linked, place) in zip(lines, marks, line_features(lines)):
                    low = masked(line.text, site)
                    m = int.from_bytes(blake2b(low.encode(), digest_size=8).digest(), "little", signed=True)
                    kept = low if mark & BIT["body"] and not mark & BIT["filler"] and len(line.words) >= EDITED_WORDS and not page & BIT["rich"] else None
                    rows.append((line.number, m, m not in seen, line.block, line.depth, bits | mark, words, linked, place, kept))
                    seen.add(m)
                for name, values in zip(made, zip(*rows)):
                    columns[name].extend(values)
                sizes.append(len(rows))
                sites.append(int.from_bytes(blake2b(host.encode(), digest_size=8).digest(), "little", signed=True))
            if sizes:
                take = pa.array(np.repeat(np.arange(len(sizes)), sizes))
                own = [batch.column("html").take(take), batch.column("id").take(take), pa.array(sites, pa.int64()).take(take)]
                types = (pa.int32(), pa.int64(), pa.bool_(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.float32(), pa.float32(), pa.string())
                yield pa.RecordBatch.from_arrays(own + [pa.array(columns[c], t) for c, t in zip(made, types)], names=names)

    return cut(pages.mapInArrow(lines_of, SCHEMA))


def has(*names: str):
    """Whether a line has any of the bits."""
    return F.col("bits").bitwiseAND(reduce(int.__or__, (BIT[n] for n in names))) != 0
