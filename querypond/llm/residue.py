"""Template residue and error pages: partitioned SimHash tables and label propagation.

Per page. Code is set aside for the search of unfilled placeholders, in title and text: such a page is a case. Of the rest, the lines
without furniture, headings, frames of stack traces and references are its body. Lines of the body are trusted residue where they are
filler by vocabulary, hold one of a few wordings (``trusted``), or stand, all of them short, below an error heading. A page with code or
references to other sites is trusted content.

Spreading. Lines are normalised (case, tokens with digits, the site's name) and equal ones form a class, over all pages. A class
with more trusted lines than lines on trusted content is residue. Its near-duplicates are found with SimHashes over shingles of
five words, with as many independent ones as two lines right at the similarity need to share a band with a probability of 0.999
(``tables_for``). Each band is a table that is partitioned by (band, value). Candidates are verified by the Hamming distance of
their first 64 bits, within a bound that pairs at the similarity keep (``hamming_for``), then by the Jaccard similarity of their
shingles (0.8 or more). Links join classes into connected components, which take one label by the same count. A page is residue if all
of its body is, but for ``SPARE_WORDS`` words, or four fifths of its words where none of it stands on trusted content; pages and lines of
any length take part.

Scale. Only components with residue matter, so links are followed from the residue outwards, a checkpoint a round, until nothing new is
reached; filler, which its vocabulary tells everywhere, isn't followed, and lines take part only if their words allow the similarity
(``worded_like``). What was reached is broadcast only after it was counted; else the join
on (band, value) streams its matches and is split by AQE where a value is hot. Texts stay where they were read: only hashes of lines are
grouped, in parts, so a message on a third of all pages is one class. Bands get wider with the number of residue classes, so that chance
meetings stay few.

Defined results: null titles and texts are empty; pages without body are no cases, unless they stand below an error heading; rows with a
null id are dropped; of rows with one id the latest counts; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from querypond.llm.chosen_path import mix
from querypond.llm.page_table import common_form, has, parsed
from querypond.runtime import cut

SHINGLE, SIMILARITY, RECALL = 5, 0.8, 0.999
#: Words of a residue page that nothing need be known about: a link back, the name of a product.
SPARE_WORDS = 4
#: Rows of tables up to which they are broadcast; above, the join is shuffled.
BROADCAST_ROWS = 200_000
#: Slots of the hashed vocabulary of what was reached.
SLOTS = 1 << 20


def shingles(text: str, size: int = SHINGLE) -> list[str]:
    words = re.findall(r"\w+|∅", text)
    return sorted({" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))}) if words else []


def flips(similarity: float) -> float:
    """Probability that a bit differs at a similarity: the angle between sets of one size, and a quarter more for the small ones,
    whose sums are often zero."""
    return min(0.5, 1.25 * math.acos(2 * similarity / (1 + similarity)) / math.pi)


def hamming_for(similarity: float) -> int:
    """Differing bits of 64 that pairs at the similarity exceed with a probability below 0.001."""
    p = flips(similarity)
    return math.ceil(64 * p + 3.3 * math.sqrt(64 * p * (1 - p)))


def tables_for(similarity: float, width: int, recall: float) -> int:
    """Bands of so many bits of which a pair at the similarity shares one with the wanted probability."""
    return math.ceil(math.log(1 - recall) / math.log(1 - (1 - flips(similarity)) ** width))


def simhashes(bodies: list[str], words: int) -> np.ndarray:
    """(bodies, 64 * words) bits of independent SimHashes."""
    sets = [[int.from_bytes(blake2b(p.encode(), digest_size=8).digest(), "little") for p in shingles(b)] or [0] for b in bodies]
    lengths = np.array([len(x) for x in sets])
    start = np.cumsum(lengths) - lengths
    base = np.array([h for x in sets for h in x], dtype=np.uint64)
    out = []
    for k in range(words):
        bits = np.unpackbits(mix(base + np.uint64((k + 1) * 0x9E3779B97F4A7C15 % (1 << 64))).view(np.uint8).reshape(-1, 8), axis=1)
        out.append(2 * np.add.reduceat(bits, start, axis=0, dtype=np.int32) > lengths[:, None])
    return np.concatenate(out, axis=1)


def near_links(classes: DataFrame, others: DataFrame | None = None, *, hamming: int | None = None, similarity: float = SIMILARITY, recall: float = RECALL) -> DataFrame:
    """(a, b) of classes (class, body) whose bodies are near-duplicates, a < b; with others, from classes to others (in which a class may
    have several rows)."""
    hamming = hamming_for(similarity) if hamming is None else hamming
    second = classes if others is None else others
    # Some chance meetings for each row of the second side, whatever the number of classes of the first.
    width = min(24, max(8, math.ceil(math.log2(max(2, classes.count()))) - 3))
    bands = tables_for(similarity, width, recall)

    def prints(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        powers = 1 << np.arange(width)
        for pdf in batches:
            for first in range(0, len(pdf), 500):
                part = pdf.iloc[first : first + 500]
                bits = simhashes(part["body"].tolist(), -(-bands * width // 64))
                yield pd.DataFrame({"class": part["class"], "print": np.packbits(bits[:, :64], axis=1).view(np.int64).ravel(), "bands": list((bits[:, : bands * width].reshape(-1, bands, width) @ powers).astype(np.int32))})

    def tables(df: DataFrame, s: str) -> DataFrame:
        printed = df.select("class", "body").mapInPandas(prints, "class bigint, print bigint, bands array<int>")
        return printed.select(F.col("class").alias(s), F.col("print").alias(f"print_{s}"), F.posexplode("bands").alias("band", "value"))

    small = classes.limit(BROADCAST_ROWS // bands + 1).count() * bands <= BROADCAST_ROWS
    left = F.broadcast(tables(classes, "a")) if small else tables(classes, "a")
    order = F.col("a") < F.col("b") if others is None else F.col("a") != F.col("b")
    near = order & (F.bit_count(F.col("print_a").bitwiseXOR(F.col("print_b"))) <= hamming)
    candidates = tables(second, "b").join(left, ["band", "value"]).where(near).select("a", "b").distinct()
    candidates = candidates if others is None else cut(candidates)
    found = second if others is None else second.join(candidates.select(F.col("b").alias("class")), "class", "left_semi").groupBy("class").agg(F.first("body").alias("body"))
    a, b = (df.select(F.col("class").alias(s), F.col("body").alias(f"body_{s}")) for s, df in (("a", classes), ("b", found)))

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for x, y, p, q in zip(pdf["a"], pdf["b"], pdf["body_a"], pdf["body_b"]):
                s, t = set(shingles(p)), set(shingles(q))
                if len(s & t) >= similarity * len(s | t):
                    out.append((x, y))
            yield pd.DataFrame(out, columns=["a", "b"])

    return candidates.join(a, "a").join(b, "b").mapInPandas(verify, "a bigint, b bigint")


def _slots(body: str) -> list[int]:
    return [zlib.crc32(w.encode()) & (SLOTS - 1) for w in re.findall(r"\w+|∅", body)]


def worded_like(texts: DataFrame, classes: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """Rows (class, body) that may be similar to one of the classes (class, body): shingles that two texts share cover at least that
    share of the words of each, so as many of a text's words are in the vocabulary of the classes. The vocabulary is a bit a slot,
    whatever the number of classes; words that share a slot only let more texts pass."""

    def used(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"slot": sorted({x for b in pdf["body"] for x in _slots(b)})}, dtype="int32")

    known = np.zeros(SLOTS, dtype=bool)
    known[[r["slot"] for r in classes.select("body").mapInPandas(used, "slot int").distinct().collect()]] = True
    shared = texts.sparkSession.sparkContext.broadcast(np.packbits(known).tobytes())

    def like(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bits = shared.value
        for pdf in batches:
            keep = []
            for b in pdf["body"]:
                slots = _slots(b)
                keep.append(sum(bits[x >> 3] >> (7 - (x & 7)) & 1 for x in slots) >= similarity * len(slots))
            yield pdf[np.array(keep, dtype=bool)]

    return texts.mapInPandas(like, "class bigint, body string")


def components(links: DataFrame) -> DataFrame:
    """(node, component) by smallest labels with pointer jumping; ends when no label changes."""
    edges = cut(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    if not edges.limit(1).count():
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    labels = cut(edges.groupBy(F.col("a").alias("node")).agg(F.min(F.least("a", "b")).alias("component")))
    while True:
        around = edges.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("best"))
        step = labels.join(around, "node").select("node", "component", F.least("component", "best").alias("new"))
        jump = step.select(F.col("node").alias("new"), F.col("new").alias("root"))
        after = cut(step.join(jump, "new", "left").select("node", F.col("component").alias("old"), F.least("new", F.coalesce("root", "new")).alias("component")))
        labels = after.select("node", "component")
        if not after.where("old <> component").limit(1).count():
            return labels


def residue_links(texts: DataFrame, classes: DataFrame) -> DataFrame | None:
    """All links (a, b) of the components that hold residue; None if there are none. texts (class, body): lines, repeated ones too;
    classes (class): where to begin."""
    reached, links = classes, None
    newest = texts.join(classes, "class", "left_semi").groupBy("class").agg(F.first("body").alias("body"))
    while True:
        newest = cut(newest)
        if not newest.limit(1).count():
            return links
        found = cut(near_links(newest, cut(worded_like(texts, newest))))
        links = found if links is None else links.unionByName(found)
        fresh = found.select(F.col("b").alias("class")).distinct().join(reached, "class", "left_anti")
        reached = reached.unionByName(fresh)
        newest = texts.join(fresh, "class", "left_semi").groupBy("class").agg(F.first("body").alias("body"))


def residue_pages(lines: DataFrame) -> DataFrame:
    """(id, reason) of the pages that are residue, from their lines (page_table.parsed); reason: placeholder, residue (all trusted) or
    near-duplicate (some of it by equal or similar lines)."""
    pages = lines.where("line_no = 0").select("id", has("placeholder").alias("placeholder"), has("rich").alias("rich"), has("bare").alias("bare"))
    at_once = pages.where("placeholder OR bare").select("id", F.when(F.col("placeholder"), "placeholder").otherwise("residue").alias("reason"))
    body = lines.where((F.col("line_no") > 0) & has("body")).select("id", F.col("mask").alias("class"), "words", has("trusted").alias("trusted"), has("filler").alias("filler"), "text")
    rich = pages.where("rich").select("id", F.lit(True).alias("rich"))
    # Lines on trusted content count against a class.
    on_rich = F.col("rich").isNotNull()
    counted = body.join(rich, "id", "left").groupBy("class").agg(F.count_if(F.col("trusted") & ~on_rich).alias("r"), F.count_if(on_rich).alias("c"), F.max("filler").alias("filler"))
    known = cut(counted.where("r > 0"))
    texts = body.where("text IS NOT NULL").select("class", F.col("text").alias("body"))
    links = residue_links(texts, known.where("r > c AND NOT filler").select("class"))
    labels = known.select("class", (F.col("r") > F.col("c")).alias("residue"), F.col("c"))
    if links is not None and links.limit(1).count():
        member = components(links)
        votes = member.join(counted, F.col("node") == F.col("class")).groupBy("component").agg(F.sum("r").alias("r"), F.sum("c").alias("c"))
        voted = member.join(votes, "component").select(F.col("node").alias("class"), (F.col("r") > F.col("c")).alias("residue"), "c")
        labels = labels.join(voted.select("class"), "class", "left_anti").unionByName(voted)
    # Only pages of which a line is residue are looked at further.
    told = body.select("id", "class", "words", "trusted").join(cut(labels), "class", "left").withColumn("residue", F.col("trusted") | F.coalesce("residue", F.lit(False)))
    total, other = F.sum("words"), F.sum(F.when(F.col("residue"), 0).otherwise(F.col("words")))
    per = told.groupBy("id").agg(F.count_if("residue").alias("n"), total.alias("total"), other.alias("other"), F.count_if(F.col("c") > 0).alias("near_content"), F.min("trusted").alias("sure"))
    per = per.where(f"n > 0 AND (other <= {SPARE_WORDS} OR near_content = 0 AND other <= {1 - SIMILARITY:.2f} * total)")
    more = per.join(rich, "id", "left_anti").join(at_once, "id", "left_anti").select("id", F.when(F.col("sure"), "residue").otherwise("near-duplicate").alias("reason"))
    return at_once.unionByName(more)


def find_residue(pages: DataFrame, *, id_col: str = "extraction_id", title: str = "title", text: str = "markdown", host: str = "host", newest: str | None = "extracted_at") -> DataFrame:
    """(id, reason) of the pages that are residue."""
    return residue_pages(parsed(common_form(pages, id_col=id_col, title=title, text=text, host=host, at=newest, html=False)))
