"""Evaluation texts inside corpus documents: Wu-Manber multi-pattern search.

A *token* is a maximal run of a-z and 0-9 of the lower-cased text. An item leaks into a document when both share a run of at
least ``run`` tokens; an item with fewer tokens leaks when all its tokens occur as one run. Every window of ``run`` tokens of
every item is a test string, so a shared run of any greater length contains one of them.

Search: texts are brought to `` token token ... `` form by the JVM, then scanned once per table. A table holds test strings
of similar length. Its shift entry for a block of B characters is the distance by which a window may move when it ends in
that block; a block in no test string allows the full move. Where the shift is zero, the block's bucket names the test
strings that end their first m characters with it, and direct comparison decides.

Defined results: null or empty texts and items match nothing; repeated documents or items count once; ids are kept in their
own type and null ids are dropped; other columns of either input are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

RUN = 13
#: Test strings of one pass. More items than fit are searched in further passes over the same texts, never dropped.
ITEMS_PER_PASS = 20_000


def token_line(text: Column) -> Column:
    """`` a b c `` : the tokens with one space around each; null stays null."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " ")), F.lit(" "))


def test_strings(line: str, run: int) -> list[str]:
    tokens = line.split()
    if not tokens:
        return []
    return [" " + " ".join(tokens[i : i + run]) + " " for i in range(max(1, len(tokens) - run + 1))]


class ShiftTable:
    """Wu-Manber tables over test strings with at least ``m`` characters."""

    def __init__(self, strings: dict[str, list[int]], block: int = 8):
        self.m = m = min(map(len, strings))
        self.block = b = min(block, m)
        self.far = m - b + 1
        self.shift: dict[str, int] = {}
        self.bucket: dict[str, list[tuple[str, list[int]]]] = {}
        for s, items in strings.items():
            for end in range(b, m + 1):
                part = s[end - b : end]
                if m - end < self.shift.get(part, self.far):
                    self.shift[part] = m - end
            self.bucket.setdefault(s[m - b : m], []).append((s, items))

    def scan(self, line: str, hits: dict[int, int]) -> None:
        """Adds to ``hits`` the number of occurrences of each item's test strings."""
        m, b, far, shift, bucket = self.m, self.block, self.far, self.shift.get, self.bucket
        end, n = m, len(line)
        while end <= n:
            part = line[end - b : end]
            step = shift(part, far)
            if step:
                end += step
                continue
            for s, items in bucket[part]:
                if line.startswith(s, end - m):
                    for i in items:
                        hits[i] = hits.get(i, 0) + 1
            end += 1


def build_tables(lines: Iterable[str], run: int) -> list[ShiftTable]:
    """Tables by length class (powers of two), so that one very short item doesn't shorten every move."""
    classes: dict[int, dict[str, list[int]]] = {}
    for i, line in enumerate(lines):
        for s in test_strings(line, run):
            owners = classes.setdefault(len(s).bit_length(), {}).setdefault(s, [])
            if not owners or owners[-1] != i:
                owners.append(i)
    return [ShiftTable(strings) for _, strings in sorted(classes.items())]


def find_leaks(
    documents: DataFrame,
    items: DataFrame,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "item_text",
    run: int = RUN,
    items_per_pass: int = ITEMS_PER_PASS,
) -> DataFrame:
    """One row per document and leaked item: (doc_id, item_id, windows), windows = matching runs of ``run`` tokens."""
    spark = documents.sparkSession
    lines = documents.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("doc"), token_line(F.col(text)).alias("line")).where("length(line) > 2")
    wanted = items.where(F.col(item_id).isNotNull()).select(F.col(item_id).alias("item"), token_line(F.col(item_text)).alias("line")).where("length(line) > 2").distinct()
    doc_type, item_type = lines.schema["doc"].dataType, wanted.schema["item"].dataType
    schema = T.StructType([T.StructField("doc", doc_type), T.StructField("item", item_type), T.StructField("windows", T.LongType())])

    passes = max(1, -(-wanted.count() // items_per_pass))
    found = []
    for p in range(passes):
        block = wanted.where(F.pmod(F.xxhash64("item"), F.lit(passes)) == p).orderBy("item", "line").collect()
        ids = [r["item"] for r in block]
        shared = spark.sparkContext.broadcast([r["line"] for r in block])

        def search(batches: Iterator[pd.DataFrame], ids: list = ids, shared=shared) -> Iterator[pd.DataFrame]:
            tables = build_tables(shared.value, run)
            for pdf in batches:
                out = []
                for doc, line in zip(pdf["doc"], pdf["line"]):
                    hits: dict[int, int] = {}
                    for t in tables:
                        t.scan(line, hits)
                    out.extend((doc, ids[i], n) for i, n in hits.items())
                yield pd.DataFrame(out, columns=["doc", "item", "windows"])

        found.append(lines.mapInPandas(search, schema))
    result = found[0]
    for other in found[1:]:
        result = result.unionByName(other)
    return result.groupBy(F.col("doc").alias("doc_id"), F.col("item").alias("item_id")).agg(F.max("windows").alias("windows"))
