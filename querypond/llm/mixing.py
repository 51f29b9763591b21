"""A mixture of sources at target shares of its tokens: a multivariate-hypergeometric splitting tree.

Sizes. Every document is tokenized once; a source's size is the sum over its documents. The total T is the largest at which
no source needs its documents more than ``max_repeats`` times: the least over the sources of max_repeats * size / share. A
source without tokens can't contribute: its share is spread over the others in proportion, and the report shows it.

Blocks. A source's quota share * T is filled by whole passes over its documents and one partial pass. Each pass has its own
random order (a hash of document, pass and seed) and is cut into blocks, ranges of that order; the partial pass takes the blocks
that fit into what is left of the quota, and of one more block the documents that come closest to it. Only the totals of
blocks, at most ``blocks_per_source`` for a pass, reach the driver; documents never do.

Splitting. The blocks of all sources go to output shards down a binary tree: at each node the composition of the left half is
drawn from the multivariate hypergeometric distribution of the node's block counts, which is what dealing shuffled blocks
would give, without shuffling them. A shard then takes disjoint runs of each source's permuted blocks, and its documents are
shuffled locally.

Defined results: documents of sources without a target and null or empty texts are left out (no tokens); a target with a null
or non-positive share or repeat limit gets nothing; repeated document ids count as one document; no documents or no feasible
target give an empty mixture; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from querypond.llm.segmenting import encoder, vocabulary_path
from querypond.runtime import cut

BLOCKS_PER_SOURCE = 1024


def token_counts(documents: DataFrame, *, doc_id: str = "doc_id", text: str = "text", source: str = "source", vocabulary: str | None = None) -> DataFrame:
    """(doc_id, source, n_tokens), one row a document."""
    vocabulary = vocabulary or vocabulary_path()

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(vocabulary)
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "source": pdf["source"], "n_tokens": [len(enc.encode_ordinary(t)) for t in pdf["body"]]})

    rows = documents.where(F.col(doc_id).isNotNull() & F.col(source).isNotNull() & (F.octet_length(text) > 0)).select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(source).cast("string").alias("source"), F.col(text).alias("body"))
    counted = rows.mapInPandas(count, "doc_id bigint, source string, n_tokens bigint")
    return counted.groupBy("doc_id").agg(F.max_by("source", F.struct("n_tokens", "source")).alias("source"), F.max("n_tokens").alias("n_tokens"))


@dataclass
class Quota:
    source: str
    target: float
    share: float
    max_repeats: int
    size: int
    documents: int
    tokens: float = 0.0

    @property
    def passes(self) -> int:
        """Whole passes."""
        return min(self.max_repeats, int(self.tokens // self.size)) if self.size else 0


def quotas(sizes: dict[str, tuple[int, int]], targets: list[tuple[str, float, int]]) -> list[Quota]:
    """Token quotas of the largest mixture with the target shares; sizes: tokens and documents of each source."""
    out = []
    for source, share, repeats in sorted(t for t in targets if t[0] is not None):
        size, n = sizes.get(source, (0, 0))
        usable = share is not None and share > 0 and repeats is not None and repeats > 0 and size > 0
        out.append(Quota(source, float(share or 0), float(share) if usable else 0.0, int(repeats or 0), int(size), int(n)))
    whole = math.fsum(q.share for q in out)
    if whole:
        for q in out:
            q.share /= whole
        total = min(q.max_repeats * q.size / q.share for q in out if q.share)
        for q in out:
            q.tokens = q.share * total
    return out


def split_blocks(counts: np.ndarray, shards: int, rng: np.random.Generator) -> np.ndarray:
    """(shards, sources): blocks of each source in each shard. Shards get equal numbers of blocks, but for the remainder."""
    out = np.zeros((shards, len(counts)), dtype=np.int64)
    stack = [(0, shards, counts.astype(np.int64))]
    while stack:
        first, n, here = stack.pop()
        if n == 1:
            out[first] = here
            continue
        left = n // 2
        take = int(here.sum()) * left // n
        part = rng.multivariate_hypergeometric(here, take, method="marginals") if here.sum() else here * 0
        stack += [(first, left, part), (first + left, n - left, here - part)]
    return out


def mixture(
    documents: DataFrame,
    targets: DataFrame,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    source_name: str = "source_name",
    target_share: str = "target_share",
    max_repeats: str = "max_repeats",
    shard_tokens: int = 8_000_000,
    max_shards: int = 4096,
    blocks_per_source: int = BLOCKS_PER_SOURCE,
    seed: int = 17,
    vocabulary: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(rows, report). rows: (shard, position, doc_id, source, repeat_no, n_tokens); report: (source, target_share,
    actual_share, tokens, documents, available_tokens, max_used, max_repeats), one row a target."""
    spark = documents.sparkSession
    wanted = [(r["s"], r["t"], r["m"]) for r in targets.select(F.col(source_name).alias("s"), F.col(target_share).alias("t"), F.col(max_repeats).alias("m")).distinct().collect()]
    counted = cut(token_counts(documents, doc_id=doc_id, text=text, source=source, vocabulary=vocabulary).where(F.col("source").isin([w[0] for w in wanted]) & (F.col("n_tokens") > 0)))
    sizes = {r["source"]: (r["t"], r["n"]) for r in counted.groupBy("source").agg(F.sum("n_tokens").alias("t"), F.count("*").alias("n")).collect()}
    plan = quotas(sizes, wanted)
    active = [q for q in plan if q.tokens > 0]
    if not active:
        return _no_rows(spark), _report(spark, plan, {})

    # Occurrences: each document once for every whole pass and once for the partial one. The block is a range of the pass's
    # hash order, so its place in the order is known without sorting a source.
    plan_of = {q.source: q for q in active}
    blocks = {q.source: max(1, min(blocks_per_source, q.documents)) for q in active}
    passes = spark.createDataFrame([(q.source, p, blocks[q.source]) for q in active for p in range(q.passes + (q.passes < q.max_repeats))], "source string, repeat_no int, blocks int")
    key = F.xxhash64("doc_id", "repeat_no", F.lit(seed))
    place = F.shiftrightunsigned(key, 11).cast("double") / F.lit(float(1 << 53))
    taken = counted.join(F.broadcast(passes), "source").withColumn("place", place).withColumn("block", F.floor(F.col("place") * F.col("blocks")).cast("int"))
    totals = taken.groupBy("source", "repeat_no", "block").agg(F.sum("n_tokens").alias("t")).orderBy("source", "repeat_no", "block").collect()

    # Blocks that the quota takes whole, in their order, passing over those that don't fit; then one more, in part.
    whole, ends, left = [], {}, {q.source: q.tokens for q in active}
    over: dict[str, list] = {s: [] for s in left}
    for r in totals:
        s = r["source"]
        if r["t"] <= left[s] + 1e-6:
            whole.append((s, r["repeat_no"], r["block"]))
            left[s] -= r["t"]
        elif r["repeat_no"] == plan_of[s].passes:
            over[s].append((r["t"], r["repeat_no"], r["block"]))
    for s, rest in over.items():
        if rest and left[s] >= 1:
            _, p, b = min(rest)
            ends[s] = (p, b, left[s])
    dealt = whole + [(s, p, b) for s, (p, b, _) in ends.items()]
    names = [q.source for q in active]
    total = sum(q.tokens for q in active)
    shards = int(max(1, min(max_shards, math.ceil(total / shard_tokens))))
    rng = np.random.default_rng(seed)
    counts = np.array([sum(d[0] == s for d in dealt) for s in names], dtype=np.int64)
    tree = split_blocks(counts, shards, rng)
    deal = []
    for i, s in enumerate(names):
        mine = [d for d in dealt if d[0] == s]
        order = rng.permutation(len(mine))
        shard = np.repeat(np.arange(shards), tree[:, i])
        deal += [(*mine[j], int(shard[k]), ends.get(s, (None,))[:2] == mine[j][1:], float(ends[s][2]) if s in ends and ends[s][:2] == mine[j][1:] else 0.0) for k, j in enumerate(order)]
    dealt_rows = spark.createDataFrame(deal, "source string, repeat_no int, block int, shard int, partial boolean, room double")

    # In the last block of a source documents are taken in order while they come closer to the quota.
    chosen = taken.join(F.broadcast(dealt_rows), ["source", "repeat_no", "block"])
    order = Window.partitionBy("source", "repeat_no", "block").orderBy("place", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    last = chosen.where("partial").withColumn("upto", F.sum("n_tokens").over(order)).where(F.col("upto") - F.col("n_tokens") / 2 <= F.col("room"))
    kept = chosen.where("NOT partial").select("shard", "doc_id", "source", "repeat_no", "n_tokens").unionByName(last.select("shard", "doc_id", "source", "repeat_no", "n_tokens"))
    local = Window.partitionBy("shard").orderBy(F.xxhash64("doc_id", "repeat_no", "shard", F.lit(seed + 1)), "doc_id", "repeat_no")
    rows = kept.withColumn("position", F.row_number().over(local) - 1).select("shard", "position", "doc_id", "source", "repeat_no", "n_tokens")
    actual = kept.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("documents"), F.max(F.col("repeat_no") + 1).alias("max_used"))
    return rows, _report(spark, plan, actual)


def _no_rows(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "shard int, position int, doc_id bigint, source string, repeat_no int, n_tokens bigint")


def _report(spark: SparkSession, plan: list[Quota], actual) -> DataFrame:
    base = spark.createDataFrame([(q.source, q.target, q.size, q.max_repeats) for q in plan], "source string, target_share double, available_tokens bigint, max_repeats int")
    if isinstance(actual, dict):
        actual = spark.createDataFrame([], "source string, tokens bigint, documents bigint, max_used int")
    joined = base.join(F.broadcast(actual), "source", "left").fillna(0, ["tokens", "documents", "max_used"])
    share = F.col("tokens") / F.sum("tokens").over(Window.partitionBy())
    return joined.select("source", "target_share", F.coalesce(share, F.lit(0.0)).alias("actual_share"), "tokens", "documents", "available_tokens", "max_used", "max_repeats")


def with_texts(rows: DataFrame, documents: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The mixture with its texts, in the order of shard and position within each partition; of a repeated id the longest text."""
    bodies = documents.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text")).where(F.octet_length("text") > 0).groupBy("doc_id").agg(F.max_by("text", F.struct(F.octet_length("text"), "text")).alias("text"))
    return rows.join(bodies, "doc_id").repartition("shard").sortWithinPartitions("shard", "position")
