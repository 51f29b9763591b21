"""Near-duplicate records with small edits: a chosen-path set similarity join.

A record's set T holds the distinct tokens (maximal runs of a-z and 0-9, lower case) of its text columns. Two records are
linked when both sets have at least ``min_tokens`` tokens and their Jaccard similarity is at least ``threshold``.

Paths. Sets are split recursively on sampled shared tokens. At the root of the path tree some tokens are chosen, at each
further node ``spread``, by hashes of the path and the token that all sets share (consistent weighted sampling), in proportion
to a power of its information -log(df / N): rare tokens split well, frequent ones hardly do, and a token of one set only, which
can't be shared, is never chosen. A path goes on until a chance meeting of ``bucket`` records is all that is expected in its
bucket, N times the product of its tokens' frequencies, or until its set has no token left. Sets that reach one bucket are
compared there by brute force: 152-bit sketches of one-bit minima first, then, once for each pair, the sets themselves.

Recall. Paths get deeper with N, and deeper ones are shared less often. From the depths that a sample of the sets has at this N,
tokens are added at the root (at least ``width``), then runs with fresh hashes, until ``recall`` of the pairs right at the
threshold are expected to meet and to pass the sketches (``roots_for``); more similar ones meet more often. The sketches' share
of the misses is half of what the recall allows (``sketch_bound``). ``exact_links`` gives all links, without sampling or
sketches, by prefixes of the rarest tokens; ``all_groups`` uses it for the sets that are too small for many paths.

Scale. Token frequencies are kept in a fixed number of hashed counters, so what is broadcast doesn't grow. Records with
equal sets form a class that takes part once. Buckets and sets move as fixed-width rows; the comparison inside a bucket is
an equi-join on the bucket's key, both sides one exchange, which AQE splits where a key is hot. Frequency counts use all records.

Defined results: null columns count as empty text; rows with a null id are dropped; of rows with one id the one with the
largest ``newest`` value counts (a null one comes last; ties: the larger set, then the larger hash of the set), so that an id
has one row; sets below ``min_tokens`` are left out by ``near_duplicates``; ``all_groups`` keeps them, a record without tokens as
a class of its own; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from querypond.runtime import cut

COUNTERS = 1 << 18
#: Bits of a sketch: two words, and the low bits of a bucket's key (of whose hash 40 bits are left, enough for 10^11 records).
KEY_BITS = 24
SKETCH_BITS = 128 + KEY_BITS
MIX1, MIX2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
#: Rows up to which a side is broadcast; above, the join is shuffled.
BROADCAST_ROWS = 200_000
#: Sets whose paths are looked at to tell how deep paths are, and the most tokens at the root in one run.
SAMPLE, WIDEST = 2000, 16


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer with good avalanche."""
    x = (x ^ (x >> np.uint64(33))) * MIX1
    x = (x ^ (x >> np.uint64(33))) * MIX2
    return x ^ (x >> np.uint64(33))


def token_set(columns: list[Column]) -> Column:
    """Sorted distinct tokens as 32-bit hashes."""
    text = F.lower(F.concat_ws(" ", *[F.coalesce(c.cast("string"), F.lit("")) for c in columns]))
    words = F.regexp_extract_all(text, F.lit("[a-z0-9]+"), F.lit(0))
    return F.array_sort(F.array_distinct(F.transform(words, lambda w: F.hash(w))))


def sketch_miss(threshold: float, bound: int) -> float:
    """Probability that the sketches of a pair at the threshold differ in more bits than the bound."""
    p = (1 - threshold) / 2
    return sum(math.comb(SKETCH_BITS, k) * p**k * (1 - p) ** (SKETCH_BITS - k) for k in range(bound + 1, SKETCH_BITS + 1))


def sketch_bound(threshold: float, recall: float) -> int:
    """Differing bits above which a pair isn't compared further: half of the misses that the recall allows."""
    return next(b for b in range(SKETCH_BITS + 1) if sketch_miss(threshold, b) <= (1 - recall) / 2)


def roots_for(recall: float, threshold: float, depths: list[np.ndarray], least: int) -> int:
    """Tokens at the root, of all runs together, after which a pair at the threshold has met and passed its sketches with the wanted
    probability; depths: of each set of a sample, the lengths of its paths. With sets of one size a sampled token is shared with a
    probability of about the threshold, and a path must be shared throughout."""
    wanted = 1 - recall / (1 - sketch_miss(threshold, sketch_bound(threshold, recall)))
    meets = np.array([np.mean(np.log1p(-(threshold ** d.astype(float)))) for d in depths if len(d)])
    roots = least
    while len(meets) and np.mean(np.exp(meets * roots)) > wanted:
        roots += 1
    return roots


class Paths:
    """Bucket keys and sketches of many sets at once."""

    def __init__(self, frequency: np.ndarray, total: int, *, runs: int, width: int, spread: int, bucket: float, max_depth: int, power: float = 1.0, seed: int = 5):
        self.share = np.clip(frequency / max(1, total), 1.0 / max(2, total), 1.0)
        # A token of a single set can't be shared: it is never chosen.
        self.weight = np.where(frequency > 1, (-np.log(self.share * 0.999)) ** power, 0.0)
        self.total, self.runs, self.width, self.spread, self.bucket, self.max_depth, self.seed = total, runs, width, spread, bucket, max_depth, seed

    def keys(self, tokens: np.ndarray, lengths: np.ndarray, chunk: int = 2000) -> tuple[np.ndarray, np.ndarray]:
        """(record number, key) of all buckets of all runs, some thousand records at a time."""
        bounds = np.r_[0, np.cumsum(lengths)]
        parts = []
        for first in range(0, len(lengths), chunk):
            last = min(len(lengths), first + chunk)
            record, key, _ = self._keys(tokens[bounds[first] : bounds[last]], lengths[first:last])
            parts.append((record + first, key))
        return tuple(np.concatenate(x) for x in zip(*parts))

    def depths(self, tokens: np.ndarray, lengths: np.ndarray) -> list[np.ndarray]:
        """The lengths of the paths of each set."""
        record, _, depth = self._keys(tokens, lengths)
        return [depth[record == i] for i in range(len(lengths))]

    def _keys(self, tokens: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n = len(lengths)
        start = np.cumsum(lengths) - lengths
        slot = tokens.view(np.uint32).astype(np.int64) & (COUNTERS - 1)
        weight, share = self.weight[slot], self.share[slot]
        t64 = mix(tokens.view(np.uint32).astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
        out_record, out_key, out_depth = [], [], []
        for run in range(self.runs):
            rec = np.arange(n)
            path = np.full(n, mix(np.array([self.seed * 1000 + run], dtype=np.uint64))[0])
            expected = np.full(n, float(self.total))
            used = np.zeros((n, 0), dtype=np.int64)
            for depth in range(self.max_depth):
                count = lengths[rec]
                first = np.cumsum(count) - count
                at = np.repeat(start[rec] - first, count) + np.arange(int(count.sum()))
                child = mix(np.repeat(path, count) ^ t64[at])
                # consistent weighted sampling: the smallest exponential variates, the same in all sets that hold the token
                u = ((child >> np.uint64(11)).astype(np.float64) + 0.5) / float(1 << 53)
                with np.errstate(divide="ignore"):
                    draw = -np.log(u) / weight[at]
                for j in range(depth):  # no token twice in a path
                    draw[first + used[:, j] - start[rec]] = np.inf
                chosen = []
                for _ in range(self.width if depth == 0 else self.spread):
                    least = np.minimum.reduceat(draw, first)
                    hit = np.flatnonzero((draw == np.repeat(least, count)) & np.isfinite(draw))
                    chosen.append(hit)
                    draw[hit] = np.inf
                hit = np.concatenate(chosen)
                node = np.searchsorted(first, hit, side="right") - 1
                token = at[hit]
                # a set with no further token to share ends where it is
                stuck = np.setdiff1d(np.arange(len(rec)), node) if depth else np.zeros(0, dtype=np.int64)
                out_record.append(rec[stuck])
                out_key.append(path[stuck])
                out_depth.append(np.full(len(stuck), depth))
                rec, path, expected, used = rec[node], child[hit], expected[node] * share[token], np.c_[used[node], token]
                done = (expected <= self.bucket) | (depth == self.max_depth - 1)
                out_record.append(rec[done])
                out_key.append(path[done])
                out_depth.append(np.full(int(done.sum()), depth + 1))
                rec, path, expected, used = rec[~done], path[~done], expected[~done], used[~done]
                if not len(rec):
                    break
        return np.concatenate(out_record), np.concatenate(out_key), np.concatenate(out_depth)

    @staticmethod
    def sketches(tokens: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """SKETCH_BITS one-bit minwise values of each (non-empty) set, 64 a column."""
        start = np.cumsum(lengths) - lengths
        t64 = tokens.view(np.uint32).astype(np.uint64)
        out = np.zeros((-(-SKETCH_BITS // 64), len(lengths)), dtype=np.uint64)
        for bit in range(SKETCH_BITS):
            least = np.minimum.reduceat(mix(t64 + np.uint64((bit + 1) * 0x9E3779B97F4A7C15 % (1 << 64))), start)
            out[bit // 64] |= ((least >> np.uint64(7)) & np.uint64(1)) << np.uint64(bit % 64)
        return out


def record_sets(records: DataFrame, *, id_col: str, columns: list[str], newest: str | None, min_tokens: int) -> DataFrame:
    """(id, tokens), one row an id, of the records with enough tokens. Only the ids that repeat are gathered; the rest stay where they are."""
    rows = records.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), (F.col(newest) if newest else F.lit(0)).alias("newest"), *[F.col(c).alias(f"text_{i}") for i, c in enumerate(columns)])
    tokens = token_set([F.col(f"text_{i}") for i in range(len(columns))]).alias("tokens")
    repeated = rows.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id")
    if repeated.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        repeated = F.broadcast(repeated)
    once = rows.join(repeated, "id", "left_anti").select("id", tokens)
    several = rows.join(repeated, "id", "left_semi").select("id", "newest", tokens)
    latest = F.struct(F.col("newest").isNotNull(), "newest", F.size("tokens"), F.xxhash64("tokens"))
    return once.unionByName(several.groupBy("id").agg(F.max_by("tokens", latest).alias("tokens"))).where(F.size("tokens") >= min_tokens)


def token_frequencies(sets: DataFrame) -> tuple[np.ndarray, int]:
    """Document frequencies in COUNTERS hashed counters, and the number of sets."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(COUNTERS, dtype=np.int64), 0
        for b in batches:
            t = np.asarray(b.column("tokens").flatten(), dtype=np.int32)
            total += np.bincount(t.view(np.uint32).astype(np.int64) & (COUNTERS - 1), minlength=COUNTERS)
            n += b.num_rows
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[used, -1].astype(np.int32)), pa.array(np.r_[total[used], n])], names=["slot", "n"])

    out = np.zeros(COUNTERS, dtype=np.float64)
    total = 0
    for r in sets.select("tokens").mapInArrow(count, "slot int, n bigint").groupBy("slot").agg(F.sum("n").alias("n")).collect():
        if r["slot"] < 0:
            total = r["n"]
        else:
            out[r["slot"]] = r["n"]
    return out, total


def classes_of(sets: DataFrame) -> DataFrame:
    """(id, class, tokens). The sets are read by several branches: they are made once, and none recomputes texts when an executor is lost."""
    return cut(sets.select("id", F.xxhash64("tokens").alias("class"), "tokens"))


def verified(candidates: DataFrame, one: DataFrame, threshold: float) -> DataFrame:
    """(class_a, class_b, jaccard) of the candidate pairs whose sets, in one (class, tokens), are similar."""
    left, right = (one.select(F.col("class").alias(f"class_{s}"), F.col("tokens").alias(f"tokens_{s}")) for s in "ab")
    # One exchange by the first class serves the pairs' distinct and their first join.
    pairs = candidates.repartition("class_a").distinct()
    common = F.size(F.array_intersect("tokens_a", "tokens_b"))
    jaccard = common / (F.size("tokens_a") + F.size("tokens_b") - common)
    return pairs.join(left, "class_a").join(right, "class_b").select("class_a", "class_b", jaccard.alias("jaccard")).where(F.col("jaccard") >= threshold)


def path_links(
    hashed: DataFrame,
    *,
    counted: tuple[np.ndarray, int] | None = None,
    threshold: float = 0.7,
    recall: float = 0.999,
    width: int = 12,
    spread: int = 1,
    bucket: float = 64.0,
    power: float = 1.5,
    max_depth: int = 24,
) -> DataFrame:
    """Links (class_a, class_b, jaccard), a < b, between the classes of (id, class, tokens), by chosen paths; counted: token_frequencies,
    where they are known."""
    spark = hashed.sparkSession
    frequency, total = counted or token_frequencies(hashed)
    shared = spark.sparkContext.broadcast(frequency)
    settings = dict(spread=spread, bucket=bucket, max_depth=max_depth, power=power)
    # About SAMPLE sets, by a hash of the id: as many are expected whatever their number, and no task sends more than its share.
    taken = F.pmod(F.xxhash64("id", F.lit("depths")), F.lit(1 << 40)) < F.lit(int((1 << 40) * min(1.0, SAMPLE / max(1, total))))
    sample = [np.array(r["tokens"], dtype=np.int32) for r in hashed.where(taken & (F.size("tokens") > 0)).select("tokens").collect()]
    roots = width
    if sample:
        depths = Paths(frequency, total, runs=1, width=width, **settings).depths(np.concatenate(sample), np.array([len(x) for x in sample]))
        roots = roots_for(recall, threshold, depths, width)
    # Few tokens are distinct in a small set: more than so many at the root are spread over runs.
    runs = math.ceil(roots / WIDEST)
    settings |= dict(runs=runs, width=math.ceil(roots / runs))

    def paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maker = Paths(shared.value, total, **settings)
        for b in batches:
            if not b.num_rows:
                continue
            column = b.column("tokens")
            lengths = np.asarray(column.value_lengths(), dtype=np.int64)
            tokens = np.asarray(column.flatten(), dtype=np.int32)
            low, high, rest = maker.sketches(tokens, lengths)
            record, key = maker.keys(tokens, lengths)
            key = key >> np.uint64(KEY_BITS) << np.uint64(KEY_BITS) | rest[record]
            low, high = low.view(np.int64), high.view(np.int64)
            own = np.asarray(b.column("class"))
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(own[record]), pa.array(low[record]), pa.array(high[record])], names=["key", "class", "low", "high"])

    # One row a class. Its exchange serves the paths and, on both sides, the comparison of the sets.
    one = hashed.groupBy("class").agg(F.first("tokens").alias("tokens"))
    buckets = one.where("size(tokens) > 0").mapInArrow(paths, "key bigint, class bigint, low bigint, high bigint")
    # Both sides of the self-join keep their columns' names, so that they are one exchange, which AQE may split where a key is hot.
    a, b = buckets.alias("a"), buckets.alias("b")
    differing = reduce(Column.__add__, [F.bit_count(F.col(f"a.{c}").bitwiseXOR(F.col(f"b.{c}"))) for c in ("low", "high", "key")])
    near = (F.shiftright("a.key", KEY_BITS) == F.shiftright("b.key", KEY_BITS)) & (F.col("a.class") < F.col("b.class")) & (differing <= sketch_bound(threshold, recall))
    candidates = a.join(b, near).select(F.col("a.class").alias("class_a"), F.col("b.class").alias("class_b"))
    return verified(candidates, one, threshold)


def exact_links(hashed: DataFrame, *, threshold: float = 0.7, below: int | None = None, counted: tuple[np.ndarray, int] | None = None) -> DataFrame:
    """Links (class_a, class_b, jaccard), a < b, between the classes of (id, class, tokens), all of them; with below, those of which one
    set has fewer tokens than that. Similar sets share at least two tokens, so two of the rarest of each: a pair of tokens is a key.
    Rare is what the hashed counters say; any order that all sets share finds all links."""
    frequency, _ = counted or token_frequencies(hashed)
    shared = hashed.sparkSession.sparkContext.broadcast(frequency)
    sized = hashed.where(F.size("tokens") > 1)
    if below is not None:
        sized = sized.where(F.size("tokens") <= math.floor((below - 1) / threshold + 1e-9))
    one = sized.groupBy("class").agg(F.first("tokens").alias("tokens"))

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = shared.value
        for b in batches:
            own, sizes, found = [], [], []
            for c, tokens in zip(b.column("class").to_pylist(), b.column("tokens").to_pylist()):
                n = len(tokens)
                t = np.array(tokens, dtype=np.int32).view(np.uint32).astype(np.int64)
                # Of n tokens, all but the t * n - 2 most frequent ones: of similar sets these hold two shared ones at least.
                rare = np.sort(t[np.lexsort((t, often[t & (COUNTERS - 1)]))[: n - math.ceil(n * threshold - 1e-9) + 2]])
                i, j = np.triu_indices(len(rare), 1)
                found.append(rare[i] << 32 | rare[j])
                own.append(np.full(len(i), c))
                sizes.append(np.full(len(i), n))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(own).astype(np.int64)), pa.array(np.concatenate(sizes).astype(np.int32)), pa.array(np.concatenate(found).astype(np.int64))], names=["class", "n", "key"])

    keyed = one.mapInArrow(keys, "class bigint, n int, key bigint")
    a, b = keyed.alias("a"), keyed.alias("b")
    least, most = F.least("a.n", "b.n"), F.greatest("a.n", "b.n")
    near = (F.col("a.key") == F.col("b.key")) & (F.col("a.class") < F.col("b.class")) & (least >= threshold * most - 1e-9)
    if below is not None:
        near = near & (least < below)
    return verified(a.join(b, near).select(F.col("a.class").alias("class_a"), F.col("b.class").alias("class_b")), one, threshold)


def all_groups(records: DataFrame, *, id_col: str = "result_id", columns: tuple[str, ...] = ("title", "snippet"), newest: str | None = "ingested_at", exact_below: int = 16, threshold: float = 0.7, **join) -> tuple[DataFrame, DataFrame]:
    """(members, links) of all records, short ones included: chosen paths, and an exact join where a set has fewer than ``exact_below``
    tokens. A record without tokens is a class of its own."""
    sets = record_sets(records, id_col=id_col, columns=list(columns), newest=newest, min_tokens=0)
    own = F.when(F.size("tokens") > 0, F.xxhash64("tokens")).otherwise(F.xxhash64(F.lit("no tokens"), "id"))
    hashed = cut(sets.select("id", own.alias("class"), "tokens"))
    counted = token_frequencies(hashed)
    long = path_links(hashed.where(F.size("tokens") >= exact_below), threshold=threshold, counted=counted, **join)
    return hashed.select("id", "class"), long.unionByName(exact_links(hashed, threshold=threshold, below=exact_below, counted=counted))


def linked_pairs(members: DataFrame, links: DataFrame) -> DataFrame:
    """All linked pairs of records (result_a < result_b), members of one class included."""
    a, b = (members.select(F.col("class").alias(f"class_{s}"), F.col("id").alias(f"id_{s}")) for s in "ab")
    across = links.join(a, "class_a").join(b, "class_b").select("id_a", "id_b")
    repeated = members.groupBy("class").agg(F.count("*").alias("n")).where("n > 1").select("class")
    within = members.join(repeated, "class")
    inside = within.select("class", F.col("id").alias("id_a")).join(within.select("class", F.col("id").alias("id_b")), "class").where("id_a < id_b").select("id_a", "id_b")
    both = across.unionByName(inside)
    return both.select(F.least("id_a", "id_b").alias("result_a"), F.greatest("id_a", "id_b").alias("result_b"))


def near_duplicates(records: DataFrame, *, id_col: str = "result_id", columns: tuple[str, ...] = ("title", "snippet"), newest: str | None = "ingested_at", min_tokens: int = 16, **join) -> tuple[DataFrame, DataFrame]:
    """(members, links): members (id, class) with class = a hash of the set; links (class_a, class_b, jaccard), a < b."""
    hashed = classes_of(record_sets(records, id_col=id_col, columns=list(columns), newest=newest, min_tokens=min_tokens))
    return hashed.select("id", "class"), path_links(hashed, **join)


def link_counts(members: DataFrame, links: DataFrame) -> DataFrame:
    """One row a record: (id, class, class_size, links), class = the lowest id with an equal set, links = records in other classes that
    it is linked to."""
    size = members.groupBy("class").agg(F.count("*").alias("class_size"), F.min("id").alias("lowest"))
    ends = reduce(DataFrame.unionByName, [links.select(F.col(f"class_{s}").alias("class"), F.col(f"class_{o}").alias("other")) for s, o in ("ab", "ba")])
    degree = ends.join(size.select(F.col("class").alias("other"), "class_size"), "other").groupBy("class").agg(F.sum("class_size").alias("links"))
    per_class = size.join(degree, "class", "left").select("class", "class_size", "lowest", F.coalesce("links", F.lit(0)).alias("links"))
    return members.join(per_class, "class").select("id", F.col("lowest").alias("class"), "class_size", "links")
