"""The k most similar vectors of every vector: vantage-point trees per shard.

Vectors are brought to unit length; similarity is the cosine, and on the unit sphere the chord sqrt(2 - 2 cos) is a metric.

Shards. A bounded sample of the vectors serves as vantage points of the first level, one shard each; every vector belongs to
the shard of its nearest vantage point and is indexed there, once. A vector also visits each other shard whose vantage point
is at most ``reach / factor`` farther than its own, where reach is the chord of ``min_cosine``. Of two vectors within reach of
each other at least one visits the other's shard when factor is 1: with own points p and q, the two excesses d(x,q) - d(x,p)
and d(y,p) - d(y,q) add up to at most 2 d(x,y), so the smaller is at most d(x,y). A factor above 1 visits fewer shards; it
loses a pair only if both excesses are above the relaxed bound.

Trees. In a shard a vantage-point tree holds the vectors; a visiting vector skips the inside (outside) of a node's ball where
its distance to the vantage point is more than its reach / factor outside (inside) the radius. Factor 1 gives the exact result, up to the rounding of components to 16 bits (about 1e-5 in the cosine).

Scale. A shard with more than ``shard_rows`` vectors or visitors is a grid of tasks, each with a part of either, so no task
grows with the data. Equal vectors form a class, of which the k + 1 lowest ids are indexed (any other has the same neighbours:
the k lowest of its class); the rest are answered from the class without a search. Only the vantage points (at most
``max_points``), and counts by shard, reach the driver.

Defined results: rows with a null id, or a vector that is null, of another length than ``dimension``, with a null or a value
that is not finite, or all zero, are not valid and take no part; of rows with one id, that with the largest ``newest`` value
counts (then any); ties in the cosine go to the lower id; an empty input gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SCALE = 32_000


def unit_rows(values: np.ndarray) -> np.ndarray:
    values = values.astype(np.float64)
    top = np.abs(values).max(axis=1, keepdims=True)
    values = values / top
    return values / np.sqrt((values * values).sum(axis=1, keepdims=True))


def pack(units: np.ndarray) -> np.ndarray:
    return np.rint(units * SCALE).astype("<i2")


def unpack(cells: list[bytes] | pa.Array, dimension: int) -> np.ndarray:
    raw = b"".join(cells) if isinstance(cells, list) else b"".join(cells.to_pylist())
    return np.frombuffer(raw, dtype="<i2").reshape(-1, dimension).astype(np.float32) / np.float32(SCALE)


def chord(cosine: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0, 2 - 2 * cosine))


class VantageTree:
    """A vantage-point tree over unit rows; leaves hold up to ``leaf`` of them."""

    def __init__(self, units: np.ndarray, leaf: int = 192, seed: int = 7):
        self.units, self.leaf = units, leaf
        rng = np.random.default_rng(seed)
        self.nodes: list[tuple] = []
        self._build(np.arange(len(units)), rng)

    def _build(self, rows: np.ndarray, rng: np.random.Generator) -> int:
        at = len(self.nodes)
        self.nodes.append(())
        if len(rows) > self.leaf:
            point = int(rows[rng.integers(len(rows))])
            d = chord(self.units[rows] @ self.units[point])
            radius = float(np.median(d))
            inner = d <= radius
            if 0 < inner.sum() < len(rows):
                self.nodes[at] = (point, radius, self._build(rows[inner], rng), self._build(rows[~inner], rng))
                return at
        self.nodes[at] = (rows,)
        return at

    def leaves(self, queries: np.ndarray, reach: np.ndarray, factor: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(leaf rows, query numbers that reach the leaf)."""
        stack = [(0, np.arange(len(queries)))]
        while stack:
            node, who = stack.pop()
            if not len(who):
                continue
            here = self.nodes[node]
            if len(here) == 1:
                yield here[0], who
                continue
            point, radius, inner, outer = here
            gap = chord(queries[who] @ self.units[point]) - radius
            slack = reach[who] / factor
            near_in, near_out = gap <= slack, gap >= -slack
            stack.append((outer, who[near_out]))
            stack.append((inner, who[near_in]))


def _keep_best(values: list, owner: np.ndarray, other: np.ndarray, cosine: np.ndarray, k: int) -> None:
    """Appends, of each owner's pairs, the k best by (cosine, lower other)."""
    if not len(owner):
        return
    order = np.lexsort((other, -cosine, owner))
    owner, other, cosine = owner[order], other[order], cosine[order]
    first = np.r_[0, np.flatnonzero(owner[1:] != owner[:-1]) + 1]
    rank = np.arange(len(owner)) - np.repeat(first, np.diff(np.r_[first, len(owner)]))
    keep = rank < k
    values.append((owner[keep], other[keep], cosine[keep]))


def search_shard(ids: np.ndarray, units: np.ndarray, visitors: np.ndarray, seeking: np.ndarray, k: int, min_cosine: float, factor: float):
    """Pairs (a, b, cosine): the k best of each visitor among the shard's rows, and of each row among its visitors."""
    tree = VantageTree(units)
    start = float(chord(np.array(min_cosine)))
    reach = np.full(len(visitors), start, dtype=np.float32)
    owners, rows, cosines = [], [], []
    for leaf, who in tree.leaves(seeking, reach, factor):
        for part in np.array_split(who, -(-len(who) // 4096)):
            sims = seeking[part] @ units[leaf].T
            q, x = np.nonzero(sims >= np.float32(min_cosine - 2e-5))
            if not len(q):
                continue
            keep = visitors[part[q]] != ids[leaf[x]]
            q, x = q[keep], x[keep]
            owners.append(part[q])
            rows.append(leaf[x])
            cosines.append(sims[q, x])
    if not owners:
        return None
    owner, row, cosine = np.concatenate(owners), np.concatenate(rows), np.concatenate(cosines)
    out: list = []
    _keep_best(out, visitors[owner], ids[row], cosine, k)
    _keep_best(out, ids[row], visitors[owner], cosine, k)
    a, b, c = (np.concatenate(x) for x in zip(*out))
    return a, b, c.astype(np.float64)


def nearest_vectors(
    vectors: DataFrame,
    *,
    id_col: str = "entry_id",
    vector: str = "embedding",
    newest: str | None = None,
    dimension: int = 64,
    k: int = 5,
    min_cosine: float = 0.92,
    factor: float = 4.0,
    rows_per_point: int = 600,
    max_points: int = 4096,
    shard_rows: int = 20_000,
    seed: int = 11,
) -> DataFrame:
    """(id, neighbour, cosine, rank): of each valid vector the k most similar others with a cosine of at least min_cosine."""
    if factor < 1:
        raise ValueError("factor is 1 (exact) or more")
    spark = vectors.sparkSession
    x = F.col("v")
    raw = vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector).alias("v"), (F.col(newest).cast("double") if newest else F.lit(0.0)).alias("newest"))
    valid = raw.where(F.col("id").isNotNull() & (F.size("v") == dimension) & ~F.exists(x, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf"))) & F.exists(x, lambda e: e != 0))

    def packing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            units = unit_rows(np.asarray(b.column("v").flatten(), dtype=np.float64).reshape(-1, dimension))
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("newest"), pa.array([r.tobytes() for r in pack(units)], pa.binary())], names=["id", "newest", "v"])

    form = "id bigint, newest double, v binary"
    packed = valid.mapInArrow(packing, form)
    one = packed.groupBy("id").agg(F.max_by("v", F.struct("newest", "v")).alias("v"))

    # Vantage points: the vectors whose ids hash lowest, a bounded sample; every vector is indexed.
    total = valid.count()
    points_wanted = int(min(max_points, max(1, total // rows_per_point)))
    # All tasks together send some more than these, of which the lowest are taken.
    place = F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 40))
    lowest = valid.where(place < F.lit(int((1 << 40) * min(1.0, (1.3 * points_wanted + 20) / max(1, total)))))
    sent = lowest.mapInArrow(packing, form).select(place.alias("place"), "id", "v").collect()
    sample = sorted(sent, key=lambda r: (r["place"], r["id"], bytes(r["v"])))[:points_wanted]
    if not sample:
        return spark.createDataFrame([], "id bigint, neighbour bigint, cosine double, rank int")
    points = spark.sparkContext.broadcast(np.unique(np.stack([np.frombuffer(bytes(r["v"]), dtype="<i2") for r in sample]), axis=0))
    margin = float(chord(np.array(min_cosine))) / factor

    def home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = points.value.astype(np.float32) / np.float32(SCALE)
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array(np.argmax(unpack(b.column("v"), dimension) @ p.T, axis=1).astype(np.int32))], names=["shard"])

    # Rows of each shard by a first pass without a shuffle of vectors; at most max_points counts come to the driver.
    counts = {r["shard"]: r["n"] for r in packed.select("v").mapInArrow(home, "shard int").groupBy("shard").agg(F.count("*").alias("n")).collect()}
    splits = np.ones(len(points.value), dtype=np.int64)
    for s, n in counts.items():
        splits[s] = max(1, math.ceil(n / shard_rows))

    # The k + 1 lowest ids of a class of equal vectors; the limit on the rank is applied before the shuffle, too.
    ranked = one.withColumn("n", F.row_number().over(Window.partitionBy("v").orderBy("id"))).where(F.col("n") <= k + 1)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = points.value.astype(np.float32) / np.float32(SCALE)
        for b in batches:
            if not b.num_rows:
                continue
            cells, ids = b.column("v"), np.asarray(b.column("id"))
            d = chord(unpack(cells, dimension) @ p.T)
            own = np.argmin(d, axis=1)
            row, shard = np.nonzero(d <= d[np.arange(len(d)), own][:, None] + margin)
            mine = shard == own[row]
            n = splits[shard]
            # A shard's rows are dealt to n parts, its visitors to n parts; each pair of parts is a task.
            part = (ids[row] * 2654435761 >> 7) % n
            # as a visitor: to each part of the rows; as a row: to each part of the visitors
            take = np.repeat(np.arange(len(row)), n)
            step = np.arange(len(take)) - np.repeat(np.cumsum(n) - n, n)
            v_row, v_shard, v_part, v_mine = row[take], shard[take], part[take], mine[take]
            single = (n[take] == 1) & v_mine
            keep = ~single
            index = v_mine
            rows = np.concatenate([v_row[index], v_row[keep]])
            shards = np.concatenate([v_shard[index], v_shard[keep]]).astype(np.int32)
            a = np.concatenate([v_part[index], step[keep]])
            c = np.concatenate([step[index], v_part[keep]])
            # 0: row of the shard, 1: visitor, 2: both (the one task of a small shard)
            role = np.concatenate([np.where(n[take][index] == 1, 2, 0), np.ones(int(keep.sum()), dtype=np.int64)]).astype(np.int8)
            task = a * splits[shards] + c
            yield pa.RecordBatch.from_arrays([pa.array(shards), pa.array(task.astype(np.int32)), pa.array(role), pa.array(ids[rows]), cells.take(pa.array(rows))], names=["shard", "task", "role", "id", "v"])

    routed = ranked.select("id", "v").mapInArrow(route, "shard int, task int, role tinyint, id bigint, v binary")

    def search(table: pa.Table) -> pa.Table:
        role, ids = np.asarray(table.column("role")), np.asarray(table.column("id"))
        units = unpack(table.column("v").combine_chunks(), dimension)
        rows, visiting = role != 1, role != 0
        found = search_shard(ids[rows], units[rows], ids[visiting], units[visiting], k, min_cosine, factor) if rows.any() and visiting.any() else None
        a, b, c = found or (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        return pa.table({"id": pa.array(a), "neighbour": pa.array(b), "cosine": pa.array(c)})

    pairs = routed.groupBy("shard", "task").applyInArrow(search, "id bigint, neighbour bigint, cosine double")
    # both directions may bring a pair; its products differ in the last bits only
    found = pairs.groupBy("id", "neighbour").agg(F.max("cosine").alias("cosine"))

    # Members of a class beyond the indexed ones. Counting classes moves one hash a row; most data have none so large.
    large = one.groupBy("v").agg(F.count("*").alias("n")).where(F.col("n") > k + 1)
    if _has_large_class(packed, k):
        few = ranked.join(large.select("v"), "v", "left_semi").groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("lowest"))
        rest = one.join(few, "v").where(~F.array_contains("lowest", F.col("id")))
        found = found.unionByName(rest.select("id", F.explode(F.slice("lowest", 1, k)).alias("neighbour"), F.lit(1.0).alias("cosine")))
    order = Window.partitionBy("id").orderBy(F.col("cosine").desc(), "neighbour")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _has_large_class(packed: DataFrame, k: int) -> bool:
    """Whether more than k + 1 rows share a vector, told by hashes (a collision only costs the exact pass)."""
    return bool(packed.groupBy(F.xxhash64("v").alias("h")).agg(F.count("*").alias("n")).where(F.col("n") > k + 1).limit(1).count())


def neighbour_pairs(neighbours: DataFrame) -> DataFrame:
    """Unordered pairs of which one is a neighbour of the other."""
    return neighbours.select(F.least("id", "neighbour").alias("entry_a"), F.greatest("id", "neighbour").alias("entry_b")).distinct()
