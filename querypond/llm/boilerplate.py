"""Main bodies of pages: minimum-cut labelling of lines as content or furniture.

Every line with visible text is a node. A classifier gives its cost as content and as furniture (terminal capacities); edges
between neighbouring lines of one block, between a heading and what follows it, and between neighbours in one container or at one
depth of the DOM cost their weight where the labels differ. The minimum cut, found by maximum flow, is the cheapest labelling.

Classifier. Logistic regression over wording, links, role, place, container and repetition: on how many pages, and of how many
sites, a line recurs once the site's name and numbers are masked, counted over all pages. It is trained here on a bounded
sample (``sample_lines``) of lines that are certain: furniture by wording that recurs, content by long sentences or code that
don't. Everything else covers all lines.

Flow. Most nodes are settled beforehand: one whose own preference exceeds the sum of its edges has the same label in every
minimum cut. What is left is solved exactly by augmenting paths.

Scale. Pages are taken apart once (``page_table``). Lines move as hashes and features; repetition is counted by (line, site) and then by line, so a site with a third of all
pages is counted in parts; a page's lines meet again in one row. Repeated lines are joined by hash, the frequent side small.

Defined results: null and empty texts have no lines; rows with a null id are dropped, of rows with one id the latest counts;
pages of one line are labelled by the classifier alone; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from querypond.llm.page_table import BIT
from querypond.runtime import cut

#: Repetition from which a short line of several sites is furniture for certain: on 0.2 % of all pages.
FREQUENT = float(np.log1p(500 * 0.002))
#: Weights of the smoothness edges, in nats.
NEXT, SAME_LIST, AFTER_HEADING, CONTAINER = 0.35, 1.6, 1.4, 0.25


#: Columns of the features of a line.
COLUMNS = ("one", "words", "short", "sentence", "wording", "mention", "navigation", "linked", "inside", "outside", "h1", "h", "li", "code", "side", "below", "before", "place", "last", "bars", "number", "setting", "pages", "sites", "most")


def feature_matrix(bits: np.ndarray, **values: np.ndarray) -> np.ndarray:
    """One row a line, columns as in COLUMNS."""
    values = {"one": np.ones(len(bits)), **values, "words": values["words"] / 40}
    return np.stack([values[c] if c in values else (bits & BIT[c] > 0).astype(np.float64) for c in COLUMNS], axis=1).astype(np.float64)


def edges_of(bits: list[int], blocks: list[int], depths: list[int]) -> list[tuple[int, int, float]]:
    """Smoothness edges between lines of a page."""
    code, li, h, side, inside, related = (BIT[x] for x in ("code", "li", "h", "side", "inside", "related"))
    links = BIT["inside"] | BIT["outside"]
    out = []
    for i in range(1, len(bits)):
        a, b = bits[i - 1], bits[i]
        same = blocks[i - 1] == blocks[i]
        if a & b & code or a & b & li and a & links == b & links and (same or a & inside):
            out.append((i - 1, i, SAME_LIST))
        elif a & h and a & related and b & li and b & inside:
            out.append((i - 1, i, AFTER_HEADING))
        elif same:
            out.append((i - 1, i, NEXT))
        elif a & b & side or depths[i - 1] == depths[i] > 0:
            out.append((i - 1, i, CONTAINER))
    return out


def minimum_cut(furniture: list[float], content: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """True where a node is on the furniture side of the minimum cut. furniture / content: costs of the two labels."""
    n = len(furniture)
    gain = [c - f for f, c in zip(furniture, content)]  # positive: furniture is cheaper
    around: list[dict[int, float]] = [{} for _ in range(n)]
    for a, b, w in edges:
        if a != b and w > 0:
            around[a][b] = around[a].get(b, 0.0) + w
            around[b][a] = around[b].get(a, 0.0) + w
    label: list[bool | None] = [None] * n
    queue = deque(range(n))
    while queue:  # persistency: a node that outweighs its edges is settled, and pulls its neighbours
        i = queue.popleft()
        if label[i] is not None or abs(gain[i]) < sum(around[i].values()) and around[i]:
            continue
        label[i] = gain[i] > 0
        for j, w in around[i].items():
            gain[j] += w if label[i] else -w
            del around[j][i]
            if label[j] is None:
                queue.append(j)
        around[i] = {}
    rest = [i for i in range(n) if label[i] is None]
    if rest:
        number = {i: k for k, i in enumerate(rest)}
        for i, side in zip(rest, _max_flow([gain[i] for i in rest], [{number[j]: w for j, w in around[i].items()} for i in rest])):
            label[i] = side
    return [bool(x) for x in label]


def _max_flow(gain: list[float], around: list[dict[int, float]]) -> list[bool]:
    """Source side of the minimum cut: source to nodes with a positive gain, the others to the sink, by shortest paths."""
    n = len(gain)
    s, t = n, n + 1
    room: list[dict[int, float]] = [dict(a) for a in around] + [{}, {}]
    for i, g in enumerate(gain):
        a, b = (s, i) if g > 0 else (i, t)
        room[a][b] = room[a].get(b, 0.0) + abs(g)
        room[b].setdefault(a, 0.0)
    while True:
        come, queue = {s: s}, deque([s])
        while queue and t not in come:
            u = queue.popleft()
            for v, r in room[u].items():
                if r > 1e-12 and v not in come:
                    come[v] = u
                    queue.append(v)
        if t not in come:
            return [i in come for i in range(n)]
        path, v = [], t
        while v != s:
            path.append((come[v], v))
            v = come[v]
        least = min(room[u][v] for u, v in path)
        for u, v in path:
            room[u][v] -= least
            room[v][u] = room[v].get(u, 0.0) + least


def fit(x: np.ndarray, y: np.ndarray, steps: int = 400, rate: float = 0.5, ridge: float = 1e-3) -> np.ndarray:
    """Logistic regression by full gradient steps, classes weighted to equal parts; no draw, so the result is repeatable."""
    w = np.zeros(x.shape[1])
    weight = np.where(y > 0, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum()))
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w -= rate * 4 * (x.T @ (weight * (p - y)) + ridge * w)
    return w


def certain(features: np.ndarray) -> np.ndarray:
    """1: furniture for certain, 0: content for certain, nan: neither."""
    words, sentence, wording, nav, inside, outside, h1, head, code, setting, pages, sites = (features[:, COLUMNS.index(c)] for c in ("words", "sentence", "wording", "navigation", "inside", "outside", "h1", "h", "code", "setting", "pages", "sites"))
    plain = (wording == 0) & (nav == 0) & (inside == 0)
    out = np.full(len(features), np.nan)
    out[(wording > 0) | (nav > 0) | ((sites >= np.log(4)) & (pages >= FREQUENT) & (words <= 0.5) & (code == 0) & (h1 == 0) & (head == 0) & (setting == 0))] = 1
    out[(code > 0) | plain & ((sentence > 0) & (pages == 0) | (setting > 0) | (outside > 0) | (head > 0) | (h1 > 0))] = 0
    return out


def label_lines(lines: DataFrame, *, sample_lines: int = 20_000, seed: int = 3) -> DataFrame:
    """(html, id, line_no, furniture) of every line with visible text, from page_table.parsed."""
    lines = lines.where("line_no > 0")
    total = lines.groupBy("html", "id").agg(F.lit(1)).count()
    repeated = lines.where("first").groupBy("mask", "site").agg(F.count("*").alias("n")).groupBy("mask").agg(F.sum("n").alias("pages"), F.count("*").alias("sites"), F.max("n").alias("most"))
    counted = lines.join(repeated.where("pages > 1"), "mask", "left")
    # Repetition in proportion to all pages, so that it means the same in a collection of any size.
    share = lambda c: F.log1p(F.lit(500.0) * (F.coalesce(F.col(c), F.lit(1)) - 1) / F.lit(float(max(1, total))))
    sites = F.log(F.least(F.coalesce("sites", F.lit(1)), F.lit(16)).cast("double"))
    full = counted.select("html", "id", F.struct("line_no", "block", "depth", "bits", "words", "linked", "place", share("pages").cast("float").alias("pages"), sites.cast("float").alias("sites"), share("most").cast("float").alias("most")).alias("line"))
    full = cut(full.groupBy("html", "id").agg(F.array_sort(F.collect_list("line")).alias("lines")))

    # A bounded sample for the classifier: whole pages in the order of a hash until the lines suffice. All tasks together send some more.
    wanted = max(50, sample_lines // 40)
    place = F.pmod(F.xxhash64("html", "id", F.lit(seed)), F.lit(1 << 40))
    sent = full.where(place < F.lit(int((1 << 40) * min(1.0, (1.3 * wanted + 20) / max(1, total))))).select(place.alias("turn"), "html", "id", F.explode("lines").alias("line")).select("turn", "html", "id", "line.*").collect()
    taken = sorted(sent, key=lambda r: (r["turn"], r["html"], r["id"], r["line_no"]))[:sample_lines]
    if not taken:
        return lines.select("html", "id", "line_no", F.lit(False).alias("furniture"))
    measured = ("words", "linked", "place", "pages", "sites", "most")
    x = feature_matrix(np.array([r["bits"] for r in taken]), **{c: np.array([r[c] for r in taken], dtype=np.float64) for c in measured})
    y = certain(x)
    sure = ~np.isnan(y)
    w = fit(x[sure], y[sure]) if len(set(y[sure])) == 2 else None

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            column = batch.column("lines")
            sizes, flat = np.asarray(column.value_lengths(), dtype=np.int64), column.flatten()
            bits = np.asarray(flat.field("bits"))
            f = feature_matrix(bits, **{c: np.asarray(flat.field(c), dtype=np.float64) for c in measured})
            z = np.clip(f @ w, -12, 12) if w is not None else np.where(certain(f) == 1, 4.0, -4.0)
            content, furniture = np.logaddexp(0, z).tolist(), np.logaddexp(0, -z).tolist()
            marks, blocks, depths = bits.tolist(), flat.field("block").to_pylist(), flat.field("depth").to_pylist()
            out, at = [], 0
            for n in sizes:
                end = at + int(n)
                out.extend(minimum_cut(furniture[at:end], content[at:end], edges_of(marks[at:end], blocks[at:end], depths[at:end])))
                at = end
            take = pa.array(np.repeat(np.arange(len(sizes)), sizes))
            yield pa.RecordBatch.from_arrays([batch.column("html").take(take), batch.column("id").take(take), flat.field("line_no"), pa.array(out, pa.bool_())], names=["html", "id", "line_no", "furniture"])

    return full.mapInArrow(label, "html boolean, id bigint, line_no int, furniture boolean")


def main_bodies(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(html, id, body): the texts of pages in the common form without their furniture lines."""
    drop = labels.where("furniture").groupBy("html", "id").agg(F.collect_set(F.col("line_no") - 1).alias("drop"))
    joined = pages.where(F.length("text") > 0).join(drop, ["html", "id"], "left")
    kept = F.filter(F.split("text", "\n"), lambda _, i: F.coalesce(~F.array_contains("drop", i), F.lit(True)))
    return joined.select("html", "id", F.array_join(kept, "\n").alias("body"))
