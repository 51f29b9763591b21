"""Stateful operators: the same reducers in batch, over sorted partitions, and in Structured Streaming."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

Step = Callable[[dict[str, Any] | None, dict[str, Any]], dict[str, Any]]


def credibility(state: dict | None, event: dict) -> dict:
    """Additive for the first ten signals, then an exponential mean; the first is taken as it is; rounded, 0 to 100."""
    signal = float(event["signal"])
    if state is None:
        return {"score": max(0.0, min(100.0, signal)), "signals": 1}
    score = state["score"] + signal if state["signals"] < 10 else 0.95 * state["score"] + 0.05 * signal
    return {"score": max(0.0, min(100.0, float(int(score + 0.5) if score >= 0 else 0))), "signals": state["signals"] + 1}


def memory(state: dict | None, event: dict) -> dict:
    """Running mean, rounded to two digits (halves up) at each step."""
    used, mean = (state["used"], state["mean"]) if state else (0, 0.0)
    return {"used": used + 1, "mean": math.floor((mean * used + float(event["score"])) / (used + 1) * 100 + 0.5) / 100}


def tagged_memory(state: dict | None, event: dict) -> dict:
    """The running mean, and the tags of all events in the order in which they were first seen."""
    tags = list(state["tags"]) if state else []
    tags += [t for t in dict.fromkeys(event["tags"] if event["tags"] is not None else []) if t not in tags]
    return {**memory(state, event), "tags": tags}


#: How long a result is kept and a subscription lives, in milliseconds.
RESULT_TTL_MS, WATCH_TTL_MS = 300_000, 30 * 86_400_000


def result_cache(state: dict | None, event: dict) -> dict:
    """Requests of one key: a result answers those that come within its life; reading doesn't prolong it."""
    made, hits, misses = (state["made_ms"], state["hits"], state["misses"]) if state else (None, 0, 0)
    now = int(event["at_ms"])
    if made is not None and now - made < RESULT_TTL_MS:
        return {"made_ms": made, "hits": hits + 1, "misses": misses}
    return {"made_ms": now, "hits": hits, "misses": misses + 1}


def circuit(state: dict | None, event: dict) -> dict:
    """Closed, open, half-open: three failures open it for 30 s, doubled for each further one up to 300 s."""
    failures, opened, wait, blocked = (state["failures"], state["opened_ms"], state["wait_ms"], state["blocked"]) if state else (0, 0, 0, 0)
    now = int(event["at_ms"])
    if failures >= 3 and now <= opened + wait:
        return {"failures": failures, "opened_ms": opened, "wait_ms": wait, "blocked": blocked + 1}
    if not event["failed"]:
        return {"failures": 0, "opened_ms": 0, "wait_ms": 0, "blocked": blocked}
    failures += 1
    return {"failures": failures, "opened_ms": now if failures >= 3 else 0, "wait_ms": min(30_000 * 2 ** (failures - 3), 300_000) if failures >= 3 else 0, "blocked": blocked}


def fold(events: DataFrame, *, key: str, order: list[str], step: Step, state_schema: T.StructType) -> DataFrame:
    """The last state of each key. Rows are sorted within partitions and pass one by one: a key of any size needs one state."""
    schema = T.StructType([events.schema[key], *state_schema.fields])
    names = [f.name for f in schema.fields]
    columns = events.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state, started = None, None, False
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False, name=None):
                event = dict(zip(columns, row))
                if not started or event[key] != current:
                    if started:
                        out.append((current, *[state[n] for n in names[1:]]))
                    current, state, started = event[key], None, True
                state = step(state, event)
            yield pd.DataFrame(out, columns=names)
        if started:
            yield pd.DataFrame([(current, *[state[n] for n in names[1:]])], columns=names)

    return events.where(F.col(key).isNotNull()).repartition(key).sortWithinPartitions(key, *order).mapInPandas(run, schema)


def stream_fold(events: DataFrame, *, key: str, order: list[str], step: Step, state_schema: T.StructType) -> DataFrame:
    """The same over a stream, in update mode: the state of each key that a micro-batch touched."""
    schema = T.StructType([events.schema[key], *state_schema.fields])
    names = [f.name for f in state_schema.fields]

    def update(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = dict(zip(names, state.get)) if state.exists else None
        pdf = pd.concat(list(batches)).sort_values(order)
        for row in pdf.to_dict("records"):
            now = step(now, row)
        state.update(tuple(now[n] for n in names))
        yield pd.DataFrame([(k[0], *[now[n] for n in names])], columns=[f.name for f in schema.fields])

    return events.groupBy(key).applyInPandasWithState(update, schema, state_schema, "update", GroupStateTimeout.NoTimeout)


def watch_stream(results: DataFrame, *, key: str = "subscription", ttl_ms: int = WATCH_TTL_MS) -> DataFrame:
    """Alerts of a stream of scored results (subscription, threshold, url, score, published): those that are newer than the last check of their
    subscription and reach its threshold. Each micro-batch is a check and moves the mark, whether or not it gives an alert; a subscription
    that gets no results for its time to live is forgotten."""
    schema = T.StructType([results.schema[key], *[results.schema[c] for c in ("url", "score", "published")]])

    def check(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get[0] if state.exists else 0
        for pdf in batches:
            ms = (pdf["published"] - pd.Timestamp(0)) // pd.Timedelta(milliseconds=1)
            yield pdf[pdf["published"].notna() & (ms > last) & (pdf["score"] >= pdf["threshold"])][[f.name for f in schema.fields]]
        state.update((state.getCurrentProcessingTimeMs(),))
        state.setTimeoutDuration(ttl_ms)

    return results.groupBy(key).applyInPandasWithState(check, schema, "last_checked_ms bigint", "append", GroupStateTimeout.ProcessingTimeTimeout)


def fresh_requests(requests: DataFrame, *, keys: list[str], at: str = "ts", ttl: str = "5 minutes") -> DataFrame:
    """Of a stream of requests those that no earlier one within the time to live answers."""
    return requests.withWatermark(at, ttl).dropDuplicatesWithinWatermark(keys)


def rate_windows(events: DataFrame, *, key: str = "user_id", at: str = "ts", length: str = "1 minute", limit: int = 120, watermark: str | None = None) -> DataFrame:
    """(key, window_start, n, limited): tumbling windows; on a stream late rows are dropped beyond the watermark."""
    source = events.withWatermark(at, watermark) if watermark else events
    return source.groupBy(F.window(at, length).alias("w"), key).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("window_start"), "n", (F.col("n") > limit).alias("limited"))


def watch_alerts(results: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """Results that are newer than their subscription's low-water mark and reach its threshold.

    results (query, published, score, ...), subscriptions (query, threshold, last_checked).
    """
    return results.join(subscriptions, "query").where("published IS NOT NULL AND published > coalesce(last_checked, timestamp'1970-01-01') AND score >= threshold")
