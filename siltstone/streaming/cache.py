"""Streaming forms of the keyed state and of the decision pipeline."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.config import ProxyConfig
from siltstone.operators.requests import decide
from siltstone.operators.state import END_SLOT, FIRST_SLOT


def cache_stream(events: DataFrame, key: str, ts: str, ttl_seconds: int, late: str = "5 minutes") -> DataFrame:
    """ST-01 over a stream: (key, ts, hit).  The state of a key is the time of its last fetch; a hit doesn't extend it.

    Rows of one micro-batch are taken in time order.  A row older than the last fetch counts as a hit, since its fetch is known; a row older than the
    watermark, `late` behind the newest row, is dropped.  A key's state ends once the watermark passes its entry's end, so only keys of the last
    ttl and lateness are held.
    """
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    ttl = ttl_seconds * 1_000_000

    def run(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        fetched = state.get[0] if state.exists else None
        at = pd.concat([p["ts"] for p in parts]).sort_values()
        hits = []
        for t in (at.astype("datetime64[us]").astype("int64")).tolist():
            hit = fetched is not None and t - fetched < ttl
            fetched = fetched if hit else t
            hits.append(hit)
        state.update((fetched,))
        state.setTimeoutTimestamp(max((fetched + ttl) // 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"key": k[0], "ts": at.to_numpy(), "hit": hits})

    rows = events.select(F.col(key).cast("string").alias("key"), F.col(ts).cast("timestamp").alias("ts")).where("ts IS NOT NULL").withWatermark("ts", late)
    return rows.groupBy("key").applyInPandasWithState(run, "key string, ts timestamp, hit boolean", "fetched long", "append", GroupStateTimeout.EventTimeTimeout)


def allocator_stream(log: DataFrame, pool: str, order: str, action: str, slot: str, quota: int, first: int = FIRST_SLOT, end: int = END_SLOT) -> DataFrame:
    """ST-03..05 over a stream: (pool, order, action, slot, result, allocated), as operators.state.allocator_replay in the order of each micro-batch.

    The state of a pool is its held slots, at most end - first of them; it stays, since a held slot has no end of its own.
    """
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def run(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = set(state.get[0]) if state.exists else set()
        free = sorted(set(range(first, end)) - held)
        rows = pd.concat(list(parts)).sort_values("at", kind="stable")
        results, given = [], []
        for a, x in zip(rows["action"].tolist(), rows["slot"].tolist(), strict=True):
            got, result = None, "released"
            if a == "acquire":
                result = "quota" if len(held) >= quota else "ok" if free else "exhausted"
                if result == "ok":
                    got = heapq.heappop(free)
                    held.add(got)
            elif x in held:
                held.remove(x)
                heapq.heappush(free, int(x))
            results.append(result)
            given.append(got)
        state.update((sorted(int(s) for s in held),))
        yield pd.DataFrame({"pool": k[0], "at": rows["at"].to_numpy(), "action": rows["action"].to_numpy(), "slot": rows["slot"].astype("Int32"), "result": results, "allocated": pd.array(given, "Int32")})

    rows = log.select(F.col(pool).cast("string").alias("pool"), F.col(order).cast("long").alias("at"), F.col(action).alias("action"), F.col(slot).cast("int").alias("slot"))
    return rows.groupBy("pool").applyInPandasWithState(run, "pool string, at long, action string, slot int, result string, allocated int", "held array<int>", "append", GroupStateTimeout.NoTimeout)


def decide_stream(requests: DataFrame, config: ProxyConfig) -> DataFrame:
    """The decision pipeline is stateless, so it runs on a stream as it is."""
    return decide(requests, config)


def errors_per_window(decided: DataFrame, ts: str = "ts", width: str = "1 minute", late: str = "5 minutes") -> DataFrame:
    """Extension: statuses per tumbling window, with late rows up to the watermark."""
    return decided.withWatermark(ts, late).groupBy(F.window(ts, width).alias("w"), "status").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "status", "n")
