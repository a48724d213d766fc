"""Replays of keyed state: a cache whose entries expire after their fetch, and an allocator of the lowest free slot.

Both are sequential by nature within a key.  Rows are dealt by key, sorted within partitions (an external sort) and streamed through in batches with a
state of constant size, so a key with very many rows costs time in its task but no memory.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FIRST_SLOT, END_SLOT = 8000, 9000


def _streamed(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    return df.repartition(key).sortWithinPartitions(key, *order)


def cache_replay(events: DataFrame, key: str, ts: str, ttl_seconds: int, event_id: str) -> DataFrame:
    """ST-01: (key, event_id, hit).  A look-up is a hit if the last fetch is less than ttl old; a hit doesn't extend it.  Null keys share an entry."""
    ttl = ttl_seconds * 1_000_000
    rows = events.where(F.col(ts).isNotNull()).select(F.col(key).cast("string").alias("key"), F.col(event_id).cast("long").alias("event_id"), F.unix_micros(F.col(ts).cast("timestamp")).alias("at"))

    def run(batches):
        known, fetched = None, None
        for batch in batches:
            keys, at = batch.column("key").to_pylist(), batch.column("at").to_numpy()
            hit = np.ones(len(at), bool)
            s = 0
            while s < len(at):
                e = s + 1
                while e < len(at) and keys[e] == keys[s]:
                    e += 1
                if known != (keys[s],):
                    known, fetched = (keys[s],), None
                k = s if fetched is None else s + int(np.searchsorted(at[s:e], fetched + ttl))
                while k < e:
                    hit[k], fetched = False, int(at[k])
                    k = s + int(np.searchsorted(at[s:e], fetched + ttl))
                s = e
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("event_id"), pa.array(hit)], ["key", "event_id", "hit"])

    return _streamed(rows, "key", ["at", "event_id"]).mapInArrow(run, "key string, event_id long, hit boolean")


def allocator_replay(log: DataFrame, pool: str, order: list[str], action: str, slot: str, quota: int, first: int = FIRST_SLOT, end: int = END_SLOT) -> DataFrame:
    """ST-03..05: adds result ("ok", "quota", "exhausted" or "released") and the allocated slot.

    action "acquire" takes the lowest free slot if fewer than quota are held; "release" frees the slot of its row, if held.
    """
    columns = list(log.columns)
    rows = log.withColumn("__pool", F.col(pool).cast("string"))

    def run(batches):
        known, held, free = None, set(), []
        for batch in batches:
            pools, actions, slots = (batch.column(c).to_pylist() for c in ("__pool", action, slot))
            results, given = [], []
            for p, a, x in zip(pools, actions, slots, strict=True):
                if known != (p,):
                    known, held, free = (p,), set(), list(range(first, end))
                got, result = None, "released"
                if a == "acquire":
                    if len(held) >= quota:
                        result = "quota"
                    elif not free:
                        result = "exhausted"
                    else:
                        got, result = heapq.heappop(free), "ok"
                        held.add(got)
                elif x in held:
                    held.remove(x)
                    heapq.heappush(free, x)
                results.append(result)
                given.append(got)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(results, pa.string()), pa.array(given, pa.int32())], [*columns, "result", "allocated"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in log.schema.fields) + ", result string, allocated int"
    return _streamed(rows, "__pool", order).mapInArrow(run, schema)
