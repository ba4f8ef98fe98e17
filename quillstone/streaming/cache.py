"""The answer cache: lookups by key against unexpired entries, least-recently-used cut, and a stateful stream with time to live."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

TTL_SECONDS, MAX_ENTRIES = 3600, 1000


def probe(requests: DataFrame, cache: DataFrame, now: Column) -> DataFrame:
    """requests (key, ...) with the cached answer and hit; entries expire a time to live after they were set."""
    live = cache.filter(F.col("set_at") + F.expr(f"interval {TTL_SECONDS} seconds") > now).select("key", "answer")
    return requests.join(live, "key", "left").withColumn("hit", F.col("answer").isNotNull())


def evict(cache: DataFrame, most: int = MAX_ENTRIES) -> DataFrame:
    """The most recently used entries."""
    return cache.orderBy(F.col("used_at").desc(), "key").limit(most)


def lru(accesses: DataFrame, most: int = MAX_ENTRIES) -> DataFrame:
    """(key, used_at, place) of the entries that a cache holds after these accesses (key, ts)."""
    last = accesses.groupBy("key").agg(F.max("ts").alias("used_at"))
    return evict(last, most).withColumn("place", F.row_number().over(Window.orderBy(F.col("used_at").desc(), "key")))


def cached_stream(requests: DataFrame, ttl_seconds: int = TTL_SECONDS, lateness: str = "1 hour") -> DataFrame:
    """(key, ts, hit) of a stream of requests (key, ts): a hit if the key was set within the time to live before, by the requests' own times.

    Each key keeps one timestamp; requests that miss set it, and it goes when the watermark passes its time to live.
    """

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        set_at = state.get[0] if state.exists else None
        rows = []
        for ts in sorted(t for f in frames for t in f["ts"]):
            now = ts.timestamp()
            hit = set_at is not None and now < set_at + ttl_seconds
            set_at = set_at if hit else now
            rows.append((key[0], ts, hit))
        state.update((set_at,))
        mark = state.getCurrentWatermarkMs()
        state.setTimeoutTimestamp(max(int((set_at + ttl_seconds) * 1000), mark + 1))
        yield pd.DataFrame(rows, columns=["key", "ts", "hit"])

    return requests.withWatermark("ts", lateness).groupBy("key").applyInPandasWithState(run, "key string, ts timestamp, hit boolean", "set_at double", "append", GroupStateTimeout.EventTimeTimeout)
