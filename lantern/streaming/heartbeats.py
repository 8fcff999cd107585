"""Liveness by heartbeats: services that have not been heard of for longer than a timeout."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def expired(beats: DataFrame, key: str, stamp: str, timeout: str) -> DataFrame:
    """(key, last_seen): in a finished table, keys whose last beat is more than `timeout` before the last of all."""
    last = beats.groupBy(key).agg(F.max(stamp).alias("last_seen"))
    now = last.agg(F.max("last_seen").alias("now"))
    # One row against the keys: the latest stamp of all.
    return last.join(F.broadcast(now)).where(F.col("last_seen") < F.expr(f"now - interval {timeout}")).select(key, "last_seen")


def watch(beats: DataFrame, key: str, stamp: str, seconds: int, late: str = "10 seconds") -> DataFrame:
    """(key, last_seen) of each key once the watermark has passed its last beat by `seconds`; beats is a stream.

    The state of a key is its last beat. A key heard of again after it expired starts anew.
    """
    kind = dict(beats.dtypes)[key]

    def step(k: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            (last,) = state.get
            state.remove()
            yield pd.DataFrame({key: [k[0]], "last_seen": [pd.Timestamp(last, unit="us")]})
            return
        last = state.get[0] if state.exists else 0
        for d in rows:
            last = max(last, int(d[stamp].max().value // 1000))
        state.update((last,))
        state.setTimeoutTimestamp(max(last // 1000 + seconds * 1000, state.getCurrentWatermarkMs() + 1))

    source = beats.select(key, F.col(stamp).cast("timestamp").alias(stamp)).withWatermark(stamp, late)
    return source.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, last_seen timestamp", "last long", "append", GroupStateTimeout.EventTimeTimeout)
