"""An extension: the leakage check on a stream of arriving images.

A patient who has been seen in one partition and arrives in another is flagged at once, and
only once. State is a partition name per group; it ends when the watermark has passed the group's
last arrivals by ``ttl``.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState

FLAGS = "group_key string, first_partition string, partition string, image_id string"


def monitor(arrivals: DataFrame, ttl_seconds: int = 30 * 86400, late: str = "1 day") -> DataFrame:
    """Flags of a stream (group_key, partition, image_id, ts); arrivals more than ``late`` behind the newest are ignored."""

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        first, flagged = state.get if state.exists else (None, False)
        for rows in batches:
            for partition, image in rows.sort_values("image_id")[["partition", "image_id"]].itertuples(index=False):
                if first is None:
                    first = partition
                elif partition != first and not flagged:
                    flagged = True
                    yield pd.DataFrame([(key[0], first, partition, image)], columns=["group_key", "first_partition", "partition", "image_id"])
        state.update((first, flagged))
        state.setTimeoutTimestamp(state.getCurrentWatermarkMs() + ttl_seconds * 1000)

    rows = arrivals.withWatermark("ts", late).groupBy("group_key")
    return rows.applyInPandasWithState(update, FLAGS, "first string, flagged boolean", "append", "EventTimeTimeout")


def drift(events: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Calibration by event-time window over a stream (ts, p, y): (start, n, mean_p, rate)."""
    grouped = events.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"))
    return grouped.agg(F.count("*").alias("n"), F.avg("p").alias("mean_p"), F.avg(F.col("y").cast("double")).alias("rate")).select(F.col("w.start").alias("start"), "n", "mean_p", "rate")
