"""Streams: positions, state changes, cached results and windows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import haversine_km


def moved(fixes: DataFrame, metres: float = 20.0, key: str = "user_id", ts: str = "ts") -> DataFrame:
    """Batch form: fixes at least ``metres`` from the fix before, and the first of each key."""
    w = Window.partitionBy(key).orderBy(ts, "event_id")
    m = haversine_km(F.lag("lat").over(w), F.lag("lon").over(w), F.col("lat"), F.col("lon")) * 1000
    return fixes.withColumn("metres", m).filter(F.col("metres").isNull() | (F.col("metres") >= metres))


def moved_stream(fixes: DataFrame, metres: float = 20.0) -> DataFrame:
    """Stream form of ``moved`` over (user_id, event_id, ts, lat, lon): the state is the last fix, kept or not."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        from math import asin, cos, radians, sin, sqrt

        last = state.get if state.exists else None
        out = []
        for row in pd.concat(list(batches)).sort_values(["ts", "event_id"]).itertuples():
            if last is None:
                out.append((key[0], row.event_id, row.lat, row.lon))
            else:
                a, b, c, d = map(radians, (last[0], last[1], row.lat, row.lon))
                h = sin((c - a) / 2) ** 2 + cos(a) * cos(c) * sin((d - b) / 2) ** 2
                if 2 * 6371000 * asin(sqrt(min(1.0, h))) >= metres:
                    out.append((key[0], row.event_id, row.lat, row.lon))
            last = (row.lat, row.lon)
        state.update(last)
        yield pd.DataFrame(out, columns=["user_id", "event_id", "lat", "lon"])

    return fixes.groupBy("user_id").applyInPandasWithState(step, "user_id long, event_id long, lat double, lon double", "lat double, lon double", "append", "NoTimeout")


def latest(changes: DataFrame, key: str, value: str, ts: str = "ts", tie: str = "event_id") -> DataFrame:
    """The last value of each key, in batch or as a stream in update mode."""
    return changes.groupBy(key).agg(F.max_by(value, F.struct(ts, tie)).alias(value), F.max(ts).alias(ts))


def cached(results: DataFrame, minutes: int = 30, ts: str = "ts") -> DataFrame:
    """Stream: the first result of each key within the time, later ones dropped."""
    return results.withWatermark(ts, f"{minutes} minutes").dropDuplicatesWithinWatermark(["key"])


def first_in_flight(requests: DataFrame, keys: list[str], ts: str = "ts", tie: str = "event_id") -> DataFrame:
    """Batch form of dropping equal requests: the first of each."""
    return requests.groupBy(*keys).agg(F.min_by(tie, F.struct(ts, tie)).alias(tie))


def tumbling(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and sums by event type and window; an extension, batch or stream."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Sessions of users; an extension, batch or stream."""
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count(F.lit(1)).alias("n"))
