"""Keyed state with timers: a time-limited cache, the guard against late answers, and open hours that flip by the clock.

Each has a stream form, whose state and timers are Spark's, and a batch form with the same rows.  Streams need
the RocksDB state store (``state_store``).  Rows of one key and one batch are taken by time, then event id.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from itertools import groupby

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from ..functions.decisions import is_open
from ..functions.text import once
from ..operators.graph import materialised

MINUTE, WEEK = 60_000_000, 7 * 24 * 60  # in microseconds; in minutes
#: The first day of the epoch, a Thursday, counted from Sunday.
EPOCH_DAY = 4


def state_store(spark: SparkSession) -> None:
    """Choose the state store that the streams below need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def _ordered(rows: Iterator[pd.DataFrame]) -> pd.DataFrame:
    return pd.concat(list(rows)).sort_values(["us", "event_id"])


# --- time-limited cache -------------------------------------------------------------------------------------


def _serve(entry: tuple | None, requests: Iterator[tuple], ttl: int) -> Iterator[tuple]:
    """(event_id, us, hit, value, loaded us) of each request (us, event_id, value); an entry older than ``ttl`` is loaded anew."""
    for us, event, value in requests:
        hit = entry is not None and us - entry[1] <= ttl
        if not hit:
            entry = value, us
        yield event, us, hit, *entry


_SERVED = ["event_id", "us", "hit", "value", "loaded_us"]


class _Cache(StatefulProcessor):
    def __init__(self, ttl: int, key: str):
        self.ttl, self.key = ttl, key

    def init(self, handle) -> None:  # noqa: ANN001
        self.handle, self.entry = handle, handle.getValueState("entry", "value string, us bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        entry = self.entry.get() if self.entry.exists() else None
        got = _ordered(rows)
        out = list(_serve(entry, zip(got["us"].tolist(), got["event_id"].tolist(), got["value"].tolist(), strict=True), self.ttl))
        value, loaded = out[-1][3:]
        if entry is None or loaded != entry[1]:
            if entry is not None:
                self.handle.deleteTimer(self._expiry(entry[1]))
            self.entry.update((value, loaded))
            self.handle.registerTimer(self._expiry(loaded))
        yield pd.DataFrame([(key[0], *r) for r in out], columns=[self.key, *_SERVED])

    def _expiry(self, loaded: int) -> int:
        return (loaded + self.ttl) // 1000 + 1  # the first millisecond that is too late

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        if self.entry.exists() and self._expiry(self.entry.get()[1]) <= expiredTimerInfo.getExpiryTimeInMs():
            self.entry.clear()
        yield pd.DataFrame({})

    def close(self) -> None:
        pass


def _served(df: DataFrame, key: str) -> DataFrame:
    return df.select(key, "event_id", F.timestamp_micros("us").alias("ts"), "hit", "value", F.timestamp_micros("loaded_us").alias("loaded_at"))


def _requests(requests: DataFrame, key: str, ts: str) -> DataFrame:
    return requests.select(F.col(key), "event_id", F.unix_micros(F.col(ts).cast("timestamp")).alias("us"), F.col("value").cast("string").alias("value"), F.col(ts).alias("ts"))


def cache_stream(requests: DataFrame, minutes: int = 30, key: str = "key", ts: str = "ts", late: str = "10 minutes") -> DataFrame:
    """Each request (key, event_id, ts, value) with what a cache serves: hit, value and loaded_at.

    ``value`` of a request is what a load would give then; the cache serves the value that was loaded
    last, if that is no more than ``minutes`` ago, and loads anew otherwise.  A timer frees expired entries.
    """
    state_store(requests.sparkSession)
    rows = _requests(requests.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late), key, ts)
    kind = rows.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, event_id bigint, us bigint, hit boolean, value string, loaded_us bigint"
    return _served(rows.groupBy(key).transformWithStateInPandas(_Cache(minutes * MINUTE, key), schema, "append", "eventTime"), key)


def cache_hits(requests: DataFrame, minutes: int = 30, key: str = "key", ts: str = "ts") -> DataFrame:
    """Batch form of ``cache_stream``.  A task reads the requests of a key in order and holds one entry at a time."""
    rows = _requests(requests, key, ts).drop("ts")
    kind = rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entry, last = None, ()
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in (key, "us", "event_id", "value")]
            out = []
            for k, own in groupby(zip(*columns, strict=True), lambda r: r[0]):
                entry = entry if (k,) == last else None
                last = (k,)
                for r in _serve(entry, (x[1:] for x in own), minutes * MINUTE):
                    out.append(r)
                    entry = r[3:]
            found = [pa.array([r[i] for r in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.bool_(), pa.string(), pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(key), *found], [key, *_SERVED])

    dealt = rows.repartition(key).sortWithinPartitions(key, "us", "event_id")
    return _served(dealt.mapInArrow(run, f"`{key}` {kind}, event_id bigint, us bigint, hit boolean, value string, loaded_us bigint"), key)


# --- late answers ---------------------------------------------------------------------------------------------


class _Guard(StatefulProcessor):
    def __init__(self, key: str):
        self.key = key

    def init(self, handle) -> None:  # noqa: ANN001
        self.latest = handle.getValueState("latest", "request bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        latest, out = self.latest.get()[0] if self.latest.exists() else None, []
        for r in _ordered(rows).itertuples():
            if r.kind == "request":
                latest = r.request_id if latest is None else max(latest, r.request_id)
            elif r.request_id == latest:
                out.append((key[0], r.event_id, r.request_id, r.value))
        if latest is not None:
            self.latest.update((int(latest),))
        yield pd.DataFrame(out, columns=[self.key, "event_id", "request_id", "value"])

    def close(self) -> None:
        pass


def timely_stream(messages: DataFrame, key: str = "key", ts: str = "ts") -> DataFrame:
    """The answers that are of the latest request of their key when they come; those of earlier requests are refused.

    ``messages``: key, event_id, ts, kind (request or answer), request_id, value.
    """
    state_store(messages.sparkSession)
    rows = messages.select(F.col(key), "event_id", F.unix_micros(F.col(ts).cast("timestamp")).alias("us"), "kind", F.col("request_id").cast("long").alias("request_id"), F.col("value").cast("string").alias("value"))
    kind = rows.schema[key].dataType.simpleString()
    return rows.groupBy(key).transformWithStateInPandas(_Guard(key), f"`{key}` {kind}, event_id bigint, request_id bigint, value string", "append", "none")


def timely(messages: DataFrame, key: str = "key", ts: str = "ts") -> DataFrame:
    """Batch form of ``timely_stream``."""
    so_far = Window.partitionBy(key).orderBy(ts, "event_id").rowsBetween(Window.unboundedPreceding, 0)
    latest = F.max(F.when(F.col("kind") == "request", F.col("request_id").cast("long"))).over(so_far)
    rows = messages.select(F.col(key), "event_id", "kind", F.col("request_id").cast("long").alias("request_id"), F.col("value").cast("string").alias("value"), latest.alias("latest"))
    return rows.filter("kind = 'answer' and request_id = latest").drop("kind", "latest")


# --- open hours by the clock ---------------------------------------------------------------------------------


def schedule(hours: Column) -> Column:
    """The minutes of a week (from Sunday) at which open hours may change, each with what then holds; null without hours."""
    clock = F.transform(F.regexp_extract_all(hours, F.lit(r"\d{1,2}:\d{2}"), F.lit(0)), lambda t: F.element_at(F.split(t, ":"), 1).cast("int") * 60 + F.element_at(F.split(t, ":"), 2).cast("int"))
    edges = F.filter(F.array_sort(F.array_distinct(F.concat(F.array(F.lit(0)), clock, F.transform(clock, lambda m: m + 1)))), lambda m: m < 24 * 60)
    day = lambda d: F.transform(edges, lambda m: F.struct((d * 24 * 60 + m).alias("minute"), is_open(hours, d, m).alias("open")))
    return F.when(hours.isNotNull() & (hours != ""), F.flatten(F.transform(F.sequence(F.lit(0), F.lit(6)), day)))


def flips(hours: Column) -> Column:
    """The minutes of a week at which a place opens or closes, in order; empty if it never does."""
    before = lambda week, i: F.get(week, F.pmod(i - 1, F.size(week)))["open"]
    changed = lambda week: F.filter(week, lambda s, i: s["open"] != before(week, i))
    found = F.get(F.transform(F.array(schedule(hours)), changed), F.lit(0))
    return F.coalesce(found, F.array().cast("array<struct<minute:int,open:boolean>>"))


def status_changes(places: DataFrame, begin: Column, end: Column, id_: str = "id", hours: str = "opening_hours") -> DataFrame:
    """Batch form of ``status_stream``: when each place opens and closes from ``begin`` up to ``end`` (id, at, open)."""
    first = F.floor((F.unix_micros(begin) / MINUTE + EPOCH_DAY * 1440) / WEEK) * WEEK - EPOCH_DAY * 1440  # Sunday before, in minutes
    weeks = F.sequence(first, F.floor(F.unix_micros(end) / MINUTE), F.lit(WEEK).cast("long"))
    # texts of hours are few and their weeks long to make: once a text; the table is written, so that it is broadcast only if it is small
    texts = materialised(once(places.select(F.col(hours).alias("_hours")).distinct(), _flips=flips(F.col("_hours"))).filter(F.size("_flips") > 0))
    known = places.select(F.col(id_), F.col(hours).alias("_asked")).join(texts, F.col("_asked") == F.col("_hours"))
    each = known.select(F.col(id_), F.explode("_flips").alias("f")).select(id_, "f.open", F.col("f.minute").alias("minute"), F.explode(weeks).alias("week"))
    at = F.timestamp_micros((F.col("week") + F.col("minute")) * MINUTE)
    return each.select(id_, at.alias("at"), "open").filter((F.col("at") >= begin) & (F.col("at") < end))


class _Clock(StatefulProcessor):
    def __init__(self, key: str, wall: bool):
        self.key, self.wall = key, wall

    def init(self, handle) -> None:  # noqa: ANN001
        self.handle, self.place = handle, handle.getValueState("place", "minutes array<int>, opens array<boolean>, open boolean, next bigint")

    def _emit(self, key, minutes: list[int], opens: list[bool], was: bool | None, begin: int, now: int) -> pd.DataFrame:  # noqa: ANN001
        """Status at ``begin`` (in minutes), and each flip from then up to ``now``, if they differ from what was said last."""
        at, out = begin, []
        while minutes and at <= now:
            of_week = (at + EPOCH_DAY * 1440) % WEEK
            i = bisect_right(minutes, of_week) - 1
            if opens[i] != was:
                was = opens[i]
                out.append((key[0], at * MINUTE, was))
            at += (minutes[i + 1] if i + 1 < len(minutes) else WEEK) - of_week
        if minutes:
            self.place.update((minutes, opens, was, at))
            if any(o != opens[0] for o in opens):
                self.handle.registerTimer(at * MINUTE // 1000)
        return pd.DataFrame(out, columns=[self.key, "at_us", "open"])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        was = None
        if self.place.exists():
            _, _, was, next_ = self.place.get()
            self.handle.deleteTimer(int(next_) * MINUTE // 1000)
        last = _ordered(rows).iloc[-1]
        week = [] if last["week"] is None else list(last["week"])
        now = timerValues.getCurrentProcessingTimeInMs() * 1000 if self.wall else int(last["us"])
        yield self._emit(key, [int(s["minute"]) for s in week], [bool(s["open"]) for s in week], was, now // MINUTE, now // MINUTE)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        minutes, opens, was, next_ = self.place.get()
        now = timerValues.getCurrentProcessingTimeInMs() if self.wall else timerValues.getCurrentWatermarkInMs()
        yield self._emit(key, list(minutes), list(opens), was, int(next_), now * 1000 // MINUTE)

    def close(self) -> None:
        pass


def status_stream(places: DataFrame, wall: bool = True, id_: str = "id", hours: str = "opening_hours", ts: str = "ts", late: str = "0 seconds") -> DataFrame:
    """Whether a place is open, said when it comes, and again each time that the clock opens or closes it (id, at, open).

    The clock is the machine's, or with ``wall`` false the watermark of ``ts``, which rows of any id move on.
    """
    state_store(places.sparkSession)
    rows = (places if wall else places.withWatermark(ts, late)).select(F.col(id_), "event_id", F.unix_micros(F.col(ts).cast("timestamp")).alias("us"), schedule(F.col(hours)).alias("week"), F.col(ts).alias("ts"))
    kind = rows.schema[id_].dataType.simpleString()
    out = rows.groupBy(id_).transformWithStateInPandas(_Clock(id_, wall), f"`{id_}` {kind}, at_us bigint, open boolean", "append", "processingTime" if wall else "eventTime")
    return out.select(id_, F.timestamp_micros("at_us").alias("at"), "open")
