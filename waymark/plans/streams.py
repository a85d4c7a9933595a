"""Queries of keyed state in its batch forms, and of the upsert sink; tests hold the streams to the same rows."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ..operators.graph import scratch_path
from ..streaming import sink, stateful
from . import adapters
from .catalog import _PLACE, query


@query("""WITH RECURSIVE loads AS (SELECT user_id, min(ts) AS ts, arg_min(event_id, (ts, event_id)) AS event_id FROM events GROUP BY 1
  UNION ALL SELECT l.user_id, min(e.ts), arg_min(e.event_id, (e.ts, e.event_id)) FROM loads l JOIN events e ON e.user_id = l.user_id AND e.ts > l.ts + INTERVAL 30 MINUTE GROUP BY l.user_id)
SELECT e.user_id, e.event_id, e.event_id <> l.event_id AS hit, l.event_id AS served FROM events e ASOF JOIN loads l ON e.user_id = l.user_id AND e.ts >= l.ts""")
def cache_served(spark, sf):
    e = adapters.read(spark, sf, "events").select(F.col("user_id").alias("key"), "event_id", "ts", F.col("event_id").cast("string").alias("value"))
    return stateful.cache_hits(e).select(F.col("key").alias("user_id"), "event_id", "hit", F.col("value").cast("long").alias("served"))


_MESSAGES = """SELECT (event_id // 3) % 5 AS key, event_id, ts, CASE WHEN event_id % 3 = 0 THEN 'request' ELSE 'answer' END AS kind, event_id // 15 - CASE WHEN event_id % 3 = 2 AND user_id % 2 = 0 THEN 1 ELSE 0 END AS request_id FROM events"""


@query(f"WITH m AS ({_MESSAGES}), l AS (SELECT *, max(CASE WHEN kind = 'request' THEN request_id END) OVER (PARTITION BY key ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS latest FROM m) SELECT key, event_id, request_id FROM l WHERE kind = 'answer' AND request_id = latest")
def timely_answers(spark, sf):
    number = F.expr("event_id div 3")
    late = F.when((F.col("event_id") % 3 == 2) & (F.col("user_id") % 2 == 0), 1).otherwise(0)
    m = adapters.read(spark, sf, "events").select((number % 5).alias("key"), "event_id", "ts", F.when(F.col("event_id") % 3 == 0, "request").otherwise("answer").alias("kind"), (F.expr("event_id div 15") - late).alias("request_id"), F.lit("").alias("value"))
    return stateful.timely(m).select("key", "event_id", "request_id")


_RULES = """h AS (SELECT DISTINCT opening_hours, lower(opening_hours) AS h FROM places WHERE opening_hours <> ''),
k AS (SELECT *, unnest(list_transform(string_split_regex(h, '[;,]'), lambda x: trim(x))) AS p FROM h),
m AS (SELECT *, regexp_extract(p, '([a-z]{2})(?:-([a-z]{2}))?\\s+(\\d{1,2}):(\\d{2})-(\\d{1,2}):(\\d{2})', ['a', 'b', 'c', 'd', 'e', 'f']) AS m, regexp_extract(p, '^(\\d{1,2}):(\\d{2})-(\\d{1,2}):(\\d{2})$', ['c', 'd', 'e', 'f']) AS t FROM k),
z AS (SELECT opening_hours, h, p, m.a AS a, list_position(['su', 'mo', 'tu', 'we', 'th', 'fr', 'sa'], m.a) - 1 AS d1, list_position(['su', 'mo', 'tu', 'we', 'th', 'fr', 'sa'], coalesce(nullif(m.b, ''), m.a)) - 1 AS d2,
  try_cast(coalesce(nullif(m.c, ''), t.c) AS INT) * 60 + try_cast(coalesce(nullif(m.d, ''), t.d) AS INT) AS s, try_cast(coalesce(nullif(m.e, ''), t.e) AS INT) * 60 + try_cast(coalesce(nullif(m.f, ''), t.f) AS INT) AS e FROM m),
week AS (SELECT i, i // 1440 AS d, i % 1440 AS mi FROM range(10080) r(i)),
o AS (SELECT opening_hours, i, bool_or(contains(h, '24/7') OR (NOT contains(p, 'off') AND s IS NOT NULL AND (a = '' OR CASE WHEN d1 <= d2 THEN d BETWEEN d1 AND d2 ELSE d >= d1 OR d <= d2 END)
  AND CASE WHEN s <= e THEN mi BETWEEN s AND e ELSE mi >= s OR mi <= e END)) AS op FROM z, week GROUP BY opening_hours, i),
f AS (SELECT a.opening_hours, a.i, a.op FROM o a JOIN o b ON a.opening_hours = b.opening_hours AND b.i = (a.i + 10079) % 10080 WHERE a.op <> b.op)"""


@query(f"WITH {_PLACE}, {_RULES} SELECT id, TIMESTAMP '2023-12-31 00:00:00' + to_minutes(i::BIGINT + CASE WHEN i < 1440 THEN 10080 ELSE 0 END) AS at, op AS open FROM places JOIN f USING (opening_hours)")
def opening_changes(spark, sf):
    """When each place opens and closes in the week from Monday, 1 January 2024."""
    week = [F.lit(dt.datetime(2024, 1, day)) for day in (1, 8)]
    return stateful.status_changes(adapters.places(spark, sf), *week)


@query("SELECT 'part-' || user_id::VARCHAR AS place_id, arg_max(event_id % 6, (ts, event_id))::BIGINT AS rating FROM events GROUP BY user_id HAVING arg_max(event_id % 6, (ts, event_id)) > 0")
def state_upserts(spark, sf):
    """Ratings by a log of changes, of which a rating of 0 removes: three batches, out of order and one of them twice."""
    changes = adapters.read(spark, sf, "events").select(
        F.concat(F.lit("part-"), F.col("user_id").cast("string")).alias("place_id"), (F.col("event_id") % 6).alias("rating"), "ts", "event_id", (F.col("event_id") % 6 == 0).alias("deleted")
    )
    table = sink.VersionedTable(spark, scratch_path(spark), "place_id string, rating bigint, ts timestamp, event_id bigint", "place_id", ["ts", "event_id"])
    hour = F.hour("ts")
    for number, batch in enumerate((hour >= 16, hour < 8, (hour >= 8) & (hour < 16))):
        table.upsert(changes.filter(batch), number)
    table.upsert(changes.filter(hour < 8), 1)
    return table.read().select("place_id", "rating")
