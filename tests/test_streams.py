import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from waymark.operators.graph import filesystem
from waymark.streaming import sink, stateful

START = dt.datetime(2024, 1, 1)


def at(minutes, micros=0):
    return START + dt.timedelta(minutes=minutes, microseconds=micros)


def fed(spark, tmp_path, batches, schema, stream):
    """The rows that a stream gives when the batches come one by one."""
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(f"{tmp_path}/in/*")
    name = f"fed_{random.randrange(10**9)}"
    q = stream(source).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", f"{tmp_path}/cp").start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    return spark.table(name).collect()


REQUESTS = "key string, event_id long, ts timestamp, value string"


def test_cache_serves_expires_and_loads_anew(spark, tmp_path):
    rows = [
        [("a", 1, at(0), "v1"), ("b", 2, at(1), "w1"), ("a", 3, at(29), "v2")],
        [("a", 4, at(30), "v3"), ("a", 5, at(30, 1), "v4"), ("b", 6, at(200), "w2")],
        [("a", 8, at(230), "v5"), ("b", 9, at(230), "w3")],
        [("a", 7, at(60), "late"), ("b", 10, at(231), "w4")],
    ]
    got = {r.event_id: (r.hit, r.value) for r in fed(spark, tmp_path, rows, REQUESTS, lambda s: stateful.cache_stream(s, late="5 minutes"))}
    assert got == {1: (False, "v1"), 2: (False, "w1"), 3: (True, "v1"), 4: (True, "v1"), 5: (False, "v4"), 6: (False, "w2"), 8: (False, "v5"), 9: (True, "w2"), 10: (False, "w4")}  # 7 came after the watermark


def test_cache_stream_equals_its_batch_form(spark, tmp_path):
    r, t, rows = random.Random(3), 0, []
    for i in range(300):
        t += r.choice([0, 1, 5, 5, 31])
        rows.append((r.choice(["a", "b", "c", None]), i, at(t), r.choice(["x", None, f"v{i}"])))
    batch = stateful.cache_hits(spark.createDataFrame(rows, REQUESTS)).collect()
    assert 50 < sum(x.hit for x in batch) < 250 and len(batch) == 300
    streamed = fed(spark, tmp_path, [rows[i : i + 60] for i in range(0, 300, 60)], REQUESTS, stateful.cache_stream)
    assert sorted(streamed, key=str) == sorted(batch, key=str)


def test_late_answers_are_refused(spark, tmp_path):
    schema = "key string, event_id long, ts timestamp, kind string, request_id long, value string"
    rows = [
        [("a", 1, at(0), "request", 1, None), ("a", 2, at(1), "request", 2, None), ("a", 3, at(2), "answer", 1, "old"), ("b", 4, at(2), "answer", 9, "unasked")],
        [("a", 5, at(3), "answer", 2, "new"), ("b", 6, at(3), "request", 1, None), ("a", 7, at(4), "request", 3, None)],
        [("a", 8, at(5), "answer", 2, "again"), ("b", 9, at(5), "answer", 1, None), ("a", 10, at(6), "answer", 3, "last")],
    ]
    streamed = fed(spark, tmp_path, rows, schema, stateful.timely_stream)
    assert {r.event_id for r in streamed} == {5, 9, 10}
    assert sorted(streamed, key=str) == sorted(stateful.timely(spark.createDataFrame(sum(rows, []), schema)).collect(), key=str)


HOURS = ["Mo-Fr 08:00-18:00", "22:00-02:00", "24/7", "", None, "off", "Sa 09:00-12:30; Su 10:00-23:59", "closed on demand", "00:00-23:59"]


def test_status_flips_by_a_clock_that_the_test_moves(spark, tmp_path):
    schema = "id string, event_id long, ts timestamp, opening_hours string"
    places = [(f"p{i}", i, at(0), h) for i, h in enumerate(HOURS)]
    ticks = [[("tick", 100 + i, at(60 * h), None)] for i, h in enumerate((7, 9, 30, 80, 200, 200))]
    streamed = fed(spark, tmp_path, [places, *ticks], schema, lambda s: stateful.status_stream(s, wall=False))
    first = {r.id: r.open for r in streamed if r.at == START}
    assert first == {"p0": False, "p1": True, "p2": True, "p5": False, "p6": False, "p7": False, "p8": True}
    batch = stateful.status_changes(spark.createDataFrame(places, schema), F.lit(at(1)), F.lit(at(200 * 60, 1)))
    assert sorted(tuple(r) for r in streamed if r.at != START) == sorted(map(tuple, batch.collect()))
    monday = [r for r in batch.collect() if r.id == "p0" and r.at < at(24 * 60)]
    assert sorted((r.at, r.open) for r in monday) == [(at(8 * 60), True), (at(18 * 60 + 1), False)]


CHANGES = "k string, rating long, ts long, tie long, deleted boolean"


def table(spark, path):
    return sink.VersionedTable(spark, path, "k string, rating long, ts long, tie long", "k", ["ts", "tie"], 4)


def rows_of(t, version=None):
    return sorted((r.k or "", r.rating, r.ts) for r in t.read(version).collect())


def test_versions_of_a_table(spark, tmp_path):
    t = table(spark, f"{tmp_path}/t")
    df = lambda rows: spark.createDataFrame(rows, CHANGES)
    assert rows_of(t) == [] and t.versions() == []
    assert t.upsert(df([("a", 1, 5, 0, False), ("a", 2, 5, 1, False), ("b", 3, 1, 0, False), (None, 9, 1, 0, False)]), 0)
    assert rows_of(t) == [("", 9, 1), ("a", 2, 5), ("b", 3, 1)]
    assert t.upsert(df([("a", None, 6, 0, True), ("b", 7, 0, 0, False), ("c", 4, 2, 0, False)]), 1)
    want = [("", 9, 1), ("b", 3, 1), ("c", 4, 2)]  # b's change is older than its row
    assert rows_of(t) == want
    assert not t.upsert(df([("c", 99, 99, 0, False)]), 1) and rows_of(t) == want and t.versions() == [0, 1]  # a replay
    assert t.upsert(df([("a", 8, 5, 9, False)]), 2) and rows_of(t) == want  # late: a was removed after
    assert rows_of(t, 0) == [("", 9, 1), ("a", 2, 5), ("b", 3, 1)]
    t.vacuum(keep=1)
    assert rows_of(t) == want and t.versions() == [2]


def test_a_lost_writer_leaves_the_version_as_it_was(spark, tmp_path, monkeypatch):
    t = table(spark, f"{tmp_path}/t")
    t.upsert(spark.createDataFrame([("a", 1, 1, 0, False)], CHANGES), 0)
    lost = table(spark, f"{tmp_path}/t")
    monkeypatch.setattr(lost, "_commit", lambda *_: (_ for _ in ()).throw(KeyboardInterrupt))
    with pytest.raises(KeyboardInterrupt):
        lost.upsert(spark.createDataFrame([("a", 2, 2, 0, False), ("b", 1, 1, 0, False)], CHANGES), 1)
    assert rows_of(t) == [("a", 1, 1)] and len(t._list("rows")) == 2
    assert t.upsert(spark.createDataFrame([("a", 2, 2, 0, False), ("b", 1, 1, 0, False)], CHANGES), 1)
    assert rows_of(t) == [("a", 2, 2), ("b", 1, 1)]
    t.vacuum(keep=1)
    assert len(t._list("rows")) == 1 and rows_of(t) == [("a", 2, 2), ("b", 1, 1)]


def test_only_one_writer_makes_a_version(spark, tmp_path):
    t = table(spark, f"{tmp_path}/t")
    t.upsert(spark.createDataFrame([("a", 1, 1, 0, False)], CHANGES), 0)
    with pytest.raises(RuntimeError):
        t._commit(0, {"batch": 5, "folders": {}})
    assert rows_of(t) == [("a", 1, 1)]
    assert not [f for f in t._list("versions") if f.startswith(".") and not f.endswith(".crc")]


def test_stream_into_a_table(spark, tmp_path):
    r = random.Random(2)
    rows = [(r.choice("abcdefgh"), r.randint(1, 5), i // 2, i, r.random() < 0.2) for i in range(200)]
    batches = [rows[100:150], rows[:100], rows[150:]]
    for i, b in enumerate(batches):
        spark.createDataFrame(b, CHANGES).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    t = table(spark, f"{tmp_path}/t")
    source = spark.readStream.schema(CHANGES).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    for _ in range(2):  # the second start has nothing new to do
        q = t.writer(source, f"{tmp_path}/cp").start()
        q.processAllAvailable()
        q.stop()
    last = {}
    for row in sorted(rows, key=lambda x: (x[2], x[3])):
        last[row[0]] = row
    assert rows_of(t) == sorted((k, v[1], v[2]) for k, v in last.items() if not v[4])
    files, path = filesystem(spark, f"{tmp_path}/t/versions")
    assert files.exists(path) and len(t.versions()) == 3
