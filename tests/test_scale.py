"""Work of a query over many places: how it is dealt to tasks, and that no expression is made again and again."""

import re

import pytest
from pyspark.sql import functions as F

from waymark.functions.text import bound, once
from waymark.plans import adapters, catalog

SF = "/root/testdata/sf0.001"


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def _filters(plan):
    return [line for line in plan.splitlines() if re.match(r"[\s:+-]*Filter ", line)]


def test_places_of_one_row_group_are_dealt_to_all_cores(spark):
    p = adapters.places(spark, SF)
    assert adapters.read(spark, SF, "part").rdd.getNumPartitions() == 1
    assert p.rdd.getNumPartitions() >= 24
    rows = p.groupBy(F.spark_partition_id()).count().collect()
    assert len(rows) >= 24 and max(r["count"] for r in rows) < 3 * p.count() / len(rows)


def test_a_column_made_once_stays_out_of_the_filters_below(spark):
    df = spark.range(10).withColumn("t", F.concat(F.lit("x"), F.col("id").cast("string")))
    out = once(df, n=F.length(F.upper("t")), id=F.col("id") + 1).filter("n > 1 and id > 3")
    assert all("upper" not in f for f in _filters(_plan(out)))
    assert sorted((r.t, r.n, r.id) for r in out.collect()) == [(f"x{i}", 2, i + 1) for i in range(3, 10)]
    assert df.select(bound(F.nullif("t", F.lit("x1")), lambda t: F.concat(t, t)).alias("b")).collect()[1].b is None


@pytest.mark.parametrize("name", ["exclusion_audit", "discovery_score"])
def test_rules_are_not_made_again_in_filters(spark, name):
    """The filter on a rule's result had the rule, the tags and all that they read in it: 685,000 and 156,000 characters of plan."""
    plan = _plan(catalog.QUERIES[name](spark, SF))
    assert all("transform(" not in f and "map_from_entries" not in f for f in _filters(plan))


def test_an_id_is_written_and_read_once(spark):
    assert _plan(catalog.QUERIES["strict_ids"](spark, SF)).count("regexp_replace") < 20  # an id has two texts, each of five steps, and the city is read again


def test_tags_of_an_importer_are_made_once(spark):
    for name in ("imported_story", "imported_agent"):
        plan = _plan(catalog.QUERIES[name](spark, SF))
        assert plan.count("bakery cafe") <= 1 and plan.count("regexp_replace") <= 4, name


def test_weeks_are_made_once_a_text_of_hours(spark):
    plan = _plan(catalog.QUERIES["opening_changes"](spark, SF))
    assert "regexp" not in plan and "_flips" in plan


def test_kinds_are_compared_by_all_cores(spark, monkeypatch):
    """The pairs of kinds were scored by one task, since the kinds were one small file."""
    from waymark.operators import locate, matching

    dealt, join = [], locate.radius_join
    monkeypatch.setattr(matching.locate, "radius_join", lambda left, *a: dealt.append(left.rdd.getNumPartitions()) or join(left, *a))
    catalog.QUERIES["photo_match_best"](spark, SF)
    assert dealt and min(dealt) >= 24


@pytest.mark.parametrize(("block", "rows", "words"), [(1024, 256, 4096), (13, 3, 11)])
def test_best_matches_of_many_kinds_keep_two_a_kind(spark, monkeypatch, block, rows, words):
    """A row was written for each two kinds near each other; now two a kind and block near it, and the best are those of all rows against all."""
    import random

    from waymark.functions.geo import haversine_km
    from waymark.operators import matching

    r = random.Random(3)
    first, last = ["Café Bean", "bean cafe", "Cafe-Bean", "Bean & Co", "B", "", None, "Mill's", "Mühle", "old mill"], ["", " Bar", " bar", " Bakery", " 7"]
    name = lambda: None if (x := r.choice(first)) is None else x + r.choice(last)
    lat, lon = [60.0, 60.0003, 60.0008, 60.004, 60.0065, 60.02, float("nan"), None], [179.9995, -179.9995, 179.99, 12.0]
    row = lambda s, i: (f"{s}{i}", name(), r.choice([None, "", "1 A St", "St. A 1", "2 A St", "3 B"]), r.choice(lat), r.choice(lon))
    own = [row("p", i) for i in range(140)]
    others = [(i // 2, *x) for i, x in enumerate(r.sample(own, 100) + [row("c", i) for i in range(60)])]
    p = spark.createDataFrame(own, "id string, name string, address string, lat double, lon double")
    q = spark.createDataFrame(others, "cord long, cid string, cname string, caddress string, clat double, clon double")
    tables, write = [], matching.materialised
    monkeypatch.setattr(matching, "materialised", lambda df: tables.append(write(df)) or tables[-1])
    for n, size in (("BLOCK", block), ("SLICE", rows), ("WORDS", words)):
        monkeypatch.setattr(matching, n, size)
    got = {x.id: (x.cid, x.total, x.strong) for x in matching.best_matches(p, q).collect()}
    km = haversine_km(F.col("lat"), F.col("lon"), F.col("clat"), F.col("clon"))
    score = matching.match_score(F.col("name"), F.col("cname"), F.col("address"), F.col("caddress"), km * 1000)
    want = {}
    for x in p.crossJoin(q).filter((km <= 0.7) & (F.col("id") != F.col("cid"))).select("id", "cid", "cord", score.alias("m")).collect():
        new = (-x.m.total, x.cord, x.cid, x.m.strong)
        want[x.id] = min(want.get(x.id, new), new)
    assert len(want) > 80 and got == {i: (c, -t, s) for i, (t, _, c, s) in want.items()}
    near = next(t for t in tables if "band" in t.columns)
    blocks = near.join(next(t for t in tables if {"n", "block"} <= set(t.columns)).select(F.col("block").alias("left"), "lat", "lon", "n"), ["left", "lat", "lon"])
    assert next(t for t in tables if "m" in t.columns).count() <= 2 * blocks.select("n", "right").distinct().count()


def test_best_matches_of_one_point_are_not_all_pairs_of_kinds(spark, monkeypatch):
    """4,000 kinds at one point had 1.6e7 rows of pairs."""
    from waymark.operators import matching

    n = 4000
    p = spark.range(n).select(F.concat(F.lit("p"), F.col("id")).alias("id"), F.concat(F.lit("cafe "), F.col("id") % 40).alias("name"), F.concat((F.col("id") / 40).cast("int"), F.lit(" St")).alias("address"), F.lit(1.0).alias("lat"), F.lit(2.0).alias("lon"), F.col("id").alias("ord"))
    tables, write = [], matching.materialised
    monkeypatch.setattr(matching, "materialised", lambda df: tables.append(write(df)) or tables[-1])
    q = p.select(F.col("ord").alias("cord"), F.col("id").alias("cid"), F.col("name").alias("cname"), F.col("address").alias("caddress"), F.col("lat").alias("clat"), F.col("lon").alias("clon"))
    got = {x.id: (x.cid, round(x.total, 6)) for x in matching.best_matches(p, q).collect()}
    # each place is a kind of its own; the first of those with its name, which share one of three words of its address
    assert got == {f"p{i}": (f"p{i % 40 if i >= 40 else i + 40}", round(0.9 + 0.1 / 3, 6)) for i in range(n)}
    assert max(t.count() for t in tables) <= 2 * n * 4  # kinds of four blocks


@pytest.mark.parametrize("chunk", [7, 1024])
def test_pairs_of_one_point_are_compared_by_kinds(spark, monkeypatch, chunk):
    """Each pair of places was compared and shuffled by itself; now the tables that meet have a row a chunk, and the pairs are those of all rows against all."""
    from waymark.operators import dedupe
    from waymark.functions.geo import haversine_km
    from waymark.functions.text import place_text

    names, addresses = ["Bean", "Bean Roastery", "Mill", "", None], ["1 A St", None, "2 B St"]
    rows = [(f"p{i}", i // 2, "Rome" if i % 10 else None, 41.9 + (i % 3) * 0.0002, 12.5 + (i % 2) * 0.00005, names[i % 5], addresses[i % 4 % 3]) for i in range(200)]
    p = spark.createDataFrame(rows, "id string, ord long, city string, lat double, lon double, name string, address string")
    tables, write = [], dedupe.materialised
    monkeypatch.setattr(dedupe, "materialised", lambda df: tables.append(write(df)) or tables[-1])
    monkeypatch.setattr(dedupe, "CHUNK", chunk)
    got = dedupe.duplicate_pairs(p, digits=6).collect()
    cells = p.filter("city is not null").select(*[c.alias(n) for c, n in zip(dedupe.cell(F.col("lat"), F.col("lon"), dedupe.FARTHEST), "rc", strict=True)]).groupBy("r", "c").count().collect()
    assert tables[0].count() == sum(-(-x["count"] // chunk) for x in cells) and tables[0].agg(F.sum(F.size("kinds"))).first()[0] < 180
    base = p.select("id", "ord", "city", "lat", "lon", place_text(F.col("name")).alias("n"), place_text(F.col("address")).alias("a"))
    x, y = (base.select(*[F.col(c).alias(s + c) for c in base.columns]) for s in "xy")
    km = haversine_km(F.col("xlat"), F.col("xlon"), F.col("ylat"), F.col("ylon"))
    all_ = x.join(y, (F.col("xcity") == F.col("ycity")) & (F.col("xord") < F.col("yord"))).withColumn("m", km * 1000).filter(F.col("m") <= dedupe.FARTHEST * 1000)
    want = all_.filter(dedupe.alike(F.col("m"), F.col("xn"), F.col("yn"), F.col("xa"), F.col("ya"), dedupe.profile(F.col("xcity")))).select("xid", "yid", F.round("m", 6)).collect()
    assert len(want) > 1000 and sorted(map(tuple, got)) == sorted(map(tuple, want))


@pytest.mark.parametrize(("chunk", "run"), [(7, 3), (1024, 256)])
def test_pairs_go_by_names_and_read_addresses_as_they_are_written(spark, monkeypatch, chunk, run):
    """Records of one name and point that differ by address were compared one by one; now they are one kind, and the pairs are those of a plain loop."""
    import math
    import random

    from waymark.functions import vocab as v
    from waymark.operators import dedupe

    r = random.Random(5)
    cities = ["Rome", None, next(iter(v.DEDUPE_BY_CITY))]
    step = 1 / 111_195  # a metre
    rows = [(f"p{i}", i // 3, cities[i % 8 // 3], 41.9 + r.choice([0, 10, 17, 30, 50, 60, 80, 95]) * step, r.choice([12.5, 12.50001]), r.choice(["bean", "bean mill", "cafe", "mill", "ab", ""]), r.choice(["1 a", "2 b", ""])) for i in range(240)]
    rows += [("nan", 1, "Rome", float("nan"), 12.5, "bean", ""), ("none", 1, "Rome", None, 12.5, "bean", "")]
    tables, write = [], dedupe.materialised
    monkeypatch.setattr(dedupe, "materialised", lambda df: tables.append(write(df)) or tables[-1])
    monkeypatch.setattr(dedupe, "CHUNK", chunk)
    monkeypatch.setattr(dedupe, "RUN", run)
    p = spark.createDataFrame(rows, "id string, ord long, city string, lat double, lon double, name string, address string")
    got = sorted((x.a, x.b, x.metres) for x in dedupe.duplicate_pairs(p, digits=3).collect())

    def metres(a, b):
        la, lb = math.radians(a[3]), math.radians(b[3])
        h = math.sin((lb - la) / 2) ** 2 + math.cos(la) * math.cos(lb) * math.sin(math.radians(b[4] - a[4]) / 2) ** 2
        return 2000 * 6371 * math.atan2(math.sqrt(h), math.sqrt(1 - h))

    def like(a, b, m):
        close, name, address = v.DEDUPE_BY_CITY.get(a[2], v.DEDUPE_DEFAULT)
        short, long_ = sorted((a[5], b[5]), key=len)
        same = a[5] == b[5] != ""
        if a[6] == b[6] != "" and m <= address or same and m <= name or m <= close and (same or "" in (a[6], b[6])):
            return True
        return len(short) >= 3 and short not in v.GENERIC_TOKENS and short in long_ and m <= max(name, 55)

    whole = [x for x in rows[:240] if x[2]]
    near = [(a, b, metres(a, b)) for a in whole for b in whole if a[1] < b[1] and a[2] == b[2]]
    want = sorted((a[0], b[0], round(m, 3)) for a, b, m in near if m <= 1000 * dedupe.FARTHEST and like(a, b, m))
    assert len(want) > 1000 and [x[:2] for x in got] == [x[:2] for x in want] and max(abs(x[2] - y[2]) for x, y in zip(got, want, strict=True)) < 0.002

    p = spark.range(600).select(F.col("id").cast("string"), F.col("id").alias("ord"), F.lit("Rome").alias("city"), F.lit(1.0).alias("lat"), F.lit(2.0).alias("lon"), F.lit("bean").alias("name"), F.col("id").cast("string").alias("address"))
    tables.clear()
    assert dedupe.duplicate_pairs(p).count() == 600 * 599 / 2
    assert tables[0].agg(F.sum(F.size("kinds"))).first()[0] <= 600 // run + 600 // chunk + 2  # 600 before


def test_a_filter_on_the_nearest_city_measures_no_distance_again(spark):
    from waymark.operators import locate

    p, cities = adapters.places(spark, SF), adapters.cities(spark, SF)
    plan = _plan(locate.nearest(p, cities, F.col("lat"), F.col("lon")).filter("nearest_city is not null and nearest_city = city"))
    assert all("ATAN2" not in f.upper() for f in _filters(plan))
