import json
import random

from pyspark.sql import functions as F

from waymark.operators import audit, dedupe, locate, state
from waymark.sources import readers, writers
from waymark.streaming import live


def test_radius_join_equals_all_pairs(spark):
    r = random.Random(2)
    a = [(i, r.uniform(-85, 85), r.choice([r.uniform(-180, 180), 179.9, -179.9])) for i in range(150)]
    b = [(i, x + r.uniform(-3, 3), y) for i, x, y in a[:80]]
    left, right = spark.createDataFrame(a, "i int, lat double, lon double"), spark.createDataFrame(b, "j int, city_lat double, city_lon double")
    from waymark.functions.geo import haversine_km

    want = left.crossJoin(right).filter(haversine_km(F.col("lat"), F.col("lon"), F.col("city_lat"), F.col("city_lon")) <= 150)
    for km in (150.0,):
        got = locate.radius_join(left, right, km)
        assert sorted((x.i, x.j) for x in got.collect()) == sorted((x.i, x.j) for x in want.collect())


def test_nearest_by_array_and_by_grid_agree(spark, monkeypatch):
    r = random.Random(3)
    places = spark.createDataFrame([(i, r.uniform(-80, 80), r.uniform(-180, 180)) for i in range(60)], "i int, lat double, lon double")
    cities = spark.createDataFrame([(i, f"c{i}", r.uniform(-80, 80), r.uniform(-180, 180)) for i in range(40)], "city_key int, city string, city_lat double, city_lon double")
    a = {x.i: x.nearest_city for x in locate.nearest(places, cities, F.col("lat"), F.col("lon")).collect()}
    monkeypatch.setattr(locate, "MOST_CITIES", 5)
    b = {x.i: x.nearest_city for x in locate.nearest(places, cities, F.col("lat"), F.col("lon")).collect()}
    assert a == b and len(a) == 60


def places(spark, rows):
    return spark.createDataFrame([(f"p{i}", i, "X", lat, 0.0, n, a, float(q)) for i, (lat, n, a, q) in enumerate(rows)], "id string, ord long, city string, lat double, lon double, name string, address string, quality double")


def kept(spark, rows):
    p = places(spark, rows)
    return sorted(x.id for x in dedupe.greedy(p, dedupe.duplicate_pairs(p)).collect())


def test_greedy_follows_the_order(spark):
    step = 0.0007  # about 78 metres: neighbours are near, ends are not
    assert kept(spark, [(0.0, "aa", "", 1), (step, "aa", "", 1), (2 * step, "aa", "", 1)]) == ["p0", "p2"]
    assert kept(spark, [(0.0, "aa", "", 1), (step, "aa", "st 1", 9), (2 * step, "aa", "", 1)]) == ["p1"]
    assert kept(spark, [(0.0, "aa", "s", 1), (0.00001, "bb", "t", 1), (0.5, "cc", "", 1)]) == ["p0", "p1", "p2"]


def test_greedy_equals_a_plain_loop(spark):
    r = random.Random(6)
    rows = [(r.randrange(40) * 0.0003, r.choice(["aa", "aab", "cc"]), r.choice(["", "s 1"]), r.randrange(4)) for _ in range(120)]
    p = places(spark, rows)
    like = {frozenset((x.a, x.b)) for x in dedupe.duplicate_pairs(p).collect()}
    out = []
    for i, row in enumerate(rows):
        at = next((j for j, (k, _) in enumerate(out) if frozenset((k, f"p{i}")) in like), None)
        if at is None:
            out.append((f"p{i}", row[3]))
        elif row[3] > out[at][1]:
            out[at] = (f"p{i}", row[3])
    assert kept(spark, rows) == sorted(k for k, _ in out)


def walked(rows, like):
    """Ids of the kept of ``rows`` (id, quality), by a plain loop over pairs of ids."""
    out = []
    for id_, q in rows:
        at = next((j for j, (k, _) in enumerate(out) if frozenset((k, id_)) in like), None)
        if at is None:
            out.append((id_, q))
        elif q > out[at][1]:
            out[at] = (id_, q)
    return sorted(k for k, _ in out)


def test_greedy_without_pairs_equals_a_plain_loop(spark):
    r = random.Random(7)
    rows = [(r.randrange(40) * 0.0003, r.choice(["aa", "aab", "cafe", "cafe x", "", None]), r.choice(["", None, "s 1", "s 2"]), r.randrange(6)) for _ in range(250)]
    p = places(spark, rows)
    like = {frozenset((x.a, x.b)) for x in dedupe.duplicate_pairs(p).collect()}
    assert sorted(x.id for x in dedupe.greedy_near(p).collect()) == walked([(f"p{i}", row[3]) for i, row in enumerate(rows)], like)


def test_greedy_makes_no_pairs_of_a_hot_spot(spark, monkeypatch):
    monkeypatch.setattr(dedupe, "duplicate_pairs", None)  # 20,000 places of one point have 2e8 pairs
    n = 20_000
    p = places(spark, [(0.0, f"n{i}", "" if i % 3 else f"s {i % 25}", i % 7) for i in range(n)])
    like = lambda i, j: i % 3 != 0 or j % 3 != 0 or i % 25 == j % 25 or min(i, j) >= 10 and f"n{min(i, j)}" in f"n{max(i, j)}"
    out = []
    for i in range(n):
        at = next((k for k, j in enumerate(out) if like(i, j)), None)
        if at is None:
            out.append(i)
        elif i % 7 > out[at] % 7:
            out[at] = i
    assert sorted(x.id for x in dedupe.greedy_near(p).collect()) == sorted(f"p{i}" for i in out)


def test_photo_match_best_equals_all_pairs(spark):
    from waymark.functions.geo import haversine_km
    from waymark.operators import matching
    from waymark.plans import catalog

    sf = "/root/testdata/sf0.01"
    p = catalog._places(spark, sf).select("id", "ord", "name", "address", "lat", "lon").cache()
    q = p.toDF("cid", "cord", "cname", "caddress", "clat", "clon")
    km = haversine_km(F.col("lat"), F.col("lon"), F.col("clat"), F.col("clon"))
    score = matching.match_score(F.col("name"), F.col("cname"), F.col("address"), F.col("caddress"), km * 1000)
    want = {}
    for x in p.crossJoin(q).filter((km <= 0.7) & (F.col("id") != F.col("cid"))).select("id", "cid", "cord", score.alias("m")).collect():
        new = (-x.m.total, x.cord, x.cid, x.m.strong)
        want[x.id] = min(want.get(x.id, new), new)
    got = {x.id: (x.cid, x.total, x.strong) for x in catalog.photo_match_best(spark, sf).collect()}
    assert len(got) > 100 and got == {i: (c, round(-t, 6), s) for i, (t, _, c, s) in want.items()}


def test_url_merge(spark):
    df = spark.createDataFrame([(2, "u", "", ["a", "b"]), (1, "u", None, ["a"]), (3, "u", "st", None), (4, None, "x", ["z"])], "ord int, url string, address string, types array<string>")
    got = {x._key: (x.address, x.types) for x in dedupe.merge_by_key(df, F.col("url"), "ord", ["address"], ["types"]).collect()}
    assert got == {"u": ("st", ["a", "b"]), None: ("x", ["z"])}


def test_rating_cascade_stages(spark):
    p = spark.createDataFrame(
        [("a", ["old"], "Haifa", "Foo", 1.0, 1.0), ("b", ["old"], "Haifa", "Foo", 1.0, 1.0), ("c", None, "Haifa", "Bar", 1.0, 1.0), ("d", None, "Haifa", "Baz", 32.8, 34.9), ("e", None, "Haifa", "Qux", 32.80015, 34.9), ("f", None, None, "none", None, None)],
        "id string, legacy array<string>, city string, name string, lat double, lon double",
    )
    ratings = [("a", 5, 0), ("old", 2, 1), ("seeded-name-haifa-bar", 3, 2), ("seeded-haifa-baz-10.00000-10.00000", 4, 3), ("seeded-haifa-zed-32.80000-34.90000", 1, 4), ("b", 0, 5)]
    got = {x.id: x.rating for x in state.rating_cascade(p, spark.createDataFrame(ratings, "place_id string, rating int, ord long")).collect()}
    assert got == {"a": 5, "b": 2, "c": 3, "d": 4, "e": 1, "f": 0}


def test_overrides_and_state(spark):
    o = spark.createDataFrame([("a", {"address": "", "lat": "x"}, False), ("old", {"name": "N"}, True)], "id string, patch map<string,string>, deleted boolean")
    p = spark.createDataFrame([("a", ["old"], "st", 1.0), ("b", ["old"], "st", 1.0), ("c", None, "st", 1.0)], "id string, legacy array<string>, address string, lat double")
    d = state.with_override(p, o)
    got = {x.id: (x.address, x.lat, x.deleted) for x in d.select("id", state.patched(F.col("patch"), "address", F.col("address")).alias("address"), state.patched(F.col("patch"), "lat", F.col("lat"), number=True).alias("lat"), "deleted").collect()}
    assert got == {"a": ("", 1.0, False), "b": ("st", 1.0, True), "c": ("st", 1.0, False)}
    r = lambda rows: spark.createDataFrame(rows, "place_id string, rating int")
    assert {x.place_id: x.rating for x in state.merge_ratings(r([("a", 3)]), r([("a", 2), ("b", 4)])).collect()} == {"a": 3, "b": 4}
    old = r([("seeded-Tel Aviv-1", 4), ("seeded-Tel Aviv-9", 2), ("node-1", 5)])
    pos = spark.createDataFrame([("Tel Aviv", 0, "x"), ("Tel Aviv", 1, "y")], "city string, pos int, id string")
    assert [(x.place_id, x.rating) for x in state.recover_indexed(old, pos).collect()] == [("y", 4)]
    raw = spark.createDataFrame([(1, "m", "N", "1", "2"), (0, "m", "First", "1,5", "2"), (2, "", "x", "1", "1"), (3, "n", "ok", "3", "4")], "ord int, id string, name string, lat string, lon string")
    assert sorted((x.id, x.name) for x in state.coerce_manual(raw).collect()) == [("m", "N"), ("n", "ok")]
    assert state.hydrate(old, old.limit(0), True) is old and state.hydrate(old, pos, False) is pos


def test_fallback(spark):
    a = spark.range(3)
    assert [x.stage for x in audit.fallback([a.filter("id > 9"), a, a], False).collect()] == [1, 1, 1]
    assert audit.fallback([a.filter("id > 9"), a], True).count() == 0


def test_sources(spark, tmp_path):
    (tmp_path / "l.json").write_text(json.dumps({"exportedAt": "x", "lists": [{"url": "u", "places": [{"name": "A", "lat": "52,5", "longitude": 13.4, "types": ["cafe", ""], "vicinity": "V"}, {"name": "B", "types": "bar", "address": ""}]}]}))
    rows = readers.lists(spark, str(tmp_path / "l.json")).orderBy("id").collect()
    assert [(r.id, r.name, r.address, r.lat, r.lon, r.types) for r in rows] == [("google-0-0", "A", "V", 52.5, 13.4, ["cafe"]), ("google-0-1", "B", None, None, None, ["bar"])]
    (tmp_path / "o.json").write_text(json.dumps({"elements": [{"type": "node", "id": 1, "lat": 1.0, "lon": 2.0, "tags": {"name:en": "E", "addr:street": "S", "addr:housenumber": "5"}}, {"type": "way", "id": 2, "center": {"lat": 3.0, "lon": 4.0}}, {"type": "way", "id": 3}]}))
    got = {r.id: (r.name, r.lat, r.address, r.named) for r in readers.map_elements(spark, str(tmp_path / "o.json")).collect()}
    assert got == {"node-1": ("E", 1.0, "S 5", True), "way-2": (None, 3.0, None, False)}
    (tmp_path / "tel-aviv.json").write_text(json.dumps([{"name": "T", "lat": 1.5, "types": ["a"]}, {"name": "U", "lat": None}]))
    assert sorted((r.name, r.city_file, r.lat) for r in readers.seeded(spark, str(tmp_path / "tel-aviv.json")).collect()) == [("T", "tel-aviv", 1.5), ("U", "tel-aviv", None)]
    (tmp_path / "urls.txt").write_text("# c\n\n https://x \n")
    assert [r.url for r in readers.list_urls(spark, str(tmp_path / "urls.txt")).collect()] == ["https://x"]


def test_page_extractors(spark):
    page = '<title> T </title><meta property="og:image" content="/a.png"><a href="http://s.test/cafe/Foo-Bar/"></a><h3 class=x>Foo <b>Bar</b></h3><a href="http://s.test/cafe/foo-bar"></a>"latitude": "1.5", "longitude": 2.5'
    df = spark.createDataFrame([(1, page)], "page_id int, html string")
    r = df.select(readers.html_meta(F.col("html")).alias("m"), readers.page_coordinates(F.col("html")).alias("c"), readers.url_coordinates(F.lit("x/@1,2,15z/data=!3d3.5!4d4.5")).alias("u")).first()
    assert (r.m.title, r.m.image, r.c.lat, r.c.lon, r.u.lat, r.u.lon) == ("T", "/a.png", 1.5, 2.5, 3.5, 4.5)
    got = readers.page_links(df, r"(?i)https?://s\.test/cafe/([a-z0-9-]+)/?").collect()
    assert [(x.slug, x.pos, x.heading.split()) for x in got] == [("foo-bar", 0, ["Foo", "Bar"])]


def test_partitioned_write(spark, tmp_path):
    p = spark.createDataFrame([("Tel Aviv", 1.0, 2.0), ("Tel-Aviv", 3.0, 4.0), ("Ör", 1.0, 1.0)], "city string, lat double, lon double")
    index = writers.write_by_city(p, str(tmp_path / "out"))
    assert sorted(r.city_slug for r in index.collect()) == ["or", "tel-aviv", "tel-aviv-2"]
    assert spark.read.parquet(str(tmp_path / "out")).filter("city_slug = 'tel-aviv-2'").first().city == "Tel-Aviv"


def test_streams(spark, tmp_path):
    rows = [(1, i, f"2024-01-01 00:{i:02}:00", 32.0 + d, 34.0) for i, d in enumerate([0, 0.0001, 0.0002, 0.001])]
    df = spark.createDataFrame(rows, "user_id long, event_id long, ts string, lat double, lon double").withColumn("ts", F.to_timestamp("ts"))
    batch = sorted(x.event_id for x in live.moved(df).collect())
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = live.moved_stream(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("moves").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert batch == [0, 3] and sorted(x.event_id for x in spark.table("moves").collect()) == batch


def test_groups_of_shuffled_chains_and_stars(spark):
    from waymark.operators import graph

    names = [f"{i:05}" for i in range(1000)]
    random.Random(3).shuffle(names)
    pairs = [*zip(names, names[1:], strict=False), *[("hub", f"leaf{i}") for i in range(200)], ("x", "y"), ("y", "x"), ("z", "z")]
    rounds, keep = [], graph.materialised
    graph.materialised = lambda df: rounds.append(1) or keep(df)
    try:
        got = {r.node: r.label for r in graph.groups(spark.createDataFrame(pairs, "a string, b string")).collect()}
    finally:
        graph.materialised = keep
    assert len(rounds) < 2 * 10  # two tables a round
    assert got == {**dict.fromkeys(names, "00000"), **{f"leaf{i}": "hub" for i in range(200)}, "hub": "hub", "x": "x", "y": "x", "z": "z"}
    assert graph.groups(spark.createDataFrame([], "a string, b string")).count() == 0


def test_entity_lists_and_city_slugs(spark):
    item = lambda name, address, point: [None, [None, None, "second", None, address, point], name]
    body = ")]}'\n" + json.dumps([[None] * 8 + [[item(" A ", "St 1", [0, 0, 1.5, 2.5]), item("a", "st 1", None), item("B", "", None), item(None, "x", None), [None, None, "no details"]]]])
    rows = readers.entity_list(spark.createDataFrame([(body,), ("broken",), (None,)], "body string")).collect()
    assert sorted((r.pos, r.name, r.address, r.lat, r.lon) for r in rows) == [(0, "A", "St 1", 1.5, 2.5), (2, "B", "second", None, None)]
    links = spark.createDataFrame([("https://s.test/Wien/",), ("https://s.test/wien/",), ("https://s.test/about/",), ("https://s.test/linz/",), ("x",)], "href string")
    pages = spark.createDataFrame([("wien", "/cafe/" * 8), ("linz", "/cafe/" * 7), ("about", "/cafe/" * 9)], "slug string, html string")
    got = readers.city_slugs(links, r"(?i)^https://s\.test/([a-z][a-z-]+)/$", ["about"], pages, "/cafe/").collect()
    assert [(r.slug, r.n) for r in got] == [("wien", 8)]
    assert readers.lists(spark, "/nowhere/to/be/found.json").count() == 0


def test_fallback_asks_in_order(spark):
    a = spark.range(3)
    assert [x.stage for x in audit.fallback([a.filter("id > 9"), a.filter("id > 8"), a.filter("id > 7")], False).collect()] == []
    assert {x.stage for x in audit.fallback([a, a], False).collect()} == {0}


def test_nearest_looks_at_enough_cities(spark):
    from waymark.functions.geo import haversine_km

    r = random.Random(8)
    places = spark.createDataFrame([(i, r.uniform(-89.9, 89.9), r.choice([r.uniform(-180, 180), 179.99, -179.99])) for i in range(200)] + [(-1, None, 1.0)], "i int, lat double, lon double")
    cities = spark.createDataFrame([(i, f"c{i}", r.uniform(-89, 89), r.uniform(-180, 180)) for i in range(60)], "city_key int, city string, city_lat double, city_lon double")
    d = places.crossJoin(cities).select("i", "city", haversine_km(F.col("lat"), F.col("lon"), F.col("city_lat"), F.col("city_lon")).alias("d")).filter("d is not null").collect()
    want = {}
    for x in d:
        want[x.i] = min(want.get(x.i, (9e9, "")), (x.d, x.city))
    got = {x.i: x.nearest_city for x in locate.nearest(places, cities, F.col("lat"), F.col("lon")).collect()}
    assert got == {**{i: c for i, (_, c) in want.items()}, -1: None}


def test_state_joins_and_fills(spark):
    from waymark.operators import combine, matching

    p = spark.createDataFrame([(1, "a", "Cafe X", ""), (2, "b", "cafe  x ", "st"), (3, "c", "Other", None)], "ord int, id string, name string, address string")
    r = spark.createDataFrame([("a", 3), ("b", 5), ("c", 0)], "place_id string, rating int")
    assert {x.place_id: x.rating for x in state.spread_by_name(r, p).collect()} == {"a": 5, "b": 5, "c": 0}
    found = spark.createDataFrame([("a", "new 1"), ("c", "new 3"), ("b", "not this")], "id string, address string")
    assert {x.id: x.address for x in combine.fill_missing(p, found, "id", "address").collect()} == {"a": "new 1", "b": "st", "c": "new 3"}
    assert {x.id: x.address for x in combine.fill_missing(p, found, "id", "address", limit=1).collect()} == {"a": "new 1", "b": "st", "c": None}
    answers = spark.createDataFrame([("Long street 1", 2, 9.0, 9.0), ("Long street 1", 1, 1.0, 2.0), ("abc", 1, 3.0, 4.0)], "address string, rank int, lat double, lon double")
    hits = combine.first_hit(spark.createDataFrame([("Long street 1",), ("abc",), ("none at all",)], "address string"), answers).collect()
    assert {x.address: (x.lat, x.lon) for x in hits} == {"Long street 1": (1.0, 2.0), "abc": (None, None), "none at all": (None, None)}
    two = spark.createDataFrame([("k", 1, False), ("k", 2, True), ("l", 1, False)], "key string, ord int, coffee boolean")
    assert sorted((x.key, x.ord) for x in combine.prefer(two, "key", F.col("coffee")).collect()) == [("k", 2), ("l", 1)]
    score = matching.geocode_score(F.lit("Cafe Foo, Main St"), F.lit("Cafe Foo"), F.lit("cafe"), F.lit("amenity"), F.lit(1.0), F.lit(1.0), F.lit(1.0), F.lit(1.0))
    assert spark.range(1).select(score.alias("s")).first().s == 38 + 14 + 12 + 32


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([("a", 1)], "id string, n int")
    for stamp in ("1", "2"):
        writers.snapshot(df, str(tmp_path / "s"), stamp)
    assert spark.read.parquet(str(tmp_path / "s" / "current")).count() == 1 and spark.read.parquet(str(tmp_path / "s" / "history" / "1")).count() == 1
    for _ in range(2):
        writers.append_log(df, str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).count() == 2
    writers.report({"x": df, "y": df}, str(tmp_path / "r"))
    assert spark.read.json(str(tmp_path / "r" / "y")).first().id == "a"
    p = df.withColumn("city", F.lit("X")).withColumn("lat", F.lit(1.0)).withColumn("lon", F.lit(2.0))
    assert writers.write_by_city(p, str(tmp_path / "dry"), write=False).first().city_slug == "x" and not (tmp_path / "dry").exists()
    writers.export_manual(p, str(tmp_path / "out"))
    back = writers.import_manual(spark, str(tmp_path / "out"), p.limit(0))
    assert [(r.id, r.lat) for r in back.collect()] == [("a", 1.0)]
    assert writers.import_manual(spark, str(tmp_path / "nothing"), p).count() == 1


def test_cached_stream_drops_repeats(spark, tmp_path):
    rows = [("k", "2024-01-01 00:00:00", 1), ("k", "2024-01-01 00:05:00", 2), ("l", "2024-01-01 00:06:00", 3)]
    df = spark.createDataFrame(rows, "key string, ts string, v int").withColumn("ts", F.to_timestamp("ts"))
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    q = live.cached(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("cached").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    got = sorted(x.key for x in spark.table("cached").collect())
    assert got == ["k", "l"]
    cache = spark.createDataFrame([("a", 0), ("b", 1_000_000)], "city string, ts long")
    assert [x.city for x in readers.fresh(cache, F.lit(1_900_000)).collect()] == ["b"]
