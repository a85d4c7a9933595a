from pyspark.sql import functions as F

from waymark.functions import scoring, text
from waymark.operators import audit, combine, matching, state


def test_overrides_are_coerced(spark):
    entries = {
        " a ": '{"name": " N ", "address": null, "notes": false, "cityName": 5, "source": 0, "lat": "12.5", "lon": null, "specialtyScore": 250, "updatedAt": true}',
        "b": '{"lat": "x", "lon": {"a": 1}, "deleted": "true", "other": 1}',
        "c": '{"deleted": true, "lat": [1]}',
        "d": "[1]", "e": "no json", "f": None, "g": "{}", " ": '{"name": "x"}', "h": '{"lat": "", "specialtyScore": -3, "name": "\\u00e9"}',
    }
    got = {r.id: (r.patch, r.deleted) for r in state.coerce_overrides(spark.createDataFrame(list(entries.items()), "id string, entry string")).collect()}
    assert got == {
        "a": ({"name": "N", "address": "", "notes": "", "cityName": "5", "source": "", "lat": "12.5", "lon": "0.0", "specialtyScore": "100.0", "updatedAt": "1.0"}, False),
        "c": ({}, True), "h": ({"lat": "0.0", "specialtyScore": "0.0", "name": "é"}, False),
    }


def test_an_empty_post_clears_and_none_keeps(spark):
    existing = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a"), (3, "c"), (None, "n")], "user_id int, place_key string")
    posts = spark.createDataFrame([(1, []), (2, ["x", "", None, "x", "a"]), (3, None), (4, ["y"]), (None, [])], "user_id int, ids array<string>")
    got = sorted((r.user_id or 0, r.place_key) for r in state.post_hidden(existing, posts).collect())
    assert got == [(2, "a"), (2, "x"), (3, "c"), (4, "y")]


def test_geocodes_are_accepted_by_points_or_nearness(spark):
    rows = [
        ("far", 0, "Café Zoo", "cafe zoo, Berlin", "cafe", "amenity", 0.3, 0.0), ("far", 1, "Café Zoo", None, None, None, 0.0, 0.0),
        ("near", 0, "Zoo", "something else", "house", "x", 0.0, 0.0), ("none", 0, "Zoo", "Zoo", "cafe", "amenity", None, 0.0), ("weak", 0, "Zoo", "x", "cafe", "y", 0.17, 0.0),
    ]
    df = spark.createDataFrame(rows, "id string, rank int, name string, display string, kind string, category string, lat double, lon double").withColumns({"city_lat": F.lit(0.0), "city_lon": F.lit(0.0)})
    got = {r.id: (r["rank"], r.accepted) for r in matching.best_geocode(df).collect()}
    assert got == {"far": (1, True), "near": (0, True), "weak": (0, False)}


def test_links_and_labels(spark):
    row = spark.range(1).select(
        text.direct_link(F.lit(""), F.lit(" It's (a) café~ "), F.lit("1 & 2 St!"), "https://m/?q=").alias("a"), text.direct_link(F.lit("u"), F.lit("n"), F.lit(None).cast("string"), "s").alias("b"),
        text.direct_link(F.lit(None).cast("string"), F.lit(" "), F.lit(None).cast("string"), "s").alias("c"), audit.source_label(F.lit(" Overpass ")).alias("d"), audit.source_label(F.lit(None).cast("string")).alias("e"),
    ).first()
    assert tuple(row) == ("https://m/?q=It's%20(a)%20caf%C3%A9~%201%20%26%202%20St!", "u", "", "OpenStreetMap", "Other")


def test_review_leaning(spark):
    rows = [("weak", None, None, [], []), ("mixed", "strong", "high", [], ["bakery"]), ("mixed", "strong", "high", [], ["bakery", "v60"]), ("coffee_led", "strong", "high", ["no_specialty_signals"], []), (None, None, None, None, ["bakery"]), ("coffee_led", "medium", "elite", ["missing_story"], ["v60"])]
    df = spark.createDataFrame(rows, "b string, s string, d string, f array<string>, t array<string>")
    got = [r.x for r in df.select(scoring.leans_from_coffee(*map(F.col, "bsdft")).alias("x")).collect()]
    assert got == [True, True, False, True, False, False]


def test_queue_and_scans(spark):
    p = spark.createDataFrame([(1, "a", 1.0, 1.0, None), (2, "a", None, 1.0, False), (3, "a", 1.0, float("nan"), None), (4, "a", 1.0, 1.0, True), (5, "b", 1.0, None, None)], "ord int, city string, lat double, lon double, needs_coords boolean")
    assert [(r.ord, r.turn) for r in audit.to_geocode(p, 2).orderBy("ord").collect()] == [(2, 1), (3, 2), (5, 1)]
    e = spark.createDataFrame([("x", 1, "Samy Bar", 0.0, 0.01, {"amenity": "bar"}), ("y", 2, "SAMY coffee", 0.0, 0.02, {"shop": "Coffee"}), ("z", 0, "samy", 3.0, 3.0, {"amenity": "cafe"}), ("q", 3, None, 0.0, 0.0, {"addr:street": "Shlomo HaMelech"})], "id string, ord int, name string, lat double, lon double, tags map<string,string>")
    asked = spark.createDataFrame([("Samy", 0.0, 0.0), ("nobody", 0.0, 0.0)], "asked string, city_lat double, city_lon double")
    assert [(r.asked, r.id) for r in combine.name_scan(asked, e).collect()] == [("Samy", "y")]
    assert [r.id for r in combine.street_scan(e, asked.limit(1), "shlomo hamelech", 500.0).collect()] == ["q"]


def test_best_matches_equal_all_pairs_without_making_them(spark):
    """A hot point of many copies: kinds meet, and not their members."""
    import random

    from pyspark.sql import Window

    from waymark.operators import locate

    r = random.Random(7)
    names, streets = ["Café Zoo", "cafe  ZOO", "Zoo Bar", "Bar & Co", "x", "", None], ["Main St 1", "main st 1", None, ""]
    rows = [(i, i % 90, r.choice(names[:3]), r.choice(streets), 1.0, 1.0) for i in range(400)]
    rows += [(400 + i, i, r.choice(names), r.choice(streets), 1 + r.randint(0, 9) / 2000, 1 + r.randint(0, 9) / 2000) for i in range(120)]
    rows += [(600, 1, "alone", None, 5.0, 5.0), (601, 1, "no point", None, None, 1.0)]
    p = spark.createDataFrame(rows, "id int, ord int, name string, address string, lat double, lon double")
    c = p.toDF("cid", "cord", "cname", "caddress", "clat", "clon")
    got = {x.id: (x.cid, round(x.total, 9), x.strong) for x in matching.best_matches(p, c).collect()}
    pairs = locate.radius_join(p.drop("ord"), c.withColumnsRenamed({"clat": "city_lat", "clon": "city_lon"}), 0.7).filter("id != cid")
    pairs = pairs.withColumn("m", matching.match_score(F.col("name"), F.col("cname"), F.col("address"), F.col("caddress"), F.col("km") * 1000))
    w = Window.partitionBy("id").orderBy(F.desc("m.total"), "cord", "cid")
    want = {x.id: (x.cid, round(x.m.total, 9), x.m.strong) for x in pairs.withColumn("n", F.row_number().over(w)).filter("n = 1").collect()}
    assert got == want and len(want) == 520
    many = p.filter("id < 400").withColumn("id", F.explode(F.sequence(F.col("id") * 100, F.col("id") * 100 + 99)))  # 40,000 at one point
    kinds = matching.best_matches(many, many.toDF("cid", "cord", "cname", "caddress", "clat", "clon"))
    assert kinds.count() == 40_000  # 1.6e9 pairs, were they made


def test_strict_ids_keep_signs_and_cities(spark):
    ids = {"seeded-madrid-foo-40.41680--3.70380": ("foo", 40.4168, -3.7038), "seeded-madrid-foo-bar--1.50000-na": ("foo-bar", -1.5, None), "seeded-madrid-7": None, "node-5": None, "seeded-tel-aviv-x-1.00000-2.00000": ("aviv-x", 1.0, 2.0)}
    df = spark.createDataFrame([(i,) for i in ids], "i string")
    got = {r.i: (r.p and (r.p.name_key, r.p.lat, r.p.lon)) for r in df.select("i", text.parse_strict_id(F.col("i")).alias("p")).collect()}
    assert got == ids
    named = df.select("i", text.parse_strict_id(F.col("i"), F.lit("Tel Aviv")).alias("p")).filter("p is not null").collect()
    assert [(r.p.city_key, r.p.name_key) for r in named] == [("tel-aviv", "x")]


def test_a_replaced_table_leaves_a_copy(spark, tmp_path):
    from waymark.sources import writers

    path = str(tmp_path / "t")
    writers.replace_table(spark.range(3), path, "1")
    assert not (tmp_path / "t.before-1").exists()
    more = spark.read.parquet(path).filter("id > 0")
    assert writers.replace_table(more, path, "2", write=False).count() == 2 and spark.read.parquet(path).count() == 3
    writers.replace_table(more, path, "2")
    assert spark.read.parquet(path).count() == 2 and spark.read.parquet(path + ".before-2").count() == 3
