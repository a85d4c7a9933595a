import json
import random

from pyspark.sql import functions as F

from waymark.operators import assign, matching
from waymark.sources import json_walk, readers, writers


def plain_walk(value, path=(), key=None):
    yield list(path), key, value
    items = value.items() if isinstance(value, dict) else enumerate(value) if isinstance(value, list) else ()
    for i, (k, v) in enumerate(items):
        yield from plain_walk(v, (*path, i), str(k))


def some_value(r, depth):
    kind = r.choice(["object", "array", "leaf"]) if depth else "leaf"
    if kind == "object":
        return {k: some_value(r, depth - 1) for k in r.sample(["zeta", "lat", "lng", "latitude", "longitude", "a b", "é", "geo.x"], r.randint(0, 5))}
    if kind == "array":
        return [some_value(r, depth - 1) for _ in range(r.randint(0, 3))]
    return r.choice([1, -2.5, True, False, None, "", "5.25", "x", '{"lat": 1, "lng": 2}', "https://lh3.GoogleUserContent.com/p/1", "http://lh3.googleusercontent.com/p/2"])


def plain_number(v):
    if isinstance(v, bool) or v is None:
        return float(bool(v))
    if isinstance(v, str):
        try:
            return float(v.strip() or 0)
        except ValueError:
            return None
    return float(v) if isinstance(v, int | float) else None


def plain_point(value):
    for _, _, v in plain_walk(value):
        if isinstance(v, dict):
            for a, b in json_walk.POINTS:
                if a in v and b in v and plain_number(v[a]) is not None and plain_number(v[b]) is not None:
                    return plain_number(v[a]), plain_number(v[b])
    return None


def documents(seed, n, depth=6):
    r = random.Random(seed)
    return [(i, some_value(r, depth)) for i in range(n)]


def test_values_come_in_the_order_of_the_document(spark):
    docs = documents(1, 60)
    df = spark.createDataFrame([(i, json.dumps(v, ensure_ascii=False), "x") for i, v in docs] + [(-1, "{broken", "x"), (-2, None, "x"), (-3, "", "x")], "id long, doc string, path string").drop("path")
    got = sorted(json_walk.walk(df, "doc").collect(), key=lambda x: (x.id, x.path))
    want = [(i, path, key) for i, v in sorted(docs) for path, key, _ in plain_walk(v)]
    assert [(x.id, x.path, x.key) for x in got] == want and len(want) > 300
    kinds = {dict: "object", list: "array", str: "string", bool: "boolean", int: "number", float: "number", type(None): "null"}
    values = [v for _, d in sorted(docs) for _, _, v in plain_walk(d)]
    assert [x.kind for x in got] == [kinds[type(v)] for v in values]
    assert all(x.text == v for x, v in zip(got, values, strict=True) if isinstance(v, str))
    assert json_walk.walk(df, "doc", depth=2).count() == sum(len(path) <= 2 for path in (w[1] for w in want))


def test_first_points_and_images_equal_a_plain_loop(spark):
    docs = documents(2, 300, 5)
    df = spark.createDataFrame([(i, json.dumps(v)) for i, v in docs], "id long, doc string")
    points = json_walk.points(df, "doc", ["id"]).groupBy("id").agg(F.min_by(F.struct("lat", "lon"), "path").alias("p"))
    want = {i: plain_point(v) for i, v in docs}
    assert {x.id: tuple(x.p) for x in points.collect()} == {i: p for i, p in want.items() if p} and sum(p is not None for p in want.values()) > 20
    images = json_walk.first_string(df, "doc", "id", json_walk.is_image(F.col("text"), "googleusercontent.com"))
    first = {i: next((v for path, _, v in plain_walk(d) if len(path) <= 6 and isinstance(v, str) and v.startswith("https://")), None) for i, d in docs}
    assert {x.id: x.text for x in images.collect()} == {i: v for i, v in first.items() if v}


def test_pages_give_linked_points_before_named_ones_and_markers(spark):
    linked = '<script type="application/ld+json">{0}</script>'
    pages = {
        "linked": linked.format("broken") + linked.format('{"@graph":[{"n":1},{"geo":{"longitude":"8.5","latitude":47}}]}') + '"latitude": 1, "longitude": 2',
        "second": linked.format('{"maxLatitude": 3}') + linked.format('[{"lat":"x","lng":2},{"lat":4,"lng":5}]'),
        "named": '{"maxLatitude": 1, "latitude": 2, "longitude": "-3.5"}',
        "long names only": '"maxLatitude": 1, "minLongitude": 2',
        "marker": "x/marker-cafe.png(9.5,45.25)/9.5,45.25,14",
        "map": "https://m.example/@1.5,2.5,15z",
        "none": "<p>",
        "null": None,
    }
    df = spark.createDataFrame(list(pages.items()), "name string, html string")
    got = {x.name: (x.lat, x.lon, x.stage) for x in readers.page_points(df, "name").collect()}
    assert got == {"linked": (47.0, 8.5, "linked"), "second": (4.0, 5.0, "linked"), "named": (2.0, -3.5, "text"), "marker": (45.25, 9.5, "text"), "map": (1.5, 2.5, "text")}


def test_lists_take_the_best_coordinates(spark, tmp_path):
    places = [{"name": "a", "lat": "52,5", "lon": 13.4}, {"name": "b", "lat": 13.4, "longitude": 52.5}, {"name": "c", "coords": {"lat": 52.4, "lng": 13.3}, "location": {"lat": 0, "lon": 0}}, {"name": "d", "lat": "x"}]
    (tmp_path / "l.json").write_text(json.dumps({"lists": [{"url": "u", "places": places}]}))
    got = {r.name: (r.lat, r.lon) for r in readers.lists(spark, f"{tmp_path}/l.json", (52.5, 13.4)).collect()}
    assert got == {"a": (52.5, 13.4), "b": (52.5, 13.4), "c": (52.4, 13.3), "d": (None, None)}
    assert {r.name: r.lat for r in readers.lists(spark, f"{tmp_path}/l.json").collect()} == {"a": 52.5, "b": 13.4, "c": 52.4, "d": None}


def test_a_scan_of_few_cities_reads_few_files(spark, tmp_path):
    rows = [(f"p{i}", f"City {i % 20}", float(i % 20), 1.0) for i in range(400)]
    places = spark.createDataFrame(rows, "id string, city string, lat double, lon double").coalesce(1)
    index = writers.write_by_city(places, f"{tmp_path}/places")
    index.write.parquet(f"{tmp_path}/index")
    some = spark.read.parquet(f"{tmp_path}/index").filter("lat >= 18")
    df = readers.city_places(spark, f"{tmp_path}/places", some)
    assert sorted(r.id for r in df.collect()) == sorted(r[0] for r in rows if r[2] >= 18)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan.lower()
    assert 0 < _files_read(df) <= 4  # 20 folders have a file each; two are asked for


def _files_read(df):
    """How many files the scan of the partitioned table read, of the plan that ran."""
    todo, read = [df._jdf.queryExecution().executedPlan()], -1
    while todo:
        node = todo.pop()
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
        elif kind.endswith("QueryStageExec"):
            todo.append(node.plan())
        elif kind == "FileSourceScanExec" and "dynamicpruning" in node.toString().lower():
            read = node.metrics().apply("numFiles").value()
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    return read


def plain_contained(asked, known):
    if not asked:
        return None
    exact = [k for _, k in known if k == asked]
    return exact[0] if exact else next((k for _, k in known if k and (k in asked or asked in k)), None)


def test_containment_equals_all_pairs(spark):
    r = random.Random(6)
    text = lambda n: "".join(r.choices("abcé", k=n))
    known = [(i, text(r.randint(0, 7))) for i in range(150)]
    asked = [text(r.randint(0, 9)) for _ in range(200)] + ["", None, "a", "zzz"]
    left = spark.createDataFrame([(i, t, "x") for i, t in enumerate(asked)], "id int, t string, ord string")
    right = spark.createDataFrame(known, "ord int, name string").withColumn("extra", F.col("ord") * 2)
    out = matching.contained(left, right, "t", "name", "ord")
    assert "CartesianProduct" not in out._jdf.queryExecution().executedPlan().toString() and "NestedLoop" not in out._jdf.queryExecution().executedPlan().toString()
    got = {x.id: (x.match.name if x.match else None) for x in out.collect()}
    assert got == {i: plain_contained(t, known) for i, t in enumerate(asked)}
    assert len({v for v in got.values() if v}) > 20


def plain_photos(places, candidates):
    out = {}
    for city in {p[2] for p in places}:
        own = sorted((p for p in places if p[2] == city), key=lambda p: p[1])
        by_photo = {}
        for p in own:
            if p[3]:
                by_photo.setdefault(p[3], []).append(p)
        used = {p[3] for p in own if p[3]}
        for p in own:
            out[p[0]] = p[3], None
        for photo, group in by_photo.items():
            for p in group[1:]:
                new = next((u for _, u in sorted(candidates.get(p[0], [])) if u and u not in used), None)
                if new:
                    used.add(new)
                out[p[0]] = (new or photo), new is not None
    return out


def test_photos_are_replaced_as_by_the_walk(spark):
    r = random.Random(9)
    places = [(f"p{i}", i, r.choice("ABC"), r.choice(["u1", "u2", "u3", "", None, f"own{i}"])) for i in range(150)]
    r.shuffle(places)
    candidates = {p[0]: [(k, f"c{r.randint(1, 60)}" if r.random() < 0.9 else "u1") for k in range(r.randint(0, 6))] for p in places}
    df = spark.createDataFrame(places, "id string, ord int, city string, photo_url string")
    wishes = spark.createDataFrame([(i, k, u) for i, c in candidates.items() for k, u in c], "id string, place int, url string")
    got = {x.id: (x.photo_url, x.replaced) for x in assign.replace_photos(df, wishes).collect()}
    want = plain_photos(places, candidates)
    assert got == want and sum(v[1] is True for v in want.values()) > 30 and sum(v[1] is False for v in want.values()) > 2


def test_a_chain_of_refusals_ends_like_the_walk(spark):
    wishes = [(t, k, f"t{k}") for t in range(12) for k in range(12)]  # all wish alike: eleven rounds of refusals
    got = {x.turn: x.thing for x in assign.in_turn(spark.createDataFrame(wishes, "turn int, place int, thing string")).collect()}
    assert got == {t: f"t{t}" for t in range(12)}
