"""Rules on hand-written rows; expected values were worked out by reading the rules, not by running them."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from waymark.functions import decisions, geo, scoring, text


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'double' if isinstance(x, float) else 'map<string,string>' if isinstance(x, dict) else 'array<string>' if isinstance(x, list) else 'string'}" for k, x in values.items()))
    return row.select(column.alias("x")).first().x


@pytest.mark.parametrize(("a", "b"), [("52,5", 52.5), (" 7 ", 7.0), ("", None), ("x", None), ("NaN", None), ("Infinity", None), ("1,2,3", None), ("-0.5e1", -5.0)])
def test_parse_number(spark, a, b):
    assert one(spark, text.parse_number(F.col("a")), a=a) == b


def test_rounding_and_weights(spark):
    got = spark.range(1).select(*[text.js_round(F.lit(x)) for x in (-2.5, 2.5, -0.4, 0.5)]).first()
    assert list(got) == [-2, 3, 0, 1]
    assert tuple(spark.range(1).select(text.weight(0, -40), text.weight(None, 5), text.weight(-7, 1)).first()) == (-40.0, 5.0, -7.0)


def test_ids(spark):
    lat, lon = F.lit(40.4168), F.lit(-3.7038)
    sid = text.stable_id(F.lit("Madrid"), F.lit(" Foo  Bar! "), lat, lon)
    assert spark.range(1).select(sid).first()[0] == "seeded-madrid-foo-bar-40.41680--3.70380"
    assert spark.range(1).select(text.stable_id(F.lit(""), F.lit(None).cast("string"), F.lit(None).cast("double"), F.lit(float("nan")))).first()[0] == "seeded-city-unnamed-na-na"
    p = one(spark, text.parse_stable_id(F.col("a")), a="seeded-madrid-foo-40.41680--3.70380")
    assert (p.city_key, p.name_key, p.lat, p.lon) == ("madrid", "foo-40.41680", 0.0, 3.7038)
    p = one(spark, text.parse_stable_id(F.col("a")), a="seeded-haifa-foo-bar-32.80000-34.90000")
    assert (p.name_key, p.lat, p.lon) == ("foo-bar", 32.8, 34.9)
    assert one(spark, text.parse_stable_id(F.col("a")), a="seeded-Haifa-7") is None


def test_text_forms(spark):
    assert one(spark, text.squeeze(F.col("a")), a=" A   B\n") == "a b"
    assert one(spark, text.place_text(F.col("a")), a="Café  No. 7!") == "caf no 7"
    assert one(spark, text.ascii_word(F.col("a"), "soho"), a="12 frith st, soho") is True
    assert one(spark, text.ascii_word(F.col("a"), "יפו"), a="קפה יפו") is False
    assert one(spark, text.dice(text.bigrams(F.col("a")), text.bigrams(F.col("b"))), a="night", b="nacht") == 0.25
    assert one(spark, text.stable_hash(F.col("a")), a="ab") == 97 * 31 + 98
    assert one(spark, text.link_part(F.col("a")), a="a b&c") == "a%20b%26c"
    assert one(spark, text.area_of_notes(F.col("a")), a=" Area : Soho ") == "Soho"
    assert one(spark, text.domain(F.col("a")), a="https://WWW.Example.org/x") == "example.org"
    assert [one(spark, text.format_distance(F.col("a")), a=x) for x in (0.25, 3.14159, 12.5)] == ["250 m", "3.1 km", "13 km"]


@settings(max_examples=20, deadline=None)
@given(st.floats(-89, 89), st.floats(-179, 179), st.floats(-89, 89), st.floats(-179, 179))
def test_haversine_is_symmetric(spark, a, b, c, d):
    x, y = spark.range(1).select(geo.haversine_km(*map(F.lit, (a, b, c, d))), geo.haversine_km(*map(F.lit, (c, d, a, b)))).first()
    assert x == pytest.approx(y, abs=1e-6) and 0 <= x <= 20038


def test_distance_and_coordinates(spark):
    km = spark.range(1).select(geo.haversine_km(*map(F.lit, (0.0, 0.0, 0.0, 1.0)))).first()[0]
    assert km == pytest.approx(111.195, abs=0.001)
    o = spark.range(1).select(geo.oriented(F.lit(34.78), F.lit(32.08), F.lit(32.08), F.lit(34.78)).alias("o")).first().o
    assert (o.lat, o.lon, o.swapped) == (32.08, 34.78, True)
    assert spark.range(1).select(geo.oriented(F.lit(200.0), F.lit(95.0), F.lit(0.0), F.lit(0.0)).alias("o")).first().o is None
    null = F.lit(None).cast("double")
    best = spark.range(1).select(geo.best_coordinates([null, F.lit(10.0), F.lit(50.0)], [F.lit(20.0), F.lit(7.0)], F.lit(50.0), F.lit(7.0)).alias("b")).first().b
    assert (best.lat, best.lon) == (50.0, 7.0) and best.score == pytest.approx(0.002)


SCORES = [
    ("Zed Specialty Coffee", {}, 65.0, "coffee"), ("Aroma", {}, 10.0, "other"), ("Starbucks", {}, 10.0, "other"), ("The Barn Cafe", {"amenity": "cafe"}, 40.0, "bar"),
    ("Zed", {"amenity": "cafe"}, 50.0, "coffee"), ("Zed", {"amenity": "cafe", "specialty_coffee": "yes", "v60": "yes", "chemex": "no"}, 67.0, "coffee"),
]


@pytest.mark.parametrize(("name", "tags", "score", "kind"), SCORES)
def test_scores(spark, name, tags, score, kind):
    df = spark.createDataFrame([(name, tags)], "name string, tags map<string,string>")
    row = scoring.add_score(df, weights={"chainPenalty": 0}).first()
    assert (row.score, row.place_type) == (score, kind)
    assert df.columns + ["place_type", "confidence", "score", "reasons", "explanation"] == scoring.add_score(df).columns


def test_explanation_and_caps(spark):
    row = scoring.add_score(spark.createDataFrame([("Aroma", None)], "name string, tags map<string,string>")).first()
    assert [(r.label, r.points) for r in row.reasons] == [("Chain cafe", -40.0), ("Weak chain cap", 0.0)] and row.explanation == "Chain cafe"
    assert row.confidence == 0


def test_rating_ladder(spark):
    tags = F.create_map().cast("map<string,string>")
    cols = [scoring.boosted(F.lit(33.0), F.lit("bar"), F.lit(i), tags).alias(f"r{i}") for i in range(6)]
    row = spark.range(1).select(*cols).first()
    assert [x.score for x in row] == [33.0, 60.0, 70.0, 80.0, 90.0, 100.0] and [x.place_type for x in row] == ["bar"] * 3 + ["coffee"] * 3


def test_agent_rules(spark):
    t = scoring.tag_rules(F.col("a"), F.lit(80.0))
    assert one(spark, t, a="a quiet spot with v60") == ["specialty_coffee", "v60", "work_friendly"]
    assert one(spark, scoring.tag_evidence(F.col("a"), F.lit(80.0)), a="zed") == {"specialty_coffee": ["specialtyScore:80"]}
    c = scoring.agent_components(F.lit(80.0), F.lit("seeded"), F.array(F.lit("specialty_coffee")))
    assert spark.range(1).select(scoring.agent_score(c)).first()[0] == 62


@pytest.mark.parametrize(
    ("hours", "day", "minute", "want"),
    [("22:00-02:00", 1, 60, True), ("Mo,We 08:00-18:00", 1, 600, False), ("Mo,We 08:00-18:00", 3, 600, True), ("08:00-20:00", 0, 1200, True), ("Fr-Mo 10:00-12:00", 0, 660, True), ("Mo off", 1, 600, False), ("24/7", 2, 0, True), ("", 2, 0, None), (None, 2, 0, None)],
)
def test_hours(spark, hours, day, minute, want):
    assert spark.createDataFrame([(hours,)], "h string").select(decisions.is_open(F.col("h"), F.lit(day), F.lit(minute))).first()[0] is want


def test_decisions(spark):
    d = lambda t, mode="coffeeAndBakery", **k: one(spark, decisions.list_decision(F.col("t"), F.array().cast("array<string>"), F.lit(None).cast("string"), mode), t=t).reason
    assert d("zed espresso temporarily closed") == "temporarily closed" and d("zed gelato coffee") == "explicit non-coffee keyword" and d("waycup bar") == "explicit allowlist"
    assert d("zed") == "missing strict coffee/cafe keyword" and d("coffee barn") == "food/bar/dessert keyword" and d("coffee zed", "all") == "all mode" and d("coffee zed") == "coffee/bakery match"
    assert one(spark, decisions.city_locked_out(F.col("t"), F.lit("Haifa")), t="cafelix shlomo hamelech") is True
    al = F.array(F.struct(F.lit("haifa").alias("city_key"), F.lit("haifa").alias("alias")), F.struct(F.lit("tel aviv").alias("city_key"), F.lit("jaffa").alias("alias")))
    assert one(spark, decisions.conflicting_city(F.col("t"), F.lit("haifa"), al), t="zed, jaffa") is True
    assert one(spark, decisions.conflicting_city(F.col("t"), F.lit("haifa"), al), t="zed, jaffa road, haifa") is False


def value_of(spark, c):
    return spark.range(1).select(c.alias("x")).first().x


def test_curated_helpers(spark):
    from waymark.functions import curation as c

    lit, m = F.lit, lambda **k: F.create_map(*[x for a, b in k.items() for x in (F.lit(a), F.lit(b))])
    assert value_of(spark, c.normal_words(F.array(lit(" A "), lit(""), lit("a"), lit("B")))) == ["a", "b"]
    assert value_of(spark, c.normal_words(F.array(lit(" ")))) is None
    assert value_of(spark, c.city_aliases(lit(" Wien "), F.array(lit("vienna"), lit("WIEN")))) == ["wien", "vienna"]
    assert value_of(spark, c.exclusion_word(lit("a costa coffee house"), F.array(lit("house")), lit(True))) == "costa"
    assert value_of(spark, c.exclusion_word(lit("a costa coffee house"), F.array(lit("house")), lit(False))) == "house"
    assert [value_of(spark, c.radius_km(lit(x))) for x in ("Tel Aviv", "Haifa", "Nowhere")] == [5.0, 3.5, 3.5]
    assert [value_of(spark, c.display_city(lit(x))) for x in ("Ramat Gan", "X")] == ["Ramat Gan-Givataim", "X"]
    assert [value_of(spark, c.score_badge(c.shown_score(lit(s), lit(r)))) for s, r in ((95.0, 0), (94.0, 5), (79.0, 0), (60.0, 1), (49.9, 0))] == ["top", "high", "mid", "mid", "low"]
    assert value_of(spark, c.lookup_address(m(street="S", housenumber="5", postcode="100", district="D", countrycode="cz", country="Czechia"))) == "S 5, 100 D, Czech Republic"
    assert value_of(spark, c.first_image([lit(" "), lit(None).cast("string")], [F.array(lit(""), lit("b.png"))])) == "b.png"
    assert value_of(spark, c.query_texts((lit("A"), lit("X")), (lit("A"), lit("X"), lit("")), (lit(None).cast("string"),), (lit("B"),))) == ["A, X", "B"]
    assert [value_of(spark, c.city_of_url(lit(u), {"ny": "New York"})) for u in ("https://s.test/ny/", "https://s.test/tel-aviv/x", "none")] == ["New York", "Tel Aviv", None]
    texts = ["t0", "t1", "t2", "t3"]
    assert value_of(spark, c.card_text(lit("abc"), lit("n"), lit(False), texts, ["r"])) == texts[(97 * 31 * 31 + 98 * 31 + 99) % 4]
    assert value_of(spark, c.card_text(lit(""), lit("n"), lit(True), texts, ["r"])) == "r"


def test_agent_helpers(spark):
    from waymark.functions import agent as a

    lit, none, no_tags = F.lit, F.lit(None).cast("string"), F.array().cast("array<string>")
    assert value_of(spark, a.first_sentence(lit("  One  two! Three"))) == "One two!"
    assert len(value_of(spark, a.first_sentence(lit("x" * 300)))) == 180 and value_of(spark, a.first_sentence(none)) == ""
    assert value_of(spark, a.story(none, none, no_tags, none)) is None
    s = value_of(spark, a.story(none, lit(""), F.array(lit("pour_over"), lit("v60")), lit("website")))
    assert (s.summary, s.sources) == ("Known for pour over, v60.", ["tags", "website"])
    found = value_of(spark, a.sources(lit("https://www.A.example/x"), lit("https://a.example/y"), none, lit("https://maps.example/1"), lit("osm")))
    assert [(x.id, x.title, x.domain) for x in found] == [("website", "Official website (a.example)", "a.example"), ("source-url", "Source (official site)", "a.example"), ("gmaps-link", "Google Maps", "maps.example"), ("source-primary", "OSM", None)]
    assert value_of(spark, a.image(lit("https://x/place-photos/AL8z"), [none], none, none)) is None
    i = value_of(spark, a.image(lit("https://x/place-photos/AL8z"), [lit("w.png")], none, lit("https://www.b.example/")))
    assert (i.url, i.source, i.attribution) == ("w.png", "website", "b.example")
    assert [value_of(spark, a.story_quality(lit(t), F.array(lit("notes")))) for t in ("", "short one", "one two three four five six seven eight")] == ["weak", "medium", "strong"]
    parts = F.array(*[F.struct(lit(k).alias("key"), lit(p).alias("points")) for k, p in (("a", 1.0), ("b", -5.0), ("c", 5.0))])
    assert [x.key for x in value_of(spark, a.breakdown(parts))] == ["b", "c", "a"]


def test_coffee_only_mode(spark):
    from waymark.functions import decisions as d

    said = lambda text, types=(): value_of(spark, d.list_decision(F.lit(text), F.array(*[F.lit(t) for t in types]).cast("array<string>"), F.lit(None).cast("string"), "coffeeOnly"))
    assert said("foo coffee").reason == "coffeeOnly match" and said("foo coffee").included
    assert said("kaffee brunch").reason == "bakery/brunch without strong coffee-leading tags"
    assert said("kaffee brunch", ["cafe"]).reason == "not classified as coffee"
    assert said("kaffee").reason == "not classified as coffee"


def test_notes_are_cleaned(spark):
    from waymark.functions.text import clean_notes

    assert value_of(spark, clean_notes(F.lit("imported from X | good | | best"), ["imported from x"])) == "good | best"
    assert value_of(spark, clean_notes(F.lit("imported from x"), ["imported from x"])) is None
