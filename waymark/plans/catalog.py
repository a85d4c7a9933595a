"""Queries of the place operators over the given tables, and the same in DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import decisions, geo, scoring, text
from ..functions import vocab as v
from ..operators import audit, combine, dedupe, locate, matching, state
from ..sources import readers, writers
from ..streaming import live
from . import adapters, rank

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL (after the adapters' table expressions)."""

    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register


def _places(spark: SparkSession, sf: str) -> DataFrame:
    return adapters.places(spark, sf)


def _q(word: str) -> str:
    return "'" + word.replace("'", "''") + "'"


def _any(col: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({col}, {_q(w)})" for w in words) + ")"


def _hav(a: str, b: str, c: str, d: str) -> str:
    h = f"(power(sin(radians({c} - {a}) / 2), 2) + cos(radians({a})) * cos(radians({c})) * power(sin(radians({d} - {b}) / 2), 2))"
    return f"(6371 * 2 * atan2(sqrt({h}), sqrt(1 - {h})))"


def _set(keys: list[str]) -> str:
    have = [k for k in keys if f"tag_{k}" in adapters.PLACE_COLUMNS]
    return "list_filter([" + ", ".join(f"CASE WHEN coalesce(tag_{k}, '') NOT IN ('', 'no') THEN '{k}' END" for k in have) + "], lambda x: x IS NOT NULL)"


W = v.PRESETS["balanced"]
_PLACE = adapters.CTE
_TEXT = "lower(concat_ws(' ', nullif(name, ''), nullif(address, ''), nullif(description, '')))"
_YES = lambda c: f"coalesce({c}, '') <> ''"
_REASONS = [
    ("chain", "'Chain cafe'", W["chainPenalty"]), (f"n IN ({', '.join(_q(x) for g in v.GENERIC_NAMES for x in (g, 'the ' + g))})", "'Generic name'", W["genericPenalty"]),
    (f"{_any('n', v.SCORE_RESTAURANT)} AND NOT chain AND NOT special", "'Restaurant/bar'", W["restaurantPenalty"]), ("special", "'Specialty keyword'", W["specialtyKeywords"]),
    ("roaster AND NOT special", "'Roaster'", W["roaster"]), (_YES("tag_website"), "'Has website'", W["website"]), (_YES("tag_opening_hours"), "'Opening hours listed'", W["openingHours"]),
    ("tag_internet_access IN ('wlan', 'yes')", "'WiFi available'", W["wifiAccess"]), ("len(core) > 0", "'Specialty tag (' || array_to_string(core, ', ') || ')'", 15),
    ("len(roasting) > 0 AND NOT roaster", "'Roasting tag (' || array_to_string(roasting, ', ') || ')'", 12), ("len(brewing) > 0", "'Brew methods (' || array_to_string(brewing, ', ') || ')'", "least(10, 2 * len(brewing))"),
    ("len(equipment) > 0", "'Equipment (' || array_to_string(equipment, ', ') || ')'", "least(8, 2 * len(equipment))"), ("len(experience) > 0", "'Experience (' || array_to_string(experience, ', ') || ')'", "least(6, 2 * len(experience))"),
]
_CASES = ", ".join(f"CASE WHEN {c} THEN {{'label': {label}, 'points': CAST({p} AS DOUBLE)}} END" for c, label, p in _REASONS)
SCORED = f"""{_PLACE},
t0 AS (SELECT *, lower(name) AS n, lower(coalesce(tag_amenity, '')) AS am, lower(coalesce(tag_cuisine, '')) AS cu, lower(coalesce(tag_shop, '')) AS sh, lower(coalesce(tag_brand, '')) AS br FROM places),
t1 AS (SELECT *, n || ' ' || am || ' ' || cu || ' ' || sh AS al, {_any('n', v.TYPE_COFFEE)} OR {_any('cu', v.TYPE_COFFEE)} AS sig,
  {_any('n', v.CHAINS)} OR {_any('br', v.CHAINS)} AS chain, {_any('n', v.WEAK_CHAINS)} OR {_any('br', v.WEAK_CHAINS)} AS weak, {_any('n', v.SPECIALTY_WORDS)} AS special, {_any('n', v.ROASTER_WORDS)} AS roaster,
  {_set(v.CORE_TAGS)} AS core, {_set(v.ROASTING_TAGS)} AS roasting, {_set(v.BREWING_TAGS)} AS brewing, {_set(v.EQUIPMENT_TAGS)} AS equipment, {_set(v.EXPERIENCE_TAGS)} AS experience FROM t0),
t2 AS (SELECT *, CASE WHEN {_any('al', v.TYPE_BAR)} THEN 'bar' WHEN {_any('al', v.TYPE_RESTAURANT)} THEN 'restaurant' WHEN {_any('al', v.TYPE_OTHER)} AND NOT sig THEN 'other'
    WHEN am IN ('cafe', 'coffee') OR sh = 'coffee' OR sig THEN 'coffee' WHEN am = 'bakery' OR sh = 'bakery' OR {_any('n', ['bakery', 'boulangerie', 'bäckerei'])} THEN 'bakery' ELSE 'other' END AS place_type,
  least(100.0, {' + '.join([f"CASE WHEN {_YES(c)} THEN {p} ELSE 0 END" for c, p in (('tag_phone', 10), ('tag_website', 10), ('tag_email', 10), ('tag_opening_hours', 20), ('tag_addr_street', 7.5), ('tag_addr_city', 7.5), ('tag_amenity', 5), ('tag_cuisine', 5), ('tag_shop', 5), ('tag_brand', 5))])})::DOUBLE AS confidence,
  list_filter([{_CASES}], lambda x: x IS NOT NULL) AS r0 FROM t1),
t3 AS (SELECT *, 50 + coalesce(list_sum(list_transform(r0, lambda x: x.points)), 0) AS s FROM t2),
t4 AS (SELECT *, greatest(0.0, least(100.0, s)) AS s0 FROM t3), t5 AS (SELECT *, CASE WHEN weak THEN least(s0, 20.0) ELSE s0 END AS s1 FROM t4),
t6 AS (SELECT *, CASE WHEN place_type <> 'coffee' THEN least(s1, 40.0) ELSE s1 END AS s2, len(core) + len(roasting) + len(brewing) + len(equipment) + len(experience) > 0 AS verified FROM t5),
t7 AS (SELECT *, CASE WHEN confidence < 40 AND NOT verified THEN least(s2, 65.0) ELSE s2 END AS score FROM t6),
scored AS (SELECT *, list_concat(r0, list_filter([CASE WHEN weak THEN {{'label': 'Weak chain cap', 'points': s1 - s}} END, CASE WHEN s2 <> s1 THEN {{'label': 'Not pure coffee (score cap)', 'points': s2 - s1}} END,
  CASE WHEN score <> s2 THEN {{'label': 'Low data (score cap)', 'points': score - s2}} END], lambda x: x IS NOT NULL)) AS reasons FROM t7)"""


@query(f"WITH {SCORED} SELECT id, place_type FROM scored")
def classify_rules(spark, sf):
    return _places(spark, sf).select("id", scoring.classify(F.col("tags"), F.col("name")).alias("place_type"))


@query(f"WITH {SCORED} SELECT id, confidence FROM scored")
def confidence(spark, sf):
    return _places(spark, sf).select("id", scoring.confidence(F.col("tags")).alias("confidence"))


@query(f"WITH {SCORED} SELECT id, score::DOUBLE AS score, place_type FROM scored")
def specialty_score(spark, sf):
    return rank.scored(_places(spark, sf)).select("id", "score", "place_type")


@query(f"""WITH {SCORED}, l AS (SELECT *, array_to_string(list_transform(list_filter(reasons, lambda x: x.points > 0), lambda x: x.label), ', ') AS up,
  array_to_string(list_transform(list_filter(reasons, lambda x: x.points < 0), lambda x: x.label), ', ') AS down, array_to_string(list_transform(reasons[1:2], lambda x: x.label), ', ') AS two FROM scored)
SELECT id, array_to_string(list_transform(reasons, lambda x: x.label || '=' || x.points::VARCHAR), ';') AS reasons,
  CASE WHEN len(reasons) = 0 THEN 'Standard cafe' WHEN score >= 60 THEN coalesce(nullif(up, ''), 'Looks promising') WHEN score <= 30 THEN coalesce(nullif(down, ''), 'Likely generic') ELSE coalesce(nullif(two, ''), 'Mixed signals') END AS explanation FROM l""")
def score_explain(spark, sf):
    reasons = F.array_join(F.transform("reasons", lambda x: F.concat(x["label"], F.lit("="), x["points"].cast("string"))), ";")
    return rank.scored(_places(spark, sf)).select("id", reasons.alias("reasons"), "explanation")


@query(f"WITH {_PLACE}, d AS (SELECT id, c.city, c.city_key, {_hav('p.lat', 'p.lon', 'c.city_lat', 'c.city_lon')} AS km FROM places p, cities c) SELECT id, arg_min(city, (km, city_key)) AS nearest_city, round(min(km), 6) AS nearest_km FROM d GROUP BY id")
def haversine_nearest_city(spark, sf):
    out = locate.nearest(_places(spark, sf).drop("city", "city_lat", "city_lon"), adapters.cities(spark, sf), F.col("lat"), F.col("lon"))
    return out.select("id", "nearest_city", F.round("nearest_km", 6).alias("nearest_km"))


@query(f"WITH {_PLACE}, d AS (SELECT id, c.city, {_hav('p.lat', 'p.lon', 'c.city_lat', 'c.city_lon')} AS km FROM places p, cities c) SELECT id, city, round(km, 6) AS km FROM d WHERE km <= 500")
def radius_join(spark, sf):
    left = _places(spark, sf).select("id", "lat", "lon")
    return locate.radius_join(left, adapters.cities(spark, sf), 500.0).select("id", "city", F.round("km", 6).alias("km"))


@query(f"WITH {_PLACE} SELECT id, lon < 34.742 + (lat - 32.02) * 0.35 - 0.0015 AS offshore FROM places")
def offshore_predicate(spark, sf):
    return _places(spark, sf).select("id", geo.offshore(F.col("lat"), F.col("lon")).alias("offshore"))


@query(f"""WITH {_PLACE}, s AS (SELECT *, CASE WHEN ord % 2 = 0 THEN lon ELSE lat END AS a, CASE WHEN ord % 2 = 0 THEN lat ELSE lon END AS b FROM places),
o AS (SELECT *, abs(a) <= 90 AND abs(b) <= 180 AS d, abs(b) <= 90 AND abs(a) <= 180 AS w, {_hav('city_lat', 'city_lon', 'b', 'a')} + 0.2 < {_hav('city_lat', 'city_lon', 'a', 'b')} AS nearer FROM s),
r AS (SELECT *, CASE WHEN d AND w AND nearer THEN true WHEN d THEN false WHEN w THEN true END AS swapped FROM o)
SELECT id, round(CASE WHEN swapped THEN b ELSE a END, 6) AS lat, round(CASE WHEN swapped THEN a ELSE b END, 6) AS lon, swapped FROM r""")
def swap_coords(spark, sf):
    p = _places(spark, sf)
    even = F.col("ord") % 2 == 0
    o = geo.oriented(F.when(even, F.col("lon")).otherwise(F.col("lat")), F.when(even, F.col("lat")).otherwise(F.col("lon")), F.col("city_lat"), F.col("city_lon"))
    return p.withColumn("o", o).select("id", F.round("o.lat", 6).alias("lat"), F.round("o.lon", 6).alias("lon"), "o.swapped")


_BOOST = """b AS (SELECT s.*, coalesce(r.rating, 0) AS rating FROM scored s LEFT JOIN ratings r ON s.id = r.place_id)"""


@query(f"""WITH {SCORED}, {_BOOST} SELECT id, CASE rating WHEN 1 THEN 60.0 WHEN 2 THEN 70.0 WHEN 3 THEN 80.0 WHEN 4 THEN 90.0 WHEN 5 THEN 100.0 ELSE CASE WHEN place_type = 'coffee' AND verified THEN 100.0 ELSE score END END::DOUBLE AS score,
  CASE WHEN rating >= 3 THEN 'coffee' ELSE place_type END AS place_type FROM b""")
def rating_boost(spark, sf):
    df = rank.scored(_places(spark, sf)).join(adapters.ratings(spark, sf), F.col("id") == F.col("place_id"), "left")
    return df.withColumn("b", scoring.boosted(F.col("score"), F.col("place_type"), F.col("rating"), F.col("tags"))).select("id", "b.score", "b.place_type")


@query(f"WITH {SCORED} SELECT id, (CASE WHEN trim(coalesce(address, '')) <> '' THEN 50 ELSE 0 END + 10 * CASE source WHEN 'manual' THEN 4 WHEN 'seeded' THEN 3 WHEN 'osm' THEN 2 WHEN 'google' THEN 1 ELSE 0 END + floor(score / 10 + 0.5))::BIGINT AS quality FROM scored")
def quality_score(spark, sf):
    return rank.scored(_places(spark, sf)).select("id", scoring.quality(F.col("address"), F.col("source"), F.col("score")).cast("long").alias("quality"))


_LISTED = f"""CASE WHEN {_any('tx', v.CLOSED_WORDS)} THEN 'temporarily closed' WHEN {_any('tx', v.EXCLUDED_WORDS)} THEN 'explicit non-coffee keyword' WHEN {_any('tx', v.ALLOWED_WORDS)} THEN 'explicit allowlist'
  WHEN NOT {_any('tx', v.STRICT_COFFEE_WORDS)} THEN 'missing strict coffee/cafe keyword' WHEN {_any('tx', v.FOOD_WORDS)} THEN 'food/bar/dessert keyword'"""


@query(f"""WITH {_PLACE}, d AS (SELECT city, {_TEXT} AS tx FROM places), r AS (SELECT city, {_LISTED} WHEN {_any('tx', v.COFFEE_WORDS)} OR {_any('tx', v.BAKERY_WORDS)} THEN 'coffee/bakery match' ELSE 'not coffee/bakery' END AS reason FROM d)
SELECT city, reason, reason IN ('explicit allowlist', 'coffee/bakery match') AS included, count(*)::BIGINT AS n FROM r GROUP BY ALL""")
def decision_reason_counts(spark, sf):
    p = _places(spark, sf)
    d = decisions.list_decision(rank.text_of(p), F.array().cast("array<string>"), F.lit(None).cast("string"))
    return p.withColumn("d", d).groupBy("city", F.col("d.reason").alias("reason"), F.col("d.included").alias("included")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {_PLACE}, d AS (SELECT id, {_TEXT} AS tx, lower(coalesce(tag_cuisine, '')) AS cu, lower(coalesce(tag_shop, '')) AS sh, lower(coalesce(tag_amenity, '')) AS am FROM places), e AS (SELECT *, concat_ws(' ', tx, nullif(cu, '')) AS w FROM d)
SELECT id, CASE WHEN {_any('tx', v.ALLOWED_WORDS)} THEN 'explicit allowlist' WHEN {_any('tx', v.EXCLUDED_WORDS)} THEN 'explicit non-coffee keyword' WHEN {_any('w', v.FOOD_WORDS + v.BAKERY_WORDS + v.MORE_SWEET_WORDS)} THEN 'non-coffee signal (dessert/boba/food)'
  WHEN NOT (sh = 'coffee' OR {_any('cu', v.CUISINE_COFFEE)} OR {_any('w', v.STRICT_COFFEE_WORDS)}) THEN 'missing strong coffee signal' WHEN NOT (am IN ('cafe', 'coffee') OR sh = 'coffee') THEN 'type is not cafe/coffee' ELSE 'strict coffee match' END AS reason FROM e""")
def map_decision(spark, sf):
    p = _places(spark, sf)
    return p.select("id", decisions.map_decision(rank.text_of(p), F.col("tags"))["reason"].alias("reason"))


@query(f"""WITH {SCORED}, d AS (SELECT *, {_TEXT} AS tx FROM scored), r AS (SELECT *, {_LISTED} WHEN {_any('tx', v.COFFEE_WORDS)} OR {_any('tx', v.BAKERY_WORDS)} THEN NULL ELSE 'not coffee/bakery' END AS dr FROM d)
SELECT ord, id, coalesce(nullif(dr, 'explicit allowlist'), 'score below minimum') AS reason FROM r WHERE coalesce(nullif(dr, 'explicit allowlist'), CASE WHEN score < 60 THEN 'x' END) IS NOT NULL ORDER BY ord LIMIT 40""")
def exclusion_audit(spark, sf):
    p = rank.scored(_places(spark, sf))
    d = decisions.list_decision(rank.text_of(p), F.array().cast("array<string>"), F.lit(None).cast("string"))
    return audit.excluded_rows(p, d, F.col("score"), 60).select("ord", "id", "reason")


@query(f"""WITH {_PLACE}, k AS (SELECT CASE WHEN trim(source) = '' THEN 'other' WHEN source IN ('osm', 'overpass') THEN 'osm' ELSE source END AS source_key FROM places)
SELECT source_key, count(*)::BIGINT AS n, CASE source_key WHEN 'google' THEN 1 WHEN 'seeded' THEN 2 WHEN 'manual' THEN 3 WHEN 'osm' THEN 4 ELSE 5 END::BIGINT AS place FROM k GROUP BY 1""")
def source_facets(spark, sf):
    return audit.source_facets(_places(spark, sf))


@query(f"WITH {_PLACE} SELECT DISTINCT city, country FROM places")
def distinct_countries(spark, sf):
    return _places(spark, sf).select("city", "country").distinct()


_AREAS = [(i, f"Area {i}", [f"area {i}", w]) for i, w in enumerate(("espresso", "v60", "kitchen", "brand#1"))]


@query(f"""WITH {_PLACE} SELECT id, CASE {' '.join(f"WHEN regexp_matches(lower(name || ' ' || coalesce(address, '')), '(^|[^A-Za-z0-9_]){a[2][1]}($|[^A-Za-z0-9_])') THEN '{a[1]}'" for a in _AREAS)} END AS area FROM places""")
def distinct_areas(spark, sf):
    areas = spark.createDataFrame([(c, *a) for c in range(25) for a in _AREAS], "city_key int, ord int, canonical string, variants array<string>")
    return locate.area(_places(spark, sf), areas, F.concat_ws(" ", "name", F.coalesce("address", F.lit("")))).select("id", "area")


@query(f"""WITH {_PLACE}, g AS (SELECT lower(trim(name)) AS normalized, arg_max(name, (length(name), -ord)) AS name, count(*)::BIGINT AS n, list_sort(list(DISTINCT city)) AS cities FROM places GROUP BY 1)
SELECT normalized, name, n, array_to_string(cities, ',') AS cities FROM g WHERE n >= 3 AND len(cities) >= 2""")
def chain_audit(spark, sf):
    return audit.chains(_places(spark, sf)).withColumn("cities", F.array_join("cities", ","))


@query(f"""WITH {_PLACE}, g AS (SELECT lower(trim(name)) AS normalized, count(*)::BIGINT AS n, count(DISTINCT city) AS c FROM places GROUP BY 1) SELECT normalized, n FROM g WHERE n >= 3 AND c >= 2 ORDER BY n DESC, normalized LIMIT 80""")
def repeat_names_having(spark, sf):
    return audit.chains(_places(spark, sf)).select("normalized", "n").orderBy(F.desc("n"), "normalized").limit(80)


_HINTS = ["starbucks", "aroma", "bubble", "kitchen"]


@query(f"""WITH {_PLACE}, k AS (SELECT name, city, CASE {' '.join(f"WHEN contains(lower(name), '{w}') THEN '{w}'" for w in _HINTS)} END AS keyword FROM places)
SELECT name, keyword, count(*)::BIGINT AS n, array_to_string(list_sort(list(DISTINCT city)), ',') AS cities FROM k WHERE keyword IS NOT NULL GROUP BY 1, 2""")
def keyword_groups(spark, sf):
    p = _places(spark, sf)
    return audit.keyword_groups(p, text.first_of(F.lower(F.col("name")), _HINTS)).withColumn("cities", F.array_join("cities", ","))


@query(f"WITH {_PLACE} SELECT city, count(*)::BIGINT AS n FROM places WHERE trim(coalesce(address, '')) = '' GROUP BY 1 ORDER BY n DESC, city LIMIT 15")
def missing_addresses(spark, sf):
    return audit.missing_by_city(_places(spark, sf))


@query(f"""WITH {_PLACE}, g AS (SELECT city, round(avg(lat), 6) AS lat, round(avg(lon), 6) AS lon, count(*)::BIGINT AS n FROM places GROUP BY 1),
s AS (SELECT *, regexp_replace(regexp_replace(lower(city), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS b FROM g)
SELECT city, lat, lon, n, CASE WHEN row_number() OVER (PARTITION BY b ORDER BY city) = 1 THEN b ELSE b || '-' || row_number() OVER (PARTITION BY b ORDER BY city) END AS city_slug FROM s""")
def centroid_by_city(spark, sf):
    i = writers.city_index(_places(spark, sf))
    return i.select("city", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"), "n", "city_slug")


@query(f"WITH {_PLACE} SELECT city, round(min(lat), 6) AS south, round(max(lat), 6) AS north, round(min(lon), 6) AS west, round(max(lon), 6) AS east FROM places GROUP BY 1")
def bbox_by_city(spark, sf):
    r = lambda c, n: F.round(c, 6).alias(n)
    return _places(spark, sf).groupBy("city").agg(r(F.min("lat"), "south"), r(F.max("lat"), "north"), r(F.min("lon"), "west"), r(F.max("lon"), "east"))


@query(f"WITH {_PLACE} SELECT id FROM places p WHERE ord % 2 = 0 AND NOT EXISTS (SELECT 1 FROM places q WHERE q.ord % 2 = 1 AND q.city_key = p.city_key AND lower(q.name) = lower(p.name))")
def name_anti_join(spark, sf):
    p = _places(spark, sf)
    return combine.names_not_in(p.filter("ord % 2 = 0"), p.filter("ord % 2 = 1")).select("id")


_KEY = "regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(trim({0})), '\\s+', '-', 'g'), '[^a-z0-9-]', '', 'g'), '-+', '-', 'g'), '^-+|-+$', '', 'g')"


@query(f"""WITH {_PLACE}, h AS (SELECT 'part-' || c_custkey AS k FROM customer WHERE c_custkey % 3 = 0 UNION SELECT 'hidden-name-' || {_KEY.format('city')} || '-' || {_KEY.format('name')} FROM places WHERE ord % 40 = 0)
SELECT id FROM places WHERE id NOT IN (SELECT k FROM h) AND 'hidden-name-' || {_KEY.format('city')} || '-' || {_KEY.format('name')} NOT IN (SELECT k FROM h)""")
def hidden_anti_join(spark, sf):
    p = _places(spark, sf).withColumn("keys", state.hide_keys(F.col("id"), F.lit(None).cast("array<string>"), F.col("city"), F.col("name")))
    named = p.filter("ord % 40 = 0").select(F.element_at("keys", -1).alias("place_key"))
    ids = adapters.read(spark, sf, "customer").filter("c_custkey % 3 = 0").select(F.concat(F.lit("part-"), F.col("c_custkey").cast("string")).alias("place_key"))
    return state.not_hidden(p, state.merge_hidden(ids, named), F.col("keys")).select("id")


@query(f"""WITH {_PLACE}, a AS (SELECT 'seeded-name-' || {_KEY.format('city')} || '-' || {_KEY.format('name')} AS k, min(ord) % 5 AS r FROM places WHERE ord % 50 = 7 GROUP BY 1),
c AS (SELECT p.id, coalesce(nullif(r1.rating, 0), nullif(r2.rating, 0), nullif(a.r, 0), 0) AS rating FROM places p LEFT JOIN ratings r1 ON r1.place_id = p.id LEFT JOIN ratings r2 ON r2.place_id = 'part-' || (p.ord - 1000)
  LEFT JOIN a ON a.k = 'seeded-name-' || {_KEY.format('p.city')} || '-' || {_KEY.format('p.name')}) SELECT id, rating::INT AS rating FROM c""")
def rating_cascade(spark, sf):
    p = _places(spark, sf).withColumn("legacy", F.array(F.concat(F.lit("part-"), (F.col("ord") - 1000).cast("string"))))
    alias = F.concat(F.lit("seeded-name-"), text.id_part(F.col("city")), F.lit("-"), text.id_part(F.col("name")))
    named = p.filter("ord % 50 = 7").groupBy(alias.alias("place_id")).agg((F.min("ord") % 5).cast("int").alias("rating"))
    ratings = adapters.ratings(spark, sf).unionByName(named).withColumn("ord", F.xxhash64("place_id"))
    return state.rating_cascade(p, ratings).select("id", F.col("rating").cast("int").alias("rating"))


@query(f"""WITH {SCORED}, o AS (SELECT 'part-' || s_suppkey AS oid, s_suppkey AS k, s_acctbal FROM supplier), j AS (SELECT s.*, o.*, coalesce(k % 5 = 0, false) AS gone FROM scored s LEFT JOIN o ON oid = id)
SELECT id, CASE WHEN k % 2 = 0 THEN '' WHEN k % 2 = 1 THEN 'moved ' || k ELSE address END AS address, CASE WHEN k % 3 = 0 THEN greatest(0.0, least(100.0, s_acctbal)) ELSE score END::DOUBLE AS score FROM j WHERE NOT gone""")
def override_patch(spark, sf):
    k = F.col("s_suppkey")
    fields = F.filter(F.array(F.struct(F.lit("address").alias("key"), F.when(k % 2 == 0, "").otherwise(F.concat(F.lit("moved "), k.cast("string"))).alias("value")), F.when(k % 3 == 0, F.struct(F.lit("specialtyScore").alias("key"), F.col("s_acctbal").cast("string").alias("value")))), lambda x: x.isNotNull())
    o = adapters.read(spark, sf, "supplier").select(F.concat(F.lit("part-"), k.cast("string")).alias("id"), F.map_from_entries(fields).alias("patch"), (k % 5 == 0).alias("deleted"))
    p = rank.scored(_places(spark, sf)).withColumn("legacy", F.array().cast("array<string>"))
    return rank.overlay(p, o).select("id", "address", "score")


@query("""WITH r AS (SELECT user_id % 100 AS k, 1 + event_id % 5 AS rating, event_type FROM events) SELECT 'u' || k AS place_id, max(rating)::INT AS rating FROM r GROUP BY 1""")
def ratings_max_merge(spark, sf):
    e = adapters.read(spark, sf, "events").select(F.concat(F.lit("u"), (F.col("user_id") % 100).cast("string")).alias("place_id"), (1 + F.col("event_id") % 5).cast("int").alias("rating"), "event_type")
    return state.merge_ratings(e.filter("event_type = 'click'"), e.filter("event_type != 'click' or event_type is null"))


@query("SELECT DISTINCT 'k' || c_nationkey AS place_key FROM customer UNION SELECT 'k' || (s_nationkey + 10) FROM supplier")
def ids_union_distinct(spark, sf):
    k = lambda t, c, d: adapters.read(spark, sf, t).select(F.concat(F.lit("k"), (F.col(c) + d).cast("string")).alias("place_key"))
    return state.merge_hidden(k("customer", "c_nationkey", 0), k("supplier", "s_nationkey", 10))


@query(f"""WITH {_PLACE}, u AS (SELECT *, regexp_replace(regexp_replace(url, '#.*$', ''), '/$', '') AS k, 't' || (ord % 3) AS ty FROM places)
SELECT k AS url, min(ord)::BIGINT AS ord, arg_min(name, ord) AS name, arg_min(address, ord) FILTER (address IS NOT NULL) AS address, array_to_string(list_sort(list(DISTINCT ty)), ',') AS types FROM u GROUP BY 1""")
def url_merge(spark, sf):
    p = _places(spark, sf).withColumn("types", F.array(F.concat(F.lit("t"), (F.col("ord") % 3).cast("string"))))
    key = F.regexp_replace(F.regexp_replace("url", "#.*$", ""), "/$", "")
    out = dedupe.merge_by_key(p, key, "ord", ["name", "address"], ["types"])
    return out.select(F.col("_key").alias("url"), "ord", "name", "address", F.array_join(F.array_sort("types"), ",").alias("types"))


@query(f"WITH {SCORED} SELECT id, lower(name) AS n, score::DOUBLE AS score FROM (SELECT *, row_number() OVER (PARTITION BY lower(name) ORDER BY score DESC, ord) AS r FROM scored) WHERE r = 1")
def best_per_name(spark, sf):
    return dedupe.best_of(rank.scored(_places(spark, sf)), F.lower("name"), F.desc("score"), F.col("ord")).select("id", F.lower("name").alias("n"), "score")


_GENERIC = ", ".join(_q(t) for t in v.GENERIC_TOKENS)
_PAIRS = f"""b AS (SELECT id, ord, city_key, lat, lon, floor(lat / 0.001)::BIGINT AS g, regexp_replace(lower(trim(name)), '[^a-z0-9 ]', '', 'g') AS n, regexp_replace(lower(trim(coalesce(address, ''))), '[^a-z0-9 ]', '', 'g') AS a FROM places),
e AS (SELECT *, unnest([g - 1, g, g + 1]) AS gg FROM b),
m AS (SELECT x.id AS a, y.id AS b, {_hav('x.lat', 'x.lon', 'y.lat', 'y.lon')} * 1000 AS metres, x.n AS na, y.n AS nb, x.a AS aa, y.a AS ab FROM b x JOIN e y ON x.city_key = y.city_key AND x.g = y.gg AND x.ord < y.ord AND abs(x.lon - y.lon) < 0.01),
s AS (SELECT *, CASE WHEN length(na) <= length(nb) THEN na ELSE nb END AS sh, CASE WHEN length(na) <= length(nb) THEN nb ELSE na END AS lo FROM m),
pairs AS (SELECT a, b, metres FROM s WHERE (aa <> '' AND aa = ab AND metres <= 90) OR (na <> '' AND na = nb AND metres <= 90) OR (length(sh) >= 3 AND sh NOT IN ({_GENERIC}) AND contains(lo, sh) AND metres <= 90) OR (metres <= 18 AND ((na <> '' AND na = nb) OR aa = '' OR ab = '')))"""


@query(f"WITH {_PLACE}, {_PAIRS} SELECT a, b, round(metres, 6) AS metres FROM pairs")
def geo_dedupe_pairs(spark, sf):
    return dedupe.duplicate_pairs(_places(spark, sf), digits=6)


@query()
def geo_dedupe_greedy(spark, sf):
    p = rank.scored(_places(spark, sf)).withColumn("quality", scoring.quality(F.col("address"), F.col("source"), F.col("score")).cast("double"))
    return dedupe.greedy_near(p).select("id", "city", "name", "quality")


_NEXT = "x AS (SELECT p.id, p.name AS n1, q.name AS n2 FROM places p JOIN places q ON q.ord = p.ord + 12)"


def _next_pairs(spark, sf):
    p = _places(spark, sf)
    return p.select("id", F.col("name").alias("n1"), (F.col("ord") + 12).alias("o")).join(p.select(F.col("name").alias("n2"), F.col("ord").alias("o")), "o")


@query(f"""WITH {_PLACE}, {_NEXT}, t AS (SELECT id, list_distinct(string_split(lower(n1), ' ')) AS a, list_distinct(string_split(lower(n2), ' ')) AS b FROM x) SELECT id, round(len(list_intersect(a, b))::DOUBLE / (len(a) + len(b) - len(list_intersect(a, b))), 6) AS jaccard FROM t""")
def token_jaccard(spark, sf):
    return _next_pairs(spark, sf).select("id", F.round(text.jaccard(text.tokens(F.col("n1")), text.tokens(F.col("n2"))), 6).alias("jaccard"))


@query(f"""WITH {_PLACE}, {_NEXT}, t AS (SELECT id, replace(lower(n1), ' ', '') AS a, replace(lower(n2), ' ', '') AS b FROM x),
g AS (SELECT id, list_distinct(list_transform(range(1, length(a)), lambda i: substr(a, i, 2))) AS a, list_distinct(list_transform(range(1, length(b)), lambda i: substr(b, i, 2))) AS b FROM t) SELECT id, round(2.0 * len(list_intersect(a, b)) / (len(a) + len(b)), 6) AS dice FROM g""")
def bigram_dice(spark, sf):
    return _next_pairs(spark, sf).select("id", F.round(text.dice(text.bigrams(F.col("n1")), text.bigrams(F.col("n2"))), 6).alias("dice"))


@query()
def photo_match_best(spark, sf):
    p = _places(spark, sf).select("id", "ord", "name", "address", "lat", "lon")
    c = p.select(F.col("id").alias("cid"), F.col("ord").alias("cord"), F.col("name").alias("cname"), F.col("address").alias("caddress"), F.col("lat").alias("clat"), F.col("lon").alias("clon"))
    return matching.best_matches(p, c).select("id", "cid", F.round("total", 6).alias("total"), "strong")


@query(f"""WITH {_PLACE}, h AS (SELECT id, lower(opening_hours) AS h, unnest(string_split_regex(lower(opening_hours), '[;,]')) AS raw FROM places WHERE opening_hours <> ''),
k AS (SELECT id, h, trim(raw) AS p, regexp_extract(trim(raw), '([a-z]{{2}})(?:-([a-z]{{2}}))?\\s+(\\d{{1,2}}):(\\d{{2}})-(\\d{{1,2}}):(\\d{{2}})', ['a', 'b', 'c', 'd', 'e', 'f']) AS m, regexp_extract(trim(raw), '^(\\d{{1,2}}):(\\d{{2}})-(\\d{{1,2}}):(\\d{{2}})$', ['c', 'd', 'e', 'f']) AS t FROM h),
z AS (SELECT id, h, p, m.a AS a, list_position(['su', 'mo', 'tu', 'we', 'th', 'fr', 'sa'], m.a) - 1 AS d1, list_position(['su', 'mo', 'tu', 'we', 'th', 'fr', 'sa'], coalesce(nullif(m.b, ''), m.a)) - 1 AS d2,
  try_cast(coalesce(nullif(m.c, ''), t.c) AS INT) * 60 + try_cast(coalesce(nullif(m.d, ''), t.d) AS INT) AS s, try_cast(coalesce(nullif(m.e, ''), t.e) AS INT) * 60 + try_cast(coalesce(nullif(m.f, ''), t.f) AS INT) AS e FROM k),
o AS (SELECT id, bool_or(contains(h, '24/7') OR (NOT contains(p, 'off') AND s IS NOT NULL AND (a = '' OR CASE WHEN d1 <= d2 THEN 3 BETWEEN d1 AND d2 ELSE 3 >= d1 OR 3 <= d2 END) AND CASE WHEN s <= e THEN 600 BETWEEN s AND e ELSE 600 >= s OR 600 <= e END)) AS op FROM z GROUP BY id)
SELECT p.id, o.op AS open, CASE WHEN p.source = 'google' OR o.op IS NULL THEN 1 WHEN o.op THEN 0 ELSE 2 END AS live_rank FROM places p LEFT JOIN o USING (id)""")
def open_status_rank(spark, sf):
    o = decisions.is_open(F.col("opening_hours"), F.lit(3), F.lit(600))
    p = _places(spark, sf).withColumn("open", o)
    return p.select("id", "open", F.when((F.col("source") == "google") | F.col("open").isNull(), 1).when(F.col("open"), 0).otherwise(2).alias("live_rank"))


@query(f"WITH {_PLACE}, u AS (SELECT id, 1 AS stage FROM places WHERE ord % 3 = 0 UNION ALL SELECT id, 2 FROM places), f AS (SELECT min(stage) AS s FROM u) SELECT id, stage FROM u, f WHERE stage = s")
def fallback_cascade(spark, sf):
    p = _places(spark, sf).select("id", "ord")
    return audit.fallback([p.filter("ord < 0"), p.filter("ord % 3 = 0"), p], filtered=False).select("id", "stage")


_TAGTEXT = "lower(trim(concat_ws(' ', nullif(name, ''), nullif(description, ''), nullif(trim(source), ''))))"
_TAGS = f"""g AS (SELECT *, {_TAGTEXT} AS tt FROM scored), h AS (SELECT *, list_filter([{', '.join(f"CASE WHEN {_any('tt', w)} THEN '{t}' END" for t, w in v.TAG_RULES)}], lambda x: x IS NOT NULL) AS t0 FROM g),
tagged AS (SELECT *, list_sort(CASE WHEN score >= 80 AND NOT list_contains(t0, 'specialty_coffee') THEN list_append(t0, 'specialty_coffee') ELSE t0 END) AS tg FROM h)"""


def _tagged(spark, sf):
    p = rank.scored(_places(spark, sf))
    tt = F.lower(F.trim(F.concat_ws(" ", F.nullif("name", F.lit("")), F.nullif("description", F.lit("")), F.nullif(F.trim("source"), F.lit("")))))
    return p.withColumn("tt", tt).withColumn("tg", scoring.tag_rules(F.col("tt"), F.col("score")))


@query(f"WITH {SCORED}, {_TAGS} SELECT id, array_to_string(tg, ',') AS tags FROM tagged")
def tag_rules(spark, sf):
    return _tagged(spark, sf).select("id", F.array_join("tg", ",").alias("tags"))


_POINTS = "CASE x " + " ".join(f"WHEN '{t}' THEN {p}" for t, p in v.TAG_POINTS.items()) + " ELSE 0 END"
_AGENT = f"""a0 AS (SELECT *, greatest(0, least(45, floor(score * 0.45 + 0.5))) AS base, CASE source WHEN 'seeded' THEN 8 WHEN 'manual' THEN 7 WHEN 'google' THEN 4 WHEN 'osm' THEN 3 ELSE 0 END AS sp, list_transform(tg, lambda x: {_POINTS}) AS tp FROM tagged),
agent AS (SELECT *, greatest(0, least(100, floor(base + sp + coalesce(list_sum(tp), 0) + 0.5)))::BIGINT AS value FROM a0)"""


def _agent(spark, sf):
    p = _tagged(spark, sf).withColumn("components", scoring.agent_components(F.col("score"), F.col("source"), F.col("tg")))
    return p.withColumn("value", scoring.agent_score(F.col("components")).cast("long"))


@query(f"WITH {SCORED}, {_TAGS}, {_AGENT} SELECT id, value, (1 + (sp <> 0)::INT + len(list_filter(tp, lambda x: x <> 0)))::INT AS n_components FROM agent")
def agent_score(spark, sf):
    return _agent(spark, sf).select("id", "value", F.size("components").alias("n_components"))


_LEAD = "list_has_any(tg, [" + ", ".join(_q(t) for t in v.LEADING_TAGS) + "])"


@query(f"""WITH {SCORED}, {_TAGS}, {_AGENT}, q AS (SELECT *, CASE WHEN ord % 4 = 0 THEN 'strong' WHEN ord % 4 = 1 THEN 'weak' WHEN ord % 4 = 2 THEN 'medium' ELSE 'weak' END AS sq,
  CASE WHEN value >= 85 THEN 'elite' WHEN value >= 70 THEN 'high' WHEN value >= 50 THEN 'medium' ELSE 'low' END AS band, {_LEAD} AS lead, list_has_any(tg, ['bakery', 'brunch']) AS baked FROM agent),
w AS (SELECT *, CASE WHEN band = 'low' OR sq = 'weak' OR NOT lead THEN 'weak' WHEN baked THEN 'mixed' ELSE 'coffee_led' END AS bucket, base + sp + coalesce(list_sum(tp), 0) AS total FROM q)
SELECT id, sq AS source_quality, band, bucket, array_to_string(list_filter([CASE WHEN floor(total + 0.5) <> value THEN 'score_mismatch' END, CASE WHEN ord % 4 = 3 THEN 'missing_sources' WHEN sq = 'weak' THEN 'weak_sources' END, CASE WHEN ord % 4 = 1 THEN 'google_maps_only' END,
  CASE WHEN ord % 2 = 0 THEN 'missing_story' END, CASE WHEN band = 'low' THEN 'low_score' END, CASE WHEN NOT lead THEN 'no_specialty_signals' END, CASE WHEN bucket = 'weak' THEN 'coffee_profile_weak' END], lambda x: x IS NOT NULL), ',') AS flags FROM w""")
def review_flags(spark, sf):
    k = F.col("ord") % 4
    arr = lambda *x: F.array(*[F.lit(y) for y in x])
    p = _agent(spark, sf).withColumn("kinds", F.when(k == 0, arr("website", "map")).when(k == 1, arr("map")).when(k == 2, arr("source_url")).otherwise(F.array().cast("array<string>")))
    p = p.withColumn("source_quality", scoring.source_quality(F.col("kinds"), F.transform("kinds", lambda x: F.lit("d.example")))).withColumn("band", scoring.score_band(F.col("value")))
    p = p.withColumn("bucket", scoring.coffee_bucket(F.col("tg"), F.col("band"), F.col("source_quality")))
    story = F.when(F.col("ord") % 2 == 1, "A story").otherwise(" ")
    flags = scoring.review_flags(F.col("components"), F.col("value").cast("double"), F.col("kinds"), F.col("source_quality"), story, F.col("tg"), F.col("bucket"))
    return p.select("id", "source_quality", "band", "bucket", F.array_join(flags, ",").alias("flags"))


@query("SELECT page_id, nullif(trim(regexp_extract(substr(html, 1, 50000), '<title[^>]*>(.*?)</title>', 1, 'is')), '') AS title FROM pages")
def html_title(spark, sf):
    return adapters.read(spark, sf, "pages").select("page_id", readers.html_meta(F.col("html"))["title"].alias("title"))


@query("SELECT page_id, regexp_replace(lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)), '^www\\.', '') AS domain FROM pages")
def url_domain(spark, sf):
    return adapters.read(spark, sf, "pages").select("page_id", text.domain(F.col("url")).alias("domain"))


@query("SELECT user_id, arg_max(value, (ts, event_id)) AS value, max(ts) AS ts FROM events GROUP BY 1")
def latest_state_per_key(spark, sf):
    return live.latest(adapters.read(spark, sf, "events"), "user_id", "value")


@query(f"""WITH f AS (SELECT event_id, user_id, ts, 32 + (event_id % 7) * 0.0001 AS lat, 34 + (event_id % 5) * 0.0001 AS lon FROM events), p AS (SELECT *, lag(lat) OVER w AS la, lag(lon) OVER w AS lo FROM f WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
m AS (SELECT *, {_hav('la', 'lo', 'lat', 'lon')} * 1000 AS d FROM p) SELECT user_id, event_id, round(d, 4) AS metres FROM m WHERE d IS NULL OR d >= 20""")
def movement_filter(spark, sf):
    e = adapters.read(spark, sf, "events").select("event_id", "user_id", "ts", (32 + (F.col("event_id") % 7) * 0.0001).alias("lat"), (34 + (F.col("event_id") % 5) * 0.0001).alias("lon"))
    return live.moved(e).select("user_id", "event_id", F.round("metres", 4).alias("metres"))


@query(f"WITH {_PLACE} SELECT id, 'seeded-' || {_KEY.format('city')} || '-' || {_KEY.format('name')} || '-' || printf('%.5f', lat) || '-' || CASE WHEN ord % 4 = 0 THEN 'na' ELSE printf('%.5f', lon) END AS stable_id FROM places")
def stable_id(spark, sf):
    lon = F.when(F.col("ord") % 4 != 0, F.col("lon"))
    return _places(spark, sf).select("id", text.stable_id(F.col("city"), F.col("name"), F.col("lat"), lon).alias("stable_id"))


@query(f"WITH {_PLACE} SELECT id, list_reduce(list_transform(string_split(name, ''), lambda c: unicode(c)::BIGINT), lambda h, x: (h * 31 + x) % 4294967296)::BIGINT AS h FROM places")
def stable_hash(spark, sf):
    return _places(spark, sf).select("id", text.stable_hash(F.col("name")).alias("h"))


@query(f"""WITH {SCORED}, {_BOOST}, f AS (SELECT *, {_TEXT} AS tx FROM b WHERE {_hav('city_lat', 'city_lon', 'lat', 'lon')} <= 3.5), d AS (SELECT *, {_LISTED} ELSE 'ok' END AS reason FROM f),
z AS (SELECT *, CASE rating WHEN 1 THEN 60.0 WHEN 2 THEN 70.0 WHEN 3 THEN 80.0 WHEN 4 THEN 90.0 WHEN 5 THEN 100.0 ELSE CASE WHEN place_type = 'coffee' AND verified THEN 100.0 ELSE score END END AS sc FROM d WHERE reason IN ('ok', 'explicit allowlist')),
o AS (SELECT *, row_number() OVER (PARTITION BY city, lower(name) ORDER BY sc DESC, ord) AS r FROM z), k AS (SELECT *, row_number() OVER (PARTITION BY city ORDER BY sc DESC, ord) AS rank FROM o WHERE r = 1)
SELECT city, rank::INT AS rank, id, sc::DOUBLE AS score FROM k WHERE rank <= 20""")
def rank_top_by_city(spark, sf):
    p = rank.scored(_places(spark, sf)).filter(geo.haversine_km(F.col("city_lat"), F.col("city_lon"), F.col("lat"), F.col("lon")) <= 3.5)
    p = p.filter(decisions.list_decision(rank.text_of(p), F.array().cast("array<string>"), F.lit(None).cast("string"), "all")["included"])
    p = p.join(adapters.ratings(spark, sf), F.col("id") == F.col("place_id"), "left")
    p = p.withColumn("score", scoring.boosted(F.col("score"), F.col("place_type"), F.col("rating"), F.col("tags"))["score"])
    best = dedupe.best_of(p.withColumn("n", F.lower("name")).withColumn("key", F.struct("city", "n")), F.col("key"), F.desc("score"), F.col("ord"))
    w = Window.partitionBy("city").orderBy(F.desc("score"), "ord")
    return best.withColumn("rank", F.row_number().over(w)).filter("rank <= 20").select("city", "rank", "id", "score")


@query()
def rank_places(spark, sf):
    return rank.rank_query(spark, sf)


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*)::BIGINT AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def ext_tumbling_window(spark, sf):
    out = live.tumbling(adapters.read(spark, sf, "events"))
    return out.select(F.col("window.start").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, min(ts) AS start, count(*)::BIGINT AS n FROM s GROUP BY user_id, k""")
def ext_session_window(spark, sf):
    return live.sessions(adapters.read(spark, sf, "events")).select("user_id", F.col("session_window.start").alias("start"), "n")


from . import curation, pieces, rules, search, streams  # noqa: E402, F401  (register their queries)
