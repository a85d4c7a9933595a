"""Queries of review filters, state coercion, geocoding, scans by name and street, and presets."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import agent, curation, geo, scoring, text
from ..functions import vocab as v
from ..operators import audit, combine, matching, state
from . import adapters, rank
from .catalog import _PLACE, ORACLE, QUERIES, SCORED, _any, _hav, _q, query
from .catalog import _places as places

_REVIEW = ORACLE["review_flags"].rsplit("SELECT id, sq", 1)[0]
_FLAGS = ORACLE["review_flags"].split("array_to_string(list_filter([", 1)[1].split("], lambda x: x IS NOT NULL)", 1)[0]


@query(f"""{_REVIEW.rstrip()}, fl AS (SELECT id, sq, band, bucket, tg, baked, lead, list_filter([{_FLAGS}], lambda x: x IS NOT NULL) AS flags FROM w)
SELECT id, len(flags) > 0 AS needs_review, bucket = 'weak' OR sq = 'weak' OR band = 'low' OR list_has_any(flags, ['weak_sources', 'low_score', 'no_specialty_signals']) OR baked AND NOT lead AS leans_away FROM fl""")
def review_filters(spark, sf):
    """Which places a reviewer is asked to look at, and which can be hidden as weak or not coffee."""
    p = QUERIES["review_flags"](spark, sf).withColumn("flags", F.filter(F.split("flags", ","), lambda x: x != ""))
    tags = QUERIES["tag_rules"](spark, sf).select("id", F.filter(F.split("tags", ","), lambda x: x != "").alias("tg"))
    away = scoring.leans_from_coffee(F.col("bucket"), F.col("source_quality"), F.col("band"), F.col("flags"), F.col("tg"))
    return p.join(tags, "id").select("id", (F.size("flags") > 0).alias("needs_review"), away.alias("leans_away"))


def _preset_sql(name: str) -> str:
    """The scoring SQL with the weights of another preset in place of the balanced ones."""
    sql, given = SCORED, {**v.PRESETS["balanced"], **{k: w for k, w in v.PRESETS[name].items() if w}}
    for label, key in (("'Chain cafe'", "chainPenalty"), ("'Generic name'", "genericPenalty"), ("'Restaurant/bar'", "restaurantPenalty"), ("'Specialty keyword'", "specialtyKeywords"), ("'Roaster'", "roaster"), ("'Has website'", "website"), ("'Opening hours listed'", "openingHours"), ("'WiFi available'", "wifiAccess")):
        old = f"{{'label': {label}, 'points': CAST({v.PRESETS['balanced'][key]} AS DOUBLE)}}"
        assert old in sql
        sql = sql.replace(old, f"{{'label': {label}, 'points': CAST({given[key]} AS DOUBLE)}}")
    return sql.replace("*, 50 + coalesce(list_sum", f"*, {given['baseline']} + coalesce(list_sum")


@query(" UNION ALL ".join(f"SELECT * FROM (WITH {_preset_sql(n)} SELECT {_q(n)} AS preset, id, score::DOUBLE AS score FROM scored)" for n in sorted(v.PRESETS)))
def score_presets(spark, sf):
    """Scores by each of the presets."""
    p, out = places(spark, sf), None
    for name in sorted(v.PRESETS):
        one = rank.scored(p, name).select(F.lit(name).alias("preset"), "id", "score")
        out = one if out is None else out.unionByName(one)
    return out


@query(f"WITH {SCORED} SELECT id, array_to_string(list_transform(reasons[1:3], lambda x: x.label), ';') AS reasons FROM scored")
def first_reasons(spark, sf):
    """The three reasons that a card has room for."""
    return rank.scored(places(spark, sf)).select("id", F.array_join(F.transform(curation.shown_reasons(F.col("reasons")), lambda x: x["label"]), ";").alias("reasons"))


@query(f"WITH {_PLACE}, q AS (SELECT id, city, row_number() OVER (PARTITION BY city ORDER BY ord) AS turn FROM places WHERE ord % 7 = 0 OR ord % 5 = 1) SELECT id, city, turn::INT AS turn FROM q WHERE turn <= 10")
def geocode_queue(spark, sf):
    """The first ten places of each city that have no coordinates or are marked."""
    p = places(spark, sf).withColumn("lat", F.when(F.col("ord") % 7 != 0, F.col("lat"))).withColumn("needs_coords", F.when(F.col("ord") % 5 == 1, True))
    return audit.to_geocode(p, 10).select("id", "city", "turn")


_ANSWERS = """SELECT p.id, a.rank, p.name, CASE a.rank WHEN 0 THEN upper(p.name) || ', ' || p.city WHEN 1 THEN split_part(p.name, ' ', 1) || ' street' ELSE 'Zürich' END AS display,
  CASE WHEN (p.ord + a.rank) % 3 = 0 THEN 'Cafe' ELSE 'house' END AS kind, CASE WHEN (p.ord + a.rank) % 2 = 0 THEN 'amenity' ELSE 'building' END AS category, p.city_lat, p.city_lon,
  p.city_lat + (p.ord % 40) * 0.01 * a.rank AS lat, CASE WHEN p.ord % 13 = 0 AND a.rank = 0 THEN NULL ELSE p.city_lon END AS lon FROM places p CROSS JOIN (SELECT {0} AS rank) a"""
_WORDS = "list_distinct(list_filter(string_split(trim(regexp_replace(lower(strip_accents({0})), '[^a-z0-9]+', ' ', 'g')), ' '), lambda w: length(w) > 1))"


@query(f"""WITH {_PLACE}, a AS ({_ANSWERS.format('unnest([0, 1, 2])')}), t AS (SELECT *, {_hav('city_lat', 'city_lon', 'lat', 'lon')} AS km, {_WORDS.format('display')} AS dw, {_WORDS.format('name')} AS nw, trim(regexp_replace(lower(strip_accents(display)), '[^a-z0-9]+', ' ', 'g')) AS dt, trim(regexp_replace(lower(name), '[^a-z0-9]+', ' ', 'g')) AS nt FROM a WHERE lon IS NOT NULL),
s AS (SELECT *, CASE WHEN len(dw) > 0 AND len(nw) > 0 THEN len(list_intersect(dw, nw)) / least(len(dw), len(nw)) ELSE 0 END AS ov FROM t),
p AS (SELECT *, CASE WHEN contains(dt, nt) AND length(nt) > 2 THEN 38 WHEN ov >= 0.6 THEN 28 WHEN ov >= 0.35 THEN 16 ELSE 0 END + CASE WHEN category = 'amenity' THEN 14 ELSE 0 END + CASE WHEN lower(kind) = 'cafe' THEN 12 ELSE 0 END + greatest(0.0, 32 - km * 2.5) - CASE WHEN km > 25 THEN 35 ELSE 0 END AS points FROM s),
b AS (SELECT id, arg_max(rank, (points, -rank)) AS rank, max(points) AS points, arg_max(km, (points, -rank)) AS km FROM p GROUP BY id)
SELECT id, rank::INT AS rank, round(points, 6)::DOUBLE AS points, points >= 32 OR points >= 24 AND km <= 12 AS accepted FROM b""")
def geocode_best(spark, sf):
    """The best of three answers for each place, and whether it is good enough."""
    p = places(spark, sf).select("id", "ord", "name", "city", "city_lat", "city_lon").withColumn("rank", F.explode(F.array(*map(F.lit, (0, 1, 2)))))
    first, o = F.split("name", " ")[0], F.col("ord") + F.col("rank")
    a = p.select(
        "id", "rank", "name", F.when(F.col("rank") == 0, F.concat(F.upper("name"), F.lit(", "), F.col("city"))).when(F.col("rank") == 1, F.concat(first, F.lit(" street"))).otherwise("Zürich").alias("display"),
        F.when(o % 3 == 0, "Cafe").otherwise("house").alias("kind"), F.when(o % 2 == 0, "amenity").otherwise("building").alias("category"), "city_lat", "city_lon",
        (F.col("city_lat") + (F.col("ord") % 40) * 0.01 * F.col("rank")).alias("lat"), F.when(~((F.col("ord") % 13 == 0) & (F.col("rank") == 0)), F.col("city_lon")).alias("lon"),
    )
    return matching.best_geocode(a).select("id", "rank", F.round("points", 6).alias("points"), "accepted")


_ENTRY = """CASE c_custkey % 6 WHEN 0 THEN '{"name": " A ' || c_custkey || ' ", "lat": "12.5", "deleted": "true"}' WHEN 1 THEN '{"notes": null, "specialtyScore": ' || c_custkey || ', "lon": "x"}' WHEN 2 THEN '{"deleted": true}'
  WHEN 3 THEN '[1]' WHEN 4 THEN '{"other": 1}' ELSE '{"lat": "", "address": "B"}' END"""


@query(f"""WITH e AS (SELECT CASE WHEN c_custkey % 10 = 9 THEN ' ' ELSE ' u' || c_custkey END AS id, {_ENTRY} AS e, c_custkey AS k FROM customer)
SELECT trim(id) AS id, CASE k % 6 WHEN 0 THEN 'lat=12.5;name=A ' || k WHEN 1 THEN 'notes=;specialtyScore=' || least(100, k)::DOUBLE WHEN 5 THEN 'address=B;lat=0.0' ELSE '' END AS patch, coalesce(json_extract(e, '$.deleted') = 'true'::JSON, false) AS deleted FROM e WHERE trim(id) <> '' AND k % 6 NOT IN (3, 4)""")
def coerced_overrides(spark, sf):
    """A user's overrides as the state takes them."""
    raw = adapters.read(spark, sf, "customer").select(F.expr("CASE WHEN c_custkey % 10 = 9 THEN ' ' ELSE ' u' || c_custkey END").alias("id"), F.expr(_ENTRY).alias("entry"))
    out = state.coerce_overrides(raw)
    return out.select("id", F.array_join(F.array_sort(F.transform(F.map_entries("patch"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ";").alias("patch"), "deleted")


@query("""WITH x AS (SELECT DISTINCT user_id, event_type AS place_key FROM events), u AS (SELECT DISTINCT user_id FROM events)
SELECT user_id, place_key FROM x WHERE user_id % 3 <> 0 UNION SELECT user_id, 'new' || (user_id % 7) FROM u WHERE user_id % 3 = 1""")
def hidden_posts(spark, sf):
    """Hidden ids of each user after a post: a third sends an empty list, a third new ids, the others none."""
    e = adapters.read(spark, sf, "events")
    new = F.array(F.concat(F.lit("new"), (F.col("user_id") % 7).cast("string")), F.lit(""), F.lit(None).cast("string"))
    ids = F.when(F.col("user_id") % 3 == 0, F.array().cast("array<string>")).when(F.col("user_id") % 3 == 1, new)
    return state.post_hidden(e.select("user_id", F.col("event_type").alias("place_key")), e.select("user_id").distinct().withColumn("ids", ids))


@query(f"""WITH {_PLACE}, r AS (SELECT 'seeded-' || CASE c_custkey % 4 WHEN 0 THEN city WHEN 1 THEN lower(city) || ' north' WHEN 2 THEN 'nation' ELSE 'elsewhere' END || '-' || (c_custkey % 60) AS place_id, 1 + c_custkey % 5 AS rating FROM customer JOIN cities ON city_key = c_nationkey),
q AS (SELECT regexp_extract(place_id, '^seeded-(.+)-(\\d+)$', 1) AS c, regexp_extract(place_id, '^seeded-(.+)-(\\d+)$', 2)::INT AS pos, rating FROM r),
n AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(lower(c), '\\s+', '-', 'g'), '[^a-z0-9-]', '', 'g'), '-+', '-', 'g') AS cn FROM q), k AS (SELECT city_key, regexp_replace(lower(city), '[^a-z0-9]', '', 'g') AS known FROM cities),
m AS (SELECT cn, arg_min(city_key, (known <> cn, known)) AS city_key FROM (SELECT DISTINCT cn FROM n) JOIN k ON contains(cn, known) OR contains(known, cn) GROUP BY 1)
SELECT 'part-' || p.ord AS place_id, max(n.rating)::BIGINT AS rating FROM n JOIN m USING (cn) JOIN places p ON p.city_key = m.city_key AND p.ord // 25 = n.pos GROUP BY 1""")
def recovered_ratings(spark, sf):
    """Ratings under a city's text and a place's index in it, moved to the places."""
    c = adapters.read(spark, sf, "customer").join(F.broadcast(adapters.cities(spark, sf)), F.col("c_nationkey") == F.col("city_key"))  # 25 cities
    named = F.expr("CASE c_custkey % 4 WHEN 0 THEN city WHEN 1 THEN lower(city) || ' north' WHEN 2 THEN 'nation' ELSE 'elsewhere' END")
    ratings = c.select(F.concat(F.lit("seeded-"), named, F.lit("-"), (F.col("c_custkey") % 60).cast("string")).alias("place_id"), (1 + F.col("c_custkey") % 5).alias("rating"))
    p = places(spark, sf).select("id", F.translate("city", "_", "").alias("city"), F.expr("cast(ord div 25 as int)").alias("pos"))
    return state.recover_indexed(ratings, p)


@query(f"""WITH {_PLACE}, a AS (SELECT city_lat AS la, city_lon AS lo, unnest(['bolt', 'RING ', 'Nothing']) AS asked FROM cities),
n AS (SELECT a.*, p.id, lower(coalesce(tag_amenity, '')) IN ('cafe', 'coffee') OR lower(coalesce(tag_shop, '')) = 'coffee' AS coffee, p.ord FROM a JOIN places p ON contains(lower(p.name), lower(a.asked)) AND {_hav('a.la', 'a.lo', 'p.lat', 'p.lon')} <= 4)
SELECT asked, la AS city_lat, lo AS city_lon, arg_min(id, (NOT coffee, ord)) AS id FROM n GROUP BY ALL""")
def places_by_name(spark, sf):
    """For names asked for around each city the first place within four km that is called so, coffee first."""
    asked = adapters.cities(spark, sf).select("city_lat", "city_lon", F.explode(F.array(*map(F.lit, ("bolt", "RING ", "Nothing")))).alias("asked"))
    elements = places(spark, sf).select("id", "ord", "name", "lat", "lon", "tags")
    return combine.name_scan(asked, elements, 4.0).select("asked", "city_lat", "city_lon", "id")


@query(f"WITH {_PLACE} SELECT p.id, c.city, round({_hav('c.city_lat', 'c.city_lon', 'p.lat', 'p.lon')}, 6) AS km FROM places p JOIN cities c ON {_hav('c.city_lat', 'c.city_lon', 'p.lat', 'p.lon')} <= 3 WHERE regexp_matches(coalesce(address, ''), '(?i)brand#1|ST$')")
def places_by_street(spark, sf):
    """Places near each city whose street matches a pattern."""
    e = places(spark, sf).select("id", "lat", "lon", F.create_map(F.lit("addr:street"), F.coalesce("address", F.lit(""))).alias("tags"))
    return combine.street_scan(e, adapters.cities(spark, sf).select("city", "city_lat", "city_lon"), "brand#1|st$", 3000.0).select("id", "city", F.round("km", 6).alias("km"))


@query(f"""WITH {_PLACE} SELECT id, CASE WHEN ord % 4 = 0 THEN url ELSE 'https://m.example/?q=' || url_encode(concat_ws(' ', nullif(trim(name || CASE WHEN ord % 3 = 0 THEN '''s (Ü&~)!' ELSE '' END), ''), nullif(trim(coalesce(address, '')), ''))) END AS link,
  CASE CASE WHEN trim(lower(source)) IN ('osm', 'overpass') THEN 'osm' ELSE trim(lower(source)) END WHEN 'google' THEN 'Google Lists' WHEN 'seeded' THEN 'Curated seeds' WHEN 'manual' THEN 'Manual entries' WHEN 'osm' THEN 'OpenStreetMap' ELSE 'Other' END AS source FROM places""")
def direct_links(spark, sf):
    """Where a place's link leads, and what its source is called.  The oracle's encoder escapes more signs, so those are compared escaped."""
    name = F.concat("name", F.when(F.col("ord") % 3 == 0, "'s (Ü&~)!").otherwise(""))
    link = text.direct_link(F.when(F.col("ord") % 4 == 0, F.col("url")), name, F.col("address"), "https://m.example/?q=")
    escaped = link
    for sign, code in (("!", "%21"), ("'", "%27"), ("(", "%28"), (")", "%29")):
        escaped = F.replace(escaped, F.lit(sign), F.lit(code))
    return places(spark, sf).select("id", F.when(F.col("ord") % 4 == 0, link).otherwise(escaped).alias("link"), audit.source_label(F.col("source")).alias("source"))


_CHAIN = "trim(regexp_replace(lower(name), '[^a-z0-9]+', ' ', 'g'))"


@query(f"WITH {_PLACE}, c AS (SELECT {_CHAIN} AS normalized FROM places GROUP BY 1 HAVING count(*) >= 3 AND count(DISTINCT city) >= 2) SELECT {_CHAIN} AS normalized, id FROM places WHERE {_CHAIN} IN (SELECT normalized FROM c)")
def chain_members(spark, sf):
    """The places of each chain."""
    p = places(spark, sf)
    return audit.chain_members(p, audit.chains(p))


_IMPORTED = "lower(trim(regexp_replace(concat_ws(' ', nullif(name, ''), nullif(description, ''), nullif(address, ''), 'bakery cafe', nullif(source, '')), '\\s+', ' ', 'g')))"


@query(f"""WITH {SCORED}, g AS (SELECT *, {_IMPORTED} AS tt FROM scored), h AS (SELECT *, list_filter([{', '.join(f"CASE WHEN {_any('tt', w)} THEN '{t}' END" for t, w in v.TAG_RULES)}], lambda x: x IS NOT NULL) AS t0 FROM g)
SELECT id, array_to_string(list_sort(CASE WHEN score >= 80 AND NOT list_contains(t0, 'specialty_coffee') THEN list_append(t0, 'specialty_coffee') ELSE t0 END), ',') AS tags,
  concat_ws(',', CASE WHEN source <> '' THEN 'source-primary' END, CASE WHEN ord % 2 = 0 THEN 'google-maps-url' END, CASE WHEN ord % 3 = 0 THEN 'website' END) AS sources FROM h""")
def imported_agent(spark, sf):
    """Tags and sources as the importer makes them: its text has the address and the types, its sources another order."""
    p = rank.scored(places(spark, sf))
    said = agent.import_text(F.col("name"), F.col("description"), F.lit(None).cast("string"), F.col("address"), F.array(F.lit("bakery"), F.lit("cafe")), F.col("source"))
    url = lambda n: F.when(F.col("ord") % n == 0, F.lit("https://x.example/a"))
    ids = F.transform(agent.import_sources(F.col("source"), url(2), F.lit(None).cast("string"), url(3)), lambda s: s["id"])
    return p.select("id", F.array_join(scoring.tag_rules(said, F.col("score")), ",").alias("tags"), F.array_join(ids, ",").alias("sources"))


@query(f"WITH {_PLACE} SELECT id, round(CASE WHEN ord % 3 = 0 THEN city_lat WHEN ord % 3 = 1 THEN lat ELSE lat END, 6) AS lat, round(CASE WHEN ord % 3 = 0 THEN city_lon ELSE lon END, 6) AS lon FROM places")
def best_coordinates(spark, sf):
    """Of several coordinate fields the pair nearest to the city, swapped where that is nearer."""
    none = F.lit(None).cast("double")
    o = F.col("ord") % 3
    first = [F.when(o == 0, F.col("lat")).when(o == 1, none).otherwise(F.col("lon")), F.when(o == 0, F.col("lon")).when(o == 1, none).otherwise(F.col("lat"))]
    second = [F.when(o == 0, F.col("city_lat")).when(o == 1, F.col("lat")), F.when(o == 0, F.col("city_lon")).when(o == 1, F.col("lon"))]
    best = geo.best_coordinates([first[0], second[0]], [first[1], second[1]], F.col("city_lat"), F.col("city_lon"))
    return places(spark, sf).select("id", best.alias("b")).select("id", F.round("b.lat", 6).alias("lat"), F.round("b.lon", 6).alias("lon"))




_TAGGED = ORACLE["imported_agent"].split("SELECT id, array_to_string(", 1)


@query(f"""{_TAGGED[0].rstrip()}, k AS (SELECT *, list_sort(CASE WHEN score >= 80 AND NOT list_contains(t0, 'specialty_coffee') THEN list_append(t0, 'specialty_coffee') ELSE t0 END) AS tg FROM h),
c AS (SELECT *, list_contains(tg, 'specialty_coffee') AS sp, list_contains(tg, 'espresso_bar') AS es, list_has_any(tg, {agent.POUR_TAGS}) AS po,
  list_filter([CASE WHEN ord % 2 = 0 THEN 'x.example' END, CASE WHEN ord % 3 = 0 THEN 'y.example' END], lambda x: x IS NOT NULL) AS refs FROM k)
SELECT id, concat_ws(' ', CASE WHEN list_contains(tg, 'roastery') AND sp THEN {_q(agent.ROASTERY_STORY)} WHEN list_contains(tg, 'bakery') AND (es OR sp) THEN {_q(agent.BAKERY_STORY)}
  WHEN sp OR es OR po THEN {_q(agent.CUE_STORY[0])} || coalesce(nullif(array_to_string(list_filter([CASE WHEN po THEN 'pour-over' END, CASE WHEN es THEN 'espresso' END], lambda x: x IS NOT NULL), ' and '), ''), 'specialty coffee') || {_q(agent.CUE_STORY[1])} ELSE {_q(agent.PLAIN_STORY)} END,
  CASE WHEN len(refs) > 0 THEN {_q(agent.REFERENCE_STORY)} || array_to_string(refs, ' and ') || '.' END, CASE WHEN coalesce(address, '') <> '' THEN {_q(agent.ADDRESS_STORY)} END) AS summary FROM c""")
def imported_story(spark, sf):
    """The story that an importer writes out of tags, sources and address."""
    p = rank.scored(places(spark, sf))
    said = agent.import_text(F.col("name"), F.col("description"), F.lit(None).cast("string"), F.col("address"), F.array(F.lit("bakery"), F.lit("cafe")), F.col("source"))
    url = lambda n, host: F.when(F.col("ord") % n == 0, F.lit(f"https://{host}.example/a"))
    found = agent.import_sources(F.col("source"), url(2, "X"), F.lit(None).cast("string"), url(3, "y"))
    return p.select("id", agent.import_story(scoring.tag_rules(said, F.col("score")), found, F.col("address")).alias("s")).select("id", "s.summary")


@query(f"WITH {_PLACE} SELECT id, CASE WHEN ord % 5 = 0 THEN NULL ELSE round(-lat, 5) END AS lat, round(lon, 5) AS lon FROM places")
def strict_ids(spark, sf):
    """Places out of the ids that were made of them, signs included."""
    k, city = F.col("ord"), F.concat("city", F.lit(" Old-Town"))
    ids = text.stable_id(city, F.col("name"), F.when(k % 5 != 0, -F.col("lat")), F.col("lon"))
    return places(spark, sf).select("id", text.parse_strict_id(ids, city).alias("p")).select("id", "p.lat", "p.lon")
