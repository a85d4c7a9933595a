"""Queries of curated places: sources put together, user state, import, discovery and enrichment."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import agent, curation, decisions, scoring, text
from ..functions import vocab as v
from ..operators import audit, combine
from ..sources import readers
from ..streaming import live
from . import adapters, rank
from .catalog import _AGENT, _BOOST, _HINTS, _PLACE, _TAGS, _TEXT, SCORED, _agent, _any, _hav, _places, _q, _tagged, query

_LIST = lambda words: "[" + ", ".join(_q(w) for w in words) + "]"


@query(f"WITH {SCORED} SELECT id, (CASE WHEN ord % 4 = 0 THEN greatest(score, 72) ELSE score END)::DOUBLE AS score, CASE WHEN ord % 4 = 0 THEN 'coffee' ELSE place_type END AS place_type, len(reasons) + CASE WHEN ord % 4 = 0 THEN 1 ELSE 0 END AS n_reasons FROM scored")
def seeded_floor(spark, sf):
    p = rank.scored(_places(spark, sf))
    f = curation.seeded_floor(F.col("score"), F.col("place_type"), F.col("reasons"), F.col("ord") % 4 == 0)
    return p.withColumn("f", f).select("id", "f.score", "f.place_type", F.size("f.reasons").cast("long").alias("n_reasons"))


@query(f"WITH {_PLACE}, t AS (SELECT id, lower(concat_ws(' ', nullif(name, ''), nullif(coalesce(tag_cuisine, ''), ''), nullif(description, ''), nullif(coalesce(tag_brand, ''), ''))) AS tx FROM places) SELECT id, {_any('tx', v.SPECIALTY_FLAG_WORDS)} AS flag FROM t")
def specialty_flag(spark, sf):
    tags = F.col("tags")
    return _places(spark, sf).select("id", curation.specialty_flag(F.col("name"), scoring.tag(tags, "cuisine"), F.col("description"), scoring.tag(tags, "brand")).alias("flag"))


_OWN = [" Steel ", "COPPER", "steel", ""]


@query(f"""WITH {_PLACE}, t AS (SELECT *, {_TEXT} AS tx FROM places), w AS (SELECT *, list_filter(list_concat(CASE WHEN country = 'EUROPE' THEN {_LIST(v.EUROPE_CHAINS)} ELSE [] END, {_LIST(v.EXCLUDED_WORDS)}, CASE WHEN city_key % 5 = 0 THEN ['steel', 'copper'] ELSE [] END), lambda x: contains(tx, x)) AS found FROM t) SELECT id, found[1] AS word FROM w""")
def exclusion_keyword(spark, sf):
    p = _places(spark, sf)
    own = F.when(F.col("city_key") % 5 == 0, F.array(*[F.lit(w) for w in _OWN]))
    words = curation.city_words(F.array(*[F.lit(w) for w in v.EXCLUDED_WORDS]), own)
    return p.select("id", curation.exclusion_word(rank.text_of(p), words, curation.is_european(F.col("country"), ["EUROPE"])).alias("word"))


@query(f"""WITH {SCORED}, {_BOOST}, f AS (SELECT *, {_TEXT} AS tx FROM b) SELECT id, rating::INT AS rating, score::DOUBLE AS score FROM f
WHERE contains(tx, 'co') AND NOT ({_any('tx', v.EXCLUDED_WORDS)} OR (country = 'EUROPE' AND {_any('tx', v.EUROPE_CHAINS)})) AND NOT {_any('tx', v.CITY_LOCKS[0][0])}
  AND (source = 'google' OR (ord % 8) IN (1, 2, 3)) AND (score >= 45 OR rating > 0)""")
def ui_filters(spark, sf):
    p = rank.scored(_places(spark, sf)).join(adapters.ratings(spark, sf), F.col("id") == F.col("place_id"), "left")
    p = p.withColumn("open_hours", F.when(p["source"] == "google", None).otherwise(F.when((F.col("ord") % 8).isin(1, 2, 3), "24/7").otherwise("Mo 01:00-02:00")))
    p = p.drop("opening_hours").withColumnRenamed("open_hours", "opening_hours")
    shown = rank.filters(p, text="CO ", open_at=(3, 600), least=45, european=["EUROPE"])
    return shown.select("id", F.coalesce("rating", F.lit(0)).alias("rating"), "score")


@query(f"WITH {_PLACE}, b AS (SELECT * FROM places WHERE ord % 2 = 0), n AS (SELECT * FROM places s WHERE ord % 2 = 1 AND NOT EXISTS (SELECT 1 FROM b WHERE b.city = s.city AND lower(b.name) = lower(s.name))) SELECT id, 0 AS stage FROM n UNION ALL SELECT id, 1 FROM b")
def union_new_seeded(spark, sf):
    p = _places(spark, sf)
    base = combine.by_mode("combined", p.filter("ord % 4 = 0"), p.filter("ord % 4 = 2"))
    return combine.with_new(base, p.filter("ord % 2 = 1")).select("id", "stage")


@query(f"""WITH {_PLACE}, a AS (SELECT CASE WHEN ord % 3 = 0 THEN 0 ELSE 1 END AS part, ord, id, name, [id, 'old-' || (ord % 100)] AS ks FROM places), k AS (SELECT *, unnest(ks) AS key FROM a)
SELECT key, arg_min(id, (part, ord)) AS id, arg_min(name, (part, ord)) AS name FROM k GROUP BY key""")
def known_places_first(spark, sf):
    p = _places(spark, sf).withColumn("legacy", F.array(F.concat(F.lit("old-"), (F.col("ord") % 100).cast("string"))))
    keys = F.concat(F.array("id"), F.col("legacy"))
    return combine.first_known([p.filter("ord % 3 = 0"), p.filter("ord % 3 != 0")], keys, ["id", "name"])


@query(f"""WITH {_PLACE}, o AS (SELECT 'part-' || (s_suppkey * 3) AS id, CASE WHEN s_suppkey % 4 = 0 THEN s_name END AS n, s_suppkey % 7 = 0 AS deleted, s_suppkey % 10 AS updated_at FROM supplier)
SELECT o.id, coalesce(o.n, p.name, o.id) AS name, coalesce(p.city, '') AS city, coalesce(p.source, '') AS source, o.deleted, o.updated_at::BIGINT AS updated_at FROM o LEFT JOIN places p ON p.id = o.id""")
def override_view(spark, sf):
    k = F.col("s_suppkey")
    patch = F.when(k % 4 == 0, F.create_map(F.lit("name"), F.col("s_name"))).otherwise(F.create_map().cast("map<string,string>"))
    o = adapters.read(spark, sf, "supplier").select(F.concat(F.lit("part-"), (k * 3).cast("string")).alias("id"), patch.alias("patch"), (k % 7 == 0).alias("deleted"), (k % 10).cast("long").alias("updated_at"))
    return combine.override_view(o, _places(spark, sf).select(F.col("id").alias("key"), "name", "city", "source"))


@query(f"""WITH {_PLACE}, m AS (SELECT 'old-' || (ord % 120) AS place_id, arg_max(id, ord) AS id FROM places GROUP BY 1), r AS (SELECT * FROM ratings UNION ALL SELECT 'old-' || user_id, max(1 + event_id % 4)::INT FROM events WHERE user_id < 60 GROUP BY 1),
n AS (SELECT m.id AS place_id, max(rating) AS rating FROM r JOIN m USING (place_id) GROUP BY 1) SELECT place_id, rating::INT AS rating FROM r UNION ALL SELECT place_id, rating::INT FROM n WHERE place_id NOT IN (SELECT place_id FROM r)""")
def migrate_legacy_ratings(spark, sf):
    p = _places(spark, sf).withColumn("legacy", F.array(F.concat(F.lit("old-"), (F.col("ord") % 120).cast("string"))))
    e = adapters.read(spark, sf, "events").filter("user_id < 60").groupBy(F.concat(F.lit("old-"), F.col("user_id").cast("string")).alias("place_id")).agg(F.max((1 + F.col("event_id") % 4).cast("int")).alias("rating"))
    return combine.migrate_ratings(adapters.ratings(spark, sf).unionByName(e), combine.legacy_map(p))


@query(f"""WITH {_PLACE}, m AS (SELECT 'old-' || (ord % 120) AS k, arg_max(id, ord) AS id FROM places GROUP BY 1), h AS (SELECT DISTINCT 'old-' || (c_custkey % 70) AS k FROM customer)
SELECT k AS place_key FROM h UNION SELECT id FROM h JOIN m USING (k)""")
def migrate_legacy_hidden(spark, sf):
    p = _places(spark, sf).withColumn("legacy", F.array(F.concat(F.lit("old-"), (F.col("ord") % 120).cast("string"))))
    hidden = adapters.read(spark, sf, "customer").select(F.concat(F.lit("old-"), (F.col("c_custkey") % 70).cast("string")).alias("place_key"))
    return combine.migrate_hidden(hidden, combine.legacy_map(p))


@query(f"WITH {SCORED} SELECT id, score::DOUBLE AS score FROM scored ORDER BY (id = 'part-77') DESC, score DESC, ord LIMIT 50")
def pinned_first(spark, sf):
    p = rank.scored(_places(spark, sf))
    return combine.pinned(p, "part-77", F.desc("score"), F.col("ord")).limit(50).select("id", "score")


_RADIUS = "CASE WHEN city_key % 3 = 0 THEN 3.5 ELSE 4.0 END"


@query(f"""WITH {_PLACE}, r AS (SELECT *, least(40, greatest(3.5, greatest(1, CASE city {' '.join(f"WHEN {_q(c)} THEN {m}" for c, m in v.CITY_RADIUS_METRES.items())} ELSE {v.DEFAULT_RADIUS_METRES} END / 1000.0)))::DOUBLE AS km FROM places)
SELECT city, round(min(lat), 6) AS south, round(max(lat), 6) AS north, round(min(lon), 6) AS west, round(max(lon), 6) AS east, count(*)::BIGINT AS n, min(km) AS km FROM r WHERE {_hav('city_lat', 'city_lon', 'lat', 'lon')} <= km * 2 GROUP BY 1""")
def map_fit(spark, sf):
    p = _places(spark, sf).withColumn("km", curation.radius_km(F.col("city")))
    box = [F.round(f(c), 6).alias(n) for f, c, n in ((F.min, "lat", "south"), (F.max, "lat", "north"), (F.min, "lon", "west"), (F.max, "lon", "east"))]
    return combine.within(p, F.col("km") * 2).groupBy("city").agg(*box, F.count(F.lit(1)).alias("n"), F.min("km").alias("km"))


@query("""WITH d AS (SELECT n_name AS name, n_nationkey + 0.5 AS lat, CASE WHEN n_nationkey = 3 THEN NULL ELSE 1.0 END AS lon FROM nation WHERE n_nationkey < 8), m AS (SELECT n_name AS name, n_nationkey + 0.25 AS lat, CASE WHEN n_nationkey = 20 THEN 'NaN'::DOUBLE ELSE 2.0 END AS lon FROM nation WHERE n_nationkey > 2)
SELECT coalesce(d.name, m.name) AS name, (CASE WHEN d.name IS NOT NULL THEN d.lat ELSE m.lat END)::DOUBLE AS lat, (CASE WHEN d.name IS NOT NULL THEN d.lon ELSE m.lon END)::DOUBLE AS lon FROM d FULL JOIN m ON d.name = m.name
WHERE (CASE WHEN d.name IS NOT NULL THEN d.lon ELSE m.lon END) IS NOT NULL AND NOT isnan((CASE WHEN d.name IS NOT NULL THEN d.lon ELSE m.lon END)::DOUBLE)""")
def city_dimension(spark, sf):
    n = adapters.read(spark, sf, "nation").withColumn("k", F.col("n_nationkey"))
    d = n.filter("k < 8").select(F.col("n_name").alias("name"), (F.col("k") + 0.5).alias("lat"), F.when(F.col("k") != 3, 1.0).alias("lon"))
    m = n.filter("k > 2").select(F.col("n_name").alias("name"), (F.col("k") + 0.25).alias("lat"), F.when(F.col("k") == 20, float("nan")).otherwise(2.0).alias("lon"), F.col("k").alias("ord"))
    return combine.city_dimension(d, m)


@query(f"""WITH {SCORED}, {_BOOST}, x AS (SELECT *, CASE WHEN rating = 1 THEN 50 ELSE score END AS shown FROM b) SELECT id, shown::DOUBLE AS shown, CASE WHEN shown >= 95 THEN 'top' WHEN shown >= 80 THEN 'high' WHEN shown >= 50 THEN 'mid' ELSE 'low' END AS badge, CASE WHEN ord % 3 = 0 THEN 'open' WHEN ord % 3 = 1 THEN 'closed' END AS open,
  CASE WHEN ord % 5 = 0 THEN 'a.png' WHEN ord % 2 = 0 THEN 'p.png' END AS image, place_type <> 'coffee' AS non_pure, rating = 0 AND confidence < 40 AS low_data, rating = 0 AND source <> 'google' AS editorial, trim(coalesce(address, '')) = '' AS missing_address, ord % 4 = 0 AND ord % 7 = 0 AS missing_coordinates FROM x""")
def output_rows(spark, sf):
    p = rank.scored(_places(spark, sf)).join(adapters.ratings(spark, sf), F.col("id") == F.col("place_id"), "left")
    o = F.col("ord")
    row = curation.output_row(F.col("score"), F.col("rating"), F.col("confidence"), F.col("place_type"), F.col("source"), F.when(o % 3 == 0, True).when(o % 3 == 1, False), F.col("address"), F.when(o % 5 == 0, "a.png").otherwise(""), F.when(o % 2 == 0, "p.png"), o % 4 == 0, o % 7 != 0)
    return p.withColumn("r", row).select("id", "r.*")


_DISC = "coalesce({0}, '') NOT IN ('', 'no', 'false', '0')"
_count = lambda keys: " + ".join([f"CASE WHEN {_DISC.format('tag_' + k)} THEN 1 ELSE 0 END" for k in keys if f"tag_{k}" in adapters.PLACE_COLUMNS] or ["0"])
_hits = lambda words: " + ".join(f"CASE WHEN contains(tx, {_q(w)}) THEN 1 ELSE 0 END" for w in words)


@query(f"""WITH {_PLACE}, t AS (SELECT *, lower(concat_ws(' ', name, nullif(coalesce(tag_brand, ''), ''), nullif(coalesce(tag_cuisine, ''), ''))) AS tx FROM places),
s AS (SELECT id, greatest(0, CASE WHEN {_count(v.CORE_TAGS)} > 0 THEN 25 ELSE 0 END + CASE WHEN {_count(v.ROASTING_TAGS)} > 0 THEN 15 ELSE 0 END + least(12, 3 * ({_count(v.BREWING_TAGS)})) + least(8, 2 * ({_count(v.EQUIPMENT_TAGS)})) + least(8, 2 * ({_count(v.EXPERIENCE_TAGS)}))
  + least(20, 4 * ({_hits(v.DISCOVERY_TEXT)})) + least(12, 3 * ({_hits(v.DISCOVERY_NAME)})) + CASE WHEN regexp_matches(lower(coalesce(tag_cuisine, '')), 'coffee_shop|specialty_coffee') THEN 8 ELSE 0 END - CASE WHEN {_any('tx', v.DISCOVERY_NEGATIVE)} THEN 25 ELSE 0 END) AS score FROM t)
SELECT id, score::INT AS score, least(100, 60 + score)::INT AS total FROM s WHERE score >= 18""")
def discovery_score(spark, sf):
    p = _places(spark, sf).withColumn("t", F.map_concat("tags", F.create_map(F.lit("name"), F.col("name"))))
    return text.once(p.select("id", "t"), d=curation.discovery_score(F.col("t"))).filter(F.col("d.score") >= v.DISCOVERY_LEAST).select("id", F.col("d.score").cast("int").alias("score"), F.col("d.total").cast("int").alias("total"))


_GATE = f"""g1 AS (SELECT *, lower(concat_ws(' ', nullif(name, ''), nullif(address, ''))) AS t2, {_TEXT} AS se, list_has_any(tg, {_LIST(v.LEADING_TAGS)}) AS strong FROM tagged),
g2 AS (SELECT *, strong OR {_any('lower(name)', v.IMPORT_COFFEE_NAME)} AS evidence, {_any('se', v.IMPORT_COFFEE_TEXT)} AS ct, {_any('se', v.IMPORT_NON_COFFEE)} AS obvious, {_any('se', v.IMPORT_FOOD_FIRST)} AS food, list_has_any(tg, ['bakery', 'brunch']) OR {_any('t2', v.IMPORT_BAKERY_BRUNCH)} AS baked2 FROM g1)"""


@query(f"""WITH {SCORED}, {_TAGS}, {_GATE} SELECT id, CASE WHEN {_any('t2', v.IMPORT_EXCLUDED)} THEN false WHEN {_any('t2', v.ALLOWED_WORDS)} THEN true WHEN obvious AND NOT strong THEN false WHEN (baked2 OR food) AND NOT strong THEN false ELSE evidence OR (NOT baked2 AND NOT food AND (ct OR score >= 48)) END AS coffee_only,
  CASE WHEN {_any('t2', v.IMPORT_EXCLUDED)} THEN false WHEN {_any('t2', v.ALLOWED_WORDS)} THEN true WHEN obvious AND NOT strong THEN false ELSE evidence OR ct OR (baked2 AND NOT obvious) END AS with_bakery FROM g2""")
def import_gate(spark, sf):
    p = _tagged(spark, sf)
    passes = lambda mode: curation.import_passes(F.col("name"), F.col("address"), rank.text_of(p), F.col("tg"), F.col("score"), mode)
    return p.select("id", passes("coffeeOnly").alias("coffee_only"), passes("coffeeAndBakery").alias("with_bakery"))


_SITE = "CASE WHEN ord % 4 = 0 THEN 'https://www.Shop' || (ord % 9) || '.example/x' END"
_PAGE = "CASE WHEN ord % 6 = 0 THEN 'https://shop' || (ord % 9) || '.example/y' WHEN ord % 6 = 1 THEN 'not a url' END"
_NOTES = "CASE WHEN ord % 5 = 0 THEN '  Best  cup. More text' WHEN ord % 5 = 1 THEN 'No end here' END"
_STORY = f"""st AS (SELECT *, {_SITE} AS site, {_PAGE} AS page, {_NOTES} AS notes FROM tagged), s1 AS (SELECT *, coalesce(regexp_extract(lower(site), '^https?://(?:www\\.)?([^/]*)', 1), '') AS sd, coalesce(regexp_extract(lower(page), '^https?://(?:www\\.)?([^/]*)', 1), '') AS pd,
  CASE WHEN site IS NOT NULL THEN 'website' WHEN page IS NOT NULL THEN 'source-url' ELSE 'google-maps-url' END AS pref FROM st),
s2 AS (SELECT *, CASE WHEN notes IS NULL AND description = '' AND len(tg) = 0 THEN NULL WHEN ord % 5 = 0 THEN 'Best cup.' WHEN ord % 5 = 1 THEN 'No end here' WHEN description <> '' THEN description ELSE 'Known for ' || array_to_string(list_transform(tg[1:3], lambda x: replace(x, '_', ' ')), ', ') || '.' END AS summary,
  CASE WHEN notes IS NOT NULL THEN 'notes' WHEN description <> '' THEN 'description' ELSE 'tags' END AS told FROM s1)"""


def _storied(spark, sf):
    p = _tagged(spark, sf).withColumn("site", F.expr(_SITE)).withColumn("page", F.expr(_PAGE)).withColumn("notes", F.expr(_NOTES))
    return p.withColumn("story", agent.story(F.col("notes"), F.col("description"), F.col("tg"), agent.source_ids(F.col("site"), F.col("page"), F.col("url"), F.lit(None).cast("string"))))


@query(f"""WITH {SCORED}, {_TAGS}, {_STORY} SELECT id, summary, told || ',' || pref AS cited, array_to_string(list_filter([CASE WHEN site IS NOT NULL THEN 'Official website (' || sd || ')' END, CASE WHEN page IS NOT NULL THEN CASE WHEN pd = '' THEN 'Source' WHEN pd = sd THEN 'Source (official site)' ELSE 'Source (' || pd || ')' END END, 'Google Maps',
  CASE WHEN source <> '' THEN upper(source) END], lambda x: x IS NOT NULL), '|') AS sources, CASE WHEN len(regexp_split_to_array(summary, '\\s+')) BETWEEN 8 AND 45 THEN 'strong' ELSE 'medium' END AS quality FROM s2""")
def agent_story_sources(spark, sf):
    p = _storied(spark, sf)
    s = agent.sources(F.col("site"), F.col("page"), F.col("url"), F.lit(None).cast("string"), F.col("source"))
    return p.select("id", "story.summary", F.array_join("story.sources", ",").alias("cited"), F.array_join(F.transform(s, lambda x: x["title"]), "|").alias("sources"), agent.story_quality(F.col("story.summary"), F.col("story.sources")).alias("quality"))


@query(f"""WITH {SCORED}, {_TAGS}, {_STORY} SELECT id, CASE WHEN ord % 3 = 0 THEN 'Mine' ELSE summary END AS summary, CASE WHEN ord % 3 = 1 THEN 'own' ELSE array_to_string(tg, ',') END AS tags,
  CASE WHEN ord % 4 = 1 THEN 'https://i.example/own.png' WHEN ord % 7 = 0 THEN 'https://g.example/photo.png' WHEN ord % 2 = 0 THEN 'https://s.example/og.png' END AS image, CASE WHEN ord % 5 = 2 THEN 'reviewed' WHEN len(tg) > 0 THEN 'scored' ELSE 'none' END AS status FROM s2""")
def agent_merge(spark, sf):
    p, o = _storied(spark, sf), F.col("ord")
    picture = agent.image(F.when(o % 7 == 0, "https://g.example/photo.png").when(o % 7 == 1, "https://g.example/place-photos/AL8x"), [F.when(o % 3 == 5, "x"), F.when(o % 2 == 0, "https://s.example/og.png")], F.col("site"), F.col("page"))
    found = agent.sources(F.col("site"), F.col("page"), F.col("url"), F.lit(None).cast("string"), F.col("source"))
    computed = F.struct(F.col("story"), found.alias("sources"), F.col("tg").alias("tags"), picture.alias("image"), F.lit(1.0).alias("score"), F.when(F.size("tg") > 0, "scored").otherwise("none").alias("status"))
    own_image = F.struct(F.when(o % 4 == 1, "https://i.example/own.png").when(o % 4 == 2, "https://g.example/place-photos/AL8y").alias("url"), F.lit("own").alias("source"), F.lit(None).cast("string").alias("attribution"))
    existing = F.struct(
        F.when(o % 3 == 0, F.struct(F.lit("Mine").alias("summary"), F.array(F.lit("own")).alias("sources"))).alias("story"), F.filter(found, lambda x: F.lit(False)).alias("sources"), F.when(o % 3 == 1, F.array(F.lit("own"))).otherwise(F.array().cast("array<string>")).alias("tags"),
        own_image.alias("image"), F.lit(None).cast("double").alias("score"), F.when(o % 5 == 2, "reviewed").otherwise("none").alias("status"),
    )
    m = p.withColumn("m", agent.merged(existing, computed))
    return m.select("id", "m.story.summary", F.array_join("m.tags", ",").alias("tags"), "m.image.url", "m.status").withColumnRenamed("url", "image")


@query(f"""WITH {SCORED}, {_TAGS}, {_AGENT}, c AS (SELECT id, unnest(list_concat([{{'k': 'specialtyScore', 'p': base::DOUBLE, 'i': 0}}, {{'k': 'source:' || source, 'p': sp::DOUBLE, 'i': 1}}], list_transform(tg, lambda x, i: {{'k': 'tag:' || x, 'p': tp[i]::DOUBLE, 'i': i + 1}}))) AS c FROM agent)
SELECT id, string_agg(c.k || '=' || c.p::VARCHAR, ';' ORDER BY -abs(c.p), c.i) AS breakdown FROM c WHERE c.i = 0 OR c.p <> 0 GROUP BY id""")
def score_breakdown(spark, sf):
    parts = F.transform(agent.breakdown(F.col("components")), lambda x: F.concat(x["key"], F.lit("="), x["points"].cast("string")))
    return _agent(spark, sf).select("id", F.array_join(parts, ";").alias("breakdown"))


@query(f"""WITH {_PLACE}, c AS (SELECT printf('%.6f,%.6f', lat, lon) AS k, min('found ' || city) AS a FROM places WHERE ord % 2 = 0 GROUP BY 1) SELECT id, CASE WHEN trim(coalesce(address, '')) = '' THEN coalesce(c.a, address) ELSE address END AS address FROM places p LEFT JOIN c ON c.k = printf('%.6f,%.6f', p.lat, p.lon)""")
def address_cache(spark, sf):
    p = _places(spark, sf)
    cache = p.filter("ord % 2 = 0").select(F.col("lat").alias("lat"), F.col("lon").alias("lon"), F.concat(F.lit("found "), "city").alias("address"))
    return combine.with_cached_address(p, cache).select("id", "address")


_SCAN_KEYS = [k for k in v.VERIFIED_TAGS if f"tag_{k}" in adapters.PLACE_COLUMNS]


@query(f"""WITH {_PLACE} SELECT id, c.city, round({_hav('c.city_lat', 'c.city_lon', 'p.lat', 'p.lon')}, 6) AS km FROM places p JOIN cities c ON {_hav('c.city_lat', 'c.city_lon', 'p.lat', 'p.lon')} <= {_RADIUS.replace('city_key', 'c.city_key')}
WHERE tag_amenity = 'cafe' OR tag_shop = 'coffee' OR {' OR '.join(f'tag_{k} IS NOT NULL' for k in _SCAN_KEYS)}""")
def tag_radius_scan(spark, sf):
    e = _places(spark, sf).select("id", "lat", "lon", "tags")
    metres = F.when(F.col("city_key") % 3 == 0, 3500.0).otherwise(4000.0)
    out = combine.tag_scan(e, adapters.cities(spark, sf), combine.coffee_tags(F.col("tags"), v.VERIFIED_TAGS), metres, 4.0)
    return out.select("id", "city", F.round("km", 6).alias("km"))


@query(f"WITH {_PLACE}, p AS (SELECT *, CASE WHEN ord % 4 <> 0 THEN 'ph' || (ord % 60) ELSE '' END AS photo FROM places) SELECT city, photo AS photo_url, count(*)::BIGINT AS n, arg_min(id, ord) AS first_id FROM p WHERE photo <> '' GROUP BY 1, 2 HAVING count(*) > 1")
def photo_groups(spark, sf):
    photo = F.when(F.col("ord") % 4 != 0, F.concat(F.lit("ph"), (F.col("ord") % 60).cast("string"))).otherwise("")
    return combine.photo_groups(_places(spark, sf).withColumn("photo_url", photo))


@query(f"""WITH {_PLACE}, d AS (SELECT city, {_TEXT} AS tx, name, lower(coalesce(tag_cuisine, '')) AS cu FROM places) SELECT city, count(*) FILTER ({_any('tx', v.STRICT_COFFEE_WORDS)})::BIGINT AS kept, count(*) FILTER ({_any('tx', v.STRICT_COFFEE_WORDS)} AND {_any("(lower(name) || ' ' || cu)", v.SUSPICIOUS_WORDS)})::BIGINT AS suspicious, count(*)::BIGINT AS "all" FROM d GROUP BY 1""")
def city_sanity(spark, sf):
    p = _places(spark, sf)
    kept = text.any_of(rank.text_of(p), v.STRICT_COFFEE_WORDS)
    odd = text.any_of(F.concat(F.lower("name"), F.lit(" "), F.lower(scoring.tag(F.col("tags"), "cuisine"))), v.SUSPICIOUS_WORDS)
    return combine.outcomes(p, ["city"], kept=kept, suspicious=kept & odd)


@query(f"""WITH {_PLACE}, s AS (SELECT *, CASE WHEN ord % 3 = 0 THEN 0 WHEN ord % 3 = 1 THEN 2 ELSE 1 END AS lr FROM places), k AS (SELECT city, id, row_number() OVER (PARTITION BY city ORDER BY lr, ord) AS place FROM s) SELECT city, id, place::INT AS place FROM k WHERE place <= 30""")
def live_order(spark, sf):
    open_ = F.when(F.col("ord") % 3 == 0, True).when(F.col("ord") % 3 == 1, False)
    return rank.live_order(_places(spark, sf), open_, 30).select("city", "id", "place")


@query(f"WITH {_PLACE} SELECT city, count(*)::BIGINT AS n, count(*) FILTER (source = 'google') > 0 AS listed FROM places WHERE contains(lower(name), 'bar') GROUP BY 1")
def result_counts(spark, sf):
    p = _places(spark, sf).filter(F.contains(F.lower("name"), F.lit("bar")))
    return audit.found_by_city(p)


_LAT_TEXT = "CASE ord % 5 WHEN 0 THEN '52,' || ord WHEN 1 THEN ' 1.5 ' WHEN 2 THEN 'x' WHEN 3 THEN '' ELSE '-' || ord || '.25' END"


@query(f"WITH {_PLACE}, t AS (SELECT id, {_LAT_TEXT} AS t FROM places) SELECT id, try_cast(nullif(regexp_replace(trim(t), '^([^,]*),', '\\1.'), '') AS DOUBLE) AS x FROM t")
def decimal_comma(spark, sf):
    return _places(spark, sf).select("id", text.parse_number(F.expr(_LAT_TEXT)).alias("x"))


@query(f"""WITH {_PLACE}, k AS (SELECT id, 'seeded-' || lower(regexp_replace(city, '[^A-Za-z]', '', 'g')) || '-place-' || ord || '-' || printf('%.5f', lat) || '-' || printf('%.5f', abs(lon)) AS sid FROM places), p AS (SELECT *, string_split(sid, '-') AS a FROM k)
SELECT id, a[2] AS city_key, array_to_string(a[3:len(a) - 2], '-') AS name_key, a[len(a) - 1]::DOUBLE AS lat, a[len(a)]::DOUBLE AS lon FROM p""")
def parsed_ids(spark, sf):
    part = F.format_string("%.5f", F.col("lat")), F.format_string("%.5f", F.abs("lon"))
    sid = F.concat_ws("-", F.lit("seeded"), F.lower(F.regexp_replace("city", "[^A-Za-z]", "")), F.lit("place"), F.col("ord").cast("string"), *part)
    return _places(spark, sf).select("id", text.parse_stable_id(sid).alias("p")).select("id", "p.*")


@query(f"WITH {_PLACE}, d AS (SELECT id, (ord % 200) / 16.0 AS km FROM places) SELECT id, CASE WHEN km < 1 THEN floor(km * 1000 + 0.5)::INT || ' m' WHEN km < 10 THEN printf('%.1f km', km + 1e-9) ELSE floor(km + 0.5)::INT || ' km' END AS shown FROM d")
def distance_text(spark, sf):
    return _places(spark, sf).select("id", text.format_distance((F.col("ord") % 200) / 16.0).alias("shown"))


_LOCK = [(["espresso bar"], "france"), (["kitchen"], "germany")]


@query(f"WITH {_PLACE}, t AS (SELECT id, city, {_TEXT} AS tx FROM places) SELECT id, (contains(tx, 'espresso bar') AND lower(city) <> 'france') OR (contains(tx, 'kitchen') AND lower(city) <> 'germany') AS locked FROM t")
def city_lock(spark, sf):
    p = _places(spark, sf)
    return p.select("id", decisions.city_locked_out(rank.text_of(p), F.col("city"), _LOCK).alias("locked"))


_ALIASES = [("france", "roastery"), ("france", "v60"), ("china", "bubble"), ("peru", "starbucks")]


@query(f"""WITH {_PLACE}, t AS (SELECT id, lower(city) AS c, {_TEXT} AS tx FROM places), m AS (SELECT *, {' OR '.join(f"(c <> '{k}' AND contains(tx, '{a}'))" for k, a in _ALIASES)} AS other, contains(tx, c) OR {' OR '.join(f"(c = '{k}' AND contains(tx, '{a}'))" for k, a in _ALIASES)} AS own FROM t)
SELECT id, other AND NOT own AS conflict, NOT (other AND NOT own) AND NOT ((contains(tx, 'espresso bar') AND c <> 'france') OR (contains(tx, 'kitchen') AND c <> 'germany')) AS in_scope FROM m""")
def city_mentions(spark, sf):
    p = _places(spark, sf)
    known = F.array(*[F.struct(F.lit(k).alias("city_key"), F.lit(a).alias("alias")) for k, a in _ALIASES])
    conflict = decisions.conflicting_city(rank.text_of(p), F.lower("city"), known)
    return p.select("id", conflict.alias("conflict"), decisions.in_city_scope(rank.text_of(p), F.col("city"), F.lower("city"), known, _LOCK).alias("in_scope"))


@query("""WITH l AS (SELECT page_id, unnest(regexp_extract_all(html, '<a href="/([^"/]+)"', 1)) AS s, generate_subscripts(regexp_extract_all(html, '<a href="/([^"/]+)"', 1), 1) - 1 AS pos FROM pages) SELECT page_id, lower(s) AS slug, min(pos)::INT AS pos FROM l GROUP BY 1, 2""")
def page_links(spark, sf):
    return readers.page_links(adapters.read(spark, sf, "pages").select("page_id", "html"), r'<a href="/([^"/]+)"').select("page_id", "slug", "pos")


@query(f"""WITH {_PLACE}, h AS (SELECT id, CASE ord % 4 WHEN 0 THEN '"latitude": "' || lat || '", "longitude": ' || lon WHEN 1 THEN 'x/@' || lat || ',' || lon || ',15z' WHEN 2 THEN 'nothing' ELSE '?ll=' || lat || ',' || lon END AS h, ord, lat, lon FROM places)
SELECT id, CASE WHEN ord % 4 <> 2 THEN round(lat, 6) END AS lat, CASE WHEN ord % 4 <> 2 THEN round(lon, 6) END AS lon FROM h""")
def page_coordinates(spark, sf):
    o, la, lo = F.col("ord") % 4, F.col("lat").cast("string"), F.col("lon").cast("string")
    h = F.when(o == 0, F.concat(F.lit('"latitude": "'), la, F.lit('", "longitude": '), lo)).when(o == 1, F.concat(F.lit("x/@"), la, F.lit(","), lo, F.lit(",15z"))).when(o == 2, "nothing").otherwise(F.concat(F.lit("?ll="), la, F.lit(","), lo))
    c = readers.page_coordinates(h)
    return _places(spark, sf).select("id", c.alias("c")).select("id", F.round("c.lat", 6).alias("lat"), F.round("c.lon", 6).alias("lon"))


@query("WITH r AS (SELECT user_id, event_id, event_id % 50 AS request_id FROM events) SELECT user_id, event_id FROM r WHERE request_id = (SELECT max(request_id) FROM r q WHERE q.user_id = r.user_id)")
def latest_request(spark, sf):
    e = adapters.read(spark, sf, "events").select("user_id", "event_id", (F.col("event_id") % 50).alias("request_id"))
    return combine.latest_request(e, "user_id").select("user_id", "event_id")


@query(f"WITH {_PLACE} SELECT DISTINCT city, CASE {' '.join(f"WHEN contains(lower(name), '{w}') THEN '{w}'" for w in _HINTS)} END AS area FROM places WHERE area IS NOT NULL")
def distinct_city_areas(spark, sf):
    return audit.areas(_places(spark, sf), text.first_of(F.lower("name"), _HINTS))


@query("SELECT conv_id, count(*)::BIGINT AS n, arg_min(text, turn) AS first_text FROM conversations GROUP BY 1")
def list_totals(spark, sf):
    return audit.list_sizes(adapters.read(spark, sf, "conversations"), "conv_id", "turn", "text")


@query("SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS n FROM events) WHERE n = 1")
def in_flight_once(spark, sf):
    """The first of equal requests of a user; the stream form drops later ones within its watermark (``live.cached``)."""
    e = adapters.read(spark, sf, "events")
    return live.first_in_flight(e, ["user_id", "event_type"]).select("user_id", "event_id")

