"""Queries of deep searches, folded texts, resolved links, lookups by containment, and cascades by city."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import assign, audit, matching
from ..operators.graph import materialised, scratch_path
from ..sources import json_walk, readers, writers
from . import adapters, city
from .catalog import _PLACE, query


@query("SELECT doc_id, length(strip_accents(text))::BIGINT AS n, md5(strip_accents(text)) AS folded FROM documents")
def folded_texts(spark, sf):
    """Every document's whole text without accents."""
    f = text.folded(F.col("text"))
    return adapters.read(spark, sf, "documents").select("doc_id", f.alias("f")).select("doc_id", F.length("f").cast("long").alias("n"), F.md5("f").alias("folded"))


_REFERENCE = "CASE pos % 5 WHEN 0 THEN href WHEN 1 THEN '..' || href WHEN 2 THEN 'a/./b/../' || substr(href, 2) || '?q=1#x' WHEN 3 THEN '//Other.example' || href || '/..' ELSE '?only=' || CAST(pos AS VARCHAR(20)) END"
_GROUPS = r"^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?"
_DOTS = lambda p: f"list_reduce(list_transform(string_split({p}, '/')[2:], lambda s: [s]), lambda done, s: CASE WHEN s[1] = '.' THEN done WHEN s[1] = '..' THEN done[:-2] ELSE list_concat(done, s) END, []::VARCHAR[])"
_FLAT = lambda p: f"('/' || array_to_string(CASE WHEN string_split({p}, '/')[-1] IN ('.', '..') THEN list_append({_DOTS(p)}, '') ELSE {_DOTS(p)} END, '/'))"


@query(f"""WITH h AS (SELECT page_id, url, regexp_extract_all(html, 'href="([^"]*)"', 1) AS hs FROM pages), l AS (SELECT page_id, url, unnest(hs) AS href, unnest(range(len(hs))) AS pos FROM h),
r AS (SELECT page_id, pos, regexp_extract({_REFERENCE}, '{_GROUPS}', ['s', 'a', 'p', 'q', 'f']) AS r, contains({_REFERENCE}, '//') AS own, regexp_extract(url, '{_GROUPS}', ['s', 'a', 'p', 'q', 'f']) AS b FROM l),
p AS (SELECT *, CASE WHEN own OR r.p LIKE '/%' THEN r.p WHEN r.p = '' THEN b.p ELSE regexp_replace(b.p, '[^/]*$', '') || r.p END AS path FROM r)
SELECT page_id, pos::BIGINT AS pos, b.s || '://' || CASE WHEN own THEN r.a ELSE b.a END || CASE WHEN r.p = '' AND NOT own THEN path ELSE {_FLAT('path')} END
  || coalesce('?' || nullif(CASE WHEN own OR r.p <> '' OR r.q <> '' THEN r.q ELSE b.q END, ''), '') || coalesce('#' || nullif(r.f, ''), '') AS link FROM p""")
def absolute_links(spark, sf):
    """Links of every page, some with steps, hosts or queries of their own, as absolute URLs."""
    pages = adapters.read(spark, sf, "pages").select("page_id", "url", F.posexplode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("pos", "href"))
    return pages.select("page_id", F.col("pos").cast("long").alias("pos"), text.absolute_url(F.expr(_REFERENCE.replace("VARCHAR(20)", "STRING")), F.col("url")).alias("link"))


_LINKED = """CASE page_id % 5 WHEN 0 THEN '{"@type":"x","z":{"deep":[1,[{"q":null},{"longitude":' || CAST(page_id % 90 AS VARCHAR(20)) || ',"latitude":"' || CAST(page_id % 45 AS VARCHAR(20)) || '.5"}]]},"a":{"lat":1,"lng":2}}'
  WHEN 1 THEN '[{"name":"n"},{"maxLatitude":9,"geo":{"lat":' || CAST(page_id % 45 AS VARCHAR(20)) || ',"lng":-3.25}}]' WHEN 2 THEN '{"broken":' WHEN 3 THEN '{"latitude":"north","longitude":3}' ELSE '"text"' END"""
_HTML = f"""'<script type="application/ld+json">{{"first":[]}}</script><script type="application/ld+json">' || {_LINKED} || '</script>' || html || CASE WHEN page_id % 3 = 0 THEN '{{"maxLatitude": 1, "latitude": 7.5, "longitude": "-8.25"}}' WHEN page_id % 3 = 1 THEN 'marker-cafe.png(5.5,6.25)/5.5,6.25,14' ELSE '' END"""


@query(f"""WITH h AS (SELECT page_id, {_HTML} AS html FROM pages), s AS (SELECT page_id, unnest(list_zip(range(9), regexp_extract_all(html, '<script type="application/ld\\+json">(.*?)</script>', 1)[1:9])) AS s FROM h),
j AS (SELECT page_id, s[1] AS n, s[2] AS j FROM s WHERE s[2] IS NOT NULL AND json_valid(s[2])), t AS (SELECT page_id, n, t.id, t.value, t.type FROM j, json_tree(j.j) t),
o AS (SELECT page_id, n, id, CASE WHEN try_cast(value ->> '$.latitude' AS DOUBLE) IS NOT NULL AND try_cast(value ->> '$.longitude' AS DOUBLE) IS NOT NULL THEN [try_cast(value ->> '$.latitude' AS DOUBLE), try_cast(value ->> '$.longitude' AS DOUBLE)]
  WHEN try_cast(value ->> '$.lat' AS DOUBLE) IS NOT NULL AND try_cast(value ->> '$.lng' AS DOUBLE) IS NOT NULL THEN [try_cast(value ->> '$.lat' AS DOUBLE), try_cast(value ->> '$.lng' AS DOUBLE)] END AS p FROM t WHERE type = 'OBJECT'),
l AS (SELECT page_id, arg_min(p, (n, id)) AS p FROM o WHERE p IS NOT NULL GROUP BY 1),
x AS (SELECT page_id, try_cast(nullif(regexp_extract(html, '"latitude"\\s*:\\s*"?(-?\\d+(?:\\.\\d+)?)"?', 1), '') AS DOUBLE) AS la, try_cast(nullif(regexp_extract(html, '"longitude"\\s*:\\s*"?(-?\\d+(?:\\.\\d+)?)"?', 1), '') AS DOUBLE) AS lo, contains(html, 'marker-cafe') AS m FROM h)
SELECT page_id, coalesce(p[1], CASE WHEN la IS NOT NULL AND lo IS NOT NULL THEN la WHEN m THEN 6.25 END) AS lat, coalesce(p[2], CASE WHEN la IS NOT NULL AND lo IS NOT NULL THEN lo WHEN m THEN 5.5 END) AS lon, CASE WHEN p IS NULL THEN 'text' ELSE 'linked' END AS stage
FROM x LEFT JOIN l USING (page_id) WHERE p IS NOT NULL OR m OR la IS NOT NULL AND lo IS NOT NULL""")
def page_points(spark, sf):
    """Coordinates of every page, to which linked data, named members and map markers were added."""
    pages = adapters.read(spark, sf, "pages").select("page_id", F.expr(_HTML.replace("VARCHAR(20)", "STRING")).alias("html"))
    return readers.page_points(pages, "page_id")


_RESPONSE = """'[null,{"k":["http://lh3.googleusercontent.com/no",{"n":' || CAST(p_partkey AS VARCHAR(20)) || CASE WHEN p_partkey % 3 = 0 THEN ',"z":[["https://lh3.googleusercontent.com/p/' || CAST(p_partkey AS VARCHAR(20)) || '"]]' ELSE '' END || '}]},"https://x.example/a"' || CASE WHEN p_partkey % 4 < 2 THEN ',{"a":" https://LH5.GoogleUserContent.com/q ","b":"https://lh3.googleusercontent.com/r"}]' ELSE ']' END"""


@query(f"""WITH d AS (SELECT p_partkey, {_RESPONSE} AS j FROM part), t AS (SELECT p_partkey, t.id, trim(t.atom ->> '$') AS s FROM d, json_tree(d.j) t WHERE t.type = 'VARCHAR')
SELECT p_partkey, arg_min(s, id) AS image FROM t WHERE regexp_matches(s, '^https://') AND contains(lower(s), 'googleusercontent.com') GROUP BY 1""")
def first_images(spark, sf):
    """The first image in each of a table of nested responses."""
    docs = adapters.read(spark, sf, "part").select("p_partkey", F.expr(_RESPONSE.replace("VARCHAR(20)", "STRING")).alias("json"))
    return json_walk.first_string(docs, "json", "p_partkey", json_walk.is_image(F.col("text"), "googleusercontent.com")).select("p_partkey", F.col("text").alias("image"))


_ASKED = "CASE ord % 5 WHEN 0 THEN lower(city) WHEN 1 THEN lower(city) || ' old town' WHEN 2 THEN substr(lower(city), 2, 3) WHEN 3 THEN 'nowhere ' || CAST(ord AS VARCHAR(20)) ELSE substr(lower(city), 1, 1) END"


@query(f"""WITH {_PLACE}, a AS (SELECT id, {_ASKED} AS asked FROM places), q AS (SELECT DISTINCT asked FROM a), c AS (SELECT lower(city) AS name, city_key FROM cities),
m AS (SELECT asked, arg_min(name, (name <> asked, city_key)) AS city FROM q JOIN c ON contains(asked, name) OR contains(name, asked) GROUP BY 1) SELECT id, asked, m.city FROM a LEFT JOIN m USING (asked)""")
def contained_names(spark, sf):
    """Texts that name a city in whole, in part or with more, each with its city."""
    places = adapters.places(spark, sf).select("id", F.expr(_ASKED.replace("VARCHAR(20)", "STRING")).alias("asked"))
    cities = adapters.cities(spark, sf).select(F.lower("city").alias("name"), "city_key")
    return matching.contained(places, cities, "asked", "name", "city_key").select("id", "asked", F.col("match.name").alias("city"))


@query(f"WITH {_PLACE} SELECT id, lower(city) AS city_slug FROM (SELECT id, regexp_replace(city, '[^A-Za-z0-9]+', '-', 'g') AS city FROM places WHERE country = 'EUROPE')")
def city_scan(spark, sf):
    """Places written by city, of which one region's are read again: only their folders are."""
    path = scratch_path(spark)
    places = adapters.places(spark, sf).select("id", "city", "lat", "lon")
    index = materialised(writers.write_by_city(places, path))
    regions = adapters.cities(spark, sf).select(F.col("city").alias("name"), "country")
    wanted = materialised(index.join(regions, F.col("city") == F.col("name"))).filter("country = 'EUROPE'")
    return readers.city_places(spark, path, wanted).select("id", "city_slug")


@query(f"""WITH {_PLACE}, u AS (SELECT id, city, 0 AS stage FROM places WHERE city_key % 3 = 0 AND ord % 2 = 0 UNION ALL SELECT id, city, 1 FROM places WHERE city_key % 3 < 2 AND source = 'google' UNION ALL SELECT id, city, 2 FROM places),
f AS (SELECT city, min(stage) AS stage FROM u GROUP BY 1) SELECT id, city, stage FROM u JOIN f USING (city, stage)""")
def fallback_by_city(spark, sf):
    """For each city the narrowest of three scans that finds any place."""
    p = adapters.places(spark, sf).select("id", "city", "city_key", "ord", "source")
    parts = [p.filter("city_key % 3 = 0 and ord % 2 = 0"), p.filter("city_key % 3 < 2 and source = 'google'"), p]
    return audit.fallback_by(parts, "city").select("id", "city", "stage")


@query()
def photo_replacement(spark, sf):
    """Photos that places of a city share replaced by those that no other place of the city has."""
    p = adapters.places(spark, sf).select("id", "ord", "city", F.concat(F.lit("u"), (F.col("ord") % 30).cast("string")).alias("photo_url"))
    wishes = p.select("id", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("place"), "ord").withColumn("url", F.concat(F.lit("c"), ((F.col("ord") * 7 + F.col("place") * 13) % 900).cast("string")))
    return assign.replace_photos(p, wishes.drop("ord")).select("id", "city", "photo_url", "replaced")


@query()
def city_view(spark, sf):
    """Every city's places as a user sees them, with overrides, ratings, hidden ids, curated places and fallbacks."""
    out = city.see(**city.given(spark, sf))
    return out.select("city", "rank", "id", "name", "score", "place_type", F.coalesce("rating", F.lit(0)).alias("rating"), "open", F.element_at(F.array(*[F.lit(s) for s in city.STAGES]), F.col("stage") + 1).alias("stage"))


@query()
def city_view_filtered(spark, sf):
    """The same with a least score, open places only and a text: cities without such places are empty."""
    view = city.View(least=40.0, filters={"open_now": True, "text": "e"})
    return city.see(**city.given(spark, sf), view=view).select("city", "rank", "id", "score", "open")
