"""Queries of the smaller rules: notes, addresses, images, lookup texts, links to cities, caches and spread ratings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import curation, text
from ..operators import combine, locate, state
from ..sources import readers
from . import adapters
from .catalog import _PLACE, query
from .catalog import _places as places

_NOTE = "CASE ord % 5 WHEN 0 THEN 'Imported from list 7 | ' || name || ' | | good' WHEN 1 THEN '| ' || name || '  |' WHEN 2 THEN 'imported from LIST 9' WHEN 3 THEN 'Area : Old ' || city ELSE name END"


@query(f"""WITH {_PLACE}, n AS (SELECT id, {_NOTE} AS n FROM places), c AS (SELECT id, n, regexp_replace(n, '(?i)imported from list \\d+', '', 'g') AS t FROM n)
SELECT id, nullif(trim(regexp_replace(regexp_replace(t, '\\s*\\|\\s*(\\|\\s*)*', ' | ', 'g'), '^[\\s|]+|[\\s|]+$', '', 'g')), '') AS notes, trim(regexp_extract(trim(n), '^area\\s*:\\s*(.+)$', 1, 'i')) AS area FROM c""")
def tidy_notes(spark, sf):
    """Notes without where they came from, and the area that they name."""
    n = places(spark, sf).select("id", F.expr(_NOTE).alias("n"))
    return n.select("id", text.clean_notes(F.col("n"), [r"imported from list \d+"]).alias("notes"), text.area_of_notes(F.col("n")).alias("area"))


@query(f"""WITH {_PLACE}, p AS (SELECT id, CASE WHEN ord % 2 = 0 THEN name || ' St' END AS street, CASE WHEN ord % 3 = 0 THEN ord::VARCHAR ELSE '' END AS no, CASE WHEN ord % 5 = 0 THEN '100 00' END AS zip, CASE WHEN ord % 7 = 0 THEN NULL ELSE city END AS town, country, CASE WHEN ord % 4 = 0 THEN 'cz' ELSE 'xx' END AS cc FROM places)
SELECT id, concat_ws(', ', nullif(trim(concat_ws(' ', street, nullif(no, ''))), ''), nullif(trim(concat_ws(' ', zip, coalesce(town, 'D 1'))), ''), CASE WHEN cc = 'cz' THEN 'Czech Republic' ELSE country END) AS address FROM p""")
def looked_up_address(spark, sf):
    """One line of address out of what a geocoder says."""
    k = F.col("ord")
    said = {"street": F.when(k % 2 == 0, F.concat("name", F.lit(" St"))), "housenumber": F.when(k % 3 == 0, k.cast("string")).otherwise(""), "postcode": F.when(k % 5 == 0, "100 00"), "city": F.when(k % 7 != 0, F.col("city")), "district": F.lit("D 1"), "country": F.col("country"), "countrycode": F.when(k % 4 == 0, "cz").otherwise("xx")}
    return places(spark, sf).select("id", curation.lookup_address(F.create_map(*[x for n, c in said.items() for x in (F.lit(n), c)])).alias("address"))


@query(f"""WITH {_PLACE} SELECT id, CASE WHEN ord % 2 = 0 THEN 'a' || ord WHEN ord % 3 = 0 THEN 'b' || ord WHEN ord % 5 = 0 THEN 'c1' ELSE 'd2' END AS image,
  array_to_string(list_filter([concat_ws(', ', name, nullif(trim(coalesce(address, '')), ''), city), CASE WHEN address IS NOT NULL AND trim(address) <> '' THEN concat_ws(', ', name, city) END, 'cafe, ' || city], lambda q: q IS NOT NULL), ';') AS asked FROM places""")
def images_and_lookups(spark, sf):
    """The first image of a place's fields, and the texts to look it up with."""
    k, s = F.col("ord"), lambda n, c: F.when(F.col("ord") % n == 0, c).otherwise(" ")
    fields = [s(2, F.concat(F.lit("a"), k.cast("string"))), s(3, F.concat(F.lit("b"), k.cast("string")))]
    lists = [F.array(F.lit(""), F.when(k % 5 == 0, "c1"), F.lit(" ")), F.array(F.lit(None).cast("string"), F.lit("d2"), F.lit("d3"))]
    asked = curation.query_texts((F.col("name"), F.col("address"), F.col("city")), (F.col("name"), F.col("city")), (F.lit("cafe"), F.col("city")))
    return places(spark, sf).select("id", curation.first_image(fields, lists).alias("image"), F.array_join(asked, ";").alias("asked"))


@query("""WITH u AS (SELECT page_id, url, lower(regexp_extract(url, '^[a-z]+://[^/?#]+/+([^/?#]*)', 1)) AS s FROM pages)
SELECT page_id, CASE s WHEN 'en' THEN 'England' ELSE array_to_string(list_transform(string_split(replace(s, '-', ' '), ' '), lambda w: upper(w[1]) || w[2:]), ' ') END AS city FROM u""")
def city_of_link(spark, sf):
    """The city that a page's link names."""
    return adapters.read(spark, sf, "pages").select("page_id", curation.city_of_url(F.col("url"), {"en": "England"}).alias("city"))


@query(f"WITH {_PLACE} SELECT id, array_to_string(CASE WHEN ord % 2 = 0 THEN named ELSE [lower(city)] END, ',') AS aliases FROM (SELECT id, ord, city, [lower(city), lower(city) || ' town'] AS named FROM places)")
def aliases_of_cities(spark, sf):
    """A city's name and aliases as they are matched."""
    given = F.when(F.col("ord") % 2 == 0, F.array(F.concat(F.lit(" "), F.upper("city")), F.concat("city", F.lit(" Town")), F.lit("")))
    return places(spark, sf).select("id", F.array_join(curation.city_aliases(F.col("city"), given), ",").alias("aliases"))


@query("WITH c AS (SELECT user_id, event_id, ts, (SELECT max(ts) FROM events) AS now FROM events) SELECT user_id, event_id FROM c WHERE epoch_ms(now) - epoch_ms(ts) <= 43200000")
def fresh_entries(spark, sf):
    """Cache entries of the last twelve hours before the last event."""
    e = adapters.read(spark, sf, "events").select("user_id", "event_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("ts"))
    now = e.agg(F.max("ts")).first()[0]
    return readers.fresh(e, F.lit(now), 12 * 60).select("user_id", "event_id")


@query(f"""WITH {_PLACE}, a AS (SELECT address, ord AS rank, lat, lon FROM places WHERE ord % 2 = 0), f AS (SELECT address, arg_min(lat, rank) AS lat, arg_min(lon, rank) AS lon FROM a GROUP BY 1)
SELECT p.id, CASE WHEN length(trim(p.address)) >= 13 THEN f.lat END AS lat, CASE WHEN length(trim(p.address)) >= 13 THEN f.lon END AS lon FROM places p LEFT JOIN f USING (address)""")
def first_answers(spark, sf):
    """The first answer to each address that is long enough to ask for."""
    p = places(spark, sf)
    answers = p.filter("ord % 2 = 0").select("address", F.col("ord").alias("rank"), "lat", "lon")
    return combine.first_hit(p.select("id", "address"), answers, least=13).select("id", "lat", "lon")


@query(f"""WITH {_PLACE}, n AS (SELECT id, trim(regexp_replace(lower(name), '\\s+', ' ', 'g')) AS n FROM places), r AS (SELECT n, max(rating) AS rating FROM n JOIN ratings ON place_id = id GROUP BY 1) SELECT id AS place_id, rating FROM n JOIN r USING (n)""")
def spread_ratings(spark, sf):
    """A rating holds for all places of the same name."""
    return state.spread_by_name(adapters.ratings(spark, sf), places(spark, sf))


@query(f"""WITH {_PLACE}, m AS (SELECT id, city, city_key, CASE WHEN ord % 4 = 0 THEN 'NATION_' || (ord % 7) END AS mentioned, CASE WHEN ord % 3 <> 0 THEN 'NATION_' || (ord % 5) END AS near FROM places)
SELECT id, CASE WHEN mentioned IS NOT NULL THEN mentioned = city OR mentioned = 'NATION_' || (city_key % 5) WHEN near IS NOT NULL THEN near = city OR near = 'NATION_' || (city_key % 5) ELSE true END AS here FROM m""")
def scope_of_city(spark, sf):
    """Whether a place is its city's: by the city that it mentions, else by the nearest one, else yes; cities of a group count as one."""
    named = lambda c: F.concat(F.lit("NATION_"), c.cast("string"))
    k = F.col("ord")
    here = locate.in_scope(F.when(k % 4 == 0, named(k % 7)), F.when(k % 3 != 0, named(k % 5)), F.col("city"), F.array(named(F.col("city_key") % 5)))
    return places(spark, sf).select("id", here.alias("here"))
