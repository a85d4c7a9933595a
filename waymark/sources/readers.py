"""Scans of the source families, by explicit schemas; unreadable rows are kept apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo
from ..functions.text import parse_number
from . import json_walk

PLACE = "name string, address string, formattedAddress string, vicinity string, latitude string, longitude string, lat string, lon string, lng string, coords map<string,string>, location map<string,string>, googleMapsUrl string, photoUrl string, types string, notes string, description string, specialtyScore double, status string"
LISTS = f"exportedAt string, lists array<struct<url string, error string, places array<struct<{', '.join(f'{c.split()[0]}:{c.split()[1]}' for c in PLACE.split(', '))}>>>>".replace("url string, error string, places ", "url:string,error:string,places:")
ELEMENTS = "elements array<struct<type:string,id:bigint,lat:double,lon:double,center:struct<lat:double,lon:double>,tags:map<string,string>>>"
SEEDED = "name string, address string, source string, isSpecialty boolean, needsCoords boolean, lat string, lon string, photoUrl string, notes string, id string, city string, cityName string, state string, country string, phone string, score double, specialtyScore double, placeType string, types string"


def _json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON documents of a path; a path that is not there gives an empty table."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).globStatus(at):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE").json(path)


def string_or_array(value: Column) -> Column:
    """A field that holds a JSON array or one text, as an array without empties."""
    as_array = F.when(F.ltrim(value).startswith("["), F.from_json(value, "array<string>")).otherwise(F.array(value))
    return F.filter(F.coalesce(as_array, F.array().cast("array<string>")), lambda x: x.isNotNull() & (x != ""))


def lists(spark: SparkSession, path: str, center: tuple[float, float] | None = None) -> DataFrame:
    """Places of list documents, one row each, with an id from their positions.

    Of all fields that may hold coordinates the pair nearest to ``center`` counts, where one is given, else the first sound one.
    """
    doc = _json(spark, path, LISTS)
    rows = doc.select(F.posexplode("lists").alias("list", "l")).select("list", F.posexplode("l.places").alias("pos", "p")).select("list", "pos", "p.*")
    address = F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in ("address", "formattedAddress", "vicinity")])
    read = lambda *fields: [parse_number(F.col(f)) for f in fields]
    best = geo.best_coordinates(read("lat", "latitude", "coords.lat", "location.lat"), read("lon", "lng", "longitude", "coords.lon", "coords.lng", "location.lon", "location.lng"), *[F.lit(x).cast("double") for x in center or (None, None)])
    rows = rows.withColumn("best", best)
    return rows.select(
        F.concat_ws("-", F.lit("google"), "list", "pos").alias("id"), "name", F.regexp_replace(address, "^[‎‏‪-‮]+", "").alias("address"),
        F.col("best.lat").alias("lat"), F.col("best.lon").alias("lon"),
        F.col("googleMapsUrl").alias("url"), F.col("photoUrl").alias("photo_url"), string_or_array(F.col("types")).alias("types"), string_or_array(F.col("notes")).alias("notes"), "description", "status", F.lit("google").alias("source"),
    )


def map_elements(spark: SparkSession, path: str) -> DataFrame:
    """Map elements as places; rows without coordinates go, rows without a name have ``named`` false."""
    rows = _json(spark, path, ELEMENTS).select(F.inline("elements"))
    t = lambda k: F.nullif(F.trim(F.try_element_at("tags", F.lit(k))), F.lit(""))
    street = F.concat_ws(" ", t("addr:street"), t("addr:housenumber"))
    address = F.concat_ws(", ", F.nullif(street, F.lit("")), t("addr:city"), t("addr:postcode"))
    name = F.coalesce(t("name"), t("name:he"), t("name:en"), t("brand"), t("operator"))
    out = rows.select(
        F.concat_ws("-", "type", "id").alias("id"), name.alias("name"), F.coalesce("lat", "center.lat").alias("lat"), F.coalesce("lon", "center.lon").alias("lon"), F.nullif(address, F.lit("")).alias("address"),
        t("cuisine").alias("cuisine"), t("description").alias("description"), t("brand").alias("brand"), t("opening_hours").alias("opening_hours"), F.coalesce(t("website"), t("contact:website")).alias("website"),
        F.coalesce(t("phone"), t("contact:phone"), t("contact:mobile")).alias("phone"), F.coalesce("tags", F.create_map().cast("map<string,string>")).alias("tags"),
    )
    return out.filter("lat is not null and lon is not null").withColumn("named", F.col("name").isNotNull())


def seeded(spark: SparkSession, path: str) -> DataFrame:
    """Curated places of all city files below ``path``, with the file's name as city_file."""
    return _json(spark, path, SEEDED).withColumn("city_file", F.regexp_extract(F.input_file_name(), r"([^/]+)\.json$", 1)).withColumn("lat", parse_number(F.col("lat"))).withColumn("lon", parse_number(F.col("lon"))).withColumn("types", string_or_array(F.col("types")))


def city_places(spark: SparkSession, path: str, cities: DataFrame) -> DataFrame:
    """Places that ``writers.write_by_city`` wrote, of the given cities (rows of its index) alone.

    Only those cities' folders are read: what the filter on ``cities`` leaves prunes the scan while it runs.
    """
    return spark.read.parquet(path).join(F.broadcast(cities.select("city_slug").distinct()), "city_slug", "left_semi")  # one row a city


def list_urls(spark: SparkSession, path: str) -> DataFrame:
    """Trimmed lines of text files that are neither blank nor comments."""
    return spark.read.text(path).select(F.trim("value").alias("url")).filter("url != '' and not startswith(url, '#')")


def html_meta(html: Column) -> Column:
    """struct(title, image) from the first 50,000 characters of a page's head."""
    head = F.substring(html, 1, 50_000)
    find = lambda p: F.nullif(F.trim(F.regexp_extract(head, p, 1)), F.lit(""))
    meta = lambda n: F.coalesce(find(rf'(?is)<meta[^>]+(?:property|name)=["\']{n}["\'][^>]*content=["\']([^"\']+)'), find(rf'(?is)<meta[^>]+content=["\']([^"\']+)["\'][^>]*(?:property|name)=["\']{n}["\']'))
    return F.struct(find("(?is)<title[^>]*>(.*?)</title>").alias("title"), F.coalesce(meta("og:image"), meta("twitter:image")).alias("image"))


def url_coordinates(url: Column) -> Column:
    """struct(lat, lon) from a map URL: its data part, else its centre, else its ll parameter."""
    num = r"(-?\d+(?:\.\d+)?)"
    patterns = (rf"!3d{num}!4d{num}", rf"@{num},{num}", rf"[?&]ll={num},{num}")
    out = F.lit(None).cast("struct<lat:double,lon:double>")
    for p in reversed(patterns):
        g = lambda i, p=p: F.regexp_extract(url, p, i).try_cast("double")
        out = F.when(url.rlike(p), F.struct(g(1).alias("lat"), g(2).alias("lon"))).otherwise(out)
    return out


def named_coordinates(html: Column) -> Column:
    """struct(lat, lon) from the first members called exactly latitude and longitude in a page's text."""
    lat, lon = (F.regexp_extract(html, rf'(?i)"{k}"\s*:\s*"?(-?\d+(?:\.\d+)?)"?', 1).try_cast("double") for k in ("latitude", "longitude"))
    return F.when(lat.isNotNull() & lon.isNotNull(), F.struct(lat.alias("lat"), lon.alias("lon")))


def marker_coordinates(html: Column, marker: str = "marker-cafe.png") -> Column:
    """struct(lat, lon) from a static map's marker, marker(lon,lat)/lon,lat,zoom."""
    num = r"(-?\d+(?:\.\d+)?)"
    pattern = rf"(?i)\Q{marker}\E\({num},{num}\)/{num},{num},\d+"
    lon, lat = (F.regexp_extract(html, pattern, i).try_cast("double") for i in (1, 2))
    return F.when(lat.isNotNull() & lon.isNotNull(), F.struct(lat.alias("lat"), lon.alias("lon")))


def page_coordinates(html: Column) -> Column:
    """struct(lat, lon) from a page's text: named members, else a map marker, else a map's URL."""
    return F.coalesce(named_coordinates(html), marker_coordinates(html), url_coordinates(html))


def page_points(pages: DataFrame, key: str, html: str = "html") -> DataFrame:
    """(key, lat, lon, stage) of the pages that have coordinates: linked data before the page's text.

    ``key`` names a page; stage is linked or text.
    """
    linked = json_walk.linked_points(pages, html, key).select(F.col(key).alias("_page"), F.struct("lat", "lon").alias("_linked"))
    both = pages.select(F.col(key), page_coordinates(F.col(html)).alias("_text")).join(linked, F.col(key).eqNullSafe(F.col("_page")), "left")
    point, stage = F.coalesce("_linked", "_text"), F.when(F.col("_linked").isNotNull(), "linked").otherwise("text")
    return both.select(key, point.alias("p"), stage.alias("stage")).filter("p is not null").select(key, "p.lat", "p.lon", "stage")


def page_links(pages: DataFrame, pattern: str, html: str = "html") -> DataFrame:
    """First link of each slug on each page: slug, and its heading within the next 600 characters."""
    parts = F.split(F.col(html), pattern, -1)
    rows = pages.withColumn("_slugs", F.regexp_extract_all(html, F.lit(pattern), F.lit(1))).withColumn("_parts", parts)
    rows = rows.select(*[c for c in pages.columns if c != html], "_parts", F.posexplode("_slugs").alias("pos", "slug"))
    rows = rows.withColumn("heading", F.nullif(F.trim(F.regexp_replace(F.regexp_extract(F.substring(F.get("_parts", F.col("pos") + 1), 1, 600), "(?is)<h3[^>]*>(.*?)</h3>", 1), "<[^>]+>", " ")), F.lit("")))
    keys = [c for c in pages.columns if c != html]
    return rows.groupBy(*keys, F.lower("slug").alias("slug")).agg(F.min("pos").alias("pos"), F.min_by("heading", "pos").alias("heading"))


def fresh(cache: DataFrame, as_of: Column, minutes: int = 30) -> DataFrame:
    """Cache rows (ts in milliseconds) that are not older than ``minutes``."""
    return cache.filter(as_of - F.col("ts") <= minutes * 60_000)


ENTITY_NAME, ENTITY_DETAILS, ENTITY_ADDRESSES, ENTITY_POINT = 2, 1, (4, 2), 5


def entity_list(responses: DataFrame, body: str = "body") -> DataFrame:
    """Places of list responses, whose JSON holds values by position; broken ones give no rows.

    A line that guards the JSON is dropped.  Of places with the same name and address in lower case the
    first of a response stays.
    """
    text = F.when(F.col(body).startswith(")]}'"), F.regexp_replace(F.col(body), r"^[^\n]*\n", "")).otherwise(F.col(body))
    at = lambda v, path, kind: F.try_variant_get(v, path, kind)
    whole = responses.withColumn("_response", F.monotonically_increasing_id()).select("_response", F.try_parse_json(text).alias("v"))
    items = whole.select("_response", F.posexplode(at(F.col("v"), "$[0][8]", "array<variant>")).alias("pos", "i"))
    item = F.col("i")
    said = lambda path: F.nullif(F.trim(at(item, path, "string")), F.lit(""))
    rows = items.select(
        "_response", "pos", said(f"$[{ENTITY_NAME}]").alias("name"), F.coalesce(*[said(f"$[{ENTITY_DETAILS}][{k}]") for k in ENTITY_ADDRESSES]).alias("address"),
        at(item, f"$[{ENTITY_DETAILS}][{ENTITY_POINT}][2]", "double").alias("lat"), at(item, f"$[{ENTITY_DETAILS}][{ENTITY_POINT}][3]", "double").alias("lon"), at(item, f"$[{ENTITY_DETAILS}]", "array<variant>").isNotNull().alias("_ok"),
    )
    rows = rows.filter("_ok and name is not null").withColumn("_key", F.concat_ws("|", F.lower("name"), F.lower(F.coalesce("address", F.lit("")))))
    first = rows.groupBy("_response", "_key").agg(F.min_by(F.struct("pos", "name", "address", "lat", "lon"), "pos").alias("p"))
    both = F.col("p.lat").isNotNull() & F.col("p.lon").isNotNull()
    return first.select("p.pos", "p.name", "p.address", F.when(both, F.col("p.lat")).alias("lat"), F.when(both, F.col("p.lon")).alias("lon"))


def city_slugs(links: DataFrame, pattern: str, stop: list[str], pages: DataFrame, cafe_link: str, least: int = 8, url: str = "href", html: str = "html") -> DataFrame:
    """Slugs of city pages: links that match and are not stop words, whose page (slug, html) has ``least`` cafe links."""
    found = links.select(F.lower(F.regexp_extract(F.col(url), pattern, 1)).alias("slug")).filter(F.col("slug") != "").filter(~F.col("slug").isin(stop)).distinct()
    counted = pages.select(F.lower("slug").alias("slug"), F.regexp_count(F.col(html), F.lit(cafe_link)).alias("n"))
    return found.join(counted.filter(F.col("n") >= least), "slug").select("slug", "n").orderBy("slug")
