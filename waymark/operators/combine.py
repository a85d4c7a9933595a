"""Sources put together, and user state over them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import haversine_km
from ..functions.scoring import tag
from . import locate


def with_new(base: DataFrame, more: DataFrame, city: str = "city", name: str = "name") -> DataFrame:
    """The rows of ``more`` whose lower-case name the city's base does not have, before the base (column stage: 0, 1)."""
    key = lambda df: df.select(F.col(city).alias("_city"), F.lower(F.coalesce(F.col(name), F.lit(""))).alias("_name")).distinct()
    here = (F.col(city) == F.col("_city")) & (F.lower(F.coalesce(F.col(name), F.lit(""))) == F.col("_name"))
    new = more.join(key(base), here, "left_anti")
    return new.withColumn("stage", F.lit(0)).unionByName(base.withColumn("stage", F.lit(1)), allowMissingColumns=True)


def names_not_in(new: DataFrame, known: DataFrame, by: str = "city_key", name: str = "name") -> DataFrame:
    """Rows whose lower-case name the known ones of their city do not have."""
    have = known.select(F.col(by).alias("_by"), F.lower(name).alias("_name")).distinct()
    return new.join(have, (F.col(by) == F.col("_by")) & (F.lower(F.col(name)) == F.col("_name")), "left_anti")


def name_scan(asked: DataFrame, elements: DataFrame, km: float = 12.0) -> DataFrame:
    """For each name asked for around a point (asked, city_lat, city_lon) the first element by ord that is called so, coffee before others.

    ``elements``: id, ord, name, lat, lon and tags; a name holds the asked one whatever its case.  Points are
    few; each name is tested against the elements near its points alone.
    """
    near = locate.radius_join(elements, asked.withColumn("_asked", F.lower("asked")), km).filter(F.contains(F.lower(F.col("name")), F.col("_asked")))
    tags = F.col("tags")
    coffee = F.lower(tag(tags, "amenity")).isin("cafe", "coffee") | (F.lower(tag(tags, "shop")) == "coffee")
    key = F.struct("asked", "city_lat", "city_lon")
    return prefer(near.withColumn("_point", key), "_point", coffee).drop("_point", "_asked")


def street_scan(elements: DataFrame, points: DataFrame, pattern: str, metres: float, street: str = "addr:street") -> DataFrame:
    """Elements near a point whose street matches a pattern, whatever its case; named or not."""
    wanted = F.coalesce(tag(F.col("tags"), street), F.lit("")).rlike("(?i)" + pattern)
    return locate.radius_join(elements.filter(wanted), points, metres / 1000)


def by_mode(mode: str, mapped: DataFrame, listed: DataFrame) -> DataFrame:
    """The sources that a mode shows: lists alone, or the map before the lists."""
    return listed if mode == "google" else mapped.unionByName(listed, allowMissingColumns=True)


def first_known(parts: Sequence[DataFrame], keys: Column, columns: Sequence[str], order: str = "ord") -> DataFrame:
    """For each key (column key) the first place that has it: by part, then by order in the part."""
    tagged = [p.select(F.lit(i).alias("_part"), F.col(order).alias("_ord"), F.struct(*columns).alias("_place"), F.explode(keys).alias("key")) for i, p in enumerate(parts)]
    whole = tagged[0]
    for t in tagged[1:]:
        whole = whole.unionByName(t)
    first = whole.filter("key != ''").groupBy("key").agg(F.min_by("_place", F.struct("_part", "_ord")).alias("_place"))
    return first.select("key", *[F.col(f"_place.{c}").alias(c) for c in columns])


def override_view(overrides: DataFrame, known: DataFrame) -> DataFrame:
    """Overrides (id, patch, deleted, updated_at) with the place each one is of, latest first.

    ``known``: key, name, city and source of places.  The view's name is the patch's, else the place's, else the id.
    """
    of = lambda k: F.nullif(F.try_element_at("patch", F.lit(k)), F.lit(""))
    joined = overrides.join(known.select(F.col("key").alias("id"), F.col("name").alias("_name"), F.col("city").alias("_city"), F.col("source").alias("_source")), "id", "left")
    view = joined.select(
        "id", F.coalesce(of("name"), F.nullif("_name", F.lit("")), "id").alias("name"), F.coalesce(of("cityName"), "_city", F.lit("")).alias("city"), F.coalesce(of("source"), "_source", F.lit("")).alias("source"),
        F.coalesce("deleted", F.lit(False)).alias("deleted"), F.coalesce("updated_at", F.lit(0).cast("long")).alias("updated_at"),
    )
    return view.orderBy(F.desc("updated_at"), F.expr("name COLLATE UNICODE"), "id")


def legacy_map(places: DataFrame, id_: str = "id", legacy: str = "legacy") -> DataFrame:
    """(legacy_id, id): of places that share a legacy id the last by ord."""
    pairs = places.select(F.col(id_).alias("id"), "ord", F.explode(legacy).alias("legacy_id")).filter("legacy_id != '' and legacy_id != id")
    return pairs.groupBy("legacy_id").agg(F.max_by("id", "ord").alias("id"))


def migrate_ratings(ratings: DataFrame, moves: DataFrame) -> DataFrame:
    """Ratings with those of legacy ids copied to ids that have none; the greatest where several would move."""
    moved = ratings.filter("rating != 0").join(moves.withColumnRenamed("legacy_id", "place_id"), "place_id").groupBy(F.col("id").alias("place_id")).agg(F.max("rating").alias("rating"))
    new = moved.join(ratings.filter("rating > 0").select("place_id"), "place_id", "left_anti")
    return ratings.join(new.select("place_id"), "place_id", "left_anti").unionByName(new)


def migrate_hidden(hidden: DataFrame, moves: DataFrame) -> DataFrame:
    """Hidden keys and the ids that hidden legacy ids stand for."""
    more = hidden.join(moves.select(F.col("legacy_id").alias("place_key"), "id"), "place_key").select(F.col("id").alias("place_key"))
    return hidden.select("place_key").union(more).distinct()


def pinned(df: DataFrame, id_: str, *order: Column, column: str = "id") -> DataFrame:
    """Rows in order, the one of the given id before all others."""
    return df.orderBy(F.desc(F.coalesce(F.col(column) == id_, F.lit(False))), *order)


def city_dimension(defaults: DataFrame, meta: DataFrame) -> DataFrame:
    """Cities (name, lat, lon) of both tables by name; defaults win, invalid centres go."""
    d = defaults.select("name", F.struct("lat", "lon").alias("_d"))
    m = meta.groupBy("name").agg(F.max_by(F.struct("lat", "lon"), "ord").alias("_m"))
    both = d.join(m, "name", "full_outer").select("name", F.coalesce("_d", "_m").alias("c"))
    sound = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return both.select("name", F.col("c.lat").cast("double").alias("lat"), F.col("c.lon").cast("double").alias("lon")).filter(sound(F.col("lat")) & sound(F.col("lon"))).orderBy(F.expr("name COLLATE UNICODE"))


def fill_missing(df: DataFrame, found: DataFrame, key: str, column: str, limit: int | None = None, order: str = "ord") -> DataFrame:
    """``column`` of rows that have none from ``found`` (key, column), of the first ``limit`` such rows where one is given."""
    empty = F.trim(F.coalesce(F.col(column), F.lit(""))) == ""
    wanted = df.filter(empty)
    wanted = (wanted.orderBy(order).limit(limit) if limit is not None else wanted).select(key)
    new = found.join(wanted, key, "left_semi").groupBy(key).agg(F.min(column).alias("_new"))
    return df.join(new, key, "left").withColumn(column, F.when(empty, F.coalesce("_new", column)).otherwise(F.col(column))).drop("_new")


def photo_groups(places: DataFrame, photo: str = "photo_url", city: str = "city") -> DataFrame:
    """Photos that several places of a city have: how many, and the first place by ord, which keeps it."""
    full = places.filter(F.col(photo) != "")
    return full.groupBy(F.col(city).alias("city"), F.col(photo).alias("photo_url")).agg(F.count(F.lit(1)).alias("n"), F.min_by("id", "ord").alias("first_id")).filter("n > 1")


def outcomes(df: DataFrame, by: Sequence[str] = (), **conditions: Column) -> DataFrame:
    """How many rows meet each condition, and how many there are."""
    return df.groupBy(*by).agg(*[F.count_if(c).alias(n) for n, c in conditions.items()], F.count(F.lit(1)).alias("all"))


def with_cached_address(places: DataFrame, cache: DataFrame, lat: str = "lat", lon: str = "lon", address: str = "address") -> DataFrame:
    """Addresses of places that have none from a cache (lat, lon, address), met on coordinates of six decimals."""
    key = lambda a, o: F.format_string("%.6f,%.6f", a.cast("double"), o.cast("double"))
    known = cache.filter("address != ''").groupBy(key(F.col("lat"), F.col("lon")).alias("_key")).agg(F.min("address").alias("_cached"))
    empty = F.trim(F.coalesce(F.col(address), F.lit(""))) == ""
    keyed = places.withColumn("_key", F.when(empty & F.col(lat).isNotNull() & F.col(lon).isNotNull(), key(F.col(lat), F.col(lon))))
    return keyed.join(known, "_key", "left").withColumn(address, F.when(empty, F.coalesce("_cached", address)).otherwise(F.col(address))).drop("_key", "_cached")


def first_hit(wanted: DataFrame, answers: DataFrame, text: str = "address", least: int = 5, order: str = "rank") -> DataFrame:
    """The first answer (text, lat, lon by ``order``) of each text of at least ``least`` characters; others get none."""
    first = answers.groupBy(text).agg(F.min_by(F.struct("lat", "lon"), order).alias("_hit"))
    long_ = F.length(F.trim(F.col(text))) >= least
    return wanted.join(first, text, "left").withColumn("lat", F.when(long_, F.col("_hit.lat"))).withColumn("lon", F.when(long_, F.col("_hit.lon"))).drop("_hit")


def tag_scan(elements: DataFrame, cities: DataFrame, wanted: Column, metres: Column, most_km: float, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """Map elements that have the wanted tags and lie within the radius of a city: a filter, then a grid join.

    ``metres``: the radius, from columns of ``cities`` (city_lat, city_lon); no city's radius is over ``most_km``.
    """
    near = locate.radius_join(elements.filter(wanted), cities.withColumn("_reach", metres / 1000), most_km, (lat, lon))
    return near.filter(F.col("km") <= F.col("_reach")).drop("_reach")


def coffee_tags(tags: Column, keys: Sequence[str]) -> Column:
    """Whether an element is a cafe, a coffee shop, or has one of the tags."""
    any_key = F.lit(False)
    for k in keys:
        any_key = any_key | F.map_contains_key(tags, k)
    return (tag(tags, "amenity") == "cafe") | (tag(tags, "shop") == "coffee") | F.coalesce(any_key, F.lit(False))


def prefer(df: DataFrame, key: str, preferred: Column, order: str = "ord") -> DataFrame:
    """Of each key's rows the first preferred one, else the first."""
    w = Window.partitionBy(key).orderBy(F.desc(F.coalesce(preferred, F.lit(False))), order)
    return df.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def latest_request(answers: DataFrame, key: str, request: str = "request_id") -> DataFrame:
    """Answers of the latest request of each key; those of earlier ones are late and go."""
    last = answers.groupBy(key).agg(F.max(request).alias("_last"))
    return answers.join(last, key).filter(F.col(request) == F.col("_last")).drop("_last")


def within(df: DataFrame, km: Column, lat: str = "lat", lon: str = "lon", center: tuple[str, str] = ("city_lat", "city_lon")) -> DataFrame:
    """Rows no further than ``km`` from their centre."""
    return df.filter(haversine_km(F.col(center[0]), F.col(center[1]), F.col(lat), F.col(lon)) <= km)
