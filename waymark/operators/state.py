"""User state over places: ratings, hidden ids, overrides, manual places, and how they merge."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import finite, id_part, parse_stable_id, squeeze
from . import matching

TOLERANCE = 0.0002


def keys_of(id_: Column, legacy: Column) -> Column:
    """The place's own id and then its legacy ids, without empties and repeats."""
    both = F.concat(F.array(id_), F.coalesce(legacy, F.array().cast("array<string>")))
    return F.array_distinct(F.filter(both, lambda k: k.isNotNull() & (k != "")))


def hide_keys(id_: Column, legacy: Column, city: Column, name: Column) -> Column:
    named = F.concat(F.lit("hidden-name-"), id_part(F.coalesce(F.nullif(city, F.lit("")), F.lit("global")), "global"), F.lit("-"), id_part(name, "unnamed"))
    return F.array_distinct(F.concat(keys_of(id_, legacy), F.array(named)))


def not_hidden(places: DataFrame, hidden: DataFrame, keys: Column, id_: str = "id") -> DataFrame:
    """Places none of whose keys is among the hidden ids (place_key)."""
    hit = places.select(F.col(id_).alias("_id"), F.explode(keys).alias("place_key")).join(hidden.select("place_key").distinct(), "place_key").select("_id").distinct()
    return places.join(hit, F.col(id_) == F.col("_id"), "left_anti")


def rating_cascade(places: DataFrame, ratings: DataFrame, id_: str = "id", legacy: str = "legacy", city: str = "city", name: str = "name") -> DataFrame:
    """Add ``rating``: the first positive one by id, by legacy ids in order, by name alias, and last by the
    ids of other records with the same name or within 0.0002 degrees, in the order of ``ratings.ord``.

    ``ratings``: place_id, rating, ord.  Each stage is an equi-join; near coordinates meet in grid cells.
    """
    good = ratings.filter("rating > 0").select("place_id", "rating", F.col("ord").alias("rord"))
    # normal forms are columns of their own, computed once and read where they are needed
    base = places.select(F.col(id_).alias("_id"), F.col(legacy).alias("_legacy"), id_part(F.col(city), "").alias("_city"), id_part(F.col(name), "").alias("name_key"), finite(F.col("lat")).alias("la"), finite(F.col("lon")).alias("lo"))
    alias = F.when((F.col("_city") != "") & (F.col("name_key") != ""), F.array(F.concat_ws("-", F.lit("seeded-name"), "_city", "name_key")))
    keys = F.concat(keys_of(F.col("_id"), F.col("_legacy")), F.coalesce(alias, F.array().cast("array<string>")))
    by_key = base.select("_id", F.posexplode(keys).alias("stage", "place_id")).join(good, "place_id").select("_id", "stage", F.lit(0).cast("long").alias("rord"), "rating")
    parsed = good.withColumn("p", parse_stable_id(F.col("place_id"))).filter("p is not null").select("rord", "rating", "p.name_key", F.col("p.lat").alias("rlat"), F.col("p.lon").alias("rlon"))
    # of the ratings of one name, or of one point, only the first counts: a place meets one row, however many there are
    first = lambda *key: parsed.groupBy(*key).agg(F.min("rord").alias("rord"), F.min_by("rating", "rord").alias("rating"))
    located = base.filter("la is not null and lo is not null")
    same = located.filter("name_key != ''").select("_id", "name_key").join(first("name_key"), "name_key").select("_id", "rord", "rating")
    step = 2 * TOLERANCE
    around = lambda x: F.transform(F.array(*[F.lit(i) for i in (-1, 0, 1)]), lambda i: F.floor(x / step) + i)
    a = located.select("_id", "la", "lo", F.floor(F.col("la") / step).alias("gx"), F.floor(F.col("lo") / step).alias("gy"))
    b = first("rlat", "rlon").withColumn("gx", F.explode(around(F.col("rlat")))).withColumn("gy", F.explode(around(F.col("rlon"))))
    near = a.join(b, ["gx", "gy"]).filter((F.abs(F.col("rlat") - F.col("la")) <= TOLERANCE) & (F.abs(F.col("rlon") - F.col("lo")) <= TOLERANCE)).select("_id", "rord", "rating")
    last = same.unionByName(near).select("_id", F.lit(1 << 30).alias("stage"), "rord", "rating")
    best = by_key.unionByName(last).groupBy("_id").agg(F.min_by("rating", F.struct("stage", "rord")).alias("_rating"))
    return places.join(best, F.col(id_) == F.col("_id"), "left").withColumn("rating", F.coalesce("_rating", F.lit(0))).drop("_id", "_rating")


def with_override(places: DataFrame, overrides: DataFrame, id_: str = "id", legacy: str = "legacy") -> DataFrame:
    """Add patch (map) and deleted of the first of the place's keys that has an override (id, patch, deleted)."""
    keys = places.select(F.col(id_).alias("_id"), F.posexplode(keys_of(F.col(id_), F.col(legacy))).alias("_at", "_key"))
    found = keys.join(overrides.select(F.col("id").alias("_key"), "patch", "deleted"), "_key")
    first = found.groupBy("_id").agg(F.min_by(F.struct("patch", "deleted"), "_at").alias("_o"))
    return places.join(first, F.col(id_) == F.col("_id"), "left").withColumn("patch", F.col("_o.patch")).withColumn("deleted", F.coalesce(F.col("_o.deleted"), F.lit(False))).drop("_id", "_o")


def patched(patch: Column, key: str, value: Column, number: bool = False) -> Column:
    """The override's value where the key is there (an empty text counts; a number has to be finite)."""
    new = F.try_element_at(patch, F.lit(key))
    if number:
        new = finite(new.try_cast("double"))
        return F.coalesce(new, value.cast("double"))
    return F.when(F.coalesce(F.map_contains_key(patch, key), F.lit(False)), new).otherwise(value)


def override_score(patch: Column, score: Column) -> Column:
    """The overriding score, kept between 0 and 100, else the place's own."""
    new = finite(F.try_element_at(patch, F.lit("specialtyScore")).try_cast("double"))
    return F.when(new.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(100.0), new))).otherwise(score)


def merge_ratings(a: DataFrame, b: DataFrame) -> DataFrame:
    """The greater rating of each place_id of either."""
    return a.select("place_id", "rating").unionByName(b.select("place_id", "rating")).groupBy("place_id").agg(F.max("rating").alias("rating"))


def merge_hidden(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("place_key").union(b.select("place_key")).distinct()


def hydrate(local: DataFrame, remote: DataFrame, first_migration: bool) -> DataFrame:
    """Remote state replaces local, but for a first migration with nothing remote."""
    return local if first_migration and remote.isEmpty() else remote


def coerce_manual(raw: DataFrame) -> DataFrame:
    """Valid manual places: id, name and finite coordinates; the first row of an id wins (by ord)."""
    ok = raw.withColumn("lat", finite(F.col("lat").try_cast("double"))).withColumn("lon", finite(F.col("lon").try_cast("double"))).filter("trim(coalesce(id, '')) != '' and trim(coalesce(name, '')) != '' and lat is not null and lon is not null")
    return ok.groupBy("id").agg(*[F.min_by(c, "ord").alias(c) for c in raw.columns if c != "id"])


_TEXTS, _NUMBERS = ("name", "address", "notes", "cityName", "source"), ("lat", "lon", "specialtyScore", "updatedAt")


def coerce_overrides(raw: DataFrame) -> DataFrame:
    """(id, patch, deleted) out of a user's overrides (id, entry: a JSON object).

    Ids are trimmed, and those that are blank go.  Texts that are there are trimmed, null and false read as empty;
    numbers count if they are finite (scores from 0 to 100), and only a true ``deleted`` deletes.  Entries that are
    no objects, and those of which nothing is left, go.
    """
    values, kinds = F.from_json("entry", "map<string,string>"), F.from_json("entry", "map<string,variant>")
    rows = raw.select(F.trim(F.coalesce("id", F.lit(""))).alias("id"), F.when(F.ltrim("entry").startswith("{"), values).alias("v"), F.transform_values(kinds, lambda _, x: F.schema_of_variant(x)).alias("k"))
    rows = rows.filter("id != '' and v is not null")
    value, kind = (lambda n: F.try_element_at("v", F.lit(n))), (lambda n: F.try_element_at("k", F.lit(n)))

    def text(n: str) -> Column:
        empty = value(n).isNull() | ((kind(n) == "BOOLEAN") & (value(n) == "false")) | (kind(n).startswith("DECIMAL") | (kind(n) == "BIGINT")) & (value(n).try_cast("double") == 0)
        return F.when(F.map_contains_key("v", n), F.when(empty, F.lit("")).otherwise(F.trim(value(n))))

    def number(n: str) -> Column:
        x = F.when(kind(n) == "BOOLEAN", (value(n) == "true").cast("double")).when(F.trim(F.coalesce(value(n), F.lit(""))) == "", F.lit(0.0)).otherwise(finite(F.trim(value(n)).try_cast("double")))
        x = F.when(F.map_contains_key("v", n) & ~F.coalesce(kind(n).startswith("OBJECT") | kind(n).startswith("ARRAY"), F.lit(False)), x)
        return F.when(x.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(100.0), x))) if n == "specialtyScore" else x

    fields = [F.struct(F.lit(n).alias("key"), text(n).alias("value")) for n in _TEXTS] + [F.struct(F.lit(n).alias("key"), number(n).cast("string").alias("value")) for n in _NUMBERS]
    patch = F.map_from_entries(F.filter(F.array(*fields), lambda e: e["value"].isNotNull()))
    deleted = F.coalesce((kind("deleted") == "BOOLEAN") & (value("deleted") == "true"), F.lit(False))
    return rows.select("id", patch.alias("patch"), deleted.alias("deleted")).filter((F.size("patch") > 0) | F.col("deleted"))


def post_hidden(existing: DataFrame, posts: DataFrame, user: str = "user_id") -> DataFrame:
    """Hidden ids (user, place_key) after each user's post (user, ids): they are added, an empty list clears, no list changes nothing.

    A user posts once.  Blank ids go, and so do repeats.
    """
    cleared = posts.filter(F.size("ids") == 0).select(F.col(user).alias("_user"))
    kept = existing.select(user, "place_key").join(cleared, F.col(user).eqNullSafe(F.col("_user")), "left_anti")
    new = posts.select(user, F.explode("ids").alias("place_key")).filter("place_key != ''")
    return kept.unionByName(new).distinct()


def upsert(table: DataFrame, rows: DataFrame, key: str = "id") -> DataFrame:
    """The table with the rows of the same key replaced and new ones added."""
    return table.join(rows.select(key), key, "left_anti").unionByName(rows, allowMissingColumns=True)


def remove(table: DataFrame, keys: DataFrame, key: str = "id") -> DataFrame:
    return table.join(keys.select(key), key, "left_anti")


def toggle_rating(old: Column, clicked: Column) -> Column:
    """The same star again takes the rating back."""
    return F.when(old == clicked, 0).otherwise(clicked)


def spread_by_name(ratings: DataFrame, places: DataFrame) -> DataFrame:
    """Ratings for all places with the same squeezed name as a rated place; the greatest where they differ."""
    named = places.select("id", squeeze(F.col("name")).alias("n"))
    rated = named.join(ratings, F.col("id") == F.col("place_id")).groupBy("n").agg(F.max("rating").alias("rating"))
    return named.join(rated, "n").select(F.col("id").alias("place_id"), "rating")


def recover_indexed(ratings: DataFrame, places: DataFrame) -> DataFrame:
    """Ratings under seeded-<city>-<index> moved to the id of the city's place at that position (pos).

    The city is the one of that name, else the first by name whose name holds the other or is held by it.
    """
    parts = F.regexp_extract(F.col("place_id"), r"^seeded-(.+)-(\d+)$", 1)
    old = ratings.withColumn("c", id_part(parts, "")).withColumn("pos", F.regexp_extract("place_id", r"^seeded-(.+)-(\d+)$", 2).try_cast("int")).filter("c != '' and pos is not null")
    known = places.select(id_part(F.col("city"), "").alias("known")).distinct()
    of = matching.contained(old.select("c").distinct(), known.withColumn("by", F.col("known")), "c", "known", "by").select("c", F.col("match.known").alias("known"))
    return old.join(of, "c").join(places.select(id_part(F.col("city"), "").alias("known"), "pos", "id"), ["known", "pos"]).groupBy(F.col("id").alias("place_id")).agg(F.max("rating").alias("rating"))
