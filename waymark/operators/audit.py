"""Facets, audits and fallbacks over places."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import bound, chain_key, once

#: Order in which facets are shown.
SOURCE_ORDER = ["google", "seeded", "manual", "osm"]


def source_key(source: Column) -> Column:
    raw = F.lower(F.trim(F.coalesce(source, F.lit(""))))
    return F.when(raw.isin("osm", "overpass"), "osm").when(raw == "", "other").otherwise(raw)


#: How sources are called.
SOURCE_LABELS = {"google": "Google Lists", "seeded": "Curated seeds", "manual": "Manual entries", "osm": "OpenStreetMap"}


def source_label(source: Column) -> Column:
    key = source_key(source)
    out = F.lit("Other")
    for name, label in SOURCE_LABELS.items():
        out = F.when(key == name, label).otherwise(out)
    return out


def source_facets(places: DataFrame, source: str = "source") -> DataFrame:
    counts = places.groupBy(source_key(F.col(source)).alias("source_key")).agg(F.count(F.lit(1)).alias("n"))
    place = F.array_position(F.array(*[F.lit(s) for s in SOURCE_ORDER]), F.col("source_key"))
    return counts.withColumn("place", F.when(place == 0, len(SOURCE_ORDER) + 1).otherwise(place).cast("long"))


def chains(places: DataFrame, name: str = "name", city: str = "city", least_count: int = 3, least_cities: int = 2) -> DataFrame:
    """Names that repeat over cities: name without accents and signs, its longest form, count and sorted cities.

    Of forms of equal length the first by ord stays.
    """
    best = F.max_by(F.col(name), F.struct(F.length(F.col(name)), -F.col("ord")))
    out = places.filter(F.trim(F.col(name)) != "").groupBy(chain_key(F.col(name)).alias("normalized")).agg(best.alias("name"), F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_set(city)).alias("cities"))
    return out.filter((F.col("n") >= least_count) & (F.size("cities") >= least_cities))


def chain_members(places: DataFrame, names: DataFrame, id_: str = "id", name: str = "name") -> DataFrame:
    """(normalized, id) of the places that ``chains`` counted, one row each."""
    return places.select(chain_key(F.col(name)).alias("normalized"), F.col(id_).alias("id")).join(names.select("normalized"), "normalized", "left_semi")


def areas(places: DataFrame, area: Column, city: str = "city") -> DataFrame:
    """The areas that occur in each city."""
    return places.select(F.col(city).alias("city"), area.alias("area")).filter("area is not null").distinct()


def missing_by_city(places: DataFrame, address: str = "address", city: str = "city", top: int = 15) -> DataFrame:
    """The cities with the most places without an address."""
    counts = places.filter(missing_address(F.col(address))).groupBy(F.col(city).alias("city")).agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.desc("n"), "city").limit(top)


def found_by_city(places: DataFrame, city: str = "city", source: str = "source") -> DataFrame:
    """How many places of each city were found, and whether any is from lists."""
    return places.groupBy(F.col(city).alias("city")).agg(F.count(F.lit(1)).alias("n"), (F.count_if(F.col(source) == "google") > 0).alias("listed"))


def list_sizes(rows: DataFrame, key: str, order: str, text: str) -> DataFrame:
    """How many rows each list has, and the text of its first one."""
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.min_by(text, order).alias("first_text"))


def to_geocode(places: DataFrame, limit: int, city: str = "city", order: str = "ord") -> DataFrame:
    """Of each city the first ``limit`` places that lack a coordinate or are marked to be looked up again (needs_coords)."""
    lacks = F.col("lat").isNull() | F.col("lon").isNull() | F.isnan("lat") | F.isnan("lon") | F.coalesce(F.col("needs_coords"), F.lit(False))
    return places.filter(lacks).withColumn("turn", F.row_number().over(Window.partitionBy(city).orderBy(order))).filter(F.col("turn") <= limit)


def keyword_groups(places: DataFrame, keyword: Column, name: str = "name", city: str = "city") -> DataFrame:
    return places.withColumn("keyword", keyword).filter("keyword is not null").groupBy(F.col(name).alias("name"), "keyword").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_set(city)).alias("cities"))


def fallback(parts: list[DataFrame], filtered: bool) -> DataFrame:
    """The rows of the first part that has any, with its number as stage; with active filters only the first part counts.

    Whether a part has rows is asked for one after the other, each time up to the first row.
    """
    stage = 0
    while not filtered and stage < len(parts) - 1 and parts[stage].isEmpty():
        stage += 1
    return parts[stage].withColumn("stage", F.lit(stage))


def fallback_by(parts: list[DataFrame], key: str, filtered: bool = False) -> DataFrame:
    """For each key the rows of the first part that has any, with its number as stage, in one plan without an action.

    With active filters only the first part counts.  A null key is a key like others.
    """
    own = [p.withColumn("stage", F.lit(i)) for i, p in enumerate(parts)]
    if filtered:
        return own[0]
    whole = own[0]
    for p in own[1:]:
        whole = whole.unionByName(p, allowMissingColumns=True)
    light = own[0].select(key, "stage")
    for p in own[1:]:
        light = light.unionByName(p.select(key, "stage"))
    first = light.groupBy(F.col(key).alias("_fallback_key")).agg(F.min("stage").alias("_fallback_stage"))
    return whole.join(first, F.col(key).eqNullSafe(F.col("_fallback_key")) & (F.col("stage") == F.col("_fallback_stage"))).drop("_fallback_key", "_fallback_stage")


def missing_address(address: Column) -> Column:
    return F.trim(F.coalesce(address, F.lit(""))) == ""


def excluded_rows(places: DataFrame, decision: Column, score: Column, least: float, limit: int = 40) -> DataFrame:
    """Rows that the rules or the least score turn away, with the reason, the first ``limit`` by ord."""
    reason = bound(decision, lambda d: F.when(~d["included"], d["reason"]).when(score < least, F.lit("score below minimum")))
    return once(places, reason=reason).filter("reason is not null").orderBy("ord").limit(limit)
