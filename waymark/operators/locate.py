"""Joins by distance and by mention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import cell, column_width, haversine_km
from ..functions.text import ascii_word, once
from .graph import materialised

#: Up to so many cities go to each occupied cell as one array; more are found through the grid.
MOST_CITIES = 2000
#: No point of a cell of one degree is further from its middle, in km.
CELL_REACH = 79.0


def reached(df: DataFrame, km: float, at: tuple[str, str] = ("lat", "lon")) -> DataFrame:
    """Each row once for every cell (_row, _col) that may hold a partner within ``km``, also across the date line."""
    step = km / 111.0
    rows = F.transform(F.array(*[F.lit(i) for i in (-1, 0, 1)]), lambda i: F.floor(F.col(at[0]) / step) + i)
    b = df.withColumn("_row", F.explode(rows)).withColumn("_lon", F.explode(F.array(*[F.col(at[1]) + x for x in (-360.0, 0.0, 360.0)])))
    width = column_width(F.col("_row"), km)
    b = b.filter(F.col("_lon").between(F.lit(-180.0) - 2 * width, F.lit(180.0) + 2 * width))
    middle = F.floor(F.col("_lon") / width)
    return b.withColumn("_col", F.explode(F.sequence(middle - 2, middle + 2))).drop("_lon")


def radius_join(left: DataFrame, right: DataFrame, km: float, left_at: tuple[str, str] = ("lat", "lon"), right_at: tuple[str, str] = ("city_lat", "city_lon"), same: tuple[tuple[str, str], ...] = ()) -> DataFrame:
    """Pairs within ``km``, with their distance as ``km``: an equi-join on grid cells, then the exact test.

    The right side's rows go to every cell that may hold a partner, also across the date line.  ``same``:
    pairs of columns that have to be equal, which take part in the equi-join.
    """
    row, col = cell(F.col(left_at[0]), F.col(left_at[1]), km)
    a = left.withColumn("_row", row).withColumn("_col", col)
    b = reached(right, km, right_at)
    d = haversine_km(F.col(left_at[0]), F.col(left_at[1]), F.col(right_at[0]), F.col(right_at[1]))
    b = b.withColumnsRenamed({"_row": "_row2", "_col": "_col2"})
    on = (F.col("_row") == F.col("_row2")) & (F.col("_col") == F.col("_col2"))
    for x, y in same:
        on = on & (F.col(x) == F.col(y))
    return a.join(b, on).withColumn("km", d).filter(F.col("km") <= km).drop("_row", "_col", "_row2", "_col2")


def nearest(df: DataFrame, cities: DataFrame, lat: Column, lon: Column, name: str = "city", order: str = "city_key") -> DataFrame:
    """Add nearest_city and nearest_km; of equal distances the first city by ``order`` wins.

    Each cell of one degree that has rows gets the cities that can be nearest to a point in it: those no
    further from its middle than the nearest one and twice the cell's reach.  A row then looks at the few
    cities of its cell.  There are at most 64,800 cells; their table is written, so that the planner knows
    its size and broadcasts it only if that is small.
    """
    if cities.limit(MOST_CITIES + 1).count() > MOST_CITIES:
        return _nearest_by_grid(df, cities, lat, lon, name, order)
    one = cities.agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(name).alias("n"), F.col("city_lat").alias("la"), F.col("city_lon").alias("lo")))).alias("_cities"))
    row, col = F.floor(lat), F.floor(lon)
    cells = df.select(row.alias("_r"), col.alias("_c")).distinct().filter("_r is not null and _c is not null").join(F.broadcast(one))  # one row of at most MOST_CITIES
    far = F.transform("_cities", lambda c: haversine_km(F.col("_r") + 0.5, F.col("_c") + 0.5, c["la"], c["lo"]))
    cells = cells.withColumn("_far", far).withColumn("_most", F.array_min("_far") + 2 * CELL_REACH)
    near = materialised(cells.select("_r", "_c", F.filter("_cities", lambda c, i: F.get("_far", i) <= F.col("_most")).alias("_near")))
    best = F.array_min(F.transform("_near", lambda c: F.struct(haversine_km(lat, lon, c["la"], c["lo"]).alias("d"), c["o"].alias("o"), c["n"].alias("n"))))
    out = once(df.join(near, (row == F.col("_r")) & (col == F.col("_c")), "left"), _best=best)  # a filter on the city would measure all distances again
    return out.withColumn("nearest_city", F.col("_best.n")).withColumn("nearest_km", F.col("_best.d")).drop("_best", "_r", "_c", "_near")


def _nearest_by_grid(df: DataFrame, cities: DataFrame, lat: Column, lon: Column, name: str, order: str) -> DataFrame:
    """The same through the grid, with wider cells for the rows that found no city in the narrower."""
    keyed = df.withColumn("_lat", lat).withColumn("_lon", lon).withColumn("_id", F.xxhash64("_lat", "_lon"))
    right, found = cities.select(F.col(order).alias("_o"), F.col(name).alias("_n"), "city_lat", "city_lon"), None
    points = materialised(keyed.select("_id", "_lat", "_lon").filter("_lat is not null and _lon is not null").dropDuplicates(["_id"]))  # rows of one point ask once
    open_ = points
    for km in (50.0, 400.0, 3200.0, 20100.0):
        pairs = radius_join(open_, right, km, ("_lat", "_lon"))
        best = pairs.groupBy("_id").agg(F.min(F.struct("km", "_o", "_n")).alias("_best"))
        found = best if found is None else found.unionByName(best)
        open_ = open_.join(best, "_id", "left_anti")
    out = keyed.join(found, "_id", "left")
    return out.withColumn("nearest_city", F.col("_best._n")).withColumn("nearest_km", F.col("_best.km")).drop("_id", "_lat", "_lon", "_best")


def area(df: DataFrame, areas: DataFrame, text: Column, city: str = "city_key") -> DataFrame:
    """Add ``area``: the first of the city's areas (by ord) one of whose variants stands in the text as a word.

    ``areas``: city_key, ord, canonical, variants (array); one row an area, gathered to one array a city.
    """
    lists = areas.groupBy(F.col("city_key").alias("_city")).agg(F.array_sort(F.collect_list(F.struct("ord", "canonical", "variants"))).alias("_areas"))
    edge = "(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"
    hit = lambda a: F.exists(a["variants"], lambda v: (F.trim(v) != "") & F.regexp_like(F.lower(text), F.concat(F.lit(edge + "\\Q"), F.lower(F.trim(v)), F.lit("\\E" + edge))))
    out = df.join(lists, F.col(city).eqNullSafe(F.col("_city")), "left")
    return out.withColumn("area", F.try_element_at(F.filter("_areas", hit), F.lit(1))["canonical"]).drop("_city", "_areas")


def in_scope(mentioned: Column, nearest_city: Column, city: Column, group: Column) -> Column:
    """Whether a place is the city's: by mention first, else by the nearest centre, else yes."""
    own = lambda c: (c == city) | F.array_contains(group, c)
    return F.when(mentioned.isNotNull(), own(mentioned)).when(nearest_city.isNotNull(), own(nearest_city)).otherwise(F.lit(True))


__all__ = ["area", "ascii_word", "in_scope", "nearest", "radius_join"]
