"""Distances and coordinates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    half = lambda a, b: F.pow(F.sin((b - a) * (3.141592653589793 / 180) / 2), 2)
    a = half(lat1, lat2) + F.cos(lat1 * (3.141592653589793 / 180)) * F.cos(lat2 * (3.141592653589793 / 180)) * half(lon1, lon2)
    return 2 * EARTH_KM * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def oriented(lat: Column, lon: Column, city_lat: Column, city_lon: Column) -> Column:
    """struct(lat, lon, swapped): the pair, or the pair swapped where that is valid and more than 0.2 km
    nearer to the city, or the only valid way; null where neither is valid."""
    direct, swapped = (F.abs(lat) <= 90) & (F.abs(lon) <= 180), (F.abs(lon) <= 90) & (F.abs(lat) <= 180)
    nearer = haversine_km(city_lat, city_lon, lon, lat) + 0.2 < haversine_km(city_lat, city_lon, lat, lon)
    as_is = F.struct(lat.alias("lat"), lon.alias("lon"), F.lit(False).alias("swapped"))
    turned = F.struct(lon.alias("lat"), lat.alias("lon"), F.lit(True).alias("swapped"))
    return F.when(direct & swapped & F.coalesce(nearer, F.lit(False)), turned).when(direct, as_is).when(swapped, turned)


def best_coordinates(lats: list[Column], lons: list[Column], city_lat: Column, city_lon: Column) -> Column:
    """The best of all pairs of candidate fields: least distance to the city plus 0.001 a place in the lists.

    Places count after missing candidates are removed; the first of equals wins.
    """
    la, lo = (F.filter(F.array(*x), lambda v: v.isNotNull()) for x in (lats, lons))

    def pair(a: Column, i: Column) -> Column:
        def one(o: Column, j: Column) -> Column:
            p = oriented(a, o, city_lat, city_lon)
            d = F.coalesce(haversine_km(city_lat, city_lon, p["lat"], p["lon"]), F.lit(0.0))
            return F.when(p.isNotNull(), F.struct((d + (i + j) * 0.001).alias("score"), i.alias("i"), j.alias("j"), p["lat"].alias("lat"), p["lon"].alias("lon"), p["swapped"].alias("swapped")))

        return F.transform(lo, one)

    return F.array_min(F.filter(F.flatten(F.transform(la, pair)), lambda x: x.isNotNull()))


def cell(lat: Column, lon: Column, km: float) -> tuple[Column, Column]:
    """Grid row, and column at the row's latitude, of cells of at least ``km`` in both directions.

    A column is as wide as ``km`` asks for at the far edge of the row next to it.
    """
    step = km / 111.0
    row = F.floor(lat / step)
    return row, F.floor(lon / column_width(row, km))


def column_width(row: Column, km: float) -> Column:
    step = km / 111.0
    far = F.least(F.greatest(F.abs(row * step), F.abs((row + 1) * step)), F.lit(89.0))
    return F.lit(step) / F.cos(far * (3.141592653589793 / 180))


def offshore(lat: Column, lon: Column) -> Column:
    """West of the coast line estimated for Tel Aviv."""
    return lon < (F.lit(34.742) + (lat - 32.02) * 0.35) - 0.0015
