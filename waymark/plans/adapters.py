"""Places, cities and user state made from the given tables, the same in Spark and in DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import once

SUFFIXES = ["", " Coffee Roasters", " Espresso Bar", " Bakery", " Specialty Coffee", " Cafe", " Kitchen", " Roastery", " Starbucks", " Aroma", " Bubble Tea", " V60 House"]
HOURS = ["", "24/7", "Mo-Fr 08:00-18:00", "08:00-20:00", "Mo,We 08:00-18:00", "22:00-02:00", "Fr-Su 10:00-16:00; Mo off", "Sa 09:00-12:30"]


def _case(key: str, words: list[str]) -> str:
    return f"CASE {key} " + " ".join(f"WHEN {i} THEN '{w}'" for i, w in enumerate(words)) + " END"


#: Columns of a place by their SQL, which both engines read alike; tags are the columns that begin with tag_.
PLACE_COLUMNS = {
    "ord": "p_partkey",
    "id": "'part-' || CAST(p_partkey AS VARCHAR(20))",
    "name": f"p_name || {_case('p_partkey % 12', SUFFIXES)}",
    "city_key": "CAST(p_partkey % 25 AS INT)",
    "address": "CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE CAST(p_partkey % 50 AS VARCHAR(20)) || ' ' || p_brand || ' St' END",
    "description": "lower(p_type)",
    "source": "CASE p_partkey % 5 WHEN 0 THEN 'google' WHEN 1 THEN 'seeded' WHEN 2 THEN 'overpass' WHEN 3 THEN 'manual' ELSE ' ' END",
    "dlat": "CAST((p_partkey * 7919) % 1000 - 500 AS DOUBLE) / 10000",
    "dlon": "CAST((p_partkey * 6841) % 1000 - 500 AS DOUBLE) / 10000",
    "opening_hours": _case("p_partkey % 8", HOURS),
    "url": "'https://WWW.site' || CAST(p_partkey % 40 AS VARCHAR(20)) || '.example/p#' || CAST(p_partkey AS VARCHAR(20))",
    "tag_amenity": "CASE p_partkey % 5 WHEN 0 THEN 'cafe' WHEN 1 THEN 'Cafe' WHEN 2 THEN 'pharmacy' WHEN 3 THEN NULL ELSE 'bakery' END",
    "tag_cuisine": "CASE p_partkey % 6 WHEN 0 THEN 'coffee_shop' WHEN 1 THEN 'Pizza' END",
    "tag_shop": "CASE WHEN p_partkey % 9 = 0 THEN 'coffee' END",
    "tag_brand": "CASE WHEN p_partkey % 31 = 0 THEN 'Illy' WHEN p_partkey % 2 = 0 THEN p_brand END",
    "tag_website": "CASE WHEN p_partkey % 4 = 0 THEN 'https://w.example' END",
    "tag_phone": "CASE WHEN p_partkey % 3 = 1 THEN '1' END",
    "tag_email": "CASE WHEN p_partkey % 7 = 1 THEN 'x' WHEN p_partkey % 7 = 2 THEN '' END",
    "tag_opening_hours": f"nullif({_case('p_partkey % 8', HOURS)}, '')",
    "tag_internet_access": "CASE p_partkey % 4 WHEN 1 THEN 'wlan' WHEN 2 THEN 'yes' WHEN 3 THEN 'no' END",
    "tag_addr_street": "CASE WHEN p_partkey % 2 = 1 THEN 's' END",
    "tag_addr_city": "CASE WHEN p_partkey % 3 = 0 THEN 'c' END",
    "tag_specialty_coffee": "CASE p_partkey % 10 WHEN 0 THEN 'yes' WHEN 1 THEN 'no' END",
    "tag_espresso_bar": "CASE WHEN p_partkey % 20 = 0 THEN 'yes' END",
    "tag_v60": "CASE WHEN p_partkey % 7 = 2 THEN 'yes' END",
    "tag_cold_brew": "CASE WHEN p_partkey % 14 = 2 THEN 'yes' END",
    "tag_roastery": "CASE WHEN p_partkey % 11 = 3 THEN 'yes' END",
    "tag_latte_art": "CASE WHEN p_partkey % 13 = 4 THEN 'only' END",
    "tag_quality_grinder": "CASE WHEN p_partkey % 17 = 5 THEN 'yes' END",
}
CITY_LAT, CITY_LON = "CAST(30 + (n_nationkey * 7) % 25 AS DOUBLE)", "CAST((n_nationkey * 11) % 40 - 10 AS DOUBLE)"

#: DuckDB: common table expressions cities, places, ratings and overrides.
CTE = f"""cities AS (SELECT CAST(n_nationkey AS INT) AS city_key, n_name AS city, {CITY_LAT} AS city_lat, {CITY_LON} AS city_lon, r_name AS country
  FROM nation JOIN region ON n_regionkey = r_regionkey),
places AS (SELECT p.*, c.city, c.city_lat, c.city_lon, c.country, c.city_lat + dlat AS lat, c.city_lon + dlon AS lon
  FROM (SELECT {', '.join(f'{sql} AS {name}' for name, sql in PLACE_COLUMNS.items())} FROM part) p JOIN cities c USING (city_key)),
ratings AS (SELECT 'part-' || CAST(user_id AS VARCHAR) AS place_id, max(CAST(1 + event_id % 5 AS INT)) AS rating FROM events GROUP BY 1)"""


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cities(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = read(spark, sf_dir, "nation").join(F.broadcast(read(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    return n.selectExpr("CAST(n_nationkey AS INT) AS city_key", "n_name AS city", f"{CITY_LAT} AS city_lat", f"{CITY_LON} AS city_lon", "r_name AS country")


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """The rows dealt by key to three tasks a core: a narrow table has few row groups, so as few tasks read it, whatever its rows cost later."""
    return df.repartition(max(24, 3 * df.sparkSession.sparkContext.defaultParallelism), *keys)


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places with their city's name and centre, and a map of tags.  The city table has 25 rows."""
    part = read(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type")
    flat = dealt(part, "p_partkey").selectExpr(*[f"{sql} AS {name}" for name, sql in PLACE_COLUMNS.items()])
    tags = [c for c in PLACE_COLUMNS if c.startswith("tag_")]
    key = lambda c: c[4:].replace("addr_", "addr:")
    entries = F.filter(F.array(*[F.struct(F.lit(key(c)).alias("k"), F.col(c).alias("v")) for c in tags]), lambda e: e["v"].isNotNull())
    out = once(flat, tags=F.map_from_entries(entries)).drop(*tags).join(F.broadcast(cities(spark, sf_dir)), "city_key")
    return out.withColumn("lat", F.col("city_lat") + F.col("dlat")).withColumn("lon", F.col("city_lon") + F.col("dlon"))


def ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best rating of each place id of the change log."""
    e = read(spark, sf_dir, "events")
    return e.groupBy(F.concat(F.lit("part-"), F.col("user_id").cast("string")).alias("place_id")).agg(F.max((1 + F.col("event_id") % 5).cast("int")).alias("rating"))
