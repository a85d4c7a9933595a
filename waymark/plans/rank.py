"""Ranking the places of all cities in one plan: score, locate, decide, overlay, deduplicate, order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import curation, decisions, geo, scoring
from ..functions import vocab as v
from ..functions.text import joined
from ..operators import audit, dedupe, locate, state
from ..operators.graph import materialised
from . import adapters


def scored(places: DataFrame, weights: str = "balanced") -> DataFrame:
    return scoring.add_score(places, weights=weights)


def text_of(df: DataFrame) -> Column:
    return joined(F.col("name"), F.col("address"), F.col("description"))


def filters(
    df: DataFrame, text: str | None = None, source: str | None = None, area: str | None = None, open_at: tuple[int, int] | None = None, least: float | None = None, words: Column | None = None, european: list[str] = v.EUROPEAN_COUNTRIES
) -> DataFrame:
    """The interactive filters: rows tied to another city and rows that a word of the city excludes always go.

    Open now does not apply to rows from lists, nor the least score to rated rows.  ``words``: the
    excluding words of a row's city (those that hold everywhere, if none are given).
    """
    said = text_of(df)
    df = df.filter(~decisions.city_locked_out(said, F.col("city")))
    if text and text.strip():
        df = df.filter(F.contains(said, F.lit(text.strip().lower())))
    words = words if words is not None else F.array(*[F.lit(w) for w in v.EXCLUDED_WORDS])
    df = df.filter(curation.exclusion_word(said, words, curation.is_european(F.col("country"), european)).isNull())
    if area:
        df = df.filter(F.col("area") == area)
    if source:
        df = df.filter(audit.source_key(F.col("source")) == source)
    if open_at:
        df = df.filter((F.col("source") == "google") | F.coalesce(decisions.is_open(F.col("opening_hours"), *map(F.lit, open_at)), F.lit(False)))
    if least is not None:
        df = df.filter((F.col("score") >= least) | (F.coalesce(F.col("rating"), F.lit(0)) > 0))
    return df


def live_order(places: DataFrame, open_: Column, top: int | None = None, city: str = "city", order: str = "ord") -> DataFrame:
    """Places of each city numbered (place): open ones, those of which it is not known, closed ones."""
    by = Window.partitionBy(city).orderBy(F.when(open_.isNull(), 1).when(open_, 0).otherwise(2), order)
    df = places.withColumn("place", F.row_number().over(by))
    return df.filter(F.col("place") <= top) if top else df


def rank_places(places: DataFrame, cities: DataFrame, ratings: DataFrame, mode: str = "coffeeAndBakery", radius_km: float = 3.5, top: int = 20, weights: str = "balanced") -> DataFrame:
    """The ``top`` places of each city: in scope and radius, listed, scored, boosted by rating, without duplicates."""
    df = scored(places, weights)
    df = df.filter(geo.haversine_km(F.col("city_lat"), F.col("city_lon"), F.col("lat"), F.col("lon")) <= radius_km)
    df = locate.nearest(df, cities, F.col("lat"), F.col("lon")).filter(F.col("nearest_city") == F.col("city"))
    decision = decisions.list_decision(text_of(df), F.array().cast("array<string>"), F.lit(None).cast("string"), mode)
    df = df.withColumn("_d", decision).filter("_d.included").withColumn("decision", F.col("_d.reason")).drop("_d")
    df = df.join(ratings.withColumnRenamed("place_id", "_rid"), F.col("id") == F.col("_rid"), "left").drop("_rid")
    df = df.withColumn("_b", scoring.boosted(F.col("score"), F.col("place_type"), F.col("rating"), F.col("tags")))
    df = df.withColumn("score", F.col("_b.score")).withColumn("place_type", F.col("_b.place_type")).drop("_b")
    df = df.withColumn("quality", scoring.quality(F.col("address"), F.col("source"), F.col("score")).cast("double"))
    df = dedupe.greedy_near(materialised(df))  # scored once, and read twice
    w = Window.partitionBy("city").orderBy(F.desc("score"), "ord")
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top)


def rank_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = rank_places(adapters.places(spark, sf_dir), adapters.cities(spark, sf_dir), adapters.ratings(spark, sf_dir))
    return out.select("city", "rank", "id", "name", "score", "place_type", "decision", F.coalesce("rating", F.lit(0)).alias("rating"))


def overlay(places: DataFrame, overrides: DataFrame) -> DataFrame:
    """Field and score overrides applied; rows deleted by an override go."""
    df = overlay_fields(places, overrides)
    return df.withColumn("score", state.override_score(F.col("patch"), F.col("score"))) if "score" in df.columns else df


def overlay_fields(places: DataFrame, overrides: DataFrame) -> DataFrame:
    """Field overrides applied, the patch kept for those of computed fields; rows deleted by an override go."""
    df = state.with_override(places, overrides).filter("not deleted")
    for c in ("name", "address", "notes"):
        if c in df.columns:
            df = df.withColumn(c, state.patched(F.col("patch"), c, F.col(c)))
    for c in ("lat", "lon"):
        df = df.withColumn(c, state.patched(F.col("patch"), c, F.col(c), number=True))
    return df
