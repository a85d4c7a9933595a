"""The places of every city as a user sees them: listed and curated places with the user's state, in one plan."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import curation, decisions, geo, scoring
from ..functions.text import once
from ..operators import audit, combine, dedupe, locate, state
from ..operators.graph import materialised
from . import adapters, rank

#: Names of the scans that a city falls back to, in order.
STAGES = ("filtered", "displayed", "listed", "wide")
#: How many times its radius the last scan of a city reaches.
WIDER = 2.0
_SEEDED_FIRST = 1 << 40


@dataclass
class View:
    """What a user has chosen: the lists' mode, weights, time of the week, least score and interactive filters."""

    mode: str = "coffeeAndBakery"
    weights: str = "balanced"
    day: int = 1
    minute: int = 600
    least: float = 0.0
    filters: dict[str, Any] = field(default_factory=dict)

    @property
    def narrowed(self) -> bool:
        """Whether a filter is on: then an empty city is empty on purpose."""
        return bool(self.least > 0 or self.filters)


def scored(listed: DataFrame, seeded: DataFrame, cities: DataFrame, ratings: DataFrame, overrides: DataFrame, view: View) -> DataFrame:
    """Both sources with overrides, scores, floors, ratings and boosts, of each city's scope, and where each row may be shown.

    ``shown``: the scans (listed, seeded, wide) that have the row.  Scores, the nearest city and the decision are
    made once for all that follows.
    """
    none = F.lit(None).cast("boolean")
    both = listed.withColumn("part", F.lit("listed")).withColumn("is_specialty", none).unionByName(seeded.withColumn("part", F.lit("seeded")), allowMissingColumns=True)
    df = locate.nearest(rank.overlay_fields(both, overrides), cities, F.col("lat"), F.col("lon"))
    offshore = F.when(F.col("city") == "Tel Aviv", geo.offshore(F.col("lat"), F.col("lon"))).otherwise(F.lit(False))
    scope = locate.in_scope(F.lit(None).cast("string"), F.col("nearest_city"), F.col("city"), F.array().cast("array<string>"))
    df = rank.scored(df.filter(scope & ~F.coalesce(offshore, F.lit(False))), view.weights)  # after the nearest city, which reads its rows twice
    floor = curation.seeded_floor(F.col("score"), F.col("place_type"), F.col("reasons"), F.col("is_specialty"))
    df = once(df, _f=floor).withColumns({c: F.col(f"_f.{c}") for c in ("score", "place_type", "reasons")}).drop("_f")
    df = materialised(df.withColumn("score", state.override_score(F.col("patch"), F.col("score"))).drop("patch", "deleted"))
    df = state.rating_cascade(df, ratings)
    boost = scoring.boosted(F.col("score"), F.col("place_type"), F.col("rating"), F.col("tags"))
    decision = decisions.list_decision(rank.text_of(df), F.array().cast("array<string>"), F.lit(None).cast("string"), view.mode)
    km = geo.haversine_km(F.col("city_lat"), F.col("city_lon"), F.col("lat"), F.col("lon"))
    df = once(df, _b=boost, _d=decision, _km=km).withColumns({"score": F.col("_b.score"), "place_type": F.col("_b.place_type")})
    decision, km, reach = F.col("_d"), F.col("_km"), curation.radius_km(F.col("city"))
    is_listed = F.col("part") == "listed"
    enough = (F.col("score") >= view.least) | (F.col("rating") > 0)  # the first pass spares rated places
    shown = [F.when(~is_listed, "seeded"), F.when(is_listed & decision["included"] & (km <= reach) & enough, "listed"), F.when(is_listed & (km <= reach * WIDER), "wide")]
    df = once(df, shown=F.array_compact(F.array(*shown))).withColumn("decision", decision["reason"]).drop("_b", "_d", "_km")
    return df.withColumn("quality", scoring.quality(F.col("address"), F.col("source"), F.col("score")).cast("double"))


def displayed(rows: DataFrame, hidden: DataFrame) -> DataFrame:
    """Of each city the curated places whose names the listed ones do not have, then those, without hidden ones and duplicates."""
    base = state.not_hidden(rows.filter("scan = 'listed'"), hidden, state.hide_keys(F.col("id"), F.col("legacy"), F.col("city"), F.col("name")), "key")
    both = combine.with_new(base, rows.filter("scan = 'seeded'")).drop("stage")
    return dedupe.greedy_near(materialised(both.withColumn("ord", F.col("ord") + F.when(F.col("scan") == "listed", _SEEDED_FIRST).otherwise(0))), id_="key")


def see(listed: DataFrame, seeded: DataFrame, cities: DataFrame, ratings: DataFrame, overrides: DataFrame, hidden: DataFrame, view: View | None = None, top: int | None = None) -> DataFrame:
    """Each city's places in the order in which they are shown (rank), with the scan that they came from (stage).

    ``listed``: id, ord, name, address, description, source, city, city_key, city_lat, city_lon, country, lat, lon,
    tags, opening_hours and legacy ids; ``seeded``: the same and is_specialty.  Ids are unique in each of the two.
    A city whose places the filters leave none of falls back to all that is displayed, to its listed places, and
    to those within twice its radius; with filters on it stays empty.  Open places come first, then those of
    which it is not known, then closed ones; curated before listed ones, by score, in the order of the input.
    """
    view = view or View()
    rows = materialised(scored(listed, seeded, cities, ratings, overrides, view).withColumn("scan", F.explode("shown")).drop("shown"))
    rows = rows.withColumn("key", F.concat_ws("/", "scan", "id"))
    rows = materialised(dedupe.greedy_near(rows, id_="key", apart="scan"))
    all_ = materialised(displayed(rows, hidden))
    wanted = rank.filters(all_, open_at=(view.day, view.minute) if view.filters.get("open_now") else None, **{k: v for k, v in view.filters.items() if k != "open_now"})
    wanted = wanted.filter(F.col("score") >= view.least)  # the second pass spares none
    later = lambda scan: rows.filter(F.col("scan") == scan).withColumn("ord", F.col("ord") + _SEEDED_FIRST)
    out = audit.fallback_by([wanted, all_, later("listed"), later("wide")], "city", view.narrowed)
    return _ranked(out, view, top)


def _ranked(df: DataFrame, view: View, top: int | None) -> DataFrame:
    known = F.when(F.col("source") == "google", F.lit(None).cast("boolean")).otherwise(decisions.is_open(F.col("opening_hours"), F.lit(view.day), F.lit(view.minute)))
    df = df.withColumn("open", known)
    live: Column = F.when(F.col("open").isNull(), 1).when(F.col("open"), 0).otherwise(2)
    order = [live, (F.col("ord") >= _SEEDED_FIRST), F.desc("score"), "ord"]
    df = df.withColumn("rank", F.row_number().over(Window.partitionBy("city").orderBy(*order)))
    return df.filter(F.col("rank") <= top) if top else df


def given(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Both sources, cities and a user's state out of the given tables: a third of the places is curated.

    Some cities have no curated places, and of those some have hidden listed ones only, or far ones only.
    """
    p = adapters.places(spark, sf_dir).withColumn("legacy", F.array(F.concat(F.lit("part-"), (F.col("ord") - 1000).cast("string"))))
    k = F.col("ord")
    entry = lambda key, value: F.create_map(F.lit(key), value.cast("string"))
    patch = F.when(k % 50 == 7, entry("name", F.concat(F.lit("Renamed "), k.cast("string")))).when(k % 50 == 8, entry("specialtyScore", k % 130)).when(k % 50 == 9, entry("lat", F.col("city_lat")))
    overrides = p.filter(k % 50 >= 7).select("id", F.coalesce(patch, F.create_map().cast("map<string,string>")).alias("patch"), (k % 50 == 10).alias("deleted"))
    poor, far = F.col("city_key") % 7 == 3, F.col("city_key") % 7 == 5
    seeded = p.filter((k % 3 == 0) & ~poor & ~far).withColumn("source", F.lit("seeded")).withColumn("is_specialty", k % 4 == 0)
    ratings = adapters.ratings(spark, sf_dir).withColumn("ord", F.xxhash64("place_id"))
    hidden = p.filter((k % 11 == 3) | poor).select(F.col("id").alias("place_key"))
    listed = p.filter((k % 3 != 0) & (~far | (F.abs("dlat") > 0.035)))
    return {"listed": listed, "seeded": seeded, "cities": adapters.cities(spark, sf_dir), "ratings": ratings, "overrides": overrides, "hidden": hidden}
