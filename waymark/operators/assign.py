"""Assignments in which each thing goes once, and the earliest comes first."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import discard, materialised


def in_turn(wishes: DataFrame) -> DataFrame:
    """(turn, thing) of what each turn gets when all choose in order the first of their wishes that is left.

    ``wishes``: turn (unique, in order), place (of the wish among the turn's own) and thing.  Turns propose at
    once to their first wish, of each thing the earliest proposer stays, and those refused go on to their
    next one; since every thing prefers earlier turns, that ends with the same choice as the walk.  Only turns
    that were refused, and those that hold what they ask for, take part in a round; each round is written.
    """
    left = materialised(wishes.select("turn", "place", "thing").groupBy("turn", "thing").agg(F.min("place").alias("place")))
    while True:
        asked = left.groupBy("turn").agg(F.min_by("thing", F.struct("place", "thing")).alias("thing"))
        held = asked.groupBy("thing").agg(F.min("turn").alias("holder"))
        # a wish for what an earlier turn holds can never be met: things are only passed on to earlier turns
        kept = materialised(left.join(held, "thing", "left").filter("holder is null or turn <= holder").select("turn", "place", "thing"))
        done, refused = left, kept.count() < left.count()
        left = kept
        discard(done)
        if not refused:
            return left.groupBy("turn").agg(F.min_by("thing", F.struct("place", "thing")).alias("thing"))


def replace_photos(places: DataFrame, candidates: DataFrame, city: str = "city", photo: str = "photo_url") -> DataFrame:
    """Places with repeated photos of a city replaced: the first place (by ord) of each photo keeps it, and the others
    take in turn their first candidate that no place of the city has; a place without one keeps its photo.

    Turns go by photo, in the order of their first places, and then by ord.  ``places``: id, ord, city and photo;
    ``candidates``: id, place and url.  Adds ``replaced``: true, false (no candidate left) or null (nothing to do).
    """
    own = places.select("id", "ord", F.col(city).alias("city"), F.col(photo).alias("photo")).filter("photo != ''")
    groups = own.groupBy("city", "photo").agg(F.min("ord").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    needy = materialised(own.join(groups, ["city", "photo"]).filter("ord > first").select("id", "city", F.struct("first", "ord", "id").alias("turn")))
    wished = candidates.filter("url != ''").join(needy, "id").select("turn", "city", "place", "url")
    free = wished.join(own.select("city", F.col("photo").alias("url")).distinct(), ["city", "url"], "left_anti")
    got = in_turn(free.select("turn", "place", F.struct("city", "url").alias("thing")))
    new = needy.join(got, "turn", "left").select(F.col("id").alias("_id"), F.col("thing.url").alias("_url"))
    out = places.join(new, F.col("id") == F.col("_id"), "left")
    return out.withColumn("replaced", F.when(F.col("_id").isNotNull(), F.col("_url").isNotNull())).withColumn(photo, F.coalesce("_url", photo)).drop("_id", "_url")
