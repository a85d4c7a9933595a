"""Likely duplicates of places, merges of records, and best rows of a key."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vocab as v
from ..functions.geo import EARTH_KM, cell, haversine_km
from ..functions.text import bound, once, place_text
from .graph import groups, materialised
from .locate import reached

#: Records further apart than this, in km, are never duplicates.
FARTHEST = 0.091
#: Records of one cell that are handled as one, and of those of one point and name.
CHUNK, RUN = 1024, 256


def profile(city: Column) -> Column:
    """struct(close, name, address): metres within which records of a city count as one."""
    s = lambda p: F.struct(*[F.lit(x).alias(n) for x, n in zip(p, ("close", "name", "address"), strict=True)])
    out = s(v.DEDUPE_DEFAULT)
    for name, p in v.DEDUPE_BY_CITY.items():
        out = F.when(city == name, s(p)).otherwise(out)
    return out


def named_alike(m: Column, na: Column, nb: Column, p: Column) -> Column:
    """Whether two records ``m`` metres apart are likely one by their normalised names alone."""
    short, long_ = F.when(F.length(na) <= F.length(nb), na).otherwise(nb), F.when(F.length(na) <= F.length(nb), nb).otherwise(na)
    variant = (F.length(short) >= 3) & ~short.isin(v.GENERIC_TOKENS) & F.contains(long_, short)
    return ((na != "") & (na == nb) & (m <= F.greatest(p["name"], p["close"]))) | (variant & (m <= F.greatest(p["name"], F.lit(55.0))))


def alike(m: Column, na: Column, nb: Column, aa: Column, ab: Column, p: Column) -> Column:
    """Whether two records ``m`` metres apart are likely one, by normalised names and addresses."""
    return ((aa != "") & (aa == ab) & (m <= p["address"])) | named_alike(m, na, nb, p) | ((m <= p["close"]) & ((aa == "") | (ab == "")))


def duplicate_pairs(places: DataFrame, id_: str = "id", city: str = "city", digits: int | None = None) -> DataFrame:
    """Pairs (a, b, metres) of likely duplicates of one city, the one with the lower ord first.

    ``digits``: the metres are rounded to so many, once for all members of two kinds.
    Records of a grid cell are dealt to chunks, and in a chunk to kinds: those of one name at one point.
    Chunks of near cells meet once, and distances and names are compared once for two kinds.  What these leave open
    goes by the addresses of the members, which are read as the pairs are written out.  The pairs themselves
    are not shuffled, and a task holds two chunks.
    """
    row, col = cell(F.col("lat"), F.col("lon"), FARTHEST)
    base = places.select(F.col(id_).alias("id"), "ord", F.col(city).alias("city"), "lat", "lon", place_text(F.col("name")).alias("n"), place_text(F.col("address")).alias("a"))
    base = base.dropna(subset=["ord", "city", "lat", "lon"]).withColumn("_row", row).withColumn("_col", col)
    within = Window.partitionBy("city", "_row", "_col")
    number = F.row_number().over(within.orderBy("lat", "lon", "n", "a", "ord"))
    numbered = base.withColumn("_n", number - 1).withColumn("_chunk", F.floor(F.col("_n") / CHUNK)).withColumn("_run", F.floor(F.col("_n") / RUN))
    members = F.sort_array(F.collect_list(F.struct("a", "ord", "id")))
    kinds = numbered.groupBy("city", "_row", "_col", "_chunk", "lat", "lon", "n", "_run").agg(F.array_remove(F.collect_set("a"), "").alias("as"), F.bool_or(F.col("a") == "").alias("bare"), members.alias("m"))
    fields = ("lat", "lon", "n", "as", "bare", "m")
    held = F.transform(F.collect_list(F.struct(*fields)), lambda x, i: F.struct(i.alias("k"), *[x[c].alias(c) for c in fields]))
    chunks = materialised(kinds.groupBy("city", "_row", "_col", "_chunk").agg(held.alias("kinds")).withColumn("chunk", F.monotonically_increasing_id()))

    at = chunks.select("city", F.col("_row").alias("_row0"), F.col("_col").alias("_col0"), F.explode("kinds").alias("x")).select("city", "_row0", "_col0", "x.lat", "x.lon").distinct()
    steps = reached(at, FARTHEST).select("city", "_row0", "_col0", "_row", "_col").distinct()
    names = chunks.select("city", "_row", "_col", "chunk")
    met = steps.join(names.withColumnsRenamed({"_row": "_row0", "_col": "_col0", "chunk": "c"}), ["city", "_row0", "_col0"]).join(names.withColumnRenamed("chunk", "d"), ["city", "_row", "_col"])
    met = met.select(F.least("c", "d").alias("left"), F.greatest("c", "d").alias("right")).distinct()

    tasks = max(48, 6 * places.sparkSession.sparkContext.defaultParallelism)  # a few bytes become many rows, so their size is no measure
    met = met.join(chunks.select(F.col("chunk").alias("left"), "city", F.col("kinds").alias("_l")), "left").repartition(tasks, "right").join(chunks.select(F.col("chunk").alias("right"), F.col("kinds").alias("_r")), "right")
    fields = ("k", *fields)
    both = met.select(profile(F.col("city")).alias("p"), (F.col("left") == F.col("right")).alias("same"), "_r", F.inline("_l").alias(*[f"l{c}" for c in fields]))
    both = both.select("p", "same", *[f"l{c}" for c in fields], F.inline("_r").alias(*[f"r{c}" for c in fields])).filter("not same or lk <= rk")
    both = once(both, km=haversine_km(F.col("llat"), F.col("llon"), F.col("rlat"), F.col("rlon"))).filter(F.col("km") <= FARTHEST).withColumn("m", F.col("km") * 1000)
    rule = {"named": named_alike(F.col("m"), F.col("ln"), F.col("rn"), F.col("p")), "close": F.col("m") <= F.col("p.close"), "reach": F.col("m") <= F.col("p.address")}
    both = once(both, **rule)
    some = F.col("named") | (F.col("close") & (F.col("lbare") | F.col("rbare"))) | (F.col("reach") & F.arrays_overlap("las", "ras"))
    # bound, not chained: a row of two chunks would else become all its pairs in one step, and these would wait in memory
    metres = bound(F.col("m"), lambda m: m if digits is None else F.round(m, digits))
    out = both.filter(some).select(metres.alias("metres"), (F.col("same") & (F.col("lk") == F.col("rk"))).alias("self"), *rule, "rm", F.inline("lm").alias("la", "lord", "lid"))
    out = out.select("metres", "self", *rule, "la", "lord", "lid", F.inline("rm").alias("ra", "rord", "rid")).filter("lord < rord or (not self and lord > rord)")
    out = out.filter("named or (close and (la = '' or ra = '')) or (reach and la != '' and la = ra)")
    first = F.col("lord") < F.col("rord")
    return out.select(F.when(first, F.col("lid")).otherwise(F.col("rid")).alias("a"), F.when(first, F.col("rid")).otherwise(F.col("lid")).alias("b"), "metres")


def greedy(places: DataFrame, pairs: DataFrame, quality: str = "quality", id_: str = "id") -> DataFrame:
    """The records that remain when each, in order, joins the first kept record that it is like.

    A better record takes the place of the one it joins.  The rule follows the order and is not
    transitive, so the groups of records that links connect are walked one by one; a record without
    links stays without a walk.
    """
    pairs = materialised(pairs)
    linked_groups = groups(pairs)
    linked = places.join(linked_groups, F.col(id_) == linked_groups["node"], "inner").select(F.col(id_).alias("id"), "ord", F.col(quality).alias("q"), "label")
    links = pairs.join(linked_groups, pairs["a"] == linked_groups["node"]).select("label", "a", "b").toDF("group", "a", "b")

    def walk(key: tuple, rows: pd.DataFrame, edges: pd.DataFrame) -> pd.DataFrame:
        like: dict[str, set[str]] = {}
        for a, b in zip(edges["a"], edges["b"], strict=True):
            like.setdefault(a, set()).add(b)
            like.setdefault(b, set()).add(a)
        kept: list[tuple[str, float]] = []
        for r in rows.sort_values("ord").itertuples():
            at = next((i for i, (k, _) in enumerate(kept) if k in like.get(r.id, ())), None)
            if at is None:
                kept.append((r.id, r.q))
            elif r.q > kept[at][1]:
                kept[at] = (r.id, r.q)
        return pd.DataFrame({"kept": [k for k, _ in kept]})

    kept = linked.groupBy("label").cogroup(links.groupBy("group")).applyInPandas(walk, "kept string")
    lost = linked.join(kept, F.col("id") == F.col("kept"), "left_anti").select(F.col("id").alias("_lost"))
    return places.join(lost, F.col(id_) == F.col("_lost"), "left_anti")


class _Slots:
    """The kept records of one group in the order their places were founded, found by position."""

    def __init__(self):
        self.near: dict[tuple, dict[int, tuple]] = {}
        self.count = 0

    def put(self, r: tuple, at: tuple, quality: float) -> None:
        """Join the first kept record that ``r`` (ord, id, n, a, lat, lon) is like, or found a place."""
        x, y, z, close, name, address = at
        first = None
        for i in (x, x - 1, x + 1):
            for j in (y, y - 1, y + 1):
                for k in (z, z - 1, z + 1):
                    for slot, kept in self.near.get((i, j, k), {}).items():
                        if (first is None or slot < first[0]) and _alike(r, kept[0], close, name, address):
                            first = slot, kept, (i, j, k)
        if first is None:
            slot, self.count = self.count, self.count + 1
        elif quality > first[1][1]:
            slot = first[0]
            del self.near[first[2]][slot]
        else:
            return
        self.near.setdefault((x, y, z), {})[slot] = r, quality

    def ids(self) -> list[str]:
        return [r[1] for kept in self.near.values() for r, _ in kept.values()]


def _alike(r: tuple, s: tuple, close: float, name: float, address: float) -> bool:
    """``alike`` for two records in a task."""
    (o, _, n, a, lat, lon), (p, _, m, b, lat2, lon2) = r, s
    if o == p:
        return False
    same_name, same_address, no_address = n != "" and n == m, a != "" and a == b, a == "" or b == ""
    short, long_ = (n, m) if len(n) <= len(m) else (m, n)
    variant = len(short) >= 3 and short in long_ and short not in v.GENERIC_TOKENS
    if not (same_name or same_address or no_address or variant):
        return False
    if lat == lat2 and lon == lon2:
        metres = 0.0
    else:
        h = math.sin(math.radians(lat - lat2) / 2) ** 2 + math.cos(math.radians(lat)) * math.cos(math.radians(lat2)) * math.sin(math.radians(lon - lon2) / 2) ** 2
        metres = 2000 * EARTH_KM * math.atan2(math.sqrt(h), math.sqrt(1 - h))
    return metres <= FARTHEST * 1000 and (same_address and metres <= address or same_name and metres <= name or variant and metres <= max(name, 55.0) or metres <= close and (same_name or no_address))


def greedy_near(places: DataFrame, quality: str = "quality", id_: str = "id", city: str = "city", apart: str | None = None) -> DataFrame:
    """``greedy`` over ``duplicate_pairs``, without the pairs.

    The rule goes by the order, so the records of a group are read in order by one task; but the task
    holds the kept records of the group alone and compares each record with those near it.  Groups are
    the cells of one city that near records connect: they may be wider than the links ask for, which
    changes nothing, since records without a link have no influence on each other.  Ids are unique; records
    that differ in the text ``apart`` are never alike.  Only the columns that the rule needs are read from
    ``places`` before the last join, so a table that is costly to make should be written first.
    """
    named = F.concat_ws("/", F.col("_row"), F.col("_col"), F.col("city"), F.col("apart"))
    row, col = cell(F.col("lat"), F.col("lon"), FARTHEST)
    base = places.select(
        F.col(id_).alias("id"), "ord", F.col(city).alias("city"), F.col("lat").cast("double"), F.col("lon").cast("double"), F.col(quality).cast("double").alias("q"), place_text(F.col("name")).alias("n"), place_text(F.col("address")).alias("a"), F.coalesce(F.col(apart), F.lit("")).alias("apart") if apart else F.lit("").alias("apart")
    ).dropna(subset=["id", "ord", "city", "lat", "lon"])
    base = materialised(base.withColumn("_row", row).withColumn("_col", col).withColumn("cell", named).drop("_row", "_col"))
    cells = base.select("cell").distinct()
    steps = reached(base.select("cell", "city", "apart", "lat", "lon").distinct(), FARTHEST).select(F.col("cell").alias("a"), named.alias("b")).filter("a != b").distinct()
    labels = groups(steps.join(cells, F.col("b") == F.col("cell"), "left_semi"))
    grouped = base.join(labels.withColumnRenamed("node", "cell"), "cell", "left").withColumn("group", F.coalesce("label", "cell"))
    p = profile(F.col("city"))
    rows = grouped.select("group", "ord", "id", "n", "a", "lat", "lon", "q", *[p[c].alias(f"_{c}") for c in ("close", "name", "address")])

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group, slots = None, _Slots()
        for batch in batches:
            lat, lon = np.radians(batch["lat"].to_numpy()), np.radians(batch["lon"].to_numpy())
            # a distance through the globe is no longer than the one along it
            at = [np.floor(np.nan_to_num(c) * EARTH_KM / (FARTHEST * 1.001)).astype(np.int64).tolist() for c in (np.cos(lat) * np.cos(lon), np.cos(lat) * np.sin(lon), np.sin(lat))]
            records = zip(*(batch[c].tolist() for c in ("ord", "id", "n", "a", "lat", "lon")), strict=True)
            places_ = zip(*at, *(batch[c].tolist() for c in ("_close", "_name", "_address")), strict=True)
            done: list[str] = []
            for g, r, place, q in zip(batch["group"].tolist(), records, places_, batch["q"].tolist(), strict=True):
                if g != group:
                    done += slots.ids()
                    group, slots = g, _Slots()
                slots.put(r, place, q)
            yield pd.DataFrame({"kept": pd.Series(done, dtype=object)})
        yield pd.DataFrame({"kept": pd.Series(slots.ids(), dtype=object)})

    kept = rows.repartition("group").sortWithinPartitions("group", "ord", "id").mapInPandas(walk, "kept string")
    lost = base.join(kept, F.col("id") == F.col("kept"), "left_anti").select(F.col("id").alias("_lost"))
    return places.join(lost, F.col(id_) == F.col("_lost"), "left_anti")


def merge_by_key(df: DataFrame, key: Column, order: str, scalars: list[str], lists: list[str]) -> DataFrame:
    """One row a key: of each column the first value that is not missing, of list columns the union in order.

    Rows without a key stay as they are.
    """
    d = df.withColumn("_key", key)
    by_order = lambda value, keep: F.min(F.when(keep, F.struct(F.col(order), value.alias("v"))))["v"]
    firsts = [by_order(F.col(c), F.col(c).isNotNull() & (F.col(c).cast("string") != "")).alias(c) for c in scalars]
    all_ = [F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order), F.col(c).alias("v")))), lambda x: F.coalesce(x["v"], F.array().cast("array<string>"))))).alias(c) for c in lists]
    merged = d.filter(F.col("_key").isNotNull()).groupBy("_key").agg(F.min(order).alias(order), *firsts, *all_)
    return merged.unionByName(d.filter(F.col("_key").isNull()).select("_key", order, *scalars, *lists))


def best_of(df: DataFrame, key: Column, *order: Column) -> DataFrame:
    """The first row of each key in the given order."""
    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


