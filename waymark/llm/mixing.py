"""Mixing sources to target weights by the cube method.

Each document of a source is expected target / source_size times in the mix.  The whole part is
given outright; the fraction is an inclusion probability.  The cube method's flight phase moves the
fractions of a block of documents through the null space of the balancing constraints (words and
documents), so that totals stay exact, until a handful of documents per block are undecided.  The
undecided of all blocks of a source are gathered into fewer blocks and flown again, level by level;
the few that are left of a source at the end land on the rounding whose words come nearest.

Null texts have size 0, as have empty ones; they join by their fraction but count no words.  Very long
texts count all their words.  Null sources are a source of their own.  Repeated rows are separate documents,
and are dealt to blocks by their number, so that none gets all of them.  An empty table has an empty mix.
Everything follows from hashes of the rows, so reruns agree.  Columns may have any names.
"""

from __future__ import annotations

from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut_lineage, n_words, packed, table, unpacked

WEIGHTS, SHARE, MOST_REPEATS = (3, 1, 2), 1.5, 2.0
#: Documents flown together.
BLOCK = 2048
#: With at most so many sources their table is broadcast; with more it is joined by shuffle.
FEW_SOURCES = 10_000
#: Repeated rows of one kind that a task makes at a time.
REPEATS = 100_000
_EPS = 1e-9


def flight(p: np.ndarray, a: np.ndarray) -> np.ndarray:
    """Round all but at most as many of the fractions ``p`` as ``a`` has columns, keeping ``p @ a``.

    Documents are taken in order, in windows of one more than there are constraints; each step goes
    along a null vector of the window as far as the first fraction that becomes 0 or 1.
    """
    p, k = p.copy(), a.shape[1]
    scale = np.maximum(np.abs(a).max(axis=0), 1.0) if len(a) else np.ones(k)
    rows = (a / scale).tolist()
    values = p.tolist()
    window: list[int] = []
    for i in range(len(values)):
        if values[i] <= _EPS or values[i] >= 1 - _EPS:
            values[i] = float(round(values[i]))
            continue
        window.append(i)
        while len(window) > k:
            u = _null([rows[j] for j in window], k)
            up = min(((1 - values[j]) / x if x > 0 else values[j] / -x) for j, x in zip(window, u, strict=True) if abs(x) > 1e-12)
            down = min((values[j] / x if x > 0 else (1 - values[j]) / -x) for j, x in zip(window, u, strict=True) if abs(x) > 1e-12)
            step = up if up <= down else -down  # the nearer wall; the first of equals
            left = []
            for j, x in zip(window, u, strict=True):
                v = values[j] + step * x
                values[j] = v = 0.0 if v <= _EPS else 1.0 if v >= 1 - _EPS else v
                if 0.0 < v < 1.0:
                    left.append(j)
            window = left
    return np.array(values)


def _null(rows: list[list[float]], k: int) -> list[float]:
    """A vector orthogonal to the ``k`` columns of the ``k + 1`` rows."""
    if k == 2:
        (a, b), (c, d), (e, f) = rows
        u = [c * f - d * e, b * e - a * f, a * d - b * c]
        if max(map(abs, u)) > 1e-12:
            return u
    return np.linalg.svd(np.array(rows).T)[2][-1].tolist()


def land(p: np.ndarray, sizes: np.ndarray, owed: float) -> np.ndarray:
    """The rounding of a few fractions whose words come nearest to ``owed``; then whose count is nearest."""
    if not len(p):
        return p
    best = min(product((0.0, 1.0), repeat=len(p)), key=lambda c: (abs(np.dot(c, sizes) - owed), abs(sum(c) - p.sum()), c))
    return np.array(best)


def targets(sources: DataFrame, source: str = "source", size: str = "source_size", weights=WEIGHTS, share: float = SHARE, most: float = MOST_REPEATS) -> DataFrame:
    """Add each source's target to a table of one row a source.

    Weights repeat along the sources by code point, null last.  Ordered by the level at which a
    source is full, the sources that stop at ``most`` times their size are a prefix; the rest share
    what is left by weight.  The table has one row a source, not a document.
    """
    order = Window.orderBy(F.col(source).isNull(), F.col(source).cast("binary"))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    full = F.col("_cap") / F.col("_w")
    by_level = Window.orderBy(full, F.col(source).isNull(), F.col(source).cast("binary"))
    before, after = by_level.rowsBetween(Window.unboundedPreceding, -1), by_level.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy(F.lit(0))
    t = (
        sources.withColumn("_w", w).withColumn("_cap", F.lit(float(most)) * F.col(size))
        .withColumn("_all", F.sum(size).over(everything) * F.lit(float(share)))
        .withColumn("_level", (F.col("_all") - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / F.sum("_w").over(after))
        .withColumn("_place", F.row_number().over(by_level))
        .withColumn("_level", F.min(F.when(full > F.col("_level"), F.struct("_place", F.col("_level").alias("l")))).over(everything)["l"])
    )
    return t.withColumn("target", F.least(F.col("_cap"), F.coalesce(F.col("_level") * F.col("_w"), F.col("_cap")))).select(*sources.columns, "target")


def _with_source(df: DataFrame, per_source: DataFrame, few: bool) -> DataFrame:
    other = per_source.withColumnRenamed("source", "_source")
    return df.join(F.broadcast(other) if few else other, F.col("source").eqNullSafe(F.col("_source")), "left").drop("_source")


def _numbered(rows: DataFrame) -> DataFrame:
    """``rows`` with equal ones told apart by a number (nth); a kind that is repeated often comes from several tasks."""
    counted = rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("n"))
    runs = counted.withColumn("run", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(n - 1) div {REPEATS}")))).repartition("h", "run")
    first = F.col("run") * REPEATS
    return runs.select(*rows.columns, F.explode(F.sequence(first, F.least(first + REPEATS, F.col("n")) - 1)).alias("nth"))


def mix(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text", block: int = BLOCK) -> DataFrame:
    """Per document doc_id, source, size, source_size, target, taken (words), copies (0, 1 or 2) and h (its hash)."""
    key, of, t = F.col(f"`{doc_id}`"), F.col(f"`{source}`"), F.col(f"`{text}`")
    sized = docs.select(key.alias("doc_id"), of.alias("source"), n_words(t).alias("size"), F.xxhash64(key, of, t).alias("h"))
    per_source = cut_lineage(targets(sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("left"))))
    few = per_source.count() <= FEW_SOURCES
    sized = _with_source(_numbered(sized), per_source, few)
    # the documents of a source without words are expected as often as those of an average source
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(SHARE))
    sized = sized.withColumn("sure", F.floor(rate + _EPS).cast("int")).withColumn("p", F.greatest(rate - F.col("sure"), F.lit(0.0)))
    flown, level, done = sized, 0, None
    while True:
        blocks = F.greatest(F.ceil(F.col("left") / block), F.lit(1))
        flown = flown.withColumn("block", F.pmod(F.xxhash64("h", "nth", F.lit(level)), blocks)).withColumn("last", F.col("left") <= block)
        schema = flown.drop("left", "block", "last").schema

        def fly(part: pd.DataFrame) -> pd.DataFrame:
            part = part.sort_values(["h", "nth", "doc_id", "size"], kind="stable")
            p, size = part["p"].to_numpy(float), part["size"].to_numpy(float)
            r = flight(p, np.column_stack([size, np.ones(len(p))]))
            if part["last"].iloc[0]:
                rest = np.flatnonzero((r > 0) & (r < 1))
                r[rest] = land(r[rest], size[rest], float(np.dot(r[rest], size[rest])))
            return part.assign(p=r)[schema.names]

        flown = cut_lineage(flown.groupBy("source", "block").applyInPandas(fly, schema))
        decided = (F.col("p") <= 0) | (F.col("p") >= 1)
        done = flown.filter(decided) if done is None else done.unionByName(flown.filter(decided))
        flown = flown.filter(~decided)
        if flown.isEmpty():
            break
        flown, level = _with_source(flown, flown.groupBy("source").agg(F.count(F.lit(1)).alias("left")), few), level + 1
    done = done.withColumn("copies", F.col("sure") + F.col("p").cast("int"))
    return done.select("doc_id", "source", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies", "h")


def mixed(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """The documents of the mix, all columns, each row as often as the mix takes it."""
    # a document is known by the hashes of its id, source and text; equal rows are told apart by number
    second = lambda i, o: F.xxhash64(F.lit(2), i, o)
    chosen = mix(docs, doc_id, source, text).select("h", second(F.col("doc_id"), F.col("source")).alias("g"), "copies")
    chosen = chosen.withColumn("nth", F.row_number().over(Window.partitionBy("h", "g").orderBy(F.desc("copies")))).filter("copies > 0")
    key, of, t = F.col(f"`{doc_id}`"), F.col(f"`{source}`"), F.col(f"`{text}`")
    rows = packed(docs, F.xxhash64(key, of, t).alias("h"), second(key, of).alias("g"))
    rows = rows.withColumn("nth", F.row_number().over(Window.partitionBy("h", "g").orderBy("h")))
    taken = rows.join(chosen, ["h", "g", "nth"]).select("row", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"))
    return taken.select(*unpacked(docs.columns))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mix(docs).select("doc_id", "size", "source_size", F.col("target").cast("double").alias("target"), "taken")
