"""Connected components by rounds of contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of the nodes of ``edges`` (a, b): nodes have the same label, one of them, if edges connect them.

    Each round orders the vertices by a hash of its own and merges each into the first vertex within
    two edges.  A star is one vertex after one round, and chains shrink to about a fifth whatever the
    order of their nodes.  What is left between different vertices are the edges of the next round.
    """
    scratch = Scratch(edges.sparkSession)
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    left, merged = scratch.keep(both), []
    while not left.isEmpty():
        place = lambda x, turn=len(merged): F.struct(F.xxhash64(x, F.lit(turn)).alias("place"), F.col(x).alias("v"))
        first = left.groupBy("a").agg(F.min(place("b")).alias("p")).select(F.col("a").alias("b"), F.least("p", place("a")).alias("p"))
        into = scratch.keep(left.join(first, "b").groupBy("a").agg(F.min("p").alias("p")).select(F.col("a").alias("node"), F.col("p.v").alias("into")))
        merged.append(into)
        of = lambda x: into.select(F.col("node").alias(x), F.col("into").alias(f"_{x}"))  # noqa: B023, E731
        moved = left.join(of("a"), "a").join(of("b"), "b").filter("_a != _b").select(F.col("_a").alias("a"), F.col("_b").alias("b")).distinct()
        done, left = left, scratch.keep(moved)
        scratch.drop(done)
    if not merged:
        return left.select(F.col("a").alias("node"), F.col("b").alias("label"))
    labels = merged[0].select("node", F.col("into").alias("label"))
    for into in merged[1:]:
        step = into.select(F.col("node").alias("label"), "into")
        labels = labels.join(step, "label", "left").select("node", F.coalesce("into", "label").alias("label"))
    result = Scratch(edges.sparkSession).keep(labels)
    scratch.drop(left, *merged)
    return result
