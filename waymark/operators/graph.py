"""Groups that links connect."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch_path(spark: SparkSession) -> str:
    """A new folder below the session's checkpoint folder, which all executors share; it goes when the session ends.

    A session without such a folder gets a temporary one in local mode; on a cluster that is an error.
    """
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("spark.checkpoint.dir names no folder that all executors share")
        context.setCheckpointDir(shared or os.path.join(tempfile.gettempdir(), "waymark-checkpoints"))
    path = f"{context._jsc.sc().getCheckpointDir().get()}/{uuid.uuid4().hex}"
    files, at = filesystem(spark, path)
    files.deleteOnExit(at)
    return path


def materialised(df: DataFrame) -> DataFrame:
    """``df`` as a table in the session's checkpoint folder: its plan begins at files, whose sizes are known.

    The table goes when the session ends, or by ``discard``.
    """
    path = scratch_path(df.sparkSession)
    df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table._written_to = path
    return table


def discard(*tables: DataFrame) -> None:
    """Remove materialised tables that no plan reads any more."""
    for t in tables:
        files, at = filesystem(t.sparkSession, t._written_to)
        files.delete(at, True)


def filesystem(spark: SparkSession, path: str):
    """The file system of a path, and the path as it takes it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), at


def groups(pairs: DataFrame) -> DataFrame:
    """(node, label) of the nodes of ``pairs`` (a, b); the label is the least node connected.

    Each round orders the vertices by a hash of its own and merges each into the first vertex within
    two pairs.  A star is one vertex after one round, and a chain shrinks to about a fifth whatever the
    order of its nodes; the pairs left between different vertices are those of the next round.
    """
    both = pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    left, merged = materialised(both), []
    while not left.isEmpty():
        place = lambda x, turn=len(merged): F.struct(F.xxhash64(x, F.lit(turn)).alias("place"), F.col(x).alias("v"))
        first = left.groupBy("a").agg(F.min(place("b")).alias("p")).select(F.col("a").alias("b"), F.least("p", place("a")).alias("p"))
        into = materialised(left.join(first, "b").groupBy("a").agg(F.min("p").alias("p")).select(F.col("a").alias("node"), F.col("p.v").alias("into")))
        merged.append(into)
        of = lambda x, into=into: into.select(F.col("node").alias(x), F.col("into").alias(f"_{x}"))
        done, left = left, materialised(left.join(of("a"), "a").join(of("b"), "b").filter("_a != _b").select(F.col("_a").alias("a"), F.col("_b").alias("b")).distinct())
        discard(done)
    if not merged:
        return left.select(F.col("a").alias("node"), F.col("b").alias("label"))
    labels = merged[0].select("node", F.col("into").alias("label"))
    for into in merged[1:]:
        labels = labels.join(into.select(F.col("node").alias("label"), "into"), "label", "left").select("node", F.coalesce("into", "label").alias("label"))
    labels = materialised(labels)
    discard(left, *merged)
    least = labels.groupBy("label").agg(F.min("node").alias("least"))
    return labels.join(least, "label").select("node", F.col("least").alias("label"))
