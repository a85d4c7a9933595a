"""Sinks: partitioned places, state snapshots, reports and logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import folded
from ..operators.graph import filesystem, materialised


def slug(text: Column) -> Column:
    """A name for paths: letters without accents and digits, joined by hyphens; "city" if nothing is left."""
    s = F.lower(F.regexp_replace(folded(F.coalesce(text, F.lit(""))), "[^a-zA-Z0-9]+", "-"))
    return F.coalesce(F.nullif(F.regexp_replace(s, "^-+|-+$", ""), F.lit("")), F.lit("city"))


def city_index(places: DataFrame, city: str = "city") -> DataFrame:
    """One row a city: name, mean coordinates and a slug, numbered where slugs collide (one row a city)."""
    index = places.groupBy(F.col(city).alias("city")).agg(F.avg("lat").alias("lat"), F.avg("lon").alias("lon"), F.count(F.lit(1)).alias("n")).withColumn("base", slug(F.col("city")))
    nth = F.row_number().over(Window.partitionBy("base").orderBy("city"))
    return index.withColumn("city_slug", F.when(nth == 1, F.col("base")).otherwise(F.concat_ws("-", "base", nth))).drop("base")


def write_by_city(places: DataFrame, path: str, city: str = "city", write: bool = True) -> DataFrame:
    """Write places partitioned by their city's slug, and return the index; nothing is written in a dry run."""
    index = city_index(places, city)
    if write:
        named = places.join(index.select(F.col("city").alias("_city"), "city_slug"), F.col(city) == F.col("_city")).drop("_city")
        named.write.mode("overwrite").partitionBy("city_slug").parquet(path)
    return index


def snapshot(state: DataFrame, path: str, stamp: str) -> None:
    """Overwrite the current state, and keep a copy under its stamp."""
    state.write.mode("overwrite").parquet(f"{path}/current")
    state.write.mode("overwrite").parquet(f"{path}/history/{stamp}")


def replace_table(df: DataFrame, path: str, stamp: str, write: bool = True) -> DataFrame:
    """``df`` in place of the table at ``path``, whose rows are first copied to ``path``.before-``stamp``; a dry run only returns ``df``."""
    if write:
        spark, new = df.sparkSession, materialised(df)  # it may be read from the path that it replaces
        files, at = filesystem(spark, path)
        if files.exists(at):
            spark.read.parquet(path).write.parquet(f"{path}.before-{stamp}")
        new.write.mode("overwrite").parquet(path)
    return df


def append_log(events: DataFrame, path: str) -> None:
    events.write.mode("append").json(path)


def report(named: dict[str, DataFrame], path: str) -> None:
    for name, df in named.items():
        df.write.mode("overwrite").json(f"{path}/{name}")


def export_manual(places: DataFrame, path: str) -> None:
    """Manual places as one JSON file: they are a user's own, few enough for one task."""
    places.coalesce(1).write.mode("overwrite").json(path)


def import_manual(spark: SparkSession, path: str, current: DataFrame) -> DataFrame:
    """The places of an export in place of the current ones, also where it holds none.

    A path that is not there, or whose files hold something else than JSON objects or one array of them, leaves
    the current places as they are.
    """
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(at):
        return current
    text = spark.read.text(path, wholetext=True).filter("trim(value) != ''")  # a user's own places: each file fits a task
    listed = F.col("value").rlike(r"^\s*\[")
    documents = text.select(F.explode(F.when(listed, F.array("value")).otherwise(F.split("value", r"[\r\n]+"))).alias("value")).filter("trim(value) != ''")
    kind = current.schema.simpleString()
    one = F.when(listed, F.from_json("value", f"array<{kind}>", {"mode": "FAILFAST"})).otherwise(F.array(F.from_json("value", kind, {"mode": "FAILFAST"})))
    parsed = F.try_parse_json("value")
    sound = F.schema_of_variant(parsed).rlike("^(OBJECT|ARRAY<(OBJECT|VOID))")
    if documents.filter(~F.coalesce(sound, F.lit(False))).limit(1).count():
        return current
    return documents.select(F.explode(one).alias("p")).select("p.*")
