"""Deep searches of JSON documents: every value with its path, level by level, in the order of the document."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import finite
from ..operators.graph import materialised

#: Levels below the document that the search for an image goes down to.
DEPTH = 6
#: A page's linked data.
LINKED_DATA = r"""(?is)<script[^>]*type=["']application/ld\+json["'][^>]*>(.*?)</script>"""


def _kind(value: Column) -> Column:
    """object, array, string, number, boolean or null of a variant."""
    said = F.schema_of_variant(value)
    return (
        F.when(said.startswith("OBJECT"), "object").when(said.startswith("ARRAY"), "array").when(said == "STRING", "string")
        .when(said == "BOOLEAN", "boolean").when(said == "VOID", "null").otherwise("number")
    )


def walk(documents: DataFrame, json: str, depth: int | None = None) -> DataFrame:
    """The values of each document, down to ``depth`` if one is given: the caller's columns, and path, key, text and kind.

    ``path`` has the place of each step among its siblings, so paths are in the order of the document, a value
    before what it holds.  ``text`` is the value as JSON, of a string the string itself.  Each level is the last
    one's objects and arrays taken apart: members come in the order of the text (a map keeps it), their kinds from
    the same members as variants.  A broken document has no values.  Each level is written once.
    """
    names = [c for c in documents.columns if c != json]
    kept = F.struct(F.lit(True).alias("_"), *[F.col(f"`{c}`") for c in names]).alias("row")
    parsed = F.try_parse_json(F.col(f"`{json}`"))
    root = documents.select(kept, F.array().cast("array<int>").alias("path"), F.lit(None).cast("string").alias("key"), F.col(f"`{json}`").alias("text"), parsed.alias("v")).filter("v is not null")
    alone = F.when(_kind(F.col("v")) == "string", F.try_variant_get("v", "$", "string")).otherwise(F.col("text"))
    level = materialised(root.select("row", "path", "key", alone.alias("text"), _kind(F.col("v")).alias("kind")))
    found = [level]
    while len(found) - 1 != depth and not found[-1].filter("kind in ('object', 'array')").isEmpty():
        text = F.col("text")
        members, typed = F.from_json(text, "map<string,string>"), F.from_json(text, "map<string,variant>")
        items, typed_items = F.from_json(text, "array<string>"), F.from_json(text, "array<variant>")
        kinds = lambda values: F.transform(values, _kind)
        inside = F.when(F.col("kind") == "object", F.arrays_zip(F.map_keys(members).alias("key"), F.map_values(members).alias("text"), kinds(F.map_values(typed)).alias("kind")))
        listed = F.arrays_zip(F.transform(items, lambda _, i: i.cast("string")).alias("key"), items.alias("text"), kinds(typed_items).alias("kind"))
        below = found[-1].filter("kind in ('object', 'array')").select("row", "path", F.posexplode(inside.otherwise(listed)).alias("at", "m"))
        level = below.select("row", F.concat("path", F.array("at")).alias("path"), F.col("m.key").alias("key"), F.col("m.text").alias("text"), F.coalesce("m.kind", F.lit("null")).alias("kind"))
        found.append(materialised(level))
    whole = found[0]
    for more in found[1:]:
        whole = whole.unionByName(more)
    return whole.select(*[F.col("row").getField(c).alias(c) for c in names], "path", "key", "text", "kind")


def first_string(documents: DataFrame, json: str, key: str, wanted: Column, depth: int = DEPTH) -> DataFrame:
    """(key, text): the first string of each document (by ``key``) for which ``wanted``, an expression of ``text``, holds."""
    strings = walk(documents, json, depth).filter("kind = 'string'").withColumn("text", F.trim("text")).filter(wanted)
    return strings.groupBy(key).agg(F.min_by("text", "path").alias("text"))


def is_image(text: Column, host: str) -> Column:
    return text.rlike("(?i)^https://") & F.contains(F.lower(text), F.lit(host.lower()))


#: Names of the members that hold a point, the first pair before the second.
POINTS = (("latitude", "longitude"), ("lat", "lng"))


def points(documents: DataFrame, json: str, order: Sequence[str], depth: int | None = None) -> DataFrame:
    """(``order`` columns, path, lat, lon) of every object that has a point: numbers, or strings that read as such.

    An empty string or null reads as zero, as it does where these documents are made.
    """
    rows = walk(documents, json, depth)
    number = F.when(F.col("kind").isin("number", "string", "null"), F.when(F.trim(F.coalesce("text", F.lit(""))) == "", F.lit(0.0)).otherwise(finite(F.trim("text").try_cast("double"))))
    number = F.when(F.col("kind") == "boolean", (F.col("text") == "true").cast("double")).otherwise(number)
    names = [n for pair in POINTS for n in pair]
    members = rows.filter((F.size("path") > 0) & F.col("key").isin(names)).withColumn("n", number)
    parent = members.groupBy(*order, F.slice("path", F.lit(1), F.size("path") - 1).alias("path")).agg(*[F.max(F.when(F.col("key") == n, F.col("n"))).alias(n) for n in names])
    point = F.lit(None).cast("struct<lat:double,lon:double>")
    for lat, lon in reversed(POINTS):
        point = F.when(F.col(lat).isNotNull() & F.col(lon).isNotNull(), F.struct(F.col(lat).alias("lat"), F.col(lon).alias("lon"))).otherwise(point)
    return parent.withColumn("point", point).filter("point is not null").select(*order, "path", "point.lat", "point.lon")


def linked_points(pages: DataFrame, html: str, key: str, depth: int | None = None) -> DataFrame:
    """(key, lat, lon): the first point in the linked data of each page (by ``key``), by script and then by place in it."""
    scripts = pages.select(F.col(key), F.posexplode(F.regexp_extract_all(html, F.lit(LINKED_DATA), F.lit(1))).alias("script", "json"))
    found = points(scripts.filter(F.trim("json") != ""), "json", [key, "script"], depth)
    first = found.groupBy(key).agg(F.min_by(F.struct("lat", "lon"), F.struct("script", "path")).alias("p"))
    return first.select(key, "p.lat", "p.lon")
