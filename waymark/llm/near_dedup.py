"""Near-duplicates by DartMinHash signatures, a banded join and an exact check.

A text's shingles are its runs of five words (all its words, if there are fewer), each weighing as
often as it occurs.  Hashed darts are thrown into the unit cells of each shingle's region, element by
weight by rank; each dart belongs to a coordinate of the signature, and the earliest dart of a
coordinate is kept.  Bands of coordinates are the keys of a join.  Two texts are linked if the sum of
the lesser weights is at least 0.8 of the sum of the greater ones, which for texts that repeat no
shingle is the Jaccard similarity of the sets.  Classes are what links connect.

Texts with the same weighted shingles are one node.  A bucket's nodes are checked exactly against its
leader, so a group of copies costs one link a member.  Nodes of one leader that are then still in different
classes can only be alike where they differ from the leader in the same shingles: they meet on the rarest of
their differences, as many as an exact bound asks for, and are checked exactly too.  Differences that one
class alone has bring no nodes together, and nodes of one class never meet.  No link between texts of one
bucket is lost; only the bands can miss one (at a similarity of 0.8 with a chance of 6e-5).

Texts without words (null, empty, white space) are left alone: each is a class of its own.  Very long texts
are taken whole; an empty table gives no classes.  Ties go to the least (id, text hash), null ids last.  Repeated rows are one class.  Columns other than id and
text play no part, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, free_name, frugal, table
from .components import components

SHINGLE, BANDS, ROWS = 5, 32, 6
#: Links have at least 4 of 5 parts of their weight in common: a similarity of 0.8.
ALIKE, OF = 4, 5

_ODD = np.uint64(0x9E3779B97F4A7C15)
_POISSON = np.cumsum([math.exp(-1) / math.factorial(i) for i in range(18)])


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct 64-bit hashes of the runs of ``size`` words, and how often each occurs."""
    words = (text or "").encode().split()  # bytes split at the six ASCII white-space characters only
    if not words:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    h = pd.util.hash_array(np.array(words, dtype=object), categorize=False)
    n = max(len(h) - size + 1, 1)
    out = np.full(n, np.uint64(min(len(h), size)))
    for i in range(min(size, len(h))):
        out = _mixed(out * _ODD + h[i : i + n])
    return np.unique(out, return_counts=True)


def unit_cells(elements: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The regions of weighted elements cut into cells of one unit of weight, and the part of each cell that is filled.

    Cells are numbered along the weight of their element, so of whole weights two sets have as many
    cells in common as the sum of their lesser weights.
    """
    steps = np.ceil(weights).astype(np.int64)
    nth = np.arange(steps.sum()) - np.repeat(np.cumsum(steps) - steps, steps)
    cells = _mixed(np.repeat(elements, steps) + nth.astype(np.uint64) * _ODD)
    return cells, np.minimum(np.repeat(weights, steps) - nth, 1.0)


def signature(elements: np.ndarray, weights: np.ndarray, size: int = BANDS * ROWS) -> np.ndarray:
    """DartMinHash of a weighted set."""
    return darts(*unit_cells(elements, weights), size)


def darts(cells: np.ndarray, filled: np.ndarray | None = None, size: int = BANDS * ROWS) -> np.ndarray:
    """For each coordinate the hash of the earliest dart in the cells (``filled``: in parts of them).

    Each cell gets, for each whole step of rank, a Poisson number of darts, one on average, at places
    that its hash decides; darts above the filled part miss.  Steps are added until every coordinate
    has a dart.
    """
    value, rank = np.zeros(size, dtype=np.uint64), np.full(size, np.inf)
    first, last = 0, max(1, math.ceil(size * (math.log(size) + 2) / max(len(cells), 1)))
    while len(cells) and np.isinf(rank).any():
        at = np.arange(first, last, dtype=np.uint64)
        base = _mixed(cells[:, None] ^ _mixed(at * _ODD + np.uint64(1))[None, :]).ravel()
        n = np.searchsorted(_POISSON, (base >> np.uint64(11)) * 2.0**-53, side="right")
        cell = np.repeat(np.arange(len(base)), n)
        nth = np.arange(len(cell)) - np.repeat(np.cumsum(n) - n, n)
        dart = _mixed(base[cell] + (nth.astype(np.uint64) + np.uint64(1)) * _ODD)
        when = (cell % len(at)) + first + (dart >> np.uint64(11)) * 2.0**-53
        if filled is not None:
            hit = (_mixed(dart ^ _ODD) >> np.uint64(11)) * 2.0**-53 < filled[cell // len(at)]
            dart, when = dart[hit], when[hit]
        order = np.argsort(-when, kind="stable")
        dart, when = dart[order], when[order]
        where = ((_mixed(dart) >> np.uint64(40)) * np.uint64(size)) >> np.uint64(24)
        new = np.zeros(size, dtype=np.uint64)
        new[where] = dart  # of several darts the last one, the earliest, stays
        reached = np.zeros(size, dtype=bool)
        reached[where] = True
        reached &= np.isinf(rank)
        value[reached], rank[reached] = new[reached], 0
        first, last = last, 2 * last
    return value


def text_cells(text: str | None) -> np.ndarray:
    """Sorted cells of a text's shingles, as many of a shingle as it occurs; counts fill cells whole."""
    elements, counts = shingles(text)
    return np.sort(unit_cells(elements, counts)[0])


def bands(sig: np.ndarray, count: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """One 64-bit key for each band of the signature."""
    out = np.arange(1, count + 1, dtype=np.uint64)
    for i in range(rows):
        out = _mixed(out * _ODD + sig.reshape(count, rows)[:, i])
    return out.view(np.int64)


def _rows(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(F.col(f"`{doc_id}`").cast("long").alias("id"), F.xxhash64(F.col(f"`{text}`")).alias("h"), F.col(f"`{text}`").alias("text"))


def _sketch(rows: DataFrame) -> DataFrame:
    """id, h (text hash), node (digest of the cells, null without words), n (cells) and keys of each row."""
    import xxhash

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out, seen = [], {}
            for t in batch["text"]:
                s = text_cells(t)
                if not len(s):
                    out.append((None, 0, None))
                    continue
                node = xxhash.xxh3_128_digest(s.tobytes())
                if node not in seen:
                    seen[node] = (node, len(s), bands(darts(s)))
                out.append(seen[node])
            yield pd.concat([batch[["id", "h"]], pd.DataFrame(out, columns=["node", "n", "keys"], index=batch.index)], axis=1)

    return rows.mapInPandas(frugal(run), "id long, h long, node binary, n long, keys array<long>")


def _sets(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, s): the cells of the nodes of ``wanted`` (id, h), each from one row that has them."""
    import xxhash

    w = wanted.select(F.col("id").alias("_id"), F.col("h").alias("_h"))
    some = rows.join(w, F.col("id").eqNullSafe(F.col("_id")) & (F.col("h") == F.col("_h")), "left_semi").dropDuplicates(["id", "h"]).select("text")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [text_cells(t) for t in batch["text"]]
            yield pd.DataFrame({"node": [xxhash.xxh3_128_digest(s.tobytes()) for s in found], "s": [s.view(np.int64) for s in found]})

    return some.mapInPandas(frugal(run), "node binary, s array<long>")


def _of(sets: DataFrame, x: str) -> DataFrame:
    return sets.select(F.col("node").alias(x), F.col("s").alias(f"s{x}"))


def _alike(common, n, m):  # noqa: ANN001
    return OF * common >= ALIKE * (n + m - common)


def _close(n: str, m: str):  # noqa: ANN202
    """What the sizes alone leave possible."""
    return OF * F.least(n, m) >= ALIKE * F.greatest(n, m)


def _checked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b) that are links, by counting their cells."""
    both = pairs.select("a", "b").join(_of(sets, "a"), "a").join(_of(sets, "b"), "b")
    common = F.size(F.array_intersect("sa", "sb"))
    return both.filter(_alike(common, F.size("sa"), F.size("sb"))).select("a", "b")


def _stars(nodes: DataFrame, scratch: Scratch) -> DataFrame:
    """(a, b, n, m): nodes and the leaders of their buckets, with their sizes.

    A bucket's leader is its member with the most company over all its buckets: in a group of copies,
    one with few edits.
    """
    members = nodes.select(F.explode("keys").alias("key"), "node", "n")
    several = members.groupBy("key").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    with_company = members.join(several, "key").groupBy("node").agg(F.sum("size").alias("w"), F.first("n").alias("n"), F.collect_list("key").alias("keys"))
    members = scratch.keep(with_company).select(F.explode("keys").alias("key"), "node", "n", "w")
    leaders = members.groupBy("key").agg(F.max(F.struct("w", "node", "n")).alias("top"))
    led = members.join(leaders, "key").filter(F.col("node") != F.col("top.node"))
    return scratch.keep(led.select(F.col("node").alias("a"), F.col("top.node").alias("b"), "n", F.col("top.n").alias("m")).distinct())


def _apart(stars: DataFrame, labels: DataFrame, sets: DataFrame, scratch: Scratch) -> DataFrame:
    """Pairs (a, b) of nodes with one leader and of different components that may still be links.

    With D the cells in which a node differs from the leader, n its cells and S the cells of a pair:
    a pair differs in |Da| + |Db| - 2 |Da & Db| cells, and is a link if 9 times that is at most S.  So
    a link has 2 |Da & Db| >= ea + eb, where e = |D| - n / 9.  One of the two is no link of the leader
    (else they were of one component), which means e > m / 9 for the leader's m cells; for links of
    the leader e >= -m / 9.  As |Da & Db| <= |Db| too, |Da & Db| >= |Da| - n / 4 for a node's sizes.  From the least
    overlap t that this gives each node, the |D| - t + 1 rarest cells of D contain one that a link
    shares, and from its place on there are enough cells left in both.
    """
    label = lambda x: labels.select(F.col("node").alias(x), F.col("label").alias(f"l{x}"))
    led = stars.join(label("a"), "a", "left").withColumn("la", F.coalesce("la", "a"))
    mixed = led.groupBy("b").agg(F.min("la").alias("low"), F.max("la").alias("high")).filter("low < high").select("b")
    led = scratch.keep(led.join(mixed, "b", "left_semi").select("a", "b", "la", "n", "m"))
    apart = led.join(_of(sets, "a"), "a").join(_of(sets, "b"), "b")
    apart = apart.select("a", "b", "la", "n", "m", F.concat(F.array_except("sa", "sb"), F.array_except("sb", "sa")).alias("d"))
    cells = scratch.keep(apart).select("a", "b", "la", "n", "m", F.size("d").alias("d"), F.explode("d").alias("x"))
    # cells that one class alone has can be of no link between classes: they come first in the order, as those of no other node do
    often = cells.groupBy("b", "x").agg(F.count(F.lit(1)).alias("c"), F.min("la").alias("low"), F.max("la").alias("high")).filter("low < high").select("b", "x", "c")
    shared = cells.join(often, ["b", "x"]).groupBy("a", "b").agg(*[F.first(c).alias(c) for c in ("la", "n", "m", "d")], F.array_sort(F.collect_list(F.struct("c", "x"))).alias("xs"))
    e = 9 * F.col("d") - F.col("n")  # 9 e
    t = F.when(e > F.col("m"), F.greatest(2 * (e - F.col("m")), 36 * F.col("d") - 9 * F.col("n"))).otherwise(2 * (e + F.col("m")))
    least = F.greatest(F.ceil(t / 36), F.lit(1))  # t: 36 times the overlap
    alone = F.col("d") - F.size("xs")
    shared = shared.withColumn("alone", alone).withColumn("most", F.col("d") - least + 1 - alone).filter("most > 0")
    rarest = shared.select("a", "b", "la", "n", "d", F.posexplode(F.slice("xs", F.lit(1), F.col("most").cast("int"))).alias("at", "x"), "alone")
    rarest = scratch.keep(rarest.select("a", "b", "la", "n", "d", F.col("x.x").alias("x"), (F.col("d") - F.col("alone") - F.col("at")).alias("left")))
    met = _across(_possible(rarest), scratch)
    enough = 18 * F.least("left", "left_") >= 9 * (F.col("d") + F.col("d_")) - F.col("n") - F.col("n_")
    return met.filter(_close("n", "n_") & enough).select(F.least("a", "a_").alias("a"), F.greatest("a", "a_").alias("b")).distinct()


def _possible(rows: DataFrame) -> DataFrame:
    """The rows that some row of another class in their cell may be alike to, by what the pairs are later asked for.

    The classes of a cell say how many cells their rows have left at most, and how few common ones they ask for.
    """
    asks = 9 * F.col("d") - F.col("n")
    each = rows.groupBy("b", "x", "la").agg(F.max("left").alias("most"), F.min(asks).alias("least"))
    of = Window.partitionBy("b", "x").orderBy("la")  # one row a class
    sides = [of.rowsBetween(Window.unboundedPreceding, -1), of.rowsBetween(1, Window.unboundedFollowing)]
    others = each.select("b", "x", "la", F.greatest(*[F.max("most").over(w) for w in sides]).alias("most"), F.least(*[F.min("least").over(w) for w in sides]).alias("least"))
    return rows.join(others, ["b", "x", "la"]).filter(18 * F.least("left", "most") >= asks + F.col("least")).drop("most", "least")


def _across(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """Each pair of rows (b, x, la and others) of one cell (b, x) and different classes la once; the other row's columns end in _.

    The classes of a cell are numbered.  Two numbers first differ in one bit: there the row with 0 meets the
    row with 1, by the cell, the bit and the bits before it.  So a row is dealt out once a bit, and rows of one
    class never meet, however many there are.  Spark splits what is left of a hot cell.
    """
    classes = rows.select("b", "x", "la").distinct()
    of = Window.partitionBy("b", "x")  # one row a class
    numbered = classes.withColumn("number", F.row_number().over(of.orderBy("la")) - 1).withColumn("of", F.count(F.lit(1)).over(of)).filter("of > 1")
    bits = F.sequence(F.lit(0), F.floor(F.log2(F.col("of") - F.lit(0.5))).cast("int"))
    dealt = rows.join(numbered, ["b", "x", "la"]).withColumn("bit", F.explode(bits))
    dealt = scratch.keep(dealt.withColumn("before", F.expr("shiftright(number, bit + 1)")).withColumn("side", F.expr("shiftright(number, bit) & 1")).drop("number", "of"))
    key = ["b", "x", "bit", "before"]
    other = dealt.filter("side = 1").drop("side")
    other = other.select(*key, *[F.col(c).alias(f"{c}_") for c in other.columns if c not in key])
    return dealt.filter("side = 0").drop("side").join(other, key)


def classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a row of ``docs``: id, h (hash of its text), class_id and class_h, the least of its class."""
    scratch = Scratch(docs.sparkSession)
    rows = _rows(docs, doc_id, text)
    sketch = scratch.keep(_sketch(rows))
    least = F.min(F.struct(F.col("id").isNull().alias("last"), "id", "h")).alias("rep")
    nodes = scratch.keep(sketch.filter("node is not null").groupBy("node").agg(least, F.first("n").alias("n"), F.first("keys").alias("keys")))
    stars = _stars(nodes, scratch)
    wanted = stars.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    sets = scratch.keep(_sets(rows, nodes.select("node", "rep").join(wanted, "node", "left_semi").select("rep.id", "rep.h")))
    links = scratch.keep(_checked(stars.filter(_close("n", "m")), sets))
    labels = scratch.keep(components(links))
    more = scratch.keep(_checked(_apart(stars, labels, sets, scratch), sets))
    if not more.isEmpty():
        labels = scratch.keep(components(links.unionByName(more)))
    linked = labels.join(nodes.select("node", "rep"), "node")
    best = linked.groupBy("label").agg(F.min("rep").alias("best"))
    best = scratch.keep(linked.select("node", "label").join(best, "label").select("node", "best"))
    of_node = nodes.select("node", "rep").join(best, "node", "left").select("node", F.coalesce("best", "rep").alias("least"))
    out = sketch.select("id", "h", "node").join(of_node, "node", "left")
    of = lambda c: F.when(F.col("least").isNull(), F.col(c)).otherwise(F.col(f"least.{c}")).alias(f"class_{c}")
    result = Scratch(docs.sparkSession).keep(out.select("id", "h", of("id"), of("h")))
    scratch.drop()
    return result


def deduplicated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents that are the least of their class, one row each, with all columns."""
    i, h = free_name("_class_id", docs.columns), free_name("_class_h", docs.columns)
    keep = classes(docs, doc_id, text).select(F.col("class_id").alias("_i"), F.col("class_h").alias("_h")).distinct()
    keyed = docs.select(*[F.col(f"`{c}`") for c in docs.columns], F.col(f"`{doc_id}`").cast("long").alias(i), F.xxhash64(F.col(f"`{text}`")).alias(h)).alias("d")
    kept = keyed.join(keep.alias("k"), F.col(f"d.{i}").eqNullSafe(F.col("k._i")) & (F.col(f"d.{h}") == F.col("k._h")), "left_semi")
    return kept.dropDuplicates([i, h]).select(*[F.col(f"`{c}`") for c in docs.columns])


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return classes(docs).select(F.col("id").alias("doc_id"), "class_id", (F.col("id").eqNullSafe(F.col("class_id")) & (F.col("h") == F.col("class_h"))).alias("kept"))
