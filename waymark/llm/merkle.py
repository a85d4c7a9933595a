"""A Merkle manifest of a dataset: one tree a group, one tree over the groups' roots, and a proof for each row.

A leaf is the digest of a row.  In its group the leaves are in order; while several nodes remain, every
``arity`` consecutive ones become one.  What remains is the group's root; the groups' roots, in the order of
the groups, likewise give the root of all.

The nodes of a tree that are known but whose siblings are not all at hand are a sparse forest: nodes keyed by
level and place.  Two fragments of a forest merge by taking both, and a run of siblings becomes its parent as
soon as it is whole, which the number of leaves tells.  That is associative, so each task makes a fragment of
the rows it holds, and rounds of merges take ``FAN_IN`` neighbouring fragments at a time.  (An RDD's treeReduce
would merge distant fragments, which complete no run, and end on the driver; so the rounds are grouped merges
of neighbours, in which a fragment never holds more than two edges of its range.)  Runs that a merge completes are
kept as a table.  A row's path needs the runs within its task's range, which the task can make again, and those
at the range's edges, at most two a level, which are joined from that table.

Leaves take the place that a distributed sort of (group, order, leaf) gives them, so a large group lies in many
tasks.  Only digests, the order and the columns to be kept are moved.  Null groups come first, as do null order
values.  Ties in the order go by the leaf; equal rows are leaves beside each other.  Any null value is a leaf's
``-``; empty and very long texts are hashed whole.  An empty table gives an empty manifest.  Columns that are
kept stay in a struct beside the operator's own, but for those named as a result, which are replaced.
"""

from __future__ import annotations

import hashlib
import string
from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import groupby

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, table, unpacked

ARITY, FAN_IN = 16, 16
#: Leaves of one task: where there are few, where there are many.
FEWEST, MOST = 5_000, 100_000
#: A group's name for sorting and joining: null below every string.
_NULL, _NAMED = "", "="

Nodes = dict[tuple[int, int], bytes]  # (level, place): digest
Path = list[tuple[bytes, int]]  # run by run to the root: the members, and the place of one's own


def parent(members: bytes) -> bytes:
    """The digest of digests end to end, each taken as lowercase hex text."""
    return hashlib.sha256(members.hex().encode()).digest()


def size_of(n: int, level: int, arity: int = ARITY) -> int:
    """Nodes on a level of a tree with n leaves."""
    for _ in range(level):
        n = -(-n // arity)
    return n


def whole(n: int, run: int, arity: int = ARITY) -> int:
    """Members of a run of siblings among n nodes."""
    return min(arity, n - run * arity)


def resolve(nodes: Nodes, n: int, arity: int = ARITY) -> tuple[Nodes, dict[tuple[int, int], bytes]]:
    """Turn whole runs of siblings into their parents, level by level: what is left, and the runs (level, run) with their members."""
    left, runs, rising = {}, {}, defaultdict(dict)
    for (level, at), digest in nodes.items():
        rising[level][at] = digest
    level = min(rising, default=0)
    size = size_of(n, level, arity)
    while rising:
        here = rising.pop(level, {})
        by_run = defaultdict(list)
        for at in sorted(here):
            by_run[at // arity].append(at)
        for run, at in by_run.items():
            if size > 1 and len(at) == whole(size, run, arity):
                runs[level, run] = members = b"".join([here[i] for i in at])
                rising[level + 1][run] = parent(members)
            else:
                left |= {(level, i): here[i] for i in at}
        level, size = level + 1, -(-size // arity)
    return left, runs


def paths(leaves: list[bytes], first: int, n: int, edges: Nodes, arity: int = ARITY) -> Iterator[Path]:
    """For each leaf the runs on its way to the root.

    The leaves are those from ``first`` on; ``edges`` has the runs that they alone do not make up.
    """
    runs = resolve({(0, first + i): d for i, d in enumerate(leaves)}, n, arity)[1] | edges
    levels = 0
    while size_of(n, levels, arity) > 1:
        levels += 1
    above: Path = []
    for i in range(first, first + len(leaves)):
        if i == first or i % arity == 0:  # the way from the parent on is the same for a run
            above, at = [], i // arity
            for level in range(1, levels):
                above.append((runs[level, at // arity], at % arity))
                at //= arity
        yield [(runs[0, i // arity], i % arity), *above] if levels else []


def siblings(path: Path) -> bytes:
    """The other members of each run of a path, in order."""
    return b"".join([members[: 32 * at] + members[32 * at + 32 :] for members, at in path])


def folded(leaf: bytes, path: Path) -> bytes:
    """The root that a leaf and the siblings on its path give."""
    for members, at in path:
        leaf = parent(members[: 32 * at] + leaf + members[32 * at + 32 :])
    return leaf


def verified(leaf: bytes, proof: bytes, shape: list[tuple[int, int]], root: bytes) -> bool:
    """True if a leaf and its proof give the root; ``shape`` has the members of each run of the path and the leaf's place."""
    path, begin = [], 0
    for members, at in shape:
        own = proof[begin : begin + 32 * (members - 1)]
        begin += len(own)
        path.append((own[: 32 * at] + bytes(32) + own[32 * at :], at))
    return begin == len(proof) and folded(leaf, path) == root


def _in_order(rows: pa.Table) -> pa.Table:
    return rows.take(pc.sort_indices(rows, [("nth", "ascending")]))


def _by_source(rows: pa.Table, ranges: pa.Table) -> Iterator[tuple[dict, int, int]]:
    """What is known of each source among the sorted rows, and where its rows begin and end."""
    known, begin = {r["source"]: r for r in ranges.to_pylist()}, 0
    for source, own in groupby(rows["source"].to_pylist()):
        end = begin + sum(1 for _ in own)
        yield known[source], begin, end
        begin = end


def _nodes(part: int, source: str, n: int, left: Nodes, arity: int) -> Iterator[tuple]:
    for (level, at), digest in left.items():
        yield part, source, n, level, at, digest, "root" if size_of(n, level, arity) == 1 else "node"


_NODES = "part int, source string, n long, level int, at long, digest binary, kind string"
_ARROW = pa.schema([("part", pa.int32()), ("source", pa.string()), ("n", pa.int64()), ("level", pa.int32()), ("at", pa.int64()), ("digest", pa.binary()), ("kind", pa.string())])


def _as_table(rows: list[tuple]) -> pa.Table:
    return pa.table([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(_ARROW)], schema=_ARROW)


class _Forest:
    """Trees over the rows (row, source, place, leaf, claimed): numbered leaves, runs that cross tasks, and roots."""

    def __init__(self, rows: DataFrame, scratch: Scratch, arity: int):
        self.arity, self.keep = arity, scratch.keep
        light = self.keep(rows)
        n = light.count()
        usual = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        parts = max(1, min(-(-n // FEWEST), max(usual, -(-n // MOST))))
        order = ["source", "place", "leaf", "tie"]
        dealt = light.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(parts, *order).sortWithinPartitions(*order)
        self.rows = self.keep(dealt.select("row", "source", "leaf", "claimed", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("nth")))
        counted = self.keep(self.rows.groupBy("part", "source").agg(F.count(F.lit(1)).alias("here")))
        of = Window.partitionBy("source")  # one row a task that has leaves of the source
        before = F.sum("here").over(of.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
        self.ranges = self.keep(counted.select("part", "source", "here", F.coalesce(before, F.lit(0)).alias("first"), F.sum("here").over(of).alias("n")))
        self.runs, self.roots = self._merged()

    def _fragments(self) -> DataFrame:
        """What each task's leaves make up: the nodes whose siblings it does not have, and roots."""
        arity = self.arity

        def fragment(rows: pa.Table, ranges: pa.Table) -> pa.Table:
            rows, out = _in_order(rows), []
            leaves, part = rows["leaf"].to_pylist(), rows["part"][0].as_py()
            for r, begin, end in _by_source(rows, ranges):
                left, _ = resolve({(0, r["first"] + i): d for i, d in enumerate(leaves[begin:end])}, r["n"], arity)
                out += _nodes(part, r["source"], r["n"], left, arity)
            return _as_table(out)

        return self.rows.select("part", "source", "nth", "leaf").groupBy("part").cogroup(self.ranges.groupBy("part")).applyInArrow(fragment, _NODES)

    def _merged(self) -> tuple[DataFrame, DataFrame]:
        """Rounds of merges until one fragment is left: the runs that they complete, and the roots."""
        arity = self.arity

        def merge(nodes: pa.Table) -> pa.Table:
            by_source, out = defaultdict(dict), []
            for r in nodes.to_pylist():
                by_source[r["source"], r["n"]][r["level"], r["at"]] = r["digest"]
            part = nodes["part"][0].as_py() // FAN_IN
            for (source, n), own in by_source.items():
                left, runs = resolve(own, n, arity)
                out += _nodes(part, source, n, left, arity)
                out += [(part, source, n, level, run, members, "run") for (level, run), members in runs.items()]
            return _as_table(out)

        rounds = [self.keep(self._fragments())]
        parts = (self.ranges.agg(F.max("part")).first()[0] or 0) + 1
        while parts > 1:
            parts = -(-parts // FAN_IN)
            left = rounds[-1].filter("kind = 'node'")
            rounds.append(self.keep(left.groupBy(F.expr(f"part div {FAN_IN}")).applyInArrow(merge, _NODES)))
        made = rounds[0]
        for r in rounds[1:]:
            made = made.unionByName(r)
        runs = made.filter("kind = 'run'").select("source", "level", F.col("at").alias("run"), F.col("digest").alias("members"))
        return runs, made.filter("kind = 'root'").select("source", "digest")

    def proved(self, result: Callable[[pa.Table, list[Path], dict], pa.Table], schema: str | T.StructType, above: DataFrame | None = None) -> DataFrame:
        """``result`` of each task's rows of a source, their paths, and what ``above`` has of the source."""
        arity = self.arity
        spans = F.array(*[F.lit(arity**i) for i in range(64) if arity ** (i + 1) < 2**62])  # leaves under a node, level by level
        edge = self.ranges.select("part", "source", "first", "here", F.posexplode(F.filter(spans, lambda x: x < F.col("n"))).alias("level", "span"))
        ends = F.array(F.expr("`first` div (span * %d)" % arity), F.expr("(`first` + here - 1) div (span * %d)" % arity))
        edge = edge.select("part", "source", "level", F.explode(F.array_distinct(ends)).alias("run")).join(self.runs, ["source", "level", "run"])
        edges = edge.groupBy("part", "source").agg(F.collect_list(F.struct("level", "run", "members")).alias("edges"))  # two a level at most
        known = self.ranges.join(edges, ["part", "source"], "left")
        if above is not None:
            known = known.join(above, "source")

        def prove(rows: pa.Table, ranges: pa.Table) -> pa.Table:
            rows, out = _in_order(rows), []
            for r, begin, end in _by_source(rows, ranges):
                own = rows.slice(begin, end - begin)
                known = {(e["level"], e["run"]): e["members"] for e in r["edges"] or ()}
                out.append(result(own, paths(own["leaf"].to_pylist(), r["first"], r["n"], known, arity), r))
            return pa.concat_tables(out)

        return self.rows.groupBy("part").cogroup(known.groupBy("part")).applyInArrow(prove, schema)


def leaf(columns: list[Column]) -> Column:
    """Digest (binary) of a row's values: each ``-`` if null, else its length in UTF-8 bytes, a colon and itself."""
    value = lambda c: F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-"))
    return F.unhex(F.sha2(F.concat(*map(value, columns)), 256))


_WAYS = pa.list_(pa.struct([("members", pa.binary()), ("at", pa.int32())]))


def manifest(docs: DataFrame, columns: list[str], group: str = "source", order: str = "doc_id", keep: list[str] | None = None, claimed: Column | None = None, arity: int = ARITY, proofs: bool = True) -> DataFrame:
    """The columns ``keep`` (order and group, if not given) with leaf, subroot, root, proof and folded_root, all binary.

    A proof is the siblings' digests end to end; without ``proofs`` it is the SHA-256 of their hex text.
    ``claimed``, if given and not null, is the leaf to be folded instead of the row's own: the root that
    this gives differs from ``root`` if the row that it was made of does.
    """
    names = ("leaf", "subroot", "root", "proof", "folded_root")
    keep = [c for c in keep or dict.fromkeys([order, group]) if c.lower() not in names]
    row = F.struct(F.lit(True).alias("_"), *[F.col(f"`{c}`") for c in keep]).alias("row")
    by = F.col(f"`{group}`")
    source = F.when(by.isNull(), F.lit(_NULL)).otherwise(F.concat(F.lit(_NAMED), by.cast("string")))
    none = F.lit(None).cast("binary").alias("claimed")
    own = leaf([F.col(f"`{c}`") for c in columns]).alias("leaf")
    rows = docs.select(row, source.alias("source"), F.col(f"`{order}`").alias("place"), own, none if claimed is None else claimed.alias("claimed"))
    scratch = Scratch(docs.sparkSession)
    trees = _Forest(rows, scratch, arity)
    top = _Forest(trees.roots.select(F.col("source").alias("row"), F.lit(_NULL).alias("source"), F.col("source").alias("place"), F.col("digest").alias("leaf"), none), scratch, arity)
    found = top.roots.first()  # one digest
    root = found.digest if found else None

    def listed(rows: pa.Table, ways: Iterator[Path], _: dict) -> pa.Table:
        steps = [[{"members": m, "at": at} for m, at in way] for way in ways]
        return pa.table([rows["row"], rows["leaf"], pa.array(steps, _WAYS)], names=["source", "subroot", "above"])

    above = top.proved(listed, "source string, subroot binary, above array<struct<members:binary,at:int>>")
    schema = T.StructType([trees.rows.schema["row"], *[T.StructField(n, T.BinaryType()) for n in names]])

    def result(rows: pa.Table, each: Iterator[Path], of: dict) -> pa.Table:
        way, proof, ends = [(s["members"], s["at"]) for s in of["above"]], [], []
        for digest, claim, path in zip(rows["leaf"].to_pylist(), rows["claimed"].to_pylist(), each, strict=True):
            path += way
            others = siblings(path)
            proof.append(others if proofs else parent(others))
            ends.append(folded(digest if claim is None else claim, path))
        same = lambda x: pa.array([x] * len(rows), pa.binary())
        return pa.table([rows["row"], rows["leaf"], same(of["subroot"]), same(root), pa.array(proof, pa.binary()), pa.array(ends, pa.binary())], names=["row", *names])

    return trees.proved(result, schema, scratch.keep(above)).select(*unpacked(keep), *names)


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["doc_id", "source", "lang", "n_chars", "text"]
    lowered = F.translate("text", string.ascii_uppercase, string.ascii_lowercase)
    tampered = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0
    claimed = F.when(tampered, leaf([*map(F.col, columns[:-1]), lowered]))
    proved = manifest(table(spark, sf_dir, "documents"), columns, keep=["doc_id"], claimed=claimed, proofs=False)
    hex_of = lambda c, name=None: F.lower(F.hex(c)).alias(name or c)
    return proved.select("doc_id", *map(hex_of, ("leaf", "subroot", "root")), hex_of("proof", "proof_sha256"), hex_of("folded_root"), (F.col("folded_root") == F.col("root")).alias("verified"))


_ENCODED = lambda text: "sha256(" + " || ".join(f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')" for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"
_CRC32 = """xor(4294967295, list_reduce(flatten(list_transform(range(1, length(doc_id::VARCHAR) + 1), lambda i: [unicode(substr(doc_id::VARCHAR, i, 1))::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1])),
  lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, 3988292384 * (c & 1)) END, 4294967295::BIGINT))"""


def _tree_sql(name: str, leaves: str) -> str:
    """Nodes of the trees of ``leaves`` (g, i, h, n) level by level, and their runs of siblings."""
    return f"""{name} AS (SELECT g, 0 AS level, i, h, n FROM {leaves}
  UNION ALL SELECT g, level + 1, i // {ARITY}, sha256(string_agg(h, '' ORDER BY i)), (any_value(n) + {ARITY - 1}) // {ARITY} FROM {name} WHERE n > 1 GROUP BY g, level, i // {ARITY}),
{name}_runs AS (SELECT g, level, i // {ARITY} AS run, list(h ORDER BY i) AS hs FROM {name} WHERE n > 1 GROUP BY ALL),
{name}_steps AS (SELECT l.g, l.i, r.level, [array_to_string(r.hs[:pos], ''), array_to_string(r.hs[pos + 2:], '')] AS step
  FROM (SELECT g, i, level, (i // power({ARITY}, level + 1)::BIGINT) AS run, (i // power({ARITY}, level)::BIGINT) % {ARITY} AS pos FROM {leaves}, range(12) v(level)) l JOIN {name}_runs r USING (g, level, run)),
{name}_ways AS (SELECT g, i, list(step ORDER BY level) AS steps FROM {name}_steps GROUP BY ALL)"""


OP11_SQL = f"""WITH RECURSIVE d AS (SELECT doc_id, coalesce('=' || source, '') AS g, {_ENCODED('text')} AS leaf, {_ENCODED(f"translate(text, '{string.ascii_uppercase}', '{string.ascii_lowercase}')")} AS lowered, coalesce({_CRC32} % 5 = 0, false) AS tampered FROM documents),
l AS (SELECT *, leaf AS h, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY g) AS n FROM d),
{_tree_sql('t', 'l')},
s AS (SELECT '' AS g, g AS of, h, row_number() OVER (ORDER BY g) - 1 AS i, count(*) OVER () AS n FROM t WHERE n = 1),
{_tree_sql('u', 's')},
p AS (SELECT l.doc_id, l.leaf, s.h AS subroot, (SELECT h FROM u WHERE n = 1) AS root, CASE WHEN l.tampered THEN l.lowered ELSE l.leaf END AS claimed, list_concat(coalesce(a.steps, []), coalesce(b.steps, [])) AS steps
  FROM l JOIN s ON s.of = l.g LEFT JOIN t_ways a ON a.g = l.g AND a.i = l.i LEFT JOIN u_ways b ON b.i = s.i),
f AS (SELECT *, list_reduce(steps, lambda acc, x: [sha256(x[1] || acc[1] || x[2])], [claimed])[1] AS folded_root FROM p)
SELECT doc_id, leaf, subroot, root, sha256(array_to_string(flatten(steps), '')) AS proof_sha256, folded_root, folded_root = root AS verified FROM f"""
