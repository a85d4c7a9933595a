"""Order MinHash fingerprints, in DataFrame functions alone.

A text's k-mers (of words; of characters where it has fewer than k words) are numbered by their
occurrence, so that repeats are distinct, and hashed.  The hashes lie on a ring.  Each of the
fingerprint's entries starts from a fixed point of the ring and selects the ``l`` hashes that follow:
the minimal ones in the order that begins there.  Their k-mers, put back into the order of the text,
are hashed to the entry.  Two texts agree in an entry if they select the same k-mers in the same
order, so the share of equal entries falls with the edit distance, not only with the set overlap.

A text without words or characters (null counts as empty) has the fingerprint of zeros; two such
texts are fully alike.  Equal texts have equal fingerprints, however long.  Repeated ids are ordered
by their texts' hashes, null ids come last.  Other columns are kept, whatever their names, except
those named as a result, which are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, packed, table, unpacked

K, L, ENTRIES = 3, 2, 32
#: Rows that are ordered together, and the most such blocks (their table is broadcast); sampled ids for each cut between blocks.
BLOCK_ROWS, MOST_BLOCKS, PER_CUT = 1024, 65_536, 64
#: Bits of a place in a text; longer texts take as many as their places need.
PLACE_BITS = 24
_HIGH = ~((1 << PLACE_BITS) - 1)
_TOP = ~((1 << 32) - 1)


def _range(n: Column) -> Column:
    """0 .. n - 1, empty for n = 0."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def _points(entries: int) -> list[int]:
    """Where the entries start on the ring of signed 64-bit numbers."""
    return [-(1 << 63) + (j * ((1 << 64) // entries) & _HIGH) for j in range(entries)]


def add_signature(df: DataFrame, text: str, into: str, k: int = K, l: int = L, entries: int = ENTRIES) -> DataFrame:  # noqa: E741
    """Add the ``entries`` 32-bit numbers of the fingerprint of ``text`` as the array ``into``.

    Every step is a column of its own that later steps read more than once: so the optimizer keeps
    the steps apart, and an array is made once and not once an element.
    """
    kept = [c for c in df.columns if c.lower() != into.lower() or c == text]
    df = packed(df, F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("t"))
    content = F.col("t")
    df = df.select("row", "t", F.regexp_extract_all(content, F.lit(WORD), F.lit(0)).alias("u"))
    u = F.col("u")
    df = df.select("row", F.when(F.size(u) >= k, u).when(content == "", F.array().cast("array<string>")).otherwise(F.split(content, "")).alias("u"))
    n = F.when(F.size(u) > 0, F.greatest(F.size(u) - k + 1, F.lit(1))).otherwise(F.lit(0))
    df = df.select("row", "u", n.alias("n"))
    df = df.select("row", "u", "n", (F.expr(f"shiftleft(1L, greatest({PLACE_BITS}, length(bin(cast(n as bigint)))))") - 1).alias("low"))
    low = F.col("low")
    high = F.bitwise_not(low)
    # k-mer hashes, with the place in the text in their low bits, sorted
    kmer = lambda i: F.xxhash64(*[F.get(u, i + d) for d in range(k)])
    df = df.select("row", "low", F.sort_array(F.transform(_range(F.col("n")), lambda i: kmer(i).bitwiseAND(high).bitwiseOR(i.cast("long")))).alias("p"))
    p = F.col("p")
    # where a run of equal k-mers begins
    new = lambda i: (i == 0) | (F.get(p, i).bitwiseXOR(F.get(p, i - 1)).bitwiseAND(high) != 0)
    df = df.select("row", "low", "p", F.filter(_range(F.size(p)), new).alias("s"))
    s = F.col("s")
    # the second and later occurrences get hashes of their own
    numbered = lambda j, first: F.when(j == first, F.get(p, j)).otherwise(
        F.xxhash64(F.get(p, j).bitwiseAND(F.lit(_TOP)), j - first).bitwiseAND(high).bitwiseOR(F.get(p, j).bitwiseAND(low))
    )
    run = lambda first, r: F.transform(F.sequence(first, F.coalesce(F.get(s, r + 1), F.size(p)) - 1), lambda j: numbered(j, first))
    df = df.select("row", "low", F.when(F.size(s) == F.size(p), p).otherwise(F.sort_array(F.flatten(F.transform(s, run)))).alias("q"))
    q = F.col("q")
    points = F.array(*[F.lit(x) for x in _points(entries)])
    df = df.select("row", "low", "q", F.sort_array(F.concat(q, points)).alias("a"))
    a = F.col("a")
    # hashes before each point: its place among the hashes and points, less the points before it
    df = df.select("row", "low", "q", F.when(F.size(a) > entries, F.transform(points, lambda x, j: (F.array_position(a, x) - 1 - j).cast("int"))).alias("i"))
    m = F.size(q)
    by_place = lambda x: F.shiftleft(x.bitwiseAND(low), 31).bitwiseOR(F.shiftrightunsigned(x, 33))
    chosen = lambda i: F.sort_array(F.transform(_range(F.least(m, F.lit(l))), lambda t: by_place(F.get(q, F.pmod(i + t, m)))))
    entry = lambda i: F.shiftright(F.xxhash64(F.transform(chosen(i), lambda x: x.bitwiseAND(F.lit((1 << 31) - 1)))), 32).cast("int")
    none = F.array_repeat(F.lit(0), entries)
    signature = F.when(F.col("i").isNull() | (m == 0), none).otherwise(F.transform(F.col("i"), entry))
    return df.select(*unpacked([c for c in kept if c != into]), signature.alias(into))


def as_text(signature: str) -> Column:
    """The fingerprint as eight lowercase hexadecimal digits an entry."""
    return F.array_join(F.transform(F.col(signature), lambda x: F.lpad(F.lower(F.hex(x.cast("long").bitwiseAND(F.lit(0xFFFFFFFF)))), 8, "0")), "")


def likeness(a: str, b: str, entries: int = ENTRIES) -> Column:
    """Share of equal entries, from 0 to 1."""
    return F.aggregate(F.zip_with(F.col(a), F.col(b), lambda x, y: (x == y).cast("int")), F.lit(0), lambda n, x: n + x) / F.lit(float(entries))


def _cuts(df: DataFrame, doc_id: str) -> tuple[list[int], dict[int, int]]:
    """Ids at which blocks begin, ascending, and of ids that fill several blocks how many.

    They are quantiles of a sample of ids, so that any distribution is dealt evenly.  Cuts decide which
    task orders which rows; no result depends on them.
    """
    key = F.col(f"`{doc_id}`").cast("double")
    n = df.count()
    blocks = max(1, min(MOST_BLOCKS, n // BLOCK_ROWS))
    if blocks == 1:
        return [], {}
    some = df.select(key.alias("id")).filter("id is not null")
    if n > 2 * blocks * PER_CUT:
        some = some.sample(blocks * PER_CUT / n, seed=5)
    found = some.approxQuantile("id", [i / blocks for i in range(1, blocks)], 1 / (4 * blocks))
    times: dict[int, int] = {}
    for c in found:
        times[int(c)] = times.get(int(c), 0) + 1
    return sorted(times), {c: k for c, k in times.items() if k > 1}


def _place(sorted_: list[int], x: Column, width: int = 256) -> Column:
    """How many of the sorted numbers are at most ``x``: by the first of each ``width`` of them, then among those."""
    parts = [sorted_[i : i + width] for i in range(0, len(sorted_), width)]
    longs = lambda xs: F.array(*[F.lit(c).cast("long") for c in xs]) if xs else F.array().cast("array<bigint>")
    up_to = lambda xs: F.size(F.filter(xs, lambda c: c <= x))
    if len(parts) <= 1:
        return up_to(longs(sorted_))
    part = up_to(longs([p[0] for p in parts])) - 1
    return F.when(part < 0, 0).otherwise(part * width + up_to(F.get(F.array(*[longs(p) for p in parts]), part)))


def with_next(df: DataFrame, doc_id: str, text: str, *columns: str) -> DataFrame:
    """Add ``next_<column>``: the value in the next row by descending id; after the last comes the first.

    Rows of one id are ordered by the hash of ``text``, null ids come last.  Rows are dealt into blocks at
    sampled ids (those of a frequent id, and those without one, by their text's hash) and ordered within;
    the first row of each block also goes to the block before it.
    """
    key, h = F.col(f"`{doc_id}`").cast("long"), F.xxhash64(F.col(f"`{text}`"))
    cuts, hot = _cuts(df, doc_id)
    share = lambda parts: F.least(F.floor((F.col("h") / F.lit(2.0**64) + 0.5) * parts), parts - 1)
    several = F.create_map(*[x for c, k in hot.items() for x in (F.lit(c).cast("long"), F.lit(k))]) if hot else F.create_map().cast("map<bigint,int>")
    within = F.coalesce(share(F.try_element_at(several, F.col("id")).cast("long")) + 1, F.lit(0))
    # blocks in the order of descending ids, those of null ids last
    number = (len(cuts) - _place(cuts, F.col("id"))).cast("long") * (1 << 20) + within
    block = F.when(F.col("id").isNull(), F.lit((len(cuts) + 1) << 20) + share(F.lit(len(cuts) + 1))).otherwise(number)
    rows = packed(df, key.alias("id"), h.alias("h"), *[F.col(f"`{c}`").alias(f"v{i}") for i, c in enumerate(columns)]).withColumn("b", block.cast("long"))
    firsts = rows.groupBy("b").agg(F.max(F.struct("id", F.bitwise_not("h").alias("down"))).alias("first"))
    by_block, everything = Window.orderBy("b"), Window.partitionBy(F.lit(0))
    firsts = firsts.select(F.col("first.id").alias("_id"), F.bitwise_not("first.down").alias("_h"), F.col("b").alias("_b"), F.coalesce(F.lag("b").over(by_block), F.max("b").over(everything)).alias("before"))
    met = (F.col("b") == F.col("_b")) & F.col("id").eqNullSafe(F.col("_id")) & (F.col("h") == F.col("_h"))
    rows = rows.join(F.broadcast(firsts), met, "left")  # one row a block
    here, before = F.struct(F.col("b").alias("b"), F.lit(0).alias("guest")), F.struct(F.col("before").alias("b"), F.lit(1).alias("guest"))
    rows = rows.select("row", "id", "h", *[f"v{i}" for i in range(len(columns))], F.explode(F.when(F.col("before").isNull(), F.array(here)).otherwise(F.array(here, before))).alias("at"))
    order = Window.partitionBy("at.b").orderBy(F.col("at.guest"), F.col("id").desc_nulls_last(), "h")
    rows = rows.withColumns({f"n{i}": F.lead(f"v{i}").over(order) for i in range(len(columns))}).filter("at.guest = 0")
    names = [f"next_{c}" for c in columns]
    return rows.select(*unpacked([c for c in df.columns if c not in names]), *[F.col(f"n{i}").alias(n) for i, n in enumerate(names)])


def op4_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = with_next(add_signature(docs, "text", "sig"), "doc_id", "text", "text", "sig")
    n = F.length("text")
    third = F.floor(n / 3).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - third), F.substring(F.col("next_text"), F.lit(1), third))
    rows = rows.select("doc_id", n.cast("long").alias("n_chars"), "sig", "next_sig", edited.alias("edited"))
    rows = add_signature(rows, "edited", "edited_sig")
    return rows.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), as_text("sig").alias("fingerprint"), as_text("edited_sig").alias("edited_fingerprint"),
        likeness("sig", "edited_sig").alias("near_edited"), likeness("sig", "next_sig").alias("near_next"),
    )
