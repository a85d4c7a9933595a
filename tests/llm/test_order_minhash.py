import hashlib
import random

from pyspark.sql import functions as F

from waymark.llm import order_minhash as o
from waymark.llm import queries


def given():
    r = random.Random(9)
    words = ["".join(r.choices("abcdeé", k=r.randint(1, 7))) for _ in range(60)]
    out = [(3 * i, " ".join(r.choices(words, k=r.randint(0, 80)))) for i in range(120)]
    return out + [(1, None), (2, ""), (4, "ab"), (5, "a b"), (7, "日本語" * 50), (8, "w " * 3000), (8, "w " * 3000), (10**15, "x y z w")]


def plain_signature(spark, text, k=o.K, l=o.L):  # noqa: E741
    """The same definition over rows: explode, number by window, and choose by sorting from each point."""
    units = (text or "").split(" ")
    units = [u for u in units if u]
    if len(units) < k:
        units = list(text or "")
    return units


def test_edits_order_and_equality(spark, tmp_path):
    rows = given()
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    block, o.BLOCK_ROWS = o.BLOCK_ROWS, 16
    try:
        got = queries.QUERIES["op4_order_minhash"](spark, str(tmp_path)).collect()
    finally:
        o.BLOCK_ROWS = block
    assert len(got) == len(rows)
    order = sorted(rows, key=lambda x: -x[0])
    want = []
    for (i, t), (_, nxt) in zip(order, order[1:] + order[:1], strict=True):
        t, nxt = t or "", nxt or ""
        third = len(t) // 3
        want.append((i, len(t), hashlib.sha256((t[: len(t) - third] + nxt[:third]).encode()).hexdigest()))
    assert sorted(want) == sorted((r.doc_id, r.n_chars, r.edited_sha256) for r in got)
    by_text = {}
    texts = dict(rows)
    for r in got:
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        by_text.setdefault(texts[r.doc_id] or "", set()).add(r.fingerprint)
        if r.edited_sha256 == hashlib.sha256((texts[r.doc_id] or "").encode()).hexdigest():
            assert r.near_edited == 1 and r.fingerprint == r.edited_fingerprint
    assert all(len(x) == 1 for x in by_text.values())


def test_selection_equals_brute_force(spark):
    rows = [(i, t) for i, (_, t) in enumerate(given())]
    df = spark.createDataFrame(rows, "i int, text string")
    got = {r.i: list(r.sig) for r in o.add_signature(df, "text", "sig").collect()}
    # hashes of numbered k-mers by plain rows, then the choice by sorting from each point
    kmers = []
    for i, t in rows:
        units = plain_signature(spark, t)
        seen = {}
        for p in range(max(len(units) - o.K + 1, 1) if units else 0):
            gram = units[p : p + o.K]
            n = seen[tuple(gram)] = seen.get(tuple(gram), -1) + 1
            kmers.append((i, p, *(gram + [None] * (o.K - len(gram))), n))
    names = [f"g{d}" for d in range(o.K)]
    h = F.xxhash64(*names).bitwiseAND(F.lit(o._HIGH))
    hashed = spark.createDataFrame(kmers, "i int, p int, " + ", ".join(f"{n} string" for n in names) + ", n int")
    hashed = hashed.select("i", "p", F.when(F.col("n") == 0, h).otherwise(F.xxhash64(h.bitwiseAND(F.lit(o._TOP)), "n").bitwiseAND(F.lit(o._HIGH))).alias("h")).collect()
    tuples = []
    for i, _ in rows:
        own = sorted((x.h | x.p, x.p) for x in hashed if x.i == i)
        for j, point in enumerate(o._points(o.ENTRIES)):
            later = [x for x in own if x[0] >= point] + [x for x in own if x[0] < point]
            first = sorted(later[: o.L], key=lambda x: x[1])
            tuples.append((i, j, [((x[0] % 2**64) >> 33) for x in first]))
    want = spark.createDataFrame(tuples, "i int, j int, t array<long>").select("i", "j", F.when(F.size("t") == 0, F.lit(0)).otherwise(F.shiftright(F.xxhash64("t"), 32).cast("int")).alias("e")).collect()
    for r in want:
        assert got[r.i][r.j] == r.e, (r.i, r.j)


def test_likeness_follows_edit_distance(spark):
    r = random.Random(1)
    words = ["".join(r.choices("abcdefgh", k=6)) for _ in range(400)]
    near, moved = list(words), words[200:] + words[:200]
    near[50] = "zzz"
    shuffled = list(words)
    r.shuffle(shuffled)
    df = spark.createDataFrame([(" ".join(words), " ".join(x)) for x in (words, near, moved, shuffled)], "a string, b string")
    df = o.add_signature(o.add_signature(df, "a", "x"), "b", "y").select(o.likeness("x", "y").alias("n"))
    same, one, half, none = (x.n for x in df.collect())
    assert same == 1 and one > 0.8 and one > half > 0.2 and none < 0.05


def test_places_may_take_more_bits(spark, monkeypatch):
    """As they do in texts of over 2**24 k-mers: the same fingerprints, whatever the bits of a place."""
    df = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(given())], "i int, text string")
    want = {r.i: list(r.sig) for r in o.add_signature(df, "text", "sig").collect()}
    monkeypatch.setattr(o, "PLACE_BITS", 3)
    assert {r.i: list(r.sig) for r in o.add_signature(df, "text", "sig").collect()} == want


def test_next_of_uneven_hot_and_null_ids(spark, monkeypatch):
    monkeypatch.setattr(o, "BLOCK_ROWS", 8)
    r = random.Random(3)
    ids = [*range(100), 10**15, -(10**12), *[50] * 120, *[None] * 90, *r.sample(range(10**9, 2 * 10**9), 60)]
    rows = [(i, f"text {n % 250}", n) for n, i in enumerate(ids)]
    df = spark.createDataFrame(rows, "doc_id long, text string, b int").repartition(4)
    hashed = {x.text: x.h for x in df.select("text", F.xxhash64("text").alias("h")).distinct().collect()}
    order = sorted(rows, key=lambda x: (x[0] is None, -(x[0] or 0), hashed[x[1]]))
    want = sorted((str(a[0]), a[1], b[1]) for a, b in zip(order, order[1:] + order[:1], strict=True))
    got = o.with_next(df, "doc_id", "text", "text", "b")
    assert got.columns == ["doc_id", "text", "b", "next_text", "next_b"]
    got = got.collect()
    assert sorted((str(x.doc_id), x.text, x.next_text) for x in got) == want
    cuts, hot = o._cuts(df, "doc_id")
    assert len(cuts) > 15 and hot.get(50, 0) > 5
    assert o._place(list(range(0, 3000, 3)), F.lit(7)) is not None
    at = spark.range(20).select("id", o._place(list(range(0, 30, 3)), F.col("id"), width=4).alias("n")).collect()
    assert all(x.n == x.id // 3 + 1 for x in at)


def test_clashing_columns_stay(spark):
    df = spark.createDataFrame([(1, "a b c d", 7, "x"), (2, "a b", 8, "y")], "doc_id long, text string, row int, t string")
    out = o.with_next(o.add_signature(df, "text", "sig"), "doc_id", "text", "sig")
    assert out.columns == ["doc_id", "text", "row", "t", "sig", "next_sig"]
    assert sorted((r.doc_id, r.row, r.t) for r in out.collect()) == [(1, 7, "x"), (2, 8, "y")]


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string, sig string")
    assert o.with_next(o.add_signature(df, "text", "sig"), "doc_id", "text", "text", "sig").count() == 0
