import random
from collections import Counter

import numpy as np

from waymark.llm import near_dedup as d


def corpus():
    r = random.Random(11)
    words = ["".join(r.choices("abcdefghij", k=r.randint(2, 8))) for _ in range(3000)]
    shared = r.choices(words, k=60)
    rows, n = [], 0
    for _ in range(60):
        base = r.choices(words, k=r.randint(30, 200))
        if r.random() < 0.4:
            base[10:10] = shared
        for _ in range(r.choice([1, 1, 2, 5])):
            t = list(base)
            for _ in range(r.choice([0, 0, 1, 2, 3, 6])):
                t[r.randrange(len(t))] = r.choice(words)
            rows.append((n, " ".join(t)))
            n += 1
    chain = r.choices(words, k=120)  # each like the next, the ends unlike
    for _ in range(12):
        chain = chain[6:] + r.choices(words, k=6)
        rows.append((n, " ".join(chain)))
        n += 1
    line = r.choices(words, k=20)  # the same shingles, but not as often
    rows += [(n + 100 + i, " ".join(line * k)) for i, k in enumerate([2, 3, 10, 11, 12, 13])]
    same = " ".join(r.choices(words, k=50))
    rows += [(n + i, same + "\n" * (i % 3)) for i in range(40)]
    rows += [(9001, None), (9002, ""), (9003, " \n"), (9004, ""), (9005, "one two"), (9006, "one two"), (9007, "one"), (9008, "é " * 30_000), (9008, "é " * 30_000), (None, "some words of a null id here")]
    r.shuffle(rows)
    return rows


def plain(rows):
    """Classes by comparing the shingle counts of all pairs, as the number of one row of each class."""
    sets = []
    for _, t in rows:
        w = (t or "").encode().split()
        sets.append(Counter(tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))) if w else None)
    up = list(range(len(rows)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 5 * (sets[i] & sets[j]).total() >= 4 * (sets[i] | sets[j]).total():
                up[top(i)] = top(j)
    return [top(i) for i in range(len(rows))]


def test_classes_equal_all_pairs(spark):
    rows = corpus()
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, node int").repartition(5)
    got = d.classes(df).collect()
    assert len(got) == len(rows)
    want = {}
    for (i, _), c in zip(rows, plain(rows), strict=True):
        want.setdefault(c, []).append(i)
    expected = Counter((i, min((x for x in c if x is not None), default=None)) for c in want.values() for i in c)
    assert Counter((r.id, r.class_id) for r in got) == expected
    kept = d.deduplicated(df)
    assert kept.columns == df.columns and kept.count() == len(want)


def test_null_ids_share_classes(spark):
    text, other = " ".join(f"w{i}" for i in range(60)), " ".join(f"v{i}" for i in range(60))
    rows = [(None, text), (3, text), (7, text), (9, text + " end"), (None, other), (None, other), (None, None), (4, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter((r.id, r.class_id) for r in d.classes(df).collect())
    assert got == Counter([(None, 3), (3, 3), (7, 3), (9, 3), (None, None), (None, None), (None, None), (4, 4)])
    assert Counter(map(tuple, d.deduplicated(df).collect())) == Counter([(3, text), (None, other), (None, None), (4, None)])


def test_no_link_of_a_bucket_is_lost(spark):
    """All texts in one bucket, whatever their signatures: the classes are those of all pairs."""
    from pyspark.sql import functions as F

    r = random.Random(5)
    base, few = [f"w{i}" for i in range(150)], [f"v{i}" for i in range(40)]
    texts = []
    for _ in range(40):  # copies with edits, of which others share some
        t = list(base)
        for _ in range(r.choice([2, 4, 6, 8, 12])):
            t[r.randrange(150)] = r.choice(few)
        texts += [" ".join(t)]
        for _ in range(r.choice([0, 0, 1, 2])):
            u = list(t)
            for _ in range(r.choice([1, 2, 3, 4])):
                u[r.randrange(150)] = r.choice(few)
            texts.append(" ".join(u[r.choice([0, 0, 5, 14]) :]))
    text = lambda a, b: " ".join(f"x{i}" for i in range(a, b))
    texts += [text(0, 104), text(10, 112), text(5000, 5060), text(5000, 5062), "x5000 x5001", "x5000 x5001 x5002"]
    rows = list(enumerate(texts))
    scratch = d.Scratch(spark)
    docs = d._rows(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text")
    sketch = scratch.keep(d._sketch(docs))
    nodes = sketch.select("node", "n", F.array(F.lit(7).cast("long")).alias("keys")).dropDuplicates(["node"])
    stars = d._stars(nodes, scratch)
    sets = scratch.keep(d._sets(docs, sketch.select("id", "h")))
    links = scratch.keep(d._checked(stars.filter(d._close("n", "m")), sets))
    pairs = scratch.keep(d._apart(stars, scratch.keep(d.components(links)), sets, scratch))
    more = d._checked(pairs, sets)
    assert more.count() > 0 and pairs.count() < len(texts) ** 2 / 8
    labels = {bytes(x.node): bytes(x.label) for x in d.components(links.unionByName(more)).collect()}
    node = {x.id: bytes(x.node) for x in sketch.collect()}
    got = Counter(labels.get(node[i], node[i]) for i, _ in rows)
    want = plain(rows)
    assert sorted(got.values()) == sorted(Counter(want).values())
    assert len({(w, labels.get(node[i], node[i])) for w, (i, _) in zip(want, rows, strict=True)}) == len(set(want))


def test_signature_estimates_weighted_similarity():
    r = np.random.default_rng(1)
    e = r.integers(0, 2**63, 400).astype(np.uint64)
    w1, w2 = r.random(400) * 3, r.random(400) * 3
    want = np.minimum(w1, w2).sum() / np.maximum(w1, w2).sum()
    got = (d.signature(e, w1, 2000) == d.signature(e, w2, 2000)).mean()
    assert abs(got - want) < 0.05
    one = np.ones(300)
    plain = (d.signature(e[:300], one, 2000) == d.signature(e[100:], one, 2000)).mean()
    assert abs(plain - 0.5) < 0.05
    assert len(set(d.signature(e[:1], one[:1], 50).tolist())) == 50
    whole = r.integers(1, 5, 400)
    assert (d.signature(e, whole) == d.darts(d.unit_cells(e, whole)[0])).all()


def test_components_of_long_chains(spark, monkeypatch):
    n = 1000
    names = [f"{i:05}".encode() for i in range(n)]
    random.Random(3).shuffle(names)
    hub = [(b"hub", f"leaf{i}".encode()) for i in range(200)]
    edges = [*zip(names, names[1:], strict=False), *hub, (b"x", b"y"), (b"y", b"x"), (b"z", b"z")]
    rounds, keep = [], d.Scratch.keep
    monkeypatch.setattr(d.Scratch, "keep", lambda self, df: rounds.append(1) or keep(self, df))
    labels = {bytes(r.node): bytes(r.label) for r in d.components(spark.createDataFrame(edges, "a binary, b binary")).collect()}
    assert len(rounds) < 2 * 10  # two tables a round
    groups = {}
    for k, v in labels.items():
        groups.setdefault(v, set()).add(k)
    want = [set(names), {b"hub"} | {x for _, x in hub}, {b"x", b"y"}, {b"z"}]
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want)) and all(k in v for k, v in groups.items())


def test_clashing_columns_stay(spark):
    rows = [(i, "some words that both of them have in common", "h", "i", 1.5) for i in range(3)]
    names = ["_class_h", "_class_id", "h"]
    df = spark.createDataFrame(rows, f"id long, text string, {names[0]} string, {names[1]} string, {names[2]} double")
    got = d.deduplicated(df, doc_id="id").collect()
    assert [tuple(r) for r in got] == [rows[0]]


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert d.classes(df).count() == 0 and d.deduplicated(df).count() == 0


def two_groups(n, m, r, words):
    """Two groups of near copies whose bases have 0.6 of their shingles in common; edits of both are often the same."""
    first = r.choices(words, k=200)
    second = list(first)
    second[10:55] = r.choices(words, k=45)  # 49 of 196 shingles differ: 147 of 245 are common

    def near(base):
        t = list(base)
        for _ in range(3):
            t[r.randrange(150, 196)] = r.choice(words[:3])
        return " ".join(t)

    return [near(first) for _ in range(n)], [near(second) for _ in range(m)]


def test_meetings_do_not_grow_with_the_square_of_a_group(spark):
    """All in one bucket; the cells of edits lie in both classes."""
    from pyspark.sql import functions as F

    r = random.Random(21)
    words = ["".join(r.choices("abcdefghij", k=7)) for _ in range(5000)]
    first, second = two_groups(400, 560, r, words)
    for k in (100, 400):
        rows = list(enumerate(first[:k] + second[: k * 7 // 5]))
        scratch = d.Scratch(spark)
        docs = d._rows(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text")
        sketch = scratch.keep(d._sketch(docs))
        nodes = sketch.select("node", "n", F.array(F.lit(7).cast("long")).alias("keys")).dropDuplicates(["node"])
        stars = scratch.keep(d._stars(nodes, scratch))
        sets = scratch.keep(d._sets(docs, sketch.select("id", "h")))
        leader = stars.first().b
        side = {bytes(x.node): x.id < k for x in sketch.collect()}  # the group is the class
        labels = spark.createDataFrame([(bytearray(n), bytes([s])) for n, s in side.items()], "node binary, label binary")
        seen = []
        possible, across = d._possible, d._across
        d._possible = lambda x: (seen.append(x.count()), possible(x))[1]  # noqa: B023
        d._across = lambda x, y: (seen.append((out := y.keep(across(x, y))).count()), out)[1]  # noqa: B023
        try:
            pairs = d._apart(stars, labels, sets, scratch).count()
        finally:
            d._possible, d._across = possible, across
        assert seen[0] > k and seen[1] <= 2 * len(rows) and pairs <= 2 * len(rows), (seen, pairs, leader)


def test_classes_of_a_cell_meet_once_and_never_themselves(spark):
    r = random.Random(4)
    rows = [(b, x, la, i) for b in range(3) for x in range(4) for la in range(r.randint(1, 9)) for i in range(r.randint(1, 4))]
    df = spark.createDataFrame(rows, "b int, x int, la int, a int")
    got = Counter(((p.b, p.x), frozenset([(p.la, p.a), (p.la_, p.a_)])) for p in d._across(df, d.Scratch(spark)).collect())
    want = Counter(((p[0], p[1]), frozenset([p[2:], q[2:]])) for p in rows for q in rows if p[:2] == q[:2] and p[2] < q[2])
    assert got == want and len(want) > 100
