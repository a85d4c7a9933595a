from collections import Counter

import numpy as np
import pytest

from waymark.llm import mixing


def plain_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    cap, total = {s: 2.0 * sizes[s] for s in order}, 1.5 * sum(sizes.values())
    full = set()
    while True:
        open_ = [s for s in order if s not in full]
        level = (total - sum(cap[s] for s in full)) / sum(w[s] for s in open_) if open_ else 0
        above = {s for s in open_ if level * w[s] > cap[s]}
        if not above:
            return {s: cap[s] if s in full else level * w[s] for s in order}
        full |= above


def rows(n=3000):
    r = np.random.default_rng(3)
    names = ["b", "a", None, "ä", "Z", "é"]
    out = [(i, names[0] if r.random() < 0.4 else names[r.integers(6)], " ".join(["w"] * int(r.pareto(1.2) * 20 + 1))) for i in range(n)]
    return out + [(7, "a", None), (7, "a", ""), (8, "a", "x y"), (8, "a", "x y"), (None, None, "q")]


def test_targets_totals_and_reruns(spark):
    data = rows()
    df = spark.createDataFrame(data, "doc_id long, source string, text string")
    got = mixing.mix(df.repartition(5), block=128).collect()
    assert len(got) == len(data)
    sizes = {}
    for _, s, t in data:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    want, taken = plain_targets(sizes), {}
    for r in got:
        assert r.target == pytest.approx(want[r.source], rel=1e-9) and r.source_size == sizes[r.source]
        assert r.copies in (0, 1, 2) and r.taken == r.copies * r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
    for s in sizes:
        longest = max(len((t or "").split()) for _, o, t in data if o == s)
        assert abs(taken[s] - want[s]) <= longest, s
    again = mixing.mix(df.repartition(3), block=128).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_document_totals_are_balanced():
    r = np.random.default_rng(1)
    p, size = r.random(4000), r.integers(1, 900, 4000).astype(float)
    x = mixing.flight(p, np.column_stack([size, np.ones(4000)]))
    open_ = (x > 0) & (x < 1)
    assert open_.sum() <= 2
    assert x.sum() == pytest.approx(p.sum(), abs=1e-6) and x @ size == pytest.approx(p @ size, rel=1e-9)


def test_rows_of_the_mix(spark):
    df = spark.createDataFrame([(i, "a" if i % 3 else "b", "w " * (i % 9), i) for i in range(200)] + [(5, "a", "w " * 5, 5)], "doc_id long, source string, text string, size long")
    n = sum(r.copies for r in mixing.mix(df).collect())
    out = mixing.mixed(df)
    assert out.columns == df.columns and out.count() == n


def test_empty_and_wordless(spark):
    df = spark.createDataFrame([(1, "a", "")], "doc_id long, source string, text string")
    assert mixing.mix(df.limit(0)).count() == 0
    assert mixing.mix(df).first().target == 0


def test_mixed_keeps_clashing_columns_and_repeats(spark):
    text = lambda i: " ".join([f"w{i}"] * (5 + i % 7))
    rows = [(i % 40, text(i % 40), f"s{i % 3}", "a", "b", i % 40) for i in range(80)] + [(None, None, None, "a", "b", 0)] * 3
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, _size string, row string, h long").repartition(3)
    want = Counter()
    for r in mixing.mix(df).collect():
        want[r.doc_id, r.source] += r.copies
    got = mixing.mixed(df)
    assert got.columns == df.columns
    out = got.collect()
    assert Counter((r.doc_id, r.source) for r in out) == Counter({k: n for k, n in want.items() if n})
    assert all((r._size, r.row) == ("a", "b") and (r.doc_id is None or r.h == r.doc_id and r.text == text(r.doc_id)) for r in out)
    assert mixing.mixed(df.limit(0)).count() == 0


def test_repeated_rows_are_dealt_to_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(mixing, "REPEATS", 100)
    df = spark.createDataFrame([(1, "a", "same words here")] * 5000 + [(i, "b", "w " * (i % 7)) for i in range(300)], "doc_id long, source string, text string")
    numbered = mixing._numbered(df.selectExpr("doc_id", "source", "cast(3 as long) as size", "xxhash64(text) as h"))
    assert numbered.count() == 5300 and numbered.filter("source = 'a'").select("nth").distinct().count() == 5000
    got = mixing.mix(df, block=128).collect()
    assert len(got) == 5300
    taken = sum(r.taken for r in got if r.source == "a")
    assert abs(taken - next(r.target for r in got if r.source == "a")) <= 3
    assert {r.copies for r in got if r.source == "a"} <= {0, 1, 2}


def test_very_long_texts_count_all_their_words(spark):
    rows = [(1, "a", "w " * 500_000), (2, "a", "x" * 1_000_000)] + [(i, "b", "w w") for i in range(3, 60)]
    got = {r.doc_id: r for r in mixing.mix(spark.createDataFrame(rows, "doc_id long, source string, text string")).collect()}
    assert (got[1].size, got[2].size, got[1].source_size) == (500_000, 1, 500_001) and got[1].taken in (0, 500_000, 1_000_000)
