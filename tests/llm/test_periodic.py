import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np

from waymark.llm import periodic


def plain_runs(words, min_words=24, min_exp=3):
    """All runs by definition: the longest stretch around each place for each period, the period the smallest one."""
    n, out = len(words), set()
    for q in range(1, n // min_exp + 1):
        for at in range(n - q):
            if words[at] != words[at + q]:
                continue
            begin, end = at, at + q + 1
            while begin and words[begin - 1] == words[begin - 1 + q]:
                begin -= 1
            while end < n and words[end] == words[end - q]:
                end += 1
            stretch = words[begin:end]
            smallest = next(p for p in range(1, len(stretch) + 1) if all(stretch[i] == stretch[i + p] for i in range(len(stretch) - p)))
            if smallest == q and end - begin >= max(min_words, min_exp * q):
                out.add((begin, end - begin, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def plain_row(doc_id, text):
    words = (text or "").encode().split()
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(words)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None, None, None))
    milli = None if best[0] is None else 1000 * best[1] // best[2]
    sha = lambda b: hashlib.sha256(b).hexdigest()
    listed = sha("".join(f"{s},{length},{q}\n" for s, length, q in runs).encode())
    return (len(runs), *best, milli, listed, sha(b" ".join(w for i, w in enumerate(words) if i not in gone)))


def repeating(r, n):
    words = []
    while len(words) < n:
        unit = [r.choice("abc") for _ in range(r.randint(1, 7))]
        words += (unit * r.randint(1, 9))[: r.randint(1, 50)]
    return words[:n]


def some_texts(r):
    texts = [None, "", " \n\t", "a", "é ", " ".join("a" * 23), " ".join("a" * 24), "  b\u0085c " * 30, " ".join("ab" * 40) + " x " + " ".join("ab" * 40), " ".join(["a"] * 30 + ["b"] * 30 + ["a"] * 30)]
    return texts + [r.choice([" ", "\n", " \t "]).join(repeating(r, r.randint(20, 130))) for _ in range(110)]


def test_runs_are_those_of_the_definition():
    r = random.Random(3)
    for _ in range(150):
        words = repeating(r, r.randint(0, 90))
        ids = periodic.numbered(" ".join(words))[1]
        least, times = r.choice([(24, 3), (6, 2), (1, 2), (9, 4)])
        got = list(zip(*(x.tolist() for x in periodic.scan(ids, 1, periodic.last_lag(len(ids), times), least, times)), strict=True))
        assert got == plain_runs(words, least, times), (words, least, times)


def test_ranges_of_lags_together_are_all_lags():
    r = random.Random(4)
    for block in (1, 100, 1 << 20):
        periodic.BLOCK, kept = block, periodic.BLOCK
        try:
            ids = periodic.numbered(" ".join(repeating(r, 300)))[1]
            parts = [periodic.scan(ids, i * 100 // 7 + 1, (i + 1) * 100 // 7) for i in range(7)]
            together = periodic.smallest(*np.concatenate([np.stack(p) for p in parts], axis=1))
            assert [x.tolist() for x in together] == [x.tolist() for x in periodic.scan(ids, 1, 100)]
        finally:
            periodic.BLOCK = kept


def test_rows_equal_the_plain_walk(spark, tmp_path):
    rows = [(i if i else None, t, "x", 5) for i, t in enumerate(some_texts(random.Random(8)))]
    rows += rows[5:9]  # repeated rows
    spark.createDataFrame(rows, "doc_id long, text string, runs string, n_words int").write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(x) for x in periodic.op12_periodic_runs(spark, str(tmp_path)).collect()]
    assert sorted(got, key=str) == sorted([(d, *plain_row(d, t)) for d, t, *_ in rows], key=str)
    assert sum(x[1] > 0 for x in got) > 50 and any(zlib.crc32(str(x[0]).encode()) % 10 == 0 and x[1] for x in got)


def test_long_texts_are_dealt_out_with_the_same_result(spark):
    r = random.Random(12)
    texts = [" ".join(repeating(r, n)) for n in (3000, 2500, 40, 900)] + [" ".join(["la"] * 4000), None]
    docs = spark.createDataFrame([(i, t, "a.b") for i, t in enumerate([*texts, texts[0]])], "doc_id long, text string, `odd.name` string")
    whole = periodic.find_runs(docs).orderBy("doc_id").collect()
    dealt = periodic.find_runs(docs, long_chars=1000, piece=200_000)
    assert dealt.columns == ["doc_id", "text", "odd.name", "n_words", "runs", "collapsed"]
    assert dealt.orderBy("doc_id").collect() == whole
    assert whole[4].collapsed == "la" and [tuple(x) for x in whole[4].runs] == [(0, 4000, 1)]


def test_no_rows(spark):
    assert periodic.find_runs(spark.createDataFrame([], "doc_id long, text string")).collect() == []
