import random
import re
from collections import Counter

from waymark.llm import quality_rules as q


def plain(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    times = Counter(windows)
    covered = {p for i, w in enumerate(windows) if times[w] > 1 for p in range(i, i + 8)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    failed = len(words) < 20 or 100 * len(covered) > 30 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered), failed


def texts():
    r = random.Random(2)
    out = [None, "", " \n ", "a", "x y\nx y\n\n\r\nx y", "é ü " * 9, "a b c d e f g h " * 2, "\x85a\xa0b \x1cc", "# " * 30, "LOUD!! " * 25, "w " * 50_000]
    for _ in range(150):
        out.append(r.choice([" ", "\n", "\t "]).join(r.choices(["a", "b", "c", "dé", "#x", "||"], k=r.randint(1, 90))))
        out.append(" ".join("".join(r.choices("abcdeé", k=r.randint(1, 9))) for _ in range(r.randint(15, 60))))
    return out


def test_equals_brute_force(spark):
    given = texts()
    rows = [(i, t, "old", 5) for i, t in enumerate(given)]
    df = spark.createDataFrame(rows + rows[:3], "doc_id long, text string, kept string, n_words int").repartition(3)
    out = q.cascade(df).collect()
    assert len(out) == len(rows) + 3
    for r in out:
        assert (*(r[n] for n in q.BASE), r.base_failed) == plain(given[r.doc_id])
        d = q.Counted(given[r.doc_id])
        assert r.kept == (not r.base_failed and not any(rule(d) for rule in q.RULES.values()))
        assert r.kept == (r.rejected_by is None)


def test_order_is_by_rejections_per_cost():
    assert q.ordered([("a", 1.0, 0.1), ("b", 0.1, 0.1), ("c", 1.0, 0.9), ("d", 0.1, 0.0)]) == ["b", "c", "a", "d"]


def test_ties_keep_the_given_order(spark):
    assert q.ordered([("c", 1.0, 0.5), ("a", 2.0, 1.0), ("b", 0.5, 0.25), ("d", 0.0, 0.0), ("e", 0.0, 0.0)]) == ["c", "a", "b", "d", "e"]
    texts = [("LOUD words here and there " * 8 + f"{i} {i + 1}",) for i in range(30)]
    got = q.cascade(spark.createDataFrame(texts, "`the.text` string"), text="the.text")
    assert got.columns[0] == "the.text" and got.count() == 30


def test_empty_table(spark):
    assert q.cascade(spark.createDataFrame([], "doc_id long, text string")).count() == 0
