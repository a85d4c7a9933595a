import random

import numpy as np
from pyspark.sql import functions as F

from waymark.llm import quality_model as m
from waymark.llm.common import held_out


def corpus(spark, n=500):
    r = random.Random(4)
    rows, labels = [], []
    for i in range(n):
        words = ["".join(r.choices("aeinorst", k=r.randint(2, 7))) for _ in range(r.randint(20, 60))]
        good = i % 4 > 0
        rows.append((i, " ".join(words if good else [w.upper() + "!!" for w in words] if i % 8 else [words[0]] * 50), "x"))
        labels.append((i, int(good)))
    rows += [(-1, None, "x"), (-2, "", "x"), (-3, "é" * 100_000, "x"), (0, rows[0][1], "x"), (None, "a", "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, score string").repartition(3), spark.createDataFrame(labels + [(None, 1), (3, None)], "doc_id long, quality int")


def test_held_out_accuracy_and_reruns(spark):
    docs, labels = corpus(spark)
    model = m.train(docs, labels)
    out = m.score(docs, model).withColumn("held", held_out("doc_id")).collect()
    assert len(out) == 505 and all(0 <= r.score <= 1 for r in out)
    assert np.mean([(r.score >= 0.5) == (r.doc_id % 4 > 0) for r in out if r.held and r.doc_id >= 0]) > 0.95
    again = m.train(docs.repartition(2), labels)
    assert np.array_equal(model.feature, again.feature) and np.allclose(model.leaf, again.leaf)


def test_traversal_equals_walking_each_tree():
    r = np.random.default_rng(0)
    x = r.random((300, 3))
    model = m.grow(x, (x[:, 0] + x[:, 1] * (x[:, 2] > 0.5) > 0.8).astype(float), trees=5)
    for row, got in zip(x, model.score(x), strict=True):
        total = model.base
        for f, c, leaf in zip(model.feature, model.cut, model.leaf, strict=True):
            i = 0
            while i < len(f):
                i = 2 * i + 1 + (row[f[i]] > c[i])
            total += leaf[i - len(f)]
        assert abs(got - 1 / (1 + np.exp(-total))) < 1e-12
    assert ((model.score(x) > 0.5) == (x[:, 0] + x[:, 1] * (x[:, 2] > 0.5) > 0.8)).mean() > 0.85


def test_no_labels_and_no_rows(spark):
    docs, labels = corpus(spark, 20)
    assert {r.score for r in m.score(docs, m.train(docs, labels.limit(0))).collect()} == {0.5}
    assert m.score(docs.limit(0), m.train(docs, labels)).count() == 0


def test_one_label_and_clashing_names(spark):
    docs, labels = corpus(spark, 60)
    one = {r.score for r in m.score(docs, m.train(docs, labels.filter("quality = 1"))).collect()}
    assert len(one) == 1 and 0.5 < one.pop() < 1
    clash = docs.withColumn("Score", F.lit("mine")).withColumn("a.b", F.lit("its")).withColumn("y", F.lit(1))
    got = m.score(clash, m.train(clash, labels))
    assert [c for c in got.columns if c.lower() == "score"] == ["score"] and {(r["a.b"], r.y) for r in got.collect()} == {("its", 1)}
