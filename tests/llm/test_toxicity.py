import random

import numpy as np
from pyspark.sql import functions as F

from waymark.llm import toxicity as m
from waymark.llm.common import held_out


def corpus(spark, n=600):
    r = random.Random(4)
    words = ["".join(r.choices("aeinorst", k=r.randint(2, 7))) for _ in range(150)]
    rows, labels = [], []
    for i in range(n):
        toxic = i % 5 == 0
        text = r.choices(words, k=r.randint(20, 60))
        for _ in range(3 * toxic):
            text.insert(r.randrange(len(text)), r.choice(["idiot", "STUPID", "scum"]))
        rows.append((i, " ".join(text), "x"))
        labels.append((i, int(toxic), 1))
    rows += [(-1, None, "x"), (-2, "", "x"), (-3, "é" * 100_000, "x"), (0, rows[0][1], "x"), (None, "idiot", "x")]
    labels += [(None, 1, 1), (3, None, 1), (4, 7, 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, score string").repartition(3), spark.createDataFrame(labels, "doc_id long, toxic int, quality int")


def test_held_out_accuracy_and_reruns(spark):
    docs, labels = corpus(spark)
    model = m.train(docs, labels)
    out = m.score(docs, model).withColumn("held", held_out("doc_id")).collect()
    assert len(out) == 605 and all(0 <= r.score <= 1 for r in out)
    seen = [r for r in out if r.held and r.doc_id >= 0]
    assert np.mean([(r.score >= m.THRESHOLD) == (r.doc_id % 5 == 0) for r in seen]) > 0.95
    again = m.train(docs.repartition(2), labels)
    assert np.array_equal(model.buckets, again.buckets) and np.allclose(model.weights, again.weights)
    kept = m.reject_toxic(docs, labels)
    assert kept.columns == docs.columns and kept.count() == sum(r.score < m.THRESHOLD for r in out)


def test_clashing_columns_and_repeated_ids(spark):
    docs, labels = corpus(spark, 60)
    clash = docs.withColumn("_toxicity", F.lit("mine")).withColumn("_id", F.lit("its")).withColumn("y", F.lit(1))
    got = m.reject_toxic(clash, labels)
    assert got.columns == clash.columns and {(r._toxicity, r._id, r.y) for r in got.collect()} == {("mine", "its", 1)}
    many = docs.unionByName(docs.filter("doc_id < 10")).unionByName(docs.filter("doc_id < 10"))
    one, three = m.train(docs, labels), m.train(many, labels.unionByName(labels))
    assert np.array_equal(one.buckets, three.buckets) and np.allclose(one.weights, three.weights)


def test_no_labels_and_no_rows(spark):
    docs, labels = corpus(spark, 20)
    assert {r.score for r in m.score(docs, m.train(docs, labels.limit(0))).collect()} == {0.5}
    assert m.score(docs.limit(0), m.train(docs, labels)).count() == 0


def test_hits_are_distinct_and_stay_within_rows():
    texts = [m._bytes("abcabc"), m._bytes(""), m._bytes("Abcd"), m._bytes("éèé日本")]
    row, feature = m.hits(texts)
    for i, t in enumerate(texts):
        t = t.decode("utf-32-le")
        want = {t[a : a + n] for n in m.SIZES for a in range(len(t) - n + 1)}
        assert (row == i).sum() == len(want)


def test_buckets_that_differ_alike_are_kept_in_order(spark, monkeypatch):
    monkeypatch.setattr(m, "KEPT", 5)
    docs = spark.createDataFrame([(i, "aaaa bbbb" if i % 2 else "cccc dddd") for i in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, toxic int")
    one, two = m.train(docs, labels), m.train(docs.repartition(7), labels)
    assert len(one.buckets) == 5 and one.buckets.tolist() == two.buckets.tolist() == sorted(one.buckets.tolist())


def test_the_decay_is_chosen_on_folds():
    r = np.random.default_rng(3)
    noise = r.normal(size=(240, 300)).astype(np.float32)
    y = (r.random(240) < 0.5).astype(float)
    assert m.choose_decay(noise, y) == max(m.DECAYS)  # nothing to learn: the strongest
    clear = noise[:, :3] * 0.1 + np.float32(4) * (2 * y[:, None] - 1).astype(np.float32)
    assert m.choose_decay(clear, y) == min(m.DECAYS)
    assert m.choose_decay(noise[:2], np.array([0.0, 1.0])) in m.DECAYS
