from collections import Counter

import corpus_pipeline as c
from waymark.llm import mixing, near_dedup, pii, toxicity

SF = "/root/testdata/sf0.001"


def test_stages_take_effect_one_after_the_other(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").cache()
    out = docs
    for name, stage in c.STAGES:
        before, out = out, stage(spark, out, SF).cache()
        if name == "toxicity":
            model = toxicity.train(before, spark.read.parquet(f"{SF}/labels.parquet"))
            kept = {r.doc_id for r in toxicity.score(before, model).filter("score < 0.7").collect()}
            assert {r.doc_id for r in out.collect()} == kept
        elif name == "near_dedup":
            ids = {r.class_id for r in near_dedup.classes(before).collect()}
            assert Counter(r.doc_id for r in out.collect()) == Counter(ids)
        elif name == "pii":
            assert out.count() == before.count()
            assert not any(s.base for r in pii.find(out).collect() for s in r.spans)
        elif name == "mixing":
            want = {r.doc_id: r.copies for r in mixing.mix(before).collect() if r.copies}
            assert Counter(r.doc_id for r in out.collect()) == Counter(want)
        if name != "bpe":
            assert out.columns == docs.columns
        else:
            assert out.count() == before.count() and set(out.columns) == {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"}
    assert sorted(map(tuple, c.run(spark, SF).collect())) == sorted(map(tuple, out.collect()))


def test_defined_cases(spark, tmp_path):
    """Nulls in any column, empty and very long texts, repeated rows, extra columns with the stages' own names, no rows."""
    names = ["_toxicity", "_hash", "row", "h", "spans", "nth", "ids"]
    schema = "doc_id long, text string, lang string, source string, n_chars int, " + ", ".join(f"{n} string" for n in names)
    text = "mail me at some.one@example.com about the words of this text"
    rows = [(1, text, "en", "a", len(text)), (1, text, "en", "a", len(text)), (2, None, None, None, None), (None, "", "en", "b", 0), (None, None, None, None, None), (3, "w " * 60_000, "en", "a", 120_000), (4, text + " and more", "en", "b", 5)]
    rows += [(10 + i, " ".join(f"v{i}x{j}" for j in range(30)), "de", "c", 100) for i in range(12)]
    docs = spark.createDataFrame([(*r, *names) for r in rows], schema).repartition(3)
    spark.createDataFrame([(1, 0, 1), (10, 1, 0), (None, 1, 1), (11, None, None)], "doc_id long, toxic int, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    for out in (docs, docs.limit(0)):
        empty = out.isEmpty()
        for name, stage in c.STAGES:
            before, out = out, stage(spark, out, str(tmp_path))
            if name != "bpe":
                assert out.columns == docs.columns, name
                assert all(tuple(r)[-len(names) :] == tuple(names) for r in out.collect()), name
            if name in ("pii", "bpe"):
                assert out.count() == before.count(), name
            assert out.isEmpty() == empty, name
