import hashlib
import random

import numpy as np

from waymark.llm import bpe

ODD = ["", " ", "a", "Hello<|startoftext|>World <|endoftext|>", "İIß ﬁ é é x y", "x" * 5000, "日本語" * 400, "it's we'll 'd 12 3.5!!", "́ lead", "a\x1cb\x85c\u0000d", "tab\tnew\nline\r\n\x0b\x0c end", "🙂🙂 👩‍👩‍👧 ok", "Σίσυφος ΣΑΣ", "0 10 a0b 0 ０", "Été## ÇA!! a_b ÿ* ×2 ª º µ x<|endoftext|> <| |> don't# (y)"]


def expected(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe.default_tokenizer())
    for e in t.encode_batch(texts, add_special_tokens=False):
        yield len(e.ids), hashlib.sha256(np.array(e.ids, dtype="<u4").tobytes()).hexdigest(), hashlib.sha256(t.decode(e.ids, skip_special_tokens=False).encode()).hexdigest()


def test_equals_the_library(spark):
    r = random.Random(5)
    words = ["".join(r.choices("abcdeéßñ日<|>'3", k=r.randint(1, 12))) for _ in range(300)]
    texts = ODD + [r.choice([" ", "\n", "  ", " "]).join(r.choices(words, k=r.randint(1, 800))) for _ in range(60)]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(-1, None, None), (0, texts[0], "x")], "doc_id long, text string, n_tokens string").repartition(3)
    got = {row.doc_id: (row.n_tokens, row.ids_sha256, row.decoded_sha256) for row in bpe.encode(df, output="digests").collect()}
    for i, want in enumerate(expected(texts)):
        assert got[i] == want, texts[i][:80]
    assert got[-1] == got[0]


def test_joins_are_repaired_wherever_chunks_end():
    text = ("aardvark élan  <|endoftext|> " + "q" * 40 + " the end\n") * 30
    encoder = bpe.ChunkEncoder(bpe.default_tokenizer())
    plain = encoder.tokenizer.encode(text, add_special_tokens=False).ids
    original = bpe.cuts
    try:
        for step in (1, 2, 3, 7, 50):
            bpe.cuts = lambda texts, s=step: [[i for i in range(s, len(data), s) if data[i] & 0xC0 != 0x80] + [len(data)] for data in texts]
            encoder.chunks.clear()
            assert np.frombuffer(encoder.encode([text])[0], dtype="<u4").tolist() == plain
    finally:
        bpe.cuts = original


def test_chunks_of_a_text_do_not_depend_on_the_texts_around_it():
    r = random.Random(9)
    texts = ["".join(r.choices("abcdé ", k=n)).encode() for n in (0, 5, 16, 17, 3000, 0, 9000, 1)]
    assert bpe.cuts(texts) == [bpe.cuts([t])[0] for t in texts]
    assert len(bpe.cuts(texts)[4]) > 5


def test_old_words_and_chunks_go(monkeypatch):
    monkeypatch.setattr(bpe, "KEPT_WORDS", 50)
    monkeypatch.setattr(bpe, "KEPT_CHUNKS", 5)
    encoder, r = bpe.ChunkEncoder(bpe.default_tokenizer()), random.Random(2)
    for _ in range(8):
        text = " ".join("".join(r.choices("abcdé0", k=5)) for _ in range(300))
        assert np.frombuffer(encoder.encode([text, ""])[0], dtype="<u4").tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids
        assert len(encoder.words) <= 350 and len(encoder.chunks) <= 30


def test_round_trip_and_empty(spark):
    df = spark.createDataFrame([(1, "Some words, again and again")], "doc_id long, text string")
    row = bpe.decode(bpe.encode(df)).first()
    assert row.n_tokens == len(row.ids) and "some</w> words</w>" in row.decoded
    assert bpe.encode(df.limit(0)).count() == 0


def test_tokenizers_that_keep_white_space_are_rejected(tmp_path):
    import pytest
    from tokenizers import AddedToken, Tokenizer, models, pre_tokenizers

    t = Tokenizer(models.BPE({c: i for i, c in enumerate(sorted(pre_tokenizers.ByteLevel.alphabet()))}, []))
    t.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=True)
    t.save(str(tmp_path / "kept.json"))
    with pytest.raises(ValueError, match="white space"):
        bpe.ChunkEncoder(str(tmp_path / "kept.json"))
    t = Tokenizer.from_file(bpe.default_tokenizer())
    bpe.ChunkEncoder(bpe.default_tokenizer())
    t.add_tokens([AddedToken("two words")])
    t.save(str(tmp_path / "added.json"))
    with pytest.raises(ValueError, match="white space"):
        bpe.ChunkEncoder(str(tmp_path / "added.json"))


def test_names_with_dots(spark):
    df = spark.createDataFrame([(1, "Some words"), (2, None)], "`the.id` long, `a.text` string")
    got = bpe.encode(df, text="a.text").orderBy("`the.id`")
    assert got.columns == ["the.id", "a.text", "n_tokens", "ids"]
    back = bpe.decode(got)
    assert [(r["the.id"], r.n_tokens, r.decoded.replace("</w>", "")) for r in back.collect()] == [(1, 2, "some words"), (2, 0, "")]
