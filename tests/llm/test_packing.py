import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from waymark.llm import packing

ODD = ["", " ", "  ", "a", " a", "a ", "a  b", "a \n b", "\n\n a\tb 　c   d", "it's we'll 'd  12 3.5!!", "x<|endoftext|> y <|endoftext|>z <| |>", "日本語 の テキスト 🙂🙂 👩‍👩‍👧 ok", "a\x1c b \x85c\u0000 d", "Ġ ĠĠ aĠb Ġ", "q" * 5000 + " " + "w " * 50, "tab\t new\r\n line \x0b\x0c end ", "́ lead ́"]


def encoded(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.default_tokenizer())
    return [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


def some_texts(seed, n, most):
    r = random.Random(seed)
    words = ["".join(r.choices("abcdeéßñ日<|>'3.\n", k=r.randint(1, 12))) for _ in range(400)]
    return ["".join(r.choice([" ", " ", " ", "\n", "  ", " "]) + w for w in r.choices(words, k=r.randint(1, most)))[r.randint(0, 1) :] for _ in range(n)]


def test_encoder_equals_the_library():
    encoder, texts = packing.Encoder(packing.default_tokenizer()), ODD + some_texts(1, 80, 120)
    assert encoder.quick is not None and sum(map(encoder._common, texts)) > 5 and not all(map(encoder._common, texts))
    assert [np.frombuffer(encoder.encode(t), dtype="<u4").tolist() for t in texts] == encoded(texts)


def test_both_libraries_agree_on_common_characters():
    encoder = packing.Encoder(packing.default_tokenizer())
    texts = [f"a{c}b {c}1{c}{c}.{c} x\n{c}  {c}'s{c}'{c}" for c in map(chr, range(ord(packing.COMMON)))]
    assert all(map(encoder._common, texts))
    assert [encoder.quick.encode_ordinary(t) for t in texts] == encoded(texts)
    assert not encoder._common("x<|endoftext|>") and not encoder._common("é日")


def test_other_tokenizers_are_left_to_their_library():
    import public_tokenizers

    encoder = packing.Encoder(public_tokenizers.path("word_bpe_49k.json"))
    assert encoder.quick is None
    assert np.frombuffer(encoder.encode("Some Text"), dtype="<u4").tolist() == encoder.tokenizer.encode("Some Text", add_special_tokens=False).ids


HISTOGRAMS = [{}, {2048: 5}, {1: 1}, {3: 10**6}, {1100: 10**9, 5: 3}, {700: 10**6, 1100: 10**6 + 3}, {2047: 4}, {k: 10**9 + k * k for k in range(1, 2049)}, {k: k for k in range(1000, 1500)}]


@pytest.mark.parametrize("histogram", [*HISTOGRAMS, *[{random.Random(i).randint(1, 2048): random.Random(-i).randint(1, 99) for i in range(s, s + 300)} for s in (0, 500)]])
def test_patterns_take_each_piece_once(histogram):
    rows = packing.patterns(histogram)
    assert len(rows) < 30_000  # whatever the counts
    taken, used, counts = defaultdict(list), defaultdict(int), {}
    for piece, number, count, start, length, sequence, offset in rows:
        assert length > 0 and used[sequence] == offset and counts.setdefault(sequence, count) == count
        used[sequence] += length
        taken[piece].append((start, length, number, count))
    assert all(0 < u <= 2048 for u in used.values())
    for piece, n in histogram.items():
        assert sum(length * count for _, length, _, count in taken[piece]) == piece * n
        edges = sorted({x for _, _, number, count in taken[piece] for x in (number, number + count)})
        for at in edges[:-1] if len(edges) < 400 else edges[:200]:  # each range of numbers is covered from 0 on without a gap
            place = 0
            for start, length, number, count in sorted(taken[piece]):
                if number <= at < number + count:
                    assert start == place
                    place += length
            assert place == piece
        assert edges[0] == 0 and edges[-1] == n
    total = 0
    for s in sorted(counts):  # sequences are numbered without a gap
        assert s == total
        total += counts[s]
    pads = sorted(((packing.padding(u), counts[s]) for s, u in used.items()), reverse=True)
    assert all(pad <= packing.SPARE for pad, _ in pads)


def test_every_id_of_every_document_lies_in_one_piece(spark, tmp_path):
    texts = [None, *ODD, *some_texts(2, 150, 500), "w " * 9000, *["same text here"] * 40]
    rows = [(i if i != 7 else None, t, "z", 3) for i, t in enumerate(texts)]
    rows += rows[20:25]  # repeated rows
    spark.createDataFrame(rows, "doc_id long, text string, part string, length int").repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    got = packing.op13_packing(spark, str(tmp_path)).collect()
    assert sorted(got, key=str) == sorted(packing.op13_packing(spark, str(tmp_path)).collect(), key=str)  # reruns agree
    ids = {d: [*x, 1] for (d, *_), x in zip(rows, encoded([t or "" for _, t, *_ in rows]), strict=True)}
    places, by_doc = defaultdict(list), defaultdict(list)
    for r in got:
        assert r.doc_tokens == len(ids[r.doc_id]) and 0 < r.length <= 2048
        assert r.ids_crc32 == zlib.crc32(np.array(ids[r.doc_id][r.start : r.start + r.length], dtype="<u4").tobytes())
        places[r.sequence_id].append((r.offset, r.length))
        by_doc[r.doc_id] += range(r.start, r.start + r.length)
    often = {d: sum(x[0] == d for x in rows) for d in ids}
    assert all(sorted(by_doc[d]) == sorted(list(range(len(x))) * often[d]) for d, x in ids.items())
    pad = 0
    for x in places.values():
        end = 0
        for offset, length in sorted(x):
            assert offset == end
            end += length
        assert end <= 2048
        pad += packing.padding(end)
    assert pad <= packing.SPARE * len(places) and any(r.start % 2048 for r in got)  # some are cut to fit
    real = packing.pack(spark.read.parquet(f"{tmp_path}/documents.parquet")).collect()
    assert sorted((str(r.doc_id), r.start, r.length, r.sequence_id, r.offset) for r in real) == sorted((str(r.doc_id), r.start, r.length, r.sequence_id, r.offset) for r in got)
    assert all(r.ids == ids[r.doc_id][r.start : r.start + r.length] for r in real)


def test_no_rows(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string")).collect() == []
