"""BPE encoding and decoding with content-defined chunk reuse.

A rolling hash over the bytes of a text cuts it into chunks, so that passages which several
documents share give the same chunks wherever they stand.  A chunk is encoded once a task and
then reused.  A cut may fall inside a word; the word that a join cuts in two is encoded anew as a
whole, and the join grows until it reaches white space on both sides.  The vocabulary never merges
across white space, so from there on the tokens agree exactly with those of the undivided text.
Tokenizers that keep white space in their tokens are rejected with an error.

Null texts count as empty; an empty text has no tokens; very long texts are encoded whole; an empty table
gives no rows.  Any other column of the input is kept,
except those named as a result column, which are replaced.  Repeated rows give repeated results.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterable, Iterator
from itertools import filterfalse, islice

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_frames, pack, table, without

#: One cut in about so many bytes (a power of two).
CHUNK_BYTES = 256
#: Words and chunks that a task keeps; when more have come, the older half goes before the next texts.
KEPT_WORDS, KEPT_CHUNKS = 250_000, 20_000
#: Longer words are encoded each time and not kept.
LONGEST_KEPT = 200
#: Stands between words that are encoded in one call; words that hold it are encoded alone.
BETWEEN = "0"

_WHITE = b" \t\n\r\x0b\x0c"
_GEAR = np.random.default_rng(49_408).integers(0, 2**32, 256, dtype=np.uint64).astype(np.uint32)


def default_tokenizer() -> str:
    """Place of the public word-end vocabulary."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def cuts(texts: list[bytes], mean: int = CHUNK_BYTES) -> list[list[int]]:
    """Ends of the chunks of each text: where the rolling hash of its last 16 bytes says so.

    A cut never divides a code point.
    """
    b, begins = pack(texts)
    if len(b) <= 16:
        return [[len(t)] for t in texts]
    h = _GEAR[b]
    for step in (1, 2, 4, 8):  # after these, 16 bytes take part in each hash
        h[step:] = h[step:] + (h[:-step] << np.uint32(step))
    at = np.flatnonzero((h[15:-1] >> np.uint32(12)) & np.uint32(mean - 1) == 0) + 16
    at = at[(b[at] & 0xC0) != 0x80]
    of = np.searchsorted(begins, at, side="right") - 1
    inside = at - begins[of]
    own = inside >= 16  # not those that bytes of the text before take part in
    each = np.split(inside[own], np.searchsorted(of[own], np.arange(1, len(texts))))
    return [[*x.tolist(), len(t)] for x, t in zip(each, texts, strict=True)]


class ChunkEncoder:
    """Encodes and decodes texts as the tokenizers library does, reusing chunks and words."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        added = self.tokenizer.get_added_tokens_decoder()
        self._reject_kept_white(added.values())
        n = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.pieces = [(self.tokenizer.id_to_token(i) or "").encode() for i in range(n)]
        self.words: dict[bytes, bytes] = {}
        self.chunks: dict[bytes, tuple] = {}
        self.mark = self.tokenizer.encode(BETWEEN, add_special_tokens=False).ids

    def _reject_kept_white(self, added: Iterable) -> None:
        """Raise where the tokens of a text are not those of its words: then no join at white space is exact."""
        ids = lambda t: self.tokenizer.encode(t, add_special_tokens=False).ids
        words = ("a", "The", "1", "!", "é")
        gaps = [chr(c) for c in _WHITE] + ["  ", " \n", "\n\n"]
        whole = all(ids(g + x + g + y + g) == ids(x) + ids(y) for g in gaps for x in words for y in words)
        if not whole or any(set(t.content) & set(_WHITE.decode()) for t in added):
            raise ValueError("the tokenizer keeps white space in its tokens; chunks cannot be joined at white space")

    def _learn(self, words: Iterable[bytes]) -> None:
        """Encode words, each as a whole: many in one call, with a word of one known token between them."""
        alone, texts = [], []
        for w in words:
            t = w.decode()
            (alone if BETWEEN in t or len(self.mark) != 1 else texts).append(t)
        for at in range(0, len(texts), 2000):
            part = texts[at : at + 2000]
            ids = np.array(self.tokenizer.encode_batch_fast([f" {BETWEEN} ".join(part)], add_special_tokens=False)[0].ids, dtype="<u4")
            ends = np.flatnonzero(ids == self.mark[0]) * 4
            if len(ends) != len(part) - 1:  # a word has that token too
                alone += part
                continue
            flat, begin = ids.tobytes(), 0
            for t, end in zip(part, [*ends.tolist(), len(flat)], strict=True):
                self.words[t.encode()] = flat[begin:end]
                begin = end + 4
        for at in range(0, len(alone), 2000):
            part = alone[at : at + 2000]
            for t, e in zip(part, self.tokenizer.encode_batch_fast(part, add_special_tokens=False), strict=True):
                self.words[t.encode()] = np.array(e.ids, dtype="<u4").tobytes()

    def _forget(self) -> None:
        for name, most in (("words", KEPT_WORDS), ("chunks", KEPT_CHUNKS)):
            kept = getattr(self, name)
            if len(kept) > most:
                setattr(self, name, dict(islice(kept.items(), len(kept) - most // 2, None)))

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian 32-bit integers."""
        self._forget()
        words, chunks, plans, new, missing = self.words, self.chunks, [], {}, set()
        coded = [t.encode() for t in texts]
        for data, ends in zip(coded, cuts(coded), strict=True):
            plan, begin, half = [], 0, []
            for end in ends:
                chunk, begin = data[begin:end], end
                parts = chunks.get(chunk) or new.get(chunk)
                if parts is None:
                    whole = chunk.split()
                    head = whole.pop(0) if whole and chunk[0] not in _WHITE else b""
                    bare = len(head) == len(chunk)
                    tail = whole.pop() if whole and chunk[-1] not in _WHITE else b""
                    parts = new[chunk] = (bare, head, tail, whole)
                    missing.update(filterfalse(words.__contains__, whole))
                bare, head, tail, _ = parts
                if head:
                    half.append(head)
                if bare:  # no white space: the join goes on through the next chunk
                    continue
                if half:  # the join, repaired: the word that it cut is encoded whole
                    plan.append((words, b"".join(half)))
                plan.append((None, chunk))
                half = [tail] if tail else []
            if half:
                plan.append((words, b"".join(half)))
            missing.update(key for of, key in plan if of is words and key not in words)
            plans.append(plan)
        self._learn(missing)
        for chunk, (bare, head, tail, whole) in new.items():
            chunks[chunk] = (bare, head, tail, b"".join(map(words.__getitem__, whole)))
        out = [b"".join([chunks[key][3] if of is None else words[key] for of, key in plan]) for plan in plans]
        for w in missing:
            if len(w) > LONGEST_KEPT:
                del words[w]
        return out

    def decode(self, ids: bytes) -> bytes:
        """The text of ids in UTF-8, special tokens kept."""
        if self.tokenizer.decoder is not None:
            return self.tokenizer.decode(np.frombuffer(ids, dtype="<u4").tolist(), skip_special_tokens=False).encode()
        return b" ".join(map(self.pieces.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


def _slices(texts: list[str], most: int = 4_000_000) -> Iterator[slice]:
    """Runs of texts of about ``most`` characters, one text at least."""
    begin = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > most:
            yield slice(begin, i)
            begin, size = i, 0
        size += len(t)
    if begin < len(texts):
        yield slice(begin, len(texts))


def encode(docs: DataFrame, text: str = "text", tokenizer: str | None = None, output: str = "ids") -> DataFrame:
    """Encode every whole text.

    ``output="ids"`` adds n_tokens and ids (array of int); ``output="digests"`` adds n_tokens,
    ids_sha256 and decoded_sha256 instead, the digests of the ids and of the text decoded from them.
    """
    path = tokenizer or default_tokenizer()
    names = {"ids": ("n_tokens", "ids"), "digests": ("n_tokens", "ids_sha256", "decoded_sha256")}[output]
    kept = without(docs, *(n for n in names if n != text)).withColumn(text, F.coalesce(F.col(f"`{text}`"), F.lit("")))
    extra = [T.StructField("n_tokens", T.LongType())]
    extra += [T.StructField("ids", T.ArrayType(T.IntegerType()))] if output == "ids" else [T.StructField(n, T.StringType()) for n in names[1:]]
    schema = T.StructType([*kept.schema.fields, *extra])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = ChunkEncoder(path)
        for batch in batches:
            texts = batch[text].tolist()
            for part in _slices(texts):
                done = encoder.encode(texts[part])
                more = {"n_tokens": [len(x) // 4 for x in done]}
                if output == "ids":
                    more["ids"] = [np.frombuffer(x, dtype="<u4").astype(np.int32) for x in done]
                else:
                    more["ids_sha256"] = [hashlib.sha256(x).hexdigest() for x in done]
                    more["decoded_sha256"] = [hashlib.sha256(encoder.decode(x)).hexdigest() for x in done]
                yield batch.iloc[part].assign(**more)[schema.names]

    return map_frames(kept, run, schema)


def decode(encoded: DataFrame, ids: str = "ids", tokenizer: str | None = None, into: str = "decoded") -> DataFrame:
    """Decode arrays of ids to texts, special tokens kept; null arrays give empty texts."""
    path = tokenizer or default_tokenizer()
    kept = without(encoded, into)
    schema = T.StructType([*kept.schema.fields, T.StructField(into, T.StringType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        for batch in batches:
            texts = [tokenizer.decode([] if x is None else list(x), skip_special_tokens=False) for x in batch[ids]]
            yield batch.assign(**{into: texts})[schema.names]

    return map_frames(kept, run, schema)


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return encode(docs, output="digests").select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
