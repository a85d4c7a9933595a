"""Documents packed into sequences of bounded length, shortest pack first over the histogram of lengths.

A document's tokens are its ids and an end id; what exceeds a sequence is cut off as whole sequences.
The pieces that are left are known by their length alone: the histogram of at most ``capacity`` lengths
goes to the driver, however many documents there are.  Lengths are placed longest first, each into the
packs with the most room, and a pack stands for as many sequences as are alike.  Where no pack has room,
new ones are opened.  At the end packs with more than ``SPARE`` tokens of room are filled with the tail
ends of the emptiest, cut to fit, so that one pack at most is left with more; that one is cut at powers of
two, which need no padding.  So padding is below ``SPARE`` tokens a sequence, whatever the lengths.

Pieces of one length are numbered over all tasks, and the patterns, as a table whose size depends on the
capacity alone, are joined back to them by length and number.

Texts are encoded where they are read.  Texts of common characters are encoded by tiktoken, which is three
times as fast, with the vocabulary of the tokenizer's own file; a test holds the two against each other on
each of those characters.  Other texts, and all texts with tokenizers of another kind, are encoded by the
tokenizers library.

Null and empty texts are the end id alone.  Repeated rows are packed each for themselves.  Very long texts are cut
into as many pieces as they need.  Empty tables give empty results.  Columns other than id and text play no
part, whatever their names.  Of pieces with the same length the task and place that read them decide the
number, so the sequence of a document depends on how the input is split; reruns on the same input agree.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, frugal, table

CAPACITY, END = 2048, 1
#: Room that is left in a pack as padding, and not filled by cutting documents.
SPARE = 32
#: Characters of texts that are encoded together.
SLICE = 4_000_000
#: Fixed value: how byte-level vocabularies cut a text before they merge.
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters from this one on may be letters to one library and none to the other.
COMMON = "\u3000"


def default_tokenizer() -> str:
    """Place of the public byte-level vocabulary."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """Encodes texts as the tokenizers library does."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        kind = json.loads(self.tokenizer.to_str())
        self.added = [t["content"] for t in kind["added_tokens"]]
        self.quick = _by_rank(kind)
        self.rare = re.compile(f"[{COMMON}-\U0010ffff]")

    def _common(self, text: str) -> bool:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            if self.rare.search(text):
                return False
        return not any(t in text for t in self.added)

    def encode(self, text: str) -> bytes:
        """The ids of a text as little-endian unsigned 32-bit integers."""
        if self.quick is not None and self._common(text):
            ids = self.quick.encode_ordinary(text)
        else:
            ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return np.array(ids, dtype="<u4").tobytes()


def _by_rank(kind: dict):  # noqa: ANN202
    """A byte-level vocabulary for the library that merges by id; none for a tokenizer of another kind or order of merges."""
    import tiktoken

    before, model = kind["pre_tokenizer"] or {}, kind["model"]
    if kind["normalizer"] or before.get("type") != "ByteLevel" or before["add_prefix_space"] or not before.get("use_regex", True):
        return None
    if model["type"] != "BPE" or model["dropout"] or model["ignore_merges"]:
        return None
    vocabulary, merges = model["vocab"], [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    ids = [vocabulary.get(a + b, -1) for a, b in merges]
    if -1 in ids or ids != sorted(ids) or len(vocabulary) != 256 + len(merges):
        return None
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves; the others follow from 256 on
    bytes_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)).difference(plain)))}
    ranks = {bytes(map(bytes_of.__getitem__, token)): i for token, i in vocabulary.items()}
    return tiktoken.Encoding("by rank", pat_str=BYTE_LEVEL, mergeable_ranks=ranks, special_tokens={})


@dataclass
class Pack:
    """``count`` sequences alike: each slot is a piece (its length, the number of the first one, the part of it taken) and its place."""

    count: int
    used: int = 0
    slots: list[tuple[int, int, int, int, int]] = field(default_factory=list)  # piece length, its first number, start, length, offset

    def split(self, count: int) -> Pack:
        """The first ``count`` sequences; the others stay."""
        first = Pack(count, self.used, self.slots)
        self.count -= count
        self.slots = [(p, r + count, *x) for p, r, *x in self.slots]
        return first

    def put(self, piece: int, number: int, start: int, length: int) -> None:
        self.slots = [*self.slots, (piece, number, start, length, self.used)]
        self.used += length


def padding(used: int, capacity: int = CAPACITY) -> int:
    """Padding of a sequence of that length: powers of two need none."""
    return capacity - used if used & (used - 1) else 0


def shortest_pack_first(histogram: dict[int, int], capacity: int = CAPACITY) -> list[Pack]:
    """Whole pieces placed by their lengths, longest first, into the packs with the most room."""
    by_room: dict[int, list[Pack]] = {}
    for length in sorted(histogram, reverse=True):
        left, number, room = histogram[length], 0, capacity - 1
        while left:
            while room >= length and not by_room.get(room):
                room -= 1
            if room < length:
                pack = Pack(left)
            else:
                pack = by_room[room].pop()
                if pack.count > left:
                    rest, pack = pack, pack.split(left)
                    by_room[room].append(rest)
            pack.put(length, number, 0, length)
            number, left = number + pack.count, left - pack.count
            by_room.setdefault(capacity - pack.used, []).append(pack)
    return [p for packs in by_room.values() for p in packs]


def filled(packs: list[Pack], capacity: int = CAPACITY) -> list[Pack]:
    """Packs with room filled with the tail ends of the emptiest; one at most is left, cut at powers of two."""
    done = [p for p in packs if padding(p.used, capacity) <= SPARE]
    short = sorted((p for p in packs if padding(p.used, capacity) > SPARE), key=lambda p: p.used)
    while short:
        to = short.pop()  # the fullest
        if not short:
            if to.count == 1:
                return done + _at_powers(to)
            short.append(to.split(to.count // 2))
        source = short[0]  # the emptiest
        count = min(to.count, source.count)
        if to.count > count:
            first = to.split(count)
            short.append(to)
            to = first
        if source.count > count:
            rest, source = source, source.split(count)
            short[0] = rest
        else:
            del short[0]
        while source.slots and to.used < capacity:
            piece, number, start, length, offset = source.slots[-1]
            part = min(length, capacity - to.used)
            to.put(piece, number, start + length - part, part)
            source.used -= part
            source.slots = [*source.slots[:-1], (piece, number, start, length - part, offset)] if part < length else source.slots[:-1]
        for p, at in ((source, 0), (to, len(short) + 1)):
            if p.used and padding(p.used, capacity) <= SPARE:
                done.append(p)
            elif p.used:
                short.insert(min(at, len(short)), p)
    return done


def _at_powers(pack: Pack) -> list[Pack]:
    """One sequence as several whose lengths are powers of two."""
    out, slots = [], list(pack.slots)
    for bit in reversed(range(pack.used.bit_length())):
        if pack.used >> bit & 1:
            out.append(Pack(1))
            while out[-1].used < 1 << bit:
                piece, number, start, length, _ = slots.pop(0)
                part = min(length, (1 << bit) - out[-1].used)
                out[-1].put(piece, number, start, part)
                if part < length:
                    slots.insert(0, (piece, number, start + part, length - part, 0))
    return out


def patterns(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, ...]]:
    """(piece length, first number, count, start, length, first sequence, offset) of every slot."""
    rows, sequence = [], 0
    for pack in sorted(filled(shortest_pack_first(histogram, capacity), capacity), key=lambda p: (-p.used, p.slots)):
        rows += [(piece, number, pack.count, start, length, sequence, offset) for piece, number, start, length, offset in pack.slots]
        sequence += pack.count
    return rows


def _slices(lengths: list[int]) -> Iterator[slice]:
    begin = size = 0
    for i, n in enumerate(lengths):
        if size and size + n > SLICE:
            yield slice(begin, i)
            begin, size = i, 0
        size += n
    if begin < len(lengths):
        yield slice(begin, len(lengths))


def pieces(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", tokenizer: str | None = None, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """The tokens of each document, cut where a sequence is full: doc_id, start, length, ids, ids_crc32, doc_tokens, and part, row and nth.

    ``part`` and ``row`` say which task made a piece, and as which; ``nth`` counts its pieces of that length.
    """
    path = tokenizer or default_tokenizer()
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, start long, length int, ids array<int>, ids_crc32 long, doc_tokens long, part int, row long, nth long"
    last = np.array([end], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, row, seen = Encoder(path), TaskContext.get().partitionId(), 0, Counter()
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for piece in _slices([len(t) for t in texts]):
                coded = [encoder.encode(t) + last for t in texts[piece]]
                of, start, length, nth = [], [], [], []
                crc = []
                for i, ids in enumerate(coded):
                    n = len(ids) // 4
                    for at in range(0, n, capacity):
                        size = min(capacity, n - at)
                        of.append(i)
                        start.append(at)
                        length.append(size)
                        crc.append(zlib.crc32(ids[4 * at : 4 * (at + size)]))
                        nth.append(seen[size])
                        seen[size] += 1
                flat = np.frombuffer(b"".join(coded), dtype="<i4")
                ends = np.cumsum([0, *length]).astype(np.int32)
                tokens = np.array([len(x) // 4 for x in coded], dtype=np.int64)[of]
                ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))
                names = batch.column("doc_id")[piece.start : piece.stop].take(pa.array(of, pa.int64()))
                numbers = np.arange(row, row + len(of))
                row += len(of)
                columns = [names, pa.array(start, pa.int64()), pa.array(length, pa.int32()), ids, pa.array(crc, pa.int64()), pa.array(tokens), pa.array(np.full(len(of), part, np.int32)), pa.array(numbers), pa.array(nth, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "length", "ids", "ids_crc32", "doc_tokens", "part", "row", "nth"])

    return rows.mapInArrow(frugal(run), schema)


def _placed(made: DataFrame, capacity: int, scratch: Scratch) -> DataFrame:
    """The pieces with their slots: from (place in the piece), taken, sequence_id and offset; a piece that is cut has several."""
    spark = made.sparkSession
    counts = scratch.keep(made.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n")))
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most ``capacity`` rows
    slots = spark.createDataFrame(patterns(histogram, capacity), "length int, number long, count long, from int, taken int, sequence long, offset long")
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a task and length
    first = counts.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    numbered = made.join(first, ["part", "length"]).withColumn("rank", F.col("first") + F.col("nth"))
    fits = (F.col("rank") >= F.col("number")) & (F.col("rank") < F.col("number") + F.col("count"))
    joined = numbered.alias("p").join(F.broadcast(slots).alias("s"), (F.col("p.length") == F.col("s.length")) & fits)  # bounded by the capacity
    return joined.select("p.*", "from", "taken", (F.col("sequence") + F.col("rank") - F.col("number")).alias("sequence_id"), "offset")


def _crc32(ids: pd.Series) -> pd.Series:
    return ids.map(lambda x: zlib.crc32(np.asarray(x, dtype="<u4").tobytes()))


def pack(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", tokenizer: str | None = None, capacity: int = CAPACITY, end: int = END, output: str = "ids") -> DataFrame:
    """Pieces of documents and their places: doc_id, start, length, doc_tokens, sequence_id, offset, and ``ids`` or, of ``output="digests"``, ids_crc32."""
    scratch = Scratch(docs.sparkSession)
    made = scratch.keep(pieces(docs, doc_id, text, tokenizer, capacity, end))
    light = [c for c in made.columns if c != "ids"]
    placed = _placed(made.select(*light), capacity, scratch)
    names = ["doc_id", (F.col("start") + F.col("from")).alias("start"), F.col("taken").cast("long").alias("length")]
    place = ["doc_tokens", "sequence_id", "offset"]
    ids = F.slice("ids", F.col("from") + 1, F.col("taken"))
    with_ids = lambda some: some.join(made.select("part", "row", "ids"), ["part", "row"])
    if output == "ids":
        return with_ids(placed).select(*names, ids.alias("ids"), *place)
    placed = scratch.keep(placed)
    crc32 = F.pandas_udf(_crc32, "long")
    whole = placed.filter("taken = length").select(*names, "ids_crc32", *place)
    cut = with_ids(scratch.keep(placed.filter("taken < length"))).select(*names, crc32(ids).alias("ids_crc32"), *place)
    return whole.unionByName(cut)


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pack(docs, output="digests").select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
