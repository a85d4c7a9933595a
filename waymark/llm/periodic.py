"""Periodic runs of words, by comparing a text's word numbers with themselves at every lag.

A run is a stretch of words with smallest period q, at least ``min_words`` words and ``min_exp`` periods
long, which no neighbouring word extends.  For each lag up to a ``min_exp``-th of the words, the numbered
words are compared with themselves that far on; a true stretch of the comparison, and the lag's words
after it, are a stretch with that period.  Of one stretch found at several lags the least lag is its
smallest period: the lags of a stretch that is long enough are multiples of it.

The comparisons grow with the square of a text's words.  Texts of over ``long_chars`` characters are
therefore cut into ranges of lags of about ``piece`` comparisons, which Spark deals out; equal long texts
are compared once.  Shorter texts are compared where they are read, without a shuffle.

Null and empty texts have no words and no runs, and collapse to an empty text.  Repeated rows give
repeated results.  Of very long texts nothing is left out.  Empty tables give empty results.  The caller's
columns are kept, except those named as a result (n_words, runs, collapsed), which are replaced.  Runs come
in the order of their start, then of their period; no two have both alike.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WORD, cut_lineage, frugal, packed, table, unpacked

MIN_WORDS, MIN_EXP = 24, 3
#: Characters from which on the lags of a text are dealt out, and comparisons of one range of lags.
LONG_CHARS, PIECE = 100_000, 1_000_000_000
#: Comparisons made at once: the memory that a task needs besides the text.
BLOCK = 1 << 20

RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"
Runs = tuple[np.ndarray, np.ndarray, np.ndarray]


def numbered(text: str | None) -> tuple[list[bytes], np.ndarray]:
    """The words of a text, and a number for each that is the same for equal words."""
    words = (text or "").encode().split()  # bytes split at the six ASCII white-space characters only
    ids = pd.factorize(np.array(words, dtype=object))[0] if words else np.zeros(0)
    return words, ids.astype(np.int32)


def last_lag(n: int, min_exp: int = MIN_EXP) -> int:
    return n // min_exp


def scan(ids: np.ndarray, first: int, last: int, min_words: int = MIN_WORDS, min_exp: int = MIN_EXP) -> Runs:
    """Start, length and period of the stretches that lags from ``first`` to ``last`` show, one a place."""
    n, found = len(ids), []
    if n < min_words or last < first:
        return tuple(np.zeros((3, 0), dtype=np.int64))
    shifted = np.lib.stride_tricks.sliding_window_view(np.concatenate([ids, np.full(last, -1, dtype=ids.dtype)]), n)
    step = max(1, BLOCK // n)
    for low in range(first, last + 1, step):
        same = (shifted[low : min(low + step, last + 1)] == ids).ravel()  # the last word of a lag has no partner: false
        edges = np.flatnonzero(same[1:] != same[:-1]) + 1
        if same[0]:
            edges = np.concatenate([[0], edges])
        begin, end = edges[0::2], edges[1::2]
        lag = begin // n + low
        length = end - begin + lag
        long = length >= np.maximum(min_words, min_exp * lag)
        found.append(np.stack([begin[long] % n, length[long], lag[long]]))
    return smallest(*np.concatenate(found, axis=1))


def smallest(start: np.ndarray, length: np.ndarray, period: np.ndarray) -> Runs:
    """Of equal stretches the one with the smallest period, by start, then period."""
    order = np.lexsort((period, length, start))
    start, length, period = start[order], length[order], period[order]
    new = np.ones(len(start), dtype=bool)
    new[1:] = (start[1:] != start[:-1]) | (length[1:] != length[:-1])
    start, length, period = start[new], length[new], period[new]
    order = np.lexsort((period, start))
    return start[order], length[order], period[order]


def collapsed(words: list[bytes], runs: Runs) -> str:
    """The words left when each run keeps its first period only, joined by one space."""
    start, length, period = runs
    if len(start):
        depth = np.zeros(len(words) + 1, dtype=np.int64)
        np.add.at(depth, start + period, 1)
        np.add.at(depth, start + length, -1)
        words = [words[i] for i in np.flatnonzero(np.cumsum(depth[:-1]) == 0)]
    return b" ".join(words).decode()


def _as_arrow(each: list[Runs]) -> pa.Array:
    flat = [np.concatenate([r[i] for r in each]) if each else np.zeros(0, dtype=np.int64) for i in range(3)]
    ends = np.cumsum([0, *(len(r[0]) for r in each)]).astype(np.int32)
    return pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in flat], ["start", "length", "period"]))


def find_runs(docs: DataFrame, text: str = "text", min_words: int = MIN_WORDS, min_exp: int = MIN_EXP, long_chars: int = LONG_CHARS, piece: int = PIECE) -> DataFrame:
    """The rows of ``docs`` with n_words, runs (array of start, length, period) and the collapsed text."""
    names = ("n_words", "runs", "collapsed")
    own = [c for c in docs.columns if c.lower() not in names]
    rows = packed(docs, F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"), leave=tuple(c for c in docs.columns if c not in own))
    schema = T.StructType([rows.schema["row"], *T.StructType.fromDDL(f"n_words bigint, runs {RUNS}, collapsed string").fields])
    is_long = F.length("text") > long_chars

    def finish(batch: pa.RecordBatch, n: list[int], each: list[Runs], left: list[str]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column("row"), pa.array(n, pa.int64()), _as_arrow(each), pa.array(left, pa.string())], ["row", *names])

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, each, left = [], [], []
            for t in batch.column("text").to_pylist():
                words, ids = numbered(t)
                runs = scan(ids, 1, last_lag(len(ids), min_exp), min_words, min_exp)
                n.append(len(words))
                each.append(runs)
                left.append(collapsed(words, runs))
            yield finish(batch, n, each, left)

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            each = []
            for t, i, of in zip(*(batch.column(c).to_pylist() for c in ("text", "i", "of")), strict=True):
                ids = numbered(t)[1]
                last = last_lag(len(ids), min_exp)
                each.append(scan(ids, i * last // of + 1, (i + 1) * last // of, min_words, min_exp))
            yield pa.RecordBatch.from_arrays([batch.column("key"), _as_arrow(each)], ["key", "runs"])

    def given(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, each, left = [], [], []
            for t, found in zip(batch.column("text").to_pylist(), batch.column("runs").to_pylist(), strict=True):
                words = t.encode().split()
                runs = smallest(*(np.array([r[c] for r in found], dtype=np.int64) for c in ("start", "length", "period")))
                n.append(len(words))
                each.append(runs)
                left.append(collapsed(words, runs))
            yield finish(batch, n, each, left)

    keyed = cut_lineage(rows.filter(is_long).select("row", "text", F.sha2("text", 256).alias("key")))
    n = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("double")
    of = F.greatest(F.lit(1), F.ceil(n * n / (min_exp * piece))).cast("int")
    texts = keyed.select("key", "text").dropDuplicates(["key"]).withColumn("of", of)
    dealt = texts.select("key", "text", "of", F.explode(F.sequence(F.lit(0), F.col("of") - 1)).alias("i")).repartition("key", "i")
    found = dealt.mapInArrow(frugal(ranges), f"key string, runs {RUNS}").groupBy("key").agg(F.flatten(F.collect_list("runs")).alias("runs"))
    long = keyed.join(found, "key").select("row", "text", "runs").mapInArrow(frugal(given), schema)
    done = rows.filter(~is_long).mapInArrow(frugal(whole), schema).unionByName(long)
    return done.select(*unpacked(own), *names)


def strongest(runs: Column) -> Column:
    """The run with the greatest length by period, compared exactly; of several the first.  Null without runs."""
    more = lambda best, r: r["length"] * best["period"] > best["length"] * r["period"]
    return F.aggregate(runs, F.try_element_at(runs, F.lit(1)), lambda best, r: F.when(more(best, r), r).otherwise(best))


def planted(doc_id: Column, text: Column) -> Column:
    """The text in which some documents, by a hash of their id, go on periodically from one of their words."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10)
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    n = F.size(words).cast("long")
    a = F.pmod(g, n)
    p = 1 + F.floor((n - a) / (3 + F.pmod(g, F.lit(8))))
    whole = lambda c: c.cast("int")
    unit = F.slice(words, whole(a + 1), whole(p))
    again = F.slice(F.flatten(F.array_repeat(unit, whole(F.ceil((n - a) / p)))), F.lit(1), whole(n - a))
    changed = F.array_join(F.concat(F.slice(words, F.lit(1), whole(a)), again), " ")
    return F.when((F.pmod(h, F.lit(10)) == 0) & F.regexp_like(text, F.lit(WORD)), changed).otherwise(text)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", planted(F.col("doc_id"), F.col("text")).alias("text"))
    runs = find_runs(docs).withColumn("best", strongest(F.col("runs")))
    lines = F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")))
    return runs.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"), F.col("best.length").alias("length"), F.col("best.period").alias("period"),
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
