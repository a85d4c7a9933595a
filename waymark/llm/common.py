"""Helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import os
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A word is a run of characters other than the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"

#: Remainder of crc32(doc_id as text) modulo 3 that is kept out of every fit.
HELD_OUT_FOLD = 1

#: Tasks that share the work on a labelled sample.
SAMPLE_PARTS = 32


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given Parquet tables, read by Spark wherever it lies."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: Column | str) -> Column:
    """True for the rows whose labels no model may see (null ids: false)."""
    key = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(3)) == HELD_OUT_FOLD, F.lit(False))


def n_words(text: Column) -> Column:
    """Number of words of a text as a long; null and empty texts have none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder that all executors share, as the session names it.

    A session without one gets a temporary folder in local mode, as in tests; on a cluster that is an error.
    """
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("spark.checkpoint.dir names no folder that all executors share")
        context.setCheckpointDir(shared or os.path.join(tempfile.gettempdir(), "waymark-checkpoints"))
    return context._jsc.sc().getCheckpointDir().get()


class Scratch:
    """Intermediate tables of one computation, written to the shared folder and read back.

    Their plans begin at files, so lost executors cost no recomputation and the planner knows true
    sizes.  ``drop`` removes tables that are no longer read; the rest goes when the session ends.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}
        self.base = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
        self._files(self.base)[0].deleteOnExit(self._files(self.base)[1])

    def _files(self, path: str):
        jvm = self.spark._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()), at

    def keep(self, df: DataFrame) -> DataFrame:
        path = f"{self.base}/{len(self.paths)}"
        df.write.parquet(path)
        table = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(table)] = path, table
        return table

    def drop(self, *tables: DataFrame) -> None:
        for t in tables or [t for _, t in self.paths.values()]:
            path, _ = self.paths[id(t)]
            files, at = self._files(path)
            files.delete(at, True)


def cut_lineage(df: DataFrame) -> DataFrame:
    """``df`` as a table written to the shared folder."""
    return Scratch(df.sparkSession).keep(df)


def packed(df: DataFrame, *others: Column, leave: tuple[str, ...] = ()) -> DataFrame:
    """The columns of ``df`` (less those of ``leave``) as one struct ``row``, and named columns beside it.

    So an operator's own columns never meet the caller's, whatever those are called.
    """
    return df.select(F.struct(F.lit(True).alias("_"), *[F.col(f"`{c}`") for c in df.columns if c not in leave]).alias("row"), *others)


def unpacked(columns: list[str]) -> list[Column]:
    """The caller's columns out of ``row``."""
    return [F.col("row").getField(c).alias(c) for c in columns]


def free_name(wanted: str, *columns: list[str]) -> str:
    """``wanted``, lengthened until none of ``columns`` has it (case does not matter)."""
    taken = {c.lower() for names in columns for c in names}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def without(df: DataFrame, *names: str) -> DataFrame:
    """``df`` less the columns whose names an operator is about to add (case does not matter)."""
    taken = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in taken])


def frugal(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run`` over a task's batches, after which the worker gives the memory that it took back to the machine.

    Workers live on beside later stages, and their allocators would keep what a task freed: some 300 MB each.
    """

    def wrapped(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(AttributeError):  # other C libraries have no such call
                ctypes.CDLL(None).malloc_trim(0)

    return wrapped


def map_frames(df: DataFrame, run: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], schema: T.StructType) -> DataFrame:
    """``df.mapInPandas`` for columns of any name: a dot in one is no step into a struct.  ``run`` yields the columns of ``schema`` in order."""
    names = df.columns
    plain = T.StructType([T.StructField(f"_{i}", f.dataType, f.nullable) for i, f in enumerate(schema.fields)])

    def named(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch.columns = names
            yield batch

    def renamed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in run(named(batches)):
            yield batch.set_axis(plain.names, axis=1)

    return df.toDF(*[f"_{i}" for i in range(len(names))]).mapInPandas(frugal(renamed), plain).toDF(*schema.names)


def pack(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of ``texts`` end to end, and the offsets at which each begins (one more at the end)."""
    ends = np.cumsum([0, *map(len, texts)], dtype=np.int64)
    return np.frombuffer(b"".join(texts), dtype=np.uint8), ends


def window_hashes(data: np.ndarray, size: int, seed: int = 0) -> np.ndarray:
    """A 32-bit hash of each run of ``size`` bytes, mixed so that its low bits are usable."""
    n = len(data) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint32)
    out = np.full(n, np.uint32((size * 0x9E3779B1 + seed) & 0xFFFFFFFF), dtype=np.uint32)
    for i in range(size):
        out *= np.uint32(0x01000193)
        out += data[i : i + n]
    out ^= out >> np.uint32(15)
    out *= np.uint32(0x2C1B3C6D)
    out ^= out >> np.uint32(13)
    return out


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, most: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(text, y) of at most ``most`` labelled ids of each label, held-out ones never among them.

    The ids are the first by their hash, so the sample does not depend on the order of the input, and
    an id counts once a label: of documents that share it the least text.  Labels other than 0 and 1
    are left out.  The bound is on the labels; their documents are spread over ``SAMPLE_PARTS`` tasks.
    """
    key = F.col(f"`{doc_id}`")
    y = F.col(f"`{label}`").cast("int")
    known = labels.filter(key.isNotNull() & y.isin(0, 1) & ~held_out(key)).select(key.alias("_id"), y.alias("y")).distinct()
    chosen = [known.filter(F.col("y") == v).orderBy(F.xxhash64("_id"), "_id").limit(most) for v in (0, 1)]
    few = F.broadcast(chosen[0].unionByName(chosen[1]))  # at most 2 * most rows of two numbers
    found = docs.select(key.alias("_doc"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text")).join(few, F.col("_doc") == F.col("_id"))
    return found.groupBy("_id", "y").agg(F.min("text").alias("text")).select("text", "y").repartition(SAMPLE_PARTS)
