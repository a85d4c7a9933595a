"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

The n-grams (of code points, lower case) are hashed.  On a bounded labelled sample each bucket's
document counts give its log-count ratio r; the buckets whose share differs most between the labels
are kept, and a logistic regression is fitted on features that are r where the n-gram occurs.  How much
its weights decay is chosen on folds of that sample, so that no other label takes part in it.  The score
of a text uses its distinct n-grams, from the whole text, however long.

Null texts count as empty and get the bias alone.  Of buckets whose shares differ alike the first are kept;
of decays that do alike the strongest is taken.  An empty table gets no scores.  Without labelled rows every score is 0.5, and a
sample of one label only gives that label's smoothed share.  Repeated rows get repeated results.
Other columns may have any names; one called as the result is replaced.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut_lineage, free_name, frugal, held_out, labelled_sample, map_frames, pack, table, window_hashes, without

BUCKETS, SIZES, KEPT = 1 << 20, (3, 4, 5, 6), 2048
#: The bound of the labelled sample: rows of each label.
MOST_LABELLED = 3000
THRESHOLD = 0.7
#: Decays among which the folds choose, how many folds there are, and the rounds of their fits.
DECAYS, FOLDS, ROUNDS = (1e-3, 3e-4, 1e-4, 3e-5), 3, 150


def _slices(texts: Iterable[bytes], most: int = 2_000_000) -> Iterator[list[bytes]]:
    part, size = [], 0
    for t in texts:
        if part and size + len(t) > most:
            yield part
            part, size = [], 0
        part.append(t)
        size += len(t)
    if part:
        yield part


def _bytes(text: str | None) -> bytes:
    """Code points of a text, four bytes each, a space before and after."""
    return f" {(text or '').lower()} ".encode("utf-32-le", "surrogatepass")


def hits(texts: list[bytes], place: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, feature) pairs of the texts' n-grams.

    ``place`` gives the feature of each bucket, -1 for those left out; without it the buckets are
    the features.
    """
    data, ends = pack(texts)
    data, ends = data.view(np.uint32), ends // 4
    keys = []
    for size in SIZES:
        bucket = (window_hashes(data, size) & np.uint32(BUCKETS - 1)).astype(np.int32)
        feature = bucket if place is None else place[bucket]
        at = np.arange(len(bucket)) if place is None else np.flatnonzero(feature >= 0)
        row = np.searchsorted(ends, at, side="right") - 1
        inside = at + size <= ends[row + 1]
        keys.append(row[inside] * np.int64(BUCKETS) + feature[at[inside]])
    keys = np.unique(np.concatenate(keys))
    return keys // BUCKETS, keys % BUCKETS


def _counts(sample: DataFrame) -> DataFrame:
    """bucket, pos, neg: documents of the sample with each bucket."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((2, BUCKETS), dtype=np.int64)
        for batch in batches:
            for y, group in batch.groupby("y"):
                for part in _slices(map(_bytes, group["text"])):
                    total[int(y)] += np.bincount(hits(part)[1], minlength=BUCKETS)
        at = np.flatnonzero(total.any(axis=0))
        yield pd.DataFrame({"bucket": at, "pos": total[1][at], "neg": total[0][at]})

    return sample.mapInPandas(frugal(run), "bucket long, pos long, neg long").groupBy("bucket").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))


def fit_logistic(x: np.ndarray, y: np.ndarray, decay: float = 1e-4, rounds: int = 400) -> np.ndarray:
    """Weights and, last, the bias, by accelerated gradient descent; the same each time."""
    n, k = x.shape
    x = np.column_stack([x, np.ones(n, dtype=x.dtype)])
    w = np.zeros(k + 1)
    ahead, rate = w.copy(), 4.0 / max(float((x.astype(np.float64) ** 2).sum(axis=1).mean()), 1.0)
    for i in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ ahead.astype(x.dtype), -30, 30)))
        step = (p - y).astype(x.dtype) @ x / n + decay * np.r_[ahead[:-1], 0.0]
        new = ahead - rate * step
        ahead = new + i / (i + 3) * (new - w)
        w = new
    return w


def loss(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> float:
    """Sum of the logarithmic losses of rows under fitted weights."""
    p = 1 / (1 + np.exp(-np.clip(x @ w[:-1].astype(x.dtype) + w[-1], -30, 30).astype(np.float64)))
    return float(-np.log(np.where(y > 0.5, p, 1 - p)).sum())


def choose_decay(x: np.ndarray, y: np.ndarray) -> float:
    """The decay with the least loss on folds that are left out in turn."""
    fold = np.arange(len(y)) % FOLDS
    parts = [(x[fold != k], y[fold != k], x[fold == k], y[fold == k]) for k in range(FOLDS)]
    parts = [p for p in parts if len(p[2]) and 0 < p[1].mean() < 1]
    losses = [sum(loss(tx, ty, fit_logistic(fx, fy, decay, ROUNDS)) for fx, fy, tx, ty in parts) for decay in DECAYS]
    return DECAYS[int(np.argmin(losses))]


class Model:
    """Kept buckets with the weight of each (its ratio times its coefficient), and the bias."""

    def __init__(self, buckets: np.ndarray, weights: np.ndarray, bias: float):
        self.buckets, self.weights, self.bias = buckets, weights, bias

    def place(self) -> np.ndarray:
        at = np.full(BUCKETS, -1, dtype=np.int32)
        at[self.buckets] = np.arange(len(self.buckets))
        return at

    def score(self, texts: list[bytes], place: np.ndarray) -> np.ndarray:
        row, feature = hits(texts, place)
        total = np.bincount(row, weights=self.weights[feature], minlength=len(texts)) + self.bias
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", most: int = MOST_LABELLED, doc_id: str = "doc_id", text: str = "text") -> Model:
    """Fit on at most ``most`` rows of each label; the prior is that of all labels that may be seen."""
    y = F.col(f"`{label}`").cast("int")
    seen = labels.filter(F.col(f"`{doc_id}`").isNotNull() & y.isin(0, 1) & ~held_out(F.col(f"`{doc_id}`"))).agg(F.sum(y).alias("pos"), F.sum(1 - y).alias("neg")).first()
    prior = np.log(((seen.pos or 0) + 1) / ((seen.neg or 0) + 1))
    sample = cut_lineage(labelled_sample(docs, labels, label, most, doc_id, text))
    n = {r.y: r["count"] for r in sample.groupBy("y").count().collect()}
    n_pos, n_neg = n.get(1, 0), n.get(0, 0)
    if not n_pos or not n_neg:
        return Model(np.zeros(0, dtype=np.int64), np.zeros(0), float(prior))
    share = (F.col("pos") / n_pos - F.col("neg") / n_neg) / F.sqrt((F.col("pos") + F.col("neg") + 1) / float(n_pos + n_neg))
    best = _counts(sample).orderBy(F.abs(share).desc(), "bucket").limit(KEPT).toPandas()
    buckets = best["bucket"].to_numpy()
    ratio = np.log((best["pos"].to_numpy() + 1) / (n_pos + 2)) - np.log((best["neg"].to_numpy() + 1) / (n_neg + 2))
    model = Model(buckets, ratio, 0.0)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        place = model.place()
        for batch in batches:
            on = []
            for part in _slices(map(_bytes, batch["text"])):
                row, feature = hits(part, place)
                on += np.split(feature.astype(np.int32), np.searchsorted(row, np.arange(1, len(part))))
            yield pd.DataFrame({"y": batch["y"].to_numpy(), "on": on})

    rows = sample.mapInPandas(frugal(run), "y int, on array<int>").toPandas()  # at most 2 * most rows of KEPT numbers
    x = np.zeros((len(rows), len(buckets)), dtype=np.float32)
    for i, on in enumerate(rows["on"]):
        x[i, on] = ratio[on]
    known = rows["on"].map(lambda on: hash(tuple(sorted(on))))
    order = np.lexsort([known.to_numpy(), rows["y"].to_numpy()])  # rows arrive in any order
    x, y = x[order], rows["y"].to_numpy(float)[order]
    w = fit_logistic(x, y, choose_decay(x, y))
    return Model(buckets, ratio * w[:-1], float(w[-1] + prior - np.log(n_pos / n_neg)))


def score(docs: DataFrame, model: Model, text: str = "text", into: str = "score") -> DataFrame:
    """Add the score of every whole text as ``into``."""
    kept = without(docs, into) if into != text else docs
    schema = T.StructType([*kept.schema.fields, T.StructField(into, T.DoubleType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        place = model.place()
        for batch in batches:
            found = [model.score(part, place) for part in _slices(map(_bytes, batch[text]))]
            yield batch.assign(**{into: np.concatenate(found) if found else np.zeros(0)})[schema.names]

    return map_frames(kept, run, schema)


def reject_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that the classifier does not reject, with the input's columns."""
    into = free_name("_toxicity", docs.columns)
    scored = score(docs, train(docs, labels), into=into)
    return scored.filter(F.col(into) < threshold).select(*[F.col(f"`{c}`") for c in docs.columns])


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
