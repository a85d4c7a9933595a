"""Quality classifier: histogram gradient-boosted trees over document statistics.

The statistics come from the whole text alone.  The trees are grown in numpy on a bounded labelled
sample, binned by its quantiles, and flattened into arrays of features, cuts and leaves that every
task traverses for a batch of documents at once.

Null texts count as empty; their statistics are zeros and they get the score those lead to.  Very long
texts are counted whole.  Without labelled rows every score is 0.5, and a sample of one label gives that
label's smoothed share.  Repeated rows get repeated results; an empty table gives none.  The result
replaces an input column of its name; all other names are free.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import held_out, labelled_sample, map_frames, table, without
from .quality_rules import Counted

#: The bound of the labelled sample: rows of each label.
MOST_LABELLED = 10_000
THRESHOLD = 0.5
TREES, DEPTH, BINS, RATE, LEAST = 80, 4, 64, 0.15, 10

STATISTICS = (
    "log_words", "word_length", "symbols", "repeated", "dup_lines", "distinct", "top_word", "stutter", "upper",
    "digits", "bangs", "bars", "signs", "not_ascii", "line_words", "first_upper",
)


def statistics(text: str | None) -> list[float]:
    """The statistics of one text, in the order of ``STATISTICS``."""
    d = Counted(text)
    n = d.n_words
    if not n:
        return [0.0] * len(STATISTICS)
    data = np.frombuffer(d.text.encode(), dtype=np.uint8)
    of = np.bincount(data, minlength=256)
    chars = max(d.word_chars, 1)
    letters = int(of[65:91].sum() + of[97:123].sum())
    times = Counter(d.words)
    return [
        float(np.log1p(n)), chars / n, d.n_symbols / n, d.n_repeat_words / n, d.n_dup_lines / max(d.n_lines, 1), len(times) / n,
        times.most_common(1)[0][1] / n, sum(map(bytes.__eq__, d.words[1:], d.words)) / n, int(of[65:91].sum()) / max(letters, 1),
        int(of[48:58].sum()) / chars, int(of[33]) / n, int(of[124]) / n, int(of[33:48].sum() + of[58:65].sum() + of[91:97].sum() + of[123:127].sum()) / n,
        int((of[128:].sum())) / len(data), n / max(d.n_lines, 1), sum(65 <= w[0] <= 90 for w in d.words) / n,
    ]


class Trees:
    """Complete binary trees of one depth in arrays: node i has the children 2i + 1 and 2i + 2."""

    def __init__(self, feature: np.ndarray, cut: np.ndarray, leaf: np.ndarray, base: float):
        self.feature, self.cut, self.leaf, self.base = feature, cut, leaf, base

    def score(self, x: np.ndarray) -> np.ndarray:
        total, rows = np.full(len(x), self.base), np.arange(len(x))
        inner = self.feature.shape[1] if len(self.feature) else 0
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf, strict=True):
            node = np.zeros(len(x), dtype=np.int64)
            while len(node) and node[0] < inner:  # all nodes are on one level
                node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
            total += leaf[node - inner]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def grow(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, rate: float = RATE, least: int = LEAST) -> Trees:
    """Boost ``trees`` trees on the logistic loss; the same result for the same rows in any order."""
    n, k = x.shape if x.ndim == 2 else (0, 0)
    pos = float(y.sum())
    base = float(np.log((pos + 1) / (n - pos + 1)))
    inner = 2**depth - 1
    none = Trees(np.zeros((0, inner), int), np.zeros((0, inner)), np.zeros((0, inner + 1)), base)
    if not n or not 0 < pos < n:
        return none
    order = np.lexsort((y, *x.T))
    x, y = x[order], y[order]
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(k)]
    binned = np.column_stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)])  # bin b: at most edges[b]
    total = np.full(n, base)
    features, cuts, leaves = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-total))
        g, h = y - p, p * (1 - p)
        feature, cut, node = np.zeros(inner, int), np.full(inner, np.inf), np.zeros(n, dtype=np.int64)
        for level in range(depth):
            first, wide = 2**level - 1, 2**level
            cell = (node - first)[:, None] * (k * BINS) + np.arange(k) * BINS + binned
            shape = (wide, k, BINS)
            hist = [np.bincount(cell.ravel(), weights=np.repeat(v, k), minlength=wide * k * BINS).reshape(shape).cumsum(axis=2) for v in (g, h, np.ones(n))]
            (gl, hl, nl), (ga, ha, na) = hist, [v[:, :, -1:] for v in hist]
            gain = gl**2 / (hl + 1) + (ga - gl) ** 2 / (ha - hl + 1) - ga**2 / (ha + 1)
            gain[(nl < least) | (na - nl < least)] = 0
            flat = gain.round(9).reshape(wide, -1)
            best = flat.argmax(axis=1)
            for i in range(wide):
                if flat[i, best[i]] > 1e-6:
                    j, b = divmod(int(best[i]), BINS)
                    feature[first + i], cut[first + i] = j, edges[j][b]
            node = 2 * node + 1 + (x[np.arange(n), feature[node]] > cut[node])
        at = node - inner
        leaf = rate * np.bincount(at, weights=g, minlength=inner + 1) / (np.bincount(at, weights=h, minlength=inner + 1) + 1)
        total += leaf[at]
        features.append(feature)
        cuts.append(cut)
        leaves.append(leaf)
    return Trees(np.array(features), np.array(cuts), np.array(leaves), base)


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", most: int = MOST_LABELLED, doc_id: str = "doc_id", text: str = "text") -> Trees:
    """Grow the trees on at most ``most`` rows of each label."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"y": batch["y"].to_numpy(), "x": [statistics(t) for t in batch["text"]]})

    rows = labelled_sample(docs, labels, label, most, doc_id, text).mapInPandas(run, "y int, x array<double>").toPandas()
    if not len(rows):
        return grow(np.zeros((0, len(STATISTICS))), np.zeros(0))
    return grow(np.stack(rows["x"].to_list()), rows["y"].to_numpy(float))


def score(docs: DataFrame, model: Trees, text: str = "text", into: str = "score") -> DataFrame:
    """Add the quality of every whole text, from 0 to 1, as ``into``."""
    kept = without(docs, into) if into != text else docs
    schema = T.StructType([*kept.schema.fields, T.StructField(into, T.DoubleType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x = np.array([statistics(t) for t in batch[text]]).reshape(len(batch), len(STATISTICS))
            yield batch.assign(**{into: model.score(x)})[schema.names]

    return map_frames(kept, run, schema)


def op7_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
