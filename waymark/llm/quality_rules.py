"""Quality rules in a short-circuit cascade.

A text's base counts are taken once (words, symbols, repeated lines, repeated 8-word windows).
Texts that pass the base test go through the rules until one rejects.  Each rule's cost and
selectivity is measured on a sample, on the executors, and the rules are ordered by rejections per
cost; the order changes the time taken and the first rule named, never the verdict.

Null texts count as empty: no words, so the base test fails and they are not kept.  Very long texts are
counted whole.  Rules that do alike keep the given order.  Repeated rows give repeated results; an empty
table gives none.  Results replace input columns of the same name; all other names are free.
"""

from __future__ import annotations

import re
import time
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_frames, table, without

WINDOW, FEWEST_WORDS, REPEATED_PERCENT = 8, 20, 30
#: Documents on which costs and selectivities are estimated (expected number).
SAMPLE = 400
_SYMBOLS = "#*$%&|<>"
_UPPER, _LETTER, _DIGIT = re.compile("[A-Z]+"), re.compile("[A-Za-z]+"), re.compile("[0-9]+")
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def repeated_words(words: list[bytes], size: int = WINDOW) -> int:
    """Words within windows of ``size`` words that are found twice or more; exact, by doubling."""
    if len(words) < size + 1 or size & (size - 1):
        if size & (size - 1):
            raise ValueError("the window is a power of two")
        return 0
    ids = pd.factorize(np.array(words, dtype=object))[0].astype(np.int64)
    step = 1
    while step < size:
        n = int(ids.max()) + 1
        ids = pd.factorize(ids[:-step] * n + ids[step:])[0].astype(np.int64)
        step *= 2
    twice = np.bincount(ids)[ids] > 1
    if not twice.any():
        return 0
    edge = np.zeros(len(words) + 1, dtype=np.int64)
    at = np.flatnonzero(twice)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + size, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


class Counted:
    """A text with its base counts; what the rules need beyond them is counted when asked for."""

    def __init__(self, text: str | None):
        self.text = text = text or ""
        data = text.encode()
        self.words = data.split()  # bytes split at the six ASCII white-space characters only
        self.n_words = len(self.words)
        self.word_chars = len(text) - sum(text.count(c) for c in " \t\n\v\f\r")
        self.n_symbols = sum(text.count(c) for c in _SYMBOLS)
        lines = [x for x in data.split(b"\n") if x.strip(b" \t\r\v\f")]
        self.n_lines, self.n_dup_lines = len(lines), len(lines) - len(set(lines))
        self.n_repeat_words = repeated_words(self.words)

    @property
    def base_failed(self) -> bool:
        return self.n_words < FEWEST_WORDS or 100 * self.n_repeat_words > REPEATED_PERCENT * self.n_words


def _chars(pattern: re.Pattern, text: str) -> int:
    return sum(map(len, pattern.findall(text)))


#: Rules by name; each says whether it rejects a text.  Thresholds are whole-number ratios.
RULES: dict[str, Callable[[Counted], bool]] = {
    "word_length": lambda d: d.word_chars < 2 * d.n_words or d.word_chars > 25 * d.n_words,
    "symbols": lambda d: 10 * d.n_symbols > d.n_words,
    "dup_lines": lambda d: 2 * d.n_dup_lines > d.n_lines,
    "stutter": lambda d: 10 * sum(map(bytes.__eq__, d.words[1:], d.words)) > 3 * d.n_words,
    "shouting": lambda d: 2 * _chars(_UPPER, d.text) > _chars(_LETTER, d.text),
    "exclamations": lambda d: 4 * d.text.count("!") > d.n_words,
    "digits": lambda d: 4 * _chars(_DIGIT, d.text) > d.word_chars,
    "one_word": lambda d: 10 * Counter(d.words).most_common(1)[0][1] > 3 * d.n_words,
}


def measured(docs: DataFrame, text: str, rules=RULES, sample: int = SAMPLE) -> list[tuple[str, float, float]]:
    """(rule, seconds a document, share rejected) over a random sample of about ``sample`` documents."""
    n = docs.count()
    part = docs.select(F.col(f"`{text}`").alias("text")).sample(fraction=min(1.0, sample / max(n, 1)), seed=1)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        spent, rejected, seen = Counter(), Counter(), 0
        for batch in batches:
            for t in batch["text"]:
                d = Counted(t)
                if d.base_failed:
                    continue
                seen += 1
                for name, rule in rules.items():
                    begin = time.perf_counter()
                    rejected[name] += bool(rule(d))
                    spent[name] += time.perf_counter() - begin
        yield pd.DataFrame([(k, float(spent[k]), float(rejected[k]), float(seen)) for k in rules], columns=["rule", "s", "r", "n"])

    rows = part.mapInPandas(run, "rule string, s double, r double, n double").groupBy("rule").agg(F.sum("s").alias("s"), F.sum("r").alias("r"), F.sum("n").alias("n")).collect()
    found = {x.rule: (x.s / max(x.n, 1), x.r / max(x.n, 1)) for x in rows}
    return [(k, *found.get(k, (0.0, 0.0))) for k in rules]


def ordered(costs: list[tuple[str, float, float]]) -> list[str]:
    """Rule names by rejections per cost, the most first; ties in the given order."""
    return [k for k, _, _ in sorted(costs, key=lambda x: -x[2] / max(x[1], 1e-9))]


def cascade(docs: DataFrame, text: str = "text", rules=RULES, sample: int = SAMPLE) -> DataFrame:
    """Add the base counts, base_failed, kept and rejected_by (the first rule that rejected, or null)."""
    order = ordered(measured(docs, text, rules, sample))
    results = (*BASE, "base_failed", "kept", "rejected_by")
    kept = without(docs, *(n for n in results if n != text))
    kinds = [T.LongType()] * len(BASE) + [T.BooleanType()] * 2 + [T.StringType()]
    schema = T.StructType([*kept.schema.fields, *(T.StructField(n, k) for n, k in zip(results, kinds, strict=True))])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for t in batch[text]:
                d = Counted(t)
                first = "base" if d.base_failed else next((k for k in order if rules[k](d)), None)
                rows.append((*(getattr(d, n) for n in BASE), d.base_failed, first is None, first))
            more = pd.DataFrame(rows, columns=list(results), index=batch.index)
            yield pd.concat([batch, more], axis=1)[schema.names]

    return map_frames(kept, run, schema)


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return cascade(docs).select("doc_id", *BASE, "base_failed", "kept")


OP1_SQL = r"""
WITH t AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines
  FROM documents
), w AS (
  SELECT rid, i, list_aggregate(words[i:i+7], 'string_agg', ' ') AS g
  FROM (SELECT rid, words, unnest(range(1, len(words) - 6)) AS i FROM t)
), d AS (
  SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM w) WHERE c > 1
), r AS (
  SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest(range(i, i + 8)) AS p FROM d) GROUP BY rid
), c AS (
  SELECT t.*, len(words) AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
    len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words,
    length(regexp_replace(text, '[^A-Z]', '', 'g')) AS up, length(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS letters,
    length(regexp_replace(text, '[^0-9]', '', 'g')) AS digits, length(regexp_replace(text, '[^!]', '', 'g')) AS bangs,
    len(list_filter(range(2, len(words) + 1), lambda i: words[i] = words[i - 1])) AS stutter,
    coalesce(list_max(map_values(list_histogram(words))), 0) AS top
  FROM t LEFT JOIN r USING (rid)
), b AS (
  SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM c
)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
  n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
  NOT (base_failed OR word_chars < 2 * n_words OR word_chars > 25 * n_words OR 10 * n_symbols > n_words
    OR 2 * n_dup_lines > n_lines OR 10 * stutter > 3 * n_words OR 2 * up > letters OR 4 * bangs > n_words OR 4 * digits > word_chars
    OR 10 * top > 3 * n_words) AS kept
FROM b
"""
