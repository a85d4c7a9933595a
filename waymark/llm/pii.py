"""Personal data by weak supervision, in DataFrame functions alone.

Regular expressions propose candidate spans.  Four labelers vote on each (-1, 0 or 1): the strict
form of its kind, a gazetteer, the words before it, and what touches it.  Expectation-maximisation
over the counts of vote patterns estimates how reliable the labelers are and how likely each pattern
means personal data; the posteriors, as soft labels, train the final span classifier (naive Bayes
over features of the span and its surroundings).  Candidates of the four base kinds that pass their
strict form are always spans; the classifier decides on all others.

Null texts count as empty.  An empty table or one without candidates gives no added spans.
Positions count code points, the end exclusive.  Repeated rows give repeated results.  Very long texts are
taken whole, in time that grows with them and their candidates.  Other columns
may have any names; one called spans is replaced by the result of ``find``.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrays import below, let, running
from .common import cut_lineage, packed, table, unpacked

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "ssn", "local_phone", "iban")
LABELERS, PATTERNS, FEATURES, BUCKETS = 4, 81, 6, 64
#: Characters of a text in which spans are replaced at a time.
PIECE = 4096

# The patterns match what the plain ones of the base kinds match, from the same places; possessive
# quantifiers and look-behind keep the time linear and the matcher's stack flat in long runs.
_EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
_IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
_CARD = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?+[0-9]){11,}+"  # at least 12 digits
_PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
_SSN, _LOCAL, _IBAN = r"[0-9]{3}-[0-9]{2}-[0-9]{4}", r"\(?[0-9]{3}\)?[\x20.-][0-9]{3}[.-][0-9]{4}", r"[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}"
_MORE = rf"(?<![A-Za-z0-9+(.-])(?:{_SSN}|{_LOCAL}|{_IBAN})(?![A-Za-z0-9]|-[0-9])"
_OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_IP_FORM = rf"^{_OCTET}\.{_OCTET}\.{_OCTET}\.{_OCTET}$"

# Gazetteers.
_ENDINGS = "com org net edu gov int info io co de fr es uk us it nl eu ch at se ca au jp br in".split()
_ISSUERS = r"^(?:4|5[1-5]|2[2-7]|3[47]|30|36|38|6011|65|62|35)"
_CALLING = r"^\+(?:1|7|20|27|3[0-9]|4[0-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])"
_IBAN_LANDS = "AD AE AT BE BG CH CY CZ DE DK EE ES FI FR GB GR HR HU IE IS IT LI LT LU LV MC MT NL NO PL PT RO SE SI SK SM TR".split()
_CUES = r"(?i)(?:mail|contact|tel|phone|call|fax|mobile|card|visa|amex|mastercard|credit|\bip\b|address|host|ssn|social security|iban|account|write to)\W{0,3}(?:\w+\W{0,3}){0,2}$"
_OTHER_CUES = r"(?i)(?:version|release|isbn|order|invoice|serial|token|key|hash|page|chapter|section|\bv\.?|=\s*\")\W{0,3}(?:\w+\W{0,3}){0,1}$"


def _matches(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def _luhn(digits: Column) -> Column:
    """Whether 12 to 19 digits pass Luhn's test."""
    back = F.reverse(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(back, i, F.lit(1)).cast("int")
        twice = d * 2
        return total + F.when(i % 2 == 1, d).when(twice > 9, twice - 9).otherwise(twice)

    summed = F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add)
    return F.when(F.length(digits).between(12, 19), summed % 10 == 0).otherwise(F.lit(False))


def _strict(kind: Column, v: Column, digits: Column) -> Column:
    n = F.length(digits)
    return F.coalesce(
        F.when(kind == 0, F.lit(True)).when(kind == 1, v.rlike(_IP_FORM)).when(kind == 2, _luhn(digits)).when(kind == 3, n.between(9, 15))
        .when(kind == 4, ~v.rlike("^(?:000|666|9)") & ~v.rlike("-00-|-0000$")).when(kind == 5, ~v.rlike(r"^\(?[01]")).otherwise(F.length(v).between(15, 34)),
        F.lit(False),
    )


def _gazetteer(kind: Column, v: Column) -> Column:
    ending = F.lower(F.element_at(F.split(v, r"\."), -1))
    yes, no = F.lit(1), F.lit(-1)
    return (
        F.when(kind == 0, F.when(ending.isin(_ENDINGS), yes).otherwise(F.lit(0)))
        .when(kind == 1, F.when(v.rlike(r"^(?:0|127|255)\.") | v.rlike(r"^[0-9]\.[0-9]\.[0-9]\.[0-9]$"), no).otherwise(F.lit(0)))
        .when(kind == 2, F.when(v.rlike(_ISSUERS), yes).otherwise(F.lit(0)))
        .when(kind == 3, F.when(v.rlike(_CALLING), yes).otherwise(no))
        .when(kind == 6, F.when(F.substring(v, 1, 2).isin(_IBAN_LANDS), yes).otherwise(no))
        .otherwise(F.lit(0))
    )


def _candidate(kind: Column, v: Column, start: Column, before: Column, after: Column) -> Column:
    """A candidate with its vote pattern (base 3) and the buckets of its features."""
    digits = F.regexp_replace(v, "[^0-9]", "")
    strict = _strict(kind, v, digits)
    last, first = F.right(before, F.lit(1)), F.substring(after, 1, 1)
    glued = last.rlike(r"[A-Za-z0-9\"'=/_]") | first.rlike(r"[A-Za-z0-9\"'=/_]")
    context = F.when(before.rlike(_OTHER_CUES), F.lit(-1)).when(before.rlike(_CUES), F.lit(1)).otherwise(F.lit(0))
    votes = [F.when(strict, 1).otherwise(-1), _gazetteer(kind, v), context, F.when(glued, -1).otherwise(1)]
    pattern = F.lit(0)
    for vote in votes:
        pattern = pattern * 3 + (vote + 1)
    kind_of = lambda c: F.when(c == "", 0).when(c.rlike("[0-9]"), 1).when(c.rlike(r"\w"), 2).when(c.rlike(r"\s"), 3).when(c.rlike("[\"'=/_]"), 4).otherwise(5)
    word = F.lower(F.regexp_extract(before, r"(\w+)\W*$", 1))
    features = [
        F.least(F.length(v), F.lit(BUCKETS - 1)), F.least(F.length(digits), F.lit(BUCKETS - 1)), F.pmod(F.xxhash64(word), F.lit(BUCKETS)).cast("int"),
        kind_of(last), kind_of(first), F.least(F.length(F.regexp_replace(v, "[A-Za-z0-9]", "")), F.lit(BUCKETS - 1)),
    ]
    base = strict & (kind < len(BASE_KINDS))
    return F.struct(kind.cast("int").alias("kind"), start.cast("int").alias("start"), (start + F.length(v)).cast("int").alias("end"), base.alias("base"), pattern.cast("int").alias("pattern"), F.array(*features).alias("f"))


def add_candidates(docs: DataFrame, text: str = "text", into: str = "candidates") -> DataFrame:
    """Add an array of candidates to each row.

    Matches of a pattern and the pieces between them give the positions; pieces are cut only where
    there are matches.  Each step is a column that later steps read more than once.
    """
    others = [F.col(f"`{c}`") for c in docs.columns if c != into]
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    patterns = {"e": _EMAIL, "i": _IP, "c": _CARD, "p": _PHONE, "m": _MORE}
    needs = {"e": F.contains(t, F.lit("@")), "p": F.contains(t, F.lit("+"))}
    none = F.array().cast("array<string>")
    found = {k: F.when(needs[k], _matches(t, p)).otherwise(none) if k in needs else _matches(t, p) for k, p in patterns.items()}
    df = docs.select(*others, *[c.alias(f"_m{k}") for k, c in found.items()])
    m = {k: F.col(f"_m{k}") for k in patterns}
    df = df.select(*others, *m.values(), *[F.when(F.size(m[k]) > 0, F.split(t, p, -1)).otherwise(none).alias(f"_g{k}") for k, p in patterns.items()])
    g = {k: F.col(f"_g{k}") for k in patterns}

    def starts(k: str) -> Column:
        steps = F.transform(m[k], lambda v, i: F.length(v) + F.length(F.get(g[k], i + 1)))
        return F.when(F.size(m[k]) > 0, F.transform(running(steps, F.length(F.get(g[k], F.lit(0))), lambda x, y: x + y), lambda x: x))

    df = df.select(*others, *m.values(), *g.values(), *[starts(k).alias(f"_s{k}") for k in patterns])
    order = {"e": F.lit(0), "i": F.lit(1), "c": F.lit(2), "p": F.lit(3)}

    def all_of(k: str) -> Column:
        def one(v: Column, i: Column) -> Column:
            kind = order.get(k, F.when(v.rlike(f"^{_SSN}$"), 4).when(v.rlike(f"^{_LOCAL}$"), 5).otherwise(6))
            return _candidate(kind, v, F.get(F.col(f"_s{k}"), i), F.right(F.get(g[k], i), F.lit(40)), F.substring(F.get(g[k], i + 1), 1, 4))

        return F.transform(m[k], one)

    return df.select(*others, F.concat(*[all_of(k) for k in patterns]).alias(into))


@dataclass
class Model:
    """The classifier's bias of each kind and weight of each kind, feature and bucket; what EM found."""

    bias: list[float]
    weights: list[float]
    reliability: list[list[list[float]]]  # labeler, class, vote
    posterior: list[float]  # kind, pattern


def expectation_maximisation(counts: dict[tuple[int, int], int], rounds: int = 40) -> tuple[list[list[list[float]]], list[float]]:
    """Reliabilities of the labelers and the posterior of each kind and pattern, from pattern counts."""
    votes = [[pattern // 3 ** (LABELERS - 1 - j) % 3 for j in range(LABELERS)] for pattern in range(PATTERNS)]
    rel = [[[0.6, 0.3, 0.1], [0.1, 0.3, 0.6]] for _ in range(LABELERS)]
    prior = [0.5] * len(KINDS)

    def posterior(kind: int, pattern: int) -> float:
        a, b = math.log(prior[kind]), math.log(1 - prior[kind])
        for j, v in enumerate(votes[pattern]):
            a, b = a + math.log(rel[j][1][v]), b + math.log(rel[j][0][v])
        return 1 / (1 + math.exp(min(b - a, 700)))

    for _ in range(rounds):
        post = {key: posterior(*key) for key in counts}
        # pseudo-counts keep each labeler better than chance when there is little to learn from
        sums = [[[2.0, 1.0, 0.4], [0.4, 1.0, 2.0]] for _ in range(LABELERS)]
        kinds = [[1.0, 1.0] for _ in KINDS]
        for (kind, pattern), n in counts.items():
            p = post[kind, pattern]
            kinds[kind][0] += n * (1 - p)
            kinds[kind][1] += n * p
            for j, v in enumerate(votes[pattern]):
                sums[j][0][v] += n * (1 - p)
                sums[j][1][v] += n * p
        rel = [[[x / sum(row) for x in row] for row in labeler] for labeler in sums]
        prior = [b / (a + b) for a, b in kinds]
    return rel, [posterior(k, p) for k in range(len(KINDS)) for p in range(PATTERNS)]


def fit(candidates: DataFrame, column: str = "candidates") -> Model:
    """Train on all candidates; only counts of patterns and of feature buckets reach the driver."""
    rows = candidates.select(F.explode(column).alias("c")).select("c.kind", "c.pattern", "c.f")
    counts = {(r.kind, r.pattern): r["count"] for r in rows.groupBy("kind", "pattern").count().collect()}  # at most kinds * 81
    reliability, posterior = expectation_maximisation(counts)
    p = F.get(F.lit(posterior), F.col("kind") * PATTERNS + F.col("pattern"))
    one = rows.select("kind", p.alias("p"), F.posexplode("f").alias("feature", "bucket"))
    table_ = one.groupBy("kind", "feature", "bucket").agg(F.sum("p").alias("yes"), F.sum(1 - F.col("p")).alias("no")).collect()  # at most kinds * 6 * 64
    yes, no = [[1.0] * len(KINDS) for _ in range(2)]
    for (kind, pattern), n in counts.items():
        yes[kind] += n * posterior[kind * PATTERNS + pattern]
        no[kind] += n * (1 - posterior[kind * PATTERNS + pattern])
    weights = [0.0] * (len(KINDS) * FEATURES * BUCKETS)
    for r in table_:
        share = math.log((r.yes + 1) / (yes[r.kind] + 8)) - math.log((r.no + 1) / (no[r.kind] + 8))
        weights[(r.kind * FEATURES + r.feature) * BUCKETS + r.bucket] = round(share, 9)
    return Model([round(math.log(a / b), 9) for a, b in zip(yes, no, strict=True)], weights, reliability, posterior)


def add_spans(df: DataFrame, model: Model, column: str = "candidates", into: str = "spans") -> DataFrame:
    """Turn candidates into spans struct(start, kind, end, base), sorted.

    An added span that overlaps a base span is left out.
    """
    weights, bias = F.lit(model.weights), F.lit(model.bias)

    def verdict(c: Column) -> Column:
        at = lambda j: (c["kind"] * FEATURES + j) * BUCKETS + F.get(c["f"], F.lit(j))
        total = F.get(bias, c["kind"])
        for j in range(FEATURES):
            total = total + F.get(weights, at(j))
        return total > 0

    kept = [F.col(f"`{c}`") for c in df.columns if c not in (into, column)]
    c = F.col(column)
    flat = lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end"), x["base"].alias("base"))
    base = F.array_sort(F.transform(F.filter(c, lambda x: x["base"]), flat))

    def whole(bounds: Column) -> Column:
        def free(x: Column) -> Column:
            before = below(bounds["starts"], x["end"])  # base spans that begin before the candidate ends
            return (before == 0) | (F.get(bounds["ends"], before - 1) <= x["start"])

        added = F.transform(F.filter(c, lambda x: ~x["base"] & verdict(x) & free(x)), flat)
        return F.array_sort(F.concat(bounds["base"], added))

    bounds = let(base, lambda b: F.struct(b.alias("base"), F.transform(b, lambda x: x["start"]).alias("starts"), farthest(b).alias("ends")))
    return df.select(*kept, let(bounds, whole).alias(into))


def farthest(spans: Column) -> Column:
    """For each span the greatest end of it and those before it."""
    more = lambda x, y: F.greatest(x, y)
    return let(F.transform(spans, lambda x: x["end"]), lambda ends: F.zip_with(running(ends, F.lit(0), more), ends, more))


def _listed(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    name = lambda s: F.concat(F.get(names, s["kind"]), F.when(~s["base"] & (s["kind"] < len(BASE_KINDS)), "_like").otherwise(""))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", name(s), s["start"].cast("string"), s["end"].cast("string"))), ",")


def find(docs: DataFrame, text: str = "text") -> DataFrame:
    """Per row the other columns (not the text) and its spans; fits on all rows first."""
    kept = [c for c in docs.columns if c != text and c.lower() != "spans"]
    found = cut_lineage(add_candidates(packed(docs, F.col(f"`{text}`").alias("text"), leave=(text,))).drop("text"))
    return add_spans(found, fit(found)).select(*unpacked(kept), "spans")


def merged(spans: Column) -> Column:
    """Spans, sorted, with those that overlap as one struct(start, end, kind) of the first one's kind."""

    def whole(ends: Column) -> Column:
        first = F.filter(F.sequence(F.lit(0), F.size(spans) - 1), lambda i: (i == 0) | (F.get(ends, i - 1) <= F.get(spans, i)["start"]))
        last = lambda firsts, q: F.coalesce(F.get(firsts, q + 1) - 1, F.size(spans) - 1)
        one = lambda firsts: lambda i, q: F.struct(F.get(spans, i)["start"].alias("start"), F.get(ends, last(firsts, q)).alias("end"), F.get(spans, i)["kind"].alias("kind"))
        return let(first, lambda firsts: F.transform(firsts, one(firsts)))

    return let(farthest(spans), whole)


def _marked(text: Column, spans: Column) -> Column:
    """The text with each of its spans, which do not overlap, replaced by its kind in brackets.

    Pieces of ``PIECE`` characters are done one by one, each with the spans that lie in it or reach into it.
    """
    kinds = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])

    def piece(p: Column, i: Column, starts: Column, ends: Column) -> Column:
        begin = i * PIECE
        first = below(ends, begin + 1)  # those before end in earlier pieces
        own = F.slice(spans, first + 1, F.greatest(below(starts, begin + PIECE) - first, F.lit(0)))

        def step(acc: Column, s: Column) -> Column:
            mark = F.when(s["start"] >= begin, F.get(kinds, s["kind"])).otherwise(F.lit(""))
            return F.struct((s["end"] - begin).alias("at"), F.concat(acc["out"], F.substring(p, acc["at"] + 1, F.greatest(s["start"] - begin - acc["at"], F.lit(0))), mark).alias("out"))

        return F.aggregate(own, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, lambda acc: F.concat(acc["out"], F.substring(p, acc["at"] + 1, F.lit(PIECE))))

    pieces = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))
    edges = F.struct(F.transform(spans, lambda s: s["start"]).alias("starts"), F.transform(spans, lambda s: s["end"]).alias("ends"))
    return let(edges, lambda e: F.array_join(F.transform(pieces, lambda p, i: piece(p, i, e["starts"], e["ends"])), ""))


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """The documents with each span replaced by its kind in brackets; n_chars, if there, is renewed.

    The candidates are found once and written with the documents.  A null text has no spans and stays
    null, as its n_chars stays what it was.
    """
    found = cut_lineage(add_candidates(packed(docs, F.col(f"`{text}`").alias("text"))))
    df = add_spans(found, fit(found))
    df = df.select("row", "text", "spans", F.when(F.size("spans") > 0, let(F.col("spans"), merged)).alias("marks"))
    df = df.select("row", F.when(F.col("marks").isNull(), F.col("text")).otherwise(_marked(F.col("text"), F.col("marks"))).alias("clean"))
    new = {text: F.col("clean").alias(text)}
    if "n_chars" in docs.columns and text != "n_chars":
        old = F.col("row").getField("n_chars")
        new["n_chars"] = F.coalesce(F.length("clean").cast(docs.schema["n_chars"].dataType), old).alias("n_chars")
    return df.select(*[new.get(c, o) for c, o in zip(docs.columns, unpacked(docs.columns), strict=True)])


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = find(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("spans", lambda s: s["base"])
    n = lambda k: F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == k))).cast("long").alias(f"n_{BASE_KINDS[k]}")
    return rows.select("doc_id", *[n(k) for k in range(4)], F.sha2(_listed(base), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans"))
