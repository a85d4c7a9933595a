"""URL filter: a few host and path rules, and a logistic regression on hashed character n-grams.

The model is trained from a small table of labelled URLs (``LABELLED``, or a DataFrame of the
caller's), which is bounded by ``most_labelled`` rows; its weights are one array of fixed size.

A null url, or one without "://", has an empty host and path: no rule fits, and the model judges
the empty string.  Urls count whole, however long.  Without labels every score is 0.5.  Repeated rows
give repeated results.  Other columns are kept, except those named as a result, which are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import pack, table, window_hashes, without

#: The rules as host and path, and what they decide.
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))

#: A small labelled table; hosts and paths are made up, none is of a table that is judged.
LABELLED = tuple(
    [(u, "block") for u in (
        "http://casino-lights.example/play/bonus", "https://m.casino-lights.example/slots", "http://best-poker-bonus.example/", "https://lucky-jackpot.example/spin?ref=ad",
        "http://free-slots-online.example/casino/", "http://bets-tonight.example/odds", "http://pills-direct.example/buy-viagra", "https://online-pharmacy-rx.example/pills/discount",
        "http://xxx-videos.example/watch", "https://hot-adult-cams.example/live", "http://sexy-singles.example/dating/adult", "http://free-porn-tube.example/video/1",
        "http://get-rich-quick.example/forex-signals", "https://crypto-doubler.example/invest", "http://win-free-iphone.example/claim-prize", "http://click-here-now.example/offer?aff=1",
        "https://payday-loans-fast.example/apply", "http://replica-watches.example/cheap/rolex", "http://torrent-cracked.example/keygen-download", "https://warez-full.example/crack/serial",
        "http://ads.tracker.example/click?id=1", "https://popup-adserver.example/banner/ad.js", "http://seo-backlinks.example/buy-links", "http://malware-update.example/setup.exe",
        "http://verify-account-login.example/secure/password", "https://spam-deals.example/unsubscribe", "http://weight-loss-miracle.example/diet-pills", "https://casino-royal.example.com/en/12/",
        "http://poker-palace.example.org/fr/40", "https://bargain-pills.example.com/en/9?page=4",
        "https://adult-lounge.example.com/en/31", "http://ads-exchange.example.net/fr/5", "https://www.track-clicks.example.org/de/77.html", "http://m.bets-and-odds.example.com/es/8", "https://casino-nights.example.net/en/640",
        "http://pills-outlet.example.org/fr/19#top", "https://free-adult-chat.example.com/de/2", "http://blog.ad-tracking.example.com/en/90?ref=x", "https://free-bonus-bets.example.org/en/6/",
        "https://casino-spins.example.com/fr/73", "https://www.win-big-casino.example.org/de/4?page=1", "http://adult-films.example.net/en/18", "https://casino-wins.example.org/en/301.html", "http://adult-xxx.example.com/es/5",
    )] + [(u, "allow") for u in (
        "https://www.library.example/catalogue/books", "https://news.example/2024/01/city-council", "https://university.example/research/papers", "https://docs.example/guide/install.html",
        "https://museum.example/exhibits/history", "https://blog.gardening.example/roses", "https://recipes.example/soup/lentil", "https://weather.example/forecast/tomorrow",
        "https://science.example/articles/photosynthesis", "https://school.example/courses/algebra", "https://encyclopedia.example/wiki/River", "https://health.example/advice/vaccination",
        "https://gov.example/services/passport", "https://code.example/project/readme", "https://travel.example/guides/lisbon", "https://music.example/theory/harmony",
        "https://law.example/statutes/2019", "https://blog.marrowick.example.com/en/88?page=3&ref=home", "https://pellard.example.org/en/1790#top",
        "https://quenby.example.com/fr/61", "http://www.ostrander.example.org/en/402", "https://m.wexcombe.example.org/en/73?utm_source=letter", "https://dunmere.example.com/es/955/",
        "http://halvorsen.example.org/de/16.html", "https://news.tamsel.example.org/de/208", "https://carrow.example.com/en/3",
        "https://merrin.example.net/fr/12", "http://m.addlestone.example.com/en/44?page=2", "https://www.tracey.example.net/de/7/", "https://freeling.example.org/es/310#top", "http://blog.betham.example.com/fr/28.html",
        "https://pilling.example.com/en/1501", "https://adelaide.example.org/en/66?utm_source=letter", "http://cassin.example.net/en/9",
        "https://forum.example/thread/9910", "https://archive.example/journal/vol3", "https://maps.example/region/alps", "https://observatory.example/data/stars",
        "https://theatre.example/season/plays", "https://farm.example/produce/apples",
    )]
)

BUCKETS, SIZES = 1 << 16, (3, 4, 5)


def host_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty where there is no "://"."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits as struct(rule, verdict); null where none does."""
    ordered = sorted(rules, key=lambda r: (-len(r[0] + r[1]), r))
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for name, start, verdict in reversed(ordered):
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(start)
        out = F.when(fits, F.struct(F.lit(name + start).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def features(hosts: list[str], paths: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row numbers and distinct buckets of the n-grams of ``^host$`` and ``^path$``, and the rows' sizes."""
    texts = [b"^" + h.encode() + b"$\x00^" + p.encode() + b"$" for h, p in zip(hosts, paths, strict=True)]
    data, ends = pack(texts)
    row_of = np.repeat(np.arange(len(texts)), np.diff(ends))
    keys = []
    for size in SIZES:
        h = window_hashes(data, size)
        same = row_of[: len(h)] == row_of[size - 1 :]
        keys.append(row_of[: len(h)][same] * np.int64(BUCKETS) + (h[same] & np.uint32(BUCKETS - 1)))
    keys = np.unique(np.concatenate(keys)) if keys else np.zeros(0, dtype=np.int64)
    rows = keys // BUCKETS
    return rows, keys % BUCKETS, np.maximum(np.bincount(rows, minlength=len(texts)), 1)


def score(weights: np.ndarray, hosts: list[str], paths: list[str]) -> np.ndarray:
    """Probability that each URL is to be blocked."""
    rows, cols, sizes = features(hosts, paths)
    total = np.bincount(rows, weights=weights[cols], minlength=len(hosts)) / np.sqrt(sizes) + weights[-1]
    return 1 / (1 + np.exp(-total))


def train(hosts: list[str], paths: list[str], blocked: np.ndarray, rounds: int = 1500, rate: float = 4.0, decay: float = 1e-4) -> np.ndarray:
    """Weights of the buckets and, last, the bias; full-batch gradient descent, the same each time."""
    weights = np.zeros(BUCKETS + 1)
    if not len(hosts):
        return weights
    rows, cols, sizes = features(hosts, paths)
    value = 1 / np.sqrt(sizes[rows])
    for _ in range(rounds):
        total = np.bincount(rows, weights=weights[cols] * value, minlength=len(hosts)) + weights[-1]
        gap = (1 / (1 + np.exp(-total)) - blocked) / len(hosts)
        step = np.bincount(cols, weights=gap[rows] * value, minlength=BUCKETS)
        weights[:-1] -= rate * (step + decay * weights[:-1])
        weights[-1] -= rate * gap.sum()
    return weights


def judge(pages: DataFrame, url: str = "url", labelled: DataFrame | None = None, rules=RULES, most_labelled: int = 5000, threshold: float = 0.5) -> DataFrame:
    """Add host, path, rule, verdict and score to the input's columns (which they replace by name).

    ``labelled``: url and label ("block" or "allow"); of it the ``most_labelled`` first by hash are used.
    """
    spark = pages.sparkSession
    if labelled is None:
        labelled = spark.createDataFrame(list(LABELLED), "url string, label string")
    h, p = host_path(F.col("url"))
    rows = labelled.filter(F.col("label").isin("block", "allow")).select(h.alias("h"), p.alias("p"), "label").orderBy(F.xxhash64("h", "p"), "h", "p", "label").limit(most_labelled).collect()
    weights = train([r.h for r in rows], [r.p for r in rows], np.array([r.label == "block" for r in rows], dtype=float))

    @F.pandas_udf("double")
    def blocked(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for a, b in batches:
            yield pd.Series(score(weights, a.tolist(), b.tolist()))

    h, p = host_path(F.col(f"`{url}`"))
    names = tuple(n for n in ("host", "path", "rule", "verdict", "score") if n != url)
    out = without(pages, *names).withColumn("host", h).withColumn("path", p).withColumn("score", blocked("host", "path"))
    found = rule_of(F.col("host"), F.col("path"), rules)
    by_model = F.when(F.col("score") >= threshold, "block").otherwise("allow")
    return out.withColumn("rule", found["rule"]).withColumn("verdict", F.coalesce(found["verdict"], by_model))


def op10_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judge(pages).select("page_id", "host", "path", "rule", "verdict", F.round("score", 6).alias("score"))
