import math
import re

import pytest

from tests import oracle
from waymark.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_query_equals_sql(spark, con, name):
    assert oracle.differences(catalog.QUERIES[name](spark, SF), con, catalog.ORACLE[name]) == ""


#: Queries that SQL cannot express; each is held against a plain loop, here, in test_operators, test_search or test_city.
PLAIN = {"rank_places", "geo_dedupe_greedy", "photo_match_best", "photo_replacement", "city_view", "city_view_filtered"}


def test_every_query_has_sql_or_a_plain_loop():
    assert set(catalog.QUERIES) - set(catalog.ORACLE) == PLAIN


def _metres(a, b):
    (la, lo), (lb, lp) = a, b
    h = math.sin(math.radians(lb - la) / 2) ** 2 + math.cos(math.radians(la)) * math.cos(math.radians(lb)) * math.sin(math.radians(lp - lo) / 2) ** 2
    return 2000 * 6371 * math.atan2(math.sqrt(h), math.sqrt(1 - h))


def _plain(s):
    return re.sub(r"[^a-z0-9\s]", "", re.sub(r"\s+", " ", (s or "").strip().lower()))


def _alike(a, b):
    """The rule for two places of one city, by its description; no city of the tables has limits of its own."""
    m = _metres((a["lat"], a["lon"]), (b["lat"], b["lon"]))
    na, nb, aa, ab = _plain(a["name"]), _plain(b["name"]), _plain(a["address"]), _plain(b["address"])
    short, long_ = sorted((na, nb), key=len)
    return (
        aa != "" and aa == ab and m <= 90 or na != "" and na == nb and m <= 90
        or len(short) >= 3 and short not in catalog.v.GENERIC_TOKENS and short in long_ and m <= 90
        or m <= 18 and (na != "" and na == nb or not aa or not ab)
    )


def _deduplicated(rows):
    kept = []
    for r in sorted(rows, key=lambda r: r["ord"]):
        at = next((i for i, k in enumerate(kept) if _alike(k, r)), None)
        if at is None:
            kept.append(r)
        elif r["quality"] > kept[at]["quality"]:
            kept[at] = r
    return kept


_QUALITY = "CASE WHEN trim(coalesce(address, '')) <> '' THEN 50 ELSE 0 END + 10 * CASE source WHEN 'manual' THEN 4 WHEN 'seeded' THEN 3 WHEN 'osm' THEN 2 WHEN 'google' THEN 1 ELSE 0 END + floor({0} / 10 + 0.5)"


def _by_city(con, sql):
    rows = con.sql(sql).df().replace({float("nan"): None}).to_dict("records")
    cities = {}
    for r in rows:
        cities.setdefault(r["city"], []).append(r)
    return cities


def test_rank_places_equals_sql_and_a_plain_walk(spark):
    """Scores, decisions and boosts in SQL, then the walk over duplicates and the order of each city by plain loops."""
    sf = "/root/testdata/sf0.01"
    boosted = "CASE rating WHEN 1 THEN 60.0 WHEN 2 THEN 70.0 WHEN 3 THEN 80.0 WHEN 4 THEN 90.0 WHEN 5 THEN 100.0 ELSE CASE WHEN place_type = 'coffee' AND verified THEN 100.0 ELSE score END END"
    sql = f"""WITH {catalog.SCORED}, {catalog._BOOST}, f AS (SELECT *, {catalog._TEXT} AS tx FROM b WHERE {catalog._hav('city_lat', 'city_lon', 'lat', 'lon')} <= 3.5),
      d AS (SELECT *, {catalog._LISTED} WHEN {catalog._any('tx', catalog.v.COFFEE_WORDS)} OR {catalog._any('tx', catalog.v.BAKERY_WORDS)} THEN 'coffee/bakery match' END AS decision FROM f),
      e AS (SELECT *, {boosted} AS sc, CASE WHEN rating >= 3 THEN 'coffee' ELSE place_type END AS ty FROM d WHERE decision IN ('explicit allowlist', 'coffee/bakery match') AND city_key = (SELECT arg_min(c.city_key, ({catalog._hav('d.lat', 'd.lon', 'c.city_lat', 'c.city_lon')}, c.city_key)) FROM cities c))
      SELECT ord, id, city, name, address, lat, lon, rating, decision, sc, ty, {_QUALITY.format('sc')} AS quality FROM e"""
    want = set()
    for city, rows in _by_city(oracle.connect(sf), sql).items():
        best = sorted(_deduplicated(rows), key=lambda r: (-r["sc"], r["ord"]))[:20]
        want |= {(city, i, r["id"], r["name"], float(r["sc"]), r["ty"], r["decision"], int(r["rating"])) for i, r in enumerate(best, 1)}
    got = {tuple(r) for r in catalog.QUERIES["rank_places"](spark, sf).collect()}
    assert len(want) > 50 and got == want


def test_geo_dedupe_greedy_equals_a_plain_walk(spark):
    sf = "/root/testdata/sf0.01"
    sql = f"WITH {catalog.SCORED} SELECT ord, id, city, name, address, lat, lon, {_QUALITY.format('score')} AS quality FROM scored"
    want = {(r["id"], city, r["name"], float(r["quality"])) for city, rows in _by_city(oracle.connect(sf), sql).items() for r in _deduplicated(rows)}
    got = {tuple(r) for r in catalog.QUERIES["geo_dedupe_greedy"](spark, sf).collect()}
    assert 0 < len(want) < 2000 and got == want
