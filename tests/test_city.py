"""The view of every city against SQL for each row's scores and decisions, and plain loops for all that goes by order."""

import pytest
from pyspark.sql import functions as F

from tests import oracle
from tests.test_queries import _QUALITY, _by_city, _deduplicated
from waymark.functions import vocab as v
from waymark.plans import catalog, city

SF = "/root/testdata/sf0.01"
SEEN = """
seen AS (SELECT * REPLACE (CASE WHEN ord % 50 = 7 THEN 'Renamed ' || ord ELSE name END AS name, CASE WHEN ord % 50 = 9 THEN city_lat ELSE lat END AS lat, CASE WHEN ord % 3 = 0 THEN 'seeded' ELSE source END AS source) FROM places WHERE ord % 50 <> 10),
t0 AS"""


def rows_by_city(con):
    scored = catalog.SCORED.replace("\nt0 AS", SEEN).replace("AS br FROM places)", "AS br FROM seen)")
    assert scored.count("FROM seen)") == 1
    first = "CASE WHEN ord % 3 = 0 AND ord % 4 = 0 THEN greatest(score, 72) ELSE score END"
    sql = f"""WITH {scored}, fl AS (SELECT * REPLACE (CASE WHEN ord % 50 = 8 THEN least(100.0, ord % 130) ELSE {first} END AS score, CASE WHEN ord % 3 = 0 AND ord % 4 = 0 THEN 'coffee' ELSE place_type END AS place_type), {catalog._TEXT} AS tx FROM scored),
      ra AS (SELECT s.*, coalesce(nullif(r1.rating, 0), nullif(r2.rating, 0), 0) AS rating FROM fl s LEFT JOIN ratings r1 ON r1.place_id = s.id LEFT JOIN ratings r2 ON r2.place_id = 'part-' || (s.ord - 1000)),
      bo AS (SELECT * REPLACE (CASE rating WHEN 1 THEN 60.0 WHEN 2 THEN 70.0 WHEN 3 THEN 80.0 WHEN 4 THEN 90.0 WHEN 5 THEN 100.0 ELSE CASE WHEN place_type = 'coffee' AND verified THEN 100.0 ELSE score END END AS score, CASE WHEN rating >= 3 THEN 'coffee' ELSE place_type END AS place_type), {catalog._hav('city_lat', 'city_lon', 'lat', 'lon')} AS km FROM ra),
      de AS (SELECT *, {catalog._LISTED} WHEN {catalog._any('tx', v.COFFEE_WORDS)} OR {catalog._any('tx', v.BAKERY_WORDS)} THEN 'coffee/bakery match' END AS decision FROM bo),
      op AS ({catalog.ORACLE['open_status_rank']})
      SELECT ord, id, city, city_key, name, address, lat, lon, tx, source, score, place_type, rating, km, decision, op.open AS open, {_QUALITY.format('score')} AS quality, abs(dlat) AS dlat FROM de LEFT JOIN op USING (id)
      WHERE city_key = (SELECT arg_min(c.city_key, ({catalog._hav('de.lat', 'de.lon', 'c.city_lat', 'c.city_lon')}, c.city_key)) FROM cities c)"""
    return _by_city(con, sql)


def plain_view(rows, least=0.0, text=None, open_now=False):
    poor, far = rows[0]["city_key"] % 7 == 3, rows[0]["city_key"] % 7 == 5
    kept = {r["id"]: r for r in rows}
    curated = _deduplicated([r for r in rows if r["ord"] % 3 == 0 and not poor and not far])
    in_lists = [r for r in rows if r["ord"] % 3 and (not far or r["dlat"] > 0.035)]
    listed = _deduplicated([r for r in in_lists if r["decision"] in ("explicit allowlist", "coffee/bakery match") and r["km"] <= 3.5 and (r["score"] >= least or r["rating"] > 0)])
    wide = _deduplicated([r for r in in_lists if r["km"] <= 7])
    hidden = lambda o: o % 11 == 3 or poor
    shown = [r for r in listed if not hidden(r["ord"]) and not (r["ord"] >= 1000 and (r["ord"] - 1000) % 11 == 3)]
    names = {r["name"].lower() for r in shown}
    order = [r for r in curated if r["name"].lower() not in names] + shown
    displayed = _deduplicated([{**r, "ord": i, "of": r["id"]} for i, r in enumerate(sorted(order, key=lambda r: (r["ord"] % 3 != 0, r["ord"])))])
    displayed = [kept[r["of"]] for r in displayed]
    fine = [r for r in displayed if r["score"] >= least and not any(w in r["tx"] for w in v.EXCLUDED_WORDS) and (not text or text in r["tx"]) and (not open_now or r["source"] == "google" or r["open"])]
    stage, out = next(((s, x) for s, x in zip(city.STAGES, (fine, displayed, listed, wide), strict=True) if x), ("", []))
    if least or text or open_now:
        stage, out = city.STAGES[0], fine
    live = lambda r: 1 if r["source"] == "google" or r["open"] is None else 0 if r["open"] else 2
    later = stage in city.STAGES[2:]
    out = sorted(out, key=lambda r: (live(r), later or r["ord"] % 3 != 0, -r["score"], r["ord"]))
    return [(i, r["id"], float(r["score"]), stage) for i, r in enumerate(out, 1)]


@pytest.mark.parametrize("least,text,open_now", [(0.0, None, False), (50.0, "e", True)])
def test_view_equals_sql_and_plain_loops(spark, least, text, open_now):
    filters = {k: x for k, x in (("text", text), ("open_now", open_now)) if x}
    got = city.see(**city.given(spark, SF), view=city.View(day=3, minute=600, least=least, filters=filters))
    got = {(r.city, r.rank, r.id, round(r.score, 6), city.STAGES[r.stage]) for r in got.collect()}
    want = {(c, i, id_, round(s, 6), stage) for c, rows in rows_by_city(oracle.connect(SF)).items() for i, id_, s, stage in plain_view(rows, least, text, open_now)}
    assert sorted(want - got)[:3] == [] and sorted(got - want)[:3] == []
    assert len(want) > 100 and ({w[4] for w in want} >= {"filtered", "listed", "wide"} if not least else {w[4] for w in want} == {"filtered"})


def test_nothing_to_see(spark):
    given = city.given(spark, SF)
    given["listed"], given["seeded"] = given["listed"].limit(0), given["seeded"].limit(0)
    assert city.see(**given).collect() == []
    given = city.given(spark, SF)
    only = given | {"seeded": given["seeded"].limit(0), "overrides": given["overrides"].limit(0), "hidden": given["hidden"].limit(0), "ratings": given["ratings"].limit(0)}
    top = city.see(**only, top=2)
    assert 0 < top.groupBy("city").count().agg(F.max("count")).first()[0] <= 2
