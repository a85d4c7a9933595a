import unicodedata
from urllib.parse import urljoin

from pyspark.sql import functions as F

from waymark.functions import text
from waymark.operators import audit
from waymark.sources import writers


def plain_fold(s, marks=None):
    return "".join(c for c in unicodedata.normalize("NFKD", s) if not (unicodedata.combining(c) if marks is None else marks[0] <= ord(c) <= marks[1]))


def test_folding_equals_unicode_on_single_characters(spark):
    codes = [*range(0, 0xAC00), *range(0xD7A4, 0xD800), *range(0xF900, 0x10000), *range(0x1D400, 0x1D800), *range(0x2F800, 0x2FA20)]
    df = spark.createDataFrame([(c, chr(c)) for c in codes], "code int, c string")
    for marks in (None, text.LATIN_MARKS):
        got = df.select("code", text.folded(F.col("c"), marks).alias("f"), text.folded(F.concat(F.lit("aÉ"), "c", F.lit("ﬁ é½")), marks).alias("g")).collect()
        wrong = [(hex(r.code), r.f) for r in got if r.f != plain_fold(chr(r.code), marks)]
        assert wrong == []
        assert [hex(r.code) for r in got if r.g != "aE" + plain_fold(chr(r.code), marks) + "fi e1⁄2"] == []


def test_slugs_and_names_lose_their_accents(spark):
    names = {"Café Münster": "cafe-munster", "Zürich": "zurich", "İstanbul": "istanbul", "Ærø ß": "r", "東京": "city", None: "city", "  ": "city", "Łódź ﬁn": "odz-fin", "São-Paulo (SP)": "sao-paulo-sp"}
    df = spark.createDataFrame([(n,) for n in names], "n string")
    assert {r.n: r.s for r in df.select("n", writers.slug(F.col("n")).alias("s")).collect()} == names
    row = df.limit(1).select(text.match_text(F.lit("L’Été & Söhne — 京都")).alias("m"), text.chain_key(F.lit("CAFÉ   Aroma's!")).alias("k"), text.tokens(F.lit("Crème  crème")).alias("t")).first()
    assert (row.m, row.k, row.t) == ("lete and sohne 京都", "cafe aroma s", ["creme"])


REFERENCES = ["g", "./g", "g/", "/g", "//g", "?y", "g?y", "#s", "g#s", "g?y#s", ";x", "g;x", "g;x?y#s", ".", "./", "..", "../", "../g", "../..", "../../", "../../g", "../../../g", "../../../../g", "/./g", "/../g", "g.", ".g", "g..", "..g", "./../g", "./g/.", "g/./h", "g/../h", "g;x=1/./y", "g;x=1/../y", "g?y/./x", "g#s/../x", "http:g", "https://Other.example/a/b?c#d", "mailto:x@y.example", "//h.example", "/", "  /trim  ", "é/ü?ö=1"]


def test_references_are_resolved_as_the_standard_says(spark):
    bases = ["http://a/b/c/d;p?q", "http://a", "http://a/", "https://a.example/x/y/", "http://a/b?c/d#e/f"]
    rows = [(r, b) for r in REFERENCES for b in bases]
    got = spark.createDataFrame(rows, "r string, b string").select("r", "b", text.absolute_url(F.col("r"), F.col("b")).alias("u")).collect()
    wrong = [(x.r, x.b, x.u, urljoin(x.b, x.r.strip())) for x in got if x.u != urljoin(x.b, x.r.strip())]
    assert [w for w in wrong if w[0] != "mailto:x@y.example"] == []
    odd = spark.createDataFrame([("a//b", "http://a/c/"), ("", "http://a/"), (None, "http://a/"), ("g", None), ("g", "rel"), ("http://x/a/../y", None), ("mailto:x@y", "http://a/")], "r string, b string")
    assert [x.u for x in odd.select(text.absolute_url(F.col("r"), F.col("b")).alias("u")).collect()] == ["http://a/c/a//b", None, None, None, None, "http://x/y", "mailto:x@y"]


def test_an_empty_export_replaces_the_places(spark, tmp_path):
    current = spark.createDataFrame([("a", 1.0)], "id string, lat double")
    for name, body in (("empty", "[]"), ("some", '[{"id": "b", "lat": 2}, {"id": "c"}]'), ("broken", "no json"), ("one", '{"id": "d"}')):
        (tmp_path / f"{name}.json").write_text(body)
    got = {n: [r.id for r in writers.import_manual(spark, f"{tmp_path}/{n}.json", current).collect()] for n in ("empty", "some", "broken", "one", "missing")}
    assert got == {"empty": [], "some": ["b", "c"], "broken": ["a"], "one": ["d"], "missing": ["a"]}


def test_each_key_falls_back_by_itself(spark):
    part = lambda rows: spark.createDataFrame(rows, "city string, id int")
    parts = [part([("a", 1)]), part([("a", 2), ("b", 3), (None, 4)]), part([("a", 5), ("b", 6), ("c", 7), (None, 8)])]
    plan = audit.fallback_by(parts, "city")
    assert sorted((r.id, r.stage) for r in plan.collect()) == [(1, 0), (3, 1), (4, 1), (7, 2)]
    assert [r.id for r in audit.fallback_by(parts, "city", filtered=True).collect()] == [1]
