import hashlib
import random
import re
import time

from waymark.llm import pii, queries

PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(d):
    return sum(sum(divmod(int(c) * (2 if i % 2 else 1), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def plain(text):
    out = []
    for k, (kind, pattern) in enumerate(PLAIN.items()):
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else 0, "card": 12 <= len(d) <= 19 and luhn(d) if d else 0, "phone": 9 <= len(d) <= 15}[kind]
            if ok:
                out.append((m.start(), k, m.end(), kind))
    return sorted(out)


def texts():
    r = random.Random(8)
    parts = ["a@b.co", "x.y+z@mail.example.org", "@", "a@b", "a@@b.c", "1.2.3.4", "256.1.1.1", "1.2.3.4.5.6.7.8", "001.02.3.255", "4532015112830366", "4532 0151 1283 0366", "4532-0151-1283-0367", "+1 (377) 555-0271", "+49 30 1234", "+12", "(377) 555-0271", "123-45-6789", "DE89370400440532013000", "é", "日本", "🙂", ".", "-", " ", "\n", "9", "12 34  56", "token = \"0123456789abcdef\"", "mail", "word", "_", "%"]
    out = [None, "", "\n", "a@b.c" * 50, "1" * 30_000, "1 " * 20_000, "a." * 20_000 + "@x.y", "x@" + "a." * 20_000 + "z", "." * 1000 + "1.2.3.4", "+1" + "-" * 5000]
    return out + ["".join(r.choices(parts, k=r.randint(1, 25))) for _ in range(700)] + [" ".join(r.choices(parts, k=r.randint(1, 25))) for _ in range(500)]


def test_base_spans_equal_brute_force(spark, tmp_path):
    given = texts()
    rows = [(i, t, "x") for i, t in enumerate(given)]
    spark.createDataFrame(rows + rows[:2], "doc_id long, text string, spans string").repartition(4).write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.QUERIES["op2_pii"](spark, str(tmp_path)).collect()
    assert len(got) == len(rows) + 2
    for r in got:
        want = plain(given[r.doc_id])
        listed = ",".join(f"{kind}:{a}:{b}" for a, _, b, kind in want)
        assert r.base_sha256 == hashlib.sha256(listed.encode()).hexdigest(), (given[r.doc_id], r.spans, listed)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(x[1] == k for x in want) for k in range(4)]
        assert not want or set(listed.split(",")) <= set(r.spans.split(","))


def test_weak_supervision_adds_and_refuses(spark):
    r = random.Random(1)
    number = lambda: f"{r.randint(200, 600)}-{r.randint(10, 99)}-{r.randint(1000, 9999)}"
    rows = [(i, f"Her SSN {number()} stands here") for i in range(200)] + [(200 + i, f'order token="{number()}"x') for i in range(200)]
    rows += [(400 + i, f"mail a{i}@b.com now") for i in range(100)]
    got = {x.doc_id: x.spans for x in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(len(got[i]) == 1 and got[i][0].kind == 4 for i in range(200)) > 190
    assert sum(len(got[i]) == 0 for i in range(200, 400)) > 190


def test_em_learns_reliabilities():
    r = random.Random(3)
    counts = {}
    for _ in range(20_000):
        y = r.random() < 0.4
        pattern = 0
        for accuracy in (0.95, 0.8, 0.7, 0.55):
            right = r.random() < accuracy
            pattern = pattern * 3 + (2 if y == right else 0)
        counts[0, pattern] = counts.get((0, pattern), 0) + 1
    rel, post = pii.expectation_maximisation(counts)
    for got, want in zip([x[1][2] for x in rel], (0.95, 0.8, 0.7, 0.55), strict=True):
        assert abs(got - want) < 0.05
    assert post[80] > 0.9 > 0.1 > post[0]


def test_redaction_keeps_the_rest(spark):
    given = texts()
    df = spark.createDataFrame([(i, t, len(t or "")) for i, t in enumerate(given)], "doc_id long, text string, n_chars long")
    spans = {r.doc_id: r.spans for r in pii.find(df).collect()}
    out = pii.redact(df)
    assert out.columns == df.columns
    for r in out.collect():
        t = given[r.doc_id]
        if t is None:
            assert r.text is None
            continue
        want, at = "", 0
        for x in spans[r.doc_id]:
            if x.start >= at:
                want += t[at : x.start] + f"[{pii.KINDS[x.kind].upper()}]"
            at = max(at, x.end)
        assert r.text == want + t[at:] and r.n_chars == len(r.text)


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert pii.find(df).count() == 0 and pii.redact(df).count() == 0


def test_redact_with_clashing_columns_nulls_and_no_rows(spark):
    rows = [(1, "mail a@b.com now", "c", "s", "m", 5), (2, None, "c", "s", "m", 7), (3, "", "c", "s", "m", 9), (1, "mail a@b.com now", "c", "s", "m", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _candidates string, _spans string, _me string, n_chars int").repartition(2)
    got = sorted(map(tuple, pii.redact(df).collect()), key=str)
    assert got == sorted([(1, "mail [EMAIL] now", "c", "s", "m", 16), (2, None, "c", "s", "m", 7), (3, "", "c", "s", "m", 0), (1, "mail [EMAIL] now", "c", "s", "m", 16)], key=str)
    clash = df.withColumnRenamed("_spans", "row").withColumnRenamed("_me", "candidates")
    assert pii.redact(clash).columns == clash.columns and {r.row for r in pii.redact(clash).collect()} == {"s"}
    found = pii.find(clash)
    assert found.columns == ["doc_id", "_candidates", "row", "candidates", "n_chars", "spans"] and found.count() == 4
    assert pii.redact(df.limit(0)).count() == 0


def plain_redacted(text, spans):
    out, at = "", 0
    for s in sorted(spans):
        if s.start >= at:
            out += text[at : s.start] + f"[{pii.KINDS[s.kind].upper()}]"
        at = max(at, s.end)
    return out + text[at:]


def test_redaction_equals_a_plain_walk(spark, monkeypatch):
    rows = [(i, t) for i, t in enumerate(texts()) if t]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    spans = {r.doc_id: r.spans for r in pii.find(df).collect()}
    for piece in (7, 4096):  # spans reach over pieces
        monkeypatch.setattr(pii, "PIECE", piece)
        got = {r.doc_id: r.text for r in pii.redact(df).collect()}
        assert [i for i, t in rows if got[i] != plain_redacted(t, spans[i])] == []


def test_many_spans_in_one_text(spark):
    """Time grows with the spans: 50,000 in one text once took a minute."""
    parts = ["10.2.3.4", "999.1.1.1", "a@b.co", "+1 415 555 2671", "123-45-6789"]
    text = " ".join(parts[i % 5] for i in range(50_000)) + " é"
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    begin = time.perf_counter()
    row = pii.find(df).first()
    assert [(s.start, s.kind, s.end) for s in row.spans if s.base] == [(a, k, b) for a, k, b, _ in plain(text)]
    assert pii.redact(df).first().text == plain_redacted(text, row.spans)
    assert time.perf_counter() - begin < 40
