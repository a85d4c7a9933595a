import math
import random
import re
import time

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from waymark.llm import html

PAGE = """<!DOCTYPE html><html><head><title>T &amp; U</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href=/>Home</a></li></ul></nav><div class="cookie-notice">We use cookies on this page.</div>
<div class="ad">Buy now and save a lot of money today.</div>%s<aside>Side remarks of some length stand here.</aside>
<form><label>Mail</label><input></form><footer>&copy; 2024</footer></body></html>"""
BODY = "<h1>Title</h1><p><b>First&nbsp;&lt;para\n graph</b> goes on<br>and on, for a good while at least.<p>Short.<p>Last one, with some <i>mark</i>up in the words of it.</p>"
TEXT = "Title First <para graph goes on and on, for a good while at least. Short. Last one, with some markup in the words of it."


def test_article_and_no_boilerplate():
    assert html.main_text(PAGE % f"<article>{BODY}</article>") == TEXT
    assert html.main_text(PAGE % f"<main><article><header>{BODY}</header></article></main>") == TEXT
    assert html.main_text(PAGE % f"<article>{BODY}<div class=ads>Ad</div><section id=comments><p>A reader's words</p></section></article>") == TEXT


def test_region_without_content_element():
    body = BODY.replace("goes on", "goes on " + "and on with many words " * 20)
    assert html.main_text(PAGE % f"<div class=post>{body}</div><div>x</div>") == TEXT.replace("goes on", "goes on " + ("and on with many words " * 20).strip())


def test_all_regions_stay():
    long_, other = "a sentence with many words " * 30, "another sentence of its kind " * 28
    page = lambda body: html.main_text(PAGE % body)
    text = lambda *parts: " ".join(" ".join(parts).split())
    assert page(f"<div>{f'<p>{long_}</p>' * 7}</div><p>a<p>b<p>c<p>d<div><p>{other}</p><p>{other}</p></div>") == text(*[long_] * 7, "a b c d", other, other)
    assert page(f"<article><p>{long_}</p></article><article><p>Short one.</p></article>") == text(long_, "Short one.")
    assert page(f"<main><h1>Heading</h1><article><p>{long_}</p></article><p>End.</p></main>") == text("Heading", long_, "End.")
    assert page(f"<div><p>{long_}</p></div><article><p>{long_}</p></article>") == text(long_, long_)


def test_unclosed_elements():
    assert html.main_text(PAGE.replace("</nav>", "") % f"<article>{BODY}") == TEXT
    assert html.main_text("<p>one<p>two") == "one two"


def test_ratios_decide_where_no_element_does(monkeypatch):
    long_ = "a sentence with many words " * 20
    menu = "<div>" + "".join(f"<div><a href=/{i}>Place {i}</a></div>" for i in range(8)) + "</div>"
    page = f"<html><body>{menu}<div><h2>Heading</h2><p>{long_}</p><p>Short.</p><p>{long_}</p></div>{menu}</body></html>"
    text = " ".join(f"Heading {long_} Short. {long_}".split())
    assert html.main_text(page) == text
    monkeypatch.setattr(html, "threshold", lambda values: values.min())
    assert html.main_text(page) != text


def test_ratio_smoothing_and_threshold_by_plain_loops():
    r = random.Random(4)
    for _ in range(30):
        lines = [("x" * r.randint(1, 400), r.randint(0, 9), 0) for _ in range(r.randint(1, 30))]
        raw = [len(t) / max(n, 1) for t, n, _ in lines]
        want = []
        for i in range(len(raw)):
            w = [(math.exp(-((i - j) ** 2) / 2), raw[j]) for j in range(len(raw)) if abs(i - j) <= 3]
            want.append(sum(a * b for a, b in w) / sum(a for a, _ in w))
        got = html.smoothed(html.ratios(lines), 1.0)
        assert np.allclose(got, want)
        cut = html.threshold(got)
        low, high = [x for x in want if x <= cut], [x for x in want if x > cut]
        if low and high:
            assert abs(cut - (sum(low) / len(low) + sum(high) / len(high)) / 2) < 1e-6 * cut


def test_classes_tell_as_a_whole():
    long_ = "a sentence with many words " * 20
    text = " ".join(long_.split())
    for inner in (f"<div class='notice-board'>{long_}</div>", f"<div class='share-price'>{long_}</div>", f"<p class=notice>{long_}</p>", f"<div class=header>{long_}</div>"):
        assert html.main_text(PAGE % f"<article>{inner}</article>") == text, inner
    for outer in ("has-sidebar", "content-with-sidebar", "page menu-layout"):
        assert html.main_text(f"<div class='{outer}'><p>{long_}</p></div>") == text, outer
    assert html.main_text(f"<div class='menu'><div><article><p>{long_}</p></article></div></div>") == text
    for junk in ("share-links", "comment-list", "left-sidebar", "ad-box-300", "related-articles"):
        assert html.main_text(PAGE % f"<article><p>{long_}</p><div class='{junk}'>{long_}</div></article>") == text, junk
    assert html.main_text(PAGE % f"<article><h2 class=header>Head</h2><p>{long_}</p></article>") == f"Head {text}"


def test_broken_declarations_are_comments():
    for d in ("<![foo[bar]]>", "<![ x]>", "<![CDATA[x]]>", "<![if !IE]>", "<!x>", "<!>", "<![", "<![foo"):
        assert html.main_text(f"<p>a{d}b</p>").startswith("a"), d
    assert html.main_text("<p>a<![foo[bar]]>b</p>") == "ab"


def test_time_follows_the_length_of_deeply_nested_pages():
    begin = time.process_time()
    for page in ("<div>a" * 60_000, "<div>a" * 30_000 + "</b>" * 30_000, "<article><p>a" * 40_000, "<div class=menu>" * 30_000 + "<article>a" * 30_000, "<b><article>a</b>" * 20_000):
        assert html.main_text(page)
    assert time.process_time() - begin < 30


def test_defined_cases(spark):
    rows = [(1, "u", None, "x"), (2, "u", "", "x"), (3, "u", "<nav>a</nav>", "x"), (4, None, "<article>é " + "w " * 200_000 + "</article>", "x"), (4, None, "plain & simple &amp", "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = sorted((r.page_id, r.n_chars, r.text[:20]) for r in html.extract(df).collect())
    assert got == [(1, 0, ""), (2, 0, ""), (3, 0, ""), (4, 16, "plain & simple &"), (4, 400_001, "é w w w w w w w w w ")]
    clash = spark.createDataFrame([(1, "u", "<p>a</p>", "x", 5)], "page_id long, url string, html string, N_Chars string, lines int")
    assert [r.asDict() for r in html.extract(clash).collect()] == [{"page_id": 1, "url": "u", "lines": 5, "text": "a", "n_chars": 1}]
    assert html.extract(df.limit(0)).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="<>/apdivscrt&;![]-\" =é\n", max_size=80))
def test_never_fails(s):
    out = html.main_text(s)
    assert out == " ".join(out.split())


def stripped(page):
    """A page whose elements, classes, ids and roles say nothing of their part in it."""
    page = re.sub(r"<(/?)(?:article|main|nav|header|footer|aside|form|section|menu|dialog|figure)\b", r"<\1div", page, flags=re.I)
    return re.sub(r"\s(?:class|id|role|aria-\w+)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", "", page)


def test_ratios_find_the_same_text_on_pages_without_marks(monkeypatch):
    import pyarrow.parquet as pq

    pages = pq.read_table("/root/testdata/sf0.01/pages.parquet")["html"].to_pylist()
    marked, bare = [html.main_text(p) for p in pages], [html.main_text(stripped(p)) for p in pages]
    assert sum(a == b for a, b in zip(marked, bare, strict=True)) >= 0.96 * len(pages)
    assert all(a in b for a, b in zip(marked, bare, strict=True))
    monkeypatch.setattr(html, "threshold", lambda values: values.min())
    assert sum(html.main_text(stripped(p)) != a for p, a in zip(pages, marked, strict=True)) > 0.5 * len(pages)


def test_loose_lines_do_not_widen_the_region():
    long_ = "a sentence with many words " * 5
    page = f"<body><div>An advert that is long enough to count.</div><div><h2>Head</h2><p>{long_}</p><p>{long_}</p></div><div>An imprint of some length, as they are.</div></body>"
    text = " ".join(f"Head {long_} {long_}".split())
    assert html.main_text(page) == text
    two = page.replace("</body>", f"<div><p>{long_}</p><p>{long_}</p></div></body>")  # another container of its kind does
    assert text in html.main_text(two) and html.main_text(two).endswith(" ".join(f"{long_} {long_}".split()))
