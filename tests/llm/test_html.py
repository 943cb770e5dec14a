import random
import re

import pytest

from tests.llm.cases import words
from vellumine.llm import html_template


def page(i, host="news.example.com", marked=False):
    r = random.Random(i)
    title, paras = f"Story {words(i, 4)}", [words(i * 100 + k, r.randint(20, 60)) + " &amp; caf&eacute;" for k in range(r.randint(2, 5))]
    body = "".join(f"<p>{p}" for p in paras)
    article = f"<h1>{title}</h1>{body}"
    article = f"<article>{article}<aside>Related {words(i + 7, 3)}</aside><div class='share'>Share this</div></article>" if marked else f"<div id=c1><div class=x2>{article}</div></div>"
    html = f"""<!DOCTYPE html><html><head><title>{title}</title><style>p > a {{}}</style><script>var a = "</p>" + {i};</script></head><body class="has-sidebar">
<header><a href=/>News</a></header><div class="m9"><a href=/a>Politics</a> <a href=/b>Sport and more</a></div>
<div class="zz"><span>We use small files to make this site work for you</span></div>{article}
<div class="comments"><p>{words(i + 3, 30)}</p></div><form><label>Your mail</label></form>
<div class="qq">All rights reserved by the publisher of this site</div><footer>&copy; {host}</footer></body></html>"""
    want = " ".join([title, *(p.replace("&amp;", "&").replace("&eacute;", "é") for p in paras)])
    return html, want


@pytest.mark.parametrize("marked", [False, True])
def test_slots(spark, marked):
    made = [page(i, marked=marked) for i in range(30)]
    df = spark.createDataFrame([(i, f"https://news.example.com/{i}", h, "x") for i, (h, _) in enumerate(made)], "page_id long, url string, html string, text string")
    got = {r["page_id"]: r for r in html_template.main_text(df).collect()}
    assert all(got[i]["text"] == w and got[i]["n_chars"] == len(w) for i, (_, w) in enumerate(made))


def test_copies_of_an_article_stay(spark):
    html, want = page(1, marked=True)
    df = spark.createDataFrame([(i, f"https://a.example/{i}", html) for i in range(12)], "page_id long, url string, html string")
    assert {r["text"] for r in html_template.main_text(df).collect()} == {want}


def test_awkward_pages(spark):
    rows = [(1, "http://h.example/1", None), (2, None, ""), (None, None, None), (3, "x", "plain text only"), (4, "http://h.example/", "<p>one<p>two<b>bold</b><br>three<!-- no --> &lt;four&gt;&nbsp;five<script>x<y</script"), (5, "http://h.example/", "<div><"), (5, "http://h.example/", "<div><"), (6, "u", "<article><p>" + "word " * 50_000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'x' as host", "'y' as template", "'z' as token")
    got = html_template.main_text(df)
    assert got.columns == ["page_id", "url", "text", "n_chars"] and got.count() == 8
    by = {r["page_id"]: r["text"] for r in got.collect()}
    assert by[1] == by[2] == "" and by[3] == "plain text only" and by[4] == "one twobold three <four> five" and len(by[6]) == 5 * 50_000 - 1
    assert html_template.main_text(df.limit(0)).count() == 0


def test_layout_names_and_page_forms():
    html = "<body><form id=f><div class='page has-sidebar'><nav>Menu</nav><main><p>Text one.</p><form>Mail</form><div class='discussion'>no</div></main><div class=sidebar>side</div></div></form></body>"
    blocks, _ = html_template.parse(html, html_template._Names())
    assert html_template.slots(blocks, frozenset()) == ["Text one."]


def test_copies_of_plain_pages_stay(spark):
    html = f"<html><body><h1>One title</h1><p>{words(1, 40)}</p><p>{words(2, 30)}</p></body></html>"
    near = [html.replace("</body>", f"<p>Seen {i} times</p></body>") for i in range(4)]
    rows = [(i, f"https://a.example/{i}", html) for i in range(3)] + [(10 + i, f"https://b.example/{i}", h) for i, h in enumerate(near)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in html_template.main_text(df).collect()}
    body = f"One title {words(1, 40)} {words(2, 30)}"
    assert [got[i] for i in range(3)] == [body] * 3
    assert [got[10 + i] for i in range(4)] == [f"{body} Seen {i} times" for i in range(4)]


def host_pages(marked):
    """Pages whose names say nothing: opaque menus, adverts and a line inside the article that all pages share."""
    out = []
    for i in range(12):
        r = random.Random(i)
        text = "".join(f"<p>{words(i * 50 + k, r.choice((2, 40)))}</p>" for k in range(1 + i % 4))
        inner = f"<h1>T{words(i, 3)}</h1>{text}<p>Our letter brings you this every week</p>"
        inner = f"<article>{inner}</article>" if marked else f"<div class=q7>{inner}</div>"
        out.append((i, f"https://h.example/{i}", f"<body><div class=k1><a href=/>{words(i + 90, 3)}</a></div><div class=k2>{words(i + 300, 5)}</div>{inner}<div class=k3>{words(i + 600, 14)}</div></body>"))
    return out


@pytest.mark.parametrize("marked", [False, True])
def test_the_template_decides(spark, marked):
    rows = host_pages(marked)
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    t = html_template.templates(df).first()
    known, frames = html_template._keys(t["template"]), html_template._keys(t["regions"])
    assert known and frames
    got = {r["page_id"]: r["text"] for r in html_template.main_text(df).collect()}
    assert got == {r["page_id"]: r["text"] for r in html_template.main_text(df, limit=0).collect()}
    alone = []
    for i, _, h in rows:
        inner = h[h.index("<h1>") : h.index("<p>Our")]
        assert got[i] == " ".join(re.sub("<[^>]*>", " ", inner).split())
        blocks = html_template.parse(h, html_template._Names())[0]
        assert " ".join(html_template.slots(blocks, frozenset())) != got[i]
        alone.append(" ".join(html_template.slots(blocks, known)) == got[i])
    assert all(alone) if marked else not all(alone)


def test_regions_override_names_outside(spark):
    rows = [(i, u, h.replace("class=q7", "class=q7 id=main-widget")) for i, u, h in host_pages(False)]
    got, plain = (html_template.main_text(spark.createDataFrame(x, "page_id long, url string, html string")).collect() for x in (rows, host_pages(False)))
    assert got == plain and all(r["n_chars"] for r in got)


def test_classes_by_brute_force(spark):
    rows = [(i, f"https://{'ab'[i % 2]}.example/{i}", page(i, marked=i % 3 == 0)[0]) for i in range(24)] + [r for r in host_pages(False)]
    rows += [(100 + r[0], r[1], r[2]) for r in rows[:5]]  # copies count once
    hosts = {}
    for _, url, html in rows:
        hosts.setdefault(url.split("/")[2], {})[html] = html_template.parse(html, html_template._Names())
    want = {}
    for host, pages in hosts.items():
        vectors = {}
        for n, (blocks, elements) in enumerate(pages.values()):
            for token in [(False, e) for e in elements] + [(True, b.key) for b in blocks]:
                vectors.setdefault(token, [0] * len(pages))[n] += 1
        classes = {}
        for token, v in vectors.items():
            classes.setdefault(tuple(v), []).append(token)
        fixed = set()
        for v, tokens in classes.items():
            if sum(map(bool, v)) >= max(html_template.LEAST_PAGES, html_template.LEAST_SHARE * len(pages)) and len({t for t, _ in tokens}) == 2:
                fixed |= {k for text, k in tokens if text}
        regions = set()
        for v, tokens in classes.items():
            if max(v) > 1 or sum(v) < max(html_template.LEAST_PAGES, html_template.LEAST_SHARE * len(pages)) or sum(not t for t, _ in tokens) < 2:
                continue
            on = [b for n, (b, _) in enumerate(pages.values()) if v[n]]
            everywhere = sum(b.mass for bs, _ in pages.values() for b in bs if b.key in fixed) * sum(v) / len(pages)
            whole = sum(b.mass for bs in on for b in bs) - everywhere
            for text, k in tokens:
                mass = 0 if text else sum(b.mass for bs in on for b in bs if k in b.paths and b.key not in fixed)
                if mass > 0 and mass >= html_template.MOST * whole:
                    regions.add(k)
        want[host] = (fixed, regions)
        if sum(b.mass for bs, _ in pages.values() for b in bs if b.key in fixed) >= html_template.MOST * sum(b.mass for bs, _ in pages.values() for b in bs):
            want[host] = (set(), regions)
    got = {r["host"]: (set(html_template._keys(r["template"])), set(html_template._keys(r["regions"]))) for r in html_template.templates(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {h: w for h, w in want.items() if w[0] or w[1]}
