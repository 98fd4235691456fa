"""Main text of pages: whole pages by hand, densities against a recursive computation, and the given pages."""

import html
import math
import re
from html.parser import HTMLParser

import pyarrow.parquet as pq

from prepcast.llm import html_density
from prepcast.llm.html_density import BLOCK, RESULT, Tree, extract, main_text

LONG = "Rivers carry stones and silt from the hills down to the plain, where they slow and drop them in broad fans."
MORE = "Farmers on the fans dig wells between the old channels & store the water of spring floods in ponds."
ARTICLE = f"<h1>Stones</h1><p>{LONG}</p>\n<p>{MORE.replace('&', '&amp;')}</p><ul><li>silt</li><li>sand</li></ul>"
WANT = "\n\n".join(["Stones", LONG, MORE, "silt", "sand"])
MENU = '<ul><li><a href="/a">Home</a></li><li><a href="/b">News of today</a></li><li><a href="/c">About us</a></li></ul>'


def test_a_page_with_every_part():
    page = f"""<!doctype html><html><head><title>no</title><style>p{{}}</style></head><body class="has-sidebar comments-open">
    <header><h1>The Site</h1>{MENU}</header><div class="cookie-notice">We use cookies on this site, do you agree to all of them?</div>
    <main><article class="post comments-open">{ARTICLE}<div class="ad">Buy a very long advert sentence that never seems to end at all.</div>
    <form><label>Mail</label><input><button>Send</button> Join our letter</form><script>if (a < b) {{ p("</p>") }}</script>
    <section id="comments"><h2>Comments</h2><article class="comment"><p>I was first, and this comment of a reader is rather long too.</p></article></section>
    </article><aside><p>{LONG}</p></aside></main><footer>&copy; The Site, all rights reserved by its owners.</footer></body></html>"""
    assert main_text(page) == WANT


def test_a_page_of_plain_divisions():
    page = f"""<html><body><div id="top"><a href="/">The Site</a> {MENU}</div><div id="wrap"><div class="left">{MENU}</div>
    <div class="story">{ARTICLE}</div></div><div>Imprint <a href="/i">here</a></div></body></html>"""
    assert main_text(page) == WANT


def test_text_in_the_body_and_broken_markup():
    assert main_text(f"{LONG}<br>\n<br>{MORE}") == f"{LONG} {MORE}"
    assert main_text(f"<body><p>{LONG}<p>{MORE.replace('&', '&#38;')}") == f"{LONG}\n\n{MORE}"
    assert main_text(f"<article><p><b>{LONG}<br><p>{MORE}</b></article") == f"{LONG}\n\n{MORE}"
    assert main_text(f"<article><p>{LONG}</p><p>cut &am") == f"{LONG}\n\ncut &am"
    assert main_text(f'<article><p>{LONG}</p><p title="never closed>{MORE}</p></article>') == f"{LONG}\n\n{MORE}"
    assert main_text(f"<article><p>{LONG}</p><!-- open {MORE}") == LONG
    assert main_text("<p>5 < 6 and a&nbsp;b</p>") == "5 < 6 and a b"
    assert main_text(f"<article><p><a href=x>{LONG}<p>{MORE}</a></article>") == f"{LONG}\n\n{MORE}"
    assert [main_text(x) for x in (None, "", "   ", "<html></html>", "<nav>a</nav>", "<script>x", "<", "</", "<!")] == [""] * 9


def test_deep_and_long_pages_end():
    assert main_text("<div>" * 50_000 + LONG) == LONG
    assert main_text("<i><div>" + "<b>" * 20_000 + "</i>" * 20_000 + LONG) == LONG
    assert main_text('<a t="' * 20_000 + LONG) == ""
    assert main_text(f"<p>{LONG}</p>" * 20_000) == "\n\n".join([LONG] * 20_000)


class Reader(HTMLParser):
    """Nested lists (name, children) of well-formed markup."""

    def __init__(self, page):
        super().__init__()
        self.open = [("html", [])]
        self.feed(page)
        self.close()

    def handle_starttag(self, tag, attrs):
        node = (tag, [])
        self.open[-1][1].append(node)
        if tag not in ("br", "img"):
            self.open.append(node)

    def handle_endtag(self, tag):
        self.open.pop()

    def handle_data(self, data):
        self.open[-1][1].append(data)


def test_densities_equal_a_recursive_computation():
    page = f"<body><div>{MENU}</div><div><p>{LONG} <a href=x>see</a></p><p>{MORE}<br>end</p><section><h2>More</h2>text <b>here</b></section></div><p>tail <a>x</a></p></body>"
    size = lambda x: len(" ".join(html.unescape(x).split()))
    found = []

    def walk(node, linked):
        if isinstance(node, str):
            return [size(node), 0, size(node) * linked, 0]
        at = len(found)
        found.append(None)
        sums = [0, 0, 0, 0]
        for child in node[1]:
            own = walk(child, linked or node[0] == "a")
            extra = [0, 0, 0, 0] if isinstance(child, str) else [0, 1, 0, child[0] == "a"]
            sums = [a + b + c for a, b, c in zip(sums, own, extra)]
        found[at] = (node[0], *sums)
        return sums

    tree = ("html", Reader(page).open[0][1])
    total = walk(tree, False)
    share = total[2] / total[0]
    seen = []
    real = html_density.density
    html_density.density = lambda c, t, lc, lt, of: seen.append((c, t, lc, lt, of, real(c, t, lc, lt, of))) or seen[-1][-1]
    try:
        html_density.main_blocks(Tree(page))
    finally:
        html_density.density = real
    for (name, c, t, lc, lt), got in zip(found, seen):
        assert got[:5] == (c, t, lc, lt, share), name
        if c:
            base = math.log(c / max(c - lc, 1) * lc + share * c + math.e**2)
            assert math.isclose(got[5], c / max(t, 1) * math.log(max(1, c / max(lc, 1) * max(t, 1) / max(lt, 1)), base), abs_tol=1e-9)


def test_the_article_of_every_given_page(spark):
    path = "/root/testdata/sf0.01/pages.parquet"
    raw = pq.read_table(path).to_pylist()
    got = {r["page_id"]: r for r in extract(spark.read.parquet(path)).collect()}
    assert len(got) == len(raw)
    for x in raw:
        inner = x["html"].split("<article>")[1].split("</article>")[0]
        inner = re.sub(r"<[^>]*$", "", inner)
        parts = re.split("|".join(rf"</?{b}\b[^>]*>" for b in sorted(BLOCK)), inner)
        parts = (" ".join(html.unescape(re.sub("<[^>]*>", " ", b)).split()) for b in parts)
        want = "\n\n".join(b for b in parts if b)
        r = got[x["page_id"]]
        assert (r["text"], r["n_chars"], r["url"]) == (want, len(want), x["url"])


def test_nulls_repeats_and_further_columns(spark):
    rows = [(1, "u", f"<p>{LONG}</p>", "t"), (1, "u", f"<p>{LONG}</p>", "t"), (None, None, None, None), (2, None, "", "x")]
    got = extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string"))
    assert got.schema.simpleString() == "struct<page_id:bigint,url:string,text:string,n_chars:bigint>"
    assert sorted(map(tuple, got.collect()), key=str) == sorted([(1, "u", LONG, len(LONG))] * 2 + [(None, None, "", 0), (2, None, "", 0)], key=str)
    assert extract(spark.createDataFrame([], "page_id long, url string, html string")).columns == [c.split()[0] for c in RESULT.split(", ")]
    assert extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
