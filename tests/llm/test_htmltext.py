import html
import json
import random
import re

import pytest
from pyspark.sql import functions as F

from seqloom.llm import htmltext as h

PAGES = "page_id long, url string, html string"


def site(i, body, sort=0):
    """Invented templates without <article>: the main element is told by what changes."""
    menu = "".join(f"<li><a href='/{j}'>Item {j}</a></li>" for j in range(3 + i % 3))
    advert = f'<div class="ad-slot">Buy number {i}</div>' if i % 2 else ""
    if sort == 0:
        return (
            f"<html><head><title>t{i}</title></head><body><div class='top-menu'><ul>{menu}</ul></div>{advert}"
            f"<div class='wrap'><div class='c1'>{body}</div><div class='sidebar'><p>Popular {i}</p></div></div>"
            f"<div id='footer'>&copy; {i}</div></body></html>"
        )
    return (
        f"<body><header><h2>Site</h2></header><main><h1>Head {i}</h1>{body}<form><input>Mail</form>"
        f"<section class='comments'><p>Reader {i} says</p></section></main><aside>Links {i}</aside></body>"
    )


BODY = "<p>First &amp; {0}\n  para&eacute;</p><p>Second <b>bo</b>ld {0}<br>line</p><script>x='<p>no</p>'</script><ul><li>one<li>two {0}</ul>"
TEXT = "First & {0} paraé\n\nSecond bold {0} line\n\none\n\ntwo {0}"


def test_wrappers_find_the_changing_element(spark):
    rows = [(i, "http://a.example/%d" % i, site(i, BODY.format(i))) for i in range(7)]
    rows += [(20 + i, "https://u@B.example:80/%d" % i, site(i, BODY.format(i), 1)) for i in range(4)]
    got = {r.page_id: r.text for r in h.extract(spark.createDataFrame(rows, PAGES)).collect()}
    assert {i: got[i] for i in range(7)} == {i: TEXT.format(i) for i in range(7)}
    assert {i: got[20 + i] for i in range(4)} == {i: f"Head {i}\n\n" + TEXT.format(i) for i in range(4)}
    where = {r.host: r.region for r in h.regions(h.infer_wrappers(spark.createDataFrame(rows, PAGES))).collect()}
    assert where["a.example"] == "html/body/div.wrap/div.c1"


def test_both_ways_to_meet_a_wrapper(spark):
    rows = [(i, "http://a.example/%d" % i, site(i, BODY.format(i))) for i in range(6)] + [(9, None, site(1, "<p>x</p>"))]
    pages = spark.createDataFrame(rows, PAGES)
    assert sorted(h.extract(pages).collect(), key=str) == sorted(h.extract(pages, sent=-1).collect(), key=str)


def test_alignment():
    def fold(page):
        return h.page_wrapper(page)

    one = fold("<div><ul><li>a</li><li>b</li><li>c</li></ul><p>x</p></div>")
    two = fold("<div><ul><li>d</li></ul><i>new</i><p>y</p></div>")
    both = h.align(one, two)
    kinds = [n[0] for n in both]
    assert kinds == ["<", "<", "+", ">", "?", "<", "#", ">", ">"]
    assert both[2][1][1][1] is None and both[6][1] is None
    assert h.align(both, two) == both and h.align(both, one) == both
    many = both
    for i in range(60):
        many = h.align(many, fold(f"<div><ul>{'<li>q</li>' * (i % 4)}</ul>{'<i>n</i>' * (i % 2)}<p>{i}</p></div>"))
    assert len(json.dumps(many)) < 600


def test_every_page_of_a_host_is_aligned(spark, monkeypatch):
    """A template of few pages is known whatever comes before it, and rounds leave one wrapper."""
    monkeypatch.setattr(h, "MERGED", 2)
    rare = site(0, "").replace("<div class='c1'></div>", "<section class='s'><h2>H {0}</h2><p>rare {0}</p></section>")
    rows = [(i, "http://a.example/%d" % i, site(i, BODY.format(i))) for i in range(200)]
    rows += [(200 + i, "http://a.example/r%d" % i, rare.format(i)) for i in range(3)]
    pages = spark.createDataFrame(rows, PAGES)
    got = h.infer_wrappers(pages).collect()
    assert [(r.host, r.pages) for r in got] == [("a.example", 203)] and "section.s" in got[0].wrapper
    text = {r.page_id: r.text for r in h.extract(pages).collect()}
    assert text == {i: TEXT.format(i) for i in range(200)} | {200 + i: f"H {i}\n\nrare {i}" for i in range(3)}


def test_long_stretches_are_aligned():
    """Beyond the bound of the exact alignment texts still become slots, and only what one side lacks is optional."""
    dice = random.Random(3)
    tags = [dice.choice("bius") for _ in range(700)]

    def page(edge, word, lacks):
        inner = "".join(f"<{t}>{word} {i}</{t}>" for i, t in enumerate(tags) if i not in lacks)
        return h.page_wrapper(f"<div><{edge}>{edge}</{edge}>{inner}<{edge}>{edge}</{edge}></div>")

    one, two = page("em", "one", {100, 400}), page("dfn", "two", {250})
    both = h.align(one, two)
    slots = sum(n[0] == "#" and n[1] is None for n in both)
    assert slots > 0.9 * sum(n[0] == "#" for n in one) and len(both) < 1.1 * len(one)


@pytest.mark.parametrize(
    "page,want",
    [
        ("", ""),
        ("plain &lt; text", "plain < text"),
        ("<article><header><h1>T</h1></header>a  b<!-- c --><nav>m</nav><p>d</article>e", "T\n\na b\n\nd"),
        ("<article><p>a</p><div class='comment-list'><p>no</p></div><p>b &amp", "a\n\nb &"),
        ("<body><p>cut off <b>here", "cut off here"),
        ("<body><p>a</p><p hidden>b</p><div role='navigation'>c</div><td>d", "a\n\nd"),
        ("<p>1 < 2 > 0</p>", "1 < 2 > 0"),
        ("<style>p{}</style><script>no", ""),
        ("<article><p>" + "w " * 200_000 + "</p></article>", ("w " * 200_000).strip()),
        ("<p>" * 3000 + "deep", "deep"),
        ("<div>" * 3000 + "deep", "deep"),
    ],
)
def test_pages_by_themselves(page, want):
    assert h.main_text(page) == want


def test_edge_rows(spark):
    page = site(1, "<p>x</p>")
    rows = [(1, None, None), (2, "", ""), (3, "not a url", page), (4, "http://h/", page), (4, "http://h/", page), (None, "http://h/", "<p>q</p>")]
    pages = spark.createDataFrame(rows, PAGES).withColumn("text", F.lit(1)).withColumn("host", F.lit("z")).withColumn("_host", F.lit(1))
    got = h.extract(pages).collect()
    assert len(got) == 6 and {(r.page_id, r.url) for r in got} == {(r[0], r[1]) for r in rows}
    assert all(r.text == "" for r in got if r.page_id in (1, 2)) and all("x" in r.text for r in got if r.page_id in (3, 4))
    assert h.extract(spark.createDataFrame([], PAGES)).count() == 0


def test_the_query_agrees_with_brute_force(spark):
    folder = "/root/testdata/sf0.01"
    got = {r.page_id: r for r in h.op9_html_text(spark, folder).collect()}
    pages = spark.read.parquet(f"{folder}/pages.parquet").collect()
    assert len(got) == len(pages)
    for row in pages:
        article = re.search(r"<article>(.*?)</article>", row.html, re.S)[1]
        parts = (" ".join(html.unescape(re.sub(r"<[^>]*>", "", s)).split()) for s in re.split(r"</?(?:p|h1)>|<br>", article))
        want = "\n\n".join(p for p in parts if p)
        assert (got[row.page_id].text, got[row.page_id].n_chars, got[row.page_id].url) == (want, len(want), row.url)


def test_the_wrapper_decides(spark):
    """Templates that no tag or name tells: without the host's wrapper most pages give something else."""
    rows = []
    for i in range(60):
        menu = "".join(f"<li>Item {j}</li>" for j in range(4))
        body = f"<body><div class='x1'><ul>{menu}</ul></div><div class='x2'>{BODY.format(i)}</div><div class='x3'>All rights kept</div></body>"
        rows.append((i, f"http://h{i % 3}.example/{i}", body))
    got = {r.page_id: r.text for r in h.extract(spark.createDataFrame(rows, PAGES)).collect()}
    assert got == {i: TEXT.format(i) for i in range(60)}
    assert all(h.main_text(page) != got[i] for i, _, page in rows)


def test_an_article_is_taken_from_its_place_in_the_wrapper(spark):
    """Articles elsewhere on the page, such as teasers, are not the host's region."""
    rows = [
        (i, f"http://a.example/{i}", f"<body><div class='top'><article>Teaser</article></div><main><article>{BODY.format(i)}</article></main></body>")
        for i in range(5)
    ]
    got = {r.page_id: r.text for r in h.extract(spark.createDataFrame(rows, PAGES)).collect()}
    assert got == {i: TEXT.format(i) for i in range(5)}


@pytest.mark.parametrize("part", ['<a "x', "<a '\"x", "<!x ", "<p '", '"<b>', "<script \"", "</", "<a <b <!-- -"])
def test_malformed_pages_take_time_in_proportion(part):
    import time

    start = time.process_time()
    h.main_text(part * 60_000)
    assert time.process_time() - start < 10
    assert "--" in part or "after" in h.main_text(f"<p class=\"open>shown</p><p>{part}</p> > after")
