"""Rules of sources: selectors, steps with provenance, what broken pages give, the registry that ships."""

import random

import pytest
from pyspark.sql import functions as F

from quillstream.sources import registry, rules

PAGE = """<html><head><meta property="og:title" content="T"><meta name='q'></head><body><ul id="l" class="a b"><li class="x">1<li class="y">2 <b>two</b> end<li>3</ul>
<div class="a"><p>p1</p><p lang="tr">p2</p><span>s</span></div><table><tr><th>h<tr><td>c1<td>c2</table></body></html>"""


@pytest.mark.parametrize(
    "selector, found",
    [("li", 3), ("li.y", 1), ("ul.b li", 3), ("ul > li", 3), ("body > li", 0), ("#l", 1), (".a", 2), (".a.b", 1), ("li.x + li", 1), ("p + span", 1), ("p, span", 3), ("[lang]", 1), ("[lang='tr']", 1), ("[lang=de]", 0), ("li:nth-child(2)", 1), ("li:first-child", 1),
     ("li:not(:first-child)", 2), ("tr:not(:first-child) td:nth-child(2)", 1), ("*", 20), ("p:last-child", 0), ("span:last-child", 1), ("meta[property='og:title']", 1), ("div ul li, td", 2), ("nothing", 0), ("DIV.a P", 2)],
)
def test_selectors(selector, found):
    assert len(rules.Page(PAGE).select(selector)) == (found if selector != "*" else len(rules.Page(PAGE).nodes))


def test_scopes_and_lists_of_elements_equal_a_test_of_all():
    draw = random.Random(5)
    marks = ["<ul class='a b'>", "<li class=x>", "<li>", "</li>", "</ul>", "<div id=l class='a a'>", "</div>", "<p lang=tr>", "<p>", "<br>", "<a href=/x>", "</a>", "<i/>", "text", "<table><tr><td>", "<td class=b>", "</table>", "<script>a<b></script>", "<SPAN ID=l>", "</span>"]
    groups = ["li", "*", ".a", "#l", "[lang]", "ul li, .b, td", "ul > li + li", ".a.b", "[class]", "span#l, p:first-child", "li:not(:first-child), li", "DIV.a *"]
    for _ in range(60):
        page = rules.Page("".join(draw.choices(marks, k=40)))
        for group in groups:
            every = [n for n in page.nodes if any(page._chain(n[0], c) for c in rules.compiled(group))]
            assert page.select(group) == [n[0] for n in every]
            for scope in page.nodes:
                assert page.select(group, scope[0]) == [n[0] for n in every if scope[4] <= n[4] and n[7] <= scope[7]]


def test_work_grows_with_the_rows_of_a_listing(monkeypatch):
    visits, parse = [], rules.tree.parse

    class Nodes(list):
        def __iter__(self):
            visits.append(len(self))
            return super().__iter__()

    monkeypatch.setattr(rules.tree, "parse", lambda raw: Nodes(parse(raw)))
    own = rules.Rules([r[1:] for r in registry.RULES if r[0] == "undp"], [r[1:] for r in registry.RULES if r[0] == "*"])

    def work(n):
        visits.clear()
        assert len(own.found('<div class="procurement-item"><a href="/x">x</a><span class="closing">2024-03-01</span><i class="pub-date">2024-02-01</i></div>' * n)) == n + 1
        return sum(visits)

    assert work(200) < 2.2 * work(100)


def test_texts():
    page = rules.Page(PAGE)
    assert page.take("li.y", "text", None) == "2" and page.take("li.y", "texts", None) == "2 two end" and page.take("li", "texts", None) == "1 2 two end 3"
    assert page.take("meta[property='og:title']", "@content", None) == "T" and page.take("meta[name]", "@content", None) == "" and page.take("x", "const", None) == "x"


@pytest.mark.parametrize("text, made", [("2024-02-03", "2024-02-03 00:00:00"), ("2024-02-03T01:00:00+03:00", "2024-02-02 22:00:00"), ("Sat, 03 Feb 2024 10:00:00 GMT", "2024-02-03 10:00:00"), ("Saturday, 03 February 2024 17:47", "2024-02-03 17:47:00"), ("03/02/2024", "2024-02-03 00:00:00"), ("soon", ""), ("", ""), ("0001-01-01T00:00:00+14:00", "")])
def test_dates(text, made):
    assert rules.date(text) == made


def test_the_first_valid_step_counts(spark):
    own = [("s", "page", "at_at", 0, ".a", "text"), ("s", "page", "at_at", 1, ".b", "text"), ("s", "page", "title", 5, "h1", "text"), ("s", "page", "title", 2, "h2", "text"), ("*", "page", "title", 0, "p", "text"), ("*", "page", "more", 0, "p", "text")]
    pages = spark.createDataFrame([(1, "s", "<p class=a>never</p><p class=b>2024-01-02</p><h1>one</h1>"), (2, "t", "<p>x</p>"), (3, None, "<p>y</p>"), (4, "s", None), (5, "s", "<h1>"), (6, "s", "<h2>two<h1>one")], "row int, source string, html string")
    found = {r[0]: (dict(r["values"]), dict(r["steps"])) for r in rules.read(pages.withColumnRenamed("row", "i"), spark.createDataFrame(own, rules.RULES_DDL)).collect()}
    assert found[1] == ({"at_at": "2024-01-02 00:00:00", "title": "one", "more": "never"}, {"at_at": 1, "title": 5, "more": 0})
    assert found[2] == ({"title": "x", "more": "x"}, {"title": 0, "more": 0}) and found[3][0]["title"] == "y" and found[4] == ({}, {}) == found[5] and found[6] == ({"title": "two"}, {"title": 2})


def test_listing_keeps_each_address_once(spark):
    own = [("s", "row", None, 0, "li", None), ("s", "field", "href", 0, "a", "@href"), ("s", "include", None, 0, "/n/", None), ("s", "exclude", None, 0, "/n/x", None)]
    html = '<ul><li><a href="/n/1">a</a><li><a href="https://e.org/n/1">again</a><li><a href="n/2">b</a><li><a href="/n/x">no</a><li><a href="/o/1">no</a><li>none</ul>'
    pages = spark.createDataFrame([(1, "s", "https://e.org/d/p.html", html), (2, "s", "https://e.org/d/p.html", html), (3, "t", "https://e.org/", html), (4, "s", None, html)], "k int, source string, url string, html string")
    table = spark.createDataFrame(own, rules.RULES_DDL)
    rows = sorted((r["k"], r["row"], r["link"]) for r in rules.listing(rules.read(pages, table), table, keys=("k",)).collect())
    assert rows == [(k, n, u) for k in (1, 2) for n, u in ((1, "https://e.org/n/1"), (3, "https://e.org/d/n/2"))] + [(4, 2, "https://e.org/n/1")]


def test_rewriting_is_idempotent(spark):
    rows = spark.createDataFrame([("ecofin", "https://e/a_S.jpg"), ("ecofin", "https://e/a_Generic.jpg"), ("business_in_cameroon", "https://e/a_Generic.jpg"), ("other", "https://e/a_S.jpg"), ("ecofin", None)], "source string, image string")
    once = rules.rewritten(rows, registry.shipped(spark), "image")
    twice = rules.rewritten(once, registry.shipped(spark), "image")
    want = sorted([("ecofin", "https://e/a_Generic.jpg"), ("ecofin", "https://e/a_Generic.jpg"), ("business_in_cameroon", "https://e/a_XL.jpg"), ("other", "https://e/a_S.jpg"), ("ecofin", None)], key=str)
    assert [sorted((tuple(r) for r in x.collect()), key=str) for x in (once, twice)] == [want, want]


def test_a_registry_has_a_bound(spark, monkeypatch):
    monkeypatch.setattr(rules, "MOST_RULES", 3)
    with pytest.raises(ValueError):
        rules.read(spark.createDataFrame([("s", "")], "source string, html string"), registry.shipped(spark))
    assert spark.createDataFrame(registry.RULES, rules.RULES_DDL).filter(F.col("kind") == "row").select("source").distinct().count() == 14


@pytest.mark.parametrize("name", ["tender_listings", "registry_index"])
def test_a_page_is_parsed_once_for_rows_and_following_pages(spark, name):
    from quillstream.plans import QUERIES

    plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "found" in plan and "MapInArrow" not in plan
