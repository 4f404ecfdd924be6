"""Attributes and leaves of the style tree."""

import pytest

from spectraloom.llm import html_text


@pytest.mark.parametrize("attrs", ['style="overflow:hidden"', 'aria-hidden="false"', 'title="the hidden role=search"', 'data-role="search"', "data-hidden", 'data-class="sidebar"', 'class="c" class="sidebar"', "style='visibility: hidden' id=x"])
def test_html_attributes_that_hide_nothing(attrs):
    assert html_text.Page(f"<div {attrs}><article><p>x</p></article></div>").text() == "x"


@pytest.mark.parametrize("attrs", ["hidden", "HIDDEN=''", 'aria-hidden="true"', 'role="search"', "role=search", 'title="a>b" hidden', "class=sidebar", "CLASS = 'sidebar'", "data-x/hidden"])
def test_html_attributes_that_hide(attrs):
    assert html_text.Page(f"<div {attrs}><p>x</p></div><p>y</p>").text() == "y"


def test_html_blocks_that_a_host_repeats_inside_articles(spark):
    page = lambda i: f"<article><h1>Title {i}</h1><p>Read this on our site</p><p>Text {i // 2} of two pages</p><ul><li>Item {i}</li><li>Subscribe now</li></ul></article>"
    rows = [(i, f"http://h.example/{i}", page(i)) for i in range(12)] + [(100 + i, f"http://few.example/{i}", page(i)) for i in range(4)]
    # one article under many menus
    rows += [(200 + i, "http://same.example/", f"<nav>{i}</nav>" + page(1)) for i in range(9)]
    out = html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    for r in out:
        i = r.page_id % 100 if r.page_id < 200 else 1
        own = [f"Title {i}", f"Text {i // 2} of two pages", f"Item {i}"]
        # few.example and same.example have too few pages: both use the tree of all such hosts
        assert r.text.split("\n") == own


def test_html_article_is_not_all_there_is():
    text = lambda h: html_text.Page(h).text()
    assert text('<article><p>teaser</p></article><div id="content"><p>long body</p></div>') == "teaser\nlong body"
    assert text("<div><p>about us</p></div><article><p>all of the long body</p></article>") == "all of the long body"
    # names that articles use as well cut outside of them only
    assert text('<article><p>a</p><div class="related-work"><p>b</p></div><div class="comments">c</div></article><div class="search">d</div>') == "a\nb"
    assert text('<div class="notice">n</div><p>body</p>') == "body"


@pytest.mark.parametrize("bad", ['<a title="x ', "<p class='", "<li><x>", "<", "<a \"'>", "<!--", "<div>", "</q>", "<p>x<b "])
def test_html_hostile_pages_take_linear_time(bad):
    import time

    began = time.process_time()
    html_text.Page(bad * (1_000_000 // len(bad))).text()
    assert time.process_time() - began < 10


def test_html_importance_against_brute_force(spark):
    import collections
    import math
    import re

    # a menu that is the same, a box of two contents, bodies of their own, and a block that most pages have
    page = lambda i: f"<html><body><div class='top'><p>Home</p></div><div class='box'><p>offer {i % 2}</p></div><div class='c'><p>body {i}</p><p>{'tail' if i < 6 else i}</p></div></body></html>"
    rows = [(i, f"http://h.example/{i}", page(i)) for i in range(8)]
    tree, _ = html_text.style_tree(spark.createDataFrame(rows, "page_id long, url string, html string"))
    got = sorted(round(r.importance, 9) for r in tree.collect())
    contents, leaves = collections.defaultdict(collections.Counter), collections.defaultdict(collections.Counter)
    for i, _, source in rows:
        inner = {"top": ["Home"], "box": [f"offer {i % 2}"], "c": re.findall("<p>(.*?)</p>", source)[2:]}
        every = [x for v in inner.values() for x in v]
        for name, said in [("html", every), ("body", every), *inner.items()]:
            contents[name][tuple(said)] += 1
            for x in set(said) if name in inner else ():
                leaves[name][x] += 1
    want = []
    for counts in contents.values():
        n = sum(counts.values())
        entropy = -sum(c / n * math.log(c / n) for c in counts.values()) / math.log(n)
        want.append(round(html_text.CONTENT * entropy, 9))  # all pages have the same children
    want += [round(1 - math.log(d) / math.log(8), 9) for c in leaves.values() for d in c.values() if d > 1]
    assert got == pytest.approx(sorted(want), abs=1e-8)


def test_html_long_pages_and_clashing_columns(spark):
    body = "".join(f"<p>line {i} é</p>" for i in range(30_000))
    rows = [(1, "http://a.example/1", f"<article>{body}</article>", "s", "n", 1), (2, None, None, None, None, None), (2, "", "", None, None, None)]
    out = html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string, site string, _node string, host long"))
    assert out.columns == ["page_id", "url", "text", "n_chars"]
    assert sorted((r.page_id, r.n_chars, r.text.count("\n")) for r in out.collect()) == [(1, sum(len(f"line {i} é") + 1 for i in range(30_000)) - 1, 29_999), (2, 0, 0), (2, 0, 0)]
