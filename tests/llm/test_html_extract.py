from __future__ import annotations

import html
import re

import pytest

from quirespark.llm import html_extract as H
from quirespark.llm import labelled_pages as L

MENU, FOOT = (x.replace("[-1]", "One").replace("[-2]", "Two words").replace("[-6]", "The press of the old town") for x in (L.MENU, L.FOOT))
P, Q = "The road ran north along the river and then turned west into the hills.", "No one had walked it for a year, as far as they knew."


@pytest.mark.parametrize("page, text", [
    (None, ""), ("", ""), ("plain", "plain"), ("<p>x", "x"),
    (f"<article><h1>T &amp; t</h1><p>{P}<br>on&nbsp; &#8364;\n\n {Q}</article>", f"T & t\n{P} on € {Q}"),
    (f"{MENU}<article><p>{P}</p><p>So.</p></article>{FOOT}", f"{P}\nSo."),
    (f"<div class='page has-sidebar'><article><p>{P}</p><aside>{Q}</aside><p>End.</p></article></div>", f"{P}\nEnd."),
    (f"<form id=all><article><p>{P}</p></article></form><form><p>{Q}</p></form>", P),
    (f"<article><p>{P}</p><script>if (a < b) document.write('<p>no</p>')</script><style>p{{}}</style><!-- <p>no</p> --><noscript>no</noscript></article>", P),
    (f"<article><p>{P}</p></article><div id='comments'><article class='comment'><p>{Q}</p></article></div>", P),
    (f"<main><p>{P}</p><div class='cookie-notice'><p>{Q}</p></div><ul><li>one<li>two</ul></main>", f"{P}\none\ntwo"),
    (f"<article><span hidden>no</span><div style='display: none'>no</div><p>{P} <span>yes</span></p></article>", f"{P} yes"),
    (f"<article><p title='a > b'>{P}<p><b>{Q}<br></article><p>after", f"{P}\n{Q}"),
    ("<article><p>1 < 2 & 3 > 2</p></article>", "1 < 2 & 3 > 2"),
    (f"<article><h1>T</h1><section id='related-work'><p>{P}</p></section></article>", f"T\n{P}"),
    (f"<article><div class='share-price'><p>Up.</p></div><p class='dialog'>No.</p><p class='dialog'>{Q}</p></article>", f"Up.\nNo.\n{Q}"),
    (f"<article><p>{P}</p><div class='related'><p>{Q}</p></div><div class='share'><a href='/f'>F</a> <a href='/x'>X</a></div></article>", f"{P}\n{Q}"),
    (f"<article><p>{P}</p><div class='ad'><p>{Q}</p></div><div class='post-comments'><p>{P}</p></div><p>So.</p></article>", f"{P}\nSo."),
    ("<script>never closed <p>x</p>", ""), ("<!-- never closed <p>x</p>", ""), ("</div></p>text", "text"),
])
def test_pages(page, text):
    assert H.main_text(page) == text


@pytest.mark.parametrize("page, text", [
    (f"<html><head><title>T</title><body><article><p>{P}</p></article></body></html>", P),
    (f"<html><head><meta charset=utf-8><title>T</title><style>p{{}}</style><article><p>{P}</p></article>", P),
    (f"<html><head><title>T</title><noscript>no<body><article><p>{P}</p></article>", P),
    (f"<html><head><title>T</title>\n<noscript>no</noscript></head><body><article><p>{P}</p></article>", P),
    ("<head><title>T</title>plain", "plain"), ("<head><head><link rel=x><b>bold</b> text", "bold text"),
    ("<p>one <svg/> two</p>", "one two"), (f"<article><p>{P} <math /> {Q}</p></article>", f"{P} {Q}"),
    (f"<article><svg viewBox='0 0 1 1' role=img /><p>{P}</p></article>", P),
    (f"<article><p>{P} <svg><path d='M0'/><text>no</text></svg> {Q}</p></article>", f"{P} {Q}"),
])
def test_elements_without_an_end_tag(page, text):
    assert H.main_text(page) == text


def test_pages_without_an_article(small, spark):
    """Pages whose article tags are taken out: words, links and tags of the others decide."""
    right = n = 0
    for r in spark.read.parquet(f"{small}/pages.parquet").collect():
        found = H.blocks(re.sub("</?article>", "", r.html))
        kept = H.shares(H.trained(), H.features(found)) >= 0.5
        wanted = set(brute(r.html).split("\n"))
        right, n = right + sum((b.text in wanted) == k for b, k in zip(found, kept)), n + len(found)
    assert right > 0.98 * n


def test_tree_asks_for_words_and_links_and_needs_no_names():
    def asked(node):
        return set() if node.low is None else {H.FEATURES[node.feature]} | asked(node.low) | asked(node.high)

    assert {"words", "links", "links after"} <= asked(H.trained())
    x, y = H.training_table()
    x[:, [H.FEATURES.index("plain names"), H.FEATURES.index("ambiguous names")]] = 0
    assert ((H.shares(H.grow(x, y), x) >= 0.5) == (y > 0.5)).mean() > 0.9


def test_very_long_page():
    page = "<article>" + f"<p>{P}</p>" * 20_000 + "</article>"
    assert H.main_text(page) == "\n".join([P] * 20_000)
    assert H.main_text("<p a='" * 3000) is not None and H.main_text("<div>" * 5000 + "x") == "x"


def test_tree_fits_the_labelled_table():
    x, y = H.training_table()
    assert ((H.shares(H.trained(), x) >= 0.5) == (y > 0.5)).mean() > 0.98


def brute(page):
    inner = page[page.index("<article>") + 9 : page.index("</article>")].replace("<br>", " ")
    parts = [" ".join(html.unescape(re.sub("<[^>]+>", "", p)).split()) for p in re.split(r"</?(?:p|h1)>", inner)]
    return "\n".join(p for p in parts if p)


def test_all_pages_against_brute_force(spark, small):
    pages = spark.read.parquet(f"{small}/pages.parquet")
    want = {r.page_id: brute(r.html) for r in pages.collect()}
    got = H.extract(pages).collect()
    assert {r.page_id: r.text for r in got} == want and all(r.n_chars == len(r.text) for r in got)


def test_rows(spark):
    rows = [(1, "u", f"<p>{P}", 1), (1, "u", f"<p>{P}", 1), (None, None, None, 2)]
    got = H.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text int")).collect()
    assert sorted(((r.page_id, r.url, r.text, r.n_chars) for r in got), key=repr) == sorted([(1, "u", P, len(P)), (1, "u", P, len(P)), (None, None, "", 0)], key=repr)
    assert H.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
