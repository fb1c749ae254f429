"""Articles that a style tree or a container's name must not take away, and what still goes; misnested markup in linear time."""

import time

import pytest

pytest.importorskip("chronofold.llm")
from chronofold.llm import site_style  # noqa: E402

LONG = "The harbour authority said on Monday that the old lighthouse will be repaired before the winter storms arrive again."
MORE = "Fishermen had asked for it since the spring, when two boats missed the entrance in thick fog and had to be towed."


def _text(spark, *pages):
    df = spark.createDataFrame([(k, f"http://news.example/{k}", p) for k, p in enumerate(pages)], "page_id long, url string, html string")
    return [r.text for r in sorted(site_style.extract(df).collect(), key=lambda r: r.page_id)]


def _page(body, nav="Home"):
    return f"<html><body><nav>{nav}</nav>{body}<footer>Imprint</footer></body></html>"


@pytest.mark.parametrize("copies", [2, 3, 9])
def test_one_article_under_many_addresses_stays(spark, copies):
    article = f'<article><div class="body"><p>{LONG}</p><p>{MORE}</p></div></article>'
    pages = [_page(article, f"Section {k}") for k in range(copies)]
    assert _text(spark, *pages) == [f"{LONG}\n\n{MORE}"] * copies
    dated = [_page(article.replace("<article>", f"<article><time>{k} May</time>")) for k in range(copies)]
    assert all(LONG in t and MORE in t for t in _text(spark, *dated))


@pytest.mark.parametrize("holder", ['div class="legal"', 'div class="share-prices"', 'section class="header"', 'div id="footer-history"'])
def test_names_do_not_take_the_main_branch_of_a_page_without_an_article(holder):
    page = _page(f'<{holder}><p>{LONG}</p><p>{MORE}</p></{holder.split()[0]}><div class="sidebar"><p>Most read</p></div>')
    assert site_style.main_text(site_style.parse(page)) == f"{LONG}\n\n{MORE}"


@pytest.mark.parametrize("holder", ['section class="subscription-economics"', 'div id="comment-piece"', 'div class="adsorption"', 'section class="cookie-recipes"'])
def test_parts_of_names_do_not_delete_inside_an_article(holder):
    page = _page(f"<article><p>{LONG}</p><{holder}><p>{MORE}</p></{holder.split()[0]}></article>")
    assert site_style.main_text(site_style.parse(page)) == f"{LONG}\n\n{MORE}"


@pytest.mark.parametrize("holder", ['div class="ad"', 'div class="ad-box"', 'section id="comments"', 'div class="comments-area"', 'ul class="comment-list x1"', 'div class="cookie-banner"', 'div class="newsletter-signup"', 'div class="adBlock"'])
def test_adverts_comments_and_notices_still_go(holder):
    tag = holder.split()[0]
    page = _page(f"<article><p>{LONG}</p><{holder}><p>Something else</p></{tag}></article>")
    assert site_style.main_text(site_style.parse(page)) == LONG


def test_what_many_pages_share_still_goes(spark):
    pages = [_page(f'<article><div class="body"><p>{LONG} Part {k}.</p></div><div class="signoff">Written with care by our newsroom</div></article><div class="x">Follow us</div>') for k in range(6)]
    assert _text(spark, *pages) == [f"{LONG} Part {k}." for k in range(6)]


def test_a_page_keeps_its_text_where_all_of_it_would_go(spark):
    pages = [f"<html><body><div class='a'>{LONG}</div></body></html>", f"<html><body><div class='a'>{LONG}</div><!-- print --></body></html>"] * 2
    assert _text(spark, *pages) == [LONG] * 4


def test_misnested_closing_tags_take_linear_time():
    began = time.time()
    for page in ("<body>" + "<i>" * 40_000 + "</b>" * 40_000 + LONG, "<b><article>" + "<i>" * 40_000 + "</b>" * 40_000 + LONG, "<body>" + "<i>" * 40_000 + "<hr>" * 40_000 + LONG, "<p>" + "<i>" * 40_000 + "<td>" * 20_000 + LONG):
        assert LONG in site_style.main_text(site_style.parse(page))
    assert time.time() - began < 20
