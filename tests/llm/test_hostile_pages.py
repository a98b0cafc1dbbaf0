"""Pages that are cheap to read however they are nested, and articles that names and tags must not hide."""

import re
import time

import pytest

from aerostrata.llm import html_text

P = (
    "<p>The committee of the town has said that it will take up the matter of the old bridge in the spring, when the water is low and the work can be done "
    "by the men who know it best, and that all of it is to be paid for from the fund.</p>"
)
NAV = "<nav><ul><li><a href=x>Home</a></li><li><a href=y>News</a></li></ul></nav>"
FOOT = "<footer>Copyright of the town</footer>"


def count(html):
    text = html_text.main_text(html)
    assert "Home" not in text and "Copyright" not in text
    return text.count("The committee")


@pytest.mark.parametrize(
    ("name", "html"),
    [
        ("spans and items", "<span>" * 60_000 + "<li>" * 60_000),
        ("stray ends", "<div>" * 80_000 + "</b>" * 80_000),
        ("regions", "<nav>" * 80_000 + "x"),
        ("items", "<li>" * 250_000),
        ("quotes", "<a \"" * 100_000 + ">"),
        ("paragraphs", "<p>" * 100_000 + "</div>" * 100_000),
        ("attributes", "<x " + "a " * 200_000 + ">t"),
        ("comments", "<!--" * 100_000),
        ("scripts", "<script>" * 50_000),
    ],
)
def test_pages_are_read_in_linear_time(name, html):
    began = time.perf_counter()
    html_text.main_text(html)
    assert time.perf_counter() - began < 6, name


@pytest.mark.parametrize(
    ("n", "html"),
    [
        (3, f"<body><form id=aspnetForm>{NAV}{P * 3}{FOOT}</form>"),
        (3, f"<form>{NAV}<article>{P * 3}</article>{FOOT}</form>"),
        (2, f'{NAV}<article data-id="promo" data-role="ads" data-class="comments">{P * 2}</article>'),
        (2, f'{NAV}<article class="post category-ads">{P * 2}</article>'),
        (3, f'<article>{P * 2}<section id="comments-on-the-law">{P}</section></article>'),
        (2, f'<article>{P}<section class="cookie-recipe">{P}</section></article>'),
        (2, f'<article>{P}<div id="newsletter-of-1890">{P}</div></article>'),
        (2, f"<article>{P}{P.replace('<p>', '<p title="the hidden truth" data-hidden=no>')}</article>"),
        (3, f"<header><h1>News of the town</h1>{NAV}{P * 3}"),
        (2, f"<!-->{P}<!-- <p>x</p> -->{P}<!--->"),
        (1, f"<article>{P}</article>{FOOT}<aside>{P}</aside>"),
    ],
)
def test_articles_are_kept(n, html):
    assert count(html) == n


@pytest.mark.parametrize(
    "beside",
    [
        "<div class=comments>{}</div>", "<div class='ad-slot'>{}</div>", "<div class='google-ads-300x250'>{}</div>", "<div id=cookieConsent>{}</div>", "<form>{}</form>", "<div class='newsletter-signup'>{}</div>",
        "<div id=comment-12>{}</div>", "<ol class='commentlist'>{}</ol>", "<section aria-label='Cookie banner'>{}</section>", "<section hidden>{}</section>", "<div style='color: red; display :none'>{}</div>",
        "<div aria-hidden=true>{}</div>", "<div class='sponsored-content'>{}</div>", "<header class=site-header>{}</header>", "<div class='post-comments'>{}</div>",
    ],
)
def test_what_lies_beside_goes(beside):
    assert count(f"{NAV}<article>{P * 2}</article>{beside.format(P)}{FOOT}") == 2
    assert count(f"{NAV}<div>{P * 2}{beside.format(P)}</div>{FOOT}") == 2


def test_whole_pages_in_forms_give_the_same_text(spark):
    """All pages of a table, their bodies put into a form, as some servers do."""
    pages = [r.html for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect() if r.html]
    same = 0
    for html in pages:
        wrapped = re.sub(r"(<body[^>]*>)(.*)(</body>)", r"\1<form id='aspnetForm' method='post'>\2</form>\3", html, flags=re.S | re.I)
        if wrapped != html:
            assert html_text.main_text(wrapped) == html_text.main_text(html)
            same += 1
    assert same > len(pages) / 2
