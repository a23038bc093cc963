"""Layouts whose containers have names of boilerplate."""

import pytest

from shelfscope.llm.html_extract import main_text

TEXT = "The river rose for three days. On the fourth, the bridge was closed. Nobody was hurt, and the road opened again in May."
NAV = "<nav><a href=/>Home</a> <a href=/x>News</a></nav>"
FOOT = "<div class='site-footer'>All rights kept. Call us.</div>"


@pytest.mark.parametrize(
    "page",
    [
        f"{NAV}<div class='content-sidebar-wrap'><main><article><p>{TEXT}</p></article></main></div>{FOOT}",
        f"{NAV}<div class='content has-sidebar'><p>{TEXT}</p></div>{FOOT}",
        f"{NAV}<div class='sidebar-layout'><article><p>{TEXT}</p></article></div>{FOOT}",
        f"{NAV}<div class='sidebar'><main><p>{TEXT}</p></main></div>{FOOT}",
        *[f"{NAV}<article><section id='{i}'><p>{TEXT}</p></section></article>{FOOT}" for i in ("discussion", "feedback-control", "related-work", "search-results")],
    ],
)
def test_text_in_named_containers(page):
    assert main_text(f"<html><body>{page}</body></html>") == TEXT


def test_title_in_entry_header():
    page = f"<article><div class='entry-header'><h1>The flood</h1></div><p>{TEXT}</p></article>"
    assert main_text(page) == f"The flood {TEXT}"


def test_teaser_article_beside_the_text():
    page = f"{NAV}<div><p>{TEXT}</p><p>{TEXT}</p></div><div><article><h3>More</h3><p>Read on here.</p></article></div>"
    assert f"{TEXT} {TEXT}" in main_text(page)


@pytest.mark.parametrize("name", ["comments", "post-comments", "site-footer", "sidebar", "mainNav"])
def test_boilerplate_stays_out(name):
    assert main_text(f"<article><p>{TEXT}</p></article><div class='{name}'><p>Nice. I was there too. It was wet.</p></div>") == TEXT
