"""Texts made to be slow, and readers' comments."""

import time

import pytest

from shelfscope.llm.html_extract import main_text
from shelfscope.llm.secret_scan import Novelty, novel_spans

N = 100_000


@pytest.mark.parametrize(
    "page",
    ["<div>" * N + "</x>" * N, "<a " * N, "<b>" * N + "x<br>" * N, "<i><div>" + "<b>" * N + "</i>" * N, "<p>" * N + "</div>" * N, "<li>" * N, "<!--" * N, "<" * N],
    ids=["unknown ends", "no end", "open inline", "crossed inline", "paragraphs", "items", "comments", "brackets"],
)
def test_pages_in_linear_time(page):
    start = time.perf_counter()
    main_text(page)
    assert time.perf_counter() - start < 10


@pytest.mark.parametrize("text", ["token " + "a" * 1_000_000, "key=" + "ab.cd-" * 150_000 + "!", "token " + "x_" * 500_000 + "=", "secret '" * 100_000, 'auth="' * 100_000])
def test_words_in_linear_time(text):
    start = time.perf_counter()
    novel_spans(text, Novelty())
    assert time.perf_counter() - start < 20


BODY = "<p>Real body. It is.</p>"
READERS = "<p>Reader text here. It is long. Yes.</p>"


@pytest.mark.parametrize(
    "page",
    [
        f"<article>{BODY}<section id='comments'><h2>Comments</h2>{READERS}</section></article>",
        f"<article><div class='comment-content'>{READERS}</div>{BODY}</article>",
        f"<article>{BODY}<ol class='comment-list'><li><article class='comment-body'>{READERS}</article></li></ol></article>",
        f"<article>{BODY}</article><div id='disqus_thread'>{READERS}</div>",
        f"<div class='content comments-open'>{BODY}</div>",
        f"<article class='post has-comments'>{BODY}</article>",
    ],
)
def test_comments_stay_out(page):
    assert main_text(f"<html><body>{page}</body></html>") == "Real body. It is."


def test_text_before_a_broken_end():
    assert main_text("<article><p>One. Two.</p> tail <a href='x") == "One. Two. tail <a href='x"
    assert main_text("<article><p>One. Two.</p><!-- never closed <p>Three.</p>") == "One. Two."
