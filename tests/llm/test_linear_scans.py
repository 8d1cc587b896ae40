"""Scans of very long inputs take time in proportion, and nested or broken markup loses no text."""

from __future__ import annotations

import random
import time

import pytest


@pytest.mark.parametrize(
    "part", ["a <b ", "<select>x ", "<a \"b\" ' ", "<a<a", "< x", "<!- x", "<p \"", "<i 'a\" ", "</select  "], ids=range(9)
)
@pytest.mark.parametrize("end", ["", ">", "'>", "\">"], ids=range(4))
def test_a_page_of_a_megabyte_of_open_tags(part, end):
    from docketlake.llm.html_blocks import read_page

    source = "<article><p>text</p></article>" + part * (1_000_000 // len(part)) + end
    start = time.time()
    assert read_page(source).article[0] == "text"
    assert time.time() - start < 20


def test_tags_end_at_the_first_mark_outside_quotes():
    from docketlake.llm.html_blocks import read_page

    assert read_page('<article><p title="a > b">x <b class=\'<p>\'>y</b> 1 < 2 <3 &lt;</p><!-- <p> --><!DOCTYPE z>z</article>').article == ["x y 1 < 2 <3 <", "z"]
    assert read_page("<article>a<!-- b").article == ["a"]
    assert read_page("a < b").rest == ["a < b"] and read_page("<").rest == ["<"] and read_page("").rest == []


def test_articles_among_comments_end_neither_the_comments_nor_the_article():
    from docketlake.llm.html_blocks import read_page

    comment = "<article class='comment'><p>c</p></article>"
    page = read_page(f"<article><p>one</p><div class='comments'>{comment}{comment}</div><p>two</p></article><p>out</p>")
    assert page.article == ["one", "two"] and page.rest == ["out"]
    page = read_page("<article><p>one</p><div class='comments'><article><p>c</p><article>d</article></article>e</div><p>two</p></article>")
    assert page.article == ["one", "two"] and page.furniture == ["c", "d", "e"]
    # Unclosed: the comments end with the article around them.
    page = read_page("<article><p>one</p><div class='comments'><article>c</article></article><article><p>two</p></article>")
    assert page.article == ["one", "two"]


def test_segments_in_one_pass():
    from docketlake.llm.toxicity import maximal_segments

    def plain(values):
        """The best segment, then those of what is left and right of it."""
        best = max(((sum(values[a:b]), -(b - a), a, b) for a in range(len(values)) for b in range(a + 1, len(values) + 1)), default=(0,))
        if best[0] <= 0:
            return []
        _, _, a, b = best
        return plain(values[:a]) + [(a, b)] + [(x + b, y + b) for x, y in plain(values[b:])]

    rng = random.Random(3)
    for _ in range(150):
        values = [rng.choice([-1.0, -1.0, 0.37, 1.61, 2.93]) for _ in range(rng.randint(0, 24))]
        got = maximal_segments(((i, v) for i, v in enumerate(values) if v > 0), -1.0)
        assert [(a, b) for a, b, _ in got] == plain(values)
        assert all(s == pytest.approx(sum(values[a:b])) for a, b, s in got)
    start = time.time()
    assert len(maximal_segments(((i * 8, 1.0) for i in range(300_000)), -1.0)) == 300_000
    assert time.time() - start < 10
