"""Pages and archives that lost text or ended the job: odd end tags and comments, names of wrappers, deep foreign elements, malformed fields."""

import time

import pytest

from codelode.llm import html_text, warc

ARTICLE = "<article><h1>A title of the page</h1>" + "".join(f"<p>The {w} sentence of the article is long enough to be read as text, and it ends with a dot.</p>" for w in "first second third fourth fifth".split()) + "</article>"


def text(page):
    return html_text.main_text(page, html_text.default_model())


@pytest.mark.parametrize("before", ["<script>var a;</script foo>", "<style>a{}</style\n>", "<script>a</script/>", '<script>"</scriptx>"</script a="b">', "<!-->", "<!--->", "<!-- x --!>", "<!---->", "<!-- a -- b -->", "<title>t</title x><!-->"])
def test_what_stands_before_an_article_takes_none_of_it(before):
    assert text(f"<html><body>{before}{ARTICLE}</body></html>") == text(f"<html><body>{ARTICLE}</body></html>") != ""


@pytest.mark.parametrize("name", ["post-comments-enabled", "comments sidebar", "has-sidebar menu-open navigation", "page footer-widgets", "comments-disabled"])
def test_names_around_an_article_do_not_empty_the_page(name):
    want = text(f"<html><body><div>{ARTICLE}</div></body></html>")
    assert want and text(f'<html><body class="{name}"><div class="{name}"><div id="{name}">{ARTICLE}</div></div></body></html>') == want


def test_names_of_states_say_nothing():
    paragraphs = ARTICLE.replace("article>", "div>")
    assert text(f'<html><body><div class="post-comments-enabled">{paragraphs}</div></body></html>') == text(f"<html><body><div>{paragraphs}</div></body></html>") != ""


def test_comments_that_are_articles_are_still_left_out():
    comments = '<div class="comments"><h3>Comments</h3>' + "".join(f'<article class="comment"><p>Reader {i} says that this is nice.</p></article>' for i in range(3)) + "</div>"
    got = text(f"<html><body><main>{ARTICLE}</main>{comments}</body></html>")
    assert "Reader" not in got and "fifth sentence" in got


@pytest.mark.parametrize("part", ["<g>", "<math>x</mat>", "<svg><g>", "<head>x", "<math><annotation>", "<object><p>", "<svg><title>", "</g></svg>", "<math><mi>a</mi></math>"])
def test_foreign_elements_take_linear_time(part):
    began = time.perf_counter()
    html_text.blocks("<p>a</p><svg>" + part * 100_000)
    html_text.blocks("<p>a</p>" + part * 100_000)
    assert time.perf_counter() - began < 15


def test_nesting_of_foreign_elements():
    page = "<p>a</p><svg><g><g><text>no</text></g></g><foreignObject><p>no</p></foreignObject></svg><p>b</p><svg><g><p>c</p><object><svg></object><p>d</p>"
    assert [b.text for b in html_text.blocks(page)] == ["a", "b", "c", "d"]


GOOD = [warc.record(i, f"http://h/{i}", f"payload {i}".encode() * 5) for i in range(3)]


@pytest.mark.parametrize("length", [b"9" * 5000, b"9" * 30, b"-1", "٣".encode(), b"", b"1e3", b"0" * 5000 + b"7"])
def test_a_malformed_length_is_a_gap(length):
    bad = GOOD[1].replace(b"Content-Length: ", b"Content-Length: " + length + b"\r\nX: ", 2)
    found = list(warc.salvage(GOOD[0] + bad + GOOD[2]))
    assert [got is None for *_, got, _ in found] == [False, True, False] and [(a, b) for a, b, got, _ in found if got is None] == [(len(GOOD[0]), len(GOOD[0] + bad))]


def test_ids_beyond_a_long_are_those_of_others(spark, tmp_path):
    records = [warc.record(n, "u", b"x") for n in ((1 << 63) - 1, 1 << 63, -(1 << 63) - 1, 10**18)]
    (tmp_path / "a.warc").write_bytes(b"".join(records))
    assert {r["page_id"] for r in warc.read_archives(spark, f"file://{tmp_path}").collect()} == {(1 << 63) - 1, None, 10**18}


def test_bogus_version_lines_take_linear_time():
    began = time.perf_counter()
    found = list(warc.salvage(GOOD[0] + b"WARC/1.0\r\nA: b\r\n" * 200_000 + GOOD[2]))
    assert time.perf_counter() - began < 10 and [got is None for *_, got, _ in found] == [False, True, False]
