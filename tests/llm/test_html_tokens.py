"""The tokenizer of pages against the standard library's parser, on generated and broken markup."""

from __future__ import annotations

import time
from html.parser import HTMLParser

import numpy as np
import pytest

from candlewick.llm.html_extract import blocks


def texts(page):
    return [b.text for b in blocks(page)]


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("<p title=Bob's>Hello world, it's fine</p>", ["Hello world, it's fine"]),
        ("<a href=x title='it's'>Go on</a>", ["Go on"]),
        ("<p title=Bob's>one</p><p>two, it's>fine</p><p>three</p>", ["one", "two, it's>fine", "three"]),
        ("<p>&am<b>p;</b> &lt;b> &amp;lt;</p>", ["&amp; <b> &lt;"]),
        ("<p a = \"x>y\" b='>' c>t</p>", ["t"]),
        ("<p a=\"x>one</p><p>two</p>", ["one", "two"]),
        ("<p>one<p title=\"no end", ["one"]),
        ("<p>1 < 2 and 3 > 2</p><!--> shown <!-- hidden --> too", ["1 < 2 and 3 > 2", "shown too"]),
        ("<p>one</ ><!doctype x>two</3></p>", ["onetwo"]),
        ("<p =a=b ='c'>x</p><P/CLASS=d/>y", ["x", "y"]),
        ("<![CDATA[a &amp; <b>]]>", ["a &amp; <b>"]),
    ],
)
def test_tokens(page, want):
    assert texts(page) == want


class Words(HTMLParser):
    """All text outside scripts and styles."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.words, self.raw = [], 0

    def handle_starttag(self, tag, attrs):
        self.raw += tag in ("script", "style")

    def handle_endtag(self, tag):
        self.raw -= tag in ("script", "style") and self.raw > 0

    def handle_data(self, data):
        if not self.raw:
            self.words.append(data)


def page_of(rng) -> str:
    pick = lambda xs: xs[rng.integers(len(xs))]
    value = lambda: pick(["=x", "=Bob's", "=\"a > b\"", "='a > \"b\"'", "=\"it's\"", " = 'y'", "= z", "", "=\"\"", "=a\"b", "=/p/q?r=s&t"])
    attributes = lambda: "".join(pick([" ", "\n", "  "]) + pick(["class", "id", "title", "data-x", "HREF", "o'k", "\"q"]) + value() for _ in range(rng.integers(0, 4)))
    out = []
    for _ in range(rng.integers(1, 25)):
        kind = rng.integers(10)
        if kind < 4:
            out.append(pick(["word", " it's ", "\"said\"", "&amp;", "&lt;p>", "&#233;", "a > b", "é 😀", "& co", "&copy 5", "= ' \"", "x=y"]))
        elif kind < 7:
            out.append(f"<{pick(['p', 'div', 'B', 'a', 'li', 'span', 'h1', 'td'])}{attributes()}{pick(['', '', ' ', ' /'])}>")
        elif kind < 8:
            out.append(f"</{pick(['p', 'div', 'b', 'a', 'li', 'span'])}{pick(['', ' ', ' x=1'])}>")
        else:
            out.append(pick(["<!-- a > ' -->", "<script>if (a < b) '</p>'</script>", "<style>p > a {}</style>", "<br>", "<img alt=\"a > b\">", "<!DOCTYPE html>", "< b", "1 < 2"]))
    return "".join(out)


def test_text_equals_the_standard_parser():
    """Characters outside markup, white space aside, on 10,000 pages."""
    rng = np.random.default_rng(8)
    for _ in range(10_000):
        page = page_of(rng)
        parser = Words()
        parser.feed(page)
        parser.close()
        assert "".join("".join(texts(page)).split()) == "".join("".join(parser.words).split()), page


def test_broken_tags_take_linear_time():
    for part in ("<p a='", "<a b=\"x' ", "<!--", "</ ", "<p =", "<p a = ", "&am<b>", "<![CDATA["):
        start = time.time()
        blocks(part * 30_000)
        assert time.time() - start < 20, part
