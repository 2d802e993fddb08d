"""Blocks keep every text, in time that follows the page's length; the field's text equals the articles of the tables."""

import re
import time
from html import unescape

import pytest

from lotgrid.llm import html_crf
from lotgrid.llm.html_blocks import ANCESTORS, blocks


def texts(html):
    return [b.text for b in blocks(html)[0]]


def test_long_attributes_end_with_their_quote():
    assert texts(f'<p title="{"a>" * 9000}">one</p><p data-x=\'<b>"{"x" * 9000}\'>two</p>') == ["one", "two"]
    assert texts('<p title="never ends>one</p><p>two</p>') == ["one", "two"]
    assert texts("<p a=b\"c'>one</p><a href=/x/>two</a> < 3 <") == ["one", "two < 3 <"]


def test_formulas_and_embedded_media_keep_their_text():
    assert texts("<p>As <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds, <object>plan <b>B</b></object> <video>no film</video>.</p>") == ["As x=2 holds, plan B no film."]
    assert texts("<svg><text>drawn</text></svg><p>kept</p><select><option>a</select>") == ["kept"]


def test_deep_pages_keep_the_nearest_names():
    deep = "".join(f'<div class="n{chr(97 + k % 26)}{chr(97 + k // 26 % 26)}x">' for k in range(650))
    (block,) = blocks(f'{deep}<article id="story"><p>text')[0]
    assert {"article", "p", "name:story"} <= block.above and len(block.above) >= ANCESTORS and "name:naax" not in block.above
    (block,) = blocks(f'{deep}<div class="comments"><p>text')[0]
    assert "name:comments" in block.above


LONG = {
    "unmatched ends": "<div>" * 60_000 + "</foo>" * 110_000 + "x",
    "inline ends behind a block": "<b><div>" + "<i>" * 120_000 + "</b>" * 120_000 + "x",
    "items without a list": "<div>" * 80_000 + "<li>x" * 100_000,
    "rules in open inline elements": "<i>" * 120_000 + "<hr>" * 120_000 + "x",
    "quotes that never end": "<p a='" * 150_000 + "x",
    "names that pile up": "".join(f'<div class="{"".join(chr(97 + k // 26**j % 26) for j in range(4))}">x' for k in range(30_000)),
    "the same name at every depth": "<div>x" * 150_000,
    "blank runs": "<p>" + " &nbsp;" * 150_000 + "<b> </b>" * 1000 + "x",
    "lone brackets": "< " * 500_000,
    "raw elements that never end": "<xmp" * 10 + "<style>" * 100_000,
}


@pytest.mark.parametrize("name", sorted(LONG))
def test_a_megabyte_in_seconds(name):
    began = time.time()
    blocks(LONG[name])
    assert time.time() - began < 8


def test_article_of_every_page(spark):
    """By plain patterns, which the layout of the tables' pages allows: paragraphs, headings and lines of the article element."""
    for page in html_crf.extract(spark.read.parquet("/root/testdata/sf0.01/pages.parquet")).join(spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("page_id", "html"), "page_id").collect():
        inner = re.search(r"<article>(.*?)(?:</article>)", page.html, re.S)[1]
        inner = re.sub(r"(?s)<!--.*?-->|<script.*?</script>|<style.*?</style>|<div class=\"?ad.*?</div>", "", inner)
        want = " ".join(unescape(re.sub(r"</?(?:b|i|em|strong|a|span)\b[^>]*>", "", re.sub(r"<(?!/?(?:b|i|em|strong|a|span)\b)[^>]*>", " ", inner))).split())
        assert (page.text, page.n_chars) == (want, len(want)), page.page_id
