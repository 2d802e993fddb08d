"""Only a hidden attribute or a style without display hides an element; the word elsewhere doesn't."""

import pytest

from lotgrid.llm.html_blocks import blocks

SHOWN = ['href="/hidden-gems"', 'id="hidden-costs"', 'class="hidden-print"', 'title="the hidden room"', "class=hidden", 'hidden="false"', 'data-a="x hidden y"', 'style="overflow:hidden"', 'title="display: none"', 'aria-label="a" data-hidden']
HIDDEN = ["hidden", "HIDDEN", 'class="a" hidden', 'hidden=""', "hidden='hidden' id=b", 'style="display:none"', "STYLE='color: red; DISPLAY : none'", 'style="overflow:hidden;display:none"']


@pytest.mark.parametrize("attrs", SHOWN)
@pytest.mark.parametrize("tag", ["a", "h2", "article"])
def test_shown(tag, attrs):
    assert [b.text for b in blocks(f"<div><{tag} {attrs}>words</{tag}></div>")[0]] == ["words"]


@pytest.mark.parametrize("attrs", HIDDEN)
def test_hidden(attrs):
    assert [b.text for b in blocks(f"<div {attrs}>words</div><p>rest</p>")[0]] == ["rest"]
