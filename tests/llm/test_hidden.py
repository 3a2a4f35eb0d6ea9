"""Which attributes hide an element."""

from talus.llm import html


def hidden(attributes):
    return html.Page(f"<div {attributes}>text</div>").hidden[1]


def test_only_own_attributes_hide():
    for x in ("style='overflow:hidden'", 'class="overflow-hidden"', 'class="hidden-xs"', "id=hidden", 'hidden="false"', 'aria-hidden="false"', 'data-x="display:none"'):
        assert not hidden(x), x
    for x in ("hidden", 'class="a" hidden', 'hidden=""', 'aria-hidden="true"', "style='color:red; display: none'", 'style="visibility:hidden"', "HIDDEN"):
        assert hidden(x), x
