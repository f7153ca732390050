from __future__ import annotations

import pytest

from costurero.llm.html_blocks import blocks
from costurero.llm.html_main import named_role


def texts(page):
    return [b.text for b in blocks(page, labelled=False)]


@pytest.mark.parametrize("head", ["<head><title>x</title><body><p>shown", "<head><title>x</title><div>shown</div>", "<html><head><meta charset=utf-8><script>a</script>shown", "<head></head><body>shown", "<head><noscript><p>no</p></noscript><style>b</style></head>shown"])
def test_a_head_without_end_tag_ends(head):
    assert texts(head) == ["shown"]


def test_raw_elements_end_behind_letters_that_grow():
    page = "<p>\u0130\u0130\u0130</p><SCRIPT>var a</SCRIPT><p>one</p><style>x</styled>y</style ><p>two</p>"
    assert texts(page) == ["\u0130\u0130\u0130", "one", "two"]
    assert texts("<html><head><title>\u0130stanbul</title></head><body>rest") == ["rest"]


def test_a_drawing_closed_in_itself_hides_nothing():
    assert texts("<div><svg/>one<svg width='3' /> two<svg><text>no</text></svg> three</div>") == ["one two three"]
    assert texts("<div><svg viewBox=a/><text>no</text></svg>one</div>") == ["one"]


def test_labels_are_read_only_while_training():
    page = '<div data-y="1"><p>a</p></div><div data-y="many">b</div>'
    assert [b.label for b in blocks(page, labelled=False)] == [None, None]
    assert [b.label for b in blocks(page)] == [1, None]


def test_every_token_of_a_class_is_on_the_path():
    [block] = blocks('<div class="col-md-8 col-lg-9 px-3 mt-2 mb-2 sidebar">text</div>')
    assert "sidebar" in block.path and named_role(block) == 0


def test_what_is_not_shown_cuts_no_block():
    for hidden in (
        "<script>x()</script>", "<svg><path d='1'/></svg>", "<noscript><p>no</p></noscript>", "<button type=a><div>no</div></button>", "<style>p{}</style>",
        "<select><option>no<option>no</select>", "<template><p>no</p></template>", "<object><p>no</p></object>", "<iframe src=a></iframe>", "<canvas><p>no</canvas>",
    ):
        assert texts(f"<p>One two {hidden}three</p><p>four</p>") == ["One two three", "four"], hidden
        assert texts(f"<div>{hidden}<p>a</p>{hidden}<p>b{hidden}</p></div>") == ["a", "b"], hidden
    assert texts("<p>a<button>no</p><p>b</p>") == ["a", "b"]
    assert texts("<ul><li>a<button>no<li>b</ul>c") == ["a", "b", "c"]
