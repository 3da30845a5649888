"""Pages that leave out </head>, formulas, and objects without anything to load."""

import time

import pytest

from lexmill.llm import htmltext

BODY = "<h1>Head</h1><p>One <b>two</b>three four, a whole sentence.</p><p>Five six seven, another sentence here.</p>"
TEXT = "Head One twothree four, a whole sentence. Five six seven, another sentence here."


@pytest.mark.parametrize("top", ["<html><head><title>T</title><meta charset=utf-8><body>", "<head><title>T</title><link rel=x>", "<head><title>T</title></head><body>", "<head><template><p>no</p></template><noscript><img src=x></noscript><body>"])
def test_open_head_ends(top):
    assert htmltext.model().text(f"{top}<article>{BODY}</article>") == TEXT


def test_text_ends_an_open_head():
    assert htmltext.Tree().read("<head><title>T</title>\nPlain text").texts[1:] == ["Plain text"]


def test_formulas_and_objects():
    math = "<p>Here <math><mi>x</mi><mo>=</mo><mn>2</mn><annotation>tex</annotation></math> holds.</p>"
    page = f"<article>{BODY}{math}<object><p>Shown as nothing is loaded.</p></object><object data=f.swf><p>Hidden one.</p></object></article>"
    assert htmltext.model().text(page) == f"{TEXT} Here x=2 holds. Shown as nothing is loaded."


def test_neutral_containers_and_deep_nesting():
    m = htmltext.model()
    said = "The council met for two hours on the new bridge and could not agree on who will pay for it, so the vote was put off to the spring."
    for opening in ("<div class='wrap'><div class='col-8'>", "<div class='row'><div class='cell'>", "<div><div>"):
        page = f"<body><nav><ul><li><a href='/'>Home</a></li></ul></nav>{opening}<h1>Bridge</h1><p>{said}</p></div></div><footer>All rights</footer></body>"
        assert m.text(page) == f"Bridge {said}"
    began = time.time()
    m.text("<div>" * 40_000 + said)
    assert m.text("</li>" * 40_000 + f"<p>{said}</p>") == said
    assert time.time() - began < 20  # in proportion to the tags; by their square it would take minutes
