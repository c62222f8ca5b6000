"""Attributes and optional tags of raw pages."""

import pytest

from tessera.llm import html


@pytest.mark.parametrize("attributes", ['style="overflow:hidden"', 'data-state="hidden"', 'title="the hidden river"', 'href="/p?id=related-1"', "data-class='nav'", 'class="content no-sidebar"', 'class="hasSidebar wide"'])
def test_element_stays(attributes):
    assert html.texts_of([f"<body><div {attributes}><p>Text</p></div></body>"], False)[0] == "Text"


@pytest.mark.parametrize("attributes", ["hidden", "hidden=''", 'aria-hidden="true"', "class=sidebar", "id = 'related'", 'class="content no-menu sidebar"', "role=navigation", 'title="x" class="navBar"', "data-a='b'hidden"])
def test_element_goes(attributes):
    assert html.texts_of([f"<body><div {attributes}><p>Text</p></div><p>More</p></body>"], False)[0] == "More"


@pytest.mark.parametrize("page", ["<html><head><title>t</title><meta charset=x><body><p>Text</p></body>", "<head><title>t</title><div><p>Text</p></div>", "<head><title>t</head><body><p>Text", "<svg class='x' d='a>b'/><p>Text</p><svg><text>s</text></svg>", "<svg/><p>Text</p>"])
def test_optional_ends(page):
    assert html.texts_of([page], False)[0] == "Text"
