"""Pages on which a parser can spend a time that grows with their square."""

import time

import pytest

from ampflow.llm import html

N = 60_000


@pytest.mark.parametrize("page", ["<table><tr><td>" * N, "<!-" * N, "<?" * N, "</a " * N, "<a '\"" * N, "<style>" + "/*" * N, "<style>" + "@" * N, "<style>" + "a " * N, "<!--" * N, "<" * N])
def test_hostile_pages_end_in_seconds(page):
    start = time.monotonic()
    html.extract(page)
    assert time.monotonic() - start < 10


def test_nested_tables_with_text():
    start = time.monotonic()
    assert html.extract("<table><tr><td>x" * 5_000) == "\n\n".join(["x"] * 5_000)  # a table is set off by an empty line
    assert time.monotonic() - start < 10


def test_what_follows_the_last_bracket():
    assert html.extract("<p>a</p> b <!-- c") == "a\n\nb"
    assert html.extract("<p>a</p> b <!c") == "a\n\nb <!c"
    assert html.extract("<p>a</p> b </c") == "a\n\nb </c"


def test_sheets_with_rules_around_at_rules():
    page = "<style>b{display:none} @import q; i{display:none} @media x{u{display:none}} s{display:none}</style><b>1</b><i>2</i><u>3</u><s>4</s>5"
    assert html.extract(page) == "35"
