"""Visibility, numbering and tables at any depth and width."""

import time

from quarry.llm.html import to_text


def test_hidden_at_any_depth():
    for n in (10, 255, 300, 5000):
        assert to_text("<div>" * n + "<p hidden>SECRET</p><p>shown</p>" + "</div>" * n + "end") == "shown\n\nend"


def test_end_tags_end_their_own_element():
    assert to_text("<blockquote>" + "<span>" * 400 + "<p>one</p>two" + "</span>" * 400 + "</blockquote>three") == "  one\n\n  two\n\nthree"


def test_deep_pages_take_time_in_proportion():
    began = time.time()
    assert to_text("<p><button>" + "<div>" * 100_000 + "x") == "x"
    assert time.time() - began < 20


def test_style_rules():
    page = "<style>.h, #gone {display: none} p.v {visibility:hidden} /* .s{display:none} */ @media print { .s {display:none} } div .deep {display:none} i {display:none} .back {display:inline}</style>"
    shown = "<p class='a h'>1</p><p id=gone>2</p><p class=v>3<b style='visibility:visible'>4</b></p><p class=s>5</p><div><p class=deep>6</p></div><i>7</i><i class=back>8</i><p class=h style='display:block'>9</p>"
    assert to_text(page + shown).split() == ["4", "5", "6", "8", "9"]


def test_list_numbers():
    assert to_text("<ol><li>a<li value=9>b<li>c</ol>").split("\n") == ["1. a", "9. b", "10. c"]
    assert to_text("<ol reversed><li>a<li>b<li>c</ol>").split("\n") == ["3. a", "2. b", "1. c"]
    assert to_text("<ol start=-1><li>a<li>b<li>c</ol>").split("\n") == ["-1. a", "0. b", "1. c"]
    assert to_text("<ol start=5 reversed><li>a<li value=x>b</ol>").split("\n") == ["5. a", "4. b"]


def test_tables_at_any_depth():
    row = lambda inner: f"<table><tr><td>{inner}</td><td>r</td></tr><tr><td>long cell</td><td>q</td></tr></table>"
    for n in (9, 12, 400):
        inner = "x"
        for _ in range(n):
            inner = row(inner)
        lines = to_text(inner).split("\n")
        assert [x for x in lines if x][-1].split()[-1] == "q"
        last = [x for x in lines if x.startswith("long cell")][-1]
        assert last.index("q") == [x for x in lines if x.startswith("x")][0].rindex("r")


def test_columns_of_any_width():
    wide = "w" * 300
    text = to_text(f"<table><tr><td>{wide}</td><td>b</td></tr><tr><td>a</td><td>c</td></tr></table>")
    assert text.split("\n") == [wide + "  b", "a" + " " * 299 + "  c"]


def test_padding_stays_in_bounds():
    page = "<table><tr><td>" + "w" * 100_000 + "</td><td>b</td></tr>" + "<tr><td>a</td><td>c</td></tr>" * 5000 + "</table>"
    assert len(to_text(page)) < 66 * len(page)
