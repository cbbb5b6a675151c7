"""Visible text of broken pages."""

import pytest

from riskframe.llm import pages


@pytest.mark.parametrize("page, text", [
    ("<table><form><tr><td>x<td>y<tr><td>z</form></table>end", "x | y\nz\nend"),
    ("<table><tr><form><td>a<td>b</form></tr></table>", "a | b"),
    ("<table><center><tr><td>x</center></table>", "x"),
    ("<table><a href=u><tr><td>x</a><tr><td>y</table>", "x\ny"),
    ("<table><td>a<td>b</table>", "a | b"),
    ("<table><td>a<td>b<tr><td>c</table>", "a | b\nc"),
    ("<table>loose<tr>more<td>x</table>", "loosemore\nx"),
    ("<table><tr><td>x</tr><p>para</p><tr><td>y</table>", "para\nx\ny"),
    ("<table><form><caption>cap</caption><tr><td>x</form></table>", "cap\nx"),
    ("<table><caption>cap<tr><td>x<td>y</table>", "cap\nx | y"),
    ("<table><tr><td>x<table><td>in</table></table>", "x in"),
    ("<table><tr hidden><td>no</tr><form hidden><tr><td>no</form></table>yes", "yes"),
    ("<head>bare text", "bare text"),
    ("<html><head><title>no</title><meta x>\nbare <b>text</b>", "bare text"),
    ("<head><script>no</script></head><body>yes", "yes"),
    ("<p>so <math><mi>x</mi><mo>=</mo><semantics><mn>1</mn><annotation>no</annotation></semantics></math> ends", "so x=1 ends"),
])
def test_visible_text_of_broken_tables_and_heads(page, text):
    assert [x for x in pages.visible_text(page).split("\n") if x] == text.split("\n")


@pytest.mark.parametrize("open_tags", ["<font>" * 300, "<span>" * 20_000, "<div>" * 20_000])
def test_roles_hold_at_any_depth(open_tags):
    page = open_tags + ("<p>a<div hidden>no<div>no</div>no</div><i style='display:none'>no</i><select><option>no</select>"
                        "<noscript>no</noscript><table><tr><td>x<td>y<tr><td>zz<td>k</table><ul><li>one<li>two<ol><li>in</ol></ul>")
    assert [x for x in pages.visible_text(page).split("\n") if x] == ["a", "x  | y", "zz | k", "- one", "- two", "  1. in"]
    assert pages.visible_text("<div hidden>" + "<font>" * 300 + "<div>no</div>no<p>no</p></div>yes") == "yes"


def test_deeply_nested_tables_and_lists():
    assert pages.visible_text("<table><tr><td>" * 2000 + "deep") == "deep"
    assert [x.strip() for x in pages.visible_text("<ul><li>x" * 2000).split("\n") if x] == ["- x"] * 2000
