"""Text of HTML pages as a reader would see it: a tree with implied tags, visibility, and layout.

Tags are put into a tree as browsers do where end tags may be left out (a new list item ends the last,
a block ends an open paragraph, a new row ends the last). Hidden parts give no text. Blocks are set
apart by line ends, paragraphs and headings by an empty line, list items by their mark and indent, and
the cells of a table are padded to columns. What a table holds outside its cells comes before it.
"""

from __future__ import annotations

import html
import re
from collections.abc import Generator, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Element names of the HTML standard by the role they play in layout.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
HIDDEN = frozenset("head script style template noscript iframe object svg annotation annotation-xml audio video canvas select datalist title "
                   "textarea noembed noframes".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl blockquote pre table figure hr fieldset".split())
BLOCKS = SPACED | frozenset("html body address article aside center details dialog dd div dt fieldset figcaption footer "
                            "form header hgroup li main nav section summary caption thead tbody tfoot tr".split())
IN_HEAD = frozenset("html head meta link base basefont bgsound script style template noscript noframes title".split())
TABLE_PARTS = frozenset("table thead tbody tfoot tr td th".split())
ENDS_PARAGRAPH = BLOCKS - TABLE_PARTS - {"html", "body", "caption", "li", "dd", "dt"} | {"table"}
# A start tag ends an open element of the second set, looked for up to one of the third.
IMPLIED_ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th", "caption"}, {"table"}), "td": ({"td", "th", "caption"}, {"tr", "table"}), "th": ({"td", "th", "caption"}, {"tr", "table"}),
    "tbody": ({"thead", "tbody", "tfoot", "caption"}, {"table"}), "thead": ({"thead", "tbody", "tfoot", "caption"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "caption"}, {"table"}),
    "option": ({"option"}, {"select"}), "optgroup": ({"option", "optgroup"}, {"select"}),
}
SCOPES = frozenset("html table td th caption button object template".split())
MOST_INDENT = 100

token = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
attribute = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+)))?")
unseen_style = re.compile(r"display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse)", re.I)
white = re.compile(r"[ \t\n\r\f]+")


class Node:
    __slots__ = ("name", "attrs", "children", "hidden", "parts")

    def __init__(self, name: str, attrs: dict[str, str]):
        self.name, self.attrs, self.children = name, attrs, []
        self.parts = False  # whether it holds a caption, row or cell of the table around it
        self.hidden = (name in HIDDEN or "hidden" in attrs or attrs.get("aria-hidden", "").lower() == "true"
                       or name == "input" or bool(unseen_style.search(attrs.get("style", ""))))


def attributes(text: str) -> dict[str, str]:
    found: dict[str, str] = {}
    if text.strip(" /\t\r\n"):
        for name, *values in attribute.findall(text):
            found.setdefault(name.lower(), html.unescape("".join(values)))
    return found


def tree(page: str) -> Node:
    """The page's elements. Text is a string among the children."""
    root = Node("", {})
    stack, at, end = [root], 0, len(page)
    places: dict[str, list[int]] = {}  # of the open elements of a name on the stack

    def top(names) -> int:
        return max((places[n][-1] for n in names if places.get(n)), default=0)

    def cut(at: int) -> None:
        for node in reversed(stack[at:]):
            places[node.name].pop()
        del stack[at:]

    def close(names: set[str], scope) -> bool:
        i = top(names)
        if not i or i < top(scope):
            return False
        cut(i)
        return True

    while at < end:
        match = token.search(page, at)
        text = page[at: match.start() if match else end]
        if text:
            if stack[-1].name == "head" and text.strip(" \t\n\r\f"):
                cut(len(stack) - 1)
            stack[-1].children.append(html.unescape(text))
        if not match:
            break
        at = match.end()
        name = (match["name"] or "").lower()
        if not name:
            continue
        if match["end"]:
            if name in VOID:
                if name == "br":
                    stack[-1].children.append(Node("br", {}))
            elif name == "p":
                if not close({"p"}, SCOPES):
                    stack[-1].children.append(Node("p", {}))
            else:
                close({name}, TABLE_PARTS - {name} - {"tr", "td", "th", "thead", "tbody", "tfoot"} if name in TABLE_PARTS else SCOPES - {name})
            continue
        if name in IMPLIED_ENDS:
            names, scope = IMPLIED_ENDS[name]
            while close(names, scope):
                pass
        if name in ENDS_PARAGRAPH or name in ("li", "dd", "dt"):
            close({"p"}, SCOPES)
        if name in ("body", "html") and places.get(name):
            continue
        if name not in IN_HEAD and stack[-1].name == "head":
            cut(len(stack) - 1)
        node = Node(name, attributes(match["attrs"]))
        stack[-1].children.append(node)
        if name in TABLE_PARTS and name != "table" or name == "caption":
            for above in reversed(stack):
                if above.parts or above.name == "table":
                    break
                above.parts = True
        if name in RAW:
            close_at = re.compile(rf"</{name}(?=[\s/>])", re.I).search(page, at)
            body_end = close_at.start() if close_at else end
            node.children.append(page[at:body_end])
            at = page.find(">", body_end) + 1 if close_at else end
            at = at or end
        elif name not in VOID:
            places.setdefault(name, []).append(len(stack))
            stack.append(node)
    return root


class Lines:
    """Lines under construction: white space collapses, blocks break lines, empty lines do not add up."""

    def __init__(self):
        self.lines: list[str] = []
        self.open, self.gap, self.mark = "", 0, ""

    def text(self, text: str, keep: bool) -> None:
        if keep:
            first, *rest = text.split("\n")
            self._add(first)
            for line in rest:
                self.end_line(True)
                self._add(line)
            return
        text = white.sub(" ", text)
        if text.startswith(" ") and (not self.open or self.open.endswith(" ")):
            text = text[1:]
        if text:
            self._add(text)

    def _add(self, text: str) -> None:
        if text and not self.open:
            if self.gap and self.lines:
                self.lines.extend([""] * (self.gap - 1))
            self.gap, self.open, self.mark = 0, self.mark, ""
        self.open += text

    def end_line(self, forced: bool = False) -> None:
        if self.open.strip() or forced:
            self.lines.append(self.open.rstrip())
        self.open = ""

    def block(self, spaced: bool) -> None:
        self.end_line()
        if not self.mark:  # a block that opens a list item stays on the item's line
            self.gap = max(self.gap, 2 if spaced else 1)


def table_parts(table: Node) -> tuple[list[Node], list[list[Node]], Node]:
    """A table's captions, the cells of its rows, and what stands outside all cells, in an element of its own.

    Elements between the table, its rows and its cells are looked through; cells without a row begin one.
    """
    captions, rows, loose = [], [], Node("div", {})
    row, todo = None, list(reversed(table.children))
    while todo:
        child = todo.pop()
        if child is None:  # the end of a row or group
            row = None
        elif isinstance(child, str):
            loose.children.append(child)
        elif child.hidden:
            pass
        elif child.name == "caption":
            captions.append(child)
        elif child.name in ("td", "th"):
            if row is None:
                row = []
                rows.append(row)
            row.append(child)
        elif child.name in ("tr", "thead", "tbody", "tfoot"):
            row = None
            if child.name == "tr":
                row = []
                rows.append(row)
            todo += [None, *reversed(child.children)]
        elif child.name != "table" and child.parts:
            todo += reversed(child.children)
        else:
            loose.children.append(child)
    return captions, rows, loose


def finish(steps: Generator):
    """The result of a generator whose steps are generators of the same kind: recursion without Python's stack."""
    todo, value = [steps], None
    while todo:
        try:
            todo.append(todo[-1].send(value))
            value = None
        except StopIteration as done:
            todo.pop()
            value = done.value
    return value


def table_rows(rows: list[list[Node]]) -> Generator:
    """The texts of cells; a cell's lines are joined by a space, a wide cell leaves columns empty."""
    texts: list[list[str]] = []
    for row in rows:
        cells: list[str] = []
        for cell in row:
            lines = yield render(cell)
            cells.append(" ".join(x.strip() for x in lines if x.strip()))
            span = cell.attrs.get("colspan", "1")
            cells += [""] * (min(int(span), 1000) - 1 if span.isascii() and span.isdigit() else 0)
        texts.append(cells)
    return texts


def render(node: Node) -> Generator:
    """The lines of an element, by `finish`."""
    out = Lines()

    def walk(node: Node, indent: int, keep: bool, number: list[int] | None) -> Generator:
        for child in node.children:
            if isinstance(child, str):
                out.text(child, keep)
                continue
            name = child.name
            if child.hidden:
                continue
            if name == "br":
                out.end_line(True)
            elif name == "hr":
                out.block(True)
            elif name == "img":
                out.text(child.attrs.get("alt", ""), False)
            elif name == "table":
                out.block(True)
                captions, parts, loose = table_parts(child)
                rows = [r for r in (yield table_rows(parts)) if any(r)]
                widths = [max(map(len, (r[i] for r in rows if i < len(r)))) for i in range(max(map(len, rows), default=0))]
                outside = (yield render(loose)) if loose.children else []
                above = outside if any(outside) else []
                for caption in captions:
                    above += yield render(caption)
                for line in above + [
                        " | ".join(c.ljust(w) for c, w in zip(r, widths)).rstrip(" |") for r in rows]:
                    out.text(line, True)
                    out.end_line()
                out.block(True)
            elif name in ("ul", "ol", "menu"):
                out.block(indent == 0)
                start = child.attrs.get("start", "1")
                yield walk(child, indent + 1, keep, [int(start) if start.isascii() and start.isdigit() else 1] if name == "ol" else None)
                out.block(indent == 0)
            elif name == "li":
                out.block(False)
                out.mark = "  " * min(max(0, indent - 1), MOST_INDENT) + (f"{number[0]}. " if number else "- ")
                if number:
                    number[0] += 1
                yield walk(child, indent, keep, number)
                out.block(False)
                out.mark = ""
            elif name in BLOCKS:
                out.block(name in SPACED)
                yield walk(child, indent, keep or name == "pre", number)
                out.block(name in SPACED)
            else:
                if name in ("td", "th") and out.open and not out.open.endswith(" "):
                    out.text(" ", False)
                yield walk(child, indent, keep, number)

    yield walk(node, 0, node.name == "pre", None)
    out.end_line()
    return out.lines


def visible_text(page: str | None) -> str:
    """All visible text of a page, laid out; empty for null."""
    if not page:
        return ""
    return "\n".join(finish(render(tree(page)))).strip("\n")


def extract(pages: DataFrame) -> DataFrame:
    """One row per row of `pages` (page_id, url, html): text, n_lines, n_words.

    Broken markup never fails: stray end tags are skipped, open elements end with the page, and
    elements keep their role at any depth. List items deeper than MOST_INDENT are indented no further.
    Null html gives an empty text. Rows are judged one by one; other columns are ignored.
    """
    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(html=[visible_text(page) for page in batch["html"]]).rename(columns={"html": "text"})

    rows = pages.select(pages["page_id"].cast("bigint").alias("page_id"), pages["url"].alias("url"), pages["html"].alias("html"))
    texts = rows.mapInPandas(work, "page_id bigint, url string, text string")
    lines = F.when(F.col("text") == "", 0).otherwise(F.size(F.split("text", "\n"))).cast("bigint")
    return texts.select("page_id", "url", "text", lines.alias("n_lines"), F.regexp_count("text", F.lit(r"\S+")).cast("bigint").alias("n_words"))
