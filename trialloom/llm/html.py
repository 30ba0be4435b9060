"""Visible text of HTML pages, laid out as a reader sees it.

A tree builder with implied tags makes a tree of whatever markup there is; visibility
rules drop what a browser would not show; the rest is rendered with blocks on lines of
their own, blank lines where blocks have margins, list markers, and table cells in
columns. All visible text is kept: nothing is judged boilerplate.
"""

from __future__ import annotations

import bisect
import html as entities
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialloom.llm.common import map_arrow

# Element names of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
UNSEEN = frozenset("script style head title template noscript iframe object annotation annotation-xml canvas audio video datalist noembed noframes map area meta link base param source track rp".split())
MARGIN = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl pre blockquote figure table hr fieldset".split())
BLOCK = MARGIN | frozenset("html body address article aside center dd details dialog dir div dt figcaption footer form header hgroup legend li main menu nav option optgroup search section summary caption thead tbody tfoot tr td th".split())
CLOSES_P = (BLOCK - frozenset("html body dd dt legend li option optgroup caption thead tbody tfoot tr td th".split())) | {"dd", "dt", "li"}
#: What an opening tag closes first, and the elements at which the search for it stops.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "optgroup", "datalist"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "tr": ({"tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "thead": ({"thead", "tbody", "tfoot", "caption", "colgroup", "tr"}, {"table"}),
    "tbody": ({"thead", "tbody", "tfoot", "caption", "colgroup", "tr"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "caption", "colgroup", "tr"}, {"table"}),
    "rt": ({"rt", "rp"}, {"ruby"}),
    "rp": ({"rt", "rp"}, {"ruby"}),
    "body": ({"head"}, {"html"}),
}
#: What svg and math do not show of their content; of svg, only what stands in text elements.
SVG_UNSEEN = frozenset("title desc metadata".split())
MATH_UNSEEN = frozenset("annotation annotation-xml".split())
#: Elements of svg and math that hold HTML, and HTML elements that end svg or math elsewhere.
HOLD_HTML = frozenset("foreignobject desc annotation-xml mi mo mn ms mtext".split())
BREAK_OUT = frozenset("b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s small span strong strike sub sup table tt u ul var".split())
HEAD_ONLY = frozenset("base link meta title style script noscript template head html".split())

ATTRIBUTE = re.compile(r"([^\s=>\"'/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]*)))?")
NAME = re.compile(r"[A-Za-z][^\s/>]*")
SPACE = re.compile(r"[ \t\n\r\f]+")
HIDDEN_STYLE = re.compile(r"display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse)", re.IGNORECASE)
RULE = re.compile(r"([^{}]+)\{([^{}]*)\}")
#: Elements nested deeper become siblings, so that no page exhausts the stack; tables
#: nested deeper than TABLES are rendered as plain blocks.
DEPTH, TABLES = 512, 40
#: Columns wider than this are not padded.
WIDEST = 60


class Tags:
    """Finds the tags and comments of a page, from left to right, in time linear in its length.

    A quote delimits only right after "="; with one there that is never closed, and where no
    ">" follows, it is no tag but text. What was learned on a way that led to no end is kept.
    """

    MARK, BLANK, END = re.compile(r"[>=]"), re.compile(r"[ \t\n\r\f]*"), re.compile(r"[ \t\n\r\f>]")

    def __init__(self, page: str) -> None:
        self.page = page
        self.dead: set[int] = set()  # "=" from which no end can be reached
        self.first = (0, -1, 0)  # from .. to: the mark that comes next there, and its place (-1 for none)

    def _next_mark(self, at: int) -> int:
        a, z, mark = self.first
        if not a <= at <= z:
            m = self.MARK.search(self.page, at)
            mark = m.start() if m else -1
            self.first = (at, mark if m else len(self.page), mark)
        return mark

    def _tag_end(self, at: int) -> int:
        """The place after the tag that is open at this place, or -1."""
        page, way = self.page, []
        mark = self._next_mark(at)
        while mark >= 0 and mark not in self.dead:
            if page[mark] == ">":
                return mark + 1
            way.append(mark)
            at = self.BLANK.match(page, mark + 1).end()
            quote = page[at : at + 1]
            if quote in ('"', "'") and quote:
                at = page.find(quote, at + 1) + 1
                if not at:
                    break
            else:
                m = self.END.search(page, at)
                if not m:
                    break
                at = m.start()
            m = self.MARK.search(page, at)
            mark = m.start() if m else -1
        self.dead.update(way)
        return -1

    def next(self, at: int) -> tuple[int, int] | None:
        """(start, end) of the next tag, comment or declaration from this place on."""
        page = self.page
        while (start := page.find("<", at)) >= 0:
            if page.startswith("<!--", start):
                ends = [e + n for e, n in ((page.find("-->", start + 4), 3), (page.find("--!>", start + 4), 4)) if e >= 0]
                return start, min(ends, default=len(page))
            kind = page[start + 1 : start + 3]
            if kind[:1] in ("!", "?") and kind:
                return start, page.find(">", start) + 1 or len(page)
            letter = kind[1:] if kind[:1] == "/" else kind[:1]
            if letter.isascii() and letter.isalpha() and (end := self._tag_end(start + 2)) >= 0:
                return start, end
            at = start + 1
        return None


def raw_end(page: str, name: str, at: int) -> tuple[int, int]:
    """(start, end) of the closing tag of script and the like; the page's end if there is none."""
    m = re.compile(rf"</{name}(?=[\s/>])", re.IGNORECASE).search(page, at)
    end = page.find(">", m.end()) + 1 if m else 0
    return (m.start(), end) if end else (len(page), len(page))


class Node:
    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag: str, attrs: dict[str, str]) -> None:
        self.tag, self.attrs, self.children = tag, attrs, []


def parse(page: str) -> Node:
    """The tree of a page. Unknown, unclosed and misplaced tags never lose text."""
    root = Node("html", {})
    stack = [root]

    def push_text(text: str) -> None:
        if text:
            stack[-1].children.append(text)

    def close_to(names: set[str], stops: set[str]) -> None:
        """Close up to and including the outermost open element of names above a stop."""
        found = None
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in stops:
                break
            if stack[i].tag in names:
                found = i
        if found:
            del stack[found:]

    def foreign() -> int:
        """Place of the innermost svg or math whose own content comes next, or 0."""
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in ("svg", "math"):
                return i
            if stack[i].tag in HOLD_HTML:
                break
        return 0

    at, end = 0, len(page)
    any_foreign = re.search(r"<(?:svg|math)", page, re.IGNORECASE) is not None
    tags = Tags(page)
    while at < end:
        found = tags.next(at)
        if not found:
            push_text(entities.unescape(page[at:]))
            break
        push_text(entities.unescape(page[at : found[0]]))
        token, at = page[slice(*found)], found[1]
        if token[1] in "!?":
            continue
        closing = token[1] == "/"
        name = NAME.search(token, 1 + closing)[0].lower()
        if closing:
            if name == "p" and not any(n.tag == "p" for n in stack):
                stack[-1].children.append(Node("p", {}))
            elif name == "br":
                stack[-1].children.append(Node("br", {}))
            else:
                stops = {"table"} if name not in ("table", "body", "html") else set()
                if name not in BLOCK:
                    stops = stops | {"td", "th"}
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].tag == name:
                        del stack[i:]
                        break
                    if stack[i].tag in stops:
                        break
            continue
        if name == "html":
            continue
        attrs = {}
        if len(token) > len(name) + 2:
            for a in ATTRIBUTE.finditer(token, 1 + len(name), len(token) - 1):
                attrs.setdefault(a[1].lower(), entities.unescape(a[2] or a[3] or a[4] or ""))
        inside = foreign() if any_foreign else 0
        if inside and name in BREAK_OUT:
            del stack[inside:]
            inside = 0
        if name in MATH_UNSEEN and not any(n.tag == "math" for n in stack):
            name = "span"  # an unknown element
        if stack[-1].tag == "head" and name not in HEAD_ONLY:
            stack.pop()
        if name in CLOSES_P:
            close_to({"p"}, {"table", "td", "th", "caption", "button", "object"})
        if name in IMPLIED:
            close_to(*IMPLIED[name])
        if name in ("h1", "h2", "h3", "h4", "h5", "h6") and stack[-1].tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
            stack.pop()
        if name in ("td", "th") and stack[-1].tag in ("table", "thead", "tbody", "tfoot"):
            row = Node("tr", {})
            stack[-1].children.append(row)
            stack.append(row)
        node = Node(name, attrs)
        stack[-1].children.append(node)
        if inside and token.endswith("/>"):
            continue
        if name in RAW:
            close, after = raw_end(page, name, at)
            body = page[at:close]
            node.children.append(entities.unescape(body) if name in ("textarea", "title") else body)
            at = after
        elif name not in VOID and len(stack) < DEPTH:
            stack.append(node)
    return root


def hidden_by_style(root: Node) -> set[str]:
    """Plain selectors (tag, .class, #id, tag.class) that style elements of the page hide."""
    out, todo = set(), [root]
    while todo:
        n = todo.pop()
        if n.tag == "style":
            for selectors, body in RULE.findall("".join(c for c in n.children if isinstance(c, str))):
                if HIDDEN_STYLE.search(body):
                    out |= {s.strip() for s in selectors.split(",") if re.fullmatch(r"[\w-]*(?:[.#][\w-]+)?", s.strip())}
        todo += [c for c in n.children if isinstance(c, Node)]
    return out - {""}


class Renderer:
    def __init__(self, hidden: set[str]) -> None:
        self.hidden = hidden

    def seen(self, n: Node) -> bool:
        a = n.attrs
        if n.tag in UNSEEN or "hidden" in a or (n.tag == "input" and a.get("type", "").lower() == "hidden"):
            return False
        if n.tag == "dialog" and "open" not in a:
            return False
        if "style" in a and HIDDEN_STYLE.search(a["style"]):
            return False
        if self.hidden:
            keys = {n.tag, f"#{a.get('id')}", f"{n.tag}#{a.get('id')}"}
            for c in a.get("class", "").split():
                keys |= {f".{c}", f"{n.tag}.{c}"}
            return not (keys & self.hidden)
        return True

    def lines(self, root: Node, tables: int = 0) -> list[str]:
        """The lines of an element's content."""
        out: list[str] = []
        cur: list[str] = []
        state = {"gap": False, "space": False}
        prefix: list[list[str]] = []  # of open lists and quotes: [first line, further lines]

        def flush() -> None:
            text = "".join(cur)
            cur.clear()
            state["space"] = False
            if text.strip(" \n"):
                for part in text.rstrip(" ").split("\n"):
                    emit(part)

        def emit(line: str) -> None:
            if state["gap"] and out:
                out.append("")
            state["gap"] = False
            head = ""
            for p in prefix:
                head += p[0]
                p[0] = p[1]
            out.append((head + line).rstrip())

        def text(s: str, pre: bool) -> None:
            if pre:
                cur.append(s.replace("\r\n", "\n"))
                return
            s = SPACE.sub(" ", s)
            if s[0] == " ":
                if cur and not cur[-1].endswith((" ", "\n")):
                    cur.append(" ")
                s = s[1:]
            if s:
                cur.append(s)

        # (node or text, leaving) with the state that its ancestors set
        todo: list[tuple] = [(c, False, False, None) for c in reversed(root.children)]
        while todo:
            n, leaving, pre, lists = todo.pop()
            if isinstance(n, str):
                text(n, pre)
                continue
            tag = n.tag
            if leaving:
                flush()
                if tag in ("li", "blockquote", "dd"):
                    mark = prefix.pop()
                    if tag == "li" and mark[0] != mark[1]:  # an item without text keeps its marker
                        prefix.append(mark)
                        emit("")
                        prefix.pop()
                if tag in MARGIN and not (tag in ("ul", "ol") and lists is not None):
                    state["gap"] = True
                continue
            if not self.seen(n):
                continue
            if tag == "br":
                cur.append("\n")
                continue
            if tag == "hr":
                flush()
                state["gap"] = True
                continue
            if tag == "input":
                if n.attrs.get("type", "text").lower() in ("submit", "button", "reset", "text", "search", "email", "url", "tel", "number") and n.attrs.get("value"):
                    text(n.attrs["value"], False)
                continue
            if tag == "table" and tables < TABLES:
                flush()
                state["gap"] = True
                for line in self.table(n, tables + 1):
                    emit(line)
                state["gap"] = True
                continue
            if tag in BLOCK:
                flush()
                if tag in MARGIN and not (tag in ("ul", "ol") and lists is not None):
                    state["gap"] = True
                inner = lists
                if tag in ("ul", "ol", "menu", "dir"):
                    start = n.attrs.get("start", "")
                    inner = [int(start) if tag == "ol" and re.fullmatch(r"-?\d{1,9}", start) else 1 if tag == "ol" else None]
                elif tag == "li":
                    mark = "- "
                    if lists and lists[0] is not None:
                        value = n.attrs.get("value", "")
                        if re.fullmatch(r"-?\d{1,9}", value):
                            lists[0] = int(value)
                        mark = f"{lists[0]}. "
                        lists[0] += 1
                    prefix.append([mark, " " * len(mark)])
                elif tag == "blockquote":
                    prefix.append(["> ", "> "])
                elif tag == "dd":
                    prefix.append(["    ", "    "])
                todo.append((n, True, pre, lists))
            else:
                inner = lists
            inside = pre or tag in ("pre", "textarea", "xmp") or "white-space:pre" in n.attrs.get("style", "").replace(" ", "")
            children = n.children
            if tag == "svg":
                children = self.labels(n)
            if tag == "details" and "open" not in n.attrs:
                children = [c for c in children if isinstance(c, Node) and c.tag == "summary"][:1]
            if tag == "pre" and children and isinstance(children[0], str) and children[0].startswith("\n"):
                children = [children[0][1:], *children[1:]]
            todo += [(c, False, inside, inner) for c in reversed(children) if c != ""]
        flush()
        return out

    def labels(self, svg: Node) -> list:
        """What shows text in an svg, kept apart by spaces."""
        out, todo = [" "], svg.children[::-1]
        while todo:
            n = todo.pop()
            if isinstance(n, str) or n.tag in SVG_UNSEEN or not self.seen(n):
                continue
            if n.tag in ("text", "foreignobject"):
                out += [n, " "]
            else:
                todo += n.children[::-1]
        return out

    def table(self, table: Node, depth: int) -> list[str]:
        """Rows with cells in columns; a cell of several lines takes several lines of its row.
        Anything in a table outside its cells comes before it."""
        rows: list[list[tuple[list[str], int, int]]] = []
        loose: list[str] = []
        todo = [(c, None) for c in reversed(table.children)]
        feet: list = []
        while todo:
            n, row = todo.pop()
            if isinstance(n, str):
                loose += [s] if (s := SPACE.sub(" ", n).strip(" ")) else []
            elif not self.seen(n):
                continue
            elif n.tag == "tfoot" and row is None and todo:
                feet.append(n)  # a footer stands below all rows
            elif n.tag in ("thead", "tbody", "tfoot", "colgroup"):
                todo += [(c, None) for c in reversed(n.children)]
            elif n.tag == "tr":
                rows.append([])
                todo += [(c, rows[-1]) for c in reversed(n.children)]
            elif n.tag in ("td", "th") and row is not None:
                span = [int(v) if (v := n.attrs.get(k, "1")).isdigit() and 1 <= int(v) <= 1000 else 1 for k in ("colspan", "rowspan")]
                row.append((self.lines(n, depth), *span))
            else:
                loose += self.lines(n if n.tag == "caption" else wrap(n), depth)
            if not todo and feet:
                todo, feet = [(f, 0) for f in reversed(feet)], []
        grid: list[dict[int, list[str]]] = [{} for _ in rows]
        taken: dict[int, int] = {}  # column: rows that a cell above still covers
        for r, row in enumerate(rows):
            col, covered = 0, {c: k - 1 for c, k in taken.items() if k > 1}
            for cell, across, down in row:
                while taken.get(col, 0) > 0:
                    col += 1
                grid[r][col] = cell
                for c in range(col, col + across):
                    if down > 1:
                        covered[c] = down - 1
                col += across
            taken = covered
        spans = {(r, c) for r, row in enumerate(rows) for c in self._wide(row, grid[r])}
        width: dict[int, int] = {}
        for r, cells in enumerate(grid):
            for c, lines in cells.items():
                if (r, c) not in spans:
                    width[c] = max([width.get(c, 0), *map(len, lines)])
        out = list(loose)
        columns = sorted({c for c, w in width.items() if w} | {c for cells in grid for c in cells})
        for cells in grid:
            for i in range(max([len(x) for x in cells.values()], default=0)):
                line, last = "", max(c for c, x in cells.items() if len(x) > i)
                for c in columns[: bisect.bisect_right(columns, last)]:
                    part = cells[c][i] if c in cells and i < len(cells[c]) else ""
                    if c not in cells and not width.get(c):
                        continue
                    line += part if c == last else part.ljust(min(width.get(c, 0), WIDEST)) + "  "
                out.append(line.rstrip())
        return out

    @staticmethod
    def _wide(row: list, cells: dict) -> list[int]:
        return [c for c, (_, across, _) in zip(sorted(cells), row, strict=True) if across > 1]


def wrap(n: Node) -> Node:
    out = Node("div", {})
    out.children.append(n)
    return out


def render(page: str | None) -> str:
    """The visible text of a page; null and empty pages give an empty text."""
    if not page:
        return ""
    root = parse(page)
    return "\n".join(Renderer(hidden_by_style(root)).lines(root))


def extract_text(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(page_id, text, n_chars) for every row. Null and empty pages have empty texts; null ids and
    repeated rows keep their rows, no rows give none; other columns are not read."""

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            text = [render(h) for h in b["html"]]
            yield {"page_id": b["page_id"], "text": text, "n_chars": [len(t) for t in text]}

    rows = pages.select(F.col(id_col).alias("page_id"), F.col(html_col).alias("html"))
    return map_arrow(rows, run, f"page_id {rows.schema['page_id'].dataType.simpleString()}, text string, n_chars long")
