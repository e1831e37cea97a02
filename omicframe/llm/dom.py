"""A page's blocks as a tree, in plain Python: elements that make blocks, and the stretches of text between them."""

from __future__ import annotations

import html
import re

# Fixed values of the markup language.
BLOCKS = [
    "html", "body", "div", "article", "main", "section", "nav", "header", "footer", "aside", "form", "p", "h1", "h2", "h3", "h4", "h5", "h6", "ul", "ol", "li",
    "dl", "dt", "dd", "table", "tr", "td", "th", "blockquote", "pre", "figure", "figcaption", "fieldset", "address", "details", "dialog", "ins", "iframe",
]
RAW = ["script", "style", "noscript", "template", "svg", "head", "title", "textarea", "select", "button", "object", "canvas", "math", "option"]
NO_TEXT = {"script", "style", "noscript", "template", "svg", "textarea", "select", "button", "object", "canvas", "math"}
VOID = {"br", "hr", "img", "input", "meta", "link", "area", "base", "col", "embed", "source", "track", "wbr"}
#: What an opening tag of the key closes, up to the nearest of the barriers.
CLOSES = {
    **{t: {"p"} for t in BLOCKS if t not in ("html", "body", "ins", "iframe")},
    "li": {"p", "li"}, "dt": {"p", "dt", "dd"}, "dd": {"p", "dt", "dd"}, "tr": {"p", "td", "th", "tr"}, "td": {"p", "td", "th"}, "th": {"p", "td", "th"},
}
BARRIERS = {"ul", "ol", "dl", "table", "div", "article", "main", "section", "nav", "header", "footer", "aside", "form", "body", "html", "blockquote", "figure", "fieldset", "details", "dialog"}

_MARK = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+>?|<(/?)([A-Za-z][^\s/>]*+)((?:[^>\"']|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([A-Za-z][^\s/>]*+)([^>]*+)>", re.S)
_ATTR = re.compile(r"(?:^|\s)(class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
_BLOCKS, _RAW = set(BLOCKS), {t: re.compile(rf"</{t}\b[^>]*>?", re.I) for t in RAW if t in NO_TEXT or t == "title"}


class Tree:
    """Nodes in page order, parents before children: tag ('' for text), attributes, parent (-1: none), text, and the
    characters of the text that stand in links."""

    def __init__(self) -> None:
        self.tag, self.attrs, self.parent, self.text, self.linked = ["html"], [""], [-1], [""], [0]


def parsed(page: str | None) -> Tree:
    """The tree of a whole page. Unclosed and stray tags are put up with; a stretch of text ends at every tag that makes
    a block and at line breaks. Null and empty pages have the root alone."""
    tree = Tree()
    page = page or ""
    stack: list[tuple[str, int]] = [("html", 0)]
    buffer: list[str] = []
    links, in_link, at, linked = 0, [], 0, 0

    def flush() -> None:
        nonlocal linked
        if buffer:
            text = " ".join("".join(buffer).split())
            if text:
                tree.tag.append("")
                tree.attrs.append("")
                tree.parent.append(stack[-1][1])
                tree.text.append(text)
                tree.linked.append(min(linked, len(text)))
            buffer.clear()
        linked = 0

    def said(raw: str) -> None:
        nonlocal linked
        if raw:
            text = html.unescape(raw) if "&" in raw else raw
            buffer.append(text)
            if links:
                linked += len(text.strip())

    def pop_to(depth: int) -> None:
        nonlocal links
        del stack[depth:]
        while in_link and in_link[-1] > depth:
            in_link.pop()
            links -= 1

    n = len(page)
    while at < n:
        m = _MARK.search(page, at)
        if m is None:
            said(page[at:])
            break
        said(page[at : m.start()])
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            if m[0].startswith("<![CDATA["):
                said(m[0][9:].removesuffix("]]>"))
            continue
        closing = bool(m[1] or m[4])
        attrs = (m[3] if m[2] else m[6]) or ""
        if name in _RAW and not closing and not attrs.endswith("/"):
            end = _RAW[name].search(page, at)
            if name not in ("textarea", "select", "button"):
                pass
            at = end.end() if end else n if name in ("script", "style") else at
            continue
        if name == "a":
            if closing:
                if in_link:
                    in_link.pop()
                    links -= 1
            else:
                in_link.append(len(stack))
                links += 1
        elif name in ("br", "hr"):
            flush()
        elif name in _BLOCKS and name not in ("html",):
            if closing:
                depth = next((d for d in range(len(stack) - 1, 0, -1) if stack[d][0] == name), 0)
                flush()
                if depth:
                    pop_to(depth)
            else:
                flush()
                shut = CLOSES.get(name, ())
                d = len(stack) - 1
                lowest = None
                while d > 0:
                    tag = stack[d][0]
                    if tag in shut:
                        lowest = d
                    elif tag in BARRIERS:
                        break
                    d -= 1
                if lowest is not None:
                    pop_to(lowest)
                if name == "body" and any(t == "body" for t, _ in stack):
                    continue
                tree.tag.append(name)
                tree.attrs.append(" ".join(v.strip("\"'") for _, v in _ATTR.findall(attrs)) if "=" in attrs else "")
                tree.parent.append(stack[-1][1])
                tree.text.append("")
                tree.linked.append(0)
                if not attrs.endswith("/"):
                    stack.append((name, len(tree.tag) - 1))
    flush()
    return tree
