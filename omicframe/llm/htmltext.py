"""Main text of web pages: a tree-structured graphical model over the blocks of a page.

Each block (an element or a stretch of text) is content or not. Its own features give a potential, and each
parent-child pair has one; sum-product messages up and down the tree give every block's marginal.
"""

from __future__ import annotations

import random
import re
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .dom import BLOCKS, Tree, parsed

# Words of class, id and role attributes, by what they say about a block.
WORDS = {
    "menu": ["nav", "navbar", "navigation", "menu", "breadcrumb", "breadcrumbs", "tabs", "toolbar", "pagination", "pager", "skip"],
    "header": ["header", "masthead", "topbar", "banner", "logo", "branding", "top"],
    "footer": ["footer", "foot", "colophon", "copyright", "legal", "bottom", "contentinfo"],
    "side": ["sidebar", "side", "aside", "rail", "widget", "widgets", "related", "recommended", "recommendations", "popular", "trending", "complementary", "more"],
    "notice": ["cookie", "cookies", "consent", "notice", "alert", "gdpr", "popup", "modal", "overlay", "newsletter", "subscribe", "signup", "paywall", "warning"],
    "advert": ["ad", "ads", "advert", "adverts", "advertisement", "advertising", "sponsor", "sponsored", "promo", "promotion", "adsense", "teaser"],
    "form": ["form", "search", "login", "signin", "contact", "feedback"],
    "comments": ["comment", "comments", "commentlist", "disqus", "reply", "replies", "discussion", "respond", "reviews"],
    "social": ["share", "sharing", "social", "follow", "tools"],
    "main": ["article", "content", "main", "post", "entry", "story", "body", "text", "copy", "prose"],
}
_GROUP = {w: k for k, words in enumerate(WORDS.values()) for w in words}
_TAG = {t: k for k, t in enumerate(BLOCKS)}
_N_TAG, _N_WORD = len(BLOCKS) + 1, len(WORDS)
_TEXT = 10
N = 1 + _N_TAG + _N_WORD + _N_TAG + _TEXT + 4  # bias, own tag, own words, a text's parent tag, the text, what lies below
_TOKEN = re.compile("[A-Z]?[a-z]+|[A-Z]+")


def featured(trees: list[Tree]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features, parent, depth) of all nodes of the trees, one forest."""
    starts = np.cumsum([0] + [len(t.tag) for t in trees])
    x = np.zeros((starts[-1], N))
    parent, depth = np.full(starts[-1], -1), np.zeros(starts[-1], int)
    size, linked = np.zeros(starts[-1]), np.zeros(starts[-1])
    x[:, 0] = 1
    text_at, own = 1 + _N_TAG + _N_WORD + _N_TAG, 1 + _N_TAG
    for t, base in zip(trees, starts):
        tags = t.tag
        for k, tag in enumerate(tags):
            i = base + k
            if t.parent[k] >= 0:
                parent[i] = base + t.parent[k]
                depth[i] = depth[parent[i]] + 1
            if tag:
                x[i, 1 + _TAG.get(tag, _N_TAG - 1)] = 1
                if t.attrs[k]:
                    for w in _TOKEN.findall(t.attrs[k]):
                        g = _GROUP.get(w.lower())
                        if g is not None:
                            x[i, own + g] = 1
            else:
                text = t.text[k]
                n = len(text)
                size[i], linked[i] = n, t.linked[k]
                x[i, own + _N_WORD + _TAG.get(tags[t.parent[k]], _N_TAG - 1)] = 1
                share = t.linked[k] / n
                x[i, text_at : text_at + _TEXT] = (
                    1, n < 15, 15 <= n < 40, 40 <= n < 100, 100 <= n < 300, n >= 300, share > 0.9, 0.3 < share <= 0.9, share == 0,
                    "©" in text,
                )
    for d in range(depth.max() if len(depth) else 0, 0, -1):
        at = np.nonzero(depth == d)[0]
        np.add.at(size, parent[at], size[at])
        np.add.at(linked, parent[at], linked[at])
    element = x[:, text_at] == 0
    share = linked / np.maximum(size, 1)
    for k, f in enumerate((size < 40, size >= 400, share > 0.6, (share < 0.1) & (size > 0))):
        x[:, N - 4 + k] = element & f
    return x, parent, depth


def _edge(x: np.ndarray) -> np.ndarray:
    """An edge's kind, by its lower end: 0 to an element, 1 to a text."""
    return x[:, 1 + _N_TAG + _N_WORD + _N_TAG].astype(int)


def marginals(unary: np.ndarray, edges: np.ndarray, kind: np.ndarray, parent: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sum-product on a forest. ``unary``: log odds of content; ``edges[kind, label of parent, label of child]``.
    Returns each node's probability of content and the joint one of (parent, child), zeros at roots."""
    n = len(unary)
    belief = np.stack([np.zeros(n), unary], 1)  # own potential and the messages from below
    up = np.zeros((n, 2))
    order = np.argsort(depth, kind="stable")
    levels = np.split(order, np.cumsum(np.bincount(depth))[:-1]) if n else []
    for at in reversed(levels[1:]):
        up[at] = np.logaddexp.reduce(edges[kind[at]] + belief[at][:, None, :], axis=2)
        np.add.at(belief, parent[at], up[at])
    whole, pair = belief.copy(), np.zeros((n, 2, 2))  # belief and the message from above
    for at in levels[1:]:
        outside = whole[parent[at]] - up[at]
        joint = outside[:, :, None] + edges[kind[at]] + belief[at][:, None, :]
        joint -= np.logaddexp.reduce(joint.reshape(len(at), 4), axis=1)[:, None, None]
        pair[at] = np.exp(joint)
        down = np.logaddexp.reduce(outside[:, :, None] + edges[kind[at]], axis=1)
        whole[at] = belief[at] + down
        whole[at] -= whole[at].max(1, keepdims=True)
    return 1 / (1 + np.exp(np.clip(whole[:, 0] - whole[:, 1], -40, 40))), pair


def fitted(trees: list[Tree], labels: list[list[int]], steps: int = 250, rate: float = 0.1, decay: float = 2e-4) -> tuple[np.ndarray, np.ndarray]:
    """Weights and edge potentials of largest likelihood, by Adam on exact gradients: features and label pairs as
    observed less as expected under the marginals."""
    x, parent, depth = featured(trees)
    y = np.array([v for page in labels for v in page])
    kind, child = _edge(x), parent >= 0
    seen = np.zeros((2, 2, 2))
    np.add.at(seen, (kind[child], y[parent[child]], y[child]), 1)
    w = np.zeros(N + 8)
    m, v = 0.0, 0.0
    for t in range(1, steps + 1):
        p, pair = marginals(x @ w[:N], w[N:].reshape(2, 2, 2), kind, parent, depth)
        expected = np.stack([pair[child & (kind == k)].sum(0) for k in (0, 1)])
        grad = np.concatenate([x.T @ (y - p), (seen - expected).ravel()]) / len(y) - decay * w
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        w = w + rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return w[:N], w[N:].reshape(2, 2, 2)


def contents(pages: list[str | None], model: tuple[np.ndarray, np.ndarray]) -> list[str]:
    """The main text of each page: its texts whose marginal is at least one half, in page order."""
    trees = [parsed(p) for p in pages]
    if not trees:
        return []
    x, parent, depth = featured(trees)
    p, _ = marginals(x @ model[0], model[1], _edge(x), parent, depth)
    out, at = [], 0
    for t in trees:
        out.append(" ".join(s for s, q in zip(t.text, p[at : at + len(t.tag)]) if s and q >= 0.5))
        at += len(t.tag)
    return out


def _sentence(rng: random.Random, low: int = 4, high: int = 18) -> str:
    words = ["".join(rng.choice(["ka", "ro", "ti", "mel", "an", "su", "de", "vin", "or", "el"]) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(low, high))]
    return " ".join(words).capitalize() + rng.choice([".", ".", ".", "!", "?"])


def _label(rng: random.Random) -> str:
    return _sentence(rng, 1, 3).rstrip(".!?")


def labelled_pages(n: int = 400, seed: int = 11) -> list[tuple[str, list[int]]]:
    """Pages made by rule, with a label for each node of their tree: the parts of ordinary pages under the tags and
    attribute words that pages use for them, in changing order and nesting, with unclosed tags as they come. Content
    is marked while a page is put together (by a character that no page uses, taken out again after labelling)."""
    rng = random.Random(seed)
    pick = rng.choice
    mark = "\x01"

    def box(options: list[str], inner: str) -> str:
        opening = pick(options)
        return f"<{opening}>{inner}</{opening.split()[0]}>"

    def named(group: str) -> str:
        word = pick(WORDS[group])
        return f'div {pick(["class", "id"])}="{pick(["", "site-", "page-", "main-" if rng.random() < 0.3 else ""])}{word}{pick(["", "-box", "-wrap", " left"])}"'

    def links(k: int) -> str:
        return "<ul>" + "".join(f'<li><a href="/{i}">{_label(rng)}</a>{pick(["</li>", "</li>", ""])}' for i in range(k)) + "</ul>"

    def style(text: str) -> str:
        """Content is content in any style: as it is, as cells, with signs, in capitals, said twice, a word alone."""
        kind = rng.random()
        if kind < 0.1:
            return text.replace(" ", " | ")
        if kind < 0.2:
            return re.sub(" ", lambda _: pick(["*** ", "### ", "$$$ ", " "]), text)
        if kind < 0.25:
            return text.upper()
        if kind < 0.3:
            return f"{text} {text}"
        return text.split()[0] if kind < 0.4 else text

    def prose(k: int, content: bool) -> str:
        out = []
        for _ in range(k):
            t = style(" ".join(_sentence(rng) for _ in range(rng.choice([1, 1, 2, 3, 5]))))
            if rng.random() < 0.25:
                t = t.replace(" ", f' <a href="#">{_label(rng)}</a> ', 1)
            if rng.random() < 0.2:
                t = f"<b>{t}" + pick(["</b>", "", "<br>"])
            out.append(f"<p>{mark if content else ''}{t}{pick(['</p>', '</p>', ''])}")
        return "".join(out)

    def article() -> str:
        title = f"<h1>{mark}{_label(rng)} {_sentence(rng, 2, 8)}</h1>"
        parts = [prose(rng.randint(0, 6), True)]
        for _ in range(rng.randint(0, 2)):
            parts.append(pick([
                f"<h2>{mark}{_label(rng)}</h2>" + prose(1, True),
                "<ul>" + "".join(f"<li>{mark}{_sentence(rng, 1, 12)}</li>" for _ in range(3)) + "</ul>",
                f"<blockquote>{mark}{_sentence(rng)}</blockquote>",
                f"<table><tr><td>{mark}{_label(rng)}<td>{mark}{rng.randint(1, 99)}</table>",
                box(["figure"], f"<figcaption>{mark}{_sentence(rng, 3, 8)}</figcaption>"),
                f"<div>{mark}{_sentence(rng)}</div>",
                advert(), social(),
            ]))
        body = title + "".join(parts)
        return pick([
            lambda: f"<article>{body}</article>", lambda: f"<article>{body}</article>", lambda: f"<main>{body}</main>", lambda: f"<main><article>{body}</article></main>",
            lambda: box([named("main")], body), lambda: box([named("main")], f"<div>{body}</div>"), lambda: f"<div>{body}</div>", lambda: body,
            lambda: f'<section class="{pick(WORDS["main"])}">{body}</section>',
        ])()

    def advert() -> str:
        return box([named("advert"), named("advert"), "aside", "ins"], pick([_sentence(rng), f"<a href='/x'>{_sentence(rng)}</a>", f"<p>{_sentence(rng)}</p>"]))

    def social() -> str:
        return box([named("social")], pick([links(3), f"<a href='#'>{_label(rng)}</a> {_label(rng)}"]))

    def notice() -> str:
        return box([named("notice"), 'div role="alert"', "dialog"], f"<p>{_sentence(rng)}</p>" + pick(["", "<button>OK</button>", f"<a href='#'>{_label(rng)}</a>"]))

    def form() -> str:
        inner = f"<label>{_label(rng)}</label><input name='q'>{pick(['<p>' + _sentence(rng) + '</p>', ''])}<button>Go</button>"
        return pick([f"<form>{inner}</form>", box([named("form")], f"<form>{inner}</form>")])

    def header() -> str:
        return box(["header", named("header")], pick([_label(rng), f"<h1>{_label(rng)}</h1><p>{_sentence(rng)}</p>", f"<a href='/'>{_label(rng)}</a>"]) + pick(["", menu()]))

    def menu() -> str:
        return box(["nav", named("menu")], pick([links(rng.randint(2, 8)), " | ".join(f"<a href='/{i}'>{_label(rng)}</a>" for i in range(4))]))

    def side() -> str:
        return box(["aside", named("side")], pick([f"<h3>{_label(rng)}</h3>{links(4)}", prose(2, False), advert(), f"<h2>{_label(rng)}</h2>{prose(1, False)}"]))

    def comments() -> str:
        each = "".join(box(["li", "div class='comment'", "article class='comment'"], f"<h4>{_label(rng)}</h4>{prose(rng.randint(1, 2), False)}") for _ in range(rng.randint(1, 4)))
        return box([named("comments"), "section class='comments'", "ol class='commentlist'"], f"<h3>{_label(rng)}</h3>{each}{pick(['', form()])}")

    def footer() -> str:
        return box(["footer", named("footer")], pick([f"&copy; {_label(rng)} &middot; {_sentence(rng)}", links(4), f"<p>{_sentence(rng)}</p>{links(2)}"]))

    def page() -> str:
        before = [p() for p in (notice, header, menu, advert, form, side) if rng.random() < 0.45]
        after = [p() for p in (side, advert, social, form, comments, comments, notice) if rng.random() < 0.35]
        rng.shuffle(before)
        rng.shuffle(after)
        middle = article()
        if rng.random() < 0.3:
            middle = f"<div class='{pick(['container', 'wrapper', 'row', 'page'])}'>{middle}{side()}</div>"
        return f"<html><head><title>{_label(rng)}</title><style>p{{}}</style></head><body>{''.join(before)}{middle}{''.join(after)}{footer() if rng.random() < 0.8 else ''}" + pick(["</body></html>", ""])

    out = []
    for _ in range(n):
        source = page()
        tree = parsed(source)
        labels = [int(mark in t) for t in tree.text]
        for k in range(len(labels) - 1, 0, -1):  # an element with content below it is content
            if labels[k]:
                labels[tree.parent[k]] = 1
        out.append((source.replace(mark, ""), labels))
    return out


@lru_cache(maxsize=1)
def trained() -> tuple[np.ndarray, np.ndarray]:
    """The model of the labelled pages; the same at every call."""
    pages = labelled_pages()
    return fitted([parsed(p) for p, _ in pages], [y for _, y in pages])


def main_text(page: Column, model: tuple[np.ndarray, np.ndarray] | None = None) -> Column:
    """The main text of whole pages as a column: blocks of text judged content, white space inside each made one space,
    joined by one space. Null, empty and text-free pages give an empty string; pages of any length are read whole."""
    model = model or trained()

    @F.pandas_udf("string")
    def extract(pages: pd.Series) -> pd.Series:
        return pd.Series([t for k in range(0, len(pages), 256) for t in contents(pages.iloc[k : k + 256].tolist(), model)], dtype=object)

    return extract(page)
