"""Main text of web pages by a tree-structured graphical model over the DOM (operator 7).

A page becomes the tree of its block elements; runs of text directly in a block are its
text.  Each block has a binary label, content or not.  Its features (tag, words in class,
id and role, words and links below it) give its own potential, and every parent-child edge
has a 2 x 2 potential.  Sum-product messages passed from the leaves to the root and back
give each block's exact marginal; text of blocks with a content marginal of at least one
half is the page's main text.  Weights maximise the likelihood of labelled pages, whose
gradient is again a difference of such marginals.

The labelled pages are made by ``labelled_pages``: layouts drawn from rules (containers,
menus, side bars, notices, adverts, comments, unclosed tags) with every block labelled.
Training is a few hundred bounded pages on the driver; pages are extracted where they lie,
without a shuffle.

Defined cases: null or empty html gives an empty text and 0 characters; text outside any
element counts as text of the page's root; truncated pages end where they end; repeated
rows are returned each; other columns are ignored.
"""

from __future__ import annotations

import functools
import html as _html
import math
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Element names of HTML by their role here.
BLOCKS = set("html body article aside main section header footer nav div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table "
             "thead tbody tfoot tr td th caption blockquote pre figure figcaption form fieldset address details summary "
             "center hgroup dialog menu".split())
DROP = set("script style noscript template iframe object svg math head title select option button textarea input "
           "canvas audio video map datalist".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
CLOSES_P = BLOCKS - {"html", "body"}
SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
        "th": {"td", "th"}, "p": {"p"}}
FENCE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"},
         "th": {"tr", "table"}}
GOOD = "article content post entry main story body text prose markdown page".split()
BAD = ("nav menu sidebar side footer foot header masthead topbar ad ads advert advertisement adsense banner promo sponsor "
       "sponsored cookie notice consent gdpr alert comment comments disqus reply replies respond share social related "
       "recommended widget breadcrumb breadcrumbs newsletter subscribe subscription login signup modal popup overlay "
       "toolbar pagination pager search meta byline tags legal copyright skip complementary navigation contentinfo").split()
# words of a class that tell a state or a layout of what it stands on, not what it is
STATES = set("has with without no not is are open opened closed hidden visible active inactive collapsed expanded sticky "
             "fixed left right top bottom none enabled disabled wide narrow".split())
KINDS = set("category tag type status format postid template tax term author".split())  # prefixes of a post's own facts
TAGS = ("p article main section div nav header footer aside form ul ol li table td h1 h2 h3 blockquote pre figure body "
        "address details").split()

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*(?:>|\Z)|<\?[^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)"
                    r"((?>=\s*\"[^\"]*\"|=\s*'[^']*'|[^>])*+)(?:>|\Z)|[^<]+|<", re.S)
_ATTR = re.compile(r"(?<![\w-])(class|id|role|aria-label|aria-hidden|hidden|style)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?", re.I)
_NAME = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_END = {t: re.compile(rf"</{t}\b[^>]*(?:>|\Z)", re.I) for t in DROP}


class Page:
    """Block tree of a page: parents come before children; ``runs`` are (block, text) in page order."""

    def __init__(self, source: str):
        self.parent, self.tag, self.attrs = [-1], ["body"], [""]
        self.words, self.linked = [0], [0]
        self.runs: list[tuple[int, str]] = []
        self.labels: dict[int, int] = {}
        self._read(source)

    def _read(self, source: str) -> None:
        stack, text, links, at = [0], [], 0, 0

        def flush():
            if text:
                run = " ".join(_html.unescape("".join(text)).split())
                if run:
                    self.runs.append((stack[-1], run))
                text.clear()

        while at < len(source):
            m = _TOKEN.match(source, at)
            if m is None:
                break
            at = m.end()
            name = m.group(2)
            if name is None:
                piece = m.group()
                if not piece.startswith(("<!", "<?")):
                    text.append(piece)
                    n = len(piece.split())
                    self.words[stack[-1]] += n
                    if links:
                        self.linked[stack[-1]] += n
                continue
            name, closing = name.lower(), m.group(1)
            if name in DROP and not closing and name not in VOID:
                if not m.group(3).rstrip().endswith("/") and (e := _END[name].search(source, at)):
                    at = e.end()
                elif name in ("script", "style", "textarea", "title"):
                    at = len(source)
                continue
            if name == "a":
                links = 0 if closing else 1
            if name in ("br", "hr"):
                text.append(" ")
                if name == "hr":
                    flush()
            if name not in BLOCKS:
                continue
            flush()
            links = 0
            if closing:
                if name in (tags := [self.tag[k] for k in stack[1:]]):
                    del stack[1 + len(tags) - 1 - tags[::-1].index(name) :]
                continue
            if name in ("html", "body"):
                continue
            if name in CLOSES_P:
                for k in range(len(stack) - 1, 0, -1):
                    if self.tag[stack[k]] == "p":
                        del stack[k:]
                        break
                    if self.tag[stack[k]] in ("table", "td", "th", "caption"):
                        break
            if name in SAME:
                for k in range(len(stack) - 1, 0, -1):
                    if self.tag[stack[k]] in FENCE.get(name, ()):
                        break
                    if self.tag[stack[k]] in SAME[name]:
                        del stack[k:]
                        break
            self.parent.append(stack[-1])
            self.tag.append(name)
            self.attrs.append(m.group(3))
            self.words.append(0)
            self.linked.append(0)
            if "data-label" in m.group(3):
                self.labels[len(self.tag) - 1] = int('data-label="1"' in m.group(3))
            stack.append(len(self.tag) - 1)
        flush()


N_FEATURES = 1 + len(TAGS) + 12


def features(page: Page) -> np.ndarray:
    """One row of features per block; the last columns describe the text below it."""
    n = len(page.tag)
    words, linked = list(page.words), list(page.linked)
    blocks = [1 if w else 0 for w in words]
    for k in range(n - 1, 0, -1):
        p = page.parent[k]
        words[p] += words[k]
        linked[p] += linked[k]
        blocks[p] += blocks[k]
    x = np.zeros((n, N_FEATURES))
    x[:, 0] = 1
    base = 1 + len(TAGS)
    inside, holds, named = [False] * n, [False] * n, [(False, False, False)] * n
    for k in range(n):
        tag = page.tag[k]
        if tag in _TAG_AT:
            x[k, 1 + _TAG_AT[tag]] = 1
        good = bad = hidden = False
        if page.attrs[k].strip():
            for key, value in _ATTR.findall(page.attrs[k]):
                key, value = key.lower(), value.strip("\"'")
                if key == "hidden" or (key == "aria-hidden" and value.lower() == "true") or (
                        key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value)):
                    hidden = True
                elif key in ("class", "id", "role", "aria-label"):
                    one = roles(value)
                    good, bad = good or one[0], bad or one[1]
        named[k] = good, bad, hidden
    # a block that holds most of the page and its heading or article is a wrapper, whatever it is called
    for k in range(n - 1, 0, -1):
        good, bad, hidden = named[k]
        if holds[k] or not bad and (good or page.tag[k] in ("h1", "main", "article")):
            holds[page.parent[k]] = True
    for k in range(n):
        tag, p = page.tag[k], page.parent[k]
        good, bad, hidden = named[k]
        if holds[k] and words[k] >= 0.5 * words[0] and not hidden:
            bad = False
            out = False
        else:
            out = bad or hidden or tag in _OUT
        inside[k] = out or (p >= 0 and inside[p])
        density = linked[k] / words[k] if words[k] else 0.0
        x[k, base : base + 12] = (good, bad, hidden, inside[k], density, density > 0.5, math.log1p(words[k]) / 5,
                                  words[k] == 0, words[k] >= 25, math.log1p(words[k] / max(1, blocks[k])) / 4,
                                  good and not inside[k], bad and not good)
    return x


def roles(value: str) -> tuple[bool, bool]:
    """Whether a class, id or role names something good or bad.

    ``content-with-sidebar`` is content, ``has-sidebar`` and ``nav-closed`` are states, ``category-search`` is a fact
    about a post: of each name only what it says of the block itself counts.
    """
    good = bad = False
    for one in value.split():
        names = _NAME.findall(_CAMEL.sub(" ", one).lower())
        if len(names) > 1:
            if names[0] in KINDS or names[-1] in STATES and names[-1] not in _GOOD | _BAD:
                continue
            at = next((i for i, w in enumerate(names) if w in STATES), len(names))
            names = names[:at]
        good = good or any(w in _GOOD for w in names)
        bad = bad or any(w in _BAD for w in names)
    return good, bad


_TAG_AT = {t: k for k, t in enumerate(TAGS)}
_GOOD, _BAD = set(GOOD), set(BAD)
_OUT = {"nav", "footer", "aside", "form", "dialog", "menu"}


def marginals(parent: list[int], own: np.ndarray, edge: np.ndarray):
    """Sum-product on a tree: content marginals, edge marginals (node, parent label, label) and log Z.

    ``own`` is the log potential of label 1 (label 0 has 0); ``edge[a, b]`` the log potential of a
    parent labelled a with a child labelled b.
    """
    n = len(parent)
    e = np.exp(edge)
    e00, e01, e10, e11 = e[0, 0], e[0, 1], e[1, 0], e[1, 1]
    in0, in1 = [1.0] * n, np.exp(np.clip(own, -30, 30)).tolist()
    up0, up1 = [1.0] * n, [1.0] * n
    log_z = 0.0
    for k in range(n - 1, 0, -1):  # upward
        a, b = in0[k], in1[k]
        m0, m1 = e00 * a + e01 * b, e10 * a + e11 * b
        s = m0 + m1
        log_z += math.log(s)
        up0[k], up1[k] = m0 / s, m1 / s
        p = parent[k]
        in0[p] *= up0[k]
        in1[p] *= up1[k]
        t = in0[p] + in1[p]
        log_z += math.log(t)
        in0[p] /= t
        in1[p] /= t
    z = in0[0] + in1[0]
    log_z += math.log(z)
    b0, b1 = [0.0] * n, [0.0] * n
    b0[0], b1[0] = in0[0] / z, in1[0] / z
    pair = np.zeros((n, 2, 2))
    for k in range(1, n):  # downward: the parent's belief without this child's message
        p = parent[k]
        q0, q1 = b0[p] / max(up0[k], 1e-300), b1[p] / max(up1[k], 1e-300)
        a, b = in0[k], in1[k]
        j00, j01, j10, j11 = q0 * e00 * a, q0 * e01 * b, q1 * e10 * a, q1 * e11 * b
        s = j00 + j01 + j10 + j11
        pair[k] = ((j00 / s, j01 / s), (j10 / s, j11 / s))
        b0[k], b1[k] = (j00 + j10) / s, (j01 + j11) / s
    return np.array(b1), pair, log_z


def labelled_pages(n: int = 240, seed: int = 5) -> list[str]:
    """Pages with every block labelled (``data-label``), drawn from layout rules; never copied from the corpus."""
    r = random.Random(seed)
    syll = "an re thi on el mo ta li ver que sch ung er é os ción la de pa".split()

    def words(lo, hi):
        w = ["".join(r.choices(syll, k=r.randint(1, 4))) for _ in range(r.randint(lo, hi))]
        return " ".join(x + (r.choice([".", ",", "", "", "", "", ""])) for x in w).capitalize() + "."

    def el(tag, inner, label, attr="", close=True):
        return f'<{tag}{" " + attr if attr else ""} data-label="{label}">{inner}' + (f"</{tag}>" if close else "")

    def cls(options):
        return r.choice(["", f'class="{r.choice(options)}"', f'id="{r.choice(options)}"'])

    def links(lab, lo=3, hi=9):
        return "".join(el("li", f'<a href="/x">{words(1, 3)}</a>', lab) for _ in range(r.randint(lo, hi)))

    def article():
        out = []
        if r.random() < 0.8:
            out.append(el("h1", words(3, 9), 1))
        for _ in range(r.randint(1, 10)):
            kind = r.random()
            if kind < 0.70:
                body = words(*r.choice([(1, 4), (5, 30), (30, 120)]))
                if r.random() < 0.25:
                    body = f"<b>{body}" + r.choice(["</b>", "<br>"])
                elif r.random() < 0.25:
                    body += f' <a href="/y">{words(1, 4)}</a> {words(5, 20)}'
                out.append(el("p", body, 1, close=r.random() < 0.85))
            elif kind < 0.78:
                out.append(el(r.choice(["h2", "h3"]), words(2, 7), 1))
            elif kind < 0.86:
                out.append(el(r.choice(["ul", "ol"]), "".join(el("li", words(3, 20), 1) for _ in range(r.randint(2, 5))), 1))
            elif kind < 0.90:
                out.append(el("blockquote", el("p", words(8, 40), 1), 1))
            elif kind < 0.93:
                out.append(el("pre", words(3, 20), 1))
            elif kind < 0.96:
                out.append(el("table", el("tr", "".join(el("td", words(1, 6), 1) for _ in range(3)), 1), 1))
            else:
                out.append(r.choice([
                    el("div", words(4, 20), 0, f'class="{r.choice(["ad", "ads", "advert", "promo", "sponsored"])}"'),
                    el("aside", el("p", words(5, 30), 0), 0),
                    el("div", el("ul", links(0, 2, 4), 0), 0, 'class="share"'),
                    el("div", el("p", words(5, 30), 0), 0, f'class="{r.choice(["related", "newsletter", "widget"])}"')]))
        return "".join(out)

    def chrome_top():
        out = []
        if r.random() < 0.6:
            nav = el("ul", links(0), 0) if r.random() < 0.7 else "".join(f'<a href="/z">{words(1, 2)}</a> ' for _ in range(5))
            out.append(el("nav", nav, 0))
        if r.random() < 0.5:
            inner = r.choice([el("h1", words(1, 4), 0), el("p", words(2, 10), 0), words(1, 5)])
            out.append(el(*r.choice([("header", inner, 0), ("div", inner, 0, cls(["header", "masthead", "topbar", "site-header"]) or 'class="header"')])))
        if r.random() < 0.35:
            out.append(el("div", el("ul", links(0), 0), 0, r.choice(['class="menu"', 'id="menu"', 'class="breadcrumbs"', ""])))
        if r.random() < 0.4:
            out.append(el("div", r.choice([words(4, 30), el("p", words(8, 50), 0)]), 0, f'class="{r.choice(["cookie-notice", "notice", "consent", "alert", "banner", "gdpr"])}"'))
        if r.random() < 0.5:
            out.append(el("div", words(3, 25), 0, f'class="{r.choice(["ad", "ads", "advert", "banner", "promo", "sponsor"])}"'))
        r.shuffle(out)
        return "".join(out)

    def chrome_end():
        out = []
        if r.random() < 0.45:
            tag = r.choice(["section", "div", "ol"])
            post = [el("li" if tag == "ol" else r.choice(["div", "p", "article"]), r.choice([words(5, 70), el("p", words(5, 70), 0)]), 0,
                       r.choice(["", 'class="comment"', 'class="reply"'])) for _ in range(r.randint(1, 6))]
            out.append(el(tag, r.choice(["", el("h2", words(1, 3), 0), el("h3", words(1, 3), 0)]) + "".join(post), 0,
                          r.choice(['class="comments"', 'id="comments"', 'class="comment-list"', 'id="disqus_thread"'])))
        if r.random() < 0.4:
            body = el("h3", words(1, 3), 0) + r.choice([el("ul", links(0), 0), el("p", words(8, 60), 0) * r.randint(1, 2)])
            out.append(r.choice([el("aside", body, 0), el("div", body, 0, f'class="{r.choice(["sidebar", "widget", "related", "side-bar"])}"')]))
        if r.random() < 0.3:
            out.append(el("form", el("p", words(2, 12), 0) + "<input name=q>" + el("div", words(1, 4), 0), 0, cls(["search", "newsletter", "login"])))
        if r.random() < 0.7:
            inner = r.choice([words(2, 25), el("p", words(3, 40), 0), el("ul", links(0), 0) + el("div", words(3, 15), 0)])
            out.append(el(*r.choice([("footer", inner, 0), ("div", inner, 0, r.choice(['class="footer"', 'id="footer"', 'class="site-footer"']))])))
        return "".join(out)

    pages = []
    for _ in range(n):
        core = article()
        kind = r.random()
        if kind < 0.35:
            core = el("article", core, 1, cls(["post", "entry", "hentry", "story"]))
        elif kind < 0.55:
            core = el("main", r.choice([core, el("article", core, 1)]), 1)
        elif kind < 0.85:
            core = el("div", core, 1, cls(["content", "post", "entry-content", "article-body", "main", "story", "text"]))
        elif kind < 0.92:
            core = el("section", core, 1, cls(["content", "article", "main"]))
        if r.random() < 0.3:
            core = el("div", chrome_top() + core + chrome_end(), 1, cls([
                "container", "wrapper", "page", "row", "site-content has-sidebar", "wrap nav-closed", "content-with-sidebar"]))
        if r.random() < 0.08:
            core = el("form", core, 1, 'action="/"')
        pages.append(f"<html><body>{chrome_top()}{core}{chrome_end()}</body></html>")
    return pages


def fit(pages: list[str], rounds: int = 60, rate: float = 0.15, ridge: float = 2e-3) -> tuple[np.ndarray, np.ndarray]:
    """Weights and edge potentials that maximise the likelihood of labelled pages (Adam on the exact gradient)."""
    data = []
    for source in pages:
        page = Page(source)
        y = np.array([page.labels.get(k, 1) for k in range(len(page.tag))])
        data.append((page.parent, features(page), y))
    total = sum(len(y) for _, _, y in data)
    w = np.zeros(N_FEATURES + 4)
    first, second = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, rounds + 1):
        grad = -ridge * w
        for parent, x, y in data:
            m, pair, _ = marginals(parent, x @ w[:N_FEATURES], w[N_FEATURES:].reshape(2, 2))
            grad[:N_FEATURES] += x.T @ (y - m) / total
            seen = np.zeros((2, 2))
            np.add.at(seen, (y[np.array(parent[1:], int)], y[1:]), 1)
            grad[N_FEATURES:] += (seen - pair[1:].sum(axis=0)).ravel() / total
        first = 0.9 * first + 0.1 * grad
        second = 0.99 * second + 0.01 * grad * grad
        w += rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
    return w[:N_FEATURES], w[N_FEATURES:].reshape(2, 2)


@functools.lru_cache(maxsize=4)
def trained(n: int = 240, seed: int = 5):
    return fit(labelled_pages(n, seed))


def main_text(source: str | None, model) -> str:
    """Blocks judged content, in page order, one line each."""
    if not source:
        return ""
    page = Page(source)
    m, _, _ = marginals(page.parent, features(page) @ model[0], model[1])
    return "\n".join(run for block, run in page.runs if m[block] >= 0.5)


def _extract(model):
    def run(batches):
        for batch in batches:
            text = [main_text(h, model) for h in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(text, pa.string()),
                 pa.array([len(t) for t in text], pa.int64())], names=["page_id", "url", "text", "n_chars"])
    return run


def extract(pages: DataFrame, n_labelled: int = 240, seed: int = 5) -> DataFrame:
    """``pages(page_id, url, html)`` -> ``(page_id, url, text, n_chars)``."""
    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                        F.col("html").cast("string").alias("html")).mapInArrow(
        _extract(trained(n_labelled, seed)), "page_id long, url string, text string, n_chars long")
