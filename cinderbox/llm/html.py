"""HTML extraction: a recurrent block labeller over the leaf blocks of a page.

A page is cut into leaf blocks (text between block-level tags), each with the
path of open tags above it. A bidirectional LSTM in numpy reads, block after
block, a vector of the path (hashed tag names and the words of their classes and
ids), a vector of the block's hashed words and its length and link share, and
labels every block as article or not with the whole page as context.

The network is trained here, seeded, on synthetic pages that this module writes
itself: menus, headers, footers, sidebars, notices, adverts, forms and reader
comments around and inside articles of many layouts. No page of the input is
learned from. Training takes a few seconds on the driver, once a process, and
the weights (a fixed size) go to the workers as a broadcast.

Tokenising follows the HTML standard where it matters to text: comments, raw
text of scripts and styles, attributes (a quote begins a value only after an
equals sign), implied end tags, and a tag that the page's end cuts off is not
text. It takes time in proportion to the page, however deep its tags are nested.

Defined cases: null, empty and textless pages give an empty text; pages of any
length are read whole; repeated rows give equal texts; other columns pass by, except those
named like a result.
"""

from __future__ import annotations

import bisect
import functools
import html as entities
import random
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import table

# Fixed values of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br button cite code data del dfn em font i img input ins kbd label mark q rp rt ruby s samp small span"
                   " strike strong sub sup time tt u var wbr".split())
RAW_TEXT = frozenset("script style xmp iframe noembed noframes".split())
PLAIN_TEXT = frozenset("title textarea".split())
ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6"
                   " header hgroup hr main menu nav ol p pre section table ul".split())
IMPLIED = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
           "option": {"option"}, "tbody": {"tr", "td", "th", "thead", "tbody"}, "tfoot": {"tr", "td", "th", "tbody"}}
SCOPES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "option": {"select"},
          "tbody": {"table"}, "tfoot": {"table"}}

#: A tag: its attributes are names, each with a value in quotes or without, or without a value.
_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*)((?:[\s/]++|[^\s/>][^\s/>=]*+(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>"'][^\s>]*+|(?=>)))?+)*+)>""")
_LOOSE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*+)>")
_NAMES = re.compile(r"""(?:^|\s)(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_WORD = re.compile(r"[a-z]+")
_RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])", re.I) for t in RAW_TEXT | PLAIN_TEXT}

PATH_BUCKETS, WORD_BUCKETS, NUMBERS = 512, 64, 3
HIDDEN = 16


@dataclass
class Block:
    path: int  # a bit for each bucket of the features of the open tags
    text: str
    links: int  # characters inside links


@functools.lru_cache(100_000)
def _level(name: str, attrs: str) -> int:
    """Buckets of the features of one open tag: its name, and the words of its class, id and role."""
    out = 1 << zlib.crc32(f"<{name}>".encode()) % PATH_BUCKETS
    for groups in _NAMES.findall(attrs):
        for w in _WORD.findall("".join(groups).lower()):
            out |= 1 << zlib.crc32(w.encode()) % PATH_BUCKETS
    return out


class _Open:
    """The open tags, with what finds one of them without a look at all: their places by name, and those that are not inline."""

    def __init__(self):
        self.names: list[str] = []
        self.paths = [0]  # features of all levels up to each
        self.at: dict[str, list[int]] = {}
        self.solid: list[int] = []

    def push(self, name: str, attrs: str) -> None:
        k = len(self.names)
        self.names.append(name)
        self.paths.append(self.paths[-1] | _level(name, attrs))
        self.at.setdefault(name, []).append(k)
        if name not in INLINE:
            self.solid.append(k)

    def pop(self) -> str:
        name = self.names.pop()
        self.paths.pop()
        self.at[name].pop()
        if name not in INLINE:
            self.solid.pop()
        return name

    def last(self, name: str) -> int:
        """The place of the innermost tag of this name, or -1."""
        own = self.at.get(name)
        return own[-1] if own else -1

    def ended_by(self, name: str) -> int:
        """The place of the outermost tag that an opening tag ends by implication, or -1."""
        found = -1
        if name in ENDS_P and self.solid and self.names[self.solid[-1]] == "p":
            found = self.solid[-1]
        if name in IMPLIED:
            scope = max(map(self.last, SCOPES[name]))
            for other in IMPLIED[name]:
                own = self.at.get(other, ())
                k = bisect.bisect_right(own, scope)
                if k < len(own) and (found < 0 or own[k] < found):
                    found = own[k]
        return found


def blocks(page: str) -> list[Block]:
    """The leaf blocks with text, in page order."""
    out: list[Block] = []
    stack = _Open()
    pieces: list[str] = []
    linked, in_link = 0, 0

    def flush() -> None:
        nonlocal linked
        if pieces:
            text = " ".join("".join(pieces).split())
            pieces.clear()
            if text:
                out.append(Block(stack.paths[-1], text, linked))
            linked = 0

    def add(raw: str) -> None:
        nonlocal linked
        if raw:
            pieces.append(text := entities.unescape(raw) if "&" in raw else raw)
            if in_link:
                linked += len(text)

    def pop_to(k: int) -> None:
        nonlocal in_link
        if stack.solid and stack.solid[-1] >= k:
            flush()
        while len(stack.names) > k:
            in_link -= stack.pop() == "a"

    at, n = 0, len(page)
    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            add(page[at:])
            break
        add(page[at:lt])
        after = page[lt + 1:lt + 2]
        if page.startswith("<!--", lt):
            if page.startswith((">", "->"), lt + 4):
                at = page.index(">", lt) + 1
            else:
                end = page.find("-->", lt + 4)
                at = n if end < 0 else end + 3
            continue
        if after in ("!", "?") or after == "/" and not page[lt + 2:lt + 3].isalpha():
            end = page.find(">", lt)
            at = n if end < 0 else end + 1
            continue
        if not (after.isascii() and after.isalpha() or after == "/"):
            pieces.append("<")
            at = lt + 1
            continue
        tag = _TAG.match(page, lt)
        if tag is None:  # a quote that never ends: up to the next >, or else the page breaks off inside the tag
            tag = _LOOSE.match(page, lt)
            if tag is None:
                break
        at = tag.end()
        name = tag[2].lower()
        if tag[1]:
            k = stack.last(name)
            if name == "br" or name == "p" and k < 0:
                flush()
            elif k >= 0:
                pop_to(k)
            continue
        if (k := stack.ended_by(name)) >= 0:
            pop_to(k)
        if name not in INLINE:
            flush()
        if name == "br":
            pieces.append(" ")
        if name in VOID:
            continue
        if name in _RAW_END:
            end = _RAW_END[name].search(page, at)
            inner = page[at:end.start() if end else n]
            if name in PLAIN_TEXT:
                stack.push(name, tag[3])
                add(inner)
                flush()
                stack.pop()
            close = page.find(">", end.end()) if end else -1
            at = n if close < 0 else close + 1
            continue
        if not tag[3].endswith("/") or name not in ("svg", "path"):
            stack.push(name, tag[3])
            in_link += name == "a"
    flush()
    return out


# ---------------------------------------------------------------- features

@functools.lru_cache(200_000)
def _word_bucket(word: str) -> int:
    return zlib.crc32(word.lower().encode()) % WORD_BUCKETS


@functools.lru_cache(100_000)
def _path_buckets(path: int) -> tuple[int, ...]:
    return tuple(k for k in range(PATH_BUCKETS) if path >> k & 1)


def word_features(found: list[Block]) -> np.ndarray:
    """Shares of the word buckets, and length in words, link share and a constant."""
    sizes, at = [], []
    for i, b in enumerate(found):
        words = b.text.split(" ")
        sizes.append(len(words))
        base = i * WORD_BUCKETS
        at += [base + _word_bucket(w) for w in words]
    n = len(found)
    count = np.array(sizes, np.float64)
    shares = np.bincount(np.array(at, np.int64), minlength=n * WORD_BUCKETS).reshape(n, WORD_BUCKETS) / np.sqrt(count)[:, None]
    links = np.array([b.links / max(1, len(b.text)) for b in found])
    return np.concatenate([np.minimum(shares, 2.0), np.stack([np.log1p(count) / 5, np.minimum(links, 1.0), np.ones(n)], 1)], 1)


# ---------------------------------------------------------------- network

def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


@dataclass
class Network:
    """Weights; inputs of both directions' gates (input, forget, output, cell) are side by side."""

    path: np.ndarray  # PATH_BUCKETS x 8 HIDDEN
    word: np.ndarray  # WORD_BUCKETS + NUMBERS x 8 HIDDEN
    ahead: np.ndarray  # HIDDEN x 4 HIDDEN
    back: np.ndarray
    out: np.ndarray  # 2 HIDDEN + 1
    projected: dict = field(default_factory=dict)

    @classmethod
    def fresh(cls, rng: np.random.Generator) -> Network:
        def of(*shape):
            return rng.normal(0, 1 / np.sqrt(shape[0] if shape[0] <= 64 else 16), shape)

        net = cls(of(PATH_BUCKETS, 8 * HIDDEN), of(WORD_BUCKETS + NUMBERS, 8 * HIDDEN) * 0.3, of(HIDDEN, 4 * HIDDEN), of(HIDDEN, 4 * HIDDEN), of(2 * HIDDEN + 1) * 0.5)
        for k in (1, 5):  # forget gates start open
            net.word[-1, k * HIDDEN:(k + 1) * HIDDEN] += 1
        return net

    def weights(self) -> list[np.ndarray]:
        return [self.path, self.word, self.ahead, self.back, self.out]

    def project(self, paths: list[tuple[int, ...]], words: np.ndarray) -> np.ndarray:
        """Gate inputs of blocks."""
        rows = np.empty((len(paths), 8 * HIDDEN))
        for i, p in enumerate(paths):
            v = self.projected.get(p)
            if v is None:
                if len(self.projected) > 50_000:
                    self.projected.clear()
                v = self.projected[p] = self.path[list(p)].sum(0) if p else np.zeros(8 * HIDDEN)
            rows[i] = v
        return rows + words @ self.word

    def run(self, x: np.ndarray, mask: np.ndarray):
        """x: steps x pages x 8 HIDDEN. The scores, and what the gradient needs."""
        held = []
        for inputs, u, order in ((x[..., :4 * HIDDEN], self.ahead, range(len(x))), (x[..., 4 * HIDDEN:], self.back, range(len(x) - 1, -1, -1))):
            h = c = np.zeros((x.shape[1], HIDDEN))
            hs, keep = np.zeros((len(x), x.shape[1], HIDDEN)), [None] * len(x)
            for t in order:
                z = inputs[t] + h @ u
                s, g, m = _sigmoid(z[:, :3 * HIDDEN]), np.tanh(z[:, 3 * HIDDEN:]), mask[t][:, None]
                i, f, o = s[:, :HIDDEN], s[:, HIDDEN:2 * HIDDEN], s[:, 2 * HIDDEN:]
                c2 = (f * c + i * g) * m
                th = np.tanh(c2)
                keep[t] = (h, c, i, f, o, g, th, m)
                h, c = o * th * m, c2
                hs[t] = h
            held.append((hs, keep, u, order))
        both = np.concatenate([held[0][0], held[1][0]], 2)
        return both @ self.out[:-1] + self.out[-1], both, held

    def gradient(self, dscore: np.ndarray, both: np.ndarray, held) -> tuple[np.ndarray, list[np.ndarray]]:
        dout = np.concatenate([np.einsum("tbh,tb->h", both, dscore), [dscore.sum()]])
        dboth = dscore[..., None] * self.out[:-1]
        dxs, dus = [], []
        for k, (_, keep, u, order) in enumerate(held):
            dh_all = dboth[..., k * HIDDEN:(k + 1) * HIDDEN]
            dx, du = np.zeros((*dscore.shape, 4 * HIDDEN)), np.zeros_like(u)
            dh = dc = np.zeros((dscore.shape[1], HIDDEN))
            for t in reversed(order):
                h, c, i, f, o, g, th, m = keep[t]
                dh = (dh + dh_all[t]) * m
                dct = (dc + dh * o * (1 - th * th)) * m
                dz = np.concatenate([dct * g * i * (1 - i), dct * c * f * (1 - f), dh * th * o * (1 - o), dct * i * (1 - g * g)], 1)
                dx[t] = dz
                du += h.T @ dz
                dh, dc = dz @ u.T, dct * f
            dxs.append(dx)
            dus.append(du)
        return np.concatenate(dxs, 2), [*dus, dout]


def batches(lengths: list[int], cells: int = 60_000, most: int = 256) -> Iterator[list[int]]:
    """Pages of like length together, so that padding stays small; a long page runs alone."""
    held: list[int] = []
    for i in sorted((i for i, n in enumerate(lengths) if n), key=lambda i: lengths[i]):
        if held and (len(held) == most or lengths[i] * (len(held) + 1) > cells):
            yield held
            held = []
        held.append(i)
    if held:
        yield held


def _padded(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    steps = max(map(len, rows))
    x, mask = np.zeros((steps, len(rows), rows[0].shape[1])), np.zeros((steps, len(rows)))
    for k, r in enumerate(rows):
        x[:len(r), k], mask[:len(r), k] = r, 1
    return x, mask


def label(net: Network, pages: list[list[Block]]) -> list[list[bool]]:
    """For each page whether each of its blocks belongs to the article."""
    out: list[list[bool]] = [[] for _ in pages]
    for own in batches([len(p) for p in pages]):
        flat = [b for i in own for b in pages[i]]
        x = net.project([_path_buckets(b.path) for b in flat], word_features(flat))
        ends = np.cumsum([len(pages[i]) for i in own])[:-1]
        padded, mask = _padded(np.split(x, ends))
        scores = net.run(padded, mask)[0]
        for k, i in enumerate(own):
            out[i] = (scores[:len(pages[i]), k] > 0).tolist()
    return out


# ---------------------------------------------------------------- training pages

MARK = "\ue000"  # begins each article block of a training page
_SYLLABLES = "the and ing tion er ou re st an en on th is ed sch ung ein ich auf lich keit ent ción ado ez que mente los llo eau eux oi ré è ç ü ö ß ñ ly ble sh wh".split()
_JUNK = {
    "nav": (["<nav>", '<ul class="menu">', '<div id="nav">', '<div class="navbar">', '<div class="breadcrumb">', '<div class="navigation">', '<ul id="menu">', '<div class="main-menu">', '<div role="navigation">'], "home about contact archive login products blog next previous"),
    "header": (["<header>", '<div class="header">', '<div id="masthead">', '<div class="topbar">', '<div class="site-header">', '<div id="header">', '<header class="banner">', '<div class="logo">'], "welcome site daily news our"),
    "footer": (["<footer>", '<div class="footer">', '<div id="footer">', '<div class="copyright">', '<div class="site-info">', '<footer class="page-footer">', '<div class="colophon">'], "copyright rights reserved privacy policy terms imprint © ·"),
    "aside": (["<aside>", '<div class="sidebar">', '<div id="secondary">', '<div class="widget">', '<div class="related">', '<section class="recommended">', '<aside class="sidebar">', '<div class="trending">', '<div class="more">', '<div class="popular">'], "related popular more stories trending tags"),
    "ad": (['<div class="ad">', '<div class="ads">', '<div class="advert">', '<div class="advertisement">', '<div class="banner-ad">', '<div class="sponsored">', '<div class="promo">', '<ins class="adsbygoogle">', '<div id="ad-top">', '<div class="promotion">', '<section class="ad">'], "buy now sale offer sponsored advertisement"),
    "notice": (['<div class="cookie">', '<div class="cookie-notice">', '<div id="consent">', '<div class="gdpr">', '<div class="notice">', '<div class="alert">', '<div class="popup">', '<div class="newsletter">', '<div class="subscribe">', '<div class="modal">', '<div class="cookie-banner">', '<div role="alert">', "<noscript>", "<dialog>", '<section class="notice">', '<div class="paywall">'], "we use cookies accept consent privacy subscribe enable javascript"),
    "form": (["<form>", '<form class="search">', '<form id="login">', '<form action="/subscribe">', '<div class="search"><form>', "<fieldset>", '<form method="post">'], "search name email password submit message"),
    "comments": (['<div class="comments">', '<section id="comments">', '<ol class="comment-list">', '<div id="disqus_thread">', '<div class="comment">', '<section class="comments">', '<div class="replies">', '<div id="respond">', '<ul class="comments">', '<div class="user-comments">', '<div class="discussion">'], "reply says comment posted great thanks"),
    "share": (['<div class="share">', '<div class="social">', '<ul class="tags">', '<div class="pagination">', '<div class="sharing">', '<div class="social-links">'], "share tweet facebook email print"),
}
_MAIN = ["<article>", "<main>", '<div class="content">', '<div id="content">', '<div class="post">', '<div class="entry-content">', '<div class="article-body">',
         '<section class="story">', '<div class="text">', '<div class="post-body">', '<article class="post">', '<main id="main">', '<div id="main">', '<section>',
         '<div class="article">', '<div class="body">', '<div class="page-content">', '<div itemprop="articleBody">', "<div>", ""]


def _closing(opening: str) -> str:
    return "".join(f"</{t}>" for t in reversed(re.findall(r"<([a-z0-9]+)", opening)))


def training_page(rng: random.Random) -> str:
    """A page whose article blocks begin with MARK."""
    vocabulary = [rng.choice(["", "", "", "&amp;", "$"]) + "".join(rng.choice(_SYLLABLES) for _ in range(rng.randint(1, 4))) for _ in range(rng.choice([3, 20, 60]))]
    loud, dull = rng.random() < 0.25, rng.random() < 0.15
    noise = rng.choice([["###", "***", "&amp;&amp;", "%%%", "$$$"], ["!!"], [" |"], ["###", "!!", " |", " 1234"]])

    def words(n: int) -> str:
        out = [rng.choice(vocabulary) for _ in range(n)]
        if dull and rng.random() < 0.7:
            out = [rng.choice(vocabulary[:3])] * n
        out = [w + rng.choice(noise) for w in out] if loud and rng.random() < 0.8 else out
        if rng.random() < 0.15:
            k = rng.randrange(len(out))
            out[k] = rng.choice(["<b>%s</b>", "<i>%s</i>", '<a href="/x">%s</a>', "<span>%s</span>", "%s 1234", '"%s"']) % out[k]
        return " ".join(out).capitalize() + rng.choice([".", ".", "", "?"])

    def junk(kind: str) -> str:
        openings, known = _JUNK[kind]
        opening = rng.choice(openings)
        known = known.split()

        def some(a: int, b: int) -> str:
            n = rng.randint(a, b)
            return " ".join(rng.choice(known) for _ in range(min(n, 8))) if rng.random() < 0.35 else words(n)

        items = rng.randint(1, 7)
        if kind in ("nav", "share") or kind == "aside" and rng.random() < 0.5:
            inner = "".join(f'<li><a href="/{i}">{some(1, 3)}</a></li>' for i in range(items))
            inner = inner if opening.startswith("<ul") else f"<ul>{inner}</ul>" if rng.random() < 0.7 else re.sub("</?li>", " ", inner)
        elif kind == "form":
            inner = "".join(rng.choice([f"<label>{some(1, 3)}</label><input name=x>", f"<p>{some(1, 10)}</p>", f"<button>{some(1, 2)}</button>",
                                        f"<select><option>{some(1, 2)}<option>{some(1, 2)}</select>", f"<textarea>{some(1, 6)}</textarea>", some(1, 8)]) for _ in range(rng.randint(1, 4)))
        elif kind == "comments":
            item = rng.choice(['<li class="comment"><p>%s</p></li>', '<div class="comment"><div class="author">%s</div><p>%s</p></div>', "<p>%s</p>", '<article class="comment"><p>%s</p></article>', "<li>%s</li>"])
            inner = (f"<h3>{some(1, 3)}</h3>" if rng.random() < 0.5 else "") + "".join(item.replace("%s", "{}").format(*[some(2, 40) for _ in range(item.count("%s"))]) for _ in range(rng.randint(1, 5)))
        else:
            inner = rng.choice([f"<p>{some(2, 30)}</p>", some(1, 25), f"<h3>{some(1, 4)}</h3><p>{some(3, 25)}</p>", f"<p>{some(2, 9)}</p><p>{some(2, 20)}</p>",
                                f'{some(2, 8)} <a href="/">{some(1, 3)}</a>', f"<h4>{some(1, 3)}</h4><ul><li>{some(1, 6)}</li></ul>", f"<div>{some(1, 8)}</div>"])
        return opening + inner + _closing(opening)

    def main_block() -> str:
        n = rng.choice([1, 2, 4, 8, 15, 30, 60])
        kind = rng.random()
        if kind < 0.6:
            return rng.choice([f"<p>{MARK}{words(n)}</p>", f"<p>{MARK}{words(n)}", f"<p><b>{MARK}{words(n)}<br>"])
        if kind < 0.7:
            h = rng.choice(["h2", "h3"])
            return f"<{h}>{MARK}{words(min(n, 8))}</{h}>"
        if kind < 0.8:
            t = rng.choice(["ul", "ol"])
            return f"<{t}>" + "".join(f"<li>{MARK}{words(min(n, 15))}</li>" for _ in range(rng.randint(1, 5))) + f"</{t}>"
        if kind < 0.85:
            return f"<blockquote><p>{MARK}{words(n)}</p></blockquote>"
        if kind < 0.9:
            return "<table>" + "".join(f"<tr><td>{MARK}{words(2)}</td><td>{MARK}{words(3)}</td></tr>" for _ in range(rng.randint(1, 3))) + "</table>"
        if kind < 0.94:
            return f"<figure><figcaption>{MARK}{words(min(n, 12))}</figcaption></figure>"
        return rng.choice([f"<div>{MARK}{words(n)}</div>", f"<pre>{MARK}{words(n)}</pre>"])

    outer = rng.choice(["", "", '<div id="page">', '<div class="wrapper">', '<div class="container">', "<main>", '<div class="site">'])
    opening = rng.choice(_MAIN[:2] if rng.random() < 0.35 else _MAIN)
    head = f"<!DOCTYPE html><html><head><title>{words(5)}</title><style>p{{}}</style><script>var a='<p>';</script></head><body>"
    before = [junk(k) for k in ("header", "nav", "ad", "notice", "aside", "form", "nav") if rng.random() < 0.4]
    after = [junk(k) for k in ("share", "comments", "form", "aside", "ad", "footer", "notice", "footer") if rng.random() < 0.4]
    rng.random() < 0.5 and rng.shuffle(before)
    title = f"<h1>{MARK}{words(rng.randint(1, 10))}</h1>" if rng.random() < 0.7 else ""
    body = [title] + [main_block() for _ in range(rng.choice([0, 1, 2, 4, 8, 14]) + (not title))]
    for k in ("ad", "ad", "share", "aside", "notice", "form", "comments"):
        if rng.random() < 0.12:
            body.insert(rng.randint(1, len(body)), junk(k))
    if rng.random() < 0.05:
        body = []
    page = head + outer + "".join(before) + opening + "".join(body) + _closing(opening) + "".join(after) + _closing(outer)
    return page + ("</body></html>" if rng.random() < 0.8 else "")


PAGES, EPOCHS, BATCH, RATE, SEED = 2500, 8, 24, 0.01, 11


@functools.lru_cache(1)
def trained(pages: int = PAGES, epochs: int = EPOCHS, seed: int = SEED) -> Network:
    """The network, trained by Adam on synthetic pages; the same weights for the same arguments."""
    rng, np_rng = random.Random(seed), np.random.default_rng(seed)
    net = Network.fresh(np_rng)
    data = []
    for _ in range(pages):
        found = blocks(training_page(rng))
        if not found:
            continue
        y = np.array([b.text.startswith(MARK) for b in found], float)
        for b in found:
            b.text = b.text.replace(MARK, "")
        data.append(([_path_buckets(b.path) for b in found], word_features(found), y))
    moments = [(np.zeros_like(w), np.zeros_like(w)) for w in net.weights()]
    step, steps = 0, epochs * -(-len(data) // BATCH)
    for _ in range(epochs):
        order = sorted(np_rng.permutation(len(data)), key=lambda i: len(data[i][2]) // 8)
        groups = [order[i:i + BATCH] for i in range(0, len(order), BATCH)]
        for g in np_rng.permutation(len(groups)):
            own = [data[i] for i in groups[g]]
            net.projected.clear()
            # now and then a path feature is unseen, as on pages of other makers
            paths = [[tuple(k for k in p if np_rng.random() > 0.05) for p in d[0]] for d in own]
            # and for some pages the words are hidden: layout comes first
            texts = [d[1] * np.concatenate([np.full(WORD_BUCKETS, float(np_rng.random() > 0.4)), np.ones(NUMBERS)]) for d in own]
            x, mask = _padded([net.project(p, t) for p, t in zip(paths, texts, strict=True)])
            score, both, held = net.run(x, mask)
            y = _padded([d[2][:, None] for d in own])[0][..., 0]
            dscore = (_sigmoid(score) - y) * mask / mask.sum()
            dx, (da, db, dout) = net.gradient(dscore, both, held)
            dpath, dword = np.zeros_like(net.path), np.zeros_like(net.word)
            for k, d in enumerate(own):
                own_dx = dx[:len(d[2]), k]
                dword += texts[k].T @ own_dx
                np.add.at(dpath, [b for p in paths[k] for b in p], np.repeat(own_dx, [len(p) for p in paths[k]], axis=0))
            step += 1
            lr = RATE * (1 - step / (steps + 1))
            for w, d, (m, v) in zip(net.weights(), (dpath, dword, da, db, dout), moments, strict=True):
                m += 0.1 * (d - m)
                v += 0.001 * (d * d - v)
                w -= lr * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
    net.projected.clear()
    return net


# ---------------------------------------------------------------- the operator

#: Characters of html that are labelled together.
CHUNK = 4 << 20


def main_text(net: Network, pages: list[str | None]) -> list[str]:
    found = [blocks(p or "") for p in pages]
    return ["\n".join(b.text for b, keep in zip(own, kept, strict=True) if keep) for own, kept in zip(found, label(net, found), strict=True)]


def extract(df: DataFrame, html: str = "html", out: str = "text") -> DataFrame:
    """The other columns of ``df`` with the page's main text and its length ``n_chars``."""
    sent = df.sparkSession.sparkContext.broadcast(trained())
    kept = [c for c in df.columns if c not in (html, out, "n_chars")]
    schema = ", ".join([*(f"`{c}` {t}" for c, t in df.dtypes if c in kept), f"`{out}` string, n_chars bigint"])

    def extracted(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = sent.value
        for b in rows:
            texts, held, size = [], [], 0
            for page in (x.as_py() for x in b.column(len(kept))):
                held.append(page)
                size += len(page or "")
                if size >= CHUNK:
                    texts += main_text(net, held)
                    held, size = [], 0
            texts += main_text(net, held)
            yield pa.RecordBatch.from_arrays([*b.columns[:len(kept)], pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                                             names=[*kept, out, "n_chars"])

    return df.select(*kept, html).mapInArrow(extracted, schema)


def op1_html_text(spark, sf_dir):
    return extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
