"""Main text of web pages by a recurrent block labeller.

A page is read as the sequence of its leaf blocks: runs of text between block-level tags, each with the path of open
elements, their class and id words, and its own words. Path and words are hashed to fixed vectors, a few measures are
added, and a bidirectional LSTM in numpy reads the whole sequence both ways before it labels any block, so each label
uses the context of the document. Blocks labelled as content are joined in page order.

The LSTM is trained here, on ``EXAMPLES`` pages that a seeded generator writes: articles among menus, headers, footers,
sidebars, notices, adverts, forms and reader comments, before, after and inside the article, under many tags and names or
none, with missing end tags and without. Words are made up, but for some phrases that pages have around their text.
No page of the table is used, so the model is the same at every size; it travels with the task closure (about 300 kB).

Null html counts as empty; pages without content give an empty text. Pages are independent, so repeated rows get equal
results. Long pages are read whole: time grows with their length alone, however deep elements are nested, and the labeller
goes over ``STEPS`` blocks at a time. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import html as html_lib
import random
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import cache, lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from .common import field, table

PATH_DIM, WORD_DIM, HIDDEN = 128, 64, 24
EXAMPLES, EPOCHS, BATCH, SEED = 3000, 6, 32, 11
PAGES_AT_ONCE = 128
#: Blocks that the labeller holds vectors of at once, and characters of html that become blocks at once.
STEPS, CHARS_AT_ONCE = 16_384, 1 << 23
#: An attribute's value may be quoted after its equals sign alone; elsewhere quotes are letters like others. A quote that
#: isn't closed begins a name, so such a tag ends at the next ">"; a tag without one is dropped with what follows.
ATTRIBUTE = r"""[\s/]++|=?+[^\s/>=]++(?:\s*+=\s*+(?:"[^"]*"|'[^']*'|[^\s"'>][^\s>]*+)?+)?+|="""
TAG = rf"</?[a-zA-Z][^\s/>]*+(?:{ATTRIBUTE})*+(?:>|\Z)"
TOKEN = re.compile(rf"<!--(?:-?>|.*?(?:--!?>|\Z))|<!\[CDATA\[.*?(?:\]\]>|\Z)|<![^>]*(?:>|\Z)|<\?[^>]*(?:>|\Z)|{TAG}|</(?:>|[^a-zA-Z>][^>]*(?:>|\Z))|[^<]+|<", re.S)
NAME = re.compile(r"</?([a-zA-Z][a-zA-Z0-9:-]*)")
NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
PARTS = re.compile(r"[a-z]+|[0-9]+")
RAW = {"script", "style", "noscript", "template", "svg", "iframe", "textarea", "select"}
RAW_END = {t: re.compile(rf"</{t}\b[^>]*>", re.I) for t in RAW}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
CLOSED_BY = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}


#: What an end of a paragraph or list item isn't looked for beyond.
HOLDERS = ("ul", "ol", "dl", "table", "div", "article", "section", "body", "td", "th", "li", "tr")


class Block:
    """A leaf block: the hashed marks of its open elements as bits, its text, how many of its characters are links."""

    __slots__ = ("path", "text", "link_chars")

    def __init__(self, path: int, text: str, link_chars: int):
        self.path, self.text, self.link_chars = path, text, link_chars


@lru_cache(4096)
def element(tag: str) -> tuple[str, int]:
    """Name of a start tag and its marks: the name and the words of its class, id and role, hashed to bits."""
    name = NAME.match(tag).group(1).lower()
    words = {w for m in NAMES.finditer(tag) for w in PARTS.findall((m.group(1) or m.group(2) or m.group(3) or "").lower())}
    bits = 0
    for w in {name, *words}:
        bits |= 1 << zlib.crc32(w.encode()) % PATH_DIM
    return name, bits


class Open:
    """The open elements of a page. Each operation's time is the same at every depth, but for the elements it closes."""

    def __init__(self) -> None:
        self.names: list[str] = []
        self.paths = [0]
        self.at: dict[str, list[int]] = defaultdict(list)
        self.blocks: list[int] = []

    def last(self, *names: str) -> int:
        return max((self.at[x][-1] for x in names if self.at[x]), default=-1)

    def push(self, name: str, bits: int) -> None:
        self.at[name].append(len(self.names))
        if name not in INLINE:
            self.blocks.append(len(self.names))
        self.names.append(name)
        self.paths.append(self.paths[-1] | bits)

    def close(self, low: int) -> None:
        while len(self.names) > low:
            name = self.names.pop()
            self.paths.pop()
            self.at[name].pop()
            if name not in INLINE:
                self.blocks.pop()


def blocks(page: str) -> list[Block]:
    """The leaf blocks of a page in order, text decoded and white space joined."""
    out: list[Block] = []
    parts: list[str] = []
    opened = Open()
    links = 0

    def flush() -> None:
        nonlocal links
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                out.append(Block(opened.paths[-1], text, links))
            parts.clear()
        links = 0

    at, scan = 0, TOKEN.match
    while m := scan(page, at):
        at, piece = m.end(), m.group()
        if piece[0] != "<" or len(piece) == 1:
            piece = html_lib.unescape(piece) if "&" in piece else piece
            parts.append(piece)
            if opened.at["a"]:
                links += len(piece)
        elif piece[1] in "!?":
            if piece.startswith("<![CDATA["):
                parts.append(piece[9:].removesuffix("]]>"))
        elif piece[1] == "/":
            found = NAME.match(piece)
            if not found:
                continue
            name = found.group(1).lower()
            if name not in INLINE:
                flush()
            low = opened.last(name)
            # An inline end tag doesn't reach over open blocks.
            if low >= 0 and (name not in INLINE or not opened.blocks or opened.blocks[-1] < low):
                opened.close(low)
        else:
            name, bits = element(piece) if len(piece) < 300 else element.__wrapped__(piece)
            if name in RAW:
                end = RAW_END[name].search(page, at)
                at = end.end() if end else len(page)
                continue
            if name not in INLINE:
                flush()
                if name in CLOSED_BY:
                    low = opened.last(*CLOSED_BY[name])
                    if low >= 0 and low >= opened.last(*HOLDERS):
                        opened.close(low)
            if name == "br":
                parts.append(" ")
            elif name not in VOID and not piece.endswith("/>"):
                opened.push(name, bits)
    flush()
    return out


DIM = PATH_DIM + WORD_DIM + 6
crc = zlib.crc32


def features(page: list[Block], lo: int = 0, hi: int | None = None) -> np.ndarray:
    """The vectors of blocks lo to hi of a page."""
    hi, n_blocks = len(page) if hi is None else hi, len(page)
    out = np.zeros((hi - lo, DIM), np.float32)
    if hi > lo:
        paths = np.frombuffer(b"".join(b.path.to_bytes(PATH_DIM // 8, "little") for b in page[lo:hi]), np.uint8).reshape(hi - lo, -1)
        out[:, :PATH_DIM] = np.unpackbits(paths, axis=1, bitorder="little")
    for i, b in enumerate(page[lo:hi]):
        x, text = out[i], b.text
        w = text.lower().split(" ")
        x[PATH_DIM : PATH_DIM + WORD_DIM] = np.minimum(np.bincount([crc(y.encode("utf-8", "surrogatepass")) & (WORD_DIM - 1) for y in w], minlength=WORD_DIM) / min(len(w), 12), 1)
        n = len(text)
        x[-6:] = (np.log1p(len(w)) / 4, min(1.0, b.link_chars / n), (text.count(".") + text.count(",")) / len(w), text[-1] in ".!?", (lo + i) / n_blocks, 1 / (1 + n_blocks - lo - i))
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


class Direction:
    """One direction of the LSTM over padded batches (time, pages, features)."""

    def __init__(self, rng: np.random.Generator):
        self.w = rng.normal(0, 0.08, (DIM, 4 * HIDDEN)).astype(np.float32)
        self.u = rng.normal(0, 0.15, (HIDDEN, 4 * HIDDEN)).astype(np.float32)
        self.b = np.zeros(4 * HIDDEN, np.float32)
        self.b[HIDDEN : 2 * HIDDEN] = 1

    def forward(self, x: np.ndarray, mask: np.ndarray, tape: list | None = None, state: list | None = None) -> np.ndarray:
        """The hidden states of all steps; ``state`` is where to go on from, and gets where it ends."""
        t_max, n, _ = x.shape
        xw = x @ self.w + self.b
        h, c = state or (np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32))
        out = np.empty((t_max, n, HIDDEN), np.float32)
        for t in range(t_max):
            z = xw[t] + h @ self.u
            ifo, g = _sigmoid(z[:, : 3 * HIDDEN]), np.tanh(z[:, 3 * HIDDEN :])
            i, f, o = ifo[:, :HIDDEN], ifo[:, HIDDEN : 2 * HIDDEN], ifo[:, 2 * HIDDEN :]
            m = mask[t]
            new = f * c + i * g
            tc = np.tanh(new)
            if tape is not None:
                tape.append((h, c, i, f, o, g, tc, m))
            c, h = np.where(m, new, c), np.where(m, o * tc, h)
            out[t] = h
        if state is not None:
            state[:] = h, c
        return out

    def backward(self, x: np.ndarray, dout: np.ndarray, tape: list) -> list[np.ndarray]:
        dw, du, db = np.zeros_like(self.w), np.zeros_like(self.u), np.zeros_like(self.b)
        dh, dc = np.zeros_like(dout[0]), np.zeros_like(dout[0])
        for t in range(len(tape) - 1, -1, -1):
            h, c, i, f, o, g, tc, m = tape[t]
            dh = dh + dout[t]
            own, skip = np.where(m, dh, 0), np.where(m, 0, dh)
            dnew = np.where(m, dc, 0) + own * o * (1 - tc * tc)
            dz = np.concatenate([dnew * g * i * (1 - i), dnew * c * f * (1 - f), own * tc * o * (1 - o), dnew * i * (1 - g * g)], 1)
            dw += x[t].T @ dz
            du += h.T @ dz
            db += dz.sum(0)
            dh, dc = dz @ self.u.T + skip, dnew * f + np.where(m, 0, dc)
        return [dw, du, db]


class Labeller:
    def __init__(self, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.ways = [Direction(rng), Direction(rng)]
        self.v = rng.normal(0, 0.1, (2 * HIDDEN, 1)).astype(np.float32)
        self.a = np.zeros(1, np.float32)

    def _batch(self, pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        t = max(len(p) for p in pages)
        x, mask = np.zeros((t, len(pages), DIM), np.float32), np.zeros((t, len(pages), 1), bool)
        back = np.zeros((t, len(pages)), np.int64)
        for k, p in enumerate(pages):
            x[: len(p), k], mask[: len(p), k] = p, True
            back[:, k] = np.arange(t)
            back[: len(p), k] = np.arange(len(p))[::-1]
        return x, mask, back

    def _states(self, x, mask, back, tapes=(None, None)) -> tuple[np.ndarray, np.ndarray]:
        turned = np.take_along_axis(x, back[:, :, None], 0)
        one = self.ways[0].forward(x, mask, tapes[0])
        two = np.take_along_axis(self.ways[1].forward(turned, mask, tapes[1]), back[:, :, None], 0)
        return np.concatenate([one, two], 2), turned

    def chances(self, pages: list[list[Block]], steps: int = STEPS) -> list[np.ndarray]:
        """For each page, the chance of each block to be content."""
        out: list[np.ndarray] = [np.zeros(0, np.float32)] * len(pages)
        order = sorted((k for k in range(len(pages)) if len(pages[k])), key=lambda k: len(pages[k]))
        lo = 0
        while lo < len(order):
            hi = lo + 1
            while hi < len(order) and hi - lo < PAGES_AT_ONCE and len(pages[order[hi]]) <= 1.3 * len(pages[order[lo]]) + 4 and len(pages[order[hi]]) * (hi - lo + 1) <= steps:
                hi += 1
            if len(pages[order[lo]]) > steps:
                out[order[lo]] = self._long(pages[order[lo]], steps)
            else:
                states, _ = self._states(*self._batch([features(pages[k]) for k in order[lo:hi]]))
                p = _sigmoid(states @ self.v + self.a)[:, :, 0]
                for j, k in enumerate(order[lo:hi]):
                    out[k] = p[: len(pages[k]), j]
            lo = hi
        return out

    def _long(self, page: list[Block], steps: int) -> np.ndarray:
        """The same for one page whose vectors are made ``steps`` at a time: back from its end, then on from its start."""
        n = len(page)
        back, p = np.empty((n, HIDDEN), np.float32), np.empty(n, np.float32)
        starts = list(range(0, n, steps))
        zero = np.zeros((1, HIDDEN), np.float32)
        for way, part in ((1, reversed(starts)), (0, starts)):
            state = [zero, zero]
            for lo in part:
                x = features(page, lo, min(lo + steps, n))[:, None, :]
                h = self.ways[way].forward(x[::-1] if way else x, np.ones((len(x), 1, 1), bool), None, state)[:, 0]
                if way:
                    back[lo : lo + len(x)] = h[::-1]
                else:
                    p[lo : lo + len(x)] = _sigmoid(np.concatenate([h, back[lo : lo + len(x)]], 1) @ self.v + self.a)[:, 0]
        return p

    def fit(self, pages: list[np.ndarray], labels: list[np.ndarray], epochs: int = EPOCHS, rate: float = 0.01) -> Labeller:
        params = [p for w in self.ways for p in (w.w, w.u, w.b)] + [self.v, self.a]
        first, second, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
        rng = np.random.default_rng(SEED)
        for _ in range(epochs):
            order = rng.permutation(len(pages))
            for lo in range(0, len(order), BATCH):
                some = order[lo : lo + BATCH]
                x, mask, back = self._batch([pages[k] for k in some])
                y = np.zeros(mask.shape, np.float32)
                for j, k in enumerate(some):
                    y[: len(labels[k]), j, 0] = labels[k]
                tapes: tuple[list, list] = ([], [])
                states, turned = self._states(x, mask, back, tapes)
                dlogit = np.where(mask, _sigmoid(states @ self.v + self.a) - y, 0) / max(1, int(mask.sum())) * 30
                grads = [np.einsum("tnh,tnk->hk", states, dlogit), dlogit.sum((0, 1))]
                ds = dlogit @ self.v.T
                d_two = np.take_along_axis(ds[:, :, HIDDEN:], back[:, :, None], 0)
                grads = self.ways[0].backward(x, ds[:, :, :HIDDEN], tapes[0]) + self.ways[1].backward(turned, d_two, tapes[1]) + grads
                step += 1
                for p, g, m, v in zip(params, grads, first, second):
                    g = np.clip(g, -1, 1)
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        return self


# The generator of labelled pages. A label is whether the block is main text.
CHROME = {
    "nav": ["nav", "menu", "navigation", "navbar", "breadcrumb", "breadcrumbs", "toolbar", "topbar", "tabs", "pagination", "pager", "toc"],
    "header": ["header", "masthead", "head", "top", "banner", "logo", "branding", "site header"],
    "footer": ["footer", "copyright", "bottom", "foot", "colophon", "legal", "site footer"],
    "aside": ["sidebar", "side", "widget", "related", "recommended", "popular", "trending", "more", "rail", "links", "tags", "share", "social"],
    "ad": ["ad", "ads", "advert", "advertisement", "sponsored", "promo", "promotion", "adsense", "adbox", "partner", "outbrain"],
    "notice": ["cookie", "cookies", "notice", "consent", "gdpr", "alert", "popup", "modal", "overlay", "newsletter", "subscribe", "paywall", "disclaimer"],
    "form": ["form", "search", "login", "signup", "contact form", "poll", "register"],
    "comments": ["comments", "comment", "replies", "reply", "discussion", "disqus", "responses", "respond", "user reviews", "thread"],
}
#: What pages say around their text.
SAID = {
    "nav": ["Home", "About", "Contact", "News", "Sports", "Products", "Blog", "Archive", "Next", "Previous"],
    "header": ["Welcome to our site", "Log in", "Search"],
    "footer": ["\u00a9 2024 All rights reserved", "Privacy policy", "Terms of use", "Imprint", "Copyright", "Contact us"],
    "aside": ["Related articles", "Most read", "Share this", "Read more", "You may also like", "Follow us", "Tags"],
    "ad": ["Advertisement", "Sponsored", "Buy now", "Special offer", "Click here", "Shop the sale"],
    "notice": ["We use cookies to improve your experience", "Accept all", "Subscribe to our newsletter", "Sign up today", "By continuing you agree", "Please enable JavaScript"],
    "form": ["Your name", "E-mail", "Send", "Search", "Password", "Log in", "Register"],
    "comments": ["Reply", "Leave a comment", "says", "Great post", "Thanks for sharing", "Posted by", "Report", "Likes"],
}
MAIN = ["content", "main", "post", "entry", "story", "article", "text", "body", "post content", "article body", "page", "main content", "entry content", "prose", "wrapper", "container"]
WRAPS = ["wrap", "wrapper", "container", "row", "col", "inner", "outer", "grid", "layout", "page", "site", "x1"]
#: Alphabets that words are made of: first and last code point, letters beyond.
ALPHABETS = [("a", "z", ""), ("a", "z", ""), ("a", "z", "\u00e4\u00f6\u00fc\u00e9\u00e8\u00f1\u00ed"), ("\u0430", "\u044f", ""), ("\u03b1", "\u03c9", "")]


class Voice:
    """A page's way to write: letters, length of words, signs between and after them."""

    def __init__(self, r: random.Random):
        lo, hi, more = r.choice(ALPHABETS)
        letters = [chr(c) for c in range(ord(lo), ord(hi) + 1)] + list(more) * 3
        self.r, self.parts = r, ["".join(r.choices(letters, k=r.randint(1, 3))) for _ in range(60)]
        self.noise = r.choice(["", "", "", "", "!!", "***", "%"])
        self.upper = r.random() < 0.06

    def say(self, lo: int, hi: int) -> str:
        r = self.r
        out = ["".join(r.choices(self.parts, k=r.randint(1, 3))) for _ in range(r.randint(lo, hi))]
        out = [w + r.choice("..,,!?") if r.random() < 0.1 else w + self.noise for w in out]
        text = " ".join(out)
        return (text.upper() if self.upper else text[:1].upper() + text[1:]) + r.choice([".", ".", "", "!"])


def _named(r: random.Random, tag: str, names: list[str], chance: float = 0.75) -> str:
    if r.random() > chance:
        return f"<{tag}>"
    name = r.choice(names).replace(" ", r.choice("-_ "))
    if r.random() < 0.3:
        name += r.choice([" ", "-", "_"]) + r.choice(["block", "box", "inner", "wrap", "container", "section", "area", "list", "x1", "row", "col", "clearfix"])
    return f'<{tag} {r.choice(["class", "class", "id"])}="{name}">'


class Writer:
    """One page: its html, and the text of each block with its label."""

    def __init__(self, r: random.Random):
        self.r, self.voice = r, Voice(r)
        self.parts: list[str] = []
        self.truth: list[tuple[str, int]] = []
        #: Pages without names, whose menus and notices show by place, words and links alone.
        self.plain = r.random() < 0.25

    def put(self, tag: str, text: str, label: int, end: bool = True, link: bool = False) -> None:
        r, inside = self.r, text
        if link:
            inside = f'<a href="/x">{text}</a>'
        elif r.random() < 0.25:
            inside = f"<{r.choice(['b', 'i', 'em', 'span', 'strong'])}>" + text + ("" if r.random() < 0.4 else "<br>")
        elif label and r.random() < 0.2:
            inside = f'<a href="/y">{text[: len(text) // 3]}</a>{text[len(text) // 3 :]}'
        self.parts.append(f"<{tag}>{inside}" + (f"</{tag}>" if end else ""))
        self.truth.append((text, label))

    def words(self, kind: str, lo: int, hi: int) -> str:
        r = self.r
        said = r.choice(SAID[kind]) if r.random() < 0.45 else ""
        return (said + " " + self.voice.say(lo, hi)).strip() if r.random() < 0.5 or not said else said

    def chrome(self, kind: str) -> None:
        r = self.r
        tags = {"nav": ["nav", "div", "ul"], "header": ["header", "div"], "footer": ["footer", "div"], "aside": ["aside", "div", "section"], "form": ["form", "div"], "comments": ["section", "div", "ol"]}.get(kind, ["div", "section", "aside"])
        tag = r.choice(tags)
        known = kind in ("nav", "footer", "header") or (kind == "aside" and tag == "aside")
        # Unnamed where the tag or the words and links tell it.
        self.parts.append(f"<{tag}>" if self.plain and known and kind != "header" else _named(r, tag, CHROME[kind], 0.5 if tag == kind else 1))
        if kind in ("nav", "aside") and (r.random() < 0.75 or self.plain):
            self.parts.append("<ul>")
            for _ in range(r.randint(2, 8)):
                self.put("li", self.words(kind, 1, 4 if kind == "nav" else 12), 0, r.random() < 0.8, link=True)
            self.parts.append("</ul>")
        elif kind == "form":
            for _ in range(r.randint(1, 3)):
                self.put(r.choice(["p", "div", "button"]), self.words(kind, 1, 6), 0)
        elif kind == "comments":
            for _ in range(r.randint(1, 6)):
                self.put(r.choice(["p", "div", "li"]), self.words(kind, 3, 60), 0)
        elif r.random() < 0.5 or kind == "ad":
            text = self.words(kind, 2, 40)
            self.parts.append(text)
            self.truth.append((text, 0))
        else:
            for _ in range(r.randint(1, 3)):
                self.put(r.choice(["p", "div", "span"]) if kind != "footer" else "p", self.words(kind, 1, 25), 0)
        self.parts.append(f"</{tag}>")

    def body(self, title: str) -> None:
        r, say = self.r, self.voice.say
        if r.random() < 0.85:
            self.put("h1", title if r.random() < 0.7 else say(3, 12), 1)
        soup = self.plain and r.random() < 0.5
        for _ in range(r.choice([1, 2, 3, 4, 6, 9, 14])):
            u = r.random()
            if u < 0.72:
                tag = "div" if soup or r.random() < 0.15 else "p"
                self.put(tag, say(2 if r.random() < 0.3 else 12, r.choice([12, 40, 150])), 1, tag == "div" or r.random() < 0.85)
            elif u < 0.8:
                self.put(r.choice(["h2", "h3", "h4"]), say(1, 8), 1)
            elif u < 0.86:
                self.parts.append("<ul>")
                for _ in range(r.randint(1, 5)):
                    self.put("li", say(2, 20), 1)
                self.parts.append("</ul>")
            elif u < 0.9:
                self.put(r.choice(["blockquote", "pre", "figcaption"]), say(3, 30), 1)
            elif u < 0.92:
                self.parts.append("<table><tr>")
                for _ in range(r.randint(1, 4)):
                    self.put("td", say(1, 5), 1)
                self.parts.append("</tr></table>")
            else:
                self.chrome(r.choice(["ad", "ad", "aside", "notice"]))

    def page(self) -> None:
        r = self.r
        title = self.voice.say(3, 12)
        if r.random() < 0.9:
            self.parts.append(f"<!DOCTYPE html><html><head><title>{title}</title><style>p{{}}</style></head><body>")
            self.truth.append((title, 0))
        wraps = r.choice([0, 0, 1, 2, 4])
        self.parts += [_named(r, "div", WRAPS, 0.6) for _ in range(wraps)]
        for kind in ("notice", "header", "nav", "ad"):
            if r.random() < 0.55:
                self.chrome(kind)
        main = r.choice(["div", "div", "section", ""]) if self.plain else r.choice(["article", "article", "main", "div", "div", "section", ""])
        if main:
            self.parts.append(f"<{main}>" if self.plain else _named(r, main, MAIN, 0.4 if main in ("article", "main") else 0.8))
        self.body(title)
        if r.random() < 0.25:
            self.chrome(r.choice(["comments", "comments", "aside", "form"]))
        if main:
            self.parts.append(f"</{main}>")
        for kind in ("aside", "comments", "form", "ad", "nav", "footer"):
            if r.random() < (0.8 if kind == "footer" else 0.3):
                self.chrome(kind)
        self.parts += ["</div>"] * wraps
        if r.random() < 0.6:
            self.parts.append("</body></html>")


def example(r: random.Random) -> tuple[str, list[tuple[str, int]]]:
    """A page, and the text of each of its blocks with its label."""
    w = Writer(r)
    w.page()
    return "".join(w.parts), w.truth


def training_set(n: int, seed: int) -> tuple[list[list[Block]], list[np.ndarray]]:
    r = random.Random(seed)
    pages, labels = [], []
    while len(pages) < n:
        page, truth = example(r)
        got = blocks(page)
        want = [(" ".join(t.split()), y) for t, y in truth]
        if [b.text for b in got] == [t for t, _ in want]:
            pages.append(got)
            labels.append(np.array([y for _, y in want], np.float32))
    return pages, labels


@cache
def trained(n: int = EXAMPLES, epochs: int = EPOCHS) -> Labeller:
    pages, labels = training_set(n, SEED)
    return Labeller().fit([features(p) for p in pages], labels, epochs)


def extract(pages: list[str | None], model: Labeller) -> list[str]:
    found = [blocks(p or "") for p in pages]
    return ["\n".join(b.text for b, x in zip(p, c) if x >= 0.5) for p, c in zip(found, model.chances(found))]


def main_text(pages: DataFrame, keep: list[str], html_col: str = "html", model: Labeller | None = None) -> DataFrame:
    """``keep`` columns, text and n_chars of each page. ``keep`` must have no column text or n_chars."""
    model = model or trained()
    rows = pages.select(*[field(pages, c) for c in keep], field(pages, html_col).cast("string").alias("__html"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema[:-1]) + ", text string, n_chars bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column("__html")), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
            lo = 0
            while lo < batch.num_rows:
                # Pages of some megabytes at a time, one at least.
                hi = max(lo + 1, int(np.searchsorted(sizes, (sizes[lo - 1] if lo else 0) + CHARS_AT_ONCE, "right")))
                part = batch.slice(lo, hi - lo)
                text = extract(part.column("__html").to_pylist(), model)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], [*keep, "text", "n_chars"])
                lo = hi

    return rows.mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages"), ["page_id", "url"])
