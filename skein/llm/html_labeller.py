"""Main-text extraction by a recurrent block labeller.

A page is cut into leaf blocks: runs of text between block-level tags. Each
block is a vector of its hashed tag path (names, class and id words of its
ancestors), its hashed words and some figures. A bidirectional LSTM in numpy
reads the page's blocks in order and labels each one main text or not, so that
a block is judged by the whole page around it, however long: long pages go
through the network in chunks that hand their state on, which gives what one run
would. Cutting takes time in proportion to the page, whatever its tags.

The network is trained here, on pages from the generator `made_page`, which
knows the label of every block; training is deterministic and needs no input.
"""

from __future__ import annotations

import functools
import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHasher, bound_batches, pick, pieces

#: Element names of the HTML standard.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption "
    "figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html iframe legend li main menu nav ol optgroup "
    "option p pre search section select summary table tbody td tfoot th thead tr ul".split()
)
RAW_TAGS = frozenset("script style noscript template textarea title svg math iframe object xmp noembed noframes".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: An opening tag of the second kind ends an open element of the first.
IMPLIED = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}

PATH_BUCKETS, WORD_BUCKETS, FIGURES = 192, 64, 6  # the word bucket is the top 6 bits of a hash
INPUT = PATH_BUCKETS + WORD_BUCKETS + FIGURES
HIDDEN = 20
#: Blocks of a page that the network reads at once.
CHUNK = 400
#: An element that these do not end: LIMITS stand between an element and what it would end.
LIMITS = ("ul", "ol", "dl", "table", "select")

_QUOTED = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>")
_PLAIN = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>")
_ATTRS = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_NAME = re.compile(r"[a-z]+|[A-Z][a-z]*")
_SPACE = re.compile(r"\s+")
_HASH = WordHasher()


class Element:
    """An open element; elements share their ancestors. mask: path buckets of itself and all of them."""

    __slots__ = ("tag", "parent", "depth", "mask")

    def __init__(self, tag: str, parent: Element | None, mask: int):
        self.tag, self.parent, self.mask = tag, parent, mask | (parent.mask if parent else 0)
        self.depth = parent.depth + 1 if parent else 1


@dataclass
class Block:
    text: str
    element: Element | None
    linked: int = 0


@functools.lru_cache(100_000)
def _bucket(kind: str, name: str) -> int:
    return xxhash.xxh64_intdigest(f"{kind}:{name}".encode("utf-8", "surrogatepass"), 3) % PATH_BUCKETS


@functools.lru_cache(20_000)
def _names(tag: str, attrs: str) -> tuple[str, ...]:
    """Tokens of an element: its name, and words of class, id and role."""
    words = [x.lower() for m in _ATTRS.finditer(attrs) for x in _NAME.findall(m[2] or m[3] or m[4] or "")]
    return (tag, *(f".{w}" for w in dict.fromkeys(words)))


@functools.cache
def _closing(tag: str) -> re.Pattern:
    return re.compile(rf"</{re.escape(tag)}\s*>", re.I)


@functools.lru_cache(20_000)
def _mask(tag: str, attrs: str) -> int:
    """Path buckets of an element: of its names if it is of block level, else of its tag."""
    names = _names(tag, attrs) if tag in BLOCK_TAGS else (tag,)
    return functools.reduce(lambda m, n: m | 1 << _bucket("t", n), names, 0)


def tokens_of(page: str) -> Iterator[tuple[str, str, str]]:
    """(kind, value, attributes) of a page in one pass: `text` and `raw` (text without references),
    `open` and `close` with lower-case tags; comments, declarations and the content of raw
    elements are left out. A sign that begins no tag is text. Once a quotation mark is open
    up to the end of the page, quotation marks count no more."""
    at, end, last = 0, len(page), page.rfind(">")
    pattern = _QUOTED
    while at < end:
        start = page.find("<", at)
        m = stop = kind = None
        while start >= 0:
            if page.startswith("<!--", start):
                stop = page.find("-->", start + 4)
                stop = end if stop < 0 else stop + 3
            elif page.startswith("<![CDATA[", start):
                kind, close = "raw", page.find("]]>", start)
                stop = end if close < 0 else close + 3
            elif start > last:  # no tag ends any more
                start = min((k for k in (page.find("<!--", start), page.find("<![CDATA[", start)) if k >= 0), default=-1)
                continue
            elif page[start + 1] in "!?":
                stop = page.find(">", start) + 1
            elif (m := pattern.match(page, start)) is not None:
                stop = m.end()
            elif pattern is _QUOTED and _PLAIN.match(page, start):
                pattern = _PLAIN
                continue
            else:
                start = page.find("<", start + 1)
                continue
            break
        if text := page[at : start if stop else end]:
            yield "text", text, ""
        if not stop:
            return
        at = stop
        if kind == "raw":
            yield "raw", page[start + 9 : stop].removesuffix("]]>"), ""
        if m is None:
            continue
        tag, attrs = m[2].lower(), m[3]
        if m[1]:
            yield "close", tag, ""
        elif tag in RAW_TAGS and not attrs.endswith("/"):
            shut = _closing(tag).search(page, at)
            at = shut.end() if shut else end
            if tag in BLOCK_TAGS:
                yield "flush", tag, ""
        else:
            yield "open", tag, attrs


def blocks_of(page: str | None) -> list[Block]:
    """Leaf blocks in page order, white space and the character references of each run of
    text resolved; none for null."""
    stack: list[Element] = []
    where: dict[str, list[int]] = {}  # places of each tag's open elements
    block_at: list[int] = []  # places of block-level ones
    out: list[Block] = []
    parts: list[str] = []
    linked = 0

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                out.append(Block(text, stack[-1] if stack else None, min(linked, len(text))))
            parts.clear()
        linked = 0

    def last(tag: str) -> int:
        own = where.get(tag)
        return own[-1] if own else -1

    def close(k: int) -> None:
        while len(stack) > k:
            tag = stack.pop().tag
            where[tag].pop()
            if tag in BLOCK_TAGS:
                block_at.pop()

    for kind, value, attrs in tokens_of(page or ""):
        if kind in ("text", "raw"):
            if last("head") < 0:
                text = html.unescape(value) if kind == "text" else value
                parts.append(text)
                if last("a") >= 0:
                    linked += len(text)
        elif kind == "flush":
            flush()
        elif kind == "close":
            if value in BLOCK_TAGS:
                flush()
            elif value == "br":
                parts.append(" ")
            if last(value) >= 0:
                close(last(value))
        else:
            if value in BLOCK_TAGS:
                flush()
                if value in IMPLIED:
                    k = max(map(last, [*IMPLIED[value], "p"]))
                    if k > max(map(last, LIMITS)):
                        close(k)
                elif block_at and stack[block_at[-1]].tag == "p":
                    close(block_at[-1])
                if last("head") >= 0 and value != "head":
                    close(last("head"))
            elif value == "br":
                parts.append(" ")
            if value not in VOID_TAGS and not attrs.endswith("/"):
                where.setdefault(value, []).append(len(stack))
                if value in BLOCK_TAGS:
                    block_at.append(len(stack))
                stack.append(Element(value, stack[-1] if stack else None, _mask(value, attrs)))
    flush()
    return out


@functools.lru_cache(50_000)
def _path_buckets(mask: int, leaf: str) -> np.ndarray:
    own = {k for k in range(PATH_BUCKETS) if mask >> k & 1}
    if leaf:
        own.add(_bucket("leaf", leaf))
    return np.array(sorted(own), np.intp)


def vectors_of(pages: list[list[Block]], at: int = 0, total: int | None = None) -> list[np.ndarray]:
    """For each page the matrix of its blocks, one row each. With `total` the blocks are those
    from `at` on of a page of so many."""
    blocks = [b for page in pages for b in page]
    x = np.zeros((len(blocks), INPUT), np.float32)
    if not blocks:
        return [x for _ in pages]
    paths = [_path_buckets(b.element.mask, b.element.tag) if b.element else _path_buckets(0, "") for b in blocks]
    x[np.repeat(np.arange(len(blocks)), list(map(len, paths))), np.concatenate(paths)] = 1
    words = [b.text.lower().split() for b in blocks]
    n = np.array(list(map(len, words)))
    bucket = (_HASH([w for own in words for w in own]) >> np.uint64(58)).astype(np.intp)
    counts = np.bincount(np.repeat(np.arange(len(blocks)), n) * WORD_BUCKETS + bucket, minlength=len(blocks) * WORD_BUCKETS)
    share = 1 / np.maximum(n, 1) ** 0.5 / np.maximum(1.0, n / 64) ** 0.5
    x[:, PATH_BUCKETS : PATH_BUCKETS + WORD_BUCKETS] = counts.reshape(-1, WORD_BUCKETS) * share[:, None]
    size = np.array([len(b.text) for b in blocks])
    ends = np.array([sum(map(b.text.count, ".!?:;,")) for b in blocks])
    place = np.concatenate([(at + np.arange(len(p))) / max(1, total or len(p)) for p in pages])
    depth = np.array([b.element.depth if b.element else 0 for b in blocks])
    x[:, -FIGURES:] = np.stack([np.log1p(n) / 5, np.array([b.linked for b in blocks]) / size, np.minimum(1, ends / np.maximum(1, n) * 4), place, np.minimum(depth, 50) / 10, size < 60], axis=1)
    return np.split(x, np.cumsum([len(p) for p in pages])[:-1])


@dataclass
class Lstm:
    """One direction: gates in the order input, forget, output, candidate."""

    wx: np.ndarray
    wh: np.ndarray
    b: np.ndarray

    @classmethod
    def new(cls, rng: np.random.Generator) -> Lstm:
        b = np.zeros(4 * HIDDEN, np.float32)
        b[HIDDEN : 2 * HIDDEN] = 1
        return cls(*(rng.normal(0, s, shape).astype(np.float32) for s, shape in ((0.08, (INPUT, 4 * HIDDEN)), (0.15, (HIDDEN, 4 * HIDDEN)))), b)

    def run(self, x: np.ndarray, mask: np.ndarray, keep: list | None = None, state: list | None = None) -> np.ndarray:
        """x: time x batch x input. Padded steps (mask 0) leave the state as it was. state holds
        what a run before this one left, and then what this one leaves."""
        h, c = state if state else (np.zeros((x.shape[1], HIDDEN), np.float32) for _ in range(2))
        z0 = x.reshape(-1, INPUT) @ self.wx
        z0 = z0.reshape(len(x), -1, 4 * HIDDEN) + self.b
        out = np.empty((len(x), x.shape[1], HIDDEN), np.float32)
        for t in range(len(x)):
            z = z0[t] + h @ self.wh
            gates = 1 / (1 + np.exp(-z[:, : 3 * HIDDEN]))
            cand = np.tanh(z[:, 3 * HIDDEN :])
            i, f, o = gates[:, :HIDDEN], gates[:, HIDDEN : 2 * HIDDEN], gates[:, 2 * HIDDEN :]
            m = mask[t][:, None]
            c_new = f * c + i * cand
            tanh_c = np.tanh(c_new)
            if keep is not None:
                keep.append((h, c, i, f, o, cand, tanh_c, m))
            c = np.where(m, c_new, c)
            h = np.where(m, o * tanh_c, h)
            out[t] = h
        if state is not None:
            state[:] = [h, c]
        return out

    def back(self, x: np.ndarray, kept: list, dout: np.ndarray) -> list[np.ndarray]:
        dwh, dz_all = np.zeros_like(self.wh), np.zeros((len(x), x.shape[1], 4 * HIDDEN), np.float32)
        dh = np.zeros((x.shape[1], HIDDEN), np.float32)
        dc = dh.copy()
        for t in range(len(x) - 1, -1, -1):
            h, c, i, f, o, cand, tanh_c, m = kept[t]
            g = dh + dout[t]
            gm = g * m
            dct = dc * m + gm * o * (1 - tanh_c**2)
            dz = np.concatenate([dct * cand * i * (1 - i), dct * c * f * (1 - f), gm * tanh_c * o * (1 - o), dct * i * (1 - cand**2)], axis=1)
            dz_all[t] = dz
            dwh += h.T @ dz
            dh = dz @ self.wh.T + g * (1 - m)
            dc = dct * f + dc * (1 - m)
        flat = dz_all.reshape(-1, 4 * HIDDEN)
        return [x.reshape(-1, INPUT).T @ flat, dwh, flat.sum(axis=0)]


@dataclass
class Labeller:
    ahead: Lstm
    behind: Lstm
    w: np.ndarray
    b: np.ndarray = field(default_factory=lambda: np.zeros(1, np.float32))

    def logits(self, x: np.ndarray, mask: np.ndarray, keep: tuple[list, list] | None = None) -> tuple[np.ndarray, np.ndarray]:
        a = self.ahead.run(x, mask, keep and keep[0])
        z = self.behind.run(x[::-1], mask[::-1], keep and keep[1])[::-1]
        h = np.concatenate([a, z], axis=2)
        return h @ self.w + self.b, h

    def label(self, pages: list[list[Block]]) -> list[np.ndarray]:
        """Whether each block is main text, for pages of blocks. Pages of like length share a
        batch; of a long page only a chunk's vectors and all blocks' states are held."""
        out = [np.zeros(0, bool) for _ in pages]
        short = sorted((len(own), p) for p, own in enumerate(pages) if 0 < len(own) <= CHUNK)
        for k in range(0, len(short), 32):
            group = [p for _, p in short[k : k + 32]]
            x, mask = _padded(vectors_of([pages[p] for p in group]))
            z, _ = self.logits(x, mask)
            for col, p in enumerate(group):
                out[p] = z[: len(pages[p]), col] > 0
        for p, own in enumerate(pages):
            if len(own) > CHUNK:
                out[p] = self._long(own) > 0
        return out

    def _long(self, blocks: list[Block]) -> np.ndarray:
        """Logits of one page's blocks, read in chunks that hand their state on."""
        n = len(blocks)
        z = np.full(n, self.b[0], np.float32)
        starts = list(range(0, n, CHUNK))
        for lstm, order, flip, w in ((self.ahead, starts, 1, self.w[:HIDDEN]), (self.behind, starts[::-1], -1, self.w[HIDDEN:])):
            state: list = []
            for at in order:
                x = vectors_of([blocks[at : at + CHUNK]], at, n)[0][::flip, None]
                z[at : at + CHUNK] += (lstm.run(x, np.ones(x.shape[:2], bool), state=state)[:, 0] @ w)[::flip]
        return z


def _padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    x = np.zeros((max(map(len, pages)), len(pages), INPUT), np.float32)
    mask = np.zeros(x.shape[:2], bool)
    for k, p in enumerate(pages):
        x[: len(p), k], mask[: len(p), k] = p, True
    return x, mask


def train(pages: int = 1600, epochs: int = 4, seed: int = 11, rate: float = 0.006) -> Labeller:
    rng = np.random.default_rng(seed)
    made = [made_page(rng) for _ in range(pages)]
    cut = [blocks_of(page) for page, _ in made]
    labels = [np.array([b.text in wanted for b in blocks], np.float32) for blocks, (_, wanted) in zip(cut, made)]
    data = [(x, y) for x, y in zip(vectors_of(cut), labels) if len(x)]
    net = Labeller(Lstm.new(rng), Lstm.new(rng), rng.normal(0, 0.2, 2 * HIDDEN).astype(np.float32))
    params = [net.ahead.wx, net.ahead.wh, net.ahead.b, net.behind.wx, net.behind.wh, net.behind.b, net.w, net.b]
    first, second, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    data.sort(key=lambda d: len(d[0]))
    groups = [data[k : k + 24] for k in range(0, len(data), 24)]
    for _ in range(epochs):
        for g in rng.permutation(len(groups)):
            x, mask = _padded([v for v, _ in groups[g]])
            y = np.zeros(mask.shape, np.float32)
            for k, (_, labels) in enumerate(groups[g]):
                y[: len(labels), k] = labels
            keep: tuple[list, list] = ([], [])
            z, h = net.logits(x, mask, keep)
            dz = (1 / (1 + np.exp(-z)) - y) * mask / mask.sum()
            dh = dz[:, :, None] * net.w
            back = net.ahead.back(x, keep[0], dh[:, :, :HIDDEN]) + net.behind.back(x[::-1], keep[1], dh[::-1, :, HIDDEN:])
            step += 1
            for k, grad in enumerate([*back, np.einsum("tb,tbh->h", dz, h), dz.sum(keepdims=True)[0]]):
                first[k] = 0.9 * first[k] + 0.1 * grad
                second[k] = 0.999 * second[k] + 0.001 * grad * grad
                params[k] -= (rate * (1 - step / (1 + epochs * len(groups))) * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return net


@functools.cache
def trained() -> Labeller:
    return train()


#: Words that sites commonly put in class and id names of page furniture and of articles.
FURNITURE = {
    "nav": "nav menu navbar navigation breadcrumb breadcrumbs topnav submenu pagination tabs toc",
    "header": "header masthead site-header banner top-bar logo branding",
    "footer": "footer site-footer copyright colophon bottom legal",
    "aside": "sidebar side widget related recommended popular trending more-links rail",
    "ad": "ad ads advert advertisement sponsor sponsored promo promotion banner-ad adsense",
    "notice": "cookie cookies consent notice gdpr alert popup modal newsletter subscribe paywall",
    "form": "form search search-form login signup contact",
    "comments": "comments comment comment-list disqus replies respond reader-comments discussion",
    "social": "share social sharing follow-us tags byline-links",
}
ARTICLE = "article content post entry main story body text entry-content post-body article-body main-content page-content"
WORDS = {
    "nav": "home about contact products news blog help login archive categories next previous menu",
    "header": "welcome home search sign in menu your site daily",
    "footer": "copyright all rights reserved privacy policy terms of use contact imprint sitemap",
    "aside": "related read more popular posts latest see also recent tags you may like",
    "ad": "buy now sale offer sponsored free shipping click here advertisement deal discount save",
    "notice": "we use cookies accept decline this site consent newsletter subscribe agree settings",
    "form": "name email search submit send password message your",
    "comments": "reply says posted comment ago like report great thanks agree user",
    "social": "share tweet facebook follow us print email pin",
}


def made_page(rng: np.random.Generator) -> tuple[str, set[str]]:
    """A page in one of many layouts and the texts of its main blocks. Its words are random
    syllables; page furniture holds some of its usual words, often none."""
    syllables = ["".join(rng.choice(list("abcdefghilmnoprstuv"), rng.integers(1, 4))) for _ in range(40)]
    made = lambda: "".join(rng.choice(syllables, rng.integers(1, 4)))
    wanted: set[str] = set()

    def prose(low: int, high: int, mark: bool) -> str:
        words = [made() for _ in range(rng.integers(low, high))]
        style = rng.random()
        text = " ".join(words)
        if rng.random() < 0.05:
            text = " ".join(w for w in words[:6] for _ in range(rng.integers(2, 15)))
        elif rng.random() < 0.05:
            text = " | ".join(words)
        elif style < 0.15:
            text = text.upper()
        elif style < 0.8 and low > 3:
            text = re.sub(r" (\w+) (\w)", lambda m: f" {m[1]}{'.' if rng.random() < 0.2 else ''} {m[2]}", text).capitalize() + "."
        text = text.replace(" ", "  ", 1) if rng.random() < 0.1 else text
        if mark:
            wanted.add(_SPACE.sub(" ", text).strip())
        return text

    def furniture(kind: str) -> str:
        usual = WORDS[kind].split()
        plain = rng.random() < 0.5

        def bit(low: int = 1, high: int = 8) -> str:
            own = [str(rng.choice(usual)) if not plain and rng.random() < 0.6 else made() for _ in range(rng.integers(low, high))]
            return " ".join(own).capitalize() + rng.choice(["", ".", ""])

        tag = {"nav": "nav", "header": "header", "footer": "footer", "aside": "aside", "form": "form"}.get(kind, "div")
        bare = rng.random() < 0.45 and tag != "div"
        tag = tag if bare or rng.random() < 0.4 else str(rng.choice(["div", "section", "ul" if kind == "nav" else "div"]))
        name = str(rng.choice(FURNITURE[kind].split()))
        attrs = "" if bare else f' {rng.choice(["class", "id"])}="{name}{rng.choice(["", "", " box", "-1"])}"'
        n = int(rng.integers(1, 9))
        if kind == "nav" or (kind in ("aside", "header", "footer", "social") and rng.random() < 0.5):
            body = "<ul>" + "".join(f'<li><a href="/{k}">{bit(1, 4)}</a></li>' for k in range(n)) + "</ul>" if rng.random() < 0.7 else " | ".join(f'<a href="/{k}">{bit(1, 4)}</a>' for k in range(n))
            if kind == "aside":
                body = f"<h3>{bit(1, 4)}</h3>" + body
        elif kind == "form":
            body = f"<label>{bit(1, 3)}</label><input name=q><button>{bit(1, 3)}</button>"
            tag = "form"
        elif kind == "comments":
            body = f"<h3>{bit(1, 3)}</h3>" + "".join(f'<div class="{rng.choice(["comment", "reply", "c"])}"><p>{prose(4, 60, False)}</p></div>' for _ in range(n))
        elif kind == "footer":
            body = rng.choice(["&copy; ", ""]) + bit(2, 12) + rng.choice([" &middot; ", "<br>", "\n"]) + bit(1, 30)
        else:
            body = "".join(rng.choice(["<p>{}</p>", "{}"]).format(bit(1, 30)) for _ in range(rng.integers(1, 3)))
        return f"<{tag}{attrs}>{body}</{tag}>"

    def article() -> str:
        out = [f"<h1>{prose(2, 12, True)}</h1>"] if rng.random() < 0.85 else []
        for _ in range(int(rng.integers(1, 4 if rng.random() < 0.4 else 25))):
            r = rng.random()
            long = 140 if rng.random() < 0.3 else 40
            if r < 0.62:
                text = prose(2 if rng.random() < 0.2 else 6, long, True)
                first, _, rest = text.partition(" ")
                out.append(rng.choice(["<p>{0} {1}</p>", "<p>{0} {1}", "<p><b>{0} {1}</b></p>", '<p><a href="x">{0}</a> {1}</p>', "<p><b>{0} {1}<br></p>", "<div>{0} {1}</div>"], p=[0.5, 0.1, 0.1, 0.1, 0.1, 0.1]).format(first, rest))
            elif r < 0.74:
                out.append(f"<h{rng.integers(2, 5)}>{prose(1, 8, True)}</h2>")
            elif r < 0.84:
                out.append("<ul>" + "".join(f"<li>{prose(1, 20, True)}</li>" for _ in range(rng.integers(1, 6))) + "</ul>")
            elif r < 0.89:
                out.append("<table>" + "".join(f"<tr><td>{prose(1, 5, True)}</td><td>{prose(1, 5, True)}</td></tr>" for _ in range(rng.integers(1, 4))) + "</table>")
            elif r < 0.95:
                out.append(f"<blockquote>{prose(5, 40, True)}</blockquote>")
            else:
                out.append(f"<pre>{prose(3, 30, True)}</pre>")
            if rng.random() < 0.04:
                out.append(furniture(str(rng.choice(["ad", "aside", "social", "notice", "form"]))))
        body = "".join(out)
        style = rng.random()
        if style < 0.5:
            return f"<article>{body}</article>"
        name = rng.choice(ARTICLE.split())
        tag = rng.choice(["div", "section", "main", "article"])
        return f'<{tag} {rng.choice(["class", "id"])}="{name}">{body}</{tag}>' if style < 0.9 else f"<main>{body}</main>"

    before = [furniture(str(rng.choice(["nav", "header", "ad", "notice", "form", "social", "aside"], p=[0.3, 0.2, 0.2, 0.1, 0.05, 0.05, 0.1]))) for _ in range(rng.integers(0, 5))]
    after = [furniture(str(rng.choice(["footer", "aside", "comments", "ad", "notice", "social", "form", "nav"], p=[0.3, 0.15, 0.2, 0.1, 0.05, 0.1, 0.05, 0.05]))) for _ in range(rng.integers(0, 5))]
    page = "".join(before) + article() + "".join(after)
    if rng.random() < 0.3:
        page = f'<div {rng.choice(["id", "class"])}="{rng.choice(["page", "wrapper", "container", "root", "site"])}">{page}</div>'
    return f"<html><head><title>{prose(1, 6, False)}</title></head><body>{page}</body></html>", wanted


def extract(net: Labeller, pages: list[str | None]) -> list[str]:
    cut = [blocks_of(p) for p in pages]
    kept = net.label(cut)
    return ["\n".join(b.text for b, k in zip(own, keep) if k) for own, keep in zip(cut, kept)]


def extract_pages(pages: DataFrame) -> DataFrame:
    """Every row of pages (page_id, url, html) -> page_id, url, text, n_chars.

    text joins the blocks labelled main text, in page order, by line ends; it is
    empty for null and empty html and for pages without such a block. The whole
    html is read, whatever its length; a block with even odds is no main text;
    repeated rows and null ids stay as they are; the network is trained on the
    driver at the first use in a process, which takes about a minute; an empty table gives an empty result; other columns are ignored.
    """
    bound_batches(pages.sparkSession)
    sent = pages.sparkSession.sparkContext.broadcast(trained())

    @F.arrow_udf("string")
    def main_text(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for own in pieces(batches):
            yield pa.array(extract(sent.value, own), pa.string())

    out = pick(pages, "page_id", "url", "html").select("page_id", "url", main_text("html").alias("text"))
    return out.withColumn("n_chars", F.char_length("text").cast("long"))
