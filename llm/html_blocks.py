"""HTML extraction: a recurrent labeller over a page's blocks.

Blocks. A page is cut at block-level tags into leaves, each with its tag path (tags, class and id words, role) and its text,
in which inline tags make no border and character references are decoded. Comments, scripts and styles are no text.

Labeller. A bidirectional LSTM (numpy) reads for each leaf the hashed path, hashed words and a few densities, so each
label rests on the whole page. It is trained here on ``MAX_PAGES`` sampled pages: those with an article or main element, labelled by
it, and layouts composed of their blocks: the article and menus, notices, adverts, forms, comments and so on under varied
markup, with labels known by construction. Blocks with a probability of ``THRESHOLD`` or more are the main text.

Scale. One map over pages. The keys of the sampled pages come to the driver; the pages themselves, whole, to the one task that fits
the model. Pages are labelled in batches of bounded total length, and a page is read in one pass.

Rows. Null and empty html give an empty text. Broken markup is read as far as it goes; an unclosed comment or script lasts to the
end. Repeated rows are labelled alike. Pages without words are trained on with stand-in words; an empty table gives an empty
result. Other columns are not read.
"""

from __future__ import annotations

import html as entities
import pickle
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_PAGES = 150
THRESHOLD = 0.5
PATH, TEXT, DENSE, HIDDEN = 96, 48, 6, 20
SIZE = PATH + TEXT + DENSE

_RAW = re.compile(r"<(script|style|noscript|template|svg|iframe|textarea|select)\b", re.I)
_TAG = re.compile(r"<(/?)([a-z][a-z0-9:-]*)", re.I)
_ATTRS = re.compile(r"""((?:"[^"]*+"|'[^']*+'|[^'">]++)*+)>""")
_ATTR = re.compile(r"""\b(?:class|id|role|aria-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_PART = re.compile(r"[a-z]+")
_INLINE = frozenset("a abbr b bdi bdo big cite code data dfn em font i ins kbd mark q s samp small span strong sub sup time tt u var wbr del label".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_OPEN_ENDED = frozenset("p li dt dd tr td th option".split())


_MAIN = {"article", "main"}
_NOT_MAIN = {
    *("nav", "header", "footer", "aside", "form", "button", "dialog", "title", "head", "menu"),
    *("." + w for w in "nav menu sidebar footer ad ads advert advertisement banner cookie consent notice comment comments comm newsletter share social related promo breadcrumb breadcrumbs".split()),
}


@dataclass(frozen=True)
class Path:
    """What the open elements above a block say; blocks below one element share it."""

    places: frozenset[int] = frozenset()  # of the hashed tags and words, PATH at most
    main: bool = False
    apart: bool = False

    def below(self, words: list[str]) -> Path:
        places = self.places.union(_place(w, PATH) for w in words)
        return Path(places, self.main or not _MAIN.isdisjoint(words), self.apart or not _NOT_MAIN.isdisjoint(words))


@dataclass
class Block:
    text: str
    path: Path
    links: float  # share of the text in links


@dataclass
class Mark:
    start: int
    end: int
    tag: str = ""  # of a comment and the like none
    closes: bool = False
    attrs: str = ""
    raw: bool = False


def marks(page: str) -> Iterator[Mark]:
    """Tags, comments and elements without text, in one pass: each character is looked at a bounded number of times.

    Quotes in a tag may hold ``>``. After a tag whose quotes do not close, quotes are not minded any more.
    """
    at, gt, minded, size = 0, -1, True, len(page)
    while (at := page.find("<", at)) >= 0:
        if gt < at:
            gt = page.find(">", at)
            if gt < 0:  # nothing but a comment can begin here, which lasts to the end
                if (at := page.find("<!--", at)) >= 0:
                    yield Mark(at, size)
                return
        if page.startswith("<!--", at):
            close = page.find("-->", at + 4)
            mark = Mark(at, size if close < 0 else close + 3)
        elif found := _RAW.match(page, at):
            close = re.compile(rf"</{found[1]}\s*>", re.I).search(page, gt + 1)
            mark = Mark(at, close.end() if close else size, raw=True)
        elif found := _TAG.match(page, at):
            attrs = _ATTRS.match(page, found.end()) if minded else None
            minded = attrs is not None
            mark = Mark(at, attrs.end() if attrs else gt + 1, found[2].lower(), bool(found[1]), attrs[1] if attrs else page[found.end() : gt])
        elif page[at + 1] in "!?/":
            mark = Mark(at, gt + 1)
        else:
            at += 1
            continue
        yield mark
        at = mark.end


def blocks(page: str) -> list[Block]:
    out: list[Block] = []
    stack: list[tuple[str, Path]] = []
    opened: Counter[str] = Counter()
    parts: list[str] = []
    linked, total, in_link, at = 0, 0, 0, 0

    def flush() -> None:
        nonlocal linked, total
        text = " ".join(entities.unescape("".join(parts)).split())
        if text:
            out.append(Block(text, stack[-1][1] if stack else Path(), linked / max(total, 1)))
        parts.clear()
        linked = total = 0

    def add(piece: str) -> None:
        nonlocal linked, total
        if piece:
            parts.append(piece)
            total += len(piece)
            linked += len(piece) * (in_link > 0)

    def leave(tag: str) -> None:
        while opened[tag]:
            last, _ = stack.pop()
            opened[last] -= 1
            if last == tag:
                break

    for m in marks(page):
        add(page[at : m.start])
        at = m.end
        if m.raw:
            flush()
        if not m.tag:
            continue
        if m.tag == "a":
            in_link = 0 if m.closes else 1
        if m.tag in _INLINE:
            continue
        flush()
        in_link = 0
        if m.closes:
            leave(m.tag)
        elif m.tag not in _VOID:
            if m.tag in _OPEN_ENDED and stack and stack[-1][0] == m.tag:
                leave(m.tag)
            named = ["." + w for a in _ATTR.findall(m.attrs) for w in _PART.findall("".join(a).lower())]
            stack.append((m.tag, (stack[-1][1] if stack else Path()).below([m.tag, *named])))
            opened[m.tag] += 1
    add(page[at:])
    flush()
    return out


def _place(word: str, size: int) -> int:
    return zlib.crc32(word.encode()) % size


def vectors(leaves: list[Block]) -> np.ndarray:
    x = np.zeros((len(leaves), SIZE), np.float32)
    for i, b in enumerate(leaves):
        x[i, list(b.path.places)] = 1
        own = b.text.lower().split()
        places = [zlib.crc32(w.encode()) % TEXT for w in own]
        x[i, PATH : PATH + TEXT] = np.bincount(places, minlength=TEXT) / len(own)
        n = len(b.text)
        x[i, PATH + TEXT :] = (
            np.log1p(len(own)) / 5,
            b.links,
            (b.text.count(".") + b.text.count(",")) / n * 20,
            i / len(leaves),
            i < 3,
            i >= len(leaves) - 3,
        )
    return x


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Lstm:
    """One direction; arrays are (time, batch, ...)."""

    def __init__(self, rng: np.random.Generator):
        scale = 1 / np.sqrt(SIZE + HIDDEN)
        self.w = rng.normal(0, scale, (SIZE + HIDDEN, 4 * HIDDEN)).astype(np.float32)
        self.b = np.zeros(4 * HIDDEN, np.float32)
        self.b[HIDDEN : 2 * HIDDEN] = 1

    def forward(self, x: np.ndarray, mask: np.ndarray, keep: bool = False):
        t, n, _ = x.shape
        h, c = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32)
        out, saved = np.zeros((t, n, HIDDEN), np.float32), []
        fixed = (x.reshape(t * n, SIZE) @ self.w[:SIZE] + self.b).reshape(t, n, -1)
        for s in range(t):
            z = fixed[s] + h @ self.w[SIZE:]
            i, f, o = (_sigmoid(z[:, k * HIDDEN : (k + 1) * HIDDEN]) for k in range(3))
            g = np.tanh(z[:, 3 * HIDDEN :])
            m = mask[s][:, None]
            c_new = f * c + i * g
            th = np.tanh(c_new)
            if keep:
                saved.append((h, c, i, f, o, g, th, m))
            c, h = m * c_new + (1 - m) * c, m * (o * th) + (1 - m) * h
            out[s] = h
        return out, saved

    def backward(self, x: np.ndarray, saved: list, grad: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        t, n, _ = x.shape
        dz = np.zeros((t, n, 4 * HIDDEN), np.float32)
        dw_h = np.zeros((HIDDEN, 4 * HIDDEN), np.float32)
        dh, dc = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32)
        for s in range(t - 1, -1, -1):
            h, c, i, f, o, g, th, m = saved[s]
            dh = dh + grad[s]
            inner = m * dh
            dcn = m * dc + inner * o * (1 - th * th)
            dz[s] = np.concatenate([dcn * g * i * (1 - i), dcn * c * f * (1 - f), inner * th * o * (1 - o), dcn * i * (1 - g * g)], axis=1)
            dw_h += h.T @ dz[s]
            dh = (1 - m) * dh + dz[s] @ self.w[SIZE:].T
            dc = (1 - m) * dc + dcn * f
        flat = dz.reshape(t * n, -1)
        return np.concatenate([x.reshape(t * n, SIZE).T @ flat, dw_h]), flat.sum(axis=0)


class Labeller:
    def __init__(self, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.ahead, self.back = Lstm(rng), Lstm(rng)
        self.v = rng.normal(0, 0.2, 2 * HIDDEN).astype(np.float32)
        self.c = np.zeros(1, np.float32)

    def weights(self) -> list[np.ndarray]:
        return [self.ahead.w, self.ahead.b, self.back.w, self.back.b, self.v, self.c]

    def load(self, weights: list[np.ndarray]) -> Labeller:
        self.ahead.w, self.ahead.b, self.back.w, self.back.b, self.v, self.c = weights
        return self

    @staticmethod
    def pad(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        t = max(len(p) for p in pages)
        x, mask = np.zeros((t, len(pages), SIZE), np.float32), np.zeros((t, len(pages)), np.float32)
        for k, p in enumerate(pages):
            x[: len(p), k], mask[: len(p), k] = p, 1
        return x, mask

    def _run(self, x: np.ndarray, mask: np.ndarray, keep: bool):
        a, sa = self.ahead.forward(x, mask, keep)
        b, sb = self.back.forward(x[::-1], mask[::-1], keep)
        both = np.concatenate([a, b[::-1]], axis=2)
        return _sigmoid(both @ self.v + self.c), both, sa, sb

    def probabilities(self, pages: list[np.ndarray], most: int = 20_000) -> list[np.ndarray]:
        """Of each block of each page; pages of like length run together, ``most`` padded blocks at a time."""
        out: list[np.ndarray] = [np.empty(0)] * len(pages)
        order = sorted((k for k in range(len(pages)) if len(pages[k])), key=lambda k: len(pages[k]))
        while order:
            size = len(pages[order[-1]])
            group, order = order[-max(1, most // size) :], order[: -max(1, most // size)]
            p = self._run(*self.pad([pages[k] for k in group]), False)[0]
            for j, k in enumerate(group):
                out[k] = p[: len(pages[k]), j]
        return out

    def fit(self, pages: list[np.ndarray], labels: list[np.ndarray], epochs: int = 24, batch: int = 24, rate: float = 0.01, seed: int = 3) -> None:
        rng = np.random.default_rng(seed)
        params = self.weights()
        first, second, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
        for _ in range(epochs):
            by_length = sorted(rng.permutation(len(pages)), key=lambda k: len(pages[k]) // 8)
            groups = [by_length[k : k + batch] for k in range(0, len(pages), batch)]
            for k in rng.permutation(len(groups)):
                x, mask = self.pad([pages[j] for j in groups[k]])
                y = np.zeros(mask.shape, np.float32)
                for j, page in enumerate(groups[k]):
                    y[: len(labels[page]), j] = labels[page]
                p, both, sa, sb = self._run(x, mask, True)
                gap = (p - y) * mask / mask.sum()
                down = gap[:, :, None] * self.v
                ga = self.ahead.backward(x, sa, down[:, :, :HIDDEN])
                gb = self.back.backward(x[::-1], sb, down[::-1, :, HIDDEN:])
                grads = [*ga, *gb, (both * gap[:, :, None]).sum(axis=(0, 1)), gap.sum(keepdims=True).reshape(1)]
                norm = np.sqrt(sum(float((g * g).sum()) for g in grads))
                step += 1
                for w, g, m, v in zip(params, grads, first, second, strict=True):
                    g = g / max(1.0, norm)
                    m += 0.1 * (g - m)
                    v += 0.01 * (g * g - v)
                    w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-7)


# ---- training pages

def marked(leaves: list[Block]) -> np.ndarray | None:
    """Labels by an article or main element; None if the page has none."""
    if not any(b.path.main for b in leaves):
        return None
    return np.array([b.path.main and not b.path.apart for b in leaves], np.float32)


#: How composed layouts mark their parts.
_ARTICLES = (
    ("<article>", "</article>"), ("<main>", "</main>"), ("<main><article>", "</article></main>"), ('<div class="content">', "</div>"),
    ('<div id="main-content">', "</div>"), ('<div class="post-body">', "</div>"), ('<div class="entry-content">', "</div>"),
    ('<section class="article-text">', "</section>"), ('<div class="story">', "</div>"), ('<div role="main">', "</div>"),
    ('<div id="content"><div class="article">', "</div></div>"), ('<td class="text">', "</td>"),
)
_MENUS = ("<nav>{}</nav>", '<div class="nav">{}</div>', '<div id="menu">{}</div>', '<ul class="breadcrumbs">{}</ul>', '<header class="site-header">{}</header>', '<div class="navbar">{}</div>')
_ASIDES = (
    '<div class="ad">{}</div>', "<aside>{}</aside>", '<div class="sidebar">{}</div>', '<div class="cookie-notice">{}</div>', '<div class="advert">{}</div>',
    '<form action="/s">{}</form>', '<div class="banner promo">{}</div>', '<div class="related">{}</div>', '<div class="newsletter"><form>{}</form></div>',
    '<div class="share social">{}</div>', '<div id="consent" role="dialog">{}</div>', '<div class="notice">{}</div>', '<section class="ads">{}</section>',
)
_ENDS = (
    "<footer>{}</footer>", '<div class="footer">{}</div>', '<section class="comments">{}</section>', '<div id="comments">{}</div>', '<div id="footer">{}</div>',
    '<ol class="comment-list">{}</ol>', '<div class="comments"><div class="comment">{}</div></div>', '<aside class="related-posts">{}</aside>',
)


def compose(rng: np.random.Generator, prose: list[str]) -> tuple[list[Block], np.ndarray]:
    """The blocks of a page in a random layout of given texts, and their labels."""
    pick = lambda options: options[rng.integers(len(options))]

    def few(n: int) -> str:
        own = pick(prose).split()
        at = rng.integers(max(1, len(own) - n))
        return entities.escape(" ".join(own[at : at + n]))

    def menu() -> str:
        items = [f'<a href="/{k}">{few(int(rng.integers(1, 3)))}</a>' for k in range(rng.integers(2, 8))]
        return "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>" if rng.random() < 0.7 else " ".join(items)

    def prose_of(n: int) -> str:
        return "".join(f"<p>{few(int(rng.integers(5, 60)))}</p>" for _ in range(n)) if rng.random() < 0.6 else few(int(rng.integers(3, 40)))

    def part(options: tuple[str, ...], inner: str) -> str:
        return pick(options).format(inner.replace("{", "(").replace("}", ")"))

    def aside() -> str:
        return part(_ASIDES, menu() if rng.random() < 0.3 else prose_of(int(rng.integers(1, 4))))

    def end() -> str:
        return part(_ENDS, menu() if rng.random() < 0.2 else prose_of(int(rng.integers(1, 6))))

    before = [f"<head><title>{few(6)}</title></head>"] + [part(_MENUS, menu()) for _ in range(rng.integers(0, 3))] + [aside() for _ in range(rng.integers(0, 3))]
    level = rng.integers(1, 4)
    body = [f"<h{level}>{few(int(rng.integers(2, 9)))}</h{level}>"] if rng.random() < 0.8 else []
    for _ in range(rng.integers(1, 10)):
        kind = rng.random()
        text = few(int(rng.integers(1, 80)))
        if kind < 0.75:
            body.append(f"<p>{text}</p>")
        elif kind < 0.85:
            body.append("<ul>" + "".join(f"<li>{few(8)}</li>" for _ in range(rng.integers(1, 4))) + "</ul>")
        else:
            body.append(pick(("<blockquote>{}</blockquote>", "<h3>{}</h3>", "<pre>{}</pre>", "<p><b>{}<br>", "<div>{}</div>", "<td>{}</td>")).format(text))
    inside = [(1, x) for x in body]
    if rng.random() < 0.3:
        inside.insert(int(rng.integers(1, len(inside) + 1)), (0, aside()))
    if rng.random() < 0.15:
        inside.append((0, end()))
    opened, closed = pick(_ARTICLES)
    after = [aside() for _ in range(rng.integers(0, 2))] + [end() for _ in range(rng.integers(0, 3))]
    sign = "\ue000"  # marks text of the article, to be taken off again
    shown = "".join(re.sub(r">([^<]+)", rf">{sign}\1", x) if good else x for good, x in inside)
    leaves = blocks("<html><body>" + "".join(before) + opened + shown + closed + "".join(after) + "</body></html>")
    labels = np.array([sign in b.text for b in leaves], np.float32)
    return [Block(b.text.replace(sign, ""), b.path, b.links) for b in leaves], labels


def fitted(sample: list[str], most: int = MAX_PAGES, seed: int = 5) -> Labeller:
    """The labeller fitted on whole pages and on layouts composed of their blocks."""
    rng = np.random.default_rng(seed)
    x, y, prose = [], [], []
    for page in sample:
        leaves = blocks(page)
        prose += [b.text for b in leaves if len(b.text.split()) > 15]
        labels = marked(leaves)
        if labels is not None:
            x.append(vectors(leaves))
            y.append(labels)
    prose = prose or [" ".join(f"word{k}" for k in range(80))]
    for _ in range(3 * most):
        leaves, labels = compose(rng, prose)
        if leaves:
            x.append(vectors(leaves))
            y.append(labels)
    model = Labeller()
    model.fit(x, y)
    return model


def train(pages: DataFrame, most: int = MAX_PAGES, seed: int = 5) -> Labeller:
    """Fits in one task, on ``most`` pages by a hash of page_id and url; keys come to the driver, and the weights."""
    rows = pages.where("html is not null").select(F.xxhash64("page_id", "url").alias("key"), "html")
    # few more than needed are looked at, whatever the number of pages
    share = min(1.0, 20 * most / max(rows.count(), 1))
    likely = rows.where(F.col("key") <= min(2**63 - 1, -(2**63) + int(share * 2**64)))
    keys = [r[0] for r in likely.select("key").distinct().orderBy("key").limit(most).collect()]
    # pages that share a key are one
    sample = rows.where(F.col("key").isin(keys)).groupBy("key").agg(F.min("html").alias("html")) if keys else None

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = sorted(page for batch in batches for page in batch.column(0).to_pylist())
        yield pa.record_batch([pa.array([pickle.dumps(fitted(held, most, seed).weights())], pa.binary())], ["weights"])

    found = sample.select("html").repartition(1).mapInArrow(fit, "weights binary").first() if keys else None
    return Labeller().load(pickle.loads(found.weights)) if found else Labeller()


def extract(pages: DataFrame, model: Labeller | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """One row per page: page_id, url, text and n_chars."""
    model = model or train(pages)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                leaves = [blocks(h or "") for h in part.column(2).to_pylist()]
                likely = model.probabilities([vectors(own) for own in leaves])
                texts = [" ".join(b.text for b, p in zip(own, ps, strict=True) if p >= threshold) for own, ps in zip(leaves, likely, strict=True)]
                columns = [part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())]
                yield pa.record_batch(columns, ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html")
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
