"""Main text of web pages by a recurrent block labeller.

A page is cut into leaf blocks: runs of text between block-level tags or line breaks, with character references
decoded and white space reduced to single spaces. Scripts, styles, comments and other content that is never shown
are not blocks; an element of that kind without an end tag is read as any other. The scanner is linear in a page's
length, and blocks share the nodes of their tag paths, whatever is nested or left open. Each block has two hashed
vectors, of its tag path (element names with their class and id words) and of its words, beside its length and link
share. A bidirectional LSTM in numpy reads a page's blocks in order, both ways, and labels every block as main text or
not with the whole page as context.

The labeller is trained on at most ``most_pages`` pages (default 250, the first by a hash of their id, up to 60,000
characters each) and variants of them with furniture moved in and containers renamed. Labels come from plain rules
over element and class names. Each training page is there a second time without any names but with the same labels, so
that the network learns what main text is by order, length, links and words where names are missing. Everything else
covers all pages and whole texts; a page of any number of blocks is read in full.

Nulls: a null or empty html has empty text; null page_ids and urls are kept; repeated rows give one result each. A
block whose score is exactly even is not main text. Extra columns, of any name, are not looked at. An empty table
gives no rows and needs no model.
"""

from __future__ import annotations

import functools
import html as entities
import random
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.llm import common

PATH_DIM, WORD_DIM, HIDDEN = 96, 24, 16
MOST_PAGES, MOST_TRAIN_CHARS = 250, 60_000
_OPEN = re.compile(r"<(?:(/?)([a-zA-Z][^\s/>]*)|(!--)|[!?])")
_REST = re.compile(r"((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>")
_ATTRIBUTE = re.compile(r"(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_SPACE = re.compile(r"\s+")
_NAME = re.compile(r"[a-z]+")
_WORDS = re.compile(r"\w+")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Content that is never shown as text: to its end tag, or to the end of the page for the first two. Without an end tag the others are plain elements.
RAW = frozenset(("script", "style"))
HIDDEN_CONTENT = RAW | frozenset("noscript template title textarea select svg iframe object canvas audio video".split())
INLINE = frozenset("a abbr acronym audio b bdi bdo big canvas cite code data del dfn em font i iframe ins kbd label mark math mi mn mo mrow ms msub msup mtext object q s samp select small span strike strong sub sup svg textarea time tt u var video wbr".split())
_CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_ENDS_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())


class Node:
    """An open element. It shares its parents with all others below them and holds what the labeller and the training rule need of its path."""

    __slots__ = ("element", "furniture", "main", "parent", "vector")

    def __init__(self, parent: Node | None, element: str):
        self.parent, self.element = parent, element
        vector, furniture, main = _elements[element]
        if parent is None:
            self.vector, self.furniture, self.main = vector, furniture, main
        else:
            self.vector, self.furniture, self.main = parent.vector + vector, parent.furniture or furniture, parent.main or main


@dataclass
class Block:
    text: str
    node: Node
    linked: int  # characters inside links

    @property
    def path(self) -> tuple[str, ...]:
        out, node = [], self.node
        while node.parent is not None:
            out.append(node.element)
            node = node.parent
        return tuple(reversed(out))


def _element(name: str, attributes: str) -> str:
    words = sorted({w for m in _ATTRIBUTE.finditer(attributes) for w in _NAME.findall((m[2] or m[3] or m[4] or "").lower())}) if "=" in attributes else []
    return ".".join([name, *words])


@functools.cache
def _end_tag(name: str) -> re.Pattern:
    return re.compile(rf"</{re.escape(name)}\s*>", re.I)


_HEAD_END = re.compile(r"</head\s*>|<body\b", re.I)


class _Parser:
    """One pass over a page, in time linear in its length: what has not been found up to the end is not looked for again."""

    def __init__(self, page: str):
        self.page, self.out, self.held = page, [], []
        self.stack: list[tuple[str, Node]] = []
        self.open: Counter = Counter()
        self.linked, self.in_head, self.heads, self.quotes = 0, False, 0, True
        self.unended: set[str] = set()

    def flush(self) -> None:
        if self.held:
            text = _SPACE.sub(" ", "".join(self.held)).strip()
            if text:
                self.out.append(Block(text, self.stack[-1][1] if self.stack else _root, min(self.linked, len(text))))
            self.held.clear()
        self.linked = 0

    def take(self, raw: str) -> None:
        if self.in_head or not raw:
            return
        text = entities.unescape(raw)
        self.held.append(text)
        if self.open["a"]:
            self.linked += len(text)

    def cut(self, k: int) -> None:
        """Close the elements from the k-th on."""
        for name, _ in self.stack[k:]:
            self.open[name] -= 1
        del self.stack[k:]

    def rest(self, at: int) -> tuple[str, int] | None:
        """Attributes of a tag whose name ends at a place, and where the tag ends; quotes that are never closed count for nothing."""
        if self.quotes:
            if m := _REST.match(self.page, at):
                return m[1], m.end()
            self.quotes = False
        end = self.page.find(">", at)
        return None if end < 0 else (self.page[at:end], end + 1)

    def close(self, name: str) -> None:
        if name == "head":
            self.in_head = False
        if name not in INLINE:
            self.flush()
        if self.open[name]:
            k = len(self.stack) - 1
            while self.stack[k][0] != name:
                k -= 1
            self.cut(k)

    def begin(self, name: str, attributes: str, at: int) -> int:
        """Open an element whose tag ends at a place; where to go on."""
        if name == "head":
            self.heads += 1
            self.in_head = self.heads == 1 and _HEAD_END.search(self.page, at) is not None
            return at
        if name == "body":
            self.in_head = False
        if name in HIDDEN_CONTENT and name not in self.unended and not attributes.endswith("/"):
            if end := _end_tag(name).search(self.page, at):
                return end.end()
            if name in RAW:
                return len(self.page)
            self.unended.add(name)
        if name not in INLINE:
            self.flush()
        if name in _CLOSES or name in _ENDS_P:
            closing = _CLOSES.get(name, frozenset()) | ({"p"} if name in _ENDS_P else frozenset())
            k = len(self.stack) - 1
            while k >= 0 and self.stack[k][0] in INLINE and self.stack[k][0] not in closing:
                k -= 1
            if k >= 0 and self.stack[k][0] in closing:
                self.cut(k)
        if name not in VOID and not attributes.endswith("/"):
            self.stack.append((name, Node(self.stack[-1][1] if self.stack else _root, _element(name, attributes))))
            self.open[name] += 1
        return at

    def run(self) -> list[Block]:
        page, at, last = self.page, 0, self.page.rfind(">")
        text_from = 0
        while (m := _OPEN.search(page, at)) and m.start() < last:
            if m[3]:
                end = page.find("-->", m.end())
                following = len(page) if end < 0 else end + 3
            else:
                found = self.rest(m.end()) if m[2] else ("", page.find(">", m.end()) + 1)
                if found is None or not found[1]:
                    at = m.end()
                    continue
                following = found[1]
            self.take(page[text_from : m.start()])
            if m[2]:
                name = m[2].lower()
                if m[1]:
                    self.close(name)
                else:
                    following = self.begin(name, found[0], following)
            at = text_from = following
        if not (m and m[3]):  # an unclosed comment hides the rest
            self.take(page[text_from:])
        else:
            self.take(page[text_from : m.start()])
        self.flush()
        return self.out


def parse(page: str | None) -> list[Block]:
    """Leaf blocks of a page in order."""
    return _Parser(page).run() if page else []


#: Names of elements, and words of classes and ids, of page furniture and of main text: fixed values of the rules.
FURNITURE_TAGS = frozenset("nav header footer aside form button menu dialog fieldset label input".split())
FURNITURE_WORDS = frozenset(
    "ad ads advert advertisement sponsor sponsored promo banner cookie cookies consent notice alert nav navigation navbar menu breadcrumb "
    "breadcrumbs sidebar side rail footer header masthead topbar comment comments respond reply replies discussion disqus share sharing "
    "social related recommended newsletter subscribe signup login search widget toolbar popup modal copyright legal tags pagination pager".split()
)
MAIN_TAGS = frozenset(("article", "main"))
MAIN_WORDS = frozenset("article content main entry post story body text".split())


def _place(word: str, size: int) -> tuple[int, float]:
    h = zlib.crc32(word.encode("utf-8", "surrogatepass"))
    return h % size, 1.0 if h >> 16 & 1 else -1.0


class _Elements(dict):
    """Vector of an element, and whether it is furniture, and main text, by the names in it."""

    def __missing__(self, element: str) -> tuple[np.ndarray, bool, bool]:
        vector = np.zeros(PATH_DIM, np.float32)
        name, *words = element.split(".")
        for word in (name, *words):
            k, sign = _place(f"path {word}", PATH_DIM)
            vector[k] += sign
        furniture = name in FURNITURE_TAGS or not FURNITURE_WORDS.isdisjoint(words)
        main = name in MAIN_TAGS or (name in ("div", "section") and not MAIN_WORDS.isdisjoint(words))
        out = vector, furniture, main
        if len(self) < 50_000:
            self[element] = out
        return out


_elements = _Elements()
_elements[""] = np.zeros(PATH_DIM, np.float32), False, False
_root = Node(None, "")


def rule(block: Block) -> bool:
    """The training rule for one block: below a main element and no furniture."""
    return block.node.main and not block.node.furniture


class _WordPlaces(dict):
    def __missing__(self, word: str) -> int:
        place = zlib.crc32(word.encode("utf-8", "surrogatepass")) % WORD_DIM
        if len(self) < 300_000:
            self[word] = place
        return place


_word_places = _WordPlaces()
INPUT = PATH_DIM + WORD_DIM + 3


def vectors(found: list[Block]) -> np.ndarray:
    out = np.zeros((len(found), INPUT), np.float32)
    for row, block in zip(out, found, strict=True):
        row[:PATH_DIM] = np.clip(block.node.vector, -2, 2)
        own = _WORDS.findall(block.text.lower())
        at = np.fromiter(map(_word_places.__getitem__, own), np.int64, len(own))
        counts = np.bincount(at, minlength=WORD_DIM)
        row[PATH_DIM:-3] = counts / max(1, np.sqrt((counts**2).sum()))
        row[-3:] = np.log1p(len(own)) / 5, block.linked / len(block.text), 1.0
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Lstm:
    """One direction: time-major batches, a mask that holds the state at zero on padding, and its gradient."""

    def __init__(self, rng: np.random.Generator, inputs: int, hidden: int):
        scale = 1 / np.sqrt(inputs + hidden)
        self.wx = (rng.normal(size=(inputs, 4 * hidden)) * scale).astype(np.float32)
        self.wh = (rng.normal(size=(hidden, 4 * hidden)) * scale).astype(np.float32)
        self.b = np.zeros(4 * hidden, np.float32)
        self.b[hidden : 2 * hidden] = 1.0
        self.hidden = hidden

    @property
    def parameters(self) -> list[np.ndarray]:
        return [self.wx, self.wh, self.b]

    def forward(self, x: np.ndarray, mask: np.ndarray, keep: bool = False) -> np.ndarray:
        steps, batch, _ = x.shape
        n = self.hidden
        z = x.reshape(steps * batch, -1) @ self.wx + self.b
        z = z.reshape(steps, batch, 4 * n)
        h, c = np.zeros((batch, n), np.float32), np.zeros((batch, n), np.float32)
        out = np.zeros((steps, batch, n), np.float32)
        self.kept = []
        for t in range(steps):
            a = z[t] + h @ self.wh
            gates, g = _sigmoid(a[:, : 3 * n]), np.tanh(a[:, 3 * n :])
            m = mask[t][:, None]
            before, c = c, (gates[:, n : 2 * n] * c + gates[:, :n] * g) * m
            tc = np.tanh(c)
            if keep:
                self.kept.append((h, before, gates, g, tc, m))
            h = gates[:, 2 * n :] * tc * m
            out[t] = h
        return out

    def backward(self, x: np.ndarray, slope: np.ndarray) -> list[np.ndarray]:
        steps, batch, _ = x.shape
        n = self.hidden
        dz = np.zeros((steps, batch, 4 * n), np.float32)
        dh, dc = np.zeros((batch, n), np.float32), np.zeros((batch, n), np.float32)
        dwh = np.zeros_like(self.wh)
        for t in range(steps - 1, -1, -1):
            h, before, gates, g, tc, m = self.kept[t]
            i, f, o = gates[:, :n], gates[:, n : 2 * n], gates[:, 2 * n :]
            dh = (dh + slope[t]) * m
            dc = (dc + dh * o * (1 - tc**2)) * m
            dz[t] = np.concatenate([dc * g * i * (1 - i), dc * before * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - g**2)], axis=1)
            dwh += h.T @ dz[t]
            dh = dz[t] @ self.wh.T
            dc = dc * f
        flat = dz.reshape(steps * batch, 4 * n)
        return [x.reshape(steps * batch, -1).T @ flat, dwh, flat.sum(axis=0)]


class Labeller:
    """Two LSTMs, one for each direction, and a logistic output for each block."""

    def __init__(self, seed: int = 0, hidden: int = HIDDEN):
        rng = np.random.default_rng(seed)
        self.ahead, self.back = Lstm(rng, INPUT, hidden), Lstm(rng, INPUT, hidden)
        self.w = (rng.normal(size=2 * hidden) * 0.3).astype(np.float32)
        self.bias = np.zeros(1, np.float32)

    @property
    def parameters(self) -> list[np.ndarray]:
        return [*self.ahead.parameters, *self.back.parameters, self.w, self.bias]

    @staticmethod
    def padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        steps = max(map(len, pages))
        x, mask = np.zeros((steps, len(pages), INPUT), np.float32), np.zeros((steps, len(pages)), np.float32)
        for k, page in enumerate(pages):
            x[: len(page), k], mask[: len(page), k] = page, 1
        return x, mask

    def logits(self, x: np.ndarray, mask: np.ndarray, keep: bool = False) -> np.ndarray:
        ahead, back = self.ahead.forward(x, mask, keep), self.back.forward(x[::-1], mask[::-1], keep)[::-1]
        self.both = np.concatenate([ahead, back], axis=2)
        return self.both @ self.w + self.bias

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Mean cross-entropy of the blocks and its gradient."""
        z = self.logits(x, mask, keep=True)
        n = mask.sum()
        loss = float(((np.logaddexp(0, z) - y * z) * mask).sum() / n)
        slope = (_sigmoid(z) - y) * mask / n
        to_w = np.einsum("tb,tbh->h", slope, self.both)
        each = slope[:, :, None] * self.w
        hidden = self.ahead.hidden
        return loss, [*self.ahead.backward(x, each[:, :, :hidden]), *self.back.backward(x[::-1], each[::-1, :, hidden:]), to_w, slope.sum().reshape(1)]

    def fit(self, pages: list[np.ndarray], labels: list[np.ndarray], rounds: int = 14, batch: int = 32, rate: float = 0.01, seed: int = 0) -> float:
        order = np.argsort([len(p) for p in pages], kind="stable")
        batches = [order[k : k + batch] for k in range(0, len(order), batch)]
        rng, turn, loss = np.random.default_rng(seed), 0, 0.0
        state = [(p, np.zeros_like(p), np.zeros_like(p)) for p in self.parameters]
        for r in range(rounds):
            for k in rng.permutation(len(batches)):
                x, mask = self.padded([pages[i] for i in batches[k]])
                y = np.zeros(mask.shape, np.float32)
                for column, i in enumerate(batches[k]):
                    y[: len(labels[i]), column] = labels[i]
                loss, slopes = self.gradients(x, mask, y)
                turn += 1
                step = rate * (1 - r / (rounds + 1))
                for (p, mean, square), slope in zip(state, slopes, strict=True):
                    mean += 0.1 * (slope - mean)
                    square += 0.001 * (slope * slope - square)
                    p -= step * (mean / (1 - 0.9**turn)) / (np.sqrt(square / (1 - 0.999**turn)) + 1e-8)
        return loss

    def label(self, pages: list[np.ndarray], most: int = 400_000) -> list[np.ndarray]:
        """Whether each block of each page is main text; pages of like length go together, within a bound on padded cells."""
        out: list[np.ndarray] = [np.zeros(0, bool)] * len(pages)
        order = [i for i in sorted(range(len(pages)), key=lambda i: len(pages[i])) if len(pages[i])]
        group: list[int] = []

        def run() -> None:
            z = self.logits(*self.padded([pages[i] for i in group]))
            for column, i in enumerate(group):
                out[i] = z[: len(pages[i]), column] > 0
            group.clear()

        for i in order:
            if group and len(pages[i]) * (len(group) + 1) * INPUT > most * 8:
                run()
            group.append(i)
        if group:
            run()
        return out


_FURNITURE = (
    '<nav><ul><li><a href="/">{a}</a></li><li><a href="/x">{b}</a></li></ul></nav>', "<header><a>{a}</a><p>{b} {c}</p></header>", "<footer>&copy; {a} {b} {c}</footer>", '<aside class="sidebar"><h3>{a}</h3><p>{c}</p></aside>',
    '<div class="ad">{c}</div>', '<div class="cookie-notice"><p>{c}</p><button>{a}</button></div>', '<form><label>{a}</label><p>{b}</p><input name="q"><button>{b}</button></form>',
    '<section class="comments" id="comments"><h3>{a}</h3><div class="comment"><p>{c}</p></div><div class="comment"><p>{d}</p></div></section>', '<div class="related"><ul><li><a>{c}</a></li><li><a>{d}</a></li></ul></div>', '<div class="newsletter subscribe"><p>{c}</p></div>',
    '<div class="share social"><a>{a}</a> <a>{b}</a></div>', '<div class="breadcrumb"><a>{a}</a> {b}</div>',
)
_CONTAINERS = (("<article>", "</article>"), ("<main>", "</main>"), ('<div class="content">', "</div>"), ('<div id="main-content"><article class="post">', "</article></div>"), ('<section class="entry">', "</section>"))


def variant(page: str, rng: random.Random) -> str:
    """A page with other containers and more furniture, with words of its own."""
    text = [w for w in _WORDS.findall(re.sub(r"<[^>]*>", " ", page[:20_000])) if w.isalpha()] or ["word"]

    def some(n: int) -> str:
        return " ".join(rng.choices(text, k=n))

    def furniture() -> str:
        return rng.choice(_FURNITURE).format(a=some(1), b=some(rng.randint(1, 3)), c=some(rng.randint(5, 30)), d=some(rng.randint(5, 60)))

    opening, closing = rng.choice(_CONTAINERS)
    page = page.replace("<article>", opening).replace("</article>", closing)
    for mark, where in ((opening, "before"), (closing, "after"), ("</p><p>", "inside"), ("<body>", "after")):
        at = page.find(mark)
        if at >= 0 and rng.random() < 0.6:
            cut = at if where == "before" else at + (4 if where == "inside" else len(mark))
            page = page[:cut] + "".join(furniture() for _ in range(rng.randint(1, 3))) + page[cut:]
    return page


_NAMED = re.compile(r"<(/?)(?:article|main|nav|header|footer|aside|section|form|menu|dialog|fieldset)\b[^>]*>", re.I)
_NAMES = re.compile(r"(<[a-z][^<>]*?)\s(?:class|id|role)\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s\"'>]+)", re.I)


def nameless(page: str) -> str:
    """A page whose containers are all plain and whose elements have no class, id or role: blocks stay as they are, names go."""
    page, before = _NAMED.sub(r"<\1div>", page), None
    while page != before:
        page, before = _NAMES.sub(r"\1", page), page
    return page


def train_labeller(sample: list[str], seed: int = 0) -> Labeller:
    """Fit on pages, two variants of each, and the same without names, whose labels are those of the named page."""
    rng = random.Random(seed)
    found, labels = [], []
    for page in sample:
        for p in (page, variant(page, rng), variant(page, rng)):
            own, bare = parse(p), parse(nameless(p))
            y = np.array([rule(b) for b in own], np.float32)
            if own:
                found.append(vectors(own))
                labels.append(y)
            if own and [b.text for b in bare] == [b.text for b in own] and y.any():
                found.append(vectors(bare))
                labels.append(y)
    model = Labeller(seed)
    if found:
        model.fit(found, labels, seed=seed)
    return model


def train(pages: DataFrame, most_pages: int = MOST_PAGES, most_chars: int = MOST_TRAIN_CHARS, seed: int = 0) -> Labeller:
    """Fit on the first pages by a hash of their id and address; the bounds are those of the module."""
    common.prepare(pages.sparkSession)
    key = F.xxhash64("page_id", "url", "html")
    usable = pages.filter(F.col("html").isNotNull() & (F.length("html") <= most_chars)).select(key.alias("key"), F.col("html").cast("string").alias("html"))
    # Keys are ranked first, so that tasks send the driver keys and only the chosen pages' texts.
    chosen = usable.select("key").distinct().orderBy("key").limit(most_pages)
    rows = usable.join(F.broadcast(chosen), "key").groupBy("key").agg(F.min("html").alias("html")).orderBy("key").collect()
    return train_labeller([r["html"] for r in rows], seed)


def extract_text(model: Labeller, pages: list[str | None]) -> list[str]:
    found = [parse(p) for p in pages]
    labels = model.label([vectors(f) for f in found])
    return [" ".join(b.text for b, y in zip(f, own, strict=True) if y) for f, own in zip(found, labels, strict=True)]


def extract(pages: DataFrame, model: Labeller) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    common.prepare(pages.sparkSession)
    model.ahead.kept, model.back.kept, model.both = [], [], None
    sent = pages.sparkSession.sparkContext.broadcast(model)  # under 100 kB

    def apply(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for at in range(0, len(part), 256):
                own = part.iloc[at : at + 256]
                text = extract_text(sent.value, [None if pd.isna(h) else h for h in own["html"]])
                yield pd.DataFrame({"page_id": own["page_id"].to_numpy(), "url": own["url"].to_numpy(), "text": text, "n_chars": np.array([len(t) for t in text], np.int64)})

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInPandas(apply, "page_id long, url string, text string, n_chars long")
