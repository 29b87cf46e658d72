"""Main text of web pages by a recurrent block labeller.

A page's blocks are read in order by a bidirectional LSTM, so each is classified in the light of the whole page.  A
block enters as hashed vectors of its tag path and of its words, with a few lengths.  The network learns from pages
that are made here: articles of invented words among menus, notices, adverts, forms, sidebars, comments and footers,
in many layouts and under many class names.
"""

from __future__ import annotations

import random
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.html_blocks import Block, Path, blocks

PATH_DIM, WORD_DIM, SHAPE_DIM = 192, 32, 6
INPUT = PATH_DIM + WORD_DIM + SHAPE_DIM
HIDDEN = 24
TRAINING_PAGES, EPOCHS, BATCH = 600, 8, 12
RATE = 0.008
SEED = 7
BLOCKS_A_BATCH = 4096


# ---- features ---------------------------------------------------------------------------------------------------


class Slots(dict):
    """Where a token's vector has its 1: below dim, or its -1: dim higher.  Forgets all when full."""

    def __init__(self, dim: int, most: int = 400_000):
        super().__init__()
        self.dim, self.most = dim, most

    def __missing__(self, token: str) -> int:
        if len(self) >= self.most:
            self.clear()
        h = zlib.crc32(token.encode("utf-8", "replace"))
        slot = self[token] = (h >> 1) % self.dim + self.dim * (h & 1)
        return slot

    def vector(self, tokens: list[str]) -> np.ndarray:
        n = np.bincount(np.fromiter(map(self.__getitem__, tokens), np.int64, len(tokens)), minlength=2 * self.dim)
        return n[: self.dim] - n[self.dim :]


_of_word, _of_path = Slots(WORD_DIM), Slots(PATH_DIM)


def _path_vector(path: Path) -> np.ndarray:
    """Of the distinct tokens of a path: what those around it have, and its own; kept with each of them."""
    way, node = [], path
    while node is not None and node.vector is None:
        way.append(node)
        node = node.parent
    v = node.vector if node is not None else np.zeros(PATH_DIM, np.int32)
    for node in reversed(way):
        if node.new:
            v = v.copy()
            for token in node.new:
                slot = _of_path[token]
                v[slot % PATH_DIM] += 1 if slot < PATH_DIM else -1
        node.vector = v
    return v


def vector(block: Block, place: float) -> np.ndarray:
    v = np.empty(INPUT)
    v[:PATH_DIM] = _path_vector(block.path)
    words, n = block.text.lower().split(), len(block.text)
    v[PATH_DIM : PATH_DIM + WORD_DIM] = _of_word.vector(words) / (8 * len(words) ** 0.5)
    v[-SHAPE_DIM:] = (np.log1p(len(words)) / 4, block.linked / n, sum(map(block.text.count, ".,;:!?")) / len(words), place, 1.0, block.path.depth / 16)
    return v


def vectors(found: list[Block]) -> np.ndarray:
    return np.array([vector(b, i / len(found)) for i, b in enumerate(found)]) if found else np.zeros((0, INPUT))


# ---- network ----------------------------------------------------------------------------------------------------


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


Weights = dict[str, np.ndarray]


def new_weights(rng: np.random.Generator) -> Weights:
    out: Weights = {"out": rng.normal(0, 0.1, 2 * HIDDEN + INPUT + 1)}
    for side in "fb":
        out[side] = rng.normal(0, 0.15, (INPUT + HIDDEN + 1, 4 * HIDDEN))
        out[side][-1, HIDDEN : 2 * HIDDEN] = 1.0  # remember at first
    return out


def _lstm(x: np.ndarray, mask: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, list]:
    """Hidden states of sequences (steps, pages, INPUT); masked steps keep the state.  Also what the way back needs."""
    steps, pages, _ = x.shape
    h, c = np.zeros((pages, HIDDEN)), np.zeros((pages, HIDDEN))
    inner = x @ w[:INPUT] + w[-1]
    out, tape = np.zeros((steps, pages, HIDDEN)), []
    for t in range(steps):
        z = inner[t] + h @ w[INPUT:-1]
        i, f, o = (_sigmoid(z[:, k * HIDDEN : (k + 1) * HIDDEN]) for k in range(3))
        g = np.tanh(z[:, 3 * HIDDEN :])
        new_c = f * c + i * g
        th = np.tanh(new_c)
        m = mask[t][:, None]
        tape.append((h, c, i, f, o, g, th, m))
        c = m * new_c + (1 - m) * c
        h = m * (o * th) + (1 - m) * h
        out[t] = h
    return out, tape


def _lstm_back(x: np.ndarray, w: np.ndarray, tape: list, d_out: np.ndarray) -> np.ndarray:
    """Gradient of the weights, from that of the hidden states."""
    grad = np.zeros_like(w)
    dh, dc = np.zeros_like(d_out[0]), np.zeros_like(d_out[0])
    for t in range(len(tape) - 1, -1, -1):
        h, c, i, f, o, g, th, m = tape[t]
        dh = dh + d_out[t]
        now, keep_h = m * dh, (1 - m) * dh
        d_new = m * dc + now * o * (1 - th * th)
        dz = np.concatenate([d_new * g * i * (1 - i), d_new * c * f * (1 - f), now * th * o * (1 - o), d_new * i * (1 - g * g)], axis=1)
        grad[:INPUT] += x[t].T @ dz
        grad[INPUT:-1] += h.T @ dz
        grad[-1] += dz.sum(axis=0)
        dh = dz @ w[INPUT:-1].T + keep_h
        dc = d_new * f + (1 - m) * dc
    return grad


def _padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    steps = max(map(len, pages))
    x, mask = np.zeros((steps, len(pages), INPUT)), np.zeros((steps, len(pages)))
    for k, p in enumerate(pages):
        x[: len(p), k], mask[: len(p), k] = p, 1
    return x, mask


def _forward(x: np.ndarray, mask: np.ndarray, w: Weights) -> tuple[np.ndarray, np.ndarray, list, list]:
    ahead, tape_f = _lstm(x, mask, w["f"])
    back, tape_b = _lstm(x[::-1], mask[::-1], w["b"])
    both = np.concatenate([ahead, back[::-1], x], axis=2)
    return _sigmoid(both @ w["out"][:-1] + w["out"][-1]), both, tape_f, tape_b


def probabilities(pages: list[np.ndarray], w: Weights) -> list[np.ndarray]:
    """Of each block of each page, that it is main text.  Pages of like length are read together."""
    out: list[np.ndarray] = [np.zeros(0)] * len(pages)
    order = sorted((k for k in range(len(pages)) if len(pages[k])), key=lambda k: len(pages[k]))
    while order:
        longest = len(pages[order[-1]])
        take = [order.pop() for _ in range(min(len(order), max(1, BLOCKS_A_BATCH // longest)))]
        x, mask = _padded([pages[k] for k in take])
        p = _forward(x, mask, w)[0]
        for j, k in enumerate(take):
            out[k] = p[: len(pages[k]), j]
    return out


def train(pages: list[tuple[np.ndarray, np.ndarray]], seed: int = SEED) -> Weights:
    """Weights fitted to pages of (vectors, labels) by Adam on the cross entropy."""
    rng = np.random.default_rng(seed)
    w = new_weights(rng)
    first, second = ({k: np.zeros_like(v) for k, v in w.items()} for _ in range(2))
    step = 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(pages))
        for k in range(0, len(order), BATCH):
            chosen = [pages[i] for i in order[k : k + BATCH]]
            x, mask = _padded([p for p, _ in chosen])
            x = x * (rng.random(x.shape) > 0.1)  # inputs are dropped, so that no one of them decides alone
            y = np.zeros(mask.shape)
            for j, (_, label) in enumerate(chosen):
                y[: len(label), j] = label
            p, both, tape_f, tape_b = _forward(x, mask, w)
            d = (p - y) * mask / mask.sum()
            grad = {"out": np.append((both * d[:, :, None]).sum(axis=(0, 1)), d.sum())}
            d_both = d[:, :, None] * w["out"][:-1]
            grad["f"] = _lstm_back(x, w["f"], tape_f, d_both[:, :, :HIDDEN])
            grad["b"] = _lstm_back(x[::-1], w["b"], tape_b, d_both[::-1, :, HIDDEN : 2 * HIDDEN])
            step += 1
            for name, g in grad.items():
                g = np.clip(g + 1e-5 * w[name], -1, 1)
                first[name] = 0.9 * first[name] + 0.1 * g
                second[name] = 0.99 * second[name] + 0.01 * g * g
                w[name] -= RATE * first[name] / (1 - 0.9**step) / (np.sqrt(second[name] / (1 - 0.99**step)) + 1e-8)
    return w


# ---- pages to learn from ----------------------------------------------------------------------------------------

# a choice of our own: names that sites often give to parts of pages
CALLED = {
    "menu": "nav menu navbar navigation topnav main-menu links".split(),
    "head": "header site-header masthead top-bar banner branding".split(),
    "foot": "footer site-footer page-footer bottom copyright colophon".split(),
    "side": "sidebar aside widget related rail recommended trending popular secondary".split(),
    "note": "notice cookie cookie-notice consent alert popup modal gdpr message subscribe-note".split(),
    "ad": "ad ads advert advertisement sponsored promo promotion adsense ad-slot banner-ad".split(),
    "form": "search login newsletter signup subscribe contact search-form".split(),
    "share": "share social share-buttons breadcrumb breadcrumbs tags pagination meta-links".split(),
    "comments": "comments comment-list responses reader-comments disqus discussion replies".split(),
    "body": "content post entry story article-body article post-content main entry-content text body".split(),
    "plain": "wrapper container row col inner page layout wrap box outer site".split(),
}
MARK = "\x01"  # at the start of text that is main text


class PageMaker:
    """Pages with known main text."""

    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def words(self, low: int, high: int) -> str:
        r = self.r
        out = ["".join(r.choice("aeioubcdfglmnprst") for _ in range(r.randint(1, 9))) for _ in range(int(low * (high / low) ** r.random()))]
        return " ".join(w + r.choice(("", "", "", "", ",", ".")) for w in out).capitalize() + r.choice((".", ".", ""))

    def named(self, part: str, tags: str, inner: str) -> str:
        r = self.r
        tag = r.choice(tags.split())
        if tag not in ("div", "section", "ul", "p") and r.random() < 0.4:
            return f"<{tag}>{inner}</{tag}>"
        name = r.choice(CALLED[part]) + r.choice(("", "", f" {r.choice(CALLED['plain'])}"))
        return f'<{tag} {r.choice(("class", "class", "id"))}="{name}">{inner}</{tag}>'

    def links(self, n: int) -> str:
        r = self.r
        items = [f'<a href="/{i}">{self.words(1, 4)}</a>' for i in range(n)]
        return r.choice(("<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>", " | ".join(items), "".join(f"<p>{x}</p>" for x in items), "".join(f"<div>{x}</div>" for x in items)))

    def junk(self, part: str) -> str:
        r = self.r
        some = lambda: r.choice((self.words(2, 40), f"<p>{self.words(2, 60)}</p>", f"<p>{self.words(3, 20)} <a href='#'>{self.words(1, 3)}</a></p>"))
        if part == "menu":
            return self.named("menu", "nav nav div ul", self.links(r.randint(2, 9)))
        if part == "head":
            return self.named("head", "header header div", r.choice(("", f"<h1>{self.words(1, 4)}</h1>", f"<div>{self.words(1, 6)}</div>")) + some() + r.choice(("", self.junk("menu"))))
        if part == "foot":
            return self.named("foot", "footer footer div", r.choice((f"&copy; {self.words(1, 30)}", some() + self.links(3), some())))
        if part == "side":
            return self.named("side", "aside aside div section", f"<h3>{self.words(1, 4)}</h3>" + r.choice((self.links(4), some() + some())))
        if part == "note":
            return self.named("note", "div section aside", some() + r.choice(("", f"<button>{self.words(1, 2)}</button>")))
        if part == "ad":
            return self.named("ad", "div div aside section p", r.choice((self.words(2, 25), some())))
        if part == "form":
            inner = f"<label>{self.words(1, 4)}</label><input name='q'><select><option>{self.words(1, 2)}<option>{self.words(1, 2)}</select><button>{self.words(1, 2)}</button>"
            return r.choice((f"<form>{some()}{inner}</form>", self.named("form", "div section", f"<form>{inner}</form>"), self.named("form", "form", some() + inner)))
        if part == "share":
            return self.named("share", "div ul nav", self.links(r.randint(2, 5)))
        one = lambda: f'<div class="{r.choice(("comment", "reply", "comment-body"))}"><b>{self.words(1, 2)}</b><p>{self.words(3, 60)}</p></div>'
        return self.named("comments", "div section", f"<h3>{self.words(1, 3)}</h3>" + "".join(one() for _ in range(r.randint(1, 5))))

    def article(self) -> str:
        r, m = self.r, MARK
        out = []
        if r.random() < 0.85:
            title = f"<h1>{m}{self.words(1, 14)}</h1>"
            out.append(r.choice((title, title, f"<header>{title}</header>")))
        for _ in range(r.randint(1, 14)):
            kind = r.random()
            text = lambda: m + self.words(1, 140)
            if kind < 0.72:
                out.append(r.choice((f"<p>{text()}</p>", f"<p>{text()}", f"<p><b>{text()}</b></p>", f"<p>{text()} <a href='#'>{self.words(1, 3)}</a> {self.words(1, 9)}</p>", f"<div>{text()}</div>")))
            elif kind < 0.8:
                out.append(f"<h{r.randint(2, 4)}>{m}{self.words(1, 8)}</h2>")
            elif kind < 0.86:
                out.append("<ul>" + "".join(f"<li>{m}{self.words(1, 20)}</li>" for _ in range(r.randint(1, 5))) + "</ul>")
            elif kind < 0.9:
                out.append(r.choice((f"<blockquote>{text()}</blockquote>", f"<blockquote><p>{text()}</p></blockquote>", f"<pre>{text()}</pre>", f"<figure><img src='x'><figcaption>{text()}</figcaption></figure>")))
            elif kind < 0.93:
                out.append("<table>" + "".join(f"<tr><td>{m}{self.words(1, 4)}</td><td>{m}{self.words(1, 4)}</td></tr>" for _ in range(3)) + "</table>")
            else:
                out.append(self.junk(r.choice(("ad", "ad", "share", "note", "form", "side"))))
        inner = "".join(out)
        way = r.random()
        if way < 0.45:
            return f"<article>{inner}</article>"
        if way < 0.6:
            return f"<main>{inner}</main>"
        if way < 0.75:
            return f"<main>{self.named('body', 'article div section', inner)}</main>"
        return self.named("body", "div div section", inner)

    def page(self) -> str:
        r = self.r
        maybe = lambda part, p: self.junk(part) if r.random() < p else ""
        around = self.article() + maybe("comments", 0.3)
        around = maybe("side", 0.25) + around + maybe("side", 0.3) if r.random() < 0.5 else around
        if r.random() < 0.4:
            around = f'<div class="{r.choice(CALLED["plain"])}">{around}</div>'
        top = [maybe("note", 0.3), maybe("head", 0.5), maybe("menu", 0.7), maybe("ad", 0.5), maybe("form", 0.25), maybe("share", 0.2)]
        r.shuffle(top)
        low = [maybe("side", 0.2), maybe("ad", 0.3), maybe("form", 0.2), maybe("menu", 0.2), maybe("note", 0.15), maybe("comments", 0.15)]
        r.shuffle(low)
        return f"<html><head><title>{self.words(1, 9)}</title><style>p{{}}</style></head><body>{''.join(top)}{around}{''.join(low)}{maybe('foot', 0.85)}</body></html>"


def learnt_page(page: str) -> tuple[np.ndarray, np.ndarray]:
    found = blocks(page)
    label = np.array([b.text.startswith(MARK) for b in found], float)
    for b in found:
        b.text = b.text.replace(MARK, "")
    return vectors(found), label


@lru_cache(maxsize=1)
def trained(pages: int = TRAINING_PAGES, seed: int = SEED) -> Weights:
    maker = PageMaker(seed)
    return train([x for x in (learnt_page(maker.page()) for _ in range(pages)) if len(x[0])], seed)


# ---- pages ------------------------------------------------------------------------------------------------------


@dataclass
class Extractor:
    weights: Weights
    threshold: float = 0.5

    def texts(self, pages: list[str | None]) -> list[str]:
        """The main text of each page, its blocks joined by a space."""
        found = [blocks(p or "") for p in pages]
        keep = probabilities([vectors(b) for b in found], self.weights)
        return [" ".join(b.text for b, p in zip(bs, ps, strict=True) if p >= self.threshold) for bs, ps in zip(found, keep, strict=True)]


PAGES_A_TIME = 256


def main_text(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Every row's id, url, text and n_chars, the code points of the text.

    A null or empty page has an empty text, as has one without main text.  No block is shortened, whatever its
    length.  Rows that repeat an id stay separate.
    """
    held = pages.sparkSession.sparkContext.broadcast(trained())

    def extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        extractor = Extractor(held.value)
        for batch in batches:
            texts = [t for k in range(0, len(batch), PAGES_A_TIME) for t in extractor.texts(batch["html"].iloc[k : k + PAGES_A_TIME].tolist())]
            yield pd.DataFrame({"id": batch["id"].astype("Int64"), "url": batch["url"], "text": texts})

    chosen = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    done = chosen.mapInPandas(extract, "id long, url string, text string")
    return done.select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text", F.length("text").cast("long").alias("n_chars"))
