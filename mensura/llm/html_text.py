"""Main-text extraction from HTML: a linear-chain conditional random field over DOM leaf blocks.

A page is cut into leaf blocks, the runs of text between block-level tags.  Each block carries its ancestors' tags and
the kinds of names in their class, id and role attributes, its share of linked text, and features of its words and
place.  The field labels blocks as main text or not, and Viterbi decoding picks the best labelling of a page.  It
is trained on labelled pages that `labelled_pages` composes from common page parts (the words are random, so
that it learns from structure); other labelled pages can be given instead.

Markup, comments, scripts, styles and other elements without readable text make no blocks.  Unclosed, crossed and cut
off tags are tolerated; what follows an unclosed script or comment is not text.  Null and empty pages give an empty
text; pages of the same id are rows of their own.  Nothing is capped: whole pages are read.
"""

from __future__ import annotations

import random
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from html import unescape

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import crf
from .common import over_batches, table

# Element names by their role in a page.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_SILENT = frozenset("script style noscript template svg math iframe object canvas audio video select textarea datalist".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q ruby rt rp s samp small span strike strong sub sup time tt u var wbr".split())
_ANCESTORS = "head title nav header footer aside article main section form button p li h1 h2 h3 h4 table blockquote pre figcaption figure dl details address div body".split()
_BIT = {t: 1 << k for k, t in enumerate(_ANCESTORS)}
_NAMES = {
    "advert": re.compile(r"\b(ads?|advert\w*|sponsor\w*|promo\w*|banner|commercial)\b"),
    "menu": re.compile(r"\b(nav\w*|menu\w*|breadcrumbs?|toolbar|pagination|pager|tabs?)\b"),
    "comment": re.compile(r"\b(comments?|repl(y|ies)|discuss\w*|disqus|respond|responses?)\b"),
    "notice": re.compile(r"\b(cookies?|consent|gdpr|notices?|alert|newsletter|subscribe|signup|modal|popup|paywall)\b"),
    "side": re.compile(r"\b(sidebar|side|aside|related|recommend\w*|share|sharing|social|widgets?|trending|popular|tags?)\b"),
    "foot": re.compile(r"\b(foot\w*|copyright|legal|imprint|colophon|masthead|head(er|ing)bar|topbar|site header)\b"),
    "content": re.compile(r"\b(content|article\w*|post|entry|main|story|text|body|prose)\b"),
}
_NAME_BIT = {n: 1 << (len(_ANCESTORS) + k) for k, n in enumerate(_NAMES)}
_BITS = len(_ANCESTORS) + len(_NAMES)
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_STOPS = re.compile(r"[.!?…。]")
FEATURES = _BITS + 12


@dataclass
class Block:
    text: str
    ancestors: int
    linked: int


def _named(attributes: str) -> int:
    names = " ".join(a or b or c for a, b, c in _ATTRIBUTE.findall(attributes)).lower()
    if not names:
        return 0
    names = re.sub(r"[-_]+", " ", names)
    return sum(_NAME_BIT[n] for n, p in _NAMES.items() if p.search(names))


def blocks(html: str | None) -> list[Block]:
    """The leaf blocks of a page with text, in page order."""
    html = html or ""
    out: list[Block] = []
    stack: list[tuple[str, int]] = [("", 0)]  # open elements with what they and their ancestors are
    held: dict[str, int] = {}  # how often each is open
    parts: list[str] = []
    linked = 0

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                out.append(Block(text, stack[-1][1], min(linked, len(text))))
            parts.clear()
        linked = 0

    def close(name: str) -> None:
        while stack[-1][0] != name:
            held[stack.pop()[0]] -= 1
        held[stack.pop()[0]] -= 1

    at = 0
    while at < len(html):
        found = _TOKEN.search(html, at)
        text = html[at : found.start() if found else len(html)]
        if text:
            text = unescape(text)  # each run of text by itself: a reference doesn't reach over a tag
            parts.append(text)
            if held.get("a"):
                linked += len(text.strip())
        if not found:
            break
        at = found.end()
        name = (found[2] or found[5] or "").lower()
        if not name:
            continue
        inline = name in _INLINE
        if not inline and name != "br":
            flush()
        elif name == "br":
            parts.append(" ")
        if found[1] or found[4]:
            if held.get(name):
                close(name)
            continue
        attributes = found[3] or found[6] or ""
        if name in _SILENT:
            if not attributes.endswith("/"):
                end = re.compile(rf"</{re.escape(name)}\b[^>]*>", re.I).search(html, at)
                at = end.end() if end else len(html)
            continue
        if name in _VOID:
            continue
        if not inline and held.get("p") and name not in ("br", "button"):
            close("p")
        if name in ("li", "option", "tr", "td", "th", "dt", "dd") and stack[-1][0] == name:
            close(name)
        bits = stack[-1][1] | _BIT.get(name, 0) | _named(attributes)
        stack.append((name, bits))
        held[name] = held.get(name, 0) + 1
    flush()
    return out


def features(page: list[Block]) -> np.ndarray:
    """blocks x FEATURES."""
    x = np.zeros((len(page), FEATURES))
    if not page:
        return x
    bits = np.array([b.ancestors for b in page], np.int64)
    x[:, :_BITS] = (bits[:, None] >> np.arange(_BITS)) & 1
    for k, b in enumerate(page):
        words, n = b.text.count(" ") + 1, len(b.text)
        x[k, _BITS : _BITS + 8] = (np.log1p(words), b.linked / n, len(_STOPS.findall(b.text)) > 0, b.text[-1] in ".!?…\"”»", "©" in b.text, min(words, 5) / 5, b.text[0].isupper(), words > 12)
    x[:, _BITS + 8] = np.linspace(0, 1, len(page))
    x[0, _BITS + 9] = x[-1, _BITS + 10] = 1
    x[:, _BITS + 11] = np.log1p(len(page))
    return x


def labelled_pages(count: int = 400, seed: int = 7) -> Iterator[tuple[str, list[int]]]:
    """Pages composed of common parts, with the label (1: main text) of each of their blocks."""
    rng = random.Random(seed)
    syllables = [c + v for c in "bdfgklmnprstvz" for v in "aeiou"]

    def word() -> str:
        return "".join(rng.choices(syllables, k=rng.randint(1, 4)))

    def sentence(least: int = 4, most: int = 18) -> str:
        s = " ".join(word() for _ in range(rng.randint(least, most))).capitalize()
        return (s.upper() if rng.random() < 0.05 else s) + rng.choice([".", ".", ".", "!", "?", ""])

    def paragraph() -> str:
        return " ".join(sentence() for _ in range(rng.choice([1, 1, 2, 3, 5, 9])))

    def links(tag: str = "li") -> tuple[str, list[int]]:
        n = rng.randint(2, 8)
        items = "".join(f'<{tag}><a href="/{word()}">{word().capitalize()}</a></{tag}>' for _ in range(n))
        return (f"<ul>{items}</ul>" if tag == "li" else items), [0] * n

    def boxed(tag: str, names: list[str], text: str) -> tuple[str, list[int]]:
        name = rng.choice(names)
        return f"<{tag}{f' class="{name}"' if name else ''}>{text}</{tag}>", [0]

    def story() -> tuple[str, list[int]]:
        html, labels = "", []
        if rng.random() < 0.85:
            html, labels = f"<h1>{sentence(3, 10)}</h1>", [1]
        for _ in range(rng.choice([1, 2, 3, 5, 8, 14])):
            kind = rng.random()
            if kind < 0.72:
                html += f"<p>{paragraph()}</p>"
            elif kind < 0.8:
                html += f"<p><b>{paragraph()}<br>"
            elif kind < 0.86:
                html += f"<{(h := rng.choice(['h2', 'h3']))}>{sentence(2, 7)}</{h}>"
            elif kind < 0.9:
                html += f"<blockquote>{paragraph()}</blockquote>"
            elif kind < 0.94:
                n = rng.randint(2, 5)
                html += "<ul>" + "".join(f"<li>{sentence()}</li>" for _ in range(n)) + "</ul>"
                labels += [1] * (n - 1)
            elif kind < 0.97:
                html += f'<p>{sentence()} <a href="/{word()}">{word()} {word()}</a> {sentence()}</p>'
            else:
                html += f"<pre>{paragraph()}</pre>"
            labels.append(1)
            if rng.random() < 0.06:
                part = boxed(rng.choice(["div", "aside"]), ["ad", "advert", "promo box", "related", "newsletter-signup"], sentence(4, 20))
                html, labels = html + part[0], labels + part[1]
        return html, labels

    for _ in range(count):
        bare = rng.random() < 0.1  # the story stands in the body itself
        parts: list[tuple[str, list[int]]] = [(f"<html><head><title>{sentence(3, 10)}</title></head><body>", [0]) if not bare or rng.random() < 0.5 else ("", [])]

        def maybe(p: float, part: Callable[[], tuple[str, list[int]]]) -> None:
            if rng.random() < p:
                parts.append(part())

        def wrapped(tag: str, name: str, inner: tuple[str, list[int]]) -> tuple[str, list[int]]:
            return f"<{tag}{f' class="{name}"' if name else ''}>{inner[0]}</{tag}>", inner[1]

        maybe(0.3, lambda: boxed("div", ["cookie-banner", "notice", "consent", "alert"], sentence(6, 25)))
        maybe(0.3, lambda: boxed("header", ["", "site-header", "masthead"], f"<p>{sentence(1, 6)}</p>"))
        maybe(0.75, lambda: wrapped(*rng.choice([("nav", ""), ("nav", "menu"), ("div", "menu"), ("div", "navbar")]), links(rng.choice(["li", "li", "div"]))))  # type: ignore[arg-type]
        maybe(0.5, lambda: boxed(rng.choice(["div", "div", "aside"]), ["ad", "ads", "advert", "sponsored", "banner"], paragraph()))
        maybe(0.3, lambda: wrapped("aside", rng.choice(["", "sidebar"]), links("p" if rng.random() < 0.3 else "li")))
        parts.append(story() if bare else wrapped(*rng.choice([("article", ""), ("article", ""), ("article", "post"), ("main", ""), ("div", "content"), ("div", "article-body"), ("div", "entry"), ("section", "")]), story()))  # type: ignore[arg-type]
        maybe(0.25, lambda: wrapped(*rng.choice([("section", "comments"), ("div", "comments"), ("div", "comment-list")]), ("".join(f'<div class="comment"><p>{paragraph()}</p></div>' for _ in range(3)), [0] * 3)))  # type: ignore[arg-type]
        maybe(0.2, lambda: (f"<form><p>{sentence(2, 8)}</p><label>{word()}</label><input><button>{word()}</button></form>", [0, 0, 0]))
        maybe(0.2, lambda: wrapped("div", rng.choice(["related", "sidebar", "share"]), links()))
        maybe(0.7, lambda: boxed("footer", ["", "footer", "site-footer"], f"&copy; {word()} &middot; {paragraph()}"))
        maybe(0.2, lambda: boxed("div", ["footer", "copyright", "legal"], sentence(3, 20)))
        yield "".join(h for h, _ in parts), [x for _, labels in parts for x in labels]


def train(pages: Iterable[tuple[str, list[int]]]) -> crf.Model:
    """The field from (html, label of each block); pages whose labels don't fit their blocks are an error."""
    xs, ys = [], []
    for html, labels in pages:
        page = blocks(html)
        if len(page) != len(labels):
            raise ValueError(f"{len(labels)} labels for {len(page)} blocks")
        xs.append(features(page))
        ys.append(labels)
    return crf.train(np.vstack(xs), np.concatenate(ys).astype(int), np.array([len(y) for y in ys]), steps=200)


@lru_cache(1)
def default_model() -> crf.Model:
    return train(labelled_pages())


def extract(model: crf.Model, pages: list[str | None]) -> list[str]:
    """The main text of each page."""
    cut = [blocks(p) for p in pages]
    lengths = np.array([len(c) for c in cut], int)
    if not lengths.sum():
        return [""] * len(pages)
    chosen = crf.viterbi(model, model.emissions(np.vstack([features(c) for c in cut])), lengths)
    out, at = [], 0
    for c in cut:
        out.append("\n".join(b.text for b, y in zip(c, chosen[at : at + len(c)]) if y))
        at += len(c)
    return out


def extract_pages(pages: DataFrame, model: crf.Model | None = None) -> DataFrame:
    """page_id, url, text, n_chars of every page, in one pass without shuffle."""
    fitted = model or default_model()

    def start() -> Callable[[dict[str, list]], Iterable[tuple]]:
        def work(batch: dict[str, list]) -> Iterator[tuple]:
            texts = extract(fitted, batch["html"])
            return zip(batch["page_id"], batch["url"], texts, map(len, texts))

        return work

    return over_batches(pages.select(F.col("page_id").cast("long"), "url", "html"), "page_id long, url string, text string, n_chars long", start)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's main text.  Null and empty pages give an empty text, repeated ids stay apart, an empty table gives no
    rows."""
    return extract_pages(table(spark, sf_dir, "pages"))
