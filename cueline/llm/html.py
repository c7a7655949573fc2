"""Main text of web pages by a linear-chain conditional random field over leaf blocks.

A page is cut into leaf blocks: runs of text between block-level tags, with the
tags (and the words of their ``class`` and ``id``) that stand open around them.
Ancestor and text features score each block as content or boilerplate, transition
weights score neighbouring labels, and Viterbi finds the best labelling of the
whole page. The field is trained on labelled pages (``labelled_pages``) that a
seeded generator composes of the usual parts of articles, menus, notices, forms
and comments; ``train`` takes any other labelled pages.

Defined results: null and empty pages, and pages of markup alone, give an empty
text. Character references are decoded once, white space inside a block becomes
one space, blocks are joined by one space in page order. Unclosed tags, stray
ends and a page cut off within a tag are read as far as they go. A head without
an end or a body after it ends at the first thing that cannot stand in a head.
Quotes open a value only directly after ``=``. Repeated rows are rows like any other; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import html
import random
import re
from collections import Counter
from collections.abc import Iterator, Sequence
from functools import cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cueline.llm.tables import read

#: Tags that end a run of text, tags whose contents are no text, and tags without an end.
BLOCKS = frozenset(
    "address article aside blockquote body br button caption center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hr html iframe legend li main menu nav ol option p pre section select summary table tbody td textarea "
    "tfoot th thead title tr ul".split()
)
SILENT = ("script", "style", "template", "noscript", "svg", "head", "textarea", "select", "iframe", "object", "math")
#: Silent tags that have no contents where they are self-closed.
_FOREIGN = ("svg", "math")
#: Tags that may stand in a head, and those of them whose contents do so too.
_IN_HEAD = frozenset("head title meta link base script style template noscript".split())
_HEAD_CONTENTS = ("title", "script", "style", "template", "noscript")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: An opening tag of these ends an open paragraph.
_ENDS_P = BLOCKS - {"br", "option"}
_SPACE = re.compile(r"\s+")
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attributes>(?:[^>=]+|=\s*(?:\"[^\"]*\"|'[^']*'|[^\s>]*))*)(?:>|\Z)|(?P<text>[^<]+|<)",
    re.DOTALL,
)
_ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.IGNORECASE)
_SPLIT = re.compile(r"[^a-z]+")


class Block(NamedTuple):
    text: str
    tag: str
    ancestors: tuple[str, ...]  # tags and ``.words`` of class, id and role
    linked: int  # code points inside links


def _contents_end(page: str, tag: str, at: int) -> int:
    """The place behind the end tag of the ``tag`` opened before ``at``, or the end of the page."""
    end = re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.IGNORECASE).search(page, at)
    return end.end() if end else len(page)


def _head_end(page: str, at: int, closes: bool) -> tuple[int, bool]:
    """The place where the head opened before ``at`` ends, and whether its end tag or a body says so.

    If neither follows (``closes`` false: this is known), it ends at the first
    tag or text that cannot stand in a head.
    """
    first = None
    while at < len(page) and (closes or first is None):
        token = _TOKEN.match(page, at)
        tag = (token["tag"] or "").lower()
        if tag == "head" and token["end"]:
            return token.end(), True
        if tag == "body" and not token["end"]:
            return at, True
        if first is None and (tag not in _IN_HEAD if tag else (token["text"] or "").strip()):
            first = at
        at = token.end()
        if tag in _HEAD_CONTENTS and not token["end"]:
            at = _contents_end(page, tag, at)
    return len(page) if first is None else first, False


class _Open(NamedTuple):
    """An open tag, the nearest block tag up to it, and the distinct words of all tags up to it."""

    tag: str
    block: str
    words: tuple[str, ...]
    known: frozenset[str]

    def inner(self, tag: str, words: list[str]) -> _Open:
        new = tuple(w for w in dict.fromkeys((tag, *words)) if w not in self.known)
        block = tag if tag in BLOCKS else self.block
        return _Open(tag, block, self.words + new, self.known.union(new)) if new else _Open(tag, block, self.words, self.known)


def blocks(page: str | None) -> list[Block]:
    """Leaf blocks of a page in order, without those that have no text.

    What a block needs of its ancestors is carried by the innermost open tag, so the
    time does not grow with the depth of the page.
    """
    found: list[Block] = []
    stack: list[_Open] = [_Open("", "", (), frozenset())]
    depth: Counter[str] = Counter()
    parts: list[str] = []
    linked, links, at, page = 0, 0, 0, page or ""
    head_closes = True

    def close() -> None:
        nonlocal parts, linked
        if parts:
            text = _SPACE.sub(" ", html.unescape("".join(parts))).strip()
            if text:
                found.append(Block(text, stack[-1].block, stack[-1].words, linked))
        parts, linked = [], 0

    def leave(tag: str) -> None:
        last = None
        while last != tag:
            last = stack.pop().tag
            depth[last] -= 1

    while at < len(page):
        token = _TOKEN.match(page, at)
        at = token.end()
        if (text := token["text"]) is not None:
            parts.append(text)
            linked += len(text) if links else 0
            continue
        if token["tag"] is None:
            continue
        tag = token["tag"].lower()
        if tag in BLOCKS:
            close()
        if token["end"]:
            if tag == "a":
                links = max(0, links - 1)
            if depth[tag]:
                leave(tag)
        elif tag == "head":
            at, head_closes = _head_end(page, at, head_closes)
        elif tag in SILENT and not (tag in _FOREIGN and token["attributes"].endswith("/")):
            close()
            at = _contents_end(page, tag, at)
        elif tag not in VOID and not token["attributes"].endswith("/"):
            if tag in _ENDS_P and depth["p"]:
                leave("p")
            if tag == "li" and stack[-1].tag == "li":
                leave("li")
            links += tag == "a"
            words = [w for m in _ATTRIBUTE.finditer(token["attributes"]) for w in _SPLIT.split((m[2] or m[3] or m[4] or "").lower()) if w] if token["attributes"] else []
            stack.append(stack[-1].inner(tag, [f".{w}" for w in words]))
            depth[tag] += 1
    close()
    return found


#: Words of class and id by the part that they usually name.
HINTS = {
    "menu": "nav navbar navigation menu breadcrumb breadcrumbs toc topbar masthead links pagination pager tabs",
    "header": "header banner branding logo hero site",
    "footer": "footer copyright legal colophon bottom credits",
    "side": "sidebar aside widget related recommended promo popular trending rail secondary complementary more",
    "notice": "cookie cookies consent notice alert popup modal newsletter subscribe gdpr overlay dialog paywall",
    "advert": "ad ads advert advertisement sponsor sponsored adsense commercial dfp",
    "share": "share social sharing follow tweet like author byline meta tags",
    "comment": "comment comments discussion reply replies respond disqus thread reader",
    "form": "form search login signup contact input field",
    "content": "article content post entry story body main text prose page document",
}
_HINT = {word: kind for kind, words in HINTS.items() for word in words.split()}
_STRUCTURE = frozenset("article main section nav header footer aside form figure figcaption ul ol table blockquote button label details dialog a".split())


def features(block: Block) -> list[str]:
    """Names of the features that hold for a block."""
    names = {"bias", f"tag={block.tag}"}
    for word in block.ancestors:
        if word[0] == ".":
            kind = _HINT.get(word[1:]) or _HINT.get(word[1:].rstrip("s"))
            if kind:
                names.add(f"named={kind}")
        elif word in _STRUCTURE:
            names.add(f"in={word}")
    words = block.text.count(" ") + 1
    names.add(f"words={min(int(np.log2(words)), 6)}")
    share = block.linked / max(1, len(block.text))
    names.add("links=none" if not block.linked else "links=few" if share < 0.34 else "links=most")
    names.add("ends=stop" if block.text[-1] in ".!?…\"”»" else "ends=open")
    if "©" in block.text or "all rights reserved" in block.text.lower():
        names.add("copyright")
    if "in=article" in names or "in=main" in names:
        names.add(f"inside tag={block.tag}")
    return sorted(names)


class Field(NamedTuple):
    """Weights of a field of two labels: 0 boilerplate, 1 content."""

    index: dict[str, int]
    weights: np.ndarray
    transitions: np.ndarray

    def scores(self, page: Sequence[Block]) -> np.ndarray:
        return np.array([self.weights[[self.index[f] for f in features(b) if f in self.index]].sum(axis=0) for b in page])


def viterbi(scores: np.ndarray, transitions: np.ndarray) -> list[int]:
    """The labelling of the best total score; the smaller label on ties."""
    best, back = scores[0], []
    for row in scores[1:]:
        paths = best[:, None] + transitions
        back.append(paths.argmax(axis=0))
        best = paths.max(axis=0) + row
    labels = [int(best.argmax())]
    for step in reversed(back):
        labels.append(int(step[labels[-1]]))
    return labels[::-1]


def train(pages: Sequence[tuple[Sequence[Block], Sequence[int]]], rounds: int = 150, rate: float = 0.1, decay: float = 1e-3) -> Field:
    """Maximum likelihood of the labels by gradient ascent over all pages at once."""
    named = [[features(b) for b in page] for page, _ in pages]
    index = {name: i for i, name in enumerate(sorted({f for page in named for b in page for f in b}))}
    longest = max(len(page) for page in named)
    n = len(pages)
    design = np.zeros((n, longest, len(index)), np.float32)
    truth, real = np.zeros((n, longest), int), np.zeros((n, longest), bool)
    for i, (page, (_, labels)) in enumerate(zip(named, pages)):
        for t, names in enumerate(page):
            design[i, t, [index[f] for f in names]] = 1
        truth[i, : len(page)], real[i, : len(page)] = labels, True
    one_hot = np.eye(2)[truth] * real[..., None]
    pairs = real[:, 1:, None, None] * one_hot[:, :-1, :, None] * one_hot[:, 1:, None, :]
    weights, transitions = np.zeros((len(index), 2)), np.zeros((2, 2))
    moments = [np.zeros_like(weights), np.zeros_like(weights), np.zeros_like(transitions), np.zeros_like(transitions)]
    for step in range(1, rounds + 1):
        scores = design @ weights
        marginal, joint = _marginals(scores, transitions, real)
        slopes = (
            np.tensordot(design, one_hot - marginal, ((0, 1), (0, 1))) / n - decay * weights,
            (pairs - joint).sum(axis=(0, 1)) / n - decay * transitions,
        )
        for k, (values, slope) in enumerate(zip((weights, transitions), slopes)):
            first, second = moments[2 * k], moments[2 * k + 1]
            first += 0.1 * (slope - first)
            second += 0.001 * (slope * slope - second)
            values += rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return Field(index, weights, transitions)


def _marginals(scores: np.ndarray, transitions: np.ndarray, real: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Label and label-pair probabilities of every block, by the forward-backward sums."""
    n, longest, _ = scores.shape
    ahead, behind = np.zeros_like(scores), np.zeros_like(scores)
    ahead[:, 0] = scores[:, 0]
    for t in range(1, longest):
        step = np.logaddexp.reduce(ahead[:, t - 1, :, None] + transitions, axis=1) + scores[:, t]
        ahead[:, t] = np.where(real[:, t, None], step, ahead[:, t - 1])
    for t in range(longest - 2, -1, -1):
        step = np.logaddexp.reduce(transitions + (scores[:, t + 1] + behind[:, t + 1])[:, None, :], axis=2)
        behind[:, t] = np.where(real[:, t + 1, None], step, behind[:, t])
    total = np.logaddexp.reduce(ahead[:, -1], axis=1)[:, None, None]
    marginal = np.exp(ahead + behind - total) * real[..., None]
    joint = np.exp(ahead[:, :-1, :, None] + transitions + (scores[:, 1:] + behind[:, 1:])[:, :, None, :] - total[..., None]) * real[:, 1:, None, None]
    return marginal, joint


_SYLLABLES = "an ber con de el fa gri ho in ka lo mer no or pa qui ra so te un va wer".split()


def labelled_pages(n: int, seed: int = 5) -> Iterator[tuple[str, list[str]]]:
    """Composed pages with the texts of their content blocks."""
    rng = random.Random(seed)

    def words(low: int, high: int) -> str:
        return " ".join("".join(rng.choices(_SYLLABLES, k=rng.randint(1, 4))) for _ in range(rng.randint(low, high)))

    def sentence(low: int = 3, high: int = 40) -> str:
        return words(low, high).capitalize() + rng.choice("...!?")

    def named(*options: str) -> str:
        return f'{rng.choice(("class", "id"))}="{rng.choice(options)}"'

    def links(count: int, tag: str = "li") -> str:
        return "".join(f'<{tag}><a href="/{i}">{words(1, 4)}</a></{tag}>' for i in range(count))

    def wrapped(text: str) -> str:
        return rng.choice((text, f"<p>{text}</p>", f"<p>{text}</p>", f"<div><p>{text}</p></div>"))

    def listed_comments() -> str:
        tag, body = rng.choice(("ol", "ul")), rng.choice(("comment-body", "comment-content", "text"))
        each = lambda: rng.choice((f"<p>{sentence(3, 45)}</p>", f'<b>{words(1, 2)}</b><div class="{body}"><p>{sentence(3, 45)}</p></div>', sentence(3, 45)))
        return f'<{tag} {named("comments", "comment-list", "replies", "discussion")}>' + "".join(f'<li class="{rng.choice(("comment", "comment even", "reply"))}">{each()}</li>' for _ in range(rng.randint(1, 4))) + f"</{tag}>"

    def junk(place: str) -> str:
        made = {
            "menu": lambda: rng.choice([f"<nav><ul>{links(rng.randint(2, 9))}</ul></nav>", f'<div {named("menu", "navbar", "breadcrumbs", "main-nav")}><ul>{links(rng.randint(2, 8))}</ul></div>']),
            "header": lambda: f'<header {named("site-header", "banner", "top")}><a href="/">{words(1, 3)}</a><p>{words(2, 8)}</p></header>',
            "footer": lambda: f'<footer>{wrapped(rng.choice(("&copy; ", "", "© 2024 ", "")) + words(1, 6) + rng.choice((" &middot; ", " ")) + sentence(2, 25))}</footer>',
            "side": lambda: f"<aside>{wrapped(sentence(2, 30))}</aside>" if rng.random() < 0.35 else rng.choice([f"<aside><h3>{words(1, 4)}</h3><p>{sentence(2, 25)}</p></aside>", f'<div {named("sidebar", "related-posts", "widget")}><h4>{words(1, 4)}</h4><ul>{links(rng.randint(2, 6))}</ul><p>{sentence()}</p></div>']),
            "notice": lambda: f'<div {named("cookie-notice", "consent", "newsletter", "popup", "alert notice", "newsletter-content", "subscribe box")}>{wrapped(sentence(3, 35))}{rng.choice((f"<button>{words(1, 2)}</button>", ""))}</div>',
            "advert": lambda: f'<div {named("ad", "ads", "advert", "sponsored", "ad-slot")}>{rng.choice((sentence(2, 15), f"<p>{sentence(2, 20)}</p>", f"<a href=x>{words(2, 9)}</a>"))}</div>',
            "share": lambda: f'<div {named("share", "social-links", "tags")}>{links(3, "span")}</div>',
            "form": lambda: f"<form>{wrapped(sentence(2, 15))}<input name=q></form>" if rng.random() < 0.4 else f'<form action="/s"><label>{words(1, 3)}</label><input name="q"><p>{sentence(2, 10)}</p><button>{words(1, 2)}</button></form>',
            "comment": lambda: listed_comments() if rng.random() < 0.4 else f'<{(tag := rng.choice(("section", "div")))} {named("comments", "comment-list", "discussion")}><h3>{words(1, 3)}</h3>' + "".join(f'<div class="comment"><b>{words(1, 2)}</b><p>{sentence(3, 45)}</p></div>' for _ in range(rng.randint(1, 4))) + f"</{tag}>",
        }
        return made[place]()

    for _ in range(n):
        wanted: list[str] = []

        def keep(text: str) -> str:
            wanted.append(text)
            return text

        def content() -> str:
            kind = rng.random()
            if kind < 0.06:
                return f"<section><h2>{keep(words(1, 9))}</h2><p>{keep(sentence())}</p></section>"
            if kind < 0.12:
                return f"<div>{keep(sentence())}</div>" if kind < 0.09 else f"<div><p>{keep(sentence())}</p></div>"
            if kind < 0.68:
                text = keep(" ".join(sentence(1, 30) for _ in range(rng.choice((1, 1, 1, 2, 4, 8)))))
                return f"<p>{text}</p>" if rng.random() < 0.85 else f"<p><b>{text}</b></p>"
            if kind < 0.76:
                return f"<h2>{keep(words(1, 9))}</h2>"
            if kind < 0.82:
                return f"<ul>{''.join(f'<li>{keep(words(1, 14))}</li>' for _ in range(rng.randint(1, 5)))}</ul>"
            if kind < 0.87:
                return f"<blockquote>{keep(sentence())}</blockquote>"
            if kind < 0.91:
                return f"<table><tr><td>{keep(words(1, 4))}</td><td>{keep(words(1, 4))}</td></tr></table>"
            if kind < 0.95:
                return f"<figure><img src=x><figcaption>{keep(sentence(2, 9))}</figcaption></figure>"
            return f'<p><a href="/x">{keep(words(2, 8))}</a></p>'

        before = "".join(junk(k) for k in rng.sample(["menu", "header", "notice", "advert", "form", "side"], rng.randint(0, 4)))
        middle, outer = [f"<h1>{keep(words(1, 10))}</h1>" if rng.random() < 0.85 else ""], rng.random()
        for _ in range(rng.choice((0, 1, 2, 4, 8, 14))):
            middle.append(content())
            if rng.random() < 0.3:
                middle.append(junk(rng.choice(["advert", "side", "share", "notice", "form", "comment", "menu", "footer", "header"])))
        opening, closing = ("<article>", "</article>") if outer < 0.6 else ("<main>", "</main>") if outer < 0.75 else (f'<div {named("content", "post-body", "article", "entry-content", "main")}>', "</div>")
        after = "".join(junk(k) for k in rng.sample(["comment", "side", "share", "advert", "form", "menu", "notice"], rng.randint(0, 3)))
        last = junk("footer") if rng.random() < 0.8 else ""
        yield f"<html><head><title>{words(2, 8)}</title></head><body>{before}{opening}{''.join(middle)}{closing}{after}{last}</body></html>", wanted


def labelled_blocks(page: str, wanted: Sequence[str]) -> tuple[list[Block], list[int]]:
    """Leaf blocks of a page, each with 1 if it is the next of the wanted texts."""
    found, labels, place = blocks(page), [], 0
    for block in found:
        hit = place < len(wanted) and block.text == _SPACE.sub(" ", html.unescape(wanted[place])).strip()
        labels.append(int(hit))
        place += hit
    return found, labels


#: Labelled pages that the default field is trained on.
TRAINING_PAGES = 400


@cache
def default_field() -> Field:
    pages = [labelled_blocks(page, wanted) for page, wanted in labelled_pages(TRAINING_PAGES)]
    return train([p for p in pages if p[0]])


def main_text(page: str | None, field: Field) -> str:
    found = blocks(page)
    if not found:
        return ""
    return " ".join(b.text for b, label in zip(found, viterbi(field.scores(found), field.transitions)) if label)


def extract(pages: DataFrame, field: Field | None = None) -> DataFrame:
    """``page_id, url, text, n_chars`` of every row of ``pages``."""
    field = field or default_field()
    given = pages.select("page_id", "url", "html")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.array([main_text(page, field) for page in batch.column("html").to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), texts], names=["page_id", "url", "text"])

    schema = given.select("page_id", "url").schema.add("text", "string")
    return given.mapInArrow(run, schema).withColumn("n_chars", F.length("text").cast("bigint"))


def op10_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(read(spark, sf_dir, "pages"))
