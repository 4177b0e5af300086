"""Main text of web pages by a linear-chain conditional random field.

A page becomes a chain of leaf blocks: runs of text between block-level tags.  Features of a
block are the tags, roles and class words of its ancestors and the shape of its text (length, links,
ends of sentences, marks).  The field has weights for features by label and for pairs of
neighbouring labels; it is trained by gradient ascent on its log-likelihood and decoded by
Viterbi.  Blocks labelled as content, in page order, are the text.

Training pages are made here, with labels: layouts in common use, filled with pieces of text
from a bounded sample of the given pages (`sample_pages` of at most `sample_bytes` each), so that
the texts on both sides look alike and only structure tells them apart.

Defined cases: null, empty or text-free html gives an empty text; markup may be cut off or not closed; an
open comment, script or style runs to the end; text of formulas and drawings stands in its line, fallback text of
embedded objects and `noscript` is text like any other; ancestors count at any depth; repeated rows give equal
results; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import html as entities
import random
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hash60

SAMPLE_PAGES = 64
SAMPLE_BYTES = 1 << 16
TRAIN_PAGES = 400
EPOCHS = 120
SEED = 5

TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"""|<(?P<end>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*)(?P<rest>(?:[^>"']++|"[^"]*+"|'[^']*+')*+)>"""
    r"|<(?P<end2>/?)(?P<tag2>[a-zA-Z][a-zA-Z0-9:-]*)(?P<rest2>[^>]*)(?:>|\Z)",
    re.S,
)
ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|style)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
CLASS_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

# tags by how HTML lays them out
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike "
    "strong sub sup time tt u var wbr img svg math object canvas audio video".split()
)
#: What lies in these is no text of the page.
SILENT = frozenset("script style template iframe head title textarea select".split())
#: All elements below these stand in the line, until an element of the page follows.
FOREIGN = ("svg", "math")
#: These end an open paragraph.
ENDS_PARAGRAPH = frozenset(
    "address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split()
)
#: These end an open element of their own kind.
ENDS_ITSELF = frozenset("li dt dd tr td th option p".split())


#: Class words by which made pages carry the label of a part; no feature.
TRUTH = {"truthother": 0, "truthcontent": 1}
#: An element of made pages that stands for no element at all.
BARE = "truthbox"


class Block:
    """A leaf block: its text, the features of its ancestors, and how much of it is links."""

    __slots__ = ("text", "path", "linked", "truth")

    def __init__(self, text: str, path: tuple[str, ...], linked: int, truth: int):
        self.text, self.path, self.linked, self.truth = text, path, linked, truth


def _marks(tag: str, rest: str) -> str:
    """What the features keep of an element: tag and the words of class, id and role."""
    words = []
    for name, *values in ATTRIBUTE.findall(rest) if "=" in rest else ():
        value = next((v for v in values if v), "")
        name = name.lower()
        if name == "style":
            if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
                words.append("hidden")
        elif name != "hidden":
            words += [w.lower() for w in CLASS_WORD.findall(value)]
    if re.search(r"\bhidden\b", re.sub(r"""=\s*("[^"]*"|'[^']*'|\S+)""", "", rest)):
        words.append("hidden")
    return " ".join([tag, *words])


def blocks(page: str | None) -> list[Block]:
    """The leaf blocks of a page in order."""
    page = page or ""
    found: list[Block] = []
    # open elements: tag, marks, and the label and the innermost marks that hold inside
    stack: list[tuple[str, str, int, str]] = []
    is_open: Counter[str] = Counter()
    around: Counter[str] = Counter()  # marks of open elements, however deep: features tell a set
    silent = 0
    parts: list[str] = []
    linked = 0
    at = 0

    def close_block() -> None:
        nonlocal linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                truth, inner = stack[-1][2:] if stack else (-1, "")
                path = (*(m for m in around if m != inner), inner) if around else ()
                found.append(Block(text, path, linked, truth))
            parts.clear()
        linked = 0

    def pop(index: int) -> None:
        nonlocal silent
        for tag, marks, _, _ in stack[index:]:
            silent -= tag in SILENT
            is_open[tag] -= 1
            if tag not in INLINE and tag != BARE:
                around[marks] -= 1
                if not around[marks]:
                    del around[marks]
        del stack[index:]

    while True:
        m = TAG.search(page, at)
        raw = page[at : m.start() if m else len(page)]
        if raw and not silent:
            text = entities.unescape(raw) if "&" in raw else raw
            parts.append(text)
            if is_open["a"]:
                linked += len(text.strip())
        if not m:
            break
        at = m.end()
        tag = (m["tag"] or m["tag2"] or "").lower()
        if not tag:
            continue
        rest = m["rest"] or m["rest2"] or ""
        own = tag in ENDS_PARAGRAPH or tag in ENDS_ITSELF or tag == "body"
        foreign = not own and (is_open["svg"] > 0 or is_open["math"] > 0)
        if own and (is_open["svg"] or is_open["math"]):  # an element of the page ends a drawing or formula
            close_block()
            pop(next(k for k, e in enumerate(stack) if e[0] in FOREIGN))
        if tag not in INLINE and not foreign or tag == "br":
            close_block()
        if m["end"] or m["end2"]:
            if is_open[tag]:
                pop(next(k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == tag))
            continue
        if tag in VOID:
            continue
        if tag in ("script", "style", "textarea", "title"):  # raw text up to their own end
            end = re.compile(rf"</{tag}\b[^>]*>", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        if tag == "body" and silent:  # a head that was never closed
            pop(next(k for k, e in enumerate(stack) if e[0] in SILENT))
        if tag in ENDS_PARAGRAPH or tag in ENDS_ITSELF:
            for k in range(len(stack) - 1, -1, -1):
                open_tag = stack[k][0]
                if open_tag == tag and tag in ENDS_ITSELF or open_tag == "p" and tag in ENDS_PARAGRAPH:
                    pop(k)
                    break
                if open_tag not in INLINE:
                    break
        if foreign and tag not in SILENT and tag not in FOREIGN:
            continue  # its text goes on in the line
        if not rest.rstrip().endswith("/") or tag not in INLINE:
            marks = _marks(tag, rest) if rest else tag
            truth, inner = stack[-1][2:] if stack else (-1, "")
            truth = next((TRUTH[w] for w in marks.split() if w in TRUTH), truth)
            if tag not in INLINE and tag != BARE:
                around[marks] += 1
                inner = marks
            stack.append((tag, marks, truth, inner))
            silent += tag in SILENT
            is_open[tag] += 1
    close_block()
    return found


def _path_features(path: tuple[str, ...]) -> list[str]:
    out = set()
    for depth, marks in enumerate(reversed(path)):
        tag, *words = marks.split()
        out.add(f"a:{tag}")
        if depth == 0:
            out.add(f"p:{tag}")
        for w in words:
            if w not in TRUTH:
                out.add(f"c:{w}")
    return sorted(out)


def _text_features(b: Block, k: int, n: int) -> list[str]:
    chars, words = len(b.text), b.text.count(" ") + 1
    return [
        "bias",
        f"len:{min(10, chars.bit_length())}",
        f"link:{min(4, 4 * b.linked // max(1, chars))}",
        f"end:{b.text[-1] in '.!?…:;。！？”»'}",
        f"stops:{min(3, len(re.findall(r'[.!?] ', b.text)))}",
        f"marks:{'©' in b.text or '|' in b.text or '»' in b.text}",
        f"words:{min(3, words // 4)}",
        f"first:{k == 0}",
        f"last:{k == n - 1}",
    ]


class Field:
    """Weights by feature and label, and of neighbouring labels."""

    def __init__(self) -> None:
        self.ids: dict[str, int] = {}
        self.weights = np.zeros((0, 2))
        self.pairs = np.zeros((2, 2))
        self.paths: dict[tuple[str, ...], np.ndarray] = {}

    def _emission(self, path: tuple[str, ...]) -> np.ndarray:
        known = self.paths.get(path)
        if known is None:
            ids = [self.ids[f] for f in _path_features(path) if f in self.ids]
            known = self.weights[ids].sum(axis=0) if ids else np.zeros(2)
            if len(self.paths) > 50_000:
                self.paths.clear()
            self.paths[path] = known
        return known

    def label(self, chain: list[Block]) -> list[int]:
        """Viterbi: the most likely labels."""
        n = len(chain)
        if not n:
            return []
        (s00, s01), (s10, s11) = self.pairs.tolist()
        back: list[tuple[int, int]] = []
        best0 = best1 = 0.0
        for k, b in enumerate(chain):
            e0, e1 = self._emission(b.path).tolist()
            for f in _text_features(b, k, n):
                i = self.ids.get(f)
                if i is not None:
                    e0 += self.weights[i, 0]
                    e1 += self.weights[i, 1]
            if k:
                to0, to1 = best1 + s10 > best0 + s00, best1 + s11 > best0 + s01
                back.append((int(to0), int(to1)))
                best0, best1 = (best1 + s10 if to0 else best0 + s00) + e0, (best1 + s11 if to1 else best0 + s01) + e1
            else:
                best0, best1 = e0, e1
        labels = [int(best1 > best0)]
        for step in reversed(back):
            labels.append(step[labels[-1]])
        return labels[::-1]

    def train(self, chains: list[list[Block]], epochs: int = EPOCHS, rate: float = 0.1, l2: float = 1e-3) -> None:
        """Maximise the log-likelihood of the chains, all at once, by Adam."""
        chains = [c for c in chains if c]
        rows, owner = [], []
        longest = max(map(len, chains))
        truth = np.full((len(chains), longest), -1)
        for p, chain in enumerate(chains):
            for k, b in enumerate(chain):
                truth[p, k] = b.truth
                for f in _path_features(b.path) + _text_features(b, k, len(chain)):
                    rows.append(self.ids.setdefault(f, len(self.ids)))
                    owner.append(p * longest + k)
        feature, owner = np.array(rows), np.array(owner)
        inside = truth >= 0
        gold = np.zeros((len(chains), longest, 2))
        gold[inside, truth[inside]] = 1
        follows = inside[:, 1:]
        gold_pairs = np.einsum("pki,pkj->ij", gold[:, :-1], gold[:, 1:] * follows[..., None])
        theta = np.zeros(2 * len(self.ids) + 4)
        m, v = np.zeros_like(theta), np.zeros_like(theta)
        for epoch in range(1, epochs + 1):
            w, s = theta[:-4].reshape(-1, 2), theta[-4:].reshape(2, 2)
            e = np.zeros((len(chains) * longest, 2))
            np.add.at(e, owner, w[feature])
            e = e.reshape(len(chains), longest, 2)
            ahead, back = np.zeros_like(e), np.zeros_like(e)
            ahead[:, 0] = e[:, 0]
            for k in range(1, longest):
                step = np.logaddexp.reduce(ahead[:, k - 1, :, None] + s, axis=1) + e[:, k]
                ahead[:, k] = np.where(inside[:, k, None], step, ahead[:, k - 1])
            for k in range(longest - 2, -1, -1):
                step = np.logaddexp.reduce(s + (e[:, k + 1] + back[:, k + 1])[:, None, :], axis=2)
                back[:, k] = np.where(inside[:, k + 1, None], step, 0)
            z = np.logaddexp.reduce(ahead[:, -1], axis=1)
            node = np.exp(ahead + back - z[:, None, None]) * inside[..., None]
            link = ahead[:, :-1, :, None] + s + (e[:, 1:] + back[:, 1:])[:, :, None, :] - z[:, None, None, None]
            expected = (np.exp(np.minimum(link, 0)) * follows[..., None, None]).sum(axis=(0, 1))
            slope = np.zeros_like(theta)
            miss = (gold - node).reshape(-1, 2)
            np.add.at(slope[:-4].reshape(-1, 2), feature, miss[owner])
            slope[-4:] = (gold_pairs - expected).ravel()
            slope = slope / len(chains) - l2 * theta
            m, v = 0.9 * m + 0.1 * slope, 0.999 * v + 0.001 * slope**2
            theta += rate * (m / (1 - 0.9**epoch)) / (np.sqrt(v / (1 - 0.999**epoch)) + 1e-8)
        self.weights, self.pairs = theta[:-4].reshape(-1, 2), theta[-4:].reshape(2, 2)
        self.paths.clear()


# layouts: elements and class words in common use
CONTENT_BOX = [
    "article", "main", "div class='content'", "div id='content'", "div class='post-content'", "div class='entry'", "section class='story'",
    "div class='article-body'", "div class='page-content'", "div id='main'", "div class='text'", "div class='post'", "div class='blog-post'",
]
MENU_BOX = ["nav", "ul class='menu'", "div class='navbar'", "div id='nav'", "div class='breadcrumbs'", "div role='navigation'", "nav class='toc'", "div class='pagination'"]
HEADER_BOX = ["header", "div class='header'", "div id='header'", "div class='site-header masthead'", "div class='top-bar'", "div class='logo'", "header role='banner'"]
FOOTER_BOX = ["footer", "div class='footer'", "div id='footer'", "div class='site-footer'", "div class='copyright'", "footer role='contentinfo'", "div class='legal'"]
SIDE_BOX = ["aside", "div class='sidebar'", "div id='sidebar'", "div class='widget'", "div class='related'", "section class='related-posts'", "div class='rail'", "div class='recommended'", "div role='complementary'", "div class='trending popular'"]
NOTICE_BOX = ["div class='cookie-banner'", "div class='cookie consent'", "div class='notice'", "div class='alert'", "div class='newsletter'", "div class='modal popup'", "div id='banner'", "div class='subscribe'", "div role='alert'", "div class='gdpr'", "div class='paywall'", "p class='disclaimer'", "div role='dialog'", "div class='message'", "div class='overlay'", "div hidden"]
AD_BOX = ["div class='ad'", "div class='ads'", "div class='advert'", "div class='advertisement'", "div class='sponsored'", "div class='promo'", "div id='ad'", "ins class='adsbygoogle'", "aside class='ad'", "section class='promotion'", "div class='ad-slot banner'"]
COMMENT_BOX = ["div class='comments'", "section id='comments'", "div class='comment'", "ol class='comment-list'", "div id='disqus'", "section class='reader-comments'", "div class='responses replies'", "div class='discussion'", "ul class='comments'"]
SOCIAL_BOX = ["div class='share'", "div class='social'", "ul class='sharing buttons'", "div class='tags meta'", "div class='byline author'"]


def _open_close(box: str) -> tuple[str, str]:
    return f"<{box}>", f"</{box.split()[0]}>"


class Maker:
    """Labelled pages; a piece of text carries its label in a class word that is no feature."""

    def __init__(self, pieces: list[str], seed: int = SEED):
        self.rng = random.Random(seed)
        self.pieces = pieces

    def _words(self, low: int, high: int) -> str:
        words = self.rng.choice(self.pieces).split()
        n = self.rng.randint(low, high)
        at = self.rng.randrange(max(1, len(words) - n + 1))
        return entities.escape(" ".join(words[at : at + n]), quote=False)

    def _mark(self, box: str, label: int) -> tuple[str, str]:
        tag, _, rest = box.partition(" ")
        word = next(w for w, y in TRUTH.items() if y == label)
        if "class='" in rest:
            rest = rest.replace("class='", f"class='{word} ", 1)
        else:
            rest = f"{rest} class='{word}'".strip()
        return f"<{tag} {rest}>", f"</{tag}>"

    def _prose(self, box: str, label: int, count: int, *, headings: bool = True) -> str:
        rng = self.rng
        start, end = self._mark(box, label)
        out = [start]
        if headings and rng.random() < 0.7:
            out.append(f"<h1>{self._words(1, 12)}</h1>")
        for _ in range(count):
            kind = rng.random()
            text = self._words(1, 4) if rng.random() < 0.15 else self._words(8, 120)
            if kind < 0.7:
                out.append(f"<p>{text}</p>")
            elif kind < 0.76:
                out.append(f"<p><b>{text}<br><p>{self._words(5, 60)}</p>")
            elif kind < 0.82:
                out.append(f"<h{rng.randint(2, 4)}>{self._words(1, 8)}</h{2}>")
            elif kind < 0.88:
                out.append("<ul>" + "".join(f"<li>{self._words(2, 20)}</li>" for _ in range(rng.randint(2, 5))) + "</ul>")
            elif kind < 0.92:
                out.append(f"<blockquote>{text}</blockquote>")
            elif kind < 0.95:
                out.append(f"<figure><figcaption>{self._words(3, 15)}</figcaption></figure>")
            elif kind < 0.98:
                out.append(f"<table><tr><td>{self._words(1, 5)}</td><td>{self._words(1, 5)}</td></tr></table>")
            else:
                out.append(f"<p>{self._words(3, 20)} <a href='#'>{self._words(1, 4)}</a> {self._words(3, 20)}</p>")
        out.append(end)
        return "".join(out)

    def _links(self, box: str) -> str:
        start, end = self._mark(box, 0)
        items = "".join(f"<li><a href='#'>{self._words(1, 3)}</a></li>" for _ in range(self.rng.randint(2, 8)))
        return f"{start}{items if box.startswith('ul') else f'<ul>{items}</ul>'}{end}"

    def _stuff(self, boxes: list[str]) -> str:
        rng, box = self.rng, self.rng.choice(boxes)
        start, end = self._mark(box, 0)
        kind = rng.random()
        if kind < 0.3:
            return self._links(box)
        if kind < 0.5:
            return f"{start}{self._words(2, 30)}{end}"
        if kind < 0.6:
            return f"{start}<h3>{self._words(1, 4)}</h3><p>{self._words(5, 60)}</p>{end}"
        return f"{start}{''.join(f'<p>{self._words(3, 60)}</p>' for _ in range(rng.randint(1, 4)))}{end}"

    def _form(self) -> str:
        box, mark = self._mark("form", 0)
        return f"{box}<label>{self._words(1, 3)}</label><input name='q'><button>{self._words(1, 2)}</button><p>{self._words(2, 25)}</p>{mark}"

    def _footer(self) -> str:
        start, end = self._mark(self.rng.choice(FOOTER_BOX), 0)
        return f"{start}{self.rng.choice(['&copy; ', '', '© 2024 '])}{self._words(2, 15)}{self.rng.choice([' &middot; ', ' | ', ' '])}{self._words(1, 10)}{end}"

    def page(self) -> str:
        rng = self.rng
        often = lambda p: rng.random() < p
        body: list[str] = []
        if often(0.5):
            start, end = self._mark(rng.choice(HEADER_BOX), 0)
            body.append(f"{start}<a href='/'>{self._words(1, 3)}</a><p>{self._words(1, 12)}</p>{end}")
        if often(0.85):
            body.append(self._links(rng.choice(MENU_BOX)))
        for boxes, p in ((NOTICE_BOX, 0.4), (AD_BOX, 0.5), (SIDE_BOX, 0.25)):
            if often(p):
                body.append(self._stuff(boxes))
        if often(0.25):
            body.append(self._form())
        main = rng.choice(CONTENT_BOX) if often(0.85) else rng.choice(["div", BARE])
        inner = [self._prose(main, 1, rng.randint(1, 6))]
        while often(0.4):
            # something foreign inside the article, and the article goes on after it
            middle = self._form() if often(0.15) else self._stuff(rng.choice([AD_BOX, NOTICE_BOX, SOCIAL_BOX, SIDE_BOX, COMMENT_BOX]))
            inner.append(middle)
            if often(0.6):
                inner.append(self._prose("div" if often(0.5) else "section", 1, rng.randint(1, 4), headings=False))
        first = inner[0]
        cut = first.rindex("</")
        body.append(first[:cut] + "".join(inner[1:]) + first[cut:] if often(0.7) else "".join(inner[:1]) + "".join(inner[1:2]))
        for boxes, p in ((COMMENT_BOX, 0.4), (SIDE_BOX, 0.4), (AD_BOX, 0.25), (NOTICE_BOX, 0.2)):
            if often(p):
                body.append(self._stuff(boxes))
        if often(0.2):
            body.append(self._form())
        if often(0.85):
            body.append(self._footer())
        wrapped = "".join(body)
        if often(0.4):
            box, end = _open_close(rng.choice(["div class='wrapper'", "div id='page'", "div class='container'", "div class='site'"]))
            wrapped = f"{box}{wrapped}{end}"
        page = f"<html><head><title>{self._words(1, 8)}</title></head><body>{wrapped}"
        return page if often(0.1) else page + "</body></html>"


def train_field(pieces: list[str], *, train_pages: int = TRAIN_PAGES, epochs: int = EPOCHS, seed: int = SEED) -> Field:
    """A field trained on `train_pages` made pages, filled with the given pieces of text."""
    maker = Maker(pieces, seed)
    chains = [[b for b in blocks(maker.page()) if b.truth >= 0] for _ in range(train_pages)]
    field = Field()
    field.train(chains, epochs)
    return field


def sample_pieces(pages: DataFrame, sample_pages: int = SAMPLE_PAGES, sample_bytes: int = SAMPLE_BYTES) -> list[str]:
    """Texts of the blocks of a bounded sample of pages."""
    few = pages.where((F.octet_length("html") > 0) & (F.octet_length("html") <= sample_bytes))
    hashed = few.select("html", hash60(F.col("page_id"), F.col("html")).alias("h"))
    # 64 numbers first, then their pages: no sort of whole pages, and no more than the sample comes to the driver
    keys = sorted({r["h"] for r in hashed.select("h").distinct().orderBy("h").limit(sample_pages).collect()})
    chosen = hashed.where(F.col("h").isin(keys)).groupBy("h").agg(F.min("html").alias("html")).collect()
    return [b.text for r in sorted(chosen) for b in blocks(r["html"])]


def extract(pages: DataFrame, **options) -> DataFrame:
    """(page_id, url, html) -> page_id, url, text, n_chars."""
    pieces = sample_pieces(pages)
    field = train_field(pieces or ["A sentence of a page."], **options)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            texts = []
            for page in batch:
                chain = blocks(page)
                texts.append(" ".join(b.text for b, y in zip(chain, field.label(chain), strict=True) if y))
            yield pd.Series(texts)

    made = pages.select("page_id", "url", F.pandas_udf(run, "string")("html").alias("text"))
    return made.withColumn("n_chars", F.char_length("text").cast("long"))
