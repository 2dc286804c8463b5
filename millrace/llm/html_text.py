"""The main text of web pages by boosted trees over the elements of a page.

Each element is described by its subtree (text, tags, text per tag, links, punctuation), the
words in its attributes, its depth and place, its siblings, and what its ancestors are.
Boosted trees give the probability that it holds main text.  Decoding is hierarchical: an
element that is left out takes its whole subtree with it, and among all choices that obey
this the likeliest one is taken, so no element contradicts one above or below it.

The trees learn from a bounded sample of the pages.  Their examples come from pages whose
markup names its parts (article, nav, footer, names such as "comments" or "sidebar"), and from
altered copies of them: main parts under other names and with foreign blocks put inside, so
that the text and the siblings must speak where the markup is silent.

Cases: null, empty and plain texts are pages without elements (plain text is kept); broken
markup is read in one forward scan, a tag that never ends is text; very long pages are read whole; equal pages get equal
texts; an empty table gives no rows; other columns pass through, a column named like the
result is replaced.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import boosting, dom

# Tags and attribute words that name parts of a page.
MAIN_TAGS = frozenset({"article", "main"})
SIDE_TAGS = frozenset(
    "nav header footer aside form head title script style button select menu dialog label input fieldset".split()
)
SIDE_WORDS = frozenset(
    "ad ads advert advertisement adverts banner breadcrumb breadcrumbs comment comments consent cookie cookies "
    "disqus footer form gdpr header login masthead menu modal nav navbar navigation newsletter notice notices "
    "overlay pagination popup promo recommended related replies reply respond search share sharing shoutbox "
    "sidebar signup skip social sponsor sponsored subscribe tags toolbar widget alert warning".split()
)
MAIN_WORDS = frozenset("article body content entry main post story text page".split())
TEXT_TAGS = frozenset("p li h1 h2 h3 h4 h5 h6 blockquote pre td dd dt b i em strong span a".split())

GROUP = 64  # pages that one call of the trees judges

_NAME = re.compile(r"""\b(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
_WORD = re.compile(r"[a-z]+")
_MARKS = re.compile(r"[.,;:!?]")


def attribute_words(attrs: str) -> set[str]:
    return {w for value in _NAME.findall(attrs) for w in _WORD.findall(value.lower())} if attrs else set()


class Tree:
    """Measures of the elements of one page."""

    def __init__(self, page: dom.Page):
        n = len(page.tags)
        self.page, self.size = page, n
        words = [attribute_words(a) for a in page.attrs]
        self.side = np.array([t in SIDE_TAGS or bool(w & SIDE_WORDS) for t, w in zip(page.tags, words, strict=True)])
        self.main = np.array([t in MAIN_TAGS or bool(w & MAIN_WORDS) for t, w in zip(page.tags, words, strict=True)])
        own, marks, links = np.zeros(n), np.zeros(n), np.zeros(n)
        for piece in page.pieces:
            if piece is not None:
                own[piece[0]] += len(piece[1].strip())
                marks[piece[0]] += len(_MARKS.findall(piece[1]))
        tags = np.ones(n)
        text = own.copy()
        under_main, under_side, depth = np.zeros(n), np.zeros(n), np.zeros(n)
        in_link = np.zeros(n, bool)
        self.children: list[list[int]] = [[] for _ in range(n)]
        for i in range(1, n):
            p = page.parents[i]
            self.children[p].append(i)
            depth[i] = depth[p] + 1
            under_main[i] = under_main[p] + self.main[p]
            under_side[i] = under_side[p] + self.side[p]
            in_link[i] = in_link[p] or page.tags[i] == "a"
        links[in_link] = own[in_link]
        holds_main = self.main.astype(float)
        for i in range(n - 1, 0, -1):
            p = page.parents[i]
            for sums in (tags, text, marks, links, holds_main):
                sums[p] += sums[i]
        self.text, self.links = text, links
        self.under_main, self.under_side, self.holds_main = under_main, under_side, holds_main
        density = np.log1p(text / tags)
        place, peers, before, after = np.zeros(n), np.ones(n), np.zeros(n), np.zeros(n)
        for own_children in self.children:
            for k, i in enumerate(own_children):
                place[i], peers[i] = k / len(own_children), len(own_children)
                before[i] = density[own_children[k - 1]] if k else -1
                after[i] = density[own_children[k + 1]] if k + 1 < len(own_children) else -1
        parent = np.maximum(np.array(page.parents), 0)
        is_text = np.array([t in TEXT_TAGS for t in page.tags], float)
        self.features = np.column_stack(
            [
                np.log1p(text), np.log1p(tags), density, links / np.maximum(text, 1), marks / np.maximum(text, 1),
                depth, place, np.log1p(peers), before, after, text / np.maximum(text[parent], 1),
                text / max(text[0], 1), np.array([t in SIDE_TAGS for t in page.tags], float),
                np.array([len(w & SIDE_WORDS) for w in words], float), under_side > 0,
                np.array([t in MAIN_TAGS for t in page.tags], float),
                np.array([len(w & MAIN_WORDS) for w in words], float), under_main > 0, holds_main > 0,
                is_text, density[parent],
            ]
        ).astype(np.float32)

    def examples(self) -> np.ndarray:
        """1 for elements of the part that the markup names as main, and for those around it."""
        marked = np.array([t in MAIN_TAGS for t in self.page.tags])
        if not marked.any():
            marked = self.main & ~self.side & (self.under_side == 0)
        if not marked.any():  # nothing is named: go down while one child has most of the text
            at = 0
            while True:
                plain = [c for c in self.children[at] if not self.side[c]]
                total = sum(self.text[c] - self.links[c] for c in plain)
                heavy = [c for c in plain if self.text[c] - self.links[c] > 0.7 * total]
                if not heavy or self.page.tags[heavy[0]] in TEXT_TAGS:
                    break
                at = heavy[0]
            marked[at] = True
        label = np.zeros(self.size, bool)
        for i in range(1, self.size):
            label[i] = (label[self.page.parents[i]] or marked[i]) and not self.side[i]
        label[0] |= marked[0]
        for i in range(self.size - 1, 0, -1):
            label[self.page.parents[i]] |= label[i]
        return label

    def decode(self, p: np.ndarray) -> list[bool]:
        """The likeliest choice in which nothing below a left-out element is kept.

        A page without elements is plain text and kept.
        """
        keep, drop = np.log(np.clip(p, 1e-6, 1)), np.log(np.clip(1 - p, 1e-6, 1))
        out, best = drop.copy(), keep.copy()
        for i in range(self.size - 1, 0, -1):
            parent = self.page.parents[i]
            out[parent] += out[i]
            best[parent] += max(best[i], out[i])
        kept = [True] * self.size
        for i in range(1, self.size):
            kept[i] = kept[self.page.parents[i]] and bool(best[i] >= out[i])
        return kept


def altered(source: str, rng: random.Random, words: list[str]) -> str:
    """A copy with other names for the main part and foreign blocks inside and around it."""
    name = rng.choice(["content", "post", "entry", "story", "article-body", "main"])
    tag = rng.choice(["div", "section", "article"])
    source = re.sub(r"<article[^>]*>", f'<{tag} class="{name}">' if tag != "article" else "<article>", source)
    source = re.sub(r"</article>", f"</{tag}>", source)

    def said(n: int) -> str:
        return " ".join(rng.choice(words) for _ in range(n))

    blocks = [
        lambda: f'<div class="comments"><h3>{said(2)}</h3><p>{said(30)}.</p><p>{said(15)}.</p></div>',
        lambda: f'<section id="comments"><div class="comment"><p>{said(40)}.</p></div></section>',
        lambda: f"<aside><h2>{said(3)}</h2><p>{said(20)}</p></aside>",
        lambda: f'<div class="notice"><p>{said(12)}.</p></div>',
        lambda: f'<div class="ad">{said(9)}</div>',
        lambda: f"<form><label>{said(2)}</label><input><button>{said(1)}</button></form>",
        lambda: f'<ul class="related"><li><a href="#">{said(4)}</a></li><li><a href="#">{said(4)}</a></li></ul>',
        lambda: f'<div id="cookie-banner"><p>{said(18)}</p></div>',
    ]
    spots = [m.end() for m in re.finditer(r"</p>", source)] or [len(source)]
    for spot in sorted(rng.sample(spots, min(2, len(spots))), reverse=True):
        source = source[:spot] + rng.choice(blocks)() + source[spot:]
    body = re.search(r"<body[^>]*>", source)
    if body:
        top = f"<header><h2>{said(3)}</h2><p>{said(10)}</p></header>"
        source = source[: body.end()] + rng.choice([top, rng.choice(blocks)(), ""]) + source[body.end() :]
    return source


def fit_model(pages: DataFrame, html: str = "html", sample_pages: int = 150, page_chars: int = 100_000):
    """Trees learnt from ``sample_pages`` distinct pages of at most ``page_chars``; None if there are none.

    Both bound the sample, not the pages that are read afterwards.
    """
    short = pages.select(html).filter(F.length(html).between(1, page_chars))
    # The hashes alone are ranked first, so that tasks send the driver no pages but the sample's.
    hashed = short.select(html, F.xxhash64(html).alias("__hash"))
    # Each page counts once, however often it is repeated.
    ranks = hashed.select("__hash").distinct().orderBy("__hash").limit(sample_pages).collect()
    last = ranks[-1][0] if ranks else None
    rows = hashed.filter(F.col("__hash") <= F.lit(last)).dropDuplicates(["__hash"]).orderBy("__hash").collect()
    rng = random.Random(4)
    sources = [r[0] for r in rows]
    words = [w for s in sources[:40] for w in main_text(s, None).split()][:20_000]
    x, y = [], []
    for source in sources:
        for variant in (source, *(altered(source, rng, words or ["text"]) for _ in range(3))):
            tree = Tree(dom.read(variant))
            x.append(tree.features)
            y.append(tree.examples())
    if not x:
        return None
    features, labels = np.concatenate(x), np.concatenate(y).astype(float)
    return boosting.fit(features, labels)


def main_texts(sources: list[str | None], model) -> list[str]:
    """The main text of each page; the trees judge the elements of all pages together."""
    pages = [dom.read(s) for s in sources]
    if model is None:
        return [dom.text_of(p, [True] * len(p.tags)) for p in pages]
    trees = [Tree(p) for p in pages]
    judged = model.probability(np.concatenate([t.features for t in trees])) if trees else np.zeros(0)
    parts = np.split(judged, np.cumsum([t.size for t in trees])[:-1])
    return [dom.text_of(t.page, t.decode(p)) for t, p in zip(trees, parts, strict=False)]


def main_text(source: str | None, model) -> str:
    return main_texts([source], model)[0]


def extract(pages: DataFrame, model, html: str = "html", out: str = "text") -> DataFrame:
    """Add the main text of every page."""
    shared = pages.sparkSession.sparkContext.broadcast(model)  # some 20 kB, whatever the data

    @F.pandas_udf("string")
    def extracted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for sources in batches:
            pages = list(sources)
            yield pd.Series(
                [t for i in range(0, len(pages), GROUP) for t in main_texts(pages[i : i + GROUP], shared.value)],
                dtype="object",
            )

    return pages.withColumn(out, extracted(F.col(html)))
