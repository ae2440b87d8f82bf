"""Main text of web pages by tag-path ratios.

A page becomes a sequence of text nodes, each with its root-to-leaf tag path (tags with class, id and role names).
Per path: text length and punctuation per node.  Both ratios are smoothed along the page, fused into one score, and
paths above the page's threshold are content.  What HTML or a name says of a section is a prior in the score: nav, footer,
aside, forms, or class words such as ad or comments weigh ASIDE_WEIGHT, the more so the more of the name they are (all of
"ad-box", half of "share-price"); an <article> or <main> around weighs SCOPE_WEIGHT.  Scripts, styles and the like hold no text.

Null or empty html, and html without text, gives an empty text; an empty table an empty result.  Unclosed and stray tags
are repaired as browsers do: a block start closes an open paragraph, an end tag without a start is ignored, end of input
closes all; an attribute's quote that is never closed ends with the tag.  Scanning is linear in the page, however deeply it
is nested.  Repeated rows and ids are extracted each, nulls stay null in page_id and url, and other columns are ignored.
"""

from __future__ import annotations

import html as entities
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Elements without an end tag, per the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is raw text.
RAW = frozenset("script style textarea title noscript template iframe svg xmp noembed noframes".split())
#: Elements that start a block and close an open <p>.
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
#: Elements that are seldom the article.
ASIDE = frozenset("nav footer aside form header head button select option label input dialog menu".split())
#: Class, id or role words of sections that are seldom the article.
NOISE = frozenset(
    "ad ads adv advert advertisement advertising banner breadcrumb breadcrumbs comment comments comentarios commentaires kommentare cookie cookies consent disclaimer footer form header login menu modal nav navbar navigation newsletter notice notices notification pagination pager popup promo promotion related reply replies respond share sharing sidebar signup skip social sponsor sponsored subscribe toolbar widget contentinfo complementary search".split()
)
#: Words that only say what shape or place a section has; they don't soften a name.
SHAPE = frozenset("area bar block bottom box btn button buttons col column container content custom default div first footer grid group header inner item items last left link links list main module outer panel post row right section small text title top view wrap wrapper".split())
#: Pairs (new tag, open tag that it closes) of sibling elements.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = ("article", "main")
SMOOTH = 2
SIGMAS = 0.5
#: Priors of a path in the fused score: inside a scope, and inside a section named as something else.
SCOPE_WEIGHT = 2
ASIDE_WEIGHT = 0.002

_ATTRIBUTES = re.compile(r"(?:[^<>\"']|\"[^\"]*\"|'[^']*')*+>")
_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_NAMED = re.compile(r"(?:^|\s)(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_WORD = re.compile(r"[a-z0-9]+")
#: Tags that only mark words of a text; their text has the path of the block around.
INLINE = frozenset("b i em strong u s small sub sup mark code span font abbr cite q time tt var kbd samp del ins".split())
_SPACE = re.compile(r"\s+")
_PUNCT = ".,;:!?…。，！？"


def prior_of(tag: str, names: str, scope: bool) -> float:
    """How far an element's own tag and names speak for content: 1, or less the more of its words name something else."""
    if tag in ASIDE and not (scope and tag == "header"):
        return ASIDE_WEIGHT
    least = 1.0
    for name in names.split():
        words = [w for w in _WORD.findall(name) if w not in SHAPE or w in NOISE]
        if share := sum(w in NOISE for w in words) / max(1, len(words)):
            least = min(least, ASIDE_WEIGHT if share == 1 else ASIDE_WEIGHT**share)
    return least


class _Page:
    """Text nodes in page order (path number, block, text); paths is a tree (parent, prior, in a scope) of tag-path steps."""

    def __init__(self, page: str):
        self.paths: list[tuple[int, float, bool]] = [(-1, 1.0, False)]
        self.nodes: list[tuple[int, int, str]] = []
        self.steps: dict[tuple, int] = {}
        self.stack: list[tuple[str, int]] = []
        self.open: dict[str, list[int]] = {}  # where in the stack a tag is open
        self.block = 0
        self.read(page)

    def text(self, piece: str) -> None:
        if piece and (self.nodes or piece.strip()):
            self.nodes.append((self.stack[-1][1] if self.stack else 0, self.block, entities.unescape(piece)))

    def close(self, k: int) -> None:
        while len(self.stack) > k:
            tag, _ = self.stack.pop()
            self.open[tag].pop()
            self.block += tag in BLOCK

    def innermost(self, tags, stops=()) -> int:
        last = lambda names: max((self.open[t][-1] for t in names if self.open.get(t)), default=-1)
        k = last(tags)
        return k if k > last(stops) else -1

    def start(self, tag: str, attributes: str) -> str | None:
        """Open an element; the tag if its content is raw text."""
        if tag in BLOCK and (k := self.innermost(("p",), ("td", "th", "button"))) >= 0:
            self.close(k)
        if tag in CLOSES and (k := self.innermost(CLOSES[tag], ("ul", "ol", "dl", "table", "select"))) >= 0:
            self.close(k)
        self.block += tag in BLOCK
        if tag in VOID:
            if tag in ("br", "hr", "img"):
                self.text(" ")
            return None
        if tag in RAW:
            return None if attributes.endswith("/") else tag
        names = " ".join(a or b or c for a, b, c in _NAMED.findall(attributes)).lower() if attributes else ""
        above = self.stack[-1][1] if self.stack else 0
        _, prior, scope = self.paths[above]
        own = prior_of(tag, names, scope)
        if tag in INLINE and own == 1:
            path = above
        else:
            path = self.steps.setdefault((above, tag, names), len(self.paths))
            if path == len(self.paths):
                self.paths.append((above, min(prior, own), scope or tag in SCOPES))
        self.open.setdefault(tag, []).append(len(self.stack))
        self.stack.append((tag, path))
        return None

    def read(self, page: str) -> None:
        at, end, pending = 0, len(page), 0  # pending: where the text begins that is not taken yet
        while (lt := page.find("<", at)) >= 0:
            at, name = lt + 1, page[lt + 1 : lt + 2]
            if not (name.isascii() and name.isalpha()) and name not in ("!", "?", "/"):
                continue  # a bare < is text
            self.text(page[pending:lt])
            if page.startswith("<!--", lt):
                close = page.find("-->", lt + 4)
                at = pending = close + 3 if close >= 0 else end
                continue
            tag = _NAME.match(page, lt + 1 + (name == "/")) if name not in ("!", "?") else None
            rest = _ATTRIBUTES.match(page, tag.end()) if tag else None
            gt = rest.end() - 1 if rest else page.find(">", lt)  # a quote that isn't closed ends with the tag
            if gt < 0:
                return  # the page ends inside a tag
            at = pending = gt + 1
            if not tag:
                continue
            if name == "/":
                if (k := self.innermost((tag[0].lower(),))) >= 0:
                    self.close(k)
                elif tag[0].lower() in BLOCK:
                    self.block += 1
            elif raw := self.start(tag[0].lower(), page[tag.end() : gt]):
                found = re.compile(rf"</{raw}(?=[\s/>])[^>]*>", re.I).search(page, at)  # re keeps compiled patterns
                if not found:
                    return
                at = pending = found.end()
        self.text(page[pending:])


def smooth(x: np.ndarray, radius: int = SMOOTH) -> np.ndarray:
    """Gaussian mean along the page, with the kernel cut and renormed at its ends."""
    if len(x) < 2:
        return x
    kernel = np.exp(-0.5 * (np.arange(-radius, radius + 1) / max(1, radius / 2)) ** 2)
    same = lambda v: np.convolve(v, kernel)[radius : radius + len(v)]
    return same(x) / same(np.ones(len(x)))


def path_scores(page: _Page) -> tuple[np.ndarray, np.ndarray, float]:
    """Path of each text node, the fused score of each path, and the page's threshold."""
    path = np.array([p for p, _, _ in page.nodes])
    size = np.array([len(t.strip()) for _, _, t in page.nodes], float)
    marks = np.array([sum(map(t.count, _PUNCT)) for _, _, t in page.nodes], float)
    prior = np.array([p for _, p, _ in page.paths])
    scope = np.array([s for _, _, s in page.paths])
    own = np.flatnonzero(size > 0)
    if not len(own):
        return path, np.zeros(len(page.paths)), 1.0
    # Nodes smooth each other among their like: those named as something else don't dim the article's edges.
    fused = np.zeros(len(path))
    for part in (own[prior[path[own]] == 1], own[prior[path[own]] < 1]):
        if len(part):
            at, n = path[part], len(page.paths)
            count = np.maximum(np.bincount(at, minlength=n), 1)
            length, mark = np.bincount(at, size[part], n) / count, np.bincount(at, marks[part], n) / count
            fused[part] = smooth(length[at]) * (1 + smooth(mark[at]))
    count = np.maximum(np.bincount(path[own], minlength=len(prior)), 1)
    plain = np.bincount(path[own], fused[own], len(prior)) / count
    seen = np.unique(path[own])
    weighed = plain[seen] * prior[seen]
    named = seen[prior[seen] == 1] if (prior[seen] == 1).any() else seen
    threshold = min(weighed.max() * 0.5, SIGMAS * plain[named].std())
    return path, plain * prior * np.where(scope, SCOPE_WEIGHT, 1), max(threshold, 2 * ASIDE_WEIGHT * plain.max())


def content_mask(page: _Page) -> np.ndarray:
    """Which text nodes belong to the article; blanks part the words of a block."""
    path, score, threshold = path_scores(page)
    blank = np.array([not t.strip() for _, _, t in page.nodes])
    return (score[path] >= threshold) | (blank & (np.array([p for _, p, _ in page.paths])[path] == 1))


def main_text(page: str | None) -> str:
    read = _Page(page or "")
    if not read.nodes:
        return ""
    blocks: dict[int, list[str]] = {}
    for (_, block, text), chosen in zip(read.nodes, content_mask(read), strict=True):
        if chosen:
            blocks.setdefault(block, []).append(text)
    lines = (_SPACE.sub(" ", "".join(b)).strip() for b in blocks.values())
    return "\n".join(x for x in lines if x)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars, a row per page."""

    def run(batches):
        for batch in batches:
            texts = [main_text(x) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.selectExpr("cast(page_id as bigint) page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
