"""HTML extraction: the main text of a page from its flat text blocks, by a small decision tree.

A page is read from left to right into blocks: runs of text between block-level tags.  A block is described by its word
count and the share of its words inside links, by those of its neighbours, by the longest block two places around, by
whether it is a heading, and by its zone: what the tags, classes and ids of the elements around it say (inside an article,
beside it, or nothing).  Neighbours are looked at as far as the zone reaches.  A decision tree over these numbers says which
blocks are main text.  It is grown from a small labelled table: the blocks of the sketches in blocks_labelled.py, as they are, with all zones blank, so
that words and links alone must tell as much as they can, and with all in one zone.

Scripts, styles, comments and markup never are text.  Character references are decoded, white space in a block becomes
one space, and kept blocks are joined by one line feed.  Unclosed and stray tags are tolerated; an element that is closed
closes all that are open inside it.  Pages of any length take time in proportion to it, whatever is left open.  A null or
empty page gives an empty text.  Every input row gives one row, repeated rows too; columns other than page_id, url and
html aren't read.  An empty table gives an empty result.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from sheaf.llm.blocks_labelled import SKETCHES
from sheaf.llm.words import map_texts

BLOCK = set(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
#: Elements whose content isn't markup, and those of them that hold text of another kind where they are left open.
RAW = set("script style noscript template iframe textarea select title foreignobject".split())
OPEN_RAW = set("script style textarea".split())
_NAME = re.compile(r"(/?)([a-z][^\s/>]*)", re.I)
_QUOTED = re.compile(r"""(?:[^>"']++|"[^"]*+"|'[^']*+')*+>""")
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
ASIDE = set("nav footer aside form header menu dialog button fieldset search".split())
LOOSE = set("form fieldset".split())
ASIDE_WORDS = set(
    "ad ads adv advert adverts advertisement banner breadcrumb breadcrumbs captcha comment comments consent cookie cookies copyright disclaimer discussion "
    "disqus footer form gdpr header hidden login masthead menu modal nav navbar navigation newsletter notice notices pager pagination popup promo promoted "
    "related reply replies search share sharing sidebar signup skip social sponsor sponsored subscribe subscription tags toc toolbar topbar widget".split()
)
READER_WORDS = set("comment comments discussion disqus replies".split())
ARTICLE_WORDS = set("article articlebody content entry main maincontent post postbody prose story text".split())
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


@dataclass
class Block:
    text: str
    words: int
    link: float  # share of words inside links
    zone: int  # 1: in an article, -1: in something beside it, 0: neither
    heading: int  # whether it is one


def markup(page: str) -> Iterator[tuple[int, int, str, bool, str]]:
    """The tags of a page: (from, to, name, whether it closes, attributes); the name is empty for comments and the like.

    A raw element is one tag from its start to its end.  Each character is looked at a bounded number of times: where quotes
    in a tag don't pair up, none do from there on; what has no end runs to the end of the page, or is left out if that
    would take text with it.
    """
    at, quotes, ends = page.find("<"), True, {}
    last = page.rfind(">")
    while 0 <= at < last:
        if page.startswith("<!--", at):
            stop = page.find("-->", at + 4)
            stop = len(page) if stop < 0 else stop + 3
            yield at, stop, "", False, ""
        elif (m := _NAME.match(page, at + 1)) is None:
            stop = at + 1
            if page[at + 1] in "!?/":
                stop = page.index(">", at) + 1
                yield at, stop, "", False, ""
        else:
            closes, name, stop = bool(m[1]), m[2].lower(), 0
            if quotes:
                whole = _QUOTED.match(page, m.end())
                quotes, stop = whole is not None, whole.end() if whole else 0
            stop = stop or page.index(">", m.end() - 1) + 1
            first, attributes = stop, page[m.end() : stop - 1]
            if name in RAW and not closes and ends.get(name, 0) >= 0:
                close = re.compile(rf"</{name}\s*>", re.I).search(page, stop)
                ends[name] = close.start() if close else -1
                if close:
                    stop = close.end()
                elif name in OPEN_RAW:
                    stop = len(page)
            elif name in OPEN_RAW and not closes:
                stop = len(page)
            yield at, stop, name, closes, "" if stop > first else attributes
        at = page.find("<", stop)


@dataclass(frozen=True)
class Place:
    """Where an element lies: its zone, and whether a tag and not only a name or a form sets it aside."""

    zone: int = 0
    firm: bool = False


@lru_cache(4096)
def _named(tag: str, attributes: str) -> tuple[bool, bool, bool]:
    """Whether an element is set aside by its name or as a form, whether its name says that it is an article, and whether readers wrote it."""
    names = set()
    if attributes and tag not in ("html", "head", "body"):
        names = {p.lower() for m in _NAMES.findall(attributes) for p in _PARTS.findall("".join(m))}
    return tag in LOOSE or bool(names & ASIDE_WORDS), bool(names & ARTICLE_WORDS), bool(names & READER_WORDS)


def _place(tag: str, named: tuple[bool, bool, bool], around: Place) -> Place:
    """The place of an element inside another."""
    if tag in ASIDE and tag not in LOOSE and not (tag == "header" and around.zone > 0):
        return Place(-1, True)
    if around.firm or tag == "header":
        return around
    if tag == "main" or tag == "article" and around.zone >= 0:
        return Place(1)
    if tag == "article" and not named[0]:
        return Place(0)  # inside something set aside by its name only: the tree decides
    if around.zone < 0:
        return around
    if named[0]:
        return Place(-1, named[2])
    return Place(1) if named[1] else around


def blocks(page: str) -> list[Block]:
    """The blocks of a page.

    What is set aside by its name only, or as a form, but holds more than half of the words outside links, with no article
    outside it, is a wrapper of the page and passed over.  Such elements lie inside each other, so it takes three readings
    to tell which: one for the words, one with all of them passed over, and the last.
    """
    found, _, sums = _blocks(page, frozenset())
    half = sum(b.words * (1 - b.link) for b in found) / 2
    chain = sorted(start for start, words in sums.items() if words > half)
    if chain:
        found, depths, _ = _blocks(page, frozenset(chain))
        outside = min((d for b, d in zip(found, depths, strict=True) if b.zone > 0), default=len(chain))
        if outside < len(chain):
            found, _, _ = _blocks(page, frozenset(chain[:outside]))
    return found


def _blocks(page: str, passed: frozenset[int]) -> tuple[list[Block], list[int], dict[int, float]]:
    """Blocks, how many elements of ``passed`` each lies in, and the words outside links of what a name or form sets aside."""
    found: list[Block] = []
    depths: list[int] = []
    sums: dict[int, float] = {}
    open_: list[tuple[str, Place, int, float]] = []  # tag, place, where it starts if a name or form sets it aside, words so far
    here, links, headings, depth, free, parts = Place(), 0, 0, 0, 0.0, []
    quiet = ""  # inside a head or an svg that no block has ended yet

    def text(a: int, b: int) -> None:
        if a < b and not quiet:
            parts.append((page[a:b], links > 0))

    def flush() -> None:
        nonlocal free
        if not parts:
            return
        words = html.unescape("".join([t for t, _ in parts])).split()
        if words:
            linked = sum(len(html.unescape(t).split()) for t, inside in parts if inside)
            found.append(Block(" ".join(words), len(words), min(1.0, linked / len(words)), here.zone, int(headings > 0)))
            depths.append(depth)
            free += found[-1].words * (1 - found[-1].link)
        parts.clear()

    def leave(k: int) -> Place:
        nonlocal links, headings, depth
        while len(open_) > k:
            tag, _, start, before = open_.pop()
            links -= tag == "a"
            headings -= tag in HEADINGS
            if start >= 0:
                depth -= start in passed
                sums[start] = free - before
        return open_[-1][1] if open_ else Place()

    at, counts = 0, Counter()
    for start, stop, tag, closes, attributes in markup(page):
        text(at, start)
        at = stop
        if tag in RAW:
            if tag not in ("noscript", "template") and not closes:
                flush()
        elif tag == "br":
            parts.append((" ", links > 0))
        elif tag in ("head", "svg"):
            if closes:
                quiet = "" if quiet == tag else quiet
            elif not attributes.endswith("/"):
                quiet = quiet or tag
        elif tag and (tag not in VOID or tag == "hr"):
            if tag in BLOCK:
                quiet = ""
                flush()
            if closes:
                if counts[tag]:
                    k = len(open_) - 1
                    while open_[k][0] != tag:
                        k -= 1
                    counts.subtract(t for t, *_ in open_[k:])
                    here = leave(k)
            elif tag not in VOID and not quiet:
                if tag in ("p", "li", "td", "tr", "dd", "dt", "option") and open_ and open_[-1][0] == tag:  # closed by the next
                    counts[tag] -= 1
                    here = leave(len(open_) - 1)
                links += tag == "a"
                headings += tag in HEADINGS
                named = _named(tag, attributes)
                own = start if named[0] and not here.firm else -1
                if own in passed:
                    named = (False, named[1], False)
                    depth += 1
                here = _place(tag, named, here)
                open_.append((tag, here, own, free))
                counts[tag] += 1
    text(at, len(page))
    flush()
    leave(0)
    return found, depths, sums


FEATURES = ("words", "link", "words_before", "link_before", "words_after", "link_after", "around", "heading", "zone")


def features(found: list[Block]) -> np.ndarray:
    """A row for each block: words and link share of it and of its neighbours, the most words outside links of any block
two places around, and what its elements say.  A neighbour in another zone counts as none."""
    n = len(found)
    own = np.array([(b.words, b.link) for b in found], float).reshape(n, 2)
    said = np.array([(b.heading, b.zone) for b in found], float).reshape(n, 2)
    run = np.cumsum(np.append(0, np.diff(said[:, 1]) != 0)) if n else np.zeros(0)

    def at(k: int) -> np.ndarray:
        """The block k places on, if it lies in the same run of blocks of a zone."""
        there = np.arange(n) + k
        inside = (there >= 0) & (there < n)
        there = np.where(inside, there, 0)
        return np.where((inside & (run[there] == run))[:, None], own[there], 0.0) if n else own

    around = np.max([(w := at(k))[:, 0] * (1 - w[:, 1]) for k in (-2, -1, 1, 2)], axis=0)
    return np.column_stack([own, at(-1), at(1), around, said])


@dataclass
class Node:
    share: float  # of main text among the labelled rows here
    feature: int = -1
    cut: float = 0.0
    below: Node | None = None
    above: Node | None = None

    def predict(self, x: np.ndarray) -> np.ndarray:
        if self.below is None:
            return np.full(len(x), self.share)
        under = x[:, self.feature] <= self.cut
        out = np.empty(len(x))
        out[under], out[~under] = self.below.predict(x[under]), self.above.predict(x[~under])
        return out


def grow(x: np.ndarray, y: np.ndarray, depth: int = 16, least: int = 3, prior: float = 0.0) -> Node:
    """A binary tree that splits where the Gini impurity falls most; ties go to the first feature and the lowest cut.

    A leaf with as many rows of either kind has the share of the node above it.
    """
    node = Node(float(y.mean()))
    if depth == 0 or node.share in (0.0, 1.0):
        node.share = prior if node.share == 0.5 else node.share
        return node
    best = (y.var() * len(y) - 1e-9, -1, 0.0)
    for f in range(x.shape[1]):
        for cut in np.unique(x[:, f])[:-1]:
            under = x[:, f] <= cut
            if least <= under.sum() <= len(y) - least:
                loss = y[under].var() * under.sum() + y[~under].var() * (~under).sum()
                if loss < best[0] - 1e-9:
                    above = x[~under, f].min()
                    best = (loss, f, (cut + above) / 2)
    if best[1] >= 0:
        node.feature, node.cut = best[1], best[2]
        under = x[:, node.feature] <= node.cut
        node.below, node.above = (grow(x[side], y[side], depth - 1, least, node.share) for side in (under, ~under))
    elif node.share == 0.5:
        node.share = prior
    return node


def labelled_rows() -> tuple[np.ndarray, np.ndarray]:
    """The small labelled table: features of the blocks of all sketches, and whether they are main text.

    A sketch is read as it is and with its zones blank, but for what neither words nor links tell from a paragraph, such as a
    long comment of a reader; and, as blocks of any words and links lie in articles and beside them,
    with all its blocks inside one, which makes them text, and all beside it, which makes them none.
    """
    rows, labels = [], []
    for sketch in SKETCHES:
        found = blocks(re.sub(r"([+-])(\d+)", lambda m: " ".join([{"+": "kept", "-": "left"}[m[1]]] * int(m[2])), sketch))
        judged = [b.text.startswith("kept") for b in found]
        for zone, labelled in ((None, judged), (0, judged), (1, [True] * len(found)), (-1, [False] * len(found))):
            told = [zone != 0 or b.zone >= 0 or b.words * (1 - b.link) < 15 for b in found]
            rows.append(features(found if zone is None else [replace(b, zone=zone) for b in found])[told])
            labels += [y for y, t in zip(labelled, told, strict=True) if t]
    return np.vstack(rows), np.array(labels, float)


@lru_cache(1)
def tree() -> Node:
    return grow(*labelled_rows())


def main_text(page: str | None) -> str:
    """The main text of a page."""
    found = blocks(page) if page else []
    keep = tree().predict(features(found)) >= 0.5
    return "\n".join([b.text for b, k in zip(found, keep, strict=True) if k])


def _extract(piece: pa.RecordBatch) -> pa.RecordBatch:
    texts = [main_text(h) for h in piece.column("html").to_pylist()]
    return pa.RecordBatch.from_arrays([piece.column("page_id"), piece.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])


def extract_pages(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) for each row of (page_id, url, html)."""
    return map_texts(pages.select("page_id", "url", "html"), _extract, "page_id long, url string, text string, n_chars long", "html")


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"))
