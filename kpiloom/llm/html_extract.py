"""Main text of web pages by tag-path ratios.

Every block of text has a path of block elements from the root. Text length and punctuation
are summed per path and divided by its number of blocks; the two ratios are smoothed along
the page (near blocks on like paths lend each other weight), fused into one score per path,
and paths that score above a multiple of the deviation are content. They say where the article
is: all that stands under their nearest common ancestor belongs to it, but for blocks of links.

Elements named after parts that are no article (menus, adverts, comments) are left out, unless the ratios
say that the article is inside. Paths are nodes of a tree, so deep pages cost no more than long ones.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame

from kpiloom.llm.common import pieces_of

# Element names of HTML and words that name the parts of a page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span "
    "strike strong sub sup time tt u var wbr math maction menclose merror mfrac mi mmultiscripts mn mo mover mpadded "
    "mphantom mprescripts mroot mrow ms mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover semantics".split()
)
ROOTS = frozenset("html body main article".split())
NOT_CONTENT = frozenset(
    "head title nav menu header footer aside form dialog button fieldset select option datalist noscript audio video "
    "canvas map".split()
)
NOT_CONTENT_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie "
    "cookies copyright disqus dropdown footer gdpr header masthead menu modal nav navbar navigation newsletter notice "
    "pager pagination popup promo promotion recommended related reply replies respond share sharing sidebar signup "
    "skip social sponsor sponsored subscribe subscription tags toolbar widget widgets".split()
)
CLOSED_BY = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th"}, "th": {"td", "th"},
    "tr": {"td", "th", "tr"}, "option": {"option"},
}
PUNCTUATION = re.compile(r"[,.;:!?。，！？…]")

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(script|style|template|textarea|iframe|svg|object|xmp|annotation|annotation-xml)\b(?:\"[^\"<]*\"|'[^'<]*'|[^>])*+>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"<]*\"|'[^'<]*'|[^>])*+)(?:>|\Z)"
    r"|<[!?/][^>]*(?:>|\Z)",
    re.DOTALL | re.IGNORECASE,
)
ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
WORD = re.compile(r"[a-z]+")
# Elements that are parts of a text and do not hold an article.
PARTS = frozenset(
    "p ul ol li dl dt dd table caption thead tbody tfoot tr td th blockquote pre figure figcaption h1 h2 h3 h4 h5 h6".split()
)
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre dd figcaption".split())
HEADING = re.compile(r"h[1-6](?:\.|$)")
# An element named as no part of the article holds it all the same if its best path scores, and its
# text weighs, so many times what is found outside.
STRONGER, HEAVIER = 4.0, 8.0
ROUNDS = 8  # such elements one inside the other that are looked into
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")


class Paths:
    """Root-to-leaf paths as nodes of a tree, each with its parent and a node further up to jump to."""

    def __init__(self):
        self.nodes: dict[tuple[int, str], int] = {}
        self.parent, self.depth, self.jump, self.label, self.holder = [0], [0], [0], [""], [0]

    def child(self, node: int, label: str) -> int:
        found = self.nodes.get((node, label))
        if found is None:
            found = self.nodes[node, label] = len(self.parent)
            up = self.jump[node]
            even = self.depth[node] - self.depth[up] == self.depth[up] - self.depth[self.jump[up]]
            self.parent.append(node)
            self.depth.append(self.depth[node] + 1)
            self.jump.append(self.jump[up] if even else node)
            self.label.append(label)
            # The nearest element that may hold an article.
            self.holder.append(self.holder[node] if label.split(".", 1)[0] in PARTS else found)
        return found

    def shared(self, a: int, b: int) -> int:
        """The nearest common ancestor, in steps by the logarithm of the depth."""
        depth, jump, parent = self.depth, self.jump, self.parent
        if depth[a] < depth[b]:
            a, b = b, a
        while depth[a] > depth[b]:
            a = jump[a] if depth[jump[a]] >= depth[b] else parent[a]
        while a != b:
            a, b = (jump[a], jump[b]) if jump[a] != jump[b] else (parent[a], parent[b])
        return a

    def likeness(self, a: int, b: int) -> float:
        return 1.0 if a == b else self.depth[self.shared(a, b)] / max(self.depth[a], self.depth[b])

    def below(self, holder: int) -> list[bool]:
        """For each node whether it is the holder or stands under it."""
        found: list[bool] = []
        for node, parent in enumerate(self.parent):
            found.append(node == holder or (node > 0 and found[parent]))
        return found


class Block(NamedTuple):
    path: int
    text: str
    linked: int  # characters in links
    doubt: int  # the innermost element around it whose name says that it is no article; 0 for none


def _label(tag: str, attributes: str) -> tuple[str, bool, bool]:
    """What the path shows of an element, whether it is hidden, and whether its name says that it is not content."""
    if not attributes or attributes.isspace():
        return tag, False, False
    named = {m[0].lower(): (m[1] or m[2] or m[3]).lower() for m in ATTRIBUTE.findall(attributes)}
    said = " ".join(named.get(k, "") for k in ("class", "id", "role"))
    doubt = bool(NOT_CONTENT_WORDS.intersection(WORD.findall(said)))
    hidden = named.get("aria-hidden") == "true" or bool(HIDDEN.search(named.get("style", "")))
    hidden |= re.search(r"(?:^|\s)hidden(?:\s|/|$)", attributes) is not None
    kind = named.get("class", "")
    root = tag in ROOTS
    return (f"{tag}.{kind}" if kind else tag), hidden and not root, doubt and not root


def blocks_of(page: str) -> tuple[list[Block], Paths, list[int]]:
    """The blocks outside of elements that are hidden or never content, their paths, and for each doubt the one around it."""
    found: list[Block] = []
    paths, doubts = Paths(), [0]
    stack: list[tuple[str, int, bool, int]] = []  # element, path of it, not content, doubt in it
    opened: dict[str, int] = {}
    parts: list[str] = []
    out = links = in_links = 0

    def flush() -> None:
        nonlocal in_links
        if parts:
            text = " ".join("".join(parts).split())
            if text and not out:
                _, path, _, doubt = stack[-1] if stack else ("", 0, False, 0)
                found.append(Block(path, text, in_links, doubt))
            parts.clear()
        in_links = 0

    def pop() -> None:
        nonlocal out
        tag, _, hidden, _ = stack.pop()
        opened[tag] -= 1
        out -= hidden

    def text(raw: str) -> None:
        nonlocal in_links
        if raw and not out:
            plain = entities.unescape(raw) if "&" in raw else raw
            parts.append(plain)
            if links:
                in_links += len(plain.strip())

    at = 0
    for token in TOKEN.finditer(page):
        if token.start() > at:
            text(page[at : token.start()])
        at = token.end()
        tag = token[3]
        if tag is None:
            continue
        tag = tag.lower()
        if tag in VOID:
            if tag == "hr":
                flush()
            else:
                parts.append(" ")
            continue
        if token[2]:
            if tag in INLINE and not opened.get(tag):
                links -= tag == "a" and links > 0
            elif opened.get(tag):
                flush()
                while stack[-1][0] != tag:
                    pop()
                pop()
            continue
        label, hidden, doubted = _label(tag, token[4])
        if tag in INLINE and not hidden and not doubted:
            links += tag == "a"
            continue
        flush()
        links = 0
        if stack and stack[-1][0] == "p":
            pop()
        while stack and stack[-1][0] in CLOSED_BY.get(tag, ()):
            pop()
        # The header of an article has its title; that of the page goes.
        hidden = hidden or (tag in NOT_CONTENT and not (tag == "header" and opened.get("article")))
        _, path, _, doubt = stack[-1] if stack else ("", 0, False, 0)
        if doubted:
            doubts.append(doubt)
            doubt = len(doubts) - 1
        stack.append((tag, paths.child(path, label), hidden, doubt))
        opened[tag] = opened.get(tag, 0) + 1
        out += hidden
        if tag == "body":
            out = 0
    text(page[at:])
    flush()
    return found, paths, doubts


def path_scores(blocks: list[Block], paths: Paths, radius: int = 2) -> dict[int, float]:
    """The fused, smoothed ratios of each path.

    A heading is short whatever it stands above, so its path scores at least as high as what
    follows it does on average.
    """
    sums: dict[int, list[float]] = {}
    for path, text, linked, _ in blocks:
        s = sums.setdefault(path, [0.0, 0.0, 0.0])
        s[0] += max(0, len(text) - linked)
        s[1] += len(PUNCTUATION.findall(text))
        s[2] += 1
    ratio = {path: (length / n, points / n) for path, (length, points, n) in sums.items()}
    kernel = [math.exp(-(d * d) / 2) for d in range(radius + 1)]
    alike: dict[tuple[int, int], float] = {}
    smooth: dict[int, list[float]] = {path: [0.0, 0.0, 0.0] for path in ratio}
    for i, block in enumerate(blocks):
        path = block.path
        s = smooth[path]
        for j in range(max(0, i - radius), min(len(blocks), i + radius + 1)):
            other = blocks[j].path
            if (like := alike.get((path, other))) is None:
                like = alike[path, other] = paths.likeness(path, other)
            weight = kernel[abs(i - j)] * like**2
            s[0] += weight * ratio[other][0]
            s[1] += weight * ratio[other][1]
            s[2] += weight
    score = {path: (a / w) * math.log(2 + b / w) if w else 0.0 for path, (a, b, w) in smooth.items()}
    below: dict[int, list[float]] = {}
    for one, after in zip(blocks, blocks[1:], strict=False):
        path, above = one.path, paths.parent[one.path]
        if HEADING.match(paths.label[path]) and paths.shared(above, after.path) == above:
            below.setdefault(path, []).append(score[after.path])
    for path, follow in below.items():
        score[path] = max(score[path], sum(follow) / len(follow))
    return score


def content_paths(blocks: list[Block], score: dict[int, float], strictness: float = 0.8) -> set[int]:
    """The paths whose score is over `strictness` deviations."""
    values = [score[block.path] for block in blocks]
    mean = sum(values) / len(values) if values else 0.0
    deviation = math.sqrt(sum((v - mean) ** 2 for v in values) / len(values)) if values else 0.0
    return {path for path, value in score.items() if value > 0 and value >= strictness * deviation}


def container_of(found: set[int], paths: Paths) -> int | None:
    """The nearest common ancestor of some paths, outside of parts of a text; headings do not count beside others."""
    holder = None
    for path in [p for p in found if not HEADING.match(paths.label[p])] or found:
        holder = paths.holder[path] if holder is None else paths.shared(holder, paths.holder[path])
    return holder


def _undoubted(blocks: list[Block], paths: Paths, doubts: list[int]) -> list[Block]:
    """The blocks to judge: those in no doubted element, and those in one that the ratios show to hold the article."""
    trusted = {0}
    for _ in range(ROUNDS):
        outer = [0] * len(doubts)  # the outermost doubted element around each, of those not trusted
        for doubt in range(1, len(doubts)):
            above = doubts[doubt]
            outer[doubt] = outer[above] or (0 if doubt in trusted else doubt)
        inside: dict[int, list[Block]] = {}
        for block in blocks:
            inside.setdefault(outer[block.doubt], []).append(block)
        outside = inside.pop(0, [])
        if not inside:
            return outside

        def weight(part: list[Block]) -> int:
            return sum(max(0, len(b.text) - b.linked) for b in part)

        heaviest = max(inside, key=lambda doubt: weight(inside[doubt]))
        if weight(inside[heaviest]) <= HEAVIER * weight(outside):
            return outside
        best = [max(path_scores(part, paths).values(), default=0.0) for part in (inside[heaviest], outside)]
        if best[0] <= STRONGER * best[1]:
            return outside
        trusted.add(heaviest)
    return outside


def main_text(page: str | None) -> str:
    """The article of one page, blocks joined by an empty line; empty if there is none."""
    if not page:
        return ""
    blocks, paths, doubts = blocks_of(page)
    if len(doubts) > 1:
        blocks = _undoubted(blocks, paths, doubts)
    kept = content_paths(blocks, path_scores(blocks, paths))
    holder = container_of(kept, paths)
    below = paths.below(holder) if holder is not None else []

    def stays(block: Block) -> bool:
        if block.path in kept:
            return True
        if holder is None or not below[block.path]:
            return False
        # A paragraph may be mostly links, a list of them is none of the article.
        prose = paths.label[block.path].split(".", 1)[0] in PROSE
        return block.linked <= (0.9 if prose else 0.5) * len(block.text)

    return "\n\n".join(block.text for block in blocks if stays(block))


SCHEMA = "page_id long, url string, text string, n_chars long"


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in pieces_of(whole, "html"):
            texts = [main_text(page) for page in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("page_id"),
                    batch.column("url"),
                    pa.array(texts, pa.string()),
                    pa.array([len(t) for t in texts], pa.int64()),
                ],
                ["page_id", "url", "text", "n_chars"],
            )


def extract_pages(pages: DataFrame) -> DataFrame:
    """Main text of every row of `pages` (page_id, url, html); one row out for each row in.

    Pages are independent, so there is no shuffle and a lost task repeats its pages only.
    Null or empty html, and pages that have markup only, give the empty text. Equal rows each
    give a row. Null ids and urls pass through. Other columns of the input are not read.
    Unclosed elements, comments and attributes end with the page. Very long and very deep pages are
    handled one at a time, in time about proportional to their length.
    """
    return pages.selectExpr("cast(page_id as long) page_id", "cast(url as string) url", "html").mapInArrow(
        _extract, SCHEMA
    )
