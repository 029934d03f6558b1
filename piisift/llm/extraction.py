"""Main text of HTML pages by the maximum-scoring subsequence of words and tags.

A page is a sequence of tokens: words and tags.  Words score positive, tags
negative; the contiguous run of tokens with the largest sum is the content
region, found by one linear scan.  What kind of word or tag scores how much is
learnt from labelled pages, those whose markup names its main part (``main`` or
``article``): a token kind's weight is its log odds of lying inside that part.
Elements that never hold the article (scripts, styles, forms, navigation,
headers, footers, asides, by element or role) are left out of the text wherever
they are, and their words count against the region unless they lie inside the
part that the markup names.  A form around most of the page's words is no form
in this sense, and a button inside a paragraph is part of its sentence.  Classes and ids that name
a sidebar, notice, advert or comments of readers only make a kind of their own
of the blocks inside: they are left out if its weight, learnt like the others,
is negative.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from math import log

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from piisift.llm.common import text_slices

#: Labelled pages that the weights are learnt from : the bound of the sample (met on average, chosen by hash).
SAMPLE_PAGES = 2000

# fixed values: element names of HTML
BLOCKS = set(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html "
    "legend li main menu nav noscript ol optgroup option p pre search section select summary table tbody td template tfoot th thead title tr ul".split()
)
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW_TEXT = set("script style textarea title noscript iframe noembed noframes xmp".split())
SKIPPED = set("head script style noscript template iframe object svg canvas button select textarea nav header footer aside menu dialog audio video map search".split())
CONTAINERS = set("article blockquote body center div main section table td".split())
CLOSES_P = BLOCKS - {"br", "body", "html", "head", "title", "option", "optgroup", "noscript", "template", "select", "td", "th", "tr", "tbody", "thead", "tfoot", "caption"}
#: What a page puts around its main part: entering main ends the skip.
AROUND_MAIN = set("nav header footer aside search".split())
SKIPPED_ROLES = set("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar".split())
#: Whole class or id tokens (all their parts) that speak against an element.
BOILERPLATE = re.compile(
    r"(?:(?:^|[-_])(?:ads?|advert\w*|adsense|banner|sponsor\w*|promo\w*|cookies?|consent|notice|gdpr|popup|modal|overlay|newsletter|subscri\w+|signup|login|sidebar|side|rail|widgets?"
    r"|nav|navbar|navigation|menu|breadcrumbs?|pagination|pager|footer|header|masthead|topbar|share|sharing|social|related|recommended|comments?|disqus|respond|replies|reply|toolbar|skip"
    r"|aside|copyright|complementary|contentinfo|search|alert|alertdialog|dialog))+"
)
#: An element with more than this share of the page's words is a wrapper, whatever its class says.
WRAPPER = 0.75
HEADINGS = set("h1 h2 h3 h4 h5 h6 p".split())
MAIN = re.compile(r"(?<![a-z])(?:main|articlebody)(?![a-z])")
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>",
    re.S,
)
ATTRIBUTE = re.compile(r"(?:^|[\s/\"'])(class|id|role|itemprop|hidden|aria-hidden|aria-label|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?(?=[\s/\"'>]|$)", re.I)
SPACE = re.compile(r"\s+")


class Page:
    """The blocks of a page in order: ``(text, kind, tags before it, inside a skipped element, inside the labelled part, containers)``.

    A block ends at every block element's tag; inline tags do not end it.  Its
    kind ends in ``+hint`` inside an element of a boilerplate class or id.
    """

    def __init__(self, source: str):
        self.blocks: list[tuple] = []
        self.stack: list[tuple] = []  # element, skipped, labelled as main part, hinted, what was skipped and hinted around it
        self.skipping: list[str] = []  # skipped elements on the stack ("": not shown at all)
        self.hints: list[int] = []  # numbers of hinted elements on the stack
        self.hinted: list[tuple[int, ...]] = []  # those of each block
        self.forms: list[int] = []  # numbers of forms on the stack
        self.formed: list[tuple[int, ...]] = []  # those of each block
        self.open: Counter = Counter()  # elements on the stack by name
        self.kinds, self.around = [], []  # block elements and numbers of containers on the stack
        self.mains = self.muted = 0  # muted: skipped elements inside a block, whose words are no part of it
        self.text: list[str] = []
        self.link_chars = self.chars = self.tags = self.elements = 0
        self.labelled = False
        at, last = 0, source.rfind(">") + 1
        while at < last and (m := TOKEN.search(source, at, last)):
            self._words(source[at : m.start()])
            at = m.end()
            closing, name, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
            name = (name or "").lower()
            if not name:
                if m[0].startswith("<![CDATA["):
                    self._words(m[0][9:].removesuffix("]]>"))
            elif closing:
                self._close(name)
            else:
                self._start(name, attributes)
                if name in RAW_TEXT:
                    end = re.compile(rf"</{name}(?=[\s/>])|\Z", re.I).search(source, at)
                    self._words(source[at : end.start()])
                    at = end.start()
        self._words(source[at:].partition("<!--")[0])
        self._end_block()
        prose = [b[1] in HEADINGS for b in self.blocks]  # a form is around the page if it is around its paragraphs
        for i in self._inside_small(self.formed, prose if any(prose) else [True] * len(prose)):
            self.blocks[i] = (*self.blocks[i][:3], True, *self.blocks[i][4:])
        for i in self._inside_small(self.hinted, [True] * len(prose)):
            self.blocks[i] = (self.blocks[i][0], self.blocks[i][1] + "+hint", *self.blocks[i][2:])

    def _inside_small(self, numbers: list[tuple[int, ...]], counted: list[bool]) -> list[int]:
        """Blocks inside a numbered element that does not hold more than ``WRAPPER`` of the words shown in ``counted`` blocks."""
        if not any(numbers):
            return []
        within, total = Counter(), 0
        for (text, _, _, skipped, *_), around, counts in zip(self.blocks, numbers, counted, strict=True):
            if counts and not skipped:
                within.update(dict.fromkeys(around, text.count(" ") + 1))
                total += text.count(" ") + 1
        return [i for i, around in enumerate(numbers) if any(within[n] <= WRAPPER * total for n in around)]

    def _words(self, text: str) -> None:
        if text and not self.muted:
            self.text.append(text)
            self.link_chars += len(text) if self.open["a"] else 0
            self.chars += len(text)

    def _end_block(self) -> None:
        text = SPACE.sub(" ", html.unescape("".join(self.text))).strip()
        if text:
            kind = (self.kinds[-1] if self.kinds else "") + ("+link" if 2 * self.link_chars > self.chars else "")
            self.blocks.append((text, kind, self.tags, bool(self.skipping), self.mains > 0, tuple(self.around)))
            self.hinted.append(tuple(self.hints))
            self.formed.append(tuple(self.forms))
            self.tags = 0
        self.text, self.link_chars, self.chars = [], 0, 0

    def _push(self, name: str, skipped: bool, main: bool, hinted: bool, shown: bool) -> None:
        around = None
        if main and not self.mains:
            around = self.skipping, self.hints, self.forms
            ends = set() if name == "article" else AROUND_MAIN
            self.skipping, self.hints, self.forms = [x for x in self.skipping if x not in ends], [], []
        self.stack.append((name, skipped, main, hinted, around))
        self.open[name] += 1
        self.muted += skipped and name not in BLOCKS
        self.mains += main
        self.elements += 1
        if skipped:
            self.skipping.append(name if shown else "")
        if hinted:
            self.hints.append(self.elements)
        if name == "form":
            self.forms.append(self.elements)
        if name in BLOCKS:
            self.kinds.append(name)
        if name in CONTAINERS:
            self.around.append(self.elements)

    def _drop(self) -> str:
        name, skipped, main, hinted, around = self.stack.pop()
        self.open[name] -= 1
        self.muted -= skipped and name not in BLOCKS
        self.mains -= main
        if skipped:
            self.skipping.pop()
        if hinted:
            self.hints.pop()
        if name == "form":
            self.forms.pop()
        if around:
            self.skipping, self.hints, self.forms = around
        if name in BLOCKS:
            self.kinds.pop()
        if name in CONTAINERS:
            self.around.pop()
        return name

    def _start(self, name: str, attributes: str) -> None:
        if name in BLOCKS:
            self._end_block()
        self.tags += 1
        if name in CLOSES_P:
            self._pop("p")
        if name in ("li", "dd", "dt", "tr", "td", "th", "option") and self.stack and self.stack[-1][0] == name:
            self._drop()
        if name in VOID:
            return
        inside = self.mains > 0  # an article's own header is part of it
        skipped, main = name in SKIPPED and not (name == "header" and inside) and not (name == "button" and self.open["p"]), name in ("main", "article")
        shown, hinted = True, False
        for key, *values in ATTRIBUTE.findall(attributes):
            key, value = key.lower(), "".join(values).lower()
            if key == "class" or (key == "id" and name not in HEADINGS):
                hinted |= any(BOILERPLATE.fullmatch(w) and not (inside and w == "header") for w in value.split())
            if key == "role":
                skipped |= any(w in SKIPPED_ROLES and not (inside and w == "banner") for w in value.split())
            if key in ("role", "itemprop"):
                main |= bool(MAIN.search(value))
            shown &= not (key == "hidden" or (key == "aria-hidden" and value == "true") or (key == "style" and "display:none" in value.replace(" ", "")))
        if main and name not in SKIPPED:
            skipped = False
        hinted &= name in BLOCKS and not main and name not in ("body", "html")
        self.labelled |= main
        self._push(name, skipped or not shown, main, hinted, shown)

    def _close(self, name: str) -> None:
        if name in BLOCKS:
            self._end_block()
        self.tags += 1
        self._pop(name)

    def _pop(self, name: str) -> None:
        """Ends the innermost open element of that name and all inside it; a p never ends from inside a table cell."""
        if not self.open[name]:
            return
        if name == "p":
            for inner, *_ in reversed(self.stack):
                if inner == "p":
                    break
                if inner in ("table", "td", "th", "button", "object"):
                    return
        while self._drop() != name:
            pass


class Scores:
    """Weights of words by the kind of their block, and of a tag; learnt as log odds from labelled pages.

    ``words``: per kind, words inside and outside the main part (skipped
    elements not counted); ``tags``: tags inside and outside; of the tags
    before a block at most four count against it, since wrappers nest deeper
    than that around any first block.  Few counts stay near the weights of an
    unknown kind: 0.5, and -0.5 if it is mostly links or of a boilerplate class.
    """

    def __init__(self, words: dict[str, tuple[int, int]], tags: tuple[int, int], prior: float = 50.0):
        self.default = 0.5
        self.words = {}
        for kind, (inside, outside) in words.items():
            odds = log((inside + prior) / (outside + prior))
            self.words[kind] = max(-2.0, min(2.0, self.word(kind) + odds / 4))
        inside, outside = (sum(w[i] for w in words.values()) for i in (0, 1))
        # a tag costs a word's gain times the words per tag at which inside and outside are equally likely, and always something
        dense = (tags[0] + prior) / (inside + 10 * prior) + (tags[1] + prior) / (outside + 10 * prior)
        self.tag = -max(0.5, min(2.0, 0.5 / dense * self.default))

    def word(self, kind: str) -> float:
        return self.words.get(kind, -0.5 if "+" in kind else self.default)

    def left_out(self, block: tuple) -> bool:
        """Whether the block is no part of the text wherever it is."""
        return block[3] or (block[1].endswith("+hint") and self.word(block[1]) <= 0)

    def block(self, block: tuple) -> float:
        text, kind, tags, skipped, *_ = block
        words = text.count(" ") + 1
        if self.left_out(block) and block[4]:
            return 0.0
        if skipped:
            return self.tag * (tags + words)
        return self.tag * min(tags, 4) + self.word(kind) * words


def best_region(scores: list[float]) -> tuple[int, int]:
    """First and end index of the contiguous run with the largest sum (the first such; empty if none is positive)."""
    best, region, total, start = 0.0, (0, 0), 0.0, 0
    for i, s in enumerate(scores):
        if total <= 0:
            total, start = 0.0, i
        total += s
        if total > best:
            best, region = total, (start, i + 1)
    return region


def _with_siblings(blocks: list[tuple], left: list[bool], scores: Scores, parent: tuple, at: int, step: int) -> int:
    """From block ``at``, in direction ``step``, past the children of ``parent`` whose blocks score positive; left-out blocks between them do not count."""
    depth, edge = len(parent), at

    def under(i: int, path: tuple) -> bool:
        return 0 <= i < len(blocks) and blocks[i][5][: len(path)] == path

    while True:
        while under(at, parent) and left[at]:
            at += step
        if not under(at, parent):
            return edge
        child, total = blocks[at][5][: depth + 1], 0.0
        while under(at, child) and (len(child) > depth or len(blocks[at][5]) == depth):
            total += 0.0 if left[at] else scores.block(blocks[at])
            at += step
        if total <= 0:
            return edge
        edge = at


def main_text(source: str | None, scores: Scores) -> str:
    """The blocks of the best region that are not left out, joined by blank lines."""
    blocks = Page(source or "").blocks
    left = [scores.left_out(b) for b in blocks]
    first, end = best_region([scores.block(b) for b in blocks])
    if first == end:  # a page of very short blocks: words alone decide
        first, end = best_region([0.0 if x else scores.word(b[1]) * (b[0].count(" ") + 1) for b, x in zip(blocks, left, strict=True)])
    paths = [b[5] for b, x in zip(blocks[first:end], left[first:end], strict=True) if not x]
    if paths:
        # short blocks at the edges cost more in tags than they gain in words: take those of the region's own container
        common = next((paths[0][:n] for n in range(len(paths[0]), 0, -1) if all(p[:n] == paths[0][:n] for p in paths)), ())

        def belongs(i: int) -> bool:
            return blocks[i][5][: len(common)] == common and (left[i] or scores.word(blocks[i][1]) > 0)

        while first > 0 and (belongs(first - 1) or (blocks[first - 1][1] in ("h1", "h2") and blocks[first - 1][5][: len(common) - 1] == common[:-1])):
            first -= 1
        while end < len(blocks) and belongs(end):
            end += 1
        if len(common) > 2 or (len(common) > 1 and any(b[4] for b in blocks[first:end])):  # the container has siblings in more than the body
            end = _with_siblings(blocks, left, scores, common[:-1], end, 1)
            first = _with_siblings(blocks, left, scores, common[:-1], first - 1, -1) + 1
    return "\n\n".join(b[0] for b, x in zip(blocks[first:end], left[first:end], strict=True) if not x)


def learn_scores(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", sample: int = SAMPLE_PAGES) -> Scores:
    """Weights from about ``sample`` pages, chosen by hash, whose markup names the main part; counts per kind come to the driver."""
    marked = pages.where(F.col(html_col).rlike("(?i)<main|<article|role=.?main|articlebody"))
    share = min(1.0, sample / max(1, marked.count()))
    chosen = marked.where(F.pmod(F.xxhash64(id_col, html_col), F.lit(1 << 30)) < int(share * (1 << 30))).select(F.col(html_col).alias("text"))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                page = Page(text)
                if page.labelled:
                    for words, kind, tags, skipped, inside, _ in page.blocks:
                        if not skipped:
                            counts[kind, inside] += words.count(" ") + 1
                            counts["<tag>", inside] += tags
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in counts], pa.string()), pa.array([g for _, g in counts], pa.bool_()), pa.array(list(counts.values()), pa.int64())], names=["kind", "good", "n"])

    rows = chosen.mapInArrow(task, "kind string, good boolean, n long").groupBy("kind", "good").agg(F.sum("n").alias("n")).collect()
    table: dict[str, list[int]] = {}
    for r in rows:
        table.setdefault(r["kind"], [0, 0])[0 if r["good"] else 1] += r["n"]
    tags = table.pop("<tag>", [0, 0])
    return Scores({k: tuple(v) for k, v in table.items()}, tuple(tags))


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: ``page_id, url, text``.

    Null html counts as empty and gives an empty text; whole pages are read.
    Repeated rows and null ids pass through row by row; extra columns are not
    read.  Character references are decoded, white space inside a block becomes
    one space, blocks are joined in page order by a blank line.
    """
    scores = learn_scores(pages, id_col, html_col)
    source = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("text"))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch):
                texts = [main_text(t, scores) for t in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    types = {f.name: f.dataType.simpleString() for f in source.schema}
    return source.mapInArrow(task, f"page_id {types['page_id']}, url {types['url']}, text string")
