"""Main text of web pages: the best contiguous region of words and tags.

A page is a row of words and tags. Words score positive and tags negative, by weights learned
from labelled pages, those that mark their content with <article> or <main>: the log-odds that
a word in such an element, or such a tag, lies inside the content. One linear scan finds the
contiguous run of greatest sum; its blocks are the text.

Words in boxes (menus, forms, scripts, adverts, comments, notices and the like) score nothing and
are left out of the region's text. A box is known by its element or by a name (a word of class,
id or role). Names have weights as well: the log-odds that an element of that name holds the
content rather than words beside it. A name that the labelled pages show too seldom is judged by
the words in it and by what the element holds. All of its words name boxes or places (`ad-slot`,
`comments-list`): a box, unless most of the content stands in it. Only some do (`related-work`,
`notice-period`): within the content a box only if much of its text is links. An element that
holds the content is no box whatever it is called: where all of a page's content stands in boxes,
those around the largest part of it are wrappers.

A page that marks its content (an <article> that holds most of a <main>, else the largest of them)
has its text there alone, so that readers' discussions and teasers beside it don't join it.

Defined results: null, empty or wordless html gives an empty text. Broken markup is read as it
stands: tags left open close with their parent, a quote or tag that never ends is plain text.
Reading takes time in proportion to the page, however broken. Rows are mapped one by one;
repeated rows give repeated results.
"""

from __future__ import annotations

import math
import re
from functools import lru_cache
from html import unescape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm._shared import halved, map_arrow, strings

#: Most labelled pages that weights are counted on.
LABELLED_PAGES = 2000
#: Least cost of a tag, so that tags always score negative; and bounds of a word's weight.
TAG_COST, WORD_LEAST, WORD_MOST = 0.02, 0.5, 4.0
#: Words that speak for a name before any are counted; and words of a box that may be a wrapper.
NAME_PRIOR, WRAPPER_WORDS = 100, 20
#: The share of links from which text is a list of links; and of a page's words that its marked content has at least.
LINKED, MARKED = 0.4, 0.25

# HTML elements by role.
RAW = "script style noscript iframe textarea title xmp noembed noframes".split()
VOID = "area base br col embed hr img input link meta param source track wbr".split()
INLINE = "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby rb rp rt s samp small span strike strong sub sup time tt u var wbr nobr img".split()
OUTSIDE = "nav header footer aside form button select option fieldset menu dialog datalist head search svg math template object canvas audio video".split()
# Elements outside the content that may yet stand around it; those that break no line.
AROUND = "form header fieldset object".split()
PHRASING = "button select option datalist svg math template object canvas audio video".split()
CONTENT = "article main".split()
# Words in class, id or role that name what is never content; words that make a name a state.
NAMED = "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe signup login sidebar rail widget widgets nav navbar navigation menu menus breadcrumb breadcrumbs header footer masthead copyright legal comment comments commentlist disqus respond reply replies share sharing social related recommended recommendations trending pagination pager skip toolbar search complementary contentinfo".split()
PLACES = "area bar block body bottom box col column container content fixed float global group head heading inline inner item items left link links list main outer page panel post posts primary right row secondary section site slot sticky stories story text title top unit wrap wrapper zone".split()
STATES = "has no not with without is hide show".split()
# Elements whose end tag may be missing, and the tags that end them.
CLOSED_BY = {"p": "address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split(), "li": ["li"], "dt": ["dt", "dd"], "dd": ["dt", "dd"], "tr": ["tr"], "td": ["td", "th", "tr"], "th": ["td", "th", "tr"], "option": ["option"]}

TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)")
MARK = re.compile("[>\"']")
RAW_END = {name: re.compile(rf"</{name}(?=[\s/>]|\Z)", re.I) for name in RAW}
NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
HIDDEN = re.compile(r"\bhidden(?=[\s=/]|\Z)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.I)
_INLINE, _OUTSIDE, _AROUND, _CONTENT, _VOID, _NAMED, _PLACES, _STATES = map(frozenset, (INLINE, OUTSIDE, AROUND, CONTENT, VOID, NAMED, PLACES, STATES))
_UNBROKEN = _INLINE | frozenset(PHRASING)


def tokens(page: str):
    """(name, end, attributes, text): texts have no name. Comments, declarations and raw elements are left out."""

    def after(mark: str, at: int) -> int:
        found = page.find(mark, at)
        return found + len(mark) if found >= 0 else len(page)

    at = begin = 0
    last, quotes, lacking = page.rfind(">"), True, set()
    while (lt := page.find("<", at)) >= 0:
        follows = page[lt + 1 : lt + 2]
        name = tag = None
        if page.startswith("<!--", lt):
            end = after("-->", lt + 2)
        elif page.startswith("<![CDATA[", lt):
            end = after("]]>", lt)
        elif follows and follows in "!?":
            end = after(">", lt)
        elif lt < last and (tag := TAG.match(page, lt)):
            end = at = tag.end()
            name = tag[2].lower()
            while quotes and (mark := MARK.search(page, at)):  # the first > that isn't quoted
                c, at = mark[0], mark.end()
                if c == ">":
                    break
                if c not in lacking and page[max(end, at - 9) : at - 1].rstrip().endswith("="):
                    closed = page.find(c, at) + 1
                    if closed:
                        at = closed
                    else:
                        lacking.add(c)
            else:  # none: quotes that hold all the rest are no quotes
                quotes = False
                at = page.find(">", end) + 1
            attributes, end = page[end : at - 1], at
        else:
            at = lt + 1
            continue
        at = end
        if lt > begin:
            yield "", False, "", page[begin:lt]
        if name in RAW_END and not tag[1]:
            # Nothing in it counts; its end tag is read like any other.
            close = RAW_END[name].search(page, at)
            at = close.start() if close else len(page)
        elif name and name not in RAW_END:
            yield name, bool(tag[1]), attributes, ""
        begin = at
    if begin < len(page):
        yield "", False, "", page[begin:]


def names(attributes: str) -> list[str]:
    """The names in class, id and role."""
    found = []
    for m in NAMES.finditer(attributes):
        found += (m[1] or m[2] or m[3] or "").split()
    return found


@lru_cache(50_000)
def _names_box(name: str, inside: bool = False) -> int:
    """0 for a name without a word that names boxes, or of a state (has-sidebar); 1 if other words
    stand beside it, 2 if none do. Inside the content a header is the content's own."""
    words = re.split(r"[^a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", name).lower())
    told = [w for w in words if w in _NAMED and not (inside and w in ("header", "masthead"))]
    if not told or words[0] in _STATES:
        return 0
    return 2 if all(w in _NAMED or w in _PLACES or not w for w in words) else 1


class Page:
    """A page's elements (in order, parents first) and its events: texts and tags with the element that they stand in."""

    def __init__(self, html: str):
        self.names, self.parents, self.attributes = [""], [-1], [""]
        self.content = [False]
        self.events: list[tuple[str, int, str]] = []  # tag or "", element around it, text
        self.words = [0]  # words that stand in the element itself
        stack, places = [0], {}
        blocks, contents = [0], [0]  # places in the stack of elements that aren't inline, or are content

        def close(depth: int) -> None:
            while len(stack) > depth:
                places[self.names[stack.pop()]].pop()
            while blocks[-1] >= depth:
                blocks.pop()
            while contents[-1] >= depth:
                contents.pop()

        for name, end, attributes, text in tokens(html):
            if not name:
                self.events.append(("", stack[-1], text))
                self.words[stack[-1]] += len(text.split())
                continue
            if end:
                at = places.get(name)
                # An inline end tag reaches no further than its block, another no further than the content.
                if at and at[-1] > (blocks[-1] if name in _INLINE else 0 if name == "p" else contents[-1] - (name in _CONTENT)):
                    close(at[-1])
                self.events.append(("/" + name, stack[-1], ""))
                continue
            top = self.names[stack[-1]]
            if top in _INLINE and name not in _INLINE and name not in _VOID and name in CLOSED_BY.get(self.names[stack[blocks[-1]]], ()):
                close(blocks[-1] + 1)
                top = self.names[stack[-1]]
            if name in CLOSED_BY.get(top, ()):
                close(len(stack) - 1)
            around = stack[-1]
            self.events.append((name, around, ""))
            if name not in _VOID and not attributes.endswith("/"):
                me = len(self.names)
                self.names.append(name)
                self.parents.append(around)
                self.attributes.append(attributes)
                self.content.append(self.content[around] or name in _CONTENT)
                self.words.append(0)
                places.setdefault(name, []).append(len(stack))
                if name not in _INLINE:
                    blocks.append(len(stack))
                if name in _CONTENT:
                    contents.append(len(stack))
                stack.append(me)

    def sizes(self) -> tuple[list[int], list[int]]:
        """For each element the words in it, and those of them in links."""
        linked = [False]
        for name, up in zip(self.names[1:], self.parents[1:], strict=True):
            linked.append(name == "a" or linked[up])
        size, links = list(self.words), [w if own else 0 for w, own in zip(self.words, linked, strict=True)]
        for i in range(len(size) - 1, 0, -1):
            size[self.parents[i]] += size[i]
            links[self.parents[i]] += links[i]
        return size, links

    def boxes(self, weights: dict) -> tuple[list[bool], list[bool]]:
        """For each element whether it is a box, and whether one that nothing could make a wrapper.

        A header inside the content is the content's own.
        """
        box, hard, root = [False], [False], [0]
        size, links = self.sizes()
        for i, (name, up, attributes) in enumerate(zip(self.names[1:], self.parents[1:], self.attributes[1:], strict=True), 1):
            root.append(root[up] or (i if name in _CONTENT else 0))  # the outermost content around it
            inside = self.content[up]
            own = name in _OUTSIDE and not (name == "header" and self.content[up])
            hard.append(own and name not in _AROUND)
            if not own and attributes and name not in ("html", "body"):
                if name not in _CONTENT:
                    told = [(2 if weights[k] < 0 else 0) if (k := ("name", n)) in weights else _names_box(n, inside) for n in names(attributes)]
                    kind = max(told, default=0)
                    own = kind > 0
                    if inside and kind == 1:
                        own = links[i] >= LINKED * size[i]
                    elif inside and kind == 2:
                        own = 2 * size[i] <= size[root[up]]
                own = own or bool(HIDDEN.search(attributes))
            box.append(own)
        return box, hard

    def shunned(self, box: list[bool]) -> list[int]:
        """For each element the innermost box around it (or itself), or 0."""
        out = [0]
        for i in range(1, len(box)):
            out.append(i if box[i] else out[self.parents[i]])
        return out

    def around(self, i: int) -> list[int]:
        out = []
        while i > 0:
            out.append(i)
            i = self.parents[i]
        return out

    def wrapped(self, box: list[bool], hard: list[bool]) -> list[bool]:
        """`box`, less those that stand around the content of a page all of whose content is in boxes."""
        inner = self.shunned(box)
        marked = [i for i, n in enumerate(self.names) if n in _CONTENT]
        if marked and any(self.words[i] and self.content[i] and not inner[i] for i in range(len(box))):
            return box
        banned = self.shunned(hard)
        if marked:
            size = list(self.words)  # of each element with all in it
            for i in range(len(size) - 1, 0, -1):
                size[self.parents[i]] += size[i]
            best = max(marked, key=lambda i: (not banned[i], size[i]))
            enough = size[best] > 0
        else:
            if any(w and not i for w, i in zip(self.words, inner, strict=True)):
                return box
            size = [0] * len(box)
            for w, i in zip(self.words, inner, strict=True):
                size[i] += w
            best = max(range(len(box)), key=lambda i: (not banned[i], size[i]))
            enough = size[best] >= WRAPPER_WORDS
        if not enough or banned[best]:
            return box
        out = list(box)
        for i in self.around(best):
            out[i] = False
        return out


    def left_out(self, weights: dict) -> list[int]:
        """For each element a number other than 0 if its words are none of the text."""
        inner = self.shunned(self.wrapped(*self.boxes(weights)))
        free = [0 if i else w for w, i in zip(self.words, inner, strict=True)]
        size = list(free)
        for i in range(len(size) - 1, 0, -1):
            size[self.parents[i]] += size[i]
        marked = [i for i, n in enumerate(self.names) if n in _CONTENT and not inner[i]]
        chosen = max(marked, key=lambda i: (size[i], -i), default=0)
        # From the largest inward, as long as one element holds most of what is left.
        for i in marked:
            if chosen in self.around(i)[1:] and 2 * size[i] > size[chosen]:
                chosen = i
        if not chosen or size[chosen] < MARKED * size[0]:
            return inner
        within = [False] * len(inner)
        for i in range(1, len(inner)):
            within[i] = i == chosen or within[self.parents[i]]
        return [x if own else x or -1 for x, own in zip(inner, within, strict=True)]


def count(html: str, counts: dict) -> None:
    """Add a labelled page's words, tags and names, inside and outside of its content."""
    page = Page(html)
    box, hard = page.boxes({})
    inner = page.shunned(page.wrapped(box, hard))

    def add(key, n: int, content: bool) -> None:
        own = counts.setdefault(key, [0, 0])
        own[0 if content else 1] += n

    inside, outside = [0] * len(box), [0] * len(box)
    for name, at, text in page.events:
        if name:
            if not inner[at]:  # what a menu is made of may well be in the content, too
                add(("tag", name), 1, page.content[at])
            continue
        n = len(text.split())
        (inside if page.content[at] else outside)[at] += n
        if n and not inner[at]:
            add(("word", page.names[at]), n, page.content[at])
    for i in range(len(box) - 1, 0, -1):
        inside[page.parents[i]] += inside[i]
        outside[page.parents[i]] += outside[i]
    for i in range(1, len(box)):
        # Elements inside the content show nothing: labels don't tell its adverts from its words.
        if not page.content[i] and page.names[i] not in ("html", "body"):
            for name in set(names(page.attributes[i])):
                add(("name", name), inside[i] or outside[i], inside[i] > 0)


def weights_of(counts: dict) -> dict:
    """Scores: words positive, tags negative, both by their log-odds to be inside content; names
    by those to stand around it, if there are enough words to tell."""
    out = {("word", None): 1.0, ("tag", None): -0.5}
    for (kind, name), (inside, outside) in counts.items():
        if kind == "name":
            if inside + outside >= NAME_PRIOR:
                prior = (0, NAME_PRIOR) if _names_box(name) else (NAME_PRIOR, 0)
                out[kind, name] = math.log((inside + prior[0] + 0.5) / (outside + prior[1] + 0.5))
            continue
        odds = math.log((inside + 0.5) / (outside + 0.5))
        out[kind, name] = min(WORD_MOST, max(WORD_LEAST, odds)) if kind == "word" else min(-TAG_COST, odds)
    return out


def best_run(scores: list[float]) -> tuple[int, int]:
    """(start, end) of the contiguous run of greatest sum; of equals the longest first one."""
    best, span, total, start = 0.0, (0, 0), 0.0, 0
    for i, s in enumerate(scores):
        if total < 0:
            total, start = 0.0, i
        total += s
        if total > best:
            best, span = total, (start, i + 1)
    return span


def extract(html: str | None, weights: dict) -> str:
    """The main text: the best region's blocks, joined by line ends."""
    if not html:
        return ""
    page = Page(html)
    inner = page.left_out(weights)
    tag, word = weights["tag", None], weights["word", None]
    scores = []
    for name, at, text in page.events:
        if name:
            # Tags of a box inside the content don't break it.
            scores.append(0.0 if inner[at] and page.content[at] else weights.get(("tag", name), tag))
        else:
            scores.append(0.0 if inner[at] else len(text.split()) * weights.get(("word", page.names[at]), word))
    start, end = best_run(scores)
    blocks, own = [], []
    for name, at, text in page.events[start:end]:
        if inner[at]:
            continue
        if not name:
            own.append(text)
        elif name.lstrip("/") == "br":
            own.append(" ")
        elif name.lstrip("/") not in _UNBROKEN:
            blocks.append("".join(own))
            own = []
    blocks.append("".join(own))
    lines = (" ".join(unescape(b).split()) for b in blocks)
    return "\n".join(x for x in lines if x)


def fit(pages: DataFrame, column: str = "html", labelled_pages: int = LABELLED_PAGES) -> dict:
    """Weights from a sample of at most about `labelled_pages` pages that mark their content."""
    labelled = pages.select(F.col(column).alias("html")).where(F.lower("html").rlike("<(article|main)[ >]"))
    total = labelled.count()
    draw = F.xxhash64("html", F.lit(5)).bitwiseAND(F.lit((1 << 40) - 1)) / float(1 << 40)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for piece in halved(batch):
                counts: dict = {}
                for page in strings(piece, "html"):
                    count(page, counts)
                rows = [(k, n, *c) for (k, n), c in counts.items()]
                cols = list(zip(*rows, strict=True)) or [[], [], [], []]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.string(), pa.int64(), pa.int64()), strict=True)], names=["kind", "name", "inside", "outside"])

    rows = labelled.where(draw < labelled_pages / max(1, total)).mapInArrow(run, "kind string, name string, inside long, outside long")
    # One row a name; the sample bounds their number, and seldom ones of classes tell nothing.
    rows = rows.groupBy("kind", "name").agg(F.sum("inside").alias("inside"), F.sum("outside").alias("outside"))
    rows = rows.where((F.col("kind") != "name") | (F.col("inside") + F.col("outside") >= NAME_PRIOR)).collect()
    return weights_of({(r.kind, r.name): (r.inside, r.outside) for r in rows})


def extract_pages(pages: DataFrame, weights: dict, column: str = "html") -> DataFrame:
    """`pages` with text and n_chars."""
    shared = pages.sparkSession.sparkContext.broadcast(weights)

    def make():
        own = shared.value

        def compute(batch):
            texts = [extract(page, own) for page in strings(batch, column)]
            return [texts, [len(t) for t in texts]]

        return compute

    return map_arrow(pages, make, [("text", T.StringType()), ("n_chars", T.LongType())])
