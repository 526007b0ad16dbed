"""HTML extraction by maximum-scoring subsequence.

A page is a sequence of words and tags. Words score positive and tags negative,
and one linear scan finds the contiguous region of the greatest sum. A tag's
weight is learned from labelled pages, those that mark their content themselves
(one <article> or <main>): the log-odds of standing outside of the marked
content rather than inside. A tag that no labelled page has costs what all block
tags, or all others, cost together, nothing if those speak for the content; and
inside of what a page itself marks as content no tag costs anything, so tables,
lists, code and the like stay, wherever they stand in the article.

What an author calls a part is learned from the same pages: an element that
stands beside the marked content speaks against the words of its class and id,
against its role, and against its tag if HTML gives that tag a meaning; elements
inside speak for theirs. ``PRIOR`` is what is believed before a page was read,
worth ``BELIEF`` sightings. An element whose name speaks clearly against it is a
gap: it scores nothing and gives no text, wherever it stands. At most
``LABELLED`` pages teach, those of at most ``LONGEST`` characters with the least
hash of their markup.

An element that is never closed ends at the latest where a content element
begins inside it; <p>, <li> and their like end where HTML says so. Should all
text lie in gaps, gaps around a content element end there too, and should that
not help, nothing is a gap.

Defined results: null and empty pages, and pages without words, give an empty
text; repeated rows give one result each; other columns are ignored.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.session import bounded_batches, table

#: How many labelled pages the weights are fitted on, at most, and their size.
LABELLED, LONGEST = 500, 1 << 15
ATTRIBUTES = r"""(?:=\s*(?:"[^"]*"|'[^']*')|[^>])*+"""
MARKUP = re.compile(r"<(?:!--|!\[CDATA\[|[!?]|/?[a-z])", re.I)
TAG = re.compile(rf"<(?P<end>/?)(?P<name>[a-z][^\s/>]*)(?P<rest>{ATTRIBUTES})>", re.I)
UNQUOTED = re.compile(r"<(?P<end>/?)(?P<name>[a-z][^\s/>]*)(?P<rest>[^>]*)>", re.I)
#: Elements whose content is no text of the page, to the page's end if not closed; likewise, if they are closed; and whose content is text with character references, but no tags.
RAW = {"script", "style"}
DEAD = {"noscript", "template", "iframe", "title", "select", "object", "noembed", "noframes", "canvas", "audio", "video"}
PLAIN = {"textarea"}
CLOSERS = {n: re.compile(rf"</{n}\s*>", re.I) for n in RAW | DEAD | PLAIN}
ATTRIBUTE = re.compile(r"""(?:^|(?<=[\s"'/]))(class|id|role|aria-hidden|hidden|style)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)|(?=[\s/]|$))""", re.I)
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
BLOCKS = {"p", "div", "h1", "h2", "h3", "h4", "h5", "h6", "li", "ul", "ol", "dl", "dt", "dd", "table", "thead", "tbody", "tfoot", "tr", "caption", "section", "article", "main", "blockquote", "pre", "figure", "figcaption", "hr", "address", "details", "summary", "header", "footer", "nav", "aside", "form", "fieldset", "menu", "dialog", "body", "html", "center", "hgroup"}
VOID = {"br", "hr", "img", "input", "meta", "link", "area", "base", "col", "embed", "source", "track", "wbr", "param"}
CONTENT = {"article", "main"}
#: Tags to which HTML gives the meaning of a part of a page, and what an author may call one. Believed before any page is read.
MEANING = {"nav", "footer", "aside", "form", "button", "header", "menu", "dialog", "label", "fieldset"}
PRIOR = {
    "ad", "ads", "advert", "advertisement", "sponsor", "sponsored", "promo", "banner", "sidebar", "nav", "navbar", "navigation", "menu", "breadcrumb", "breadcrumbs", "footer", "header", "masthead",
    "comment", "comments", "replies", "cookie", "cookies", "consent", "notice", "popup", "newsletter", "subscribe", "signup", "login", "share", "social", "related", "recommended", "pagination", "copyright", "disclaimer",
}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "menu", "menubar", "dialog", "alert", "alertdialog", "toolbar"}
#: Words that say where or how big a part is, not what it is.
LAYOUT = {"main", "site", "page", "top", "bottom", "left", "right", "bar", "box", "list", "item", "container", "wrapper", "wrap", "inner", "block", "section", "area", "slot", "widget", "links", "primary", "secondary", "body", "text", "content", "panel", "group", "row", "col", "column", "module", "holder", "outer", "thread"}
BELIEF, CLEAR, STEEP = 9, 1.5, 6.0
#: Tags of the document itself say nothing about others.
FRAME = {"html", "head", "body", "meta", "link", "base", "article", "main"}
#: Elements whose end tag may be left out: the tags whose start ends them, and what their search stops at.
CELLS = {"td", "th", "tr", "tbody", "thead", "tfoot"}
ENDED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": CELLS, "th": CELLS, "tr": CELLS - {"td", "th"}, "tbody": CELLS - {"td", "th", "tr"}, "thead": CELLS - {"td", "th", "tr"}, "tfoot": CELLS - {"td", "th", "tr"}, "p": BLOCKS}
OPTIONAL = {*ENDED_BY, "html", "body", "head", "option", "colgroup", "caption"}
STOPS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "p": BLOCKS - {"p"}, **dict.fromkeys(CELLS, {"table"})}


class Element:
    __slots__ = ("name", "features", "up", "begin", "marked", "closed", "limit", "gap", "ends")

    def __init__(self, name: str, features: list[list[str]], up: Element | None, begin: int, marked: bool = False):
        self.name, self.features, self.up, self.begin, self.marked = name, features, up, begin, marked  # marked: within a content element
        self.closed, self.limit, self.gap, self.ends = name in OPTIONAL, None, False, (0.0, 0.0)


def features(name: str, attributes: str, inside: bool) -> list[list[str]]:
    """What the element is called, each name as its telling words."""
    out = [[f"<{name}"]] if name in MEANING and not (inside and name == "header") else []
    for key, value in ATTRIBUTE.findall(attributes) if attributes else ():
        key, value = key.lower(), value.strip("\"'")
        if key in ("class", "id"):
            for one in value.split():
                words = [w.lower() for w in WORDS.findall(one)]
                if telling := [w for w in words if w not in LAYOUT]:
                    out.append(telling)
        elif key == "role":
            out.append(["role=" + value.lower()])
        elif key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "style" and re.search(r"display\s*:\s*none", value, re.I):
            out.append(["hidden"])
    return out


def tokens(page: str) -> Iterator[tuple[str, str, str]]:
    """('text', raw, ''), ('data', plain, ''), ('open' or 'close', name, attributes) in order. Every step moves on, and a search that has failed is not repeated, so a page takes linear time however it is broken."""
    at, place, size, tag, missing = 0, 0, len(page), TAG, set()
    while (m := MARKUP.search(page, place)) is not None:
        begin, kind, data = m.start(), m[0], ""
        if kind[1] in "!?":
            stop = {"<!--": "-->", "<![CDATA[": "]]>"}.get(kind.upper() if len(kind) > 4 else kind, ">")
            end = page.find(stop, m.end())
            if end < 0 and stop == ">":
                break
            data = page[m.end() : end if end >= 0 else size] if stop == "]]>" else ""
            place = end + len(stop) if end >= 0 else size
            tokens_ = [("data", data, "")] if data else []
        else:
            t = tag.match(page, begin)
            if t is None:  # a quote that is never closed: from here on quotes mean nothing
                tag = UNQUOTED
                if (t := tag.match(page, begin)) is None:
                    break  # no tag ends any more
            name, place = t["name"].lower(), t.end()
            tokens_ = [("close" if t["end"] else "open", name, t["rest"])]
            if name in CLOSERS and not t["end"]:
                found = None if name in missing else CLOSERS[name].search(page, place)
                if found is not None:
                    tokens_ = [("open", name, t["rest"]), ("text", page[place : found.start()], ""), ("close", name, "")] if name in PLAIN else []
                    place = found.end()
                elif name in RAW:
                    tokens_, place = [], size
                else:
                    missing.add(name)
        if begin > at:
            yield "text", page[at:begin], ""
        yield from tokens_
        at = place
    if at < size:
        yield "text", page[at:], ""


#: Elements that decide what an omitted end tag means; only these are looked at when another begins.
MARKS = set(ENDED_BY) | (BLOCKS - OPTIONAL)
ENDING = set().union(*ENDED_BY.values())


def parse(page: str) -> tuple[list[tuple[str, str, Element | None]], list[Element]]:
    """The sequence of ('text', raw), ('open' and 'close', tag) with the element each stands in (a tag: its own), and the elements in order."""
    seq: list[tuple[str, str, Element | None]] = []
    stack: list[Element] = []
    elements: list[Element] = []
    places: dict[str, list[int]] = {}  # of the open elements of each name
    marks: list[int] = []
    inside = limited = 0  # open content elements; elements of the stack from its bottom that have their limit

    def cut(k: int) -> None:
        nonlocal inside, limited
        for e in stack[k:]:
            places[e.name].pop()
            inside -= e.name in CONTENT
        while marks and marks[-1] >= k:
            marks.pop()
        del stack[k:]
        limited = min(limited, k)

    def top(name: str) -> int:
        return places[name][-1] if places.get(name) else -1

    for kind, name, rest in tokens(page):
        here = stack[-1] if stack else None
        if kind in ("text", "data"):
            seq.append(("text", html.escape(name) if kind == "data" else name, here))
            continue
        if kind == "close":
            k = top(name)
            if k > max((top(x) for x in STOPS.get(name, ())), default=-1):
                stack[k].closed = True
                seq.append(("close", name, stack[k]))
                cut(k)
            else:
                seq.append(("close", name, here))
            continue
        if name in ENDING:
            for k in reversed(marks):
                own = stack[k].name
                if name in ENDED_BY.get(own, ()):
                    cut(k)
                elif own in STOPS.get(name, ()) and name != "p" or own in BLOCKS and own not in OPTIONAL:
                    break
        e = Element(name, features(name, rest, inside > 0), stack[-1] if stack else None, len(seq), inside > 0)
        elements.append(e)
        seq.append(("open", name, e))
        if name in CONTENT:
            for x in stack[limited:]:
                x.limit = len(seq) - 1
            limited = len(stack)
        if name not in VOID and not rest.endswith("/"):
            places.setdefault(name, []).append(len(stack))
            if name in MARKS:
                marks.append(len(stack))
            stack.append(e)
            inside += name in CONTENT
        else:
            e.closed = True
    return seq, elements


def believed(word: str) -> bool:
    return word in PRIOR or word[1:] in MEANING or word[5:] in ROLES or word == "hidden"


class Model:
    """Weights of tags, and for or against names."""

    def __init__(self, pages: list[str]):
        self.beside, self.within, self.weights = Counter(), Counter(), {}
        parsed = [parse(p) for p in pages]
        for seq, elements in parsed:
            marked = [e for e in elements if e.name in CONTENT]
            if len(marked) != 1:
                continue
            around, e = set(), marked[0].up
            while e is not None:
                around.add(id(e))
                e = e.up
            inner, held = {id(marked[0])}, Counter()
            for kind, x, e in seq:
                if kind == "text" and e is not None:
                    held[id(e)] += len(x.split())
            for e in reversed(elements):
                if e.up is not None:
                    held[id(e.up)] += held[id(e)]
            for e in elements:
                if e is marked[0] or id(e) in around:
                    continue
                if e.up is not None and id(e.up) in inner:
                    inner.add(id(e))
                    most = 2 * held[id(e)] > held[id(marked[0])]  # marked content has adverts and comments in it: these names must hold it to be cleared
                    self.within.update(w for x in e.features for w in x if most or not believed(w))
                elif e.up is None or id(e.up) in around:  # beside the content; what stands in it is not to blame
                    self.beside.update(w for x in e.features for w in x)
        out, into = Counter(), Counter()
        for seq, elements in parsed:
            self.mark(elements)
            depth = 0
            for k, (kind, x, e) in enumerate(seq):
                if kind == "text" or self.hidden(e, k):
                    continue
                if kind == "close" and x in CONTENT:
                    depth = max(0, depth - 1)
                (into if depth else out)["/" * (kind == "close") + x] += 1
                if kind == "open" and x in CONTENT:
                    depth += 1
        self.weights = {k: -max(0.05, STEEP * math.log((out[k] + 1) / (into[k] + 1))) for k in out | into}
        #: Of tags that were not seen: what all block tags and all others say together, nothing if none was seen.
        self.unseen = {}
        for block in (True, False):
            own = [k for k in out | into if (k.strip("/") in BLOCKS) == block and k.strip("/") not in FRAME]
            self.unseen[block] = -max(0.0, STEEP * math.log((sum(out[k] for k in own) + 1) / (sum(into[k] for k in own) + 1)))

    def price(self, kind: str, tag: str, e: Element | None) -> float:
        """What a tag costs; nothing inside of what the page marks as its content."""
        if e is not None and e.marked:
            return 0.0
        key = "/" * (kind == "close") + tag
        return self.weights[key] if key in self.weights else self.unseen[tag in BLOCKS]

    def against(self, word: str) -> float:
        """Log-odds of standing beside the content; 0 for a word that nothing is known of."""
        belief = BELIEF * believed(word)
        return math.log((self.beside[word] + belief + 0.5) / (self.within[word] + 0.5)) if belief or self.beside[word] or self.within[word] else 0.0

    def mark(self, elements: list[Element]) -> None:
        """Finds the gaps, and for every element up to where in the sequence it lies in one: as closed elements say, and as if none was closed."""
        for e in elements:
            e.gap = any(sum(map(self.against, x)) > CLEAR * len(x) for x in e.features)
            closed, all_end = e.up.ends if e.up is not None else (0.0, 0.0)
            if e.gap:
                limit = math.inf if e.limit is None else e.limit
                closed, all_end = max(closed, math.inf if e.closed else limit), max(all_end, limit)
            e.ends = closed, all_end

    @staticmethod
    def hidden(e: Element | None, k: int, all_end: bool = False) -> bool:
        """Whether place k of the sequence, in element e, lies in a gap."""
        return e is not None and k < e.ends[all_end]


def best(scores: list[float]) -> tuple[int, int]:
    """The contiguous range of the greatest sum, the first and longest of equals; empty if none is positive."""
    top, out, total, begin = 0.0, (0, 0), 0.0, 0
    for k, s in enumerate(scores):
        if total < 0:
            total, begin = 0.0, k
        total += s
        if total > top or total == top > 0 and begin == out[0]:
            top, out = total, (begin, k + 1)
    return out


def region(seq: list, hidden: list[bool], model: Model) -> tuple[int, int]:
    return best([0.0 if gap else float(len(x.split())) if kind == "text" else model.price(kind, x, e) for (kind, x, e), gap in zip(seq, hidden)])


def extract(page: str, model: Model, gaps: bool = True) -> str:
    seq, elements = parse(page)
    model.mark(elements)
    hidden = [gaps and model.hidden(e, k) for k, (_, _, e) in enumerate(seq)]
    a, b = region(seq, hidden, model)
    if b <= a and any(hidden):
        hidden = [model.hidden(e, k, True) for k, (_, _, e) in enumerate(seq)]
        a, b = region(seq, hidden, model)
        if b <= a and not any(e.closed and e.gap for e in elements):
            hidden = [False] * len(seq)
            a, b = region(seq, hidden, model)
    blocks, held = [], []

    def end() -> None:
        if held:
            if line := " ".join(html.unescape("".join(held)).split()):
                blocks.append(line)
            held.clear()

    for (kind, x, _), gap in zip(seq[a:b], hidden[a:b]):
        if kind != "text":
            if x in BLOCKS:
                end()
            elif x in ("br", "td", "th", "img"):
                held.append(" ")
        elif not gap:
            held.append(x)
    end()
    return "\n".join(blocks)


def fit(pages: DataFrame, html_col: str = "html", bound: int = LABELLED) -> Model:
    low = F.lower(F.col(html_col))
    marks = sum((F.size(F.split(low, f"<{t}[\\s>]")) - 1 for t in sorted(CONTENT)), F.lit(0))
    marked = pages.select(F.col(html_col).alias("page"), F.xxhash64(html_col).alias("h")).filter(marks == 1).filter(F.length("page") <= LONGEST)
    last = marked.select("h").orderBy("h").limit(bound).agg(F.max("h")).first()[0]
    return Model([r.page for r in marked.filter(F.col("h") <= last).limit(bound).collect()] if last is not None else [])


def extract_all(spark: SparkSession, pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", bound: int = LABELLED) -> DataFrame:
    """Per page: page_id, url, text, n_chars."""
    bounded_batches(spark)
    model = fit(pages, html_col, bound)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            for lo in range(0, x.num_rows, 256):
                part = x.slice(lo, 256)
                texts = [extract(p.as_py() or "", model) for p in part.column(2)]
                yield pa.record_batch([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html")).mapInArrow(run, "page_id long, url string, text string, n_chars long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_all(spark, table(spark, sf_dir, "pages"))
