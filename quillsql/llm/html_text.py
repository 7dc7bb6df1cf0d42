"""Main text of web pages by a maximum-scoring subsequence.

A page becomes a row of tokens: words score positive, tags negative, words inside elements that labelled
pages show to be boilerplate score nothing. One linear scan finds the contiguous region of the highest
score; where a learned content element encloses it, the region grows to that element. The weights are log
odds counted on labelled pages (pieces of HTML, each marked as main text or not).
"""

from __future__ import annotations

import html as html_lib
import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed values of HTML: elements without an end tag, with raw text, and those that make blocks of their own.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript iframe template textarea title svg math object audio video canvas select xmp".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody tfoot thead tr ul caption".split()
)
SCOPES = BLOCK - {"p", "h1", "h2", "h3", "h4", "h5", "h6", "hr", "dt", "dd"}
KEPT = frozenset("html body main article".split())
#: Name parts that say how a page is laid out or what state it is in, and so nothing of the element they stand on.
MODIFIERS = frozenset("has no with without open closed enabled disabled".split())
NEUTRAL = frozenset({"site"})
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
SPACED = frozenset("br td th img option".split())

TAG = re.compile(r"<(/?)([A-Za-z][^\s/>]*+)((?:[^\"'>]++|\"[^\"]*+\"|'[^']*+')*+)>")
NAMES = re.compile(r"""(?i)(?<![\w-])(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
PARTS = re.compile(r"[A-Za-z][a-z]*|[A-Z]+")

WORDS = "the river bends where old stones hold cold water and small boats wait for morning light near quiet fields".split()
#: Class names by which labelled pages mark their parts.
OUTSIDE = (
    ("nav", "nav menu"), ("ul", "menu navbar"), ("div", "breadcrumb breadcrumbs"), ("header", "header masthead"), ("div", "site header banner"),
    ("footer", "footer"), ("div", "footer copyright legal"), ("aside", "sidebar"), ("div", "sidebar widget"), ("div", "related recommended"),
    ("div", "share social"), ("div", "ad ads"), ("div", "advert advertisement"), ("section", "sponsor sponsored promo"), ("div", "cookie consent"),
    ("div", "notice notices"), ("div", "newsletter subscribe"), ("form", "form search"), ("form", "login signup"), ("section", "comments comment"),
    ("div", "comments respond reply"), ("ol", "commentlist"), ("div", "popup modal"), ("div", "pagination pager"), ("div", "alert gdpr privacy"),
    ("dialog", "overlay"), ("button", "button"), ("div", "toolbar"), ("div", "disqus thread"), ("label", "label"),
)
INSIDE = (
    ("article", ""), ("main", ""), ("div", "content"), ("div", "article body"), ("div", "post entry"), ("section", "story text"), ("div", "main"),
)


def labelled_pages() -> list[list[tuple[str, bool]]]:
    """Pages as rows of (HTML, whether it is main text), made from the parts above by rule."""
    pages = []
    for k in range(3 * len(OUTSIDE)):
        tag, names = INSIDE[k % len(INSIDE)]
        text = [" ".join(WORDS[(k + 3 * i + j) % len(WORDS)] for j in range(12 + (k * 7 + i) % 20)) for i in range(4)]
        body = f"<h1>{text[0][:40]}</h1><p>{text[1]}</p><h2>{text[2][:20]}</h2><p><b>{text[2]}</b> <i>more</i><br><a>{text[0]}</a></p><ul><li>{text[3]}</li></ul>"
        outside = []
        for n in range(3):
            o_tag, o_names = OUTSIDE[(k + n * 11) % len(OUTSIDE)]
            name = o_names.split()[k % len(o_names.split())]
            links = "".join(f"<li><a>{w}</a></li>" for w in WORDS[k % 5 : k % 5 + 4])
            outside.append((f'<{o_tag} class="{name}"><ul>{links}</ul><span>{text[n][:30]}</span></{o_tag}>', False))
        head = "<head><title>t</title><style>p{}</style><script>x</script></head>"
        pages.append([(head, False), outside[0], (f'<{tag} class="{names}">{body}</{tag}>', True), outside[1], outside[2]])
    return pages


@dataclass
class Element:
    tag: str
    start: int
    end: int = -1
    weight: float = 0.0
    off: bool = False
    p_at: int = -1
    parent: Element | None = None
    negative: bool = False  # the names of an article or main, whose weight leaves them out

    @property
    def content(self) -> bool:
        return self.tag in SCOPES and self.weight > 0.7 and not self.negative


@dataclass
class Model:
    """Log odds by feature (a tag's name, or a class word with a dot before it), and of a word."""

    weights: dict[str, float] = field(default_factory=dict)
    word: float = 1.0

    def element(self, tag: str, attributes: str) -> float:
        """Of one element: its tag's and its names' weights."""
        return self.weights.get(tag, 0.0) + (0.0 if tag in KEPT else self.names(attributes))

    def names(self, attributes: str) -> float:
        """In a name of several words (comment-body) the least counts; names of one element add up; has-sidebar is no name of a part."""
        weight = 0.0
        if "=" in attributes:
            for m in NAMES.finditer(attributes):
                for name in (m[1] or m[2] or m[3] or "").split():
                    parts = [w.lower() for w in PARTS.findall(name)]
                    if not MODIFIERS.isdisjoint(parts):
                        continue
                    known = [self.weights[k] for w in parts if w not in NEUTRAL and (k := f".{w}") in self.weights]
                    weight += min(known, default=0.0)
        return weight


def tags(page: str) -> Iterator[tuple[str, str, str]]:
    """(kind, name or text, attributes) of a page: kind is text, open or close; raw elements are left out."""
    at, last = 0, page.rfind(">")
    pending: list[str] = []
    while at < len(page):
        lt = page.find("<", at)
        if lt < 0 or lt > last:
            pending.append(page[at:])
            break
        pending.append(page[at:lt])
        if page.startswith("<!--", lt):
            end = page.find("-->", lt + 4)
            at = len(page) if end < 0 else end + 3
            continue
        if page.startswith(("<!", "<?"), lt):
            at = page.find(">", lt) + 1
            continue
        m = TAG.match(page, lt)
        if not m:
            if not re.match(r"</?[A-Za-z]", page[lt : lt + 3]):
                pending.append("<")
                at = lt + 1
                continue
            end = page.find(">", lt)
            m = re.match(r"<(/?)([A-Za-z][^\s/>]*)(.*)>\Z", page[lt : end + 1], re.S)
        at = lt + len(m[0])
        if pending and (text := "".join(pending)):
            yield "text", text, ""
        pending = []
        name = m[2].lower()
        if m[1]:
            yield "close", name, ""
            continue
        if name in RAW and not m[3].endswith("/"):
            end = re.compile(rf"</{name}\b[^>]*>?", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        yield "open", name, m[3]
    if text := "".join(pending):
        yield "text", text, ""


def scan(page: str, model: Model) -> tuple[list[tuple], list[Element]]:
    """(tokens, elements): tokens are (kind, text or tag, score, the innermost element)."""
    tokens: list[tuple] = []
    root = Element("", 0)
    stack, opened, elements = [root], Counter(), []

    def pop_to(depth: int) -> None:
        while len(stack) > depth:
            gone = stack.pop()
            opened[gone.tag] -= 1
            gone.end = len(tokens)

    for kind, what, attributes in tags(page):
        top = stack[-1]
        if kind == "text":
            tokens.append(("text", what, model.word * len(what.split()), top))
        elif kind == "close":
            if opened[what]:
                depth = len(stack) - 1
                while stack[depth].tag != what:
                    depth -= 1
                pop_to(depth)
            tokens.append(("tag", what, min(-0.05, model.weights.get(what, 0.0)), stack[-1]))
        else:
            if what in BLOCK and stack[-1].p_at >= 0:
                pop_to(stack[-1].p_at)
            if what == "li":
                for depth in range(len(stack) - 1, max(0, len(stack) - 8), -1):
                    if stack[depth].tag in ("ul", "ol", "menu"):
                        break
                    if stack[depth].tag == "li":
                        pop_to(depth)
                        break
            top, weight = stack[-1], model.element(what, attributes)
            tokens.append(("tag", what, max(-8.0, min(-0.05, weight)), top))
            if what not in VOID and not attributes.endswith("/"):
                own = Element(what, len(tokens), weight=weight, parent=top, negative=what in KEPT and model.names(attributes) < -1.0)
                own.p_at = len(stack) if what == "p" else -1 if what in SCOPES else top.p_at
                stack.append(own)
                opened[what] += 1
                elements.append(own)
    pop_to(1)
    switch_off(tokens, elements)
    return [(kind, what, 0.0 if kind == "text" and e.off else score, e) for kind, what, score, e in tokens], elements


def switch_off(tokens: list[tuple], elements: list[Element]) -> None:
    """Mark the elements whose words don't count: those of negative weight and what stands in them.

    An article's header with a heading stays. If a content element in an element that is off holds more words
    than all content elements that are on, the page's boxes are misnamed: content elements are then on again.
    Elements off by weight that hold most words of a page without content elements are on as well.
    """
    words = list(accumulate((len(what.split()) if kind == "text" else 0 for kind, what, _, _ in tokens), initial=0))
    headings = list(accumulate((kind == "tag" and what in HEADINGS for kind, what, _, _ in tokens), initial=0))
    in_article: dict[int, bool] = {}

    def mark(again: bool, wide: bool) -> None:
        for e in elements:
            up = e.parent
            in_article[id(e)] = e.tag == "article" or in_article.get(id(up), False)
            titled = e.tag in ("header", "hgroup") and in_article[id(e)] and headings[e.end] > headings[e.start]
            most = wide and e.tag in ("div", "section") and 2 * (words[e.end] - words[e.start]) > words[-1]
            e.off = not (again and e.content) and (up.off or e.weight < -1.0 and not titled and not most)

    mark(False, False)
    content = [e for e in elements if e.content]
    inside: dict[int, bool] = {}
    for e in elements:
        inside[id(e)] = e.content and not e.off or inside.get(id(e.parent), False)
    shown = sum(len(what.split()) for kind, what, _, e in tokens if kind == "text" and not e.off and inside.get(id(e), False))
    if any(e.off and words[e.end] - words[e.start] > shown for e in content):
        mark(True, False)
    elif not content:
        mark(False, True)


def best_region(scores: Iterable[float]) -> tuple[int, int]:
    """[start, end) of the contiguous run with the highest positive sum, the first of equals; (0, 0) if none."""
    best, found, total, start = 0.0, (0, 0), 0.0, 0
    for i, score in enumerate(scores):
        if total <= 0:
            total, start = 0.0, i
        total += score
        if total > best:
            best, found = total, (start, i + 1)
    return found


def main_text(page: str | None, model: Model) -> str:
    """The main text: blocks in page order, one a line; '' for null, empty or textless pages."""
    tokens, elements = scan(page or "", model)
    start, end = best_region(t[2] for t in tokens)
    around = [e for e in elements if e.weight > 0.7 and not e.off and e.tag in SCOPES and e.start <= start and end <= e.end]
    if around:
        start, end = around[-1].start, around[-1].end
    blocks, open_block = [], []
    for kind, what, _, element in tokens[start:end]:
        if kind == "text":
            if not element.off:
                open_block.append(html_lib.unescape(what))
        elif what in BLOCK:
            blocks.append("".join(open_block))
            open_block = []
        elif what in SPACED:
            open_block.append(" ")
    blocks.append("".join(open_block))
    return "\n".join(b for b in (" ".join(b.split()) for b in blocks) if b)


def fit(pages: Iterable[list[tuple[str, bool]]], max_pages: int = 10_000) -> Model:
    """Count log odds on at most max_pages labelled pages; more are refused."""
    inside, outside, words = Counter(), Counter(), Counter()
    for n, page in enumerate(pages):
        if n >= max_pages:
            raise ValueError(f"more than {max_pages} labelled pages")
        for piece, main in page:
            count = inside if main else outside
            seen: Counter = Counter()
            for kind, what, attributes in tags(piece):
                if kind == "text":
                    words[main] += len(what.split())
                elif kind == "open":
                    seen[what] = 1
                    for m in NAMES.finditer(attributes):
                        for name in PARTS.findall(m[1] or m[2] or m[3] or ""):
                            seen[f".{name.lower()}"] = 1
            count.update(seen)
    weights = {k: math.log((inside[k] + 0.5) / (outside[k] + 0.5)) for k in inside.keys() | outside.keys()}
    # plain boxes stand on both sides; that pages have more boxes outside than inside says nothing of one box
    for k in ("div", "section", "ul", "ol", "li", "a", "span", "p"):
        weights[k] = max(-0.5, min(0.0, weights.get(k, 0.0)))
    return Model(weights, math.log(1 + words[True] / (1 + words[False])))


def extract(pages: DataFrame, model: Model | None = None, html: str = "html") -> DataFrame:
    """pages with main_text and main_chars added (replacing columns of those names), one row for each row.

    A null html counts as empty and gives ''. Repeated rows give equal texts; an empty table stays empty.
    """
    model = model or fit(labelled_pages())
    keep = pages.drop("main_text", "main_chars")
    schema = T.StructType(list(keep.schema.fields)).add("main_text", "string").add("main_chars", "long")

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(html)
            texts = [main_text(x.as_py(), model) for x in batch.column(at)]
            out = [*batch.columns, pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(out, [*batch.schema.names, "main_text", "main_chars"])

    return keep.withColumn(html, F.col(html).cast("string")).mapInArrow(work, schema)
