"""Main text of web pages by minimum-cut labelling.

A page is cut into blocks at block-level tags. A linear classifier over each block's text
and surroundings gives two costs, which become the capacities of its edges to the terminals
"content" and "boilerplate"; what elements around say fades with distance and is bounded, and
says little from outside a content tag. Neighbouring blocks, and blocks with near ancestors in
the DOM, are tied by smoothness edges. The minimum cut of that graph is the labelling. Blocks whose
own capacity outweighs all their ties are settled before the flow is computed, which does
not change the cut's value; the rest is small.

Null and empty pages, and pages without text, give an empty text. Broken markup is read as
browsers do: unclosed tags end with their parent, a tag cut off at the end (or by a quote that
never closes) is dropped. Pages are read whole, however long. Blocks whose costs tie are
boilerplate. Repeated rows give repeated results, an empty table none. Only ``page_id``, ``url``
and ``html`` are read, so other columns cannot clash.
"""

from __future__ import annotations

import html
import re
from collections import deque

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from tidemark.llm.common import table

# Kinds of tags.
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header "
    "hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead title tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg math canvas object video audio xmp noembed noframes".split())
BOILER_TAGS = frozenset("nav menu footer header aside form button select option dialog label fieldset search".split())
CONTENT_TAGS = frozenset("article main".split())
BOILER_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
BOILER_WORDS = frozenset(
    "ad ads adv advert advertisement advertising adbox banner breadcrumb breadcrumbs byline comment comments consent cookie cookies copyright disclaimer disqus footer form gdpr header "
    "hidden login masthead menu menubar modal nav navbar navigation newsletter notice notices notification overlay pager pagination paywall popup promo promoted promotion "
    "reactions recommended related replies reply respond responses share sharing sidebar sidenav signup skip social sponsor sponsored subscribe subscription tags teaser toolbar topbar widget".split()
)

# Words in class and id that name a wrapper of more than their own kind, that say
# a thing is there or not rather than here, and that name content.
WRAP_WORDS = frozenset("wrap wrapper container layout page root app site outer inner grid row theme template".split())
HOLDS_WORDS = frozenset("has have no not with without hide show".split())
CONTENT_WORDS = frozenset("article content entry post story prose text body main".split())

# An attribute's value may hold > in quotes and quotes where it is unquoted; an unclosed quote runs to the end of the page.
_VALUE = r"""(?:\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z)|(?=>)|[^\s>\"'][^\s>]*+)"""
_NAME = r"(?:=[^\s/>=]*+|[^\s/>=]++)"
TOKEN = re.compile(rf"<!--(?:-?>|.*?(?:--!?>|\Z))|<[!?][^>]*+(?:>|\Z)|</(?![a-zA-Z])[^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[\s/]++|{_NAME}(?:\s*+=\s*+{_VALUE})?+)*+)(>|\Z)", re.S)
ATTRIBUTE = re.compile(rf"({_NAME})(?:\s*+=\s*+({_VALUE}))?+")
#: Children of these are closed by the next tag of the kinds named.
ENDED_BY = {"p": BLOCK, "li": frozenset({"li"}), "dt": frozenset({"dt", "dd"}), "dd": frozenset({"dt", "dd"}), "td": frozenset({"td", "th", "tr"}), "th": frozenset({"td", "th", "tr"}), "tr": frozenset({"tr"}), "option": frozenset({"option", "optgroup"})}

#: The classifier: costs in hundredths. Positive speaks for content.
BIAS, PER_WORD, MOST_WORDS, SENTENCE, LINKED, HEADING = -60, 12, 25, 80, -400, 40
#: Cells and entries are short by their kind; links count less in a content tag; what a text says itself.
ENTRY, LINKED_INSIDE, NOTICE, POINTER = 60, -250, -480, -520
ENTRIES = frozenset("td th dt dd".split())
NOTICES = re.compile(r"(?:copyright|©|\(c\))\s*(?:©|\(c\))?\s*(?:19|20)\d\d\b|\ball rights reserved\.?$|^(?:we|this (?:web)?site|our (?:web)?site)\b.{0,40}\buses? cookies\b", re.I)
POINTERS = re.compile(r"(?:related|recommended|more from|you may also like|read next|share this|leave a (?:comment|reply)|comments?\b|subscribe|newsletter|advertisement)\b", re.I)
#: Words of a notice or of such a heading, at most.
NOTICE_WORDS, POINTER_WORDS = 30, 5
#: A page on which nothing is content is cut again with so much more for every block that elements do not speak against.
SECOND = 130
#: A name of more than boilerplate words on an element that holds running text: of the order of the ties.
PART_NAME = -130
TEXT_TAGS = frozenset("p h1 h2 h3 h4 h5 h6 li td th dt dd span em strong b i blockquote figure figcaption pre table tr tbody article main".split())
#: What an element says of the text in it: its tag, its class or id, hidden; content tags and words.
BOILER_TAG, BOILER_NAME, HIDDEN, CONTENT_TAG, CONTENT_NAME = -700, -700, -900, 400, 120
#: A wrapper's name counts so much; each level up counts so much of the one below; outside a
#: content tag, names and tags of boilerplate count so much. The sum stays inside the bounds.
WRAPPER, FADE, NAME_OUTSIDE, TAG_OUTSIDE, LEAST, MOST = 0.3, 0.92, 0.15, 0.6, -900, 500
#: Smoothness: neighbours in page order, and what the DOM's common parent adds.
NEXT, SAME_PARENT, SAME_GRANDPARENT = 60, 80, 30


class Block:
    __slots__ = ("parts", "linked", "path", "weight", "heading", "entry", "inside")

    def __init__(self, path: tuple[int, ...], weight: int, heading: bool, entry: bool = False, inside: bool = False):
        self.parts: list[str] = []
        self.linked = 0
        self.path, self.weight, self.heading, self.entry, self.inside = path, weight, heading, entry, inside


def _attributes(raw: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for name, value in ATTRIBUTE.findall(raw):
        out.setdefault(name.lower(), (value[1:].removesuffix(value[0]) if value[:1] in ("'", '"') else value).lower())
    return out


def _named(value: str, tag: str = "div") -> float:
    """What the names in a class or id say: from ``BOILER_NAME`` to ``CONTENT_NAME``.

    On elements that hold running text, a name with other words besides (share-price) says little.
    """
    found = 0.0
    for name in value.split():
        words = [w for w in re.split(r"[^a-z]+", name) if w]
        told = [w for k, w in enumerate(words) if w in BOILER_WORDS and (k == 0 or words[k - 1] not in HOLDS_WORDS)]
        if told:
            part = tag in TEXT_TAGS and len(told) < len(words)
            found = min(found, PART_NAME if part else BOILER_NAME * (WRAPPER if not WRAP_WORDS.isdisjoint(words) else 1))
        elif found == 0 and not CONTENT_WORDS.isdisjoint(words):
            found = CONTENT_NAME
    return found


def _evidence(tag: str, raw: str) -> tuple[float, float, bool]:
    """What an element says of the text in it: by its name, by its kind, and whether it is a content tag."""
    if tag in ("html", "body"):
        return 0.0, 0.0, False  # all of the page is in it
    named, role = 0.0, ""
    if raw:
        at = _attributes(raw)
        if "hidden" in at or at.get("aria-hidden") == "true" or re.search(r"display:\s*none|visibility:\s*hidden", at.get("style", "")):
            return 0.0, HIDDEN, False
        role, named = at.get("role", ""), min((_named(at[x], tag) for x in ("class", "id") if x in at), key=lambda n: (n >= 0, -abs(n)), default=0.0)
    if tag in BOILER_TAGS or role in BOILER_ROLES:
        return 0.0, BOILER_TAG, False
    content = (tag in CONTENT_TAGS or role in ("main", "article")) and named >= PART_NAME
    return named, CONTENT_TAG if content else 0.0, content


def _surroundings(stack: list[tuple[str, int, tuple[float, float, bool]]], heading: bool = False) -> int:
    """The bounded sum of what the open elements say, the innermost first.

    A content tag's own header says nothing against the headings in it.
    """
    total, share, outside, within = 0.0, 1.0, False, False
    inside = [k for k, (_, _, e) in enumerate(stack) if e[2]]
    for k in range(len(stack) - 1, -1, -1):
        tag, _, (named, kind, content) = stack[k]
        if tag == "header" and heading and inside and k > inside[0]:
            named, kind = 0.0, 0.0
        if outside:
            named, kind = named * NAME_OUTSIDE, kind * TAG_OUTSIDE if LEAST < kind < 0 else min(kind, 0.0)
        if within:  # a form in an article is a form
            named, kind = min(named, 0.0), min(kind, 0.0)
        total += share * (named + kind)
        share *= FADE
        outside, within = outside or content, within or named + kind <= BOILER_NAME * WRAPPER
    return round(max(LEAST, min(MOST, total)))


def blocks_of(page: str) -> list[Block]:
    """Text blocks in page order, each with the elements that hold it."""
    # open elements: tag, number, evidence for the text inside
    stack: list[tuple[str, int, tuple[float, float, bool]]] = []
    out: list[Block] = []
    current: Block | None = None
    count = at = links = 0

    def text(raw: str) -> None:
        nonlocal current
        if not raw:
            return
        if current is None:
            if raw.isspace():
                return
            current = Block(tuple(n for _, n, _ in stack), _surroundings(stack, heading := any(t[0] == "h" and t[1:].isdigit() for t, _, _ in stack)), heading, bool(stack) and any(t in ENTRIES for t, _, _ in stack[-3:]), any(e[2] for _, _, e in stack))
            out.append(current)
        current.parts.append(raw)
        if links:
            current.linked += len(raw.strip())

    while True:
        m = TOKEN.search(page, at)
        if m is None:
            text(page[at:])
            break
        text(page[at : m.start()])
        at = m.end()
        tag = m[2]
        if tag is None or not m[4]:
            continue
        tag = tag.lower()
        if m[1]:
            if tag in BLOCK:
                current = None
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    if tag == "a":
                        links -= 1
                    links -= sum(t == "a" for t, _, _ in stack[k + 1 :])
                    del stack[k:]
                    break
            continue
        if tag in RAW and not (tag in ("svg", "math") and m[3].endswith("/")):
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>|\Z", re.I).search(page, at)
            at = end.end()
            if tag == "title":
                current = None
            continue
        if tag in VOID:
            if tag == "hr":
                current = None
            elif tag == "br":
                text(" ")
            continue
        if tag in BLOCK:
            current = None
            while stack and tag in ENDED_BY.get(stack[-1][0], ()):
                stack.pop()
            inner = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] in BLOCK), -1)
            # inline elements left open inside a paragraph do not keep it open
            if inner >= 0 and tag in ENDED_BY.get(stack[inner][0], ()):
                links -= sum(t == "a" for t, _, _ in stack[inner:])
                del stack[inner:]
        count += 1
        stack.append((tag, count, _evidence(tag, m[3])))
        links += tag == "a"
    return out


def score(block: Block, text: str) -> int:
    """The classifier's margin: above 0 for content."""
    n = text.count(" ") + 1
    s = BIAS + block.weight + PER_WORD * min(n, MOST_WORDS)
    if text[-1:] in ".!?…\"”'":
        s += SENTENCE
    if block.heading:
        s += HEADING
    if block.entry and block.weight >= 0:
        s += ENTRY
    if n <= NOTICE_WORDS and not block.inside and NOTICES.search(text):
        s += NOTICE
    elif n <= POINTER_WORDS and block.heading and POINTERS.match(text):
        s += POINTER
    linked = LINKED_INSIDE if block.inside and block.weight > 0 else LINKED
    return s + round(linked * min(1.0, block.linked / max(1, len(text))))


def smoothness(a: Block, b: Block) -> int:
    """Capacity between two neighbouring blocks."""
    s = NEXT
    if a.path[:-1] == b.path[:-1]:
        s += SAME_PARENT
    elif a.path[:-2] == b.path[:-2]:
        s += SAME_GRANDPARENT
    return s


def min_cut(margin: list[int], edges: list[tuple[int, int, int]]) -> list[bool]:
    """Which nodes stay with the source. margin: capacity from the source if above 0, to the sink if below."""
    n = len(margin)
    near: list[dict[int, int]] = [{} for _ in range(n)]
    for a, b, c in edges:
        near[a][b] = near[a].get(b, 0) + c
        near[b][a] = near[b].get(a, 0) + c
    own = list(margin)
    label: list[bool | None] = [None] * n
    todo = deque(range(n))
    while todo:  # a node that outweighs its ties is settled, and pulls its neighbours
        a = todo.popleft()
        if label[a] is None and abs(own[a]) >= sum(near[a].values()):
            label[a] = own[a] > 0
            for b, c in near[a].items():
                del near[b][a]
                if label[b] is None:
                    own[b] += c if label[a] else -c
                    todo.append(b)
            near[a] = {}
    rest = [a for a in range(n) if label[a] is None]
    if rest:
        source, sink = n, n + 1
        cap: dict[int, dict[int, int]] = {a: dict(near[a]) for a in rest} | {source: {}, sink: {}}
        for a in rest:
            cap[source][a], cap[a][source] = max(own[a], 0), 0
            cap[a][sink], cap[sink][a] = max(-own[a], 0), 0
        seen: dict[int, int] = {}
        while True:  # shortest augmenting paths
            seen, queue = {source: source}, deque([source])
            while queue and sink not in seen:
                a = queue.popleft()
                for b, c in cap[a].items():
                    if c > 0 and b not in seen:
                        seen[b] = a
                        queue.append(b)
            if sink not in seen:
                break
            path, b = [], sink
            while b != source:
                path.append((seen[b], b))
                b = seen[b]
            push = min(cap[a][b] for a, b in path)
            for a, b in path:
                cap[a][b] -= push
                cap[b][a] += push
        for a in rest:
            label[a] = a in seen
    return [bool(x) for x in label]


def main_text(page: str | None) -> str:
    """The page's content blocks, joined by line feeds."""
    found = [(b, " ".join(html.unescape("".join(b.parts)).split())) for b in blocks_of(page or "")]
    found = [(b, t) for b, t in found if t]
    margin = [score(b, t) for b, t in found]
    edges = [(k, k + 1, smoothness(found[k][0], found[k + 1][0])) for k in range(len(found) - 1)]
    last: dict[tuple[int, ...], int] = {}
    for k, (b, _) in enumerate(found):  # blocks of one parent, other than neighbours
        before = last.get(b.path[:-1], k)
        if before < k - 1:
            edges.append((before, k, SAME_PARENT))
        last[b.path[:-1]] = k
    labels = min_cut(margin, edges)
    if not any(labels):  # such a page has no long text: short ones are judged against each other
        labels = min_cut([m + SECOND if b.weight >= 0 else m for m, (b, _) in zip(margin, found, strict=True)], edges)
    return "\n".join(t for (_, t), keep in zip(found, labels, strict=True) if keep)


def extract(pages: DataFrame) -> DataFrame:
    """Rows ``page_id, url, text, n_chars`` of every page."""

    def run(frames):
        for f in frames:
            texts = [main_text(h) for h in f["html"]]
            yield pd.DataFrame({"page_id": f["page_id"].astype("Int64"), "url": f["url"], "text": texts, "n_chars": [len(t) for t in texts]})

    return pages.select("page_id", "url", "html").mapInPandas(run, "page_id long, url string, text string, n_chars long")


def op8_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))


QUERIES = {"op8_html": op8_html}
ORACLES: dict[str, str] = {}
