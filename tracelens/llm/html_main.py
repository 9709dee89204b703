"""Operator 4: the main text of web pages by two-pass block rules.

A tokenizer walks the markup once, keeps a stack of open elements (with the end tags that HTML lets pages leave out) and
cuts the page into blocks at block-level tags. The first pass classes each block by its length, its share of linked
characters and its density of stop words; short blocks whose class is open take, in the second pass, the class of the
nearest decided neighbours. The good blocks are joined by one space.

Elements by whose tag, role, class or id a page says that they are something else (menus, headers, footers, sidebars,
notices, adverts, forms, reader comments) are left out, unless they turn out to hold the page: those around the article
or the first heading, and those beside which there is next to no text. A class name counts only if all its parts are
such words (``cookie-notice``, not ``has-sidebar``). ``article`` and ``main`` are evidence of the same kind: where they
hold most of the good text, blocks outside are bad; otherwise they count for nothing.

Null, empty and text-free pages give an empty string. Nothing is capped: pages of any length are read whole. Repeated
rows give repeated rows.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, texts_of

BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead title tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is text up to their own end tag.
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes template".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: What a start tag ends: elements that may be open, and those beyond which it doesn't reach.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"}), "optgroup": ({"option", "optgroup"}, {"select"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tr": ({"tr"}, {"table"}), "tbody": ({"thead", "tbody", "caption"}, {"table"}), "tfoot": ({"thead", "tbody"}, {"table"}),
}
CELLS = frozenset("td th caption table".split())
#: Parts of a page by tag, role, and by words of class names and ids.
TAGS = {"nav": "menu", "menu": "menu", "footer": "footer", "aside": "sidebar", "header": "header", "form": "form", "fieldset": "form", "figcaption": "header", **dict.fromkeys("button select dialog head svg math object canvas audio video map".split(), "never")}
ROLES = {"navigation": "menu", "menu": "menu", "menubar": "menu", "toolbar": "menu", "banner": "header", "contentinfo": "footer", "complementary": "sidebar", "search": "form", "form": "form", "dialog": "never", "alertdialog": "never", "alert": "notice"}
WORDS = {
    **dict.fromkeys("comment comments commentlist commenter discussion disqus feedback replies reply respond shoutbox".split(), "comment"),
    **dict.fromkeys("ad ads adv advert adverts advertisement advertising adsense carousel promo promoted promotion recommended related sponsor sponsored subscribe subscription newsletter signin signup login register share sharing social teaser tracking".split(), "advert"),
    **dict.fromkeys("breadcrumb breadcrumbs masthead menu menus nav navbar navigation pager pagination skip tags toolbar topbar".split(), "menu"),
    **dict.fromkeys("sidebar sidebars widget widgets".split(), "sidebar"), **dict.fromkeys("footer footnav".split(), "footer"), **dict.fromkeys("header byline".split(), "header"),
    **dict.fromkeys("banner cookie cookies consent copyright disclaimer gdpr legal notice notices notification popup overlay modal".split(), "notice"), **dict.fromkeys("captcha form search".split(), "form"),
    **dict.fromkeys("hidden dialog".split(), "never"),
}
#: Words that may stand beside those.
BESIDE = frozenset("area bar block body bottom box btn button buttons card center column container content fixed global group heading icons inner item items left link links list main message news page panel part post posts primary right row secondary section site slot small sticky stories sub text thread title top unit user wrap wrapper zone".split())
#: Frequent function words of English, German, French and Spanish.
STOP = frozenset(
    "the of and to a in is it that for on with as are was be by this from or at an not he his they you which but have had were their has its been who will would there she her we i all can if no more when out so what up about into than them some could time these two may then do first any my now such like our over me even most made after also did many must before through back years where much your way well down should because each just those people too own "
    "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über einen so zum war haben nur oder aber vor zur bis mehr durch man sein wurde wenn "
    "de la le et les des en un une du est que qui dans pour pas sur au par plus ne se ce il avec son sa ou ses sont être mais aux elle nous cette ils été deux même ont comme tout leur fait lui bien sans si peut "
    "el los que y del se las por con para una su al lo como más pero sus le ya o este sí porque esta entre cuando muy sin sobre también me hasta hay donde quien desde todo nos durante todos uno les ni contra otros ese eso ante ellos".split()
)
TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*>?|</?([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|</?([a-zA-Z][a-zA-Z0-9:-]*)[^<>]*(?=<|$)>?", re.S)
NAMED = re.compile(r"class|id\s*=|role|hidden|style", re.I)
ATTRIBUTE = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")
WHITE = re.compile(r"\s+")
WORD = re.compile(r"\w+")

#: Limits of the first pass: linked share, short and long blocks (code points), stop-word densities.
LINKED, SHORT, LONG, FEW_STOPS, MANY_STOPS = 0.33, 70, 200, 0.12, 0.22
#: Times the text outside that a part must hold to be the page; share of good text that makes articles the page.
HOLDS, MOST = 4, 0.5


def named_kind(name: str) -> str:
    """What a single class name or id says its element is; empty if it doesn't."""
    parts = [x for x in re.split(r"[\s_-]+", re.sub(r"(?<=[a-z])(?=[A-Z])", "-", name).lower()) if x and not x.isdigit()]
    kinds = [WORDS[x] for x in parts if x in WORDS]
    return kinds[0] if kinds and all(x in WORDS or x in BESIDE for x in parts) else ""


def kind_of(tag: str, attributes: str, in_article: bool) -> str:
    """What an element says it is: a kind of part, or empty. An article's own header and captions belong to it."""
    if tag in TAGS and not (in_article and tag in ("header", "figcaption")):
        return TAGS[tag]
    if not attributes or tag in ("html", "body") or not NAMED.search(attributes):
        return ""
    for m in ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name == "role" and (kind := ROLES.get(value.strip().lower())):
            return kind
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true" and tag != "span" or name == "style" and UNSEEN.search(value.lower()):
            return "never"
        if name in ("class", "id"):
            for kind in filter(None, map(named_kind, value.split())):
                if tag not in ("article", "main") or kind in ("comment", "advert"):
                    return kind
    return ""


class Part:
    """An element that says it is something else than the article."""

    def __init__(self, kind: str):
        self.kind, self.out = kind, True

    def meets(self, tag: str) -> None:
        """Something inside shows that the element is only around the article."""
        if tag in ("main", "article") and self.kind not in ("comment", "advert", "never", "sidebar") or tag == "h1" and self.kind in ("form", "notice"):
            self.out = False


class Block:
    def __init__(self, text: str, linked: int, heading: bool, article: int, parent: int, parts: tuple):
        self.text, self.linked, self.heading, self.article, self.parent, self.parts = text, linked, heading, article, parent, parts
        self.first = self.label = ""

    @property
    def out(self) -> bool:
        return any(p.out for p in self.parts)


class Walk:
    """Blocks of a page in its order."""

    def __init__(self):
        self.blocks: list[Block] = []
        self.open: list[tuple] = []  # tag, number, article, part
        self.count: Counter = Counter()
        self.parts: list[Part] = []
        self.pieces: list[str] = []
        self.linked = self.anchors = self.number = 0
        self.heading = ""

    def flush(self) -> None:
        text = WHITE.sub(" ", html.unescape("".join(self.pieces))).strip() if self.pieces else ""
        if text:
            article = next((x[2] for x in reversed(self.open) if x[2]), 0)
            parent = next((x[1] for x in reversed(self.open) if x[0] not in HEADINGS and x[0] not in ("p", "li", "blockquote", "pre")), 0)
            self.blocks.append(Block(text, self.linked, bool(self.heading), article, parent, tuple(self.parts)))
        self.pieces.clear()
        self.linked = 0

    def text(self, piece: str) -> None:
        if any(p.kind == "never" for p in self.parts):
            return
        self.pieces.append(piece)
        if self.anchors:
            self.linked += len(WHITE.sub(" ", html.unescape(piece)).strip())

    def close_to(self, depth: int) -> None:
        self.flush()
        for tag, _, _, part in self.open[depth:]:
            self.count[tag] -= 1
            if part:
                self.parts.remove(part)
            if tag in HEADINGS:
                self.heading = ""
        del self.open[depth:]

    def end_implied(self, ended, bounds) -> None:
        if any(self.count[t] for t in ended):
            for i in range(len(self.open) - 1, -1, -1):
                if self.open[i][0] in ended:
                    return self.close_to(i)
                if self.open[i][0] in bounds:
                    return None
        return None

    def start(self, tag: str, attributes: str, ended: bool) -> None:
        if tag in BLOCK:
            self.flush()
            self.end_implied(("p",), CELLS)
            if tag in ENDS:
                self.end_implied(*ENDS[tag])
            if tag in ("p", "div", "li", "td", "article", "section"):
                self.anchors = 0
        if tag == "a":
            self.anchors = 1
        if tag in VOID or ended and tag not in BLOCK:
            return
        kind = kind_of(tag, attributes, any(x[2] for x in self.open))
        if tag in ("main", "article", "h1") and not kind:
            for p in self.parts:
                p.meets(tag)
        if tag not in BLOCK and not kind:
            return
        self.flush()
        self.number += 1
        part = Part(kind) if kind else None
        self.open.append((tag, self.number, self.number if tag in ("article", "main") and not kind else 0, part))
        self.count[tag] += 1
        if part:
            self.parts.append(part)
        if tag in HEADINGS:
            self.heading = tag

    def end(self, tag: str) -> None:
        if tag == "a":
            self.anchors = 0
        if tag in BLOCK:
            self.flush()
        if not self.count[tag]:
            return
        for i in range(len(self.open) - 1, -1, -1):
            at = self.open[i][0]
            if at == tag:
                return self.close_to(i)
            if at in CELLS and tag not in CELLS and tag not in ("tr", "tbody", "thead", "tfoot", "body", "html") or tag not in BLOCK and at in BLOCK:
                return


def blocks_of(page: str) -> list[Block]:
    walk = Walk()
    at, end = 0, len(page)
    while at < end:
        begin = page.find("<", at)
        begin = end if begin < 0 else begin
        if begin > at:
            walk.text(page[at:begin])
        if begin == end:
            break
        m = TOKEN.match(page, begin)
        if not m or m.end() == begin:
            walk.text("<")
            at = begin + 1
            continue
        at = m.end()
        tag = (m[1] or m[3] or "").lower()
        if not tag:
            continue
        if page[begin + 1] == "/":
            walk.end(tag)
        elif tag in RAW:
            stop = re.compile(rf"</{tag}\b", re.I).search(page, at)
            close = page.find(">", stop.start()) if stop else -1
            at = close + 1 if close >= 0 else end if stop or tag in ("script", "style") else at
            if tag in BLOCK:
                walk.flush()
        else:
            walk.start(tag, m[2] or "", (m[2] or "").endswith("/"))
    walk.close_to(0)
    return walk.blocks


def first_pass(block: Block) -> str:
    """good, bad, near (medium length) or short, by a block's own figures."""
    if block.linked > LINKED * len(block.text):
        return "bad"
    if len(block.text) < SHORT:
        return "short"
    words = WORD.findall(block.text.lower())
    density = sum(w in STOP for w in words) / len(words) if words else 0.0
    if density >= MANY_STOPS and len(block.text) > LONG:
        return "good"
    return "near" if density >= FEW_STOPS else "thin"


def weight(blocks: list[Block], labels: tuple[str, ...]) -> int:
    return sum(len(b.text) for b in blocks if b.first in labels)


def choose(blocks: list[Block]) -> list[Block]:
    """The blocks among which the article is sought: without parts that are something else, and inside the articles if these hold most."""
    some = ("good", "near")
    for part in dict.fromkeys(p for b in blocks for p in b.parts if p.out and p.kind not in ("comment", "never")):
        outside = [b for b in blocks if not b.out and b.first != "bad"]
        own = weight([b for b in blocks if part in b.parts and not any(p.out and p is not part for p in b.parts)], ("good",))
        if own and not any(b.article for b in outside) and own > (HOLDS if part.kind in ("form", "notice") else math.inf if outside else 0) * sum(len(b.text) for b in outside):
            part.out = False
    left = [b for b in blocks if not b.out]
    inside = [b for b in left if b.article]
    return inside if inside and weight(inside, some) >= MOST * weight(left, some) else left


def classify(blocks: list[Block]) -> None:
    """First pass by each block's own figures, second by its neighbours; labels are good or bad."""
    for b in blocks:
        b.first = first_pass(b)
    chosen = choose(blocks)
    article = bool(chosen) and all(b.article for b in chosen)
    label = {"good": "good", "bad": "bad", "thin": "" if article else "bad"}
    if all(b.first != "good" for b in chosen):  # no long block: the medium ones decide
        label["near"] = "good"
    decided = [label.get(b.first, "") for b in chosen]
    n = len(chosen)
    before, after = [-1] * n, [n] * n
    for i in range(1, n):
        before[i] = i - 1 if decided[i - 1] else before[i - 1]
        after[n - 1 - i] = n - i if decided[n - i] else after[n - i]
    for i, b in enumerate(chosen):
        p, q = before[i], after[i]
        around = [decided[j] if 0 <= j < n else "" for j in (p, q)]
        if decided[i]:
            b.label = decided[i]
        elif not any(decided):
            b.label = "good" if article or b.first == "near" else "short"
        elif b.first != "short":
            b.label = "good" if "good" in around or article and "bad" not in around else "bad"
        elif b.heading and around[1]:  # a heading goes with what follows
            b.label = around[1]
        elif article:  # the nearer neighbour, good ones first
            b.label = min((abs(i - j), x == "bad", x) for j, x in zip((p, q), around) if x)[2]
        elif around == ["good", "good"]:
            b.label = "good"
        else:  # beside what is bad, or at an end of the page, only with what stands in the same element
            b.label = "good" if any(x == "good" and chosen[j].parent == b.parent for j, x in zip((p, q), around)) else "bad"


def main_text(page: str) -> str:
    """The article's text: good blocks joined by one space."""
    blocks = blocks_of(page)
    classify(blocks)
    good = [b.text for b in blocks if b.label == "good"]
    if not good:  # a page of short blocks only
        good = [b.text for b in blocks if b.label == "short"]
    return " ".join(good)


def extract(df: DataFrame, id_col: str = "page_id", html_col: str = "html", keep: tuple[str, ...] = ("url",)) -> DataFrame:
    """``df``'s id and ``keep`` columns with ``text`` and ``n_chars`` (code points)."""
    schema = {f"k{i}": df.schema[c].dataType.simpleString() for i, c in enumerate((id_col, *keep))}

    def work(batches):
        for batch in slices(batches, rows=256, size=4 << 20):
            found = [main_text(t) for t in texts_of(batch, "html")]
            columns = [batch.column(i) for i in range(len(schema))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(found, pa.string()), pa.array([len(t) for t in found], pa.int64())], [*schema, "text", "n_chars"])

    rows = df.select(*(F.col(c).alias(f"k{i}") for i, c in enumerate((id_col, *keep))), F.col(html_col).cast("string").alias("html"))
    out = rows.mapInArrow(work, ", ".join([*(f"{k} {v}" for k, v in schema.items()), "text string", "n_chars bigint"]))
    return out.select(*(F.col(f"k{i}").alias(c) for i, c in enumerate((id_col, *keep))), "text", "n_chars")
