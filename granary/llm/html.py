"""Main text of web pages by two-pass block rules.

A tokenizer cuts a page into blocks at block-level tags. Blocks within navigation, headers, footers, sidebars, forms, adverts, notices and
comments are boilerplate by their markup, and where a page marks its article, blocks outside it are; all others are judged by their text:

* The first pass looks at each block alone: at its length, the share of its characters in links, and the share of common words among its
  words. Long blocks with many common words are text. Blocks of links are not: any of them where a page marks no article, within an
  article those beside each other, as in a list of links. Long blocks with hardly any common word are no text where no article is marked.
  All others, the short ones above all, stay undecided.
* The second pass gives undecided blocks the label of their nearest decided neighbours. The borders of a marked article count as
  text, and within one, both neighbours must be no text for a block to go: the markup is a prior that the rules can overrule.

Each page is a row of its own, so nothing is shuffled. Defined cases: null or empty html, and pages without text, give the
empty text; unclosed and misnested tags close as browsers close them; a page cut off within a tag or a reference keeps what comes
before it; what a browser shows only in place of something else (alternatives of canvas, object, audio and video) counts as text,
drawings and frames don't; repeated rows give equal texts; an empty table gives an empty result; extra columns pass through, one that
has the result's name under another (``aside``).
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import aside

#: Lengths in code points, densities in words.
SHORT, LONG = 70, 200
STOP_LOW, STOP_HIGH, MAX_LINKS = 0.15, 0.30, 0.5
#: Within a marked article a lower share of common words makes a text.
STOP_INSIDE = 0.1

#: Common words of English, German, French and Spanish.
STOP_WORDS = frozenset(
    """a an the and or but of to in on at by for from with as is are was were be been it its this that these those not have has had he she they we you i his her their
    der die das den dem des ein eine einer einem einen und oder aber von zu zum zur im in an auf mit für bei nach aus als ist sind war nicht sich es er sie wir ich auch wie
    le la les un une des du de et ou mais en dans sur pour par avec que qui ne pas ce cette ces est sont était il elle nous vous ils au aux se sa son ses plus
    el los las una unos y o pero del al con sin por para que no su sus es son era lo como más este esta""".split()
)

BLOCKS = frozenset(
    """address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html
    legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead tr ul""".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style template iframe svg title textarea noframes noembed xmp".split())
OUT = frozenset("nav footer aside form button select dialog menu".split())
#: Words of class, id and role that mark boilerplate.
HINTS = frozenset(
    """ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored sponsors promo promos promotion cookie cookies consent gdpr notice notices notification popup modal overlay
    newsletter subscribe subscription signup nav navbar navigation menu menus breadcrumb breadcrumbs sidebar sidebars aside footer header masthead toolbar share sharing social comment comments commentlist respond
    reply replies discussion disqus related recommended recommendations widget widgets login search pagination pager copyright skip contentinfo complementary alert announcement disclaimer paywall rail
    promoted adsbygoogle adslot adbox outbrain taboola""".split()
)
#: Words of class and id that mark the text where a page has no article.
CONTENT = frozenset("content post entry article story".split())
#: Of these, an article within frees itself: such names often stand on wrappers of the whole page.
SOFT = frozenset("header banner sidebar menu nav widget search login notice ads ad overlay modal social share footer".split())
NEVER_HINTED = frozenset("html body main article".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

_TOKEN = re.compile(r"""<!--(?:-?>|.*?(?:--!?>|\Z))|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]|=\s*"[^"]*"|=\s*'[^']*'|=)*+)(>|\Z)|<[!?/][^>]*(?:>|\Z)""", re.S)
_NAMED = re.compile(r"""\b(class|id|role|style|hidden|aria-hidden)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_WORD = re.compile(r"[^\W\d_]+")
_ENDS = {x: re.compile(rf"</{x}(?=[\s/>])[^>]*(?:>|\Z)", re.I) for x in RAW}


class Block:
    __slots__ = ("chars", "heading", "inside", "kind", "links", "out", "text")

    def __init__(self, text: str, links: int, out: bool, inside: int, heading: bool):
        self.text, self.links, self.out, self.inside, self.heading = text, links, out, inside, heading
        self.chars = len(text)
        self.kind = ""


def hints(attributes: str) -> set[str]:
    """What class, id and role say, as lower-case words; "hidden" for what isn't shown."""
    found: set[str] = set()
    for name, value in _NAMED.findall(attributes):
        name, value = name.lower(), value.strip("\"'")
        if name == "hidden" or (name == "aria-hidden" and value.lower() == "true") or (
            name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I)
        ):
            found.add("hidden")
        elif name in ("class", "id", "role"):
            found |= {x.lower() for x in _PART.findall(value)}
    return found


def blocks(html: str) -> Iterator[Block]:
    """The blocks of a page in its order."""
    # Open elements: name, boilerplate ("" or why), within an article (2) or something named like one (1), link.
    stack: list[tuple[str, str, int, bool]] = []
    pieces: list[str] = []
    links = 0

    def close() -> Block | None:
        nonlocal links
        text = " ".join("".join(pieces).split())
        n, links = links, 0
        pieces.clear()
        if not text:
            return None
        _, out, inside, _ = stack[-1] if stack else ("", "", 0, False)
        heading = any(x[0] in HEADINGS for x in stack)
        return Block(text, n, bool(out) and not (out == "header" and inside == 2 and heading), inside, heading)

    at, size = 0, len(html)
    while at < size:
        token = _TOKEN.search(html, at)
        upto = token.start() if token else size
        if upto > at:
            text = unescape(html[at:upto])
            pieces.append(text)
            if stack and stack[-1][3]:
                links += len("".join(text.split()))
        if not token:
            break
        at = token.end()
        name = (token[2] or "").lower()
        if not name:
            continue
        if token[1]:
            if name in BLOCKS and (done := close()):
                yield done
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    del stack[k:]
                    break
            continue
        if name == "br":
            pieces.append(" ")
            continue
        if name in RAW:
            end = _ENDS[name].search(html, at)
            at = end.end() if end else size
            if name in ("iframe", "svg"):
                pieces.append(" ")
            continue
        if name in BLOCKS:
            if done := close():
                yield done
            for k in range(len(stack) - 1, -1, -1):
                # A block ends an open paragraph, an item ends an item of the same list.
                if stack[k][0] == "p" or (name == "li" and stack[k][0] == "li"):
                    del stack[k:]
                    break
                if stack[k][0] in ("td", "th", "table", "ul", "ol", "div", "article", "section", "body") and stack[k][0] != name:
                    break
        if name in VOID:
            continue
        _, out, inside, link = stack[-1] if stack else ("", "", 0, False)
        said = hints(token[3]) if token[3] else set()
        if name in ("article", "main") or "main" in said and name in ("div", "section") and not said & HINTS:
            if out in SOFT and not said & HINTS:
                out = ""
            inside = inside if out else 2
        elif said & CONTENT and not said & HINTS and name in ("div", "section", "td") and not out:
            inside = max(inside, 1)
        if "hidden" in said:
            out = "hidden"
        elif not out:
            if name in OUT:
                out = f"<{name}>"
            elif name == "header":
                out = "header"
            elif name == "noscript" and inside < 2:
                out = "<noscript>"
            elif said and name not in NEVER_HINTED or name == "article":
                out = min(said & HINTS, default="")
        stack.append((name, out, inside, link or name == "a"))
    if done := close():
        yield done


def classify(found: list[Block]) -> list[Block]:
    """Labels every block and returns the good ones. A block's kind says what decided it: its markup ("out"), the first pass ("good",
    "bad") or the second ("kept", "dropped")."""
    # Where a page has an article, what is named like one does not count.
    level = max((b.inside for b in found if not b.out), default=0)
    rows = []
    for b in found:
        if b.out or b.inside < level:
            b.kind = "out"
        else:
            rows.append(b)
    # First pass.
    dense, stops, common = [], [], 0
    for b in rows:
        words = _WORD.findall(b.text.lower())
        n = sum(w in STOP_WORDS for w in words)
        common += n
        stops.append(n / len(words) if words else 0.0)
        dense.append(b.links > MAX_LINKS * max(1, len(b.text.replace(" ", ""))))
    for k, b in enumerate(rows):
        beside = (k > 0 and dense[k - 1]) or (k + 1 < len(rows) and dense[k + 1])
        if dense[k]:
            b.kind = "bad" if beside or not level else "short"
        elif b.chars < SHORT:
            b.kind = "bad" if b.links and not level else "short"
        elif level:
            b.kind = "good" if stops[k] >= STOP_INSIDE else "short"
        elif not common or stops[k] >= STOP_HIGH or (stops[k] >= STOP_LOW and b.chars > LONG):
            b.kind = "good"
        else:
            b.kind = "short" if stops[k] >= STOP_LOW else "bad"
    # Second pass: the nearest decided block before and after each undecided one.
    decided = [k for k, b in enumerate(rows) if b.kind in ("good", "bad")]
    any_good = any(rows[k].kind == "good" for k in decided)
    nxt = 0
    for k, b in enumerate(rows):
        if b.kind != "short":
            continue
        while nxt < len(decided) and decided[nxt] < k:
            nxt += 1
        before, after = (decided[nxt - 1] if nxt else None), (decided[nxt] if nxt < len(decided) else None)
        bad = [x is not None and rows[x].kind == "bad" for x in (before, after)]
        if level:
            b.kind = "dropped" if all(bad) else "kept"
        elif not any_good:
            # A page of short blocks has nothing better.
            b.kind = "kept"
        elif before is None or after is None:
            b.kind = "dropped" if any(bad) else "kept"
        else:
            near = bad[1] if b.heading or after - k < k - before else bad[0]
            b.kind = "dropped" if near else "kept"
    return [b for b in rows if b.kind in ("good", "kept")]


def main_text(html: str | None) -> str:
    return "\n".join(b.text for b in classify(list(blocks(html)))) if html else ""


@F.arrow_udf(T.StringType())
def main_texts(pages: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for batch in pages:
        yield pa.array([main_text(x.as_py()) for x in batch], pa.string())


def extracted(pages: DataFrame, html: str = "html", into: str = "text") -> DataFrame:
    """pages with the main text in a column."""
    kept, [html] = aside(pages, [into], [html])
    return kept.withColumn(into, main_texts(F.col(html)))
