"""Main text of web pages by two-pass block rules.

A page is cut into text blocks at block-level tags. What stands in a container that pages use for anything but the
article (navigation, adverts, comments, ...) is furniture and goes. The first pass decides the other blocks from their
length, link density and stop-word density; headings, short blocks and those between the bounds stay open. The second pass
gives an open block the label of its nearest decided neighbours. An article or main element is one feature more: links
alone don't decide against a block in it, and its blocks have their neighbours there.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Frequent function words of English, German, French and Spanish.
STOP_WORDS = frozenset(
    """a about after all also an and any are as at be because been but by can could did do for from had has have he her
    his how i if in into is it its just more no not of on one only or other our out over she so some than that the their
    them then there these they this to up was we were what when which who will with would you your
    aber als am an auch auf aus bei bin bis da damit das dass dem den der des die doch du durch ein eine einem einen
    einer er es für haben hat hier ich ihr im in ist ja kann man mehr mit nach nicht noch nur oder sein sich sie sind so
    um und uns unter vom von vor war was wenn werden wie wir wird zu zum zur über
    au aussi aux avec ce ces cette comme dans de des du elle en est et il ils je la le les leur lui mais même ne nous on
    ont ou par pas plus pour qu que qui sa sans se ses si son sont sur tout un une vous été être à où
    al como con cuando de del desde donde el ella en entre era es esta este está fue ha hay la las lo los mas me mi muy
    más ni no nos o para pero por que se ser si sin sobre son su sus también te tiene todo un una uno y ya yo""".split()
)
# Elements whose content is never text of the page.
RAW = ("script", "style", "noscript", "template", "svg", "math", "iframe", "object", "canvas", "textarea", "head", "select", "title")
# Elements that hold a page's furniture.
FURNITURE = frozenset("nav footer aside form button dialog menu fieldset".split())
# Elements that end the text block before them.
BLOCK = frozenset(
    """address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form
    frameset h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol optgroup option p pre section summary table tbody td
    tfoot th thead tr ul""".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# Elements that a further one of their kind ends.
CLOSED_BY_NEXT = frozenset("p li dt dd tr td th option".split())
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
# Words in class, id or role that mark furniture.
MARKS = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|adsense|banner|sponsor\w*|promo\w*|nav\w*|menu\w*|breadcrumbs?|sidebar\w*|side|footer|comments?|disqus|respond|"
    r"replies|cookies?|consent|gdpr|notices?|popup|modal|newsletter|subscribe|signup|login|share|sharing|social|related|recommended|widget\w*|"
    r"toolbar|pagination|pager|masthead|complementary|navigation|search|alert|disclaimer|copyright)(?:$|[\s_-])"
)
ATTRIBUTE = re.compile(r"""\b(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
HIDDEN = re.compile(r"""\shidden(?=[\s>/=]|$)|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.I)
# A tag that isn't closed ends at the next one or at the page's end, so that no part of a broken page is read again and again.
TAG = re.compile(r"""<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<(/?)([a-zA-Z][^\s/<>]*)((?:"[^"]*"|'[^']*'|[^'"<>]++|["'])*?)(?:>|(?=<)|$)|<[!?][^<>]*+>?""", re.S)
END_OF_RAW = {name: re.compile(rf"</{name}(?=[\s/>])[^<>]*+>?", re.I) for name in RAW}
WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?")

#: Defaults of the first pass: characters of a short and of a long block, stop-word densities, link density.
SHORT, LONG, STOP_LOW, STOP_HIGH, LINKS = 70, 200, 0.15, 0.30, 0.33


def is_furniture(name: str, attributes: str, in_article: bool) -> bool:
    if name in FURNITURE or name == "header" and not in_article or attributes and HIDDEN.search(attributes):
        return True
    if not attributes or name in ("body", "html", "article", "main"):
        return False
    return bool(MARKS.search(" ".join(x.strip("\"'").lower() for x in ATTRIBUTE.findall(attributes))))


class Block:
    __slots__ = ("article", "furniture", "heading", "linked", "parts")

    def __init__(self, article: bool, furniture: bool, heading: bool):
        self.parts: list[str] = []
        self.article, self.furniture, self.heading = article, furniture, heading
        self.linked = 0


def blocks(page: str) -> list[tuple[Block, str]]:
    """The page's text blocks in order, with their text: references decoded, each run of white space one space."""
    found: list[Block] = []
    open_tags: list[tuple[str, bool, bool]] = []  # name, furniture from here on, article from here on
    n_open: dict[str, int] = {}
    headless = False  # no end of a head was found from here on
    current: Block | None = None
    link = 0
    heading = False

    def add(text: str) -> None:
        nonlocal current
        if not text:
            return
        if current is None:
            if not text.strip():
                return
            inside = open_tags[-1] if open_tags else ("", False, False)
            current = Block(inside[2], inside[1], heading)
            found.append(current)
        current.parts.append(text)
        if link:
            current.linked += len(text.strip())

    at, size = 0, len(page)
    while at < size:
        m = TAG.search(page, at)
        if m is None:
            add(page[at:])
            break
        add(page[at : m.start()])
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            continue
        closing = bool(m[1])
        if name in BLOCK:
            current = None
        if name in END_OF_RAW and not closing:
            if m[3].endswith("/") and name in ("svg", "math"):
                continue
            if headless and name == "head":
                continue
            end = END_OF_RAW[name].search(page, at)
            if end is None and name == "head":
                headless = True
                continue
            at = size if end is None else end.end()
            continue
        if name == "a":
            link = 0 if closing else 1
        elif name == "br":
            add(" ")
        elif name in HEADING:
            heading = not closing
        if name in BLOCK and name not in VOID:
            if closing:
                while n_open.get(name):
                    n_open[last := open_tags.pop()[0]] -= 1
                    if last == name:
                        break
                link = 0
            else:
                while name in CLOSED_BY_NEXT and open_tags and open_tags[-1][0] == name:
                    n_open[open_tags.pop()[0]] -= 1
                above = open_tags[-1] if open_tags else ("", False, False)
                furniture = is_furniture(name, m[3], above[2])
                if name not in CLOSED_BY_NEXT or furniture:
                    open_tags.append((name, above[1] or furniture, above[2] or name in ("article", "main")))
                    n_open[name] = n_open.get(name, 0) + 1
    texts = ((b, " ".join(entities.unescape("".join(b.parts)).split())) for b in found)
    return [(b, t) for b, t in texts if t]


def first_pass(block: Block, text: str) -> str:
    """good, bad, near (open, but with the look of prose) or open: too short or too mixed to tell."""
    links = block.linked / len(text)
    if links > LINKS:
        return "open" if block.article else "bad"
    if block.heading:
        return "open"
    words = WORD.findall(text)
    stops = sum(w.lower() in STOP_WORDS for w in words) / len(words) if words else 0.0
    if len(text) < SHORT:
        return "open" if block.article or not block.linked else "bad"
    if stops >= STOP_HIGH and len(text) > LONG:
        return "good"
    # Prose of which the list has few words is told from debris by its length and by having no links.
    return "near" if stops >= STOP_LOW or len(text) > LONG and not links else "open" if block.article or not block.linked else "bad"


def second_pass(labels: list[str]) -> list[bool]:
    """Whether each of a row of neighbours is kept. An open block takes the label of its nearest decided neighbours: it stays
    if both sides are good or the only side is, and, if they differ, where it is near or not further from the good one. Where
    no block is good, near ones count as good; where none is decided either way all stay."""
    if "good" not in labels:
        labels = ["good" if x == "near" else x for x in labels]
    n = len(labels)
    before: list[int | None] = [None] * n
    after: list[int | None] = [None] * n
    for places, sides in ((range(n), before), (range(n - 1, -1, -1), after)):
        last = None
        for i in places:
            sides[i] = last
            if labels[i] in ("good", "bad"):
                last = i
    kept = []
    for label, i, b, a in zip(labels, range(n), before, after, strict=True):
        if label in ("good", "bad"):
            kept.append(label == "good")
            continue
        sides = {labels[x] for x in (b, a) if x is not None}
        if len(sides) < 2:
            kept.append("bad" not in sides)
        else:
            good, bad = (b, a) if labels[b] == "good" else (a, b)
            kept.append(label == "near" or abs(good - i) <= abs(bad - i))
    return kept


def main_text(page: str | None) -> str:
    if not page:
        return ""
    found = [(b, t) for b, t in blocks(page) if not b.furniture]
    # The article's blocks are each other's neighbours, and so are the others.
    kept = [False] * len(found)
    for inside in (True, False):
        own = [i for i, (b, _) in enumerate(found) if b.article == inside]
        for i, keep in zip(own, second_pass([first_pass(*found[i]) for i in own]), strict=True):
            kept[i] = keep
    return "\n\n".join(t for (_, t), keep in zip(found, kept, strict=True) if keep)


def extract(pages: DataFrame, html: str = "html") -> DataFrame:
    """pages' columns page_id and url with text and n_chars, one row per page, rows that repeat included.

    A null or empty page, or one without main text, gives the empty string. Whole pages are read, however long.
    Other columns of pages are ignored.
    """

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = [main_text(x) for x in batch["html"]]
            yield pd.DataFrame({"page_id": batch["page_id"], "url": batch["url"], "text": texts, "n_chars": [len(t) for t in texts]})

    narrow = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.coalesce(F.col(html), F.lit("")).alias("html"))
    return narrow.mapInPandas(each, "page_id long, url string, text string, n_chars long")
