"""HTML extraction by two passes of block rules.

The page is cut at tags into blocks. What markup itself names as no article text is left out
with all that it holds: script, style, form, nav, footer, aside, and elements with a class, id
or role that names a menu, notice, advert, comments or the like (whole names, or the first or
last part of a hyphenated one, unless it says that something else has one: has-sidebar). If
that hides every article or main of the page, names of layout alone (sidebar, menu, form) don't
count on elements that hold one.

First pass: link density makes a block bad (inside an article or main only two or more blocks in
a row that are nothing but links, a menu); length and stop-word density make the others good,
near-good, short or, if long and outside an article, bad. Second pass: a near-good or short
block takes the label of its nearest decided neighbours in the same part of the page (article,
main, or body outside them). Where they disagree the nearer one counts, good at a tie; inside
an article, whose edges count as good neighbours, one good neighbour is enough. Where nothing
is decided a near-good block is kept, a short one only inside an article. Headings belong to
what follows them. Of a page with text in an article or main nothing else is kept.

Defined cases: null and empty html give an empty text. Unclosed and stray tags are met as
browsers do: block tags end an open paragraph, the body ends an open head, end tags close up
to their start if there is one; <!--> and <!---> are whole comments. Character references are
decoded once, white space (no-break space too) becomes one space, empty blocks vanish. Time is
linear in the page. Repeated rows are extracted each; an empty table gives no rows. Extra
columns pass through extracted(), but columns of the names that it adds (text, n_chars) are
replaced, also where it reads html from them.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linequarry.functions.shipping import ship
from linequarry.llm.common import table

# Element names, names of page parts, and stop words.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SKIPPED = frozenset("script style noscript template form nav footer aside head iframe object svg canvas button select textarea menu dialog math audio video".split())
RAW = frozenset("script style textarea noscript template iframe svg".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
PARTS = frozenset("article main".split())
NAMED = frozenset(
    "ad ads advert adverts advertisement advertising adslot banner sponsor sponsored promo promotion nav navbar navigation menu breadcrumb breadcrumbs sidebar "
    "aside footer foot masthead topbar cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login share sharing social "
    "related recommended comment comments commentlist reply replies respond disqus discussion widget pagination pager tags toc copyright legal complementary contentinfo search toolbar".split()
)
PHRASES = frozenset("side-bar site-header page-header".split())
LAYOUT = frozenset("nav navbar navigation menu sidebar side-bar masthead topbar toolbar form".split())
#: A name that begins so tells of something else.
MODIFIERS = frozenset("has with without no not non hide show is".split())
STOP_WORDS = frozenset(
    "the of and to a in is it that for was on are as with be by at or from this not have an they which but his her "
    "le la les de des du un une et est en que qui dans pour pas sur par au avec ce il ne se plus sont "
    "der die das und ist in den von zu mit dem sich des auf für im nicht ein eine als auch es an werden aus "
    "el los las de que y en un una es por con no para su al lo como más se del".split()
)
#: Thresholds: most links, what counts as nothing but a link, least length of a good block, least stop words of a good and of a near-good block.
LINKS, ALL_LINK, SHORT, GOOD_LENGTH, STOPS_LOW, STOPS_HIGH = 0.4, 0.9, 40, 120, 0.08, 0.2

NAME = re.compile(r"<(/?)([A-Za-z][^\s/>]*)")
END_OR_VALUE = re.compile(r">|=\s*([\"'])")
COMMENT_END = re.compile(r"--!?>")
ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
HUMP = re.compile(r"(?<=[a-z])(?=[A-Z])")


def tags(page: str) -> Iterator[tuple[int, int, str, str, str]]:
    """Begin, end, slash, name and attributes of each tag; no name for comments and declarations. A tag that is never closed is text."""
    at = page.find("<")
    while at >= 0:
        if page.startswith("<!--", at):
            if page.startswith((">", "->"), at + 4):
                end = page.index(">", at) + 1
            else:
                m = COMMENT_END.search(page, at + 4)
                end = m.end() if m else len(page)
            yield at, end, "", "", ""
        elif (m := NAME.match(page, at)) or page.startswith(("<!", "<?", "</"), at):
            first = page.find(">", at + 1)
            if first < 0:
                return
            if not m:
                end = first + 1
                yield at, end, "", "", ""
            else:
                end, k = first + 1, m.end()
                while x := END_OR_VALUE.search(page, k):  # a quoted value may hold the sign that ends a tag
                    if not x[1]:
                        end = x.end()
                        break
                    k = page.find(x[1], x.end()) + 1
                    if not k:
                        break
                yield at, end, m[1], m[2].lower(), page[m.end() : end - 1]
        else:
            end = at + 1
        at = page.find("<", end)


def names_a_part(value: str) -> set[str]:
    """The names of page parts among the words of a class, id or role."""
    found = set()
    for word in value.split():
        word = HUMP.sub("-", word).lower().replace("_", "-").strip("-")
        parts = word.split("-")
        if parts[0] not in MODIFIERS or len(parts) == 1:
            found |= {x for x in (word, parts[0], parts[-1]) if x in NAMED or x in PHRASES}
            found |= {x for x in PHRASES if word.startswith(x + "-") or word.endswith("-" + x)}
    return found


def left_out(name: str, attributes: str, inside: bool) -> str:
    """Whether an element is no article text: "" (it may be), "layout" (by a name that a whole page's frame may bear), or "part"."""
    if name in SKIPPED or (name == "header" and not inside):
        return "layout" if name == "form" else "part"
    if name in ("html", "body", *PARTS) or not attributes:
        return ""
    own: dict[str, str] = {}
    for key, *values in ATTRIBUTE.findall(attributes):
        own.setdefault(key.lower(), entities.unescape("".join(values)))
    style = own.get("style", "").lower()
    if "hidden" in own or own.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", style):
        return "part"
    found = set().union(*(names_a_part(own.get(k, "")) for k in ("class", "id", "role")))
    return "" if not found else "layout" if found <= LAYOUT else "part"


class Opened:
    """The open elements, with the places of those that are asked for kept apart, so that no tag needs to look through all."""

    def __init__(self) -> None:
        self.stack: list[tuple[str, str, int]] = []  # name, left_out(), number of the part it begins
        self.named: dict[str, list[int]] = {}
        self.blocks: list[int] = []
        self.skips: list[int] = []
        self.firm: list[int] = []  # of the skips those that aren't layout
        self.parts: list[int] = []
        self.links = self.headings = 0

    def push(self, name: str, skip: str, number: int) -> None:
        i = len(self.stack)
        self.stack.append((name, skip, number))
        self.named.setdefault(name, []).append(i)
        for held, own in ((self.blocks, name not in INLINE), (self.skips, skip), (self.firm, skip == "part"), (self.parts, number)):
            if own:
                held.append(i)
        self.links += name == "a"
        self.headings += name in HEADINGS

    def close(self, i: int) -> None:
        """Closes the elements from the i-th on."""
        while len(self.stack) > i:
            name, _, _ = self.stack.pop()
            self.named[name].pop()
            for held in (self.blocks, self.skips, self.firm, self.parts):
                if held and held[-1] == len(self.stack):
                    held.pop()
            self.links -= name == "a"
            self.headings -= name in HEADINGS


def blocks(page: str, reveal: bool = False) -> tuple[list[tuple[str, int, bool, int, bool]], bool]:
    """(text, characters in links, heading, number of the page's part, whether that is an article or main) of each block in page order,
    and whether names of layout hide an article or main; with reveal they don't."""
    out: list[tuple[str, int, bool, int, bool]] = []
    words: list[str] = []
    linked, parts, at, hides = 0, 0, 0, False
    open_ = Opened()
    shown = -1  # with reveal, the skips up to this place don't count

    def hidden() -> bool:
        return bool(open_.skips) and open_.skips[-1] > shown

    def end_block() -> None:
        nonlocal linked
        text = " ".join(entities.unescape("".join(words)).split())
        if text:
            out.append((text, linked, open_.headings > 0, open_.stack[open_.parts[-1]][2] if open_.parts else 0, bool(open_.parts)))
        words.clear()
        linked = 0

    def put(text: str) -> None:
        nonlocal linked
        if text and not hidden():
            words.append(text)
            if open_.links:
                linked += len(" ".join(entities.unescape(text).split()))

    def close(i: int) -> None:
        nonlocal shown
        open_.close(i)
        shown = min(shown, i - 1)

    for begin, end, slash, name, attributes in tags(page):
        if begin < at:
            continue  # inside a script or the like
        put(page[at:begin])
        at = end
        if name == "br":
            put(" ")
        elif slash:
            places = open_.named.get(name)
            # An inline end tag doesn't close blocks.
            if places and not (name in INLINE and open_.blocks and open_.blocks[-1] > places[-1]):
                if name not in INLINE:
                    end_block()
                close(places[-1])
        elif name:
            if name not in INLINE:
                end_block()
                if name in ("body", *PARTS) and open_.named.get("head"):
                    close(open_.named["head"][-1])
                if open_.blocks:
                    k = open_.blocks[-1]
                    top = open_.stack[k][0]
                    if top == "p" or top in HEADINGS or (top == name and name in ("li", "dt", "dd", "td", "th", "tr", "option")):
                        close(k)
                    elif k < len(open_.stack) - 1 and not (open_.skips and open_.skips[-1] > k):
                        close(k + 1)
            if name in RAW:
                after = re.compile(rf"</{name}\s*>", re.I).search(page, at)
                at = after.end() if after else len(page)
            elif name not in VOID and not attributes.endswith("/"):
                skip, number = left_out(name, attributes, bool(open_.parts)), 0
                if name in PARTS and not open_.parts:
                    if hidden() and not open_.firm:
                        hides = True
                        shown = len(open_.stack) - 1 if reveal else shown
                    if not hidden():
                        parts += 1
                        number = parts
                open_.push(name, skip, number)
    put(page[at:])
    end_block()
    return out, hides


def first_pass(found: list[tuple[str, int, bool, int, bool]]) -> list[str]:
    """A label for each block: good, bad, near or short."""
    only_link = [linked > ALL_LINK * len(text) for text, linked, *_ in found]
    parts = [b[3] for b in found]

    def beside(i: int) -> bool:
        return any(0 <= k < len(found) and only_link[k] and parts[k] == parts[i] for k in (i - 1, i + 1))

    def label(i: int) -> str:
        text, linked, _, _, inside = found[i]
        if (only_link[i] and beside(i)) if inside else linked > LINKS * len(text):
            return "bad"
        if len(text) < SHORT:
            return "short"
        words = text.lower().split()
        stops = sum(w.strip(".,;:!?\"'()&$#*%") in STOP_WORDS for w in words) / len(words)
        if stops >= STOPS_HIGH:
            return "good" if len(text) >= GOOD_LENGTH else "near"
        return "near" if stops >= STOPS_LOW or inside or len(text) < GOOD_LENGTH else "bad"

    return [label(i) for i in range(len(found))]


def second_pass(found: list[tuple[str, int, bool, int, bool]], labels: list[str]) -> list[bool]:
    """Whether each block is kept."""
    kept = [x == "good" for x in labels]
    before: list[int] = []
    last: dict[int, int] = {}
    for i, b in enumerate(found):  # the nearest decided block before, and below, after, of the same part
        before.append(last.get(b[3], -1))
        if labels[i] in ("good", "bad"):
            last[b[3]] = i
    last.clear()
    for i in range(len(found) - 1, -1, -1):
        _, _, heading, part, inside = found[i]
        if labels[i] not in ("short", "near"):
            last[part] = i
            continue
        p, n = before[i], last.get(part, -1)
        good = lambda k: k >= 0 and labels[k] == "good"
        if inside:
            kept[i] = p < 0 or n < 0 or good(p) or good(n)
        elif p < 0 and n < 0:
            kept[i] = labels[i] == "near"
        elif (heading and n >= 0) or p < 0:
            kept[i] = good(n)
        elif n < 0:
            kept[i] = good(p)
        else:
            kept[i] = good(p) if i - p < n - i else good(n) if i - p > n - i else good(p) or good(n)
    # A page with an article or main has its text there.
    if any(k and b[4] for k, b in zip(kept, found, strict=True)):
        kept = [k and b[4] for k, b in zip(kept, found, strict=True)]
    return kept


def extract(page: str | None) -> str:
    """The main text of a page: its blocks joined by line ends."""
    if not page:
        return ""
    found, hides = blocks(page)
    if hides and not any(b[4] for b in found):
        found, _ = blocks(page, reveal=True)
    kept = second_pass(found, first_pass(found))
    return "\n".join(b[0] for k, b in zip(kept, found, strict=True) if k)


def extracted(pages: DataFrame, column: str = "html") -> DataFrame:
    """pages with text and n_chars, the main text of each row."""
    ship(pages.sparkSession)

    @F.pandas_udf("string")
    def main_text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series([extract(x) for x in s], dtype=object)

    return pages.withColumn("text", main_text(column)).withColumn("n_chars", F.char_length("text").cast("long"))


def op4_html_extraction(spark, sf_dir: str) -> DataFrame:
    return extracted(table(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "url", "text", "n_chars")
