"""Main text of web pages by two passes over their blocks.

Pass one decides blocks by stop-word density, length and link density (and by
the elements around them: navigation, footers, adverts, forms and the like
are no text; an article element is evidence for what it holds, unless more
text is found outside of it). Where a page holds hardly any stop word known
here, sentence marks stand in for them. Blocks too short or too ordinary to
tell stay open. Pass two gives each open block the label of the nearest decided
block of its region.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Frequent function words.
STOP_WORDS = frozenset(
    "the of and to in a is that for it as was with be by on not he his but at are this have from or had an they which one you were all we her she there their"
    " le la les de des du un une et que qui dans en est pour pas sur au avec par ce il ne se plus"
    " der die das und von zu mit den nicht auf ein eine im dem als für ist sich auch"
    " el los las del al se con por una su lo como más para".split()
)
LOW, HIGH, MANY_LINKS = 70, 200, 0.33
STOPS_LOW = 0.10
#: Elements by what they mean for the text.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split())
RAW = frozenset("script style textarea iframe title xmp noembed noframes".split())
NO_TEXT = frozenset("nav footer menu button noscript template object svg math select datalist canvas audio video".split())
NO_TEXT_UNLESS_AROUND = frozenset("aside form dialog fieldset".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose end tag may be missing: what begins after them, and what they stand in.
ENDED_BY = {
    "li": ("li", "ul ol menu dir"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "option": ("option", "select datalist"),
    "td": ("td th", "tr table"), "th": ("td th", "tr table"), "tr": ("tr", "table"),
    "tbody": ("tbody thead tfoot", "table"), "thead": ("tbody thead tfoot", "table"), "tfoot": ("tbody thead tfoot", "table"),
}
ENDED_BY = {tag: (tuple(a.split()), frozenset(b.split())) for tag, (a, b) in ENDED_BY.items()}
WALLS = ("td", "th", "caption", "table", "object", "button")
#: Words in class, id and role that mark what is no text.
COMMENTS = frozenset("comment comments commentlist disqus reply replies respond".split())
MARKS = COMMENTS | frozenset(
    "ad ads adv advert adverts advertisement advertising banner promo promotion sponsor sponsored nav navbar navigation menu breadcrumb breadcrumbs sidebar"
    " footer header masthead toolbar widget related recommended share sharing social cookie cookies consent gdpr notice popup modal overlay newsletter subscribe"
    " subscription signup login pagination pager copyright legal disclaimer complementary contentinfo search skip".split()
)
#: Words that name the text itself, and words that turn a mark into its contrary ("no-sidebar").
KEEPERS = frozenset("article post entry content main body story text".split())
CONTRARY = frozenset("no not has with without free".split())
TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>")
LOOSE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>")
NAMES = re.compile(r"(?:^|[\s\"'/])(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
WORD = re.compile(r"[^\W_]+")
#: Ends of sentences in any script; a full stop only before a blank or the end.
SENTENCE = re.compile(r"[.!?](?=\s|$)|[\u3002\uff01\uff1f\u0964\u061f\u06d4\u1362\u104b\u0589]")
BLANKS = re.compile(r"\s+")

#: How surely an element is no text: not at all; unless it turns out to be around the text; surely.
PLAIN, MAYBE, SURE = 0, 1, 2


def _unwanted(tag: str, attributes: str, in_article: bool) -> int:
    """PLAIN, MAYBE or SURE, by the element's name and attributes."""
    if tag in NO_TEXT:
        return SURE
    worst = MAYBE if tag in NO_TEXT_UNLESS_AROUND or tag == "header" and not in_article else PLAIN
    if not attributes:
        return worst
    named = False  # a word of its own that names the text
    marked = PLAIN
    for m in NAMES.finditer(attributes):
        name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if name == "hidden" or name == "aria-hidden" and value == "true":
            return SURE
        if name == "style":
            if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
                return SURE
            continue
        for token in value.split():
            words = set(re.split(r"[^a-z0-9]+", token))
            found = words & MARKS
            if found and words & CONTRARY or found == {"header"} and (in_article or words & KEEPERS):
                continue
            if found:
                marked = max(marked, SURE if found & COMMENTS else MAYBE)
            else:
                named = named or bool(words & KEEPERS)
    if tag in ("html", "body", "main") or tag == "article" and (marked < SURE or named):
        return worst
    return max(worst, PLAIN if named and marked < SURE else marked)


class Page:
    """Blocks of a page, with the elements around them that may be no text.

    ``pieces`` has (block, text, characters inside links, region, mark) for
    each run of text between block elements, in pieces where an element inside
    of the run is marked; region 0 is outside of any article or main element,
    and mark 0 outside of marked elements. ``marks`` has [parent mark,
    PLAIN/MAYBE/SURE, whether it was closed, its first block, what it has
    inside] for each marked element. End tags may be missing or wrong: list
    items, cells, paragraphs and the like end where the next one begins, an
    end tag that opens nothing is ignored, and a mark that is never closed
    counts for its first block only.
    """

    def __init__(self, page: str) -> None:
        self.marks: list[list] = [[0, PLAIN, True, 0, set()]]
        self._stack: list[tuple[str, int, int]] = [("", 0, 0)]  # name, mark, region
        self._places: dict[str, list[int]] = {}  # where on the stack the elements of a name are
        self._parts: list[tuple[str, int, int]] = []  # text, mark and link of the block under way
        self._links: list[list] = []  # [closed, first block] of each link
        self._found: list[tuple[int, int, int, list]] = []  # block, region, mark, parts
        self._block = self._regions = 0
        self._read(page)
        self._flush()
        self._close(1, None)
        self.pieces = []
        for block, region, mark, parts in self._found:
            linked = sum(len(t) for t, _, k in parts if k >= 0 and (self._links[k][0] or self._links[k][1] == block))
            self.pieces.append((block, "".join(t for t, _, _ in parts), linked, region, mark))

    def _flush(self) -> None:
        if any(not t.isspace() for t, _, _ in self._parts):
            region, at = self._stack[-1][2], 0
            for i, part in enumerate(self._parts):
                if i + 1 == len(self._parts) or self._parts[i + 1][1] != part[1]:
                    self._found.append((self._block, region, part[1], self._parts[at:i + 1]))
                    at = i + 1
            self._block += 1
        self._parts = []

    def _last(self, names) -> int:
        at = 0
        for x in names:
            places = self._places.get(x)
            if places and places[-1] > at:
                at = places[-1]
        return at

    def _close(self, to: int, name: str | None) -> None:
        """Take the stack down to ``to``, which ``name`` (None: the end of something around it) ends."""
        while len(self._stack) > to:
            tag, mark, _ = self._stack.pop()
            self._places[tag].pop()
            if mark and mark != self._stack[-1][1]:
                own = len(self._stack) == to and name is not None
                self.marks[mark][2] = own or tag == "p" or tag in ENDED_BY and name in ENDED_BY[tag][1]

    def _open(self, tag: str, attributes: str) -> None:
        _, mark, region = self._stack[-1]
        sure = _unwanted(tag, attributes, bool(region))
        if tag in ("article", "main", "p"):
            at = mark
            while at and tag not in self.marks[at][4]:
                self.marks[at][4].add(tag)
                at = self.marks[at][0]
        if sure:
            self.marks.append([mark, sure, False, self._block, set()])
            mark = len(self.marks) - 1
        if tag in ("article", "main") and not region:
            self._regions += 1
            region = self._regions
        self._places.setdefault(tag, []).append(len(self._stack))
        self._stack.append((tag, mark, region))

    def _begin(self, tag: str, attributes: str) -> None:
        if tag in BLOCKS:
            self._flush()
            at = self._last(("p",))
            if at > self._last(WALLS):
                self._close(at, "p")
        elif tag == "br":
            self._text(" ")
        if tag in ENDED_BY:
            same, around = ENDED_BY[tag]
            at = self._last(same)
            if tag in ("tr", "tbody", "thead", "tfoot"):  # an open cell ends with its row
                at = min((x for x in (at, self._last(("td", "th")), self._last(("tr",))) if x > self._last(("table",))), default=0)
            if at > self._last(around if tag not in ("td", "th") else ("tr", "table")):
                self._close(at, tag)
        if tag == "a":
            at = self._last(("a",))
            if at > self._last(WALLS):
                self._close(at, None)
            self._links.append([False, self._block])
        if tag not in VOID and not attributes.endswith("/"):
            self._open(tag, attributes)

    def _end(self, tag: str) -> None:
        if tag in BLOCKS:
            self._flush()
        at = self._last((tag,))
        if not at or tag not in WALLS and tag not in ("article", "main", "body", "html") and at < self._last(WALLS):
            return
        above = len(self._stack) - 1 - at
        if tag not in BLOCKS and above and self._stack[at][1] == self._stack[at - 1][1] and any(x[0] in BLOCKS for x in self._stack[-min(above, 8):]):
            if tag == "a":
                self._links[-1][0] = True
                self._places["a"].pop()
                self._stack[at] = ("", *self._stack[at][1:])
                self._places.setdefault("", []).append(at)
            return
        if tag == "a":
            self._links[-1][0] = True
        self._close(at, tag)

    def _read(self, page: str) -> None:
        at, n = 0, len(page)
        endless: set[str] = set()
        while at < n:
            open_at = page.find("<", at)
            if open_at < 0:
                open_at = n
            if open_at > at:
                self._text(page[at:open_at])
            if open_at == n:
                break
            follows = page[open_at + 1:open_at + 2]
            if page.startswith("<!--", open_at):
                end = page.find("-->", open_at + 2)
                at = n if end < 0 else end + 3
                continue
            if follows in ("!", "?"):
                end = page.find(">", open_at)
                at = n if end < 0 else end + 1
                continue
            m = TAG.match(page, open_at) or LOOSE.match(page, open_at)
            if not m:
                if follows.isalpha() or follows == "/":  # the page breaks off in a tag
                    end = page.find(">", open_at)
                    at = n if end < 0 else end + 1
                    continue
                self._text("<")
                at = open_at + 1
                continue
            at = m.end()
            closing, tag, attributes = bool(m[1]), m[2].lower(), m[3]
            if tag in RAW:
                if tag in BLOCKS:
                    self._flush()
                if not closing and tag not in endless and not attributes.endswith("/"):
                    end = re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I).search(page, at)
                    if end:
                        at = end.end()
                    else:  # looked for once
                        endless.add(tag)
                        at = n if tag in ("script", "style") else max(at, page.find("<", at)) if tag == "title" else at
            elif closing:
                self._end(tag)
            else:
                self._begin(tag, attributes)

    def _text(self, data: str) -> None:
        self._parts.append((data, self._stack[-1][1], len(self._links) - 1 if self._places.get("a") else -1))


def _dropped(page: Page, texts: list[str], known: bool) -> list[bool]:
    """For each piece (with its text), whether it is inside of an element that is no text.

    An element that is no text but for what is around it (a form, an advert's
    class) is kept open to the block rules if hardly any text would be left
    without it: it is a wrapper of the page.
    """
    marks = page.marks
    closed_up = [0] * len(marks)  # the nearest mark that counts as a whole
    for i in range(1, len(marks)):
        closed_up[i] = i if marks[i][2] else closed_up[marks[i][0]]
    owner = [m if m and marks[m][3] == i else closed_up[m] for i, _, _, _, m in page.pieces]
    good, size = [0] * len(marks), [0] * len(marks)  # text by the block rules, and characters outside links, of each mark
    for text, (_, _, linked, _, _), m in zip(texts, page.pieces, owner):
        good[m] += len(text) if text and decide(text, linked, False, known) else 0
        size[m] += max(len(text) - linked, 0)
    own_good, own_size = list(good), list(size)
    for i in range(len(marks) - 1, 0, -1):
        up = closed_up[marks[i][0]]
        if up:
            good[up] += good[i]
            size[up] += size[i]
    out_good, out_size = own_good[0], own_size[0]
    articles = any(r and not m for (_, _, _, r, _), m in zip(page.pieces, owner))
    gone = [False] * len(marks)
    for i in range(1, len(marks)):
        up = closed_up[marks[i][0]]
        _, sure, _, _, inside = marks[i]
        holds = bool(inside & {"article", "main"})
        wraps = sure == MAYBE and not gone[up] and (
            out_size == 0 and (holds or "p" in inside) and size[i] > 0
            or good[i] > out_good and holds and not articles
            or good[i] > 4 * out_good and not articles
        )
        gone[i] = not wraps
        if wraps:
            out_good, out_size = out_good + own_good[i], out_size + own_size[i]
    return [gone[m] for m in owner]


def decide(text: str, linked: int, in_article: bool, known: bool = True) -> bool | None:
    """Pass one: True for text, False for none, None if open; ``known`` if the page's language has stop words here."""
    size = len(text)
    if linked / size > MANY_LINKS and (linked > 20 or not in_article):
        return False
    if not known:
        marks = len(SENTENCE.findall(text))
        if size > HIGH and marks or marks > 1 or marks and size >= LOW:
            return True
        return None if in_article or marks or not linked and size < LOW else False
    if size < LOW:
        return None if in_article or not linked else False
    stops = density(text)
    if stops >= STOPS_LOW:
        return True if size > HIGH or in_article else None
    return None if in_article else False


def density(text: str) -> float:
    """The share of stop words among the words."""
    words = WORD.findall(text.lower())
    return len([w for w in words if w in STOP_WORDS]) / max(len(words), 1)


def _plain(raw: str) -> str:
    return BLANKS.sub(" ", html.unescape(raw)).strip()


def main_text(page: str) -> str:
    """Text of the blocks that the two passes take for the article, a line each."""
    read = Page(page)
    texts = [_plain(x[1]) for x in read.pieces]
    known = density(" ".join(t for t, x in zip(texts, read.pieces) if t and x[2] / len(t) <= MANY_LINKS)) >= STOPS_LOW / 2
    joined: dict[int, list] = {}  # the pieces of a block that stay
    for (block, raw, linked, region, _), no in zip(read.pieces, _dropped(read, texts, known)):
        if not no:
            at = joined.setdefault(block, [[], 0, region])
            at[0].append(raw)
            at[1] += linked
    found = [(_plain("".join(raw)), linked, region) for raw, linked, region in joined.values()]
    found = [x for x in found if x[0]]
    # an article is evidence unless more text stands outside of it: cards that lead to other pages hold little
    outside = sum(len(t) for t, k, r in found if not r and decide(t, k, False, known))
    inside: dict[int, int] = {}
    for t, k, r in found:
        if r:
            inside[r] = inside.get(r, 0) + len(t) - k
    main = {r for r, n in inside.items() if n >= outside}
    labels = [decide(t, k, r in main, known) for t, k, r in found]
    decided = any(x is not None for x in labels)
    final, before, after = list(labels), _nearest(found, labels, 1), _nearest(found, labels, -1)
    for i, label in enumerate(labels):
        if label is None:
            near = [(abs(i - j), not labels[j]) for j in (before[i], after[i]) if j is not None]
            final[i] = not min(near)[1] if near else found[i][2] in main or not decided
    return "\n".join(b[0] for b, label in zip(found, final) if label)


def _nearest(found: list, labels: list, way: int) -> list[int | None]:
    """For each block, the nearest decided one of its region before it (way 1) or after it (-1)."""
    out: list[int | None] = [None] * len(found)
    last = None
    for i in range(len(found))[::way]:
        if 0 <= i - way < len(found) and found[i][2] != found[i - way][2]:
            last = None
        out[i] = last
        last = i if labels[i] is not None else last
    return out


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every row of ``pages``.

    Needs ``page_id``, ``url`` and ``html``; other columns are ignored. A null
    or empty page, or one without text, gives the empty string. Repeated rows
    each give their row; pages are read whole, in time linear in their length.
    The rest of a page after a script or style element without an end belongs
    to it, as in a browser. An empty table gives an empty result.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = [main_text(x or "") for x in pdf["html"]]
            yield pd.DataFrame({"page_id": pdf["page_id"].array, "url": pdf["url"].array, "text": texts, "n_chars": [len(t) for t in texts]})

    read = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return read.mapInPandas(run, "page_id long, url string, text string, n_chars long")
