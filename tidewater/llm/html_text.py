"""Main text of web pages by two-pass block rules.

The page is cut into blocks at block-level tags. Pass one decides blocks by
where they stand (menus, footers, forms, adverts, comments ...), link density,
length and stop-word density, and leaves short blocks open. In pass two an open
block takes the label of its nearest decided neighbour in the same zone
(article or page).
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Element names of HTML and common words of four languages.
RAW = "script style noscript template textarea iframe svg math object canvas select"
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead title tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
OUTSIDE = frozenset("head title nav footer aside menu button dialog search".split())
HINTS = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus "
    "footer form header login masthead menu modal nav navbar navigation newsletter notice notices pagination popup promo promoted related replies "
    "respond rail search share sharing sidebar signup skip social sponsor sponsored subscribe subscription tags toolbar widget widgets".split()
)
COMMENTS = frozenset("comment comments disqus replies respond".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar".split())
STOP = frozenset(
    "a an and are as at be by for from has he in is it its of on or that the this to was were which with you "
    "aber als auch auf aus bei das dem den der des die ein eine einen er es für hat im ist mit nicht sch sich sie sind und von war wie zu "
    "au aux avec ce dans de des du elle en est et il la le les leur mais ne on ou par pas pour que qui se sur un une "
    "al como con de del el en era es la las lo los más no o para pero por que se sin su un una y ya".split()
)

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?:svg|math)\b(?:\"[^\"]*\"|'[^']*'|[^>\"'])*/>"
    rf"|<(?P<raw>{RAW.replace(' ', '|')})\b(?:\"[^\"]*\"|'[^']*'|[^>\"'])*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:\"[^\"]*\"|'[^']*'|[^>\"'])*)>"
    r"|<[!?][^>]*(?:>|\Z)|</[^>]*(?:>|\Z)|<[a-zA-Z][^>]*(?:>|\Z)",
    re.S | re.I,
)
_NAMED = re.compile(r"""\b(class|id|role|style|hidden|aria-hidden)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

SHORT, LONG = 70, 200
LINKED, STOPPED = 0.34, 0.1


#: Shares of the text around it from which on a suspect is not boilerplate: one with
#: a heading, any other, and one that is named for comments.
HEADED, HOLDS, DISCUSSED = 0.3, 0.5, 0.9


def _suspicion(tag: str, attrs: str, inside: bool) -> int:
    """0: none, 1: its name speaks against it (2: for comments), 3: boilerplate whatever it holds."""
    if tag in OUTSIDE or (tag == "header" and not inside):
        return 3
    found = int(tag == "form")
    if not attrs or tag in ("html", "body", "article", "main"):
        return found
    for name, value in _NAMED.findall(attrs):
        name, value = name.lower(), value.strip("\"'")
        if name in ("class", "id"):
            own = {x.lower() for x in _PARTS.findall(value)} & HINTS
            if own and not (inside and own == {"header"}):
                found = max(found, 2 if own & COMMENTS else 1)
        elif name == "role" and value.lower() in ROLES:
            return 3
        elif name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and re.search(r"display\s*:\s*none", value)):
            return 3
    return found


class Suspect:
    """An element whose name speaks against it. What it holds decides."""

    __slots__ = ("outer", "zone", "comments", "size", "article", "heading")

    def __init__(self, outer: int, zone: int, comments: bool):
        self.outer, self.zone, self.comments = outer, zone, comments
        self.size, self.article, self.heading = 0, False, False


def _condemned(suspects: list[Suspect], sizes: dict[int, int]) -> list[bool]:
    """A suspect is spared if it holds the article, or most of the text that
    stands beside it: of its article if it lies in one, else of the page."""
    for x in reversed(suspects):  # inner ones come later
        if x.outer >= 0:
            outer = suspects[x.outer]
            outer.size += x.size
            outer.article |= x.article
            outer.heading |= x.heading
    whole, out = sum(sizes.values()), []
    for x in suspects:
        share = x.size / max(1, sizes.get(x.zone, 0) if x.zone else whole)
        spared = x.article or share >= (DISCUSSED if x.comments else HEADED if x.heading else HOLDS)
        out.append(not spared or (x.outer >= 0 and out[x.outer]))
    return out


class Block:
    __slots__ = ("parts", "linked", "zone", "bad", "suspect")

    def __init__(self, zone: int, bad: bool, suspect: int):
        self.parts: list[str] = []
        self.linked = 0
        self.zone, self.bad, self.suspect = zone, bad, suspect


def blocks(page: str) -> list[tuple[str, float, int, bool]]:
    """(text, link density, zone, stands in boilerplate) in page order."""
    found: list[Block] = []
    open_: list[tuple[str, bool, int, int]] = []  # tag, opens boilerplate, opens a zone, the suspect around it (-2: it is none itself)
    suspects: list[Suspect] = []
    places: dict[str, list[int]] = {}  # of each tag, where it stands in open_
    opened: list[int] = []  # where block tags stand
    bad = zones = links = at = 0
    zone, suspect = 0, -1
    now = Block(0, False, -1)

    def cut() -> None:
        nonlocal now
        if now.parts:
            found.append(now)
        now = Block(zone, bad > 0, suspect)

    def say(raw: str) -> None:
        if raw:
            now.parts.append(raw)
            if links:
                now.linked += len(raw.strip())

    def close(k: int) -> None:
        nonlocal bad, zone, links, suspect
        ends = False
        while len(open_) > k:
            tag, was_bad, was_zone, around = open_.pop()
            places[tag].pop()
            if tag in BLOCKS:
                opened.pop()
            bad -= was_bad
            links -= tag == "a"
            if was_zone:
                zone = 0
            if around > -2:
                suspect = around
            ends |= was_bad or around > -2
        if ends:  # what follows stands outside
            cut()

    for m in _TOKEN.finditer(page):
        say(page[at : m.start()])
        at = m.end()
        tag = (m["tag"] or "").lower()
        if not tag:
            continue
        if m["end"]:
            k = places[tag][-1] if places.get(tag) else None
            if tag in BLOCKS:
                if k is not None:
                    close(k)
                cut()
            elif k is not None and not (opened and opened[-1] > k):
                close(k)
            continue
        if tag == "br":
            say(" ")
            continue
        if tag in VOID:
            if tag == "hr":
                cut()
            continue
        if tag in BLOCKS:
            # a paragraph, item or cell ends the one before it, and inline tags left open in it
            while open_ and (open_[-1][0] not in BLOCKS or (open_[-1][0] == "p")):
                close(len(open_) - 1)
            if open_ and open_[-1][0] == tag and tag in ("li", "dd", "dt", "td", "th", "tr", "option"):
                close(len(open_) - 1)
        inside = zone > 0
        new_zone = tag in ("article", "main") and not inside
        if new_zone:
            zones += 1
            zone = zones
        level = _suspicion(tag, m["attrs"], zone > 0)
        is_bad, around = level == 3, -2
        bad += is_bad
        if level in (1, 2):
            suspects.append(Suspect(suspect, zone, level == 2))
            around, suspect = suspect, len(suspects) - 1
        elif suspect >= 0 and not bad:
            suspects[suspect].article |= bool(new_zone)
            suspects[suspect].heading |= tag == "h1"
        links += tag == "a"
        places.setdefault(tag, []).append(len(open_))
        if tag in BLOCKS:
            opened.append(len(open_))
        open_.append((tag, is_bad, zone if new_zone else 0, around))
        if tag in BLOCKS or level:
            cut()
    say(page[at:])
    cut()
    texts = [" ".join(html.unescape("".join(b.parts)).split()) for b in found]
    sizes: dict[int, int] = {}
    for b, text in zip(found, texts):
        if not b.bad:
            sizes[b.zone] = sizes.get(b.zone, 0) + len(text)
            if b.suspect >= 0:
                suspects[b.suspect].size += len(text)
    gone = _condemned(suspects, sizes)
    return [(text, b.linked / len(text), b.zone, b.bad or (b.suspect >= 0 and gone[b.suspect])) for b, text in zip(found, texts) if text]


def _density(text: str) -> float:
    words = text.lower().split()
    return sum(w.strip(".,;:!?\"'()") in STOP for w in words) / len(words)


def labels(found: list[tuple[str, float, int, bool]]) -> list[bool]:
    """Whether each block is main text."""
    first: list[bool | None] = []
    zoned = any(zone and not bad for *_, zone, bad in found)
    # longer blocks almost without these stop words: another language, so length and links decide
    long = [_density(text) for text, linked, _, bad in found if len(text) >= SHORT and linked <= LINKED and not bad]
    foreign = bool(long) and max(long) < STOPPED / 2
    for text, linked, zone, bad in found:
        if bad or linked > LINKED:
            first.append(False)
            continue
        density = _density(text)
        if zone:  # an article keeps what nothing speaks against
            first.append(True if len(text) >= SHORT or density >= STOPPED else None)
        elif zoned:  # the page names its article; what stands elsewhere needs strong signs
            first.append(True if len(text) >= LONG and density >= 2 * STOPPED and not linked else False)
        elif len(text) < SHORT:
            first.append(None)
        elif foreign:
            first.append(True)
        elif density >= STOPPED:
            first.append(True if len(text) >= LONG or density >= 2 * STOPPED else None)
        else:
            first.append(len(text) >= LONG and density >= STOPPED / 2)
    # nearest decided block of the zone on either side, in two sweeps
    n, near = len(found), []
    for order in (range(n), range(n - 1, -1, -1)):
        last: dict[int, int] = {}
        side = [-1] * n
        for i in order:
            zone, bad = found[i][2:]
            side[i] = last.get(zone, -1)
            if first[i] is not None and not bad:
                last[zone] = i
        near.append(side)
    out = []
    for i, (decided, a, b) in enumerate(zip(first, *near)):
        if decided is None:
            far = [abs(i - j) if j >= 0 else n for j in (a, b)]
            decided = any(first[j] for j, d in zip((a, b), far) if j >= 0 and d == min(far)) if min(far) < n else True
        out.append(bool(decided))
    return out


def main_text(page: str | None) -> str:
    found = blocks(page or "")
    return " ".join(b[0] for b, ok in zip(found, labels(found)) if ok)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        text = [main_text(x) for x in batch.column("html").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column("page_id"), batch.column("url"), pa.array(text, pa.string()), pa.array([len(x) for x in text], pa.int64())],
            ["page_id", "url", "text", "n_chars"],
        )


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of each row; a null page is an empty one,
    repeated rows stay repeated, an empty table gives none."""
    cols = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return cols.mapInArrow(_extract, "page_id long, url string, text string, n_chars long")
