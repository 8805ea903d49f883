"""HTML extraction by line-block distribution.

Markup is stripped into lines, one for each block of the page, each with the length of its text outside links. Where an
element that is never running text (scripts, menus, forms, adverts, ...) is stripped with its content, a blank line
stays, and at the edges of an article or main element a whole window of blank lines. Sums of the lengths over sliding
windows of lines show where text surges and where it dives to nothing: text from the first surge to the last dive is
kept, of article and main elements if any of these has a surge, else of the page.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict
from functools import lru_cache
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as C

#: Lines of a window, and the characters that a window's sum reaches in a surge.
LINES, SURGE = 3, 80
# Elements by what they hold, and words of class, id and role that mark page furniture.
NEVER = frozenset("head script style template noscript iframe object svg canvas audio video map select button textarea".split())
DROPPED = frozenset("nav footer aside form dialog menu".split())
BLOCKS = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
FURNITURE = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising adsense banner sponsor sponsored promo promotion promotions nav navbar navigation menu menus breadcrumb breadcrumbs footer sidebar "
    "aside widget widgets cookie cookies notice notices consent gdpr popup modal overlay newsletter subscribe subscription signup login search searchbox form comment comments commentlist disqus reply replies "
    "respond share sharing social related recommended recommendations toolbar pagination pager copyright alert announcement skip contentinfo complementary tags".split()
)
#: These are furniture only as a whole name, or beside a place.
AMBIGUOUS = frozenset("sidebar aside form tags search banner overlay header".split())
#: What may stand beside a word of furniture in one name without changing what it says.
BESIDE = frozenset("area bar block box buttons container content group holder inner item items left level links list main outer panel posts primary right secondary section site slot thread top bottom unit wrap wrapper".split())
PLACES = frozenset("bottom left primary right secondary site top".split())
#: An element that begins where another of its kind is open, and no list or table of them begins in between, ends that one.
ENDS = {
    "li": (("li",), ("ul", "ol", "menu")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "option": (("option",), ("select",)),
    "tr": (("tr",), ("table",)),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
}
RAW = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*>?", re.I) for t in ("script", "style", "textarea", "title")}
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)(?:((?:\"[^\"]*\"|'[^']*'|[^>\"']++)*+)(?:>|\Z)|[^>]*(?:>|\Z))", re.S)
_ATTRIBUTE = re.compile(r"([^\s=\"'>/]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
_UNSEEN = re.compile(r"display\s*:\s*none", re.I)
#: Longest attributes whose elements' kinds are remembered.
REMEMBERED = 500
#: Kinds of elements: kept, furniture if it does not hold the text, gone whatever it holds.
KEPT, MAYBE, GONE = 0, 1, 2


def furniture_name(name: str) -> bool:
    """Whether one class, id or role, taken whole, names furniture."""
    words = [w for w in re.split(r"[^a-z0-9]+", re.sub(r"(?<=[a-z])(?=[A-Z])", "-", name).lower()) if w]
    some = FURNITURE.intersection(words)
    if len(some - AMBIGUOUS):
        return all(w in FURNITURE or w in BESIDE or w.isdigit() for w in words)
    return bool(some) and len(words) <= 3 and all(w in some or w in PLACES or w.isdigit() for w in words)


def kind_of(tag: str, attributes: str, at_home: bool) -> int:
    return (_kind_of if len(attributes) <= REMEMBERED else _kind_of.__wrapped__)(tag, attributes, at_home)


@lru_cache(1024)
def _kind_of(tag: str, attributes: str, at_home: bool) -> int:
    if tag in NEVER:
        return GONE
    if tag in ("html", "body", "main") or not attributes.strip():
        return MAYBE if tag in DROPPED or tag == "header" and not at_home else KEPT
    given = {name.lower(): value.strip("\"'") for name, value in _ATTRIBUTE.findall(attributes)}
    if "hidden" in given or given.get("aria-hidden", "").lower() == "true" or _UNSEEN.search(given.get("style", "")):
        return GONE
    if tag in DROPPED or tag == "header" and not at_home:
        return MAYBE
    names = [n for name in ("class", "id", "role") for n in given.get(name, "").split()]
    return MAYBE if any(furniture_name(n) or not at_home and re.fullmatch(r"(?:site|page|top|main)?-?header", n, re.I) for n in names) else KEPT


class Page:
    """The page's elements (parent, kind, home: the number of the innermost article or main element, 0 for none) and what happens in them, read in one pass.

    Every element ends with its parent if its own end is missing, also furniture. events: (element, text or None for
    a line's end, inside a link).
    """

    def __init__(self, page: str):
        self.parent, self.kind, self.home, self.homes = [0], [KEPT], [0], [0]
        self.events: list[tuple[int, str | None, bool]] = []
        self.stack: list[tuple[int, str]] = [(0, "")]
        self.at: dict[str, list[int]] = defaultdict(list)  # places in the stack of open elements, by tag
        self.blocks = [0]  # places in the stack of open blocks
        self.links: list[int] = []  # places of open links
        end = 0
        while m := _TOKEN.search(page, end):
            self._text(page[end : m.start()])
            end = m.end()
            tag = (m[2] or "").lower()
            if m[1]:
                self._end(tag)
            elif tag:
                self._begin(tag, m[3] or "", m[0].endswith("/>"))
                if tag in RAW and self.stack[-1][1] == tag:
                    close = RAW[tag].search(page, end)
                    stop = close.start() if close else len(page)
                    if tag == "title":
                        self._text(page[end:stop])
                    end = close.end() if close else len(page)
                    self._end(tag)
        self._text(page[end:])

    def _text(self, raw: str) -> None:
        if raw:
            self.events.append((self.stack[-1][0], html.unescape(raw), bool(self.links)))

    def _line(self) -> None:
        self.events.append((self.stack[-1][0], None, False))

    def _pop(self, place: int) -> None:
        """Everything from this place of the stack on ends."""
        for k in range(len(self.stack) - 1, place - 1, -1):
            tag = self.stack[k][1]
            self.at[tag].pop()
            if self.links and self.links[-1] == k:
                self.links.pop()
            if self.blocks[-1] == k:
                self.blocks.pop()
                self._line()
            self.stack.pop()

    def _begin(self, tag: str, attributes: str, closed: bool) -> None:
        if tag in BLOCKS and self.at["p"] and self.blocks[-1] == self.at["p"][-1]:
            self._pop(self.at["p"][-1])
        if tag in ENDS:
            same, scopes = ENDS[tag]
            place = max((self.at[t][-1] for t in same if self.at[t]), default=-1)
            if place > max((self.at[t][-1] for t in scopes if self.at[t]), default=-1):
                self._pop(place)
        if tag == "br":
            self.events.append((self.stack[-1][0], " ", False))
        elif tag in BLOCKS:
            self._line()
        if tag in VOID or closed:
            return
        up = self.stack[-1][0]
        kind = kind_of(tag, attributes, self.home[up] > 0)
        if tag == "main" or tag == "article" and kind == KEPT:
            self.homes.append(len(self.parent))
            self.home.append(len(self.homes) - 1)
        else:
            self.home.append(self.home[up])
        self.parent.append(up)
        self.kind.append(kind)
        place = len(self.stack)
        self.at[tag].append(place)
        if tag in BLOCKS:
            self.blocks.append(place)
        if tag == "a":
            self.links = [place]
        self.stack.append((len(self.parent) - 1, tag))

    def _end(self, tag: str) -> None:
        if tag == "a":
            self.links = []
        if not self.at[tag]:
            return
        place = self.at[tag][-1]
        if tag in BLOCKS or place > self.blocks[-1]:
            self._pop(place)

    def gone(self) -> list[bool]:
        """Of each element whether it goes with its content: scripts and the like, and furniture, unless it holds half of the text of the articles or, where there are none, of the page."""
        n = len(self.parent)
        letters, at_home = [0] * n, [0] * n
        never = [False] * n
        for e in range(1, n):
            never[e] = never[self.parent[e]] or self.kind[e] == GONE
        for e, text, linked in self.events:
            if text and not linked and not never[e]:
                size = len("".join(text.split()))
                letters[e] += size
                at_home[e] += size if self.home[e] else 0
        for e in range(n - 1, 0, -1):
            letters[self.parent[e]] += letters[e]
            at_home[self.parent[e]] += at_home[e]
        share = at_home if at_home[0] else letters
        out = [False] * n
        for e in range(1, n):
            out[e] = out[self.parent[e]] or self.kind[e] == GONE or self.kind[e] == MAYBE and 2 * share[e] <= share[0]
        return out

    def lines(self, window: int = LINES) -> list[tuple[str, int, int]]:
        """(text, characters outside links, home) of each block with text, in page order, with a blank line where furniture was and `window` of them at the edges of homes."""
        gone, out, parts, size, home, gap = self.gone(), [], [], 0, 0, False
        for e, text, linked in self.events:
            if gone[e]:
                gap |= bool(text and text.strip())
            elif text is not None:
                parts.append(text)
                size += 0 if linked else len(text.strip())
                home = self.home[e]
                continue
            if parts:
                line = " ".join("".join(parts).split())
                if line:
                    if out and out[-1][2] != home:
                        out += [("", 0, home)] * window
                    elif gap:
                        out.append(("", 0, home))
                    out.append((line, min(size, len(line)), home))
                    gap = False
                parts.clear()
                size = 0
        return out


def lines_of(page: str, window: int = LINES) -> list[tuple[str, int, int]]:
    parsed = Page(page)
    parsed.events.append((0, None, False))
    return parsed.lines(window)


def window_sums(size: list[int], window: int) -> list[int]:
    """At each line the sum over the `window` lines about it."""
    half = window // 2
    total = [0, *accumulate(size)]
    return [total[min(len(size), i + half + 1)] - total[max(0, i - half)] for i in range(len(size))]


def stretches(sums: list[int], surge: int) -> list[tuple[int, int]]:
    """[from, to) of runs between a rise from zero and the fall back to it that reach `surge` somewhere."""
    out, start = [], None
    for i, s in enumerate([*sums, 0]):
        if s and start is None:
            start = i
        elif not s and start is not None:
            if max(sums[start:i]) >= surge:
                out.append((start, i))
            start = None
    return out


def main_text(page: str | None, window: int = LINES, surge: int = SURGE) -> str:
    """The page's main text: blocks joined by one space; empty if there is none.

    Where no sum reaches `surge`, the highest does, of homes if they have text; links count as text if there is no other.
    """
    lines = lines_of(page, window) if page else []
    size = [n for _, n, _ in lines]
    sums = window_sums(size, window)
    if max(sums, default=0) < surge:
        at_home = [n if home else 0 for _, n, home in lines]
        size = at_home if any(at_home) else size if any(size) else [len(text) for text, _, _ in lines]
        sums = window_sums(size, window)
        surge = max(sums, default=0)
    # Blank lines part homes, so a stretch has one home's text, and at its ends perhaps a line of links of another's.
    by_home: dict[int, list[int]] = {}
    for a, b in stretches(sums, surge):
        home = lines[max(range(a, b), key=size.__getitem__)][2]
        own = [i for i in range(a, b) if lines[i][2] == home and (home or size[i])]
        by_home.setdefault(home, []).extend((own[0], own[-1]))
    if any(by_home):
        by_home.pop(0, None)
    keep = sorted({i for ends in by_home.values() for i in range(ends[0], ends[-1] + 1)})
    return " ".join(lines[i][0] for i in keep if lines[i][0])


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The columns `keep` of every page, its main text and n_chars (code points); a scan without shuffle.

    Null and empty html give empty text; very long pages are read whole, in one pass; repeated rows come out each, and
    of two equal sums none is preferred, since all stretches are kept; malformed and cut-off markup is read as far as
    it goes; an empty table gives no rows; nulls in `keep` are passed on; columns of any name and type can be kept
    except `text` and `n_chars`, whose names the results have; other columns are not looked at.
    """
    C.bound_batches(pages.sparkSession)
    source = pages.select(*[C.col(pages, c).alias(f"k{k}") for k, c in enumerate(keep)], C.col(pages, html_col).cast("string").alias("text"))
    kinds = T.StructType([*(T.StructField(c, pages.schema[c].dataType) for c in keep), T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(batches):
        for batch in C.slices(batches):
            text = [main_text(t) for t in C.column(batch, "text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(C.column(batch, f"k{k}") for k in range(len(keep))), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], [*keep, "text", "n_chars"])

    return source.mapInArrow(C.released(run), kinds)


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
