"""HTML extraction by element lists and line-block distribution: windows where links outweigh text hold none."""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

# Element names by their part in a page.
RAW = {"script", "style", "noscript", "template", "svg", "math", "iframe", "textarea", "title", "object", "canvas", "video", "audio", "select"}
BOILERPLATE = {"nav", "header", "footer", "aside", "form", "menu", "dialog", "button", "head", "fieldset"}
BLOCKS = set("address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
#: Elements that hold text themselves: within an article or main element their class and id don't make them boilerplate.
TEXTUAL = set("a abbr b blockquote caption cite code dd dt em figcaption h1 h2 h3 h4 h5 h6 i kbd li mark p pre q s samp small span strong sub sup td th time u".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
NAMED = re.compile(r"(?:^|[-_\s])(?:ads?|adverts?|advertisements?|adsense|banner|sponsor(?:ed)?|promo(?:tion)?|sidebar|side-?bar|menu|nav(?:bar|igation)?|breadcrumbs?|header|footer|masthead|comments?|commentlist|respond|disqus|replies|cookies?|consent|gdpr|notices?|popup|modal|newsletter|subscribe|signup|login|share|sharing|social|related|recommended|widget|toolbar|pagination|pager|copyright|disclaimer)(?:$|[-_\s0-9])", re.I)
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "menu", "menubar", "dialog", "alert", "alertdialog"}

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?>(?:"[^"]*"|'[^']*'|[^>"'])*)>|[^<>]*>|[^<>]*\Z)""", re.S)
ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)|\b(hidden)\b""")
#: Lines in a window, and also the links from which on it can hold no text.
WINDOW = 3


def _unwanted(name: str, attributes: str, inside: bool) -> bool:
    if name in BOILERPLATE:
        return True
    if name in ("html", "body", "article", "main") or not attributes.strip(" />"):
        return False
    for key, value, hidden in ATTRIBUTE.findall(attributes):
        key, value = key.lower(), value.strip("\"'")
        if hidden or key == "aria-hidden" and value == "true" or key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return True
        if key in ("class", "id") and not (inside and name in TEXTUAL) and NAMED.search(value) or key == "role" and value.lower() in ROLES:
            return True
    return False


def lines(page: str) -> list[tuple[str, bool, int, int]]:
    """The page's lines, whether each lies in an article or main element, the length of its links and their number; every
    stripped element leaves WINDOW empty lines."""
    out: list[tuple[str, bool, int, int]] = []
    text: list[str] = []
    linked: list[str] = []
    depth: int | None = None  # of blocks opened within an open link
    fresh, links = True, 0
    closed: list[str] | None = None  # names of open elements within an unwanted one
    inside = at = 0

    def add(piece: str) -> None:
        nonlocal fresh, links
        text.append(piece)
        if depth is not None and piece.strip():
            linked.append(piece)
            links += fresh
            fresh = False

    def end_line() -> None:
        nonlocal fresh, links
        if text:
            within = len(" ".join(entities.unescape("".join(linked)).split())) if linked else 0
            out.append((" ".join(entities.unescape("".join(text)).split()), inside > 0, within, links))
            text.clear()
            linked.clear()
        fresh, links = True, 0

    def gap() -> None:
        end_line()
        out.extend([("", inside > 0, 0, 0)] * WINDOW)

    while (m := TOKEN.search(page, at)) is not None:
        if closed is None and m.start() > at:
            add(page[at : m.start()])
        at = m.end()
        if m[0].startswith("<![CDATA[") and closed is None:
            add(entities.escape(m[0][9:].removesuffix("]]>")))
        if m[2] is None:
            continue
        name, closing, attributes = m[2].lower(), m[1] == "/", m[3]
        if name in RAW and not closing:
            if not attributes.rstrip(">").endswith("/"):
                end = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, at)
                at = end.end() if end else (len(page) if name in ("script", "style") else at)
            if closed is None and name not in ("select",):
                text.append("")
            continue
        if closed is not None:
            if closing and name in closed:
                while closed.pop() != name:
                    pass
                if not closed:
                    closed = None
                    gap()
            elif closing and name in ("article", "main", "body", "html"):
                closed = None  # the unwanted element was never closed: it ends with what held it
                gap()
                inside = max(0, inside - (name in ("article", "main")))
            elif not closing and name not in VOID and not attributes.rstrip(">").endswith("/"):
                closed.append(name)
            continue
        if not closing and name not in VOID and _unwanted(name, attributes.rstrip(">"), inside > 0):
            gap()
            if name != "head" or re.search(r"</head", page[at:], re.I):
                closed = [name]
            continue
        if name == "a":
            depth, fresh = (None if closing or "href" not in attributes.lower() else 0), True
        if name in BLOCKS:
            end_line()
            if depth is not None and name not in VOID:
                depth = depth + (-1 if closing else 1)
                if depth < 0:  # a link that is never closed ends with the block that held it
                    depth = None
        if name in ("article", "main"):
            inside = max(0, inside + (-1 if closing else 1))
    if closed is None:
        add(page[at:])
    end_line()
    return out


def _has_text(run: list[tuple[str, bool, int, int]]) -> list[bool]:
    """Which lines of a run lie in a window where text surges: what is no link is at least as long as the links, or these
    are fewer than WINDOW. Lines of links that meet a dropped line go with it."""
    keep = [False] * len(run)
    for i in range(max(1, len(run) - WINDOW + 1)):
        block = run[i : i + WINDOW]
        if sum(x[3] for x in block) < WINDOW or sum(len(x[0]) - 2 * x[2] for x in block) >= 0:
            keep[i : i + WINDOW] = [True] * len(block)
    for order in (range(1, len(run)), range(len(run) - 2, -1, -1)):
        for i in order:
            before = i - 1 if order.step > 0 else i + 1
            if keep[i] and not keep[before] and 2 * run[i][2] > len(run[i][0]):
                keep[i] = False
    return keep


def main_text(page: str) -> str:
    """Lines without a stripped element between them are a run. Windows of WINDOW lines go over each run; a line is kept
    if text surges in a window that holds it, however short it is: link lists go, short paragraphs stay. If text surges
    nowhere, all lines are kept. Where article and main elements hold most of the text that is no link, only their lines
    count; elsewhere all lines do."""
    ls = lines(page)
    plain = [0, 0]
    for t, inside, within, _ in ls:
        plain[inside] += len(t) - within
    framed = plain[True] > plain[False]
    runs, empty = [[]], 0
    for x in ls:
        if not x[0] or framed and not x[1]:
            empty += 1
            continue
        if empty >= WINDOW and runs[-1]:
            runs.append([])
        runs[-1].append(x)
        empty = 0
    kept = [[x[0] for x, k in zip(run, _has_text(run), strict=True) if k] for run in runs]
    if not any(kept):
        kept = [[x[0] for x in run] for run in runs]
    return " ".join(t for k in kept for t in k)


def _run(batches: Iterator) -> Iterator:
    import pyarrow as pa

    for b in slices(batches):
        texts = [main_text(h or "") for h in b.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) for each row of pages(page_id, url, html), whole pages, without a shuffle.

    Script, style and other raw elements, head, menus, headers, footers, sidebars, forms, notices, adverts, comments and
    hidden parts go first, by element name, role or class; then main_text() finds the text among the lines left.
    Null and empty pages, and pages with no text, give an empty text.
    """
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return p.mapInArrow(_run, "page_id long, url string, text string, n_chars long")
