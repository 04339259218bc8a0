"""Main text of web pages, by wrappers inferred from pages of the same host.

A page becomes a balanced stream of block tags and texts; a tag is named with its
class and id, and inline markup belongs to the text around it. Neighboring equal
stretches of the stream fold into repeated groups. The streams of a host are then
aligned one after the other with the wrapper so far, a regular expression without
unions: equal tags stay, texts that differ become slots, a stretch that only one
side has becomes optional, and a single stretch that the other side repeats
becomes a repeated group.

The wrapper's slots hold how much text its pages put there. The main region is
the smallest container with most of the text that changes from page to page;
text that is the same on every page counts little, and menus, footers, adverts
and the like count nothing. A page's main text is what its main region holds,
without such parts inside, one block after the other.

Each task keeps one wrapper per host of its pages, and a host's wrappers from all
tasks are merged, so a host with a third of all pages gathers one small row per
task. Streams of any length are aligned in the same way, by a longest common
subsequence, and a wrapper holds all that its pages hold, however much; a task hands
its wrappers on when they have ``HELD_ITEMS`` items together. Pages that
lack the main region are read by their own structure (article, then main, then
the whole body). All pages are learned from and all are extracted.

Defined cases: a null html is empty and has no text; a null or odd url belongs to
the host without a name; repeated rows are extracted each; unclosed tags end with
their parents; a page cut off in a tag loses that tag only; very long pages are
extracted whole; equal pages have equal texts; other columns are not read, whatever
their names; an empty table gives no rows.
"""

from __future__ import annotations

import html as entities
import json
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from cohortline.llm.text import pieces
from cohortline.session import materialize

HELD_ITEMS = 200_000
MAX_PERIOD = 48
MAIN_SHARE = 0.6
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(script|style|noscript|template|iframe|object|svg|math|canvas|textarea|title|select)\b[^>]*>.*?(?:</\1\s*>|\Z)"
    r"|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>"
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)"
    r"|[^<]+|<", re.S | re.I)
_ATTRIBUTE = re.compile(r"(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?(?=[\s/]|\Z)", re.I)
_HOST = re.compile(r"\s*[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp "
                   "small span strike strong sub sup time tt u var wbr".split())
NOISE_TAGS = frozenset("nav footer aside form button dialog menu head input option fieldset".split())
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar form".split())
NOISE_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion sidebar side menu nav navbar navigation "
    "breadcrumb breadcrumbs footer header masthead cookie cookies consent notice notices popup modal overlay newsletter subscribe "
    "subscription signup login social share sharing related recommended recommendations comment comments disqus reply replies "
    "respond pagination pager widget toolbar skip".split())
CONTAINERS = frozenset("body main article section div td center".split())
# an opening tag of the key ends open ones of the value, back to the nearest container
CLOSES = {"p": {"p"}, "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"},
          "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "option": {"option"}}
CLOSES |= {t: {"p"} for t in "div ul ol dl table h1 h2 h3 h4 h5 h6 article section main header footer nav aside form pre blockquote "
           "hr figure address fieldset".split()}


def host_of(url: str | None) -> str:
    found = _HOST.match(url or "")
    return found[1].lower() if found else ""


def attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(text)} if text else {}


def is_noise(tag: str, own: dict[str, str], in_article: bool) -> bool:
    """Whether an element is a menu, footer, advert or the like."""
    if tag in NOISE_TAGS or (tag == "header" and not in_article):
        return True
    if not own:
        return False
    if "hidden" in own or own.get("aria-hidden") == "true" or "display:none" in own.get("style", "").replace(" ", ""):
        return True
    if own.get("role", "").lower() in NOISE_ROLES:
        return True
    names = set(re.split(r"[^a-z0-9]+", (own.get("class", "") + " " + own.get("id", "")).lower()))
    return bool(names & NOISE_NAMES) and tag not in ("body", "html", "article", "main")


def events(page: str) -> Iterator[tuple[str, str, bool]]:
    """Balanced stream of ("open", label, noise), ("close", label, noise) and ("text", block, noise).

    ``noise`` says whether the place lies in an element that is not main text.
    """
    stack: list[tuple[str, str, bool]] = []
    noisy, articles, words = 0, 0, []

    def flush():
        if words:
            block = " ".join(entities.unescape("".join(words)).split())
            words.clear()
            if block:
                yield "text", block, noisy > 0

    def pop():
        nonlocal noisy, articles
        tag, label, noise = stack.pop()
        event = "close", label, noisy > 0
        noisy -= noise
        articles -= tag in ("article", "main")
        return event

    for m in _TOKEN.finditer(page):
        tag = (m[3] or m[6] or "").lower()
        if not tag:
            if m[0][0] != "<" or m[0] == "<":
                words.append(m[0])
            elif m[1] is None:
                continue
            continue
        if tag in INLINE:
            if tag in ("br", "wbr", "img"):
                words.append(" ")
            continue
        yield from flush()
        if m[2] or m[5]:
            if any(s[0] == tag for s in stack):
                while stack[-1][0] != tag:
                    yield pop()
                yield pop()
            continue
        if tag in ("article", "main"):
            # nothing that was left open keeps an article out of the text
            while noisy and stack and not (stack[-1][2] and _is_comment(stack[-1][1])):
                yield pop()
        ends = CLOSES.get(tag, ())
        while stack and stack[-1][0] in ends:
            yield pop()
        if tag in VOID:
            continue
        own = attributes(m[4] or m[7] or "")
        noise = is_noise(tag, own, articles > 0)
        label = ".".join([tag, *sorted(own.get("class", "").lower().split()), *(["#" + own["id"].lower()] if own.get("id") else [])])
        stack.append((tag, label, noise))
        noisy += noise
        articles += tag in ("article", "main")
        yield "open", label, noisy > 0
    yield from flush()
    while stack:
        yield pop()


def _is_comment(label: str) -> bool:
    return bool({"comment", "comments", "reply", "replies", "respond", "disqus"} & set(re.split(r"[^a-z]+", label)))


# A wrapper is a list of items [key, text, weight, pages, children]:
# key "<label" or ">label" for tags, "#" for text, "(...)+" for repeated groups; text None once it differs

def stream(page: str) -> list[list]:
    """A page's items, with texts as slots of one page; repeated groups folded."""
    items = []
    for kind, value, noise in events(page):
        if kind == "text":
            items.append(["#", value if len(value) <= 80 else None, 0 if noise else len(value), 1, None])
        else:
            items.append([("<" if kind == "open" else ">") + value, None, 0, 1, None])
    return folded(items)


def joined(one: list, two: list) -> list:
    """Two items of one key as one."""
    children = [joined(a, b) for a, b in zip(one[4], two[4])] if one[4] else None
    return [one[0], one[1] if one[1] == two[1] else None, one[2] + two[2], one[3] + two[3], children]


def group(children: list[list]) -> list:
    return ["(" + " ".join(c[0] for c in children) + ")+", None, 0, 1, children]


def folded(items: list[list]) -> list[list]:
    """Equal neighboring stretches as repeated groups, short periods first."""
    for period in range(1, MAX_PERIOD + 1):
        if len(items) < 2 * period:
            break
        keys = [i[0] for i in items]
        out, at = [], 0
        while at < len(items):
            unit = keys[at:at + period]
            balanced = unit[0][0] == "<" and unit[-1] == ">" + unit[0][1:] or period == 1 and unit[0][0] == "("
            if not balanced or keys[at + period:at + 2 * period] != unit:
                out.append(items[at])
                at += 1
                continue
            children = items[at:at + period]
            at += period
            while keys[at:at + period] == unit:
                children = [joined(a, b) for a, b in zip(children, items[at:at + period])]
                at += period
            out.append(group(children) if period > 1 else children[0])
        items = out
    return items


def absorbed(items: list[list], groups: list[list]) -> list[list]:
    """Single stretches that the other side repeats, as groups too."""
    for g in groups:
        keys, n = [c[0] for c in g[4]], len(g[4])
        out, at = [], 0
        while at < len(items):
            if items[at][0] == keys[0] and [i[0] for i in items[at:at + n]] == keys:
                out.append(group(items[at:at + n]))
                at += n
            else:
                out.append(items[at])
                at += 1
        items = out
    return items


def aligned(a: list[str], b: list[str]) -> Iterator[tuple[bool, int, int]]:
    """A longest common subsequence of two lists of any length, as steps ``(both, i, j)``.

    Each step names the place reached; with ``both``, a[i] and b[j] are a match. A row of
    the table of common lengths is one integer: bit k says that the row grows by one at
    b[-1 - k]. Every ``every``-th row is kept and those between are made again, so memory grows
    with len(b) times the root of len(a).
    """
    places: dict[str, int] = {}
    for j, key in enumerate(b):
        places[key] = places.get(key, 0) | 1 << (len(b) - 1 - j)
    ones, every = (1 << len(b)) - 1, math.isqrt(len(a)) + 1

    def row_before(row: int, key: str) -> int:
        here = places.get(key, 0)
        fits = here | row
        return fits & ~(fits - (row << 1 | 1)) & ones

    kept, row = {len(a): 0}, 0
    for i in range(len(a) - 1, -1, -1):
        row = row_before(row, a[i])
        if i % every == 0:
            kept[i] = row
    rows: dict[int, int] = {}

    def below(i: int) -> int:
        if i not in rows:
            end = min(len(a), (i // every + 1) * every)
            rows.clear()
            rows[end] = kept[end]
            for k in range(end - 1, i // every * every - 1, -1):
                rows[k] = row_before(rows[k + 1], a[k])
        return rows[i]

    def common(row: int, j: int) -> int:
        return (row & (1 << (len(b) - j)) - 1).bit_count()

    i = j = 0
    # common lengths of what lies behind (i + 1, j)
    under = common(below(1), 0) if a else 0
    over = common(below(0), 0) if a else 0
    while i < len(a) and j < len(b):
        if a[i] == b[j]:
            yield True, i, j
            i, j = i + 1, j + 1
        elif under >= over - (below(i) >> (len(b) - 1 - j) & 1):
            i += 1
            yield False, i, j
        else:
            over -= below(i) >> (len(b) - 1 - j) & 1
            under -= below(i + 1) >> (len(b) - 1 - j) & 1
            j += 1
            yield False, i, j
            continue
        if i < len(a):
            over, under = common(below(i), j), common(below(i + 1), j)


def merged(wrapper: list[list], page: list[list]) -> list[list]:
    """The wrapper generalized to cover another stream."""
    page = absorbed(page, [i for i in wrapper if i[4]])
    wrapper = absorbed(wrapper, [i for i in page if i[4]])
    a, b = [i[0] for i in wrapper], [i[0] for i in page]
    if a == b:
        return [joined(x, y) for x, y in zip(wrapper, page)]
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    x, y = wrapper[head:len(a) - tail], page[head:len(b) - tail]
    middle, i, j = [], 0, 0
    for both, i_next, j_next in aligned(a[head:len(a) - tail], b[head:len(b) - tail]):
        # what only one side has becomes optional: seen on fewer pages than its neighbors
        middle += x[i:i_next] + y[j:j_next]
        i, j = i_next, j_next
        if both:
            middle.append(joined(x[i], y[j]))
            i, j = i + 1, j + 1
    middle += x[i:] + y[j:]
    ends = [joined(p, q) for p, q in zip(wrapper[len(a) - tail:], page[len(b) - tail:])] if tail else []
    return folded([joined(p, q) for p, q in zip(wrapper[:head], page[:head])] + middle + ends)


def main_region(wrapper: list[list]) -> str:
    """Label of the smallest container with most of the changing text; empty if there is none.

    An article or main element with a third of all text is taken first.
    """
    totals: dict[tuple[str, ...], float] = {(): 0.0}
    named: dict[str, int] = {}
    path: list[str] = []

    def walk(items: list[list], repeated: bool) -> None:
        for key, text, weight, pages, children in items:
            if children:
                walk(children, True)
            elif key[0] == "<":
                path.append(key[1:])
            elif key[0] == ">":
                if key[1:] in path:
                    while path.pop() != key[1:]:
                        pass
            else:
                value = weight * (0.1 if text is not None and pages > 1 and not repeated else 1.0)
                for k in range(len(path) + 1):
                    part = tuple(path[:k])
                    totals[part] = totals.get(part, 0.0) + value
                for label in {p for p in ["", *path] if p.split(".")[0] in ("", "article", "main")}:
                    named[label] = named.get(label, 0) + weight

    walk(wrapper, False)
    most = max((x for x in named if x), key=lambda x: named[x], default="")
    if most and 3 * named[most] >= named[""] > 0:
        return most
    here, label = (), ""
    while True:
        inner = [p for p in totals if len(p) == len(here) + 1 and p[:-1] == here and totals[p] >= MAIN_SHARE * totals[here] > 0]
        if not inner:
            return label
        here = max(inner, key=lambda p: totals[p])
        if here[-1].split(".")[0] in CONTAINERS:
            label = here[-1]


def main_text(page: str, region: str) -> str:
    """Blocks of the page's main region, two line breaks between them."""
    found: dict[str, list[str]] = {"region": [], "article": [], "main": [], "page": []}
    inside = dict.fromkeys(found, 0) | {"page": 1}
    for kind, value, noise in events(page):
        if kind == "text":
            if not noise:
                for name, depth in inside.items():
                    if depth > 0:
                        found[name].append(value)
        else:
            step = 1 if kind == "open" else -1
            tag = value.split(".", 1)[0]
            if value == region:
                inside["region"] += step
            if tag in ("article", "main"):
                inside[tag] += step
    best = next((blocks for blocks in found.values() if blocks), [])
    return "\n\n".join(best)


def wrappers(pages: DataFrame) -> DataFrame:
    """``host``, ``region``: the main region of each host's pages. Takes ``url`` and ``html``."""
    schema = "host string, wrapper string"

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, list] = {}
        held = 0
        arrow = pa.schema([("host", pa.string()), ("wrapper", pa.string())])

        def flush():
            for k in range(0, len(known), 512):
                part = list(known.items())[k:k + 512]
                yield pa.RecordBatch.from_arrays([pa.array([h for h, _ in part], pa.string()),
                                                  pa.array([json.dumps(w) for _, w in part], pa.string())], schema=arrow)
            known.clear()

        for batch in batches:
            for part in pieces(batch, "html"):
                for url, page in zip(part.column("url").to_pylist(), part.column("html").to_pylist()):
                    host, items = host_of(url), stream(page)
                    before = known.get(host)
                    known[host] = items if before is None else merged(before, items)
                    held += len(known[host]) - (len(before) if before else 0)
                if held > HELD_ITEMS:
                    yield from flush()
                    held = 0
        yield from flush()

    def combine(table: pa.Table) -> pa.Table:
        whole = None
        # in a fixed order, so that a repeated task gives the same wrapper
        for text in sorted(table.column("wrapper").to_pylist()):
            items = json.loads(text)
            whole = items if whole is None else merged(whole, items)
        return pa.table({"host": table.column("host").slice(0, 1), "region": pa.array([main_region(whole)], pa.string())})

    found = pages.select("url", F.coalesce("html", F.lit("")).alias("html")).mapInArrow(learn, schema)
    return found.groupBy("host").applyInArrow(combine, "host string, region string")


def extracted(pages: DataFrame, id_column: str = "page_id", url_column: str = "url", html_column: str = "html") -> DataFrame:
    """One row per page: ``page_id``, ``url``, ``text``, ``n_chars``."""
    rows = pages.select(F.col(f"`{id_column}`").cast("long").alias("page_id"), F.col(f"`{url_column}`").alias("url"),
                        F.coalesce(F.col(f"`{html_column}`"), F.lit("")).alias("html"))
    regions = materialize(wrappers(rows), "wrappers")
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^\s*[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "html"):
                texts = [main_text(page, region or "") for page, region in zip(part.column("html").to_pylist(),
                                                                               part.column("region").to_pylist())]
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()),
                                                  pa.array(list(map(len, texts)), pa.int64())], schema=schema)

    return rows.withColumn("host", host).join(regions, "host", "left").select("page_id", "url", "html", "region").mapInArrow(
        run, "page_id long, url string, text string, n_chars long")
