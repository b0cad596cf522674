"""Main text of web pages by nearest-URL page differencing.

Each page becomes lines (block texts in page order), marked by where they stand: inside the article (or main) element,
outside it, or in a landmark that is never main text (menu, header, footer, sidebar, notice, advert, form, comments).
Landmarks are left out whether or not a neighbour has them, and text lines of an article are kept either way (licences
and quotations repeat across articles). Differencing decides the others: all lines of a page without an article, and
those lines of an article that are links for the most part (menus and lists of related pages that no landmark marks).

Pages are ordered by host and URL path over the cluster, without gathering a host; a page is paired with the pages
before and after it on its host, the one whose path agrees longer first. Their lines outside landmarks are aligned by
longest common subsequence and the shared ones that are open to decision are deleted. What is left of a page that has an
article is the article; otherwise it is every line left.

Pages of one host with the same lines are one page for pairing (that of the least path and page_id) and share its
result. A neighbour of the same url, one with the same article, or one that would leave a page without an article no
line, is a copy and is not compared with.

Defined results: null or empty html gives an empty text; a null or odd url has an empty host and path; ties are ordered
by page_id; repeated rows get equal texts; very long pages are read whole; an empty table gives an empty result; other
columns are ignored. A header inside an article is its headline and stays. A page that repeats another of a different
url except for a few lines keeps those lines alone. An element of plain text (title, textarea) that is never closed is
taken as absent; an unclosed script or style reaches to the next block element.
"""

from __future__ import annotations

import html as entities
import re
from bisect import bisect_left
from collections.abc import Iterator
from hashlib import blake2b
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .neighbours import with_neighbours

# HTML element names by role, and words of class, id and role attributes that mark what is not main text.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
BOILER = set("nav header footer aside form dialog menu".split())
BLOCK = set("address article aside blockquote body br_ caption center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
MARKS = set("ad ads advert advertisement banner breadcrumb breadcrumbs comment comments cookie consent footer header menu modal nav navbar navigation newsletter notice popup promo related share sidebar social sponsor sponsored subscribe".split())
PLACES = set("area article bar block bottom box button buttons container content desktop entry fixed form global group inner item items left links list main mobile outer page panel post posts primary right secondary section side site slot sticky top unit widget wrap wrapper".split())
QUOTES = set("blockquote callout definition epigraph footnote note pullquote quote quotation tip".split())
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
# Which open elements the start of another one ends, and inside which elements it does not reach out (HTML's rules of implied end tags).
KINDS = {"p": "p", "li": "li", "dt": "dt", "dd": "dt", "td": "td", "th": "td", "tr": "tr", "tbody": "tbody", "thead": "tbody", "tfoot": "tbody"}
ENDS_P = set("address article aside blockquote center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main menu nav ol p pre section summary table ul".split())
ENDS = {x: ("p",) for x in ENDS_P} | {"li": ("li", "p"), "dt": ("dt", "p"), "dd": ("dt", "p"), "td": ("td",), "th": ("td",), "tr": ("tr", "td"), "tbody": ("tbody", "tr", "td"), "thead": ("tbody", "tr", "td"), "tfoot": ("tbody", "tr", "td")}
SHUTS = {x: ("li", "dt") for x in ENDS_P - {"address", "div", "p", "li", "dt", "dd", "hr"}} | {x: ("p", "li", "dt") for x in ("td", "th", "caption", "object")} | {"table": ("p", "li", "dt", "td", "tr", "tbody")}
TOKEN = re.compile(
    r"<!--.*?(?:-->|$)"
    r"|<!\[CDATA\[(?:[^<\]]|\](?!\]>)|<(?!!\[CDATA\[))*+\]\]>"
    r"|<[!?][^<>]*+(?:>|(?=<))"
    r"|<(/?)([A-Za-z][^\s/<>]*+)((?:[^<>\"']|\"[^\"<]*+\"|'[^'<]*+')*+(?=>)|[^<>]*+)(?:>|(?=<))"
    r"|([^<]+|<)", re.S)
MUTE = "script style noscript template title textarea iframe svg select button".split()
END = {x: re.compile(rf"</{x}(?=[\s/>])", re.I) for x in MUTE}
CODE = {"script", "style"}
AGAIN = re.compile(r"<(?:body|main|article|section|header|div|h[1-6]|p)(?=[\s/>])", re.I)
ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert"}
OUTSIDE, MAIN, LINKED = 0, 1, 2
SPACE = re.compile(r"\s+")


def _marked(attributes: str, article: bool) -> bool:
    """Whether the attributes of an element say that it is not main text. A class or id does so where one of its names is made
    of marks and of words for places only (``site-header``, not ``cookie-recipe``)."""
    for a, x, y, z in ATTRIBUTE.findall(attributes):
        a, value = a.lower(), (x or y or z).lower()
        if a == "hidden" or (a == "aria-hidden" and value == "true") or (a == "role" and value in ROLES):
            return True
        if a in ("class", "id"):
            for name in value.split():
                parts = {x for x in re.split("[_-]+", name) if x}
                if parts & (MARKS - {"header"} if article else MARKS) and parts <= MARKS | PLACES:
                    return True
    return False


def _quotes(attributes: str) -> bool:
    return any(not QUOTES.isdisjoint(re.split(r"[\s_-]+", (x or y or z).lower())) for a, x, y, z in ATTRIBUTE.findall(attributes) if a.lower() == "class")


def page_lines(page: str) -> list[tuple[int, str]]:
    """(MAIN, LINKED or OUTSIDE, text) of each block that may be main text, in page order. LINKED: a line of the article that is
    mostly links. Takes time in proportion to the page: what is open is counted by name, and each element that another one ends
    is known by its place."""
    out: list[tuple[int, str]] = []
    text: list[str] = []
    stack: list[tuple] = []  # element, and as it stood before: depth of boilerplate, of forms in that, of articles, open elements by kind
    count: dict[str, int] = {}
    missing: set[str] = set()
    boiler = forms = main = linked = 0
    near: dict[str, int] = {}
    link = False

    def flush() -> None:
        nonlocal linked
        line = SPACE.sub(" ", "".join(text)).strip()
        if line:
            out.append((OUTSIDE if not main else LINKED if 2 * linked >= sum(map(len, text)) else MAIN, line))
        text.clear()
        linked = 0

    def shut(at: int) -> None:
        nonlocal boiler, forms, main, near
        boiler, forms, main, near = stack[at][1:]
        for x in stack[at:]:
            count[x[0]] -= 1
        del stack[at:]

    tokens = TOKEN.finditer(page)
    while (m := next(tokens, None)) is not None:
        close, name, attributes, words = m.groups()
        if words is not None:
            if not boiler:
                text.append(entities.unescape(words))
                linked += len(text[-1]) * link
            continue
        if name is None:
            continue
        name = name.lower()
        if name == "br":
            text.append(" ")
            continue
        if name == "a":
            link = not close
        if name in BLOCK or name in BOILER:
            flush()
        if close:
            if name in KINDS:
                at = near.get(KINDS[name], -1)
                if at >= 0 and stack[at][0] == name:
                    shut(at)
            elif count.get(name):
                shut(next(i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name))
            continue
        if name in END:
            if not attributes.endswith("/"):  # what stands inside is not markup: go on at the closing tag itself
                end = None if name in missing else END[name].search(page, m.end())
                if not end:
                    missing.add(name)  # nor is there one further on
                    if name in CODE:
                        end = AGAIN.search(page, m.end())
                        if not end:
                            break
                if end:
                    tokens = TOKEN.finditer(page, end.start())
            continue
        ended = [near[x] for x in ENDS.get(name, ()) if near.get(x, -1) >= 0]
        if ended:
            shut(min(ended))
        if name in VOID or attributes.endswith("/"):
            continue
        stack.append((name, boiler, forms, main, near))
        count[name] = count.get(name, 0) + 1
        if name in SHUTS or name in KINDS:
            near = near | dict.fromkeys(SHUTS.get(name, ()), -1)
            if name in KINDS:
                near[KINDS[name]] = len(stack) - 1
        article = bool(count.get("article"))
        marked = bool(attributes.strip()) and name not in ("html", "body", "article", "main") and name not in HEADINGS and _marked(attributes, article)
        if marked or (name in BOILER and not (article and (name == "header" or (name == "aside" and _quotes(attributes))))):
            boiler += 1
            forms += name == "form" and not marked
        if name in ("article", "main"):
            if boiler == forms:  # a form around the whole page hides no article
                boiler = forms = 0
            main += not boiler
    flush()
    return out


def common_lines(a: list[str], b: list[str]) -> set[int]:
    """Positions in ``a`` of a longest common subsequence with ``b``."""
    where: dict[str, list[int]] = {}
    for j, line in enumerate(b):
        where.setdefault(line, []).append(j)
    ends: list[int] = []
    last: list[tuple] = []
    for i, line in enumerate(a):
        for j in reversed(where.get(line, ())):
            k = bisect_left(ends, j)
            node = (i, last[k - 1] if k else None)
            if k == len(ends):
                ends.append(j)
                last.append(node)
            else:
                ends[k], last[k] = j, node
    found, node = set(), last[-1] if last else None
    while node:
        found.add(node[0])
        node = node[1]
    return found


def _path(url: str | None) -> tuple[str, str]:
    try:
        parts = urlsplit(url or "")
        return parts.netloc.lower(), parts.path
    except ValueError:
        return "", ""


def _agree(a: str, b: str) -> int:
    return next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


def _difference(row: dict, before: dict | None, after: dict | None) -> dict:
    if row["sig"] is None:  # nothing to decide: only stands beside others
        return {}
    near = [x for x in (before, after) if x and x["host"] == row["host"] and (row["url"] is None or x["url"] != row["url"])]
    near.sort(key=lambda x: -_agree(x["path"], row["path"]))
    left = list(range(len(row["outside"])))
    for other in near:
        if row["body"] is not None and other["body"] == row["body"]:
            continue
        shared = common_lines([row["outside"][i] for i in left], other["outside"])
        if row["body"] is not None or len(shared) < len(left):  # a page that has all lines is a copy, and shows nothing
            left = [x for i, x in enumerate(left) if i not in shared]
    return {"host": row["host"], "sig": row["sig"], "gone": sorted(set(range(len(row["outside"]))) - set(left))}


def _digest(lines: list[str]) -> bytes:
    return blake2b("\0".join(lines).encode("utf-8", "surrogatepass"), digest_size=16).digest()


LINES = "page_id long, url string, host string, path string, text string, lines array<string>, open array<int>, outside array<string>, body binary, sig binary"


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines of each page. text: the main text where nothing is left to decide. Else lines: all that may stay, outside:
    those outside articles or open to decision, open: the positions in lines of these (-1: not among them)."""
    for b in batches:
        for lo in range(0, len(b), 500):
            part = b.slice(lo, 500)
            columns: list[list] = [[] for _ in range(7)]
            for page in part.column(2).to_pylist():
                found = page_lines(page or "")
                article = [t for k, t in found if k == MAIN]
                stays = (MAIN, LINKED) if article else (OUTSIDE, LINKED)
                may, other = [x for x in found if x[0] in stays], [x for x in found if x[0] != MAIN]
                decide = bool(other) and any(k != OUTSIDE for k, _ in other) if article else bool(other)
                at = iter([i for i, (k, _) in enumerate(may) if k != MAIN])
                values = [None, [t for _, t in may], [next(at) if k in stays else -1 for k, _ in other], [t for _, t in other], _digest(article) if article else None, None]
                if decide:
                    values[5] = _digest(values[3]) + (values[4] or b"")
                else:
                    values[0], values[1], values[2] = "\n\n".join(article), None, None
                for column, value in zip(columns, values):
                    column.append(value)
            places = [_path(x) for x in part.column(1).to_pylist()]
            kinds = [pa.string(), pa.list_(pa.string()), pa.list_(pa.int32()), pa.list_(pa.string()), pa.binary(), pa.binary()]
            yield pa.record_batch([
                part.column(0), part.column(1), pa.array([h for h, _ in places], pa.string()), pa.array([p for _, p in places], pa.string()),
                *[pa.array(c, k) for c, k in zip(columns, kinds)],
            ], names=[x.split()[0] for x in LINES.split(", ")])


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row of ``pages`` (page_id, url, html)."""
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    lines = materialize(rows.mapInArrow(_lines, LINES), "lines")
    whole, undecided = lines.where("sig is null"), lines.where("sig is not null")
    out = whole.select("page_id", "url", "text")
    if not undecided.isEmpty():
        least = F.min(F.struct("path", "page_id", "url")).alias("of")
        copies = undecided.groupBy("host", "sig").agg(least, F.first("outside").alias("outside"), F.first("body").alias("body"))
        beside = copies.select("host", "of.path", "of.page_id", "of.url", "outside", "body", "sig").unionByName(whole.select("host", "path", "page_id", "url", "outside", "body", "sig"))
        context = lambda r: {x: r[x] for x in ("host", "path", "url", "outside", "body")}
        left = with_neighbours(beside, [F.col("host"), F.col("path"), F.col("page_id")], context, _difference, "host string, sig binary, gone array<int>").where("sig is not null")
        gone = F.transform("gone", lambda i: F.get("open", i))
        text = F.array_join(F.filter("lines", lambda x, i: ~F.array_contains(gone, i)), "\n\n").alias("text")
        out = out.unionByName(undecided.join(left, ["host", "sig"]).select("page_id", "url", text))
    return out.withColumn("n_chars", F.length("text").cast("long"))


op3_html_extract = extract_pages
