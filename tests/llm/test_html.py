import time
from collections import Counter

from pyspark.sql import functions as F

from ledgerloom.llm.html_extract import LINKED, MAIN, OUTSIDE, common_lines, extract_pages, page_lines

SCHEMA = "page_id long, url string, html string"


def _texts(spark, rows):
    return {r.page_id: r.text for r in extract_pages(spark.createDataFrame(rows, SCHEMA)).collect()}


def test_scripts_are_not_markup():
    body = "<article><p>whole text</p></article>"
    for head in ("<script>for(var i=0;i<n;i++){f(i)}</script>", "<SCRIPT>if(a<b&&c>d)g('<p>')</Script >", "<style>a{content:'<b'}</style>", "<script>var s='</scripts>';i<n</script><style>p<a{}</style>"):
        assert page_lines(f"<html><head>{head}</head><body>{body}</body></html>") == [(MAIN, "whole text")], head
    assert page_lines(f"<div><button>go{body}</div>") == [(OUTSIDE, "go"), (MAIN, "whole text")]
    assert page_lines("<p>one</p><script>i<n") == [(OUTSIDE, "one")]


def test_broken_markup_loses_no_text():
    assert page_lines('<article><p title="a>one</p><p title=\'b>two</p></article>') == [(MAIN, "one"), (MAIN, "two")]
    assert page_lines('<article><p title="a > b">one</p></article>') == [(MAIN, "one")]
    for name in ("title", "textarea", "noscript", "script", "style"):
        assert (MAIN, "text") in page_lines(f"<head><{name}>x <body><article><p>text</p></article>"), name
    assert page_lines("<article><header><h1>Head</h1></header><p>a</p><footer>f</footer></article><header>site</header>") == [(MAIN, "Head"), (MAIN, "a")]
    assert page_lines('<article><div class="entry-header"><h1>Head</h1></div><div class="share">s</div></article><div class="header">site</div>') == [(MAIN, "Head")]
    assert page_lines("<article><p>see <a>this</a> and that</p><ul><li><a>More</a></ul></article>") == [(MAIN, "see this and that"), (LINKED, "More")]


def test_marks_end_with_their_element():
    """Implied end tags close what is marked, and a mark is a whole name, not a part of one."""
    cases = {
        '<article><p class="ad">Ad<h2>Title</h2><div>text one</div><p>para two</p></article>': ["Title", "text one", "para two"],
        '<article><ul><li class="share">Share<li>real item</ul><p>end</article>': ["real item", "end"],
        '<article><dl><dt class="ad">x<dd>one<dt>two</dl><table><tr><td class="promo">y<td>three<tr><td>four</table></article>': ["one", "two", "three", "four"],
        '<article><div class="cookie-recipe">one</div><div class="content related-work">two</div><h2 id="menu">three</h2><aside class="pullquote">four</aside></article>': ["one", "two", "three", "four"],
        '<article><ul><li>a<ul><li class="ad">b</ul>c<li>d</ul><p class="ad">x<b>y<p>e</article>': ["a", "c", "d", "e"],
        '<form id="page"><div>skip</div><article><p>one</p><form>mail</form></article>skip</form>': ["one"],
        '<article><aside>side</aside><div class="site-footer ad-slot">x</div><p id="comment_list">y</p><p>one</p></p></article>': ["one"],
        '<article><p class="ad"><table><tr><td><p>z</p></td></tr></table><p>one<a href=x <b>two</b></article>': ["z", "onetwo"],
        '<article>a<![CDATA[ x < y ]]>b<![CDATA[ c</article>': ["ab"],
    }
    for page, want in cases.items():
        assert [t for _, t in page_lines(page)] == want, page


def test_broken_markup_takes_linear_time():
    """A megabyte or so of each kind of broken markup; every one of them took seconds a few ten kilobytes with a quadratic scan."""
    parts = ["<b>", "<a ", "<![CDATA[ ", "</q>", "<title>", "<p class=ad>", "<li>", "<td>", "<p><table><td>", "<!x ", "<a b='", '<a b="c" "', "<div><p></div>", "<script>x</script>", "<textarea><b>"]
    for part in parts:
        page = "<article><p>first</p>" + part * (1_000_000 // len(part)) + "<p>last</p></article>"
        began = time.process_time()
        found = page_lines(page)
        assert time.process_time() - began < 20, part
        assert found[0] == (MAIN, "first"), part


def test_copies_keep_their_text(spark):
    page = "<body><div>Shared</div><div>only {}</div></body>"
    rows = [(i, f"http://a/{url}", page.format(n)) for i, (url, n) in enumerate([("1", 1), ("1", 1), ("1b", 1), ("2", 2)])]
    rows += [(4, "http://b/1", page.format(4)), (5, "http://b/1", page.format(4)), (6, "http://c/1", page.format(6)), (7, "http://c/1", page.format(7)), (8, None, page.format(8)), (9, None, page.format(8))]
    rows += [(10, "http://d/1", "<p>x</p><p>y</p>"), (11, "http://d/2", "<p>x</p><p>y</p><p>z</p>"), (12, "http://e/1", "<p>s</p><article>t</article>"), (13, "http://e/2", "<p>s</p><p>u</p>"), (14, "http://e/2", None)]
    both = "Shared\n\nonly {}"
    assert _texts(spark, rows) == {0: "only 1", 1: "only 1", 2: "only 1", 3: "only 2", 4: both.format(4), 5: both.format(4), 6: both.format(6), 7: both.format(7), 8: both.format(8), 9: both.format(8),
                                   10: "x\n\ny", 11: "z", 12: "t", 13: "u", 14: ""}


def test_links_inside_articles(spark):
    page = "<article><p>Text {}</p><p>A licence</p><ul><li><a href=x>Home</a><li><a href=y>{}</a></ul></article>"
    rows = [(1, "http://a/1", page.format(1, "one")), (2, "http://a/2", page.format(2, "two")), (3, "http://a/2b", page.format(2, "two")), (4, "http://b/1", page.format(4, "four"))]
    text = "Text {}\n\nA licence\n\n{}"
    # the shared link goes, the licence and the page's own links stay; a page alone on its host keeps all
    assert _texts(spark, rows) == {1: text.format(1, "one"), 2: text.format(2, "two"), 3: text.format(2, "two"), 4: text.format(4, "Home\n\nfour")}


def test_sites_without_articles(spark):
    """Menus that no landmark marks are found by differencing alone; compared with a plain version."""
    rows, want = [], {}
    for host in range(3):
        for n in range(12):
            own = [f"host {host} page {n} line {i}" for i in range(n % 4 + 1)]
            lines = [f"Menu {host}", "Search", *own, f"Imprint {host}"]
            rows.append((host * 100 + n, f"http://h{host}.example/a/{n:02d}", "".join(f"<div>{x}</div>" for x in lines)))
            want[host * 100 + n] = "\n\n".join(own)
    table = spark.createDataFrame(rows, SCHEMA).withColumns({"text": F.lit("clash"), "host": F.lit(1)})
    got = {r.page_id: r.text for r in extract_pages(table.repartition(5)).collect()}
    assert got == want
    assert extract_pages(table.where("false")).count() == 0


def test_common_lines():
    a, b = list("abcbdab"), list("bdcaba")
    found = common_lines(a, b)
    assert len(found) == 4 and not Counter(a[i] for i in found) - Counter(b)
    assert common_lines([], ["x"]) == set() and common_lines(["x"], []) == set()


def test_null_and_odd_pages(spark):
    rows = [(None, None, None), (None, "::bad[", "<p>a</p>"), (7, "http://h/1", ""), (7, "http://h/1", ""), (8, "http://[", "x" * 100_000)]
    got = sorted((r.page_id or 0, r.text, r.n_chars) for r in extract_pages(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == [(0, "", 0), (0, "a", 1), (7, "", 0), (7, "", 0), (8, "x" * 100_000, 100_000)]
