from helpers import details, kinds_at, rows_of

from sievelight.operators import pages as pg

PLANTED = """\
<!DOCTYPE html>
<html>
<head>
<meta charset="utf-8">
</head>
<body>
<p>intro</p>
<img src="harbour.png">
<label>Ship</label>
<input type="text" name="ship">
<p style="color:#a1b2c3; padding-left:4px">Ahoy</p>
</body>
</html>
"""
CLEAN = """\
<!DOCTYPE html>
<html lang="he" dir="rtl">
<head><title>Harbour</title></head>
<body>
<img src="harbour.png" alt="">
<label for="ship">Ship</label><input id="ship">
<label>Crew <select name="crew"></select></label>
<input aria-label="Port"><input type="submit"><textarea title="Log"></textarea>
<p style="color:var(--sea); margin-inline-start:4px">Ahoy</p>
<style>p { inset-inline: 0; color: var(--ink); }</style>
</body>
</html>
"""


def pages(spark, *htmls):
    rows = [(i, f"https://a.test/p{i}", h) for i, h in enumerate(htmls, 1)]
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def test_planted_page(spark):
    found = pg.page_findings(pages(spark, PLANTED))
    assert kinds_at(found) == {
        "missing-lang": [None],
        "no-title": [None],
        "missing-alt": [8],
        "missing-label": [10],
        "hardcoded-color": [11],
        "physical-css": [11],
    }
    text = details(found)
    assert "a1b2c3" not in text and "harbour" not in text and "Ship" not in text
    roll = pg.site_rollup(found, pages(spark, PLANTED, CLEAN))
    assert rows_of(roll, "findings", "pages", "checks") == [(1, 2, 7)] * 6


def test_clean_page_is_silent(spark):
    assert pg.page_findings(pages(spark, CLEAN)).count() == 0


def wrap(body, head='<html lang="en"><head><title>t</title></head>'):
    return f"{head}<body>{body}</body></html>"


def test_direction_of_hebrew_pages(spark):
    htmls = [wrap("", f'<html lang="{a}"{d}><head><title> t </title></head>') for a, d in (("he", ""), ("he", " dir='RTL'"), ("en", ""), ("he-IL", " dir=ltr"))]
    assert rows_of(pg.page_head(pages(spark, *htmls)), "source", "kind") == [("1", "missing-dir"), ("4", "missing-dir")]


def test_blank_title_over_lines(spark):
    assert rows_of(pg.page_head(pages(spark, "<html lang=en><title>\n \n</title>")), "kind") == [("no-title",)]


def test_placeholder_is_no_label(spark):
    found = pg.missing_label(pages(spark, wrap('<input type="text" placeholder="x">'), wrap("<label>a</label>\n<SELECT></SELECT>")))
    assert rows_of(found, "source", "row", "detail") == [
        ("1", 1, "line 1: input control without a label, aria-label or title"),
        ("2", 2, "line 2: select control without a label, aria-label or title"),
    ]


def test_external_css_and_blocks(spark):
    page = pages(spark, wrap("<style>\n.x { float : left }\n</style>"))
    css = spark.createDataFrame([(1, "p { color: #fff; }"), (2, "")], "page_id long, css string")
    styles = pg.style_sources(page, css)
    assert rows_of(pg.hardcoded_color(styles), "row", "key") == [(None, "css")]
    assert rows_of(pg.physical_css(styles), "row", "key") == [(1, "style block")]


def test_physical_words(spark):
    css = ["left: 0", "margin-inline: 0", "inset-left : 1px", "text-align:right", "clear : left", "--my-left: 1", "border-left-width:1px"]
    styles = spark.createDataFrame([(i, "css", c, None) for i, c in enumerate(css)], "page_id long, name string, css string, line int")
    assert rows_of(pg.physical_css(styles), "source") == [("0",), ("3",), ("4",), ("6",)]


def test_links(spark):
    html = wrap(
        '<a href="#top" id="top">t</a><a href="#gone">g</a><a href="#">n</a><a href="p2?x=1">ok</a><a href=\'./sub/../p2#y\'>ok</a>'
        '<a href="missing.html">m</a><a href="/p1">ok</a><a href="mailto:a@b.test">m</a><a href="https://b.test/x">e</a>'
        '<a href="//a.test/p2">ok</a><a name="x">none</a>'
    )
    page = pages(spark, html, wrap("<input><img><input type=hidden>"))
    assert rows_of(pg.broken_anchor(page, include_text=True), "source", "key") == [("1", "#gone")]
    assert rows_of(pg.broken_link(page, include_text=True), "source", "key") == [("1", "missing.html")]
    assert pg.broken_link(page).first()["key"] is None
    assert rows_of(pg.link_stats(page), "page_id", "links", "external", "inputs", "images") == [(1, 10, 1, 0, 0), (2, 0, 0, 1, 1)]


def test_browser_log(spark):
    rows = [
        (1, "error", "widget broke", None, None, None),
        (1, "error", "Failed to load resource: 404", None, None, None),
        (1, "log", "fine", None, None, None),
        (1, "exception", "Error: x\n at y", None, None, None),
        (1, "response", None, "https://a.test/z", 404, None),
        (1, "response", None, "https://a.test/z", 200, None),
        (1, "failed", "net::ERR", None, None, True),
        (1, "failed", "net::ERR", None, None, None),
    ]
    events = spark.createDataFrame(rows, "page_id long, type string, text string, url string, status int, canceled boolean")
    assert rows_of(pg.browser_event_defects(events), "kind", "detail") == [
        ("bad-request", "failed"),
        ("bad-request", "status 404"),
        ("console-error", "error"),
        ("console-error", "exception"),
    ]
    assert "Error: x" in details(pg.browser_event_defects(events, include_text=True))
