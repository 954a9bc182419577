"""Main text by the page's tree."""

from quillgraph.sources import article as A
from quillgraph.sources import pages

LONG = "The firm, which was founded in a garage, invested in several companies, and sold most of them again."
PAGE = f"""<!DOCTYPE html><html><head><title>T</title><style>p {{ color: red }}</style></head><body>
<nav><a href=/>Home</a><a href=/x>Other</a></nav>
<div class="wrapper"><div id="sidebar"><p>{LONG} This one is in the sidebar, however long, with commas, many.</p></div>
<article><h1>Heading</h1><p>{LONG}</p><p>Second, <a href="/l">linked</a> and <b>bold</b> words &amp; signs, in a row.<p>Third paragraph, never closed, but read all the same.
<ul><li>An item of a list, as long as it needs to be, with a comma.</li></ul><table><tr><td>cell</td></tr></table></article>
<div><a href="/1">{LONG}</a></div>
<section class="comments"><p>{LONG} A reader says so, too, at some length, again.</p></section></div>
<footer>Imprint, and so on, and so forth, for ever and ever.</footer><script>var x = "<p>no</p>";</script></body></html>"""


def test_an_article_by_hand():
    lines = A.article(PAGE).split("\n")
    assert lines == ["Heading", LONG, "Second, linked and bold words & signs, in a row.", "Third paragraph, never closed, but read all the same.", "An item of a list, as long as it needs to be, with a comma."]


def test_odd_pages():
    assert A.article(None) is None and A.article("") == "" and A.article("just text") == "just text"
    assert A.article("<p>short</p><p>words</p>") == "short\nwords"
    assert A.article("<div>" * 5000 + "deep" + "</div>" * 10) == "deep"
    assert A.article("<p>cut off in a <b") .startswith("cut off in a")
    assert A.article("<nav><p>never closed") == ""
    assert A.article("</p></div>stray ends") == "stray ends"


def test_tables(spark):
    df = spark.createDataFrame([("u", PAGE), ("v", None)], "url string, html string")
    rows = {r.url: r for r in pages.raw_documents(df, A.article_text).collect()}
    assert rows["u"].text == A.article(PAGE) and rows["u"].title == "T" and rows["u"].char_count == len(rows["u"].text)
    assert rows["v"].status == "error" and rows["v"].text == ""
    # the page's own words, whichever way they are found
    assert LONG in pages.raw_documents(df).where("url = 'u'").first().text
