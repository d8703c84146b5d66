import re

import pytest

from cinder.llm.catalog import op4_html_text
from cinder.llm.html_text import extract, render


@pytest.mark.parametrize(("page", "want"), [
    (None, ""), ("", ""), ("plain", "plain"), ("a < b & c &amp; d", "a < b & c & d"),
    ("<p>one<p>two</p>three", "one\n\ntwo\n\nthree"),
    ("<p>a <b>bold\n  text</b> c<br>d", "a bold text c\nd"),
    ("<div>a</div><div>b</div>", "a\nb"),
    ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>", "- a\n- b\n  - c\n- d"),
    ("<ol><li>a</li><li>b</li></ol>", "1. a\n2. b"),
    ("<table><tr><th>name<th>n<tr><td>x<td>10<tr><td>longer<td>2</table>", "name    n\nx       10\nlonger  2"),
    ("<table><td>a<td>b<tr><td colspan=2>wide cell<td>c</table>", "a  b\nwide cell  c"),
    ("<table><tr><td>a<br>b<td>c</table>", "a  c\nb"),
    ("<head><title>t</title></head><body>x", "x"),
    ("<script>var a='<p>no</p>'</script>y<style>p{}</style>z<!-- no --><template>no</template>", "yz"),
    ("<div hidden>no</div><p style='display: none'>no</p><p style=\"visibility:hidden\">no</p>yes", "yes"),
    ("<pre>a  b\n  c</pre>", "a  b\n  c"),
    ("<dl><dt>t<dd>d<dt>u<dd>e</dl>", "t\n  d\nu\n  e"),
    ("<p>x</b></i></p></div>y", "x\n\ny"), ("<p>unclosed <b>at <i>end", "unclosed at end"), ("a<", "a<"), ("<p", ""), ("a<!--", "a"),
])
def test_render(page, want):
    assert render(page) == want


@pytest.mark.parametrize("attributes", [
    'title="a hidden gem"', 'aria-label="show hidden items"', 'class="card hidden md:block"', "class='x' data-hidden",
    'style="overflow: hidden auto"', 'data-style="display:none"', "title='style=\"display:none\"'", 'alt="x hidden" class=hidden',
    'style="display:none; display:block"', 'style="background:url(a;display:none)"', 'style="--x:\'display:none\'"',
    'hidden style="display:block"', 'style="/* display:none */ color:red"', 'style="-x-display:none"', "href=/hidden",
])
def test_values_of_other_attributes_hide_nothing(attributes):
    assert render(f"<body {attributes}>shown <b>too</b></body>") == "shown too"


@pytest.mark.parametrize("attributes", [
    "hidden", "HIDDEN", 'hidden=""', "class=x hidden", 'title="a>b" hidden', "style=display:none", 'style="color:red;DISPLAY : NONE !important;display:block"',
    'style="display&#58;none"', "style='visibility:collapse'", 'style="display:none" style="display:block"',
])
def test_what_hides(attributes):
    assert render(f"<p {attributes}>no <b>no</b></p>yes") == "yes"


@pytest.mark.parametrize(("page", "want"), [
    ("<head><title>T</title>Hello <p>x", "Hello\n\nx"),
    ("<head><title>T</title><span><p>all of the page</p></span>", "all of the page"),
    *[(f"<html><head><meta charset=x><title>T</title>\n<{e}>one</{e}> two<div>three</div>", "one two\nthree") for e in ("a", "b", "strong", "font", "label", "button")],
    ("<head><link rel=x><img src=y>text", "text"), ("<head> \n &nbsp;a", "\xa0a"), ("<head></br>a", "a"),
    ("<head><style>no</style> <script>no</script><noscript>no<p>no</p></noscript><template><p>no</template><base><title>no</title></head>a", "a"),
    ("<head><title>the <body> tag and <b>more</title><p>a", "a"), ("<title>no</titles>no</title>a", "a"),
])
def test_the_head_ends_where_a_browser_ends_it(page, want):
    assert render(page) == want


@pytest.mark.parametrize(("page", "want"), [
    ("a <textarea>one  <b>&amp; two\n three</textarea> b", "a\none  <b>& two\n three\nb"),
    ("<p>a<xmp><b>x</b> &amp;  y\nz</xmp>b", "a\n\n<b>x</b> &amp;  y\nz\n\nb"),
    ("in <select name=x><option>one<option selected value=2>two</option><option>three</select> now", "in two now"),
    ("in <select><option disabled>pick<optgroup label=g><option>one</optgroup></select> now", "in one now"),
    ("<select><option hidden selected>pick</option><option>one</select>", "pick"),
    ("<select multiple><option>one<option>two</select>", "one\ntwo"),
    ("<div><select><option>one<option>two<p>rest</div>after", "one\n\nrest\nafter"),
    ("<select><option>one</option> rest", "one rest"),
    ("<select><option>one <b>bold</b></option></select><select><option>two", "one boldtwo"),
    ("<select><option>one</option><select><option>two</select> x", "onetwo x"),
    ("<p>so <math><mi>x</mi><mo>=</mo><mn>1</mn></math>.", "so x=1."),
    ("<math><semantics><mi>x</mi><annotation encoding=t>\\no</annotation></semantics></math> y", "x y"),
    ("a<svg><title>no</title><desc>no</desc><defs><text>no</text></defs><g><text x=1>one</text><text>two <tspan>three</tspan></text></g></svg>b",
     "aone two three b"),
    ("<svg><path d=''/><defs/><text>t</text></svg>b", "t b"), ("<svg><foreignObject><p>in</p></foreignObject></svg>", "in"),
    ("<div><svg><path d=''>lost<p>rest</div>after", "rest\nafter"), ("<div><math><mi>x<p>rest</div>after", "x\n\nrest\nafter"),
    ("<svg><g><svg><g><div>rest", "rest"), ("<div hidden><svg><text>no</text></svg></div>yes", "yes"),
    ("<object><p>shown</object>", "shown"), ("<object>shown", "shown"), ("<object data=x>no</object>yes", "yes"),
    ("<div hidden><select><option>no</select><textarea>no</textarea><xmp>no</xmp></div>yes", "yes"),
])
def test_elements_that_browsers_show(page, want):
    assert render(page) == want


def test_visibility_is_set_again_inside():
    assert render("<div style='visibility:hidden'>no <b style='visibility:visible'>yes</b> no</div>after") == "yes\nafter"
    assert render("<div style='display:none'>no <b style='visibility:visible;display:inline'>no</b></div>after") == "after"
    assert render("<table><tr><td data-colspan=2>a<td>b<tr><td colspan='2'>wide<td>c</table>") == "a  b\nwide  c"


def test_deep_and_long_pages():
    assert render("<div>" * 20_000 + "x" + "</div>" * 20_000) == "x"
    assert render("<p>word " * 50_000).count("word") == 50_000
    assert render("<a '" * 2_000) == ""


def test_query_keeps_every_visible_word(spark):
    """Compared with a plain stripping of markup: the same words in the same order."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()
    got = {r.page_id: r for r in op4_html_text(spark, "/root/testdata/sf0.01").collect()}
    assert len(got) == len(pages)
    import html
    for p in pages:
        body = re.sub(r"<!--.*?-->|<(script|style|title)\b.*?</\1\s*>", " ", p.html, flags=re.S)
        want = html.unescape(re.sub(r"<[^>]*>", "\x01", body)).replace("\x01", " ").split()
        mine = [w for line in got[p.page_id].text.split("\n") for w in re.sub(r"^\s*(- |\d+\. )", "", line).split()]
        assert "".join(mine) == "".join(want)
        assert got[p.page_id].n_chars == len(got[p.page_id].text)


def test_odd_rows(spark):
    rows = [(1, None, None, "x"), (None, "u", "", "x"), (2, "u", "<p>a", "x"), (2, "u", "<p>a", "x")]
    got = extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    assert sorted((r.page_id or 0, r.text, r.n_lines) for r in got) == [(0, "", 0), (1, "", 0), (2, "a", 1), (2, "a", 1)]
    assert extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_end_tags_stay_in_their_cell():
    page = "<table><tr><td>a</div></td><td>b</td></tr></table>"
    assert render("<div>" + page + "c</div>").split("\n") == ["a  b", "", "c"]
    assert render("<table><tr><td><b>x</p></span></td><td>y</td></tr></table>") == "x  y"
    assert render("<table><tr><td>in<table><tr><td>i</td></tr></table></td><td>o</td></tr></table>").split("\n") == ["in  o", "", "i"]


def test_cells_that_span_rows():
    page = "<table><tr><td rowspan=2>aa</td><td>b</td><td>c</td></tr><tr><td>d</td><td>e</td></tr><tr><td>f</td><td>g</td></tr></table>"
    assert render(page).split("\n") == ["aa  b  c", "    d  e", "f   g"]
    page = "<table><tr><td>a</td><td rowspan=3>b</td></tr><tr><td colspan=2>wide one</td></tr><tr><td>x</td><td>y</td></tr></table>"
    assert render(page).split("\n")[2] == "x     y"


def test_list_numbers():
    assert render("<ol start=5><li>a<li value=9>b<li>c</ol>").split("\n") == ["5. a", "9. b", "10. c"]
    assert render("<ol start=3 reversed><li>a<li>b</ol><ol><li>c</ol>").split("\n") == ["3. a", "2. b", "", "1. c"]


def test_time_grows_with_the_page():
    import time
    for page in ("<div>x</span>" * 8000, "<span><table><tr><td>" + "<div>x</span>" * 8000, "<div><p>y" * 8000, "<table><tr><td>" * 1500):
        began = time.process_time()
        text = render(page)
        assert time.process_time() - began < 1.5 and text.count("x") + text.count("y") == page.count("x") + page.count("y")
