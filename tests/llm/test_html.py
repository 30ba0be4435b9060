import re
import time
from html.parser import HTMLParser

from hypothesis import given, settings
from hypothesis import strategies as st

from trialloom.llm.html import Tags, render

SF = "/root/testdata/sf0.01"


class Words(HTMLParser):
    """Words outside head, script and style, with no layout at all."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.skip, self.out = 0, []

    def handle_starttag(self, tag, attrs):
        self.skip += tag in ("script", "style", "title")

    def handle_endtag(self, tag):
        self.skip -= tag in ("script", "style", "title")

    def handle_data(self, data):
        if not self.skip:
            self.out += data.split()


def test_blocks_and_spaces():
    assert render("<p>a  b\n c<p>d<br>e</p>f<div>g</div>h") == "a b c\n\nd\ne\n\nf\ng\nh"
    assert render("x<b> y </b> z") == "x y z"
    assert render("<h1>T</h1>t<pre>\n a\n  b</pre>u") == "T\n\nt\n\n a\n  b\n\nu"
    assert render("a &lt;b&gt; &amp;amp; &nbsp;c") == "a <b> &amp; \xa0c"
    assert render("1 < 2 and <3") == "1 < 2 and <3"
    assert render("<blockquote>q<p>r</blockquote>s") == "> q\n\n> r\n\ns"


def test_lists():
    assert render("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>e") == "- a\n- b\n  - c\n- d\n\ne"
    assert render("<ol start=3><li>a</li><li value=9>b</li><li>c</ol>") == "3. a\n9. b\n10. c"
    assert render("<dl><dt>a<dd>b<dt>c<dd>d</dl>") == "a\n    b\nc\n    d"
    assert render("<ul><li></li><li>x</ul>") == "-\n- x"


def test_tables():
    assert render("<table><tr><th>ab<th>c<tr><td>d<td>efg</table>x") == "ab  c\nd   efg\n\nx"
    assert render("<table><caption>t</caption><td>a<td>b<br>c<td>d</table>") == "t\na  b  d\n   c"
    assert render("<table><tr><td rowspan=2>a<td>b<tr><td>c<tr><td colspan=2>long long<tr><td>x<td>y</table>") == "a  b\n   c\nlong long\nx  y"
    assert render("<table><tfoot><tr><td>foot</tfoot><tr><td>body</table>") == "body\nfoot"
    assert render("<table><tr><td>a<table><tr><td>b<td>c</table><td>d</table>") == "a     d\n\nb  c"
    assert render("<td>loose") == "loose"


def test_visibility():
    assert render("<head><title>t</title></head><script>x</script>a<!-- b --><style>p{}</style><div hidden>c</div>") == "a"
    assert render("<style>.ad, #n {display: none}</style><p class='x ad'>a</p><p id=n>b</p><p>c") == "c"
    assert render("<span style='visibility:hidden'>a</span>b<input type=hidden value=c><input value=d>") == "bd"
    assert render("<details><summary>s</summary>x</details><details open><summary>t</summary>y</details>") == "s\nt\ny"
    assert render("<script>if (a<b) '</p>'</script>z<noscript>n</noscript>") == "z"


def test_odd_pages():
    assert render(None) == render("") == render("<!doctype html>") == ""
    assert render("</p></div>a</b>") == "a"
    assert render("<a href='x>y") == "<a href='x>y"
    assert render("<div>" * 5000 + "deep" + "</div>" * 5000) == "deep"
    assert render("<table><tr><td>" * 300 + "deep").strip() == "deep"
    start = time.time()
    assert len(render("<p>word <b>bold</b>" * 50_000)) > 400_000
    assert time.time() - start < 20


def test_pages_keep_every_word(spark):
    rows = spark.read.parquet(f"{SF}/pages.parquet").collect()
    for r in rows:
        w = Words()
        w.feed(r.html)
        got = re.sub(r"(?m)^( *)- ", r"\1", render(r.html)).split()
        assert sorted(got) == sorted(w.out), r.page_id


def test_extract_cases(spark):
    from trialloom.llm.html import extract_text

    rows = [(1, None, "t"), (2, "", "t"), (None, "<p>x", None), (3, "<p>y", "t"), (3, "<p>y", "t")]
    df = spark.createDataFrame(rows, "page_id long, html string, text string")
    assert sorted([(r.page_id, r.text, r.n_chars) for r in extract_text(df).collect()], key=str) == sorted([(1, "", 0), (2, "", 0), (None, "x", 1), (3, "y", 1), (3, "y", 1)], key=str)
    assert extract_text(df.limit(0)).collect() == []


def test_svg_and_math_show_their_text():
    assert render("a <svg><title>t</title><desc>d</desc><metadata/><g><rect width='1'/><text>One <tspan>two</tspan></text><text>three</text></g>no</svg> b") == "a One two three b"
    assert render("<svg><path d='M0'/><foreignObject><p>in</p></foreignObject></svg><p>out") == "in\n\nout"
    assert render("<svg><g><p>not lost") == "not lost"
    assert render("let <math><semantics><mrow><mi>x</mi><mo>=</mo><mn>1</mn></mrow><annotation>x=1</annotation></semantics></math>, <annotation>n</annotation>") == "let x=1, n"


def test_quotes_delimit_only_after_equals():
    assert render("<p class=it's>Hello don't go</p>") == "Hello don't go"
    assert render("<p it's>don't</p><p title = 'a>b'>c</p><a href=x?q=\"y>d</a>e\"") == "don't\n\nc\n\nde\""
    assert render("<p title=\"a>b<p>c") == "<p title=\"a>b\n\nc"


# the tags of a page as one expression: what Tags finds, but in quadratic time
PLAIN = re.compile(r"<!--.*?(?:-->|--!>|\Z)|<[!?][^>]*(?:>|\Z)|</?[A-Za-z](?:[^>=]|=[ \t\n\r\f]*+(?:\"[^\"]*+\"|'[^']*+'|(?![\"'])[^ \t\n\r\f>]*+))*+>", re.DOTALL)
PARTS = st.sampled_from(["<", ">", "=", '"', "'", " ", "a", "<a", "</b", "<!--", "-->", "--!>", "<!", "<?", "/", 'x="y"', "x='", "=\n'", "é", "=="])


@settings(max_examples=2000, deadline=None)
@given(st.lists(PARTS, max_size=24).map("".join))
def test_tags_match_plain_expression(page):
    tags, at, got = Tags(page), 0, []
    while found := tags.next(at):
        got.append(found)
        at = found[1]
    assert got == [m.span() for m in PLAIN.finditer(page)]


def test_broken_pages_take_linear_time():
    n = 300_000
    start = time.monotonic()
    for piece in ("<a ", '<a x="', "<a x='y=\"", "</script ", "<!-- ", "<a =", "<", "</", "<p", "<td colspan=1000>", "<li>", "<table>", "&lt;", "<b =x <i"):
        for head, tail in (("", ""), ("<script>", ""), ("", ">"), ("", "'>")):
            render(head + piece * (n // len(piece)) + tail)
    assert time.monotonic() - start < 120
    assert render("<a " * 10**6) == ("<a " * 10**6).rstrip()
