"""Page trees against the standard library's parser, links against the examples of RFC 3986."""

import re
from html.parser import HTMLParser
from urllib.parse import urljoin

import pytest
from pyspark.sql import functions as F

from millrace.functions.links import resolve
from millrace.operators import pages as P

SF = "/root/testdata/sf0.001"


class Tree(HTMLParser):
    """[tag, attrs, parent, text pieces inside] of every element, by the library's own tokens."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.found, self.open = [], []

    def handle_starttag(self, tag, attrs):
        kept = {}
        for k, v in attrs:
            kept.setdefault(k, v or "")
        self.found.append([tag, kept, self.open[-1] if self.open else None, []])
        if tag not in P.VOID:
            self.open.append(len(self.found) - 1)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in P.VOID:
            self.open.pop()

    def handle_endtag(self, tag):
        names = [self.found[i][0] for i in self.open]
        if tag in names:
            del self.open[len(names) - 1 - names[::-1].index(tag) :]

    def handle_data(self, data):
        if not self.open or self.found[self.open[-1]][0] not in P.RAW:
            for i in self.open:
                self.found[i][3].append(data)


def elements(rows):
    """The same of the operator's rows."""
    numbers = {r[0]: i for i, r in enumerate(r for r in rows if r[3] != "#text")}
    texts = [(r[0], r[5]) for r in rows if r[3] == "#text"]
    return [[r[3], r[4], numbers.get(r[2]), [t for at, t in texts if r[0] < at < r[1]]] for r in rows if r[3] != "#text"]


def said(pieces):
    return re.sub(r"\s+", "", "".join(pieces))


HARD = [
    "<div><div>a</div>b</div>c", "<p>a<p>b</div></p>", "<ul><li>1<li>2<ul><li>3</ul></ul>x", "<img src=a.png alt='1 > 0'><br/>t", "<b><i>x</b>y</i>z",
    "<script>if (a < b) '<p>';</script ><p>q</p>", "<style>p > a {}</style>", "<!-- <p>no</p> --><p>yes<!-- x -->", "<A HREF=x CLASS='b c' class=d>t</A>", "a &lt;b&gt; &amp;amp; &#65;&eacute;",
    "<div/><p>in</p>", "<td>1<td>2", "", "no markup", "<p title=\"a 'b' c\" hidden data-x='{\"k\": \"v\"}'>t</p>", "</p></div>tail",
]


@pytest.mark.parametrize("markup", HARD)
def test_hard_markup_as_the_library_reads_it(markup):
    other = Tree()
    other.feed(markup)
    other.close()
    mine, theirs = elements(P.parse(markup)), other.found
    assert [x[:3] for x in mine] == [x[:3] for x in theirs]
    assert [said(x[3]) for x in mine] == [said(x[3]) for x in theirs]


def test_all_pages_as_the_library_reads_them(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    rows = {}
    for r in P.tree(pages).orderBy("page_id", "node").collect():
        rows.setdefault(r["page_id"], []).append(tuple(r)[1:])
    for p in pages.collect():
        other = Tree()
        other.feed(p["html"])
        other.close()
        mine = elements(rows[p["page_id"]])
        assert [x[:3] for x in mine] == [x[:3] for x in other.found]
        assert [said(x[3]) for x in mine] == [said(x[3]) for x in other.found]


def test_texts_of_nested_cells_stay_in_proportion():
    rows = P.parse("<table>" + "<td>some text" * 2000)
    assert sum(len(r[5] or "") for r in rows) < 20 * 2000 * 10 and rows[1][5].count("some") == 2000


def page(spark, *markups):
    return spark.createDataFrame([(i, f"https://h.example/a/b.do?x={i}", m, 1) for i, m in enumerate(markups)], "page_id int, url string, html string, node int")


def texts(rows, nodes):
    return sorted((r["page_id"], r["content"]) for r in P.with_text(rows, nodes).collect())


def test_selectors(spark):
    rows = P.tree(page(spark, "<div id=one class='a b'><p>x<span class=a>y</span></p></div><p data-k='v-1'>z</p>", None)).cache()
    chosen = lambda s: [t for _, t in texts(rows, P.select(rows, s))]
    assert chosen("p") == ["x y", "z"] and chosen("#one.a.b") == ["x y"] and chosen("div .a") == ["y"] and chosen("div > .a") == []
    assert chosen("div > p > span.a") == ["y"] and chosen("[data-k]") == ["z"] and chosen("p[data-k*='-']") == ["z"] and chosen("p[data-k^='-']") == [] and chosen("*[class~='b']") == ["x y"]
    with pytest.raises(ValueError):
        P.select(rows, "p:first-child")


def test_main_content_takes_the_longest_node_of_the_first_usable_selector(spark):
    rows = P.tree(page(spark, "<main> ab </main><div class=cont>short</div><div class=cont>much longer</div><body>all</body>", "<div>nothing</div>", "<main>in main</main><div class=cont>a much longer text</div>"))
    got = {r["page_id"]: (r["selector"], r["content"]) for r in P.main_content(rows, ("main", ".cont", "div")).collect()}
    assert got == {0: (".cont", "much longer"), 1: ("div", "nothing"), 2: ("main", "in main")}


def test_board_rows(spark):
    line = lambda n, params, day, **a: f"<ul><li>{n}</li><li><a class='open' title=\"T&amp;{n}\" data-params='{params}' href='#'>text {n}</a></li><li>Office</li><li>{day}</li></ul>"
    board = "<div class=board><div class=lines>" + line("Notice", '{"seq": "a1", "menu": 7}', "24.03.09") + line("12", '{"seq": "b2"}', " 24.03.10 ") + line("11", '{"seq": "c3", "secret": true}', "24.03.11") + line("10", "no json", "someday") + "<ul><li>1</li></ul></div></div>"
    got = P.board_rows(P.tree(page(spark, board)), ".board .lines > ul", "li", "a.open[data-params]", {"number": 0, "department": -2, "published": -1}, 4, {"board_id": "seq", "menu_id": "menu"}, "secret").orderBy("turn").collect()
    assert [(r["turn"], r["title"], r["department"], str(r["published"]), r["pinned"], r["board_id"], r["menu_id"]) for r in got] == [(0, "T&Notice", "Office", "2024-03-09", True, "a1", "7"), (1, "T&12", "Office", "2024-03-10", False, "b2", None)]


def test_zipped_drops_pages_whose_counts_differ(spark):
    rows = P.tree(page(spark, "<dl><dt>q1</dt><dd>a <b>1</b></dd><dt>q2</dt><dd></dd></dl>", "<dt>q</dt>", "<dt>q</dt><dt>r</dt><dd>a</dd>"))
    assert [tuple(r) for r in P.zipped(rows, "dt", "dd").collect()] == [(0, 0, "q1", "a 1")]


def test_references_have_kinds_and_names(spark):
    table = "<table><tr><th>Form <i>A</i></th><td><a href='/download.do?id=1'>PDF</a></td></tr><tr><td>x</td><td>y</td><td><a href='../download.do?id=2'>Rules</a> <a href='download.do?id=3'> </a></td></tr></table>"
    markup = f"{table}<a href='/download.do?id=1'>again</a><a href='download.do?id=4'>Download</a><img src='i.png' alt='A map'><img src='//cdn.example/j.png'><a href='c?d=1#e'>See</a><a href='mailto:a@b.c'>Mail</a>"
    got = {r["link"]: (r["kind"], r["name"]) for r in P.page_references(P.tree(page(spark, markup)), page(spark, markup)).collect()}
    assert got == {
        "https://h.example/download.do?id=1": ("attachment", "Form A"), "https://h.example/download.do?id=2": ("attachment", "Rules"), "https://h.example/a/download.do?id=3": ("attachment", "y"),
        "https://h.example/a/download.do?id=4": ("attachment", "attachment 4"), "https://h.example/a/i.png": ("image", "A map"), "https://cdn.example/j.png": ("image", "image 2"),
        "https://h.example/a/c?d=1#e": ("link", "See"), "mailto:a@b.c": ("link", "Mail"),
    }


# The examples of RFC 3986, 5.4, against http://a/b/c/d;p?q
EXAMPLES = """g:h g:h|g http://a/b/c/g|./g http://a/b/c/g|g/ http://a/b/c/g/|/g http://a/g|//g http://g|?y http://a/b/c/d;p?y|g?y http://a/b/c/g?y|#s http://a/b/c/d;p?q#s|g#s http://a/b/c/g#s
g?y#s http://a/b/c/g?y#s|;x http://a/b/c/;x|g;x http://a/b/c/g;x|g;x?y#s http://a/b/c/g;x?y#s|. http://a/b/c/|./ http://a/b/c/|.. http://a/b/|../ http://a/b/|../g http://a/b/g|../.. http://a/|../../ http://a/|../../g http://a/g
../../../g http://a/g|../../../../g http://a/g|/./g http://a/g|/../g http://a/g|g. http://a/b/c/g.|.g http://a/b/c/.g|g.. http://a/b/c/g..|..g http://a/b/c/..g|./../g http://a/b/g|./g/. http://a/b/c/g/|g/./h http://a/b/c/g/h|g/../h http://a/b/c/h
g;x=1/./y http://a/b/c/g;x=1/y|g;x=1/../y http://a/b/c/y|g?y/./x http://a/b/c/g?y/./x|g?y/../x http://a/b/c/g?y/../x|g#s/./x http://a/b/c/g#s/./x|g#s/../x http://a/b/c/g#s/../x|http:g http:g"""


def test_resolution_by_the_standard(spark):
    cases = [tuple(x.split(" ")) for x in EXAMPLES.replace("\n", "|").split("|")] + [("", "http://a/b/c/d;p?q")]
    df = spark.createDataFrame(cases, "r string, want string").withColumn("got", resolve(F.lit("http://a/b/c/d;p?q"), F.col("r")))
    assert [(r["r"], r["got"]) for r in df.collect()] == cases


def test_resolution_as_urljoin(spark):
    bases = ["https://h.example", "https://h.example/", "https://h.example/a/b/c.do?x=1#y", "http://h.example:81/a/b/"]
    refs = ["x", "/x", "../x", "../../../x", "?p=2", "//o.example/z", "mailto:a@b.c", "a/./b/../c", "x?u=/../v", "/a/b/.."]
    df = spark.createDataFrame([(b, r) for b in bases for r in refs], "b string, r string").withColumn("got", resolve(F.col("b"), F.col("r")))
    assert [r["got"] for r in df.collect()] == [urljoin(b, r) for b in bases for r in refs]
