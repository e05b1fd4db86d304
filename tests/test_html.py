"""Pages against the standard library's parser, broken markup by hand, hard rows."""

import random
from html.parser import HTMLParser

import pytest

from millrace.functions.html import RAW, SKIPPED, page_contents, read, tokens


class Plain(HTMLParser):
    """The same tokens by another parser."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.found = []

    def handle_starttag(self, tag, attrs):
        self.found.append(("start", tag, {k: v or "" for k, v in reversed(attrs)}))

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        self.found.append(("end", tag, {}))

    def handle_data(self, data):
        if self.found and self.found[-1][0] == "text":
            self.found[-1] = ("text", self.found[-1][1] + data, {})
        else:
            self.found.append(("text", data, {}))


def ours(page):
    out = []
    for kind, value in tokens(page):
        if kind == "text":
            if out and out[-1][0] == "text":
                out[-1] = ("text", out[-1][1] + value, {})
            else:
                out.append(("text", value, {}))
        else:
            out.append((kind, value.name, value.attributes if kind == "start" else {}))
    return out


def theirs(page):
    parser = Plain()
    parser.feed(page)
    parser.close()
    return parser.found


def test_given_pages_give_the_same_tokens(duck):
    for (page,) in duck.sql("SELECT html FROM pages").fetchall():
        assert ours(page) == theirs(page)


def test_made_pages_give_the_same_tokens():
    rng = random.Random(3)
    parts = ["<p>", "</p>", "<b>", "</b>", "<br/>", "<a href='x'>", '<a href="/y?a=1&amp;b=2" rel=nofollow>', "</a>", "<script>", "</script>", 'var t="</p>";', "<!-- x -->", "text ", "&amp;", "&copy;", "<li>", "</li>", "<ul>", "</ul>", "<DIV CLASS=ad>", "</DIV>", "é\n", "a > b ", "<img src=a alt>"]
    for _ in range(800):
        page = "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))
        if page.count("<script>") and "</script>" not in page[page.rindex("<script>") :]:
            continue  # what a script without an end holds is read differently by that parser's versions
        assert ours(page) == theirs(page), page


def plain_text(page):
    """Text outside skipped elements of a well-formed page, without lines."""
    depth, out = 0, []
    for kind, value, _ in theirs(page):
        if kind == "start" and value in SKIPPED:
            depth += 1
        elif kind == "end" and value in SKIPPED:
            depth -= 1
        elif kind == "text" and not depth:
            out.append(value)
        else:
            out.append(" ")
    return "".join("".join(out).split())


def test_text_of_given_pages(duck):
    for (page,) in duck.sql("SELECT html FROM pages").fetchall():
        assert "".join(read(page).lines().split()) == plain_text(page)


@pytest.mark.parametrize(
    ("page", "text", "links"),
    [
        ("<p>a<p>b<b>c</p>d</b>", "a\nbc\nd", []),
        ('<script>var t="</p>"; document.write("<a href=x>");</script>after', "after", []),
        ("<SCRIPT>x</SCRIPTS></script >y", "y", []),
        ("a<!-- <p> never ends", "a", []),
        ("a<p class='x", "a", []),
        ("</div></p>a</nav>b", "ab", []),
        ("<nav>menu <a href=/m>M</a>", "", [("/m", "M")]),
        ("<a href=1>one<a href='2'>two</a> x", "one two x".replace("one two", "onetwo"), [("1", "one"), ("2", "two")]),
        ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>", "a\nb\nc\nd", []),
        ("<table><tr><td>1<td>2<tr><td>3</table>", "1\n2\n3", []),
        ("1 < 2 &lt; 3 <3 &amp;amp; &nbsp; x", "1 < 2 < 3 <3 &amp; x", []),
        ("a\n  b\t<i>c</i> d<br>e<br/>f", "a b c d\ne\nf", []),
        ("<a>no address</a><a href>empty</a>", "no addressempty", [("", "empty")]),
        ("<", "<", []),
        ("", "", []),
        ("<title>t &amp; u</title><p>x", "x", []),
        ("<style>p{}", "", []),
    ],
)
def test_broken_markup(page, text, links):
    found = read(page)
    assert found.lines() == text
    assert [(x.href, "".join(x.parts)) for x in found.links] == links


def test_any_text_is_read():
    rng = random.Random(5)
    for _ in range(3000):
        read("".join(rng.choice("<>/!-='\"ab &;#p \n") for _ in range(rng.randint(0, 40))))
    assert read("<div>" * 20_000 + "x" + "</div>" * 20_000).lines() == "x"
    assert len(read("<a href=x>y</a>" * 20_000).links) == 20_000
    assert {"script", "style"} <= RAW


def test_rows(spark):
    rows = [(1, None, "http://h/a/"), (2, "", None), (3, "<title> A  b</title><a href='c?d#e'>l</a><a href='http://[x'>m</a>", "http://h/a/"), (None, "<p>x", "u")]
    found = {r["page_id"]: r for r in page_contents(spark.createDataFrame(rows, "page_id long, html string, url string")).collect()}
    assert (found[1]["title"], found[1]["text"], found[1]["links"]) == (None, None, None)
    assert (found[2]["title"], found[2]["text"], found[2]["links"]) == (None, "", [])
    assert found[3]["title"] == "A b" and [tuple(x) for x in found[3]["links"]] == [("c?d#e", "http://h/a/c?d#e", "", "l"), ("http://[x", None, "", "m")]
    assert found[None]["text"] == "x"
    assert page_contents(spark.createDataFrame([], "page_id long, html string, url string")).count() == 0


def test_references_without_a_semicolon_are_the_same_in_sql(spark, tmp_path):
    """Titles that are cut inside a reference, as larger tables have them: what is left of it counts if HTML knows it."""
    import duckdb
    from compare import rows

    from millrace.registry import QUERIES, SQL

    page = "<html><head><title>{0}</title></head><body><h1>{0}</h1><p>x {0}</p></body></html>"
    cut = ["a &amp", "a &amp;&amp", "a &am", "&lt", "&gt b", "&quot", "&amp;lt", "&amplt;", "&quo", "&lt;&gt;&amp;lt;"]
    made = spark.createDataFrame([(k, "http://h/", page.format(x)) for k, x in enumerate(cut)], "page_id long, url string, html string")
    made.coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    found = rows(QUERIES["fn_html_text"](spark, str(tmp_path)).toPandas())
    assert found == rows(con.sql(SQL["fn_html_text"]).df()) and len(found[1]) == len(cut)
