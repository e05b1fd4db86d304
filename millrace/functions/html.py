"""Text and links of web pages, by a tokenizer and a stack of open elements.

A page needn't be well formed: end tags that nothing has opened are passed over, an end tag closes what was left open inside its element,
paragraphs, list items and cells end where the next one begins, and whatever is open at the end is closed. The contents of scripts and styles aren't markup:
`</p>` in a script is no tag. A comment, tag or script that never ends goes to the end of the page.

Text is what elements outside SKIPPED hold, a line for each block, blanks run together, character references resolved. Links are the `a`
elements with an `href` wherever they are, with their text; `target` is the address that the page's own makes of it.

Defined results: a null page has null title, text and links; an empty one an empty text, no title and no links. A broken address has a null target.
Pages are parsed one by one inside tasks, in Arrow batches.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.registry import query
from millrace.sources.tables import table

#: Fixed values of the language: elements without an end, elements whose contents are no markup, elements that start a line.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCKS = frozenset(
    "address article aside blockquote body br center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search section summary table "
    "tbody td tfoot th thead title tr ul".split()
)
#: What an element's start ends, if that is open within the elements behind the colon.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"table", "tr"}), "th": ({"td", "th"}, {"table", "tr"}),
    "tbody": ({"tr", "td", "th", "thead", "tbody", "tfoot"}, {"table"}), "tfoot": ({"tr", "td", "th", "thead", "tbody", "tfoot"}, {"table"}),
}

#: Elements whose text isn't the page's.
SKIPPED = frozenset("head script style template noscript nav footer textarea title iframe noembed noframes xmp svg".split())

_NAME = re.compile(r"[A-Za-z][^\s/>]*")
_ATTRIBUTE = re.compile(r"""[\s/]*([^\s/>=][^\s/>=]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"'][^\s>]*)?))?""")
_BLANKS = re.compile(r"[ \t\n\f\r ]+")


@dataclass
class Tag:
    name: str
    attributes: dict[str, str]


def _tag(page: str, at: int) -> tuple[Tag, int]:
    """The tag whose name begins at a place, and where it ends; the page's end if it has none."""
    m = _NAME.match(page, at)
    name, at, found = m[0].lower(), m.end(), {}
    while at < len(page) and page[at] != ">":
        m = _ATTRIBUTE.match(page, at)
        if not m:
            at += 1
            continue
        found.setdefault(m[1].lower(), html.unescape(next((x for x in m.groups()[1:] if x is not None), "")))
        at = m.end()
    return Tag(name, found), at + 1


def tokens(page: str) -> Iterator[tuple[str, str | Tag]]:
    """("text", string), ("start", Tag) and ("end", Tag) in order. Comments and declarations give nothing; a tag that the page ends in gives nothing either."""
    at = 0
    while at < len(page):
        mark = page.find("<", at)
        if mark < 0 or mark + 1 >= len(page):
            yield "text", html.unescape(page[at:])
            return
        if mark > at:
            yield "text", html.unescape(page[at:mark])
        after = page[mark + 1]
        closing = after == "/"
        if page.startswith("<!--", mark):
            end = page.find("-->", mark + 4)
            at = len(page) if end < 0 else end + 3
        elif after in "!?":
            end = page.find(">", mark)
            at = len(page) if end < 0 else end + 1
        elif _NAME.match(page, mark + 1 + closing):
            tag, at = _tag(page, mark + 1 + closing)
            if at > len(page):
                return
            yield "end" if closing else "start", tag
            if not closing and tag.name in RAW:
                end = re.compile(rf"</{tag.name}(?=[\s/>])", re.IGNORECASE).search(page, at)
                inside = page[at : end.start() if end else len(page)]
                if inside:
                    yield "text", html.unescape(inside) if tag.name in ("title", "textarea") else inside
                at = end.start() if end else len(page)
        else:
            yield "text", "<"
            at = mark + 1


@dataclass
class Link:
    href: str
    rel: str
    parts: list[str] = field(default_factory=list)


class Reader:
    """A page's title, text and links as tokens come."""

    def __init__(self) -> None:
        self.open: list[str] = []
        self.skipped = 0
        self.title: list[str] | None = None
        self.parts: list[str] = []
        self.links: list[Link] = []
        self.link: Link | None = None

    def start(self, tag: Tag) -> None:
        name = tag.name
        if name in BLOCKS and "p" in self.open and name not in ("br", "option"):
            self._close("p", {"table", "td", "th", "li", "div", "article", "section", "blockquote"})
        if name in ENDS:
            for inner in ENDS[name][0]:
                self._close(inner, ENDS[name][1])
        if name == "a":
            self._close("a", {"table", "td", "th"})
        if name in BLOCKS:
            self._put("\n")
        if name == "a" and "href" in tag.attributes:
            self.link = Link(tag.attributes["href"].strip(), tag.attributes.get("rel", ""))
            self.links.append(self.link)
        if name == "title" and self.title is None:
            self.title = []
        if name not in VOID:
            self.open.append(name)
            self.skipped += name in SKIPPED

    def _close(self, name: str, within: set[str] | frozenset[str] = frozenset()) -> None:
        """Close the last open element of a name, and what is open inside it, if no element of `within` lies between."""
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k] == name:
                for _ in range(len(self.open) - k):
                    gone = self.open.pop()
                    self.skipped -= gone in SKIPPED
                    if gone == "a":
                        self.link = None
                    if gone in BLOCKS:
                        self._put("\n")
                return
            if self.open[k] in within:
                return

    def end(self, tag: Tag) -> None:
        if tag.name == "br":
            self._put("\n")
        else:
            self._close(tag.name)

    def _put(self, text: str) -> None:
        if not self.skipped:
            self.parts.append(text)
        if self.link:
            self.link.parts.append(text)

    def text(self, text: str) -> None:
        if self.open and self.open[-1] == "title" and self.title is not None:
            self.title.append(text)
        # ends of lines in the source are blanks; only blocks start lines
        self._put(_BLANKS.sub(" ", text))

    def lines(self) -> str:
        lines = (_BLANKS.sub(" ", x).strip(" ") for x in "".join(self.parts).split("\n"))
        return "\n".join(x for x in lines if x)


def read(page: str) -> Reader:
    reader = Reader()
    for kind, value in tokens(page):
        getattr(reader, kind)(value)
    return reader


def _target(base: str | None, href: str) -> str | None:
    try:
        return urljoin(base or "", href)
    except ValueError:
        return None


_RESULT = "title string, text string, links array<struct<href: string, target: string, rel: string, label: string>>"


def page_contents(pages: DataFrame, key: str = "page_id", page: str = "html", url: str = "url") -> DataFrame:
    """key, url, title, text, links."""
    rows = pages.select(F.col(key), F.col(url).alias("url"), F.col(page).alias("html"))
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = StructType([*rows.schema.fields[:2], *StructType.fromDDL(_RESULT).fields])
    kinds = to_arrow_schema(StructType.fromDDL(_RESULT))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                found = [None if h is None else read(h) for h in part.column("html").to_pylist()]
                title = [None if r is None or r.title is None else _BLANKS.sub(" ", "".join(r.title)).strip(" ") for r in found]
                text = [None if r is None else r.lines() for r in found]
                links = [
                    None if r is None else [{"href": x.href, "target": _target(u, x.href), "rel": x.rel, "label": _BLANKS.sub(" ", "".join(x.parts)).strip(" ")} for x in r.links]
                    for r, u in zip(found, part.column("url").to_pylist(), strict=True)
                ]
                new = [pa.array(x, type=f.type) for x, f in zip((title, text, links), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *new], names=schema.names)

    return rows.mapInArrow(run, schema)


@query(r"""
WITH p AS (SELECT page_id, regexp_replace(html, '(?s)<!--.*?-->|<script>.*?</script>|<style>.*?</style>', '', 'g') AS html FROM pages),
a AS (SELECT page_id, regexp_extract_all(html, '<a href="([^"]*)"', 1) AS hrefs, regexp_extract_all(html, '(?s)<a href="[^"]*"[^>]*>(.*?)</a>', 1) AS labels FROM p)
SELECT page_id, CAST(i AS INTEGER) AS place, hrefs[i] AS href, labels[i] AS label FROM a, unnest(range(1, len(hrefs) + 1)) AS u(i)
""")
def fn_html_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page's links in order."""
    found = page_contents(table(spark, sf_dir, "pages")).select("page_id", F.posexplode("links").alias("place", "link"))
    return found.select("page_id", (F.col("place") + 1).alias("place"), "link.href", "link.label")


@query(r"""
WITH a AS (SELECT page_id, html, regexp_replace(regexp_replace(html, '[ \t\n\f\r]+', ' ', 'g'), '(?s)<!--.*?-->|<script>.*?</script>|<style>.*?</style>|<head>.*?</head>|<nav>.*?</nav>|<footer>.*?(</footer>|$)', '', 'g') AS t FROM pages),
b AS (SELECT page_id, html, regexp_replace(regexp_replace(t, '</?(p|br|h[1-6]|div|article|body|html|ul|li|table|tr|td|section)( [^>]*)?>', chr(10), 'g'), '<[^>]*>', '', 'g') AS t FROM a),
c AS (SELECT page_id, html, list_filter(list_transform(string_split(t, chr(10)), lambda x: trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(x, '&lt;?', '<', 'g'), '&gt;?', '>', 'g'), '&quot;?', '"', 'g'), '&amp;?', '&', 'g'), ' +', ' ', 'g'))), lambda x: x <> '') AS lines FROM b)
SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_extract(html, '<title>([^<]*)</title>', 1), '&lt;?', '<', 'g'), '&gt;?', '>', 'g'), '&quot;?', '"', 'g'), '&amp;?', '&', 'g')) AS title, CAST(len(lines) AS INTEGER) AS lines, md5(array_to_string(lines, chr(10))) AS text_md5 FROM c
""")
def fn_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page's title and text. References count with and without their semicolon, as in HTML; the SQL knows the four that given pages have in their text."""
    found = page_contents(table(spark, sf_dir, "pages"))
    return found.select("page_id", "title", F.when(F.col("text") == "", 0).otherwise(F.size(F.split("text", "\n"))).alias("lines"), F.md5("text").alias("text_md5"))
