"""HTML as a relation: one row an element or string, parsed in Arrow batches.

Elements are numbered as they open and close (`start`, `end`), so an element
contains another whose interval lies in its own; strings are rows of the tag
`#text`. What a page says is then told by joins and windows over these rows.

Elements that are never closed end with the one around them, so a malformed
page still gives rows. Strings of scripts, styles and comments are no rows. A page that cannot be read
is one row of the tag `#error`.
"""

import re
from bisect import bisect
from collections import Counter
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..operators.sections import SPACE

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
MUTE = frozenset(("script", "style", "template"))
BLOCK = frozenset("address article aside blockquote body br caption dd div dl dt fieldset figcaption footer form h1 h2 h3 h4 h5 h6 head header hr li main nav noscript ol p pre section table tbody td tfoot th thead title tr ul".split())
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
#: Tags that are read without a search for attributes; none of them changes how what follows is read.
PLAIN, PLAIN_END = re.compile("<(p|b|i|li|td|tr|div|span)>"), re.compile("</(p|b|i|li|td|tr|div|span)>")
#: Rows after which a batch goes to Spark.
ROWS = 20_000
#: block counts the edges of block elements before the row: strings of one number stand in one block.
ELEMENT = "start int, end int, depth int, tag string, classes array<string>, href string, text string, block int"
#: A page in one row: its strings in order, and elements in order, each with its first string (from 1) and how many follow from there; inside: another kind of element contains it.
OUTLINE = "strings array<string>, elements array<struct<start:int,end:int,tag:string,classes:array<string>,inside:boolean,first:int,n:int>>"


class _Rows(HTMLParser):
    """Rows of one page, in the order in which they end."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open, self.at, self.block, self.muted, self.done = [], 0, 0, 0, []

    def handle_starttag(self, tag, attrs):
        own = dict(attrs)
        self.block += tag in BLOCK
        self.open.append((self.at, tag, (own.get("class") or "").split(), own.get("href"), self.block))
        self.muted += tag in MUTE
        self.at += 1
        if tag in VOID:
            self._close()

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self._close()

    def handle_endtag(self, tag):
        if any(e[1] == tag for e in reversed(self.open)):
            while self._close() != tag:
                pass

    def handle_data(self, data):
        if not self.muted:
            self.done.append((self.at, self.at + 1, len(self.open), "#text", [], None, data, self.block))
            self.at += 2

    def _close(self):
        start, tag, classes, href, block = self.open.pop()
        self.muted -= tag in MUTE
        self.block += tag in BLOCK
        self.done.append((start, self.at, len(self.open), tag, classes, href, None, block))
        self.at += 1
        return tag


def _page_rows(html: str | None) -> list[tuple]:
    page = _Rows()
    try:
        page.feed(html or "")
        page.close()
    except Exception as error:  # noqa: BLE001 - one bad page is a row with an error
        return [(0, 1, 0, "#error", [], None, repr(error)[:300], 0)]
    while page.open:
        page._close()
    return page.done


class _Strings(HTMLParser):
    """A page's strings in order, and the places of those in a title: strings of _Rows, without its rows."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open, self.held, self.muted, self.done, self.titles = [], Counter(), 0, [], []

    def updatepos(self, i, j):
        return j  # lines are not counted

    def parse_starttag(self, i):
        plain = PLAIN.match(self.rawdata, i)
        if plain is None:
            return super().parse_starttag(i)
        self.handle_starttag(plain[1], ())
        return plain.end()

    def parse_endtag(self, i):
        plain = PLAIN_END.match(self.rawdata, i)
        if plain is None or self.cdata_elem is not None:
            return super().parse_endtag(i)
        self.handle_endtag(plain[1])
        return plain.end()

    def handle_starttag(self, tag, attrs):
        if tag not in VOID:
            self.open.append(tag)
            self.held[tag] += 1
            self.muted += tag in MUTE

    def handle_startendtag(self, tag, attrs):
        pass

    def handle_endtag(self, tag):
        if self.held[tag]:
            last = None
            while last != tag:
                last = self.open.pop()
                self.held[last] -= 1
                self.muted -= last in MUTE

    def handle_data(self, data):
        if not self.muted:
            if self.held["title"]:
                self.titles.append(len(self.done))
            self.done.append(data)


def page_strings(html: str | None) -> tuple[list[str], list[int]]:
    """A page's strings in order, and the places of those in a title; a page that cannot be read has none."""
    page = _Strings()
    try:
        page.feed(html or "")
        page.close()
    except Exception:  # noqa: BLE001 - as in _page_rows
        return [], []
    return page.done, page.titles


def page_text(html: str | None) -> tuple[str, str]:
    """(title, text) of a page: a line for each string, without white space at its ends."""
    strings, titles = page_strings(html)
    own = [string.strip(SPACE) for string in strings]
    return " ".join(own[i] for i in titles if own[i]), "\n" + "\n".join(filter(None, own)) + "\n"


def page_outline(html: str | None, wanted, outer) -> tuple[list[str], list[tuple]]:
    """A page's strings, and the elements that are `wanted` by tag and classes as in OUTLINE; `outer` tells the tags that others are inside of.

    An element's strings lie together, so they are told by two numbers however deep elements nest.
    """
    rows = sorted(_page_rows(html), key=lambda row: row[0])
    texts = [row for row in rows if row[3] in ("#text", "#error")]
    places = [row[0] for row in texts]
    found, reach = [], -1
    for start, end, _, tag, classes, *_ in rows:
        if tag == "#error" or tag != "#text" and wanted(tag, classes):
            first = bisect(places, start - (tag == "#error"))
            found.append((start, end, tag, classes, reach > start, first + 1, bisect(places, end) - first))
        if tag in outer:
            reach = max(reach, end)
    return [row[6] for row in texts], found


def _outlines(wanted, outer, strings: pa.DataType, kinds: pa.DataType):
    """For mapInArrow over (columns to keep, HTML): the kept columns and OUTLINE's, some pages at a time."""

    def out(batch: pa.RecordBatch, at: int, pages: list[tuple]) -> pa.RecordBatch:
        kept = [batch.column(i).slice(at, len(pages)) for i in range(batch.num_columns - 1)]
        texts, own, ends, stops = [], [], [0], [0]
        for strings_, found in pages:
            texts += strings_
            own += found
            ends.append(len(texts))
            stops.append(len(own))
        columns = zip(*own) if own else [()] * kinds.value_type.num_fields
        rows = pa.StructArray.from_arrays([pa.array(column, field.type) for column, field in zip(columns, kinds.value_type)], fields=list(kinds.value_type))
        both = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(texts, strings.value_type)), pa.ListArray.from_arrays(pa.array(stops, pa.int32()), rows)]
        return pa.RecordBatch.from_arrays(kept + both, [*batch.schema.names[:-1], "strings", "elements"])

    def run(batches):
        for batch in batches:
            at, size, pages = 0, 0, []
            for html in batch.column(batch.num_columns - 1):
                pages.append(page_outline(html.as_py(), wanted, outer))
                size += len(pages[-1][0]) + len(pages[-1][1])
                if size >= ROWS:
                    yield out(batch, at, pages)
                    at, size, pages = at + len(pages), 0, []
            if pages:
                yield out(batch, at, pages)

    return run


def outlines(pages: DataFrame, wanted, outer: tuple[str, ...] = (), html: str = "html") -> DataFrame:
    """The columns of pages but the HTML, and OUTLINE's of each: what meets no other page is read row by row, so nothing is shuffled.

    `wanted(tag, classes)` says which elements are listed; `outer` names the tags for `inside`. A page that cannot be read has the element `#error`.
    """
    own = pages.select(*[c for c in pages.columns if c != html], html)
    kinds = StructType.fromDDL(OUTLINE)
    return own.mapInArrow(_outlines(wanted, frozenset(outer), *[f.type for f in to_arrow_schema(kinds)]), StructType(own.schema.fields[:-1] + kinds.fields))


def _elements(kinds: list[pa.Field]):
    """For mapInArrow over (columns to keep, HTML): the kept columns and ELEMENT's, some pages at a time."""

    def out(batch: pa.RecordBatch, at: list[int], rows: list[tuple]) -> pa.RecordBatch:
        kept = [batch.column(i).take(pa.array(at, pa.int32())) for i in range(batch.num_columns - 1)]
        own = [pa.array(column, field.type) for column, field in zip(zip(*rows), kinds)]
        return pa.RecordBatch.from_arrays(kept + own, [*batch.schema.names[:-1], *[field.name for field in kinds]])

    def run(batches):
        for batch in batches:
            at, rows = [], []
            for n, html in enumerate(batch.column(batch.num_columns - 1)):
                found = _page_rows(html.as_py())
                at += [n] * len(found)
                rows += found
                if len(rows) >= ROWS:
                    yield out(batch, at, rows)
                    at, rows = [], []
            if rows:
                yield out(batch, at, rows)

    return run


def elements(pages: DataFrame, html: str = "html") -> DataFrame:
    """The columns of pages but the HTML, and its elements; a page without any has no rows. Rows go to Spark in Arrow batches."""
    own = pages.select(*[c for c in pages.columns if c != html], html)
    kinds = StructType.fromDDL(ELEMENT)
    return own.mapInArrow(_elements(list(to_arrow_schema(kinds))), StructType(own.schema.fields[:-1] + kinds.fields))


def inside(rows: DataFrame, keys: list[str], outer: Column, name: str) -> DataFrame:
    """rows with whether an element that is `outer` contains them: of those that opened before, one ends after."""
    before = Window.partitionBy(*keys).orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn(name, F.coalesce(F.max(F.when(outer, F.col("end"))).over(before) > F.col("start"), F.lit(False)))


def strings(rows: DataFrame, keys: list[str], wanted: Column) -> DataFrame:
    """The elements that are `wanted`, with the strings in each in place of their text, in order.

    A string belongs to the wanted elements around it: they are carried on as
    the list of those that are open, which is as long as wanted ones are nested.
    """
    own = rows.where(wanted | (F.col("tag") == "#text")).withColumn("__w", wanted)
    before = Window.partitionBy(*keys).orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    # where the outermost wanted element around or before a row began: strings of one run meet its few elements only
    reach = F.max(F.when(F.col("__w"), F.col("end"))).over(before)
    own = own.withColumn("__top", F.coalesce(reach < F.col("start"), F.lit(True)) & F.col("__w"))
    upto = Window.partitionBy(*keys).orderBy("start").rowsBetween(Window.unboundedPreceding, 0)
    own = own.withColumn("__run", F.sum(F.col("__top").cast("int")).over(upto))
    whole = [c for c in rows.columns if c != "text"]
    marked = own.where("__w").select(*whole, "__run")
    texts = own.where("NOT __w").select(*[F.col(k).alias(f"__{k}") for k in keys], F.col("__run").alias("__of"), F.col("start").alias("__at"), F.col("text").alias("__text"))
    same = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys] + [F.col("__run") == F.col("__of"), F.col("__at") > F.col("start"), F.col("__at") < F.col("end")]
    met = marked.join(texts, same, "left").groupBy(*whole).agg(F.array_sort(F.collect_list(F.when(F.col("__at").isNotNull(), F.struct("__at", "__text")))).alias("__s"))
    return met.select(*whole, F.transform("__s", lambda s: s["__text"]).alias("strings"))


def stripped(strings: Column) -> Column:
    """Strings without white space at their ends, as one."""
    return F.array_join(F.transform(strings, lambda s: F.regexp_replace(s, r"(?U)^\s+|\s+$", "")), "")
