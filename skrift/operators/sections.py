"""Ordered text structure: paragraphs, headings, section ranges, PDF spans, carried values."""

import re
import unicodedata

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, types
from pyspark.sql import functions as F

from .. import constants as K

# Page furniture, hyphenation at line ends, headings of volumes.
NOISE = r"^(?:Prop\.|Prop\. \d{4}/\d{2}:\d+|\d{4}/\d{2}:\d+|[\d\s,.−\-–+%()]+|(?:Prop\. \d{4}/\d{2}:\d+\s*)?Utgiftsområde \d{1,2})$"
HYPHEN = r"(?U)(\w)- (?!och\b|eller\b|samt\b|till\b|som\b)([a-zåäö])"
#: White space as (?U)\s has it.
SPACE = "\t\n\x0b\f\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
_NOISE = re.compile(NOISE, re.ASCII)


def paragraphs(text: Column) -> Column:
    """Lines folded to paragraphs: a line joins an unfinished one that is long, or if it starts in lower case or follows a comma or dash."""
    return unhyphened(folded(text))


def unhyphened(paragraphs: Column) -> Column:
    """Paragraphs without hyphens of line ends, unless these stand for a shared ending."""
    return F.transform(paragraphs, lambda p: F.when(p.contains("- "), F.regexp_replace(p, HYPHEN, "$1$2")).otherwise(p))


def fold_lines(lines) -> list[str] | None:
    """Lines (stripped, none empty) folded to paragraphs, each line looked at once (a growing paragraph would be copied and searched for each)."""
    done: list[str] = []
    parts: list[str] = []
    for line in () if lines is None else lines:
        if parts and parts[-1][-1] not in ".!?:" and (size >= 90 or unicodedata.category(line[0]) == "Ll" or parts[-1][-1] in ",–-"):
            parts.append(line)
            size += 1 + len(line)
            continue
        if parts:
            done.append(" ".join(parts))
        parts, size = [line], len(line)
    return None if lines is None else done + [" ".join(parts)] * bool(parts)


def fold_text(text: str | None) -> list[str] | None:
    """A text's lines, without white space at their ends, page furniture and table cells, folded to paragraphs."""
    return None if text is None else fold_lines(x for line in text.split("\n") if (x := line.strip(SPACE)) and not _NOISE.match(x))


@F.arrow_udf(types.ArrayType(types.StringType()))
def folded(texts: pa.Array) -> pa.Array:
    return pa.array([fold_text(text.as_py()) for text in texts], pa.list_(pa.string()))


def is_heading(p: Column) -> Column:
    return (F.length(p) < 100) & ~p.rlike("[.!?:,]$")


def mostly_numbers(p: Column) -> Column:
    return F.length(F.regexp_replace(p, r"(?U)\D", "")) > 0.2 * F.length(p)


def topic_records(bodies: DataFrame, least: int = K.MIN_CHARS) -> DataFrame:
    """(doc, section, heading, text) of bodies (doc, section, body): text between headings, without number-heavy paragraphs."""
    return grouped_topics(bodies, ["doc"], least).select("doc", "section", "heading", "text")


def grouped_topics(bodies: DataFrame, keys: list[str], least: int = K.MIN_CHARS) -> DataFrame:
    """(keys, section, group, heading, text) of bodies (keys, section, body): a fold over one body's paragraphs, without a shuffle.

    A heading opens a group; the text before the first has the section's title
    for a heading. Groups of fewer than `least` characters go.
    """
    kind = "array<struct<heading:string,parts:array<string>>>"

    def step(done, p):
        last = F.element_at(done, -1)
        opened = F.concat(done, F.array(F.struct(p.alias("heading"), F.array().cast("array<string>").alias("parts"))))
        grown = F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(F.struct(last["heading"].alias("heading"), F.concat(last["parts"], F.array(p)).alias("parts"))))
        return F.when(is_heading(p), opened).when(mostly_numbers(p), done).otherwise(grown)

    start = F.array(F.struct(F.col("section").alias("heading"), F.array().cast("array<string>").alias("parts"))).cast(kind)
    groups = F.aggregate(paragraphs(F.col("body")), start, lambda done, p: step(done, p).cast(kind))
    own = bodies.select(*keys, "section", F.posexplode(groups).alias("group", "g"))
    own = own.select(*keys, "section", "group", F.col("g.heading").alias("heading"), F.array_join("g.parts", "\n\n").alias("text"))
    return own.where(F.length("text") >= least)


def section_ranges(headings: DataFrame) -> DataFrame:
    """(doc, pos, depth, next_any, next_level) of headings (doc, pos, depth): where a section ends.

    next_any is the next heading; next_level the next of the same or a higher
    level. A document's headings are folded backwards over a stack of those that
    may still end a section, whose depths fall from top to bottom: any number of
    levels, each heading pushed and popped once. A null depth ends nothing and
    has no next_level; the second of two headings at one place is the next one.
    """

    def ends(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("pos")
        pos, depth = rows["pos"].to_pylist(), rows["depth"].to_pylist()
        stack, level = [], [None] * len(pos)
        for i in reversed(range(len(pos))):
            if depth[i] is None:
                continue
            while stack and depth[stack[-1]] > depth[i]:
                stack.pop()
            level[i] = pos[stack[-1]] if stack else None
            stack.append(i)
        kind = rows.schema.field("pos").type
        return rows.select(["doc", "pos", "depth"]).append_column("next_any", pa.array(pos[1:] + [None] * bool(pos), kind)).append_column("next_level", pa.array(level, kind))

    kinds = dict(headings.dtypes)
    schema = f"doc {kinds['doc']}, pos {kinds['pos']}, depth {kinds['depth']}, next_any {kinds['pos']}, next_level {kinds['pos']}"
    return headings.select("doc", "pos", "depth").groupBy("doc").applyInArrow(ends, schema)


def first_per_key(rows: DataFrame, key: list[str], order: str) -> DataFrame:
    return rows.withColumn("__r", F.row_number().over(Window.partitionBy(*key).orderBy(order))).where("__r = 1").drop("__r")


def carried(rows: DataFrame, by: str, order: str, value: str, name: str) -> DataFrame:
    """The last non-null value at or before each row."""
    w = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(name, F.last(value, ignorenulls=True).over(w))


def body_style(spans: DataFrame) -> DataFrame:
    """(file, font, size): the style most characters have, white space at the ends apart; ties by font and size."""
    stripped = F.regexp_replace("text", r"(?U)^\s+|\s+$", "")
    per = spans.groupBy("file", "font", F.round("size", 1).alias("size")).agg(F.sum(F.length(stripped)).alias("chars"))
    best = F.max(F.struct("chars", "font", "size")).alias("b")
    return per.groupBy("file").agg(best).select("file", "b.font", "b.size")


def join_lines(lines) -> str | None:
    """Lines as one text, each added once to a list of parts (a growing text would be copied for each line); see joined_lines."""
    parts: list[str] = []
    for line in lines:
        if line is None:
            return None
        if parts and parts[-1].endswith("-") and unicodedata.category(line[:1] or " ") == "Ll" and not line.startswith(("och ", "eller ")):
            parts[-1:] = [parts[-1][:-1], line] if len(parts[-1]) > 1 else [line]
        elif parts:
            parts.append(" " + line)
            for end, cut in ((-1, str.rstrip), (0, str.lstrip)):  # blanks at both ends go, with what is nothing else
                while parts:
                    parts[end] = cut(parts[end], " ")
                    if parts[end]:
                        break
                    parts.pop(end)
        elif line:
            parts = [line]
    return "".join(parts)


@F.pandas_udf(types.StringType())
def joined_lines(lines: pd.Series) -> pd.Series:
    """Lines as one text; a hyphen at a line's end goes when the next one starts in lower case, unless it stands for a shared ending."""
    return lines.map(lambda x: None if x is None else join_lines(x))
