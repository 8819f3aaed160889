"""Government bills: HTML exports of PDF pages to one record a topic of a policy section.

HTML becomes (title, text of lines) in Arrow batches that are bounded by bytes, as a
page may be large; everything after that is column expressions: header fields by
patterns, sections as an array of places and titles, bodies cut out of the text,
topics by sections.topic_records' rule.
"""

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import constants as K
from ..operators import sections as X
from ..operators.sections import fold_text  # goes to the workers, as the module's UDFs can't
from ..tables import byte_batches, written
from .elements import page_text
from .motions import html_files

# Names and patterns of the documents.
GOVERNMENT = "M;KD;L"
PREVIOUS_PM = "Magdalena Andersson"
BILL = r"Regeringens proposition (\d{4}/\d{2}):(\d+)"
DATE = r"(?U)Stockholm den (\d{1,2} \w+ \d{4})"
SUMMARY_TITLE, CONTENTS_TITLE = "Propositionens huvudsakliga innehåll", "Innehållsförteckning"
POLICY_HEADING = r"\n(\d\.\d)\n([A-ZÅÄÖ][^\n.]{3,90})\n"
POLICY_TITLE = r"^(Reformer|Politiska utgångspunkter)"
AREA_FILE = r"031d\d+\.html$"
AREA_BILL = r"Prop\. (\d{4}/\d{2}):1\b"
AREA = r"Utgiftsområde (\d{1,2})\s+(?:–\s+)?([A-ZÅÄÖ][^\n]{3,80})"
AREA_HEADING = r"\n(\d+(?:\.\d+){1,3})\n([A-ZÅÄÖ][^\n.]{3,110})\n"
AREA_TITLE = r"^(Politikens inriktning|Förslag om )"
PROPOSAL_BOX = (
    r"(?s)\nRegeringens (?:förslag|bedömning)(?: och bedömning)?:?\n(.*?)"
    r"(?=\n(?:Promemorians|Utredningens|Betänkandets|Delbetänkandets|Remissinstanserna|Skälen för|Lagrådet|Regeringens (?:förslag|bedömning))|\Z)"
)
#: Characters at the start in which a bill names itself, and an area volume its area.
HEAD, AREA_HEAD = 5000, 400
#: Characters after which a batch of texts goes to Spark.
CHARS = 1 << 21
_BILL = re.compile(BILL, re.ASCII)


def summary_of(text: str) -> str | None:
    """What stands between the titles of the summary and of the contents."""
    start, end = f"\n{SUMMARY_TITLE}\n", f"\n{CONTENTS_TITLE}\n"
    at = text.find(start)
    to = text.find(end, at + len(start))
    return text[at + len(start) : to] if at >= 0 and to >= 0 else None


def enough(text: str) -> bool:
    """Whether a text that may be cut names a bill that is no budget, and has its whole summary."""
    number = _BILL.search(text[:HEAD])
    return number is not None and number[2] not in ("1", "100") and summary_of(text) is not None


def _texts(limit: int):
    """For mapInArrow over (file, cut, html): see texts."""

    def run(batches):
        for batch in batches:
            rows, size = [], 0
            for file, cut, html in zip(*batch.columns):
                head = page_text(html.as_py()[:limit]) if cut.as_py() and html.is_valid else None
                own = head if head and enough(head[1]) else page_text(html.as_py())
                rows.append((file.as_py(), *own, own is not head, fold_text(summary_of(own[1]))))
                size += len(own[1])
                if size >= CHARS:
                    yield out(rows)
                    rows, size = [], 0
            if rows:
                yield out(rows)

    def out(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.string(), pa.string(), pa.string(), pa.bool_(), pa.list_(pa.string()))
        return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows), kinds)], ["file", "title", "text", "whole", "summary"])

    return run


def texts(files: DataFrame, limit: int = K.HEAD_CHARS) -> DataFrame:
    """(file, title, text, whole, summary) of (file, html), where a file meets no other rows; the summary, if there is one, as paragraphs with their hyphens.

    `limit` characters are parsed of each file that is no volume of an area.
    What they lack is parsed whole: volumes, budgets, bills whose number or
    summary is not in the first part.
    """
    byte_batches(files.sparkSession)
    return files.select("file", (~F.col("file").rlike(AREA_FILE)).alias("cut"), "html").mapInArrow(_texts(limit), "file string, title string, text string, whole boolean, summary array<string>")


def headings(text: Column, pattern: str) -> Column:
    """[{number, title, start, after, level}] of the section headings of a text, in code points."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found))
    both = F.arrays_zip(gaps.alias("gap"), found.alias("hit"))
    kind = "array<struct<number:string,title:string,start:int,after:int,level:int>>"

    def step(done, x):
        at = F.when(F.size(done) > 0, F.element_at(done, -1)["after"]).otherwise(0) + F.length(x["gap"])
        number = F.regexp_extract(x["hit"], pattern, 1)
        own = F.struct(number.alias("number"), F.trim(F.regexp_extract(x["hit"], pattern, 2)).alias("title"), at.alias("start"), (at + F.length(x["hit"])).alias("after"), F.regexp_count(number, F.lit(r"\.")).alias("level"))
        return F.concat(done, F.array(own).cast(kind))

    return F.when(F.size(found) > 0, F.aggregate(both, F.array().cast(kind), step)).otherwise(F.array().cast(kind))


def _end(heads: Column, i: Column, head: Column, text: Column, same_level: bool) -> Column:
    """Where a section ends: at the next heading, or at the next of its own or a higher level."""
    later = F.slice(heads, i + 2, F.size(heads))
    if same_level:
        later = F.filter(later, lambda n: n["level"] <= head["level"])
    return F.coalesce(F.get(later, 0)["start"], F.length(text))


def policy_sections(docs: DataFrame) -> DataFrame:
    """(file, nth, section, body) of whole texts (file, text, budget): the sections that carry policy, each number once."""
    own = docs.select("file", "text", "budget", headings(F.col("text"), POLICY_HEADING).alias("heads"))
    own = own.select("*", F.posexplode("heads").alias("i", "h"))
    keep = F.col("h.title").rlike(POLICY_TITLE) | (F.col("budget") & (F.col("h.number") == "1.1"))
    own = X.first_per_key(own.where(keep), ["file", "h.number"], "i")  # after the test of the title: appendices count again
    end = _end(F.col("heads"), F.col("i"), F.col("h"), F.col("text"), False)
    return own.select("file", F.col("i").alias("nth"), F.col("h.title").alias("section"), F.substring("text", F.col("h.after") + 1, end - F.col("h.after")).alias("body"))


def area_sections(docs: DataFrame) -> DataFrame:
    """(file, nth, section, body) of volumes (file, text): a section has its sub-sections; of chapters of proposals only the boxes stay."""
    own = docs.select("file", "text", headings(F.col("text"), AREA_HEADING).alias("heads"))
    own = own.select("*", F.posexplode("heads").alias("i", "h")).where(F.col("h.title").rlike(AREA_TITLE))
    end = _end(F.col("heads"), F.col("i"), F.col("h"), F.col("text"), True)
    body = F.substring("text", F.col("h.after") + 1, end - F.col("h.after"))
    boxes = F.array_join(F.regexp_extract_all(body, F.lit(PROPOSAL_BOX), F.lit(1)), "\n")
    return own.select("file", F.col("i").alias("nth"), F.col("h.title").alias("section"), F.when(F.col("h.title").startswith("Förslag om"), boxes).otherwise(body).alias("body"))


def documents(read: DataFrame) -> DataFrame:
    """Header fields of read files (see texts): kind is bill, budget or area; files that name no bill, tests and those of the previous government go."""
    head, area_head = F.left("text", F.lit(HEAD)), F.left("text", F.lit(AREA_HEAD))
    found = lambda t, p, n=1: F.nullif(F.regexp_extract(t, p, n), F.lit(""))
    volume = F.col("file").rlike(AREA_FILE)
    rm = F.when(volume, found(head, AREA_BILL)).otherwise(found(head, BILL))
    number = F.when(volume, F.lit("1")).otherwise(found(head, BILL, 2))
    area, name = found(area_head, AREA), F.trim(F.regexp_extract(area_head, AREA, 2))
    year = (F.left("rm", F.lit(4)).cast("int") + 1).cast("string")
    own = read.select("file", "title", "text", "summary", rm.alias("rm"), number.alias("beteckning"), F.when(volume, area).alias("area"), F.when(volume, name).alias("area_name"), volume.alias("volume"))
    own = own.where(F.col("rm").isNotNull() & (~F.col("volume") | F.col("area").isNotNull()) & ~F.col("title").startswith("TEST"))
    own = own.where(F.col("volume") | ~F.left("text", F.lit(HEAD)).contains(PREVIOUS_PM))
    return own.select(
        "file", "text", "summary", "rm", "beteckning", "area",
        F.when(F.col("volume"), "area").when(F.col("beteckning").isin("1", "100"), "budget").otherwise("bill").alias("kind"),
        F.when(F.col("volume"), F.concat(F.lit("Budgetpropositionen för "), year, F.lit(", utgiftsområde "), "area", F.lit(" "), "area_name")).otherwise(F.col("title")).alias("doc_title"),
        F.lit(GOVERNMENT).alias("parti"), F.regexp_extract("text", DATE, 1).alias("datum"),
        F.concat_ws(":", "rm", "beteckning", F.when(F.col("volume"), F.concat(F.lit("uo"), "area"))).alias("key"),
    )


def records(read: DataFrame, least: int = K.MIN_CHARS) -> DataFrame:
    """One row a topic of read files (see texts); of files with the same key and any record, the first by name counts."""
    byte_batches(read.sparkSession)
    own = documents(read)
    own = own.withColumn("summary", F.when(F.col("kind") == "bill", F.array_join(X.unhyphened(F.col("summary")), "\n\n")))
    # written: bills, sections and fields are read off the same texts, which are parsed and searched once; of a bill only its summary is
    docs = written(own.withColumn("text", F.when(F.col("kind") != "bill", F.col("text"))), "bills")
    fields = ["file", "rm", "beteckning", "area", "doc_title", "parti", "datum", "key"]
    bills = docs.where("summary IS NOT NULL").select(*fields, F.lit(0).alias("nth"), F.lit(0).alias("group"), F.lit(SUMMARY_TITLE).alias("heading"), F.col("summary").alias("text"))
    policy = policy_sections(docs.where("kind = 'budget'").select("file", "text", (F.col("beteckning") == "1").alias("budget")))
    area = area_sections(docs.where("kind = 'area'").select("file", "text"))
    named = F.when((F.col("of") == "area") & (F.col("heading") != F.col("section")), F.concat("section", F.lit(" – "), "heading")).otherwise(F.col("heading"))
    both = policy.withColumn("of", F.lit("budget")).unionByName(area.withColumn("of", F.lit("area")))
    topics = X.grouped_topics(both, ["file", "nth", "of"], least).select("file", "nth", "group", named.alias("heading"), "text")
    # texts of whole files stay behind: the few budgets' fields and records are joined by file
    out = bills.unionByName(docs.where("kind <> 'bill'").select(*fields).join(topics, "file"))
    # rows of a key's first file come first, so one order finds and numbers them
    ordered = Window.partitionBy("key").orderBy("file", "nth", "group")
    out = out.select("*", F.first("file").over(ordered).alias("first"), (F.row_number().over(ordered) - 1).alias("at")).where(F.col("file") == F.col("first"))
    prefix = F.concat(F.lit("prop:"), "rm", F.lit(":"), "beteckning", F.lit(":"), F.when(F.col("area").isNotNull(), F.concat(F.lit("uo"), "area", F.lit(":"))).otherwise(""))
    name = F.element_at(F.split("file", "/"), -1)
    return out.select("rm", "beteckning", "doc_title", "parti", "datum", name.alias("file"), "heading", "text", F.concat(prefix, F.col("at").cast("string")).alias("chunk_id"))


def build(spark: SparkSession, folder: str, path: str) -> DataFrame:
    """Writes the proposition layer of a folder of HTML files as JSON lines; returns (file, records)."""
    records(texts(html_files(spark, folder))).write.mode("overwrite").json(path)
    return spark.read.schema("file string").json(path).groupBy("file").agg(F.count("*").alias("records"))
