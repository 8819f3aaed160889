"""Party programmes: text spans of PDF pages to one record a heading.

Spans come from a Python data source ("pdf_spans", where a PDF library is
installed) or any table of its schema. Lines, their styles, the body's style,
pages of contents, paragraphs and sections are DataFrame steps: runs and
sections are numbered by running sums over a file's lines in order.
"""

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..operators import sections as X

SPANS = "file string, page int, block int, line int, span int, font string, size double, flags int, text string"

# The documents, with party, kind and year of adoption.
PROGRAMS = (
    ("socialdemokraterna_partiprogram.pdf", "S", "partiprogram", 2025),
    ("moderaterna_partiprogam.pdf", "M", "idéprogram", 2021),
    ("sverigedemokraternas_partiprogram.pdf", "SD", "principprogram", 2023),
    ("centerpartiet_partiprogram.pdf", "C", "idéprogram", 2013),
    ("vansterpartiet_partiprogram.pdf", "V", "partiprogram", 2024),
    ("kristdemokraterna_partiprogram.pdf", "KD", "principprogram", 2025),
    ("miljopartiet_partiprogram.pdf", "MP", "partiprogram", 2025),
    ("liberalerna_partiprogram.pdf", "L", "partiprogram", 2025),
    ("tidoavtalet-overenskommelse-for-sverige-slutlig.pdf", "M;KD;L;SD", "Tidöavtalet", 2022),
)
# Patterns of the documents' layout.
NUMBERED = r"^(KAPITEL\s+\d+\.?|\d{1,2}(\.\d+)*\.?)\s+[A-ZÅÄÖa-zåäö]"
CONTENTS = r"(?iu)^\s*(innehåll|innehållsförteckning)\s*$"
NOISE = r"(?iu)^(informationsklass:.*|\d{1,3})$"
LETTERS = "[A-Za-zÅÄÖåäöÉé]{2}"
INVISIBLE = "​­﻿"
SPLIT_M_FONT = "GillSansProforRiksdag"
PROJECT_FILE = "tidoavtalet-overenskommelse-for-sverige-slutlig.pdf"
PROJECT = r"Direktiv (?:sam ?arbetsprojekt|(andra) sam ?arbetsfrågor) *\n?(.*)"
OTHER_MATTERS = "Andra samarbetsfrågor"
FRAME = r"(?iu)^(\d\.\s+)?(Inledning|Avgränsningar|Metod och modell|(\d\.\d\.\s+)?Kommunikation|Ägarskap och arbetsformer|Inga ytterligare frågor)"
# Sizes against the body's, and what makes a page one of contents.
DECORATION, STYLED, TINY = 3.0, 1.15, 0.75
CONTENTS_HEADINGS, CONTENTS_CHARS, LONGEST_HEADING, LONGEST_JOINED = 8, 600, 90, 120
BOLD = 16


class PdfSpans(DataSource):
    """spark.read.format("pdf_spans").load(folder): one partition a file."""

    @classmethod
    def name(cls):
        return "pdf_spans"

    def schema(self):
        return SPANS

    def reader(self, schema):
        return _PdfReader(self.options["path"])


class _PdfReader(DataSourceReader):
    def __init__(self, folder: str):
        self.folder = folder

    def partitions(self):
        from pathlib import Path

        return [InputPartition(str(p)) for p in sorted(Path(self.folder).glob("*.pdf"))]

    def read(self, partition) -> Iterator[tuple]:
        try:
            import pymupdf
        except ImportError as missing:
            raise RuntimeError("reading PDF files needs pymupdf; a table of spans can be given instead") from missing
        for page, content in enumerate(pymupdf.open(partition.value), 1):
            for b, block in enumerate(content.get_text("dict")["blocks"]):
                for n, line in enumerate(block.get("lines", ())):
                    for s, span in enumerate(line["spans"]):
                        yield partition.value, page, b, n, s, span["font"], float(span["size"]), int(span["flags"]), span["text"]


def span_text(font: Column, text: Column) -> Column:
    """One font is extracted with a blank after every m inside words."""
    return F.when(font.startswith(SPLIT_M_FONT), F.regexp_replace(text, "m (?=[a-zåäö])", "m")).otherwise(text)


def lines(spans: DataFrame) -> DataFrame:
    """(file, page, block, line, text, style, letter) of spans; style is heading, body, dropcap or skip. Lines lie by file, as all that follows needs them: spans are shuffled once."""
    strip = lambda c: F.regexp_replace(F.translate(c, INVISIBLE, ""), r"(?U)^\s+|\s+$", "")
    body = X.body_style(spans).select("file", F.col("font").alias("body_font"), F.col("size").alias("body_size"))
    own = F.struct("span", "font", "size", "flags", "text", span_text(F.col("font"), F.col("text")).alias("own"))
    out = spans.repartition("file").groupBy("file", "page", "block", "line").agg(F.array_sort(F.collect_list(own)).alias("s"))
    out = out.withColumn("text", strip(F.array_join(F.transform("s", lambda x: x["own"]), "")))
    out = out.withColumn("s", F.filter("s", lambda x: strip(x["text"]) != ""))
    out = out.join(body, "file")  # a row for each file
    size = F.array_max(F.transform("s", lambda x: x["size"]))
    bold = F.forall("s", lambda x: F.lower(x["font"]).contains("bold") | (x["flags"].bitwiseAND(BOLD) != 0))
    letter = F.element_at(F.split("text", r"(?U)\s+"), -1)
    styled = (size >= F.col("body_size") * STYLED) | ((F.get("s", 0)["font"] != F.col("body_font")) & (size > F.col("body_size"))) | bold | F.col("text").rlike(NUMBERED)
    style = (
        F.when((F.size("s") == 0) | F.col("text").rlike(NOISE), "skip")
        .when(size > F.col("body_size") * DECORATION, F.when(letter.rlike("^[A-ZÅÄÖ]$"), "dropcap").otherwise("skip"))
        .when(~F.col("text").rlike(LETTERS) | (size < F.col("body_size") * TINY), "skip")
        .otherwise(F.when(styled, "heading").otherwise("body"))
    )
    out = out.withColumn("style", style)
    return out.select("file", "page", "block", "line", "text", "style", F.when(F.col("style") == "dropcap", letter).alias("letter"))


def without_contents(styled: DataFrame) -> DataFrame:
    """Lines of pages that are no table of contents, without skipped ones; a window over a page's lines decides."""
    page = Window.partitionBy("file", "page")
    titled = F.max(F.col("text").rlike(CONTENTS)).over(page)
    many = (F.count_if(F.col("style") == "heading").over(page) >= CONTENTS_HEADINGS) & (F.coalesce(F.sum(F.when(F.col("style") == "body", F.length("text"))).over(page), F.lit(0)) < CONTENTS_CHARS)
    return styled.where("style <> 'skip'").withColumn("contents", titled | many).where("NOT contents").drop("contents")


def reads_as_heading(text: Column) -> Column:
    """Short, with letters, capital or number first, and no sentence: pull quotes are set like headings."""
    starts = text.rlike(r"(?U)^[\p{Lu}\d]") & text.rlike(LETTERS)
    return F.length(text).between(2, LONGEST_HEADING) & starts & (~text.endswith(".") | text.rlike(NUMBERED))


def events(lines: DataFrame) -> DataFrame:
    """(file, page, block, seq, kind, text) of lines: headings, paragraphs and drop caps, which come before what else is in their block.

    Heading lines that follow one another in a block are a run. A run that does
    not read as a heading belongs to the paragraph around it; alone in a block,
    it is a pull quote and goes.
    """
    block = ["file", "page", "block"]
    # drop caps stand apart, as lines of their own windows, so one pass makes both kinds of events
    own = lines.withColumn("cap", F.col("style") == "dropcap")
    order = Window.partitionBy(*block, "cap").orderBy("line")
    own = own.withColumn("turn", (F.col("style") != F.lag("style", 1, "").over(order)).cast("int"))
    own = own.withColumn("run", F.sum("turn").over(order))
    run = Window.partitionBy(*block, "cap", "run")
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("style") == "heading", F.struct("line", "text"))).over(run)), lambda x: x["text"]), " ")
    own = own.withColumn("head", (F.col("style") == "heading") & reads_as_heading(whole)).withColumn("runs", F.max("run").over(Window.partitionBy(*block, "cap")))
    own = own.where(~((F.col("runs") == 1) & (F.col("style") == "heading") & ~F.col("head")))
    # what stands between headings is one paragraph, whatever its runs
    new = (F.col("head") & ((F.col("turn") == 1))) | (F.col("head") != F.lag("head", 1).over(order))
    own = own.withColumn("seq", F.when(F.col("cap"), -1).otherwise(F.sum(F.coalesce(new, F.lit(False)).cast("int")).over(order)))
    parts = F.transform(F.array_sort(F.collect_list(F.when(~F.col("cap"), F.struct("line", "text")))), lambda x: x["text"])
    grouped = own.groupBy(*block, "seq", "head", "cap").agg(parts.alias("parts"), F.max_by("letter", "line").alias("letter"))
    text = F.when(F.col("cap"), F.col("letter")).when(F.col("head"), F.array_join("parts", " ")).otherwise(X.joined_lines(F.col("parts")))
    return grouped.select(*block, "seq", F.when(F.col("cap"), "dropcap").when(F.col("head"), "heading").otherwise("paragraph").alias("kind"), text.alias("text"))


def merged_heading(texts: Column) -> Column:
    """Headings without text between them as one, unless a later one is numbered or both together are too long: then it replaces what was before."""

    def step(done, text):
        both = F.when(done == "", text).otherwise(F.concat(done, F.lit(" "), text))
        return F.when((F.length(both) > LONGEST_JOINED) | text.rlike(NUMBERED), text).otherwise(both)

    return F.aggregate(texts, F.lit(""), step)


def sections(spans: DataFrame) -> DataFrame:
    """(file, nth, heading, page, text): one row a heading of each file.

    A section begins where a heading follows a paragraph, so sections are
    numbered by running sums over a file's events; what is before the first
    heading is a section without one. A drop cap goes before the next paragraph.
    """
    file = Window.partitionBy("file").orderBy("page", "block", "seq")
    own = events(without_contents(lines(spans)))
    own = own.withColumn("before", F.coalesce(F.sum((F.col("kind") == "paragraph").cast("int")).over(file.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    gap = Window.partitionBy("file", "before").orderBy("page", "block", "seq")
    own = own.withColumn("letter", F.last(F.when(F.col("kind") == "dropcap", F.col("text")), ignorenulls=True).over(gap)).where("kind <> 'dropcap'")
    text = F.when(F.col("kind") == "paragraph", F.concat(F.coalesce("letter", F.lit("")), "text")).otherwise(F.col("text"))
    opens = (F.col("kind") == "heading") & (F.lag("kind").over(file) == "paragraph")
    own = own.withColumn("text", text).withColumn("section", F.sum(F.coalesce(opens, F.lit(False)).cast("int")).over(file))
    of = lambda kind: F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.struct("page", "block", "seq", "text")))), lambda x: x["text"])
    out = own.groupBy("file", "section").agg(merged_heading(of("heading")).alias("heading"), F.coalesce(F.max(F.when(F.col("kind") == "heading", F.col("page"))), F.lit(1)).alias("page"), of("paragraph").alias("parts"))
    out = out.where(F.size("parts") > 0).withColumn("nth", F.row_number().over(Window.partitionBy("file").orderBy("section")) - 1)
    return out.select("file", "nth", "heading", "page", F.array_join("parts", "\n\n").alias("text"))


def projects(spans: DataFrame) -> DataFrame:
    """(file, page, project): the project of the last directive's title page at or before each page."""
    own = spans.groupBy("file", "page", "block", "line").agg(F.array_sort(F.collect_list(F.struct("span", "text"))).alias("s"))
    text = F.array_join(F.transform("s", lambda x: x["text"]), "")
    pages = own.select("file", "page", F.struct("block", "line", text.alias("text")).alias("l")).groupBy("file", "page").agg(F.array_sort(F.collect_list("l")).alias("l"))
    head = F.left(F.array_join(F.transform("l", lambda x: x["text"]), "\n"), F.lit(300))
    name = F.regexp_extract(head, PROJECT, 2)
    other = F.regexp_extract(head, PROJECT, 1) != ""
    named = F.trim(F.regexp_replace(F.when(other, F.lit(OTHER_MATTERS)).otherwise(name), "m (?=[a-zåäö])", "m"))
    found = F.when(head.rlike(PROJECT) & ~F.contains(name, F.lit("..")), named)
    return X.carried(pages.select("file", "page", found.alias("found")), "file", "page", "found", "project").select("file", "page", F.coalesce("project", F.lit("")).alias("project"))


def records(spans: DataFrame, programs=PROGRAMS, project_file: str = PROJECT_FILE) -> DataFrame:
    """The program layer: sections of the listed documents; in the agreement, frame sections go and headings get their project's name."""
    spark = spans.sparkSession
    listed = spark.createDataFrame(list(programs), "source_file string, parti string, doc_type string, year int")
    own = sections(spans).withColumn("source_file", F.element_at(F.split("file", "/"), -1)).join(F.broadcast(listed), "source_file")
    shared = F.col("source_file") == project_file
    own = own.where(~shared | ~F.col("heading").rlike(FRAME))
    own = own.join(projects(spans.where(F.col("file").endswith(project_file))), ["file", "page"], "left")
    heading = F.when(F.coalesce("project", F.lit("")) != "", F.concat("project", F.lit(": "), "heading")).otherwise(F.col("heading"))
    nth = F.row_number().over(Window.partitionBy("file").orderBy("nth")) - 1
    return own.select(F.concat("parti", F.lit(":program:"), nth.cast("string")).alias("chunk_id"), F.lit("program").alias("layer"), "parti", "doc_type", "year", heading.alias("heading"), "page", "text", "source_file")


def word_totals(program_records: DataFrame) -> DataFrame:
    """(parti, doc_type, sections, words)."""
    words = F.size(F.regexp_extract_all("text", F.lit(r"(?U)\S+"), F.lit(0)))
    return program_records.groupBy("parti", "doc_type").agg(F.count("*").alias("sections"), F.sum(words).alias("words"))


def build(spark: SparkSession, folder: str, path: str) -> DataFrame:
    """Writes the program layer of a folder of PDF files as JSON lines; returns word totals."""
    spark.dataSource.register(PdfSpans)
    records(spark.read.format("pdf_spans").load(folder)).write.mode("overwrite").json(path)
    return word_totals(spark.read.schema("parti string, doc_type string, text string").json(path))
