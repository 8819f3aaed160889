"""Motions: HTML files to one record a proposal, each with the section that argues for it.

A file is one row with its elements in order (see elements.py); headers, proposals
and sections are column expressions over them, and proposals meet sections by
their words, so no file meets another one and nothing is shuffled.
"""

import json
from collections import Counter
from itertools import chain

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructType

from .. import constants as K
from ..functions import text as T
from ..functions.counts import MatchWords
from . import log
from .elements import HEADINGS, outlines, stripped

# Classes and patterns of the export's markup.
PROPOSAL_CLASSES = {"Frslagstext", "Hemstlatt", "Yrkande"}
HEADING_CLASSES = {"Rubrik1numrerat", "Rubrik2numrerat", "Rubrik3numrerat", "Rubrik4numrerat"}
NUMBER = r"^(\d{4}/\d{2}):(\S+)"
PARTY = r"\((?:[a-zåäö]+\s+)?([A-ZÅÄÖ]{1,3})\)\s*$"


def html_files(spark: SparkSession, folder: str) -> DataFrame:
    """(file, html) of all .html files below a folder; bytes that are no UTF-8 become replacement characters."""
    own = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.html").load(folder)

    @F.pandas_udf("string")
    def decoded(col: pd.Series) -> pd.Series:
        return col.map(lambda b: b.decode("utf-8", errors="replace"))

    return own.select(F.col("path").alias("file"), decoded("content").alias("html"))


def _named(line: Column, tag: str, name: str) -> Column:
    return (line["tag"] == tag) & F.array_contains(line["classes"], name)


def _any(line: Column, names) -> Column:
    return F.arrays_overlap(line["classes"], F.array(*map(F.lit, sorted(names))))


def _with(value: Column, then) -> Column:
    """then(value), where value is computed once: a lambda function that names an expression computes it for each element."""
    return F.get(F.transform(F.array(value), then), 0)


def _wanted(tag: str, classes: list[str]) -> bool:
    """Elements that a motion is read from."""
    return tag in ("p", "li", *HEADINGS) or (tag == "span" and ("sidhuvud_beteckning" in classes or "MotionarLista" in classes)) or (tag == "div" and "Section1" in classes)


def lines(files: DataFrame, key: str = "file") -> DataFrame:
    """(key, lines) of (key, html): headers, headings, paragraphs, list items and section divisions in order, with their strings joined without white space at their ends (spans) or as clean text."""
    own = outlines(files.select(key, "html"), _wanted, ("li",))
    texts = lambda e: F.slice("strings", e["first"], e["n"])
    text = lambda e: F.when(e["tag"] == "span", stripped(texts(e))).when(e["tag"] == "div", "").otherwise(T.clean(F.array_join(texts(e), "")))
    line = lambda e: F.struct(e["start"].alias("start"), e["end"].alias("end"), e["tag"].alias("tag"), e["classes"].alias("classes"), e["inside"].alias("in_item"), text(e).alias("text"))
    return own.select(key, F.transform("elements", line).alias("lines"))


def header(lines: Column) -> Column:
    """{rm, beteckning, parti, forste_undertecknare, doc_title, undertecknare} by the first line of each kind; what a page lacks is empty."""
    first = lambda kind: F.coalesce(F.get(F.filter(lines, kind), 0)["text"], F.lit(""))
    number, signer = first(lambda x: _named(x, "span", "sidhuvud_beteckning")), first(lambda x: _named(x, "span", "MotionarLista"))
    signers = F.filter(lines, lambda x: _named(x, "p", "Underskrifter") & (x["text"] != ""))
    return F.struct(
        F.regexp_extract(number, NUMBER, 1).alias("rm"), F.regexp_extract(number, NUMBER, 2).alias("beteckning"), F.regexp_extract(signer, PARTY, 1).alias("parti"),
        signer.alias("forste_undertecknare"), first(lambda x: x["tag"] == "h1").alias("doc_title"), F.array_join(F.transform(signers, lambda x: x["text"]), ";").alias("undertecknare"),
    )


def proposals(lines: Column) -> Column:
    """[text]: list items or paragraphs of the classes of proposals, in order."""
    return F.transform(F.filter(lines, lambda x: x["tag"].isin("li", "p") & _any(x, PROPOSAL_CLASSES) & (x["text"] != "")), lambda x: x["text"])


def sections(lines: Column) -> Column:
    """[{heading, body}]: headings of the first section division with the paragraphs up to the next; neither list items nor proposals are body text."""
    within = lambda x, top: (x["start"] > top["start"]) & (x["end"] < top["end"]) & x["tag"].isin("p", *HEADINGS) & ~x["in_item"] & ~_any(x, PROPOSAL_CLASSES) & (x["text"] != "")
    own = _with(F.get(F.filter(lines, lambda x: _named(x, "div", "Section1")), 0), lambda top: F.filter(lines, lambda x: within(x, top)))
    texts = lambda own: F.transform(own, lambda x: x["text"])
    heads = lambda own: F.array_compact(F.transform(own, lambda x, i: F.when(x["tag"].isin(*HEADINGS) | _any(x, HEADING_CLASSES), i)))

    def cut(x: Column) -> Column:
        end = lambda i: F.coalesce(F.get(x["heads"], i + 1), F.size(x["texts"]))
        body = lambda at, i: F.array_join(F.slice(x["texts"], at + 2, end(i) - at - 1), " ")
        return F.transform(x["heads"], lambda at, i: F.struct(F.get(x["texts"], at).alias("heading"), body(at, i).alias("body")))

    return _with(_with(own, lambda own: F.struct(texts(own).alias("texts"), heads(own).alias("heads"))), cut)


@F.arrow_udf(ArrayType(StructType().add("match_score", DoubleType()).add("pos", IntegerType())))
def matched(proposals: pa.Array, bodies: pa.Array) -> pa.Array:
    """[{match_score, pos}] of each proposal: the place of the section whose body holds the largest share of its words, the first of equals; pos is null where none shares any.

    Words meet words of one motion, so pairs are as many as its parts share words.
    """
    known, found = MatchWords(), []
    for asks, parts in zip(proposals, bodies):
        places, own = {}, []
        for n, body in enumerate(parts.as_py()):
            for word in known.of(body):
                places.setdefault(word, []).append(n)
        for words in map(known.of, asks.as_py()):
            both = Counter(chain.from_iterable(places[word] for word in words if word in places))
            pos, most = min(both.items(), key=lambda x: (-x[1], x[0]), default=(None, 0))
            own.append((most / len(words) if most else 0.0, pos))
        found.append(own)
    return pa.array(found, pa.list_(pa.struct([("match_score", pa.float64()), ("pos", pa.int32())])))


def records(files: DataFrame, key: str = "file", least: float = K.MIN_MATCH) -> DataFrame:
    """One row a proposal of the motions in files (key, html), with the best section if it holds at least `least` of the proposal's words. Files meet no other rows."""
    own = lines(files, key).select(key, header(F.col("lines")).alias("head"), proposals(F.col("lines")).alias("asks"), sections(F.col("lines")).alias("parts"))
    own = own.withColumn("best", matched("asks", F.transform("parts", lambda s: s["body"])))

    def record(text: Column, i: Column) -> Column:
        best = F.get("best", i)
        of = lambda name: F.when(best["match_score"] >= least, F.coalesce(F.get("parts", best["pos"])[name], F.lit(""))).otherwise("")
        return F.struct(text.alias("text"), of("heading").alias("heading"), of("body").alias("sektion_text"), best["match_score"].alias("match_score"), (i + 1).alias("yrkande_nr"))

    out = own.select(key, "head", F.explode(F.transform("asks", record)).alias("own"))
    return out.select(
        key, "own.*", "head.parti", "head.rm", "head.beteckning", "head.doc_title", "head.forste_undertecknare", "head.undertecknare",
        F.lit("motion").alias("layer"), F.concat("head.rm", F.lit(":"), "head.beteckning", F.lit(":yrkande:"), F.col("own.yrkande_nr").cast("string")).alias("chunk_id"),
    )


def build(spark: SparkSession, folder: str, path: str, least: float = K.MIN_MATCH) -> dict:
    """Writes the motion layer of a folder as JSON lines; returns counts: files, records, uncertain, and records by party."""
    files = html_files(spark, folder)
    n = files.count()
    if not n:
        raise FileNotFoundError(f"no .html files in {folder}")
    records(files, least=least).drop("file").orderBy("rm", "beteckning", "yrkande_nr").write.mode("overwrite").json(path)
    done = spark.read.schema("parti string, match_score double").json(path)
    total = done.agg(F.count("*").alias("records"), F.count_if(F.col("match_score") < least).alias("uncertain")).first()
    return {"files": n, **total.asDict(), "by_party": {r["parti"]: r["count"] for r in done.groupBy("parti").count().collect()}}


SUBTYPES = "rm string, beteckning string, subtyp string"


def subtype_pages(spark: SparkSession, sessions: list[str], fetch) -> DataFrame:
    """(key, subtype) of a paged listing: one task a session follows its pages.

    fetch(session, page) gives (documents, next page or None): a connector that
    the caller has, as the library makes no requests of its own.
    """

    def pages(frames):
        for frame in frames:
            for session in frame.session:
                page = None
                while True:
                    found, page = fetch(session, page)
                    yield pd.DataFrame([(d["rm"], d["beteckning"], d.get("subtyp") or "") for d in found], columns=["rm", "beteckning", "subtyp"])
                    if page is None:
                        break

    own = spark.createDataFrame([(s,) for s in sessions], "session string").repartition(max(1, len(sessions)), "session")
    got = own.mapInPandas(pages, SUBTYPES)
    return got.groupBy(F.concat("rm", F.lit(":"), "beteckning").alias("key")).agg(F.max("subtyp").alias("subtype"))


class SavedPages(DataSource):
    """spark.readStream.format("saved_pages").load(folder): the documents of a listing's saved pages, `<session>-<page>.json` files, in order of name.

    The offset is the name of the last page that was read: it is kept in the
    query's checkpoint, so a restart goes on behind it and reads no page twice.
    A page holds {"documents": [{"rm", "beteckning", "subtyp"}]}; pages are
    saved under names that sort in the order of saving. The folder is read by
    pyarrow's file systems, local or remote.
    """

    @classmethod
    def name(cls):
        return "saved_pages"

    def schema(self):
        return SUBTYPES + ", page string"

    def streamReader(self, schema):
        return _SavedPagesReader(self.options["path"])


class _Page(InputPartition):
    def __init__(self, name: str):
        self.name = name


class _SavedPagesReader(DataSourceStreamReader):
    def __init__(self, folder: str):
        self.folder = folder

    def _store(self):
        from pyarrow.fs import FileSystem

        return FileSystem.from_uri(self.folder) if "://" in self.folder or self.folder.startswith("file:") else FileSystem.from_uri("file://" + self.folder)

    def _names(self) -> list[str]:
        from pyarrow.fs import FileSelector, FileType

        store, path = self._store()
        return sorted(f.base_name for f in store.get_file_info(FileSelector(path)) if f.type == FileType.File and f.base_name.endswith(".json") and f.base_name[0] not in "._")

    def initialOffset(self) -> dict:
        return {"page": ""}

    def latestOffset(self) -> dict:
        return {"page": max(self._names(), default="")}

    def partitions(self, start: dict, end: dict):
        return [_Page(n) for n in self._names() if start["page"] < n <= end["page"]]

    def read(self, partition: _Page):
        store, path = self._store()
        with store.open_input_stream(f"{path}/{partition.name}") as f:
            for d in json.loads(f.read()).get("documents", []):
                yield d["rm"], d["beteckning"], d.get("subtyp") or "", partition.name


def subtype_stream(spark: SparkSession, pages: str, folder: str, checkpoint: str) -> StreamingQuery:
    """Adds what saved pages list to a log of subtypes (see log.py); `latest` of it by document is the dictionary."""
    spark.dataSource.register(SavedPages)

    def add(batch: DataFrame, n: int) -> None:
        log.append(batch, folder, f"{checkpoint}-{n}", ["page"])

    return spark.readStream.format("saved_pages").load(pages).writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
