"""Contracts of text functions, splitting, caps, metrics and sections on small rows."""

import pytest
from pyspark.sql import functions as F

from skrift.functions import text as T
from skrift.functions.split import split_text
from skrift.operators import evaluate as E
from skrift.operators import search as S
from skrift.operators import sections as X
from skrift.operators.retrieve import quota
from skrift.sources import html as H


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("word,stem", [("det", "det"), ("stat", "stat"), ("landsbygden", "landsbygd"), ("partierna", "parti")])
def test_stem(spark, word, stem):
    assert one(spark, T.stem(F.col("w")), w=word) == stem


@pytest.mark.parametrize("answer,numbers", [("a [3]", [3]), ("[3, 5]", [3, 5]), ("[3–5]", [3, 4, 5]), ("[3-5]", [3, 4, 5]), ("[5-3]", [5, 3]), ("[1-99]", [1, 99]), ("none", [])])
def test_citations(spark, answer, numbers):
    assert one(spark, T.cited_numbers(F.col("a")), a=answer) == numbers


def test_split_text():
    assert split_text("") == [] == split_text(None)
    assert split_text("a" * 1200) == ["a" * 1200]
    long = split_text("One two three. " * 200)
    assert len(long) > 1 and max(map(len, long)) <= 1350
    assert long[1].startswith(long[0][-150:].split(" ", 1)[1])
    giant = split_text("First one. Second one. " + "x" * 3000 + ".")
    assert giant[0].startswith("First one.")


def test_a_piece_without_a_tail_stays_as_it_is():
    text = "a" * 1200 + "\n\n" + "bb " * 500 + "c."
    whole = "bb " * 400
    assert split_text(text)[:2] == ["a" * 1200, whole] and len(whole) == 1200
    assert split_text(text, ordered=False)[1] == whole.strip()


def test_shared_cap_is_greedy(spark):
    rows = [(1, 1, "A;B", 1), (1, 2, "A", 2), (1, 3, "B;C", 3), (1, 4, "", 4), (1, 5, "C", 5), (1, 6, "", 6)]
    hits = spark.createDataFrame(rows, "qid long, pid long, party string, rank int")
    assert [r.pid for r in S.capped_shared(hits, 1, 8).orderBy("rank").collect()] == [1, 3, 4]


def test_quota():
    assert quota("one_party", ("motion",)) == {"motion": 17}


def test_exclusive_p90(spark):
    rows = [("a", float(v)) for v in (1, 2, 3, 10)] + [("b", 5.0), ("b", 7.0), ("c", 4.0)]
    out = {r.k: (r.p50, round(r.p90, 6)) for r in E.latency(spark.createDataFrame(rows, "k string, v double"), "k", "v").collect()}
    assert out == {"a": (2.5, 13.5), "b": (6.0, 8.4), "c": (4.0, 4.0)}


def test_section_ranges(spark):
    heads = spark.createDataFrame([("d", 1, 1), ("d", 2, 2), ("d", 3, 1)], "doc string, pos int, depth int")
    assert sorted((r.pos, r.next_any, r.next_level) for r in X.section_ranges(heads).collect()) == [(1, 2, 3), (2, 3, 3), (3, None, None)]


def test_paragraphs(spark):
    assert one(spark, X.paragraphs(F.col("t")), t="hus-\nhållens bruk.") == ["hushållens bruk."]


def test_best_section(spark):
    y = spark.createDataFrame([("d", 1, "skogen behöver skydd"), ("d", 2, "helt annat ämne")], "doc string, nr int, text string")
    s = spark.createDataFrame([("d", 1, "Skogen", "skydd för skogen behöver mer"), ("d", 2, "Havet", "fiske")], "doc string, pos int, heading string, body string")
    out = {r.nr: (r.match_score, r.heading) for r in E.best_sections(y, s).collect()}
    assert out[1] == (1.0, "Skogen") and out[2] == (0.0, "")


def test_html(spark):
    long = "ord och mer text om skolan i hela landet som ska bli bättre"
    pages = spark.createDataFrame([("https://a.se/b/", f"<title>T</title><nav>x</nav><article><p>{long}<b> b<br>{long}</article><a href='../u#f'>L</a>")], "url string, html string")
    row = H.main_text(pages).first()
    assert (row.title, row.text) == ("T", f"{long} b\n{long}")
    assert [(r.url, r.labels) for r in H.anchors(pages).collect()] == [("https://a.se/u", ["L"])]
    saved = spark.createDataFrame([("m", bytearray(b"junk<urlset><url><loc>u</loc><lastmod>2024-01-02T03</lastmod></url></urlset>")), ("n", bytearray(b"\x1f\x8bbad")), ("o", None)], "url string, content binary")
    sites = spark.createDataFrame([("S", "m"), ("T", "n"), ("U", "o"), ("V", "gone")], "party string, sitemap string")
    assert list(map(tuple, H.site_urls(saved, sites).collect())) == [("S", "u", "2024-01-02")]


def test_latest(spark):
    rows = spark.createDataFrame([("a", 1, 5.0), ("a", 2, None)], "k string, seq int, v double")
    assert [tuple(r) for r in E.latest(rows, ["k"], "seq").collect()] == [("a", 2, None)]
