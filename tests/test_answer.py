"""Links and sources of answers, metrics, flags and worklists."""

from pyspark.sql import functions as F

from skrift.operators import answer as A
from skrift.operators import evaluate as E
from skrift.operators import retrieve as R
from skrift.operators import search as S
from skrift.plans import report
from skrift.sources import index as I


def test_links_and_sources(spark):
    hits = spark.createDataFrame([(1, 1, "https://a.se/x"), (1, 2, "https://a.se/x"), (1, 3, "https:///y"), (1, 4, "javascript:x"), (1, 5, "http://b.se"), (1, 6, None)], "qid long, n int, url string")
    answers = spark.createDataFrame([(1, "A [2, 3] b [1] c [4–6].")], "qid long, answer string")
    assert sorted(map(tuple, A.links(hits, answers).collect())) == [(1, 1, "https://a.se/x"), (1, 5, "http://b.se")]
    one = spark.createDataFrame([("A [2].", ["[1, 2] x", "[3] y", "z"])], "a string, s array<string>")
    assert one.select(A.cited_sources(F.col("s"), F.col("a")).alias("c")).first().c == ["[1, 2] x"]


def test_encoders_have_unit_vectors(spark):
    encode = I.encoder(lambda: lambda texts: [[len(t), 0.0] for t in texts], "query: ", 2)
    out = encode(spark.createDataFrame([("a", "x"), ("b", "yy"), ("c", "")], "emb string, text string")).collect()
    assert {r.emb: r.vector for r in out} == {k: [1.0, 0.0] for k in "abc"}


def test_metrics_and_flags(spark):
    hits = [(1, "motion", "S;M"), (2, "said", "V")]
    rows = [
        ("a", "rag_tools", "Moderaterna vill sänka skatten för alla nu [1, 7].", hits, ["M", "V"], ["said"], "moderaterna", None, None, "sv"),
        ("b", "no_rag", "Moderaterna vill sänka skatten för alla nu [9].", [], None, None, None, True, True, "en"),
        ("c", "rag_tools", "Det saknas material [2].", hits, ["V"], ["said"], None, True, None, None),
        ("d", "rag_tools", "[no answer was generated — finish_reason: X]", [], None, None, None, None, None, None),
    ]
    table = spark.createDataFrame(rows, "qid string, config string, answer string, hits array<struct<n:int,layer:string,parti:string>>, expected array<string>, layers array<string>, attribution string, expect_gap boolean, expect_refusal boolean, lang string")
    m = E.answer_metrics(table)
    out = {r.qid: r for r in m.collect()}
    assert (out["a"].citation_validity, out["a"].party_mentioned, out["a"].party_cited, out["a"].layer_cited, out["a"].attribution_found, out["a"].claims, out["a"].cited_claims) == (0.5, 0.5, 0.5, False, True, 1, 1)
    assert out["b"].citation_validity is None and out["b"].invalid_citations == [] and out["b"].gap_acknowledged is False and out["c"].claims is None and out["c"].gap_acknowledged
    flags = {r.qid: r.p for r in m.select("qid", E.problem_flags(m).alias("p")).collect()}
    assert flags == {"a": "invalid citation 7; no source for V; expected source type not cited", "b": "gap not acknowledged; no refusal phrase; wrong language", "c": "", "d": "no answer"}
    own = m.withColumn("typ", F.lit("t")).withColumn("comparative", F.col("qid") == "a")
    text = report.report(own, E.latency(spark.createDataFrame([("rag_tools", 1.0), ("rag_tools", 3.0)], "config string, latency_s double"), "config", "latency_s"), ["rag_tools", "no_rag"])
    assert "| Median latency (s) | 2.0 | — |" in text and "| Answered | 67% (3) | 100% (1) |" in text and "| Substantive sentences with a citation | 50% (2) | 100% (1) |" in text  # the marker of no answer is a sentence
    assert report.share_figure(own, ["rag_tools"]).startswith("<svg") and "median 2.0 s" in report.latency_figure(spark.createDataFrame([("rag_tools", 2.0)], "config string, latency_s double"), ["rag_tools"])


def test_worklist_and_parents(spark):
    q = spark.createDataFrame([("a", 0, None), ("b", 1, "a"), ("c", 2, "z")], "id string, ord int, follows string")
    done = spark.createDataFrame([("x", "a", "svar")], "config string, id string, answer string")
    ids = lambda **k: [(r.config, r.id) for r in E.worklist(q, ["x", "y"], done, **k).collect()]
    assert ids() == [("x", "b"), ("x", "c"), ("y", "a"), ("y", "b"), ("y", "c")] and ids(limit=1) == [("x", "b")]
    assert ids(redo=True, only=["a"]) == [("x", "a"), ("y", "a")]
    assert sorted((r.id, r.parent_answer) for r in E.with_parent(q, done).collect()) == [("a", None), ("b", "svar")]


def test_ranges_rank_like_one_task(spark):
    from skrift.tables import range_ranked

    rows = spark.range(2000).select((F.col("id") % 2).alias("qid"), F.col("id").alias("pid"), (F.col("id") * 37 % 101).alias("score"))
    want = {(r.qid, r.pid): r["rank"] for r in S.ranked(rows, F.desc("score"), "pid").collect()}
    assert {(r.qid, r.pid): r["rank"] for r in range_ranked(rows, "qid", F.desc("score"), "pid").collect()} == want


def test_individual_motions(spark):
    rows = [("motion", "Enskild motion", "a;b", True), ("motion", "Partimotion", "a", False), ("motion", "", "a", True), ("motion", None, "a;b", False), ("said", "Enskild motion", "a", False), ("motion", None, None, False)]
    out = spark.createDataFrame(rows, "layer string, subtype string, undertecknare string, want boolean").select(R.individual(F.col("layer"), F.col("subtype"), F.col("undertecknare")).alias("got"), "want").collect()
    assert all(r.got == r.want for r in out)
