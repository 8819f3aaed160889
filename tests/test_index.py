"""Index versions, the vector cache, streams and the grading sheet on small rows."""

import csv
import json

import pytest
from pyspark.sql import functions as F

from skrift.operators import search as S
from skrift.plans import report
from skrift.sources.index import Index, append, build, compact, manifest, vacuum
from skrift.streaming import passages as P

ROWS = [(1, "A", "said", "A said", "skatten på arbete sänks"), (2, "B", "motion", "B motion", "vargen ska skyddas"), (3, "A;C", "program", "AC program", "skatten på vargar"), (4, "B", "said", "A said", "skatten på arbete sänks")]


def passages(spark, rows=ROWS):
    return spark.createDataFrame(rows, "pid long, party string, layer string, context string, text string")


def stub(df):
    return S.stub_vectors(df, "emb", "text")


def asked(spark):
    q = spark.createDataFrame([(1, "skatten på arbete")], "qid long, question string")
    return q.join(S.stub_vectors(q, "qid", "question").withColumnRenamed("vector", "qvector"), "qid")


def test_index_round_trip(spark, tmp_path):
    folder = f"file://{tmp_path}/index"
    assert manifest(spark, folder) is None
    with pytest.raises(FileNotFoundError):
        Index(spark, folder)
    first = build(passages(spark), folder, stub)
    own = Index(spark, folder)
    assert own.vectors.count() == 4 and spark.read.parquet(*first["vectors"]).count() == 3
    want = [tuple(r) for r in S.bm25(passages(spark), asked(spark), 10).orderBy("rank").collect()]
    got = [tuple(r) for r in S.bm25_scored(own.postings, own.stats, asked(spark), 10).orderBy("rank").collect()]
    assert got == want and len(want) == 3
    assert [r.pid for r in own.search(asked(spark), 2).orderBy("rank").collect()] == [1, 4]
    assert {r.pid for r in own.search(asked(spark), 8, party=["C"]).collect()} == {3}
    # only the new key is encoded; a lexical build leaves the vectors alone
    second = build(passages(spark, [*ROWS, (5, "D", "said", "D said", "nytt")]), folder, stub)
    assert spark.read.parquet(second["vectors"][-1]).count() == 1
    third = build(passages(spark), folder, None)
    assert third["vectors"] == second["vectors"] and Index(spark, folder).vectors.count() == 4
    assert build(passages(spark), folder, stub, "other")["vectors"][0] not in second["vectors"]


def hits(own, spark):
    return sorted((r.pid, round(r.score, 9), r["rank"]) for r in own.bm25(asked(spark), 10).collect())


def test_deltas_are_like_a_build(spark, tmp_path):
    folder, other = f"file://{tmp_path}/deltas", f"file://{tmp_path}/whole"
    with pytest.raises(FileNotFoundError):
        append(passages(spark), folder)
    build(passages(spark, [ROWS[0], (2, "B", "motion", "B motion", "skatten är gammal"), (9, "X", "said", "X", "skatten går bort")]), folder, stub)
    append(passages(spark, ROWS[1:3] + ROWS[1:2]), folder, name="a", encode=stub)
    now = append(passages(spark, ROWS[3:]), folder, removed=spark.createDataFrame([(9,), (77,)], "pid long"), name="b", encode=stub)
    assert append(passages(spark), folder, name="a") == now and len(now["segments"]) == 3
    build(passages(spark), other, stub)
    own, whole = Index(spark, folder), Index(spark, other)
    assert (own.manifest["n"], own.manifest["words"]) == (whole.manifest["n"], whole.manifest["words"])
    assert hits(own, spark) == hits(whole, spark) and own.vectors.count() == 4
    assert [r.pid for r in own.search(asked(spark), 8).orderBy("rank").collect()] == [r.pid for r in whole.search(asked(spark), 8).orderBy("rank").collect()]
    # a passage that was taken out comes back
    append(passages(spark, [(9, "X", "said", "X", "skatten kom")]), folder)
    append(passages(spark, []), folder, removed=spark.createDataFrame([(9,)], "pid long"))
    assert hits(Index(spark, folder), spark) == hits(whole, spark)
    done = compact(spark, folder)
    assert len(done["segments"]) == 1 and compact(spark, folder) == done and hits(Index(spark, folder), spark) == hits(whole, spark)
    assert vacuum(spark, folder) == []  # the last step's tables may still be read
    gone = vacuum(spark, folder, 0)
    assert len(gone) == 5 and not any((tmp_path / "deltas" / g.rsplit("/", 1)[-1] / "postings").exists() for g in gone)
    assert hits(Index(spark, folder), spark) == hits(whole, spark) and Index(spark, folder).vectors.count() == 4


def test_a_repeated_batch_adds_nothing(spark, tmp_path):
    folder, given = f"file://{tmp_path}/index", tmp_path / "in"
    given.mkdir()
    build(passages(spark, []), folder, None)
    kind = passages(spark).schema
    for n, rows in enumerate((ROWS[:2], ROWS[1:])):
        (given / f"{n}.json").write_text("\n".join(json.dumps(dict(zip(kind.names, r))) for r in rows))
        P.append_new(spark.readStream.schema(kind).json(str(given)), folder, f"{tmp_path}/state").awaitTermination()
    found = manifest(spark, folder)
    assert found["n"] == 4 and len(found["segments"]) == 3
    # the last batch's commit is lost: it runs again
    for name in ("1", ".1.crc"):
        (tmp_path / "state" / "commits" / name).unlink()
    P.append_new(spark.readStream.schema(kind).json(str(given)), folder, f"{tmp_path}/state").awaitTermination()
    assert manifest(spark, folder) == found


def test_stream_adds_each_key_once(spark, tmp_path):
    given, out = tmp_path / "in", f"file://{tmp_path}/vectors"
    given.mkdir()
    for n in range(2):
        (given / f"{n}.json").write_text("\n".join(json.dumps({"context": "c", "text": t}) for t in ("a", f"b{n}", "a")))
        stream = spark.readStream.schema("context string, text string").json(str(given))
        query = P.embed_new(stream, out, stub, f"{tmp_path}/state")
        query.awaitTermination()
    found = spark.read.parquet(out)
    assert found.count() == found.select("emb").distinct().count() == 3


def test_grading_sheet(spark, tmp_path):
    kind = "config string, id string, typ string, fraga string, answer string, sources array<string>, error string"
    log = spark.createDataFrame([("rag", "q2", "t", "f", "new\nline [2, 3]", ["[1] s1", "[2] s2", "[3, 4] s3"], None), ("rag", "q1", "t", "f", "same", [], None), ("rag", "q3", "t", "f", None, None, "broken")], kind)
    old = spark.createDataFrame([("rag", "q1", "same", "2", "1", "1", "1", "ok"), ("rag", "q2", "old", "0", "0", "0", "0", "")], "config string, id string, answer string, supported string, attribution string, relevance string, neutral string, notes string")
    path = tmp_path / "grading.csv"
    assert report.write_grading(report.grading_rows(log, old), str(path), ["rag"], ["q1", "q2"]) == 2
    assert path.read_bytes().startswith(b"\xef\xbb\xbf")
    with open(path, encoding="utf-8-sig", newline="") as f:
        rows = list(csv.DictReader(f))
    assert [(r["id"], r["supported"], r["sources"]) for r in rows] == [("q1", "2", ""), ("q2", "", "[2] s2\n[3, 4] s3")]


def test_means_at_three_grains(spark):
    m = spark.createDataFrame([("rag", "a", "q1", 1.0), ("rag", "a", "q2", None), ("rag", "b", "q3", 0.0)], "config string, typ string, id string, x double")
    out = report.means(m, ["x"])
    assert out.count() == 6
    assert out.where("typ IS NULL").first()["x"] == 0.5
    assert "| 0.500 |" in report.markdown(out.where("typ IS NULL").select(F.col("x")))
