from pyspark.sql import functions as F

from skrift.operators import evaluate as E
from skrift.operators import search as S
from skrift.tables import range_ranked

WORDS = "alfa beta gamma delta epsilon zeta eta theta".split()


def passages(spark, n=60):
    rows = [(i, "pq"[i % 2], ["a", "b", "a;b", None][i % 4], "c", " ".join(WORDS[(i * k) % 8] for k in range(1, 2 + i % 5))) for i in range(n)]
    return spark.createDataFrame(rows, "pid long, layer string, party string, context string, text string")


def questions(spark):
    return spark.createDataFrame([(1, "beta gamma", [1.0, 0.0]), (2, "alfa zeta theta beta", [0.6, 0.8])], "qid long, question string, qvector array<double>")


def test_ranks_by_ranges_are_numbered_in_place(spark):
    rows = spark.range(300).select((F.col("id") % 4).alias("a"), (F.col("id") % 3).alias("b"), (F.col("id") % 7).alias("x"), "id")
    found = range_ranked(rows, ["a", "b"], F.desc("x"), "id")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning(a" not in plan.split("BroadcastExchange")[0] and "SortMergeJoin" not in plan
    want = {(r.a, r.b, r.id): r.r for r in rows.selectExpr("*", "row_number() OVER (PARTITION BY a, b ORDER BY x DESC, id) AS r").collect()}
    assert {(r.a, r.b, r.id): r["rank"] for r in found.collect()} == want and found.columns == [*rows.columns, "rank"]


def test_hits_of_wanted_passages_are_those_of_the_whole_ranking(spark, monkeypatch):
    own, asked = passages(spark), questions(spark)
    vectors = own.where("pid % 3 = 0").select("pid", F.array(F.lit(0.6) - F.col("pid") / 100, F.lit(0.8)).cast("array<double>").alias("vector"))
    cols = ["qid", "pid", "score", "l_rank", "v_rank", "similarity"]
    want = {tuple(r) for r in S.filtered(S.hybrid(own, vectors, asked, party_filter=True), own, party=["a"]).select(cols).collect()}
    wanted = S.matching(own, party=["a"])
    assert want
    for rows, ids in ((2_000_000, 4_000_000), (0, 0)):
        monkeypatch.setattr(S, "RANKED_ROWS", rows)
        monkeypatch.setattr(S, "WANTED_ROWS", ids)
        assert {tuple(r) for r in S.hybrid_within(own, vectors, asked, wanted).select(cols).collect()} == want


def test_one_list_keeps_its_ranks_and_lists_of_words_are_shared(spark):
    own, asked = passages(spark), questions(spark)
    lists = S.asked_lists(own, asked)
    for wide in (False, True):
        alone = S.hybrid(own, None, asked, "bm25", wide)
        shared = S.hybrid(own.limit(0), None, asked, "bm25", wide, lists=lists)
        assert sorted(map(tuple, alone.collect())) == sorted(map(tuple, shared.collect()))
        assert all(r["rank"] == r.l_rank and abs(r.score - 1 / (60 + r.l_rank)) < 1e-12 for r in alone.collect())
        plan = alone._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("Window [") == 1 and "Aggregate" not in plan  # the list's own ranks, no second ones


def test_runs_of_both_kinds_from_one_pass(spark):
    own, asked = passages(spark), questions(spark)
    how = spark.createDataFrame([(1, 4, None, None, None), (2, 3, None, ["a"], 1)], "qid long, k int, layer string, party array<string>, per_party int")
    ranking = S.hybrid(own, None, asked, "bm25", True)
    found = E.retrieval_run(ranking, own, how).collect()
    order = {(r.qid, r.pid): r["rank"] for r in ranking.collect()}
    assert [r.pid for r in sorted(found, key=lambda r: r["rank"]) if r.qid == 1] == [p for _, p in sorted((v, p) for (q, p), v in order.items() if q == 1)][:4]
    assert 1 <= len([r for r in found if r.qid == 2]) <= 2 and all("a" in r.party for r in found if r.qid == 2)
