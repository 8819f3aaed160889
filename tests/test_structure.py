"""Section ends at any number of levels, slots over shared passages, spreading."""

import random
import time

from pyspark.sql import functions as F

from skrift.operators import retrieve as R
from skrift.operators import sections as X
from skrift.tables import spread


def test_section_ranges_of_any_number_of_levels(spark):
    rnd = random.Random(6)
    rows = [(d, p, rnd.choice([None, *range(60)]) if d else p % 45) for d in range(4) for p in range(0, 300, 1 + d)]
    want = set()
    for d, p, depth in rows:
        later = [(q, e) for c, q, e in rows if c == d and q > p]
        want.add((d, p, depth, later[0][0] if later else None, next((q for q, e in later if e is not None and depth is not None and e <= depth), None)))
    table = spark.createDataFrame(rows, "doc long, pos int, depth int").repartition(3)
    assert set(map(tuple, X.section_ranges(table).collect())) == want
    assert X.section_ranges(table.limit(0)).count() == 0


def test_a_shared_passage_fills_one_slot_only(spark):
    slots = R.slots(spark, ["M", "KD"], ["proposition"])
    hits = spark.createDataFrame([(1, p, "proposition", party, None, None, r, 0.1, 0.9) for r, (p, party) in enumerate([(7, "M;KD;L"), (8, "M;KD;L"), (9, "KD"), (5, "M;KD;L"), *((20 + i, "M;KD") for i in range(20))], 1)], "qid long, pid long, layer string, party string, subtype string, undertecknare string, rank int, score double, similarity double")
    out = {}
    for r in R.fill(R.group_motions(R.slot_candidates(hits, slots))).collect():
        out.setdefault(r.s_party, []).append(r.pid)
    n = slots.first()["n"]
    m = [p for p in (7, 8, 5, *range(20, 40))][:n]
    assert sorted(out["M"]) == sorted(m) and sorted(out["KD"]) == sorted([p for p in (7, 8, 9, 5, *range(20, 40)) if p not in m][:n])
    gaps = R.gaps(spark.createDataFrame([(1,), (2,)], "qid long"), slots, R.fill(R.group_motions(R.slot_candidates(hits, slots))))
    assert {(r.qid, r.s_party) for r in gaps.collect()} == {(2, "M"), (2, "KD")}


def test_spread_runs_nothing(spark):
    calls = spark.sparkContext.accumulator(0)

    @F.udf("long")
    def counted(x):
        calls.add(1)
        return x

    own = spread(spark.range(40).select(counted("id").alias("x")).groupBy("x").count())
    assert calls.value == 0 and own.count() == 40


def test_spread_leaves_rows_of_many_files_where_they_are(spark, tmp_path):
    cores = spark.sparkContext.defaultParallelism
    shuffles = lambda df: spread(df)._jdf.queryExecution().executedPlan().toString().count("Exchange RoundRobin")
    for n in (1, cores):
        spark.range(100).repartition(n).write.parquet(f"{tmp_path}/{n}")
    one, many = (spark.read.parquet(f"{tmp_path}/{n}") for n in (1, cores))
    own = many.where("id % 2 = 0").selectExpr("id + 1 AS x")
    assert shuffles(own) == 0 and spread(own).count() == 50
    # few files, and plans whose rows do not lie as the files do
    assert shuffles(one) == 1 and shuffles(many.groupBy("id").count()) == 1 and shuffles(many.join(one, "id")) == 1


def test_joined_lines_like_a_fold_and_in_linear_time(spark):
    rnd = random.Random(3)
    some = ["och ", "eller x", "x-", "Ab-", "-", "", " ", "  a- ", "b ", "åre", "ß-", "ǅ", "1", "c-\n", "--"]
    rows = [[rnd.choice(some) for _ in range(rnd.randrange(0, 9))] for _ in range(400)] + [["a", None], None]
    step = lambda done, line: F.when(done == "", line).when(done.endswith("-") & line.rlike(r"^\p{Ll}") & ~line.rlike("^(?:och|eller) "), F.concat(F.regexp_replace(done, "-$", ""), line)).otherwise(F.trim(F.concat(done, F.lit(" "), line)))
    own = spark.createDataFrame(list(enumerate(rows)), "i int, l array<string>")
    assert all(r.x == r.y for r in own.select(F.aggregate("l", F.lit(""), step).alias("x"), X.joined_lines("l").alias("y")).collect())
    began = time.perf_counter()
    out = spark.range(1).select(X.joined_lines(F.array_repeat(F.lit("ord-"), 100_000)).alias("x")).first().x
    assert out == "ord" * 100_000 + "-" and time.perf_counter() - began < 20
