"""Stages of the pipeline on rows with null and repeated ids, empty texts and extra columns."""

import random

import corpus_pipeline
from skrift.llm import mixing, pii, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long, row string, kind string"


def rows_of(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, None if t is None else len(t), "clash", None) for i, t, s in rows], DOCS)


def as_set(df):
    return sorted(map(str, df.collect()))


def test_toxicity_stage_keeps_what_the_model_leaves(spark, tmp_path):
    rnd = random.Random(12)
    word = lambda: "".join(rnd.choice("aeioulmnrst") for _ in range(5))
    rows, labels = [], []
    for i in range(240):
        words = [word() for _ in range(50)]
        if i % 4 == 0:
            words[3::9] = [f"vrakk{rnd.choice('aeiou')}{rnd.choice('stn')}" for _ in words[3::9]]
        rows.append((i, " ".join(words), "s"))
        labels.append((i, int(i % 4 == 0)))
    bad, clean = rows[0][1], rows[1][1]
    rows += [(None, bad, "s"), (None, clean, None), (1, bad, "s"), (1, clean, "s"), (300, None, "s"), (301, "", "s"), (None, None, None)]
    spark.createDataFrame([*labels, (None, 1), (7, None)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = rows_of(spark, rows)
    out = corpus_pipeline.less_toxic(spark, docs, str(tmp_path))
    assert out.columns == docs.columns
    model = toxicity.train(docs, spark.read.parquet(f"{tmp_path}/labels.parquet"))
    assert as_set(out) == sorted(str(r) for r in docs.collect() if model.severity(r.text) < toxicity.REJECT)
    kept = [(r.doc_id, r.text) for r in out.collect()]
    assert (None, bad) not in kept and (1, bad) not in kept and (None, clean) in kept and kept.count((1, clean)) == 2 and (300, None) in kept and (301, "") in kept
    assert corpus_pipeline.less_toxic(spark, docs.limit(0), str(tmp_path)).collect() == []


def test_redaction_stage_replaces_base_spans_and_nothing_else(spark):
    rows = [(1, "mail a@b.co or 1.2.3.4, 4111 1111 1111 1111 é", "s"), (None, "call +1 (555) 123-4567 now", "s"), (None, None, None), (2, "", "s"), (2, "plain 12 words", "s"), (2, "plain 12 words", "s"), (3, "x" * 9000 + " a@b.co " + "y" * 9000, "s")]
    want = ["mail [EMAIL] or [IP], [CARD] é", "call [PHONE] now", None, "", "plain 12 words", "plain 12 words", "x" * 9000 + " [EMAIL] " + "y" * 9000]
    docs = rows_of(spark, rows)
    out = corpus_pipeline.redacted(spark, docs, "")
    assert out.columns == docs.columns
    assert as_set(out) == as_set(rows_of(spark, [(i, t, s) for (i, _, s), t in zip(rows, want)]))
    assert corpus_pipeline.redacted(spark, docs.limit(0), "").collect() == [] and pii.KINDS[0] == "email"


def test_mixing_stage_keeps_every_row(spark):
    rows = [(None, "a b c", None), (None, "a b c", None), (1, None, "s"), (1, "", "s"), (2, "w " * 40, "s"), (2, "w " * 40, "s"), (3, "x y", "t")]
    out = corpus_pipeline.mixed(spark, rows_of(spark, rows), "").collect()
    assert sorted((r.doc_id or 0, r.size) for r in out) == [(0, 3), (0, 3), (1, 0), (1, 0), (2, 40), (2, 40), (3, 2)]
    goal = {r.source: r.target for r in out}
    taken = {s: sum(r.taken for r in out if r.source == s) for s in goal}
    assert all(abs(goal[s] - taken[s]) <= 1 for s in goal) and all(r.taken <= 3 * r.size for r in out)
    assert corpus_pipeline.mixed(spark, rows_of(spark, []), "").collect() == [] and mixing.WEIGHTS == (5.0, 2.0, 1.0)
