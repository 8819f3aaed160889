"""Queries without SQL over small tables, against brute force."""

import hashlib
from collections import Counter

import numpy as np

from skrift.functions import text as T
from skrift.plans import queries as Q

TEXTS = [(0, "Landsbygden behöver skolor\nskolor skolor skolor skolor skolor behöver lärare", "en"), (1, "ett två tre fyra fem sex sju åtta nio tio elva tolv tretton fjorton " + "femton " * 3, "fr"), (2, "la maison est grande\n" + "le chat dort sur la grande maison " * 20, "fr"), (3, "", "de"), (4, None, "es")]

#: Postings are of the context, "source (lang)", and the text; en and de are stop words.
CONTEXT = {i: ["src0"] + [x] * (x not in ("en", "de")) for i, _, x in TEXTS}


def stored(spark, folder, name, rows, schema):
    spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")


def documents(spark, folder):
    stored(spark, folder, "documents", [(i, t, x, "src0") for i, t, x in TEXTS], "doc_id long, text string, lang string, source string")


def test_vector_topk_per_label_of_all_questions(spark, tmp_path):
    x = np.random.default_rng(3).normal(size=(40, 8)).astype("float32")
    x /= np.linalg.norm(x, axis=1)[:, None]
    stored(spark, tmp_path, "embeddings", [(i, [float(v) for v in r], i % 3) for i, r in enumerate(x)], "vec_id long, embedding array<float>, label int")
    stored(spark, tmp_path, "documents", [(i, "t", "en", "s") for i in range(30)], "doc_id long, text string, lang string, source string")
    stored(spark, tmp_path, "benchmark", [(q, "t") for q in (0, 7, 35)], "item_id long, text string")
    y = x.astype(float)
    expected = {(q, label, r, p) for q in (0, 7, 35) for label in range(3) for r, p in enumerate(sorted((i for i in range(30) if i % 3 == label), key=lambda i: (-round(float(y[i] @ y[q]), 9), i))[:3], 1)}
    assert {(r.qid, r.label, r["rank"], r.pid) for r in Q.queries()["vector_topk_per_label"](spark, str(tmp_path)).collect()} == expected


def test_best_section_match_of_whole_texts_in_all_languages(spark, tmp_path):
    documents(spark, tmp_path)
    words = lambda texts: [set(r[0] or []) for r in spark.createDataFrame([(x,) for x in texts], "x string").select(T.match_words("x")).collect()]
    expected = {}
    for i, t, _ in TEXTS:
        lines = (t or "").split("\n")
        whole, *own = words([t, *lines])
        match = [len(whole & o) / len(whole) if whole else 0.0 for o in own]
        best = match.index(max(match))
        expected[i] = (round(match[best], 6), len(lines[best]) if match[best] >= 0.5 else 0)
    out = Q.best_section_match(spark, str(tmp_path)).collect()
    assert {r.doc: (r.match_score, r.chars) for r in out} == expected


def test_whole_stem_lists_postings_and_parent_answers(spark, tmp_path):
    documents(spark, tmp_path)
    stems = {r.doc_id: r.s or [] for r in spark.read.parquet(f"{tmp_path}/documents.parquet").select("doc_id", T.tokens("text").alias("s")).collect()}
    assert any(len(s) > 12 for s in stems.values())
    q = Q.queries()
    assert {r.pid: r.sha1 for r in q["tokenize_stem"](spark, str(tmp_path)).where("n_tokens > 0").collect()} == {i: hashlib.sha1(" ".join(s).encode()).hexdigest() for i, s in stems.items() if s}
    assert {(r.pid, r.term, r.tf) for r in q["term_freq"](spark, str(tmp_path)).collect()} == {(i, w, n) for i, s in stems.items() for w, n in Counter(s + CONTEXT[i]).items()}
    long = "ett långt svar " * 9
    stored(spark, tmp_path, "conversations", [(1, 1, "user", "a"), (1, 2, "assistant", long), (1, 3, "user", "b"), (2, 4, "user", "c")], "conv_id long, turn long, role string, text string")
    assert {tuple(r) for r in q["followup_parent"](spark, str(tmp_path)).collect()} == {("1-1", None, None, None), ("1-3", "rag", "1-2", hashlib.sha1(long.encode()).hexdigest())}
