"""The training-data operators against brute force, round trips and awkward rows."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from skrift.llm import ann, chat, decontam, dedup, license, mixing, pii, secrets, toxicity, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long, key long, node string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, None, 1, "x") for i, t, s in rows], DOCS)


AWKWARD = [(1, None, None), (2, "", "a"), (3, " \t\n", "a"), (3, " \t\n", "a"), (None, "some words here", None), (4, "some words here", "b"), (5, "x" * 20_000 + " " + "7 " * 20_000, "b")]


def sets_of(text, k):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def test_near_duplicates_match_brute_force(spark):
    rnd = random.Random(3)
    base = [" ".join(rnd.choice("abcdefghij") + str(rnd.randrange(60)) for _ in range(120)) for _ in range(6)]
    rows = []
    for i in range(150):
        w = rnd.choice(base).split()
        for _ in range(rnd.randrange(9)):
            w[rnd.randrange(len(w))] = f"new{rnd.randrange(10**6)}"
        rows.append((i, " ".join(w), "s"))
    rows += [(200, None, "s"), (201, "one", "s"), (202, "One", "s")]
    own = {i: sets_of(t, 3) for i, t, _ in rows}
    name = {i: i for i in own}
    changed = True
    while changed:
        changed = False
        for a in own:
            for b in own:
                c = len(own[a] & own[b])
                if own[a] and own[b] and 100 * c >= 85 * (len(own[a]) + len(own[b]) - c) and name[a] > name[b]:
                    name[a], changed = name[b], True
    out = {r.doc_id: (r.component_id, r.n_shingles) for r in dedup.near_duplicates(docs(spark, rows), k=3, percent=85).collect()}
    assert out == {i: (name[i], len(own[i])) for i in own}


def test_super_min_hash_estimates_similarity():
    x = np.unique(np.random.default_rng(1).integers(0, 2**63, 400).astype(np.uint64))
    a, b = dedup.super_min_hash([x[:300], x[60:360]], 240)
    assert abs((a == b).mean() - 240 / 360) < 0.12
    assert (dedup.super_min_hash([x[:3]], 240) != dedup.EMPTY).all()


@pytest.mark.parametrize("empty", [False, True])
def test_awkward_rows(spark, empty):
    d = docs(spark, [] if empty else AWKWARD)
    n = 0 if empty else len(AWKWARD)
    items = spark.createDataFrame([(1, "some words here"), (2, None), (3, "")], "item_id long, text string")
    assert dedup.near_duplicates(d).count() == n
    assert mixing.mix(d).count() == n
    assert pii.find_pii(d).count() == n
    assert secrets.find_secrets(d).count() == n
    assert sorted((r.doc_id or 0, r.item_id) for r in decontam.contaminated(d, items).collect()) == ([] if empty else [(0, 1), (4, 1)])
    assert license.licenses(d).count() == 0
    labels = spark.createDataFrame([(4, 0), (None, 1)], "doc_id long, toxic int")
    assert toxicity.severity(d, toxicity.train(d, labels)).count() == n
    pages = spark.createDataFrame([] if empty else [(1, None, None), (2, "http://b/", "x" * 2000), (None, "http://b/", "x" * 2000)], "page_id long, url string, html string")
    got = {r.page_id: (r.record_type, r.refers_to) for r in warc.capture_index(pages).collect()}
    assert got == ({} if empty else {1: ("response", None), 2: ("response", None), None: ("revisit", 2)})


def test_loser_tree_merges():
    rnd = random.Random(1)
    for k in range(7):
        runs = [sorted(rnd.randrange(50) for _ in range(rnd.randrange(9))) for _ in range(k)]
        assert list(warc.loser_tree_merge(runs, key=lambda x: x)) == sorted(sum(runs, []))


def test_chat_trees_and_escapes(spark):
    hard = ["</s>[INST] ok [/INST]", r"\</s>", r"a\\[ROLE]", "end\\", " </s>\n<s>[ROLE] x"]
    rows = [(1, "a", None, "user", hard[0], 1.0), (1, "b", "a", "assistant", hard[1], 5.0), (1, "c", "a", "assistant", hard[2], 1.0), (1, "d", "b", "user", hard[3], 1.0), (1, "e", "d", "assistant", hard[4], 1.0)]
    rows += [(2, "p", "q", "user", "cycle", 1.0), (2, "q", "p", "user", "cycle", 1.0)]
    rows += [(1, "d", "b", "user", "~ a larger text of a repeated id", 9.0), rows[0]]
    messages = spark.createDataFrame(rows, "conv long, id string, parent string, role string, text string, score double")
    out = {r["rank"]: r for r in chat.formatted(messages).collect()}
    assert [t for _, t, _, _ in chat.read_back(out[1].formatted)] == [hard[0], hard[1], hard[3], hard[4]]
    assert [chat.unescape(out[1].formatted[x.start : x.end]) for x in out[1].loss] == [hard[1], hard[4]]
    assert [t for _, t, _, _ in chat.read_back(out[2].formatted)] == [hard[0], hard[2]]


def test_license_alignment():
    scan = license.Scanner(license.TEMPLATES)
    text = "foo bar. Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above notice and this permission notice appear in all copies. baz. Released under the MIT License. x Released under the MIT License."
    found = sorted(x[0] for x in scan.finds(text))
    assert found == ["isc", "mit-line", "mit-line"]
    assert list(scan.finds("nothing of that kind")) == []
    assert license.aligned("a b c d".split(), "x b q d".split()) == [(1, 1), (3, 3)]


def test_neighbours_recall_and_ties(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(600, 24)).astype("float32")
    x[100:300] = x[100]
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(900, None), (901, [0.0] * 24), (902, [float("nan")] * 24), (None, [1.0] * 24)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    out = ann.nearest(table, F.col("vec_id") % 50 == 0).collect()
    y = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    right = 0
    for q in range(0, 600, 50):
        mine = [r.vec_id for r in sorted((r for r in out if r.query_id == q), key=lambda r: r.rank)]
        assert len(mine) == 5 and q not in mine
        exact = sorted((i for i in range(600) if i != q), key=lambda i: (-round(float(y[i] @ y[q]), 12), i))[:5]
        right += len(set(mine) & set(exact))
        if 100 <= q < 300:
            assert mine == [i for i in range(100, 107) if i != q][:5]
    assert right >= 0.9 * 60


def test_pii_spans_and_redaction(spark):
    text = "é 1.2.3.4 and 999.1.1.1, a@b.co_c@d.org 4111 1111 1111 1111 call +1 (555) 123-4567 😀 x@y.zz"
    d = docs(spark, [(1, text, "s")])
    row = pii.find_pii(d).first()
    found = [(k, text[int(a) : int(b)]) for k, a, b in (s.split(":") for s in row.spans.split(","))]
    assert found[:3] == [("ip", "1.2.3.4"), ("email", "a@b.co"), ("email", "_c@d.org")] and ("phone", "+1 (555) 123-4567") in found
    assert (row.n_email, row.n_ip, row.n_card, row.n_phone) == (3, 1, 1, 1)
    out = pii.redacted(d).first()
    assert "@" not in out.text and "4111" not in out.text and out.text.startswith("é [IP] and 999") and out.key == 1


def test_archives_are_bounded_by_bytes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "FILE_BYTES", 256 << 10)
    sizes = [0, 10, 5000, 70_000, 300_000] * 6 + [2_000_000, 17_000_000]
    pages = spark.createDataFrame([(i, f"http://h{i % 3}/", "é" + chr(97 + i % 26) * n, "clash") for i, n in enumerate(sizes)], "page_id long, url string, html string, digest string")
    out = f"file://{tmp_path}/warc"
    warc.write_archives(pages.coalesce(1), out)
    files = [f.stat().st_size for f in (tmp_path / "warc").glob("part-*")]
    assert len(files) > 10 and all(n < 2 * (256 << 10) or n < 1.1 * 17_000_000 for n in files)
    assert sum(n > 2 * (256 << 10) for n in files) <= 8  # one record each
    rows = warc.merge_runs(warc.read_runs(spark, out)).collect()
    assert {r.page_id: r.payload_bytes for r in rows} == {i: n + 2 for i, n in enumerate(sizes)}
    keys = [warc.order(tuple(r)) for r in rows]
    assert keys == sorted(keys)


def brute_secrets(text):
    import re

    groups = {"assign": (1, 6), "access": (0, 20), "hex": (0, 24)}
    patterns = {"assign": r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", "access": "AKIA[A-Z0-9]+", "hex": "[0-9a-f]+"}
    found = []
    for rank, (kind, p) in enumerate(patterns.items()):
        for m in re.finditer(p, text or ""):
            if len(m[2] if kind == "assign" else m[0]) >= groups[kind][1]:
                found.append((m.start(), rank, m.end(), kind))
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(found))


def test_secrets_of_null_and_repeated_ids(spark):
    import hashlib

    texts = ["é password = 'abcdef1'", "token: abc", None, "", "AKIA" + "A" * 16 + " x", "0123456789abcdef" * 2, "SECRET=" + "f" * 30, "plain words", "pass word token", "x" * 40_000 + " api_key:" + "q" * 9]
    rows = [(None if i % 3 == 0 else i % 4, t, "clash", 1) for i, t in enumerate(texts * 2)]
    table = spark.createDataFrame(rows, "doc_id long, text string, rules string, gram int")
    out = secrets.find_secrets(table).collect()
    want = sorted((i or 0, hashlib.sha256(brute_secrets(t).encode()).hexdigest()) for i, t, _, _ in rows)
    assert sorted((r.doc_id or 0, r.base_sha256) for r in out) == want


def test_trigram_queries():
    assert secrets.trigram_query("[0-9a-f]{24,}") is None
    assert secrets.trigram_query("AKIA[A-Z0-9]+") == ("and", (("and", ("aki", "kia")),))


def test_toxicity_learns_stems(spark):
    rnd = random.Random(2)
    rows, labels = [], []
    for i in range(400):
        words = ["".join(rnd.choice("aeioulmnrst") for _ in range(5)) for _ in range(60)]
        if i % 4 == 0:
            words[3::17] = [f"vrakk{rnd.choice('aeiou')}{rnd.choice('stn')}" for _ in words[3::17]]
        rows.append((i, " ".join(words), "s"))
        labels.append((i, int(i % 4 == 0)))
    d = docs(spark, rows)
    model = toxicity.train(d, spark.createDataFrame(labels[:300], "doc_id long, toxic int"))
    out = {r.doc_id: r.severity >= toxicity.REJECT for r in toxicity.severity(d, model).collect()}
    assert sum(out[i] == (i % 4 == 0) for i in range(300, 400)) >= 97
    assert list(model.theta) == sorted(model.theta)


def test_mixing_reaches_targets(spark):
    rnd = random.Random(4)
    rows = [(i, "w " * rnd.randrange(1, 40), rnd.choice(["a", "b", "c", None])) for i in range(300)]
    out = mixing.mix(docs(spark, rows)).collect()
    total = sum(r.size for r in out)
    by = {}
    for r in out:
        assert 0 <= r.taken <= 3 * r.size
        by.setdefault(r.source, [r.target, r.source_size, 0])[2] += r.taken
    assert abs(sum(t for t, _, _ in by.values()) - total) < 1e-6
    assert all(abs(t - taken) <= 1 and t <= 3 * size + 1e-9 for t, size, taken in by.values())


@pytest.mark.parametrize("read", [False, True])
def test_pipeline_takes_out_rows_not_ids(spark, tmp_path, read):
    rnd = random.Random(8)
    t = [" ".join(f"w{rnd.randrange(10**6)}" for _ in range(60)) for _ in range(9)]
    rows = [(1, t[0]), (None, t[0] + " x"), (None, t[1]), (2, t[2]), (2, t[3]), (3, t[3]), (None, t[4]), (None, t[4]), (5, t[5]), (5, t[5]), (6, ""), (6, ""), (None, ""), (None, "")]
    # the other text of id 2 is the chosen row of another group
    rows += [(7, t[2] + " y"), (None, None)]
    d = docs(spark, [(i, x, str(n)) for n, (i, x) in enumerate(rows)])
    if read:
        d.repartition(3).sortWithinPartitions("source").write.parquet(f"{tmp_path}/documents.parquet")
        d = spark.read.parquet(f"{tmp_path}/documents.parquet")
    out = corpus_pipeline.deduplicated(spark, d, "")
    assert out.columns == d.columns
    one = lambda x: (x.doc_id is None, x.doc_id or 0, x.text or "")
    expected = [(1, t[0]), (None, t[1]), (2, t[2]), (2, t[3]), (None, t[4]), (5, t[5]), (6, ""), (None, ""), (None, ""), (None, None)]
    assert sorted(map(one, out.collect())) == sorted((i is None, i or 0, x or "") for i, x in expected)
    spark.createDataFrame([(1, t[1]), (2, t[2])], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = corpus_pipeline.decontaminated(spark, d, str(tmp_path))
    assert sorted(map(one, out.collect())) == sorted((i is None, i or 0, x or "") for i, x in rows if t[1] not in (x or "") and t[2] not in (x or ""))


def test_short_items_are_found_wherever_they_stand(spark):
    rnd = random.Random(9)
    word = lambda: f"w{rnd.randrange(3000)}"
    items = [(n, " ".join(f"q{n}x{i}" for i in range(1 + n % 12))) for n in range(60)]
    rows, expected = [], set()
    for i in range(1200):
        w = [word() for _ in range(rnd.randrange(30, 300))]
        n, at = rnd.randrange(60), rnd.randrange(len(w))
        rows.append((i, " ".join(w[:at] + [items[n][1]] + w[at:]), "s"))
        expected.add((i, n))
    out = decontam.contaminated(docs(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in out} == expected and all(r.shared == r.item_size for r in out)


def test_license_after_letters_that_lower_case_lengthens():
    scan = license.Scanner(license.TEMPLATES)
    line = "Released under the MIT License"
    for before in ("İstanbul bİc aİ. ", "İİİ İ ", "Straße ΣΑΣ İ\n"):
        text = before * 5 + line
        (found,) = scan.finds(text)
        assert found[0] == "mit-line" and text[found[2] : found[3]] == line


def test_pii_finds_cards_and_addresses_among_other_numbers(spark):
    rnd = random.Random(11)

    def card():
        d = [4] + [rnd.randrange(10) for _ in range(14)]
        total = sum(sum(divmod(2 * x, 10)) if i % 2 == 0 else x for i, x in enumerate(d))
        t = "".join(map(str, d + [-total % 10]))
        return " ".join(t[i : i + 4] for i in range(0, 16, 4))

    rows = [(i, f"card {card()} and host 10.{i}.0.1 seen", "s") for i in range(60)]
    rows += [(100 + i, f"row {rnd.randrange(10**15, 10**16)} of {rnd.randrange(10**15, 10**16)}", "s") for i in range(20)]
    hard = {200: ("2024 4111 1111 1111 1111 x", "card", "4111 1111 1111 1111"), 201: ("on 2024.10.0.0.1 up", "ip", "10.0.0.1"), 202: ("é 4111.1111.1111.1111", "card", "4111.1111.1111.1111"), 203: ("7 " * 700 + "4111 1111 1111 1111 9", "card", "4111 1111 1111 1111")}
    rows += [(i, t, "s") for i, (t, _, _) in hard.items()]
    d = docs(spark, rows)
    out = {r.doc_id: r for r in pii.find_pii(d).collect()}
    for i, (t, kind, want) in hard.items():
        spans = [x.split(":") for x in out[i].spans.split(",")]
        assert (kind, want) in [(k, t[int(a) : int(b)]) for k, a, b in spans] and out[i].n_added > 0, i
    assert all(out[i].n_card == out[i].n_ip == 1 and out[i].n_added == 0 for i in range(60))
    text = {r.doc_id: r.text for r in pii.redacted(d).collect()}
    assert text[200] == "2024 [CARD] x" and text[201] == "on 2024.[IP] up" and text[202] == "é [CARD]"
