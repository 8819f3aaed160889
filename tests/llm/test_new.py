"""Phrases, packing and hard negatives against brute force, on awkward and hot rows too."""

import functools
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from skrift.llm import negatives, packing, phrases

DOCS = "doc_id long, text string, lang string, source string, n long, phrase string, length long, rank int"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, lang, "s", 1, "x", 2, 3) for i, t, lang in rows], DOCS)


# -- phrases --------------------------------------------------------------------


def brute_phrases(rows, least, longest, inside, top):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    f, n = {}, Counter()
    for _, text, lang in rows:
        own = f.setdefault(lang or "und" if lang is None else lang, Counter())
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(lower)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang if lang is not None else "und"] += len(w)
            own.update(tuple(w[i : i + k]) for k in range(1, longest + 1) for i in range(len(w) - k + 1))
    out = {}
    for lang, own in f.items():
        found = {p: a for p, a in own.items() if len(p) > 1 and a >= least}
        kept = []
        for p, a in found.items():
            if any(len(q) > len(p) and 100 * b >= inside * a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in found.items()):
                continue
            score, _, left, right = min((1_000_000 * a * a // (own[p[:k]] * own[p[k:]]), k, own[p[:k]], own[p[k:]]) for k in range(1, len(p)))
            kept.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (s, a, p, left, right) in enumerate(sorted(kept)[:top], 1):
            out[lang, rank] = (p.decode(), -a, left, right, n[lang], -s)
    return out


@pytest.mark.parametrize("bits,longest,chunk", [(26, 3, 3_000_000), (16, 3, 40), (16, 4, 40), (26, 2, 3_000_000)])
def test_phrases_match_brute_force(spark, monkeypatch, bits, longest, chunk):
    monkeypatch.setattr(phrases, "CHUNK", chunk)
    rnd = random.Random(5)
    word = lambda: rnd.choice(["a", "B", "c", "É", "é", "dd", "zürich", "\x00", "x1"])
    rows = []
    for i in range(300):
        text = "".join(word() + rnd.choice([" ", " ", " ", "\t", "  ", ". ", ",", "\n", "\x0b", "!"]) for _ in range(rnd.randrange(30)))
        rows.append((i % 7 or None, text, rnd.choice(["en", "de", None, "und", ""])))
    rows += [(1, None, "en"), (2, "", "xx"), (3, " ..,", "yy"), (4, "one " * 30_000, "en"), (5, "lone", "zz")]
    got = phrases.phrases(docs(spark, rows), least=3, longest=longest, top=40, bits=bits).collect()
    assert {(r.lang, r["rank"]): (r.phrase, r.a, r.l, r.r, r.n, r.score) for r in got} == brute_phrases(rows, 3, longest, 50, 40)


def test_phrase_scores_are_exact(spark, monkeypatch):
    """Products beyond 64 bits."""
    big = 2_999_999_999_999_999
    tables = [("x y", big - 7), ("x", big), ("y", big - 1)]
    t = spark.createDataFrame([("en", p, n) for p, n in tables], "lang string, phrase string, n long")
    monkeypatch.setattr(phrases, "counts", lambda *_: [t.where("phrase <> 'x y'"), t.where("phrase = 'x y'")])
    r = phrases.phrases(docs(spark, []), longest=2).first()
    assert r.score == 1_000_000 * (big - 7) ** 2 // (big * (big - 1)) and r.n == 2 * big - 1


def test_no_documents_no_phrases(spark):
    assert phrases.phrases(docs(spark, [])).count() == 0


# -- packing --------------------------------------------------------------------


def fewest(items, size):
    items, best = sorted(items, reverse=True), [len(items)]

    def go(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(items):
            best[0] = len(bins)
            return
        for b in {room: n for n, room in enumerate(bins)}.values():
            if bins[b] + items[i] <= size:
                bins[b] += items[i]
                go(i + 1, bins)
                bins[b] -= items[i]
        go(i + 1, [*bins, items[i]])

    go(0, [])
    return best[0]


def counted(items, size):
    return [items.count(x) for x in range(size + 1)]


def test_reduction_keeps_the_optimum():
    rnd, above = random.Random(1), 0
    for _ in range(1500):
        size = rnd.choice([10, 17, 24])
        items = [rnd.randrange(1, size + 1) for _ in range(rnd.randrange(1, 10))]
        own, best = counted(items, size), fewest(items, size)
        bins = packing.Bins(own, size)
        packing.reduced(bins)
        rest = [x for x in range(size + 1) for _ in range(bins.left[x])]
        assert sum(n for _, n in bins.groups) + (fewest(rest, size) if rest else 0) == best
        groups = packing.plan(own, size)
        assert all(sum(g) <= size for g, _ in groups) and Counter(x for g, n in groups for x in g * n) == Counter(items)
        assert packing.lower_bound(own, size) <= best <= sum(n for _, n in groups)
        above += sum(n for _, n in groups) - best
    assert above <= 5


def test_plans_of_large_counts_are_near_the_bound():
    rnd = random.Random(2)
    for own in ([0] + [rnd.randrange(10**6) for _ in range(1024)], counted([min(1024, int(rnd.expovariate(1 / 300)) + 1) for _ in range(3000)], 1024), [0] * 1024 + [10**12], [0, 10**12] + [0] * 1023):
        groups = packing.plan(own)
        assert sum(n for _, n in groups) <= 1.003 * packing.lower_bound(own) + 1
        assert len(packing.slots(groups)["first"]) < 140_000


@functools.cache
def encoder():
    with open(public_tokenizers.path(packing.VOCABULARY), encoding="utf-8") as f:
        return packing.Encoder(f.read())


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.sampled_from(" \n\t\x1c\xa0 ab1'é.ś<|endoftext|>"), max_size=40), min_size=1, max_size=4))
def test_cached_words_have_the_tokenizers_ids(texts):
    path = public_tokenizers.path(packing.VOCABULARY)
    own = Tokenizer.from_file(path)
    own.encode_special_tokens = True
    assert [np.frombuffer(b, "<u4").tolist() for b in encoder().ids(texts)] == [own.encode(t, add_special_tokens=False).ids for t in texts]


@pytest.mark.parametrize("empty", [False, True])
def test_packing_is_whole(spark, empty):
    rnd = random.Random(3)
    rows = [] if empty else [(None, None, "a"), (1, "", None), (1, "", None), (2, "word " * 5000, "b"), *((9, "the very same text", "c") for _ in range(200)), *((i, " ".join("w" * rnd.randrange(1, 9) for _ in range(rnd.randrange(400))), "d") for i in range(20, 90))]
    table = docs(spark, rows).repartition(5)
    out = packing.packed(table, size=64).collect()
    own = Tokenizer.from_file(public_tokenizers.path(packing.VOCABULARY))
    want = Counter()
    for i, text, _ in rows:
        ids = own.encode(text or "", add_special_tokens=False).ids + [2]
        first = (len(ids) - 1) % 64 + 1
        for n, (a, b) in enumerate(zip([0, *range(first, len(ids), 64)], range(first, len(ids) + 1, 64))):
            want[i, n, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes()), tuple(ids[a:b])] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32, tuple(r.ids)) for r in out) == want
    by: dict = {}
    for r in out:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by.values():
        ends = np.cumsum([0] + [n for _, n in sorted(places)])
        assert [a for a, _ in sorted(places)] == list(ends[:-1]) and ends[-1] <= 64
    assert len(by) <= packing.lower_bound(np.bincount([r.length for r in out], minlength=65), 64) + 2 if out else not by
    whole = packing.sequences(packing.packed(table, size=64)).collect()
    assert sum(len(r.ids) for r in whole) == sum(r.length for r in out)


# -- hard negatives ---------------------------------------------------------------


def brute_negatives(rows):
    ok = [(i, lab, [int(np.floor(256 * float(x))) for x in v]) for i, v, lab in rows if i is not None and lab is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    own = {}
    for i, lab, v in ok:
        own[i] = min(own.get(i, (lab, v)), (lab, v))
    out = []
    for a, (label, v) in own.items():
        if a % 50:
            continue
        scores = sorted((-sum(x * y for x, y in zip(v, w)), i, lab) for i, (lab, w) in own.items() if i != a and len(w) == len(v))
        for p, i, _ in [s for s in scores if s[2] == label][:5]:
            fit = [(n, -s) for s, n, lab in scores if lab != label and 50 * -p <= 100 * -s <= 95 * -p]
            out += [(a, i, r, n, -p, s) for r, (n, s) in enumerate(fit[:3], 1)]
    return sorted(out)


def mined(spark, rows, **options):
    table = spark.createDataFrame([(i, v, lab, "x", 1, 2) for i, v, lab in rows], "vec_id long, embedding array<double>, label int, side string, id long, score long")
    return sorted(map(tuple, negatives.hard_negatives(table, F.col("id") % 50 == 0, **options).collect()))


@pytest.mark.parametrize("shard,dims,cells", [((4096, 256), 32, 1 << 31), ((60, 5), 7, 4000)])
def test_negatives_match_brute_force(spark, shard, dims, cells):
    rng = np.random.default_rng(4)
    rows = [(int(i), (0.3 + rng.normal(size=20) * rng.choice([0.1, 1])).tolist(), int(rng.integers(3))) for i in range(0, 3000, 10)]
    rows += [(5000 + i, rows[7][1], i % 3) for i in range(120)]  # copies
    rows += [(50, rows[3][1], 2), (50, rows[3][1], 2), (None, rows[0][1], 1), (9001, None, 1), (9003, [None] * 20, 1), (9004, [float("nan")] * 20, 1), (9005, rows[0][1], None), (9006, [], 1), (9050, [0.0] * 20, 1)]
    rows += [(9100 + i, [1.0 + i, 0.5], i % 2) for i in range(60)]  # another length
    got = mined(spark, rows, shard=shard, dims=dims, cells=cells)
    assert got == brute_negatives(rows) and len(got) > 100


def test_negatives_of_large_components(spark):
    rows = [(i, [1e6 + i * 1e3, -2e6 + i * 77.0, 3.0], i % 3) for i in range(0, 200, 2)] + [(400, [1e300, 1.0, 1.0], 1)]
    assert mined(spark, rows) == brute_negatives(rows[:-1])


@pytest.mark.parametrize("rows", [[], [(1, [1.0], 1)], [(50, [1.0], 1)], [(50, [1.0], 1), (51, [1.0], 2)]])
def test_few_rows_have_no_negatives(spark, rows):
    assert mined(spark, rows) == []
