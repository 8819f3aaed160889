"""Cross-polytope search: recall on the embeddings table, share of candidates, small and awkward tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from skrift.llm import ann


def exact(ids, x, k):
    y = x / np.abs(x).max(axis=1)[:, None]
    y = y / np.linalg.norm(y, axis=1)[:, None]
    out = {}
    for q in np.flatnonzero(ids % 50 == 0):
        s = y @ y[q]
        out[int(ids[q])] = [int(ids[i]) for i in sorted((i for i in range(len(ids)) if i != q), key=lambda i: (-round(float(s[i]), 12), ids[i]))[:k]]
    return out


def test_recall_on_the_embeddings_table(spark):
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = table.select("vec_id", "embedding").collect()
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float)
    want = exact(ids, x, 5)
    got: dict[int, list] = {}
    for r in ann.nearest(table, F.col("vec_id") % 50 == 0).collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
        a, b = x[ids == r.query_id][0], x[ids == r.vec_id][0]
        assert abs(r.score - a @ b / np.linalg.norm(a) / np.linalg.norm(b)) < 1e-12
    assert set(got) == set(want) and all(len(v) == 5 for v in got.values())
    assert sum(len(set(got[q]) & set(want[q])) for q in want) >= 0.9 * 5 * len(want)


def clustered(n, size, spread, seed=0):
    """Queries, their 5 nearest, and rows about centres."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n // 6, 1, size)) + spread * rng.normal(size=(n // 6, 6, size))
    x = x.reshape(-1, size)
    y = x / np.linalg.norm(x, axis=1)[:, None]
    at = rng.choice(len(x), 60, replace=False)
    s = y[at] @ y.T
    s[np.arange(60), at] = -2
    return x, at, np.argsort(-s, axis=1)[:, :5]


@pytest.mark.parametrize("hashes,spread", [(2, 0.5), (3, 0.35), (4, 0.2)])
def test_recall_of_two_to_four_rotations(hashes, spread):
    """Fitted on one half of the queries, measured on the other."""
    x, at, near = clustered(6000, 64, spread)
    hasher, probes = ann.fitted(ann.scaled(x[at[:30]]), ann.scaled(x[near[:30].ravel()]).reshape(30, 5, -1), ann.scaled(x[:1000]), len(x), hashes=(hashes,))
    assert hasher.hashes == hashes
    met = ann.first_probes(hasher, ann.scaled(x[at[30:]]), ann.scaled(x[near[30:].ravel()]).reshape(30, 5, -1), probes) < probes
    assert met.mean() >= 0.9
    assert (ann.first_probes(hasher, ann.scaled(x[at[30:]]), ann.scaled(x), probes) < probes).mean() < {2: 0.25, 3: 0.12, 4: 0.05}[hashes]


def test_rotations_that_miss_too_much_are_not_taken():
    x, at, near = clustered(3000, 32, 9.0)
    hasher, probes = ann.fitted(ann.scaled(x[at]), ann.scaled(x[near.ravel()]).reshape(60, 5, -1), ann.scaled(x[:500]), 10**9, hashes=(4,), probes=2)
    assert (hasher.hashes, probes) == (1, 64)  # every axis: all rows


def test_candidates_shrink_as_tables_grow():
    """The nearer the neighbours, as in larger tables, the smaller the share of rows that are candidates."""
    shares = []
    for spread in (1.5, 0.7, 0.3):
        x, at, near = clustered(6000, 64, spread)
        hasher, probes = ann.fitted(ann.scaled(x[at]), ann.scaled(x[near.ravel()]).reshape(60, 5, -1), ann.scaled(x[:1000]), 10**7)
        shares.append((ann.first_probes(hasher, ann.scaled(x[at]), ann.scaled(x[:2000]), probes) < probes).mean())
    assert shares[0] > shares[1] > shares[2] and shares[2] < 0.02


def test_blocks_do_not_change_results(spark, monkeypatch):
    table = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    one = sorted(map(tuple, ann.nearest(table, F.col("vec_id") % 50 == 0).collect()))
    monkeypatch.setattr(ann, "ROWS", 3)
    monkeypatch.setattr(ann, "ASKED", 2)
    assert sorted(map(tuple, ann.nearest(table, F.col("vec_id") % 50 == 0).collect())) == one


@pytest.mark.parametrize("n", [0, 1, 4, 30])
def test_small_tables_give_all_candidates(spark, n):
    rng = np.random.default_rng(n)
    x = rng.normal(size=(n, 100))
    if n > 20:
        x[3:18] = x[3]
    rows = [(i * 10, [float(v) for v in r], "clash", 1) for i, r in enumerate(x)]
    rows += rows[:1] + [(70, None, "", 1), (71, [0.0] * 100, "", 1), (72, [float("nan")] * 100, "", 1), (None, [1.0] * 100, "", 1), (73, [1.0], "", 1), (74, [1.0, None] * 50, "", 1), (76, [float("inf")] * 100, "", 1)] if n else []
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, class string, rank int")
    got: dict[int, list] = {}
    for r in sorted(ann.nearest(table, F.col("vec_id") % 50 == 0).collect(), key=lambda r: r["rank"]):
        got.setdefault(r.query_id, []).append(r.vec_id)
    want = exact(np.arange(n) * 10, x, 5) if n else {}
    assert got == {q: v for q, v in want.items() if v}


def nearest_of(spark, rows):
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got: dict[int, list] = {}
    for r in sorted(ann.nearest(table, F.col("vec_id") % 50 == 0).collect(), key=lambda r: r["rank"]):
        got.setdefault(r.query_id, []).append(r.vec_id)
    return got


def test_every_length_is_searched(spark):
    rng = np.random.default_rng(8)
    parts = {size: (start + np.arange(n) * 10, rng.normal(size=(n, size))) for size, start, n in ((3, 0, 9), (20, 1000, 200), (1, 5000, 6), (24, 10_000, 150))}
    rows = [(int(i), v.tolist()) for ids, x in parts.values() for i, v in zip(ids, x)]
    rows += [(90_000 + i, []) for i in range(400)] + [(91_000 + i, [float("nan")] * 5) for i in range(400)] + [(92_000 + i, [0.0] * 6) for i in range(400)]
    got, want = nearest_of(spark, rows), {}
    for ids, x in parts.values():
        want |= exact(ids, x, 5)
    assert set(got) == set(want) and all(len(got[q]) == len(want[q]) for q in want)
    assert sum(len(set(got[q]) & set(want[q])) for q in want) >= 0.9 * sum(map(len, want.values()))


def test_large_and_small_components(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(40, 8)) * 10.0 ** rng.choice([-200, -3, 0, 5, 200], size=(40, 1))
    assert nearest_of(spark, [(i * 10, v.tolist()) for i, v in enumerate(x)]) == exact(np.arange(40) * 10, x, 5)
