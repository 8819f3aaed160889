"""Near-duplicate groups against brute force: large groups, chains, equal keys, and nulls."""

import random

import pytest
from pyspark.sql import functions as F

from skrift.llm import dedup
from skrift.llm.shared import pruned, written


def sets_of(text, k):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def groups(rows, k, percent):
    """Row number to the smallest id of its component, by comparing all pairs of distinct sets."""
    own = [frozenset(sets_of(t, k)) for _, t in rows]
    kinds = sorted(set(own) - {frozenset()}, key=sorted)
    up = {s: s for s in kinds}

    def root(s):
        while up[s] is not s:
            s = up[s]
        return s

    for i, a in enumerate(kinds):
        for b in kinds[:i]:
            if 100 * len(a & b) >= percent * len(a | b):
                up[root(a)] = root(b)
    least = {}
    for (i, _), s in zip(rows, own):
        if s and i is not None:
            least[root(s)] = min(i, least.get(root(s), i))
    return [(len(s), least.get(root(s)) if s else i) for (i, _), s in zip(rows, own)]


@pytest.mark.parametrize("k, percent", [(3, 85), (5, 80)])
def test_large_groups_in_small_blocks(spark, monkeypatch, k, percent):
    """A third exact copies, a third near copies of one text, a chain whose ends are far apart, and texts that almost link."""
    monkeypatch.setattr(dedup, "BLOCK", 8)
    rnd = random.Random(6)
    word = lambda: f"w{rnd.randrange(10**6)}"
    base = [word() for _ in range(150)]
    rows = [(i, " ".join(base)) for i in range(100, 160)]
    for i in range(60):
        w = list(base)
        for _ in range(rnd.randrange(5)):
            w[rnd.randrange(len(w))] = word()
        rows.append((200 + i, " ".join(w)))
    chain = [word() for _ in range(150)]
    for i in range(30):
        rows.append((300 + i, " ".join(chain)))
        for _ in range(2):
            chain[rnd.randrange(len(chain))] = word()
    for i in range(60):  # near the threshold, on both sides
        w = list(base)
        for _ in range(rnd.randrange(4, 9)):
            w[rnd.randrange(len(w))] = word()
        rows.append((400 + i, " ".join(w)))
    rows += [(None, " ".join(base)), (None, "alone on its own here with some words"), (1, None), (2, ""), (3, " \t"), (4, "x"), (5, "X"), (100, " ".join(base)), (7, "y " * 5000)]
    rnd.shuffle(rows)
    table = spark.createDataFrame([(i, t, n, "clash") for n, (i, t) in enumerate(rows)], "doc_id long, text string, at long, node string")
    out = dedup.near_duplicates(table, k=k, percent=percent, row_col="at").collect()
    got = {r["at"]: (r.n_shingles, r.component_id) for r in out}
    assert got == dict(enumerate(groups(rows, k, percent)))
    # one row of each group stays, the one with the smallest id, and all without shingles
    kept = {}
    for r in out:
        if r.kept and r.n_shingles:
            kept[frozenset(sets_of(rows[r["at"]][1], k)), r.component_id] = r["at"]
    names = [(r.component_id) for r in out if r.kept and r.n_shingles and r.component_id is not None]
    assert len(names) == len(set(names)) and all(rows[r["at"]][0] == r.component_id for r in out if r.kept)
    assert all(r.kept for r in out if not r.n_shingles)


def test_empty_table(spark):
    table = spark.createDataFrame([], "doc_id long, text string")
    assert dedup.near_duplicates(table).collect() == []


def test_pruned_loses_no_wanted_row(spark):
    table = spark.range(20_000).withColumn("v", F.col("id") * 2)
    wanted = written(table.where("id % 50 = 0").select("id"), "wanted")
    left = pruned(table, "id", wanted)
    assert left.columns == table.columns and left.join(wanted, "id").count() == 400
    assert left.count() < 5_000
    assert pruned(table, "id", written(table.limit(0).select("id"), "none")).count() == 0
