"""The append log: order, retries, two writers, compaction."""

import json

import pytest

from skrift.sources import log as G
from skrift.sources import motions as M

KIND = "config string, id long, answer string"


def rows(spark, *own):
    return spark.createDataFrame(list(own), KIND)


def test_order_retry_and_compaction(spark, tmp_path):
    folder = f"file://{tmp_path}/log"
    assert G.read(spark, folder, KIND).count() == 0
    with pytest.raises(FileNotFoundError):
        G.read(spark, folder)
    assert G.append(rows(spark, *[("a", i, f"first {i}") for i in range(40)]).repartition(5), folder, "one", ["id"]) == 40
    assert G.append(rows(spark, ("a", 3, "new"), ("b", 3, None), ("a", 3, "newer")).coalesce(1), folder, "two") == 3
    assert G.append(rows(spark, ("a", 3, "new"), ("b", 3, None)), folder, "two") == 0
    log = G.read(spark, folder)
    assert sorted((r.seq, r.id, r.answer) for r in log.collect()) == [*((i, i, f"first {i}") for i in range(40)), (40, 3, "new"), (41, 3, None), (42, 3, "newer")]
    last = {(r.config, r.id): (r.seq, r.answer) for r in G.latest(log, ["config", "id"]).collect()}
    assert last["a", 3] == (42, "newer") and last["b", 3] == (41, None) and last["a", 5] == (5, "first 5") and len(last) == 41
    assert G.compact(spark, folder, ["config", "id"]) and not G.compact(spark, folder, ["config", "id"])
    assert {(r.config, r.id): (r.seq, r.answer) for r in G.read(spark, folder).collect()} == last
    # names outlive compaction, numbers go on
    assert G.append(rows(spark, ("c", 1, "x")), folder, "one") == 0 and G.append(rows(spark, ("c", 1, "x")), folder, "three") == 1
    assert G.read(spark, folder).where("config = 'c'").first().seq == 43
    assert G.append(rows(spark), folder, "none") == 0 and G.read(spark, folder).count() == 42


def test_saved_pages_are_read_once(spark, tmp_path):
    pages, folder, state = tmp_path / "pages", f"file://{tmp_path}/log", f"{tmp_path}/state"
    pages.mkdir()
    spark.dataSource.register(M.SavedPages)

    def saved(name, *docs):
        (pages / f"{name}.json").write_text(json.dumps({"documents": [dict(zip(("rm", "beteckning", "subtyp"), d)) for d in docs]}))

    def run():
        M.subtype_stream(spark, str(pages), folder, state).awaitTermination()
        return sorted((r.page, r.beteckning, r.subtyp) for r in G.read(spark, folder).collect())

    saved("2022-001", ("2022/23", "1", "Enskild motion"), ("2022/23", "2"))
    saved("2022-002")
    first = run()
    assert first == [("2022-001.json", "1", "Enskild motion"), ("2022-001.json", "2", "")] and run() == first
    saved("2023-001", ("2022/23", "2", "Partimotion"))
    assert run() == [*first, ("2023-001.json", "2", "Partimotion")]
    assert {r.beteckning: r.subtyp for r in G.latest(G.read(spark, folder), ["rm", "beteckning"]).collect()} == {"1": "Enskild motion", "2": "Partimotion"}


def test_two_writers_of_one_number(spark, tmp_path, monkeypatch):
    folder = f"file://{tmp_path}/log"
    G.append(rows(spark, ("a", 1, "x")), folder, "one")
    made, other = G._committed, []

    def late(own, where, commit):
        if not other:  # someone commits first
            other.append(1)
            made(own, where, commit | {"name": "theirs", "n": 5})
        return made(own, where, commit)

    monkeypatch.setattr(G, "_committed", late)
    assert G.append(rows(spark, ("a", 2, "y")), folder, "two") == 1
    assert [(c["number"], c["name"], c["first"]) for c in G.commits(spark, folder)] == [(0, "one", 0), (1, "theirs", 1), (2, "two", 6)]
