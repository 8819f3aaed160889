import random

import pyarrow as pa
from pyspark.sql import functions as F

from skrift.functions import text as T
from skrift.functions.counts import MatchWords
from skrift.operators import search as S
from skrift.operators import sections as X
from skrift.sources import elements as N
from skrift.sources import motions as M
from skrift.sources import propositions as B
from skrift.tables import BATCH_BYTES


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_bills_are_read_without_a_shuffle(spark):
    page = "<html><title> Lag <b>1</b></title><body><p>Regeringens proposition 2023/24:9</p><p> Propositionens huvudsakliga innehåll </p><p>kort text.</p><p>Innehållsförteckning</p>{}<p>slut</p>"
    files = spark.createDataFrame([("a.html", page.format("")), ("b.html", page.format("<p>x</p>" * 50)), ("c.html", page.replace("/24:9", "/24:1").format("")), ("x031d1.html", page.format("")), ("d.html", None)], "file string, html string")
    found = B.texts(files, limit=260)
    assert "Exchange" not in plan(found)
    rows = {r.file: r for r in found.collect()}
    assert {f: r.whole for f, r in rows.items()} == {"a.html": False, "b.html": False, "c.html": True, "x031d1.html": True, "d.html": True}
    assert rows["a.html"].title == "Lag 1" and rows["c.html"].text.endswith("\nInnehållsförteckning\nslut\n") and rows["d.html"].text == "\n\n"


def test_paragraphs_of_many_lines(spark):
    lines = ["Första raden,", "andra raden", "tredje", "Fjärde.", "Femte -", "Sjätte", "x" * 95, "Sjunde", "12,5", "åttonde av-", "", " nionde"]
    rows = spark.createDataFrame([("\n".join(lines),), (None,), ("",), ("ord " * 3 + "\n" + "rad\n" * 30_000,)], "text string")
    found = [r.p for r in rows.select(X.paragraphs(F.col("text")).alias("p")).collect()]
    assert found[:3] == [["Första raden, andra raden tredje", "Fjärde.", "Femte - Sjätte " + "x" * 95 + " Sjunde åttonde avnionde"], None, []]
    assert len(found[3]) == 1 and len(found[3][0]) == len("ord ord ord") + 4 * 30_000


def test_few_hits_go_to_the_passages(spark):
    own = spark.range(50).select(F.col("id").alias("pid"), F.repeat(F.lit("x"), 9).alias("text"))
    hits = spark.createDataFrame([(1, 3, 1), (1, 7, 2)], "qid long, pid long, rank int")
    found = S.met(hits, own)
    assert "BroadcastHashJoin" in plan(found) and "SortMergeJoin" not in plan(found) and "Exchange hash" not in plan(found)
    assert sorted(map(tuple, found.collect())) == [(1, 3, 1, "x" * 9), (1, 7, 2, "x" * 9)]


def test_motions_are_read_once_without_a_shuffle(spark):
    rnd = random.Random(8)
    words = "skog skogen skogarna vargjakt och att havet fiskens x1 12 riksdagen motionen Östersjön ÅKER".split()
    some = lambda n: " ".join(rnd.choice(words) for _ in range(rnd.randrange(n)))
    pages, want = {}, {}
    for page in range(30):
        asks, parts = [some(6) for _ in range(rnd.randrange(5))], [[some(9) for _ in range(rnd.randrange(3))] for _ in range(rnd.randrange(6))]
        section = "".join(f"<h2>Del <b>{n}</b></h2>" + "".join(f"<div><p>{p}</p></div><li><p>skogen havet</p></li><p class='Yrkande'> </p>" for p in part) for n, part in enumerate(parts))
        pages[page] = f"<span class='a sidhuvud_beteckning'> 2024/25:<i> {page} </i></span>" + "".join(f"<li class=Frslagstext>{a}</li></b>" for a in asks) + f"<div class=Section1><p>{some(9)}</p>{section}</div><h2>Utanför</h2><p>{' '.join(words)}</p>"
        for nr, ask in enumerate([a for a in asks if a], 1):
            own, best = MatchWords().of(ask), (0, None)
            for n, part in enumerate(parts):
                both = len(own & MatchWords().of(" ".join(part)))
                best = (both, n) if both > best[0] else best
            score = best[0] / len(own) if own else 0.0
            good = best[1] is not None and score >= 0.5
            want[page, nr] = (ask, score, f"Del {best[1]}" if good else "", " ".join(p for p in parts[best[1]] if p) if good else "", f"2024/25:{page}:yrkande:{nr}")
    files = spark.createDataFrame([*pages.items(), (99, None), (98, ""), (97, "<![bad<p class='Yrkande'>x</p>")], "file long, html string")
    found = M.records(files)
    assert "Exchange" not in plan(found) and plan(found).count("MapInArrow") == 1
    rows = {(r.file, r.yrkande_nr): (r.text, r.match_score, r.heading, r.sektion_text, r.chunk_id) for r in found.collect()}
    assert rows == want and len(want) > 20


def test_elements_that_are_not_closed_share_their_strings(spark):
    strings, own = N.page_outline("<ul><li>a<p class='x y'>b<p>c</ul>d" + "<p>e" * 20_000, lambda tag, classes: tag == "p", {"li"})
    assert strings[:4] == ["a", "b", "c", "d"] and len(strings) == 20_004 and len(own) == 20_002
    assert [(e[2:]) for e in own[:3]] == [("p", ["x", "y"], True, 2, 2), ("p", [], True, 3, 1), ("p", [], False, 5, 20_000)] and own[-1][5:] == (20_004, 1)
    rows = N.outlines(spark.createDataFrame([(1, "<p>a"), (2, None), (3, "b")], "id long, html string"), lambda tag, classes: tag == "p").collect()
    assert [(r.id, r.strings, [e.n for e in r.elements]) for r in rows] == [(1, ["a"], [1]), (2, [], []), (3, ["b"], [])]


def test_words_that_match_are_those_of_the_columns(spark):
    rnd = random.Random(9)
    texts = ["".join(rnd.choice("aåÄÖeErRnas tdiIİK0é-\n") for _ in range(40)) for _ in range(300)] + ["", " ", "Riksdagen ÄR och Skogarnas ERNA lerna"]
    known = MatchWords()
    for r in spark.createDataFrame([(t,) for t in texts], "text string").select("text", T.match_words(F.col("text")).alias("w")).collect():
        assert known.of(r.text) == set(r.w)


def test_pages_meet_python_in_batches_that_are_bounded_by_bytes(spark):
    held = spark.conf.get(BATCH_BYTES, None)
    spark.conf.unset(BATCH_BYTES)
    try:
        page = "<p>Regeringens proposition 2023/24:9</p><p>Propositionens huvudsakliga innehåll</p>" + "<p>rad</p>" * 1000 + "<p>" + "x" * 400_000
        files = spark.range(0, 40, 1, 1).select(F.concat(F.col("id").cast("string"), F.lit(".html")).alias("file"), F.concat(F.lit(page), F.col("id").cast("string")).alias("html"))
        read = B.texts(files).select("file", F.length("text").alias("n"))
        sizes = files.mapInArrow(lambda batches: (pa.record_batch({"n": [b.num_rows], "size": [b.nbytes]}) for b in batches), "n long, size long").collect()
        assert sum(r.n for r in sizes) == 40 and max(r["size"] for r in sizes) < 6_000_000
        assert read.agg(F.count("*"), F.countDistinct("file"), F.min("n")).first()[:] == (40, 40, 404_074)
    finally:
        spark.conf.unset(BATCH_BYTES)
        if held:
            spark.conf.set(BATCH_BYTES, held)
    whole = pa.record_batch({"file": [str(n) for n in range(40)], "cut": [False] * 40, "html": [page] * 40})
    back = list(B._texts(100)([whole]))
    assert sum(b.num_rows for b in back) == 40 and max(b.nbytes for b in back) < 2 * B.CHARS + 2 * len(page)


def test_strings_are_those_of_the_rows():
    rnd = random.Random(4)
    bits = ["<p>", "</p>", "<P>", "<p", "<b>x", "</b>", "<title>", "</title>", "<title/>", "<script>", "</script>", "<style>p {} ", "</style>", "<template>", "</template>", "<br>", "</br>", "<br/>", "<p/>", "<p class='a>b'>"]
    bits += ["&amp;", "&lt", "&", " text ", "\x1f\n", "<!-- c", "-->", "<![bad", "<!doctype x>", "<?pi>", "</>", "</ p>", "<", ">", "<div>", "</div >", "<li>", "</span>", "<textarea>", "<p>>"]
    for _ in range(3000):
        html = "".join(rnd.choice(bits) for _ in range(rnd.randrange(30)))
        rows = sorted(N._page_rows(html), key=lambda row: row[0])
        titles = [row for row in rows if row[3] == "title"]
        texts = [row for row in rows if row[3] == "#text"]
        want = [row[6] for row in texts], [i for i, row in enumerate(texts) if any(t[0] < row[0] < t[1] for t in titles)]
        assert N.page_strings(html) == want, html


def test_lines_are_stripped_as_by_the_columns(spark):
    rnd = random.Random(5)
    bits = [*X.SPACE, "\x1c", "\x1f", "\u180e", "\u200b", "\ufeff", "a", "B", "12", "٣", "−", "%", "Prop.", "Prop. 2023/24:1", "Utgiftsområde 9", "av- ", ".", ",", "\n"]
    texts = ["".join(rnd.choice(bits) for _ in range(rnd.randrange(25))) for _ in range(2000)]
    lines = F.filter(F.transform(F.split("text", "\n"), lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", "")), lambda x: (x != "") & ~x.rlike(X.NOISE))
    for r in spark.createDataFrame([(t,) for t in texts], "text string").select("text", lines.alias("lines"), X.folded(F.col("text")).alias("own"), X.paragraphs(F.col("text")).alias("p")).collect():
        assert r.own == X.fold_lines(r.lines) and len(r.p) == len(r.own)


def test_files_of_one_bill_count_once(spark):
    page = "<title>{}</title><p>Regeringens proposition 2023/24:{}</p><p>Propositionens huvudsakliga innehåll</p><p>{}</p><p>Innehållsförteckning</p><p>1</p>"
    budget = "<p>1.{n}</p><p>Reformer nu</p><p>" + "Skatten sänks för alla. " * 9 + "</p>"
    files = [("c.html", page.format("C", 7, "tredje")), ("b.html", page.format("B", 7, "andra")), ("a.html", "<p>Regeringens proposition 2023/24:7</p>"), ("e.html", page.format("E", 1, "x") + budget.format(n=2) + budget.format(n=3)), ("f.html", page.format("F", 1, "x") + budget.format(n=2)), ("d.html", page.format("D", 8, "12"))]
    rows = sorted((r.chunk_id, r.file, r.doc_title, r.heading, r.text[:7]) for r in B.records(B.texts(spark.createDataFrame(files, "file string, html string"))).collect())
    of = "Propositionens huvudsakliga innehåll"
    B.texts(spark.createDataFrame(files, "file string, html string")).count()  # the function goes to the workers again after UDFs have run
    assert rows == [("prop:2023/24:1:0", "e.html", "E", "Reformer nu", "Skatten"), ("prop:2023/24:1:1", "e.html", "E", "Reformer nu", "Skatten"), ("prop:2023/24:7:0", "b.html", "B", of, "andra"), ("prop:2023/24:8:0", "d.html", "D", of, "")]
