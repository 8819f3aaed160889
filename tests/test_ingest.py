"""Sources over generated files: motions, bills, programmes and sites."""

import gzip

import pytest
from pyspark.sql import functions as F

from skrift.functions.split import split_text
from skrift.sources import layers as L
from skrift.sources import motions as M
from skrift.sources import programs as P
from skrift.sources import propositions as B
from skrift.sources import sites as Y
from skrift.sources import elements as N

MOTION = """<html><head><style>p {{}}</style></head><body><span class="sidhuvud_beteckning">2024/25:{nr}</span><span class="MotionarLista">av Anna Alm m.fl. (båda C)</span>
<h1>Skog&shy;ens\xa0skydd</h1><ol><li class="Frslagstext">Riksdagen ställer sig bakom att gammelskogen skyddas bättre.</li></ol>
<div class="Section1"><h1>Skog&shy;ens skydd</h1><p class="Rubrik1numrerat">Gammelskog</p><p>Gammelskogen skyddas sällan.</p><p>Den behöver <b>bättre</b> skydd.</p>
<p class="Yrkande">Vargjakt bör bedrivas året om i hela landet.</p><h2>Havet</h2><p>Fisket minskar i Östersjön.</p><ul><li><p>utanför</p></li></ul></div>
<p class="Underskrifter">Anna Alm (C)</p><p class="Underskrifter"> </p><p class="Underskrifter">Bo Berg (C)</p></body></html>"""


def test_elements_are_forgiving(spark):
    pages = spark.createDataFrame([(1, "<div>a<p>b<br>c<p class='x y'>d</div><script>no</script>e<!-- f --></b>"), (2, None), (None, "")], "id long, html string")
    rows = N.elements(pages).collect()
    assert {r.id for r in rows} == {1}
    assert "".join(r.text for r in sorted(rows, key=lambda r: r.start) if r.tag == "#text") == "abcde"
    own = N.strings(N.elements(pages), ["id"], F.col("tag").isin("p", "div", "br"))
    assert [(r.tag, r.strings, r.classes) for r in sorted(own.collect(), key=lambda r: r.start)] == [("div", ["a", "b", "c", "d"], []), ("p", ["b", "c", "d"], []), ("br", [], []), ("p", ["d"], ["x", "y"])]
    held = {(r.tag, r.text): r.within for r in N.inside(N.elements(pages), ["id"], F.col("tag") == "p", "within").collect()}
    assert held["#text", "d"] and held["br", None] and not held["#text", "a"] and not held["#text", "e"]


def test_motions(spark, tmp_path):
    (tmp_path / "deep").mkdir()
    (tmp_path / "a.html").write_text(MOTION.format(nr="12"), encoding="utf-8")
    (tmp_path / "deep" / "b.html").write_bytes(MOTION.format(nr="13").encode() + b"\xff")
    (tmp_path / "c.html").write_text("<p>nothing</p>")
    out = M.build(spark, f"file://{tmp_path}", f"file://{tmp_path}/out")
    assert out == {"files": 3, "records": 4, "uncertain": 2, "by_party": {"C": 4}}
    rows = L.layer(spark, "motion", f"file://{tmp_path}/out").orderBy("chunk_id").collect()
    assert [r.chunk_id for r in rows] == ["2024/25:12:yrkande:1", "2024/25:12:yrkande:2", "2024/25:13:yrkande:1", "2024/25:13:yrkande:2"]
    first, second = rows[:2]
    assert (first.doc_title, first.parti, first.undertecknare, first.forste_undertecknare) == ("Skogens skydd", "C", "Anna Alm (C);Bo Berg (C)", "av Anna Alm m.fl. (båda C)")
    assert first.heading == "Gammelskog" and first.sektion_text == "Gammelskogen skyddas sällan. Den behöver bättre skydd." and first.match_score >= 0.5
    assert second.text.startswith("Vargjakt") and second.heading == second.sektion_text == "" and second.match_score == 0
    (tmp_path / "empty").mkdir()
    with pytest.raises(FileNotFoundError):
        M.build(spark, f"file://{tmp_path}/empty", f"file://{tmp_path}/out2")


def test_deep_and_broken_motions(spark):
    files = spark.createDataFrame([("a", "<div class='Section1'>" + "<p>" * 2000), ("b", "<![bad<p class='Yrkande'>x</p>"), ("c", None)], "file string, html string")
    assert M.records(files).count() <= 1


def test_subtypes_of_paged_listings(spark, tmp_path):
    pages = {("2022/23", None): ([{"rm": "2022/23", "beteckning": "1", "subtyp": "Enskild motion"}], "two"), ("2022/23", "two"): ([{"rm": "2022/23", "beteckning": "2"}], None), ("2023/24", None): ([], None)}
    got = M.subtype_pages(spark, ["2022/23", "2023/24"], lambda s, p: pages[s, p])
    assert sorted(map(tuple, got.collect())) == [("2022/23:1", "Enskild motion"), ("2022/23:2", "")]
    assert L.subtypes(spark, f"file://{tmp_path}/none.json").collect() == []


def html(title, lines):
    return f"<html><head><title>{title}</title></head><body>" + "".join(f"<p>{x}</p>" for x in lines) + "</body></html>"


LONG = "Regeringen bedömer att fler behöver få stöd i hela landet och att insatserna ska följas upp varje år framöver."
MORE = "Därför avsätts medel för skolor, vård och omsorg i kommuner och regioner, vilket stärker välfärden på lång sikt."


def test_bills(spark, tmp_path):
    head = lambda nr, pm="Ulf K": [f"Regeringens proposition 2023/24:{nr}", pm, "Stockholm den 5 oktober 2023"]
    files = {
        "a.html": html("En lag", [*head(30), "Propositionens huvudsakliga innehåll", LONG + " Hus-", "hållen får mer.", "Prop. 2023/24:30", "12", "Innehållsförteckning", "1"]),
        "b.html": html("Dubblett", [*head(30), "Propositionens huvudsakliga innehåll", LONG, "Innehållsförteckning", "1"]),
        "c.html": html("Gammal", [*head(3, "Magdalena Andersson"), "Propositionens huvudsakliga innehåll", LONG, "Innehållsförteckning", "1"]),
        "d.html": html("TEST", [*head(4), "Propositionens huvudsakliga innehåll", LONG, "Innehållsförteckning", "1"]),
        "e.html": html("Budget", [*head(1), "1.1", "Inledning om ekonomin", LONG, MORE, "1.2", "Annat", LONG, MORE, "1.4", "Reformer för välfärden", "Skola", LONG, MORE, "1 234 5 678 9 012", "Vård", "Kort.", "1.1", "Bilaga", LONG, MORE]),
        "x031d5.html": html("V", ["Prop. 2023/24:1", "Utgiftsområde 9 Hälsovård och omsorg", "Stockholm den 5 oktober 2023", "3.1", "Förslag om tandvård", "bakgrund " * 30, "3.1.1", "Detalj", "Regeringens förslag:", LONG, MORE, "Skälen för regeringens förslag", "skäl " * 40, "3.2", "Politikens inriktning", "Vården", LONG, MORE, "3.3", "Övrigt", LONG]),
        "y031d6.html": html("V", ["Prop. 2023/24:1", "Utan område"]),
    }
    for name, text in files.items():
        (tmp_path / name).write_text(text, encoding="utf-8")
    B.build(spark, f"file://{tmp_path}", f"file://{tmp_path}/out")
    rows = {r.chunk_id: r for r in L.layer(spark, "proposition", f"file://{tmp_path}/out").collect()}
    assert set(rows) == {"prop:2023/24:30:0", "prop:2023/24:1:0", "prop:2023/24:1:1", "prop:2023/24:1:uo9:0", "prop:2023/24:1:uo9:1"}
    bill = rows["prop:2023/24:30:0"]
    assert (bill.file, bill.doc_title, bill.datum, bill.parti) == ("a.html", "En lag", "5 oktober 2023", "M;KD;L")
    assert bill.heading == "Propositionens huvudsakliga innehåll" and bill.text == LONG + " Hushållen får mer."
    assert rows["prop:2023/24:1:0"].heading == "Inledning om ekonomin" and rows["prop:2023/24:1:1"].heading == "Skola"
    assert rows["prop:2023/24:1:1"].text == f"{LONG}\n\n{MORE}"
    area = rows["prop:2023/24:1:uo9:0"]
    assert area.doc_title == "Budgetpropositionen för 2024, utgiftsområde 9 Hälsovård och omsorg" and area.heading == "Förslag om tandvård"
    assert area.text == f"{LONG}\n\n{MORE}" and rows["prop:2023/24:1:uo9:1"].heading == "Politikens inriktning – Vården"


def test_large_bills_are_read_whole_only_if_their_head_lacks_the_summary(spark):
    text = html("T", ["Regeringens proposition 2023/24:30", "Propositionens huvudsakliga innehåll", LONG, "Innehållsförteckning", "1"])
    late = html("T", ["x" * 900, "Regeringens proposition 2023/24:31", "Propositionens huvudsakliga innehåll", LONG, "Innehållsförteckning", "1"])
    files = spark.createDataFrame([("a.html", text + "<p>" + "y" * 2000), ("b.html", late)], "file string, html string")
    out = {r.file: r for r in B.texts(files, 700).collect()}
    assert not out["a.html"].whole and out["b.html"].whole and "2023/24:31" in out["b.html"].text


def spans(rows):
    return [("f/p.pdf", page, block, line, 0, font, size, flags, text) for page, block, line, font, size, flags, text in rows]


def test_programmes(spark):
    body, head = ("Serif", 10.0, 0), ("Sans", 14.0, 0)
    rows = [(1, 0, 0, *head, "Innehåll"), (1, 1, 0, *body, "Kapitel ett .... 2")]
    rows += [(2, 0, 0, *head, "Frihet och"), (2, 0, 1, *head, "ansvar"), (2, 1, 0, "Serif", 40.0, 0, "V"), (2, 1, 1, *body, "i tror på demo-"), (2, 1, 2, *body, "krati och arbets-"), (2, 1, 3, *body, "och familjeliv " + "i hela landet " * 6)]
    rows += [(2, 2, 0, *head, "ett citat som upprepar."), (2, 3, 0, *body, "12"), (2, 4, 0, *body, "Nästa stycke " * 8), (2, 4, 1, *head, "Miljö"), (2, 4, 2, *body, "Miljön ska skyddas " * 6)]
    rows += [(3, 0, 0, *head, "Del"), (3, 1, 0, *head, "2.1 Klimat"), (3, 2, 0, "GillSansProforRiksdag", 10.0, 0, "Klim atet är viktigt​ " * 5), (3, 3, 0, "Serif-Bold", 10.0, 16, "Fetstil"), (3, 4, 0, *body, "Slut " * 30), (3, 5, 0, "Serif", 5.0, 0, "liten text")]
    table = spark.createDataFrame(spans(rows), P.SPANS)
    out = [tuple(r)[2:] for r in P.sections(table).orderBy("nth").collect()]
    assert [(h, p) for h, p, _ in out] == [("Frihet och ansvar", 2), ("Miljö", 2), ("2.1 Klimat", 3), ("Fetstil", 3)]
    assert out[0][2].startswith("Vi tror på demokrati och arbets- och familjeliv i hela") and "\n\nNästa stycke" in out[0][2] and "citat" not in out[0][2]
    assert "Klimatet är viktigt" in out[2][2] and "liten" not in out[3][2]
    got = P.records(table, [("p.pdf", "S", "partiprogram", 2025)]).collect()
    assert [r.chunk_id for r in got] == [f"S:program:{i}" for i in range(4)] and got[0].year == 2025
    assert P.word_totals(P.records(table, [("p.pdf", "S", "partiprogram", 2025)])).first().sections == 4


def test_agreement_sections_have_their_project(spark):
    head, body = ("Sans", 14.0, 0), ("Serif", 10.0, 0)
    rows = [(1, 0, 0, *body, "Direktiv samarbetsprojekt"), (1, 0, 1, *body, "Tillväxt"), (2, 0, 0, *head, "1. Inledning"), (2, 1, 0, *body, "ram " * 50), (3, 0, 0, *head, "Skatter"), (3, 1, 0, *body, "sänks " * 50)]
    out = P.records(spark.createDataFrame(spans(rows), P.SPANS), [("p.pdf", "M;KD;L;SD", "Tidöavtalet", 2022)], "p.pdf").collect()
    # the title page is a section without a heading, the frame is gone
    assert [(r.heading, r.text.split()[0]) for r in out] == [("Tillväxt: ", "Direktiv"), ("Tillväxt: Skatter", "sänks")]


def test_programme_headings(spark):
    texts = [("2.1 Klimat.", True), ("Vi vill.", False), ("litet", False), ("X" + "x" * 90, False), ("7", False), ("Å", False), ("Öar", True)]
    out = spark.createDataFrame(texts, "t string, want boolean").select(P.reads_as_heading(F.col("t")).alias("got"), "want").collect()
    assert all(r.got == r.want for r in out)
    parts = [(["Del", "Två"], "Del Två"), (["Del", "2.1 Klimat", "Mer"], "2.1 Klimat Mer"), (["a" * 70, "b" * 70], "b" * 70), ([], "")]
    out = spark.createDataFrame(parts, "p array<string>, want string").select(P.merged_heading(F.col("p")).alias("got"), "want").collect()
    assert all(r.got == r.want for r in out)


SITE = Y.Site("T", "Testpartiet", r"^https://t\.se/politik/[^/]+/?$", "https://t.se/index.xml", ("https://t.se/a-o/",))
PAGE = "<html><head><title>{t}</title></head><body><nav>meny</nav><article><p>{b}</p></article><p>När du besöker en webbplats kan den lagra kakor</p></body></html>"


def test_sites(spark, tmp_path):
    web = {
        "https://t.se/index.xml": b'\xef\xbb\xbf\n<?xml version="1.0"?><sitemapindex xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"><sitemap><loc>https://t.se/1.xml.gz</loc></sitemap><sitemap><loc>https://t.se/gone.xml</loc></sitemap></sitemapindex>',
        "https://t.se/1.xml.gz": gzip.compress(b"<urlset><url><loc>https://t.se/politik/skola</loc><lastmod>2024-05-06T07:08</lastmod></url><url><loc>https://t.se/annat/x</loc></url><url><loc>https://t.se/politik/kort/</loc></url></urlset>"),
        "https://t.se/a-o/": '<a href="/politik/skola#x">Skola  och <b>barn</b></a><a href="/politik/skola">Utbildning</a><a href="../politik/vard-och-omsorg"></a><a href="/politik/borta">Borta</a>'.encode(),
        "https://t.se/politik/skola": PAGE.format(t="Skolan", b="Skolan ska bli bättre. " * 20).encode(),
        "https://t.se/politik/kort/": PAGE.format(t="K", b="kort").encode(),
        "https://t.se/politik/vard-och-omsorg": PAGE.format(t="", b="Vården ska bli bättre. " * 20).encode(),
    }
    waits = []
    found = {r.url.rsplit("/politik/")[-1]: r for r in Y.discover(spark, SITE, web.__getitem__, waits.append).collect()}
    assert list(found) == ["borta", "kort/", "skola", "vard-och-omsorg"] and waits == [1.0] * 3
    assert (found["skola"].lastmod, found["skola"].labels, found["skola"].sources) == ("2024-05-06", ["Skola och barn", "Utbildning"], ["sitemap", "index"])
    assert found["vard-och-omsorg"].sources == ["index"] and found["vard-och-omsorg"].labels == []
    index = Y.fetch(spark, SITE, str(tmp_path), web.__getitem__, waits.append)
    assert [p["slug"] for p in index["pages"]] == ["kort", "skola", "vard-och-omsorg"]
    asked = []
    Y.fetch(spark, SITE, str(tmp_path), lambda u: asked.append(u) or web[u], waits.append)
    assert not any(u in asked for u in ("https://t.se/politik/skola",)) and "https://t.se/politik/borta" in asked
    stats = Y.extract(spark, f"file://{tmp_path}", "T", f"file://{tmp_path}/said").first()
    assert stats.n == 2 and stats.largest >= stats.median
    rows = {r.sakfraga: r for r in L.layer(spark, "said", f"file://{tmp_path}/said").collect()}
    assert rows["skola"].text_for_embedding.startswith("Skolan\n(Skola och barn; Utbildning)\nSkolan ska") and "kakor" not in rows["skola"].text
    assert rows["vard-och-omsorg"].heading == "Vard och omsorg" and rows["skola"].in_index and rows["skola"].chunk_id == "T:said:skola"
    assert Y.codes("all") == list(Y.SITES) and Y.codes("V") == ["V"]
    with pytest.raises(ValueError):
        Y.codes("X")


def test_splitter_cases():
    """Cases worked out from the contract: pieces of 1,200, steps of 1,050, the rest is packed on."""
    x = "x" * 2150
    assert split_text(x) == ["x" * 1200, "x" * 1100]
    assert list(map(len, split_text("x" * 1250 + "."))) == [1200, 201]
    # a sentence before a giant one goes first; in the other order its rest is packed with it
    assert split_text("Kort mening. " + x)[0] == "Kort mening."
    assert split_text("Kort mening. " + x, ordered=False) == ["x" * 1200, "Kort mening. " + "x" * 1100]
    # the rest is packed with what follows
    assert split_text(x + ". Slut nu.") == ["x" * 1200, "x" * 1100 + ". Slut nu."]
    words = split_text("ord " * 299 + "sist. " + "Ett till.")
    assert [len(w) <= 1350 for w in words] == [True] * len(words) and words[1].endswith("Ett till.")


def test_section_bounds(spark):
    text = "\n1.1\nInledning om allt\nbrödtext\n1.2\nReformer nu\nmer\n"
    heads = spark.createDataFrame([(text,)], "t string").select(B.headings(F.col("t"), B.POLICY_HEADING).alias("h")).first().h
    assert [(h.number, h.title, text[h.start : h.after]) for h in heads] == [("1.1", "Inledning om allt", "\n1.1\nInledning om allt\n"), ("1.2", "Reformer nu", "\n1.2\nReformer nu\n")]
