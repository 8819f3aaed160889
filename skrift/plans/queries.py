"""Queries over the driver's tables; documents stand in for passages (layer = lang, party = source)."""

import gzip

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import text as T
from ..functions.split import paragraphs as blank_line_paragraphs
from ..functions.split import split_pieces
from ..operators import answer as A
from ..operators import evaluate as E
from ..operators import retrieve as R
from ..operators import search as S
from ..operators import sections as X
from ..sources import html as H
from ..sources import index as I
from ..sources import layers as L
from ..sources import log as G
from ..sources import motions as M
from ..sources import programs as P
from ..sources import propositions as B
from ..sources import sites as Y
from ..tables import scratch, spread
from . import report


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def corpus(spark, sf) -> DataFrame:
    return table(spark, sf, "documents").select(F.col("doc_id").alias("pid"), F.col("lang").alias("layer"), F.col("source").alias("party"), F.concat("source", F.lit(" ("), "lang", F.lit(")")).alias("context"), "text")


def shared_corpus(spark, sf) -> DataFrame:
    """Every tenth passage has two parties."""
    n = F.regexp_extract("party", r"(\d+)", 1).cast("int")
    return corpus(spark, sf).withColumn("party", F.when(F.col("pid") % 10 == 0, F.concat("party", F.lit(";src"), ((n + 1) % 20).cast("string"))).otherwise(F.col("party")))


def asked(spark, sf) -> DataFrame:
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("question"))


def vectors(spark, sf) -> DataFrame:
    v = table(spark, sf, "embeddings").select(F.col("vec_id").alias("pid"), F.col("embedding").alias("vector"))
    return v.join(table(spark, sf, "documents").select(F.col("doc_id").alias("pid")), "pid", "left_semi")


def asked_with_vectors(spark, sf) -> DataFrame:
    q = table(spark, sf, "embeddings").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qvector"))
    return asked(spark, sf).join(q, "qid")


def rounded(hits: DataFrame, *extra: str) -> DataFrame:
    return hits.select("qid", "pid", F.round("score", 6).alias("score"), "rank", *extra)


def tokenize_stem(spark, sf):
    """With a digest of all stems of a text."""
    own = T.tokens(F.col("text"))
    return corpus(spark, sf).select("pid", F.size(own).cast("long").alias("n_tokens"), F.sha1(F.array_join(own, " ").cast("binary")).alias("sha1"))


def term_freq(spark, sf):
    return S.postings(S.token_lists(corpus(spark, sf))).select("pid", "term", "tf")


def doc_freq_idf(spark, sf):
    lists = S.token_lists(corpus(spark, sf))
    df = S.postings(lists).groupBy("term").agg(F.count("*").alias("df"))
    return df.crossJoin(F.broadcast(S.corpus_stats(lists))).select("term", "df", F.round(S.idf(F.col("df"), F.col("n")), 6).alias("idf"))


def corpus_stats(spark, sf):
    return S.corpus_stats(S.token_lists(corpus(spark, sf))).select("n", F.round("avgdl", 6).alias("avgdl"))


def bm25_topk(spark, sf):
    return rounded(S.bm25(corpus(spark, sf), asked(spark, sf), 10))


def index_bm25(spark, sf):
    """The same search from a written index."""
    folder = scratch(spark)
    I.build(corpus(spark, sf), folder, None)
    own = I.Index(spark, folder)
    return rounded(own.bm25(asked(spark, sf), 10))


def index_deltas(spark, sf):
    """The same search from an index in steps: old texts and passages that are not there any more, then what replaces the one and takes out the other."""
    folder, whole = scratch(spark), corpus(spark, sf)
    old = whole.where("pid % 3 <> 0").withColumn("text", F.when(F.col("pid") % 3 == 1, F.reverse("text")).otherwise(F.col("text")))
    extra = whole.where("pid % 2 = 0").withColumn("pid", -1 - F.col("pid"))
    I.build(old.unionByName(extra), folder, None)
    I.append(whole.where("pid % 3 < 2"), folder, name="first")
    I.append(whole.limit(0), folder, removed=extra, name="second")
    I.append(whole.where("pid % 3 < 2"), folder, name="first")  # again: nothing
    return rounded(I.Index(spark, folder).bm25(asked(spark, sf), 10))


def bm25_drop_party_words(spark, sf):
    return rounded(S.bm25(corpus(spark, sf), asked(spark, sf), 10, True))


def vector_topk(spark, sf):
    return rounded(S.dense(vectors(spark, sf), asked_with_vectors(spark, sf), 10))


def vector_topk_per_label(spark, sf):
    """For every question, the three nearest of each label."""
    labels = table(spark, sf, "embeddings").select(F.col("vec_id").alias("pid"), "label")
    return rounded(S.dense(vectors(spark, sf).join(labels, "pid"), asked_with_vectors(spark, sf), 3, by="label"), "label")


def _hybrid(spark, sf, **options):
    return S.hybrid(corpus(spark, sf), vectors(spark, sf), asked_with_vectors(spark, sf), **options)


def _within(spark, sf, passages, party):
    """Fused hits of some parties' passages, ranked among all."""
    own = S.matching(passages.select("pid", "layer", "party", "context"), party=party)
    return S.hybrid_within(corpus(spark, sf), vectors(spark, sf), asked_with_vectors(spark, sf), own).join(own, "pid")


def rrf_hybrid(spark, sf):
    return rounded(_hybrid(spark, sf).where(F.col("rank") <= 10))


def rrf_weights(spark, sf):
    return rounded(_hybrid(spark, sf, bm25_weight=1.0).where(F.col("rank") <= 10))


def hybrid_layer_filter(spark, sf):
    return rounded(S.top(S.filtered(_hybrid(spark, sf), corpus(spark, sf), layer="en"), 8))


def hybrid_party_filter(spark, sf):
    return rounded(S.top(_within(spark, sf, corpus(spark, sf), ["src0", "src3"]), 8))


def per_party_cap(spark, sf):
    return rounded(S.capped(S.filtered(_hybrid(spark, sf), corpus(spark, sf)), 1, 8), "party")


def per_party_cap_shared(spark, sf):
    return S.capped_shared(S.filtered(_hybrid(spark, sf), shared_corpus(spark, sf)), 1, 8)


SLOT_PARTIES = ("S", "M", "KD")


def political(spark, sf) -> DataFrame:
    """Documents as passages of the format's layers and parties, with what tells individual motions and sources."""
    c = F.col
    layer = F.when(c("lang") == "fr", "motion").when(c("lang") == "de", "program").when(c("lang") == "es", "proposition").otherwise("said")
    code = F.get(F.lit(list(K.PARTIES)), F.regexp_extract("source", r"(\d+)", 1).try_cast("int") % len(K.PARTIES))
    party = F.when(c("lang") == "es", "M;KD;L").otherwise(code)
    own = table(spark, sf, "documents").select(c("doc_id").alias("pid"), layer.alias("layer"), party.alias("party"), "text")
    return own.select(
        "*", F.col("party").alias("parti"), F.concat("party", F.lit(" ("), "layer", F.lit(")")).alias("context"),
        F.when(c("layer") == "motion", F.get(F.array(F.lit("Enskild motion"), F.lit("Kommittémotion"), F.lit("")), (c("pid") % 3).cast("int"))).alias("subtype"),
        F.when(c("layer") == "motion", F.when(c("pid") % 2 == 0, "A B").otherwise("A B;C D")).alias("undertecknare"),
        F.lit("2024/25").alias("rm"), c("pid").cast("string").alias("beteckning"), F.concat(F.lit("t"), c("pid").cast("string")).alias("doc_title"), F.lit("1 maj 2024").alias("datum"),
        F.lit("partiprogram").alias("doc_type"), (c("pid") % 40).cast("int").alias("page"), (F.lit(2000) + c("pid") % 2 * 20).cast("int").alias("year"), F.lit("h").alias("heading"),
        F.concat(F.when(c("pid") % 7 == 0, F.lit("ftp://")).otherwise(F.lit("https://")), F.lit("p.se/"), (c("pid") % 50).cast("string")).alias("url"), F.when(c("pid") % 2 == 0, "2024-05-06T01").alias("lastmod"),
        F.when(c("pid") % 5 == 0, c("text")).alias("sektion_text"),
    )


def program_spans(spark, sf) -> DataFrame:
    """Documents as spans of a programme's pages: headings of three kinds, drop caps, page numbers, and the whole text as the last block."""
    parts = F.filter(F.transform(F.split(F.regexp_replace("text", "([.!?]) ", "$1\n"), "\n"), lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", "")), lambda x: x != "")
    own = spread(table(spark, sf, "documents")).select("doc_id", "text", F.posexplode(parts).alias("i", "x"))
    kind = (F.col("doc_id") + F.col("i") * 7) % 11
    pick = lambda **of: F.coalesce(*[F.when(kind == int(k[1:]), v) for k, v in of.items() if k != "rest"], of["rest"])
    text = pick(k0=F.left("x", F.lit(40)), k1=F.concat((F.col("i") % 9 + 1).cast("string"), F.lit(".1 "), F.left("x", F.lit(30))), k2=F.lit("M"), k3=F.lit("12"), k4=F.left("x", F.lit(100)), rest=F.col("x"))
    spans = own.select(
        F.concat("doc_id", F.lit(".pdf")).alias("file"), (F.floor(F.col("i") / 12) + 1).cast("int").alias("page"), F.floor(F.col("i") % 12 / 4).cast("int").alias("block"), (F.col("i") % 4).cast("int").alias("line"), F.lit(0).alias("span"),
        pick(k0=F.lit("Sans"), k4=F.lit("Serif-Bold"), rest=F.lit("Serif")).alias("font"), pick(k0=F.lit(14.0), k2=F.lit(40.0), rest=F.lit(10.0)).alias("size"), pick(k4=F.lit(P.BOLD), rest=F.lit(0)).alias("flags"), text.alias("text"),
    )
    last = table(spark, sf, "documents").where(F.col("text").rlike(r"\S")).select(F.concat("doc_id", F.lit(".pdf")).alias("file"), F.lit(1_000_000).alias("page"), *[F.lit(0).alias(c) for c in ("block", "line", "span")], F.lit("Serif").alias("font"), F.lit(10.0).alias("size"), F.lit(0).alias("flags"), F.concat(F.lit("Slut "), F.regexp_replace("text", r"\s+", " ")).alias("text"))
    return spans.unionByName(last)


def program_sections(spark, sf):
    out = P.sections(program_spans(spark, sf))
    return out.select("file", "nth", "heading", "page", F.length("text").cast("long").alias("chars"), F.sha1(F.col("text").cast("binary")).alias("sha1"))


def _slot_table(spark):
    return R.slots(spark, SLOT_PARTIES)


def _candidates(spark, sf):
    """A party's candidates of one ranking, after a cutoff that the synthetic vectors pass; propositions are shared by the parties in government."""
    own = political(spark, sf)
    hits = _within(spark, sf, own, list(SLOT_PARTIES))
    near = R.relevant(R.slot_candidates(hits, _slot_table(spark)), floor=-0.2, distance=0.3)
    return near.join(own.select("pid", "subtype", "undertecknare"), "pid")


def _filled(spark, sf):
    return R.fill(R.group_motions(_candidates(spark, sf)))


def slot_retrieval(spark, sf):
    return R.final_order(_filled(spark, sf)).select("qid", "n", "slot", "pid", F.round("similarity", 6).alias("similarity"))


def slot_gaps(spark, sf):
    return R.gaps(asked_with_vectors(spark, sf), _slot_table(spark), _filled(spark, sf))


def individual_motions(spark, sf):
    return political(spark, sf).where("layer = 'motion'").select("pid", R.individual(F.col("layer"), F.col("subtype"), F.col("undertecknare")).alias("single"))


def slot_table(spark, sf):
    """The slots of every question: of even ones about all parties, of odd ones about one and two layers."""
    every = R.slots(spark, []).withColumn("asked", F.lit("all"))
    every = every.unionByName(R.slots(spark, ["KD"], ["motion", "said"], searched=["motion", "said"]).withColumn("asked", F.lit("KD")))
    own = asked(spark, sf).select("qid", F.when(F.col("qid") % 2 == 0, "all").otherwise("KD").alias("asked"))
    return own.join(F.broadcast(every), "asked")  # two short fixed lists


def _shown(spark, sf):
    """Numbered hits of two searches: by words, then by vectors."""
    own = political(spark, sf)
    ranked = [S.bm25(own, asked(spark, sf), 6), S.dense(vectors(spark, sf), asked_with_vectors(spark, sf), 6)]
    both = ranked[0].withColumn("call", F.lit(0)).unionByName(ranked[1].withColumn("call", F.lit(1)))
    return S.met(A.numbered_calls(both), own)


def tool_round(spark, sf):
    return _shown(spark, sf).select("qid", "n", "call", "pid")


def prompt_context(spark, sf):
    gaps = asked(spark, sf).where("qid % 2 = 0").select("qid", F.explode(F.array(F.lit("motion"), F.lit("program"))).alias("s_layer"), F.lit("S").alias("s_party"))
    out = A.prompt_context(_shown(spark, sf), gaps, limit=None).join(asked(spark, sf), "qid")
    text = A.prompt(F.col("context"), F.col("question"))
    return out.select("qid", F.length(text).cast("long").alias("chars"), F.sha1(text.cast("binary")).alias("sha1"))


def listed_sources(spark, sf):
    return _shown(spark, sf).select("qid", "n", A.listed_source().alias("line"))


def link_buttons(spark, sf):
    answers = asked(spark, sf).select("qid", F.lit("A [1–4] b [6, 7] och [99].").alias("answer"))
    return A.links(_shown(spark, sf), answers)


def passage_counts(spark, sf):
    return E.passage_counts(political(spark, sf)).select("layer", "party", "subtype", "grain", "n")


def filter_hits(spark, sf):
    q = F.concat(F.col("question"), F.when(F.col("qid") % 3 == 0, " Vilket parti SKA jag välja?").otherwise(""))
    return E.filter_hits(asked(spark, sf).select(q.alias("question"), (F.col("qid") % 2 == 0).alias("expect_refusal")))


def text_length_places(spark, sf):
    out = Y.length_stats(table(spark, sf, "documents").select(F.col("lang").alias("parti"), "text"))
    return out.select("parti", "n", *[F.col(c).cast("long").alias(c) for c in ("median", "p90", "largest")])


def party_mentions(spark, sf):
    named = F.get(F.lit(["Moderaterna", "the Greens", "SD", "sd", "xMP", "moderat", "Centre Party", "Liberalerna"]), (F.col("doc_id") % 8).cast("int"))
    text = F.concat("text", F.lit(" "), named, F.lit(", V."))
    return table(spark, sf, "documents").select("doc_id", F.array_join(T.mentioned(text), ",").alias("parties"))


def citation_strip(spark, sf):
    answer = F.concat("text", F.lit("  [3]\n[4, 5] x ("), F.get(F.lit(["SAID", "MOTION", "x"]), (F.col("doc_id") % 3).cast("int")), F.lit(")."))
    return table(spark, sf, "documents").select("doc_id", F.sha1(T.without_layer_labels(T.without_citations(answer)).cast("binary")).alias("sha1"))


def joined_line_text(spark, sf):
    """Lines of words ending in hyphens, joined."""
    words = F.split("text", " ")
    lines = F.transform(F.slice(words, 1, F.size(words)), lambda w, i: F.when(i % 3 == 0, F.concat(w, F.lit("-"))).when(i % 3 == 1, F.concat(F.get(F.lit(["och ", "eller ", "x"]), (i % 9 / 3).cast("int")), w)).otherwise(w))
    return table(spark, sf, "documents").select("doc_id", F.sha1(X.joined_lines(F.filter(lines, lambda x: x != "")).cast("binary")).alias("sha1"))


def relevance_cutoff(spark, sf):
    hits = S.filtered(_hybrid(spark, sf, method="vector"), corpus(spark, sf))
    return R.relevant(hits, floor=0.1, distance=0.15).select("qid", "layer", "pid", F.round("similarity", 6).alias("similarity"))


def quota_table(spark, sf):
    """How many passages of each layer every question gets, by how many parties it is about and which layers it searches."""
    searched = (K.LAYERS, ("motion",), ("program", "said"))
    rows = [(m, ",".join(ls), x, n) for m in K.QUOTA for ls in searched for x, n in R.quota(m, ls).items()]
    each = spark.createDataFrame(rows, "mode string, layers string, layer string, n int")
    how = asked(spark, sf).select("qid", F.get(F.lit(list(K.QUOTA)), (F.col("qid") % 2).cast("int")).alias("mode"), F.get(F.lit([",".join(ls) for ls in searched]), (F.col("qid") % 3).cast("int")).alias("layers"))
    return how.join(F.broadcast(each), ["mode", "layers"])  # a short fixed list


def _numbered(spark, sf):
    hits = S.met(S.bm25(corpus(spark, sf), asked(spark, sf), 10), corpus(spark, sf))
    return hits.select("qid", F.col("rank").alias("n"), "pid", "layer", "context", F.col("party").alias("source"), "text")


def context_budget(spark, sf):
    kept = R.within_budget(R.pieces(_numbered(spark, sf)), 20_000)
    return kept.select("qid", "n", F.length("piece").cast("long").alias("chars"), F.sha1(F.col("piece").cast("binary")).alias("sha1"))


def source_list(spark, sf):
    answers = asked(spark, sf).select("qid", F.lit("Ett [1, 3], två [5–8] och [12].").alias("answer"))
    return R.source_list(_numbered(spark, sf), answers)


def cited_numbers(spark, sf):
    answer = F.concat(F.lit("A ["), F.col("item_id").cast("string"), F.lit(", "), (F.col("item_id") + 3).cast("string"), F.lit("] b ["), F.col("item_id").cast("string"), F.lit("–"), (F.col("item_id") * 2).cast("string"), F.lit("]."))
    return table(spark, sf, "benchmark").select("item_id", F.array_join(T.cited_numbers(answer).cast("array<string>"), ",").alias("numbers"))


def history_last_turns(spark, sf):
    c = table(spark, sf, "conversations")
    return R.history(c.withColumn("text", F.concat("text", F.when(F.col("turn") % 2 == 1, F.lit("  [1]\n[2, 3–5].")).otherwise(""))), 3)


def content_key(spark, sf):
    return corpus(spark, sf).select("pid", T.content_key(T.embedded(F.col("context"), F.col("text"))).alias("emb"), T.content_hash(F.col("text")).alias("content_hash"))


def embedding_cache_missing(spark, sf):
    """Content keys that a cache of every third passage lacks, by the index's own function."""
    keyed = I.keyed(corpus(spark, sf))
    known = keyed.where("pid % 3 = 0").select("emb")
    return I.missing(keyed, known).select("emb", F.sha1(F.col("text").cast("binary")).alias("sha1"))


def _passages(spark, sf) -> DataFrame:
    """Documents as the four layers' records, and these as passages."""
    c = F.col
    docs = table(spark, sf, "documents")
    own = lambda lang: docs.where(c("lang") == lang).withColumn("chunk_id", c("doc_id").cast("string")).withColumn("parti", c("source"))
    said = own("en").select("chunk_id", "parti", F.lit("ämne").alias("sakfraga"), F.lit("").alias("heading"), F.array(F.lit("Ämne")).alias("labels"), "text", F.lit("u").alias("url"), F.lit(None).cast("string").alias("lastmod"))
    motion = own("fr").select("chunk_id", "parti", F.lit("2024/25").alias("rm"), c("chunk_id").alias("beteckning"), F.lit("t").alias("doc_title"), F.lit("h").alias("heading"), F.lit("s").alias("sektion_text"), F.lit("x").alias("undertecknare"), "text")
    program = own("de").select("chunk_id", "parti", F.lit(None).cast("string").alias("doc_type"), F.lit(2020).alias("year"), F.lit("h").alias("heading"), F.lit(1).alias("page"), "text")
    prop = own("es").select("chunk_id", "parti", F.lit("2024/25").alias("rm"), F.lit("1").alias("beteckning"), F.lit("t").alias("doc_title"), F.lit("h").alias("heading"), F.lit("d").alias("datum"), "text")
    kinds = own("fr").where("doc_id % 2 = 0").select(F.concat(F.lit("2024/25:"), "chunk_id").alias("key"), F.lit("Enskild motion").alias("subtype"))
    return L.passages(said, motion, program, prop, kinds)


def passage_union(spark, sf):
    return _passages(spark, sf).groupBy("layer", "parti", "kontext", "subtyp").agg(F.countDistinct("parent").alias("parents"))


def passage_rows(spark, sf):
    """Every passage, with digests of its context and text."""
    sha = lambda c: F.sha1(F.col(c).cast("binary")).alias(c)
    return _passages(spark, sf).select("id", "layer", "parti", "parent", "subtyp", sha("kontext"), sha("text"), "emb")


def context_lines(spark, sf):
    docs = table(spark, sf, "documents")
    return docs.select("doc_id", L.program_context(F.when(F.col("doc_id") % 2 == 0, "M;KD").otherwise("S"), F.lit(None).cast("string"), (F.col("doc_id") % 3).cast("int"), F.col("lang")).alias("line"))


def split_paragraphs(spark, sf):
    return corpus(spark, sf).select("pid", F.size(blank_line_paragraphs(F.replace("text", F.lit("\n"), F.lit("\n\n")))).cast("long").alias("n"))


def split_text_full(spark, sf):
    own = spread(corpus(spark, sf)).select("pid", F.posexplode(split_pieces("text")).alias("i", "piece"))
    return own.select("pid", F.col("i").cast("long").alias("i"), F.length("piece").cast("long").alias("chars"), F.sha1(F.col("piece").cast("binary")).alias("sha1"))


def sentence_split(spark, sf):
    s = T.sentences(F.col("text"))
    return corpus(spark, sf).select("pid", F.size(s).cast("long").alias("n"), F.sha1(F.array_join(s, "|").cast("binary")).alias("sha1"))


def substantive_sentences(spark, sf):
    own = corpus(spark, sf).select("pid", T.sentences(F.col("text")).alias("s"))
    return own.select("pid", F.size("s").cast("long").alias("n"), F.size(F.filter("s", T.substantive)).cast("long").alias("substantive"))


def language_vote(spark, sf):
    return corpus(spark, sf).select("pid", T.language(F.col("text")).alias("language"))


def voting_advice_flag(spark, sf):
    q = F.concat(F.col("question"), F.when(F.col("qid") % 3 == 0, " Vilket parti SKA jag välja?").otherwise(""))
    return asked(spark, sf).select("qid", T.asks_for_voting_advice(q).alias("advice"))


def _judged(spark, sf):
    good = table(spark, sf, "labels").where("quality = 1 AND toxic = 0").select(F.col("doc_id").alias("pid"), F.lit(True).alias("good"))
    hits = S.met(S.bm25(corpus(spark, sf), asked(spark, sf), 10), corpus(spark, sf).drop("text")).join(good, "pid", "left")
    rules = asked(spark, sf).select("qid", F.lit("en").alias("layer"), *[F.lit(None).cast(t).alias(c) for c, t in _CONDITIONS[1:]])
    none = [F.lit(None).cast("string").alias(c) for c in ("number", "session", "topic", "text")]
    return E.judged(hits.select("*", *none), rules).withColumn("flag", F.coalesce("good", F.lit(False)) & F.col("flag"))


_CONDITIONS = (("layer", "string"), ("party", "array<string>"), ("number", "array<string>"), ("session", "array<string>"), ("topic", "string"), ("body", "string"))


def precision_rules(spark, sf):
    """Precision by a rule a question: every condition alone, all at once, and a rule without conditions."""
    kind, none = F.col("qid") % 8, F.lit(None)
    own = {"layer": F.lit("en"), "party": F.array(F.lit("src0"), F.lit("src3"), F.lit("src7")), "number": F.array(*map(F.lit, "12579")), "session": F.array(F.lit("1"), F.lit("2")), "topic": F.lit("^(THE|d.|[a-f])"), "body": F.lit("SRC.* (der|THE|la) ")}
    rules = asked(spark, sf).select("qid", *[F.when(kind.isin(n, 7), own[c]).otherwise(none).cast(t).alias(c) for n, (c, t) in enumerate(_CONDITIONS)])
    extra = table(spark, sf, "documents").select(F.col("doc_id").alias("pid"), (F.col("doc_id") % 10).cast("string").alias("number"), (F.col("doc_id") % 3).cast("string").alias("session"), F.substring_index("text", " ", 1).alias("topic"), "text")
    hits = S.met(S.bm25(corpus(spark, sf), asked(spark, sf), 10), corpus(spark, sf).drop("text").join(extra, "pid"))
    return E.retrieval_metrics(E.judged(hits, rules)).select("qid", F.round("precision", 6).alias("precision"), F.round("reciprocal_rank", 6).alias("reciprocal_rank"), "false_hits")


def retrieval_runs(spark, sf):
    """Every question by its own search: number of hits, layer, parties, cap a party. Questions for parties rank all passages, without their names."""
    qid = F.col("qid")
    how = asked(spark, sf).select("qid", (3 + qid % 5).cast("int").alias("k"), F.when(qid % 3 == 0, "en").alias("layer"), F.when(qid % 4 == 1, F.array(F.lit("src0"), F.lit("src3"))).alias("party"), F.when(qid % 5 == 2, 1).alias("per_party"))
    lists = S.asked_lists(corpus(spark, sf), asked(spark, sf))
    parts = [S.hybrid(corpus(spark, sf), None, asked(spark, sf).where(c), "bm25", wide, lists=lists) for c, wide in ((qid % 4 != 1, False), (qid % 4 == 1, True))]
    return rounded(E.retrieval_run(parts[0].unionByName(parts[1]), corpus(spark, sf), how), "layer", "party")


def topic_urls(spark, sf):
    """Pages of sites whose patterns stand in a table."""
    sites = table(spark, sf, "pages").select(F.concat(F.lit("p"), (F.col("page_id") % 7).cast("string")).alias("party")).distinct()
    sites = sites.withColumn("topics", F.concat(F.lit("/(en|fr)/[0-9]*"), F.right("party", F.lit(1)), F.lit("[0-9]*([?#]|$)")))
    urls = table(spark, sf, "pages").select("page_id", "url", F.concat(F.lit("p"), (F.col("page_id") % 7).cast("string")).alias("party"))
    return H.topic_pages(urls, sites).select("page_id", "party", "url")


def precision_mrr(spark, sf):
    return E.retrieval_metrics(_judged(spark, sf)).select("qid", F.round("precision", 6).alias("precision"), F.round("reciprocal_rank", 6).alias("reciprocal_rank"))


def party_coverage(spark, sf):
    expected = F.array(F.lit("src0"), F.lit("src1"), F.lit("src2"))
    return E.coverage(_judged(spark, sf), expected).withColumn("covered", F.round("covered", 6))


def false_hits(spark, sf):
    return E.retrieval_metrics(_judged(spark, sf)).select("qid", "false_hits", "top_context")


def metrics_by_type(spark, sf):
    per = E.retrieval_metrics(_judged(spark, sf)).withColumn("type", F.concat(F.lit("t"), (F.col("qid") % 3).cast("string")))
    out = per.rollup("type").agg(F.avg("precision").alias("p"), F.avg("reciprocal_rank").alias("m"), F.count("*").alias("n"))
    return out.select(F.coalesce("type", F.lit("all")).alias("type"), F.round("p", 6).alias("precision"), F.round("m", 6).alias("mrr"), "n")


def latency_p50_p90(spark, sf):
    out = E.latency(table(spark, sf, "events"), "event_type", "value")
    return out.select("event_type", "n", F.round("p50", 6).alias("p50"), F.round("p90", 6).alias("p90"))


def pooled_citation_coverage(spark, sf):
    parts = table(spark, sf, "events").select("event_type", F.when(F.col("value") > 10, 1).otherwise(0).alias("cited"), F.lit(1).alias("claims"))
    return E.pooled(parts, "event_type").withColumn("coverage", F.round("coverage", 6))


def report_grains(spark, sf):
    own = table(spark, sf, "events").select(F.col("event_type").alias("config"), (F.col("user_id") % 3).alias("typ"), F.col("user_id").alias("id"), "value")
    out = report.means(own, ["value"])
    return out.select("config", "typ", "id", "grain", F.round("value", 6).alias("value"), "n_value")


def grading_sheet(spark, sf):
    c = table(spark, sf, "conversations").where("role = 'assistant'")
    own = c.select(F.lit("rag").alias("config"), F.concat_ws("-", "conv_id", "turn").alias("id"), F.col("role").alias("typ"), F.lit("f").alias("fraga"), F.concat("text", F.lit(" [1].")).alias("answer"), F.array(F.lit("[1, 4] a"), F.lit("[2–3] b")).alias("sources"), F.when(F.col("conv_id") % 5 == 0, "broken").alias("error"), "turn")
    old = own.where("turn % 4 = 1").select("config", "id", F.when(F.col("turn") == 1, F.col("answer")).otherwise("old").alias("answer"), *[F.lit("1").alias(g) for g in report.GRADES], F.lit("n").alias("notes"))
    return report.grading_rows(own, old).select("config", "id", "sources", "supported", "neutral", "notes")


def latest_result(spark, sf):
    return E.latest(table(spark, sf, "events").select("user_id", "event_type", "event_id", "value"), ["user_id", "event_type"], "event_id")


def latest_logged(spark, sf):
    """Last rows of a log that got the events in two appends, the first of them twice, and was compacted between."""
    folder, own = scratch(spark, "log"), table(spark, sf, "events").select("user_id", "event_type", "event_id", "value")
    keys = ["user_id", "event_type"]
    G.append(own.where("event_id % 2 = 0"), folder, "even", ["event_id"])
    G.append(own.where("event_id % 2 = 0"), folder, "even", ["event_id"])
    G.compact(spark, folder, keys)
    G.append(own.where("event_id % 2 = 1"), folder, "odd", ["event_id"])
    return G.latest(G.read(spark, folder), keys).select(*keys, "event_id", "value", "seq")


def best_section_match(spark, sf):
    docs = spread(table(spark, sf, "documents"))
    s = docs.select(F.col("doc_id").alias("doc"), F.posexplode(F.split("text", "\n")).alias("pos", "body")).withColumn("heading", F.lit(""))
    y = docs.select(F.col("doc_id").alias("doc"), F.lit(1).alias("nr"), "text")
    return E.best_sections(y, s).select("doc", F.round("match_score", 6).alias("match_score"), F.length("section_text").cast("long").alias("chars"))


def _urls(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.regexp_replace("url", "[?#].*$", "").alias("url"))


def url_discovery_join(spark, sf):
    p = _urls(spark, sf)
    left = p.where("page_id % 3 <> 0").groupBy("url").agg(F.max("page_id").cast("string").alias("lastmod"))
    right = p.where("page_id % 2 = 0").groupBy("url").agg(F.array(F.min("page_id").cast("string")).alias("labels"))
    return H.discovered(left, right).select("url", "lastmod", F.array_join("labels", ",").alias("labels"), F.array_join("sources", ",").alias("sources"))


def sitemap_files(spark, sf) -> DataFrame:
    """Pages as the sitemaps of five sites: an index each, seven children, one of which is no sitemap; compressed, marked and with junk before them."""
    n = F.col("page_id")
    party = F.concat(F.lit("p"), (n % 5).cast("string"))
    date = F.when(n % 3 == 0, F.concat(F.lit("<x:lastmod> 2024-05-0"), (n % 9 + 1).cast("string"), F.lit("T01:02:03Z </x:lastmod>"))).otherwise("")
    loc = F.replace("url", F.lit("&"), F.lit("&amp;"))
    child = lambda k: F.concat(F.lit("https://"), F.col("party"), F.lit("/map-"), k.cast("string"), F.lit(".xml"))
    entry = F.concat(F.lit("<x:url><x:loc> "), loc, F.lit(" </x:loc>"), date, F.lit("</x:url>"))
    own = table(spark, sf, "pages").select(party.alias("party"), F.floor(n / 5 % 7).alias("k"), "page_id", entry.alias("e"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_id", "e"))), lambda x: x["e"]), "\n")
    maps = own.groupBy("party", "k").agg(text.alias("t")).select(child(F.col("k")).alias("url"), F.concat(F.when(F.col("k") == 1, "junk \n").otherwise(""), F.lit('<?xml version="1.0" encoding="UTF-8"?><x:urlset xmlns:x="http://www.sitemaps.org/schemas/sitemap/0.9">'), "t", F.when(F.col("k") == 6, "").otherwise("</x:urlset>")).alias("t"), "k")
    index = own.select("party").distinct().select(F.concat(F.lit("https://"), "party", F.lit("/index.xml")).alias("url"), F.concat(F.lit("\ufeff<sitemapindex>"), F.array_join(F.transform(F.sequence(F.lit(0), F.lit(7)), lambda k: F.concat(F.lit("<sitemap><loc>"), child(k), F.lit("</loc></sitemap>"))), ""), F.lit("</sitemapindex>")).alias("t"), F.lit(0).alias("k"))

    @F.pandas_udf("binary")
    def packed(col: pd.Series, k: pd.Series) -> pd.Series:
        return pd.Series([gzip.compress(t.encode()) if n % 2 else t.encode() for t, n in zip(col, k)])

    return maps.unionByName(index).select("url", packed("t", "k").alias("content"))


def sitemap_urls(spark, sf):
    sites = spark.range(6).select(F.concat(F.lit("p"), F.col("id").cast("string")).alias("party"), F.concat(F.lit("https://p"), F.col("id").cast("string"), F.lit("/index.xml")).alias("sitemap"))
    return H.site_urls(sitemap_files(spark, sf), sites)


def parties_in(spark, sf):
    """Parties that each text names by an alias, one of which stands at its end."""
    names = F.get(F.lit([*K.ALIASES, "Socialdemokraterna S", "xmoderaterna", "kd-l", "MP_"]), (F.col("doc_id") % (len(K.ALIASES) + 4)).cast("int"))
    text = F.concat("text", F.lit(" ("), names, F.lit(", "), F.when(F.col("doc_id") % 3 == 0, "Sossarna?").otherwise(""))
    return spread(table(spark, sf, "documents")).select("doc_id", F.array_join(T.parties_in(text), ",").alias("parties"))


def slug_collisions(spark, sf):
    return H.slugs(_urls(spark, sf).groupBy("url").agg(F.min("page_id").alias("page_id"))).select("url", "slug")


def html_strip(spark, sf):
    plain = F.regexp_replace(F.regexp_replace("html", r"(?s)<[^>]*>", " "), r"[ \t\r\n\f]+", " ")
    return table(spark, sf, "pages").select("page_id", F.sha1(F.trim(plain).cast("binary")).alias("sha1"))


def html_main_text(spark, sf):
    return H.main_text(spread(table(spark, sf, "pages").select("page_id", "html")))


def html_blocks(spark, sf):
    """The blocks of text of each page, and which of them are its main text."""
    own = H.blocks(spread(table(spark, sf, "pages").select("page_id", "html")), ["page_id"])
    order = Window.partitionBy("page_id").orderBy("block")
    out = H.main_blocks(own, ["page_id"]).where("NOT skipped").withColumn("nth", F.row_number().over(order))
    return out.select("page_id", "nth", F.sha1(F.col("text").cast("binary")).alias("sha1"), "words", "linked", "main")


def html_anchors(spark, sf):
    return H.anchors(spread(table(spark, sf, "pages"))).select("url", F.array_join("labels", "|").alias("labels"))


def said_records(spark, sf):
    """The said layer of all pages, whose saved list says where each was found."""
    n = F.col("page_id")
    both = F.array_compact(F.array(F.when(n % 3 != 0, "sitemap"), F.when(n % 2 == 0, "index")))
    own = spread(table(spark, sf, "pages")).select(
        F.lit("V").alias("party"), F.lit("Vänsterpartiet").alias("name"), F.lit("2026-09-08").alias("fetched"), F.concat(F.lit("en-sida-"), n.cast("string")).alias("slug"), "url", F.lit(None).cast("string").alias("lastmod"),
        both.alias("sources"), F.when(n % 4 == 0, F.array(F.lit("Ämne"), F.lit("B"))).alias("labels"), F.when(n % 5 == 0, F.regexp_replace("html", "(?s)<title>.*?</title>", "")).otherwise(F.col("html")).alias("html"),
    )
    sha = lambda c: F.sha1(F.col(c).cast("binary")).alias(c)
    return Y.said_records(own).select("chunk_id", "parti", "sakfraga", "heading", sha("text"), sha("text_for_embedding"), "in_index", F.array_join("sources", ",").alias("sources"), "content_hash")


def motion_files(spark, sf) -> DataFrame:
    """Pages as motions: a paragraph's first sentence is a proposal, each paragraph a section, in the two kinds of markup."""
    paras = F.regexp_extract_all("html", F.lit("<p>([^<]+)</p>"), F.lit(1))
    own = spread(table(spark, sf, "pages").select("page_id", paras.alias("p")))
    item = lambda x, i: F.concat(F.when(i % 3 == 2, F.lit('<p class="a Yrkande">')).otherwise(F.lit('<li class="Frslagstext">')), F.substring_index(x, ". ", 1), F.when(i % 3 == 2, F.lit("</p>")).otherwise(F.lit("</li>")))
    name = lambda i: F.concat(F.lit("Del "), i.cast("string"))
    part = lambda x, i: F.concat(F.when(i % 2 == 0, F.concat(F.lit('<p class="Rubrik2numrerat b">'), name(i), F.lit("</p>"))).otherwise(F.concat(F.lit("<h3>"), name(i), F.lit("</h3>"))), F.lit("<div><p>"), x, F.lit("</p></div><ul><li><p>punkt</p></li></ul>"))
    code = F.get(F.lit(["S", "båda C", "alla MP", "?"]), (F.col("page_id") % 4).cast("int"))
    html = F.concat(
        F.lit('<html><body><span class="sidhuvud_beteckning"> 2024/25:'), F.col("page_id").cast("string"), F.lit(' </span><span class="MotionarLista">av A B m.fl. ('), code, F.lit(")</span><h1>Om&shy;råde <i>"),
        F.col("page_id").cast("string"), F.lit("</i></h1><ol>"), F.array_join(F.transform("p", item), ""), F.lit('</ol><div class="Section1"><p>ingress</p>'), F.array_join(F.transform("p", part), ""), F.lit('</div><p>efter</p><p class="Underskrifter">A B</p><p class="Underskrifter"> </p><p class="Underskrifter">C D</p></body>'),
    )
    return own.select(F.col("page_id").alias("file"), html.alias("html"))


def motion_records(spark, sf):
    sha = lambda c: F.sha1(F.col(c).cast("binary")).alias(c)
    return M.records(motion_files(spark, sf)).select("chunk_id", sha("text"), "heading", sha("sektion_text"), F.round("match_score", 6).alias("match_score"), "yrkande_nr", "parti", "doc_title", "forste_undertecknare", "undertecknare")


def bill_files(spark, sf) -> DataFrame:
    """Documents as bills whose summary their text is, with a line for each sentence; styles of different length come before."""
    safe = F.replace(F.replace("text", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    body = F.array_join(F.transform(F.split(safe, r"(?<=[.!?]) |\n"), lambda x: F.concat(F.lit("<p>"), x, F.lit("</p>"))), "")
    head = F.concat(F.lit("<html><head><title>Lag "), F.col("doc_id").cast("string"), F.lit("</title><style>"), F.repeat(F.lit("p {} "), (F.col("doc_id") % 9 * 100).cast("int")), F.lit("</style></head><body><p>Regeringens proposition 2023/24:"), (F.col("doc_id") + 200).cast("string"))
    html = F.concat(head, F.lit("</p><p>Stockholm den 5 oktober 2023</p><p>Propositionens huvudsakliga innehåll</p>"), body, F.lit("<p>Innehållsförteckning</p><p>1</p>"))
    return spread(table(spark, sf, "documents")).select(F.concat(F.lit("b/"), F.col("doc_id").cast("string"), F.lit(".html")).alias("file"), html.alias("html"))


def proposition_records(spark, sf):
    """Bills in two passes: those whose summary is not in the first 3,000 characters are read whole."""
    out = B.records(B.texts(bill_files(spark, sf), limit=3000))
    return out.select("chunk_id", "file", "doc_title", "datum", "heading", F.length("text").cast("long").alias("chars"), F.sha1(F.col("text").cast("binary")).alias("sha1"))


def section_ranges(spark, sf):
    lines = table(spark, sf, "documents").select(F.col("doc_id").alias("doc"), F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return X.section_ranges(lines.select("doc", "pos", (F.length("line") % 3).alias("depth")))


def carry_forward(spark, sf):
    e = table(spark, sf, "events").withColumn("heading", F.when(F.col("event_type") == "purchase", F.col("event_id")))
    return X.carried(e, "user_id", "event_id", "heading", "last_heading").select("event_id", "last_heading")


def body_style_mode(spark, sf):
    d = table(spark, sf, "documents")
    return X.body_style(d.select(F.col("source").alias("file"), F.col("lang").alias("font"), (F.col("doc_id") % 4 + 8.04).alias("size"), "text"))


def stub_embedding(spark, sf):
    """Places of the vector that are not zero."""
    own = S.stub_vectors(asked(spark, sf), "qid", "question")
    return own.select("qid", F.posexplode("vector").alias("bin", "value")).where("value <> 0").select("qid", F.col("bin").cast("long").alias("bin"), F.round("value", 9).alias("value"))


def worklist(spark, sf):
    done = table(spark, sf, "events").where("user_id % 2 = 0").select(F.lit("rag_tools").alias("config"), F.col("user_id").alias("id"))
    asks = asked(spark, sf).select(F.col("qid").alias("id"), F.col("qid").alias("ord"))
    return E.worklist(asks, ["rag_tools", "no_rag"], done).select("config", "id")


def grade_carry_over(spark, sf):
    """Grades of a sheet come over to the very answer that was graded."""
    c = table(spark, sf, "conversations")
    own = c.select(F.lit("rag").alias("config"), F.concat_ws("-", "conv_id", "turn").alias("id"), F.col("role").alias("typ"), F.lit("f").alias("fraga"), F.col("text").alias("answer"), F.array().cast("array<string>").alias("sources"), F.lit(None).cast("string").alias("error"))
    old = c.where("conv_id % 2 = 0").select(F.lit("rag").alias("config"), F.concat_ws("-", "conv_id", "turn").alias("id"), F.when(F.col("conv_id") % 4 == 0, F.col("text")).otherwise("old").alias("answer"), *[F.lit("2").alias(g) for g in report.GRADES], F.lit("n").alias("notes"))
    return report.grading_rows(own, old).select("id", "supported", "notes")


def followup_parent(spark, sf):
    c = table(spark, sf, "conversations")
    name = lambda turn: F.concat_ws("-", "conv_id", turn.cast("string"))
    answered = c.where("role = 'assistant'").select(F.lit("rag").alias("config"), name(F.col("turn")).alias("id"), F.col("text").alias("answer"))
    asks = c.where("role = 'user'").select(name(F.col("turn")).alias("id"), F.when(F.col("turn") > 1, name(F.col("turn") - 1)).alias("follows"))
    return E.with_parent(asks, answered).select("id", "config", "follows", F.sha1(F.col("parent_answer").cast("binary")).alias("parent_sha1"))


def _metrics(spark, sf):
    c = table(spark, sf, "conversations").where("role = 'assistant'")
    nth = F.col("turn") % 4
    answer = F.concat("text", F.when(nth == 1, " Moderaterna vill sänka skatten för alla [1] och [7].").when(nth == 3, " Det saknas material [2].").otherwise(""))
    hit = lambda n, layer, party: F.struct(F.lit(n).alias("n"), F.lit(layer).alias("layer"), F.lit(party).alias("parti"))
    odd = F.col("conv_id") % 2 == 1
    return E.answer_metrics(
        c.select(
            F.concat_ws("-", "conv_id", "turn").alias("qid"), F.when(F.col("conv_id") % 5 == 0, "no_rag").otherwise("rag_tools").alias("config"), answer.alias("answer"),
            F.array(hit(1, "motion", "S;M"), hit(2, "said", "V")).alias("hits"), F.when(odd, F.array(F.lit("M"), F.lit("V"))).alias("expected"), F.when(odd, F.array(F.lit("said"))).alias("layers"),
            F.when(F.col("conv_id") % 3 == 0, "REGERINGEN|moderaterna").alias("attribution"), (F.col("conv_id") % 4 == 0).alias("expect_gap"), (F.col("conv_id") % 4 == 1).alias("expect_refusal"), F.lit("sv").alias("lang"),
        )
    )


def answer_metrics(spark, sf):
    m = _metrics(spark, sf)
    return m.select("qid", "config", "answered", F.round("citation_validity", 6).alias("citation_validity"), F.round("party_mentioned", 6).alias("party_mentioned"), F.round("party_cited", 6).alias("party_cited"), "layer_cited", "attribution_found", "gap_acknowledged", "refused", "language_ok")


def problem_flags(spark, sf):
    m = _metrics(spark, sf)
    return m.select("qid", E.problem_flags(m).alias("problems"))


ALL = (
    tokenize_stem, term_freq, doc_freq_idf, corpus_stats, bm25_topk, index_bm25, index_deltas, bm25_drop_party_words, vector_topk, vector_topk_per_label, rrf_hybrid, rrf_weights,
    hybrid_layer_filter, hybrid_party_filter, per_party_cap, per_party_cap_shared, slot_retrieval, slot_gaps, relevance_cutoff, quota_table, context_budget,
    source_list, cited_numbers, history_last_turns, content_key, embedding_cache_missing, passage_union, passage_rows, context_lines, split_paragraphs, split_text_full,
    sentence_split, substantive_sentences, language_vote, voting_advice_flag, precision_mrr, precision_rules, retrieval_runs, topic_urls, party_coverage, false_hits, metrics_by_type, latency_p50_p90,
    pooled_citation_coverage, report_grains, grading_sheet, latest_result, latest_logged, best_section_match, url_discovery_join, sitemap_urls, parties_in, slug_collisions, html_strip, html_main_text, html_anchors, section_ranges,
    individual_motions, slot_table, tool_round, prompt_context, listed_sources, link_buttons, passage_counts, filter_hits, text_length_places, party_mentions, citation_strip, joined_line_text, answer_metrics,
    html_blocks, said_records, motion_records, proposition_records, program_sections, carry_forward, body_style_mode, stub_embedding, worklist, grade_carry_over, followup_parent, problem_flags,
)


def queries() -> dict:
    return {f.__name__: f for f in ALL}
