"""Slots by party and layer, relevance cutoff, gaps, contexts and sources."""

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import text as T
from .search import fused_order


def quota(mode: str, layers=K.LAYERS, searched=None) -> dict[str, int]:
    """Passages a slot gets, scaled so that all layers searched in this step share the whole budget."""
    own = K.QUOTA[mode]
    budget, weight = sum(own.values()), sum(own[x] for x in searched or layers)
    return {x: math.ceil(own[x] * budget / weight) for x in layers}


def slots(spark: SparkSession, parties, layers=K.LAYERS, government=K.GOVERNMENT, searched=None) -> DataFrame:
    """(slot, s_party, s_layer, n): parties (none: all) by layers, without propositions for the opposition; two short fixed lists."""
    each = quota("one_party" if len(parties) == 1 else "several_parties", layers, searched)
    rows = [(p, x, each[x]) for p in parties or K.PARTIES for x in layers if x != "proposition" or p in government]
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "slot int, s_party string, s_layer string, n int")


def individual(passage_layer: Column, subtype: Column, signers: Column) -> Column:
    """A member's own motion: by subtype, else by having one signer only."""
    one = F.size(T.split_set(F.coalesce(signers, F.lit("")))) == 1
    return (passage_layer == "motion") & F.when(F.coalesce(subtype, F.lit("")) != "", subtype == "Enskild motion").otherwise(one)


def slot_candidates(hits: DataFrame, slot_table: DataFrame, extra: int = K.SLOT_EXTRA) -> DataFrame:
    """All slots of a question from its one ranking, numbered or in fused order: the first n + extra of each slot."""
    most = (slot_table.agg(F.max("n")).first()[0] or 0) + extra
    order = ["rank"] if "rank" in hits.columns else fused_order()
    own = hits.withColumn("own", F.explode(T.split_set(F.col("party"))))
    own = own.join(F.broadcast(slot_table), (F.col("own") == F.col("s_party")) & (F.col("layer") == F.col("s_layer")))
    nth = F.row_number().over(Window.partitionBy("qid", "slot").orderBy(*order))
    # the longest slot is a number, so tasks leave out what is behind it before they shuffle
    return own.withColumn("pos", nth).where(F.col("pos") <= most).where(F.col("pos") <= F.col("n") + extra)


def relevant(candidates: DataFrame, floor: float = K.MIN_SIMILARITY, distance: float = K.MAX_DISTANCE) -> DataFrame:
    """Those near enough to the best of their layer; without similarity all pass."""
    best = F.max("similarity").over(Window.partitionBy("qid", "layer"))
    own = candidates.withColumn("best", best)
    return own.where(F.col("similarity").isNull() | (F.col("similarity") >= F.greatest(F.lit(floor), F.col("best") - distance))).drop("best")


def group_motions(candidates: DataFrame, most: int = K.MOST_INDIVIDUAL) -> DataFrame:
    """Candidates (qid, slot, pos, layer, subtype, undertecknare, ...) with at most so many individual motions a slot; after the cutoff, for which all count."""
    own = candidates.withColumn("single", F.coalesce(individual(F.col("layer"), F.col("subtype"), F.col("undertecknare")), F.lit(False)))
    if not most:
        return own.where("NOT single").drop("single")
    nth = F.sum(F.col("single").cast("int")).over(Window.partitionBy("qid", "slot").orderBy("pos"))
    return own.withColumn("nth", nth).where(~F.col("single") | (F.col("nth") <= most)).drop("single", "nth")


def fill(candidates: DataFrame) -> DataFrame:
    """Slots filled in order, no passage twice; a skipped one leaves its place free.

    A question has at most slots * (n + extra) candidates, which one group holds.
    """

    def greedy(pdf):
        seen, keep, taken = set(), [], {}
        for i, row in pdf.sort_values(["slot", "pos"]).iterrows():
            if row.pid not in seen and taken.get(row.slot, 0) < row.n:
                seen.add(row.pid)
                taken[row.slot] = taken.get(row.slot, 0) + 1
                keep.append(i)
        return pdf.loc[keep, ["qid", "slot", "s_party", "s_layer", "pid", "pos", "score", "similarity"]]

    schema = "qid long, slot int, s_party string, s_layer string, pid long, pos int, score double, similarity double"
    return candidates.select("qid", "slot", "s_party", "s_layer", "n", "pid", "pos", "score", "similarity").groupBy("qid").applyInPandas(greedy, schema)


def final_order(filled: DataFrame) -> DataFrame:
    by = Window.partitionBy("qid").orderBy(F.desc(F.round(F.coalesce("similarity", "score"), 9)), "slot", "pos")
    return filled.withColumn("n", F.row_number().over(by))


def gaps(questions: DataFrame, slot_table: DataFrame, filled: DataFrame, government=K.GOVERNMENT) -> DataFrame:
    """Slots without a hit; a governing party without motions is no gap."""
    every = questions.select("qid").crossJoin(F.broadcast(slot_table.select("slot", "s_party", "s_layer")))
    empty = every.join(filled.select("qid", "slot").distinct(), ["qid", "slot"], "left_anti")
    return empty.where(~((F.col("s_layer") == "motion") & F.col("s_party").isin(*government))).select("qid", "s_party", "s_layer")


def unseen(hits: DataFrame, shown: DataFrame) -> DataFrame:
    return hits.join(shown.select("qid", "pid"), ["qid", "pid"], "left_anti")


def pieces(hits: DataFrame, start: int = 1, argument_chars: int = K.ARGUMENT_CHARS["several_parties"]) -> DataFrame:
    """(qid, n, piece) of numbered hits (qid, n, layer, context, source, text[, argument])."""
    number = (F.col("n") + (start - 1)).cast("string")
    piece = F.concat(F.lit("\n["), number, F.lit("] "), F.upper("layer"), F.lit(" — "), F.col("context"), F.lit("\nkälla: "), F.col("source"), F.lit("\n"), F.col("text"))
    if "argument" in hits.columns:
        said = F.coalesce(F.col("argument"), F.lit(""))
        piece = F.when((F.col("layer") == "motion") & (said != ""), F.concat(piece, F.lit("\nMotivering: "), T.truncated(said, argument_chars))).otherwise(piece)
    return hits.withColumn("piece", F.concat(piece, F.lit("\n"))).select("qid", (F.col("n") + (start - 1)).alias("n"), "piece")


def within_budget(numbered: DataFrame, limit: int | None = K.MAX_CONTEXT_CHARS) -> DataFrame:
    """Pieces up to the first overflow; lengths are positive, so the running sum decides."""
    if limit is None:
        return numbered
    running = F.sum(F.length("piece")).over(Window.partitionBy("qid").orderBy("n").rowsBetween(Window.unboundedPreceding, 0))
    return numbered.withColumn("running", running).where(F.col("running") <= limit).drop("running")


def context(numbered: DataFrame) -> DataFrame:
    """(qid, context): at most a budget of characters a question, so the list is bounded."""
    own = numbered.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("n", "piece"))).alias("own"))
    return own.select("qid", F.concat(F.lit("\nHÄMTADE TEXTER\n"), F.array_join(F.transform("own", lambda p: p["piece"]), "\n")).alias("context"))


def source_list(hits: DataFrame, answers: DataFrame | None = None) -> DataFrame:
    """(qid, line_no, line) of hits (qid, n, source): a line a source with all its numbers, cited ones only if answers are given."""
    if answers is not None:
        cited = answers.select("qid", F.explode(F.array_distinct(T.cited_numbers(F.col("answer")))).alias("n"))
        hits = hits.join(cited, ["qid", "n"], "left_semi")
    own = hits.groupBy("qid", "source").agg(F.sort_array(F.collect_list("n")).alias("ns"), F.min("n").alias("first"))
    line = F.concat(F.lit("["), F.array_join(F.col("ns").cast("array<string>"), ", "), F.lit("] "), F.col("source"))
    nth = F.row_number().over(Window.partitionBy("qid").orderBy("first"))
    return own.select("qid", nth.alias("line_no"), line.alias("line"))


def history(turns: DataFrame, most: int = K.HISTORY_TURNS) -> DataFrame:
    """The last turns of each conversation (conv_id, turn, role, text), citations stripped from answers."""
    nth = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))
    text = F.when(F.col("role") == "assistant", T.without_citations(F.col("text"))).otherwise(F.col("text"))
    return turns.withColumn("nth", nth).where(F.col("nth") <= most).select("conv_id", "turn", "role", text.alias("text"))
