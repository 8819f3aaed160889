"""Retrieval and answer metrics."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import text as T
from ..tables import written


#: Conditions of a relevance rule; a null or empty one holds for every hit.
CONDITIONS = ("layer", "party", "number", "session", "topic", "body")


def rules(questions: DataFrame) -> DataFrame:
    """(qid, layer, party, number, session, topic, body) of a question file: a row a question, null where its rule has no such condition."""
    text = lambda c: F.nullif(F.col(f"relevant.{c}"), F.lit(""))
    some = lambda c: F.when(F.size(F.col(f"relevant.{c}")) > 0, F.col(f"relevant.{c}"))
    return questions.select(F.col("id").alias("qid"), text("layer").alias("layer"), some("parti").alias("party"), some("beteckning").alias("number"), some("rm").alias("session"), text("sakfraga_regex").alias("topic"), text("text_regex").alias("body"))


def searches(questions: DataFrame, k: int = 10) -> DataFrame:
    """(qid, k, layer, party, per_party) of a question file: how each question is searched."""
    own = F.col("sok.parti")
    return questions.select(F.col("id").alias("qid"), F.coalesce("sok.k", F.lit(k)).alias("k"), F.nullif(F.col("sok.layer"), F.lit("")).alias("layer"), F.when(F.size(own) > 0, own).alias("party"), F.nullif(F.col("sok.per_parti"), F.lit(0)).alias("per_party"))


def judged(hits: DataFrame, rules: DataFrame) -> DataFrame:
    """hits (qid, layer, party, number, session, topic, context, text, ...) with `flag`: are they relevant by the rule of their question?

    All conditions of a rule must hold; patterns are looked for whatever the
    case. A question without a rule, or whose rule has no condition, has no
    relevant hits.
    """
    own = rules.select("qid", *[F.col(c).alias(f"__{c}") for c in CONDITIONS])
    r = {c: F.col(f"__{c}") for c in CONDITIONS}
    found = lambda text, pattern: F.regexp_like(text, F.concat(F.lit("(?iu)"), pattern))
    blob = F.concat(F.coalesce("context", F.lit("")), F.lit(" "), F.coalesce("text", F.lit("")))
    holds = {
        "layer": F.col("layer") == r["layer"],
        "party": F.arrays_overlap(T.split_set(F.coalesce("party", F.lit(""))), r["party"]),
        "number": F.array_contains(r["number"], F.col("number")),
        "session": F.array_contains(r["session"], F.col("session")),
        "topic": found(F.coalesce("topic", F.lit("")), r["topic"]),
        "body": found(blob, r["body"]),
    }
    flag = F.lit(False)
    for c in r.values():
        flag = flag | c.isNotNull()
    for c, own_holds in holds.items():
        flag = flag & (r[c].isNull() | F.coalesce(own_holds, F.lit(False)))
    return hits.join(own, "qid", "left").withColumn("flag", flag).drop(*[f"__{c}" for c in CONDITIONS])


def retrieval_run(ranking: DataFrame, passages: DataFrame, searches: DataFrame) -> DataFrame:
    """Hits (qid, pid, score, rank, layer, party, context) of all questions of a fused ranking, by each question's own search (qid, k, layer, party, per_party).

    Layer and parties filter the ranking, then the first k stay; with per_party
    a passage goes only if all its parties have so many already.
    """
    meta = passages.select("pid", "layer", "party", "context")
    own = searches.select("qid", "k", F.col("layer").alias("__layer"), F.col("party").alias("__party"), "per_party")
    keep = (F.col("__layer").isNull() | (F.col("layer") == F.col("__layer"))) & (F.col("__party").isNull() | F.arrays_overlap(T.split_set(F.col("party")), F.col("__party")))
    hits = ranking.join(own, "qid").join(meta, "pid").where(F.coalesce(keep, F.lit(False)))
    by = lambda *of: F.row_number().over(Window.partitionBy("qid", *of).orderBy("rank"))
    # of a set of parties the greedy choice takes at most per_party passages, so only so many go to Python
    few = F.when(F.col("per_party").isNull(), F.col("nth") <= F.col("k")).otherwise(F.col("__of") <= F.col("per_party"))
    # written: what is left is small, and both kinds of search read it
    slim = written(hits.withColumn("nth", by()).withColumn("__of", by("party")).where(few).drop("__of"), "slim")
    free = slim.where("per_party IS NULL")

    def greedy(pdf):
        taken: dict[str, int] = {}
        keep = []
        for i, row in pdf.sort_values("rank").iterrows():
            parties = [p for p in (row.party or "").split(";") if p] or ["—"]
            if len(keep) < row.k and any(taken.get(p, 0) < row.per_party for p in parties):
                keep.append(i)
                for p in parties:
                    taken[p] = taken.get(p, 0) + 1
        return pdf.loc[keep].assign(nth=range(1, len(keep) + 1))

    capped = slim.where("per_party IS NOT NULL").groupBy("qid").applyInPandas(greedy, free.schema)
    return free.unionByName(capped).select("qid", "pid", "score", F.col("nth").cast("int").alias("rank"), "layer", "party", "context")


def retrieval_metrics(judged: DataFrame) -> DataFrame:
    """(qid, precision, reciprocal_rank, false_hits, top_context) of judged hits (qid, rank, flag, context)."""
    return judged.groupBy("qid").agg(
        F.avg(F.col("flag").cast("double")).alias("precision"),
        F.coalesce(F.max(F.when(F.col("flag"), 1.0 / F.col("rank"))), F.lit(0.0)).alias("reciprocal_rank"),
        F.count_if(~F.col("flag")).alias("false_hits"),
        F.min_by("context", "rank").alias("top_context"),
    )


def coverage(judged: DataFrame, expected: Column) -> DataFrame:
    """(qid, covered, missing, unexpected): parties of relevant hits against those expected."""
    own = F.array_distinct(F.flatten(F.collect_list(F.when(F.col("flag"), T.split_set(F.col("party"))))))
    out = judged.groupBy("qid").agg(own.alias("own"))
    both = F.array_intersect("own", expected)
    return out.select("qid", (F.size(both) / F.size(expected)).alias("covered"), F.array_join(F.array_sort(F.array_except(expected, "own")), ",").alias("missing"), F.array_join(F.array_sort(F.array_except("own", expected)), ",").alias("unexpected"))


def exclusive_p90(sorted_values: Column) -> Column:
    """The ninth decile by the exclusive method; one value is itself."""
    n = F.size(sorted_values)
    at = F.greatest(F.lit(1), F.least(n - 1, F.floor(9 * (n + 1) / 10).cast("int")))
    d = 9 * (n + 1) - 10 * at
    v = lambda i: F.get(sorted_values, i - 1)
    return F.when(n == 1, v(F.lit(1))).otherwise((v(at) * (10 - d) + v(at + 1) * d) / 10)


def latency(rows: DataFrame, by: str, value: str) -> DataFrame:
    """Median and exclusive p90 by group, whatever the group's size.

    Values are counted first (equal ones combine before the shuffle) and
    range-sorted by (group, value); each range has a running total, and ranges'
    totals, few, say where it starts. Only the values at the wanted places are kept.
    """
    counted = rows.select(by, value).where(F.col(value).isNotNull()).groupBy(by, value).agg(F.count("*").alias("c"))
    ranged = written(counted.repartitionByRange(by, value).withColumn("part", F.spark_partition_id()), "latency")
    parts = ranged.groupBy(by, "part").agg(F.sum("c").alias("size"))
    before = Window.partitionBy(by).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(by)
    parts = parts.withColumn("before", F.coalesce(F.sum("size").over(before), F.lit(0))).withColumn("n", F.sum("size").over(whole)).drop("size")
    last = F.sum("c").over(Window.partitionBy(by, "part").orderBy(value))
    own = ranged.withColumn("last", last).join(parts, [by, "part"])
    at = F.greatest(F.lit(1), F.least(F.col("n") - 1, F.floor(9 * (F.col("n") + 1) / 10)))
    own = own.withColumn("at", at).withColumn("last", F.col("last") + F.col("before"))
    holds = lambda place: F.max(F.when((F.col("last") >= place) & (F.col("last") - F.col("c") < place), F.col(value)))
    low, high = F.floor((F.col("n") + 1) / 2), F.floor(F.col("n") / 2) + 1
    two = own.groupBy(by, "n", "at").agg(holds(low).alias("m1"), holds(high).alias("m2"), holds(F.col("at")).alias("low"), holds(F.col("at") + 1).alias("high"))
    d = 9 * (F.col("n") + 1) - 10 * F.col("at")
    p90 = F.when(F.col("n") == 1, F.col("low")).otherwise((F.col("low") * (10 - d) + F.col("high") * d) / 10)
    return two.select(by, "n", ((F.col("m1") + F.col("m2")) / 2).alias("p50"), p90.alias("p90"))


def pooled(parts: DataFrame, by: str) -> DataFrame:
    """Citation coverage pooled over sentences (by, cited, claims)."""
    return parts.groupBy(by).agg(F.sum("cited").alias("cited"), F.sum("claims").alias("claims"), (F.sum("cited") / F.nullif(F.sum("claims"), F.lit(0))).alias("coverage"))


#: What answer_metrics needs besides qid, config and answer, and what holds where a table lacks it.
METRIC_INPUTS = {
    "hits": "array<struct<n:int,layer:string,parti:string>>", "expected": "array<string>", "layers": "array<string>", "attribution": "string",
    "expect_gap": "boolean", "expect_refusal": "boolean", "lang": "string", "latency_s": "double", "api_calls": "int",
}


def answer_metrics(rows: DataFrame) -> DataFrame:
    """A row of metrics for each answer (qid, config, answer, and any of METRIC_INPUTS); one that does not apply is null.

    An answer without retrieval has no citations to check. Attribution is a
    pattern of the question; everything is one projection.
    """
    for name, kind in METRIC_INPUTS.items():
        if name not in rows.columns:
            rows = rows.withColumn(name, F.lit(None).cast(kind))
    answer = F.col("answer")
    own = rows.withColumn("cited", T.cited_numbers(answer)).withColumn("sentences", F.filter(T.sentences(answer), T.substantive))
    own = own.withColumn("hits", F.coalesce("hits", F.array().cast(METRIC_INPUTS["hits"]))).withColumn("ns", F.transform("hits", lambda h: h["n"]))
    own = own.withColumn("valid", F.filter("cited", lambda n: F.array_contains("ns", n)))
    own = own.withColumn("used", F.filter("hits", lambda h: F.array_contains("valid", h["n"])))
    parties = F.array_distinct(F.flatten(F.transform("used", lambda h: T.split_set(h["parti"]))))
    used_layers = F.array_distinct(F.transform("used", lambda h: h["layer"]))
    expects = F.size(F.coalesce("expected", F.array().cast("array<string>"))) > 0
    share = lambda found: F.size(F.array_intersect(F.array_distinct("expected"), found)) / F.size(F.array_distinct("expected"))
    retrieved = F.col("config") != "no_rag"
    claims = F.size("sentences") > 0
    return own.select(
        "qid", "config", "latency_s", "api_calls",
        (~answer.startswith("[no answer")).alias("answered"),
        F.when(retrieved & (F.size("cited") > 0), F.size("valid") / F.size("cited")).alias("citation_validity"),
        F.when(claims, F.size(F.filter("sentences", lambda s: s.rlike(K.CITATION)))).alias("cited_claims"),
        F.when(claims, F.size("sentences")).alias("claims"),
        F.when(expects, share(T.mentioned(answer))).alias("party_mentioned"),
        F.when(expects, share(parties)).alias("party_cited"),
        F.when(expects, F.array_sort(F.array_except("expected", parties))).alias("missing_parties"),
        F.when(F.size(F.coalesce("layers", F.array().cast("array<string>"))) > 0, F.arrays_overlap("layers", F.coalesce(used_layers, F.array().cast("array<string>")))).alias("layer_cited"),
        F.when(F.coalesce("attribution", F.lit("")) != "", F.regexp_like(answer, F.concat(F.lit("(?iu)"), "attribution"))).alias("attribution_found"),
        F.when(F.col("expect_gap"), answer.rlike(f"(?iu){K.GAP}")).alias("gap_acknowledged"),
        F.when(F.col("expect_refusal"), answer.rlike(f"(?iu){K.REFUSAL}")).alias("refused"),
        (T.language(answer) == F.coalesce("lang", F.lit("sv"))).alias("language_ok"),
        F.when(retrieved, F.array_sort(F.array_distinct(F.array_except("cited", "ns")))).otherwise(F.array().cast("array<int>")).alias("invalid_citations"),
    )


def problem_flags(m: DataFrame) -> Column:
    """Short flags of a metrics row, joined."""
    listed = lambda c: F.array_join(F.col(c).cast("array<string>"), ",")
    unmet = lambda c: ~F.coalesce(c, F.lit(True))
    flags = F.array(
        F.when(~F.col("answered"), "no answer"),
        F.when(F.size("invalid_citations") > 0, F.concat(F.lit("invalid citation "), listed("invalid_citations"))),
        F.when(F.size(F.coalesce("missing_parties", F.array().cast("array<string>"))) > 0, F.concat(F.lit("no source for "), listed("missing_parties"))),
        F.when(unmet("layer_cited"), "expected source type not cited"),
        F.when(unmet("attribution_found"), "attribution wording missing"),
        F.when(unmet("gap_acknowledged"), "gap not acknowledged"),
        F.when(unmet("refused"), "no refusal phrase"),
        F.when(~F.col("language_ok"), "wrong language"),
    )
    return F.array_join(F.array_compact(flags), "; ")


def latest(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last row of each key: a max over structs, combined before the shuffle."""
    rest = [c for c in rows.columns if c not in keys and c != order]
    return rows.groupBy(*keys).agg(F.max(F.struct(order, *rest)).alias("last")).select(*keys, "last.*")


def worklist(questions: DataFrame, configs: list[str], answered: DataFrame, only: list[str] | None = None, redo: bool = False, limit: int | None = None) -> DataFrame:
    """(config, id, ...) still to ask, in order of configs, then questions (id, ord, ...); answered (config, id) are left out unless `redo`."""
    spark = questions.sparkSession
    listed = spark.createDataFrame(list(enumerate(configs)), "c_ord int, config string")
    out = (questions.where(F.col("id").isin(only)) if only is not None else questions).crossJoin(F.broadcast(listed))
    if not redo:
        out = out.join(answered.select("config", "id").distinct(), ["config", "id"], "left_anti")
    out = out.orderBy("c_ord", "ord")
    return (out if limit is None else out.limit(limit)).drop("c_ord")


def with_parent(questions: DataFrame, answered: DataFrame) -> DataFrame:
    """Questions (id, follows, ...) of each config with the parent's answer; a follow-up whose parent has none is left out."""
    parents = answered.select("config", F.col("id").alias("follows"), F.col("answer").alias("parent_answer"))
    firsts = questions.where("follows IS NULL").withColumn("config", F.lit(None).cast("string")).withColumn("parent_answer", F.lit(None).cast("string"))
    return firsts.unionByName(questions.where("follows IS NOT NULL").join(parents, "follows").select(*firsts.columns))


def append_results(rows: DataFrame, path: str) -> None:
    """Adds rows to a result log; the last row of a key counts when it is read."""
    rows.write.mode("append").json(path)


def compact_hits(hits: DataFrame) -> DataFrame:
    """(qid, hits): what metrics need of numbered hits (qid, n, layer, party, context, similarity), a few dozen a question."""
    own = F.struct("n", "layer", F.col("party").alias("parti"), F.col("context").alias("kontext"), F.round("similarity", 3).alias("similarity"))
    return hits.groupBy("qid").agg(F.array_sort(F.collect_list(own)).alias("hits"))


def filter_hits(questions: DataFrame, question: str = "question", expect_refusal: str = "expect_refusal") -> DataFrame:
    """(advice, flagged_advice, others, flagged_others): how the voting-advice pattern does on questions that ask for it, and on others."""
    flagged, asks = T.asks_for_voting_advice(F.col(question)), F.coalesce(F.col(expect_refusal), F.lit(False))
    return questions.agg(F.count_if(asks).alias("advice"), F.count_if(asks & flagged).alias("flagged_advice"), F.count_if(~asks).alias("others"), F.count_if(~asks & flagged).alias("flagged_others"))


def passage_counts(passages: DataFrame) -> DataFrame:
    """(layer, party, subtype, n) at three grains in one pass; what a grain leaves out is null."""
    own = passages.groupingSets([["layer"], ["layer", "party"], ["layer", "subtype"]], "layer", "party", "subtype")
    return own.agg(F.grouping_id().alias("grain"), F.count("*").alias("n"))


def best_sections(proposals: DataFrame, sections: DataFrame, least: float = K.MIN_MATCH) -> DataFrame:
    """Each proposal (doc, nr, text) with the section (doc, pos, heading, body) that holds most of its words; strict best, first wins."""
    left = proposals.select("doc", "nr", T.match_words(F.col("text")).alias("y"))
    right = sections.select("doc", "pos", "heading", "body", T.match_words(F.concat_ws(" ", "heading", "body")).alias("s")).where(F.size("s") > 0)
    pairs = left.join(right, "doc", "left").withColumn("match", F.coalesce(F.size(F.array_intersect("y", "s")) / F.nullif(F.size("y"), F.lit(0)), F.lit(0.0)))
    best = pairs.withColumn("r", F.row_number().over(Window.partitionBy("doc", "nr").orderBy(F.desc("match"), "pos"))).where("r = 1")
    good = F.col("match") >= least
    return best.select("doc", "nr", F.col("match").alias("match_score"), F.when(good, F.col("heading")).otherwise("").alias("heading"), F.when(good, F.col("body")).otherwise("").alias("section_text"))
