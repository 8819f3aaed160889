"""From hits to an answer: contexts, prompts, numbers across searches, sources and links.

All are column expressions and joins over hits, for one question or many; the
conversation with a language model is the caller's.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import text as T
from . import retrieve as R

#: Columns of passages that source lines use; a table without one has empty values.
FIELDS = ("rm", "beteckning", "datum", "doc_type", "page", "doc_title", "parti", "year", "heading", "url", "lastmod", "undertecknare", "subtype")


def with_fields(hits: DataFrame) -> DataFrame:
    return hits.select("*", *[F.lit(None).cast("string").alias(c) for c in FIELDS if c not in hits.columns])


def _or(name: str, default: str = "") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(default))


def by_layer(motion: Column, proposition: Column, program: Column, other: Column) -> Column:
    layer = F.col("layer")
    return F.when(layer == "motion", motion).when(layer == "proposition", proposition).when(layer == "program", program).otherwise(other)


def context_source() -> Column:
    """How a context names a passage's source."""
    single = R.individual(F.col("layer"), F.col("subtype"), F.col("undertecknare"))
    signed = F.when(single, F.concat(F.lit(" (enskild motion, "), F.replace(_or("undertecknare"), F.lit(";"), F.lit(", ")), F.lit(")"))).otherwise("")
    return by_layer(
        F.concat(F.lit("motion "), _or("beteckning"), F.lit(" "), _or("rm"), signed),
        F.concat(F.lit("prop. "), _or("rm"), F.lit(":"), _or("beteckning"), F.lit(", "), _or("datum")),
        F.concat(_or("doc_type", "partiprogram"), F.lit(", s. "), _or("page", "None")),
        _or("url"),
    )


def listed_source() -> Column:
    """How a source list names it, with what the source is called."""
    party = F.when(_or("parti") == "", F.lit("?")).otherwise(F.col("parti"))
    year = F.when(_or("year", "0") != "0", F.concat(F.lit(" "), _or("year"))).otherwise("")
    edited = F.when(_or("lastmod") != "", F.concat(F.lit(" (last edited "), F.left(_or("lastmod"), F.lit(10)), F.lit(")"))).otherwise("")
    named = lambda *parts: F.regexp_replace(F.concat(*parts), "[ –]+$", "")
    number = [_or("rm"), F.lit(":"), _or("beteckning")]
    return by_layer(
        named(F.lit("motion "), *number, F.lit(" ("), party, F.lit(") – "), _or("doc_title")),
        named(F.lit("prop. "), *number, F.lit(" (regeringen: M, KD, L) – "), _or("doc_title")),
        named(_or("doc_type", "partiprogram"), F.lit(" ("), F.replace(_or("parti"), F.lit(";"), F.lit(", ")), F.lit(")"), year, F.lit(", p. "), _or("page", "None"), F.lit(" – "), _or("heading")),
        F.concat(_or("url"), edited),
    )


def prompt_context(hits: DataFrame, gaps: DataFrame | None = None, start: int = 1, argument_chars: int = K.ARGUMENT_CHARS["several_parties"], limit: int | None = K.MAX_CONTEXT_CHARS) -> DataFrame:
    """(qid, context) of numbered hits (qid, n, layer, context, text, sektion_text, ...) and gaps (qid, s_party, s_layer)."""
    own = with_fields(hits).withColumn("source", context_source())
    if "sektion_text" in own.columns:
        own = own.withColumn("argument", F.col("sektion_text"))
    out = R.context(R.within_budget(R.pieces(own, start, argument_chars), limit))
    if gaps is None:
        return out
    names = F.create_map(*[F.lit(x) for kv in K.PARTIES.items() for x in kv])
    layers = F.create_map(*[F.lit(x) for kv in K.LAYER_NAMES.items() for x in kv])
    line = F.concat(F.lit("- "), F.coalesce(F.try_element_at(names, F.col("s_party")), "s_party"), F.lit(" ("), "s_party", F.lit("): "), F.coalesce(F.try_element_at(layers, F.col("s_layer")), "s_layer"))
    place = F.struct(F.array_position(F.lit(list(K.PARTIES)), F.col("s_party")).alias("p"), F.array_position(F.lit(list(K.LAYERS)), F.col("s_layer")).alias("l"), line.alias("line"))
    # at most parties * layers lines a question
    lines = gaps.groupBy("qid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(place)), lambda x: x["line"]), "\n").alias("lines"))
    both = out.join(lines, "qid", "full_outer")
    empty = F.lit("\nHÄMTADE TEXTER")
    return both.select("qid", F.concat(F.coalesce("context", empty), F.when(F.col("lines").isNotNull(), F.concat(F.lit(f"\n\n{K.GAPS_TITLE}\n"), "lines")).otherwise("")).alias("context"))


def prompt(context: Column, question: Column) -> Column:
    """The one turn of a question with its context; a question for voting advice gets a note."""
    note = F.when(T.asks_for_voting_advice(question), F.lit(K.VOTING_ADVICE_NOTE)).otherwise("")
    return F.concat(F.lit("KONTEXT\n"), context, F.lit("\n\nSLUT PÅ KONTEXT"), note, F.lit("\n\nFRÅGA: "), question)


def numbered_calls(hits: DataFrame) -> DataFrame:
    """Hits of several searches of a question (qid, call, rank, pid, ...): shown once, where first found, and numbered on across searches."""
    first = Window.partitionBy("qid", "pid").orderBy("call", "rank")
    own = hits.withColumn("__seen", F.row_number().over(first)).where("__seen = 1").drop("__seen")
    return own.withColumn("n", F.row_number().over(Window.partitionBy("qid").orderBy("call", "rank")))


def links(hits: DataFrame, answers: DataFrame) -> DataFrame:
    """(qid, n, url): a link a URL for cited passages (qid, n, url), by its smallest number; http and https with a host only."""
    cited = answers.select("qid", F.explode(F.array_distinct(T.cited_numbers(F.col("answer")))).alias("n"))
    own = hits.join(cited, ["qid", "n"], "left_semi").where(F.col("url").rlike(r"(?i)^https?://[^/?#\s]+"))
    return own.groupBy("qid", "url").agg(F.min("n").alias("n")).select("qid", "n", "url")


def cited_sources(sources: Column, answer: Column) -> Column:
    """Those lines of a source list whose numbers an answer cites."""
    head = lambda s: F.concat(F.substring_index(s, "]", 1), F.lit("]"))
    return F.filter(sources, lambda s: F.arrays_overlap(T.cited_numbers(answer), T.cited_numbers(head(s))))
