"""Mixing sources to target weights by weighted fair queueing.

Each source is a queue: its documents, shuffled anew for each of up to
`most` passes (order: md5 of document id and pass). A queued copy's virtual
finish time is its source's cumulative size divided by the source's target; the
copies of all sources are served by finish time until the total budget is used
up. Targets add up to the budget (as far as the caps allow), so that happens at
virtual time 1: a copy that would finish later is served up to there, that is,
its last words are cut. A document is thus taken up to `most` times its size.

Targets: shares of the budget in proportion to weight, stopped at `most` times
the source's own size; the excess is shared out again by weight until no
target is above its cap (water filling: target = min(cap, weight * level)).

Prefix sums have two levels (source and 1/256 of the shuffle order, then within
it), so no source is gathered in one task, however large it is.

Defined results: a null text has size 0, takes nothing and is kept with taken
0; a null source is a source of its own and comes last; repeated rows are
separate queue entries, ties in the shuffle order are broken by id, then size.
A table without words gives targets of 0.
"""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import n_words, written

WEIGHTS = (5.0, 2.0, 1.0)
BINS = 256


def targets(sizes: DataFrame, weights=WEIGHTS, most: int = 3, budget: int | None = None) -> DataFrame:
    """(source, source_size, target) from (source, size); one row per source.

    The windows have one row per source, after the sums by source.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_code = Window.orderBy(F.col("source").asc_nulls_last())
    nth = F.pmod(F.row_number().over(by_code) - 1, F.lit(len(weights)))
    per = per.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (nth + 1).cast("int")))
    every = Window.partitionBy()
    cap = F.col("source_size") * F.lit(most)
    by_fill = Window.orderBy(F.col("ratio"), F.col("source").asc_nulls_last())
    per = per.withColumn("cap", cap).withColumn("ratio", cap / F.col("weight"))
    per = per.withColumn("budget", F.lit(budget) if budget is not None else F.sum("source_size").over(every))
    before = by_fill.rowsBetween(Window.unboundedPreceding, -1)
    after = by_fill.rowsBetween(0, Window.unboundedFollowing)
    # were this source the first uncapped one, this would be the level
    level = (F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0))) / F.sum("weight").over(after)
    per = per.withColumn("level", level)
    # from the first uncapped source on, levels do not rise: the largest that fits is its
    top = F.max(F.when(F.col("level") <= F.col("ratio"), F.col("level"))).over(every)
    per = per.withColumn("top", top)
    target = F.when(F.col("top").isNull(), F.col("cap").cast("double")).otherwise(F.least(F.col("cap").cast("double"), F.col("weight") * F.col("top")))
    return per.select("source", "source_size", target.alias("target"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS, most: int = 3, budget: int | None = None) -> DataFrame:
    """A row per row of docs: id, source, size, source_size, target, taken, first_finish (virtual time of its first copy), range-sorted by the last."""
    sizes = written(docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), n_words(F.col(text_col)).alias("size")), "sizes")
    goal = targets(sizes, weights, most, budget)
    queue = sizes.withColumn("turn", F.explode(F.sequence(F.lit(0), F.lit(most - 1))))
    order = F.md5(F.concat(F.coalesce(F.col("id").cast("string"), F.lit("null")), F.lit(":"), F.col("turn").cast("string")).cast("binary"))
    queue = queue.withColumn("place", order)
    queue = queue.withColumn("bin", F.conv(F.substring("place", 1, 2), 16, 10).cast("int"))
    sums = queue.groupBy("source", "turn", "bin").agg(F.sum("size").alias("bin_size"))
    earlier = Window.partitionBy("source").orderBy("turn", "bin").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("before", F.coalesce(F.sum("bin_size").over(earlier), F.lit(0))).drop("bin_size")
    starts = sums.join(goal, sums.source.eqNullSafe(goal.source)).select(sums.source.alias("s"), F.col("turn").alias("t"), F.col("bin").alias("b"), "before", "source_size", "target")
    queue = queue.join(starts, queue.source.eqNullSafe(F.col("s")) & (queue.turn == F.col("t")) & (queue.bin == F.col("b")))
    # within a bin, the running sum of copies up to and with this one
    within = Window.partitionBy("source", "turn", "bin").orderBy("place", "id", "size").rowsBetween(Window.unboundedPreceding, 0)
    queue = queue.withColumn("end", F.col("before") + F.sum("size").over(within))
    queue = queue.withColumn("finish", F.when(F.col("target") > 0, F.col("end") / F.col("target")))
    quota = F.floor(F.col("target") + F.lit(1e-6))
    served = F.greatest(F.lit(0), F.least(F.col("size"), quota - (F.col("end") - F.col("size"))))
    queue = queue.withColumn("served", served.cast("long"))
    keys = ["id", "source", "size", "source_size", "target"]
    # one row per row of docs: repeated rows are told apart by their number within the turn
    nth = F.row_number().over(Window.partitionBy("source", "turn", "bin", "place", "id", "size").orderBy("end"))
    taken = queue.withColumn("nth", nth).groupBy(*keys, "nth").agg(F.sum("served").alias("taken"), F.min("finish").alias("first_finish"))
    taken = taken.orderBy(F.asc_nulls_last("first_finish"), "id", "source", "size")  # a global range sort
    return taken.select(F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target", "taken", "first_finish")


ORACLE = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents
), per AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INT)] AS weight
  FROM sized GROUP BY source
), ratio AS (
  SELECT *, 3 * source_size AS cap, 3 * source_size / weight AS r, sum(source_size) OVER () AS budget FROM per
), levels AS (
  SELECT *, (budget - coalesce(sum(cap) OVER (ORDER BY r, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
       / sum(weight) OVER (ORDER BY r, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM ratio
), goal AS (
  SELECT source, source_size, least(cast(cap AS DOUBLE), weight * coalesce(max(level) FILTER (level <= r) OVER (), 1e300)) AS target FROM levels
), queue AS (
  SELECT s.doc_id, s.source, s.size, t.turn, md5(coalesce(cast(s.doc_id AS VARCHAR), 'null') || ':' || t.turn) AS place
  FROM sized s, range(3) t(turn)
), ends AS (
  SELECT q.*, source_size, target, sum(size) OVER (PARTITION BY q.source ORDER BY turn, place, q.doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS ended
  FROM queue q JOIN goal g ON q.source IS NOT DISTINCT FROM g.source
)
SELECT doc_id, size, source_size, target, CAST(sum(greatest(0, least(size, floor(target + 1e-6) - (ended - size)))) AS BIGINT) AS taken
FROM ends GROUP BY doc_id, size, source_size, target
"""
