"""Hard negatives by a two-dimensional block matrix product (SUMMA-style).

Scores are integer inner products of quantised vectors, floor(scale * x) a
component. Rows and anchors are dealt into shards by a hash of their id (ROWS
and ANCHORS a shard, about) and their vectors into chunks of DIMS dimensions.
A row shard meets an anchor shard once for each chunk; the product of the two
is a partial score tile of 64-bit integers. Tiles of one pair of shards are
added up after a shuffle by that pair, and reduced there to the few rows that
the result can need; no score leaves its tile otherwise.

The product runs twice. First only shards of one label meet, and each anchor
keeps its best rows: its positives. Then all shards meet; an anchor's shard
carries the windows of scores that its positives open, and each window keeps its
best rows of another label.

Anchors go in rounds of at most CELLS scores, so what tiles take of the disk has
a bound that does not grow with the table. Within a tile, sums are exact: in
doubles while products stay below 2^53, else in 64-bit integers.

Defined results: rows with a null id, a null label, a null vector, or a null or
non-finite component take no part. Rows of other lengths have no inner product,
so each length is a space of its own. Rows of one id count once: the one of the
smallest label and vector. Quantised vectors longer than 2^31 take no part, as
their products pass 64 bits. Ties go to the smaller id; the window's ends belong
to it. Other columns are not read; a table without anchors gives no rows.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import byte_batches, new_path, written

POSITIVES, NEGATIVES, SCALE = 5, 3, 256
#: The window: low * positive <= 100 * negative <= high * positive.
LOW, HIGH = 50, 95
ROWS, ANCHORS, DIMS, CELLS = 4096, 256, 32, 1 << 31
TILE = "side string, i long, j long, k int, ids array<long>, labels array<long>, anchors array<long>, anchor_labels array<long>, windows array<array<long>>, positives array<array<long>>, tile binary"
FOUND = "anchor_id long, positive_id long, positive_score long, other long, score long"


def quantised(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", scale: int = SCALE) -> DataFrame:
    """(id, label, v, size) of the rows that take part, one for each id."""
    v = F.col(vector_col).cast("array<double>")
    sound = F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    own = vectors.where(sound).select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), v.alias("x"))
    whole = own.select("id", "label", F.transform("x", lambda x: F.floor(x * scale)).alias("v"), F.transform("x", lambda x: F.floor(x * scale).cast("double")).alias("d"))
    norm = F.aggregate("d", F.lit(0.0), lambda a, x: a + x * x)
    rows = whole.where(norm <= float(1 << 62)).groupBy("id").agg(F.min(F.struct("label", "v")).alias("r"))
    return rows.select("id", "r.label", "r.v", F.size("r.v").alias("size")).where("size > 0")


def _matrix(column, n: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(n, -1)


def product(rows: np.ndarray, anchors: np.ndarray) -> np.ndarray:
    """Inner products as 64-bit integers."""
    most = float(np.abs(rows).max(initial=0)) * float(np.abs(anchors).max(initial=0)) * rows.shape[1]
    if most < 1 << 53:
        return np.rint(rows.astype(float) @ anchors.astype(float).T).astype(np.int64)
    return rows @ anchors.T


def _partial(rows: pa.Table, anchors: pa.Table) -> pa.Table:
    """One chunk's tile; that of the first chunk carries ids, labels and windows."""
    kind = {"side": pa.string(), "i": pa.int64(), "j": pa.int64(), "k": pa.int32(), "ids": pa.list_(pa.int64()), "labels": pa.list_(pa.int64()), "anchors": pa.list_(pa.int64()), "anchor_labels": pa.list_(pa.int64()), "windows": pa.list_(pa.list_(pa.int64())), "positives": pa.list_(pa.list_(pa.int64())), "tile": pa.binary()}
    schema = pa.schema(list(kind.items()))
    if not rows.num_rows or not anchors.num_rows:
        return schema.empty_table()
    rows, anchors = rows.sort_by("id").combine_chunks(), anchors.sort_by("id").combine_chunks()
    x, y = (_matrix(t["v"].combine_chunks(), t.num_rows) for t in (rows, anchors))
    k = rows["k"][0].as_py()
    whole = {"ids": rows["id"], "labels": rows["label"], "anchors": anchors["id"], "anchor_labels": anchors["label"], "windows": anchors["scores"], "positives": anchors["others"]}
    out = {c: rows[c][0].as_py() for c in ("side", "i", "j", "k")} | {"tile": product(x, y).tobytes()}
    out |= {c: v.to_pylist() if k == 0 else None for c, v in whole.items()}
    return pa.Table.from_pylist([out], schema)


def _best(score: np.ndarray, at: np.ndarray, most: int) -> np.ndarray:
    """Of the places `at`, in order of id, those of the best scores, ties to the first."""
    own = score[at]
    if len(at) > most:
        top = own >= np.partition(own, len(own) - most)[len(own) - most]
        at, own = at[top], own[top]
    return at[np.argsort(-own, kind="stable")[:most]]


def _added(batches) -> tuple[dict, np.ndarray]:
    """The whole tile of a pair of shards, (anchors, rows), and the first chunk's lists; partial tiles are folded one by one."""
    total, first = None, None
    for batch in batches:
        for row in range(batch.num_rows):
            own = np.frombuffer(batch["tile"][row].as_py(), np.int64)
            total = own.copy() if total is None else np.add(total, own, out=total)
            if batch["k"][row].as_py() == 0:
                first = {c: batch[c][row].as_py() for c in ("ids", "labels", "anchors", "anchor_labels", "windows", "positives")}
    return first, np.ascontiguousarray(total.reshape(len(first["ids"]), -1).T)


def _rows(found: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*found)) or [()] * 5
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["anchor_id", "positive_id", "positive_score", "other", "score"])


def _positives(most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, score = _added(batches)
        ids, labels, found = np.array(own["ids"]), np.array(own["labels"]), []
        for n, (anchor, label) in enumerate(zip(own["anchors"], own["anchor_labels"])):
            at = np.flatnonzero((labels == label) & (ids != anchor))
            found += [(anchor, None, None, int(ids[a]), int(score[n, a])) for a in _best(score[n], at, most)]
        yield _rows(found)

    return run


def _negatives(most: int, low: int, high: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, score = _added(batches)
        ids, labels, found = np.array(own["ids"]), np.array(own["labels"]), []
        for n, (anchor, label) in enumerate(zip(own["anchors"], own["anchor_labels"])):
            other = np.flatnonzero(labels != label)
            near = score[n, other]
            for positive, p in zip(own["positives"][n], own["windows"][n]):
                # low * p <= 100 * s <= high * p, in Python's integers
                least, top = -(-low * p // 100), high * p // 100
                at = other[(near >= least) & (near <= top)] if least <= top else other[:0]
                found += [(anchor, positive, p, int(ids[a]), int(score[n, a])) for a in _best(score[n], at, most)]
        yield _rows(found)

    return run


def met(rows: DataFrame, anchors: DataFrame, reduce, shard: tuple[int, int] = (ROWS, ANCHORS), dims: int = DIMS) -> DataFrame:
    """What `reduce` keeps of each whole tile of rows (side, id, label, size, v) and anchors (with others, scores) of one side."""
    sides = rows.groupBy("side").agg(F.count("*").alias("rows")).join(anchors.groupBy("side").agg(F.count("*").alias("asks")), "side")
    sides = written(sides.select("side", F.ceil(F.col("rows") / shard[0]).alias("n_i"), F.ceil(F.col("asks") / shard[1]).alias("n_j")), "sides")
    cut = F.posexplode(F.transform(F.sequence(F.lit(0), F.floor((F.col("size") - 1) / dims).cast("int")), lambda c: F.slice("v", c * dims + 1, F.lit(dims)))).alias("k", "v")
    own = lambda n: F.pmod(F.xxhash64("id"), F.col(n))
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    left = rows.join(sides, "side").select("side", "id", "label", "size", "v", own("n_i").alias("i"), each("n_j").alias("j"))
    right = anchors.join(sides, "side").select("side", "id", "label", "size", "v", "others", "scores", own("n_j").alias("j"), each("n_i").alias("i"))
    keys = ["side", "i", "j", "k"]
    left, right = left.select("side", "i", "j", "id", "label", cut), right.select("side", "i", "j", "id", "label", "others", "scores", cut)
    left, right = (d.toDF(*d.columns) for d in (left, right))  # both stem from one table: columns of their own
    tiles = left.groupBy(keys).cogroup(right.groupBy(keys)).applyInArrow(_partial, TILE)
    return tiles.groupBy("side", "i", "j").applyInArrow(reduce, FOUND)


def hard_negatives(vectors: DataFrame, is_anchor, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, scale: int = SCALE, cells: int = CELLS, shard: tuple[int, int] = (ROWS, ANCHORS), dims: int = DIMS) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score); is_anchor: a condition on the column `id`."""
    spark = vectors.sparkSession
    byte_batches(spark)
    rows = written(quantised(vectors, id_col, vector_col, label_col, scale), "quantised")
    asking = rows.where(is_anchor)
    rounds = max(1, -(-rows.count() * asking.count() // cells))
    path = new_path(spark, "negatives")
    of_label, of_size = F.concat_ws(":", "size", "label").alias("side"), F.col("size").cast("string").alias("side")
    columns = ("id", "label", "size", "v")
    none = [F.array().cast("array<long>").alias(c) for c in ("others", "scores")]
    for n in range(rounds):
        own = asking.where(F.pmod(F.xxhash64("id", F.lit(1)), F.lit(rounds)) == n)
        near = met(rows.select(of_label, *columns), own.select(of_label, *columns, *none), _positives(positives), shard, dims)
        first = Window.partitionBy("anchor_id").orderBy(F.desc("score"), "other")
        near = near.withColumn("n", F.row_number().over(first)).where(F.col("n") <= positives)
        near = near.groupBy("anchor_id").agg(F.collect_list("other").alias("others"), F.collect_list("score").alias("scores"))
        windows = written(own.join(near, own.id == near.anchor_id).select(of_size, *columns, "others", "scores"), "windows")
        met(rows.select(of_size, *columns), windows, _negatives(negatives, low, high), shard, dims).write.mode("append").parquet(path)
    best = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("score"), "other")
    found = spark.read.schema(FOUND).parquet(path).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= negatives)
    return found.select("anchor_id", "positive_id", "rank", F.col("other").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


ORACLE = """
WITH own AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scores AS (
  SELECT a.vec_id AS anchor_id, a.label AS anchor_label, r.vec_id AS id, r.label AS label,
         CAST(list_sum(list_transform(list_zip(a.v, r.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM own a JOIN own r ON a.vec_id % 50 = 0 AND r.vec_id <> a.vec_id AND len(a.v) = len(r.v)
), positives AS (
  SELECT anchor_id, anchor_label, id AS positive_id, score AS positive_score FROM scores WHERE label = anchor_label
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
)
SELECT anchor_id, positive_id, CAST(row_number() OVER pick AS INT) AS rank, s.id AS negative_id, positive_score, s.score AS negative_score
FROM positives p JOIN scores s USING (anchor_id)
WHERE s.label <> p.anchor_label AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score
WINDOW pick AS (PARTITION BY anchor_id, positive_id ORDER BY s.score DESC, s.id)
QUALIFY row_number() OVER pick <= 3
"""
