"""Approximate nearest neighbours by cross-polytope hashing.

A vector is padded to a power of two and rotated by three rounds of random
signs and a fast Hadamard transform; a rotation's code is the nearest signed
axis. Each of `tables` tables has some rotations, whose codes together are the
bucket. A query probes, in each table, the buckets nearest to it: those with the
least sum of squared gaps to the nearest axes.

Rotations and probes are fitted (`fitted`): for a sample of at most SAMPLED
queries the exact neighbours among all rows are found, and with them the number
of probes at which TARGET of them are met, for each number of rotations. Of
those the cheapest is taken, by the share of a sample of at most ROW_SAMPLE rows
that such probes meet. One rotation with all its axes probed meets everything,
so some choice always reaches the target; the nearer neighbours are, as they are
in larger tables, the more rotations pay and the fewer rows are candidates.

Rows and probes meet in a shuffle join by table and head (all codes of a bucket
but the last). Heads with many rows or probes, however hot, are cut into blocks
of at most ROWS rows and ASKED queries, so a task's memory is bounded. In a
block each query looks up its buckets, and what they hold are its candidates:
they are reranked by exact cosine in double precision, and the best k + 1 leave
the block. What the tables found is made one by its largest score, and ranked.
A query with fewer than k found is searched exactly, in blocks of at most
`block` queries that are broadcast against all rows.

Equal vectors are hashed and scored once, with their k + 1 smallest ids, which
is all that ties can bring into a result; a vector that a third of all rows
share costs no more than another.

Defined results: null, empty or zero vectors, and those with null or non-finite
components, take no part, nor do rows without an id. Vectors are near only to
vectors of their own length; each length is searched by itself, those of at most
FEW different vectors together, exactly. A vector is scaled by a power of two
before its squares are taken, so that none is too large or small. Rows that
share a query's id are its own. Other columns are not read; an empty table gives
no rows.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import new_path, written

TABLES, BLOCK, K, FEW = 16, 4096, 5, 64
#: Rotations to choose from, the most probes of a table, the share of neighbours to be met, and the samples' sizes.
HASHES, PROBES, TARGET, SAMPLED, ROW_SAMPLE = (1, 2, 3, 4), 1024, 0.95, 48, 2048
#: Distinct vectors and queries of a block of a head.
ROWS, ASKED = 8192, 2048
FOUND = "class long, vec_id long, score double"


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of the rows."""
    n, d = x.shape
    h = 1
    while h < d:
        x = x.reshape(n, d // (2 * h), 2, h)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], axis=2).reshape(n, d)
        h *= 2
    return x


class Hasher:
    """`tables` tables of `hashes` rotations each; a code is one of 2 * padded signed axes."""

    def __init__(self, size: int, tables: int = TABLES, hashes: int = 2, seed: int = 7):
        self.size, self.padded, self.tables, self.hashes = size, 1 << max(0, (size - 1).bit_length()), tables, hashes
        self.axes = 2 * self.padded
        self.signs = np.random.default_rng(seed).choice([-1.0, 1.0], (tables, hashes, 3, self.padded))

    def rotated(self, x: np.ndarray, table: int, nth: int) -> np.ndarray:
        """Rows' coordinates along all signed axes."""
        x = np.pad(x, ((0, 0), (0, self.padded - self.size)))
        for signs in self.signs[table, nth]:
            x = hadamard(x * signs) / np.sqrt(self.padded)
        return np.concatenate([x, -x], axis=1)

    def codes(self, x: np.ndarray, table: int) -> np.ndarray:
        """The bucket of each row, its codes in mixed radix."""
        out = np.zeros(len(x), np.int64)
        for nth in range(self.hashes):
            out = out * self.axes + self.rotated(x, table, nth).argmax(axis=1)
        return out

    def probed(self, x: np.ndarray, table: int, probes: int) -> np.ndarray:
        """(rows, probes): the nearest buckets, nearest first. The best sums have prefixes among the best sums."""
        codes, gaps = np.zeros((len(x), 1), np.int64), np.zeros((len(x), 1))
        for nth in range(self.hashes):
            r = self.rotated(x, table, nth)
            own = (r.max(axis=1, keepdims=True) - r) ** 2
            codes = (codes[:, :, None] * self.axes + np.arange(self.axes)).reshape(len(x), -1)
            gaps = (gaps[:, :, None] + own[:, None, :]).reshape(len(x), -1)
            if gaps.shape[1] > probes:
                best = np.argpartition(gaps, probes - 1, axis=1)[:, :probes]
                codes, gaps = np.take_along_axis(codes, best, 1), np.take_along_axis(gaps, best, 1)
        return np.take_along_axis(codes, np.argsort(gaps, axis=1, kind="stable"), 1)


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows times a power of two that brings their largest component to between a half and one."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, initial=0, keepdims=True))[1])


def _matrix(column) -> np.ndarray:
    return scaled(np.asarray(column.flatten().to_numpy(zero_copy_only=False), float).reshape(len(column), -1))


def first_probes(hasher: Hasher, queries: np.ndarray, rows: np.ndarray, probes: int) -> np.ndarray:
    """(queries, rows): at which probe, counted from 0, a query meets a row in some table; `probes` if in none. rows: the same for all queries, or some for each."""
    out = np.full((len(queries), rows.shape[-2]), probes)
    for t in range(hasher.tables):
        codes = hasher.codes(rows.reshape(-1, rows.shape[-1]), t).reshape(rows.shape[:-1])
        for at in range(0, len(queries), 8):
            for n, own in enumerate(hasher.probed(queries[at : at + 8], t, probes), at):
                order = np.argsort(own)
                seek = codes if codes.ndim == 1 else codes[n]
                place = np.minimum(np.searchsorted(own[order], seek), len(own) - 1)
                met = own[order][place] == seek
                out[n, met] = np.minimum(out[n, met], order[place[met]])
    return out


def fitted(queries: np.ndarray, near: np.ndarray, rows: np.ndarray, n_rows: int, tables: int = TABLES, hashes=HASHES, probes: int = PROBES, target: float = TARGET) -> tuple[Hasher, int]:
    """The hasher and probes that meet `target` of the neighbours near (queries, k, size) at the least cost a query."""
    size = queries.shape[1]
    best, least, hasher = None, np.inf, None
    for n in hashes:
        hasher = Hasher(size, tables, n)
        most = min(probes, hasher.axes**n) if n > 1 else hasher.axes
        at = np.sort(first_probes(hasher, queries, near, most), axis=None)
        need = int(at[int(np.ceil(target * len(at))) - 1]) + 1 if len(at) else 1
        if need > most:
            continue
        share = (first_probes(hasher, queries, rows, need) < need).mean() if len(rows) else 1.0
        cost = n_rows * share * size + tables * (min(need, hasher.axes ** (n - 1)) * size + 2 * need)
        if cost < least:
            best, least = (hasher, need), cost
    return best or (Hasher(size, tables, 1), Hasher(size, 1, 1).axes)


def _indexed(hasher: Hasher, with_vectors: bool):
    """(tbl, head[, tail, ids, v]) of classes (v, ids): a row for each table."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                x = _matrix(part.column(0))
                for t in range(hasher.tables):
                    codes = hasher.codes(x, t)
                    columns = {"tbl": pa.array(np.full(len(x), t, np.int32)), "head": pa.array(codes // hasher.axes)}
                    if with_vectors:
                        columns |= {"tail": pa.array((codes % hasher.axes).astype(np.int32)), "ids": part.column(1), "v": part.column(0)}
                    yield pa.RecordBatch.from_pydict(columns)

    return run


def _asked(hasher: Hasher, probes: int, with_vectors: bool):
    """(tbl, head[, tails, class, v]) of queries (v, class): a row for each head that is probed."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                x, names = _matrix(part.column(0)), part.column(1).to_numpy()
                for t in range(hasher.tables):
                    codes = np.sort(hasher.probed(x, t, probes), axis=1)
                    heads, tails = codes // hasher.axes, (codes % hasher.axes).astype(np.int32)
                    first = np.concatenate([np.ones((len(x), 1), bool), heads[:, 1:] != heads[:, :-1]], axis=1).reshape(-1)
                    starts = np.flatnonzero(first)
                    own = starts // codes.shape[1]
                    columns = {"tbl": pa.array(np.full(len(starts), t, np.int32)), "head": pa.array(heads.reshape(-1)[starts])}
                    if with_vectors:
                        ends = pa.array(np.append(starts, first.size), pa.int32())
                        columns |= {"tails": pa.ListArray.from_arrays(ends, pa.array(tails.reshape(-1))), "class": pa.array(names[own]), "v": part.column(0).take(pa.array(own))}
                    yield pa.RecordBatch.from_pydict(columns)

    return run


def _best(x: np.ndarray, norms: np.ndarray, ids: list, near: np.ndarray, query: np.ndarray, keep: int) -> list[tuple[float, int]]:
    """(-cosine, id) of those of the rows `near` that are nearest to the query, ties to smaller ids."""
    score = (x[near] * query).sum(axis=1) / (norms[near] * np.sqrt((query * query).sum()))
    if len(near) > keep:
        top = score >= np.partition(score, len(score) - keep)[len(score) - keep]
        near, score = near[top], score[top]
    return sorted((-s, i) for n, s in zip(near.tolist(), score.tolist()) for i in ids[n])[:keep]


def _rows(found: list[tuple[int, float, int]], kind=pa.RecordBatch):
    return kind.from_arrays([pa.array([f[0] for f in found], pa.int64()), pa.array([f[2] for f in found], pa.int64()), pa.array([-f[1] for f in found], pa.float64())], names=["class", "vec_id", "score"])


def _met(keep: int):
    """What each query of a block finds in the buckets that it probes."""

    def run(rows, asking):
        found = []
        if rows.num_rows and asking.num_rows:
            tail = rows["tail"].to_numpy()
            order = np.argsort(tail, kind="stable")
            tail, x, ids = tail[order], _matrix(rows["v"].combine_chunks()), rows["ids"].to_pylist()
            norms = np.sqrt((x * x).sum(axis=1))
            queries, names = _matrix(asking["v"].combine_chunks()), asking["class"].to_pylist()
            for name, query, tails in zip(names, queries, asking["tails"].to_pylist()):
                left, right = np.searchsorted(tail, tails, "left"), np.searchsorted(tail, tails, "right")
                near = np.concatenate([order[a:b] for a, b in zip(left, right)])
                if len(near):
                    found += [(name, s, i) for s, i in _best(x, norms, ids, near, query, keep)]
        return _rows(found, pa.Table)

    return run


def _exact(block, keep: int):
    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                x, ids, every = _matrix(part.column(0)), part.column(1).to_pylist(), np.arange(part.num_rows)
                norms = np.sqrt((x * x).sum(axis=1))
                yield _rows([(name, s, i) for name, query in zip(*block.value) for s, i in _best(x, norms, ids, every, query, keep)])

    return run


def candidates(classes: DataFrame, queries: DataFrame, hasher: Hasher, probes: int, keep: int) -> DataFrame:
    """(class, vec_id, score): the `keep` best of each block's candidates for queries (v, class) among classes (v, ids)."""
    keys, kind = ["tbl", "head"], dict(classes.dtypes)["v"]
    n_rows = classes.mapInArrow(_indexed(hasher, False), "tbl int, head long").groupBy(keys).agg(F.count("*").alias("n_rows"))
    n_asked = queries.mapInArrow(_asked(hasher, probes, False), "tbl int, head long").groupBy(keys).agg(F.count("*").alias("n_asked"))
    heads = written(n_rows.join(n_asked, keys).select(*keys, F.ceil(F.col("n_rows") / ROWS).cast("int").alias("rows"), F.ceil(F.col("n_asked") / ASKED).cast("int").alias("asks")), "heads")
    rows = classes.mapInArrow(_indexed(hasher, True), f"tbl int, head long, tail int, ids array<long>, v {kind}").join(heads, keys)
    rows = rows.withColumn("i", F.pmod(F.xxhash64("ids"), "rows").cast("int")).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("asks") - 1)))
    asks = queries.mapInArrow(_asked(hasher, probes, True), f"tbl int, head long, tails array<int>, class long, v {kind}").join(heads, keys)
    asks = asks.withColumn("j", F.pmod(F.xxhash64("class"), "asks").cast("int")).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("rows") - 1)))
    block = [*keys, "i", "j"]
    met = rows.select(*block, "tail", "ids", "v").groupBy(block).cogroup(asks.select(*block, "tails", "class", "v").groupBy(block))
    return met.applyInArrow(_met(keep), FOUND)


def _few(keep: int):
    """All rows of a length against its queries."""

    def run(rows, asking):
        if not rows.num_rows or not asking.num_rows:
            return _rows([], pa.Table)
        x, ids, every = _matrix(rows["v"].combine_chunks()), rows["ids"].to_pylist(), np.arange(rows.num_rows)
        norms = np.sqrt((x * x).sum(axis=1))
        return _rows([(name, s, i) for name, q in zip(asking["class"].to_pylist(), _matrix(asking["v"].combine_chunks())) for s, i in _best(x, norms, ids, every, q, keep)], pa.Table)

    return run


def _searched(rows: DataFrame, queries: DataFrame, keep: int, block: int, path: str) -> None:
    """Writes the exact `keep` nearest among rows (v, ids) of queries (class, v), in blocks that are broadcast."""
    spark, n = rows.sparkSession, queries.count()
    marked = queries.withColumn("block", F.pmod(F.xxhash64("class"), F.lit(-(-n // block) or 1)))
    for b in range(-(-n // block)):
        asked = marked.where(F.col("block") == b).select("class", "v").collect()
        if asked:
            sent = spark.sparkContext.broadcast(([r[0] for r in asked], scaled(np.array([list(r[1]) for r in asked], float))))
            rows.select("v", "ids").mapInArrow(_exact(sent, keep), FOUND).write.mode("append").parquet(path)
            sent.destroy()


def _found(classes: DataFrame, queries: DataFrame, k: int, tables: int, hashes, probes: int, target: float, block: int) -> DataFrame:
    """(class, vec_id, score): the k + 1 nearest found, for queries (class, v) among classes (v, ids, first) of one length."""
    spark, n = classes.sparkSession, classes.count()
    some = queries.orderBy(F.xxhash64("class"), "class").limit(SAMPLED)
    path = new_path(spark, "sample")
    _searched(classes, some, k + 1, SAMPLED, path)
    order = Window.partitionBy("class").orderBy(F.desc("score"), "vec_id")
    true = spark.read.schema(FOUND).parquet(path).withColumn("n", F.row_number().over(order)).where((F.col("n") > 1) & (F.col("n") <= k + 1))
    # at most SAMPLED * k ids, a bounded broadcast; a neighbour is a class by any of its ids
    ids = F.broadcast(true.select("class", "vec_id"))
    with_v = classes.select("v", F.explode("ids").alias("vec_id")).join(ids, "vec_id").select("class", "v").collect()
    asked = {r["class"]: list(r["v"]) for r in some.select("class", "v").collect()}
    near = {c: [list(r["v"]) for r in with_v if r["class"] == c] for c in asked}
    full = [c for c in asked if len(near[c]) >= k]
    rows = [list(r["v"]) for r in classes.orderBy(F.xxhash64("first"), "first").limit(ROW_SAMPLE).select("v").collect()]
    array = lambda x: scaled(np.array(x, float))
    if full:
        size = len(rows[0])
        hasher, probes = fitted(array([asked[c] for c in full]), array([v for c in full for v in near[c][:k]]).reshape(len(full), k, size), array(rows), n, tables, hashes, probes, target)
    else:
        hasher = Hasher(len(rows[0]), tables, 1)
        probes = hasher.axes
    found = candidates(classes, queries, hasher, probes, k + 1)
    return written(found.groupBy("class", "vec_id").agg(F.max("score").alias("score")), "found")


def nearest(vectors: DataFrame, is_query, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K, tables: int = TABLES, hashes=HASHES, probes: int = PROBES, target: float = TARGET, block: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found for each row that is_query (a condition on the id column).

    hashes: numbers of rotations to choose from; probes: the most of a table.
    """
    spark = vectors.sparkSession
    own = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("v"), is_query.alias("query")).where("vec_id IS NOT NULL AND v IS NOT NULL")
    own = own.where(F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))) & F.exists("v", lambda c: c != 0))
    firsts = own.select("v", "vec_id").distinct().withColumn("n", F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))).where(F.col("n") <= k + 1)
    classes = firsts.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")).withColumn("first", F.col("ids")[0]).withColumn("size", F.size("v"))
    classes = written(classes, "classes")
    asking = written(own.where("query").select("vec_id", "v").distinct(), "asking")
    queries = written(asking.groupBy("v").agg(F.min("vec_id").alias("class")).withColumn("size", F.size("v")), "queries")
    counted = classes.groupBy("size").agg(F.count("*").alias("n")).join(queries.select("size").distinct(), "size")
    counted = written(counted, "sizes")
    few = counted.where(F.col("n") <= FEW).select("size")
    parts = [d.join(F.broadcast(few) if few.count() <= 100_000 else few, "size", "left_semi").select(*columns) for d, columns in ((classes, ("size", "v", "ids")), (queries, ("size", "v", "class")))]
    left, right = (d.toDF(*d.columns) for d in parts)
    found = left.groupBy("size").cogroup(right.groupBy("size")).applyInArrow(_few(k + 1), FOUND)
    for r in counted.where(F.col("n") > FEW).orderBy("size").collect():
        of = [d.where(F.col("size") == r["size"]) for d in (classes, queries)]
        found = found.unionByName(_found(*of, k, tables, hashes, probes, target, block))
    found = written(found, "all")
    # each query's own id is one of those found
    enough = found.groupBy("class").agg(F.count("*").alias("n")).where(F.col("n") > k).select("class")
    short = queries.join(enough, "class", "left_anti").join(counted.where(F.col("n") > FEW).select("size"), "size", "left_semi")
    short = written(short, "short")
    for r in short.groupBy("size").count().orderBy("size").collect():
        path = new_path(spark, "exact")
        _searched(classes.where(F.col("size") == r["size"]), short.where(F.col("size") == r["size"]), k + 1, block, path)
        found = found.unionByName(spark.read.schema(FOUND).parquet(path))
    found = found.groupBy("class", "vec_id").agg(F.max("score").alias("score"))
    best = Window.partitionBy("class").orderBy(F.desc("score"), "vec_id")
    found = found.withColumn("n", F.row_number().over(best)).where(F.col("n") <= k + 1).drop("n")
    # each query's own id goes, then the first k of its class stay
    members = asking.join(queries, "v").select(F.col("vec_id").alias("query_id"), "class")
    by = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    out = members.join(found, "class").where("query_id <> vec_id").withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)
    return out.select("query_id", "rank", "vec_id", "score")
