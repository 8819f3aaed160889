"""Near-duplicate grouping: SuperMinHash, banding, exact verification, union-find.

Nodes are distinct shingle sets, keyed by a 128-bit fingerprint of the set, so
any number of exact copies is one node. A node's SuperMinHash signature is cut
into bands; nodes that share a band are candidates. Candidates are not expanded
into all pairs: each bucket is verified as a star around its pivot (the node
with the smallest fingerprint), and union-find joins what is linked. Pairs of a
bucket that are in different components so far, and whose signatures are within
MARGIN of the threshold, are still open; crowded buckets are searched for them
in blocks: nodes of a bucket's largest component need only be compared with the
others, so a large group that its star has linked costs no more than its rows.
What open pairs connect is a canopy, and within each canopy, in blocks again,
open pairs are verified on full sets. Blocks give spanning forests, not pairs;
nothing is capped.

Texts are fetched for full sets by row key, after a filter of bounded size on
the side of the scan; a set counts only if its fingerprint is its node. Joins on
keys that many rows may share (node, bucket, root) have a written table with one
row a key on the other side, so that skewed partitions can be split.

Defined results: null or blank text has no shingles and is linked with nothing.
Rows with a null id are grouped, but the smallest non-null id names the
component; if there is none, component_id is null and the row is kept. Repeated
rows get equal results. Columns other than id and text are not read. With a
column of row keys, one row of each group is kept, whatever its id. An empty
table gives no rows.
"""

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import WordHashes, byte_batches, dropped, mix, pruned, rolling, salted, written

EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)
LOW = np.uint64(0xFFFFFFFF)
#: Under the threshold by this much, a signature still counts as likely: 5 standard deviations.
MARGIN = 0.12
#: Nodes of a chunk of a crowded group.
BLOCK = 512
#: Places of a signature; the first ones make the bands.
PLACES = 240
#: Shingles handled at once in a worker.
CHUNK = 25_000


def shingle_set(text: bytes | None, k: int, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles; bytes.lower() folds A-Z only."""
    return np.unique(rolling(hashes.array(text.lower().split()), k)) if text else np.empty(0, np.uint64)


def super_min_hash(sets: list[np.ndarray], m: int) -> np.ndarray:
    """SuperMinHash signatures, (len(sets), m).

    An element's j-th trial proposes j + r (kept as j << 32 | r) for the j-th
    place of the element's own random permutation of 0..m-1, which a
    Fisher-Yates shuffle unrolls step by step. A trial j is of use only to sets
    that have an empty place after trial j - 1, as all later proposals are
    larger: this is the early stop, applied to whole sets at once.
    """
    out = np.full((len(sets), m), EMPTY, np.uint64)
    flat = out.reshape(-1)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    x = np.concatenate(sets) if sets else np.empty(0, np.uint64)
    order, first = None, None
    for j in range(m):
        draw = salted(x, j)
        value = (draw >> np.uint64(32)) | np.uint64(j << 32)
        k = (((draw & LOW) * np.uint64(m - j)) >> np.uint64(32)).astype(np.int64) + j
        if j == 0:
            place = first = k
        elif j == 1:
            place = np.where(k == first, 0, k)
        else:
            rows = np.arange(len(x))
            place = order[rows, k].astype(np.int64)
            order[rows, k] = order[:, j]
            order[:, j] = place
        np.minimum.at(flat, owner * m + place, value)
        open_sets = (out == EMPTY).any(axis=1)
        keep = open_sets[owner]
        if not keep.any():
            break
        if j == 1:
            order = np.tile(np.arange(m, dtype=np.uint8), (int(keep.sum()), 1))
            rows = np.arange(len(order))
            for step, at in ((0, first[keep]), (1, k[keep])):
                held = order[rows, at].copy()
                order[rows, at] = order[:, step]
                order[:, step] = held
        elif j > 1:
            order = order[keep]
        x, owner, first = x[keep], owner[keep], first[keep]
    return out


def _sketches(k: int, bands: int, rows: int):
    m = PLACES

    def run(batches):
        hashes = WordHashes()
        for batch in batches:
            ids, keys, texts = batch.column(0), batch.column(1), batch.column(2)
            at = 0
            while at < len(texts):
                sets, start, total = [], at, 0
                while at < len(texts) and total < CHUNK:
                    sets.append(shingle_set(texts[at].as_py(), k, hashes))
                    total += len(sets[-1])
                    at += 1
                sig = super_min_hash(sets, m)
                band = np.empty((len(sets), bands), np.uint64)
                for b in range(bands):
                    acc = np.full(len(sets), b + 1, np.uint64)
                    for r in range(rows):
                        acc = mix(acc * np.uint64(0x9FB21C651E98DF25) + sig[:, b * rows + r])
                    band[:, b] = acc
                small = mix(sig).astype(np.uint8)
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(start, at - start),
                        keys.slice(start, at - start),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()),
                        pa.array([b.tolist() if len(s) else None for b, s in zip(band.view(np.int64), sets)], pa.list_(pa.int64())),
                        pa.array([b.tobytes() if len(s) else None for b, s in zip(small, sets)], pa.binary()),
                    ],
                    names=["id", "key", "n", "node", "bands", "sig"],
                )

    return run


def _sets(k: int):
    """Full sets of nodes; a row whose set is not its node's (equal row keys of other texts) goes."""

    def run(batches):
        hashes = WordHashes()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                nodes, sets = [], []
                for node, text in zip(part.column(0).to_pylist(), part.column(1)):
                    own = shingle_set(text.as_py(), k, hashes).tobytes()
                    if xxhash.xxh3_128_digest(own) == node:
                        nodes.append(node)
                        sets.append(own)
                yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.binary()), pa.array(sets, pa.binary())], names=["node", "shingles"])

    return run


def _likely(least: float):
    """Drops pairs whose signatures agree in under `least` of the places."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                a, b = (np.stack([np.frombuffer(x.as_py(), np.uint8) for x in batch.column(i)]) for i in (2, 3))
                part = batch.filter(pa.array((a == b).mean(axis=1) >= least))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1)], names=["a", "b"])

    return run


def _compared(batches):
    for batch in batches:
        common, union = [], []
        for x, y in zip(batch.column(2), batch.column(3)):
            x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
            common.append(len(np.intersect1d(x, y, assume_unique=True)))
            union.append(len(x) + len(y) - common[-1])
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(common, pa.int64()), pa.array(union, pa.int64())], names=["a", "b", "common", "union"])


def _local_union_find(batches):
    """Replaces a task's edges by a star for each tree of its own union-find."""
    parent: dict[bytes, bytes] = {}

    def root(x):
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[up]
        return x

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            a, b = root(a), root(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
    nodes = [x for x in parent if root(x) != x]
    for at in range(0, len(nodes), 10_000):
        part = nodes[at : at + 10_000]
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.binary()), pa.array([root(x) for x in part], pa.binary())], names=["a", "b"])


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (a, b): root is the same within a component.

    Union-find inside each task, then rounds over what is left: each node hooks
    to its smallest neighbour, pointers are halved, and edges are relabelled.
    Nodes are fingerprints, so hooking order is random and rounds are few.
    """
    edges = written(edges.mapInArrow(_local_union_find, "a binary, b binary"), "edges")
    roots = edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select("b", "b")).distinct()
    roots = written(roots.groupBy("node").agg(F.min("root").alias("root")), "roots")
    # a node may be in several tasks' stars: these are the edges between roots
    step = edges.join(roots, edges.a == roots.node).select(F.col("b").alias("a"), F.col("root").alias("b"))
    left = written(step.union(roots.select("node", "root")).where("a <> b").distinct(), "edges")
    while not left.isEmpty():
        both = left.union(left.select("b", "a"))
        # written, so that a node to which many hook can be split in the join
        hook = written(both.groupBy("a").agg(F.min("b").alias("up")).select(F.col("a").alias("x"), F.least("a", "up").alias("up")), "hooks")
        for _ in range(2):
            other = hook.select(F.col("x").alias("y"), F.col("up").alias("top"))
            hook = hook.join(other, F.col("up") == F.col("y"), "left").select("x", F.coalesce("top", "up").alias("up"))
        hook = written(hook, "hooks")
        roots = written(roots.join(hook, F.col("root") == F.col("x"), "left").select("node", F.coalesce("up", "root").alias("root")), "roots")
        to = hook.select(F.col("x").alias("y"), F.col("up").alias("up_b"))
        relabelled = left.join(hook, F.col("a") == F.col("x"), "left").join(to, F.col("b") == F.col("y"), "left")
        left = written(relabelled.select(F.coalesce("up", "a").alias("a"), F.coalesce("up_b", "b").alias("b")).where("a <> b").distinct(), "edges")
    return roots


def _full_sets(nodes: DataFrame, reps: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """(node, shingles) of nodes, from one row of docs each.

    Only rows that repeat a row key have to be made one text; others are not compared.
    """
    wanted = written(reps.join(nodes, "node").select("node", F.col("rep.key").alias("key"), "again"), "wanted")
    texts = pruned(docs, "key", wanted).join(wanted.hint("merge"), "key").select("node", "raw", "again")
    once = texts.where("NOT again").select("node", "raw")
    if not wanted.where("again").isEmpty():
        repeated = texts.where("again").groupBy("node", F.md5("raw").alias("md5")).agg(F.first("raw").alias("raw"))
        once = once.unionByName(repeated.select("node", "raw"))
    return once.mapInArrow(_sets(k), "node binary, shingles binary")


def _verified(pairs: DataFrame, reps: DataFrame, docs: DataFrame, k: int, least: float) -> DataFrame:
    """(a, b, common, union) of those pairs whose signatures are likely enough; exact counts on full sets."""
    left, right = (reps.select(F.col("node").alias(n), F.col("sig").alias(f"sig_{n}")) for n in "ab")
    likely = written(pairs.join(left, "a").join(right, "b").select("a", "b", "sig_a", "sig_b").mapInArrow(_likely(least), "a binary, b binary"), "likely")
    needed = likely.select(F.col("a").alias("node")).union(likely.select("b")).distinct()
    sets = written(_full_sets(needed, reps, docs, k), "sets")
    left, right = (sets.select(F.col("node").alias(n), F.col("shingles").alias(f"s_{n}")) for n in "ab")
    found = written(likely.join(left, "a").join(right, "b").select("a", "b", "s_a", "s_b").mapInArrow(_compared, "a binary, b binary, common long, union long"), "compared")
    dropped(sets)
    dropped(likely)
    return found


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80, bands: int = 30, rows: int = 4, row_col: str | None = None) -> DataFrame:
    """A row per row of docs: id, n_shingles, component_id, kept.

    row_col: a column of longs that no two rows share. It is returned too, and
    kept then holds for one row of each group: of those with the smallest id (null is the
    largest) the one with the smallest key. Rows without shingles are all kept.

    Linked: 100 * |A & B| >= percent * |A | B| on distinct k-word shingles.
    A linked pair misses all of 30 bands of 4 with a probability of 1.4e-7 at
    80 percent, 2e-10 at 85, and less above the threshold.
    """
    byte_batches(docs.sparkSession)
    raw = docs.select(F.col(id_col).cast("long").alias("id"), (F.col(row_col) if row_col else F.xxhash64(id_col, text_col)).alias("key"), F.col(text_col).cast("binary").alias("raw"))
    sketch = written(raw.mapInArrow(_sketches(k, bands, rows), "id long, key long, n long, node binary, bands array<long>, sig binary"), "sketch")
    rep = F.min(F.struct(F.isnull("id").alias("no_id"), "id", "key")).alias("rep")
    reps = sketch.where("n > 0").groupBy("node").agg(rep, F.first("bands").alias("bands"), F.first("sig").alias("sig"))
    repeated = sketch.groupBy(F.col("key").alias("__key")).agg(F.count("*").alias("__n")).where("__n > 1")
    repeated = written(repeated.select("__key"), "repeated")
    reps = written(reps.join(repeated, F.col("rep.key") == F.col("__key"), "left").withColumn("again", F.col("__key").isNotNull()).drop("__key"), "reps")
    texts = raw.select("key", "raw")
    bucketed = reps.select("node", F.explode("bands").alias("bucket"))
    # most buckets have one node: those are counted without it, and only members of others are shuffled for a pivot
    crowded = written(bucketed.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1"), "crowded")
    shared = written(bucketed.join(crowded, "bucket"), "shared")
    pivots = written(shared.groupBy("bucket").agg(F.min("node").alias("pivot")), "pivots")
    members = written(shared.join(pivots, "bucket"), "members")
    dropped(shared)
    least = percent / 100 - MARGIN
    star = members.where("node <> pivot").select(F.col("node").alias("a"), F.col("pivot").alias("b")).distinct()
    known = _verified(star, reps, texts, k, least)
    roots = components(_linked(known, percent))
    # written: a task that runs both functions would hold two Python workers
    canopies = components(written(_open(members, roots, reps, least), "open"))
    more = _linked_in(canopies, roots, reps, texts, k, percent, least)
    if not more.isEmpty():
        roots = components(_linked(known, percent).unionByName(more))
    # one row a node: its component's first row
    own = reps.select("node", "rep").join(roots, "node", "left")
    names = written(own.where("root IS NOT NULL").groupBy("root").agg(F.min("rep").alias("top")), "names")
    firsts = written(own.join(names, "root", "left").select(F.col("node").alias("of"), F.coalesce("top", "rep").alias("first")), "firsts")
    out = sketch.select("id", "key", "n", "node").join(firsts, F.col("node") == F.col("of"), "left")
    out = out.withColumn("name", F.when(F.col("of").isNull(), F.col("id")).otherwise(F.col("first.id")))
    kept = F.col("of").isNull() | (F.col("key") == F.col("first.key")) if row_col else F.col("id").eqNullSafe(F.col("name"))
    keys = [F.col("key").alias(row_col)] if row_col else []
    return out.select(F.col("id").alias(id_col), *keys, F.col("n").alias("n_shingles"), F.col("name").alias("component_id"), kept.alias("kept"))


def _linked(pairs: DataFrame, percent: int) -> DataFrame:
    return pairs.where(F.col("common") * 100 >= F.col("union") * percent).select("a", "b")


def _chunked(state: DataFrame, group: str) -> DataFrame:
    """state (group, node, root, ...) dealt to blocks (i, j), for groups that have several roots.

    Nodes that are not of their group's commonest root (`few`) visit all blocks
    of the group: block (i, j) has chunk i of all nodes, and as visitors chunk j
    of the few. A group of N nodes, M of them few, makes (N * M) / 256 rows and N + M at least.
    """
    sizes = state.groupBy(group, "root").agg(F.count("*").alias("n"))
    shape = sizes.groupBy(group).agg(F.sum("n").alias("size"), F.max(F.struct("n", F.col("root").alias("bulk"))).alias("top"))
    shape = written(shape.where(F.col("size") > F.col("top.n")).select(group, "size", (F.col("size") - F.col("top.n")).alias("others"), "top.bulk"), "shape")
    chunks = lambda n: F.ceil(F.col(n) / BLOCK).cast("int")
    own = state.join(shape, group).withColumn("few", F.col("root") != F.col("bulk"))
    at = lambda n: F.pmod(F.xxhash64("node"), chunks(n)).cast("int")
    block = lambda i, j, visitor: F.struct(i.alias("i"), j.alias("j"), F.lit(visitor).alias("visitor"))
    held = F.transform(F.sequence(F.lit(0), chunks("others") - 1), lambda j: block(at("size"), j, False))
    sent = F.transform(F.sequence(F.lit(0), chunks("size") - 1), lambda i: block(i, at("others"), True))
    own = own.withColumn("b", F.explode(F.when(F.col("few"), F.concat(held, sent)).otherwise(held)))
    return own.select("*", "b.*").drop("b", "size", "others", "bulk")


def _open(members: DataFrame, roots: DataFrame, reps: DataFrame, least: float) -> DataFrame:
    """Edges that span, within blocks of buckets, all likely pairs which the stars have left in different components."""
    state = members.where("size > 2").join(roots, "node", "left").select("bucket", "node", F.coalesce("root", "node").alias("root"))
    state = _chunked(written(state, "state"), "bucket").join(reps.select("node", "sig"), "node")
    return state.groupBy("bucket", "i", "j").applyInArrow(_block(least), "a binary, b binary")


def _linked_in(canopies: DataFrame, roots: DataFrame, reps: DataFrame, docs: DataFrame, k: int, percent: int, least: float) -> DataFrame:
    """Links between components within a canopy, as a spanning forest; exact, on full sets."""
    own = canopies.select("node", F.col("root").alias("canopy"))
    state = written(own.join(roots, "node", "left").select("canopy", "node", F.coalesce("root", "node").alias("root")), "state")
    sets = written(_full_sets(own.select("node"), reps, docs, k), "sets")
    state = _chunked(state, "canopy").join(sets, "node").join(reps.select("node", "sig"), "node")
    found = written(state.groupBy("canopy", "i", "j").applyInArrow(_block(least, percent), "a binary, b binary"), "links")
    dropped(sets)
    return found


def _block(least: float, percent: int | None = None):
    """A spanning forest of one block's open pairs of a visitor and a node that is held.

    Open: in different components, and signatures agree in `least` of the
    places. With `percent`, the forest is of components, and only of pairs
    that their full sets link. A pair of two few meets in two blocks, and is
    taken in one.
    """

    def run(table):
        node = table.column("node").to_pylist()
        codes: dict[bytes, int] = {}
        tree = np.array([codes.setdefault(r, len(codes)) for r in table.column("root").to_pylist()])
        place: dict[bytes, int] = {n: i for i, n in enumerate(sorted(set(node)))}
        name = np.array([place[n] for n in node])
        sig = np.stack([np.frombuffer(x, np.uint8) for x in table.column("sig").to_pylist()])
        few, visitor = (table.column(c).to_numpy(zero_copy_only=False).astype(bool) for c in ("few", "visitor"))
        if percent is not None:
            sets = [np.frombuffer(x, np.uint64) for x in table.column("shingles").to_pylist()]
            size = np.array([len(x) for x in sets])
        left, right = [], []
        # exact links join components; open pairs join the very nodes, all of which a canopy needs
        joint = (tree if percent is not None else name).copy()
        held = np.flatnonzero(~visitor)
        for x in np.flatnonzero(visitor):
            y = held[(tree[held] != tree[x]) & (~few[held] | (name[held] > name[x]))]
            y = y[(sig[y] == sig[x]).mean(axis=1) >= least]
            for v in y[joint[y] != joint[x]]:
                if joint[v] == joint[x]:
                    continue
                if percent is not None:
                    shared = len(np.intersect1d(sets[x], sets[v], assume_unique=True))
                    if shared * 100 < percent * (size[x] + size[v] - shared):
                        continue
                left.append(max(node[x], node[v]))
                right.append(min(node[x], node[v]))
                joint[joint == joint[v]] = joint[x]
        return pa.table({"a": pa.array(left, pa.binary()), "b": pa.array(right, pa.binary())})

    return run


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i+2], ' ')) END) AS s FROM w
), e AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM s),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.x = b.x AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))
), reach(doc_id, other) AS (
  SELECT doc_id, doc_id FROM s UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON r.other = l.a
), c AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, component_id, s.doc_id = component_id AS kept FROM s JOIN c USING (doc_id)
"""
