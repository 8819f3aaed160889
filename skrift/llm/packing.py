"""Best-fit packing of token sequences after Martello-Toth dominance reduction.

A document is its token ids and an end token; only a longer one than `size` is
cut, into pieces of `size` tokens of which the first may be shorter. Bins are
sequences of at most `size` tokens.

Lengths are whole numbers of 1 to `size`, so an instance of any number of
pieces is a histogram of `size` counts: this is what the driver solves, and what
it sends out is a list of slots, of at most a few times size^1.5 rows.

Reduction: for a length j (longest first) a set of partners that dominates all
others is fixed for good, for as many bins at once as the counts allow: nothing,
if j fits with no other; a partner that fills the bin; the largest partner that
fits, if no two fit or no two are larger together; the largest pair, if it is
at least as large as every other feasible pair in both members. This shrinks the
instance until no length has such a set. The rest goes by best fit, longest
first: into the fullest open bin that has room, else a new one.

A task numbers the pieces of each of its lengths; with the sums of the tasks
before it, a piece's number within its length names its slot, so no length is
gathered, however many pieces have it.

Defined results: a null or empty text is the end token alone; every row is
packed, repeated rows and null ids too; an empty table gives no rows. Strings of
control tokens in a text are ordinary text. Other columns are not read.
"""

import json
import re
import zlib
from array import array
from bisect import bisect_left, insort

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import byte_batches, written

SIZE, END = 1024, 2
#: Words whose ids a worker's cache holds.
CACHED = 300_000
VOCABULARY = "byte_bpe_50k.json"
#: A blank that follows no white space: no token reaches over its left edge.
CUT = re.compile(r"(?<=\S) ")
WIDE = [chr(c) + " " for c in range(0x3001) if chr(c).isspace()]
KINDS = "piece int, start long, length long, ids_crc32 long"


def byte_of() -> dict[str, int]:
    """The byte that each sign of a byte-level vocabulary stands for: printable ones for themselves, the others by signs from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + n): b for n, b in enumerate(rest)}


class Ids(dict):
    """Words to ids, as little-endian 32-bit integers; forgets everything when it holds CACHED words."""

    def __init__(self, encode, before: str):
        self.encode, self.before = encode, before

    def __missing__(self, word):
        if len(self) >= CACHED:
            self.clear()
        out = self[word] = array("I", self.encode(self.before + word)).tobytes()
        return out


class Encoder:
    """Token ids of texts by a byte-level vocabulary, a cached word (what stands between single blanks) at a time.

    In such a vocabulary an id is the rank of its merge, so the library that
    merges by ranks gives the same ids as the tokenizer file, in a third of the time.
    """

    def __init__(self, vocabulary: str):
        signs = byte_of()
        found = json.loads(vocabulary)["model"]["vocab"]
        ranks = {bytes(map(signs.__getitem__, t)): n for t, n in found.items() if all(c in signs for c in t)}
        encode = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.first, self.later = Ids(encode, ""), Ids(encode, " ")

    def ids(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, as little-endian 32-bit integers."""
        parts = [CUT.split(t) if any(w in t for w in WIDE) else t.split(" ") for t in texts]
        first, later = self.first.__getitem__, self.later.__getitem__
        return [b"".join([first(p[0]), *map(later, p[1:])]) for p in parts]


def pieces_of(length: int, size: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces."""
    cut = [0, *range((length - 1) % size + 1, length + 1, size)]
    return [(a, b - a) for a, b in zip(cut, cut[1:])]


# -- the plan -------------------------------------------------------------------


class Bins:
    """Groups of equal bins: the lengths in one, and how many there are."""

    def __init__(self, counts, size: int):
        self.size, self.left, self.groups = size, np.array(counts, dtype=object), []

    def fixed(self, lengths: list[int]) -> int:
        """As many bins of these lengths as there are pieces for."""
        need = {x: lengths.count(x) for x in lengths}
        n = min(self.left[x] // m for x, m in need.items())
        if n:
            self.groups.append((sorted(lengths, reverse=True), n))
            for x, m in need.items():
                self.left[x] -= n * m
        return n


def dominating(left, size: int, j: int) -> list[int] | None:
    """Partners of a piece of length j whose set dominates all others that fit with it, if one is proved to."""
    rest = left.copy()
    rest[j] -= 1
    have = np.flatnonzero(rest > 0)
    room = size - j
    fit = have[have <= room]
    if not len(fit):
        return []
    k = int(fit[-1])
    small = [int(x) for x in fit[:3] for _ in range(min(3, int(rest[x])))][:3]
    two = len(small) > 1 and small[0] + small[1] <= room
    if k == room or not two:
        return [k]
    if len(small) > 2 and sum(small) <= room:
        return None
    # at most two partners fit: pairs p >= q of the lengths that are there
    pairs = []
    for q in map(int, fit):
        p = int(fit[np.searchsorted(fit, room - q, "right") - 1]) if q <= room - q or fit[0] <= room - q else 0
        if p == q and rest[q] < 2:
            lower = fit[fit < q]
            p = int(lower[-1]) if len(lower) else 0
        if p:
            pairs.append((max(p, q), min(p, q)))
    best = max(pairs, key=sum)
    if sum(best) <= k:
        return [k]
    # the largest pair must be as large as any other in its larger and in its smaller member
    if best[0] >= k and all(best[1] >= q for _, q in pairs):
        return list(best)
    return None


def reduced(bins: Bins) -> None:
    """Fixes dominating sets until there is none."""
    changed = True
    while changed:
        changed = False
        for j in range(bins.size, 0, -1):
            while bins.left[j] > 0 and (with_j := dominating(bins.left, bins.size, j)) is not None:
                if not bins.fixed([j, *with_j]):
                    break
                changed = True


def best_fit(bins: Bins) -> None:
    """The remaining lengths, longest first, each into the fullest open bins with room; equal bins are filled together."""
    gaps: list[int] = []
    opened: dict[int, list] = {}

    def put(lengths, n, gap):
        if gap and gap not in opened:
            insort(gaps, gap)
        if gap:
            opened.setdefault(gap, []).append((lengths, n))
        elif n:
            bins.groups.append((lengths, n))

    for j in range(bins.size, 0, -1):
        left = int(bins.left[j])
        while left:
            at = bisect_left(gaps, j)
            if at == len(gaps):
                lengths, n, gap = [], -(-left // (bins.size // j)), bins.size
            else:
                gap = gaps[at]
                lengths, n = opened[gap].pop()
                if not opened[gap]:
                    del opened[gap]
                    gaps.pop(at)
            each = gap // j
            full = min(n, left // each)
            some = left - full * each if full < n and left - full * each < each else 0
            if full:
                put(lengths + [j] * each, full, gap - each * j)
            if some:
                put(lengths + [j] * some, 1, gap - some * j)
            if n - full - (some > 0) and lengths:
                put(lengths, n - full - (some > 0), gap)
            left -= full * each + some
        bins.left[j] = 0
    for groups in opened.values():
        bins.groups += groups


def plan(counts, size: int = SIZE) -> list[tuple[list[int], int]]:
    """Groups of bins (lengths, number) for a histogram: counts[x] pieces have length x."""
    bins = Bins(counts, size)
    reduced(bins)
    best_fit(bins)
    return bins.groups


def lower_bound(counts, size: int = SIZE) -> int:
    """No packing has fewer bins: the best of Martello and Toth's bounds over all thresholds."""
    counts = np.array(counts, dtype=object)
    lengths = np.arange(len(counts), dtype=object)
    total, best = (counts * lengths), -(-int((counts * lengths).sum()) // size)
    for t in range(size // 2 + 1):
        large, middle = int(counts[size - t + 1 :].sum()), int(counts[size // 2 + 1 : size - t + 1].sum())
        room = size * middle - int(total[size // 2 + 1 : size - t + 1].sum())
        small = int(total[max(t, 1) : size // 2 + 1].sum())
        best = max(best, large + middle + max(0, -(-(small - room) // size)))
    return best


def slots(groups: list[tuple[list[int], int]]) -> dict[str, np.ndarray]:
    """Numbers of the pieces of a length, from `first` on, go to the sequences from `sequence` on, at `offset`; sorted by length and first."""
    rows, used, sequence = [], {}, 0
    for lengths, n in groups:
        offset = 0
        for x in lengths:
            rows.append((x, used.get(x, 0), sequence, offset))
            used[x] = used.get(x, 0) + n
            offset += x
        sequence += n
    rows.sort()
    table = np.array(rows, np.int64).reshape(-1, 4)
    return dict(zip(("length", "first", "sequence", "offset"), table.T))


# -- the job --------------------------------------------------------------------


def tokenized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, end: int = END, vocabulary: str | None = None, with_ids: bool = True) -> DataFrame:
    """(id_col, piece, start, length, ids_crc32, part, nth[, ids]) of all pieces; nth counts a task's pieces of a length.

    vocabulary: path of a tokenizer file, by default that of byte_bpe_50k; it is
    read on the driver and broadcast.
    """
    spark = docs.sparkSession
    byte_batches(spark)
    with open(vocabulary or public_tokenizers.path(VOCABULARY), encoding="utf-8") as f:
        sent = spark.sparkContext.broadcast({"vocabulary": f.read()})
    last = np.array([end], "<u4").tobytes()

    def run(batches):
        state, part, seen = sent.value, TaskContext.get().partitionId(), {}
        if "encoder" not in state:  # a worker's tasks share it
            state["encoder"] = Encoder(state["vocabulary"])
        encoder = state["encoder"]
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a in range(0, len(texts), 64):
                out = {c: [] for c in ("at", "piece", "start", "length", "crc", "nth", "ids")}
                for row, ids in enumerate(encoder.ids([t or "" for t in texts[a : a + 64]]), a):
                    ids += last
                    for n, (start, length) in enumerate(pieces_of(len(ids) // 4, size)):
                        own = ids[4 * start : 4 * (start + length)]
                        seen[length] = nth = seen.get(length, -1) + 1
                        for c, v in zip(out, (row, n, start, length, zlib.crc32(own), nth, own)):
                            out[c].append(v)
                whole = lambda c, kind: pa.array(out[c], kind)
                columns = [batch.column(0).take(whole("at", pa.int64())), whole("piece", pa.int32()), whole("start", pa.int64()), whole("length", pa.int64()), whole("crc", pa.int64()), pa.array([part] * len(out["at"]), pa.int32()), whole("nth", pa.int64())]
                if with_ids:
                    ends = np.concatenate([[0], np.cumsum(out["length"])]).astype(np.int32)
                    columns.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(out["ids"]), "<u4").astype(np.int32))))
                yield pa.RecordBatch.from_arrays(columns, names=[id_col, *"piece start length ids_crc32 part nth".split(), *["ids"] * with_ids])

    kind = dict(docs.dtypes)[id_col]
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, {KINDS}, part int, nth long" + ", ids array<int>" * with_ids)


def packed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, end: int = END, vocabulary: str | None = None, with_ids: bool = True) -> DataFrame:
    """(id_col, piece, start, length, ids_crc32, sequence_id, offset[, ids]) of all pieces."""
    spark = docs.sparkSession
    own = written(tokenized(docs, id_col, text_col, size, end, vocabulary, with_ids), "pieces")
    sizes = own.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = written(sizes.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))), "lengths")
    counts = [0] * (size + 1)
    for r in sizes.groupBy("length").agg(F.sum("n").alias("n")).collect():
        counts[r["length"]] = r["n"]
    sent = spark.sparkContext.broadcast(slots(plan(counts, size)))
    names = [id_col, "piece", "start", "length", "ids_crc32", *["ids"] * with_ids]
    numbered = own.join(sizes.select("length", "part", "before"), ["length", "part"]).select(*names, (F.col("before") + F.col("nth")).alias("number"))

    def place(batches):
        table = sent.value
        starts = {int(x): (int(a), int(b)) for x, a, b in zip(*_ranges(table["length"]))}
        for batch in batches:
            length, number = batch["length"].to_numpy(), batch["number"].to_numpy()
            at = np.empty(len(length), np.int64)
            for x in np.unique(length):
                a, b = starts[int(x)]
                rows = length == x
                at[rows] = a + np.searchsorted(table["first"][a:b], number[rows], "right") - 1
            sequence = table["sequence"][at] + number - table["first"][at]
            columns = {c: batch[c] for c in names} | {"sequence_id": pa.array(sequence), "offset": pa.array(table["offset"][at])}
            yield pa.RecordBatch.from_pydict(columns)

    kind = dict(docs.dtypes)[id_col]
    return numbered.mapInArrow(place, f"`{id_col}` {kind}, {KINDS}" + ", ids array<int>" * with_ids + ", sequence_id long, offset long")


def _ranges(lengths: np.ndarray):
    """Each length, and where its slots begin and end."""
    values, first, n = np.unique(lengths, return_index=True, return_counts=True)
    return values, first, first + n


def sequences(pieces: DataFrame) -> DataFrame:
    """(sequence_id, ids): the packed sequences, of at most `size` ids each."""
    own = pieces.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("p"))
    return own.select("sequence_id", F.flatten("p.ids").alias("ids"))
