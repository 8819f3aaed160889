"""Benchmark decontamination: size-partitioned MinHash containment search.

A short item inside a long document has a tiny Jaccard similarity with it, so
both sides are partitioned by size: items by the power of two above their
number of shingles, and for each such class L, documents into overlapping
blocks of 2 L shingles with stride L, which any passage of L shingles fits
whole. Items and blocks get a MinHash signature of `places` places (a shingle
belongs to the place its hash names; the smallest hash in a place is its
value). A document with a block that agrees with an item in a place is a
candidate; so is one with any shingle of a short item (at most SHORT shingles),
which other words of a block could hide. Candidates are verified by exact
containment of the item's k-word shingles in the whole document:
100 * shared >= percent * size of the item's set.

Words are lower-cased runs of letters, digits and underscores; an item of fewer
than k words is one shingle of all its words. Items go out to executors in
chunks of at most `chunk` shingles, so what is broadcast has a bound; a larger
benchmark takes more passes over the documents.

Defined results: null and wordless texts and items match nothing; repeated
documents give repeated rows, repeated items a row for each; a null id is kept
as null. Other columns are not read.
"""

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import WordHashes, byte_batches, mix, rolling, salted

WORDS = re.compile(r"\w+").findall
CHUNK = 2_000_000
PLACES = 64
#: Items of so few shingles are looked up by each of them, at every position.
SHORT = 8


def _words(text: str | None, hashes: WordHashes) -> np.ndarray:
    return hashes.array(WORDS(text.lower())) if text else np.empty(0, np.uint64)


def _signature(shingles: np.ndarray, places: int) -> np.ndarray:
    """Smallest salted hash in each place; the largest integer where a place is empty."""
    out = np.full(places, np.iinfo(np.uint64).max, np.uint64)
    h = salted(shingles, 77)
    np.minimum.at(out, (h % np.uint64(places)).astype(np.int64), h)
    return out


class Index:
    """Items of one chunk: sets, and per word count and size class the values of their signatures (all hashes of short ones)."""

    def __init__(self, items: list[tuple[int, str]], k: int, places: int):
        hashes = WordHashes()
        self.places, self.ids, self.sets = places, [], []
        owners: dict[int, dict[int, list]] = {}  # shingle width -> size class -> (value, item)
        for item, text in items:
            words = _words(text, hashes)
            if not len(words):
                continue
            own = np.unique(rolling(words, k))
            size = 1 << int(len(own) - 1).bit_length() if len(own) > SHORT else SHORT
            values = _signature(own, places) if len(own) > SHORT else salted(own, 77)
            for v in values[values != np.iinfo(np.uint64).max]:
                owners.setdefault(min(k, len(words)), {}).setdefault(size, []).append((int(v), len(self.ids)))
            self.ids.append(item)
            self.sets.append(own)
        self.classes = []
        for width, by_size in owners.items():
            for size, pairs in by_size.items():
                pairs.sort()
                self.classes.append((width, size, np.array([p[0] for p in pairs], np.uint64), np.array([p[1] for p in pairs])))
        # a first look: one bit for each value of any signature
        self.bits = {}
        for width, _, values, _ in self.classes:
            table = self.bits.setdefault(width, np.zeros(1 << 22, bool))
            table[(values >> np.uint64(42)).astype(np.int64)] = True

    def state(self) -> dict:
        """Plain arrays: what is broadcast needs no module of this library to be read."""
        return dict(vars(self))

    @classmethod
    def of(cls, state: dict) -> "Index":
        out = cls.__new__(cls)
        out.__dict__.update(state)
        return out

    def candidates(self, words: np.ndarray) -> set[int]:
        found: set[int] = set()
        for width, table in self.bits.items():
            if len(words) < width:
                continue
            shingles = rolling(words, width)
            h = salted(shingles, 77)
            hit = np.flatnonzero(table[(h >> np.uint64(42)).astype(np.int64)])
            if not len(hit):
                continue
            for w, size, values, owner in self.classes:
                if w != width:
                    continue
                left, right = np.searchsorted(values, h[hit], "left"), np.searchsorted(values, h[hit], "right")
                for at, lo, hi in zip(hit, left, right):
                    if hi > lo and (size == SHORT or self._smallest(h, int(at), size)):
                        found.update(owner[lo:hi].tolist())
        return found

    def _smallest(self, h: np.ndarray, at: int, size: int) -> bool:
        """Is the hash at this position the value of its place in one of the blocks that hold it?"""
        place = h[at] % np.uint64(self.places)
        for start in {max(0, at // size * size - size), at // size * size}:
            block = h[start : start + 2 * size]
            if at < start + len(block) and block[block % np.uint64(self.places) == place].min() == h[at]:
                return True
        return False

    def verified(self, words: np.ndarray, k: int, percent: int):
        for c in sorted(self.candidates(words)):
            own = self.sets[c]
            width = k if len(own) > 1 else None
            shared = 0
            for w in {width} if width else {x for x, *_ in self.classes}:
                if len(words) >= w:
                    shared = max(shared, len(np.intersect1d(own, rolling(words, w))))
            if shared * 100 >= percent * len(own):
                yield self.ids[c], shared, len(own)


def contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", k: int = 5, percent: int = 80, places: int = PLACES, chunk: int = CHUNK) -> DataFrame:
    """(id, item, shared, item_size): each pair of a document and an item that it contains."""
    spark = docs.sparkSession
    byte_batches(spark)
    raw = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    parts, chunks, held = [], [], 0

    def close():
        nonlocal parts, held
        if parts:
            chunks.append(raw.mapInArrow(_search(spark.sparkContext.broadcast(Index(parts, k, places).state()), k, percent), "id long, item long, shared long, item_size long"))
        parts, held = [], 0

    for row in items.select(F.col(item_col).cast("long"), item_text).toLocalIterator():
        parts.append((row[0], row[1]))
        held += len(row[1] or "") // 4 + 1
        if held >= chunk:
            close()
    close()
    if not chunks:
        return raw.limit(0).selectExpr("id", "id AS item", "id AS shared", "id AS item_size").toDF(id_col, item_col, "shared", "item_size")
    out = chunks[0]
    for more in chunks[1:]:
        out = out.unionAll(more)
    return out.toDF(id_col, item_col, "shared", "item_size")


def _search(index, k: int, percent: int):
    def run(batches):
        hashes = WordHashes()
        look = Index.of(index.value)
        for batch in batches:
            out = [[], [], [], []]
            for at in range(batch.num_rows):
                words = _words(batch.column(1)[at].as_py(), hashes)
                if len(words):
                    for item, shared, size in look.verified(words, k, percent):
                        for col, x in zip(out, (batch.column(0)[at].as_py(), item, shared, size)):
                            col.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=["id", "item", "shared", "item_size"])

    return run


ORACLE = r"""
WITH dw AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS w FROM documents),
ds AS (SELECT DISTINCT doc_id, array_to_string(w[i:i+4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM dw)),
iw AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS w FROM benchmark),
its AS (SELECT DISTINCT item_id, array_to_string(w[i:i+4], ' ') AS s FROM (SELECT item_id, w, unnest(range(1, len(w) - 3)) AS i FROM iw)),
n AS (SELECT item_id, count(*) AS item_size FROM its GROUP BY 1)
SELECT doc_id, item_id, count(*) AS shared, item_size
FROM ds JOIN its USING (s) JOIN n USING (item_id) GROUP BY doc_id, item_id, item_size
HAVING count(*) * 100 >= 80 * item_size
"""
