"""Phrase mining by PCY/DHP: bucket bitmaps and Apriori pruning before exact counts.

Pass k over the texts counts phrases of k words exactly, and in the same pass
hashes phrases of k + 1 words into 2^BITS buckets, whose counts (cut off at the
least count, which decides as well) are added up over all tasks. A bit for each
bucket that reaches the least count is broadcast: 2^BITS / 8 bytes, whatever
the corpus. In pass k + 1 a phrase is counted only if its bucket's bit is set
and (Apriori) both of its parts of k words are frequent by exact count; these
are a second bitmap of the same size. DHP: only phrases whose parts survive are
hashed. Bitmaps have no false negatives, and counts of what passes are exact, so
the result does not depend on BITS; where buckets fill up, Apriori alone prunes.

A task works on chunks of CHUNK words: distinct phrases leave it with their
counts, buckets as packed runs of 2^16. Buckets are added up in two levels, the
first by run and SALTS parts of the tasks, each folding its batches one by one.

A phrase's score is that of its lowest-scoring cut into two parts:
floor(1000000 * a * a / (l * r)), in decimals (exact up to counts of 3 * 10^15);
phrases contained in a longer one that is at least `inside` percent as frequent
are dropped.

Defined results: a null text is empty, a null language `und` (one with rows that
say `und`); a language without words has no rows. Repeated rows count as often
as they stand. Ties go by count, then by bytes of the phrase. Ids and other
columns are not read; an empty table gives no rows.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import byte_batches, dropped, mix, written

LEAST, LONGEST, INSIDE, TOP = 10, 3, 50, 2000
BITS, CHUNK, SALTS = 26, 3_000_000, 64
RUN = 16
#: Separators of pieces become line feeds, the tab a blank, A to Z lower case.
PIECES = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?\x0b\x0c\r\t", b"abcdefghijklmnopqrstuvwxyz\n\n\n\n\n\n\n\n\n ")
#: Rows of a pass: a phrase and its count, or a run's buckets and their counts.
FOUND = {"lang": pa.string(), "phrase": pa.string(), "n": pa.int64(), "run": pa.int32(), "part": pa.int32(), "buckets": pa.binary(), "sums": pa.binary()}
KINDS = "lang string, phrase string, n long, run int, part int, buckets binary, sums binary"
_STEP = np.uint64(0x9FB21C651E98DF25)


class Words(dict):
    """Word to number in a chunk of one language; 0 ends a piece, -1 is nothing, and words that are not frequent end pieces too."""

    def __init__(self, lang: str, frequent: np.ndarray | None, bits: int):
        super().__init__({b"": -1, b"\n": 0})
        self.seed, self.frequent, self.bits = xxhash.xxh64_intdigest(lang.encode()), frequent, bits
        self.names, self.hashes = [b""], [0]

    def __missing__(self, word):
        h = xxhash.xxh64_intdigest(word, self.seed)
        at = h >> (64 - self.bits)
        if self.frequent is not None and not self.frequent[at >> 3] >> (at & 7) & 1:
            self[word] = 0
            return 0
        self[word] = n = len(self.names)
        self.names.append(word)
        self.hashes.append(h)
        return n

    def numbers(self, text: bytes) -> np.ndarray:
        words = text.translate(PIECES).replace(b"\n", b" \n ").split(b" ")
        out = np.fromiter(map(self.__getitem__, words), np.int32, len(words))
        return out[out >= 0]


def _set(bitmap: np.ndarray, h: np.ndarray, bits: int) -> np.ndarray:
    at = h >> np.uint64(64 - bits)
    return (bitmap[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 > 0


def _joined(h: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Hashes of phrases and of one word more."""
    return mix(h * _STEP + last)


def _packed(h: np.ndarray, n: np.ndarray, least: int, bits: int, part: int):
    """Bucket counts of phrases, in runs of 2^RUN buckets; counts are cut off at `least`."""
    at, first = np.unique(h >> np.uint64(64 - bits), return_inverse=True)
    total = np.minimum(np.bincount(first, n), least).astype(np.uint16)
    run = (at >> np.uint64(RUN)).astype(np.int32)
    starts = np.flatnonzero(np.concatenate([[True], run[1:] != run[:-1]])) if len(run) else run
    low, ends = (at & np.uint64((1 << RUN) - 1)).astype(np.uint16), np.append(starts[1:], len(at))
    cut = lambda x: pa.array([x[a:b].tobytes() for a, b in zip(starts, ends)], pa.binary())
    return _batch(run=pa.array(run[starts]), part=pa.array(np.full(len(starts), part, np.int32)), buckets=cut(low), sums=cut(total))


def _batch(**columns) -> pa.RecordBatch:
    n = len(next(iter(columns.values())))
    return pa.RecordBatch.from_pydict({c: columns[c] if c in columns else pa.nulls(n, kind) for c, kind in FOUND.items()})


def _chunks(batches, frequent, bits):
    """(lang, word numbers, words) of chunks of the texts of one task."""
    held, words, size = {}, {}, 0
    for batch in batches:
        by: dict[str, list] = {}
        for text, lang in zip(batch.column(0).cast(pa.binary()).to_pylist(), batch.column(1).to_pylist()):
            if text:
                by.setdefault(lang, []).append(text)
        for lang, texts in by.items():
            if lang not in words:
                words[lang] = Words(lang, frequent, bits)
            part = words[lang].numbers(b"\n".join([b"", *texts, b""]))
            held.setdefault(lang, []).append(part)
            size += len(part)
        if size >= CHUNK or sum(map(len, words.values())) >= CHUNK // 4:
            yield from ((k, np.concatenate(v), words[k]) for k, v in held.items())
            held, words, size = {}, {}, 0
    yield from ((k, np.concatenate(v), words[k]) for k, v in held.items())


def _pass(k: int, maps, least: int, bits: int, last: bool):
    """One pass: counts of phrases of k words that may be frequent, and the buckets of phrases of k + 1 words both of whose parts may be."""

    def run(batches):
        part = TaskContext.get().partitionId() % SALTS
        words_map, parts_map, bucket_map = (m.value if m is not None else None for m in maps)
        for lang, ids, words in _chunks(batches, words_map, bits):
            own, at = np.array(words.hashes, np.uint64), np.flatnonzero(ids)
            h = own[ids[at]]
            for n in range(2, k + 1):
                on = np.flatnonzero(at[1:] == at[:-1] + 1)
                at = at[on]
                h = _joined(h[on], own[ids[at + n - 1]])
                if n >= k - 1:
                    alive = _set(bucket_map if n == k else parts_map, h, bits)
                    at, h = at[alive], h[alive]
            yield from _counts(k, lang, ids, words, at)
            if not last:
                on = np.flatnonzero(at[1:] == at[:-1] + 1)
                yield _packed(_joined(h[on], own[ids[at[on] + k]]), np.ones(len(on)), least, bits, part)

    return run


def _counts(k: int, lang: str, ids: np.ndarray, words: Words, at: np.ndarray):
    """Phrases of k words that begin at the places `at`, and how often they do."""
    code = ids[at].astype(np.int64)
    for n in range(1, k):
        if n > 1:
            code = np.unique(code, return_inverse=True)[1]
        code = code << 32 | ids[at + n]
    _, first, count = np.unique(code, return_index=True, return_counts=True)
    names = pa.array(words.names, pa.binary()).cast(pa.string())
    for a in range(0, len(first), 100_000):
        own = at[first[a : a + 100_000]]
        texts = [names.take(pa.array(ids[own + n])) for n in range(k)]
        yield _batch(lang=pa.array([lang] * len(own), pa.string()), phrase=pc.binary_join_element_wise(*texts, " ") if k > 1 else texts[0], n=pa.array(count[a : a + 100_000], pa.int64()))


def _present(k: int, least: int, bits: int):
    """Packed buckets of phrases that are frequent by exact count."""

    def run(batches):
        for batch in batches:
            hashes = []
            for lang, phrase in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
                seed = xxhash.xxh64_intdigest(lang.encode())
                hashes.append([xxhash.xxh64_intdigest(w, seed) for w in phrase.split(b" ")])
            own = np.array(hashes, np.uint64).reshape(-1, k)
            h = own[:, 0]
            for n in range(1, k):
                h = _joined(h, own[:, n])
            yield _packed(h, np.full(len(h), least), least, bits, int(h[0] & np.uint64(SALTS - 1)) if len(h) else 0)

    return run


def _bitmap(packed: DataFrame, least: int, bits: int) -> np.ndarray:
    """One bit a bucket that reaches `least`: this alone comes to the driver, 2^bits / 8 bytes at most."""

    def added(batches):
        total, run = np.zeros(1 << RUN, np.uint16), None
        for batch in batches:
            for r, at, n in zip(*(batch[c].to_pylist() for c in ("run", "buckets", "sums"))):
                run, at = r, np.frombuffer(at, np.uint16)
                total[at] = np.minimum(total[at] + np.frombuffer(n, np.uint16), least)
        return pa.array([run], pa.int32()), total

    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run, total = added(batches)
        at = np.flatnonzero(total).astype(np.uint16)
        yield pa.RecordBatch.from_pydict({"run": run, "buckets": pa.array([at.tobytes()]), "sums": pa.array([total[at].tobytes()])})

    def reached(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run, total = added(batches)
        yield pa.RecordBatch.from_pydict({"run": run, "set": pa.array([np.packbits(total >= least, bitorder="little").tobytes()])})

    once = packed.where("run IS NOT NULL").select("run", "part", "buckets", "sums").groupBy("run", "part").applyInArrow(some, "run int, buckets binary, sums binary")
    out = np.zeros((1 << bits) // 8, np.uint8)
    size = (1 << RUN) // 8
    for r in once.groupBy("run").applyInArrow(reached, "run int, set binary").collect():
        out[r["run"] * size : (r["run"] + 1) * size] = np.frombuffer(r["set"], np.uint8)
    return out


def counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, longest: int = LONGEST, bits: int = BITS) -> list[DataFrame]:
    """For k = 1 to `longest`, written tables (lang, phrase, n): all words, then phrases of k words that stand `least` times or more."""
    spark = docs.sparkSession
    byte_batches(spark)
    bits = max(RUN, bits)
    own = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"))
    tables, maps = [], (None, None, None)
    for k in range(1, longest + 1):
        last = k == longest
        found = written(own.mapInArrow(_pass(k, maps, least, bits, last), KINDS), "pass")
        sums = found.where("phrase IS NOT NULL").groupBy("lang", "phrase").agg(F.sum("n").alias("n"))
        tables.append(written(sums if k == 1 else sums.where(F.col("n") >= least), "phrases"))
        if not last:
            frequent = tables[-1].where(F.col("n") >= least).select("lang", "phrase")
            exact, buckets = (spark.sparkContext.broadcast(_bitmap(d, least, bits)) for d in (frequent.mapInArrow(_present(k, least, bits), KINDS), found))
            # of words, those that are not frequent end pieces from now on
            maps = (exact if k == 1 else maps[0], exact if k > 1 else None, buckets)
        dropped(found)
    return tables


def phrases(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, longest: int = LONGEST, inside: int = INSIDE, top: int | None = TOP, bits: int = BITS) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of each language's phrases of 2 to `longest` words, its first `top` (None: all)."""
    tables = counts(docs, text_col, lang_col, least, longest, bits)
    known = tables[0].where(F.col("n") >= least)
    for t in tables[1 : longest - 1]:
        known = known.unionByName(t)
    # every cut's two parts meet their counts
    found = tables[1] if longest > 1 else tables[0].limit(0)
    for t in tables[2:]:
        found = found.unionByName(t)
    words = F.split("phrase", " ")
    cuts = found.withColumn("words", words).select("lang", "phrase", F.col("n").alias("a"), "words", F.explode(F.sequence(F.lit(1), F.size("words") - 1)).alias("cut"))
    part = lambda side, at, n: F.struct(F.lit(side).alias("side"), F.array_join(F.slice("words", at, n), " ").alias("part"))
    parts = cuts.select("lang", "phrase", "a", "cut", F.inline(F.array(part(0, F.lit(1), F.col("cut")), part(1, F.col("cut") + 1, F.size("words") - F.col("cut")))))
    met = parts.join(known.select("lang", F.col("phrase").alias("part"), F.col("n").alias("f")), ["lang", "part"])
    cut = met.groupBy("lang", "phrase", "a", "cut").agg(F.max(F.when(F.col("side") == 0, F.col("f"))).alias("l"), F.max(F.when(F.col("side") == 1, F.col("f"))).alias("r"))
    whole = {c: F.col(c).cast("decimal(16,0)") for c in "alr"}
    exact = cut.withColumn("above", (F.lit(1_000_000).cast("decimal(7,0)") * (whole["a"] * whole["a"]).cast("decimal(31,0)")).cast("decimal(38,0)")).withColumn("below", (whole["l"] * whole["r"]).cast("decimal(38,0)"))
    scored = exact.withColumn("score", F.expr("above div below"))
    best = scored.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "cut", "l", "r")).alias("best"))
    # the most frequent longer candidate that contains a phrase
    longer = found.withColumn("words", words).where(F.size("words") > 2)
    sizes = F.sequence(F.lit(2), F.size("words") - 1)
    inner = F.flatten(F.transform(sizes, lambda k: F.transform(F.sequence(F.lit(1), F.size("words") - k + 1), lambda at: F.array_join(F.slice("words", at, k), " "))))
    most = longer.select("lang", F.explode(inner).alias("phrase"), F.col("n").alias("f")).groupBy("lang", "phrase").agg(F.max("f").alias("most"))
    kept = best.join(most, ["lang", "phrase"], "left").where(F.col("most").isNull() | (100 * F.col("most") < inside * F.col("a")))
    n = tables[0].groupBy("lang").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = kept.select("lang", "phrase", "a", "best.l", "best.r", "best.score").withColumn("rank", F.row_number().over(order))
    ranked = ranked if top is None else ranked.where(F.col("rank") <= top)
    return ranked.join(n, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


ORACLE = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS text
  FROM documents
), numbered AS (
  SELECT lang, row_number() OVER () AS piece, regexp_extract_all(text, '[^\x20\x09]+') AS w FROM pieces
), words AS (
  SELECT lang, piece, unnest(w) AS w, generate_subscripts(w, 1) AS nth FROM numbered
), runs AS (
  SELECT lang, w AS w1, lead(w, 1) OVER later AS w2, lead(w, 2) OVER later AS w3 FROM words WINDOW later AS (PARTITION BY piece ORDER BY nth)
), f AS (
  SELECT lang, 1 AS k, w1 AS phrase, count(*) AS f FROM runs GROUP BY lang, w1
  UNION ALL SELECT lang, 2, w1 || ' ' || w2, count(*) FROM runs WHERE w2 IS NOT NULL GROUP BY lang, w1 || ' ' || w2 HAVING count(*) >= 10
  UNION ALL SELECT lang, 3, w1 || ' ' || w2 || ' ' || w3, count(*) FROM runs WHERE w3 IS NOT NULL GROUP BY lang, w1 || ' ' || w2 || ' ' || w3 HAVING count(*) >= 10
), total AS (
  SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang
), cand AS (
  SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND f >= 10
), cuts AS (
  SELECT c.*, cut, x.f AS l, y.f AS r, CAST(1000000::HUGEINT * a * a // (x.f::HUGEINT * y.f) AS BIGINT) AS score
  FROM cand c JOIN range(1, 3) t(cut) ON cut < c.k
  JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(w[1:cut], ' ')
  JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(w[cut + 1:c.k], ' ')
), best AS (
  SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1
), most AS (
  SELECT lang, phrase, max(a) AS most FROM (
    SELECT lang, a, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS phrase FROM cand WHERE k = 3
  ) GROUP BY lang, phrase
), kept AS (
  SELECT b.* FROM best b LEFT JOIN most m ON b.lang = m.lang AND b.phrase = m.phrase WHERE m.most IS NULL OR 100 * m.most < 50 * b.a
)
SELECT lang, CAST(row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS INT) AS rank, phrase, a, l, r, n, score
FROM kept JOIN total USING (lang)
QUALIFY row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) <= 2000
"""
