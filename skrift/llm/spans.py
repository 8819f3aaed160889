"""Spans of regular expressions, with Spark's own functions only.

split() and regexp_extract_all() both walk the leftmost non-overlapping
matches, so running sums of the lengths of what is between and of what is
matched are the matches' offsets, in code points.

A column expression that is named twice is evaluated twice, and inside a lambda
once for each element; let() evaluates it once.
"""

import hashlib
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Lengths of a block of running(); characters of a block of replaced().
BLOCK, CHARS = 64, 4096
SPANS = "array<struct<start:int,rank:int,end:int,kind:string>>"


def let(value: Column, of: Callable[[Column], Column]) -> Column:
    """of(value), with value evaluated once however often it is named."""
    return F.get(F.transform(F.array(value), of), F.lit(0))


def running(lengths: Column) -> Column:
    """Running sums of an array of ints, by sums of blocks, so a text with very many matches stays near linear."""
    add = lambda a, x: a + x
    total = lambda part: F.aggregate(part, F.lit(0), add)

    def sums(own):
        starts = F.sequence(F.lit(0), F.greatest(F.size(own) - 1, F.lit(0)), F.lit(BLOCK))
        blocks = F.transform(starts, lambda b: total(F.slice(own, b + 1, F.lit(BLOCK))))
        nth = lambda i: F.floor(i / BLOCK).cast("int")
        return let(blocks, lambda done: F.transform(own, lambda _, i: total(F.slice(done, F.lit(1), nth(i))) + total(F.slice(own, nth(i) * BLOCK + 1, i % BLOCK + 1))))

    return let(lengths, sums)


def hits(text: Column, pattern: str, may: Column | None = None, group: int = 0) -> Column:
    """The matches, null where `may` (a cheap necessary condition) does not hold."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    return found if may is None else F.when(may, found)


def located(text: Column, pattern: str, found: Column) -> Column:
    """[{start, end, hit}] of matches that hits() has found; an empty array where there are none."""
    between = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found))
    steps = F.zip_with(between, found, lambda a, m: F.length(a) + F.length(m))
    spans = F.zip_with(running(steps), found, lambda e, m: F.struct((e - F.length(m)).alias("start"), e.alias("end"), m.alias("hit")))
    none = F.array().cast("array<struct<start:int,end:int,hit:string>>")
    return F.when(F.size(found) > 0, spans).otherwise(none)


def tagged(spans: Column, kind: str, rank: int) -> Column:
    """Spans that sort by start, then kind's rank."""
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), s["end"].alias("end"), F.lit(kind).alias("kind")))


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined, in the order of tagged()."""
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def outside(spans: Column, others: Column) -> Column:
    """Those spans that overlap none of the others."""
    return F.filter(spans, lambda s: ~F.exists(others, lambda o: (o["start"] < s["end"]) & (s["start"] < o["end"])))


def merged(spans: Column) -> Column:
    """Overlapping spans as one, of the first one's kind; in order."""

    def step(done, s):
        last = F.element_at(done, -1)
        longer = F.struct(last["start"].alias("start"), last["rank"].alias("rank"), F.greatest(last["end"], s["end"]).alias("end"), last["kind"].alias("kind"))
        return F.when(F.size(done) == 0, F.array(s)).when(s["start"] < last["end"], F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(longer))).otherwise(F.concat(done, F.array(s)))

    return F.aggregate(F.array_sort(spans), F.array().cast(SPANS), step)


def replaced(text: Column, spans: Column) -> Column:
    """text with each span as [KIND]. It is cut into blocks of CHARS first, as each cut walks a string from its start."""

    def block(part, n, own):
        first = n * CHARS
        mine = F.filter(own, lambda s: (s["end"] > first) & (s["start"] < first + CHARS))

        def filled(m):
            since = lambda i: F.when(i == 0, F.lit(0)).otherwise(F.get(m, i - 1)["end"] - first)
            name = lambda s: F.when(s["start"] >= first, F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]"))).otherwise("")
            pieces = F.transform(m, lambda s, i: F.concat(F.substring(part, since(i) + 1, F.greatest(s["start"] - first - since(i), F.lit(0))), name(s)))
            tail = F.substring(part, F.element_at(m, -1)["end"] - first + 1, F.lit(CHARS))
            return F.when(F.size(m) > 0, F.concat(F.array_join(pieces, ""), tail)).otherwise(part)

        return let(mine, filled)

    parts = F.regexp_extract_all(text, F.lit("(?s).{1,%d}" % CHARS), F.lit(0))
    whole = let(merged(spans), lambda own: F.array_join(F.transform(parts, lambda part, n: block(part, n, own)), ""))
    return F.when(F.size(spans) > 0, whole).otherwise(text)


def sha256_hex(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()
