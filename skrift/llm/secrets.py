"""Secret scans by a trigram inverted index, on DataFrame functions only.

From each rule's pattern a Boolean query over trigrams is derived: every match
must satisfy it. Postings (trigram, row) are built for the trigrams that the
queries name (or a given list, for an index that later rules share), written,
and intersected by row; rules are then run only where their query holds. A rule
without mandatory trigrams scans every text, where it lies: only rows that may
be candidates, after a filter of bounded size, are shuffled to meet their rules.

Postings carry a row key, not ids, which may be null or repeated.

Defined results: null and empty texts have no secrets; null ids and repeated
rows give a row each; other columns are not read. An empty table gives no rows.
"""

import re
from dataclasses import dataclass
from re import _constants as C
from re import _parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import keyed, split_by, written
from .spans import SPANS, hits, joined, located, outside, tagged


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    group: int = 0  # the group that must be long enough
    least: int = 1


#: Base rules, then added ones; spans sort by start, then in this order.
BASE = (
    Rule("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 6),
    Rule("access", r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]{24,}"),
)
ADDED = (
    Rule("pem", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[0-9A-Za-z_-]{35}"),
    Rule("stripe", r"[rs]k_live_[0-9A-Za-z]{16,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+"),
)
MOST_STRINGS = 32


def _grams(strings: set[str]):
    """The query that one of the strings is there; None if a string is too short to tell."""
    if not strings or min(map(len, strings)) < 3:
        return None
    own = {tuple(dict.fromkeys(s[i : i + 3] for i in range(len(s) - 2))) for s in strings}
    parts = [("and", g) for g in sorted(own) if not any(set(o) < set(g) for o in own)]  # a longer one adds nothing
    return parts[0] if len(parts) == 1 else ("or", tuple(parts))


def _analysed(parsed) -> tuple[set[str] | None, list]:
    """(all strings it can match, or None; clauses that hold for every match)."""
    exact, whole, clauses = {""}, True, []

    def cut():
        nonlocal exact, whole
        if query := _grams(exact):
            clauses.append(query)
        exact, whole = {""}, False

    def cross(strings):
        nonlocal exact
        if len(exact) * len(strings) > MOST_STRINGS:
            cut()
        exact = {a + b for a in exact for b in strings} if len(strings) <= MOST_STRINGS else {""}

    for op, arg in parsed:
        if op is C.LITERAL:
            cross({chr(arg).lower()})
        elif op is C.IN and all(o is C.LITERAL for o, _ in arg):
            cross({chr(a).lower() for _, a in arg})
        elif op is C.AT:
            continue
        elif op is C.SUBPATTERN or op is C.BRANCH or op in (C.MAX_REPEAT, C.POSSESSIVE_REPEAT):
            if op is C.SUBPATTERN:
                branches = [arg[3]]
            elif op is C.BRANCH:
                branches = arg[1]
            else:
                branches = [arg[2]] + ([[]] if arg[:2] == (0, 1) else [])
            found = [_analysed(b) for b in branches]
            once = op not in (C.MAX_REPEAT, C.POSSESSIVE_REPEAT) or arg[:2] == (0, 1) or arg[:2] == (1, 1)
            if once and all(e is not None for e, _ in found):
                cross(set().union(*[e for e, _ in found]))
                continue
            cut()
            if op in (C.MAX_REPEAT, C.POSSESSIVE_REPEAT) and arg[0] == 0:
                continue
            own = [("and", tuple(c)) if (c := clause + ([q] if e is not None and (q := _grams(e)) else [])) else None for e, clause in found]
            if all(own):
                clauses.append(own[0] if len(own) == 1 else ("or", tuple(own)))
        else:
            cut()
    if whole:
        return exact, clauses
    if query := _grams(exact):
        clauses.append(query)
    return None, clauses


def trigram_query(pattern: str):
    """A tree of ("and" | "or", children) over lower-case trigrams that every match satisfies; None if there is none."""
    exact, clauses = _analysed(_parser.parse(pattern))
    if exact is not None and (query := _grams(exact)):
        clauses = [*clauses, query]
    return ("and", tuple(clauses)) if clauses else None


def grams_of(query) -> list[str]:
    return [query] if isinstance(query, str) else [g for q in query[1] for g in grams_of(q)]


def postings(docs: DataFrame, grams: list[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(gram, id): the grams by their place in the list."""
    low = docs.select(F.col(id_col).alias("id"), F.lower(text_col).alias("low"))
    there = F.array_compact(F.array(*[F.when(F.col("low").contains(g), i) for i, g in enumerate(grams)]))
    return low.select(F.explode(there).alias("gram"), "id")


def candidates(index: DataFrame, queries: dict[str, tuple], grams: list[str]) -> DataFrame:
    """(id, rules): the kinds of those rules whose query holds for the document."""
    place = {g: i for i, g in enumerate(grams)}
    words = [F.bit_or(F.when(F.floor(F.col("gram") / 62) == w, F.expr("shiftleft(1L, gram % 62)")).otherwise(F.lit(0).cast("long"))).alias(f"m{w}") for w in range(len(grams) // 62 + 1)]

    def holds(query) -> Column:
        if isinstance(query, str):
            i = place[query]
            return F.col(f"m{i // 62}").bitwiseAND(F.lit(1 << (i % 62)).cast("long")) != 0
        out = None
        for q in query[1]:
            out = holds(q) if out is None else out & holds(q) if query[0] == "and" else out | holds(q)
        return out

    masks = index.groupBy("id").agg(*words)
    rules = F.array_compact(F.array(*[F.when(holds(q), F.lit(k)) for k, q in queries.items()]))
    return masks.select("id", rules.alias("rules")).where(F.size("rules") > 0)


def _long_enough(spans: Column, groups: Column, least: int) -> Column:
    return F.filter(spans, lambda _, i: F.length(F.get(groups, i)) >= least)


def _scanned(own: DataFrame, every, may: dict[str, Column], kept: int) -> DataFrame:
    """id, the spans of each of the first `kept` rules by kind, and what the others add, of rows (id, text); `may` holds for a rule where it has to be run."""
    text = F.col("text")
    own = own.select("id", "text", *[hits(text, r.pattern, may[r.kind]).alias(f"h_{r.kind}") for r in every], *[hits(text, r.pattern, may[r.kind], r.group).alias(f"g_{r.kind}") for r in every if r.group])
    spans = []
    for i, r in enumerate(every):
        at = located(text, r.pattern, F.col(f"h_{r.kind}"))
        if r.group:
            at = _long_enough(at, F.col(f"g_{r.kind}"), r.least)
        spans.append(tagged(at, r.kind, i).alias(r.kind))
    own = own.select("id", *spans)
    base = [r.kind for r in every[:kept]]
    own = own.withColumn("base", F.concat(*base))
    more = outside(F.concat(*[r.kind for r in every[kept:]]), F.col("base")) if every[kept:] else F.array().cast(SPANS)
    return own.select("id", *base, "base", more.alias("more"))


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", base=BASE, added=ADDED) -> DataFrame:
    """A row per row of docs: id, n_<kind> of base rules, base_sha256, spans, n_spans."""
    every = (*base, *added)
    queries = {r.kind: q for r in every if (q := trigram_query(r.pattern))}
    grams = sorted({g for q in queries.values() for g in grams_of(q)})
    rows = keyed(docs, "__row").select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), "__row")
    index = written(postings(rows, grams, "__row", "text"), "postings")
    wanted = written(candidates(index, queries, grams).withColumnRenamed("id", "__row"), "candidates")
    may, rest = split_by(rows, "__row", wanted)
    met = may.join(wanted.hint("merge"), "__row", "left")
    always = {r.kind: F.lit(r.kind not in queries) for r in every}
    named = {r.kind: F.array_contains("rules", r.kind) if r.kind in queries else F.lit(True) for r in every}
    own = _scanned(met, every, named, len(base)).unionAll(_scanned(rest, every, always, len(base)))
    spans = F.concat("base", "more")
    return own.select(
        F.col("id").alias(id_col),
        *[F.size(r.kind).cast("long").alias(f"n_{r.kind}") for r in base],
        F.sha2(joined(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        joined(spans).alias("spans"),
        F.size(spans).cast("long").alias("n_spans"),
    )


def _oracle() -> str:
    """The same rules in SQL: matches, what is between them, and sums of lengths."""
    parts = []
    for rank, r in enumerate((*BASE, *ADDED)):
        pattern = r.pattern.replace("'", "''")
        long_enough = f"length(regexp_extract_all(text, '{pattern}', {r.group})[i]) >= {r.least}"
        parts.append(rf"""
  SELECT doc_id, '{r.kind}' AS kind, {rank} AS rank, {rank < len(BASE)} AS is_base, f - length(h[i]) AS f0, f AS f1 FROM (
    SELECT *, coalesce(list_sum(list_transform(p[1:i], lambda x: length(x))), 0) + list_sum(list_transform(h[1:i], lambda x: length(x))) AS f FROM (
      SELECT doc_id, text, h, p, unnest(range(1, len(h) + 1)) AS i FROM (
        SELECT doc_id, text, regexp_extract_all(text, '{pattern}') AS h, string_split_regex(text, '{pattern}') AS p FROM d)))
  WHERE {long_enough}""")
    each = ", ".join(f"count(*) FILTER (kind = '{r.kind}') AS n_{r.kind}" for r in BASE)
    item = "kind || ':' || CAST(f0 AS BIGINT) || ':' || CAST(f1 AS BIGINT), ',' ORDER BY f0, rank"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
s AS ({" UNION ALL ".join(parts)}),
b AS (SELECT * FROM s WHERE is_base),
k AS (SELECT * FROM b UNION ALL SELECT * FROM s WHERE NOT is_base AND NOT EXISTS (SELECT 1 FROM b WHERE b.doc_id = s.doc_id AND b.f0 < s.f1 AND s.f0 < b.f1)),
a AS (SELECT doc_id, {each}, string_agg({item}) FILTER (is_base) AS base, string_agg({item}) AS spans, count(*) AS n_spans FROM k GROUP BY doc_id)
SELECT d.doc_id, {", ".join(f"coalesce(n_{r.kind}, 0) AS n_{r.kind}" for r in BASE)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_spans, 0) AS n_spans
FROM d LEFT JOIN a USING (doc_id)
"""


ORACLE = _oracle()
