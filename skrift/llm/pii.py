"""Personal data: generators, boosted trees and calibrated thresholds, on DataFrame functions only.

Base rules find emails, IPv4 addresses, payment cards and phone numbers; they
are greedy and not retried, so a number beside another one hides it. High-recall
generators propose further spans of each kind, which may overlap: for cards,
phones and addresses all windows of whole digit groups in a run of numbers, for
emails also spelled-out signs. A candidate's format and context (digits, groups,
brackets, separators, a telling word before it, its neighbours) are small
integers, so the counts of all distinct feature vectors are a table of bounded
size (CODES rows a label and half).

Gradient boosting (depth-2 trees, logistic loss) is fitted to the counts of one
half of the texts (by hash), over all documents. Its weak labels are properties
that are held out of the features: a card's check digit, an address's octets,
and for emails and phones that a base rule matches exactly this span. The other
half calibrates: a kind's threshold is the lowest score from which on at least
`precision` of the candidates are right, by estimate. Of emails and phones that
is the share with the label; of cards and addresses, which are only added if
their check holds, the share of those that pass which is left when the passes
by chance (CHANCE) are taken away.

Every feature vector's score is known then, so the plan looks it up. Of
candidates above the threshold that overlap no base span, and of those that
overlap each other the best scored, become spans.

The rules' patterns are given with possessive quantifiers and a start guard,
which leave the matches as they are and keep long runs linear.

Defined results: null and empty texts have no spans; null ids and repeated rows
give a row each; other columns are kept in redacted() (there a null text stays
null), not read in find_pii(). An empty table gives none.
"""

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import written
from .spans import SPANS, hits, joined, let, located, outside, replaced, tagged

KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Candidates that no base rule need confirm: of emails themselves, of the others runs of numbers, of which windows are taken.
WIDE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++\x20?(?:@|\(at\)|\[at\])\x20?[A-Za-z0-9-]++(?:\x20?(?:\.|\(dot\)|\[dot\])\x20?[A-Za-z0-9-]++)++",
    "phone": r"[+(]{0,2}[0-9](?:[\x20().-]{0,2}+[0-9]){9,}+",
    "card": r"(?=(?:[0-9][\x20.-]?){12}[0-9])[0-9]++(?:[\x20.-][0-9]++)*+",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3,}+",
}
#: What makes a window from where a group of digits starts, after the character before it: each pattern gives at most one.
WINDOWS = {
    "phone": [r"(?s)^[^0-9+(]([+]?[(]?[0-9](?:[\x20().-]{0,2}+[0-9]){%d})(?![0-9])" % (n - 1) for n in range(10, 16)],
    "card": [r"(?s)^[^0-9]([0-9](?:[\x20.-]?[0-9]){%d})(?![0-9])" % (n - 1) for n in range(13, 20)],
    "ip": [r"(?s)^[^0-9]([0-9]{1,3}(?:\.[0-9]{1,3}){3})(?![0-9])"],
}
#: Characters that the patterns look at, those of the context before, and places of a run that are looked at together.
REACH, BEFORE, PART = 48, 16, 512
CONTEXT = {"email": r"(?i)(?:mail|contact|write to)[^0-9A-Za-z]*$", "phone": r"(?i)(?:tel|phone|call|fax|mobile)[^0-9A-Za-z]*$", "card": r"(?i)(?:card|visa|master|amex|credit|debit|pay)[^0-9A-Za-z]*$", "ip": r"(?i)(?:ip|addr|address|host|server|from)[^0-9A-Za-z]*$"}
#: Upper ends of all but the last class of a candidate's number of digits.
CUTS = {"email": (0, 1, 3, 5, 9), "phone": (10, 11, 12, 13, 14), "card": (13, 14, 15, 16, 18), "ip": (4, 6, 8, 10, 11)}
#: Name and number of values of each feature. Mark: brackets, or a sign spelled out; of a card, an issuer's first digit; of an address, that more groups are beside it.
FEATURES = (("kind", 4), ("digits", 6), ("groups", 6), ("mark", 2), ("separators", 3), ("context", 2), ("glued", 2))
CODES = math.prod(n for _, n in FEATURES)
PRECISION, ROUNDS, RATE = 0.95, 30, 0.3
#: How often digits that are none pass the check: one check digit in ten; octets more often than not.
CHANCE = {"card": 0.1, "ip": 0.5}
#: The score of what is below its threshold.
NO = -(10**6)


def _digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    return F.call_function("luhn_check", digits)


CHECKS = {
    "email": lambda hit: F.lit(True),
    "ip": lambda hit: F.forall(F.split(hit, r"\."), lambda p: F.regexp_replace(p, "^0+", "").rlike("^(?:|[0-9]{1,2}|1[0-9][0-9]|2[0-4][0-9]|25[0-5])$")),
    "card": lambda hit: F.length(_digits(hit)).between(14, 19) & _luhn(_digits(hit)),
    "phone": lambda hit: F.length(_digits(hit)).between(10, 15),
}
#: Endings that tell a mail's host, however its signs are written; no feature looks at them.
ENDINGS = "com org net edu gov info biz io eu uk us ca au de at ch fr be nl es pt it se no dk fi pl cz ru jp cn in br mx example".split()
ENDING = r"(?:\.|\x20?(?:\(dot\)|\[dot\])\x20?)(?:" + "|".join(ENDINGS) + ")$"
#: Weak labels that are no base rule's verdict. The check digit holds for cards of 13 digits too.
WINDOW_CHECKS = {"email": lambda hit: hit.rlike(ENDING), "card": lambda hit: _luhn(_digits(hit)), "ip": CHECKS["ip"]}


def _windows(text: Column, runs: Column, name: str) -> Column:
    """[{start, end, hit, before, after}] of all windows in the runs; a long run is looked at in parts, so it stays near linear."""

    def parts(run):
        def part(at):
            lead = F.least(at, F.lit(BEFORE))
            around = F.concat(F.repeat(F.lit(" "), F.lit(BEFORE) - lead), F.substring(text, at - lead + 1, lead + F.lit(PART + REACH)))
            return F.struct(at.alias("at"), F.least(F.lit(PART), run["end"] - at).alias("places"), around.alias("around"))

        return F.transform(F.sequence(run["start"], run["end"] - 1, F.lit(PART)), part)

    def windows(part):
        def at(q):
            return F.struct((part["at"] + q).alias("start"), F.substring(part["around"], q + 1, F.lit(BEFORE)).alias("before"), F.substring(part["around"], q + BEFORE, F.lit(REACH)).alias("ahead"))

        def found(a):
            texts = F.filter(F.array(*[F.regexp_extract(a["ahead"], p, 1) for p in WINDOWS[name]]), lambda w: w != "")
            return F.transform(texts, lambda w: F.struct(a["start"].alias("start"), (a["start"] + F.length(w)).alias("end"), w.alias("hit"), a["before"].alias("before"), F.substring(a["ahead"], F.length(w) + 2, F.lit(2)).alias("after")))

        starts = F.filter(F.transform(F.sequence(F.lit(0), part["places"] - 1), at), lambda a: a["ahead"].rlike(r"(?s)^[^0-9][+(]{0,2}[0-9]"))
        return F.flatten(F.transform(starts, found))

    none = F.array().cast("array<struct<start:int,end:int,hit:string,before:string,after:string>>")
    return F.when(F.size(runs) > 0, F.flatten(F.transform(F.flatten(F.transform(runs, parts)), windows))).otherwise(none)


def _bucket(n: Column, *cuts: int) -> Column:
    """How many of the cuts are below n."""
    return let(n, lambda m: F.array_size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c < m)))


def _code(kind: int, span: Column, name: str) -> Column:
    """The feature vector of {hit, before, after} as one number, in mixed radix."""
    hit, before, after = span["hit"], span["before"], span["after"]
    if name == "ip":
        mark = before.rlike(r"[0-9]\.$") | after.rlike(r"^\.[0-9]")
    else:
        mark = hit.rlike("^[3-6]" if name == "card" else r"[()\[\]]")
    values = [
        F.lit(kind),
        _bucket(F.length(_digits(hit)), *CUTS[name]),
        _bucket(F.size(F.split(hit, "[^0-9A-Za-z]+")), 1, 2, 3, 4, 5),
        mark.cast("int"),
        F.when(hit.contains(" "), 2).when(hit.rlike("[.-]"), 1).otherwise(0),
        before.rlike(CONTEXT[name]).cast("int"),
        (before.rlike("[0-9A-Za-z]$") | after.rlike("^[0-9A-Za-z]")).cast("int"),
    ]
    code = F.lit(0)
    for v, (_, size) in zip(values, FEATURES):
        code = code * size + v
    return code


def unpacked(code: int) -> tuple[int, ...]:
    out = []
    for _, size in reversed(FEATURES):
        code, v = divmod(code, size)
        out.append(v)
    return tuple(reversed(out))


def _passing(spans: Column, check) -> Column:
    return F.filter(spans, lambda s: check(s["hit"]))


def candidates(docs: DataFrame, text_col: str = "text", keep: list[str] = ()) -> DataFrame:
    """Columns to keep, base spans by kind, and candidates [{kind, start, end, code, label, open}] with their text's half; one scan of the texts."""
    own = docs.select(F.struct(*keep).alias("row") if keep else F.lit(None).alias("row"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    text = F.col("text")
    number = text.rlike(r"[0-9][\x20().-]{0,2}[0-9]")
    may = {"email": text.contains("@"), "ip": number & text.rlike(r"[0-9]\.[0-9]"), "card": text.rlike(r"(?:[0-9][\x20-]?){13}[0-9]"), "phone": text.contains("+")}
    wide_may = {"email": text.contains("@") | text.contains("(at)") | text.contains("[at]"), "phone": text.rlike(r"(?:[0-9][\x20().-]{0,2}){9}[0-9]"), "card": text.rlike(r"(?:[0-9][\x20.-]?){12}[0-9]"), "ip": may["ip"] & text.rlike(r"(?:[0-9]\.[0-9]+){2}")}
    own = own.select("*", *[hits(text, PATTERNS[k], may[k]).alias(f"h_{k}") for k in KINDS], *[hits(text, WIDE[k], wide_may[k]).alias(f"w_{k}") for k in WIDE])
    own = own.select("row", "text", *[located(text, PATTERNS[k], F.col(f"h_{k}")).alias(f"h_{k}") for k in KINDS], *[located(text, WIDE[k], F.col(f"w_{k}")).alias(f"w_{k}") for k in WIDE])
    slim = lambda spans: F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))
    base = [slim(_passing(F.col(f"h_{k}"), CHECKS[k])).alias(k) for k in KINDS]
    own = own.select("row", "text", *base, *[f"w_{k}" for k in WIDE])

    def around(s):
        return F.struct(s["start"].alias("start"), s["end"].alias("end"), s["hit"].alias("hit"), F.substring(text, F.greatest(s["start"] - BEFORE + 1, F.lit(1)), F.least(s["start"], F.lit(BEFORE))).alias("before"), F.substring(text, s["end"] + 1, F.lit(2)).alias("after"))

    def scored(kind, name):
        spans = _windows(text, F.col(f"w_{name}"), name) if name in WINDOWS else F.transform(F.col(f"w_{name}"), around)

        def one(s):
            same = F.exists(name, lambda o: (o["start"] == s["start"]) & (o["end"] == s["end"]))
            label = WINDOW_CHECKS[name](s["hit"]) if name in WINDOW_CHECKS else same
            return F.struct(F.lit(name).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), _code(kind, s, name).alias("code"), label.alias("label"))

        return F.transform(spans, one)

    both = F.concat(*[scored(i, k) for i, k in enumerate(WIDE)])
    return own.select("row", *KINDS, both.alias("proposed"), F.pmod(F.xxhash64("text"), F.lit(2)).cast("int").alias("half"))


class Boosted:
    """Depth-2 regression trees on the feature vectors; thresholds by kind.

    counts and held: labels 0 and 1 of each feature vector, for fitting and for thresholds.
    """

    def __init__(self, counts: dict[int, tuple[int, int]], held: dict[int, tuple[int, int]], rounds: int = ROUNDS, rate: float = RATE, precision: float = PRECISION):
        rows = [(unpacked(c), no, yes) for c, (no, yes) in sorted(counts.items())]
        total, good = sum(r[1] + r[2] for r in rows), sum(r[2] for r in rows)
        self.start = math.log((good + 1) / (total - good + 1))
        self.trees, self.thresholds, self.precision = [], {}, {}
        score = [self.start] * len(rows)
        for _ in range(rounds if rows else 0):
            p = [1 / (1 + math.exp(-s)) for s in score]
            stats = [(x, yes - (no + yes) * q, (no + yes) * q * (1 - q)) for (x, no, yes), q in zip(rows, p)]
            tree = self._split(stats, rate, 2)
            self.trees.append(tree)
            score = [s + self._value(tree, x) for s, (x, _, _) in zip(score, rows)]
        for kind, name in enumerate(WIDE):
            steps: dict[float, list[int]] = {}
            for c, (no, yes) in held.items():
                if unpacked(c)[0] == kind:
                    step = steps.setdefault(round(self.score(unpacked(c)), 9), [0, 0])
                    step[0], step[1] = step[0] + no, step[1] + yes
            no = yes = 0
            for s in sorted(steps, reverse=True):
                no, yes = no + steps[s][0], yes + steps[s][1]
                chance = CHANCE.get(name)
                wrong = no * chance / (1 - chance) if chance else no
                share = max(0.0, yes - wrong if chance else yes) / (yes + 1 if chance else yes + no + 1)
                if share >= precision:
                    self.thresholds[name], self.precision[name] = s - 1e-6, share

    def _split(self, stats, rate, depth):
        g, h = sum(s[1] for s in stats), sum(s[2] for s in stats)
        leaf = rate * g / (h + 1)
        if not depth:
            return leaf
        best, gain = None, 1e-6
        for f, (_, size) in enumerate(FEATURES):
            for cut in range(size - 1):
                gl, hl = sum(s[1] for s in stats if s[0][f] <= cut), sum(s[2] for s in stats if s[0][f] <= cut)
                now = gl * gl / (hl + 1) + (g - gl) ** 2 / (h - hl + 1) - g * g / (h + 1)
                if now > gain:
                    best, gain = (f, cut), now
        if best is None:
            return leaf
        f, cut = best
        return f, cut, self._split([s for s in stats if s[0][f] <= cut], rate, depth - 1), self._split([s for s in stats if s[0][f] > cut], rate, depth - 1)

    def _value(self, tree, x):
        while isinstance(tree, tuple):
            tree = tree[2] if x[tree[0]] <= tree[1] else tree[3]
        return tree

    def score(self, x) -> float:
        return self.start + sum(self._value(t, x) for t in self.trees)

    def chosen(self) -> dict[int, int]:
        """Scores in thousandths of all feature vectors that are above their kind's threshold."""
        names = list(WIDE)
        scores = {c: self.score(unpacked(c)) for c in range(CODES)} if self.thresholds else {}
        return {c: round(1000 * s) for c, s in scores.items() if s >= self.thresholds.get(names[unpacked(c)[0]], math.inf)}


def fit(found: DataFrame, **options) -> Boosted:
    """From the counts of all candidates' feature vectors: at most CODES rows a label and half."""
    rows = found.select(F.explode("proposed").alias("p"), "half").groupBy("p.code", "p.label", "half").agg(F.count("*").alias("n")).collect()
    counts: tuple[dict[int, tuple[int, int]], ...] = ({}, {})
    for r in rows:
        no, yes = counts[r["half"]].get(r["code"], (0, 0))
        counts[r["half"]][r["code"]] = (no, yes + r["n"]) if r["label"] else (no + r["n"], yes)
    return Boosted(*counts, **options)


def _best(spans: Column) -> Column:
    """Of spans (start, rank, end, kind, score) those that overlap no better one that is kept; ties to the first start, then kind."""
    best_first = F.array_sort(F.transform(spans, lambda s: F.struct((-s["score"]).alias("loss"), s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end"), s["kind"].alias("kind"))))

    def step(done, s):
        return F.when(F.exists(done, lambda o: (s["start"] < o["end"]) & (o["start"] < s["end"])), done).otherwise(F.concat(done, F.array(s)))

    kept = F.aggregate(best_first, F.array().cast("array<struct<loss:int,start:int,rank:int,end:int,kind:string>>"), step)
    return F.array_sort(F.transform(kept, lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end"), s["kind"].alias("kind"))))


def _all(found: DataFrame, model: Boosted) -> DataFrame:
    """found with base (all base spans) and added (what the model adds)."""
    found = found.withColumn("base", F.concat(*[tagged(F.col(k), k, i) for i, k in enumerate(KINDS)]))
    chosen = model.chosen()
    if not chosen:
        return found.withColumn("added", F.array().cast(SPANS))
    # foldable: one literal in the plan
    scores = F.split(F.lit(",".join(str(chosen.get(c, NO)) for c in range(CODES))), ",").cast("array<int>")
    rank = lambda s: F.array_position(F.array(*map(F.lit, KINDS)), s["kind"]).cast("int") - 1
    # only with a good check or a known ending; phones with the label are base spans
    able = F.filter("proposed", lambda s: F.when(s["kind"].isin(*WINDOW_CHECKS), s["label"]).otherwise(~s["label"]))
    scored = F.transform(outside(able, F.col("base")), lambda s: F.struct(s["start"].alias("start"), rank(s).alias("rank"), s["end"].alias("end"), s["kind"].alias("kind"), F.get(scores, s["code"]).alias("score")))
    best = _best(F.filter(scored, lambda s: s["score"] > NO))
    return found.withColumn("added", best)


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per row of docs: id, n_<kind>, base_sha256, spans, n_added, n_spans."""
    found = written(candidates(docs, text_col, [id_col]), "pii")
    every = _all(found, fit(found))
    return every.select(
        F.col("row")[id_col].alias(id_col),
        *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(joined(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        joined(F.concat("base", "added")).alias("spans"),
        F.size("added").cast("long").alias("n_added"),
        F.size(F.concat("base", "added")).cast("long").alias("n_spans"),
    )


def redacted(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with every span replaced by its kind in brackets. The texts are scanned once; rows and spans are written, so that neither is made again."""
    found = written(candidates(docs, text_col, docs.columns), "pii")
    every = _all(found, fit(found)).select("row", F.concat("base", "added").alias("spans"))
    text = replaced(F.col("row")[text_col], F.col("spans"))
    return every.select(*[text.alias(c) if c == text_col else F.col("row")[c].alias(c) for c in docs.columns])
