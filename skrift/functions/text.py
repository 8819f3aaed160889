"""Text functions as Column builders; everything stays in the JVM."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as K
from .dictionary import entries_in


def words(text: Column, pattern: str = K.WORD) -> Column:
    """Case-preserving extraction, then lower case."""
    return F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.lower)


def stem(word: Column) -> Column:
    return F.regexp_replace(word, f"^(.{{{K.MIN_STEM},}}?)(?:{'|'.join(K.SUFFIXES)})$", "$1")


def without(items: Column, drop) -> Column:
    banned = F.array(*[F.lit(w) for w in dict.fromkeys(drop)])
    return F.filter(items, lambda w: ~F.array_contains(banned, w))


def tokens(text: Column, drop_party_words: bool = False) -> Column:
    """Words, without stopwords (and party words), stemmed; repeats stay."""
    return F.transform(without(words(text), (*K.STOPWORDS, *(K.PARTY_WORDS if drop_party_words else ()))), stem)


def match_words(text: Column) -> Column:
    """The distinct stemmed words of over two letters that proposals and sections are matched by."""
    own = F.filter(words(text, K.MATCH_WORD), lambda w: F.length(w) > 2)
    return F.array_distinct(F.transform(without(own, K.MATCH_STOPWORDS), stem))


def split_set(joined: Column) -> Column:
    """A ;-joined set as an array without blanks."""
    return F.filter(F.split(joined, ";"), lambda x: x != "")


def clean(text: Column) -> Column:
    """White space of any kind as one blank; soft hyphens go."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, "\u00ad", ""), r"(?U)\s+", " "))


def content_key(text: Column) -> Column:
    return F.left(F.sha1(text.cast("binary")), F.lit(16))


def content_hash(text: Column) -> Column:
    return F.left(F.sha2(text.cast("binary"), 256), F.lit(16))


def embedded(context: Column, text: Column) -> Column:
    return F.concat(F.lit("passage: "), context, F.lit("\n"), text)


def proposal_core(text: Column) -> Column:
    """A proposal without its set phrases; the first pattern that fits counts."""
    # The two set phrases.
    stands = r"(?iu)^Riksdagen ställer sig bakom det som anförs i motionen om (?:att )?(.+?)[,.]?\s*och\s+(?:detta\s+tillkännager\s+riksdagen|tillkännager\s+detta)\s+för\s+regeringen\.?\s*$"
    rejects = r"(?iu)^Riksdagen avslår regeringens förslag\s+(?:avseende|i\s+den\s+del\s+som\s+avser)\s+(.+?)\.?\s*$"
    out = text
    for pattern in (rejects, stands):
        out = F.when(text.rlike(pattern), F.trim(F.regexp_extract(text, pattern, 1))).otherwise(out)
    return out


def cited_numbers(answer: Column) -> Column:
    """[3], [3, 5] and [3-5]; a range is expanded when it spans 1 to 49."""
    marks = F.regexp_extract_all(answer, F.lit(K.CITATION), F.lit(0))
    parts = F.flatten(F.transform(marks, lambda m: F.split(F.regexp_replace(m, r"[\[\]\s]", ""), ",")))

    def numbers(part):
        bounds = F.transform(F.filter(F.split(part, "[–-]"), lambda x: x != ""), lambda x: x.cast("int"))
        span = F.get(bounds, 1) - F.get(bounds, 0)
        return F.when((F.size(bounds) == 2) & (span > 0) & (span < 50), F.sequence(F.get(bounds, 0), F.greatest(F.get(bounds, 1), F.get(bounds, 0)))).otherwise(bounds)

    return F.flatten(F.transform(parts, numbers))


def without_citations(text: Column) -> Column:
    return F.regexp_replace(text, K.CITATION, "")


def without_layer_labels(text: Column) -> Column:
    return F.regexp_replace(text, K.LAYER_LABEL, "")


def mentioned(answer: Column) -> Column:
    """Codes of the parties that an answer names, or writes as a code of its own, in slot order."""
    named = [F.when(answer.rlike(rf"(?U)(?:{names})|(?<![\w-]){code}(?![\w-])"), F.lit(code)) for code, names in K.PARTY_NAMES_IN_ANSWERS.items()]
    return F.array_compact(F.array(*named))


def sentences(text: Column) -> Column:
    """Sentences of an answer: no headings, labels or list markers; a citation behind a stop goes before it."""
    lines = F.transform(F.split(text, r"\r\n|\r|\n"), lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", ""))
    lines = F.filter(lines, lambda x: (x != "") & ~x.startswith("#") & ~x.endswith(":") & ~(x.startswith("**") & x.endswith("**")))
    lines = F.transform(lines, lambda x: F.regexp_replace(F.regexp_replace(x, K.LIST_MARKER, ""), K.TRAILING_CITATIONS, "$2$1"))
    return F.filter(F.flatten(F.transform(lines, lambda x: F.split(x, r"(?<=[.!?])\s+"))), lambda s: s != "")


def substantive(sentence: Column) -> Column:
    """Six words at least, and neither a gap nor a refusal."""
    long = F.size(F.regexp_extract_all(without_citations(sentence), F.lit(r"(?U)\S+"), F.lit(0))) >= 6
    return long & ~sentence.rlike(f"(?iu){K.GAP}") & ~sentence.rlike(f"(?iu){K.REFUSAL}")


def language(text: Column) -> Column:
    own = F.regexp_extract_all(F.lower(text), F.lit(r"(?U)\w+"), F.lit(0))
    count = lambda vocabulary: F.size(F.filter(own, lambda w: F.array_contains(F.array(*map(F.lit, vocabulary)), w)))
    return F.when(count(K.ENGLISH) > count(K.SWEDISH), "en").otherwise("sv")


def asks_for_voting_advice(question: Column) -> Column:
    return question.rlike(f"(?iu){K.VOTING_ADVICE}")


def parties_in(question: Column) -> Column:
    """Codes of the parties named, by alias, longest alias first: the text is run through one automaton of all aliases."""
    order = sorted(K.ALIASES, key=len, reverse=True)
    place = F.create_map(*[F.lit(x) for n, alias in enumerate(order) for x in (alias, n)])
    hits = F.array_sort(F.array_distinct(F.transform(entries_in(F.lower(question), order), lambda h: place[h["entry"]])))
    return F.array_distinct(F.transform(hits, lambda n: F.get(F.array(*[F.lit(K.ALIASES[alias]) for alias in order]), n)))


def truncated(text: Column, chars: int) -> Column:
    """At most so many characters, cut at a blank, and marked."""
    return F.when(F.length(text) > chars, F.concat(F.regexp_replace(F.left(text, F.lit(chars)), "(?s) [^ ]*$", ""), F.lit(" …"))).otherwise(text)


def subset(items: Column, of: Column) -> Column:
    return F.size(F.array_except(items, of)) == 0


def day(stamp: Column) -> Column:
    """The date of an ISO time stamp."""
    return F.left(stamp, F.lit(10))


def budget_year(session: Column) -> Column:
    """The year that a session's budget is for: that after its first one."""
    return F.left(session, F.lit(4)).cast("int") + 1


def slug(url: Column) -> Column:
    last = F.element_at(F.split(F.regexp_replace(url, "/+$", ""), "/"), -1)
    return F.when(last == "", "index").otherwise(last)


def before_marker(text: Column, marker: str) -> Column:
    at = F.instr(text, marker)
    return F.when(at > 0, F.regexp_replace(F.left(text, at - 1), r"(?U)\s+$", "")).otherwise(text)
