"""Words of long texts, counted in a task over whole Arrow arrays: a different word is seen once a batch, and stemmed once."""

import re

import numpy as np
import pyarrow as pa

from .. import constants as K

WORD, MATCH_WORD = re.compile(K.WORD), re.compile(K.MATCH_WORD)
STOPWORDS, MATCH_STOPWORDS, SUFFIXES = frozenset(K.STOPWORDS), frozenset(K.MATCH_STOPWORDS), frozenset(K.SUFFIXES)
LENGTHS = sorted({len(x) for x in SUFFIXES}, reverse=True)
#: Bytes of text that are counted at a time, and words that are remembered.
BYTES, KNOWN = 1 << 23, 1 << 19
#: A text's number of words, stopwords aside, and how often each term is among them.
SCHEMA = "dl int, own array<struct<term:string,tf:bigint>>"
#: Codes of stopwords and of words whose terms are not asked for.
STOP, OTHER = -1, -2
#: Lower case of the bytes of words in UTF-8, of which those that are no ASCII have two and begin alike; other bytes are 0.
LEAD = 0xC3
LOW, SECOND = np.zeros(256, np.uint8), np.zeros(256, np.uint8)
for _c in map(chr, range(0x800)):
    if WORD.fullmatch(_c):
        *_lead, _last = _c.encode()
        if _lead not in ([], [LEAD]):
            raise ValueError(f"{_c} does not begin with {LEAD}")
        (SECOND if _lead else LOW)[_last] = _c.lower().encode()[-1]


def stem(word: str) -> str:
    """A word without its longest suffix that leaves MIN_STEM letters, as text.stem does it."""
    for n in LENGTHS:
        if len(word) - n >= K.MIN_STEM and word[-n:] in SUFFIXES:
            return word[:-n]
    return word


class MatchWords(dict):
    """Words as they are written, and what text.match_words makes of each: its stem in lower case, or None where it is left out."""

    def __missing__(self, word: str) -> str | None:
        low = word.lower()
        term = self[word] = None if len(low) <= 2 or low in MATCH_STOPWORDS else stem(low)
        return term

    def of(self, text: str | None) -> set[str]:
        if len(self) > KNOWN:
            self.clear()
        return {term for term in map(self.__getitem__, MATCH_WORD.findall(text or "")) if term is not None}


class Terms(dict):
    """Codes of lower-case words: a place in `names`, STOP or OTHER; with `asked`, only these have places."""

    def __init__(self, asked=None):
        self.fixed = asked is not None
        self.names = sorted(asked or ())
        self.places = {t: n for n, t in enumerate(self.names)}
        #: How asked terms begin, which suffixes leave as it is: most other words are told by it.
        self.heads = {t[: K.MIN_STEM] for t in self.names}

    def __missing__(self, word: str) -> int:
        if word in STOPWORDS:
            code = STOP
        elif self.fixed and word[: K.MIN_STEM] not in self.heads:
            code = OTHER
        else:
            term = stem(word)
            code = self.places.get(term, OTHER)
            if code == OTHER and not self.fixed:
                code = self.places[term] = len(self.names)
                self.names.append(term)
        self[word] = code
        return code

    def forget(self) -> None:
        self.clear()
        if not self.fixed:
            self.names.clear()
            self.places.clear()


def words_of(texts: pa.StringArray) -> tuple[np.ndarray, pa.StringArray]:
    """The words of all texts in lower case, in order, and the text that each is of."""
    size, bounds = len(texts), np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
    if bounds[0] == bounds[-1]:
        return np.empty(0, int), pa.array([], pa.string())
    data = np.frombuffer(texts.buffers()[2], np.uint8)[bounds[0] : bounds[-1]]
    low, starts = LOW[data], bounds[:-1] - bounds[0]
    lead = np.flatnonzero(data[:-1] == LEAD)
    second = SECOND[data[lead + 1]]
    lead, second = lead[second > 0], second[second > 0]
    low[lead], low[lead + 1] = LEAD, second
    held = low > 0
    edge = np.ones(len(data), bool)
    np.logical_not(held[:-1], out=edge[1:])
    edge[starts[starts < len(data)]] = True
    first = np.flatnonzero(held & edge)
    ends = np.append(np.cumsum(held, dtype=np.int32)[first] - 1, np.count_nonzero(held)).astype(np.int32)
    words = pa.StringArray.from_buffers(len(first), pa.py_buffer(ends), pa.py_buffer(low[held]))
    return np.searchsorted(starts, first, "right") - 1, words


def _parts(batch: pa.RecordBatch):
    """Some rows at a time, of BYTES of text or one."""
    ends = np.frombuffer(batch.column(1).buffers()[1], np.int32)[batch.column(1).offset :][: batch.num_rows + 1]
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + BYTES, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def counted(sent=None):
    """For mapInArrow over (id, text): (id, dl, own) as in SCHEMA; with a broadcast set of terms, only these are in `own`. A null text has no words."""

    def run(batches):
        terms = Terms(None if sent is None else sent.value)
        for batch in batches:
            texts = batch.column(1).cast(pa.string()).fill_null("")
            for part in _parts(pa.RecordBatch.from_arrays([batch.column(0), texts], batch.schema.names[:2])):
                row, words = words_of(part.column(1))
                words = words.dictionary_encode()
                codes = np.fromiter(map(terms.__getitem__, words.dictionary.to_pylist()), np.int64, len(words.dictionary))
                code = codes[words.indices.to_numpy()]
                length = np.bincount(row[code != STOP], minlength=part.num_rows)
                n = max(1, len(terms.names))
                key, times = np.unique(row[code >= 0] * n + code[code >= 0], return_counts=True)
                ends = np.searchsorted(key, np.arange(part.num_rows + 1) * n)
                own = pa.StructArray.from_arrays([pa.array(terms.names, pa.string()).take(pa.array(key % n)), pa.array(times, pa.int64())], ["term", "tf"])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(length, pa.int32()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), own)], [batch.schema.names[0], "dl", "own"])
                if len(terms) > KNOWN:
                    terms.forget()

    return run
