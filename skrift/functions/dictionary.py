"""Entries of a dictionary in texts: an Aho-Corasick automaton, one pass a text whatever the number of entries."""

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

HITS = "array<struct<start:int,end:int,entry:string>>"


def _borders(text: str, start: int, end: int) -> bool:
    """Do no letters, digits or underscores touch the hit?"""
    inner = lambda c: c.isalnum() or c == "_"
    return not (start and inner(text[start - 1]) and inner(text[start])) and not (end < len(text) and inner(text[end]) and inner(text[end - 1]))


def entries_in(text: Column, entries, longest: bool = False) -> Column:
    """[{start, end, entry}] of the entries that stand in a text between word borders, in order; with `longest`, of those that overlap the first, and of these the longest.

    Entries are matched as they are: lower both where case should not count.
    Places count code points. A null text has none, nor has an empty entry.
    """
    names = sorted({e for e in entries if e})

    @F.pandas_udf(HITS)
    def found(texts: pd.Series) -> pd.Series:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for e in names:
            automaton.add_word(e, e)
        automaton.make_automaton()

        def one(text):
            if not text or not names:
                return []
            hits = sorted((last + 1 - len(e), -last - 1, e) for last, e in automaton.iter(text) if _borders(text, last + 1 - len(e), last + 1))
            out, end = [], 0
            for start, last, e in hits:
                if not longest or start >= end:
                    out.append({"start": start, "end": -last, "entry": e})
                    end = -last
            return out

        return texts.map(one)

    return found(text)
