"""Splitting texts into passages of at most MAX_CHARS characters, plus an overlap."""

import re

import pandas as pd
from pyspark.sql import Column, types
from pyspark.sql import functions as F

from .. import constants as K

ENDS = re.compile(r"(?<=[.!?])\s+")


def _packed(parts, between: str, most: int) -> list[str]:
    """Parts joined while they fit; a part that is alone and just as long as a piece may be stays as it is."""
    out, held = [], ""
    for p in parts:
        if len(held) + len(between) + len(p) <= most:
            held = f"{held}{between}{p}".strip()
        else:
            out += [held] if held else []
            held = p
    return out + ([held] if held else [])


def _sentences(paragraph: str, most: int, overlap: int, ordered: bool) -> list[str]:
    """Sentences packed with blanks. One that is too long loses pieces of `most` characters, each `overlap` into the next, and its rest is packed on.

    ordered: what is held goes before such pieces; else after them, as the rest is packed with it.
    """
    out, run = [], []
    for s in ENDS.split(paragraph):
        if ordered and len(s) > most:
            out += _packed(run, " ", most)
            run = []
        elif len(s) > most and run:
            # what is held already moves on, in packed form, with the rest
            *done, held = _packed(run, " ", most)
            out += done
            run = [held]
        while len(s) > most:
            out.append(s[:most])
            s = s[most - overlap :]
        run.append(s)
    return out + _packed(run, " ", most)


def split_text(text: str | None, most: int = K.MAX_CHARS, overlap: int = K.OVERLAP, ordered: bool = True) -> list[str]:
    """Pieces of a text: paragraphs, then sentences, packed while they fit, in the order of the text (see _sentences).

    Each piece after the first starts with the tail of the one before, from
    its first blank on; where that tail has no blank, the piece stays as it is
    (unordered, it loses white space at its ends all the same). A short text
    is one piece, an empty one has none.
    """
    text = (text or "").strip()
    if len(text) <= most:
        return [text] if text else []
    paras = filter(None, map(str.strip, re.split(r"\n\s*\n", text)))
    pieces = _packed([p for para in paras for p in ([para] if len(para) <= most else _sentences(para, most, overlap, ordered))], "\n\n", most)
    if not overlap:
        return pieces
    tails = (p[-overlap:].partition(" ")[1:] for p in pieces)
    return pieces[:1] + [f"{t} {p}".strip() if blank or not ordered else p for (blank, t), p in zip(tails, pieces[1:])]


@F.pandas_udf(types.ArrayType(types.StringType()))
def split_pieces(texts: pd.Series) -> pd.Series:
    return texts.map(split_text)


def paragraphs(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, r"\n\s*\n"), F.trim), lambda p: p != "")
