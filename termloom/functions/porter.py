"""Suffix stripping after M. F. Porter, An algorithm for suffix stripping (1980), over distinct terms."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

#: Endings by step as the paper has them; fixed values.
STEP2 = [("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble")]
STEP3 = [("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", "")]
STEP4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize"]


def _shape(w: str) -> str:
    """c and v for every letter; y is a vowel after a consonant."""
    out = ""
    for ch in w:
        out += "v" if ch in "aeiou" or ch == "y" and out[-1:] == "c" else "c"
    return out


def _measure(w: str) -> int:
    return _shape(w).count("vc")


def _cvc(w: str) -> bool:
    return _shape(w).endswith("cvc") and w[-1] not in "wxy"


def _longest(w: str, ends: list[tuple[str, str]]) -> tuple[str, str] | None:
    hits = [e for e in ends if w.endswith(e[0])]
    return max(hits, key=lambda e: len(e[0])) if hits else None


def stem(word: str) -> str:
    """The stem of an English word; other words (with signs, digits or letters beyond a to z) stay in lower case."""
    w = word.lower()
    if len(w) < 3 or not (w.isascii() and w.isalpha()):
        return w
    if w.endswith("sses") or w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    cut = None
    if w.endswith("eed"):
        if _measure(w[:-3]) > 0:
            w = w[:-1]
    elif w.endswith("ed") and "v" in _shape(w[:-2]):
        cut = w[:-2]
    elif w.endswith("ing") and "v" in _shape(w[:-3]):
        cut = w[:-3]
    if cut is not None:
        w = cut
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif len(w) > 1 and w[-1] == w[-2] and _shape(w)[-1] == "c" and w[-1] not in "lsz":
            w = w[:-1]
        elif _measure(w) == 1 and _cvc(w):
            w += "e"
    if w.endswith("y") and "v" in _shape(w[:-1]):
        w = w[:-1] + "i"
    for ends in (STEP2, STEP3):
        if (e := _longest(w, ends)) and _measure(w[: len(w) - len(e[0])]) > 0:
            w = w[: len(w) - len(e[0])] + e[1]
    if e := _longest(w, [(x, "") for x in STEP4]):
        base = w[: len(w) - len(e[0])]
        if _measure(base) > 1 and (e[0] != "ion" or base.endswith(("s", "t"))):
            w = base
    if w.endswith("e"):
        base = w[:-1]
        if _measure(base) > 1 or _measure(base) == 1 and not _cvc(base):
            w = base
    if w.endswith("ll") and _measure(w) > 1:
        w = w[:-1]
    return w


def stem_column(term: Column) -> Column:
    """The stems of a column; every distinct term of a batch is stemmed once."""

    @F.pandas_udf("string")
    def run(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in it:
            done = {w: stem(w) for w in set(s) if isinstance(w, str)}
            yield pd.Series([done.get(w) if isinstance(w, str) else None for w in s], dtype=object)

    return run(term)


def stems(terms: DataFrame, col: str = "term") -> DataFrame:
    """(term, stem) of every distinct term; null terms have none."""
    return terms.select(col).filter(F.col(col).isNotNull()).distinct().withColumn("stem", stem_column(F.col(col)))
