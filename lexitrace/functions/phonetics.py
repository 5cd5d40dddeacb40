"""Phonetic keys of words: Double Metaphone (L. Philips, C/C++ Users Journal, 2000).

Spark has no such function. Words are encoded by a vectorised UDF, once for each distinct
word, and keys are joined back.
"""

from __future__ import annotations

from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as ST

VOWELS = "AEIOUY"


class _Word:
    """A word under encoding: rules look around a place and add to two keys."""

    def __init__(self, word: str) -> None:
        self.s, self.n = word, len(word)
        self.slavic = any(x in word for x in ("W", "K", "CZ", "WITZ"))
        self.germanic = word.startswith("SCH") or word.startswith(("VAN ", "VON "))
        self.first: list[str] = []
        self.second: list[str] = []

    def at(self, i: int, *options: str) -> bool:
        return i >= 0 and self.s.startswith(options, i)

    def vowel(self, i: int) -> bool:
        return 0 <= i < self.n and self.s[i] in VOWELS

    def end(self, i: int) -> bool:
        return i == self.n - 1

    def add(self, one: str, two: str | None = None) -> None:
        self.first.append(one)
        self.second.append(one if two is None else two)


def _plain(key: str, *doubles: str):
    """A letter with one sound, said once with any of ``doubles`` behind it."""

    def rule(w: _Word, i: int) -> int:
        w.add(key)
        return 2 if doubles and w.at(i + 1, *doubles) else 1

    return rule


def _vowel(w: _Word, i: int) -> int:
    if i == 0:
        w.add("A")
    return 1


def _ch(w: _Word, i: int) -> int:
    greek = i == 0 and w.at(1, "HARAC", "HARIS", "HOR", "HYM", "HIA", "HEM") and not w.at(0, "CHORE")
    hard = w.germanic or w.at(i - 2, "ORCHES", "ARCHIT", "ORCHID") or w.at(i + 2, "T", "S")
    open_ = (i == 0 or w.at(i - 1, "A", "O", "U", "E")) and (w.at(i + 2, *"LRNMBHFVW ") or i + 1 == w.n - 1)
    if i > 0 and w.at(i, "CHAE"):
        w.add("K", "X")
    elif greek or hard or open_:
        w.add("K")
    elif i == 0:
        w.add("X")
    elif w.at(0, "MC"):
        w.add("K")
    else:
        w.add("X", "K")
    return 2


def _c(w: _Word, i: int) -> int:
    bacher = i > 1 and not w.vowel(i - 2) and w.at(i - 1, "ACH") and (not w.at(i + 2, "I", "E") or w.at(i - 2, "BACHER", "MACHER"))
    if w.at(i, "CHIA") or bacher:
        w.add("K")
        return 2
    if i == 0 and w.at(0, "CAESAR"):
        w.add("S")
        return 2
    if w.at(i, "CH"):
        return _ch(w, i)
    if w.at(i, "CZ") and not w.at(i - 2, "WICZ"):
        w.add("S", "X")
        return 2
    if w.at(i + 1, "CIA"):
        w.add("X")
        return 3
    if w.at(i, "CC") and not (i == 1 and w.at(0, "M")):
        if w.at(i + 2, "I", "E", "H") and not w.at(i + 2, "HU"):
            w.add("KS" if i == 1 and w.at(0, "A") or w.at(i - 1, "UCCEE", "UCCES") else "X")
            return 3
        w.add("K")
        return 2
    if w.at(i, "CK", "CG", "CQ"):
        w.add("K")
        return 2
    if w.at(i, "CI", "CE", "CY"):
        w.add("S", "X" if w.at(i, "CIO", "CIE", "CIA") else None)
        return 2
    w.add("K")
    if w.at(i + 1, " C", " Q", " G"):
        return 3
    return 2 if w.at(i + 1, "C", "K", "Q") and not w.at(i + 1, "CE", "CI") else 1


def _d(w: _Word, i: int) -> int:
    if w.at(i, "DG"):
        soft = w.at(i + 2, "I", "E", "Y")
        w.add("J" if soft else "TK")
        return 3 if soft else 2
    w.add("T")
    return 2 if w.at(i, "DT", "DD") else 1


def _gh(w: _Word, i: int) -> int:
    if i > 0 and not w.vowel(i - 1):
        w.add("K")
    elif i == 0:
        w.add("J" if w.at(2, "I") else "K")
    elif w.at(i - 2, "B", "H", "D") or w.at(i - 3, "B", "H", "D") or w.at(i - 4, "B", "H"):
        pass  # silent, as in hugh or bough
    elif i > 2 and w.at(i - 1, "U") and w.at(i - 3, "C", "G", "L", "R", "T"):
        w.add("F")
    elif not w.at(i - 1, "I"):
        w.add("K")
    return 2


def _g(w: _Word, i: int) -> int:
    if w.at(i + 1, "H"):
        return _gh(w, i)
    if w.at(i + 1, "N"):
        if i == 1 and w.vowel(0) and not w.slavic:
            w.add("KN", "N")
        elif not w.at(i + 2, "EY") and not w.slavic:
            w.add("N", "KN")
        else:
            w.add("KN")
        return 2
    if w.at(i + 1, "LI") and not w.slavic:
        w.add("KL", "L")
        return 2
    if i == 0 and w.at(1, "Y", "ES", "EP", "EB", "EL", "EY", "IB", "IL", "IN", "IE", "EI", "ER"):
        w.add("K", "J")
        return 2
    if w.at(i + 1, "ER", "Y") and not w.at(0, "DANGER", "RANGER", "MANGER") and not w.at(i - 1, "E", "I") and not w.at(i - 1, "RGY", "OGY"):
        w.add("K", "J")
        return 2
    if w.at(i + 1, "E", "I", "Y") or w.at(i - 1, "AGGI", "OGGI"):
        if w.germanic or w.at(i + 1, "ET"):
            w.add("K")
        elif w.at(i + 1, "IER"):
            w.add("J")
        else:
            w.add("J", "K")
        return 2
    w.add("K")
    return 2 if w.at(i + 1, "G") else 1


def _h(w: _Word, i: int) -> int:
    if (i == 0 or w.vowel(i - 1)) and w.vowel(i + 1):
        w.add("H")
        return 2
    return 1


def _j(w: _Word, i: int) -> int:
    spanish = w.at(0, "SAN ")
    if w.at(i, "JOSE") or spanish:
        if spanish or w.n == 4 or i == 0 and w.at(4, " "):
            w.add("H")
        else:
            w.add("J", "H")
        return 1
    if i == 0:
        w.add("J", "A")
    elif w.vowel(i - 1) and not w.slavic and w.at(i + 1, "A", "O"):
        w.add("J", "H")
    elif w.end(i):
        w.add("J", "")
    elif not w.at(i + 1, *"LTKSNMBZ") and not w.at(i - 1, "S", "K", "L"):
        w.add("J")
    return 2 if w.at(i + 1, "J") else 1


def _l(w: _Word, i: int) -> int:
    if not w.at(i + 1, "L"):
        w.add("L")
        return 1
    spanish = i == w.n - 3 and w.at(i - 1, "ILLO", "ILLA", "ALLE")
    spanish |= (w.at(w.n - 2, "AS", "OS") or w.s.endswith(("A", "O"))) and w.at(i - 1, "ALLE")
    w.add("L", "" if spanish else None)
    return 2


def _m(w: _Word, i: int) -> int:
    w.add("M")
    return 2 if w.at(i + 1, "M") or w.at(i - 1, "UMB") and (w.end(i + 1) or w.at(i + 2, "ER")) else 1


def _p(w: _Word, i: int) -> int:
    if w.at(i + 1, "H"):
        w.add("F")
        return 2
    w.add("P")
    return 2 if w.at(i + 1, "P", "B") else 1


def _r(w: _Word, i: int) -> int:
    french = w.end(i) and not w.slavic and w.at(i - 2, "IE") and not w.at(i - 4, "ME", "MA")
    w.add("" if french else "R", "R")
    return 2 if w.at(i + 1, "R") else 1


def _s(w: _Word, i: int) -> int:
    if w.at(i - 1, "ISL", "YSL"):
        return 1
    if i == 0 and w.at(0, "SUGAR"):
        w.add("X", "S")
        return 1
    if w.at(i, "SH"):
        w.add("S" if w.at(i + 1, "HEIM", "HOEK", "HOLM", "HOLZ") else "X")
        return 2
    if w.at(i, "SIO", "SIA"):
        w.add("S", None if w.slavic else "X")
        return 3
    if i == 0 and w.at(1, "M", "N", "L", "W") or w.at(i + 1, "Z"):
        w.add("S", "X")
        return 2 if w.at(i + 1, "Z") else 1
    if w.at(i, "SCH"):
        if w.at(i + 3, "ER", "EN"):
            w.add("X", "SK")
        elif w.at(i + 3, "OO", "UY", "ED", "EM"):
            w.add("SK")
        else:
            w.add("X", "S" if i == 0 and not w.vowel(3) and not w.at(3, "W") else None)
        return 3
    if w.at(i, "SC"):
        w.add("S" if w.at(i + 2, "I", "E", "Y") else "SK")
        return 3
    french = w.end(i) and w.at(i - 2, "AI", "OI")
    w.add("" if french else "S", "S")
    return 2 if w.at(i + 1, "S", "Z") else 1


def _t(w: _Word, i: int) -> int:
    if w.at(i, "TION", "TIA", "TCH"):
        w.add("X")
        return 3
    if w.at(i, "TH", "TTH"):
        if w.at(i + 2, "OM", "AM") or w.germanic:
            w.add("T")
        else:
            w.add("0", "T")
        return 2
    w.add("T")
    return 2 if w.at(i + 1, "T", "D") else 1


def _w(w: _Word, i: int) -> int:
    if w.at(i, "WR"):
        w.add("R")
        return 2
    if i == 0 and (w.vowel(1) or w.at(0, "WH")):
        w.add("A", "F" if w.vowel(1) else None)
    elif w.end(i) and w.vowel(i - 1) or w.at(i - 1, "EWSKI", "EWSKY", "OWSKI", "OWSKY") or w.s.startswith("SCH"):
        w.add("", "F")
    elif w.at(i, "WICZ", "WITZ"):
        w.add("TS", "FX")
        return 4
    return 1


def _x(w: _Word, i: int) -> int:
    if i == 0:
        w.add("S")
        return 1
    if not (w.end(i) and (w.at(i - 3, "IAU", "EAU") or w.at(i - 2, "AU", "OU"))):
        w.add("KS")
    return 2 if w.at(i + 1, "C", "X") else 1


def _z(w: _Word, i: int) -> int:
    if w.at(i + 1, "H"):
        w.add("J")
        return 2
    w.add("S", "TS" if w.at(i + 1, "ZO", "ZI", "ZA") or w.slavic and i > 0 and not w.at(i - 1, "T") else None)
    return 2 if w.at(i + 1, "Z") else 1


RULES = {
    **dict.fromkeys(VOWELS, _vowel),
    "B": _plain("P", "B"), "Ç": _plain("S"), "F": _plain("F", "F"), "K": _plain("K", "K"), "N": _plain("N", "N"), "Ñ": _plain("N"), "Q": _plain("K", "Q"), "V": _plain("F", "V"),
    "C": _c, "D": _d, "G": _g, "H": _h, "J": _j, "L": _l, "M": _m, "P": _p, "R": _r, "S": _s, "T": _t, "W": _w, "X": _x, "Z": _z,
}


def double_metaphone(word: str) -> tuple[str, str]:
    """(primary key, secondary key); letters without a rule are silent."""
    w = _Word(word.strip().upper())
    i = 1 if w.at(0, "GN", "KN", "PN", "WR", "PS") else 0
    while i < w.n:
        rule = RULES.get(w.s[i])
        i += rule(w, i) if rule else 1
    return "".join(w.first), "".join(w.second)


@lru_cache(maxsize=200_000)
def word_key(word: str) -> str:
    """The primary key, else the secondary, else the word itself (numbers, say)."""
    first, second = double_metaphone(word)
    return first or second or word


@F.pandas_udf(ST.StringType())
def key_udf(words: pd.Series) -> pd.Series:
    return words.map(lambda x: None if x is None else word_key(x))


@F.pandas_udf(ST.ArrayType(ST.StringType()))
def keys_udf(tokens: pd.Series) -> pd.Series:
    return tokens.map(lambda x: None if x is None else [word_key(t) for t in x])


def phonetic_tokens(tokens: Column, suits: Column) -> Column:
    """Keys of an array of words where ``suits``, else the words. A worker keeps keys of
    the words that it met; the result needs no shuffle."""
    return F.when(suits, keys_udf(tokens)).otherwise(tokens)


def encode_vocabulary(words: DataFrame) -> DataFrame:
    """word, code for the distinct values of ``word``."""
    return words.select("word").distinct().withColumn("code", key_udf("word"))
