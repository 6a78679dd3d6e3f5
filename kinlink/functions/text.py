"""Scalar text functions on Columns; JVM-side but for `romanise`."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinlink.functions import constants as K

_ACCENTED = [c for c in map(chr, range(0xC0, 0x180)) if len(d := unicodedata.normalize("NFKD", c.lower())) > 1 and d[0].isascii() and all(unicodedata.combining(x) for x in d[1:])]
_FROM = "".join(_ACCENTED)
_TO = "".join(unicodedata.normalize("NFKD", c.lower())[0] for c in _ACCENTED)
_SPELT = {"ß": "ss", "æ": "ae", "œ": "oe", "ø": "o", "đ": "d", "ł": "l", "ı": "i"}


def mapping(values: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for pair in values.items() for x in pair))


def lookup(values: dict[str, str], key: Column) -> Column:
    """The value, or null."""
    return F.try_element_at(mapping(values), key)


def fold_latin(s: Column) -> Column:
    """Lower case without accents, for Latin scripts."""
    s = F.translate(F.lower(s), _FROM + _FROM.lower(), _TO + _TO)
    for a, b in _SPELT.items():
        s = F.replace(s, F.lit(a), F.lit(b))
    return s


def is_native(s: Column) -> Column:
    """Any letter of an Indic block (U+0900 to U+0DFF)."""
    return s.rlike("[\\u0900-\\u0DFF]")


_CONSONANTS = "k kh g gh ng c ch j jh ny t th d dh n t th d dh n n p ph b bh m y r r l l l v sh s s h".split()
_VOWELS = "a aa i ii u uu r l e e e ai o o o au".split()
_SIGNS = "aa i ii u uu r r e e e ai o o o au".split()


def romanised(s: str) -> str:
    """Latin letters for a text of any script: Indic blocks share one layout, 0x80 apart; other letters lose accents."""
    out, open_ = [], False
    for ch in unicodedata.normalize("NFKC", s):
        at = ord(ch)
        if 0x900 <= at <= 0xDFF:
            k = at & 0x7F
            if 0x15 <= k <= 0x39:
                if open_:
                    out.append("a")
                out.append(_CONSONANTS[min(k - 0x15, len(_CONSONANTS) - 1)])
                open_ = True
                continue
            if 0x3E <= k <= 0x4C:
                out.append(_SIGNS[k - 0x3E])
            elif 0x05 <= k <= 0x14:
                out.append(("a" if open_ else "") + _VOWELS[k - 0x05])
            elif k == 0x4D:
                pass
            elif 0x66 <= k <= 0x6F:
                out.append(("a" if open_ else "") + str(k - 0x66))
            elif k in (0x01, 0x02):
                out.append(("a" if open_ else "") + "n")
            open_ = False
            continue
        if open_ and ch.isalpha():
            out.append("a")
        open_ = False
        plain = unicodedata.normalize("NFKD", _SPELT.get(ch.lower(), ch))
        out.append("".join(c for c in plain if c.isascii()))
    return "".join(out).lower()


@F.pandas_udf(T.StringType())
def fold(s: pd.Series) -> pd.Series:
    """Compatibility form, Latin letters, lower case, for any script; distinct values of a batch are folded once."""
    known = {x: romanised(x) for x in s.dropna().unique()}
    return s.map(known)


def zero_strip(t: Column) -> Column:
    """Digits without leading zeros; '0' if all are zeros; '' stays."""
    return F.when(t == "", "").otherwise(F.coalesce(F.nullif(F.ltrim(t, F.lit("0")), F.lit("")), F.lit("0")))


def any_of(t: Column, words: list[str]) -> Column:
    return t.isin(words)


def related(a: Column, b: Column) -> Column:
    """Equal, or one the other's start or end."""
    return (a == b) | a.startswith(b) | b.startswith(a) | a.endswith(b) | b.endswith(a)


def skeleton(s: Column) -> Column:
    """Consonants by sound."""
    s = F.lower(s)
    for a, b in K.SOUNDS:
        s = F.replace(s, F.lit(a), F.lit(b))
    s = F.replace(F.regexp_replace(s, "c(?=[eiy])", "s"), F.lit("c"), F.lit("k"))
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(s, "[^a-z]", ""), "[aeiouy]", ""), r"(.)\1+", "$1")


def ocr_fold(t: Column) -> Column:
    """Letter pairs that scanning confuses: rn to m, then ln to in."""
    return F.replace(F.replace(t, F.lit("rn"), F.lit("m")), F.lit("ln"), F.lit("in"))


def deleet(t: Column) -> Column:
    """Digits for letters, in tokens that mix both."""
    return F.when(t.rlike("[0-9]") & t.rlike("[^0-9]"), F.translate(t, *K.LEET)).otherwise(t)


def city_key(city: Column) -> Column:
    c = F.regexp_replace(F.regexp_replace(F.lower(city), r"\bste\.?\s", "sainte "), r"\bst\.?\s", "saint ")
    return F.trim(F.regexp_replace(F.regexp_replace(c, r"[^a-z0-9]+", " "), " +", " "))


def jaccard(a: Column, b: Column, empty: float = -1.0) -> Column:
    """Shared share of two arrays' sets; `empty` if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(empty)).otherwise(F.size(F.array_intersect(a, b)).cast("double") / union)
