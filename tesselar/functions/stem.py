"""Porter's stemmer (1980), run once per distinct word.

The algorithm is Porter's published one: words of one or two letters stay, steps 2 and 3 take the first suffix that
fits and stop there, step 4 takes the longest.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

_STEP2 = [x.split(">") for x in "ational>ate tional>tion enci>ence anci>ance izer>ize abli>able alli>al entli>ent eli>e ousli>ous ization>ize ation>ate ator>ate alism>al iveness>ive fulness>ful ousness>ous aliti>al iviti>ive biliti>ble".split()]
_STEP3 = [x.split(">") for x in "icate>ic ative> alize>al iciti>ic ical>ic ful> ness>".split()]
_STEP4 = sorted("al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split(), key=lambda s: (-len(s), s))


def _shape(stem: str) -> str:
    """c for each consonant and v for each vowel; a y is a vowel after a consonant."""
    out = ""
    for ch in stem:
        out += "v" if ch in "aeiou" or (ch == "y" and out.endswith("c")) else "c"
    return out


def measure(stem: str) -> int:
    """How many times a vowel run is followed by a consonant run."""
    return len(re.findall("v+c+", _shape(stem)))


def _short_end(stem: str) -> bool:
    return _shape(stem).endswith("cvc") and stem[-1] not in "wxy"


def _double(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and _shape(word)[-1] == "c"


def stem(word: str) -> str:
    """The stem of a word in lower case."""
    if len(word) < 3:
        return word
    if word.endswith(("sses", "ies")):
        word = word[:-2]
    elif word[-1] == "s" and word[-2] != "s":
        word = word[:-1]

    if word.endswith("eed"):
        word = word[:-1] if measure(word[:-3]) else word
    else:
        cut = next((word[: -len(s)] for s in ("ed", "ing") if word.endswith(s)), None)
        if cut is not None and "v" in _shape(cut):
            bare = _double(cut) and cut[-1] not in "lsz"
            silent = cut[-2:] in ("at", "bl", "iz") or (not bare and measure(cut) == 1 and _short_end(cut))
            word = cut + "e" if silent else cut[:-1] if bare else cut

    head = word[:-1]
    if word.endswith("y") and "v" in _shape(head):
        word = head + "i"

    for table in (_STEP2, _STEP3):
        for suffix, to in table:
            if word.endswith(suffix):
                rest = word.removesuffix(suffix)
                word = rest + to if measure(rest) else word
                break

    for suffix in _STEP4:
        if word.endswith(suffix):
            rest = word[: -len(suffix)]
            if measure(rest) > 1 and (suffix != "ion" or rest.endswith(("s", "t"))):
                word = rest
            break

    if word.endswith("e"):
        m = measure(word[:-1])
        if m > 1 or (m == 1 and not _short_end(word[:-1])):
            word = word[:-1]
    return word[:-1] if word.endswith("ll") and measure(word) > 1 else word


@F.pandas_udf(StringType())
def stem_column(words: pd.Series) -> pd.Series:
    codes, distinct = pd.factorize(words)
    stems = pd.Series([stem(w) for w in distinct], dtype=object)
    return stems.reindex(codes).reset_index(drop=True).where(codes >= 0, None)


def stemmed(rows: DataFrame, term: str = "term") -> DataFrame:
    """rows with the column of terms stemmed; every distinct term is stemmed once and joined back."""
    stems = rows.select(term).distinct().withColumn("__stem", stem_column(F.col(term)))
    return rows.join(stems, term).withColumn(term, F.col("__stem")).drop("__stem")


def stem_each(words: Column) -> Column:
    """Stems of an array of words, for short texts such as queries."""

    @F.pandas_udf("array<string>")
    def run(lists: pd.Series) -> pd.Series:
        return lists.map(lambda ws: None if ws is None else [stem(w) for w in ws])

    return run(words)
