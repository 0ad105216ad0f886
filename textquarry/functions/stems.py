"""English stems by the published Porter2 (Snowball English) algorithm."""

from __future__ import annotations

import functools
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the algorithm: words with stems of their own, words that stay after the first step, suffixes and what replaces them.
_OWN = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"}
_STAY = {"sky", "news", "howe", "atlas", "cosmos", "bias", "andes"}
_STAY_LATER = {"inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"}
_PREFIXES = ("gener", "commun", "arsen")
_SECOND = {
    "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al",
    "alli": "al", "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "ogi": "og", "fulli": "ful", "lessli": "less", "li": "",
}
_THIRD = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": "", "ative": ""}
_FOURTH = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion"]
_DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")

_REGION = re.compile(r".*?[aeiouy][^aeiouy]", re.S)
_SHORT = re.compile(r"(?:[^aeiouy][aeiouy][^aeiouywxY]|^[aeiouy][^aeiouy])\Z")
_VOWEL = re.compile(r"[aeiouy]")


def _by_last(*endings: str) -> dict[str, tuple[str, ...]]:
    """Endings by their last letter, the longest first."""
    return {c: tuple(sorted((e for e in endings if e[-1] == c), key=len, reverse=True)) for c in {e[-1] for e in endings}}


_OWNED, _PLURAL, _PAST = _by_last("'", "'s", "'s'"), _by_last("sses", "ied", "ies", "s", "us", "ss"), _by_last("eed", "eedly", "ed", "edly", "ing", "ingly")
_SECOND_ENDS, _THIRD_ENDS, _FOURTH_ENDS = _by_last(*_SECOND), _by_last(*_THIRD), _by_last(*_FOURTH)


def _ending(w: str, endings: dict[str, tuple[str, ...]]) -> str | None:
    """The longest of the endings that w has."""
    for e in endings.get(w[-1:], ()):
        if w.endswith(e):
            return e
    return None


def _short_word(w: str, first: int) -> bool:
    return first >= len(w) and bool(_SHORT.search(w))


def stem(word: str) -> str:
    """The stem of a word in lower case. Letters beyond a to z count as consonants."""
    if len(word) <= 2:
        return word
    w = word.removeprefix("'")
    if w in _OWN or w in _STAY:
        return _OWN.get(w, w)
    if "y" in w:
        w = re.sub(r"([aeiouy])y", r"\1Y", re.sub(r"^y", "Y", w))
    prefix = next(p for p in _PREFIXES if w.startswith(p)) if w.startswith(_PREFIXES) else None
    match = _REGION.match(w)
    first = len(prefix) if prefix else match.end() if match else len(w)
    match = _REGION.match(w, first)
    second = match.end() if match else len(w)

    if end := _ending(w, _OWNED):
        w = w[: -len(end)]
    end = _ending(w, _PLURAL)
    if end == "sses":
        w = w[:-2]
    elif end in ("ied", "ies"):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif end == "s" and _VOWEL.search(w[:-2]):
        w = w[:-1]
    if w in _STAY_LATER:
        return w

    end = _ending(w, _PAST)
    if end in ("eed", "eedly"):
        w = w[: len(w) - len(end)] + "ee" if len(w) - len(end) >= first else w
    elif end and _VOWEL.search(w[: -len(end)]):
        w = w[: -len(end)]
        if w.endswith(("at", "bl", "iz")) or _short_word(w, first):
            w += "e"
        elif w.endswith(_DOUBLES):
            w = w[:-1]
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in "aeiouy":
        w = w[:-1] + "i"

    if (end := _ending(w, _SECOND_ENDS)) and len(w) - len(end) >= first:
        before = w[: -len(end)]
        if not (end == "ogi" and not before.endswith("l") or end == "li" and not before.endswith(tuple("cdeghkmnrt"))):
            w = before + _SECOND[end]
    if (end := _ending(w, _THIRD_ENDS)) and len(w) - len(end) >= (second if end == "ative" else first):
        w = w[: -len(end)] + _THIRD[end]
    if (end := _ending(w, _FOURTH_ENDS)) and len(w) - len(end) >= second and not (end == "ion" and not w[:-3].endswith(("s", "t"))):
        w = w[: -len(end)]
    if w.endswith("e") and (len(w) - 1 >= second or len(w) - 1 >= first and not _SHORT.search(w[:-1])) or w.endswith("ll") and len(w) - 1 >= second:
        w = w[:-1]
    return w.replace("Y", "y")


@functools.lru_cache(1 << 20)
def _known(word: str) -> str:
    """The stem, remembered by a worker for all its batches."""
    return stem(word)


def stemmed(word: Column | str) -> Column:
    """The stem of each row's word: each different one is made once by a worker, and nothing is joined or shuffled."""

    @F.pandas_udf("string")
    def run(words: pd.Series) -> pd.Series:
        return words.map(_known, na_action="ignore")

    return run(word)


def dictionary(lexemes: DataFrame) -> DataFrame:
    """(lexeme, stem) of the distinct lexemes of lexemes(lexeme): each different word is stemmed once."""

    @F.pandas_udf("string")
    def run(words: pd.Series) -> pd.Series:
        return words.map(stem)

    return lexemes.select("lexeme").where("lexeme is not null").distinct().withColumn("stem", run("lexeme"))
