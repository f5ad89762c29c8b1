"""English stems by the algorithm of M. F. Porter (1980), and by the extended form that summary scorers use."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# Suffixes of the algorithm's steps and what takes their place.
STEP_2 = {"ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble"}
STEP_3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP_4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize"]


# Fixed values of the extended form: whole words with stems of their own, and two more suffixes; -bli stands for -abli.
WHOLE = {"sky": "sky", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "news": "news", "innings": "inning", "inning": "inning", "outings": "outing", "outing": "outing", "cannings": "canning", "canning": "canning", "howe": "howe", "proceed": "proceed", "exceed": "exceed", "succeed": "succeed"}
STEP_2_EXTENDED = {**{k: v for k, v in STEP_2.items() if k != "abli"}, "bli": "ble", "fulli": "ful", "logi": "log"}


def _shape(word: str) -> str:
    """The word with v for vowels and c for consonants; y is a vowel behind a consonant."""
    out = ""
    for k, x in enumerate(word):
        out += "v" if x in "aeiou" or (x == "y" and k > 0 and out[-1] == "c") else "c"
    return out


def _measure(stem: str) -> int:
    """Number of vowel runs that a consonant run follows."""
    return len(re.findall("v+c+", _shape(stem)))


def _double(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and _shape(word)[-1] == "c"


def _short(word: str, extended: bool = False) -> bool:
    return (_shape(word).endswith("cvc") and word[-1] not in "wxy") or (extended and _shape(word) == "vc")


def _longest(word: str, suffixes) -> str:
    return max((x for x in suffixes if word.endswith(x)), key=len, default="")


def stem(word: str, extended: bool = False) -> str:
    if len(word) < 3:
        return word
    if extended and word in WHOLE:
        return WHOLE[word]
    # Plurals, then -ed and -ing.
    if word.endswith("ies") and extended and len(word) == 4:
        word = word[:-1]
    elif word.endswith(("sses", "ies")):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    if word.endswith("ied") and extended:
        word = word[: -1 if len(word) == 4 else -2]
    elif word.endswith("eed"):
        word = word[:-1] if _measure(word[:-3]) > 0 else word
    elif (end := _longest(word, ("ed", "ing"))) and "v" in _shape(word[: -len(end)]):
        word = word[: -len(end)]
        if word.endswith(("at", "bl", "iz")):
            word += "e"
        elif _double(word) and word[-1] not in "lsz":
            word = word[:-1]
        elif _measure(word) == 1 and _short(word, extended):
            word += "e"
    if word.endswith("y") and (len(word) > 2 and _shape(word[:-1])[-1] == "c" if extended else "v" in _shape(word[:-1])):
        word = word[:-1] + "i"
    if extended and word.endswith("alli") and _measure(word[:-4]) > 0:
        word = word[:-2]  # what is left may have another suffix of this step
    for table in (STEP_2_EXTENDED if extended else STEP_2, STEP_3):
        end = _longest(word, table)
        if end and _measure(word[: -len(end) + (1 if end == "logi" else 0)]) > 0:
            word = word[: -len(end)] + table[end]
    end = _longest(word, STEP_4)
    if end and _measure(word[: -len(end)]) > 1 and (end != "ion" or word[: -len(end)].endswith(("s", "t"))):
        word = word[: -len(end)]
    if word.endswith("e") and ((m := _measure(word[:-1])) > 1 or (m == 1 and not _short(word[:-1], extended))):
        word = word[:-1]
    return word[:-1] if word.endswith("ll") and _measure(word) > 1 else word


def _stems(words: pa.Array) -> pa.Array:
    coded = words.flatten().dictionary_encode()
    stems = pa.array([w if w is None or len(w) < 4 else stem(w, True) for w in coded.dictionary.to_pylist()], pa.string())
    ends = words.offsets.to_numpy() - words.offsets[0].as_py()
    return pa.ListArray.from_arrays(pa.array(ends), stems.take(coded.indices), mask=words.is_null())


def stems(words: Column) -> Column:
    """Extended stems of an array of lower-case words in Arrow batches, each distinct word of a batch once; words of up to three letters stay."""
    return F.arrow_udf(_stems, "array<string>")(words)
