"""English stems by suffix rules over regions of a word (the published Porter2 rules)."""

from __future__ import annotations

import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

# Suffixes and what replaces them, longest match first within a step; words with stems of their own.
DERIVED = {
    "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al", "alli": "al",
    "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "fulli": "ful", "lessli": "less", "ogi": "og", "li": "",
}
SECOND = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": "", "ative": ""}
ENDINGS = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion"]
SPECIAL = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"}
UNCHANGED = {"sky", "news", "howe", "atlas", "cosmos", "bias", "andes"}
UNCHANGED_LATER = {"inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"}
LONG_PREFIX = re.compile("gener|commun|arsen")

VOWEL = "[aeiouy]"
REGION = re.compile(f"{VOWEL}[^aeiouy]")
SHORT = re.compile(f"(?:^{VOWEL}[^aeiouy]|[^aeiouy]{VOWEL}[^aeiouywxY])$")
DOUBLE = re.compile("(?:bb|dd|ff|gg|mm|nn|pp|rr|tt)$")


def _longest(word: str, suffixes) -> str | None:
    return max((s for s in suffixes if word.endswith(s)), key=len, default=None)


def _regions(word: str) -> tuple[int, int]:
    """Where what follows the first vowel and its consonant begins, and the same again from there."""
    m = LONG_PREFIX.match(word) or REGION.search(word)
    first = m.end() if m else len(word)
    m = REGION.search(word, first)
    return first, m.end() if m else len(word)


def _plural(w: str) -> str:
    s = _longest(w, ("sses", "ied", "ies", "us", "ss", "s"))
    if s == "sses":
        return w[:-2]
    if s in ("ied", "ies"):
        return w[:-2] if len(w) > 4 else w[:-1]
    return w[:-1] if s == "s" and re.search(VOWEL, w[:-2]) else w


def _past(w: str, first: int) -> str:
    s = _longest(w, ("eed", "eedly", "ed", "edly", "ing", "ingly"))
    if s in ("eed", "eedly"):
        return w[: -len(s)] + "ee" if len(w) - len(s) >= first else w
    if not s or not re.search(VOWEL, w[: -len(s)]):
        return w
    w = w[: -len(s)]
    if w.endswith(("at", "bl", "iz")):
        return w + "e"
    if DOUBLE.search(w):
        return w[:-1]
    return w + "e" if len(w) <= first and SHORT.search(w) else w


def _replaced(w: str, first: int, second: int) -> str:
    s = _longest(w, DERIVED)
    if s and len(w) - len(s) >= first and not (s == "ogi" and w[-4:-3] != "l") and not (s == "li" and w[-3:-2] not in tuple("cdeghkmnrt")):
        w = w[: len(w) - len(s)] + DERIVED[s]
    s = _longest(w, SECOND)
    if s and len(w) - len(s) >= (second if s == "ative" else first):
        w = w[: len(w) - len(s)] + SECOND[s]
    s = _longest(w, ENDINGS)
    if s and len(w) - len(s) >= second and not (s == "ion" and w[-4:-3] not in ("s", "t")):
        w = w[: len(w) - len(s)]
    if w.endswith("e") and (len(w) - 1 >= second or (len(w) - 1 >= first and not SHORT.search(w[:-1]))):
        return w[:-1]
    return w[:-1] if w.endswith("ll") and len(w) - 1 >= second else w


@lru_cache(maxsize=1 << 16)
def stem(word: str) -> str:
    """The stem of a lower-case word; words of other alphabets stay."""
    if len(word) <= 2 or word in UNCHANGED:
        return word
    if word in SPECIAL:
        return SPECIAL[word]
    w = re.sub(f"^y|(?<={VOWEL})y", "Y", word.removeprefix("'"))
    first, second = _regions(w)
    w = _plural(re.sub("(?:'s'|'s|')$", "", w))
    if w in UNCHANGED_LATER:
        return w
    w = _past(w, first)
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in "aeiouy":
        w = w[:-1] + "i"
    return _replaced(w, first, second).replace("Y", "y")


@F.arrow_udf(ArrayType(StringType()))
def _stemmed(terms: pa.Array) -> pa.Array:
    """Each distinct word of a batch is stemmed once."""
    coded = terms.flatten().dictionary_encode()
    stems = pa.array([w if w is None else stem(w) for w in coded.dictionary.to_pylist()], pa.string())
    sizes = terms.value_lengths().fill_null(0).to_numpy()
    ends = pa.array([0, *sizes.cumsum().tolist()], pa.int32())
    return pa.ListArray.from_arrays(ends, stems.take(coded.indices))


def stemmed(terms: Column) -> Column:
    """Stems of an array of lower-case words; null gives an empty array."""
    return _stemmed(terms)
