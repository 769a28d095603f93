"""Suffix stripping for English words, after the published rules of Porter (1980).

A word is [C](VC)^m[V]; m, counted on the stem before a suffix, decides whether
the suffix may go.  The steps' suffixes are tables; of each step the longest
suffix that a word has is tried, and no other.
"""

from __future__ import annotations

import re
from functools import lru_cache

#: Suffixes and what they become, by step (fixed values).
PLURALS = {"sses": "ss", "ies": "i", "ss": "ss", "s": ""}
DOUBLE = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous",
    "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble",
}
SIMPLE = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
LAST = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split()

_VC = re.compile("v+c+")


def shape(stem: str) -> str:
    """c and v for each letter: a, e, i, o, u are vowels, and y behind a consonant."""
    out = []
    for i, x in enumerate(stem):
        out.append("v" if x in "aeiou" or (x == "y" and i and out[-1] == "c") else "c")
    return "".join(out)


def measure(stem: str) -> int:
    return len(_VC.findall(shape(stem)))


def _short_end(stem: str) -> bool:
    """Consonant, vowel, consonant other than w, x and y."""
    return shape(stem)[-3:] == "cvc" and stem[-1] not in "wxy"


def _longest(word: str, suffixes) -> str | None:
    return max((s for s in suffixes if word.endswith(s)), key=len, default=None)


def _replace(word: str, table: dict[str, str], least: int) -> str:
    s = _longest(word, table)
    if s is not None and measure(word[: -len(s)]) > least:
        return word[: -len(s)] + table[s]
    return word


def _past(word: str) -> str:
    """-eed, -ed and -ing; what they leave is mended."""
    if word.endswith("eed"):
        return word[:-1] if measure(word[:-3]) > 0 else word
    s = _longest(word, ("ed", "ing"))
    if s is None or "v" not in shape(word[: -len(s)]):
        return word
    stem = word[: -len(s)]
    if stem.endswith(("at", "bl", "iz")):
        return stem + "e"
    if len(stem) > 1 and stem[-1] == stem[-2] and shape(stem)[-1] == "c" and stem[-1] not in "lsz":
        return stem[:-1]
    return stem + "e" if measure(stem) == 1 and _short_end(stem) else stem


@lru_cache(1 << 16)
def stem(word: str) -> str:
    """The stem of a lower-case word; words of one or two letters stay."""
    if len(word) <= 2:
        return word
    s = _longest(word, PLURALS)
    if s is not None:
        word = word[: -len(s)] + PLURALS[s]
    word = _past(word)
    if word.endswith("y") and "v" in shape(word[:-1]):
        word = word[:-1] + "i"
    word = _replace(_replace(word, DOUBLE, 0), SIMPLE, 0)
    s = _longest(word, LAST)
    if s is not None and measure(word[: -len(s)]) > 1 and (s != "ion" or word[: -len(s)].endswith(("s", "t"))):
        word = word[: -len(s)]
    if word.endswith("e") and (measure(word[:-1]) > 1 or (measure(word[:-1]) == 1 and not _short_end(word[:-1]))):
        word = word[:-1]
    return word[:-1] if word.endswith("ll") and measure(word) > 1 else word
