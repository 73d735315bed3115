"""The suffix-stripping algorithm of Porter (1980) for English words."""

from __future__ import annotations

import re
from functools import lru_cache

_STEP2 = (("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"))
_STEP3 = (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))
_STEP4 = ("ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion", "al", "er", "ic", "ou")


def _kinds(w: str) -> str:
    """c for each consonant and v for each vowel; y is a vowel after a consonant."""
    out = ""
    for i, c in enumerate(w):
        out += "v" if c in "aeiou" or c == "y" and i > 0 and out[-1] == "c" else "c"
    return out


def _m(w: str) -> int:
    return len(re.findall("v+c+", _kinds(w)))


def _cvc(w: str) -> bool:
    return _kinds(w)[-3:] == "cvc" and w[-1] not in "wxy"


@lru_cache(maxsize=200_000)
def stem(w: str) -> str:
    if len(w) <= 2 or not w.isalpha() or not w.isascii():
        return w
    if w.endswith(("sses", "ies")):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        w = w[:-1] if _m(w[:-3]) > 0 else w
    else:
        for end in ("ed", "ing"):
            if w.endswith(end) and "v" in _kinds(w[: -len(end)]):
                w = w[: -len(end)]
                if w.endswith(("at", "bl", "iz")):
                    w += "e"
                elif len(w) > 1 and w[-1] == w[-2] and _kinds(w)[-1] == "c" and w[-1] not in "lsz":
                    w = w[:-1]
                elif _m(w) == 1 and _cvc(w):
                    w += "e"
                break
    if w.endswith("y") and "v" in _kinds(w[:-1]):
        w = w[:-1] + "i"
    for table in (_STEP2, _STEP3):
        for end, new in sorted(table, key=lambda x: -len(x[0])):
            if w.endswith(end):
                if _m(w[: -len(end)]) > 0:
                    w = w[: -len(end)] + new
                break
    for end in sorted(_STEP4, key=len, reverse=True):
        if w.endswith(end):
            base = w[: -len(end)]
            if _m(base) > 1 and (end != "ion" or base[-1:] in ("s", "t")):
                w = base
            break
    if w.endswith("e") and (_m(w[:-1]) > 1 or _m(w[:-1]) == 1 and not _cvc(w[:-1])):
        w = w[:-1]
    if w.endswith("ll") and _m(w) > 1:
        w = w[:-1]
    return w
