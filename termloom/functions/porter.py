"""The suffix-stripping algorithm of M. F. Porter (Program 14, 1980)."""

from __future__ import annotations

import functools


def _form(w: str) -> str:
    """'c' and 'v' for each letter; y is a vowel after a consonant."""
    out = ""
    for i, ch in enumerate(w):
        out += "v" if ch in "aeiou" or (ch == "y" and i and out[-1] == "c") else "c"
    return out


def _measure(w: str) -> int:
    return _form(w).count("vc")


def _doubled(w: str) -> bool:
    return len(w) > 1 and w[-1] == w[-2] and _form(w)[-1] == "c"


def _cvc(w: str) -> bool:
    return _form(w)[-3:] == "cvc" and w[-1] not in "wxy"


_STEP2 = [("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble")]
_STEP3 = [("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", "")]
_STEP4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize"]


def _longest(w: str, rules: list[tuple[str, str]]) -> str:
    for suffix, new in sorted(rules, key=lambda r: -len(r[0])):
        if w.endswith(suffix):
            root = w[: len(w) - len(suffix)]
            return root + new if _measure(root) > 0 else w
    return w


@functools.lru_cache(100_000)
def stem(w: str) -> str:
    if len(w) < 3 or not (w.isascii() and w.isalpha()):
        return w
    if w.endswith("sses") or w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        if _measure(w[:-3]) > 0:
            w = w[:-1]
    else:
        for suffix in ("ed", "ing"):
            root = w[: -len(suffix)]
            if w.endswith(suffix) and "v" in _form(root):
                w = root
                if w.endswith(("at", "bl", "iz")):
                    w += "e"
                elif _doubled(w) and w[-1] not in "lsz":
                    w = w[:-1]
                elif _measure(w) == 1 and _cvc(w):
                    w += "e"
                break
    if w.endswith("y") and "v" in _form(w[:-1]):
        w = w[:-1] + "i"
    w = _longest(_longest(w, _STEP2), _STEP3)
    for suffix in sorted(_STEP4, key=len, reverse=True):
        if w.endswith(suffix):
            root = w[: len(w) - len(suffix)]
            if _measure(root) > 1 and (suffix != "ion" or root.endswith(("s", "t"))):
                w = root
            break
    if w.endswith("e"):
        root = w[:-1]
        m = _measure(root)
        if m > 1 or (m == 1 and not _cvc(root)):
            w = root
    if w.endswith("ll") and _measure(w) > 1:
        w = w[:-1]
    return w
