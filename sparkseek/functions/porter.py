"""Porter's stemmer (the published algorithm of 1980), and folding of accents."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

_LETTERS = {c: "v" if chr(c) in "aeiou" else "y" if chr(c) == "y" else "c" for c in range(128)}
_STEP2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "bli": "ble", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous",
    "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble", "logi": "log",
}
_STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
_STEP4 = {"al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ou", "ism", "ate", "iti", "ous", "ive", "ize", "ion"}


def _form(word: str) -> str:
    """c and v of each letter."""
    out = word.translate(_LETTERS)
    if "y" in out:  # a vowel after a consonant
        letters = list(out)
        for i, ch in enumerate(letters):
            if ch == "y":
                letters[i] = "v" if i and letters[i - 1] == "c" else "c"
        out = "".join(letters)
    return out


def _m(stem: str) -> int:
    return _form(stem).count("vc")


def _ending(word: str, rules) -> str:
    """The longest of the rules' endings that the word has."""
    return next((word[-n:] for n in range(min(7, len(word)), 1, -1) if word[-n:] in rules), "")


def _has_vowel(stem: str) -> bool:
    return "v" in _form(stem)


def _double(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and _form(word)[-1] == "c"


def _cvc(word: str) -> bool:
    return _form(word)[-3:] == "cvc" and word[-1] not in "wxy"


@lru_cache(maxsize=200_000)
def stem(word: str) -> str:
    if len(word) < 3 or not (word.isascii() and word.isalpha()):
        return word
    w = word
    if w.endswith(("sses", "ies")):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        if _m(w[:-3]) > 0:
            w = w[:-1]
    else:
        for end in ("ed", "ing"):
            if w.endswith(end) and _has_vowel(w[: -len(end)]):
                w = w[: -len(end)]
                if w.endswith(("at", "bl", "iz")):
                    w += "e"
                elif _double(w) and w[-1] not in "lsz":
                    w = w[:-1]
                elif _m(w) == 1 and _cvc(w):
                    w += "e"
                break
    if w.endswith("y") and _has_vowel(w[:-1]):
        w = w[:-1] + "i"
    for rules in (_STEP2, _STEP3):
        end = _ending(w, rules)
        if end and _m(w[: -len(end)]) > 0:
            w = w[: -len(end)] + rules[end]
    end = _ending(w, _STEP4)
    if end:
        rest = w[: -len(end)]
        if _m(rest) > 1 and (end != "ion" or rest.endswith(("s", "t"))):
            w = rest
    if w.endswith("e"):
        m = _m(w[:-1])
        if m > 1 or m == 1 and not _cvc(w[:-1]):
            w = w[:-1]
    if w.endswith("ll") and _m(w) > 1:
        w = w[:-1]
    return w


@lru_cache(maxsize=200_000)
def fold(word: str) -> str:
    """Lower case without accents."""
    if word.isascii():
        return word.lower()
    bare = unicodedata.normalize("NFD", word.lower())
    return "".join(c for c in bare if not unicodedata.combining(c))


def tokens(text: str | None) -> list[str]:
    """Stemmed terms: runs of letters and digits, folded."""
    out, run = [], []
    for ch in text or "":
        if ch.isalnum() or unicodedata.category(ch) in ("Co", "Mn", "Mc"):
            run.append(ch)
        elif run:
            out.append("".join(run))
            run = []
    if run:
        out.append("".join(run))
    return [stem(fold(t)) for t in out]
