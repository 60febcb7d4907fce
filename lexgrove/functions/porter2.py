"""English stemming by the published Porter2 rules."""

from __future__ import annotations

import re
from functools import lru_cache

_V = "aeiouy"
_DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
_SPECIAL = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl",
    "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl", "sky": "sky", "news": "news", "howe": "howe",
    "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
_FINAL = frozenset(("inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"))
_STEP2 = (
    ("ational", "ate"), ("fulness", "ful"), ("iveness", "ive"), ("ization", "ize"), ("ousness", "ous"), ("biliti", "ble"),
    ("lessli", "less"), ("tional", "tion"), ("alism", "al"), ("aliti", "al"), ("ation", "ate"), ("entli", "ent"),
    ("fulli", "ful"), ("iviti", "ive"), ("ousli", "ous"), ("abli", "able"), ("alli", "al"), ("anci", "ance"),
    ("ator", "ate"), ("enci", "ence"), ("izer", "ize"), ("bli", "ble"), ("ogi", "og"), ("li", ""),
)
_STEP3 = (
    ("ational", "ate"), ("tional", "tion"), ("alize", "al"), ("icate", "ic"), ("iciti", "ic"), ("ative", ""),
    ("ical", "ic"), ("ness", ""), ("ful", ""),
)
_STEP4 = ("ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion", "al", "er", "ic")


def _regions(w: str) -> tuple[int, int]:
    r1 = next((len(p) for p in ("gener", "commun", "arsen") if w.startswith(p)), None)
    if r1 is None:
        m = re.search(rf"[{_V}][^{_V}]", w)
        r1 = m.end() if m else len(w)
    m = re.compile(rf"[{_V}][^{_V}]").search(w, r1)
    return r1, m.end() if m else len(w)


def _short_end(w: str) -> bool:
    n = len(w)
    if n == 2:
        return w[0] in _V and w[1] not in _V
    return n > 2 and w[-1] not in _V + "wxY" and w[-2] in _V and w[-3] not in _V


@lru_cache(1 << 16)
def stem(word: str) -> str:
    """The stem of a lower-case word."""
    w = word.replace("’", "'").replace("‘", "'")
    if len(w) < 3:
        return w
    w = w.removeprefix("'")
    if w in _SPECIAL:
        return _SPECIAL[w]
    w = re.sub(rf"(^|(?<=[{_V}]))y", "Y", w)
    r1, r2 = _regions(w)
    for s in ("'s'", "'s", "'"):
        if w.endswith(s):
            w = w[: -len(s)]
            break
    # 1a
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and any(c in _V for c in w[:-2]):
        w = w[:-1]
    if w in _FINAL:
        return w
    # 1b
    for s in ("eedly", "eed"):
        if w.endswith(s):
            if len(w) - len(s) >= r1:
                w = w[: -len(s)] + "ee"
            break
    else:
        for s in ("ingly", "edly", "ing", "ed"):
            if w.endswith(s):
                head = w[: -len(s)]
                if any(c in _V for c in head):
                    w = head
                    if w.endswith(("at", "bl", "iz")):
                        w += "e"
                    elif w.endswith(_DOUBLES):
                        w = w[:-1]
                    elif r1 >= len(w) and _short_end(w):
                        w += "e"
                break
    # 1c
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in _V:
        w = w[:-1] + "i"
    for s, to in _STEP2:
        if w.endswith(s):
            at = len(w) - len(s)
            if at >= r1 and (s != "ogi" or w[at - 1 : at] == "l") and (s != "li" or w[at - 1 : at] in tuple("cdeghkmnrt")):
                w = w[:at] + to
            break
    for s, to in _STEP3:
        if w.endswith(s):
            at = len(w) - len(s)
            if at >= r1 and (s != "ative" or at >= r2):
                w = w[:at] + to
            break
    for s in _STEP4:
        if w.endswith(s):
            at = len(w) - len(s)
            if at >= r2 and (s != "ion" or w[at - 1 : at] in ("s", "t")):
                w = w[:at]
            break
    # 5
    if w.endswith("e"):
        at = len(w) - 1
        if at >= r2 or (at >= r1 and not _short_end(w[:-1])):
            w = w[:-1]
    elif w.endswith("l") and len(w) - 1 >= r2 and w[-2:-1] == "l":
        w = w[:-1]
    return w.replace("Y", "y")
