"""Snowball stemmers written from their published descriptions: English (Porter 2), German, Swedish, Norwegian and Danish; and the table of all 17."""

from __future__ import annotations

import re
from collections.abc import Callable

from .stems_other import arabic, dutch, finnish, hungarian, russian, tamil, turkish
from .stems_romance import french, italian, portuguese, romanian, spanish

_V = "aeiouy"
_EXCEPTIONS = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl",
    **{w: w for w in ("sky", "news", "howe", "atlas", "cosmos", "bias", "andes")},
}
_STAY = {"inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"}
_STEP2 = (
    ("ization", "ize"), ("ational", "ate"), ("fulness", "ful"), ("ousness", "ous"), ("iveness", "ive"), ("tional", "tion"), ("biliti", "ble"), ("lessli", "less"),
    ("entli", "ent"), ("ation", "ate"), ("alism", "al"), ("aliti", "al"), ("ousli", "ous"), ("iviti", "ive"), ("fulli", "ful"),
    ("enci", "ence"), ("anci", "ance"), ("abli", "able"), ("izer", "ize"), ("ator", "ate"), ("alli", "al"), ("bli", "ble"),
)
_STEP3 = (("ational", "ate"), ("tional", "tion"), ("alize", "al"), ("icate", "ic"), ("iciti", "ic"), ("ical", "ic"), ("ness", ""), ("ful", ""))
_STEP4 = ("ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "al", "er", "ic")
_DOUBLES = {"bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt"}


def _region(w: str, start: int, vowels: str) -> int:
    """Where the part after the first non-vowel that follows a vowel begins, from ``start`` on."""
    for i in range(start + 1, len(w)):
        if w[i] not in vowels and w[i - 1] in vowels:
            return i + 1
    return len(w)


def _short_end(w: str) -> bool:
    """Ends in a short syllable."""
    if len(w) == 2:
        return w[0] in _V and w[1] not in _V
    return len(w) > 2 and w[-1] not in _V + "wxY" and w[-2] in _V and w[-3] not in _V


def english(word: str) -> str:
    if len(word) <= 2:
        return word
    if word in _EXCEPTIONS:
        return _EXCEPTIONS[word]
    w = word.replace("’", "'").lstrip("'") if word[0] == "'" else word.replace("’", "'")
    # y is a consonant at the start and after a vowel
    chars = list(w)
    for i, c in enumerate(chars):
        if c == "y" and (i == 0 or chars[i - 1] in _V):
            chars[i] = "Y"
    w = "".join(chars)
    for head in ("gener", "commun", "arsen"):
        if w.startswith(head):
            r1 = len(head)
            break
    else:
        r1 = _region(w, 0, _V)
    r2 = _region(w, r1, _V)

    for end in ("'s'", "'s", "'"):
        if w.endswith(end):
            w = w[: -len(end)]
            break
    # plurals
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and any(c in _V for c in w[:-2]):
        w = w[:-1]
    if w in _STAY:
        return w.lower()
    # past tenses
    for end in ("eedly", "eed"):
        if w.endswith(end):
            if len(w) - len(end) >= r1:
                w = w[: -len(end)] + "ee"
            break
    else:
        for end in ("ingly", "edly", "ing", "ed"):
            if w.endswith(end):
                base = w[: -len(end)]
                if any(c in _V for c in base):
                    w = base
                    if w.endswith(("at", "bl", "iz")):
                        w += "e"
                    elif w[-2:] in _DOUBLES:
                        w = w[:-1]
                    elif r1 >= len(w) and _short_end(w):
                        w += "e"
                break
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in _V:
        w = w[:-1] + "i"
    for end, to in _STEP2:
        if w.endswith(end):
            if len(w) - len(end) >= r1:
                w = w[: -len(end)] + to
            break
    else:
        if w.endswith("ogi"):
            if len(w) - 3 >= r1 and w[-4:-3] == "l":
                w = w[:-1]
        elif w.endswith("li") and len(w) - 2 >= r1 and w[-3:-2] in tuple("cdeghkmnrt"):
            w = w[:-2]
    for end, to in _STEP3:
        if w.endswith(end):
            if len(w) - len(end) >= r1:
                w = w[: -len(end)] + to
            break
    else:
        if w.endswith("ative") and len(w) - 5 >= r2:
            w = w[:-5]
    for end in _STEP4:
        if w.endswith(end):
            if len(w) - len(end) >= r2:
                w = w[: -len(end)]
            break
    else:
        if w.endswith("ion") and len(w) - 3 >= r2 and w[-4:-3] in ("s", "t"):
            w = w[:-3]
    if w.endswith("e"):
        if len(w) - 1 >= r2 or (len(w) - 1 >= r1 and not _short_end(w[:-1])):
            w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.lower()


_GV = "aeiouyäöü"


def german(word: str) -> str:
    w = word.replace("ß", "ss")
    w = re.sub(f"(?<=[{_GV}])u(?=[{_GV}])", "U", w)
    w = re.sub(f"(?<=[{_GV}])y(?=[{_GV}])", "Y", w)
    first = _region(w, 0, _GV)
    r2 = _region(w, first, _GV)
    r1 = max(first, 3)
    m = re.search(r"(ern|em|er|en|es|e|s)$", w)
    if m and m.start() >= r1:
        end = m.group()
        if end == "s":
            if w[m.start() - 1] in "bdfghklmnrt":
                w = w[:-1]
        else:
            w = w[: m.start()]
            if end in ("e", "en", "es") and w.endswith("niss"):
                w = w[:-1]
    m = re.search(r"(est|en|er|st)$", w)
    if m and m.start() >= r1:
        if m.group() != "st" or (w[m.start() - 1] in "bdfghklmnt" and m.start() >= 4):
            w = w[: m.start()]
    m = re.search(r"(isch|lich|heit|keit|end|ung|ig|ik)$", w)
    if m and m.start() >= r2:
        end, at = m.group(), m.start()
        if end in ("end", "ung"):
            w = w[:at]
            if w.endswith("ig") and not w.endswith("eig") and at - 2 >= r2:
                w = w[:-2]
        elif end in ("ig", "ik", "isch"):
            if w[at - 1] != "e":
                w = w[:at]
        elif end in ("lich", "heit"):
            w = w[:at]
            if w.endswith(("er", "en")) and at - 2 >= r1:
                w = w[:-2]
        else:
            w = w[:at]
            for more in ("lich", "ig"):
                if w.endswith(more) and at - len(more) >= r2:
                    w = w[: -len(more)]
                    break
    return w.lower().replace("ä", "a").replace("ö", "o").replace("ü", "u")


def _nordic(vowels: str, main: str, s_after: str, clusters: str, others: str) -> Callable[[str], str]:
    """The plan that the stemmers of the northern languages share: endings, then consonant pairs, then derivations, all after the first syllable."""
    main_re, cluster_re, other_re = (re.compile(f"(?:{x})$") for x in (main, clusters, others))

    def strip(w: str, r1: int) -> tuple[str, str]:
        m = main_re.search(w)
        if m and m.start() >= r1:
            end = m.group()
            if end == "s":
                return (w[:-1], end) if w[:-1] and re.search(s_after, w[:-1]) else (w, "")
            return w[: m.start()], end
        return w, ""

    def stem(word: str) -> str:
        w = word
        r1 = max(3, _region(w, 0, vowels))
        w, _ = strip(w, r1)
        m = cluster_re.search(w)
        if m and m.start() >= r1:
            w = w[:-1]
        m = other_re.search(w)
        if m and m.start() >= r1:
            end = m.group()
            w = w[: m.start()] + {"fullt": "full", "löst": "lös"}.get(end, "")
        return w

    return stem


swedish = _nordic(
    "aeiouyäåö",
    "heterna|hetens|anden|heten|heter|arnas|ernas|ornas|andes|arens|andet|arna|erna|orna|ande|arne|aste|aren|ades|erns|ade|are|ern|ens|het|ast|ad|en|ar|er|or|as|es|at|a|e|s",
    "[bcdfghjklmnoprtvy]$", "dd|gd|nn|dt|gt|kt|tt", "fullt|löst|lig|els|ig",
)
_norwegian = _nordic(
    "aeiouyæåø",
    "hetenes|hetene|hetens|heter|heten|endes|ande|ende|edes|enes|ede|ane|ene|ens|ers|ets|het|ast|en|ar|er|as|es|et|a|e|s",
    "[bcdfghjlmnoprtvyz]$|[^aeiouyæåø]k$", "dt|vt", "hetslov|eleg|elig|elov|slov|leg|eig|lig|els|lov|ig",
)


def norwegian(word: str) -> str:
    r1 = max(3, _region(word, 0, "aeiouyæåø"))
    m = re.search(r"(erte|ert)$", word)
    if m and m.start() >= r1:
        word = word[: m.start()] + "er"
        m = re.search(r"(dt|vt)$", word)
        return word[:-1] if m and m.start() >= r1 else word
    return _norwegian(word)


_DV = "aeiouyæåø"


def danish(word: str) -> str:
    w = word
    r1 = max(3, _region(w, 0, _DV))
    m = re.search(r"(erendes|erende|hedens|ethed|erede|heden|heder|endes|ernes|erens|erets|ered|ende|erne|eren|erer|heds|enes|eres|eret|hed|ene|ere|ens|ers|ets|en|er|es|et|e|s)$", w)
    if m and m.start() >= r1:
        if m.group() != "s":
            w = w[: m.start()]
        elif re.search(r"[abcdfghjklmnoprtvyzå]$", w[:-1]):
            w = w[:-1]

    def pair(w: str) -> str:
        return w[:-1] if re.search(r"(gd|dt|gt|kt)$", w) and len(w) - 2 >= r1 else w

    w = pair(w)
    if w.endswith("igst"):
        w = w[:-2]
    m = re.search(r"(elig|løst|els|lig|ig)$", w)
    if m and m.start() >= r1:
        w = w[:-1] if m.group() == "løst" else pair(w[: m.start()])
    if len(w) >= 2 and w[-1] == w[-2] and w[-1] not in _DV and len(w) - 1 >= r1:
        w = w[:-1]
    return w


STEMMERS: dict[str, Callable[[str], str]] = {
    "english": english, "german": german, "swedish": swedish, "norwegian": norwegian, "danish": danish,
    "french": french, "spanish": spanish, "italian": italian, "portuguese": portuguese, "romanian": romanian,
    "dutch": dutch, "russian": russian, "finnish": finnish, "hungarian": hungarian, "arabic": arabic, "turkish": turkish, "tamil": tamil,
}
