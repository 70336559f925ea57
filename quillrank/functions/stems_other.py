"""Stemmers of further languages. Dutch, Russian, Finnish and Hungarian follow the published descriptions of the Snowball algorithms, Arabic
the published light10 stemmer. Turkish and Tamil are light stemmers of our own, which take away the commonest endings of nouns: their
stems aren't those of Snowball."""

from __future__ import annotations

import re

from .stems_romance import by_length, longest, region

# Dutch

_NL = "aeiouyè"


def _nl_undouble(w: str) -> str:
    return w[:-1] if w.endswith(("kk", "dd", "tt")) else w


def dutch(word: str) -> str:
    w = word.translate(str.maketrans("äëïöüáéíóú", "aeiouaeiou"))
    letters = list(w)
    for i, c in enumerate(letters):
        if c == "y" and (i == 0 or letters[i - 1] in _NL) or c == "i" and 0 < i < len(w) - 1 and letters[i - 1] in _NL and w[i + 1] in _NL:
            letters[i] = c.upper()
    w = "".join(letters)
    r1 = region(w, 0, _NL)
    r2 = region(w, r1, _NL)
    r1 = max(r1, min(3, len(w)))

    def en(w: str, end: str) -> str:
        stem = w[: -len(end)]
        if len(stem) >= r1 and stem and stem[-1] not in _NL and not stem.endswith("gem"):
            return _nl_undouble(stem)
        return w

    def e(w: str) -> tuple[str, bool]:
        if w.endswith("e") and len(w) - 1 >= r1 and len(w) > 1 and w[-2] not in _NL:
            return _nl_undouble(w[:-1]), True
        return w, False

    end = longest(w, by_length("heden ene en se s"))
    if end == "heden":
        w = w[:-5] + "heid" if len(w) - 5 >= r1 else w
    elif end in ("en", "ene"):
        w = en(w, end)
    elif end and len(w) - len(end) >= r1 and len(w) > len(end) and w[-len(end) - 1] not in _NL + "j":
        w = w[: -len(end)]
    w, took_e = e(w)
    if w.endswith("heid") and len(w) - 4 >= r2 and not w[:-4].endswith("c"):
        w = w[:-4]
        if w.endswith("en"):
            w = en(w, "en")
    end = longest(w, by_length("end ing ig lijk baar bar"))
    if end and len(w) - len(end) >= r2:
        stem = w[: -len(end)]
        if end in ("end", "ing"):
            w = stem[:-2] if stem.endswith("ig") and len(stem) - 2 >= r2 and not stem.endswith("eig") else _nl_undouble(stem)
        elif end == "ig":
            w = w if stem.endswith("e") else stem
        elif end == "lijk":
            w, _ = e(stem)
        elif end == "baar" or took_e:
            w = stem
    if len(w) > 3 and w[-1] not in _NL + "I" and w[-3:-1] in ("aa", "ee", "oo", "uu") and w[-4] not in _NL:
        w = w[:-2] + w[-1]
    return w.lower()


# Russian

_RU = "аеиоуыэюя"
_RU_GERUND_A, _RU_GERUND = by_length("в вши вшись"), by_length("ив ивши ившись ыв ывши ывшись")
_RU_ADJECTIVE = by_length("ее ие ые ое ими ыми ей ий ый ой ем им ым ом его ого ему ому их ых ую юю ая яя ою ею")
_RU_PARTICIPLE_A, _RU_PARTICIPLE = by_length("ем нн вш ющ щ"), by_length("ивш ывш ующ")
_RU_VERB_A = by_length("ла на ете йте ли й л ем н ло но ет ют ны ть ешь нно")
_RU_VERB = by_length("ила ыла ена ейте уйте ите или ыли ей уй ил ыл им ым ен ило ыло ено ят ует уют ит ыт ены ить ыть ишь ую ю")
_RU_NOUN = by_length("а ев ов ие ье е иями ями ами еи ии и ией ей ой ий й иям ям ием ем ам ом о у ах иях ях ы ь ию ью ю ия ья я")


def russian(word: str) -> str:
    w = word.replace("ё", "е")
    rv = next((i + 1 for i, c in enumerate(w) if c in _RU), len(w))
    r2 = region(w, region(w, 0, _RU), _RU)

    def cut(w: str, plain: list[str], after_a: list[str] = []) -> str | None:  # noqa: B006
        """Without the longest of the ends in the region; those of ``after_a`` need а or я before them there."""
        for end in sorted({*plain, *after_a}, key=lambda x: -len(x)):
            at = len(w) - len(end)
            if w.endswith(end) and at >= rv:
                if end in plain:
                    return w[:at]
                return w[:at] if at - 1 >= rv and w[at - 1] in "ая" else None
        return None

    out = cut(w, _RU_GERUND, _RU_GERUND_A)
    if out is None:
        w = cut(w, ["ся", "сь"]) or w
        out = cut(w, _RU_ADJECTIVE)
        if out is not None:
            out = cut(out, _RU_PARTICIPLE, _RU_PARTICIPLE_A) or out
        else:
            out = cut(w, _RU_VERB, _RU_VERB_A)
            if out is None:
                out = cut(w, _RU_NOUN)
    w = w if out is None else out
    if w.endswith("и") and len(w) > rv:
        w = w[:-1]
    end = longest(w, ["ость", "ост"])
    if end and len(w) - len(end) >= max(r2, rv):
        w = w[: -len(end)]
    end = longest(w, ["ейше", "ейш"])
    if end and len(w) - len(end) >= rv:
        w = w[: -len(end)]
    elif w.endswith("ь") and len(w) > rv:
        return w[:-1]
    return w[:-1] if w.endswith("нн") and len(w) - 1 >= rv else w


# Finnish

_FI = "aeiouyäö"
_FI_LONG = ("aa", "ee", "ii", "oo", "uu", "ää", "öö")
_FI_CASES = by_length("han hen hin hon hän hön siin den tten seen a ä tta ttä ta tä ssa ssä sta stä lla llä lta ltä lle na nä ksi ine n")


def _fi_possessive(w: str, r1: int) -> str:
    end = longest(w, by_length("si ni nsa nsä mme nne an än en"))
    if not end or len(w) - len(end) < r1:
        return w
    stem = w[: -len(end)]
    if end == "si":
        return w if stem.endswith("k") else stem
    if end == "ni":
        return stem[:-3] + "ksi" if stem.endswith("kse") else stem
    if end in ("nsa", "nsä", "mme", "nne"):
        return stem
    before = {"an": ("ta", "ssa", "sta", "lla", "lta", "na"), "än": ("tä", "ssä", "stä", "llä", "ltä", "nä"), "en": ("lle", "ine")}[end]
    return stem if stem.endswith(before) else w


def _fi_case(w: str, r1: int) -> tuple[str, bool]:
    for end in _FI_CASES:
        if not w.endswith(end) or len(w) - len(end) < r1:
            continue
        stem = w[: -len(end)]
        if end in ("siin", "den", "tten"):
            if len(stem) > 1 and stem[-1] == "i" and stem[-2] in "aeiouäö":
                return stem, True
            continue  # a shorter end may do
        if end == "seen":
            if stem.endswith(_FI_LONG):
                return stem, True
            continue
        if end[0] == "h":
            return (stem, True) if stem.endswith(end[1]) else (w, False)
        if end in ("a", "ä"):
            return (stem, True) if len(stem) > 1 and stem[-1] in _FI and stem[-2] not in _FI else (w, False)
        if end in ("tta", "ttä"):
            return (stem, True) if stem.endswith("e") else (w, False)
        if end == "n" and stem.endswith((*_FI_LONG, "ie")) and len(stem) - 1 >= r1:
            stem = stem[:-1]
        return stem, True
    return w, False


def finnish(word: str) -> str:
    w = word
    r1 = region(w, 0, _FI)
    r2 = region(w, r1, _FI)
    end = longest(w, by_length("kin kaan kään ko kö han hän pa pä sti"))
    if end == "sti":
        w = w[:-3] if len(w) - 3 >= r2 else w
    elif end and len(w) - len(end) >= r1 and len(w) > len(end) and w[-len(end) - 1] in _FI + "nt":
        w = w[: -len(end)]
    w = _fi_possessive(w, r1)
    w, cased = _fi_case(w, r1)
    end = longest(w, by_length("mpi mpa mpä mmi mma mmä impi impa impä immi imma immä eja ejä"))
    if end and len(w) - len(end) >= r2 and not (len(end) == 3 and end[0] == "m" and w[: -len(end)].endswith("po")):
        w = w[: -len(end)]
    if cased:
        if w[-1:] in ("i", "j") and len(w) - 1 >= r1:
            w = w[:-1]
    elif w.endswith("t") and len(w) - 1 >= r1 and len(w) > 1 and w[-2] in _FI:
        w = w[:-1]
        if w.endswith("imma") and len(w) - 4 >= r2:
            w = w[:-4]
        elif w.endswith("mma") and len(w) - 3 >= r2 and not w[:-3].endswith("po"):
            w = w[:-3]
    if w.endswith(_FI_LONG) and len(w) - 2 >= r1:
        w = w[:-1]
    if len(w) > 1 and len(w) - 2 >= r1 and w[-1] in "aäei" and w[-2] not in _FI:
        w = w[:-1]
    if w.endswith(("oj", "uj")) and len(w) - 2 >= r1:
        w = w[:-1]
    if w.endswith("jo") and len(w) - 2 >= r1:
        w = w[:-1]
    m = re.search(rf"([^{_FI}])\1([{_FI}]*)$", w)
    return w[: m.start() + 1] + m.group(2) if m else w


# Hungarian

_HU = "aáeéiíoóöőuúüű"
_HU_DOUBLES = by_length("bb cc ccs dd ff gg ggy jj kk ll lly mm nn nny pp rr ss ssz tt tty vv zz zzs")
_HU_CASES = by_length("ban ben ba be ra re nak nek val vel tól től ról ről ból ből hoz hez höz nál nél ig at et ot öt ért képp képpen kor ul ül vá vé onként enként anként ként en on an ön n t")
_HU_OWNERS = [
    ({"oké": "", "öké": "", "aké": "", "eké": "", "ké": "", "éi": "", "é": "", "áké": "a", "áéi": "a", "éké": "e", "ééi": "e", "éé": "e"}),
    ({**dict.fromkeys("ünk unk nk juk jük uk ük em om am m od ed ad öd d ja je a e o".split(), ""), **dict.fromkeys("ánk ájuk ám ád á".split(), "a"), **dict.fromkeys("énk éjük ém éd é".split(), "e")}),
    ({**dict.fromkeys("jaim jeim aim eim im jaid jeid aid eid id jai jei ai ei i jaink jeink eink aink ink jaitok jeitek aitok eitek itek jeik jaik aik eik ik".split(), ""),
      **dict.fromkeys("áim áid ái áink áitok áik".split(), "a"), **dict.fromkeys("éim éid éi éink éitek éik".split(), "e")}),
    ({**dict.fromkeys("ök ok ek ak k".split(), ""), "ák": "a", "ék": "e"}),
]


def hungarian(word: str) -> str:
    w = word
    if w and w[0] in _HU:
        m = re.search(rf"(dzs|cs|gy|ly|ny|sz|ty|zs|[^{_HU}])", w)
        r1 = m.end() if m else len(w)
    else:
        r1 = next((i + 1 for i, c in enumerate(w) if c in _HU), len(w))

    def undouble(stem: str) -> str | None:
        end = longest(stem, _HU_DOUBLES)
        return None if end is None else stem[: len(stem) - len(end)] + end[1:]

    def put(w: str, ends: dict[str, str]) -> str:
        end = longest(w, by_length(*ends))
        return w[: len(w) - len(end)] + ends[end] if end and len(w) - len(end) >= r1 else w

    if w.endswith(("al", "el")) and len(w) - 2 >= r1:
        w = undouble(w[:-2]) or w
    end = longest(w, _HU_CASES)
    if end and len(w) - len(end) >= r1:
        w = w[: len(w) - len(end)]
        if w[-1:] in ("á", "é") and len(w) - 1 >= r1:
            w = w[:-1] + ("a" if w[-1] == "á" else "e")
    w = put(w, {"án": "a", "ánként": "a", "én": "e"})
    w = put(w, {"astul": "", "estül": "", "stul": "", "stül": "", "ástul": "a", "éstül": "e"})
    if w[-1:] in ("á", "é") and len(w) - 1 >= r1:
        w = undouble(w[:-1]) or w
    for ends in _HU_OWNERS:
        w = put(w, ends)
    return w


# Arabic

_AR_MARKS = re.compile("[ً-ْٰـ]")
_AR_FORMS = str.maketrans("أإآىة", "اااي" + "ه")


def arabic(word: str) -> str:
    w = _AR_MARKS.sub("", word).translate(_AR_FORMS)
    if w.startswith("و") and len(w) > 3:
        w = w[1:]
    for head in ("وال", "بال", "كال", "فال", "ال", "لل"):
        if w.startswith(head) and len(w) - len(head) >= 2:
            w = w[len(head) :]
            break
    for end in ("ها", "ان", "ات", "ون", "ين", "يه", "ه", "ي"):
        if w.endswith(end) and len(w) - len(end) >= 2:
            w = w[: -len(end)]
    return w


# Turkish

_TR = "aeıioöuü"
_TR_ENDS = [
    re.compile(r"(dır|dir|dur|dür|tır|tir|tur|tür|ydı|ydi|ydu|ydü|ymış|ymiş|ymuş|ymüş|yken)$"),
    re.compile(r"(nda|nde|ndan|nden|dan|den|tan|ten|da|de|ta|te|nın|nin|nun|nün|yla|yle|ya|ye|yı|yi|yu|yü)$"),
    re.compile(r"(ımız|imiz|umuz|ümüz|ınız|iniz|unuz|ünüz|mız|miz|muz|müz|nız|niz|nuz|nüz|sı|si|su|sü)$"),
    re.compile(r"(lar|ler|ları|leri)$"),
]


def turkish(word: str) -> str:
    w = word.split("'")[0].split("’")[0] or word
    for end in _TR_ENDS:
        m = end.search(w)
        if m and sum(c in _TR for c in w[: m.start()]) >= 1 and m.start() >= 3:
            w = w[: m.start()]
    return w


# Tamil

_TA_ENDS = by_length("களுக்கு களில் களின் களால் களை கள் த்தில் த்தின் த்தை த்துக்கு ிலிருந்து ுடன் ுக்கு க்கு ில் ின் ால் ாக ான ை")


def tamil(word: str) -> str:
    end = next((e for e in _TA_ENDS if word.endswith(e) and len(word) - len(e) >= 3), None)
    return word[: -len(end)] if end else word
