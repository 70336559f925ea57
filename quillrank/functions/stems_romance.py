"""Stemmers of Romance languages, from the published descriptions of the Snowball algorithms: French, Spanish, Italian, Portuguese and Romanian."""

from __future__ import annotations


def region(w: str, start: int, vowels: str) -> int:
    """Where the part after the first non-vowel that follows a vowel begins, from ``start`` on."""
    for i in range(start + 1, len(w)):
        if w[i] not in vowels and w[i - 1] in vowels:
            return i + 1
    return len(w)


def verb_region(w: str, vowels: str) -> int:
    """After the third letter where a consonant and a vowel begin the word, after the next vowel where its second letter is a consonant, else after the next consonant."""
    if len(w) < 2:
        return len(w)
    if w[1] not in vowels:
        return next((i + 1 for i in range(2, len(w)) if w[i] in vowels), len(w))
    if w[0] in vowels:
        return next((i + 1 for i in range(2, len(w)) if w[i] not in vowels), len(w))
    return min(3, len(w))


def longest(w: str, ends: list[str]) -> str | None:
    """The longest of ``ends`` (sorted by length, longest first) with which ``w`` ends."""
    return next((e for e in ends if w.endswith(e)), None)


def by_length(*groups: str) -> list[str]:
    return sorted({e for g in groups for e in g.split()}, key=lambda e: (-len(e), e))


def between_vowels(w: str, letters: str, vowels: str) -> str:
    """``letters`` that stand between vowels as capitals, so that they count as consonants."""
    out = list(w)
    for i in range(1, len(out) - 1):
        if out[i] in letters and out[i - 1] in vowels and w[i + 1] in vowels:
            out[i] = out[i].upper()
    return "".join(out)


class _Word:
    """A word with its regions; ``cut`` takes an end away if it lies in one."""

    def __init__(self, w: str, vowels: str, rv: int | None = None) -> None:
        self.w = w
        self.rv = verb_region(w, vowels) if rv is None else rv
        self.r1 = region(w, 0, vowels)
        self.r2 = region(w, self.r1, vowels)

    def cut(self, end: str, at: int, put: str = "") -> bool:
        if not self.w.endswith(end) or len(self.w) - len(end) < at:
            return False
        self.w = self.w[: len(self.w) - len(end)] + put
        return True

    def cut_one(self, ends: str, at: int) -> bool:
        """The longest of ``ends`` is what counts, whether it lies in the region or not."""
        end = longest(self.w, by_length(ends))
        return end is not None and self.cut(end, at)


# Spanish

_ES = "aeiouáéíóúü"
_ES_PRONOUNS = by_length("me se sela selo selas selos la le lo las les los nos")
_ES_KINDS = {
    "plain": "anza anzas ico ica icos icas ismo ismos able ables ible ibles ista istas oso osa osos osas amiento amientos imiento imientos",
    "ador": "adora ador ación adoras adores aciones ante antes ancia ancias", "log": "logía logías", "u": "ución uciones", "ente": "encia encias",
    "amente": "amente", "mente": "mente", "idad": "idad idades", "iva": "iva ivo ivas ivos",
}
_ES_OF = {e: k for k, v in _ES_KINDS.items() for e in v.split()}
_ES_ENDS = by_length(*_ES_KINDS.values())
_ES_Y = by_length("ya ye yan yen yeron yendo yo yó yas yes yais yamos")
_ES_VERBS = by_length(
    "arían arías arán arás aríais aría aréis aríamos aremos ará aré erían erías erán erás eríais ería eréis eríamos eremos erá eré irían irías irán irás iríais iría iréis iríamos iremos irá iré",
    "aba ada ida ía ara iera ad ed id ase iese aste iste an aban ían aran ieran asen iesen aron ieron ado ido ando iendo ió ar er ir as abas adas idas ías aras ieras ases ieses ís áis abais íais arais ierais aseis ieseis asteis isteis ados idos amos ábamos íamos imos áramos iéramos iésemos ásemos",
    "en es éis emos",
)
_PLAIN = str.maketrans("áéíóú", "aeiou")


def spanish(word: str) -> str:
    x = _Word(word, _ES)
    end = longest(x.w, _ES_PRONOUNS)
    if end and len(x.w) - len(end) >= x.rv:
        stem = x.w[: -len(end)]
        before = longest(stem, by_length("iéndo ándo ár ér ír ando iendo ar er ir yendo"))
        if before and len(stem) - len(before) >= x.rv and (before != "yendo" or stem[: -len(before)].endswith("u")):
            x.w = stem[: -len(before)] + before.translate(_PLAIN)
    done, end = False, longest(x.w, _ES_ENDS)
    if end:
        kind = _ES_OF[end]
        if kind == "amente":
            done = x.cut(end, x.r1)
            if done:
                if x.cut("iv", x.r2):
                    x.cut("at", x.r2)
                else:
                    x.cut_one("os ic ad", x.r2)
        else:
            done = x.cut(end, x.r2, {"log": "log", "u": "u", "ente": "ente"}.get(kind, ""))
            if done and kind in ("ador", "mente", "idad", "iva"):
                x.cut_one({"ador": "ic", "mente": "ante able ible", "idad": "abil ic iv", "iva": "at"}[kind], x.r2)
    if not done:
        end = longest(x.w, _ES_Y)
        if end and x.w[: -len(end)].endswith("u") and x.cut(end, x.rv):
            done = True
    if not done:
        end = next((e for e in _ES_VERBS if x.w.endswith(e) and len(x.w) - len(e) >= x.rv), None)
        if end:
            x.cut(end, x.rv)
            if end in ("en", "es", "éis", "emos") and x.w.endswith("gu"):
                x.w = x.w[:-1]
    if not x.cut_one("os a o á í ó", x.rv) and x.cut_one("e é", x.rv) and x.w.endswith("gu") and len(x.w) - 1 >= x.rv:
        x.w = x.w[:-1]
    return x.w.translate(_PLAIN)


# French

_FR = "aeiouyâàëéêèïîôûù"
_FR_KINDS = {
    "plain": "ance iqUe isme able iste eux ances iqUes ismes ables istes", "ateur": "atrice ateur ation atrices ateurs ations", "log": "logie logies", "u": "usion ution usions utions",
    "ent": "ence ences", "ement": "ement ements", "ité": "ité ités", "if": "if ive ifs ives", "eau": "eaux", "al": "aux", "euse": "euse euses", "issement": "issement issements",
    "amment": "amment", "emment": "emment", "ment": "ment ments",
}
_FR_OF = {e: k for k, v in _FR_KINDS.items() for e in v.split()}
_FR_ENDS = by_length(*_FR_KINDS.values())
_FR_I = by_length(
    "îmes ît îtes i ie ies ir ira irai iraIent irais irait iras irent irez iriez irions irons iront is issaIent issais issait issant issante issantes issants isse issent isses issez issiez issions issons it"
)
_FR_E = by_length("é ée ées és èrent er era erai eraIent erais erait eras erez eriez erions erons eront ez iez")
_FR_A = by_length("âmes ât âtes a ai aIent ais ait ant ante antes ants as asse assent asses assiez assions")
_FR_VERBS = by_length("ions", *_FR_E, *_FR_A)


def _french_standard(x: _Word) -> tuple[bool, bool]:
    """(changed, whether verbs are to be looked for as well)."""
    end = longest(x.w, _FR_ENDS)
    if end is None:
        return False, True
    kind = _FR_OF[end]
    if kind == "plain":
        done = x.cut(end, x.r2)
    elif kind == "ateur":
        done = x.cut(end, x.r2)
        if done and x.w.endswith("ic") and not x.cut("ic", x.r2):
            x.cut("ic", 0, "iqU")
    elif kind in ("log", "u", "ent"):
        done = x.cut(end, x.r2, kind)
    elif kind == "ement":
        done = x.cut(end, x.rv)
        if done:
            if x.w.endswith("iv"):
                if x.cut("iv", x.r2):
                    x.cut("at", x.r2)
            elif x.w.endswith("eus"):
                if not x.cut("eus", x.r2):
                    x.cut("eus", x.r1, "eux")
            elif x.w.endswith(("abl", "iqU")):
                x.cut(x.w[-3:], x.r2)
            elif x.w.endswith(("ièr", "Ièr")):
                x.cut(x.w[-3:], x.rv, "i")
    elif kind == "ité":
        done = x.cut(end, x.r2)
        if done:
            if x.w.endswith("abil"):
                if not x.cut("abil", x.r2):
                    x.cut("abil", 0, "abl")
            elif x.w.endswith("ic"):
                if not x.cut("ic", x.r2):
                    x.cut("ic", 0, "iqU")
            else:
                x.cut("iv", x.r2)
    elif kind == "if":
        done = x.cut(end, x.r2)
        if done and x.cut("at", x.r2) and x.w.endswith("ic") and not x.cut("ic", x.r2):
            x.cut("ic", 0, "iqU")
    elif kind == "eau":
        done = x.cut(end, 0, "eau")
    elif kind == "al":
        done = x.cut(end, x.r1, "al")
    elif kind == "euse":
        done = x.cut(end, x.r2) or x.cut(end, x.r1, "eux")
    elif kind == "issement":
        before = x.w[: -len(end)]
        done = bool(before) and before[-1] not in _FR and x.cut(end, x.r1)
    elif kind in ("amment", "emment"):
        return x.cut(end, x.rv, kind[0] + "nt"), True
    else:
        before = len(x.w) - len(end) - 1
        return before >= x.rv and x.w[before] in _FR and x.cut(end, 0), True
    return done, not done


def french(word: str) -> str:
    letters = list(word)
    for i, c in enumerate(letters):
        left, right = i > 0 and letters[i - 1] in _FR, i + 1 < len(word) and word[i + 1] in _FR
        if c in "ui" and left and right or c == "y" and (left or right) or c == "u" and i > 0 and word[i - 1] == "q":
            letters[i] = c.upper()
    w = "".join(letters)
    if len(w) > 2 and (w[0] in _FR and w[1] in _FR or w.startswith(("par", "col", "tap"))):
        rv = 3
    else:
        rv = next((i + 1 for i in range(1, len(w)) if w[i] in _FR), len(w))
    x = _Word(w, _FR, rv)
    changed, verbs = _french_standard(x)
    if verbs:
        end = next((e for e in _FR_I if x.w.endswith(e) and len(x.w) - len(e) >= x.rv), None)
        i_verb = False
        if end:
            at = len(x.w) - len(end) - 1
            i_verb = at >= x.rv and x.w[at] not in _FR and x.cut(end, x.rv)
        changed |= i_verb
        if not i_verb:
            end = next((e for e in _FR_VERBS if x.w.endswith(e) and len(x.w) - len(e) >= x.rv), None)
            if end == "ions":
                changed |= x.cut(end, x.r2)
            elif end:
                x.cut(end, x.rv)
                changed = True
                if end in _FR_A:
                    x.cut("e", x.rv)
    if changed:
        if x.w.endswith("Y"):
            x.w = x.w[:-1] + "i"
        elif x.w.endswith("ç"):
            x.w = x.w[:-1] + "c"
    else:
        if len(x.w) > 1 and x.w[-1] == "s" and x.w[-2] not in "aiouès":
            x.w = x.w[:-1]
        if x.w.endswith("ion") and len(x.w) - 3 >= max(x.r2, x.rv + 1) and x.w[-4] in "st":
            x.w = x.w[:-3]
        elif x.w.endswith(("ier", "ière", "Ier", "Ière")) and len(x.w) - (3 if x.w.endswith("r") else 4) >= x.rv:
            x.w = x.w[: -3 if x.w.endswith("r") else -4] + "i"
        elif not x.cut("e", x.rv) and x.w.endswith("guë"):
            x.cut("ë", x.rv)
    if x.w.endswith(("enn", "onn", "ett", "ell", "eill")):
        x.w = x.w[:-1]
    for i in range(len(x.w) - 1, -1, -1):
        if x.w[i] in _FR:
            if x.w[i] in "éè" and i < len(x.w) - 1:
                x.w = x.w[:i] + "e" + x.w[i + 1 :]
            break
    return x.w.lower()


# Italian

_IT = "aeiouàèìòù"
_IT_PRONOUNS = by_length("ci gli la le li lo mi ne si ti vi sene gliela gliele glieli glielo gliene mela mele meli melo mene tela tele teli telo tene cela cele celi celo cene vela vele veli velo vene")
_IT_KINDS = {
    "plain": "anza anze ico ici ica ice iche ichi ismo ismi abile abili ibile ibili ista iste isti istà istè istì oso osi osa ose mente atrice atrici ante anti",
    "azione": "azione azioni atore atori", "log": "logia logie", "u": "uzione uzioni usione usioni", "ente": "enza enze", "amento": "amento amenti imento imenti",
    "amente": "amente", "ità": "ità", "ivo": "ivo ivi iva ive",
}
_IT_OF = {e: k for k, v in _IT_KINDS.items() for e in v.split()}
_IT_ENDS = by_length(*_IT_KINDS.values())
_IT_VERBS = by_length(
    "ammo ando ano are arono asse assero assi assimo ata ate ati ato ava avamo avano avate avi avo emmo enda ende endi endo erà erai eranno ere erebbe erebbero erei eremmo eremo ereste eresti erete erò erono essero ete eva evamo evano evate evi evo Yamo iamo immo",
    "irà irai iranno ire irebbe irebbero irei iremmo iremo ireste iresti irete irò irono isca iscano isce isci isco iscono issero ita ite iti ito iva ivamo ivano ivate ivi ivo ono uta ute uti uto ar ir",
)


def italian(word: str) -> str:
    w = word.translate(str.maketrans("áéíóú", "àèìòù")).replace("qu", "qU")
    x = _Word(between_vowels(w, "ui", _IT), _IT)
    end = longest(x.w, _IT_PRONOUNS)
    if end and len(x.w) - len(end) >= x.rv:
        stem = x.w[: -len(end)]
        if stem.endswith(("ando", "endo")) and len(stem) - 4 >= x.rv:
            x.w = stem
        elif stem.endswith(("ar", "er", "ir")) and len(stem) - 2 >= x.rv:
            x.w = stem + "e"
    done, end = False, longest(x.w, _IT_ENDS)
    if end:
        kind = _IT_OF[end]
        if kind == "amente":
            done = x.cut(end, x.r1)
            if done:
                if x.cut("iv", x.r2):
                    x.cut("at", x.r2)
                else:
                    x.cut_one("os ic abil", x.r2)
        elif kind == "amento":
            done = x.cut(end, x.rv)
        else:
            done = x.cut(end, x.r2, {"log": "log", "u": "u", "ente": "ente"}.get(kind, ""))
            if done and kind == "azione":
                x.cut("ic", x.r2)
            elif done and kind == "ità":
                x.cut_one("abil ic iv", x.r2)
            elif done and kind == "ivo" and x.cut("at", x.r2):
                x.cut("ic", x.r2)
    if not done:
        end = next((e for e in _IT_VERBS if x.w.endswith(e) and len(x.w) - len(e) >= x.rv), None)
        if end:
            x.cut(end, x.rv)
    if x.w and x.w[-1] in "aeioàèìò" and len(x.w) - 1 >= x.rv:
        x.w = x.w[:-1]
        x.cut("i", x.rv)
    if x.w.endswith(("ch", "gh")) and len(x.w) - 2 >= x.rv:
        x.w = x.w[:-1]
    return x.w.lower()


# Portuguese

_PT = "aeiouáéíóúâêô"
_PT_KINDS = {
    "plain": "eza ezas ico ica icos icas ismo ismos ável ível ista istas oso osa osos osas amento amentos imento imentos adora ador aça~o adoras adores aço~es ante antes ância",
    "log": "logia logias", "u": "uça~o uço~es", "ente": "ência ências", "amente": "amente", "mente": "mente", "idade": "idade idades", "iva": "iva ivo ivas ivos", "ira": "ira iras",
}
_PT_OF = {e: k for k, v in _PT_KINDS.items() for e in v.split()}
_PT_ENDS = by_length(*_PT_KINDS.values())
_PT_VERBS = by_length(
    "ada ida ia aria eria iria ará ara erá era irá ava asse esse isse aste este iste ei arei erei irei am iam ariam eriam iriam aram eram iram avam em arem erem irem assem essem issem ado ido ando endo indo ara~o era~o ira~o ar er ir as adas idas ias arias erias irias arás aras erás eras irás avas es ardes erdes irdes ares eres ires asses esses isses astes estes istes",
    "is ais eis íeis aríeis eríeis iríeis áreis areis éreis ereis íreis ireis ásseis ésseis ísseis áveis ados idos ámos amos íamos aríamos eríamos iríamos áramos éramos íramos ávamos emos aremos eremos iremos ássemos êssemos íssemos imos armos ermos irmos eu iu ou ira iras",
)


def portuguese(word: str) -> str:
    x = _Word(word.replace("ã", "a~").replace("õ", "o~"), _PT)
    done, end = False, longest(x.w, _PT_ENDS)
    if end:
        kind = _PT_OF[end]
        if kind == "amente":
            done = x.cut(end, x.r1)
            if done:
                if x.cut("iv", x.r2):
                    x.cut("at", x.r2)
                else:
                    x.cut_one("os ic ad", x.r2)
        elif kind == "ira":
            done = x.w[: -len(end)].endswith("e") and x.cut(end, x.rv, "ir")
        else:
            done = x.cut(end, x.r2, {"log": "log", "u": "u", "ente": "ente"}.get(kind, ""))
            if done and kind in ("mente", "idade", "iva"):
                x.cut_one({"mente": "ante avel ível", "idade": "abil ic iv", "iva": "at"}[kind], x.r2)
    if not done:
        end = next((e for e in _PT_VERBS if x.w.endswith(e) and len(x.w) - len(e) >= x.rv), None)
        done = end is not None and x.cut(end, x.rv)
    if done:
        if x.w.endswith("ci"):
            x.cut("i", x.rv)
    else:
        x.cut_one("os a i o á í ó", x.rv)
    if x.cut_one("e é ê", x.rv):
        if x.w.endswith(("gu", "ci")) and len(x.w) - 1 >= x.rv:
            x.w = x.w[:-1]
    elif x.w.endswith("ç"):
        x.w = x.w[:-1] + "c"
    return x.w.replace("a~", "ã").replace("o~", "õ")


# Romanian

_RO = "aăâeiîou"
_RO_PLURALS = {"ul": "", "ului": "", "aua": "a", "ea": "e", "ele": "e", "elor": "e", "ii": "i", "iua": "i", "iei": "i", "iile": "i", "iilor": "i", "ilor": "i", "ile": "i", "atei": "at", "aţie": "aţi", "aţia": "aţi"}
_RO_COMBINED = {e: put for put, ends in {
    "abil": "abilitate abilitati abilităi abilităţi", "ibil": "ibilitate", "iv": "ivitate ivitati ivităi ivităţi",
    "ic": "icitate icitati icităi icităţi icator icatori iciv iciva icive icivi icivă ical icala icale icali icală",
    "at": "ativ ativa ative ativi ativă aţiune atoare ator atori ătoare ător ători", "it": "itiv itiva itive itivi itivă iţiune itoare itor itori",
}.items() for e in ends.split()}
_RO_ENDS = by_length(
    "at ata ată ati ate ut uta ută uti ute it ita ită iti ite ic ica ice ici ică abil abila abile abili abilă ibil ibila ibile ibili ibilă oasa oasă oase os osi oşi ant anta ante anti antă ator atori itate itati ităi ităţi iv iva ive ivi ivă",
    "iune iuni ism isme ist ista iste isti istă işti",
)
_RO_AFTER = by_length(
    "are ere ire âre ind ând indu ându eze ească ez ezi ează esc eşti eşte ăsc ăşti ăşte am ai au eam eai ea eaţi eau iam iai ia iaţi iau ui aşi arăm arăţi ară uşi urăm urăţi ură işi irăm irăţi iră âi âşi ârăm ârăţi âră asem aseşi ase aserăm aserăţi aseră",
    "isem iseşi ise iserăm iserăţi iseră âsem âseşi âse âserăm âserăţi âseră usem useşi use userăm userăţi useră",
)
_RO_VERBS = by_length("ăm aţi em eţi im iţi âm âţi seşi serăm serăţi seră sei se sesem seseşi sese seserăm seserăţi seseră", *_RO_AFTER)


def romanian(word: str) -> str:
    w = word.replace("ș", "ş").replace("ț", "ţ")
    x = _Word(between_vowels(w, "ui", _RO), _RO)
    end = longest(x.w, by_length(*_RO_PLURALS))
    if end and not (end == "ile" and x.w.endswith("abile")):
        x.cut(end, x.r1, _RO_PLURALS[end])
    done = False
    while (end := longest(x.w, by_length(*_RO_COMBINED))) and x.cut(end, x.r1, _RO_COMBINED[end]):
        done = True
    end = longest(x.w, _RO_ENDS)
    if end in ("iune", "iuni"):
        if x.w[: -len(end)].endswith("ţ") and x.cut(end, x.r2):
            x.w, done = x.w[:-1] + "t", True
    elif end in ("ism", "isme", "ist", "ista", "iste", "isti", "istă", "işti"):
        done |= x.cut(end, x.r2, "ist")
    elif end:
        done |= x.cut(end, x.r2)
    if not done:
        end = next((e for e in _RO_VERBS if x.w.endswith(e) and len(x.w) - len(e) >= x.rv), None)
        if end:
            at = len(x.w) - len(end) - 1
            if end not in _RO_AFTER or at >= x.rv and (x.w[at] not in _RO or x.w[at] == "u"):
                x.cut(end, x.rv)
    x.cut_one("a e i ie ă", x.rv)
    return x.w.lower()
