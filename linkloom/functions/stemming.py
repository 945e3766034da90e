"""The English (Porter 2) stemmer after its published description, for a pandas UDF over distinct words."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

VOWEL = "aeiouy"
#: Fixed values of the published algorithm.
IRREGULAR = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl", "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes"}
AFTER_1A = {"inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"}
STEP2 = {"tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al", "alli": "al", "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "fulli": "ful", "lessli": "less"}
STEP3 = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP4 = ("ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "al", "er", "ic")
_REGION = re.compile(r"[aeiouy][^aeiouy]")


def _ends(suffixes) -> tuple[frozenset[str], tuple[int, ...]]:
    """Suffixes, and their lengths from the longest on."""
    return frozenset(suffixes), tuple(sorted({len(x) for x in suffixes}, reverse=True))


def _longest(w: str, ends: tuple[frozenset[str], tuple[int, ...]]) -> str | None:
    """The longest of the suffixes that the word has: one look for each length."""
    held, lengths = ends
    for n in lengths:
        if w[-n:] in held:
            return w[-n:]
    return None


_PAST = _ends(("ingly", "edly", "ing", "ed"))
_STEPS = ((STEP2, _ends((*STEP2, "ogi", "li"))), (STEP3, _ends((*STEP3, "ative"))))
_STEP4 = _ends((*STEP4, "ion"))


def _after(word: str, start: int) -> int:
    found = _REGION.search(word, start)
    return found.end() if found else len(word)


def _short_end(w: str) -> bool:
    if len(w) == 2:
        return w[0] in VOWEL and w[1] not in VOWEL
    return len(w) > 2 and w[-1] not in VOWEL + "wxY" and w[-2] in VOWEL and w[-3] not in VOWEL


def _double(w: str) -> bool:
    return len(w) > 1 and w[-1] == w[-2] and w[-1] in "bdfgmnprt"


def english(word: str) -> str:
    if len(word) < 3:
        return word
    if word in IRREGULAR:
        return IRREGULAR[word]
    w = word.lstrip("'")
    if "y" in w:
        w = re.sub(r"(^|[aeiouy])y", r"\1Y", w)
    head = re.match(r"gener|commun|arsen", w)
    r1 = head.end() if head else _after(w, 0)
    r2 = _after(w, r1)
    if "'" in w:
        w = re.sub(r"('s'|'s|')$", "", w)
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and re.search(r"[aeiouy].", w[:-1]):
        w = w[:-1]
    if w in AFTER_1A:
        return w
    if w.endswith(("eed", "eedly")):
        stem = w[: -3 if w.endswith("eed") else -5]
        w = stem + "ee" if len(stem) >= r1 else w
    else:
        cut = _longest(w, _PAST)
        if cut and re.search(r"[aeiouy]", w[: -len(cut)]):
            w = w[: -len(cut)]
            if w.endswith(("at", "bl", "iz")):
                w += "e"
            elif _double(w):
                w = w[:-1]
            elif len(w) <= r1 and _short_end(w):
                w += "e"
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in VOWEL:
        w = w[:-1] + "i"
    for table, names in _STEPS:
        cut = _longest(w, names)
        if cut and len(w) - len(cut) >= r1:
            stem = w[: -len(cut)]
            if cut in table:
                w = stem + table[cut]
            elif cut == "ogi" and stem.endswith("l"):
                w = stem + "og"
            elif cut == "li" and stem[-1:] and stem[-1] in "cdeghkmnrt":
                w = stem
            elif cut == "ative" and len(stem) >= r2:
                w = stem
    cut = _longest(w, _STEP4)
    if cut and len(w) - len(cut) >= r2 and (cut != "ion" or w[-4:-3] in ("s", "t")):
        w = w[: -len(cut)]
    if w.endswith("e") and (len(w) - 1 >= r2 or len(w) - 1 >= r1 and not _short_end(w[:-1])):
        w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.replace("Y", "y")


#: Fixed values of the published Spanish algorithm.
ES_VOWEL = "aeiouáéíóúü"
ES_PRONOUNS = ("selas", "selos", "sela", "selo", "las", "les", "los", "nos", "me", "se", "la", "le", "lo")
ES_BEFORE_PRONOUN = ("iéndo", "ándo", "ár", "ér", "ír", "iendo", "ando", "ar", "er", "ir", "yendo")
ES_STANDARD = (
    (("amientos", "imientos", "amiento", "imiento", "anzas", "ismos", "ables", "ibles", "istas", "anza", "icos", "icas", "ismo", "able", "ible", "ista", "osos", "osas", "ico", "ica", "oso", "osa"), "r2", ""),
    (("aciones", "adoras", "adores", "ancias", "acion", "adora", "ación", "antes", "ancia", "ador", "ante"), "r2 ic", ""),
    (("logías", "logía"), "r2", "log"), (("uciones", "ución"), "r2", "u"), (("encias", "encia"), "r2", "ente"),
    (("amente",), "amente", ""), (("mente",), "mente", ""), (("idades", "idad"), "idad", ""), (("ivas", "ivos", "iva", "ivo"), "iva", ""),
)
ES_Y = ("yeron", "yendo", "yamos", "yais", "yan", "yen", "yas", "yes", "ya", "ye", "yo", "yó")
ES_VERB_U = ("en", "es", "éis", "emos")
ES_VERBS = (
    "arían arías arán arás aríais aría aréis aríamos aremos ará aré erían erías erán erás eríais ería eréis eríamos eremos erá eré irían irías irán irás iríais iría iréis iríamos iremos irá iré "
    "aba ada ida ía ara iera ad ed id ase iese aste iste an aban ían aran ieran asen iesen aron ieron ado ido ando iendo ió ar er ir as abas adas idas ías aras ieras ases ieses ís áis abais íais arais ierais "
    "aseis ieseis asteis isteis ados idos amos ábamos íamos imos áramos iéramos iésemos ásemos"
).split()
_PLAIN = str.maketrans("áéíóú", "aeiou")
_PRONOUNS, _BEFORE_PRONOUN, _Y, _VERBS = map(_ends, (ES_PRONOUNS, ES_BEFORE_PRONOUN, ES_Y, (*ES_VERBS, *ES_VERB_U)))
_STANDARD = {x: (kind, put) for group, kind, put in ES_STANDARD for x in group}
_STANDARD_ENDS, _ENDINGS, _E = map(_ends, (_STANDARD, ("os", "a", "o", "á", "í", "ó"), ("e", "é")))


def _spanish_regions(w: str) -> tuple[int, int, int]:
    def after(start: int) -> int:
        for i in range(start + 1, len(w)):
            if w[i] not in ES_VOWEL and w[i - 1] in ES_VOWEL:
                return i + 1
        return len(w)

    r1 = after(0)
    rv = len(w)
    if len(w) > 2:
        if w[1] not in ES_VOWEL:
            rv = next((i + 1 for i in range(2, len(w)) if w[i] in ES_VOWEL), len(w))
        elif w[0] in ES_VOWEL:
            rv = next((i + 1 for i in range(2, len(w)) if w[i] not in ES_VOWEL), len(w))
        else:
            rv = 3
    return rv, r1, after(r1) if r1 < len(w) else len(w)


def _end(w: str, ends: tuple[frozenset[str], tuple[int, ...]], start: int) -> str | None:
    """The longest of the suffixes that the word has, if it lies behind start."""
    found = _longest(w, ends)
    return found if found and len(w) - len(found) >= start else None


def _spanish_pronoun(w: str, rv: int) -> str:
    pronoun = _end(w, _PRONOUNS, rv)
    if not pronoun:
        return w
    stem = w[: -len(pronoun)]
    before = _end(stem, _BEFORE_PRONOUN, rv)
    if not before or before == "yendo" and not stem.endswith("uyendo"):
        return w
    return stem[: -len(before)] + before.translate(_PLAIN) if before in ES_BEFORE_PRONOUN[:5] else stem


def _spanish_standard(w: str, r1: int, r2: int) -> str:
    suffix = _longest(w, _STANDARD_ENDS)
    if not suffix:
        return w
    kind, put = _STANDARD[suffix]
    at = len(w) - len(suffix)
    if at < (r1 if kind == "amente" else r2):
        return w
    w = w[:at] + put

    def drop(*ends: str) -> str:
        x = _end(w, _ends(ends), r2)
        return w[: -len(x)] if x else w

    if kind == "r2 ic":
        return drop("ic")
    if kind == "amente":
        if _end(w, _ends(("iv",)), r2):
            w = w[:-2]
            return drop("at")
        return drop("os", "ic", "ad")
    if kind == "mente":
        return drop("ante", "able", "ible")
    if kind == "idad":
        return drop("abil", "ic", "iv")
    return drop("at") if kind == "iva" else w


def spanish(word: str) -> str:
    """The Spanish stemmer after its published description."""
    w = word
    rv, r1, r2 = _spanish_regions(w)
    w = _spanish_pronoun(w, rv)
    before = w
    w = _spanish_standard(w, r1, r2)
    if w == before:
        y = _end(w, _Y, rv)
        if y and w[: -len(y)].endswith("u"):
            w = w[: -len(y)]
        else:
            verb = _end(w, _VERBS, rv)
            if verb:
                w = w[: -len(verb)]
                if verb in ES_VERB_U and w.endswith("gu"):
                    w = w[:-1]
    if residual := _end(w, _ENDINGS, rv):
        w = w[: -len(residual)]
    elif residual := _end(w, _E, rv):
        w = w[:-1]
        if w.endswith("gu") and len(w) - 1 >= rv:
            w = w[:-1]
    return w.translate(_PLAIN)


STEMMERS = {"en": english, "es": spanish}


@F.pandas_udf(T.StringType())
def stem(words: pd.Series, langs: pd.Series) -> pd.Series:
    """To be applied to a vocabulary's distinct words, and joined back; languages without a stemmer keep the word."""
    return pd.Series([None if w is None else STEMMERS.get(x, str)(w) for w, x in zip(words, langs, strict=True)], dtype=object)


@F.pandas_udf(T.StringType())
def stem_english(words: pd.Series) -> pd.Series:
    """To be applied to a vocabulary's distinct words, and joined back."""
    return words.map(english, na_action="ignore")
