"""Stemming by script: Porter2 for Latin words, Snowball's Russian algorithm for Cyrillic ones.

Both follow the published descriptions of the algorithms. ``stem_terms`` runs over Arrow batches of
distinct terms.
"""

from __future__ import annotations

import re
from functools import lru_cache

import pyarrow as pa

# -- English (Porter2) ---------------------------------------------------------------------------

# Words the algorithm maps or leaves alone.
_EXCEPTIONS = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"}
_INVARIANT = frozenset("sky news howe atlas cosmos bias andes".split())
_AFTER_1A = frozenset("inning outing canning herring earring proceed exceed succeed".split())
_STEP2 = (("ization", "ize"), ("ational", "ate"), ("fulness", "ful"), ("ousness", "ous"), ("iveness", "ive"), ("tional", "tion"), ("biliti", "ble"), ("lessli", "less"), ("entli", "ent"), ("ation", "ate"), ("alism", "al"), ("aliti", "al"), ("ousli", "ous"), ("iviti", "ive"), ("fulli", "ful"), ("enci", "ence"), ("anci", "ance"), ("abli", "able"), ("izer", "ize"), ("ator", "ate"), ("alli", "al"), ("bli", "ble"), ("ogi", "og"), ("li", ""))
_STEP3 = (("ational", "ate"), ("tional", "tion"), ("alize", "al"), ("icate", "ic"), ("iciti", "ic"), ("ative", ""), ("ical", "ic"), ("ness", ""), ("ful", ""))
_STEP4 = ("ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion", "al", "er", "ic")
_VOWEL = "aeiouy"


def _region(word: str, start: int) -> int:
    """Where the part after the first non-vowel that follows a vowel begins, from ``start`` on."""
    m = re.compile(f"[{_VOWEL}][^{_VOWEL}]").search(word, start)
    return m.end() if m else len(word)


def _short_end(word: str) -> bool:
    return bool(re.search(f"[^{_VOWEL}][{_VOWEL}][^{_VOWEL}wxY]$|^[{_VOWEL}][^{_VOWEL}]$", word))


def english(word: str) -> str:
    if len(word) < 3:
        return word
    if word in _EXCEPTIONS:
        return _EXCEPTIONS[word]
    if word in _INVARIANT:
        return word
    word = re.sub(f"(?<=[{_VOWEL}])y|^y", "Y", word)
    prefix = re.match("gener|commun|arsen", word)
    r1 = prefix.end() if prefix else _region(word, 0)
    r2 = _region(word, r1)
    # 1a
    if word.endswith("sses"):
        word = word[:-2]
    elif word.endswith(("ied", "ies")):
        word = word[:-2] if len(word) > 4 else word[:-1]
    elif word.endswith("s") and not word.endswith(("us", "ss")) and re.search(f"[{_VOWEL}].", word[:-1]):
        word = word[:-1]
    if word in _AFTER_1A:
        return word
    # 1b
    if word.endswith(("eedly", "eed")):
        cut = 5 if word.endswith("ly") else 3
        if len(word) - cut >= r1:
            word = word[:-cut] + "ee"
    else:
        m = re.search("(?:ingly|edly|ing|ed)$", word)
        if m and re.search(f"[{_VOWEL}]", word[: m.start()]):
            word = word[: m.start()]
            if word.endswith(("at", "bl", "iz")):
                word += "e"
            elif re.search(r"(?:bb|dd|ff|gg|mm|nn|pp|rr|tt)$", word):
                word = word[:-1]
            elif _short_end(word) and r1 >= len(word):
                word += "e"
    # 1c
    if len(word) > 2 and word[-1] in "yY" and word[-2] not in _VOWEL:
        word = word[:-1] + "i"
    for end, new in _STEP2:
        if word.endswith(end):
            if len(word) - len(end) >= r1 and not (end == "ogi" and not word.endswith("logi")) and not (end == "li" and word[-3:-2] not in tuple("cdeghkmnrt")):
                word = word[: len(word) - len(end)] + new
            break
    for end, new in _STEP3:
        if word.endswith(end):
            if len(word) - len(end) >= (r2 if end == "ative" else r1):
                word = word[: len(word) - len(end)] + new
            break
    for end in _STEP4:
        if word.endswith(end):
            if len(word) - len(end) >= r2 and not (end == "ion" and word[-4:-3] not in ("s", "t")):
                word = word[: len(word) - len(end)]
            break
    if word.endswith("e"):
        if len(word) - 1 >= r2 or (len(word) - 1 >= r1 and not _short_end(word[:-1])):
            word = word[:-1]
    elif word.endswith("ll") and len(word) - 1 >= r2:
        word = word[:-1]
    return word.replace("Y", "y")


# -- Russian -------------------------------------------------------------------------------------

_RV = "аеиоуыэюя"
# Endings of the published algorithm, the first group of each after а or я.
_GERUND = (("вшись", "вши", "в"), ("ившись", "ывшись", "ивши", "ывши", "ив", "ыв"))
_ADJECTIVE = ("ими", "ыми", "его", "ого", "ему", "ому", "ее", "ие", "ые", "ое", "ей", "ий", "ый", "ой", "ем", "им", "ым", "ом", "их", "ых", "ую", "юю", "ая", "яя", "ою", "ею")
_PARTICIPLE = (("ем", "нн", "вш", "ющ", "щ"), ("ивш", "ывш", "ующ"))
_REFLEXIVE = ("ся", "сь")
_VERB = (("ете", "йте", "ешь", "нно", "ла", "на", "ли", "ем", "ло", "но", "ет", "ют", "ны", "ть", "й", "л", "н"), ("ейте", "уйте", "ила", "ыла", "ена", "ите", "или", "ыли", "ило", "ыло", "ено", "ует", "уют", "ены", "ить", "ыть", "ишь", "ей", "уй", "ил", "ыл", "им", "ым", "ен", "ят", "ит", "ыт", "ую", "ю"))
_NOUN = ("иями", "ями", "ами", "иях", "иям", "ием", "ией", "ев", "ов", "ие", "ье", "еи", "ии", "ей", "ой", "ий", "ям", "ем", "ам", "ом", "ах", "ях", "ию", "ью", "ия", "ья", "а", "е", "и", "й", "о", "у", "ы", "ь", "ю", "я")


def _cut(tail: str, endings: tuple[str, ...]) -> str | None:
    found = max((e for e in endings if tail.endswith(e)), key=len, default=None)
    return None if found is None else tail[: len(tail) - len(found)]


def _cut_grouped(tail: str, groups: tuple[tuple[str, ...], tuple[str, ...]]) -> str | None:
    """The longest ending of either group; one of the first group needs а or я before it, which stays."""
    best = max((e for g in groups for e in g if tail.endswith(e)), key=len, default=None)
    while best is not None:
        rest = tail[: len(tail) - len(best)]
        if best in groups[1] or rest.endswith(("а", "я")):
            return rest
        best = max((e for g in groups for e in g if tail.endswith(e) and len(e) < len(best)), key=len, default=None)
    return None


def russian(word: str) -> str:
    word = word.replace("ё", "е")
    m = re.search(f"[{_RV}]", word)
    if not m:
        return word
    rv = m.end()
    r = re.compile(f"[{_RV}][^{_RV}]")
    first = r.search(word)
    second = r.search(word, first.end()) if first else None
    r2 = second.end() if second else len(word)
    head, tail = word[:rv], word[rv:]
    got = _cut_grouped(tail, _GERUND)
    if got is not None:
        tail = got
    else:
        got = _cut(tail, _REFLEXIVE)
        tail = got if got is not None else tail
        got = _cut(tail, _ADJECTIVE)
        if got is not None:
            part = _cut_grouped(got, _PARTICIPLE)
            tail = part if part is not None else got
        else:
            got = _cut_grouped(tail, _VERB)
            if got is None:
                got = _cut(tail, _NOUN)
            tail = got if got is not None else tail
    if tail.endswith("и"):
        tail = tail[:-1]
    word = head + tail
    for end in ("ость", "ост"):
        if word.endswith(end) and len(word) - len(end) >= max(r2, rv):
            word = word[: -len(end)]
            break
    if word.endswith("нн") and len(word) > rv + 1:
        return word[:-1]
    for end in ("ейше", "ейш"):
        if word.endswith(end) and len(word) - len(end) >= rv:
            word = word[: -len(end)]
            return word[:-1] if word.endswith("нн") else word
    return word[:-1] if word.endswith("ь") and len(word) > rv else word


@lru_cache(maxsize=200_000)
def stem(term: str) -> str:
    if re.search("[Ѐ-ӿ]", term):
        return russian(term)
    return english(term) if re.search("[a-z]", term) else term


def stem_terms(terms: pa.Array) -> pa.Array:
    coded = terms.dictionary_encode()
    return pa.array([stem(t) for t in coded.dictionary.to_pylist()], pa.string()).take(coded.indices)
