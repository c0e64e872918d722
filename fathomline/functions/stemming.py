"""English word stems by the published Porter2 rules, and the analyzers of the text search."""

from __future__ import annotations

import re
from collections.abc import Iterator, Set
from functools import lru_cache
from itertools import count
from typing import Protocol

#: Words that carry no meaning for search; they still take up a position.
STOP_WORDS = frozenset(
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them their theirs "
    "themselves what which who whom this that these those am is are was were be been being have has had having do does did doing a an the and but if or "
    "because as until while of at by for with about against between into through during before after above below to from up down in out on off over under "
    "again further then once here there when where why how all any both each few more most other some such no nor not only own same so than too very s t "
    "can will just don should now".split()
)
#: Fixed values of the published rules: words with stems of their own, and words that stay after step 1a.
_SPECIAL = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"} | {w: w for w in "sky news howe atlas cosmos bias andes".split()}
_STAYS = frozenset("inning outing canning herring earring proceed exceed succeed".split())
_STEP_2 = {"ization": "ize", "ational": "ate", "fulness": "ful", "ousness": "ous", "iveness": "ive", "tional": "tion", "biliti": "ble", "lessli": "less", "entli": "ent", "ation": "ate", "alism": "al", "aliti": "al", "ousli": "ous", "iviti": "ive", "fulli": "ful", "enci": "ence", "anci": "ance", "abli": "able", "izer": "ize", "ator": "ate", "alli": "al", "bli": "ble"}
_STEP_3 = {"ational": "ate", "tional": "tion", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
_STEP_4 = ("ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "al", "er", "ic")
_VOWELS = "aeiouy"


def _after_vowel_consonant(word: str, start: int) -> int:
    m = re.compile("[aeiouy][^aeiouy]").search(word, start)
    return m.end() if m else len(word)


def _short_syllable(word: str) -> bool:
    return bool(re.search("[^aeiouy][aeiouy][^aeiouywxY]$|^[aeiouy][^aeiouy]$", word))


def _longest(word: str, endings) -> str | None:
    return max((e for e in endings if word.endswith(e)), key=len, default=None)


@lru_cache(maxsize=200_000)
def stem(word: str) -> str:
    """The stem of a lower-case word."""
    if len(word) <= 2:
        return word
    if word in _SPECIAL:
        return _SPECIAL[word]
    word = word.removeprefix("'")
    word = re.sub("^y|(?<=[aeiouy])y", "Y", word)
    r1 = next((len(p) for p in ("gener", "commun", "arsen") if word.startswith(p)), None)
    r1 = _after_vowel_consonant(word, 0) if r1 is None else r1
    r2 = _after_vowel_consonant(word, r1)
    for ending in ("'s'", "'s", "'"):
        if word.endswith(ending):
            word = word[: -len(ending)]
            break
    # 1a: plurals
    if word.endswith("sses"):
        word = word[:-2]
    elif word.endswith(("ied", "ies")):
        word = word[:-2] if len(word) > 4 else word[:-1]
    elif word.endswith("s") and not word.endswith(("us", "ss")) and re.search("[aeiouy]", word[:-2]):
        word = word[:-1]
    if word in _STAYS:
        return word
    # 1b: past and progressive forms
    ending = _longest(word, ("eed", "eedly", "ed", "edly", "ing", "ingly"))
    if ending in ("eed", "eedly"):
        if len(word) - len(ending) >= r1:
            word = word[: -len(ending)] + "ee"
    elif ending and re.search("[aeiouy]", word[: -len(ending)]):
        word = word[: -len(ending)]
        if word.endswith(("at", "bl", "iz")):
            word += "e"
        elif re.search(r"(bb|dd|ff|gg|mm|nn|pp|rr|tt)$", word):
            word = word[:-1]
        elif len(word) <= r1 and _short_syllable(word):
            word += "e"
    # 1c
    if len(word) > 2 and word[-1] in "yY" and word[-2] not in _VOWELS:
        word = word[:-1] + "i"
    # 2
    ending = _longest(word, (*_STEP_2, "ogi", "li"))
    if ending and len(word) - len(ending) >= r1:
        before = word[: -len(ending)]
        if ending in _STEP_2:
            word = before + _STEP_2[ending]
        elif ending == "ogi" and before.endswith("l"):
            word = before + "og"
        elif ending == "li" and before[-1:] in tuple("cdeghkmnrt"):
            word = before
    # 3
    ending = _longest(word, (*_STEP_3, "ative"))
    if ending and len(word) - len(ending) >= r1:
        before = word[: -len(ending)]
        if ending == "ative":
            word = before if len(before) >= r2 else word
        else:
            word = before + _STEP_3[ending]
    # 4
    ending = _longest(word, (*_STEP_4, "ion"))
    if ending and len(word) - len(ending) >= r2 and (ending != "ion" or word[: -len(ending)].endswith(("s", "t"))):
        word = word[: -len(ending)]
    # 5
    if word.endswith("e") and (len(word) - 1 >= r2 or len(word) - 1 >= r1 and not _short_syllable(word[:-1])) or word.endswith("ll") and len(word) - 1 >= r2:
        word = word[:-1]
    return word.replace("Y", "y")


class Analyzer(Protocol):
    """Turns a text into (lexeme, position) pairs; positions count from 1."""

    def __call__(self, text: str) -> Iterator[tuple[str, int]]: ...


_WORD = re.compile(r"[^\W_]+(?:'[^\W_]+)?")
_SIMPLE = re.compile("[a-z0-9]+")


def simple(text: str) -> Iterator[tuple[str, int]]:
    """Lower-cased runs of ASCII letters and digits."""
    return zip(_SIMPLE.findall(text.lower()), count(1))


def english(text: str) -> Iterator[tuple[str, int]]:
    """Stems of words that aren't stop words; stop words take up their position."""
    for k, m in enumerate(_WORD.finditer(text.lower()), 1):
        if m.group() not in STOP_WORDS:
            yield stem(m.group()), k


ANALYZERS: dict[str, Analyzer] = {"simple": simple, "english": english}


def lexemes(text: str, analyzer: str = "english", only: Set[str] | None = None) -> dict[str, list[int]]:
    """Positions by lexeme; positions beyond 16,383 count as that, and a lexeme keeps 256 (fixed limits of the format).

    ``only`` names the lexemes that are wanted, where not all are.
    """
    found: dict[str, list[int]] = {}
    for lexeme, at in ANALYZERS[analyzer](text):
        if only is not None and lexeme not in only:
            continue
        if at > 16_383:
            at = 16_383
        places = found.get(lexeme)
        if places is None:
            found[lexeme] = [at]
        elif len(places) < 256 and places[-1] != at:
            places.append(at)
    return found


def query_lexemes(text: str, analyzer: str = "english") -> list[str]:
    """Distinct lexemes of a query, in order of appearance; all must occur in a match."""
    return list(dict.fromkeys(lexeme for lexeme, _ in ANALYZERS[analyzer](text)))
