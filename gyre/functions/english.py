"""English lexemes: the stemmer of the public Porter2 definition, as rules over endings, and stop words."""

from __future__ import annotations

import re
from functools import lru_cache

# The stop words of the public Snowball list.
STOP_WORDS = frozenset(
    """i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself
    it its itself they them their theirs themselves what which who whom this that these those am is are was were be been
    being have has had having do does did doing a an the and but if or because as until while of at by for with about
    against between into through during before after above below to from up down in out on off over under again further
    then once here there when where why how all any both each few more most other some such no nor not only own same so
    than too very s t can will just don should now""".split()
)

# The words and endings of the Porter2 definition.
WHOLE = dict(zip("skis skies dying lying tying idly gently ugly early only singly".split(), "ski sky die lie tie idl gentl ugli earli onli singl".split(), strict=True)) | {w: w for w in "sky news howe atlas cosmos bias andes".split()}
UNTOUCHED = frozenset("inning outing canning herring earring proceed exceed succeed".split())
LONG_STARTS = "gener|commun|arsen"
STEP_2 = {
    "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al", "alli": "al",
    "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "ogi": "og", "fulli": "ful", "lessli": "less", "li": "",
}
STEP_3 = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": "", "ative": ""}
STEP_4 = {e: "" for e in "al ance ence er ic able ible ant ement ment ent ism ate iti ous ive ize ion".split()}
#: What must stand before an ending for it to change.
BEFORE = {"ogi": "l$", "li": "[cdeghkmnrt]$", "ion": "[st]$"}

_REGION = re.compile("[aeiouy][^aeiouy]")
_SHORT = re.compile("(?:^[aeiouy][^aeiouy]|[^aeiouy][aeiouy][^aeiouywxY])$")
_DOUBLE = re.compile("(?:bb|dd|ff|gg|mm|nn|pp|rr|tt)$")


def _after(word: str, start: int) -> int:
    """Where the region behind the first non-vowel that follows a vowel starts."""
    found = _REGION.search(word, start)
    return found.end() if found else len(word)


def _exchanged(word: str, endings: dict[str, str], region: int, inner: int = 0) -> str:
    """The longest of the endings exchanged, if it lies in the region; `ative` must lie in the inner one."""
    ending = max((e for e in endings if word.endswith(e)), key=len, default=None)
    if ending is None:
        return word
    stem = word[: -len(ending)]
    start = inner if ending == "ative" else region
    if len(stem) < start or not re.search(BEFORE.get(ending, ""), stem):
        return word
    return stem + endings[ending]


@lru_cache(200_000)
def stem(word: str) -> str:
    """The stem of a lower-case word without apostrophes."""
    if len(word) <= 2:
        return word
    if word in WHOLE:
        return WHOLE[word]
    # a y that begins a word or follows a vowel is a consonant
    word = re.sub("([aeiouy])y", r"\1Y", re.sub("^y", "Y", word))
    start = re.match(LONG_STARTS, word)
    r1 = start.end() if start else _after(word, 0)
    r2 = _after(word, r1)
    # plurals
    if word.endswith("sses"):
        word = word[:-2]
    elif word.endswith(("ied", "ies")):
        word = word[:-2] if len(word) > 4 else word[:-1]
    elif word.endswith("s") and not word.endswith(("us", "ss")) and re.search("[aeiouy]", word[:-2]):
        word = word[:-1]
    if word in UNTOUCHED:
        return word
    # past and present participles
    ending = re.search("(?:eedly|eed|ingly|edly|ing|ed)$", word)
    if ending and ending[0].startswith("ee"):
        if ending.start() >= r1:
            word = word[: ending.start()] + "ee"
    elif ending and re.search("[aeiouy]", word[: ending.start()]):
        word = word[: ending.start()]
        if word.endswith(("at", "bl", "iz")):
            word += "e"
        elif _DOUBLE.search(word):
            word = word[:-1]
        elif len(word) <= r1 and _SHORT.search(word):
            word += "e"
    if re.search("[^aeiouy][yY]$", word) and len(word) > 2:
        word = word[:-1] + "i"
    word = _exchanged(word, STEP_2, r1)
    word = _exchanged(word, STEP_3, r1, r2)
    word = _exchanged(word, STEP_4, r2)
    if word.endswith("e") and (len(word) > r2 or (len(word) > r1 and not _SHORT.search(word[:-1]))):
        word = word[:-1]
    elif word.endswith("ll") and len(word) > r2:
        word = word[:-1]
    return word.lower()


def lexeme(word: str) -> str | None:
    """A lower-case word's lexeme; None for a stop word."""
    return None if word in STOP_WORDS else stem(word)
