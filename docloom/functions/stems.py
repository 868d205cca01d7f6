"""Languages of full-text search: the public Snowball stemmers for English and German, and their stop words.

Words are lower-case runs of letters and digits. A stemmer sees one word; callers stem each distinct word once.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field
from itertools import product

# --- English ---

# Fixed values of the public English stemmer (Porter2).
_DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
_WHOLE = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl",
    "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
_DONE_EARLY = {"inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"}
_STEP2 = {
    "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al", "alli": "al",
    "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "ogi": "og", "fulli": "ful", "lessli": "less", "li": "",
}
_STEP3 = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": "", "ative": ""}
_STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion")

_AFTER_VOWEL = re.compile(r"[aeiouy][^aeiouy]")
_SHORT_END = re.compile(r"(?:[^aeiouy][aeiouy][^aeiouywxY]|^[aeiouy][^aeiouy])$")


def _longest(word: str, endings) -> str:
    return max((e for e in endings if word.endswith(e)), key=len, default="")


def _regions(word: str, after: re.Pattern) -> tuple[int, int]:
    """Where the first and the second region begin."""
    one = after.search(word)
    first = one.end() if one else len(word)
    two = after.search(word, first)
    return first, two.end() if two else len(word)


def english(word: str) -> str:
    if len(word) < 3 or word in _WHOLE:
        return _WHOLE.get(word, word)
    w = re.sub(r"([aeiouy])y", r"\1Y", re.sub("^y", "Y", word))
    r1, r2 = _regions(w, _AFTER_VOWEL)
    if head := re.match("gener|commun|arsen", w):
        r1 = head.end()
        two = _AFTER_VOWEL.search(w, r1)
        r2 = two.end() if two else len(w)
    w = _plural(w)
    if w in _DONE_EARLY:
        return w.replace("Y", "y")
    w = _past(w, r1)
    if w[-1] in "yY" and len(w) > 2 and w[-2] not in "aeiouy":
        w = w[:-1] + "i"
    end = _longest(w, _STEP2)
    at = len(w) - len(end)
    if end and at >= r1 and (end != "ogi" or w[at - 1 : at] == "l") and (end != "li" or w[at - 1 : at] in tuple("cdeghkmnrt")):
        w = w[:at] + _STEP2[end]
    end = _longest(w, _STEP3)
    at = len(w) - len(end)
    if end and at >= (r2 if end == "ative" else r1):
        w = w[:at] + _STEP3[end]
    end = _longest(w, _STEP4)
    at = len(w) - len(end)
    if end and at >= r2 and (end != "ion" or w[at - 1 : at] in ("s", "t")):
        w = w[:at]
    if w.endswith("e"):
        if len(w) - 1 >= r2 or len(w) - 1 >= r1 and not _SHORT_END.search(w[:-1]):
            w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.replace("Y", "y")


def _plural(w: str) -> str:
    if w.endswith("sses"):
        return w[:-2]
    if w.endswith(("ied", "ies")):
        return w[:-2] if len(w) > 4 else w[:-1]
    if w.endswith("s") and not w.endswith(("us", "ss")) and re.search("[aeiouy]", w[:-2]):
        return w[:-1]
    return w


def _past(w: str, r1: int) -> str:
    end = _longest(w, ("eed", "eedly", "ed", "edly", "ing", "ingly"))
    base = w[: len(w) - len(end)]
    if end in ("eed", "eedly"):
        return base + "ee" if len(base) >= r1 else w
    if not end or not re.search("[aeiouy]", base):
        return w
    if base.endswith(("at", "bl", "iz")):
        return base + "e"
    if base.endswith(_DOUBLES):
        return base[:-1]
    return base + "e" if len(base) <= r1 and _SHORT_END.search(base) else base


# --- German ---

_GERMAN_AFTER = re.compile("[aeiouyäöü][^aeiouyäöü]")


def german(word: str) -> str:
    w = word.replace("ß", "ss")
    w = re.sub("([aeiouyäöü])([uy])([aeiouyäöü])", lambda m: m[1] + m[2].upper() + m[3], w)
    r1, r2 = _regions(w, _GERMAN_AFTER)
    r1 = max(r1, 3)
    end = _longest(w, ("em", "ern", "er", "e", "en", "es", "s"))
    at = len(w) - len(end)
    if end and at >= r1 and (end != "s" or w[at - 1 : at] in tuple("bdfghklmnrt")):
        w = w[:at]
        if end in ("e", "en", "es") and w.endswith("niss"):
            w = w[:-1]
    end = _longest(w, ("en", "er", "est", "st"))
    at = len(w) - len(end)
    if end and at >= r1 and (end != "st" or at >= 4 and w[at - 1] in "bdfghklmnt"):
        w = w[:at]
    w = _german_derived(w, r1, r2)
    return w.lower().translate(str.maketrans("äöü", "aou"))


def _german_derived(w: str, r1: int, r2: int) -> str:
    end = _longest(w, ("end", "ung", "ig", "ik", "isch", "lich", "heit", "keit"))
    base = w[: len(w) - len(end)]
    if not end or len(base) < r2 or end in ("ig", "ik", "isch") and base.endswith("e"):
        return w
    cut = {"end": ("ig",), "ung": ("ig",), "lich": ("er", "en"), "heit": ("er", "en"), "keit": ("lich", "ig")}.get(end, ())
    more = _longest(base, cut)
    at = len(base) - len(more)
    if more and at >= (r1 if end in ("lich", "heit") else r2) and not (end in ("end", "ung") and base[:at].endswith("e")):
        return base[:at]
    return base


# --- stop words and languages ---

# The stop words of the usual database configuration for English.
ENGLISH_STOPS = (
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them their theirs themselves what which who whom this that these those am is are was were be been being"
    " have has had having do does did doing a an the and but if or because as until while of at by for with about against between into through during before after above below to from up down in out on off over under again further then once"
    " here there when where why how all any both each few more most other some such no nor not only own same so than too very s t can will just don should now"
)


def _german_stops() -> set[str]:
    """German function words: inflected pronouns and articles from stem and ending, the rest plain."""
    forms = {a + b for a, b in product(("dies", "jed", "jen", "manch", "solch", "welch", "ander", "all", "derselb", "dasselb", "desselb"), ("e", "em", "en", "er", "es"))}
    forms |= {a + b for a, b in product(("ein", "kein", "mein", "dein", "sein", "ihr", "unser", "euer", "eur", "unsr"), ("", "e", "em", "en", "er", "es"))}
    plain = (
        "der die das den dem des ich mich mir du dich dir er ihn ihm sie es wir uns euch ihnen man sich selbst wer was und oder aber auch als also an am auf aus bei bis da dann dass daß doch dort durch für gegen hier hin hinter im in ins ist"
        " bin bist sind war warst waren hab habe haben hat hatte hatten werde werden wird wurde wurden kann können könnte muss musste soll sollte will wollte würde würden indem jetzt mit nach nicht nichts noch nun nur ob ohne sehr sondern"
        " so sonst über um unter vom von vor während weg weil weiter wenn wie wieder wo zu zum zur zwar zwischen damit einmal viel"
    )
    return forms | set(plain.split())


@dataclass(frozen=True)
class Language:
    stem: Callable[[str], str] | None = None
    stops: frozenset[str] = field(default_factory=frozenset)


LANGUAGES = {"simple": Language(), "english": Language(english, frozenset(ENGLISH_STOPS.split())), "german": Language(german, frozenset(_german_stops()))}
DEFAULT = "english"


def resolve_language(asked: str | None = None, configured: str | None = None) -> str:
    """Asked, else configured, else English."""
    name = next((x.strip().lower() for x in (asked, configured) if x and x.strip()), DEFAULT)
    if name not in LANGUAGES:
        raise ValueError(f"no such language: {name}")
    return name
