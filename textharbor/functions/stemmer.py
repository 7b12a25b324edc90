"""Porter's stemming algorithm, as regular expressions over the pattern of vowels and consonants."""

from __future__ import annotations

import re



def _shape(stem: str) -> str:
    """``v`` for vowels and ``c`` for consonants; y is a vowel after a consonant."""
    out = ""
    for ch in stem:
        out += "v" if ch in "aeiou" or (ch == "y" and out[-1:] == "c") else "c"
    return out


def _measure(stem: str) -> int:
    return len(re.findall("v+c+", _shape(stem)))


def _short(stem: str) -> bool:
    """Ends consonant, vowel, consonant, the last not w, x or y."""
    return _shape(stem).endswith("cvc") and stem[-1] not in "wxy"


def _double(stem: str) -> bool:
    return len(stem) > 1 and stem[-1] == stem[-2] and _shape(stem)[-1] == "c"


def _replace(word: str, rules: dict[str, str], least: int) -> str:
    """Replace the longest matching suffix where the rest measures more than ``least``."""
    for size in range(min(len(word), 7), 0, -1):
        if (suffix := word[-size:]) in rules:
            stem = word[:-size]
            return stem + rules[suffix] if _measure(stem) > least else word
    return word


# The suffixes of steps 2, 3 and 4 of the published algorithm.
STEP2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "bli": "ble", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous",
    "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble", "logi": "log",
}
STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP4 = {s: "" for s in ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "sion", "tion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")}


def porter(word: str) -> str:
    """Stem of a lower-case word; words under three letters or beyond ASCII stay as they are."""
    if len(word) < 3 or not word.isascii():
        return word
    # 1a: plurals
    word = re.sub("(ss|i)es$", r"\1", word) if re.search("(ss|i)es$", word) else re.sub("(?<!s)s$", "", word)
    # 1b: past and progressive forms
    if word.endswith("eed"):
        word = word[:-1] if _measure(word[:-3]) > 0 else word
    elif (m := re.fullmatch("(.*)(ed|ing)", word)) and "v" in _shape(m[1]):
        word = m[1]
        if word.endswith(("at", "bl", "iz")):
            word += "e"
        elif _double(word) and word[-1] not in "lsz":
            word = word[:-1]
        elif _measure(word) == 1 and _short(word):
            word += "e"
    # 1c: final y
    if word.endswith("y") and "v" in _shape(word[:-1]):
        word = word[:-1] + "i"
    word = _replace(_replace(word, STEP2, 0), STEP3, 0)
    # 4: the longest suffix decides, even if it must stay
    for size in range(min(len(word), 5), 1, -1):
        if (suffix := word[-size:]) in STEP4:
            stem = word[:-size] + (suffix[0] if suffix in ("sion", "tion") else "")
            if _measure(stem) > 1:
                word = stem
            break
    # 5: final e and double l
    if word.endswith("e"):
        m = _measure(word[:-1])
        if m > 1 or (m == 1 and not _short(word[:-1])):
            word = word[:-1]
    if word.endswith("ll") and _measure(word[:-1]) > 1:
        word = word[:-1]
    return word


def stem(word: str, kind: str) -> str:
    return porter(word) if kind == "porter" else word
