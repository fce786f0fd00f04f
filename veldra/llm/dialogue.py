"""Words of damaged subtitle dialogue, brought to forms that damage doesn't change."""

from __future__ import annotations

import html
import re
import unicodedata
from functools import lru_cache

import numpy as np

#: Markup and bracketed sounds of any length; a bracket ends within its cue, at the latest before the next time.
_MARKUP = re.compile(r"<[^<>\n]*>|\{[^{}\n]*\}|\[(?:[^\[\]-]|-(?!->))*+\]")
_LINE_ENDS = re.compile(r"\r\n?|[  \x85\x0b\x0c]")
_INVISIBLE = re.compile("[­​-‏‪-‮⁠﻿\x00-\x08\x0e-\x1f]")
_CP1252 = {chr(b): b for b in range(128, 256)} | {bytes([b]).decode("cp1252"): b for b in range(128, 160) if b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D)}
_TAIL = "[" + "".join(re.escape(c) for c, b in _CP1252.items() if b < 0xC0) + "]"
_TWICE = re.compile(f"[Â-ß]{_TAIL}|[à-ï]{_TAIL}{{2}}")
_CYRILLIC = re.compile("[\u0400-\u045f]")
_VOWELS = re.compile("[аеиоуыэюя]")

#: Letters that decomposition doesn't reduce to plain ones.
_FOLD = str.maketrans({"ł": "l", "ß": "ss", "ø": "o", "æ": "ae", "œ": "oe", "đ": "d", "ð": "d", "þ": "th", "ı": "i"})
_UMLAUT = str.maketrans({"ä": "ae", "ö": "oe", "ü": "ue", "ß": "ss"})
#: Characters that optical reading confuses, each with a common form of its class.
_READING = str.maketrans({"w": "vv", "m": "rn", "d": "ci", "h": "ii", "e": "c", "l": "i", "1": "i", "|": "i", "0": "o", "5": "s", "8": "b", "6": "b", "7": "t", "f": "t", "9": "g", "q": "g", "2": "z"})
_ASCII = {i: None for i in range(128) if not (chr(i).isalnum() or chr(i) == "|")} | {k: v for k, v in _READING.items()}
_ANY = re.compile("[a-zA-Z]")
#: The same for words in Cyrillic letters, with the Latin letters of the same look.
_READING_CYRILLIC = str.maketrans({"0": "о", "3": "з", "6": "б", "4": "ч", "c": "с", "е": "с", "e": "с", "o": "о", "a": "а", "p": "р", "x": "х", "y": "у", "k": "к", "m": "м", "t": "т", "h": "н", "b": "в", "n": "п", "и": "п", "u": "п", "ш": "щ", "ь": "ъ"})


def repair(text: str) -> str:
    """Undo UTF-8 read as a Western code page (once or twice), Windows Cyrillic read as Latin, and KOI8 read as Windows Cyrillic."""
    if "&" in text:
        text = html.unescape(text)
    if text.isascii():
        return text
    for _ in range(2):
        fixed = _TWICE.sub(_decode, text)
        if fixed == text:
            break
        text = fixed
    units = np.frombuffer(text.encode("utf-16-le", "replace"), np.uint16)
    other = units[units > 127]
    high = np.count_nonzero(((other >= 0xC0) & (other < 0x100)) | (other == 0xA8) | (other == 0xB8))
    if high > 10 and high > 0.8 * np.count_nonzero((units | 32) - 97 < 26):
        text = text.encode("latin-1", "replace").decode("cp1251", "replace")
        high = 0
    cyrillic = np.count_nonzero((other >= 0x400) & (other < 0x460))
    if cyrillic > 10:
        turned = text.encode("cp1251", "replace").decode("koi8-r", "replace")
        if len(_VOWELS.findall(text.lower())) < 0.28 * cyrillic < len(_VOWELS.findall(turned.lower())):
            text = turned
    return text


def _decode(m: re.Match) -> str:
    try:
        return bytes(_CP1252[c] for c in m[0]).decode("utf-8")
    except (UnicodeDecodeError, KeyError):
        return m[0]


def tokens(text: str | None) -> list[str]:
    """The dialogue between white space: without cue numbers, times, markup and bracketed sounds.

    A line that only repeats the one before it, as rolling captions do, counts once.
    """
    if not text:
        return []
    text = repair(text)
    if not text.isascii():
        text = _INVISIBLE.sub("", text)
        text = _LINE_ENDS.sub("\n", text)
    elif "\r" in text:
        text = text.replace("\r", "\n")
    if "<" in text or "[" in text or "{" in text:
        text = _MARKUP.sub(" ", text)
    out: list[str] = []
    before: list[str] = []
    for line in text.split("\n"):
        if "-->" in line:
            continue
        words = line.split()
        if words and not (len(words) == 1 and words[0].isdigit()):
            if words != before:
                out += words
            before = words
    return out


def _letters(word: str) -> str:
    return "".join(c for c in word if c.isalnum() or c == "|")


def _skeleton(word: str) -> str:
    if _CYRILLIC.search(word):
        return word.translate(_READING_CYRILLIC)
    word = "".join(c for c in word if c.isascii() and (c.isalnum() or c in "|"))
    return word.translate(_READING)


@lru_cache(maxsize=1 << 16)
def skeletons(token: str) -> tuple[str, ...]:
    """The forms by which a word is known: accents folded, lost, or written out. None for numbers and signs."""
    if token.isascii():
        return (token.lower().translate(_ASCII),) if _ANY.search(token) else ()
    word = unicodedata.normalize("NFC", token.lower())
    if not any(c.isalpha() for c in word):
        return ()
    plain = "".join(c for c in unicodedata.normalize("NFD", word.translate(_FOLD)) if not unicodedata.combining(c))
    found = {_skeleton(_letters(plain))}
    if not word.isascii():
        found |= {_skeleton(_letters(word.translate(_UMLAUT))), _skeleton(_letters(word))}
    return tuple(sorted(f for f in found if f))


def close(a: str, b: str) -> bool:
    """Whether two skeletons differ by about one misread character in four at most."""
    most = max(1, max(len(a), len(b)) // 5)
    if abs(len(a) - len(b)) > most:
        return False
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1] <= most
