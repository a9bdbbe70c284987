"""One form for text that looks alike (problem 2): a confusables skeleton.

Skeleton of a text: decompose, replace every character by its prototype, decompose
again. Originals with equal skeletons look alike. The readable form keeps letters of
other scripts in words wholly of that script.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

#: Letters of other scripts that look like a Latin letter.
CYRILLIC = dict(zip("аеорсухіјѕԁһӏѵԛԝАВЕКМНОРСТУХІЈЅԌԚԜҮкгпьЬӀѴүҺ", "aeopcyxijsdhlvqwABEKMHOPCTYXIJSGQWYkrnbblVyh"))
GREEK = dict(zip("οανιρυκχγτωηΑΒΕΖΗΙΚΜΝΟΡΤΥΧϲϳσϱϹͿ", "oavipukxytwnABEZHIKMNOPTYXcjopCJ"))
ARMENIAN = dict(zip("օոսհցզՕՍՏԼ", "onuhgqOUSL"))
CHEROKEE = dict(zip("ᎠᎡᎢᎪᎫᎬᎳᎷᎻᎽᏀᏃᏔᏙᏚᏟᏢᏦᏞᏴ", "DRTAJEWMHYGZWVSCPKLB"))
LOOKALIKE = CYRILLIC | GREEK | ARMENIAN | CHEROKEE
#: Those that differ enough in print to be a sign of garbling too (problem 1).
WEAK = set("γτωηκυχ" "кгпьЬӀѴүҺσϱϹͿ") | set(ARMENIAN) | set(CHEROKEE)
#: With the composed letters whose first part is one of them.
LISTED = {c for n in (*range(0x370, 0x590), *range(0x13A0, 0x13F6), *range(0x1F00, 0x2000)) if unicodedata.normalize("NFD", c := chr(n))[0] in LOOKALIKE}
INVISIBLE = "\u00ad\u034f\u061c\u115f\u1160\u17b4\u17b5\u180e\u200b\u200c\u200d\u200e\u200f\u202a\u202b\u202c\u202d\u202e\u2060\u2061\u2062\u2063\u2064\u2066\u2067\u2068\u2069\ufeff"
SPACES = "\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"
HYPHENS = "\u2010\u2011⁃\u058a\u1806\ufe63\uff0d"
JOINED = "".join(map(chr, (*range(0xFB00, 0xFB07), 0x132, 0x133, *range(0x1C4, 0x1CD), 0x1F1, 0x1F2, 0x1F3)))
MARKS = "\u0300-\u036f\u1ab0-᫿\u1dc0-\u1dff"

#: What may be a case, in one scan; − only between letters.
SUSPECT = re.compile(f"[{INVISIBLE}{SPACES}{HYPHENS}{JOINED}{MARKS}\uff01-\uff5e\uffe0-\uffe6{''.join(sorted(LISTED))}]|(?<=[^\\W\\d_])\u2212(?=[^\\W\\d_])")
_MARK = re.compile(f"[{MARKS}]")
_WORD = re.compile(r"[^\W\d_]+")
_EMOJI = re.compile("[\u203c-\u3299\U0001f000-\U0001faff\ufe0f\u20e3]")


@lru_cache(maxsize=4096)
def prototype(ch: str) -> str:
    """What stands for a character in a skeleton."""
    if ch in INVISIBLE or ch == "\ufe0f":
        return ""
    if ch in SPACES:
        return " "
    if ch in HYPHENS or ch == "\u2212":
        return "-"
    if ch in LOOKALIKE:
        return LOOKALIKE[ch]
    wide = unicodedata.normalize("NFKD", ch)
    return "".join(LOOKALIKE.get(c, c) for c in wide)


def skeleton(text: str | None) -> str | None:
    """Equal for texts that look alike; null stays null."""
    if text is None or text.isascii():
        return text
    first = unicodedata.normalize("NFD", text)
    return unicodedata.normalize("NFD", "".join(map(prototype, first)))


def differs(text: str | None) -> bool:
    """Whether a text isn't its own skeleton, which ways of setting accents don't show in: those count apart."""
    return bool(text) and not text.isascii() and (skeleton(text) != unicodedata.normalize("NFD", text) or bool(_MARK.search(text)))


def _joins_emoji(text: str, at: int) -> bool:
    return text[at] == "\u200d" and 0 < at < len(text) - 1 and bool(_EMOJI.match(text[at - 1]) and _EMOJI.match(text[at + 1]))


def script(ch: str) -> str:
    """latin, greek, cyrillic or other."""
    n = ord(ch)
    if n < 0x250 or 0x1E00 <= n < 0x1F00:
        return "latin"
    return "greek" if 0x370 <= n < 0x400 or 0x1F00 <= n < 0x2000 else "cyrillic" if 0x400 <= n < 0x530 else "other"


def disguised(word: str) -> bool:
    """Whether a word with Latin letters holds a look-alike letter of another script."""
    return any(c in LISTED for c in word) and any(script(c) == "latin" for c in word)


def kinds(text: str | None) -> set[str]:
    """The kinds of disguise in a text: wide, joined, accent, invisible, space, hyphen, script."""
    found: set[str] = set()
    if not differs(text):
        return found
    letters = False
    for m in SUSPECT.finditer(text):
        ch, at = m[0], m.start()
        if ch in LISTED:
            letters = True
        elif ch in INVISIBLE:
            if not _joins_emoji(text, at):
                found.add("invisible")
        elif ch in SPACES:
            found.add("wide" if ch == "\u3000" else "space")
        elif ch in HYPHENS or ch == "\u2212":
            found.add("hyphen")
        elif ch in JOINED:
            found.add("joined")
        elif ch >= "\uff00":
            found.add("wide")
        elif at and text[at - 1].isalpha() or at and unicodedata.combining(text[at - 1]):
            found.add("accent")
    if letters:
        plain = text.translate(_DROP) if "invisible" in found else text
        if any(disguised(w[0]) for w in _WORD.finditer(unicodedata.normalize("NFC", plain)) if not w[0].isascii()):
            found.add("script")
    return found


def _latin(ch: str) -> str:
    first, *marks = unicodedata.normalize("NFD", ch)
    return unicodedata.normalize("NFC", LOOKALIKE[first] + "".join(marks)) if ch in LISTED else ch


_DROP = {ord(c): None for c in INVISIBLE if c != "\u200d"}


def readable(text: str | None) -> str | None:
    """The one form: composed accents, plain spaces and hyphens, no invisible or wide or joined characters, each word in one script."""
    if text is None or text.isascii() or not SUSPECT.search(text):
        return text if text is None or text.isascii() else unicodedata.normalize("NFC", text)
    out = []
    for at, ch in enumerate(text):
        if ch in INVISIBLE:
            out.append(ch if _joins_emoji(text, at) else "")
        elif ch in SPACES:
            out.append(" ")
        elif ch in HYPHENS or ch == "\u2212" and 0 < at < len(text) - 1 and text[at - 1].isalpha() and text[at + 1].isalpha():
            out.append("-")
        elif ch in JOINED or "\uff01" <= ch <= "\uffe6":
            out.append(unicodedata.normalize("NFKC", ch))
        else:
            out.append(ch)
    whole = unicodedata.normalize("NFC", "".join(out))
    return _WORD.sub(lambda m: "".join(map(_latin, m[0])) if not m[0].isascii() and disguised(m[0]) else m[0], whole)
