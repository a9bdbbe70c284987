"""Text decoded with the wrong encoding (problem 1).

For every character that readers use and every pair (encoding the text was in,
encoding it was read with) the garbled sequence is worked out beforehand. An
Aho-Corasick automaton finds the longest of them in a text; only spans that match,
and whose surroundings bear it out where the sequence could be ordinary text, are
put right.
"""

from __future__ import annotations

import html.entities
import re
import unicodedata
from collections import Counter
from collections.abc import Iterable

import ahocorasick

from marginalia.llm.lookalikes import JOINED, LOOKALIKE, WEAK, script

#: Encodings that UTF-8 is misread with, and pairs of single-byte encodings (written in, read with).
UTF8_READ_AS = ("cp1252", "latin-1", "mac_roman", "cp437", "cp850", "cp1251", "cp1250", "iso8859-15", "koi8-r", "cp1254", "iso8859-9", "cp1257", "cp1253", "iso8859-5", "cp866", "mac_cyrillic")
#: Those whose upper half holds letters of another script.
OTHER_LETTERS = ("cp1251", "koi8-r", "cp1253", "iso8859-5", "cp866", "mac_cyrillic")
BYTE_PAIRS = (("cp1252", "cp1251"), ("cp1252", "mac_roman"), ("cp1252", "cp437"), ("cp1252", "cp850"), ("mac_roman", "cp1252"), ("cp850", "cp1252"))
#: The characters beyond ASCII that readers' texts use.
LETTERS = "ÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÑÒÓÔÕÖØÙÚÛÜÝàáâãäåæçèéêëìíîïñòóôõöøùúûüýÿßœŒ"
PUNCTUATION = "‘’‚“”„–—…«»¿¡"
SYMBOLS = "€™•©®°±²³¹ºª§¶·£¥¢¼½¾×÷¨´¯‹›†‡\u00a0\u00ad\u2212"
EXTENDED = "".join(map(chr, range(0x100, 0x180)))
OTHER_SCRIPTS = "".join(map(chr, (*range(0x391, 0x3CA), *range(0x410, 0x450))))
EMOJI = "".join(map(chr, (*range(0x1F300, 0x1F650), *range(0x1F680, 0x1F700), *range(0x1F900, 0x1FA00), 0x2764, 0x2615, 0x2728)))
CLOSERS = set("\u2019\u201d\u2026\u2014\u2013\u2022\u201c\u2018\u00a0\u00ad?\ufffd")
BACKGROUND = re.compile("[^\x00-\x7f]|&#?[A-Za-z0-9]")
_LOST = re.compile("�")
_CONTRACTION = re.compile(r"(?:t|s|re|ve|ll|m|d)(?![\w�])")


def _latin(c: str) -> bool:
    return c.isalpha() and script(c) == "latin"


def misread(text: str, written: str, read: str, gap: str = "byte") -> str:
    """What `text` turns into; `gap`: how bytes that `read` lacks show: as the byte, as '?' or as U+FFFD."""
    out = []
    for b in text.encode(written):
        try:
            out.append(bytes([b]).decode(read))
        except UnicodeDecodeError:
            out.append({"byte": chr(b), "mark": "?", "lost": "�", "none": ""}[gap])
    return "".join(out)


def _entities(seq: str, only_letters: bool) -> str:
    return "".join(f"&{n};" if (n := html.entities.codepoint2name.get(ord(c))) and ord(c) > 127 and (c.isalpha() or not only_letters) else c for c in seq)


def _numbers(seq: str, form: str) -> str:
    return "".join(form.format(ord(c)) if ord(c) > 127 else c for c in seq)


def table() -> dict[str, tuple[str, str, bool]]:
    """Garbled sequence -> (character, pair of encodings, sure): `sure` ones need no further evidence."""
    out: dict[str, tuple[str, str, bool]] = {}

    def add(seq: str, ch: str, pair: str, sure: bool) -> None:
        if seq.isascii() and "&" not in seq or seq == ch:
            return
        if seq not in out or sure and not out[seq][2]:
            out[seq] = (ch, pair, sure)

    def sure(seq: str) -> bool:
        if len(seq) == 1:
            return False
        if seq[-1] in CLOSERS and len(seq) == 2:
            return False
        rest = [c for c in seq if c.isalpha()]
        return not (len(rest) == len(seq) and len({script(c) for c in rest}) == 1)

    for ch in LETTERS + PUNCTUATION + SYMBOLS + EXTENDED + OTHER_SCRIPTS + EMOJI:
        for read in UTF8_READ_AS:
            for gap in ("byte", "mark", "lost"):
                once = misread(ch, "utf-8", read, gap)
                if ch in OTHER_SCRIPTS and read in OTHER_LETTERS:
                    continue  # pairs of ordinary Cyrillic letters
                add(once, ch, f"utf-8>{read}", sure(once))
                if ch in EMOJI + EXTENDED + OTHER_SCRIPTS:
                    continue
                low = once.lower()
                if low != once and once[0] in "ÃÂ":
                    add(low, ch, f"utf-8>{read} lower", sure(low) and not low.endswith(("\u00a0", "\u00ad")))
                if read in ("cp1252", "latin-1"):
                    for letters in (True, False):
                        if (named := _entities(once, letters)) != once:
                            add(named, ch, f"utf-8>{read} entities", True)
                    for form in ("&#{};", "&#x{:x};", "&#x{:X};"):
                        add(_numbers(once, form), ch, f"utf-8>{read} entities", True)
                    for again in ("cp1252", "latin-1"):
                        for gap2 in ("byte", "mark", "none"):
                            add(misread(once, "utf-8", again, gap2), ch, f"utf-8>{read} twice", True)
                elif gap == "byte":
                    add(misread(once, "utf-8", read, "byte"), ch, f"utf-8>{read} twice", True)
                if once.endswith("\u00a0") and read not in OTHER_LETTERS:  # white space put in order afterwards
                    add(once[:-1] + " ", ch, f"utf-8>{read}", False)
    for c in "â":  # a lost last byte of typographic punctuation
        add(f"{c}€", "", "utf-8>cp1252", True)
        add(f"{c}\x80", "", "utf-8>latin-1", True)
    for written, read in BYTE_PAIRS:
        for ch in LETTERS + PUNCTUATION:
            try:
                seq = ch.encode(written).decode(read)
            except UnicodeError:
                continue
            if seq not in out:
                add(seq, ch, f"{written}>{read}", False)
    return out


class Repairer:
    """`lexicon`: words with letters beyond ASCII, in lower case, that bear out a restored single letter."""

    def __init__(self, lexicon: Iterable[str] = ()):
        self.table = table()
        self.single: dict[str, list[tuple[str, str]]] = {}
        for written, read in BYTE_PAIRS:
            for ch in LETTERS + PUNCTUATION:
                try:
                    seq = ch.encode(written).decode(read)
                except UnicodeError:
                    continue
                if seq != ch and not seq.isascii():
                    self.single.setdefault(seq, []).append((ch, f"{written}>{read}"))
        self.automaton = ahocorasick.Automaton()
        for seq in {*self.table, *self.single}:
            self.automaton.add_word(seq, seq)
        self.automaton.make_automaton()
        words = {unicodedata.normalize("NFC", w.lower()) for w in lexicon}
        self.words = {w for w in words if w.isascii()}
        self.lexicon = words - self.words
        self.shapes: dict[str, set[str]] = {}
        for w in self.lexicon:
            self.shapes.setdefault("".join(c if c.isascii() else "�" for c in w), set()).add(w)

    def _word(self, text: str, at: int) -> tuple[int, int]:
        a = b = at
        while a and (text[a - 1].isalpha() or text[a - 1] in "\u0301\u0300"):
            a -= 1
        while b < len(text) and (text[b].isalpha() or b == at):
            b += 1
        return a, b

    def _single(self, text: str, at: int) -> list[tuple[str, str, bool]]:
        """(character, pair, sure) for a single suspicious character, by what stands around it."""
        s, prev, then = text[at], text[at - 1 : at] if at else "", text[at + 1 : at + 2]
        before, after = _latin(prev), _latin(then)
        a, b = self._word(text, at)
        word = text[a:b].lower()
        out = []
        for ch, pair in self.single[s]:
            if ch.isalpha():
                known = word not in self.lexicon and text[a:at].lower() + ch.lower() + text[at + 1 : b].lower() in self.lexicon
                if not (before or after):
                    if known and not s.isascii() and s not in PUNCTUATION:
                        out.append((ch, pair, False))
                    continue
                if s in "\u2019\u2018\u00a0\u00ad\u00b4":
                    continue
                fits = ch.islower() == (then.islower() if after else prev.islower()) or ch.isupper() and not before
                if s in PUNCTUATION or s in "–—·°ºª":
                    if before and after and fits:  # low quotes never stand within a word
                        out.append((ch, pair, known or s in "\u201a\u201e" and prev.islower() and then.islower()))
                elif s.isalpha() and script(s) != "latin":
                    others = {script(c) for c in word if c != s.lower()}
                    if others <= {"latin", script(s)} and fits:
                        out.append((ch, pair, known or "latin" in others and (s not in LOOKALIKE or s in WEAK)))
                elif s in JOINED:
                    if before and (known or ch == "ß"):
                        out.append((ch, pair, known))
                elif s.isalpha():
                    if known or s.isupper() and ch.islower() and prev.islower():
                        out.append((ch, pair, known or not then.isupper()))
                elif fits:
                    out.append((ch, pair, known or before and after))
            elif s.isalpha() and word not in self.lexicon:
                if ch in "”’…" and prev and prev in ".,!?" and not then.isalpha():
                    out.append((ch, pair, script(s) == "latin"))
                elif ch in "“‘„¿¡" and not prev.strip() and after and (then.isupper() or text[at + 1 : b].lower() in self.words):
                    out.append((ch, pair, s.islower() and then.isupper() or script(s) != "latin"))
                elif ch == "’" and before and _CONTRACTION.match(text, at + 1):
                    out.append((ch, pair, s.isupper() and prev.islower() or prev == "n" and then == "t"))
                elif ch in "–—" and not prev.strip() and not then.strip():
                    out.append((ch, pair, s not in "éÉàÀèÈìÌòÒùÙóÓúÚêÊôÔ" and s not in LOOKALIKE))
                elif ch == "”" and before and not after and text[a:at].lower() in self.words:
                    out.append((ch, pair, False))
            elif ch == "’" and before and after and not s.isalpha() and s not in "’‘´`'":
                out.append((ch, pair, s not in "·-–—“”"))
        return out

    def spans(self, text: str | None) -> list[tuple[int, int, str]]:
        """(start, end, restored) of the garbled stretches, in order; restored is U+FFFD where the character can't be known."""
        if not text or not BACKGROUND.search(text):
            return []
        sure: list[tuple[int, int, str]] = []
        maybe: list[tuple[int, int, str, str]] = []
        active: Counter[str] = Counter()
        for last, seq in self.automaton.iter_long(text):
            end = last + 1
            start = end - len(seq)
            if len(seq) == 1:
                for ch, pair, certain in self._single(text, start):
                    if certain:
                        active[pair] += 1
                    maybe.append((start, end, ch, pair))
                continue
            ch, pair, certain = self.table[seq]
            before, after = text[start - 1 : start], text[end : end + 1]
            if not certain:
                if all(c.isalpha() for c in seq):  # letters of one other script, or Latin ones
                    kind = script(seq[0])
                    if kind == "latin":
                        certain = len(seq) > 2 and not any(map(str.isascii, seq)) or seq[0] in "ÃÂãâ" and seq[1] in "ŸªºŠŒŽžšœƒ" or before.islower() and seq[0].isupper() and not seq.isupper()
                    else:
                        certain = not any(c.isalpha() and script(c) == kind for c in (before, after) if c)
                        certain = certain and (len(seq) > 2 or before.isalpha() or after.isalpha() or not before.strip())
                elif seq[0].isupper():
                    tail = seq[-1]
                    certain = after.isalpha() and tail != "\u00ad" or before.isalpha() and before.islower() or tail in " \u00a0\u00ad"
                else:
                    certain = before.isalpha() and after.isalpha() and seq[-1] not in " \u00a0\u00ad\u2014\u2013"
            if certain:
                active[pair.split(" ")[0]] += 1
                sure.append((start, end, ch or "�"))
            else:
                maybe.append((start, end, ch, pair.split(" ")[0]))
        out = sure
        if maybe and active:
            taken = {s for s, _, _ in sure}
            for s, e, ch, pair in sorted(maybe, key=lambda x: (x[0], -active[x[3]])):
                if active[pair] and s not in taken:
                    taken.add(s)
                    out.append((s, e, ch))
        if "�" in text:
            covered = [(s, e) for s, e, _ in out]
            out += [(m.start(), m.end(), self._lost(text, m.start())) for m in _LOST.finditer(text) if not any(s <= m.start() < e for s, e in covered)]
        out.sort()
        return out

    def _lost(self, text: str, at: int) -> str:
        """What a replacement character stood for, if only one character fits, else U+FFFD."""
        prev, then = text[at - 1] if at else " ", text[at + 1] if at + 1 < len(text) else " "
        a = b = at
        while a and (text[a - 1].isalpha() or text[a - 1] == "�"):
            a -= 1
        while b < len(text) and (text[b].isalpha() or text[b] == "�"):
            b += 1
        fits = {w[at - a] for w in self.shapes.get(text[a:b].lower(), ()) if len(w) == b - a}
        if len(fits) == 1:
            ch = fits.pop()
            return ch.upper() if text[a:b].isupper() else ch
        if prev.isalpha() and _CONTRACTION.match(text, at + 1) and (prev == "n" and then == "t" or text[a:at].lower() in self.words):
            return "’"
        if prev in ".,!?" and not then.isalpha():
            return "”"
        if not prev.strip() and then.isalpha() and then.isupper():
            return "“"
        return "�"

    def repair(self, text: str | None, rounds: int = 3) -> tuple[str | None, int]:
        """(restored text, garbled stretches). Neighbouring matches count as one stretch; null and empty stay as they are."""
        found = 0
        for k in range(rounds):
            spans = self.spans(text)
            if not spans:
                break
            if k == 0:
                found = sum(1 for i, s in enumerate(spans) if i == 0 or s[0] > spans[i - 1][1])
            out, at = [], 0
            for s, e, ch in spans:
                if s < at:
                    continue
                out += [text[at:s], ch]
                at = e
            fixed = "".join(out) + text[at:]
            if fixed == text:
                break
            text = fixed
        return text, found
