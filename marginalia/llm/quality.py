"""Text statistics per document and natural prose told from lists, tables and junk (problem 6)."""

from __future__ import annotations

import random
import textwrap
from collections.abc import Sequence

import numpy as np

from marginalia.llm.codes import DIGIT, ENDER, LETTER, LINE, ORDINARY, SPACE, UPPER, VOWEL, Batch, member, word_hashes
from marginalia.llm.holdout import HOLDOUT
from marginalia.llm.trees import BoostedTrees

NAMES = ("n_words", "mean_word_length", "symbol_share", "punctuated_line_share", "common_word_share", "digit_share", "common_kinds", "words_per_line", "marked_line_share", "upper_share", "longest_word", "enders_per_word", "commas_per_word", "table_share", "type_share", "letter_word_share", "repeat_share", "vowel_share", "gap_share", "letter_share", "mid_letters", "title_share", "list_commas")
#: Lines that start with one of these, or with a number and a dot or bracket, look like items or rows.
MARKS = "-•*[|<\"#+>{=‣▪–"
CLOSING = "\"'”’»)]"


def statistics(texts: Sequence[str | None], common: np.ndarray) -> np.ndarray:
    """One row of NAMES per text; null and empty texts have zeros. `common`: hashes of common words."""
    b = Batch(texts)
    f, code, n = b.flags, b.code, b.n
    space, letter, live = (f & SPACE) > 0, (f & LETTER) > 0, code != 0
    solid = live & ~space
    n_solid, n_letters, n_space = b.count(solid), b.count(letter), b.count(space & live)
    at_least = lambda x: np.maximum(x, 1)
    ws, we = b.runs(solid)
    words = b.per_doc(ws)
    longest = np.zeros(n)
    np.maximum.at(longest, b.doc(ws), we - ws)
    # words of letters
    ls, le = b.runs(letter | ((code == 0x2019) | (code == 39)) & np.roll(letter, 1) & np.roll(letter, -1))
    ld = b.doc(ls)
    h = b.hashes(ls, le)
    is_common = member(h, common)
    lw = np.bincount(ld, minlength=n).astype(float)
    commons = np.bincount(ld, is_common, n)
    mixed = h ^ (ld.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    _, first = np.unique(mixed, return_index=True)
    kinds = np.bincount(ld[first], minlength=n).astype(float)
    common_kinds = np.bincount(ld[first], is_common[first], n)
    title = ((f[ls] & UPPER) > 0) & ((f[np.minimum(ls + 1, len(f) - 1)] & UPPER) == 0) if len(ls) else np.zeros(0, bool)
    # lines
    starts, ends = b.runs(live & ((f & LINE) == 0))
    where = np.flatnonzero(solid)
    a, z = np.searchsorted(where, starts), np.searchsorted(where, ends)
    full = z > a
    a, z = a[full], z[full]
    fi, la = where[a] if len(where) else a, where[z - 1] if len(where) else z
    line_doc = b.doc(fi)
    lines = np.bincount(line_doc, minlength=n).astype(float)
    closing = np.isin(code, [ord(c) for c in CLOSING])
    back = np.where(closing[la] & (la > fi), la - 1, la)
    ended = ((f[back] & ENDER) > 0) | (code[la] == 58)
    second, third = np.minimum(fi + 1, len(f) - 1), np.minimum(fi + 2, len(f) - 1)
    numbered = ((f[fi] & DIGIT) > 0) & (np.isin(code[second], [46, 41, 58]) | ((f[second] & DIGIT) > 0) & np.isin(code[third], [46, 41, 58]))
    marked = (np.isin(code[fi], [ord(c) for c in MARKS]) & ~((code[fi] == 34) & ended)) | numbered
    follows = np.roll(space | ~live, -1)
    prev_same = np.concatenate([[False], code[1:] == code[:-1]]) & solid
    next_doc = np.maximum(b.count(solid & (f & (LETTER | DIGIT | ORDINARY) == 0)), 0)
    commas = b.count(np.isin(code, [44, 59]))
    out = np.column_stack([
        words,
        n_solid / at_least(words),
        next_doc / at_least(n_solid),
        np.bincount(line_doc, ended, n) / at_least(lines),
        commons / at_least(lw),
        b.count((f & DIGIT) > 0) / at_least(n_solid),
        common_kinds / at_least(np.minimum(lw, 60)),
        np.log1p(words / at_least(lines)),
        np.bincount(line_doc, marked, n) / at_least(lines),
        b.count((f & UPPER) > 0) / at_least(n_letters),
        np.log1p(longest),
        b.count(((f & ENDER) > 0) & follows) / at_least(words),
        commas / at_least(words),
        b.count(np.isin(code, [9, 47, 124, 60, 62, 95, 61, 123, 125, 92])) / at_least(n_solid),
        kinds / at_least(lw),
        lw / at_least(words),
        b.count(prev_same) / at_least(n_solid),
        b.count((f & VOWEL) > 0) / at_least(n_letters),
        b.count(space & np.roll(space, 1) & ((f & LINE) == 0)) / at_least(n_space),
        n_letters / at_least(n_solid),
        n_letters / at_least(lw),
        np.bincount(ld, title, n) / at_least(lw),
        commas / at_least(commas + b.count((f & ENDER) > 0)) * np.minimum(words, 40) / 40,
    ])
    return out


class ProseModel:
    """Boosted trees over the statistics, trained on weak labels, calibrated on the hand-checked holdout."""

    def __init__(self, prose: Sequence[str], common_words: Sequence[str], seed: int = 7):
        self.common = word_hashes(w.lower() for w in common_words)
        rng = random.Random(seed)
        good = natural(prose, rng)
        bad = junk(prose, rng, len(good))
        x = statistics([*good, *bad], self.common)
        y = np.r_[np.ones(len(good)), np.zeros(len(bad))]
        self.trees = BoostedTrees().fit(x, y)
        self.trees.calibrate(statistics([t for t, _ in HOLDOUT], self.common), np.array([k == "prose" for _, k in HOLDOUT], float))

    def score(self, texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(statistics, probability of natural prose)."""
        x = statistics(texts, self.common)
        return x, self.trees.probability(x)


def natural(samples: Sequence[str], rng: random.Random) -> list[str]:
    """Weakly labelled prose: the samples, joined and roughened as readers' texts are."""
    digits = lambda k: "".join(rng.choice("0123456789") for _ in range(k))

    def figure() -> str:
        """A figure as prose has them: page, year, price, number, code, address, quotation."""
        a, b = rng.randint(1, 400), rng.randint(1700, 2025)
        return rng.choice([str(a), str(b), f"{a}-{a + 9}", f"{digits(3)}-{digits(3)}-{digits(4)}", f"({digits(3)}) {digits(3)} {digits(4)}", f"+{digits(2)} {digits(3)} {digits(6)}", f"{chr(65 + a % 26)}{chr(65 + b % 26)} {digits(4)}.{a % 10}", f"{a % 28 + 1:02}-{a % 12 + 1:02}-{b} at {a % 12 + 8}:{b % 60:02}", f"{digits(3)}-{a % 10}-{digits(4)}-{digits(4)}-{a % 10}", f"reader{a}@mail.example", f"“{digits(2)}”", f"{a} €", f"No. {a},", f"@reader{a}"])

    out = list(samples)
    while len(out) < 6 * len(samples):
        t = " ".join(rng.choices(samples, k=rng.choice([1, 1, 2, 3, 5, 9, 20])))
        for chance, change in (
            (0.12, str.upper),
            (0.12, str.lower),
            (0.12, lambda s: "".join(c for c in s if c.isalnum() or c.isspace() or c in "'’")),
            (0.2, lambda s: "\n".join(textwrap.wrap(s, rng.randint(28, 70)))),
            (0.15, lambda s: s.replace(". ", ".\n\n")),
            (0.1, lambda s: s.replace(" ", " ")),
            (0.06, lambda s: s.replace(" ", rng.choice(["  ", "\t", " \n"]))),
            (0.08, lambda s: "".join(c if c.isascii() else rng.choice(["�", "Ã©", "â€™", "?"]) for c in s)),
            (0.08, lambda s: "".join(chr(ord(c) + 0xFEE0) if "!" <= c <= "~" else "　" if c == " " else c for c in s)),
            (0.1, lambda s: s + "\n" + "\n".join(f"{rng.choice(['•', '-', '*'])} {w}" for w in rng.sample(s.split() * 4, rng.randint(2, 4)))),
            (0.3, lambda s: " ".join(w + (" " + figure() if rng.random() < 0.12 else "") for w in s.split(" "))),
            (0.15, lambda s: s + rng.choice([" ", "\n", "\n\n"]) + " ".join(w.strip(".,?!").title() for w in rng.sample(s.split() * 3, 3)).replace(" ", rng.choice([", ", " ", ": "]), 1)),
            (0.06, lambda s: f"{s} {rng.choice(['😀', ':)', '!!!', '❤️', '<3', '£3', '12 €', 'p. 33'])}"),
            (0.05, lambda s: "".join(c + rng.choice(["​", "­"]) if rng.random() < 0.03 else c for c in s)),
        ):
            if rng.random() < chance:
                t = change(t)
        out.append(t)
    return out


def junk(samples: Sequence[str], rng: random.Random, n: int) -> list[str]:
    """Weakly labelled lists, tables and junk, built by rule from the samples' words."""
    pool = [w for s in samples for w in "".join(c if c.isalpha() else " " for c in s).split() if len(w) > 3]
    word = lambda: rng.choice(pool)
    small = ["and", "in the", "/", "of", "und", "et", "y", "e", "en", "with", "de la", "für", "-"]
    item = lambda: rng.choice([word(), f"{word()} {rng.choice(small)} {word()}", f"{word().title()} {word().title()}", f"{word()} {rng.choice(['(ch.', '(p.', '(cap.', '(Kap.'])} {rng.randint(1, 40)})"])
    few = lambda: rng.randint(3, 40)
    num = lambda: rng.choice([str(rng.randint(1, 400)), f"{rng.uniform(0, 10):.1f}", f"{rng.randint(0, 999):,}"])
    letters = "abcdefghijklmnopqrstuvwxyz"
    cells = lambda: [f"{word().title()} {word().title()}", num(), num(), word(), num()][: rng.randint(2, 5)]

    def rows(sep: str, quote: str = "") -> str:
        k = rng.randint(2, 5)
        return "\n".join(sep.join(quote + c + quote for c in (cells() + [num()] * 5)[:k]) for _ in range(few()))

    def listed() -> str:
        mark = rng.choice(["-", "•", "*", "[ ]", "[x]", "–", "+", "", "1.", "1)", "(1)", "a)"])
        lines = [f"{mark.replace('1', str(k + 1)).replace('a', letters[k % 26])} {item()}".strip() for k in range(few())]
        if rng.random() < 0.3:
            lines = [" " * rng.randint(0, 4) + x for x in lines]
        if rng.random() < 0.4:
            lines = [x[:1].upper() + x[1:] if rng.random() < 0.9 else x for x in lines]
        return rng.choice(["", "", word().title() + ":\n"]) + "\n".join(lines)

    def inline() -> str:
        style = rng.choice([0, 1, 1, 2, 3])
        k = rng.choice([few(), rng.randint(2, 8)])
        if style == 0:
            return "; ".join(f"{letters[i % 26]}) {item()}" for i in range(k))
        if style == 1:
            return ", ".join(item() for _ in range(k + 4))
        if style == 2:
            return " | ".join(rng.choice([item(), f"Page {rng.randint(1, 20)} of {rng.randint(2, 30)}", "Next >>", "Log in", "© 2020"]) for _ in range(k))
        return rng.choice([" / ", " · ", " > ", "; ", " - ", " * "]).join(item() for _ in range(k + 3))

    def table() -> str:
        style = rng.randrange(6)
        if style == 0:
            return rows(",")
        if style == 1:
            return rows("\t")
        if style == 2:
            return rows(rng.choice([";", ","]), '"')
        if style == 3:
            return "\n".join("| " + " | ".join(cells()) + " |" for _ in range(few()))
        if style == 4:
            return "\n".join("".join(c.ljust(w) for c, w in zip(cells() + [num()] * 3, (26, 8, 8, 12, 6))).rstrip() for _ in range(few()))
        return rows(": ")

    def noise() -> str:
        style = rng.randrange(14)
        many = rng.randint(8, 120)
        if style == 0:
            return "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/") + ("\n" if i % 64 == 63 else "") for i in range(4 * many))
        if style == 1:
            return "".join(rng.choice("#^*|~\\<>%-_+=/&@$ ") for _ in range(3 * many))
        if style == 2:
            return " ".join(rng.choice(letters + "!?.") * rng.randint(3, 50) for _ in range(1 + many // 12))
        if style == 3:
            s = " ".join(rng.choices(samples, k=2))
            return "".join(rng.sample(s, len(s)))
        if style == 4:
            return " ".join(word()[::-1].lower() + rng.choice(["", str(rng.randint(1, 99)) + rng.choice(letters) * 3]) for _ in range(many))
        if style == 5:
            return " ".join("".join(rng.choice(rng.choice([letters, "bcdfghjklmnpqrstvwxz"])) for _ in range(rng.randint(2, 12))) for _ in range(many))
        if style == 6:
            return " ".join(f"{rng.uniform(1, 999):.3f}" if rng.random() < 0.7 else str(rng.randint(1, 99999)) for _ in range(many))
        if style == 7:
            return "\n".join(f"[{rng.randint(10, 23)}:{rng.randint(10, 59)}:{rng.randint(10, 59)}] {rng.choice(['INFO', 'WARN', 'ERROR'])} {word()}.{word()} rc={rng.randint(0, 9)}" for _ in range(few()))
        if style == 8:
            return " ".join(f'<{t} class="{word()}"><span style="margin:{rng.randint(1, 40)}px">{word()}</span></{t}>' for t in [rng.choice(["div", "p", "td"]) for _ in range(few())])
        if style == 9:
            return "{" + ", ".join(f'"{word()}": {num()}' for _ in range(few())) + "}"
        if style == 10:
            return " ".join([word()] * rng.randint(8, 60))
        if style == 11:
            return "\n".join(f"{word()} = {word()}({word()}, {num()});" for _ in range(few()))
        if style == 12:
            return " ".join(f"https://{word().lower()}.example/{word().lower()}?id={rng.randint(1, 999)}" for _ in range(few()))
        return "".join(f"{rng.randrange(16):x}" for _ in range(3 * many))

    kinds = [listed, listed, listed, inline, inline, table, table, noise, noise, noise]
    out = []
    while len(out) < n:
        t = rng.choice(kinds)()
        if rng.random() < 0.06:
            t = t.upper()
        if rng.random() < 0.05:
            t = " " + t
        out.append(t)
    return out
