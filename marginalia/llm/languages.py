"""Language of texts and of their stretches by a string kernel (problem 5).

The kernel of two texts is the share of character n-grams they have in common
(presence, n = 1..4, blended). Landmarks from the sample table give a Nyström map; on
it one ridge regression per language is fitted, one against the rest. As all of that
is linear in the n-grams present, the landmarks, map and regressions are multiplied
out once into a matrix (n-gram bins x languages), and a batch of sentences is scored
by one product of its presence matrix with it.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Sequence
from functools import cache

import numpy as np

BINS, ORDERS, LANDMARKS, RIDGE = 8192, (1, 2, 3, 4), 240, 0.02
#: A sentence counts for a language of its own from so many words and letters, and such a lead of the best score over the next.
LEAST_WORDS, LEAST_LETTERS, LEAD = 4, 18, 0.35
#: A shorter sentence needs so many words and letters, and such a lead.
SHORT_WORDS, SHORT_LETTERS, SHORT_LEAD = 2, 8, 0.7
SHARPNESS = 5.0
#: Codes and names of the languages.
LABELS = {
    "en": "en eng english englisch anglais inglés inglês engels",
    "de": "de deu ger german deutsch allemand alemán alemão duits",
    "fr": "fr fra fre french français francais französisch francés francês frans",
    "es": "es spa spanish español espanol espagnol castellano spanisch espanhol spaans castilian",
    "pt": "pt por portuguese português portugues portugais portugués portugiesisch portugees",
    "nl": "nl nld dut dutch nederlands néerlandais holländisch niederländisch holandés holandês flemish vlaams",
}
_BY_LABEL = {w: code for code, words in LABELS.items() for w in words.split()}
_BREAK = re.compile(r"[.!?…]+[\"”“»’')\]]*\s+|\n\s*\n\s*|\n(?=\s*[-•*—])")
_WORD = re.compile(r"[^\W\d_]+")


def label_of(label: str | None) -> str | None:
    """The two-letter code that a label stands for; None if it names none of the languages."""
    words = re.split(r"[-_\s(/,;]+", (label or "").strip().lower())
    return _BY_LABEL.get(words[0])


@cache
def folding() -> np.ndarray:
    """Code point -> code of its lower-cased compatibility form; digits become one sign, everything but letters a space."""
    out = np.full(65536, 32, np.uint32)
    for i in range(65536):
        c = unicodedata.normalize("NFKC", chr(i)).lower()
        if len(c) == 1 and (c.isalpha() or c in "'’"):
            out[i] = ord("'") if c == "’" else ord(c)
    return out


def word_rows(words: Sequence[tuple[str, str]], size: int = 7, rounds: int = 3) -> list[tuple[str, str]]:
    """(language, text) rows made of frequent words (language, word), so that a model knows those its samples lack."""
    by: dict[str, list[str]] = {}
    for lang, word in words:
        by.setdefault(lang, []).append(word)
    out = []
    for lang, own in sorted(by.items()):
        for step in range(1, rounds + 1):
            order = [own[i * step * 7 % len(own)] for i in range(len(own))] if len(own) % 7 else own
            out += [(lang, " ".join(order[i : i + size])) for i in range(0, len(order), size)]
    return out


class LanguageModel:
    def __init__(self, texts: Sequence[str], labels: Sequence[str], landmarks: int = LANDMARKS):
        self.langs = sorted(set(labels))
        parts, target = [], []
        for t, y in zip(texts, labels):
            for a, z in sentences(t):
                if len(_WORD.findall(t[a:z])) >= 3:
                    parts += [t[a:z]]
                    target.append(self.langs.index(y))
        x = self.presence(parts)
        x /= np.sqrt(np.maximum(x.sum(1, keepdims=True), 1))
        y = np.asarray(target)
        # landmarks: as many of each language, spread over its samples
        per = -(-landmarks // len(self.langs))
        marks = np.concatenate([(at := np.flatnonzero(y == k))[np.linspace(0, len(at) - 1, min(per, len(at))).astype(int)] for k in range(len(self.langs))])
        z = x[marks]
        values, vectors = np.linalg.eigh(z @ z.T)
        keep = values > 1e-6 * values.max()
        root = vectors[:, keep] / np.sqrt(values[keep])
        phi = np.column_stack([x @ z.T @ root, np.ones(len(x))])
        weight = 1 / np.bincount(y, minlength=len(self.langs))[y]
        weight /= weight.mean()
        signs = np.where(y[:, None] == np.arange(len(self.langs)), 1.0, -1.0)
        ridge = RIDGE * len(x) / len(marks) * np.eye(phi.shape[1])
        ridge[-1, -1] = 1e-6
        w = np.linalg.solve(phi.T @ (phi * weight[:, None]) + ridge, phi.T @ (signs * weight[:, None]))
        self.matrix = (z.T @ root @ w[:-1]).astype(np.float32)
        self.offset = w[-1].astype(np.float32)

    def presence(self, parts: Sequence[str], out: np.ndarray | None = None) -> np.ndarray:
        """One row per text: 1 in the bins of the n-grams it has. `out`: rows of zeros to use."""
        code = np.frombuffer("".join(f" {p} \0" for p in (q.replace("\0", " ") for q in parts)).encode("utf-32-le", "replace"), np.uint32)
        ends = np.flatnonzero(code == 0)
        row = np.repeat(np.arange(len(parts)), np.diff(np.concatenate([[-1], ends])))
        folded = folding()[np.where(code < 65536, code, 32)]
        # runs of spaces count once
        keep = ~((folded == 32) & (np.concatenate([[0], folded[:-1]]) == 32)) | (code == 0)
        folded, row, stop = folded[keep], row[keep], code[keep] == 0
        if out is None:
            out = np.zeros((len(parts), BINS), np.float32)
        h = np.zeros(len(folded), np.uint32)
        valid = ~stop
        with np.errstate(over="ignore"):
            for n in range(1, max(ORDERS) + 1):
                h = h * np.uint32(2654435761) + folded if n == 1 else h[:-1] * np.uint32(2654435761) + folded[n - 1 :] + np.uint32(n)
                valid = valid if n == 1 else valid[:-1] & ~stop[n - 1 :]
                if n in ORDERS:
                    mixed = h ^ (h >> np.uint32(15))
                    at = (mixed * np.uint32(2246822519)) >> np.uint32(32 - BINS.bit_length() + 1)
                    out[row[: len(h)][valid], at[valid]] = 1
        return out

    def scores(self, parts: Sequence[str], rows: int = 64) -> np.ndarray:
        """One row of scores per text, one column per language."""
        out = np.empty((len(parts), len(self.langs)), np.float32)
        counted = np.column_stack([self.matrix, np.ones(BINS, np.float32)])  # the last column gives the n-grams' number
        buffer = np.zeros((rows, BINS), np.float32)
        for i in range(0, len(parts), rows):
            part = parts[i : i + rows]
            product = self.presence(part, buffer[: len(part)]) @ counted
            out[i : i + rows] = product[:, :-1] / np.sqrt(np.maximum(product[:, -1:], 1)) + self.offset
            buffer[: len(part)] = 0
        return out


def sentences(text: str, longest: int = 400, window: int = 160) -> list[tuple[int, int]]:
    """(start, end) of the sentences; what has no end for very long is cut into windows at spaces."""
    out, at = [], 0
    for m in [*_BREAK.finditer(text), None]:
        end = m.end() if m else len(text)
        while end - at > longest:
            cut = text.find(" ", at + window)
            if cut < 0 or end - cut < window // 2:
                break
            out.append((at, cut + 1))
            at = cut + 1
        if end > at:
            out.append((at, end))
        at = end
    return out


class Labeller:
    """Languages of texts; scores of sentences are kept in a bounded memory, as readers repeat and quote them."""

    def __init__(self, model: LanguageModel, entries: int = 120_000):
        self.model, self.entries = model, entries
        self.known: dict[str, tuple[int, float, float]] = {}

    def _judge(self, parts: list[str]) -> None:
        s = self.model.scores(parts)
        order = np.sort(s, 1)
        p = np.exp(SHARPNESS * (s - s.max(1, keepdims=True)))
        best, conf = s.argmax(1).tolist(), (1 / p.sum(1)).tolist()
        lead = (order[:, -1] - order[:, -2]).tolist()
        for t, k, c, d in zip(parts, best, conf, lead):
            words = _WORD.findall(t)
            n, letters = len(words), sum(map(len, words))
            sure = n >= LEAST_WORDS and letters >= LEAST_LETTERS or n >= SHORT_WORDS and letters >= SHORT_LETTERS and d >= SHORT_LEAD
            self.known[t] = (k, c, d if sure else -1.0)

    def stretches(self, texts: Sequence[str]) -> list[list[tuple[int, int, str, float, bool]]]:
        """Of each text its stretches: (start, end, language, confidence, whether it has a whole sure sentence).

        A sentence that is short or unsure goes with the stretch before it, or after it at the start.
        """
        cut = [sentences(t) for t in texts]
        new = {t[a:z] for t, c in zip(texts, cut) for a, z in c}
        if len(self.known) + len(new) > self.entries:
            self.known.clear()
        new -= self.known.keys()
        if new:
            self._judge(sorted(new))
        langs, out = self.model.langs, []
        for t, c in zip(texts, cut):
            found: list[list] = []
            marks = [(a, z, *self.known[t[a:z]]) for a, z in c]
            sure = [m for m in marks if m[4] >= LEAD]
            if not sure:
                if not marks:
                    out.append([])
                    continue
                total = np.zeros(len(langs))
                for a, z, k, conf, _ in marks:
                    total[k] += conf * (z - a)
                k = int(total.argmax())
                conf = float(np.mean([m[3] if m[2] == k else 0.0 for m in marks]))
                out.append([(0, len(t), langs[k], conf, False)])
                continue
            for a, z, k, conf, d in marks:
                if d < LEAD and found:
                    found[-1][1] = z
                elif found and (found[-1][2] == k or found[-1][2] is None):
                    if found[-1][2] is None:
                        found[-1][2] = k
                    found[-1][1] = z
                    found[-1][3].append(conf)
                else:
                    found.append([a, z, k if d >= LEAD else None, [conf] if d >= LEAD else []])
            out.append([(a, z, langs[k], float(np.mean(confs)), True) for a, z, k, confs in found])
        return out
