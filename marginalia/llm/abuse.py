"""Abusive, hateful and sexual content: a factorization machine over hashed terms (problem 7).

A text's score is the highest of its sentences'. A sentence is a set of hashed terms:
its words, put back from their disguises, and their first letters. The machine adds to
the terms' weights the products of their latent vectors, so that a group's name and a
harsh word count together as neither does alone.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

import numpy as np
import xxhash

from marginalia.llm import abuse_seeds
from marginalia.llm.lookalikes import SUSPECT, readable
from marginalia.llm.private import segments

CATEGORIES = ("abuse", "hate", "sexual")
BITS, RANK, EPOCHS, BATCH, RATE = 22, 8, 24, 64, 0.06
DECAY_W, DECAY_V = 2e-4, 6e-4
_TOKEN = re.compile(r"[\w@$!*'’-]+")
_PLAIN = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")
_SPACED = re.compile(r"(?<!\w)(?:\w ){2,}\w(?!\w)")
_SIGNS = str.maketrans("013457@$!", "oieastasi")
RUDE_WORDS = {w for lang in abuse_seeds.INSULTS for phrase in abuse_seeds.INSULTS[lang] + abuse_seeds.RUDE[lang] for w in phrase.lower().split()} | {"shit", "fuck", "fucking", "crap", "hell", "sex"}


def undisguise(token: str) -> str:
    """A token with digits and signs for letters, or stars, as the rude word it stands for."""
    bare = token.strip("!'’-").lower()
    if bare.isalpha():
        return bare
    if "*" in bare and len(bare) > 2:
        shape = re.compile(re.escape(bare).replace(r"\*", ".") + "$")
        return next((w for w in sorted(RUDE_WORDS) if shape.match(w)), bare)
    if any(c.isalpha() for c in bare):
        plain = bare.translate(_SIGNS)
        if plain in RUDE_WORDS or plain.replace("l", "i") in RUDE_WORDS:
            return plain
        for k in "oieastasl":  # a sign may stand for another letter
            alt = re.sub(r"[@$!1]", k, bare).translate(_SIGNS)
            if alt in RUDE_WORDS:
                return alt
    return bare


def terms(text: str) -> list[str]:
    if not text.isascii() and SUSPECT.search(text):
        text = readable(text)
    if " " in text and _SPACED.search(text):
        text = _SPACED.sub(lambda m: j if (j := m[0].replace(" ", "").lower()) in RUDE_WORDS else m[0], text)
    out = []
    for t in _TOKEN.findall(text):
        w = t.lower() if t.isalpha() else undisguise(t)
        if w:
            out.append(w.replace("’", "'"))
    return out


def features(text: str) -> list[int]:
    """Hashed terms of a sentence, each once."""
    mask = (1 << BITS) - 1
    words = terms(text)
    seen = {xxhash.xxh32_intdigest(w) & mask for w in words}
    seen.update(xxhash.xxh32_intdigest("<" + w[:5]) & mask for w in words if len(w) > 4)
    return sorted(seen)


class FactorizationMachine:
    """One output per category; trained with Adagrad on the logistic loss.

    Only the hashed terms of the training rows have weights; all others count for nothing.
    """

    def __init__(self, rows: Sequence[Sequence[int]], seed: int = 5):
        rng = np.random.default_rng(seed)
        self.place = {h: i for i, h in enumerate(sorted({h for r in rows for h in r}))}
        n = len(self.place)
        self.b = np.full(len(CATEGORIES), -3.0, np.float32)
        self.w = np.zeros((n, len(CATEGORIES)), np.float32)
        self.v = rng.normal(0, 0.05, (n, len(CATEGORIES), RANK)).astype(np.float32)
        self.seed = seed

    def places(self, rows: Sequence[Sequence[int]]) -> list[list[int]]:
        get = self.place.get
        return [[p for h in r if (p := get(h)) is not None] for r in rows]

    def margin(self, rows: Sequence[Sequence[int]]) -> np.ndarray:
        rows = self.places(rows)
        sizes = np.fromiter(map(len, rows), np.int64, len(rows))
        out = np.tile(self.b, (len(rows), 1)).astype(np.float64)
        live = np.flatnonzero(sizes)
        if len(live):
            flat = np.fromiter((i for r in rows for i in r), np.int64, int(sizes.sum()))
            at = np.concatenate([[0], np.cumsum(sizes[live])[:-1]])
            v = self.v[flat]
            total = np.add.reduceat(v, at)
            square = np.add.reduceat(v * v, at)
            out[live] += np.add.reduceat(self.w[flat], at) + 0.5 * (total * total - square).sum(2)
        return out

    def fit(self, rows: Sequence[Sequence[int]], y: np.ndarray, weight: np.ndarray, epochs: int = EPOCHS) -> FactorizationMachine:
        rng = np.random.default_rng(self.seed)
        rows = self.places(rows)
        gb, gw, gv = np.full_like(self.b, 1e-2), np.full_like(self.w, 1e-2), np.full_like(self.v, 1e-2)
        for _ in range(epochs):
            order = rng.permutation(len(rows))
            for i in range(0, len(order), BATCH):
                pick = [k for k in order[i : i + BATCH] if rows[k]]
                sizes = np.array([len(rows[k]) for k in pick])
                flat = np.concatenate([rows[k] for k in pick]).astype(np.int64)
                owner = np.repeat(np.arange(len(pick)), sizes)
                at = np.concatenate([[0], np.cumsum(sizes)[:-1]])
                v = self.v[flat]
                total = np.add.reduceat(v, at)
                m = self.b + np.add.reduceat(self.w[flat], at) + 0.5 * (total**2 - np.add.reduceat(v * v, at)).sum(2)
                d = (1 / (1 + np.exp(-np.clip(m, -30, 30))) - y[pick]) * weight[pick]
                db = d.sum(0)
                dw = d[owner] + DECAY_W * self.w[flat]
                dv = d[owner][:, :, None] * (total[owner] - v) + DECAY_V * v
                gb += db**2
                self.b -= RATE * db / np.sqrt(gb)
                ids, inverse = np.unique(flat, return_inverse=True)
                sw, sv = np.zeros((len(ids), dw.shape[1]), np.float32), np.zeros((len(ids), *dv.shape[1:]), np.float32)
                np.add.at(sw, inverse, dw)
                np.add.at(sv, inverse, dv)
                gw[ids] += sw**2
                gv[ids] += sv**2
                self.w[ids] -= RATE * sw / np.sqrt(gw[ids])
                self.v[ids] -= RATE * sv / np.sqrt(gv[ids])
        return self


def windows(text: str) -> list[str]:
    """Sentences; long ones without an end in windows that overlap by half."""
    out = []
    for a, z in segments(text, longest=10**9):
        if z - a <= 300:
            out.append(text[a:z])
            continue
        at = a
        while at < z:
            end = min(z, at + 160)
            if end < z:
                end = (text.find(" ", end, end + 40) + 1 or end) if end < z else z
            out.append(text[at:end])
            if end >= z:
                break
            step = text.find(" ", at + 80, end)
            at = step + 1 if step >= 0 else at + 80
    return out


class AbuseModel:
    """Trained on the reviewed texts, samples of plain prose and the seed rows; no other text of the corpus takes part, so a text's score depends on itself.

    Of a reviewed text with several sentences only the worst is taken for its
    category; which one that is, the machine of a first round tells.
    """

    def __init__(self, reviewed: Sequence[tuple[str, str]], plain: Sequence[str]):
        seeds = abuse_seeds.rows()
        single: list[tuple[str, str]] = list(seeds)
        several: list[tuple[list[str], str]] = []
        for text, category in reviewed:
            parts = windows(text)
            if category == "none":
                single += [(p, "none") for p in parts]
            elif len(parts) == 1:
                single.append((text, category))
            else:
                several.append((parts, category))
        for text in plain:
            single += [(p, "none") for p in windows(text)]
        first = self._train(single)
        worst = []
        for parts, category in several:
            k = CATEGORIES.index(category)
            at = int(first.margin([features(p) for p in parts])[:, k].argmax())
            worst += [(p, category if i == at else "none") for i, p in enumerate(parts)]
        self.machine = self._train(single + worst)
        self.known: dict[str, tuple[float, ...]] = {}

    @staticmethod
    def _train(rows: list[tuple[str, str]]) -> FactorizationMachine:
        x = [features(t) for t, _ in rows]
        y = np.array([[c == k for k in CATEGORIES] for _, c in rows], np.float32)
        share = np.maximum(y.mean(0), 1e-3)
        weight = np.where(y > 0, 0.5 / share, 1.0).clip(1, 2.5).astype(np.float32)
        return FactorizationMachine(x).fit(x, y, weight)

    def __getstate__(self) -> dict:
        return {"machine": self.machine, "known": {}}

    def score(self, texts: Sequence[str | None], entries: int = 120_000) -> np.ndarray:
        """Probability of each category, per text; null, empty and blank texts have 0."""
        cut = [windows(t) if t and not t.isspace() else [] for t in texts]
        new = {p for c in cut for p in c}
        if len(self.known) + len(new) > entries:
            self.known.clear()
        fresh = sorted(new - self.known.keys())
        for i in range(0, len(fresh), 4096):
            part = fresh[i : i + 4096]
            p = 1 / (1 + np.exp(-np.clip(self.machine.margin([features(t) for t in part]), -30, 30)))
            self.known.update(zip(part, map(tuple, p.tolist())))
        out = np.zeros((len(texts), len(CATEGORIES)))
        for i, c in enumerate(cut):
            if c:
                out[i] = np.max([self.known[p] for p in c], axis=0)
        return out
