"""Personal information in free text: a linear-chain conditional random field (problem 3).

Tokens are described by their form, shape and ending and by lists of names, of
themselves and of two neighbours on each side. All of a token's scores come from
what it is written like, so they are worked out once per written form and added up
with numpy; sentences of like length are decoded together by Viterbi.
"""

from __future__ import annotations

import copy
import re
from collections.abc import Iterable, Sequence
from functools import cache

import numpy as np
import xxhash

from marginalia.llm.lookalikes import readable
from marginalia.llm.pii_seeds import FIRST, STREETS, TITLES, Maker

KINDS = ("email", "phone", "id_number", "address", "person_name")
LABELS = ("O", *(f"{b}-{k}" for k in KINDS for b in "BI"))
OFFSETS = (-2, -1, 0, 1, 2)
EPOCHS, RATE, DECAY, BATCH = 5, 0.25, 1e-5, 24
#: Words of the longest name; a longer span of capitalised words is a heading or a list.
LONGEST_NAME = 10
TOKEN = re.compile(r"[^\W\d_]+|\d+|[^\w\s]|_")
_STREET = {t.strip(".").lower() for _, types in STREETS.values() for t in types}
_STREET_END = re.compile(r"(?:straße|strasse|str|weg|gasse|platz|allee|ufer|straat|laan|kade|plein|gracht|dijk|singel|steeg)$")
_TITLE = {w.strip(".").lower() for t in TITLES.values() for x in t for w in x.split() if len(w) > 1} - {"la", "el", "a", "o"}


class Names:
    """A set of lower-case words as sorted 64-bit hashes, 8 bytes each, as Spark's xxhash64 gives them; equal hashes of different names are no matter here."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = np.unique(np.asarray(hashes, np.int64))

    def __contains__(self, word: str) -> bool:
        h = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"), 42)
        h -= (h >> 63) << 64
        at = int(np.searchsorted(self.hashes, h))
        return at < len(self.hashes) and int(self.hashes[at]) == h

    def __len__(self) -> int:
        return len(self.hashes)


class Lists:
    """Names known from the tables: characters and authors, and all first and last names of users, as texts or as Names."""

    def __init__(self, cast: Iterable[str], first: Iterable[str] | Names, last: Iterable[str] | Names, common: Iterable[str] = ()):
        self.cast = {" ".join(n.lower().split()) for n in cast}
        self.cast_first = {n.split()[0] for n in self.cast if " " in n}
        self.cast_last = {n.split()[-1] for n in self.cast if " " in n}
        split = lambda names: names if isinstance(names, Names) else {w for n in names for w in TOKEN.findall(n.lower())}
        self.first, self.last = split(first), split(last)
        self.common = {w.lower() for w in common}

    def flags(self, low: str) -> list[str]:
        return [f for f, s in (("cf", self.cast_first), ("cl", self.cast_last), ("uf", self.first), ("ul", self.last)) if low in s]


def shape(token: str) -> str:
    if token.isdigit():
        return f"d{min(len(token), 9)}"
    if token.isalpha():
        if len(token) == 1:
            return "X" if token.isupper() else "x"
        return "XX" if token.isupper() else "Xx" if token[0].isupper() else "xx"
    return token


def described(token: str, lists: Lists) -> list[str]:
    """The features of a written form."""
    low = token.lower()
    out = ["", "w" + low, "s" + shape(token)]
    if token.isalpha():
        out += ["e" + low[-3:], "f" + low[-4:], *lists.flags(low)]
        if low in _STREET or len(low) > 5 and _STREET_END.search(low):
            out.append("street")
        if low in _TITLE:
            out.append("title")
    return out


class Crf:
    def __init__(self, lists: Lists):
        self.lists = lists
        self.forms: dict[str, np.ndarray] = {}
        self.joints: dict[tuple[str, bool, str], np.ndarray] = {}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"forms": {}, "joints": {}}

    @staticmethod
    def tokens(text: str) -> list[tuple[int, int]]:
        return [m.span() for m in TOKEN.finditer(text)]

    # training -----------------------------------------------------------------
    def fit(self, rows: Sequence[tuple[str, list[tuple[int, int, str]]]], seed: int = 9, epochs: int = EPOCHS) -> Crf:
        names: dict[tuple, int] = {}
        feature_rows, gold = [], []
        for text, spans in rows:
            at = self.tokens(text)
            words = [text[a:z] for a, z in at]
            glued = [i > 0 and at[i - 1][1] == at[i][0] for i in range(len(at))]
            own = [described(w, self.lists) for w in words]
            feats = []
            for i in range(len(at)):
                f = [(o, x) for o in OFFSETS if 0 <= i + o < len(at) for x in own[i + o]]
                f += [(k, shape(words[j - 1]), glued[j], shape(words[j])) for k, j in (("<", i), (">", i + 1)) if 0 < j < len(at)]
                feats.append([names.setdefault(x, len(names)) for x in f])
            y = np.zeros(len(at), np.int64)
            for a, z, kind in spans:
                inside = [i for i, (s, e) in enumerate(at) if s >= a and e <= z]
                for k, i in enumerate(inside):
                    y[i] = LABELS.index(("B-" if k == 0 else "I-") + kind)
            feature_rows.append(feats)
            gold.append(y)
        n = len(LABELS)
        self.names, self.w, self.t = names, np.zeros((len(names), n)), np.zeros((n + 1, n))  # the last row of t is the start
        gw, gt = np.full(len(names), 1e-2), np.full_like(self.t, 1e-2)
        rng = np.random.default_rng(seed)
        by_length = sorted(range(len(rows)), key=lambda i: len(gold[i]))
        batches = [b for i in range(0, len(rows), BATCH) if (b := [k for k in by_length[i : i + BATCH] if len(gold[k])])]
        for _ in range(epochs):
            for pick in rng.permutation(len(batches)):
                self._step([feature_rows[k] for k in batches[pick]], [gold[k] for k in batches[pick]], gw, gt)
        return self

    def _step(self, feats: list, gold: list, gw: np.ndarray, gt: np.ndarray) -> None:
        n, size = len(LABELS), len(gold)
        length = max(map(len, gold))
        flat = np.fromiter((x for s in feats for f in s for x in f), np.int64)
        counts = np.fromiter((len(f) for s in feats for f in s), np.int64)
        starts = np.concatenate([[0], np.cumsum(counts)[:-1]])
        emit = np.add.reduceat(self.w[flat], starts)
        e, live, y = np.zeros((size, length, n)), np.zeros((size, length), bool), np.zeros((size, length), np.int64)
        for i, g in enumerate(gold):
            live[i, : len(g)], y[i, : len(g)] = True, g
        e[live] = emit
        t, start = self.t[:-1], self.t[-1]
        alpha = np.zeros_like(e)
        alpha[:, 0] = e[:, 0] + start
        lse = lambda x, axis: (m := x.max(axis, keepdims=True)).squeeze(axis) + np.log(np.exp(x - m).sum(axis))
        for k in range(1, length):
            step = lse(alpha[:, k - 1, :, None] + t, 1) + e[:, k]
            alpha[:, k] = np.where(live[:, k, None], step, alpha[:, k - 1])
        beta = np.zeros_like(e)
        for k in range(length - 2, -1, -1):
            step = lse(t + (e[:, k + 1] + beta[:, k + 1])[:, None, :], 2)
            beta[:, k] = np.where(live[:, k + 1, None], step, 0)
        z = lse(alpha[:, -1], 1)
        # alpha of finished rows was carried on: it is the alpha of the row's last token
        p = np.exp(alpha + beta - z[:, None, None]) * live[:, :, None]
        d = p.copy()
        rows, cols = np.nonzero(live)
        d[rows, cols, y[rows, cols]] -= 1
        dt = np.zeros_like(self.t)
        for k in range(1, length):
            on = live[:, k]
            if not on.any():
                break
            pair = np.exp(alpha[on, k - 1, :, None] + t + (e[on, k] + beta[on, k])[:, None, :] - z[on, None, None])
            dt[:-1] += pair.sum(0)
            np.subtract.at(dt, (y[on, k - 1], y[on, k]), 1)
        dt[-1] += d[:, 0].sum(0)
        ids, inverse = np.unique(flat, return_inverse=True)
        grad = np.zeros((len(ids), n))
        np.add.at(grad, inverse, np.repeat(d[live], counts, axis=0))
        gw[ids] += (grad**2).sum(1)
        self.w[ids] -= RATE * grad / np.sqrt(gw[ids])[:, None] + DECAY * self.w[ids]
        gt += dt**2
        self.t -= RATE * dt / np.sqrt(gt)

    # decoding -----------------------------------------------------------------
    def _form(self, token: str) -> np.ndarray:
        """(offset, label) scores that a written form gives to the tokens around it."""
        if (out := self.forms.get(token)) is None:
            if len(self.forms) > 50_000:
                self.forms.clear()
            own = described(token, self.lists)
            out = self.forms[token] = np.array([self.w[[k for x in own if (k := self.names.get((o, x))) is not None]].sum(0) for o in OFFSETS])
        return out

    def _joint(self, key: tuple[str, bool, str]) -> np.ndarray:
        if (out := self.joints.get(key)) is None:
            out = self.joints[key] = np.array([self.w[k] if (k := self.names.get((side, *key))) is not None else np.zeros(len(LABELS)) for side in "<>"])
        return out

    def emissions(self, text: str, at: list[tuple[int, int]]) -> np.ndarray:
        words = [text[a:z] for a, z in at]
        f = np.stack([self._form(w) for w in words])
        out = f[:, 2].copy()
        for k, o in enumerate(OFFSETS):
            if o < 0:
                out[-o:] += f[:o, k]
            elif o > 0:
                out[:-o] += f[o:, k]
        if len(words) > 1:
            shapes = [shape(w) for w in words]
            j = np.stack([self._joint((shapes[i - 1], at[i - 1][1] == at[i][0], shapes[i])) for i in range(1, len(words))])
            out[1:] += j[:, 0]
            out[:-1] += j[:, 1]
        return out

    def decode(self, texts: Sequence[str], rows: int = 128) -> list[list[tuple[int, int, str]]]:
        """The spans (start, end, kind) of each text."""
        cut = [self.tokens(t) for t in texts]
        out: list[list[tuple[int, int, str]]] = [[] for _ in texts]
        order = sorted((i for i, c in enumerate(cut) if c), key=lambda i: len(cut[i]))
        t, start = self.t[:-1], self.t[-1]
        for at in range(0, len(order), rows):
            pick = order[at : at + rows]
            length = len(cut[pick[-1]])
            e = np.zeros((len(pick), length, len(LABELS)))
            sizes = np.array([len(cut[i]) for i in pick])
            for r, i in enumerate(pick):
                e[r, : sizes[r]] = self.emissions(texts[i], cut[i])
            back = np.zeros((len(pick), length, len(LABELS)), np.int8)
            score = e[:, 0] + start
            for k in range(1, length):
                step = score[:, :, None] + t
                back[:, k] = step.argmax(1)
                score = np.where((k < sizes)[:, None], step.max(1) + e[:, k], score)
            label = score.argmax(1)
            path = np.zeros((len(pick), length), np.int64)
            for k in range(length - 1, -1, -1):
                path[:, k] = np.where(k < sizes, label, 0)
                label = np.where(k < sizes, back[np.arange(len(pick)), k, label], label)
            for r, i in enumerate(pick):
                spans = out[i]
                for k, y in enumerate(path[r, : sizes[r]]):
                    if y == 0:
                        continue
                    kind = LABELS[y][2:]
                    a, z = cut[i][k]
                    if LABELS[y][0] == "I" and spans and spans[-1][2] == kind and path[r, k - 1] != 0:
                        spans[-1] = (spans[-1][0], z, kind)
                    else:
                        spans.append((a, z, kind))
        return out


_AT = r"\s?@\s?|\s?[\[(]\s?at\s?[\])]\s?|\sat\s(?=[\w ]+\sdot\s)"
_MAIL_GATE = re.compile(r"@|[\[(]\s?at\s?[\])]|\sdot\s", re.I)
_DIGIT = re.compile(r"\d")
#: Any white space but the plain space and the line break.
_ODD_SPACE = re.compile(r"[^\S \n]")
_MANY_DIGITS = re.compile(r"(?:\d[\s().\-/+]{0,2}){6}|(?<![A-Za-z])[A-Za-z]{1,2}[\s-]?\d{2,}")
_STREET_GATE = re.compile(r"(?:straße|strasse|str\.|gasse|platz|allee|ufer|damm|ring|straat|laan|kade|plein|gracht|dijk|singel|steeg|weg)(?![^\W\d_])", re.I)
_EDGES = str.maketrans(dict.fromkeys(".,;:!?()[]\"“”\n/", " "))
_PAIR = re.compile(r"(?<![\w@])([A-ZÀ-ÞŠŽĆČ][\w’'-]*\.?)(,?)\s+(?:(?:van|von|de|da|der|den|di|la|le|du|dos)\s+)*(?=([A-ZÀ-ÞŠŽĆČ][\w’-]+))")
_END = re.compile(r"[.!?…]+[\"”»’')\]]*\s+|\n\s*\n\s*")
#: No end of a sentence: an initial or a usual abbreviation before the dot.
_SHORT = re.compile(r"(?:^|[^\w])(?:[A-ZÀ-Þ]|St|Mr|Ms|Dr|Av|Rd|Sr|Mrs|Ave|Sra|Str|dhr|no|mevr)$|str$")


def segments(text: str, longest: int = 500, window: int = 300, overlap: int = 100) -> list[tuple[int, int]]:
    """(start, end) of the sentences; very long ones in windows, cut at spaces where there are any, each of which repeats the last `overlap` characters of the one before."""
    out, at = [], 0
    for m in [*_END.finditer(text), None]:
        if m and text[m.start()] == "." and _SHORT.search(text, max(0, m.start() - 6), m.start()):
            continue
        end = m.end() if m else len(text)
        while end - at > longest:
            cut = text.find(" ", at + window, at + longest) + 1 or at + window
            out.append((at, cut))
            back = text.rfind(" ", at, cut - overlap) + 1
            at = back if back > at else cut - overlap
        if end > at:
            out.append((at, end))
        at = end
    return out


def joined(spans: Sequence[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Spans in order, as windows that overlap find them: of those that share characters the longest stands, the first on a tie."""
    out: list[tuple[int, int, str]] = []
    for a, z, k in sorted(set(spans)):
        if out and a < out[-1][1]:
            if z - a > out[-1][1] - out[-1][0]:
                out[-1] = (a, z, k)
        else:
            out.append((a, z, k))
    return out


@cache
def trained_field(seed: int) -> Crf:
    """The field, trained on the made-up table with the lists of its own made-up names."""
    maker = Maker(seed)
    rows = maker.rows()
    return Crf(Lists(maker.cast, [a for a, _ in maker.users] + FIRST[: len(FIRST) // 2], [b for _, b in maker.users])).fit(rows)


class Redactor:
    """Sentences that can hold private data go through the field. `lists` are of the project's tables; the field is trained with lists of its own made-up names."""

    def __init__(self, lists: Lists, seed: int = 3):
        self.crf = copy.copy(trained_field(seed))
        self.crf.lists, self.crf.forms, self.crf.joints = lists, {}, {}
        self.lists = lists
        self.known: dict[str, list] = {}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"known": {}}

    def candidate(self, s: str) -> bool:
        """Whether a sentence can hold any kind: a sign of address or number, a title, two words that may be a name and aren't a character's, or all letters in one case.

        No list of users' names takes part but to save a name from looking like an
        ordinary word, so a name that no user has is put to the field as well.
        """
        if _MAIL_GATE.search(s):
            return True
        words = s.lower().translate(_EDGES).split()
        if _DIGIT.search(s) and (_MANY_DIGITS.search(s) or not _STREET.isdisjoint(words) or _STREET_GATE.search(s)):
            return True
        if not _TITLE.isdisjoint(words):
            return True
        if s.isupper() or s.islower():
            return len(words) > 1
        lists = self.lists
        for m in _PAIR.finditer(s):
            a, b = m[1].lower().rstrip("."), m[3].lower()
            for end in ("’s", "'s"):
                b = b.removesuffix(end)
            if b in lists.cast_last and a in lists.cast_first:
                continue
            if (a in lists.common or a in lists.cast_last and b in lists.cast_first) and a not in lists.first:
                continue
            return True
        return False

    def _holds(self, text: str, a: int, z: int, kind: str) -> bool:
        """The exact check after the field: what no span of a kind can lack."""
        s = text[a:z]
        before, after = text[a - 1 : a], text[z : z + 1]
        if kind != "person_name" and (before.isalnum() or after.isalnum() or before and before in "+/=" and s[0] != "+" or after and after in "+=" and kind != "email"):
            return False
        digits = sum(c.isdigit() for c in s)
        if kind == "email":
            return bool(re.search(rf"\w(?:{_AT})\w", s, re.I) and re.search(r"\.\w|dot", s, re.I))
        if kind == "phone":
            return 7 <= digits <= 15
        if kind == "id_number":
            return 5 <= digits <= 14 and not re.match(r"97[89][\s-]", s)
        if kind == "address":
            return digits > 0 and any(c.isalpha() for c in s)
        if not re.fullmatch(r"[^\W\d_]+(?:[ \t\n.,’'\u00a0-]{1,3}[^\W\d_]+)*\.?", s) or s.count("\n") > 1:
            return False
        if not s.isascii():
            s = readable(s)
        words = [w for w in TOKEN.findall(s) if w.isalpha()]
        if len(words) > LONGEST_NAME or max(map(len, words)) < 3 or not (s.islower() or sum(w[0].isupper() for w in words) >= 2):
            return False
        low = [w.lower() for w in words if w.lower() not in _TITLE]
        if not low or len(words) < 2:
            return False
        lists = self.lists
        full = " ".join(low)
        if full in lists.cast or len(low) > 1 and (low[0] in lists.cast_first and low[-1] in lists.cast_last or low[-1] in lists.cast_first and low[0] in lists.cast_last):
            return False
        if low[-1] in lists.cast_last and low[0] not in lists.first and low[0] not in lists.last:
            return False
        return before != "@" and after != "@" and "@" not in s

    def spans(self, texts: Sequence[str | None], entries: int = 120_000) -> list[list[tuple[int, int, str]]]:
        """(start, end, kind) of the private data in each text; null, empty and blank texts have none."""
        if len(self.known) > entries:
            self.known.clear()
        known, todo, cut = self.known, [], []
        for t in texts:
            t = t and _ODD_SPACE.sub(" ", t)  # one to one: places stay
            own = []
            for a, z in segments(t) if t and not t.isspace() else []:
                s = t[a:z]
                if s not in known:
                    if self.candidate(s):
                        todo.append(s)
                    known[s] = ()
                own.append((a, s))
            cut.append(own)
        for s, found in zip(todo, self.crf.decode(todo)):
            known[s] = [f for f in found if self._holds(s, *f)]
        return [joined([(a + x, a + y, k) for a, s in own for x, y, k in known[s]]) for own in cut]

    @staticmethod
    def redact(text: str, spans: Sequence[tuple[int, int, str]]) -> str:
        out, at = [], 0
        for a, z, kind in spans:
            out += [text[at:a], f"[{kind.upper()}]"]
            at = z
        return "".join(out) + text[at:]
