"""Splitting oversized texts at natural boundaries (problem 10).

Every place between two tokens has a strength. A sparse table answers "strongest
cut in this window" in constant time; the cut of a piece is the strongest in the
window the limit permits (the latest of equals), and the next piece starts the
overlap further back, moved up to the strongest boundary within it (the earliest
of equals).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from marginalia.llm.bpe import load, slices

#: Strengths: inside a character, inside a word, between words, after a clause, a sentence, a line, a paragraph.
IN_CHAR, IN_WORD, WORD, CLAUSE, SENTENCE, LINE, PARAGRAPH = range(7)
_MARKS = regex.compile(r"(?P<p>\n[ \t\r]*\n\s*)|(?P<l>\n[ \t]*)|(?P<s>[.!?…]+[\"'”’»)\]]*(?=\s))|(?P<c>[,;:—–](?=\s))|(?P<w>(?=[ \t　]))")
_LEVEL = {"p": PARAGRAPH, "l": LINE, "s": SENTENCE, "c": CLAUSE, "w": WORD}


class SparseTable:
    """Range maximum with the index of the latest (or earliest) maximum."""

    def __init__(self, values: np.ndarray, latest: bool = True):
        n = len(values)
        place = np.arange(n, dtype=np.int64)
        self.n, self.latest = n, latest
        rows = [values.astype(np.int64) * n + (place if latest else n - 1 - place)]
        width = 1
        while 2 * width <= n:
            rows.append(np.maximum(rows[-1][:-width], rows[-1][width:]))
            width *= 2
        self.rows = rows

    def best(self, lo: int, hi: int) -> tuple[int, int]:
        """(index, value) of the maximum over lo..hi, both included."""
        k = (hi - lo + 1).bit_length() - 1
        row = self.rows[k]
        value, place = divmod(int(max(row[lo], row[hi - (1 << k) + 1])), self.n)
        return (place if self.latest else self.n - 1 - place), value


def strengths(text: str, ends: np.ndarray) -> np.ndarray:
    """Strength of the cut after each token; `ends` are the tokens' ends in bytes of UTF-8."""
    raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    starts = (raw & 0xC0) != 0x80
    char_at = np.flatnonzero(starts)
    by_byte = np.zeros(len(raw) + 1, np.int8)
    by_byte[:-1][starts] = IN_WORD
    by_byte[-1] = PARAGRAPH
    for m in _MARKS.finditer(text):
        at, level = m.end(), _LEVEL[m.lastgroup]
        at = char_at[at] if at < len(char_at) else len(raw)
        if by_byte[at] < level:
            by_byte[at] = level
    return by_byte[ends]


def cut_points(strength: np.ndarray, limit: int, overlap: int, least: float) -> list[tuple[int, int]]:
    """(first token, end token) of the pieces of a text whose tokens have these strengths after them."""
    n = len(strength)
    if n <= limit:
        return [(0, n)]
    late, early = SparseTable(strength), SparseTable(strength, latest=False)
    out, start, floor = [], 0, max(overlap + 1, int(limit * least))
    while n - start > limit:
        cut, _ = late.best(start + floor - 1, start + limit - 1)
        out.append((start, cut + 1))
        back, value = early.best(cut - overlap, cut - 1) if overlap else (cut, WORD)
        # without any boundary within the overlap it is repeated in full, but for a character that it would split
        start = back + 1 if value >= WORD else next((cut + 1 - k for k in range(overlap, 0, -1) if strength[cut - k] > IN_CHAR), cut + 1 - overlap)
    out.append((start, n))
    return out


def split_oversized(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = 1024, overlap: int = 64, least: float = 0.5, vocab: str = "byte_bpe_50k", folder: str | None = None) -> DataFrame:
    """(id, piece_no, first_token, end_token, n_tokens, piece) of every text above `limit` tokens.

    Pieces have at most `limit` tokens and, but for the last, at least `least` of
    it; each after the first repeats `overlap` tokens of the one before, or fewer
    where that starts it at a boundary. Texts of at most `limit` tokens, null and
    empty ones have no rows. A text of at most `limit` bytes can't have more tokens
    and isn't encoded. Narrow: one pass, no shuffle. Repeated rows are each cut.
    """
    if not 0 <= overlap < limit * least:
        raise ValueError("overlap must be below the least piece length")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(vocab, folder)
        for whole in batches:
            for b in slices(whole):
                rows: list[list] = [[], [], [], [], [], []]
                for key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    ids = bpe.encode(text)
                    if len(ids) <= limit:
                        continue
                    ends = np.cumsum(bpe.lengths[ids])
                    raw = text.encode("utf-8", "replace")
                    for k, (i, j) in enumerate(cut_points(strengths(text, ends), limit, overlap, least)):
                        for col, v in zip(rows, (key, k, i, j, j - i, raw[ends[i - 1] if i else 0 : ends[j - 1]].decode("utf-8", "replace"))):
                            col.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(rows[0], b.schema.field(0).type), *(pa.array(c, pa.int32()) for c in rows[1:5]), pa.array(rows[5], pa.string())], names=[id_col, "piece_no", "first_token", "end_token", "n_tokens", "piece"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, text_col).filter(F.octet_length(text_col) > limit).mapInArrow(run, f"`{id_col}` {kind}, piece_no int, first_token int, end_token int, n_tokens int, piece string")
