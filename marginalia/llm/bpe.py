"""Byte-pair encoding by a segment tree over byte positions (problem 8).

The tree keeps, over the positions of a pre-token's bytes, the least pair rank
and with it the leftmost position that has it. Each merge takes the root, joins
the two live neighbours and repairs two leaves, so a pre-token of n bytes costs
O(n log n) however long it is. Pre-tokens that were met before come from a bounded
memo.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

TOKENIZER_DIR = os.environ.get("PUBLIC_TOKENIZERS", "/opt/tokenizers")
#: Fixed value: the published split pattern of the rank files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
MEMO_ENTRIES, MEMO_CHARS = 200_000, 48
_NONE = 1 << 62


class SegmentTree:
    """Leftmost minimum over a fixed number of slots; empty slots hold _NONE."""

    __slots__ = ("size", "nodes")

    def __init__(self, keys: list[int]):
        size = 1
        while size < len(keys):
            size *= 2
        self.size = size
        nodes = [_NONE] * size + keys + [_NONE] * (size - len(keys))
        for i in range(size - 1, 0, -1):
            a, b = nodes[2 * i], nodes[2 * i + 1]
            nodes[i] = a if a < b else b
        self.nodes = nodes

    def put(self, slot: int, key: int) -> None:
        nodes = self.nodes
        i = slot + self.size
        nodes[i] = key
        i >>= 1
        while i:
            a, b = nodes[2 * i], nodes[2 * i + 1]
            least = a if a < b else b
            if nodes[i] == least:
                break
            nodes[i] = least
            i >>= 1


class Bpe:
    """Encoder over one rank file; ranks are the ids."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.token_bytes = {i: b for b, i in self.ranks.items()}
        self.lengths = np.zeros(max(self.token_bytes) + 1, np.int32)
        for i, b in self.token_bytes.items():
            self.lengths[i] = len(b)
        self.split = regex.compile(PATTERN).findall
        self.memo: dict[str, tuple[int, ...]] = {}

    def merge(self, piece: bytes) -> tuple[int, ...]:
        """Ids of one pre-token."""
        ranks, names = self.ranks, self.token_bytes
        whole = ranks.get(piece) if len(piece) == 1 else None
        if whole is not None:
            return (whole,)
        n = len(piece)
        ids = [ranks[piece[i : i + 1]] for i in range(n)]
        # a key is rank * n + position, so the least key is the leftmost least rank
        tree = SegmentTree([_NONE if (r := ranks.get(piece[i : i + 2])) is None else r * n + i for i in range(n - 1)])
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        nodes = tree.nodes
        while (least := nodes[1]) != _NONE:
            rank, at = divmod(least, n)
            gone = after[at]
            then = after[gone]
            ids[at], ids[gone] = rank, -1
            after[at] = then
            if gone < n - 1:
                tree.put(gone, _NONE)
            if then < n:
                before[then] = at
                r = ranks.get(names[rank] + names[ids[then]])
                tree.put(at, _NONE if r is None else r * n + at)
            else:
                tree.put(at, _NONE)
            if (prior := before[at]) >= 0:
                r = ranks.get(names[ids[prior]] + names[rank])
                tree.put(prior, _NONE if r is None else r * n + prior)
        return tuple(i for i in ids if i >= 0)

    def encode(self, text: str | None) -> list[int]:
        """Ids of a text; strings of special tokens count as ordinary text; null and empty give []."""
        out: list[int] = []
        if not text:
            return out
        memo = self.memo
        for word in self.split(text):
            ids = memo.get(word)
            if ids is None:
                ids = self.merge(word.encode("utf-8", "replace"))
                if len(word) <= MEMO_CHARS:
                    if len(memo) >= MEMO_ENTRIES:
                        memo.clear()
                    memo[word] = ids
            out += ids
        return out

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(self.token_bytes[i] for i in ids)


_LOADED: dict[str, Bpe] = {}


def load(name: str = "byte_bpe_50k", folder: str | None = None) -> Bpe:
    """The encoder of a rank file, once per process."""
    path = os.path.join(folder or TOKENIZER_DIR, f"{name}.tiktoken")
    if path not in _LOADED:
        _LOADED[path] = Bpe(path)
    return _LOADED[path]


def list_column(rows: list[list[int]]) -> pa.ListArray:
    sizes = np.fromiter(map(len, rows), np.int64, len(rows))
    flat = np.empty(int(sizes.sum()), np.int32)
    at = 0
    for r in rows:
        flat[at : at + len(r)] = r
        at += len(r)
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(flat))


def slices(batch: pa.RecordBatch, chars: int = 4_000_000, column: int = 1) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of about `chars` bytes of text, so that long texts don't fill a worker's memory."""
    col = batch.column(column)
    if col.nbytes <= chars:
        yield batch
        return
    import pyarrow.compute as pc

    ends = np.cumsum(pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < batch.num_rows:
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + chars, "right")))
        yield batch.slice(start, stop - start)
        start = stop


def encode_corpus(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocab: str = "byte_bpe_50k", folder: str | None = None) -> DataFrame:
    """(id, ids) of every row of `df`.

    Narrow: one pass over the two columns, no shuffle. Null and empty texts both
    have the empty list; repeated rows give repeated rows; an empty table gives an
    empty result; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(vocab, folder)
        for whole in batches:
            for b in slices(whole):
                yield pa.RecordBatch.from_arrays([b.column(0), list_column([bpe.encode(t) for t in b.column(1).to_pylist()])], names=[id_col, "ids"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, ids array<int>")
