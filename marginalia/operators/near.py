"""Pairs of sparse vectors of length 1 whose cosine reaches a threshold, without a pair lost (JN19)."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs

BLOCK = 2048
#: Postings above this share of all pairs of a group make products of all its rows the cheaper way.
SHARE = 0.5
#: Of the pairs of groups by themselves, what the pairs of their union may be at most, as more rows have more terms.
TOGETHER = 0.8


def _runs(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The places first, first + 1, … of runs of n."""
    ends = np.cumsum(n)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - (ends - n), n)


class Rows:
    """Vectors held in one task: row r has the terms idx[off[r]:off[r + 1]] in order from rare to common, each n times; its first `prefix` terms are its prefix.

    The rarest common term of a similar pair lies in both prefixes. So a pair is sought
    among the texts of each term, and counts where that term is its rarest common one.
    Among a term's texts the same argument holds again with the terms in the order of
    their frequency there, which splits them further; where that doesn't, as in texts made
    of the same few words, all of them are multiplied out, once for all terms that have
    mostly the same texts.
    """

    def __init__(self, idx: np.ndarray, n: np.ndarray, off: np.ndarray, prefix: np.ndarray, idf: np.ndarray, threshold: float, crowd: int):
        self.idx, self.n, self.off, self.prefix, self.idf, self.crowd = idx, n, off, prefix, idf, crowd
        self.terms, self.least = len(idf), threshold - 1e-9
        count = np.diff(off)
        self.norm = np.ones(len(count))
        for a in range(0, len(count), 1 << 16):
            s = slice(off[a], off[min(len(count), a + (1 << 16))])
            c = count[a : a + (1 << 16)]
            w = n[s] * idf[idx[s]]
            self.norm[a : a + (1 << 16)] = np.sqrt(np.bincount(np.repeat(np.arange(len(c)), c), w * w, len(c)))
        self.buffer = np.zeros((BLOCK, self.terms), np.float32)

    def weights(self, e: np.ndarray, row: np.ndarray) -> np.ndarray:
        return self.n[e] * self.idf[self.idx[e]] / self.norm[row]

    def pairs(self, of_terms: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The similar pairs whose rarest common term is one of `of_terms`, each once."""
        mine = np.zeros(self.terms, bool)
        mine[of_terms] = True
        e = _runs(self.off[:-1], self.prefix)
        row = np.repeat(np.arange(len(self.prefix)), self.prefix)
        own = mine[self.idx[e]]
        e, row = e[own], row[own]
        order = np.argsort(self.idx[e], kind="stable")
        e, row = e[order], row[order]
        size = np.bincount(self.idx[e], minlength=self.terms)
        end = np.cumsum(size)
        crowded: list[tuple[int, np.ndarray]] = []
        for t in np.flatnonzero(size > 1).tolist():
            s = slice(end[t] - size[t], end[t])
            found = self.close(row[s], e[s])
            if found is None:
                crowded.append((t, row[s].astype(np.int32)))
            elif len(found[0]):
                yield self._owned(row[s][found[0]], row[s][found[1]], [t])
        for rows, terms in self._crowds(crowded):
            # the common terms of the pairs sought are none rarer than all of `terms`
            first, r = _runs(self.off[rows], self.prefix[rows]), np.repeat(np.arange(len(rows)), self.prefix[rows])
            lo = self.off[rows] + np.bincount(r[self.idx[first] < min(terms)], minlength=len(rows))
            for a, b in self._products(rows, lo):
                if len(a):
                    yield self._owned(a, b, terms)

    def _crowds(self, groups: list[tuple[int, np.ndarray]]) -> Iterator[tuple[np.ndarray, list[int]]]:
        """(rows, terms): the groups put together where comparing all rows of several once costs less than each by itself."""
        left = sorted(groups, key=lambda g: -len(g[1]))
        while left:
            member = np.zeros(len(self.prefix), bool)
            member[left[0][1]] = True
            share = np.array([member[rows].mean() for _, rows in left])
            order = np.argsort(-share, kind="stable")
            member[:] = False
            union, single, best, take = 0.0, 0.0, 0.0, 1
            for k, g in enumerate(order[share[order] > 0].tolist(), 1):
                rows = left[g][1]
                union += float((~member[rows]).sum())
                single += float(len(rows)) ** 2
                member[rows] = True
                if k > 1 and TOGETHER * single - union**2 > best:
                    best, take = TOGETHER * single - union**2, k
            taken = [left[g] for g in order[:take]]
            yield np.unique(np.concatenate([rows for _, rows in taken])), [t for t, _ in taken]
            left = [left[g] for g in np.sort(order[take:]).tolist()]

    def _owned(self, a: np.ndarray, b: np.ndarray, terms: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """Of similar pairs those whose rarest common term is one of `terms`."""
        mine = np.zeros(self.terms, bool)
        mine[terms] = True
        rows, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        ia, ib = at[: len(a)], at[len(a) :]
        n, first = self.prefix[rows].astype(np.int64), self.off[rows]
        keys = np.repeat(np.arange(len(rows)) * self.terms, n) + self.idx[_runs(first, n)]
        keep = np.zeros(len(a), bool)
        for k in range(0, len(a), 1 << 17):
            p, q = ia[k : k + (1 << 17)], ib[k : k + (1 << 17)]
            pair = np.repeat(np.arange(len(p)), n[p])
            term = self.idx[_runs(first[p], n[p])].astype(np.int64)
            want = q[pair] * self.terms + term
            place = np.minimum(np.searchsorted(keys, want), len(keys) - 1)
            hit = np.flatnonzero(keys[place] == want)
            which, rarest = np.unique(pair[hit], return_index=True)
            keep[k + which] = mine[term[hit[rarest]]]
        return a[keep], b[keep]

    def _postings(self, rows: np.ndarray, lo: np.ndarray) -> tuple[np.ndarray, ...]:
        """(r, t, x, pr, pk, pb, size): the terms t of the places r in `rows` from `lo` on with weights x; and by the local order of terms the lists of the places pr that have the term pk in their local prefix, the length pb of their rest from there, and the lists' sizes."""
        m, n = len(rows), self.off[rows + 1] - lo
        e, r = _runs(lo, n), np.repeat(np.arange(m), n)
        t = self.idx[e]
        x = self.n[e] * self.idf[t] / np.repeat(self.norm[rows], n)
        floor = self.least**2 / np.bincount(r, x * x, m).max()
        by = np.argsort(np.bincount(t, minlength=self.terms), kind="stable")
        rank = np.empty(self.terms, np.int64)
        rank[by] = np.arange(self.terms)
        if m * self.terms < 1 << 31 and len(e) < 1 << 32:
            packed = np.sort(((r * self.terms + rank[t]) << 32) | np.arange(len(e)))
            rk, y = (packed >> 32) - r * self.terms, x[packed & 0xFFFFFFFF]
        else:
            order = np.lexsort((rank[t], r))
            rk, y = rank[t[order]], x[order]
        total, ends = np.concatenate([[0.0], np.cumsum(y * y)]), np.cumsum(n)
        behind = total[ends[r]] - total[:-1]
        kept = np.flatnonzero(behind >= floor - 1e-9)
        kept = kept[np.argsort(rk[kept].astype(np.uint16) if self.terms < 1 << 16 else rk[kept], kind="stable")]
        return r, t, x, r[kept], rk[kept], np.sqrt(behind[kept]), np.bincount(rk[kept], minlength=self.terms)

    @staticmethod
    def _crowded(size: np.ndarray, m: int) -> bool:
        return float(size.astype(float) @ (size - 1)) > SHARE * m * (m - 1)

    def close(self, rows: np.ndarray, lo: np.ndarray, top: bool = True) -> tuple[np.ndarray, np.ndarray] | None:
        """Pairs of places in `rows` that are similar by the terms from the places `lo` on; None if all rows should be multiplied out (at the top only)."""
        m, n = len(rows), self.off[rows + 1] - lo
        if m <= self.crowd:
            return self._joined(self._products(rows, lo, places=True))
        # which way is cheaper shows in every eighth row of many
        crowded = m >= 1024 and self._crowded(self._postings(rows[::8], lo[::8])[-1], len(rows[::8]))
        if not crowded:
            r, t, x, pr, pk, pb, size = self._postings(rows, lo)
            crowded = self._crowded(size, m)
        if crowded:
            return None if top else self._joined(self._products(rows, lo, places=True))
        end, found = np.cumsum(size), [np.zeros(0, np.int64)]
        large = size > 4 * self.crowd + 64
        for d in np.flatnonzero(large):
            sub = pr[end[d] - size[d] : end[d]]
            a, b = self.close(rows[sub], lo[sub], top=False)
            found.append(sub[a] * m + sub[b])
        # the rest: all pairs of each posting list, some millions at a time
        later = np.where(large[pk], 0, end[pk] - np.arange(len(pk)) - 1)
        upto, at, seen = np.cumsum(later), 0, []
        while at < len(later):
            to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + (1 << 21), "right")))
            k = later[at:to]
            a = np.repeat(np.arange(at, to), k)
            b = _runs(np.arange(at + 1, to + 1), k)
            near = pb[a] * pb[b] >= self.least - 1e-9
            seen.append(np.unique(pr[a[near]] * m + pr[b[near]]))
            at = to
        pair = np.unique(np.concatenate(seen)) if seen else found[0]
        if len(pair):
            found.append(pair[self._similar(n, r, t, x, pair // m, pair % m)])
        pair = np.unique(np.concatenate(found))
        return pair // m, pair % m

    @staticmethod
    def _joined(parts: Iterator[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        a, b = zip(*parts)
        return np.concatenate(a), np.concatenate(b)

    def _exact(self, x: float, ea: np.ndarray, ra: int, eb: np.ndarray, rb: int) -> bool:
        """What single precision leaves open."""
        if abs(x - self.least) >= 1e-4:
            return x >= self.least
        _, i, j = np.intersect1d(self.idx[ea], self.idx[eb], assume_unique=True, return_indices=True)
        return float(self.weights(ea[i], np.full(len(i), ra)) @ self.weights(eb[j], np.full(len(j), rb))) >= self.least

    def _similar(self, n: np.ndarray, r: np.ndarray, t: np.ndarray, x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Which of the pairs of places (a, b) are similar; place p holds n[p] terms t with weights x, in order."""
        start, single, out = np.cumsum(n) - n, x.astype(np.float32), np.zeros(len(a), bool)
        for lo in range(0, len(n), BLOCK):
            hi = min(len(n), lo + BLOCK)
            s = slice(start[lo], start[hi - 1] + n[hi - 1])
            self.buffer[r[s] - lo, t[s]] = single[s]
            which = np.flatnonzero((b >= lo) & (b < hi))
            for at in range(0, len(which), 1 << 14):
                k = which[at : at + (1 << 14)]
                na = n[a[k]]
                e = _runs(start[a[k]], na)
                dots = np.add.reduceat(self.buffer.ravel()[np.repeat((b[k] - lo) * self.terms, na) + t[e]] * single[e], np.cumsum(na) - na)
                ok = dots >= self.least
                for i in np.flatnonzero(np.abs(dots - self.least) < 1e-4):
                    p, q = slice(start[a[k[i]]], start[a[k[i]]] + n[a[k[i]]]), slice(start[b[k[i]]], start[b[k[i]]] + n[b[k[i]]])
                    _, u, v = np.intersect1d(t[p], t[q], assume_unique=True, return_indices=True)
                    ok[i] = float(x[p][u] @ x[q][v]) >= self.least
                out[k] = ok
            self.buffer[r[s] - lo, t[s]] = 0
        return out

    def _products(self, rows: np.ndarray, lo: np.ndarray, places: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Similar pairs of `rows` by the terms from the places `lo` on, by products of blocks."""
        n, column = self.off[rows + 1] - lo, np.zeros(self.terms, np.int64)
        for k in range(0, len(rows), BLOCK):
            column[self.idx[_runs(lo[k : k + BLOCK], n[k : k + BLOCK])]] = 1
        used = int(column.sum())
        column = np.cumsum(column) - 1

        def block(k: int) -> np.ndarray:
            e, r = _runs(lo[k : k + BLOCK], n[k : k + BLOCK]), np.repeat(np.arange(len(n[k : k + BLOCK])), n[k : k + BLOCK])
            x = np.zeros((len(n[k : k + BLOCK]), used), np.float32)
            x[r, column[self.idx[e]]] = self.weights(e, rows[k + r])
            return x

        for k in range(0, len(rows), BLOCK):
            left = block(k)
            for h in range(k, len(rows), BLOCK):
                dots = left @ (left if h == k else block(h)).T
                i, j = np.nonzero(dots >= self.least - 1e-4)
                if h == k:
                    i, j = i[i < j], j[i < j]
                x = dots[i, j]
                ok = x >= self.least
                i, j = k + i, h + j
                for at in np.flatnonzero(np.abs(x - self.least) < 1e-4):
                    p, q = i[at], j[at]
                    ok[at] = self._exact(float(x[at]), np.arange(lo[p], lo[p] + n[p]), rows[p], np.arange(lo[q], lo[q] + n[q]), rows[q])
                i, j = i[ok], j[ok]
                yield (i, j) if places else (rows[i], rows[j])


def _files(folder: str) -> Iterator[pq.ParquetFile]:
    at = urlparse(folder)
    files, path = (fs.LocalFileSystem(), at.path) if at.scheme in ("", "file") else fs.FileSystem.from_uri(folder)
    for f in sorted(x.path for x in files.get_file_info(fs.FileSelector(path)) if x.path.endswith(".parquet")):
        with files.open_input_file(f) as opened:
            yield pq.ParquetFile(opened)


def _held(folder: str, mine: np.ndarray, idf: np.ndarray, threshold: float, crowd: int) -> tuple[pa.Array, Rows]:
    """The ids and vectors of the texts that have one of the terms `mine` in their prefix."""
    ids, idx, ns, lengths, prefixes = [], [np.zeros(0, np.int32)], [np.zeros(0, np.int32)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    small = np.uint16 if len(idf) < 1 << 16 else np.int32
    for f in _files(folder):
        for b in f.iter_batches(batch_size=20_000, columns=["id", "idx", "n", "n_prefix"]):
            length = pc.list_value_length(b.column("idx")).to_numpy(zero_copy_only=False).astype(np.int64)
            prefix = b.column("n_prefix").to_numpy(zero_copy_only=False).astype(np.int64)
            i, n = b.column("idx").flatten().to_numpy(zero_copy_only=False), b.column("n").flatten().to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(len(length)), prefix)
            keep = np.bincount(row[mine[i[_runs(np.cumsum(length) - length, prefix)]]], minlength=len(length)) > 0
            e = np.repeat(keep, length)
            ids.append(b.column("id").filter(pa.array(keep)))
            idx.append(i[e].astype(small))
            ns.append(n[e].astype(np.int32 if len(n) and n.max() >= 1 << 16 else np.uint16))
            lengths.append(length[keep])
            prefixes.append(prefix[keep])
    n = np.concatenate(ns[1:] or ns)
    off = np.concatenate([[0], np.cumsum(np.concatenate(lengths))]).astype(np.int64)
    return pa.concat_arrays(ids) if ids else pa.array([]), Rows(np.concatenate(idx[1:] or idx), n, off, np.concatenate(prefixes), idf, threshold, crowd)


def links_of_terms(folder: str, part_of: np.ndarray, idf: np.ndarray, threshold: float, crowd: int, kind: pa.DataType) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """From numbers of parts to (id, n, least): for each text the number and the least id of those similar to it whose rarest common term is one of the part's.

    `folder` holds the vectors (id, idx, n, n_prefix); each task reads them and holds those
    with a term of its part in their prefix, so they are never shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (x for b in batches for x in b.column(0).to_pylist()):
            mine = part_of == part
            ids, rows = _held(folder, mine, idf, threshold, crowd)
            if len(ids) < 2:
                continue
            order = pc.sort_indices(ids).to_numpy()
            place = np.empty(len(ids), np.int64)
            place[order] = np.arange(len(ids))
            count, least = np.zeros(len(ids), np.int64), np.full(len(ids), len(ids))
            for a, b in rows.pairs(np.flatnonzero(mine)):
                for p, q in ((a, b), (b, a)):
                    count += np.bincount(p, minlength=len(ids)) if len(p) * 8 > len(ids) else 0
                    if len(p) * 8 <= len(ids):
                        np.add.at(count, p, 1)
                    np.minimum.at(least, p, place[q])
            for k in range(0, len(at := np.flatnonzero(count)), 10_000):
                s = at[k : k + 10_000]
                out = [ids.take(pa.array(s)), pa.array(count[s]), ids.take(pa.array(order[least[s]]))]
                yield pa.RecordBatch.from_arrays([c.cast(t) for c, t in zip(out, (kind, pa.int64(), kind))], names=["class_id", "n", "least"])

    return run
