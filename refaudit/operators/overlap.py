"""The records whose titles share most words with an entry's: counted exactly, a block at a time.

Records are taken by their number of words, in slices. A word that many titles of a slice have is a
row of zeros and ones, a rare one a list of places; the rows of an entry's words are added up, which
gives the number of common words with every title of the slice, and one comparison with the least
number that the entry's last record so far demands of a title of its length leaves the few titles
to rank. The slice with titles as long as the entry's comes first; of the others only the titles of
lengths that can still reach that share are counted.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Titles in a slice, and titles that have a word from which it is a row of its own.
SLICE, COMMON = 1 << 16, 512
#: Shares that are tried where an entry has no records yet, the greatest first; all titles reach the last.
STEPS = (1.0, 0.9, 0.8, 0.7, 0.65, 0.6, 0.55, 0.5, 0.45, 0.4, 0.35, 0.3, 0.25, 0.2, 0.15, 0.1, 0.05, 0.0)


def coded(left: pa.Array, right: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
    """(codes, sizes) of the words of both sides, separated by spaces, and the number of codes."""
    lists = [pc.split_pattern(x, " ") for x in (left, right)]
    sizes = [pc.list_value_length(x).to_numpy(zero_copy_only=False).astype(np.int64) for x in lists]
    words = pa.concat_arrays([x.flatten() for x in lists]).dictionary_encode()
    codes = words.indices.to_numpy(zero_copy_only=False)
    return codes[: sizes[0].sum()], sizes[0], codes[sizes[0].sum() :], sizes[1], len(words.dictionary)


class Slice:
    """Titles in the order of their ``sizes``; ``codes`` are their words one after the other."""

    def __init__(self, codes: np.ndarray, sizes: np.ndarray, n_codes: int, kind: type) -> None:
        self.n, self.kind = len(sizes), kind
        self.lengths, first = np.unique(sizes, return_index=True)
        self.first = np.append(first, self.n)
        order = np.argsort(codes, kind="stable")
        self.at = np.repeat(np.arange(self.n, dtype=np.int32), sizes)[order]
        self.start = np.searchsorted(codes[order], np.arange(n_codes + 1))
        self.rows: dict[int, np.ndarray] = {}
        for c in np.flatnonzero(np.diff(self.start) > COMMON).tolist():
            row = self.rows[c] = np.zeros(self.n, kind)
            row[self.places(c)] = 1
        self.counts = np.zeros(self.n, kind)
        self.start = self.start.tolist()
        self.kept: dict[tuple[int, float], tuple[int, int, np.ndarray]] = {}

    def places(self, c: int) -> np.ndarray:
        return self.at[self.start[c] : self.start[c + 1]]

    def least(self, m: int, share: float) -> tuple[int, int, np.ndarray]:
        """(from, to, common words that each title between must have) to reach ``share`` with m words."""
        held = self.kept.get((m, share))
        if held is None:
            if len(self.kept) >= 256:
                self.kept.clear()
            common = np.arange(1, m + 1)
            reach = (common / (m + self.lengths[:, None] - common) >= share) & (common <= self.lengths[:, None])
            able = np.flatnonzero(reach.any(1))
            if len(able):
                i, j = able[0], able[-1] + 1
                need = np.where(reach.any(1), reach.argmax(1) + 1, np.iinfo(self.kind).max)[i:j].astype(self.kind)
                held = int(self.first[i]), int(self.first[j]), np.repeat(need, np.diff(self.first[i : j + 1]))
            else:
                held = 0, 0, np.zeros(0, self.kind)
            self.kept[m, share] = held
        return held

    def count(self, codes: list[int], lo: int, hi: int) -> np.ndarray:
        """Common words of the titles from ``lo`` to ``hi`` with a title of ``codes``."""
        self.counts[lo:hi] = 0
        part = self.counts[lo:hi]
        for c in codes:
            row = self.rows.get(c)
            if row is not None:
                np.add(part, row[lo:hi], out=part)
            elif self.start[c + 1] > self.start[c]:
                self.counts[self.places(c)] += 1
        return part


def closest(asked: pa.Array, held: pa.Array, ids: pa.Array, limit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of ``asked``, row of ``held``, common words): for each title the ``limit`` others of the
    greatest share of common words, ties by id; those without a common word are left out."""
    ec, es, rc, rs, n_codes = coded(asked, held)
    if not len(es) or not len(rs):
        return (np.zeros(0, np.int64),) * 3
    by_id = np.empty(len(rs), np.int64)
    by_id[pc.sort_indices(ids).to_numpy()] = np.arange(len(rs))
    order = np.argsort(rs, kind="stable")
    r_from, e_from = np.append(0, np.cumsum(rs)), np.append(0, np.cumsum(es)).tolist()
    entries = ec.tolist()
    kind = np.uint8 if es.max() < 255 else np.uint16 if es.max() < 65_535 else np.uint32
    top = [None] * len(es)  # (shares, rows of held, common words), the best first
    cuts = list(range(0, len(rs), SLICE))
    home = np.minimum(np.searchsorted(rs[order], es, "left"), len(rs) - 1) // SLICE
    by_size = np.argsort(es, kind="stable")
    for first in (True, False):
        for k, cut in enumerate(cuts):
            wanted = by_size[(home[by_size] == k) == first].tolist()
            if not wanted:
                continue
            rows = order[cut : cut + SLICE]
            sizes = rs[rows]
            codes = rc[np.repeat(r_from[rows] - np.append(0, np.cumsum(sizes)[:-1]), sizes) + np.arange(sizes.sum())]
            part = Slice(codes, sizes, n_codes, kind)
            step = 0
            for e in wanted:
                m, old = e_from[e + 1] - e_from[e], top[e]
                full = old is not None and len(old[0]) == limit
                lo, hi, need = part.least(m, float(old[0][-1]) if full else 0.0)
                if lo == hi:
                    continue
                counts = part.count(entries[e_from[e] : e_from[e + 1]], lo, hi)
                if full:
                    hits = np.flatnonzero(counts >= need)
                else:
                    lo, hits, step = _by_steps(part, m, limit, step)
                if not len(hits):
                    continue
                hits += lo
                common = part.counts[hits].astype(np.int64)
                found = common / (m + sizes[hits] - common), rows[hits], common
                if old is not None:
                    found = tuple(np.concatenate(x) for x in zip(old, found))
                best = np.lexsort((by_id[found[1]], -found[0]))[:limit]
                top[e] = tuple(x[best] for x in found)
    named = [e for e, t in enumerate(top) if t is not None]
    if not named:
        return (np.zeros(0, np.int64),) * 3
    return np.repeat(named, [len(top[e][0]) for e in named]), np.concatenate([top[e][1] for e in named]), np.concatenate([top[e][2] for e in named])


def _by_steps(part: Slice, m: int, limit: int, step: int) -> tuple[int, np.ndarray, int]:
    """(from, titles counted from there, step): those of the greatest step that ``limit`` titles reach."""

    def reached(s: int) -> tuple[int, np.ndarray]:
        lo, hi, need = part.least(m, STEPS[s])
        return lo, part.counts[lo:hi] >= need

    lo, on = reached(step)
    if np.count_nonzero(on) >= limit:
        while step and np.count_nonzero((higher := reached(step - 1))[1]) >= limit:
            step, (lo, on) = step - 1, higher
    else:
        while step < len(STEPS) - 1 and np.count_nonzero(on) < limit:
            step += 1
            lo, on = reached(step)
    return lo, np.flatnonzero(on), step
