"""Token ids of texts by way of their distinct pieces.

A tokenizer that never joins across certain places (white space) gives a text
the ids of its pieces in a row.  Most pieces of a text occur many times, so the
library encodes each new piece once and numpy lays out the ids of all texts.
Pieces are grouped by hash; ids are shared only by pieces of the same bytes.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np

from .words import EXACT, Words, _BYTE, mix, place_factors


def pieces_after_space(texts: list[bytes]):
    """Pieces of white space (ASCII) and what follows it: (buf, start, end, first, hash) as in Words."""
    buf = b"".join(texts)
    n = len(buf)
    at = np.concatenate([[0], np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))])
    if not n:
        return buf, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(at), np.int64), np.zeros(0, np.uint64)
    a = np.frombuffer(buf, np.uint8)
    solid = np.frombuffer(buf.translate(EXACT), np.uint8) != 0x20
    cut = np.zeros(n, bool)
    cut[1:] = solid[:-1] & ~solid[1:]
    cut[at[:-1][at[:-1] < n]] = True
    start = np.flatnonzero(cut)
    end = np.append(start[1:], n)
    lens = end - start
    place = np.arange(n, dtype=np.int64) - np.repeat(start, lens)
    value = _BYTE.copy()
    value[0x20] = 0x5851F42D4C957F2D
    h = mix(np.add.reduceat(value[a] * place_factors(int(lens.max()) + 1)[place], start) + lens.astype(np.uint64))
    return buf, start, end, np.searchsorted(start, at), h


def words_between_space(texts: list[bytes]):
    w = Words(texts, EXACT)
    return w.buf, w.start, w.end, w.first, w.hash


def _alike(buf: bytes, start: np.ndarray, end: np.ndarray, model: np.ndarray) -> bool:
    """Whether each piece has the bytes of its model, another piece."""
    size = end - start
    if (size != size[model]).any():
        return False
    a, to = np.frombuffer(buf, np.uint8), np.cumsum(size)
    step = np.arange(to[-1])
    return bool((a[np.repeat(start - to + size, size) + step] == a[np.repeat(start[model] - to + size, size) + step]).all())


class PieceIds:
    """encode: ids of each of a list of pieces (strings).  keep: how many pieces a worker keeps between batches."""

    def __init__(self, encode, keep: int = 500_000):
        self.encode, self.keep = encode, keep
        self.slot: dict[bytes, int] = {}
        self.flat, self.off = np.zeros(1 << 16, np.int32), np.zeros(1 << 14, np.int64)

    def _add(self, keys: list[bytes], lists: list[list[int]]) -> None:
        n, m = len(self.slot), len(lists)
        off = np.cumsum(np.fromiter(map(len, lists), np.int64, m)) + self.off[n]
        while len(self.off) <= n + m:
            self.off = np.concatenate([self.off, np.zeros_like(self.off)])
        while len(self.flat) < off[-1]:
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[self.off[n] : off[-1]] = np.fromiter((x for ids in lists for x in ids), np.int32, int(off[-1] - self.off[n]))
        self.off[n + 1 : n + 1 + m] = off
        self.slot.update(zip(keys, range(n, n + m), strict=True))

    def __call__(self, buf: bytes, start, end, first, h) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, where each text's ids begin and end in it)."""
        if not len(h):
            return np.zeros(0, np.int32), np.zeros(len(first), np.int64)
        _, where, inv = np.unique(h, return_index=True, return_inverse=True)
        if not _alike(buf, start, end, where[inv]):
            number: dict[bytes, int] = {}
            inv = np.fromiter((number.setdefault(buf[a:b], len(number)) for a, b in zip(start.tolist(), end.tolist(), strict=True)), np.int64, len(h))
            where = np.unique(inv, return_index=True)[1]
        names = [buf[a:b] for a, b in zip(start[where].tolist(), end[where].tolist(), strict=True)]
        slots = np.fromiter(map(self.slot.get, names, repeat(-1)), np.int64, len(names))
        new, added = np.flatnonzero(slots < 0), []
        if len(new):
            n, added = len(self.slot), [names[i] for i in new.tolist()]
            self._add(added, self.encode([x.decode() for x in added]))
            slots[new] = np.arange(n, n + len(new))
        begin, count = self.off[slots][inv], (self.off[slots + 1] - self.off[slots])[inv]
        ends = np.cumsum(count)
        ids = self.flat[np.repeat(begin - ends + count, count) + np.arange(ends[-1])]
        if len(self.slot) > self.keep:
            for k in added[max(0, len(added) - (len(self.slot) - self.keep)) :]:
                del self.slot[k]
        return ids, np.concatenate([[0], ends])[first]
