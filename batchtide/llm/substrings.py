"""Removal of passages that occur more than once, by relative Lempel-Ziv factors.

Blocks of documents are the references.  Their index has two levels, both
spread by hash over all tasks (see blocks.py), so a document is factored against
every block without meeting each:

1. Seeds: of each window of ``n`` words the seed, its smallest hash of SEED
   consecutive words.  Windows with the same words have the same seed, and one
   seed in place of about a dozen windows is kept.  A block learns which of its seeds
   another place has too; a window whose seed is nowhere else is unique.
2. Windows: those whose seed is shared, by 64 bits of hash and 32 more of
   another one.  The answer names a reference: the first place (block and word) that has the
   window, if there is more than one place.

A document is then parsed from left to right: where a window has a reference, a
factor begins and grows word by word as long as the window that ends there has
the next place of the same reference; where that fails, at the factor's
boundary, the windows across it are looked at on their own, as each may
stand in another reference, which is then the next factor's.  No factor is
shorter than n words, so all are long enough to be duplicate spans, and together
they cover just the words of windows that occur more than once, the first
place included, as references are asked for on the input as it was.

A window is told by 96 bits.  Of w windows, two different ones are taken for one
with a chance of about w**2 / 2**97: 2e-10 for 5e9 windows (30 GB), 2e-3 for
1.6e13 (100 TB).

Nulls and empty texts have no words.  Repeated rows are copies of each other.
Very long texts are a block each and hashed whole.  An empty table gives an
empty result; other columns, of whatever name, are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks, shared
from .words import EXACT, Words, grams, mix, pair, pieces

N, SEED = 35, 12
_U = np.uint64
#: What a block tells of a window, and what it learns: the reference, or nothing (places 0).
_SAID = np.dtype([("check", "<u4"), ("places", "u1"), ("at", "<u4")])
_TOLD = np.dtype([("block", "<i8"), ("at", "<u4"), ("places", "u1")])


def _rolling(x: np.ndarray, width: int, f) -> np.ndarray:
    """f over each run of so many values, by doubling."""
    out, done = x, 1
    while 2 * done <= width:
        out = f(out[:-done], out[done:])
        done *= 2
    return f(out[: len(out) - (width - done)], out[width - done :]) if done < width else out


class Windows:
    """Windows of some texts: ok where a window is of one text, its seed, and both hashes."""

    def __init__(self, w: Words, n: int):
        k = min(SEED, n)
        self.hash, self.ok = w.grams(n)
        size = len(self.hash)
        self.seed = _rolling(grams(w.hash, k), n - k + 1, np.minimum) if size else self.hash
        # where a window of one text has its seed
        if size:
            least = grams(w.hash, k)
            most = np.concatenate([np.zeros(n - k, _U), np.where(self.ok, self.seed, _U(0)), np.zeros(n - k, _U)])
            self.chosen = np.flatnonzero(_rolling(most, n - k + 1, np.maximum) == least)
            self.least = least[self.chosen]
        else:
            self.least = self.hash

    @staticmethod
    def checks(w: Words, n: int) -> np.ndarray:
        """32 bits of another hash of each window."""
        return (grams(mix(w.hash ^ _U(0xC2B2AE3D27D4EB4F)), n) >> _U(32)).astype(np.uint32)


def _distinct(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of a sorted array, and whether each is there more than once."""
    first = np.ones(len(h), bool)
    first[1:] = h[1:] != h[:-1]
    at = np.flatnonzero(first)
    return h[at], np.diff(np.append(at, len(h))) > 1


def _seeds(texts: list[bytes], n: int) -> tuple[np.ndarray, np.ndarray]:
    """A block's distinct seeds, and whether each has several places in it."""
    got = [Windows(Words(texts[lo:hi], EXACT), n).least for lo, hi in pieces(texts)]
    return _distinct(np.sort(np.concatenate(got)) if got else np.zeros(0, _U))


def _shared_seeds(slices: list[np.ndarray], numbers: list[bytes], _):
    """A bit for each seed: whether another place has it."""
    u, inv = np.unique(np.concatenate(slices), return_inverse=True)
    several = np.concatenate([np.frombuffer(x, np.uint8) for x in numbers])
    hit = np.bincount(inv, 1 + several, len(u))[inv] > 1
    ends = np.cumsum([len(s) for s in slices])[:-1]
    return [len(x).to_bytes(4, "little") + np.packbits(x).tobytes() for x in np.split(hit, ends)], (int(hit.sum()), 0)


def _bits(parts: list[bytes]) -> np.ndarray:
    bits = [np.unpackbits(np.frombuffer(p, np.uint8, offset=4), count=int.from_bytes(p[:4], "little")) for p in parts]
    return np.concatenate(bits) == 1 if bits else np.zeros(0, bool)


def _suspects(texts: list[bytes], shared_seeds: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct windows of a block whose seed is shared: sorted hashes, and what is said of them."""
    hashes, said, word = [], [], 0
    for lo, hi in pieces(texts):
        w = Words(texts[lo:hi], EXACT)
        x = Windows(w, n)
        if len(x.hash) and len(shared_seeds):
            near = np.minimum(np.searchsorted(shared_seeds, x.seed), len(shared_seeds) - 1)
            at = np.flatnonzero(x.ok & (shared_seeds[near] == x.seed))
            s = np.zeros(len(at), _SAID)
            s["check"], s["places"], s["at"] = Windows.checks(w, n)[at], 1, at + word
            hashes.append(x.hash[at])
            said.append(s)
        word += len(w)
    if not hashes:
        return np.zeros(0, _U), np.zeros(0, _SAID)
    h, s = np.concatenate(hashes), np.concatenate(said)
    order = np.lexsort((s["at"], s["check"], h))
    h, s = h[order], s[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (s["check"][1:] != s["check"][:-1])
    first = np.flatnonzero(new)
    times = np.diff(np.append(first, len(h)))
    s["places"][first] = np.minimum(times, 2)
    return h[first], s[first]


def _references(slices: list[np.ndarray], numbers: list[bytes], blocks_: list[int]):
    """For each window of each block its first place in all blocks, and in how many places it is (2 for more)."""
    size = [len(s) for s in slices]
    h, said = np.concatenate(slices), np.concatenate([np.frombuffer(x, _SAID) for x in numbers])
    block = np.repeat(np.array(blocks_, np.int64), size)
    order = np.lexsort((said["at"], block, said["check"], h))
    new = np.ones(len(h), bool)
    a, c = h[order], said["check"][order]
    new[1:] = (a[1:] != a[:-1]) | (c[1:] != c[:-1])
    first = np.flatnonzero(new)
    number = np.cumsum(new) - 1
    told = np.zeros(len(first), _TOLD)
    told["block"], told["at"] = block[order][first], said["at"][order][first]
    told["places"] = np.minimum(np.add.reduceat(said["places"][order].astype(np.int64), first), 2)
    back = np.empty(len(h), np.int64)
    back[order] = number
    ends = np.cumsum(size)[:-1]
    out = []
    for x in np.split(told[back], ends):
        hit = x["places"] > 1
        out.append(len(x).to_bytes(4, "little") + np.packbits(hit).tobytes() + x[["block", "at"]][hit].astype(_PLACE).tobytes())
    return out, (int((told["places"] > 1).sum()), 0)


_PLACE = np.dtype([("block", "<i8"), ("at", "<u4")])


def _places(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hit, reference of each hit) of a block's windows."""
    hits, places = [np.zeros(0, bool)], [np.zeros(0, _PLACE)]
    for p in parts:
        m = int.from_bytes(p[:4], "little")
        size = -(-m // 8)
        hits.append(np.unpackbits(np.frombuffer(p, np.uint8, size, 4), count=m) == 1)
        places.append(np.frombuffer(p, _PLACE, offset=4 + size))
    return np.concatenate(hits), np.concatenate(places)


def _find(known: np.ndarray, check: np.ndarray, w: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(words whose windows are among the known ones, sorted by hash and check; which of those)."""
    h, ok = w.grams(n)
    if not len(h) or not len(known):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    rank = np.searchsorted(known, h)
    at = np.flatnonzero(ok & (known[np.minimum(rank, len(known) - 1)] == h))
    rank, c = rank[at], Windows.checks(w, n)[at]
    right = np.zeros(len(at), bool)
    left = np.arange(len(at))
    while len(left):  # several checks of one hash: once but for a chance of 2**-64 a pair
        same = known[rank[left]] == h[at[left]]
        right[left[same]] = check[rank[left[same]]] == c[left[same]]
        left = left[same]
        left = left[~right[left]]
        left = left[rank[left] + 1 < len(known)]
        rank[left] += 1
    return at[right], rank[right]


def factors(hit: np.ndarray, place: np.ndarray, n: int) -> list[tuple[int, int, int, int]]:
    """(begin, end, block, place) of the factors, from the words whose windows have a reference, in order, and those.

    A factor that begins before the last one's end is the one across its boundary.
    """
    if not len(hit):
        return []
    on = (np.diff(hit) == 1) & (place["block"][1:] == place["block"][:-1]) & (place["at"][1:].astype(np.int64) - place["at"][:-1] == 1)
    first = np.flatnonzero(np.concatenate([[True], ~on]))
    last = np.append(first[1:], len(hit)) - 1
    return list(zip(hit[first].tolist(), (hit[last] + n).tolist(), place["block"][first].tolist(), place["at"][first].tolist(), strict=True))


def covered(found: list[tuple[int, int, int, int]]) -> list[tuple[int, int]]:
    """Disjoint spans, in order, of factors that may overlap."""
    out: list[list[int]] = []
    for lo, hi, _, _ in found:
        if out and lo <= out[-1][1]:
            out[-1][1] = max(hi, out[-1][1])
        else:
            out.append([lo, hi])
    return [(a, b) for a, b in out]


def deduplicate(docs: DataFrame, n: int = N, key: str = "doc_id", text: str = "text", with_text: bool = False, block_bytes: int = blocks.BLOCK_BYTES) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (and kept_text, spans: begin, end, reference block and word of each factor, in a row)."""
    held = blocks.blocks(docs, key, text, block_bytes)
    buckets = blocks.bucket_count(held)

    def seeds(_, texts):
        u, several = _seeds(texts, n)
        return u, several.astype(np.uint8)

    def suspects(block, _, texts, parts):
        yield from blocks.slices(block, *_suspects(texts, _seeds(texts, n)[0][_bits(parts)], n), buckets)

    known_seeds = shared.written(blocks.answered(blocks.asked(held, buckets, seeds), _shared_seeds).select("block", "part", "data"), "seeds")
    told = blocks.answered(blocks.with_answers(held, known_seeds, suspects, blocks._SLICES), _references)
    every = known_seeds.unionByName(told.select("block", (F.col("part") + buckets).cast("int").alias("part"), "data"))

    def use(_, keys, texts, parts):
        u, some, total = _seeds(texts, n)[0], [], 0
        for p in parts:  # the seeds' answers come first
            if total >= len(u):
                break
            some.append(p)
            total += int.from_bytes(p[:4], "little")
        h, said = _suspects(texts, u[_bits(some)], n)
        hit, place = _places(parts[len(some) :])
        known, check = h[hit], said["check"][hit]
        for lo, hi in pieces(texts):
            w = Words(texts[lo:hi], EXACT)
            at, rank = _find(known, check, w, n)
            out = {"doc_id": keys[lo:hi], "n_words": np.diff(w.first), "n_removed": [], "kept_sha256": []}
            if with_text:
                out |= {"kept_text": [], "spans": []}
            for i in range(hi - lo):
                mine, a = w.of(i), int(w.first[i])
                s, e = np.searchsorted(at, (a, int(w.first[i + 1])))
                found = factors(at[s:e] - a, place[rank[s:e]], n)
                kept, done = [], 0
                for b, f in covered(found):
                    kept += mine[done:b]
                    done = f
                joined = b" ".join(kept + mine[done:])
                out["n_removed"].append(sum(f - b for b, f in covered(found)))
                out["kept_sha256"].append(hashlib.sha256(joined).hexdigest())
                if with_text:
                    out["kept_text"].append(joined.decode())
                    out["spans"].append([z for f in found for z in f])
            yield out

    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string, spans array<long>" * with_text
    return blocks.with_answers(held, every, use, schema)
