"""Vectorised word splitting and hashing over whole batches of texts.

Texts are handled as UTF-8 bytes.  Every separator of the word rules used here
is an ASCII byte and no byte of a multi-byte character is below 0x80, so a rule
on bytes and the same rule on characters give the same words.

A batch is laid out as one buffer; the words of all its texts are found and
hashed with a fixed number of numpy passes, whatever the number of words.
Hashes are 64 bits, the same in every process and on every machine.  Two of n
distinct words share one with a chance of about n**2 / 2**64: 0.05 % for 10**8
words.  Where ids are reused (pieces.py) the bytes are compared as well.
"""

from __future__ import annotations

import numpy as np

_SPACE = 0x20
_BLANK = bytes([0x20, *range(0x09, 0x0E)])


def _table(lower: bool, separators: bytes) -> bytes:
    out = bytearray(range(256))
    if lower:
        for b in range(0x41, 0x5B):
            out[b] = b + 0x20
    for b in separators:
        out[b] = _SPACE
    return bytes(out)


#: words [^\x20\x09-\x0D]+ as they stand
EXACT = _table(False, _BLANK)
#: the same after lower-casing A-Z
LOWER = _table(True, _BLANK)
#: words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after lower-casing A-Z
ALNUM = _table(True, bytes([*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]))

_U = np.uint64
_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.int64).astype(_U) | _U(1)
_BYTE[_SPACE] = 0
_place = np.zeros(0, _U)


def place_factors(n: int) -> np.ndarray:
    """A factor for each place within a word, independent of one another.

    A word's hash is the sum of its bytes' random values times these.  Two given
    words that differ, of whatever shape, agree with a chance of about 2**-63;
    with powers of one constant, as in a polynomial, some regular words always do.
    """
    global _place
    if len(_place) < n:
        size = max(64, 1 << (n - 1).bit_length())
        _place = mix(np.arange(1, size + 1, dtype=_U) * _U(0x9E3779B97F4A7C15))
    return _place


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of an ordered pair of hashes."""
    return mix(a * _U(0xD1342543DE82EF95) + b + _U(0x2545F4914F6CDD1D))


class Words:
    """The words of some texts.

    ``buf`` bytes after the table, ``start``/``end`` of each word in it,
    ``first[i]:first[i + 1]`` the words of text i, ``hash`` of each word.
    """

    __slots__ = ("buf", "start", "end", "first", "hash", "at")

    def __init__(self, texts: list[bytes], table: bytes):
        self.buf = b" ".join(texts).translate(table)
        n = len(self.buf)
        lens = np.fromiter(map(len, texts), np.int64, len(texts))
        self.at = np.concatenate([[0], np.cumsum(lens + 1)])
        a = np.frombuffer(self.buf, np.uint8)
        solid = np.zeros(n + 2, np.int8)
        solid[1:-1] = a != _SPACE
        step = np.diff(solid)
        self.start = np.flatnonzero(step == 1)
        self.end = np.flatnonzero(step == -1)
        self.first = np.searchsorted(self.start, self.at)
        if len(self.start):
            longest = int((self.end - self.start).max())
            place = np.arange(n, dtype=np.int64)
            place -= np.repeat(np.concatenate([[0], self.start]), np.diff(np.concatenate([[0], self.start, [n]])))
            np.minimum(place, longest, out=place)  # separators count as nothing
            self.hash = mix(np.add.reduceat(_BYTE[a] * place_factors(longest + 1)[place], self.start))
        else:
            self.hash = np.zeros(0, _U)

    def __len__(self) -> int:
        return len(self.start)

    def of(self, i: int) -> list[bytes]:
        """The words of text i."""
        return self.buf[self.at[i] : self.at[i + 1] - 1].split()

    def grams(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(hashes, ok): the k words from each word on; ok where they are all of one text."""
        n = len(self)
        out, size = grams(self.hash, k), n - k + 1
        if size <= 0:
            return np.zeros(0, _U), np.zeros(0, bool)
        last = np.repeat(self.first[1:], np.diff(self.first))
        return out, np.arange(size) + k <= last[:size]


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k hashes, by doubling: a few passes whatever k is."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, _U)
    out, done, power, width = None, 0, h, 1
    while True:
        if k & width:
            part = power[done : done + n]
            out = part if out is None else pair(out, part)
            done += width
        if done == k:
            break
        power = pair(power[: len(power) - width], power[width:])
        width *= 2
    return mix(out ^ _U(k))


def words_of(text: bytes, table: bytes) -> list[bytes]:
    return text.translate(table).split()


def word_hashes(words: list[bytes]) -> np.ndarray:
    """Hashes as Words gives them, for a few words that are at hand."""
    return Words([b" ".join(words)], EXACT).hash if words else np.zeros(0, _U)


def pieces(texts: list, most: int = 1 << 20):
    """Ranges of a list of texts with about so many bytes; a longer text is alone."""
    lo = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > most:
            yield lo, i
            lo, size = i, 0
        size += len(t) + 1
    if lo < len(texts):
        yield lo, len(texts)
