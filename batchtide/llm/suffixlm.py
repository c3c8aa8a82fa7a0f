"""Language-model scores by a probabilistic suffix tree.

Symbols are the bytes of a text, lower-cased, its words joined by one space and
closed by a newline.  From the training texts, runs of DEPTH + 1 symbols are
counted; shorter contexts' counts are sums of those.  A context of up to DEPTH
symbols becomes a state if it stands at MIN_COUNT places at least, whatever the
corpus, so the tree grows with it, and if the next symbol's distribution
diverges from that of the context one shorter: Kullback-Leibler at least MIN_DIVERGENCE nats, and over all its places at least
one nat for each distinct next symbol (what chance alone would about give).  A
state's distribution is smoothed towards that of its longest shorter state,
with SMOOTHING times the number of distinct next symbols as weight.  A text is scored by the longest state that is a suffix
of what came before.

A block of documents (see blocks.py) asks for its distinct runs and says how
often its training texts have them.  Runs are dealt by a hash of the last SPLIT
symbols of their context, so all that a state of SPLIT symbols or more needs is
in one bucket: its task adds the counts up, grows the bucket's part of the tree
and answers from it.  The counts of SPLIT symbols, from which the shorter states
grow, are at most 256**SPLIT for any corpus and are read by every task.  So no
task holds the tree; answers are 32-bit floats.

Beside it stand the unigram figures of words: counts of every word in all
training texts, asked for by blocks of documents (see blocks.py), so that no
vocabulary is held in one place.

Training texts are those with crc32(doc_id as text) mod 5 other than 1; a null
doc_id counts as empty text there (training).  Null and empty texts have no
word and one token, the end.  Repeated rows count each time.  Very long texts
are a block each.  An empty table gives an empty result; other columns, of
whatever name, are not read.
"""

from __future__ import annotations

import zlib
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks, shared
from .words import LOWER, Words, pieces, words_of

DEPTH, SPLIT, MIN_COUNT, MIN_DIVERGENCE, SMOOTHING = 6, 3, 64, 0.01, 3
_ODD = (0x9E3779, 0x85EBCB)
_END = b"\n"
_END_KEY = 0x9D8E7F60514233A5
#: Bytes of text whose runs are numbered at once.
_STEP = 1 << 20
#: Bits of a key below the hash that deals it.
_LOW = 40
_U = np.uint64


def is_training(key) -> bool:
    return zlib.crc32(b"" if key is None else str(key).encode()) % 5 != 1


# the unigram figures


def _sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of the ranges that begin at first (the last entry ends the last)."""
    return np.diff(np.concatenate([[0], np.cumsum(values)])[first])


def _word_keys(keys: list, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct word hashes of a block and how often training texts have them, the end included."""
    every, count = [np.array([_END_KEY], _U)], [np.array([sum(map(is_training, keys))], np.int64)]
    for lo, hi in pieces(texts):
        w = Words(texts[lo:hi], LOWER)
        train = np.repeat(np.array([is_training(k) for k in keys[lo:hi]], bool), np.diff(w.first))
        u, inv = np.unique(w.hash, return_inverse=True)
        every.append(u)
        count.append(np.bincount(inv, train, len(u)).astype(np.int64))
    u, inv = np.unique(np.concatenate(every), return_inverse=True)
    return u, np.bincount(inv, np.concatenate(count), len(u)).astype("<u4")


def _total(slices: list[np.ndarray], numbers: list[bytes], _):
    numbers = [np.frombuffer(n, "<u4") for n in numbers]
    u, inv = np.unique(np.concatenate(slices), return_inverse=True)
    n = np.bincount(inv, np.concatenate(numbers), len(u)).astype(np.int64)
    return [n[np.searchsorted(u, s)].astype("<i8").tobytes() for s in slices], (int((n > 0).sum()), int(n.sum()))


# the tree


def _stream(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(runs of DEPTH + 1 symbols as numbers, index of the text of each run's last symbol)."""
    pad = _END * DEPTH
    said = [pad + b" ".join(words_of(t, LOWER)) + _END for t in texts]
    lens = np.fromiter(map(len, said), np.int64, len(said))
    flat = b"".join(said) + _END * 8
    # eight bytes from each place on, as one number
    g = np.ndarray((len(flat) - 7,), ">u8", flat, 0, (1,)).astype(_U) >> _U(8 * (7 - DEPTH))
    doc = np.repeat(np.arange(len(said)), lens - DEPTH)
    return g[np.arange(len(doc)) + doc * DEPTH], doc


def _numbered(runs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which of the distinct runs each one is, the distinct runs), by a hash table."""
    import pandas as pd

    return pd.factorize(runs)


def _starts(s: np.ndarray) -> np.ndarray:
    """Where each distinct value of a sorted array begins."""
    new = np.ones(len(s), bool)
    new[1:] = s[1:] != s[:-1]
    return np.flatnonzero(new)


def _added(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    return np.add.reduceat(values, first) if len(first) else values[:0]


def _distinct(parts: list[np.ndarray]) -> np.ndarray:
    s = np.concatenate([np.zeros(0, _U), *parts])
    s.sort()
    return s[_starts(s)]


def _places(known: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Where each key is among the sorted known ones; keys are looked up in their order, which is kinder to caches."""
    order = np.argsort(keys)
    out = np.empty(len(keys), np.int64)
    out[order] = np.searchsorted(known, keys[order])
    return out


def count_short(held: DataFrame) -> DataFrame:
    """(code, n): how often each run of SPLIT symbols stands in the training texts."""

    def out(batch):
        for path in batch.column("path").to_pylist():
            keys, texts = blocks.load(path)
            texts = [t for k, t in zip(keys, texts, strict=True) if is_training(k)]
            some = [(_stream(texts[lo:hi])[0] & _U(256**SPLIT - 1)).astype(np.uint32) for lo, hi in pieces(texts, _STEP)]
            s = np.sort(np.concatenate([np.zeros(0, np.uint32), *some]))
            at = _starts(s)
            yield {"code": s[at].astype(np.int64), "n": np.diff(np.append(at, len(s)))}

    counts = shared.arrow(held.select("path", "block").repartition(blocks.spread(held), "block"), out, "code long, n long")
    return counts.groupBy("code").agg(F.sum("n").alias("n"))


class Level(NamedTuple):
    """Contexts of one length, sorted, with their places and numbers of next symbols; codes (context and next symbol), sorted, with their counts."""

    context: np.ndarray
    total: np.ndarray
    kinds: np.ndarray
    code: np.ndarray
    n: np.ndarray


def _level(code: np.ndarray, n: np.ndarray, kept) -> Level:
    """Sorted codes and their counts by context; kept: the contexts that stay, from a level."""
    first = _starts(code >> _U(8))
    level = Level(code[first] >> _U(8), _added(n, first), np.diff(np.append(first, len(code))), code, n)
    keep = kept(level)
    each = np.repeat(keep, level.kinds)
    return Level(level.context[keep], level.total[keep], level.kinds[keep], code[each], n[each])


def _divergent(shorter: Level, depth: int):
    def kept(level: Level) -> np.ndarray:
        at = _places(shorter.code, level.code & _U(256**depth - 1))
        q = shorter.n[at] / np.repeat(shorter.total, shorter.kinds)[at]
        p = level.n / np.repeat(level.total, level.kinds)
        first = np.cumsum(level.kinds) - level.kinds
        far = _added(p * np.log(p / q), first)
        return (far >= MIN_DIVERGENCE) & (far * level.total >= level.kinds)

    return kept


def grow(code: np.ndarray, n: np.ndarray, deep: int, shallow: int = 0, shorter: Level | None = None) -> tuple[list[Level], Level | None]:
    """States of deep down to shallow symbols from the counts of all codes of deep + 1 symbols that end alike.

    shorter: the frequent contexts, states or not, one symbol shorter than the
    shallow ones; those of deep symbols are given back with the states.
    """
    frequent = []
    for d in range(deep, shallow - 1, -1):
        code = code & _U(256 ** (d + 1) - 1)
        order = np.argsort(code)
        code, n = code[order], n[order]
        at = _starts(code)
        code, n = code[at], _added(n, at)
        frequent.insert(0, _level(code, n, lambda x: x.total >= MIN_COUNT))
    states = []
    for d, level in enumerate(frequent, shallow):
        states.append(_level(level.code, level.n, _divergent(shorter, d)) if d else level)
        shorter = level
    return states, shorter


def _hashed(context: np.ndarray) -> np.ndarray:
    """A one-to-one hash of 24 bits."""
    h = (context & _U(0xFFFFFF)) * _U(_ODD[0]) & _U(0xFFFFFF)
    h ^= h >> _U(12)
    return h * _U(_ODD[1]) & _U(0xFFFFFF)


def _asked(runs: np.ndarray) -> np.ndarray:
    """Runs as keys whose top bits are the hash of the last SPLIT symbols of the context."""
    return _hashed(runs >> _U(8)) << _U(_LOW) | (runs >> _U(32)) << _U(16) | (runs & _U(255)) << _U(8)


def _unasked(keys: np.ndarray) -> np.ndarray:
    h, a = keys >> _U(_LOW), [_U(pow(o, -1, 1 << 24)) for o in _ODD]
    h = h * a[1] & _U(0xFFFFFF)
    h ^= h >> _U(12)
    h = h * a[0] & _U(0xFFFFFF)
    return (keys >> _U(16) & _U(0xFFFFFF)) << _U(32) | h << _U(8) | keys >> _U(8) & _U(255)


def _run_keys(keys: list, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct runs of a block, as keys, and how often training texts have them."""
    every = [np.zeros(0, _U)]
    for lo, hi in pieces(texts, _STEP):
        runs, doc = _stream(texts[lo:hi])
        every.append(runs << _U(8) | np.array([is_training(k) for k in keys[lo:hi]], _U)[doc])
    s = np.concatenate(every)
    del every
    s.sort()
    at = _starts(s >> _U(8))
    n = _added(s & _U(255), at)
    u = _asked(s[at] >> _U(8))
    order = np.argsort(u)
    return u[order], n[order].astype("<u4")


class Tree:
    """The states, by depth."""

    def __init__(self, levels: list[Level]):
        self.levels = levels

    def log10(self, runs: np.ndarray) -> np.ndarray:
        """log10 probability of the last symbol of each run after the others."""
        p = np.full(len(runs), 1 / 256)
        for d, (context, total, kinds, code, n) in enumerate(self.levels):
            if not len(context):
                continue
            now = runs & _U((1 << 8 * (d + 1)) - 1)
            at = np.minimum(_places(context, now >> _U(8)), len(context) - 1)
            hit = np.flatnonzero(context[at] == now >> _U(8))
            now, at = now[hit], at[hit]
            i = np.minimum(_places(code, now), len(code) - 1)
            seen = np.where(code[i] == now, n[i], 0)
            weight = SMOOTHING * kinds[at]
            p[hit] = (seen + weight * p[hit]) / (total[at] + weight)
        return np.log10(p)

    def scores(self, texts: list[bytes]) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        runs, doc = _stream(texts)
        u, inv = np.unique(runs, return_inverse=True)
        return np.bincount(doc, self.log10(u)[inv], len(texts))


def _read(path: str) -> dict[str, np.ndarray]:
    import pyarrow.parquet as pq

    from .tokenfiles import file_system

    fs, at = file_system(path)
    t = pq.read_table(at, filesystem=fs)
    return {c: t.column(c).to_numpy() for c in t.column_names}


@lru_cache(maxsize=1)
def _short(path: str) -> tuple[list[Level], Level]:
    """The states below SPLIT symbols, and the frequent contexts just below it."""
    c = _read(path)
    return grow(c["code"].astype(_U), c["n"], SPLIT - 1)


def _bucket(path: str, keys: list[np.ndarray], numbers: list[bytes]) -> tuple[Tree, np.ndarray, np.ndarray]:
    """(the shorter states and those of a bucket, its distinct runs, which of these each asked one is)."""
    every = np.concatenate(keys)
    order = np.argsort(every)
    s = every[order]
    at = _starts(s)
    n = _added(np.concatenate([np.frombuffer(x, "<u4") for x in numbers])[order].astype(np.int64), at)
    which = np.empty(len(s), np.int32)
    which[order] = np.repeat(np.arange(len(at), dtype=np.int32), np.diff(np.append(at, len(s))))
    runs = _unasked(s[at])
    states, shorter = _short(path)
    train = n > 0
    return Tree(states + grow(runs[train], n[train], DEPTH, SPLIT, shorter)[0]), runs, which


def _answer(path: str):
    """Answers to slices of a bucket: log10 of each run's last symbol after the others."""

    def answer(slices: list[np.ndarray], numbers: list[bytes], _):
        tree, runs, which = _bucket(path, slices, numbers)
        p = tree.log10(runs).astype("<f4")[which]
        ends = np.cumsum([len(x) for x in slices])
        return [x.tobytes() for x in np.split(p, ends[:-1])], (0, 0)

    return answer


_STATES = "depth int, context long, total long, kinds long, code long, n long"


def train(held: DataFrame, buckets: int | None = None) -> str:
    """Grows the tree from blocks and writes it to the shared folder: its states and their next symbols, and the counts of SPLIT symbols; gives its path."""
    path = shared.shared_folder(held.sparkSession, "suffix-tree")
    count_short(held).write.parquet(f"{path}/short")

    def states(_, blocks, keys, numbers):
        for d, level in enumerate(_bucket(f"{path}/short", keys, numbers)[0].levels[SPLIT:], SPLIT):
            each = [np.repeat(x, level.kinds) for x in level[:3]]
            yield pa.RecordBatch.from_pydict(dict(zip(want.names, [np.full(len(level.code), d), *each, *level[3:]], strict=True)), schema=want)

    want = shared.arrow_schema(held.sparkSession, _STATES)
    blocks.by_bucket(blocks.asked(held, buckets or blocks.bucket_count(held), _run_keys, _LOW), states, _STATES).write.parquet(f"{path}/states")
    return path


def load(path: str) -> Tree:
    """The whole tree."""
    c, levels = _read(f"{path}/states"), list(_short(f"{path}/short")[0])
    for d in range(SPLIT, DEPTH + 1):
        mine = np.flatnonzero(c["depth"] == d)
        mine = mine[np.argsort(c["code"][mine])]
        levels.append(_level(c["code"][mine].astype(_U), c["n"][mine], lambda x: np.ones(len(x.context), bool)))
    return Tree(levels)


def score(docs: DataFrame, key: str = "doc_id", text: str = "text", block_bytes: int = blocks.BLOCK_BYTES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every document."""
    held = blocks.blocks(docs, key, text, block_bytes)
    told = shared.written(blocks.answered(blocks.asked(held, blocks.bucket_count(held), _word_keys), _total), "word-counts")
    v, n = told.agg(F.coalesce(F.sum("x"), F.lit(0)), F.coalesce(F.sum("y"), F.lit(0))).first()
    buckets = blocks.bucket_count(held)
    path = shared.shared_folder(held.sparkSession, "short-runs")
    count_short(held).write.parquet(path)
    scored = blocks.answered(blocks.asked(held, buckets, _run_keys, _LOW), _answer(path))
    both = told.select("block", "part", "data").unionByName(scored.select("block", (F.col("part") + buckets).cast("int").alias("part"), "data"))

    def use(_, keys, texts, parts):
        seen = []
        for lo, hi in pieces(texts, _STEP):
            w = Words(texts[lo:hi], LOWER)
            runs, doc = _stream(texts[lo:hi])
            which, u = _numbered(runs)
            seen.append((lo, hi, w.first, w.hash, doc.astype(np.int32), which.astype(np.int32), _asked(u)))
        # the block's keys, as it asked for them
        known = _distinct([np.array([_END_KEY], _U), *(x[3] for x in seen)])
        asked = _distinct([x[6] for x in seen])
        words = int(np.searchsorted(np.cumsum([len(p) for p in parts]), 8 * len(known))) + 1
        count = np.concatenate([np.frombuffer(p, "<i8") for p in parts[:words]])
        p_run = np.concatenate([np.zeros(0, "<f4"), *(np.frombuffer(p, "<f4") for p in parts[words:])])
        if len(p_run) != len(asked) or len(count) != len(known):
            raise ValueError("a key without its answer")
        worth = np.log10((count + 0.5) / (n + 0.5 * (v + 1)))
        end = int(np.searchsorted(known, _U(_END_KEY)))
        for lo, hi, first, hashes, doc, which, keyed in seen:
            at = _places(known, hashes)
            yield {
                "doc_id": keys[lo:hi],
                "held_out": [not is_training(k) for k in keys[lo:hi]],
                "n_tokens": np.diff(first) + 1,
                "n_known": _sums(count[at] > 0, first) + int(count[end] > 0),
                "train_tokens": np.full(hi - lo, n),
                "base_score": np.array([worth[at[a:b]].sum() for a, b in zip(first, first[1:], strict=False)]) + worth[end],
                "score": np.bincount(doc, p_run[_places(asked, keyed)][which], hi - lo),
            }

    return blocks.with_answers(held, both, use, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
