"""Benchmark decontamination.

The windows of the test items (n words, or a whole shorter item) are hashed into
sorted arrays that every worker has; the training texts are scanned once, each
window's hash is looked up, and a hit counts only if its words are those of an item.

The items' size is measured first.  They are dealt into blocks of at most about
BLOCK_BYTES of item text, each a file of the shared folder, broadcast by being
read: a worker holds one block at a time, takes some MB of texts, splits and
hashes them once, and passes them by all blocks.  So memory doesn't grow with the
items, in the driver neither, which makes the blocks one after the other.

Nulls and empty texts or items have no words: no window, no hit.  A null
item_id is shown as an empty one.  Repeated items count once, repeated rows each.
Very long texts are scanned whole.  An empty table of texts gives an empty
result, one of items no hit; other columns, of whatever name, are kept by
`without_hits` and not read.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared
from .shared import file_system
from .words import ALNUM, Words, pieces

N = 10
BLOCK_BYTES = 4 << 20
#: Bytes of text that pass by all blocks at once.
STEP_BYTES = 4 << 20


class Items:
    """Windows of some items: by length, sorted hashes and where they stand."""

    def __init__(self, items: list[tuple[str, bytes]], n: int):
        w = Words([t for _, t in items], ALNUM)
        self.ids, self.buf, self.start, self.end = [i for i, _ in items], w.buf, w.start, w.end
        sizes = np.diff(w.first)
        self.by_size = {}
        for k in sorted(set(np.minimum(sizes, n).tolist()) - {0}):
            h, ok = w.grams(k)
            at = np.flatnonzero(ok)
            item = np.searchsorted(w.first, at, "right") - 1
            mine = sizes[item] >= n if k == n else sizes[item] == k
            at, item = at[mine], item[mine]
            order = np.argsort(h[at], kind="stable")
            self.by_size[k] = (h[at][order], at[order], item[order])

    def words(self, i: int, k: int) -> bytes:
        return b" ".join(self.buf[a:b] for a, b in zip(self.start[i : i + k].tolist(), self.end[i : i + k].tolist(), strict=True))

    def find(self, w: Words):
        """(places, length, ids of items) of hits, one window at a time."""
        for k, (known, at, item) in self.by_size.items():
            h, ok = w.grams(k)
            if not len(h):
                continue
            lo = np.searchsorted(known, h)
            near = np.minimum(lo, len(known) - 1)
            memo: dict[tuple, list] = {}
            for i in np.flatnonzero(ok & (known[near] == h)).tolist():
                said = b" ".join(w.buf[a:b] for a, b in zip(w.start[i : i + k].tolist(), w.end[i : i + k].tolist(), strict=True))
                if (ids := memo.get(said)) is None:
                    same = range(int(lo[i]), int(np.searchsorted(known, h[i], "right")))
                    ids = memo[said] = list({self.ids[item[j]]: 1 for j in same if self.words(int(at[j]), k) == said})
                if ids:
                    yield i, k, ids


def _blocks(benchmark: DataFrame, n: int, item_key: str, item_text: str) -> list[str]:
    """Files of the items' blocks."""
    import pickle
    import uuid

    t = benchmark.select(F.coalesce(F.col(f"`{item_key}`").cast("string"), F.lit("")).alias("i"), F.coalesce(F.col(f"`{item_text}`").cast("string"), F.lit("")).cast("binary").alias("t")).distinct()
    size = t.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    blocks = max(1, -(-size // BLOCK_BYTES))
    if blocks > 1:
        t = shared.written(t, "items")
    folder, out = shared.shared_folder(benchmark.sparkSession, "item-blocks"), []
    for b in range(blocks):
        some = t.where(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == b).collect()  # at most about BLOCK_BYTES
        out.append(f"{folder}/{b}-{uuid.uuid4().hex}")
        fs, at = file_system(out[-1])
        fs.create_dir(at.rsplit("/", 1)[0])
        with fs.open_output_stream(at) as f:
            f.write(pickle.dumps(Items([(r.i, bytes(r.t)) for r in some], n)))
    return out


@lru_cache(maxsize=1)
def _load(path: str) -> Items:
    import pickle

    fs, at = file_system(path)
    with fs.open_input_stream(at) as f:
        return pickle.loads(f.read())


def _find(texts: list[bytes], blocks: list[str]):
    """(lo, hi, words, hits) of some texts at a time; hits are those of all blocks, as of Items.find."""
    for lo, hi in pieces(texts, STEP_BYTES):
        w = Words(texts[lo:hi], ALNUM)
        yield lo, hi, w, [x for path in blocks for x in _load(path).find(w)]


def find_hits(docs: DataFrame, benchmark: DataFrame, n: int = N, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """doc_id, n_words, at (begin and end of each hit window in words, in a row), items of every document."""
    blocks = _blocks(benchmark, n, item_key, item_text)

    def run(batch):
        texts, keys = shared.texts(batch), batch.column("doc_id")
        for lo, hi, w, hits in _find(texts, blocks):
            at, seen = [[] for _ in range(hi - lo)], [{} for _ in range(hi - lo)]
            for i, k, ids in hits:
                doc = int(np.searchsorted(w.first, i, "right")) - 1
                at[doc] += [i - int(w.first[doc]), i - int(w.first[doc]) + k]
                seen[doc].update(dict.fromkeys(ids))
            yield {"doc_id": keys[lo:hi], "n_words": np.diff(w.first), "at": at, "items": [list(x) for x in seen]}

    return shared.arrow(shared.keyed(docs, key, text), run, "doc_id long, n_words long, at array<long>, items array<string>")


def spans(at: list[int]) -> list[tuple[int, int]]:
    """Disjoint spans, in order, of windows that may overlap."""
    out: list[list[int]] = []
    for lo, hi in sorted(zip(at[::2], at[1::2], strict=True)):
        if out and lo <= out[-1][1]:
            out[-1][1] = max(hi, out[-1][1])
        else:
            out.append([lo, hi])
    return [(a, b) for a, b in out]


def report(docs: DataFrame, benchmark: DataFrame, n: int = N, **names) -> DataFrame:
    """Per document n_words, n_hit, n_items, items_sha256, contaminated."""

    def run(batch):
        hit = [sum(b - a for a, b in spans(x)) for x in batch.column("at").to_pylist()]
        items = batch.column("items").to_pylist()
        yield {
            "doc_id": batch.column("doc_id"),
            "n_words": batch.column("n_words"),
            "n_hit": hit,
            "n_items": [len(x) for x in items],
            "items_sha256": [hashlib.sha256(",".join(sorted(x)).encode()).hexdigest() for x in items],
            "contaminated": [x > 0 for x in hit],
        }

    found = find_hits(docs, benchmark, n, **names).select("doc_id", "n_words", "at", "items")
    return shared.arrow(found, run, "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean")


def without_hits(docs: DataFrame, benchmark: DataFrame, n: int = N, text: str = "text") -> DataFrame:
    """docs with hit words cut out of the text; rows, other columns and clean texts stay as they are.

    Cuts run from the first hit word to the last; what stands around them stays.
    """
    t = F.col(f"`{text}`")
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), t.cast("string").cast("binary").alias("text"))
    schema = held.schema
    blocks = _blocks(benchmark, n, "item_id", "text")

    def run(batches):
        for batch in batches:
            texts = batch.column("text").to_pylist()
            flat = [x or b"" for x in texts]
            for lo, hi, w, hits in _find(flat, blocks):
                at: dict[int, list[int]] = {}
                for i, k, _ in hits:
                    at.setdefault(int(np.searchsorted(w.first, i, "right")) - 1, []).extend((i, i + k))
                out = texts[lo:hi]
                for doc, x in at.items():
                    kept, done, base = [], 0, int(w.at[doc])
                    for a, b in spans(x):
                        kept.append(flat[lo + doc][done : int(w.start[a]) - base])
                        done = int(w.end[b - 1]) - base
                    out[doc] = b"".join(kept) + flat[lo + doc][done:]
                yield pa.RecordBatch.from_arrays([batch.column("row").slice(lo, hi - lo), pa.array(out, batch.schema.field("text").type)], schema=batch.schema)

    held = held.mapInArrow(run, schema)
    kind = docs.schema[text].dataType
    return held.select(*[(F.col("text").cast("string").cast(kind) if c == text else F.col(f"row.`{c}`")).alias(c) for c in docs.columns])
