"""Blocks of documents, and questions that all blocks ask about their keys.

Some operators must know, for each of very many small keys of a text (windows,
words), something about that key in the whole corpus.  A row for each key would
be most of the work, so documents are packed into blocks of some MB, each
written once as a file of the shared folder (named by the try that wrote it; the
table of blocks lists those that counted), and a block asks about its distinct
keys together:

1. a block sorts its distinct 64-bit keys and cuts them by their top bits into
   one slice a bucket, one row each (perhaps with numbers for each key);
2. the task of a bucket sees the slices of all blocks, works out what is asked
   and answers each slice in its own order;
3. the answers of a block come to a task that reads the block again.

A key that every document has still is one key in a block's slice, so no bucket
depends on how often a key occurs; buckets hold equal shares of the hashes.
Rows are at most one a bucket and block, and never more than distinct keys:
with buckets of BUCKET_BYTES some 15,000 at 4 GB and, as keys spread over more
buckets, one row for about 100 keys at 1 TB and for one at 100 TB.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared

#: Bytes of text in a block, and in the share of a bucket.
BLOCK_BYTES, BUCKET_BYTES = 8 << 20, 32 << 20
_U = np.uint64


def pack(keys: list, texts: list[bytes]) -> bytes:
    """Documents as compressed bytes; a key may be None."""
    import zstandard

    ok = np.array([k is not None for k in keys], np.uint8)
    k = np.array([k or 0 for k in keys], "<i8")
    n = np.fromiter(map(len, texts), "<i8", len(texts))
    head = np.array([len(texts)], "<i8").tobytes()
    return zstandard.ZstdCompressor(level=3).compress(head + ok.tobytes() + k.tobytes() + n.tobytes() + b"".join(texts))


def unpack(data: bytes) -> tuple[list, list[bytes]]:
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(data)
    n = int(np.frombuffer(raw, "<i8", 1)[0])
    ok = np.frombuffer(raw, np.uint8, n, 8)
    k = np.frombuffer(raw, "<i8", n, 8 + n).tolist()
    ends = (np.cumsum(np.frombuffer(raw, "<i8", n, 8 + 9 * n)) + 8 + 17 * n).tolist()
    return [x if v else None for x, v in zip(k, ok, strict=True)], [raw[a:b] for a, b in zip([8 + 17 * n, *ends], ends, strict=False)]


def load(path: str) -> tuple[list, list[bytes]]:
    """The documents (keys, texts) of a block."""
    from pyarrow import fs

    system, at = fs.FileSystem.from_uri(path)
    with system.open_input_stream(at) as f:
        return unpack(f.read())


def blocks(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = BLOCK_BYTES) -> DataFrame:
    """A written table (block, n_bytes, path) of all documents; a null text counts as empty."""
    folder = shared.shared_folder(docs.sparkSession, "block-files")

    def run(batches):
        from pyspark import TaskContext

        number, keys, texts, held = TaskContext.get().partitionId() << 32, [], [], 0
        for batch in batches:
            for k, t in zip(batch.column("doc_id").to_pylist(), shared.texts(batch), strict=True):
                if held and held + len(t) > size:
                    yield row(number, held, keys, texts)
                    number, keys, texts, held = number + 1, [], [], 0
                keys.append(k)
                texts.append(t)
                held += len(t) + 64
        if keys:
            yield row(number, held, keys, texts)

    def row(number, held, keys, texts):
        import uuid

        from pyarrow import fs

        path = f"{folder}/{number}-{uuid.uuid4().hex}"
        system, at = fs.FileSystem.from_uri(path)
        system.create_dir(at.rsplit("/", 1)[0])
        with system.open_output_stream(at) as f:
            f.write(pack(keys, texts))
        return pa.RecordBatch.from_pydict({"block": [number], "n_bytes": [held], "path": [path]})

    return shared.written(shared.keyed(docs, key, text).mapInArrow(run, "block long, n_bytes long, path string"), "blocks")


def spread(held: DataFrame) -> int:
    """Tasks for work on all blocks: one a block, within bounds set by the shuffle partitions."""
    n = int(held.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(n, min(held.count(), 64 * n))


def bucket_count(held: DataFrame) -> int:
    """Buckets for a table of blocks: in proportion to its bytes, and one for each shuffle partition at least."""
    total = held.agg(F.sum("n_bytes")).first()[0] or 0
    return max(int(held.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // BUCKET_BYTES))


def pack_sorted(a: np.ndarray) -> bytes:
    """Sorted 64-bit numbers, by their differences, byte planes apart."""
    import zstandard

    d = np.diff(a, prepend=_U(0)).astype("<u8")
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(d.view(np.uint8).reshape(-1, 8).T).tobytes())


def unpack_sorted(data: bytes) -> np.ndarray:
    import zstandard

    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(raw.T).view("<u8").ravel().astype(_U), dtype=_U)


def _cuts(keys: np.ndarray, buckets: int, low: int = 0) -> np.ndarray:
    """Where each bucket's slice of sorted keys begins, and the end; keys that differ in the low bits only stay together."""
    edge = np.array([(b << 64) // buckets >> low << low for b in range(1, buckets)], _U)
    return np.concatenate([[0], np.searchsorted(keys, edge), [len(keys)]])


_SLICES = "bucket int, block long, keys binary, numbers binary"


def slices(block: int, keys: np.ndarray, numbers: np.ndarray | None, buckets: int, low: int = 0) -> Iterator[dict]:
    """Rows of a block's sorted distinct keys and the numbers that go with them."""
    cut = _cuts(keys, buckets, low)
    full = np.flatnonzero(np.diff(cut)).tolist()
    for lo in range(0, len(full), 64):
        some = full[lo : lo + 64]
        yield {
            "bucket": some,
            "block": [block] * len(some),
            "keys": [pack_sorted(keys[cut[b] : cut[b + 1]]) for b in some],
            "numbers": [None if numbers is None else numbers[cut[b] : cut[b + 1]].tobytes() for b in some],
        }


def asked(held: DataFrame, buckets: int, ask: Callable[[list, list[bytes]], tuple[np.ndarray, np.ndarray | None]], low: int = 0) -> DataFrame:
    """Slices of all blocks.  ask: the sorted distinct keys of a block's documents (keys, texts), and numbers that go with them or None.

    Keys that differ in the low bits only go to one bucket.
    """

    def out(batch):
        for block, path in zip(batch.column("block").to_pylist(), batch.column("path").to_pylist(), strict=True):
            yield from slices(block, *ask(*load(path)), buckets, low)

    return shared.arrow(held.select("block", "path").repartition(spread(held), "block"), out, _SLICES)


def by_bucket(asked: DataFrame, work: Callable[[int, list[int], list[np.ndarray], list[bytes]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """work: from a bucket, the blocks that ask there, their slices and their numbers (as bytes) to rows."""

    def run(batches):
        now, rows = None, []

        def put():
            return work(now, [b for b, _, _ in rows], [unpack_sorted(k) for _, k, _ in rows], [n or b"" for _, _, n in rows])

        for batch in batches:
            for bucket, block, k, n in zip(*(batch.column(c).to_pylist() for c in ("bucket", "block", "keys", "numbers")), strict=True):
                if bucket != now and rows:
                    yield from put()
                    rows = []
                now = bucket
                rows.append((block, k, n))
        if rows:
            yield from put()

    return asked.repartition("bucket").sortWithinPartitions("bucket", "block").mapInArrow(run, schema)


def answered(asked: DataFrame, answer: Callable[[list[np.ndarray], list[bytes], list[int]], tuple[list[bytes], tuple[int, int]]]) -> DataFrame:
    """Rows (block, part, data, x, y): the answer to each slice, and two figures of each part in one of its rows.

    answer: from the slices of all blocks, their numbers (as bytes) and the blocks to an answer for each and the part's two figures.
    """

    def work(bucket, asking, keys, numbers):
        got, (x, y) = answer(keys, numbers, asking)
        yield pa.RecordBatch.from_pydict({"block": pa.array(asking, pa.int64()), "part": pa.array([bucket] * len(got), pa.int32()), "data": pa.array(got, pa.binary()), "x": pa.array([x] + [0] * (len(got) - 1), pa.int64()), "y": pa.array([y] + [0] * (len(got) - 1), pa.int64())})

    return by_bucket(asked, work, "block long, part int, data binary, x long, y long")


def with_answers(held: DataFrame, answered: DataFrame, use: Callable[[int, list, list[bytes], list[bytes]], Iterator[dict]], schema: str) -> DataFrame:
    """use: from a block, its documents and its answers, in the order of its keys, to columns of rows."""
    both = held.select("block", F.lit(-1).alias("part"), F.col("path").cast("binary").alias("data")).unionByName(answered.select("block", "part", "data"))
    want = shared.arrow_schema(held.sparkSession, schema)

    def work(batches):
        now, path, parts = None, None, []

        def put():
            for out in use(now, *load(path.decode()), parts):
                yield pa.RecordBatch.from_pydict(out, schema=want)

        for batch in batches:
            for block, part, x in zip(*(batch.column(c).to_pylist() for c in ("block", "part", "data")), strict=True):
                if part == -1:
                    if path is not None:
                        yield from put()
                    now, path, parts = block, x, []
                elif block != now:
                    raise ValueError("an answer without its block")
                else:
                    parts.append(x)
        if path is not None:
            yield from put()

    return both.repartition(spread(held), "block").sortWithinPartitions("block", "part").mapInArrow(work, schema)
