"""Token-id files with keyed access.

Shards hold raw little-endian ids of documents in ascending key order (null
keys first, equal keys by the text's hash), 2 bytes an id where the vocabulary
allows it, else 4:

    ids | end of each document, in ids (u64) | footer

The footer is ``<Q n_documents><Q n_ids><I width><4s BTID>``.  Files are only
appended to, so any store that pyarrow.fs knows will do.

The index maps a document's key to the place of its ids.  Keys are dealt into
buckets by hash; a bucket's file holds a minimal perfect hash function (levels
of bit arrays: a key sits on the first level where it is alone, its number is
the rank of its bit) and for each number the key's fingerprint, shard, ordinal
in the shard and number of documents.  A look-up of one key (`ids_of`) reads a
few words by their places: per level a bit with the 512 around it, whose rank
is stored, then the entry and the document's ends; many keys at once
(`lookup`) are dealt by bucket, and a task reads each bucket once.  A key that was never stored
is refused by its 32-bit fingerprint (wrongly accepted once in 2**32).

Where a task is run twice, each try writes files of its own; the manifest,
itself a table in the shared folder, names those of the try that counted.

Nulls: a null text has only the end id; a null key is a key like others.
Repeated keys: the entry gives the first of them and their number, and they
are adjacent.  An empty table gives no shard and an empty result.  Very long
texts are encoded whole; other columns, of whatever name, are not read.
"""

from __future__ import annotations

import os
import re
import struct
import uuid
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared
from .pieces import PieceIds
from .shared import file_system
from .words import EXACT, LOWER, Words, mix, pieces

_FOOTER = "<QQI4s"
_MAGIC = b"BTID"
_STEP = 1 << 21
_U = np.uint64
#: Keys in one file of the index.
BUCKET_KEYS = 1 << 16
#: Bits of a perfect hash for which the rank of the first is stored.
_SAMPLE = 512
_PLAIN = re.compile("[a-z]+")
_LETTERS = re.compile("[a-zªµºÀ-ÖØ-öø-ɏ]+")


# encoding


class WordIds:
    """Ids of texts by a tokenizer of the tokenizers library that drops white space.

    New words are encoded by the library: words of plain letters, perhaps with
    one mark behind them, are one token of its split and go to its model at
    once; all others go through its whole course.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        from .bytebpe import byte_characters

        self.tokenizer = Tokenizer.from_file(path)
        self.size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        show = byte_characters()
        self._show = [show[b] for b in range(256)]
        token = self.tokenizer.model.tokenize
        self._marks = {c: [t.id for t in token(c)] for c in ".,;:!?"}
        self._pieces = PieceIds(self._ids, 700_000)

    def _ids(self, words: list[str]) -> list[list[int]]:
        token, marks, show, norm = self.tokenizer.model.tokenize, self._marks, self._show, self.tokenizer.normalizer.normalize_str
        out: list = [None] * len(words)
        rest = []
        for i, w in enumerate(words):
            mark = marks.get(w[-1])
            core = w if mark is None else w[:-1]
            if _PLAIN.fullmatch(core):
                ids = [t.id for t in token(core)]
            elif _LETTERS.fullmatch(core) and _LETTERS.fullmatch(n := norm(core)):
                ids = [t.id for t in token("".join(map(show.__getitem__, n.encode())))]
            else:
                rest.append(i)
                continue
            out[i] = ids if mark is None else ids + mark
        for lo in range(0, len(rest), 2048):
            some = rest[lo : lo + 2048]
            for i, e in zip(some, self.tokenizer.encode_batch_fast([words[i] for i in some], add_special_tokens=False), strict=True):
                out[i] = e.ids
        return out

    def __call__(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, where each text's begin and end)."""
        w = Words(texts, EXACT if any(b"<|" in t for t in texts) else LOWER)  # special tokens have a case
        return self._pieces(w.buf, w.start, w.end, w.first, w.hash)


@lru_cache(maxsize=2)
def load(path: str) -> WordIds:
    return WordIds(path)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


# writing

_MANIFEST = "shard long, path string, n_docs long, n_ids long"


def write_shards(docs: DataFrame, folder: str, path: str | None = None, end_id: int = 1, shards: int | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Encodes every document and writes the shards; gives the manifest (shard, path, n_docs, n_ids, start)."""
    path, spark = path or default_path(), docs.sparkSession
    n = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    d = shared.keyed(docs, key, text).withColumn("tie", F.xxhash64("text"))
    order = [F.asc_nulls_first("doc_id"), F.asc("tie")]
    placed = d.repartitionByRange(n, *order).sortWithinPartitions(*order)

    def run(batches):
        from pyspark import TaskContext

        shard, out, ends, keys, n_ids = TaskContext.get().partitionId(), None, [], [], 0
        coder = load(path)
        width = 2 if max(coder.size, end_id + 1) <= 1 << 16 else 4
        name = f"{folder}/{shard:07d}-{uuid.uuid4().hex}"
        try:
            for batch in batches:
                if not batch.num_rows:
                    continue
                if out is None:
                    fs, at = file_system(name)
                    fs.create_dir(os.path.dirname(at))
                    out = fs.open_output_stream(f"{at}.ids")
                    of_keys = fs.open_output_stream(f"{at}.keys")
                    sink = pa.ipc.new_stream(of_keys, pa.schema([("doc_id", pa.int64())]))
                texts = shared.texts(batch)
                sink.write_batch(pa.record_batch([batch.column("doc_id")], names=["doc_id"]))
                for lo, hi in pieces(texts, _STEP):
                    ids, where = coder(texts[lo:hi])
                    ids = np.insert(ids, where[1:], end_id)
                    out.write(ids.astype(f"<u{width}").tobytes())
                    ends.append(where[1:] + np.arange(1, hi - lo + 1) + n_ids)
                    n_ids += len(ids)
            if out is not None:
                ends = np.concatenate(ends)
                out.write(ends.astype("<u8").tobytes())
                out.write(struct.pack(_FOOTER, len(ends), n_ids, width, _MAGIC))
                yield pa.RecordBatch.from_pydict({"shard": [shard], "path": [name], "n_docs": [len(ends)], "n_ids": [n_ids]})
        finally:
            if out is not None:
                out.close()
                sink.close()
                of_keys.close()

    made = shared.written(placed.select("doc_id", "text").mapInArrow(run, _MANIFEST), "manifest")
    rows, start = [], 0  # one row a shard: small whatever the corpus
    for r in made.orderBy("shard").collect():
        rows.append((r.shard, r.path, r.n_docs, r.n_ids, start))
        start += r.n_ids
    return spark.createDataFrame(rows, _MANIFEST + ", start long")


class Shard:
    """Reader of one shard file."""

    def __init__(self, name: str):
        fs, at = file_system(name + ".ids")
        self.file = fs.open_input_file(at)
        size = self.file.size()
        self.n_docs, self.n_ids, self.width, magic = struct.unpack(_FOOTER, self.file.read_at(struct.calcsize(_FOOTER), size - struct.calcsize(_FOOTER)))
        if magic != _MAGIC:
            raise ValueError(f"{name}.ids is no token-id file")

    def __enter__(self):
        return self

    def __exit__(self, *_):
        self.file.close()

    def bounds(self, i: int, n: int = 1) -> np.ndarray:
        """Begin of document i and ends of it and the next n - 1."""
        lo = max(0, i - 1)
        got = np.frombuffer(self.file.read_at(8 * (i + n - lo), self.n_ids * self.width + 8 * lo), "<u8").astype(np.int64)
        return got if i else np.concatenate([[0], got])

    def ids(self, begin: int, end: int) -> np.ndarray:
        return np.frombuffer(self.file.read_at((end - begin) * self.width, begin * self.width), f"<u{self.width}").astype("<u4")


# the index


def key_hash(keys: np.ndarray, valid: np.ndarray) -> np.ndarray:
    """64-bit hash of nullable integer keys."""
    h = mix(np.where(valid, keys, 0).astype(np.int64).view(_U) ^ _U(0xA0761D6478BD642F))
    h[~valid] = _U(0x1B873593CC9E2D51)
    return h


class PerfectHash:
    """Numbers 0 to n - 1 for n distinct 64-bit hashes."""

    def __init__(self, sizes: np.ndarray, bits: np.ndarray):
        self.sizes, self.bits = sizes, bits
        self.base = np.concatenate([[0], np.cumsum(sizes)])
        flat = np.unpackbits(bits.view(np.uint8), bitorder="little")
        self.flat, self.rank = flat, np.concatenate([[0], np.cumsum(flat, dtype=np.int64)])

    @classmethod
    def of(cls, h: np.ndarray, room: float = 2.0) -> PerfectHash:
        sizes, parts, left = [], [], h
        while len(left):
            m = -(-int(len(left) * room + 64) // 64) * 64
            at = cls._at(left, len(sizes), m)
            count = np.bincount(at, minlength=m)
            parts.append(np.packbits(count == 1, bitorder="little"))
            sizes.append(m)
            left = left[count[at] != 1]
            if len(sizes) > 200:
                raise ValueError("keys of a perfect hash function must be distinct")
        bits = np.concatenate(parts) if parts else np.zeros(0, np.uint8)
        return cls(np.array(sizes, np.int64), bits)

    @staticmethod
    def _at(h: np.ndarray, level: int, m: int) -> np.ndarray:
        return (mix(h + _U((level + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) % _U(m)).astype(np.int64)

    def __call__(self, h: np.ndarray) -> np.ndarray:
        """The number of each hash; -1 for some that were not among the keys, any number for others."""
        out, left = np.full(len(h), -1, np.int64), np.arange(len(h))
        for level, m in enumerate(self.sizes.tolist()):
            bit = self.base[level] + self._at(h[left], level, m)
            hit = self.flat[bit] == 1
            out[left[hit]] = self.rank[bit[hit]]
            left = left[~hit]
            if not len(left):
                break
        return out


_ENTRY = np.dtype([("fingerprint", "<u4"), ("shard", "<u4"), ("ordinal", "<u8"), ("n_docs", "<u8")])


def _fingerprint(h: np.ndarray) -> np.ndarray:
    return (mix(h ^ _U(0xE7037ED1A0B428DB)) >> _U(32)).astype(np.uint32)


def pack_bucket(h: np.ndarray, shard, ordinal, n_docs) -> bytes:
    mph = PerfectHash.of(h)
    entries = np.zeros(len(h), _ENTRY)
    at = mph(h)
    entries["fingerprint"][at] = _fingerprint(h)
    for name, col in (("shard", shard), ("ordinal", ordinal), ("n_docs", n_docs)):
        entries[name][at] = col
    ranks = mph.rank[: len(mph.flat) : _SAMPLE].astype("<u4") if len(mph.flat) else np.zeros(0, "<u4")
    return struct.pack("<QQ", len(h), len(mph.sizes)) + mph.sizes.astype("<i8").tobytes() + ranks.tobytes() + mph.bits.tobytes() + entries.tobytes()


class Bucket:
    def __init__(self, data: bytes):
        n, levels = struct.unpack_from("<QQ", data)
        sizes = np.frombuffer(data, "<i8", levels, 16)
        at = 16 + 8 * levels + 4 * -(-int(sizes.sum()) // _SAMPLE)
        bits = np.frombuffer(data, np.uint8, int(sizes.sum()) // 8, at)
        self.mph = PerfectHash(sizes, bits)
        self.entries = np.frombuffer(data, _ENTRY, n, at + len(bits))

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(entries, found): found is false for keys that are not in the index."""
        at = self.mph(h)
        if not len(self.entries):
            return np.zeros(len(h), _ENTRY), np.zeros(len(h), bool)
        e = self.entries[np.maximum(at, 0)]
        return e, (at >= 0) & (e["fingerprint"] == _fingerprint(h))


def find_in(file, h: int):
    """The entry of one hash, or None, by a few small reads of an index file: head, a bit's surroundings and rank a level, entry."""
    n, levels = struct.unpack("<QQ", file.read_at(16, 0))
    sizes = np.frombuffer(file.read_at(8 * levels, 16), "<i8")
    total, key = int(sizes.sum()), np.array([h], _U)
    ranks = 16 + 8 * levels
    bits = ranks + 4 * -(-total // _SAMPLE)
    base = 0
    for level, m in enumerate(sizes.tolist()):
        bit = base + int(PerfectHash._at(key, level, m)[0])
        block, inside = divmod(bit, _SAMPLE)
        size = min(_SAMPLE, total - block * _SAMPLE) // 8
        flat = np.unpackbits(np.frombuffer(file.read_at(size, bits + block * _SAMPLE // 8), np.uint8), bitorder="little")
        if flat[inside]:
            rank = int(np.frombuffer(file.read_at(4, ranks + 4 * block), "<u4")[0]) + int(flat[:inside].sum())
            entry = np.frombuffer(file.read_at(_ENTRY.itemsize, bits + total // 8 + rank * _ENTRY.itemsize), _ENTRY)[0]
            return entry if entry["fingerprint"] == _fingerprint(key)[0] else None
        base += m
    return None


def ids_of(folder: str, manifest: list, n_buckets: int, key: int | None) -> list[np.ndarray]:
    """The ids of each document of a key, read by place: constant time for a key, whatever the corpus.

    manifest: its rows (shard, path, ...), one a shard.
    """
    import xxhash

    seed = xxhash.xxh64_intdigest(int(key is None).to_bytes(4, "little"), 42)
    named = seed if key is None else xxhash.xxh64_intdigest(int(key).to_bytes(8, "little", signed=True), seed)
    bucket = (named - (named >> 63 << 64)) % n_buckets
    fs, at = file_system(f"{folder}/index/bucket-{bucket}")
    if fs.get_file_info(at).type.name == "NotFound":
        return []
    h = int(key_hash(np.array([key or 0], np.int64), np.array([key is not None]))[0])
    with fs.open_input_file(at) as f:
        entry = find_in(f, h)
    if entry is None:
        return []
    paths, out = {r.shard: r.path for r in manifest}, []
    shard, ordinal, left = int(entry["shard"]), int(entry["ordinal"]), int(entry["n_docs"])
    while left:
        with Shard(paths[shard]) as s:
            here = min(left, s.n_docs - ordinal)
            b = s.bounds(ordinal, here).tolist()
            out += [s.ids(x, y) for x, y in zip(b, b[1:], strict=False)]
        left, ordinal = left - here, 0
        shard = min((x for x in paths if x > shard), default=shard)
    return out


def _bucket_of(column: str, n: int):
    return F.pmod(F.xxhash64(F.col(column).isNull(), column), F.lit(n)).cast("int")


def _column(batch, name: str) -> tuple[np.ndarray, np.ndarray]:
    c = batch.column(name)
    return c.fill_null(0).to_numpy(zero_copy_only=False), c.is_valid().to_numpy(zero_copy_only=False)


def write_index(manifest: DataFrame, folder: str, n_buckets: int) -> None:
    """Index files ``folder/bucket-<n>`` for all keys of the shards."""

    def keys(batch):
        for shard, name in zip(batch.column("shard").to_pylist(), batch.column("path").to_pylist(), strict=True):
            fs, at = file_system(name + ".keys")
            with fs.open_input_stream(at) as f:
                done = 0
                for part in pa.ipc.open_stream(f):
                    k = part.column("doc_id")
                    yield {"doc_id": k, "shard": [shard] * len(k), "ordinal": np.arange(done, done + len(k))}
                    done += len(k)

    rows = shared.arrow(manifest.select("shard", "path").repartition("shard"), keys, "doc_id long, shard long, ordinal long")
    one = rows.groupBy("doc_id").agg(F.min(F.struct("shard", "ordinal")).alias("p"), F.count(F.lit(1)).alias("n_docs"))
    one = one.select("doc_id", "p.shard", "p.ordinal", "n_docs").withColumn("bucket", _bucket_of("doc_id", n_buckets))

    def build(batches):
        held, now = [], None

        def put():
            t = pa.Table.from_batches(held)
            k, ok = _column(t.combine_chunks().to_batches()[0], "doc_id")
            fs, at = file_system(f"{folder}/bucket-{now}")
            fs.create_dir(os.path.dirname(at))
            own = f"{at}.{uuid.uuid4().hex}"
            with fs.open_output_stream(own) as f:
                f.write(pack_bucket(key_hash(k, ok), *(t.column(c).to_numpy() for c in ("shard", "ordinal", "n_docs"))))
            fs.move(own, at)  # the same bytes whichever try comes last
            return pa.RecordBatch.from_pydict({"bucket": pa.array([now], pa.int32())})

        for batch in batches:
            b = batch.column("bucket").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(b)) + 1).tolist(), len(b)]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                if lo == hi:
                    continue
                if now is not None and b[lo] != now:
                    yield put()
                    held = []
                now = int(b[lo])
                held.append(batch.slice(lo, hi - lo))
        if held:
            yield put()

    done = one.repartition("bucket").sortWithinPartitions("bucket", "doc_id").mapInArrow(build, "bucket int")
    done.write.format("noop").mode("overwrite").save()


def lookup(keys: DataFrame, folder: str, n_buckets: int, key: str = "doc_id") -> DataFrame:
    """doc_id, shard, ordinal, n_docs of those keys that are in the index."""

    def find(batch):
        b = batch.column("bucket").to_numpy()
        k, ok = _column(batch, "doc_id")
        h = key_hash(k, ok)
        cuts = [0, *(np.flatnonzero(np.diff(b)) + 1).tolist(), len(b)]
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            fs, at = file_system(f"{folder}/bucket-{b[lo]}")
            if fs.get_file_info(at).type.name == "NotFound":
                continue
            with fs.open_input_stream(at) as f:
                e, found = Bucket(f.read()).find(h[lo:hi])
            mask = pa.array(found)
            yield {"doc_id": batch.column("doc_id").slice(lo, hi - lo).filter(mask)} | {c: e[c][found].astype(np.int64) for c in ("shard", "ordinal", "n_docs")}

    ks = keys.select(F.col(f"`{key}`").cast("long").alias("doc_id")).withColumn("bucket", _bucket_of("doc_id", n_buckets))
    ks = ks.repartition("bucket").sortWithinPartitions("bucket")
    return shared.arrow(ks, find, "doc_id long, shard long, ordinal long, n_docs long")


def read_back(found: DataFrame, manifest: DataFrame, with_ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (and ids) of looked-up keys, from the files."""
    places = manifest.select("shard", "path", "start", "n_docs").collect()  # one row a shard
    at = {r.shard: (r.path, r.start, r.n_docs) for r in places}
    after = {a.shard: b.shard for a, b in zip(sorted(places), sorted(places)[1:], strict=False)}

    def read(batch):
        out = {c: [] for c in ("doc_id", "start", "n_tokens", "ids_crc32", *["ids"] * with_ids)}
        now = reader = None
        size = 0
        for key, shard, ordinal, n in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "shard", "ordinal", "n_docs")), strict=True):
            while n:
                path, start, n_docs = at[shard]
                if now != shard:
                    if reader is not None:
                        reader.file.close()
                    now, reader = shard, Shard(path)
                here = min(n, n_docs - ordinal, 1024)
                b = reader.bounds(ordinal, here).tolist()
                for lo, hi in zip(b, b[1:], strict=False):
                    ids = reader.ids(lo, hi)
                    for c, v in (("doc_id", key), ("start", start + lo), ("n_tokens", hi - lo), ("ids_crc32", zlib.crc32(ids.tobytes())), *[("ids", ids)] * with_ids):
                        out[c].append(v)
                    size += hi - lo
                if size > 1 << 22 and with_ids:
                    yield out
                    out, size = {c: [] for c in out}, 0
                n, ordinal = n - here, ordinal + here
                if n and ordinal == n_docs:
                    shard, ordinal = after[shard], 0
        if reader is not None:
            reader.file.close()
        yield out

    f = found.repartitionByRange("shard", "ordinal").sortWithinPartitions("shard", "ordinal")
    return shared.arrow(f, read, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids)


def round_trip(docs: DataFrame, path: str | None = None, end_id: int = 1, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Writes shards and index of all documents below spark.checkpoint.dir and reads each document back by its key."""
    folder, manifest, n_buckets = write_files(docs, path, end_id, key, text)
    keys = docs.select(F.col(f"`{key}`").cast("long").alias("doc_id")).distinct()
    return read_back(lookup(keys, f"{folder}/index", n_buckets), manifest)


def write_files(docs: DataFrame, path: str | None = None, end_id: int = 1, key: str = "doc_id", text: str = "text") -> tuple[str, DataFrame, int]:
    """(folder, manifest, buckets) of the shards and the index of all documents."""
    spark: SparkSession = docs.sparkSession
    folder = shared.shared_folder(spark, "tokens")
    manifest = write_shards(docs, f"{folder}/shards", path, end_id, None, key, text)
    total = sum(r.n_docs for r in manifest.select("n_docs").collect())
    n_buckets = max(1, -(-total // BUCKET_KEYS))
    write_index(manifest, f"{folder}/index", n_buckets)
    return folder, manifest, n_buckets
