"""Source of packed order records: 54-byte little-endian, in files that may be gzip, one partition a file.

``spark.read.format("orderbin").load(path)`` after ``register(spark)``, from any
store that pyarrow.fs knows.  Paths are listed on the driver and sorted by name,
which puts a coin's hours in order and accepted records before rejected ones;
``seq`` is (rank of the file, row).  With the option ``report`` the rows are the
files: records seen, those without a size, and whether the file was dropped
because its first record is none.  With ``strict`` a dropped file is an error.
"""

from __future__ import annotations

import gzip
import os
from contextlib import nullcontext

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from ..schemas import ORDER_EVENTS, arrow

#: Fixed layout of a record.
RECORD = np.dtype([
    ("ts", "<u8"), ("user_id", "<u4"), ("is_builder", "u1"), ("status_id", "u1"), ("is_ask", "u1"), ("limit_px", "<u4"), ("sz", "<u4"), ("oid", "<u8"),
    ("timestamp_diff", "<u4"), ("trigger_condition", "<u4"), ("triggered", "u1"), ("is_trigger", "u1"), ("has_children", "u1"), ("is_position_tpsl", "u1"),
    ("reduce_only", "u1"), ("order_type_id", "u1"), ("tif_id", "u1"), ("trigger_px", "<u4"), ("orig_sz", "<u4"),
])
assert RECORD.itemsize == 54
#: A plausible first record: time from 2020 to 2035 and known codes.
FIRST_TS, LAST_TS, TOP = 1577836800 * 10**9, 2051222400 * 10**9, {"status_id": 17, "order_type_id": 6, "tif_id": 5}
_ROWS = 1 << 16
#: Rows of a report.
REPORT = "file string, coin string, seen long, skipped long, dropped boolean"


#: By number of decimal digits (the top three bits of a packed number): what turns its count into millionths.
_TIMES = np.array([10**6, 10**5, 10**4, 10**3, 10**2, 10, 1, 1], np.int64)
_OVER = np.array([1, 1, 1, 1, 1, 1, 1, 10], np.int64)


def unpack_price(p: np.ndarray, signed: bool = False) -> np.ndarray:
    """Millionths of packed numbers: digits in 3 bits, if signed a sign bit, and a count; a seventh digit is rounded, halves up."""
    whole = p.astype(np.int64)
    count_bits = 28 if signed else 29
    digits = np.right_shift(whole, 29)
    count = np.bitwise_and(whole, 2**count_bits - 1)
    millionths = (count * _TIMES[digits] + _OVER[digits] // 2) // _OVER[digits]
    if signed:
        millionths *= 1 - 2 * np.bitwise_and(np.right_shift(whole, 28), 1)
    return millionths


def unpack_quantity(p: np.ndarray) -> np.ndarray:
    return (unpack_price(p) + 500_000) // 1_000_000


def plausible(records: np.ndarray) -> bool:
    if not len(records):
        return True
    r = records[0]
    return FIRST_TS <= r["ts"] < LAST_TS and all(r[k] <= v for k, v in TOP.items())


def decode(records: np.ndarray, coin: str, file: str, seq: int, want: pa.Schema) -> pa.RecordBatch:
    cols = {}
    for name in RECORD.names:
        v = records[name]
        kind = want.field(name).type
        if name in ("limit_px", "trigger_px"):
            v = unpack_price(v)
        elif name == "trigger_condition":
            v = unpack_price(v, True)
        elif name in ("sz", "orig_sz"):
            v = unpack_quantity(v)
        elif pa.types.is_boolean(kind):
            v = v != 0
        elif name == "user_id":
            v = pa.array(v.astype(np.int64)).cast(pa.string())
        cols[name] = v if isinstance(v, pa.Array) else pa.array(np.ascontiguousarray(v)).cast(kind)
    n = len(records)
    cols |= {"coin": pa.array([coin] * n), "file": pa.array([file] * n), "seq": pa.array(np.arange(seq, seq + n))}
    return pa.RecordBatch.from_arrays([cols[f.name] for f in want], schema=want)


class _File(InputPartition):
    def __init__(self, path: str, rank: int):
        super().__init__(rank)
        self.path, self.rank = path, rank


class OrderBinary(DataSource):
    @classmethod
    def name(cls) -> str:
        return "orderbin"

    def schema(self) -> str:
        return REPORT if self.options.get("report", "false").lower() == "true" else ORDER_EVENTS

    def reader(self, schema: StructType):
        return _Reader(self.options)


def listed(root: str) -> list[str]:
    """Files of records below a path, by name."""
    from pyarrow import fs

    system, at = fs.FileSystem.from_uri(root)
    if system.get_file_info(at).type == fs.FileType.File:
        return [root]
    found = [i.path for i in system.get_file_info(fs.FileSelector(at, recursive=True)) if i.type == fs.FileType.File and i.path.endswith((".data", ".gz"))]
    return sorted(root[: len(root) - len(at)] + p if root.endswith(at) else p for p in found)


class _Reader(DataSourceReader):
    def __init__(self, options):
        yes = lambda name: options.get(name, "false").lower() == "true"
        self.root, self.strict, self.report = options["path"], yes("strict"), yes("report")

    def partitions(self):
        return [_File(p, i) for i, p in enumerate(listed(self.root))]

    def read(self, part: _File):
        from pyarrow import fs

        want = arrow(REPORT if self.report else ORDER_EVENTS)
        folder, name = part.path.rstrip("/").split("/")[-2:]
        file, coin, seq = f"{folder}/{name}", name.split("_")[0], part.rank << 36
        seen = skipped = 0
        dropped = False
        system, at = fs.FileSystem.from_uri(part.path)
        with system.open_input_stream(at, compression=None) as raw, (gzip.GzipFile(fileobj=raw) if at.endswith(".gz") else nullcontext(raw)) as f:
            while data := f.read(_ROWS * RECORD.itemsize):
                if len(data) % RECORD.itemsize:
                    raise ValueError(f"{part.path} ends within a record")
                records = np.frombuffer(data, RECORD)
                if not seen and not plausible(records):
                    if self.strict:
                        raise ValueError(f"{part.path} doesn't begin with a record")
                    dropped = True
                    break
                seen += len(records)
                skipped += int((unpack_quantity(records["orig_sz"]) == 0).sum())
                if not self.report:
                    yield decode(records, coin, file, seq, want)
                seq += len(records)
        if self.report:
            yield pa.RecordBatch.from_arrays([pa.array([v], t.type) for v, t in zip((file, coin, seen, skipped, dropped), want, strict=True)], schema=want)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(OrderBinary)


def write_records(path: str, rows: np.ndarray) -> None:
    """A file of packed records, for fixtures."""
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with (gzip.open if path.endswith(".gz") else open)(path, "wb") as f:
        f.write(rows.astype(RECORD).tobytes())
