"""Sources on hand-made files: order, counts, malformed rows, any file system that Spark or pyarrow reads."""

import gzip
import os

import numpy as np
import pytest

from batchtide.sources import binary, text

HEAD = ",".join(text.CSV_COLUMNS)


def row(clock, oid, size="2", side="True"):
    return f"{clock},7,False,1,{side},1.5,0,{oid},0,0,False,False,False,False,False,0,1,0,{size},open,Limit,Gtc"


def put(path, lines):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    data = "\n".join(lines) + "\n"
    with (gzip.open(path, "wt") if path.endswith(".gz") else open(path, "w")) as f:
        f.write(data)


@pytest.fixture
def folder(tmp_path):
    put(f"{tmp_path}/d/2025-12-01/a_00.csv", [HEAD, row("2025-12-01 00:00:01", 1), "broken", row("2025-12-01 00:00:02", 2, "0"), row("2025-12-01 00:00:03", 3, side="maybe")])
    put(f"{tmp_path}/d/2025-12-01/b_01.csv", [HEAD] + [row(f"2025-12-01 01:00:{i % 60:02d}", 100 + i) for i in range(500)])
    put(f"{tmp_path}/d/2025-12-02/a_00.csv.gz", [HEAD, row("2025-12-02 00:00:01", 900)])
    put(f"{tmp_path}/d/2025-12-02/z_00.csv", ["ts,px", "1,2", "3,4"])
    put(f"{tmp_path}/d/2025-12-02/notes.txt", ["no"])
    return f"{tmp_path}/d"


def test_csv_files_in_order(spark, folder):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")  # b_01 in parts, small files together
    try:
        got = [(r.seq >> 36, r.seq & 0xFFFFFFFF, r.oid) for r in text.read_order_csv(spark, folder).orderBy("seq").collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == [(0, 0, 1), (0, 2, 2), *((1, i, 100 + i) for i in range(500)), (2, 0, 900)]


def test_csv_counts(spark, folder):
    got = {"/".join(r.file.split("/")[-2:]): (r.seen, r.malformed, r.skipped, r.dropped, r.first_ts) for r in text.csv_counts(spark, folder).collect()}
    at = 1764547201 * 10**9
    assert got == {
        "2025-12-01/a_00.csv": (2, 2, 1, False, at),
        "2025-12-01/b_01.csv": (500, 0, 0, False, at + 3599 * 10**9),
        "2025-12-02/a_00.csv.gz": (1, 0, 0, False, at + 86400 * 10**9),
        "2025-12-02/z_00.csv": (0, 0, 0, True, None),
    }


def test_binary_report(spark, tmp_path):
    binary.register(spark)
    rows = np.zeros(5, binary.RECORD)
    rows["ts"], rows["status_id"], rows["oid"] = 1764547201 * 10**9, 1, np.arange(5)
    rows["orig_sz"] = [0, 3, 4, 0, 5]
    binary.write_records(f"{tmp_path}/in/d1/a_00.data.gz", rows)
    with open(f"{tmp_path}/in/d1/a_00.data.gz", "ab") as f:  # a second member
        f.write(gzip.compress(rows[:2].tobytes()))
    binary.write_records(f"{tmp_path}/in/d1/b_00.data", np.zeros(2, binary.RECORD))
    load = spark.read.format("orderbin")
    got = {r.file: (r.seen, r.skipped, r.dropped) for r in load.option("report", "true").load(f"{tmp_path}/in").collect()}
    assert got == {"d1/a_00.data.gz": (7, 3, False), "d1/b_00.data": (0, 0, True)}
    assert spark.read.format("orderbin").load(f"{tmp_path}/in").count() == 7
    with pytest.raises(Exception, match="begin with a record"):
        spark.read.format("orderbin").option("strict", "true").load(f"{tmp_path}/in").collect()


def test_small_readers(spark, tmp_path):
    put(f"{tmp_path}/l/status.csv", ["open,1", "filled,5"])
    assert {tuple(r) for r in text.read_lookup(spark, f"{tmp_path}/l/status.csv").collect()} == {("open", 1), ("filled", 5)}
    put(f"{tmp_path}/c/candles.json", ['{"timestamp": [1, 2], "open": [1.0, 2.0], "high": [3.0, 4.0], "low": [0.5, 1.5], "close": [2.0, 3.0]}'])
    assert [tuple(r) for r in text.read_candles(spark, f"{tmp_path}/c/candles.json").orderBy("ts").collect()] == [(1, 1.0, 3.0, 0.5, 2.0), (2, 2.0, 4.0, 1.5, 3.0)]
    d = spark.createDataFrame([("5;2;9;90;spread=3:6.0:1.0:3.0;depth=0:0:nan:nan",)], "b string")
    assert [(x.metric, x.n, x.total) for x in d.select(text.parse_summary_blob(d.b).alias("x")).first().x] == [("spread", 3, 6.0), ("depth", 0, 0.0)]
    text.write_results(spark.range(3), f"{tmp_path}/out")
    assert spark.read.json(f"{tmp_path}/out").count() == 3
