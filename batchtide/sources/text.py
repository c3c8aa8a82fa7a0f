"""Text sources: order records as CSV, lookups, interval tables, key-value files, candles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..schemas import INTERVAL_COLUMNS

#: The 22 columns of the record CSV, in order (fixed values).
CSV_COLUMNS = [
    "ts", "userId", "isBuilder", "statusId", "isAsk", "limitPx", "sz", "oid", "timestampDiff", "triggerCondition", "triggered", "isTrigger", "hasChildren",
    "isPositionTpsl", "reduceOnly", "orderTypeId", "tifId", "triggerPx", "origSz", "status", "orderType", "tif",
]


def scan_order_csv(spark: SparkSession, path: str) -> DataFrame:
    """Rows of the CSV files (.csv, or .gz) below a path, as text, with file, seq and good.

    Files follow one another by name.  A large file is read in parts; its rows are
    numbered by part and place, so seq is (rank of the file, row) whatever Spark
    packs together.  good is false for the rows of a file whose header has too
    few columns, and for rows that have; the headers themselves are left out.
    """
    n = len(CSV_COLUMNS)
    raw = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.{csv,gz}").text(path)
    raw = raw.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_part"), F.monotonically_increasing_id().alias("_id"))
    parts = raw.groupBy("file", "_part").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
    along = Window.partitionBy("file").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("_base", F.coalesce(F.sum("_n").over(along), F.lit(0)))
    files = parts.groupBy("file").agg(F.lit(1)).select("file", (F.row_number().over(Window.orderBy("file")) - 1).cast("long").alias("_rank"))  # a row a file
    d = raw.join(parts.select("file", "_part", "_first", "_base"), ["file", "_part"]).join(files, "file").withColumn("_row", F.col("_base") + F.col("_id") - F.col("_first"))
    columns = F.size(F.split("value", ",", -1))
    heads = d.where("_row = 0").select("file", (columns >= n).alias("_headed"))
    d = d.where((F.col("_row") > 0) & (F.trim("value") != "")).join(heads, "file")
    cells = F.from_csv("value", ", ".join(f"`{c}` string" for c in CSV_COLUMNS), {"mode": "PERMISSIVE"}).alias("c")
    # a row with more columns than the known ones is whole
    d = d.select(cells, "file", (F.shiftleft("_rank", 36) + F.col("_row") - 1).alias("seq"), "_headed", (F.col("_headed") & (columns >= n)).alias("good"))
    return d.select("c.*", "file", "seq", "_headed", "good")


def read_order_csv(spark: SparkSession, path: str, coin: str = "") -> DataFrame:
    """Records of well-formed rows, in order of seq; every column is read as text and parsed exactly."""
    return parse_order_rows(scan_order_csv(spark, path).where("good").withColumnsRenamed({"file": "_file", "seq": "_row"}), coin)


def csv_counts(spark: SparkSession, path: str) -> DataFrame:
    """(file, seen, malformed, skipped, dropped, first_ts) of each file.

    seen: well-formed rows, those without a size (skipped) included; dropped:
    the header has too few columns; first_ts: the first time among the first 256 rows.
    """
    rows = scan_order_csv(spark, path)
    parsed = parse_order_rows(rows.where("good").withColumnsRenamed({"file": "_file", "seq": "_row"})).select("file", "seq", "ts", "orig_sz")
    j = rows.select("file", "seq", "_headed").join(parsed, ["file", "seq"], "left")
    early = F.when(F.col("ts").isNotNull() & (F.col("seq").bitwiseAND(F.lit((1 << 36) - 1)) < 256), F.col("seq"))
    return j.groupBy("file").agg(
        F.count("ts").alias("seen"), F.count_if(F.col("_headed") & F.col("ts").isNull()).alias("malformed"), F.count_if(F.col("orig_sz") == 0).alias("skipped"),
        (~F.bool_and("_headed")).alias("dropped"), F.min_by("ts", early).alias("first_ts"),
    )


def parse_order_rows(raw: DataFrame, coin: str = "") -> DataFrame:
    t = lambda c: F.trim(F.col(c))
    no: Column = F.lit(False)
    d = raw.select(
        F.lit(coin).alias("coin"), F.col("_row").alias("seq"), F.col("_file").alias("file"), S.parse_timestamp(t("ts")).alias("ts"), t("userId").alias("user_id"), no.alias("is_builder"),
        t("statusId").try_cast("int").alias("status_id"), S.parse_bool(t("isAsk")).alias("is_ask"), S.parse_fixed_point(t("limitPx")).alias("limit_px"),
        S.round_to_unit(t("origSz")).alias("sz"), t("oid").try_cast("long").alias("oid"), F.lit(0).cast("long").alias("timestamp_diff"), F.lit(0).cast("long").alias("trigger_condition"),
        no.alias("triggered"), S.parse_bool(t("isTrigger")).alias("is_trigger"), no.alias("has_children"), no.alias("is_position_tpsl"), no.alias("reduce_only"),
        t("orderTypeId").try_cast("int").alias("order_type_id"), t("tifId").try_cast("int").alias("tif_id"), F.lit(0).cast("long").alias("trigger_px"), S.round_to_unit(t("origSz")).alias("orig_sz"),
        S.non_empty(F.col("status")).alias("status_label"), S.non_empty(F.col("orderType")).alias("order_type_label"), S.non_empty(F.col("tif")).alias("tif_label"),
    )
    return d.na.drop(subset=["ts", "status_id", "is_ask", "limit_px", "oid", "is_trigger", "order_type_id", "tif_id", "orig_sz"])


def read_lookup(spark: SparkSession, path) -> DataFrame:
    """(label, id) of a file without a header."""
    return spark.read.schema("label string, id int").csv(path)


def read_intervals(spark: SparkSession, path) -> DataFrame:
    """An interval table; empty fields are null."""
    kinds = {"engine": "string", "interval_start_ns": "long", "interval_width_ns": "long", "trade_count": "long"}
    return spark.read.schema(", ".join(f"{c} {kinds.get(c, 'double')}" for c in INTERVAL_COLUMNS)).csv(path, header=True)


def rescaled(intervals: DataFrame) -> DataFrame:
    """Prices and what has the dimension of a price in whole units."""
    return intervals.withColumns({c: F.col(c) / S.UNIT for c in ("vwap", "executed_notional", "trader_surplus")})


def read_key_values(spark: SparkSession, path) -> DataFrame:
    """(key, value) of lines of a key, a space, and the rest."""
    t = spark.read.text(path).where(F.trim("value") != "")
    return t.select(F.substring_index("value", " ", 1).alias("key"), F.regexp_replace("value", r"^\S+\s*", "").alias("value"))


def parse_summary_blob(blob: Column) -> Column:
    """Metrics of 'rows;trades;volume;notional;name=n:sum:min:max;...' as an array of structs."""
    parts = F.slice(F.split(blob, ";"), 5, 1_000)

    def one(x):
        v = F.split(F.substring_index(x, "=", -1), ":")
        at = lambda i: F.get(v, F.lit(i))
        return F.struct(F.substring_index(x, "=", 1).alias("metric"), at(0).try_cast("long").alias("n"), at(1).try_cast("double").alias("total"), at(2).try_cast("double").alias("min"), at(3).try_cast("double").alias("max"))

    return F.transform(F.filter(parts, lambda x: F.contains(x, F.lit("="))), one)


def read_candles(spark: SparkSession, path) -> DataFrame:
    """(ts, open, high, low, close) of a JSON with parallel arrays."""
    j = spark.read.option("multiLine", True).schema("timestamp array<long>, open array<double>, high array<double>, low array<double>, close array<double>").json(path)
    return j.select(F.explode(F.arrays_zip("timestamp", "open", "high", "low", "close")).alias("c")).select(F.col("c.timestamp").alias("ts"), "c.open", "c.high", "c.low", "c.close")


def write_results(d: DataFrame, path: str) -> None:
    """A table of results as JSON lines."""
    d.write.mode("overwrite").json(path)


def write_intervals(d: DataFrame, path: str) -> None:
    """CSV, a folder for each engine, six decimals, null as empty."""
    text = [c for c in INTERVAL_COLUMNS if c in ("engine", "interval_start_ns", "interval_width_ns", "trade_count")]
    out = d.select(F.col("engine").alias("of"), *[F.col(c).cast("string").alias(c) if c in text else S.fixed(F.col(c)).alias(c) for c in INTERVAL_COLUMNS])
    out.write.mode("overwrite").partitionBy("of").option("header", True).option("emptyValue", "").csv(path)
