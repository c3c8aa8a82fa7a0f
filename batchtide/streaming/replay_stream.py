"""The replay as a Structured Streaming query.

Records are keyed by coin; each coin's engines live in its state, so a restart
from the checkpoint goes on exactly where it was.  Rows of a micro-batch are
sorted by seq before they are applied; micro-batches must come in seq order,
which a file source with one file a trigger gives.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.replay import _KINDS, Replay, prepared, tagged_schema
from ..schemas import names

LATE = "35 seconds"


class _Engines(StatefulProcessor):
    def __init__(self, width: int, engines: tuple[str, ...], kinds: dict[str, str]):
        self.width, self.engines, self.kinds = width, engines, kinds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("replay", "data binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:  # noqa: N802
        got = self.state.get() if self.state.exists() else None
        r = pickle.loads(got[0]) if got else Replay(key[0], self.width, self.engines)
        d = pd.concat(list(rows)).sort_values("seq", kind="stable")
        limit = [None if pd.isna(x) else int(x) for x in d["limit"]]
        for seq, ts, oid, ask, lim, q, u, live, gone in zip(d.seq, d.ts, d.oid, d.is_ask, limit, d.orig_sz, d.user_id, d.live, d.cancel, strict=True):
            r.record(int(seq), int(ts), int(oid), bool(ask), lim, int(q), u, bool(live), bool(gone))
        out = {kind: r.columns(kind) for kind in _KINDS}
        self.state.update((pickle.dumps(r, protocol=5),))
        for kind, ddl in _KINDS.items():
            if out[kind]:
                part = pd.DataFrame(out[kind], columns=names(ddl), dtype=object)
                part["kind"] = kind
                part = part.reindex(columns=list(self.kinds))
                yield part.astype({c: {"long": "Int64", "boolean": "boolean"}.get(k, "object") for c, k in self.kinds.items()})

    def close(self) -> None:
        pass


def replay_stream(events: DataFrame, width: int, engines: tuple[str, ...] = ("cda", "fba")) -> DataFrame:
    """Tagged rows, as the batch replay gives them before its last batch is closed."""
    schema = tagged_schema()
    return prepared(events).groupBy("coin").transformWithStateInPandas(_Engines(width, engines, dict(c.split() for c in schema.split(", "))), schema, "Append", "None")


def interval_volumes(trades: DataFrame, width: str) -> DataFrame:
    """Volume, notional and count by coin, engine and interval of event time, emitted when the watermark (35 s) has passed."""
    t = trades.withColumn("at", F.timestamp_micros(F.floor(F.col("ts") / 1000).cast("long"))).withWatermark("at", LATE)
    total = F.sum(F.col("quantity").cast("decimal(38,0)") * F.col("price")).alias("notional")
    return t.groupBy("coin", "engine", F.window("at", width).alias("interval")).agg(F.sum("quantity").alias("volume"), total, F.count(F.lit(1)).alias("trades"))
