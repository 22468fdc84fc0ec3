"""Streams: KPI windows, the adaptive window with state, and upserts of micro-batches."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from gaugeworks.operators.adwin import DELTA, MAX_WINDOW, advance
from gaugeworks.session import prepare
from gaugeworks.sources.store import TableStore

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def event_time(df: DataFrame, column: str = "ts") -> DataFrame:
    """Watermarks need a timestamp with a zone; event times are stored without one and mean UTC."""
    return df.withColumn(column, F.col(column).cast("timestamp"))


def stream_kpi_windows(
    stream: DataFrame, aggregates: dict[str, Column], keys: Sequence[str] = (), ts: str = "ts", window: str = "1 day",
    slide: str | None = None, delay: str = "1 hour",
) -> DataFrame:
    """KPI aggregates per tumbling or sliding window. Rows later than ``delay`` behind the newest
    event are dropped; with append output a window appears once it is closed."""
    frame = F.window(ts, window, slide) if slide else F.window(ts, window)
    out = (
        event_time(stream, ts)
        .withWatermark(ts, delay)
        .groupBy(frame.alias("w"), *keys)
        .agg(*[a.alias(n) for n, a in aggregates.items()])
    )
    return out.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *keys, *aggregates)


def stream_sessions(
    stream: DataFrame, keys: Sequence[str], aggregates: dict[str, Column], ts: str = "ts", gap: str = "30 minutes",
    delay: str = "1 hour",
) -> DataFrame:
    """Aggregates per session of a key: events with less than ``gap`` between neighbours. A session
    appears once the watermark has passed its end, the last event plus the gap."""
    out = (
        event_time(stream, ts).withWatermark(ts, delay).groupBy(*keys, F.session_window(ts, gap).alias("s"))
        .agg(*[a.alias(n) for n, a in aggregates.items()])
    )
    return out.select(*keys, F.col("s.start").alias("session_start"), F.col("s.end").alias("session_end"), *aggregates)


def run_to_table(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Process what is there, append it as Parquet below ``path`` and return the table."""
    query = (
        stream.writeStream.format("parquet").outputMode("append").option("path", path)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)


class AdwinProcessor(StatefulProcessor):
    """State per key: the current window (at most 1,024 values) and the rows seen so far."""

    def __init__(self, keys: Sequence[str], order: str, value: str, delta: float):
        self.keys, self.order, self.value, self.delta = list(keys), order, value, delta

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("window", "w array<double>, n bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values(self.order)
        kept, seen = self.state.get() if self.state.exists() else ([], 0)
        kept = [] if kept is None else list(kept)
        values = np.concatenate([np.asarray(kept, dtype=float), batch[self.value].to_numpy(dtype=float)])
        found, width = advance(values, len(kept), len(kept), self.delta)
        self.state.update((values[len(values) - width :].tolist(), int(seen) + len(batch)))
        if found:
            at = np.asarray(found) - len(kept)
            out = pd.DataFrame({k: [v] * len(at) for k, v in zip(self.keys, key)})
            out["drift_index"] = int(seen) + at
            out[self.order] = batch[self.order].to_numpy()[at]
            yield out

    def close(self) -> None:
        pass


def stream_adwin(stream: DataFrame, keys: Sequence[str], order: str, value: str, delta: float = DELTA) -> DataFrame:
    """Drift points of a stream that arrives in time order, as rows (keys..., drift_index, order).

    The state of a key is at most ``MAX_WINDOW`` values, kept in RocksDB; a micro-batch bounds what
    one task holds.
    """
    spark = prepare(stream.sparkSession)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    schema = T.StructType(
        [stream.schema[k] for k in keys] + [T.StructField("drift_index", T.LongType()), T.StructField(order, stream.schema[order].dataType)]
    )
    return stream.select(*keys, order, value).groupBy(*keys).transformWithStateInPandas(
        statefulProcessor=AdwinProcessor(keys, order, value, delta), outputStructType=schema, outputMode="append", timeMode="None"
    )


def stream_upsert(
    stream: DataFrame, store: TableStore, table: str, key: Sequence[str], dedupe_by: str, checkpoint: str,
    partition: Sequence[str] = (),
) -> StreamingQuery:
    """Upsert every micro-batch; a batch that runs again after a failure leaves the same table."""

    def load(batch: DataFrame, _id: int) -> None:
        store.upsert(table, batch, key, dedupe_by, partition)

    return stream.writeStream.foreachBatch(load).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


__all__ = ["MAX_WINDOW", "event_time", "run_to_table", "stream_adwin", "stream_kpi_windows", "stream_sessions", "stream_upsert"]
