"""ADWIN: an adaptive window over an ordered stream that is cut where two halves differ in mean."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugeworks.functions.ordering import chunk_with_halo, join_same
from gaugeworks.session import stage

DELTA = 0.002
MAX_WINDOW = 1024
SILENT_BELOW = 32
CHUNK_ROWS = 65_536  # rows one task walks through


# splits that may be tried: powers of two and multiples of 32, in the order they are tried
SPLITS = np.array(sorted({2**k for k in range(3, 11)} | set(range(32, MAX_WINDOW + 1, 32))))
BLOCK = 256  # rows checked at once
AFTER_DRIFT = 32  # rows checked at once after a drift, then twice as many until there are BLOCK


def first_cuts(p1: np.ndarray, p2: np.ndarray, ends: np.ndarray, widths: np.ndarray, delta: float) -> np.ndarray:
    """For windows of ``widths`` rows ending before ``ends``: the first split whose sides differ by
    more than the bound, or 0. ``p1`` and ``p2`` are prefix sums of the values and their squares."""
    splits = SPLITS[SPLITS < widths.max() - 8]  # no window is wide enough for the others
    if not len(splits):
        return np.zeros(len(widths), dtype=SPLITS.dtype)
    n = widths[:, None].astype(float)
    start, n0 = (ends - widths)[:, None], splits[None, :].astype(float)
    usable = (splits[None, :] < widths[:, None] - 8) & (widths[:, None] >= SILENT_BELOW)
    at = np.minimum(start + splits[None, :], len(p1) - 1)
    n1 = np.maximum(n - n0, 1.0)
    s0, q0 = p1[at] - p1[start], p2[at] - p2[start]
    s1, q1 = p1[ends][:, None] - p1[at], p2[ends][:, None] - p2[at]
    mu0, mu1 = s0 / n0, s1 / n1
    spread = np.maximum(q0 / n0 - mu0**2, 0.0) + np.maximum(q1 / n1 - mu1**2, 0.0)
    m = 1.0 / (1.0 / n0 + 1.0 / n1)
    log = np.log(2.0 * n / delta)
    hit = usable & (np.abs(mu0 - mu1) > np.sqrt(2.0 / m * log) * np.sqrt(spread) + 2.0 / (3.0 * m) * log)
    return np.where(hit.any(axis=1), splits[hit.argmax(axis=1)], 0)


def advance(values: np.ndarray, start: int, width: int, delta: float = DELTA, cap: int = MAX_WINDOW):
    """Feed ``values[start:]``; before that the window is the last ``width`` values.

    The window is always a suffix of what was read, so its width is the whole state. Returns the
    positions of drifts and the width at the end.
    """
    x = values - values.mean() if len(values) else values
    p1, p2 = (np.concatenate([[0.0], np.cumsum(v)]) for v in (x, x * x))
    found, i, block = [], start, BLOCK
    while i < len(values):
        ends = np.arange(i + 1, min(i + block, len(values)) + 1)
        widths = np.minimum(width + 1 + np.arange(len(ends)), cap)
        cuts = first_cuts(p1, p2, ends, widths, delta)
        drift = np.flatnonzero(cuts)
        if len(drift):  # rows after a drift see a shorter window and are checked again
            row = drift[0]
            found.append(int(ends[row]) - 1)
            width, i, block = int(widths[row] - cuts[row]), int(ends[row]), AFTER_DRIFT
        else:
            width, i, block = int(widths[-1]), int(ends[-1]), min(2 * block, BLOCK)
    return found, width


def adwin(
    rows: DataFrame,
    keys: Sequence[str],
    order_by: Sequence[str],
    value: str,
    delta: float = DELTA,
    chunk: int = CHUNK_ROWS,
) -> DataFrame:
    """Drift points ``(keys..., drift_index, <order_by[0]>)``; the index counts rows from 0.

    A series is cut into chunks, each preceded by the last ``MAX_WINDOW`` rows before it. What a
    chunk does depends on earlier rows only through the window width it starts with, so all chunks
    run at once on a guessed width, and those whose predecessor ended on another width run again.
    Short series are one chunk and one round.
    """
    if chunk < MAX_WINDOW:
        raise ValueError("a chunk must be at least as long as the window")
    at = order_by[0]
    parts = chunk_with_halo(
        rows.select(*keys, *order_by, F.col(value).cast("double").alias("__v")), keys, order_by, MAX_WINDOW, chunk
    )
    parts = stage(parts.select(*keys, at, "rn", "__v", "__chunk", "__own"))
    by = [*keys, "__chunk"]
    guess = parts.groupBy(*by).agg(F.count_if(~F.col("__own")).alias("__w0"))
    widths = stage(guess.withColumn("__w0", F.least("__w0", F.lit(MAX_WINDOW)).cast("int")))
    fields = [rows.schema[k] for k in keys] + [
        T.StructField("__chunk", T.LongType()), T.StructField("__w0", T.IntegerType()),
        T.StructField("__w1", T.IntegerType()), T.StructField("drift_index", T.LongType()),
        T.StructField(at, rows.schema[at].dataType),
    ]
    names = [f.name for f in fields]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rn")
        start = int((~pdf["__own"]).sum())
        first = int(pdf["__w0"].iloc[0])
        found, width = advance(pdf["__v"].to_numpy(), start, first, delta)
        head = pdf.iloc[[*found, -1]].copy()  # the last row carries the end width
        head["drift_index"] = [*(pdf["rn"].iloc[found] - 1), -1]
        head["__w1"] = width
        return head[names]

    result, todo = None, widths
    while True:  # each round settles at least one more chunk of every series
        fresh = stage(join_same(parts, todo, by, "inner").groupBy(*by).applyInPandas(run, T.StructType(fields)))
        if result is not None:  # rerun chunks replace their earlier result
            again = fresh.where("drift_index < 0").select(*by, F.lit(True).alias("__new"))
            kept = join_same(result, again, by).where("__new IS NULL").drop("__new")
            fresh = stage(kept.unionByName(fresh))
        result = fresh
        ends = result.where("drift_index < 0").select(*by, "__w0", "__w1")
        before = ends.select(*keys, (F.col("__chunk") + 1).alias("__chunk"), F.col("__w1").alias("__want"))
        wrong = join_same(ends, before, by, "inner").where("__want <> __w0")
        todo = stage(wrong.select(*by, F.col("__want").alias("__w0")))
        if todo.isEmpty():
            return result.where("drift_index >= 0").select(*keys, "drift_index", at)


def residual_drift(
    predictions: DataFrame, actuals: DataFrame, keys: Sequence[str], delta: float = DELTA, chunk: int = CHUNK_ROWS
) -> DataFrame:
    """ADWIN on actual minus prediction: per series the drift points and the number of observations."""
    both = stage(
        actuals.select(*keys, "timestamp", F.col("value").alias("__a"))
        .join(predictions.select(*keys, "timestamp", F.col("yhat").alias("__p")), [*keys, "timestamp"])
        .select(*keys, "timestamp", (F.col("__a") - F.col("__p")).alias("residual"))
    )
    points = adwin(both, keys, ["timestamp"], "residual", delta, chunk)
    seen = both.groupBy(*keys).agg(F.count("*").alias("n_observations"))
    hits = points.groupBy(*keys).agg(F.count("*").alias("n_drifts"), F.min("drift_index").alias("first_drift"), F.max("drift_index").alias("last_drift"))
    out = join_same(seen, hits, keys)
    return out.withColumn("n_drifts", F.coalesce("n_drifts", F.lit(0))).withColumn("drift_detected", F.col("n_drifts") > 0)
