"""Tree regressors on the feature table, one model a series and fold, forecast step by step.

The rows of a (series, fold) lie in blocks of at most ``BLOCK``; a block is fitted in one task, many
short ones as one array program, and extended in the same task, all series of a batch at once. A series
longer than a block is a committee: every block has its model, and the forecasts are averaged by their
rows. No row is left out, and no task holds more than a block and a batch.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugeworks.functions.ordering import join_same, ordered_index
from gaugeworks.operators.features import FeatureConfig, FeaturePipeline, alpha_name, drop_incomplete
from gaugeworks.operators.histogram_trees import fit_forest
from gaugeworks.session import prepare, stage

MIN_ROWS = 20
KINDS = ("gbt", "random_forest")
BLOCK = 200_000
BATCH_ROWS, BATCH_MODELS = 50_000, 64


def next_features(tail: np.ndarray, averages: np.ndarray, at_us: np.ndarray, origin_us: np.ndarray, c: FeatureConfig, names: Sequence[str]) -> np.ndarray:
    """The feature rows that follow the series in ``tail`` (a row each, latest value last, NaN where a
    series is shorter); missing features are 0."""
    out: dict[str, np.ndarray] = {f"lag_{k}": tail[:, -k] for k in c.lags}
    for n in c.rolling:
        part = tail[:, -n:]
        count = (~np.isnan(part)).sum(axis=1)
        some = np.where(np.isnan(part), 0.0, part)
        mean = some.sum(axis=1) / np.maximum(count, 1)
        square = np.where(np.isnan(part), 0.0, (part - mean[:, None]) ** 2).sum(axis=1)
        found = {
            "mean": mean, "std": np.sqrt(square / np.maximum(count - 1, 1)),
            "min": np.where(np.isnan(part), np.inf, part).min(axis=1), "max": np.where(np.isnan(part), -np.inf, part).max(axis=1),
        }
        out |= {f"roll_{k}_{n}": np.where(count >= max(2, n // 2), v, 0.0) for k, v in found.items()}
    out |= {alpha_name(a): averages[:, i] for i, a in enumerate(c.ema_alphas)}
    t = pd.DatetimeIndex(at_us.astype("datetime64[us]"))
    out |= {
        "dow": t.dayofweek, "dom": t.day, "week": t.isocalendar().week, "month": t.month, "quarter": t.quarter, "year": t.year,
        "is_month_end": t.is_month_end, "is_month_start": t.is_month_start, "is_weekend": t.dayofweek >= 5,
    }
    days = (at_us - origin_us) / 86_400_000_000.0
    for p in c.fourier_periods:
        for k in range(1, c.fourier_orders + 1):
            out[f"fourier_sin_{p}_{k}"] = np.sin(2.0 * np.pi * k * days / p)
            out[f"fourier_cos_{p}_{k}"] = np.cos(2.0 * np.pi * k * days / p)
    return np.nan_to_num(np.stack([np.asarray(out[n], dtype=float) for n in names], axis=1), posinf=0.0, neginf=0.0)


def fit_and_extend(heads: list, rows: list, horizon: int, config: FeatureConfig, names: Sequence[str], **how) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each model of a batch: its forecast, its squared error in training, its rows.

    A head has tail, averages, t_last, step_us and origin; rows are (place, x, y).
    """
    forest, fitted = fit_forest([r[1] for r in rows], [r[2] for r in rows], [r[0] for r in rows], **how)
    error = np.array([((r[2] - f) ** 2).sum() - len(f) * (r[2] - f).mean() ** 2 for r, f in zip(rows, fitted)])
    need = max(*config.lags, *config.rolling, 1)
    tail = np.full((len(heads), need), np.nan)
    for i, h in enumerate(heads):
        last = np.asarray(h.tail, dtype=float)[-need:]
        tail[i, need - len(last) :] = last
    averages = np.array([list(h.averages) for h in heads], dtype=float).reshape(len(heads), -1)
    alphas = np.array(config.ema_alphas)
    t, step, origin = (np.array([getattr(h, c) for h in heads], dtype=np.int64) for c in ("t_last", "step_us", "origin"))
    point = np.empty((len(heads), horizon))
    for i in range(horizon):
        point[:, i] = forest.predict(next_features(tail, averages, t + (i + 1) * step, origin, config, names))
        tail = np.concatenate([tail[:, 1:], point[:, i : i + 1]], axis=1)
        averages = (1 - alphas) * averages + alphas * point[:, i : i + 1]
    return point, error, np.array([len(r[2]) for r in rows])


def tree_forecast(
    series: DataFrame, keys: Sequence[str], targets: DataFrame, steps: DataFrame, horizon: int, kind: str = "gbt",
    rounds: int = 400, depth: int = 6, step_size: float = 0.05, seed: int = 42, block: int = BLOCK,
) -> DataFrame:
    """(keys..., fold, model, step, yhat, lower95, upper95) for every (series, fold) of ``targets``.

    Differences of the current value would give the answer away in training, so they are not used.
    Series with fewer than 20 complete rows before the fold's start get no forecast.
    """
    if kind not in KINDS:
        raise ValueError(f"unknown tree model {kind}")
    spark = prepare(series.sparkSession)
    config = FeatureConfig(keys=list(keys), diffs=(), extra=("rn",))
    pipe = FeaturePipeline(config)
    feats = stage(pipe.fit_transform(ordered_index(series.where("value IS NOT NULL"), keys, ["timestamp"])))
    names, by = [c for c in pipe.columns if c != "rn"], [*keys, "fold"]
    past = join_same(feats, targets.select(*by, "start"), keys, "inner").where("rn <= start")
    blocks = F.ceil(F.col("start") / F.lit(block))  # of equal length
    train = drop_incomplete(past, [*names, "value"]).select(
        *by, F.floor((F.col("rn") - 1) * blocks / F.col("start")).cast("int").alias("block"), "rn",
        F.col("value").cast("double").alias("value"), F.array(*[F.col(c).cast("double") for c in names]).alias("x"),
    )
    sizes = train.groupBy(*by, "block").agg(F.count("*").alias("n"))
    enough = sizes.groupBy(*by).agg(F.sum("n").alias("n")).where(F.col("n") >= MIN_ROWS).drop("n")
    after = [F.coalesce((1 - a) * F.col(alpha_name(a)) + a * F.col("value"), F.col("value")).alias(alpha_name(a)) for a in config.ema_alphas]
    recent = past.where(F.col("rn") > F.col("start") - max(*config.lags, *config.rolling, 1))
    ends = recent.select(*by, "rn", "timestamp", "value", *after).groupBy(*by).agg(
        F.sort_array(F.collect_list(F.struct("rn", "value"))).alias("r"), F.unix_micros(F.max(F.col("timestamp").cast("timestamp"))).alias("t_last"),
        F.max_by(F.array(*[F.col(alpha_name(a)) for a in config.ema_alphas]), "rn").alias("averages"),
    )
    heads = join_same(join_same(sizes.drop("n"), enough, by, "inner"), ends, by, "inner")
    heads = join_same(join_same(heads, steps.select(*keys, "step_us"), keys, "inner"), pipe.origins, keys, "inner").select(
        *by, "block", F.lit(-1).cast("long").alias("rn"), F.col("r.value").cast("array<double>").alias("tail"), "averages", "t_last", "step_us",
        F.unix_micros(F.col("__origin").cast("timestamp")).alias("origin"),
    )
    # a block is its head and then its rows; many tasks, as fitting takes far longer than reading
    rows = heads.unionByName(join_same(train, enough, by, "inner"), allowMissingColumns=True)
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-sizes.count() // BATCH_MODELS))
    dealt = rows.repartition(tasks, *by, "block").sortWithinPartitions(*by, "block", "rn")
    schema = T.StructType(
        [rows.schema[k] for k in by]
        + [T.StructField("n", T.LongType()), T.StructField("sse", T.DoubleType()), T.StructField("point", T.ArrayType(T.DoubleType()))]
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        heads, parts = [], []

        def settle() -> pd.DataFrame:
            whole = [tuple(np.concatenate(c) for c in zip(*p)) for p in parts]
            point, error, n = fit_and_extend(heads, whole, horizon, config, names, kind=kind, rounds=rounds, depth=depth, rate=step_size, seed=seed)
            out = pd.DataFrame([[getattr(h, k) for k in by] for h in heads], columns=by)
            heads.clear(), parts.clear()
            return out.assign(n=n, sse=error, point=list(point))

        for batch in batches:
            marks = np.flatnonzero(batch["rn"].to_numpy() == -1).tolist()
            edges = [0, *marks, len(batch)]
            for part, (lo, hi) in enumerate(zip(edges, edges[1:])):
                if part:  # every part but the first begins with a head
                    if heads and (len(heads) >= BATCH_MODELS or sum(len(c[0]) for p in parts for c in p) >= BATCH_ROWS):
                        yield settle()
                    heads.append(next(batch.iloc[lo : lo + 1].itertuples(index=False)))
                    parts.append([])
                    lo += 1
                if hi > lo:
                    piece = batch.iloc[lo:hi]
                    parts[-1].append((piece["rn"].to_numpy(), np.stack(piece["x"].tolist()), piece["value"].to_numpy(dtype=float)))
        if heads:
            yield settle()

    fits = dealt.mapInPandas(run, schema)
    flat = fits.select(*by, "n", "sse", F.posexplode("point").alias("i", "p"))
    joined = flat.groupBy(*by, (F.col("i") + 1).alias("step")).agg(
        (F.sum(F.col("p") * F.col("n")) / F.sum("n")).alias("yhat"), F.greatest(F.sqrt(F.sum("sse") / F.sum("n")), F.lit(1e-9)).alias("sigma")
    )
    half = 1.96 * F.col("sigma") * F.sqrt("step")
    return joined.select(
        *by, F.lit(kind).alias("model"), "step", "yhat", (F.col("yhat") - half).alias("lower95"), (F.col("yhat") + half).alias("upper95")
    )
