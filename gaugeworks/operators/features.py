"""The time-series feature table: lags, rolling statistics, differences, averages, calendar, Fourier.

Series are rows ``(keys..., timestamp, value)``, one per key and timestamp. Rows are cut into ranges of
(key, timestamp), whatever the length of a series; all window features share one partitioning and order
within them.

Exponential averages are seeded with the first value; missing values keep the average and decay its
weight by the length of the gap. The step from one value to the next is an affine map of the average,
so the maps of a range are composed in its task, and the states before the ranges follow from one row
a range. Null, NaN and infinite values are missing.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import asdict, dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window, WindowSpec

from gaugeworks.functions.ordering import in_ranges, join_same, over_ranges
from gaugeworks.session import stage


@dataclass
class FeatureConfig:
    keys: Sequence[str] = ()
    timestamp: str = "timestamp"
    target: str = "value"
    lags: Sequence[int] = (1, 7, 14, 28)
    rolling: Sequence[int] = (7, 14, 28)
    diffs: Sequence[int] = (1, 7)
    ema_alphas: Sequence[float] = (0.3, 0.1)
    calendar: bool = True
    fourier_periods: Sequence[int] = (7, 365)
    fourier_orders: int = 3
    extra: Sequence[str] = ()

    def lookback(self) -> int:
        return max(max(self.lags, default=0), max(self.rolling, default=0), max(self.diffs, default=0), int(bool(self.ema_alphas)))


def alpha_name(alpha: float) -> str:
    return f"ema_{alpha}".replace(".", "_")


def lag_features(w: WindowSpec, value: str, lags: Sequence[int]) -> dict[str, Column]:
    return {f"lag_{k}": F.lag(value, k).over(w) for k in lags}


def rolling_features(w: WindowSpec, value: str, sizes: Sequence[int]) -> dict[str, Column]:
    """Mean, sample deviation, min and max of the ``n`` rows before the current one; null while
    fewer than max(2, n // 2) of them hold a value."""
    out = {}
    for n in sizes:
        frame = w.rowsBetween(-n, -1)
        enough = F.count(value).over(frame) >= max(2, n // 2)
        out[f"roll_mean_{n}"] = F.when(enough, F.avg(value).over(frame))
        out[f"roll_std_{n}"] = F.when(enough, F.stddev_samp(value).over(frame))
        out[f"roll_min_{n}"] = F.when(enough, F.min(value).over(frame))
        out[f"roll_max_{n}"] = F.when(enough, F.max(value).over(frame))
    return out


def diff_features(w: WindowSpec, value: str, steps: Sequence[int]) -> dict[str, Column]:
    return {f"diff_{d}": F.col(value) - F.lag(value, d).over(w) for d in steps}


def affine_prefix(c: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Prefix compositions of the maps x -> c x + d (several d for one c), by doubling.

    Composing is associative, so in every pass a map takes in the one ``step`` places before it; c = 0
    starts anew, c = 1 and d = 0 changes nothing. There is no division, hence no loss where a product
    of many c vanishes.
    """
    c, d, step = c.copy(), d.copy(), 1
    while step < len(c) and c[step:].any():
        d[:, step:] += c[step:] * d[:, :-step]
        c[step:] = c[step:] * c[:-step]
        c[np.abs(c) < 1e-300] = 0.0
        step *= 2
    return c, d


def local_averages(keys: Sequence[str], value: str, alphas: Sequence[float]) -> Callable[[DataFrame], DataFrame]:
    """Adds to the ordered rows of a range how the average after each row follows from the state after
    the first value of its key in the range: ``__a{i}`` e + ``__s{i}``. That first value is ``__x1`` at
    place ``__f`` of the key, the last one so far stands at ``__l`` and the row itself at ``__pos``."""
    names = ["__pos", "__f", "__l", "__x1", *[f"__{c}{i}" for i in range(len(alphas)) for c in "as"]]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, pos0, f0, l0, x0 = None, 0, 0, 0, np.nan
        state = np.zeros((len(alphas), 2))
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            h = batch.column(batch.schema.get_field_index("__k")).to_numpy(zero_copy_only=False)
            x = pc.cast(batch.column(batch.schema.get_field_index(value)), pa.float64(), safe=False).to_numpy(zero_copy_only=False)
            at, seen = np.arange(n), np.isfinite(x)
            new = np.concatenate([[h[0] != key], h[1:] != h[:-1]])
            start = np.maximum.accumulate(np.where(new, at, -1))
            inside, carries = np.maximum(start, 0), start < 0  # rows that go on with the key of the batch before
            pos = np.where(carries, pos0 + at + 1, at - start + 1)

            def latest(marks: np.ndarray, values: np.ndarray, before: float) -> np.ndarray:
                """The value at the last mark of the row's key so far."""
                i = np.maximum.accumulate(np.where(marks, at, -1))
                return np.where(i >= inside, values[i], np.where(carries, before, 0))

            last = latest(seen, pos, l0)
            previous = np.where(new, 0, np.concatenate([[l0], last[:-1]]))
            first = seen & (previous == 0)
            f, x1 = latest(first, pos, f0), latest(first, x, x0)
            go_on = seen & ~first
            out = []
            for i, a in enumerate(alphas):
                weight = (1.0 - a) ** np.where(go_on, pos - previous, 1)
                c = np.where(go_on, weight / (weight + a), np.where(first | new, 0.0, 1.0))
                d = np.stack([first.astype(np.float64), np.where(go_on, a * np.where(seen, x, 0.0) / (weight + a), 0.0)])
                c, d = affine_prefix(c, d)
                d += c * state[i][:, None]
                state[i] = d[:, -1]
                out += [pa.array(d[0]), pa.array(d[1])]
            key, pos0, f0, l0, x0 = h[-1], int(pos[-1]), f[-1], last[-1], x1[-1]
            found = f > 0
            places = [pa.array(pos), pa.array(f.astype(np.int64), mask=~found), pa.array(last.astype(np.int64), mask=~found)]
            extra = [*places, pa.array(x1, mask=~found), *out]
            yield pa.RecordBatch.from_arrays([*batch.columns, *extra], names=[*batch.schema.names, *names])

    def add(df: DataFrame) -> DataFrame:
        marked = df.withColumn("__k", F.xxhash64(F.lit(0), *keys, *[F.col(k).isNull() for k in keys]))
        kinds = [T.LongType()] * 3 + [T.DoubleType()] * (1 + 2 * len(alphas))
        schema = T.StructType([*marked.schema.fields, *[T.StructField(n, k) for n, k in zip(names, kinds)]])
        return marked.mapInArrow(scan, schema).drop("__k")

    return add


def averages(cut: DataFrame, keys: Sequence[str], alphas: Sequence[float]) -> DataFrame:
    """Adds ``__e{i}``, the exponential average after each row, to rows that carry
    :func:`local_averages`.

    A range's rows fold to one map and the places of its first and last value. The states before the
    ranges of a key follow from these, one row a range; only keys that lie in several ranges need them.
    """
    columns = ["__pos", "__f", "__l", "__x1", *[f"__{c}{i}" for i in range(len(alphas)) for c in "as"]]
    last = cut.groupBy(*keys, "__b").agg(F.max_by(F.struct(*columns), "__pos").alias("z")).select(*keys, "__b", "z.*")
    several = last.withColumn("__ranges", F.count("*").over(Window.partitionBy(*keys))).where("__ranges > 1").drop("__ranges")
    given = [f"__{c}{i}" for i in range(len(alphas)) for c in ("before", "first")]

    def fold(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("__b").reset_index(drop=True)
        rows = np.full((len(part), 2 * len(alphas)), np.nan)
        gap, e = 0, np.full(len(alphas), np.nan)
        for r, z in enumerate(part[columns].to_dict("records")):
            rows[r, 0::2] = e
            if np.isnan(z["__f"]):
                gap += z["__pos"]
                continue
            for i, a in enumerate(alphas):
                weight = (1.0 - a) ** (gap + z["__f"])
                start = z["__x1"] if np.isnan(e[i]) else (weight * e[i] + a * z["__x1"]) / (weight + a)
                rows[r, 2 * i + 1] = start
                e[i] = z[f"__a{i}"] * start + z[f"__s{i}"]
            gap = z["__pos"] - z["__l"]
        return pd.concat([part[[*keys, "__b"]], pd.DataFrame(rows, columns=given)], axis=1)

    schema = T.StructType([*[cut.schema[k] for k in keys], T.StructField("__b", T.IntegerType()), *[T.StructField(g, T.DoubleType()) for g in given]])
    states = stage(several.groupBy(*keys).applyInPandas(fold, schema))
    rows = join_same(cut, states, [*keys, "__b"])

    def state(i: int) -> Column:
        start = F.coalesce(F.nanvl(f"__first{i}", F.lit(None)), "__x1")
        return F.when(F.col("__f").isNull(), F.nanvl(f"__before{i}", F.lit(None))).otherwise(F.col(f"__a{i}") * start + F.col(f"__s{i}"))

    return rows.select("*", *[state(i).alias(f"__e{i}") for i in range(len(alphas))]).drop(*columns, *given)


def calendar_features(ts: str) -> dict[str, Column]:
    t = F.col(ts)
    day = t.cast("date")
    return {
        "dow": F.weekday(day),
        "dom": F.dayofmonth(day),
        "week": F.weekofyear(day),
        "month": F.month(day),
        "quarter": F.quarter(day),
        "year": F.year(day),
        "is_month_end": (day == F.last_day(day)).cast("int"),
        "is_month_start": (F.dayofmonth(day) == 1).cast("int"),
        "is_weekend": (F.weekday(day) >= 5).cast("int"),
    }


def fourier_features(ts: str, origin: Column, periods: Sequence[int], orders: int) -> dict[str, Column]:
    days = (F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(origin.cast("timestamp"))) / F.lit(86_400_000_000.0)
    out = {}
    for p in periods:
        for k in range(1, orders + 1):
            angle = F.lit(2.0 * math.pi * k) * days / F.lit(float(p))
            out[f"fourier_sin_{p}_{k}"] = F.sin(angle)
            out[f"fourier_cos_{p}_{k}"] = F.cos(angle)
    return out


def conform_schema(df: DataFrame, columns: Sequence[str], lead: Sequence[str] = ()) -> DataFrame:
    """The locked columns in their order: missing ones null, others dropped."""
    have = set(df.columns)
    return df.select(
        *[c for c in lead if c in have],
        *[F.col(c) if c in have else F.lit(None).cast("double").alias(c) for c in columns],
    )


def drop_incomplete(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.dropna(how="any", subset=list(columns))


@dataclass
class FeaturePipeline:
    """Fit once to lock the column order and the Fourier origin of every series, then transform."""

    config: FeatureConfig = field(default_factory=FeatureConfig)
    columns: list[str] | None = None
    origins: DataFrame | None = None

    def _build(self, df: DataFrame, buckets: int | None) -> DataFrame:
        c = self.config
        keys, alphas = list(c.keys), list(c.ema_alphas) if c.target in df.columns else []

        def windows(part: DataFrame, w: WindowSpec) -> DataFrame:
            cols: dict[str, Column] = {}
            if c.target in part.columns:
                cols |= lag_features(w, c.target, c.lags) | rolling_features(w, c.target, c.rolling)
                cols |= diff_features(w, c.target, c.diffs)
            cols |= {alpha_name(a): F.lag(f"__e{i}").over(w) for i, a in enumerate(alphas)}
            return part.select("*", *[v.alias(k) for k, v in cols.items()])

        cut = in_ranges(df, keys, [c.timestamp], buckets, local_averages(keys, c.target, alphas) if alphas else None)
        if alphas:
            cut = averages(cut, keys, alphas)
        out = over_ranges(cut, keys, [c.timestamp], c.lookback(), windows).drop(*[f"__e{i}" for i in range(len(alphas))])
        if c.calendar:
            out = out.select("*", *[v.alias(k) for k, v in calendar_features(c.timestamp).items()])
        if c.fourier_periods:
            out = join_same(out, self.origins, keys)
            four = fourier_features(c.timestamp, F.col("__origin"), c.fourier_periods, c.fourier_orders)
            out = out.select("*", *[v.alias(k) for k, v in four.items()]).drop("__origin")
        for name in c.extra:
            if name not in out.columns:
                out = out.withColumn(name, F.lit(None).cast("double"))
        return out

    def fit(self, df: DataFrame) -> FeaturePipeline:
        c = self.config
        self.origins = df.groupBy(*c.keys).agg(F.min(c.timestamp).alias("__origin"))
        return self

    def fit_transform(self, df: DataFrame, buckets: int | None = None) -> DataFrame:
        out = self.fit(df)._build(df, buckets)
        c = self.config
        self.columns = [x for x in out.columns if x not in {*c.keys, c.timestamp, c.target}]
        return out

    def transform(self, df: DataFrame, buckets: int | None = None) -> DataFrame:
        """Same features with the fitted origins, in the locked column order."""
        c = self.config
        if self.columns is None or self.origins is None:
            raise ValueError("fit the pipeline first")
        return conform_schema(self._build(df, buckets), self.columns, [*c.keys, c.timestamp, c.target])

    # state ------------------------------------------------------------------------------
    def to_json(self) -> str:
        """Config and columns as JSON; origins, one row per series, are saved as a table."""
        return json.dumps({"config": asdict(self.config), "columns": self.columns})

    @classmethod
    def from_json(cls, text: str, origins: DataFrame) -> FeaturePipeline:
        state = json.loads(text)
        return cls(FeatureConfig(**state["config"]), state["columns"], origins)
