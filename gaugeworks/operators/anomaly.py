"""Rolling anomalies, and the three-detector ensemble around the isolation forest."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from gaugeworks.functions import sentences as say
from gaugeworks.functions.ordering import exact_quantiles, join_same, over_series
from gaugeworks.functions.text import fixed, humanize

TINY = 1e-9
LEAST_ROWS = 4  # shorter series have no anomalies, whatever the window


def rolling_scores(
    series: DataFrame, keys: Sequence[str], window: int = 12, buckets: int | None = None
) -> DataFrame:
    """Mean, population deviation, z and quartile fences of the ``window`` rows before each row.

    Quartiles are picked by index from the sorted history (no interpolation). Rows with a shorter
    history are left out.
    """

    def build(part: DataFrame, w: WindowSpec) -> DataFrame:
        frame = w.rowsBetween(-window, -1)
        return part.select(
            "*",
            F.array_sort(F.collect_list("value").over(frame)).alias("__h"),
            F.avg("value").over(frame).alias("expected"),
            F.stddev_pop("value").over(frame).alias("__s"),
        )

    rows = over_series(series, keys, ["timestamp"], window, build, buckets).where(F.size("__h") == window)
    if window < LEAST_ROWS:
        long = series.groupBy(*keys).agg(F.count("*").alias("__rows")).where(F.col("__rows") >= LEAST_ROWS)
        rows = join_same(rows, long.drop("__rows"), keys, "left_semi" if keys else "inner")
    n = window
    rows = rows.withColumn("__s", F.when(F.col("__s") == 0, F.lit(TINY)).otherwise(F.col("__s")))
    rows = rows.withColumn("z_score", (F.col("value") - F.col("expected")) / F.col("__s"))
    q1, q3 = (F.try_element_at("__h", F.lit(i + 1)) for i in (n // 4, min(n - 1, 3 * n // 4)))
    iqr = F.greatest(q3 - q1, F.lit(TINY))
    return rows.withColumn("fence_low", q1 - 1.5 * iqr).withColumn("fence_high", q3 + 1.5 * iqr).drop("__h", "__s")


def rolling_anomalies(
    series: DataFrame,
    keys: Sequence[str] = ("kpi_id",),
    kpi_name: Column | None = None,
    higher_is_better: bool = True,
    window: int = 12,
    z_threshold: float = 2.0,
    buckets: int | None = None,
) -> DataFrame:
    """Rows whose z reaches the threshold or that leave the quartile fence, with kind, severity and text."""
    z, v = F.col("z_score"), F.col("value")
    rows = rolling_scores(series, keys, window, buckets)
    rows = rows.where((F.abs(z) >= z_threshold) | (v < F.col("fence_low")) | (v > F.col("fence_high")))
    rows = rows.withColumn(
        "delta_pct", F.coalesce(F.try_divide(v - F.col("expected"), F.col("expected")) * 100.0, F.lit(0.0))
    )
    worse = F.col("delta_pct") < 0 if higher_is_better else F.col("delta_pct") > 0
    base = F.least(F.lit(1.0), (F.abs(z) - z_threshold + 1) / 4.0)
    rows = rows.withColumn("severity", F.when(worse, F.least(F.lit(1.0), base + 0.2)).otherwise(base))
    rows = rows.withColumn("kind", F.when(z > 0, "spike").otherwise("drop"))
    name = kpi_name if kpi_name is not None else F.col(keys[-1])
    rows = rows.withColumn("narrative", narrate(name, F.col("kind"), v, F.col("expected"), F.col("delta_pct"), worse))
    return rows.select(
        *keys, "timestamp", "value", "expected", "delta_pct", "z_score", "kind", "severity", "narrative",
        (F.col("severity") >= 0.5).alias("alert_worthy"),
    )


def narrate(name: Column, kind: Column, value: Column, expected: Column, delta_pct: Column, worse: Column) -> Column:
    return F.concat(
        F.when(worse, "⚠️ ").otherwise(""), name, F.when(kind == "spike", " jumped ").otherwise(" dropped "),
        fixed(F.abs(delta_pct), 1), F.lit("% (now "), humanize(value), F.lit(", expected ~"),
        humanize(expected), F.lit(")"),
    )


# ensemble ----------------------------------------------------------------------------------


def fit_medians(features: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Exact median per series and feature: (keys..., feature, median)."""
    long = features.select(*keys, *[F.col(c).cast("double").alias(c) for c in columns]).unpivot(
        list(keys), list(columns), "feature", "x"
    )
    finite = long.where(F.abs("x") < float("inf"))
    q = exact_quantiles(finite, [*keys, "feature"], "x", [0.5])
    return q.select(*keys, "feature", F.element_at("q", 1).alias("median"))


def _by_feature(long: DataFrame, keys: Sequence[str], columns: Sequence[str], value: str, out: str) -> DataFrame:
    """One array per series in the order of ``columns``, null where a feature has no entry."""
    table = F.map_from_entries(F.collect_list(F.struct("feature", value)))  # one entry per feature
    names = F.array(*[F.lit(c) for c in columns])
    packed = long.groupBy(*keys).agg(table.alias("__t"))
    return packed.select(*keys, F.transform(names, lambda c: F.col("__t")[c]).alias(out))


def pack_features(features: DataFrame, columns: Sequence[str], out: str = "x") -> DataFrame:
    """The feature columns as one array; the other columns stay."""
    keep = [c for c in features.columns if c not in set(columns)]
    return features.select(*keep, F.array(*[F.col(c).cast("double") for c in columns]).alias(out))


def unpack_features(rows: DataFrame, columns: Sequence[str], x: str = "x") -> DataFrame:
    keep = [c for c in rows.columns if c != x]
    return rows.select(*keep, *[F.col(x)[i].alias(c) for i, c in enumerate(columns)])


def impute_array(rows: DataFrame, medians: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Infinite and missing entries of ``x`` become the series' median, or 0 where there is none."""
    out = join_same(rows, _by_feature(medians, keys, columns, "median", "__m"), keys)
    none = F.transform("x", lambda v: F.lit(None).cast("double"))
    filled = F.zip_with(
        "x", F.coalesce("__m", none),
        # NaN compares above infinity, so one test drops it together with the infinities
        lambda v, m: F.coalesce(F.when(F.abs(v) < float("inf"), v), m, F.lit(0.0)),
    )
    return out.withColumn("x", filled).drop("__m")


def impute(features: DataFrame, medians: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """:func:`impute_array` on separate feature columns."""
    return unpack_features(impute_array(pack_features(features, columns), medians, keys, columns), columns)


def fit_scaler(rows: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Mean and population deviation (0 becomes 1) per series and feature of ``x``.

    The array is exploded and reduced in the same stage, so the shuffle holds one row per series,
    feature and task.
    """
    long = rows.select(*keys, F.posexplode("x").alias("i", "v"))
    sd = F.stddev_pop("v")
    stats = long.groupBy(*keys, "i").agg(F.avg("v").alias("mean"), F.when(sd == 0, 1.0).otherwise(sd).alias("sd"))
    names = F.array(*[F.lit(c) for c in columns])
    return stats.select(*keys, names[F.col("i")].alias("feature"), "mean", "sd")


def standardize_array(rows: DataFrame, scaler: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    fitted = scaler.withColumn("ms", F.struct("mean", "sd"))
    out = join_same(rows, _by_feature(fitted, keys, columns, "ms", "__s"), keys)
    return out.withColumn("x", F.zip_with("x", "__s", lambda v, s: (v - s["mean"]) / s["sd"])).drop("__s")


def standardize(features: DataFrame, scaler: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """:func:`standardize_array` on separate feature columns."""
    return unpack_features(standardize_array(pack_features(features, columns), scaler, keys, columns), columns)


def fit_statistical(series: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mean, population deviation and interpolated quartiles of the training values."""
    moments = series.groupBy(*keys).agg(F.avg("value").alias("v_mean"), F.stddev_pop("value").alias("__s"))
    moments = moments.withColumn("v_std", F.when(F.col("__s") == 0, F.lit(TINY)).otherwise(F.col("__s"))).drop("__s")
    q = exact_quantiles(series, keys, "value", [0.25, 0.75])
    quart = q.select(*keys, F.element_at("q", 1).alias("v_q1"), F.element_at("q", 2).alias("v_q3"))
    return join_same(moments, quart, keys)


def statistical_score(rows: DataFrame, fitted: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Adds ``statistical``: a sigmoid of |z| around 2, at least 0.7 outside the quartile fence."""
    out = join_same(rows, fitted, keys)
    v = F.coalesce("value", "v_mean")
    z = F.abs((v - F.col("v_mean")) / F.col("v_std"))
    iqr = F.greatest(F.col("v_q3") - F.col("v_q1"), F.lit(TINY))
    outside = (v < F.col("v_q1") - 1.5 * iqr) | (v > F.col("v_q3") + 1.5 * iqr)
    soft = 1 / (1 + F.exp(-(z - 2.0)))
    return out.withColumn("statistical", F.when(outside, F.greatest(soft, F.lit(0.7))).otherwise(soft)).drop(
        "v_mean", "v_std", "v_q1", "v_q3"
    )


def min_max_scale(rows: DataFrame, keys: Sequence[str], raw: str, out: str) -> DataFrame:
    """Scale ``raw`` to [0, 1] over the rows scored together for one series; all equal gives 0."""
    ends = rows.groupBy(*keys).agg(F.min(raw).alias("__lo"), F.max(raw).alias("__hi"))
    span = F.col("__hi") - F.col("__lo")
    scaled = F.when(span < TINY, F.lit(0.0)).otherwise((F.col(raw) - F.col("__lo")) / span)
    return join_same(rows, ends, keys).withColumn(out, scaled).drop("__lo", "__hi")


DETECTORS = ("isolation_forest", "statistical", "xgboost")  # fixed values: detector names


def fuse_scores(rows: DataFrame, detectors: Sequence[str], threshold: float = 0.55, agreeing: int = 2) -> DataFrame:
    """Mean of the detector scores that are present; anomaly by the mean or by agreeing detectors."""
    scores = F.map_filter(
        F.map_from_arrays(F.array(*[F.lit(d) for d in detectors]), F.array(*[F.col(d).cast("double") for d in detectors])),
        lambda _, s: s.isNotNull(),
    )
    rows = rows.withColumn("detector_scores", scores)
    values = F.map_values("detector_scores")
    total = F.aggregate(values, F.lit(0.0), lambda a, x: a + x)
    rows = rows.withColumn("fused_score", total / F.size(values))
    rows = rows.withColumn("detectors_flagging", F.map_keys(F.map_filter("detector_scores", lambda _, s: s > 0.5)))
    rows = rows.withColumn(
        "is_anomaly", (F.col("fused_score") >= threshold) | (F.size("detectors_flagging") >= agreeing)
    )
    rows = rows.withColumn("severity", F.greatest(F.lit(0.0), F.least(F.lit(1.0), "fused_score")))
    return rows.withColumn("explanation", explain_detection())


def explain_detection() -> Column:
    flags = F.col("detectors_flagging")

    def part(detector: str, text: str) -> Column:
        return F.when(F.array_contains(flags, detector), text)

    parts = F.concat_ws(
        "; ",
        part("isolation_forest", say.FOREST_REASON),
        part("xgboost", say.MODEL_REASON),
        part("statistical", say.HISTORY_REASON),
    )
    fused = fixed(F.col("fused_score"), 2)
    return F.when(F.size(flags) == 0, F.concat(F.lit(say.NORMAL_POINT), fused, F.lit(")."))).otherwise(
        F.concat(
            F.lit(say.ANOMALY_AT), fixed(F.col("value"), 2), F.lit(": "), parts,
            F.lit(say.FUSED_CONFIDENCE), fused, F.lit("."),
        )
    )


def anomaly_metrics(scored: DataFrame, keys: Sequence[str], n_features: int, min_rows: int = 50) -> tuple[DataFrame, DataFrame]:
    """(metrics, rejects): per series the rows, share flagged and mean severity; short series are rejected."""
    xgb = F.bool_or(F.col("xgboost").isNotNull()) if "xgboost" in scored.columns else F.lit(False)
    per = scored.groupBy(*keys).agg(
        F.count("*").alias("n_train_rows"),
        (F.count_if("is_anomaly") / F.count("*") * 100.0).alias("flagged_pct"),
        F.avg("severity").alias("avg_severity"),
        xgb.alias("xgb_used"),
    )
    ok = per.where(F.col("n_train_rows") >= min_rows).withColumn("n_features", F.lit(n_features))
    short = per.where(F.col("n_train_rows") < min_rows).select(
        *keys, "n_train_rows", F.format_string(f"needs {min_rows} rows after features, has %d", "n_train_rows").alias("reason")
    )
    return ok, short
