"""The anomaly ensemble on the daily series of the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from gaugeworks.operators import anomaly as an
from gaugeworks.operators import ensemble as en
from gaugeworks.operators import isolation as iso
from gaugeworks.operators.features import FeatureConfig, FeaturePipeline, drop_incomplete
from gaugeworks.plans import bindings as b
from gaugeworks.plans.registry import query
from gaugeworks.plans.series_queries import KEY, SERIES, daily
from gaugeworks.session import stage

_GAPPY = f"""{SERIES}, x AS (SELECT kpi_id, day, value, LAG(value, 1) OVER w AS lag_1, CASE WHEN isodow(ts) = 7 THEN NULL WHEN day(ts) = 1 THEN CAST('inf' AS DOUBLE) ELSE LAG(value, 7) OVER w END AS lag_7,
  CAST(NULL AS DOUBLE) AS empty FROM s WINDOW w AS (PARTITION BY kpi_id ORDER BY ts)),
  m AS (SELECT kpi_id, quantile_cont(lag_1, 0.5) AS m1, quantile_cont(CASE WHEN lag_7 < 1e300 THEN lag_7 END, 0.5) AS m7 FROM x GROUP BY 1),
  filled AS (SELECT kpi_id, day, value, COALESCE(lag_1, m1) AS lag_1, CASE WHEN lag_7 < 1e300 THEN lag_7 ELSE m7 END AS lag_7, 0.0::DOUBLE AS empty FROM x JOIN m USING (kpi_id))"""
COLUMNS = ["lag_1", "lag_7", "empty"]


def _gappy(spark, sf):
    """Lag features with missing and infinite cells, and a column without values."""
    cfg = FeatureConfig(keys=KEY, lags=(1, 7), rolling=(), diffs=(), ema_alphas=(), calendar=False, fourier_periods=(), extra=("empty",))
    rows = FeaturePipeline(cfg).fit_transform(daily(spark, sf))
    sunday, first = F.weekday("timestamp") == 6, F.dayofmonth("timestamp") == 1
    holes = F.when(sunday, None).when(first, F.lit(float("inf"))).otherwise(F.col("lag_7"))
    return stage(rows.withColumn("lag_7", holes))


def _filled(spark, sf):
    rows = _gappy(spark, sf)
    return an.impute(rows, an.fit_medians(rows, KEY, COLUMNS), KEY, COLUMNS)


@query("impute", f"WITH {_GAPPY} SELECT kpi_id, day, value, ROUND(lag_1, 4) AS lag_1, ROUND(lag_7, 4) AS lag_7, empty FROM filled")
def _(spark, sf):
    return b.day_text(b.rounded(_filled(spark, sf), 4, "lag_1", "lag_7"))


@query("standardize", f"""WITH {_GAPPY}, st AS (SELECT kpi_id, AVG(lag_1) AS a1, STDDEV_POP(lag_1) AS s1, AVG(lag_7) AS a7, STDDEV_POP(lag_7) AS s7 FROM filled GROUP BY 1)
  SELECT kpi_id, day, value, ROUND((lag_1 - a1) / s1, 6) AS lag_1, ROUND((lag_7 - a7) / s7, 6) AS lag_7, 0.0::DOUBLE AS empty FROM filled JOIN st USING (kpi_id)""")
def _(spark, sf):
    rows = stage(_filled(spark, sf))
    out = an.standardize(rows, an.fit_scaler(an.pack_features(rows, COLUMNS), KEY, COLUMNS), KEY, COLUMNS)
    return b.day_text(b.rounded(out, 6, "lag_1", "lag_7"))


_STAT = f"""{SERIES}, v AS (SELECT kpi_id, AVG(value) AS m, STDDEV_POP(value) AS sd, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM s GROUP BY 1),
  st AS (SELECT kpi_id, day, ts, value, 1 / (1 + EXP(-(ABS((value - m) / sd) - 2))) AS soft, value < q1 - 1.5 * GREATEST(q3 - q1, 1e-9) OR value > q3 + 1.5 * GREATEST(q3 - q1, 1e-9) AS outside FROM s JOIN v USING (kpi_id)),
  scored AS (SELECT kpi_id, day, ts, value, CASE WHEN outside THEN GREATEST(soft, 0.7) ELSE soft END AS statistical FROM st)"""


def _statistical(spark, sf):
    rows = daily(spark, sf)
    return an.statistical_score(rows, an.fit_statistical(rows, KEY), KEY)


@query("statistical_score", f"WITH {_STAT} SELECT kpi_id, day, value, ROUND(statistical, 8) AS statistical FROM scored")
def _(spark, sf):
    return b.day_text(b.rounded(_statistical(spark, sf), 8, "statistical"))


_FUSED = f"""{_STAT}, dv AS (SELECT kpi_id, day, ts, value, statistical, ABS(value - LAG(value) OVER (PARTITION BY kpi_id ORDER BY ts)) AS raw FROM scored),
  mm AS (SELECT kpi_id, MIN(raw) AS lo, MAX(raw) AS hi FROM dv GROUP BY 1),
  two AS (SELECT kpi_id, day, value, statistical, CASE WHEN hi - lo < 1e-9 THEN 0 ELSE (raw - lo) / (hi - lo) END AS isolation_forest FROM dv JOIN mm USING (kpi_id)),
  fu AS (SELECT *, (statistical + COALESCE(isolation_forest, 0)) / (CASE WHEN isolation_forest IS NULL THEN 1 ELSE 2 END) AS fused,
    COALESCE(CAST(isolation_forest > 0.5 AS INTEGER), 0) + CAST(statistical > 0.5 AS INTEGER) AS flags FROM two),
  ex AS (SELECT *, fused >= 0.55 OR flags >= 2 AS is_anomaly, LEAST(1.0, GREATEST(0.0, fused)) AS severity,
    CASE WHEN flags = 0 THEN 'Normal point (fused score ' || printf('%.2f', fused) || ').' ELSE '⚠️ Anomaly @ ' || printf('%.2f', value) || ': ' ||
    concat_ws('; ', CASE WHEN isolation_forest > 0.5 THEN 'isolation forest detected feature-space outlier' END, CASE WHEN statistical > 0.5 THEN 'value is statistically extreme vs history' END)
    || '. Fused confidence: ' || printf('%.2f', fused) || '.' END AS explanation FROM fu)"""


def _fused(spark, sf):
    """Fusion of the statistical score and the scaled day-to-day change, in place of a random forest."""
    cfg = FeatureConfig(keys=KEY, lags=(1,), rolling=(), diffs=(), ema_alphas=(), calendar=False, fourier_periods=())
    rows = FeaturePipeline(cfg).fit_transform(_statistical(spark, sf)).withColumn("raw", F.abs(F.col("value") - F.col("lag_1")))
    scaled = an.min_max_scale(stage(rows), KEY, "raw", "isolation_forest")
    return an.fuse_scores(scaled, ["isolation_forest", "statistical"])


@query("min_max_scale", f"WITH {_FUSED} SELECT kpi_id, day, ROUND(isolation_forest, 8) AS score FROM two")
def _(spark, sf):
    return b.day_text(_fused(spark, sf)).select("kpi_id", "day", F.round("isolation_forest", 8).alias("score"))


@query("fuse_scores", f"WITH {_FUSED} SELECT kpi_id, day, ROUND(fused, 8) AS fused_score, flags AS n_flags, is_anomaly, ROUND(severity, 8) AS severity FROM ex")
def _(spark, sf):
    return b.day_text(_fused(spark, sf)).select(
        "kpi_id", "day", F.round("fused_score", 8).alias("fused_score"), F.size("detectors_flagging").alias("n_flags"), "is_anomaly",
        F.round("severity", 8).alias("severity"),
    )


@query("explain_detection", f"WITH {_FUSED} SELECT kpi_id, day, explanation FROM ex")
def _(spark, sf):
    return b.day_text(_fused(spark, sf)).select("kpi_id", "day", "explanation")


@query("anomaly_metrics", f"""WITH {_FUSED} SELECT kpi_id, COUNT(*) AS n_train_rows, ROUND(COUNT(*) FILTER (is_anomaly) / COUNT(*) * 100, 6) AS flagged_pct,
  ROUND(AVG(severity), 6) AS avg_severity, FALSE AS xgb_used, 41 AS n_features FROM ex GROUP BY 1""")
def _(spark, sf):
    ok, _short = an.anomaly_metrics(_fused(spark, sf), KEY, 41)
    return b.rounded(ok, 6, "flagged_pct", "avg_severity")


def _pipeline() -> FeaturePipeline:
    return FeaturePipeline(FeatureConfig(keys=KEY))


@query("isolation_forest_fit")
def _(spark, sf):
    """Trees of every series: how many, their sample and their size."""
    pipe = _pipeline()
    rows = drop_incomplete(pipe.fit_transform(daily(spark, sf)), pipe.columns)
    matrix = stage(rows.select("kpi_id", "timestamp", F.array(*[F.col(c).cast("double") for c in pipe.columns]).alias("x")))
    forest = iso.fit_forest(matrix, KEY, ["kpi_id", "timestamp"])
    nodes = 2 * F.size(F.filter("feature", lambda f: f >= 0)) + 1
    return forest.groupBy("kpi_id").agg(F.count("*").alias("trees"), F.max("psi").alias("sample"), F.sum(nodes).alias("nodes"))


@query("isolation_forest_score")
def _(spark, sf):
    model, scored, _metrics, _rejects = en.train_anomaly(daily(spark, sf), _pipeline())
    return b.day_text(scored).select("kpi_id", "day", "value", F.round("isolation_forest", 6).alias("isolation_forest"))


def _labels(rows):
    """Days far above the series' mean are labelled as anomalies, Sundays are unlabelled."""
    mean = rows.groupBy("kpi_id").agg(F.avg("value").alias("m"))
    seen = rows.join(mean, "kpi_id").where(F.weekday("timestamp") != 6)
    return seen.select("kpi_id", "timestamp", (F.col("value") > 1.6 * F.col("m")).cast("int").alias("label"))


@query("supervised_score")
def _(spark, sf):
    """The classifier's score of every day: 300 rounds of depth 6 for each labelled series."""
    rows = daily(spark, sf)
    _model, scored, _metrics, _rejects = en.train_anomaly(rows, _pipeline(), _labels(rows))
    return b.day_text(scored).select("kpi_id", "day", "value", F.round("xgboost", 6).alias("supervised"), "is_anomaly")


@query("anomaly_ensemble")
def _(spark, sf):
    _model, scored, _metrics, _rejects = en.train_anomaly(daily(spark, sf), _pipeline())
    return b.day_text(scored).where("is_anomaly").select("kpi_id", "day", "value", F.round("severity", 6).alias("severity"), "explanation")


@query("score_recent")
def _(spark, sf):
    rows, pipe = daily(spark, sf), _pipeline()
    model, _scored, _metrics, _rejects = en.train_anomaly(rows, pipe)
    return en.score_recent(rows, pipe, model)
