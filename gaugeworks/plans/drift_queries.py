"""Drift between two windows of the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from gaugeworks.operators import adwin as ad
from gaugeworks.operators import drift as dr
from gaugeworks.operators.features import FeatureConfig, FeaturePipeline, drop_incomplete
from gaugeworks.plans import bindings as b
from gaugeworks.plans.registry import query
from gaugeworks.plans.series_queries import KEY, SERIES, daily
from gaugeworks.session import stage

SPLIT = "1998-06-01"
COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber"]


def _windows(spark, sf, shift: bool = False):
    rows = b.table(spark, sf, "lineitem").select("l_returnflag", "l_shipdate", *COLS)
    ref, new = rows.where(F.col("l_shipdate") < SPLIT), rows.where(F.col("l_shipdate") >= SPLIT)
    if shift:
        new = new.withColumn("l_quantity", F.col("l_quantity") * 1.5 + 20).withColumn("l_discount", F.col("l_discount") * 1.1)
    return ref, new


def scores_sql(source: str, keys: str) -> str:
    """``source`` is a CTE body giving keys, feature, side (0 reference, 1 new) and x."""
    k = keys + ", " if keys else ""
    on = "USING (" + k + "feature)"
    return f"""long AS ({source}),
  t AS (SELECT {k}feature, COUNT(*) FILTER (side = 0) AS n0, COUNT(*) FILTER (side = 1) AS n1, MIN(x) AS lo, MAX(x) AS hi,
    AVG(x) FILTER (side = 0) AS m0, AVG(x) FILTER (side = 1) AS m1, STDDEV_POP(x) FILTER (side = 0) AS s0, STDDEV_POP(x) FILTER (side = 1) AS s1,
    list_distinct(quantile_cont(x, [0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1]) FILTER (side = 0)) AS q FROM long WHERE x IS NOT NULL GROUP BY {k}feature),
  e AS (SELECT *, CASE WHEN len(q) >= 3 THEN list_sort(q) WHEN hi - lo >= 1e-9 THEN list_transform(range(0, 11), lambda i: lo + i * (hi - lo) / 10) END AS edges FROM t),
  bin AS (SELECT {k}feature, side, LEAST(len(list_filter(edges, lambda z: z <= x)), len(edges) - 1) AS b FROM long JOIN e {on} WHERE x >= edges[1] AND x <= edges[-1]),
  cnt AS (SELECT {k}feature, b, COUNT(*) FILTER (side = 0) AS c0, COUNT(*) FILTER (side = 1) AS c1 FROM bin GROUP BY {k}feature, b),
  tot AS (SELECT {k}feature, GREATEST(SUM(c0), 1) AS t0, GREATEST(SUM(c1), 1) AS t1 FROM cnt GROUP BY {k}feature),
  full_bins AS (SELECT {'e.' + keys + ', ' if keys else ''}e.feature, UNNEST(range(1, len(edges))) AS b FROM e),
  shares AS (SELECT {k}feature, CASE WHEN COALESCE(c0, 0) = 0 THEN 1e-6 ELSE c0 / t0 END AS r, CASE WHEN COALESCE(c1, 0) = 0 THEN 1e-6 ELSE c1 / t1 END AS w
    FROM full_bins LEFT JOIN cnt USING ({k}feature, b) JOIN tot {on}),
  psi AS (SELECT {k}feature, SUM((w - r) * LN(w / r)) AS psi FROM shares GROUP BY {k}feature),
  steps AS (SELECT {k}feature, x, COUNT(*) FILTER (side = 0) AS a, COUNT(*) FILTER (side = 1) AS c FROM long WHERE x IS NOT NULL GROUP BY {k}feature, x),
  cdf AS (SELECT {k}feature, SUM(a) OVER (PARTITION BY {k}feature ORDER BY x) AS ca, SUM(c) OVER (PARTITION BY {k}feature ORDER BY x) AS cc FROM steps),
  ks AS (SELECT {k}feature, MAX(ABS(ca / n0 - cc / n1)) AS d FROM cdf JOIN t {on} GROUP BY {k}feature),
  lam AS (SELECT *, d * SQRT(n0 * n1 / (n0 + n1)) AS l FROM ks JOIN e {on}),
  scored AS (SELECT lam.*, CASE WHEN edges IS NULL THEN 0 ELSE psi.psi END AS psi, CASE WHEN l < 0.2 THEN 1 ELSE
    LEAST(1, GREATEST(0, 2 * list_sum(list_transform(range(1, 101), lambda j: (CASE WHEN j % 2 = 1 THEN 1 ELSE -1 END) * EXP(-2 * j * j * l * l))))) END AS p
    FROM lam LEFT JOIN psi {on}),
  sev AS (SELECT *, CASE WHEN psi < 0.1 THEN 'none' WHEN psi < 0.2 THEN 'minor' ELSE 'major' END AS psi_severity,
    CASE WHEN p < 0.001 THEN 'major' WHEN p < 0.01 THEN 'minor' ELSE 'none' END AS ks_severity FROM scored),
  found AS (SELECT *, CASE WHEN psi_severity = 'major' AND ks_severity = 'major' THEN 'major' WHEN psi_severity <> 'none' AND ks_severity <> 'none' THEN 'minor' ELSE 'none' END AS severity
    FROM sev WHERE n0 >= 30 AND n1 >= 30)"""


def _source(key: str = "", shift: bool = False) -> str:
    k = f"{key}, " if key else ""
    x = {c: c for c in COLS}
    new = dict(x, l_quantity="l_quantity * 1.5 + 20", l_discount="l_discount * 1.1") if shift else x
    return " UNION ALL ".join(
        f"SELECT {k}'{c}' AS feature, CAST(l_shipdate >= TIMESTAMP '{SPLIT}' AS INTEGER) AS side, "
        f"CAST(CASE WHEN l_shipdate >= TIMESTAMP '{SPLIT}' THEN {new[c]} ELSE {c} END AS DOUBLE) AS x FROM lineitem"
        for c in COLS
    )


def _flat(df, *lead):
    return df.select(
        *lead, "feature", F.round("psi", 6).alias("psi"), F.round("ks", 8).alias("ks"), F.round("p", 6).alias("p"),
        F.round("ref.mean", 6).alias("ref_mean"), F.round("ref.std", 6).alias("ref_std"), F.col("ref.n").alias("ref_n"),
        F.round("new.mean", 6).alias("new_mean"), F.round("new.std", 6).alias("new_std"), F.col("new.n").alias("new_n"),
        *[c for c in ("psi_severity", "ks_severity", "severity") if c in df.columns],
    )


_FLAT = """feature, ROUND(psi, 6) AS psi, ROUND(d, 8) AS ks, ROUND(p, 6) AS p, ROUND(m0, 6) AS ref_mean, ROUND(s0, 6) AS ref_std, n0 AS ref_n,
  ROUND(m1, 6) AS new_mean, ROUND(s1, 6) AS new_std, n1 AS new_n"""
_SEV = ", psi_severity, ks_severity, severity"


@query("psi_and_ks", f"WITH {scores_sql(_source(), '')} SELECT {_FLAT} FROM scored")
def _(spark, sf):
    return _flat(dr.feature_scores(*_windows(spark, sf), [], COLS))


@query("psi_and_ks_ranged", f"WITH {scores_sql(_source(), '')} SELECT {_FLAT} FROM scored")
def _(spark, sf):
    """The same table with the values cut into many ranges."""
    return _flat(dr.feature_scores(*_windows(spark, sf), [], COLS, buckets=32))


@query("compare_windows", f"WITH {scores_sql(_source(shift=True), '')} SELECT {_FLAT}{_SEV} FROM found")
def _(spark, sf):
    return _flat(dr.compare_windows(*_windows(spark, sf, True), features=COLS))


@query("compare_windows_by_key", f"WITH {scores_sql(_source('l_returnflag', True), 'l_returnflag')} SELECT l_returnflag, {_FLAT}{_SEV} FROM found")
def _(spark, sf):
    return _flat(dr.compare_windows(*_windows(spark, sf, True), keys=["l_returnflag"], features=COLS), "l_returnflag")


def _decision(keys: str, n: int, compared: str = "found") -> str:
    k = keys + ", " if keys else ""
    return f"""d AS (SELECT {k}COUNT(*) FILTER (severity = 'major') AS n_major, COUNT(*) FILTER (severity = 'minor') AS n_minor,
  COALESCE(STRING_AGG(feature, ',' ORDER BY feature) FILTER (severity <> 'none'), '') AS drifted FROM {compared} {'GROUP BY ' + keys if keys else ''}),
  decision AS (SELECT {k}{n} AS n_features_checked, n_major, n_minor, drifted,
  CASE WHEN n_major > 0 THEN 'major' WHEN n_minor > 0 THEN 'minor' ELSE 'none' END AS overall_severity, n_major >= 1 OR n_minor >= 6 AS should_retrain,
  'Checked {n} numeric features · ' || n_major || ' major drift, ' || n_minor || ' minor · recommendation: ' || CASE WHEN n_major >= 1 OR n_minor >= 6 THEN 'RETRAIN' ELSE 'no action' END AS summary FROM d)"""


def _texted(df):
    return df.withColumn("drifted", F.concat_ws(",", "drifted_features")).drop("drifted_features")


@query("retrain_decision", f"WITH {scores_sql(_source(shift=True), '')}, {_decision('', len(COLS))} SELECT * FROM decision")
def _(spark, sf):
    return _texted(dr.retrain_decision(dr.compare_windows(*_windows(spark, sf, True), features=COLS), [], len(COLS)))


_JOB_SOURCE = """SELECT kpi_id, 'value' AS feature, CAST(ts >= DATE '1999-01-01' AS INTEGER) AS side,
  CASE WHEN ts >= DATE '1999-01-01' AND kpi_id = '2-HIGH' THEN value * 1.5 + 200 ELSE value END AS x FROM s"""


def _shifted_series(spark, sf):
    moved = (F.col("kpi_id") == "2-HIGH") & (F.col("timestamp") >= "1999-01-01")
    return stage(b.daily_series(spark, sf).withColumn("value", F.when(moved, F.col("value") * 1.5 + 200).otherwise(F.col("value"))))


@query("drift_job", f"""WITH {SERIES}, {scores_sql(_JOB_SOURCE, 'kpi_id')}, {_decision('kpi_id', 1)}
  SELECT *, overall_severity = 'major' AS "trigger", n_major + n_minor AS n_drifted FROM decision""")
def _(spark, sf):
    t = F.col("timestamp")
    return _texted(dr.drift_job(_shifted_series(spark, sf), t < "1999-01-01", t >= "1999-01-01", KEY))


_FEATURE_SQL = """f AS (SELECT kpi_id, ts, value, LAG(value, 1) OVER w AS lag_1, LAG(value, 7) OVER w AS lag_7, MIN(value) OVER r AS lo, MAX(value) OVER r AS hi,
  COUNT(value) OVER r AS n, ts >= DATE '1999-01-01' AS late FROM {src} WINDOW w AS (PARTITION BY kpi_id, ts >= DATE '1999-01-01' ORDER BY ts),
  r AS (PARTITION BY kpi_id, ts >= DATE '1999-01-01' ORDER BY ts ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING)),
  g AS (SELECT kpi_id, late, UNNEST([{{'n': 'value', 'x': value}}, {{'n': 'lag_1', 'x': lag_1}}, {{'n': 'lag_7', 'x': lag_7}}]) AS u FROM f WHERE lag_7 IS NOT NULL)"""


@query("feature_drift", f"""WITH {SERIES}, {_FEATURE_SQL.format(src='s')},
  {scores_sql("SELECT kpi_id, u.n AS feature, CAST(late AS INTEGER) AS side, u.x AS x FROM g", 'kpi_id')} SELECT kpi_id, {_FLAT}{_SEV} FROM found""")
def _(spark, sf):
    """Features are built on each window by itself, incomplete rows dropped, then compared."""
    rows = daily(spark, sf)
    cfg = dict(keys=KEY, lags=(1, 7), rolling=(), diffs=(), ema_alphas=(), calendar=True)
    sides = []
    for side in (rows.where(F.col("timestamp") < "1999-01-01"), rows.where(F.col("timestamp") >= "1999-01-01")):
        pipe = FeaturePipeline(FeatureConfig(**cfg))
        sides.append(drop_incomplete(pipe.fit_transform(side), pipe.columns))
    return _flat(dr.compare_windows(*sides, keys=KEY), "kpi_id")


# adaptive window ---------------------------------------------------------------------------


def _stepped(spark, sf):
    """Events of each type, with a step in the second half so that the window is cut."""
    late = F.col("ts") >= "2024-01-16"
    return b.table(spark, sf, "events").select(
        "event_type", "ts", "event_id", F.when(late, F.col("value") + 40).otherwise(F.col("value")).alias("value")
    )


@query("adwin")
def _(spark, sf):
    out = ad.adwin(_stepped(spark, sf), ["event_type"], ["ts", "event_id"], "value")
    return b.time_text(out, "ts")


@query("adwin_chunked")
def _(spark, sf):
    out = ad.adwin(_stepped(spark, sf), ["event_type"], ["ts", "event_id"], "value", chunk=1024)
    return b.time_text(out, "ts")


@query("residual_drift")
def _(spark, sf):
    """Residuals of the naive prediction (the day before) of every daily series."""
    rows = _shifted_series(spark, sf)
    pipe = FeaturePipeline(FeatureConfig(keys=KEY, lags=(1,), rolling=(), diffs=(), ema_alphas=(), calendar=False, fourier_periods=()))
    guess = pipe.fit_transform(rows).where("lag_1 IS NOT NULL").select("kpi_id", "timestamp", F.col("lag_1").alias("yhat"))
    return ad.residual_drift(guess, rows, KEY)


_USERS = """SELECT user_id, 'value' AS feature, CAST(ts >= TIMESTAMP '2024-01-16' AS INTEGER) AS side,
  CASE WHEN ts >= TIMESTAMP '2024-01-16' AND user_id % 3 = 0 THEN value + 40 ELSE value END AS x FROM events"""


@query("drift_job_all_series", f"""WITH {scores_sql(_USERS, 'user_id')},
  everyone AS (SELECT user_id, feature, COALESCE(severity, 'none') AS severity FROM (SELECT DISTINCT user_id FROM events) LEFT JOIN found USING (user_id)),
  {_decision('user_id', 1, 'everyone')} SELECT *, overall_severity = 'major' AS "trigger", n_major + n_minor AS n_drifted FROM decision""")
def _(spark, sf):
    """Every third user's values step up; users with too few events to compare get a decision as well."""
    early = F.col("ts") < "2024-01-16"
    moved = ~early & (F.col("user_id") % 3 == 0)
    events = b.table(spark, sf, "events").select(
        "user_id", "ts", F.when(moved, F.col("value") + 40).otherwise(F.col("value")).alias("value")
    )
    return _texted(dr.drift_job(stage(events), early, ~early, ["user_id"], features=["value"]))
