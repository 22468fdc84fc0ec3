"""Features, rolling anomalies and insights on daily and monthly series of the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from gaugeworks.functions.kpi_catalog import CATALOG
from gaugeworks.functions.ordering import exact_quantiles, ordered_index
from gaugeworks.operators import anomaly as an
from gaugeworks.operators import insights as ins
from gaugeworks.operators.features import FeatureConfig, FeaturePipeline, conform_schema, drop_incomplete
from gaugeworks.plans import bindings as b
from gaugeworks.plans.registry import query
from gaugeworks.session import stage

KEY = ["kpi_id"]
SERIES = """series AS (SELECT o_orderpriority AS kpi_id, CAST(o_orderdate AS DATE) AS ts,
  CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS value FROM orders GROUP BY 1, 2),
  s AS (SELECT *, strftime(ts, '%Y-%m-%d') AS day, ROW_NUMBER() OVER (PARTITION BY kpi_id ORDER BY ts) AS rn FROM series)"""
MONTHS = """series AS (SELECT o_orderpriority AS kpi_id, date_trunc('month', o_orderdate) AS ts,
  CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS value FROM orders GROUP BY 1, 2),
  s AS (SELECT *, strftime(ts, '%Y-%m-%d') AS day, ROW_NUMBER() OVER (PARTITION BY kpi_id ORDER BY ts) AS rn FROM series)"""
W = "OVER (PARTITION BY kpi_id ORDER BY ts)"


def daily(spark, sf):
    return stage(b.daily_series(spark, sf))


def monthly(spark, sf):
    return stage(b.monthly_revenue(spark, sf))


def config(**kw) -> FeatureConfig:
    none = {"lags": (), "rolling": (), "diffs": (), "ema_alphas": (), "calendar": False, "fourier_periods": ()}
    return FeatureConfig(keys=KEY, **{**none, **kw})


def features(spark, sf, cfg: FeatureConfig, **kw):
    return b.day_text(FeaturePipeline(cfg).fit_transform(daily(spark, sf), **kw))


# ordering helpers --------------------------------------------------------------------------


@query("ordered_index", "SELECT event_id, ROW_NUMBER() OVER (ORDER BY ts, event_id) AS rn FROM events")
def _(spark, sf):
    return ordered_index(b.table(spark, sf, "events").select("event_id", "ts"), [], ["ts", "event_id"]).select("event_id", "rn")


_QUANTILES = """SELECT event_type, ROUND(quantile_cont(value, 0.05), 6) AS q05, ROUND(quantile_cont(value, 0.5), 6) AS q50,
  ROUND(quantile_cont(value, 0.95), 6) AS q95, COUNT(value) AS n FROM events GROUP BY 1"""


def _quantiles(spark, sf, **kw):
    q = exact_quantiles(b.table(spark, sf, "events"), ["event_type"], "value", [0.05, 0.5, 0.95], **kw)
    return q.select("event_type", *[F.round(F.element_at("q", i + 1), 6).alias(n) for i, n in enumerate(("q05", "q50", "q95"))], "n")


@query("exact_quantiles", _QUANTILES)
def _(spark, sf):
    return _quantiles(spark, sf)


@query("exact_quantiles_ranged", _QUANTILES)
def _(spark, sf):
    """The same table with the values cut into many ranges."""
    return _quantiles(spark, sf, buckets=32)


# features ----------------------------------------------------------------------------------

_LAGS = ", ".join(f"LAG(value, {k}) {W} AS lag_{k}" for k in (1, 7, 14, 28))
_DIFFS = ", ".join(f"ROUND(value - LAG(value, {d}) {W}, 4) AS diff_{d}" for d in (1, 7))


def _rolling(n: int) -> str:
    f = f"OVER (PARTITION BY kpi_id ORDER BY ts ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"
    ok = f"COUNT(value) {f} >= {max(2, n // 2)}"
    return ", ".join(
        f"CASE WHEN {ok} THEN {x} END AS roll_{name}_{n}"
        for name, x in (
            ("mean", f"ROUND(AVG(value) {f}, 4)"), ("std", f"ROUND(STDDEV_SAMP(value) {f}, 3)"),
            ("min", f"MIN(value) {f}"), ("max", f"MAX(value) {f}"),
        )
    )


_ROLL = ", ".join(_rolling(n) for n in (7, 14, 28))
_CAL = """isodow(ts) - 1 AS dow, day(ts) AS dom, weekofyear(ts) AS week, month(ts) AS month, quarter(ts) AS quarter, year(ts) AS year,
  CAST(ts = last_day(ts) AS INTEGER) AS is_month_end, CAST(day(ts) = 1 AS INTEGER) AS is_month_start, CAST(isodow(ts) >= 6 AS INTEGER) AS is_weekend"""
_FOUR = ", ".join(
    f"ROUND({f}(2 * PI() * {k} * (ts - MIN(ts) OVER (PARTITION BY kpi_id)) / {p}.0), 6) AS fourier_{f}_{p}_{k}"
    for p in (7, 365) for k in (1, 2, 3) for f in ("sin", "cos")
)
_EMA = """e AS (SELECT kpi_id, 2 AS rn, value AS a, value AS c FROM s WHERE rn = 1
  UNION ALL SELECT e.kpi_id, e.rn + 1, 0.7 * a + 0.3 * s.value, 0.9 * c + 0.1 * s.value FROM e JOIN s ON s.kpi_id = e.kpi_id AND s.rn = e.rn)"""
_EMA_COLS = "ROUND(a, 3) AS ema_0_3, ROUND(c, 3) AS ema_0_1"


def _round_features(df):
    digits = {"roll_mean": 4, "roll_std": 3, "diff": 4, "ema": 3, "fourier": 6}
    return df.select(*[
        next((F.round(c, d).alias(c) for p, d in digits.items() if c.startswith(p)), F.col(c)) for c in df.columns
    ])


@query("lag_features", f"WITH {SERIES} SELECT kpi_id, day, value, {_LAGS} FROM s")
def _(spark, sf):
    return features(spark, sf, config(lags=(1, 7, 14, 28)))


@query("rolling_features", f"WITH {SERIES} SELECT kpi_id, day, value, {_ROLL} FROM s")
def _(spark, sf):
    return _round_features(features(spark, sf, config(rolling=(7, 14, 28))))


@query("diff_features", f"WITH {SERIES} SELECT kpi_id, day, value, {_DIFFS} FROM s")
def _(spark, sf):
    return _round_features(features(spark, sf, config(diffs=(1, 7))))


@query("ema_features", f"WITH RECURSIVE {SERIES}, {_EMA} SELECT s.kpi_id, day, value, {_EMA_COLS} FROM s LEFT JOIN e ON e.kpi_id = s.kpi_id AND e.rn = s.rn")
def _(spark, sf):
    return _round_features(features(spark, sf, config(ema_alphas=(0.3, 0.1))))


@query("calendar_features", f"WITH {SERIES} SELECT kpi_id, day, value, {_CAL} FROM s")
def _(spark, sf):
    return features(spark, sf, config(calendar=True))


@query("fourier_features", f"WITH {SERIES} SELECT kpi_id, day, value, {_FOUR} FROM s")
def _(spark, sf):
    return _round_features(features(spark, sf, config(fourier_periods=(7, 365))))


_ALL = f"""WITH RECURSIVE {SERIES}, {_EMA}, f AS (SELECT kpi_id, rn, day, value, {_LAGS}, {_ROLL}, {_DIFFS}, {_CAL}, {_FOUR} FROM s)
  SELECT f.* EXCLUDE (rn), {_EMA_COLS} FROM f LEFT JOIN e ON e.kpi_id = f.kpi_id AND e.rn = f.rn"""


@query("feature_pipeline", _ALL)
def _(spark, sf):
    return _round_features(features(spark, sf, FeatureConfig(keys=KEY)))


@query("feature_pipeline_chunked", _ALL)
def _(spark, sf):
    """The same table with the series cut into many ranges."""
    return _round_features(features(spark, sf, FeatureConfig(keys=KEY), buckets=24))


@query("drop_incomplete", f"SELECT kpi_id, COUNT(*) AS n, MIN(day) AS first FROM ({_ALL}) WHERE lag_28 IS NOT NULL GROUP BY 1")
def _(spark, sf):
    pipe = FeaturePipeline(FeatureConfig(keys=KEY))
    full = b.day_text(pipe.fit_transform(daily(spark, sf)))
    return drop_incomplete(full, [*pipe.columns, "value"]).groupBy("kpi_id").agg(F.count("*").alias("n"), F.min("day").alias("first"))


@query("conform_schema", f"WITH {SERIES} SELECT kpi_id, day, LAG(value, 7) {W} AS lag_7, CAST(NULL AS DOUBLE) AS absent, LAG(value, 1) {W} AS lag_1 FROM s")
def _(spark, sf):
    return conform_schema(features(spark, sf, config(lags=(1, 7, 14))), ["lag_7", "absent", "lag_1"], ["kpi_id", "day"])


@query("lock_schema", f"""WITH {SERIES}, c AS (SELECT kpi_id, LAG(value, 1) {W} AS lag_1, LAG(value, 7) {W} AS lag_7, value - LAG(value, 1) {W} AS diff_1 FROM s)
  SELECT 1 AS position, 'lag_1' AS name, COUNT(lag_1) AS n FROM c UNION ALL SELECT 2, 'lag_7', COUNT(lag_7) FROM c UNION ALL SELECT 3, 'diff_1', COUNT(diff_1) FROM c""")
def _(spark, sf):
    """The locked feature names in order, with the number of values each holds."""
    pipe = FeaturePipeline(config(lags=(1, 7), diffs=(1,)))
    full = pipe.fit_transform(daily(spark, sf))
    counts = full.agg(*[F.count(c).alias(c) for c in pipe.columns])
    return counts.select(F.inline(F.array(*[
        F.struct(F.lit(i + 1).alias("position"), F.lit(c).alias("name"), F.col(c).alias("n")) for i, c in enumerate(pipe.columns)
    ])))


@query("passthrough", f"WITH {SERIES} SELECT kpi_id, day, value, rn, CAST(NULL AS DOUBLE) AS promo, LAG(value, 1) {W} AS lag_1 FROM s")
def _(spark, sf):
    rows = ordered_index(daily(spark, sf), KEY, ["timestamp"])
    return b.day_text(FeaturePipeline(config(lags=(1,), extra=("rn", "promo"))).fit_transform(rows))


@query("pipeline_state", f"WITH {SERIES}, f AS (SELECT kpi_id, ts, day, value, {_FOUR}, LAG(value, 1) {W} AS lag_1 FROM s) SELECT * EXCLUDE (ts) FROM f")
def _(spark, sf):
    """Fit, save as JSON and a table, load, transform: the Fourier phase stays that of the fit."""
    fitted = FeaturePipeline(config(lags=(1,), fourier_periods=(7, 365)))
    rows = daily(spark, sf)
    fitted.fit_transform(rows)
    loaded = FeaturePipeline.from_json(fitted.to_json(), stage(fitted.origins))
    return _round_features(b.day_text(loaded.transform(rows)))


# rolling anomalies -------------------------------------------------------------------------


def _human(x: str) -> str:
    return f"""CASE WHEN ABS({x}) >= 1e9 THEN printf('%.2fB', {x} / 1e9) WHEN ABS({x}) >= 1e6 THEN printf('%.2fM', {x} / 1e6)
  WHEN ABS({x}) >= 1e3 THEN printf('%.1fK', {x} / 1e3) ELSE printf('%.2f', {x}) END"""


def _anomalies(series: str) -> str:
    f = "OVER (PARTITION BY kpi_id ORDER BY ts ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING)"
    return f"""{series}, h AS (SELECT kpi_id, ts, day, value, AVG(value) {f} AS expected, STDDEV_POP(value) {f} AS sd0, list_sort(LIST(value) {f}) AS l FROM s),
  z AS (SELECT *, (value - expected) / (CASE WHEN sd0 = 0 THEN 1e-9 ELSE sd0 END) AS z_score, GREATEST(l[10] - l[4], 1e-9) AS iqr FROM h WHERE len(l) = 12),
  d AS (SELECT *, CASE WHEN expected = 0 THEN 0 ELSE (value - expected) / expected * 100 END AS delta_pct FROM z
    WHERE ABS(z_score) >= 2 OR value < l[4] - 1.5 * iqr OR value > l[10] + 1.5 * iqr),
  a AS (SELECT kpi_id, ts, day, value, expected, delta_pct, z_score, CASE WHEN z_score > 0 THEN 'spike' ELSE 'drop' END AS kind,
    CASE WHEN delta_pct < 0 THEN LEAST(1, LEAST(1, (ABS(z_score) - 1) / 4) + 0.2) ELSE LEAST(1, (ABS(z_score) - 1) / 4) END AS severity FROM d),
  anomalies AS (SELECT *, (CASE WHEN delta_pct < 0 THEN '⚠️ ' ELSE '' END) || kpi_id || (CASE WHEN kind = 'spike' THEN ' jumped ' ELSE ' dropped ' END)
    || printf('%.1f', ABS(delta_pct)) || '% (now ' || {_human('value')} || ', expected ~' || {_human('expected')} || ')' AS narrative FROM a)"""


_ANOMALY_COLS = """kpi_id, day, value, ROUND(expected, 4) AS expected, ROUND(delta_pct, 6) AS delta_pct, ROUND(z_score, 6) AS z_score, kind,
  ROUND(severity, 6) AS severity, narrative, severity >= 0.5 AS alert_worthy"""


def _anomaly_rows(df):
    return b.day_text(df).withColumns({
        "expected": F.round("expected", 4), "delta_pct": F.round("delta_pct", 6), "z_score": F.round("z_score", 6), "severity": F.round("severity", 6),
    })


@query("rolling_anomalies", f"WITH {_anomalies(SERIES)} SELECT {_ANOMALY_COLS} FROM anomalies")
def _(spark, sf):
    return _anomaly_rows(an.rolling_anomalies(daily(spark, sf)))


@query("rolling_anomalies_chunked", f"WITH {_anomalies(SERIES)} SELECT {_ANOMALY_COLS} FROM anomalies")
def _(spark, sf):
    return _anomaly_rows(an.rolling_anomalies(daily(spark, sf), buckets=24))


@query("alert_worthy", f"WITH {_anomalies(MONTHS)} SELECT {_ANOMALY_COLS} FROM anomalies WHERE severity >= 0.5")
def _(spark, sf):
    return _anomaly_rows(an.rolling_anomalies(monthly(spark, sf))).where("alert_worthy")


@query("humanize", f"SELECT o_orderkey, {_human('o_totalprice')} AS text, {_human('o_totalprice * 1000.0')} AS thousand FROM orders WHERE o_totalprice > 0")
def _(spark, sf):
    from gaugeworks.functions.text import humanize

    p = F.col("o_totalprice")
    return b.table(spark, sf, "orders").where(p > 0).select("o_orderkey", humanize(p).alias("text"), humanize(p * 1000.0).alias("thousand"))


# insights ----------------------------------------------------------------------------------

def _revenue_of(spark, sf, year):
    return b.revenue(spark, sf).where(_in_year("booked", year))


def _in_year(column: str, year: int):
    """A range test, so that the scan can skip row groups."""
    return (F.col(column) >= f"{year}-01-01") & (F.col(column) < f"{year + 1}-01-01")


@query("decompose_drivers", """WITH m AS (SELECT r_name AS region, year(o_orderdate) AS y, CAST(o_totalprice AS DECIMAL(18,2)) AS amount FROM orders
  JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
  d AS (SELECT region, COALESCE(SUM(amount) FILTER (y = 1999), 0) AS c, COALESCE(SUM(amount) FILTER (y = 1998), 0) AS p FROM m WHERE y IN (1998, 1999) GROUP BY 1),
  k AS (SELECT region, CAST(c AS DOUBLE) AS current, CAST(p AS DOUBLE) AS prior, CAST(c - p AS DOUBLE) AS delta_abs FROM d)
  SELECT region, current, prior, delta_abs, ROUND(delta_abs / ABS(prior) * 100, 6) AS delta_pct, ROW_NUMBER() OVER (ORDER BY ABS(delta_abs) DESC, region) AS rank
  FROM k ORDER BY rank LIMIT 3""")
def _(spark, sf):
    out = ins.decompose_drivers(_revenue_of(spark, sf, 1999), _revenue_of(spark, sf, 1998), "region", "amount")
    return out.withColumn("delta_pct", F.round("delta_pct", 6))


_CUSTOMER_MOVES = """m AS (SELECT o_orderpriority AS kpi_id, o_custkey, year(o_orderdate) AS y, CAST(o_totalprice AS DECIMAL(18,2)) AS amount FROM orders),
  mv AS (SELECT kpi_id, o_custkey, CAST(COALESCE(SUM(amount) FILTER (y = 2000), 0) AS DOUBLE) AS current, CAST(COALESCE(SUM(amount) FILTER (y = 1999), 0) AS DOUBLE) AS prior,
  CAST(COALESCE(SUM(amount) FILTER (y = 2000), 0) - COALESCE(SUM(amount) FILTER (y = 1999), 0) AS DOUBLE) AS delta_abs FROM m WHERE y IN (1999, 2000) GROUP BY 1, 2),
  drv AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY kpi_id ORDER BY ABS(delta_abs) DESC, o_custkey) AS rank FROM mv QUALIFY rank <= 3)"""


def _customer_drivers(spark, sf):
    o = b.table(spark, sf, "orders").withColumn("kpi_id", F.col("o_orderpriority"))
    return ins.drivers_between(o, _in_year("o_orderdate", 2000), _in_year("o_orderdate", 1999), "o_custkey", "o_totalprice", KEY)


@query("decompose_drivers_by_series", f"""WITH {_CUSTOMER_MOVES} SELECT kpi_id, o_custkey, current, prior, delta_abs,
  CASE WHEN prior <> 0 THEN ROUND(delta_abs / ABS(prior) * 100, 6) WHEN delta_abs <> 0 THEN 1e300 ELSE 0 END AS delta_pct, rank FROM drv""")
def _(spark, sf):
    out = _customer_drivers(spark, sf)
    return out.withColumn("delta_pct", F.when(F.col("delta_pct") == float("inf"), 1e300).otherwise(F.round("delta_pct", 6)))


_DIGEST = f"""{_anomalies(MONTHS)}, {_CUSTOMER_MOVES},
  suffix AS (SELECT kpi_id, ' — driven by ' || STRING_AGG(CAST(o_custkey AS VARCHAR) || ' (' || CASE WHEN delta_abs >= 0 THEN '+' ELSE '' END
    || {_human('delta_abs')} || ')', ', ' ORDER BY rank) AS txt FROM drv WHERE rank <= 2 GROUP BY 1),
  ranked AS (SELECT *, severity >= 0.5 AS al, ROW_NUMBER() OVER (PARTITION BY kpi_id, severity >= 0.5 ORDER BY severity DESC, ts) AS r FROM anomalies),
  n AS (SELECT kpi_id, COUNT(*) FILTER (al) AS na, COUNT(*) AS nn FROM ranked GROUP BY 1),
  txt AS (SELECT kpi_id, STRING_AGG('- ' || narrative || COALESCE(suffix.txt, ''), chr(10) ORDER BY r) FILTER (al AND r <= 5) AS alerts,
    STRING_AGG('- ' || narrative, chr(10) ORDER BY r) FILTER (NOT al AND r <= 5) AS quiet FROM ranked LEFT JOIN suffix USING (kpi_id) GROUP BY 1),
  aud AS (SELECT DISTINCT o_orderpriority AS kpi_id FROM orders)
  SELECT kpi_id, COALESCE(na, 0) AS n_alerts, COALESCE(nn, 0) AS n_anomalies,
  concat_ws(chr(10), '# Your 30-day digest', '_2001-07-02 → 2001-08-01_  ·  for **Desk ' || kpi_id || '**', '', '## The big picture', '- Monthly revenue', '',
    CASE WHEN COALESCE(na, 0) > 0 THEN '## ⚠️ ' || na || CASE WHEN na = 1 THEN ' thing that need attention' ELSE ' things that need attention' END || chr(10) || alerts || chr(10) END,
    CASE WHEN COALESCE(nn, 0) > COALESCE(na, 0) THEN '## Heads up' || chr(10) || quiet || chr(10) END,
    CASE WHEN COALESCE(nn, 0) = 0 THEN '## ✅ All quiet' || chr(10) || '- Nothing materially out of bounds in the last period.' || chr(10) END) AS markdown
  FROM aud LEFT JOIN n USING (kpi_id) LEFT JOIN txt USING (kpi_id)"""


def insights_preview(series, audiences, period_end, headlines=(), drivers=None, dimension=None):
    """Anomalies of every series, their drivers if a breakdown is given, and a 30-day digest each."""
    found = an.rolling_anomalies(series, KEY)
    if drivers is not None:
        found = ins.attach_drivers(found, drivers, KEY, dimension)
    return ins.digest_markdown(ins.compose_digest(stage(found), audiences, KEY, period_end, 30, headlines))


@query("insights_preview", f"WITH {_DIGEST}")
def _(spark, sf):
    series = monthly(spark, sf)
    desks = series.select("kpi_id").distinct().withColumn("audience", F.concat(F.lit("Desk "), "kpi_id"))
    out = insights_preview(series, desks, "2001-08-01", ["Monthly revenue"], _customer_drivers(spark, sf), "o_custkey")
    return out.select("kpi_id", "n_alerts", "n_anomalies", "markdown")


SCENARIOS = {
    "growth": {"lift_pct": 10.0},
    "mixed": {"price_pct": -5.0, "volume_factor": 1.2, "note": 3.0},
    "none": {},
}


@query("simulate", f"""WITH {MONTHS}, f AS (SELECT kpi_id, COUNT(*) AS n, REGR_SLOPE(value, rn - 1) AS slope, REGR_INTERCEPT(value, rn - 1) AS ic, ARG_MAX(value, rn) AS last FROM s GROUP BY 1),
  r AS (SELECT kpi_id, STDDEV_POP(value - (slope * (rn - 1) + ic)) AS sd FROM s JOIN f USING (kpi_id) GROUP BY 1),
  sc(scenario, shock) AS (VALUES ('growth', 1.1::DOUBLE), ('mixed', 0.95::DOUBLE * 1.2::DOUBLE), ('none', 1.0::DOUBLE)),
  p AS (SELECT kpi_id, scenario, shock, last, sd, slope * (n - 1 + 12) + ic AS tv, (slope * (n - 1 + 12) + ic) * (1 + (shock - 1)) AS pr FROM f JOIN r USING (kpi_id), sc),
  q AS (SELECT *, pr - last AS da, (pr - last) / last * 100 AS dp, pr - 1.96 * sd AS lo, pr + 1.96 * sd AS hi FROM p)
  SELECT kpi_id, scenario, last AS baseline, ROUND(tv, 3) AS trend_value, ROUND(pr, 3) AS projected, ROUND(da, 3) AS delta_abs, ROUND(dp, 6) AS delta_pct, ROUND(lo, 3) AS low, ROUND(hi, 3) AS high,
  'Baseline trend projects ' || {_human('tv')} || ' by FY26. Applying scenario ''' || scenario || ''' (shock ' || printf('%+.1f', (shock - 1) * 100) || '%) gives ' || {_human('pr')}
  || ' — a ' || printf('%+.1f', dp) || '% change vs today. 95% interval: ' || {_human('lo')} || ' to ' || {_human('hi')} || '.' AS explanation FROM q""")
def _(spark, sf):
    out = ins.simulate(monthly(spark, sf), KEY, SCENARIOS)
    return out.withColumns({
        **{c: F.round(c, 3) for c in ("trend_value", "projected", "delta_abs", "low", "high")}, "delta_pct": F.round("delta_pct", 6),
    })


_REVENUE = CATALOG[0]


@query("explain_number", f"""WITH g AS (SELECT o_orderpriority AS p, o_orderstatus AS st, CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS v, COUNT(*) AS n FROM orders GROUP BY 1, 2)
  SELECT p AS priority, st AS status, 'This ' || {_human('v')} || ' is the {_REVENUE.name.lower()} computed as `{_REVENUE.formula}` from orders (filtered to priority=' || p || ', status=' || st || ', all time), based on ' || format('{{:,}}', n) || ' rows.' AS explanation FROM g""")
def _(spark, sf):
    g = b.table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("priority"), F.col("o_orderstatus").alias("status")).agg(
        F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("value"), F.count("*").alias("rows_used")
    )
    g = g.withColumns({
        "kpi_name": F.lit(_REVENUE.name), "formula": F.lit(_REVENUE.formula),
        "filters": F.create_map(F.lit("priority"), F.col("priority"), F.lit("status"), F.col("status")),
        "source_tables": F.array(F.lit("orders")), "period": F.lit("all time"),
    })
    return ins.explain_number(g).select("priority", "status", "explanation")


@query("period_delta", f"""WITH {MONTHS}, r AS (SELECT kpi_id, value, ROW_NUMBER() OVER (PARTITION BY kpi_id ORDER BY ts DESC) AS k FROM s),
  t AS (SELECT kpi_id, MAX(value) FILTER (k = 1) AS current, MAX(value) FILTER (k = 2) AS previous FROM r GROUP BY 1)
  SELECT *, ROUND((current - previous) / previous * 100, 2) AS delta_pct FROM t""")
def _(spark, sf):
    return ins.period_delta(monthly(spark, sf), KEY)
