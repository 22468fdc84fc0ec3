"""Forecasting on the daily and monthly series of the test tables."""

from __future__ import annotations


from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeworks.operators import boosting as bo
from gaugeworks.operators import forecast as fc
from gaugeworks.operators import rollups as roll
from gaugeworks.operators.features import FeatureConfig, FeaturePipeline
from gaugeworks.plans import bindings as b
from gaugeworks.plans.business_queries import MONTHLY, SALES
from gaugeworks.plans.registry import query
from gaugeworks.plans.series_queries import KEY, MONTHS, SERIES, daily, monthly
from gaugeworks.session import stage

STEP = """gaps AS (SELECT kpi_id, ts, epoch_us(CAST(ts AS TIMESTAMP)) - LAG(epoch_us(CAST(ts AS TIMESTAMP))) OVER (PARTITION BY kpi_id ORDER BY ts) AS g FROM s),
  steps AS (SELECT kpi_id, CAST(quantile_cont(g, 0.5) AS BIGINT) AS step_us, COUNT(*) AS n, CAST(MAX(ts) AS TIMESTAMP) AS last FROM gaps GROUP BY 1)"""
TEST, FOLDS = 14, 4
FOLD = f"""folds AS (SELECT kpi_id, n, CAST(f AS INTEGER) AS fold, n - ({FOLDS} - f) * {TEST} AS start FROM steps, range(0, {FOLDS}) r(f)
  WHERE n >= 3 * {TEST} AND n - ({FOLDS} - f) * {TEST} >= 2 * {TEST})"""


@query("infer_step", f"WITH {SERIES}, {STEP} SELECT kpi_id, strftime(last, '%Y-%m-%d') AS last, n, step_us FROM steps")
def _(spark, sf):
    return b.day_text(fc.infer_step(daily(spark, sf), KEY), "last", "last")


@query("future_timestamps", f"""WITH {MONTHS}, {STEP} SELECT kpi_id, CAST(i AS INTEGER) AS step,
  strftime(last + to_microseconds(i * step_us), '%Y-%m-%d %H:%M:%S.%f') AS timestamp FROM steps, range(1, 7) r(i)""")
def _(spark, sf):
    return b.time_text(fc.future_timestamps(fc.infer_step(monthly(spark, sf), KEY), KEY, 6), "timestamp")


@query("backtest_folds", f"WITH {SERIES}, {STEP}, {FOLD} SELECT * FROM folds")
def _(spark, sf):
    sizes = daily(spark, sf).groupBy("kpi_id").agg(F.count("*").alias("n"))
    return fc.backtest_folds(sizes, KEY, FOLDS, TEST)


_GUESS = """g AS (SELECT kpi_id, rn, value, UNNEST([{'m': 'last_value', 'y': LAG(value, 1) OVER w}, {'m': 'last_week', 'y': LAG(value, 7) OVER w},
  {'m': 'two_weeks', 'y': LAG(value, 14) OVER w}]) AS u FROM s WINDOW w AS (PARTITION BY kpi_id ORDER BY ts))"""
_METRICS = """AVG(ABS(value - yhat)) AS mae, SQRT(AVG((value - yhat) * (value - yhat))) AS rmse,
  COALESCE(AVG(CASE WHEN ABS(value) > 1e-9 THEN ABS((value - yhat) / value) END) * 100, CAST('inf' AS DOUBLE)) AS mape, COUNT(*) AS n"""
_FOLD_SCORES = f"""{_GUESS}, fs AS (SELECT kpi_id, u.m AS model, fold, {_METRICS} FROM (SELECT *, u.y AS yhat FROM g) g JOIN folds USING (kpi_id)
  WHERE rn > start AND rn <= start + {TEST} GROUP BY 1, 2, 3)"""
_SCORES = "ROUND(mae, 4) AS mae, ROUND(rmse, 4) AS rmse, ROUND(mape, 4) AS mape"
_BOARD = "board AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY kpi_id ORDER BY mape, rmse, model) AS rank FROM (SELECT kpi_id, model, AVG(mape) AS mape, AVG(rmse) AS rmse, AVG(mae) AS mae, COUNT(*) AS folds FROM fs GROUP BY 1, 2))"
_NAMES = {"last_value": 1, "last_week": 7, "two_weeks": 14}


def _lagged_guesses(rows) -> DataFrame:
    """Earlier values as predictions of three models: kpi_id, timestamp, model, yhat."""
    cfg = FeatureConfig(keys=KEY, lags=tuple(_NAMES.values()), rolling=(), diffs=(), ema_alphas=(), calendar=False, fourier_periods=())
    wide = FeaturePipeline(cfg).fit_transform(rows)
    named = wide.select("kpi_id", "timestamp", *[F.col(f"lag_{k}").alias(n) for n, k in _NAMES.items()])
    return named.unpivot(["kpi_id", "timestamp"], list(_NAMES), "model", "yhat")


def _fold_scores(spark, sf) -> DataFrame:
    rows = daily(spark, sf)
    sizes = rows.groupBy("kpi_id").agg(F.count("*").alias("n"))
    tests = fc.fold_actuals(rows, KEY, fc.backtest_folds(sizes, KEY, FOLDS, TEST), TEST)
    return fc.forecast_metrics(tests.join(_lagged_guesses(rows), ["kpi_id", "timestamp"]), ["kpi_id", "model", "fold"])


def _four(df, *cols):
    return b.rounded(df, 4, *cols)


@query("forecast_metrics", f"WITH {SERIES}, {STEP}, {FOLD}, {_FOLD_SCORES} SELECT kpi_id, model, fold, {_SCORES}, n FROM fs")
def _(spark, sf):
    return _four(_fold_scores(spark, sf), "mae", "rmse", "mape")


@query("scoreboard", f"WITH {SERIES}, {STEP}, {FOLD}, {_FOLD_SCORES}, {_BOARD} SELECT kpi_id, model, {_SCORES}, folds, rank FROM board")
def _(spark, sf):
    return _four(fc.scoreboard(_fold_scores(spark, sf), KEY), "mae", "rmse", "mape")


_PICK = """pick AS (SELECT kpi_id, MAX(model) FILTER (rank = 1) AS winner, MAX(mape) FILTER (rank = 1) AS m1, MAX(rmse) FILTER (rank = 1) AS r1, MAX(mae) FILTER (rank = 1) AS a1,
  MAX(folds) FILTER (rank = 1) AS f1, MAX(model) FILTER (rank = 2) AS runner_up, MAX(mape) FILTER (rank = 2) AS m2, STRING_AGG(model, ',' ORDER BY model) AS candidates FROM board GROUP BY 1)"""


@query("selection_reason", f"""WITH {SERIES}, {STEP}, {FOLD}, {_FOLD_SCORES}, {_BOARD}, {_PICK} SELECT kpi_id, winner, runner_up,
  'Selected ' || winner || ': lowest MAPE (' || printf('%.2f', m1) || '%) across ' || f1 || ' backtest folds. Runner-up ' || runner_up || ' had MAPE ' || printf('%.2f', m2) || '%.' AS reason FROM pick""")
def _(spark, sf):
    return fc.select_models(fc.scoreboard(_fold_scores(spark, sf), KEY), KEY).select("kpi_id", "winner", "runner_up", "reason")


@query("training_metrics", f"""WITH {SERIES}, {STEP}, {FOLD}, {_FOLD_SCORES}, {_BOARD}, {_PICK} SELECT kpi_id, winner, ROUND(m1, 4) AS winning_mape, ROUND(r1, 4) AS winning_rmse,
  ROUND(a1, 4) AS winning_mae, n AS n_train_rows, 30 AS horizon, candidates FROM pick JOIN steps USING (kpi_id)""")
def _(spark, sf):
    picked = fc.select_models(fc.scoreboard(_fold_scores(spark, sf), KEY), KEY)
    sizes = daily(spark, sf).groupBy("kpi_id").agg(F.count("*").alias("n"))
    return _four(fc.training_metrics(picked, sizes, KEY, 30), "winning_mape", "winning_rmse", "winning_mae")


@query("interval95", f"""WITH {SERIES}, {_GUESS}, r AS (SELECT kpi_id, STDDEV_POP(value - u.y) AS sd, ARG_MAX(value, rn) AS last FROM g WHERE u.m = 'last_value' GROUP BY 1)
  SELECT kpi_id, CAST(i AS INTEGER) AS step, last AS yhat, ROUND(last - 1.96 * sd * SQRT(i), 3) AS lower95, ROUND(last + 1.96 * sd * SQRT(i), 3) AS upper95 FROM r, range(1, 8) t(i)""")
def _(spark, sf):
    rows = daily(spark, sf)
    guess = _lagged_guesses(rows).where("model = 'last_value'")
    both = rows.join(guess, ["kpi_id", "timestamp"])
    fit = both.groupBy("kpi_id").agg(F.stddev_pop(F.col("value") - F.col("yhat")).alias("sd"), F.max_by("value", "timestamp").alias("yhat"))
    steps = fit.select("*", F.explode(F.sequence(F.lit(1), F.lit(7))).alias("step"))
    low, high = fc.interval95(F.col("yhat"), F.col("sd"), F.col("step"))
    return steps.select("kpi_id", "step", "yhat", F.round(low, 3).alias("lower95"), F.round(high, 3).alias("upper95"))


def _company_months(spark, sf, metric: str = "revenue") -> DataFrame:
    rows = roll.monthly_series(roll.rollup_monthly(b.sales(spark, sf)), metric)
    return rows.select(F.lit(metric).alias("metric"), "month", "value")


@query("seasonal_naive", f"""WITH {SALES}, m AS (SELECT month, ROUND(revenue, 2) AS value, ROW_NUMBER() OVER (ORDER BY month) AS rn, COUNT(*) OVER () AS n, MAX(month) OVER () AS last FROM ({MONTHLY}))
  SELECT 'revenue' AS metric, CAST(i AS INTEGER) AS step, strftime(CAST(last || '-01' AS DATE) + to_months(CAST(i AS INTEGER)), '%Y-%m') AS month, value AS yhat
  FROM range(1, 19) r(i) JOIN m ON rn = n - 12 + ((i - 1) % 12) + 1""")
def _(spark, sf):
    return fc.seasonal_naive(_company_months(spark, sf), ["metric"], 18)


@query("monthly_forecast")
def _(spark, sf):
    both = _company_months(spark, sf).unionByName(_company_months(spark, sf, "units"))
    return fc.monthly_forecast(stage(both), ["metric"], 6)


def _one_model(name: str) -> None:
    @query(f"forecast_{name}")
    def _(spark, sf):
        """Fit one model to every daily series and forecast two weeks."""
        rows = daily(spark, sf)
        steps = stage(fc.infer_step(rows, KEY))
        full = steps.select("kpi_id", F.lit(fc.FULL).alias("fold"), F.col("n").alias("start"))
        ahead = fc.predict(fc.fit_models(fc.pack_series(rows, KEY), KEY, full, [name]), KEY, steps, TEST).drop("fold")
        return ahead.join(fc.future_timestamps(steps, KEY, TEST), ["kpi_id", "step"])


for _name in ("arima", "sarima", "holt_winters", "prophet"):
    _one_model(_name)


@query("fit_models_chunked")
def _(spark, sf):
    """The same fits with every series cut into chunks of 200 values and fitted by rounds."""
    rows = daily(spark, sf)
    full = rows.groupBy("kpi_id").agg(F.count("*").alias("start")).withColumn("fold", F.lit(fc.FULL))
    fits = fc.fit_models(fc.pack_series(rows, KEY, 200), KEY, full, None, 200, local_chunks=1)
    return fits.select("kpi_id", "model", "start", F.round("sigma", 3).alias("sigma"), "reason")


def _trees(kind: str) -> None:
    @query(f"forecast_{kind}")
    def _(spark, sf):
        """A tree model for every daily series, two weeks ahead: 400 rounds of depth 6."""
        rows = daily(spark, sf)
        steps = stage(fc.infer_step(rows, KEY))
        full = steps.select("kpi_id", F.lit(fc.FULL).alias("fold"), F.col("n").alias("start"))
        return bo.tree_forecast(rows, KEY, full, steps, TEST, kind).drop("fold")


for _name in bo.KINDS:
    _trees(_name)


@query("backtest")
def _(spark, sf):
    return fc.backtest(daily(spark, sf), KEY)


@query("autoselect")
def _(spark, sf):
    _ahead, board, _chosen, _rejects = fc.forecast(monthly(spark, sf), KEY, 6)
    return board


@query("forecast")
def _(spark, sf):
    return fc.forecast(monthly(spark, sf), KEY, 6)[0]


@query("forecast_selected_models")
def _(spark, sf):
    """Only the named candidates take part."""
    return fc.forecast(monthly(spark, sf), KEY, 6, 3, 6, ["holt_winters", "prophet"])[2]




@query("forecast_rejects", """SELECT user_id, COUNT(*) AS n, CAST(COUNT(*) AS VARCHAR) || ' values are too few for a backtest of 14' AS reason
  FROM (SELECT user_id, CAST(ts AS DATE) AS day FROM events GROUP BY 1, 2) GROUP BY 1""")
def _(spark, sf):
    """A month of days is too short for a backtest, and every such series says so."""
    days = b.table(spark, sf, "events").groupBy("user_id", F.to_date("ts").cast("timestamp").alias("timestamp")).agg(F.sum("value").alias("value"))
    return fc.forecast(days, ["user_id"], 7, 4, 14, ["holt_winters"])[3]
