"""Jobs and streams on the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from gaugeworks.operators import forecast as fc
from gaugeworks.plans import bindings as b
from gaugeworks.plans import jobs
from gaugeworks.plans.drift_queries import _JOB_SOURCE, _decision, _shifted_series, scores_sql
from gaugeworks.plans.registry import query
from gaugeworks.plans.series_queries import MONTHS, SERIES, daily, monthly
from gaugeworks.plans.source_queries import scratch
from gaugeworks.sources.readers import scan_stream
from gaugeworks.sources.store import TableStore
from gaugeworks.streaming import streams as stm


def _owned(df):
    return df.withColumn("customer_id", F.lit("demo"))


@query("write_forecasts", f"""WITH {MONTHS}, t AS (SELECT kpi_id, value, ROW_NUMBER() OVER (PARTITION BY kpi_id ORDER BY ts) AS rn, COUNT(*) OVER (PARTITION BY kpi_id) AS n, MAX(ts) OVER (PARTITION BY kpi_id) AS last FROM s)
  SELECT kpi_id, 'demo' AS customer_id, strftime(last + to_months(CAST(i AS INTEGER)), '%Y-%m-%d') AS day, ROUND(value, 2) + CASE WHEN i <= 2 THEN 1 ELSE 0 END AS yhat
  FROM range(1, 7) r(i) JOIN t ON rn = n - 12 + i""")
def _(spark, sf):
    """Six months are stored, then the first two are forecast again one higher."""
    rows = monthly(spark, sf).select("kpi_id", F.date_format("timestamp", "yyyy-MM").alias("month"), "value")
    ahead = fc.seasonal_naive(rows, ["kpi_id"], 6)
    ahead = _owned(ahead.select("kpi_id", F.to_timestamp(F.concat("month", F.lit("-01"))).alias("timestamp"), "yhat", "step"))
    store = TableStore(spark, scratch(spark, "store"))
    store.write_forecasts("revenue", ahead.drop("step"))
    store.write_forecasts("revenue", ahead.where("step <= 2").withColumn("yhat", F.col("yhat") + 1).drop("step"))
    return b.day_text(store.read("forecasts_revenue"))


@query("run_drift_check", f"""WITH {SERIES}, {scores_sql(_JOB_SOURCE, 'kpi_id')}, {_decision('kpi_id', 1)}
  SELECT 'demo' AS customer_id, kpi_id FROM decision WHERE overall_severity = 'major'""")
def _(spark, sf):
    t = F.col("timestamp")
    return jobs.run_drift_check(_owned(_shifted_series(spark, sf)), t < "1999-01-01", t >= "1999-01-01")[1]


@query("run_training")
def _(spark, sf):
    return jobs.run_training(TableStore(spark, scratch(spark, "store")), _owned(daily(spark, sf)), scratch(spark, "models"))


@query("run_predict")
def _(spark, sf):
    """Train the ensemble, then forecast and score the last rows with it."""
    store, models = TableStore(spark, scratch(spark, "store")), scratch(spark, "models")
    rows = _owned(daily(spark, sf))
    jobs.run_training(store, rows, models, train_forecast=False)
    return jobs.run_predict(store, rows, models)


# streams -----------------------------------------------------------------------------------


def _event_files(spark, sf):
    """The events as Parquet files that arrive one after the other in time order."""
    path = scratch(spark, "events")
    src = b.table(spark, sf, "events").select("event_id", "ts", "user_id", "event_type", "value")
    cuts = [None, "2024-01-11", "2024-01-21", None]
    for since, until in zip(cuts, cuts[1:]):
        part = src
        if since:
            part = part.where(F.col("ts") >= since)
        if until:
            part = part.where(F.col("ts") < until)
        part.write.mode("append").parquet(path)
    return path, src.schema


_WINDOW = """SELECT strftime({start}, '%Y-%m-%d %H:%M:%S.%f') AS window_start, event_type, COUNT(*) AS n, CAST(SUM(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS total
  FROM {src} WHERE {start} + INTERVAL {length} <= (SELECT MAX(ts) - INTERVAL 1 HOUR FROM events) GROUP BY {start}, event_type"""


def _kpi_stream(spark, sf, window: str, slide: str | None = None):
    path, schema = _event_files(spark, sf)
    aggs = {"n": F.count("*"), "total": F.sum(F.col("value").cast("decimal(18,2)")).cast("double")}
    live = stm.stream_kpi_windows(scan_stream(spark, path, schema), aggs, ["event_type"], window=window, slide=slide)
    out = stm.run_to_table(live, scratch(spark, "windows"), scratch(spark, "progress"))
    return b.time_text(out, "window_start").drop("window_end")


@query("stream_kpi_windows", _WINDOW.format(start="date_trunc('day', ts)", length="1 DAY", src="events"))
def _(spark, sf):
    return _kpi_stream(spark, sf, "1 day")


@query("stream_kpi_sliding_windows", _WINDOW.format(start="st", length="12 HOUR", src="""(SELECT *, time_bucket(INTERVAL 6 HOUR, ts) - to_hours(CAST(6 * k AS INTEGER)) AS st FROM events, range(0, 2) r(k))"""))
def _(spark, sf):
    return _kpi_stream(spark, sf, "12 hours", "6 hours")


@query("stream_sessions", """WITH e AS (SELECT user_id, ts, value, CASE WHEN ts - LAG(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events),
  s AS (SELECT *, SUM(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS no FROM e)
  SELECT user_id, strftime(MIN(ts), '%Y-%m-%d %H:%M:%S.%f') AS session_start, COUNT(*) AS n, CAST(SUM(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS total FROM s
  GROUP BY user_id, no HAVING MAX(ts) + INTERVAL 30 MINUTE <= (SELECT MAX(ts) - INTERVAL 1 HOUR FROM events)""")
def _(spark, sf):
    path, schema = _event_files(spark, sf)
    aggs = {"n": F.count("*"), "total": F.sum(F.col("value").cast("decimal(18,2)")).cast("double")}
    live = stm.stream_sessions(scan_stream(spark, path, schema), ["user_id"], aggs)
    out = stm.run_to_table(live, scratch(spark, "sessions"), scratch(spark, "progress"))
    return b.time_text(out, "session_start").drop("session_end")


@query("stream_adwin")
def _(spark, sf):
    path, schema = _event_files(spark, sf)
    late = F.col("ts") >= "2024-01-16"
    live = scan_stream(spark, path, schema, 1).withColumn("value", F.when(late, F.col("value") + 40).otherwise(F.col("value")))
    out = stm.stream_adwin(live, ["event_type"], "ts", "value")
    return b.time_text(stm.run_to_table(out, scratch(spark, "drift"), scratch(spark, "progress")), "ts")


@query("stream_upsert", """SELECT user_id, CAST(MAX(event_id) AS BIGINT) AS event_id, ARG_MAX(event_type, event_id) AS event_type FROM events GROUP BY 1""")
def _(spark, sf):
    """The latest event of every user: within a batch by event id, across batches by arrival."""
    path, schema = _event_files(spark, sf)
    store = TableStore(spark, scratch(spark, "store"))
    live = scan_stream(spark, path, schema, 1).select("user_id", "event_id", "event_type")
    stm.stream_upsert(live, store, "latest", ["user_id"], "event_id", scratch(spark, "progress")).awaitTermination()
    return store.read("latest")


@query("scan_stream", "SELECT event_type, COUNT(*) AS n FROM events GROUP BY 1")
def _(spark, sf):
    path, schema = _event_files(spark, sf)
    rows = stm.run_to_table(scan_stream(spark, path, schema), scratch(spark, "copy"), scratch(spark, "progress"))
    return rows.groupBy("event_type").agg(F.count("*").alias("n"))
