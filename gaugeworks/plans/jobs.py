"""Batch jobs: what the schedules run."""

from __future__ import annotations

from pyspark.errors import PySparkValueError
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeworks.functions.ordering import join_same
from gaugeworks.operators import drift as dr
from gaugeworks.operators import ensemble as en
from gaugeworks.operators import forecast as fc
from gaugeworks.operators.features import FeatureConfig, FeaturePipeline
from gaugeworks.sources import readers as rd
from gaugeworks.sources.store import TableStore, ingest, path_exists


def extract(store: TableStore, spec: dict):
    """The source of one ingestion spec as a DataFrame."""
    spark = store.spark
    if spec["kind"] == "csv":
        args = spec.get("source_kwargs", {})
        return rd.scan_csv(spark, spec["path"], spec.get("schema"), args.get("base_dir"), **args.get("options", {}))
    if spec["kind"] == "store":
        return store.scan(spec["query"], spec["tables"])
    return rd.scan_external(spark, spec["kind"], spec["options"])


def run_ingestion(store: TableStore, specs: list[dict]) -> list[dict]:
    """Extract and upsert each spec; one result per spec."""
    return [ingest(store, extract(store, s), s) for s in specs]


SERIES_KEYS = ["customer_id", "kpi_id"]


def check_history(history: DataFrame) -> DataFrame:
    missing = {"timestamp", "value", *SERIES_KEYS} - set(history.columns)
    if missing:
        raise PySparkValueError(f"history must have {sorted(missing)}")
    return history


def run_training(
    store: TableStore,
    history: DataFrame,
    model_root: str,
    horizon: int = 30,
    folds: int = 4,
    test_size: int = 14,
    models: list[str] | None = None,
    train_anomaly: bool = True,
    train_forecast: bool = True,
    labels: DataFrame | None = None,
    config: en.EnsembleConfig | None = None,
    features: FeatureConfig | None = None,
) -> DataFrame:
    """Train all series of ``history`` (customer_id, kpi_id, timestamp, value) in one go.

    Stores the tables ``scoreboard``, ``selection``, ``training_metrics``, ``anomaly_metrics`` and
    ``anomaly_rejects``, saves the ensemble below ``model_root``, and returns one row per series.
    """
    history = check_history(history)
    done = history.select(*SERIES_KEYS).distinct()
    if train_anomaly:
        pipe = FeaturePipeline(features or FeatureConfig(keys=SERIES_KEYS))
        model, _scored, metrics, rejects = en.train_anomaly(history, pipe, labels, config)
        model.save(f"{model_root}/ensemble")
        pipe.origins.write.mode("overwrite").parquet(f"{model_root}/origins")
        store.spark.createDataFrame([(pipe.to_json(),)], "state string").coalesce(1).write.mode("overwrite").text(f"{model_root}/pipeline")
        store.upsert("anomaly_metrics", metrics, SERIES_KEYS)
        store.upsert("anomaly_rejects", rejects, SERIES_KEYS)
        done = join_same(done, metrics.select(*SERIES_KEYS, "flagged_pct", "n_features"), SERIES_KEYS)
    if train_forecast:
        _ahead, board, chosen, rejects = fc.forecast(history, SERIES_KEYS, horizon, folds, test_size, models)
        sizes = history.groupBy(*SERIES_KEYS).agg(F.count("*").alias("n"))
        store.upsert("scoreboard", board, [*SERIES_KEYS, "model"])
        store.upsert("selection", chosen, SERIES_KEYS)
        store.upsert("forecast_rejects", rejects, SERIES_KEYS)
        store.upsert("training_metrics", fc.training_metrics(chosen, sizes, SERIES_KEYS, horizon), SERIES_KEYS)
        done = join_same(done, chosen.select(*SERIES_KEYS, "winner"), SERIES_KEYS)
    return done


def run_drift_check(
    history: DataFrame, reference: Column, new: Column, min_severity: str = "major", **compare
) -> tuple[DataFrame, DataFrame]:
    """(all series with severity and trigger, those to retrain)."""
    checked = dr.drift_job(check_history(history), reference, new, SERIES_KEYS, min_severity, **compare)
    return checked, checked.where("trigger").select(*SERIES_KEYS)


def load_pipeline(store: TableStore, model_root: str) -> FeaturePipeline:
    state = store.spark.read.text(f"{model_root}/pipeline").first()["value"]
    return FeaturePipeline.from_json(state, store.spark.read.parquet(f"{model_root}/origins"))


def run_predict(
    store: TableStore,
    history: DataFrame,
    model_root: str | None = None,
    horizon: int = 30,
    folds: int = 4,
    test_size: int = 14,
    models: list[str] | None = None,
) -> DataFrame:
    """Forecast every series into the table ``forecasts`` (one partition per KPI) and, where an
    ensemble is stored, score the last 60 rows. Returns one row per series."""
    history = check_history(history)
    ahead, _board, chosen, rejects = fc.forecast(history, SERIES_KEYS, horizon, folds, test_size, models)
    rows = ahead.select(
        *SERIES_KEYS, "timestamp", "yhat", F.col("lower95").alias("yhat_lower"), F.col("upper95").alias("yhat_upper"),
        F.col("model").alias("winning_model"),
    )
    store.upsert("forecasts", rows, ["timestamp", *SERIES_KEYS], partition=["kpi_id"])
    store.upsert("forecast_rejects", rejects, SERIES_KEYS)
    out = chosen.select(*SERIES_KEYS, "winner").withColumn("horizon", F.lit(horizon))
    if model_root and path_exists(store.spark, f"{model_root}/ensemble/state"):
        model = en.AnomalyEnsemble.load(store.spark, f"{model_root}/ensemble")
        recent = en.score_recent(history, load_pipeline(store, model_root), model)
        out = join_same(out, recent, SERIES_KEYS)
    return out
