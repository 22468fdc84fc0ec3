"""The anomaly ensemble over all series at once: fit, score, save, load."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gaugeworks.functions.ordering import join_same
from gaugeworks.operators import anomaly as an
from gaugeworks.operators import classifier as cl
from gaugeworks.operators import isolation as iso
from gaugeworks.operators.features import FeaturePipeline, drop_incomplete
from gaugeworks.session import stage
from gaugeworks.sources.store import path_exists


@dataclass
class EnsembleConfig:
    trees: int = 200
    sample: int = 256
    seed: int = 42
    min_labels: int = 50
    boost_rounds: int = 300
    boost_depth: int = 6
    boost_step: float = 0.05
    threshold: float = 0.55
    agreeing: int = 2


@dataclass
class AnomalyEnsemble:
    """Fitted tables, one row per series (and feature, tree or block of labelled rows)."""

    keys: Sequence[str]
    columns: Sequence[str]
    config: EnsembleConfig
    medians: DataFrame
    scaler: DataFrame
    forest: DataFrame
    values: DataFrame
    classifier: DataFrame | None = None

    def _matrix(self, features: DataFrame, medians: DataFrame) -> DataFrame:
        """(keys..., timestamp, value, label?, x): imputed and standardized features as one array."""
        keep = [c for c in (*self.keys, "timestamp", "value", "label") if c in features.columns]
        have = features.select(
            *keep, *[F.col(c) if c in features.columns else F.lit(None).cast("double").alias(c) for c in self.columns]
        )
        filled = an.impute_array(an.pack_features(have, self.columns), medians, self.keys, self.columns)
        return an.standardize_array(filled, self.scaler, self.keys, self.columns)

    def score(self, features: DataFrame, impute: str = "fitted") -> DataFrame:
        """One detection per row. ``impute='batch'`` takes the medians of the scored rows instead."""
        medians = self.medians if impute == "fitted" else an.fit_medians(features, self.keys, self.columns)
        ident = [*self.keys, "timestamp"]
        rows = iso.score_forest(self._matrix(features, medians), self.forest, self.keys, ident)
        rows = an.min_max_scale(stage(rows), self.keys, "raw", "isolation_forest").drop("raw")
        rows = an.statistical_score(rows, self.values, self.keys)
        detectors = ["isolation_forest", "statistical"]
        if self.classifier is not None:
            rows = cl.score_classifiers(rows, self.classifier, self.keys, ident, self.config.boost_rounds)
            detectors.append("xgboost")
        return an.fuse_scores(rows.drop("x"), detectors, self.config.threshold, self.config.agreeing)

    def save(self, root: str) -> None:
        for name in ("medians", "scaler", "forest", "values"):
            getattr(self, name).write.mode("overwrite").parquet(f"{root}/{name}")
        if self.classifier is not None:
            self.classifier.write.mode("overwrite").parquet(f"{root}/classifier")
        spark = self.medians.sparkSession
        state = json.dumps({"keys": list(self.keys), "columns": list(self.columns), "config": vars(self.config)})
        spark.createDataFrame([(state,)], "state string").coalesce(1).write.mode("overwrite").text(f"{root}/state")

    @classmethod
    def load(cls, spark: SparkSession, root: str) -> AnomalyEnsemble:
        state = json.loads(spark.read.text(f"{root}/state").first()["value"])
        tables = {n: spark.read.parquet(f"{root}/{n}") for n in ("medians", "scaler", "forest", "values")}
        boosted = spark.read.parquet(f"{root}/classifier") if path_exists(spark, f"{root}/classifier") else None
        return cls(state["keys"], state["columns"], EnsembleConfig(**state["config"]), **tables, classifier=boosted)


def fit_ensemble(
    features: DataFrame, keys: Sequence[str], columns: Sequence[str], config: EnsembleConfig | None = None
) -> AnomalyEnsemble:
    """Fit all detectors on (keys..., timestamp, value, features..., label?).

    ``features`` is read several times; pass a stored or staged table.
    """
    config = config or EnsembleConfig()
    medians = stage(an.fit_medians(features, keys, columns))
    filled = an.impute_array(an.pack_features(features, columns), medians, keys, columns)
    scaler = stage(an.fit_scaler(filled, keys, columns))
    values = stage(an.fit_statistical(features, keys))
    model = AnomalyEnsemble(keys, columns, config, medians, scaler, features, values)
    matrix = stage(model._matrix(features, medians))
    model.forest = stage(iso.fit_forest(matrix, keys, [*keys, "timestamp"], config.trees, config.sample, config.seed))
    if "label" in matrix.columns:
        model.classifier = stage(cl.fit_classifiers(
            matrix, keys, [*keys, "timestamp"], min_labels=config.min_labels, rounds=config.boost_rounds, depth=config.boost_depth,
            rate=config.boost_step, seed=config.seed,
        ))
    return model


def train_anomaly(
    series: DataFrame, pipeline: FeaturePipeline, labels: DataFrame | None = None, config: EnsembleConfig | None = None,
    min_rows: int = 50,
) -> tuple[AnomalyEnsemble, DataFrame, DataFrame, DataFrame]:
    """Features, ensemble, scores of the training rows, metrics, and the series that are too short.

    ``labels``: (keys..., timestamp, label). Series with fewer than ``min_rows`` complete rows are
    left out of the fit and listed with the reason.
    """
    keys = list(pipeline.config.keys)
    rows = pipeline.fit_transform(series)
    if labels is not None:
        rows = join_same(rows, labels.select(*keys, "timestamp", "label"), [*keys, "timestamp"])
    full = stage(drop_incomplete(rows, pipeline.columns))
    sizes = series.select(*keys).distinct() if keys else None
    counts = full.groupBy(*keys).agg(F.count("*").alias("n"))
    if sizes is not None:
        counts = join_same(sizes, counts, keys).withColumn("n", F.coalesce("n", F.lit(0)))
    short = counts.where(F.col("n") < min_rows)
    rejects = short.select(
        *keys, F.col("n").alias("n_train_rows"), F.concat(F.lit(f"needs {min_rows} rows after features, has "), F.col("n").cast("string")).alias("reason")
    )
    usable = full
    if keys and not short.isEmpty():
        usable = stage(join_same(full, counts.where(F.col("n") >= min_rows).drop("n"), keys, "inner"))
    model = fit_ensemble(usable, keys, pipeline.columns, config)
    scored = stage(model.score(usable))
    metrics, _short = an.anomaly_metrics(scored, keys, len(pipeline.columns), min_rows)
    return model, scored, metrics, rejects


def score_recent(series: DataFrame, pipeline: FeaturePipeline, model: AnomalyEnsemble, last: int = 60) -> DataFrame:
    """Anomalies among the last rows of every series: n_anomalies, n_checked, max_severity.

    Features need history, so the pipeline's look-back is read in front of the scored rows.
    """
    keys = list(pipeline.config.keys)
    w = Window.partitionBy(*keys).orderBy(F.desc("timestamp"))
    back = F.row_number().over(w)  # Spark cuts each task to the rank limit before the shuffle
    tail = series.withColumn("__back", back).where(F.col("__back") <= last + pipeline.config.lookback())
    recent = stage(tail)
    feats = pipeline.transform(recent.drop("__back"))
    checked = join_same(feats, recent.where(F.col("__back") <= last).select(*keys, "timestamp"), [*keys, "timestamp"], "inner")
    scored = model.score(stage(checked))
    return scored.groupBy(*keys).agg(
        F.count_if("is_anomaly").alias("n_anomalies"), F.count("*").alias("n_checked"), F.max("severity").alias("max_severity")
    )
