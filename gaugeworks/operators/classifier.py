"""A boosted yes/no classifier for every labelled series.

A series' labelled rows lie in blocks of at most ``BLOCK``, each fitted in one task by histogram trees
on slopes and curvatures of the log-loss. A series longer than a block is a committee of its blocks,
whose probabilities are averaged by their rows. Rare labels weigh as much as the others together.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugeworks.functions.ordering import join_same
from gaugeworks.operators.histogram_trees import fit_forest, forest_values
from gaugeworks.operators.isolation import score_by_parts
from gaugeworks.session import prepare

BLOCK = 200_000


def fit_classifiers(
    rows: DataFrame, keys: Sequence[str], row_id: Sequence[str], label: str = "label", min_labels: int = 50, rounds: int = 300,
    depth: int = 6, rate: float = 0.05, seed: int = 42, block: int = BLOCK,
) -> DataFrame:
    """(keys..., block, n, feature, above, leaf): the trees of every series with at least ``min_labels``
    positive labels and a negative one; ``rows`` has the keys, the row id, ``x`` ARRAY<DOUBLE> and the label (0, 1
    or null)."""
    prepare(rows.sparkSession)
    ids = [c for c in row_id if c not in keys]
    known = rows.where(F.col(label).isNotNull()).select(*keys, *ids, "x", F.col(label).cast("double").alias("__y"))
    sizes = known.groupBy(*keys).agg(F.count("*").alias("__n"), F.sum("__y").alias("__pos"))
    sizes = sizes.where((F.col("__pos") >= min_labels) & (F.col("__pos") < F.col("__n")))
    dealt = join_same(known, sizes, keys, "inner").select(
        *keys, F.pmod(F.xxhash64(*row_id), F.ceil(F.col("__n") / F.lit(block))).cast("int").alias("block"), F.xxhash64(*row_id).alias("place"),
        "x", F.col("__y").alias("y"), F.greatest(F.lit(1.0), (F.col("__n") - F.col("__pos")) / F.col("__pos")).alias("weight"),
    )
    reals = T.ArrayType(T.DoubleType())
    schema = T.StructType(
        [rows.schema[k] for k in keys]
        + [T.StructField("block", T.IntegerType()), T.StructField("n", T.LongType()), T.StructField("feature", T.ArrayType(T.IntegerType()))]
        + [T.StructField("above", reals), T.StructField("leaf", reals)]
    )

    def fit(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("place", kind="stable")
        y, weight = pdf["y"].to_numpy(dtype=float), pdf["weight"].to_numpy(dtype=float)
        forest, _ = fit_forest(
            [np.stack(list(pdf["x"]))], [y], [pdf["place"].to_numpy()], "logistic", rounds, depth, rate, rows=1.0, columns=1.0, seed=seed,
            weights=[np.where(y == 1, weight, 1.0)],
        )
        row = {"n": len(pdf), "feature": forest.feature[:, 0].ravel(), "above": forest.above[:, 0].ravel(), "leaf": forest.leaf[:, 0].ravel()}
        return pd.DataFrame([{**dict(zip([*keys, "block"], key)), **row}])[schema.names]

    return dealt.groupBy(*keys, "block").applyInPandas(fit, schema)


def score_classifiers(rows: DataFrame, models: DataFrame, keys: Sequence[str], row_id: Sequence[str], rounds: int, out: str = "xgboost") -> DataFrame:
    """Adds the probability of label 1, null for series without a classifier."""

    def value(x: np.ndarray, blocks: pd.DataFrame) -> np.ndarray:
        total = np.zeros(len(x))
        for m in blocks.sort_values("block").itertuples(index=False):
            trees = (np.asarray(v).reshape(rounds, -1) for v in (m.feature, m.above, m.leaf))
            total += m.n / (1.0 + np.exp(-forest_values(*trees, x)))
        return total / blocks["n"].sum()

    return score_by_parts(rows, models, keys, row_id, out, value)
