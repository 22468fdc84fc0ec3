"""Distribution drift between two windows: PSI and KS per feature, corroborated into a severity.

All features are unpivoted to (feature, side, value) and collapse into counts per value, so a
frequent value costs one row. The counts are ordered once by prefix sums; the KS distance, the
reference quantiles and the bins all read that one table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugeworks.functions.ordering import join_same, quantiles_of_placed, running_sums
from gaugeworks.session import stage

# Features that are functions of the timestamp alone and always differ between windows.
CALENDAR_COLUMNS = (
    "dow", "dom", "week", "month", "quarter", "year", "is_month_end", "is_month_start", "is_weekend",
)
EPS = 1e-6


def informative(columns: Sequence[str]) -> list[str]:
    return [c for c in columns if c not in CALENDAR_COLUMNS and not c.startswith(("fourier_sin_", "fourier_cos_"))]


def numeric_columns(reference: DataFrame, new: DataFrame, skip: Sequence[str] = ()) -> list[str]:
    return [
        f.name for f in reference.schema.fields
        if isinstance(f.dataType, T.NumericType) and f.name in new.columns and f.name not in skip
    ]


def value_counts(reference: DataFrame, new: DataFrame, keys: Sequence[str], features: Sequence[str]) -> DataFrame:
    """(keys..., feature, x, n_ref, n_new), one row per distinct value."""

    def side(df: DataFrame, ref: int) -> DataFrame:
        cols = [F.col(c).cast("double").alias(c) for c in features]
        return df.select(*keys, F.lit(ref).alias("__ref"), *cols)

    # features are numbered until their values are counted: a number is cheaper to group by than a name
    pairs = [c for i, name in enumerate(features) for c in (F.lit(i), F.col(f"`{name}`"))]
    both = side(reference, 1).unionByName(side(new, 0))
    both = both.select(*keys, "__ref", F.stack(F.lit(len(features)), *pairs).alias("__f", "x"))
    counts = (
        both.where(F.col("x").isNotNull() & ~F.isnan("x"))
        .groupBy(*keys, "__f", (F.col("x") + F.lit(0.0)).alias("x"))
        .agg(F.sum("__ref").cast("long").alias("n_ref"), F.sum(1 - F.col("__ref")).cast("long").alias("n_new"))
    )
    name = F.element_at(F.array(*[F.lit(f) for f in features]), F.col("__f") + 1).alias("feature")
    return counts.select(*keys, name, "x", "n_ref", "n_new")


def ks_p_value(d: Column, n: Column, m: Column) -> Column:
    """Asymptotic two-sided p of the Kolmogorov distance, 100 terms of the alternating series."""
    n, m = n.cast("double"), m.cast("double")
    lam = d * F.sqrt(n * m / (n + m))
    terms = F.aggregate(
        F.sequence(F.lit(1), F.lit(100)),
        F.lit(0.0),
        lambda acc, k: acc + F.when(k % 2 == 1, 1.0).otherwise(-1.0) * F.exp(-2.0 * k * k * lam * lam),
    )
    return F.when(lam < 0.2, F.lit(1.0)).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), 2.0 * terms)))


def feature_scores(
    reference: DataFrame, new: DataFrame, keys: Sequence[str], features: Sequence[str], bins: int = 10, buckets: int | None = None
) -> DataFrame:
    """(keys..., feature, psi, ks, p, ref STRUCT<mean,std,n>, new STRUCT<mean,std,n>)."""
    by = [*keys, "feature"]
    counts = stage(value_counts(reference, new, keys, features))
    placed = stage(running_sums(counts, by, "x", {"c_ref": "n_ref", "c_new": "n_new"}, buckets))

    x = F.col("x")
    probs = [i / bins for i in range(bins + 1)]
    totals = counts.groupBy(*by).agg(
        F.sum("n_ref").alias("t_ref"),
        F.sum("n_new").alias("t_new"),
        F.try_divide(F.sum(x * F.col("n_ref")), F.sum("n_ref")).alias("mean_ref"),
        F.try_divide(F.sum(x * F.col("n_new")), F.sum("n_new")).alias("mean_new"),
        F.min("x").alias("x_lo"),
        F.max("x").alias("x_hi"),
    )
    totals = join_same(totals, quantiles_of_placed(placed, by, "x", "n_ref", "c_ref", probs).drop("n"), by)
    totals = totals.withColumn("edges", F.array_distinct("q")).drop("q")
    lo, hi = F.col("x_lo"), F.col("x_hi")
    even = F.array(*[lo + F.lit(float(i)) * ((hi - lo) / F.lit(float(bins))) for i in range(bins)], hi)
    stats = totals.withColumn(
        "edges", F.when(F.size("edges") >= 3, F.col("edges")).when(hi - lo >= 1e-9, even)
    )
    stats = stage(stats)  # one row per series and feature

    wide = join_same(placed, stats, by)
    gap = F.abs(F.try_divide("c_ref", "t_ref") - F.try_divide("c_new", "t_new"))
    inside = (x >= F.element_at("edges", 1)) & (x <= F.element_at("edges", -1))
    at = F.least(F.size(F.filter("edges", lambda e: e <= x)), F.size("edges") - 1)
    per_bin = wide.groupBy(*by, F.when(inside, at).alias("bin")).agg(
        F.max(gap).alias("d"),
        F.sum("n_ref").alias("b_ref"),
        F.sum("n_new").alias("b_new"),
        F.sum(F.col("n_ref") * (x - F.col("mean_ref")) ** 2).alias("ss_ref"),
        F.sum(F.col("n_new") * (x - F.col("mean_new")) ** 2).alias("ss_new"),
    )
    # at most one row per bin and one for the values outside: an array per feature of fixed length
    packed = per_bin.groupBy(*by).agg(
        F.max("d").alias("d"),
        F.sum("ss_ref").alias("ss_ref"),
        F.sum("ss_new").alias("ss_new"),
        F.sum(F.when(F.col("bin").isNotNull(), F.col("b_ref"))).alias("in_ref"),
        F.sum(F.when(F.col("bin").isNotNull(), F.col("b_new"))).alias("in_new"),
        F.map_from_entries(
            F.collect_list(F.when(F.col("bin").isNotNull(), F.struct("bin", F.struct("b_ref", "b_new"))))
        ).alias("bins"),
    )
    rows = join_same(stats, packed, by)

    def share(count: Column, total: str) -> Column:
        c = F.coalesce(count, F.lit(0))
        return F.when(c == 0, F.lit(EPS)).otherwise(c / F.greatest(F.col(total), F.lit(1)))

    def term(acc: Column, b: Column) -> Column:
        r, n = share(F.col("bins")[b]["b_ref"], "in_ref"), share(F.col("bins")[b]["b_new"], "in_new")
        return acc + (n - r) * F.ln(n / r)

    divergence = F.aggregate(F.sequence(F.lit(1), F.size("edges") - 1), F.lit(0.0), term)
    empty = (F.col("t_ref") == 0) | (F.col("t_new") == 0)
    few = (F.col("t_ref") < 5) | (F.col("t_new") < 5)
    psi = F.when(empty, F.lit(float("inf"))).when(F.col("edges").isNull(), F.lit(0.0)).otherwise(divergence)

    def summary(s: str) -> Column:
        sd = F.sqrt(F.try_divide(F.col(f"ss_{s}"), F.col(f"t_{s}")))
        return F.struct(F.col(f"mean_{s}").alias("mean"), sd.alias("std"), F.col(f"t_{s}").alias("n")).alias(s)

    ks = F.when(few, F.lit(0.0)).otherwise(F.col("d"))
    return rows.select(
        *by, psi.alias("psi"), ks.alias("ks"),
        F.when(few, F.lit(1.0)).otherwise(ks_p_value(F.col("d"), F.col("t_ref"), F.col("t_new"))).alias("p"),
        summary("ref"), summary("new"),
    )


def psi_severity(psi: Column, minor: float = 0.1, major: float = 0.2) -> Column:
    return F.when(psi < minor, "none").when(psi < major, "minor").otherwise("major")


def ks_severity(p: Column, alpha: float = 0.01) -> Column:
    return F.when(p < alpha / 10, "major").when(p < alpha, "minor").otherwise("none")


def corroborate(psi: Column, ks: Column) -> Column:
    """Both tests must see drift: major if both are major, minor if both are at least minor."""
    return F.when((psi == "major") & (ks == "major"), "major").when((psi != "none") & (ks != "none"), "minor").otherwise("none")


def compare_windows(
    reference: DataFrame,
    new: DataFrame,
    keys: Sequence[str] = (),
    features: Sequence[str] | None = None,
    psi_minor: float = 0.1,
    psi_major: float = 0.2,
    alpha: float = 0.01,
    min_rows: int = 30,
    include_calendar: bool = False,
    drifted_only: bool = False,
) -> DataFrame:
    """Severity per feature; features with fewer than ``min_rows`` values on a side are skipped."""
    cols = list(features) if features else numeric_columns(reference, new, keys)
    if not include_calendar:
        cols = informative(cols)
    rows = feature_scores(reference, new, keys, cols)
    rows = rows.where((F.col("ref.n") >= min_rows) & (F.col("new.n") >= min_rows))
    rows = rows.withColumn("psi_severity", psi_severity(F.col("psi"), psi_minor, psi_major))
    rows = rows.withColumn("ks_severity", ks_severity(F.col("p"), alpha))
    rows = rows.withColumn("severity", corroborate(F.col("psi_severity"), F.col("ks_severity")))
    return rows.where(F.col("severity") != "none") if drifted_only else rows


def retrain_decision(
    compared: DataFrame, keys: Sequence[str], n_checked: int, major_needed: int = 1, minor_needed: int = 6,
    everyone: DataFrame | None = None,
) -> DataFrame:
    """Per series: worst severity, whether to retrain, and a summary. ``n_checked`` counts skipped features too.

    ``everyone`` names the series (one row of keys each) that must appear, also where nothing could be
    compared; these have no drift.
    """
    if everyone is not None:
        compared = join_same(everyone, compared.select(*keys, "feature", "severity"), keys).withColumn(
            "severity", F.coalesce("severity", F.lit("none"))
        )
    per = compared.groupBy(*keys).agg(
        F.count_if(F.col("severity") == "major").alias("n_major"),
        F.count_if(F.col("severity") == "minor").alias("n_minor"),
        F.sort_array(F.collect_list(F.when(F.col("severity") != "none", F.col("feature")))).alias("drifted_features"),
    )
    retrain = (F.col("n_major") >= major_needed) | (F.col("n_minor") >= minor_needed)
    overall = F.when(F.col("n_major") > 0, "major").when(F.col("n_minor") > 0, "minor").otherwise("none")
    return per.select(
        *keys,
        F.lit(n_checked).alias("n_features_checked"), "n_major", "n_minor", "drifted_features",
        overall.alias("overall_severity"), retrain.alias("should_retrain"),
        F.concat_ws(
            " · ", F.lit(f"Checked {n_checked} numeric features"),
            F.format_string("%d major drift, %d minor", "n_major", "n_minor"),
            F.when(retrain, "recommendation: RETRAIN").otherwise("recommendation: no action"),
        ).alias("summary"),
    )


def severity_rank(severity: Column) -> Column:
    return F.when(severity == "major", 2).when(severity == "minor", 1).otherwise(0)


def drift_job(
    table: DataFrame, reference: Column, new: Column, keys: Sequence[str], min_severity: str = "major", **compare
) -> DataFrame:
    """All series at once: two filters on one table, severity and retrain trigger per series."""
    cols = informative(compare.pop("features", None) or numeric_columns(table, table, keys))
    found = compare_windows(table.where(reference), table.where(new), keys, cols, **compare)
    everyone = table.where(reference | new).select(*keys).distinct() if keys else None
    out = retrain_decision(found, keys, len(cols), everyone=everyone)
    need = {"none": 0, "minor": 1, "major": 2}[min_severity]
    return out.withColumn("trigger", severity_rank(F.col("overall_severity")) >= need).withColumn(
        "n_drifted", F.col("n_major") + F.col("n_minor")
    )
