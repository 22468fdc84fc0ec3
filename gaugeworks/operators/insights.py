"""Change drivers, digests, what-if projections and explanations of single numbers."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gaugeworks.functions import sentences as say
from gaugeworks.functions.ordering import join_same, ordered_index
from gaugeworks.functions.text import humanize, signed


def _top(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, rank: str = "rank") -> DataFrame:
    """The first ``n`` rows per key. Spark cuts each task to ``n`` rows per key before the shuffle."""
    if not keys:
        best = df.orderBy(*order).limit(n)
        return best.withColumn(rank, F.row_number().over(Window.orderBy(*order)))
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= n)


def decompose_drivers(
    current: DataFrame, prior: DataFrame, dimension: str, value: str, keys: Sequence[str] = (), n: int = 3
) -> DataFrame:
    """The ``n`` members of a dimension that moved most between two periods.

    Both periods are reduced in one aggregate, so the key union is a shuffle of group rows only.
    """
    amount = F.col(value).cast("decimal(18,2)")
    zero = F.lit(0).cast("decimal(18,2)")
    both = current.select(*keys, dimension, amount.alias("c"), zero.alias("p")).unionByName(
        prior.select(*keys, dimension, zero.alias("c"), amount.alias("p"))
    )
    return _rank_moves(both, dimension, keys, n)


def drivers_between(
    rows: DataFrame, current: Column, prior: Column, dimension: str, value: str, keys: Sequence[str] = (), n: int = 3
) -> DataFrame:
    """:func:`decompose_drivers` for two periods of one table, read in one scan."""
    amount, zero = F.col(value).cast("decimal(18,2)"), F.lit(0).cast("decimal(18,2)")
    both = rows.where(current | prior).select(
        *keys, dimension, F.when(current, amount).otherwise(zero).alias("c"), F.when(prior, amount).otherwise(zero).alias("p")
    )
    return _rank_moves(both, dimension, keys, n)


def _rank_moves(both: DataFrame, dimension: str, keys: Sequence[str], n: int) -> DataFrame:
    moved = both.groupBy(*keys, dimension).agg(F.sum("c").alias("c"), F.sum("p").alias("p"))
    delta = F.col("c") - F.col("p")
    cur, pri, dif = F.col("c").cast("double"), F.col("p").cast("double"), delta.cast("double")
    pct = F.when(pri != 0, dif / F.abs(pri) * 100.0).when(dif != 0, F.lit(float("inf"))).otherwise(F.lit(0.0))
    rows = moved.select(
        *keys, dimension, cur.alias("current"), pri.alias("prior"), dif.alias("delta_abs"), pct.alias("delta_pct")
    )
    return _top(rows, keys, [F.desc(F.abs("delta_abs")), F.asc(dimension)], n)


# digest ------------------------------------------------------------------------------------


def drivers_suffix(drivers: str = "drivers") -> Column:
    """' — driven by a (+1.2K), b (-3.00)' for the first two drivers, '' without drivers."""
    parts = F.transform(
        F.slice(F.col(drivers), 1, 2),
        lambda d: F.concat(
            d["dimension"].cast("string"), F.lit(" ("), F.when(d["delta_abs"] >= 0, "+").otherwise(""),
            humanize(d["delta_abs"]), F.lit(")"),
        ),
    )
    return F.when(F.size(F.col(drivers)) > 0, F.concat(F.lit(" — driven by "), F.concat_ws(", ", parts))).otherwise("")


def attach_drivers(anomalies: DataFrame, drivers: DataFrame, keys: Sequence[str], dimension: str) -> DataFrame:
    """Adds ``drivers`` (ranked array of dimension and delta) from :func:`decompose_drivers` rows."""
    packed = drivers.groupBy(*keys).agg(
        F.transform(
            F.sort_array(F.collect_list(F.struct("rank", F.col(dimension).cast("string").alias("dimension"), "delta_abs"))),
            lambda d: F.struct(d["dimension"].alias("dimension"), d["delta_abs"].alias("delta_abs")),
        ).alias("drivers")
    )
    return join_same(anomalies, packed, keys)


def compose_digest(
    anomalies: DataFrame,
    audiences: DataFrame,
    keys: Sequence[str],
    period_end: str,
    period_days: int = 30,
    headlines: Sequence[str] = (),
) -> DataFrame:
    """One digest per row of ``audiences`` (columns ``keys`` and ``audience``).

    Sections: headlines, alerts (severity at least 0.5, five most severe), heads-up (the five most
    severe others), or all quiet.
    """
    alert = F.col("severity") >= 0.5
    marked = anomalies.withColumn("__alert", alert)
    counts = marked.groupBy(*keys).agg(F.count_if("__alert").alias("n_alerts"), F.count("*").alias("n_anomalies"))
    by = [*keys, "__alert"]
    tie = [c for c in ("kpi_id", "timestamp") if c in anomalies.columns]
    best = _top(marked, by, [F.desc("severity"), *[F.asc(c) for c in tie]], 5)
    suffix = F.when(F.col("__alert"), drivers_suffix()).otherwise("") if "drivers" in anomalies.columns else F.lit("")
    bullets = best.groupBy(*keys).agg(
        *[
            F.transform(
                F.sort_array(F.collect_list(F.when(F.col("__alert") == flag, F.struct("rank", F.concat("narrative", suffix).alias("t"))))),
                lambda s: s["t"],
            ).alias(name)
            for name, flag in (("__alerts", True), ("__quiet", False))
        ]
    )
    rows = join_same(join_same(audiences, counts, keys), bullets, keys)
    n = F.coalesce("n_alerts", F.lit(0))
    all_n = F.coalesce("n_anomalies", F.lit(0))

    def section(title: Column, lines: Column) -> Column:
        return F.struct(title.alias("title"), lines.alias("bullets"))

    big = section(F.lit(say.BIG_PICTURE), F.array(*[F.lit(h) for h in headlines]).cast("array<string>"))
    title = F.concat(
        F.lit("⚠️ "), n.cast("string"), F.when(n == 1, say.ONE_THING).otherwise(say.MANY_THINGS)
    )
    quiet = F.array(F.lit(say.NOTHING_FOUND))
    wanted = [
        F.when(F.lit(bool(headlines)), big),
        F.when(n > 0, section(title, F.col("__alerts"))),
        F.when(all_n > n, section(F.lit(say.HEADS_UP), F.col("__quiet"))),
        F.when(all_n == 0, section(F.lit(say.ALL_QUIET), quiet)),
    ]
    end = F.lit(period_end).cast("date")
    return rows.select(
        *keys, "audience",
        F.lit(f"Your {period_days}-day digest").alias("headline"),
        F.date_sub(end, period_days).alias("period_start"),
        end.alias("period_end"),
        n.cast("long").alias("n_alerts"),
        all_n.cast("long").alias("n_anomalies"),
        F.filter(F.array(*wanted), lambda s: s.isNotNull()).alias("sections"),
    )


def digest_markdown(digests: DataFrame) -> DataFrame:
    body = F.flatten(
        F.transform(
            "sections",
            lambda s: F.concat(
                F.array(F.concat(F.lit("## "), s["title"])),
                F.transform(s["bullets"], lambda b: F.concat(F.lit("- "), b)),
                F.array(F.lit("")),
            ),
        )
    )
    head = F.array(
        F.concat(F.lit("# "), "headline"),
        F.concat(
            F.lit("_"), F.col("period_start").cast("string"), F.lit(" → "), F.col("period_end").cast("string"),
            F.lit("_  ·  for **"), "audience", F.lit("**"),
        ),
        F.lit(""),
    )
    return digests.withColumn("markdown", F.concat_ws("\n", F.concat(head, body)))


# what-if -----------------------------------------------------------------------------------


def shock_of(changes: dict[str, float]) -> float:
    """Product of (1 + v/100) over ``*_pct`` entries and v over ``*_factor`` entries."""
    parts = [1 + v / 100.0 if k.endswith("_pct") else v for k, v in changes.items() if k.endswith(("_pct", "_factor"))]
    return reduce(lambda a, b: a * b, parts, 1.0)


def fit_trend(series: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Least-squares line on the row number per series, its residual deviation and the last value."""
    rows = ordered_index(series, keys, ["timestamp"])
    x = (F.col("rn") - 1).cast("double")
    fit = rows.groupBy(*keys).agg(
        F.count("value").alias("n"),
        F.avg("value").alias("mean_y"),
        F.regr_slope("value", x).alias("slope"),
        F.regr_intercept("value", x).alias("intercept"),
        F.max_by("value", "rn").alias("last_value"),
    )
    fit = fit.withColumn("slope", F.coalesce("slope", F.lit(0.0))).withColumn("intercept", F.coalesce("intercept", "mean_y"))
    left = join_same(rows, fit, keys).select(
        *keys, (F.col("value") - (F.col("slope") * x + F.col("intercept"))).alias("r")
    )
    spread = left.groupBy(*keys).agg(F.stddev_pop("r").alias("residual_std"))
    out = join_same(fit, spread, keys)
    return out.withColumn(
        "residual_std",
        F.when(F.col("residual_std") == 0, F.abs("mean_y") * 0.05).otherwise(F.col("residual_std")),
    )


def simulate(
    series: DataFrame,
    keys: Sequence[str],
    scenarios: dict[str, dict[str, float]],
    horizon: int = 12,
    label: str = "FY26",
    sensitivity: float = 1.0,
) -> DataFrame:
    """Project every series by its trend and apply every scenario. Series of fewer than 4 rows give none."""
    fit = fit_trend(series, keys).where(F.col("n") >= 4)
    table = F.array(*[F.struct(F.lit(name).alias("scenario"), F.lit(shock_of(ch)).alias("shock")) for name, ch in scenarios.items()])
    rows = fit.select("*", F.inline(table))
    base = F.col("slope") * (F.col("n") - 1 + horizon) + F.col("intercept")
    rows = rows.withColumn("trend_value", base)
    rows = rows.withColumn("projected", F.col("trend_value") * (1 + (F.col("shock") - 1) * F.lit(sensitivity)))
    rows = rows.withColumn("delta_abs", F.col("projected") - F.col("last_value"))
    rows = rows.withColumn(
        "delta_pct", F.when(F.col("last_value") != 0, F.col("delta_abs") / F.col("last_value") * 100.0).otherwise(0.0)
    )
    rows = rows.withColumn("low", F.col("projected") - 1.96 * F.col("residual_std"))
    rows = rows.withColumn("high", F.col("projected") + 1.96 * F.col("residual_std"))
    text = F.concat(
        F.lit("Baseline trend projects "), humanize(F.col("trend_value")), F.lit(f" by {label}. Applying scenario '"),
        "scenario", F.lit("' (shock "), signed((F.col("shock") - 1) * 100), F.lit("%) gives "),
        humanize(F.col("projected")), F.lit(" — a "), signed(F.col("delta_pct")), F.lit("% change vs today. 95% interval: "),
        humanize(F.col("low")), F.lit(" to "), humanize(F.col("high")), F.lit("."),
    )
    return rows.select(
        *keys, "scenario", F.col("last_value").alias("baseline"), "trend_value", "projected", "delta_abs", "delta_pct",
        "low", "high", text.alias("explanation"),
    )


# single numbers ----------------------------------------------------------------------------


def explain_number(df: DataFrame) -> DataFrame:
    """Adds ``explanation`` from value, kpi_name, formula, filters, source_tables, rows_used, period."""
    pairs = F.transform(F.map_entries("filters"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    bits = F.array_compact(
        F.array(
            F.when(F.size("filters") > 0, F.concat(F.lit("filtered to "), F.concat_ws(", ", pairs))),
            F.when(F.col("period") != "", F.col("period")),
        )
    )
    scope = F.when(F.size(bits) > 0, F.concat(F.lit(" ("), F.concat_ws(", ", bits), F.lit(")"))).otherwise("")
    srcs = F.when(F.size("source_tables") > 0, F.concat_ws(", ", "source_tables")).otherwise("the source tables")
    return df.withColumn(
        "explanation",
        F.concat(
            F.lit("This "), humanize(F.col("value")), F.lit(" is the "), F.lower("kpi_name"), F.lit(" computed as `"),
            "formula", F.lit("` from "), srcs, scope, F.lit(", based on "),
            F.format_string("%,d", F.col("rows_used").cast("long")), F.lit(" rows."),
        ),
    )


def period_delta(series: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Latest value, the one before it, and the change in percent (0 when the earlier one is 0)."""
    last = _top(series, keys, [F.desc("timestamp")], 2)
    both = last.groupBy(*keys).agg(
        F.max(F.when(F.col("rank") == 1, F.col("value"))).alias("current"),
        F.coalesce(
            F.max(F.when(F.col("rank") == 2, F.col("value"))), F.max(F.when(F.col("rank") == 1, F.col("value")))
        ).alias("previous"),
    )
    change = (F.col("current") - F.col("previous")) / F.col("previous") * 100.0
    return both.withColumn("delta_pct", F.when(F.col("previous") != 0, F.round(change, 2)).otherwise(0.0))
