"""The KPI library: every catalog KPI as an archetype over the columns of a bound table.

KPIs that are one aggregate expression share a single pass: all KPIs of a table are computed in one
``groupBy`` and unpivoted to ``(keys..., kpi_id, period, value)``. The other archetypes (growth,
average of sums, gaps, trailing distinct counts, funnels, retention, percentiles, derived ratios)
have a function each and give rows of the same shape.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gaugeworks.functions.kpi_catalog import AUDIENCES, CATALOG
from gaugeworks.functions.ordering import exact_quantiles, join_same


class Formula(NamedTuple):
    """How one KPI is computed: the domain table it reads and an aggregate over its columns."""

    table: str
    archetype: str
    expr: str


def _share(part: str, whole: str = "count(*)") -> str:
    return f"try_divide(double({part}), double({whole}))"


def _days(a: str, b: str) -> str:
    return f"avg(datediff({a}, {b}))"


def _span(a: str, b: str, seconds: int) -> str:
    """Mean of a - b in units of ``seconds``, from exact integer microseconds. A sum of long numbers would
    overflow at some hundred thousand rows of months each."""
    micros = f"cast(unix_micros({a}) - unix_micros({b}) as decimal(20, 0))"
    return f"try_divide(double(sum({micros})), double(count(*))) / {seconds}000000.0"


FORMULAS = {
    # finance
    "fin_revenue_total": Formula("ledger", "SUM", "double(sum(revenue))"),
    "fin_revenue_growth_yoy": Formula("ledger", "GROWTH", "fin_revenue_total"),
    "fin_gross_margin": Formula("ledger", "RATIO", _share("sum(revenue) - sum(cogs)", "sum(revenue)")),
    "fin_operating_margin": Formula("ledger", "RATIO", _share("sum(operating_income)", "sum(revenue)")),
    "fin_ebitda": Formula("ledger", "SUM", "double(sum(operating_income) + sum(depreciation) + sum(amortization))"),
    "fin_burn_rate": Formula("ledger", "AVG-OF-SUM", "cash_outflow"),
    "fin_runway_months": Formula("ledger", "DERIVED", "cash_balance / fin_burn_rate"),
    "fin_cac": Formula("ledger", "RATIO", _share("sum(sales_marketing_spend)", "count(distinct new_customer_id)")),
    "fin_ltv": Formula("ledger", "AVG", "customer revenue * lifespan months"),
    "fin_ltv_cac": Formula("ledger", "DERIVED", "fin_ltv / fin_cac"),
    "fin_dso": Formula("ledger", "AVG", "avg(receivables_days)"),
    "fin_budget_variance": Formula("ledger", "RATIO", _share("sum(actual) - sum(plan)", "sum(plan)")),
    # sales
    "sls_pipeline_value": Formula("opportunity", "SUM-IF", "double(sum(amount) filter (where stage not in ('won', 'lost')))"),
    "sls_win_rate": Formula("opportunity", "RATIO", _share("count_if(stage = 'won')", "count_if(stage in ('won', 'lost'))")),
    "sls_avg_deal_size": Formula("opportunity", "AVG", _share("sum(amount) filter (where stage = 'won')", "count_if(stage = 'won')")),
    "sls_sales_cycle_days": Formula("opportunity", "AVG-DELTA", _days("close_date", "created_date")),
    "sls_quota_attainment": Formula("opportunity", "RATIO", _share("sum(actual_revenue)", "sum(quota)")),
    "sls_funnel_conversion": Formula("event", "FUNNEL", "stage"),
    "sls_lead_response_time": Formula("opportunity", "AVG-DELTA", _days("first_contact", "created_date")),
    "sls_arr": Formula("opportunity", "SUM-IF", "double(sum(annual_value) filter (where active))"),
    "sls_arr_growth": Formula("opportunity", "GROWTH", "sls_arr"),
    "sls_net_revenue_retention": Formula(
        "opportunity", "RATIO", _share("sum(starting_arr) + sum(expansion) - sum(churn) - sum(contraction)", "sum(starting_arr)")
    ),
    # operations
    "ops_uptime": Formula("request", "RATIO", "1 - " + _share("sum(downtime_seconds)", "sum(total_seconds)")),
    "ops_mttr": Formula("request", "AVG-DELTA", _span("resolved_at", "ts", 60)),
    "ops_mtbf": Formula("request", "GAP", "ts"),
    "ops_throughput": Formula("request", "RATE", _share("count(*)", "count(distinct date_trunc('HOUR', ts))")),
    "ops_error_rate": Formula("request", "RATIO", _share("count_if(failed)")),
    "ops_p95_latency": Formula("request", "PERCENTILE", "latency_ms"),
    "ops_inventory_turnover": Formula("request", "RATIO", "try_divide(double(sum(cogs)), " + _share("sum(inventory_value)") + ")"),
    "ops_capacity_utilization": Formula("request", "RATIO", _share("sum(actual_output)", "sum(max_capacity)")),
    # people
    "hr_headcount": Formula("employee", "COUNT", "double(count_if(active))"),
    "hr_attrition_rate": Formula("employee", "RATIO", "12 * " + _share("count_if(departed) * count(*)", "sum(headcount)")),
    "hr_voluntary_attrition": Formula("employee", "RATIO", _share("count_if(departed and voluntary) * count(*)", "sum(headcount)")),
    "hr_time_to_hire": Formula("employee", "AVG-DELTA", _days("start_date", "open_date")),
    "hr_offer_acceptance": Formula("employee", "RATIO", _share("count_if(accepted)")),
    "hr_engagement_score": Formula("employee", "AVG", "avg(engagement)"),
    "hr_training_hours": Formula("employee", "RATIO", _share("sum(training_hours)", "count(distinct employee_id)")),
    "hr_diversity_pct": Formula("employee", "RATIO", _share("count_if(underrepresented)")),
    "hr_contractor_ratio": Formula("employee", "RATIO", _share("count_if(contractor)")),
    "hr_cost_per_hire": Formula("employee", "RATIO", _share("sum(recruiting_spend)", "count_if(accepted)")),
    # customer
    "cust_nps": Formula("ticket", "NPS", "100 * " + _share("count_if(score >= 9) - count_if(score <= 6)")),
    "cust_csat": Formula("ticket", "AVG", "avg(satisfaction)"),
    "cust_churn_rate": Formula("ticket", "RETENTION", "customer_id"),
    "cust_revenue_churn": Formula("ticket", "RETENTION", "customer_id, arr"),
    "cust_first_response_time": Formula("ticket", "AVG-DELTA", _span("first_response", "ts", 60)),
    "cust_resolution_time": Formula("ticket", "AVG-DELTA", _span("resolved_at", "ts", 3600)),
    "cust_active_users": Formula("event", "DISTINCT-WINDOW", "user_id"),
    "cust_dau_mau": Formula("event", "DERIVED", "DAU / MAU"),
    # risk
    "risk_fraud_rate": Formula("transaction", "RATIO", _share("sum(amount) filter (where fraud)", "sum(amount)")),
    "risk_false_positive_rate": Formula("transaction", "RATIO", _share("count_if(alert and false_positive)", "count_if(alert)")),
    "risk_aml_alerts": Formula("transaction", "COUNT", "double(count_if(aml and status = 'open'))"),
    "risk_audit_findings": Formula("transaction", "COUNT", "double(count_if(status = 'open'))"),
    "risk_security_incidents": Formula(
        "transaction", "COUNT",
        "double(count_if(element_at(map('low', 1, 'medium', 2, 'high', 3, 'critical', 4), severity) >= 3))",
    ),
    # product
    "prod_feature_adoption": Formula(
        "deploy", "RATIO", _share("count(distinct user_id) filter (where uses_feature)", "count(distinct user_id)")
    ),
    "prod_release_frequency": Formula("deploy", "RATE", _share("count(*)", "count(distinct date_trunc('MONTH', ts))")),
    "prod_lead_time_changes": Formula("deploy", "AVG-DELTA", _span("deploy_time", "ts", 3600)),
    "prod_change_failure_rate": Formula("deploy", "RATIO", _share("count_if(failed)")),
    "prod_bug_count": Formula("deploy", "COUNT", "double(count_if(priority in ('P0', 'P1') and status = 'open'))"),
}

ONE_PASS = {"SUM", "SUM-IF", "COUNT", "AVG", "AVG-DELTA", "RATE", "RATIO", "NPS"}


def one_pass_kpis(table: str) -> dict[str, str]:
    """KPIs of a table that are a single aggregate expression."""
    return {k: f.expr for k, f in FORMULAS.items() if f.table == table and f.archetype in ONE_PASS and k != "fin_ltv"}


def compute_kpis(
    df: DataFrame, exprs: dict[str, str], keys: Sequence[str] = (), period: Column | None = None, there: dict[str, list[str]] | None = None
) -> DataFrame:
    """All expressions in one aggregate: (keys..., kpi_id, period, value). ``there`` gives KPIs by the
    column that must have a value in a group for the group to have them."""
    at, there = (period if period is not None else F.lit("all")).alias("period"), there or {}
    wide = df.groupBy(*keys, at).agg(*[F.expr(e).cast("double").alias(k) for k, e in exprs.items()], *[F.count(c).alias(c) for c in there])
    rows = wide.unpivot([*keys, "period", *there], list(exprs), "kpi_id", "value")
    for column, kpi_ids in there.items():
        rows = rows.where((F.col(column) > 0) | ~F.col("kpi_id").isin(kpi_ids))
    return rows.select(*keys, "kpi_id", "period", "value")


def compute_boards(
    base: DataFrame, tables: dict[str, tuple[list, dict[str, str]]], period: Column, only: dict[str, Column] | None = None
) -> DataFrame:
    """KPIs of several domain tables over one base in a single aggregate: (kpi_id, period, value).

    ``tables`` gives, by name, the table's columns over the base and the expressions wanted of it. Columns
    are named after their table, in the expressions too; those no expression uses are pruned at the scan.
    ``only`` gives, by name, the condition of a table's rows where these are not all of the base.
    """
    columns, exprs, there = [], {}, {}
    for table, (wanted, formulas) in tables.items():
        names = base.select(*wanted).columns
        own, rows = [F.col(c) if isinstance(c, str) else c for c in wanted], "*"
        if table in (only or {}):
            rows = f"{table}__rows"
            own, there[rows] = [F.when(only[table], c) for c in own], list(formulas)
            columns.append(F.when(only[table], True).alias(rows))
        columns += [c.alias(f"{table}__{n}") for c, n in zip(own, names)]
        # names of columns are neither quoted nor called
        name = re.compile(rf"('[^']*')|\b({'|'.join(names)})\b(?!\s*\()")
        for kpi_id, expr in formulas.items():
            exprs[kpi_id] = name.sub(lambda m, t=table: m[1] or f"{t}__{m[2]}", expr).replace("count(*)", f"count({rows})")
    return compute_kpis(base.select(period.alias("__period"), *columns), exprs, period=F.col("__period"), there=there)


def with_target() -> set[str]:
    return {k.id for k in CATALOG if k.target is not None}


def on_boards() -> set[str]:
    return {k for _, kpis in AUDIENCES.values() for k in kpis}


def compute_kpi(df: DataFrame, kpi_id: str, keys: Sequence[str] = (), period: Column | None = None) -> DataFrame:
    formula = FORMULAS[kpi_id]
    if formula.archetype not in ONE_PASS:
        raise ValueError(f"{kpi_id} has its own function ({formula.archetype})")
    return compute_kpis(df, {kpi_id: formula.expr}, keys, period)


def _shaped(df: DataFrame, kpi_id: str, keys: Sequence[str], period: str | Column, value: Column) -> DataFrame:
    at = F.col(period) if isinstance(period, str) else period
    return df.select(*keys, F.lit(kpi_id).alias("kpi_id"), at.alias("period"), value.alias("value"))


def growth(values: DataFrame, kpi_id: str, keys: Sequence[str] = ()) -> DataFrame:
    """Change against the period before, from KPI rows of one base KPI (one row per period)."""
    before = F.lag("value").over(Window.partitionBy(*keys, "kpi_id").orderBy("period"))
    rows = values.withColumn("__b", before)
    return _shaped(rows, kpi_id, keys, "period", F.try_divide(F.col("value") - F.col("__b"), F.col("__b")))


def average_of_sums(df: DataFrame, kpi_id: str, value: str, inner: Column, period: Column, keys: Sequence[str] = ()) -> DataFrame:
    """Mean over inner periods (months) of the sum, per outer period."""
    sums = df.groupBy(*keys, period.alias("period"), inner.alias("__inner")).agg(F.sum(value).alias("s"))
    out = sums.groupBy(*keys, "period").agg(F.sum("s").cast("double").alias("t"), F.count("*").alias("n"))
    return _shaped(out, kpi_id, keys, "period", F.col("t") / F.col("n"))


def mean_gap(df: DataFrame, kpi_id: str, ts: str, keys: Sequence[str] = (), period: Column | None = None) -> DataFrame:
    """Mean days between consecutive rows. The gaps telescope to (last - first) / (rows - 1), so no
    ordering of the rows is needed, however many one key holds."""
    at = (period if period is not None else F.lit("all")).alias("period")
    ends = df.groupBy(*keys, at).agg(
        (F.unix_micros(F.max(ts)) - F.unix_micros(F.min(ts))).alias("span"), F.count(ts).alias("n")
    )
    return _shaped(ends, kpi_id, keys, "period", F.try_divide(F.col("span").cast("double"), F.col("n") - 1) / F.lit(86_400_000_000.0))


def percentile_kpi(df: DataFrame, kpi_id: str, value: str, p: float, keys: Sequence[str] = (), period: Column | None = None) -> DataFrame:
    at = (period if period is not None else F.lit("all")).alias("period")
    q = exact_quantiles(df.select(*keys, at, value), [*keys, "period"], value, [p])
    return _shaped(q, kpi_id, keys, "period", F.element_at("q", 1))


def trailing_distinct(df: DataFrame, kpi_id: str, who: str, ts: str, days: int = 30, keys: Sequence[str] = ()) -> DataFrame:
    """Distinct ``who`` over the trailing ``days`` for every day that has rows.

    Each (who, day) pair is kept once. Instead of repeating it for every day it counts for, a pair
    opens an interval of ``days`` days that the next pair of the same ``who`` may cut short; the
    count per day is then a running sum of intervals opened less intervals closed.
    """
    pairs = df.select(*keys, F.col(who).alias("__who"), F.col(ts).cast("date").alias("d")).distinct()
    nxt = F.lead("d").over(Window.partitionBy(*keys, "__who").orderBy("d"))
    until = F.least(F.date_add("d", days), F.coalesce(nxt, F.date_add("d", days)))
    steps = pairs.select(*keys, "d", until.alias("u"))
    moves = steps.select(*keys, F.inline(F.array(F.struct(F.col("d").alias("d"), F.lit(1).alias("m"), F.lit(1).alias("seen")), F.struct(F.col("u").alias("d"), F.lit(-1).alias("m"), F.lit(0).alias("seen")))))
    per_day = moves.groupBy(*keys, "d").agg(F.sum("m").alias("m"), F.sum("seen").alias("seen"))
    upto = Window.partitionBy(*keys).orderBy("d").rowsBetween(Window.unboundedPreceding, 0)  # one row per day
    rows = per_day.withColumn("active", F.sum("m").over(upto)).where("seen > 0")
    return _shaped(rows, kpi_id, keys, F.col("d").cast("string"), F.col("active").cast("double"))


def funnel(df: DataFrame, kpi_id: str, stage: str, stages: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Count of each stage divided by the count of the stage before; ``period`` holds the stage."""
    counts = df.where(F.col(stage).isin(list(stages))).groupBy(*keys).agg(
        *[F.count_if(F.col(stage) == s).alias(f"__n{i}") for i, s in enumerate(stages)]
    )
    rates = [
        F.struct(F.lit(s).alias("period"), F.try_divide(F.col(f"__n{i}"), F.col(f"__n{i - 1}")).alias("value"))
        for i, s in enumerate(stages) if i
    ]
    return counts.select(*keys, F.lit(kpi_id).alias("kpi_id"), F.inline(F.array(*rates)))


def retention_loss(df: DataFrame, who: str, ts: str, amount: str | None, kpi_id: str, keys: Sequence[str] = ()) -> DataFrame:
    """Share of a month's customers (or of their revenue) that are absent in the next month.

    The last month has no next one and is left out.
    """
    month = F.trunc(F.col(ts).cast("date"), "month")
    weight = F.sum(amount) if amount else F.lit(1)
    held = df.groupBy(*keys, F.col(who).alias("__who"), month.alias("m")).agg(weight.alias("w"))
    again = held.select(*keys, "__who", F.add_months("m", -1).alias("m"), F.lit(True).alias("back"))
    rows = held.join(again, [*keys, "__who", "m"], "left")
    last = df.groupBy(*keys).agg(F.max(month).alias("__last"))
    out = rows.groupBy(*keys, "m").agg(
        F.sum("w").cast("double").alias("all"), F.sum(F.when(F.col("back").isNull(), F.col("w")).otherwise(0)).cast("double").alias("lost")
    )
    out = join_same(out, last, keys, "inner")
    return _shaped(out.where(F.col("m") < F.col("__last")), kpi_id, keys, F.date_format("m", "yyyy-MM"), F.try_divide("lost", "all"))


def derived(a: DataFrame, b: DataFrame, kpi_id: str, keys: Sequence[str] = ()) -> DataFrame:
    """Quotient of two KPIs per period."""
    right = b.select(*keys, "period", F.col("value").alias("__b"))
    return _shaped(a.join(right, [*keys, "period"]), kpi_id, keys, "period", F.try_divide("value", "__b"))


def lifetime_value(df: DataFrame, kpi_id: str, who: str, value: str, ts: str, keys: Sequence[str] = ()) -> DataFrame:
    """Mean over customers of revenue times lifespan in months (whole months, at least one)."""
    mm = F.year(ts) * 12 + F.month(ts)
    per = df.groupBy(*keys, who).agg(F.sum(value).alias("r"), (F.max(mm) - F.min(mm) + 1).alias("months"))
    out = per.groupBy(*keys).agg(F.sum(F.col("r") * F.col("months")).cast("double").alias("t"), F.count("*").alias("n"))
    return _shaped(out, kpi_id, keys, F.lit("all"), F.col("t") / F.col("n"))


# thresholds and dashboards -----------------------------------------------------------------


def _catalog_map(field: str) -> Column:
    pairs = [x for k in CATALOG if getattr(k, field) is not None for x in (F.lit(k.id), F.lit(getattr(k, field)))]
    return F.create_map(*pairs)[F.col("kpi_id")]


def kpi_alerts(values: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Change in percent against the prior period, and whether it passes the KPI's alert threshold."""
    before = F.lag("value").over(Window.partitionBy(*keys, "kpi_id").orderBy("period"))
    change = F.try_divide(F.col("value") - F.col("previous"), F.abs("previous")) * 100.0
    rows = values.withColumn("previous", before).withColumn("delta_pct", change)
    rows = rows.withColumn("alert_threshold_pct", _catalog_map("alert_pct"))
    return rows.withColumn("alert", F.coalesce(F.abs("delta_pct") > F.col("alert_threshold_pct"), F.lit(False)))


def kpi_vs_target(values: DataFrame) -> DataFrame:
    """Gap to the target value, positive when the KPI is on the good side. KPIs without target drop out."""
    rows = values.withColumn("target", _catalog_map("target")).where(F.col("target").isNotNull())
    gap = F.col("value") - F.col("target")
    rows = rows.withColumn("gap", F.when(_catalog_map("higher_is_better"), gap).otherwise(-gap))
    return rows.withColumn("met", F.col("gap") >= 0)


def audience_dashboard(values: DataFrame, audience_column: str = "audience") -> DataFrame:
    """KPI rows per audience that lists the KPI, with the position on its board."""
    boards: dict[str, list] = {}
    for name, kpis in AUDIENCES.values():
        for i, k in enumerate(kpis):
            boards.setdefault(k, []).append(F.struct(F.lit(name).alias(audience_column), F.lit(i + 1).alias("position")))
    empty = F.array().cast(f"array<struct<{audience_column}:string,position:int>>")
    on = F.create_map(*[x for k, b in boards.items() for x in (F.lit(k), F.array(*b))])[F.col("kpi_id")]
    return values.select("*", F.inline(F.coalesce(on, empty)))
