"""All 58 catalog KPIs on domain tables bound to the test tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeworks.operators import kpis as kp
from gaugeworks.plans import bindings as b
from gaugeworks.plans.registry import ORACLE, query
from gaugeworks.session import stage

# domain tables -----------------------------------------------------------------------------


def _lines(spark, sf) -> DataFrame:
    """Order lines with their order: the base of most domain tables."""
    lines = b.table(spark, sf, "lineitem")
    return lines.join(b.table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))


def _price():
    return F.col("l_extendedprice").cast("decimal(18,4)")


def _part(expr: str):
    return F.expr(expr).cast("decimal(18,4)")


def _lines_and_first_year(spark, sf, how: str = "inner") -> DataFrame:
    # the customer's first year joins the orders before the far more numerous lines do
    orders = b.table(spark, sf, "orders")
    first = orders.groupBy("o_custkey").agg(F.year(F.min("o_orderdate")).alias("first_year"))
    return b.table(spark, sf, "lineitem").join(orders.join(first, "o_custkey", how), F.col("l_orderkey") == F.col("o_orderkey"))


def ledger_columns() -> list:
    return [
        F.col("o_orderdate").alias("ts"),
        F.col("o_custkey").alias("customer_id"),
        F.when(F.year("o_orderdate") == F.col("first_year"), F.col("o_custkey")).alias("new_customer_id"),
        _price().alias("revenue"),
        _part("l_quantity * 900").alias("cogs"),
        _part("l_extendedprice * (1 - l_discount)").alias("operating_income"),
        _part("l_extendedprice * l_tax").alias("depreciation"),
        _part("l_quantity").alias("amortization"),
        _part("l_extendedprice * l_tax").alias("cash_outflow"),
        _part("l_extendedprice * l_discount").alias("sales_marketing_spend"),
        F.datediff("l_shipdate", "o_orderdate").alias("receivables_days"),
        _price().alias("actual"),
        _part("l_quantity * 1500").alias("plan"),
        _part("o_totalprice").alias("cash_balance"),
        F.col("l_orderkey").alias("doc"),
        "l_linenumber",
    ]


def opportunity_columns() -> list:
    status = F.col("o_orderstatus")
    return [
        F.col("o_orderdate").alias("ts"),
        F.when(status == "F", "won").when(status == "P", "lost").otherwise("open").alias("stage"),
        _price().alias("amount"),
        F.col("l_shipdate").alias("close_date"),
        F.col("o_orderdate").alias("created_date"),
        F.date_add(F.col("o_orderdate").cast("date"), F.col("l_linenumber")).alias("first_contact"),
        _price().alias("actual_revenue"),
        _part("l_quantity * 1400").alias("quota"),
        _price().alias("annual_value"),
        (F.col("l_linestatus") == "O").alias("active"),
        _price().alias("starting_arr"),
        _part("l_extendedprice * l_tax").alias("expansion"),
        _part("l_extendedprice * l_discount").alias("churn"),
        _part("l_quantity").alias("contraction"),
    ]


def request(spark, sf) -> DataFrame:
    ts = F.col("ts").cast("timestamp")
    k = F.from_json("props", "k INT")["k"]
    return b.table(spark, sf, "events").select(
        ts.alias("ts"),
        "event_type",
        F.when(F.col("event_type") == "error", F.col("value").cast("decimal(18,2)")).otherwise(0).cast("decimal(18,2)").alias("downtime_seconds"),
        F.lit(600).cast("decimal(18,2)").alias("total_seconds"),
        F.timestamp_add("SECOND", k, ts).alias("resolved_at"),
        (F.col("event_type") == "error").alias("failed"),
        F.col("value").alias("latency_ms"),
        F.col("value").cast("decimal(18,2)").alias("cogs"),
        k.cast("decimal(18,2)").alias("inventory_value"),
        F.col("value").cast("decimal(18,2)").alias("actual_output"),
        F.lit(100).cast("decimal(18,2)").alias("max_capacity"),
    )


def employee_columns() -> list:
    return [
        F.col("o_orderdate").alias("ts"),
        F.col("o_custkey").alias("employee_id"),
        (F.col("l_linestatus") == "O").alias("active"),
        (F.col("l_returnflag") == "R").alias("departed"),
        (F.col("l_quantity") > 25).alias("voluntary"),
        (F.col("o_custkey") % 100 + 50).alias("headcount"),
        F.col("l_shipdate").alias("start_date"),
        F.col("o_orderdate").alias("open_date"),
        (F.col("o_orderstatus") == "F").alias("accepted"),
        F.col("l_linenumber").alias("engagement"),
        F.col("l_quantity").cast("long").alias("training_hours"),
        (F.col("l_returnflag") == "A").alias("underrepresented"),
        (F.col("l_linestatus") == "F").alias("contractor"),
        _part("l_extendedprice * l_discount").alias("recruiting_spend"),
    ]


def ticket_columns() -> list:
    return [
        F.col("o_orderdate").cast("timestamp").alias("ts"),
        F.col("o_custkey").alias("customer_id"),
        (F.col("l_quantity").cast("long") % 11).alias("score"),
        F.col("l_linenumber").alias("satisfaction"),
        _price().alias("arr"),
        F.timestamp_add("MINUTE", F.col("l_linenumber"), F.col("o_orderdate").cast("timestamp")).alias("first_response"),
        F.col("l_shipdate").cast("timestamp").alias("resolved_at"),
    ]


def transaction_columns() -> list:
    pri = F.substring("o_orderpriority", 1, 1)
    return [
        F.col("o_orderdate").alias("ts"),
        _price().alias("amount"),
        (F.col("l_returnflag") == "R").alias("fraud"),
        (F.col("l_returnflag") != "N").alias("alert"),
        (F.col("l_returnflag") == "A").alias("false_positive"),
        (F.col("l_tax") > 0.05).alias("aml"),
        F.when(F.col("o_orderstatus") == "O", "open").otherwise("closed").alias("status"),
        F.when(pri == "1", "critical").when(pri == "2", "high").when(pri == "3", "medium").otherwise("low").alias("severity"),
    ]


def deploy_columns() -> list:
    return [
        F.col("o_orderdate").cast("timestamp").alias("ts"),
        F.col("o_custkey").alias("user_id"),
        (F.col("l_returnflag") == "R").alias("uses_feature"),
        F.col("l_shipdate").cast("timestamp").alias("deploy_time"),
        (F.col("l_linestatus") == "F").alias("failed"),
        F.concat(F.lit("P"), F.substring("o_orderpriority", 1, 1).cast("int") - 1).alias("priority"),
        F.when(F.col("o_orderstatus") == "O", "open").otherwise("closed").alias("status"),
    ]


LINE_TABLES = {
    "ledger": ledger_columns, "opportunity": opportunity_columns, "employee": employee_columns,
    "ticket": ticket_columns, "transaction": transaction_columns, "deploy": deploy_columns,
}


def _line_base(spark, sf, tables) -> DataFrame:
    """Order lines with what the named tables need. Those of orders without a customer are in every table
    but the ledger."""
    if "ledger" not in tables:
        return _lines(spark, sf)
    return _lines_and_first_year(spark, sf, "inner" if len(tables) == 1 else "left")


def _on_lines(name: str):
    return lambda spark, sf: _line_base(spark, sf, [name]).select(*LINE_TABLES[name]())


ledger, opportunity, employee, ticket, transaction, deploy = (_on_lines(t) for t in LINE_TABLES)

TABLES = {
    "ledger": ledger, "opportunity": opportunity, "request": request, "employee": employee,
    "ticket": ticket, "transaction": transaction, "deploy": deploy,
}


def _yearly():
    return F.date_format("ts", "yyyy")


def _daily():
    return F.date_format("ts", "yyyy-MM-dd")



# one-pass KPIs -----------------------------------------------------------------------------

_L = "FROM lineitem JOIN orders ON l_orderkey = o_orderkey"
_P4 = "CAST(l_extendedprice AS DECIMAL(18,4))"


def _d4(e: str) -> str:
    return f"CAST({e} AS DECIMAL(18,4))"


def _sum(e: str) -> str:
    return f"CAST(SUM({e}) AS DOUBLE)"


_OPINC, _TAX, _OFF = _d4("l_extendedprice * (1 - l_discount)"), _d4("l_extendedprice * l_tax"), _d4("l_extendedprice * l_discount")
_DATEDIFF = "AVG(date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE)))"

SQL = {
    "fin_revenue_total": _sum(_P4),
    "fin_gross_margin": f"({_sum(_P4)} - {_sum(_d4('l_quantity * 900'))}) / {_sum(_P4)}",
    "fin_operating_margin": f"{_sum(_OPINC)} / {_sum(_P4)}",
    "fin_ebitda": f"CAST(SUM({_OPINC}) + SUM({_TAX}) + SUM({_d4('l_quantity')}) AS DOUBLE)",
    "fin_cac": f"{_sum(_OFF)} / COUNT(DISTINCT CASE WHEN year(o_orderdate) = first_year THEN o_custkey END)",
    "fin_dso": _DATEDIFF,
    "fin_budget_variance": f"({_sum(_P4)} - {_sum(_d4('l_quantity * 1500'))}) / {_sum(_d4('l_quantity * 1500'))}",
    "sls_pipeline_value": f"CAST(SUM({_P4}) FILTER (o_orderstatus NOT IN ('F', 'P')) AS DOUBLE)",
    "sls_win_rate": "COUNT(*) FILTER (o_orderstatus = 'F') / COUNT(*) FILTER (o_orderstatus IN ('F', 'P'))",
    "sls_avg_deal_size": f"CAST(SUM({_P4}) FILTER (o_orderstatus = 'F') AS DOUBLE) / COUNT(*) FILTER (o_orderstatus = 'F')",
    "sls_sales_cycle_days": _DATEDIFF,
    "sls_quota_attainment": f"{_sum(_P4)} / {_sum(_d4('l_quantity * 1400'))}",
    "sls_lead_response_time": "AVG(l_linenumber)",
    "sls_arr": f"CAST(SUM({_P4}) FILTER (l_linestatus = 'O') AS DOUBLE)",
    "sls_net_revenue_retention": f"CAST(SUM({_P4}) + SUM({_TAX}) - SUM({_OFF}) - SUM({_d4('l_quantity')}) AS DOUBLE) / {_sum(_P4)}",
    "ops_uptime": "1 - CAST(SUM(CASE WHEN event_type = 'error' THEN CAST(value AS DECIMAL(18,2)) ELSE 0 END) AS DOUBLE) / (COUNT(*) * 600.0::DOUBLE)",
    "ops_mttr": "CAST(SUM(k) AS DOUBLE) / COUNT(*) / 60.0::DOUBLE",
    "ops_throughput": "COUNT(*) / COUNT(DISTINCT date_trunc('hour', ts))",
    "ops_error_rate": "COUNT(*) FILTER (event_type = 'error') / COUNT(*)",
    "ops_inventory_turnover": "CAST(SUM(CAST(value AS DECIMAL(18,2))) AS DOUBLE) / (CAST(SUM(k) AS DOUBLE) / COUNT(*))",
    "ops_capacity_utilization": "CAST(SUM(CAST(value AS DECIMAL(18,2))) AS DOUBLE) / (COUNT(*) * 100.0::DOUBLE)",
    "hr_headcount": "CAST(COUNT(*) FILTER (l_linestatus = 'O') AS DOUBLE)",
    "hr_attrition_rate": "12 * (COUNT(*) FILTER (l_returnflag = 'R') / AVG(o_custkey % 100 + 50))",
    "hr_voluntary_attrition": "COUNT(*) FILTER (l_returnflag = 'R' AND l_quantity > 25) / AVG(o_custkey % 100 + 50)",
    "hr_time_to_hire": _DATEDIFF,
    "hr_offer_acceptance": "COUNT(*) FILTER (o_orderstatus = 'F') / COUNT(*)",
    "hr_engagement_score": "AVG(l_linenumber)",
    "hr_training_hours": "SUM(CAST(l_quantity AS BIGINT)) / COUNT(DISTINCT o_custkey)",
    "hr_diversity_pct": "COUNT(*) FILTER (l_returnflag = 'A') / COUNT(*)",
    "hr_contractor_ratio": "COUNT(*) FILTER (l_linestatus = 'F') / COUNT(*)",
    "hr_cost_per_hire": f"{_sum(_OFF)} / COUNT(*) FILTER (o_orderstatus = 'F')",
    "cust_nps": "100 * ((COUNT(*) FILTER (CAST(l_quantity AS BIGINT) % 11 >= 9) - COUNT(*) FILTER (CAST(l_quantity AS BIGINT) % 11 <= 6)) / COUNT(*))",
    "cust_csat": "AVG(l_linenumber)",
    "cust_first_response_time": "AVG(l_linenumber)",
    "cust_resolution_time": "SUM(date_diff('hour', o_orderdate, l_shipdate)) / COUNT(*)",
    "risk_fraud_rate": f"CAST(SUM({_P4}) FILTER (l_returnflag = 'R') AS DOUBLE) / {_sum(_P4)}",
    "risk_false_positive_rate": "COUNT(*) FILTER (l_returnflag = 'A') / COUNT(*) FILTER (l_returnflag <> 'N')",
    "risk_aml_alerts": "CAST(COUNT(*) FILTER (l_tax > 0.05 AND o_orderstatus = 'O') AS DOUBLE)",
    "risk_audit_findings": "CAST(COUNT(*) FILTER (o_orderstatus = 'O') AS DOUBLE)",
    "risk_security_incidents": "CAST(COUNT(*) FILTER (o_orderpriority < '3') AS DOUBLE)",
    "prod_feature_adoption": "COUNT(DISTINCT o_custkey) FILTER (l_returnflag = 'R') / COUNT(DISTINCT o_custkey)",
    "prod_release_frequency": "COUNT(*) / COUNT(DISTINCT date_trunc('month', o_orderdate))",
    "prod_lead_time_changes": "SUM(date_diff('hour', o_orderdate, l_shipdate)) / COUNT(*)",
    "prod_change_failure_rate": "COUNT(*) FILTER (l_linestatus = 'F') / COUNT(*)",
    "prod_bug_count": "CAST(COUNT(*) FILTER (o_orderpriority < '3' AND o_orderstatus = 'O') AS DOUBLE)",
}


def _pass_sql(table: str) -> str:
    if table == "request":
        src, period = "(SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)", "strftime(ts, '%Y-%m-%d')"
    else:
        src, period = f"(SELECT * {_L})", "strftime(o_orderdate, '%Y')"
    if table == "ledger":
        src = f"(SELECT * {_L} JOIN (SELECT o_custkey AS ck, year(MIN(o_orderdate)) AS first_year FROM orders GROUP BY 1) ON ck = o_custkey)"
    # a zero denominator gives no value, where the checking engine would give infinity
    cols = ", ".join(
        f"ROUND(CASE WHEN isfinite(CAST({SQL[k]} AS DOUBLE)) THEN {SQL[k]} END, 6) AS {k}" for k in kp.one_pass_kpis(table)
    )
    names = ", ".join(kp.one_pass_kpis(table))
    return f"""SELECT kpi_id, period, value FROM (SELECT {period} AS period, {cols} FROM {src} GROUP BY 1)
      UNPIVOT INCLUDE NULLS (value FOR kpi_id IN ({names}))"""


def one_pass(spark, sf, table: str) -> DataFrame:
    period = _daily() if table == "request" else _yearly()
    return kp.compute_kpis(TABLES[table](spark, sf), kp.one_pass_kpis(table), period=period)


def _six(df: DataFrame) -> DataFrame:
    return df.withColumn("value", F.round("value", 6))


def _register(table: str) -> None:
    @query(f"kpis_{table}", _pass_sql(table))
    def _(spark, sf):
        return _six(one_pass(spark, sf, table))


for _name in TABLES:
    _register(_name)

# other archetypes --------------------------------------------------------------------------

_BURN = f"""burn AS (SELECT strftime(m, '%Y') AS period, AVG(t) AS value FROM (SELECT date_trunc('month', o_orderdate) AS m,
  CAST(SUM({_TAX}) AS DOUBLE) AS t {_L} GROUP BY 1) GROUP BY 1)"""
_REVENUE = f"rev AS (SELECT strftime(o_orderdate, '%Y') AS period, {_sum(_P4)} AS value {_L} GROUP BY 1)"
_LTV = f"""ltv AS (SELECT SUM(r * months) / COUNT(*) AS value FROM (SELECT o_custkey, CAST(SUM({_P4}) AS DOUBLE) AS r,
  MAX(year(o_orderdate) * 12 + month(o_orderdate)) - MIN(year(o_orderdate) * 12 + month(o_orderdate)) + 1 AS months {_L} GROUP BY 1))"""


def _as_kpi(kpi: str, sql: str, digits: int = 6) -> str:
    return f"SELECT '{kpi}' AS kpi_id, CAST(period AS VARCHAR) AS period, ROUND(value, {digits}) AS value FROM ({sql})"


def _growth_sql(base: str) -> str:
    return f"SELECT period, (value - LAG(value) OVER (ORDER BY period)) / LAG(value) OVER (ORDER BY period) AS value FROM {base}"


@query("kpi_revenue_growth", f"WITH {_REVENUE} {_as_kpi('fin_revenue_growth_yoy', _growth_sql('rev'))}")
def _(spark, sf):
    base = kp.compute_kpi(ledger(spark, sf), "fin_revenue_total", period=_yearly())
    return _six(kp.growth(base, "fin_revenue_growth_yoy"))


@query("kpi_arr_growth", f"""WITH arr AS (SELECT strftime(o_orderdate, '%Y') AS period, {SQL['sls_arr']} AS value {_L} GROUP BY 1)
  {_as_kpi('sls_arr_growth', _growth_sql('arr'))}""")
def _(spark, sf):
    base = kp.compute_kpi(opportunity(spark, sf), "sls_arr", period=_yearly())
    return _six(kp.growth(base, "sls_arr_growth"))


def _burn(spark, sf) -> DataFrame:
    return kp.average_of_sums(ledger(spark, sf), "fin_burn_rate", "cash_outflow", F.date_format("ts", "yyyy-MM"), _yearly())


@query("kpi_burn_rate", f"WITH {_BURN} {_as_kpi('fin_burn_rate', 'SELECT * FROM burn', 3)}")
def _(spark, sf):
    return _burn(spark, sf).withColumn("value", F.round("value", 3))


_BALANCE = f"""bal AS (SELECT strftime(o_orderdate, '%Y') AS period, CAST(ARG_MAX(o_totalprice, (o_orderdate, l_orderkey, l_linenumber)) AS DOUBLE) AS value {_L} GROUP BY 1)"""


@query("kpi_runway", f"WITH {_BURN}, {_BALANCE} {_as_kpi('fin_runway_months', 'SELECT period, bal.value / burn.value AS value FROM bal JOIN burn USING (period)')}")
def _(spark, sf):
    last = ledger(spark, sf).groupBy(_yearly().alias("period")).agg(
        F.max_by(F.col("cash_balance").cast("double"), F.struct("ts", "doc", "l_linenumber")).alias("value")
    )
    return _six(kp.derived(last, _burn(spark, sf), "fin_runway_months"))


@query("kpi_ltv", f"WITH {_LTV} SELECT 'fin_ltv' AS kpi_id, 'all' AS period, ROUND(value, 3) AS value FROM ltv")
def _(spark, sf):
    out = kp.lifetime_value(ledger(spark, sf), "fin_ltv", "customer_id", "revenue", "ts")
    return out.withColumn("value", F.round("value", 3))


@query("kpi_ltv_cac", f"""WITH {_LTV}, cac AS (SELECT {_sum(_OFF)} / COUNT(DISTINCT CASE WHEN year(o_orderdate) = fy THEN o_custkey END) AS value
  {_L} JOIN (SELECT o_custkey AS ck, year(MIN(o_orderdate)) AS fy FROM orders GROUP BY 1) ON ck = o_custkey)
  SELECT 'fin_ltv_cac' AS kpi_id, 'all' AS period, ROUND(ltv.value / cac.value, 6) AS value FROM ltv, cac""")
def _(spark, sf):
    rows = ledger(spark, sf)
    ltv = kp.lifetime_value(rows, "fin_ltv", "customer_id", "revenue", "ts")
    return _six(kp.derived(ltv, kp.compute_kpi(rows, "fin_cac"), "fin_ltv_cac"))


@query("kpi_mean_gap", """SELECT event_type, 'ops_mtbf' AS kpi_id, 'all' AS period, ROUND(AVG(g), 9) AS value FROM (SELECT event_type,
  (epoch_us(ts) - LAG(epoch_us(ts)) OVER (PARTITION BY event_type ORDER BY ts)) / 86400000000.0::DOUBLE AS g FROM events) GROUP BY 1""")
def _(spark, sf):
    out = kp.mean_gap(request(spark, sf), "ops_mtbf", "ts", ["event_type"])
    return out.withColumn("value", F.round("value", 9))


@query("kpi_p95_latency", """SELECT 'ops_p95_latency' AS kpi_id, strftime(ts, '%Y-%m-%d') AS period, ROUND(quantile_cont(value, 0.95), 6) AS value FROM events GROUP BY 2""")
def _(spark, sf):
    return _six(kp.percentile_kpi(request(spark, sf), "ops_p95_latency", "latency_ms", 0.95, period=_daily()))


STAGES = ("view", "click", "signup", "purchase")


@query("kpi_funnel", """WITH c AS (SELECT event_type, COUNT(*) AS n FROM events GROUP BY 1),
  p(period, before) AS (VALUES ('click', 'view'), ('signup', 'click'), ('purchase', 'signup'))
  SELECT 'sls_funnel_conversion' AS kpi_id, period, ROUND(a.n / b.n, 6) AS value FROM p JOIN c a ON a.event_type = period JOIN c b ON b.event_type = before""")
def _(spark, sf):
    return _six(kp.funnel(b.table(spark, sf, "events"), "sls_funnel_conversion", "event_type", STAGES))


def _loss_sql(kpi: str, weight: str) -> str:
    return f"""WITH h AS (SELECT o_custkey, date_trunc('month', o_orderdate) AS m, {weight} AS w {_L} GROUP BY 1, 2)
      SELECT '{kpi}' AS kpi_id, strftime(h.m, '%Y-%m') AS period, ROUND(CAST(SUM(CASE WHEN n.o_custkey IS NULL THEN h.w ELSE 0 END) AS DOUBLE) / CAST(SUM(h.w) AS DOUBLE), 6) AS value
      FROM h LEFT JOIN h n ON n.o_custkey = h.o_custkey AND n.m = h.m + INTERVAL 1 MONTH WHERE h.m < (SELECT MAX(m) FROM h) GROUP BY 2"""


@query("kpi_churn_rate", _loss_sql("cust_churn_rate", "1"))
def _(spark, sf):
    return _six(kp.retention_loss(ticket(spark, sf), "customer_id", "ts", None, "cust_churn_rate"))


@query("kpi_revenue_churn", _loss_sql("cust_revenue_churn", f"SUM({_P4})"))
def _(spark, sf):
    return _six(kp.retention_loss(ticket(spark, sf), "customer_id", "ts", "arr", "cust_revenue_churn"))


_ACTIVE = """d AS (SELECT DISTINCT CAST(ts AS DATE) AS d FROM events), u AS (SELECT DISTINCT CAST(ts AS DATE) AS d, user_id FROM events),
  mau AS (SELECT d.d, COUNT(DISTINCT user_id) AS n FROM d JOIN u ON u.d BETWEEN d.d - {days} AND d.d GROUP BY 1)"""


def _users(spark, sf) -> DataFrame:
    return b.table(spark, sf, "events").select("user_id", "ts")


@query("kpi_active_users", f"WITH {_ACTIVE.format(days=29)} SELECT 'cust_active_users' AS kpi_id, CAST(d AS VARCHAR) AS period, CAST(n AS DOUBLE) AS value FROM mau")
def _(spark, sf):
    return kp.trailing_distinct(_users(spark, sf), "cust_active_users", "user_id", "ts", 30)


@query("kpi_active_users_weekly", f"WITH {_ACTIVE.format(days=6)} SELECT 'cust_active_users' AS kpi_id, CAST(d AS VARCHAR) AS period, CAST(n AS DOUBLE) AS value FROM mau")
def _(spark, sf):
    return kp.trailing_distinct(_users(spark, sf), "cust_active_users", "user_id", "ts", 7)


@query("kpi_dau_mau", f"""WITH {_ACTIVE.format(days=29)}, dau AS (SELECT d, COUNT(*) AS n FROM u GROUP BY 1)
  SELECT 'cust_dau_mau' AS kpi_id, CAST(d AS VARCHAR) AS period, ROUND(dau.n / mau.n, 6) AS value FROM dau JOIN mau USING (d)""")
def _(spark, sf):
    users = _users(spark, sf)
    daily = kp.trailing_distinct(users, "dau", "user_id", "ts", 1)
    return _six(kp.derived(daily, kp.trailing_distinct(users, "mau", "user_id", "ts", 30), "cust_dau_mau"))


# thresholds and dashboards -----------------------------------------------------------------


def _wanted(spark, sf, ids, *tables: str) -> DataFrame:
    """The KPIs in ``ids`` of several domain tables: one pass over the order lines, one over the events."""
    picked = {t: {k: e for k, e in kp.one_pass_kpis(t).items() if k in ids} for t in tables}
    lines = {t: (LINE_TABLES[t](), exprs) for t, exprs in picked.items() if t in LINE_TABLES and exprs}
    only = {"ledger": F.col("o_custkey").isNotNull()} if "ledger" in lines and len(lines) > 1 else {}
    parts = [kp.compute_boards(_line_base(spark, sf, lines), lines, F.date_format("o_orderdate", "yyyy"), only)] if lines else []
    if picked.get("request"):
        parts.append(kp.compute_kpis(request(spark, sf), picked["request"], period=_daily()))
    return reduce(DataFrame.unionByName, parts)


@query("kpi_alerts", f"""WITH v AS ({_pass_sql('ledger')} UNION ALL {_pass_sql('request')}), t(kpi_id, thr) AS (VALUES ('fin_budget_variance', 10.0::DOUBLE), ('ops_error_rate', 1.0::DOUBLE)),
  p AS (SELECT *, LAG(value) OVER (PARTITION BY kpi_id ORDER BY period) AS previous FROM v),
  d AS (SELECT *, CASE WHEN previous <> 0 THEN (value - previous) / ABS(previous) * 100 END AS delta_pct FROM p)
  SELECT kpi_id, period, value, previous, ROUND(delta_pct, 6) AS delta_pct, thr AS alert_threshold_pct, COALESCE(ABS(delta_pct) > thr, FALSE) AS alert
  FROM d LEFT JOIN t USING (kpi_id)""")
def _(spark, sf):
    out = kp.kpi_alerts(_six(_wanted(spark, sf, set(kp.FORMULAS), "ledger", "request")))
    return out.withColumn("delta_pct", F.round("delta_pct", 6))


@query("kpi_vs_target", f"""WITH v AS ({_pass_sql('opportunity')} UNION ALL {_pass_sql('ticket')} UNION ALL {_pass_sql('employee')} UNION ALL {_pass_sql('request')}),
  t(kpi_id, target) AS (VALUES ('sls_quota_attainment', 1.0::DOUBLE), ('sls_net_revenue_retention', 1.1::DOUBLE), ('ops_uptime', 0.999::DOUBLE),
  ('hr_engagement_score', 4.0::DOUBLE), ('cust_nps', 50.0::DOUBLE))
  SELECT kpi_id, period, value, target, ROUND(value - target, 6) AS gap, value - target >= 0 AS met FROM v JOIN t USING (kpi_id)""")
def _(spark, sf):
    out = kp.kpi_vs_target(_six(_wanted(spark, sf, kp.with_target(), "opportunity", "ticket", "employee", "request")))
    return out.withColumn("gap", F.round("gap", 6))


_BOARD = ", ".join(
    f"('{name.replace(chr(39), chr(39) * 2)}', {i + 1}, '{k}')" for name, ks in kp.AUDIENCES.values() for i, k in enumerate(ks)
)


#: KPIs on boards that are no single aggregate, with the queries of their own.
_OWN = {
    "fin_revenue_growth_yoy": "kpi_revenue_growth", "sls_arr_growth": "kpi_arr_growth", "fin_burn_rate": "kpi_burn_rate", "fin_runway_months": "kpi_runway",
    "sls_funnel_conversion": "kpi_funnel", "cust_churn_rate": "kpi_churn_rate", "cust_active_users": "kpi_active_users",
}


def _order_sums(spark, sf) -> DataFrame:
    """Orders with the sums over their lines, written once for the KPIs of several passes."""
    sums = b.table(spark, sf, "lineitem").groupBy("l_orderkey").agg(
        F.sum(_price()).alias("revenue"),
        F.sum(F.when(F.col("l_linestatus") == "O", _price())).alias("annual_value"),
        F.sum(_part("l_extendedprice * l_tax")).alias("cash_outflow"),
    )
    return stage(sums.join(b.table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("o_orderdate").alias("ts"), F.col("o_custkey").alias("customer_id"), F.col("l_orderkey").alias("doc"),
        _part("o_totalprice").alias("cash_balance"), "revenue", "annual_value", F.lit(True).alias("active"), "cash_outflow",
    ))


def _growth_of(orders: DataFrame, base: str, kpi_id: str) -> DataFrame:
    """Growth by year; what has no date comes last."""
    out = kp.growth(kp.compute_kpi(orders, base, period=F.coalesce(_yearly(), F.lit("~"))), kpi_id)
    return out.withColumn("period", F.nullif("period", F.lit("~")))


def _over_passes(spark, sf) -> list[DataFrame]:
    """The KPIs of ``_OWN``."""
    orders, events = _order_sums(spark, sf), b.table(spark, sf, "events")
    burn = kp.average_of_sums(orders, "fin_burn_rate", "cash_outflow", F.date_format("ts", "yyyy-MM"), _yearly())
    last = orders.where("cash_balance IS NOT NULL").groupBy(_yearly().alias("period")).agg(
        F.max_by(F.col("cash_balance").cast("double"), F.struct("ts", "doc")).alias("value")
    )
    return [
        _growth_of(orders, "fin_revenue_total", "fin_revenue_growth_yoy"),
        _growth_of(orders, "sls_arr", "sls_arr_growth"),
        burn.withColumn("value", F.round("value", 3)),
        kp.derived(last, burn, "fin_runway_months"),
        kp.funnel(events, "sls_funnel_conversion", "event_type", STAGES),
        kp.retention_loss(orders, "customer_id", "ts", None, "cust_churn_rate"),
        kp.trailing_distinct(_users(spark, sf).where("user_id IS NOT NULL AND ts IS NOT NULL"), "cust_active_users", "user_id", "ts", 30),
    ]


@query("audience_dashboard", f"""WITH v AS ({' UNION ALL '.join([*[_pass_sql(t) for t in TABLES], *[f'SELECT kpi_id, period, value FROM ({ORACLE[q]})' for q in _OWN.values()]])}),
  a(audience, position, kpi_id) AS (VALUES {_BOARD})
  SELECT kpi_id, period, value, audience, position FROM v JOIN a USING (kpi_id)""")
def _(spark, sf):
    parts = [_wanted(spark, sf, kp.on_boards(), *TABLES), *_over_passes(spark, sf)]
    return kp.audience_dashboard(_six(reduce(DataFrame.unionByName, parts)))
