import re
from datetime import datetime

import duckdb
import pytest
from pyspark.sql import functions as F

from compare import difference
from gaugeworks.functions.kpi_catalog import AUDIENCES, CATALOG
from gaugeworks.operators import kpis as kp
from gaugeworks.plans import kpi_queries  # noqa: F401  registers the queries
from gaugeworks.plans.registry import ORACLE, QUERIES


def test_every_catalog_kpi_has_a_formula():
    assert len(CATALOG) == 58
    assert set(kp.FORMULAS) == {k.id for k in CATALOG}
    assert {f.archetype for f in kp.FORMULAS.values()} == {
        "SUM", "SUM-IF", "COUNT", "AVG", "AVG-OF-SUM", "AVG-DELTA", "GAP", "RATE", "RATIO", "GROWTH", "PERCENTILE",
        "DISTINCT-WINDOW", "FUNNEL", "RETENTION", "NPS", "DERIVED",
    }


def test_boards_list_known_kpis():
    assert len(AUDIENCES) == 7
    assert {k for _, ks in AUDIENCES.values() for k in ks} <= {k.id for k in CATALOG}


def test_trailing_distinct_counts_each_user_once(spark):
    days = [(1, 1), (1, 1), (1, 5), (2, 5), (1, 20), (3, 31)]
    rows = spark.createDataFrame([(u, datetime(2024, 1, d)) for u, d in days], "u long, ts timestamp")
    got = {r["period"]: r["value"] for r in kp.trailing_distinct(rows, "k", "u", "ts", 7).collect()}
    assert got == {"2024-01-01": 1.0, "2024-01-05": 2.0, "2024-01-20": 1.0, "2024-01-31": 1.0}


def test_special_archetypes_are_not_one_expression(spark):
    with pytest.raises(ValueError):
        kp.compute_kpi(spark.range(1), "fin_revenue_growth_yoy")


def test_zero_denominators_give_no_value(spark):
    rows = spark.createDataFrame([(0, 0)], "fraud int, amount int").selectExpr("fraud = 1 AS fraud", "amount")
    assert kp.compute_kpi(rows, "risk_fraud_rate").first()["value"] is None


def test_alerts_and_targets(spark):
    rows = spark.createDataFrame([("ops_error_rate", "1", 0.1), ("ops_error_rate", "2", 0.2), ("ops_uptime", "1", 0.99)], "kpi_id string, period string, value double")
    alerts = {(r["kpi_id"], r["period"]): r["alert"] for r in kp.kpi_alerts(rows).collect()}
    assert alerts == {("ops_error_rate", "1"): False, ("ops_error_rate", "2"): True, ("ops_uptime", "1"): False}
    target = kp.kpi_vs_target(rows).collect()
    assert len(target) == 1 and target[0]["gap"] == pytest.approx(-0.009) and not target[0]["met"]


def test_one_pass_over_several_tables(spark):
    """The tables share column names, and literals look like names."""
    base = spark.createDataFrame([(1, "a", 5), (1, "b", 7), (2, "a", 1)], "p int, s string, v int")
    tables = {
        "x": ([F.col("s").alias("status"), F.col("v").alias("amount")], {"k1": "sum(amount) filter (where status = 'amount')", "k2": "double(sum(amount))"}),
        "y": ([F.when(F.col("s") == "a", "amount").otherwise("no").alias("status"), "v"], {"k3": "sum(v) filter (where status = 'amount')"}),
    }
    got = {(r.kpi_id, r.period): r.value for r in kp.compute_boards(base, tables, F.col("p")).collect()}
    assert got == {("k1", 1): None, ("k1", 2): None, ("k2", 1): 12.0, ("k2", 2): 1.0, ("k3", 1): 5.0, ("k3", 2): 1.0}


@pytest.mark.parametrize("name,facts", [("audience_dashboard", ["lineitem"]), ("kpi_vs_target", ["lineitem", "events"])])
def test_boards_scan_each_fact_once(spark, capsys, name, facts):
    QUERIES[name](spark, "/root/testdata/sf0.001").explain("formatted")
    plan = capsys.readouterr().out
    for fact in facts:
        assert len(re.findall(rf"Location: .*/{fact}\.parquet", plan)) == 1


@pytest.mark.parametrize("table,kpi_id,later,unit", [
    ("deploy", "prod_lead_time_changes", "deploy_time", 3600), ("ticket", "cust_resolution_time", "resolved_at", 3600),
    ("ticket", "cust_first_response_time", "first_response", 60), ("request", "ops_mttr", "resolved_at", 60),
])
def test_spans_whose_sum_passes_a_long(spark, table, kpi_id, later, unit):
    """Forty spans of 8,000 years are more microseconds than a long number holds."""
    rows = spark.range(40).selectExpr("timestamp'1000-01-01' AS ts", f"timestamp'9000-01-01' AS {later}", "1 AS p")
    days = (datetime(9000, 1, 1) - datetime(1000, 1, 1)).days
    assert kp.compute_kpi(rows, kpi_id).first()["value"] == pytest.approx(days * 86400 / unit)
    board = kp.compute_boards(rows, {table: (["ts", later], {kpi_id: kp.FORMULAS[kpi_id].expr})}, F.col("p"))
    assert board.first()["value"] == pytest.approx(days * 86400 / unit)


def test_dashboard_has_every_kpi_of_every_board(spark):
    rows = QUERIES["audience_dashboard"](spark, "/root/testdata/sf0.001").where("value IS NOT NULL").collect()
    got = {(r.audience, r.position, r.kpi_id) for r in rows}
    assert got == {(name, i + 1, k) for name, ks in AUDIENCES.values() for i, k in enumerate(ks)}


@pytest.fixture
def orders_without_customers(spark, tmp_path):
    """Two orders without a customer, one of them the only one of its year."""
    orders = [(1, 7, "F", 90.0, "1995-02-03", "1-URGENT"), (2, None, "O", 50.0, "1995-03-04", "5-LOW"), (3, None, "F", 70.0, "1996-05-06", "1-URGENT"), (4, 8, "P", 20.0, "1997-01-01", "2-HIGH")]
    lines = [(o, n, 10.0 * n + o, 100.0 * o + n, 0.05, 0.06, "RAN"[n - 1], "OF"[n % 2], "1997-07-08") for o in (1, 2, 3, 4) for n in (1, 2, 3)]
    kept = {"orders": (orders, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate string, o_orderpriority string"),
            "lineitem": (lines, "l_orderkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate string")}
    for name, (rows, schema) in kept.items():
        df = spark.createDataFrame(rows, schema)
        df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in df.columns if c.endswith("date")}).coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
    events = [(i, f"2024-01-{1 + i % 5:02d} 0{i % 7}:00:00", i % 3, ["view", "click", "signup", "purchase", "error"][i % 5], 1.5 * i, '{"k": %d}' % i) for i in range(40)]
    df = spark.createDataFrame(events, "event_id long, ts string, user_id long, event_type string, value double, props string")
    df.withColumn("ts", F.col("ts").cast("timestamp_ntz")).coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    return tmp_path


def test_boards_keep_orders_without_a_customer(spark, orders_without_customers):
    """All tables but the ledger have their lines, and a year without customers has no ledger."""
    at = str(orders_without_customers)
    rows = QUERIES["audience_dashboard"](spark, at).where("kpi_id NOT IN ('hr_attrition_rate', 'hr_voluntary_attrition')")
    got = {(r.kpi_id, r.period): r.value for r in rows.collect()}
    assert got["risk_fraud_rate", "1995"] == pytest.approx(302 / 912, abs=1e-6) and got["risk_security_incidents", "1996"] == 3
    assert ("fin_gross_margin", "1996") not in got and got["fin_revenue_total", "1995"] == 306
    con = duckdb.connect()
    for name in ("orders", "lineitem", "events"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{at}/{name}.parquet/*.parquet'")
    sql = f"SELECT * FROM ({ORACLE['audience_dashboard']}) WHERE kpi_id NOT IN ('hr_attrition_rate', 'hr_voluntary_attrition')"
    assert difference(rows, con, sql) is None


def test_rows_of_one_table_only(spark):
    base = spark.createDataFrame([(1, 5, True), (1, 7, None), (2, 9, None)], "p int, v int, mine boolean")
    exprs = {"k_sum": "sum(v)", "k_share": "try_divide(count_if(v > 0), count(*))"}
    tables = {"x": (["v"], exprs), "y": (["v"], {"k_all": "sum(v)"})}
    got = {(r.kpi_id, r.period): r.value for r in kp.compute_boards(base, tables, F.col("p"), {"x": F.col("mine")}).collect()}
    assert got == {("k_sum", 1): 5.0, ("k_share", 1): 1.0, ("k_all", 1): 12.0, ("k_all", 2): 9.0}
