"""Retail, finance and banking queries, and the rollups, on the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from gaugeworks.operators import business as ops
from gaugeworks.operators import rollups as roll
from gaugeworks.plans import bindings as b
from gaugeworks.plans.registry import query
from gaugeworks.session import checkpoint_root
from gaugeworks.sources.store import path_exists

SKIP = "P"  # the order status that stands for cancelled

LINES = """lines AS (SELECT l_partkey AS product_id, l_quantity AS quantity,
  CAST(l_extendedprice AS DECIMAL(18,2)) AS amount, o_orderstatus AS status
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""
SALES = """sales AS (SELECT o_orderdate AS sale_date, o_custkey AS store_id, l_partkey AS sku,
  CAST(l_quantity AS BIGINT) AS units, CAST(l_extendedprice AS DECIMAL(18,4)) AS gross_revenue,
  CAST(l_extendedprice * l_discount AS DECIMAL(18,4)) AS discount_amt,
  CAST(l_extendedprice AS DECIMAL(18,4)) - CAST(l_extendedprice * l_discount AS DECIMAL(18,4)) AS net_revenue
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""
STORES = """stores AS (SELECT c_custkey AS store_id, r_name AS region FROM customer
  JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""
REV = f"""{STORES}, revenue AS (SELECT o_orderdate AS booked, region, CAST(o_totalprice AS DECIMAL(18,2)) AS amount
  FROM orders JOIN stores ON o_custkey = store_id)"""
EXP = "expenses AS (SELECT l_returnflag AS category, CAST(l_extendedprice * l_tax AS DECIMAL(18,4)) AS amount FROM lineitem)"
ACC = """accounts AS (SELECT c_custkey AS id, c_name AS customer_name, c_mktsegment AS type, c_acctbal AS balance,
  CASE WHEN c_acctbal >= 0 THEN 'verified' WHEN c_acctbal < -500 THEN 'review' ELSE 'pending' END AS kyc_status FROM customer)"""
TRA = """transfers AS (SELECT event_id AS id, user_id AS from_account,
  CAST(json_extract_string(props, '$.k') AS BIGINT) AS to_account, value AS amount, ts AS txn_date,
  CAST(event_type = 'error' AS INTEGER) AS flagged FROM events)"""
AT = "strftime(txn_date, '%Y-%m-%d %H:%M:%S.%f') AS txn_date"
LOA = """loans AS (SELECT s_suppkey AS id, s_acctbal AS principal,
  CASE WHEN s_acctbal < 0 THEN 'delinquent' WHEN s_acctbal < 5000 THEN 'current' ELSE 'watch' END AS status FROM supplier)"""


@query("retail_top_products", f"""WITH {LINES} SELECT product_id, p_name AS name, p_type AS category,
  SUM(quantity) AS units, CAST(SUM(amount) AS DOUBLE) AS revenue FROM lines JOIN part ON product_id = p_partkey
  WHERE status <> '{SKIP}' GROUP BY 1, 2, 3 ORDER BY revenue DESC, product_id LIMIT 5""")
def _(spark, sf):
    return ops.top_products(b.retail_lines(spark, sf), b.products(spark, sf), SKIP)


@query("retail_revenue_by_category", f"""WITH {LINES} SELECT p_type AS category, CAST(SUM(amount) AS DOUBLE) AS revenue,
  COUNT(*) AS orders FROM lines JOIN part ON product_id = p_partkey WHERE status <> '{SKIP}' GROUP BY 1""")
def _(spark, sf):
    return ops.revenue_by_category(b.retail_lines(spark, sf), b.products(spark, sf), SKIP)


@query("retail_orders_by_status", """SELECT o_orderstatus AS status, COUNT(*) AS orders,
  CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS amount FROM orders GROUP BY 1""")
def _(spark, sf):
    return ops.orders_by_status(b.retail_orders(spark, sf))


@query("retail_low_stock", """SELECT p_partkey AS id, p_name AS name, p_type AS category, p_size AS stock
  FROM part WHERE p_size < 25 ORDER BY stock, id""")
def _(spark, sf):
    return ops.low_stock(b.products(spark, sf))


@query("retail_top_customers", f"""SELECT c_custkey AS customer_id, c_name AS name, n_name AS city, c_mktsegment AS segment,
  CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS spend FROM orders JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey WHERE o_orderstatus <> '{SKIP}' GROUP BY 1, 2, 3, 4
  ORDER BY spend DESC, customer_id LIMIT 5""")
def _(spark, sf):
    return ops.top_customers(b.retail_orders(spark, sf), b.customers(spark, sf), SKIP)


@query("retail_total_sales", f"""SELECT CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total_sales,
  COUNT(*) AS orders FROM orders WHERE o_orderstatus <> '{SKIP}'""")
def _(spark, sf):
    return ops.total_sales(b.retail_orders(spark, sf), SKIP)


@query("finance_revenue_by_region", f"""WITH {REV} SELECT region, CAST(SUM(amount) AS DOUBLE) AS revenue FROM revenue GROUP BY 1""")
def _(spark, sf):
    return ops.revenue_by_region(b.revenue(spark, sf))


@query("finance_revenue_by_month", f"""WITH {REV} SELECT strftime(booked, '%Y-%m') AS month,
  CAST(SUM(amount) AS DOUBLE) AS revenue FROM revenue GROUP BY 1""")
def _(spark, sf):
    return ops.revenue_by_month(b.revenue(spark, sf))


@query("finance_top_expenses", f"""WITH {EXP} SELECT category, CAST(SUM(amount) AS DOUBLE) AS spend FROM expenses
  GROUP BY 1 ORDER BY spend DESC, category LIMIT 6""")
def _(spark, sf):
    return ops.top_expenses(b.expenses(spark, sf))


@query("finance_profit", f"""WITH {REV}, {EXP}, r AS (SELECT SUM(CAST(amount AS DECIMAL(18,4))) AS v FROM revenue),
  e AS (SELECT SUM(amount) AS v FROM expenses) SELECT CAST(r.v AS DOUBLE) AS revenue, CAST(e.v AS DOUBLE) AS expenses,
  CAST(r.v - e.v AS DOUBLE) AS profit FROM r, e""")
def _(spark, sf):
    return ops.profit(b.revenue(spark, sf), b.expenses(spark, sf))


@query("finance_total_revenue", f"""WITH {REV} SELECT CAST(SUM(amount) AS DOUBLE) AS total_revenue,
  COUNT(DISTINCT strftime(booked, '%Y-%m')) AS months FROM revenue""")
def _(spark, sf):
    return ops.total_revenue(b.revenue(spark, sf))


@query("banking_flagged_transfers", f"""WITH {TRA} SELECT id, from_account, to_account, amount, {AT} FROM transfers
  WHERE flagged = 1""")
def _(spark, sf):
    return b.time_text(ops.flagged_transfers(b.transfers(spark, sf)), "txn_date")


@query("banking_high_value_transfers", f"""WITH {TRA} SELECT id, from_account, to_account, amount, {AT} FROM transfers
  ORDER BY amount DESC, id LIMIT 8""")
def _(spark, sf):
    return b.time_text(ops.high_value_transfers(b.transfers(spark, sf)), "txn_date")


@query("banking_loans_outstanding", f"""WITH {LOA} SELECT status, COUNT(*) AS loans,
  CAST(SUM(CAST(principal AS DECIMAL(18,2))) AS DOUBLE) AS principal FROM loans GROUP BY 1""")
def _(spark, sf):
    return ops.loans_outstanding(b.loans(spark, sf))


@query("banking_kyc_pending", f"""WITH {ACC} SELECT id, customer_name, type, kyc_status FROM accounts
  WHERE kyc_status <> 'verified'""")
def _(spark, sf):
    return ops.kyc_pending(b.accounts(spark, sf))


@query("banking_deposits_by_type", f"""WITH {ACC} SELECT type, COUNT(*) AS accounts,
  CAST(SUM(CAST(balance AS DECIMAL(18,2))) AS DOUBLE) AS total_balance FROM accounts GROUP BY 1""")
def _(spark, sf):
    return ops.deposits_by_type(b.accounts(spark, sf))


@query("clean_result", f"""WITH {TRA} SELECT id, from_account, to_account, ROUND(amount, 2) AS amount, {AT}
  FROM transfers WHERE flagged = 1 ORDER BY transfers.amount DESC, id LIMIT 50""")
def _(spark, sf):
    return b.time_text(ops.clean_result(ops.flagged_transfers(b.transfers(spark, sf)), 50), "txn_date")


@query("result_size", f"""WITH {TRA} SELECT COUNT(*) AS row_count, LEAST(COUNT(*), 50) AS shown, COUNT(*) > 50 AS truncated
  FROM transfers WHERE flagged = 1""")
def _(spark, sf):
    return ops.result_size(ops.flagged_transfers(b.transfers(spark, sf)), 50)


# rollups -----------------------------------------------------------------------------------

_AGG = "CAST(SUM(net_revenue) AS DOUBLE) AS revenue, CAST(SUM(units) AS BIGINT) AS units"
META = f"SELECT COUNT(*) AS rows, {_AGG} FROM sales"
MONTHLY = f"SELECT strftime(sale_date, '%Y-%m') AS month, {_AGG} FROM sales GROUP BY 1"
REGION = f"SELECT region, {_AGG} FROM sales JOIN stores USING (store_id) GROUP BY 1"
CATEGORY = f"SELECT p_type AS category, {_AGG} FROM sales JOIN part ON sku = p_partkey GROUP BY 1"
SKU = f"SELECT sku, p_name AS name, {_AGG} FROM sales JOIN part ON sku = p_partkey GROUP BY 1, 2"


@query("rollup_meta", f"WITH {SALES} {META}")
def _(spark, sf):
    return roll.rollup_meta(b.sales(spark, sf))


@query("rollup_monthly", f"WITH {SALES} {MONTHLY}")
def _(spark, sf):
    return roll.rollup_monthly(b.sales(spark, sf))


@query("rollup_region", f"WITH {SALES}, {STORES} {REGION}")
def _(spark, sf):
    return roll.rollup_region(b.sales(spark, sf), b.stores(spark, sf))


@query("rollup_category", f"WITH {SALES} {CATEGORY}")
def _(spark, sf):
    return roll.rollup_category(b.sales(spark, sf), b.sku_dimension(spark, sf))


@query("rollup_sku", f"WITH {SALES} {SKU}")
def _(spark, sf):
    return roll.rollup_sku(b.sales(spark, sf), b.sku_dimension(spark, sf))


def rollup_folder(spark, sf) -> str:
    """Rollups of one data folder, built once per application."""
    name = "".join(ch if ch.isalnum() else "_" for ch in str(sf))
    return f"{checkpoint_root(spark)}/{spark.sparkContext.applicationId}/rollups{name}"


def prepared_rollups(spark, sf, force: bool = False):
    root = rollup_folder(spark, sf)
    built = roll.ensure_rollups(
        b.sales(spark, sf), b.stores(spark, sf), b.sku_dimension(spark, sf), root, force
    )
    return roll.read_rollups(spark, root), built


@query("ensure_rollups", f"""WITH {SALES}, {STORES} SELECT 'meta' AS rollup, 1 AS rows FROM sales HAVING COUNT(*) > 0
  UNION ALL SELECT 'monthly', COUNT(*) FROM ({MONTHLY}) UNION ALL SELECT 'region', COUNT(*) FROM ({REGION})
  UNION ALL SELECT 'category', COUNT(*) FROM ({CATEGORY}) UNION ALL SELECT 'sku', COUNT(*) FROM ({SKU})""")
def _(spark, sf):
    frames, _built = prepared_rollups(spark, sf, force=True)
    parts = [df.agg(F.count("*").alias("rows")).select(F.lit(n).alias("rollup"), "rows") for n, df in frames.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _ranked(section: str, label: str, sql: str, limit: str = "") -> str:
    return f"""SELECT '{section}' AS section, ROW_NUMBER() OVER (ORDER BY revenue DESC, {label}) AS rank,
  CAST({label} AS VARCHAR) AS name, ROUND(revenue, 2) AS revenue, units FROM ({sql}) {limit}"""


_SUMMARY = f"""WITH {SALES}, {STORES}, m AS ({META})
  SELECT 'total' AS section, 1 AS rank, 'total' AS name, ROUND(revenue, 2) AS revenue, units FROM m
  UNION ALL SELECT 'rows', 1, 'rows', NULL, rows FROM m
  UNION ALL SELECT 'stores', 1, 'stores', NULL, COUNT(*) FROM stores
  UNION ALL SELECT 'skus', 1, 'skus', NULL, COUNT(*) FROM part
  UNION ALL {_ranked('region', 'region', REGION)}
  UNION ALL {_ranked('category', 'category', CATEGORY)}
  UNION ALL SELECT * FROM ({_ranked('sku', 'sku', SKU)}) WHERE rank <= 10"""


@query("retail_summary", _SUMMARY)
def _(spark, sf):
    frames, _built = prepared_rollups(spark, sf)
    return roll.retail_summary(frames, b.stores(spark, sf), b.sku_dimension(spark, sf))


@query("retail_dashboard", _SUMMARY)
def _(spark, sf):
    """The dashboard as stored by the last rollup build; the first call of an application builds it."""
    root = rollup_folder(spark, sf)
    if not path_exists(spark, f"{root}/summary/_SUCCESS"):
        prepared_rollups(spark, sf)
    return roll.read_dashboard(spark, root)


@query("retail_summary_raw", _SUMMARY)
def _(spark, sf):
    """The same dashboard by a scan of the fact, without stored rollups."""
    stores, products = b.stores(spark, sf), b.sku_dimension(spark, sf)
    return roll.retail_summary(roll.build_rollups(b.sales(spark, sf), stores, products), stores, products)


@query("monthly_series", f"WITH {SALES} SELECT month, ROUND(revenue, 2) AS value FROM ({MONTHLY})")
def _(spark, sf):
    return roll.monthly_series(roll.rollup_monthly(b.sales(spark, sf)), "revenue")


@query("monthly_series_units", f"WITH {SALES} SELECT month, CAST(units AS DOUBLE) AS value FROM ({MONTHLY})")
def _(spark, sf):
    return roll.monthly_series(roll.rollup_monthly(b.sales(spark, sf)), "units")


@query("check_invariants", f"""WITH {SALES} SELECT 'units_below_one' AS rule, COUNT(*) FILTER (units < 1) AS violations, COUNT(*) AS rows FROM sales
  UNION ALL SELECT 'negative_net', COUNT(*) FILTER (net_revenue < 0), COUNT(*) FROM sales
  UNION ALL SELECT 'net_is_not_gross_less_discount',
  COUNT(*) FILTER (ABS(net_revenue - (gross_revenue - discount_amt)) > 0.02), COUNT(*) FROM sales""")
def _(spark, sf):
    return roll.check_invariants(b.sales(spark, sf), roll.sales_rules())


@query("check_join_total", f"""WITH {SALES}, {STORES} SELECT
  (SELECT CAST(SUM(net_revenue) AS DOUBLE) FROM sales) AS fact_total,
  (SELECT CAST(SUM(net_revenue) AS DOUBLE) FROM sales JOIN stores USING (store_id)) AS joined_total,
  (SELECT COUNT(*) FROM sales WHERE store_id NOT IN (SELECT store_id FROM stores)) AS orphan_rows,
  (SELECT COUNT(*) FROM sales JOIN stores USING (store_id)) - (SELECT COUNT(*) FROM sales WHERE store_id IN (SELECT store_id FROM stores)) AS fan_out_rows""")
def _(spark, sf):
    return roll.check_join_total(b.sales(spark, sf), b.stores(spark, sf), "store_id", "net_revenue")


@query("seasonality_ratio", f"""WITH {SALES}, m AS (SELECT strftime(sale_date, '%m') AS mm, CAST(SUM(net_revenue) AS DECIMAL(28,4)) AS r
  FROM sales GROUP BY strftime(sale_date, '%Y-%m'), 1),
  t AS (SELECT CAST(SUM(r) FILTER (mm IN ('11', '12')) AS DOUBLE) / COUNT(*) FILTER (mm IN ('11', '12')) AS high_mean,
  CAST(SUM(r) FILTER (mm IN ('01', '02')) AS DOUBLE) / COUNT(*) FILTER (mm IN ('01', '02')) AS low_mean FROM m)
  SELECT ROUND(high_mean, 4) AS high_mean, ROUND(low_mean, 4) AS low_mean, ROUND(high_mean / low_mean, 8) AS ratio FROM t""")
def _(spark, sf):
    out = roll.seasonality_ratio(roll.rollup_monthly(b.sales(spark, sf)))
    return out.select(F.round("high_mean", 4).alias("high_mean"), F.round("low_mean", 4).alias("low_mean"), F.round("ratio", 8).alias("ratio"))


@query("date_range", "SELECT strftime(MIN(o_orderdate), '%Y-%m-%d') AS first, strftime(MAX(o_orderdate), '%Y-%m-%d') AS last FROM orders")
def _(spark, sf):
    out = roll.date_range(b.retail_orders(spark, sf), "order_date")
    return out.select(F.col("first").cast("string").alias("first"), F.col("last").cast("string").alias("last"))
