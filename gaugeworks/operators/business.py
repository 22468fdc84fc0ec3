"""Named business queries over retail, finance and banking tables.

Each takes DataFrames in the engine's models and returns a report. Facts are aggregated on the
join key before the dimension is joined, so the shuffle carries one row per key and task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeworks.functions.text import exact_sum

CANCELLED = "cancelled"


def _live(orders: DataFrame, cancelled: str) -> DataFrame:
    return orders.where(F.col("status") != cancelled)


# retail ------------------------------------------------------------------------------------


def top_products(lines: DataFrame, products: DataFrame, cancelled: str = CANCELLED, n: int = 5) -> DataFrame:
    per_product = _live(lines, cancelled).groupBy("product_id").agg(
        F.sum("quantity").alias("units"), exact_sum(F.col("amount")).alias("revenue")
    )
    return (
        per_product.join(products, F.col("product_id") == products["id"])
        .select("product_id", "name", "category", "units", "revenue")
        .orderBy(F.desc("revenue"), "product_id")
        .limit(n)
    )


def revenue_by_category(lines: DataFrame, products: DataFrame, cancelled: str = CANCELLED) -> DataFrame:
    per_product = _live(lines, cancelled).groupBy("product_id").agg(
        F.sum(F.col("amount").cast("decimal(18,2)")).alias("part"), F.count("*").alias("n")
    )
    return (
        per_product.join(products, F.col("product_id") == products["id"])
        .groupBy("category")
        .agg(F.sum("part").cast("double").alias("revenue"), F.sum("n").alias("orders"))
        .orderBy(F.desc("revenue"), "category")
    )


def orders_by_status(orders: DataFrame) -> DataFrame:
    return (
        orders.groupBy("status")
        .agg(F.count("*").alias("orders"), exact_sum(F.col("amount")).alias("amount"))
        .orderBy(F.desc("orders"), "status")
    )


def low_stock(products: DataFrame, below: int = 25) -> DataFrame:
    return (
        products.where(F.col("stock") < below)
        .select("id", "name", "category", "stock")
        .orderBy("stock", "id")
    )


def top_customers(orders: DataFrame, customers: DataFrame, cancelled: str = CANCELLED, n: int = 5) -> DataFrame:
    per_customer = _live(orders, cancelled).groupBy("customer_id").agg(
        exact_sum(F.col("amount")).alias("spend")
    )
    return (
        per_customer.join(customers, F.col("customer_id") == customers["id"])
        .select("customer_id", "name", "city", "segment", "spend")
        .orderBy(F.desc("spend"), "customer_id")
        .limit(n)
    )


def total_sales(orders: DataFrame, cancelled: str = CANCELLED) -> DataFrame:
    return _live(orders, cancelled).agg(
        exact_sum(F.col("amount")).alias("total_sales"), F.count("*").alias("orders")
    )


# finance -----------------------------------------------------------------------------------


def revenue_by_region(revenue: DataFrame) -> DataFrame:
    return (
        revenue.groupBy("region")
        .agg(exact_sum(F.col("amount")).alias("revenue"))
        .orderBy(F.desc("revenue"), "region")
    )


def revenue_by_month(revenue: DataFrame) -> DataFrame:
    return (
        revenue.groupBy(F.date_format("booked", "yyyy-MM").alias("month"))
        .agg(exact_sum(F.col("amount")).alias("revenue"))
        .orderBy("month")
    )


def top_expenses(expenses: DataFrame, n: int = 6) -> DataFrame:
    return (
        expenses.groupBy("category")
        .agg(exact_sum(F.col("amount"), 4).alias("spend"))
        .orderBy(F.desc("spend"), "category")
        .limit(n)
    )


def profit(revenue: DataFrame, expenses: DataFrame) -> DataFrame:
    """Both totals in one aggregate over the union, so neither side is joined to the other."""
    both = revenue.select(F.col("amount").cast("decimal(18,4)").alias("r"), F.lit(None).cast("decimal(18,4)").alias("e"))
    both = both.unionByName(
        expenses.select(F.lit(None).cast("decimal(18,4)").alias("r"), F.col("amount").cast("decimal(18,4)").alias("e"))
    )
    return both.agg(F.sum("r").alias("r"), F.sum("e").alias("e")).select(
        F.col("r").cast("double").alias("revenue"),
        F.col("e").cast("double").alias("expenses"),
        (F.col("r") - F.col("e")).cast("double").alias("profit"),
    )


def total_revenue(revenue: DataFrame) -> DataFrame:
    by_month = revenue.groupBy(F.date_format("booked", "yyyy-MM").alias("month")).agg(
        F.sum(F.col("amount").cast("decimal(18,2)")).alias("part")
    )
    return by_month.agg(F.sum("part").cast("double").alias("total_revenue"), F.count("*").alias("months"))


# banking -----------------------------------------------------------------------------------

_TRANSFER = ["id", "from_account", "to_account", "amount", "txn_date"]


def flagged_transfers(transfers: DataFrame) -> DataFrame:
    return transfers.where(F.col("flagged") == 1).select(*_TRANSFER).orderBy(F.desc("amount"), "id")


def high_value_transfers(transfers: DataFrame, n: int = 8) -> DataFrame:
    return transfers.select(*_TRANSFER).orderBy(F.desc("amount"), "id").limit(n)


def loans_outstanding(loans: DataFrame) -> DataFrame:
    return (
        loans.groupBy("status")
        .agg(F.count("*").alias("loans"), exact_sum(F.col("principal")).alias("principal"))
        .orderBy(F.desc("principal"), "status")
    )


def kyc_pending(accounts: DataFrame) -> DataFrame:
    return (
        accounts.where(F.col("kyc_status") != "verified")
        .select("id", "customer_name", "type", "kyc_status")
        .orderBy("kyc_status", "id")
    )


def deposits_by_type(accounts: DataFrame) -> DataFrame:
    return (
        accounts.groupBy("type")
        .agg(F.count("*").alias("accounts"), exact_sum(F.col("balance")).alias("total_balance"))
        .orderBy(F.desc("total_balance"), "type")
    )


# presentation ------------------------------------------------------------------------------


def clean_result(df: DataFrame, cap: int = 50) -> DataFrame:
    """Decimals become doubles, doubles are rounded to two places, at most ``cap`` rows are kept."""
    kinds = dict(df.dtypes)
    cols = []
    for c in df.columns:
        col = F.col(c)
        if kinds[c].startswith("decimal"):
            col = col.cast("double")
        if kinds[c] in ("double", "float") or kinds[c].startswith("decimal"):
            col = F.round(col, 2)
        cols.append(col.alias(c))
    return df.select(*cols).limit(cap)


def result_size(df: DataFrame, cap: int = 50) -> DataFrame:
    """One row: how many rows there are, how many are shown, whether the rest is cut."""
    return df.agg(F.count("*").alias("row_count")).select(
        "row_count",
        F.least("row_count", F.lit(cap).cast("long")).alias("shown"),
        (F.col("row_count") > cap).alias("truncated"),
    )
