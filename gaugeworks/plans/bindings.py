"""Binds the test tables to the engine's models (retail, finance, banking, series, documents)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeworks.functions.ordering import join_in_parts
from gaugeworks.functions.text import exact_sum
from gaugeworks.session import prepare


_schemas: dict[tuple[str, str], object] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A test table; its schema is read from the file footer once per application."""
    path = f"{sf_dir}/{name}.parquet"
    known = (prepare(spark).sparkContext.applicationId, path)
    if known not in _schemas:
        _schemas[known] = spark.read.parquet(path).schema
    return spark.read.schema(_schemas[known]).parquet(path)


def retail_orders(spark, sf) -> DataFrame:
    """Order headers: id, customer_id, amount, status, order_date."""
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.col("o_custkey").alias("customer_id"),
        F.col("o_totalprice").alias("amount"),
        F.col("o_orderstatus").alias("status"),
        F.col("o_orderdate").alias("order_date"),
    )


def retail_lines(spark, sf) -> DataFrame:
    """Order lines with the status of their order: product_id, quantity, amount, status."""
    lines = table(spark, sf, "lineitem").select(
        "l_orderkey",
        F.col("l_partkey").alias("product_id"),
        F.col("l_quantity").alias("quantity"),
        F.col("l_extendedprice").alias("amount"),
    )
    orders = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderstatus").alias("status")
    )
    return lines.join(orders, "l_orderkey").drop("l_orderkey")


def products(spark, sf) -> DataFrame:
    return table(spark, sf, "part").select(
        F.col("p_partkey").alias("id"),
        F.col("p_name").alias("name"),
        F.col("p_type").alias("category"),
        F.col("p_retailprice").alias("price"),
        F.col("p_size").alias("stock"),
    )


def customers(spark, sf) -> DataFrame:
    cust, nation = table(spark, sf, "customer"), table(spark, sf, "nation")
    return cust.join(nation, cust.c_nationkey == nation.n_nationkey).select(
        F.col("c_custkey").alias("id"),
        F.col("c_name").alias("name"),
        F.col("n_name").alias("city"),
        F.col("c_mktsegment").alias("segment"),
    )


def sales(spark, sf) -> DataFrame:
    """Sales fact: sale_date, store_id, sku, units, gross, discount and net revenue."""
    lines = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_partkey", "l_quantity", "l_extendedprice", "l_discount"
    )
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    off = F.col("l_extendedprice") * F.col("l_discount")
    return join_in_parts(lines, orders, "l_orderkey", "o_orderkey").select(
        F.col("o_orderdate").alias("sale_date"),
        F.col("o_custkey").alias("store_id"),
        F.col("l_partkey").alias("sku"),
        F.col("l_quantity").cast("long").alias("units"),
        F.col("l_extendedprice").cast("decimal(18,4)").alias("gross_revenue"),
        off.cast("decimal(18,4)").alias("discount_amt"),
        (F.col("l_extendedprice").cast("decimal(18,4)") - off.cast("decimal(18,4)"))
        .cast("decimal(18,4)")
        .alias("net_revenue"),
    )


def stores(spark, sf) -> DataFrame:
    cust, nation, region = (table(spark, sf, t) for t in ("customer", "nation", "region"))
    return (
        cust.join(nation, cust.c_nationkey == nation.n_nationkey)
        .join(region, F.col("n_regionkey") == F.col("r_regionkey"))
        .select(F.col("c_custkey").alias("store_id"), F.col("r_name").alias("region"))
    )


def sku_dimension(spark, sf) -> DataFrame:
    return table(spark, sf, "part").select(
        F.col("p_partkey").alias("sku"), F.col("p_name").alias("product_name"), F.col("p_type").alias("category")
    )


def revenue(spark, sf) -> DataFrame:
    """Finance revenue: order_date, region, amount."""
    orders = table(spark, sf, "orders").select("o_custkey", "o_orderdate", "o_totalprice")
    return orders.join(stores(spark, sf), F.col("o_custkey") == F.col("store_id")).select(
        F.col("o_orderdate").alias("booked"), "region", F.col("o_totalprice").alias("amount")
    )


def expenses(spark, sf) -> DataFrame:
    return table(spark, sf, "lineitem").select(
        F.col("l_returnflag").alias("category"),
        (F.col("l_extendedprice") * F.col("l_tax")).cast("decimal(18,4)").alias("amount"),
    )


def accounts(spark, sf) -> DataFrame:
    """kyc_status: 'verified' for a positive balance, 'pending' below 0, 'review' below -500."""
    bal = F.col("c_acctbal")
    return table(spark, sf, "customer").select(
        F.col("c_custkey").alias("id"),
        F.col("c_name").alias("customer_name"),
        F.col("c_mktsegment").alias("type"),
        bal.alias("balance"),
        F.when(bal >= 0, "verified").when(bal < -500, "review").otherwise("pending").alias("kyc_status"),
    )


def transfers(spark, sf) -> DataFrame:
    return table(spark, sf, "events").select(
        F.col("event_id").alias("id"),
        F.col("user_id").alias("from_account"),
        F.get_json_object("props", "$.k").cast("long").alias("to_account"),
        F.col("value").alias("amount"),
        F.col("ts").alias("txn_date"),
        (F.col("event_type") == "error").cast("int").alias("flagged"),
    )


def loans(spark, sf) -> DataFrame:
    bal = F.col("s_acctbal")
    return table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("id"),
        F.col("s_name").alias("customer_name"),
        bal.alias("principal"),
        F.when(bal < 0, "delinquent").when(bal < 5000, "current").otherwise("watch").alias("status"),
    )


def documents(spark, sf) -> DataFrame:
    """Events as documents: the JSON text of ``props`` is parsed into the field ``k``."""
    return table(spark, sf, "events").select(
        "event_id", "ts", "user_id", "event_type", "value", F.from_json("props", "k INT")["k"].alias("k")
    )


def daily_series(spark, sf) -> DataFrame:
    """Daily revenue per order priority: kpi_id, timestamp, value. At most one row per day and key."""
    return (
        table(spark, sf, "orders")
        .groupBy(F.col("o_orderpriority").alias("kpi_id"), F.col("o_orderdate").cast("date").alias("day"))
        .agg(exact_sum(F.col("o_totalprice")).alias("value"))
        .select("kpi_id", F.col("day").cast("timestamp").alias("timestamp"), "value")
    )


def monthly_revenue(spark, sf) -> DataFrame:
    """Monthly revenue per order priority: kpi_id, timestamp, value."""
    month = F.trunc(F.col("o_orderdate").cast("date"), "month")
    return (
        table(spark, sf, "orders")
        .groupBy(F.col("o_orderpriority").alias("kpi_id"), month.alias("day"))
        .agg(exact_sum(F.col("o_totalprice")).alias("value"))
        .select("kpi_id", F.col("day").cast("timestamp").alias("timestamp"), "value")
    )


def time_text(df: DataFrame, *columns: str) -> DataFrame:
    """Event times as text with microseconds, so that reports compare the same on any engine."""
    return df.withColumns({c: F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS") for c in columns})


def day_text(df: DataFrame, column: str = "timestamp", name: str = "day") -> DataFrame:
    """The series timestamp as a day, in place of the timestamp."""
    return df.select(*[F.date_format(c, "yyyy-MM-dd").alias(name) if c == column else F.col(c) for c in df.columns])


def rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


def patients(spark, sf) -> DataFrame:
    """Events as patient documents: name, age, department, diagnosis, status, cost."""
    k = F.from_json("props", "k INT")["k"]
    return table(spark, sf, "events").select(
        F.concat(F.lit("p"), F.col("event_id")).alias("name"),
        k.alias("age"),
        F.col("event_type").alias("department"),
        F.concat(F.lit("d"), F.col("user_id") % 7).alias("diagnosis"),
        F.when(k % 3 == 0, "admitted").otherwise("discharged").alias("status"),
        F.col("value").alias("cost"),
    )


def user_questions(spark, sf) -> DataFrame:
    """Conversation turns of users as questions: conv_id, turn, text."""
    return table(spark, sf, "conversations").where(F.col("role") == "user").select("conv_id", "turn", "text")
