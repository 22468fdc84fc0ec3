"""Rollup tables over a sales fact, the dashboard that reads them, and fact checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gaugeworks.session import stage
from gaugeworks.sources.store import path_exists

ROLLUPS = ("meta", "monthly", "region", "category", "sku")
SUMMARY = "section string, rank int, name string, revenue double, units long"


def month_of(date: Column) -> Column:
    return F.date_format(date, "yyyy-MM")


def rollup_meta(sales: DataFrame) -> DataFrame:
    return sales.agg(
        F.count("*").alias("rows"),
        F.sum("net_revenue").cast("double").alias("revenue"),
        F.sum("units").alias("units"),
    )


def _sum_by(df: DataFrame, *by) -> DataFrame:
    return df.groupBy(*by).agg(
        F.sum("net_revenue").cast("double").alias("revenue"), F.sum("units").alias("units")
    )


def rollup_monthly(sales: DataFrame) -> DataFrame:
    return _sum_by(sales, month_of(F.col("sale_date")).alias("month"))


def _per_key(sales: DataFrame, key: str) -> DataFrame:
    return sales.groupBy(key).agg(F.sum("net_revenue").alias("net_revenue"), F.sum("units").alias("units"))


def rollup_region(sales: DataFrame, stores: DataFrame) -> DataFrame:
    return _sum_by(_per_key(sales, "store_id").join(stores, "store_id"), "region")


def rollup_category(sales: DataFrame, products: DataFrame) -> DataFrame:
    return _sum_by(_per_key(sales, "sku").join(products, "sku"), "category")


def rollup_sku(sales: DataFrame, products: DataFrame) -> DataFrame:
    return _per_key(sales, "sku").join(products.select("sku", "product_name"), "sku").select(
        "sku",
        F.col("product_name").alias("name"),
        F.col("net_revenue").cast("double").alias("revenue"),
        "units",
    )


def build_rollups(sales: DataFrame, stores: DataFrame, products: DataFrame) -> dict[str, DataFrame]:
    """All five rollups from one scan of the fact.

    Grouping sets by month, store and sku leave one row per month, store and sku; that small table
    is written once, and the dimensions are joined to it instead of to the fact.
    """
    base = sales.select(
        month_of(F.col("sale_date")).alias("month"), "store_id", "sku", "net_revenue", "units"
    )
    sets = base.groupingSets(
        [[F.col("month")], [F.col("store_id")], [F.col("sku")]], F.col("month"), F.col("store_id"), F.col("sku")
    ).agg(
        F.grouping_id().alias("part"),
        F.sum("net_revenue").alias("net_revenue"),
        F.sum("units").alias("units"),
        F.count("*").alias("rows"),
    )
    part = stage(sets)
    # grouping_id has one bit per column, set where the column is rolled away
    months, shops, skus = (part.where(F.col("part") == p) for p in (0b011, 0b101, 0b110))
    return {
        "meta": months.agg(
            F.sum("rows").alias("rows"),
            F.sum("net_revenue").cast("double").alias("revenue"),
            F.sum("units").alias("units"),
        ),
        "monthly": months.select("month", F.col("net_revenue").cast("double").alias("revenue"), "units"),
        "region": _sum_by(shops.select("store_id", "net_revenue", "units").join(stores, "store_id"), "region"),
        "category": _sum_by(skus.select("sku", "net_revenue", "units").join(products, "sku"), "category"),
        "sku": skus.select("sku", "net_revenue", "units")
        .join(products, "sku")
        .select("sku", F.col("product_name").alias("name"), F.col("net_revenue").cast("double").alias("revenue"), "units"),
    }


def ensure_rollups(
    sales: DataFrame, stores: DataFrame, products: DataFrame, root: str, force: bool = False
) -> list[str]:
    """Write each rollup that is missing below ``root`` (all of them with ``force``); returns those built."""
    spark = sales.sparkSession
    todo = [r for r in (*ROLLUPS, "summary") if force or not path_exists(spark, f"{root}/{r}/_SUCCESS")]
    if set(todo) - {"summary"}:
        frames = build_rollups(sales, stores, products)
        for r in todo:
            if r != "summary":
                frames[r].write.mode("overwrite").parquet(f"{root}/{r}")
    if todo:  # the dashboard itself, from the rollups just written
        summary = retail_summary(read_rollups(spark, root), stores, products)
        summary.coalesce(1).write.mode("overwrite").parquet(f"{root}/summary")
    return todo


def read_dashboard(spark: SparkSession, root: str) -> DataFrame:
    """The prebuilt dashboard: one scan of a few dozen rows, no schema inference."""
    return spark.read.schema(SUMMARY).parquet(f"{root}/summary")


def read_rollups(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    return {r: spark.read.parquet(f"{root}/{r}") for r in ROLLUPS}


def retail_summary(
    rollups: dict[str, DataFrame], stores: DataFrame, products: DataFrame, top: int = 10
) -> DataFrame:
    """The dashboard as one long table: section, rank, name, revenue, units."""

    def section(name: str, df: DataFrame, label: Column, n: int | None = None) -> DataFrame:
        best = df.select(label.cast("string").alias("name"), "revenue", "units", label.alias("__id"))
        best = best.orderBy(F.desc("revenue"), "__id")
        if n:
            best = best.limit(n)
        # region and category rollups hold one row per group, the sku section is already cut to top n
        w = Window.orderBy(F.desc("revenue"), "__id")
        return best.select(
            F.lit(name).alias("section"), F.row_number().over(w).alias("rank"), "name",
            F.round("revenue", 2).alias("revenue"), F.col("units").cast("long").alias("units"),
        )

    def single(name: str, df: DataFrame, units: Column, revenue: Column) -> DataFrame:
        return df.select(
            F.lit(name).alias("section"), F.lit(1).alias("rank"), F.lit(name).alias("name"),
            F.round(revenue, 2).alias("revenue"), units.cast("long").alias("units"),
        )

    none = F.lit(None).cast("double")
    parts = [
        single("total", rollups["meta"], F.col("units"), F.col("revenue")),
        single("rows", rollups["meta"], F.col("rows"), none),
        single("stores", stores.agg(F.count("*").alias("n")), F.col("n"), none),
        single("skus", products.agg(F.count("*").alias("n")), F.col("n"), none),
        section("region", rollups["region"], F.col("region")),
        section("category", rollups["category"], F.col("category")),
        section("sku", rollups["sku"], F.col("sku"), top),
    ]
    return reduce(DataFrame.unionByName, parts)


def monthly_series(monthly: DataFrame, metric: str = "revenue") -> DataFrame:
    """(month, value) ascending; any metric but 'revenue' means units."""
    value = F.round("revenue", 2) if metric == "revenue" else F.col("units").cast("double")
    return monthly.select("month", value.alias("value")).orderBy("month")


def check_invariants(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """(rule, violations, rows) for all rules in one pass."""
    counts = df.agg(
        F.count("*").alias("rows"), *[F.count_if(cond).alias(f"v{i}") for i, cond in enumerate(rules.values())]
    )
    pairs = [F.struct(F.lit(r).alias("rule"), F.col(f"v{i}").alias("violations")) for i, r in enumerate(rules)]
    return counts.select("rows", F.inline(F.array(*pairs))).select("rule", "violations", "rows")


def sales_rules() -> dict[str, Column]:
    net, gross, off = F.col("net_revenue"), F.col("gross_revenue"), F.col("discount_amt")
    return {
        "units_below_one": F.col("units") < 1,
        "negative_net": net < 0,
        "net_is_not_gross_less_discount": F.abs(net - (gross - off)) > 0.02,
    }


def check_join_total(fact: DataFrame, dim: DataFrame, key: str, value: str) -> DataFrame:
    """Totals before and after the dimension join, and rows whose key the dimension lacks.

    The dimension is reduced to how often each key occurs, so one left join answers everything.
    """
    per_key = fact.groupBy(key).agg(F.sum(value).alias("__s"), F.count("*").alias("__n"))
    copies = dim.groupBy(key).agg(F.count("*").alias("__m"))
    joined = per_key.join(copies, key, "left")
    m = F.coalesce("__m", F.lit(0))
    return joined.agg(
        F.sum("__s").cast("double").alias("fact_total"),
        F.coalesce(F.sum(F.col("__s") * m), F.lit(0)).cast("double").alias("joined_total"),
        F.sum(F.when(m == 0, F.col("__n")).otherwise(0)).alias("orphan_rows"),
        F.sum(F.when(m > 1, F.col("__n") * (m - 1)).otherwise(0)).alias("fan_out_rows"),
    )


def seasonality_ratio(monthly: DataFrame, high=("11", "12"), low=("01", "02")) -> DataFrame:
    """Mean monthly revenue over the high months divided by that over the low months."""
    mm = F.substring("month", 6, 2)
    cents = F.col("revenue").cast("decimal(28,4)")

    def mean(months):
        inside = mm.isin(list(months))
        return F.try_divide(F.sum(F.when(inside, cents)).cast("double"), F.count_if(inside))

    return monthly.agg(mean(high).alias("high_mean"), mean(low).alias("low_mean")).select(
        "high_mean", "low_mean", F.try_divide("high_mean", "low_mean").alias("ratio")
    )


def date_range(df: DataFrame, column: str) -> DataFrame:
    return df.agg(F.min(column).cast("date").alias("first"), F.max(column).cast("date").alias("last"))
