"""Sources: CSV, JSON documents, and option builders for servers that need a driver jar."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugeworks.sources.store import path_exists


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN means missing; Spark's aggregates skip nulls, not NaN."""
    return df.select(
        *[
            F.when(~F.isnan(c), F.col(c)).alias(c) if isinstance(df.schema[c].dataType, (T.DoubleType, T.FloatType)) else F.col(c)
            for c in df.columns
        ]
    )


def scan_csv(
    spark: SparkSession, path: str, schema: str | T.StructType | None = None, base_dir: str | None = None, **options
) -> DataFrame:
    """CSV with a header. Give a schema: without one Spark reads the data twice to infer types."""
    if base_dir and not path.startswith("/") and "://" not in path:
        path = f"{base_dir.rstrip('/')}/{path}"
    if not any(ch in path for ch in "*?[{") and not path_exists(spark, path):
        raise FileNotFoundError(path)
    reader = spark.read.option("header", True).options(**options)
    reader = reader.schema(schema) if schema else reader.option("inferSchema", True)
    return nan_to_null(reader.csv(path))


def scan_documents(spark: SparkSession, path: str, schema: str | T.StructType | None = None) -> DataFrame:
    """A collection of JSON documents, one per line; fields are the union of keys, ``_id`` is dropped."""
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.json(path).drop("_id")


def parse_documents(df: DataFrame, column: str, schema: str) -> DataFrame:
    """Documents held as JSON text in a column, next to the other columns."""
    return df.withColumn(column, F.from_json(column, schema)).select(
        *[c for c in df.columns if c != column], f"{column}.*"
    ).drop("_id")


def jdbc_options(
    url: str,
    sql: str,
    driver: str | None = None,
    partition_column: str | None = None,
    lower: int | str | None = None,
    upper: int | str | None = None,
    partitions: int | None = None,
    fetch_size: int = 10_000,
) -> dict[str, str]:
    """Options for ``spark.read.format('jdbc')``; with a partition column the read runs in parallel.

    Spark refuses ``query`` together with ``partitionColumn``, so a parallel read wraps the SQL.
    """
    options = {"url": url, "fetchsize": str(fetch_size), "pushDownPredicate": "true"}
    if driver:
        options["driver"] = driver
    if partition_column is None:
        return {**options, "query": sql}
    if lower is None or upper is None or not partitions:
        raise ValueError("a parallel read needs lower, upper and partitions")
    return {
        **options,
        "dbtable": f"({sql}) AS src",
        "partitionColumn": partition_column,
        "lowerBound": str(lower),
        "upperBound": str(upper),
        "numPartitions": str(partitions),
    }


def snowflake_options(account: str, user: str, password: str, warehouse: str, database: str, schema: str, sql: str):
    """Options of the public Snowflake connector for Spark (format ``net.snowflake.spark.snowflake``)."""
    return {
        "sfURL": f"{account}.snowflakecomputing.com",
        "sfUser": user,
        "sfPassword": password,
        "sfWarehouse": warehouse,
        "sfDatabase": database,
        "sfSchema": schema,
        "query": sql,
    }


def mongo_options(uri: str, database: str, collection: str, stages: str | None = None) -> dict[str, str]:
    """Options of the public MongoDB connector for Spark (format ``mongodb``)."""
    options = {"connection.uri": uri, "database": database, "collection": collection}
    if stages:
        options["aggregation.pipeline"] = stages
    return options


def kafka_options(servers: str, topic: str, starting: str = "earliest", per_trigger: int | None = None) -> dict[str, str]:
    options = {"kafka.bootstrap.servers": servers, "subscribe": topic, "startingOffsets": starting}
    if per_trigger:
        options["maxOffsetsPerTrigger"] = str(per_trigger)
    return options


def scan_external(spark: SparkSession, kind: str, options: dict[str, str]) -> DataFrame:
    """Read a server through its connector; the connector jar must be on the class path."""
    formats = {"jdbc": "jdbc", "postgres": "jdbc", "mysql": "jdbc", "snowflake": "net.snowflake.spark.snowflake", "mongodb": "mongodb"}
    if kind not in formats:
        raise ValueError(f"unsupported source kind: {kind}")
    return spark.read.format(formats[kind]).options(**options).load()


def scan_stream(spark: SparkSession, path: str, schema: T.StructType, files_per_trigger: int | None = None) -> DataFrame:
    """A folder of Parquet files as a stream."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


# what counts as a number in a text cell; tested first because a failed cast is slow
NUMBER = r"(?i)^\s*[+-]?((\d+\.?\d*|\.\d+)(e[+-]?\d+)?|inf(inity)?|nan)\s*$"


def numeric_profile(cells: DataFrame) -> DataFrame:
    """Columns of text cells that mostly parse as numbers: count, min, max, sum, avg.

    All columns are reduced in one pass over the rows, without unpivoting the cells. A column counts
    as numeric when at least ``max(1, rows div 2)`` of its cells parse.
    """
    folds = [F.count("*").alias("rows")]
    for i, f in enumerate(cells.schema.fields):
        cell = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.NumericType):
            num = cell.cast("double")
        elif isinstance(f.dataType, T.StringType):
            num = F.when(cell.rlike(NUMBER), cell.try_cast("double"))
        else:  # the text of a date, a flag or a nested value is never a number
            num = F.lit(None).cast("double")
        seen = F.when(~F.isnan(num), num)
        folds += [F.count(num).alias(f"n{i}"), F.min(seen).alias(f"lo{i}"), F.max(seen).alias(f"hi{i}"), F.sum(seen).alias(f"s{i}")]
    rows = F.array(
        *[
            F.struct(
                F.lit(name).alias("column"), F.col(f"n{i}").alias("count"), F.col(f"lo{i}").alias("min"),
                F.col(f"hi{i}").alias("max"), F.col(f"s{i}").alias("sum"),
            )
            for i, name in enumerate(cells.columns)
        ]
    )
    stats = cells.agg(*folds).select("rows", F.inline(rows))
    return stats.where(F.col("count") >= F.greatest(F.lit(1), F.floor(F.col("rows") / 2))).select(
        "column", "count", "min", "max", "sum", F.try_divide("sum", "count").alias("avg")
    )


def preview(df: DataFrame, order_by=(), n: int = 25) -> DataFrame:
    """The first ``n`` rows as text, null as ''."""
    rows = df.orderBy(*order_by) if order_by else df
    return rows.limit(n).select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(c) for c in df.columns])


def preview_size(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("row_count")).select(
        "row_count", F.lit(len(df.columns)).alias("column_count"), F.lit(", ".join(df.columns)).alias("columns")
    )
