"""Row order, prefix sums, exact quantiles and windows without putting a group into one task.

A window over a series key is one task per key. Here rows are cut into ranges of (key, order) instead:
short keys share a range, a long key has many. Every operation works inside (key, range) and takes what
the ranges before add to it: a count, a sum, or the last few rows. There is one path for all sizes.
Where the ranges end steers balance only, every number returned is exact.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from gaugeworks.session import stage

# Rows a range of the order holds, about.
RANGE_ROWS = 250_000
# Rows of a fact a task joins and aggregates, about.
TASK_ROWS = 500_000


def parts_of(df: DataFrame, rows: int) -> int | None:
    """How many parts of about ``rows`` rows ``df`` has, if these are more than Spark makes by itself."""
    wanted = -(-df.count() // rows)
    return wanted if wanted > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else None


def join_in_parts(left: DataFrame, right: DataFrame, left_key: str, right_key: str, rows: int = TASK_ROWS) -> DataFrame:
    """Inner join of a fact with a table whose keys are spread evenly, in tasks of about ``rows`` rows of
    the fact: what a task sorts and aggregates does not grow with the fact."""
    parts = parts_of(left, rows)
    if parts:
        left, right = left.repartition(parts, left_key), right.repartition(parts, right_key)
    return left.join(right, F.col(left_key) == F.col(right_key))


def in_ranges(
    df: DataFrame, keys: Sequence[str], order_by: Sequence[str], parts: int | None = None,
    local: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """``df`` written once in ranges of (keys, order), with the number of the range in ``__b``.

    A long key has many ranges, short ones share a range. Spark samples the whole order tuple for the
    borders, and a running number at its end lets it cut between equal tuples. The number of ranges is
    that of the rows divided by ``RANGE_ROWS`` (adaptive execution joins small ones), unless ``parts``
    is given. ``local`` may add columns to the rows of a range, which it then sees in order.
    """
    marked = df.withColumn("__i", F.monotonically_increasing_id())
    columns = [*keys, *order_by, "__i"]
    if parts is None:
        parts = parts_of(df, RANGE_ROWS)
    ranged = marked.repartitionByRange(parts, *columns) if parts else marked.repartitionByRange(*columns)
    if local:
        ranged = local(ranged.sortWithinPartitions(*columns))
    return stage(ranged.withColumn("__b", F.spark_partition_id()))


def carried(cut: DataFrame, keys: Sequence[str], sums: dict[str, Column]) -> DataFrame:
    """(keys..., __b, names) of rows cut by :func:`in_ranges`: each sum over the earlier ranges of the
    key. One row a key and range goes into the window."""
    totals = cut.groupBy(*keys, "__b").agg(*[c.alias(f"__t_{n}") for n, c in sums.items()])
    earlier = Window.partitionBy(*keys).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select(*keys, "__b", *[F.coalesce(F.sum(f"__t_{n}").over(earlier), F.lit(0)).alias(n) for n in sums])


def join_same(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Join on equal keys where null equals null; the right side's key columns are dropped.

    Without keys all rows are one group: every left row meets every right row.
    """
    if not keys:
        return left.join(right, F.lit(True), how)
    marked = right.select(
        *[F.col(k).alias(f"__r_{k}") for k in keys], *[c for c in right.columns if c not in keys]
    )
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__r_{k}")) for k in keys])
    return left.join(marked, same, how).drop(*[f"__r_{k}" for k in keys])


def ordered_index(
    df: DataFrame, keys: Sequence[str], order_by: Sequence[str], name: str = "rn", buckets: int | None = None
) -> DataFrame:
    """Exact 1-based row number per key, in order of ``order_by``, computed range by range."""
    cut = in_ranges(df, keys, order_by, buckets)
    offsets = carried(cut, keys, {"__before": F.count("*")})
    local = Window.partitionBy(*keys, "__b").orderBy(*order_by, "__i")
    numbered = cut.withColumn("__local", F.row_number().over(local))
    return (
        join_same(numbered, offsets, [*keys, "__b"], "inner")
        .withColumn(name, (F.col("__before") + F.col("__local")).cast("long"))
        .drop("__b", "__i", "__local", "__before")
    )


def running_sums(
    df: DataFrame, keys: Sequence[str], order_by: str, sums: dict[str, str], buckets: int | None = None
) -> DataFrame:
    """Inclusive prefix sums ``{new: column}``; one row per (keys, order_by) is expected."""
    cut = in_ranges(df, keys, [order_by], buckets).drop("__i")
    offsets = carried(cut, keys, {f"__o_{n}": F.sum(c) for n, c in sums.items()})
    upto = Window.partitionBy(*keys, "__b").orderBy(order_by).rowsBetween(Window.unboundedPreceding, 0)
    local = cut.select("*", *[F.sum(c).over(upto).alias(f"__l_{n}") for n, c in sums.items()])
    joined = join_same(local, offsets, [*keys, "__b"], "inner")
    for n in sums:
        joined = joined.withColumn(n, F.col(f"__l_{n}") + F.col(f"__o_{n}"))
    return joined.drop("__b", *[f"__l_{n}" for n in sums], *[f"__o_{n}" for n in sums])


def quantiles_of_placed(
    placed: DataFrame, keys: Sequence[str], value: str, count: str, upto: str, probs: Sequence[float]
) -> DataFrame:
    """Linear-interpolated quantiles ``(keys..., q ARRAY<DOUBLE>, n)`` from value counts that already
    carry their prefix sum ``upto``. Only values that hold a wanted rank leave the first filter."""
    totals = placed.groupBy(*keys).agg(F.sum(count).alias("__n"))
    rows = join_same(placed.where(F.col(count) > 0), totals, keys, "inner")
    spots = F.array(
        *[
            F.struct(F.lit(i).alias("i"), (F.lit(float(p)) * (F.col("__n") - 1)).alias("h"))
            for i, p in enumerate(probs)
        ]
    )

    def holds(rank: Column) -> Column:
        return (rank >= F.col(upto) - F.col(count)) & (rank < F.col(upto))

    rows = rows.withColumn("__w", F.filter(spots, lambda s: holds(F.floor(s["h"])) | holds(F.ceil(s["h"]))))
    hit = rows.where(F.size("__w") > 0).select(
        *keys, "__n", F.col(value).alias("__v"), upto, count, F.explode("__w").alias("__s")
    )
    picked = hit.groupBy(*keys, "__n", F.col("__s.i").alias("i"), F.col("__s.h").alias("h")).agg(
        F.max(F.when(holds(F.floor("__s.h")), F.col("__v"))).alias("lo"),
        F.max(F.when(holds(F.ceil("__s.h")), F.col("__v"))).alias("up"),
    )
    point = F.col("lo") + (F.col("up") - F.col("lo")) * (F.col("h") - F.floor("h"))
    return picked.groupBy(*keys, F.col("__n").alias("n")).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("i", point.alias("x")))), lambda s: s["x"]).alias("q")
    )


def exact_quantiles(
    df: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float], buckets: int | None = None
) -> DataFrame:
    """Linear-interpolated quantiles per key: ``(keys..., q ARRAY<DOUBLE>, n)`` in order of ``probs``.

    Equal values collapse into counts before the shuffle, prefix sums place the counts range by range.
    Nulls and NaN are left out.
    """
    v = F.col(value).cast("double")
    counts = (
        df.where(v.isNotNull() & ~F.isnan(v))
        .groupBy(*keys, (v + F.lit(0.0)).alias("__x"))
        .agg(F.count("*").alias("__c"))
    )
    placed = running_sums(stage(counts), keys, "__x", {"__hi": "__c"}, buckets)
    return quantiles_of_placed(stage(placed), keys, "__x", "__c", "__hi", probs)


def chunk_with_halo(
    df: DataFrame, keys: Sequence[str], order_by: Sequence[str], halo: int, chunk: int
) -> DataFrame:
    """Cut each key into chunks of ``chunk`` rows; each chunk also gets the ``halo`` rows before it.

    Adds ``rn``, ``__chunk`` and ``__own`` (false on halo rows).
    """
    if halo > chunk:
        raise ValueError("halo must not be longer than a chunk")
    at = F.floor((F.col("rn") - 1) / F.lit(chunk)).cast("long")
    tail = (F.col("rn") - 1) % F.lit(chunk) >= F.lit(chunk - halo)
    spread = F.when(tail, F.array(at, at + 1)).otherwise(F.array(at))
    return (
        ordered_index(df, keys, order_by)
        .withColumn("__home", at)
        .withColumn("__chunk", F.explode(spread))
        .withColumn("__own", F.col("__chunk") == F.col("__home"))
        .drop("__home")
    )


def rows_before(cut: DataFrame, keys: Sequence[str], order_by: Sequence[str], lookback: int) -> DataFrame:
    """The last ``lookback`` rows before each range of a key that starts in an earlier one, with that
    range in ``__b``: at most ``lookback`` rows a range, as no more than one key crosses a border."""
    sizes = cut.groupBy(*keys, "__b").agg(F.count("*").alias("__n"))
    earlier = Window.partitionBy(*keys).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    following = F.lead("__b").over(Window.partitionBy(*keys).orderBy("__b"))
    spans = sizes.select("*", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__s"), following.alias("__next"))
    spans = stage(spans.where("__s > 0 OR __next IS NOT NULL"))
    last = Window.partitionBy(*keys, "__b").orderBy(*[F.desc(c) for c in order_by], F.desc("__i"))
    giving = join_same(cut, spans.where("__next IS NOT NULL"), [*keys, "__b"], "inner")
    ends = giving.withColumn("__r", F.row_number().over(last)).where(F.col("__r") <= lookback)
    ends = ends.withColumn("__rn", F.col("__s") + F.col("__n") - F.col("__r") + 1).drop("__b", "__s", "__n", "__next", "__r")
    # a range wants the rows numbered s - lookback + 1 to s, which lie in two blocks of ``lookback`` numbers
    blocks = F.array_distinct(F.array(F.floor((F.col("__s") - lookback) / lookback), F.floor((F.col("__s") - 1) / lookback)))
    asking = spans.where("__s > 0").select(*keys, "__b", F.col("__s").alias("__upto"), F.explode(blocks).alias("__at"))
    ends = ends.withColumn("__at", F.floor((F.col("__rn") - 1) / lookback))
    found = join_same(ends, asking, [*keys, "__at"], "inner")
    return found.where((F.col("__rn") <= F.col("__upto")) & (F.col("__rn") > F.col("__upto") - lookback)).drop("__rn", "__upto", "__at")


def over_ranges(
    cut: DataFrame, keys: Sequence[str], order_by: Sequence[str], lookback: int, build: Callable[[DataFrame, WindowSpec], DataFrame]
) -> DataFrame:
    """Apply ``build(df, window)`` to frames that reach at most ``lookback`` rows back, on rows cut by
    :func:`in_ranges`. A window sees one key in one range and the rows before it."""
    rows = cut.withColumn("__own", F.lit(True))
    if lookback:
        rows = rows.unionByName(rows_before(cut, keys, order_by, lookback).withColumn("__own", F.lit(False)))
    out = build(rows, Window.partitionBy(*keys, "__b").orderBy(*order_by))
    return out.where("__own").drop("__b", "__i", "__own")


def over_series(
    df: DataFrame, keys: Sequence[str], order_by: Sequence[str], lookback: int,
    build: Callable[[DataFrame, WindowSpec], DataFrame], buckets: int | None = None,
) -> DataFrame:
    """:func:`over_ranges` of ``df``."""
    return over_ranges(in_ranges(df, keys, order_by, buckets), keys, order_by, lookback, build)
