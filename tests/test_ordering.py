import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gaugeworks.functions import ordering as od
from gaugeworks.functions.text import fixed, humanize, signed


@pytest.fixture(scope="module")
def hot(spark):
    """Three keys, one of them with most of the rows; timestamps with gaps."""
    rng = np.random.default_rng(3)
    parts = []
    for key, n in (("hot", 3000), ("mid", 400), ("tiny", 3)):
        at = pd.Timestamp("2024-01-01") + pd.to_timedelta(np.cumsum(rng.integers(1, 90, n)), unit="h")
        parts.append(pd.DataFrame({"k": key, "timestamp": at, "value": rng.normal(100, 10, n).round(2)}))
    pdf = pd.concat(parts).sample(frac=1, random_state=1)
    return spark.createDataFrame(pdf).repartition(7), pdf.sort_values(["k", "timestamp"])


def collect(df, *order):
    return df.toPandas().sort_values(list(order)).reset_index(drop=True)


def test_ordered_index_is_the_row_number(hot):
    df, pdf = hot
    got = collect(od.ordered_index(df, ["k"], ["timestamp"], buckets=16), "k", "timestamp")
    assert (got["rn"].to_numpy() == pdf.groupby("k").cumcount().to_numpy() + 1).all()


def test_ordered_index_with_ties_and_null_key(spark):
    df = spark.createDataFrame([(None, 1, i) for i in range(50)] + [("a", i % 2, i) for i in range(50)], "k string, t int, i int")
    got = od.ordered_index(df, ["k"], ["t", "i"], buckets=4).toPandas()
    assert len(got) == 100
    for _, part in got.groupby("k", dropna=False):
        part = part.sort_values(["t", "i"])
        assert part["rn"].tolist() == list(range(1, 51))


def test_ordered_index_without_keys(hot):
    df, pdf = hot
    got = od.ordered_index(df, [], ["timestamp", "k"]).toPandas().sort_values(["timestamp", "k"])
    assert got["rn"].tolist() == list(range(1, len(pdf) + 1))


@pytest.mark.parametrize("buckets", [None, 16])
def test_running_sums(hot, buckets):
    df, pdf = hot
    got = collect(od.running_sums(df.withColumn("one", F.lit(1)), ["k"], "timestamp", {"c": "one", "s": "value"}, buckets), "k", "timestamp")
    assert (got["c"].to_numpy() == pdf.groupby("k").cumcount().to_numpy() + 1).all()
    assert np.allclose(got["s"], pdf.groupby("k")["value"].cumsum())


@pytest.mark.parametrize("buckets", [None, 16])
def test_exact_quantiles(hot, buckets):
    df, pdf = hot
    probs = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    got = od.exact_quantiles(df, ["k"], "value", probs, buckets).toPandas().set_index("k")
    for key, part in pdf.groupby("k"):
        assert np.allclose(got.loc[key, "q"], np.quantile(part["value"], probs))
        assert got.loc[key, "n"] == len(part)


def test_quantiles_skip_null_and_nan_and_weigh_repeats(spark):
    df = spark.createDataFrame([("a", v) for v in (1.0, 1.0, 1.0, 5.0, None, float("nan"))], "k string, v double")
    for buckets in (None, 4):
        row = od.exact_quantiles(df, ["k"], "v", [0.5, 1.0], buckets).first()
        assert list(row["q"]) == [1.0, 5.0] and row["n"] == 4


def test_chunks_with_halo_equal_one_window(hot):
    df, _ = hot

    def build(part, w):
        return part.select("*", F.avg("value").over(w.rowsBetween(-28, -1)).alias("m"), F.lag("value", 28).over(w).alias("l"))

    whole = collect(build(df, Window.partitionBy("k").orderBy("timestamp")), "k", "timestamp")
    for buckets in (None, 3, 40, 300):  # ranges of 11 rows are shorter than the frames
        cut = collect(od.over_series(df, ["k"], ["timestamp"], 28, build, buckets), "k", "timestamp")
        pd.testing.assert_frame_equal(whole, cut[whole.columns])
    alone = build(df.drop("k"), Window.orderBy("timestamp", "value"))
    cut = od.over_series(df.drop("k"), [], ["timestamp", "value"], 28, build, 20)
    pd.testing.assert_frame_equal(collect(alone, "timestamp", "value"), collect(cut, "timestamp", "value")[alone.columns])


def test_order_of_input_rows_does_not_matter(hot):
    df, _ = hot
    a = collect(od.ordered_index(df.repartition(3), ["k"], ["timestamp"]), "k", "timestamp")
    b = collect(od.ordered_index(df.orderBy("value").coalesce(1), ["k"], ["timestamp"]), "k", "timestamp")
    pd.testing.assert_frame_equal(a, b)


def test_numbers_read_as_python_writes_them(spark):
    values = [0.125, 0.375, 2.5, -0.125, 1234.5, 462645.0, 462655.0, 1e6, 999999.999, 2.345e9, -7.0, 0.0, 0.005, 1e15, 3.14159]
    rows = spark.createDataFrame([(v,) for v in values], "v double").select(
        "v", fixed(F.col("v"), 2).alias("f2"), fixed(F.col("v"), 1).alias("f1"), humanize(F.col("v")).alias("h"), signed(F.col("v")).alias("s")
    ).collect()

    def human(v):
        for size, digits, suffix in ((1e9, 2, "B"), (1e6, 2, "M"), (1e3, 1, "K")):
            if abs(v) >= size:
                return f"{v / size:.{digits}f}{suffix}"
        return f"{v:.2f}"

    for r in rows:
        if abs(r.v) < 1e13:
            assert (r.f2, r.f1, r.s) == (f"{r.v:.2f}", f"{r.v:.1f}", f"{r.v:+.1f}")
        if abs(r.v) < 1e15:
            assert r.h == human(r.v)


def test_join_same_without_keys(spark):
    from gaugeworks.functions.ordering import join_same

    left, right = spark.range(2).toDF("a"), spark.range(3).toDF("b")
    assert join_same(left, right, []).count() == 6
    assert join_same(left, right.limit(0), [], "left").count() == 2


def test_ranges_are_even_when_one_order_value_is_frequent(spark):
    import collections

    from gaugeworks.functions.ordering import in_ranges, ordered_index

    df = spark.range(20_000).selectExpr("'a' AS k", "CASE WHEN id % 10 = 0 THEN id ELSE 7 END AS t", "id AS i")
    sizes = collections.Counter(r["__b"] for r in in_ranges(df, ["k"], ["t"], 8).select("__b").collect())
    assert max(sizes.values()) <= 2 * 20_000 / 8
    got = [r["rn"] for r in ordered_index(df, ["k"], ["t"], buckets=8).select("rn").collect()]
    assert sorted(got) == list(range(1, 20_001))


def test_join_in_parts_has_tasks_of_so_many_rows(spark):
    left = spark.range(2000).selectExpr("id % 700 AS a", "id AS v")
    right = spark.range(600).selectExpr("id AS b", "id * 2 AS w")
    joined = od.join_in_parts(left, right, "a", "b", rows=100)
    plain = left.join(right, left.a == right.b)
    assert od.parts_of(left, 100) == 20 and od.parts_of(left, 1000) is None
    assert "20, REPARTITION_BY_NUM" in joined._jdf.queryExecution().toString().replace("), REPART", ", REPART")
    assert sorted(map(tuple, joined.collect())) == sorted(map(tuple, plain.collect()))
