"""Features, anomalies, ensemble and insights on small series with known answers."""

from datetime import datetime

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gaugeworks.operators import anomaly as an
from gaugeworks.operators import ensemble as en
from gaugeworks.operators import insights as ins
from gaugeworks.operators import isolation as iso
from gaugeworks.operators.features import FeatureConfig, FeaturePipeline

KEY = ["kpi_id"]


def wave(n=180, spike_at=120, seed=0, noise=25.0):
    rng = np.random.default_rng(seed)
    i = np.arange(n)
    v = 1000 + 300 * i / n + 50 * np.sin(2 * np.pi * i / 7) + rng.normal(0, noise, n)
    if spike_at is not None:
        v[spike_at] *= 1.4
    return pd.DataFrame({"timestamp": pd.date_range("2025-01-01", periods=n), "value": v})


@pytest.fixture(scope="module")
def series(spark):
    return spark.createDataFrame(pd.concat([wave().assign(kpi_id="a"), wave(spike_at=None, seed=5).assign(kpi_id="b")]))


def test_forty_one_columns_match_pandas(series):
    pipe = FeaturePipeline(FeatureConfig(keys=KEY))
    got = pipe.fit_transform(series).where("kpi_id = 'a'").toPandas().sort_values("timestamp").reset_index(drop=True)
    assert len(pipe.columns) == 41
    v = wave()["value"]
    shifted = v.shift(1)
    for w in (7, 14, 28):
        roll = shifted.rolling(w, min_periods=max(2, w // 2))
        for name in ("mean", "std", "min", "max"):
            assert np.allclose(got[f"roll_{name}_{w}"], getattr(roll, name)(), equal_nan=True)
    for a in (0.3, 0.1):
        assert np.allclose(got[f"ema_{a}".replace(".", "_")], shifted.ewm(alpha=a, adjust=False).mean(), rtol=1e-12, equal_nan=True)
    assert np.allclose(got["diff_7"], v.diff(7), equal_nan=True)
    assert (got["week"] == wave()["timestamp"].dt.isocalendar().week.astype(int)).all()


def test_averages_with_missing_values_match_pandas(spark):
    pdf = wave(60, None)
    pdf.loc[[3, 4, 20, 40], "value"] = np.nan
    rows = spark.createDataFrame(pdf.assign(kpi_id="a")).withColumn("value", F.when(~F.isnan("value"), F.col("value")))
    cfg = FeatureConfig(keys=KEY, lags=(1,), rolling=(), diffs=(), calendar=False, fourier_periods=())
    got = FeaturePipeline(cfg).fit_transform(rows).toPandas().sort_values("timestamp")
    want = pdf["value"].shift(1).ewm(alpha=0.1, adjust=False).mean()
    assert np.allclose(got["ema_0_1"], want, equal_nan=True)


def test_long_series_has_the_same_features(series):
    whole = FeaturePipeline(FeatureConfig(keys=KEY)).fit_transform(series).toPandas().sort_values([*KEY, "timestamp"])
    rng = FeatureConfig(keys=KEY)
    cut = FeaturePipeline(rng).fit_transform(series, buckets=20).toPandas().sort_values([*KEY, "timestamp"])
    pd.testing.assert_frame_equal(whole.reset_index(drop=True), cut[whole.columns].reset_index(drop=True))


def test_transform_keeps_the_fitted_phase(series):
    pipe = FeaturePipeline(FeatureConfig(keys=KEY))
    full = pipe.fit_transform(series).where("timestamp >= '2025-05-01'").toPandas().sort_values([*KEY, "timestamp"])
    tail = pipe.transform(series.where("timestamp >= '2025-05-01'")).toPandas().sort_values([*KEY, "timestamp"])
    assert np.allclose(full["fourier_sin_7_1"], tail["fourier_sin_7_1"])


def test_spike_and_drop_are_found(spark):
    pdf = wave(40, None)
    pdf["value"] = 100.0 + np.tile([0.0, 1.0, -1.0, 0.5], 10)
    pdf.loc[35, "value"] = 140.0
    pdf.loc[37, "value"] = 60.0
    found = an.rolling_anomalies(spark.createDataFrame(pdf.assign(kpi_id="k"))).toPandas().set_index("timestamp")
    up, down = found.loc[pdf["timestamp"][35]], found.loc[pdf["timestamp"][37]]
    assert up["kind"] == "spike" and "jumped" in up["narrative"]
    assert down["kind"] == "drop" and down["narrative"].startswith("⚠️") and down["value"] == 60.0


def test_five_day_drop_is_flagged(spark):
    pdf = wave(730, None, noise=10.0)
    pdf.loc[420:424, "value"] *= 0.65
    found = an.rolling_anomalies(spark.createDataFrame(pdf.assign(kpi_id="k"))).toPandas()
    assert set(pdf["timestamp"][420:422]) <= set(found[found["alert_worthy"]]["timestamp"])


def test_short_series_gives_nothing(spark):
    assert an.rolling_anomalies(spark.createDataFrame(wave(11, None).assign(kpi_id="k"))).count() == 0


def test_ensemble_ranks_the_spike(series, tmp_path):
    pipe = FeaturePipeline(FeatureConfig(keys=KEY))
    model, scored, metrics, rejects = en.train_anomaly(series, pipe, config=en.EnsembleConfig(trees=60))
    pdf = scored.where("kpi_id = 'a'").toPandas().sort_values("severity", ascending=False)
    assert pd.Timestamp("2025-05-01") in set(pdf["timestamp"][:5])
    assert metrics.count() == 2 and rejects.count() == 0
    model.save(str(tmp_path))
    loaded = en.AnomalyEnsemble.load(series.sparkSession, str(tmp_path))
    feats = pipe.transform(series).where("lag_28 IS NOT NULL")
    again = loaded.score(feats).where("kpi_id = 'a'").toPandas().set_index("timestamp")["severity"]
    assert np.allclose(again.loc[pdf["timestamp"]], pdf["severity"])


def test_every_labelled_series_has_its_own_classifier(series, tmp_path):
    """Series a has labels, series b has too few."""
    high = series.where("kpi_id = 'a'").agg(F.percentile("value", 0.6)).first()[0]
    labels = series.where("kpi_id = 'a' OR dayofmonth(timestamp) = 1").select(*KEY, "timestamp", (F.col("value") > high).cast("int").alias("label"))
    config = en.EnsembleConfig(trees=5, boost_rounds=20, boost_depth=3, min_labels=20)
    model, scored, metrics, _rejects = en.train_anomaly(series, FeaturePipeline(FeatureConfig(keys=KEY)), labels, config)
    assert {r.kpi_id: r.xgb_used for r in metrics.collect()} == {"a": True, "b": False}
    pdf = scored.toPandas()
    a = pdf[pdf["kpi_id"] == "a"]
    assert pdf[pdf["kpi_id"] == "b"]["xgboost"].isna().all() and ((a["xgboost"] > 0.5) == (a["value"] > high)).mean() > 0.95
    model.save(str(tmp_path))
    again = en.AnomalyEnsemble.load(series.sparkSession, str(tmp_path))
    feats = FeaturePipeline(FeatureConfig(keys=KEY)).fit_transform(series).where("lag_28 IS NOT NULL")
    got = again.score(feats).where("kpi_id = 'a'").toPandas().set_index("timestamp")["xgboost"]
    assert np.allclose(got.loc[a["timestamp"]], a["xgboost"])


def test_short_series_are_rejected_with_a_reason(spark, series):
    both = series.unionByName(spark.createDataFrame(wave(40, None).assign(kpi_id="short")))
    _m, scored, _metrics, rejects = en.train_anomaly(both, FeaturePipeline(FeatureConfig(keys=KEY)), config=en.EnsembleConfig(trees=5))
    row = rejects.collect()
    assert [r["kpi_id"] for r in row] == ["short"] and "needs 50 rows" in row[0]["reason"]
    assert scored.where("kpi_id = 'short'").count() == 0


def test_forest_does_not_depend_on_partitioning(series):
    x = series.select("kpi_id", "timestamp", F.array("value", F.col("value") % 7).alias("x"))
    a, b = (iso.fit_forest(x.repartition(n), KEY, [*KEY, "timestamp"], 10).toPandas().sort_values([*KEY, "tree"]) for n in (2, 9))
    assert [list(c) for c in a["cut"]] == [list(c) for c in b["cut"]]
    scored = [iso.score_forest(x.repartition(n), iso.fit_forest(x, KEY, [*KEY, "timestamp"], 10), KEY, [*KEY, "timestamp"]) for n in (2, 9)]
    left, right = (d.toPandas().sort_values([*KEY, "timestamp"])["raw"].to_numpy() for d in scored)
    assert np.allclose(left, right)


def test_sample_is_the_rows_of_smallest_hash(spark):
    from gaugeworks.operators.histogram_trees import draws

    rows = spark.createDataFrame([("long", i) for i in range(5000)] + [("short", i) for i in range(30)] + [(None, 7)], "k string, i long")
    got = iso.sample_rows(rows.repartition(6), ["k"], ["k", "i"], trees=12, sample=64, seed=42).toPandas()
    hashes = rows.select("k", "i", F.xxhash64("k", "i").alias("h")).toPandas()
    by = {t: set() for t in range(12)}
    for r in got.itertuples():
        for t in r.trees:
            by[t].add((r.k, r.i))
    for t in range(12):
        luck = draws(hashes["h"].to_numpy().astype(np.uint64), t, 42)
        for k, part in hashes.assign(luck=luck).groupby("k", dropna=False):
            want = {(None if k != k else k, i) for i in part.nsmallest(64, "luck")["i"]}
            assert {x for x in by[t] if x[0] == (None if k != k else k)} == want


def _plain_depths(x, rows, tree, seed, slots, limit, probe):
    """Path lengths by recursion over the same draws."""
    from gaugeworks.operators.histogram_trees import draws

    def walk(rows, level, node, v):
        lo, hi = x[rows].min(axis=0), x[rows].max(axis=0)
        usable = np.flatnonzero(hi > lo)
        if level >= limit or len(rows) <= 1 or not len(usable):
            return level + float(iso._mean_depth(len(rows)))
        one, two = (draws(np.array([tree * slots + node]), n, seed)[0] for n in (0, 1))
        f = usable[int(one * len(usable))]
        cut = lo[f] + two * (hi[f] - lo[f])
        cut = cut if cut > lo[f] else hi[f]
        left = v[f] < cut
        return walk(rows[(x[rows, f] < cut) == left], level + 1, 2 * node + (1 if left else 2), v)

    return np.array([walk(np.array(rows), 0, 0, v) for v in probe])


def test_level_wise_trees_equal_recursion():
    rng = np.random.default_rng(6)
    x = rng.normal(size=(70, 3)).round(1)
    x[:, 2] = 1.0
    pairs = [(r, t) for t in (3, 8, 11) for r in rng.permutation(70)[: {3: 64, 8: 1, 11: 40}[t]]]
    row, tree = np.array(pairs).T
    grown = iso.grow_trees(x, row, tree, 42)
    shuffled = rng.permutation(len(row))
    again = iso.grow_trees(x, row[shuffled], tree[shuffled], 42)
    assert all(np.array_equal(grown[t]["cut"], again[t]["cut"]) for t in grown)
    probe, total = rng.normal(size=(25, 3)), 0
    for t in grown:
        own = row[tree == t]
        want = _plain_depths(x, own, t, 42, 127, int(np.ceil(np.log2(max(len(own), 2)))), probe)
        assert np.allclose(iso.mean_depths(probe, pd.DataFrame([grown[t]])), want)
        total = total + want
    assert np.allclose(iso.mean_depths(probe, pd.DataFrame(list(grown.values())), step=7), total / 3)


def test_fused_flags():
    assert an.DETECTORS == ("isolation_forest", "statistical", "xgboost")


def test_two_detectors_agree(spark):
    rows = spark.createDataFrame([(10.0, 0.6, 0.1, None), (10.0, 0.51, 0.52, None), (10.0, 0.9, 0.3, 0.2)], "value double, isolation_forest double, statistical double, xgboost double")
    got = an.fuse_scores(rows, list(an.DETECTORS)).orderBy("isolation_forest").collect()
    assert [r["is_anomaly"] for r in got] == [True, False, False]
    assert len(got[2]["detector_scores"]) == 3 and len(got[0]["detector_scores"]) == 2


def test_simulation_and_drivers(spark):
    rows = spark.createDataFrame([("k", datetime(2025, 1, 1 + i), float(i)) for i in range(10)], "kpi_id string, timestamp timestamp, value double")
    got = ins.simulate(rows, KEY, {"up": {"lift_pct": 10.0}}, 12).first()
    assert got["trend_value"] == pytest.approx(21.0) and got["projected"] == pytest.approx(23.1)
    few = rows.where("value < 3")
    assert ins.simulate(few, KEY, {"up": {}}).count() == 0
    cur = spark.createDataFrame([("x", 5.0), ("new", 3.0)], "d string, v double")
    old = spark.createDataFrame([("x", 10.0), ("gone", 1.0)], "d string, v double")
    top = ins.decompose_drivers(cur, old, "d", "v").orderBy("rank").collect()
    assert [(r["d"], r["delta_abs"]) for r in top] == [("x", -5.0), ("new", 3.0), ("gone", -1.0)]
    assert top[1]["delta_pct"] == float("inf")


def test_explain_number_without_filters(spark):
    rows = spark.createDataFrame([(1500.0, "Churn", "a/b", {}, [], 1234, None)], "value double, kpi_name string, formula string, filters map<string,string>, source_tables array<string>, rows_used long, period string")
    text = ins.explain_number(rows).first()["explanation"]
    assert text == "This 1.5K is the churn computed as `a/b` from the source tables, based on 1,234 rows."


def test_averages_over_long_gaps(spark):
    import numpy as np
    import pandas as pd

    from gaugeworks.operators.features import FeatureConfig, FeaturePipeline

    rng = np.random.default_rng(0)
    values = [float(x) for x in rng.normal(100, 5, 60)] + [None] * 300 + [float(x) for x in rng.normal(50, 5, 60)]
    when = pd.date_range("2024-01-01", periods=len(values))
    df = spark.createDataFrame([("a", t.to_pydatetime(), v) for t, v in zip(when, values)], "k string, timestamp timestamp, value double")
    config = FeatureConfig(keys=["k"], ema_alphas=(0.1, 0.3))
    got = FeaturePipeline(config).fit_transform(df).orderBy("timestamp").toPandas()
    for alpha in (0.1, 0.3):
        want = pd.Series(values, dtype=float).ewm(alpha=alpha, adjust=False).mean().shift(1)
        assert np.allclose(got[f"ema_{alpha}".replace(".", "_")].astype(float), want, rtol=1e-9, equal_nan=True)


def test_averages_where_one_key_has_most_rows_and_a_gap_spans_ranges(spark):
    rng = np.random.default_rng(1)
    parts = []
    for key, values in (
        ("hot", [*rng.normal(100, 5, 5000), *[np.nan] * 10_000, *rng.normal(-50, 5, 5000), np.inf, 3.0, *[np.nan] * 40]),
        ("late", [np.nan] * 900 + [7.0, 8.0, np.nan, 9.0]), ("none", [np.nan] * 300), ("one", [1.0]), (None, list(rng.normal(0, 1, 900))),
    ):
        parts.append(pd.DataFrame({"k": key, "timestamp": pd.date_range("2020-01-01", periods=len(values), freq="h"), "value": values}))
    pdf = pd.concat(parts, ignore_index=True)
    df = spark.createDataFrame(pdf.astype({"k": object}), "k string, timestamp timestamp, value double").repartition(5)
    df = df.withColumn("value", F.when(~F.isnan("value"), F.col("value")))
    config = FeatureConfig(keys=["k"], lags=(), rolling=(), diffs=(), calendar=False, fourier_periods=(), ema_alphas=(0.3, 0.1, 0.999, 1.0))
    for buckets in (None, 3, 97):
        got = FeaturePipeline(config).fit_transform(df, buckets).toPandas()
        assert len(got) == len(pdf)
        for key, part in pdf.groupby("k", dropna=False):
            mine = got[got["k"].isna() if key is None or key != key else got["k"] == key].sort_values("timestamp")
            for a in config.ema_alphas:
                want = part["value"].replace(np.inf, np.nan).ewm(alpha=a, adjust=False).mean().shift(1)
                assert np.allclose(mine[f"ema_{a}".replace(".", "_")].astype(float), want, rtol=1e-9, equal_nan=True), (key, a, buckets)
    single = FeaturePipeline(FeatureConfig(keys=(), lags=(), rolling=(), diffs=(), calendar=False, fourier_periods=()))
    got = single.fit_transform(df.where("k = 'hot'").drop("k"), 9).toPandas().sort_values("timestamp")
    want = parts[0]["value"].replace(np.inf, np.nan).ewm(alpha=0.1, adjust=False).mean().shift(1)
    assert np.allclose(got["ema_0_1"].astype(float), want, rtol=1e-9, equal_nan=True)


def test_affine_prefix_equals_the_loop():
    from gaugeworks.operators.features import affine_prefix

    rng = np.random.default_rng(2)
    c, d = rng.choice([0.0, 0.3, 0.9, 1.0], 700, p=[0.01, 0.3, 0.3, 0.39]), rng.normal(size=(2, 700))
    got_c, got_d = affine_prefix(c, d)
    e = np.array([3.0, -1.0])
    for i in range(700):
        e = c[i] * e + d[:, i]
        assert np.allclose(got_c[i] * np.array([3.0, -1.0]) + got_d[:, i], e, rtol=1e-12, atol=1e-12)


def test_short_series_have_no_anomalies(spark):
    import datetime as dt

    from gaugeworks.operators.anomaly import rolling_anomalies

    day = dt.datetime(2024, 1, 1)
    rows = [("a", day + dt.timedelta(i), v) for i, v in enumerate([1.0, 2.0, 99.0])]
    rows += [("b", day + dt.timedelta(i), v) for i, v in enumerate([1.0, 2.0, 1.0, 99.0])]
    df = spark.createDataFrame(rows, "kpi_id string, timestamp timestamp, value double")
    assert {r.kpi_id for r in rolling_anomalies(df, window=2).collect()} == {"b"}


def test_large_numbers_as_text(spark):
    from gaugeworks.functions.text import fixed
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(12345678901234.5,), (-1e15,), (float("inf"),), (9999999999999.99,)], "v double")
    got = [r[0] for r in df.select(fixed(F.col("v"), 2)).collect()]
    assert got == ["12345678901234.50", "-1000000000000000.00", "Infinity", "9999999999999.99"]
