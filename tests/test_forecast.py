import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gaugeworks.operators import boosting as bo
from gaugeworks.operators import forecast as fc
from gaugeworks.operators import models as mo

KEY = ["kpi_id"]
MODELS = mo.candidate_models()


def wave(n, noise=5.0, seed=0):
    i = np.arange(n)
    return 1000 + i + 50 * np.sin(2 * np.pi * i / 7) + np.random.default_rng(seed).normal(0, noise, n)


@pytest.fixture(scope="module")
def series(spark):
    parts = [pd.DataFrame({"kpi_id": k, "timestamp": pd.date_range("2025-01-01", periods=180), "value": wave(180, s, j)}) for j, (k, s) in enumerate((("a", 5.0), ("b", 20.0)))]
    return spark.createDataFrame(pd.concat(parts))


def test_smoothing_errors_match_a_plain_loop():
    m, y = mo.Smoothing(), wave(60)
    params = np.array([[0.4, 0.3, 0.2]])
    (gram, end), = [mo.summarize_chunk(m, y, np.array([]), 0, params)]
    sse, state = mo.combine(m, [(gram, end)])
    width = 1 + m.dim
    start = -np.linalg.lstsq(gram[0, 1:, 1:], gram[0, 1:, 0], rcond=None)[0]
    level, trend, season = start[0], start[1], list(start[2:])
    a, b, g = 0.4, 0.4 * 0.3, 0.6 * 0.2
    total = 0.0
    for t, x in enumerate(y):
        e = x - (level + trend + season[t % 7])
        level, trend, season[t % 7] = level + trend + a * e, trend + b * e, season[t % 7] + g * e
        total += e * e
    assert sse[0] == pytest.approx(total, rel=1e-6) and gram.shape == (1, width, width)
    assert np.allclose(state[0][0] + state[0][2 + 60 % 7], level + season[60 % 7], rtol=1e-6)


def test_arma_errors_match_a_plain_loop():
    m, y = MODELS["arima"], wave(80)
    params = np.array([[0.3, -0.2, 0.4, 0.1]])
    ar, ma = m.polynomials(params[0])
    w = np.diff(y, prepend=0.0)
    e = np.zeros(80)
    for t in range(m.halo, 80):
        e[t] = w[t] + sum(ar[k] * w[t - k] for k in (1, 2)) - sum(ma[k] * e[t - k] for k in (1, 2))
    gram, _ = mo.summarize_chunk(m, y, np.array([]), 0, params)
    assert gram[0, 0, 0] == pytest.approx(np.sum(e**2))


@pytest.mark.parametrize("name", list(MODELS))
def test_chunks_give_the_same_fit(name):
    y, t = wave(300), np.arange(300) * 86_400e6
    whole = pd.DataFrame({"chunk": [0], "y": [y], "t": [t], "halo": [np.array([])]})
    cut = pd.DataFrame([{"chunk": c, "y": y[70 * c : 70 * c + 70], "t": t[70 * c : 70 * c + 70], "halo": y[max(0, 70 * c - 32) : 70 * c]} for c in range(5)])
    a, b = fc.fit_group(MODELS[name], whole, 4096), fc.fit_group(MODELS[name], cut, 70)
    assert a["sigma"] == pytest.approx(b["sigma"], rel=1e-6) and np.allclose(a["params"], b["params"], rtol=1e-5, atol=1e-6)


def test_rounds_over_chunks_equal_the_local_fit(spark, series):
    packed = fc.pack_series(series, KEY, 50)
    full = series.groupBy("kpi_id").agg(F.count("*").alias("start")).withColumn("fold", F.lit(fc.FULL))
    near = fc.fit_models(packed, KEY, full, None, 50).toPandas().set_index(["kpi_id", "model"])
    far = fc.fit_models(packed, KEY, full, None, 50, local_chunks=1).toPandas().set_index(["kpi_id", "model"])
    assert len(near) == len(far) == 8
    for at in near.index:
        assert near.loc[at, "sigma"] == pytest.approx(far.loc[at, "sigma"], rel=1e-6)
        assert np.allclose(near.loc[at, "tail"], far.loc[at, "tail"])


def test_models_follow_a_clean_season(spark, series):
    steps = fc.infer_step(series, KEY)
    full = steps.select("kpi_id", F.lit(fc.FULL).alias("fold"), (F.col("n") - 14).alias("start"))
    plan = full.withColumn("fold", F.lit(0))
    guesses = fc.predict(fc.fit_models(fc.pack_series(series, KEY), KEY, plan), KEY, steps, 14)
    scores = fc.score_folds(guesses, fc.fold_actuals(series, KEY, plan, 14), KEY).where("kpi_id = 'a'").toPandas().set_index("model")
    assert (scores.loc[["sarima", "holt_winters", "prophet"], "mape"] < 2.0).all()


def test_forecast_selects_refits_and_dates(series):
    ahead, board, chosen, rejects = fc.forecast(series, KEY, 5, 2, 14, ["holt_winters", "arima"])
    pdf = ahead.where("kpi_id = 'a'").orderBy("step").toPandas()
    assert pdf["timestamp"].tolist() == list(pd.date_range("2025-06-30", periods=5))
    assert (pdf["lower95"] < pdf["yhat"]).all() and set(pdf["trained_on"]) == {180}
    picked = {r["kpi_id"]: r for r in chosen.collect()}
    best = {r["kpi_id"]: r["model"] for r in board.where("rank = 1").collect()}
    assert {k: r["winner"] for k, r in picked.items()} == best
    assert "lowest MAPE" in picked["a"]["reason"]


def test_too_short_series_carry_a_reason(spark):
    rows = spark.createDataFrame(pd.DataFrame({"kpi_id": "s", "timestamp": pd.date_range("2025-01-01", periods=10), "value": wave(10)}))
    full = rows.groupBy("kpi_id").agg(F.count("*").alias("start")).withColumn("fold", F.lit(fc.FULL))
    fits = fc.fit_models(fc.pack_series(rows, KEY), KEY, full).toPandas()
    assert len(fits) == 4 and fits["reason"].str.contains("needs").all()


def test_folds_need_three_test_windows(spark):
    sizes = spark.createDataFrame([("a", 41), ("b", 42), ("c", 100)], "kpi_id string, n long")
    got = {(r["kpi_id"], r["start"]) for r in fc.backtest_folds(sizes, KEY, 4, 14).collect()}
    assert got == {("b", 28), ("c", 44), ("c", 58), ("c", 72), ("c", 86)}


def test_metrics_without_nonzero_actuals(spark):
    rows = spark.createDataFrame([("m", 0.0, 1.0), ("m", 0.0, 3.0)], "model string, value double, yhat double")
    r = fc.forecast_metrics(rows, ["model"]).first()
    assert (r["mae"], r["mape"]) == (2.0, float("inf")) and r["rmse"] == pytest.approx(5**0.5)


def test_unknown_models_are_an_error():
    with pytest.raises(ValueError):
        mo.candidate_models(["nothing"])
    with pytest.raises(ValueError):
        fc.split_candidates(["nothing"])
    assert fc.split_candidates(["gbt", "arima"]) == (["arima"], ["gbt"])


def test_seasonal_naive_short_series(spark):
    rows = spark.createDataFrame([("k", "2025-11", 5.0), ("k", "2025-12", 7.0)], "kpi_id string, month string, value double")
    got = fc.seasonal_naive(rows, KEY, 3).orderBy("step").collect()
    assert [(r["month"], r["yhat"]) for r in got] == [("2026-01", 7.0), ("2026-02", 7.0), ("2026-03", 7.0)]
    method = {r["method"] for r in fc.monthly_forecast(rows, KEY, 3).collect()}
    assert method == {"seasonal_naive"}


def _plain_trees(x, y, place, rounds, depth, rate=0.05, ridge=1.0, seed=42, given=None):
    """The boosted trees of one series by loops over nodes, features and cuts."""
    from gaugeworks.operators import histogram_trees as ht

    edges, codes = ht.bin_features(x)
    start = y.mean() if given is None else 0.0  # weights are given for labels
    fitted, trees = np.full(len(y), start), []

    def grow(rows, all_rows, g, w, some, level):
        if level == depth:
            return -rate * sum(g[i] for i in rows) / (sum(w[i] for i in rows) + ridge)
        best = (1e-12, None)
        total_g, total_w = sum(g[i] for i in rows), sum(w[i] for i in rows)
        for f in some:
            for b in range(ht.BINS - 1):
                left = [i for i in rows if codes[i, f] <= b]
                gl, wl = sum(g[i] for i in left), sum(w[i] for i in left)
                if wl >= 1 and total_w - wl >= 1:
                    gain = gl**2 / (wl + ridge) + (total_g - gl) ** 2 / (total_w - wl + ridge) - total_g**2 / (total_w + ridge)
                    if gain > best[0] + 1e-9 * abs(best[0]):
                        best = (gain, (f, b))
        if best[1] is None:
            return grow(rows, all_rows, g, w, some, level + 1)
        f, b = best[1]
        left, right = [i for i in rows if codes[i, f] <= b], [i for i in rows if codes[i, f] > b]
        return f, edges[f, b], grow(left, left, g, w, some, level + 1), grow(right, right, g, w, some, level + 1)

    def walk(tree, v):
        while isinstance(tree, tuple):
            tree = tree[2] if v[tree[0]] <= tree[1] else tree[3]
        return tree

    for turn in range(rounds):
        w = (ht.draws(place, turn, seed) < 0.85).astype(float)
        g = -w * (y - fitted)
        if given is not None:
            p = 1 / (1 + np.exp(-fitted))
            g, w = w * given * (p - y), w * given * p * (1 - p)
        some = np.sort(np.random.default_rng([seed, turn]).permutation(x.shape[1])[: max(1, round(0.85 * x.shape[1]))])
        tree = grow(list(range(len(y))), None, g, w, some.tolist(), 0)
        trees.append(tree)
        fitted = fitted + np.array([walk(tree, v) for v in x])
    return fitted, lambda v: start + sum(walk(t, v) for t in trees)


def test_trees_equal_plain_loops_whatever_the_batch():
    from gaugeworks.operators import histogram_trees as ht

    rng = np.random.default_rng(4)
    many = [rng.normal(size=(n, 4)).round(1) for n in (60, 45, 90)]
    ys = [3 * np.sin(x[:, 0] * 2) + x[:, 1] + rng.normal(0, 0.1, len(x)) for x in many]
    places = [np.arange(len(x)) + 1 for x in many]
    forest, fitted = ht.fit_forest(many, ys, places, rounds=4, depth=3)
    probe = rng.normal(size=(3, 4))
    got = forest.predict(probe)
    for i, (x, y) in enumerate(zip(many, ys)):
        want, ahead = _plain_trees(x, y, places[i], 4, 3)
        assert np.allclose(fitted[i], want, rtol=1e-9, atol=1e-9) and got[i] == pytest.approx(ahead(probe[i]))
        alone, own = ht.fit_forest([x], [y], [places[i]], rounds=4, depth=3)
        assert np.array_equal(own[0], fitted[i]) and alone.predict(probe[i : i + 1])[0] == got[i]


def test_labels_are_fitted_as_by_plain_loops():
    from gaugeworks.operators import histogram_trees as ht

    rng = np.random.default_rng(8)
    x = rng.normal(size=(80, 3)).round(1)
    y = (x[:, 0] + rng.normal(0, 0.3, 80) > 0.8).astype(float)
    given = np.where(y == 1, 3.0, 1.0)
    forest, fitted = ht.fit_forest([x], [y], [np.arange(80)], "logistic", rounds=5, depth=3, weights=[given])
    want, ahead = _plain_trees(x, y, np.arange(80), 5, 3, given=given)
    assert np.allclose(fitted[0], want, rtol=1e-9, atol=1e-9)
    values = ht.forest_values(forest.feature[:, 0], forest.above[:, 0], forest.leaf[:, 0], x, step=7)
    assert np.allclose(values, want) and np.allclose(values[:5], [ahead(v) for v in x[:5]])


@pytest.mark.parametrize("kind", ["gbt", "random_forest"])
def test_trees_learn_and_draw_the_same_rows(kind):
    from gaugeworks.operators import histogram_trees as ht

    rng = np.random.default_rng(5)
    x = rng.uniform(-2, 2, size=(500, 3))
    y = np.where(x[:, 0] > 0, 5.0, -5.0) + x[:, 1] ** 2
    _, fitted = ht.fit_forest([x], [y], [np.arange(500)], kind, rounds=100, depth=5)
    assert np.std(fitted[0] - y) < 0.15 * np.std(y)
    luck = ht.draws(np.arange(20_000), 3, 42)
    assert abs((luck < 0.85).mean() - 0.85) < 0.01 and abs(np.corrcoef(luck, ht.draws(np.arange(20_000), 4, 42))[0, 1]) < 0.03


def test_constant_series_and_repeated_values():
    from gaugeworks.operators import histogram_trees as ht

    forest, fitted = ht.fit_forest([np.zeros((30, 2))], [np.full(30, 7.0)], [np.arange(30)], rounds=3)
    assert np.allclose(fitted[0], 7.0) and np.allclose(forest.predict(np.ones((1, 2))), 7.0)


def test_a_long_series_is_a_committee_of_blocks(spark, series):
    steps = fc.infer_step(series, KEY)
    at = steps.select(*KEY, F.lit(0).alias("fold"), F.col("n").alias("start"))
    whole, cut = (bo.tree_forecast(series, KEY, at, steps, 4, rounds=30, depth=3, block=n).toPandas().sort_values([*KEY, "step"]) for n in (1000, 60))
    assert len(whole) == len(cut) and (cut["lower95"] < cut["yhat"]).all()
    assert np.allclose(whole["yhat"], cut["yhat"], rtol=0.25) and not np.allclose(whole["yhat"], cut["yhat"])


def test_tree_step_features_equal_the_pipeline(spark, series):
    from gaugeworks.operators.features import FeatureConfig, FeaturePipeline

    cfg = FeatureConfig(keys=KEY, diffs=())
    pipe = FeaturePipeline(cfg)
    last = pipe.fit_transform(series).where("kpi_id = 'a' AND timestamp = '2025-06-29'").first()
    us = lambda s: int(pd.Timestamp(s).value // 1000)
    past = np.array(wave(180, 5.0, 0)[:-1], dtype=float)
    averages = [pd.Series(past).ewm(alpha=a, adjust=False).mean().iloc[-1] for a in cfg.ema_alphas]
    short = np.full(28, np.nan)
    short[-3:] = [4.0, 6.0, 8.0]
    rows = bo.next_features(
        np.stack([past[-28:], short]), np.array([averages, averages]), np.array([us("2025-06-29")] * 2), np.array([us("2025-01-01")] * 2), cfg, pipe.columns
    )
    got, few = (dict(zip(pipe.columns, r)) for r in rows)
    for name in pipe.columns:
        assert got[name] == pytest.approx(last[name]), name
    assert (few["lag_1"], few["lag_7"], few["roll_mean_7"], few["roll_std_7"], few["roll_max_28"]) == (8.0, 0.0, 6.0, 2.0, 0.0)


def test_backtest_without_keys_has_all_folds(spark):
    import datetime as dt

    from gaugeworks.operators import forecast as fc

    rows = [(dt.datetime(2024, 1, 1) + dt.timedelta(i), 100.0 + i % 7) for i in range(120)]
    df = spark.createDataFrame(rows, "timestamp timestamp, value double")
    assert len({r.fold for r in fc.backtest(df, [], ["holt_winters"]).collect()}) == 4


def test_short_series_are_rejected_with_a_reason(spark):
    import datetime as dt

    from gaugeworks.operators import forecast as fc

    rows = [(k, dt.datetime(2024, 1, 1) + dt.timedelta(i), 100.0 + i % 7) for k, n in (("long", 120), ("short", 35)) for i in range(n)]
    df = spark.createDataFrame(rows, "k string, timestamp timestamp, value double")
    _ahead, _board, chosen, rejects = fc.forecast(df, ["k"], 5, 2, 14, ["holt_winters"])
    assert [r.k for r in chosen.collect()] == ["long"]
    assert [(r.k, r.n) for r in rejects.collect()] == [("short", 35)]


def test_trees_do_not_mix_scales(spark):
    import datetime as dt
    import math

    from gaugeworks.operators import boosting as bo
    from gaugeworks.operators import forecast as fc
    from pyspark.sql import functions as F

    def rows(k, size):
        return [(k, dt.datetime(2024, 1, 1) + dt.timedelta(i), size * (100 + 10 * math.sin(i / 5))) for i in range(160)]

    def ahead(data):
        df = spark.createDataFrame(data, "k string, timestamp timestamp, value double")
        steps = fc.infer_step(df, ["k"])
        at = steps.select("k", F.lit(0).alias("fold"), F.col("n").alias("start"))
        out = bo.tree_forecast(df, ["k"], at, steps, 5, "gbt", rounds=10, depth=4)
        return {r.step: r.yhat for r in out.where("k = 'a'").collect()}

    alone, mixed = ahead(rows("a", 1)), ahead(rows("a", 1) + rows("b", 1e4))
    assert alone == mixed  # every series has its own model
