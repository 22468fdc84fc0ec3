"""Forecasting: folds, fits, backtests, selection and result tables.

A series is packed once into chunks of at most ``CHUNK`` values. Series of a few chunks are fitted
in one group per (series, fold, model), which is where the parallelism comes from; longer ones are
fitted by rounds in which every chunk of every series is its own task.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from gaugeworks.functions.ordering import exact_quantiles, join_same, ordered_index, over_series
from gaugeworks.operators import boosting as bo
from gaugeworks.operators import models as mo
from gaugeworks.session import stage

CHUNK = 4096
LOCAL_CHUNKS = 8
HALO = 32  # values before a chunk, enough for the longest lag of any model
DAY_US = 86_400_000_000
FULL = -1  # the fold that trains on all rows


# steps, folds, metrics ---------------------------------------------------------------------


def infer_step(series: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Median microseconds between consecutive rows per series; one day for a single row."""

    def gaps(part, w):
        us = F.unix_micros(F.col("timestamp").cast("timestamp"))
        return part.withColumn("__gap", (us - F.lag(us).over(w)).cast("double"))

    rows = over_series(series.select(*keys, "timestamp"), keys, ["timestamp"], 1, gaps)
    q = exact_quantiles(rows, keys, "__gap", [0.5]).select(*keys, F.element_at("q", 1).alias("__q"))
    known = rows.groupBy(*keys).agg(F.max("timestamp").alias("last"), F.count("*").alias("n"))
    out = join_same(known, q, keys)
    return out.select(*keys, "last", "n", F.coalesce(F.col("__q"), F.lit(float(DAY_US))).cast("long").alias("step_us"))


def future_timestamps(steps: DataFrame, keys: Sequence[str], horizon: int) -> DataFrame:
    """(keys..., step, timestamp) for the ``horizon`` steps after the last row."""
    at = F.unix_micros("last") + F.col("step") * F.col("step_us")
    rows = steps.select(*keys, "last", "step_us", F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("step"))
    return rows.select(*keys, "step", F.timestamp_micros(at).alias("timestamp"))


def backtest_folds(sizes: DataFrame, keys: Sequence[str], folds: int = 4, test_size: int = 14) -> DataFrame:
    """(keys..., n, fold, start): train on the first ``start`` rows, test on the next ``test_size``.

    Series shorter than three test windows have no folds; folds that start before two windows are
    left out.
    """
    i = F.col("fold")
    start = (F.col("n") - (F.lit(folds) - i) * F.lit(test_size)).cast("long")
    rows = sizes.where(F.col("n") >= 3 * test_size).select(
        *keys, "n", F.explode(F.sequence(F.lit(0), F.lit(folds - 1))).alias("fold")
    )
    return rows.select(*keys, "n", "fold", start.alias("start")).where(F.col("start") >= 2 * test_size)


def forecast_metrics(rows: DataFrame, by: Sequence[str], actual: str = "value", predicted: str = "yhat") -> DataFrame:
    """MAE, RMSE and MAPE in percent; MAPE skips zero actuals and is infinite when nothing is left."""
    y, err = F.col(actual), F.col(actual) - F.col(predicted)
    pct = F.when(F.abs(y) > 1e-9, F.abs(err / F.when(F.abs(y) > 1e-9, y)))
    return rows.groupBy(*by).agg(
        F.avg(F.abs(err)).alias("mae"),
        F.sqrt(F.avg(err * err)).alias("rmse"),
        F.coalesce(F.avg(pct) * 100.0, F.lit(float("inf"))).alias("mape"),
        F.count("*").alias("n"),
    )


def interval95(point: Column, sigma: Column, step: Column) -> tuple[Column, Column]:
    half = F.lit(1.96) * F.greatest(sigma, F.lit(1e-9)) * F.sqrt(step)
    return point - half, point + half


def scoreboard(fold_scores: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mean scores per model over its folds, ranked by MAPE, then RMSE, then name."""
    per = fold_scores.groupBy(*keys, "model").agg(
        F.avg("mape").alias("mape"), F.avg("rmse").alias("rmse"), F.avg("mae").alias("mae"), F.count("*").alias("folds")
    )
    w = Window.partitionBy(*keys).orderBy("mape", "rmse", "model")  # one row per candidate model
    return per.withColumn("rank", F.row_number().over(w))


def select_models(board: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Winner, runner-up and the reason, one row per series."""

    def of(rank: int, field: str) -> Column:
        return F.max(F.when(F.col("rank") == rank, F.col(field)))

    best = board.groupBy(*keys).agg(
        of(1, "model").alias("winner"), of(1, "mape").alias("winner_mape"), of(1, "rmse").alias("winner_rmse"),
        of(1, "mae").alias("winner_mae"), of(1, "folds").alias("winner_folds"),
        of(2, "model").alias("runner_up"), of(2, "mape").alias("runner_up_mape"),
        F.array_join(F.sort_array(F.collect_list("model")), ",").alias("candidates"),
    )
    return best.withColumn("reason", selection_reason())


def selection_reason() -> Column:
    from gaugeworks.functions.text import fixed

    return F.when(
        F.col("runner_up").isNull(),
        F.concat(F.lit("Selected "), "winner", F.lit(" (only model that backtested cleanly).")),
    ).otherwise(
        F.concat(
            F.lit("Selected "), "winner", F.lit(": lowest MAPE ("), fixed(F.col("winner_mape"), 2), F.lit("%) across "),
            F.col("winner_folds").cast("string"), F.lit(" backtest folds. Runner-up "), "runner_up",
            F.lit(" had MAPE "), fixed(F.col("runner_up_mape"), 2), F.lit("%."),
        )
    )


def training_metrics(selected: DataFrame, sizes: DataFrame, keys: Sequence[str], horizon: int) -> DataFrame:
    rows = join_same(selected, sizes.select(*keys, F.col("n").alias("n_train_rows")), keys)
    return rows.select(
        *keys, "winner", F.col("winner_mape").alias("winning_mape"), F.col("winner_rmse").alias("winning_rmse"),
        F.col("winner_mae").alias("winning_mae"), "n_train_rows", F.lit(horizon).alias("horizon"), "candidates",
    )


# packing -----------------------------------------------------------------------------------


def pack_series(series: DataFrame, keys: Sequence[str], chunk: int = CHUNK) -> DataFrame:
    """(keys..., chunk, y, t, halo): arrays of at most ``chunk`` values in time order, and the values
    before them. Rows without a value are left out."""
    rows = ordered_index(series.where("value IS NOT NULL"), keys, ["timestamp"])
    us = F.unix_micros(F.col("timestamp").cast("timestamp"))
    cut = rows.withColumn("chunk", F.floor((F.col("rn") - 1) / F.lit(chunk)).cast("long"))
    packed = cut.groupBy(*keys, "chunk").agg(
        F.sort_array(F.collect_list(F.struct("rn", us.alias("t"), F.col("value").cast("double").alias("y")))).alias("r")
    )
    arrays = packed.select(*keys, "chunk", F.col("r.y").alias("y"), F.col("r.t").alias("t"))
    arrays = stage(arrays)
    tails = arrays.select(*keys, (F.col("chunk") + 1).alias("chunk"), F.slice("y", -F.least(F.size("y"), F.lit(HALO)), HALO).alias("halo"))
    out = join_same(arrays, tails, [*keys, "chunk"])
    return out.withColumn("halo", F.coalesce("halo", F.array().cast("array<double>")))


def _targets(packed: DataFrame, keys: Sequence[str], targets: DataFrame, chunk: int) -> DataFrame:
    """Chunks of every (series, fold), cut at the fold's start."""
    at = F.col("chunk") * F.lit(chunk)
    both = join_same(packed, targets.select(*keys, "fold", "start"), keys, "inner").where(at < F.col("start"))
    n = F.least(F.size("y"), (F.col("start") - at).cast("int"))
    return both.select(
        *keys, "fold", "start", "chunk", F.slice("y", F.lit(1), n).alias("y"), F.slice("t", F.lit(1), n).alias("t"), "halo"
    )


def _fit_schema(keys: Sequence[str], df: DataFrame) -> T.StructType:
    many = T.ArrayType(T.DoubleType())
    return T.StructType(
        [df.schema[k] for k in keys]
        + [
            T.StructField("fold", T.IntegerType()), T.StructField("model", T.StringType()),
            T.StructField("start", T.LongType()), T.StructField("params", many), T.StructField("state", many),
            T.StructField("tail", many), T.StructField("sigma", T.DoubleType()), T.StructField("t_first", T.LongType()),
            T.StructField("t_last", T.LongType()), T.StructField("reason", T.StringType()),
        ]
    )


def _finish(model, params, state, tail, sse, n, t_first, t_last) -> dict:
    ok = np.isfinite(sse) and np.all(np.isfinite(state)) and np.all(np.isfinite(params))
    return {
        "params": list(map(float, params)), "state": list(map(float, state)), "tail": list(map(float, tail)),
        "sigma": max(float(np.sqrt(sse / n)), 1e-9) if ok else None, "t_first": int(t_first), "t_last": int(t_last),
        "reason": None if ok else f"{model.name}: the fit did not converge",
    }


def fit_group(model, chunks: pd.DataFrame, chunk: int) -> dict:
    """Fit one model to one series that fits in a group; ``chunks`` has a row per chunk."""
    chunks = chunks.sort_values("chunk")
    ys = [np.asarray(y, dtype=float) for y in chunks["y"]]
    ts = [np.asarray(t, dtype=float) for t in chunks["t"]]
    n = int(sum(map(len, ys)))
    t_first, t_last = ts[0][0], ts[-1][-1]
    empty = {"params": [], "state": [], "tail": [], "sigma": None, "t_first": int(t_first), "t_last": int(t_last)}
    if n < model.min_rows():
        return {**empty, "reason": f"{model.name}: needs {model.min_rows()} rows, has {n}"}
    tail = np.concatenate([np.asarray(chunks["halo"].iloc[-1], dtype=float), ys[-1]])[-HALO:]
    if isinstance(model, mo.Additive):
        beta, sse = model.solve(sum(model.gram(y, t, t_first, t_last) for y, t in zip(ys, ts)))
        return _finish(model, beta, [], tail, sse, n, t_first, t_last)
    halos = [np.asarray(h, dtype=float) for h in chunks["halo"]]
    center, radius = np.asarray(model.center), model.radius
    for _ in range(mo.ROUNDS):
        points = mo.candidate_points(model, center, radius)
        parts = [
            mo.summarize_chunk(model, y, h, int(c) * chunk, points) for y, h, c in zip(ys, halos, chunks["chunk"])
        ]
        sse, states = mo.combine(model, parts)
        best = int(np.argmin(sse))
        center, radius = points[best], radius * 0.5
    return _finish(model, center, states[best], tail, sse[best], n, t_first, t_last)


def fit_models(
    packed: DataFrame, keys: Sequence[str], targets: DataFrame, names: Sequence[str] | None = None, chunk: int = CHUNK,
    local_chunks: int = LOCAL_CHUNKS,
) -> DataFrame:
    """Fit every named model to every (series, fold) of ``targets``; a failed fit carries a reason.

    ``targets``: (keys..., fold, start) with an optional column ``model`` to fit one model each.
    """
    chosen = mo.candidate_models(names)
    rows = _targets(packed, keys, targets, chunk)
    if "model" in targets.columns:
        rows = join_same(rows, targets.select(*keys, "fold", "model"), [*keys, "fold"], "inner").where(
            F.col("model").isin(list(chosen))
        )
    else:
        rows = rows.withColumn("model", F.explode(F.array(*[F.lit(m) for m in chosen])))
    by = [*keys, "fold", "model"]
    schema = _fit_schema(keys, packed)

    def fit_one(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        out = fit_group(chosen[key[-1]], pdf, chunk)
        return pd.DataFrame([{**dict(zip(by, key)), "start": int(pdf["start"].iloc[0]), **out}])[schema.names]

    short = F.col("start") <= F.lit(local_chunks * chunk)
    fits = rows.where(short).groupBy(*by).applyInPandas(fit_one, schema)
    if targets.where(~short).limit(1).isEmpty():
        return fits
    return fits.unionByName(_fit_long(rows.where(~short), keys, by, chosen, schema, chunk))


def _fit_long(rows: DataFrame, keys, by, chosen, schema: T.StructType, chunk: int) -> DataFrame:
    """Fit long series by rounds: one task per chunk sums it up for all candidates, then one small
    group per series combines the summaries and moves the search on."""
    rows = stage(rows)
    ends = rows.groupBy(*by, "start").agg(
        F.min(F.element_at("t", 1)).alias("t_first"), F.max(F.element_at("t", -1)).alias("t_last"),
        F.max_by(F.concat("halo", "y"), "chunk").alias("tail"),
    )
    ends = ends.withColumn("tail", F.slice("tail", -F.least(F.size("tail"), F.lit(HALO)), HALO))
    centers = F.create_map(*[x for k, m in chosen.items() for x in (F.lit(k), F.array(*[F.lit(float(c)) for c in m.center]).cast("array<double>"))])
    search = stage(ends.withColumn("center", centers[F.col("model")]))
    bits = T.StructType(
        [rows.schema[c] for c in by]
        + [T.StructField("chunk", T.LongType()), T.StructField("gram", T.ArrayType(T.DoubleType())), T.StructField("end", T.ArrayType(T.DoubleType()))]
    )
    fold_schema = T.StructType(
        [rows.schema[c] for c in by]
        + [T.StructField(c, T.ArrayType(T.DoubleType())) for c in ("center", "state")] + [T.StructField("sse", T.DoubleType())]
    )
    for step in range(mo.ROUNDS):
        scale = 0.5**step
        work = join_same(rows.drop("start"), search.select(*by, "center", "t_first", "t_last"), by, "inner")

        def sum_up(batches):
            for pdf in batches:
                out = []
                for r in pdf.itertuples(index=False):
                    model = chosen[r.model]
                    y = np.asarray(r.y, dtype=float)
                    if isinstance(model, mo.Additive):
                        gram, end = model.gram(y, np.asarray(r.t, dtype=float), r.t_first, r.t_last), np.zeros(0)
                    else:
                        points = mo.candidate_points(model, r.center, model.radius * scale)
                        gram, end = mo.summarize_chunk(model, y, np.asarray(r.halo, dtype=float), int(r.chunk) * chunk, points)
                    row = {c: getattr(r, c) for c in [*by, "chunk"]}
                    out.append({**row, "gram": gram.ravel(), "end": end.ravel()})
                yield pd.DataFrame(out, columns=bits.names)

        def choose(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
            model = chosen[key[-1]]
            pdf = pdf.sort_values("chunk")
            if isinstance(model, mo.Additive):
                total = np.sum(np.stack(list(pdf["gram"])), axis=0)
                k = int(np.sqrt(len(total)))
                pick, sse = model.solve(total.reshape(k, k))
                state = []
            else:
                w = 1 + model.dim
                parts = [
                    (np.asarray(g).reshape(-1, w, w), np.asarray(e).reshape(-1, w, model.dim))
                    for g, e in zip(pdf["gram"], pdf["end"])
                ]
                errors, states = mo.combine(model, parts)
                best = int(np.argmin(errors))
                pick, sse, state = [best], errors[best], states[best]
            row = {"center": list(map(float, pick)), "state": list(map(float, state)), "sse": float(sse)}
            return pd.DataFrame([{**dict(zip(by, key)), **row}])[fold_schema.names]

        picked = work.mapInPandas(sum_up, bits).groupBy(*by).applyInPandas(choose, fold_schema)
        joined = join_same(search.drop("state", "sse") if "state" in search.columns else search, picked.withColumnRenamed("center", "__pick"), by, "inner")

        def move(batches):
            for pdf in batches:
                nxt = []
                for r in pdf.itertuples(index=False):
                    model = chosen[r.model]
                    pick = np.asarray(r.pick, dtype=float)
                    if not isinstance(model, mo.Additive):
                        pick = mo.candidate_points(model, np.asarray(r.center), model.radius * scale)[int(pick[0])]
                    nxt.append(list(map(float, pick)))
                pdf = pdf.copy()
                pdf["center"] = nxt
                yield pdf[names]

        moved = joined.withColumnRenamed("__pick", "pick")
        names = [c for c in moved.columns if c != "pick"]
        search = stage(moved.mapInPandas(move, T.StructType([moved.schema[c] for c in names])))
    ok = F.col("sse") < float("inf")
    return search.select(
        *by, "start", F.col("center").alias("params"), "state", "tail",
        F.when(ok, F.greatest(F.sqrt(F.greatest(F.col("sse"), F.lit(0.0)) / F.col("start")), F.lit(1e-9))).alias("sigma"),
        "t_first", "t_last", F.when(~ok, F.concat("model", F.lit(": the fit did not converge"))).alias("reason"),
    ).select(*schema.names)


def predict(fits: DataFrame, keys: Sequence[str], steps: DataFrame, horizon: int) -> DataFrame:
    """(keys..., fold, model, step, yhat, lower95, upper95) for fits that succeeded."""
    known = mo.candidate_models()
    ready = join_same(fits.where("reason IS NULL"), steps.select(*keys, "step_us"), keys)
    lead = [*keys, "fold", "model"]
    many = T.ArrayType(T.DoubleType())
    schema = T.StructType([ready.schema[c] for c in lead] + [T.StructField(c, many) for c in ("yhat", "lower95", "upper95")])

    def run(batches):
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                model = known[r.model]
                if isinstance(model, mo.Additive):
                    t = r.t_last + np.arange(1, horizon + 1) * float(r.step_us)
                    point = model.design(t, r.t_first, r.t_last) @ np.asarray(r.params)
                    half = np.full(horizon, 1.96 * r.sigma)
                else:
                    point, half = model.forecast(np.asarray(r.params), np.asarray(r.state), list(r.tail), int(r.start), horizon, r.sigma)
                row = {c: getattr(r, c) for c in lead}
                out.append({**row, "yhat": point, "lower95": point - half, "upper95": point + half})
            yield pd.DataFrame(out, columns=schema.names)

    arrays = ready.mapInPandas(run, schema)
    return arrays.select(
        *lead, F.posexplode(F.arrays_zip("yhat", "lower95", "upper95")).alias("step", "z")
    ).select(*lead, (F.col("step") + 1).alias("step"), "z.yhat", "z.lower95", "z.upper95")


# backtest and forecast ---------------------------------------------------------------------


def fold_actuals(series: DataFrame, keys: Sequence[str], folds: DataFrame, test_size: int) -> DataFrame:
    """(keys..., fold, step, timestamp, value): the test rows of every fold."""
    rows = ordered_index(series.where("value IS NOT NULL"), keys, ["timestamp"])
    at = join_same(rows, folds.select(*keys, "fold", "start"), keys, "inner")
    step = (F.col("rn") - F.col("start")).cast("int")
    return at.where((step >= 1) & (step <= test_size)).select(*keys, "fold", step.alias("step"), "timestamp", "value")


def score_folds(predictions: DataFrame, actuals: DataFrame, keys: Sequence[str]) -> DataFrame:
    rows = join_same(predictions, actuals, [*keys, "fold", "step"], "inner")
    rows = rows.where(~F.isnan("yhat") & (F.abs("yhat") < float("inf")))
    return forecast_metrics(rows, [*keys, "model", "fold"])


def split_candidates(names: Sequence[str] | None) -> tuple[list[str], list[str]]:
    """(recursion models, tree models) among ``names``; all of them without names, error for none."""
    known = list(mo.candidate_models())
    wanted = [*known, *bo.KINDS] if names is None else list(names)
    plain, trees = [n for n in known if n in wanted], [n for n in bo.KINDS if n in wanted]
    if not plain and not trees:
        raise ValueError(f"no forecasting model among {names}")
    return plain, trees


def all_predictions(
    series: DataFrame, packed: DataFrame, keys: Sequence[str], targets: DataFrame, steps: DataFrame, horizon: int,
    names: Sequence[str] | None, chunk: int = CHUNK, tree_rounds: int = 400, local_chunks: int = LOCAL_CHUNKS,
) -> DataFrame:
    """Predictions of every candidate for every (series, fold); with a column ``model`` in
    ``targets`` only that model of each series is fitted."""
    plain, trees = split_candidates(names)
    parts = []
    if plain:
        parts.append(predict(fit_models(packed, keys, targets, plain, chunk, local_chunks), keys, steps, horizon))
    for kind in trees:
        at = targets.where(F.col("model") == kind) if "model" in targets.columns else targets
        if "model" in targets.columns and at.limit(1).isEmpty():
            continue
        parts.append(bo.tree_forecast(series, keys, at, steps, horizon, kind, tree_rounds))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def backtest(
    series: DataFrame, keys: Sequence[str], names: Sequence[str] | None = None, folds: int = 4, test_size: int = 14,
    chunk: int = CHUNK, tree_rounds: int = 400,
) -> DataFrame:
    """Scores (keys..., model, fold, mae, rmse, mape) of every candidate on every fold."""
    steps = stage(infer_step(series, keys))
    plan = stage(backtest_folds(steps, keys, folds, test_size))
    packed = stage(pack_series(series, keys, chunk))
    guesses = all_predictions(series, packed, keys, plan, steps, test_size, names, chunk, tree_rounds)
    return score_folds(guesses, fold_actuals(series, keys, plan, test_size), keys)


def forecast(
    series: DataFrame, keys: Sequence[str], horizon: int, folds: int = 4, test_size: int = 14,
    names: Sequence[str] | None = None, chunk: int = CHUNK, tree_rounds: int = 400,
) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Backtest, pick the winner per series, refit it on all rows: (forecast, scoreboard, selection, rejects)."""
    steps = stage(infer_step(series, keys))
    packed = stage(pack_series(series, keys, chunk))
    plan = stage(backtest_folds(steps, keys, folds, test_size))
    guesses = all_predictions(series, packed, keys, plan, steps, test_size, names, chunk, tree_rounds)
    scores = score_folds(guesses, fold_actuals(series, keys, plan, test_size), keys)
    board = stage(scoreboard(scores, keys))
    chosen = stage(select_models(board, keys))
    full = join_same(steps, chosen, keys, "inner").select(
        *keys, F.lit(FULL).alias("fold"), F.col("n").alias("start"), F.col("winner").alias("model")
    )
    ahead = all_predictions(series, packed, keys, stage(full), steps, horizon, names, chunk, tree_rounds).drop("fold")
    dated = join_same(ahead, future_timestamps(steps, keys, horizon), [*keys, "step"], "inner")
    out = join_same(dated, steps.select(*keys, F.col("n").alias("trained_on")), keys)
    return out.select(*keys, "step", "timestamp", "yhat", "lower95", "upper95", "model", "trained_on"), board, chosen, rejected(
        series, keys, steps, plan, chosen, test_size
    )


def rejected(
    series: DataFrame, keys: Sequence[str], steps: DataFrame, plan: DataFrame, chosen: DataFrame, test_size: int
) -> DataFrame:
    """(keys..., n, reason): the series without a forecast."""
    everyone = series.groupBy(*keys).agg(F.count("value").alias("n"))
    marks = [
        (plan.groupBy(*keys).agg(F.lit(True).alias("planned")), "planned"),
        (chosen.select(*keys, F.lit(True).alias("won")), "won"),
    ]
    for known, _ in marks:
        everyone = join_same(everyone, known, keys)
    short = F.format_string(f"%d values are too few for a backtest of {test_size}", "n")
    reason = F.when(F.col("planned").isNull(), short).otherwise("no candidate model gave a finite score on any fold")
    return everyone.where("won IS NULL").select(*keys, "n", reason.alias("reason"))


def seasonal_naive(series: DataFrame, keys: Sequence[str], periods: int, season: int = 12) -> DataFrame:
    """(keys..., step, month, yhat): the value one season back, repeated; the last value for series
    shorter than a season. ``series`` has a ``month`` text column (yyyy-MM)."""
    periods = max(1, periods)
    w = Window.partitionBy(*keys).orderBy(F.desc("month"))
    # only the last season of each series is kept; Spark cuts to it before the shuffle
    tail = series.withColumn("back", F.row_number().over(w)).where(F.col("back") <= season)
    arrays = tail.groupBy(*keys).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("month", "value"))), lambda r: r["value"]).alias("v"),
        F.max("month").alias("last"),
    )
    steps = arrays.select(*keys, "v", "last", F.explode(F.sequence(F.lit(1), F.lit(periods))).alias("step"))
    at = F.when(F.size("v") >= season, F.col("v")[(F.col("step") - 1) % season]).otherwise(F.element_at("v", -1))
    month = F.date_format(F.add_months(F.to_date(F.concat("last", F.lit("-01"))), F.col("step")), "yyyy-MM")
    return steps.select(*keys, "step", month.alias("month"), F.round(at, 2).alias("yhat"))


def monthly_forecast(series: DataFrame, keys: Sequence[str], periods: int = 6, chunk: int = CHUNK) -> DataFrame:
    """Holt-Winters with a period of 12 on (keys..., month, value); seasonal-naive where it cannot fit."""
    periods = max(1, periods)
    dated = series.withColumn("timestamp", F.to_timestamp(F.concat("month", F.lit("-01"))))
    packed = pack_series(dated, keys, chunk)
    sizes = dated.where("value IS NOT NULL").groupBy(*keys).agg(F.count("*").alias("start")).withColumn("fold", F.lit(FULL))
    model = mo.Smoothing(period=12)
    rows = _targets(packed, keys, sizes, chunk)
    schema = T.StructType([packed.schema[k] for k in keys] + [T.StructField("p", T.ArrayType(T.DoubleType()))])

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        fit = fit_group(model, pdf, chunk)
        point = None
        if fit["reason"] is None:
            point, _ = model.forecast(np.asarray(fit["params"]), np.asarray(fit["state"]), [], int(pdf["start"].iloc[0]), periods, fit["sigma"])
        return pd.DataFrame([{**dict(zip(keys, key)), "p": point}])[schema.names]

    # a monthly series has twelve rows a year, so one group holds a whole series
    fitted = rows.groupBy(*keys).applyInPandas(run, schema)
    naive = seasonal_naive(series, keys, periods)
    both = join_same(naive, fitted, keys)
    value = F.try_element_at("p", F.col("step"))
    return both.select(
        *keys, "step", "month", F.round(F.coalesce(value, "yhat"), 2).alias("yhat"),
        F.when(value.isNotNull(), "holt_winters").otherwise("seasonal_naive").alias("method"),
    )
