"""Isolation forest, one per series: sampled, built and scored in parallel.

Every tree draws its rows by a hash of (tree, row), so the sample is the same whatever the
partitioning. A block of trees is built in one group, all nodes of a level at once, and a series is
scored by cogrouping parts of its rows with its trees.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from gaugeworks.functions.ordering import join_same
from gaugeworks.operators.histogram_trees import draws
from gaugeworks.session import prepare

TREES = 200
SAMPLE = 256
SEED = 42
BLOCK = 25  # trees built in one group
SCORE_ROWS = 200_000  # rows per scoring group


def _mean_depth(n) -> np.ndarray:
    """Mean path length of an unsuccessful search among n rows."""
    n = np.asarray(n, dtype=float)
    big = np.maximum(n, 3.0)
    out = 2.0 * (np.log(big - 1.0) + np.euler_gamma) - 2.0 * (big - 1.0) / big
    return np.where(n <= 1, 0.0, np.where(n == 2, 1.0, out))


def grow_trees(x: np.ndarray, row: np.ndarray, tree: np.ndarray, seed: int) -> dict[int, dict]:
    """Random splits of the rows of many trees, all nodes of a level at once.

    ``row`` and ``tree`` pair the rows of ``x`` with the trees that drew them. A tree splits down to
    single rows or the depth limit of its size; its nodes are arrays in heap order. The feature and the
    cut of a node come from a hash of (tree, node), so rows may come in any order.
    """
    numbers, tree = np.unique(tree, return_inverse=True)
    sizes = np.bincount(tree)
    limit = np.ceil(np.log2(np.maximum(sizes, 2))).astype(np.int64)
    slots = 2 ** (int(limit.max()) + 1) - 1
    feature = np.full((len(numbers), slots), -1, dtype=np.int64)
    cut, depth = np.zeros((len(numbers), slots)), np.zeros((len(numbers), slots))
    at = np.zeros(len(row), dtype=np.int64)
    for level in range(int(limit.max()) + 1):
        if not len(row):
            break
        order = np.argsort(tree * slots + at, kind="stable")
        row, tree, at = row[order], tree[order], at[order]
        first = np.flatnonzero(np.concatenate([[True], (tree[1:] != tree[:-1]) | (at[1:] != at[:-1])]))
        count, t, node = np.diff(np.append(first, len(row))), tree[first], at[first]
        values = x[row]
        lo, hi = np.minimum.reduceat(values, first), np.maximum.reduceat(values, first)
        usable = hi > lo
        splits = usable.any(axis=1) & (count > 1) & (level < limit[t])
        depth[t[~splits], node[~splits]] = level + _mean_depth(count[~splits])
        place = numbers[t].astype(np.int64) * slots + node
        pick = np.floor(draws(place, 0, seed) * usable.sum(axis=1))
        f = (usable.cumsum(axis=1) > pick[:, None]).argmax(axis=1)
        low, high = lo[np.arange(len(f)), f], hi[np.arange(len(f)), f]
        border = low + draws(place, 1, seed) * (high - low)
        border = np.where(border > low, border, high)  # a draw on the lower end would leave one side empty
        feature[t[splits], node[splits]], cut[t[splits], node[splits]] = f[splits], border[splits]
        mine = np.repeat(np.arange(len(first)), count)
        right = values[np.arange(len(row)), f[mine]] >= border[mine]
        at = 2 * at + 1 + right
        go = splits[mine]
        row, tree, at = row[go], tree[go], at[go]
    out = {}
    for i, n in enumerate(numbers.tolist()):
        used = 2 ** (int(limit[i]) + 1) - 1
        out[n] = {"psi": int(sizes[i]), "feature": feature[i, :used], "cut": cut[i, :used], "depth": depth[i, :used]}
    return out


def mean_depths(x: np.ndarray, trees: pd.DataFrame, step: int = 2000) -> np.ndarray:
    """Mean path length of every row, through all trees at once."""
    slots = max(len(f) for f in trees["feature"])
    feature = np.stack([np.pad(np.asarray(f, dtype=np.int64), (0, slots - len(f)), constant_values=-1) for f in trees["feature"]])
    cut, depth = (np.stack([np.pad(np.asarray(v, dtype=float), (0, slots - len(v))) for v in trees[c]]) for c in ("cut", "depth"))
    t, out = np.arange(len(trees))[None, :], np.empty(len(x))
    for lo in range(0, len(x), step):
        part = x[lo : lo + step]
        line, at = np.arange(len(part))[:, None], np.zeros((len(part), len(trees)), dtype=np.int64)
        while True:
            f = feature[t, at]
            inner = f >= 0
            if not inner.any():
                break
            at = np.where(inner, 2 * at + 1 + (part[line, np.maximum(f, 0)] >= cut[t, at]), at)
        out[lo : lo + step] = depth[t, at].mean(axis=1)
    return out


def sample_rows(rows: DataFrame, keys: Sequence[str], row_id: Sequence[str], trees: int, sample: int, seed: int) -> DataFrame:
    """(keys..., row id, trees ARRAY<INT>): the rows that each tree of a series draws, at most ``sample``
    for a tree, those with the smallest hash of (row, tree).

    Only row ids travel. A row is offered to a tree only below a hash threshold that leaves about one and
    a half times the sample, every task keeps the smallest ``sample`` of what is left, and the last
    ranking sees the survivors.
    """
    ids = [c for c in row_id if c not in keys]
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("__n"))
    offered = join_same(rows.select(*keys, *ids), sizes, keys).withColumn("__h", F.xxhash64(*row_id))
    offered = offered.withColumn("__share", F.lit(1.5 * sample + 64) / F.col("__n")).drop("__n")
    schema = T.StructType([*offered.schema.fields[:-2], T.StructField("tree", T.IntegerType()), T.StructField("luck", T.DoubleType())])
    names = schema.names

    def offer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                part = batch.slice(lo, 1000)
                place = part.column(len(names) - 2).to_numpy().astype(np.uint64)
                share = part.column(len(names) - 1).to_numpy()
                luck = np.stack([draws(place, t, seed) for t in range(trees)], axis=1)
                row, tree = np.nonzero(luck < share[:, None])
                if len(row):
                    kept = part.select(list(range(len(names) - 2))).take(pa.array(row))
                    yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(tree.astype(np.int32)), pa.array(luck[row, tree])], names=names)

    w = Window.partitionBy(*keys, "tree").orderBy("luck", *ids)
    drawn = offered.mapInArrow(offer, schema).withColumn("r", F.row_number().over(w)).where(F.col("r") <= sample)
    return drawn.groupBy(*keys, *ids).agg(F.collect_set("tree").alias("trees"))


def fit_forest(
    rows: DataFrame, keys: Sequence[str], row_id: Sequence[str], trees: int = TREES, sample: int = SAMPLE, seed: int = SEED
) -> DataFrame:
    """One row per series and tree; ``rows`` has the keys, the row id and ``x`` ARRAY<DOUBLE>.

    The features of a drawn row travel once for each block of ``BLOCK`` trees that drew it.
    """
    prepare(rows.sparkSession)
    reals = T.ArrayType(T.DoubleType())
    schema = T.StructType(
        [rows.schema[k] for k in keys]
        + [T.StructField("tree", T.IntegerType()), T.StructField("psi", T.IntegerType()), T.StructField("feature", T.ArrayType(T.IntegerType()))]
        + [T.StructField("cut", reals), T.StructField("depth", reals)]
    )
    drawn = sample_rows(rows, keys, row_id, trees, sample, seed)
    ids = [*keys, *[c for c in row_id if c not in keys]]
    dealt = join_same(rows.select(*ids, "x"), drawn, ids, "inner")
    block = F.array_distinct(F.transform("trees", lambda t: F.floor(t / F.lit(BLOCK)).cast("int")))
    dealt = dealt.withColumn("block", F.explode(block)).select(
        *keys, "block", "x", F.filter("trees", lambda t: F.floor(t / F.lit(BLOCK)) == F.col("block")).alias("trees")
    )

    def build(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        many = [np.asarray(t, dtype=np.int64) for t in pdf["trees"]]
        row = np.repeat(np.arange(len(many)), [len(t) for t in many])
        grown = grow_trees(np.stack(list(pdf["x"])), row, np.concatenate(many), seed)
        return pd.DataFrame([{**dict(zip(keys, key)), "tree": t, **g} for t, g in grown.items()])[schema.names]

    return dealt.groupBy(*keys, "block").applyInPandas(build, schema)


def score_by_parts(
    rows: DataFrame, models: DataFrame, keys: Sequence[str], row_id: Sequence[str], out: str,
    value: Callable[[np.ndarray, pd.DataFrame], np.ndarray],
) -> DataFrame:
    """Adds ``out``, the value of every row's ``x`` under its series' models, null where there are none.

    Rows are spread over hash groups of about ``SCORE_ROWS``; a series' models go to each of its groups.
    """
    sizes = rows.groupBy(*keys).agg(F.ceil(F.count("*") / F.lit(SCORE_ROWS)).cast("int").alias("__g"))
    part = F.pmod(F.xxhash64(*[F.col(c) for c in row_id]), F.col("__g")).cast("int")
    spread = join_same(rows, sizes, keys).withColumn("__part", part).drop("__g")
    copies = join_same(models, sizes, keys, "inner").withColumn("__part", F.explode(F.sequence(F.lit(0), F.col("__g") - 1))).drop("__g")
    schema = T.StructType([*rows.schema.fields, T.StructField(out, T.DoubleType())])
    by = [*keys, "__part"]

    def score(pdf: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        if pdf.empty:
            return pd.DataFrame(columns=schema.names)
        found = value(np.stack(list(pdf["x"])), own) if len(own) else None
        return pdf.assign(**{out: found})[schema.names]

    return spread.groupBy(*by).cogroup(copies.groupBy(*by)).applyInPandas(score, schema)


def score_forest(rows: DataFrame, forest: DataFrame, keys: Sequence[str], row_id: Sequence[str], out: str = "raw") -> DataFrame:
    """Adds the anomaly score 2^(-mean depth / expected depth); higher is more isolated. Rows of series
    without a forest are left out."""

    def value(x: np.ndarray, trees: pd.DataFrame) -> np.ndarray:
        expected = float(_mean_depth(trees["psi"].max()))
        return 2.0 ** (-mean_depths(x, trees.sort_values("tree")) / expected) if expected else np.zeros(len(x))

    return score_by_parts(rows, forest, keys, row_id, out, value).where(F.col(out).isNotNull())
