"""Nearest neighbours by a block matrix join over int8 products with error bounds.

Vectors are packed into blocks. Every (query block, candidate block) pair is a tile: a product of
int8 codes gives all distances of the tile, each with a bound on its quantisation error. A pair whose
lower bound is above the k-th smallest upper bound of its query cannot be among the k nearest and
goes; the others are recomputed from the original vectors in double precision and kept in a heap of
k entries per query. The bounds are strict, so the result is exact.

A tile holds two blocks of at most ``block`` vectors whatever the table's size, and a tile gives at
most k rows per query. Each block is sent once per block of the other side, n Q (1/block + 1/block)
vectors in all.

Defined results: rows without id, with a null, empty, all-zero vector or one that holds a null or a
non-finite component take no part; vectors are compared with those of their own length only; ties go
to the smaller id; repeated rows are candidates of their own; no query, no row. Other columns are
ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from gaugeworks.llm.registry import query
from gaugeworks.plans.bindings import table
from gaugeworks.session import prepare, stage

_BLOCK = "part int, dim int, ids binary, vectors binary"
_NEAR = "query_id long, vec_id long, score double"


def usable(vec: Column) -> Column:
    """True for a vector that can be compared: finite components, not all of them zero."""
    finite = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce((F.size(vec) > 0) & finite & F.exists(vec, lambda x: x != 0), F.lit(False))


def _blocks(df: DataFrame, parts: int, block: int, kind: str) -> DataFrame:
    """Rows (id, vec) packed into blocks of one length; ``part`` says which task packed them."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, waiting = TaskContext.get().partitionId(), {}

        def give(dim, rows):
            ids = np.array([i for i, _ in rows], dtype="<i8")
            return part, dim, ids.tobytes(), np.stack([v for _, v in rows]).astype(kind).tobytes()

        for batch in batches:
            full = []
            for i, v in zip(batch["id"], batch["vec"]):
                rows = waiting.setdefault(len(v), [])
                rows.append((i, v))
                if len(rows) == block:
                    full.append(give(len(v), rows))
                    waiting[len(v)] = []
            if full:
                yield pd.DataFrame(full, columns=["part", "dim", "ids", "vectors"])
        rest = [give(dim, rows) for dim, rows in waiting.items() if rows]
        if rest:
            yield pd.DataFrame(rest, columns=["part", "dim", "ids", "vectors"])

    return df.repartition(parts).mapInPandas(pack, _BLOCK)


def quantise(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes in -127..127, the scale of each row, and the length of what the codes leave out."""
    scale = np.abs(v).max(axis=1) / 127.0
    codes = np.rint(v / scale[:, None])
    return codes.astype(np.int8), scale, np.sqrt(((v - codes * scale[:, None]) ** 2).sum(axis=1))


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distance of the rows of a to the rows of b, summed component by component in order.

    A pair whose squares could overflow is divided by a power of two first, which changes no leading
    digit; a distance beyond the range of double precision is infinite, one below 1e-162 may be 0.
    """
    total = np.zeros(len(a))
    for j in range(a.shape[1]):
        d = a[:, j] - b[:, j]
        total += d * d
    out = np.sqrt(total)
    largest = np.maximum(np.abs(a).max(axis=1), np.abs(b).max(axis=1))
    huge = np.flatnonzero(largest > 1e150)
    if len(huge):
        unit = np.ldexp(1.0, np.frexp(largest[huge])[1] - 1)
        parts = (a[huge] / unit[:, None]) - (b[huge] / unit[:, None])
        out[huge] = np.sqrt((parts * parts).sum(axis=1)) * unit
    return out


def tile(qid: np.ndarray, q: np.ndarray, cid: np.ndarray, c: np.ndarray, k: int, step: int = 1024) -> pd.DataFrame:
    """The k nearest rows of one candidate block for each row of one query block.

    A pair whose bound is not a finite number (components so large or so small that squares or scales
    leave the range) is kept, and its distance decides.
    """
    with np.errstate(all="ignore"):
        return _tile(qid, q, cid, c, k, step)


def _tile(qid: np.ndarray, q: np.ndarray, cid: np.ndarray, c: np.ndarray, k: int, step: int) -> pd.DataFrame:
    q, c = q.astype(np.float64), c.astype(np.float64)
    q_codes, q_scale, q_rest = quantise(q)
    # whole numbers below 2^24 are exact in single precision, and its product is the fast one
    product = np.float32 if q.shape[1] * 127 * 127 < 2**24 else np.float64
    q_codes = q_codes.astype(product)
    q_norm, heaps = (q * q).sum(axis=1), [[] for _ in qid]
    worst = np.full(len(q), np.inf)  # square of the k-th distance so far
    for at in range(0, len(c), step):
        part, part_id = c[at : at + step], cid[at : at + step]
        codes, scale, rest = quantise(part)
        norm = (part * part).sum(axis=1)
        near = (q_codes @ codes.astype(product).T).astype(np.float64) * (q_scale[:, None] * scale[None, :])
        square = q_norm[:, None] + norm[None, :] - 2.0 * near
        error = 2.0 * (q_rest[:, None] * np.sqrt(norm)[None, :] + (np.sqrt(q_norm) + q_rest)[:, None] * rest[None, :])
        error += 1e-9 * (q_norm[:, None] + norm[None, :])
        own = qid[:, None] == part_id[None, :]
        upper = np.where(own, np.inf, square + error)
        limit = worst
        if len(part) >= k:
            limit = np.minimum(worst, np.partition(upper, k - 1, axis=1)[:, k - 1])
        left, right = np.nonzero(~(square - error > limit[:, None] * (1 + 1e-12)) & ~own)
        for i, j, d in zip(left.tolist(), part_id[right].tolist(), distances(q[left], part[right]).tolist()):
            entry = (-d, -j)
            if len(heaps[i]) < k:
                heapq.heappush(heaps[i], entry)
            elif entry > heaps[i][0]:
                heapq.heapreplace(heaps[i], entry)
        worst = np.square([h[0][0] if len(h) == k else np.inf for h in heaps])
    rows = [(i, -j, -d) for i, h in zip(qid.tolist(), heaps) for d, j in h]
    return pd.DataFrame(rows, columns=["query_id", "vec_id", "score"])


def nearest(
    df: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding", block: int = 4096
) -> DataFrame:
    """The ``k`` rows nearest to every row that ``is_query`` selects: (query_id, rank, vec_id, score)."""
    spark = prepare(df.sparkSession)
    kind = "<f4" if df.schema[vec_col].dataType.elementType == T.FloatType() else "<f8"
    rows = df.where(usable(F.col(vec_col)) & F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("vec"), F.coalesce(is_query, F.lit(False)).alias("asks")
    )
    size = rows.agg(F.count("*").alias("n"), F.count_if("asks").alias("q")).first()
    q_parts, c_parts = max(1, -(-size["q"] // block)), max(1, -(-size["n"] // block))
    asked = stage(_blocks(rows.where("asks").drop("asks"), q_parts, block, kind))
    held = stage(_blocks(rows.drop("asks"), c_parts, block, kind))
    asked = asked.withColumnRenamed("part", "q").withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(c_parts - 1))))
    held = held.withColumnRenamed("part", "c").withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(q_parts - 1))))

    def compare(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"query_id": [], "vec_id": [], "score": []})]
        for a in left.itertuples():
            for b in right.itertuples():
                if a.dim == b.dim:
                    qid, cid = np.frombuffer(a.ids, "<i8"), np.frombuffer(b.ids, "<i8")
                    q, c = np.frombuffer(a.vectors, kind), np.frombuffer(b.vectors, kind)
                    out.append(tile(qid, q.reshape(len(qid), -1), cid, c.reshape(len(cid), -1), k))
        return pd.concat(out, ignore_index=True).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})

    tiles = asked.groupBy("q", "c").cogroup(held.groupBy("q", "c")).applyInPandas(compare, _NEAR)
    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return tiles.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


# Every vector is compared with every query in plain double arithmetic.
_SQL = """
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
d AS (SELECT q.vec_id AS query_id, c.vec_id,
    sqrt(list_sum(list_transform(range(1, len(q.e) + 1), lambda i: (q.e[i] - c.e[i]) * (q.e[i] - c.e[i])))) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id AND len(q.e) = len(c.e)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS rank FROM d)
SELECT query_id, rank::INT AS rank, vec_id, score FROM r WHERE rank <= 10
"""


@query("op9_nearest", _SQL)
def op9_nearest(spark, sf) -> DataFrame:
    return nearest(table(spark, sf, "embeddings"), F.col("vec_id") % 100 == 0)
