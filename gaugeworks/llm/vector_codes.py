"""Product codes of vectors in whole numbers: exact matrix products from limbs.

Every component becomes an integer, every vector is cut into equal parts, and every part position has
a codebook. Squared distances of parts to entries come from matrix products in double precision, made
exact by limbs: an integer is split into limbs of ``LIMB`` bits (the top one keeps the sign), so a
product of two limbs summed over a part stays below 2^53; the products of all pairs of limbs are
shifted and added in 64-bit integers. The first smallest distance wins, so an answer depends on neither
the order of the additions nor the number of tasks.

A round is one pass over the table: tasks assign their rows, add up the parts of every entry and send
one row for each component of each entry. Only codebooks (entries x vector length numbers) reach the
driver and travel to the tasks. The integers are written once and read by all rounds.

Defined results: rows whose vector is null or holds a null or non-finite component are dropped; all
other rows count, repeated ones as often as they stand, those without id last in the order that seeds
the codebooks; rows with equal ids stand in the order of their components. A length that the parts do
not divide is filled up with zeros. Vectors of each length have codebooks of their own; with fewer
vectors than entries a codebook is shorter. An empty table gives no row. Other columns are ignored.
Numbers whose distances would not fit 64 bits raise ValueError, as the result columns could not hold
them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from gaugeworks.functions.ordering import join_same
from gaugeworks.llm.registry import query
from gaugeworks.plans.bindings import table
from gaugeworks.session import prepare, stage

LIMB = 12
_SUMS = "dim int, part int, entry int, position int, total long, n long"
Codebooks = dict[int, list[np.ndarray]]  # by vector length: for each part, entries x components


def limbs(x: np.ndarray, bits: int, width: int = LIMB) -> list[np.ndarray]:
    """``x`` = sum of limb i shifted by i * width, for integers of at most ``bits`` bits and a sign."""
    out = []
    for _ in range(max(1, -(-bits // width) - 1)):
        out.append((x & ((1 << width) - 1)).astype(np.float64))
        x = x >> width
    return [*out, x.astype(np.float64)]


def exact_products(a: list[np.ndarray], b: list[np.ndarray], width: int = LIMB) -> np.ndarray:
    """Dot products of the rows of a with the rows of b, both as limbs."""
    total = np.zeros((len(a[0]), len(b[0])), dtype=np.int64)
    for i, left in enumerate(a):
        for j, right in enumerate(b):
            total += (left @ right.T).astype(np.int64) << (width * (i + j))
    return total


class Assigner:
    """The nearest entry of every part, for vectors of one length."""

    def __init__(self, books: list[np.ndarray], bits: int):
        self.books, self.bits = books, bits
        self.limbs = [limbs(b, bits) for b in books]
        self.norms = [(b * b).sum(axis=1) for b in books]

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(entry, squared distance) for each row and part."""
        width, split = x.shape[1] // len(self.books), limbs(x, self.bits)
        entry = np.empty((len(x), len(self.books)), dtype=np.int64)
        far = np.empty_like(entry)
        for k, (book, norm) in enumerate(zip(self.limbs, self.norms)):
            own = slice(k * width, (k + 1) * width)
            square = (x[:, own] * x[:, own]).sum(axis=1)
            d = square[:, None] + norm[None, :] - 2 * exact_products([s[:, own] for s in split], book)
            entry[:, k] = d.argmin(axis=1)
            far[:, k] = d[np.arange(len(x)), entry[:, k]]
        return entry, far

    def sums(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each part and entry: the componentwise sum of the parts assigned to it, and their number."""
        entry, _ = self.nearest(x)
        width, size = x.shape[1] // len(self.books), len(self.books[0])
        total = np.zeros((len(self.books), size, width), dtype=np.int64)
        for k in range(len(self.books)):
            for j in range(size):
                total[k, j] = x[entry[:, k] == j, k * width : (k + 1) * width].sum(axis=0)
        return total, np.stack([np.bincount(entry[:, k], minlength=size) for k in range(len(self.books))])


def _by_length(vectors: pa.ListArray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, matrix) for every length in a batch of integer lists."""
    ends = vectors.offsets.to_numpy()
    flat, lengths = vectors.values.to_numpy(), np.diff(ends)
    for dim in np.unique(lengths):
        rows = np.flatnonzero(lengths == dim)
        yield rows, flat[ends[rows][:, None] + np.arange(dim)[None, :]].reshape(len(rows), dim)


def digest(books: list[np.ndarray]) -> str:
    """SHA-256 of all integers by part, entry and position."""
    return hashlib.sha256(",".join(str(int(x)) for b in books for x in b.ravel()).encode()).hexdigest()


def integers(df: DataFrame, vec: str, scale: int, parts: int) -> DataFrame:
    """Adds ``ints``, floor(scale * component) filled up to a multiple of ``parts``; rows that cannot be
    coded are gone."""
    finite = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    kept = df.where(F.coalesce(finite, F.lit(False)))
    largest = kept.agg(F.max(F.array_max(F.transform(vec, lambda x: F.abs(x.cast("double"))))).alias("m"), F.max(F.size(vec)).alias("d")).first()
    reach = (largest["m"] or 0.0) * scale + 1
    if (largest["d"] or 0) * (2 * reach) ** 2 >= 2.0**63:
        raise ValueError(f"components up to {largest['m']} give distances beyond 64 bits")
    whole = F.transform(vec, lambda x: F.floor(x.cast("double") * F.lit(float(scale))))
    fill = F.array_repeat(F.lit(0).cast("long"), F.pmod(-F.size(vec), F.lit(parts)))
    return kept.withColumn("ints", F.concat(whole, fill))


def first_codebooks(df: DataFrame, id_col: str, parts: int, entries: int) -> Codebooks:
    """The parts of the ``entries`` rows of smallest id, for each length.

    Ranks run first within hash buckets of the rows, so the last ranking sees a fixed number of rows.
    """
    order = [F.col(id_col).asc_nulls_last(), F.col("ints")]
    rows = df.select(id_col, "ints", F.size("ints").alias("dim"), F.pmod(F.xxhash64(id_col, "ints"), F.lit(256)).alias("bucket"))
    for keys in (["dim", "bucket"], ["dim"]):
        rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= entries)
    found: dict[int, list] = {}
    for r in sorted(rows.collect(), key=lambda r: r["rank"]):
        found.setdefault(r["dim"], []).append(r["ints"])
    return {dim: [b.copy() for b in np.split(np.array(v, dtype=np.int64).reshape(len(v), dim), parts, axis=1)] for dim, v in found.items()}


def refine(df: DataFrame, books: Codebooks, bits: int) -> Codebooks:
    """One round: every entry becomes the floored mean of the parts assigned to it; unused ones stay."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tools, totals = {dim: Assigner(b, bits) for dim, b in books.items()}, {}
        for batch in batches:
            for _, x in _by_length(batch.column(0)):
                total, n = tools[x.shape[1]].sums(x)
                before = totals.get(x.shape[1])
                totals[x.shape[1]] = (total, n) if before is None else (before[0] + total, before[1] + n)
        for dim, (total, n) in totals.items():
            part, entry, position = np.indices(total.shape)
            columns = [np.full(total.size, dim), part.ravel(), entry.ravel(), position.ravel()]
            numbers = [total.ravel(), np.broadcast_to(n[:, :, None], total.shape).ravel()]
            arrays = [pa.array(c, pa.int32()) for c in columns] + [pa.array(c, pa.int64()) for c in numbers]
            yield pa.RecordBatch.from_arrays(arrays, names=["dim", "part", "entry", "position", "total", "n"])

    sums = df.select("ints").mapInArrow(add, _SUMS).groupBy("dim", "part", "entry", "position").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
    new = {dim: [b.copy() for b in v] for dim, v in books.items()}
    for r in sums.where("n > 0").collect():  # one row a component of an entry
        new[r["dim"]][r["part"]][r["entry"], r["position"]] = r["total"] // r["n"]
    return new


def encode(df: DataFrame, books: Codebooks, bits: int, id_col: str, label: str) -> DataFrame:
    """(id, label, code, error, codebooks_sha256) of every row of ``integers``."""
    digests = {dim: digest(b) for dim, b in books.items()}

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tools = {dim: Assigner(b, bits) for dim, b in books.items()}
        for batch in batches:
            codes, shas = np.empty(batch.num_rows, dtype=object), np.empty(batch.num_rows, dtype=object)
            error = np.zeros(batch.num_rows, dtype=np.int64)
            for rows, x in _by_length(batch.column(2)):
                entry, far = tools[x.shape[1]].nearest(x)
                error[rows], shas[rows] = far.sum(axis=1), digests[x.shape[1]]
                codes[rows] = [bytes(e).hex() for e in entry.astype(np.uint8)]
            extra = [pa.array(codes, pa.string()), pa.array(error), pa.array(shas, pa.string())]
            names = [id_col, label, "code", "error", "codebooks_sha256"]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *extra], names=names)

    fields = [df.schema[id_col], df.schema[label]]
    fields += [T.StructField(n, t) for n, t in (("code", T.StringType()), ("error", T.LongType()), ("codebooks_sha256", T.StringType()))]
    return df.select(id_col, label, "ints").mapInArrow(code, T.StructType([T.StructField(f.name, f.dataType) for f in fields]))


def compress(
    df: DataFrame, id_col: str = "vec_id", vec: str = "embedding", label: str = "label",
    scale: int = 4096, parts: int = 8, entries: int = 16, rounds: int = 6,
) -> tuple[DataFrame, Codebooks]:
    """Codes of all vectors, as (id, label, code, error, label_error, codebooks_sha256), and the codebooks.

    ``code`` has two hex digits a part, so ``entries`` may be 256 at most.
    """
    if not 1 <= entries <= 256:
        raise ValueError("entries must be 1 to 256")
    prepare(df.sparkSession)
    whole = stage(integers(df.select(id_col, label, vec), vec, scale, parts).select(id_col, label, "ints"))
    top = whole.agg(F.max(F.greatest(F.abs(F.array_max("ints")), F.abs(F.array_min("ints")))).alias("m")).first()["m"]
    bits, books = int(top or 0).bit_length(), first_codebooks(whole, id_col, parts, entries)
    for _ in range(rounds):
        books = refine(whole, books, bits)
    coded = stage(encode(whole, books, bits, id_col, label))
    by_label = stage(coded.groupBy(label).agg(F.sum("error").alias("label_error")))
    out = join_same(coded, by_label, [label])
    return out.select(id_col, label, "code", "error", "label_error", "codebooks_sha256"), books


def _sql(rounds: int = 6) -> str:
    """Plain integer arithmetic; every round is a pair of named tables."""
    out = ["""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS r, vec_id, label,
    list_transform(embedding, lambda x: floor(x::DOUBLE * 4096)::BIGINT) AS e
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (SELECT r, k, e[k * (len(e) // 8) + 1 : (k + 1) * (len(e) // 8)] AS s FROM v, range(8) t(k)),
c0 AS MATERIALIZED (SELECT k, r - 1 AS j, s FROM p WHERE r <= 16)"""]
    for i in range(rounds + 1):
        out.append(f"""a{i} AS MATERIALIZED (
  SELECT p.r, p.k, min({{'d': list_sum(list_transform(range(1, len(p.s) + 1), lambda i: (p.s[i] - c.s[i]) * (p.s[i] - c.s[i]))), 'j': c.j}}) AS b
  FROM p JOIN c{i} c USING (k) GROUP BY ALL)""")
        if i < rounds:
            out.append(f"""m{i} AS (
  SELECT k, j, i, sum(x) AS t, count(*) AS n
  FROM (SELECT k, a.b.j AS j, unnest(p.s) AS x, generate_subscripts(p.s, 1) AS i FROM a{i} a JOIN p USING (r, k)) GROUP BY ALL),
n{i} AS (SELECT k, j, list(((t - ((t % n) + n) % n) // n)::BIGINT ORDER BY i) AS s FROM m{i} GROUP BY ALL),
c{i + 1} AS MATERIALIZED (SELECT c.k, c.j, coalesce(n.s, c.s) AS s FROM c{i} c LEFT JOIN n{i} n USING (k, j))""")
    out.append(f"""z AS (
  SELECT r, string_agg(lpad(printf('%x', a.b.j), 2, '0'), '' ORDER BY k) AS code, sum(a.b.d)::BIGINT AS error
  FROM a{rounds} a GROUP BY r),
h AS (SELECT sha256(string_agg(array_to_string(s, ','), ',' ORDER BY k, j)) AS codebooks_sha256 FROM c{rounds})
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256
FROM z JOIN v USING (r), h""")
    return ",\n".join(out[:-1]) + ",\n" + out[-1]


@query("op13_vector_codes", _sql())
def op13_vector_codes(spark, sf) -> DataFrame:
    coded, _ = compress(table(spark, sf, "embeddings"))
    return coded.select("vec_id", "code", "error", "label_error", "codebooks_sha256")
