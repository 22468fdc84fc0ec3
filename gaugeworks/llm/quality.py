"""A quality classifier: a factorisation machine over words, structure and metadata.

A text is a sparse vector: its words hashed into buckets, with damped counts of length one together, and
one bucket for the bin of every structure statistic and of every metadata column. The score adds a
weight for each feature and, for each pair of features, the product of their values and of two short
vectors, so a word may mean another thing in a text of short lines. The pairs are not visited: their
sum is half of (square of the sum less the sum of squares) for each of the ``rank`` dimensions, which
is linear in the features.

The machine is fitted on a bounded sample, about ``docs`` labelled rows of each label, drawn by hash,
``longest`` characters of each; the start weight then takes the shares of the labels among all labelled
rows. The sample's ids, bounded so, are broadcast to the texts; its features meet in the driver. All
texts are scored whole in one pass without a shuffle; the model has a fixed size.

Defined results: a null text counts as empty; an empty text is scored by its structure; a null metadata
value is a bin of its own; examples with a null label, or one that is not 0 or 1, are left out; a
label given twice counts once, and a document that stands twice lends the text first in order; with one label only, or none, every score is the
smoothed share of label 1; equal texts with equal metadata have equal scores; other columns pass
through, clashing ones are replaced; an empty table gives no row.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeworks.llm.language import held_out
from gaugeworks.llm.registry import query
from gaugeworks.plans.bindings import table
from gaugeworks.session import prepare, stage

BUCKETS = 1 << 15
#: Weight of one structure or metadata feature, where all words together have length one.
_STRUCTURE = 0.5
_CLASSES = {
    "upper": bytes(range(65, 91)), "digit": bytes(range(48, 58)), "stop": b".,;:?!", "mark": bytes([*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]),
    "wide": bytes(range(128, 256)),
}


class _Buckets(dict):
    """The bucket of a word, remembered."""

    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        self[word] = bucket = zlib.crc32(word.encode("utf-8", "replace")) % BUCKETS
        return bucket


def _bin(share: float) -> int:
    """Fine bins near 0 and 1, where shares differ most."""
    return round(6 * math.log((share + 0.002) / (1.002 - share)))


def structure(text: str, words: list[str], counts: Counter) -> list[tuple[str, int]]:
    """Statistics of the form of a text, each as (name, bin)."""
    raw, n = text.encode("utf-8", "replace"), max(1, len(words))
    size = max(1, len(raw))
    lines = [line for line in text.split("\n") if line.strip()]
    out = [(name, _bin((len(raw) - len(raw.translate(None, chars))) / size)) for name, chars in _CLASSES.items()]
    out.append(("distinct", _bin(len(counts) / n)))
    out.append(("top", _bin(max(counts.values(), default=0) / n)))
    out.append(("lines", _bin(len(set(lines)) / max(1, len(lines)))))
    out.append(("word", round(4 * math.log2(1 + sum(map(len, words)) / n))))
    out.append(("line", round(math.log2(1 + n / max(1, len(lines))))))
    out.append(("length", len(words).bit_length()))
    return out


def features(text: str | None, extra: Sequence[tuple[str, object]], buckets: _Buckets) -> tuple[list[int], list[float]]:
    """Buckets and values of a text."""
    text = text or ""
    words = text.lower().split()
    counts = Counter(map(buckets.__getitem__, words))
    damped = [1.0 + math.log(c) for c in counts.values()]
    length = math.sqrt(sum(d * d for d in damped)) or 1.0
    marks = [zlib.crc32(f"\x00{name}\x00{value}".encode("utf-8", "replace")) % BUCKETS for name, value in [*structure(text, words, counts), *extra]]
    return [*counts, *marks], [*(d / length for d in damped), *([_STRUCTURE] * len(marks))]


@dataclass
class FactorMachine:
    """start + weights x + sum over pairs of (factors . factors) x x."""

    start: float
    weights: np.ndarray  # buckets
    factors: np.ndarray  # buckets x rank

    def log_odds(self, at: np.ndarray, x: np.ndarray, first: np.ndarray) -> np.ndarray:
        """For texts whose features lie one after the other, from ``first`` on; none is without."""
        vx = self.factors[at] * x[:, None]
        own = np.add.reduceat(vx, first, axis=0)
        pairs = (own * own).sum(axis=1) - np.add.reduceat((vx * vx).sum(axis=1), first)
        return self.start + np.add.reduceat(self.weights[at] * x, first) + 0.5 * pairs


def fit_machine(
    rows: Sequence[tuple[Sequence[int], Sequence[float]]], y: np.ndarray, rank: int = 8, epochs: int = 8, batch: int = 128,
    rate: float = 0.08, ridge: float = 2e-5, seed: int = 7,
) -> FactorMachine:
    """Logistic loss, steps scaled by the sum of squared slopes."""
    rng = np.random.default_rng(seed)
    model = FactorMachine(0.0, np.zeros(BUCKETS), rng.normal(0, 0.05, (BUCKETS, rank)))
    seen_w, seen_v, seen_s = np.full(BUCKETS, 1e-6), np.full((BUCKETS, rank), 1e-6), 1e-6
    for _ in range(epochs if 0 < y.sum() < len(y) else 0):
        order = rng.permutation(len(rows))
        for lo in range(0, len(order), batch):
            pick = order[lo : lo + batch]
            sizes = np.array([len(rows[i][0]) for i in pick])
            at = np.concatenate([rows[i][0] for i in pick])
            x = np.concatenate([rows[i][1] for i in pick])
            first = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            slope = (1.0 / (1.0 + np.exp(-model.log_odds(at, x, first))) - y[pick]) / len(pick)
            vx = model.factors[at] * x[:, None]
            around = np.repeat(np.add.reduceat(vx, first, axis=0), sizes, axis=0) - vx
            by = np.repeat(slope, sizes) * x
            # slopes of equal features are added up
            rise = np.argsort(at, kind="stable")
            which, start = np.unique(at[rise], return_index=True)
            g_w = np.add.reduceat(by[rise], start) + ridge * model.weights[which]
            g_v = np.add.reduceat((by[:, None] * around)[rise], start, axis=0) + ridge * model.factors[which]
            seen_w[which] += g_w * g_w
            seen_v[which] += g_v * g_v
            seen_s += slope.sum() ** 2
            model.weights[which] -= rate * g_w / np.sqrt(seen_w[which])
            model.factors[which] -= rate * g_v / np.sqrt(seen_v[which])
            model.start -= rate * slope.sum() / math.sqrt(seen_s)
    return model


def _extra(metadata: Sequence[str]) -> list[Column]:
    return [F.col(m).cast("string").alias(f"__m{i}") for i, m in enumerate(metadata)]


def _value(name: str, value: str | None) -> tuple[str, object]:
    """A metadata feature; numbers count by the power of two they reach."""
    try:
        number = float(value)
        return name, (math.copysign(math.ceil(math.log2(1 + abs(number))), number) if math.isfinite(number) else "odd")
    except (TypeError, ValueError):
        return name, value


def learn(
    df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "quality",
    metadata: Sequence[str] = (), docs: int = 4096, longest: int = 20_000,
) -> FactorMachine:
    """The machine for ``labels`` (id, label 0 or 1) of the texts of ``df``."""
    spark = prepare(df.sparkSession)
    ids = df.select(F.col(id_col).alias("__id"))
    known = labels.where(F.col(label).isin(0, 1)).select(F.col(id_col).alias("__id"), F.col(label).cast("int").alias("__y"))
    known = stage(known.distinct().join(ids, "__id", "left_semi"))  # numbers only
    size = {r["__y"]: r["count"] for r in known.groupBy("__y").count().collect()}
    n0, n1 = size.get(0, 0), size.get(1, 0)
    top = 1 << 40
    limit = F.when(F.col("__y") == 1, F.lit(top * docs // max(n1, docs))).otherwise(F.lit(top * docs // max(n0, docs)))
    drawn = known.where(F.pmod(F.xxhash64("__id", F.lit("sample")), F.lit(top)) < limit)
    texts = df.select(F.col(id_col).alias("__id"), F.substring(text, 1, longest).alias("__t"), *_extra(metadata))
    texts = texts.join(F.broadcast(drawn), "__id")  # about docs rows a label
    texts = texts.groupBy("__id", "__y").agg(F.min(F.struct("__t", *[f"__m{i}" for i in range(len(metadata))])).alias("s")).select("__y", "s.*")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        buckets = _Buckets()
        for part in batches:
            rows = []
            for t, y, *more in zip(part["__t"], part["__y"], *[part[f"__m{i}"] for i in range(len(metadata))]):
                at, x = features(t, [_value(m, v) for m, v in zip(metadata, more)], buckets)
                rows.append((int(y), np.array(at, dtype="<i4").tobytes(), np.array(x, dtype="<f4").tobytes()))
            yield pd.DataFrame(rows, columns=["y", "at", "x"])

    found = sorted((r["at"], r["x"], r["y"]) for r in texts.mapInPandas(count, "y int, at binary, x binary").collect()) if n0 + n1 else []
    rows = [(np.frombuffer(at, "<i4"), np.frombuffer(x, "<f4").astype(np.float64)) for at, x, _ in found]
    y = np.array([r[2] for r in found], dtype=np.float64)
    model = fit_machine(rows, y)
    share = math.log((n1 + 1) / (n0 + 1))
    if not 0 < y.sum() < len(y):  # one label, or none: the share is all there is to know
        return FactorMachine(share, model.weights, np.zeros_like(model.factors))
    model.start += share - math.log((y.sum() + 1) / (len(y) - y.sum() + 1))
    return model


def score(
    df: DataFrame, model: FactorMachine, text: str = "text", metadata: Sequence[str] = (), threshold: float = 0.7, step: int = 100_000
) -> DataFrame:
    """Adds score (0 to 1) and predicted (1 if the score is ``threshold`` at least)."""
    spark = prepare(df.sparkSession)
    sent = spark.sparkContext.broadcast(model)  # BUCKETS x (rank + 1) numbers

    @F.pandas_udf("double")
    def rate(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        buckets, machine = _Buckets(), sent.value
        for columns in batches:
            out, at, x, first = [], [], [], []

            def settle() -> None:
                if first:
                    odds = machine.log_odds(np.array(at), np.array(x), np.array(first))
                    out.extend((1.0 / (1.0 + np.exp(-np.clip(odds, -500, 500)))).tolist())
                    at.clear(), x.clear(), first.clear()

            for t, *more in zip(*(columns if metadata else (columns,))):
                more_at, more_x = features(t, [_value(m, v) for m, v in zip(metadata, more)], buckets)
                first.append(len(at))
                at.extend(more_at)
                x.extend(more_x)
                if len(at) > step:
                    settle()
            settle()
            yield pd.Series(out, dtype="float64")

    kept = df.drop(*[c for c in ("score", "predicted") if c in df.columns and c != text and c not in metadata])
    scored = kept.withColumn("__score", rate(F.col(text), *_extra(metadata)))
    rest = [c for c in kept.columns if c not in ("score", "predicted")]
    return scored.select(*rest, F.col("__score").alias("score"), (F.col("__score") >= threshold).cast("int").alias("predicted"))


@query("op11_quality")
def op11_quality(spark, sf) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text", "n_chars")
    held = held_out(F.col("doc_id"))
    model = learn(docs.where(~held), table(spark, sf, "labels").select("doc_id", "quality"), metadata=["n_chars"])
    return score(docs, model, metadata=["n_chars"]).select("doc_id", held.alias("held_out"), "score", "predicted")
