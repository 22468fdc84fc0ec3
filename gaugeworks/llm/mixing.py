"""Mixing sources by temperature.

Source shares of the tokens are raised to a power and normalised. The power is found by bisection: the
largest one, so the mix closest to the data, at which no source is repeated more than ``max_epochs``
times within the budget and at which the mix has ``min_entropy`` at least (as a share of the entropy of
equal weights). A source's weight times the budget is its target of tokens. The budget is a share of
the tokens of the data, or, without one, the least at which every document is in the mix at least once.

A target is realised in passes over the source, each in an order given by hashes, a new one for every
pass. Whole passes are counted; of the last one the documents up to the target are taken, so a source
comes within one document of its target. Whether a document is in the last pass depends on the tokens
before it in that order: tokens are summed by hash range, a range holds a few thousand documents however
large the source is, and only the range with the cut is looked into.

The mix is the copies of all sources in one order (:func:`realise`). The passes of a source follow each
other and are spread evenly over the mix, so every stretch of it has the sources at about their weights
and the copies of a document stand far apart. It is cut into blocks by a budget of tokens: a copy is in
the block in whose budget its first token falls, and its position is the number of tokens before it
there. A block so is a permutation of what it holds, within one document of its budget.

Defined results: a null source is a source of its own; a document without words counts one token; an
empty table gives an empty table; ties in the order (copies with the same id) are counted together, so
equal rows are taken or left together and stand side by side in either order; other columns pass
through, clashing ones are replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gaugeworks.functions.ordering import carried, in_ranges
from gaugeworks.llm.registry import query
from gaugeworks.plans.bindings import table
from gaugeworks.session import prepare, stage

#: Documents of a hash range.
RANGE = 2000
#: Tokens of a block of the mix.
BLOCK_TOKENS = 1 << 18
_SPACE = 1 << 40  # of the hash that orders a pass


def token_count(text: Column) -> Column:
    """Words of a text, one at least."""
    words = F.size(F.split(F.regexp_replace(F.coalesce(text, F.lit("")), r"^[\t-\r ]+|[\t-\r ]+$", ""), r"[\t-\r ]+"))
    return F.greatest(words, F.lit(1)).cast("long")


def weights_at(shares: dict, power: float) -> dict:
    """Shares raised to a power and normalised."""
    raw = {k: math.exp(power * math.log(v)) for k, v in shares.items()}
    total = math.fsum(raw.values())
    return {k: v / total for k, v in raw.items()}


def entropy(weights: dict) -> float:
    """As a share of the entropy of equal weights; 1 for a single source."""
    if len(weights) < 2:
        return 1.0
    return -math.fsum(w * math.log(w) for w in weights.values() if w > 0) / math.log(len(weights))


def whole_budget(tokens: dict, weights: dict) -> float:
    """The least budget of tokens at which every source is used up once."""
    return max(tokens[k] / w for k, w in weights.items())


def bisect_power(tokens: dict, budget: float | None, max_epochs: float, min_entropy: float, rounds: int = 60) -> float:
    """The largest power in 0..1 whose mix has ``min_entropy``, raised if need be until no source is
    repeated more than ``max_epochs`` times; power 1 (the shares themselves) repeats all alike. Without
    a budget it is :func:`whole_budget` of every power tried."""
    total = math.fsum(tokens.values())
    shares = {k: v / total for k, v in tokens.items()}

    def search(ok, low: float, high: float) -> tuple[float, float]:
        for _ in range(rounds):
            middle = (low + high) / 2
            low, high = (middle, high) if ok(middle) else (low, middle)
        return low, high

    def repeats(power: float) -> float:
        weights = weights_at(shares, power)
        held = whole_budget(tokens, weights) if budget is None else budget
        return max(w * held / tokens[k] for k, w in weights.items())

    power = 1.0
    if entropy(shares) < min_entropy:  # entropy falls as the power grows
        power, _ = search(lambda p: entropy(weights_at(shares, p)) >= min_entropy, 0.0, 1.0)
    if repeats(power) > max_epochs:  # so do the repetitions of the small sources
        _, power = search(lambda p: repeats(p) > max_epochs, power, 1.0)
    return power


def plan(sizes: dict, budget_share: float | None, max_epochs: float, min_entropy: float) -> tuple[float, dict]:
    """The power, and per source its weight and target of tokens. At power 1 the epochs of all sources
    equal ``budget_share``, so a limit below that lowers the budget to what it allows."""
    total = math.fsum(sizes.values())
    budget = None if budget_share is None else min(budget_share, max_epochs) * total
    power = bisect_power(sizes, budget, max_epochs, min_entropy)
    weights = weights_at({k: v / total for k, v in sizes.items()}, power)
    if budget is None:
        budget = whole_budget(sizes, weights)
    return power, {k: (w, round(w * budget)) for k, w in weights.items()}


def mix_sources(
    df: DataFrame, source: str = "source", text: str = "text", id_col: str = "doc_id",
    budget_share: float | None = 1.0, max_epochs: float = 2.0, min_entropy: float = 0.9,
) -> DataFrame:
    """Add n_tokens, weight, epochs (target over tokens of the source), copies (times a row is in the
    mix) and mix_key (a hash of id and text, by which the passes are ordered)."""
    spark = prepare(df.sparkSession)
    added = ("n_tokens", "weight", "epochs", "copies", "mix_key")
    rows = df.drop(*[c for c in added if c in df.columns]).withColumn("n_tokens", token_count(F.col(text)))
    keyed = rows.select(
        F.col(source).alias("__s"), F.xxhash64(F.col(id_col), F.col(text)).alias("__key"), "n_tokens"
    )
    keyed = stage(keyed.groupBy("__s", "__key").agg(F.sum("n_tokens").alias("t"), F.count("*").alias("n")))
    sums = keyed.groupBy("__s").agg(F.sum("t").alias("t"), F.sum("n").alias("n"), F.count("*").alias("k")).collect()
    if not sums:
        return rows.withColumns(
            {"weight": F.lit(0.0), "epochs": F.lit(0.0), "copies": F.lit(0).cast("long"), "mix_key": F.lit(0).cast("long")}
        )
    _, targets = plan({r["__s"]: r["t"] for r in sums}, budget_share, max_epochs, min_entropy)
    facts = [
        (r["__s"], targets[r["__s"]][0], targets[r["__s"]][1] / r["t"], *divmod(targets[r["__s"]][1], r["t"]), max(1, r["k"] // RANGE))
        for r in sums
    ]  # one row a source
    known = spark.createDataFrame(
        facts, f"__s {dict(df.dtypes)[source]}, weight double, epochs double, whole long, left long, ranges long"
    )
    same = F.col("a.__s").eqNullSafe(F.col("b.__s"))
    # the order of the last, partial pass: a hash of the document and the number of the pass
    place = _place("__key", "whole")
    placed = keyed.alias("a").join(known.alias("b"), same).select(
        "a.__s", "__key", "t", "whole", "left", place.alias("place"),
        F.floor(place / F.lit(float(_SPACE)) * F.col("ranges")).alias("range"),
    )
    held = placed.groupBy("__s", "range").agg(F.sum("t").alias("t"), F.first("left").alias("left"))
    before = Window.partitionBy("__s").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    held = held.withColumn("before", F.coalesce(F.sum("t").over(before), F.lit(0)))
    cut = held.where((F.col("before") < F.col("left")) & (F.col("before") + F.col("t") >= F.col("left")))
    cut = stage(cut.select("__s", "range", "before", "left"))  # at most one row a source
    same_range = F.col("p.__s").eqNullSafe(F.col("c.__s")) & (F.col("p.range") == F.col("c.range"))
    inside = placed.alias("p").join(cut.alias("c"), same_range).select("p.__s", "place", "t", "before", "c.left")
    upto = Window.partitionBy("__s").orderBy("place").rangeBetween(Window.unboundedPreceding, 0)
    inside = inside.withColumn("upto", F.col("before") + F.sum("t").over(upto)).where(F.col("upto") <= F.col("left"))
    # all documents up to this place are in the last pass
    ends = inside.groupBy("__s").agg(F.max("place").alias("last"))
    starts = cut.select("__s", "range")
    limits = known.alias("k").join(starts.alias("s"), F.col("k.__s").eqNullSafe(F.col("s.__s")), "left").join(
        ends.alias("e"), F.col("k.__s").eqNullSafe(F.col("e.__s")), "left"
    ).select("k.__s", "weight", "epochs", "whole", "left", "ranges", "s.range", "last")
    limits = stage(limits).withColumnRenamed("__s", "__of")  # one row a source
    out = rows.withColumn("__key", F.xxhash64(F.col(id_col), F.col(text))).join(
        limits, F.col(source).eqNullSafe(F.col("__of"))
    )
    at = F.floor(place / F.lit(float(_SPACE)) * F.col("ranges"))
    taken = (F.col("left") > 0) & F.when(
        F.col("range").isNotNull(), (at < F.col("range")) | ((at == F.col("range")) & (place <= F.coalesce("last", F.lit(-1))))
    ).otherwise(True)
    return out.withColumn("copies", F.col("whole") + F.when(taken, 1).otherwise(0)).withColumnRenamed("__key", "mix_key").drop(
        "__of", "whole", "left", "ranges", "range", "last"
    )


def _place(key: str, epoch: str) -> Column:
    """Where a document stands in a pass of its source, in 0.._SPACE."""
    return F.pmod(F.xxhash64(key, epoch), F.lit(_SPACE))


def in_mix(mixed: DataFrame) -> DataFrame:
    """Every row as often as it has copies, with ``epoch``, the number of the pass from 0, and ``place``
    from 0 to about 1, by which the mix is ordered: pass and place in the pass over the passes of the source."""
    rows = mixed.drop("epoch", "place").where("copies > 0")
    rows = rows.withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
    return rows.withColumn("place", (F.col("epoch") + _place("mix_key", "epoch") / F.lit(float(_SPACE))) / F.col("epochs"))


def realise(mixed: DataFrame, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """The mix: :func:`in_mix` with ``block`` and ``position``. Rows are written once in ranges of the
    order, so hand over the columns that are wanted only; ranges take the tokens before them."""
    order = ["place", "mix_key", "epoch"]
    cut = in_ranges(in_mix(mixed.drop("block", "position")), [], order)
    earlier = Window.partitionBy("__b").orderBy(*order, "__i").rowsBetween(Window.unboundedPreceding, -1)
    inside = cut.withColumn("__in", F.coalesce(F.sum("n_tokens").over(earlier), F.lit(0)))
    rows = inside.join(carried(cut, [], {"__before": F.sum("n_tokens")}), "__b")
    start = F.col("__before") + F.col("__in")
    return rows.withColumn("block", F.floor(start / F.lit(block_tokens)).cast("long")).withColumn(
        "position", start - F.col("block") * F.lit(block_tokens)
    ).drop("__b", "__i", "__in", "__before", "place")


def written_in_order(mixed: DataFrame) -> DataFrame:
    """The copies with all columns, range-partitioned and sorted by their place in the mix."""
    return in_mix(mixed).repartitionByRange("place", "mix_key").sortWithinPartitions("place", "mix_key", "epoch")


#: Equal weights, so far as no source is repeated more than twice; every document at least once.
TARGET = {"budget_share": None, "max_epochs": 2.0, "min_entropy": 1.0}


@query("op7_mix_sources")
def op7_mix_sources(spark, sf) -> DataFrame:
    mixed = mix_sources(table(spark, sf, "documents").select("doc_id", "source", "text"), **TARGET)
    narrow = mixed.select("doc_id", "source", "n_tokens", "weight", "epochs", "copies", "mix_key")
    return realise(narrow).drop("mix_key")
