"""URL filter: rules first, then the ratio of two character language models.

URLs that a rule accepts or rejects are the training examples. Each class gets a Markov model over
the characters of its URLs whose order varies: a symbol's probability mixes all contexts seen at
least twice, the longest weighing most (Witten-Bell). A URL without a rule is judged by the difference of the two
log-likelihoods per character against a threshold that separates the classes best on examples kept
back from the models.

Rules and URL parts are column expressions. The models are fitted on all different URLs that have a
rule, but every fourth of a class, in text order, which are kept back for the threshold. They are tables
of gram counts, never in one place: a gram's probability joins that of the gram one symbol shorter, order
by order, and a URL's score is the sum over its grams, in whole numbers of 2^-32, so that it does not
depend on the order of the rows. Tables that grow with the URLs are joined by shuffles only.

Defined results: a null URL or one without ``://`` has empty host and path and no rule; it is judged
by the models on its whole string (null: empty). Without examples of both classes there is nothing to
compare and URLs without a rule are allowed. Ties on the threshold are allowed. Repeated rows get the
same verdict, and other columns pass through.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gaugeworks.functions.ordering import ordered_index, running_sums
from gaugeworks.llm.registry import query
from gaugeworks.plans.bindings import table
from gaugeworks.session import prepare, stage

ORDER = 5  # characters of the longest context
_BITS = 7  # of a symbol
_START, _END, _OTHER = 2, 3, 127
_UNIT = float(1 << 32)  # of scores that are summed
_SLICE = 1 << 20  # characters cut into grams at once
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: (verdict, host, path) of the registered query.
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    parts = F.coalesce(rest, F.lit(""))
    return (
        F.translate(F.regexp_extract(parts, r"^([^/?#]*)", 1), _UPPER, _LOWER),
        F.regexp_extract(parts, r"^[^/?#]*([^?#]*)", 1),
    )


def apply_rules(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits host or a parent domain and the start of the path, and its verdict."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, domain, start in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith(start)
        name, verdict = F.when(fits, domain + start).otherwise(name), F.when(fits, what).otherwise(verdict)
    return name, verdict


def symbols(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """All texts in a row as 7-bit symbols, each after ORDER start marks and before an end mark, and
    the number of symbols of each text to be predicted."""
    raw = [t.encode("utf-8", "replace") for t in texts]
    joined = (b"\x03" + bytes([_START]) * ORDER).join(raw)
    flat = np.frombuffer(bytes([_START]) * ORDER + joined + bytes([_END]), dtype=np.uint8)
    return np.minimum(flat, _OTHER).astype(np.int64), np.array([len(r) + 1 for r in raw], dtype=np.int64)


def grams(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """For each symbol to be predicted, the ORDER symbols before it and itself as one number."""
    flat, lengths = symbols(texts)
    code = np.zeros(len(flat) - ORDER, dtype=np.int64)
    for k in range(ORDER + 1):
        code = (code << _BITS) | flat[k : len(flat) - ORDER + k]
    starts = np.concatenate([[0], np.cumsum(lengths + ORDER)[:-1]])
    keep = np.repeat(starts - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths) + np.arange(lengths.sum())
    return code[keep], lengths


def _find(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    if not len(keys):
        return np.zeros(len(wanted))
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, values[at], 0)


def fit_markov(texts: Sequence[str], least: int = 2) -> list[tuple[np.ndarray, ...]]:
    """For each order: the grams seen and their counts, the contexts with the count and the number of
    different symbols that follow; contexts seen under ``least`` times go."""
    code, _ = grams(texts)
    model = []
    for order in range(ORDER + 1):
        seen, count = np.unique(code & ((1 << (_BITS * (order + 1))) - 1), return_counts=True)
        context, at = np.unique(seen >> _BITS, return_inverse=True)
        total, kinds = np.bincount(at, weights=count), np.bincount(at)
        kept = total >= least
        model.append((seen[kept[at]], count[kept[at]].astype(float), context[kept], total[kept], kinds[kept].astype(float)))
    return model


def log_likelihood(model: list[tuple[np.ndarray, ...]], code: np.ndarray) -> np.ndarray:
    """Natural log probability of each symbol after its context."""
    p = np.full(len(code), 1.0 / (1 << _BITS))
    for order, (seen, count, context, total, kinds) in enumerate(model):
        gram = code & ((1 << (_BITS * (order + 1))) - 1)
        n, t = _find(context, total, gram >> _BITS), _find(context, kinds, gram >> _BITS)
        mixed = (_find(seen, count, gram) + t * p) / np.maximum(n + t, 1)
        p = np.where(n > 0, mixed, p)
    return np.log(p)


def ratio(accepted, rejected, texts: Sequence[str]) -> np.ndarray:
    """Difference of log-likelihoods per symbol; above 0 a text is more like the accepted ones."""
    if not len(texts):
        return np.zeros(0)
    code, lengths = grams(texts)
    each = log_likelihood(accepted, code) - log_likelihood(rejected, code)
    return np.add.reduceat(each, np.concatenate([[0], np.cumsum(lengths)[:-1]])) / lengths


def threshold(good: np.ndarray, bad: np.ndarray) -> float:
    """The cut with the best mean of the two classes' shares on the right side."""
    cuts = np.unique(np.concatenate([good, bad]))
    cuts = np.concatenate([cuts[:1], (cuts[:-1] + cuts[1:]) / 2])
    right = (good[None, :] >= cuts[:, None]).mean(axis=1) + (bad[None, :] < cuts[:, None]).mean(axis=1)
    best = np.flatnonzero(right == right.max())
    return float(cuts[best[len(best) // 2]])


def _examples(judged: DataFrame) -> DataFrame:
    """Every different text once: (__id, __text, __fit, __held), with the verdict it is an example of in
    ``__fit``, or in ``__held`` for every fourth example of a verdict."""
    texts = judged.groupBy("__text").agg(F.max("__verdict").alias("__told"))
    held = F.col("rn") % 4 == 1
    return stage(
        ordered_index(texts, ["__told"], ["__text"]).select(
            F.monotonically_increasing_id().alias("__id"), "__text",
            F.when(~held, F.col("__told")).alias("__fit"), F.when(held, F.col("__told")).alias("__held"),
        )
    )


def _grams_of(texts: DataFrame) -> DataFrame:
    """(__id, class, code): a row for each symbol of a text; class is 1 in an accepted example, 2 in a
    rejected one, else 0."""
    told = F.when(F.col("__fit") == "allow", 1).when(F.col("__fit") == "block", 2).otherwise(0)

    def cut(batches):
        for pdf in batches:
            size = pdf["__text"].str.len().to_numpy().cumsum() // _SLICE
            for _, part in pdf.groupby(size):
                code, lengths = grams(list(part["__text"]))
                yield pd.DataFrame({
                    "__id": np.repeat(part["__id"].to_numpy(), lengths), "class": np.repeat(part["class"].to_numpy(), lengths), "code": code,
                })

    return texts.select("__id", told.alias("class"), "__text").mapInPandas(cut, "__id long, class int, code long")


def log_ratios(codes: DataFrame, least: int = 2) -> DataFrame:
    """(code, ratio) of (code, allow, block), the counts of every gram in the examples of both classes:
    the difference of the log probabilities of a gram's last symbol, as :func:`fit_markov` and
    :func:`log_likelihood` give it, in whole numbers of 2^-32. Contexts lie in groups of 128 rows at most."""
    known = None
    for order in range(ORDER + 1):
        gram = F.col("code").bitwiseAND(F.lit((1 << (_BITS * (order + 1))) - 1))
        rows = codes.groupBy(gram.alias("gram")).agg(F.sum("allow").alias("allow"), F.sum("block").alias("block"))
        context = Window.partitionBy(F.shiftright("gram", _BITS))
        rows = rows.select(
            "*", *[F.sum(c).over(context).alias(f"n_{c}") for c in ("allow", "block")],
            *[F.count_if(F.col(c) > 0).over(context).alias(f"t_{c}") for c in ("allow", "block")],
        )
        if known is None:
            rows = rows.withColumns({f"p_{c}": F.lit(1.0 / (1 << _BITS)) for c in ("allow", "block")})
        else:
            rows = rows.join(known, F.col("gram").bitwiseAND(F.lit((1 << (_BITS * order)) - 1)) == F.col("shorter"))

        def mixed(c: str) -> Column:
            p, n, t = F.col(f"p_{c}"), F.col(f"n_{c}"), F.col(f"t_{c}")
            return F.when(n >= least, (F.col(c) + t * p) / (n + t)).otherwise(p).alias(f"p_{c}")

        known = rows.select(F.col("gram").alias("shorter"), mixed("allow"), mixed("block"))
    ratio = (F.ln("p_allow") - F.ln("p_block")) * _UNIT
    return known.select(F.col("shorter").alias("code"), F.round(ratio).cast("long").alias("ratio"))


def best_cut(held: DataFrame) -> float:
    """:func:`threshold` of (__held, score) rows: scores are counted, and their prefix sums taken range by
    range; the best cuts are compared in whole numbers."""
    counts = held.groupBy("score").agg(
        F.count_if(F.col("__held") == "allow").alias("good"), F.count_if(F.col("__held") == "block").alias("bad")
    )
    placed = stage(running_sums(counts, [], "score", {"good_upto": "good", "bad_upto": "bad"}))
    good, bad = placed.agg(F.sum("good"), F.sum("bad")).first()
    right = (F.lit(good) - F.col("good_upto") + F.col("good")).cast("decimal(19,0)") * bad
    right = stage(placed.select("score", (right + (F.col("bad_upto") - F.col("bad")).cast("decimal(19,0)") * good).alias("right")))
    best = right.where(F.col("right") == right.agg(F.max("right")).first()[0])
    numbered = stage(ordered_index(best, [], ["score"]))
    above = numbered.where(F.col("rn") == numbered.count() // 2 + 1).first()["score"]
    below = placed.where(F.col("score") < above).agg(F.max("score")).first()[0]
    return above if below is None else (below + above) / 2


def filter_urls(df: DataFrame, rules: Sequence[tuple[str, str, str]], url_col: str = "url") -> DataFrame:
    """Add host, path, rule, verdict and score (log-likelihood difference per character)."""
    prepare(df.sparkSession)
    host, path = url_parts(F.col(url_col))
    rule, verdict = apply_rules(F.col("host"), F.col("path"), rules)
    text = F.when(F.instr(url_col, "://") > 0, F.regexp_replace(url_col, r"^[\s\S]*?://", "")).otherwise(F.col(url_col))
    clash = [c for c in ("host", "path", "rule", "verdict", "score") if c in df.columns and c != url_col]
    parts = df.drop(*clash).withColumns({"host": host, "path": path, "__text": F.coalesce(text, F.lit(""))})
    judged = parts.withColumns({"rule": rule, "__verdict": verdict})
    texts = _examples(judged)
    if texts.agg(F.count_distinct("__fit")).first()[0] < 2:
        return judged.withColumns(
            {"verdict": F.coalesce("__verdict", F.lit("allow")), "score": F.lit(None).cast("double")}
        ).drop("__text", "__verdict")
    found = _grams_of(texts)
    codes = found.groupBy("code").agg(F.count_if(F.col("class") == 1).alias("allow"), F.count_if(F.col("class") == 2).alias("block"))
    ratios = stage(log_ratios(stage(codes)))
    score = (F.sum("ratio") / F.count("*") / _UNIT).alias("score")
    # Spark takes the grams for as small as the compressed texts they are cut from, and would send them all to the driver
    each = found.join(ratios.hint("merge"), "code").groupBy("__id").agg(score)
    scores = stage(texts.join(each.hint("merge"), "__id").select("__text", "__held", "score"))
    cut = best_cut(scores.where("__held IS NOT NULL"))
    scored = judged.join(scores.drop("__held").hint("merge"), "__text")
    return scored.withColumn(
        "verdict", F.coalesce("__verdict", F.when(F.col("score") >= cut, "allow").otherwise("block"))
    ).drop("__text", "__verdict")


@query("op2_url_filter")
def op2_url_filter(spark, sf) -> DataFrame:
    out = filter_urls(table(spark, sf, "pages").select("page_id", "url"), RULES)
    return out.select("page_id", "host", "path", "rule", "verdict", "score")
