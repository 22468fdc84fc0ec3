import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugeworks.llm import quality as q


def corpus(n, seed):
    """Good prose; bad texts repeat themselves, shout, or use certain words."""
    words = ["".join(w) for w in np.random.default_rng(0).choice(list("abcdefgh"), (300, 4))]
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        text = list(rng.choice(words, int(rng.integers(10, 80))))
        kind = i % 6
        if kind == 0:
            text = [text[0]] * len(text)
        elif kind == 1:
            text = [w.upper() + "!!" for w in text]
        elif kind == 2:
            text[:: 5] = ["buy"] * len(text[:: 5])
        rows.append((i, " ".join(text).capitalize() + ".", int(kind > 2)))
    return rows


@pytest.fixture(scope="module")
def trained(spark):
    rows = corpus(600, 1)
    docs = spark.createDataFrame([(i, t, len(t)) for i, t, _ in rows], "doc_id long, text string, n_chars long")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, quality int")
    return docs, labels, q.learn(docs, labels, metadata=["n_chars"])


def test_held_out_accuracy(spark, trained):
    rows = corpus(300, 2)
    docs = spark.createDataFrame([(i, t, len(t)) for i, t, _ in rows], "doc_id long, text string, n_chars long")
    got = {r.doc_id: r for r in q.score(docs, trained[2], metadata=["n_chars"]).collect()}
    assert np.mean([(got[i].score > 0.5) == y for i, _, y in rows]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got.values())


def test_linear_time_sum_equals_all_pairs(trained):
    model, buckets = trained[2], q._Buckets()
    for text in ("one two two three!", "", "a b c d e f g A.B\n\nc"):
        at, x = q.features(text, [("n_chars", 4)], buckets)
        want = model.start + sum(model.weights[a] * v for a, v in zip(at, x))
        for i in range(len(at)):
            for j in range(i):
                want += float(model.factors[at[i]] @ model.factors[at[j]]) * x[i] * x[j]
        got = model.log_odds(np.array([*at, *at]), np.array([*x, *x]), np.array([0, len(at)]))
        assert np.allclose(got, want, rtol=1e-12, atol=1e-12)


def test_features():
    at, x = q.features("Aa aa b", [], q._Buckets())
    assert at[:2] == [zlib.crc32(b"aa") % q.BUCKETS, zlib.crc32(b"b") % q.BUCKETS] and len(at) == 2 + 11
    assert math.isclose(x[0] / x[1], 1 + math.log(2)) and math.isclose(x[0] ** 2 + x[1] ** 2, 1.0)
    assert q.features(None, [], q._Buckets()) == q.features("", [], q._Buckets())


def test_the_slope_is_that_of_the_loss():
    rng = np.random.default_rng(3)
    rows = [(np.unique(rng.integers(0, 40, 6)), None) for _ in range(30)]
    rows = [(at, rng.random(len(at))) for at, _ in rows]
    y = (rng.random(30) < 0.5).astype(float)

    def loss(model):
        odds = [model.log_odds(at, x, np.array([0]))[0] for at, x in rows]
        return np.mean(np.logaddexp(0, odds) - y * odds)

    before = q.fit_machine(rows, y, epochs=0)
    step = q.fit_machine(rows, y, epochs=1, batch=30, rate=1e-4, ridge=0.0)
    assert loss(step) < loss(before)
    for a in (3, 17):  # the first step goes against the sign of the slope, which is measured here
        for f in (0, 5):
            base = loss(before)
            before.factors[a, f] += 1e-6
            rise = loss(before) - base
            before.factors[a, f] -= 1e-6
            assert abs(rise) < 1e-12 or np.sign(before.factors[a, f] - step.factors[a, f]) == np.sign(rise)


def test_odd_rows(odd, empty, spark, trained):
    model = trained[2]
    clash = odd.withColumn("score", F.lit("clash")).withColumn("predicted", F.lit(None).cast("int"))
    got = q.score(clash, model).collect()
    assert len(got) == 11 and all(0 <= r.score <= 1 for r in got)
    same = {r.score for r in got if r.text == "Same text here"}
    assert len(same) == 1 and len({r.score for r in got if not r.text}) == 1
    assert q.score(empty, model).collect() == []
    with_meta = odd.withColumn("n", F.expr("CASE WHEN doc_id = 4 THEN double('nan') WHEN doc_id > 5 THEN doc_id END"))
    assert len(q.score(with_meta, model, metadata=["n", "lang"]).collect()) == 11


def test_labels_that_say_nothing(odd, empty, spark):
    def labels(rows):
        return spark.createDataFrame(rows, "doc_id long, quality int")

    def scores(model):
        return {r.score for r in q.score(odd, model).collect()}

    for rows, share in (([], 0.5), ([(4, None), (5, 7)], 0.5), ([(4, 1), (5, 1), (5, 1), (77, 1)], 3 / 4), ([(None, 1), (4, 0)], 1 / 3)):
        got = scores(q.learn(odd, labels(rows)))
        assert len(got) == 1 and math.isclose(got.pop(), share)
    assert math.isclose(scores(q.learn(empty, labels([(4, 1)]))).pop(), 0.5)


def test_sample_is_bounded_and_repeatable(trained, spark):
    docs, labels, _ = trained
    one, two = (q.learn(docs.repartition(n), labels.repartition(n + 1), docs=30) for n in (2, 5))
    assert np.array_equal(one.factors, two.factors) and one.start == two.start
    used = (one.weights != 0).sum()
    assert 0 < used < (q.learn(docs, labels).weights != 0).sum()
