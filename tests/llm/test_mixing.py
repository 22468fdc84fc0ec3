import collections
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugeworks.llm import mixing as mx


def corpus(seed=0):
    rng = np.random.default_rng(seed)
    for i in range(900):
        source = "hot" if i % 3 == 0 else f"s{i % 8}"
        yield i, "w " * int(rng.integers(1, 60)), None, source


def test_power_meets_its_targets():
    sizes = {"a": 900.0, "b": 90.0, "c": 10.0}
    total = sum(sizes.values())
    power = mx.bisect_power(sizes, total, 100.0, 0.8)
    assert mx.entropy(mx.weights_at({k: v / total for k, v in sizes.items()}, power)) == pytest.approx(0.8, abs=1e-6)
    power = mx.bisect_power(sizes, total, 3.0, 0.8)
    weights = mx.weights_at({k: v / total for k, v in sizes.items()}, power)
    assert max(weights[k] * total / sizes[k] for k in sizes) == pytest.approx(3.0, abs=1e-6)
    assert mx.bisect_power({"a": 5.0}, 5.0, 1.0, 1.0) == 1.0
    assert math.fsum(weights.values()) == pytest.approx(1)


@pytest.mark.parametrize("per_range,share,entropy", [(2000, 1.0, 0.97), (5, 1.0, 0.97), (5, 1.7, 0.99), (40, 1.0, 0.0)])
def test_targets_are_realised(docs_of, monkeypatch, per_range, share, entropy):
    monkeypatch.setattr(mx, "RANGE", per_range)
    mixed = mx.mix_sources(docs_of(corpus()), budget_share=share, min_entropy=entropy, max_epochs=50.0)
    by = collections.defaultdict(list)
    for r in mixed.collect():
        by[r.source].append(r)
    assert sum(map(len, by.values())) == 900
    for rows in by.values():
        target = rows[0].epochs * sum(r.n_tokens for r in rows)
        got = sum(r.n_tokens * r.copies for r in rows)
        assert -1e-6 <= target - got < max(r.n_tokens for r in rows)  # the next document would be too much
        assert max(r.copies for r in rows) - min(r.copies for r in rows) <= 1
    assert sum(rows[0].weight for rows in by.values()) == pytest.approx(1)


def test_realise_repeats_rows(docs_of):
    mixed = mx.mix_sources(docs_of(corpus()), min_entropy=0.99, max_epochs=9.0)
    copies = {r.doc_id: r.copies for r in mixed.collect()}
    got = collections.Counter(r.doc_id for r in mx.realise(mixed).collect())
    assert got == {k: n for k, n in copies.items() if n}


def test_without_a_budget_every_document_is_in():
    sizes = {"a": 900.0, "b": 90.0, "c": 10.0}
    power, targets = mx.plan(sizes, None, 2.0, 1.0)
    epochs = {k: targets[k][1] / sizes[k] for k in sizes}
    assert 0 < power < 1 and epochs["a"] == pytest.approx(1) and epochs["c"] == pytest.approx(2, abs=0.06)
    power, targets = mx.plan(sizes, None, 1000.0, 1.0)
    assert power < 1e-6 and {t for _, t in targets.values()} == {900}


@pytest.mark.parametrize("budget,ranges", [(64, 7), (1000, 2), (10**9, 3)])
def test_blocks_against_a_plain_loop(docs_of, monkeypatch, budget, ranges):
    """Which copy stands where, from the hashes of Spark and a loop over the sorted copies."""
    mixed = mx.mix_sources(docs_of(corpus()), **mx.TARGET).select("doc_id", "source", "n_tokens", "epochs", "copies", "mix_key").cache()
    held = mixed.collect()
    assert {r.copies for r in held} == {1, 2}
    longest = max(r.copies for r in held)
    hashes = {
        r.doc_id: r for r in mixed.select("doc_id", *[F.pmod(F.xxhash64("mix_key", F.lit(e).cast("long")), F.lit(1 << 40)).alias(f"h{e}") for e in range(longest)]).collect()
    }
    copies = sorted(
        ((e + hashes[r.doc_id][f"h{e}"] / float(1 << 40)) / r.epochs, r.mix_key, e, r) for r in held for e in range(r.copies)
    )
    expected, before = {}, 0
    for _, _, e, r in copies:
        expected[r.doc_id, e] = (before // budget, before % budget)
        before += r.n_tokens
    plain = mx.in_ranges
    monkeypatch.setattr(mx, "in_ranges", lambda df, keys, order: plain(df, keys, order, ranges))
    got = {(r.doc_id, r.epoch): (r.block, r.position) for r in mx.realise(mixed, budget).collect()}
    assert got == expected
    by_block = collections.Counter()
    for (doc, _), (block, _) in got.items():
        by_block[block] += next(r.n_tokens for r in held if r.doc_id == doc)
    assert all(abs(n - budget) < 60 for b, n in by_block.items() if b < max(by_block))


def test_stretches_have_the_weights(docs_of):
    mixed = mx.mix_sources(docs_of(corpus()), budget_share=None, max_epochs=100.0, min_entropy=1.0)
    rows = mx.in_mix(mixed.select("source", "n_tokens", "weight", "epochs", "copies", "mix_key")).collect()
    for low in (0.0, 0.25, 0.5, 0.75):
        inside = collections.Counter()
        for r in rows:
            if low <= r.place < low + 0.25:
                inside[r.source] += r.n_tokens
        total = sum(inside.values())
        assert all(abs(inside[r.source] / total - r.weight) < 0.05 for r in rows)


def test_written_in_order_keeps_every_copy(docs_of):
    mixed = mx.mix_sources(docs_of(corpus()), **mx.TARGET)
    copies = {r.doc_id: r.copies for r in mixed.collect()}
    rows = mx.written_in_order(mixed).collect()
    assert collections.Counter(r.doc_id for r in rows) == copies
    assert [r.place for r in rows] == sorted(r.place for r in rows) and 0.9 < max(r.place for r in rows) < 1.1


def test_odd_rows(odd, empty):
    got = mx.mix_sources(odd.withColumnRenamed("lang", "copies")).collect()
    assert len(got) == 11 and all(r.copies == 1 for r in got)  # one null source at its share
    assert mx.mix_sources(empty).collect() == [] and mx.realise(mx.mix_sources(empty)).collect() == []
    spread = mx.realise(mx.mix_sources(odd.withColumnRenamed("lang", "block"), **mx.TARGET).drop("text")).collect()
    assert len(spread) == 11 and sorted(r.position for r in spread)[0] == 0 and {r.block for r in spread} == {0}
    assert [r.n_tokens for r in got if r.doc_id in (1, 2, 3, 4)] == [1, 1, 1, 1]
