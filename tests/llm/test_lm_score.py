import collections
import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugeworks.llm import lm_score as lm
from gaugeworks.llm.language import held_out

_LOWER = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(_LOWER)) + ["\n"]


def brute(rows, trained):
    counts = collections.Counter(w for i, t in rows if trained(i) for w in words_of(t))
    n, v = sum(counts.values()), len(counts)
    return [
        (len(w := words_of(t)), sum(counts[x] > 0 for x in w), n, sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in w))
        for _, t in rows
    ]


def check(df, held, trained, **how):
    rows = [(r.doc_id, r.text) for r in df.collect()]
    got = lm.score(df, held, filter_bits=1 << 22, **how).collect()
    want = sorted(brute(rows, trained))
    have = sorted((r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in got)
    for a, b in zip(have, want, strict=True):
        assert a[:3] == b[:3] and math.isclose(a[3], b[3], rel_tol=1e-9)
    return got


def test_base_is_exact(docs_of):
    rng = np.random.default_rng(0)
    vocabulary = [f"W{i}é" for i in range(300)]
    rows = [(i, " ".join(rng.choice(vocabulary, rng.integers(0, 80)))) for i in range(200)]
    check(docs_of(rows), F.col("doc_id") % 3 == 1, lambda i: i % 3 != 1, block_bytes=3000)


def test_odd_rows(odd):
    got = check(odd, F.col("doc_id") % 5 == 0, lambda i: i is None or i % 5 != 0)
    assert {r.n_tokens for r in got if r.doc_id in (1, 2, 3)} == {1}


def test_no_rows_and_no_training_rows(empty, docs_of):
    assert lm.score(empty, F.lit(False)).collect() == []
    got = lm.score(docs_of([(1, "a b"), (2, None)]), F.lit(True), filter_bits=1 << 20).collect()
    assert all(r.train_tokens == 0 and r.n_known == 0 and r.score == pytest.approx(0) or r.n_tokens for r in got)


def test_counts_come_back_within_a_step():
    rng = np.random.default_rng(4)
    keys = rng.integers(0, 2**32, 5000, dtype=np.uint64)
    counts = rng.zipf(1.5, 5000).clip(1, 10**9)
    size = 1 << 18
    bits = np.frombuffer(lm.segment_bits_of(keys, counts, size), dtype=np.uint8)
    bloom = lm.LogFrequencyFilter(1, size, bits)
    back = bloom.counts(keys)
    assert (back >= bloom.means[lm.steps(counts)] - 1e-9).all()  # never too low
    assert (back == bloom.means[lm.steps(counts)]).mean() > 0.95
    absent = bloom.counts(rng.integers(0, 2**32, 5000, dtype=np.uint64))
    assert (absent > 0).mean() < 0.05


def test_word_order_counts(docs_of):
    rows = [(i, "alpha beta gamma delta " * 5) for i in range(100)] + [(500, "alpha beta gamma delta"), (501, "delta beta alpha gamma")]
    got = {r.doc_id: r.score for r in lm.score(docs_of(rows), F.col("doc_id") >= 500, filter_bits=1 << 20, mu=5.0).collect()}
    assert got[500] > got[501] + 2


def test_held_out(spark):
    import zlib

    rows = spark.range(200).select("id", held_out(F.col("id"), 7).alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.id).encode()) % 7 == 2) for r in rows)


@pytest.mark.parametrize("known", [3_000, 300_000])
def test_wrong_probes_do_not_grow_with_the_ngrams(known):
    """The stated rate holds at two sizes, for n-grams that are asked for and for those that are stored."""
    rng = np.random.default_rng(known)
    keys = rng.choice(2**32, known + 50_000, replace=False).astype(np.uint64)
    counts = np.concatenate([rng.zipf(1.8, known).clip(1, 10**6), np.zeros(50_000, dtype=np.int64)])
    size = lm.segment_size(counts[:known])
    bits = np.unpackbits(np.frombuffer(lm.segment_bits_of(keys[:known], counts[:known], size), dtype=np.uint8))
    assert 0.24 < bits.mean() < 0.29
    level = lm.answer_segment(keys, counts)
    rate = lm.wrong_probes(lm.BITS_PER_LEVEL)
    assert rate < 0.005 and (level[known:] > 0).mean() < 1.5 * rate
    over = level[:known] - lm.steps(counts[:known])
    assert (over >= 0).all() and (over > 0).mean() < 2 * rate


def test_score_is_that_of_the_steps(docs_of):
    """Every n-gram in its own bits: scores from the counts' steps, also for held-out texts and unseen pairs."""
    rng = np.random.default_rng(7)
    rows = [(i, " ".join(rng.choice([f"w{k}" for k in range(40)], rng.integers(1, 60)))) for i in range(120)]
    got = {r.doc_id: r for r in lm.score(docs_of(rows), F.col("doc_id") % 4 == 1, mu=7.0, block_bytes=2000).collect()}
    one, two = collections.Counter(), collections.Counter()
    for i, t in rows:
        if i % 4 != 1:
            w = ["", *words_of(t)]
            one.update(w), two.update(zip(w, w[1:]))
    n, v = sum(c for w, c in one.items() if w), sum(bool(w) for w in one)
    mean = lambda c: lm._step_means()[lm.steps(np.array([c]))[0]] if c else 0.0
    off = []
    for i, t in rows:
        w, s = ["", *words_of(t)], 0.0
        for a, b in zip(w, w[1:]):
            s += math.log10((min(mean(two[a, b]), mean(one[a]), mean(one[b])) + 7.0 * (mean(one[b]) + 1) / (n + v + 1)) / (mean(one[a]) + 7.0))
        off.append(abs(got[i].score - s))
    assert np.median(off) < 1e-9 and max(off) < 1.0


def test_a_filter_of_few_bits_is_noise_and_the_sized_one_is_not(docs_of):
    """What a fixed size does to a corpus too large for it."""
    rng = np.random.default_rng(8)
    rows = [(i, " ".join(f"w{k}" for k in rng.integers(0, 5000, 200))) for i in range(300)]
    held = F.col("doc_id") % 4 == 1
    sized = {r.doc_id: r.score for r in lm.score(docs_of(rows), held, mu=1.0).collect()}
    large = {r.doc_id: r.score for r in lm.score(docs_of(rows), held, mu=1.0, filter_bits=1 << 27).collect()}
    small = {r.doc_id: r.score for r in lm.score(docs_of(rows), held, mu=1.0, filter_bits=1 << 15).collect()}
    err = lambda x: np.mean([abs(x[i] - large[i]) / abs(large[i]) for i in large])
    assert err(sized) < 0.02 < 0.2 < err(small)
