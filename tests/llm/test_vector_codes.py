import hashlib
import math

import numpy as np
import pytest

from gaugeworks.llm import vector_codes as vc

SCHEMA = "vec_id long, embedding array<double>, label int, error long, code string"


def brute(rows, scale=4096, parts=8, entries=16, rounds=6):
    """Plain Python integers, one vector at a time."""
    kept = [(i, v, lab) for i, v, lab in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept = [(i, [math.floor(x * scale) for x in v], lab) for i, v, lab in kept]
    kept = [(i, v + [0] * (-len(v) % parts), lab) for i, v, lab in kept]
    out = []
    for dim in {len(v) for _, v, _ in kept}:
        mine = sorted((r for r in kept if len(r[1]) == dim), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
        cut = [[v[k * dim // parts : (k + 1) * dim // parts] for k in range(parts)] for _, v, _ in mine]
        books = [[list(c[k]) for c in cut[:entries]] for k in range(parts)]

        def nearest(part, book):
            return min((sum((a - b) ** 2 for a, b in zip(part, e)), j) for j, e in enumerate(book))

        for _ in range(rounds):
            for k in range(parts):
                to = [nearest(c[k], books[k])[1] for c in cut]
                for j in range(len(books[k])):
                    own = [c[k] for c, t in zip(cut, to) if t == j]
                    if own:
                        books[k][j] = [sum(x) // len(own) for x in zip(*own)]
        sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
        for (i, _, lab), c in zip(mine, cut):
            found = [nearest(c[k], books[k]) for k in range(parts)]
            out.append((i, lab, "".join(f"{j:02x}" for _, j in found), sum(d for d, _ in found), sha))
    by = {}
    for _, lab, _, e, _ in out:
        by[lab] = by.get(lab, 0) + e
    return sorted((repr(i), lab or -1, code, e, by[lab], sha) for i, lab, code, e, sha in out)


def run(spark, rows, **how):
    df = spark.createDataFrame([(*r, 7, "clash") for r in rows], SCHEMA).repartition(3)
    coded, _ = vc.compress(df, **how)
    assert coded.columns == ["vec_id", "label", "code", "error", "label_error", "codebooks_sha256"]
    return sorted((repr(r[0]), r[1] or -1, *r[2:]) for r in coded.collect())


@pytest.mark.parametrize("spread", [0.3, 900.0])
def test_equals_plain_integers(spark, spread):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(size=16) * spread], int(rng.integers(1, 4)) if i % 5 else None) for i in range(90)]
    assert run(spark, rows) == brute(rows)
    assert run(spark, rows, entries=3, rounds=2, parts=4) == brute(rows, entries=3, rounds=2, parts=4)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, None, 1), (2, [nan] * 8, 1), (3, [inf] + [0.0] * 7, 1), (4, [None] + [0.0] * 7, 1), (5, [0.5] * 8, None), (5, [0.25] * 8, None),
        (5, [0.5] * 8, 2), (None, [-0.1] * 8, 2), (6, [], 2), (7, [1.0, -1.0, 0.3], 3), (8, [0.0] * 8, 3), (9, [-0.0001] * 8, 3),
    ] + [(20 + i, [0.5] * 8, 4) for i in range(40)]
    assert run(spark, rows) == brute(rows) and len(run(spark, rows)) == 48
    assert run(spark, rows[:4]) == [] and run(spark, []) == []


def test_ties_take_the_first_entry(spark):
    rows = [(1, [0.0] * 8, 1), (2, [2.0] * 8, 1), (3, [1.0] * 8, 1), (4, [1.0] * 8, 1)]
    got = run(spark, rows, entries=2, rounds=0)
    assert [r[2] for r in got] == ["00" * 8, "01" * 8, "00" * 8, "00" * 8] and got == brute(rows, entries=2, rounds=0)


def test_numbers_beyond_64_bits_are_refused(spark):
    with pytest.raises(ValueError):
        run(spark, [(1, [1e12] * 8, 1)])


def test_products_are_exact_beyond_double_precision():
    rng = np.random.default_rng(4)
    a, b = rng.integers(-(2**28), 2**28, (20, 50)), rng.integers(-(2**28), 2**28, (7, 50))
    assert (a.astype(float) @ b.T.astype(float)).astype(np.int64).tolist() != (a @ b.T).tolist()
    for width in (8, 12, 16):
        la, lb = vc.limbs(a, 29, width), vc.limbs(b, 29, width)
        assert all(np.abs(x).max() <= 2**width for x in [*la, *lb])
        assert np.array_equal(sum(x.astype(np.int64) << (i * width) for i, x in enumerate(la)), a)
        assert vc.exact_products(la, lb, width).tolist() == (a @ b.T).tolist()
