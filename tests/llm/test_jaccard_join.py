import re

import numpy as np
import pyarrow as pa
import pytest

from gaugeworks.llm import components as module
from gaugeworks.llm import jaccard_join as jj
from gaugeworks.llm.components import components
from gaugeworks.llm.shingles import shingle_sets

_LOWER = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def set_of(text, width):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(_LOWER))
    return frozenset(tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))) if w else frozenset()


def brute(rows, width, percent):
    sets, up = [set_of(t, width) for _, t in rows], list(range(len(rows)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                up[top(i)] = top(j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[top(i)] = min(least.get(top(i), doc_id), doc_id)
    return sorted(((doc_id, len(s), least.get(top(i), doc_id)) for i, ((doc_id, _), s) in enumerate(zip(rows, sets))), key=str)


def families(seed, percent):
    """Texts in families of edited copies around the limit, beside others of all sizes."""
    rng = np.random.default_rng(seed)
    words, rows = [f"w{i}" for i in range(400)], []
    for _ in range(12):
        base = list(rng.choice(words, int(rng.integers(3, 120))))
        for _ in range(int(rng.integers(1, 12))):
            copy = list(base)
            for _ in range(int(rng.integers(0, max(1, len(base) * (100 - percent) // 150) + 1))):
                copy[int(rng.integers(len(copy)))] = str(rng.choice(words))
            rows.append((len(rows) * 7 % 501, " ".join(copy)))
    return rows


@pytest.mark.parametrize("width,percent,size", [(3, 90, 256), (3, 90, 2), (5, 80, 3)])
def test_equals_brute_force(docs_of, width, percent, size):
    rows = families(width + size, percent)
    got = jj.jaccard_components(docs_of(rows), width=width, percent=percent, group_size=size).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == brute(rows, width, percent)


def test_odd_rows(odd):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    got = jj.jaccard_components(odd).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == brute(rows, 3, 90)
    kept = jj.one_per_component(odd)
    assert kept.columns == odd.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 2, 3, 4, 5, 7, 8, 9]


def test_empty_table(empty):
    assert jj.jaccard_components(empty).collect() == [] and jj.one_per_component(empty).collect() == []


def test_every_pair_above_the_limit_shares_a_row():
    rng = np.random.default_rng(9)
    for percent in (80, 90):
        for _ in range(400):
            n = int(rng.integers(9, 200))
            base = rng.integers(0, 2**63, n * 2, dtype=np.uint64)
            x = np.unique(base[:n])
            drop = int(rng.integers(0, n // 8 + 1))
            y = np.unique(np.concatenate([x[drop:], base[n : n + int(rng.integers(0, n // 8 + 1))]]))
            both = len(np.intersect1d(x, y))
            if 100 * both < percent * (len(x) + len(y) - both) or both == len(x) == len(y):
                continue
            keys, size = jj.matrix_rows(np.concatenate([x, y]), np.array([len(x), len(y)]), percent)
            assert np.intersect1d(keys[: size[0]], keys[size[0] :]).size


def test_sets_of_other_tokens_are_not_tied():
    """Neither by parts that are empty in both nor by a common passage; linked sets are, in any number."""
    rng = np.random.default_rng(5)
    passage = rng.integers(0, 2**63, 150, dtype=np.uint64)
    sets = [rng.integers(0, 2**63, 500, dtype=np.uint64) for _ in range(200)]
    sets += [np.concatenate([passage, rng.integers(0, 2**63, 350, dtype=np.uint64)]) for _ in range(12)]
    sets += [np.concatenate([sets[0][8 * i :], rng.integers(0, 2**63, 4 * i, dtype=np.uint64)]) for i in range(1, 11)]
    sets = [np.unique(s) for s in sets]
    keys, who, need = jj.listed_parts(np.concatenate(sets), np.array([len(s) for s in sets]), 80)
    ties = jj.tied(keys, who, need).groupby(["class", "low"]).agg({"seen": "sum", "need": "min"}).reset_index()
    ties = ties[ties["seen"] >= ties["need"]]
    assert all(x == 0 or x >= 212 for c in ("class", "low") for x in ties[c])
    both = {(y, x) for y, x in zip(ties["class"], ties["low"])}
    for x, a in enumerate(sets):
        for y in range(x + 1, len(sets)):
            inside = len(np.intersect1d(a, sets[y]))
            assert 100 * inside < 80 * (len(a) + len(sets[y]) - inside) or (y, x) in both


def _groups(tokens):
    raw = [jj._narrow(t.astype(np.uint64), 6) for t in tokens]
    return raw


def test_overlaps_are_exact():
    rng = np.random.default_rng(3)
    tokens = [np.unique(np.concatenate([rng.integers(0, 40, 30), rng.integers(0, 10**6, 20)])) for _ in range(70)]
    raw = _groups(tokens)
    a, b = jj.Group(range(30), raw[:30]), jj.Group(range(30, 70), raw[30:])
    for x, y, first in ((a, b, 30), (a, a, 0)):
        for low, total in jj.overlap_rows(x, y, rows=7, step=16):
            for i, row in enumerate(total):
                assert row.tolist() == [len(np.intersect1d(tokens[low + i], tokens[first + j])) for j in range(len(y.sizes))]


@pytest.mark.parametrize("split", [None, 9])
def test_bound_drops_members_but_no_link(split):
    rng = np.random.default_rng(2)
    base = rng.integers(0, 10**9, 60)
    tokens = []
    for i in range(25):
        own = base.copy()
        own[rng.choice(60, int(rng.integers(0, 9)), replace=False)] = rng.integers(0, 10**9)
        tokens.append(np.unique(own))
    raw, up = _groups(tokens), {i: i for i in range(25)}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    one = jj.Group(range(25), raw) if split is None else jj.Group(range(split), raw[:split])
    other = None if split is None else jj.Group(range(split, 25), raw[split:])
    for x, y in jj.links(one, other, 90):
        up[top(x)] = top(y)
    for i in range(25):
        for j in range(i):
            both = len(np.intersect1d(tokens[i], tokens[j]))
            crosses = split is None or (i < split) != (j < split)
            if crosses and 100 * both >= 90 * (len(tokens[i]) + len(tokens[j]) - both):
                assert top(i) == top(j)


def test_shingles():
    flat, n = shingle_sets(pa.array(["A b c a B c", "a b", "a  b", None, " ", "b a"]), 3)
    assert n.tolist() == [3, 1, 1, 0, 0, 1] and flat[3] == flat[4] != flat[5]


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(100, 101), (200, 200)], "a long, b long")
    got = {r.node: r.component for r in components(edges, "a", "b").collect()}
    assert got == {**{i: 1 for i in range(1, 41)}, 100: 100, 101: 100}


def _join_rows(plan):
    """Rows that the joins of an executed plan made."""
    name, below = plan.nodeName(), plan.children()
    if name.startswith("AdaptiveSparkPlan"):
        return _join_rows(plan.executedPlan())
    if "QueryStage" in name:
        return _join_rows(plan.plan())
    own = plan.metrics().apply("numOutputRows").value() if "Join" in name else 0
    return own + sum(_join_rows(below.apply(i)) for i in range(below.size()))


def test_rounds_join_few_edges_again(spark, monkeypatch):
    """Each edge is joined about twice in all rounds together, however far the labels travel."""
    rng = np.random.default_rng(4)
    ids = rng.permutation(2000)
    pairs = [(int(ids[i]), int(ids[i + k])) for i in range(400) for k in range(1, 13)]  # a thick path
    pairs += [(i, i + 1) for i in range(3000, 3300)] + [(5000 + k, 5100) for k in range(60)]
    made, kept = [], module.stage

    def stage(df):
        df.collect()
        made.append(_join_rows(df._jdf.queryExecution().executedPlan()))
        return kept(df)

    monkeypatch.setattr(module, "stage", stage)
    got = {r.node: r.component for r in module.components(spark.createDataFrame(pairs + [(y, x) for x, y in pairs], "a long, b long"), "a", "b").collect()}
    path = {int(i) for i in ids[:412]}
    assert got == {**dict.fromkeys(path, min(path)), **dict.fromkeys(range(3000, 3301), 3000), **dict.fromkeys([*range(5000, 5060), 5100], 5000)}
    assert 2 * len(pairs) <= sum(made) < 5 * len(pairs)


def test_components_of_random_graphs(spark):
    rng = np.random.default_rng(8)
    for n, m in ((30, 12), (200, 180), (200, 500)):
        pairs = [(int(x), int(y)) for x, y in rng.integers(0, n, (m, 2))]
        low = list(range(n))
        for _ in range(n):
            for x, y in pairs:
                low[x] = low[y] = min(low[x], low[y])
        got = {r.node: r.component for r in components(spark.createDataFrame(pairs, "a long, b long"), "a", "b").collect()}
        assert got == {i: low[i] for x, y in pairs if x != y for i in (x, y)}
    assert components(spark.createDataFrame([], "a long, b long"), "a", "b").collect() == []


@pytest.mark.parametrize("width,percent,size", [(3, 90, 256), (3, 90, 2), (5, 80, 3)])
def test_links_are_counted(docs_of, width, percent, size):
    """Copies and groups that already lie in one component count too."""
    rows = families(width + size, percent) + [(900 + i, "one two three four five six seven") for i in range(4)] + [(990, None), (991, "")]
    sets = [set_of(t, width) for _, t in rows]
    linked = lambda x, y: bool(x) and 100 * len(x & y) >= percent * len(x | y)
    want = sorted((rows[i][0], sum(linked(x, y) for j, y in enumerate(sets) if j != i)) for i, x in enumerate(sets))
    got = jj.jaccard_components(docs_of(rows), width=width, percent=percent, group_size=size, count_links=True).collect()
    assert sorted((r.doc_id, r.n_links) for r in got) == want and max(n for _, n in want) > 2
