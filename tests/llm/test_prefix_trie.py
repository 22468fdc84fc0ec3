import hashlib
import re
import zlib

import numpy as np
import pytest

from gaugeworks.llm import prefix_trie as pt

SCHEMA = "conv_id long, turn long, role string, text string, depth string, node string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def sequences(rows, share):
    """Conversation -> its turns, in plain Python."""
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            r, t = role or "", text or ""
            digest = hashlib.md5(f"{len(r)}:{r}{t}".encode()).hexdigest()
            own.setdefault(c, []).append((turn is not None, turn or 0, r, digest, t))
    own = {c: [(r, t) for _, _, r, _, t in sorted(v)] for c, v in own.items()}
    if not share:
        return own
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - int(np.fmod(c, 20))
        out[c] = own.get(base, [])[:h] + turns[h:]
    return out


def brute(rows, share):
    seqs, members = sequences(rows, share), {}
    for c, turns in seqs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    kids, leaves, saved = {}, {}, {}
    for path in members:
        if path:
            kids[path[:-1]] = kids.get(path[:-1], 0) + 1
    for path, own in members.items():
        words = len(re.findall(r"[^\x20\x09-\x0D]+", path[-1][1])) if path else 0
        for d in range(len(path) + 1):
            saved[path[:d]] = saved.get(path[:d], 0) + (len(own) - 1) * words
            leaves[path[:d]] = leaves.get(path[:d], 0) + (path not in kids)
    out = []
    for path, own in members.items():
        ends = ",".join(str(c) for c in sorted(c for c in own if len(seqs[c]) == len(path)))
        parent = min(members[path[:-1]]) if path else None
        out.append((min(own), len(path), parent, len(own), kids.get(path, 0), leaves[path], saved[path], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def run(spark, rows, share):
    df = spark.createDataFrame([(*r, "clash", "clash") for r in rows], SCHEMA).repartition(3)
    if share:
        got = pt.trie(*pt.rebuilt(pt.numbered_turns(df, "conv_id", "turn", "role", "text")))
    else:
        got = pt.prefix_trie(df)
    assert got.columns == COLUMNS
    return sorted((tuple(r) for r in got.collect()), key=repr)


def conversations(n, seed):
    rng = np.random.default_rng(seed)
    rows = []
    for c in range(n):
        c = int(c * 3 - 40)
        for t in range(int(rng.integers(1, 7))):
            rows.append((c, t, ["user", "assistant"][t % 2], f"say {int(rng.integers(0, 2))} now" if rng.random() < 0.8 else f"w{c} x y"))
    return rows


@pytest.mark.parametrize("share", [False, True])
def test_equals_brute_force(spark, share):
    rows = conversations(90, 1)
    assert run(spark, rows, share) == brute(rows, share)


@pytest.mark.parametrize("share", [False, True])
def test_odd_rows(spark, share):
    rows = [
        (1, None, None, None), (1, None, "", "b"), (1, 2, "user", ""), (2, 0, "", ""), (2, 1, "", "b"), (2, 1, "", "b"), (2, 1, "", "a"),
        (None, 0, "user", "lost"), (-7, 5, "user", "x" * 60000), (-7, 4, "ab", "c"), (40, 1, "a", "bc"), (41, 1, "ab", "c"), (60, 0, "u", "one \t\v two three"),
        (63, 0, "u", "only"), (1_000_005, 3, "u", "no base"),
    ]
    assert run(spark, rows, share) == brute(rows, share)
    assert run(spark, [], share) == []
    assert run(spark, [(None, 1, "a", "b")], share) == []


def test_one_long_conversation_and_a_common_first_turn(spark):
    rows = [(5, t, "user", f"turn {t % 3}") for t in range(400)]
    rows += [(1000 + c, t, "user", ["hello", f"c{c}", "bye"][t]) for c in range(1200) for t in range(3)]
    rows += [(9000 + c, t, "user", f"turn {t % 3}") for c in range(5) for t in range(350 + c)]
    assert run(spark, rows, False) == brute(rows, False)


@pytest.mark.parametrize("shape", ["chain", "star", "random", "forest"])
def test_subtree_totals(spark, shape):
    rng = np.random.default_rng(2)
    n = 300
    parent = {
        "chain": lambda i: i - 1, "star": lambda i: 0, "random": lambda i: int(rng.integers(max(0, i - 4), i)),
        "forest": lambda i: None if i % 50 == 0 else i - 1 - int(rng.integers(0, i % 50)),
    }[shape]
    name = rng.permutation(n) * 7 + 3
    rows = [(int(name[i]), None if i == 0 or parent(i) is None else parent(i), int(rng.integers(0, 9)), 1) for i in range(n)]
    up = {i: r[1] for i, r in enumerate(rows)}
    want = {r[0]: [0, 0] for r in rows}
    for i in range(n):
        at = i
        while at is not None:
            want[rows[at][0]][0] += rows[i][2]
            want[rows[at][0]][1] += 1
            at = up[at]
    tree = spark.createDataFrame([(a, None if b is None else int(name[b]), c, d) for a, b, c, d in rows], "node long, parent long, a long, b long")
    assert {r.node: [r.a, r.b] for r in pt.subtree_totals(tree, ["a", "b"]).collect()} == want


def test_rounds_grow_with_the_logarithm_of_a_chain(spark, monkeypatch):
    written = []
    monkeypatch.setattr(pt, "stage", lambda df: written.append(1) or df.sparkSession.createDataFrame(df.collect(), df.schema))
    tree = spark.createDataFrame([(i, i - 1 if i else None, 1) for i in range(200)], "node long, parent long, a long")
    assert {r.node: r.a for r in pt.subtree_totals(tree, ["a"]).collect()} == {i: 200 - i for i in range(200)}
    assert len(written) < 3 * 25  # three tables a round


def test_a_circle_is_refused(spark):
    with pytest.raises(ValueError):
        pt.subtree_totals(spark.createDataFrame([(1, 2, 1), (2, 1, 1)], "node long, parent long, a long"), ["a"])
