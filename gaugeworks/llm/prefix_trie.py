"""The trie of conversation prefixes, with totals of every subtree by parallel tree contraction.

A node is a distinct sequence of turns (role, text) that some conversation starts with. Nodes are named
by sums: every turn gives 128 bits hashed from its position, role and text, and a prefix is the sum of
its turns, lane by lane. Sums can be taken range by range, so a conversation of any length is spread
over tasks, and texts are hashed where they are read and travel no further. (Two of n sequences share
all lanes with a chance of about n^2 / 2^129.)

Subtree totals need no walk from the leaves up, whose length would be the depth of the tree:
:func:`subtree_totals` alternates two steps in rounds of joins. *Rake*: leaves hand their total to their
parent and go. *Compress*: in chains of nodes with one child, those whose hash is larger than their
parent's and child's are bridged, and what they would have added travels on the edge above the child.
A third of a chain goes a round, so rounds grow with the logarithm of the nodes. Then the rounds are
played back: a bridged node's total is its child's plus what it had gathered. All joins of a round are
on node numbers that stand once on both sides.

Every step is written to the shared folder, so a lost executor costs one step's tasks.

Defined results: rows without conversation id are left out; null roles and texts are empty; turns stand
in the order of their number, null first, those of equal number by role and then by MD5 of role and
text; repeated rows are turns of their own; an empty table gives no row. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gaugeworks.functions.ordering import carried, in_ranges
from gaugeworks.llm.registry import query
from gaugeworks.plans.bindings import table
from gaugeworks.session import prepare, stage

_LANES = ("h1", "h2", "h3", "h4")
_KEY = ("depth", *_LANES)
WORD = r"[^\x20\x09-\x0D]+"


def lanes(position: Column, digest: Column) -> list[Column]:
    """128 bits of a turn at its position, as four numbers below 2^32, whose sums stay in 64 bits."""
    out = []
    for seed in (1, 2):
        h = F.xxhash64(F.lit(seed), position.cast("long"), digest)
        out += [F.shiftrightunsigned(h, 32), h.bitwiseAND(F.lit(0xFFFFFFFF))]
    return out


def numbered_turns(df: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """(conv, n, digest, words, __b): the turns of every conversation counted from 1, in their ranges."""
    r, t = F.coalesce(role, F.lit("")), F.coalesce(text, F.lit(""))
    digest = F.md5(F.concat(F.length(r).cast("string"), F.lit(":"), r, t).cast("binary"))
    rows = df.where(F.col(conv).isNotNull()).select(
        F.col(conv).cast("long").alias("conv"), F.col(turn).alias("turn"), r.alias("role"), digest.alias("digest"),
        F.regexp_count(t, F.lit(WORD)).cast("long").alias("words"),
    )
    cut = in_ranges(rows, ["conv"], ["turn", "role", "digest"])
    before = carried(cut, ["conv"], {"before": F.count("*")})
    at = F.row_number().over(Window.partitionBy("conv", "__b").orderBy("turn", "role", "digest", "__i"))
    counted = cut.withColumn("at", at).join(before, ["conv", "__b"])
    return stage(counted.select("conv", (F.col("at") + F.col("before")).alias("n"), "digest", "words", "__b"))


def as_they_are(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations (conv, length) and their turns (conv, depth, digest, words, length, __b)."""
    convs = turns.groupBy("conv").agg(F.count("*").alias("length"))
    return convs, turns.withColumnRenamed("n", "depth").join(convs, "conv")


def rebuilt(turns: DataFrame, group: int = 20, most: int = 4) -> tuple[DataFrame, DataFrame]:
    """Conversations that share openings: the first h turns of c - c % group, then c's own after its
    first h, where h is crc32 of c as text, modulo ``most``. Same columns as :func:`as_they_are`."""
    h = (F.crc32(F.col("conv").cast("string").cast("binary")) % most).cast("long")
    sizes = turns.groupBy("conv").agg(F.count("*").alias("own"))
    convs = sizes.select("conv", "own", h.alias("h"), (F.col("conv") - F.col("conv") % group).alias("base"))
    bases = sizes.select(F.col("conv").alias("base"), F.col("own").alias("base_turns"))
    convs = convs.join(bases, "base", "left").withColumn("lent", F.least("h", F.coalesce("base_turns", F.lit(0))))
    convs = stage(convs.withColumn("length", F.col("lent") + F.greatest(F.lit(0), F.col("own") - F.col("h"))).drop("own", "base_turns"))
    first = turns.where(F.col("n") < most).select(F.col("conv").alias("base"), F.col("n").alias("depth"), "digest", "words")
    lent = convs.where("lent > 0").join(first, "base").where("depth <= lent")
    own = turns.join(convs, "conv").where("n > h").withColumn("depth", F.col("n") - F.col("h") + F.col("lent"))
    columns = ["conv", "depth", "digest", "words", "length"]
    return convs.select("conv", "length"), lent.select(*columns, F.lit(-1).alias("__b")).union(own.select(*columns, "__b"))


def prefixes(convs: DataFrame, turns: DataFrame) -> DataFrame:
    """(conv, depth, lanes, lanes of the parent p1..p4, words, ends) for every prefix of every
    conversation, the empty one included."""
    turns = stage(turns.select("conv", "depth", "__b", "words", "length", *[c.alias(n) for c, n in zip(lanes(F.col("depth"), F.col("digest")), _LANES)]))
    before = carried(turns, ["conv"], {f"before_{n}": F.sum(n) for n in _LANES})
    upto = Window.partitionBy("conv", "__b").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    local = turns.select("*", *[F.sum(n).over(upto).alias(f"upto_{n}") for n in _LANES]).join(before, ["conv", "__b"])
    whole = [F.col(f"upto_{n}") + F.col(f"before_{n}") for n in _LANES]
    deeper = local.select(
        "conv", F.col("depth").cast("long"), *[w.alias(n) for w, n in zip(whole, _LANES)],
        *[(w - F.col(n)).alias(f"p{i}") for i, (w, n) in enumerate(zip(whole, _LANES), 1)],
        "words", (F.col("depth") == F.col("length")).alias("ends"),
    )
    zero, none = F.lit(0).cast("long"), F.lit(None).cast("long")
    top = convs.select(
        "conv", zero.alias("depth"), *[zero.alias(n) for n in _LANES], *[none.alias(f"p{i}") for i in range(1, 5)],
        zero.alias("words"), (F.col("length") == 0).alias("ends"),
    )
    return stage(top.union(deeper))


def digests_of_ends(ends: DataFrame, chunk: int = 512) -> DataFrame:
    """(key, ends_sha256): SHA-256 over the ids, ascending and joined by commas, of every node where
    conversations end.

    A digest is made in order, so a node's ids meet in one task, but as a stream: ranges of ids are
    sorted and joined in parallel, the last task reads one row for ``chunk`` ids and keeps only the
    state of the digest.
    """
    cut = in_ranges(ends.select(*_KEY, "conv"), list(_KEY), ["conv"])
    at = F.row_number().over(Window.partitionBy(*_KEY, "__b").orderBy("conv"))
    packed = cut.withColumn("part", F.floor((at - 1) / chunk)).groupBy(*_KEY, "__b", "part").agg(
        F.min("conv").alias("first"), F.array_join(F.transform(F.array_sort(F.collect_list("conv")), lambda c: c.cast("string")), ",").alias("ids")
    )
    ordered = packed.select(*_KEY, "first", "ids").repartition(*_KEY).sortWithinPartitions(*_KEY, "first")

    def hash_stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for batch in batches:
            out = []
            for row in zip(*[batch.column(i).to_pylist() for i in (0, 1, 2, 3, 4, 6)]):
                if row[:5] == key:
                    state.update(b",")
                else:
                    if key is not None:
                        out.append((*key, state.hexdigest()))
                    key, state = row[:5], hashlib.sha256()
                state.update(row[5].encode())
            if out:
                yield rows(out)
        if key is not None:
            yield rows([(*key, state.hexdigest())])

    def rows(found: list[tuple]) -> pa.RecordBatch:
        types = [pa.int64()] * 5 + [pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), types)], names=[*_KEY, "ends_sha256"])

    return ordered.mapInArrow(hash_stream, ", ".join(f"{k} long" for k in _KEY) + ", ends_sha256 string")


def subtree_totals(tree: DataFrame, values: Sequence[str]) -> DataFrame:
    """(node, values) with each value summed over the node and everything below it.

    ``tree`` has node (long, unique), parent (a node, or null for a root) and the values. A circle of
    nodes raises ValueError.
    """
    now = stage(tree.select("node", "parent", *values, *[F.lit(0).cast("long").alias(f"edge_{v}") for v in values]))
    size, rounds = now.count(), []
    while size:
        kids = now.where("parent IS NOT NULL").groupBy(F.col("parent").alias("node")).agg(
            F.count("*").alias("kids"), F.min("node").alias("only"), *[F.min(f"edge_{v}").alias(f"below_{v}") for v in values]
        )
        seen = now.join(kids, "node", "left")

        def draw(name: str, k: int = len(rounds)) -> Column:
            return F.xxhash64(F.col(name), F.lit(k))

        bridged = (F.col("kids") == 1) & F.col("parent").isNotNull() & (draw("node") > draw("only")) & (draw("node") > draw("parent"))
        seen = stage(seen.withColumn("bridged", F.coalesce(bridged, F.lit(False))))
        rounds.append(seen)
        # compress: the only child of a bridged node moves up and carries its sum on the edge
        moves = seen.where("bridged").select(
            F.col("only").alias("node"), F.col("parent").alias("up"), *[(F.col(v) + F.col(f"edge_{v}")).alias(f"more_{v}") for v in values]
        )
        left = seen.where("NOT bridged").join(moves, "node", "left").select(
            "node", F.coalesce("up", "parent").alias("parent"), "kids", *values,
            *[(F.col(f"edge_{v}") + F.coalesce(f"more_{v}", F.lit(0))).alias(f"edge_{v}") for v in values],
        )
        # rake: leaves add their totals to their parents
        gains = left.where("kids IS NULL AND parent IS NOT NULL").groupBy(F.col("parent").alias("node")).agg(
            *[F.sum(F.col(v) + F.col(f"edge_{v}")).alias(f"gain_{v}") for v in values]
        )
        now = left.where("kids IS NOT NULL").join(gains, "node", "left").select(
            "node", "parent", *[(F.col(v) + F.coalesce(f"gain_{v}", F.lit(0))).alias(v) for v in values], *[f"edge_{v}" for v in values]
        )
        now = stage(now)
        before, size = size, now.count()
        if size == before:
            raise ValueError("the parents form a circle")
    known = tree.select("node", *values).limit(0)
    for k, seen in enumerate(reversed(rounds)):
        raked = seen.where("kids IS NULL").select("node", *values)
        here = raked if k == 0 else raked.union(known)
        below = here.select(F.col("node").alias("only"), *[F.col(v).alias(f"total_{v}") for v in values])
        bridged = seen.where("bridged").join(below, "only").select(
            "node", *[(F.col(v) + F.col(f"below_{v}") + F.col(f"total_{v}")).alias(v) for v in values]
        )
        known = stage(here.union(bridged))
    return known


def trie(convs: DataFrame, turns: DataFrame) -> DataFrame:
    """One row a node: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256. Takes what :func:`as_they_are` or :func:`rebuilt` gives."""
    rows = prefixes(convs, turns)
    nodes = rows.groupBy(*_KEY).agg(
        F.count("*").alias("n_convs"), F.min("conv").alias("conv_id"), F.min("words").alias("words"), *[F.min(f"p{i}").alias(f"p{i}") for i in range(1, 5)]
    )
    nodes = stage(nodes.withColumn("node", F.monotonically_increasing_id()))
    parents = nodes.select(
        (F.col("depth") + 1).alias("depth"), *[F.col(n).alias(f"p{i}") for i, n in enumerate(_LANES, 1)],
        F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"),
    )
    # a node with very many children is one key of this join: adaptive execution splits its rows
    linked = stage(nodes.join(parents, ["depth", "p1", "p2", "p3", "p4"], "left"))
    kids = stage(linked.where("parent IS NOT NULL").groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("n_children")))
    linked = linked.join(kids, "node", "left").select(
        "node", "parent", *_KEY, "conv_id", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"),
        F.when(F.col("n_children").isNull(), 1).otherwise(0).cast("long").alias("n_leaves"),
        ((F.col("n_convs") - 1) * F.col("words")).alias("saved_tokens"),
    )
    linked = stage(linked)
    totals = subtree_totals(linked, ["n_leaves", "saved_tokens"])
    ends = digests_of_ends(rows.where("ends"))
    out = linked.drop("n_leaves", "saved_tokens").join(totals, "node").join(ends, list(_KEY), "left")
    none = hashlib.sha256(b"").hexdigest()
    return out.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256")
    )


def prefix_trie(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The trie of the conversations as they are."""
    prepare(df.sparkSession)
    return trie(*as_they_are(numbered_turns(df, conv, turn, role, text)))


# Whole prefixes are the names of nodes; a subtree is found through the conversations of its nodes.
_SQL = r"""
WITH o AS (
  SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''),
      md5(concat(length(coalesce(role, '')), ':', coalesce(role, ''), coalesce(text, '')))) AS n,
    coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL),
s AS (SELECT c, count(*) AS own, c::VARCHAR AS t FROM o GROUP BY c),
x AS (SELECT c, own, c - c % 20 AS b, xor(4294967295, list_reduce(
    list_prepend(4294967295::BIGINT, list_transform(range(1, len(t) + 1), lambda i: ascii(t[i])::BIGINT)),
    lambda a, y: list_reduce(list_prepend(xor(a, y), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda p, q: xor(p >> 1, 3988292384 * (p & 1))))) % 4 AS h FROM s),
k AS (SELECT x.c, x.b, x.h, least(x.h, coalesce(s.own, 0)) AS m FROM x LEFT JOIN s ON s.c = x.b),
r AS (SELECT k.c, o.n AS d, role, text FROM k JOIN o ON o.c = k.b AND o.n <= k.h
  UNION ALL SELECT k.c, o.n - k.h + k.m, role, text FROM k JOIN o ON o.c = k.c AND o.n > k.h),
p AS MATERIALIZED (
  SELECT c, d, text, list({'r': role, 't': text}) OVER (PARTITION BY c ORDER BY d) AS path FROM r
  UNION ALL SELECT c, 0, '', []::STRUCT(r VARCHAR, t VARCHAR)[] FROM k),
z AS (SELECT c, max(d) AS last FROM p GROUP BY c),
g AS MATERIALIZED (
  SELECT path, d, count(*) AS n_convs, min(c) AS conv_id, sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (d = last), '')) AS ends_sha256,
    len(regexp_extract_all(any_value(text), '[^\x20\x09-\x0D]+')) AS words
  FROM p JOIN z USING (c) GROUP BY path, d),
f AS (SELECT g.*, q.conv_id AS parent_conv_id FROM g LEFT JOIN g q ON q.path = g.path[1 : g.d - 1] AND q.d = g.d - 1),
e AS (SELECT parent_conv_id AS conv_id, d - 1 AS d, count(*) AS n FROM f WHERE d > 0 GROUP BY ALL),
y AS (SELECT f.conv_id, f.d, f.path, (f.n_convs - 1) * f.words AS saved, coalesce(e.n, 0) AS n_children FROM f LEFT JOIN e USING (conv_id, d)),
u AS (SELECT p.path, p.d, sum(y.saved)::BIGINT AS saved_tokens, count(*) FILTER (y.n_children = 0) AS n_leaves
  FROM y JOIN p ON p.c = y.conv_id AND p.d <= y.d GROUP BY ALL)
SELECT f.conv_id, f.d AS depth, f.parent_conv_id, f.n_convs, y.n_children, u.n_leaves, u.saved_tokens, f.ends_sha256
FROM f JOIN y USING (path, d) JOIN u USING (path, d)
"""


@query("op12_prefix_trie", _SQL)
def op12_prefix_trie(spark, sf) -> DataFrame:
    turns = numbered_turns(table(spark, sf, "conversations"), "conv_id", "turn", "role", "text")
    return trie(*rebuilt(turns))
