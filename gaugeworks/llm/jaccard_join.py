"""Exact Jaccard join of word-shingle sets with a token-group matrix.

Similar documents are gathered into groups of bounded size, each group stands for the union of its
members' tokens, and two groups are opened only if a bound on their overlap allows a link.

1. Every document becomes the set of its shingle hashes. Equal sets are one class; only classes go on.
2. All sets together are the first group: a set whose tokens occur too rarely in other sets cannot be
   linked with any. Of most texts that is all that is ever asked. The sets that stay are asked again
   among themselves.
3. The tokens of a remaining set are dealt into parts by hash. Two sets of similarity t differ in at most
   d = (1-t)/(1+t) (|x|+|y|) tokens, so of d + k + 1 parts at least k + 1 are equal, whatever the sets. The
   matrix has a row for each (part of a set); sets without a common row cannot be linked. (k, about d / 8,
   is room for empty parts, which need not count. A set with more of them than k lists them too; as rows
   they join sets that have nothing in common.) A row of more than 16 sets ties them all; of the sets of
   smaller rows a pair is tied only if it shares as many rows as the bound asks of a link. Sets that are
   tied, directly or through others, are a family. A family is one group, or more if it holds more than
   ``group_size`` sets or ``group_tokens`` tokens.
4. Groups are opened. Inside a group, and between two of a family, the union of the other members'
   tokens bounds a member's overlap with any of them; members that cannot reach the limit are left out,
   until no more go, and only if any remain are overlaps counted, exactly. Every group is compared with
   itself and with the family's first group; groups that are then wholly in one component need not meet
   each other, the rest do.

No step emits the pairs of a group: a comparison returns a spanning forest of its links and, for each
member, how many documents its links reach. Where links are counted, all groups of a family meet. Texts are read
for steps 1 and 2, and move once, for the sets that step 2 leaves. A large group of copies is one class; a
large family is cut by hash of its members.

Tokens and sets are told apart by hashes (64 bits, 48 in the comparison). Defined results: a text of
fewer words than ``width`` is one shingle; a null text or one without words has no shingle and no link;
repeated rows are copies of each other; a null id never names a component while there is another.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeworks.llm.components import components
from gaugeworks.llm.lm_score import _slices, mix
from gaugeworks.llm.registry import query
from gaugeworks.llm.shingles import shingle_sets
from gaugeworks.plans.bindings import table
from gaugeworks.session import prepare, stage

_RUN = 4 << 20  # bytes of text handled at once
_TOKEN_BYTES = 6
_SEGMENT_ROWS = 1_000_000  # matrix rows one task gathers, about
_FEW = 16  # sets of a matrix row whose pairs are counted one by one
_PAIRS = 500_000  # counted at once


def bands(percent: int, largest: int = 1 << 31) -> np.ndarray:
    """Starts of size bands: sets that can be linked are in the same band or in neighbouring ones."""
    starts = [1]
    while starts[-1] <= largest:
        starts.append(starts[-1] * 100 // percent + 1)
    return np.array(starts, dtype=np.int64)


def listed_parts(tokens: np.ndarray, sizes: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The part keys of all sets in a row, the set of each, and how many rows a link of this set has to
    share at least; that number is below zero where the set lists itself in the next band."""
    starts = bands(percent)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    band = np.searchsorted(starts, sizes, side="right") - 1
    keys, owners, needs = [], [], []
    for ahead in (0, 1):  # a set lists itself in its own band and in the next
        at = band + ahead
        # the most two sets of this band or the one before can differ by
        differ = (100 - percent) * 2 * (starts[at + 1] - 1) // (100 + percent)
        room = np.maximum(differ // 8, 1)
        parts = np.where((differ > 0) & (sizes > 0), differ + room + 1, 0)
        base = np.cumsum(parts) - parts
        has = parts[owner] > 0
        mine = base[owner[has]] + (tokens[has] % parts[owner[has]].astype(np.uint64)).astype(np.int64)
        total = np.zeros(int(parts.sum()), dtype=np.uint64)
        np.add.at(total, mine, mix(tokens[has] + np.uint64(0x632BE59BD9B4E019)))
        empty = np.bincount(mine, minlength=len(total)) == 0
        who = np.repeat(np.arange(len(sizes)), parts)
        number = (np.arange(len(total)) - base[who]).astype(np.uint64)
        place = mix(at[who].astype(np.uint64) * np.uint64(0x9FB21C651E98DF25) + number)
        n_empty = np.bincount(who[empty], minlength=len(sizes))
        need = room + 1 - np.where(n_empty > room, 0, n_empty)
        keep = ~empty | (n_empty > room)[who]
        keys.append(mix(total + place)[keep])
        owners.append(who[keep])
        needs.append((-need if ahead else need)[who[keep]])
    return np.concatenate(keys), np.concatenate(owners), np.concatenate(needs)


def matrix_rows(tokens: np.ndarray, sizes: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """The part keys of all sets in a row, and the number of keys of each set."""
    key, who, _ = listed_parts(tokens, sizes, percent)
    return key[np.argsort(who, kind="stable")], np.bincount(who, minlength=len(sizes))


def _class_hash(tokens: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    ends = np.concatenate([[np.uint64(0)], np.cumsum(mix(tokens ^ np.uint64(0x2545F4914F6CDD1D)))])
    upto = np.cumsum(sizes)
    return mix(ends[upto] - ends[upto - sizes] + sizes.astype(np.uint64)).view(np.int64)


def describe(docs: DataFrame, width: int) -> DataFrame:
    """Per row of (id, text): id, hash of the text, number of shingles, class."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for run in _slices(batch, "text", _RUN):
                tokens, sizes = shingle_sets(run.column("text"), width)
                yield pa.RecordBatch.from_arrays(
                    [run.column("id"), run.column("text_hash"), pa.array(sizes), pa.array(_class_hash(tokens, sizes))],
                    names=["id", "text_hash", "n", "class"],
                )

    rows = docs.select("id", F.xxhash64("text").alias("text_hash"), "text")
    return rows.mapInArrow(work, "id long, text_hash long, n long, class long")


def _narrow(numbers: np.ndarray, width: int) -> bytes:
    return numbers.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def _widen(parts: list[bytes], width: int) -> np.ndarray:
    low = np.frombuffer(b"".join(parts), dtype=np.uint8).reshape(-1, width)
    out = np.zeros((len(low), 8), dtype=np.uint8)
    out[:, :width] = low
    return out.view("<u8").ravel()


def _by_segment(numbers: np.ndarray, segments: int) -> tuple[np.ndarray, list[int]]:
    """Places in order of the segments of hashes, and the bounds of the segments."""
    segment = ((numbers >> np.uint64(32)) % np.uint64(segments)).astype(np.int64)
    return np.argsort(segment, kind="stable"), np.concatenate([[0], np.cumsum(np.bincount(segment, minlength=segments))]).tolist()


def _sets_of_texts(run: pa.RecordBatch, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens, sizes and classes of the different sets of a run of texts."""
    tokens, sizes = shingle_sets(run.column("text"), width)
    classes = _class_hash(tokens, sizes)
    once = np.zeros(len(sizes), dtype=bool)
    once[np.unique(classes, return_index=True)[1]] = True
    once &= sizes > 0
    return tokens[np.repeat(once, sizes)], sizes[once], classes[once]


def _sets_of_rows(run: pa.RecordBatch, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same of rows of (class, tokens)."""
    raw = run.column("tokens").to_pylist()
    sizes = np.array([len(t) // _TOKEN_BYTES for t in raw], dtype=np.int64)
    return mix(_widen(raw, _TOKEN_BYTES)), sizes, run.column("class").to_numpy()


def repeated_tokens(rows: DataFrame, width: int, segments: int) -> DataFrame:
    """(class, n, repeated): how many tokens of a set occur in another set too. ``rows`` has texts, or
    classes and their tokens.

    Tokens travel packed by segment, 32 bits each beside the segment, with the numbers of their
    documents in the run; the answer is one bit a token. Two tokens that fall together only make a count
    too large. So do copies of a class in different runs.
    """

    column, take = ("tokens", _sets_of_rows) if "tokens" in rows.columns else ("text", _sets_of_texts)
    rows = rows.select("class", "tokens") if column == "tokens" else rows.select("text")

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, squeeze = TaskContext.get().partitionId(), 0, zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            for run in _slices(batch, column, _RUN):
                tokens, sizes, classes = take(run, width)
                owner = np.repeat(np.arange(len(sizes), dtype=np.uint32), sizes)
                order, bounds = _by_segment(tokens, segments)
                tokens, owner = tokens[order], owner[order]
                full = [s for s in range(segments) if bounds[s + 1] > bounds[s]]
                heads = [classes.astype("<i8").tobytes() + sizes.astype("<i8").tobytes()] + [b""] * len(full)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(full, pa.int64()), pa.array([part << 32 | number] * len(full), pa.int64()),
                        pa.array([_narrow(tokens[bounds[s] : bounds[s + 1]], 4) for s in full], pa.binary()),
                        pa.array([squeeze(owner[bounds[s] : bounds[s + 1]].astype("<u4").tobytes()) for s in full], pa.binary()),
                        pa.array(heads[: len(full)], pa.binary()),
                    ],
                    names=["segment", "run", "tokens", "owners", "head"],
                )
                number += 1

    def look(parts: pd.DataFrame) -> pd.DataFrame:
        size = np.array([len(t) // 4 for t in parts["tokens"]])
        _, at, often = np.unique(np.frombuffer(b"".join(parts["tokens"]), dtype="<u4"), return_inverse=True, return_counts=True)
        again, ends = often[at] > 1, np.cumsum(size)
        bits = [np.packbits(again[z - k : z]).tobytes() for z, k in zip(ends.tolist(), size.tolist())]
        return pd.DataFrame({"run": parts["run"], "owners": parts["owners"], "bits": bits, "head": parts["head"]})

    def add(parts: pd.DataFrame) -> pd.DataFrame:
        head = np.frombuffer(b"".join(parts["head"]), dtype="<i8").reshape(2, -1)
        total, expand = np.zeros(head.shape[1], dtype=np.int64), zstandard.ZstdDecompressor().decompress
        for owners, bits in zip(parts["owners"], parts["bits"]):
            owner = np.frombuffer(expand(owners), dtype="<u4")
            total += np.bincount(owner[np.unpackbits(np.frombuffer(bits, dtype=np.uint8), count=len(owner)) == 1], minlength=len(total))
        return pd.DataFrame({"class": head[0], "n": head[1], "repeated": total})

    asked = rows.mapInArrow(ask, "segment long, run long, tokens binary, owners binary, head binary")
    bits = asked.groupBy("segment").applyInPandas(look, "run long, owners binary, bits binary, head binary")
    return bits.groupBy("run").applyInPandas(add, "class long, n long, repeated long")


def tied(key: np.ndarray, member: np.ndarray, need: np.ndarray) -> pd.DataFrame:
    """Ties of the members of matrix rows: (class, low, seen, need), with low the smaller class, how many
    rows a pair was seen in and how many a link has to share. In rows of more than ``_FEW`` members all
    are tied with the smallest, whatever the number."""
    order = np.lexsort((member, key))
    key, member, need = key[order], member[order], need[order]
    first = np.ones(len(key), dtype=bool)
    first[1:] = key[1:] != key[:-1]
    start = np.flatnonzero(first)
    size = np.diff(np.append(start, len(key)))
    # two sets of one band meet in its rows, not in those of the next
    meets = np.add.reduceat(need > 0, start) > 0 if len(start) else first
    large = np.repeat(meets & (size > _FEW), size)
    low = np.repeat(member[start], size)[large]
    whole = pd.DataFrame({"class": member[large], "low": low}).drop_duplicates().assign(seen=1, need=1)
    out = [whole[whole["class"] != whole["low"]]]
    for n in range(2, _FEW + 1):
        left, right = np.triu_indices(n, 1)
        rows, step = start[meets & (size == n)], max(1, _PAIRS // len(left))
        for at in range(0, len(rows), step):
            x, y = ((rows[at : at + step, None] + side).ravel() for side in (left, right))
            ok = (need[x] > 0) | (need[y] > 0)
            x, y = x[ok], y[ok]
            pairs = pd.DataFrame({"class": member[y], "low": member[x], "need": np.minimum(abs(need[x]), abs(need[y]))})
            found = pairs.groupby(["class", "low"], sort=False)["need"].agg(["size", "min"]).reset_index()
            out.append(found.set_axis(["class", "low", "seen", "need"], axis=1))
    return pd.concat(out, ignore_index=True).astype("int64")


def shared_rows(sets: DataFrame, percent: int, segments: int) -> DataFrame:
    """Ties of the classes that list the same matrix rows: (class, low), low the smaller one."""

    def listing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for run in _slices(batch, "tokens", _RUN):
                raw = run.column("tokens").to_pylist()
                sizes = np.array([len(t) // _TOKEN_BYTES for t in raw], dtype=np.int64)
                keys, who, need = listed_parts(mix(_widen(raw, _TOKEN_BYTES)), sizes, percent)
                order, bounds = _by_segment(keys, segments)
                columns = (keys[order].astype("<u8"), run.column("class").to_numpy()[who[order]].astype("<i8"), need[order].astype("<i4"))
                full = [s for s in range(segments) if bounds[s + 1] > bounds[s]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(full, pa.int64()), *(pa.array([c[bounds[s] : bounds[s + 1]].tobytes() for s in full], pa.binary()) for c in columns)],
                    names=["segment", "keys", "members", "needs"],
                )

    def gather(parts: pd.DataFrame) -> pd.DataFrame:
        return tied(*(np.frombuffer(b"".join(parts[c]), dtype=t) for c, t in (("keys", "<u8"), ("members", "<i8"), ("needs", "<i4"))))

    rows = sets.select("class", "tokens").mapInArrow(listing, "segment long, keys binary, members binary, needs binary")
    ties = rows.groupBy("segment").applyInPandas(gather, "class long, low long, seen long, need long")
    enough = ties.groupBy("class", "low").agg(F.sum("seen").alias("seen"), F.min("need").alias("need")).where("seen >= need")
    return enough.select("class", "low")


def _sets(texts: DataFrame, width: int) -> DataFrame:
    """Per row of (class, text) the class and its tokens, each the low bytes of its hash."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for run in _slices(batch, "text", _RUN):
                tokens, sizes = shingle_sets(run.column("text"), width)
                ok = _class_hash(tokens, sizes) == run.column("class").to_numpy()
                raw = _narrow(tokens, _TOKEN_BYTES)
                ends = np.concatenate([[0], np.cumsum(sizes)]) * _TOKEN_BYTES
                rows = [raw[a:z] for a, z in zip(ends[:-1].tolist(), ends[1:].tolist())]
                yield pa.RecordBatch.from_arrays([run.column("class"), pa.array(rows, pa.binary())], names=["class", "tokens"]).filter(pa.array(ok))

    return texts.mapInArrow(work, "class long, tokens binary")


class Group:
    """Members of a group and their tokens."""

    def __init__(self, classes, tokens, copies=None):
        self.classes = np.asarray(classes, dtype=np.int64)
        self.sizes = np.array([len(t) // _TOKEN_BYTES for t in tokens], dtype=np.int64)
        self.copies = np.ones(len(self.sizes), dtype=np.int64) if copies is None else np.asarray(copies, dtype=np.int64)
        self.tokens = _widen(list(tokens), _TOKEN_BYTES)
        self.owner = np.repeat(np.arange(len(self.sizes)), self.sizes)

    def reaching(self, union: np.ndarray, percent: int) -> np.ndarray:
        """Members whose overlap with a union of tokens is large enough for a link with one of its sets."""
        inside = np.bincount(self.owner[np.isin(self.tokens, union)], minlength=len(self.sizes))
        return 100 * inside >= percent * self.sizes


    def only(self, keep: np.ndarray) -> Group:
        """The group of some members."""
        out = object.__new__(Group)
        out.classes, out.sizes, out.copies = self.classes[keep], self.sizes[keep], self.copies[keep]
        inside = keep[self.owner]
        out.tokens = self.tokens[inside]
        out.owner = np.repeat(np.arange(len(out.sizes)), out.sizes)
        return out

    def repeated(self, percent: int) -> Group:
        """Without the members whose overlap with the union of all others is too small for any link."""
        out = self
        while len(out.sizes):
            _, at, often = np.unique(out.tokens, return_inverse=True, return_counts=True)
            keep = 100 * np.bincount(out.owner[often[at] > 1], minlength=len(out.sizes)) >= percent * out.sizes
            if keep.all():
                break
            out = out.only(keep)
        return out


def overlap_rows(a: Group, b: Group, rows: int = 128, step: int = 512, pairs: int = 1_000_000) -> Iterator[tuple[int, np.ndarray]]:
    """Sizes of the intersections of all members of a with all of b, in runs of rows of a.

    Tokens that many members of b hold are counted by products of 0/1 matrices, the others by going
    through the members that hold them.
    """
    common, inverse, held = np.unique(b.tokens, return_inverse=True, return_counts=True)
    m = len(b.sizes)
    dense = held > max(8, m // 32)
    column = np.cumsum(dense) - 1  # of a frequent token in the matrices
    width = int(dense.sum())
    by_token = b.owner[np.argsort(inverse, kind="stable")]
    begin = np.cumsum(held) - held
    often = dense[inverse]
    b_member, b_column = b.owner[often], column[inverse[often]]
    spot = np.minimum(np.searchsorted(common, a.tokens), max(len(common) - 1, 0))
    known = common[spot] == a.tokens if len(common) else np.zeros(len(a.tokens), dtype=bool)
    starts = np.concatenate([[0], np.cumsum(a.sizes)])
    for low in range(0, len(a.sizes), rows):
        n = min(rows, len(a.sizes) - low)
        part = slice(starts[low], starts[low + n])
        token, member = spot[part][known[part]], a.owner[part][known[part]] - low
        total = np.zeros(n * m, dtype=np.int64)
        rare = ~dense[token] if len(token) else np.zeros(0, dtype=bool)
        t, i = token[rare], member[rare]
        runs = np.flatnonzero(np.diff(np.cumsum(held[t]) // pairs)) + 1  # of about ``pairs`` holders
        for lo, hi in zip([0, *runs.tolist()], [*runs.tolist(), len(t)]):
            k = held[t[lo:hi]]
            first = np.repeat(begin[t[lo:hi]] - (np.cumsum(k) - k), k)
            total += np.bincount(np.repeat(i[lo:hi], k) * m + by_token[first + np.arange(len(first))], minlength=n * m)
        total = total.reshape(n, m)
        j, i = column[token[~rare]], member[~rare]
        for at in range(0, width, step):
            x, y = np.zeros((n, step), dtype=np.float32), np.zeros((m, step), dtype=np.float32)
            here = (j >= at) & (j < at + step)
            x[i[here], j[here] - at] = 1
            here = (b_column >= at) & (b_column < at + step)
            y[b_member[here], b_column[here] - at] = 1
            total += (x @ y.T).astype(np.int64)
        yield low, total


class Forest:
    """Components of members, merged link by link."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def top(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def labels(self) -> np.ndarray:
        while True:
            further = self.up[self.up]
            if (further == self.up).all():
                return self.up
            self.up = further

    def join(self, left: np.ndarray, right: np.ndarray) -> None:
        label = self.labels()
        pairs = np.unique(label[left] * len(label) + label[right])
        for x, y in zip((pairs // len(label)).tolist(), (pairs % len(label)).tolist()):
            x, y = self.top(x), self.top(y)
            if x != y:
                self.up[max(x, y)] = min(x, y)


def links(a: Group, b: Group | None, percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the links inside a group, or between two groups."""
    return compare(a, b, percent)[0]


def compare(a: Group, b: Group | None, percent: int) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """The same forest, and of every class with links the number of documents they lead to."""
    if b is None:
        a = b = a.repeated(percent)
    else:
        before = -1
        while before != len(a.sizes) + len(b.sizes):
            before = len(a.sizes) + len(b.sizes)
            a = a.only(a.reaching(b.tokens, percent))
            b = b.only(b.reaching(a.tokens, percent))
    if not len(a.sizes) or not len(b.sizes):
        return [], []
    own = a is b
    n = len(a.sizes)
    classes = a.classes if own else np.concatenate([a.classes, b.classes])
    forest, reached = Forest(len(classes)), np.zeros(len(classes), dtype=np.int64)
    for low, both in overlap_rows(a, b):
        union = a.sizes[low : low + len(both), None] + b.sizes[None, :] - both
        linked = 100 * both >= percent * union
        if own:
            linked[np.arange(len(both)), np.arange(low, low + len(both))] = False
        reached[low : low + len(both)] += linked @ b.copies
        if not own:
            reached[n:] += a.copies[low : low + len(both)] @ linked
        left, right = np.nonzero(linked)
        forest.join(left + low, right if own else right + n)
    label = forest.labels()
    edges = [(int(classes[i]), int(classes[j])) for i, j in enumerate(label.tolist()) if i != j]
    return edges, [(int(classes[i]), int(reached[i])) for i in np.flatnonzero(reached).tolist()]


_EDGE = "left long, right long, reached long"


def _frame(edges: list[tuple[int, int]], reached: list[tuple[int, int]]) -> pd.DataFrame:
    """Links, and a row of a class with itself for the documents it reaches."""
    rows = [(x, y, 0) for x, y in edges] + [(x, x, n) for x, n in reached]
    return pd.DataFrame(rows, columns=["left", "right", "reached"]).astype("int64")


def _inside(groups: DataFrame, percent: int) -> DataFrame:
    def work(part: pd.DataFrame) -> pd.DataFrame:
        return _frame(*compare(Group(part["class"], part["tokens"], part["copies"]), None, percent))

    return groups.groupBy("group").applyInPandas(work, _EDGE)


def _between(pairs: DataFrame, groups: DataFrame, percent: int) -> DataFrame:
    """Links of the listed pairs of groups (a, b)."""

    def work(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return _frame([], [])
        a, b = (Group(x["class"], x["tokens"], x["copies"]) for x in (left, right))
        return _frame(*compare(a, b, percent))

    left = pairs.join(groups.toDF("class", "a", "tokens", "copies"), "a")
    right = pairs.toDF("a", "b").join(groups.toDF("class", "b", "tokens", "copies"), "b")
    return left.groupBy("a", "b").cogroup(right.groupBy("a", "b")).applyInPandas(work, _EDGE)


def link_classes(
    rows: DataFrame, docs: DataFrame, width: int, percent: int, group_size: int, group_tokens: int, count: bool = False
) -> DataFrame:
    """(node, component, reached) of all classes that are linked with another; ``rows`` from :func:`describe`.

    ``reached``, the number of documents of the classes that a class is linked with, is complete only if
    ``count`` is set: then groups meet that lie in one component too.
    """
    tokens = rows.agg(F.sum("n")).first()[0] or 0
    counts = repeated_tokens(docs, width, max(16, tokens // _SEGMENT_ROWS))
    open_ = counts.where(100 * F.col("repeated") >= percent * F.col("n")).select("class").distinct()
    # one row of documents for each class that can have a link
    one = rows.groupBy("class").agg(F.min_by(F.struct("id", "text_hash"), F.struct("id", "text_hash")).alias("r"), F.count("*").alias("copies"))
    one = stage(one.join(open_, "class").select("class", "r.*", "copies"))
    same = (F.col("d.id").eqNullSafe(F.col("p.id"))) & (F.col("d.text_hash") == F.col("p.text_hash"))
    # the texts move whatever the size of the other side
    texts = docs.withColumn("text_hash", F.xxhash64("text")).alias("d").join(one.hint("shuffle_hash").alias("p"), same)
    sets = stage(_sets(texts.select("p.class", "d.text"), width).dropDuplicates(["class"]))
    # once more among these: now every class is there once, and the tokens of others are gone
    counts = repeated_tokens(sets, width, max(16, tokens // _SEGMENT_ROWS))
    open_ = counts.where(100 * F.col("repeated") >= percent * F.col("n")).select("class")
    sets = stage(sets.join(open_.hint("shuffle_hash"), "class", "left_semi"))
    size = sets.agg(F.sum(F.octet_length("tokens"))).first()[0] or 0
    segments = max(16, 4 * (100 - percent) * size // ((100 + percent) * _TOKEN_BYTES * _SEGMENT_ROWS))
    star = stage(shared_rows(sets, percent, segments))
    family = components(star, "class", "low").toDF("class", "family")
    placed = sets.join(family, "class").withColumn("n", F.octet_length("tokens") / _TOKEN_BYTES)
    sizes = placed.groupBy("family").agg(F.count("*").alias("members"), F.sum("n").alias("n"))
    cuts = F.greatest(F.ceil(F.col("members") / group_size), F.ceil(F.col("n") / group_tokens)).cast("long")
    placed = placed.drop("n").join(sizes.select("family", cuts.alias("cuts")), "family").withColumn(
        "no", F.pmod(F.xxhash64("class"), F.col("cuts"))
    )
    placed = placed.join(one.select("class", "copies"), "class")
    placed = stage(placed.withColumn("group", F.concat_ws(":", "family", "no")))
    groups = placed.select("class", "group", "tokens", "copies")

    large = placed.where("cuts > 1").select("family", "no", "group", "class")
    numbered = large.select("family", "no", "group").distinct()
    first = numbered.where("no = 0").select("family", F.col("group").alias("a"))
    star = numbered.where("no > 0").join(first, "family").select("a", F.col("group").alias("b"))
    found = stage(_inside(groups, percent).union(_between(star, groups, percent)))
    label = components(found, "left", "right")
    if large.isEmpty():
        return _with_reached(label, found)
    # a group that lies in one component meets only groups outside it, unless links are counted
    whole = large.where("no > 0").join(label, F.col("class") == F.col("node"), "left").groupBy("family", "group").agg(
        F.min(F.coalesce("component", "class")).alias("low"), F.max(F.coalesce("component", "class")).alias("high")
    )
    single = F.when(F.col("low") == F.col("high"), F.col("low").cast("string")).otherwise(F.col("group"))
    tagged = stage(whole.select("family", F.col("group").alias("a"), (F.col("group") if count else single).alias("tag")))
    other = tagged.toDF("family", "b", "other")
    rest = tagged.join(other, "family").where("a < b AND tag <> other").select("a", "b")
    found = found.union(stage(_between(stage(rest), groups, percent)))
    return _with_reached(components(found, "left", "right"), found)


def _with_reached(label: DataFrame, found: DataFrame) -> DataFrame:
    total = found.where("reached > 0").groupBy(F.col("left").alias("node")).agg(F.sum("reached").alias("reached"))
    return label.join(total, "node", "left")


def jaccard_components(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, percent: int = 90,
    group_size: int = 8_000, group_tokens: int = 2_000_000, count_links: bool = False,
) -> DataFrame:
    """Per row: id, hash of the text, n_shingles and component_id, the smallest id that links lead to.

    With ``count_links`` also n_links, the number of other rows a row is linked with, copies among them.
    """
    prepare(df.sparkSession)
    docs = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    rows = stage(describe(docs, width))
    label = link_classes(rows, docs, width, percent, group_size, group_tokens, count_links)
    extra = []
    if count_links:  # classes without links or copies need no row
        copies = rows.where("n > 0").groupBy(F.col("class").alias("node")).agg(F.count("*").alias("copies")).where("copies > 1")
        label = label.join(copies, "node", "full")
        n_links = F.coalesce("reached", F.lit(0)) + F.coalesce("copies", F.lit(1)) - 1
        extra = [F.when(F.col("n") > 0, n_links).otherwise(F.lit(0)).cast("long").alias("n_links")]
    named = rows.select("id", "text_hash", "n", "class").join(label, F.col("class") == F.col("node"), "left")
    named = named.select("id", "text_hash", "n", *extra, F.when(F.col("n") > 0, F.coalesce("component", "class")).alias("c"))
    low = named.where("c IS NOT NULL").groupBy("c").agg(F.min("id").alias("least"))
    return named.join(low, "c", "left").select(
        F.col("id").alias(id_col), "text_hash", F.col("n").alias("n_shingles"),
        F.coalesce("least", "id").alias("component_id"), *(["n_links"] if count_links else []),
    )


def one_per_component(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows of ``df`` whose id names their component, each once; rows without words all stay."""
    found = jaccard_components(df, id_col, text_col, **how).where(F.col(id_col).eqNullSafe(F.col("component_id")))
    keep = found.select(F.col(id_col).alias("__id"), F.col("text_hash").alias("__hash"), F.col("n_shingles").alias("__n")).distinct()
    rows = df.withColumn("__text", F.xxhash64(text_col))
    same = F.col(id_col).cast("long").eqNullSafe(F.col("__id")) & (F.col("__text") == F.col("__hash"))
    return rows.join(keep, same).dropDuplicates([id_col, "__text"]).select(*df.columns)


@query("op6_jaccard_join")
def op6_jaccard_join(spark, sf) -> DataFrame:
    return jaccard_components(table(spark, sf, "documents"), count_links=True).select("doc_id", "n_shingles", "component_id", "n_links")
