"""Language-model scores from a log-frequency Bloom filter.

The filter holds one- and two-word counts on a logarithmic scale: an n-gram whose count falls into
step q of the scale is stored q times, as (n-gram, 1) to (n-gram, q). Its count is read back by probing
level after level until a probe fails. A probe can be wrong only upwards, and a count is overstated by
j steps only if j probes are wrong in a row. Probabilities are smoothed from such counts:

    P(w | v) = (c(v w) + mu * P(w)) / (c(v) + mu)        P(w) = (c(w) + 1) / (N + V + 1)

How it runs
* Texts are tokenised once. Blocks of documents (about ``block_bytes`` of text) are written as rows:
  word codes, and the hash of each code. A document is never cut; a block never holds the corpus.
* Nothing is broadcast. Every block sends its own different n-grams, packed, with their training counts
  to the filter segments they fall into. A segment's task sums the counts, builds the segment's bits
  and sends back the level that probing gives for each n-gram asked. The number of segments follows
  the number of tokens, so a task's share has a fixed size.
* A segment has ``BITS_PER_LEVEL`` bits for each (n-gram, level) that is stored in it, so the filter grows
  with the corpus, and a probe that should fail succeeds about once in 200 times at any size
  (:func:`wrong_probes`).
* Exact word counts, for the base score, go the same way: every block sends its own different words
  with their counts to the words' segments, and gets the sums back.

Words are told apart by 64-bit hashes. Defined results: a null or empty text is the end token alone; a
null id is scored and counts as training text; equal texts get equal scores; with no training text
every count is 0; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeworks.llm.language import held_out
from gaugeworks.llm.registry import query
from gaugeworks.plans.bindings import table
from gaugeworks.session import prepare, stage

BASE = 1.5  # of the logarithmic scale
_PROBES = 4
BITS_PER_LEVEL = 13  # 26.5 % of the bits on, 0.5 % wrong probes
_END = np.uint64(0x9E3779B97F4A7C15)  # stands for the end token
_START = np.uint64(0xD1B54A32D192ED03)  # context of a first word
_WORD = np.uint64(0x2545F4914F6CDD1D)
_KEY_BITS, _KEY_BYTES = np.uint64(32), 4
_SEGMENT_ITEMS = 1_000_000

_BLOCK = "block long, ids array<long>, held array<boolean>, lengths binary, codes binary, hashes binary, tokens long, trained long"


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit numbers (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def pair_keys(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return mix(left * np.uint64(0x9FB21C651E98DF25) + mix(right))


def word_keys(words: np.ndarray) -> np.ndarray:
    return mix(words ^ _WORD)


def steps(counts: np.ndarray) -> np.ndarray:
    """Step of the scale a count falls into; 1 for a count of 1."""
    return 1 + np.floor(np.log(counts) / np.log(BASE) + 1e-9).astype(np.int64)


def wrong_probes(bits_per_level: float) -> float:
    """Share of the probes that succeed and should not."""
    return (1.0 - np.exp(-_PROBES / bits_per_level)) ** _PROBES


def segment_size(counts: np.ndarray, bits_per_level: float = BITS_PER_LEVEL) -> int:
    """Bits of a segment that stores these counts, in whole bytes."""
    return max(64, int(np.ceil(bits_per_level * steps(counts).sum() / 8)) * 8)


def _step_means(most: int = 160) -> np.ndarray:
    """The count that step q stands for: the mean of the whole numbers in it (0 for step 0)."""
    out = [0.0]
    for q in range(1, most):
        low, high = int(np.ceil(BASE ** (q - 1) - 1e-9)), int(np.ceil(BASE**q - 1e-9)) - 1
        out.append((low + max(low, high)) / 2.0)
    return np.array(out)


class LogFrequencyFilter:
    """Bits in segments; a key's high bits choose the segment."""

    def __init__(self, segments: int, segment_bits: int, bits: np.ndarray):
        self.segments, self.segment_bits, self.bits, self.means = segments, segment_bits, bits, _step_means()

    @staticmethod
    def places(key: np.ndarray, level: np.ndarray | int, segment_bits: int) -> list[np.ndarray]:
        first = mix(key + np.uint64(0x632BE59BD9B4E019) * np.asarray(level).astype(np.uint64))
        jump = mix(first) | np.uint64(1)
        return [(first + np.uint64(j) * jump) % np.uint64(segment_bits) for j in range(_PROBES)]

    def counts(self, keys: np.ndarray) -> np.ndarray:
        """Count of each key as far as the filter knows it."""
        return self.means[self.levels(keys)]

    def levels(self, keys: np.ndarray) -> np.ndarray:
        """Step of each key's count, 0 for a key that is not there."""
        segment = (keys >> _KEY_BITS) % np.uint64(self.segments)
        start, low = segment * np.uint64(self.segment_bits // 8), keys & np.uint64((1 << int(_KEY_BITS)) - 1)
        level, alive = np.zeros(len(keys), dtype=np.int64), np.arange(len(keys))
        for q in range(1, len(self.means)):
            hit = np.ones(len(alive), dtype=bool)
            for place in self.places(low[alive], q, self.segment_bits):
                byte = self.bits[(start[alive] + (place >> np.uint64(3))).astype(np.int64)]
                hit &= (byte >> (place & np.uint64(7)).astype(np.uint8)) & 1 == 1
            alive = alive[hit]
            level[alive] = q
            if not len(alive):
                break
        return level


def segment_bits_of(keys: np.ndarray, counts: np.ndarray, size: int) -> bytes:
    """The bits of one segment: each key with all its levels."""
    on, level = np.zeros(size, dtype=bool), 1
    top = steps(counts)
    while len(keys):
        for place in LogFrequencyFilter.places(keys, level, size):
            on[place.astype(np.int64)] = True
        level += 1
        keep = top >= level
        keys, top = keys[keep], top[keep]
    return np.packbits(on, bitorder="little").tobytes()


def split_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Codes of all words of all texts in a row, words per text, and the words by code, frequent first."""
    lists = pc.split_pattern_regex(pc.ascii_lower(pc.fill_null(texts, "")), pattern=r"[\t-\r ]+")
    coded = lists.flatten().dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    words = coded.dictionary.cast(pa.binary()).to_pylist()
    real = np.array([len(w) > 0 for w in words], dtype=bool)
    keep = real[codes] if len(codes) else np.zeros(0, dtype=bool)
    ends = lists.offsets.to_numpy().astype(np.int64)
    upto = np.concatenate([[0], np.cumsum(keep)])
    lengths = np.diff(upto[ends - ends[0]])
    codes = codes[keep]
    seen = np.bincount(codes, minlength=len(words))
    order = np.argsort(-seen, kind="stable")
    order = order[seen[order] > 0]
    rank = np.zeros(len(words), dtype=np.int64)
    rank[order] = np.arange(len(order))
    return rank[codes], lengths, [words[i] for i in order]


def _slices(batch: pa.RecordBatch, column: str, most: int) -> Iterator[pa.RecordBatch]:
    """Runs of rows with about ``most`` bytes of text; a longer text is a run of its own."""
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    run = np.cumsum(size) // most
    cuts = np.flatnonzero(np.diff(run)) + 1 if len(run) else []
    for a, b in zip([0, *cuts], [*cuts, batch.num_rows]):
        if b > a:
            yield batch.slice(a, b - a)


def tokenise(docs: DataFrame, block_bytes: int) -> DataFrame:
    """Rows (id, held, text) as blocks of word codes; the end token is the last code of every text."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n = TaskContext.get().partitionId(), 0
        squeeze = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            for run in _slices(batch, "text", block_bytes):
                codes, lengths, words = split_words(run.column("text"))
                hashes = np.array([xxhash.xxh3_64_intdigest(w) for w in words] + [int(_END)], dtype=np.uint64)
                full = np.full(len(codes) + len(lengths), len(words), dtype=np.uint32)
                full[np.arange(len(codes)) + np.repeat(np.arange(len(lengths)), lengths)] = codes
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([part << 32 | n]), pa.array([run.column("id").to_pylist()], pa.list_(pa.int64())),
                        pa.array([run.column("held").to_pylist()], pa.list_(pa.bool_())),
                        pa.array([(lengths + 1).astype("<i4").tobytes()]), pa.array([squeeze(full.astype("<u4").tobytes())]),
                        pa.array([hashes.astype("<u8").tobytes()]), pa.array([len(full)]),
                        pa.array([int((lengths + 1)[~np.array(run.column("held"))].sum())]),
                    ],
                    names=["block", "ids", "held", "lengths", "codes", "hashes", "tokens", "trained"],
                )
                n += 1

    return docs.mapInArrow(pack, _BLOCK)


def _segments(tokens: int) -> int:
    return max(16, -(-2 * tokens // _SEGMENT_ITEMS))


class Block:
    """One row of :func:`tokenise`, unpacked."""

    def __init__(self, codes: bytes, lengths: bytes, hashes: bytes, held):
        self.codes = np.frombuffer(zstandard.ZstdDecompressor().decompress(codes), dtype="<u4").astype(np.int64)
        self.lengths = np.frombuffer(lengths, dtype="<i4").astype(np.int64)
        self.hashes = np.frombuffer(hashes, dtype="<u8")
        self.held = np.array(held, dtype=bool)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)])[:-1]
        # contexts: the code before, or one past the last code at the start of a text
        self.before = np.concatenate([[0], self.codes[:-1]])[: len(self.codes)]
        self.before[self.starts] = len(self.hashes)
        self.contexts = np.concatenate([self.hashes, [_START]])

    def pairs(self, where=slice(None), **how):
        return np.unique(self.before[where] * len(self.hashes) + self.codes[where], **how)

    def keys_of(self, pairs: np.ndarray) -> np.ndarray:
        return pair_keys(self.contexts[pairs // len(self.hashes)], self.hashes[pairs % len(self.hashes)])

    def ngrams(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The different pairs, the pair of each code, and the keys of all pairs, then of all contexts."""
        pairs, at = self.pairs(return_inverse=True)
        return pairs, at, np.concatenate([self.keys_of(pairs), word_keys(self.contexts)])

    @property
    def trained(self) -> np.ndarray:
        return np.repeat(~self.held, self.lengths)


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield {k: v[0] for k, v in batch.slice(i, 1).to_pydict().items()}


def _by_segment(hashes: np.ndarray, segments: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of a block's words in order of their segment, and the bounds of the segments."""
    return _in_order((mix(hashes ^ _START) % np.uint64(segments)).astype(np.int64), segments)


def _by_filter_segment(keys: np.ndarray, segments: int) -> tuple[np.ndarray, np.ndarray]:
    """The same of a block's n-gram keys."""
    return _in_order(((keys >> _KEY_BITS) % np.uint64(segments)).astype(np.int64), segments)


def _in_order(segment: np.ndarray, segments: int) -> tuple[np.ndarray, np.ndarray]:
    return np.argsort(segment, kind="stable"), np.concatenate([[0], np.cumsum(np.bincount(segment, minlength=segments))])


def count_words(blocks: DataFrame, segments: int) -> DataFrame:
    """Exact training counts of the words of every block: (block, segment, counts, known).

    Counts are in the order of the block's words that fall into the segment; ``known`` is the number of
    different training words of the segment, on one row of each segment.
    """

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _each(batches):
            b = Block(row["codes"], row["lengths"], row["hashes"], row["held"])
            n = np.bincount(b.codes[b.trained], minlength=len(b.hashes)).astype("<u4")
            order, bounds = _by_segment(b.hashes, segments)
            h, n = b.hashes[order], n[order]
            full = np.flatnonzero(np.diff(bounds)).tolist()
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(full, pa.int64()), pa.array([row["block"]] * len(full), pa.int64()),
                    pa.array([h[bounds[s] : bounds[s + 1]].tobytes() for s in full], pa.binary()),
                    pa.array([n[bounds[s] : bounds[s + 1]].tobytes() for s in full], pa.binary()),
                ],
                names=["segment", "block", "hashes", "n"],
            )

    def answer(parts: pd.DataFrame) -> pd.DataFrame:
        size = np.array([len(h) // 8 for h in parts["hashes"]])
        unique, at = np.unique(np.frombuffer(b"".join(parts["hashes"]), dtype="<u8"), return_inverse=True)
        total = np.bincount(at, weights=np.frombuffer(b"".join(parts["n"]), dtype="<u4"))
        mine, ends = total[at].astype("<i8"), np.cumsum(size)
        return pd.DataFrame({
            "block": parts["block"], "segment": parts["segment"],
            "counts": [mine[z - k : z].tobytes() for z, k in zip(ends.tolist(), size.tolist())],
            "known": [int((total > 0).sum())] + [0] * (len(parts) - 1),
        })

    asked = blocks.select("block", "codes", "lengths", "hashes", "held").mapInArrow(ask, "segment long, block long, hashes binary, n binary")
    return asked.groupBy("segment").applyInPandas(answer, "block long, segment long, counts binary, known long")


def _widen(keys: bytes) -> np.ndarray:
    low = np.frombuffer(keys, dtype=np.uint8).reshape(-1, _KEY_BYTES)
    wide = np.zeros((len(low), 8), dtype=np.uint8)
    wide[:, :_KEY_BYTES] = low
    return wide.view("<u8").ravel()


def answer_segment(keys: np.ndarray, counts: np.ndarray, size: int | None = None) -> np.ndarray:
    """Build a segment from the counts of keys, which may repeat, and probe it for each of them.

    Keys whose counts sum to 0 are only asked for. ``size`` is the segment's bits, if they are given.
    """
    unique, at = np.unique(keys, return_inverse=True)
    total = np.bincount(at, weights=counts, minlength=len(unique))
    known = total > 0
    size = size or segment_size(total[known])
    bits = np.frombuffer(segment_bits_of(unique[known], total[known], size), dtype=np.uint8)
    return LogFrequencyFilter(1, size, bits).levels(unique)[at]


def filter_levels(blocks: DataFrame, segments: int, filter_bits: int | None) -> DataFrame:
    """What the filter over all one- and two-word training counts answers: (block, segment, levels), a byte
    for each of the block's n-grams in the segment, in the order of :meth:`Block.ngrams`."""
    size = None if filter_bits is None else max(64, filter_bits // segments // 8 * 8)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _each(batches):
            b = Block(row["codes"], row["lengths"], row["hashes"], row["held"])
            pairs, at, key = b.ngrams()
            n = np.concatenate([
                np.bincount(at[b.trained], minlength=len(pairs)), np.bincount(b.codes[b.trained], minlength=len(b.hashes)),
                [int((~b.held).sum())],  # how often a text begins
            ])
            order, bounds = _by_filter_segment(key, segments)
            low, n = key[order].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :_KEY_BYTES], n[order]
            other = n != 1
            full = np.flatnonzero(np.diff(bounds)).tolist()
            runs = [slice(bounds[s], bounds[s + 1]) for s in full]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(full, pa.int64()), pa.array([row["block"]] * len(full), pa.int64()),
                    pa.array([low[r].tobytes() for r in runs], pa.binary()),
                    pa.array([np.flatnonzero(other[r]).astype("<u4").tobytes() for r in runs], pa.binary()),
                    pa.array([n[r][other[r]].astype("<u4").tobytes() for r in runs], pa.binary()),
                ],
                names=["segment", "block", "keys", "at", "n"],
            )

    def answer(parts: pd.DataFrame) -> pd.DataFrame:
        ends = np.cumsum([len(k) // _KEY_BYTES for k in parts["keys"]])
        n = np.ones(ends[-1], dtype=np.int64)
        for z, k, at, other in zip(ends.tolist(), parts["keys"], parts["at"], parts["n"]):
            n[z - len(k) // _KEY_BYTES + np.frombuffer(at, dtype="<u4").astype(np.int64)] = np.frombuffer(other, dtype="<u4")
        level = answer_segment(_widen(b"".join(parts["keys"])), n, size).astype(np.uint8)
        return pd.DataFrame({
            "block": parts["block"], "segment": parts["segment"],
            "levels": [level[z - len(k) // _KEY_BYTES : z].tobytes() for z, k in zip(ends.tolist(), parts["keys"])],
        })

    asked = blocks.select("block", "codes", "lengths", "hashes", "held").mapInArrow(
        ask, "segment long, block long, keys binary, at binary, n binary"
    )
    return asked.groupBy("segment").applyInPandas(answer, "block long, segment long, levels binary")


def score(
    df: DataFrame, is_held: Column, id_col: str = "doc_id", text_col: str = "text", mu: float = 1000.0,
    filter_bits: int | None = None, block_bytes: int = 4 << 20,
) -> DataFrame:
    """Per row: id, held_out, n_tokens, n_known, train_tokens, base_score and score.

    The filter is sized by the n-grams it stores; ``filter_bits`` sets its bits whatever the corpus.
    """
    prepare(df.sparkSession)
    docs = df.select(
        F.col(id_col).cast("long").alias("id"), F.coalesce(is_held, F.lit(False)).alias("held"), F.col(text_col).alias("text")
    )
    blocks = stage(tokenise(docs, block_bytes))
    size = blocks.agg(F.sum("tokens").alias("tokens"), F.sum("trained").alias("trained")).first()
    tokens, n = size["tokens"] or 0, size["trained"] or 0
    segments = _segments(tokens)
    counts = stage(count_words(blocks, segments))
    v = counts.agg(F.sum("known")).first()[0] or 0
    means = _step_means()

    def judge(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        for row in left.itertuples():
            b = Block(row.codes, row.lengths, row.hashes, row.held)
            order, _ = _by_segment(b.hashes, segments)
            exact = np.zeros(len(b.hashes))
            right = right.sort_values("segment")
            exact[order] = np.frombuffer(b"".join(right["answer"][~right["filter"]]), dtype="<i8")
            base = np.log10(exact + 1.0) - np.log10(n + v + 1.0)
            pairs, at, key = b.ngrams()
            known = np.zeros(len(key))
            known[_by_filter_segment(key, segments)[0]] = means[np.frombuffer(b"".join(right["answer"][right["filter"]]), dtype=np.uint8)]
            both, single = known[: len(pairs)], known[len(pairs) :]
            alone = (single[:-1] + 1.0) / (n + v + 1.0)
            context, follow = pairs // len(b.hashes), pairs % len(b.hashes)
            both = np.minimum(both, np.minimum(single[context], single[follow]))
            each = np.log10((both + mu * alone[follow]) / (single[context] + mu))
            out.append(pd.DataFrame({
                "id": pd.array(row.ids, dtype="Int64"), "held_out": b.held, "n_tokens": b.lengths,
                "n_known": np.add.reduceat((exact > 0)[b.codes].astype(np.int64), b.starts), "train_tokens": n,
                "base_score": np.add.reduceat(base[b.codes], b.starts), "score": np.add.reduceat(each[at], b.starts),
            }))
        return pd.concat(out, ignore_index=True) if out else pd.DataFrame(
            columns=["id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
        )

    levels = filter_levels(blocks, segments, filter_bits).select("block", "segment", F.lit(True).alias("filter"), F.col("levels").alias("answer"))
    answers = counts.select("block", "segment", F.lit(False).alias("filter"), F.col("counts").alias("answer")).union(levels)
    scored = blocks.drop("tokens", "trained").groupBy("block").cogroup(answers.groupBy("block")).applyInPandas(
        judge, "id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    )
    return scored.withColumnRenamed("id", id_col)


@query("op10_lm_score")
def op10_lm_score(spark, sf) -> DataFrame:
    return score(table(spark, sf, "documents"), held_out(F.col("doc_id"), 7))
