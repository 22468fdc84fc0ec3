"""Byte-level BPE by replaying the merges over a corpus of words.

Texts are split into words by the vocabulary's pattern. All different words of a batch stand in one
array of symbols, at first one per byte. An inverted index leads from each merge to the positions of
its pairs. Merges are applied in rank order, each one at all its positions at once; only the two pairs
at the new symbol's sides change, and they enter the index. A word then has the ids that repeated
merging of its lowest pair gives.

Words do not depend on each other, so batches are independent tasks with no shuffle. Words already
known to a worker process are not replayed again; what it keeps has a fixed size. Memory follows the
batch, never the corpus; the vocabulary is read from its file in every worker.

Defined results: a null or empty text has no ids and decodes to no bytes; the strings of special tokens
are ordinary text; copies get equal ids; extra columns pass through.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from tokenizers import pre_tokenizers

from gaugeworks.llm.pieces import regular
from gaugeworks.llm.registry import query
from gaugeworks.plans.bindings import table
from gaugeworks.session import prepare

_SHIFT = 24  # of the left id in a pair's number
_NONE = np.iinfo(np.int64).max
# Up to here the two Unicode tables in use (of the pattern module and of the tokenizers) agree.
_COMMON = regex.compile(r"[^\u0000-ɏ]")


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


class Merges:
    """The vocabulary as a sorted table of pairs and the id each pair becomes."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes = np.array([ranks[bytes([i])] for i in range(256)], dtype=np.int64)
        pairs = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    pairs[left << _SHIFT | right] = rank
        self.pairs = np.array(sorted(pairs), dtype=np.int64)
        self.made = np.array([pairs[p] for p in self.pairs.tolist()], dtype=np.int64)
        self.spelled: dict[int, list[int]] = {}  # the pairs that become an id
        for pair, rank in pairs.items():
            self.spelled.setdefault(rank, []).append(pair)

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of the merge of two neighbours, ``_NONE`` where there is none."""
        if not len(self.pairs):
            return np.full(len(left), _NONE)
        pair = left << _SHIFT | right
        at = np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)
        return np.where(self.pairs[at] == pair, self.made[at], _NONE)

    def one_by_one(self, word: bytes) -> list[int]:
        """The same for a single word: merge the leftmost lowest pair until none is left."""
        parts = self.bytes[np.frombuffer(word, dtype=np.uint8)].tolist()
        while len(parts) > 1:
            rank = self.rank_of(np.array(parts[:-1]), np.array(parts[1:]))
            at = int(rank.argmin())
            if rank[at] == _NONE:
                break
            parts[at : at + 2] = [int(rank[at])]
        return parts

    def replay(self, words: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in a row, and the number of ids of each."""
        size = np.array([len(w) for w in words], dtype=np.int64)
        symbol = self.bytes[np.frombuffer(b"".join(words), dtype=np.uint8)]
        word = np.repeat(np.arange(len(words)), size)
        n = len(symbol)
        # neighbours by position; n is the border of a word. One more slot takes writes to the border.
        after, before = np.arange(1, n + 2), np.arange(-1, n)
        after[n] = n
        first = np.cumsum(size) - size
        before[first[size > 0]] = n
        after[(first + size - 1)[size > 0]] = n
        symbol = np.append(symbol, 0)
        alive = np.ones(n + 1, dtype=bool)
        odd = np.zeros(len(words), dtype=bool)  # words where a merge made a pair of lower rank
        index: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def enter(left: np.ndarray, than: int) -> None:
            """Put the pairs that start at these positions into the index."""
            rank = self.rank_of(symbol[left], symbol[after[left]])
            real = rank != _NONE
            if not real.all():
                left, rank = left[real], rank[real]
            if not len(left):
                return
            order = np.argsort(rank, kind="stable")
            left, rank = left[order], rank[order]
            if rank[0] < than:
                odd[word[left[rank < than]]] = True
            cuts = (np.flatnonzero(rank[1:] != rank[:-1]) + 1).tolist()
            for start, stop in zip([0, *cuts], [*cuts, len(rank)]):
                r = int(rank[start])
                if r in index:
                    index[r].append(left[start:stop])
                else:
                    index[r] = [left[start:stop]]
                    heapq.heappush(heap, r)

        enter(np.flatnonzero(after[:n] < n), -1)
        while heap:
            r = heapq.heappop(heap)
            found = index.pop(r)
            at = np.sort(np.concatenate(found) if len(found) > 1 else found[0])
            beside = after[at]
            pair = symbol[at] << _SHIFT | symbol[beside]
            first, *others = self.spelled[r]
            ok = pair == first
            for another in others:
                ok |= pair == another
            ok &= alive[at]
            ok &= beside < n
            ok[1:] &= at[1:] != at[:-1]
            at = at[ok]
            if not len(at):
                continue
            gone = after[at]
            overlaps = gone[:-1] == at[1:]
            if overlaps.any():  # runs such as a a a: every other one, from the left
                starts = np.ones(len(at), dtype=bool)
                starts[1:] = ~overlaps
                run = np.maximum.accumulate(np.where(starts, np.arange(len(at)), 0))
                at = at[(np.arange(len(at)) - run) % 2 == 0]
                gone = after[at]
            symbol[at] = r
            alive[gone] = False
            following = after[gone]
            after[at] = following
            before[following] = at
            ahead = before[at]
            touched = np.concatenate([ahead[ahead < n], at[following < n]])
            if len(touched):
                enter(touched, r)
        kept = np.flatnonzero(alive[:n])
        ids, counts = symbol[kept], np.bincount(word[kept], minlength=len(words))
        if odd.any():
            ids, counts = self._redo(words, ids, counts, odd)
        return ids, counts

    def _redo(self, words, ids, counts, odd):
        """Encode the odd words one by one: there, the order of merges within the word matters."""
        parts = np.split(ids, np.cumsum(counts)[:-1])
        for i in np.flatnonzero(odd):
            parts[i] = np.array(self.one_by_one(words[i]), dtype=np.int64)
        return np.concatenate(parts), np.array([len(p) for p in parts])


class _Places(dict):
    """The place of a piece's ids; a new piece gets the next place and waits for its ids."""

    def __init__(self, coder: Coder, blank: str):
        self.coder, self.blank = coder, blank

    def __missing__(self, piece: str) -> int:
        self[piece] = place = len(self.coder.coded) + len(self.coder.fresh)
        self.coder.fresh.append((self.blank, piece))
        return place


class Coder:
    """Texts to ids and back, with the words a worker process has met."""

    def __init__(self, path: str, most: int = 500_000):
        self.merges = Merges(load_ranks(path))
        tokens = [b""] * (max(self.merges.ranks.values()) + 1)
        for token, rank in self.merges.ranks.items():
            tokens[rank] = token
        self.tokens = pa.array(tokens, pa.binary())
        self.find = regex.compile(public_tokenizers.PATTERN).findall
        self.library = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True).pre_tokenize_str
        self.most = most
        self._forget()

    def _forget(self) -> None:
        self.coded: list[bytes] = []  # the ids of every piece met
        self.fresh: list[tuple[str, str]] = []  # pieces without ids yet, those last met
        self.bare, self.known = _Places(self, ""), _Places(self, " ")  # places of bare pieces and of those after a blank

    def words(self, text: str) -> list[str]:
        if _COMMON.search(text):  # letters that only one of the tables may know
            return [text[a:b] for _, (a, b) in self.library(text)]
        return self.find(text)

    def _cut(self, text: str) -> tuple[list[str], list[str]]:
        """A text as bare pieces and pieces after a blank, cut at blanks that no word reaches across; a
        text with other white space next to a blank comes as its words, all of them bare."""
        if not text:
            return [], []
        if not regular(text):
            return self.words(text), []
        first, *rest = text.split(" ")
        return [first], rest

    def _learn(self) -> None:
        words, spelled = {}, []
        for blank, piece in self.fresh:
            own = [blank + piece] if piece.isascii() and piece.isalpha() else self.words(blank + piece)
            spelled.append([words.setdefault(w, len(words)) for w in own])
        raw = [w.encode("utf-8", "replace") for w in words]
        coded = [self.merges.ranks.get(w) for w in raw]
        parts = [i for i, r in enumerate(coded) if r is None]
        coded = [b"" if r is None else r.to_bytes(4, "little") for r in coded]
        if parts:
            ids, counts = self.merges.replay([raw[i] for i in parts])
            flat, ends = ids.astype("<i4").tobytes(), (np.cumsum(counts) * 4).tolist()
            for i, a, b in zip(parts, [0, *ends], ends):
                coded[i] = flat[a:b]
        self.coded += [coded[at[0]] if len(at) == 1 else b"".join([coded[i] for i in at]) for at in spelled]
        self.fresh.clear()

    def encode(self, texts: Sequence[str]) -> Iterator[bytes]:
        """Ids of each text as little-endian 32-bit numbers."""
        if len(self.coded) > self.most:
            self._forget()
        places = []
        for text in texts:
            one, rest = self._cut(text)
            places.append([*map(self.bare.__getitem__, one), *map(self.known.__getitem__, rest)])
        if self.fresh:
            self._learn()
        for own in places:
            yield b"".join(map(self.coded.__getitem__, own))

    def decode(self, ids: pa.Array, ends: np.ndarray) -> pa.Array:
        """The bytes of lists of ids that lie one after the other between ``ends``."""
        parts = self.tokens.take(ids)
        _, offsets, data = parts.buffers()
        at = np.frombuffer(offsets, dtype="<i4", count=len(ids) + 1)[ends] if len(ids) else np.zeros(len(ends), dtype="<i4")
        return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(at.astype("<i4").tobytes()), data or pa.py_buffer(b"")])


@lru_cache(maxsize=2)
def _coder(path: str) -> Coder:
    return Coder(path)


def _runs(values: pa.Array, most: int) -> Iterator[pa.Array]:
    """Runs of rows of about ``most`` bytes, so that a batch of long texts is coded in parts."""
    size = pc.fill_null(pc.binary_length(values), 0).to_numpy(zero_copy_only=False)
    run = np.cumsum(size) // most
    cuts = (np.flatnonzero(np.diff(run)) + 1).tolist() if len(run) else []
    for a, b in zip([0, *cuts], [*cuts, len(values)]):
        yield values.slice(a, b - a)


def _id_lists(coder: Coder, texts: pa.Array, run_bytes: int) -> pa.Array:
    values, ends = [], [0]
    for run in _runs(texts, run_bytes):
        for ids in coder.encode([t or "" for t in run.to_pylist()]):
            values.append(ids)
            ends.append(ends[-1] + len(ids) // 4)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(values), dtype="<i4")))


def _bytes_of(coder: Coder, ids: pa.Array) -> pa.Array:
    ends = ids.offsets.to_numpy()
    return coder.decode(ids.flatten(), ends - ends[0])


def encoder(path: str, run_bytes: int = 8 << 20) -> Callable[[Column], Column]:
    """A column function from text to ARRAY<INT> of ids."""

    @F.arrow_udf("array<int>")
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        coder = _coder(path)
        for texts in batches:
            yield _id_lists(coder, texts, run_bytes)

    return encode


def decoder(path: str) -> Callable[[Column], Column]:
    """A column function from ids to the bytes they stand for."""

    @F.arrow_udf("binary")
    def decode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        coder = _coder(path)
        for ids in batches:
            yield _bytes_of(coder, ids)

    return decode


def round_trip(path: str, run_bytes: int = 8 << 20) -> Callable[[Column], Column]:
    """A column function from text to its ids and the bytes these decode to, in one worker."""

    @F.arrow_udf("struct<ids: array<int>, decoded: binary>")
    def both(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        coder = _coder(path)
        for texts in batches:
            ids = _id_lists(coder, texts, run_bytes)
            yield pa.StructArray.from_arrays([ids, _bytes_of(coder, ids)], names=["ids", "decoded"])

    return both


def encode_texts(df: DataFrame, path: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """Add the ids of every whole text."""
    prepare(df.sparkSession)
    return df.withColumn(ids_col, encoder(path)(F.col(text_col)))


def decode_ids(df: DataFrame, path: str, ids_col: str = "ids", bytes_col: str = "decoded") -> DataFrame:
    """Add the bytes that ids stand for."""
    prepare(df.sparkSession)
    return df.withColumn(bytes_col, decoder(path)(F.col(ids_col)))


@query("op3_byte_bpe")
def op3_byte_bpe(spark, sf) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    docs = table(prepare(spark), sf, "documents").select("doc_id", round_trip(path)(F.col("text")).alias("r"))
    return docs.select("doc_id", "r.*").select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")).cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
