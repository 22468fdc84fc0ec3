"""Token ids in binary files, coded with Simple-8b.

A file (``.s8b``) holds the ids of whole documents, in blocks of 4,096 ids that can be decoded alone:

    magic "S8B-IDS1"
    words      little-endian 64-bit: selector in the top 4 bits, ids of equal width in the other 60
    escapes    one byte for each id of 2^60 or more: its top 4 bits; the word holds the other 60
    blocks     n x (word offset, ids, escape offset), 64 bits each
    documents  n x (id, has id, ids), 64 bits each
    counts     words, escapes, blocks, documents, 64 bits each, then the magic again

Documents are range-partitioned by id and every task writes its range in order, so the files in order of
(part, number) hold the corpus in order of id. A file has a name of its own for each attempt and is
listed in a table that Spark writes; what a lost or repeated task left behind is in no list. Positions
in the corpus come from the list's sums, one row per file.

Defined results: a null or empty text is the end id alone; null document ids come first; equal ids are
ordered by text; an empty table gives an empty list; extra columns are ignored.
"""

from __future__ import annotations

import re
import uuid
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window
from tokenizers import Tokenizer
from tokenizers.pre_tokenizers import ByteLevel

from gaugeworks.llm.pieces import regular
from gaugeworks.llm.registry import query
from gaugeworks.plans.bindings import table
from gaugeworks.session import checkpoint_root, prepare, stage

MAGIC = b"S8B-IDS1"
BLOCK = 4096
#: Ids per word and bits per id of the selectors; 0 is one escaped id.
SELECTORS = ((1, 60), (120, 0), (60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60))
_COUNT = np.array([c for c, _ in SELECTORS])
_WIDEST = max(c for c, _ in SELECTORS)
_LOW = np.uint64((1 << 60) - 1)
_BY_COUNT = [s for s in sorted(range(1, len(SELECTORS)), key=lambda s: SELECTORS[s][0])]


def _widths(ids: np.ndarray) -> np.ndarray:
    """Bits of the narrowest selector that holds each id; 64 for an escape."""
    bits = sorted(b for _, b in SELECTORS)
    limits = np.array([1 << b for b in bits], dtype=np.uint64)
    out = np.array([*bits, 64], dtype=np.uint8)
    if int(ids.max()) < 1 << 20:
        return out[np.searchsorted(limits, np.arange(int(ids.max()) + 1, dtype=np.uint64), side="right")][ids]
    return out[np.searchsorted(limits, ids, side="right")]


def pack(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words, escapes and block rows of a run of ids. All blocks advance together, a word at a time."""
    n = len(ids)
    blocks = -(-n // BLOCK)
    if not n:
        return np.zeros(0, "<u8"), np.zeros(0, np.uint8), np.zeros((0, 3), "<i8")
    grid = np.zeros((blocks, BLOCK + _WIDEST), dtype=np.uint64)
    grid[: n // BLOCK, :BLOCK] = ids[: n // BLOCK * BLOCK].reshape(-1, BLOCK)
    grid[n // BLOCK :, : n % BLOCK] = ids[n // BLOCK * BLOCK :]
    size = np.full(blocks, BLOCK)
    size[-1] = n - BLOCK * (blocks - 1)
    width, choice = _widths(grid), np.zeros((blocks, BLOCK), dtype=np.uint8)  # escape, unless something fits
    reach, span = width, 1  # the widest id of the ``span`` ids from here on
    for s in _BY_COUNT:
        count, bits = SELECTORS[s]
        while span < count:
            step = min(span, count - span)
            reach, span = np.maximum(reach[:, : reach.shape[1] - step], reach[:, step:]), span + step
        choice[reach[:, :BLOCK] <= bits] = s
    at, active, starts = np.zeros(blocks, dtype=np.int64), np.arange(blocks), np.zeros((blocks, BLOCK), dtype=bool)
    while len(active):
        starts[active, at] = True
        at = at + _COUNT[choice[active, at]]
        go = at < size[active]
        active, at = active[go], at[go]
    row, place = np.nonzero(starts)
    sel = choice[starts]
    words = sel.astype(np.uint64) << np.uint64(60)
    first = row * grid.shape[1] + place
    flat = grid.ravel()
    for s, (count, bits) in enumerate(SELECTORS):
        mine = np.flatnonzero(sel == s)
        if bits and len(mine):
            value = np.zeros(len(mine), dtype=np.uint64)
            for k in range(count):
                value |= (flat[first[mine] + k] & _LOW) << np.uint64(k * bits)
            words[mine] |= value
    escaped = sel == 0
    escapes = (flat[first[escaped]] >> np.uint64(60)).astype(np.uint8)
    per_block = np.bincount(row, minlength=blocks)
    lost = np.bincount(row[escaped], minlength=blocks)
    table_ = np.stack([np.cumsum(per_block) - per_block, size, np.cumsum(lost) - lost], axis=1).astype("<i8")
    return words.astype("<u8"), escapes, table_


def pack_runs(ids: np.ndarray, run: int = 256 * BLOCK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``pack``, a run of whole blocks at a time, so that the work space does not grow with the ids."""
    parts = [pack(ids[at : at + run]) for at in range(0, max(len(ids), 1), run)]
    shift = np.zeros(3, dtype="<i8")
    for words, escapes, blocks in parts:
        blocks += shift
        shift = shift + np.array([len(words), 0, len(escapes)])
    words, escapes, blocks = zip(*parts)
    return np.concatenate(words), np.concatenate(escapes), np.concatenate(blocks)


def unpack_runs(words: np.ndarray, escapes: np.ndarray, blocks: np.ndarray, kind: str, run: int = 256) -> np.ndarray:
    """``unpack`` of a whole file into ids of ``kind``, a run of blocks at a time."""
    out, done = np.zeros(int(blocks[:, 1].sum()), dtype=kind), 0
    for at in range(0, len(blocks), run):
        rows = blocks[at : at + run]
        stop = blocks[at + run] if at + run < len(blocks) else (len(words), 0, len(escapes))
        first = rows[0]
        ids = unpack(words[first[0] : stop[0]], escapes[first[2] : stop[2]], rows - np.array([first[0], 0, first[2]]))
        out[done : done + len(ids)] = ids
        done += len(ids)
    return out


def unpack(words: np.ndarray, escapes: np.ndarray, blocks: np.ndarray) -> np.ndarray:
    """The ids of the blocks, in order; ``blocks`` may be any run of rows of a file's table."""
    sel = (words >> np.uint64(60)).astype(np.int64)
    counts = _COUNT[sel]
    start = np.cumsum(counts) - counts  # place with the filling at the end of each block
    out = np.zeros(int(counts.sum()), dtype=np.uint64)
    for s, (count, bits) in enumerate(SELECTORS):
        mine = np.flatnonzero(sel == s)
        if bits and len(mine):
            value, mask = words[mine] & _LOW, np.uint64((1 << bits) - 1)
            for k in range(count):
                out[start[mine] + k] = (value >> np.uint64(k * bits)) & mask
    escaped = np.flatnonzero(sel == 0)
    out[start[escaped]] |= escapes.astype(np.uint64) << np.uint64(60)
    if not len(blocks):
        return out[:0]
    begins = start[np.minimum(blocks[:, 0], len(start) - 1)] if len(start) else np.zeros(len(blocks), dtype=np.int64)
    size = blocks[:, 1]
    keep = np.repeat(begins - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
    return out[keep]


def file_bytes(words: np.ndarray, escapes: np.ndarray, blocks: np.ndarray, documents: np.ndarray) -> bytes:
    counts = np.array([len(words), len(escapes), len(blocks), len(documents)], dtype="<i8")
    return b"".join([MAGIC, words.tobytes(), escapes.tobytes(), blocks.tobytes(), documents.astype("<i8").tobytes(), counts.tobytes(), MAGIC])


def parse_file(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words, escapes, block table and document table of a file."""
    if raw[:8] != MAGIC or raw[-8:] != MAGIC:
        raise ValueError("not a complete token file")
    n_words, n_escapes, n_blocks, n_docs = np.frombuffer(raw, "<i8", 4, len(raw) - 40)
    at = 8
    words = np.frombuffer(raw, "<u8", n_words, at)
    at += 8 * n_words
    escapes = np.frombuffer(raw, np.uint8, n_escapes, at)
    at += n_escapes
    blocks = np.frombuffer(raw, "<i8", 3 * n_blocks, at).reshape(-1, 3)
    at += 24 * n_blocks
    return words, escapes, blocks, np.frombuffer(raw, "<i8", 3 * n_docs, at).reshape(-1, 3)


#: Characters whose runs the byte-level pattern cuts alike in any version of Unicode: Latin letters,
#: digits, marks but the apostrophe. A blank belongs to the run behind it.
_KINDS = (r"A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f", "0-9", r"!-&(-/:-@\[-`{-~")
_RUN = re.compile("|".join(f" ?[{kind}]+" for kind in _KINDS) + r"|\n")
#: A piece of anything else, or with two line ends together, is left to the library's splitter.
_SIMPLE = re.compile(rf"[{''.join(_KINDS)}\n]+")
#: Characters of texts that are encoded together.
SLICE = 4_000_000


class Encoder(dict):
    """Text to ids, as bytes of little-endian numbers of ``kind``, with the tokenizers library.

    A byte-level tokenizer with a pre-tokenizer never merges across a blank between two characters that
    are not white space, and the blank belongs to what follows. Such pieces are encoded once and kept,
    up to ``most`` pieces; a text with other white space next to a blank is encoded as a whole, and so is
    one with the string of an added token, which the library finds before it splits. With
    ``special_as_text`` the strings of special tokens are ordinary text instead.
    """

    def __init__(self, path: str, most: int = 600_000, special_as_text: bool = True):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = special_as_text
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values() if not (special_as_text and t.special)]
        self.kind = "<u2" if self.tokenizer.get_vocab_size(True) <= 1 << 16 else "<u4"
        self.most, self.starts, self.code = most, {}, "H" if self.kind == "<u2" else "I"
        self.split, self.merge = self.tokenizer.pre_tokenizer.pre_tokenize_str, self.tokenizer.model.tokenize
        self.plain = isinstance(self.tokenizer.pre_tokenizer, ByteLevel) and self.tokenizer.pre_tokenizer.use_regex
        self.words: dict[str, bytes] = {}
        # how the library spells each byte of a word, read off characters of one and two bytes
        self.spell = {}
        for char in map(chr, range(1, 0x800)):
            self.spell.update(zip(char.encode(), self.split(char)[0][0]))

    def _ids(self, piece: str) -> bytes:
        return array(self.code, [t.id for word, _ in self.split(piece) for t in self.merge(word)]).tobytes()

    def __missing__(self, piece: str) -> bytes:
        """A piece with its blank."""
        out = self[piece] = self._ids(" " + piece)
        return out

    def _learn(self, pieces: set[str]) -> None:
        """Keep the ids of many pieces: all are cut by one pattern and spelled at once, and every word is
        merged once, whatever stands around it."""
        if not self.plain:
            return
        simple = [p for p in pieces if _SIMPLE.fullmatch(p) and "\n\n" not in p]
        runs = _RUN.findall(" " + " ".join(simple)) if simple else []
        new = [run for run in set(runs) if run not in self.words]
        spelled = "\0".join(new).encode().decode("latin-1").translate(self.spell).split("\0") if new else []
        merge, code = self.merge, self.code
        self.words.update(zip(new, [array(code, [t.id for t in merge(word)]).tobytes() for word in spelled]))
        ids = list(map(self.words.__getitem__, runs))
        begins = [k for k, run in enumerate(runs) if run[0] == " "]
        ends = [*begins[1:], len(runs)]
        self.update(zip(simple, [ids[a] if z - a == 1 else b"".join(ids[a:z]) for a, z in zip(begins, ends)]))

    def _first(self, piece: str) -> bytes:
        out = self.starts.get(piece)
        if out is None:
            out = self.starts[piece] = self._ids(piece)
        return out

    def _after_blanks(self, rests: list[str], run: int = 500_000) -> list[np.ndarray]:
        """The ids of texts that begin behind a blank. Equal pieces are found by Arrow, looked up once, and
        their ids dealt to their places, ``run`` pieces at a time."""
        lists = pc.split_pattern(pa.array(rests, pa.large_string()), " ")
        coded = lists.flatten().dictionary_encode()
        different, place = coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy()
        ids = list(map(self.get, different))
        self._learn({piece for piece, known in zip(different, ids) if known is None})
        ids = [self[piece] if known is None else known for piece, known in zip(different, ids)]
        flat = np.frombuffer(b"".join(ids), dtype=self.kind)
        size = np.fromiter(map(len, ids), np.int64, len(ids)) // flat.itemsize
        start, parts = np.cumsum(size) - size, []
        for at in range(0, len(place), run):
            own = place[at : at + run]
            n = size[own]
            parts.append(flat[np.repeat(start[own] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))])
        ends = np.concatenate([[0], np.cumsum(size[place])])[lists.offsets.to_numpy()]
        whole = np.concatenate(parts)
        return [whole[a:z] for a, z in zip(ends[:-1].tolist(), ends[1:].tolist())]

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """The ids of every text; pieces that are new in all of them are encoded together."""
        cut = [t.partition(" ") if t and regular(t) and not any(token in t for token in self.added) else None for t in texts]
        rests = [c[2] for c in cut if c and c[2]]
        ids = iter(self._after_blanks(rests)) if rests else iter(())
        out = []
        for text, pieces in zip(texts, cut):
            if pieces:
                out.append(self._first(pieces[0]) + (next(ids).tobytes() if pieces[2] else b""))
            else:
                out.append(np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=self.kind).tobytes() if text else b"")
        return out

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]

    def trim(self) -> None:
        if len(self) > self.most:
            self.clear()
        if len(self.words) > self.most:
            self.words.clear()
        if len(self.starts) > self.most // 8:
            self.starts.clear()


@lru_cache(maxsize=2)
def _encoder(path: str) -> Encoder:
    """One encoder per worker process and vocabulary; it gives the library's ids."""
    return Encoder(path, special_as_text=False)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[str]]]:
    """Ids and texts of a batch, up to about ``SLICE`` bytes of text at a time; a longer text is one slice."""
    for batch in batches:
        sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            done = int(sizes[at - 1]) if at else 0
            to = max(at + 1, int(np.searchsorted(sizes, done + SLICE, side="right")))
            part = batch.slice(at, to - at)
            yield part.column("id").to_pylist(), [t or "" for t in part.column("text").to_pylist()]
            at = to


_FILE = "part int, number int, path string, documents long, ids long"
_READ = "doc_id long, start long, n_tokens long, ids_crc32 long"


def write_ids(
    df: DataFrame, tokenizer: str, folder: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0,
    file_ids: int = 8_000_000,
) -> DataFrame:
    """Encode every text, append ``end_id``, write files into ``folder`` (shared by all executors).

    Returns the list of files with ``start``, the number of ids in all files before. A file is closed at
    the first document end past ``file_ids`` ids.
    """
    prepare(df.sparkSession)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, encoder, number = TaskContext.get().partitionId(), _encoder(tokenizer), 0
        store, root = fs.FileSystem.from_uri(folder)
        end = np.array([end_id], dtype=encoder.kind).tobytes()
        width = np.dtype(encoder.kind).itemsize
        documents, waiting, held = [], [], 0

        def close():
            path = f"{root}/part-{part:06d}-{number:06d}-{uuid.uuid4().hex}.s8b"
            packed = pack_runs(np.frombuffer(b"".join(waiting), dtype=encoder.kind))
            with store.open_output_stream(path) as out:
                out.write(file_bytes(*packed, np.array(documents)))
            row = {"part": part, "number": number, "path": path, "documents": len(documents), "ids": held}
            return pa.RecordBatch.from_pylist(
                [row], schema=pa.schema([("part", pa.int32()), ("number", pa.int32()), ("path", pa.string()), ("documents", pa.int64()), ("ids", pa.int64())])
            )

        for keys, texts in _slices(batches):
            for key, ids in zip(keys, encoder.encode_all(texts)):
                waiting.append(ids + end)
                documents.append((key or 0, key is not None, len(ids) // width + 1))
                held += documents[-1][2]
                if held >= file_ids:
                    yield close()
                    number, documents, waiting, held = number + 1, [], [], 0
            encoder.trim()
        if documents:
            yield close()

    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    ordered = rows.repartitionByRange("id").sortWithinPartitions("id", "text")
    files = stage(ordered.mapInArrow(write, _FILE))
    before = Window.orderBy("part", "number").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    return files.withColumn("start", F.coalesce(F.sum("ids").over(before), F.lit(0)))


def read_ids(files: DataFrame, folder: str) -> DataFrame:
    """Read listed files back: doc_id, start (ids before it in the corpus), n_tokens and the crc32 of
    the ids as little-endian unsigned 32-bit numbers."""
    prepare(files.sparkSession)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for path, start in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist()):
                with store.open_input_stream(path) as source:
                    words, escapes, blocks, documents = parse_file(source.read())
                ids = unpack_runs(words, escapes, blocks, "<u4")
                size = documents[:, 2]
                ends = np.cumsum(size)
                crc = [zlib.crc32(ids[z - n : z].data) for z, n in zip(ends.tolist(), size.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(documents[:, 0], mask=documents[:, 1] == 0), pa.array(start + ends - size),
                        pa.array(size), pa.array(crc, pa.int64()),
                    ],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    spread = files.select("path", "start").repartition(max(1, files.count()), "path")
    return spread.mapInArrow(read, _READ)


@query("op1_token_files")
def op1_token_files(spark, sf) -> DataFrame:
    folder = f"{checkpoint_root(prepare(spark))}/tokens-{uuid.uuid4().hex}"
    folder = folder if ":/" in folder else f"file://{folder}"
    store, root = fs.FileSystem.from_uri(folder)
    store.create_dir(root, recursive=True)
    files = write_ids(table(spark, sf, "documents"), public_tokenizers.path("byte_bpe_50k.json"), folder)
    return read_ids(files, folder)
