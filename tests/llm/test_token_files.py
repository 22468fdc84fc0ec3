import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyarrow import fs
from tokenizers import Tokenizer

from gaugeworks.llm import token_files as tf
from gaugeworks.llm.pieces import regular

PATH = public_tokenizers.path("byte_bpe_50k.json")
ENCODER = tf.Encoder(PATH, special_as_text=False)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 3), st.integers(0, 60000), st.integers(0, 2**64 - 1)), max_size=300))
def test_words_round_trip(ids):
    ids = np.array(ids, dtype=np.uint64)
    words, escapes, blocks = tf.pack(ids)
    assert (tf.unpack(words, escapes, blocks) == ids).all()


def test_blocks_decode_alone():
    ids = np.random.default_rng(1).integers(0, 50257, 3 * tf.BLOCK + 17).astype(np.uint64)
    ids[5000] = 2**63 + 9
    words, escapes, blocks, documents = tf.parse_file(tf.file_bytes(*tf.pack(ids), np.array([[7, 1, len(ids)]])))
    for b, (at, n, lost) in enumerate(blocks):
        stop = blocks[b + 1] if b + 1 < len(blocks) else (len(words), 0, len(escapes))
        own = tf.unpack(words[at : stop[0]], escapes[lost : stop[2]], np.array([[0, n, 0]]))
        assert (own == ids[b * tf.BLOCK : b * tf.BLOCK + n]).all()
    assert len(words) < len(ids) / 3 and documents.tolist() == [[7, 1, len(ids)]]


def test_incomplete_file_is_refused():
    with pytest.raises(ValueError):
        tf.parse_file(tf.file_bytes(*tf.pack(np.arange(10, dtype=np.uint64)), np.zeros((0, 3)))[:-1])


@pytest.mark.parametrize("text", ["a b", "a  b", " a", "a ", "a \nb", "a\nb", "it's we'll 12 x,y!", "é à ü", "日本 語", "\x1c a\x1fb", "a　 b", "<|endoftext|> x"])
def test_pieces_give_the_library_ids(text):
    encoder = tf.Encoder(PATH)
    whole = Tokenizer.from_file(PATH)
    whole.encode_special_tokens = True
    assert np.frombuffer(encoder.encode(text), encoder.kind).tolist() == whole.encode(text, add_special_tokens=False).ids


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.sampled_from("abé'sZ9 .,!\n\t日ñ\u3000 "), max_size=30), max_size=6))
def test_texts_encoded_together_give_the_library_ids(texts):
    encoder, whole = ENCODER, Tokenizer.from_file(PATH)
    for text, ids in zip(texts, encoder.encode_all(texts), strict=True):
        assert np.frombuffer(ids, encoder.kind).tolist() == whole.encode(text, add_special_tokens=False).ids


def test_long_piece_of_marks_and_line_ends():
    text = "x " + "ab.\n" * 50_000 + " y" + "'" * 3 + "\n\n" + "é" * 40_000
    whole = Tokenizer.from_file(PATH)
    assert np.frombuffer(ENCODER.encode(text), ENCODER.kind).tolist() == whole.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("n", [0, 1, tf.BLOCK, 3 * tf.BLOCK + 5, 9 * tf.BLOCK])
def test_runs_of_blocks_equal_one_run(n):
    ids = np.random.default_rng(n).integers(0, 2**20, n).astype(np.uint64)
    if n > 5000:
        ids[[7, 5000]] = 2**62 + 3
    parts = tf.pack_runs(ids, run=2 * tf.BLOCK)
    for a, b in zip(parts, tf.pack(ids), strict=True):
        assert (a == b).all()
    assert (tf.unpack_runs(*parts, "<u8", run=2) == ids).all()


def test_regular():
    assert regular("a b\nc") and not regular("a  b") and not regular("a\n b") and not regular(" a") and not regular("a  b")


def _run(df, tmp_path, **how):
    folder = f"file://{tmp_path}"
    fs.FileSystem.from_uri(folder)[0].create_dir(str(tmp_path), recursive=True)
    files = tf.write_ids(df, PATH, folder, **how)
    return files, tf.read_ids(files, folder).collect()


def test_files_hold_the_corpus_in_order(odd, tmp_path):
    files, got = _run(odd, tmp_path, file_ids=5000)
    assert files.count() >= 2
    rows = sorted(((r.doc_id, r.text) for r in odd.collect()), key=lambda r: (r[0] is not None, r[0] or 0))
    whole, at = Tokenizer.from_file(PATH), 0
    for (doc_id, text), r in zip(rows, sorted(got, key=lambda r: r.start)):
        ids = whole.encode(text or "", add_special_tokens=False).ids + [0]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert len(got) == len(rows)


def test_empty_table(empty, tmp_path):
    assert _run(empty, tmp_path)[1] == []


SPECIAL = ["one <|endoftext|> two", "<|endoftext|>", "a<|endoftext|>b c", "x <|endoftext|>\n y", "<|endoftext| > z", "plain text"]


def test_added_tokens_are_those_of_the_unmodified_library(docs_of, tmp_path):
    whole, at = Tokenizer.from_file(PATH), 0
    assert whole.encode(SPECIAL[0], add_special_tokens=False).ids == [505, 220, 50256, 734]
    _, got = _run(docs_of(list(enumerate(SPECIAL))), tmp_path)
    for text, r in zip(SPECIAL, sorted(got, key=lambda r: r.doc_id), strict=True):
        ids = whole.encode(text, add_special_tokens=False).ids + [0]
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
