import numpy as np
import pyarrow as pa
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from gaugeworks.llm import merge_replay as mr

PATH = P.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=mr.load_ranks(PATH), special_tokens={})


@pytest.fixture(scope="module")
def coder():
    return mr.Coder(PATH)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from("aabc é'1\n\t !日ß"), st.characters(codec="utf-8")), max_size=60), max_size=6))
def test_equals_the_library(coder, library, texts):
    coded = [np.frombuffer(ids, "<i4") for ids in coder.encode(texts)]
    assert [ids.tolist() for ids in coded] == [library.encode_ordinary(text) for text in texts]
    flat, ends = np.concatenate([*coded, np.zeros(0, "<i4")]), np.cumsum([0, *map(len, coded)])
    assert coder.decode(pa.array(flat, pa.int32()), ends).to_pylist() == [text.encode() for text in texts]


def test_a_full_memory_of_pieces_starts_anew(library):
    small = mr.Coder(PATH, most=3)
    for text in ["one two three four five", "one two", "six seven eight", "one six nine ten eleven", "one two three"]:
        assert np.frombuffer(next(small.encode([text])), "<i4").tolist() == library.encode_ordinary(text)


def test_small_vocabularies_with_odd_orders():
    """Random merge tables, also ones where a longer token ranks before its parts."""
    rng = np.random.default_rng(3)
    for _ in range(60):
        ranks, letters = {bytes([i]): i for i in range(256)}, b"abc"
        for _ in range(25):
            token = bytes(rng.choice(list(letters), rng.integers(2, 5)))
            ranks.setdefault(token, 256 + int(rng.integers(0, 10**6)))
        merges = mr.Merges(ranks)
        words = [bytes(rng.choice(list(letters), rng.integers(1, 14))) for _ in range(40)]
        ids, counts = merges.replay(words)
        parts = np.split(ids, np.cumsum(counts)[:-1])
        for word, part in zip(words, parts):
            assert part.tolist() == merges.one_by_one(word), (word, ranks)


def test_rows(odd, empty, library):
    out = mr.decode_ids(mr.encode_texts(odd, PATH), PATH).collect()
    assert len(out) == odd.count()
    for r in out:
        assert r.ids == library.encode_ordinary(r.text or "") and bytes(r.decoded) == (r.text or "").encode()
    assert mr.decode_ids(mr.encode_texts(empty, PATH), PATH).collect() == []
