"""Sets of word shingles as hashes, for whole batches of texts."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash

from gaugeworks.llm.lm_score import mix, split_words

_MULTIPLY = (np.uint64(0x9FB21C651E98DF25), np.uint64(0xC2B2AE3D27D4EB4F))


def shingle_sets(texts: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Different shingles of every text, ascending, all texts in a row, and their number per text.

    Words are cut at white space and A-Z lower-cased. A text of fewer words than ``width`` has its whole
    word sequence as its only shingle, a text without words has none.
    """
    codes, lengths, words = split_words(texts)
    if not len(codes):
        return np.zeros(0, dtype=np.uint64), np.zeros(len(lengths), dtype=np.int64)
    h = np.array([xxhash.xxh3_64_intdigest(w) for w in words], dtype=np.uint64)[codes]
    owner = np.repeat(np.arange(len(lengths)), lengths)
    left = np.repeat(np.cumsum(lengths), lengths) - np.arange(len(h))  # words from here to the text's end
    short = np.repeat(lengths, lengths) < width
    shingle = h.copy()
    for k in range(1, width):
        has = np.flatnonzero(left > k)
        shingle[has] = mix(shingle[has] * _MULTIPLY[0] + h[has + k])
    first = left == np.repeat(lengths, lengths)
    keep = np.where(short, first, left >= width)
    shingle = np.where(short, mix(shingle * _MULTIPLY[1] + np.repeat(lengths, lengths).astype(np.uint64)), mix(shingle))[keep]
    owner = owner[keep]
    order = np.lexsort((shingle, owner))
    shingle, owner = shingle[order], owner[order]
    new = np.ones(len(shingle), dtype=bool)
    new[1:] = (shingle[1:] != shingle[:-1]) | (owner[1:] != owner[:-1])
    return shingle[new], np.bincount(owner[new], minlength=len(lengths))
