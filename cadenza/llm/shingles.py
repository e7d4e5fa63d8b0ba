"""Word shingles as 64-bit hashes, whole batches at a time."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash

WORDS = 5
_MIX, _STEP = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x9E3779B97F4A7C15)


def mixed(h: np.ndarray) -> np.ndarray:
    """A one-to-one scrambling of 64-bit values."""
    h = (h ^ (h >> np.uint64(30))) * _MIX
    return h ^ (h >> np.uint64(31))


def words_of(texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
    """(words of all texts as a dictionary array, number of words by text).

    Words are maximal runs of bytes other than space and 0x09-0x0D, with A-Z lower-cased;
    a null text has none.
    """
    lists = [t.lower().split() for t in texts.cast(pa.binary()).fill_null(b"").to_pylist()]
    flat = pa.array([w for ws in lists for w in ws], pa.binary())
    return flat.dictionary_encode(), np.fromiter(map(len, lists), np.int64, len(lists))


def shingle_sets(texts: pa.Array, words: int = WORDS) -> list[np.ndarray]:
    """The distinct shingles of each text, as sorted hashes.

    A text with fewer than ``words`` words has its whole sequence as one shingle; one
    without words has none.
    """
    coded, sizes = words_of(texts)
    if not len(coded):
        return [np.empty(0, np.uint64) for _ in sizes]
    table = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary))
    h = table[coded.indices.to_numpy()]
    total = np.zeros(max(0, len(h) - words + 1), np.uint64)
    for i in range(words):
        total = mixed(total * _STEP + h[i : i + len(total)])
    out, at = [], 0
    for n in sizes.tolist():
        if n >= words:
            out.append(np.unique(total[at : at + n - words + 1]))
        elif n:
            whole = np.full(1, n, np.uint64)
            for x in h[at : at + n]:
                whole = mixed(whole * _STEP + x + np.uint64(1))
            out.append(whole)
        else:
            out.append(np.empty(0, np.uint64))
        at += n
    return out
