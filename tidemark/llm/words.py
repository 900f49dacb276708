"""Vectorised word and n-gram hashing over Arrow batches.

Words are runs of bytes other than ASCII white space. Hashes are 64-bit: a word's is xxh3 of its bytes, an
n-gram's a polynomial in its words' hashes modulo 2^64, mixed, so it depends on the words alone.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

BASE = np.uint64(0x9E3779B97F4A7C15)
BASE_INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))


def lower_ascii(texts: pa.Array) -> pa.Array:
    return pc.ascii_lower(texts)


def word_lists(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(all words in order, offsets of each text's words); null texts have none."""
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    words, offsets = lists.flatten(), np.asarray(lists.offsets, dtype=np.int64) - lists.offsets[0].as_py()
    keep = np.asarray(pc.greater(pc.binary_length(words), 0))
    if not keep.all():  # a space at either end makes an empty word
        offsets = np.concatenate(([0], np.cumsum(keep)))[offsets]
        words = words.filter(pa.array(keep))
    return words, offsets


def hash_words(words: pa.Array) -> np.ndarray:
    if not len(words):
        return np.zeros(0, np.uint64)
    coded = words.dictionary_encode()
    seen = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in coded.dictionary.cast(pa.binary()).to_pylist()), np.uint64, len(coded.dictionary))
    return seen[np.asarray(coded.indices)]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


@lru_cache(maxsize=4)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    ones = np.ones(n, np.uint64)
    ones[0] = 1
    up, down = np.full(n, BASE), np.full(n, BASE_INVERSE)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


class Prefixes:
    """Polynomial prefix sums over a run of word hashes: the hash of any span in constant time."""

    def __init__(self, hashes: np.ndarray):
        size = 1 << max(10, int(len(hashes)).bit_length())
        up, self.down = _powers(size)
        self.sums = np.zeros(len(hashes) + 1, np.uint64)
        np.cumsum(mix(hashes) * up[: len(hashes)], out=self.sums[1:])

    def spans(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """Hashes of the words [start, stop); equal spans have equal hashes wherever they stand."""
        return mix((self.sums[stop] - self.sums[start]) * self.down[start] + (stop - start).astype(np.uint64) * BASE)

    def grams(self, n: int) -> np.ndarray:
        """Hashes of all n-grams of the run."""
        count = len(self.sums) - n
        if count <= 0:
            return np.zeros(0, np.uint64)
        return mix((self.sums[n:] - self.sums[:-n]) * self.down[:count] + np.uint64(n * int(BASE) % (1 << 64)))


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every `width` neighbours, by doubling."""
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[:-step], out[step:])
        have += step
    return out
