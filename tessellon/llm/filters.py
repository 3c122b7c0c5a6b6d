"""Filters of bounded size that tell which rows can have a partner, so that only those take part in a join."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits that a filter has for each hash, and how many of them a hash sets.
BITS_EACH, PROBES = 32, 6
#: Bits that a filter has at most (64 MB). With more hashes it lets more through to the join; none is lost.
MOST_BITS = 1 << 29


def hash_of(word: str) -> int:
    """64 bits of a string, the same in every process."""
    return int.from_bytes(hashlib.blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")


def _places(h: np.ndarray, bits: int) -> Iterator[np.ndarray]:
    """The places in a filter of `bits` bits, a power of two, that stand for each hash, one after another."""
    step = (h >> np.uint64(31)) | np.uint64(1)
    at = h.copy()
    for _ in range(PROBES):
        yield at & np.uint64(bits - 1)
        at += step


def may_hold(words: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Numbers of the hashes that the filter lets through, in order."""
    left = np.arange(len(h))
    step = (h >> np.uint64(31)) | np.uint64(1)
    at, last = h.copy(), np.uint64(64 * len(words) - 1)
    for _ in range(PROBES):
        place = at & last
        keep = (words[(place >> np.uint64(6)).view(np.int64)] >> (place & np.uint64(63))) & np.uint64(1) == 1
        left, at, step = left[keep], at[keep], step[keep]
        at += step
    return left


def build(hashes: DataFrame) -> np.ndarray:
    """The words of a filter of hashes (h bigint), repeated ones or not. What comes to the driver is the filter itself, MOST_BITS at most."""
    n = hashes.count()
    bits = max(64, 1 << min((max(n, 1) * BITS_EACH - 1).bit_length(), MOST_BITS.bit_length() - 1))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            at = np.concatenate([np.empty(0, np.uint64), *_places(p["h"].to_numpy().view(np.uint64), bits)])
            yield pd.DataFrame({"word": (at >> np.uint64(6)).astype(np.int32), "bit": (np.uint64(1) << (at & np.uint64(63))).view(np.int64)})

    set_bits = hashes.select("h").mapInPandas(run, "word int, bit bigint").groupBy("word").agg(F.bit_or("bit").alias("bits")).toPandas()
    words = np.zeros(bits // 64, np.uint64)
    words[set_bits["word"].to_numpy(np.int64)] = set_bits["bits"].to_numpy(np.int64).view(np.uint64)
    return words
