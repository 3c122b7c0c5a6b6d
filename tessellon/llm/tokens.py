"""Words or characters of many texts as 64-bit hashes, without a Python object for each."""

from __future__ import annotations

import re
import sys
import types
import unicodedata

import numpy as np

#: Characters that show nothing and are deleted before any comparison.
IGNORABLE = "­͏؜ᅟᅠ឴឵᠋᠌᠍᠎​‌‍‎‏‪‫‬‭‮⁠⁡⁢⁣⁤⁦⁧⁨⁩⁪⁫⁬⁭⁮⁯ㅤ︀︁︂︃︄︅︆︇︈︉︊︋︌︍︎️﻿ﾠ"

# characters whose compatibility form is another letter or digit lie outside this class; its wide punctuation is none
_ODD = re.compile("[^\\x00-\\x7f\\u4e00-\\u9fff\\u3001-\\u3011\\uff01\\uff08\\uff09\\uff0c\\uff1a\\uff1b\\uff1f\\u2013\\u2014\\u2018-\\u201d\\u2026]")
_TOP = 0x32400
_LONGEST = 4096


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _tables() -> types.ModuleType:
    """Character classes and powers, made once in each worker process."""
    kept = sys.modules.get("_tessellon_tables")
    if kept is None:
        kept = types.ModuleType("_tessellon_tables")
        kept.word = np.array([chr(c).isalnum() for c in range(_TOP)])
        kept.drop = np.zeros(_TOP, bool)
        kept.drop[[ord(c) for c in IGNORABLE]] = True
        ideograph = np.zeros(_TOP, bool)
        for low, high in ((0x3040, 0x30FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x323AF)):
            ideograph[low : high + 1] = True
        kept.ideograph = ideograph
        powers = np.empty(_LONGEST, np.uint64)
        p = 1
        for i in range(_LONGEST):
            powers[i] = p
            p = p * 0x9E3779B97F4A7C15 % (1 << 64) | 1
        kept.powers = powers
        sys.modules["_tessellon_tables"] = kept
    return kept


def codes_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(code points, text number of each): compatibility forms, lower case, ignorable characters deleted."""
    t = _tables()
    joined = "\0".join(x if x.isascii() or not _ODD.search(x) else unicodedata.normalize("NFKC", x) for x in (x.replace("\0", " ") for x in texts)).lower()
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    doc = np.cumsum(codes == 0, dtype=np.int32)
    if len(codes) and codes.max() >= _TOP:
        codes = np.where(codes < _TOP, codes, 0xFFFD)
    keep = ~t.drop[codes]
    return (codes, doc) if keep.all() else (codes[keep], doc[keep])


def is_ideographic(texts: list[str]) -> np.ndarray:
    """For each text whether at least half of its letters and digits are ideographs."""
    t = _tables()
    codes, doc = codes_of(texts)
    word, ideo = t.word[codes], t.ideograph[codes]
    n = np.bincount(doc[word], minlength=len(texts))
    return (np.bincount(doc[ideo & word], minlength=len(texts)) * 2 >= n) & (n > 0)


def tokenise(texts: list[str], chars: bool) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text number) of every token in order: of each letter or digit if chars, else of each word, an ideograph being a word; case, punctuation and spacing aside."""
    t = _tables()
    if not texts:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    codes, doc = codes_of(texts)
    word = t.word[codes]
    if chars:
        return mix(codes[word].astype(np.uint64) + np.uint64(0x9E3779B9)), doc[word]
    at = np.nonzero(word)[0]
    if not len(at):
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    c, d = codes[at], doc[at]
    ideo = t.ideograph[c]
    first = np.ones(len(at), bool)
    first[1:] = (at[1:] != at[:-1] + 1) | ideo[1:] | ideo[:-1]
    starts = np.nonzero(first)[0]
    place = np.arange(len(at)) - starts[np.cumsum(first) - 1]
    h = mix(c.astype(np.uint64) + np.uint64(0x9E3779B9)) * t.powers[np.minimum(place, _LONGEST - 1)]
    return mix(np.add.reduceat(h, starts)), d[starts]


def windows(h: np.ndarray, doc: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, start) of every run of len(weights) tokens inside one text; a weight of 0 leaves a token out of the hash."""
    span = len(weights)
    if len(h) < span:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    start = np.nonzero(doc[: len(doc) - span + 1] == doc[span - 1 :])[0]
    total = np.zeros(len(h) - span + 1, np.uint64)
    for j, w in enumerate(weights):
        if w:
            total += h[j : len(h) - span + 1 + j] * w
    return mix(total[start]), start
