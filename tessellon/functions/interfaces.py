"""Models behind plain functions, with defaults that need no model and always answer alike."""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd


def hashed_embedder(dim: int = 64):
    """texts -> unit vectors of hashed character runs; empty and null texts have none."""

    def embed(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            v = np.zeros(dim, np.float32)
            for i in range(len(t or "") - 2):
                h = zlib.crc32(t[i : i + 3].lower().encode())
                v[h % dim] += 1 if h & 0x10000 else -1
            n = float(np.linalg.norm(v))
            out.append((v / n).tolist() if n else None)
        return pd.Series(out)

    return embed


def overlap_scorer():
    """(queries, contents) -> part of the query's characters pairs that the content holds."""

    def score(queries: pd.Series, contents: pd.Series) -> pd.Series:
        pairs = lambda t: {t[i : i + 2].lower() for i in range(len(t or "") - 1)}
        return pd.Series([len(pairs(q) & pairs(c)) / max(1, len(pairs(q))) for q, c in zip(queries, contents)], dtype=float)

    return score


def first_sentence(n: int = 100):
    """texts -> their first n characters."""

    def summarise(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else (t[:n] + "..." if len(t) > n else t))

    return summarise
