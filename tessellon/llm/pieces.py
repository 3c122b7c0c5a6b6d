"""Splitting oversized items at natural boundaries, towards balanced targets.

For a text above the limit the least number of pieces is worked out, targets
are placed so that the pieces would be equally long, and each target is moved
to the strongest boundary near it. If a piece then exceeds the limit, the
split is tried again with one piece more.
"""

from __future__ import annotations

import bisect
import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Boundaries, strongest first; a cut lies at the end of the match.
BOUNDARIES = [
    re.compile(r"\n(?=#{1,6}\s)"),
    re.compile(r"\n[^\S\n]*\n+"),
    re.compile(r"(?<=\|)[^\S\n]*\n(?!\|)|</table>\s*|\n(?=\s*(?:[-*+]|\d+[.)])\s)"),
    re.compile(r"\n+|</tr>\s*"),
    re.compile(r"[.!?](?:[\"')\]]*)\s+|[。！？][”』」]?"),
    re.compile(r"[;:；：]\s*|,\s+|，|、"),
    re.compile(r"\s+"),
]


def _boundaries(text: str) -> list[list[int]]:
    return [[m.end() for m in b.finditer(text) if 0 < m.end() < len(text)] for b in BOUNDARIES]


def _may_cut(text: str, at: int) -> bool:
    """Whether a hard cut may lie at `at`: not before a combining mark, selector or joiner, and not after a joiner."""
    c = ord(text[at])
    return not (0x300 <= c <= 0x36F or 0xFE00 <= c <= 0xFE0F or 0x1F3FB <= c <= 0x1F3FF or c == 0x200D or ord(text[at - 1]) == 0x200D)


def cuts(text: str, limit: int, overlap: int) -> list[tuple[int, int]]:
    """(start, end) of the pieces of text: each at most `limit` long, each but the first beginning `overlap` before the end of the one before it, together the whole text."""
    n = len(text)
    if n <= limit:
        return [(0, n)]
    if not 0 <= overlap < limit:
        raise ValueError("the overlap must be smaller than the limit")
    fresh = limit - overlap
    marks = _boundaries(text)
    count = math.ceil((n - overlap) / fresh)
    while True:
        ideal = (n - overlap) / count
        reach = max(fresh - ideal, 0.25 * ideal)
        ends: list[int] = []
        last = 0
        for i in range(1, count):
            target = overlap + i * ideal
            low = max(last + 1, overlap + 1, int(target - reach))
            high = min(n - 1, int(target + reach), (last + fresh) if ends else limit)
            best = None
            for strong in marks:
                k = bisect.bisect_left(strong, target)
                near = [x for x in strong[max(0, k - 1) : k + 1] if low <= x <= high]
                if near:
                    best = min(near, key=lambda x: abs(x - target))
                    break
            if best is None:
                best = max(low, min(high, round(target)))
                while best > low and not _may_cut(text, best):
                    best -= 1
            ends.append(best)
            last = best
        if n - (last - overlap) <= limit and all(b > a for a, b in zip(ends, ends[1:])):
            starts = [0, *(e - overlap for e in ends)]
            return list(zip(starts, [*ends, n]))
        count += 1


def split(items: DataFrame, limit: Column | int, overlap: int = 100) -> DataFrame:
    """Pieces of the texts above their limit: items' key columns with piece_no, n_pieces, start_at, piece.

    items: any columns with `text` string; limit: an int or a Column over
    items. Lengths are code points. Null and empty texts and texts within the
    limit give no rows; repeated rows are cut alike. Columns named like the
    new ones are refused.
    """
    keys = [c for c in items.columns if c != "text"]
    if clash := {"piece_no", "n_pieces", "start_at", "piece", "_limit"} & set(keys):
        raise ValueError(f"items has columns of the result: {sorted(clash)}")
    over = items.withColumn("_limit", limit if isinstance(limit, Column) else F.lit(limit)).where(F.length("text") > F.col("_limit"))
    schema = over.drop("text", "_limit").schema
    for name, kind in (("piece_no", "integer"), ("n_pieces", "integer"), ("start_at", "integer"), ("piece", "string")):
        schema = schema.add(name, kind)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            at, no, of, starts, pieces = [], [], [], [], []
            for i, (text, size) in enumerate(zip(p["text"], p["_limit"])):
                spans = cuts(text, int(size), overlap)
                at += [i] * len(spans)
                no += range(len(spans))
                of += [len(spans)] * len(spans)
                starts += [a for a, _ in spans]
                pieces += [text[a:b] for a, b in spans]
            out = p[keys].iloc[at].reset_index(drop=True)
            yield out.assign(piece_no=no, n_pieces=of, start_at=starts, piece=pieces)

    return over.mapInPandas(run, schema)
