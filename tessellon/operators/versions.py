"""Versions of files by name and by content."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessellon.functions import text as X
from tessellon.operators import graph
from tessellon.plans.lineage import cut, keep


def name_groups(files: DataFrame) -> DataFrame:
    """(folder, base, files): files (folder, filename) of one folder and base name, oldest first; two at least, one with a mark of a version, and no general or event's name."""
    rows = files.select("folder", "filename", X.base_name("filename").alias("base"), X.is_versioned("filename").alias("marked"), X.version_order("filename").alias("o")).distinct()
    got = rows.where(~X.is_generic_name("base")).groupBy("folder", "base").agg(F.count("*").alias("n"), F.max(F.col("marked").cast("int")).alias("m"), F.sort_array(F.collect_list("o")).alias("p"))
    return got.where("n >= 2 and m = 1").select("folder", "base", F.transform("p", lambda x: x["name"]).alias("files"))


def version_map(files: DataFrame) -> DataFrame:
    """(folder, filename, source_key): the base name as source_key of every file in a group."""
    return name_groups(files).select("folder", F.explode("files").alias("filename"), F.col("base").alias("source_key"))


def ungrouped(files: DataFrame) -> DataFrame:
    """files that no group of name_groups holds."""
    return files.join(version_map(files).select("folder", "filename"), ["folder", "filename"], "left_anti")


def _runs(text: str) -> np.ndarray:
    """The different three-character runs of a text, each as one number, in order."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    return np.unique((c[:-2] << np.uint64(42)) | (c[1:-1] << np.uint64(21)) | c[2:])


def _parities(runs: np.ndarray, width: int) -> np.ndarray:
    """Bits of which each says whether an odd number of the runs fall on it; width is a power of two of 64 at least."""
    at = (runs * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(65 - width.bit_length())
    return np.packbits(np.bincount(at.astype(np.int64), minlength=width) & 1)


def _near(bits: np.ndarray, n: np.ndarray, home: np.ndarray, part: np.ndarray, across: bool, at_least: float, most: int = 4_000_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, later row) of all pairs whose Jaccard similarity may be at_least: bits that differ are no more than runs that differ."""
    words, may = bits.view(np.uint64), (1 - at_least) / (1 + at_least)
    block = max(1, most // max(len(n), 1))
    for start in range(0, len(n), block):
        end = min(start + block, len(n))
        differ = np.zeros((end - start, len(n) - start), np.int32)
        for w in range(words.shape[1]):
            differ += np.bitwise_count(words[start:end, w][:, None] ^ words[None, start:, w])
        i, j = np.nonzero(differ <= (n[start:end, None] + n[None, start:]) * may + 1e-6)
        i, j = i + start, j + start
        ok = (i < j) & (home[i] | home[j]) & ((part[i] != part[j]) | (not across))
        yield i[ok], j[ok]


def similar_contents(files: DataFrame, at_least: float = 0.7, first: int | None = None, key: str = "filename", slice_rows: int = 8_000) -> DataFrame:
    """(folder, a, b, similarity): files (folder, key, content) of one folder whose three-character runs, in the first `first` characters if given, have a Jaccard similarity of at_least; texts of 50 characters and fewer take no part.

    Exact. Numbers of runs are divided into steps so wide that similar texts
    stand in one step or in two neighbouring ones; each text goes to its own
    step and the one below. There all pairs are held against each other by
    parity bits, about as many as a text has runs: these can only show too few
    differences, so no pair is lost, and the runs of what they leave are
    compared. Runs themselves never travel. A step of more than slice_rows
    texts of a folder is a grid of slices.
    """
    text = F.substring("content", 1, first) if first else F.col("content")
    rows = keep(files.where("length(content) > 50").select("folder", F.col(key).alias("k"), text.alias("content")))
    kind = dict(rows.dtypes)["k"]
    # a little wider than the ratio, so that no rounding puts a pair two steps apart
    step = -math.log(0.98 * at_least)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            out = []
            for folder, k, content in zip(p["folder"], p["k"], p["content"]):
                runs = _runs(content)
                own = int(math.log(max(len(runs), 1)) / step)
                for at in {own, max(own - 1, 0)}:
                    width = 1 << max(6, math.ceil((at + 1) * step / math.log(2)))
                    out.append((folder, at, k, len(runs), at == own, _parities(runs, width).tobytes()))
            yield pd.DataFrame(out, columns=["folder", "step", "k", "n", "home", "bits"])

    placed = keep(rows.mapInPandas(place, f"folder string, step int, k {kind}, n int, home boolean, bits binary"))
    counts = placed.groupBy("folder", "step").agg(F.count("*").alias("_rows"), F.max(F.length("bits")).alias("_bytes")).where("_rows > 1")
    # slices of texts with long bits are shorter, so that a task's share of memory stays the same
    slices = F.ceil(F.col("_rows") * F.greatest(F.col("_bytes") / 2048, F.lit(1)) / slice_rows).cast("int")
    part = F.pmod(F.xxhash64("k"), F.col("slices")).cast("int")
    cells = F.transform(F.sequence(F.lit(0), F.col("slices") - 1), lambda o: F.struct(F.least(o, F.col("part")).alias("x"), F.greatest(o, F.col("part")).alias("y")))
    sent = placed.join(counts.select("folder", "step", slices.alias("slices")), ["folder", "step"]).withColumn("part", part)
    sent = sent.select("folder", "step", "k", "n", "home", "bits", "part", F.explode(cells).alias("c")).select("folder", "step", "c.*", "k", "n", "home", "bits", "part")

    def search(key: tuple, p: pd.DataFrame) -> pd.DataFrame:
        k, n, home, part = (p[c].to_numpy() for c in ("k", "n", "home", "part"))
        bits = np.frombuffer(b"".join(p["bits"]), np.uint8).reshape(len(p), -1)
        found = list(_near(bits, n, home.astype(bool), part, key[2] != key[3], at_least))
        i, j = (np.concatenate([f[t] for f in found]) for t in range(2))
        return pd.DataFrame({"folder": key[0], "u": k[i], "v": k[j]})

    can = sent.groupBy("folder", "step", "x", "y").applyInPandas(search, f"folder string, u {kind}, v {kind}")
    can = cut(can.where("u <> v").select("folder", F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")).distinct())

    @F.pandas_udf("double")
    def jaccard(x: pd.Series, y: pd.Series) -> pd.Series:
        out = []
        for s, t in zip(x, y):
            s, t = _runs(s), _runs(t)
            both = len(np.intersect1d(s, t, assume_unique=True))
            out.append(both / max(len(s) + len(t) - both, 1))
        return pd.Series(out, dtype=float)

    texts = lambda c: rows.select("folder", F.col("k").alias(c), F.col("content").alias(f"t{c}"))
    both = can.join(texts("a"), ["folder", "a"]).join(texts("b"), ["folder", "b"]).withColumn("similarity", jaccard("ta", "tb"))
    return both.where(F.col("similarity") >= at_least).select("folder", "a", "b", F.round("similarity", 6).alias("similarity"))


def greedy_clusters(pairs: DataFrame) -> DataFrame:
    """(folder, seed, member): files gathered greedily, in order of name, each seed taking the files similar to it that are still free. Files that no chain of pairs (folder, a, b) links don't touch each other, so each linked group of a folder is a task."""
    pairs = keep(pairs)  # for the groups and for the members of each
    of = lambda c: F.concat_ws("\x01", F.col("folder"), F.col(c).cast("string"))
    roots = graph.components(pairs.select(of("a").alias("a"), of("b").alias("b")))
    placed = pairs.withColumn("id", of("a")).join(roots, "id").drop("id")

    def run(key: tuple, p: pd.DataFrame) -> pd.DataFrame:
        near: dict = {}
        for a, b in zip(p["a"], p["b"]):
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
        taken, out = set(), []
        for s in sorted(near):
            if s not in taken:
                mine = sorted(m for m in near[s] if m not in taken)
                if mine:
                    out += [(key[0], s, m) for m in [s, *mine]]
                    taken |= {s, *mine}
        return pd.DataFrame(out, columns=["folder", "seed", "member"])

    kind = dict(pairs.dtypes)["a"]
    return placed.groupBy("folder", "root").applyInPandas(run, f"folder string, seed {kind}, member {kind}")
