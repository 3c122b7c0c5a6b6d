"""Most similar vectors for every vector, by randomly rotated one-bit codes.

Unit vectors are spread over cells (nearest centroids of a bounded sample).
Where a vector is placed it is given its code once: one sign bit for every
coordinate of its randomly rotated residual, packed into machine words, and
scalars: the residual's length and the vector's product with the centroid.
The code travels with the vector in 16 bits a part. In a cell the XOR
population count of two codes estimates their inner product together with a
bound on the error; pairs whose upper bound reaches what is asked for are
compared in 16 bits, and those that this leaves in doubt, beside the
threshold or the last of the k, are reranked by their exact cosine.

Equal vectors form one class with one representative; only representatives
are searched, and copies take part through their class.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessellon.plans.lineage import cut, is_small, keep

#: Rows of which the centroids are fitted at most, and centroids above which cells are looked up in two levels.
SAMPLE, FLAT = 100_000, 2_048
#: Steps into which a vector's largest part is divided where it is sent in 16 bits a part.
STEPS = 32_767


def usable(vectors: DataFrame, dim: int) -> DataFrame:
    """(id, vec, h1, h2) of `vectors` (id, vec) that take part, h1 and h2 hashing the vector; null ids, null and zero vectors, other lengths, null and non-finite parts don't."""
    ok = F.col("id").isNotNull() & (F.size("vec") == dim) & F.forall("vec", lambda x: x.isNotNull() & (F.abs(x) < float("inf"))) & F.exists("vec", lambda x: x != 0)
    return vectors.where(ok).select("id", "vec", F.xxhash64("vec").alias("h1"), F.xxhash64(F.lit(1), "vec").alias("h2"))


def _matrix(vectors: pd.Series) -> np.ndarray:
    """Vectors as rows of length 1."""
    x = np.array(vectors.tolist(), dtype=np.float64)
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def _collected(vectors: DataFrame, dim: int, rows: int = 10_000) -> np.ndarray:
    """The `vec` of vectors as rows of length 1, on the driver, without an object for each."""
    x = np.concatenate([np.empty(0, np.float32), *(np.asarray(c.flatten(), np.float32) for c in vectors.select("vec").toArrow()["vec"].chunks)]).reshape(-1, dim)
    for i in range(0, len(x), rows):
        part = x[i : i + rows].astype(np.float64)
        x[i : i + rows] = part / np.linalg.norm(part, axis=1, keepdims=True)
    return x


def _centroids(sample: np.ndarray, k: int, seed: int, steps: int = 6) -> np.ndarray:
    """Spherical k-means."""
    rng = np.random.default_rng(seed)
    c = sample[rng.choice(len(sample), k, replace=False)].copy()
    block = max(1, 4_000_000 // k)  # all products at once would be as many as rows times centroids
    for _ in range(steps):
        at = np.concatenate([(sample[i : i + block] @ c.T).argmax(1) for i in range(0, len(sample), block)])
        total = np.zeros_like(c)
        np.add.at(total, at, sample)
        n = np.linalg.norm(total, axis=1, keepdims=True)
        c = np.where(n > 0, total / np.maximum(n, 1e-9), c).astype(np.float32)
    return c


def _rotation(dim: int, seed: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return (q * np.sign(np.diag(r))).astype(np.float32)


class Cells:
    """Centroids in one or two levels, and the one-bit codes of residuals against them."""

    def __init__(self, sample: np.ndarray, cells: int, seed: int):
        self.centres = _centroids(sample, cells, seed, steps=6 if cells <= FLAT else 2)
        self.rotation = _rotation(sample.shape[1], seed)
        self.above = _centroids(self.centres, int(math.sqrt(cells)), seed) if cells > FLAT else None
        if self.above is not None:
            self.of = (self.centres @ self.above.T).argmax(1)
            self.inside = [np.nonzero(self.of == i)[0] for i in range(len(self.above))]

    @classmethod
    def of_parts(cls, parts: dict) -> "Cells":
        out = cls.__new__(cls)
        out.__dict__.update(parts)
        return out

    def nearest(self, x: np.ndarray, n: int) -> np.ndarray:
        """The n nearest cells of each row of x, nearest first."""
        if self.above is None:
            near = x @ self.centres.T
            top = np.argpartition(-near, n - 1, axis=1)[:, :n]
            return np.take_along_axis(top, np.argsort(-np.take_along_axis(near, top, 1), axis=1, kind="stable"), 1)
        # a row's cells lie under one of the four groups of cells nearest to it
        groups = np.argpartition(-(x @ self.above.T), 3, axis=1)[:, :4]
        best = np.full((len(x), n), -1, np.int64)
        value = np.full((len(x), n), -2.0, np.float32)
        for g in np.unique(groups):
            rows, own = np.nonzero((groups == g).any(1))[0], self.inside[g]
            if not len(own):
                continue
            near = x[rows] @ self.centres[own].T
            ids = np.concatenate([best[rows], np.broadcast_to(own, near.shape)], 1)
            near = np.concatenate([value[rows], near], 1)
            top = np.argsort(-near, axis=1, kind="stable")[:, :n]
            best[rows], value[rows] = np.take_along_axis(ids, top, 1), np.take_along_axis(near, top, 1)
        return np.where(best < 0, best[:, :1], best)

    def codes(self, x: np.ndarray, cell: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(sign bits of the rotated residuals in words, residuals' lengths, products with the centroids)."""
        c = self.centres[cell]
        residual = x - c
        bits = np.packbits(residual @ self.rotation > 0, axis=1)
        if short := -bits.shape[1] % 8:
            bits = np.pad(bits, ((0, 0), (0, short)))
        return bits.view(np.int64), np.linalg.norm(residual, axis=1).astype(np.float32), np.einsum("ij,ij->i", x, c).astype(np.float32)


def _similar(own: np.ndarray, x: np.ndarray, bits: np.ndarray, length: np.ndarray, product: np.ndarray, square: float, at_least: float, sure: float, off: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(query row, member row, cosine in 16 bits) for pairs of rows of x whose cosine may be at_least; queries are the rows `own`. square: the centroid's product with itself; off: what such a cosine can be off by."""
    d = x.shape[1]
    # cosine of the residuals' angle by the number of different bits, and the most it may be, `sure` deviations of that number away
    n = np.arange(d + 1)
    spread = sure * np.sqrt(np.maximum(n * (d - n), d / 4) / d)
    most = np.cos(np.pi * np.maximum(n - spread, 0) / d).astype(np.float32)
    words = bits.view(np.uint64)
    block = max(1, 4_000_000 // max(len(x), 1))
    for start in range(0, len(own), block):
        q = own[start : start + block]
        differ = np.zeros((len(q), len(x)), np.uint8 if d < 256 else np.uint16)
        for w in range(words.shape[1]):
            differ += np.bitwise_count(words[q, w][:, None] ^ words[None, :, w])
        # <q, x> = <q-c, x-c> + <q, c> + <x, c> - <c, c>
        bound = most[differ] * length[q][:, None] * length[None, :]
        bound += (product[q] - square + off)[:, None] + product[None, :]
        i, j = np.nonzero(bound >= at_least)
        keep = q[i] != j
        i, j = q[i[keep]], j[keep]
        cos = np.einsum("ij,ij->i", x[i], x[j])
        hit = cos >= at_least - off
        yield i[hit], j[hit], cos[hit]


def similar_classes(reps: DataFrame, seen: DataFrame, n: int, dim: int, at_least: float, k: int, cell_rows: int = 400, probes: int = 3, asks_in: int = 3, sure: float = 3.0, seed: int = 7) -> DataFrame:
    """(a, b, cos): for every row of reps (rep, vec: distinct vectors) its k nearest others, as far as their cosine is at_least.

    seen (id, vec) are rows of the same collection, of which centroids are
    fitted (SAMPLE at most) and cells counted; n is about their number. Cells
    hold about cell_rows vectors until SAMPLE centroids are reached; every
    vector is a member of its `probes` nearest cells and asks in the `asks_in`
    nearest. A cell that has far more rows than that is searched in several tasks,
    each holding a slice of the queries and of the members.
    """
    spark = reps.sparkSession
    schema = "a bigint, b bigint, cos double"
    # sixteen rows for each centroid, four at the greatest number of cells
    cells = int(max(1, min(n / cell_rows, SAMPLE / 4)))
    wanted = min(SAMPLE, max(16 * cells, 4_096))
    share = min(1.0, 1.2 * wanted / max(n, 1))
    sample = _collected(seen.where(F.shiftrightunsigned(F.xxhash64("id", F.lit(seed)), 11) < int(share * (1 << 53))).limit(wanted), dim)
    if len(sample) < 2:
        sample = _collected(seen.limit(wanted), dim)
    if n < 2 or not len(sample):
        return spark.createDataFrame([], schema)
    cells = min(cells, len(sample))
    index = Cells(sample, cells, seed)
    # plain arrays, so that executors need no copy of this package to read them
    parts = spark.sparkContext.broadcast(vars(index))
    held: list[Cells] = []

    def cells_of() -> Cells:
        if not held:
            held.append(Cells.of_parts(parts.value))
        return held[0]

    probes = min(probes, cells)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sizes = np.zeros(cells, np.int64)
        for p in batches:
            if len(p):
                sizes += np.bincount(cells_of().nearest(_matrix(p["vec"]), probes).ravel(), minlength=cells)
        yield pd.DataFrame({"cell": np.arange(cells), "n": sizes})

    # a crowded cell becomes a grid of tasks: slices of its queries times slices of its members
    slice_rows = 20 * cell_rows
    # a part is off by half a step at most, so a vector by half a step times the root of its parts
    off = math.sqrt(dim) / STEPS
    counts = seen.select("vec").mapInPandas(count, "cell int, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()  # one number for each cell
    slices = np.ones(cells, np.int64)
    slices[counts["cell"]] = np.maximum(1, -(-counts["n"] // slice_rows))
    code = ", ".join(f"w{i} bigint" for i in range(-(-dim // 64)))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            if not len(p):
                continue
            x = _matrix(p["vec"])
            near = cells_of().nearest(x, probes)
            scale = np.abs(x).max(1) / STEPS
            small = [v.tobytes() for v in np.rint(x / scale[:, None]).astype(np.int16)]
            for i in range(probes):
                again = (near[:, :i] == near[:, i : i + 1]).any(1)
                bits, length, product = cells_of().codes(x, near[:, i])
                made = pd.DataFrame({"cell": near[:, i], "slices": slices[near[:, i]], "own": np.full(len(x), i < asks_in), "rep": p["rep"].to_numpy(), "length": length, "product": product, "scale": scale, "parts": small} | {f"w{w}": bits[:, w] for w in range(bits.shape[1])})
                yield made[~again]

    placed = reps.mapInPandas(place, f"cell int, slices int, own boolean, rep bigint, length float, product float, scale float, parts binary, {code}")
    part = F.pmod(F.xxhash64("rep"), F.col("slices")).cast("int")
    # (query slice, member slice, asks, answers): in a cell of one slice a row stands once for both
    one = F.array(F.struct(F.lit(0).alias("qs"), F.lit(0).alias("ms"), F.col("own").alias("asks"), F.lit(True).alias("answers")))
    others = F.sequence(F.lit(0), F.col("slices") - 1)
    answers = F.transform(others, lambda o: F.struct(o.alias("qs"), part.alias("ms"), F.lit(False).alias("asks"), F.lit(True).alias("answers")))
    asks = F.transform(F.when(F.col("own"), others).otherwise(F.array().cast("array<int>")), lambda o: F.struct(part.alias("qs"), o.alias("ms"), F.lit(True).alias("asks"), F.lit(False).alias("answers")))
    carried = [c for c in placed.columns if c not in ("cell", "slices", "own")]
    sent = placed.select("cell", F.explode(F.when(F.col("slices") == 1, one).otherwise(F.concat(answers, asks))).alias("s"), *carried).select("cell", "s.*", *carried)

    def search(key: tuple, p: pd.DataFrame) -> pd.DataFrame:
        names = p["rep"].to_numpy()
        number = pd.factorize(names)[0]
        x = np.frombuffer(b"".join(p["parts"]), np.int16).reshape(len(p), dim).astype(np.float32) * p["scale"].to_numpy()[:, None]
        bits = np.ascontiguousarray(np.stack([p[f"w{w}"].to_numpy() for w in range(-(-dim // 64))], 1))
        centre = cells_of().centres[key[0]]
        own, answer = np.nonzero(p["asks"].to_numpy())[0], p["answers"].to_numpy()
        found = [(i[ok], j[ok], c[ok]) for i, j, c in _similar(own, x, bits, p["length"].to_numpy(), p["product"].to_numpy(), float(centre @ centre), at_least, sure, off) for ok in [answer[j] & (number[i] != number[j])]]
        if not found:
            return pd.DataFrame({"a": [], "b": [], "cos": []}).astype({"a": int, "b": int, "cos": float})
        i, j, c = (np.concatenate([f[t] for f in found]) for t in range(3))
        out = pd.DataFrame({"a": names[i], "b": names[j], "cos": c.astype(float)}).sort_values(["a", "cos", "b"], ascending=[True, False, True])
        # the k best and whatever 16 bits cannot tell from the last of them
        rank = out.groupby("a", sort=False).cumcount()
        last = out["a"].map(out[rank == k - 1].set_index("a")["cos"]).fillna(-2.0)
        return out[(rank < k) | (out["cos"] >= last - 2 * off)]

    found = sent.groupBy("cell", "qs", "ms").applyInPandas(search, schema)
    # two cells that share both may have found a pair
    found = found.repartition("a").dropDuplicates(["a", "b"])
    by = Window.partitionBy("a")
    ranked = found.withColumn("r", F.row_number().over(by.orderBy(F.desc("cos"), "b")))
    ranked = ranked.withColumn("last", F.max(F.when(F.col("r") == k, F.col("cos"))).over(by)).withColumn("next", F.max(F.when(F.col("r") == k + 1, F.col("cos"))).over(by))
    ranked = ranked.where((F.col("r") <= k) | (F.col("cos") >= F.col("last") - 2 * off))
    # in doubt: beside the threshold, or beside the last of the k where one more comes close
    edge = F.coalesce((F.col("next") >= F.col("last") - 2 * off) & (F.col("cos") <= F.col("last") + 2 * off) & (F.col("cos") >= F.col("last") - 2 * off), F.lit(False))
    ranked = cut(ranked.select("a", "b", "cos", ((F.col("cos") < at_least + off) | edge).alias("doubt")))
    unsure = ranked.where("doubt").select("a", "b")
    ends = unsure.select(F.explode(F.array("a", "b")).alias("rep")).distinct()
    vectors = cut(reps.join(F.broadcast(ends) if is_small(ends, 1_000_000) else ends, "rep", "left_semi"))
    both = unsure.join(vectors.select(F.col("rep").alias("a"), F.col("vec").alias("va")), "a").join(vectors.select(F.col("rep").alias("b"), F.col("vec").alias("vb")), "b")

    @F.pandas_udf("double")
    def exact(u: pd.Series, v: pd.Series) -> pd.Series:
        x, y = (np.array(c.tolist(), dtype=np.float64) for c in (u, v))
        return pd.Series(np.round((x * y).sum(1) / (np.linalg.norm(x, axis=1) * np.linalg.norm(y, axis=1)), 9)) if len(u) else pd.Series([], dtype=float)

    checked = both.select("a", "b", exact("va", "vb").alias("cos")).where(F.col("cos") >= at_least)
    w = by.orderBy(F.desc("cos"), "b")
    return ranked.where("not doubt").select("a", "b", "cos").unionByName(checked).withColumn("r", F.row_number().over(w)).where(F.col("r") <= k).drop("r")


def nearest_pairs(vectors: DataFrame, dim: int = 64, k: int = 5, at_least: float = 0.86, **index) -> DataFrame:
    """(chunk_a, chunk_b): pairs of ids (chunk_a < chunk_b) with a cosine of at_least in which one is among the k most similar of the other.

    vectors: (id string, vec array<float>). Ties are broken by id. Equal
    vectors: each of n copies has the k smallest other ids of its class as
    nearest, so n copies give at most (k + 1) * n pairs. An empty input gives
    an empty result.
    """
    rows = usable(vectors, dim)
    # of one id the vector with the smallest hashes counts; ids get numbers in their order, which stand for them until the end
    named = rows.select("id", "h1", "h2").groupBy("id").agg(F.min(F.struct("h1", "h2")).alias("h")).select("id", "h.*")
    named = cut(named.orderBy("id").withColumn("no", F.monotonically_increasing_id()))
    classes = named.groupBy("h1", "h2").agg(F.min_by(F.struct("id", "no"), "no").alias("r")).select("h1", "h2", "r.id", F.col("r.no").alias("rep"))
    member = cut(named.select("no", "h1", "h2").join(classes.select("h1", "h2", "rep"), ["h1", "h2"]).select(F.col("no").alias("id"), "rep"))
    # vectors travel once, for the representatives alone
    reps = rows.join(classes.select("id", F.col("h1").alias("g1"), F.col("h2").alias("g2"), "rep"), "id").where("h1 = g1 and h2 = g2").dropDuplicates(["id", "h1", "h2"]).select("rep", "vec")
    reps = keep(reps)
    # of a class the k + 1 smallest ids can be somebody's nearest
    first = Window.partitionBy("rep").orderBy("id")
    few = member.withColumn("r", F.row_number().over(first)).where(F.col("r") <= k + 1).select("rep", F.col("id").alias("near"))
    links = similar_classes(reps, rows.select("id", "vec"), named.count(), dim, at_least, k, **index)
    itself = classes.select(F.col("rep").alias("a"), F.col("rep").alias("b"), F.lit(2.0).alias("cos"))
    offered = itself.unionByName(links).join(few.withColumnRenamed("rep", "b"), "b").select(F.col("a").alias("rep"), "near", "cos")
    # of a class's own ids one is dropped for each asker, so k + 1 of the offered are enough
    best = Window.partitionBy("rep").orderBy(F.desc("cos"), "near")
    offered = offered.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k + 1)
    asked = member.join(offered, "rep").where("id <> near")
    # an asker outside the first k + 1 would otherwise have one partner too many
    own_rank = few.select(F.col("near").alias("id"), F.lit(True).alias("listed"))
    asked = asked.join(own_rank, "id", "left").where(F.col("listed") | (F.col("r") <= k))
    pairs = asked.select(F.least("id", "near").alias("a"), F.greatest("id", "near").alias("b")).distinct()
    for end in ("a", "b"):
        pairs = pairs.join(named.select(F.col("no").alias(end), F.col("id").alias(f"chunk_{end}")), end)
    return pairs.select("chunk_a", "chunk_b")
