"""Near-duplicate records by banded MinHash and odd sketches.

A text is the set of its runs of `width` tokens. MinHash samples of the sets
are joined by bands to candidates; the samples of each text are also folded
into a parity bitmap, and the population count of the XOR of two bitmaps
estimates their similarity closely, so that most candidates are dismissed by
a few machine words. What remains is compared exactly.

Texts with the same set form one class; only one representative of a class is
compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessellon.llm import groups, tokens
from tessellon.plans.lineage import cut, is_small, keep

#: 64-bit words of an odd sketch, and the MinHash samples folded into it.
WORDS, SAMPLES = 8, 160


def _sets(texts: list[str], width: int, chars: bool) -> tuple[np.ndarray, np.ndarray]:
    """(element, text number), sorted by text, distinct: hashes of the runs of `width` tokens; a shorter text has one run of all its tokens."""
    h, doc = tokens.tokenise(texts, chars)
    weights = np.random.default_rng(width).integers(1, 1 << 62, width, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    run, start = tokens.windows(h, doc, weights)
    owner = doc[start]
    n = np.bincount(doc, minlength=len(texts))
    short = np.nonzero((n > 0) & (n < width))[0]
    if len(short):
        begin = np.searchsorted(doc, short)
        rest = np.array([int(tokens.mix(np.array([(h[b : b + n[s]] * weights[: n[s]]).sum() + np.uint64(n[s])], np.uint64))[0]) for s, b in zip(short, begin)], np.uint64)
        run, owner = np.concatenate([run, rest]), np.concatenate([owner, short])
    order = np.lexsort((run, owner))
    run, owner = run[order], owner[order]
    first = np.ones(len(run), bool)
    first[1:] = (run[1:] != run[:-1]) | (owner[1:] != owner[:-1])
    return run[first], owner[first]


def _typed_sets(texts: list[str], width: int, by_script: bool) -> tuple[np.ndarray, np.ndarray]:
    """_sets of texts, each by words or by characters as its script asks."""
    chars = tokens.is_ideographic(texts) if by_script else np.zeros(len(texts), bool)
    parts = []
    for kind in (False, True):
        of = np.nonzero(chars == kind)[0]
        if len(of):
            run, owner = _sets([texts[i] for i in of], width, kind)
            parts.append((run, of[owner]))
    if not parts:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    run, owner = (np.concatenate([x[i] for x in parts]) for i in range(2))
    if len(parts) > 1:
        order = np.argsort(owner, kind="stable")
        run, owner = run[order], owner[order]
    return run, owner


def _least(elements: np.ndarray, begin: np.ndarray, k: int) -> np.ndarray:
    """k MinHash samples of each set; sets are taken a few at a time, so that their elements stay in the processor's cache."""
    rng = np.random.default_rng(41)
    factor = rng.integers(1, 1 << 31, k, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    addend = rng.integers(0, 1 << 32, k, dtype=np.uint32)
    x = (elements >> np.uint64(32)).astype(np.uint32)
    out = np.empty((len(begin), k), np.uint32)
    ends = np.append(begin[1:], len(x))
    i = 0
    while i < len(begin):
        j = max(i + 1, int(np.searchsorted(ends, begin[i] + 16_384, "right")))
        part, at = x[begin[i] : ends[j - 1]], begin[i:j] - begin[i]
        scratch = np.empty(len(part), np.uint32)
        for s in range(k):
            np.multiply(part, factor[s], out=scratch)
            scratch += addend[s]
            out[i:j, s] = np.minimum.reduceat(scratch, at)
        i = j
    return out


def sketches(rows: DataFrame, width: int, bands: int, band_rows: int, by_script: bool) -> DataFrame:
    """rows (field, key, text) as (id, field, key, text_hash, n, class_a, class_b, bands, o0, o1, ...); texts without a token drop out. Nothing of the text itself stays."""
    k = bands * band_rows
    odd_columns = [f"o{i}" for i in range(WORDS)]
    schema = "id bigint, field string, key string, text_hash bigint, n int, class_a bigint, class_b bigint, bands array<int>, " + ", ".join(f"{c} bigint" for c in odd_columns)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            if not len(p):
                continue
            elements, owner = _typed_sets(p["text"].tolist(), width, by_script)
            if not len(owner):
                continue
            ids, begin = np.unique(owner, return_index=True)
            least = _least(elements, begin, k).astype(np.uint64)
            place = tokens.mix(least + np.arange(k, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            parity = np.zeros((len(ids), 64 * WORDS), np.uint8)
            some = place[:, : min(k, SAMPLES)]
            np.add.at(parity, (np.arange(len(ids))[:, None], (some % np.uint64(64 * WORDS)).astype(np.int64)), 1)
            odd = np.packbits(parity & 1, axis=1).view(np.int64)
            total = np.zeros((len(ids), bands), np.uint64)
            for j in range(band_rows):
                total = tokens.mix(total ^ place.reshape(len(ids), bands, band_rows)[:, :, j])
            # sums over the set: order and repeats of the text don't matter
            class_a, class_b = np.add.reduceat(elements, begin), np.add.reduceat(tokens.mix(elements + np.uint64(5)), begin)
            kept = p.iloc[ids]
            yield pd.DataFrame({
                "id": kept["id"].to_numpy(), "field": kept["field"].to_numpy(), "key": kept["key"].to_numpy(), "text_hash": kept["text_hash"].to_numpy(),
                "n": np.diff(np.append(begin, len(elements))), "class_a": class_a.view(np.int64), "class_b": class_b.view(np.int64),
                "bands": list((total >> np.uint64(32)).astype(np.uint32).view(np.int32)),
            } | {c: odd[:, i] for i, c in enumerate(odd_columns)})

    return identified(rows).mapInPandas(run, schema)


def identified(rows: DataFrame) -> DataFrame:
    """(id, field, key, text_hash, text) of the rows that have a field, a key and a text."""
    ok = rows.where("field is not null and key is not null and text <> ''")
    return ok.select(F.xxhash64("field", "key").alias("id"), "field", "key", F.xxhash64("text").alias("text_hash"), "text")


def _estimate(k: int) -> Column:
    """Similarity from the odd sketches a0, a1, ... and b0, b1, ... of k samples each."""
    n = 64 * WORDS
    differ = sum((F.bit_count(F.col(f"a{i}").bitwiseXOR(F.col(f"b{i}"))) for i in range(WORDS)), F.lit(0))
    apart = F.log(F.greatest(F.lit(1.0) - differ * (2.0 / n), F.lit(1e-3))) * (-n / 2.0)
    return F.lit(1.0) - apart / (2.0 * k)


def classes_and_links(rows: DataFrame, at_least: float = 0.8, width: int = 5, bands: int = 20, band_rows: int = 5, by_script: bool = True, slack: float = 0.2) -> tuple[DataFrame, DataFrame]:
    """(members, links) of rows (field, key, text).

    members: (field, key, rep), rep being the smallest key of the text's class
    (equal sets of runs). links: (field, a, b, similarity) between
    representatives a < b of one field with a Jaccard similarity of at_least.
    Of a repeated key one text counts, that with the smallest hash. Null keys, null texts and
    texts without a letter or digit have no row. by_script: texts mostly of
    ideographs are taken by characters, others by words. slack: by how much the
    sketch's estimate may lie under at_least.
    """
    k = bands * band_rows
    # small numbers for the rows: they make up half of what is banded
    made = keep(sketches(rows, width, bands, band_rows, by_script).withColumn("no", F.monotonically_increasing_id()))
    chosen = keep(made.groupBy("id").agg(F.min(F.struct("text_hash", "class_a", "class_b", "field", "key", "no")).alias("c"), F.count("*").alias("times")).select("id", "c.*", "times"))
    classes = chosen.groupBy("field", "class_a", "class_b").agg(F.min_by(F.struct("id", "key", "text_hash", "no"), "key").alias("r"), F.sum("times").alias("copies"))
    reps = keep(classes.select("field", "class_a", "class_b", "copies", F.col("r.key").alias("rep"), F.col("r.id").alias("id"), F.col("r.text_hash").alias("_h"), F.col("r.no").alias("no")))
    members = keep(chosen.select("field", "key", "class_a", "class_b").join(reps.select("field", "class_a", "class_b", "rep"), ["field", "class_a", "class_b"]).select("field", "key", "rep"))
    asked = reps.select("id", "_h", "no")
    odd = [f"o{i}" for i in range(WORDS)]
    # of classes of many copies only the representative is banded; the few copies of others fall away when sketches are added
    hot = reps.where(F.col("copies") > 16).select("class_a").distinct()
    hot = F.broadcast(hot) if is_small(hot, 100_000) else hot
    alone = made.join(hot, "class_a", "left_semi").join(asked.select("no"), "no", "left_semi").select("no", "field", "bands")
    spread = made.join(hot, "class_a", "left_anti").select("no", "field", "bands").unionByName(alone)
    # the band's place and 32 bits of its hash in one number
    hashed = F.col("hash").bitwiseXOR(F.hash("field")).cast("bigint").bitwiseAND(F.lit(0xFFFFFFFF))
    banded = spread.select("no", F.posexplode("bands").alias("place", "hash"), "field").select("no", F.shiftleft(F.col("place").cast("bigint"), 32).bitwiseOR(hashed).alias("band"))
    # a band of one text pairs nothing; the others meet with their sketches, so that no pair travels before it is estimated
    shared = keep(banded.withColumn("texts", F.count("*").over(Window.partitionBy("band"))).where("texts > 1").select("no", "band"))
    met = shared.join(keep(made.select("no", "n", *odd).join(asked.select("no"), "no")), "no")
    side = lambda x: met.select("band", F.col("no").alias(x), F.col("n").alias(f"n{x}"), *[F.col(c).alias(f"{x}{i}") for i, c in enumerate(odd)])
    fits = (F.col("na") >= F.ceil(F.col("nb") * (at_least - 1e-9))) & (F.col("nb") >= F.ceil(F.col("na") * (at_least - 1e-9)))
    pairs = side("a").join(side("b"), "band").where(F.col("a") < F.col("b")).where(fits).where(_estimate(min(k, SAMPLES)) >= at_least - slack)
    near = cut(pairs.select("a", "b").distinct())
    # what the sketches leave is compared by the texts themselves
    ends = near.select(F.explode(F.array("a", "b")).alias("no")).distinct().join(asked, "no")
    ends = F.broadcast(cut(ends)) if is_small(ends, 1_000_000) else ends
    texts = identified(rows).join(ends, "id").where("text_hash = _h").groupBy("no").agg(F.min(F.struct("key", "field", "text")).alias("t")).withColumnRenamed("no", "id")
    both = near.join(texts.select(F.col("id").alias("a"), F.col("t").alias("ta")), "a").join(texts.select(F.col("id").alias("b"), F.col("t").alias("tb")), "b").where("ta.field = tb.field")

    @F.pandas_udf("double")
    def similarity(x: pd.Series, y: pd.Series) -> pd.Series:
        # a text that stands in several pairs is taken apart once
        n = len(x)
        place, texts = pd.factorize(np.array([*x, *y], dtype=object))
        run, owner = _typed_sets(list(texts), width, by_script)
        size = np.bincount(owner, minlength=len(texts))
        begin = np.cumsum(size) - size
        count = size[place]
        at = np.repeat(begin[place], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        run, pair = run[at], np.repeat(np.arange(2 * n) % max(n, 1), count)
        order = np.lexsort((run, pair))
        run, pair = run[order], pair[order]
        same = (run[1:] == run[:-1]) & (pair[1:] == pair[:-1])
        common = np.bincount(pair[1:][same], minlength=n)
        return pd.Series(common / np.maximum(count[:n] + count[n:] - common, 1))

    both = both.withColumn("similarity", similarity("ta.text", "tb.text")).where(F.col("similarity") >= at_least)
    ka, kb = F.col("ta.key"), F.col("tb.key")
    return members, cut(both.select(F.col("ta.field").alias("field"), F.least(ka, kb).alias("a"), F.greatest(ka, kb).alias("b"), "similarity"))


def near_groups(members: DataFrame, links: DataFrame) -> DataFrame:
    """(field, key, class_key, group_key, n_links): one row for each text; class_key is the smallest key with the same set, group_key the smallest key reached over links, n_links the number of other classes linked with its class."""
    ids = cut(members.select("field", "rep").distinct().withColumn("id", F.monotonically_increasing_id()))
    ends = links.select("field", "a", "b").join(ids.select("field", F.col("rep").alias("a"), F.col("id").alias("ia")), ["field", "a"]).join(ids.select("field", F.col("rep").alias("b"), F.col("id").alias("ib")), ["field", "b"])
    roots = groups.components(ends.select(F.col("ia").alias("a"), F.col("ib").alias("b")))
    rooted = ids.join(roots.withColumnRenamed("v", "id"), "id", "left").select("field", "rep", F.coalesce("root", "id").alias("root"))
    named = rooted.join(rooted.groupBy("root").agg(F.min("rep").alias("group_key")), "root").select("field", "rep", "group_key")
    degree = links.select("field", F.explode(F.array("a", "b")).alias("rep")).groupBy("field", "rep").agg(F.count("*").alias("n_links"))
    one = named.join(degree, ["field", "rep"], "left").withColumn("n_links", F.coalesce("n_links", F.lit(0)))
    return members.join(one, ["field", "rep"]).select("field", "key", F.col("rep").alias("class_key"), "group_key", "n_links")


def key_pairs(members: DataFrame, links: DataFrame, whole_class: int = 256) -> DataFrame:
    """(field, key_a, key_b): the pairs of keys behind classes and links.

    Classes of up to whole_class copies are written out in full. Of a larger
    class the representative stands for all in its links, and each copy is
    paired with the representative, so that n copies make n pairs; near_groups
    has every membership.
    """
    sized = members.groupBy("field", "rep").agg(F.count("*").alias("copies"))
    marked = members.join(sized, ["field", "rep"])
    spoken = marked.where((F.col("copies") <= whole_class) | (F.col("key") == F.col("rep"))).select("field", "rep", "key")
    a, b = spoken.select("field", F.col("rep").alias("a"), F.col("key").alias("ka")), spoken.select("field", F.col("rep").alias("b"), F.col("key").alias("kb"))
    across = links.select("field", "a", "b").join(a, ["field", "a"]).join(b, ["field", "b"]).select("field", F.least("ka", "kb").alias("key_a"), F.greatest("ka", "kb").alias("key_b"))
    copies = marked.where("copies > 1")
    small = copies.where(F.col("copies") <= whole_class).select("field", "rep", "key")
    inside = small.select("field", "rep", F.col("key").alias("key_a")).join(small.select("field", "rep", F.col("key").alias("key_b")), ["field", "rep"]).where("key_a < key_b").select("field", "key_a", "key_b")
    star = copies.where((F.col("copies") > whole_class) & (F.col("key") != F.col("rep"))).select("field", F.col("rep").alias("key_a"), F.col("key").alias("key_b"))
    return across.unionByName(inside).unionByName(star)
