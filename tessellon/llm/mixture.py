"""Mixing sources to target weights by hash-threshold histograms.

Each text has a random but fixed position in its source, its hash. A source
contributes its texts `q` times and those below a threshold once more, where
the threshold is found from histograms of the tokens by hash bucket: only the
bucket in which the budget ends is refined by further bits of the hash. The
sample is a filter on the hash, never a sort of the texts.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessellon.plans.lineage import cut, is_small


#: Where public vocabularies lie, unless a caller or TESSELLON_TOKENIZERS says otherwise; the one taken is a byte-level BPE for many languages.
FOLDER, RANKS = "/opt/tokenizers", "byte_bpe_multi_50k.tiktoken"
# Fixed value: the pattern that parts a text before the merges of that vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def default_vocabulary() -> str:
    return os.path.join(os.environ.get("TESSELLON_TOKENIZERS", FOLDER), RANKS)


def count_tokens(rows: DataFrame, vocabulary: str | None = None, pattern: str = PATTERN) -> DataFrame:
    """rows (text string and others) with n_tokens bigint instead of text; a null text has 0 tokens. Special tokens' strings are ordinary text.

    vocabulary: a file of ranks on the driver's machine, which goes to the
    executors with the job; pattern: what parts a text before the merges.
    """
    with open(vocabulary or default_vocabulary(), "rb") as f:
        kept = rows.sparkSession.sparkContext.broadcast(f.read())
    keep = [c for c in rows.columns if c != "text"]
    schema = rows.drop("text").schema.add("n_tokens", "long")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in kept.value.splitlines() if line)}
        encoding = tiktoken.Encoding("mixture", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        for p in batches:
            yield p[keep].assign(n_tokens=[len(encoding.encode_ordinary(t)) if t else 0 for t in p["text"]])

    return rows.mapInPandas(run, schema)


#: Sources up to which the tables of one row a source are broadcast; larger ones are joined by a shuffle.
MANY_SOURCES = 100_000


def _by_source(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if is_small(df, MANY_SOURCES) else df


#: Bits of the hash by which each level of the histogram refines the one before it.
LEVEL_BITS = 12
LEVELS = 4


def _bucket(level: int) -> "F.Column":
    """The hash's bits up to `level`, as a number without sign."""
    return F.shiftrightunsigned("h", 64 - LEVEL_BITS * (level + 1))


def thresholds(sized: DataFrame, budgets: DataFrame) -> DataFrame:
    """(source, below): with which texts, those whose leading hash bits lie under `below`, each source spends its budget.

    sized: (source, h, n_tokens); budgets: (source, budget) in tokens. The
    threshold lies on that side of the text at which the budget ends that is
    nearer to the budget; texts that share all LEVEL_BITS * LEVELS bits, one
    but for chance, stay together.
    """
    state = budgets.select("source", F.col("budget").alias("left"), F.lit(0).cast("bigint").alias("prefix"))
    inside = sized
    for level in range(LEVELS):
        histogram = inside.groupBy("source", _bucket(level).alias("bucket")).agg(F.sum("n_tokens").alias("t"))
        w = Window.partitionBy("source").orderBy("bucket")
        upto = histogram.join(_by_source(state), "source").withColumn("sum", F.sum("t").over(w))
        fits = upto.where("sum <= left").groupBy("source").agg(F.max("sum").alias("used"))
        edge = upto.where("sum > left").groupBy("source").agg(F.min("bucket").alias("edge"), F.min("sum").alias("over"))
        bits = LEVEL_BITS
        if level == LEVELS - 1:
            nearer = F.col("over") - F.col("left") < F.col("left") - F.coalesce("used", F.lit(0))
            nxt = state.join(fits, "source", "left").join(edge, "source", "left")
            return nxt.select("source", F.when(F.col("edge").isNull(), (F.col("prefix") + 1) * (1 << bits)).when(nearer, F.col("edge") + 1).otherwise(F.col("edge")).alias("below"))
        nxt = state.join(fits, "source", "left").join(edge, "source", "left")
        state = cut(
            nxt.select(
                "source",
                (F.col("left") - F.coalesce("used", F.lit(0))).alias("left"),
                # without an edge all of the rest fits: the threshold lies behind it
                F.coalesce("edge", F.when(F.lit(level) == 0, F.lit(1 << bits)).otherwise((F.col("prefix") + 1) * (1 << bits))).alias("prefix"),
            )
        )
        inside = sized.join(_by_source(state.select("source", "prefix")), "source").where(_bucket(level) == F.col("prefix")).select("source", "h", "n_tokens")
    raise AssertionError("no level")


def plan(sized: DataFrame, targets: DataFrame, total_tokens: int | None = None, total_share: float | None = None) -> DataFrame:
    """(source, target_share, wanted_share, max_repeats, available, budget, binds): the tokens each listed source is to give.

    wanted_share is target_share rescaled over the sources that have text.
    Without a stated total the mixture is as large as it can be with every
    such source at its wanted share. total_tokens states it in tokens,
    total_share as a part of the tokens that the listed sources have; a source
    that can't give its part then gives all it may. binds: whether max_repeats
    keeps the source from giving more.
    """
    have = sized.groupBy("source").agg(F.sum("n_tokens").alias("available"))
    rows = targets.groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats")).join(have, "source", "left")
    rows = rows.withColumn("available", F.coalesce("available", F.lit(0)))
    able = (F.col("available") > 0) & (F.col("max_repeats") > 0) & (F.col("target_share") > 0)
    whole = Window.partitionBy()  # one row for each listed source
    rows = rows.withColumn("wanted_share", F.when(able, F.try_divide(F.col("target_share"), F.sum(F.when(able, F.col("target_share"))).over(whole))).otherwise(0.0))
    cap = F.col("available") * F.col("max_repeats")
    if total_tokens is not None:
        size = F.lit(float(total_tokens))
    elif total_share is not None:
        size = F.sum(F.when(able, F.col("available"))).over(whole) * F.lit(float(total_share))
    else:
        size = F.min(F.when(able, cap / F.col("wanted_share"))).over(whole)
    part = F.floor(F.col("size") * F.col("wanted_share") + 1e-6)
    rows = rows.withColumn("size", size).withColumn("budget", F.when(able, F.least(cap, part)).otherwise(0).cast("bigint"))
    return rows.withColumn("binds", F.coalesce(able & (part >= cap), F.lit(False))).drop("size")


def mix(documents: DataFrame, targets: DataFrame, total_tokens: int | None = None, total_share: float | None = None, vocabulary: str | None = None, pattern: str = PATTERN, seed: int = 1) -> tuple[DataFrame, DataFrame]:
    """(uses, shares) of a mixture of documents (doc_id, source, text) by targets (source, target_share, max_repeats).

    uses: (doc_id, source, n_tokens, uses): the texts taken and how often.
    shares: one row for each listed source, also those without text; see plan.
    A text that stands under several doc_ids counts once, with its smallest
    doc_id of a listed source, so that no text is used more than max_repeats
    times. Null and empty texts, null and unlisted sources give nothing.
    """
    listed = targets.where("source is not null").select("source").distinct()
    rows = documents.where("text <> '' and source is not null and doc_id is not null").join(_by_source(listed), "source", "left_semi")
    counted = count_tokens(rows.select("doc_id", "source", F.sha2("text", 256).alias("key"), "text"), vocabulary, pattern)
    once = counted.groupBy("key").agg(F.min(F.struct("doc_id", "source", "n_tokens")).alias("m")).select("m.*")
    sized = cut(once.where("n_tokens > 0").withColumn("h", F.xxhash64("doc_id", F.lit(seed))))
    wanted = cut(plan(sized, targets, total_tokens, total_share))
    base = wanted.select("source", F.when(F.col("available") > 0, F.floor(F.try_divide(F.col("budget"), F.col("available")))).otherwise(0).cast("int").alias("q"), "budget", "available")
    base = cut(base.withColumn("budget", F.col("budget") - F.col("q") * F.col("available")))
    below = thresholds(sized.select("source", "h", "n_tokens"), base.select("source", "budget"))
    last = _bucket(LEVELS - 1)
    uses = sized.join(_by_source(cut(base.select("source", "q").join(below, "source"))), "source")
    uses = uses.withColumn("uses", F.col("q") + (last < F.col("below")).cast("int")).where("uses > 0").select("doc_id", "source", "n_tokens", "uses")
    got = uses.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("uses")).alias("mixed_tokens"), F.count("*").alias("n_texts"), F.max("uses").alias("most_uses"))
    shares = wanted.join(got, "source", "left").withColumn("mixed_tokens", F.coalesce("mixed_tokens", F.lit(0)))
    shares = shares.select("source", "target_share", "wanted_share", F.try_divide(F.col("mixed_tokens"), F.sum("mixed_tokens").over(Window.partitionBy())).alias("actual_share"), "max_repeats", "available", "budget", "binds", "mixed_tokens", F.coalesce("n_texts", F.lit(0)).alias("n_texts"), F.coalesce("most_uses", F.lit(0)).alias("most_uses"))
    return uses, shares
