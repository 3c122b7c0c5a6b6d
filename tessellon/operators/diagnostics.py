"""Measures of an index and of runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BINS = [0, 50, 100, 200, 500, 1000, 2000]


def length_percentiles(rows: DataFrame, text: str, by: list[str]) -> DataFrame:
    """Exact percentiles P10 to P99 of text lengths, with count, least, greatest and mean."""
    n = F.length(text)
    points = [0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99]
    got = rows.where(F.col(text).isNotNull()).groupBy(*by).agg(F.count("*").alias("n"), F.min(n).alias("least"), F.max(n).alias("greatest"), F.round(F.avg(n), 6).alias("mean"), F.percentile(n, F.array(*map(F.lit, points))).alias("p"))
    return got.select(*by, "n", "least", "greatest", "mean", *[F.round(F.col("p")[i], 6).alias(f"p{round(q * 100)}") for i, q in enumerate(points)])


def length_histogram(rows: DataFrame, text: str, bins: list[int] = BINS) -> DataFrame:
    """(low, n, share): texts by the bin of their length; the last bin is open."""
    n = F.length(text)
    low: Column = F.lit(bins[0])
    for b in bins[1:]:
        low = F.when(n >= b, b).otherwise(low)
    got = rows.where(F.col(text).isNotNull()).groupBy(low.alias("low")).agg(F.count("*").alias("n"))
    return got.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 6))


def short_share(rows: DataFrame, text: str, key: str, short: int = 100, top: int | None = 10) -> DataFrame:
    """(key, n, n_short, share): each document's part of short texts; the `top` highest."""
    got = rows.where(F.col(text).isNotNull()).groupBy(key).agg(F.count("*").alias("n"), F.count_if(F.length(text) < short).alias("n_short"))
    got = got.withColumn("share", F.round(F.col("n_short") / F.col("n"), 6))
    return got.orderBy(F.desc("share"), F.desc("n"), key).limit(top) if top else got


def mode_statistics(runs: DataFrame, mode: str, value: str, failed: Column) -> DataFrame:
    """(mode, n, n_failed, mean_value, max_value): runs by mode; means without the failed."""
    return runs.groupBy(mode).agg(F.count("*").alias("n"), F.count_if(failed).alias("n_failed"), F.round(F.avg(F.when(~failed, F.col(value))), 6).alias("mean_value"), F.round(F.max(F.when(~failed, F.col(value))), 6).alias("max_value"))


def streaks(events: DataFrame, key: str, order: list[str], what: str, least: int = 3) -> DataFrame:
    """(key, what, started, n): runs of at least `least` consecutive events of one kind."""
    w = Window.partitionBy(key).orderBy(*order)
    new = F.coalesce((F.col(what) != F.lag(what).over(w)).cast("int"), F.lit(1))
    numbered = events.withColumn("_new", new).withColumn("_run", F.sum("_new").over(w))
    return numbered.groupBy(key, "_run", what).agg(F.min(order[0]).alias("started"), F.count("*").alias("n")).where(F.col("n") >= least).select(key, what, "started", "n")


def usage(steps: DataFrame, key: str, *counters: str) -> DataFrame:
    """(key, counters...): what steps used, added up; a null counts as nothing."""
    return steps.groupBy(key).agg(*[F.sum(F.coalesce(c, F.lit(0))).alias(c) for c in counters])
